"""The raw zone: immutable payload versions and their manifest."""

from __future__ import annotations

import datetime as dt

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickerlake.operators import timejoin

KEYS = ["source_system", "trade_date"]


def with_checksum(payloads: DataFrame) -> DataFrame:
    return payloads.withColumn("checksum", F.sha2("content", 256))


def version_chain(arrivals: DataFrame) -> DataFrame:
    """Add ``previous_checksum``: the one before, per (source, date), by arrival."""
    return timejoin.sliced_lag(arrivals, KEYS, "arrival", "checksum", "previous_checksum")


def idempotent_anti(payloads: DataFrame, manifest: DataFrame) -> DataFrame:
    """Payloads that are not already the current version."""
    return payloads.join(manifest.select(*KEYS, F.col("current_checksum").alias("checksum")), [*KEYS, "checksum"], "left_anti")


def raw_zone_write(payloads: DataFrame, manifest: DataFrame, stored: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(new versions, manifest after) for arriving payloads.

    ``payloads``: source_system, trade_date, arrival (long, unique per key),
    checksum, row_count and whatever else goes along; ``manifest``: source_system,
    trade_date, current_checksum, previous_checksum, row_count.  A payload equal to
    the current one is a no-op; an earlier payload coming back becomes current again
    (``created`` false).  ``stored``: checksums already on storage.
    """
    narrow = payloads.select(*KEYS, "arrival", "checksum", "row_count")
    begin = manifest.select(*KEYS, F.lit(-1).cast("long").alias("arrival"), F.col("current_checksum").alias("checksum"), "row_count")
    chain = version_chain(narrow.unionByName(begin))
    changed = chain.where((F.col("arrival") >= 0) & (F.col("previous_checksum").isNull() | (F.col("checksum") != F.col("previous_checksum"))))
    first = narrow.groupBy(*KEYS, "checksum").agg(F.min("arrival").alias("_first"))
    known = manifest.select(*KEYS, F.col("current_checksum").alias("checksum"))
    if stored is not None:
        known = known.unionByName(stored.select(*KEYS, "checksum"))
    known = known.distinct().withColumn("_known", F.lit(True))
    versions = (
        changed.join(first, [*KEYS, "checksum"]).join(known, [*KEYS, "checksum"], "left")
        .withColumn("created", F.col("_known").isNull() & (F.col("arrival") == F.col("_first")))
        .withColumn("updated", F.lit(True)).drop("_first", "_known", "row_count")
        .join(payloads.drop("checksum"), [*KEYS, "arrival"])
    )
    cols = ["checksum", "previous_checksum", "row_count"]
    steps = versions.select(*KEYS, "arrival", *cols).unionByName(
        manifest.select(*KEYS, F.lit(-1).cast("long").alias("arrival"), F.col("current_checksum").alias("checksum"), "previous_checksum", "row_count"))
    after = timejoin.latest_by(steps, KEYS, [F.col("arrival")], cols).withColumnRenamed("checksum", "current_checksum")
    return versions, after


def save_versions(versions: DataFrame, path: str) -> None:
    """Append versions, one folder per source and trade date."""
    versions.write.mode("append").partitionBy(*KEYS).parquet(f"{path}/versions")


#: Batches between two snapshots of the manifest.
EVERY = 50
MANIFEST = "source_system string, trade_date date, current_checksum string, previous_checksum string, row_count long"


def save_manifest(manifest: DataFrame, path: str, batch: int) -> None:
    """A batch's manifest rows, under its number, so that a retry rewrites its own.  Keys it leaves out stay as they were."""
    manifest.write.mode("overwrite").parquet(f"{path}/manifest/batch={batch}")


def stored(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """A table's rows; none before it is first written."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def last_snapshot(spark: SparkSession, path: str, before: int | None = None) -> int:
    """The last batch that a whole snapshot holds (of those before a number); -1 if there is none."""
    done = stored(spark, f"{path}/snapshots", "taken_upto long")
    if before is not None:
        done = done.where(F.col("taken_upto") < before)
    return done.agg(F.coalesce(F.max("taken_upto"), F.lit(-1))).head()[0]


def take_snapshot(spark: SparkSession, path: str, upto: int) -> None:
    """The newest manifest row of every key as batch ``upto`` has left it, so that reads open no earlier batch.

    It is written under its number and then entered in the list of snapshots; a repetition leaves the same.
    """
    newest_manifest(spark, path, upto + 1).write.mode("overwrite").parquet(f"{path}/snapshot/upto={upto}")
    spark.range(1).select(F.lit(upto).cast("long").alias("taken_upto")).write.mode("overwrite").parquet(f"{path}/snapshots/number={upto}")


def newest_manifest(spark: SparkSession, path: str, before: int | None = None, keys: DataFrame | None = None) -> DataFrame:
    """The newest row of each key (of ``keys`` only), from all batches or those before a number.

    A read starts from the last snapshot and opens the batches behind it alone.
    """
    start = last_snapshot(spark, path, before)
    rows = stored(spark, f"{path}/manifest", f"{MANIFEST}, batch long").where(F.col("batch") > start)
    if before is not None:
        rows = rows.where(F.col("batch") < before)
    if start >= 0:
        rows = rows.unionByName(spark.read.schema(MANIFEST).parquet(f"{path}/snapshot/upto={start}").withColumn("batch", F.lit(start).cast("long")))
    if keys is not None:
        rows = rows.join(keys.select(*KEYS).distinct(), KEYS, "left_semi")
    return timejoin.latest_by(rows, KEYS, [F.col("batch")], ["current_checksum", "previous_checksum", "row_count"])


def current_rows(versions: DataFrame, manifest: DataFrame) -> DataFrame:
    """Rows of the current payloads with their record id and arrival time.

    ``versions`` has rows_json (array of objects) and written_at.
    """
    current = manifest.select(*KEYS, F.col("current_checksum").alias("checksum"))
    # superseded payloads leave before anything wide is shuffled
    kept = versions.join(current, [*KEYS, "checksum"], "left_semi")
    once = timejoin.latest_by(kept, [*KEYS, "checksum"], [F.col("arrival")], ["rows_json", "written_at"])
    return once.select(
        *KEYS, "checksum", F.col("written_at").alias("ingested_ts"), F.posexplode(F.from_json("rows_json", "array<map<string,string>>")).alias("_i", "row"),
    ).withColumn("source_record_id", F.concat(F.col("checksum"), F.lit(".json:"), F.col("_i").cast("string"))).drop("_i")


def raw_zone_read_current(spark: SparkSession, path: str, source: str | None = None, trade_date: dt.date | None = None) -> DataFrame:
    """Follow the newest manifest row of each key to the current payload and give its rows."""
    manifest = newest_manifest(spark, path)
    versions = spark.read.parquet(f"{path}/versions")
    # partition filters reach the file listing
    if source is not None:
        versions, manifest = versions.where(F.col("source_system") == source), manifest.where(F.col("source_system") == source)
    if trade_date is not None:
        versions, manifest = versions.where(F.col("trade_date") == F.lit(trade_date)), manifest.where(F.col("trade_date") == F.lit(trade_date))
    return current_rows(versions, manifest)
