"""Stored price tables that take merges in place.

A table lies in folders by period (a month, say) and slot (a hash of the instrument), each in buckets of the key.  A merge reads and
rewrites only the folders its rows fall into; stored rows are read bucket by bucket and never shuffled, incoming ones
are brought to them.  Folders in which no row changes keep their files.
"""

from __future__ import annotations

import datetime as dt
import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickerlake.operators import merge, timejoin
from tickerlake.sources import rawzone

KEYS = ["instrument_id", "trade_date"]
PLACE = ["period", "slot"]
OVERWRITE = "spark.sql.sources.partitionOverwriteMode"


@dataclass(frozen=True)
class Bucketed:
    """Name in the session's catalog and folder of a table; slots, buckets and the period's date pattern are fixed when it is first opened.

    A month of a billion rows in 16 slots of 64 buckets has files of about a million rows; take fewer, or years, for small tables.
    A merge reads a bucket of all folders it touches in one task: ``buckets_for`` keeps such a task's rows bounded.
    """

    name: str
    path: str
    slots: int = 16
    buckets: int = 64
    period: str = "yyyy-MM"


#: Rows of a bucket over all folders that a merge touches, about.
BUCKET_ROWS = 1_000_000


def buckets_for(rows: int, least: int = 4) -> int:
    """Buckets for merges that touch up to ``rows`` stored rows at once."""
    return max(least, math.ceil(rows / BUCKET_ROWS))


def open_table(spark: SparkSession, table: Bucketed, schema: T.StructType) -> DataFrame:
    """The table, made when it is not there yet; one that was written with other slots or buckets is an error.

    ``schema`` holds instrument_id, trade_date, ingested_at, source_record_id and whatever else goes along.
    """
    taken = set(PLACE) & {n.lower() for n in schema.names}
    if taken:
        raise ValueError(f"the table's own columns are named {sorted(taken)}")
    definition = f"{table.path}/definition"
    known = rawzone.stored(spark, definition, "slots int, buckets int, period string").head()
    if known is None:
        spark.createDataFrame([], schema).write.mode("append").parquet(f"{table.path}/rows")  # the folder itself
        spark.range(1).select(F.lit(table.slots).alias("slots"), F.lit(table.buckets).alias("buckets"), F.lit(table.period).alias("period")).write.mode("overwrite").parquet(definition)
    elif tuple(known) != (table.slots, table.buckets, table.period):
        raise ValueError(f"{table.path} has {known.slots} slots of {known.buckets} buckets, periods {known.period}")
    if not spark.catalog.tableExists(table.name):
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
        spark.sql(f"CREATE TABLE {table.name} ({columns}, period STRING, slot INT) USING parquet PARTITIONED BY (period, slot) "
                  f"CLUSTERED BY ({', '.join(KEYS)}) INTO {table.buckets} BUCKETS LOCATION '{table.path}/rows'")
        spark.catalog.recoverPartitions(table.name)  # folders that another session has written
    return spark.table(table.name)


def _placed(rows: DataFrame, table: Bucketed) -> DataFrame:
    """Rows with their period and slot; a row without a key has no place and fails the merge."""
    whole = F.col(KEYS[0]).isNotNull() & F.col(KEYS[1]).isNotNull()
    period = F.when(whole, F.date_format("trade_date", table.period)).otherwise(F.raise_error(F.lit("a row has no instrument or no trade date")))
    return rows.withColumns({"period": period, "slot": F.pmod(F.xxhash64("instrument_id"), F.lit(table.slots)).cast("int")})


def _folders(places: DataFrame) -> Column:
    """A filter on the folders that occur in ``places``: plain values, at most as many as the table has folders."""
    slots: dict[str, list[int]] = {}
    for r in places.select(*PLACE).distinct().toLocalIterator():
        slots.setdefault(r.period, []).append(r.slot)
    return reduce(Column.__or__, [(F.col("period") == p) & F.col("slot").isin(sorted(s)) for p, s in sorted(slots.items())], F.lit(False))


def _merged(stored: DataFrame, fresh: DataFrame, cols: list[str]) -> DataFrame:
    """One row a key: the fresh one where it is new or strictly newer, with ``_won`` and the time of the row it replaces."""
    old = stored.select(*KEYS, *[F.col(c).alias(f"_o_{c}") for c in cols], F.lit(True).alias("_stored"))
    new = fresh.select(*KEYS, *[F.col(c).alias(f"_n_{c}") for c in cols], F.lit(True).alias("_fresh"))
    newer = F.coalesce(F.col("_n_ingested_at") > F.col("_o_ingested_at"), F.col("_n_ingested_at").isNotNull() & F.col("_o_ingested_at").isNull())
    won = F.col("_fresh").isNotNull() & (F.col("_stored").isNull() | newer)
    return old.join(new, KEYS, "full").select(
        *KEYS, *[F.when(won, F.col(f"_n_{c}")).otherwise(F.col(f"_o_{c}")).alias(c) for c in cols],
        won.alias("_won"), F.when(won, F.col("_o_ingested_at")).alias("existing_ingested_at"), F.col("_stored").isNotNull().alias("_stored"))


def merge_into(spark: SparkSession, table: Bucketed, incoming: DataFrame, as_of: dt.datetime | None, folder: str) -> DataFrame:
    """Merge rows into an opened table by the rule of ``merge.merge_ohlcv``; gives the superseded rows.

    ``folder`` keeps the merged folders until the table has them.  A merge that was cut off is called again with the
    same folder, before any other: it goes on from there, so that a half replaced table is made whole.  Equal times
    leave the stored row; no incoming rows change nothing; rows without a key are an error.
    """
    cols = [c for c in spark.table(table.name).columns if c not in (*KEYS, *PLACE)]
    types = {f.name: f.dataType for f in spark.table(table.name).schema}
    schema = T.StructType([T.StructField(c, types[c]) for c in (*KEYS, *cols)])
    place = T.StructType([T.StructField("period", T.StringType()), T.StructField("slot", T.IntegerType())])
    marks = T.StructType([T.StructField("_won", T.BooleanType()), T.StructField("existing_ingested_at", types["ingested_at"]), T.StructField("_stored", T.BooleanType())])
    if rawzone.stored(spark, f"{folder}/done", "done boolean").isEmpty():
        typed = incoming.select(*[F.col(c).cast(types[c]).alias(c) for c in (*KEYS, *cols)])
        # dealt as the buckets are, so that a file of fresh rows falls into one bucket, and each folder gets few files of a bucket
        typed = typed.repartition(table.buckets, *KEYS)
        best = timejoin.latest_by(typed, KEYS, [F.col("ingested_at"), F.col("source_record_id")], cols)
        _placed(best, table).write.mode("overwrite").parquet(f"{folder}/fresh")
        fresh = spark.read.schema(T.StructType([*schema, *place])).parquet(f"{folder}/fresh")
        touched = spark.table(table.name).where(_folders(fresh))
        _placed(_merged(touched, fresh, cols), table).write.mode("overwrite").partitionBy(*PLACE).parquet(f"{folder}/merged")
        spark.range(1).select(F.lit(True).alias("done")).write.mode("overwrite").parquet(f"{folder}/done")
    merged = spark.read.schema(T.StructType([*schema, *marks, *place])).parquet(f"{folder}/merged")
    changed = _folders(merged.where("_won"))  # values, as a join by folder would bring each whole folder to one task
    before = spark.conf.get(OVERWRITE)
    spark.conf.set(OVERWRITE, "dynamic")
    try:
        merged.where(changed).select(*spark.table(table.name).columns).write.insertInto(table.name, overwrite=True)
    finally:
        spark.conf.set(OVERWRITE, before)
    return merge.superseded(merged.where("_won and _stored"), as_of)
