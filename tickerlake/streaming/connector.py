"""A connector's whole run as a stream: arriving files to checked rows, raw versions and run events.

A micro-batch has several outputs.  Each is written under the batch's number, in a folder that a repeated batch
overwrites, and a marker is written behind the last of them.  Readers go by the markers: of a batch that was cut
off between two writes nothing is seen, and its repetition leaves what an undisturbed run leaves.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tickerlake import session
from tickerlake.functions import text
from tickerlake.operators import quality, validate
from tickerlake.sources import bhavcopy, rawzone

SOURCE = "NSE_EOD"
#: What a batch writes, in this order; "rows" are the contents of the versions it creates.
OUTPUTS = ("valid", "rejected", "refused", "incidents", "rows", "versions", "manifest", "runs", "events")
#: A batch's checked rows, which are left empty once its outputs are parted; a repeated batch writes them again.
CHECKED = "checked"


def line_parts(lines: Column) -> list[Column]:
    """Two parts of each line's hash, whole numbers of 60 bits."""
    whole = F.md5(lines)
    return [F.conv(F.substring(whole, at, 15), 16, 10).cast("long") for at in (1, 17)]


def digest_of(parts: list[Column]) -> Column:
    """A digest of a set of lines in any order, from their parts, as an aggregate that combines map-side: their number and
    the parts' sums.  Halves of a part are added as whole numbers and put together once, as adding decimals costs more."""
    half = 1 << 30
    sums = [F.sum(F.shiftright(p, 30)).cast("decimal(20,0)") * F.lit(half).cast("decimal(10,0)") + F.sum(p.bitwiseAND(F.lit(half - 1))).cast("decimal(20,0)") for p in parts]
    return F.sha2(F.concat_ws(":", F.count("*").cast("string"), *[s.cast("string") for s in sums]), 256)


def content_digest(lines: Column) -> Column:
    """The same of the lines themselves."""
    return digest_of(line_parts(lines))


def write(rows: DataFrame, out: str, name: str, number: int) -> DataFrame:
    """The batch's output, as it is written; what follows from it starts there."""
    path = f"{out}/{name}/batch={number}"
    rows.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def committed(spark: SparkSession, out: str, name: str) -> DataFrame:
    """An output's rows of all batches that were written to their end, with their ``batch``."""
    done = spark.read.parquet(f"{out}/commits").select(F.col("batch").cast("int").alias("batch"))
    return spark.read.parquet(f"{out}/{name}").withColumn("batch", F.col("batch").cast("int")).join(done, "batch", "left_semi")


def deliver(
    batch: DataFrame, number: int, out: str, trade_date: dt.date | str, contract: T.StructType, as_of: dt.datetime, keep: list[str] | None = None, source: str = SOURCE
) -> None:
    """One micro-batch of raw NSE rows: all OUTPUTS, then the marker.

    valid and rejected: rows as ``bhavcopy.nse_rows`` parts them; of the valid ones those that break the contract
    are refused, with incidents.  All rows of a trade day in the batch are one delivery, known by a digest of their
    texts: one equal to the day's current version changes nothing, another becomes the current version, and the
    contents of one not stored before are written.  Every delivery is a run with its START and END.  A trade day
    that cannot be read belongs to no delivery; its rows are rejected.
    """
    spark, keep = batch.sparkSession, keep or []
    day = F.col(trade_date).cast("date") if isinstance(trade_date, str) else F.lit(trade_date)
    raw = F.struct(*bhavcopy.NSE_HEADERS)
    line = F.to_json(F.struct(*(F.coalesce(F.col(c), F.lit("")).alias(f"_{i}") for i, c in enumerate(bhavcopy.NSE_HEADERS))))
    # typed columns take the place of those of the file whose names differ in case only, so these are set aside first
    marked = batch.withColumns({"_raw": raw, "_line": line, "_day": day})
    fields = bhavcopy.check_rows(marked, "NSE", trade_date).withColumn("_fields", F.struct(*bhavcopy.ROW))
    outcome = F.when(F.col("error").isNotNull(), "rejected").when(F.col("reason").isNotNull(), "refused").otherwise("valid")
    judged = validate.judge_contract(fields, contract, "_fields").withColumn("_outcome", outcome)
    own = lambda name, c: F.when(F.col("_outcome") == name, F.col(c))
    # every row is parsed and judged once; it is kept until the outputs are parted, and of its texts what its own output holds
    checked = write(judged.select(
        *keep, F.col("_day").alias("trade_date"), "_outcome", own("valid", "_typed").alias("_row"), own("rejected", "_raw").alias("_raw"), "error",
        own("refused", "symbol").alias("_symbol"), own("refused", "reason").alias("_reason"), *[p.alias(f"_part{i}") for i, p in enumerate(line_parts(F.col("_line")))]), out, CHECKED, number)
    valid = write(checked.where("_outcome = 'valid'").select(*keep, "trade_date", "_row.*"), out, "valid", number)
    write(checked.where("_outcome = 'rejected'").select(*keep, "_raw.*", "error"), out, "rejected", number)
    refused = write(checked.where("_outcome = 'refused'").select(*keep, "trade_date", F.col("_symbol").alias("symbol"), F.col("_reason").alias("reason")), out, "refused", number)
    write(quality.contract_incidents(refused, f"raw_zone:{source}", as_of)[1], out, "incidents", number)

    parts = [F.col("_part0"), F.col("_part1")]
    payloads = checked.where("trade_date is not null").groupBy("trade_date").agg(
        digest_of(parts).alias("checksum"), F.count_if(F.col("_outcome") == "valid").alias("row_count")).select(
        F.lit(source).alias("source_system"), "trade_date", F.lit(number).cast("long").alias("arrival"), "checksum", "row_count")
    keys = rawzone.KEYS
    if number > 0:
        before = rawzone.newest_manifest(spark, out, number, payloads).select(*keys, F.col("current_checksum").alias("previous_checksum"))
        stored = spark.read.parquet(f"{out}/versions").where(F.col("batch") < number).join(payloads.select(*keys), keys, "left_semi").select(*keys, "checksum").distinct()
        judged = payloads.join(before, keys, "left").join(stored.withColumn("_stored", F.lit(True)), [*keys, "checksum"], "left")
    else:
        judged = payloads.withColumns({"previous_checksum": F.lit(None).cast("string"), "_stored": F.lit(None).cast("boolean")})
    updated = ~F.col("checksum").eqNullSafe(F.col("previous_checksum"))
    done = judged.withColumns({
        "updated": updated, "created": updated & F.col("_stored").isNull(), "pipeline_run_id": F.concat_ws("|", "source_system", "trade_date", F.lit(str(number)))}).drop("_stored")
    done = session.stage(done, "runs")
    write(spark.createDataFrame([], checked.schema), out, CHECKED, number)  # nothing reads the checked rows from here on
    versions = done.where("updated").drop("pipeline_run_id")
    contents = valid.join(versions.where("created").select("trade_date", "source_system", "checksum"), "trade_date")
    after = versions.select(*keys, F.col("checksum").alias("current_checksum"), "previous_checksum", "row_count")

    load = text.payload_json(attempt=F.lit(1), row_count=F.col("row_count"), checksum=F.col("checksum"), created=F.col("created"), updated=F.col("updated"))
    first = F.struct(F.lit("START").alias("event_type"), F.concat(F.lit("Connector "), F.col("source_system"), F.lit(" started")).alias("message"), F.lit(None).cast("string").alias("metrics_payload"))
    last = F.struct(F.lit("END").alias("event_type"), F.concat(F.lit("raw_write_confirmed path="), F.concat_ws("/", "source_system", "trade_date")).alias("message"), load.alias("metrics_payload"))
    write(contents, out, "rows", number)
    write(versions, out, "versions", number)
    write(after, out, "manifest", number)
    write(done.select("pipeline_run_id", F.lit("SCHEDULED").alias("run_mode"), F.lit("SYSTEM").alias("triggered_by"), F.lit("SUCCESS").alias("status"), "trade_date", F.lit(as_of).alias("confirmed_at")), out, "runs", number)
    write(done.select("pipeline_run_id", F.explode(F.array(first, last)).alias("_e")).select("pipeline_run_id", "_e.*", F.lit(as_of).alias("event_ts")), out, "events", number)
    write(spark.range(1).select(F.lit(as_of).alias("committed_at")), out, "commits", number)
    if number % rawzone.EVERY == rawzone.EVERY - 1:
        rawzone.take_snapshot(spark, out, number)


def stream_connector(
    spark: SparkSession, folder: str, out: str, checkpoint: str, trade_date: dt.date | str, contract: T.StructType, as_of: dt.datetime,
    columns: list[str] | None = None, keep: list[str] | None = None,
) -> StreamingQuery:
    """Arriving NSE files through ``deliver``.  ``columns``: the files' columns in order, when they have more than the
    standard ones.  A file whose header differs in names or order fails the batch, which then leaves no marker."""
    names = columns or bhavcopy.NSE_HEADERS
    validate.require_columns(spark.createDataFrame([], ", ".join(f"{n} string" for n in names)), bhavcopy.NSE_HEADERS, "required NSE")
    files = spark.readStream.option("header", True).option("enforceSchema", False).schema(", ".join(f"{n} string" for n in names)).csv(folder)
    store = lambda batch, number: deliver(batch, number, out, trade_date, contract, as_of, keep)
    return files.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
