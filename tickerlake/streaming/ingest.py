"""Streaming ingest: arriving files, payload dedupe, late corrections, breaker.

Every micro-batch writes under its own batch number or merges idempotently, so a
batch replayed after a failure leaves the same state.
"""

from __future__ import annotations

import datetime as dt
import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tickerlake.functions import dates
from tickerlake.operators import breaker, merge
from tickerlake.sources import bucketed, rawzone

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def stream_dedupe_payloads(payloads: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Arriving payloads -> raw zone; a payload equal to the current one is dropped.

    ``payloads``: source_system, trade_date, arrival, checksum, row_count, ...
    """

    def store(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        # only the batch's keys are read, and their manifest rows appended
        manifest = rawzone.newest_manifest(spark, out, number, batch) if number > 0 else spark.createDataFrame([], rawzone.MANIFEST)
        stored = None
        if number > 0:  # what earlier batches have stored for this batch's keys: a payload that returns is not created again
            earlier = spark.read.parquet(f"{out}/versions").where(F.col("batch") < number)
            stored = earlier.join(batch.select(*rawzone.KEYS).distinct(), rawzone.KEYS, "left_semi").select(*rawzone.KEYS, "checksum")
        versions, after = rawzone.raw_zone_write(batch, manifest, stored)
        versions.write.mode("overwrite").parquet(f"{out}/versions/batch={number}")
        rawzone.save_manifest(after, out, number)
        if number % rawzone.EVERY == rawzone.EVERY - 1:
            rawzone.take_snapshot(spark, out, number)

    return payloads.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def guard_times(rows: DataFrame, as_of: dt.datetime, days: int = 5) -> DataFrame:
    """Add ``reason`` for rows from the future (over an hour) or stale by weekdays."""
    limit = dates.subtract_trading_days(F.lit(as_of.date()), days)
    return rows.withColumn(
        "reason",
        F.when(F.col("event_ts") > F.lit(as_of) + F.expr("interval 1 hour"), "future_event_ts").when(F.col("event_ts").cast("date") < limit, "event_ts_stale"))


def _event_clock(batch: DataFrame, number: int, staging: str) -> dt.datetime | None:
    """The newest event time of all earlier batches (none before the first), and the batch's own kept for the next.

    Each batch leaves one row that covers all before it, so that only the last one is read; a repeated batch leaves the same.
    """
    spark = batch.sparkSession
    before = rawzone.stored(spark, f"{staging}/clock/upto={number - 1}", "newest timestamp").head() if number > 0 else None
    known = before.newest if before else None
    batch.agg(F.greatest(F.max("event_ts"), F.lit(known).cast("timestamp")).alias("newest")).write.mode("overwrite").parquet(f"{staging}/clock/upto={number}")
    return known


def stream_late_corrections(rows: DataFrame, table: str | bucketed.Bucketed, staging: str, checkpoint: str, as_of: dt.datetime | None, days: int = 5) -> StreamingQuery:
    """Merge arriving rows into ``table``: a strictly newer ``ingested_at`` replaces the stored row.

    Rows that come too late, or from the future, are written to ``staging/refused`` with their reason, in the batch's
    own folder.  Without ``as_of`` the clock is the newest event time of earlier batches, as a watermark's: a row is
    late by what has been seen, none comes from the future, and the first batch is taken whole.  Unlike with a
    watermark in the plan, late rows are kept as refused ones.  ``table`` is a folder partitioned by month, of which the
    batch's months are rewritten, or an opened bucketed table, whose superseded rows go to ``staging/superseded``.
    """

    def guarded(batch: DataFrame, number: int) -> DataFrame:
        if as_of is not None:
            return guard_times(batch, as_of, days)
        clock = _event_clock(batch, number, staging)
        if clock is None:
            return batch.withColumn("reason", F.lit(None).cast("string"))
        limit = dates.subtract_trading_days(F.lit(clock.date()), days)
        return batch.withColumn("reason", F.when(F.col("event_ts").cast("date") < limit, "event_ts_stale"))

    def store(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        judged = guarded(batch, number)
        judged.where("reason is not null").write.mode("overwrite").parquet(f"{staging}/refused/batch={number}")
        kept = judged.where("reason is null").drop("reason", "event_ts")
        stage = f"{staging}/merged/batch={number}"
        if isinstance(table, bucketed.Bucketed):
            gone = bucketed.merge_into(spark, table, kept, as_of, stage)
            gone.write.mode("overwrite").parquet(f"{staging}/superseded/batch={number}")
            return
        good = kept.withColumn("month", F.date_format("trade_date", "yyyy-MM"))
        # the stale window bounds the months of a batch; as plain values they prune the table's folders
        months = [r.month for r in good.select("month").distinct().collect()]
        touched = rawzone.stored(spark, table, good.schema).where(F.col("month").isin(months))
        merged, _ = merge.merge_ohlcv(touched, good, as_of)
        merged.write.mode("overwrite").parquet(stage)
        spark.read.parquet(stage).hint("rebalance", "month").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("month").parquet(table)

    return rows.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


#: Days that share an entry of the state: each entry read or written is a message between Python and the JVM.
CHUNK = 128
VERDICT = "instrument_id long, trade_date date, close double, adj double, breaker_ok boolean, late boolean, revision long"


class _Days(StatefulProcessor):
    """The days of an instrument that may still change, with their versions, and the reference before them."""

    def __init__(self, keep_days: int):
        self._keep_days = keep_days

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._chunks = handle.getMapState("chunks", "chunk int", "days string")
        self._before = handle.getValueState("before", "reference double, newest int, revision long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        reference, newest, revision = self._before.get() if self._before.exists() else (None, None, 0)
        days = {day: versions for _, (chunk,) in self._chunks.iterator() for day, versions in json.loads(chunk)}
        edge = None if newest is None else newest - self._keep_days
        touched, out, late = set(), [], []
        for pdf in rows:
            numbers = [d.toordinal() for d in pdf["trade_date"]]
            for day, close, adj, arrived in zip(numbers, pdf["close"].tolist(), pdf["adj"].tolist(), pdf["arrived"].tolist()):
                if edge is not None and day < edge:
                    late.append((day, close, adj))
                    continue
                own = days.setdefault(day, [])
                same = next((v for v in own if v[:2] == [close, adj]), None)
                if same is None:
                    own.append([close, adj, arrived, None])
                else:
                    same[2] = max(same[2], arrived)
                touched.add(day)
                newest = day if newest is None else max(newest, day)
        edge = None if newest is None else newest - self._keep_days
        walked = reference
        for day in sorted(days):
            best = None
            for version in days[day]:
                close, adj, arrived, was = version
                ok = breaker.passes(adj, walked)
                if ok != was:
                    version[3] = ok
                    touched.add(day)
                    out.append((day, close, adj, ok))
                if ok:
                    best = max(best or (arrived, close, adj), (arrived, close, adj))
            walked = walked if best is None else best[1]
            if day < edge:  # from here on rows of this day are refused
                reference = walked
                touched.add(day)
        kept: dict[int, list] = {day // CHUNK: [] for day in touched}
        for day in sorted(days):
            if day >= edge and day // CHUNK in kept:
                kept[day // CHUNK].append((day, days[day]))
        for chunk, own in kept.items():
            if own:
                self._chunks.updateValue((chunk,), (json.dumps(own),))
            elif self._chunks.containsKey((chunk,)):
                self._chunks.removeKey((chunk,))
        self._before.update((reference, newest, revision + 1))
        found = [(*r, False) for r in out] + [(*r, None, True) for r in late]
        yield pd.DataFrame({
            "instrument_id": [key[0]] * len(found), "trade_date": [dt.date.fromordinal(r[0]) for r in found], "close": [r[1] for r in found], "adj": [r[2] for r in found],
            "breaker_ok": pd.array([r[3] for r in found], dtype="boolean"), "late": [r[4] for r in found], "revision": [revision] * len(found)})

    def close(self) -> None:
        pass


def stream_breaker(rows: DataFrame, out: str, checkpoint: str, keep_days: int = 3650) -> StreamingQuery:
    """Compare each row with the last accepted close of its instrument, whatever order rows come in.

    ``rows``: instrument_id, trade_date, close, adj (doubles), arrived (a number: of a day's accepted versions the
    one that arrived last, then the highest, is the reference for later days).  An instrument's days of the last
    ``keep_days`` before its newest stay in state.  A row that comes late among them is judged, and verdicts of
    later days that it changes are written again with a higher ``revision`` (see ``breaker_verdicts``).  An older
    row is refused: ``breaker_ok`` null, ``late`` true.  The session's state store provider must be ROCKSDB.
    """
    if rows.sparkSession.conf.get("spark.sql.streaming.stateStore.providerClass", "") != ROCKSDB:
        raise ValueError(f"set spark.sql.streaming.stateStore.providerClass to {ROCKSDB}")
    judged = rows.groupBy("instrument_id").transformWithStateInPandas(statefulProcessor=_Days(keep_days), outputStructType=VERDICT, outputMode="Append", timeMode="None")
    return judged.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def breaker_verdicts(spark: SparkSession, out: str) -> DataFrame:
    """The last verdict of each version (instrument, day, close, adjusted close); refused ones only where none was given."""
    keys = ["instrument_id", "trade_date", "close", "adj"]
    place = F.when(F.col("late"), F.lit(-1).cast("long")).otherwise(F.col("revision"))
    return spark.read.schema(VERDICT).parquet(out).groupBy(*keys).agg(F.max_by("breaker_ok", place).alias("breaker_ok"), F.min("late").alias("late"))
