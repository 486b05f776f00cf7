import datetime as dt
import os

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tickerlake.operators import merge
from tickerlake.sources import bucketed
from tickerlake.streaming import ingest

NOW = dt.datetime(2026, 6, 26, 12)
ROW = "instrument_id long, trade_date date, close_px double, ingested_at timestamp, source_record_id string"


def rows(spark, *given):
    """(instrument, day of 2026, close, hour of arrival)"""
    day = dt.date(2026, 1, 1)
    return spark.createDataFrame([(i, day + dt.timedelta(d), c, None if h is None else dt.datetime(2026, 6, 1, h), f"r{c}") for i, d, c, h in given], ROW)


@pytest.fixture
def table(spark, tmp_path):
    t = bucketed.Bucketed(f"t_{abs(hash(str(tmp_path)))}", str(tmp_path / "t"), slots=3, buckets=2)
    bucketed.open_table(spark, t, rows(spark).schema)
    yield t
    spark.sql(f"DROP TABLE IF EXISTS {t.name}")


def files(table):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(table.path) for f in names if f.startswith("part-")}


def content(spark, table):
    return sorted(tuple(r) for r in spark.table(table.name).drop("period", "slot").collect())


def test_same_as_whole_merge(spark, table, tmp_path):
    first = rows(spark, *[(i, d, 1.0, 5) for i in range(6) for d in range(0, 90, 7)])
    second = rows(spark, (1, 0, 2.0, 6), (1, 0, 3.0, 7), (1, 7, 2.0, 5), (2, 0, 2.0, 4), (9, 3, 2.0, 1), (9, 3, 2.0, 1), (3, 14, 2.0, None))
    assert bucketed.merge_into(spark, table, first, NOW, str(tmp_path / "a")).count() == 0
    gone = bucketed.merge_into(spark, table, second, NOW, str(tmp_path / "b"))
    merged, superseded = merge.merge_ohlcv(first, second, NOW)
    assert content(spark, table) == sorted(tuple(r) for r in merged.collect())
    assert [tuple(r) for r in gone.collect()] == [tuple(r) for r in superseded.collect()]


def test_only_touched_folders_are_written_and_no_stored_row_is_shuffled(spark, table, tmp_path):
    bucketed.merge_into(spark, table, rows(spark, *[(i, d, 1.0, 5) for i in range(6) for d in range(0, 90, 7)]), NOW, str(tmp_path / "a"))
    before = files(table)
    bucketed.merge_into(spark, table, rows(spark, (1, 0, 2.0, 6), (2, 42, 2.0, 4)), NOW, str(tmp_path / "b"))
    after = files(table)
    written = {os.path.dirname(f) for f in set(before) ^ set(after)}
    assert len(written) == 1 and "period=2026-01" in written.pop()  # the other row came too late to change its folder
    assert all(before[f] == after[f] for f in set(before) & set(after))
    plan = bucketed._merged(spark.table(table.name), rows(spark, (1, 0, 2.0, 6)), ["close_px", "ingested_at", "source_record_id"])
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    text = plan._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert text.count("Exchange") == 1 and "Bucketed: true" in text


def test_a_cut_off_merge_goes_on(spark, table, tmp_path):
    first = rows(spark, *[(i, d, 1.0, 5) for i in range(4) for d in (0, 40)])
    bucketed.merge_into(spark, table, first, NOW, str(tmp_path / "a"))
    expected = bucketed.merge_into(spark, table, rows(spark, (1, 0, 2.0, 6)), NOW, str(tmp_path / "b")).collect()
    whole = content(spark, table)
    # the folder that was being replaced is lost, as when the driver ends between removal and renaming
    slot = spark.range(1).select(F.pmod(F.xxhash64(F.lit(1).cast("long")), F.lit(table.slots))).head()[0]
    for f in files(table):
        if f"period=2026-01/slot={slot}/" in f:
            os.remove(f)
    spark.catalog.refreshTable(table.name)
    assert len(content(spark, table)) < len(whole)
    again = bucketed.merge_into(spark, table, rows(spark, (1, 0, 2.0, 6)), NOW, str(tmp_path / "b")).collect()
    spark.catalog.refreshTable(table.name)
    assert again == expected and content(spark, table) == whole


def test_empty_batch_missing_key_and_other_layout(spark, table, tmp_path):
    bucketed.merge_into(spark, table, rows(spark, (1, 0, 1.0, 5)), NOW, str(tmp_path / "a"))
    before = files(table)
    assert bucketed.merge_into(spark, table, rows(spark), NOW, str(tmp_path / "b")).count() == 0 and files(table) == before
    with pytest.raises(PySparkException, match="no instrument"):
        bucketed.merge_into(spark, table, rows(spark, (None, 0, 1.0, 5)), NOW, str(tmp_path / "c"))
    with pytest.raises(ValueError, match="2 buckets"):
        bucketed.open_table(spark, bucketed.Bucketed("other", table.path, 3, 4), rows(spark).schema)
    # another session's catalog finds what is stored
    spark.sql(f"DROP TABLE {table.name}")
    assert bucketed.open_table(spark, table, rows(spark).schema).count() == 1


def test_stream_by_event_time(spark, table, tmp_path):
    """Ten deliveries: corrections within five weekdays of what was seen before are merged, older ones written as refused."""
    src, staging = tmp_path / "in", str(tmp_path / "staging")
    accepted, late = [], []
    for n in range(10):
        given = [(1, n, 1.0, 1), (1, n - 1, 2.0, 2 + n)] if n else [(1, n, 1.0, 1)]
        if n == 9:
            late = [(1, 0, 5.0, 20)]  # the newest day seen is the ninth, a Friday; the first is six weekdays before it
        accepted += given
        rows(spark, *given, *(late if n == 9 else [])).withColumn("event_ts", F.col("trade_date").cast("timestamp")).coalesce(1).write.mode("append").parquet(str(src))
        stream = spark.readStream.schema(f"{ROW}, event_ts timestamp").parquet(str(src))
        ingest.stream_late_corrections(stream, table, staging, str(tmp_path / "cp"), None).awaitTermination()
    expected, _ = merge.merge_ohlcv(rows(spark), rows(spark, *accepted), NOW)
    assert content(spark, table) == sorted(tuple(r) for r in expected.collect())
    refused = spark.read.parquet(f"{staging}/refused").collect()
    assert [(r.instrument_id, r.close_px, r.reason, r.batch) for r in refused] == [(1, 5.0, "event_ts_stale", 9)]
    assert spark.read.parquet(f"{staging}/superseded").count() == 9
    assert spark.read.parquet(f"{staging}/clock/upto=9").head().newest == dt.datetime(2026, 1, 10)
    assert all(spark.read.parquet(f"{staging}/clock/upto={n}").count() == 1 for n in range(10))


def test_buckets_follow_the_rows_and_get_few_files(spark, tmp_path):
    """A task of a merge has a bounded number of rows, and a folder one file a bucket."""
    assert [bucketed.buckets_for(n) for n in (0, 4_000_000, 4_000_001, 200_000_000)] == [4, 4, 5, 200]
    t = bucketed.Bucketed("t_many_buckets", str(tmp_path / "t"), slots=1, buckets=8, period="yyyy")
    first = rows(spark, *[(i, d, 1.0, 5) for i in range(20) for d in range(0, 90, 3)]).repartition(6)
    bucketed.open_table(spark, t, first.schema)
    try:
        for name in "ab":
            bucketed.merge_into(spark, t, first.withColumn("ingested_at", F.expr(f"ingested_at + interval {ord(name)} hours")), NOW, str(tmp_path / name))
            assert len([f for f in files(t) if "period=" in f]) == 8
        assert len(content(spark, t)) == first.count()
    finally:
        spark.sql(f"DROP TABLE {t.name}")
