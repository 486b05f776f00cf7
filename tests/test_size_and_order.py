"""Cases of files, factors, pages and streams that the given tables do not hold."""

import datetime as dt
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tickerlake import session
from tickerlake.operators import identity, prices, serving
from tickerlake.sources import bhavcopy
from tickerlake.streaming import ingest

D = dt.date


def test_files_with_other_column_orders_and_missing_headers(spark):
    path = session.work_dir(spark, "orders")
    row = {h: v for h, v in zip(bhavcopy.NSE_HEADERS, ["ITC", "EQ", "100", "102", "99", "101", "1000", "450", "2026-06-26"])}
    for k, names in enumerate((bhavcopy.NSE_HEADERS, bhavcopy.NSE_HEADERS[::-1])):
        line = spark.createDataFrame([tuple(row[n] for n in names)], ", ".join(f"{n} string" for n in names))
        line.write.mode("append").option("header", True).csv(f"{path}/good")
        line.drop("OPEN" if k else "none").write.mode("append").option("header", True).csv(f"{path}/bad")
    got = bhavcopy.scan_nse_bhavcopy(spark, f"{path}/good", D(2026, 6, 26)).select("open", "high", "low", "close").collect()
    assert [tuple(map(float, r)) for r in got] == [(100.0, 102.0, 99.0, 101.0)] * 2
    with pytest.raises(Exception, match="OPEN"):
        bhavcopy.scan_nse_bhavcopy(spark, f"{path}/bad", D(2026, 6, 26))


BARS = "instrument_id long, trade_date date, open_px decimal(18,6), high_px decimal(18,6), low_px decimal(18,6), close_px decimal(18,6)"
ACTIONS = "instrument_id long, action_type string, ex_date date, action_value decimal(20,8), action_ratio_num decimal(20,8), action_ratio_den decimal(20,8)"


def test_large_reverse_split_factors(spark):
    px = Decimal("2.5")
    bars = spark.createDataFrame([(i, D(2024, 1, 1), px, px, px, px) for i in (1, 2, 3)], BARS)
    acts = [(1, "SPLIT", D(2024, m, 1), None, Decimal(1), Decimal(100)) for m in (2, 3, 4, 5)] + [(2, "SPLIT", D(2024, 1, d), None, Decimal(1), Decimal(100)) for d in range(2, 20)]
    adj = prices.adjusted_close(bars, spark.createDataFrame(acts, ACTIONS))
    got = {r.instrument_id: r.adj_close_px for r in adj.collect()}
    assert got == {1: Decimal("250000000.000000"), 2: None, 3: Decimal("2.500000")}
    asks = spark.createDataFrame([(2, D(2024, 1, 1)), (1, D(2024, 1, 1))], "instrument_id long, as_of_date date")
    known = spark.createDataFrame([(1, None), (2, None)], "instrument_id long, delisting_date date")
    errors = {r.instrument_id: r.error for r in prices.adjusted_close_requests(asks, bars, spark.createDataFrame(acts, ACTIONS), known).collect()}
    assert errors == {1: None, 2: "ADJUSTED_CLOSE_OUT_OF_RANGE"}


def test_walk_only_where_a_row_may_fail(spark):
    day = [D(2024, 1, 1) + dt.timedelta(days=i) for i in range(4)]
    closes = {1: [[100], [110, 112], [120], [90]], 2: [[100], [700, 300], [320], [310]], 3: [[0], [5], [5000], [10]]}
    rows = [(i, day[d], Decimal(c), Decimal(c), dt.datetime(2024, 2, 1, k), f"r{k}") for i, days in closes.items() for d, own in enumerate(days) for k, c in enumerate(own)]
    df = spark.createDataFrame(rows, "instrument_id long, trade_date date, close_px decimal(18,6), adj_close_px decimal(18,6), ingested_ts timestamp, source_record_id string")
    got = {(r.instrument_id, r.trade_date, int(r.close_px)): r.breaker_ok for r in prices.sequential_breaker(df).collect()}
    assert [k for k, ok in got.items() if not ok] == [(2, day[1], 700), (3, day[2], 5000)] or sorted(k for k, ok in got.items() if not ok) == [(2, day[1], 700), (3, day[2], 5000)]
    cand = df.select("instrument_id", "trade_date", F.col("close_px").cast("double").alias("close"), F.col("adj_close_px").cast("double").alias("adj"), F.lit(False).alias("is_stored"))
    assert sorted(r.instrument_id for r in prices._unsettled(cand).collect()) == [2, 3]


def test_returning_payload_is_not_created_again(spark):
    out, src, cp = (session.work_dir(spark, x) for x in ("zone", "src", "cp"))
    schema = "source_system string, trade_date date, arrival long, checksum string, row_count long"
    for k, checksum in enumerate("ABA"):
        spark.createDataFrame([("NSE", D(2024, 1, 1), k, checksum, 1)], schema).coalesce(1).write.parquet(f"{src}/part={k}")
        ingest.stream_dedupe_payloads(spark.readStream.schema(schema).parquet(f"{src}/*"), out, cp).awaitTermination()
    rows = spark.read.parquet(f"{out}/versions").orderBy("arrival").collect()
    assert [(r.checksum, r.created) for r in rows] == [("A", True), ("B", True), ("A", False)]


def test_far_pages(spark, monkeypatch):
    df = spark.range(0, 997, 1, 7).select((F.col("id") * 37 % 997).alias("v"))
    monkeypatch.setattr(serving, "MOST_TAKEN", 100)
    for page in (1, 3, 5, 10, 12):
        rows, total = serving.paginate(df, page, 100, [F.desc("v")])
        want = [x for x in range(996, -1, -1)][(page - 1) * 100 : page * 100]
        assert [r.v for r in rows.collect()] == want
        assert total.head().total == 997


def test_long_identifiers_get_no_keys(spark):
    ids = spark.createDataFrame([("x" * 10_000,), ("RELIANC",), ("AB",)], "_id string")
    names = spark.createDataFrame([("RELIANCE",), ("TCS",)], "_name string")
    assert sorted((r._id, r._name, r.distance) for r in identity._near_pairs(ids, names).collect()) == [("RELIANC", "RELIANCE", 1)]


def test_near_pairs_like_all_pairs(spark):
    rng = random.Random(4)
    words = ["".join(rng.choice("abé") for _ in range(rng.randrange(13))) for _ in range(160)]
    ids, names = words[:80] + ["x" * 199 + "y", "", "a"], words[80:] + ["x" * 200, "x" * 198, "", "b"]

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a):
            row, last = [i + 1], row
            for j, y in enumerate(b):
                row.append(min(row[-1] + 1, last[j + 1] + 1, last[j] + (x != y)))
        return row[-1]

    found = identity._near_pairs(spark.createDataFrame([(x,) for x in ids], "_id string"), spark.createDataFrame([(x,) for x in names], "_name string"))
    want = {(a, b, distance(a, b)) for a in set(ids) for b in set(names) if abs(len(a) - len(b)) <= 2}
    assert sorted(tuple(r) for r in found.collect()) == sorted(w for w in want if w[2] <= 2)
    keys = spark.createDataFrame([("q" * 200,)], "t string").select(F.size(identity.segment_keys(F.col("t"), False)).alias("n")).head().n
    assert keys <= 75


def test_shared_folder_is_required_on_a_cluster():
    class Context:
        master = "spark://host:7077"

    class Conf:
        def get(self, key, default=None):
            return default

    class Session:
        sparkContext, conf = Context(), Conf()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.work_dir(Session(), "x")
    Context.master = "local-cluster[2,1,1024]"
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.work_dir(Session(), "x")
    Context.master = "local[4]"
    assert "tickerlake/x-" in session.work_dir(Session(), "x")


def test_order_statistics_of_values_in_one_bin(spark):
    from tickerlake.operators import orderstats

    values = [1000.0 + i * 1e-7 for i in range(1001)] * 2 + [1000.0] * 50
    df = spark.createDataFrame([(1, v) for v in values] + [(2, 5.0)] * 3 + [(3, None)], "g int, v double")
    got = {r.g: r.median for r in orderstats.median_exact(df, ["g"], "v").collect()}
    assert got == {1: sorted(values)[len(values) // 2 - 1] / 2 + sorted(values)[len(values) // 2] / 2, 2: 5.0}


def test_corrections_make_their_bars_once(spark, tmp_path, monkeypatch):
    """The second delivery corrects the first as it was written; bars were made three times."""
    from tickerlake.plans import bindings, on_files

    made = tmp_path / "made"

    def mark(batches):
        with open(made, "a") as f:
            f.write("x")
        yield from batches

    bars = spark.range(0, 40, 1, 1).selectExpr(
        "id % 5 as instrument_id", "date_add(date'1995-12-20', cast(id as int)) as trade_date", "cast(10 + id as decimal(18,6)) as close_px", "timestamp'2001-07-01 12:00:00' as ingested_at")
    monkeypatch.setattr(bindings, "bars", lambda *_: bars.mapInArrow(mark, bars.schema))
    rows = on_files.stream_late(spark, "").collect()
    assert made.read_text() == "x"
    assert {(r.instrument_id, str(r.trade_date), int(r.close_px), r.what) for r in rows} == {
        (k % 5, str(d), int(10 + k + more), what)
        for k in range(40) for d in [D(1995, 12, 20) + dt.timedelta(k)]
        for more, what in ([((k % 5 + 1) % 2, "stored")] if d >= D(1996, 1, 1) else [(0, "0 event_ts_stale"), (1 if k % 5 % 2 == 0 else 7, "1 event_ts_stale")])}


def test_bars_are_dealt_to_tasks_by_their_number(spark, tmp_path, monkeypatch):
    """A task of the adjustment sorted more rows the more there were."""
    from tickerlake.plans import bindings

    spark.range(100).write.parquet(str(tmp_path / "lineitem.parquet"))
    assert bindings.parts(spark, str(tmp_path)) == 8
    monkeypatch.setattr(bindings, "PART_ROWS", 9)
    assert bindings.parts(spark, str(tmp_path)) == 12
    px = spark.createDataFrame([(i, D(2000, 1, d), Decimal(d)) for i in range(30) for d in (1, 2, 3)], "instrument_id long, trade_date date, close_px decimal(18,6)")
    acts = spark.createDataFrame([(i, D(2000, 1, 3), "SPLIT", None, 2, 1) for i in range(0, 30, 2)], "instrument_id long, ex_date date, action_type string, action_value double, action_ratio_num int, action_ratio_den int")
    dealt, plain = prices.adjusted_close(px, acts, parts=12), prices.adjusted_close(px, acts)
    plan = dealt._jdf.queryExecution().executedPlan().toString()
    assert ", 12), REPARTITION_BY_NUM" in plan
    assert dealt.rdd.getNumPartitions() == 12
    assert sorted(dealt.collect()) == sorted(plain.collect())
