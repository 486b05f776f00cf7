import datetime as dt
from decimal import Decimal as N

import pytest
from pyspark.sql import functions as F

from tickerlake.operators import indicators, prices, timejoin

D = dt.date
BAR = "instrument_id long, trade_date date, close_px decimal(18,6)"
ACT = "instrument_id long, action_type string, ex_date date, action_value decimal(20,8), action_ratio_num decimal(20,8), action_ratio_den decimal(20,8)"


def bars(spark, rows):
    return spark.createDataFrame([(i, d, N(str(c))) for i, d, c in rows], BAR)


def actions(spark, rows):
    return spark.createDataFrame([(i, t, d, *[None if x is None else N(str(x)) for x in v]) for i, t, d, *v in rows], ACT)


def adj(spark, price_rows, action_rows, **kw):
    out = prices.adjusted_close(bars(spark, price_rows), actions(spark, action_rows), **kw)
    return {(r.instrument_id, r.trade_date): r.adj_close_px for r in out.collect()}


def test_split_and_dividend_chain(spark):
    got = adj(spark, [(1, D(2024, 1, 1), 200), (1, D(2024, 2, 29), 120)], [(1, "SPLIT", D(2024, 2, 1), None, 2, 1), (1, "DIVIDEND", D(2024, 3, 1), 5, None, None)])
    assert got[1, D(2024, 1, 1)] == N("95.833333")
    assert got[1, D(2024, 2, 29)] == N("115.000000")


def test_action_on_the_trade_date_does_not_apply(spark):
    got = adj(spark, [(1, D(2024, 1, 1), 10), (1, D(2024, 1, 2), 10)], [(1, "SPLIT", D(2024, 1, 2), None, 2, 1)])
    assert (got[1, D(2024, 1, 1)], got[1, D(2024, 1, 2)]) == (N("5"), N("10"))


def test_window_start_skips_early_actions(spark):
    acts = [(1, "SPLIT", D(2024, 1, 2), None, 2, 1), (1, "BONUS", D(2024, 1, 5), None, 4, 1)]
    assert adj(spark, [(1, D(2024, 1, 1), 8)], acts, window_start=D(2024, 1, 3))[1, D(2024, 1, 1)] == N("2")


def test_neutral_factors(spark):
    acts = actions(spark, [
        (1, "SPLIT", D(2024, 1, 3), None, 0, 1), (1, "RIGHTS", D(2024, 1, 3), None, None, 1), (1, "MERGER", D(2024, 1, 3), 5, 2, 1),
        (1, "DIVIDEND", D(2024, 1, 1), 5, None, None), (1, "DIVIDEND", D(2024, 1, 3), 999, None, None), (1, "DIVIDEND", D(2024, 1, 3), None, None, None)])
    out = prices.action_factor(acts, bars(spark, [(1, D(2024, 1, 1), 100)]))
    assert {r.factor for r in out.collect()} == {1.0}


def test_rounding_is_half_even(spark):
    got = adj(spark, [(1, D(2024, 1, 1), "0.000001"), (2, D(2024, 1, 1), "0.000003")], [(i, "SPLIT", D(2024, 1, 2), None, 2, 1) for i in (1, 2)])
    assert got[1, D(2024, 1, 1)] == N("0") and got[2, D(2024, 1, 1)] == N("0.000002")


def test_requests_report_why_there_is_no_value(spark):
    inst = spark.createDataFrame([(1, D(2024, 1, 5)), (2, None)], "instrument_id long, delisting_date date")
    asks = spark.createDataFrame([(1, D(2024, 1, 1)), (1, D(2024, 1, 6)), (2, D(2024, 1, 1)), (3, D(2024, 1, 1))], "instrument_id long, as_of_date date")
    out = prices.adjusted_close_requests(asks, bars(spark, [(1, D(2024, 1, 1), 3), (1, D(2024, 1, 6), 3)]), actions(spark, []), inst)
    assert sorted((r.instrument_id, r.error or "") for r in out.collect()) == [(1, ""), (1, "DELISTED"), (2, "NO_PRICE_ROW"), (3, "INSTRUMENT_NOT_FOUND")]


def test_price_window_is_cut_by_delisting(spark):
    inst = spark.createDataFrame([(1, None, D(2026, 6, 26))], "instrument_id long, listing_date date, delisting_date date")
    rows = bars(spark, [(1, D(2026, 6, d), 1) for d in (25, 26, 27)])
    got = prices.price_history_window(rows, inst, None, None, D(2026, 6, 27))
    assert sorted(r.trade_date.day for r in got.collect()) == [25, 26]
    with pytest.raises(ValueError):
        prices.price_history_window(rows, inst, D(2026, 6, 27), D(2026, 6, 1), D(2026, 6, 27))


@pytest.mark.parametrize("strict,want", [(True, {1: None, 2: 10, 3: 20}), (False, {1: 10, 2: 20, 3: 20})])
def test_asof_ties(spark, strict, want):
    left = spark.createDataFrame([("a", d) for d in (1, 2, 3)], "k string, t int")
    right = spark.createDataFrame([("a", 1, 10), ("a", 2, 20)], "k string, t int, v int")
    got = timejoin.asof_join(left, right, ["k"], "t", F.col("v"), strict, "v")
    assert {r.t: r.v for r in got.collect()} == want


def test_rejected_close_is_not_the_reference_for_the_next_day(spark):
    # 10 -> 100 is refused; 40 is judged against 10 and passes, though 40/100 also would
    rows = [(1, D(2024, 1, 1), 10), (1, D(2024, 1, 2), 100), (1, D(2024, 1, 3), 51), (1, D(2024, 1, 4), 50)]
    df = bars(spark, rows).withColumn("adj_close_px", F.col("close_px")).withColumn("ingested_ts", F.lit(dt.datetime(2024, 2, 1))).withColumn("source_record_id", F.lit("r"))
    got = {r.trade_date.day: r.breaker_ok for r in prices.sequential_breaker(df).collect()}
    assert got == {1: True, 2: False, 3: False, 4: True}


def test_stored_rows_lead_and_newer_versions_replace_them(spark):
    cur = bars(spark, [(1, D(2024, 1, 1), 100)]).withColumn("ingested_at", F.lit(dt.datetime(2024, 1, 1)))
    cand = bars(spark, [(1, D(2024, 1, 1), 25), (1, D(2024, 1, 2), 6), (1, D(2024, 1, 3), 4)]).withColumn("adj_close_px", F.col("close_px"))
    cand = cand.withColumn("ingested_ts", F.lit(dt.datetime(2024, 1, 9))).withColumn("source_record_id", F.lit("r"))
    got = {r.trade_date.day: r.breaker_ok for r in prices.sequential_breaker(cand, cur).collect()}
    # the newer 25 takes the place of the stored 100, so 6 is within [5, 125]
    assert got == {1: True, 2: True, 3: True}


def test_hot_instrument_and_duplicate_rows_keep_every_row(spark):
    hot = spark.range(3000).selectExpr("case when id % 3 = 0 then 7 else id end as instrument_id", "date'2024-01-05' as trade_date", "cast(10 as decimal(18,6)) as close_px")
    curated = bars(spark, [(7, D(2024, 1, 4), 8), (7, D(2024, 1, 5), 9)])
    got = prices.asof_prior_close(hot.drop("close_px"), curated)
    assert got.count() == 3000
    assert got.where("prior_close = 8").count() == hot.where("instrument_id = 7").count()


def test_indicators_need_full_windows(spark):
    import pandas as pd
    from pyspark.sql.window import Window as W

    close = [10.0, 11, 9, 12, 13, 12, 14, 15, 13, 16, 17, 15, 18, 19, 17, 20, 21, 22, 20, 23, 24, 22]
    df = spark.createDataFrame([(1, i, float(c)) for i, c in enumerate(close)], "k long, date long, close double")
    w = W.partitionBy("k").orderBy("date")
    up, low = indicators.bollinger(F.col("close"), w)
    got = indicators.macd(indicators.rsi(df.withColumn("up", up).withColumn("low", low).withColumn("sma", indicators.sma(F.col("close"), 5, w)), "close", ["k"], "date"), ["k"], "date", "close").orderBy("date").toPandas()
    s = pd.Series(close)
    delta = s.diff()
    gain, loss = delta.clip(lower=0).rolling(14).mean(), (-delta.clip(upper=0)).rolling(14).mean()
    pd.testing.assert_series_equal(got["rsi"], 100 - 100 / (1 + gain / loss), check_names=False)
    pd.testing.assert_series_equal(got["sma"], s.rolling(5).mean(), check_names=False)
    pd.testing.assert_series_equal(got["up"], s.rolling(20).mean() + 2 * s.rolling(20).std(), check_names=False)
    line = s.ewm(span=12, adjust=False).mean() - s.ewm(span=26, adjust=False).mean()
    pd.testing.assert_series_equal(got["macd"], line, check_names=False)
    pd.testing.assert_series_equal(got["signal"], line.ewm(span=9, adjust=False).mean(), check_names=False)


def test_capm_without_market_variance(spark):
    a = spark.createDataFrame([(1, d, float(c)) for d, c in enumerate([10, 11, 12])], "k long, date long, close double")
    m = spark.createDataFrame([(d, 5.0) for d in range(3)], "date long, close double")
    r = indicators.capm(a, m, ["k"], 0.07, 0.12).head()
    mean = (0.1 + 1 / 11) / 2
    assert r.beta is None and r.expected_return == 0.07 and abs(r.alpha - (mean - 0.07 / 252) * 252) < 1e-12
