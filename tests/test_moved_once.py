"""Rows meet stretches of days where they are: they are not read again for distinct questions that are joined back."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tickerlake.operators import identity

D = dt.date


@pytest.fixture(scope="module")
def refs(spark):
    return {
        "companies": spark.createDataFrame([(1, "c1", "INAAAAAAAAA1"), (2, "c2", "INAAAAAAAAA1")], "company_id long, company_uuid string, isin_primary string"),
        "instruments": spark.createDataFrame(
            [(1, 1, 1, "AB", None, D(2000, 1, 10)), (2, 2, 1, "AB", D(2000, 1, 5), None)],
            "instrument_id long, company_id long, exchange_id long, symbol string, listing_date date, delisting_date date"),
        "exchanges": spark.createDataFrame([(1, "NSE")], "exchange_id long, exchange_code string"),
        "aliases": spark.createDataFrame(
            [(1, 1, "NSE", "OLDNAME", D(2000, 1, 1), D(2000, 1, 8)), (2, 2, "NSE", "OLDNAMX", D(2000, 1, 7), None)],
            "alias_id long, instrument_id long, source_system string, alias_symbol string, valid_from date, valid_to date"),
    }


def asked(spark, texts):
    days = F.expr("date_add(date'2000-01-03', cast(id div {n} as int))".replace("{n}", str(len(texts))))
    text = F.element_at(F.array(*[F.lit(t) for t in texts]), (F.col("id") % len(texts) + 1).cast("int"))
    return spark.range(9 * len(texts)).select(text.alias("identifier"), F.lit(None).cast("string").alias("exchange_mic"), days.alias("as_of"))


def reads(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Range (")


def test_symbols(spark, refs):
    rows = asked(spark, ["ab", "oldname"]).select(F.col("identifier").alias("symbol"), F.lit("NS").alias("exchange"), "as_of")
    found = identity.resolve_symbol_as_of(rows, refs["instruments"], refs["exchanges"], refs["aliases"])
    assert reads(found) == 1
    assert reads(identity.resolve_alias_as_of(rows, refs["instruments"], refs["exchanges"], refs["aliases"])) == 1
    got = {(r.symbol, r.as_of.day): (r.instrument_id, r.state) for r in found.collect()}
    assert len(got) == 18
    assert [got["ab", d] for d in (4, 5, 10, 11)] == [(1, "RESOLVED"), (None, "AMBIGUOUS"), (None, "AMBIGUOUS"), (2, "RESOLVED")]
    assert [got["oldname", d] for d in (3, 8, 9)] == [(1, "RESOLVED_ALIAS"), (1, "RESOLVED_ALIAS"), (None, "UNRESOLVED")]


def test_cascade(spark, refs):
    rows = asked(spark, ["inaaaaaaaaa1", "ab", "oldnam", "xoldnamx"])
    found = identity.resolve_cascade(rows, **refs)
    assert reads(found) == 2  # distinct texts for the search by distance, and the rows
    assert reads(identity.resolve_fuzzy_alias(rows, refs["aliases"], refs["instruments"], refs["companies"])) == 2
    got = {(r.identifier, r.as_of.day): (r.instrument_id, r.rule_used, r.confidence_score, r.state, r.company_uuid) for r in found.collect()}
    assert len(got) == 36
    assert [got["inaaaaaaaaa1", d][0] for d in (4, 5, 10, 11)] == [1, 1, 1, 2]  # the lowest listed one
    assert got["ab", 4] == (1, "TICKER_EXACT", 90, "MATCHED", "c1") and got["ab", 6][3] == "UNRESOLVED"
    assert [got["oldnam", d] for d in (6, 7, 9)] == [(1, "ALIAS_FUZZY", 80, "MATCHED", "c1"), (None, None, None, "AMBIGUOUS", None), (2, "ALIAS_FUZZY", 80, "MATCHED", "c2")]
    assert [got["xoldnamx", d][:3] for d in (6, 7)] == [(1, "ALIAS_FUZZY", 70), (2, "ALIAS_FUZZY", 80)]


def test_normalized_fields_and_rows(spark, refs):
    """Fields are parsed and checked once a row, and verdicts alone are written behind the checked rows."""
    from tickerlake import session
    from tickerlake.operators import prices

    raw = spark.range(12).selectExpr(
        "'AB' as symbol", "'NSE' as exchange", "' nse ' as source_system", "'INR' as currency_code", "'2' as open", "'3' as high", "'1' as low",
        "case id % 4 when 0 then 'n/a' when 1 then '20' else '2' end as close", "'5' as volume", "'' as turnover",
        "cast(date_add(date'2000-01-01', cast(id div 4 as int)) as string) as timestamp", "timestamp'2000-01-09 00:00:00' + make_interval(0, 0, 0, 0, 0, 0, id) as ingested_ts", "concat('f', id) as source_record_id")
    plan = prices.normalize_ohlcv_checks(prices.typed_feed(raw, ["symbol"]).withColumns({"instrument_id": F.lit(1), "fx_missing": F.lit(False)}), dt.datetime(2001, 1, 1)).where("reason is null")
    assert plan._jdf.queryExecution().executedPlan().toString().count("RLIKE") <= 6 + 1  # six numbers, one date layout
    fx = spark.createDataFrame([], "currency_code string, trade_date date, rate decimal(18,6)")
    acts = spark.createDataFrame([(1, D(2000, 1, 3), "SPLIT", None, 2, 1)], "instrument_id long, ex_date date, action_type string, action_value double, action_ratio_num int, action_ratio_den int")
    curated = spark.createDataFrame([], "instrument_id long, trade_date date, close_px decimal(18,6), ingested_at timestamp")
    labels, stage = [], session.stage
    session.stage = lambda df, label: labels.append(label) or stage(df, label)
    try:
        good, bad = prices.normalize_ohlcv(raw, refs["instruments"], refs["exchanges"], refs["aliases"], fx, acts, curated, dt.datetime(2001, 1, 1))
    finally:
        session.stage = stage
    assert sorted(labels) == ["breaker", "normalize-checked", "normalize-verdicts"]
    assert sorted((r.source_record_id, float(r.adj_close_px)) for r in good.collect()) == [("f10", 2.0), ("f11", 2.0), *((f"f{k}", 1.0) for k in (2, 3, 6, 7))]
    reasons = {r.source_record_id: r.reason for r in bad.collect()}
    assert reasons == {**{f"f{k}": "bad_number" for k in (0, 4, 8)}, **{f"f{k}": "high_bound_violation" for k in (1, 5, 9)}}
    rows = good.select("instrument_id", "trade_date", F.lit(50).cast("decimal(18,6)").alias("close_px"), F.col("close_px").alias("adj_close_px"), "ingested_ts", "source_record_id")
    assert prices.sequential_breaker(rows).where("not breaker_ok").count() == 4  # all but the first day


def test_walk_by_columns():
    import random

    from tickerlake.operators import breaker

    rng = random.Random(3)
    rows = [(k // 3, rng.choice([1.0, 9.0, 40.0]), rng.choice([1.0, 9.0, 40.0]), rng.randrange(3), rng.randrange(3), rng.random() < 0.1) for k in range(600)]
    one, many = breaker.Walk(), breaker.Walk()
    found = [x for k in range(0, 600, 100) for x in many.rows(*zip(*rows[k : k + 100]))]
    assert found == [one.row(*r) for r in rows] and many.behind() == one.behind()
