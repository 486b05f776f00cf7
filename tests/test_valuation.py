import datetime as dt
import random
import statistics

import pytest
from pyspark.sql import functions as F

from tickerlake.operators import fundamentals as fu
from tickerlake.operators import orderstats
from tickerlake.operators import valuation as va

D = dt.date


def dcf_frame(spark, **over):
    base = dict(instrument_id=1, wacc=0.11, terminal_growth=0.04, forecast_years=1, revenue_cagr=0.0, ebit_margin=0.2, revenue_base=1000.0, tax_rate=0.25,
                share_count=100.0, net_debt=200.0, da_plan=[20.0], capex_plan=[30.0], nwc_plan=[10.0]) | over
    return spark.createDataFrame([tuple(base.values())], "instrument_id long, wacc double, terminal_growth double, forecast_years int, revenue_cagr double, ebit_margin double, revenue_base double, "
                                 "tax_rate double, share_count double, net_debt double, da_plan array<double>, capex_plan array<double>, nwc_plan array<double>")


def test_one_year_cash_flow(spark):
    r = va.dcf_projection(dcf_frame(spark)).head()
    assert r.free_cash_flow == pytest.approx(130.0, rel=1e-12)


def test_terminal_value(spark):
    v = spark.range(1).select(va.terminal_value(F.lit(100.0), F.lit(0.10), F.lit(0.03)).alias("v")).head().v
    assert v == pytest.approx(1471.428571428571, rel=1e-12)


@pytest.mark.parametrize("over,text", [
    (dict(wacc=0.04), "WACC"), (dict(da_plan=[1.0, 2.0]), "D&A"), (dict(capex_plan=[]), "Capex"), (dict(nwc_plan=[1.0, 2.0]), "Delta NWC"), (dict(share_count=0.0), "share_count")])
def test_input_errors(spark, over, text):
    r = va.dcf_value(dcf_frame(spark, **over)).head()
    assert r.error.startswith(text) and r.dcf_price is None


def test_default_valuation_matches_a_plain_loop(spark):
    sched = dict(da_plan=[40.0, 42.0, 44.0, 46.0, 48.0], capex_plan=[55.0, 58.0, 60.0, 62.0, 65.0], nwc_plan=[10.0, 11.0, 12.0, 13.0, 14.0])
    r = va.dcf_value(dcf_frame(spark, forecast_years=5, revenue_cagr=0.08, ebit_margin=0.24, **sched)).head()
    pv, fcf = 0.0, 0.0
    for t in range(1, 6):
        fcf = 1000 * 1.08**t * 0.24 * 0.75 + sched["da_plan"][t - 1] - sched["capex_plan"][t - 1] - sched["nwc_plan"][t - 1]
        pv += fcf / 1.11**t
    ev = pv + fcf * 1.04 / 0.07 / 1.11**5
    assert r.dcf_price == pytest.approx((ev - 200) / 100, rel=1e-9) and 10 <= r.dcf_price <= 200


def quartiles(values):
    v = sorted(values)
    h = len(v) // 2
    return statistics.median(v[:h] or v), statistics.median(v), statistics.median(v[len(v) - h:] or v)


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 8, 301])
def test_exclusive_quartiles(spark, n):
    rnd = random.Random(n)
    vals = [round(rnd.uniform(-50, 50), rnd.choice([0, 0, 3])) for _ in range(n)]
    df = spark.createDataFrame([("g", float(v)) for v in vals], "k string, v double")
    r = orderstats.exclusive_quartiles(df, ["k"], "v").head()
    assert (r.n, r.q1, r.med, r.q3) == (n, *map(pytest.approx, quartiles(vals)))
    assert orderstats.median_exact(df, ["k"], "v").head().median == pytest.approx(statistics.median(vals))


def universe(spark, n=90, seed=1):
    """Instruments of which a third share one industry; ties and bad denominators included."""
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        ind = "HOT" if i % 3 == 0 else (f"I{i % 7}" if i % 3 == 1 else None)
        rows.append((i, "SEC" if i % 10 else None, ind, i % 11 != 4, *[float(rnd.choice([-5, 10, 20, 20, 35, 50])) for _ in range(6)], float(rnd.choice([0, 5])), float(rnd.choice([1, 10]))))
    names = "instrument_id long, sector_code string, industry_code string, is_active boolean, enterprise_value double, equity_value double, ebitda double, earnings double, book_value double, sales double, net_debt double, share_count double"
    df = spark.createDataFrame(rows, names)
    kind = F.when(F.col("industry_code").isNotNull(), "INDUSTRY").when(F.col("sector_code").isNotNull(), "SECTOR")
    groups = df.select("instrument_id", "sector_code", "industry_code", kind.alias("group_kind"), F.coalesce("industry_code", "sector_code").alias("group_key"), F.col("is_active").alias("is_peer"))
    return rows, groups, df.drop("sector_code", "industry_code", "is_active").withColumn("missing_metric", F.lit(None).cast("string"))


@pytest.mark.parametrize("seed", [1, 2])
def test_relative_valuation_against_explicit_peers(spark, seed):
    rows, groups, metrics = universe(spark, seed=seed)
    got = {r.instrument_id: r for r in va.relative_valuation(groups, metrics).collect()}
    assert len(got) == len(rows)
    for i, sec, ind, _, ev, eq, eb, ea, bo, sa, nd, sh in rows:
        peers = [p for p in rows if p[0] != i and p[3] and ((p[2] == ind) if ind else (sec is not None and p[1] == sec))]
        pick = {"EV/EBITDA": (4, 6, eb), "P/E": (5, 7, ea), "P/B": (5, 8, bo), "EV/Sales": (4, 9, sa)}
        equities, short = [], None
        for m, (num, den, own) in pick.items():
            vals = [p[num] / p[den] for p in peers if p[den] > 0]
            if len(vals) < 3:
                short = short or f"Insufficient valid peers for {m}: {len(vals)}"
                continue
            equities.append(quartiles(vals)[1] * own - (nd if m.startswith("EV") else 0))
        if short:
            assert (got[i].rel_status, got[i].rel_reason) == ("UNAVAILABLE", short), i
        else:
            assert got[i].rel_equity == pytest.approx(statistics.median(equities), rel=1e-9), i
            assert got[i].rel_price == pytest.approx(statistics.median(e / sh for e in equities), rel=1e-9), i


def test_implied_value(spark):
    df = spark.createDataFrame([(100.0, 50.0, 10.0)], "ebitda double, net_debt double, share_count double")
    eq, px = va.implied_values("EV/EBITDA", F.lit(8.0))
    assert df.select(eq, px).head()[:] == (750.0, 75.0)


def test_missing_peer_metric_fails_the_row(spark):
    rows, groups, metrics = universe(spark)
    broken = metrics.withColumn("missing_metric", F.when(F.col("instrument_id") == 3, "SALES"))
    got = {r.instrument_id: r.rel_status for r in va.relative_valuation(groups, broken).collect()}
    assert got[3] == "REFUSED" and got[0] == "FAILED" and got[1] != "FAILED"


def test_agreement_and_confidence(spark):
    pair = spark.createDataFrame([(100.0, 100.0), (100.0, None), (0.0, 0.0), (10.0, 30.0), (-10.0, 10.0)], "a double, b double")
    assert [r[0] for r in pair.select(va.model_agreement(F.col("a"), F.col("b"))).collect()] == [100.0, 0.0, 100.0, 0.0, 0.0]
    c = va.confidence_score(spark.createDataFrame([(20.0, 0, 75.0, 0.0), (85.0, 7, 75.0, 90.0)], "data_quality_score double, peer_count int, assumption_stability double, model_agreement double")).collect()
    assert [(r.composite_score, r.override_required) for r in c] == [(23.75, True), (87.5, False)]


def facts(spark, rows):
    return spark.createDataFrame([(n, 1, f"{y}-12-31", code, v) for n, (y, code, v) in enumerate(rows)], "statement_fact_id long, instrument_id long, d string, line_item_code string, value double").selectExpr(
        "statement_fact_id", "instrument_id", "cast(d as timestamp) as as_reported_ts", "line_item_code", "cast(value as decimal(24,4)) as value", "'FY' as fiscal_period")


def test_ratios_flags_and_growth(spark):
    f = facts(spark, [(2022, "TOTAL_REVENUE", 1000.0), (2022, "GROSS_PROFIT", 400.0), (2022, "NET_INCOME", 20.0), (2022, "TOTAL_EQUITY", -100.0), (2023, "GROSS_PROFIT", 5.0), (2024, "TOTAL_REVENUE", 1500.0), (2025, "TOTAL_REVENUE", 0.0), (2025, "GROSS_PROFIT", 9.0)])
    w = fu.metric_wide(f)
    got = {(r.as_of_date.year, r.metric_code): (r.metric_value, r.quality_flag) for r in fu.ratio_metrics(w).collect()}
    assert float(got[2022, "GROSS_MARGIN"][0]) == 0.4 and float(got[2022, "ROE"][0]) == -0.2 and got[2022, "ROE"][1] == "NEGATIVE_DENOMINATOR"
    assert got[2025, "GROSS_MARGIN"] == (None, None)
    growth = {r.as_of_date.year: r.metric_value for r in fu.growth_yoy(w).collect()}
    # 2023 has no revenue, so 2024 grows over 2022
    assert float(growth[2024]) == 0.5 and growth[2022] is None and growth[2023] is None and float(growth[2025]) == -1.0


def test_statement_period_is_strictly_point_in_time(spark):
    f = facts(spark, [(2022, "TOTAL_REVENUE", 1.0), (2023, "TOTAL_REVENUE", 2.0), (2023, "CAPEX", 3.0)])
    got = {d: va.asof_statement_period(f, d, ["TOTAL_REVENUE", "CAPEX"]).head() for d in (D(2023, 12, 30), D(2023, 12, 31), D(2021, 1, 1))}
    assert got[D(2023, 12, 30)].TOTAL_REVENUE == 1.0 and got[D(2023, 12, 30)].CAPEX is None
    assert got[D(2023, 12, 31)].TOTAL_REVENUE == 2.0 and got[D(2021, 1, 1)] is None
