"""Queries on fundamentals and valuation."""

import datetime as dt

from pyspark.sql import functions as F

from tickerlake.functions import numeric
from tickerlake.operators import fundamentals as fu
from tickerlake.operators import merge, orderstats, serving
from tickerlake.operators import valuation as va
from tickerlake.plans import bindings as b
from tickerlake.plans import sqlparts, sqlparts_value  # noqa: F401
from tickerlake.plans.registry import register

DAY = dt.date(2000, 12, 31)
NOW = dt.datetime(2001, 12, 31)


def _valued(spark, sf):
    return va.value_universe(b.facts(spark, sf), b.metrics(spark, sf), b.value_instruments(spark, sf), b.value_companies(spark, sf), b.requests(spark, sf), DAY)


def _groups(spark, sf):
    return va.peer_group(b.value_instruments(spark, sf), b.value_companies(spark, sf), DAY)


def _dcf_rows(spark, sf):
    return va.projection_with_fallback(va.build_projection_input(b.facts(spark, sf), DAY), b.requests(spark, sf))


# --- fundamentals ----------------------------------------------------------------------


@register("unpivot_statements", "\nUNION ALL ".join(
    f"""SELECT instrument_id, y AS fiscal_year, '{code}' AS line_item_code, CAST({expr} AS BIGINT) AS value FROM (SELECT DISTINCT instrument_id, y2.y FROM income_long, (SELECT DISTINCT y FROM income_long) y2)
    LEFT JOIN (SELECT instrument_id, y, max(CASE WHEN label = 'Total Revenue' THEN v END) AS tr, max(CASE WHEN label = 'Operating Revenue' THEN v END) AS opr, max(CASE WHEN label = 'Gross Profit' THEN v END) AS gp,
      max(CASE WHEN label = 'Net Income' THEN v END) AS ni, max(CASE WHEN label = 'Capital Expenditure' THEN v END) AS cx FROM income_long GROUP BY 1, 2) USING (instrument_id, y)"""
    for code, expr in {"TOTAL_REVENUE": "coalesce(tr, opr)", "GROSS_PROFIT": "gp", "NET_INCOME": "ni", "EBIT": "NULL", "CAPEX": "cx"}.items()))
def unpivot(spark, sf):
    wide = b.wide_income(spark, sf)
    field_map = {k: fu.INCOME_LABELS[k] for k in ("TOTAL_REVENUE", "GROSS_PROFIT", "NET_INCOME", "EBIT")} | {"CAPEX": fu.CASHFLOW_LABELS["CAPEX"]}
    return fu.unpivot_statements(wide, field_map, "PL").select("instrument_id", "fiscal_year", "line_item_code", "value")


@register("union_statements", """
SELECT statement_type, count(*) AS n, CAST(sum(CASE WHEN value IS NOT NULL THEN 1 ELSE 0 END) AS BIGINT) AS filled FROM (
 SELECT statement_type, value FROM parsed_facts WHERE line_item_code <> 'SHARES_OUTSTANDING' UNION ALL
 SELECT 'BS', 1 FROM (SELECT DISTINCT instrument_id FROM parsed_facts) JOIN info USING (instrument_id)
 WHERE CASE WHEN current_price <> 0 THEN current_price WHEN regular_market_price <> 0 THEN regular_market_price ELSE previous_close END > 0) GROUP BY 1""")
def union_statements(spark, sf):
    p = b.parsed_facts(spark, sf).where("line_item_code <> 'SHARES_OUTSTANDING'").drop("statement_fact_id", "ingested_at").withColumn("source_record_id", F.lit(""))
    parts = [p.where(F.col("statement_type") == t) for t in ("PL", "BS", "CF")]
    shares = fu.infer_shares(b.info(spark, sf), parts[1])
    return fu.union_statements([*parts, shares]).groupBy("statement_type").agg(F.count(F.lit(1)).alias("n"), F.count("value").alias("filled"))


@register("infer_shares", """
SELECT instrument_id, max(fiscal_year) AS fiscal_year, CAST(round_even(any_value(market_cap) / any_value(px), 4) AS DOUBLE) AS value FROM parsed_facts JOIN
 (SELECT *, CASE WHEN current_price <> 0 THEN current_price WHEN regular_market_price <> 0 THEN regular_market_price ELSE previous_close END AS px FROM info) USING (instrument_id)
WHERE statement_type = 'BS' AND px > 0 GROUP BY 1""")
def infer_shares(spark, sf):
    return fu.infer_shares(b.info(spark, sf), b.parsed_facts(spark, sf).where("statement_type = 'BS'")).select("instrument_id", "fiscal_year", "value")


@register("latest_period", "SELECT instrument_id, CAST(CAST(max(as_reported_ts) AS DATE) AS VARCHAR) AS latest_period FROM facts GROUP BY 1")
def latest_period(spark, sf):
    return fu.latest_period(b.facts(spark, sf))


PERIODS = "(SELECT instrument_id, as_reported_ts, max(CASE WHEN line_item_code = 'TOTAL_REVENUE' THEN value END) AS r FROM parsed_facts GROUP BY 1, 2)"


@register("valid_fiscal_periods", f"""
SELECT statement_fact_id, CAST(value AS DOUBLE) AS value FROM parsed_facts JOIN {PERIODS} USING (instrument_id, as_reported_ts) WHERE r <> 0""")
def valid_periods(spark, sf):
    return fu.valid_fiscal_periods(b.parsed_facts(spark, sf))[0].select("statement_fact_id", "value")


@register("skipped_fiscal_periods", f"""
SELECT instrument_id, 'skipped_period period_end=' || CAST(CAST(as_reported_ts AS DATE) AS VARCHAR) || ' reason=missing_or_zero_total_revenue' AS reason FROM {PERIODS} WHERE r IS NULL OR r = 0""")
def skipped_periods(spark, sf):
    return fu.valid_fiscal_periods(b.parsed_facts(spark, sf))[1].select("instrument_id", "reason")


@register("drop_null_values", "SELECT statement_fact_id, CAST(value AS DOUBLE) AS value FROM facts")
def drop_nulls(spark, sf):
    return fu.drop_null_values(b.parsed_facts(spark, sf), "value").select("statement_fact_id", "value")


@register("pivot_line_items", """
SELECT instrument_id, CAST(CAST(as_reported_ts AS DATE) AS VARCHAR) AS as_of_date, CAST(max(CASE WHEN line_item_code = 'TOTAL_REVENUE' THEN value END) AS DOUBLE) AS "TOTAL_REVENUE",
 CAST(max(CASE WHEN line_item_code = 'EBITDA' THEN value END) AS DOUBLE) AS "EBITDA", CAST(max(CASE WHEN line_item_code = 'CASH' THEN value END) AS DOUBLE) AS "CASH" FROM facts GROUP BY 1, 2""")
def pivot_lines(spark, sf):
    return fu.pivot_line_items(b.facts(spark, sf), ["TOTAL_REVENUE", "EBITDA", "CASH"])


from tickerlake.plans.sqlparts import part  # noqa: E402

part("line_wide", "SELECT instrument_id, CAST(as_reported_ts AS DATE) AS as_of_date, " + ", ".join(
    f"CAST(max(CASE WHEN line_item_code = '{c}' THEN value END) AS DOUBLE) AS {c.lower()}" for c in fu.METRIC_LINES) + " FROM facts GROUP BY 1, 2")
part("ratios", "\nUNION ALL ".join(
    f"SELECT instrument_id, as_of_date, '{k}' AS metric_code, CASE WHEN {d} <> 0 THEN round_even({n} / {d}, 8) END AS metric_value, CASE WHEN {n} IS NOT NULL AND {d} < 0 THEN 'NEGATIVE_DENOMINATOR' END AS flag FROM line_wide"
    for k, (n, d) in {k: (x.lower(), y.lower()) for k, (x, y) in fu.RATIOS.items()}.items()))
part("growth", """
SELECT instrument_id, as_of_date, 'REVENUE_GROWTH_YOY' AS metric_code, CASE WHEN p <> 0 THEN round_even((total_revenue - p) / abs(p), 8) END AS metric_value, NULL AS flag FROM (
 SELECT *, last_value(total_revenue IGNORE NULLS) OVER (PARTITION BY instrument_id ORDER BY as_of_date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM line_wide)""")
part("info_rows", """
SELECT instrument_id, m AS as_of_date, 'CURRENT_RATIO' AS metric_code, current_ratio AS metric_value, NULL AS flag FROM (SELECT instrument_id, max(as_of_date) AS m FROM line_wide GROUP BY 1) LEFT JOIN info USING (instrument_id)
UNION ALL SELECT instrument_id, m, 'QUICK_RATIO', quick_ratio, NULL FROM (SELECT instrument_id, max(as_of_date) AS m FROM line_wide GROUP BY 1) LEFT JOIN info USING (instrument_id)""")
_M = 'SELECT instrument_id, CAST(as_of_date AS VARCHAR) AS as_of_date, metric_code, metric_value, flag AS quality_flag FROM '


@register("ratio_metrics", _M + "ratios")
def ratio_metrics(spark, sf):
    return fu.ratio_metrics(fu.metric_wide(b.facts(spark, sf)))


@register("growth_yoy", _M + "growth")
def growth(spark, sf):
    return fu.growth_yoy(fu.metric_wide(b.facts(spark, sf)))


@register("info_metrics", _M + "info_rows")
def info_metrics(spark, sf):
    return fu.info_metrics(b.info(spark, sf), b.facts(spark, sf))


@register("build_metrics", "SELECT instrument_id, metric_code, count(*) AS n, round(sum(metric_value), 3) AS total, count(flag) AS flagged FROM (SELECT * FROM ratios UNION ALL SELECT * FROM growth UNION ALL SELECT * FROM info_rows) WHERE metric_value IS NOT NULL GROUP BY 1, 2")
def build_metrics(spark, sf):
    m = fu.build_metrics(b.facts(spark, sf), b.info(spark, sf), NOW)
    return m.groupBy("instrument_id", "metric_code").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("metric_value").cast("double"), 3).alias("total"), F.count("lookback_period").alias("flagged"))


@register("input_hash", """
SELECT instrument_id, metric_code, sha256('{"instrument_id":"' || instrument_id || '","metric_code":"' || metric_code || '","metric_date":"' || CAST(as_of_date AS VARCHAR) || '"}') AS input_hash FROM info_rows""")
def input_hash(spark, sf):
    from tickerlake.functions import text

    rows = fu.info_metrics(b.info(spark, sf), b.facts(spark, sf))
    return rows.select("instrument_id", "metric_code", text.input_hash(instrument_id=F.col("instrument_id"), metric_code=F.col("metric_code"), metric_date=F.col("as_of_date")).alias("input_hash"))


@register("fundamentals_pipeline", f"""
WITH vf AS (SELECT * FROM parsed_facts JOIN {PERIODS} USING (instrument_id, as_reported_ts) WHERE r <> 0 AND fiscal_year >= 1998),
seen AS (SELECT instrument_id, count(*) AS statements_seen FROM parsed_facts WHERE fiscal_year >= 1998 GROUP BY 1),
cnt AS (SELECT instrument_id, count(*) AS record_count_in, count(value) AS statements_stored FROM vf GROUP BY 1),
stored AS (SELECT * FROM facts WHERE fiscal_year < 1998 UNION ALL SELECT * EXCLUDE (r) FROM (SELECT statement_fact_id, instrument_id, fiscal_year, fiscal_period, statement_type, line_item_code, value, as_reported_ts, ingested_at, r FROM vf) WHERE value IS NOT NULL),
lw AS (SELECT instrument_id, CAST(as_reported_ts AS DATE) AS as_of_date, {", ".join(f"CAST(max(CASE WHEN line_item_code = '{c}' THEN value END) AS DOUBLE) AS {c.lower()}" for c in fu.METRIC_LINES)} FROM stored GROUP BY 1, 2),
mc AS (SELECT instrument_id, sum({" + ".join(f"(CASE WHEN {n.lower()} IS NOT NULL AND {d.lower()} <> 0 THEN 1 ELSE 0 END)" for n, d in fu.RATIOS.values())}
   + CASE WHEN total_revenue IS NOT NULL AND p <> 0 THEN 1 ELSE 0 END) AS k FROM (SELECT *, last_value(total_revenue IGNORE NULLS) OVER (PARTITION BY instrument_id ORDER BY as_of_date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM lw) GROUP BY 1)
SELECT s.instrument_id, statements_seen, coalesce(record_count_in, 0) AS record_count_in, coalesce(statements_stored, 0) AS statements_stored,
 CAST(CASE WHEN record_count_in IS NULL THEN 0 ELSE k + 1 + CASE WHEN current_ratio IS NOT NULL THEN 1 ELSE 0 END END AS BIGINT) AS metrics_computed, record_count_in IS NULL AS skipped,
 CASE WHEN record_count_in IS NULL THEN 'No annual periods with non-zero total_revenue' END AS skip_reason
FROM seen s LEFT JOIN cnt USING (instrument_id) LEFT JOIN mc USING (instrument_id) LEFT JOIN info USING (instrument_id)""")
def pipeline(spark, sf):
    parsed, stored = b.parsed_facts(spark, sf).where("fiscal_year >= 1998"), b.facts(spark, sf).where("fiscal_year < 1998")
    none = fu.build_metrics(stored, b.info(spark, sf), NOW).where("false")
    return fu.fundamentals_pipeline(parsed, stored, none, b.info(spark, sf), NOW)["results"]


part("newest", "SELECT instrument_id, " + ", ".join(
    f"coalesce(max_by(value, period) FILTER (label = '{x}' AND value IS NOT NULL), 0) AS {s}" for x, s in fu._VIEW.items()) + " FROM statements GROUP BY 1")
part("quality", """
SELECT instrument_id, ca / nullif(cl, 0) AS current_ratio, (ca - inv) / nullif(cl, 0) AS quick_ratio, CASE WHEN fcf <> 0 THEN fcf ELSE cfo - abs(capex) END AS fcff, cfo / nullif(ni, 0) AS cfo_net_income,
 ar * 365 / nullif(r, 0) AS dso, inv * 365 / nullif(abs(cogs), 0) AS doh, ap * 365 / nullif(abs(cogs), 0) AS dpo, gp / nullif(r, 0) AS gross_margin,
 CASE WHEN eb <> 0 THEN eb ELSE ie END / nullif(r, 0) AS ebitda_margin, ni / nullif(r, 0) AS net_margin, ni / nullif(e, 0) AS roe
FROM (SELECT n.*, n.ebitda AS eb, coalesce(i.ebitda, 0) AS ie, CASE WHEN rev <> 0 THEN rev ELSE rev2 END AS r, CASE WHEN eq <> 0 THEN eq ELSE eq2 END AS e FROM newest n LEFT JOIN info i USING (instrument_id))""")
QR = ["current_ratio", "quick_ratio", "fcff", "cfo_net_income", "dso", "doh", "dpo", "gross_margin", "ebitda_margin", "net_margin", "roe"]


def _quality(spark, sf):
    return fu.quality_ratios(b.statements(spark, sf), b.info(spark, sf))


@register("quality_ratios", "SELECT instrument_id, " + ", ".join(f"round({c}, 6) AS {c}" for c in QR) + " FROM quality")
def quality_ratios(spark, sf):
    return _quality(spark, sf).select("instrument_id", *[F.round(c, 6).alias(c) for c in QR])


@register("cash_conversion_cycle", "SELECT instrument_id, round(dso + doh - dpo, 5) AS ccc FROM quality")
def ccc(spark, sf):
    return fu.cash_conversion_cycle(_quality(spark, sf)).select("instrument_id", F.round("ccc", 5).alias("ccc"))


@register("ratio_labels", """
SELECT instrument_id, CASE WHEN current_ratio >= 1.5 THEN 'Comfortable' WHEN current_ratio IS NOT NULL THEN 'Watch list' END AS liquidity,
 CASE WHEN cfo_net_income >= 1 THEN 'Healthy' WHEN cfo_net_income IS NOT NULL THEN 'Fragile' END AS earnings_quality, CASE WHEN roe >= 0.15 THEN 'Strong' WHEN roe IS NOT NULL THEN 'Average' END AS capital_efficiency FROM quality""")
def ratio_labels(spark, sf):
    return fu.ratio_labels(_quality(spark, sf))


@register("margin_trends", """
WITH w AS (SELECT instrument_id, period, max(CASE WHEN label = 'Total Revenue' THEN coalesce(value, 0) END) AS r1, max(CASE WHEN label = 'Revenue' THEN coalesce(value, 0) END) AS r2, max(CASE WHEN label = 'Gross Profit' THEN coalesce(value, 0) END) AS gp,
  max(CASE WHEN label = 'EBITDA' THEN coalesce(value, 0) END) AS eb, max(CASE WHEN label = 'Net Income' THEN coalesce(value, 0) END) AS ni, max(CASE WHEN label = 'Stockholders Equity' THEN coalesce(value, 0) END) AS e1,
  max(CASE WHEN label = 'Total Equity Gross Minority Interest' THEN coalesce(value, 0) END) AS e2 FROM statements GROUP BY 1, 2),
z AS (SELECT instrument_id, period, nullif(coalesce(r1, r2, 0), 0) AS r, coalesce(gp, 0) AS gp, coalesce(eb, 0) AS eb, coalesce(ni, 0) AS ni, nullif(coalesce(e1, e2, 0), 0) AS e, row_number() OVER (PARTITION BY instrument_id ORDER BY period DESC) AS k FROM w)
SELECT instrument_id, CAST(period AS VARCHAR) AS period, round(gp / r, 7) AS gross_margin, round(eb / r, 7) AS ebitda_margin, round(ni / r, 7) AS net_margin, round(ni / e, 7) AS roe FROM z WHERE k <= 3""")
def margin_trends(spark, sf):
    return fu.margin_trends(b.statements(spark, sf), 3).select("instrument_id", "period", *[F.round(c, 7).alias(c) for c in ("gross_margin", "ebitda_margin", "net_margin", "roe")])


# --- merges of facts ----------------------------------------------------------------------


@register("merge_statement_facts", """
SELECT statement_fact_id, CAST(CASE WHEN fiscal_year >= 1999 AND instrument_id % 3 = 0 THEN value * 2 ELSE value END AS DOUBLE) AS value FROM facts""")
def merge_facts(spark, sf):
    f = b.facts(spark, sf)
    newer = f.where("fiscal_year >= 1999 and instrument_id % 3 = 0").withColumn("value", (F.col("value") * 2).cast("decimal(24,4)"))
    # stored: all but what only the new delivery has
    return merge.merge_statement_facts(f.where("fiscal_year < 2000 or instrument_id % 3 <> 0"), newer).select("statement_fact_id", "value")


@register("merge_metric_facts", """
SELECT instrument_id, metric_code, CAST(as_of_date AS VARCHAR) AS as_of_date, CASE WHEN instrument_id % 2 = 0 THEN metric_value + 1 ELSE metric_value END AS metric_value, '2001-01-01 00:00:00' AS created_at FROM metrics""")
def merge_metrics(spark, sf):
    m = b.metrics(spark, sf).withColumn("calc_version", F.lit("v1")).withColumn("created_at", F.lit(dt.datetime(2001, 1, 1))).drop("metric_fact_id")
    newer = m.where("instrument_id % 2 = 0").withColumn("metric_value", (F.col("metric_value") + 1).cast("decimal(24,8)")).withColumn("created_at", F.lit(NOW))
    return merge.merge_metric_facts(m, newer).drop("calc_version")


# --- valuation inputs -------------------------------------------------------------------------


@register("asof_metric", """
SELECT instrument_id, round(ev, 4) AS enterprise_value, round(ebitda, 4) AS ebitda, round(nd, 4) AS net_debt, missing AS missing_metric FROM metric_state""")
def asof_metric(spark, sf):
    w = va.asof_metric(b.metrics(spark, sf), va.PEER_METRICS, DAY)
    return w.select("instrument_id", *[F.round(c, 4).alias(c) for c in ("enterprise_value", "ebitda", "net_debt")], "missing_metric")


@register("asof_statement_period", """
SELECT f.instrument_id, CAST(mx AS VARCHAR) AS period_ts, CAST(max(CASE WHEN line_item_code = 'TOTAL_REVENUE' THEN value END) AS DOUBLE) AS "TOTAL_REVENUE", CAST(max(CASE WHEN line_item_code = 'CAPEX' THEN value END) AS DOUBLE) AS "CAPEX"
FROM facts f JOIN (SELECT instrument_id, max(as_reported_ts) AS mx FROM facts WHERE as_reported_ts < TIMESTAMP '2001-01-01' GROUP BY 1) g ON g.instrument_id = f.instrument_id AND g.mx = f.as_reported_ts GROUP BY 1, 2""")
def asof_period(spark, sf):
    return va.asof_statement_period(b.facts(spark, sf), DAY, ["TOTAL_REVENUE", "CAPEX"])


@register("asof_latest_revenue", """
SELECT instrument_id, CAST(max_by(value, statement_fact_id) AS DOUBLE) AS revenue FROM facts WHERE line_item_code = 'TOTAL_REVENUE' AND as_reported_ts < TIMESTAMP '2001-01-01' GROUP BY 1""")
def asof_revenue(spark, sf):
    legacy = b.facts(spark, sf).where("line_item_code = 'TOTAL_REVENUE'").withColumn("line_item_code", F.lit("Revenue"))
    return va.asof_latest_revenue(legacy, DAY)


@register("build_projection_input", "SELECT instrument_id, rev AS revenue_base, sh AS share_count, round(nd, 4) AS net_debt, da, capex FROM dcf_base")
def projection_input(spark, sf):
    return va.build_projection_input(b.facts(spark, sf), DAY).select("instrument_id", "revenue_base", "share_count", F.round("net_debt", 4).alias("net_debt"), "da", "capex")


@register("projection_with_fallback", """
SELECT q.instrument_id, coalesce(rev, 1e9::DOUBLE) AS revenue_base, coalesce(sh, 1e8::DOUBLE) AS share_count, CASE WHEN rev IS NULL THEN 'FALLBACK' ELSE 'FACTS' END AS input_source,
 CASE WHEN short_capex THEN 2 ELSE forecast_years END AS n_capex, CASE WHEN short_capex THEN 1000::DOUBLE ELSE coalesce(capex, 5.5e7::DOUBLE) END AS capex_1 FROM dcf_rows q""")
def projection_fallback(spark, sf):
    rows = va.projection_with_fallback(va.build_projection_input(b.facts(spark, sf), DAY), b.requests(spark, sf), allow_placeholder=True)
    return rows.select("instrument_id", "revenue_base", "share_count", "input_source", F.size("capex_plan").cast("long").alias("n_capex"), F.col("capex_plan")[0].alias("capex_1"))


@register("dcf_input_errors", "SELECT instrument_id, err AS error FROM dcf_rows")
def dcf_errors(spark, sf):
    return _dcf_rows(spark, sf).select("instrument_id", va.dcf_input_errors().alias("error"))


@register("dcf_projection", "SELECT instrument_id, t AS year_index, round(r, 3) AS revenue, round(fcf, 3) AS free_cash_flow, round(fcf / df, 3) AS present_value FROM dcf_years")
def dcf_projection(spark, sf):
    return va.dcf_projection(_dcf_rows(spark, sf)).select("instrument_id", "year_index", *[F.round(c, 3).alias(c) for c in ("revenue", "free_cash_flow", "present_value")])


@register("present_value_sum", "SELECT instrument_id, round(sum(fcf / df), 3) AS pv FROM dcf_years GROUP BY 1")
def pv_sum(spark, sf):
    return va.dcf_project(_dcf_rows(spark, sf)).where("lines is not null").select("instrument_id", F.round(va.present_value_sum(), 3).alias("pv"))


@register("dcf_value", "SELECT instrument_id, round(ev, 2) AS enterprise_value, round(eq, 2) AS equity_value, round(tv, 2) AS terminal_value, round(price, 5) AS price FROM dcf_val")
def dcf_value(spark, sf):
    v = va.dcf_value(_dcf_rows(spark, sf)).where("dcf_price is not null")
    return v.select("instrument_id", F.round("enterprise_value_dcf", 2).alias("enterprise_value"), F.round("equity_value_dcf", 2).alias("equity_value"), F.round("terminal_value", 2).alias("terminal_value"), F.round("dcf_price", 5).alias("price"))


# --- peers ---------------------------------------------------------------------------------------


@register("peer_map", """
SELECT t.instrument_id, gkind AS group_kind, gk AS group_key, coalesce(n, 0) AS peer_count FROM universe t LEFT JOIN (SELECT instrument_id, count(*) AS n FROM peer_pairs GROUP BY 1) USING (instrument_id)""")
def peer_map(spark, sf):
    return va.peer_map(b.value_instruments(spark, sf), b.value_companies(spark, sf), DAY)


@register("peer_multiples", "SELECT instrument_id, m AS multiple_name, round(v, 9) AS multiple FROM mult")
def peer_multiples(spark, sf):
    return va.peer_multiples(va.asof_metric(b.metrics(spark, sf), va.PEER_METRICS, DAY)).select("instrument_id", "multiple_name", F.round("multiple", 9).alias("multiple"))


@register("excluded_peers", """
SELECT instrument_id, k AS group_kind, g AS group_key, m AS multiple_name FROM (SELECT instrument_id, 'INDUSTRY' AS k, industry_code AS g FROM universe WHERE is_peer UNION ALL SELECT instrument_id, 'SECTOR', sector_code FROM universe WHERE is_peer)
JOIN mult USING (instrument_id) WHERE v IS NULL AND g IS NOT NULL""")
def excluded(spark, sf):
    return va.excluded_peers(_groups(spark, sf), va.asof_metric(b.metrics(spark, sf), va.PEER_METRICS, DAY))


@register("exclusive_quartiles", """
SELECT m, len(l) AS n, round(list_aggregate(l[1:len(l) // 2], 'median'), 9) AS q1, round(list_aggregate(l, 'median'), 9) AS med, round(list_aggregate(l[len(l) - len(l) // 2 + 1:], 'median'), 9) AS q3
FROM (SELECT m, list(v ORDER BY v) AS l FROM mult WHERE v IS NOT NULL GROUP BY 1)""")
def quartiles(spark, sf):
    m = va.peer_multiples(va.asof_metric(b.metrics(spark, sf), va.PEER_METRICS, DAY)).select(F.col("multiple_name").alias("m"), "multiple")
    return orderstats.exclusive_quartiles(m, ["m"], "multiple").select("m", "n", *[F.round(c, 9).alias(c) for c in ("q1", "med", "q3")])


@register("median_exact", "SELECT o_orderpriority AS k, count(*) AS n, median(o_totalprice) AS median FROM orders GROUP BY 1")
def median_exact(spark, sf):
    return orderstats.median_exact(b.table(spark, sf, "orders").select(F.col("o_orderpriority").alias("k"), "o_totalprice"), ["k"], "o_totalprice")


def _relative(spark, sf):
    return va.relative_valuation(_groups(spark, sf), va.asof_metric(b.metrics(spark, sf), va.PEER_METRICS, DAY))


@register("relative_valuation", "SELECT instrument_id, rel_status, round(rel_equity, 2) AS rel_equity, round(rel_price, 5) AS rel_price, round(rel_enterprise, 2) AS rel_enterprise, CAST(peers AS BIGINT) AS max_peer_count FROM rel_value UNION ALL SELECT instrument_id, 'REFUSED', NULL, NULL, NULL, NULL FROM universe WHERE instrument_id NOT IN (SELECT instrument_id FROM rel_value)")
def relative(spark, sf):
    return _relative(spark, sf).select("instrument_id", "rel_status", F.round("rel_equity", 2).alias("rel_equity"), F.round("rel_price", 5).alias("rel_price"), F.round("rel_enterprise", 2).alias("rel_enterprise"), "max_peer_count")


_THREE = sqlparts.PARTS["rel_value"].replace("FROM rel_multiple r JOIN", "FROM (SELECT * FROM rel_multiple WHERE m IN ('P/E', 'P/B', 'EV/Sales')) r JOIN")


@register("relative_valuation_subset", f"""
SELECT instrument_id, rel_status, round(rel_equity, 2) AS rel_equity, round(rel_price, 5) AS rel_price, CAST(peers AS BIGINT) AS max_peer_count FROM ({_THREE})
UNION ALL SELECT instrument_id, 'REFUSED', NULL, NULL, NULL FROM universe WHERE instrument_id NOT IN (SELECT instrument_id FROM ({_THREE}))""")
def relative_subset(spark, sf):
    """Only the multiples that a caller names take part; an odd number of them makes the median one of them."""
    r = va.relative_valuation(_groups(spark, sf), va.asof_metric(b.metrics(spark, sf), va.PEER_METRICS, DAY), multiples=["P/E", "P/B", "EV/Sales"])
    return r.select("instrument_id", "rel_status", F.round("rel_equity", 2).alias("rel_equity"), F.round("rel_price", 5).alias("rel_price"), "max_peer_count")


@register("implied_values", """
SELECT r.instrument_id, m AS multiple_name, n AS peer_count, round(q1, 8) AS q1, round(med, 8) AS med, round(q3, 8) AS q3,
 round(CASE m WHEN 'EV/EBITDA' THEN q1 * ebitda - nd WHEN 'P/E' THEN q1 * earn WHEN 'P/B' THEN q1 * book ELSE q1 * sales - nd END, 2) AS equity_q1,
 round(CASE m WHEN 'EV/EBITDA' THEN q3 * ebitda - nd WHEN 'P/E' THEN q3 * earn WHEN 'P/B' THEN q3 * book ELSE q3 * sales - nd END / sh, 5) AS price_q3
FROM rel_multiple r JOIN metric_state USING (instrument_id) JOIN rel_value v ON v.instrument_id = r.instrument_id WHERE rel_status = 'AVAILABLE'""")
def implied(spark, sf):
    r = _relative(spark, sf).select("instrument_id", F.explode("multiple_results").alias("r")).select("instrument_id", "r.*")
    return r.select("instrument_id", "multiple_name", "peer_count", *[F.round(c, 8).alias(c) for c in ("q1", "med", "q3")], F.round("equity_q1", 2).alias("equity_q1"), F.round("price_q3", 5).alias("price_q3"))


@register("max_peer_count", "SELECT instrument_id, CAST(peers AS BIGINT) AS max_peer_count FROM rel_value WHERE rel_status = 'AVAILABLE'")
def max_peers(spark, sf):
    return va.max_peer_count(_relative(spark, sf)).where("max_peer_count is not null")


# --- whole valuation ---------------------------------------------------------------------------


@register("value_universe", """
SELECT val_run_id, instrument_id, status, CASE WHEN failure LIKE 'Missing required metric%' THEN 'Missing required metric' ELSE failure END AS failure,
 CASE WHEN status <> 'FAILED' THEN round(blend_price, 5) END AS blended_price, CASE WHEN status <> 'FAILED' THEN round(composite, 2) END AS composite_score FROM valued""")
def value_universe(spark, sf):
    v, ok = _valued(spark, sf), F.col("status") != "FAILED"
    return v.select("val_run_id", "instrument_id", "status", F.when(F.col("failure").startswith("Missing required metric"), "Missing required metric").otherwise(F.col("failure")).alias("failure"),
                    F.when(ok, F.round("blended_price", 5)).alias("blended_price"), F.when(ok, F.round("composite_score", 2)).alias("composite_score"))


@register("value_universe_live", """
WITH q AS (SELECT CASE WHEN count(*) FILTER (incident_status IN ('OPEN', 'IN_PROGRESS')) > 0 THEN 20.0::DOUBLE ELSE 85.0::DOUBLE END AS dq FROM incidents),
scored AS (SELECT val_run_id, failure, round_even(((SELECT dq FROM q) + least(peers * 20.0::DOUBLE, 100) + 75.0::DOUBLE + agreement) / 4, 2) AS composite FROM valued)
SELECT val_run_id, CASE WHEN failure IS NOT NULL THEN 'FAILED' WHEN composite < 40 THEN 'OVERRIDDEN' ELSE 'SUCCESS' END AS status,
 CASE WHEN failure IS NULL THEN round(composite, 2) END AS composite_score FROM scored""")
def value_universe_live(spark, sf):
    v = va.value_universe(b.facts(spark, sf), b.metrics(spark, sf), b.value_instruments(spark, sf), b.value_companies(spark, sf), b.requests(spark, sf), DAY,
                          data_quality=serving.data_quality_score(b.incidents(spark, sf)))
    return v.select("val_run_id", "status", F.when(F.col("status") != "FAILED", F.round("composite_score", 2)).alias("composite_score"))


@register("model_agreement", "SELECT instrument_id, round(agreement, 2) AS model_agreement FROM valued WHERE status <> 'FAILED'")
def agreement(spark, sf):
    return va._done(_valued(spark, sf)).select("instrument_id", F.round("model_agreement", 2).alias("model_agreement"))


@register("confidence_score", "SELECT instrument_id, round(composite, 2) AS composite_score, CAST(least(peers * 20, 100) AS DOUBLE) AS peer_count_score, composite < 40 AS override_required FROM valued WHERE status <> 'FAILED'")
def confidence(spark, sf):
    return va._done(_valued(spark, sf)).select("instrument_id", F.round("composite_score", 2).alias("composite_score"), "peer_count_score", "override_required")


@register("blend_valuations", "SELECT instrument_id, round(blend_price, 5) AS price, round(blend_eq, 2) AS equity, round(blend_ev, 2) AS enterprise FROM valued WHERE status <> 'FAILED'")
def blend(spark, sf):
    return va._done(_valued(spark, sf)).select("instrument_id", F.round("blended_price", 5).alias("price"), F.round("blended_equity", 2).alias("equity"), F.round("blended_enterprise", 2).alias("enterprise"))


@register("run_status", "SELECT status, count(*) AS n FROM valued GROUP BY 1")
def run_status(spark, sf):
    return _valued(spark, sf).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@register("model_outputs", """
SELECT val_run_id, 'DCF' AS model_name, round(dcf_price, 4) AS target_price, round(dcf_eq, 2) AS equity_value, 0.5::DOUBLE AS weight FROM valued WHERE status <> 'FAILED'
UNION ALL SELECT val_run_id, 'RELATIVE', round(rel_price, 4), round(rel_equity, 2), 0.5::DOUBLE FROM valued WHERE status <> 'FAILED'
UNION ALL SELECT val_run_id, 'BLENDED', round(blend_price, 4), round(blend_eq, 2), 1.0::DOUBLE FROM valued WHERE status <> 'FAILED'""")
def model_outputs(spark, sf):
    return va.model_outputs(_valued(spark, sf)).select("val_run_id", "model_name", F.round(F.col("target_price").cast("double"), 4).alias("target_price"), F.round(F.col("equity_value").cast("double"), 2).alias("equity_value"), "weight")


@register("attribution_rows", """
SELECT val_run_id, 'DCF_FCF' AS driver_type, 'YEAR_' || t AS driver_key, round(fcf, 3) AS impact, CASE WHEN fcf > 0 THEN 'UP' WHEN fcf < 0 THEN 'DOWN' ELSE 'NEUTRAL' END AS direction FROM valued JOIN dcf_years USING (instrument_id) WHERE status <> 'FAILED'
UNION ALL SELECT val_run_id, 'DCF_TERMINAL_VALUE', 'TERMINAL_VALUE', round(tpv, 3), CASE WHEN tpv > 0 THEN 'UP' WHEN tpv < 0 THEN 'DOWN' ELSE 'NEUTRAL' END FROM valued WHERE status <> 'FAILED'
UNION ALL SELECT val_run_id, 'CONFIDENCE', 'ANALYST_OVERRIDE_REQUIRED', composite, 'DOWN' FROM valued WHERE status = 'OVERRIDDEN'""")
def attribution(spark, sf):
    return va.attribution_rows(_valued(spark, sf)).select("val_run_id", "driver_type", "driver_key", F.round(F.col("impact_value_abs").cast("double"), 3).alias("impact"), "direction")


@register("direction", """
SELECT instrument_id, CASE WHEN metric_value > 0 THEN 'UP' WHEN metric_value < 0 THEN 'DOWN' ELSE 'NEUTRAL' END AS direction, count(*) AS n FROM metrics GROUP BY 1, 2""")
def direction(spark, sf):
    return b.metrics(spark, sf).groupBy("instrument_id", numeric.direction(F.col("metric_value")).alias("direction")).agg(F.count(F.lit(1)).alias("n"))


@register("confidence_snapshot", """
SELECT val_run_id, round(composite, 2) AS overall_confidence, 85.0::DOUBLE AS data_quality_score, 75.0::DOUBLE AS management_credibility_score, CAST(least(peers * 20, 100) AS DOUBLE) AS industry_stability_score,
 75.0::DOUBLE AS forecast_accuracy_score, 85.0::DOUBLE AS news_reliability_score, round(agreement, 2) AS model_agreement_score, round(100 - agreement, 2) AS scenario_dispersion_score FROM valued WHERE status <> 'FAILED'""")
def snapshot(spark, sf):
    return va.confidence_snapshot(_valued(spark, sf)).drop("scoring_version")


part("long_assumptions", """
SELECT val_run_id, unnest(['wacc','terminal_growth','forecast_years','revenue_cagr','ebit_margin']) AS assumption_key, unnest([wacc, terminal_growth, CAST(forecast_years AS DOUBLE), revenue_cagr, ebit_margin]) AS value FROM val_requests""")


@register("assumptions_long", """
SELECT val_run_id, assumption_key, round(value, 8) AS value, CASE WHEN assumption_key = 'forecast_years' THEN 'YEARS' ELSE 'RATIO' END AS unit FROM long_assumptions""")
def assumptions_long(spark, sf):
    return va.assumptions_long(b.requests(spark, sf)).select("val_run_id", "assumption_key", F.col("assumption_value_numeric").alias("value"), F.col("assumption_unit").alias("unit"))


@register("assumptions_wide", """
SELECT val_run_id, CASE WHEN val_run_id % 7 <> 0 THEN round(wacc, 8) END AS wacc, CAST(forecast_years AS DOUBLE) AS forecast_years, CASE WHEN val_run_id % 7 = 0 THEN 'wacc' ELSE '' END AS missing_keys FROM val_requests""")
def assumptions_wide(spark, sf):
    long = va.assumptions_long(b.requests(spark, sf)).where("not (val_run_id % 7 = 0 and assumption_key = 'wacc')")
    return va.assumptions_wide(long).select("val_run_id", "wacc", "forecast_years", "missing_keys")


@register("insert_assumptions_once", "SELECT val_run_id, assumption_key, round(CASE WHEN val_run_id % 2 = 0 THEN value ELSE value + 1 END, 8) AS value FROM long_assumptions")
def insert_once(spark, sf):
    long = va.assumptions_long(b.requests(spark, sf))
    kept, _ = merge.insert_assumptions_once(long.where("val_run_id % 2 = 0"), long.withColumn("assumption_value_numeric", (F.col("assumption_value_numeric") + 1).cast("decimal(24,8)")))
    return kept.select("val_run_id", "assumption_key", F.col("assumption_value_numeric").alias("value"))


@register("reconstruct_inputs", """
SELECT val_run_id, round(wacc, 8) AS wacc, CAST(3 AS BIGINT) AS n_models, 'BLENDED' AS first_model, true AS has_payload FROM valued JOIN val_requests USING (val_run_id) WHERE status <> 'FAILED'""")
def reconstruct(spark, sf):
    r = va.reconstruct_inputs(va.model_outputs(_valued(spark, sf)), va.assumptions_long(b.requests(spark, sf)))
    return r.select("val_run_id", "wacc", F.size("model_outputs").cast("long").alias("n_models"), F.col("model_outputs")[0].model_name.alias("first_model"),
                    F.forall("model_outputs", lambda m: m.output_payload.startswith("{")).alias("has_payload"))


@register("payload_json", """
SELECT val_run_id, 'UNAVAILABLE' AS status FROM valued WHERE status <> 'FAILED' AND rel_status = 'UNAVAILABLE'""")
def payload(spark, sf):
    o = va.model_outputs(_valued(spark, sf)).where("model_name = 'RELATIVE'")
    return o.select("val_run_id", F.get_json_object("output_payload", "$.status").alias("status")).where("status is not null")


# --- quick variant ---------------------------------------------------------------------------------


@register("estimate_revenue", """
SELECT instrument_id, round(CASE WHEN price_to_sales <> 0 THEN market_cap / price_to_sales WHEN trailing_pe <> 0 THEN market_cap / trailing_pe / coalesce(profit_margins, 0.12::DOUBLE) ELSE greatest(market_cap * 0.6::DOUBLE, 1) END, 6) AS revenue FROM info""")
def estimate(spark, sf):
    return b.info(spark, sf).select("instrument_id", F.round(va.estimate_revenue(), 6).alias("revenue"))


@register("margin_dcf", "SELECT instrument_id, round((ev - debt) / greatest(sh, 1), 5) AS intrinsic_value FROM quick WHERE k = 4")
def margin_dcf(spark, sf):
    return va.margin_dcf(b.info(spark, sf)).select("instrument_id", F.round("intrinsic_value", 5).alias("intrinsic_value"))


@register("compound_projection", "SELECT instrument_id, t AS year, round(total_revenue * pow(1 + revenue_cagr, t), 4) AS revenue FROM (SELECT *, unnest(range(1, 6)) AS t FROM info)")
def compound(spark, sf):
    return va.compound_projection(b.info(spark, sf)).select("instrument_id", "year", F.round("revenue", 4).alias("revenue"))


@register("shock_grid", "SELECT instrument_id, round(wacc, 6) AS wacc, round(terminal_growth, 6) AS terminal_growth FROM shocked")
def grid(spark, sf):
    g = b.info(spark, sf).select("instrument_id", F.explode(va.shock_grid(F.col("wacc"), F.col("terminal_growth"))).alias("s"))
    return g.select("instrument_id", F.round("s.wacc", 6).alias("wacc"), F.round("s.terminal_growth", 6).alias("terminal_growth"))


@register("dcf_sensitivity", """
SELECT instrument_id, printf('%.1f', wacc * 100) || '%' AS wacc, printf('%.1f', terminal_growth * 100) || '%' AS terminal_growth, round((ev - debt) / greatest(sh, 1), 3) AS intrinsic_value FROM quick""")
def sensitivity(spark, sf):
    return va.dcf_sensitivity(b.info(spark, sf)).withColumn("intrinsic_value", F.round("intrinsic_value", 3))


@register("dcf_delta", "SELECT v.instrument_id, round((price - (ev_q - debt) / greatest(sh, 1)) / nullif(price, 0), 6) AS delta FROM dcf_val v JOIN (SELECT instrument_id, ev AS ev_q, debt, sh FROM quick WHERE k = 4) q USING (instrument_id)")
def delta(spark, sf):
    core = va.dcf_value(_dcf_rows(spark, sf)).where("dcf_price is not null").select("instrument_id", "dcf_price")
    j = core.join(va.margin_dcf(b.info(spark, sf)), "instrument_id")
    return j.select("instrument_id", F.round(va.dcf_delta(F.col("dcf_price"), F.col("intrinsic_value")), 6).alias("delta"))


@register("live_multiples", """
SELECT instrument_id, round(p / nullif(trailing_eps, 0), 9) AS p_e, round(enterprise_value / nullif(ebitda, 0), 9) AS ev_ebitda, round(p / nullif(book_value, 0), 9) AS p_b, round(market_cap / nullif(coalesce(total_revenue, 0), 0), 9) AS p_s
FROM (SELECT *, CASE WHEN current_price <> 0 THEN current_price ELSE regular_market_price END AS p FROM info)""")
def live(spark, sf):
    return va.live_multiples(b.info(spark, sf)).select("instrument_id", *[F.round(c, 9).alias(c) for c in ("p_e", "ev_ebitda", "p_b", "p_s")])


@register("pe_band", "SELECT instrument_id, CAST(date AS VARCHAR) AS date, round(close / trailing_eps, 3) AS trailing_pe FROM monthly JOIN info USING (instrument_id) WHERE trailing_eps <> 0")
def pe_band(spark, sf):
    return va.pe_band(b.monthly(spark, sf), b.info(spark, sf)).select("instrument_id", "date", F.round("trailing_pe", 3).alias("trailing_pe"))
