"""Statement parsing, period validation and derived metrics."""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tickerlake.functions import numeric, text
from tickerlake.operators import merge

# --- fixed values -----------------------------------------------------------
INCOME_LABELS = {
    "TOTAL_REVENUE": ["Total Revenue", "Operating Revenue"],
    "GROSS_PROFIT": ["Gross Profit"],
    "EBITDA": ["Normalized EBITDA"],
    "EBIT": ["Operating Income"],
    "NET_INCOME": ["Net Income", "Net Income Common Stockholders"],
    "INTEREST_EXPENSE": ["Interest Expense"],
    "TAX_PROVISION": ["Tax Provision"],
    "DILUTED_EPS": ["Diluted EPS"],
}
BALANCE_LABELS = {
    "TOTAL_ASSETS": ["Total Assets"],
    "TOTAL_LIABILITIES": ["Total Liabilities Net Minority Interest"],
    "TOTAL_EQUITY": ["Stockholders Equity"],
    "TOTAL_DEBT": ["Total Debt"],
    "NET_DEBT": ["Net Debt"],
    "CASH": ["Cash And Cash Equivalents"],
    "ACCOUNTS_RECEIVABLE": ["Accounts Receivable", "Net Receivables"],
    "INVENTORY": ["Inventory"],
    "ACCOUNTS_PAYABLE": ["Accounts Payable"],
}
CASHFLOW_LABELS = {
    "OPERATING_CF": ["Operating Cash Flow"],
    "CAPEX": ["Capital Expenditure"],
    "FREE_CASH_FLOW": ["Free Cash Flow"],
    "DEPRECIATION": ["Depreciation And Amortization"],
}
RATIOS = {
    "GROSS_MARGIN": ("GROSS_PROFIT", "TOTAL_REVENUE"),
    "EBITDA_MARGIN": ("EBITDA", "TOTAL_REVENUE"),
    "EBIT_MARGIN": ("EBIT", "TOTAL_REVENUE"),
    "NET_MARGIN": ("NET_INCOME", "TOTAL_REVENUE"),
    "ROE": ("NET_INCOME", "TOTAL_EQUITY"),
    "DEBT_TO_EQUITY": ("TOTAL_DEBT", "TOTAL_EQUITY"),
    "FCF_MARGIN": ("FREE_CASH_FLOW", "TOTAL_REVENUE"),
    "CAPEX_INTENSITY": ("CAPEX", "TOTAL_REVENUE"),
}
METRIC_LINES = ["TOTAL_REVENUE", "GROSS_PROFIT", "EBITDA", "EBIT", "NET_INCOME", "TOTAL_EQUITY", "TOTAL_DEBT", "FREE_CASH_FLOW", "CAPEX"]
LEGACY_REVENUE = "Revenue"
NEGATIVE_DENOMINATOR = "NEGATIVE_DENOMINATOR"
CALC_VERSION = "fundamentals_v1"
TRANSFORM_ID = "fundamentals_bootstrap_v1"
# ----------------------------------------------------------------------------

METRIC_KEYS = ["instrument_id", "as_of_date"]


def unpivot_statements(wide: DataFrame, field_map: dict[str, list[str]], statement_type: str, label: str = "label") -> DataFrame:
    """Label rows with one column per period end -> one row per period and line item.

    Every line item of the map comes out for every period, also when null; the first
    label with a value wins; capital expenditure is stored positive.
    """
    periods = [c for c in wide.columns if c not in ("instrument_id", label)]
    long = wide.unpivot(["instrument_id", label], periods, "period", "value")
    labels = sorted({x for names in field_map.values() for x in names})
    slot = {x: f"_v{i}" for i, x in enumerate(labels)}
    per_label = long.groupBy("instrument_id", "period").agg(
        *[F.max(F.when(F.col(label) == x, F.col("value"))).alias(s) for x, s in slot.items()])
    items = [F.struct(F.lit(code).alias("line_item_code"), text.abs_capex(F.lit(code), text.first_label_value(*[F.col(slot[x]) for x in names])).alias("value"))
             for code, names in field_map.items()]
    end = F.col("period").cast("date")
    return per_label.select("instrument_id", "period", F.explode(F.array(*items)).alias("_i")).select(
        "instrument_id", F.year(end).alias("fiscal_year"), F.lit("FY").alias("fiscal_period"), F.lit(statement_type).alias("statement_type"),
        "_i.line_item_code", "_i.value", end.cast("timestamp").alias("as_reported_ts"),
        F.concat_ws(":", F.lit(statement_type), "period", "_i.line_item_code").alias("source_record_id"),
    )


def union_statements(parts: list[DataFrame]) -> DataFrame:
    """Income, balance, cash flow and inferred share rows as one table."""
    return reduce(DataFrame.unionByName, parts)


def infer_shares(info: DataFrame, balance: DataFrame) -> DataFrame:
    """Shares = market cap / first non-zero price, on the latest balance-sheet period."""
    latest = balance.groupBy("instrument_id").agg(F.max("as_reported_ts").alias("as_reported_ts"))
    price = F.coalesce(numeric.truthy(F.col("current_price")), numeric.truthy(F.col("regular_market_price")), F.col("previous_close"))
    value = F.when(price > 0, numeric.safe_ratio(F.col("market_cap").cast("double"), price.cast("double")))
    return latest.join(info, "instrument_id").withColumn("value", value).where("value is not null").select(
        "instrument_id", F.year("as_reported_ts").alias("fiscal_year"), F.lit("FY").alias("fiscal_period"), F.lit("BS").alias("statement_type"),
        F.lit("SHARES_OUTSTANDING").alias("line_item_code"), F.col("value").cast("decimal(24,4)").alias("value"), "as_reported_ts",
        F.concat_ws(":", F.lit("BS"), F.col("as_reported_ts").cast("date").cast("string"), F.lit("SHARES_OUTSTANDING")).alias("source_record_id"),
    )


def latest_period(facts: DataFrame) -> DataFrame:
    return facts.groupBy("instrument_id").agg(F.max(F.col("as_reported_ts").cast("date")).alias("latest_period"))


def drop_null_values(df: DataFrame, col: str) -> DataFrame:
    return df.where(F.col(col).isNotNull())


def valid_fiscal_periods(facts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(facts of periods with non-zero revenue, skipped periods with their reason)."""
    revenue = F.max(F.when(F.col("line_item_code") == "TOTAL_REVENUE", F.col("value")))
    flags = facts.groupBy("instrument_id", "as_reported_ts").agg(revenue.alias("_rev"))
    good = F.coalesce(F.col("_rev") != 0, F.lit(False))
    skipped = flags.where(~good).select(
        "instrument_id", "as_reported_ts",
        F.concat(F.lit("skipped_period period_end="), F.col("as_reported_ts").cast("date").cast("string"), F.lit(" reason=missing_or_zero_total_revenue")).alias("reason"))
    return facts.join(flags.where(good).drop("_rev"), ["instrument_id", "as_reported_ts"], "left_semi"), skipped


def pivot_line_items(facts: DataFrame, codes: list[str]) -> DataFrame:
    """One row per instrument and period, one column per code; the later fact wins."""
    cols = [F.max_by(F.when(F.col("line_item_code") == c, F.col("value")), F.when(F.col("line_item_code") == c, F.col("statement_fact_id"))).alias(c) for c in codes]
    return facts.groupBy("instrument_id", F.col("as_reported_ts").cast("date").alias("as_of_date")).agg(*cols)


def metric_wide(facts: DataFrame) -> DataFrame:
    """Line items of the ratios, revenue falling back to its older code."""
    wide = pivot_line_items(facts, [*METRIC_LINES, LEGACY_REVENUE])
    return wide.withColumn("TOTAL_REVENUE", F.coalesce("TOTAL_REVENUE", LEGACY_REVENUE)).drop(LEGACY_REVENUE)


def _metric(code: Column, value: Column, flag: Column) -> Column:
    return F.struct(code.alias("metric_code"), numeric.half_even(value, 8, 24).alias("metric_value"), flag.alias("quality_flag"))


def _rows(df: DataFrame, metrics: list[Column]) -> DataFrame:
    return df.select(*METRIC_KEYS, F.explode(F.array(*metrics)).alias("_m")).select(*METRIC_KEYS, "_m.*")


def ratio_metrics(wide: DataFrame) -> DataFrame:
    """Eight ratios per period; null on a null or zero denominator; a negative one is flagged."""
    ms = []
    for code, (num, den) in RATIOS.items():
        value = numeric.safe_ratio(F.col(num).cast("double"), F.col(den).cast("double"))
        flag = F.when(value.isNotNull() & (F.col(den) < 0), NEGATIVE_DENOMINATOR)
        ms.append(_metric(F.lit(code), value, flag))
    return _rows(wide, ms)


def growth_yoy(wide: DataFrame) -> DataFrame:
    """Revenue growth over the last earlier period that has a revenue.

    One row per instrument and fiscal period, so the window is bounded by years.
    """
    w = W.partitionBy("instrument_id").orderBy("as_of_date").rowsBetween(W.unboundedPreceding, -1)
    prev = F.last("TOTAL_REVENUE", ignorenulls=True).over(w).cast("double")
    value = numeric.safe_ratio(F.col("TOTAL_REVENUE").cast("double") - prev, F.abs(prev))
    return _rows(wide.withColumn("_g", value), [_metric(F.lit("REVENUE_GROWTH_YOY"), F.col("_g"), F.lit(None).cast("string"))])


def info_metrics(info: DataFrame, facts: DataFrame) -> DataFrame:
    """Current and quick ratio, on the latest period only."""
    last = latest_period(facts).withColumnRenamed("latest_period", "as_of_date").join(info, "instrument_id", "left")
    none = F.lit(None).cast("string")
    return _rows(last, [_metric(F.lit("CURRENT_RATIO"), F.col("current_ratio").cast("double"), none), _metric(F.lit("QUICK_RATIO"), F.col("quick_ratio").cast("double"), none)])


def build_metrics(facts: DataFrame, info: DataFrame, as_of: dt.datetime) -> DataFrame:
    """All derived metrics with unit, version and fingerprint; null values stay out."""
    wide = metric_wide(facts)
    rows = union_statements([ratio_metrics(wide), growth_yoy(wide), info_metrics(info, facts)])
    return drop_null_values(rows, "metric_value").select(
        "instrument_id", "metric_code", "metric_value", F.lit("ratio").alias("metric_unit"), "as_of_date",
        F.col("quality_flag").alias("lookback_period"), F.lit(CALC_VERSION).alias("calc_version"),
        text.input_hash(instrument_id=F.col("instrument_id"), metric_code=F.col("metric_code"), metric_value=F.col("metric_value"),
                        metric_date=F.col("as_of_date"), quality_flag=F.col("quality_flag")).alias("input_hash"),
        F.lit(as_of).alias("created_at"),
    )


def fundamentals_pipeline(parsed: DataFrame, stored_facts: DataFrame, stored_metrics: DataFrame, info: DataFrame, as_of: dt.datetime) -> dict[str, DataFrame]:
    """Parsed statement rows to stored facts and metrics, with results and lineage.

    Metrics are recomputed over all stored annual facts, old and new.
    """
    valid, skipped = valid_fiscal_periods(parsed)
    incoming = drop_null_values(valid, "value")
    facts = merge.merge_statement_facts(stored_facts, incoming)
    fresh = build_metrics(facts.where("fiscal_period = 'FY'"), info, as_of)
    touched = incoming.select("instrument_id").distinct()
    fresh = fresh.join(touched, "instrument_id", "left_semi")
    metrics = merge.merge_metric_facts(stored_metrics, fresh)
    seen = parsed.groupBy("instrument_id").agg(F.count(F.lit(1)).alias("statements_seen"))
    valid_n = valid.groupBy("instrument_id").agg(F.count(F.lit(1)).alias("record_count_in"), F.count("value").alias("statements_stored"))
    metric_n = fresh.groupBy("instrument_id").agg(F.count(F.lit(1)).alias("metrics_computed"))
    results = (
        seen.join(valid_n, "instrument_id", "left").join(metric_n, "instrument_id", "left").na.fill(0)
        .withColumn("skipped", F.col("record_count_in") == 0)
        .withColumn("skip_reason", F.when(F.col("skipped"), "No annual periods with non-zero total_revenue"))
    )
    lineage = results.where("not skipped").select(
        "instrument_id", F.lit("fund_statement_fact+fund_metric_fact").alias("target_asset"), F.lit(TRANSFORM_ID).alias("transform_id"),
        "record_count_in", (F.col("statements_stored") + F.col("metrics_computed")).alias("record_count_out"), F.lit(as_of).alias("lineage_ts"))
    return {"facts": facts, "metrics": metrics, "results": results, "lineage": lineage, "skipped_periods": skipped}


# --- analyst views ------------------------------------------------------------------

_VIEW = {
    "Current Assets": "ca", "Current Liabilities": "cl", "Inventory": "inv", "Total Revenue": "rev", "Revenue": "rev2", "Cost Of Revenue": "cogs",
    "Accounts Receivable": "ar", "Accounts Payable": "ap", "Free Cash Flow": "fcf", "Operating Cash Flow": "cfo", "Capital Expenditure": "capex",
    "Net Income": "ni", "Gross Profit": "gp", "EBITDA": "ebitda", "Stockholders Equity": "eq", "Total Equity Gross Minority Interest": "eq2",
}


def quality_ratios(statements: DataFrame, info: DataFrame) -> DataFrame:
    """Liquidity, cycle, margin and return ratios from the newest value of each label.

    ``statements``: instrument_id, label, period, value.  A missing label counts as
    zero; revenue, free cash flow, EBITDA and equity have fall-back labels.
    """
    newest = [
        F.coalesce(F.max_by(F.when(F.col("label") == x, F.col("value").cast("double")), F.when((F.col("label") == x) & F.col("value").isNotNull(), F.col("period"))), F.lit(0.0)).alias(s)
        for x, s in _VIEW.items()
    ]
    w = statements.groupBy("instrument_id").agg(*newest).join(info.select("instrument_id", F.col("ebitda").cast("double").alias("_ie")), "instrument_id", "left")
    c = F.col

    def or_else(a: Column, b_: Column) -> Column:
        return F.when(a != 0, a).otherwise(b_)

    rev, cogs = or_else(c("rev"), c("rev2")), F.abs("cogs")
    eq = or_else(c("eq"), c("eq2"))
    ebitda = or_else(c("ebitda"), F.coalesce(c("_ie"), F.lit(0.0)))
    r = numeric.safe_ratio
    return w.select(
        "instrument_id", r(c("ca"), c("cl")).alias("current_ratio"), r(c("ca") - c("inv"), c("cl")).alias("quick_ratio"),
        or_else(c("fcf"), c("cfo") - F.abs("capex")).alias("fcff"), r(c("cfo"), c("ni")).alias("cfo_net_income"),
        r(c("ar") * 365, rev).alias("dso"), r(c("inv") * 365, cogs).alias("doh"), r(c("ap") * 365, cogs).alias("dpo"),
        r(c("gp"), rev).alias("gross_margin"), r(ebitda, rev).alias("ebitda_margin"), r(c("ni"), rev).alias("net_margin"), r(c("ni"), eq).alias("roe"),
    )


def cash_conversion_cycle(ratios: DataFrame) -> DataFrame:
    """Add ``ccc`` = DSO + DOH - DPO, null if any is null."""
    return ratios.withColumn("ccc", F.col("dso") + F.col("doh") - F.col("dpo"))


def margin_trends(statements: DataFrame, n: int = 8) -> DataFrame:
    """Four ratios for the newest n periods of each instrument (bounded by years).

    Per period the first label column that exists decides, so a null there is zero.
    """
    def first_label(*names: str) -> Column:
        has = [F.max(F.when(F.col("label") == x, F.struct(F.coalesce(F.col("value").cast("double"), F.lit(0.0)).alias("v")))) for x in names]
        return F.coalesce(F.coalesce(*has).getField("v"), F.lit(0.0))

    wide = statements.groupBy("instrument_id", "period").agg(
        first_label("Total Revenue", "Revenue").alias("rev"), first_label("Gross Profit").alias("gp"), first_label("EBITDA").alias("eb"),
        first_label("Net Income").alias("ni"), first_label("Stockholders Equity", "Total Equity Gross Minority Interest").alias("eq"))
    w = W.partitionBy("instrument_id").orderBy(F.desc("period"))
    r, c = numeric.safe_ratio, F.col
    return wide.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).select(
        "instrument_id", "period", r(c("gp"), c("rev")).alias("gross_margin"), r(c("eb"), c("rev")).alias("ebitda_margin"),
        r(c("ni"), c("rev")).alias("net_margin"), r(c("ni"), c("eq")).alias("roe"))


def ratio_labels(ratios: DataFrame) -> DataFrame:
    """Reading of the current ratio, earnings quality and return on equity."""
    def read(name: str, limit: float, good: str, bad: str) -> Column:
        return F.when(F.col(name) >= limit, good).when(F.col(name).isNotNull(), bad)

    return ratios.select(
        "instrument_id", read("current_ratio", 1.5, "Comfortable", "Watch list").alias("liquidity"),
        read("cfo_net_income", 1.0, "Healthy", "Fragile").alias("earnings_quality"), read("roe", 0.15, "Strong", "Average").alias("capital_efficiency"))
