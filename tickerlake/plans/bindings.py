"""Domain tables as projections of the given tables.

The given tables hold no prices or statements, so each domain table is derived
from them by key arithmetic; ``plans.sqlparts`` states the same rules in SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


#: Order lines whose bars one task sorts, about.
PART_ROWS = 250_000


def parts(spark: SparkSession, sf: str) -> int:
    """Tasks for all bars, so that a task's rows stay as many however many there are."""
    return max(8, -(-table(spark, sf, "lineitem").count() // PART_ROWS))


def scaled(units: str, places: int, precision: int = 18):
    """Integer units to a decimal with ``places`` digits, exact."""
    return F.expr(f"cast(cast({units} as decimal(18,0)) * cast('{10 ** -places:.{places}f}' as decimal({places + 1},{places})) as decimal({precision},{places}))")


# --- prices -------------------------------------------------------------------


def ticks(spark: SparkSession, sf: str) -> DataFrame:
    """One trade per order line: unit price in millionths of the currency."""
    return (
        table(spark, sf, "lineitem")
        .select(
            F.col("l_suppkey").alias("instrument_id"),
            F.col("l_shipdate").cast("date").alias("trade_date"),
            "l_orderkey", "l_linenumber", "l_returnflag",
            F.round(F.col("l_extendedprice") * 100).cast("long").alias("cents"),
            F.round(F.col("l_discount") * 100).cast("long").alias("disc"),
            F.col("l_quantity").cast("long").alias("qty"),
        )
        .withColumn("px_u", F.expr("(cents * 10000) div qty"))
    )


def bars(spark: SparkSession, sf: str) -> DataFrame:
    """Daily bars.  Open and close are the first and last trade by (order, line, price).

    The order is packed with the price into one decimal, so that min and max stay
    fixed-width hash aggregates.
    """
    pack = F.expr("cast(l_orderkey * 16 + l_linenumber as decimal(20,0)) * 10000000000000BD + cast(px_u as decimal(13,0))").cast("decimal(38,0)")
    agg = (
        ticks(spark, sf).withColumn("pack", pack).groupBy("instrument_id", "trade_date")
        .agg(F.min("pack").alias("first"), F.max("pack").alias("last"), F.max("px_u").alias("high_u"),
             F.min("px_u").alias("low_u"), F.sum("qty").alias("volume"))
        .withColumn("open_u", F.expr("cast(first % 10000000000000BD as bigint)"))
        .withColumn("close_u", F.expr("cast(last % 10000000000000BD as bigint)"))
    )
    return agg.select(
        "instrument_id", "trade_date",
        *[scaled(f"{c}_u", 6).alias(f"{c}_px") for c in ("open", "high", "low", "close")],
        "volume", F.when(F.col("instrument_id") % 2 == 0, "NSE_EOD").otherwise("BSE_EOD").alias("source_system"),
        F.expr("cast(trade_date as timestamp) + interval 12 hours").alias("ingested_at"),
    )


def actions(spark: SparkSession, sf: str) -> DataFrame:
    """Corporate actions from large returned first lines."""
    t = ticks(spark, sf).where("l_returnflag = 'R' and l_linenumber = 1 and qty >= 40")
    kind = F.expr("element_at(array('SPLIT','BONUS','DIVIDEND','RIGHTS','MERGER'), cast(l_orderkey % 5 as int) + 1)")
    ratio = F.col("l_orderkey") % 5
    return t.select(
        (F.col("l_orderkey") * 10000000 + F.col("cents") % 10000000).alias("corp_action_id"),
        "instrument_id", kind.alias("action_type"), F.col("trade_date").alias("ex_date"),
        F.when(ratio == 2, (F.col("disc") + 1) * 100).cast("decimal(20,8)").alias("action_value"),
        F.when(ratio.isin(0, 1, 3), F.when(F.col("l_orderkey") % 3 == 0, 0).otherwise(F.col("l_orderkey") % 3 + 1)).cast("decimal(20,8)").alias("action_ratio_num"),
        F.when(ratio.isin(0, 1, 3), F.lit(1)).cast("decimal(20,8)").alias("action_ratio_den"),
        F.when(F.col("instrument_id") % 2 == 0, " nse ").otherwise("BSE").alias("source_system"),
    )


# --- reference data of the price universe ----------------------------------------


def exchanges(spark: SparkSession, sf: str) -> DataFrame:
    """Three exchanges, the fixed dimension of the domain."""
    return table(spark, sf, "region").where("r_regionkey < 3").select(
        (F.col("r_regionkey") + 1).alias("exchange_id"),
        F.expr("element_at(array('NSE','BSE','BSE_SME'), r_regionkey + 1)").alias("exchange_code"),
    )


def _symbol_rule(k: str) -> str:
    return f"case when {k} % 13 = 0 then concat('DUP', cast({k} div 26 as string)) else concat('S', upper(substr(md5(cast({k} as string)), 1, 9))) end"


def instruments(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "supplier").selectExpr(
        "s_suppkey as instrument_id", "md5(concat('I', s_suppkey)) as instrument_uuid", "s_suppkey as company_id",
        "case when s_suppkey % 13 = 0 then 1 else s_nationkey % 3 + 1 end as exchange_id",
        f"{_symbol_rule('s_suppkey')} as symbol", "'EQUITY' as instrument_type",
        "case when s_suppkey % 5 = 2 then null else date_add(date'1995-01-01', cast(s_suppkey * 37 % 700 as int)) end as listing_date",
        "case when s_suppkey % 7 = 3 then date_add(date'2000-01-01', cast(s_suppkey % 365 as int)) end as delisting_date",
        "s_suppkey % 11 <> 5 as is_active",
    )


def companies(spark: SparkSession, sf: str) -> DataFrame:
    s, n, r = table(spark, sf, "supplier"), table(spark, sf, "nation"), table(spark, sf, "region")
    return s.join(n, s.s_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey).selectExpr(
        "s_suppkey as company_id", "md5(concat('C', s_suppkey)) as company_uuid", "s_name as legal_name",
        "case when s_suppkey % 9 = 4 then null else concat('IN', upper(substr(md5(concat('Q', s_suppkey div 2)), 1, 9)), s_suppkey div 2 % 10) end as isin_primary",
        "r_name as sector_code", "case when n_nationkey % 5 = 0 then null else n_name end as industry_code",
    )


def aliases(spark: SparkSession, sf: str) -> DataFrame:
    s = table(spark, sf, "supplier")
    old = s.selectExpr(
        "s_suppkey * 2 as alias_id", "s_suppkey as instrument_id", "case when s_suppkey % 2 = 0 then 'NSE' else 'BSE' end as source_system",
        "concat('O', upper(substr(md5(concat('A', s_suppkey)), 1, 8))) as alias_symbol",
        "date'1995-01-01' as valid_from", "date'1998-06-30' as valid_to",
    )
    new = s.selectExpr(
        "s_suppkey * 2 + 1", "s_suppkey", "'BSE'", "case when s_suppkey % 10 = 0 then concat('PAIR', s_suppkey div 20) else concat('N', upper(substr(md5(concat('B', s_suppkey)), 1, 8))) end",
        "date'1998-07-01'", "case when s_suppkey % 8 = 1 then date'2001-01-31' end",
    )
    return old.union(new)


def identifier_requests(spark: SparkSession, sf: str) -> DataFrame:
    """One identifier per order line, in eight spellings, on its ship date."""
    t = ticks(spark, sf)
    i = instruments(spark, sf).join(exchanges(spark, sf), "exchange_id").select("instrument_id", "symbol", "exchange_code", "company_id")
    c = companies(spark, sf).select("company_id", "isin_primary")
    a = aliases(spark, sf).where("alias_id % 2 = 0").select("instrument_id", F.col("alias_symbol").alias("old_name"))
    b = aliases(spark, sf).where("alias_id % 2 = 1").select("instrument_id", F.col("alias_symbol").alias("new_name"))
    names = i.join(c, "company_id").join(a, "instrument_id").join(b, "instrument_id").drop("company_id")
    return t.join(names, "instrument_id").selectExpr(
        """case l_orderkey % 8
             when 0 then coalesce(isin_primary, symbol)
             when 1 then concat(symbol, '.', case exchange_code when 'NSE' then 'ns' when 'BSE' then 'BO' else 'SME' end)
             when 2 then symbol
             when 3 then old_name
             when 4 then concat(substr(new_name, 1, length(new_name) - 1), 'Z')
             when 5 then concat('zz', old_name)
             when 6 then concat('?', symbol, symbol)
             else concat('  ', lower(symbol), ' ') end as identifier""",
        "case when l_orderkey % 16 = 2 then exchange_code end as exchange_mic",
        "trade_date as as_of",
        "exchange_code", "symbol", "old_name", "l_orderkey",
    )


def raw_feed(spark: SparkSession, sf: str, since: str = "1995-03-01") -> DataFrame:
    """Raw text rows of daily files, some of them damaged; older bars are stored already (``curated_bars``)."""
    b = bars(spark, sf).where(F.col("trade_date") >= F.lit(since).cast("date"))
    i = instruments(spark, sf).join(exchanges(spark, sf), "exchange_id").select("instrument_id", "symbol", "exchange_code")
    a = aliases(spark, sf).where("alias_id % 2 = 0").select("instrument_id", F.col("alias_symbol").alias("old_name"))
    rows = b.join(i, "instrument_id").join(a, "instrument_id").withColumn("k", F.expr("instrument_id * 31 + datediff(trade_date, date'1995-01-01')"))
    return rows.selectExpr(
        "case when k % 17 = 0 then concat('UNK', k) when k % 10 = 0 then lower(old_name) else symbol end as symbol",
        "exchange_code as exchange", "concat(lower(source_system), ' ') as source_system",
        "case when k % 6 = 0 then 'usd' else 'INR' end as currency_code",
        "cast(open_px as string) as open", "case when k % 103 = 0 then '0.01' else cast(high_px as string) end as high",
        "case when k % 97 = 0 then '99999999' else cast(low_px as string) end as low",
        "case when k % 101 = 0 then 'n/a' when k % 107 = 0 then '0' else cast(close_px as string) end as close",
        "cast(volume as string) as volume", "case when k % 3 = 0 then '' when k % 89 = 0 then 'x' else cast(volume * 2 as string) end as turnover",
        "case when k % 109 = 0 then '31/12/1999' else cast(trade_date as string) end as timestamp",
        "ingested_at as ingested_ts", "concat('f', instrument_id, ':', cast(trade_date as string)) as source_record_id",
    )


def curated_bars(spark: SparkSession, sf: str) -> DataFrame:
    """What is already stored when the raw feed arrives."""
    return bars(spark, sf).where("trade_date < date'1995-03-01'")


def fx_rates(spark: SparkSession, sf: str) -> DataFrame:
    return ticks(spark, sf).select("trade_date").distinct().where("day(trade_date) <> 13").selectExpr(
        "'USD' as currency_code", "trade_date", "cast(80 + month(trade_date) as decimal(18,6)) as rate"
    )


# --- market-wide and monthly series -----------------------------------------------


def monthly(spark: SparkSession, sf: str) -> DataFrame:
    """Average unit price per instrument and month, in millionths."""
    return (
        ticks(spark, sf).withColumn("date", F.trunc("trade_date", "month"))
        .groupBy("instrument_id", "date").agg(F.sum("px_u").alias("s"), F.count(F.lit(1)).alias("n"), F.sum("qty").alias("volume"))
        .select("instrument_id", "date", F.expr("s div n").cast("double").alias("close"), "volume")
    )


def market(spark: SparkSession, sf: str) -> DataFrame:
    """The same series over all instruments."""
    return (
        ticks(spark, sf).withColumn("date", F.trunc("trade_date", "month"))
        .groupBy("date").agg(F.sum("px_u").alias("s"), F.count(F.lit(1)).alias("n"))
        .select("date", F.expr("s div n").cast("double").alias("close"))
    )


# --- fundamentals and the valuation universe (customers) -----------------------------

# line item -> (id, statement, expression in cents over one customer's orders of a year)
LINES = {
    "TOTAL_REVENUE": (1, "PL", "case when (instrument_id + fiscal_year) % 19 = 0 then null when (instrument_id + fiscal_year) % 23 = 0 then 0 else rev end"),
    "GROSS_PROFIT": (2, "PL", "gp"),
    "EBITDA": (3, "PL", "p123"),
    "EBIT": (4, "PL", "p12"),
    "NET_INCOME": (5, "PL", "p1 - coalesce(p5, 0) div 2"),
    "TOTAL_EQUITY": (6, "BS", "bal * (fiscal_year - 1990) * 10"),
    "TOTAL_DEBT": (7, "BS", "p5"),
    "CASH": (8, "BS", "coalesce(gp, 0) div 20"),
    "SHARES_OUTSTANDING": (9, "BS", "case when instrument_id % 10 <> 7 then (1000 + instrument_id % 500) * 100 end"),
    "CAPEX": (10, "CF", "p4 div 10"),
    "FREE_CASH_FLOW": (11, "CF", "p2 - p3"),
    "DEPRECIATION": (12, "CF", "p3 div 4"),
}


def yearly(spark: SparkSession, sf: str) -> DataFrame:
    """Order sums in cents per customer and year, by status and priority."""
    o = table(spark, sf, "orders").select(
        F.col("o_custkey").alias("instrument_id"), F.year("o_orderdate").alias("fiscal_year"), F.round(F.col("o_totalprice") * 100).cast("long").alias("c"),
        "o_orderstatus", F.substring("o_orderpriority", 1, 1).cast("int").alias("p"))

    def cents(cond: str):
        return F.expr(f"sum(case when {cond} then c end)")

    y = o.groupBy("instrument_id", "fiscal_year").agg(
        F.sum("c").alias("rev"), cents("o_orderstatus <> 'P'").alias("gp"), cents("p <= 3").alias("p123"), cents("p <= 2").alias("p12"),
        *[cents(f"p = {k}").alias(f"p{k}") for k in range(1, 6)])
    cust = table(spark, sf, "customer").select(F.col("c_custkey").alias("instrument_id"), F.round(F.col("c_acctbal") * 100).cast("long").alias("bal"))
    return y.join(cust, "instrument_id")


def parsed_facts(spark: SparkSession, sf: str) -> DataFrame:
    """Statement facts as parsed: null values and revenue-less periods included."""
    items = ", ".join(f"struct('{k}' as line_item_code, '{st}' as statement_type, cast({e} as bigint) as cents, {i} as line_no)" for k, (i, st, e) in LINES.items())
    rows = yearly(spark, sf).select("instrument_id", "fiscal_year", F.expr(f"explode(array({items})) as i")).select("instrument_id", "fiscal_year", "i.*")
    return rows.select(
        ((F.col("instrument_id") * 100 + F.col("fiscal_year") - 1990) * 20 + F.col("line_no")).alias("statement_fact_id"),
        "instrument_id", "fiscal_year", F.lit("FY").alias("fiscal_period"), "statement_type", "line_item_code",
        scaled("cents", 2, 24).cast("decimal(24,4)").alias("value"), F.make_date("fiscal_year", F.lit(12), F.lit(31)).cast("timestamp").alias("as_reported_ts"),
        F.expr("cast(make_date(fiscal_year + 1, 2, 1) as timestamp)").alias("ingested_at"))


def facts(spark: SparkSession, sf: str) -> DataFrame:
    """Stored facts: those with a value."""
    return parsed_facts(spark, sf).where("value is not null")


def info(spark: SparkSession, sf: str) -> DataFrame:
    """Company profile figures from the customer row."""
    return table(spark, sf, "customer").selectExpr(
        "c_custkey as instrument_id", "cast(case when c_custkey % 11 <> 0 then c_custkey % 30 / 10.0 end as double) as current_ratio",
        "cast(c_custkey % 20 / 10.0 as double) as quick_ratio", "cast((c_custkey % 1000 + 1) * 1000 as double) as market_cap",
        "cast(c_custkey % 4 * 10 as double) as current_price", "cast(c_custkey % 3 * 7 as double) as regular_market_price", "cast(c_custkey % 5 as double) as previous_close",
        "cast(c_custkey % 6 * 1.5 as double) as trailing_eps", "cast(c_custkey % 9 * 100 as double) as ebitda", "cast(c_custkey % 7 * 3 as double) as book_value",
        "cast(case when c_custkey % 8 <> 0 then c_custkey % 50 * 1000 end as double) as total_revenue", "cast((c_custkey % 100 + 3) * 900 as double) as enterprise_value",
        "cast(c_custkey % 5 * 4 as double) as trailing_pe", "cast(case when c_custkey % 3 = 0 then 0.2 end as double) as profit_margins", "cast(c_custkey % 4 * 0.5 as double) as price_to_sales",
        "cast(case when c_custkey % 6 = 0 then c_custkey % 40 * 10 end as double) as depreciation_amortization", "cast(-(c_custkey % 12 * 25) as double) as capital_expenditure",
        "cast(case when c_custkey % 2 = 0 then 0.3 end as double) as effective_tax_rate", "cast(c_custkey % 90 * 50 as double) as total_debt", "cast(c_custkey % 70 * 20 as double) as total_cash",
        "cast(c_custkey % 500 as double) as shares_outstanding",
        "cast(0.10 as double) as wacc", "cast(case when c_custkey % 13 = 0 then 0.12 else 0.03 end as double) as terminal_growth", "5 as forecast_years", "cast(0.08 as double) as revenue_cagr", "cast(0.18 as double) as ebit_margin")


def value_instruments(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").selectExpr(
        "c_custkey as instrument_id", "md5(concat('V', c_custkey)) as instrument_uuid", "c_custkey as company_id", "c_nationkey % 3 + 1 as exchange_id", "concat('C', c_custkey) as symbol",
        "case when c_custkey % 4 <> 1 then date_add(date'1995-01-01', cast(c_custkey % 900 as int)) end as listing_date",
        "case when c_custkey % 29 = 4 then date'1999-06-30' end as delisting_date", "c_custkey % 17 <> 3 as is_active")


def value_companies(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").selectExpr(
        "c_custkey as company_id", "case when c_custkey % 37 <> 0 then c_mktsegment end as sector_code",
        "case when c_custkey % 37 <> 0 and c_nationkey % 5 <> 0 then concat(c_mktsegment, '_', c_nationkey) end as industry_code")


METRIC_RULES = {
    "EBITDA": "ebitda", "EARNINGS": "ni", "BOOK_VALUE": "eq", "SALES": "rev", "NET_DEBT": "debt - cash",
    "EQUITY_VALUE": "rev * (1 + instrument_id % 5)", "ENTERPRISE_VALUE": "rev * (1 + instrument_id % 5) + debt - cash", "SHARE_COUNT": "sh",
}


def metrics(spark: SparkSession, sf: str) -> DataFrame:
    """Long metric facts at each year end."""
    f = parsed_facts(spark, sf)
    names = {"EBITDA": "ebitda", "NET_INCOME": "ni", "TOTAL_EQUITY": "eq", "TOTAL_REVENUE": "rev", "TOTAL_DEBT": "debt", "CASH": "cash"}
    w = f.groupBy("instrument_id", "fiscal_year").agg(*[F.max(F.when(F.col("line_item_code") == k, F.col("value").cast("decimal(18,2)"))).alias(v) for k, v in names.items()])
    w = w.withColumn("sh", F.expr("cast(1000 + instrument_id % 500 as decimal(18,2))")).withColumn("debt", F.coalesce("debt", F.lit(0).cast("decimal(18,2)")))
    items = ", ".join(f"struct('{k}' as metric_code, cast({e} as decimal(24,8)) as metric_value, {i} as n)" for i, (k, e) in enumerate(METRIC_RULES.items()))
    return w.select("instrument_id", "fiscal_year", F.expr(f"explode(array({items})) as m")).select(
        F.expr("(instrument_id * 100 + fiscal_year - 1990) * 20 + m.n").alias("metric_fact_id"), "instrument_id", "m.metric_code", "m.metric_value",
        F.make_date("fiscal_year", F.lit(12), F.lit(31)).alias("as_of_date")).where("metric_value is not null")


def requests(spark: SparkSession, sf: str) -> DataFrame:
    """One valuation request per customer, with assumptions by key arithmetic."""
    return table(spark, sf, "customer").selectExpr(
        "c_custkey + 1 as val_run_id", "c_custkey as instrument_id", "cast(0.09 + c_custkey % 5 * 0.01 as double) as wacc",
        "cast(case when c_custkey % 41 = 0 then 0.2 else 0.03 + c_custkey % 3 * 0.005 end as double) as terminal_growth", "cast(3 + c_custkey % 5 as int) as forecast_years",
        "cast(0.02 + c_custkey % 7 * 0.01 as double) as revenue_cagr", "cast(0.1 + c_custkey % 4 * 0.05 as double) as ebit_margin",
        "case when c_custkey % 43 = 0 then array(1000D, 2000D) end as capex_schedule")


def statements(spark: SparkSession, sf: str) -> DataFrame:
    """Long analyst statements: label, period, value."""
    o = table(spark, sf, "orders")
    label = F.expr("""element_at(array('Current Assets','Current Liabilities','Inventory','Total Revenue','Revenue','Cost Of Revenue','Accounts Receivable','Accounts Payable',
        'Free Cash Flow','Operating Cash Flow','Capital Expenditure','Net Income','Gross Profit','EBITDA','Stockholders Equity','Total Equity Gross Minority Interest'), cast(o_orderkey % 16 as int) + 1)""")
    return o.groupBy(F.col("o_custkey").alias("instrument_id"), label.alias("label"), F.trunc("o_orderdate", "year").alias("period")).agg(
        F.sum(F.round(F.col("o_totalprice") * 100).cast("long")).alias("c")).selectExpr(
        "instrument_id", "label", "period", "case when c % 10 <> 0 then cast(case when label like 'C%' and instrument_id % 3 = 0 then -c else c end as double) end as value")


def wide_income(spark: SparkSession, sf: str) -> DataFrame:
    """Income statement as delivered: label rows, one column per period end."""
    o = table(spark, sf, "orders")
    label = F.expr("element_at(array('Total Revenue','Operating Revenue','Gross Profit','Net Income','Capital Expenditure'), cast(substr(o_orderpriority, 1, 1) as int))")
    first, last = o.agg(F.min(F.year("o_orderdate")), F.max(F.year("o_orderdate"))).head()
    years = [f"{y}-12-31" for y in range(first, last + 1)]  # columns of the frame: those that the orders have
    signed = F.round(F.col("o_totalprice") * 100).cast("long") * F.when(label == "Capital Expenditure", -1).otherwise(1)
    rows = o.select(F.col("o_custkey").alias("instrument_id"), label.alias("label"), F.concat(F.year("o_orderdate").cast("string"), F.lit("-12-31")).alias("y"), signed.alias("v"))
    return rows.groupBy("instrument_id", "label").pivot("y", years).agg(F.sum("v"))


# --- quality, compliance and operations ------------------------------------------------


def feed(spark: SparkSession, sf: str) -> DataFrame:
    """Records for the quality gate, some of them damaged."""
    e = table(spark, sf, "events").select("event_id", "user_id", "event_type", F.col("ts").cast("timestamp").alias("ts"), F.round(F.col("value") * 100).cast("long").alias("c"))
    e = e.withColumn("hi", F.col("c") + 100).withColumn("lo", F.expr("c div 2")).withColumn("cl", F.expr("case when event_id % 211 = 0 then 200000000 else c end"))
    return e.select(
        "event_id", F.expr("case when event_id % 97 <> 0 then user_id end").alias("instrument_id"), F.expr("case when event_id % 194 <> 0 then concat('U', user_id) end").alias("symbol"),
        F.col("ts").cast("date").alias("trade_date"), F.upper("event_type").alias("source_system"),
        F.when(F.col("event_id") % 53 != 0, scaled("c", 2)).cast("decimal(18,6)").alias("open_px"), scaled("hi", 2).cast("decimal(18,6)").alias("high_px"),
        scaled("lo", 2).cast("decimal(18,6)").alias("low_px"), scaled("cl", 2).cast("decimal(18,6)").alias("close_px"), F.expr("case when event_id % 31 <> 0 then ts end").alias("event_ts"))


def feed_curated(spark: SparkSession, sf: str) -> DataFrame:
    """Stored closes: the last view event of each user and day."""
    v = table(spark, sf, "events").where("event_type = 'view'").select("event_id", F.col("user_id").alias("instrument_id"), F.col("ts").cast("date").alias("trade_date"), F.round(F.col("value") * 100).cast("long").alias("c"))
    return v.groupBy("instrument_id", "trade_date").agg(F.max_by("c", "event_id").alias("c")).select(
        "instrument_id", "trade_date", F.lit("VIEW").alias("source_system"), scaled("c", 2).cast("decimal(18,6)").alias("close_px"))


def policies(spark: SparkSession, sf: str) -> DataFrame:
    """Usage policy per document source; one source has none."""
    n = "cast(substr(source, 4) as int)"
    return table(spark, sf, "documents").select("source").distinct().where("source <> 'src19'").selectExpr(
        "source as source_name", f"{n} % 3 <> 0 as redistribution_allowed", f"{n} % 4 <> 1 as commercial_use", f"{n} % 2 = 0 as attribution_required")


def policy_requests(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").selectExpr(
        "doc_id", "doc_id div 3 as request_id", "concat(' ', upper(source)) as source_name", "doc_id % 2 = 0 as external_call", "lang = 'en' as derived_output",
        "case when doc_id % 7 < 3 then 'given' when doc_id % 7 = 3 then '' end as attribution", "doc_id % 5 = 0 as commercial_context", "doc_id % 11 as user_id", "case when doc_id % 4 = 0 then concat('r', doc_id) end as resource_id")


def job_events(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select(
        F.col("event_id").alias("job_event_id"), F.expr("user_id * 100 + day(ts)").alias("pipeline_run_id"),
        F.expr("case event_type when 'view' then 'START' when 'click' then 'RETRY' when 'error' then 'FAILED' when 'signup' then 'WARN' else 'END' end").alias("event_type"),
        F.col("ts").cast("timestamp").alias("event_ts"), F.concat(F.lit("m"), "event_id").alias("message"),
        F.expr("concat('{\"attempt\":3,\"retryable\":', case when event_id % 2 = 0 then 'true' else 'false' end, '}')").alias("metrics_payload"))


def pipeline_run_rows(spark: SparkSession, sf: str) -> DataFrame:
    """One run per user and day."""
    e = job_events(spark, sf)
    return e.groupBy("pipeline_run_id").agg(
        F.min("event_ts").alias("started_at"), F.max("event_ts").alias("last_ts"), F.max_by("event_type", "job_event_id").alias("last_type"), F.count(F.lit(1)).alias("row_count_in"),
    ).select("pipeline_run_id", F.expr("case when pipeline_run_id div 100 % 2 = 0 then 'nse_eod_ingest' else 'bse_eod_ingest' end").alias("pipeline_name"),
             F.expr("case when pipeline_run_id % 13 = 0 then 'RUNNING' when last_type = 'FAILED' then 'FAILED' else 'SUCCESS' end").alias("status"), "started_at",
             F.expr("case when pipeline_run_id % 13 <> 0 then last_ts end").alias("ended_at"), "row_count_in")


def breaches(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").where("event_type = 'error' and value > 100").selectExpr("user_id * 100 + day(ts) as pipeline_run_id", "'RAW_WRITE_BY_20_00_IST' as sla_type")


def source_runs(spark: SparkSession, sf: str) -> DataFrame:
    """One run per source and day; confirmed by its last early purchase, if any."""
    e = table(spark, sf, "events").selectExpr("case when user_id % 2 = 0 then 'nse_eod_ingest' else 'bse_eod_ingest' end as pipeline_name", "user_id % 2 as par", "cast(ts as date) as trade_date", "cast(ts as timestamp) as ts", "event_type", "event_id")
    return e.groupBy("pipeline_name", "trade_date").agg((F.max("par") + F.dayofmonth(F.max("trade_date")) * 2).alias("pipeline_run_id"),
        F.max(F.expr("case when event_type = 'purchase' and (day(trade_date) % 3 <> 0 or hour(ts) < 14) then ts end")).alias("confirmed_at"))


def incident_results(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").selectExpr(
        "event_id as dq_result_id", "event_id % 6 + 1 as dq_rule_id", "'market_ohlcv_1d' as target_table",
        # an instrument is a part of the key, stands inside one, or beside another
        """case when event_id % 9 = 0 then '' when event_id % 5 = 1 then concat('px-', md5(concat('I', user_id)), 'Z', cast(cast(ts as date) as string))
          when event_id % 7 = 2 then concat('pair', md5(concat('I', user_id)), md5(concat('I', user_id + 1))) else concat('px:', md5(concat('I', user_id)), ':', cast(cast(ts as date) as string)) end as target_record_key""",
        "concat('why', event_id % 4) as failure_reason")


def incidents(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").where("event_type = 'error'").selectExpr(
        "event_id + 1000000 as dq_incident_id", "event_id as dq_result_id", "element_at(array('OPEN','IN_PROGRESS','RESOLVED'), cast(event_id % 3 as int) + 1) as incident_status",
        "element_at(array('MEDIUM','HIGH'), cast(event_id % 2 as int) + 1) as impact_level", "cast(ts as timestamp) as opened_at", "cast(null as timestamp) as resolved_at", "cast(null as string) as resolution_notes")


def rules(spark: SparkSession, sf: str) -> DataFrame:
    """Rule rows, numbered by the five regions and one more."""
    r = table(spark, sf, "region").selectExpr("r_regionkey + 1 as dq_rule_id").union(table(spark, sf, "region").selectExpr("max(r_regionkey) + 2"))
    return r.selectExpr("dq_rule_id", "concat('RULE_', dq_rule_id) as rule_code", "element_at(array('HIGH','CRITICAL','MEDIUM'), dq_rule_id % 3 + 1) as severity", "case when dq_rule_id % 2 = 0 then 'MARKET' else 'NEWS' end as domain_name")


# --- stored valuations -------------------------------------------------------------------


def val_runs(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").selectExpr(
        "o_orderkey + 1 as val_run_id", "md5(concat('R', o_orderkey)) as run_uuid", "o_custkey as instrument_id", "cast(o_orderdate as timestamp) as as_of_ts",
        "case o_orderstatus when 'F' then 'SUCCESS' when 'O' then 'OVERRIDDEN' else case when o_orderkey % 2 = 0 then 'RUNNING' else 'QUEUED' end end as status", "cast(o_orderdate as timestamp) as created_at")


def val_outputs(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").selectExpr("o_orderkey", "o_orderstatus", "cast(round(o_totalprice * 100) as bigint) as c",
        "explode(array(struct(0 as k, 'DCF' as m), struct(1 as k, 'RELATIVE' as m), struct(2 as k, 'BLENDED' as m))) as x")
    return o.where("not (o_orderkey % 10 = 0 and x.k = 2)").selectExpr("(o_orderkey + 1) * 3 + x.k as model_output_id", "o_orderkey + 1 as val_run_id", "x.m as model_name",
        "case when not (o_orderstatus = 'P' and x.k = 1) then cast(c div (x.k + 1) as double) end as target_price", "cast(c as double) as equity_value", "cast(c + 5 as double) as enterprise_value")


def val_confidence(spark: SparkSession, sf: str) -> DataFrame:
    a = table(spark, sf, "orders").where("o_orderkey % 9 <> 0").selectExpr("o_orderkey * 2 as confidence_id", "o_orderkey + 1 as val_run_id", "cast(o_orderkey % 100 as double) as overall_confidence", "cast(o_orderdate as timestamp) as created_at")
    c = table(spark, sf, "orders").where("o_orderkey % 4 = 0").selectExpr("o_orderkey * 2 + 1", "o_orderkey + 1", "cast(o_orderkey % 77 as double)", "cast(o_orderdate as timestamp) + interval 1 day")
    return a.union(c)


def val_labels(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    a = o.where("o_orderkey % 3 <> 0").selectExpr("o_orderkey + 1 as val_run_id", "'RUN_LABEL' as assumption_key", "cast(null as double) as assumption_value_numeric", "o_orderpriority as assumption_value_text")
    return a.union(o.selectExpr("o_orderkey + 1", "'wacc'", "cast(o_orderkey % 7 as double)", "cast(null as string)"))


def val_attributions(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").selectExpr(
        "(l_orderkey * 16 + l_linenumber) * 100000000 + cast(round(l_extendedprice * 100) as bigint) % 100000000 as attribution_id", "l_orderkey + 1 as val_run_id", "concat('T', l_returnflag) as driver_type",
        "concat('YEAR_', l_linenumber) as driver_key", "cast(round(l_extendedprice * 100) as bigint) as impact_value_abs", "case when l_linestatus = 'F' then 'UP' else 'DOWN' end as direction")


def val_sensitivities(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").selectExpr("(l_orderkey + 1) * 3 as model_output_id", "case when l_linestatus = 'F' then 'wacc' else 'terminal_growth' end as assumption_key",
        "concat('S', l_linenumber) as shock_label", "cast(l_quantity as bigint) as shock_value", "cast(round(l_extendedprice * 100) as bigint) as result_target_price")
