"""Valuation of whole universes: DCF, peer multiples, blend, confidence, outputs.

Money math is in double (relative tolerance 1e-9); stored columns are rounded to
their scale.  Yearly lines live in an array of the row, so a DCF needs no shuffle.
Peer statistics come from order statistics per peer group with the target taken
out, so no (target, peer) pair is ever formed.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickerlake import session
from tickerlake.functions import dates, numeric, text
from tickerlake.operators import orderstats, timejoin

# --- fixed values -----------------------------------------------------------
DCF_KEYS = {"wacc": "RATIO", "terminal_growth": "RATIO", "forecast_years": "YEARS", "revenue_cagr": "RATIO", "ebit_margin": "RATIO"}
MULTIPLES = {
    "EV/EBITDA": ("enterprise_value", "ebitda"),
    "P/E": ("equity_value", "earnings"),
    "P/B": ("equity_value", "book_value"),
    "EV/Sales": ("enterprise_value", "sales"),
}
PEER_METRICS = {
    "enterprise_value": "ENTERPRISE_VALUE",
    "equity_value": "EQUITY_VALUE",
    "ebitda": "EBITDA",
    "earnings": "EARNINGS",
    "book_value": "BOOK_VALUE",
    "sales": "SALES",
    "net_debt": "NET_DEBT",
    "share_count": "SHARE_COUNT",
}
MIN_PEERS = 3
TAX_RATE = 0.25
DEFAULT_STABILITY = 75.0
PLACEHOLDER = {"revenue_base": 1e9, "share_count": 1e8, "net_debt": 2e8, "da": 4e7, "capex": 5.5e7, "nwc": 0.0}
MODEL_VERSION, CONFIDENCE_VERSION = "v1", "v1"
# ----------------------------------------------------------------------------


def d(name: str) -> Column:
    return F.col(name).cast("double")


# --- as-of inputs --------------------------------------------------------------------


def asof_metric(metrics: DataFrame, codes: dict[str, str], as_of: dt.date) -> DataFrame:
    """Latest value of each metric code at the date (inclusive; ties by highest id),
    one column per code; ``missing_metric`` names the first absent one."""
    cols = []
    for name, code in codes.items():
        mine = F.col("metric_code") == code
        cols.append(F.max_by(F.when(mine, d("metric_value")), F.when(mine, F.col("_o"))).alias(name))
    known = metrics.where(F.col("as_of_date") <= F.lit(as_of)).where(F.col("metric_code").isin(list(codes.values())))
    wide = known.withColumn("_o", timejoin.packed(F.unix_date("as_of_date"), F.col("metric_fact_id"))).groupBy("instrument_id").agg(*cols)
    return wide.withColumn("missing_metric", F.coalesce(*[F.when(F.col(n).isNull(), code) for n, code in codes.items()]))


def asof_statement_period(facts: DataFrame, as_of: dt.date, codes: list[str]) -> DataFrame:
    """Line items of the latest annual period reported by the end of the day."""
    end = F.lit(dt.datetime.combine(as_of, dt.time.max))
    annual = facts.where((F.col("fiscal_period") == "FY") & (F.col("as_reported_ts") <= end))
    # one map-side combined pass: newest period per instrument by (time, id)
    per = annual.groupBy("instrument_id", "as_reported_ts").agg(
        *[F.max_by(F.when(F.col("line_item_code") == c, d("value")), F.when(F.col("line_item_code") == c, F.col("statement_fact_id"))).alias(c) for c in codes])
    newest = [F.max_by(c, "as_reported_ts").alias(c) for c in codes]
    return per.groupBy("instrument_id").agg(F.max("as_reported_ts").alias("period_ts"), *newest)


def asof_latest_revenue(facts: DataFrame, as_of: dt.date) -> DataFrame:
    """Latest older-code revenue fact by the end of the day; ties by highest id."""
    end = F.lit(dt.datetime.combine(as_of, dt.time.max))
    return facts.where((F.col("line_item_code") == "Revenue") & (F.col("as_reported_ts") <= end)).groupBy("instrument_id").agg(
        F.max_by("value", timejoin.packed(F.unix_micros("as_reported_ts"), F.col("statement_fact_id"))).alias("revenue"))


def build_projection_input(facts: DataFrame, as_of: dt.date) -> DataFrame:
    """Projection base of each instrument; rows lacking any input are left out."""
    w = asof_statement_period(facts, as_of, ["TOTAL_REVENUE", "Revenue", "DEPRECIATION", "CAPEX", "TOTAL_DEBT", "CASH", "SHARES_OUTSTANDING"])
    out = w.select(
        "instrument_id", F.coalesce("TOTAL_REVENUE", "Revenue").alias("revenue_base"), F.lit(TAX_RATE).alias("tax_rate"),
        F.col("SHARES_OUTSTANDING").alias("share_count"), (F.col("TOTAL_DEBT") - F.col("CASH")).alias("net_debt"),
        F.col("DEPRECIATION").alias("da"), F.col("CAPEX").alias("capex"), F.lit(0.0).alias("nwc"))
    return out.where("revenue_base is not null and net_debt is not null and da is not null and capex is not null and share_count > 0")


def projection_with_fallback(inputs: DataFrame, requests: DataFrame, allow_placeholder: bool = False) -> DataFrame:
    """Requests with schedules: given ones first, else flat ones from the facts.

    ``requests`` has the five assumptions and optional arrays da_schedule,
    capex_schedule, nwc_schedule.  Without facts a row has ``input_source`` null,
    or the fixed placeholder set when that is allowed.
    """
    base = requests.join(inputs.withColumn("_facts", F.lit(True)), "instrument_id", "left")
    found = F.col("_facts").isNotNull()
    if allow_placeholder:
        base = base.withColumns({k: F.when(found, F.col(k)).otherwise(F.lit(v)) for k, v in PLACEHOLDER.items()})
        base = base.withColumn("tax_rate", F.coalesce("tax_rate", F.lit(TAX_RATE)))
    n = F.col("forecast_years").cast("int")

    def schedule(name: str) -> Column:
        flat = F.array_repeat(F.col(name), n)
        return F.coalesce(F.col(f"{name}_schedule"), flat) if f"{name}_schedule" in requests.columns else flat

    source = F.when(found, "FACTS").when(F.lit(allow_placeholder), "FALLBACK")
    return base.withColumns({f"{k}_plan": schedule(k) for k in ("da", "capex", "nwc")}).withColumn("input_source", source).drop("_facts")


# --- DCF -----------------------------------------------------------------------------


def dcf_input_errors() -> Column:
    """First reason why a row cannot be valued, else null."""
    n = F.col("forecast_years").cast("int")
    return F.coalesce(
        F.when(d("wacc") <= d("terminal_growth"), "WACC must be greater than terminal growth for Gordon Growth Model"),
        F.when(F.size("da_plan") != n, "D&A schedule length must match forecast_years"),
        F.when(F.size("capex_plan") != n, "Capex schedule length must match forecast_years"),
        F.when(F.size("nwc_plan") != n, "Delta NWC schedule length must match forecast_years"),
        F.when(d("share_count") <= 0, "share_count must be positive"),
    )


def _lines() -> Column:
    """Array of yearly lines of the row."""
    one = F.lit(1.0)

    def line(t: Column) -> Column:
        rev = d("revenue_base") * F.pow(one + d("revenue_cagr"), t.cast("double"))
        ebit = rev * d("ebit_margin")
        nopat = ebit * (one - d("tax_rate"))
        da, capex, nwc = (F.element_at(F.col(f"{k}_plan"), t).cast("double") for k in ("da", "capex", "nwc"))
        fcf = nopat + da - capex - nwc
        df = F.pow(one + d("wacc"), t.cast("double"))
        return F.struct(t.alias("year_index"), rev.alias("revenue"), ebit.alias("ebit"), nopat.alias("nopat"), da.alias("depreciation_and_amortization"),
                        capex.alias("capex"), nwc.alias("delta_nwc"), fcf.alias("free_cash_flow"), df.alias("discount_factor"), (fcf / df).alias("present_value"))

    return F.transform(F.sequence(F.lit(1), F.col("forecast_years").cast("int")), line)


def dcf_project(rows: DataFrame) -> DataFrame:
    """Add ``error`` and ``lines`` (null where there is an error or no input)."""
    rows = rows.withColumn("error", dcf_input_errors())
    usable = F.col("error").isNull() & F.col("revenue_base").isNotNull()
    return rows.withColumn("lines", F.when(usable, _lines()))


def dcf_projection(rows: DataFrame) -> DataFrame:
    """One row per instrument and forecast year."""
    return dcf_project(rows).select("instrument_id", F.explode("lines").alias("_l")).select("instrument_id", "_l.*")


def present_value_sum() -> Column:
    return F.aggregate("lines", F.lit(0.0), lambda a, x: a + x.present_value)


def terminal_value(fcf: Column, wacc: Column, growth: Column) -> Column:
    """Gordon growth value after the last year; null unless wacc exceeds growth."""
    return F.when(wacc > growth, fcf * (F.lit(1.0) + growth) / (wacc - growth))


def dcf_value(rows: DataFrame) -> DataFrame:
    """Add terminal value, enterprise and equity value and value per share."""
    p = rows if "lines" in rows.columns else dcf_project(rows)
    last = F.try_element_at("lines", F.lit(-1))
    p = p.withColumn("terminal_value", terminal_value(last.free_cash_flow, d("wacc"), d("terminal_growth")))
    p = p.withColumn("terminal_present_value", F.col("terminal_value") / F.pow(1.0 + d("wacc"), d("forecast_years")))
    p = p.withColumn("enterprise_value_dcf", present_value_sum() + F.col("terminal_present_value"))
    p = p.withColumn("equity_value_dcf", F.col("enterprise_value_dcf") - d("net_debt"))
    return p.withColumn("dcf_price", numeric.safe_ratio(F.col("equity_value_dcf"), d("share_count")))


# --- peers ---------------------------------------------------------------------------


def peer_group(instruments: DataFrame, companies: DataFrame, as_of: dt.date) -> DataFrame:
    """Each instrument with its peer group key and whether it counts as a peer.

    The group is the industry, or the sector where the industry is null; a null key
    means no peers.  ``is_peer``: active and listed on the date.
    """
    day = F.lit(as_of)
    listed = (dates.open_start(F.col("listing_date")) <= day) & (dates.open_end(F.col("delisting_date")) >= day)
    kind = F.when(F.col("industry_code").isNotNull(), "INDUSTRY").when(F.col("sector_code").isNotNull(), "SECTOR")
    return instruments.join(companies.select("company_id", "sector_code", "industry_code"), "company_id").select(
        "instrument_id", "sector_code", "industry_code", kind.alias("group_kind"),
        F.coalesce("industry_code", "sector_code").alias("group_key"), (F.col("is_active") & listed).alias("is_peer"))


def group_members(groups: DataFrame) -> DataFrame:
    """Peers under every key they can be found by: their industry and their sector."""
    keys = F.array(
        F.struct(F.lit("INDUSTRY").alias("group_kind"), F.col("industry_code").alias("group_key")),
        F.struct(F.lit("SECTOR").alias("group_kind"), F.col("sector_code").alias("group_key")))
    rest = [c for c in groups.columns if c not in ("group_kind", "group_key", "sector_code", "industry_code", "is_peer")]
    return groups.where("is_peer").select(*rest, F.explode(keys).alias("_k")).select(*rest, "_k.*").where("group_key is not null")


def peer_map(instruments: DataFrame, companies: DataFrame, as_of: dt.date) -> DataFrame:
    """Target -> peer group with its peer count, without spelling out the pairs.

    The peers of a target are ``group_members`` of its key except itself; use
    ``peers_of`` for the few targets one asks about.
    """
    g = peer_group(instruments, companies, as_of)
    sizes = group_members(g).groupBy("group_kind", "group_key").agg(F.count(F.lit(1)).alias("_n"))
    return g.join(sizes, ["group_kind", "group_key"], "left").select(
        "instrument_id", "group_kind", "group_key",
        (F.coalesce("_n", F.lit(0)) - F.when(F.col("is_peer") & F.col("group_key").isNotNull(), 1).otherwise(0)).alias("peer_count"))


def peers_of(target: int, instruments: DataFrame, companies: DataFrame, as_of: dt.date) -> DataFrame:
    """Peers of one target, ordered by id."""
    g = peer_group(instruments, companies, as_of)
    mine = g.where(F.col("instrument_id") == target).select("group_kind", "group_key")
    return group_members(g).join(mine, ["group_kind", "group_key"], "left_semi").where(F.col("instrument_id") != target).select("instrument_id").orderBy("instrument_id")


def peer_multiples(metrics: DataFrame, multiples: list[str] | None = None) -> DataFrame:
    """instrument_id, multiple_name, multiple: null where the denominator is not positive."""
    items = [
        F.struct(F.lit(m).alias("multiple_name"), F.when(F.col(MULTIPLES[m][1]) > 0, F.col(MULTIPLES[m][0]) / F.col(MULTIPLES[m][1])).alias("multiple"))
        for m in (multiples or list(MULTIPLES))
    ]
    return metrics.where("missing_metric is null").select("instrument_id", F.explode(F.array(*items)).alias("_m")).select("instrument_id", "_m.*")


def excluded_peers(groups: DataFrame, metrics: DataFrame) -> DataFrame:
    """One row per (peer group, multiple, peer) left out for its denominator; for a
    target the list is its group's rows without itself."""
    out = peer_multiples(metrics).where("multiple is null").select("instrument_id", "multiple_name")
    return group_members(groups).select("instrument_id", "group_kind", "group_key").join(out, "instrument_id")


def implied_values(name: str, multiple: Column) -> tuple[Column, Column]:
    """(equity value, price per share) that a multiple implies for the row."""
    value = multiple * F.col(MULTIPLES[name][1])
    equity = value - F.col("net_debt") if name.startswith("EV/") else value
    return equity, numeric.safe_ratio(equity, F.col("share_count"))


def relative_valuation(groups: DataFrame, metrics: DataFrame, min_peers: int = MIN_PEERS, multiples: list[str] | None = None) -> DataFrame:
    """Peer valuation of every instrument.

    Per multiple: valid peers, q1/median/q3 and the implied prices.  Every multiple
    needs ``min_peers`` valid peers, else the whole result is UNAVAILABLE.  A target
    lacking a metric is REFUSED; a peer lacking one makes the row FAILED.
    """
    names = multiples or list(MULTIPLES)
    ks = range(len(names))
    have = groups.join(metrics, "instrument_id", "left")
    gap = F.when(F.col("share_count").isNull() | F.col("missing_metric").isNotNull(), F.coalesce("missing_metric", F.lit("ENTERPRISE_VALUE")))
    have = have.withColumn("_gap", gap).withColumns({
        f"_m{i}": F.when(F.col("_gap").isNull() & (F.col(MULTIPLES[m][1]) > 0), F.col(MULTIPLES[m][0]) / F.col(MULTIPLES[m][1])) for i, m in enumerate(names)})
    # one row per instrument; three branches follow, so write it once
    have = session.stage(have, "peer-metrics")
    key = ["group_kind", "group_key"]
    members = group_members(have.select("instrument_id", "sector_code", "industry_code", *key, "is_peer", "_gap", *[f"_m{i}" for i in ks]))
    long = members.select(*key, F.expr(f"posexplode(array({', '.join(f'_m{i}' for i in ks)})) as (k, v)"))
    stats = orderstats.order_stats(long, [*key, "k"], "v", orderstats.ranks_without_one("n"))
    per_group = stats.groupBy(*key).agg(*[F.expr(f"max_by(struct(n, at), 1) filter (where k = {i})").alias(f"_s{i}") for i in ks])
    gaps = members.groupBy(*key).agg(F.count("_gap").alias("_gaps"), F.expr("min_by(_gap, instrument_id) filter (where _gap is not null)").alias("_gap1"))
    # one row per peer group; writing it keeps the wide expressions below out of the
    # re-planning of the stages above
    per_group = session.stage(gaps.join(per_group, key, "left"), "peer-statistics")
    rows = have.join(per_group, key, "left")
    rows = rows.withColumns({f"_o{i}": F.expr(f"if(is_peer and group_key is not null, _m{i}, null)") for i in ks})
    rows = rows.withColumns({f"_v{i}": orderstats.ranked_without(f"coalesce(_s{i}.n, 0L)", f"_s{i}.at", f"_o{i}") for i in ks})
    rows = rows.withColumns({f"_n{i}": F.expr(f"coalesce(_s{i}.n, 0L) - if(_o{i} is null, 0, 1)") for i in ks})
    rows = rows.withColumns({f"_q{i}": F.struct(*orderstats.quartile_columns(f"_v{i}")) for i in ks})
    short = F.coalesce(*[
        F.when(F.col(f"_n{i}") < min_peers, F.concat(F.lit(f"Insufficient valid peers for {m}: "), F.col(f"_n{i}").cast("string"))) for i, m in enumerate(names)])
    # a peer list holds the target's own gap only when it is a member itself
    failed = F.when(F.col("_gaps") > 0, F.concat(F.lit("Missing required metric: "), F.col("_gap1"))).when(
        (F.col("_n0") >= min_peers) & (F.col("share_count") <= 0), "share_count must be positive")
    refused = F.col("_gap").isNotNull()
    rows = rows.withColumn("rel_status", F.when(refused, "REFUSED").when(failed.isNotNull(), "FAILED").when(short.isNotNull(), "UNAVAILABLE").otherwise("AVAILABLE"))
    rows = rows.withColumn("rel_reason", F.when(refused, F.concat(F.lit("Missing required metric: "), F.col("_gap"))).otherwise(F.coalesce(failed, short)))

    def result(i: int, m: str) -> Column:
        q = {p: F.col(f"_q{i}.{p}") for p in ("q1", "med", "q3")}
        implied = {p: implied_values(m, c) for p, c in q.items()}
        return F.struct(
            F.lit(m).alias("multiple_name"), F.col(f"_n{i}").alias("peer_count"), *[c.alias(p) for p, c in q.items()],
            *[v[0].alias(f"equity_{p}") for p, v in implied.items()], *[v[1].alias(f"price_{p}") for p, v in implied.items()])

    usable = F.col("rel_status") == "AVAILABLE"
    rows = rows.withColumn("multiple_results", F.when(usable, F.array(*[result(i, m) for i, m in enumerate(names)])))

    def mid(field: str) -> Column:
        s = f"array_sort(transform(multiple_results, r -> r.{field}))"
        return F.expr(f"(get({s}, {(len(names) - 1) // 2}) + get({s}, {len(names) // 2})) / 2")

    rows = rows.withColumns({"rel_equity": mid("equity_med"), "rel_price": mid("price_med")})
    return rows.select(
        "instrument_id", *key, "rel_status", "rel_reason", "multiple_results", "rel_equity", "rel_price", (F.col("rel_equity") + F.col("net_debt")).alias("rel_enterprise"),
        F.expr("array_max(transform(multiple_results, r -> r.peer_count))").alias("max_peer_count"))


# --- blend and confidence ---------------------------------------------------------------


def model_agreement(a: Column, b: Column) -> Column:
    """100 less the spread of the two prices in percent of their mean size."""
    size = (F.abs(a) + F.abs(b)) / 2
    score = F.when(size == 0, F.lit(100.0)).otherwise(100 - F.least(F.lit(100.0), F.abs(a - b) / F.nullif(size, F.lit(0.0)) * 100))
    return F.coalesce(F.bround(score, 2), F.lit(0.0))


def confidence_score(rows: DataFrame) -> DataFrame:
    """Add peer_count_score, composite_score and override_required.

    Expects data_quality_score, peer_count, assumption_stability, model_agreement.
    """
    peers = F.least(F.col("peer_count") * 20.0, F.lit(100.0))
    composite = F.bround((d("data_quality_score") + peers + d("assumption_stability") + d("model_agreement")) / 4, 2)
    return rows.withColumns({"peer_count_score": peers, "composite_score": composite, "override_required": composite < 40})


def blend_valuations(rows: DataFrame) -> DataFrame:
    """Mean of DCF and relative figures, DCF alone where relative is missing."""
    pairs = {"blended_price": ("dcf_price", "rel_price"), "blended_equity": ("equity_value_dcf", "rel_equity"), "blended_enterprise": ("enterprise_value_dcf", "rel_enterprise")}
    return rows.withColumns({k: F.when(F.col(r).isNull(), F.col(x)).otherwise((F.col(x) + F.col(r)) / 2) for k, (x, r) in pairs.items()})


def run_status() -> Column:
    return F.when(F.col("failure").isNotNull(), "FAILED").when(F.col("override_required"), "OVERRIDDEN").otherwise("SUCCESS")


def value_universe(
    facts: DataFrame, metrics: DataFrame, instruments: DataFrame, companies: DataFrame, requests: DataFrame, as_of: dt.date,
    data_quality: float | DataFrame = 85.0, stability: float = DEFAULT_STABILITY, allow_placeholder: bool = False, min_peers: int = MIN_PEERS,
) -> DataFrame:
    """The whole valuation of all requested instruments in one job.

    ``requests``: val_run_id, instrument_id, the five assumptions and optional
    schedules.  A row that cannot be valued is FAILED with its ``failure`` reason.
    ``data_quality``: a score, or the one-row frame of ``serving.data_quality_score``.
    """
    quality = data_quality.select("data_quality_score").scalar() if isinstance(data_quality, DataFrame) else F.lit(data_quality)
    wide = asof_metric(metrics, PEER_METRICS, as_of)
    rel = relative_valuation(peer_group(instruments, companies, as_of), wide, min_peers)
    rows = dcf_value(projection_with_fallback(build_projection_input(facts, as_of), requests, allow_placeholder))
    rows = rows.join(rel, "instrument_id", "left")
    rows = rows.withColumn(
        "failure",
        F.when(F.col("rel_status").isNull(), "Missing required metric: ENTERPRISE_VALUE")
        .when(F.col("rel_status") == "REFUSED", F.col("rel_reason"))
        .when(F.col("input_source").isNull(), "Missing fundamentals")
        .when(F.col("error").isNotNull(), F.col("error"))
        .when(F.col("rel_status") == "FAILED", F.col("rel_reason")),
    )
    rows = blend_valuations(rows).withColumns(
        {
            "peer_count": F.coalesce("max_peer_count", F.lit(0)), "model_agreement": model_agreement(F.col("dcf_price"), F.col("rel_price")),
            "data_quality_score": quality, "assumption_stability": F.lit(stability),
        })
    return confidence_score(rows).withColumn("status", run_status())


def max_peer_count(results: DataFrame) -> DataFrame:
    """Largest valid-peer count over the multiples of each instrument."""
    return results.select("instrument_id", F.array_max(F.transform("multiple_results", lambda r: r.peer_count)).alias("max_peer_count"))


# --- output tables ----------------------------------------------------------------------


def _done(v: DataFrame) -> DataFrame:
    return v.where("status <> 'FAILED'")


def model_outputs(v: DataFrame) -> DataFrame:
    """DCF, RELATIVE and BLENDED rows of each valued run with their payload."""
    c = F.col
    dcf_load = text.payload_json(
        inputs=F.struct("revenue_base", "tax_rate", "share_count", "net_debt", "da_plan", "capex_plan", "nwc_plan"),
        assumptions=F.struct(*DCF_KEYS), result=F.struct("dcf_price", "terminal_value", "terminal_present_value", "lines"), fundamentals_source=c("input_source"))
    rel_load = F.when(c("rel_status") == "AVAILABLE", text.payload_json(result=c("multiple_results"))).otherwise(
        text.payload_json(status=F.lit("UNAVAILABLE"), reason=c("rel_reason")))
    blend_load = text.payload_json(
        inputs_reconstructable=F.lit(True), dcf_target_price=c("dcf_price"), relative_target_price=c("rel_price"),
        confidence=F.struct("composite_score", "data_quality_score", "peer_count_score", "assumption_stability", "model_agreement"), analyst_override_required=c("override_required"))
    rows = [
        ("DCF", "equity_value_dcf", "enterprise_value_dcf", "dcf_price", 0.5, dcf_load),
        ("RELATIVE", "rel_equity", "rel_enterprise", "rel_price", 0.5, rel_load),
        ("BLENDED", "blended_equity", "blended_enterprise", "blended_price", 1.0, blend_load),
    ]
    items = [
        F.struct(F.lit(n).alias("model_name"), numeric.half_even(c(q), 4, 24).alias("equity_value"), numeric.half_even(c(e), 4, 24).alias("enterprise_value"),
                 numeric.half_even(c(p), 6).alias("target_price"), F.lit(w).cast("decimal(8,6)").alias("weight"), load.alias("output_payload"))
        for n, q, e, p, w, load in rows
    ]
    return _done(v).select("val_run_id", F.explode(F.array(*items)).alias("_o")).select("val_run_id", F.lit(MODEL_VERSION).alias("model_version"), "_o.*")


def attribution_rows(v: DataFrame) -> DataFrame:
    """Yearly cash flows, terminal value and the low-confidence flag as driver rows."""
    def driver(kind: str, key: Column, value: Column, way: Column, evidence: Column) -> Column:
        return F.struct(F.lit(kind).alias("driver_type"), key.alias("driver_key"), numeric.half_even(value, 6, 24).alias("impact_value_abs"), way.alias("direction"), evidence.alias("evidence_ref"))

    years = F.transform("lines", lambda x: driver(
        "DCF_FCF", F.concat(F.lit("YEAR_"), x.year_index.cast("string")), x.free_cash_flow, numeric.direction(x.free_cash_flow),
        F.to_json(F.struct(x.revenue.alias("revenue"), x.ebit.alias("ebit"), x.nopat.alias("nopat"), x.depreciation_and_amortization.alias("depreciation_and_amortization"),
                           x.capex.alias("capex"), x.delta_nwc.alias("delta_nwc"), x.present_value.alias("present_value")))))
    tail = F.array(driver("DCF_TERMINAL_VALUE", F.lit("TERMINAL_VALUE"), F.col("terminal_present_value"), numeric.direction(F.col("terminal_present_value")),
                          F.to_json(F.struct("terminal_value", "terminal_present_value"))))
    flag = F.array(driver("CONFIDENCE", F.lit("ANALYST_OVERRIDE_REQUIRED"), F.col("composite_score"), F.lit("DOWN"),
                          F.to_json(F.struct("composite_score", "data_quality_score", "peer_count_score", "assumption_stability", "model_agreement"))))
    every = F.concat(years, tail, F.when(F.col("override_required"), flag).otherwise(F.slice(flag, 1, 0)))
    return _done(v).select("val_run_id", F.explode(every).alias("_a")).select("val_run_id", "_a.*")


def confidence_snapshot(v: DataFrame) -> DataFrame:
    """Seven component columns mapped from the four scores."""
    two = {k: numeric.half_even(d(k), 2, 5) for k in ("composite_score", "data_quality_score", "peer_count_score", "assumption_stability", "model_agreement")}
    return _done(v).select(
        "val_run_id", two["composite_score"].alias("overall_confidence"), two["data_quality_score"].alias("data_quality_score"),
        two["assumption_stability"].alias("management_credibility_score"), two["peer_count_score"].alias("industry_stability_score"),
        two["assumption_stability"].alias("forecast_accuracy_score"), two["data_quality_score"].alias("news_reliability_score"),
        two["model_agreement"].alias("model_agreement_score"), numeric.half_even(100 - d("model_agreement"), 2, 5).alias("scenario_dispersion_score"),
        F.lit(CONFIDENCE_VERSION).alias("scoring_version"))


def assumptions_long(rows: DataFrame) -> DataFrame:
    """Five assumption rows per run with their unit."""
    items = [F.struct(F.lit(k).alias("assumption_key"), F.col(k).cast("decimal(24,8)").alias("assumption_value_numeric"), F.lit(u).alias("assumption_unit")) for k, u in DCF_KEYS.items()]
    return rows.select("val_run_id", F.explode(F.array(*items)).alias("_a")).select("val_run_id", "_a.*")


def assumptions_wide(long: DataFrame) -> DataFrame:
    """Back to one row per run; ``missing_keys`` lists absent keys."""
    w = long.groupBy("val_run_id").agg(*[F.max(F.when(F.col("assumption_key") == k, F.col("assumption_value_numeric"))).alias(k) for k in DCF_KEYS])
    gone = F.filter(F.array(*[F.when(F.col(k).isNull(), F.lit(k)) for k in DCF_KEYS]), lambda x: x.isNotNull())
    return w.withColumn("missing_keys", F.array_join(gone, ","))


def reconstruct_inputs(outputs: DataFrame, assumptions: DataFrame) -> DataFrame:
    """Assumptions and output payloads of each run (three models per run)."""
    loads = outputs.groupBy("val_run_id").agg(F.array_sort(F.collect_list(F.struct("model_name", "output_payload"))).alias("model_outputs"))
    return assumptions_wide(assumptions).join(loads, "val_run_id")


# --- quick terminal variant -----------------------------------------------------------------


def estimate_revenue() -> Column:
    """Market cap / price-to-sales, else / PE / margin, else 60 % of market cap."""
    cap, pe = F.coalesce(d("market_cap"), F.lit(0.0)), F.coalesce(d("trailing_pe"), F.lit(0.0))
    margin = F.coalesce(numeric.truthy(d("profit_margins")), F.lit(0.12))
    ps = F.coalesce(d("price_to_sales"), F.lit(0.0))
    return F.when((cap != 0) & (ps != 0), F.try_divide(cap, ps)).when((cap != 0) & (pe != 0), F.try_divide(F.try_divide(cap, pe), margin)).otherwise(F.greatest(cap * 0.6, F.lit(1.0)))


def margin_dcf(info: DataFrame) -> DataFrame:
    """Quick DCF from a profile row and its five assumptions: adds intrinsic_value."""
    one = F.lit(1.0)
    revenue = F.coalesce(numeric.truthy(d("total_revenue")), estimate_revenue())
    # ratios use the profile revenue as given
    base = F.coalesce(revenue, one)
    da = F.coalesce(numeric.truthy(F.try_divide(numeric.truthy(d("depreciation_amortization")), base)), F.lit(0.03))
    capex = F.coalesce(numeric.truthy(F.try_divide(numeric.truthy(F.abs(d("capital_expenditure"))), base)), F.lit(0.04))
    rows = info.withColumns({
        "_rev": base, "_da": da, "_capex": capex, "_tax": F.coalesce(numeric.truthy(d("effective_tax_rate")), F.lit(0.25)),
        "_debt": F.coalesce(d("total_debt"), F.lit(0.0)) - F.coalesce(d("total_cash"), F.lit(0.0)), "_sh": F.coalesce(numeric.truthy(d("shares_outstanding")), one)})
    w, g, n = d("wacc"), d("terminal_growth"), d("forecast_years")

    def year(t: Column) -> Column:
        rev = F.col("_rev") * F.pow(one + d("revenue_cagr"), t)
        ebit = rev * d("ebit_margin")
        fcf = ebit * (one - F.col("_tax")) + rev * F.col("_da") - rev * F.col("_capex") - rev * 0.01
        return F.struct(rev.alias("revenue"), ebit.alias("ebit"), fcf.alias("fcf"), (fcf / F.pow(one + w, t)).alias("present_value"))

    rows = rows.withColumn("years", F.transform(F.sequence(F.lit(1), F.col("forecast_years").cast("int")), lambda t: year(t.cast("double"))))
    last = F.element_at("years", -1).fcf * (one + g)
    tail = F.try_divide(last, F.greatest(w - g, F.lit(0.01))) / F.pow(one + w, n)
    ev = F.aggregate("years", F.lit(0.0), lambda a, x: a + x.present_value) + tail
    return rows.withColumn("intrinsic_value", (ev - F.col("_debt")) / F.greatest(F.col("_sh"), one)).drop("_rev", "_da", "_capex", "_tax", "_debt", "_sh")


def compound_projection(rows: DataFrame) -> DataFrame:
    """Revenue of each forecast year: one row per instrument and year."""
    return rows.select("instrument_id", d("total_revenue").alias("_b"), d("revenue_cagr").alias("_g"), F.explode(F.sequence(F.lit(1), F.col("forecast_years").cast("int"))).alias("year")).select(
        "instrument_id", "year", (F.col("_b") * F.pow(1.0 + F.col("_g"), F.col("year").cast("double"))).alias("revenue"))


def shock_grid(wacc: Column, growth: Column, step: float = 0.01) -> Column:
    """The nine (wacc, terminal_growth) pairs around the given ones, as an array of
    structs: shifts of one step, floored at 0.01 and 0."""
    shifts = [-step, 0.0, step]
    return F.array(*[
        F.struct(F.greatest(wacc + a, F.lit(0.01)).alias("wacc"), F.greatest(growth + b, F.lit(0.0)).alias("terminal_growth")) for a in shifts for b in shifts])


def dcf_sensitivity(info: DataFrame) -> DataFrame:
    """Quick DCF on the nine shocks of each row, shocks labelled as percent text."""
    grid = info.withColumn("_s", F.explode(shock_grid(d("wacc"), d("terminal_growth")))).withColumn("wacc", F.col("_s.wacc")).withColumn("terminal_growth", F.col("_s.terminal_growth")).drop("_s")
    w, g = (numeric.percent_text(F.col(c), 1).alias(c) for c in ("wacc", "terminal_growth"))
    return margin_dcf(grid).select("instrument_id", w, g, "intrinsic_value")


def dcf_delta(core: Column, quick: Column) -> Column:
    """(core - quick) / core, null when core is null or zero."""
    return numeric.safe_ratio(core - quick, core)


def live_multiples(info: DataFrame) -> DataFrame:
    """P/E, EV/EBITDA, P/B and P/S of a profile row; missing numbers count as zero."""
    z = {k: F.coalesce(d(k), F.lit(0.0)) for k in ("enterprise_value", "ebitda", "trailing_eps", "book_value", "total_revenue", "market_cap")}
    price = F.coalesce(numeric.truthy(d("current_price")), d("regular_market_price"), F.lit(0.0))
    r = numeric.safe_ratio
    return info.select("instrument_id", r(price, z["trailing_eps"]).alias("p_e"), r(z["enterprise_value"], z["ebitda"]).alias("ev_ebitda"),
                       r(price, z["book_value"]).alias("p_b"), r(z["market_cap"], z["total_revenue"]).alias("p_s"))


def pe_band(prices: DataFrame, info: DataFrame) -> DataFrame:
    """Close over trailing EPS by date; no rows where EPS is zero or missing."""
    eps = info.where("trailing_eps <> 0").select("instrument_id", d("trailing_eps").alias("_e"))
    return prices.join(eps, "instrument_id").select("instrument_id", "date", (d("close") / F.col("_e")).alias("trailing_pe"))
