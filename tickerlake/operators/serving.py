"""Read-side queries: lists, pages, details, coverage and run browsing.

Details of things with many children come as flat rows (parent columns repeated),
one row per child, so that a parent with any number of children stays spread out.
Only children bounded by a key (models, assumption keys) are nested.
"""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickerlake import session
from tickerlake.functions import dates, text
from tickerlake.operators import contain, prices, timejoin

MAX_PAGE = 200
MOST_TAKEN = 100_000


def count_total(df: DataFrame) -> DataFrame:
    """One row: the filtered row count beside a page."""
    return df.agg(F.count(F.lit(1)).alias("total"))


def paginate(df: DataFrame, page: int, size: int, order: list[Column]) -> tuple[DataFrame, DataFrame]:
    """(page rows, total).  ``size`` is 1 to 200, ``page`` starts at 1.

    Early pages come from a top-k; beyond MOST_TAKEN rows the sorted rows are numbered where they lie, so that only
    the page itself travels.
    """
    if page < 1 or not 1 <= size <= MAX_PAGE:
        raise ValueError("page must be >= 1 and size within 1..200")
    if page * size <= MOST_TAKEN:
        return df.orderBy(*order).offset((page - 1) * size).limit(size), count_total(df)
    return _far_page(df, (page - 1) * size, size, order).orderBy(*order), count_total(df)


def _far_page(df: DataFrame, skip: int, size: int, order: list[Column]) -> DataFrame:
    """Rows skip .. skip + size - 1 of the order: range partitions are sorted and counted, then addressed."""
    lies = F.monotonically_increasing_id()
    rows = session.stage(df.orderBy(*order).withColumn("_at", lies), "sorted")
    part, place = F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    counts = sorted((r.p, r.n) for r in rows.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect())  # one row a partition
    wanted, before = F.lit(False), 0
    for p, n in counts:
        low, high = max(skip - before, 0), min(skip + size - before, n)
        if low < high:
            wanted = wanted | ((part == p) & (place >= low) & (place < high))
        before += n
    return rows.where(wanted).drop("_at")


def multi_key_sort(df: DataFrame, keys: list[tuple[str, bool]]) -> DataFrame:
    """Sort by (column, descending) pairs; nulls last either way."""
    return df.orderBy(*[F.col(c).desc_nulls_last() if down else F.col(c).asc_nulls_last() for c, down in keys])


def distinct_sources(df: DataFrame) -> DataFrame:
    return df.select("source_system").distinct()


def _universe(instruments: DataFrame, companies: DataFrame, exchanges: DataFrame) -> DataFrame:
    return instruments.join(companies, "company_id").join(exchanges, "exchange_id")


def list_instruments(instruments: DataFrame, companies: DataFrame, exchanges: DataFrame, exchange: str | None = None,
                     sector: str | None = None, is_active: bool | None = None, page: int = 1, size: int = 50) -> tuple[DataFrame, DataFrame]:
    rows = _universe(instruments, companies, exchanges)
    if exchange is not None:
        rows = rows.where(F.col("exchange_code") == exchange.upper())
    if sector is not None:
        rows = rows.where(F.col("sector_code") == sector)
    if is_active is not None:
        rows = rows.where(F.col("is_active") == is_active)
    return paginate(rows, page, size, [F.col("instrument_id")])


def search_instruments(instruments: DataFrame, companies: DataFrame, query: str) -> DataFrame:
    """Case-folded substring in symbol, name or ISIN."""
    q = query.lower()
    hit = F.lower("symbol").contains(q) | F.lower("legal_name").contains(q) | F.coalesce(F.lower("isin_primary").contains(q), F.lit(False))
    return instruments.join(companies, "company_id").where(hit)


def instrument_detail(instruments: DataFrame, companies: DataFrame, exchanges: DataFrame, aliases: DataFrame, as_of: dt.date) -> DataFrame:
    """One row per instrument and active alias (one row without alias columns if none)."""
    live = aliases.where(F.col("valid_to").isNull() | (F.col("valid_to") >= F.lit(as_of))).select(
        "instrument_id", "alias_symbol", F.col("source_system").alias("alias_source"), F.col("valid_from").alias("alias_from"), F.col("valid_to").alias("alias_to"))
    return _universe(instruments, companies, exchanges).join(live, "instrument_id", "left")


def reference_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """Row counts of the reference tables, one row each."""
    parts = [t.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("table_name"), "n") for name, t in tables.items()]
    return reduce(DataFrame.unionByName, parts)


def coverage_map(instruments: DataFrame, companies: DataFrame, exchanges: DataFrame, bars: DataFrame, runs: DataFrame, as_of: dt.date) -> DataFrame:
    """Instrument with its last price date (ten years back) and last valuation."""
    seen = prices.price_history_window(bars, instruments, as_of - dt.timedelta(days=3650), as_of, as_of)
    last_price = seen.groupBy("instrument_id").agg(F.max("trade_date").alias("last_price_date"))
    last_val = runs.groupBy("instrument_id").agg(F.max("as_of_ts").alias("last_val_date"))
    return (
        _universe(instruments, companies, exchanges).join(last_price, "instrument_id", "left").join(last_val, "instrument_id", "left")
        .select(
            "symbol", F.col("isin_primary").alias("isin"), F.col("exchange_code").alias("exchange"), "last_price_date", "last_val_date",
            F.col("last_val_date").isNotNull().alias("valued"),
            text.valuation_status_text(F.col("last_val_date").isNotNull()).alias("valuation_status"),
        )
    )


# --- valuations ---------------------------------------------------------------------


def valuation_list_filter(runs: DataFrame, assumptions: DataFrame, from_date: dt.date | None = None, to_date: dt.date | None = None, label: str | None = None) -> DataFrame:
    """Runs inside whole days, optionally with a given run label."""
    dates.date_window_guard(from_date, to_date)
    if from_date is not None:
        runs = runs.where(F.col("as_of_ts") >= F.lit(dt.datetime.combine(from_date, dt.time.min)))
    if to_date is not None:
        runs = runs.where(F.col("as_of_ts") <= F.lit(dt.datetime.combine(to_date, dt.time.max)))
    if label is not None:
        tagged = assumptions.where((F.col("assumption_key") == "RUN_LABEL") & (F.col("assumption_value_text") == label))
        runs = runs.join(tagged.select("val_run_id"), "val_run_id", "left_semi")
    return runs


def model_prices(outputs: DataFrame) -> DataFrame:
    """One row per run: the target price of each model."""
    return outputs.groupBy("val_run_id").pivot("model_name", ["DCF", "RELATIVE", "BLENDED"]).agg(F.max("target_price")).select(
        "val_run_id", F.col("BLENDED").alias("blended_value"), F.col("DCF").alias("dcf_value"), F.col("RELATIVE").alias("relative_value"))


def latest_confidence(confidence: DataFrame) -> DataFrame:
    """Most recent confidence snapshot per run."""
    return confidence.groupBy("val_run_id").agg(F.max_by("overall_confidence", timejoin.packed(F.unix_micros("created_at"), F.col("confidence_id"))).alias("confidence_score"))


def valuation_list(runs: DataFrame, outputs: DataFrame, confidence: DataFrame, assumptions: DataFrame) -> DataFrame:
    """Runs with model values, confidence and label; newest first."""
    labels = assumptions.where("assumption_key = 'RUN_LABEL'").groupBy("val_run_id").agg(F.max("assumption_value_text").alias("run_label"))
    return (
        runs.join(model_prices(outputs), "val_run_id", "left").join(latest_confidence(confidence), "val_run_id", "left").join(labels, "val_run_id", "left")
        .orderBy(F.desc("as_of_ts"), F.desc("val_run_id"))
    )


def valuation_detail(runs: DataFrame, assumptions: DataFrame, outputs: DataFrame, attributions: DataFrame, confidence: DataFrame) -> DataFrame:
    """Run with its children as sorted arrays; each child list is bounded by its key
    (assumption key, model, driver, scoring version)."""

    def nest(df: DataFrame, name: str, cols: list[str]) -> DataFrame:
        return df.groupBy("val_run_id").agg(F.array_sort(F.collect_list(F.struct(*cols))).alias(name))

    parts = [
        nest(assumptions, "assumption_set", ["assumption_key", "assumption_value_numeric", "assumption_value_text"]),
        nest(outputs, "model_outputs", ["model_name", "target_price", "equity_value", "enterprise_value"]),
        nest(attributions, "attributions", ["driver_type", "driver_key", "impact_value_abs", "direction"]),
        nest(confidence, "confidence_snapshots", ["created_at", "overall_confidence"]),
    ]
    return reduce(lambda a, p: a.join(p, "val_run_id", "left"), parts, runs)


def value_bridge(attributions: DataFrame, pairs: DataFrame) -> DataFrame:
    """Current against prior attribution by driver key.

    ``pairs``: val_run_id, prior_run_id.  The last prior row of a driver key wins.
    """
    prior = attributions.groupBy(F.col("val_run_id").alias("prior_run_id"), "driver_key").agg(F.max_by("impact_value_abs", "attribution_id").alias("prior_value"))
    return (
        attributions.join(pairs, "val_run_id").join(prior, ["prior_run_id", "driver_key"])
        .select("val_run_id", "prior_run_id", "driver_type", "driver_key", F.col("impact_value_abs").alias("current_value"), "prior_value",
                (F.col("impact_value_abs") - F.col("prior_value")).alias("delta_value"))
    )


def sensitivity_rows(sensitivity: DataFrame, outputs: DataFrame) -> DataFrame:
    """Sensitivity rows of each run, by assumption key and label."""
    return sensitivity.join(outputs.select("model_output_id", "val_run_id"), "model_output_id").orderBy("val_run_id", "assumption_key", "shock_label")


def run_browser(instruments: DataFrame, exchanges: DataFrame, valuations: DataFrame) -> DataFrame:
    """Valuation runs with symbol, exchange and override flag; newest first."""
    i = instruments.join(exchanges, "exchange_id").select("instrument_id", F.col("symbol").alias("instrument"), F.col("exchange_code").alias("exchange"))
    flag = (F.col("status") == "OVERRIDDEN") | F.coalesce(F.col("confidence_score") < 40, F.lit(False))
    return valuations.join(i, "instrument_id").withColumn("override_required", flag).orderBy(F.desc("as_of_ts"), F.desc("val_run_id"))


# --- quality and pipeline -------------------------------------------------------------


def incident_star(incidents: DataFrame, results: DataFrame, rules: DataFrame) -> DataFrame:
    return incidents.join(results, "dq_result_id").join(rules, "dq_rule_id")


def incident_detail(incidents: DataFrame, results: DataFrame, rules: DataFrame) -> DataFrame:
    return incident_star(incidents, results, rules).select(
        "dq_incident_id", "incident_status", "impact_level", "opened_at", "severity", "domain_name", "rule_code",
        "target_table", "target_record_key", "failure_reason")


def open_incidents(incidents: DataFrame, results: DataFrame, rules: DataFrame, severity: str | None = None, domain: str | None = None,
                   from_date: dt.date | None = None, page: int = 1, size: int = 50) -> tuple[DataFrame, DataFrame]:
    """OPEN incidents, newest first, as a page with its total."""
    inc = incidents.where("incident_status = 'OPEN'")
    if from_date is not None:
        inc = inc.where(F.col("opened_at") >= F.lit(dt.datetime.combine(from_date, dt.time.min)))
    if severity is not None:
        rules = rules.where(F.col("severity") == severity.upper())
    if domain is not None:
        rules = rules.where(F.col("domain_name") == domain)
    return paginate(incident_detail(inc, results, rules), page, size, [F.desc("opened_at"), F.desc("dq_incident_id")])


def key_contains_lookup(incidents: DataFrame, instruments: DataFrame) -> DataFrame:
    """Add ``instrument``: symbol of the instrument whose uuid the record key contains, wherever it stands in it.

    The lowest instrument id wins, a key without a match stands for itself.
    """
    ids = instruments.select(F.col("instrument_uuid").alias("needle"), "instrument_id", "symbol")
    hit = contain.containing(incidents, "target_record_key", ids, "needle")
    hit = hit.groupBy("target_record_key").agg(F.min_by("symbol", "instrument_id").alias("_s"), F.min("instrument_id").alias("_i"))
    return incidents.join(hit, "target_record_key", "left").withColumn(
        "instrument", F.coalesce("_s", F.nullif("target_record_key", F.lit("")), F.lit("Unknown"))
    ).withColumnRenamed("_i", "matched_instrument_id").drop("_s")


def open_incidents_by_instrument(incidents: DataFrame, results: DataFrame, instruments: DataFrame) -> DataFrame:
    """Count of OPEN incidents whose record key contains the instrument; a key with several counts for each of them."""
    inc = incidents.where("incident_status = 'OPEN'").join(results.select("dq_result_id", "target_record_key"), "dq_result_id")
    per_key = inc.where("target_record_key is not null").groupBy("target_record_key").agg(F.count("*").alias("_n"))
    hit = contain.containing(per_key, "target_record_key", instruments.select("instrument_uuid", "instrument_id"), "instrument_uuid")
    return hit.join(per_key, "target_record_key").groupBy("instrument_id").agg(F.sum("_n").alias("open_incidents"))


def data_quality_score(incidents: DataFrame) -> DataFrame:
    """20 while any incident is open or in progress, else 85."""
    n = F.count_if(F.col("incident_status").isin("OPEN", "IN_PROGRESS"))
    return incidents.agg(F.when(n > 0, 20.0).otherwise(85.0).alias("data_quality_score"))


def pipeline_runs(runs: DataFrame, status: str | None = None, name: str | None = None) -> DataFrame:
    if status is not None:
        runs = runs.where(F.col("status") == status.upper())
    if name is not None:
        runs = runs.where(F.col("pipeline_name") == name)
    return runs.orderBy(F.desc("started_at"), F.desc("pipeline_run_id"))


def _with_breach(runs: DataFrame, breaches: DataFrame) -> DataFrame:
    flag = breaches.select("pipeline_run_id").distinct().withColumn("sla_breach", F.lit(True))
    return runs.join(flag, "pipeline_run_id", "left").withColumn("sla_breach", F.coalesce("sla_breach", F.lit(False)))


def pipeline_run_detail(runs: DataFrame, events: DataFrame, breaches: DataFrame) -> DataFrame:
    """Run columns and breach flag on one row per job event, in event order."""
    ev = events.select("pipeline_run_id", "job_event_id", "event_type", "event_ts", "message")
    return _with_breach(runs, breaches).join(ev, "pipeline_run_id", "left").orderBy("pipeline_run_id", "event_ts", "job_event_id")


def pipeline_health(runs: DataFrame, breaches: DataFrame, as_of: dt.datetime, n: int = 10) -> DataFrame:
    """Latest runs with duration text and breach flag."""
    latest = runs.orderBy(F.desc("started_at"), F.desc("pipeline_run_id")).limit(n)
    return _with_breach(latest, breaches).select(
        "pipeline_run_id", F.col("pipeline_name").alias("name"), F.upper("status").alias("status"), F.col("started_at").alias("start_time"),
        dates.duration_text(F.col("started_at"), F.col("ended_at"), F.lit(as_of)).alias("duration"),
        F.when(F.col("sla_breach"), "YES").otherwise("").alias("sla_breach"),
    )


def last_activity_status(runs: DataFrame, as_of: dt.datetime) -> DataFrame:
    """connected when the last activity is at most 24 hours old, else degraded."""
    last = F.max(F.coalesce("ended_at", "started_at"))
    return runs.agg(last.alias("last_pipeline_run")).withColumn(
        "status", F.when(F.col("last_pipeline_run") >= F.lit(as_of) - F.expr("interval 24 hours"), "connected").otherwise("degraded"))


def batch_summary(results: DataFrame) -> DataFrame:
    """Processed and skipped counts with stored rows; reasons counted, not listed per row."""
    return results.agg(
        F.count_if(~F.col("skipped")).alias("instruments_processed"),
        F.count_if("skipped").alias("instruments_skipped"),
        F.coalesce(F.sum(F.when(~F.col("skipped"), F.col("statements_stored"))), F.lit(0)).alias("statements_stored"),
        F.coalesce(F.sum(F.when(~F.col("skipped"), F.col("metrics_computed"))), F.lit(0)).alias("metrics_computed"),
    )


def skip_reasons(results: DataFrame) -> DataFrame:
    """``symbol: reason`` of every skipped instrument, one row each."""
    return results.where("skipped").select(F.concat(F.col("symbol"), F.lit(": "), F.col("skip_reason")).alias("skip_line"))
