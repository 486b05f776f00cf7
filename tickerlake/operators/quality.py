"""Declarative data-quality rules, severity routing, incidents and lineage."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickerlake.functions import dates, text
from tickerlake.operators import prices

# --- fixed values -----------------------------------------------------------
PRICE_FLOOR, PRICE_CEILING = "0.01", "1000000"
STALE_DAYS = 5
RETURN_LIMIT = 0.5
OWNER = "DATA_ENGINEERING"
PRICE_FIELDS = ["open_px", "high_px", "low_px", "close_px"]
# ----------------------------------------------------------------------------


@dataclass(frozen=True)
class Rule:
    """One rule as column expressions over a record.

    ``failed`` is true for a failing row (null counts as passed); the three texts
    describe the failure.  Users add rules by listing more of these.
    """

    name: str
    severity: str
    failed: Column
    reason: Column
    measured: Column
    threshold: Column
    version: int = 1
    domain: str = "MARKET"
    quarantine_on_fail: bool = True

    @property
    def code(self) -> str:
        return f"{self.name.upper()}_V{self.version}"


def missing_fields_list(fields: list[str]) -> Column:
    """Comma-joined names of the null fields."""
    return F.array_join(F.filter(F.array(*[F.when(F.col(f).isNull(), F.lit(f)) for f in fields]), lambda x: x.isNotNull()), ",")


def rule_null_check(fields: list[str]) -> Rule:
    gone = missing_fields_list(fields)
    return Rule("null_check", "HIGH", gone != "", F.concat(F.lit("null_fields="), gone), F.lit("NULL"), F.lit("NOT_NULL"))


def rule_range_check(columns: list[str], lo: str = PRICE_FLOOR, hi: str = PRICE_CEILING) -> Rule:
    """First price outside the range; raw column names stand in where the price is null."""
    firsts = []
    for f in PRICE_FIELDS:
        names = [c for c in (f, f[:-3]) if c in columns]
        if not names:
            continue
        v = F.coalesce(*[F.col(c).cast("decimal(24,6)") for c in names])
        out = (v < F.lit(lo).cast("decimal(24,6)")) | (v > F.lit(hi).cast("decimal(24,6)"))
        firsts.append(F.when(out, F.struct(F.lit(f).alias("f"), v.cast("string").alias("v"))))
    hit = F.coalesce(*firsts)
    return Rule("range_check", "HIGH", hit.isNotNull(), F.concat(F.lit("price_out_of_range field="), hit.f), hit.v, F.lit(f"[{lo},{hi}]"))


def rule_stale_check(as_of: dt.datetime, days: int = STALE_DAYS) -> Rule:
    limit = dates.subtract_trading_days(F.lit(as_of.date()), days)
    ts = F.col("event_ts")
    return Rule("stale_check", "HIGH", ts.cast("date") < limit, F.lit("event_ts_stale"), ts.cast("string"), limit.cast("string"))


def rule_duplicate_check(flag: str = "is_duplicate") -> Rule:
    key = F.concat_ws(":", "instrument_id", "trade_date", "source_system")
    return Rule("duplicate_check", "HIGH", F.col(flag), F.lit("duplicate_curated_row"), key, F.lit("UNIQUE"))


def rule_symbol_resolved() -> Rule:
    return Rule("symbol_resolved_check", "HIGH", F.col("instrument_id").isNull(), F.lit("instrument_id_unresolved"), F.lit("NULL"), F.lit("NOT_NULL"))


def rule_circuit_breaker(prior: str = "prior_close", limit: float = RETURN_LIMIT) -> Rule:
    close, before = F.col("close_px").cast("double"), F.col(prior).cast("double")
    move = F.try_divide(close - before, before)
    return Rule("circuit_breaker", "CRITICAL", F.abs(move) > limit, F.lit("circuit_breaker_triggered"),
                F.bround(move, 4).cast("decimal(18,4)").cast("string"), F.lit(f"[-{limit},{limit}]"), quarantine_on_fail=False)


def builtin_rules(columns: list[str], required: list[str], as_of: dt.datetime) -> list[Rule]:
    return [rule_null_check(required), rule_range_check(columns), rule_stale_check(as_of), rule_duplicate_check(), rule_symbol_resolved(), rule_circuit_breaker()]


def duplicate_semi(rows: DataFrame, curated: DataFrame) -> DataFrame:
    """Add ``is_duplicate``: already curated for (instrument, date, source)."""
    keys = ["instrument_id", "trade_date", "source_system"]
    known = curated.select(*keys).distinct().withColumn("is_duplicate", F.lit(True))
    return rows.join(known, keys, "left").withColumn("is_duplicate", F.coalesce("is_duplicate", F.lit(False)))


def prepare(rows: DataFrame, curated: DataFrame) -> DataFrame:
    """Add what the built-in rules look up in the curated table."""
    one_per_day = curated.select("instrument_id", "trade_date", "close_px")
    return prices.asof_prior_close(duplicate_semi(rows, curated), one_per_day)


def _key() -> Column:
    return text.record_key(F.col("instrument_id"), F.col("symbol"), F.col("trade_date"), F.col("source_system"))


def _judge(rules: list[Rule]) -> Column:
    """Array with one verdict struct per rule, in rule order."""
    def verdict(r: Rule) -> Column:
        bad = F.coalesce(r.failed, F.lit(False))
        status = "FAIL" if r.severity in ("HIGH", "CRITICAL") else "WARN"
        return F.struct(
            F.lit(r.code).alias("rule_code"), F.lit(r.severity).alias("severity"), F.when(bad, status).otherwise("PASS").alias("status"),
            F.when(bad, r.reason).alias("failure_reason"), F.when(bad, text.truncate_ellipsis(r.measured)).alias("measured_value"),
            F.when(bad, text.truncate_ellipsis(r.threshold)).alias("threshold_value"))

    return F.array(*[verdict(r) for r in rules])


def judge(rows: DataFrame, rules: list[Rule]) -> DataFrame:
    """Add record_key and ``verdicts``; no rule stops another."""
    return rows.withColumn("record_key", _key()).withColumn("verdicts", _judge(rules))


def evaluate_rules(judged: DataFrame, run_id: int, target_table: str, as_of: dt.datetime) -> DataFrame:
    """One result row per (record, rule)."""
    return judged.select("record_key", F.explode("verdicts").alias("_v")).select(
        F.lit(run_id).alias("pipeline_run_id"), F.lit(target_table).alias("target_table"), F.col("record_key").alias("target_record_key"),
        "_v.*", F.lit(as_of).alias("evaluated_at"))


def _failed(judged: DataFrame, *keep: str) -> DataFrame:
    bad = F.filter("verdicts", lambda v: v.status != "PASS")
    return judged.select("record_key", *keep, F.explode(bad).alias("_v")).select("record_key", *keep, "_v.*")


def open_incident_rows(results: DataFrame, as_of: dt.datetime) -> DataFrame:
    """OPEN incident per failed result of blocking severity."""
    return results.where("status = 'FAIL'").select(
        "target_record_key", "rule_code", F.lit("OPEN").alias("incident_status"), F.col("severity").alias("impact_level"), F.lit(OWNER).alias("assigned_to"),
        F.lit(as_of).alias("opened_at"), F.col("failure_reason").alias("resolution_notes"))


def route_by_severity(judged: DataFrame, run_id: int, target_table: str, as_of: dt.datetime) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(allowed rows, quarantine rows, job events).

    CRITICAL blocks with an ERROR event; HIGH blocks, quarantines and warns; MEDIUM
    and LOW only warn.
    """
    blocked = F.exists("verdicts", lambda v: v.status == "FAIL")
    allowed = judged.where(~blocked).drop("verdicts")
    body = [c for c in judged.columns if c not in ("verdicts", "record_key", "is_duplicate", "prior_close")]
    record = text.jsonify_record(**{c: F.col(c) for c in body})
    bad = _failed(judged.withColumn("_record", record), "_record")
    quarantine = bad.where("severity = 'HIGH'").select(
        F.lit(target_table).alias("target_table"), "rule_code", "record_key", F.lit(as_of).alias("captured_at"), F.col("_record").alias("record"))
    kind = F.when(F.col("severity") == "CRITICAL", "critical_quality_failure").when(F.col("severity") == "HIGH", "quarantined_record").otherwise("quality_warning")
    events = bad.select(
        F.lit(run_id).alias("pipeline_run_id"), F.lit(target_table).alias("job_name"),
        F.when(F.col("severity") == "CRITICAL", "ERROR").otherwise("WARN").alias("event_type"), F.lit(as_of).alias("event_ts"),
        F.concat(kind, F.lit(" rule="), F.col("rule_code"), F.lit(" key="), F.col("record_key")).alias("message"))
    return allowed, quarantine, events


def batch_counts(judged: DataFrame) -> DataFrame:
    """One row: rows in, rows out, failed rows."""
    blocked = F.exists("verdicts", lambda v: v.status == "FAIL")
    return judged.agg(F.count(F.lit(1)).alias("row_count_in"), F.count_if(~blocked).alias("row_count_out"), F.count_if(blocked).alias("failed_count"))


def lineage_rollup(counts: DataFrame, run_id: int, source: str, target: str, transform: str, as_of: dt.datetime) -> DataFrame:
    """Lineage row of a batch; out = max(in - failed, 0)."""
    return counts.select(
        F.lit(run_id).alias("pipeline_run_id"), F.lit(source).alias("source_asset"), F.lit(target).alias("target_asset"), F.lit(transform).alias("transform_id"),
        F.col("row_count_in").alias("record_count_in"), F.greatest(F.col("row_count_in") - F.col("failed_count"), F.lit(0)).alias("record_count_out"), F.lit(as_of).alias("lineage_ts"))


def process_batch(rows: DataFrame, curated: DataFrame, rules: list[Rule], run_id: int, source: str, target: str, transform: str, as_of: dt.datetime) -> dict[str, DataFrame]:
    """The whole gate: allowed rows, quarantine, results, incidents, events, counts, lineage."""
    judged = judge(prepare(rows, curated), rules)
    results = evaluate_rules(judged, run_id, target, as_of)
    allowed, quarantine, events = route_by_severity(judged, run_id, target, as_of)
    counts = batch_counts(judged)
    return {
        "allowed": allowed, "quarantine": quarantine, "results": results, "incidents": open_incident_rows(results, as_of), "events": events,
        "counts": counts, "lineage": lineage_rollup(counts, run_id, source, target, transform, as_of),
    }


def contract_incidents(rejected: DataFrame, target_table: str, as_of: dt.datetime) -> tuple[DataFrame, DataFrame]:
    """Contract rejects as FAIL results and MEDIUM incidents of one rule."""
    key = F.coalesce("symbol", F.lit("unknown"))
    code = F.lit("RAW_CONTRACT_VALIDATION_FAILED")
    results = rejected.select(code.alias("rule_code"), F.lit(target_table).alias("target_table"), key.alias("target_record_key"), F.lit("FAIL").alias("status"),
                              F.col("reason").alias("failure_reason"), F.lit(as_of).alias("evaluated_at"))
    incidents = rejected.select(code.alias("rule_code"), key.alias("target_record_key"), F.lit("OPEN").alias("incident_status"), F.lit("MEDIUM").alias("impact_level"),
                                F.lit(OWNER).alias("assigned_to"), F.lit(as_of).alias("opened_at"), F.col("reason").alias("resolution_notes"))
    return results, incidents
