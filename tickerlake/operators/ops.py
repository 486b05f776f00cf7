"""Pipeline runs, job events, SLA breaches and constraint audits."""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickerlake import schemas
from tickerlake.functions import dates, text

# --- fixed values -----------------------------------------------------------
# source, pipeline, fetch time and raw-write deadline (IST)
SCHEDULE = [("NSE_EOD", "nse_eod_ingest", "18:30", "20:00"), ("BSE_EOD", "bse_eod_ingest", "19:00", "20:00")]
SLA_TYPE = "RAW_WRITE_BY_20_00_IST"
SLA_EXPECTED = 2000
MAX_ATTEMPTS = 3
# ----------------------------------------------------------------------------


def expected_runs(spark: SparkSession, start: dt.date, end: dt.date) -> DataFrame:
    """Weekday schedule of both sources: source_system, pipeline_name, trade_date,
    scheduled_at and deadline as UTC instants."""
    jobs = F.array(*[F.struct(*[F.lit(v).alias(n) for v, n in zip(j, ("source_system", "pipeline_name", "fetch", "due"))]) for j in SCHEDULE])
    days = spark.range(1).select(F.explode(F.sequence(F.lit(start), F.lit(end))).alias("trade_date")).where(dates.is_weekday(F.col("trade_date")))
    return days.select("trade_date", F.explode(jobs).alias("j")).select(
        "j.source_system", "j.pipeline_name", "trade_date", dates.ist_deadline(F.col("trade_date"), F.col("j.fetch")).alias("scheduled_at"),
        dates.ist_deadline(F.col("trade_date"), F.col("j.due")).alias("deadline"))


def sla_breaches(expected: DataFrame, runs: DataFrame, existing: DataFrame, as_of: dt.datetime) -> tuple[DataFrame, DataFrame]:
    """(new breaches, WARN events) of raw writes not confirmed by the deadline.

    ``runs``: pipeline_run_id, pipeline_name, trade_date, confirmed_at (null = not
    written).  A missing run is a breach too, with a null run id.  A run already
    breached is not reported again.
    """
    j = expected.join(runs, ["pipeline_name", "trade_date"], "left")
    late = j.where(F.col("confirmed_at").isNull() | (F.col("confirmed_at") > F.col("deadline")))
    known = existing.where(F.col("sla_type") == SLA_TYPE).select("pipeline_run_id")
    new = late.join(known, "pipeline_run_id", "left_anti")
    breaches = new.select("pipeline_run_id", F.lit(SLA_TYPE).alias("sla_type"), F.col("pipeline_name").alias("service_name"), "trade_date",
                          F.lit(SLA_EXPECTED).alias("expected_value"), F.lit(as_of).alias("breach_detected_at"), F.lit("OPEN").alias("status"))
    events = new.select("pipeline_run_id", F.concat("pipeline_name", F.lit("_sla")).alias("job_name"), F.lit("WARN").alias("event_type"), F.lit(as_of).alias("event_ts"),
                        F.concat(F.lit("SLA breach for "), F.col("source_system"), F.lit(" on "), F.col("trade_date").cast("string")).alias("message"),
                        text.payload_json(deadline=F.col("deadline").cast("string")).alias("metrics_payload"))
    return breaches, events


def retry_exhaustion_incidents(events: DataFrame, as_of: dt.datetime) -> DataFrame:
    """HIGH incident of each run whose last event is a retryable FAILED."""
    cols = ["event_type", "message", "metrics_payload"]
    last = events.groupBy("pipeline_run_id").agg(F.max_by(F.struct(*cols), F.struct("event_ts", "job_event_id")).alias("_e")).select("pipeline_run_id", "_e.*")
    retryable = F.get_json_object("metrics_payload", "$.retryable") == "true"
    attempt = F.get_json_object("metrics_payload", "$.attempt")
    return last.where((F.col("event_type") == "FAILED") & retryable).select(
        "pipeline_run_id", F.lit("CONNECTOR_RETRY_EXHAUSTED").alias("rule_code"), F.lit("FAIL").alias("status"), F.lit("HIGH").alias("impact_level"),
        F.lit("OPEN").alias("incident_status"), F.col("message").alias("failure_reason"), text.payload_json(attempt=attempt).alias("measured_value"),
        text.payload_json(max_attempts=F.lit(MAX_ATTEMPTS)).alias("threshold_value"), F.lit(as_of).alias("opened_at"))


def run_log_rows(batches: DataFrame, as_of: dt.datetime) -> tuple[DataFrame, DataFrame]:
    """(run rows, event rows) of a set of finished batches.

    ``batches``: pipeline_run_id, pipeline_name, started_at, row_count_in,
    row_count_out, error (null when the batch went well).
    """
    bad = F.col("error").isNotNull()
    runs = batches.select("pipeline_run_id", "pipeline_name", F.lit("SCHEDULED").alias("run_mode"), F.lit("SYSTEM").alias("triggered_by"),
                          F.when(bad, "FAILED").otherwise("SUCCESS").alias("status"), "started_at", F.lit(as_of).alias("ended_at"))
    load = text.payload_json(row_count_in=F.col("row_count_in"), row_count_out=F.col("row_count_out"))
    first = F.struct(F.lit("START").alias("event_type"), F.col("started_at").alias("event_ts"), F.concat(F.col("pipeline_name"), F.lit(" started")).alias("message"), F.lit(None).cast("string").alias("metrics_payload"))
    last = F.struct(F.when(bad, "FAILED").otherwise("END").alias("event_type"), F.lit(as_of).cast("timestamp").alias("event_ts"),
                    F.when(bad, F.concat(F.lit("run_failed: "), F.col("error"))).otherwise(F.lit("raw_write_confirmed")).alias("message"), F.when(~bad, load).alias("metrics_payload"))
    events = batches.select("pipeline_run_id", F.col("pipeline_name").alias("job_name"), F.explode(F.array(first, last)).alias("_e")).select("pipeline_run_id", "job_name", "_e.*")
    return runs, events


def retry_rows(attempts: DataFrame) -> DataFrame:
    """RETRY events of failed attempts that were tried again.

    ``attempts``: pipeline_run_id, pipeline_name, attempt, error, event_ts; attempts beyond MAX_ATTEMPTS - 1 end a
    run and belong to its FAILED event.
    """
    wait = dates.retry_delay_schedule(F.col("attempt"))
    load = text.payload_json(attempt=F.col("attempt"), max_attempts=F.lit(MAX_ATTEMPTS), delay_seconds=wait)
    return attempts.where(F.col("attempt") < MAX_ATTEMPTS).select(
        "pipeline_run_id", F.col("pipeline_name").alias("job_name"), F.lit("RETRY").alias("event_type"), "event_ts",
        F.concat(F.lit("retrying_after_failure: "), F.col("error")).alias("message"), load.alias("metrics_payload"))


def _group_check(df: DataFrame, table: str, cols: list[str]) -> DataFrame:
    full = reduce(lambda a, c: a & F.col(c).isNotNull(), cols[1:], F.col(cols[0]).isNotNull())
    return df.where(full).groupBy(*cols).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(
        F.lit(table).alias("table_name"), F.lit("UNIQUE").alias("kind"), F.lit(",".join(cols)).alias("rule"), (F.col("_n") - 1).alias("violations"))


def constraint_audit(tables: dict[str, DataFrame]) -> DataFrame:
    """CHECK, NOT NULL, UNIQUE and foreign-key violations of the given tables.

    Spark enforces none of these; the rules come from ``schemas``.  One row per
    broken rule with its number of violating rows.
    """
    parts: list[DataFrame] = []
    for name, df in tables.items():
        spec = schemas.TABLES[name]
        have = set(df.columns)
        rules: list[tuple[str, str, Column]] = [
            ("NOT_NULL", c, F.col(c).isNull()) for c in spec.required if c in have
        ] + [("CHECK", e, ~F.expr(e)) for e in spec.checks if schemas.columns_of(e) <= have]
        if rules:
            counted = df.agg(*[F.count_if(cond).alias(f"_c{i}") for i, (_, _, cond) in enumerate(rules)])
            items = F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(r).alias("rule"), F.col(f"_c{i}").alias("violations")) for i, (k, r, _) in enumerate(rules)])
            parts.append(counted.select(F.lit(name).alias("table_name"), F.explode(items).alias("_r")).select("table_name", "_r.*").where("violations > 0"))
        for cols in [[spec.key], *spec.unique]:
            if set(cols) <= have:
                parts.append(_group_check(df, name, cols).groupBy("table_name", "kind", "rule").agg(F.sum("violations").alias("violations")))
        for col, (target, ref) in spec.foreign.items():
            if col in have and target in tables:
                gone = df.where(F.col(col).isNotNull()).join(tables[target].select(F.col(ref).alias(col)).distinct(), col, "left_anti")
                parts.append(gone.agg(F.count(F.lit(1)).alias("violations")).where("violations > 0").select(
                    F.lit(name).alias("table_name"), F.lit("FOREIGN_KEY").alias("kind"), F.lit(f"{col}->{target}.{ref}").alias("rule"), "violations"))
    return reduce(DataFrame.unionByName, parts)
