"""Queries on quality, compliance, operations and the serving layer."""

import datetime as dt
from functools import reduce

from pyspark.sql import functions as F

from tickerlake.functions import dates, text
from tickerlake.operators import compliance, merge, ops, quality, serving, timejoin
from tickerlake.plans import bindings as b
from tickerlake.plans import sqlparts_ops  # noqa: F401
from tickerlake.plans.registry import register
from tickerlake.session import work_dir
from tickerlake.sources import bucketed

NOW = dt.datetime(2024, 1, 25, 12, 0)
REQUIRED = ["instrument_id", "open_px", "event_ts"]


def _rules(rows):
    return quality.builtin_rules(rows.columns, REQUIRED, NOW)


def _judged(spark, sf):
    rows = b.feed(spark, sf)
    return quality.judge(quality.prepare(rows, b.feed_curated(spark, sf)), _rules(rows))


def _gate(spark, sf):
    rows = b.feed(spark, sf)
    return quality.process_batch(rows, b.feed_curated(spark, sf), _rules(rows), 7, "raw_feed", "market_ohlcv_1d", "gate_v1", NOW)


@register("duplicate_semi", "SELECT event_id, dup AS is_duplicate FROM feed_rules")
def duplicates(spark, sf):
    return quality.duplicate_semi(b.feed(spark, sf), b.feed_curated(spark, sf)).select("event_id", "is_duplicate")


@register("record_key", "SELECT event_id, rkey AS record_key FROM feed_rules")
def record_key(spark, sf):
    return b.feed(spark, sf).select("event_id", text.record_key(F.col("instrument_id"), F.col("symbol"), F.col("trade_date"), F.col("source_system")).alias("record_key"))


@register("missing_fields_list", "SELECT event_id, concat_ws(',', CASE WHEN instrument_id IS NULL THEN 'instrument_id' END, CASE WHEN open_c IS NULL THEN 'open_px' END, CASE WHEN event_ts IS NULL THEN 'event_ts' END) AS missing FROM feed")
def missing(spark, sf):
    return b.feed(spark, sf).select("event_id", quality.missing_fields_list(REQUIRED).alias("missing"))


def _register_rule(name: str, code: str, pick):
    @register(name, f"SELECT event_id, why AS failure_reason FROM verdicts WHERE rule_code = '{code}' AND why IS NOT NULL")
    def one(spark, sf):
        rows = quality.prepare(b.feed(spark, sf), b.feed_curated(spark, sf))
        r = pick(rows)
        return rows.where(F.coalesce(r.failed, F.lit(False))).select("event_id", r.reason.alias("failure_reason"))


_register_rule("rule_null_check", "NULL_CHECK_V1", lambda rows: quality.rule_null_check(REQUIRED))
_register_rule("rule_range_check", "RANGE_CHECK_V1", lambda rows: quality.rule_range_check(rows.columns))
_register_rule("rule_stale_check", "STALE_CHECK_V1", lambda rows: quality.rule_stale_check(NOW))
_register_rule("rule_duplicate_check", "DUPLICATE_CHECK_V1", lambda rows: quality.rule_duplicate_check())
_register_rule("rule_symbol_resolved", "SYMBOL_RESOLVED_CHECK_V1", lambda rows: quality.rule_symbol_resolved())
_register_rule("rule_circuit_breaker", "CIRCUIT_BREAKER_V1", lambda rows: quality.rule_circuit_breaker())


@register("evaluate_rules", "SELECT rkey AS target_record_key, rule_code, severity, CASE WHEN why IS NULL THEN 'PASS' ELSE 'FAIL' END AS status, why AS failure_reason FROM verdicts")
def evaluate(spark, sf):
    return quality.evaluate_rules(_judged(spark, sf), 7, "market_ohlcv_1d", NOW).select("target_record_key", "rule_code", "severity", "status", "failure_reason")


@register("route_by_severity", "SELECT event_id FROM blocked WHERE NOT bad")
def route(spark, sf):
    return _gate(spark, sf)["allowed"].select("event_id")


@register("quarantine_rows", "SELECT rkey AS record_key, rule_code FROM verdicts WHERE why IS NOT NULL AND severity = 'HIGH'")
def quarantine(spark, sf):
    return _gate(spark, sf)["quarantine"].select("record_key", "rule_code")


@register("gate_events", """
SELECT CASE WHEN severity = 'CRITICAL' THEN 'ERROR' ELSE 'WARN' END AS event_type, CASE WHEN severity = 'CRITICAL' THEN 'critical_quality_failure' ELSE 'quarantined_record' END || ' rule=' || rule_code || ' key=' || rkey AS message
FROM verdicts WHERE why IS NOT NULL""")
def gate_events(spark, sf):
    return _gate(spark, sf)["events"].select("event_type", "message")


@register("open_incident_rows", "SELECT rkey AS target_record_key, rule_code, severity AS impact_level, why AS resolution_notes FROM verdicts WHERE why IS NOT NULL")
def incident_rows(spark, sf):
    return _gate(spark, sf)["incidents"].select("target_record_key", "rule_code", "impact_level", "resolution_notes")


@register("batch_counts", "SELECT count(*) AS row_count_in, count(*) FILTER (NOT bad) AS row_count_out, count(*) FILTER (bad) AS failed_count FROM blocked")
def counts(spark, sf):
    return quality.batch_counts(_judged(spark, sf))


@register("lineage_rollup", "SELECT count(*) AS record_count_in, greatest(count(*) - count(*) FILTER (bad), 0) AS record_count_out, 'gate_v1' AS transform_id FROM blocked")
def lineage(spark, sf):
    return _gate(spark, sf)["lineage"].select("record_count_in", "record_count_out", "transform_id")


@register("process_batch", """
SELECT 'allowed' AS output, CAST(event_id AS VARCHAR) AS k, NULL AS what FROM blocked WHERE NOT bad
UNION ALL SELECT 'quarantine', rkey, rule_code FROM verdicts WHERE why IS NOT NULL AND severity = 'HIGH'
UNION ALL SELECT 'results', rkey, concat_ws(' ', rule_code, severity, CASE WHEN why IS NULL THEN 'PASS' ELSE 'FAIL' END, why) FROM verdicts
UNION ALL SELECT 'incidents', rkey, concat_ws(' ', rule_code, severity, why) FROM verdicts WHERE why IS NOT NULL
UNION ALL SELECT 'events', CASE WHEN severity = 'CRITICAL' THEN 'critical_quality_failure' ELSE 'quarantined_record' END || ' rule=' || rule_code || ' key=' || rkey, CASE WHEN severity = 'CRITICAL' THEN 'ERROR' ELSE 'WARN' END FROM verdicts WHERE why IS NOT NULL
UNION ALL SELECT 'counts', CAST(count(*) AS VARCHAR), count(*) FILTER (NOT bad) || ' ' || count(*) FILTER (bad) FROM blocked
UNION ALL SELECT 'lineage', CAST(count(*) AS VARCHAR), greatest(count(*) - count(*) FILTER (bad), 0) || ' gate_v1' FROM blocked""")
def process_batch(spark, sf):
    gate, line = _gate(spark, sf), lambda *names: F.concat_ws(" ", *(F.col(n).cast("string") for n in names))
    shown = {
        "allowed": ("event_id", F.lit(None).cast("string")), "quarantine": ("record_key", F.col("rule_code")), "results": ("target_record_key", line("rule_code", "severity", "status", "failure_reason")),
        "incidents": ("target_record_key", line("rule_code", "impact_level", "resolution_notes")), "events": ("message", F.col("event_type")),
        "counts": ("row_count_in", line("row_count_out", "failed_count")), "lineage": ("record_count_in", line("record_count_out", "transform_id")),
    }
    parts = [gate[name].select(F.lit(name).alias("output"), F.col(k).cast("string").alias("k"), what.alias("what")) for name, (k, what) in shown.items()]
    return reduce(lambda x, y: x.unionByName(y), parts)


@register("jsonify_record", """
SELECT event_id, '{"event_id":"' || event_id || '","symbol":' || coalesce('"' || symbol || '"', 'null') || ',"trade_date":"' || CAST(trade_date AS VARCHAR) || '"}' AS record FROM feed""")
def jsonify(spark, sf):
    return b.feed(spark, sf).select("event_id", text.jsonify_record(event_id=F.col("event_id"), symbol=F.col("symbol"), trade_date=F.col("trade_date")).alias("record"))


@register("sync_rules", """
SELECT rule_code, CASE WHEN dq_rule_id IN (1, 2) THEN true WHEN dq_rule_id IN (4, 5) THEN false ELSE true END AS is_active,
 CASE WHEN dq_rule_id IN (1, 2) THEN 'REFRESHED' WHEN dq_rule_id IN (4, 5) THEN 'DEACTIVATED' ELSE 'UNCHANGED' END AS change FROM rules
UNION ALL SELECT 'RULE_' || k, true, 'INSERTED' FROM (SELECT unnest([101, 102]) AS k)""")
def sync_rules(spark, sf):
    r = b.rules(spark, sf).withColumn("rule_name", F.concat(F.lit("n"), F.col("dq_rule_id") % 3)).withColumn("rule_expression", F.lit("x")).withColumn("is_active", F.lit(True)).withColumn("updated_at", F.lit(NOW))
    r = r.drop("dq_rule_id").withColumn("rule_name", F.when(F.col("rule_code").isin("RULE_3", "RULE_6"), "other").otherwise(F.col("rule_name")))
    new = r.where("rule_code in ('RULE_1', 'RULE_2')").withColumn("rule_code", F.concat("rule_code"))
    more = new.withColumn("rule_code", F.regexp_replace("rule_code", "RULE_", "RULE_10"))
    return merge.sync_rules(r, new.unionByName(more).drop("is_active", "updated_at"), NOW).select("rule_code", "is_active", "change")


OVR = """
SELECT event_id AS seq, event_id + 1000000 AS dq_incident_id, user_id AS approved_by_user_id, CASE WHEN event_id % 4 = 0 THEN '  short ' ELSE 'long enough text ' || event_id END AS justification FROM events"""


def _overrides(spark, sf):
    o = b.table(spark, sf, "events").selectExpr("event_id as override_seq", "event_id + 1000000 as dq_incident_id", "user_id as approved_by_user_id",
                                                "case when event_id % 4 = 0 then '  short ' else concat(' long enough text ', event_id) end as justification")
    users = b.table(spark, sf, "events").where("user_id % 10 <> 3").selectExpr("user_id").distinct()
    return merge.apply_overrides(b.incidents(spark, sf), users, o, NOW)


@register("apply_overrides", """
SELECT dq_incident_id, CASE WHEN event_id % 4 <> 0 AND user_id % 10 <> 3 THEN 'RESOLVED' ELSE incident_status END AS incident_status,
 CASE WHEN event_id % 4 <> 0 AND user_id % 10 <> 3 THEN 'long enough text ' || event_id END AS resolution_notes FROM incidents JOIN events ON event_id = dq_result_id""")
def apply_overrides(spark, sf):
    return _overrides(spark, sf)[0].select("dq_incident_id", "incident_status", "resolution_notes")


@register("apply_overrides_errors", """
SELECT event_id AS override_seq, CASE WHEN event_id % 4 = 0 THEN 'JUSTIFICATION_TOO_SHORT' WHEN event_type <> 'error' THEN 'UNKNOWN_INCIDENT' ELSE 'UNKNOWN_APPROVER' END AS error FROM events
WHERE event_id % 4 = 0 OR event_type <> 'error' OR user_id % 10 = 3""")
def override_errors(spark, sf):
    return _overrides(spark, sf)[2].select("override_seq", "error")


# --- compliance -----------------------------------------------------------------------------


def _decided(spark, sf):
    return compliance.compliance_decisions(b.policy_requests(spark, sf), b.policies(spark, sf))


@register("compliance_decisions", "SELECT doc_id, decision, decision = 'allowed' AS allowed FROM decisions")
def decisions(spark, sf):
    return _decided(spark, sf).select("doc_id", "decision", "allowed")


@register("compliance_filter", "SELECT doc_id FROM decisions WHERE request_id IN (SELECT request_id FROM decisions GROUP BY 1 HAVING bool_and(decision = 'allowed'))")
def compliance_filter(spark, sf):
    return compliance.compliance_filter(b.policy_requests(spark, sf), _decided(spark, sf)).select("doc_id")


@register("compliance_audit", """
SELECT user_id, CASE WHEN decision = 'allowed' THEN 'COMPLIANCE_POLICY_ALLOW' ELSE 'COMPLIANCE_POLICY_BLOCK' END AS event_type, coalesce(resource_id, source_name) AS resource_id, decision,
 CASE WHEN attr THEN 'Source: ' || source_name END AS required_attribution FROM decisions WHERE source_name IS NOT NULL""")
def audit(spark, sf):
    a = compliance.compliance_audit(_decided(spark, sf), NOW)
    return a.select("user_id", "event_type", "resource_id", F.get_json_object("event_payload", "$.decision").alias("decision"), F.get_json_object("event_payload", "$.required_attribution").alias("required_attribution"))


@register("distinct_sources", "SELECT DISTINCT source AS source_system FROM documents")
def sources(spark, sf):
    return serving.distinct_sources(b.table(spark, sf, "documents").withColumnRenamed("source", "source_system"))


# --- operations -----------------------------------------------------------------------------


def _expected(spark, sf):
    return ops.expected_runs(spark, dt.date(2024, 1, 1), dt.date(2024, 1, 31))


@register("expected_runs", """
SELECT source_system, pipeline_name, CAST(d AS VARCHAR) AS trade_date, CAST(CAST(d AS TIMESTAMP) + to_minutes(m) AS VARCHAR) AS scheduled_at, CAST(CAST(d AS TIMESTAMP) + INTERVAL 870 MINUTE AS VARCHAR) AS deadline, n
FROM (SELECT CAST(unnest(generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-31', INTERVAL 1 DAY)) AS DATE) AS d), (VALUES ('NSE_EOD', 'nse_eod_ingest', 780), ('BSE_EOD', 'bse_eod_ingest', 810)) j(source_system, pipeline_name, m)
LEFT JOIN (SELECT pipeline_name, trade_date, count(*) AS n FROM source_runs GROUP BY 1, 2) r ON r.pipeline_name = j.pipeline_name AND r.trade_date = d WHERE isodow(d) <= 5""".replace("SELECT source_system, pipeline_name, CAST", "SELECT source_system, j.pipeline_name, CAST"))
def expected(spark, sf):
    seen = b.source_runs(spark, sf).groupBy("pipeline_name", "trade_date").agg(F.count(F.lit(1)).alias("n"))
    return _expected(spark, sf).join(seen, ["pipeline_name", "trade_date"], "left")


@register("sla_breaches", """
SELECT r.pipeline_run_id, j.pipeline_name AS service_name, CAST(d AS VARCHAR) AS trade_date
FROM (SELECT CAST(unnest(generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-31', INTERVAL 1 DAY)) AS DATE) AS d), (VALUES ('nse_eod_ingest'), ('bse_eod_ingest')) j(pipeline_name)
LEFT JOIN source_runs r ON r.pipeline_name = j.pipeline_name AND r.trade_date = d WHERE isodow(d) <= 5 AND (confirmed_at IS NULL OR confirmed_at > CAST(d AS TIMESTAMP) + INTERVAL 870 MINUTE)
AND (r.pipeline_run_id IS NULL OR r.pipeline_run_id % 5 <> 0)""")
def sla(spark, sf):
    runs = b.source_runs(spark, sf)
    known = runs.where("pipeline_run_id % 5 = 0").select("pipeline_run_id", F.lit(ops.SLA_TYPE).alias("sla_type"))
    return ops.sla_breaches(_expected(spark, sf), runs, known, NOW)[0].select("pipeline_run_id", "service_name", "trade_date")


@register("retry_exhaustion_incidents", """
SELECT pipeline_run_id, message AS failure_reason FROM (SELECT *, row_number() OVER (PARTITION BY pipeline_run_id ORDER BY event_ts DESC, job_event_id DESC) AS k FROM job_events) WHERE k = 1 AND event_type = 'FAILED' AND retryable""")
def retry(spark, sf):
    return ops.retry_exhaustion_incidents(b.job_events(spark, sf), NOW).select("pipeline_run_id", "failure_reason")


@register("retry_delay_schedule", "SELECT event_id, least(5.0::DOUBLE * pow(2, greatest(event_id % 12 - 1, 0)), 300) AS delay FROM events")
def delays(spark, sf):
    return b.table(spark, sf, "events").select("event_id", dates.retry_delay_schedule(F.col("event_id") % 12).alias("delay"))


@register("run_log_rows", """
SELECT pipeline_run_id, pipeline_name AS job_name, 'START' AS event_type, pipeline_name || ' started' AS message FROM runs
UNION ALL SELECT pipeline_run_id, pipeline_name, CASE WHEN status = 'FAILED' THEN 'FAILED' ELSE 'END' END, CASE WHEN status = 'FAILED' THEN 'run_failed: boom' ELSE 'raw_write_confirmed' END FROM runs""")
def run_log(spark, sf):
    batches = b.pipeline_run_rows(spark, sf).select("pipeline_run_id", "pipeline_name", "started_at", "row_count_in", F.col("row_count_in").alias("row_count_out"), F.expr("case when status = 'FAILED' then 'boom' end").alias("error"))
    return ops.run_log_rows(batches, NOW)[1].select("pipeline_run_id", "job_name", "event_type", "message")


@register("run_log_retries", """
SELECT pipeline_run_id, pipeline_name AS job_name, 'RETRY' AS event_type, 'retrying_after_failure: boom' AS message, '{"attempt":' || a || ',"max_attempts":3,"delay_seconds":' || CASE a WHEN 1 THEN '5.0' ELSE '10.0' END || '}' AS metrics_payload
FROM runs, (SELECT unnest([1, 2]) AS a) WHERE status = 'FAILED'""")
def run_log_retries(spark, sf):
    failed = b.pipeline_run_rows(spark, sf).where("status = 'FAILED'")
    attempts = failed.select("pipeline_run_id", "pipeline_name", F.explode(F.array(F.lit(1), F.lit(2))).alias("attempt"), F.lit("boom").alias("error"), F.col("started_at").alias("event_ts"))
    return ops.retry_rows(attempts).select("pipeline_run_id", "job_name", "event_type", "message", "metrics_payload")


@register("pipeline_runs", "SELECT pipeline_run_id, status FROM runs WHERE status = 'FAILED' AND pipeline_name = 'nse_eod_ingest'")
def pipeline_runs(spark, sf):
    return serving.pipeline_runs(b.pipeline_run_rows(spark, sf), "failed", "nse_eod_ingest").select("pipeline_run_id", "status")


@register("pipeline_run_detail", "SELECT r.pipeline_run_id, status, job_event_id, event_type, r.pipeline_run_id IN (SELECT pipeline_run_id FROM breaches) AS sla_breach FROM runs r LEFT JOIN job_events e USING (pipeline_run_id)")
def run_detail(spark, sf):
    return serving.pipeline_run_detail(b.pipeline_run_rows(spark, sf), b.job_events(spark, sf), b.breaches(spark, sf)).select("pipeline_run_id", "status", "job_event_id", "event_type", "sla_breach")


DURATION = """CASE WHEN s < 60 THEN s || 's' WHEN s // 60 < 60 THEN (s // 60) || 'm ' || (s % 60) || 's' ELSE (s // 3600) || 'h ' || (s // 60 % 60) || 'm' END"""


@register("pipeline_health", f"""
SELECT pipeline_run_id, status, {DURATION} AS duration, CASE WHEN pipeline_run_id IN (SELECT pipeline_run_id FROM breaches) THEN 'YES' ELSE '' END AS sla_breach FROM (
SELECT *, CAST(floor((epoch_us(coalesce(ended_at, TIMESTAMP '2024-02-01')) - epoch_us(started_at)) / 1000000) AS BIGINT) AS s FROM runs ORDER BY started_at DESC, pipeline_run_id DESC LIMIT 10)""")
def health(spark, sf):
    return serving.pipeline_health(b.pipeline_run_rows(spark, sf), b.breaches(spark, sf), dt.datetime(2024, 2, 1)).select("pipeline_run_id", "status", "duration", "sla_breach")


@register("duration_text", f"SELECT pipeline_run_id, {DURATION} AS duration FROM (SELECT *, CAST(floor((epoch_us(coalesce(ended_at, TIMESTAMP '2024-02-01')) - epoch_us(started_at)) / 1000000) AS BIGINT) AS s FROM runs)")
def duration(spark, sf):
    return b.pipeline_run_rows(spark, sf).select("pipeline_run_id", dates.duration_text(F.col("started_at"), F.col("ended_at"), F.lit(dt.datetime(2024, 2, 1))).alias("duration"))


@register("last_activity_status", "SELECT CAST(max(coalesce(ended_at, started_at)) AS VARCHAR) AS last_pipeline_run, CASE WHEN max(coalesce(ended_at, started_at)) >= TIMESTAMP '2024-01-30 12:00:00' THEN 'connected' ELSE 'degraded' END AS status FROM runs")
def last_activity(spark, sf):
    return serving.last_activity_status(b.pipeline_run_rows(spark, sf), dt.datetime(2024, 1, 31, 12))


_OPEN = "FROM star WHERE incident_status = 'OPEN' AND severity = 'HIGH' AND opened_at >= TIMESTAMP '2024-01-10'"


def _open_page(spark, sf):
    return serving.open_incidents(b.incidents(spark, sf), b.incident_results(spark, sf), b.rules(spark, sf), "high", None, dt.date(2024, 1, 10), 2, 50)


@register("open_incidents", f"SELECT dq_incident_id, rule_code {_OPEN} ORDER BY opened_at DESC, dq_incident_id DESC LIMIT 50 OFFSET 50")
def open_incidents(spark, sf):
    return _open_page(spark, sf)[0].select("dq_incident_id", "rule_code")


@register("open_incidents_total", f"SELECT count(*) AS total {_OPEN}")
def open_incidents_total(spark, sf):
    return _open_page(spark, sf)[1]


@register("incident_detail", "SELECT dq_incident_id, incident_status, severity, domain_name, rule_code, target_record_key, failure_reason FROM star")
def incident_detail(spark, sf):
    return serving.incident_detail(b.incidents(spark, sf), b.incident_results(spark, sf), b.rules(spark, sf)).select(
        "dq_incident_id", "incident_status", "severity", "domain_name", "rule_code", "target_record_key", "failure_reason")


@register("key_contains_lookup", """
SELECT dq_result_id, coalesce((SELECT min_by(symbol, instrument_id) FROM instruments i WHERE contains(r.target_record_key, i.instrument_uuid)), nullif(target_record_key, ''), 'Unknown') AS instrument FROM incident_results r""")
def key_contains(spark, sf):
    return serving.key_contains_lookup(b.incident_results(spark, sf), b.instruments(spark, sf)).select("dq_result_id", "instrument")


@register("open_incidents_by_instrument", """
SELECT instrument_id, count(*) AS open_incidents FROM star JOIN instruments i ON contains(target_record_key, i.instrument_uuid) WHERE incident_status = 'OPEN' GROUP BY 1""")
def open_by_instrument(spark, sf):
    return serving.open_incidents_by_instrument(b.incidents(spark, sf), b.incident_results(spark, sf), b.instruments(spark, sf))


@register("data_quality_score", "SELECT CASE WHEN count(*) FILTER (incident_status IN ('OPEN', 'IN_PROGRESS')) > 0 THEN 20.0::DOUBLE ELSE 85.0::DOUBLE END AS data_quality_score FROM incidents")
def dq_score(spark, sf):
    return serving.data_quality_score(b.incidents(spark, sf))


@register("count_total", "SELECT count(*) AS total FROM star WHERE domain_name = 'MARKET'")
def count_total(spark, sf):
    return serving.count_total(serving.incident_detail(b.incidents(spark, sf), b.incident_results(spark, sf), b.rules(spark, sf)).where("domain_name = 'MARKET'"))


@register("paginate", "SELECT val_run_id, status FROM val_runs ORDER BY as_of_ts DESC, val_run_id DESC LIMIT 200 OFFSET 400")
def paginate(spark, sf):
    return serving.paginate(b.val_runs(spark, sf), 3, 200, [F.desc("as_of_ts"), F.desc("val_run_id")])[0].select("val_run_id", "status")


@register("batch_summary", """
SELECT count(*) FILTER (status <> 'FAILED') AS instruments_processed, count(*) FILTER (status = 'FAILED') AS instruments_skipped, CAST(sum(CASE WHEN status <> 'FAILED' THEN row_count_in ELSE 0 END) AS BIGINT) AS statements_stored,
 CAST(sum(CASE WHEN status <> 'FAILED' THEN 2 * row_count_in ELSE 0 END) AS BIGINT) AS metrics_computed FROM runs""")
def batch_summary(spark, sf):
    r = b.pipeline_run_rows(spark, sf).select((F.col("status") == "FAILED").alias("skipped"), F.col("row_count_in").alias("statements_stored"), (F.col("row_count_in") * 2).alias("metrics_computed"))
    return serving.batch_summary(r)


@register("batch_skip_reasons", "SELECT 'I' || pipeline_run_id || ': ' || pipeline_name || ' failed' AS skip_line FROM runs WHERE status = 'FAILED'")
def batch_skip_reasons(spark, sf):
    r = b.pipeline_run_rows(spark, sf).select((F.col("status") == "FAILED").alias("skipped"), F.concat(F.lit("I"), "pipeline_run_id").alias("symbol"), F.concat("pipeline_name", F.lit(" failed")).alias("skip_reason"))
    return serving.skip_reasons(r)


@register("constraint_audit", """
SELECT 'ref_instrument' AS table_name, 'UNIQUE' AS kind, 'exchange_id,symbol,is_active' AS rule, CAST(sum(n - 1) AS BIGINT) AS violations FROM (SELECT count(*) AS n FROM instruments GROUP BY exchange_id, symbol, is_active HAVING count(*) > 1) HAVING sum(n - 1) > 0
UNION ALL SELECT 'market_corporate_action', 'UNIQUE', 'corp_action_id', CAST(sum(n - 1) AS BIGINT) FROM (SELECT count(*) AS n FROM actions GROUP BY corp_action_id HAVING count(*) > 1) HAVING sum(n - 1) > 0
UNION ALL SELECT 'val_attribution', 'CHECK', 'direction IN (''UP'', ''DOWN'', ''NEUTRAL'')', count(*) FROM lineitem WHERE l_linestatus = 'F' HAVING count(*) > 0
UNION ALL SELECT 'val_attribution', 'UNIQUE', 'attribution_id', CAST(sum(n - 1) AS BIGINT) FROM (SELECT count(*) AS n FROM val_attributions GROUP BY attribution_id HAVING count(*) > 1) HAVING sum(n - 1) > 0
UNION ALL SELECT 'val_attribution', 'FOREIGN_KEY', 'val_run_id->val_run.val_run_id', count(*) FROM val_attributions WHERE val_run_id NOT IN (SELECT val_run_id FROM val_runs WHERE val_run_id % 11 <> 0) HAVING count(*) > 0
UNION ALL SELECT 'val_run', 'NOT_NULL', 'status', count(*) FROM val_runs WHERE val_run_id % 11 <> 0 AND status = 'QUEUED' HAVING count(*) > 0""")
def constraints(spark, sf):
    inst = b.instruments(spark, sf).select("instrument_id", "instrument_uuid", "exchange_id", "symbol", "instrument_type", "is_active")
    acts = b.actions(spark, sf).select("corp_action_id", "instrument_id", "action_type", "ex_date", "source_system")
    attr = b.val_attributions(spark, sf).withColumn("direction", F.when(F.col("direction") == "UP", "UPWARD").otherwise(F.col("direction")))
    runs = b.val_runs(spark, sf).where("val_run_id % 11 <> 0").select("val_run_id", "run_uuid", "as_of_ts", F.when(F.col("status") != "QUEUED", F.col("status")).alias("status"))
    return ops.constraint_audit({"ref_instrument": inst, "market_corporate_action": acts, "val_attribution": attr, "val_run": runs})


# --- stored valuations ------------------------------------------------------------------------


@register("valuation_list_filter", "SELECT val_run_id FROM val_runs WHERE as_of_ts >= TIMESTAMP '1996-01-01' AND as_of_ts < TIMESTAMP '1999-01-01' AND val_run_id IN (SELECT val_run_id FROM val_labels WHERE run_label = '2-HIGH')")
def val_filter(spark, sf):
    return serving.valuation_list_filter(b.val_runs(spark, sf), b.val_labels(spark, sf), dt.date(1996, 1, 1), dt.date(1998, 12, 31), "2-HIGH").select("val_run_id")


def _list(spark, sf):
    return serving.valuation_list(b.val_runs(spark, sf), b.val_outputs(spark, sf), b.val_confidence(spark, sf), b.val_labels(spark, sf))


@register("valuation_list", "SELECT val_run_id, status, blended_value, dcf_value, relative_value, confidence_score, run_label FROM val_list")
def valuation_list(spark, sf):
    return _list(spark, sf).select("val_run_id", "status", "blended_value", "dcf_value", "relative_value", "confidence_score", "run_label")


@register("latest_confidence", "SELECT val_run_id, confidence_score FROM conf_last")
def latest_confidence(spark, sf):
    return serving.latest_confidence(b.val_confidence(spark, sf))


@register("valuation_detail", """
SELECT r.val_run_id, coalesce(a.n, 0) AS n_assumptions, o.n AS n_outputs, o.models, coalesce(t.n, 0) AS n_attributions, t.first_driver, c.confidence_score AS last_confidence FROM val_runs r
LEFT JOIN (SELECT val_run_id, 1 + max(k) AS n FROM (SELECT o_orderkey + 1 AS val_run_id, CASE WHEN o_orderkey % 3 <> 0 THEN 1 ELSE 0 END AS k FROM orders) GROUP BY 1) a USING (val_run_id)
LEFT JOIN (SELECT val_run_id, count(*) AS n, string_agg(model_name, ',' ORDER BY model_name) AS models FROM val_outputs GROUP BY 1) o USING (val_run_id)
LEFT JOIN (SELECT val_run_id, count(*) AS n, min(driver_type || '/' || driver_key) AS first_driver FROM val_attributions GROUP BY 1) t USING (val_run_id) LEFT JOIN conf_last c USING (val_run_id)""")
def valuation_detail(spark, sf):
    v = serving.valuation_detail(b.val_runs(spark, sf), b.val_labels(spark, sf), b.val_outputs(spark, sf), b.val_attributions(spark, sf), b.val_confidence(spark, sf))
    def n(c):
        return F.coalesce(F.size(c), F.lit(0)).cast("long")

    return v.select("val_run_id", F.greatest(n("assumption_set"), F.lit(0)).alias("n_assumptions"), n("model_outputs").alias("n_outputs"), F.array_join("model_outputs.model_name", ",").alias("models"),
                    F.greatest(n("attributions"), F.lit(0)).alias("n_attributions"), F.concat_ws("/", F.get("attributions", F.lit(0)).driver_type, F.get("attributions", F.lit(0)).driver_key).alias("fd"),
                    F.element_at("confidence_snapshots", -1).overall_confidence.alias("last_confidence")).withColumn("first_driver", F.nullif("fd", F.lit(""))).drop("fd")


@register("value_bridge", """
SELECT a.val_run_id, driver_type, driver_key, impact AS current_value, prior_value, impact - prior_value AS delta_value FROM val_attributions a JOIN (SELECT val_run_id + 1 AS val_run_id, driver_key, max_by(impact, attribution_id) AS prior_value FROM val_attributions GROUP BY 1, 2) p USING (val_run_id, driver_key)
WHERE a.val_run_id IN (SELECT val_run_id FROM val_runs)""")
def value_bridge(spark, sf):
    pairs = b.val_runs(spark, sf).select("val_run_id", (F.col("val_run_id") - 1).alias("prior_run_id"))
    return serving.value_bridge(b.val_attributions(spark, sf), pairs).select("val_run_id", "driver_type", "driver_key", "current_value", "prior_value", "delta_value")


@register("sensitivity_rows", """
SELECT l_orderkey + 1 AS val_run_id, CASE WHEN l_linestatus = 'F' THEN 'wacc' ELSE 'terminal_growth' END AS assumption_key, 'S' || l_linenumber AS shock_label, CAST(round(l_extendedprice * 100) AS BIGINT) AS result_target_price
FROM lineitem JOIN orders ON o_orderkey = l_orderkey""")
def sensitivity(spark, sf):
    return serving.sensitivity_rows(b.val_sensitivities(spark, sf), b.val_outputs(spark, sf)).select("val_run_id", "assumption_key", "shock_label", "result_target_price")


@register("run_browser", """
SELECT val_run_id, 'C' || instrument_id AS instrument, exchange_code AS exchange, status, status = 'OVERRIDDEN' OR coalesce(confidence_score < 40, false) AS override_required
FROM val_list JOIN customer ON c_custkey = instrument_id JOIN exchanges ON exchange_id = c_nationkey % 3 + 1""")
def run_browser(spark, sf):
    return serving.run_browser(b.value_instruments(spark, sf), b.exchanges(spark, sf), _list(spark, sf)).select("val_run_id", "instrument", "exchange", "status", "override_required")


@register("multi_key_sort", "SELECT val_run_id, driver_type, driver_key FROM val_attributions ORDER BY driver_type, driver_key, val_run_id")
def sort_keys(spark, sf):
    return serving.multi_key_sort(b.val_attributions(spark, sf).select("val_run_id", "driver_type", "driver_key"), [("driver_type", False), ("driver_key", False), ("val_run_id", False)])


@register("top1_by_time", "SELECT instrument_id, max_by(val_run_id, (as_of_ts, val_run_id)) AS val_run_id FROM val_runs GROUP BY 1")
def top1(spark, sf):
    return timejoin.top1_by_time(b.val_runs(spark, sf), ["instrument_id"], "as_of_ts", "val_run_id", ["val_run_id"])


@register("requeue_runs", "SELECT val_run_id, 'QUEUED' AS status FROM val_runs WHERE status IN ('QUEUED', 'RUNNING')")
def requeue(spark, sf):
    return merge.requeue_runs(b.val_runs(spark, sf)).select("val_run_id", "status")


@register("replace_run_artifacts", """
SELECT val_run_id, model_name, CASE WHEN val_run_id % 5 = 0 THEN -1.0::DOUBLE ELSE target_price END AS target_price FROM val_outputs WHERE val_run_id % 5 <> 0 OR model_name = 'DCF'""")
def replace_artifacts(spark, sf):
    o = b.val_outputs(spark, sf)
    new = o.where("val_run_id % 5 = 0 and model_name = 'DCF'").withColumn("target_price", F.lit(-1.0))
    return merge.replace_run_artifacts(o, new).select("val_run_id", "model_name", "target_price")


@register("merge_ohlcv", """
SELECT instrument_id, CAST(trade_date AS VARCHAR) AS trade_date, CAST(CASE WHEN instrument_id % 2 = 0 AND day(trade_date) % 3 = 0 THEN close_px + 1 ELSE close_px END AS DOUBLE) AS close_px FROM bars""")
def merge_ohlcv(spark, sf):
    return _merged(spark, sf)[0].select("instrument_id", "trade_date", "close_px")


def _versions(spark, sf):
    cur = b.bars(spark, sf).withColumn("source_record_id", F.lit("cur"))
    newer = cur.where("instrument_id % 2 = 0").withColumn("close_px", (F.col("close_px") + 1).cast("decimal(18,6)")).withColumn("source_record_id", F.lit("new")).withColumn(
        "ingested_at", F.expr("case when day(trade_date) % 3 = 0 then ingested_at + interval 1 hour when day(trade_date) % 3 = 1 then ingested_at else ingested_at - interval 1 hour end"))
    return cur, newer


def _merged(spark, sf):
    return merge.merge_ohlcv(*_versions(spark, sf), NOW)


MERGED_SQL = "SELECT instrument_id, CAST(trade_date AS VARCHAR) AS trade_date, CAST(CASE WHEN instrument_id % 2 = 0 AND day(trade_date) % 3 = 0 THEN close_px + 1 ELSE close_px END AS DOUBLE) AS close_px, CASE WHEN instrument_id % 2 = 0 AND day(trade_date) % 3 = 0 THEN 'new' ELSE 'cur' END AS source_record_id FROM bars"


def _stored_merge(spark, sf):
    """Bars merged into an empty stored table, then corrections of every second instrument into that."""
    cur, newer = _versions(spark, sf)
    path = work_dir(spark, "bucketed")
    table = bucketed.Bucketed(f"ohlcv_{path[-32:]}", f"{path}/table", slots=2, buckets=bucketed.buckets_for(b.table(spark, sf, "lineitem").count()), period="yyyy")
    bucketed.open_table(spark, table, cur.schema)
    bucketed.merge_into(spark, table, cur, NOW, f"{path}/first")
    return spark.table(table.name), bucketed.merge_into(spark, table, newer, NOW, f"{path}/second")


@register("merge_ohlcv_stored", MERGED_SQL)
def merge_stored(spark, sf):
    return _stored_merge(spark, sf)[0].select("instrument_id", "trade_date", "close_px", "source_record_id")


@register("merge_ohlcv_stored_superseded", "SELECT instrument_id || ':' || CAST(trade_date AS VARCHAR) AS target_record_key, 'WARN' AS status FROM bars WHERE instrument_id % 2 = 0 AND day(trade_date) % 3 = 0")
def merge_stored_superseded(spark, sf):
    return _stored_merge(spark, sf)[1].select("target_record_key", "status")


@register("merge_ohlcv_superseded", "SELECT instrument_id || ':' || CAST(trade_date AS VARCHAR) AS target_record_key, 'WARN' AS status FROM bars WHERE instrument_id % 2 = 0 AND day(trade_date) % 3 = 0")
def merge_superseded(spark, sf):
    return _merged(spark, sf)[1].select("target_record_key", "status")


@register("merge_reference", """
SELECT o_custkey AS k, min(o_orderkey) FILTER (o_orderstatus = 'F') AS cur_id, coalesce(min(o_orderkey) FILTER (o_orderstatus = 'F'), min(o_orderkey) FILTER (o_orderstatus <> 'F')) AS ref_id,
 CASE WHEN count(*) FILTER (o_orderstatus <> 'F') > 0 THEN 'seed' ELSE 'stored' END AS name FROM orders GROUP BY 1""")
def merge_reference(spark, sf):
    o = b.table(spark, sf, "orders")
    cur = o.where("o_orderstatus = 'F'").groupBy(F.col("o_custkey").alias("k")).agg(F.min("o_orderkey").alias("ref_id")).select("ref_id", "k", F.lit("stored").alias("name"))
    seed = o.where("o_orderstatus <> 'F'").select(F.col("o_orderkey").alias("ref_id"), F.col("o_custkey").alias("k"), F.lit("seed").alias("name"))
    m = merge.merge_reference(cur, seed, ["k"])
    return m.join(cur.select("k", F.col("ref_id").alias("cur_id")), "k", "left").select("k", "cur_id", "ref_id", "name")
