"""SQL rules of the quality, compliance, operations and stored-valuation bindings."""

from tickerlake.plans.sqlparts import part

part("feed", """
SELECT event_id, CASE WHEN event_id % 97 <> 0 THEN user_id END AS instrument_id, CASE WHEN event_id % 194 <> 0 THEN 'U' || user_id END AS symbol, CAST(ts AS DATE) AS trade_date, upper(event_type) AS source_system,
 CASE WHEN event_id % 53 <> 0 THEN c END AS open_c, c + 100 AS high_c, c // 2 AS low_c, CASE WHEN event_id % 211 = 0 THEN 200000000 ELSE c END AS close_c, CASE WHEN event_id % 31 <> 0 THEN ts END AS event_ts
FROM (SELECT *, CAST(round(value * 100) AS BIGINT) AS c FROM events)""")
part("feed_curated", """
SELECT user_id AS instrument_id, CAST(ts AS DATE) AS trade_date, max_by(CAST(round(value * 100) AS BIGINT), event_id) AS close_c FROM events WHERE event_type = 'view' GROUP BY 1, 2""")
part("feed_rules", """
SELECT f.*, p.close_c AS prior, d.close_c IS NOT NULL AS dup,
 CASE WHEN instrument_id_ IS NULL THEN coalesce(symbol, 'UNKNOWN') || ':' || CAST(f.day AS VARCHAR) ELSE instrument_id_ || ':' || CAST(f.day AS VARCHAR) || ':' || source_system END AS rkey
FROM (SELECT *, instrument_id AS instrument_id_, trade_date AS day, coalesce(instrument_id, -1) AS iid FROM feed) f
ASOF LEFT JOIN (SELECT instrument_id AS pid, trade_date AS pday, close_c FROM feed_curated) p ON f.iid = p.pid AND f.day > p.pday
LEFT JOIN (SELECT instrument_id AS did, trade_date AS dday, close_c FROM feed_curated) d ON d.did = f.iid AND d.dday = f.day AND f.source_system = 'VIEW'""")
part("verdicts", """
SELECT event_id, rkey, 'NULL_CHECK_V1' AS rule_code, 'HIGH' AS severity, CASE WHEN instrument_id IS NULL OR open_c IS NULL OR event_ts IS NULL THEN
  'null_fields=' || concat_ws(',', CASE WHEN instrument_id IS NULL THEN 'instrument_id' END, CASE WHEN open_c IS NULL THEN 'open_px' END, CASE WHEN event_ts IS NULL THEN 'event_ts' END) END AS why FROM feed_rules
UNION ALL SELECT event_id, rkey, 'RANGE_CHECK_V1', 'HIGH', 'price_out_of_range field=' || CASE WHEN open_c < 1 OR open_c > 100000000 THEN 'open_px' WHEN high_c > 100000000 THEN 'high_px' WHEN low_c < 1 THEN 'low_px' WHEN close_c < 1 OR close_c > 100000000 THEN 'close_px' END FROM feed_rules
UNION ALL SELECT event_id, rkey, 'STALE_CHECK_V1', 'HIGH', CASE WHEN CAST(event_ts AS DATE) < DATE '2024-01-18' THEN 'event_ts_stale' END FROM feed_rules
UNION ALL SELECT event_id, rkey, 'DUPLICATE_CHECK_V1', 'HIGH', CASE WHEN dup THEN 'duplicate_curated_row' END FROM feed_rules
UNION ALL SELECT event_id, rkey, 'SYMBOL_RESOLVED_CHECK_V1', 'HIGH', CASE WHEN instrument_id IS NULL THEN 'instrument_id_unresolved' END FROM feed_rules
UNION ALL SELECT event_id, rkey, 'CIRCUIT_BREAKER_V1', 'CRITICAL', CASE WHEN prior <> 0 AND abs((close_c / 100.0::DOUBLE - prior / 100.0::DOUBLE) / (prior / 100.0::DOUBLE)) > 0.5 THEN 'circuit_breaker_triggered' END FROM feed_rules""")
part("blocked", "SELECT event_id, bool_or(why IS NOT NULL) AS bad FROM verdicts GROUP BY 1")
part("policies", """
SELECT DISTINCT source AS source_name, CAST(substr(source, 4) AS INTEGER) % 3 <> 0 AS redist, CAST(substr(source, 4) AS INTEGER) % 4 <> 1 AS comm, CAST(substr(source, 4) AS INTEGER) % 2 = 0 AS attr FROM documents WHERE source <> 'src19'""")
part("decisions", """
SELECT doc_id, doc_id // 3 AS request_id, doc_id % 11 AS user_id, source_name, CASE WHEN doc_id % 4 = 0 THEN 'r' || doc_id END AS resource_id, redist, comm, attr,
 CASE WHEN source_name IS NULL THEN 'policy_not_registered' WHEN doc_id % 5 = 0 AND NOT comm THEN 'commercial_use_blocked' WHEN doc_id % 2 = 0 AND NOT redist THEN 'redistribution_blocked'
  WHEN lang = 'en' AND attr AND doc_id % 7 >= 3 THEN 'attribution_required' ELSE 'allowed' END AS decision FROM documents LEFT JOIN policies ON source_name = source""")
part("job_events", """
SELECT event_id AS job_event_id, user_id * 100 + day(ts) AS pipeline_run_id, CASE event_type WHEN 'view' THEN 'START' WHEN 'click' THEN 'RETRY' WHEN 'error' THEN 'FAILED' WHEN 'signup' THEN 'WARN' ELSE 'END' END AS event_type,
 ts AS event_ts, 'm' || event_id AS message, event_id % 2 = 0 AS retryable FROM events""")
part("runs", """
SELECT pipeline_run_id, CASE WHEN pipeline_run_id // 100 % 2 = 0 THEN 'nse_eod_ingest' ELSE 'bse_eod_ingest' END AS pipeline_name,
 CASE WHEN pipeline_run_id % 13 = 0 THEN 'RUNNING' WHEN max_by(event_type, job_event_id) = 'FAILED' THEN 'FAILED' ELSE 'SUCCESS' END AS status, min(event_ts) AS started_at,
 CASE WHEN pipeline_run_id % 13 <> 0 THEN max(event_ts) END AS ended_at, count(*) AS row_count_in FROM job_events GROUP BY 1""")
part("breaches", "SELECT user_id * 100 + day(ts) AS pipeline_run_id FROM events WHERE event_type = 'error' AND value > 100")
part("source_runs", """
SELECT CASE WHEN user_id % 2 = 0 THEN 'nse_eod_ingest' ELSE 'bse_eod_ingest' END AS pipeline_name, CAST(ts AS DATE) AS trade_date, max(user_id % 2) + day(max(CAST(ts AS DATE))) * 2 AS pipeline_run_id,
 max(CASE WHEN event_type = 'purchase' AND (day(ts) % 3 <> 0 OR hour(ts) < 14) THEN ts END) AS confirmed_at FROM events GROUP BY 1, 2""")
part("incident_results", """
SELECT event_id AS dq_result_id, event_id % 6 + 1 AS dq_rule_id, CASE WHEN event_id % 9 = 0 THEN '' WHEN event_id % 5 = 1 THEN 'px-' || md5('I' || user_id) || 'Z' || CAST(CAST(ts AS DATE) AS VARCHAR)
  WHEN event_id % 7 = 2 THEN 'pair' || md5('I' || user_id) || md5('I' || (user_id + 1)) ELSE 'px:' || md5('I' || user_id) || ':' || CAST(CAST(ts AS DATE) AS VARCHAR) END AS target_record_key, 'why' || (event_id % 4) AS failure_reason FROM events""")
part("incidents", """
SELECT event_id + 1000000 AS dq_incident_id, event_id AS dq_result_id, ['OPEN','IN_PROGRESS','RESOLVED'][event_id % 3 + 1] AS incident_status, ['MEDIUM','HIGH'][event_id % 2 + 1] AS impact_level, ts AS opened_at FROM events WHERE event_type = 'error'""")
part("rules", "SELECT k AS dq_rule_id, 'RULE_' || k AS rule_code, ['HIGH','CRITICAL','MEDIUM'][k % 3 + 1] AS severity, CASE WHEN k % 2 = 0 THEN 'MARKET' ELSE 'NEWS' END AS domain_name FROM (SELECT unnest(range(1, 7)) AS k)")
part("star", "SELECT i.*, r.target_record_key, r.failure_reason, u.rule_code, u.severity, u.domain_name FROM incidents i JOIN incident_results r USING (dq_result_id) JOIN rules u USING (dq_rule_id)")
part("val_runs", """
SELECT o_orderkey + 1 AS val_run_id, o_custkey AS instrument_id, CAST(o_orderdate AS TIMESTAMP) AS as_of_ts,
 CASE o_orderstatus WHEN 'F' THEN 'SUCCESS' WHEN 'O' THEN 'OVERRIDDEN' ELSE CASE WHEN o_orderkey % 2 = 0 THEN 'RUNNING' ELSE 'QUEUED' END END AS status FROM orders""")
part("val_outputs", """
SELECT (o_orderkey + 1) * 3 + k AS model_output_id, o_orderkey + 1 AS val_run_id, ['DCF','RELATIVE','BLENDED'][k + 1] AS model_name,
 CASE WHEN NOT (o_orderstatus = 'P' AND k = 1) THEN CAST(CAST(round(o_totalprice * 100) AS BIGINT) // (k + 1) AS DOUBLE) END AS target_price, CAST(CAST(round(o_totalprice * 100) AS BIGINT) AS DOUBLE) AS equity_value
FROM orders, (SELECT unnest([0, 1, 2]) AS k) WHERE NOT (o_orderkey % 10 = 0 AND k = 2)""")
part("val_confidence", """
SELECT o_orderkey * 2 AS confidence_id, o_orderkey + 1 AS val_run_id, CAST(o_orderkey % 100 AS DOUBLE) AS overall_confidence, CAST(o_orderdate AS TIMESTAMP) AS created_at FROM orders WHERE o_orderkey % 9 <> 0
UNION ALL SELECT o_orderkey * 2 + 1, o_orderkey + 1, CAST(o_orderkey % 77 AS DOUBLE), CAST(o_orderdate AS TIMESTAMP) + INTERVAL 1 DAY FROM orders WHERE o_orderkey % 4 = 0""")
part("conf_last", "SELECT val_run_id, max_by(overall_confidence, created_at) AS confidence_score FROM val_confidence GROUP BY 1")
part("val_labels", "SELECT o_orderkey + 1 AS val_run_id, o_orderpriority AS run_label FROM orders WHERE o_orderkey % 3 <> 0")
part("val_list", """
SELECT r.*, b.target_price AS blended_value, d.target_price AS dcf_value, e.target_price AS relative_value, confidence_score, run_label FROM val_runs r
LEFT JOIN val_outputs b ON b.val_run_id = r.val_run_id AND b.model_name = 'BLENDED' LEFT JOIN val_outputs d ON d.val_run_id = r.val_run_id AND d.model_name = 'DCF'
LEFT JOIN val_outputs e ON e.val_run_id = r.val_run_id AND e.model_name = 'RELATIVE' LEFT JOIN conf_last c ON c.val_run_id = r.val_run_id LEFT JOIN val_labels l ON l.val_run_id = r.val_run_id""")
part("val_attributions", """
SELECT (l_orderkey * 16 + l_linenumber) * 100000000 + CAST(round(l_extendedprice * 100) AS BIGINT) % 100000000 AS attribution_id, l_orderkey + 1 AS val_run_id, 'T' || l_returnflag AS driver_type,
 'YEAR_' || l_linenumber AS driver_key, CAST(round(l_extendedprice * 100) AS BIGINT) AS impact FROM lineitem""")
