"""Table schemas, keys and constraints."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field

from pyspark.sql import types as T

_TYPES = {"BIGINT": T.LongType(), "INT": T.IntegerType(), "SMALLINT": T.ShortType(), "STRING": T.StringType(), "BOOLEAN": T.BooleanType(), "DATE": T.DateType(), "TIMESTAMP": T.TimestampType()}


@dataclass(frozen=True)
class Table:
    """Columns as Spark DDL, the first of them the key; uniqueness, foreign keys and checks."""

    ddl: str
    unique: list[list[str]] = field(default_factory=list)
    foreign: dict[str, tuple[str, str]] = field(default_factory=dict)
    checks: list[str] = field(default_factory=list)

    @property
    def columns(self) -> dict[str, str]:
        """Column -> its type, with NOT NULL where it is required."""
        lines = (line.strip().rstrip(",") for line in self.ddl.strip().splitlines())
        return dict(line.split(" ", 1) for line in lines)

    @property
    def key(self) -> str:
        return next(iter(self.columns))

    @property
    def required(self) -> list[str]:
        return [c for c, t in self.columns.items() if t.endswith(" NOT NULL")]

    @property
    def schema(self) -> T.StructType:
        return T.StructType([T.StructField(c, spark_type(t.removesuffix(" NOT NULL")), not t.endswith(" NOT NULL")) for c, t in self.columns.items()])


def spark_type(name: str) -> T.DataType:
    m = re.fullmatch(r"DECIMAL\((\d+),(\d+)\)", name)
    return T.DecimalType(int(m.group(1)), int(m.group(2))) if m else _TYPES[name]


def columns_of(expression: str) -> set[str]:
    """Lower-case words of a check that are column names (not functions or values)."""
    bare = re.sub(r"'[^']*'", "", expression)
    return {w for w in re.findall(r"\b[a-z][a-z0-9_]*\b(?!\s*\()", bare)} - {"is", "null", "or", "and", "in", "not", "between"}


# --- fixed values ---------------------------------------------------------------
TABLES = {
    "ref_exchange": Table(
        """
        exchange_id SMALLINT NOT NULL,
        exchange_code STRING NOT NULL,
        exchange_name STRING NOT NULL,
        country_code STRING NOT NULL,
        timezone STRING NOT NULL,
        currency_code STRING NOT NULL,
        is_active BOOLEAN NOT NULL,
        created_at TIMESTAMP NOT NULL,
        updated_at TIMESTAMP NOT NULL
        """,
        unique=[["exchange_code"]],
    ),
    "ref_company": Table(
        """
        company_id BIGINT NOT NULL,
        company_uuid STRING NOT NULL,
        legal_name STRING NOT NULL,
        display_name STRING NOT NULL,
        isin_primary STRING,
        sector_code STRING,
        industry_code STRING,
        incorporation_country STRING,
        is_listed BOOLEAN NOT NULL,
        is_active BOOLEAN NOT NULL,
        created_at TIMESTAMP NOT NULL,
        updated_at TIMESTAMP NOT NULL
        """,
        unique=[["company_uuid"]],
    ),
    "ref_instrument": Table(
        """
        instrument_id BIGINT NOT NULL,
        instrument_uuid STRING NOT NULL,
        company_id BIGINT NOT NULL,
        exchange_id SMALLINT NOT NULL,
        symbol STRING NOT NULL,
        instrument_type STRING NOT NULL,
        listing_date DATE,
        delisting_date DATE,
        tick_size DECIMAL(12,6),
        lot_size INT,
        is_active BOOLEAN NOT NULL,
        created_at TIMESTAMP NOT NULL,
        updated_at TIMESTAMP NOT NULL
        """,
        unique=[["instrument_uuid"], ["exchange_id", "symbol", "is_active"]],
        foreign={"company_id": ("ref_company", "company_id"), "exchange_id": ("ref_exchange", "exchange_id")},
        checks=["instrument_type IN ('EQUITY', 'ETF', 'ADR', 'PREF')"],
    ),
    "ref_symbol_alias": Table(
        """
        alias_id BIGINT NOT NULL,
        instrument_id BIGINT NOT NULL,
        source_system STRING NOT NULL,
        alias_symbol STRING NOT NULL,
        valid_from DATE NOT NULL,
        valid_to DATE,
        created_at TIMESTAMP NOT NULL
        """,
        foreign={"instrument_id": ("ref_instrument", "instrument_id")},
    ),
    "ref_calendar": Table(
        """
        calendar_id BIGINT NOT NULL,
        exchange_id SMALLINT NOT NULL,
        trade_date DATE NOT NULL,
        is_trading_day BOOLEAN NOT NULL,
        session_open_ts TIMESTAMP,
        session_close_ts TIMESTAMP,
        holiday_name STRING,
        created_at TIMESTAMP NOT NULL
        """,
        unique=[["exchange_id", "trade_date"]],
        foreign={"exchange_id": ("ref_exchange", "exchange_id")},
    ),
    "market_ohlcv_1d": Table(
        """
        ohlcv_1d_id BIGINT NOT NULL,
        instrument_id BIGINT NOT NULL,
        trade_date DATE NOT NULL,
        open_px DECIMAL(18,6) NOT NULL,
        high_px DECIMAL(18,6) NOT NULL,
        low_px DECIMAL(18,6) NOT NULL,
        close_px DECIMAL(18,6) NOT NULL,
        adj_close_px DECIMAL(18,6),
        volume DECIMAL(24,0) NOT NULL,
        turnover DECIMAL(24,2),
        source_system STRING NOT NULL,
        source_record_id STRING,
        ingested_at TIMESTAMP NOT NULL
        """,
        unique=[["instrument_id", "trade_date"]],
        foreign={"instrument_id": ("ref_instrument", "instrument_id")},
        checks=["high_px >= greatest(open_px, close_px)", "low_px <= least(open_px, close_px)"],
    ),
    "market_ohlcv_intraday": Table(
        """
        ohlcv_intraday_id BIGINT NOT NULL,
        instrument_id BIGINT NOT NULL,
        bar_start_ts TIMESTAMP NOT NULL,
        bar_end_ts TIMESTAMP NOT NULL,
        bar_interval_sec INT NOT NULL,
        open_px DECIMAL(18,6) NOT NULL,
        high_px DECIMAL(18,6) NOT NULL,
        low_px DECIMAL(18,6) NOT NULL,
        close_px DECIMAL(18,6) NOT NULL,
        volume DECIMAL(24,0) NOT NULL,
        vwap DECIMAL(18,6),
        source_system STRING NOT NULL,
        ingested_at TIMESTAMP NOT NULL
        """,
        unique=[["instrument_id", "bar_start_ts", "bar_interval_sec"]],
        foreign={"instrument_id": ("ref_instrument", "instrument_id")},
        checks=["bar_end_ts > bar_start_ts"],
    ),
    "market_corporate_action": Table(
        """
        corp_action_id BIGINT NOT NULL,
        instrument_id BIGINT NOT NULL,
        action_type STRING NOT NULL,
        announcement_date DATE,
        ex_date DATE NOT NULL,
        record_date DATE,
        effective_date DATE,
        action_value DECIMAL(20,8),
        action_ratio_num DECIMAL(20,8),
        action_ratio_den DECIMAL(20,8),
        currency_code STRING,
        source_system STRING NOT NULL,
        source_record_id STRING,
        ingested_at TIMESTAMP NOT NULL
        """,
        foreign={"instrument_id": ("ref_instrument", "instrument_id")},
        checks=["action_type IN ('SPLIT', 'BONUS', 'RIGHTS', 'DIVIDEND', 'MERGER', 'DEMERGER', 'DELISTING')"],
    ),
    "market_orderbook_snapshot": Table(
        """
        snapshot_id BIGINT NOT NULL,
        instrument_id BIGINT NOT NULL,
        snapshot_ts TIMESTAMP NOT NULL,
        depth_level SMALLINT NOT NULL,
        best_bid_px DECIMAL(18,6),
        best_bid_qty DECIMAL(24,0),
        best_ask_px DECIMAL(18,6),
        best_ask_qty DECIMAL(24,0),
        book_payload STRING NOT NULL,
        source_system STRING NOT NULL,
        ingested_at TIMESTAMP NOT NULL
        """,
        foreign={"instrument_id": ("ref_instrument", "instrument_id")},
        checks=["depth_level >= 1"],
    ),
    "fund_statement_fact": Table(
        """
        statement_fact_id BIGINT NOT NULL,
        instrument_id BIGINT NOT NULL,
        fiscal_year SMALLINT NOT NULL,
        fiscal_period STRING NOT NULL,
        statement_type STRING NOT NULL,
        line_item_code STRING NOT NULL,
        value DECIMAL(24,4) NOT NULL,
        currency_code STRING NOT NULL,
        scale_code STRING NOT NULL,
        as_reported_ts TIMESTAMP NOT NULL,
        effective_from_ts TIMESTAMP NOT NULL,
        effective_to_ts TIMESTAMP,
        source_system STRING NOT NULL,
        source_record_id STRING,
        ingested_at TIMESTAMP NOT NULL
        """,
        foreign={"instrument_id": ("ref_instrument", "instrument_id")},
        checks=["statement_type IN ('PL', 'BS', 'CF')", "fiscal_period IN ('Q1', 'Q2', 'Q3', 'Q4', 'FY', 'H1', 'H2', 'TTM')"],
    ),
    "fund_metric_fact": Table(
        """
        metric_fact_id BIGINT NOT NULL,
        instrument_id BIGINT NOT NULL,
        metric_code STRING NOT NULL,
        metric_value DECIMAL(24,8) NOT NULL,
        metric_unit STRING NOT NULL,
        as_of_date DATE NOT NULL,
        lookback_period STRING,
        calc_version STRING NOT NULL,
        input_hash STRING NOT NULL,
        created_at TIMESTAMP NOT NULL
        """,
        unique=[["instrument_id", "metric_code", "as_of_date", "calc_version"]],
        foreign={"instrument_id": ("ref_instrument", "instrument_id")},
    ),
    "fund_restatement_log": Table(
        """
        restatement_id BIGINT NOT NULL,
        statement_fact_id BIGINT NOT NULL,
        restatement_type STRING NOT NULL,
        old_value DECIMAL(24,4) NOT NULL,
        new_value DECIMAL(24,4) NOT NULL,
        reason_text STRING,
        detected_at TIMESTAMP NOT NULL,
        source_system STRING NOT NULL
        """,
        foreign={"statement_fact_id": ("fund_statement_fact", "statement_fact_id")},
        checks=["new_value <> old_value"],
    ),
    "fund_segment_fact": Table(
        """
        segment_fact_id BIGINT NOT NULL,
        instrument_id BIGINT NOT NULL,
        segment_code STRING NOT NULL,
        segment_name STRING NOT NULL,
        metric_code STRING NOT NULL,
        metric_value DECIMAL(24,4) NOT NULL,
        fiscal_year SMALLINT NOT NULL,
        fiscal_period STRING NOT NULL,
        currency_code STRING NOT NULL,
        as_reported_ts TIMESTAMP NOT NULL,
        source_system STRING NOT NULL,
        ingested_at TIMESTAMP NOT NULL
        """,
        foreign={"instrument_id": ("ref_instrument", "instrument_id")},
    ),
    "news_source_profile": Table(
        """
        source_id BIGINT NOT NULL,
        source_code STRING NOT NULL,
        source_name STRING NOT NULL,
        source_type STRING NOT NULL,
        license_class STRING NOT NULL,
        base_reliability_score DECIMAL(5,2) NOT NULL,
        terms_url STRING,
        is_active BOOLEAN NOT NULL,
        created_at TIMESTAMP NOT NULL
        """,
        unique=[["source_code"]],
        checks=["base_reliability_score BETWEEN 0 AND 100"],
    ),
    "news_article": Table(
        """
        article_id BIGINT NOT NULL,
        source_id BIGINT NOT NULL,
        external_article_id STRING,
        url STRING NOT NULL,
        headline STRING NOT NULL,
        published_at TIMESTAMP NOT NULL,
        captured_at TIMESTAMP NOT NULL,
        language_code STRING,
        article_text_hash STRING NOT NULL,
        article_text STRING,
        raw_payload STRING,
        is_paywalled BOOLEAN NOT NULL
        """,
        unique=[["source_id", "external_article_id"]],
        foreign={"source_id": ("news_source_profile", "source_id")},
        checks=["captured_at >= published_at"],
    ),
    "news_entity_link": Table(
        """
        entity_link_id BIGINT NOT NULL,
        article_id BIGINT NOT NULL,
        company_id BIGINT NOT NULL,
        mention_type STRING NOT NULL,
        relevance_score DECIMAL(5,2) NOT NULL,
        sentiment_score DECIMAL(6,3),
        created_at TIMESTAMP NOT NULL
        """,
        unique=[["article_id", "company_id", "mention_type"]],
        foreign={"article_id": ("news_article", "article_id"), "company_id": ("ref_company", "company_id")},
        checks=["relevance_score BETWEEN 0 AND 100"],
    ),
    "news_event": Table(
        """
        event_id BIGINT NOT NULL,
        article_id BIGINT NOT NULL,
        event_type STRING NOT NULL,
        event_subtype STRING,
        event_direction STRING,
        event_severity DECIMAL(5,2),
        event_payload STRING,
        event_confidence DECIMAL(5,2) NOT NULL,
        created_at TIMESTAMP NOT NULL
        """,
        foreign={"article_id": ("news_article", "article_id")},
        checks=["event_confidence BETWEEN 0 AND 100", "event_direction IN ('POSITIVE', 'NEGATIVE', 'NEUTRAL')"],
    ),
    "news_reliability_score": Table(
        """
        reliability_id BIGINT NOT NULL,
        article_id BIGINT NOT NULL,
        source_reliability DECIMAL(5,2) NOT NULL,
        content_consistency DECIMAL(5,2) NOT NULL,
        cross_source_confirmation DECIMAL(5,2) NOT NULL,
        final_reliability_score DECIMAL(5,2) NOT NULL,
        scoring_version STRING NOT NULL,
        scored_at TIMESTAMP NOT NULL
        """,
        unique=[["article_id", "scoring_version"]],
        foreign={"article_id": ("news_article", "article_id")},
        checks=["source_reliability BETWEEN 0 AND 100", "content_consistency BETWEEN 0 AND 100", "cross_source_confirmation BETWEEN 0 AND 100", "final_reliability_score BETWEEN 0 AND 100"],
    ),
    "ops_pipeline_run": Table(
        """
        pipeline_run_id BIGINT NOT NULL,
        run_uuid STRING NOT NULL,
        pipeline_name STRING NOT NULL,
        run_mode STRING NOT NULL,
        triggered_by STRING NOT NULL,
        status STRING NOT NULL,
        started_at TIMESTAMP NOT NULL,
        ended_at TIMESTAMP,
        run_context STRING
        """,
        unique=[["run_uuid"]],
        checks=["status IN ('QUEUED', 'RUNNING', 'SUCCESS', 'FAILED', 'CANCELLED')"],
    ),
    "val_run": Table(
        """
        val_run_id BIGINT NOT NULL,
        run_uuid STRING NOT NULL,
        instrument_id BIGINT NOT NULL,
        as_of_ts TIMESTAMP NOT NULL,
        run_type STRING NOT NULL,
        trigger_type STRING NOT NULL,
        status STRING NOT NULL,
        pipeline_run_id BIGINT,
        created_at TIMESTAMP NOT NULL,
        completed_at TIMESTAMP
        """,
        unique=[["run_uuid"]],
        foreign={"instrument_id": ("ref_instrument", "instrument_id"), "pipeline_run_id": ("ops_pipeline_run", "pipeline_run_id")},
        checks=["status IN ('QUEUED', 'RUNNING', 'SUCCESS', 'FAILED', 'OVERRIDDEN')"],
    ),
    "val_assumption_set": Table(
        """
        assumption_set_id BIGINT NOT NULL,
        val_run_id BIGINT NOT NULL,
        assumption_key STRING NOT NULL,
        assumption_value_numeric DECIMAL(24,8),
        assumption_value_text STRING,
        assumption_unit STRING,
        source_type STRING NOT NULL,
        source_reference STRING,
        created_at TIMESTAMP NOT NULL
        """,
        unique=[["val_run_id", "assumption_key"]],
        foreign={"val_run_id": ("val_run", "val_run_id")},
        checks=["assumption_value_numeric IS NOT NULL OR assumption_value_text IS NOT NULL"],
    ),
    "val_model_output": Table(
        """
        model_output_id BIGINT NOT NULL,
        val_run_id BIGINT NOT NULL,
        model_name STRING NOT NULL,
        model_version STRING NOT NULL,
        equity_value DECIMAL(24,4),
        enterprise_value DECIMAL(24,4),
        target_price DECIMAL(18,6),
        weight DECIMAL(8,6),
        currency_code STRING NOT NULL,
        output_payload STRING,
        created_at TIMESTAMP NOT NULL
        """,
        unique=[["val_run_id", "model_name", "model_version"]],
        foreign={"val_run_id": ("val_run", "val_run_id")},
        checks=["model_name IN ('DCF', 'RELATIVE', 'SOTP', 'SCENARIO_WEIGHTED', 'BLENDED')"],
    ),
    "val_sensitivity": Table(
        """
        sensitivity_id BIGINT NOT NULL,
        model_output_id BIGINT NOT NULL,
        assumption_key STRING NOT NULL,
        shock_label STRING NOT NULL,
        shock_value DECIMAL(24,8) NOT NULL,
        result_target_price DECIMAL(18,6) NOT NULL,
        created_at TIMESTAMP NOT NULL
        """,
        unique=[["model_output_id", "assumption_key", "shock_label"]],
        foreign={"model_output_id": ("val_model_output", "model_output_id")},
    ),
    "val_attribution": Table(
        """
        attribution_id BIGINT NOT NULL,
        val_run_id BIGINT NOT NULL,
        driver_type STRING NOT NULL,
        driver_key STRING NOT NULL,
        impact_value_abs DECIMAL(18,6) NOT NULL,
        impact_value_pct DECIMAL(9,4),
        direction STRING NOT NULL,
        evidence_ref STRING,
        created_at TIMESTAMP NOT NULL
        """,
        foreign={"val_run_id": ("val_run", "val_run_id")},
        checks=["direction IN ('UP', 'DOWN', 'NEUTRAL')"],
    ),
    "val_confidence_snapshot": Table(
        """
        confidence_id BIGINT NOT NULL,
        val_run_id BIGINT NOT NULL,
        overall_confidence DECIMAL(5,2) NOT NULL,
        data_quality_score DECIMAL(5,2) NOT NULL,
        management_credibility_score DECIMAL(5,2) NOT NULL,
        industry_stability_score DECIMAL(5,2) NOT NULL,
        forecast_accuracy_score DECIMAL(5,2) NOT NULL,
        news_reliability_score DECIMAL(5,2) NOT NULL,
        model_agreement_score DECIMAL(5,2) NOT NULL,
        scenario_dispersion_score DECIMAL(5,2) NOT NULL,
        scoring_version STRING NOT NULL,
        created_at TIMESTAMP NOT NULL
        """,
        unique=[["val_run_id", "scoring_version"]],
        foreign={"val_run_id": ("val_run", "val_run_id")},
        checks=["overall_confidence BETWEEN 0 AND 100", "data_quality_score BETWEEN 0 AND 100", "management_credibility_score BETWEEN 0 AND 100", "industry_stability_score BETWEEN 0 AND 100", "forecast_accuracy_score BETWEEN 0 AND 100", "news_reliability_score BETWEEN 0 AND 100", "model_agreement_score BETWEEN 0 AND 100", "scenario_dispersion_score BETWEEN 0 AND 100"],
    ),
    "dq_rule": Table(
        """
        dq_rule_id BIGINT NOT NULL,
        rule_code STRING NOT NULL,
        rule_name STRING NOT NULL,
        domain_name STRING NOT NULL,
        severity STRING NOT NULL,
        rule_expression STRING NOT NULL,
        is_active BOOLEAN NOT NULL,
        owner_team STRING NOT NULL,
        created_at TIMESTAMP NOT NULL,
        updated_at TIMESTAMP NOT NULL
        """,
        unique=[["rule_code"]],
        checks=["severity IN ('LOW', 'MEDIUM', 'HIGH', 'CRITICAL')"],
    ),
    "dq_result": Table(
        """
        dq_result_id BIGINT NOT NULL,
        dq_rule_id BIGINT NOT NULL,
        pipeline_run_id BIGINT,
        target_table STRING NOT NULL,
        target_record_key STRING,
        status STRING NOT NULL,
        failure_reason STRING,
        measured_value STRING,
        threshold_value STRING,
        evaluated_at TIMESTAMP NOT NULL
        """,
        foreign={"pipeline_run_id": ("ops_pipeline_run", "pipeline_run_id"), "dq_rule_id": ("dq_rule", "dq_rule_id")},
        checks=["status IN ('PASS', 'FAIL', 'WARN', 'SKIPPED')"],
    ),
    "dq_incident": Table(
        """
        dq_incident_id BIGINT NOT NULL,
        dq_result_id BIGINT NOT NULL,
        incident_status STRING NOT NULL,
        impact_level STRING NOT NULL,
        assigned_to STRING,
        opened_at TIMESTAMP NOT NULL,
        resolved_at TIMESTAMP,
        resolution_notes STRING
        """,
        foreign={"dq_result_id": ("dq_result", "dq_result_id")},
        checks=["incident_status IN ('OPEN', 'IN_PROGRESS', 'RESOLVED', 'CLOSED')"],
    ),
    "auth_user": Table(
        """
        user_id BIGINT NOT NULL,
        user_uuid STRING NOT NULL,
        email STRING NOT NULL,
        full_name STRING NOT NULL,
        status STRING NOT NULL,
        is_mfa_enabled BOOLEAN NOT NULL,
        last_login_at TIMESTAMP,
        created_at TIMESTAMP NOT NULL,
        updated_at TIMESTAMP NOT NULL
        """,
        unique=[["user_uuid"], ["email"]],
        checks=["status IN ('ACTIVE', 'INACTIVE', 'LOCKED')"],
    ),
    "dq_override": Table(
        """
        dq_override_id BIGINT NOT NULL,
        dq_incident_id BIGINT NOT NULL,
        approved_by_user_id BIGINT NOT NULL,
        override_reason STRING NOT NULL,
        override_expiry_ts TIMESTAMP,
        created_at TIMESTAMP NOT NULL
        """,
        foreign={"dq_incident_id": ("dq_incident", "dq_incident_id"), "approved_by_user_id": ("auth_user", "user_id")},
    ),
    "ops_job_event": Table(
        """
        job_event_id BIGINT NOT NULL,
        pipeline_run_id BIGINT NOT NULL,
        job_name STRING NOT NULL,
        event_type STRING NOT NULL,
        event_ts TIMESTAMP NOT NULL,
        message STRING,
        metrics_payload STRING
        """,
        foreign={"pipeline_run_id": ("ops_pipeline_run", "pipeline_run_id")},
        checks=["event_type IN ('START', 'END', 'WARN', 'ERROR', 'RETRY', 'FAILED')"],
    ),
    "ops_data_lineage": Table(
        """
        lineage_id BIGINT NOT NULL,
        pipeline_run_id BIGINT NOT NULL,
        source_asset STRING NOT NULL,
        target_asset STRING NOT NULL,
        transform_id STRING NOT NULL,
        record_count_in BIGINT,
        record_count_out BIGINT,
        lineage_ts TIMESTAMP NOT NULL
        """,
        foreign={"pipeline_run_id": ("ops_pipeline_run", "pipeline_run_id")},
        checks=["record_count_in IS NULL OR record_count_in >= 0", "record_count_out IS NULL OR record_count_out >= 0"],
    ),
    "ops_sla_breach": Table(
        """
        sla_breach_id BIGINT NOT NULL,
        pipeline_run_id BIGINT,
        sla_type STRING NOT NULL,
        service_name STRING NOT NULL,
        expected_value DECIMAL(18,4),
        actual_value DECIMAL(18,4),
        breach_detected_at TIMESTAMP NOT NULL,
        resolved_at TIMESTAMP,
        status STRING NOT NULL
        """,
        foreign={"pipeline_run_id": ("ops_pipeline_run", "pipeline_run_id")},
        checks=["status IN ('OPEN', 'ACKNOWLEDGED', 'RESOLVED')"],
    ),
    "auth_role": Table(
        """
        role_id BIGINT NOT NULL,
        role_code STRING NOT NULL,
        role_name STRING NOT NULL,
        description STRING,
        is_system_role BOOLEAN NOT NULL,
        created_at TIMESTAMP NOT NULL
        """,
        unique=[["role_code"]],
    ),
    "auth_permission": Table(
        """
        permission_id BIGINT NOT NULL,
        role_id BIGINT NOT NULL,
        resource_code STRING NOT NULL,
        action_code STRING NOT NULL,
        effect STRING NOT NULL,
        created_at TIMESTAMP NOT NULL
        """,
        unique=[["role_id", "resource_code", "action_code"]],
        foreign={"role_id": ("auth_role", "role_id")},
        checks=["effect IN ('ALLOW', 'DENY')"],
    ),
    "auth_user_role": Table(
        """
        user_role_id BIGINT NOT NULL,
        user_id BIGINT NOT NULL,
        role_id BIGINT NOT NULL,
        granted_by_user_id BIGINT,
        valid_from TIMESTAMP NOT NULL,
        valid_to TIMESTAMP,
        created_at TIMESTAMP NOT NULL
        """,
        unique=[["user_id", "role_id", "valid_from"]],
        foreign={"user_id": ("auth_user", "user_id"), "role_id": ("auth_role", "role_id")},
        checks=["valid_to IS NULL OR valid_to > valid_from"],
    ),
    "auth_audit_event": Table(
        """
        audit_event_id BIGINT NOT NULL,
        user_id BIGINT,
        event_type STRING NOT NULL,
        resource_code STRING,
        resource_id STRING,
        event_ts TIMESTAMP NOT NULL,
        ip_address STRING,
        user_agent STRING,
        event_payload STRING
        """,
        foreign={"user_id": ("auth_user", "user_id")},
    ),
}
# -------------------------------------------------------------------------------

CONTRACT_TYPES = {"string": T.StringType(), "decimal": T.DecimalType(24, 6), "date": T.DateType()}


def contract_schema(path: str) -> T.StructType:
    """Schema contract file (JSON) as a StructType; ``decimal`` is decimal(24,6)."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    return T.StructType([T.StructField(x["name"], CONTRACT_TYPES[x["type"]], bool(x["nullable"])) for x in spec["fields"]])
