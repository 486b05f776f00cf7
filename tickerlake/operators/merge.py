"""Batch merges: union of current and incoming rows, newest per key.

Newest-per-key is an aggregation with map-side combining, never a window over a
key, so a key with any number of versions is reduced before the shuffle.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickerlake.functions import dates
from tickerlake.operators import timejoin


def latest_version(df: DataFrame, keys: list[str], version: str, arrival: list[str], cols: list[str]) -> DataFrame:
    """Row with the highest version per key; the first arrival wins a tie.

    ``arrival`` columns are numbers; dates and times go in as epoch values.
    """
    return timejoin.latest_by(df, keys, [F.col(version), *[-F.col(a) for a in arrival]], cols)


def superseded(replaced: DataFrame, as_of: dt.datetime | None) -> DataFrame:
    """A WARN result for each row that took a stored one's place; ``existing_ingested_at`` is the stored one's time."""
    return replaced.select(
        F.concat_ws(":", "instrument_id", "trade_date").alias("target_record_key"),
        F.lit("SUPERSEDED_NORMALIZED_ROW").alias("rule_code"), F.lit("WARN").alias("status"),
        F.lit("superseded_row").alias("failure_reason"), "existing_ingested_at",
        F.col("ingested_at").alias("incoming_ingested_at"), F.lit(as_of).cast("timestamp").alias("evaluated_at"),
    )


def merge_ohlcv(current: DataFrame, incoming: DataFrame, as_of: dt.datetime) -> tuple[DataFrame, DataFrame]:
    """(merged, superseded): incoming replaces the stored row only when its
    ``ingested_at`` is strictly newer; each replacement is reported as WARN."""
    keys = ["instrument_id", "trade_date"]
    cols = [c for c in current.columns if c not in keys]
    both = current.withColumn("_new", F.lit(0)).unionByName(incoming.select(*current.columns).withColumn("_new", F.lit(1)))
    # at equal times the stored row stays; among incoming ones the order is made total
    rank = [F.col("ingested_at"), -F.col("_new"), F.col("source_record_id")]
    best = timejoin.latest_by(both, keys, rank, [*cols, "_new"])
    old = current.select(*keys, F.col("ingested_at").alias("existing_ingested_at"))
    gone = superseded(best.where("_new = 1").join(old, keys), as_of)
    return best.drop("_new").select(*current.columns), gone


def _last_writer(current: DataFrame, incoming: DataFrame, keys: list[str], order: list[str], keep_first: dict[str, Column] | None = None) -> DataFrame:
    cols = [c for c in current.columns if c not in keys]
    both = current.withColumn("_new", F.lit(0)).unionByName(incoming.select(*current.columns).withColumn("_new", F.lit(1)))
    best = F.max_by(F.struct(*cols), F.struct("_new", *order))
    kept = keep_first or {}
    agg = both.groupBy(*keys).agg(best.alias("_r"), *[c.alias(f"_k_{n}") for n, c in kept.items()])
    return agg.select(*[
        F.col(c) if c in keys else F.col(f"_k_{c}").alias(c) if c in kept else F.col(f"_r.{c}").alias(c) for c in current.columns
    ])


def merge_statement_facts(current: DataFrame, incoming: DataFrame) -> DataFrame:
    """Incoming facts overwrite value and times of their key."""
    keys = ["instrument_id", "fiscal_year", "fiscal_period", "statement_type", "line_item_code"]
    return _last_writer(current, incoming, keys, ["ingested_at", "value"])


def merge_metric_facts(current: DataFrame, incoming: DataFrame) -> DataFrame:
    """Incoming metrics overwrite their key; the first creation time is kept."""
    keys = ["instrument_id", "metric_code", "as_of_date", "calc_version"]
    return _last_writer(current, incoming, keys, ["created_at", "metric_value"], {"created_at": F.min("created_at")})


def merge_reference(current: DataFrame, seed: DataFrame, keys: list[str]) -> DataFrame:
    """Idempotent load by natural key: seed values win, the stored id stays."""
    cols = [c for c in current.columns if c not in keys]
    both = current.withColumn("_new", F.lit(0)).unionByName(seed.select(*current.columns).withColumn("_new", F.lit(1)))
    ident = cols[0]
    # first the stored id (or the lowest seed id), then the seed's other values
    agg = both.groupBy(*keys).agg(
        F.min_by(ident, F.struct("_new", ident)).alias(ident),
        F.max_by(F.struct(*cols), F.struct("_new", F.lit(0) - F.col(ident))).alias("_r"),
    )
    return agg.select(*[F.col(c) if c in (*keys, ident) else F.col(f"_r.{c}").alias(c) for c in current.columns])


def sync_rules(current: DataFrame, declared: DataFrame, as_of: dt.datetime) -> DataFrame:
    """Declared rules are inserted or refreshed; other versions of a declared name
    are switched off.  ``current`` and ``declared``: rule_code, rule_name,
    domain_name, severity, rule_expression; ``current`` also is_active, updated_at."""
    now = F.lit(as_of)
    d = declared.select("rule_code", *[F.col(c).alias(f"_d_{c}") for c in ("rule_name", "domain_name", "severity", "rule_expression")])
    names = declared.select("rule_name").distinct().withColumn("_named", F.lit(True))
    j = current.join(d, "rule_code", "full").join(names, "rule_name", "left")
    hit, known = F.col("_d_rule_name").isNotNull(), F.col("rule_name").isNotNull()
    off = ~hit & F.col("_named").isNotNull() & F.col("is_active")
    return j.select(
        "rule_code",
        *[F.when(hit, F.col(f"_d_{c}")).otherwise(F.col(c)).alias(c) for c in ("rule_name", "domain_name", "severity", "rule_expression")],
        F.when(hit, True).when(off, False).otherwise(F.col("is_active")).alias("is_active"),
        F.when(hit | off, now).otherwise(F.col("updated_at")).alias("updated_at"),
        F.when(hit & ~known, "INSERTED").when(hit, "REFRESHED").when(off, "DEACTIVATED").otherwise("UNCHANGED").alias("change"),
    )


def apply_overrides(
    incidents: DataFrame, users: DataFrame, overrides: DataFrame, as_of: dt.datetime, min_length: int = 10
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(incidents, accepted overrides, errors).  An accepted override resolves its
    incident; short text, unknown incident or unknown user make an error row."""
    text_ok = F.trim("justification")
    checked = (
        overrides.withColumn("justification", text_ok)
        .join(incidents.select("dq_incident_id", F.lit(True).alias("_i")), "dq_incident_id", "left")
        .join(users.select(F.col("user_id").alias("approved_by_user_id"), F.lit(True).alias("_u")), "approved_by_user_id", "left")
        .withColumn(
            "error",
            F.when(F.length("justification") < min_length, "JUSTIFICATION_TOO_SHORT")
            .when(F.col("_i").isNull(), "UNKNOWN_INCIDENT").when(F.col("_u").isNull(), "UNKNOWN_APPROVER"),
        ).drop("_i", "_u")
    )
    good = checked.where("error is null").drop("error")
    last = good.groupBy("dq_incident_id").agg(F.max_by("justification", "override_seq").alias("_why"))
    done = F.col("_why").isNotNull()
    after = incidents.join(last, "dq_incident_id", "left").withColumns(
        {
            "incident_status": F.when(done, "RESOLVED").otherwise(F.col("incident_status")),
            "resolution_notes": F.coalesce("_why", "resolution_notes"),
            "resolved_at": F.when(done, F.lit(as_of)).otherwise(F.col("resolved_at")),
        }
    ).drop("_why")
    written = good.select("dq_incident_id", "approved_by_user_id", F.col("justification").alias("override_reason"), F.lit(as_of).alias("created_at"))
    return after, written, checked.where("error is not null")


def insert_assumptions_once(current: DataFrame, incoming: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(table, rejected): the assumptions of a run are written once."""
    runs = current.select("val_run_id").distinct()
    return current.unionByName(incoming.join(runs, "val_run_id", "left_anti")), incoming.join(runs, "val_run_id", "left_semi")


def replace_run_artifacts(current: DataFrame, incoming: DataFrame) -> DataFrame:
    """Rows of the incoming runs replace all stored rows of those runs."""
    runs = incoming.select("val_run_id").distinct()
    return current.join(runs, "val_run_id", "left_anti").unionByName(incoming)


def requeue_runs(runs: DataFrame) -> DataFrame:
    """RUNNING goes back to QUEUED; queued runs in creation order."""
    return (
        runs.where(F.col("status").isin("QUEUED", "RUNNING")).withColumn("status", F.lit("QUEUED"))
        .orderBy("created_at", "val_run_id")
    )
