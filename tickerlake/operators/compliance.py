"""Source usage policies: decisions, blocking of responses, audit rows."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickerlake.functions import text


def compliance_decisions(requests: DataFrame, policies: DataFrame) -> DataFrame:
    """Add policy columns, ``allowed`` and ``decision`` to each (request, source).

    Requests: source_name, external_call, derived_output, attribution,
    commercial_context.  First match of commercial, redistribution, attribution.
    A source without a policy is refused as unregistered.
    """
    p = policies.select(F.upper("source_name").alias("_k"), F.col("source_name").alias("policy_source"), "redistribution_allowed", "commercial_use", "attribution_required")
    j = requests.withColumn("_k", F.upper(F.trim("source_name"))).join(p, "_k", "left").drop("_k")
    said = F.coalesce(F.length("attribution") > 0, F.lit(False))
    decision = (
        F.when(F.col("policy_source").isNull(), "policy_not_registered")
        .when(F.col("commercial_context") & ~F.col("commercial_use"), "commercial_use_blocked")
        .when(F.col("external_call") & ~F.col("redistribution_allowed"), "redistribution_blocked")
        .when(F.col("derived_output") & F.col("attribution_required") & ~said, "attribution_required")
        .otherwise("allowed")
    )
    return j.withColumn("decision", decision).withColumn("allowed", F.col("decision") == "allowed").withColumn(
        "required_attribution", F.when(F.col("attribution_required"), F.concat(F.lit("Source: "), F.col("policy_source"))))


def compliance_filter(rows: DataFrame, decisions: DataFrame) -> DataFrame:
    """Rows of the requests in which every source is allowed."""
    whole = decisions.groupBy("request_id").agg(F.bool_and("allowed").alias("_ok")).where("_ok").select("request_id")
    return rows.join(whole, "request_id", "left_semi")


def compliance_audit(decisions: DataFrame, as_of: dt.datetime) -> DataFrame:
    """One ALLOW or BLOCK event per check of a registered policy, with its payload."""
    c = F.col
    return decisions.where("policy_source is not null").select(
        "user_id", F.when(c("allowed"), "COMPLIANCE_POLICY_ALLOW").otherwise("COMPLIANCE_POLICY_BLOCK").alias("event_type"), F.lit("SOURCE_POLICY").alias("resource_code"),
        F.coalesce("resource_id", "policy_source").alias("resource_id"), F.lit(as_of).alias("event_ts"),
        text.payload_json(source_name=c("policy_source"), redistribution_allowed=c("redistribution_allowed"), commercial_use=c("commercial_use"),
                          attribution_required=c("attribution_required"), decision=c("decision"), required_attribution=c("required_attribution")).alias("event_payload"))
