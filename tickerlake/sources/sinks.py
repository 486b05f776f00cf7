"""Writers for quarantined records and metric exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def quarantine_write(quarantine: DataFrame, path: str) -> None:
    """JSON files in one folder per target table and rule."""
    quarantine.write.mode("append").partitionBy("target_table", "rule_code").json(path)


def quarantine_read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("record_key string, captured_at timestamp, record string, target_table string, rule_code string").json(path)


def export_metrics_csv(metrics: DataFrame, path: str) -> None:
    """metric,value files with a header."""
    metrics.select("metric", "value").write.mode("overwrite").option("header", True).csv(path)
