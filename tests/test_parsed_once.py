"""Fields are parsed once a row: neither checks nor the filters on their outcome repeat a parse."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickerlake.operators import validate
from tickerlake.sources import bhavcopy


def regexes(df):
    return df._jdf.queryExecution().executedPlan().toString().count("RLIKE")


def test_price_file_rows(spark):
    files = spark.range(3).select(*[F.concat(F.lit("1"), F.col("id").cast("string")).alias(n) for n in bhavcopy.NSE_HEADERS])
    for part in bhavcopy.nse_rows(files, "TIMESTAMP", "quarantine"):
        assert 0 < regexes(part) <= 6 + 4  # six numbers, four date layouts


def test_contract_rows(spark):
    contract = T.StructType([T.StructField("a", T.DecimalType(24, 6), False), T.StructField("b", T.DateType()), T.StructField("c", T.DecimalType(24, 6))])
    rows = spark.range(3).select("id", F.create_map(F.lit("a"), F.col("id").cast("string"), F.lit("b"), F.lit("2026-06-26"), F.lit("c"), F.lit(None)).alias("row"))
    for part in validate.validate_contract(rows, contract):
        assert 0 < regexes(part) <= 3
    assert validate.validate_contract(rows, contract)[0].columns == ["id", "a", "b", "c"]
    assert validate.validate_contract(rows, contract)[1].columns == ["id", "row", "reason"]
