"""Registry of queries and their checking SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
MODULE_OF: dict[str, str] = {}


def plain(df: DataFrame) -> DataFrame:
    """Decimals to double, whole numbers to long, dates and times to text, so that
    results compare across engines."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.DecimalType | T.FloatType):
            c = c.cast("double")
        elif isinstance(f.dataType, T.IntegerType | T.ShortType | T.ByteType):
            c = c.cast("long")
        elif isinstance(f.dataType, T.DateType | T.TimestampType | T.TimestampNTZType):
            c = c.cast("string")
        cols.append(c.alias(f.name))
    return df.select(*cols)


def register(name: str, oracle: str | None = None):
    """Decorator: add a query and, when given, its checking SQL."""

    def wrap(fn: Callable[[SparkSession, str], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        MODULE_OF[name] = fn.__module__.rsplit(".", 1)[-1]
        QUERIES[name] = lambda spark, sf: plain(fn(spark, sf))
        if oracle is not None:
            ORACLE[name] = oracle
        return fn

    return wrap
