"""Exact order statistics per group without gathering a group anywhere.

Values are first collapsed to (value, weight), then counted in narrow monotone
bins.  Only the bins that hold a wanted position are opened, and these are cut
again into equal parts between their least and greatest value.  A group of any
size is thus spread over its bins, and what reaches one task is one part of a bin,
also where all values lie close together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

BINS_PER_OCTAVE = 256
SUB_BINS = 4096


def monotone_bin(v: Column) -> Column:
    """A bin number that never falls as the value grows."""
    octave = F.floor((F.log2(F.abs(v)) + 1100) * BINS_PER_OCTAVE)
    return F.when(v > 0, octave).when(v < 0, -octave).otherwise(F.lit(0)).cast("long")


def order_stats(df: DataFrame, keys: list[str], value: str, positions: str) -> DataFrame:
    """keys, n, at: map of 0-based rank -> value for the wanted ranks.

    ``positions`` is a SQL expression over the group size ``n`` giving an array of
    ranks; ranks outside the group are ignored.
    """
    c = (
        df.where(F.col(value).isNotNull())
        .groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_w"))
        .withColumn("_bin", monotone_bin(F.col(value)))
    )
    plain = F.col(value).cast("double")
    bins = c.groupBy(*keys, "_bin").agg(F.sum("_w").alias("_bw"), F.min(plain).alias("_least"), F.max(plain).alias("_most"))
    run = W.partitionBy(*keys).orderBy("_bin").rowsBetween(W.unboundedPreceding, 0)
    whole = W.partitionBy(*keys) if keys else W.partitionBy(F.lit(0))
    bins = (
        bins.withColumn("_upto", F.sum("_bw").over(run))
        .withColumn("n", F.sum("_bw").over(whole))
        .withColumn("_from", F.col("_upto") - F.col("_bw"))
        .withColumn("_need", F.expr(f"filter(array_distinct({positions}), p -> p >= _from and p < _upto)"))
        .where(F.size("_need") > 0)
        .select(*keys, "_bin", "n", "_from", "_need", "_least", "_most")
    )
    part = F.least(F.floor((plain - F.col("_least")) / F.nullif(F.col("_most") - F.col("_least"), F.lit(0.0)) * SUB_BINS), F.lit(SUB_BINS - 1))
    opened = c.join(bins, [*keys, "_bin"]).withColumn("_sub", F.coalesce(part, F.lit(0)))
    # the same again inside the opened bins; their rows of all groups are few
    cut = W.partitionBy(*keys, "_bin").orderBy("_sub").rowsBetween(W.unboundedPreceding, 0)
    subs = (
        opened.groupBy(*keys, "_bin", "_sub").agg(F.sum("_w").alias("_bw"), F.first("_from").alias("_base"), F.first("_need").alias("_wanted"))
        .withColumn("_end", F.sum("_bw").over(cut) + F.col("_base"))
        .withColumn("_begin", F.col("_end") - F.col("_bw"))
        .where("exists(_wanted, p -> p >= _begin and p < _end)")
        .select(*keys, "_bin", "_sub", "_begin")
    )
    inside = W.partitionBy(*keys, "_bin", "_sub").orderBy(value).rowsBetween(W.unboundedPreceding, 0)
    hits = (
        opened.join(subs, [*keys, "_bin", "_sub"])
        .withColumn("_hi", F.sum("_w").over(inside) + F.col("_begin"))
        .withColumn("_lo", F.col("_hi") - F.col("_w"))
        .withColumn("_p", F.expr("explode(filter(_need, p -> p >= _lo and p < _hi))"))
    )
    return hits.groupBy(*keys).agg(
        F.max("n").alias("n"),
        F.map_from_entries(F.collect_list(F.struct(F.col("_p"), F.col(value)))).alias("at"),
    )


def quartile_ranks(m: str) -> str:
    """SQL array of the six ranks whose pairwise means are q1, median and q3.

    The halves leave out the middle element of an odd count; a single value is its
    own quartile.
    """
    h, up = f"({m} div 2)", f"({m} - {m} div 2)"
    six = [f"({h} - 1) div 2", f"{h} div 2", f"({m} - 1) div 2", f"{m} div 2", f"{up} + ({h} - 1) div 2", f"{up} + {h} div 2"]
    return f"if({m} < 2, array_repeat(0L, 6), array({', '.join(six)}))"


def exclusive_quartiles(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys, n, q1, med, q3 with halves that exclude the middle element."""
    s = order_stats(df, keys, value, quartile_ranks("n"))
    return s.withColumn("_v", F.expr(f"transform({quartile_ranks('n')}, p -> try_element_at(at, p))")).select(*keys, "n", *quartile_columns("_v"))


def quartile_columns(v: str) -> list[Column]:
    """q1, med, q3 from the six ranked values."""
    return [F.expr(f"(get({v}, {i}) + get({v}, {i + 1})) / 2").alias(n) for i, n in ((0, "q1"), (2, "med"), (4, "q3"))]


def median_exact(df: DataFrame, keys: list[str], value: str, out: str = "median") -> DataFrame:
    """keys, n and the median (mean of the middle two for an even count)."""
    s = order_stats(df, keys, value, "array((n - 1) div 2, n div 2)")
    return s.select(*keys, "n", F.expr("(try_element_at(at, (n - 1) div 2) + try_element_at(at, n div 2)) / 2").alias(out))


def ranks_without_one(n: str) -> str:
    """Ranks needed for the quartiles of the group with and without one member."""
    less = quartile_ranks(f"({n} - 1)")
    return f"concat({quartile_ranks(n)}, {less}, transform({less}, p -> p + 1))"


def ranked_without(n: str, at: str, own: str) -> Column:
    """The six ranked values of the group after taking out one member of value ``own``.

    ``own`` null means the row is not a member.  After the removal rank p holds the
    old value of p if that is below ``own``, else the old value of p + 1.
    """
    m = f"({n} - if({own} is null, 0, 1))"
    return F.expr(
        f"transform({quartile_ranks(m)}, p -> case when {own} is null or try_element_at({at}, p) < {own} then try_element_at({at}, p) else try_element_at({at}, p + 1) end)")
