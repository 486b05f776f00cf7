"""Time-aware joins that stay linear in the input.

All operators here look at *distinct* (key, day) pairs before any ordered window
runs, so one window partition never holds more rows than the calendar has days,
however many input rows share a key.  Results reach the input rows by an equi
join on (key, day), which adaptive execution splits when a key is hot.
"""

from __future__ import annotations

from decimal import Decimal
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tickerlake.functions.dates import OPEN_END


def asof_values(points: DataFrame, facts: DataFrame, keys: list[str], time: str, value: Column, strict: bool, out: str) -> DataFrame:
    """Latest fact value before (or at) each distinct point, one row per point.

    ``facts`` carries at most one row per (keys, time).
    """
    # at equal times the point must see the fact only in the inclusive form
    point_side = 0 if strict else 1
    asks = points.select(*keys, time).distinct().withColumn("_v", F.lit(None)).withColumn("_side", F.lit(point_side))
    gives = facts.select(*keys, time, value.alias("_v")).withColumn("_side", F.lit(1 - point_side))
    both = asks.unionByName(gives)
    w = W.partitionBy(*keys).orderBy(time, "_side").rowsBetween(W.unboundedPreceding, 0)
    return (
        both.withColumn(out, F.last("_v", ignorenulls=True).over(w))
        .where(F.col("_side") == point_side)
        .select(*keys, time, out)
    )


def asof_join(left: DataFrame, facts: DataFrame, keys: list[str], time: str, value: Column, strict: bool, out: str) -> DataFrame:
    """Add ``out``: the latest fact value strictly before (or at) ``time``."""
    found = asof_values(left.where(_all_set(keys + [time])), facts, keys, time, value, strict, out)
    return left.join(found, [*keys, time], "left")


def _all_set(names: list[str]) -> Column:
    cond = F.lit(True)
    for n in names:
        cond = cond & F.col(n).isNotNull()
    return cond


def active_unique(points: DataFrame, spans: DataFrame, keys: list[str], day: str, start: str, end: str, ident: str) -> DataFrame:
    """How many spans of the key are open on the day (``n_active``), and which one if just one."""
    return active_unique_of(points, {"": spans}, keys, day, start, end, ident)


def active_unique_of(points: DataFrame, sides: dict[str, DataFrame], keys: list[str], day: str, start: str, end: str, ident: str) -> DataFrame:
    """For several kinds of spans at once, by name: how many are open on the day, and which one if just one.

    One row for each distinct point with a day.
    """
    asked = points.select(*keys, day).where(F.col(day).isNotNull()).distinct()
    return at_segment(asked, active_segments(sides, keys, start, end, ident), keys, day).fillna(0, [f"n_active{side}" for side in sides])


def active_segments(sides: dict[str, DataFrame], keys: list[str], start: str, end: str, ident: str) -> DataFrame:
    """The stretches of days of a key between which nothing opens or ends: (keys, _since, _until, n_active, ident), the
    last two for each kind of spans by its name."""
    spans = [df.select(*keys, start, end, ident, F.lit(name).alias("_kind")) for name, df in sides.items()]
    return segments_by_kind(reduce(DataFrame.unionByName, spans), list(sides), keys, start, end, ident)


def segments_by_kind(spans: DataFrame, kinds: list[str], keys: list[str], start: str, end: str, ident: str) -> DataFrame:
    """``active_segments`` of spans that say in ``_kind`` of which kind they are.

    Spans are inclusive at both ends.  Each span adds +1 (and its identifier) on
    its first day and takes it back on the day after its last, so the running sums
    give the count and, where the count is one, the identifier itself.  No range
    join is needed, duplicates of a key only add up, and all kinds share one shuffle.
    A key has one stretch a day at most; ``_until`` is the day behind it (null: it does not end).
    """
    begins = F.struct(F.col(start).alias("_since"), F.lit(1).alias("_sign"))
    ends = F.struct(F.when(F.col(end) < F.lit(OPEN_END).cast("date"), F.date_add(F.col(end), 1)).alias("_since"), F.lit(-1).alias("_sign"))
    steps = spans.select(*keys, F.col(ident).cast("decimal(38,0)").alias("_ident"), "_kind", F.inline(F.array(begins, ends))).where("_sign > 0 or _since is not null")
    sums = {}
    for k, kind in enumerate(kinds):
        own = F.col("_kind") == kind
        sums[f"_n{k}"] = F.sum(F.when(own, F.col("_sign")).otherwise(0))
        sums[f"_id{k}"] = F.sum(F.when(own, F.when(F.col("_sign") > 0, F.col("_ident")).otherwise(-F.col("_ident"))))
    days = steps.groupBy(*keys, "_since").agg(*[c.alias(n) for n, c in sums.items()])
    order = W.partitionBy(*keys).orderBy("_since")
    w = order.rowsBetween(W.unboundedPreceding, 0)
    found = days.select(*keys, "_since", F.lead("_since").over(order).alias("_until"), *[F.sum(c).over(w).alias(c) for c in sums])
    out = []
    for k, kind in enumerate(kinds):
        out += [F.col(f"_n{k}").alias(f"n_active{kind}"), F.when(F.col(f"_n{k}") == 1, F.col(f"_id{k}").cast("long")).alias(f"{ident}{kind}")]
    return found.select(*keys, "_since", "_until", *out).where(reduce(lambda x, y: x | y, [F.col(f"n_active{kind}") > 0 for kind in kinds]))


def at_segment(rows: DataFrame, segments: DataFrame, keys: list[str], day: str) -> DataFrame:
    """Add what the key's stretch (``_since``, ``_until``) around the day holds; nulls where there is none.

    Stretches of a key do not meet, so that a row finds one at most and keeps its number.  The equi join is by the key
    alone: rows are moved once, and not at all where the stretches are few.
    """
    names = [f"_s{k}" for k in range(len(keys))]
    side = segments.select(*[F.col(k).alias(n) for k, n in zip(keys, names)], *[c for c in segments.columns if c not in keys])
    same = reduce(lambda x, y: x & y, [F.col(k) == F.col(n) for k, n in zip(keys, names)])
    inside = (F.col("_since").isNull() | (F.col(day) >= F.col("_since"))) & (F.col("_until").isNull() | (F.col(day) < F.col("_until")))
    return rows.join(side, same & inside, "left").drop(*names, "_since", "_until")


def overlap_counts(probe: DataFrame, wanted: dict[str, tuple[DataFrame, list[str]]]) -> DataFrame:
    """For each probe span the number of spans of the key it overlaps.

    ``wanted`` maps an output column to (spans, keys).  Both sides have inclusive
    ``valid_from``, ``valid_to`` (null = open).  Overlaps = spans begun by the
    probe's end minus spans ended before the probe's begin: two running counts over
    (key, day), not a range join.
    """
    end = F.coalesce(F.col("valid_to"), F.lit(OPEN_END).cast("date"))
    base = probe.withColumn("_to", end)
    out = base
    for name, (spans, keys) in wanted.items():
        w = W.partitionBy(*keys).orderBy("_d").rowsBetween(W.unboundedPreceding, 0)
        begun = spans.groupBy(*keys, F.col("valid_from").alias("_d")).agg(F.count(F.lit(1)).alias("_c")).withColumn("_v", F.sum("_c").over(w))
        ended = spans.groupBy(*keys, end.alias("_d")).agg(F.count(F.lit(1)).alias("_c")).withColumn("_v", F.sum("_c").over(w))
        upto_end = asof_values(base.withColumn("_d", F.col("_to")), begun, keys, "_d", F.col("_v"), False, "_begun")
        before = asof_values(base.withColumn("_d", F.col("valid_from")), ended, keys, "_d", F.col("_v"), True, "_ended")
        out = (
            out.join(upto_end.withColumnRenamed("_d", "_to"), [*keys, "_to"], "left")
            .join(before.withColumnRenamed("_d", "valid_from"), [*keys, "valid_from"], "left")
            .withColumn(name, F.coalesce("_begun", F.lit(0)) - F.coalesce("_ended", F.lit(0)))
            .drop("_begun", "_ended")
        )
    return out.drop("_to")


def packed(major: Column, ident: Column) -> Column:
    """One decimal that orders by ``major`` (days or micros), then by a non-negative id.

    A fixed-width order value keeps ``max_by`` a hash aggregate; a struct would make
    Spark sort the input first.
    """
    wide = F.lit(Decimal(10**19)).cast("decimal(20,0)")
    return (major.cast("decimal(18,0)") * wide + ident.cast("decimal(19,0)")).cast("decimal(38,0)")


def latest_by(df: DataFrame, keys: list[str], order: list[Column], cols: list[str]) -> DataFrame:
    """Newest row per key by aggregation, combined map-side (structs are aggregated by sorting)."""
    best = F.max_by(F.struct(*cols), F.struct(*order))
    return df.groupBy(*keys).agg(best.alias("_r")).select(*keys, "_r.*")


def top1_by_time(df: DataFrame, keys: list[str], time: str, ident: str, cols: list[str]) -> DataFrame:
    """``cols`` (of fixed width: numbers, days, times) of each key's row with the latest time, then the greatest id.

    A hash aggregate, combined map-side: time and id are packed into one number.  Rows without a time or an id count
    for nothing where the key has others.
    """
    order = packed(F.unix_micros(F.col(time).cast("timestamp")), F.col(ident))
    return df.groupBy(*keys).agg(*(F.max_by(c, order).alias(c) for c in cols))


#: Rows of a slice, about, and cut points at most.
SLICE_ROWS = 500_000
MARKS = 1000


def order_slices(df: DataFrame, order: str, rows: int | None = None) -> Column:
    """Cut points of a long or timestamp column, as a scalar subquery: a job of the query that uses it, not of its making.

    The cuts follow the data, so that a slice holds about ``rows`` (SLICE_ROWS) of all rows even when one key or one
    hour dominates; beyond MARKS slices they grow.
    """
    marks = F.percentile_approx(order, [i / MARKS for i in range(1, MARKS)], 10 * MARKS)
    step = F.greatest(F.lit(1), F.floor(F.lit(MARKS * (rows or SLICE_ROWS)) / F.count("*")))
    found = df.agg(marks.alias("c"), step.alias("step"))
    return found.select(F.array_distinct(F.filter("c", lambda x, i: (i + 1) % F.col("step") == 0))).scalar()


def sliced_lag(df: DataFrame, keys: list[str], order: str, value: str, out: str, rows: int | None = None) -> DataFrame:
    """``lag(value)`` per key in ``order`` without one task per key.

    Rows are lagged inside (key, slice); the first row of a slice takes the last
    value of the nearest earlier non-empty slice of its key.  ``order`` is unique
    per key; it is a long (an arrival number or epoch micros).
    """
    sl = F.coalesce(F.size(F.filter("_cuts", lambda c: c < F.col(order))), F.lit(0))
    df = df.withColumn("_cuts", order_slices(df, order, rows))
    df = df.withColumn("_sl", sl).drop("_cuts")
    tails = df.groupBy(*keys, "_sl").agg(F.max_by(F.struct(F.col(value).alias("v")), F.col(order)).alias("_t"))
    tails = tails.withColumn("_carry", F.lag("_t").over(W.partitionBy(*keys).orderBy("_sl"))).drop("_t")
    w = W.partitionBy(*keys, "_sl").orderBy(order)
    local = df.withColumn("_p", F.lag(F.struct(F.col(value).alias("v"))).over(w))
    return (
        local.join(tails, [*keys, "_sl"], "left")
        .withColumn(out, F.coalesce("_p", "_carry").getField("v"))
        .drop("_sl", "_p", "_carry")
    )
