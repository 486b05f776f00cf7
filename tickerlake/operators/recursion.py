"""Recursive means of ordered values, a key's rows in slices that tasks work on side by side.

A recursive mean takes the mean before a row to the mean behind it by an affine map, and so does any stretch of
rows.  A key with more rows than SLICE is cut into slices.  A first pass turns each slice into its map (where it is
taken from a zero mean and from unit means), the maps are composed in order, which gives the state that each slice
starts from, and a second pass gives the rows' means from there.  Keys of at most SLICE rows are one slice and need
no first pass.  Rows stream through a task, sorted by key and order; no key is gathered.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows that are taken in one go; keys with more are cut, into MARKS slices at most.
SLICE = 1_000_000
MARKS = 1000


@dataclass(frozen=True)
class State:
    """The means behind a row (None before the first value), and how many nulls in a row came last."""

    means: np.ndarray | None = None
    nulls: int = 0


@dataclass(frozen=True)
class Means:
    """A mean for each name."""

    spans: dict[str, int]

    @property
    def names(self) -> list[str]:
        return list(self.spans)

    @property
    def size(self) -> int:
        return len(self.spans)

    def run(self, values: np.ndarray, state: State) -> tuple[list[np.ndarray], State]:
        """The means behind each value, and the state behind the last one."""
        if not len(values):
            return [values] * self.size, state
        lead = [] if state.means is None else [np.nan] * (state.nulls + 1)
        column = pd.Series(np.concatenate([lead, values]))
        out = []
        for k, span in enumerate(self.spans.values()):
            if lead:
                column.iloc[0] = state.means[k]
            out.append(column.ewm(span=span, adjust=False).mean().to_numpy()[len(lead) :])
        there = np.flatnonzero(~np.isnan(values))
        nulls = len(values) - 1 - int(there[-1]) if len(there) else state.nulls + len(values)
        if state.means is None and not len(there):
            return out, State()
        return out, State(np.array([x[-1] for x in out]), nulls)


class Macd:
    """A fast mean less a slow one, and the mean of this line; its state is the three means."""

    names, size = ["macd", "signal"], 3
    parts, line = Means({"fast": 12, "slow": 26}), Means({"signal": 9})

    def run(self, values: np.ndarray, state: State) -> tuple[list[np.ndarray], State]:
        (fast, slow), behind = self.parts.run(values, replace(state, means=None if state.means is None else state.means[:2]))
        line = fast - slow
        (signal,), last = self.line.run(line, State(None if state.means is None else state.means[2:]))
        return [line, signal], behind if behind.means is None else State(np.concatenate([behind.means, last.means]), behind.nulls)


class Stretch:
    """What rows do to a state: nulls in front, the first value, and the affine map of the rest from the state behind it."""

    def __init__(self, rule):
        self.rule, self.front, self.first, self.nulls = rule, 0, None, 0
        # the states that a zero state and unit states become; the first row is the constant part
        self.reached = np.vstack([np.zeros(rule.size), np.eye(rule.size)])

    def add(self, values: np.ndarray) -> None:
        if self.first is None:
            there = np.flatnonzero(~np.isnan(values))
            if not len(there):
                self.front += len(values)
                return
            self.front += int(there[0])
            self.first, values = float(values[there[0]]), values[there[0] + 1 :]
        if len(values):
            behind = [self.rule.run(values, State(means, self.nulls))[1] for means in self.reached]
            self.reached, self.nulls = np.array([s.means for s in behind]), behind[0].nulls

    def row(self) -> tuple:
        return self.front, self.first, self.nulls, self.reached.ravel().tolist()


def after(rule, state: State, front: int, first: float | None, nulls: int, reached: list[float]) -> State:
    """The state behind a stretch that was found elsewhere."""
    _, state = rule.run(np.concatenate([np.full(front, np.nan), [] if first is None else [first]]), state)
    if first is None:
        return state
    reached = np.array(reached).reshape(rule.size + 1, rule.size)
    return State(reached[0] + state.means @ (reached[1:] - reached[0]), nulls)


def stretches(batch: pa.RecordBatch, keys: int) -> list[tuple[int, int, tuple]]:
    """(begin, end, key) of the runs of equal first columns in sorted rows."""
    other = np.zeros(max(batch.num_rows - 1, 0), dtype=bool)
    for column in batch.columns[:keys]:
        a, b = column.slice(1), column.slice(0, len(other))
        other |= pc.coalesce(pc.not_equal(a, b), pc.not_equal(pc.is_null(a), pc.is_null(b))).to_numpy(zero_copy_only=False)
    cuts = [0, *(np.flatnonzero(other) + 1).tolist(), batch.num_rows]
    return [(a, b, tuple(c[a].as_py() for c in batch.columns[:keys])) for a, b in zip(cuts, cuts[1:]) if b > a]


def cut(df: DataFrame, keys: list[str], order: str, rows: int) -> tuple[DataFrame, bool]:
    """df with ``_slice``, and whether there are keys of more than ``rows`` rows: these are cut into stretches of about
    as many, numbered in order; other keys have a null.

    Such keys are at most one in ``rows`` of the table's rows, and have MARKS cut points at most.
    """
    large = df.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") > rows)
    large = large.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), "_n")
    if large.isEmpty():
        return df.withColumn("_slice", F.lit(None).cast("int")), False
    numeric = isinstance(df.schema[order].dataType, T.NumericType)
    placed = df.withColumn("_place", F.col(order).cast("long") if numeric else F.unix_micros(F.col(order).cast("timestamp")))
    same = reduce(lambda x, y: x & y, (F.col(f"_k{i}").eqNullSafe(F.col(k)) for i, k in enumerate(keys)))
    marks = F.percentile_approx("_place", [i / MARKS for i in range(1, MARKS)], 10 * MARKS)
    cuts = placed.join(large, same).groupBy(*large.columns).agg(marks.alias("_marks"))
    step = F.greatest(F.lit(1), F.floor(F.lit(MARKS * rows) / F.col("_n")))
    cuts = cuts.withColumn("_marks", F.array_distinct(F.filter("_marks", lambda x, i: (i + 1) % step == 0))).drop("_n")
    number = F.when(F.col("_marks").isNotNull(), F.size(F.filter("_marks", lambda x: F.coalesce(x < F.col("_place"), F.lit(False)))))
    return placed.join(cuts, same, "left").select(*df.columns, number.alias("_slice")), True


def starts(dealt: DataFrame, keys: int, rule) -> dict[tuple, State]:
    """The state that each slice of a cut key starts from; dealt: keys, _slice, value, ..., sorted."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, stretch = None, None

        def row() -> pa.RecordBatch:
            columns = [pa.array([v], f.type) for v, f in zip([*key, *stretch.row()], schema)]
            return pa.RecordBatch.from_arrays(columns, schema=schema)

        schema = None
        for batch in batches:
            schema = schema or pa.schema([*list(batch.schema)[: keys + 1], ("front", pa.int64()), ("first", pa.float64()), ("nulls", pa.int64()), ("reached", pa.list_(pa.float64()))])
            for a, b, own in stretches(batch, keys + 1):
                if own != key:
                    if stretch:
                        yield row()
                    key, stretch = own, Stretch(rule)
                stretch.add(batch.column(keys + 1).slice(a, b - a).to_numpy(zero_copy_only=False))
        if stretch:
            yield row()

    names = dealt.columns[: keys + 1]
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in dealt.schema.fields[: keys + 1])
    maps = dealt.where("_slice is not null").mapInArrow(found, f"{kinds}, front long, first double, nulls long, reached array<double>")
    out, last, state = {}, None, State()
    for r in maps.orderBy(*names).toLocalIterator():  # a row for each slice
        key = tuple(r[: keys + 1])
        state = state if key[:-1] == last else State()
        out[key], last = state, key[:-1]
        state = after(rule, state, *r[keys + 1 :])
    return out


def sliced(df: DataFrame, keys: list[str], order: str, c: str, rule, rows: int | None = None) -> DataFrame:
    """df with the columns of ``rule``, a recursion over the values of ``c`` in each key's rows in ``order``."""
    n = len(keys)
    whole, several = cut(df, keys, order, rows or SLICE)
    dealt = whole.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), "_slice", F.col(c).cast("double").alias("_value"), *df.columns)
    own = dealt.columns[: n + 1]
    dealt = dealt.repartition(*own).sortWithinPartitions(*own, order)
    begin = starts(dealt, n, rule) if several else {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, State()
        for batch in batches:
            out: list[list[np.ndarray]] = [[] for _ in rule.names]
            values = batch.column(n + 1).to_numpy(zero_copy_only=False)
            for a, b, own in stretches(batch, n + 1):
                if own != key:
                    key, state = own, begin.get(own, State())
                found, state = rule.run(values[a:b], state)
                for column, x in zip(out, found):
                    column.append(x)
            if batch.num_rows:
                made = [pa.array(np.concatenate(x), pa.float64(), from_pandas=True) for x in out]
                yield pa.RecordBatch.from_arrays([*batch.columns[n + 2 :], *made], [*batch.schema.names[n + 2 :], *rule.names])

    schema = T.StructType([*df.schema.fields, *(T.StructField(name, T.DoubleType()) for name in rule.names)])
    return dealt.mapInArrow(run, schema)
