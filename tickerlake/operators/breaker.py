"""The circuit breaker's walk over an instrument's days, in slices that are walked side by side.

A row is accepted when its adjusted close lies within [LOW, HIGH] times the reference, the last accepted close of an
earlier day; so each verdict depends on those before it.  What a slice of days does depends on the reference it
starts from alone, and references between two neighbouring bounds of its rows lead to the same verdicts.  So a
slice is a short table from stretches of references to the reference behind it, tables are composed in order, and every
slice is then walked from its own reference.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickerlake.operators import recursion

# --- fixed values -----------------------------------------------------------
LOW, HIGH = 0.2, 5.0
# ----------------------------------------------------------------------------
#: Versions (distinct day, close and adjusted close) of an instrument that are walked in one go.
SLICE = 200_000
OUT = "instrument_id long, trade_date date, close double, adj double, breaker_ok boolean"


def passes(adj: float, reference: float | None) -> bool:
    return reference is None or reference <= 0 or LOW <= adj / reference <= HIGH


class Walk:
    """Verdicts of rows in order of days; within a day all are held against the day before."""

    def __init__(self, reference: float | None = None):
        self.reference, self.day, self.best, self.pending = reference, None, None, None

    def row(self, day, close: float, adj: float, arrived: int, first_seen: int, stored: bool) -> bool:
        if day != self.day:
            self.reference = self.behind()
            self.day, self.best = day, None
        ok = stored or passes(adj, self.reference)
        # a stored row keeps its place unless a candidate is strictly newer
        rank = (arrived, stored, -first_seen)
        if ok and (self.best is None or rank > self.best):
            self.best, self.pending = rank, close
        return ok

    def rows(self, *columns: list) -> list[bool]:
        """``row`` for each of many rows, given by columns."""
        reference, today, best, pending = self.reference, self.day, self.best, self.pending
        out = []
        for day, close, adj, arrived, first_seen, stored in zip(*columns):
            if day != today:
                if best is not None:
                    reference = pending
                today, best = day, None
            ok = stored or reference is None or reference <= 0 or LOW <= adj / reference <= HIGH
            if ok:
                rank = (arrived, stored, -first_seen)
                if best is None or rank > best:
                    best, pending = rank, close
            out.append(ok)
        self.reference, self.day, self.best, self.pending = reference, today, best, pending
        return out

    def behind(self) -> float | None:
        """The reference behind the rows so far."""
        return self.reference if self.best is None else self.pending


def bounds(adj: float) -> tuple[float, float]:
    """The least and the greatest positive reference that lets an adjusted close pass; (inf, 0) if none does."""
    if not 0 < adj < math.inf:
        return math.inf, 0.0
    low, high = adj / HIGH, adj / LOW
    while low > 0 and passes(adj, math.nextafter(low, 0)):
        low = math.nextafter(low, 0)
    while not passes(adj, low):
        low = math.nextafter(low, math.inf)
    while passes(adj, math.nextafter(high, math.inf)):
        high = math.nextafter(high, math.inf)
    while not passes(adj, high):
        high = math.nextafter(high, 0)
    return low, high


class Table:
    """What a slice makes of the reference before it.

    ``free`` is for none (or one that is not positive); stretches of positive references are (first, value): up to
    the next first one, the reference behind is the value, or unchanged where it is None.
    """

    def __init__(self) -> None:
        self.day, self.rows = None, []
        self.free: float | None = None
        self.stretches: list[tuple[float, float | None]] = [(math.nextafter(0, 1), None)]

    def row(self, day, *rest) -> None:
        if day != self.day:
            self.close_day()
            self.day = day
        self.rows.append((day, *rest))

    def after_day(self, reference: float | None) -> float | None:
        walk = Walk(reference)
        for r in self.rows:
            walk.row(*r)
        return walk.behind()

    def close_day(self) -> None:
        if not self.rows:
            return
        known: dict[float, float | None] = {}
        for _, value in self.stretches:
            if value is not None and value not in known:
                known[value] = self.after_day(value)
        self.free = self.after_day(self.free)
        edges = sorted({e for _, _, adj, *_ in self.rows for low, high in [bounds(adj)] if low < math.inf for e in (low, math.nextafter(high, math.inf))})
        out: list[tuple[float, float | None]] = []
        for k, (first, value) in enumerate(self.stretches):
            end = self.stretches[k + 1][0] if k + 1 < len(self.stretches) else math.inf
            for at in [first] if value is not None else [first, *(e for e in edges if first < e < end)]:
                reached = known[value] if value is not None else self.after_day(at)
                if value is None and not any(stored or passes(adj, at) for _, _, adj, _, _, stored in self.rows):
                    reached = None
                if not out or out[-1][1] != reached:
                    out.append((at, reached))
        self.stretches, self.rows = out, []

    def table(self) -> tuple[float | None, list[float], list[float | None]]:
        self.close_day()
        return self.free, [a for a, _ in self.stretches], [b for _, b in self.stretches]


def after(reference: float | None, free: float | None, firsts: list[float], values: list[float | None]) -> float | None:
    """The reference behind a slice."""
    if reference is None or reference <= 0:
        return free
    value = [v for first, v in zip(firsts, values) if first <= reference][-1]
    return reference if value is None else value


def references(dealt: DataFrame) -> dict[tuple, float | None]:
    """The reference that each slice of a cut instrument starts from; dealt as in ``walked``."""

    def tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, table = None, Table()
        names = ["instrument_id", "_slice", "free", "firsts", "values"]
        kinds = [pa.int64(), pa.int32(), pa.float64(), pa.list_(pa.float64()), pa.list_(pa.float64())]

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip([*key, *table.table()], kinds)], names)

        for batch in batches:
            for own_key, *rest in zip(zip(*(c.to_pylist() for c in batch.columns[:2])), *(c.to_pylist() for c in batch.columns[2:8])):
                if own_key != key:
                    if key:
                        yield row()
                    key, table = own_key, Table()
                table.row(*rest)
        if key:
            yield row()

    found = dealt.where("_slice is not null").mapInArrow(tables, "instrument_id long, _slice int, free double, firsts array<double>, values array<double>")
    out, last, reference = {}, None, None
    for r in found.orderBy("instrument_id", "_slice").toLocalIterator():  # a row for each slice
        reference = reference if r.instrument_id == last else None
        out[r.instrument_id, r._slice], last = reference, r.instrument_id
        reference = after(reference, r.free, r.firsts, r["values"])
    return out


def plain(column: pa.Array) -> list:
    """The values of a column, days as numbers (their objects take longer to make than a row to walk)."""
    if pa.types.is_date32(column.type):
        column = column.cast(pa.int32())
    return column.to_pylist() if column.null_count else column.to_numpy(zero_copy_only=False).tolist()


def walked(versions: DataFrame, rows: int | None = None) -> DataFrame:
    """Verdicts (OUT) of the versions that are not stored.

    versions: instrument_id, trade_date, close, adj, arrived, first_seen, first_id, is_stored.  Rows stream through a
    task in order; an instrument with more than SLICE rows is cut between days.
    """
    cut, several = recursion.cut(versions, ["instrument_id"], "trade_date", rows or SLICE)
    dealt = cut.select(F.col("instrument_id").cast("long").alias("instrument_id"), F.col("_slice").cast("int").alias("_slice"), "trade_date", "close", "adj", "arrived", "first_seen", "is_stored", "first_id")
    dealt = dealt.repartition("instrument_id", "_slice").sortWithinPartitions("instrument_id", "_slice", "trade_date", "first_id", "close", "adj")
    begin = references(dealt) if several else {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, walk = None, Walk()
        for batch in batches:
            verdicts, columns = [], [plain(c) for c in batch.columns[2:8]]
            for a, b, own in recursion.stretches(batch, 2):
                if own != key:
                    key, walk = own, Walk(begin.get(own))
                verdicts += walk.rows(*(c[a:b] for c in columns))
            new = pa.compute.invert(batch.column(7))
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in (0, 2, 3, 4)), pa.array(verdicts, pa.bool_())], ["instrument_id", "trade_date", "close", "adj", "breaker_ok"]).filter(new)

    return dealt.mapInArrow(run, OUT)
