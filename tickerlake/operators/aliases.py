"""Alias changes applied one after the other.

A change is judged against what the changes before it have left.  Changes can only meet under one (source, symbol),
or where an alias moves from one to another; such keys form a group, and groups are independent.  A group's stored
aliases and changes stream through a task in order, which keeps the group's open windows alone: sorted begins and
ends for each key and for each instrument of a key, so that a change is judged by four look-ups.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickerlake import session
from tickerlake.operators import identity, linked

#: Day number of an open end.
OPEN = 1 << 40
WINDOW = ["instrument_id", "source_system", "alias_symbol", "valid_from", "valid_to"]
OUT = "final boolean, seq long, op string, error string, alias_id long, instrument_id long, source_system string, alias_symbol string, valid_from int, valid_to int"


class Windows:
    """Day windows with inclusive ends; how many of them a window meets."""

    def __init__(self) -> None:
        self.begins: list[int] = []
        self.ends: list[int] = []

    def add(self, begin: int, end: int) -> None:
        bisect.insort(self.begins, begin)
        bisect.insort(self.ends, end)

    def remove(self, begin: int, end: int) -> None:
        del self.begins[bisect.bisect_left(self.begins, begin)], self.ends[bisect.bisect_left(self.ends, end)]

    def meeting(self, begin: int, end: int) -> int:
        return bisect.bisect_right(self.begins, end) - bisect.bisect_left(self.ends, begin)


class Book:
    """The aliases of a group, by id, and their windows."""

    def __init__(self) -> None:
        self.aliases: dict[int, tuple] = {}
        self.windows: dict[tuple, Windows] = {}
        self.changed: set[int] = set()

    def put(self, alias_id: int, row: tuple) -> None:
        instrument, source, symbol, begin, end = self.aliases[alias_id] = row
        for key in ((source, symbol), (source, symbol, instrument)):
            self.windows.setdefault(key, Windows()).add(begin, OPEN if end is None else end)

    def take(self, alias_id: int) -> tuple:
        row = instrument, source, symbol, begin, end = self.aliases.pop(alias_id)
        for key in ((source, symbol), (source, symbol, instrument)):
            self.windows[key].remove(begin, OPEN if end is None else end)
            if not self.windows[key].begins:
                del self.windows[key]
        return row

    def conflicts(self, instrument: int, source: str, symbol: str, begin: int, end: int | None) -> bool:
        """Whether the window meets one of another instrument."""
        count = [self.windows[key].meeting(begin, OPEN if end is None else end) if key in self.windows else 0 for key in ((source, symbol), (source, symbol, instrument))]
        return count[0] > count[1]

    def change(self, op: str, alias_id: int, row: tuple, known: bool) -> str | None:
        """Carries a change out, or says why not."""
        instrument, source, symbol, begin, end = row
        if op not in ("CREATE", "UPDATE", "CLOSE"):
            return "UNKNOWN_OPERATION"
        if (op == "CREATE") == (alias_id in self.aliases):
            return "ALIAS_EXISTS" if op == "CREATE" else "ALIAS_NOT_FOUND"
        if op == "CLOSE":
            row = self.aliases[alias_id][:4] + (end,)
            begin = row[3]
        elif source not in identity.ALIAS_SOURCES:
            return "UNSUPPORTED_SOURCE"
        if begin is None or (op == "CLOSE" and end is None):
            return "MISSING_DAY"
        if end is not None and end < begin:
            return "REVERSED_WINDOW"
        if op != "CLOSE" and not known:
            return "INSTRUMENT_NOT_FOUND"
        own = self.take(alias_id) if op != "CREATE" else None
        if op != "CLOSE" and self.conflicts(*row):
            if own:
                self.put(alias_id, own)
            return "ALIAS_CONFLICT"
        self.put(alias_id, row)
        self.changed.add(alias_id)
        return None


def _sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Verdicts of changes as they come, and the changed aliases of a group behind its last change."""
    group, book = None, Book()
    names = [field.split()[0] for field in OUT.split(", ")]
    schema = pa.schema([(n, {"boolean": pa.bool_(), "long": pa.int64(), "int": pa.int32(), "string": pa.string()}[field.split()[1]]) for n, field in zip(names, OUT.split(", "))])

    def finals() -> list[tuple]:
        return [(True, None, None, None, i, *book.aliases[i]) for i in sorted(book.changed)]

    for batch in batches:
        out: list[tuple] = []
        for own, stored, seq, op, alias_id, known, *row in zip(*(c.to_pylist() for c in batch.columns)):
            if own != group:
                out += finals()
                group, book = own, Book()
            if stored:
                book.put(alias_id, tuple(row))
            else:
                out.append((False, seq, op, book.change(op, alias_id, tuple(row), known), alias_id, *row))
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)] if out else [pa.array([], f.type) for f in schema], schema=schema)
    last = finals()
    if last:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*last), schema)], schema=schema)


def _key(source: str, symbol: str):
    return F.to_json(F.array(source, symbol))


def in_sequence(current: DataFrame, mutations: DataFrame, instruments: DataFrame) -> DataFrame:
    """(final, ...) rows of OUT, written: a verdict for every mutation, and every changed alias as it ends up (final)."""
    named = mutations.withColumn("source_system", F.upper(F.trim("source_system"))).withColumn("alias_symbol", F.upper(F.trim("alias_symbol")))
    opens = named.where("op <> 'CLOSE'").select("alias_id", _key("source_system", "alias_symbol").alias("key"))
    stored = current.select("alias_id", *WINDOW, _key("source_system", "alias_symbol").alias("key"))
    held = stored.join(mutations.select("alias_id").distinct(), "alias_id", "left_semi").select("alias_id", "key")
    keys = session.stage(opens.unionByName(held).where("alias_id is not null and key is not null").distinct(), "alias-keys")
    homes = keys.groupBy("alias_id").agg(F.min("key").alias("home"), F.count("*").alias("n"))
    tied = linked.groups(keys.join(homes.where("n > 1"), "alias_id").select("key", "home"))
    grouped = keys.select("key").distinct().join(tied, "key", "left").select("key", F.coalesce("group", "key").alias("group"))
    of_alias = homes.join(grouped.withColumnRenamed("key", "home"), "home").select("alias_id", "group")
    begin, end = F.unix_date("valid_from").alias("valid_from"), F.unix_date("valid_to").alias("valid_to")
    row = ["instrument_id", "source_system", "alias_symbol", begin, end]
    none = F.lit(None)
    old = stored.join(grouped, "key").select("group", F.lit(True).alias("stored"), none.cast("long").alias("seq"), none.cast("string").alias("op"), "alias_id", F.lit(True).alias("known"), *row)
    known = instruments.select("instrument_id", F.lit(True).alias("known")).distinct()
    new = named.join(of_alias, "alias_id", "left").join(known, "instrument_id", "left")
    alone = F.concat(F.lit("alias "), F.coalesce(F.col("alias_id").cast("string"), F.col("seq").cast("string")))
    new = new.select(F.coalesce("group", alone).alias("group"), F.lit(False).alias("stored"), F.col("seq").cast("long").alias("seq"), "op", "alias_id", F.coalesce("known", F.lit(False)).alias("known"), *row)
    rows = old.unionByName(new).repartition("group").sortWithinPartitions("group", F.desc("stored"), "seq", "alias_id", "op")
    return session.stage(rows.mapInArrow(_sweep, OUT), "alias-changes")


def merge_aliases(current: DataFrame, mutations: DataFrame, instruments: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(aliases, errors) after CREATE, UPDATE and CLOSE mutations in the order of ``seq``.

    Mutations: seq, op, alias_id, instrument_id, source_system, alias_symbol, valid_from, valid_to; an alias may be
    changed any number of times.  Creates and updates must not overlap a window of another instrument under the same
    source and symbol, as earlier mutations have left it: a closed window is free for a later create, an accepted
    one blocks, a refused one does not.  A close needs a last day, others a first one.
    """
    done = in_sequence(current, mutations, instruments)
    day = [F.date_from_unix_date(c).alias(c) for c in ("valid_from", "valid_to")]
    changed = done.where("final").select("alias_id", *WINDOW[:3], *day)
    kept = current.select("alias_id", *WINDOW).join(changed.select("alias_id"), "alias_id", "left_anti")
    return kept.unionByName(changed), done.where("not final and error is not null").select("seq", "op", "error")
