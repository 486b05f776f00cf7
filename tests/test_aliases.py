"""Alias changes in sequence, against a plain registry that takes one after the other."""

import datetime as dt
import random

from hypothesis import given, settings
from hypothesis import strategies as st

from tickerlake.operators import aliases

COLUMNS = "alias_id long, instrument_id long, source_system string, alias_symbol string, valid_from date, valid_to date"
DAY = dt.date(2024, 1, 1)


def plain(stored, changes, known):
    """Rows by id and refusals by seq; every change looks at all rows."""
    rows, errors = {r[0]: r[1:] for r in stored}, {}
    for seq, op, alias_id, inst, source, symbol, begin, end in sorted(changes, key=lambda c: c[0]):
        source, symbol = (source or "").strip().upper() or None, (symbol or "").strip().upper() or None
        if op == "CREATE" and alias_id in rows:
            errors[seq] = "ALIAS_EXISTS"
        elif op != "CREATE" and alias_id not in rows:
            errors[seq] = "ALIAS_NOT_FOUND"
        elif op != "CLOSE" and source not in ("NSE", "BSE", "ISIN", "YAHOO"):
            errors[seq] = "UNSUPPORTED_SOURCE"
        elif end is not None and end < (rows[alias_id][3] if op == "CLOSE" else begin):
            errors[seq] = "REVERSED_WINDOW"
        elif op != "CLOSE" and inst not in known:
            errors[seq] = "INSTRUMENT_NOT_FOUND"
        elif op == "CLOSE":
            rows[alias_id] = (*rows[alias_id][:4], end)
        elif any(i != alias_id and r[0] != inst and r[1:3] == (source, symbol) and r[3] <= (end or dt.date.max) and begin <= (r[4] or dt.date.max) for i, r in rows.items()):
            errors[seq] = "ALIAS_CONFLICT"
        else:
            rows[alias_id] = (inst, source, symbol, begin, end)
    return rows, errors


def made(rng, n, keys, ids):
    """Stored aliases without conflicts, and n changes of few keys, days and ids."""
    stored = [(i, i % 3 + 1, "NSE", f"K{i}", DAY + dt.timedelta(10 * i), DAY + dt.timedelta(10 * i + 5) if i % 2 else None) for i in range(keys)]
    changes = []
    for seq in range(n):
        begin = rng.randrange(60)
        op = rng.choice(["CREATE", "CREATE", "UPDATE", "CLOSE"])
        window = (None if op == "CLOSE" else DAY + dt.timedelta(begin), DAY + dt.timedelta(begin + rng.randrange(-1, 15)) if op == "CLOSE" or rng.random() < 0.8 else None)
        changes.append((seq, op, rng.randrange(ids), rng.randrange(1, 5), rng.choice(["nse", "NSE ", "BSE", "FEED"] if rng.random() < 0.2 else ["NSE"]), f"k{rng.randrange(keys)}", *window))
    return stored, changes


def as_in_book(stored, changes, known):
    """The same by the operator's windows, without Spark."""
    book, errors = aliases.Book(), {}
    number = lambda d: None if d is None else d.toordinal()
    for alias_id, *row, begin, end in stored:
        book.put(alias_id, (*row, number(begin), number(end)))
    for seq, op, alias_id, inst, source, symbol, begin, end in changes:
        error = book.change(op, alias_id, (inst, source.strip().upper(), symbol.strip().upper(), number(begin), number(end)), inst in known)
        errors |= {seq: error} if error else {}
    return {i: (*r[:3], *(d and dt.date.fromordinal(d) for d in r[3:])) for i, r in book.aliases.items()}, errors


@settings(max_examples=150, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 60), st.integers(1, 4), st.integers(2, 30))
def test_windows_like_a_plain_registry(seed, n, keys, ids):
    stored, changes = made(random.Random(seed), n, keys, ids)
    assert as_in_book(stored, changes, {1, 2, 3}) == plain(stored, changes, {1, 2, 3})


def run(spark, stored, changes, known):
    table, errors = aliases.merge_aliases(
        spark.createDataFrame(stored, COLUMNS), spark.createDataFrame(changes, f"seq long, op string, {COLUMNS}"), spark.createDataFrame([(k,) for k in known], "instrument_id long"))
    return {r[0]: tuple(r[1:]) for r in table.collect()}, {r.seq: r.error for r in errors.collect()}


def test_like_a_plain_registry(spark):
    """Aliases that move tie keys together; one key has a third of all changes."""
    stored, changes = made(random.Random(8), 600, 40, 200)
    changes = [(*c[:5], "K0" if c[0] % 3 == 0 else c[5], *c[6:]) for c in changes]
    assert run(spark, stored, changes, {1, 2, 3}) == plain(stored, changes, {1, 2, 3})


def test_closed_window_is_free_and_a_refused_change_blocks_nothing(spark):
    d = lambda n: DAY + dt.timedelta(n)
    stored = [(1, 1, "NSE", "A", d(0), None), (2, 1, "NSE", "UNTOUCHED", d(0), None)]
    changes = [
        (1, "CREATE", 10, 2, "NSE", "A", d(9), None), (2, "CLOSE", 1, None, None, None, None, d(4)), (3, "CREATE", 11, 3, "NSE", "A", d(9), d(20)), (4, "UPDATE", 11, 3, "NSE", "B", d(9), d(20)),
        (5, "CREATE", 12, 2, "NSE", "A", d(9), None), (6, "CREATE", 12, 2, "NSE", "C", d(9), None), (7, "CREATE", 13, 1, "NSE", "A", None, None), (8, "CLOSE", 12, None, None, None, None, None),
        (9, "CLOSE", 99, None, None, None, None, d(1)), (10, "DROP", 1, None, None, None, None, None),
    ]
    rows, errors = run(spark, stored, changes, {1, 2, 3})
    assert errors == {1: "ALIAS_CONFLICT", 6: "ALIAS_EXISTS", 7: "MISSING_DAY", 8: "MISSING_DAY", 9: "ALIAS_NOT_FOUND", 10: "UNKNOWN_OPERATION"}
    assert rows == {1: (1, "NSE", "A", d(0), d(4)), 2: stored[1][1:], 11: (3, "NSE", "B", d(9), d(20)), 12: (2, "NSE", "A", d(9), None)}
    assert run(spark, stored, [], {1})[0] == {1: stored[0][1:], 2: stored[1][1:]}
