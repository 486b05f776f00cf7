"""The breaker's walk in slices, against one walk over all days."""

import datetime as dt
import random

from hypothesis import given, settings
from hypothesis import strategies as st

from tickerlake.operators import breaker

PRICE = st.sampled_from([-1.0, 0.0, 1e-300, 0.1, 0.5, 1.0, 3.0, 4.999999999999999, 5.0, 5.000000000000001, 20.0, 25.0, 100.0, 130.0, 1e6, 1e308])
ROW = st.tuples(st.integers(0, 12), PRICE, PRICE, st.integers(0, 3), st.integers(0, 3), st.booleans())


def same(reference):
    """References that are not positive let all pass, like none."""
    return reference if reference is not None and reference > 0 else None


def plain(rows, reference=None):
    """Verdicts, and the reference behind, day by day."""
    out = []
    for day in sorted({r[0] for r in rows}):
        own, best = [r for r in rows if r[0] == day], None
        for _, close, adj, arrived, seen, stored in own:
            ok = stored or reference is None or reference <= 0 or 0.2 <= adj / reference <= 5.0
            out.append(ok)
            if ok and (best is None or (arrived, stored, -seen) > best[0]):
                best = (arrived, stored, -seen), close
        reference = best[1] if best else reference
    return out, reference


@settings(max_examples=400, deadline=None)
@given(st.lists(ROW, max_size=25), st.one_of(st.none(), PRICE), st.integers(0, 12))
def test_composed_tables_give_the_whole_walk(rows, reference, cut):
    rows = sorted(rows, key=lambda r: r[0])
    want, last = plain(rows, reference)
    got, at = [], reference
    for part in ([r for r in rows if r[0] < cut], [r for r in rows if r[0] >= cut]):
        table, walk = breaker.Table(), breaker.Walk(at)
        for r in part:
            table.row(*r)
            got.append(walk.row(*r))
        at = breaker.after(at, *table.table())
        assert same(at) == same(walk.behind())
    assert got == want and same(at) == same(last)


@settings(max_examples=300, deadline=None)
@given(st.floats(min_value=5e-324, max_value=1e308))
def test_bounds_are_exact(adj):
    low, high = breaker.bounds(adj)
    import math

    assert breaker.passes(adj, low) and breaker.passes(adj, high)
    assert not (math.nextafter(low, 0) > 0 and breaker.passes(adj, math.nextafter(low, 0))) and not breaker.passes(adj, math.nextafter(high, math.inf))


def test_one_instrument_in_slices(spark):
    """An instrument with nearly all rows, jumps, and days on which nothing is accepted."""
    rng, rows, px = random.Random(5), [], 100.0
    for i in range(3000):
        px = max(0.01, px * rng.choice([0.9, 1.1, 1.0, 8.0 if rng.random() < 0.1 else 1.0, 0.05 if rng.random() < 0.05 else 1.0]))
        for k in range(rng.choice([1, 1, 2])):
            rows.append((1, dt.date(2010, 1, 1) + dt.timedelta(i), px + k, px * (1 + k), rng.randrange(5), rng.randrange(5), f"r{k}", rng.random() < 0.02))
    rows += [(2, dt.date(2010, 1, d), 100.0 * 6**d, 100.0 * 6**d, 1, 1, "r", False) for d in range(1, 6)]
    df = spark.createDataFrame(rows, "instrument_id long, trade_date date, close double, adj double, arrived long, first_seen long, first_id string, is_stored boolean")
    want = []
    for key in (1, 2):
        own = sorted((r for r in rows if r[0] == key), key=lambda r: (r[1], r[6], r[2], r[3]))
        verdicts, _ = plain([(r[1], r[2], r[3], r[4], r[5], r[7]) for r in own])
        want += [(*r[:4], ok) for r, ok in zip(own, verdicts) if not r[7]]
    for size in (10**6, 300):
        found = breaker.walked(df, size)
        assert "FlatMapGroupsInPandas" not in found._jdf.queryExecution().toString()
        assert sorted(tuple(r) for r in found.collect()) == sorted(want)
    assert 0 < sum(not w[-1] for w in want) < len(want)
