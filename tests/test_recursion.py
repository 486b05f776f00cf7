"""Recursive means in slices, against pandas over whole keys."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tickerlake.operators import indicators, recursion

VALUES = st.lists(st.one_of(st.none(), st.floats(-1e6, 1e6)), min_size=1, max_size=60)


def plain_macd(v):
    line = v.ewm(span=12, adjust=False).mean() - v.ewm(span=26, adjust=False).mean()
    return line, line.ewm(span=9, adjust=False).mean()


@settings(max_examples=200, deadline=None)
@given(VALUES, st.lists(st.integers(0, 60), max_size=4), st.booleans())
def test_composed_slices_give_the_whole(values, cuts, macd):
    """Each slice's map applied to the state before it, then its rows from there, also batch by batch."""
    rule = recursion.Macd() if macd else recursion.Means({"a": 1, "b": 5, "c": 40})
    v = pd.Series(values, dtype=float)
    want = plain_macd(v) if macd else [v.ewm(span=n, adjust=False).mean() for n in (1, 5, 40)]
    state, got = recursion.State(), []
    edges = [0, *sorted(min(c, len(v)) for c in cuts), len(v)]
    for a, b in zip(edges, edges[1:]):
        stretch = recursion.Stretch(rule)
        for part in np.array_split(v.to_numpy()[a:b], 2):
            stretch.add(part)
        got.append(rule.run(v.to_numpy()[a:b], state)[0])
        state = recursion.after(rule, state, *stretch.row())
    for k, w in enumerate(want):
        np.testing.assert_allclose(np.concatenate([g[k] for g in got]), w.to_numpy(), rtol=1e-9, atol=1e-9 * (1 + np.nanmax(np.abs(v)) if v.notna().any() else 1))


@pytest.mark.parametrize("rows", [10**6, 500])
def test_hot_key_in_slices(spark, rows):
    rng = np.random.default_rng(3)
    sizes = {("HOT", 1): 9000, ("b", None): 700, (None, 2): 3, ("c", 1): 1}
    parts = []
    for (k, j), n in sizes.items():
        px = 100 + rng.normal(size=n).cumsum()
        px[rng.random(n) < 0.05] = np.nan
        parts.append(pd.DataFrame({"k": k, "j": pd.array([j] * n, dtype="Int64"), "at": [dt.datetime(2020, 1, 1) + dt.timedelta(minutes=i) for i in range(n)], "px": px, "macd_": "x"}))
    pdf = pd.concat(parts, ignore_index=True)
    rows_of = [(k, None if pd.isna(j) else int(j), at.to_pydatetime(), None if np.isnan(px) else px, x) for k, j, at, px, x in pdf.sample(frac=1, random_state=1).itertuples(index=False)]
    df = spark.createDataFrame(rows_of, "k string, j long, at timestamp, px double, macd_ string")
    got = recursion.sliced(df, ["k", "j"], "at", "px", recursion.Macd(), rows)
    assert got.columns == [*df.columns, "macd", "signal"]
    assert "FlatMapGroupsInPandas" not in got._jdf.queryExecution().toString()
    if rows == 500:
        whole, several = recursion.cut(df, ["k", "j"], "at", rows)
        slices = [r[0] for r in whole.where("k = 'HOT'").groupBy("_slice").count().select("count").collect()]
        assert several and len(slices) > 10 and max(slices) < 1000
        assert {r[0] for r in whole.where("k = 'c'").select("_slice").collect()} == {None}
    out = got.toPandas().sort_values("at")
    for (k, j), own in pdf.groupby(["k", "j"], dropna=False):
        mine = out[(out["k"].isna() if pd.isna(k) else out["k"] == k) & (out["j"].isna() if pd.isna(j) else out["j"] == j)]
        for name, want in zip(("macd", "signal"), plain_macd(own["px"])):
            np.testing.assert_allclose(mine[name].to_numpy(dtype=float), want.to_numpy(), rtol=1e-9, atol=1e-9)


def test_empty(spark):
    df = spark.createDataFrame([], "k string, at date, px double")
    assert indicators.ema(df, ["k"], "at", "px", {"e": 3}).collect() == []
    assert indicators.macd(df, ["k"], "at", "px").columns == ["k", "at", "px", "macd", "signal"]
