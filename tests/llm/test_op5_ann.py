import numpy as np
import pytest

from tickerlake.llm import common
from tickerlake.llm import op5_ann as op

SCHEMA = "vec_id long, embedding array<float>, score string, rank string"


def brute(rows, every=op.EVERY, k=op.K):
    good = {}
    for i, v, *_ in rows:
        if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v):
            v = [float(np.float32(x)) for x in v]
            good[i] = min(good.get(i, v), v)
    out = {}
    for q, a in good.items():
        if q % every == 0:
            gaps = sorted((float(np.sqrt(((np.array(b) - np.array(a)) ** 2).sum())), i) for i, b in good.items() if i != q and len(b) == len(a))
            out[q] = gaps[:k]
    return out


def got(spark, rows, **options):
    found = {}
    for r in op.search(spark.createDataFrame(rows, SCHEMA).repartition(3), **options).orderBy("query_id", "rank").collect():
        assert r.rank == len(found.setdefault(r.query_id, [])) + 1
        found[r.query_id].append((r.score, r.vec_id))
    return found


def alike(a, b):
    assert set(a) == {q for q in b if b[q]}
    for q in a:
        assert [i for _, i in a[q]] == [i for _, i in b[q]] and np.allclose([s for s, _ in a[q]], [s for s, _ in b[q]], rtol=1e-12)


def test_odd_vectors_and_ties(spark):
    rng = np.random.default_rng(0)
    rows = [(i, rng.normal(size=5).tolist(), "x", "x") for i in range(0, 400)]
    rows += [(1000 + i, [1.0, 0.0, 0.0, 0.0, 0.0], "x", "x") for i in range(130)]  # a common vector, held by queries too
    rows += [(2000, None, "x", "x"), (2100, [], "x", "x"), (2200, [0.0] * 5, "x", "x"), (2300, [1.0, None, 0.0, 0.0, 0.0], "x", "x"), (2400, [float("nan")] * 5, "x", "x"), (2500, [float("inf"), 1.0, 0.0, 0.0, 0.0], "x", "x")]
    rows += [(None, [1.0] * 5, "x", "x"), (3000, [1.0, 2.0], "x", "x"), (3001, [1.0, 2.5], "x", "x"), (3100, [4.0] * 7, "x", "x"), (100, rows[100][1], "x", "x"), (5, [9.0] * 5, "x", "x"), (3200, [1e30, 1e-30, 0.0, 0.0, 0.0], "x", "x")]
    alike(got(spark, rows, most=1000), brute(rows))
    assert got(spark, []) == {}


@pytest.mark.parametrize("large", [7, 8192])
def test_few_probes_still_give_ten(spark, monkeypatch, large):
    monkeypatch.setattr(op, "LARGE", large)
    monkeypatch.setattr(op, "BLOCK", 60)
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=16).tolist(), "x", "x") for i in range(300)]
    found = got(spark, rows, tables=1, most=1)
    assert {q: len(x) for q, x in found.items()} == {0: 10, 100: 10, 200: 10}


def test_recall(spark):
    vectors = common.table(spark, "/root/testdata/sf0.1", "embeddings").select("vec_id", "embedding")
    rows = [(r.vec_id, list(r.embedding), "x", "x") for r in vectors.collect()]
    want = brute(rows)
    found = got(spark, rows)
    hits = sum(len({i for _, i in want[q]} & {i for _, i in found[q]}) for q in want)
    assert hits / sum(len(x) for x in want.values()) >= 0.9
    exact = dict((i, {j: s for s, j in x}) for i, x in want.items())
    for q, x in found.items():
        for s, i in x:
            if i in exact[q]:
                assert s == pytest.approx(exact[q][i], rel=1e-12)


@pytest.mark.parametrize("n", [100_000, 200_000, 3_000_000, 1_000_000_000])
def test_long_keys_do_not_lose_neighbours(n):
    rng = np.random.default_rng(7)
    count = op.names(n, 64)
    most = op.looked_up(count, 64)
    assert most <= op.MOST_PROBES
    queries = op.prepared(rng.normal(size=(60, 64)).tolist())
    aside = op.prepared(rng.normal(size=(60, 64)).tolist())
    near = op.prepared((0.5 * queries + 0.866 * aside).tolist())  # as near as the nearest ones of the given vectors
    found = np.zeros(60, dtype=bool)
    for t in range(op.TABLES):
        looked = op.combined(op.probes(queries, t, count, most)[0], 64)
        found |= (looked == op.combined(op.keys(near, t, count), 64)[:, None]).any(axis=1)
    assert found.mean() >= 0.9


def test_rotation_keeps_lengths():
    x = op.prepared(np.random.default_rng(5).normal(size=(9, 3)).tolist())
    assert np.allclose(np.linalg.norm(op.rotated(x, 2, 1), axis=1), 1)
    names = op.keys(x, 0, 2)
    looked, _ = op.probes(x, 0, 2, 16)
    assert (looked[:, 0] == names).all()
