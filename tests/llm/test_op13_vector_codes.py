import hashlib
import math

import numpy as np
import pytest

from tickerlake.llm import op13_vector_codes as op

SCHEMA = "vec_id long, embedding array<float>, label int, code string, n int"


def brute(rows):
    """Every part against every entry, in whole numbers."""
    kept = [(i, [math.floor(256 * np.float32(x).item()) for x in v], label) for i, v, label, *_ in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    if not kept:
        return []
    d = len(kept[0][1]) // 16
    parts = [[r[1][p * d : (p + 1) * d] for r in kept] for p in range(16)]
    first = sorted(range(len(kept)), key=lambda k: (kept[k][0] is None, kept[k][0] or 0, kept[k][1]))[:64]
    books = [[parts[p][k] for k in first] for p in range(16)]

    def nearest(p, x):
        return min((sum((a - b) ** 2 for a, b in zip(x, e)), i) for i, e in enumerate(books[p]))

    for _ in range(2):
        for p in range(16):
            own = {}
            for x in parts[p]:
                own.setdefault(nearest(p, x)[1], []).append(x)
            books[p] = [[sum(c) // len(c) for c in zip(*own[i])] if i in own else e for i, e in enumerate(books[p])]
    told = hashlib.sha256(",".join(str(c) for book in books for e in book for c in e).encode()).hexdigest()
    coded = [[nearest(p, parts[p][k]) for p in range(16)] for k in range(len(kept))]
    errors = [sum(e for e, _ in row) for row in coded]
    sums = {}
    for r, e in zip(kept, errors):
        sums[r[2]] = sums.get(r[2], 0) + e
    return sorted(((r[0], "".join(f"{i:02x}" for _, i in row), e, sums[r[2]], told) for r, row, e in zip(kept, coded, errors)), key=str)


def coded(spark, rows):
    got = op.vector_codes(spark.createDataFrame(rows, SCHEMA)).collect()
    return sorted(((r.vec_id, r.code, r.error, r.label_error, r.codebooks_sha256) for r in got), key=str)


@pytest.mark.parametrize("width,n", [(16, 40), (32, 300), (48, 150)])
def test_against_all_entries(spark, width, n):
    rng = np.random.default_rng(width)
    rows = [(i * 3 % n, rng.normal(size=width).astype(np.float32).tolist(), int(rng.integers(4)) if i % 5 else None, "x", 1) for i in range(n)]
    rows += rows[7:9] + [(i, rows[3][1], 1, "x", 1) for i in (500, 501)] + [(1, [0.0] * width, None, "x", 1), (None, [-0.001] * width, 77, "x", 1)]
    rows += [(600, None, 1, "x", 1), (601, [None] * width, 1, "x", 1), (602, [float("nan")] * width, None, "x", 1), (603, [float("-inf")] + [0.0] * (width - 1), 1, "x", 1)]
    assert coded(spark, rows) == brute(rows)


def test_hot_labels_and_ties(spark):
    rows = [(i, [float(i % 3)] * 16, i if i % 3 else 5, "x", 1) for i in range(1500)]
    assert coded(spark, rows) == brute(rows)


def test_few_none_and_wrong(spark):
    assert coded(spark, []) == [] == coded(spark, [(1, None, 1, "x", 1), (2, [None], 1, "x", 1)])
    one = [(4, [0.5] * 16, None, "x", 1)]
    assert coded(spark, one) == brute(one)
    assert [r[1:4] for r in coded(spark, [(4, [], None, "x", 1)])] == [("00" * 16, 0, 0)]
    for bad in ([(1, [0.0] * 16, 1, "x", 1), (2, [0.0] * 32, 1, "x", 1)], [(1, [0.0] * 15, 1, "x", 1)]):
        with pytest.raises(ValueError):
            coded(spark, bad)


def test_cells_leave_only_entries_that_can_be_nearest():
    rng = np.random.default_rng(1)
    book = rng.integers(-300, 300, size=(64, 3))
    cells = op.Cells(book)
    points = rng.integers(-500, 500, size=(3000, 3))
    apart = ((points[:, None, :] - book) ** 2).sum(axis=2)
    codes, errors = cells.nearest(points)
    assert (codes == apart.argmin(axis=1)).all() and (errors == apart.min(axis=1)).all()
    assert 1 <= np.mean([len(e) for e in cells.kept.values()]) < 32
    again = {k: v.tolist() for k, v in cells.kept.items()}
    cells.nearest(points)
    assert {k: v.tolist() for k, v in cells.kept.items()} == again
