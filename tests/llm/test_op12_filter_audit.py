import itertools
import random
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from tickerlake.llm import op12_filter_audit as op

DOCS = "doc_id long, text string, lang string, mask int, part string, n long, quality int"


def failing(text, repeated):
    words = [w for w in re.split("[\x20\x09-\x0d]+", text) if w]
    checks = (len(words) < 100, 100 * len(set(words)) < 80 * len(words), 100 * len(re.findall("[A-Z]", text)) > 10 * len(text), any(c in text for c in "#$%&*|"), repeated)
    return {f for f, bad in zip("ABCDE", checks) if bad}


def brute(rows, labels):
    """Every order applied to every document, one step after the other."""
    texts = [(i, t or "", lang or "") for i, t, lang, *_ in rows]
    docs = []
    for i, t, part in texts:
        repeated = i is not None and any(j is not None and j < i and u == t for j, u, _ in texts)
        own = [r for r in labels if r[0] == i and i is not None]
        docs.append((part, failing(t, repeated), any(r[1] == 1 for r in own), any(r[2] == 1 for r in own)))
    out, sums = [], {}
    for part in {d[0] for d in docs}:
        for order in itertools.permutations("ABCDE"):
            left = [d for d in docs if d[0] == part]
            for step, f in enumerate(order, 1):
                gone = [d for d in left if f in d[1]]
                left = [d for d in left if f not in d[1]]
                every = [d for d in docs if d[0] == part and f in d[1]]
                out.append(["".join(order), part, step, len(left), len(gone), len(every) - len(gone), sum(d[1] == {f} for d in every), sum(d[2] for d in gone), sum(d[3] for d in gone)])
                sums[part, f] = sums.get((part, f), 0) + len(gone)
    return sorted((*r, sums[r[1], r[0][r[2] - 1]]) for r in out)


def audited(spark, rows, labels):
    got = op.audit(spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int, lang string"))
    return sorted((r.filter_order, r.part, r.step, r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in got.collect())


def test_against_every_order(spark):
    rng = random.Random(3)
    texts = [None, "", "x", "A B", " \x1c\x85 é", "$", "word " * 40_000, "É" * 30 + "A" * 4, "E" * 3 + "é" * 30]
    for _ in range(40):
        words = [rng.choice(["the", "Word", "a#b", f"w{rng.random()}", f"W{rng.random()}"]) for _ in range(rng.choice([99, 100, 101, 150]))]
        texts += ["\n".join(words)] * rng.choice([1, 1, 3])
    texts += [" ".join(f"v{i}" for i in range(n)) + " the" * m for n, m in ((79, 21), (80, 20), (79, 20), (100, 0), (99, 0))]
    rows = [(rng.choice([i, i, 5, None]), t, rng.choice(["en", None, "", "de"]), 1, "x", 9, 1) for i, t in enumerate(texts)]
    rows += rows[10:13] * 2 + [(2000 + i, "same", "fr", 1, "x", 9, 1) for i in range(50)]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None]), "x") for i in range(0, 2050, 2)] + [(5, 1, 0, "x"), (5, 0, 1, "x"), (None, 1, 1, "x")]
    assert audited(spark, rows, labels) == brute(rows, labels)


def test_empty(spark):
    assert audited(spark, [], []) == []
    got = audited(spark, [(1, "x", "en", 1, "x", 9, 1)], [])
    assert len(got) == 600 and {r[-1] for r in got} == {0, 120}


@settings(max_examples=50, deadline=None)
@given(st.dictionaries(st.integers(0, 15), st.integers(0, 1000)))
def test_potential_gives_what_orders_give(counts):
    worth = op.worths(counts, 4)
    share = [0] * 4
    for order in itertools.permutations(range(4)):
        before = 0
        for f in order:
            share[f] += worth[before | 1 << f] - worth[before]
            before |= 1 << f
    assert op.shapley(worth, 4) == share and sum(share) == 24 * worth[15]
