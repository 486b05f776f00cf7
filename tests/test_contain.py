"""Containment by equal pieces, against comparing all pairs."""

import random

from pyspark.sql import functions as F

from tickerlake.operators import contain


def pairs(spark, texts, needles):
    left = spark.createDataFrame([(t, i) for i, t in enumerate(texts)], "_piece string, n int")
    right = spark.createDataFrame([(s, i) for i, s in enumerate(needles)], "needle string, i int")
    found = contain.containing(left, "_piece", right, "needle")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    return sorted((r[0], r.needle, r.i) for r in found.collect())


def test_like_all_pairs(spark):
    rng = random.Random(2)
    make = lambda n: "".join(rng.choice("abé") for _ in range(n))
    texts = [make(rng.choice([0, 3, 7, 8, 9, 30])) for _ in range(80)] + ["same prefix for all " + make(12) for _ in range(80)] + [None, "", "twice twice twice", "twice twice twice"]
    needles = [make(rng.choice([1, 2, 7, 8, 9, 12])) for _ in range(40)] + [t[5:25] for t in texts[80:100]] + ["same pre", "same prefix for all ", None, "", "wice twic", "same prefix for all x", "same prefix for all x"]
    want = sorted((t, s, i) for t in {t for t in texts if t is not None} for i, s in enumerate(needles) if s and s in t)
    assert pairs(spark, texts, needles) == want and len(want) > 300


def test_empty(spark):
    assert pairs(spark, [], ["abc"]) == pairs(spark, ["abc"], []) == []


def test_few_pieces_of_long_needles(spark):
    rng = random.Random(5)
    make = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    needles = [make(32) for _ in range(30)] + ["a" * 20]
    texts = [f"px:{rng.choice(needles)}:{make(10)}" for _ in range(60)] + [needles[0], needles[0][1:], "a" * 19, "b" + "a" * 25, needles[1] + needles[2], make(70)]
    want = sorted((t, s, i) for t in set(texts) for i, s in enumerate(needles) if s in t)
    assert pairs(spark, texts, needles) == want and len(want) > 40
    kept = spark.createDataFrame([(make(46),) for _ in range(100)], "t string").select(F.size(contain.pieces(F.col("t"), [], 25)).alias("n"))
    assert kept.agg(F.avg("n")).head()[0] < 8  # of 39 stretches
