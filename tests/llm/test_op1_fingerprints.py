import hashlib
import random
import time

import numpy as np
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from tickerlake import session
from tickerlake.llm import op1_fingerprints as op
from tickerlake.llm import ordered

SCHEMA = "doc_id long, text string, fingerprint int, block string"


def brute(rows):
    """Every document beside the next one, from the texts alone."""
    rows = sorted(((i, t or "") for i, t, *_ in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    out = []
    for (i, text), (_, after) in zip(rows, rows[1:] + rows[:1]):
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        a, e, b = op.embed_bits([text]), op.embed_bits([edited]), op.embed_bits([after])
        out.append((i, len(text), hashlib.sha256(edited.encode()).hexdigest(), op.as_hex(a)[0], op.as_hex(e)[0], float(op.likeness(a, e)[0]), float(op.likeness(a, b)[0])))
    return out


def key(r):
    return tuple((x is not None, x) if x is not None else (False, 0) for x in r)


def check(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = [tuple(r) for r in op.with_next(df).collect()]
    assert sorted(got, key=key) == sorted(brute(rows), key=key)


def words(rng, n):
    return "".join(rng.choice(["un ", "été ", "tree ", "ß", "\n", "日本 "]) for _ in range(n))


def test_against_brute_force(spark, monkeypatch):
    rng = random.Random(3)
    monkeypatch.setattr(ordered, "ROWS", 7)
    rows = [(i * 3, words(rng, rng.randrange(0, 300)), 1, "x") for i in range(60)]
    rows += [(400, words(rng, 9000), 1, "x"), (401, None, 1, "x"), (402, "", 1, "x"), (403, "a", 1, "x"), (403, "b", 1, "x"), (404, "same", 1, "x"), (404, "same", 1, "x")]
    check(spark, rows)
    check(spark, [*rows, (None, "lost id", 1, "x"), (None, "", 1, "x")])


def test_small_tables(spark):
    assert op.with_next(spark.createDataFrame([], SCHEMA)).collect() == []
    check(spark, [(5, "only one", 1, "x")])
    check(spark, [(None, "only one", 1, "x")])


def test_edits_keep_likeness():
    rng = random.Random(5)
    texts = [words(rng, 700) for _ in range(40)]
    near = []
    for t in texts:
        chars = list(t)
        for _ in range(3):
            chars.insert(rng.randrange(len(chars)), "q")
            chars.pop(rng.randrange(len(chars)))
        near.append("".join(chars))
    a, b = op.embed_bits(texts), op.embed_bits(near)
    assert np.median(op.likeness(a, b)) > 0.9
    assert np.median(op.likeness(a, a[::-1])) < 0.4
    assert (op.embed_bits(texts) == a).all()


def test_row_type(spark):
    df = op.with_next(spark.createDataFrame([Row(doc_id=1, text="x")]))
    assert dict(df.dtypes)["n_chars"] == "bigint" and dict(df.dtypes)["near_next"] == "double"


@pytest.mark.parametrize("large,part", [(64, 512), (2, 3)])
def test_near_duplicates(spark, monkeypatch, large, part):
    monkeypatch.setattr(op, "LARGE", large)
    monkeypatch.setattr(op, "PART", part)
    rng = random.Random(8)
    rows, group = [], {}
    for g in range(12):
        text = words(rng, 600)
        for k in range(rng.choice([1, 2, 9])):
            chars = list(text)
            for _ in range(k % 3):
                chars[rng.randrange(len(chars))] = "q"
            group[g * 100 + k] = g
            rows.append((g * 100 + k, "".join(chars), 1, "x"))
    rows += [(5000, None, 1, "x"), (5001, "", 1, "x"), (0, rows[0][1], 1, "x")]
    group |= {5000: 50, 5001: 50}
    got = op.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    least = {g: min(i for i, x in group.items() if x == g) for g in group.values()}
    assert len(got) == len(rows)
    for r in got:
        assert r.class_id == least[group[r.doc_id]]
        assert r.fingerprint == op.as_hex(op.embed_bits([next(t or "" for i, t, *_ in rows if i == r.doc_id)]))[0]
    assert op.near_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []


def test_query_carries_classes(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = op.op1_fingerprints(spark, sf)
    assert sorted((tuple(r) for r in got.drop("class_id", "class_size").collect()), key=key) == sorted((tuple(r) for r in op.with_next(docs).collect()), key=key)
    rows = got.select("doc_id", "fingerprint", "class_id", "class_size").collect()
    bits = np.array([np.unpackbits(np.frombuffer(bytes.fromhex(r.fingerprint), np.uint8)) for r in rows])
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in np.flatnonzero(op.likeness(bits, bits[i]) >= op.THRESHOLD):
            was, now = label[j], label[i]
            label = [now if x == was else x for x in label]
    want = {x: min(r.doc_id for r, y in zip(rows, label) if x == y) for x in label}
    assert [(r.class_id, r.class_size) for r in rows] == [(want[x], label.count(x)) for x in label]
    assert any(r.class_size > 1 for r in rows)


def test_bands_meet_pairs_at_the_threshold():
    rng = np.random.default_rng(2)
    a = rng.integers(0, 2, (4000, op.BITS))
    b = a.copy()
    for row in b:
        row[rng.choice(op.BITS, op.most_apart(op.THRESHOLD), replace=False)] ^= 1
    assert (op.band_keys(a) == op.band_keys(b)).any(axis=1).mean() > 0.99


def test_large_bucket_of_near_copies_and_others(spark):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2, op.BITS)
    rows, bits = [], []
    for i in range(300):
        x = base.copy()
        x[rng.choice(op.BITS, 10 if i < 200 else 60, replace=False)] ^= 1  # of these, the last hundred are not all near the leader
        bits.append(x)
        packed = np.packbits(x)
        rows.append((i, packed.view(">i8").astype(np.int64).tolist(), [7]))
    links = {tuple(sorted((r.a, r.b))) for r in op.near_links(spark.createDataFrame(rows, "node long, bits array<long>, bands array<int>")).collect()}
    bits = np.array(bits)
    most = op.most_apart(op.THRESHOLD)
    assert all((bits[i] != bits[j]).sum() <= most for i, j in links)

    def parts(edges):
        root = list(range(300))
        for i, j in edges:
            root = [root[i] if x == root[j] else x for x in root]
        return {frozenset(k for k in range(300) if root[k] == x) for x in root}

    assert parts(links) == parts((i, j) for i in range(300) for j in range(i) if (bits[i] != bits[j]).sum() <= most)


def bucket_rows(spark, rng, near, unlike):
    """A bucket of ``near`` near copies of one fingerprint and ``unlike`` ones that share nothing but the band."""
    base = rng.integers(0, 2, op.BITS)
    bits = [base.copy() for _ in range(near)] + list(rng.integers(0, 2, (unlike, op.BITS)))
    for x in bits[:near]:
        x[rng.choice(op.BITS, 20, replace=False)] ^= 1
    rows = [(int(i), np.packbits(x).view(">i8").astype(np.int64).tolist(), [7]) for i, x in zip(rng.permutation(len(bits)), bits)]
    return rows, spark.createDataFrame(rows, "node long, bits array<long>, bands array<int>")


@pytest.mark.parametrize("many,once", [(1024, 1 << 21), (1024, 100), (50, 1 << 21)])
def test_members_that_share_a_band_by_chance_are_left_out(spark, monkeypatch, many, once):
    monkeypatch.setattr(op, "MANY", many)
    monkeypatch.setattr(op, "AT_ONCE", once)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    try:
        rows, distinct = bucket_rows(spark, np.random.default_rng(4), 30, 200)
        near = {n for n, *_ in rows[:30]}
        found = op.met(distinct.select(F.lit(1).cast("long").alias("bucket"), "node", F.get("bits", F.lit(0)).alias("one"), F.get("bits", F.lit(3)).alias("other")).unionByName(
            spark.createDataFrame([(0, 1, 5, 0), (2, 1, 5, 7), (2, 2, 4, 7), (3, 9, 0, 0), (3, 8, -1, -1)], "bucket long, node long, one long, other long")), op.most_apart(op.THRESHOLD)).collect()
        one = [r for r in found if r.bucket == 1]
        assert near <= {r.node for r in one} and len({r.node for r in one}) == len(one)
        assert {(r.bucket, r.leader, r.n, r.node) for r in found if r.bucket != 1} == {(2, 1, 2, 1), (2, 1, 2, 2)}
        if many == 50:
            assert {(r.leader, r.n) for r in one} == {(0, 51)} and len(one) == 230
        else:
            assert len(one) < 40
            assert all(r.leader == min(x.node for x in one if x.leader == r.leader) and r.n == sum(x.leader == r.leader for x in one) for r in one)
        linked = {x for r in op.near_links(distinct).collect() for x in r}
        assert linked == near
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_two_words_hide_no_link():
    rng = np.random.default_rng(5)
    most = op.most_apart(op.THRESHOLD)
    assert max((rng.permutation(op.BITS)[:most] < 128).sum() for _ in range(20_000)) <= op.most_in_words(most) < 36
    assert op.most_in_words(0) == 0 and op.most_in_words(op.BITS) == 128


def test_shuffle_files_go_with_a_written_stage(spark):
    """They stayed until the JVM happened to collect its garbage, and a run of the check tool ended for it."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    files = lambda: {str(b) for b in map(lambda i: root.getAllFiles().apply(i).getName(), range(root.getAllFiles().size())) if str(b).startswith("shuffle_")}
    before = files()
    rows = session.stage(spark.range(1000).repartition(3, "id"), "shuffled")
    for _ in range(50):
        if files() <= before:
            break
        time.sleep(0.1)
    assert files() <= before and rows.count() == 1000
    assert spark.conf.get(session.CLEANUP) == "false"


def test_groups_list_no_pairs(spark):
    """Sixty near copies in each of 48 bands: every pair was listed in each band."""
    rng = np.random.default_rng(6)
    words = np.packbits(np.tile(rng.integers(0, 2, op.BITS), (60, 1)) ^ (rng.random((60, op.BITS)) < 0.01), axis=1).view(">i8").astype(np.int64)
    chain = np.zeros((4, op.WORDS64), dtype=np.int64)
    for i in range(4):
        chain[i, :i] = 2**40 - 1  # neighbours are 40 bits apart, others more than a link allows
    order = [2, 0, 3, 1]
    rows = [(k, 0, i, w.tolist()) for k in range(48) for i, w in enumerate(words)]
    rows += [(99, 100, 100 + i, chain[c].tolist()) for i, c in enumerate(order)] + [(99, 200, 200 + i, chain[c].tolist()) for i, c in enumerate((0, 3))]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "41")
    try:
        got = [tuple(r) for r in op.linked(spark.createDataFrame(rows, "bucket long, leader long, node long, bits array<long>").repartition(3), op.most_apart(op.THRESHOLD)).collect()]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len([x for x in got if x[1] < 100]) == 48 * 59 and {x[1] for x in got if x[0] == 0} == set(range(1, 60))
    chained = [x for x in got if x[0] >= 100]
    assert len(chained) == 3 and {x for link in chained for x in link} == {100, 101, 102, 103}


def test_links_of_many_bands_fall_together(spark):
    """A group's links from 48 bands with other leaders each were all joined with labels in every round."""
    rng = np.random.default_rng(7)
    pairs = {(int(min(g)), int(i)) for _ in range(48) for g in np.array_split(rng.permutation(400), 50) for i in g if i != min(g)}
    pairs |= {(1000 + i, 1001 + i) for i in range(30)} | {(2000, 2000 + i) for i in range(1, 30)} | {(3000 + i, 3100) for i in range(30)}
    frame = spark.createDataFrame([*pairs, *[(b, a) for a, b in pairs], (7, 7)], "a long, b long")
    kept = [tuple(r) for r in op.thinned(frame).collect()]
    nodes = {x for p in pairs for x in p}
    assert len(pairs) > 8 * len(nodes) and len(kept) == len(set(kept)) < 1.1 * len(nodes) and all(a < b for a, b in kept)

    def parts(edges):
        label = {x: x for x in nodes}
        while True:
            was = dict(label)
            for a, b in edges:
                label[a] = label[b] = min(label[a], label[b])
            if was == label:
                return label

    assert parts(kept) == parts(pairs)
    assert op.thinned(frame.limit(0)).collect() == []
