import itertools
import zlib

import numpy as np
import pytest
import samples

from tickerlake.llm import op9_langid as op
from tickerlake.llm.wordtokens import vocabulary_path

SF = "/root/testdata/sf0.001"
PATH = vocabulary_path(op.VOCABULARY)


def every_segmentation(word):
    for cuts in itertools.product([False, True], repeat=len(word) - 1):
        at = [0, *(i + 1 for i, c in enumerate(cuts) if c), len(word)]
        yield [word[a:b] for a, b in itertools.pairwise(at)]


def test_forward_sums_all_segmentations_and_expected_counts_follow():
    pieces, _ = op.vocabulary(PATH)
    rng = np.random.default_rng(1)
    chance = np.vstack([rng.random((len(pieces), 2)) / len(pieces), np.full((1, 2), op.UNKNOWN), np.zeros((1, 2))])
    words = ["▁the", "▁schön", "▁x日y", "▁a", "▁ation"]
    number = lambda p: pieces.get(p, len(pieces) if len(p) == 1 else len(pieces) + 1)
    logs = op.log_chances(words, chance, PATH)
    counts = np.array([1.0, 2, 3, 4, 5])
    want = np.zeros(len(chance))
    for w, word in enumerate(words):
        segmentations = [[number(p) for p in s] for s in every_segmentation(word)]
        for k in (0, 1):
            assert np.isclose(np.exp(logs[w, k]), sum(np.prod(chance[s, k]) for s in segmentations))
        total = sum(np.prod(chance[s, 0]) for s in segmentations)
        for s in segmentations:
            np.add.at(want, s, counts[w] * np.prod(chance[s, 0]) / total)
    assert np.allclose(op.expected(words, counts, chance[:, [0]], PATH), want)


def test_held_out_accuracy(spark):
    rows = op.op9_langid(spark, SF).collect()
    docs = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").collect()}
    assert len(rows) == len(docs)
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1
    out = [r for r in rows if r.held_out]
    assert sum(docs[r.doc_id].lang == r.lang_pred for r in out) / len(out) > 0.97


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en" if i % 2 else None, "x") for i, (_, t, *_) in enumerate(samples.rows())]
    rows += [(100 + i, "the quick brown fox and the lazy dog " * 5, "en", "x") for i in range(9)] + [(200 + i, "der schnelle braune Fuchs und der faule Hund " * 5, "de", "x") for i in range(9)]
    return spark.createDataFrame([*rows, (None, "und der Hund", "de", "x"), (7, "12 34 !?", "de", "x")], "doc_id long, text string, lang string, score string")


def test_odd_texts(spark, docs):
    got = op.identify(spark, docs)
    assert got.columns == ["doc_id", "held_out", "lang_pred", "score"] and got.count() == docs.count()
    by = {(r.doc_id, r.lang_pred) for r in got.collect()}
    assert {(None, "de"), (7, "und"), (100, "en"), (208, "de"), (0, "und"), (1, "und")} <= by


def test_nothing_learned(spark, docs):
    assert op.identify(spark, docs.limit(0)).collect() == []
    blank = docs.selectExpr("doc_id", "text", "cast(null as string) lang")
    assert {(r.lang_pred, r.score) for r in op.identify(spark, blank).collect()} == {("und", 0.0)}


def test_keep_believed(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    more = docs.limit(1).selectExpr("-1L doc_id", "'12 34' text", "lang", "source", "n_chars")
    kept = op.keep_believed(spark, docs.unionByName(more))
    assert kept.columns == docs.columns and kept.count() == docs.count() and kept.where("doc_id = -1").count() == 0


def test_numerals_are_no_letters():
    assert all(op.LETTERS.findall(c) == [] for c in "²½①Ⅷ٣12_ \n.")
    assert op.LETTERS.findall("x²y é½ 日本①語") == ["x", "y", "é", "日本", "語"]
    assert all(bool(op.LETTERS.fullmatch(c)) == c.isalpha() for c in map(chr, range(0x3000)))
