"""op2, op4 and op10 against the libraries and plain loops."""

import hashlib
import random
import zlib

import numpy as np
import pytest
import samples

from tickerlake import session
from tickerlake.llm import common, distinct, ordered, wordtokens
from tickerlake.llm import op2_sentencepiece as sp
from tickerlake.llm import op4_bitplanes as bp
from tickerlake.llm import op10_packing as pk

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(samples.rows(), samples.SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def given(spark):
    return common.table(spark, SF, "documents")


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], samples.SCHEMA)


def texts(df):
    return [(r.doc_id, r.text or "") for r in df.select("doc_id", "text").collect()]


@pytest.fixture(scope="module")
def word_ids():
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(wordtokens.vocabulary_path())
    return lambda text: [*library.encode(text, add_special_tokens=False).ids, 1]


@pytest.mark.parametrize("which", ["odd", "given"])
def test_sentencepiece(request, which):
    import sentencepiece

    docs = request.getfixturevalue(which)
    library = sentencepiece.SentencePieceProcessor(model_file=wordtokens.vocabulary_path(sp.VOCABULARY))
    want = sorted((str(i), [*library.encode(t), 2]) for i, t in texts(docs))
    got = sp.decode(sp.encode(docs)).collect()
    assert sorted((str(r.doc_id), list(r.ids)) for r in got) == want
    assert sorted(r.text for r in got) == sorted(library.decode(ids) for _, ids in want)


def test_sentencepiece_query(spark):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=wordtokens.vocabulary_path(sp.VOCABULARY))
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = []
    for i, t in texts(common.table(spark, SF, "documents")):
        ids = [*library.encode(t), 2]
        want.append((i, len(ids), digest(" ".join(map(str, ids))), digest(library.decode(ids))))
    assert sorted(tuple(r) for r in sp.op2_sentencepiece(spark, SF).collect()) == sorted(want)


def in_order(docs):
    return sorted(texts(docs), key=lambda r: (r[0] is not None, r[0] or 0))


@pytest.mark.parametrize("bits", [1, 8])
@pytest.mark.parametrize("which", ["odd", "given"])
def test_bit_planes(spark, request, monkeypatch, word_ids, which, bits):
    docs = request.getfixturevalue(which)
    monkeypatch.setattr(ordered, "ROWS", 6)
    monkeypatch.setattr(bp, "BLOCK", 1000)
    path = session.work_dir(spark, "bp-test")
    bp.write_documents(docs, path, bits=bits)
    got = [tuple(r) for r in bp.summary(spark, path).orderBy("start").collect()]
    ids = sorted(((i, word_ids(t)) for i, t in texts(docs)), key=lambda r: (r[0] is not None, r[0] or 0, np.array(r[1], "<u4").tobytes()))
    want, start = [], 0
    for i, x in ids:
        want.append((i, start, len(x), zlib.crc32(np.array(x, "<u4").tobytes())))
        start += len(x)
    assert got == want
    whole = {}
    for r in bp.read_ids(spark, path).collect():
        whole.setdefault((r.shard, r.row), []).append((r.begin, list(r.ids)))
    assert sorted(sum((p for _, p in sorted(parts)), []) for parts in whole.values()) == sorted(x for _, x in ids)


def test_planes_alone():
    for ids in ([], [0], [0, 0], [1, 2**32 - 1], list(range(70_000))):
        for bits in (1, 8):
            assert bp.from_planes(bp.to_planes(np.array(ids, dtype=np.uint32), bits)).tolist() == ids
    with pytest.raises(ValueError):
        bp.from_planes(b"other data")
    rng = random.Random(1)
    for _ in range(20):
        a, b = rng.randbytes(rng.randrange(50)), rng.randbytes(rng.randrange(5000))
        assert bp.join_crc(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b)


def packing_is_whole(rows, docs, word_ids, window):
    ids = {}
    for i, t in texts(docs):
        ids.setdefault(i, []).append(word_ids(t))
    parts = {}
    sequences = {}
    for r in rows:
        assert 1 <= r.length <= window
        parts.setdefault(r.doc_id, []).append((r.start, r.length, r.ids_crc32, r.doc_tokens))
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    want = {i: sorted((a, len(x[a : a + window]), zlib.crc32(np.array(x[a : a + window], "<u4").tobytes()), len(x)) for x in own for a in range(0, len(x), window)) for i, own in ids.items()}
    assert {i: sorted(p) for i, p in parts.items()} == want
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= window
    assert sorted(sequences) == list(range(len(sequences)))
    return sum(r.length for r in rows) / (window * len(sequences))


@pytest.mark.parametrize("which", ["odd", "given"])
def test_packing(request, monkeypatch, word_ids, which):
    docs = request.getfixturevalue(which)
    monkeypatch.setattr(pk, "RANKED", 3)
    fill = packing_is_whole(pk.packed(docs).collect(), docs, word_ids, 2048)
    assert fill > 0.9 or which == "odd"


def test_plan_fills_and_uses_each_piece_once():
    rng = np.random.default_rng(2)
    for n, least in ((50, 0.6), (3000, 0.97), (200_000, 0.995)):
        histogram = np.bincount(np.clip(rng.lognormal(6, 0.8, n).astype(int), 1, 2048), minlength=2049)
        plans = pk.plan(histogram)
        used = np.zeros_like(histogram)
        for times, lengths in plans:
            assert sum(lengths) <= 2048 and times > 0
            np.add.at(used, lengths, times)
        assert (used == histogram).all()
        assert (histogram * np.arange(2049)).sum() / (2048 * sum(t for t, _ in plans)) > least
    assert pk.plan(np.zeros(2049, dtype=int)) == []


def test_solver_against_exact_cases():
    rows = np.array([[4, 2, 0], [3, 3, 0], [2, 2, 2]])
    histogram = np.array([0, 0, 7, 4, 1])
    assert np.allclose(pk.solve(rows, histogram), [1, 2, 2], atol=0.01)


def test_empty_tables(spark, empty):
    assert sp.decode(sp.encode(empty)).collect() == []
    path = session.work_dir(spark, "bp-test")
    bp.write_documents(empty, path)
    assert bp.summary(spark, path).collect() == []
    assert pk.packed(empty).collect() == []


def test_segments_and_words():
    found = distinct.segments([b"a b" * 10, b"", b"zz", b"x" * 300 + b" y " * 50], b" ", 100)
    joined = {}
    for owners, data in found:
        for i in owners:
            joined.setdefault(i, b"")
        if len(owners) == 1:
            joined[owners[0]] += data
    assert joined[3].split() == (b"x" * 300 + b" y " * 50).split()
    kept = []

    def learn(new, first):
        kept[first:] = new

    words = distinct.Words(b" ", learn, most=4)
    for data in (b"a b a c ", b"c  b d e f", b"", b"   ", b"zz a", b"e f a d", b"y"):
        codes, starts = words.codes(data)
        assert [kept[c] for c in codes] == data.split() and [data[s : s + 1] for s in starts] == [w[:1] for w in data.split()]


def test_words_share_an_entry_whatever_marks_follow(word_ids):
    """A word had an entry for each capital and each mark behind it."""
    chunks = wordtokens.Chunks(wordtokens.vocabulary_path())
    text = " ".join(w + m for w in ("tree", "Tree", "TREE") for m in ("", ",", ".", "!?"))
    assert [*chunks.ids([text])[0], 1] == word_ids(text) and len(chunks.words.code) == 4
    rng = random.Random(4)
    parts = [*"abAZzéÉßÿÀ×÷µªº'’.,!<|>#%&*()[]{}~`^_-=+09 \t\n\r\f\v\x1c\x85\xa0　̸́‍ΣσİıK日", "<|endoftext|>", "<|ENDOFTEXT|>", "'s", "'LL", "Foo,", "foo", "ÉTÉ.", "été", "a×", "a̸"]
    many = ["".join(rng.choice(parts) for _ in range(rng.randrange(60))) for _ in range(2000)]
    assert [[*x, 1] for x in chunks.ids(many)] == [word_ids(t) for t in many]
