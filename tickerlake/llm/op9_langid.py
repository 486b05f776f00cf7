"""Language identification by segmentation-marginalised unigrams.

The vocabulary is that of a public tokenizer.  Each language has a probability for every piece; a word's
probability in a language is the sum over all its segmentations into pieces (forward algorithm), and a text's is
the product over its words.  Piece probabilities are fitted by expectation maximisation over the word counts of a
bounded sample of labelled documents; each round is a Spark job that returns one number for a piece and language.
Words are scored once for each worker and looked up from then on.
"""

from __future__ import annotations

import functools
import re
import sys
import uuid
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickerlake import session
from tickerlake.llm import common
from tickerlake.llm.distinct import Words, segments
from tickerlake.llm.wordtokens import vocabulary_path

VOCABULARY = "piece_bpe_32k.model"
MARKER = "▁"
#: Labelled documents that are learned from, for each language at most (about: chosen by a hash of doc_id); rounds;
#: pseudo-count of a piece; probability of a character that is no piece.
PER_LANGUAGE = 2000
ROUNDS = 4
PSEUDO = 0.02
UNKNOWN = 1e-7
#: Letters that are segmented together; longer runs are cut into such parts.
LONGEST = 31
#: Posterior below which a prediction is not believed.
LEAST_SCORE = 0.5
FOLDS, HELD_OUT = 3, 1
UNDETERMINED = "und"
#: All ASCII bytes but letters part words.
BLANKS = b" " + bytes(b for b in range(128) if b != 32 and not chr(b).isalpha())
#: Runs of characters that are letters (str.isalpha); \w also admits numerals that are no digits, such as "²" and "½".
NUMERALS = "".join(c for c in map(chr, range(sys.maxunicode + 1)) if c.isnumeric() and not c.isalpha() and not c.isdecimal())
LETTERS = re.compile(rf"[^\W\d_{NUMERALS}]+")
SLICE_BYTES = 2_000_000


@functools.cache
def vocabulary(path: str) -> tuple[dict[str, int], int]:
    """Pieces without control and byte pieces by number, and the length of the longest."""
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=path)
    own = [library.id_to_piece(i) for i in range(library.get_piece_size()) if not (library.is_control(i) or library.is_byte(i) or library.is_unknown(i))]
    kept = sorted({p for p in own if LETTERS.fullmatch(p.removeprefix(MARKER)) or p == MARKER})
    return {p: i for i, p in enumerate(kept)}, max(map(len, kept))


def marked_words(chunk: str) -> list[str]:
    """The chunk's runs of letters in lower case, cut to LONGEST, with the word marker in front."""
    return [MARKER + run[a : a + LONGEST] for run in LETTERS.findall(chunk.lower()) for a in range(0, len(run), LONGEST)]


STEP, SPREAD = common.U64(0x9E3779B97F4A7C15), common.U64(0xD6E8FEB86659FD93)
SLOT_BITS = 20
#: Words are scored in groups of lengths up to these (with the marker), and as many at once as keep a table below CELLS.
LENGTHS = (6, 9, 12, 16, 22, LONGEST + 1)
CELLS = 4_000_000


def points(words: list[str], size: int) -> np.ndarray:
    """(word, place) code points, 0 behind the end."""
    return np.array(words, dtype=f"<U{size}").view(np.uint32).reshape(len(words), size).astype(np.uint64)


def slot(h: np.ndarray) -> np.ndarray:
    return ((h ^ (h >> common.U64(29))) * SPREAD >> common.U64(64 - SLOT_BITS)).astype(np.int64)


@functools.cache
def piece_table(path: str) -> tuple[np.ndarray, np.ndarray, int]:
    """Open hash table of the pieces: (hash, number) by slot, and how many slots a look-up may take."""
    pieces, longest = vocabulary(path)
    codes = points(list(pieces), longest)
    with np.errstate(over="ignore"):
        h = np.zeros(len(pieces), dtype=np.uint64)
        for k in range(longest):
            h = np.where(codes[:, k] > 0, (h + codes[:, k]) * STEP, h)
        home = slot(h)
    keys, numbers, most = np.zeros(1 << SLOT_BITS, np.uint64), np.zeros(1 << SLOT_BITS, np.int32), 1
    for key, at, n in zip(h.tolist(), home.tolist(), range(len(h))):
        tries = 1
        while keys[at]:
            at, tries = (at + 1) % (1 << SLOT_BITS), tries + 1
        keys[at], numbers[at], most = key, n, max(most, tries)
    return keys, numbers, most


def lattice(words: list[str], size: int, path: str) -> np.ndarray:
    """(word, start, length - 1): numbers of the pieces of words of at most ``size`` characters; behind the last piece:
    0 unknown character, 1 no piece."""
    pieces, longest = vocabulary(path)
    keys, numbers, most = piece_table(path)
    none, longest = len(pieces) + 1, min(longest, size)
    codes = points(words, size)
    out = np.full((len(words), size, longest), none, dtype=np.int32)
    with np.errstate(over="ignore"):
        h = np.zeros_like(codes)
        for m in range(1, longest + 1):
            last = codes[:, m - 1 :]
            h = (h[:, : size - m + 1] + last) * STEP
            at = slot(h)
            found = np.where((keys[at] == h) & (last > 0), numbers[at], none)
            for k in range(1, most):
                later = (at + k) % (1 << SLOT_BITS)
                found = np.where((keys[later] == h) & (last > 0), numbers[later], found)
            out[:, : size - m + 1, m - 1] = found
    single = out[:, :, 0]
    single[(single == none) & (codes > 0)] = none - 1
    return out


def by_length(words: list[str]) -> list[tuple[int, np.ndarray]]:
    """(largest size, places of words) of groups of similar lengths, small enough to be scored at once."""
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    out = []
    for low, high in zip((0, *LENGTHS), LENGTHS):
        own = np.flatnonzero((sizes > low) & (sizes <= high))
        step = max(1, CELLS // (high * high))
        out += [(high, own[a : a + step]) for a in range(0, len(own), step)]
    return out


def forward(ids: np.ndarray, chance: np.ndarray) -> np.ndarray:
    """(place, word, language): probability of the first characters over all segmentations."""
    n, size, longest = ids.shape
    out = np.zeros((size + 1, n, chance.shape[1]))
    out[0] = 1.0
    for j in range(1, size + 1):
        for m in range(1, min(longest, j) + 1):
            out[j] += out[j - m] * chance[ids[:, j - m, m - 1]]
    return out


def log_chances(words: list[str], chance: np.ndarray, path: str) -> np.ndarray:
    """(word, language) logarithms of the marginal probabilities."""
    out = np.zeros((len(words), chance.shape[1]))
    for size, part in by_length(words):
        own = [words[i] for i in part]
        out[part] = np.log(forward(lattice(own, size, path), chance)[[len(w) for w in own], np.arange(len(own))])
    return out


def expected(words: list[str], counts: np.ndarray, chance: np.ndarray, path: str) -> np.ndarray:
    """Expected uses of every piece under one language's probabilities."""
    out = np.zeros(len(chance))
    for high, part in by_length(words):
        own = [words[i] for i in part]
        ids = lattice(own, high, path)
        n, size, longest = ids.shape
        ahead = forward(ids, chance)[:, :, 0]
        ends, each = np.array([len(w) for w in own]), np.arange(n)
        behind = np.zeros((size + 1, n))
        behind[ends, each] = counts[part] / ahead[ends, each]
        for i in range(size - 1, -1, -1):
            for m in range(1, min(longest, size - i) + 1):
                behind[i] += behind[i + m] * chance[ids[:, i, m - 1], 0]
        for i in range(size):
            for m in range(1, min(longest, size - i) + 1):
                k = ids[:, i, m - 1]
                out += np.bincount(k, weights=ahead[i] * chance[k, 0] * behind[i + m], minlength=len(out))
    return out


class Model:
    """Languages in order and the chance of every piece in each."""

    def __init__(self, languages: list[str], chance: np.ndarray, path: str):
        self.languages, self.chance, self.path, self.name = languages, chance, path, uuid.uuid4().hex


def train(spark: SparkSession, labelled: DataFrame, path: str | None = None, per_language: int = PER_LANGUAGE) -> Model:
    """Fits a model to (doc_id, text, lang); rows with a null text or language tell nothing.

    About per_language documents of each language are learned from, chosen by a hash of doc_id.
    """
    path = path or vocabulary_path(VOCABULARY)
    labelled = labelled.select("doc_id", "text", "lang").where("text is not null and lang is not null")
    sizes = sorted((r.lang, r["count"]) for r in labelled.groupBy("lang").count().collect())  # one row a language
    if not sizes:
        return Model([], np.empty((0, 0)), path)
    spread = F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(1_000_000))
    share = F.coalesce(*(F.when(F.col("lang") == lang, F.lit(per_language / n * 1_000_000)) for lang, n in sizes))

    def count(batches):
        for batch in batches:
            found: dict[str, Counter] = {}
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found.setdefault(lang, Counter()).update(marked_words(text))
            rows = [(lang, w, n) for lang, words in found.items() for w, n in words.items()]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], ["lang", "word", "n"])

    counted = labelled.where(spread < share).select("text", "lang").mapInArrow(count, "lang string, word string, n long")
    counted = session.stage(counted.groupBy("lang", "word").agg(F.sum("n").alias("n")), "words")
    languages = [lang for lang, _ in sizes]
    number = {lang: i for i, lang in enumerate(languages)}
    pieces = len(vocabulary(path)[0])

    def closed(chance: np.ndarray) -> np.ndarray:
        return np.vstack([chance, np.full((1, len(languages)), UNKNOWN), np.zeros((1, len(languages)))])

    chance = closed(np.full((pieces, len(languages)), 1.0 / pieces))
    for _ in range(ROUNDS):
        shared = spark.sparkContext.broadcast(chance)

        def round_of(batches, shared=shared):
            for batch in batches:
                names, words, counts = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_numpy().astype(float)
                for lang in sorted(set(names)):
                    own = [i for i, x in enumerate(names) if x == lang]
                    k = number[lang]
                    uses = expected([words[i] for i in own], counts[own], shared.value[:, [k]], path)[:pieces]
                    seen = np.flatnonzero(uses)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(seen), k, np.int32)), pa.array(seen.astype(np.int32)), pa.array(uses[seen])], ["k", "piece", "uses"])

        uses = np.full((pieces, len(languages)), PSEUDO)
        for r in counted.mapInArrow(round_of, "k int, piece int, uses double").groupBy("k", "piece").agg(F.sum("uses").alias("uses")).toLocalIterator():
            uses[r.piece, r.k] += r.uses
        chance = closed(uses / uses.sum(axis=0))
    return Model(languages, chance, path)


class Scorer:
    """A worker's table of scored chunks under one model."""

    def __init__(self, model: Model):
        self.model = model
        self.words = Words(BLANKS, self.learn)
        self.score = np.empty((1 << 16, len(self.model.languages)))
        self.letters = np.empty(1 << 16, dtype=np.int64)

    def learn(self, chunks: list[bytes], first: int) -> None:
        found = [[MARKER + t] if len(t) <= LONGEST and t.isascii() else marked_words(t) for t in b" ".join(chunks).decode().split(" ")]
        flat = [w for words in found for w in words]
        own = np.repeat(np.arange(len(found)), [len(w) for w in found])
        behind = first + len(chunks)
        while behind > len(self.score):
            self.score, self.letters = np.vstack([self.score, np.empty_like(self.score)]), np.concatenate([self.letters, np.empty_like(self.letters)])
        logs = log_chances(flat, self.model.chance, self.model.path)
        for k in range(logs.shape[1]):
            self.score[first:behind, k] = np.bincount(own, weights=logs[:, k], minlength=len(found))
        self.letters[first:behind] = np.bincount(own, weights=[len(w) - 1 for w in flat], minlength=len(found))

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        n, languages = len(texts), self.model.languages
        total, letters = np.zeros((n, len(languages))), np.zeros(n, dtype=np.int64)
        plain = [(t or "").encode().lower() for t in texts]  # bytes: ASCII letters alone, the rest when a word is learned
        for owners, data in segments(plain, BLANKS) if languages else []:
            codes, starts = self.words.codes(data)
            behind = np.cumsum([len(plain[i]) + 1 for i in owners]) if len(owners) > 1 else np.array([len(data)])
            own = np.array(owners)[np.searchsorted(behind, starts, side="right")]
            letters += np.bincount(own, weights=self.letters[codes], minlength=n).astype(np.int64)
            for k in range(len(languages)):
                total[:, k] += np.bincount(own, weights=self.score[codes, k], minlength=n)
        if not languages:
            return [UNDETERMINED] * n, np.zeros(n)
        best = total.argmax(axis=1)
        score = 1.0 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
        return [languages[b] if k else UNDETERMINED for b, k in zip(best, letters)], np.where(letters > 0, score, 0.0)


_scorers: dict[str, Scorer] = {}


def worker_scorer(model: Model) -> Scorer:
    """The worker's table for this model; that of an earlier model is given up."""
    if model.name not in _scorers:
        _scorers.clear()
        _scorers[model.name] = Scorer(model)
    return _scorers[model.name]


def predict(spark: SparkSession, docs: DataFrame, model: Model) -> DataFrame:
    """All columns of docs with lang_pred and score (0 to 1, the posterior under equal priors).

    Only ``text`` is looked at.  ``und`` with score 0 for a null text, one without a letter, or a model without
    languages; ties go to the first language in order.  docs has no column of these two names.
    """
    shared = spark.sparkContext.broadcast(model)
    names = docs.columns
    at = names.index("text")

    def run(batches):
        for batch in common.slices(batches, "text", SLICE_BYTES):
            lang, score = worker_scorer(shared.value).predict(batch.column(at).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lang, pa.string()), pa.array(score)], [*names, "lang_pred", "score"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(run, f"{kinds}, lang_pred string, score double")


def held_out(doc_id) -> F.col:
    return F.coalesce(F.crc32(doc_id.cast("string")) % FOLDS == HELD_OUT, F.lit(False))


def identify(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every document, learned from those that are not held out.

    docs: doc_id, text, lang (further columns are ignored).  A row without a doc_id is not held out.  Repeated rows
    are repeated; an empty table gives an empty result.
    """
    rows = docs.select("doc_id", "text", "lang").withColumn("held_out", held_out(F.col("doc_id")))
    model = train(spark, rows.where("not held_out"))
    return predict(spark, rows.select("doc_id", "text", "held_out"), model).select("doc_id", "held_out", "lang_pred", "score")


def op9_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(spark, common.table(spark, sf_dir, "documents"))


def keep_believed(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Documents whose language is told with a score of LEAST_SCORE or more, all columns as they were."""
    model = train(spark, docs.where(~held_out(F.col("doc_id"))))
    return predict(spark, docs, model).where((F.col("lang_pred") != UNDETERMINED) & (F.col("score") >= LEAST_SCORE)).select(*docs.columns)
