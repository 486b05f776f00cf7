"""SentencePiece encoding and decoding through tables of distinct marked words.

No piece of the vocabulary has a space marker behind another character, so no merge crosses the place before a
marker: a text is segmented word by word, a word with the marker in front.  A worker segments each distinct word
once and joins the ids back by position.  Texts whose spaces are not single ones between words (or that hold the
marker itself) go to the library whole.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickerlake.llm import common
from tickerlake.llm.distinct import Words, segments
from tickerlake.llm.wordtokens import Pool, vocabulary_path

VOCABULARY = "piece_bpe_32k.model"
MARKER = "▁"
SLICE_BYTES = 2_000_000
SLICE_ROWS = 500


class Pieces:
    """The library with a worker's table of distinct words."""

    def __init__(self, path: str):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = (self.library.id_to_piece(i) for i in range(self.library.get_piece_size()))
        self.by_word = not any(MARKER in p.lstrip(MARKER) for p in pieces)
        self.end = self.library.eos_id()
        self.pool = Pool()
        self.words = Words(b" ", self.learn)

    def learn(self, words: list[bytes], first: int) -> None:
        self.pool.put(self.library.encode([w.decode() for w in words], num_threads=1), first)

    def regular(self, text: str) -> bool:
        return self.by_word and text != "" and text[0] != " " and text[-1] != " " and "  " not in text and MARKER not in text

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """int32 ids of every text, with the end id behind."""
        out: list[list[np.ndarray]] = [[] for _ in texts]
        plain = [t.encode() if self.regular(t) else b"" for t in texts]
        for owners, data in segments(plain, b" "):
            codes, starts = self.words.codes(data)
            ids, sizes = self.pool.take(codes)
            behind = np.cumsum([len(plain[i]) + 1 for i in owners]) if len(owners) > 1 else [len(data)]
            cuts = np.concatenate([[0], np.cumsum(sizes)])[np.searchsorted(starts, behind)]
            for i, a, b in zip(owners, [0, *cuts[:-1].tolist()], cuts.tolist()):
                out[i].append(ids[a:b])
        end = np.array([self.end], dtype=np.int32)
        return [np.concatenate([*found, end] if plain[i] else [np.array(self.library.encode(texts[i]), dtype=np.int32), end]) for i, found in enumerate(out)]


@functools.cache
def worker_pieces(path: str) -> Pieces:
    return Pieces(path)


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, ids array<int>) of every document: the library's ids of the whole text, and the end id.

    docs: doc_id, text (further columns are ignored).  A null text is empty and has the end id alone.  Repeated rows
    are repeated; an empty table gives an empty result.
    """
    path = path or vocabulary_path(VOCABULARY)

    def run(batches):
        pieces = worker_pieces(path)
        for batch in common.slices(batches, "text", SLICE_BYTES):
            found = pieces.encode(batch.column(1).to_pylist())
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(found)))], ["doc_id", "ids"])

    return common.documents(docs).mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, ids, text): the library's decode of whole id lists; null ids give a null text."""
    path = path or vocabulary_path(VOCABULARY)

    def run(batches):
        library = worker_pieces(path).library
        for batch in batches:
            for a in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(a, SLICE_ROWS)
                texts = [None if ids is None else library.decode(ids) for ids in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string())], ["doc_id", "ids", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids array<int>, text string")


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = decode(encode(common.table(spark, sf_dir, "documents")))
    return rows.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("text", 256).alias("decoded_sha256"),
    )
