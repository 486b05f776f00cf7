"""Packing of token sequences by non-negative least squares.

Documents are cut into whole windows and a rest.  Over the histogram of the rests, combinations of two or three
lengths that fill a window exactly are enumerated; how often each is used is a non-negative least squares problem
against the histogram (projected gradient steps with momentum).  Rounded counts are taken as far as pieces last,
and what is left is packed greedily, the longest first.  The plan depends on the histogram alone, which has one
number for each length however many documents there are; each piece then finds its place from its length and its
rank among the pieces of that length.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickerlake import session
from tickerlake.llm import common
from tickerlake.llm.wordtokens import END, vocabulary_path, worker_chunks

WINDOW = 2048
#: For triples: how many of the most frequent lengths join each length; steps of the solver.
PARTNERS = 12
STEPS = 400
#: Pieces of one length that are ranked in one group.
RANKED = 500_000
SLICE_BYTES = 2_000_000
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def pieces(docs: DataFrame, window: int = WINDOW, vocabulary: str | None = None) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens) of every piece: whole windows from the start, and the rest.

    docs: doc_id, text (further columns are ignored); a null text is empty and has the end id alone.
    """
    vocabulary = vocabulary or vocabulary_path()

    def run(batches):
        chunks = worker_chunks(vocabulary)
        for batch in common.slices(batches, "text", SLICE_BYTES):
            rows = []
            for doc_id, ids in zip(batch.column(0).to_pylist(), chunks.ids(batch.column(1).to_pylist())):
                ids = np.append(ids, END).astype("<u4")
                rows += [(doc_id, a, len(part := ids[a : a + window]), zlib.crc32(part.tobytes()), len(ids)) for a in range(0, len(ids), window)]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return common.documents(docs).mapInArrow(run, PIECES)


def combinations(histogram: np.ndarray, window: int) -> np.ndarray:
    """(combination, 3) lengths, longest first and 0 for none, that fill a window: all pairs, and triples with a frequent length."""
    have = histogram > 0
    own = np.flatnonzero(have)
    found = [np.stack([own, window - own, np.zeros_like(own)], axis=1)]
    for often in own[np.argsort(-histogram[own], kind="stable")][:PARTNERS]:
        found.append(np.stack([own, np.full_like(own, often), window - own - often], axis=1))
    rows = np.concatenate(found)
    rows = rows[(rows >= 0).all(axis=1) & (rows[:, 1] > 0)]
    rows = -np.sort(-rows, axis=1)
    rows = rows[have[rows[:, 0]] & have[rows[:, 1]] & (have[rows[:, 2]] | (rows[:, 2] == 0))]
    return np.unique(rows, axis=0)


def solve(rows: np.ndarray, histogram: np.ndarray) -> np.ndarray:
    """x >= 0 that minimises the squared difference between what x combinations use and the histogram."""
    used = rows > 0

    def use(x):
        return np.bincount(rows.ravel(), weights=(x[:, None] * used).ravel(), minlength=len(histogram))

    def back(r):
        return (r[rows] * used).sum(axis=1)

    x = y = np.zeros(len(rows))
    v = np.ones(len(rows))
    for _ in range(30):  # largest eigenvalue, for the length of a step
        v = back(use(v))
        v /= max(np.linalg.norm(v), 1e-300)
    bound = 1.02 * np.linalg.norm(back(use(v))) if len(rows) else 1.0
    target, t = histogram.astype(float), 1.0
    for _ in range(STEPS):
        after = np.maximum(y - back(use(y) - target) / bound, 0)
        s = (1 + np.sqrt(1 + 4 * t * t)) / 2
        x, y, t = after, after + (t - 1) / s * (after - x), s
    return x


def plan(histogram: np.ndarray, window: int = WINDOW) -> list[tuple[int, list[int]]]:
    """(times, lengths) of all sequences; every piece of the histogram (counts by length) is used exactly once."""
    left = histogram.astype(np.int64).copy()
    out: list[tuple[int, list[int]]] = []
    if left[window]:
        out.append((int(left[window]), [window]))
        left[window] = 0
    rows = combinations(left, window)
    x = solve(rows, left) if len(rows) else np.empty(0)
    for rounded in (np.floor, np.ceil):
        for k in np.argsort(-x, kind="stable"):
            lengths = [int(n) for n in rows[k] if n]
            most = min(left[n] // lengths.count(n) for n in lengths)
            times = int(min(rounded(x[k]), most))
            if times > 0:
                out.append((times, lengths))
                for n in lengths:
                    left[n] -= times
                x[k] -= times
    while left.any():
        lengths, space = [], window
        taken = np.zeros_like(left)
        while space and len(fits := np.flatnonzero((left - taken)[: space + 1])):
            n = int(fits[-1])
            k = int(min(space // n, left[n] - taken[n]))
            lengths += [n] * k
            taken[n] += k
            space -= n * k
        own = taken > 0
        times = int((left[own] // taken[own]).min())
        out.append((times, lengths))
        left -= times * taken
    return out


def places(plans: list[tuple[int, list[int]]]) -> dict[str, np.ndarray]:
    """Runs of slots ordered by length: pieces of a length with ranks from ``low`` on go to sequence + rank - low at ``offset``."""
    runs, low, sequence = [], {}, 0
    for times, lengths in plans:
        offset = 0
        for n in lengths:
            runs.append((n, low.get(n, 0), sequence, offset))
            low[n] = low.get(n, 0) + times
            offset += n
        sequence += times
    table = np.array(sorted(runs), dtype=np.int64).reshape(-1, 4)
    return dict(zip(("length", "low", "sequence", "offset"), table.T))


def pack(cut: DataFrame, window: int = WINDOW) -> DataFrame:
    """Adds sequence_id and offset to pieces.

    cut: a written table with ``length`` from 1 to ``window`` and any other columns; it is read several times.
    """
    counts = np.zeros(window + 1, dtype=np.int64)
    for r in cut.groupBy("length").count().collect():  # one row a length
        counts[r["length"]] = r["count"]
    slots = places(plan(counts, window))
    names = cut.columns
    groups = max(1, -(-int(counts.max()) // RANKED))
    salted = cut.withColumn("_group", F.pmod(F.xxhash64(*names), F.lit(groups)).cast("int"))
    sizes = salted.groupBy("length", "_group").agg(F.count("*").alias("_n"))
    sizes = sizes.select("length", "_group", (F.sum("_n").over(Window.partitionBy("length").orderBy("_group")) - F.col("_n")).alias("_before"))
    ranked = salted.withColumn("_rank", F.row_number().over(Window.partitionBy("length", "_group").orderBy(*names)))
    ranked = ranked.join(sizes, ["length", "_group"]).select(*names, (F.col("_rank") - 1 + F.col("_before")).alias("_rank"))

    def run(batches):
        scale = int(counts.max()) + 1
        keys = slots["length"] * scale + slots["low"]
        for batch in batches:
            length, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("length", "_rank"))
            k = np.searchsorted(keys, length * scale + rank, side="right") - 1
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(names))), pa.array(slots["sequence"][k] + rank - slots["low"][k]), pa.array(slots["offset"][k])], [*names, "sequence_id", "offset"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cut.schema.fields)
    return ranked.mapInArrow(run, f"{kinds}, sequence_id long, offset long")


def packed(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """All documents in sequences of at most ``window`` tokens: the pieces with sequence_id and offset.

    Repeated rows are packed each on its own; an empty table gives an empty result.
    """
    return pack(session.stage(pieces(docs, window), "pieces"), window)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(common.table(spark, sf_dir, "documents"))
