"""Codes for vectors: parts replaced by the number of their codebook's nearest entry, found by memoised grid cells.

Components become whole numbers, and each of PARTS parts of a vector has a codebook of ENTRIES entries.  The
space of a part is cut into boxes.  A box's entries are judged once: one whose least distance to the box is above another's
greatest distance to it is nearest to no point of the box.  The rest is kept under the box's cell in a table of the
worker, and a part of a vector is compared exactly with its cell's entries only.  All arithmetic is on whole numbers.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickerlake import session
from tickerlake.llm import common

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Cells that a worker keeps for one part; a full table starts anew.  Numbers in one step of a comparison.
MOST_CELLS = 50_000
STEP = 1 << 21
#: Labels with more than this share of the rows meet their sum apart; so there are fewer than 1,000 of them.
HOT = 1000


class Cells:
    """Nearest entries of one codebook (entry, component), by way of the boxes that points lie in."""

    def __init__(self, book: np.ndarray):
        self.book = book
        self.width = max(1, int(book.std()) // 2) if book.size else 1
        self.kept: dict[bytes, np.ndarray] = {}

    def judge(self, cells: np.ndarray) -> list[np.ndarray]:
        """The entries of each cell (cell, component) that some point of its box may be nearest to, ascending."""
        out = []
        step = max(1, STEP // self.book.size)
        for a in range(0, len(cells), step):
            low = (cells[a : a + step] * self.width)[:, None, :]
            high = low + self.width - 1
            least = np.maximum(np.maximum(low - self.book, self.book - high), 0)
            most = np.maximum(np.abs(self.book - low), np.abs(self.book - high))
            least, most = (least * least).sum(axis=2), (most * most).sum(axis=2)
            out += [np.flatnonzero(row) for row in least <= most.min(axis=1, keepdims=True)]
        return out

    def entries(self, cells: np.ndarray) -> list[np.ndarray]:
        names = [c.tobytes() for c in cells]
        new = [i for i, name in enumerate(names) if name not in self.kept]
        if len(self.kept) + len(new) > MOST_CELLS:
            self.kept.clear()
            new = list(range(len(names)))
        self.kept.update(zip((names[i] for i in new), self.judge(cells[new])))
        return [self.kept[name] for name in names]

    def nearest(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(entry, squared distance) of the nearest entry of each point, of equally near ones that with the lower number."""
        codes, errors = np.zeros(len(points), dtype=np.int64), np.zeros(len(points), dtype=np.int64)
        if not self.book.shape[1]:
            return codes, errors
        step = max(1, STEP // self.book.size)
        for a in range(0, len(points), step):
            some = points[a : a + step]
            cells, inverse = np.unique(some // self.width, axis=0, return_inverse=True)
            lists = self.entries(cells)
            sizes = np.array([len(x) for x in lists])
            first = np.cumsum(sizes) - sizes
            mine = sizes[inverse.ravel()]
            entry = np.concatenate(lists)[np.repeat(first[inverse.ravel()], mine) + common.ragged(mine)]
            apart = self.book[entry] - np.repeat(some, mine, axis=0)
            apart = (apart * apart).sum(axis=1)
            starts = np.cumsum(mine) - mine
            errors[a : a + step] = best = np.minimum.reduceat(apart, starts)
            codes[a : a + step] = np.minimum.reduceat(np.where(apart == np.repeat(best, mine), entry, len(self.book)), starts)
        return codes, errors


def whole(vectors: DataFrame) -> DataFrame:
    """(vec_id, label, embedding array<double>) of rows whose vector is neither null nor holds null or non-finite components."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "label", F.col("embedding").cast("array<double>").alias("embedding")).where(F.coalesce(finite, F.lit(False)))


def numbers(column: pa.ListArray, width: int) -> np.ndarray:
    """(row, part, component) whole numbers of a batch's vectors."""
    flat = np.floor(column.flatten().to_numpy(zero_copy_only=False) * float(SCALE))
    if len(flat) and np.abs(flat).max() >= largest(width):
        raise ValueError(f"a component times {SCALE} is {np.abs(flat).max():g}; squared distances of {width} components hold less than {largest(width):g}")
    return flat.astype(np.int64).reshape(len(column), PARTS, width // PARTS)


def largest(width: int) -> float:
    """Components below this bound have squared distances, summed over a vector, below 2**62."""
    return 2.0**30 / max(width, 1) ** 0.5


def first_books(kept: DataFrame, width: int) -> np.ndarray:
    """(part, entry, component): the parts of the vectors with the ENTRIES smallest ids."""
    rows = kept.orderBy(F.col("vec_id").asc_nulls_last(), "embedding").limit(ENTRIES).select("embedding").collect()  # ENTRIES rows
    return numbers(pa.array([r.embedding for r in rows], pa.list_(pa.float64())), width).transpose(1, 0, 2)


def moved(kept: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks after a round: entries become the floor of their parts' mean, unused ones stay."""
    _, entries, width = books.shape

    def run(batches):
        cells = [Cells(b) for b in books]
        sums = np.zeros((PARTS, entries, width + 1), dtype=np.int64)
        for batch in batches:
            points = numbers(batch.column(0), PARTS * width)
            for k, cell in enumerate(cells):
                codes, _ = cell.nearest(points[:, k])
                np.add.at(sums[k], codes, np.hstack([points[:, k], np.ones((len(points), 1), dtype=np.int64)]))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(sums.size, dtype=np.int32)), pa.array(sums.ravel())], ["place", "value"])

    parts = kept.select("embedding").mapInArrow(run, "place int, value long").where("value <> 0")
    out = np.zeros(PARTS * entries * (width + 1), dtype=np.int64)
    for place, value in parts.groupBy("place").agg(F.sum("value")).collect():  # the size of the codebooks
        out[place] = value
    sums = out.reshape(PARTS, entries, width + 1)
    count = sums[:, :, -1:]
    return np.where(count > 0, sums[:, :, :-1] // np.maximum(count, 1), books)


def train(kept: DataFrame, rounds: int = ROUNDS) -> np.ndarray | None:
    """(part, entry, component) codebooks of whole() vectors; None where there is no vector."""
    least, most = kept.agg(F.min(F.size("embedding")), F.max(F.size("embedding"))).head()
    if least is None:
        return None
    if least != most or least % PARTS:
        raise ValueError(f"vectors have {least} to {most} components; one length that {PARTS} divides is needed")
    books = first_books(kept, least)
    for _ in range(rounds):
        books = moved(kept, books)
    return books


def encode(kept: DataFrame, books: np.ndarray) -> DataFrame:
    """(vec_id, label, code, error) of whole() vectors."""
    kind = kept.schema["label"].dataType.simpleString()
    width = PARTS * books.shape[2]

    def run(batches):
        cells = [Cells(b) for b in books]
        for batch in batches:
            points = numbers(batch.column(2), width)
            found = [cell.nearest(points[:, k]) for k, cell in enumerate(cells)]
            packed = np.array([codes for codes, _ in found], dtype=np.uint8).T
            code = [row.tobytes().hex() for row in np.ascontiguousarray(packed)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(code, pa.string()), pa.array(sum(e for _, e in found), pa.int64())], ["vec_id", "label", "code", "error"])

    return kept.mapInArrow(run, f"vec_id long, label {kind}, code string, error long")


def with_label_errors(coded: DataFrame) -> DataFrame:
    """Adds label_error, the errors summed over equal labels (nulls together).

    coded: label, error and further columns.  Sums of labels with more than a HOT-th of the rows are fewer than HOT
    and are broadcast; rows that have one are spread over the partitions of the join with the other sums.
    """
    sums = session.stage(coded.groupBy("label").agg(F.count("*").alias("n"), F.sum("error").alias("sum")), "labels")
    total = sums.agg(F.coalesce(F.sum("n"), F.lit(0))).head()[0]
    is_hot = F.col("n") * HOT > total
    hot = sums.where(is_hot).select(F.col("label").alias("hot"), F.col("sum").alias("hot_sum"))
    rare = sums.where(~is_hot).select(F.col("label").alias("rare"), F.lit(0).cast("long").alias("apart"), F.col("sum").alias("rare_sum"))
    rows = coded.join(F.broadcast(hot), F.col("label").eqNullSafe(F.col("hot")), "left")
    rows = rows.withColumn("spread", F.when(F.col("hot_sum").isNotNull(), F.xxhash64("vec_id", "code")).otherwise(0))
    rows = rows.join(rare, F.col("label").eqNullSafe(F.col("rare")) & (F.col("spread") == F.col("apart")), "left")
    return rows.select(*coded.columns, F.coalesce("hot_sum", "rare_sum").alias("label_error"))


def digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def vector_codes(vectors: DataFrame) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) of every vector that whole() keeps.

    vectors: vec_id, embedding, label (further columns are ignored).  Codebooks start from the smallest vec_ids, a
    missing one last, equal ones by their vectors; with fewer than ENTRIES vectors they are smaller.  Repeated rows
    stay.  Vectors without components have code 00 in every part.  An empty table gives no rows.  Vectors of several
    lengths, of one that PARTS does not divide, and components too large for exact sums (see ``largest``) are an error.
    """
    kept = whole(vectors)
    books = train(kept)
    coded = encode(kept, np.zeros((PARTS, 1, 0), dtype=np.int64) if books is None else books)
    coded = with_label_errors(session.stage(coded, "codes"))
    return coded.select("vec_id", "code", "error", "label_error", F.lit("" if books is None else digest(books)).alias("codebooks_sha256"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes(common.table(spark, sf_dir, "embeddings"))


def _nearest(name: str, book: str) -> str:
    return f"""{name}_best AS (SELECT v, p, min(list_sum(list_transform(list_zip(c, e), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::HUGEINT * {ENTRIES} + entry) AS best FROM cut JOIN {book} USING (p) GROUP BY v, p),
{name} AS (SELECT v, p, (best % {ENTRIES})::INT AS entry, (best // {ENTRIES})::BIGINT AS apart FROM {name}_best)"""


def _moved(name: str, found: str, book: str) -> str:
    return f"""{name}_sums AS (SELECT p, entry, i, sum(c[i])::BIGINT AS s, count(*) AS n FROM cut JOIN {found} USING (v, p), range(1, 1025) r(i) WHERE i <= len(c) GROUP BY p, entry, i),
{name}_means AS (SELECT p, entry, list((s - ((s % n) + n) % n) // n ORDER BY i) AS mean FROM {name}_sums GROUP BY p, entry),
{name} AS (SELECT p, entry, coalesce(mean, e) AS e FROM {book} LEFT JOIN {name}_means USING (p, entry))"""


#: All entries of a codebook compared with every part.
ORACLE = f"""
WITH kept AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS e, row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) - 1 AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
cut AS (SELECT v, p, e[p * len(e) // {PARTS} + 1 : (p + 1) * len(e) // {PARTS}] AS c FROM kept, range({PARTS}) r(p)),
book0 AS (SELECT p, v AS entry, c AS e FROM cut WHERE v < {ENTRIES}),
{_nearest('near0', 'book0')}, {_moved('book1', 'near0', 'book0')},
{_nearest('near1', 'book1')}, {_moved('book2', 'near1', 'book1')},
{_nearest('near2', 'book2')},
coded AS (SELECT v, string_agg(printf('%02x', entry), '' ORDER BY p) AS code, sum(apart)::BIGINT AS error FROM near2 GROUP BY v),
told AS (SELECT sha256(string_agg(array_to_string(e, ','), ',' ORDER BY p, entry)) AS codebooks_sha256 FROM book2)
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256 FROM kept JOIN coded USING (v), told
"""
