"""Documents in ascending doc_id order, dealt to contiguous blocks without one task seeing them all."""

from __future__ import annotations

import bisect

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROWS = 4096
MOST_BLOCKS = 20_000


def bounds(df: DataFrame, key: str = "doc_id", rows: int | None = None) -> tuple[list[int], bool]:
    """First ids of blocks of about ``rows`` (ROWS) rows, and whether there are rows without an id (they come first).

    Only the id column is read.  Beyond MOST_BLOCKS blocks the blocks grow instead; they are streamed, so
    nothing is lost by it.
    """
    n, nulls, least = df.agg(F.count("*"), F.count_if(F.col(key).isNull()), F.min(key)).head()
    if n == nulls:
        return ([], nulls > 0)
    parts = min(MOST_BLOCKS, -(-n // (rows or ROWS)))
    inner = []
    if parts > 1:
        marks = [i / parts for i in range(1, parts)]
        inner = df.agg(F.percentile_approx(key, marks, 4 * parts).alias("q")).head().q
    return (sorted({least, *inner}), nulls > 0)


def deal(df: DataFrame, firsts: list[int], nulls: bool, with_next: bool, prepare=None, made: str = "") -> DataFrame:
    """Adds ``block`` and ``tail`` and sends each block to a partition of its own, sorted by (tail, doc_id, payload).

    df: (doc_id long, payload).  With ``with_next`` the rows that open a block are also sent, as tail rows, to
    the block before (those of the first block to the last).  ``prepare`` may turn the batches of df into batches
    of (doc_id, other payload) on the way, in the same Python worker; ``made`` then names the payload and its type.
    """
    payload, kind = made.split() if prepare else (df.columns[1], df.schema[1].dataType.simpleString())
    firsts = firsts or [0]
    last = len(firsts) - 1

    def dealt(batches):
        marks = np.array(firsts, dtype=np.int64)
        for batch in prepare(batches) if prepare else batches:
            ids, body = batch.column(0), batch.column(1)
            empty = ids.is_null().to_numpy(zero_copy_only=False)
            values = ids.fill_null(0).to_numpy(zero_copy_only=False)
            block = np.where(empty, 0, np.maximum(np.searchsorted(marks, values, side="right") - 1, 0))
            if not with_next:
                yield pa.RecordBatch.from_arrays([pa.array(block.astype(np.int32)), pa.array(np.zeros(len(block), dtype=bool)), ids, body], ["block", "tail", "doc_id", payload])
            else:
                take = np.arange(len(values))
                opens = empty | ((values == marks[block]) & ~((block == 0) & nulls))
                own = np.flatnonzero(opens)
                take, where = np.concatenate([take, own]), np.concatenate([block, np.where(block[own] == 0, last, block[own] - 1)])
                tail = np.arange(len(take)) >= len(values)
                rows = pa.array(take)
                yield pa.RecordBatch.from_arrays([pa.array(where.astype(np.int32)), pa.array(tail), ids.take(rows), body.take(rows)], ["block", "tail", "doc_id", payload])

    out = df.mapInArrow(dealt, f"block int, tail boolean, doc_id long, {payload} {kind}")
    return out.repartitionById(last + 1, F.col("block")).sortWithinPartitions("tail", F.col("doc_id").asc_nulls_first(), payload)


def block_of(firsts: list[int], doc_id: int | None) -> int:
    return 0 if doc_id is None else max(bisect.bisect_right(firsts, doc_id) - 1, 0)
