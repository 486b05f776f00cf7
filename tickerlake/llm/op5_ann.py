"""Approximate nearest neighbours by cross-polytope hashing.

A vector of length one is turned by fast pseudo-rotations (three rounds of random signs and a Hadamard transform)
and named after the signed axis it is nearest to.  A table's key is made of one or more such names.  A query looks
up several keys of each table, those whose axes are least farther away than its own (multiprobe; the more the longer
keys are), and everything it meets is ranked by its exact distance on the original vectors.

Equal vectors are hashed and compared once.  Rows of a table that share the first name of a key form a group; groups
of more than LARGE rows are split, and queries go to every part.  Tasks return each query's best few of a part, so
that neither rows nor pairs are gathered.  Queries that met too few vectors are compared with all, block by block.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickerlake import session
from tickerlake.llm import common

K = 10
EVERY = 100
#: Tables and the fewest keys looked up in each; looked_up gives more where keys are long (measured in the README).
TABLES = 24
PROBES = 128
#: The most keys looked up in a table: keys are not made of more names than these suffice for.
MOST_PROBES = 8192
#: The fewest axes that are tried for each name of a key.
AXES = 32
#: Queries whose keys are found at once.
ASKED = 128
#: Rows of a group that one task compares.
LARGE = 8192
BLOCK = 4096


def looked_up(count: int, width: int, least: int = PROBES) -> int:
    """Keys looked up in each table.  Keys multiply by 2 * width with each name; so that the neighbours met do not
    become fewer, those looked up multiply by a quarter of that (128 keys of two names at width 64, 4096 of three)."""
    return max(least, (2 * width) ** count >> (3 + 2 * count))


def names(n: int, width: int) -> int:
    """Names in a key: as many as give about one key for each of n vectors, while MOST_PROBES keys are enough."""
    count = max(1, round(math.log(max(n, 2)) / math.log(2 * width)))
    while count > 1 and looked_up(count, width) > MOST_PROBES:
        count -= 1
    return count


@functools.cache
def signs(table: int, name: int, width: int) -> np.ndarray:
    """(round, axis) of one pseudo-rotation."""
    return np.where(common.mix(np.arange(3 * width) + (table << 40) + (name << 32)) & common.U64(1), 1.0, -1.0).reshape(3, width)


def rotated(vectors: np.ndarray, table: int, name: int) -> np.ndarray:
    """Pseudo-rotated vectors; their width is a power of two."""
    n, width = vectors.shape
    out = vectors
    for flips in signs(table, name, width):
        out = out * flips
        half = 1
        while half < width:
            pairs = out.reshape(n, -1, 2, half)
            out = np.concatenate([pairs[:, :, :1] + pairs[:, :, 1:], pairs[:, :, :1] - pairs[:, :, 1:]], axis=2).reshape(n, width)
            half *= 2
        out = out / math.sqrt(width)
    return out


def prepared(vectors: list) -> np.ndarray:
    """Vectors of one size, scaled to length one and filled up with zeros to a power of two."""
    x = np.array([np.asarray(v, dtype=np.float64) for v in vectors])
    x = x / np.abs(x).max(axis=1, keepdims=True)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    width = 1 << max(1, (x.shape[1] - 1).bit_length())
    return np.hstack([x, np.zeros((len(x), width - x.shape[1]))])


def keys(unit: np.ndarray, table: int, count: int) -> np.ndarray:
    """(vector, name) signed axes: axis, plus the width where the nearest one is the negative."""
    out = []
    for name in range(count):
        turned = rotated(unit, table, name)
        axis = np.abs(turned).argmax(axis=1)
        out.append(axis + unit.shape[1] * (turned[np.arange(len(turned)), axis] < 0))
    return np.stack(out, axis=1)


def probes(unit: np.ndarray, table: int, count: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(vector, probe, name) keys to look up, the likeliest first, and which of them are real."""
    n, width = unit.shape
    chosen, cost = np.zeros((n, 1, 0), dtype=np.int64), np.zeros((n, 1))
    for name in range(count):
        turned = rotated(unit, table, name)
        both = np.concatenate([turned, -turned], axis=1)
        axes = np.argsort(-both, axis=1, kind="stable")[:, : most if count == 1 else max(AXES, 2 * math.ceil(most ** (1 / count)))]
        away = np.take_along_axis(both, axes, axis=1)
        total = (cost[:, :, None] + ((away[:, :1] - away) ** 2)[:, None, :]).reshape(n, -1)
        best = np.argsort(total, axis=1, kind="stable")[:, :most]
        before, axis = best // axes.shape[1], best % axes.shape[1]
        chosen = np.concatenate([np.take_along_axis(chosen, before[:, :, None], axis=1), np.take_along_axis(axes, axis, axis=1)[:, :, None]], axis=2)
        cost = np.take_along_axis(total, best, axis=1)
    return chosen, cost


def combined(names: np.ndarray, width: int) -> np.ndarray:
    """One number for the names of a key."""
    out = np.zeros(names.shape[:-1], dtype=np.int64)
    for k in range(names.shape[-1]):
        out = out * (2 * width) + names[..., k]
    return out


def usable(rows: DataFrame) -> DataFrame:
    """(vec_id, embedding array<double>, size) of vectors that take part: no null, zero, or non-finite component.

    Of rows that share a vec_id one takes part, that with the smallest vector; rows without a vec_id do not.
    """
    v = F.col("embedding").cast("array<double>")
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("embedding")).where("vec_id is not null and embedding is not null")
    good = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0)
    return rows.where(good).groupBy("vec_id").agg(F.min("embedding").alias("embedding")).withColumn("size", F.size("embedding"))


def best_of(queries: np.ndarray, found: np.ndarray, allowed: list[np.ndarray] | None, ids: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each query the ids and distances of its k nearest allowed rows (their places), ties to smaller ids."""
    out = []
    for i, q in enumerate(queries):
        own = np.arange(len(found)) if allowed is None else allowed[i]
        gap = np.sqrt(((found[own] - q) ** 2).sum(axis=1))
        if len(own) > k:
            near = np.flatnonzero(gap <= np.partition(gap, k - 1)[k - 1])
            own, gap = own[near], gap[near]
        order = np.lexsort((ids[own], gap))[:k]
        out.append((ids[own][order], gap[order]))
    return out


MET = "query long, near long, score double"


def met(query_ids: np.ndarray, best: list[tuple[np.ndarray, np.ndarray]]) -> pd.DataFrame:
    return pd.DataFrame({"query": np.repeat(query_ids, [len(i) for i, _ in best]), "near": np.concatenate([np.empty(0, np.int64), *(i for i, _ in best)]), "score": np.concatenate([np.empty(0), *(s for _, s in best)])})


def compare(key, queries: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
    """Best of one part of a group for the queries that look it up; each query brings the keys it looks up there."""
    if not len(queries) or not len(found):
        return met(np.empty(0, np.int64), [])
    order = np.argsort(found["key"].to_numpy(), kind="stable")
    own, allowed = found["key"].to_numpy()[order], []
    for k in queries["keys"]:
        first = np.searchsorted(own, k, side="left")
        met_rows = np.searchsorted(own, k, side="right") - first
        allowed.append(order[np.repeat(first, met_rows) + common.ragged(met_rows)])
    q, x = (np.array([np.asarray(v, dtype=np.float64) for v in frame["embedding"]]) for frame in (queries, found))
    return met(queries["near"].to_numpy(), best_of(q, x, allowed, found["near"].to_numpy(), K + 1))


def compare_all(key, queries: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
    if not len(queries) or not len(found):
        return met(np.empty(0, np.int64), [])
    q, x = (np.array([np.asarray(v, dtype=np.float64) for v in frame["embedding"]]) for frame in (queries, found))
    return met(queries["near"].to_numpy(), best_of(q, x, None, found["near"].to_numpy(), K + 1))


def top(rows: DataFrame) -> DataFrame:
    """The K + 1 nearest of every query, met once or more."""
    ranked = F.row_number().over(Window.partitionBy("query").orderBy("score", "near"))
    return rows.distinct().withColumn("at", ranked).where(F.col("at") <= K + 1).drop("at")


def search(rows: DataFrame, every: int = EVERY, tables: int = TABLES, most: int = PROBES) -> DataFrame:
    """(query_id, rank, vec_id, score): the K nearest of each row whose vec_id is divisible by ``every``.

    rows: vec_id, embedding (further columns are ignored).  Vectors that are null, empty or zero, or hold null or
    non-finite components, take no part; vectors of different sizes are not compared.  score is the Euclidean
    distance in double precision; ties go to smaller vec_ids.  A query has fewer rows only if there are fewer
    candidates.  An empty table gives an empty result.
    """
    spark = rows.sparkSession
    good = session.stage(usable(rows), "vectors")
    # equal vectors are one; any query needs at most the K + 1 smallest ids of each
    small = F.row_number().over(Window.partitionBy("embedding").orderBy("vec_id"))
    members = good.withColumn("at", small).where(F.col("at") <= K + 1)
    same = members.groupBy("embedding", "size").agg(F.min("vec_id").alias("near"), F.array_sort(F.collect_list("vec_id")).alias("ids"))
    same = session.stage(same, "distinct")
    asked = good.where(F.col("vec_id") % every == 0).select("vec_id", "embedding").join(same.select("embedding", "near", "size"), "embedding")
    asked = session.stage(asked.select(F.col("vec_id").alias("query_id"), F.col("near").alias("query"), "size"), "queries")
    queries = same.join(asked.select(F.col("query").alias("near")).distinct(), "near", "left_semi").select("near", "size", "embedding")
    sizes = {r["size"]: r["count"] for r in same.groupBy("size").count().collect()}  # one row a vector size

    def index(frames):
        for frame in frames:
            for size, own in frame.groupby("size"):
                unit = prepared(list(own["embedding"]))
                for t in range(tables):
                    name = keys(unit, t, names(sizes[size], unit.shape[1]))
                    yield pd.DataFrame({"size": size, "table": t, "first": name[:, 0], "key": combined(name, unit.shape[1]), "near": own["near"].to_numpy(), "embedding": list(own["embedding"])})

    def look(frames):
        for frame in frames:
            for size, own in frame.groupby("size"):
                for a in range(0, len(own), ASKED):
                    some = own.iloc[a : a + ASKED]
                    unit = prepared(list(some["embedding"]))
                    count = names(sizes[size], unit.shape[1])
                    for t in range(tables):
                        name, _ = probes(unit, t, count, looked_up(count, unit.shape[1], most))
                        key = combined(name, unit.shape[1])
                        out = []
                        for i in range(len(some)):
                            for first in np.unique(name[i, :, 0]):
                                out.append((size, t, first, key[i, name[i, :, 0] == first], some["near"].iloc[i], some["embedding"].iloc[i]))
                        yield pd.DataFrame(out, columns=["size", "table", "first", "keys", "near", "embedding"])

    kind = "size int, table int, first long"
    rows_of = same.select("near", "size", "embedding").mapInPandas(index, f"{kind}, key long, near long, embedding array<double>")
    looks = queries.mapInPandas(look, f"{kind}, keys array<long>, near long, embedding array<double>")
    parts = rows_of.groupBy("size", "table", "first").agg(F.ceil(F.count("*") / LARGE).cast("int").alias("parts"))
    group = ["size", "table", "first"]
    parts = session.stage(parts, "parts")
    placed = rows_of.join(parts, group).select(*group, "key", "near", "embedding", F.pmod(F.xxhash64("near"), F.col("parts")).cast("int").alias("part"))
    split = parts.select(*group, F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    asking = looks.join(split, group).select(*group, "keys", "near", "embedding", "part")
    found = asking.groupBy(*group, "part").cogroup(placed.groupBy(*group, "part")).applyInPandas(compare, MET)
    found = session.stage(top(found), "found")

    # queries that met too few: all vectors of their size, in blocks
    want = spark.createDataFrame([(s, n) for s, n in sizes.items()], "size int, there long")
    short = found.groupBy("query").count()
    short = queries.withColumnRenamed("near", "query").join(short, "query", "left").join(want, "size").where(F.coalesce("count", F.lit(0)) < F.least(F.col("there"), F.lit(K + 1)))
    blocks = F.ceil(F.col("there") / BLOCK).cast("int")
    wide = short.select(F.col("query").alias("near"), "size", "embedding", F.explode(F.sequence(F.lit(0), blocks - 1)).alias("part"))
    everything = same.toDF(*same.columns).join(want.toDF("size", "there"), "size").select("near", "size", "embedding", F.pmod(F.xxhash64("near"), blocks).cast("int").alias("part"))
    rest = wide.groupBy("size", "part").cogroup(everything.groupBy("size", "part")).applyInPandas(compare_all, MET)
    nearest = found.join(short.select("query"), "query", "left_anti").unionByName(top(rest))

    by_id = asked.select("query_id", "query").join(nearest, "query").join(same.select("near", "ids"), "near")
    each = by_id.select("query_id", F.explode("ids").alias("vec_id"), "score").where("vec_id <> query_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return each.withColumn("rank", rank).where(F.col("rank") <= K).select("query_id", "rank", "vec_id", "score")


def op5_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(common.table(spark, sf_dir, "embeddings"))
