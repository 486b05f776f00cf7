"""SimHash near-duplicates, linked through tables of distances to reference fingerprints.

Fingerprints at most RADIUS = 2 bits apart agree in two of four 16-bit words, so that six tables, each keyed by
two of the words, bring every such pair into a bucket at least once.  Inside a bucket a pair is dropped when its
distances to any reference fingerprint (pivot) differ by more than the radius: by the triangle inequality it
cannot be a link then.  What is left is verified bit by bit.

Fingerprints that share a bucket of more than LARGE members are linked another, equally exact way that never
lists pairs: each writes itself and its 64 neighbours at one bit, and two fingerprints are at most two bits apart
exactly if they have one of these in common; a neighbour is shared by 65 at most.
"""

from __future__ import annotations

import functools
import itertools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickerlake import session
from tickerlake.llm import common
from tickerlake.llm.components import components

WORDS = 3
SEED = 42
RADIUS = 2
PIVOTS = 24
LARGE = 64
SLICE_BYTES = 2_000_000
#: Hashes whose bits are counted at once.
COUNTED = 1 << 18


def shingle_hashes(text: str) -> list[int]:
    """XXH64 of each shingle: runs of WORDS words, A-Z lower-cased, with one space between; all words if fewer."""
    words = text.encode("utf-8").lower().split()  # bytes: only ASCII letters and ASCII white space count
    if not words:
        return []
    if len(words) < WORDS:
        return [xxhash.xxh64_intdigest(b" ".join(words), SEED)]
    digest = functools.partial(xxhash.xxh64_intdigest, seed=SEED)
    return list(map(digest, map(b" ".join, zip(*(words[i:] for i in range(WORDS))))))


def simhash(texts: list[str]) -> np.ndarray:
    """A 64-bit fingerprint (as signed) for every text: a bit is set if over half of the hashes have it."""
    hashes = [shingle_hashes(t) for t in texts]
    sizes = np.array([len(h) for h in hashes], dtype=np.int64)
    out = np.zeros(len(texts), dtype=np.uint64)
    full = np.flatnonzero(sizes)
    if not len(full):
        return out.view(np.int64)
    flat = np.fromiter(itertools.chain.from_iterable(hashes), dtype=np.uint64, count=int(sizes.sum()))
    owner = np.repeat(np.arange(len(full)), sizes[full])
    ones = np.zeros((len(full), 64), dtype=np.int64)
    for a in range(0, len(flat), COUNTED):
        bits = np.unpackbits(flat[a : a + COUNTED].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        starts = np.flatnonzero(np.diff(owner[a : a + COUNTED], prepend=-1))
        ones[owner[a : a + COUNTED][starts]] += np.add.reduceat(bits, starts, axis=0, dtype=np.int64)
    packed = np.packbits(2 * ones > sizes[full, None], axis=1, bitorder="little")
    out[full] = np.ascontiguousarray(packed).view(np.uint64).ravel()
    return out.view(np.int64)


def row_mark(docs: DataFrame) -> Column:
    """A hash of all columns of a row."""
    return F.xxhash64(*(F.col(f"`{c}`") for c in docs.columns))


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, mark, bits long) of every document, mark is its row_mark; a text without words has no bit set."""

    def run(batches):
        for batch in common.slices(batches, "text", SLICE_BYTES):
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(simhash(batch.column(1).to_pylist()))], ["doc_id", "mark", "bits"])

    text = F.coalesce(F.col("text"), F.lit("")).alias("text")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text, row_mark(docs).alias("mark")).mapInArrow(run, "doc_id long, mark long, bits long")


def distance(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def pivots() -> list[int]:
    """Reference fingerprints, spread by rule."""
    return common.mix(np.arange(PIVOTS) + (1 << 50)).view(np.int64).tolist()


def keyed(distinct: DataFrame) -> DataFrame:
    """Each fingerprint with its pivot distances once for every table: (part, key, bits, apart)."""
    word = [F.shiftrightunsigned("bits", 16 * i).bitwiseAND(F.lit(0xFFFF)) for i in range(4)]
    keys = [F.struct(F.lit(t).alias("part"), (word[i] * 65536 + word[j]).alias("key")) for t, (i, j) in enumerate(itertools.combinations(range(4), 2))]
    return distinct.select("bits", "apart", F.inline(F.array(*keys)))


def links(distinct: DataFrame) -> DataFrame:
    """(a, b) for fingerprints at most RADIUS bits apart; for large buckets enough of these to connect them all.

    distinct: one column ``bits`` without repeats.
    """
    apart = F.array(*(distance(F.col("bits"), F.lit(p)).cast("byte") for p in pivots()))
    rows = keyed(distinct.select("bits", apart.alias("apart")))
    sizes = rows.groupBy("part", "key").agg(F.count("*").alias("n")).where("n > 1")
    shared = session.stage(rows.join(sizes, ["part", "key"]), "buckets")
    small = shared.where(F.col("n") <= LARGE)
    a = small.select("part", "key", F.col("bits").alias("a"), F.col("apart").alias("to_a"))
    b = small.select("part", "key", F.col("bits").alias("b"), F.col("apart").alias("to_b"))
    gap = F.array_max(F.zip_with("to_a", "to_b", lambda x, y: F.abs(x - y)))
    pairs = a.join(b, ["part", "key"]).where((F.col("a") < F.col("b")) & (gap <= RADIUS) & (distance(F.col("a"), F.col("b")) <= RADIUS)).select("a", "b")
    hot = shared.where(F.col("n") > LARGE).select("bits").distinct()
    near = F.array(F.col("bits"), *(F.col("bits").bitwiseXOR(F.lit(1 << i if i < 63 else -(1 << 63))) for i in range(64)))
    balls = hot.select(F.col("bits").alias("b"), F.explode(near).alias("centre")).groupBy("centre").agg(F.collect_list("b").alias("members")).where(F.size("members") > 1)
    stars = balls.select(F.array_min("members").alias("a"), F.explode("members").alias("b")).where((F.col("a") < F.col("b")) & (distance(F.col("a"), F.col("b")) <= RADIUS))
    return pairs.unionByName(stars)


def groups(prints: DataFrame) -> DataFrame:
    """(bits, component, component_id) of every fingerprint in prints (doc_id, bits): the smallest fingerprint and the
    smallest doc_id reachable over links."""
    distinct = session.stage(prints.groupBy("bits").agg(F.min("doc_id").alias("least")), "distinct")
    found = components(links(distinct.select("bits")))
    whole = distinct.join(found.withColumnRenamed("node", "bits"), "bits", "left").withColumn("component", F.coalesce("component", "bits"))
    least = whole.groupBy("component").agg(F.min("least").alias("component_id"))
    return whole.join(least, "component").select("bits", "component", "component_id")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every document.

    docs: doc_id, text (further columns are ignored).  A null text counts as empty.  component_id is the smallest
    doc_id reachable over links (null only if no document of the component has an id); repeated rows give repeated
    rows.  An empty table gives an empty result.
    """
    prints = session.stage(fingerprints(docs.select("doc_id", "text")), "simhash")
    return prints.join(groups(prints), "bits").select("doc_id", F.lpad(F.lower(F.hex("bits")), 16, "0").alias("fingerprint"), "component_id")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(common.table(spark, sf_dir, "documents"))


def keep_one(docs: DataFrame) -> DataFrame:
    """One document of each group of near-duplicates: that with the smallest doc_id, all columns as they were.

    Of a group's rows that share this doc_id the one with the smallest row_mark stays, which depends on their
    contents alone; rows of other groups with the same doc_id are no rivals.  Documents without a doc_id are no part
    of the groups; of those with equal texts one stays.
    """
    named = docs.where(F.col("doc_id").isNotNull())
    prints = session.stage(fingerprints(named), "simhash")
    first = prints.join(groups(prints), "bits").where("doc_id = component_id").groupBy("component", "doc_id").agg(F.min("mark").alias("_mark"))
    kept = named.withColumn("_mark", row_mark(named)).join(first.select("doc_id", "_mark"), ["doc_id", "_mark"], "left_semi")
    rest = docs.where(F.col("doc_id").isNull()).dropDuplicates(["text"])
    return kept.dropDuplicates(["doc_id", "_mark"]).select(*docs.columns).unionByName(rest)
