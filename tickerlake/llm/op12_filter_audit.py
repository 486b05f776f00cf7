"""How five filters share the removals: Hart and Mas-Colell's potential of the removal game.

A coalition of filters is worth the documents that at least one of its filters removes.  Every document is
reduced to the set of filters it fails, so that a table of at most 32 counts for each part holds the whole game.
The potential P of a coalition S of s filters follows from those of its sub-coalitions,

    s P(S) = worth(S) + sum over f in S of P(S without f),    P(nothing) = 0,

and a filter's Shapley value is the potential of all filters less that of all but this one.  What a filter
removes at a step of an order is the worth of the coalition with it less that of the coalition before it.
"""

from __future__ import annotations

import hashlib
import itertools
import math
from collections.abc import Sequence

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickerlake import session
from tickerlake.llm import common

FILTERS = "ABCDE"
SHORT_WORDS, DISTINCT_PERCENT, UPPER_PERCENT = 100, 80, 10
MARKS = b"#$%&*|"
UPPER = bytes(range(ord("A"), ord("Z") + 1))
SLICE_BYTES = 4_000_000
REPEATED = 1 << FILTERS.index("E")
OUT = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def fails(data: bytes, points: int) -> int:
    """Filters A to D that a text (UTF-8, so many code points) fails, a bit each."""
    words = data.split()  # of bytes: \x20 and \x09 to \x0D alone
    return (
        (len(words) < SHORT_WORDS)
        | (100 * len(set(words)) < DISTINCT_PERCENT * len(words)) << 1
        | (100 * (len(data) - len(data.translate(None, UPPER))) > UPPER_PERCENT * points) << 2
        | (len(data.translate(None, MARKS)) < len(data)) << 3
    )


def judged(docs: DataFrame) -> DataFrame:
    """(doc_id, part, digest, mask): filters A to D of every document, and the SHA-256 of its text; no text is carried on."""

    def run(batches):
        for batch in common.slices(batches, "text", SLICE_BYTES):
            texts = batch.column(2)
            points = pc.utf8_length(texts).to_pylist()
            texts = texts.cast(pa.binary()).to_pylist()
            digests = pa.array([hashlib.sha256(t).digest() for t in texts], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), digests, pa.array(list(map(fails, texts, points)), pa.int32())], ["doc_id", "part", "digest", "mask"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("lang", F.lit("")).alias("part"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(run, "doc_id long, part string, digest binary, mask int")


def game(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): documents of a part that fail exactly the filters of mask, and labelled ones of them.

    docs: doc_id, lang, text; labels: doc_id, quality, toxic (further columns are ignored).  A null text is empty,
    a null lang the part "".  A document repeats (E) when a smaller doc_id has its text; one without a doc_id has
    none smaller, makes none repeat and has no label.  Repeated rows are each counted.  Of several labels of a
    document, one that says so makes it good or toxic.

    Rows alike in everything are counted before they move, the first holder of a text is found by a map-side
    minimum and meets its own row only, and rows without a doc_id are spread by their digest: no key is hot.
    """
    rows = session.stage(judged(docs), "judged")
    counted = rows.groupBy("doc_id", "digest", "part", "mask").agg(F.count("*").alias("n"))
    firsts = rows.where("doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    repeated = F.when(F.col("doc_id").isNotNull() & F.col("first").isNull(), REPEATED).otherwise(0)
    whole = counted.join(firsts, ["doc_id", "digest"], "left").withColumn("mask", F.col("mask").bitwiseOR(repeated))
    said = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "quality", "toxic").where("doc_id is not null").groupBy("doc_id")
    said = said.agg(F.max((F.col("quality") == 1).cast("long")).alias("good"), F.max((F.col("toxic") == 1).cast("long")).alias("toxic")).withColumn("spread", F.lit(0).cast("long"))
    spread = F.when(F.col("doc_id").isNull(), F.xxhash64("digest")).otherwise(0).alias("spread")
    told = whole.select("doc_id", spread, "part", "mask", "n").join(said, ["doc_id", "spread"], "left")
    sums = (F.sum("n").alias("n"), *(F.coalesce(F.sum(F.col("n") * F.col(x)), F.lit(0)).alias(x) for x in ("good", "toxic")))
    return told.groupBy("part", "mask").agg(*sums)


def worths(counts: dict[int, int], filters: int) -> list[int]:
    """Documents that a coalition removes, for every coalition; counts: documents by the set of filters they fail."""
    return [sum(n for mask, n in counts.items() if mask & coalition) for coalition in range(1 << filters)]


def potentials(worth: Sequence[int], filters: int) -> list[int]:
    """s! times the potential of every coalition of s filters: whole numbers, from smaller coalitions to larger ones."""
    out = [0] * (1 << filters)
    for coalition in range(1, 1 << filters):  # a sub-coalition has a smaller number
        members = [f for f in range(filters) if coalition >> f & 1]
        out[coalition] = math.factorial(len(members) - 1) * worth[coalition] + sum(out[coalition ^ 1 << f] for f in members)
    return out


def shapley(worth: Sequence[int], filters: int) -> list[int]:
    """filters! times each filter's Shapley value, which is what it removes summed over all orders."""
    potential, grand = potentials(worth, filters), (1 << filters) - 1
    return [potential[grand] - filters * potential[grand ^ 1 << f] for f in range(filters)]


def steps(cells: pd.DataFrame, filters: str = FILTERS) -> pd.DataFrame:
    """Every order's steps in one part; cells: (part, mask, n, good, toxic), a row for each mask at most."""
    count, good, toxic = (worths(dict(zip(cells["mask"].tolist(), cells[x].tolist())), len(filters)) for x in ("n", "good", "toxic"))
    part, total, grand = cells["part"].iloc[0], int(cells["n"].sum()), len(count) - 1
    share, out = shapley(count, len(filters)), []
    for order in itertools.permutations(range(len(filters))):
        before = 0
        for step, f in enumerate(order, 1):
            after = before | 1 << f
            removed = count[after] - count[before]
            alone = count[grand] - count[grand ^ 1 << f]
            out.append(("".join(filters[x] for x in order), step, total - count[after], removed, count[1 << f] - removed, alone, good[after] - good[before], toxic[after] - toxic[before], share[f]))
            before = after
    names = [field.split()[0] for field in OUT.split(", ")]
    rows = pd.DataFrame(out, columns=names[1:])
    rows.insert(0, "part", part)
    return rows


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """A row for every part, order and step of the filters, see ``game`` for what counts.  No documents, no rows."""
    return game(docs, labels).groupBy("part").applyInPandas(lambda cells: steps(cells), OUT)  # 32 rows of a part at most


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))


_LETTERS = ", ".join(f"('{x}', {1 << i})" for i, x in enumerate(FILTERS))
#: Steps counted one by one from the failures, and their sum over all orders.
ORACLE = f"""
WITH texts AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words FROM documents),
said AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
judged AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic, (len(words) < {SHORT_WORDS})::INT + 2 * (100 * len(list_distinct(words)) < {DISTINCT_PERCENT} * len(words))::INT
  + 4 * (100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > {UPPER_PERCENT} * length(text))::INT + 8 * regexp_matches(text, '[#$%&*|]')::INT
  + 16 * coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), false)::INT AS mask FROM texts LEFT JOIN said USING (doc_id)),
cells AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM judged GROUP BY ALL),
letters(name, bit) AS (VALUES {_LETTERS}),
orders AS (SELECT concat(a.name, b.name, c.name, d.name, e.name) AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
  FROM letters a, letters b, letters c, letters d, letters e WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31 AND (a.bit | b.bit | c.bit | d.bit | e.bit) = 31),
steps AS (SELECT filter_order, s::INT AS step, bits[s] AS bit, coalesce(list_sum(bits[:s - 1]), 0)::INT AS before FROM orders, range(1, 6) r(s)),
counts AS (SELECT part, filter_order, step, bit, coalesce(sum(n) FILTER (mask & (before | bit) = 0), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (mask & bit <> 0 AND mask & before = 0), 0)::BIGINT AS removed,
  coalesce(sum(n) FILTER (mask & bit <> 0 AND mask & before <> 0), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (mask = bit), 0)::BIGINT AS unique_fails,
  coalesce(sum(good) FILTER (mask & bit <> 0 AND mask & before = 0), 0)::BIGINT AS good_lost, coalesce(sum(toxic) FILTER (mask & bit <> 0 AND mask & before = 0), 0)::BIGINT AS toxic_lost
  FROM cells, steps GROUP BY ALL)
SELECT * EXCLUDE (bit), sum(removed) OVER (PARTITION BY part, bit)::BIGINT AS shapley FROM counts
"""
