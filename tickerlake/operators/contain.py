"""Texts that contain others, by equal pieces instead of comparing all pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters of a piece; needles with fewer are pieces themselves.
GRAM = 8
#: Pieces in a row of which one is kept, at most.
WINDOW = 64


def pieces(text: Column, short: list[int], window: int) -> Column:
    """Hashes of all stretches of the short sizes, and of each ``window`` pieces of GRAM characters in a row the least."""

    def of(n: int) -> Column:
        return F.transform(F.sequence(F.lit(1), F.length(text) - (n - 1)), lambda i: F.xxhash64(F.substring(text, i, F.lit(n))))

    def least(runs: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.size(runs) - (window - 1)), lambda i: F.array_min(F.slice(runs, i, window)))

    none = F.array().cast("array<bigint>")
    kept = F.when(F.length(text) >= GRAM + window - 1, F.flatten(F.transform(F.array(of(GRAM)), least))).otherwise(none)
    return F.array_distinct(F.concat(kept, *(F.when(F.length(text) >= n, of(n)).otherwise(none) for n in short)))


def containing(texts: DataFrame, text: str, needles: DataFrame, needle: str) -> DataFrame:
    """(text, *columns of needles) for every distinct text and every needle that it contains, at any place.

    A text that contains a needle contains all its pieces of GRAM characters, and of as many in a row as the shortest
    needle has it keeps the same one (the least hash) as the needle does.  A needle is looked up by the one of its kept
    pieces that fewest texts have, and found only where all occur at all; pairs that agree in this piece are verified.
    So a piece that all texts share is no key of the join unless a needle has nothing rarer.  Null texts and needles,
    and empty needles, match nothing.
    """
    own = needles.select(F.col(needle).alias("_needle")).where("_needle <> ''").distinct()
    size = F.length("_needle")
    sizes = own.agg(F.sort_array(F.collect_set(F.when(size < GRAM, size))).alias("short"), F.min(F.when(size >= GRAM, size)).alias("least")).head()  # GRAM numbers at most
    window = min(WINDOW, (sizes.least or GRAM) - GRAM + 1)
    keys = texts.select(F.col(text).alias("_text")).where("_text is not null").distinct()
    held = keys.select("_text", F.explode(pieces(F.col("_text"), sizes.short, window)).alias("_piece"))
    spread = held.groupBy("_piece").agg(F.count("*").alias("_n"))
    asked = F.when(size < GRAM, F.array(F.xxhash64("_needle"))).otherwise(pieces(F.col("_needle"), [], window))
    asked = own.select("_needle", asked.alias("_pieces")).select("_needle", F.size("_pieces").alias("_all"), F.explode("_pieces").alias("_piece"))
    found = asked.join(spread, "_piece").groupBy("_needle", "_all").agg(F.count("*").alias("_found"), F.min(F.struct("_n", "_piece")).alias("_least"))
    anchors = found.where("_found = _all").select("_needle", F.col("_least._piece").alias("_piece"))
    hits = held.join(anchors, "_piece").where(F.contains("_text", "_needle")).select(F.col("_text").alias(text), "_needle")
    return hits.join(needles, hits["_needle"] == needles[needle]).drop("_needle")
