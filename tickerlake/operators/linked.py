"""Keys that links tie together."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickerlake import session

MOST_ROUNDS = 60


def groups(links: DataFrame) -> DataFrame:
    """(key, group) of every key of a link (two columns): the smallest key that it is tied to over any number of links.

    Each round every key takes the least group of its neighbours and then that group's own group, so that rounds grow
    with the logarithm of the longest chain.  Rounds are written tables; without links there is no round.
    """
    a, b = links.columns
    one = links.select(F.col(a).alias("key"), F.col(b).alias("other")).where("key <> other")
    both = session.stage(one.unionByName(one.select(F.col("other").alias("key"), F.col("key").alias("other"))).distinct(), "links")
    found = session.stage(both.groupBy("key").agg(F.least("key", F.min("other")).alias("group")), "groups")
    for _ in range(MOST_ROUNDS):
        theirs = both.join(found.select(F.col("key").alias("other"), F.col("group").alias("theirs")), "other").groupBy("key").agg(F.min("theirs").alias("theirs"))
        met = found.join(theirs, "key").select("key", F.col("group").alias("was"), F.least("group", "theirs").alias("group"))
        beyond = found.select(F.col("key").alias("group"), F.col("group").alias("beyond"))
        after = session.stage(met.join(beyond, "group", "left").select("key", "was", F.least("group", F.coalesce("beyond", "group")).alias("group")), "groups")
        found = after.select("key", "group")
        if after.where("was <> group").isEmpty():
            return found
    raise RuntimeError(f"links were not followed to their ends in {MOST_ROUNDS} rounds")
