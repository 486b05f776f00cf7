"""Connected components of a link table, by rounds of joins over written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickerlake import session

MOST_ROUNDS = 100


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of a link; component is the smallest node reachable.

    links: two columns of one type, in any order and direction; self links, repeated and null links are allowed
    and tell nothing.  Every round takes the least label of a node's neighbours and then the label of that label,
    so that rounds grow with the logarithm of a component's width.  Labels are written to the shared folder after
    each round; a lost executor costs one round at most.  No links give an empty table.
    """
    a, b = links.columns
    both = links.select(F.col(a).alias("node"), F.col(b).alias("other")).where("node <> other")
    both = session.stage(both.unionByName(both.select(F.col("other").alias("node"), F.col("node").alias("other"))).distinct(), "links")
    labels = session.stage(both.groupBy("node").agg(F.least(F.col("node"), F.min("other")).alias("component")), "labels")
    for _ in range(MOST_ROUNDS):
        near = both.join(labels.select(F.col("node").alias("other"), F.col("component").alias("theirs")), "other").groupBy("node").agg(F.min("theirs").alias("theirs"))
        met = labels.join(near, "node").select("node", F.col("component").alias("was"), F.least("component", "theirs").alias("component"))
        jump = labels.select(F.col("node").alias("component"), F.col("component").alias("beyond"))
        after = session.stage(met.join(jump, "component", "left").select("node", "was", F.least("component", F.coalesce("beyond", "component")).alias("component")), "labels")
        labels = after.select("node", "component")
        if after.where("was <> component").isEmpty():
            return labels
    raise RuntimeError(f"no fixed point after {MOST_ROUNDS} rounds")
