"""Connected components of a link table, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node in links (a long, b long); root is the same member of the component for all its nodes.

    Each round every node points to the neighbour, or itself, of least hash; links are then redrawn between the nodes pointed to.
    Hash order is random, so a constant share of the nodes goes each round and long chains shrink as fast as stars. Nothing is
    gathered on the driver but a row count. The pointers of all rounds are composed at the end. Self-links and repeated
    links are allowed; rows with a null end are ignored. No links give no rows.
    """
    edges = saved(links.where("a != b").select("a", "b").distinct())
    rounds: list[DataFrame] = []
    while edges.take(1):
        both = edges.union(edges.select("b", "a"))
        pointed = both.groupBy(F.col("a").alias("node")).agg(F.min(F.struct(F.xxhash64("b").alias("h"), F.col("b").alias("id"))).alias("best"))
        own = F.struct(F.xxhash64("node").alias("h"), F.col("node").alias("id"))
        step = saved(pointed.select("node", F.least("best", own)["id"].alias("to")))
        rounds.append(step)
        redrawn = edges.join(step.select(F.col("node").alias("a"), F.col("to").alias("x")), "a").join(step.select(F.col("node").alias("b"), F.col("to").alias("y")), "b")
        edges = saved(redrawn.where("x != y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
    if not rounds:
        return links.sparkSession.createDataFrame([], "node long, root long")
    out = rounds[0].select("node", F.col("to").alias("root"))
    for step in rounds[1:]:
        out = out.join(step.select(F.col("node").alias("root"), "to"), "root", "left").select("node", F.coalesce("to", "root").alias("root"))
    return saved(out)
