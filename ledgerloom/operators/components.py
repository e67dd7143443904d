"""Chains, strong components and reachability on edge tables, in few rounds also where paths are long."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.steps import Rounds, whole_jobs


def _links(e: DataFrame) -> DataFrame:
    """(src, dst) of the edges that are the only one out of src and the only one into dst."""
    out = e.groupBy("src").agg(F.count("*").alias("n"), F.min("dst").alias("dst")).where("n = 1").select("src", "dst")
    into = e.groupBy("dst").agg(F.count("*").alias("n"), F.min("src").alias("src")).where("n = 1").select("src", "dst")
    return out.join(into, ["src", "dst"])


def chains(e: DataFrame) -> DataFrame:
    """(node, chain, place) of the nodes of edges (src, dst; distinct, no loops). A chain is a longest run of nodes that are each other's only successor and
    predecessor; it is named by its first node, a closed one by its least. Edges between chains leave from their last node and enter at their first.

    Pointers to predecessors are doubled each round, so the rounds are as many as the logarithm of the longest chain."""
    r = Rounds(e.sparkSession)
    one = r.save(_links(e))[0]
    # best: the least node met so far, and how far back it is; a closed chain is cut before its least node
    start = F.least(F.struct(F.col("dst").alias("least"), F.lit(0).cast("long").alias("back")), F.struct(F.col("src").alias("least"), F.lit(1).cast("long").alias("back")))
    state, left = r.save(one.select(F.col("dst").alias("node"), F.col("src").alias("at"), F.lit(1).cast("long").alias("far"), start.alias("best"), F.lit(True).alias("open")), "open")
    span, before = 1, -1
    while left and not (left == before and span >= left):
        further = state.select(F.col("node").alias("at"), F.col("at").alias("to"), F.col("far").alias("more"), F.col("best").alias("there"), F.col("open").alias("goes_on"))
        met = F.when(F.col("more").isNull(), F.col("best")).otherwise(F.least("best", F.struct(F.col("there.least").alias("least"), (F.col("there.back") + F.col("far")).alias("back"))))
        moved = state.join(further, "at", "left").select(
            "node",
            F.when(F.col("open"), F.coalesce("to", "at")).otherwise(F.col("at")).alias("at"),
            F.when(F.col("open"), F.col("far") + F.coalesce("more", F.lit(0))).otherwise(F.col("far")).alias("far"),
            F.when(F.col("open"), met).otherwise(F.col("best")).alias("best"),
            (F.col("open") & F.coalesce("goes_on", F.lit(False))).alias("open"),
        )
        before, span = left, 2 * span
        state, left = r.save(moved, "open")
        r.keep(state)
    inside = state.select("node", F.when(F.col("open"), F.col("best.least")).otherwise(F.col("at")).alias("chain"), F.when(F.col("open"), F.col("best.back")).otherwise(F.col("far")).alias("place"))
    ends = e.select(F.col("src").alias("node")).union(e.select(F.col("dst").alias("node"))).distinct()
    return ends.join(inside, "node", "left").select("node", F.coalesce("chain", "node").alias("chain"), F.coalesce("place", F.lit(0).cast("long")).alias("place"))


def between_chains(e: DataFrame, of: DataFrame) -> DataFrame:
    """(src, dst) of chains: the edges that leave a chain, also back to its own first node."""
    a = of.select(F.col("node").alias("src"), F.col("chain").alias("from"), F.col("place").alias("at"))
    b = of.select(F.col("node").alias("dst"), F.col("chain").alias("to"), F.col("place").alias("then"))
    inner = (F.col("from") == F.col("to")) & (F.col("then") == F.col("at") + 1)
    return e.join(a, "src").join(b, "dst").where(~inner).select(F.col("from").alias("src"), F.col("to").alias("dst")).distinct()


#: Share of the edges that a round of trimming must take away for another one to be worth it.
TRIMMED = 0.1


def _trimmed(r: Rounds, e: DataFrame, n: int) -> tuple[DataFrame, int]:
    """Edges (src, dst) without those of nodes that nothing leads to or that lead nowhere, round by round as long as many go."""
    while n:
        live = e.select(F.col("src").alias("node")).intersect(e.select(F.col("dst").alias("node")))
        rest, left = r.save(e.join(live.withColumnRenamed("node", "src"), "src", "left_semi").join(live.withColumnRenamed("node", "dst"), "dst", "left_semi").select("src", "dst"), "true")
        done, e, n = left > (1 - TRIMMED) * n, rest, left
        if done:
            break
    return e, n


def _least_around(r: Rounds, e: DataFrame, salt: int) -> DataFrame:
    """(node, up, down): of the nodes that lead to each node, and of those that it leads to, itself included, the first in an order by a salted hash. What a node's first node
    has found holds for the node as well, so labels jump, and rounds are about the logarithm of the longest path."""
    both = r.save(e.select(F.lit(0).alias("way"), F.col("src").alias("a"), F.col("dst").alias("b")).union(e.select(F.lit(1).alias("way"), F.col("dst").alias("a"), F.col("src").alias("b"))))[0]
    first = lambda c: F.struct(F.xxhash64(c, F.lit(salt)).alias("h"), F.col(c).alias("node"))
    state = r.save(both.select("way", F.col("a").alias("node")).union(both.select("way", F.col("b").alias("node"))).distinct().select("way", "node", first("node").alias("label")))[0]
    while True:
        met = both.join(state.withColumnRenamed("node", "a"), ["way", "a"]).groupBy("way", F.col("b").alias("node")).agg(F.min("label").alias("met"))
        near = state.join(met, ["way", "node"], "left").select("way", "node", "label", F.least("label", F.coalesce("met", "label")).alias("now"))
        jump = state.select("way", F.col("node").alias("over"), F.col("label").alias("far"))
        now = near.withColumn("over", F.col("now.node")).join(jump, ["way", "over"]).select("way", "node", F.least("now", "far").alias("new"), "label")
        state, moved = r.save(now.select("way", "node", F.col("new").alias("label"), (F.col("new") != F.col("label")).alias("moved")), "moved")
        state = state.drop("moved")
        if not moved:
            return state.groupBy("node").agg(F.max(F.when(F.col("way") == 0, F.col("label.node"))).alias("up"), F.max(F.when(F.col("way") == 1, F.col("label.node"))).alias("down"))


def _cyclic(e: DataFrame) -> DataFrame | None:
    """(node, least) of the nodes of edges that lie on a cycle with others: the least node of their strong component.

    Nodes that nothing leads to, or that lead nowhere, go first. Then each node learns the first node, in a random order, among those that lead to it and
    among those that it leads to. Where both are the same, that node's component is found; edges between nodes that learnt different ones lie in
    no component, so what remains falls apart and the next order is tried on it."""
    r = Rounds(e.sparkSession)
    e, n = r.save(e.where("src != dst"), "true")
    found, salt = None, 0
    while True:
        e, n = _trimmed(r, e, n)
        if not n:
            return found
        labels = r.save(_least_around(r, e, salt))[0]
        done = labels.where("up = down").select("node", "up")
        done = done.join(done.groupBy("up").agg(F.min("node").alias("least"), F.count("*").alias("n")).where("n > 1"), "up").select("node", "least")
        found = r.save(done if found is None else found.union(done))[0]
        a, b = (labels.select(F.col("node").alias(c), F.col("up").alias(f"{c}_up"), F.col("down").alias(f"{c}_down")) for c in ("src", "dst"))
        same = (F.col("src_up") == F.col("dst_up")) & (F.col("src_down") == F.col("dst_down")) & (F.col("src_up") != F.col("src_down"))
        e, n = r.save(e.join(a, "src").join(b, "dst").where(same).select("src", "dst"), "true")
        r.keep(found, e)
        salt += 1


def strong_components(edges: DataFrame) -> DataFrame:
    """(node, component) of each node of edges (src, dst): the least node among those that lead to it and that it leads to, itself included. Loops and
    repeated edges make no difference. Chains are contracted first, see chains, so a long cycle of only successors and predecessors is one edge."""
    spark, r = edges.sparkSession, Rounds(edges.sparkSession)
    with whole_jobs(spark):
        e = r.save(edges.select("src", "dst").where("src is not null and dst is not null").distinct())[0]
        plain = e.where("src != dst")
        of = r.save(chains(plain))[0]
        across = r.save(between_chains(plain, of))[0]
        closed = across.where("src = dst").select(F.col("src").alias("chain"), F.col("src").alias("with"))
        cyclic = _cyclic(across)
        groups = closed if cyclic is None else cyclic.select(F.col("node").alias("chain"), F.col("least").alias("with")).union(closed.join(cyclic, F.col("chain") == F.col("node"), "left_anti"))
        members = of.join(groups, "chain").select("node", "with")
        least = members.groupBy("with").agg(F.min("node").alias("component"))
        named = members.join(least, "with").select("node", "component")
        ends = e.select(F.col("src").alias("node")).union(e.select(F.col("dst").alias("node"))).distinct()
        out = r.save(ends.join(named, "node", "left").select("node", F.coalesce("component", "node").alias("component")))[0]
    r.keep(out)
    return out


#: Rounds after which what they found is put together into one table.
LAYERS = 8


def _least(layers: list[DataFrame]) -> DataFrame:
    out = layers[0]
    for more in layers[1:]:
        out = out.union(more)
    return out.groupBy("key", "seed", "chain").agg(F.min("dist").alias("dist")) if len(layers) > 1 else out


def reached(starts: DataFrame, edges: DataFrame) -> DataFrame:
    """(key, seed, node, hop): every node that the seed of each row of starts (key, seed) leads to along edges (src, dst; distinct), and its distance.

    Chains are contracted, so a round goes along a whole chain. Distances that are found too long at first, since a chain counts as one
    step, are lowered in later rounds. A round's findings are met with those of earlier ones, which are put together into one table every LAYERS rounds.
    """
    spark, r = edges.sparkSession, Rounds(edges.sparkSession)
    with whole_jobs(spark):
        e = r.save(edges.where("src != dst"))[0]
        of = r.save(chains(e))[0]
        sizes = of.groupBy("chain").agg(F.count("*").alias("size"))
        steps = r.save(between_chains(e, of).withColumnRenamed("src", "chain").join(sizes, "chain"))[0]
        r.keep(of, steps)
        own = starts.join(of.withColumnRenamed("node", "seed"), "seed", "left").select("key", "seed", F.coalesce("chain", "seed").alias("chain"), F.coalesce("place", F.lit(0).cast("long")).alias("place"))
        own = r.save(own)[0]
        # the distance of a chain's first node, of each key and chain but the chains that the seeds lie in themselves; a later layer may lower an earlier one's
        front, n = r.save(own.join(steps, "chain").groupBy("key", "seed", F.col("dst").alias("chain")).agg(F.min(F.col("size") - F.col("place")).alias("dist")), "true")
        layers = [front]
        while n:
            to = front.join(steps, "chain").groupBy("key", "seed", F.col("dst").alias("chain")).agg(F.min(F.col("dist") + F.col("size")).alias("dist"))
            old = _least(layers).select("key", "chain", F.col("dist").alias("was"))
            front, n = r.save(to.join(old, ["key", "chain"], "left").where("was is null or dist < was").select("key", "seed", "chain", "dist"), "true")
            layers.append(front)
            if len(layers) > LAYERS:
                layers = [r.save(_least(layers))[0]]
                r.keep(of, steps, own, front, *layers)
        known = _least(layers)
        inside = of.select("chain", "node", F.col("place").alias("at"))
        first = own.join(inside.where("at >= 0"), "chain").where("at >= place").select("key", "seed", "node", (F.col("at") - F.col("place")).alias("hop"))
        alone = own.join(of.select("chain").distinct(), "chain", "left_anti").select("key", "seed", F.col("seed").alias("node"), F.lit(0).cast("long").alias("hop"))
        others = known.join(inside, "chain").select("key", "seed", "node", (F.col("dist") + F.col("at")).alias("hop"))
        out = first.union(alone).union(others).groupBy("key", "seed", "node").agg(F.min("hop").cast("int").alias("hop"))
        out = r.save(out)[0]
    r.keep(out)
    return out
