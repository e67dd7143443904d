"""Label-restricted subnetworks: reachability from seeds, removal of redundant ones, merging of overlapping ones, summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.places import numbered
from ..sources.steps import Rounds, whole_jobs
from ..sources.tables import ILLICIT, saved
from .components import reached, strong_components


def allowed_edges(edges: DataFrame, labels: DataFrame, label_col: str = "class_label", value: str = ILLICIT, src: str = "txId1", dst: str = "txId2", id_col: str = "txId") -> DataFrame:
    """Distinct (src, dst) with both ends labelled value. The label check is made once, before any traversal."""
    ids = labels.where(F.col(label_col) == value).select(F.col(id_col).alias("_id"))
    out = edges.select(F.col(src).try_cast("long").alias("src"), F.col(dst).try_cast("long").alias("dst"))
    return out.join(ids, out["src"] == ids["_id"], "left_semi").join(ids, out["dst"] == ids["_id"], "left_semi").distinct()


def number_seeds(labels: DataFrame, label_col: str = "class_label", value: str = ILLICIT, id_col: str = "txId") -> DataFrame:
    """(subnetwork_id, seed_txn): seeds in order of id, from 0."""
    ids = labels.where(F.col(label_col) == value).select(F.col(id_col).alias("seed_txn"))
    return numbered(ids, ["seed_txn"], "subnetwork_id").select("subnetwork_id", "seed_txn")


def reach(seeds: DataFrame, allowed: DataFrame, max_hops: int | None = None) -> DataFrame:
    """(subnetwork_id, seed_txn, node, hop): every node reachable from each seed along allowed edges, and its distance. All seeds advance together: without a
    hop limit a whole chain of edges a round (see components.reached), with one a layer a round."""
    if max_hops is None:
        starts = seeds.select(F.col("subnetwork_id").alias("key"), F.col("seed_txn").alias("seed"))
        return reached(starts, allowed).select(F.col("key").alias("subnetwork_id"), F.col("seed").alias("seed_txn"), "node", "hop")
    spark, r = allowed.sparkSession, Rounds(allowed.sparkSession)
    with whole_jobs(spark):
        front, n = r.save(seeds.select("subnetwork_id", "seed_txn", F.col("seed_txn").alias("node"), F.lit(0).alias("hop")), "true")
        known = front
        for hop in range(1, max_hops + 1):
            step = front.join(allowed, front["node"] == allowed["src"]).select("subnetwork_id", "seed_txn", F.col("dst").alias("node"), F.lit(hop).alias("hop")).distinct()
            front, n = r.save(step.join(known.select("subnetwork_id", "node"), ["subnetwork_id", "node"], "left_anti").select(*known.columns), "true")
            if not n:
                break
            known = r.save(known.union(front))[0]
            r.keep(known, front)
    return known


def kept_seeds(seeds: DataFrame, allowed: DataFrame) -> DataFrame:
    """The seeds whose subnetworks dedup keeps where there is no hop limit and every node of allowed is a seed: the first of each strong component
    that no other one leads to. They are known without growing any subnetwork."""
    of = strong_components(allowed)
    a, b = of.select(F.col("node").alias("src"), F.col("component").alias("from")), of.select(F.col("node").alias("dst"), F.col("component").alias("to"))
    entered = allowed.join(a, "src").join(b, "dst").where(F.col("from") != F.col("to")).select(F.col("to").alias("component")).distinct()
    named = seeds.join(of.withColumnRenamed("node", "seed_txn"), "seed_txn", "left").select("subnetwork_id", "seed_txn", F.coalesce("component", "seed_txn").alias("component"))
    first = named.join(entered, "component", "left_anti").groupBy("component").agg(F.min(F.struct("subnetwork_id", "seed_txn")).alias("s"))
    return saved(first.select("s.subnetwork_id", "s.seed_txn"))


def subnet_nodes(reached: DataFrame) -> DataFrame:
    return reached.select(F.col("node").alias("txn_id"), "hop", "subnetwork_id", "seed_txn")


def subnet_edges(reached: DataFrame, allowed: DataFrame, max_hops: int | None = None) -> DataFrame:
    """Allowed edges that leave an expanded node of a subnetwork, with the hops of both ends in that subnetwork."""
    a = reached.select("subnetwork_id", "seed_txn", F.col("node").alias("src"), F.col("hop").alias("src_txn_hop"))
    if max_hops is not None:
        a = a.where(F.col("src_txn_hop") < max_hops)
    b = reached.select("subnetwork_id", F.col("node").alias("dst"), F.col("hop").alias("dst_txn_hop"))
    rows = a.join(allowed, "src").join(b, ["subnetwork_id", "dst"])
    return rows.select(F.col("src").alias("src_txn_id"), F.col("dst").alias("dst_txn_id"), "src_txn_hop", "dst_txn_hop", "subnetwork_id", "seed_txn")


def seed_summary(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Of each subnetwork: nodes, edges, max_hop and bucket."""
    n = nodes.groupBy("subnetwork_id", "seed_txn").agg(F.count("*").alias("nodes"), F.max("hop").alias("max_hop"))
    e = edges.groupBy("subnetwork_id").agg(F.count("*").alias("edges"))
    return n.join(e, "subnetwork_id", "left").select("subnetwork_id", "seed_txn", "nodes", F.coalesce("edges", F.lit(0)).alias("edges"), "max_hop", F.when(F.col("nodes") <= 1, "single node network").otherwise("multi-node network").alias("bucket"))


def _holders(nodes: DataFrame, sizes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(twins, holds) of sets of nodes (id, txn_id): (id, first) of those equal to an earlier one, and (id, size, o_id, o_size) of all pairs of the others
    in which o_id holds all nodes of id.

    A set that holds another one also holds its rarest node, so sets are met there only; nodes that many sets have are rarely the rarest of one. A pair
    must also pass the sizes and 63 bits in which a node marks one, before its nodes are compared. Equal sets are found by two hashes and compared too."""
    often = nodes.groupBy("txn_id").agg(F.count("*").alias("n"))
    bit = F.expr("shiftleft(1L, cast(pmod(xxhash64(txn_id), 63) AS int))")
    marks = [F.min(F.struct("n", "txn_id")).alias("rarest"), F.bit_or(bit).alias("bits"), F.bit_xor(F.xxhash64("txn_id", F.lit(1))).alias("x"), F.bit_xor(F.xxhash64("txn_id", F.lit(2))).alias("y")]
    sets = saved(nodes.join(often, "txn_id").groupBy("id").agg(*marks).join(sizes, "id").select("id", "size", "rarest.txn_id", "bits", "x", "y"))

    def shared(pairs: DataFrame) -> DataFrame:
        """The pairs (id, size, o_id) of which o_id has all nodes of id."""
        inside = pairs.join(nodes, "id").join(nodes.select(F.col("id").alias("o_id"), "txn_id"), ["o_id", "txn_id"])
        return inside.groupBy("id", "size", "o_id").agg(F.count("*").alias("n")).where("n = size").select("id", "size", "o_id")

    first = sets.groupBy("size", "x", "y").agg(F.min("id").alias("o_id"))
    twins = saved(shared(sets.join(first, ["size", "x", "y"]).where("id != o_id").select("id", "size", "o_id")).select("id", F.col("o_id").alias("first")))
    own = sets.join(twins, "id", "left_anti")
    larger = own.select(F.col("id").alias("o_id"), F.col("size").alias("o_size"), F.col("bits").alias("o_bits"))
    met = own.join(nodes.select(F.col("id").alias("o_id"), "txn_id"), "txn_id").join(larger, "o_id").where("o_size > size and (bits & ~o_bits) = 0")
    return twins, saved(shared(met.select("id", "size", "o_id")).join(larger.select("o_id", "o_size"), "o_id"))


def dedup_report(nodes: DataFrame, by_reach: bool = True) -> DataFrame:
    """id, size, seed, status (kept or dropped_subset) and kept_as. Subnetworks in order of size (largest first), then id; one goes where an
    earlier one holds all its nodes. kept_as: itself, or the first kept one that holds it.

    by_reach: the nodes are everything that each seed reaches; then one holds another exactly if it holds its seed, and one join on that node
    is enough. Otherwise (a hop limit) sets are compared where they may hold each other, see _holders."""
    sizes = nodes.groupBy(F.col("subnetwork_id").alias("id"), F.col("seed_txn").alias("seed")).agg(F.count("*").alias("size"))
    if by_reach:
        outer = sizes.select(F.col("id").alias("o_id"), F.col("size").alias("o_size"))
        holds = sizes.join(nodes.select(F.col("subnetwork_id").alias("o_id"), F.col("txn_id").alias("seed")), "seed").select("id", "size", "o_id")
        earlier = holds.join(outer, "o_id").where("o_id != id and (o_size > size or (o_size = size and o_id < id))")
    else:
        sizes = saved(sizes)
        twins, earlier = _holders(saved(nodes.select(F.col("subnetwork_id").alias("id"), "txn_id")), sizes.select("id", "size"))
        as_first = twins.join(earlier.withColumnRenamed("id", "first"), "first").select("id", "size", "o_id", "o_size")
        itself = twins.join(sizes, "id").select("id", "size", F.col("first").alias("o_id"), F.col("size").alias("o_size"))
        earlier = earlier.select("id", "size", "o_id", "o_size").union(as_first).union(itself)
    dropped = earlier.select("id").distinct()
    kept = sizes.join(dropped, "id", "left_anti")
    winner = earlier.join(kept.select(F.col("id").alias("o_id")), "o_id", "left_semi").groupBy("id").agg(F.min(F.struct((-F.col("o_size")).alias("s"), F.col("o_id").alias("o"))).alias("w"))
    return sizes.join(winner, "id", "left").select("id", "size", "seed", F.when(F.col("w").isNull(), "kept").otherwise("dropped_subset").alias("status"), F.coalesce(F.col("w.o"), F.col("id")).alias("kept_as"))


def relabel(report: DataFrame, order: str = "id") -> DataFrame:
    """(old_id, new_id) of the kept ones, counted from 0 by id."""
    return numbered(report.where("status = 'kept'").select(F.col(order).alias("old_id")), ["old_id"], "new_id").select("old_id", "new_id")


def components(links: DataFrame) -> DataFrame:
    """(node, least): the least node of the component of each node of links (a, b). Each round a node takes the least label around it, then
    labels jump to their own label, which shortens long chains by half or more."""
    spark, r = links.sparkSession, Rounds(links.sparkSession)
    links = saved(links)
    with whole_jobs(spark):
        both = r.save(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a != b").distinct())[0]
        label, moved = r.save(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("least")), "true")
        while moved:
            around = both.join(label.select(F.col("node").alias("b"), "least"), "b").groupBy(F.col("a").alias("node")).agg(F.min("least").alias("around"))
            near = label.join(around, "node").select("node", "least", F.least("least", "around").alias("now"))
            jump = label.select(F.col("node").alias("now"), F.col("least").alias("far"))
            new = near.join(jump, "now", "left").select("node", F.coalesce(F.least("now", "far"), "now").alias("new"), F.col("least").alias("old"))
            table, moved = r.save(new, "new != old")
            r.keep(both, table)
            label = table.select("node", F.col("new").alias("least"))
    return label


#: Subnetworks at a node up to which they are met pair by pair there.
HUB = 200


def overlap_links(held: DataFrame, min_shared: int, hub: int = HUB) -> DataFrame:
    """(a, b) that join the sets (subnetwork_id, txn_id; distinct) which share at least min_shared nodes, directly or through others; not all such pairs.

    With nodes in order of frequency, two such sets share one that is not among the min_shared - 1 most frequent of either. They are met at such nodes
    only, rare ones first, and their shared nodes counted. At a node that more than hub sets are met at, no pairs are made: its sets,
    with the nodes that come after it in that order, are joined among themselves for one shared node less, down to one, where all sets at a node are linked to the
    first of them."""
    return _overlaps(held.select(F.lit("").alias("at"), F.col("subnetwork_id").alias("s"), "txn_id"), min_shared, hub)


def _overlaps(held: DataFrame, k: int, hub: int) -> DataFrame:
    if k <= 1:
        least = held.groupBy("at", "txn_id").agg(F.min("s").alias("a"))
        return held.join(least, ["at", "txn_id"]).select("a", F.col("s").alias("b")).where("a != b").distinct()
    often = held.groupBy("at", "txn_id").agg(F.count("*").alias("n")).where("n > 1")  # a node of one set is shared by none
    rows = saved(held.join(often, ["at", "txn_id"]).select("at", "s", F.struct("n", "txn_id").alias("node")))
    met = rows
    for _ in range(k - 1):
        met = met.join(met.groupBy("at", "s").agg(F.max("node").alias("node")), ["at", "s", "node"], "left_anti")
    met = saved(met)
    many = saved(met.groupBy("at", "node").agg(F.count("*").alias("sets")).where("sets > 1"))
    few = met.join(many.where(F.col("sets") <= hub), ["at", "node"], "left_semi")
    pairs = few.select("at", F.col("s").alias("a"), "node").join(few.select("at", F.col("s").alias("b"), "node"), ["at", "node"]).where("a < b").select("at", "a", "b").distinct()
    both = pairs.join(rows.withColumnRenamed("s", "a"), ["at", "a"]).join(rows.withColumnRenamed("s", "b"), ["at", "b", "node"])
    links = both.groupBy("at", "a", "b").agg(F.count("*").alias("n")).where(F.col("n") >= k).select("a", "b").distinct()
    hubs = many.where(F.col("sets") > hub).select("at", "node")
    if not hubs.take(1):
        return links
    there = met.join(hubs, ["at", "node"], "left_semi").select("at", "s", F.col("node").alias("hub"))
    after = there.join(rows, ["at", "s"]).where("node > hub").select(F.concat_ws("/", "at", F.col("hub.txn_id").cast("string")).alias("at"), "s", F.col("node.txn_id").alias("txn_id"))
    return links.union(_overlaps(after, k - 1, hub)).distinct()


def merge_ids(nodes: DataFrame, min_shared: int = 1) -> DataFrame:
    """(subnetwork_id, merged_subnetwork_id): subnetworks that share at least min_shared nodes, directly or through others, are merged
    under their least id."""
    held = nodes.select("subnetwork_id", "txn_id")
    found = components(overlap_links(held, min_shared))
    ids = held.select("subnetwork_id").distinct()
    return ids.join(found, ids["subnetwork_id"] == found["node"], "left").select("subnetwork_id", F.coalesce("least", "subnetwork_id").alias("merged_subnetwork_id"))


def retag(df: DataFrame, merged: DataFrame) -> DataFrame:
    return df.join(merged, "subnetwork_id")


def group_seeds(retagged: DataFrame) -> DataFrame:
    """Distinct (group, seed_txn): the long form of seeds_in_group. A subnetwork has one row of its seed, so few rows are shuffled."""
    return retagged.where("txn_id = seed_txn").select("merged_subnetwork_id", "seed_txn").distinct()


#: Nodes of a group that get their list of seeds in one task, about.
SLICE_NODES = 1000


def collapse_nodes(retagged: DataFrame) -> DataFrame:
    """(group, txn_id, min_hop, seeds_in_group): the sorted distinct seeds of the whole merged group, the same list on each of its nodes. Large groups
    are cut into slices, and slices are dealt to a fixed number of partitions: repeated lists are few bytes when packed, so
    adaptive execution would put all of them into one task."""
    keys = ["merged_subnetwork_id", "_slice"]
    parts = int(retagged.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    seeds = group_seeds(retagged).groupBy("merged_subnetwork_id").agg(F.array_sort(F.collect_list("seed_txn")).alias("seeds_in_group"))
    least = saved(retagged.groupBy("merged_subnetwork_id", "txn_id").agg(F.min("hop").alias("min_hop")))
    slices = least.groupBy("merged_subnetwork_id").agg(F.ceil(F.count("*") / SLICE_NODES).alias("_slices"))
    lists = seeds.join(slices, "merged_subnetwork_id").withColumn("_slice", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_slices") - 1)))
    nodes = least.join(slices, "merged_subnetwork_id").withColumn("_slice", F.pmod(F.xxhash64("txn_id"), F.col("_slices")))
    dealt = nodes.drop("_slices").repartition(parts, *keys).join(lists.drop("_slices").repartition(parts, *keys), keys)
    return dealt.select("merged_subnetwork_id", "txn_id", "min_hop", "seeds_in_group")


def collapse_edges(retagged: DataFrame) -> DataFrame:
    return retagged.groupBy("merged_subnetwork_id", "src_txn_id", "dst_txn_id").agg(F.min("src_txn_hop").alias("min_src_hop"), F.min("dst_txn_hop").alias("min_dst_hop"))


def size_report(nodes: DataFrame, edges: DataFrame, min_nodes: int = 2, min_edges: int | None = None, id_col: str = "merged_subnetwork_id") -> DataFrame:
    """Of each group: node_count (distinct), edge_count (rows), status (kept or dropped_small) and kept_as."""
    n = nodes.groupBy(id_col).agg(F.countDistinct("txn_id").alias("node_count"))
    e = edges.groupBy(id_col).agg(F.count("*").alias("edge_count"))
    ok = F.col("node_count") >= min_nodes
    if min_edges is not None:
        ok = ok & (F.coalesce("edge_count", F.lit(0)) >= min_edges) & F.col("edge_count").isNotNull()
    return n.join(e, id_col, "left").select(id_col, "node_count", F.coalesce("edge_count", F.lit(0)).alias("edge_count"), F.when(ok, "kept").otherwise("dropped_small").alias("status"), F.when(ok, F.col(id_col)).alias("kept_as"))


def filter_small(df: DataFrame, report: DataFrame, id_col: str = "merged_subnetwork_id", new_ids: DataFrame | None = None) -> DataFrame:
    """Rows of the kept groups; new_ids (old_id, new_id, see relabel) renumbers them."""
    if new_ids is None:
        return df.join(report.where("status = 'kept'").select(id_col), id_col, "left_semi")
    names = [F.col("new_id").alias(c) if c == id_col else F.col(c) for c in df.columns]
    return df.join(new_ids, df[id_col] == new_ids["old_id"]).select(*names)


def summarise(nodes: DataFrame, edges: DataFrame, id_col: str = "merged_subnetwork_id") -> DataFrame:
    """Of each group: txn_ids, node_count, edge_count (rows), depth, seeds, seed_count, linked_txn_count. Takes retagged rows (seed_txn, hop) or
    collapsed ones (seeds_in_group, min_hop)."""
    flat = "seeds_in_group" in nodes.columns
    seeds = F.first("seeds_in_group") if flat else F.array_sort(F.collect_set(F.when(F.col("txn_id") == F.col("seed_txn"), F.col("seed_txn"))))
    n = nodes.groupBy(id_col).agg(F.array_sort(F.collect_set("txn_id")).alias("txn_ids"), F.max("min_hop" if flat else "hop").alias("depth"), seeds.alias("seeds"))
    e = edges.groupBy(id_col).agg(F.count("*").alias("edge_count"))
    return n.join(e, id_col, "left").select(
        id_col, "txn_ids", F.size("txn_ids").cast("long").alias("node_count"), F.coalesce("edge_count", F.lit(0)).alias("edge_count"), "depth", "seeds",
        F.size("seeds").cast("long").alias("seed_count"), (F.size("txn_ids") - F.size("seeds")).cast("long").alias("linked_txn_count"),
    )


def seed_edges(edges: DataFrame, labels: DataFrame, seeds: DataFrame, label_col: str = "class_label") -> DataFrame:
    """Out-edges of the seeds (seed_txn) with the labels of both ends and both_illicit."""
    s, d = labels.select(F.col("txId").alias("txId1"), F.col(label_col).alias("src_label")), labels.select(F.col("txId").alias("txId2"), F.col(label_col).alias("dst_label"))
    rows = edges.join(seeds.select(F.col("seed_txn").alias("txId1")), "txId1", "left_semi").join(s, "txId1", "left").join(d, "txId2", "left")
    return rows.select("txId1", "txId2", "src_label", "dst_label", F.coalesce((F.col("src_label") == ILLICIT) & (F.col("dst_label") == ILLICIT), F.lit(False)).alias("both_illicit"))
