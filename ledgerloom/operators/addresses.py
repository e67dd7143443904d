"""Address projections, transaction summaries, drawing tables and dashboard figures, for all groups at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import parse_address_list
from ..functions.places import GROUP_ROWS, large_groups, with_places
from ..sources.tables import saved
from .ranking import GROUP


def _sides(nodes: DataFrame, addr_txn: DataFrame, txn_addr: DataFrame) -> tuple[DataFrame, DataFrame]:
    """addr_txn and txn_addr of the transactions in nodes. All others go before an address is grouped, sorted or sent anywhere."""
    ids = nodes.select(F.col("node").alias("txId")).distinct()
    return addr_txn.join(ids, "txId", "left_semi"), txn_addr.join(ids, "txId", "left_semi")


def projection(nodes: DataFrame, addr_txn: DataFrame, txn_addr: DataFrame) -> DataFrame:
    """(group, input_address, output_address, weight): weight counts the transactions of the group between the two."""
    n = nodes.select(GROUP, F.col("node").alias("txId"))
    return n.join(addr_txn, "txId").join(txn_addr, "txId").groupBy(GROUP, "input_address", "output_address").agg(F.count("*").alias("weight"))


def scaled(value: str, low: float, high: float) -> Column:
    """value (null as 0) scaled within its group to [low, high]; the middle where the group has one value only."""
    v, w = F.coalesce(F.col(value).cast("double"), F.lit(0.0)), Window.partitionBy(GROUP)
    return F.coalesce(low + (v - F.min(v).over(w)) * (high - low) / F.nullif(F.max(v).over(w) - F.min(v).over(w), F.lit(0.0)), F.lit((low + high) / 2))


def seed_txns(edges: DataFrame) -> DataFrame:
    """(group, node) of the ends of edges that have hop 0."""
    src = "min_src_hop" if "min_src_hop" in edges.columns else "min_scr_hop"
    a = edges.where(F.col(src) == 0).select(GROUP, F.col("src_txn_id").alias("node"))
    return a.union(edges.where("min_dst_hop = 0").select(GROUP, F.col("dst_txn_id").alias("node"))).distinct()


def address_metrics(ranks: DataFrame, edges: DataFrame, addr_txn: DataFrame, txn_addr: DataFrame, agg: str = "sum", low: float = 100.0, high: float = 900.0, top_n: int = 10, other: float = 60.0, uniform: bool = False, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Of each address of a group's projection: final_rank (least composite rank of its transactions), is_seed, pagerank (sum, mean or max over
    its transactions), strength (weighted in- and out-degree), size: scaled pagerank for the group's top_n addresses, other for the rest. Ranks
    without a pagerank column are sized by strength; uniform gives every address the size other. Groups of more than group_rows addresses are
    ordered by ranges."""
    addr_txn, txn_addr = (saved(side) for side in _sides(ranks, addr_txn, txn_addr))
    txns = addr_txn.select(F.col("input_address").alias("address"), "txId").union(txn_addr.select(F.col("output_address").alias("address"), "txId")).distinct()
    known = "pagerank" in ranks.columns
    r = ranks.select(GROUP, F.col("node").alias("txId"), "composite_rank", (F.round("pagerank", 9) if known else F.lit(None).cast("double")).alias("pagerank"))
    seeds = seed_txns(edges).select(GROUP, F.col("node").alias("txId"), F.lit(True).alias("s"))
    how = {"sum": F.sum, "mean": F.avg, "max": F.max}[agg]
    own = r.join(txns, "txId").join(seeds, [GROUP, "txId"], "left").groupBy(GROUP, "address").agg(F.min("composite_rank").alias("final_rank"), F.max(F.coalesce("s", F.lit(False))).alias("is_seed"), F.round(F.coalesce(how("pagerank"), F.lit(0.0)), 9).alias("pagerank"))
    p = projection(ranks, addr_txn, txn_addr)
    strength = p.select(GROUP, F.col("input_address").alias("address"), "weight").union(p.select(GROUP, F.col("output_address").alias("address"), "weight")).groupBy(GROUP, "address").agg(F.sum("weight").alias("strength"))
    out = strength.join(own, [GROUP, "address"], "left")
    by = "pagerank" if known else "strength"
    if uniform:
        return out.withColumn("size", F.lit(float(other)))
    out = saved(out)
    v = F.coalesce(F.col(by).cast("double"), F.lit(0.0))
    ends = out.groupBy(GROUP).agg(F.min(v).alias("_low"), F.max(v).alias("_high"))
    placed = with_places(out, [GROUP], [F.desc(by), F.asc("address")], "_place", large_groups(out, [GROUP], group_rows)).join(ends, GROUP)
    size = F.coalesce(low + (v - F.col("_low")) * (high - low) / F.nullif(F.col("_high") - F.col("_low"), F.lit(0.0)), F.lit((low + high) / 2))
    return placed.withColumn("size", F.when(F.col("_place") < top_n, size).otherwise(other)).select(*out.columns, "size")


def txn_summary(ranks: DataFrame, addr_txn: DataFrame, txn_addr: DataFrame, join_text: bool = True, sep: str = "; ") -> DataFrame:
    """Each ranked transaction with its sorted distinct addresses on both sides and their number, illicit_flag, seed_flag (hop 0, where ranks
    have min_hop) and investigation_order."""
    addr_txn, txn_addr = _sides(ranks, addr_txn, txn_addr)
    a = addr_txn.groupBy("txId").agg(F.array_sort(F.collect_set("input_address")).alias("input_addresses"))
    b = txn_addr.groupBy("txId").agg(F.array_sort(F.collect_set("output_address")).alias("output_addresses"))
    both = a.join(b, "txId", "full").withColumnRenamed("txId", "node")
    seed = F.coalesce(F.col("min_hop") == 0, F.lit(False)) if "min_hop" in ranks.columns else F.lit(False)
    empty = F.array().cast("array<string>")
    rows = ranks.join(both, "node", "left").withColumns({"input_addresses": F.coalesce("input_addresses", empty), "output_addresses": F.coalesce("output_addresses", empty)})
    shown = (lambda c: F.array_join(c, sep)) if join_text else F.col
    return rows.select(
        F.col(GROUP).alias("subnetwork_id"), F.col("node").alias("txn_id"), F.lit(True).alias("illicit_flag"), seed.alias("seed_flag"), F.col("composite_rank").alias("investigation_order"), "in_BTC_total", "composite_raw",
        shown("input_addresses").alias("input_addresses"), shown("output_addresses").alias("output_addresses"), F.size("input_addresses").cast("long").alias("n_inputs"), F.size("output_addresses").cast("long").alias("n_outputs"),
    )


def _first_of(ranks: DataFrame, *names: str) -> str | None:
    return next((n for n in names if n in ranks.columns), None)


def viz_edges(edges: DataFrame) -> DataFrame:
    """Distinct edges of the drawn graph with the seed flags of both ends; rows with a null end are left out."""
    seeds = seed_txns(edges)
    a = seeds.select(GROUP, F.col("node").alias("src_txn_id"), F.lit(True).alias("src_is_seed"))
    b = seeds.select(GROUP, F.col("node").alias("dst_txn_id"), F.lit(True).alias("dst_is_seed"))
    rows = edges.where("src_txn_id is not null and dst_txn_id is not null").select(GROUP, "src_txn_id", "dst_txn_id").distinct()
    rows = rows.join(a, [GROUP, "src_txn_id"], "left").join(b, [GROUP, "dst_txn_id"], "left")
    return rows.select(GROUP, "src_txn_id", "dst_txn_id", F.coalesce("src_is_seed", F.lit(False)).alias("src_is_seed"), F.coalesce("dst_is_seed", F.lit(False)).alias("dst_is_seed"))


def viz_nodes(ranks: DataFrame, edges: DataFrame, size_by: str | None = None, low: float = 100.0, high: float = 900.0) -> DataFrame:
    """Nodes of the drawn graph (the ends of edges) with is_seed and size. Size follows size_by, or the first that ranks has of composite_raw, pagerank
    and node_score; without any all sizes are the middle."""
    size_by = size_by or _first_of(ranks, "composite_raw", "pagerank", "node_score")
    if size_by is None:
        size_by, ranks = "_none", ranks.withColumn("_none", F.lit(0.0))
    ends = edges.select(GROUP, F.col("src_txn_id").alias("node")).union(edges.select(GROUP, F.col("dst_txn_id").alias("node"))).distinct()
    seeds = seed_txns(edges).withColumn("is_seed", F.lit(True))
    rows = ends.join(ranks.select(GROUP, "node", F.round(size_by, 9).alias(size_by)), [GROUP, "node"], "left").join(seeds, [GROUP, "node"], "left")
    return rows.select(GROUP, "node", F.coalesce("is_seed", F.lit(False)).alias("is_seed"), scaled(size_by, low, high).alias("size"))


def top_labels(ranks: DataFrame, label_by: str | None = None, n: int = 3) -> DataFrame:
    """The n nodes of each group to label: ranks ascending with null last, other metrics descending with null as 0; ties by node. By label_by, or
    the first that ranks has of composite_rank, pr_rank and pagerank; without any, by node."""
    label_by = label_by or _first_of(ranks, "composite_rank", "pr_rank", "pagerank")
    if label_by is None:
        label_by, ranks = "_none", ranks.withColumn("_none", F.lit(0.0))
    order = F.col(label_by).asc_nulls_last() if "rank" in label_by else F.round(F.coalesce(F.col(label_by), F.lit(0.0)), 9).desc()
    return ranks.withColumn("label_place", F.row_number().over(Window.partitionBy(GROUP).orderBy(order, "node"))).where(F.col("label_place") <= n).select(GROUP, "node", F.col("label_place").cast("long").alias("label_place"))


def edge_class_labels(edges: DataFrame, labels: DataFrame, predicted: DataFrame) -> DataFrame:
    """Each edge with the class label and the predicted label of both ends."""
    out = edges
    for df, col in ((labels, "class_label"), (predicted, "pred_class_label")):
        for end, name in (("txId1", "src"), ("txId2", "dst")):
            out = out.join(df.select(F.col("txId").alias(end), F.col(col).alias(f"{name}_{col}")), end, "left")
    return out


def dashboard(summary: DataFrame, by_group: bool = False) -> DataFrame:
    """Networks, transactions, unique senders and receivers: over all, or of each subnetwork. Address texts are parsed and counted."""
    keys = ["subnetwork_id"] if by_group else []
    base = summary.groupBy(*keys).agg(F.countDistinct("subnetwork_id").alias("networks"), F.countDistinct("txn_id").alias("transactions"))
    for side, name in (("input_addresses", "senders"), ("output_addresses", "receivers")):
        seen = summary.select(*keys, F.explode(parse_address_list(F.col(side))).alias("_a")).groupBy(*keys).agg(F.countDistinct("_a").alias(name))
        base = base.join(seen, keys, "left") if keys else base.crossJoin(F.broadcast(seen))
    return base.na.fill(0, ["senders", "receivers"])


def lookup(summary: DataFrame, subnetwork_id: int) -> DataFrame:
    """The rows of one subnetwork. On a written summary the filter reaches its scan."""
    return summary.where(F.col("subnetwork_id") == subnetwork_id)
