"""Worked examples with answers made by hand (FIXTURES.md), invariants and literal plain-Python versions on random graphs."""

import random

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions.exprs import cut, parse_address_list, pct_rank_within
from ledgerloom.operators import addresses, features, ranking, reports, subnetworks
from ledgerloom.sources import tables

LABELS = [(i, "Illicit") for i in (1, 2, 3, 4, 5, 6, 8)] + [(7, "Licit"), (9, "Unknown")]
EDGES = [(1, 2), (1, 2), (1, 3), (2, 4), (3, 4), (4, 5), (6, 5), (5, 7), (7, 1), (9, 6), (8, 8)]


class Graph:
    def __init__(self, spark, edges, labels, max_hops=None, by_reach=True):
        self.labels = spark.createDataFrame(labels, "txId long, class_label string")
        self.edgelist = spark.createDataFrame(edges, "txId1 long, txId2 long")
        self.allowed = subnetworks.allowed_edges(self.edgelist, self.labels)
        self.seeds = subnetworks.number_seeds(self.labels)
        reached = subnetworks.reach(self.seeds, self.allowed, max_hops)
        self.nodes, self.edges = subnetworks.subnet_nodes(reached), subnetworks.subnet_edges(reached, self.allowed, max_hops)
        self.report = subnetworks.dedup_report(self.nodes, by_reach)
        kept = self.report.where("status = 'kept'").select(F.col("id").alias("subnetwork_id"))
        self.kn, self.ke = self.nodes.join(kept, "subnetwork_id", "left_semi"), self.edges.join(kept, "subnetwork_id", "left_semi")
        ids = subnetworks.merge_ids(self.kn)
        self.rn, self.re = subnetworks.retag(self.kn, ids), subnetworks.retag(self.ke, ids)
        self.fn, self.fe = subnetworks.collapse_nodes(self.rn).cache(), subnetworks.collapse_edges(self.re).cache()


@pytest.fixture(scope="module")
def g(spark):
    return Graph(spark, EDGES, LABELS)


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_reach_and_edges(spark, g):
    assert rows(g.allowed, "src", "dst") == [(1, 2), (1, 3), (2, 4), (3, 4), (4, 5), (6, 5), (8, 8)]
    one = g.nodes.where("seed_txn = 1")
    assert rows(one, "txn_id", "hop") == [(1, 0), (2, 1), (3, 1), (4, 2), (5, 3)] and g.edges.where("seed_txn = 1").count() == 5
    two = Graph(spark, EDGES, LABELS, 2, by_reach=False)
    assert rows(two.nodes.where("seed_txn = 1"), "txn_id") == [(1,), (2,), (3,), (4,)]
    assert rows(two.edges.where("seed_txn = 1"), "src_txn_id", "dst_txn_id") == [(1, 2), (1, 3), (2, 4), (3, 4)]


def test_dedup_and_merge(g):
    assert rows(g.report, "id", "size", "status", "kept_as") == [(0, 5, "kept", 0), (1, 3, "dropped_subset", 0), (2, 3, "dropped_subset", 0), (3, 2, "dropped_subset", 0), (4, 1, "dropped_subset", 0), (5, 2, "kept", 5), (6, 1, "kept", 6)]
    assert rows(subnetworks.relabel(g.report), "old_id", "new_id") == [(0, 0), (5, 1), (6, 2)]
    assert rows(subnetworks.merge_ids(g.kn), "subnetwork_id", "merged_subnetwork_id") == [(0, 0), (5, 0), (6, 6)]
    assert rows(subnetworks.merge_ids(g.kn, 2), "subnetwork_id", "merged_subnetwork_id") == [(0, 0), (5, 5), (6, 6)]
    assert rows(g.fn.where("merged_subnetwork_id = 0"), "txn_id", "min_hop") == [(1, 0), (2, 1), (3, 1), (4, 2), (5, 1), (6, 0)]
    assert rows(g.fe, "src_txn_id", "dst_txn_id", "min_src_hop", "min_dst_hop") == [(1, 2, 0, 1), (1, 3, 0, 1), (2, 4, 1, 2), (3, 4, 1, 2), (4, 5, 2, 3), (6, 5, 0, 1), (8, 8, 0, 0)]


def test_summaries_and_filters(spark, g):
    s = {r.merged_subnetwork_id: r for r in subnetworks.summarise(g.rn, g.re).collect()}
    assert (s[0].node_count, s[0].edge_count, s[0].depth, s[0].seeds, s[0].linked_txn_count) == (6, 6, 3, [1, 6], 4)
    assert {r.merged_subnetwork_id: r.depth for r in subnetworks.summarise(g.fn, g.fe).collect()}[0] == 2
    assert rows(subnetworks.size_report(g.fn, g.fe), "merged_subnetwork_id", "status") == [(0, "kept"), (6, "dropped_small")]
    peek = subnetworks.seed_edges(g.edgelist, g.labels, spark.createDataFrame([(5,)], "seed_txn long")).collect()
    assert [(r.txId1, r.txId2, r.src_label, r.dst_label, r.both_illicit) for r in peek] == [(5, 7, "Illicit", "Licit", False)]


def test_metrics(g):
    e = g.fe.where("merged_subnetwork_id = 0")
    assert rows(ranking.degrees(e), "node", "in_degree", "out_degree", "rank_inDeg", "rank_outDeg") == [(1, 0, 2, 3, 3), (2, 1, 1, 2, 2), (3, 1, 1, 2, 2), (4, 2, 1, 1, 2), (5, 2, 0, 1, 1), (6, 0, 1, 3, 2)]
    near = lambda df, c: {r.node: round(r[c], 6) for r in df.collect()}
    assert near(ranking.harmonic(e), "harmonic") == {1: 0, 2: 1, 3: 1, 4: 2.5, 5: 3.333333, 6: 0}
    assert near(ranking.betweenness(e), "betweenness") == {1: 0, 2: 0.05, 3: 0.05, 4: 0.15, 5: 0, 6: 0}
    assert near(ranking.matrix_metrics(e, ["coreness"]), "coreness") == {1: 2, 2: 2, 3: 2, 4: 2, 5: 1, 6: 1}
    want = {1: 0.076736, 2: 0.109349, 3: 0.109349, 4: 0.262630, 5: 0.365198, 6: 0.076736}
    assert near(ranking.pagerank(e), "pagerank") == pytest.approx(want, abs=2e-6)
    assert near(ranking.pagerank(e, group_edges=0), "pagerank") == near(ranking.pagerank(e), "pagerank")
    assert near(ranking.matrix_metrics(e, ["katz"]), "katz") == pytest.approx({1: 0.367565, 2: 0.404322, 3: 0.404322, 4: 0.448430, 5: 0.449165, 6: 0.367565}, abs=2e-6)
    assert near(ranking.matrix_metrics(e, ["eigenvector"]), "eigenvector") == pytest.approx({1: 0.408248, 2: 0.444037, 3: 0.444037, 4: 0.557678, 5: 0.325058, 6: 0.149429}, abs=2e-6)
    assert {r.coreness for r in ranking.matrix_metrics(g.fe.where("merged_subnetwork_id = 6"), ["coreness"]).collect()} == {0.0}
    assert {r.katz for r in ranking.matrix_metrics(e, ["katz"], limit=3).collect()} == {0.0}


def test_composite(spark, g):
    deg = {1: (0, 2), 2: (1, 1), 3: (1, 1), 4: (2, 1), 5: (2, 0), 6: (0, 1), 8: (1, 1)}
    btc = {1: 10.0, 2: 5.0, 3: 5.0, 4: 1.0, 5: None, 6: 20.0, 8: 3.0}
    f = spark.createDataFrame([(k, btc[k], *deg[k]) for k in deg], "txId long, in_BTC_total double, in_txs_degree long, out_txs_degree long")
    pr = ranking.complete_pagerank(ranking.pagerank(g.fe.where("merged_subnetwork_id = 0")), g.fn)
    got = {r.node: r for r in ranking.composite(f, pr, g.fn).collect()}
    want = {1: (0.4175, 5), 2: (0.578333, 3), 3: (0.578333, 3), 4: (0.676667, 2), 5: (0.739167, 1), 6: (0.48, 4), 8: (0.97, 1)}
    assert {k: (round(r.composite_raw, 6), r.composite_rank) for k, r in got.items()} == want
    assert round(got[1].in_btc_share, 6) == 0.243902
    with pytest.raises(ValueError):
        ranking.composite(f, pr, g.fn, {"pr": 0.5, "val": 0.4, "in": 0, "out": 0})
    with pytest.raises(ValueError):
        ranking.composite(f.drop("in_BTC_total"), pr, g.fn)


def test_scalars(spark):
    df = spark.createDataFrame([(1, 1.0), (1, 2.0), (1, 2.0), (1, None)], "k int, v double")
    assert [None if r.p is None else round(r.p, 6) for r in df.select("v", pct_rank_within("v", ["k"]).alias("p")).orderBy(F.asc_nulls_last("v")).collect()] == [0.333333, 0.833333, 0.833333, None]
    p = spark.createDataFrame([(x,) for x in (0.05, 0.1, 0.3, 0.95, 1.0)], "pred_proba double")
    edges = reports.edges_by_thresholds(0.05, 1.0, [0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0])
    assert [r.pred_bin for r in reports.with_bins(p, "pred_proba", edges).orderBy("pred_proba").collect()] == ["0.05-0.1", "0.1-0.2", "0.3-0.4", "0.9-1", None]
    d = spark.createDataFrame([(x,) for x in (0.0, 1.0, 2.0, 5.0, 6.0)], "v double").select(cut(F.col("v"), [0, 1, 2, 3, 4, float("inf")], ["1", "2", "3", "4", "5+"], right=True).alias("b"))
    assert [r.b for r in d.collect()] == ["1", "1", "2", "5+", "5+"]
    y = spark.createDataFrame([(0, 0.1), (0, 0.4), (1, 0.35), (1, 0.8)], "class int, pred_proba double")
    assert tuple(reports.auc(y).first()) == (0.75, 0.5)
    e = reports.final_evaluation(y.withColumn("pred_class", (F.col("pred_proba") >= 0.4).cast("int")), "x").first()
    assert (e.tp, e.tn, e.fp, e.fn, e.auc_hard) == (1, 1, 1, 1, 0.5)
    a = spark.createDataFrame([("a; b,c|a",), ("['x','y']",), ("",), (None,)], "t string").select(parse_address_list(F.col("t")).alias("l"))
    assert [r.l for r in a.collect()] == [["a", "b", "c", "a"], ["x", "y"], [], []]
    assert features.fold_windows(100, 100, 5) == [] and len(features.fold_windows(100, 10, 5)) == 5


@pytest.mark.parametrize("seed", range(3))
def test_random_graphs_against_plain_python(spark, seed):
    rng = random.Random(seed)
    n = 24
    labels = [(i, "Illicit" if rng.random() < 0.8 else "Licit") for i in range(n)]
    edges = [(rng.randrange(n), rng.randrange(n)) for _ in range(26)]
    ill = {i for i, x in labels if x == "Illicit"}
    out = {i: {b for a, b in edges if a == i and b in ill} for i in ill}

    def closure(u):
        seen, todo = {u}, [u]
        while todo:
            for v in out[todo.pop()] - seen:
                seen.add(v)
                todo.append(v)
        return seen

    sets = {k: closure(u) for k, u in enumerate(sorted(ill))}
    kept: list[int] = []
    kept_as = {}
    for k in sorted(sets, key=lambda k: (-len(sets[k]), k)):
        winner = next((j for j in kept if sets[j] >= sets[k]), None)
        kept_as[k] = k if winner is None else winner
        if winner is None:
            kept.append(k)
    merged = {k: k for k in kept}
    for _ in kept:
        for a in kept:
            for b in kept:
                if sets[a] & sets[b]:
                    merged[a] = merged[b] = min(merged[a], merged[b])
    for by_reach in (True, False):
        g = Graph(spark, edges, labels, by_reach=by_reach)
        assert {r.id: r.kept_as for r in g.report.collect()} == kept_as
    assert {r.subnetwork_id: r.merged_subnetwork_id for r in subnetworks.merge_ids(g.kn).collect()} == merged
    assert reports.txn_conflicts(g.fn).count() == 0


def test_empty_edges(spark):
    g = Graph(spark, [], LABELS)
    assert g.fe.count() == 0 and g.fn.count() == 7
    assert ranking.pagerank(g.fe).collect() == [] and ranking.degrees(g.fe).columns == ["merged_subnetwork_id", "node", "in_degree", "out_degree", "rank_inDeg", "rank_outDeg"]
    assert ranking.matrix_metrics(g.fe).collect() == [] and ranking.harmonic(g.fe).collect() == [] and ranking.min_hops(g.fe).collect() == []


def test_sinks_and_viz(spark, tmp_path, g):
    path = str(tmp_path / "t")
    tables.write_table(g.fn, path)
    tables.write_table(g.fn, path, overwrite=False)
    assert spark.read.parquet(path).count() == 2 * g.fn.count()
    assert tables.query(spark, "SELECT * FROM {t} WHERE txn_id = :x", {"x": 5}, t=g.fn).count() == 1
    assert rows(addresses.seed_txns(g.fe), "node") == [(1,), (6,), (8,)]
    nan = tables.nan_to_null(spark.createDataFrame([(float("nan"),), (1.0,)], "v double"))
    assert nan.where("v is null").count() == 1
