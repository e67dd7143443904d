"""Groups of any size get their matrix metrics."""

import math
import random
import statistics

import numpy as np
import pytest

from ledgerloom.operators import models, ranking

NAMES = ["hub", "authority", "eigenvector", "katz", "coreness"]


def frame(spark, edges, group=1):
    return spark.createDataFrame([(group, a, b) for a, b in edges], "merged_subnetwork_id long, src_txn_id long, dst_txn_id long")


def test_a_group_over_2000_nodes_has_metrics(spark):
    n, rng = 2_500, random.Random(1)
    edges = {(rng.randrange(i), i) for i in range(1, n)} | {(rng.randrange(40), rng.randrange(40, n)) for _ in range(800)} | {(a, b) for a in range(5) for b in range(a + 1, 5)}
    got = {r.node: r for r in ranking.matrix_metrics(frame(spark, edges), NAMES).collect()}
    a = np.zeros((n, n))
    for s, d in edges:
        a[s, d] = 1
    katz = np.linalg.solve(np.eye(n) - 0.1 * a.T, np.ones(n))
    value, vector = np.linalg.eigh(np.maximum(a, a.T))
    _, _, v = np.linalg.svd(a)
    for name, want in (("katz", katz / np.linalg.norm(katz)), ("eigenvector", np.abs(vector[:, -1])), ("authority", np.abs(v[0]) / np.abs(v[0]).sum())):
        assert np.allclose([got[i][name] for i in range(n)], want, atol=1e-6), name
    u = {i: set() for i in range(n)}
    for s, d in edges:
        u[s].add(d)
        u[d].add(s)
    core, k, alive = {}, 0, set(u)
    while alive:
        v = min(alive, key=lambda i: len(u[i] & alive))
        k = max(k, len(u[v] & alive))
        core[v] = k
        alive.remove(v)
    assert {i: got[i].coreness for i in range(n)} == core
    assert len({got[i].rank_katz for i in range(n)}) > 1


def test_groups_that_are_not_gathered_get_the_same(spark):
    """The series of Katz diverges in the first group; the second one is gathered."""
    e = frame(spark, [(a, b) for a in range(14) for b in range(14) if a != b] + [(0, 20), (20, 21)]).union(frame(spark, [(5, 5), (5, 6), (6, 7)], 2))
    plain = lambda df: {(r.merged_subnetwork_id, r.node): [r[k] for k in NAMES] for r in df.collect()}
    near, far = plain(ranking.matrix_metrics(e, NAMES)), plain(ranking.matrix_metrics(e, NAMES, group_edges=5))
    assert near.keys() == far.keys() and all(far[k] == pytest.approx(near[k], abs=1e-9) for k in near)


def close(a, b):
    return a.keys() == b.keys() and all(a[k] == pytest.approx(b[k], abs=1e-12) for k in a)


def test_weights_of_groups_in_windows_and_by_ranges(spark):
    rng = random.Random(11)
    rows = [(g, i, rng.randrange(50) / 4, *(rng.choice((None, rng.randrange(20) / 20)) for _ in range(2)), rng.random(), rng.random()) for g, n in ((1, 40), (2, 7), (3, 3), (4, 12)) for i in range(n)]
    df = spark.createDataFrame(rows, "merged_subnetwork_id long, node long, in_BTC_total double, pagerank_pct double, in_btc_pct double, in_deg_pct double, out_deg_pct_inv double").repartition(3)
    sets = {"a": {"pr": 0.6, "val": 0.3, "in": 0.07, "out": 0.03}, "b": {"pr": 0.1, "val": 0.8, "in": 0.1, "out": 0.0}}

    def plain(weights):
        out = {}
        for g in (1, 2, 4):
            own = [r for r in rows if r[0] == g]
            raw = lambda r: round(weights["pr"] * (r[3] or 0) + weights["val"] * (r[4] or 0) + weights["in"] * r[5] + weights["out"] * r[6], 9)
            own.sort(key=lambda r: (-raw(r), r[1]))
            top = own[: max(1, math.ceil(0.2 * len(own)))]
            out[g] = (sum(round(r[2] * 100) for r in top) / sum(round(r[2] * 100) for r in own), statistics.median(r[3] or 0.0 for r in top) * 100)
        return out

    for limit in (2_000_000, 5):
        got = ranking.compare_weights(df, sets, 0.2, 5, details=True, group_rows=limit).collect()
        for name, weights in sets.items():
            assert close({r["merged_subnetwork_id"]: (r.btc_share, r.pr_percentile_med) for r in got if r["name"] == name}, plain(weights))
        whole = {r["name"]: (r.median_btc_share, r.median_pr_percentile, r.groups) for r in ranking.compare_weights(df, sets, 0.2, 5, group_rows=limit).collect()}
        assert close(whole, {k: (statistics.median(x for x, _ in plain(w).values()), statistics.median(x for _, x in plain(w).values()), 3) for k, w in sets.items()})


def test_kendall_of_large_groups_makes_no_pairs(spark):
    rng = random.Random(12)
    rows = [(1, i, rng.randrange(1000), rng.randrange(900)) for i in range(3000)] + [(2, i, i % 4, 7) for i in range(40)] + [(3, i, i, -i) for i in range(30)]
    df = spark.createDataFrame(rows, "merged_subnetwork_id long, node long, a long, b long")
    small, large = ({r["merged_subnetwork_id"]: r["corr"] for r in ranking.rank_correlations(df, ["a", "b"], "kendall", 5, limit).where("metric_a = 'a' and metric_b = 'b'").collect()} for limit in (2_000_000, 10))
    assert large[2] is None and small[2] is None and large[3] == pytest.approx(-1.0)
    assert large[1] == pytest.approx(small[1], abs=1e-12)


def test_importance_by_area(spark):
    rows = spark.createDataFrame([(i, i // 10, float(i % 7), float(i % 3), int(i % 7 > 3)) for i in range(200)], "txId long, time_step long, x double, noise double, class int")
    bundle = models.fit(rows, ["x", "noise"], models.logistic(50), threshold=0.5)
    got = {r.feature: r.importance for r in models.permutation_importance(bundle, rows, repeats=3, metric="roc_auc").collect()}
    assert 0.3 < got["x"] < 0.7 and abs(got["noise"]) < 0.1
    with pytest.raises(ValueError):
        models.permutation_importance(bundle, rows, repeats=1, metric="nothing")


def test_ranks_of_values_at_the_ninth_decimal(spark):
    """1 / sqrt(5) is 4e-14 from a boundary of nine decimals: an iteration that stops by a tolerance ranks equal nodes apart."""
    edges = [(1, 2), (3, 4), (5, 6), (4, 6), (7, 4), (2, 5), (2, 8)]
    rows = {r.node: r for r in ranking.matrix_metrics(frame(spark, edges), ["eigenvector"]).collect()}
    assert {k: r.rank_eigenvector for k, r in rows.items()} == {2: 1, 4: 1, 5: 1, 6: 1, 1: 2, 3: 2, 7: 2, 8: 2}


def test_rounds_that_a_query_fixes(spark):
    """A path settles slowly: after as many rounds as asked for, the values are those of so many plain steps."""
    n, edges = 40, [(i, i + 1) for i in range(40)]
    a = np.eye(n + 1)
    for x, y in edges:
        a[x, y] = a[y, x] = 1.0
    want = np.ones(n + 1)
    for _ in range(50):
        want = a @ want
    got = {r.node: r.eigenvector for r in ranking.matrix_metrics(frame(spark, edges), ["eigenvector"], rounds={"eigenvector": 50}).collect()}
    assert np.allclose([got[i] for i in range(n + 1)], want / np.linalg.norm(want), atol=1e-13)


def test_paths_of_a_group_beyond_the_old_limits(spark):
    """Two nodes lead to a hub that leads to 10,050 others: a group of over 10,000 nodes has its values like any other."""
    leaves = 10_050
    edges = spark.createDataFrame([(7, 1, 0), (7, 2, 0), *((7, 0, 3 + i) for i in range(leaves)), (8, 1, 2), (8, 2, 3)], f"{ranking.GROUP} long, src_txn_id long, dst_txn_id long")
    n = leaves + 3
    through = {(r[0], r.node): r.betweenness for r in ranking.betweenness(edges).collect() if r.betweenness}
    assert through == {(7, 0): pytest.approx(2 * leaves / ((n - 1) * (n - 2))), (8, 2): pytest.approx(0.5)}
    near = {(r[0], r.node): r.harmonic for r in ranking.harmonic(edges).collect()}
    assert near[7, 0] == near[7, 3] == near[7, n - 1] == 2.0 and near[7, 1] == 0.0 and near[8, 3] == 1.5


def test_a_task_goes_through_its_sources_in_turn(spark):
    rng = random.Random(4)
    edges = spark.createDataFrame([(g, rng.randrange(60), rng.randrange(60)) for g in (1, 2) for _ in range(150)], f"{ranking.GROUP} long, src_txn_id long, dst_txn_id long")
    for between in (False, True):
        whole = {(r.g, r.node): r.h for r in ranking._path_sums(edges, None, between).collect()}
        parted = {(r.g, r.node): r.h for r in ranking._path_sums(edges, None, between, cells=900, tasks=3).collect()}
        assert parted == pytest.approx(whole)
