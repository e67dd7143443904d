"""Work of groups and ranges is spread over tasks, however few bytes it has."""

import random

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import information, ranking, subnetworks


def test_groups_are_not_packed_into_one_task(spark):
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    e = spark.createDataFrame([(g, g, g + 1, 1.0, 1) for g in range(200)], "g long, s long, d long, w double, n long")
    assert ranking._each_group(e, ranking._pagerank_small(0.85, 100, 1e-8), "g long, node long, pr double, done boolean").rdd.getNumPartitions() >= parts
    edges = spark.createDataFrame([(g, g, g + 1) for g in range(200)], f"{ranking.GROUP} long, src_txn_id long, dst_txn_id long")
    sums = ranking.harmonic(edges)
    assert sums.count() == 400 and {r.harmonic for r in sums.collect()} == {0.0, 1.0}


def test_ranges_of_points_are_bounded(spark, monkeypatch):
    rng = random.Random(3)
    df = spark.createDataFrame([(rng.random(), int(rng.random() < 0.4)) for _ in range(4000)], "a double, class int").repartition(4)
    whole = information.knn_information(df, ["a"]).collect()
    plain = information.kth_distances

    def bounded(x, *others):
        assert len(x) < 1000
        return plain(x, *others)

    monkeypatch.setattr(information, "kth_distances", bounded)
    monkeypatch.setattr(information, "RANGE_POINTS", 200, raising=False)
    found = information.knn_information(df, ["a"]).collect()
    assert [r.n for r in found] == [r.n for r in whole] == [4000]
    assert found[0].mutual_info == pytest.approx(whole[0].mutual_info, abs=1e-9)


def test_a_large_group_gets_its_seeds_in_several_tasks(spark, monkeypatch):
    monkeypatch.setattr(subnetworks, "SLICE_NODES", 100, raising=False)
    rows = [(s, seed, n, abs(n - seed), 0) for s, seed in enumerate((0, 500)) for n in range(seed, seed + 1000)] + [(2, 5000, 5000, 0, 2)]
    got = subnetworks.collapse_nodes(spark.createDataFrame(rows, "subnetwork_id long, seed_txn long, txn_id long, hop int, merged_subnetwork_id long"))
    want = {(0, n, min(n if n < 1000 else 9999, n - 500 if n >= 500 else 9999), (0, 500)) for n in range(1500)} | {(2, 5000, 0, (5000,))}
    found = got.withColumn("p", F.spark_partition_id()).collect()
    assert len(found) == len(want) and {(r.merged_subnetwork_id, r.txn_id, r.min_hop, tuple(r.seeds_in_group)) for r in found} == want
    assert len({r.p for r in found if r.merged_subnetwork_id == 0}) > 1
