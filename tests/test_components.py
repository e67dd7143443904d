"""Chains, strong components, reachability, containment and overlap of sets against plain Python, on random graphs and on long paths."""

import random

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import components, subnetworks


def last_job(spark):
    jobs = spark.sparkContext._jsc.sc().statusStore().jobsList(None)
    return jobs.apply(0).jobId()


def distances(edges, start):
    after = {}
    for a, b in edges:
        after.setdefault(a, set()).add(b)
    found, order = {start: 0}, [start]
    for x in order:
        for y in sorted(after.get(x, ())):
            if y not in found:
                found[y] = found[x] + 1
                order.append(y)
    return found


def graphs():
    rng = random.Random(1)
    out = [[(1, 2), (2, 3), (3, 1), (3, 4), (4, 4), (5, 6), (6, 5), (6, 1)], [(i, (i + 1) % 9) for i in range(9)] + [(20, 20), (30, 31)]]
    for n, m in ((8, 8), (30, 40), (60, 70)):
        cycle = rng.randrange(3, 20)
        out.append([(rng.randrange(n), rng.randrange(n)) for _ in range(m)] + [(1000 + i, 1000 + (i + 1) % cycle) for i in range(cycle)] + [(1000, 3)] + [(2000 + i, 2001 + i) for i in range(21)] + [(2010, 1)])
    return out


@pytest.mark.parametrize("edges", graphs())
def test_against_plain_python(spark, edges):
    nodes = sorted({x for e in edges for x in e})
    table = spark.createDataFrame(edges, "src long, dst long")
    far = {x: distances(edges, x) for x in nodes}
    got = {r.node: r.component for r in components.strong_components(table).collect()}
    assert got == {x: min(y for y in far[x] if x in far[y]) for x in nodes}
    seeds = [*nodes, 99_999, nodes[0]]
    starts = spark.createDataFrame(list(enumerate(seeds)), "key long, seed long")
    found = {(r.key, r.seed, r.node): r.hop for r in components.reached(starts, table.distinct()).collect()}
    assert found == {(i, s, y): h for i, s in enumerate(seeds) for y, h in (far.get(s) or {s: 0}).items()}
    own = {r.node: (r.chain, r.place) for r in components.chains(table.distinct().where("src != dst")).collect()}
    out, into = {}, {}
    for a, b in set(edges):
        if a != b:
            out.setdefault(a, []).append(b)
            into.setdefault(b, []).append(a)
    for b, froms in into.items():
        linked = len(froms) == 1 and len(out[froms[0]]) == 1
        assert (own[b][0] == own[froms[0]][0] and own[b][1] == own[froms[0]][1] + 1) == linked or own[b] == (b, 0)


def test_kept_seeds_are_those_that_dedup_keeps(spark):
    for edges in graphs()[::2]:
        nodes = sorted({x for e in edges for x in e})
        seeds = spark.createDataFrame(list(enumerate(nodes)), "subnetwork_id long, seed_txn long")
        allowed = spark.createDataFrame(edges, "src long, dst long").distinct()
        report = subnetworks.dedup_report(subnetworks.subnet_nodes(subnetworks.reach(seeds, allowed)))
        want = sorted((r.id, r.seed) for r in report.where("status = 'kept'").collect())
        assert sorted(map(tuple, subnetworks.kept_seeds(seeds, allowed).collect())) == want


def test_a_source_cycle_of_10000_nodes(spark):
    n, before = 10_000, last_job(spark)
    allowed = spark.range(n).selectExpr("id AS src", f"(id + 1) % {n} AS dst").union(spark.range(1).selectExpr(f"{n // 2}L AS src", f"{n}L AS dst"))
    seeds = spark.range(n + 1).selectExpr("id AS subnetwork_id", "id AS seed_txn")
    assert list(map(tuple, subnetworks.kept_seeds(seeds, allowed).collect())) == [(0, 0)]
    assert last_job(spark) - before < 100


def test_a_chain_of_5000_nodes(spark):
    n, before = 5000, last_job(spark)
    allowed = spark.range(n - 1).selectExpr("id AS src", "id + 1 AS dst")
    got = subnetworks.reach(spark.createDataFrame([(0, 0)], "subnetwork_id long, seed_txn long"), allowed)
    assert got.where("hop != node").count() == 0 and got.count() == n
    assert last_job(spark) - before < 60


def test_a_random_cycle_with_chords(spark):
    rng = random.Random(4)
    p = list(range(2000))
    rng.shuffle(p)
    edges = [(p[i], p[(i + 1) % len(p)]) for i in range(len(p))] + [(p[i], p[(i + 2) % len(p)]) for i in range(len(p))]
    before = last_job(spark)
    got = components.strong_components(spark.createDataFrame(edges, "src long, dst long")).agg(F.count("*"), F.max("component")).first()
    assert tuple(got) == (2000, 0) and last_job(spark) - before < 150


def plain_report(sets):
    order = sorted(sets, key=lambda i: (-len(sets[i]), i))
    kept, out = [], {}
    for i in order:
        over = next((k for k in kept if sets[k] >= sets[i]), None)
        out[i] = (len(sets[i]), "kept" if over is None else "dropped_subset", i if over is None else over)
        if over is None:
            kept.append(i)
    return out


def table_of(spark, sets):
    return spark.createDataFrame([(i, x, i) for i, s in sets.items() for x in s], "subnetwork_id long, txn_id long, seed_txn long")


def test_containment_against_plain_python(spark):
    rng = random.Random(6)
    sets = {i: frozenset(rng.sample(range(12), rng.randrange(1, 7))) for i in range(150)}
    got = {r.id: (r.size, r.status, r.kept_as) for r in subnetworks.dedup_report(table_of(spark, sets), by_reach=False).collect()}
    assert got == plain_report(sets)


def plain_groups(sets, k):
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and len(sets[a] & sets[b]) >= k:
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {i: root(i) for i in sets}


@pytest.mark.parametrize("k", [1, 2, 3])
def test_overlap_against_plain_python(spark, k):
    rng = random.Random(k)
    sets = {i: frozenset(rng.sample(range(40), rng.randrange(1, 6))) | ({100} if i % 2 else frozenset()) | ({101} if i % 3 else frozenset()) for i in range(90)}
    for hub in (1, 4, 200):
        links = subnetworks.components(subnetworks.overlap_links(table_of(spark, sets), k, hub))
        found = {r.node: r.least for r in links.collect()}
        assert {i: found.get(i, i) for i in sets} == plain_groups(sets, k)


def test_a_node_in_5000_subnetworks(spark):
    """All of them hold the hub, those of a hundred also a second node."""
    held = spark.range(5000).selectExpr("id AS subnetwork_id", "explode(array(-1L, 100000 + id, 200000 + id % 50)) AS txn_id").withColumn("seed_txn", F.col("subnetwork_id"))
    merged = subnetworks.merge_ids(held, 2)
    assert merged.where("merged_subnetwork_id != subnetwork_id % 50").count() == 0 and merged.count() == 5000
    report = subnetworks.dedup_report(held.union(spark.createDataFrame([(9000, -1, 9000), (9001, -1, 9001), (9001, 200007, 9001)], held.schema)), by_reach=False)
    dropped = sorted((r.id, r.kept_as) for r in report.where("status != 'kept'").collect())
    assert dropped == [(9000, 0), (9001, 7)]
