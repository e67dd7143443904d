import hashlib
import math
import random

import numpy as np
from pyspark.sql import functions as F

from ledgerloom.llm import hamerly

SCHEMA = "vec_id long, embedding array<double>, cluster string, distance string, _v string, n int"


def brute(rows, k, rounds, dims, scale=256, seed=2):
    kept = []
    for i, v in rows:
        if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) and abs(x) <= hamerly.LARGEST // scale for x in v):
            kept.append((i, [math.floor(scale * x) for x in v]))
    order = sorted(kept, key=lambda r: (hashlib.sha256(f"{seed}:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    cents = [v for _, v in order[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(cents))

    for _ in range(rounds):
        own = [nearest(v)[1] for _, v in kept]
        for j in range(len(cents)):
            mine = [v for (_, v), o in zip(kept, own) if o == j]
            if mine:
                cents[j] = [sum(x) // len(mine) for x in zip(*mine)]
    last = [(i, *nearest(v)) for i, v in kept]
    total = sum(d for _, d, _ in last)
    by = {j: sum(d for _, d, c in last if c == j) for j in range(len(cents))}
    return sorted(((i, c, d, by[c], total, hashlib.sha256(",".join(map(str, cents[c])).encode()).hexdigest()) for i, d, c in last), key=repr)


def run(spark, rows, **settings):
    df = spark.createDataFrame([(i, v, "clash", "clash", "clash", 1) for i, v in rows], SCHEMA).repartition(3)
    found, cents = hamerly.clusters(df, **settings)
    return hamerly.with_inertia(found, cents)


def plain(df):
    return sorted((tuple(r) for r in df.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256").collect()), key=repr)


def odd(rng, dims):
    rows = [(i, [rng.gauss(0, 0.2) for _ in range(dims)]) for i in range(60)]
    rows += [(100 + i, [rng.choice((-1, 0, 1)) / 256 for _ in range(dims)]) for i in range(40)]  # many ties
    rows += [(200 + i, rows[5][1]) for i in range(30)] + [rows[7]] * 5 + [(None, rows[9][1]), (None, None)]
    rows += [(300, [0.0] * (dims - 1)), (301, [0.0] * (dims + 1)), (302, [math.nan] + [0.0] * (dims - 1)), (303, [math.inf] + [0.0] * (dims - 1)), (304, [None] + [0.0] * (dims - 1)), (305, []), (306, [1e300] * dims)]
    rows += [(307, [hamerly.LARGEST / 256] + [-0.001] * (dims - 1)), (308, [-hamerly.LARGEST / 256] * dims)]
    return rows


def test_equals_brute_force(spark):
    rows = odd(random.Random(3), 4)
    for k, rounds in ((7, 5), (1, 2), (500, 3)):
        assert plain(run(spark, rows, k=k, rounds=rounds, dims=4)) == brute(rows, k, rounds, 4)


def test_bounds_spare_scans_and_change_nothing():
    rng = np.random.default_rng(1)
    middles = rng.integers(-400, 400, (12, 8))
    v = (middles[rng.integers(0, 12, 3000)] + rng.integers(-30, 30, (3000, 8))).astype(np.int64)
    cents, moved, state, scanned = v[:12].copy(), None, (None, None, None), []
    for _ in range(8):
        *state, scans = hamerly.assign(v, *state, cents, moved)
        full = ((v[:, None, :] - cents[None]) ** 2).sum(axis=2)
        assert (state[0] == full.argmin(axis=1)).all()
        own = np.sqrt(full[np.arange(len(v)), state[0]])
        full[np.arange(len(v)), state[0]] = np.iinfo(np.int64).max
        assert (state[1] >= own).all() and (state[2] <= np.sqrt(full.min(axis=1))).all()
        scanned.append(int(scans.sum()))
        now = np.array([v[state[0] == j].sum(axis=0) // max(1, (state[0] == j).sum()) if (state[0] == j).any() else cents[j] for j in range(12)])
        moved, cents = hamerly._up(((now - cents) ** 2).sum(axis=1)), now
    assert scanned[0] == 3000 and scanned[-1] < 600


def test_scans_are_reported(spark):
    rows = odd(random.Random(4), 4)
    found = run(spark, rows, k=5, rounds=5, dims=4).select(F.min("n_scans"), F.max("n_scans")).first()
    assert 1 <= found[0] < 6 and found[1] <= 6


def test_nothing_kept(spark):
    for rows in ([], [(1, None), (2, [1.0])]):
        df = run(spark, rows, dims=4)
        assert df.collect() == [] and df.columns == ["vec_id", "cluster", "distance", "n_scans", "cluster_inertia", "inertia", "centroid_sha256"]
