"""Nearest-neighbour mutual information against a plain version that compares all pairs."""

import math
import random

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import information

EULER = 0.5772156649015329


def digamma(n):
    return -EULER + sum(1 / i for i in range(1, n))


def plain(pairs, k=3):
    pairs = [(x, y) for x, y in pairs if x is not None and y is not None and not math.isnan(x)]
    n = len(pairs)

    def spread(v):
        mean = math.fsum(v) / n
        return math.sqrt(math.fsum((a - mean) ** 2 for a in v) / n) or 1.0

    unit = spread([x for x, _ in pairs]) / spread([y for _, y in pairs])
    lost = 0.0
    for i, (x, y) in enumerate(pairs):
        r = sorted(max(abs(x - a), abs(y - b) * unit) for j, (a, b) in enumerate(pairs) if j != i)[k - 1]
        nx = sum(x - r < a < x + r if r else a == x for a, _ in pairs)
        ny = sum(abs(y - b) * unit < r if r else b == y for _, b in pairs)
        lost += digamma(nx) + digamma(ny)
    return n, max(0.0, digamma(n) + digamma(k) - lost / n)


def test_against_all_pairs(spark):
    rng = random.Random(5)
    rows = []
    for i in range(240):
        y = float(rng.choice((0, 0, 0, 1, 2)))
        rows.append((i, y, rng.gauss(3 * y, 1.0), rng.random(), float(rng.randrange(4)) + y, 7.0, None if i % 3 else rng.gauss(y, 0.3), math.nan if i % 5 else y))
    rows.append((900, 3.0, 50.0, 0.5, 1.0, 7.0, 1.0, 3.0))  # a class of one row
    rows.append((901, None, 1.0, 0.5, 1.0, 7.0, 1.0, 3.0))
    names = ["near", "noise", "grid", "constant", "gaps", "same"]
    df = spark.createDataFrame(rows, "id long, class double, " + ", ".join(f"{c} double" for c in names)).repartition(5).withColumn("few", F.when(F.col("id") < 4, F.col("near")))
    for k in (3, 1):
        got = {r.feature: (r.n, r.mutual_info) for r in information.knn_information(df, [*names, "few"], k=k).collect()}
        assert "few" not in got
        for j, c in enumerate(names):
            n, want = plain([(r[2 + j], r[1]) for r in rows], k)
            assert got[c] == (n, pytest.approx(want, abs=1e-8)), c
    assert got["near"][1] > 0.3 > got["noise"][1]


def test_ranges_and_a_class_that_most_of_them_lack(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "12")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = [(float(i * i % 97) + i / 8, 1.0 if i in (3, 4, 5, 190, 191) else 0.0) for i in range(200)]
        got = information.knn_information(spark.createDataFrame(rows, "x double, class double"), ["x"]).first()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert (got.n, got.mutual_info) == (200, pytest.approx(plain(rows)[1], abs=1e-8))


def test_empty_and_too_many_classes(spark):
    assert information.knn_information(spark.createDataFrame([], "x double, class double"), ["x"]).collect() == []
    with pytest.raises(ValueError):
        information.knn_information(spark.range(40).selectExpr("id AS x", "id AS class"), ["x"])


def test_digamma(spark):
    got = spark.createDataFrame([(n,) for n in (1, 2, 3, 10, 100, 5000)], "n long").select("n", information.digamma(F.col("n")).alias("d")).collect()
    assert all(r.d == pytest.approx(digamma(r.n), abs=1e-10) for r in got)
