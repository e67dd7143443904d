"""Permutation importance: its values against plain Python, and what it moves."""

import random

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import models


def sent(spark) -> int:
    """Rows that the application has sent through shuffles so far."""
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, spark._sc._gateway.new_array(spark._jvm.double, 0), None)
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(7)
    held = [(i, int(rng.random() < 0.3), float(rng.randint(0, 40)), float(rng.randint(0, 9))) for i in range(700)]
    return spark.createDataFrame([(i, y, a + 15 * y, b) for i, y, a, b in held], "txId long, class int, a double, b double")


def plain(bundle, rows, repeats, metric):
    """Losses of each column, with rows met and scored one by one."""
    order = [r.asDict() for r in rows.na.drop().orderBy(F.xxhash64(F.lit(42), "txId"), "txId").collect()]
    n, last = len(order), bundle.model.stages[-1]

    def probability(x):
        margin = last.intercept + sum(w * (x[c] - bundle.scaler.mean[c]) / bundle.scaler.scale[c] for c, w in zip(bundle.columns, last.coefficients))
        return 1 / (1 + 2.718281828459045 ** -margin)

    def value(swapped, k):
        scores = [(r["class"], round(probability({**r, **({swapped: order[(i + k) % n][swapped]} if swapped else {})}), 12)) for i, r in enumerate(order)]
        if metric == "roc_auc":
            ones, zeros = ([p for y, p in scores if y == k] for k in (1, 0))
            return sum((p > q) + (p == q) / 2 for p in ones for q in zeros) / (len(ones) * len(zeros))
        tp, fp, fn = (sum(1 for y, p in scores if (y, p >= bundle.threshold) == k) for k in ((1, True), (0, True), (1, False)))
        return 2 * tp / (2 * tp + fp + fn)

    shifts = [1 + r % (n - 1) for r in range(repeats)]
    return {c: sum(value(None, k) - value(c, k) for k in shifts) / repeats for c in bundle.columns}


@pytest.mark.parametrize("metric", ["roc_auc", "f1"])
def test_values_of_small_blocks_and_ranges(spark, rows, monkeypatch, metric):
    monkeypatch.setattr(models, "BLOCK_ROWS", 64)
    monkeypatch.setattr(models, "RANGE_SCORES", 100)
    bundle = models.fit(rows, ["a", "b"], models.logistic(weighted=True), threshold=0.5)
    got = {r.feature: r.importance for r in models.permutation_importance(bundle, rows, repeats=3, metric=metric).collect()}
    assert got == pytest.approx(plain(bundle, rows, 3, metric), abs=1e-9)


@pytest.mark.parametrize("metric", ["roc_auc", "f1"])
def test_other_models_by_rows_agree(spark, rows, monkeypatch, metric):
    """The path of models that aren't linear, on the same logistic regression."""
    monkeypatch.setattr(models, "BLOCK_ROWS", 64)
    bundle = models.fit(rows, ["a", "b"], models.logistic(), threshold=0.5)
    packed = {r.feature: r.importance for r in models.permutation_importance(bundle, rows, repeats=2, metric=metric).collect()}
    monkeypatch.setattr(models, "LogisticRegressionModel", type(None))
    by_rows = {r.feature: r.importance for r in models.permutation_importance(bundle, rows, repeats=2, metric=metric).collect()}
    assert packed == pytest.approx(by_rows, abs=1e-9)


def test_few_rows(spark, rows):
    bundle = models.fit(rows, ["a", "b"], models.logistic(), threshold=0.5)
    for n in (1, 2, 3):
        assert models.permutation_importance(bundle, rows.where(f"txId < {n}"), repeats=4, metric="roc_auc").count() == 2


def test_repeats_shuffle_no_rows(spark):
    n = 20_000
    many = spark.range(n).select(F.col("id").alias("txId"), (F.hash("id") % 3 == 0).cast("int").alias("class"), F.hash("id", F.lit(1)).cast("double").alias("a"), F.hash("id", F.lit(2)).cast("double").alias("b"))
    bundle = models.fit(many, ["a", "b"], models.logistic(), threshold=0.5)
    before = sent(spark)
    models.permutation_importance(bundle, many, metric="roc_auc")
    assert 0 < sent(spark) - before < 4 * n  # it was 101 n: each repeat's rows, and each score
