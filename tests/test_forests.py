"""Forests whose trees are grown in one task each, against plain Python."""

import random

import numpy as np
import pytest
from .test_components import last_job

from ledgerloom.operators import forests, models

COLUMNS = ["a", "b", "c"]


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(9)
    made = [(i, i, int(rng.random() < 0.3), rng.random(), rng.random(), float(rng.randrange(5))) for i in range(1500)]
    return spark.createDataFrame(made, "txId long, time_step int, class int, a double, b double, c double").repartition(3)


def impurity(a, b):
    return 2 * a * b / (a + b) if a + b else 0.0


def test_every_split_is_the_best_of_all():
    rng = np.random.default_rng(2)
    n, width, w = 400, 3, (0.7, 2.5)
    bins, ones = rng.integers(0, 6, (width, n)).astype(np.uint8), (rng.random(n) < 0.3).astype(np.uint8)
    drawn = rng.integers(0, 3, n)
    cells = forests.Cells([np.arange(5.0)] * width, w, bins, ones, np.ones(n, np.int64))
    nodes, counts = forests.grow_tree(cells, drawn, rng, width, 7, 4)
    at = {0: np.arange(n)}
    depth = {0: 0}
    for i, v in enumerate(nodes):
        own = at[i]
        total = [int(drawn[own[ones[own] == k]].sum()) for k in (0, 1)]
        assert total == list(counts[i])
        best = 0.0
        for f in range(width):
            for s in range(6):
                left, right = own[bins[f, own] <= s], own[bins[f, own] > s]
                sums = [[w[k] * drawn[x[ones[x] == k]].sum() for k in (0, 1)] for x in (left, right)]
                if min(drawn[left].sum(), drawn[right].sum()) >= 4:
                    best = max(best, impurity(*(w[k] * total[k] for k in (0, 1))) - impurity(*sums[0]) - impurity(*sums[1]))
        if v & 255 == forests.LEAF:
            assert v >> 16 == i and (depth[i] == 7 or best < 1e-9)
            continue
        f, s, left = v >> 8 & 255, v & 255, v >> 16
        at[left], at[left + 1] = own[bins[f, own] <= s], own[bins[f, own] > s]
        depth[left] = depth[left + 1] = depth[i] + 1
        sums = [impurity(*(w[k] * drawn[x[ones[x] == k]].sum() for k in (0, 1))) for x in (at[left], at[left + 1])]
        assert impurity(*(w[k] * total[k] for k in (0, 1))) - sum(sums) == pytest.approx(best)
    assert len(at) == len(nodes) > 20 and max(depth.values()) == 7


def test_deep_forests_take_few_jobs_and_are_kept(spark, rows, tmp_path):
    rows.count()
    before = last_job(spark)
    bundle = models.fit(rows, COLUMNS, models.forest(12, 30), threshold=0.5, name="rf")
    assert last_job(spark) - before < 25  # a job or more for each of some 20 levels before
    model = bundle.model.stages[-1]
    found = {r.txId: r.pred_proba for r in models.score(bundle, rows).collect()}
    trees = model.trees
    assert len(found) == 1500 and max(t.depth for t in trees) > 12 and sum(t.numNodes for t in trees) == model.totalNumNodes
    x = bundle.model.stages[0].transform(bundle.scaler.transform(rows.limit(20))).collect()
    for r in x:
        asked = [t.predictRaw(r["_features"]).toArray() for t in trees]
        assert found[r.txId] == pytest.approx(sum(p[1] / p.sum() for p in asked) / 12, abs=1e-6)
    bundle.save(str(tmp_path / "rf"))
    again = models.Bundle.load(spark, str(tmp_path / "rf"))
    assert {r.txId: r.pred_proba for r in models.score(again, rows).collect()} == found


def test_unlike_weights_go_to_sparks_own_forest(spark, rows):
    made = models.VectorAssembler(inputCols=COLUMNS, outputCol="_features").transform(rows.selectExpr("*", "1 + a AS _weight"))
    assert models.forest(2, 3).pack(made) is None and len(models.forest(2, 3).fit(made).trees) == 2


def test_a_search_packs_each_block_once(spark, rows, monkeypatch):
    packs, plain = [], forests.Forest.pack
    monkeypatch.setattr(forests.Forest, "pack", lambda self, df: packs.append(1) or plain(self, df))
    records = models.forest_search(rows, COLUMNS, models.forest_draws(3), [2, 4], factor=3, splits=2)
    assert len(records) == 4 and len(packs) == 2


def test_importances_ask_the_trees_once_for_all_repeats(spark, rows, monkeypatch):
    """Each block's scores, looked up by bin, count as those of the rows with swapped values."""
    monkeypatch.setattr(models, "FOREST_ROWS", 200)
    bundle = models.fit(rows, COLUMNS, models.forest(9, 12), threshold=0.5, name="rf")
    placed = models.saved(models.numbered(rows, ["txId"], "_place"))
    blocks, shifts = models._blocks(placed, 1500, 3, 200)
    got = {(r["_r"], r["_c"]): (r.tp, r.tn, r.fp, r.fn) for r in models._linear_counts(bundle, blocks, shifts).collect()}
    scored = models.score(bundle, models._swapped(blocks, bundle.columns, shifts))
    kinds = {k: v for k, v in models.reports.confusion(models.F.col("class"), models.F.col("pred_class")).items()}
    want = scored.groupBy("_r", "_c").agg(*(v.alias(k) for k, v in kinds.items())).collect()
    assert got == {(r["_r"], r["_c"]): (r.tp, r.tn, r.fp, r.fn) for r in want} and len(got) == 12
    monkeypatch.setattr(models, "_swapped", None)
    assert models.permutation_importance(bundle, rows, repeats=2).count() == 3
