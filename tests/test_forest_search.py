"""The forests' halving search and their importances, against plain Python."""

import math
import random

import pytest

from ledgerloom.operators import models

COLUMNS = ["a", "b", "c"]


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(5)
    made = []
    for i in range(400):
        a, b, c = rng.random(), rng.random(), rng.randrange(4)
        made.append((i, i // 20, int(a + 0.3 * rng.random() > 0.8), a, b, float(c)))
    made.append((400, 20, None, 0.5, 0.5, 1.0))
    made.append((401, 20, 1, None, 0.5, 1.0))
    return spark.createDataFrame(made, "txId long, time_step int, class int, a double, b double, c double")


def test_draws_stay_in_their_ranges_and_repeat():
    drawn = models.forest_draws(300)
    assert drawn == models.forest_draws(300) != models.forest_draws(300, seed=1)
    assert {d["max_depth"] for d in drawn} == {None, 12, 16, 20, 24, 28, 32, 36}
    assert {d["min_samples_split"] for d in drawn} == set(range(2, 20)) and {d["min_samples_leaf"] for d in drawn} == set(range(1, 20))
    assert {d["max_features"] for d in drawn} == {"sqrt", "log2", None} and {d["class_weight"] for d in drawn} == {"balanced", "balanced_subsample"}


def test_parameters_of_a_drawn_forest(spark):
    made = models.drawn_forest(7, 3, None, 13, 2, None, "balanced")
    assert (made.getNumTrees(), made.getMaxDepth(), made.getMinInstancesPerNode(), made.getFeatureSubsetStrategy()) == (7, 30, 7, "all")
    made = models.drawn_forest(7, 3, 12, 4, 9, "log2", "balanced_subsample")
    assert (made.getMaxDepth(), made.getMinInstancesPerNode(), made.getFeatureSubsetStrategy(), made.getWeightCol()) == (12, 9, "log2", "_weight")
    with pytest.raises(ValueError):
        models.drawn_forest(7, 3, 12, 4, 9, "log2", "none")


def test_rounds_keep_the_best_third_rounded_up():
    quality = [0.3, 0.9, 0.9, 0.1, 0.5, 0.8, 0.2, 0.0, 0.7, 0.6]
    records = models._halved([{"p": i} for i in range(10)], [100, 300, 900], 3, lambda resource, alive: {k: [quality[k], quality[k] / 2] for k in alive})
    assert [[r["candidate"] for r in records if r["round"] == i] for i in range(3)] == [list(range(10)), [1, 2, 5, 8], [1, 2]]
    assert models.best_record(records)["candidate"] == 1 and records[1]["recall"] == pytest.approx(0.675) and records[1]["recall_std"] == pytest.approx(0.225)
    assert len([r for r in models._halved([{}] * 12, [1, 2, 4, 8], 2, lambda _, alive: {k: [0.0] for k in alive}) if r["round"] == 3]) == 2


def grown_recalls(block, parts):
    """Recall of all trees of parts together, asked row by row."""
    held = hits = 0
    for r in block:
        if r["class"] == 1:
            raw = [p.predictRaw(r["_features"]).toArray() for p in parts]
            held, hits = held + 1, hits + (2 * sum(x[1] for x in raw) > sum(x.sum() for x in raw))
    return hits / held if held else 0.0


def test_search_equals_forests_fitted_part_by_part(spark, rows):
    draws = models.forest_draws(4, seed=8)
    records = models.forest_search(rows, COLUMNS, draws, [2, 5, 11], factor=2, splits=3, seed=7, parallel=3)
    assert [sum(r["round"] == i for r in records) for i in range(3)] == [4, 2, 1]
    assert records == models.forest_search(rows, COLUMNS, draws, [2, 5, 11], factor=2, splits=3, seed=7, parallel=1)
    known = rows.na.drop().orderBy("time_step", "txId").collect()
    assemble = models.VectorAssembler(inputCols=COLUMNS, outputCol="_features")
    n, last = len(known), records[-1]
    for i, got in enumerate(last["splits"]):
        ends = [n * j // 4 for j in (i + 1, i + 2)]
        train = models.balanced(assemble.transform(spark.createDataFrame(known[: ends[0]], rows.schema).coalesce(1)))
        after = assemble.transform(spark.createDataFrame(known[ends[0] : ends[1]], rows.schema)).collect()
        seed = 7 + 1000 * last["candidate"] + 100 * i
        parts = [models.drawn_forest(k, seed + j, **draws[last["candidate"]]).fit(train) for j, k in enumerate((2, 3, 6))]
        assert [p.getNumTrees for p in parts] == [2, 3, 6]
        assert got == pytest.approx(grown_recalls(after, parts))
    best = models.refitted(rows.na.drop(), COLUMNS, records)
    assert best.model.stages[-1].getNumTrees == 11 and best.params == draws[last["candidate"]]
    report = models.tuning_report(spark, records, list(draws[0]), factor=2, words=["max_features", "class_weight"]).first()
    assert (report.halving__resources_schedule, report.halving__candidates_schedule) == ("2;5;11", "4;2;1")
    assert report.tuned__max_features == draws[last["candidate"]]["max_features"] and report.tuned__min_samples_leaf == draws[last["candidate"]]["min_samples_leaf"]


def test_blocks_of_one_class_and_too_few_rows(spark, rows):
    same = rows.na.drop().selectExpr("txId", "time_step", "0 as class", "a", "b", "c")
    records = models.forest_search(same, COLUMNS, models.forest_draws(2), [1, 2], factor=2, splits=2)
    assert [r["recall"] for r in records] == [0.0] * 3
    with pytest.raises(ValueError):
        models.forest_search(rows.limit(0), COLUMNS, models.forest_draws(2), [1, 2])


def gini_of(tree, n):
    """Impurity importances of one tree by its nodes: what each split gains, by its rows, to a sum of 1."""
    out = [0.0] * n

    def walk(node):
        if node.numDescendants() == 0:
            return
        out[node.split().featureIndex()] += node.gain() * node.impurityStats().count()
        walk(node.leftChild())
        walk(node.rightChild())

    walk(tree)
    return [x / sum(out) for x in out] if sum(out) else out


def test_gini_importance_by_hand_and_its_ranks(spark, rows):
    bundle = models.fit(rows.na.drop(), COLUMNS, models.forest(5, 6), threshold=0.5)
    found = {r.feature: r.importance for r in models.model_importance(bundle, spark).collect()}
    trees = [t._call_java("rootNode") for t in bundle.model.stages[-1].trees]
    told = [sum(x) for x in zip(*(gini_of(t, 3) for t in trees))]
    assert all(math.isclose(found[c], x / sum(told), rel_tol=1e-6) for c, x in zip(COLUMNS, told)) and max(found, key=found.get) == "a"
    merged = {r.feature: r for r in models.importance_ranks(models.permutation_importance(bundle, rows.na.drop(), repeats=2), models.model_importance(bundle, spark)).collect()}
    ranked = sorted(COLUMNS, key=lambda c: -found[c])
    assert [merged[c].rank_model for c in ranked] == [1, 2, 3] and merged["a"].rank_permutation == 1


def test_linear_search_keeps_fits_that_ended(spark, rows, monkeypatch):
    """Each fit told one after the other gives the same records; those that ended before their limit are fitted once."""
    grid = [{"reg": r} for r in (0.01, 0.1, 1.0)]
    made = []

    def make(n, reg):
        made.append((n, reg))
        return models.logistic(n, reg, 0.0, True)

    known = rows.na.drop()
    records = models.successive_halving(known, COLUMNS, grid, make, [1, 200, 400], factor=2, splits=2)
    assert [sum(r["round"] == i for r in records) for i in range(3)] == [3, 2, 1]
    assert len(made) == 3 * 2 + 2 * 2  # one iteration ends no fit, 200 end all
    placed = known.orderBy("time_step", "txId").collect()
    n = len(placed)
    for r in records:
        for i, got in enumerate(r["splits"]):
            a, b = n * (i + 1) // 3, n * (i + 2) // 3
            bundle = models.fit(spark.createDataFrame(placed[:a], rows.schema), COLUMNS, models.logistic(r["resource"], grid[r["candidate"]]["reg"], 0.0, True), threshold=0.5)
            held = [x.pred_class for x in models.score(bundle, spark.createDataFrame(placed[a:b], rows.schema)).collect() if x["class"] == 1]
            assert got == pytest.approx(sum(held) / len(held) if held else 0.0)
