"""The batch run on written tables, with actual and predicted labels, a fitted model, and tables that change."""

import os
import shutil

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import places
from ledgerloom.operators import features, models, ranking, reports
from ledgerloom.plans import workspace
from ledgerloom.plans.workspace import Settings, Workspace, run_batch

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables here")


def test_run_batch_with_two_label_columns_and_a_saved_model(spark, tmp_path):
    w = Workspace(spark, DIR)
    rows = features.impute_median(w.features.join(w.scores.select("txId", "class"), "txId").select("txId", "time_step", "class", "fees", "size"), ["txId", "time_step", "class"]).where("class is not null")
    bundle = models.fit(rows, ["fees", "size"], models.logistic(50), threshold=0.5, name="lr")
    bundle.save(str(tmp_path / "bundle"))
    again = models.Bundle.load(spark, str(tmp_path / "bundle"))
    score = lambda b: sorted((r.txId, round(r.pred_proba, 9)) for r in models.score(b, rows).collect())
    assert score(again) == score(bundle) and again.threshold == 0.5
    for label, chosen in (("class_label", None), ("pred_class_label", str(tmp_path / "bundle"))):
        out = str(tmp_path / label)
        done = run_batch(spark, DIR, out, Settings(label_col=label, threshold=0.4 if chosen is None else 0.999), bundle=chosen, write_pagerank=chosen is None)
        pred = spark.read.parquet(f"{out}/df_txn_pred")
        seeds = pred.where(F.col(label) == "Illicit").count()
        if seeds:
            assert spark.read.parquet(f"{out}/df_nw_txn_final").select("txn_id").distinct().count() == seeds
        assert os.path.isdir(f"{out}/df_rank_pr") == ("df_rank_pr" in done) and (chosen is None) == ("df_rank_pr" in done)
    assert run_batch(spark, DIR, str(tmp_path / "dry"), dry_run=True) and not os.path.exists(str(tmp_path / "dry"))


def test_a_replaced_table_is_read_anew(spark, tmp_path):
    where = str(tmp_path / "tables")
    os.mkdir(where)
    for name in os.listdir(DIR):
        shutil.copyfile(f"{DIR}/{name}", f"{where}/{name}")  # without the read-only mode
    whole = workspace.workspace(spark, where).classes.count()
    assert workspace.workspace(spark, where) is workspace.workspace(spark, where)
    spark.read.parquet(f"{DIR}/orders.parquet").where("o_orderkey % 2 = 0").write.parquet(str(tmp_path / "half"))
    os.remove(f"{where}/orders.parquet")
    shutil.move(str(tmp_path / "half"), f"{where}/orders.parquet")
    assert 0 < workspace.workspace(spark, where).classes.count() < whole


def test_quantiles_and_ranks_by_ranges(spark):
    df = spark.createDataFrame([(i % 3, float(i * 7 % 11) if i % 5 else None) for i in range(60)], "g long, v double").withColumn("id", F.monotonically_increasing_id())
    values = sorted(r.v for r in df.collect() if r.v is not None)
    at = 0.3 * (len(values) - 1)
    want = values[int(at)] + (values[int(at) + 1] - values[int(at)]) * (at - int(at))
    assert places.quantiles(df.withColumn("none", F.lit(None).cast("double")), {"v": [0.0, 0.3, 1.0], "none": [0.5]}) == {"v": [values[0], pytest.approx(want), values[-1]], "none": [None]}
    large = places.large_groups(df, ["g"], 5)
    for f, spec in ((places.with_pct_ranks, {"p": "v"}), (places.with_dense_ranks, {"p": ("v", False)})):
        a, b = (sorted((r.id, None if r.p is None else round(r.p, 9)) for r in f(df, ["g"], spec, x).collect()) for x in (None, large))
        assert a == b


def test_kendall_and_auc_against_pairs(spark):
    import random

    rng = random.Random(4)
    rows = [(g, i, rng.randrange(6), rng.randrange(5)) for g in (1, 2) for i in range(30)]
    df = spark.createDataFrame(rows, "merged_subnetwork_id long, node long, a long, b long")
    for limit in (2_000_000, 10):
        for r in ranking.rank_correlations(df, ["a", "b"], "kendall", 5, limit).where("metric_a = 'a' and metric_b = 'b'").collect():
            own = [(x, y) for g, _, x, y in rows if g == r.merged_subnetwork_id]
            sign = lambda v: (v > 0) - (v < 0)
            s = [(sign(p[0] - q[0]), sign(p[1] - q[1])) for i, p in enumerate(own) for q in own[:i]]
            assert r["corr"] == pytest.approx(sum(x * y for x, y in s) / (sum(x * x for x, _ in s) * sum(y * y for _, y in s)) ** 0.5)
    y = spark.createDataFrame([(g, x % 2, float(z)) for g, _, x, z in rows], "fold long, class int, pred_proba double")
    for r in reports.auc(y, ["fold"]).collect():
        own = [(x % 2, z) for g, _, x, z in rows if g == r.fold]
        won = [(p > q) + (p == q) / 2 for c, p in own if c for d, q in own if not d]
        assert r.auc == pytest.approx(sum(won) / len(won))


def test_search_report_and_importance(spark):
    rows = spark.createDataFrame([(i, i // 10, float(i % 7), float(i % 3), int(i % 7 > 3)) for i in range(200)], "txId long, time_step long, x double, noise double, class int")
    bundle = models.fit(rows, ["x", "noise"], models.logistic(50), threshold=0.5)
    got = {r.feature: r for r in models.permutation_importance(bundle, rows, repeats=3).collect()}
    assert got["x"]["rank"] == 1 and got["x"].importance > 0.2 and got["x"].importance_std >= 0 and abs(got["noise"].importance) < 0.1
    records = models.successive_halving(rows, ["x", "noise"], [{"reg": 0.0}, {"reg": 0.1}, {"reg": 50.0}], lambda n, reg: models.logistic(n, reg), [5, 10], factor=3, splits=2)
    assert [r["round"] for r in records] == [0, 0, 0, 1] and all(0 <= r["recall"] <= 1 and len(r["splits"]) == 2 for r in records)
    row = models.tuning_report(spark, records, ["reg"]).first()
    assert (row.n_candidates_tested, row.halving__resources_schedule, row.halving__candidates_schedule) == (4, "5;10", "3;1") and row.best_score == models.best_record(records)["recall"]
    assert models.tuning_report(spark, [], ["reg"]).first().tuning_method == "None"
    evaluation, bundles = models.cross_validate(rows, ["x", "noise"], lambda: models.logistic(20), [(0, 100), (100, 200)])
    assert evaluation.count() == 2 and models.best_bundle(evaluation, bundles) in bundles
