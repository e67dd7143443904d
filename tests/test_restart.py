"""Tables with versions, sinks that fail, and a batch that stops and goes on."""

import os

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import ranking, reports, subnetworks
from ledgerloom.plans import workspace
from ledgerloom.plans.workspace import STEPS, Batch, Settings, run_batch
from ledgerloom.sources import tables
from ledgerloom.sources.versions import Conflict, VersionedTable

DIR = "/root/testdata/sf0.001"


def broken(spark):
    """A frame whose second half can't be computed."""
    return spark.range(100).select("id", F.when(F.col("id") > 50, F.raise_error(F.lit("lost"))).otherwise(F.lit("x")).alias("v"))


def test_a_failed_overwrite_leaves_the_table(spark, tmp_path):
    path = str(tmp_path / "t")
    tables.write_table(spark.range(5), path)
    with pytest.raises(Exception, match="lost"):
        tables.write_table(broken(spark), path)
    assert spark.read.parquet(path).count() == 5 and os.listdir(tmp_path) == ["t"]
    tables.write_table(spark.read.parquet(path).where("id > 2"), path)  # reads what it overwrites
    assert spark.read.parquet(path).count() == 2 and os.listdir(tmp_path) == ["t"]
    tables.write_table(spark.range(1), path, overwrite=False)
    tables.write_table(spark.range(9), path, dry_run=True)
    assert spark.read.parquet(path).count() == 3


def test_versions(spark, tmp_path):
    t = VersionedTable(spark, str(tmp_path / "t"), ["k"])
    with pytest.raises(FileNotFoundError):
        t.read()
    rows = spark.range(1000).selectExpr("id % 100 AS k", "id", "cast(id AS string) AS s")
    assert t.replace(rows, 8) == 1
    with pytest.raises(Exception, match="lost"):
        t.replace(broken(spark).selectExpr("id AS k", "id", "v AS s"))
    assert t.versions() == [1] and t.read().count() == 1000
    assert len(os.listdir(tmp_path / "t" / "data")) == 1  # nothing is left of the failed one
    got = t.lookup("k", 42)
    assert sorted(r.id for r in got.collect()) == list(range(42, 1000, 100))
    assert len(got.inputFiles()) == 1 and len(t.read().inputFiles()) == 8
    assert t.lookup("k", 5000).collect() == [] and t.lookup("s", "7").count() == 1
    assert t.append(spark.createDataFrame([(7, 5000, "new"), (None, 5001, None)], "k long, id long, s string"), 1) == 2
    assert t.read().count() == 1002 and t.read(1).count() == 1000 and len(t.lookup("k", 7).inputFiles()) <= 2 and t.lookup("k", 7).count() == 11
    with pytest.raises(ValueError):
        t.append(spark.range(3))
    with pytest.raises(Conflict):
        t._publish(2, {})
    assert t.replace(t.read().where("k < 10")) == 3
    t.vacuum()
    assert t.versions() == [3] and t.read().count() == 101
    with pytest.raises(FileNotFoundError):
        t.read(1)
    by_name = VersionedTable(spark, str(tmp_path / "u"), ["s"])
    by_name.replace(rows, 4)
    assert by_name.lookup("s", "999").count() == 1 and len(by_name.lookup("s", "999").inputFiles()) == 1
    by_name.replace(rows.limit(0))
    assert by_name.read().collect() == [] and by_name.lookup("s", "1").collect() == []


pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables here")


def same(spark, a, b, table):
    x, y = spark.read.parquet(f"{a}/{table}"), spark.read.parquet(f"{b}/{table}")
    return x.columns == y.columns and sorted(map(repr, x.collect())) == sorted(map(repr, y.collect()))


def test_a_batch_stops_after_its_second_step_and_goes_on(spark, tmp_path, monkeypatch):
    whole, out = str(tmp_path / "whole"), str(tmp_path / "out")
    done = run_batch(spark, DIR, whole)

    def stop(*args, **named):
        raise RuntimeError("stopped")

    with monkeypatch.context() as m:
        m.setattr(ranking, "pagerank", stop)
        with pytest.raises(RuntimeError, match="stopped"):
            run_batch(spark, DIR, out)
    assert sorted(os.listdir(f"{out}/_steps"))[-2:] == ["classify", "subnetwork"] and not os.path.exists(f"{out}/df_rank_composite")
    with monkeypatch.context() as m:  # what is done isn't made again
        m.setattr(reports, "final_labels", stop)
        m.setattr(subnetworks, "collapse_nodes", stop)
        again = run_batch(spark, DIR, out, resume=True)
        assert sorted(again) == sorted(done) and all(same(spark, whole, out, t) for t in done)
        m.setattr(ranking, "pagerank", stop)
        assert sorted(run_batch(spark, DIR, out, resume=True)) == sorted(done)
        b = Batch(spark, DIR, out, Settings(alpha=0.5))
        assert [b.done(s) for s in STEPS] == [True, True, False, False]
        assert not Batch(spark, DIR, out, Settings(threshold=0.9)).done("classify")
        assert not Batch(spark, DIR, out, write_pagerank=False).done("rank")
    b.run("rank")
    assert [b.done(s) for s in STEPS] == [True, True, True, False]
    assert spark.read.parquet(f"{out}/df_rank_pr").agg(F.max("pagerank")).first()[0] != spark.read.parquet(f"{whole}/df_rank_pr").agg(F.max("pagerank")).first()[0]


def test_a_step_from_the_command_line(spark, tmp_path):
    out = str(tmp_path / "out")
    for step in ("classify", "subnetwork"):
        workspace.main(["--input", DIR, "--out", out, "--step", step, "--set", "threshold=0.3", "--set", "label_col=class_label"])
    assert sorted(t for t in os.listdir(out) if t[0] != "_") == ["df_network_edges", "df_nw_txn_final", "df_txn_pred", "network_summary"]
    assert spark.read.parquet(f"{out}/df_txn_pred").select("pred_model_threshold").distinct().first()[0] == 0.3
    with pytest.raises(SystemExit):
        workspace.main(["--input", DIR, "--out", out, "--set", "nothing=1"])
