"""The addresses of transactions that are in no group are sent nowhere, and the summary is made once for all that read it."""

from ledgerloom.operators import addresses
from ledgerloom.plans.workspace import Workspace


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_the_summary_is_a_table_that_later_queries_read(spark):
    w = Workspace(spark, "/root/testdata/sf0.001")
    plan = _plan(w.txn_summary)
    assert "Join" not in plan and "Aggregate" not in plan


def test_only_ranked_transactions_are_grouped_by_address(spark):
    ranks = spark.createDataFrame([(1, 10, 1, 0.5, 2.0, 0.7), (1, 11, 2, 0.1, 1.0, 0.3)], "merged_subnetwork_id long, node long, composite_rank long, pagerank double, in_BTC_total double, composite_raw double")
    edges = spark.createDataFrame([(1, 10, 11, 0, 1)], "merged_subnetwork_id long, src_txn_id long, dst_txn_id long, min_src_hop int, min_dst_hop int")
    ins = spark.createDataFrame([("a", 10), ("b", 11), ("c", 99)], "input_address string, txId long")
    outs = spark.createDataFrame([(10, "x"), (10, "y"), (99, "z")], "txId long, output_address string")
    summary = addresses.txn_summary(ranks, ins, outs)
    assert _plan(summary).count("LeftSemi") == 2
    assert [(r.txn_id, r.input_addresses, r.output_addresses, r.n_outputs) for r in summary.orderBy("txn_id").collect()] == [(10, "a", "x; y", 2), (11, "b", "", 0)]
    metrics = addresses.address_metrics(ranks, edges, ins, outs)
    assert sorted((r.address, r.strength, r.final_rank, r.is_seed) for r in metrics.collect()) == [("a", 2, 1, True), ("x", 1, 1, True), ("y", 1, 1, True)]
