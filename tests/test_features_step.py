"""The lines' sums, medians and distinct counts of an order."""

from statistics import median

from ledgerloom.sources import tables


def test_lines_of_orders(spark, tmp_path):
    lines = [(1, 5, 1, 10.0), (1, 5, 2, 30.0), (1, 6, None, 20.0), (1, None, 1, None), (2, 7, 7, 1.5), (2, 7, 7, 1.5), (3, None, None, None), (None, 1, 1, 9.0)]
    lines += [(4, i % 3, i % 5, float(i * 7 % 11)) for i in range(300)]
    rows = [(o, p, s, price, 0.1, 0.02, 2.0, f"1995-01-{1 + i % 28:02}") for i, (o, p, s, price) in enumerate(lines)]
    names = "l_orderkey long, l_partkey long, l_suppkey long, l_extendedprice double, l_discount double, l_tax double, l_quantity double, l_shipdate string"
    spark.createDataFrame(rows, names).write.parquet(f"{tmp_path}/lineitem.parquet")
    orders = [(k, k, "1995-01-01", 100.0, "1-URGENT", "F") for k in (1, 2, 3, 4, 5)]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderdate string, o_totalprice double, o_orderpriority string, o_orderstatus string").write.parquet(f"{tmp_path}/orders.parquet")
    found = tables.txn_features(spark, str(tmp_path))
    for r in found.collect():
        own = [x for x in lines if x[0] == r.txId]
        prices = [x[3] for x in own if x[3] is not None]
        assert r.in_BTC_median == (median(prices) if prices else None)
        assert (r.in_BTC_min, r.in_BTC_max) == ((min(prices), max(prices)) if prices else (None, None))
        distinct = [len({x[k] for x in own} - {None}) if own else None for k in (1, 2)]
        assert [r.num_input_addresses, r.num_output_addresses] == distinct
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Expand" not in plan and "ObjectHashAggregate" not in plan  # each line was sent three times, with a map of its order's values
