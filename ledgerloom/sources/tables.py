"""Loaders and sinks, and the transaction-graph views over the star-schema tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.exprs import code_label
from .steps import saved, shared_folder, stored  # noqa: F401

ILLICIT, LICIT, UNKNOWN = "Illicit", "Licit", "Unknown"
CODES = {1: ILLICIT, 2: LICIT, 3: UNKNOWN}


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def state(spark: SparkSession, sf_dir: str) -> tuple:
    """Name, time of change, number of files and bytes of each table of a folder, from the file system alone."""
    path = spark._jvm.org.apache.hadoop.fs.Path(sf_dir)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    found = []
    for f in fs.listStatus(path):
        held = fs.getContentSummary(f.getPath())
        found.append((f.getPath().getName(), f.getModificationTime(), held.getFileCount(), held.getLength()))
    return tuple(sorted(found))


def read_columns(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Projected and cast scan: {column: type}; values that can't be cast become null."""
    return df.select(*(F.col(c).try_cast(t).alias(c) for c, t in columns.items()))


def nan_to_null(df: DataFrame) -> DataFrame:
    """Doubles and floats with NaN turned into null."""
    return df.select(*(F.nanvl(F.col(c), F.lit(None).cast(t)).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes))


def query(spark: SparkSession, sql: str, params: dict | None = None, **tables: DataFrame) -> DataFrame:
    """A query over named tables with optional named parameters."""
    return spark.sql(sql, args=params, **tables)


def write_table(df: DataFrame, path: str, overwrite: bool = True, dry_run: bool = False) -> DataFrame:
    """Overwrites or appends to a Parquet table, or with dry_run only returns df. What overwrites is written beside the table first and then takes its place, so
    a write that fails leaves the table as it was, and df may read the table that it overwrites."""
    if dry_run:
        return df
    if not overwrite:
        df.write.mode("append").parquet(path)
        return df
    spark = df.sparkSession
    at = lambda p: spark._jvm.org.apache.hadoop.fs.Path(p)
    beside = f"{path.rstrip('/')}.{uuid.uuid4().hex}"
    fs, new, old = at(path).getFileSystem(spark._jsc.hadoopConfiguration()), at(f"{beside}.new"), at(f"{beside}.old")
    try:
        df.write.parquet(f"{beside}.new")
    except BaseException:
        fs.delete(new, True)
        raise
    if fs.exists(at(path)):
        fs.rename(at(path), old)
    if not fs.rename(new, at(path)):
        fs.rename(old, at(path))
        raise OSError(f"{path} can't be replaced")
    fs.delete(old, True)
    return df


def txn_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """txId, time_step, class (1 Illicit, 2 Licit, 3 Unknown), class_label."""
    o = read_table(spark, sf_dir, "orders")
    code = F.when((F.col("o_orderpriority") == "1-URGENT") & (F.col("o_orderstatus") == "F"), 1).when(F.col("o_orderpriority") == "5-LOW", 3).otherwise(2)
    rows = o.select(F.col("o_orderkey").alias("txId"), (F.year("o_orderdate") * 12 + F.month("o_orderdate")).alias("time_step"), code.alias("class"))
    return rows.withColumn("class_label", code_label(F.col("class"), CODES))


def txn_edgelist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct (txId1, txId2): the next order of the same customer, the next order that holds the same part."""
    o, li = read_table(spark, sf_dir, "orders"), read_table(spark, sf_dir, "lineitem")
    a = o.select(F.col("o_orderkey").alias("txId1"), F.lead("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")).alias("txId2"))
    b = li.select(F.col("l_orderkey").alias("txId1"), F.lead("l_orderkey").over(Window.partitionBy("l_partkey").orderBy("l_shipdate", "l_orderkey")).alias("txId2"))
    return a.union(b).where("txId2 is not null and txId1 != txId2").distinct()


def txn_features(spark: SparkSession, sf_dir: str, edges: DataFrame | None = None) -> DataFrame:
    """One row for each transaction; edges: its edge list, where that is at hand. Amounts are summed as integers (hundredths, ten-thousandths), so results don't depend on order."""
    o, li, e = read_table(spark, sf_dir, "orders"), read_table(spark, sf_dir, "lineitem"), txn_edgelist(spark, sf_dir) if edges is None else edges
    cents = F.round(F.col("l_extendedprice") * 100).cast("long")
    lines = li.select(
        "l_orderkey",
        "l_partkey",
        "l_suppkey",
        cents.alias("i"),
        (cents * (100 - F.round(F.col("l_discount") * 100).cast("long"))).alias("x"),
        (cents * F.round(F.col("l_tax") * 100).cast("long")).alias("f"),
        F.col("l_quantity").cast("long").alias("q"),
    )
    # An order's lines meet in one place and are sorted there by each column in turn: the lines in the middle give the medians, the first line of each
    # value is counted as a distinct one.
    own = Window.partitionBy("l_orderkey")
    marks = {}
    for c in ("i", "x"):
        marks[f"_at_{c}"] = F.row_number().over(own.orderBy(F.col(c).asc_nulls_last()))
        marks[f"_n_{c}"] = F.count(c).over(own)
    for c in ("l_partkey", "l_suppkey"):
        marks[f"_new_{c}"] = F.col(c).isNotNull() & ~F.col(c).eqNullSafe(F.lag(c).over(own.orderBy(c)))
    lines = lines.where("l_orderkey is not null").withColumns(marks)
    aggs = []
    for side, c, unit in (("in", "i", 100.0), ("out", "x", 10000.0)):
        middle = (2 * F.col(f"_at_{c}")).between(F.col(f"_n_{c}"), F.col(f"_n_{c}") + 2)
        aggs += [
            (F.min(c) / F.lit(unit)).alias(f"{side}_BTC_min"),
            (F.max(c) / F.lit(unit)).alias(f"{side}_BTC_max"),
            (F.sum(c).cast("double") / F.count(c) / F.lit(unit)).alias(f"{side}_BTC_mean"),
            (F.avg(F.when(middle, F.col(c))) / F.lit(unit)).alias(f"{side}_BTC_median"),
            (F.sum(c) / F.lit(unit)).alias(f"{side}_BTC_total"),
        ]
    agg = lines.groupBy("l_orderkey").agg(
        *aggs,
        (F.sum("f") / F.lit(10000.0)).alias("fees"),
        F.sum("q").cast("double").alias("size"),
        F.count_if("_new_l_partkey").alias("num_input_addresses"),
        F.count_if("_new_l_suppkey").alias("num_output_addresses"),
    )
    outs = e.groupBy(F.col("txId1").alias("k1")).agg(F.count("*").alias("out_txs_degree"))
    ins = e.groupBy(F.col("txId2").alias("k2")).agg(F.count("*").alias("in_txs_degree"))
    base = o.select(
        F.col("o_orderkey").alias("txId"),
        (F.year("o_orderdate") * 12 + F.month("o_orderdate")).alias("time_step"),
        ((F.round(F.col("o_totalprice") * 100).cast("long") - 100000) / F.lit(1e8)).alias("total_BTC"),
    )
    joined = base.join(agg, F.col("txId") == F.col("l_orderkey"), "left").join(ins, F.col("txId") == F.col("k2"), "left").join(outs, F.col("txId") == F.col("k1"), "left")
    return joined.drop("l_orderkey", "k1", "k2")


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stand-in for model scores: txId, class_label, class (1 Illicit, 0 Licit, null Unknown), pred_proba."""
    o = read_table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("txId"), F.pmod(F.col("o_orderkey") * 7919 + F.col("o_custkey") * 104729, F.lit(1000)).alias("b"))
    proba = F.when(F.col("class_label") == ILLICIT, 3000 + F.col("b") * 7).otherwise(F.col("b") * 6) / F.lit(10000.0)
    return txn_classes(spark, sf_dir).drop("class").join(o, "txId").select("txId", "time_step", "class_label", F.when(F.col("class_label") == ILLICIT, 1).when(F.col("class_label") == LICIT, 0).alias("class"), proba.alias("pred_proba"))


def addr_txn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(input_address, txId)."""
    o, c = read_table(spark, sf_dir, "orders"), read_table(spark, sf_dir, "customer")
    return o.join(c, o["o_custkey"] == c["c_custkey"]).select(F.col("c_name").alias("input_address"), F.col("o_orderkey").alias("txId"))


def txn_addr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct (txId, output_address)."""
    li, s = read_table(spark, sf_dir, "lineitem"), read_table(spark, sf_dir, "supplier")
    pairs = li.select("l_orderkey", "l_suppkey").distinct()
    return pairs.join(s, pairs["l_suppkey"] == s["s_suppkey"]).select(F.col("l_orderkey").alias("txId"), F.col("s_name").alias("output_address"))


def wallets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each user and day, with the user's totals repeated on each."""
    e = read_table(spark, sf_dir, "events")
    days = e.select(F.col("user_id").alias("address"), F.date_format("ts", "yyyyMMdd").cast("int").alias("time_step")).distinct()
    totals = e.groupBy(F.col("user_id").alias("address")).agg(F.count("*").alias("num_events"), F.sum(F.round(F.col("value") * 100).cast("long")).alias("total_cents"), F.countDistinct("event_type").alias("num_types"))
    return days.join(totals, "address")
