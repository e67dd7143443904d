"""Classification results, binning, evaluation and distribution reports."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import cut, safe_div
from ..functions.places import quantiles, running_total
from ..sources.tables import ILLICIT, LICIT


def threshold_predictions(scores: DataFrame, threshold: float = 0.4, model: str = "model") -> DataFrame:
    pred = (F.col("pred_proba") >= threshold).cast("int")
    return scores.withColumns({"pred_model": F.lit(model), "pred_model_threshold": F.lit(float(threshold)), "pred_class": pred, "pred_class_label": F.when(pred == 1, ILLICIT).otherwise(LICIT)})


def counts_by_step(df: DataFrame, values: Sequence[str], label_col: str = "class_label", time_col: str = "time_step") -> DataFrame:
    """Rows of each label by time step, 0 where there are none."""
    return df.groupBy(time_col).pivot(label_col, list(values)).agg(F.count(F.lit(1))).na.fill(0, list(values))


def final_labels(pred: DataFrame) -> DataFrame:
    """final_class and its label: the actual one where it is Illicit or Licit, else the predicted one."""
    known = F.coalesce(F.col("class_label").isin(ILLICIT, LICIT), F.lit(False))
    label = F.when(known, F.col("class_label")).otherwise(F.col("pred_class_label"))
    return pred.withColumns({"final_class": F.when(label == ILLICIT, 1).when(label == LICIT, 0), "final_class_label": label})


def to_utc(df: DataFrame, local: str, out: str, zone: str = "Australia/Melbourne") -> DataFrame:
    return df.withColumn(out, F.to_utc_timestamp(F.col(local), zone))


def cross_counts(df: DataFrame, row: str, column: str, values: Sequence[str], percent: str | None = None) -> DataFrame:
    """Counts of column's values by row, 0 where none; percent row or column turns them into shares in percent at two decimals."""
    out = df.groupBy(row).agg(*(F.count_if(F.col(column) == v).alias(v) for v in values))
    total = sum((F.col(v) for v in values[1:]), F.col(values[0]))
    if percent == "row":
        return out.select(row, *(F.round(safe_div(F.col(v) * 100, total), 2).alias(v) for v in values))
    if percent == "column":
        return out.select(row, *(F.round(safe_div(F.col(v) * 100, F.sum(v).over(Window.partitionBy())), 2).alias(v) for v in values))
    return out


def _bins(width_raw: Column, span: Column, ok: Column) -> list[Column]:
    width = F.when(ok, F.bround(width_raw, 3))
    bins = F.when(ok & (width > 0), F.greatest(F.lit(1), F.floor(F.try_divide(span, width)).cast("long"))).otherwise(F.lit(10).cast("long"))
    return [bins.alias("num_bins"), width.alias("bin_width")]


def scott_bins(df: DataFrame, value: str) -> DataFrame:
    """num_bins and bin_width by Scott's rule; 10 and null without spread."""
    s, n = F.stddev_pop(value), F.count(value)
    return df.agg(*_bins(3.49 * s / F.pow(n, F.lit(1 / 3)), F.max(value) - F.min(value), (n >= 2) & (s > 0)))


def freedman_bins(df: DataFrame, value: str) -> DataFrame:
    """num_bins and bin_width by the Freedman-Diaconis rule; 10 and null without spread between the quartiles."""
    low, high = quantiles(df, {value: [0.25, 0.75]})[value]
    iqr, n = F.lit(None if low is None else high - low).cast("double"), F.count(value)
    return df.agg(*_bins(2 * iqr * F.pow(n, F.lit(-1 / 3)), F.max(value) - F.min(value), iqr > 0))


def edges_by_width(low: float, high: float, width: float) -> list[float]:
    """Equal-width edges from low; the last one is raised to high if short."""
    edges = [low + i * width for i in range(max(0, math.ceil((high + width - low) / width)))]
    if edges[-1] < high:
        edges[-1] = high
    return edges


def edges_by_thresholds(low: float, high: float, thresholds: Sequence[float]) -> list[float]:
    """The distinct thresholds in order, with low and high (out to two decimals) where they lie beyond."""
    edges, low, high = sorted(set(thresholds)), math.floor(low * 100) / 100, math.ceil(high * 100) / 100
    return [*([low] if low < edges[0] else []), *edges, *([high] if high > edges[-1] else [])]


def with_bins(df: DataFrame, value: str, edges: Sequence[float], fmt: str | None = None, closed_last: bool = False) -> DataFrame:
    """pred_bin, pred_bin_LOWERB and pred_bin_UPPERB: bins [a, b). A value on the last edge gets none, unless closed_last."""
    v = F.col(value)
    if closed_last:
        v = F.when(v == edges[-1], F.lit((edges[-2] + edges[-1]) / 2)).otherwise(v)
    labels = [f"{a:{fmt}}-{b:{fmt}}" if fmt else f"{a:g}-{b:g}" for a, b in zip(edges, edges[1:], strict=False)]
    return df.withColumns({"pred_bin": cut(v, edges, labels).cast("string"), "pred_bin_LOWERB": cut(v, edges, [float(x) for x in edges[:-1]]).cast("double"), "pred_bin_UPPERB": cut(v, edges, [float(x) for x in edges[1:]]).cast("double")})


def bins_by_width(df: DataFrame, value: str, width: float) -> DataFrame:
    low, high = df.agg(F.min(value), F.max(value)).first()
    return with_bins(df, value, edges_by_width(low, high, width), ".2f")


def bins_manual(df: DataFrame, value: str, thresholds: Sequence[float]) -> DataFrame:
    low, high = df.agg(F.min(value), F.max(value)).first()
    return with_bins(df, value, edges_by_thresholds(low, high, thresholds))


def binned_report(binned: DataFrame) -> DataFrame:
    """By bin: counts of Illicit and Licit, their total, shares, running shares (three decimals), odds and conversion (two decimals), and a
    Total row. binned: pred_bin, pred_bin_LOWERB, class."""
    c = F.col
    counts = binned.where("pred_bin is not null and class is not null").groupBy("pred_bin", "pred_bin_LOWERB").agg(F.count_if(c("class") == 1).alias("Illicit"), F.count_if(c("class") == 0).alias("Licit"))
    counts = counts.withColumn("TOTAL", c("Illicit") + c("Licit"))
    every, upto = Window.partitionBy(), Window.orderBy("pred_bin_LOWERB").rowsBetween(Window.unboundedPreceding, 0)
    names = ("Illicit", "Licit", "TOTAL")
    rows = counts.select(
        "pred_bin", "pred_bin_LOWERB", *names,
        *(F.bround(safe_div(c(n), F.sum(n).over(every)), 3).alias(f"{n}_PCT") for n in names),
        *(F.bround(safe_div(F.sum(n).over(upto), F.sum(n).over(every)), 3).alias(f"{n}_CUMPCT") for n in names),
        F.bround(F.when(c("Licit") == 0, c("Illicit").cast("double")).otherwise(safe_div(c("Illicit"), c("Licit"))), 2).alias("Illicit_Licit_ODDS"),
        F.bround(safe_div(c("Illicit"), c("TOTAL")), 2).alias("Illicit_CONVERSION"),
    )
    sums = rows.agg(*(F.sum(n).alias(n) for n in names), *(F.sum(f"{n}_PCT").alias(f"{n}_PCT") for n in names))
    total = sums.select(
        F.lit("Total").alias("pred_bin"), F.lit(None).cast("double").alias("pred_bin_LOWERB"), *names, *(f"{n}_PCT" for n in names), *(F.lit(1.0).alias(f"{n}_CUMPCT") for n in names),
        F.when(c("Licit") == 0, c("Illicit").cast("double")).otherwise(safe_div(c("Illicit"), c("Licit"))).alias("Illicit_Licit_ODDS"), safe_div(c("Illicit"), c("TOTAL")).alias("Illicit_CONVERSION"),
    )
    return rows.unionByName(total)


def confusion(y: Column, p: Column) -> dict[str, Column]:
    return {"tp": F.count_if((y == 1) & (p == 1)), "tn": F.count_if((y == 0) & (p == 0)), "fp": F.count_if((y == 0) & (p == 1)), "fn": F.count_if((y == 1) & (p == 0))}


def metrics(tp: Column, tn: Column, fp: Column, fn: Column) -> dict[str, Column]:
    zero = lambda x: F.coalesce(x, F.lit(0.0))
    precision, recall = zero(safe_div(tp, tp + fp)), zero(safe_div(tp, tp + fn))
    return {"accuracy": safe_div(tp + tn, tp + tn + fp + fn), "precision": precision, "recall": recall, "f1": zero(safe_div(2 * precision * recall, precision + recall))}


# How the report writes each metric.
FORMULAS = {
    "accuracy": "((TP + TN) / (TP + TN + FP + FN))",
    "precision": "(TP / (TP + FP))",
    "recall": "(TP / (TP + FN))",
    "f1": "2 * (Precision * Recall) / (Precision + Recall)",
}


def threshold_report(df: DataFrame, thresholds: DataFrame) -> DataFrame:
    """For each threshold (a column of few values): confusion counts, the four metrics at two decimals, and each as a formula. One row for each distinct score is
    counted first, so the small cross join doesn't multiply the rows."""
    c = F.col
    per = df.where("class is not null").groupBy("pred_proba", "class").agg(F.count("*").alias("n"))
    rows = per.crossJoin(F.broadcast(thresholds)).withColumn("p", (c("pred_proba") >= c("threshold")).cast("int"))
    hit = lambda y, p: F.sum(F.when((c("class") == y) & (c("p") == p), c("n")).otherwise(0))
    counts = rows.groupBy("threshold").agg(hit(1, 1).alias("tp"), hit(0, 0).alias("tn"), hit(0, 1).alias("fp"), hit(1, 0).alias("fn"))
    m = metrics(c("tp"), c("tn"), c("fp"), c("fn"))
    return counts.select("threshold", *(F.bround(v, 2).alias(k) for k, v in m.items()), *(F.concat(F.format_string("%.4f", m[k]), F.lit(f" = {text}")).alias(f"{k}_formula") for k, text in FORMULAS.items()), "tp", "tn", "fp", "fn", (c("tp") + c("tn") + c("fp") + c("fn")).alias("total"))


def final_evaluation(df: DataFrame, label: str, pred: str = "pred_class") -> DataFrame:
    """One row from hard labels; auc_hard is (TPR + TNR) / 2, null with one class."""
    counts = df.where("class is not null").agg(F.count("*").alias("total_size"), *(v.alias(k) for k, v in confusion(F.col("class"), F.col(pred)).items()))
    c = F.col
    auc = (safe_div(c("tp"), c("tp") + c("fn")) + safe_div(c("tn"), c("tn") + c("fp"))) / 2
    return counts.select(F.lit(label).alias("label"), "total_size", *(v.alias(k) for k, v in metrics(c("tp"), c("tn"), c("fp"), c("fn")).items()), auc.alias("auc_hard"), (2 * auc - 1).alias("gini_hard"), "tp", "tn", "fp", "fn")


def auc(df: DataFrame, keys: Sequence[str] = (), score: str = "pred_proba") -> DataFrame:
    """auc and gini of each key, exact: pairs of a positive and a negative, ties half. Distinct scores are counted and summed by ranges, so no
    task sees all of them. Null with one class."""
    per = df.where("class is not null").groupBy(*keys, score).agg(F.sum("class").alias("p"), F.sum(1 - F.col("class")).alias("n"))
    upto = running_total(per, [*keys, score], F.col("n"), "upto")
    p, n, below = F.col("p").cast("double"), F.col("n").cast("double"), (F.col("upto") - F.col("n")).cast("double")
    won = F.sum(p * (below + n / 2)) - F.min(below) * F.sum(p)
    a = safe_div(won, F.sum(p) * F.sum(n))
    return upto.groupBy(*keys).agg(a.alias("auc"), (2 * a - 1).alias("gini"))


def fold_evaluation(df: DataFrame, threshold: float = 0.5, val_only: bool = False, time_col: str = "time_step") -> DataFrame:
    """One row for each fold: sizes, class counts, time range, metrics, auc, gini and confusion counts. Over all rows of the fold, or with
    val_only over its validation rows."""
    rows = df.where("training_label = 'Val'") if val_only else df
    c = F.col
    pred = (c("pred_proba") >= threshold).cast("int")
    counts = rows.groupBy("fold").agg(
        F.count("*").alias("total_size"), F.count_if(c("training_label") == "Train").alias("train_size"), F.count_if(c("training_label") == "Val").alias("val_size"),
        F.count_if(c("class") == 0).alias("class_0"), F.count_if(c("class") == 1).alias("class_1"), F.min(time_col).alias("min_step"), F.max(time_col).alias("max_step"),
        *(v.alias(k) for k, v in confusion(c("class"), pred).items()),
    )
    return counts.join(auc(rows, ["fold"]), "fold").select("*", *(v.alias(k) for k, v in metrics(c("tp"), c("tn"), c("fp"), c("fn")).items()))


def class_maps(df: DataFrame, key: str = "fold") -> DataFrame:
    """train and val class counts of each fold as maps."""
    per = df.groupBy(key, "training_label", "class").agg(F.count("*").alias("n"))
    cell = lambda s: F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("training_label") == s, F.struct("class", "n")))))
    return per.groupBy(key).agg(cell("Train").alias("train_classes"), cell("Val").alias("val_classes"))


def best_folds(evaluation: DataFrame, n: int = 1) -> DataFrame:
    return evaluation.orderBy(F.desc_nulls_last("gini"), F.desc("recall"), F.desc("accuracy"), "fold").limit(n)


def _distribution(df: DataFrame, value: str, labels: Sequence[str], name: str, running_of_rounded: bool) -> DataFrame:
    """Counts by right-closed bins 0-1-2-..., percent and running values in label order, and a Total row."""
    edges = [*range(len(labels)), math.inf]
    bins = df.sparkSession.createDataFrame(list(enumerate(labels)), "_o int, _l string")
    counts = df.where(F.col(value).isNotNull()).groupBy(cut(F.col(value).cast("double"), edges, labels, right=True).alias("_l")).agg(F.count("*").alias("c"))
    c = F.col
    upto, every = Window.orderBy("_o").rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy()
    rows = bins.join(counts, "_l", "left").na.fill(0, ["c"]).withColumns({"pct": F.bround(safe_div(c("c"), F.sum("c").over(every)) * 100, 2), "cum": F.sum("c").over(upto)})
    cum_pct = F.bround(F.sum("pct").over(upto), 2) if running_of_rounded else F.bround(safe_div(c("cum"), F.sum("c").over(every)) * 100, 2)
    rows = rows.select(c("_o").alias("bin_no"), c("_l").alias(name), c("c").alias("network_count"), c("pct").alias("pct_population"), c("cum").alias("cum_count"), cum_pct.alias("cum_pct_population"))
    last = lambda x: F.max_by(x, "bin_no") if running_of_rounded else F.lit(None)
    total = rows.agg(F.lit(len(labels)).alias("bin_no"), F.lit("Total").alias(name), F.sum("network_count").alias("network_count"), F.sum("pct_population").alias("pct_population"), last("cum_count").cast("long").alias("cum_count"), last("cum_pct_population").cast("double").alias("cum_pct_population"))
    return rows.unionByName(total)


# Fixed values in the next functions: the labels of the report's bins.
def node_count_bins(summary: DataFrame) -> DataFrame:
    return _distribution(summary, "node_count", ["1", "2", "3", "4", "5", "5+"], "node_group", False)


def depth_bins(summary: DataFrame) -> DataFrame:
    return _distribution(summary, "depth", ["1", "2", "3", "4", "5+"], "depth_group", True)


def seed_bins(summary: DataFrame) -> DataFrame:
    return _distribution(summary, "seed_count", ["1", "2", "3", "4", "5+"], "seed_group", True)


def node_count_distribution(summary: DataFrame) -> DataFrame:
    """Groups by node count, with percent and running percent (of rounded values)."""
    per = summary.groupBy("node_count").agg(F.count("*").alias("network_count"))
    per = per.withColumn("pct", F.bround(safe_div(F.col("network_count"), F.sum("network_count").over(Window.partitionBy())) * 100, 2))
    return per.withColumn("cum_pct", F.bround(F.sum("pct").over(Window.orderBy("node_count").rowsBetween(Window.unboundedPreceding, 0)), 2))


def size_depth_matrix(summary: DataFrame, min_nodes: int = 2) -> DataFrame:
    """Counts of groups by size class (rows) and depth class (columns), all classes present."""
    rows, columns = ["1–5", "6–10", "11–15", "16–20", "21+"], ["1", "2", "3", "4", "5", "5+"]
    n, d = F.col("node_count"), F.greatest(F.lit(1), F.col("depth"))
    size = F.when(n <= 5, rows[0]).when(n <= 10, rows[1]).when(n <= 15, rows[2]).when(n <= 20, rows[3]).otherwise(rows[4])
    depth = F.when(d <= 5, d.cast("string")).otherwise("5+")
    per = summary.where(n >= min_nodes).groupBy(size.alias("txn_count_bin")).agg(*(F.count_if(depth == c).alias(f"depth_{c.replace('+', '_plus')}") for c in columns))
    every = summary.sparkSession.createDataFrame([(r,) for r in rows], "txn_count_bin string")
    return every.join(per, "txn_count_bin", "left").na.fill(0)


def txn_conflicts(nodes: DataFrame, id_col: str = "merged_subnetwork_id") -> DataFrame:
    """Transactions in more than one group, with their groups."""
    return nodes.groupBy("txn_id").agg(F.countDistinct(id_col).alias("num_subnets"), F.array_join(F.array_sort(F.collect_set(id_col)).cast("array<string>"), ";").alias("subnets")).where("num_subnets > 1")
