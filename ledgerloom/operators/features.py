"""Feature engineering, imputation, splits and scaling of the transaction table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import safe_div
from ..functions.places import numbered, quantiles, running_total, with_global_pct_rank
from ..sources.tables import ILLICIT, LICIT, saved

HIGH_FEE_QUANTILE, MICRO_TXN = 0.95, 0.001


def flag(known, condition):
    """1.0 or 0.0, null where known is null."""
    return F.when(known, condition.cast("double"))


def with_high_fees(df: DataFrame, quantile: float = HIGH_FEE_QUANTILE) -> DataFrame:
    """high_fees_flag: fees above their exact quantile over the table."""
    limit = quantiles(df, {"fees": [quantile]})["fees"][0]
    return df.withColumn("high_fees_flag", flag(F.col("fees").isNotNull(), F.col("fees") > F.lit(limit).cast("double")))


def clean_features(features: DataFrame, classes: DataFrame) -> DataFrame:
    """Features left-joined with class and label (third and fourth column), plus the twelve engineered ones. Zero denominators give null."""
    df = features.join(classes.select("txId", "class", "class_label"), "txId", "left")
    c = F.col
    df = df.select(
        "txId", "time_step", "class", "class_label", *[x for x in features.columns if x not in ("txId", "time_step")],
        safe_div(c("in_BTC_total"), c("out_BTC_total")).alias("in_out_ratio"),
        safe_div(c("num_input_addresses"), c("num_output_addresses")).alias("input_output_ratio"),
        (c("out_BTC_max") - c("out_BTC_min")).alias("BTC_dispersion"),
        flag(c("total_BTC").isNotNull(), c("total_BTC") < MICRO_TXN).alias("micro_txn_flag"),
        safe_div(c("size"), c("num_input_addresses") + c("num_output_addresses")).alias("txn_density"),
        safe_div(c("fees"), c("size")).alias("fees_per_byte"),
        safe_div(c("fees"), c("total_BTC")).alias("fees_ratio"),
        safe_div(c("fees"), c("num_input_addresses")).alias("fees_per_input"),
        flag(c("in_BTC_total").isNotNull() & c("out_BTC_total").isNotNull(), (c("in_BTC_total") % 1 == 0) | (c("out_BTC_total") % 1 == 0)).alias("rounded_amount_flag"),
    )
    df = with_high_fees(df)
    return with_global_pct_rank(with_global_pct_rank(df, "num_input_addresses", "input_address_percentile"), "num_output_addresses", "output_address_percentile")


def wallet_dedup(wallets: DataFrame, time_col: str = "time_step") -> DataFrame:
    """Distinct rows once the time step is dropped."""
    return wallets.drop(time_col).distinct()


def numeric_columns(df: DataFrame, ignore: Sequence[str] = ()) -> list[str]:
    return [c for c, t in df.dtypes if t.split("(")[0] in ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal") and c not in ignore]


def columns_without_prefix(df: DataFrame, drop: Sequence[str] = (), prefixes: Sequence[str] = ("Local_feature_", "Aggregate_feature_")) -> list[str]:
    return [c for c in df.columns if c not in drop and not c.startswith(tuple(prefixes))]


def impute_median(df: DataFrame, ignore: Sequence[str] = ()) -> DataFrame:
    """Nulls of numeric columns become the column's exact median over the table."""
    columns = numeric_columns(df, ignore)
    medians = quantiles(df, {c: [0.5] for c in columns}) if columns else {}
    return df.select(*(F.coalesce(F.col(c).cast("double"), F.lit(medians[c][0]).cast("double")).alias(c) if c in medians else F.col(c) for c in df.columns))


def split_labels(df: DataFrame, label_col: str = "class_label") -> tuple[DataFrame, DataFrame]:
    """(labelled rows with class 0 or 1, the rest with class null)."""
    coded = df.withColumn("class", F.when(F.col(label_col) == LICIT, 0).when(F.col(label_col) == ILLICIT, 1))
    return coded.where("class is not null"), coded.where("class is null")


def with_data_split(df: DataFrame, train_val: DataFrame | None = None, test: DataFrame | None = None, label_col: str = "class_label", id_col: str = "txId") -> DataFrame:
    """data_split: Train/Val, Test or Unlabeled. By two tables of ids (an id in both counts as Test), or without them by the label: Train/Val for
    Illicit and Licit, Test for other labels, Unlabeled without one."""
    if train_val is None and test is None:
        known = F.col(label_col).isin(ILLICIT, LICIT)
        return df.withColumn("data_split", F.when(known, "Train/Val").when(F.col(label_col).isNotNull(), "Test").otherwise("Unlabeled"))
    out = df
    for ids, name in ((train_val, "_a"), (test, "_b")):
        found = (ids if ids is not None else df.limit(0)).select(F.col(id_col)).distinct().withColumn(name, F.lit(True))
        out = out.join(found, id_col, "left")
    return out.withColumn("data_split", F.when(F.col("_b"), "Test").when(F.col("_a"), "Train/Val").otherwise("Unlabeled")).drop("_a", "_b")


def fold_windows(n: int, size: int, folds: int, offsets: Sequence[int] | None = None, seed: int = 42) -> list[tuple[int, int]]:
    """Contiguous windows of size rows out of n in time order; none where size reaches n. Offsets are given or drawn from seed."""
    import random

    size = min(size, n)
    if n - size < 1:
        return []
    rng = random.Random(seed)
    starts = [o % (n - size + 1) for o in offsets[:folds]] if offsets is not None else [rng.randint(0, n - size) for _ in range(folds)]
    return [(s, s + size) for s in starts]


def with_time_order(df: DataFrame, time_col: str = "time_step", id_col: str = "txId") -> DataFrame:
    """_place: rows counted from 0 by time and id, by ranges of that order."""
    return numbered(df, [time_col, id_col], "_place")


def take_folds(df: DataFrame, windows: Sequence[tuple[int, int]], time_col: str = "time_step") -> DataFrame:
    """Rows of each window with its fold number, in one pass: the windows are a small literal table."""
    table = df.sparkSession.createDataFrame([(i + 1, a, b) for i, (a, b) in enumerate(windows)], "fold int, _a long, _b long")
    return with_time_order(df, time_col).join(F.broadcast(table), (F.col("_place") >= F.col("_a")) & (F.col("_place") < F.col("_b"))).drop("_a", "_b", "_place")


def temporal_split(df: DataFrame, ratio: float = 0.7, time_col: str = "time_step", keys: Sequence[str] = ()) -> DataFrame:
    """training_label: Train for the first int(steps * ratio) distinct time steps (of each key), Val for the others."""
    steps = df.select(*keys, time_col).distinct()
    w = Window.partitionBy(*keys)
    place = F.row_number().over(w.orderBy(time_col))
    labelled = steps.select(*keys, time_col, F.when(place <= F.floor(F.count("*").over(w) * F.lit(ratio)), "Train").otherwise("Val").alias("training_label"))
    return df.join(labelled, [*keys, time_col])


def temporal_split_summary(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    train, val = F.count_if(F.col("training_label") == "Train"), F.count_if(F.col("training_label") == "Val")
    return df.groupBy(*keys).agg(F.count("*").alias("total_size"), train.alias("training_size"), val.alias("val_size"), F.bround(train / F.count("*") * 100).alias("training_pct"), F.bround(val / F.count("*") * 100).alias("val_pct"))


def standardize(df: DataFrame, columns: Sequence[str], fit_on) -> DataFrame:
    """z-scores by mean and population deviation of the rows where fit_on holds; a zero deviation counts as 1."""
    fit = df.where(fit_on).agg(*(F.avg(c).alias(f"_a_{c}") for c in columns), *(F.stddev_pop(c).alias(f"_s_{c}") for c in columns))
    scaled = [((F.col(c) - F.col(f"_a_{c}")) / F.coalesce(F.nullif(F.col(f"_s_{c}"), F.lit(0.0)), F.lit(1.0))).alias(c) if c in columns else F.col(c) for c in df.columns]
    return df.crossJoin(F.broadcast(fit)).select(*scaled)


def prepare(df: DataFrame, label: str, drop: Sequence[str], target: str = "class", split_col: str = "training_label", id_col: str = "txId") -> tuple[DataFrame, DataFrame]:
    """(features, id and target) of the rows with this split label; ValueError where a column is missing."""
    if target not in df.columns or split_col not in df.columns:
        raise ValueError(f"{target} and {split_col} are needed")
    rows = df.where(F.col(split_col) == label)
    return rows.drop(*drop, target, split_col), rows.select(id_col, target)


def feature_shape(df: DataFrame, columns: Sequence[str], target: str = "class", bins: int = 16) -> DataFrame:
    """feature, n, pearson, spearman, r2, mutual_info (of histogram bins, natural log) and relation of each column against target; columns
    with fewer than five complete rows are left out. One scan counts the distinct (feature, x, y) of all columns; all else comes from those."""
    cells = F.explode(F.array(*(F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("x")) for c in columns)))
    long = df.where(F.col(target).isNotNull()).select(F.col(target).cast("double").alias("y"), cells.alias("z")).select("z.feature", "z.x", "y").where("x is not null")
    per = saved(long.groupBy("feature", "x", "y").agg(F.count("*").alias("n")))

    def ranks(c: str) -> DataFrame:
        upto = running_total(per.groupBy("feature", c).agg(F.sum("n").alias("k")), ["feature", c], F.col("k"), "upto")
        before = upto.groupBy("feature").agg(F.min(F.col("upto") - F.col("k")).alias("before"))
        return upto.join(F.broadcast(before), "feature").select("feature", c, (F.col("upto") - F.col("before") - (F.col("k") - 1) / 2).alias(f"r{c}"))

    ranked = saved(per.join(ranks("x"), ["feature", "x"]).join(F.broadcast(ranks("y")), ["feature", "y"]))
    n, names = F.col("n"), ("x", "y", "rx", "ry")
    means = ranked.groupBy("feature").agg(F.sum("n").alias("_all"), F.min("x").alias("lo"), F.max("x").alias("hi"), *((F.sum(n * F.col(c)) / F.sum("n")).alias(f"m_{c}") for c in names)).where("_all >= 5")
    off = {c: F.col(c) - F.col(f"m_{c}") for c in names}
    r = lambda a, b: F.try_divide(F.sum(n * off[a] * off[b]), F.sqrt(F.sum(n * off[a] * off[a]) * F.sum(n * off[b] * off[b])))
    rows = ranked.join(F.broadcast(means), "feature")
    stats = rows.groupBy("feature").agg(F.sum("n").alias("n"), r("x", "y").alias("pearson"), r("rx", "ry").alias("spearman"))
    b = F.coalesce(F.least(F.floor(safe_div(F.col("x") - F.col("lo"), F.col("hi") - F.col("lo")) * bins), F.lit(bins - 1)), F.lit(0))
    held = rows.groupBy("feature", b.alias("b"), "y").agg(F.sum("n").alias("c"))
    total = lambda *k: F.sum("c").over(Window.partitionBy("feature", *k))
    info = held.select("feature", (F.col("c") / total() * F.log(F.col("c") * total() / (total("b") * total("y")))).alias("i")).groupBy("feature").agg(F.sum("i").alias("mutual_info"))
    out = stats.join(info, "feature").withColumn("r2", F.col("pearson") ** 2)
    p, s = F.abs(F.col("pearson")), F.abs(F.col("spearman"))
    relation = F.when((p > 0.5) & (F.col("r2") > 0.3), "linear").when((p < 0.3) & ((s > 0.5) | (F.col("mutual_info") > 0.1)), "nonlinear").otherwise("weak")
    return out.select("feature", "n", "pearson", "spearman", "r2", "mutual_info", relation.alias("relation"))
