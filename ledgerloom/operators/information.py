"""Mutual information of numeric columns and a class by nearest neighbours (Kraskov, Stoegbauer and Grassberger 2004), on tables sorted by ranges."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.places import running_total
from ..sources.tables import saved

MOST_CLASSES = 16

#: Distinct points (feature, value, class) of a range that one task holds at once, about.
RANGE_POINTS = 200_000


def digamma(n: Column) -> Column:
    """Of a whole number from 1 on, to about eleven digits: the asymptotic series at n + 6, less the steps from n there."""
    x = n.cast("double") + 6
    series = F.log(x) - 1 / (2 * x) - 1 / (12 * x**2) + 1 / (120 * x**4) - 1 / (252 * x**6) + 1 / (240 * x**8)
    for j in range(6):
        series = series - 1 / (n.cast("double") + j)
    return series


def kth_distances(x: np.ndarray, y: np.ndarray, values: dict, gaps: dict, k: int) -> np.ndarray:
    """Of each point (x, class y) the distance to its k-th nearest other point, where two points are as far apart as their values or their classes,
    whichever is more. values: sorted values of each class, each as often as it occurs or k + 1 times; gaps: the distance of two classes."""
    out = np.full(len(x), np.inf)
    for own in np.unique(y):
        rows = np.flatnonzero(y == own)
        near = []
        for other, v in values.items():
            padded = np.concatenate([np.full(k, -np.inf), v, np.full(2 * k + 1, np.inf)])
            at = np.searchsorted(v, x[rows], "left") + k
            around = np.abs(padded[at[:, None] + np.arange(-k, 2 * k + 1)] - x[rows, None])
            if other == own:
                around[:, k] = np.inf  # the point itself, which is the first of its value
            near.append(np.maximum(around, gaps[own, other]))
        out[rows] = np.partition(np.concatenate(near, axis=1), k - 1, axis=1)[:, k - 1]
    return out


def _ends(own: DataFrame, k: int, last: bool) -> DataFrame:
    """(feature, y, _p, values): the k first or last distinct values of each class in each range. The window runs inside a range."""
    order = F.col("x").desc() if last else F.col("x").asc()
    near = own.withColumn("_i", F.row_number().over(Window.partitionBy("_p", "feature", "y").orderBy(order))).where(F.col("_i") <= k)
    return near.groupBy("feature", "y", "_p").agg(F.collect_list(F.struct("x", "n")).alias("values"))


def _halos(own: DataFrame, k: int, before: bool) -> DataFrame:
    """(_p, feature, x, y, n): for each range and feature in it, of every class the k values next before (or after) the range. A range that holds a class gives at
    least one, so the k nearest ranges of a class are enough; the windows run over a row for each range, feature and class."""
    ends = _ends(own, k, last=before)
    grid = own.select("_p", "feature").distinct().join(own.select("feature", "y").distinct(), "feature")
    towards = F.col("_p").asc() if before else F.col("_p").desc()
    classes = Window.partitionBy("feature", "y").orderBy(towards)
    known = ends.withColumn("near", F.flatten(F.collect_list("values").over(classes.rowsBetween(-k, 0))))
    nearest = F.slice(F.sort_array("near", asc=not before), 1, k)
    held = grid.join(known.select("feature", "y", "_p", nearest.alias("near")), ["feature", "y", "_p"], "left")
    seen = held.withColumn("near", F.last("near", ignorenulls=True).over(classes.rowsBetween(Window.unboundedPreceding, -1)))
    return seen.select("_p", "feature", "y", F.explode("near").alias("v")).select("_p", "feature", "v.x", "y", "v.n")


def _radii(counts: DataFrame, gaps: dict, k: int) -> DataFrame:
    """counts with r, the distance of each point to its k-th nearest other one. Points are sorted into ranges by feature and value; each range gets the values next to
    it, class by class (_halos), so no task sees more than a range. gaps: by feature and two classes."""
    ranges = max(1, counts.count() // RANGE_POINTS, int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    own = saved(counts.repartitionByRange(ranges, "feature", "x").sortWithinPartitions("feature", "x", "y").withColumn("_p", F.spark_partition_id()))
    both = own.select("_p", "feature", "x", "y", "n", F.lit(0).alias("halo"))
    for before in (True, False):
        both = both.unionByName(_halos(own, k, before).withColumn("halo", F.lit(1)))

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("x", kind="stable")
        feature = part["feature"].iloc[0]
        values = {y: np.repeat(g["x"].to_numpy(), np.minimum(g["n"].to_numpy(), k + 1)) for y, g in part.groupby("y")}
        mine = part[part["halo"] == 0]
        apart = {(a, b): gaps[feature, a, b] for a in values for b in values}
        return mine[["feature", "x", "y", "n"]].assign(r=kth_distances(mine["x"].to_numpy(), mine["y"].to_numpy(), values, apart, k))

    return both.groupBy("_p", "feature").applyInPandas(run, "feature string, x double, y double, n long, r double")


def _inside(points: DataFrame) -> DataFrame:
    """points (feature, x, n, r, id) with nx, the points of the feature between x - r and x + r, both left out; for r = 0 those at x. Both ends are
    put among the values in order, and a running sum of counts is read there."""
    low, high = F.when(F.col("r") > 0, F.col("x") - F.col("r")).otherwise(F.col("x")), F.when(F.col("r") > 0, F.col("x") + F.col("r")).otherwise(F.col("x"))
    # side: at one value, a count up to and with it comes after the value, one up to it before
    at_low, at_high = F.when(F.col("r") > 0, 2).otherwise(0), F.when(F.col("r") > 0, 0).otherwise(2)
    asked = points.select("feature", "id", F.explode(F.array(F.struct(low.alias("v"), at_low.alias("side"), F.lit(-1).alias("sign")), F.struct(high.alias("v"), at_high.alias("side"), F.lit(1).alias("sign")))).alias("q"))
    rows = points.groupBy("feature", F.col("x").alias("v")).agg(F.sum("n").alias("n")).select("feature", "v", F.lit(1).alias("side"), "n", F.lit(0).alias("sign"), F.lit(None).cast("long").alias("id"))
    rows = rows.unionByName(asked.select("feature", "q.v", "q.side", F.lit(0).cast("long").alias("n"), "q.sign", "id"))
    upto = running_total(rows, ["feature", "v", "side"], F.col("n"), "upto")
    return upto.where("id is not null").groupBy("id").agg(F.sum(F.col("sign") * F.col("upto")).alias("nx"))


def knn_information(df: DataFrame, columns: Sequence[str], target: str = "class", k: int = 3) -> DataFrame:
    """feature, n and mutual_info (natural log, 0 at least) of each numeric column with the target, a class given by a number, from the distance of each row to its
    k-th nearest: digamma(n) + digamma(k) - mean(digamma(nx)) - mean(digamma(ny)), nx and ny being the rows, itself included, that are nearer in the
    column and in the class. Both are taken in units of their population standard deviation (1 where it is 0). No noise is added, so rows of equal values
    count as they are: where the k-th nearest is at no distance, nx and ny count the rows at none.

    Rows with a null or NaN in the column or the target are left out, as are columns with fewer than five rows left or no more than k. More than MOST_CLASSES
    classes are an error. All columns are worked on together, from the counts of distinct (column, value, class)."""
    cells = F.explode(F.array(*(F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("x")) for c in columns)))
    long = df.select(F.col(target).cast("double").alias("y"), cells.alias("z")).select("z.feature", "z.x", "y").where("x is not null and y is not null and not isnan(x) and not isnan(y)")
    counts = saved(long.groupBy("feature", "x", "y").agg(F.count("*").alias("n")))
    if counts.select("y").distinct().count() > MOST_CLASSES:
        raise ValueError(f"{target} has more than {MOST_CLASSES} values")
    mean = lambda c: F.sum(F.col("n") * F.col(c)) / F.sum("n")
    means = counts.groupBy("feature").agg(F.sum("n").alias("all"), mean("x").alias("mx"), mean("y").alias("my")).where((F.col("all") >= 5) & (F.col("all") > k))
    centred = counts.join(F.broadcast(means), "feature")
    spread = lambda c: F.sqrt(F.sum(F.col("n") * (F.col(c) - F.col(f"m{c}")) ** 2) / F.sum("n"))
    scales = {r.feature: (r.sx or 1.0, r.sy or 1.0) for r in centred.groupBy("feature").agg(spread("x").alias("sx"), spread("y").alias("sy")).collect()}
    held = {(r.feature, r.y): r.n for r in counts.groupBy("feature", "y").agg(F.sum("n").alias("n")).collect() if r.feature in scales}
    classes = {f: [y for g, y in held if g == f] for f in scales}
    gaps = {(f, a, b): abs(a - b) * sx / sy for f, (sx, sy) in scales.items() for a in classes[f] for b in classes[f]}
    points = saved(_radii(centred.select("feature", "x", "y", "n"), gaps, k).withColumn("id", F.monotonically_increasing_id()))
    spark = df.sparkSession
    apart = spark.createDataFrame([(f, a, g, held[f, b]) for (f, a, b), g in gaps.items()], "feature string, y double, gap double, size long")
    ny = points.join(F.broadcast(apart), ["feature", "y"]).where("gap < r or (r = 0 and gap = 0)").groupBy("id").agg(F.sum("size").alias("ny"))
    both = points.join(_inside(points), "id").join(ny, "id").groupBy("feature").agg(F.sum("n").alias("n"), (F.sum(F.col("n") * (digamma(F.col("nx")) + digamma(F.col("ny")))) / F.sum("n")).alias("lost"))
    return both.select("feature", "n", F.greatest(F.lit(0.0), digamma(F.col("n")) + digamma(F.lit(k)) - F.col("lost")).alias("mutual_info"))
