"""Places of rows in a sorted table, quantiles and ranks, without a task that sees the whole table or a whole group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import saved
from .exprs import dense_rank_known, pct_rank_within


def running_total(df: DataFrame, by: Sequence[str | Column], amount: Column, out: str) -> DataFrame:
    """df with the sum of amount over its rows up to and with each row, in the order of by. Rows are dealt into ranges of that order; a
    window runs inside each range, and one over the ranges' sums, which are as many as there are partitions."""
    ranged = saved(df.withColumn("_amount", amount).repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_m", F.monotonically_increasing_id()))
    ranged = ranged.withColumn("_p", F.shiftright("_m", 33))
    sums = ranged.groupBy("_p").agg(F.sum("_amount").alias("_n"))
    before = sums.select("_p", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_b"))
    inside = F.sum("_amount").over(Window.partitionBy("_p").orderBy("_m").rowsBetween(Window.unboundedPreceding, 0))
    return ranged.withColumn("_inside", inside).join(F.broadcast(before), "_p").withColumn(out, F.col("_b") + F.col("_inside")).drop("_p", "_m", "_b", "_inside", "_amount")


def numbered(df: DataFrame, by: Sequence[str | Column], out: str) -> DataFrame:
    """df with each row's place, from 0, in the order of by. Ids of a sort by ranges hold partition and place in it, so numbering takes the
    ranges' row counts only."""
    ranged = saved(df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_m", F.monotonically_increasing_id()))
    ranged = ranged.withColumn("_p", F.shiftright("_m", 33))
    sizes = ranged.groupBy("_p").agg(F.count("*").alias("_n"))
    before = sizes.select("_p", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_b"))
    place = F.col("_b") + F.col("_m").bitwiseAND(F.lit((1 << 33) - 1))
    return ranged.join(F.broadcast(before), "_p").withColumn(out, place).drop("_p", "_m", "_b")


def quantiles(df: DataFrame, wanted: dict[str, Sequence[float]]) -> dict[str, list[float | None]]:
    """Exact quantiles of numeric columns, linear between neighbours, nulls left out: {column: fractions} gives {column: values}, null for
    a column without values. Values are counted, the counts are summed by ranges, and only the few rows around the wanted places reach the driver."""
    names = list(wanted)
    cells = F.explode(F.array(*(F.struct(F.lit(i).alias("c"), F.col(n).cast("double").alias("v")) for i, n in enumerate(names))))
    counts = df.select(cells.alias("x")).select("x.c", "x.v").where("v is not null").groupBy("c", "v").agg(F.count("*").alias("n"))
    upto = running_total(counts, ["c", "v"], F.col("n"), "upto")
    totals = {r.c: r.n for r in upto.groupBy("c").agg(F.sum("n").alias("n")).collect()}
    base, places = 0, {}
    for i, n in enumerate(names):
        for q in wanted[n]:
            at = q * (totals[i] - 1) if i in totals else 0.0
            places[i, q] = (base, int(at), at - int(at))
        base += totals.get(i, 0)
    around = sorted({b + k for (i, _), (b, k, _) in places.items() if i in totals for k in (k, min(k + 1, totals[i] - 1))})
    if not around:
        return {n: [None] * len(wanted[n]) for n in names}
    start = F.col("upto") - F.col("n")
    table = df.sparkSession.createDataFrame([(x,) for x in around], "_at long")
    got = {r._at: r.v for r in upto.join(F.broadcast(table), (F.col("_at") >= start) & (F.col("_at") < F.col("upto"))).select("_at", "v").collect()}

    def value(i: int, q: float) -> float | None:
        if i not in totals:
            return None
        b, k, part = places[i, q]
        low, high = got[b + k], got[b + min(k + 1, totals[i] - 1)]
        return low + (high - low) * part if part else low

    return {n: [value(i, q) for q in wanted[n]] for i, n in enumerate(names)}


#: Rows of a group up to which one task ranks it in a window; larger groups are ranked by ranges.
GROUP_ROWS = 2_000_000


def with_global_pct_rank(df: DataFrame, value: str, out: str) -> DataFrame:
    """df with the percentile rank of value over the whole table, ties at their average place; nulls get none and don't count."""
    counts = df.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("_v")).agg(F.count("*").alias("_n"))
    upto = running_total(counts, ["_v"], F.col("_n"), "_upto")
    everything = upto.agg(F.sum("_n").alias("_all"))
    places = upto.crossJoin(F.broadcast(everything)).select("_v", ((F.col("_upto") - (F.col("_n") - 1) / 2) / F.col("_all")).alias(out))
    return df.join(places, F.col(value) == F.col("_v"), "left").drop("_v")


def _pct_by_ranges(df: DataFrame, keys: Sequence[str], values: dict[str, str]) -> DataFrame:
    for out, value in values.items():
        v = F.round(F.col(value).cast("double"), 9)
        rows = df.withColumn("_v", v)
        counts = running_total(rows.where("_v is not null").groupBy(*keys, "_v").agg(F.count("*").alias("_n")), [*keys, "_v"], F.col("_n"), "_upto")
        groups = counts.groupBy(*keys).agg(F.min(F.col("_upto") - F.col("_n")).alias("_before"), F.sum("_n").alias("_all"))
        pct = ((F.col("_upto") - F.col("_before")) - (F.col("_n") - 1) / 2) / F.col("_all")
        places = counts.join(F.broadcast(groups), [*keys]).select(*keys, "_v", pct.alias(out))
        df = rows.join(places, [*keys, "_v"], "left").drop("_v")
    return df


def _dense_by_ranges(df: DataFrame, keys: Sequence[str], values: dict[str, tuple[str, bool]]) -> DataFrame:
    for out, (value, ascending) in values.items():
        rows = df.withColumn("_v", F.round(F.col(value).cast("double"), 9))
        distinct = rows.where("_v is not null").select(*keys, "_v").distinct()
        placed = numbered(distinct, [*keys, F.col("_v").asc() if ascending else F.col("_v").desc()], "_place")
        first = placed.groupBy(*keys).agg(F.min("_place").alias("_first"))
        ranks = placed.join(F.broadcast(first), [*keys]).select(*keys, "_v", (F.col("_place") - F.col("_first") + 1).alias(out))
        df = rows.join(ranks, [*keys, "_v"], "left").drop("_v")
    return df


def large_groups(df: DataFrame, keys: Sequence[str], group_rows: int = GROUP_ROWS) -> DataFrame | None:
    """The keys of the groups of more than group_rows rows, None where there are none."""
    large = saved(df.groupBy(*keys).agg(F.count("*").alias("_size")).where(F.col("_size") > group_rows).select(*keys))
    return large if large.take(1) else None


def _ranked(df: DataFrame, keys: Sequence[str], large: DataFrame | None, in_window, by_ranges) -> DataFrame:
    if large is None:
        return in_window(df)
    small = df.join(F.broadcast(large), [*keys], "left_anti")
    return in_window(small).unionByName(by_ranges(saved(df.join(F.broadcast(large), [*keys], "left_semi"))))


def with_pct_ranks(df: DataFrame, keys: Sequence[str], values: dict[str, str], large: DataFrame | None = None) -> DataFrame:
    """df with percentile ranks {new column: value column} within keys, values at nine decimals, ties at their average place; nulls get none and
    don't count. Groups are ranked in windows; the large ones (see large_groups) by value counts and ranges, so no task holds one."""
    windows = {out: pct_rank_within(value, keys) for out, value in values.items()}
    return _ranked(df, keys, large, lambda d: d.withColumns(windows), lambda d: _pct_by_ranges(d, keys, values))


def with_dense_ranks(df: DataFrame, keys: Sequence[str], values: dict[str, tuple[str, bool]], large: DataFrame | None = None) -> DataFrame:
    """df with dense ranks {new column: (value column, ascending)} within keys, values at nine decimals; nulls get none. Large groups as in
    with_pct_ranks."""
    windows = {out: dense_rank_known(F.col(value), keys, ascending) for out, (value, ascending) in values.items()}
    return _ranked(df, keys, large, lambda d: d.withColumns(windows), lambda d: _dense_by_ranges(d, keys, values))


def with_places(df: DataFrame, keys: Sequence[str], by: Sequence[str | Column], out: str, large: DataFrame | None = None) -> DataFrame:
    """df with each row's place in its group, from 0, in the order of by. Large groups (see large_groups) are numbered by ranges."""

    def in_window(d: DataFrame) -> DataFrame:
        return d.withColumn(out, (F.row_number().over(Window.partitionBy(*keys).orderBy(*by)) - 1).cast("long"))

    def by_ranges(d: DataFrame) -> DataFrame:
        placed = numbered(d, [*keys, *by], "_at")
        first = placed.groupBy(*keys).agg(F.min("_at").alias("_first"))
        return placed.join(F.broadcast(first), [*keys]).withColumn(out, F.col("_at") - F.col("_first")).select(*d.columns, out)

    return _ranked(df, keys, large, in_window, by_ranges)
