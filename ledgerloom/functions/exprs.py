"""Column expressions shared by the operators."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def require_columns(df: DataFrame, names: Iterable[str]) -> None:
    """Raises ValueError naming the columns that df lacks."""
    if missing := [n for n in names if n not in df.columns]:
        raise ValueError(f"missing columns: {', '.join(missing)}")


def safe_div(a: Column, b: Column) -> Column:
    """a / b as double, null where b is 0."""
    return a.cast("double") / F.nullif(b.cast("double"), F.lit(0.0))


def code_label(code: Column, labels: dict) -> Column:
    """The label of a code, null for any other."""
    out = F.lit(None).cast("string")
    for k, v in labels.items():
        out = F.when(code == F.lit(k), F.lit(v)).otherwise(out)
    return out


def dense_rank_known(value: Column, keys: Sequence[str], ascending: bool = False) -> Column:
    """Dense rank within keys as long; nulls get none. Values are compared at nine decimals, so that the order of summation can't
    split ties."""
    shown = F.round(value.cast("double"), 9)
    order = shown.asc_nulls_last() if ascending else shown.desc_nulls_last()
    return F.when(value.isNotNull(), F.dense_rank().over(Window.partitionBy(*keys).orderBy(order)).cast("long"))


def pct_rank_within(value: str, keys: Sequence[str]) -> Column:
    """Percentile rank within keys, ties at their average place; nulls get none and don't count."""
    v = F.round(F.col(value).cast("double"), 9)
    place = F.rank().over(Window.partitionBy(*keys).orderBy(v.asc_nulls_last()))
    ties = F.count(v).over(Window.partitionBy(*keys, v))
    return F.when(v.isNotNull(), (place + (ties - 1) / 2) / F.count(v).over(Window.partitionBy(*keys)))


def cut(value: Column, edges: Sequence[float], labels: Sequence, right: bool = False, lowest: bool = True) -> Column:
    """The label of the interval of edges that holds value: [a, b), or (a, b] with right, then the least edge belongs to the first
    interval if lowest. Null outside."""
    out = F.lit(None)
    for i in reversed(range(len(edges) - 1)):
        a, b = F.lit(float(edges[i])), F.lit(float(edges[i + 1]))
        inside = (value > a) & (value <= b) if right else (value >= a) & (value < b)
        if right and lowest and i == 0:
            inside = (value >= a) & (value <= b)
        out = F.when(inside, F.lit(labels[i])).otherwise(out)
    return out


def parse_address_list(value: Column) -> Column:
    """Addresses in a text: null or blank gives none; a bracketed list is read as JSON with single quotes for double ones; anything else is
    split at ; , or |. Entries are trimmed, blank ones dropped."""
    text = F.trim(value)
    listed = F.from_json(F.regexp_replace(F.regexp_replace(F.regexp_replace(text, r"^\(", "["), r"\)$", "]"), "'", '"'), "array<string>")
    parts = F.when(text.rlike(r"^[\[(]"), F.coalesce(listed, F.split(text, r"[;,|]+"))).otherwise(F.split(text, r"[;,|]+"))
    return F.coalesce(F.filter(F.transform(parts, lambda x: F.trim(x)), lambda x: x != ""), F.array().cast("array<string>"))
