"""Mixing sources to target weights by balanced sampling (cube method)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import join_groups, repeated, saved, shuffle_parts
from .textcore import by_key

BLOCK = 4096  # units that a task balances together
WEIGHTS = (3, 1, 2)


def word_count(text: Column) -> Column:
    """Number of runs of characters other than space, tab, line feed, vertical tab, form feed and carriage return."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source, source_size, target) from (source, size). Sources in order of code point, null last, take the weights in turn and
    share that part of all sizes; a target stops at most times its source's size, the rest is dealt anew by weight among the others.

    The outcome is min(most * size, level * weight) for one level: with sources in order of most * size / weight, those before some place
    are full. The windows run over one row for each source."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("_docs"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    w = F.element_at(F.array(*(F.lit(float(x)) for x in weights)), (F.pmod(place - 1, F.lit(len(weights))) + 1).cast("int"))
    per = per.withColumn("_w", w).withColumn("_cap", F.col("source_size") * F.lit(most)).withColumn("_full_at", F.col("_cap") / F.col("_w"))
    order = Window.orderBy("_full_at", F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    onward = order.rowsBetween(0, Window.unboundedFollowing)
    everything = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    per = per.withColumn("_level", (F.sum("source_size").over(everything) * F.lit(share) - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / F.sum("_w").over(onward))
    # the first source whose own level doesn't fill it sets the level for it and all after it
    per = per.withColumn("_level", F.first(F.when(F.col("_level") < F.col("_full_at"), F.col("_level")), ignorenulls=True).over(everything))
    return per.select("source", "source_size", F.least("_cap", F.coalesce(F.col("_level") * F.col("_w"), "_cap")).alias("target"))


def flight(p: np.ndarray, weight: np.ndarray, size: np.ndarray, seed: int) -> np.ndarray:
    """The flight phase: moves inclusion probabilities p at random, three units at a time, along the direction that keeps the total
    of weight and of weight * size, until two units at most are left strictly between 0 and 1. Expectations stay p."""
    p = p.astype(float).copy()
    rng = np.random.Generator(np.random.PCG64(seed))
    draws = iter(rng.random(4 * len(p) + 16).tolist())
    eps = 1e-9
    active: list[int] = []
    values, w, s = p.tolist(), weight.astype(float).tolist(), size.astype(float).tolist()

    def move(units: list[int], u: list[float]) -> None:
        up = down = float("inf")
        for k, d in zip(units, u, strict=True):
            if d > 0:
                up, down = min(up, (1 - values[k]) / d), min(down, values[k] / d)
            elif d < 0:
                up, down = min(up, -values[k] / d), min(down, (values[k] - 1) / d)
        step = up if next(draws, 0.5) * (up + down) < down else -down
        for k, d in zip(units, u, strict=True):
            values[k] = min(1.0, max(0.0, values[k] + step * d))
            if values[k] < eps or values[k] > 1 - eps:
                values[k] = float(round(values[k]))

    for k in range(len(values)):
        if not eps < values[k] < 1 - eps:
            values[k] = float(round(values[k]))
            continue
        active.append(k)
        while len(active) == 3:
            a, b, c = active
            # null space of the rows w and w * s
            u = [(s[c] - s[b]) / w[a], (s[a] - s[c]) / w[b], (s[b] - s[a]) / w[c]]
            if not any(u):
                u = [1 / w[a], -1 / w[b], 0.0]
            top = max(map(abs, u))
            move(active, [x / top for x in u])
            active = [x for x in active if 0 < values[x] < 1]
    if len(active) == 2 and s[active[0]] == s[active[1]]:
        move(active, [1 / w[active[0]], -1 / w[active[1]]])
    return np.array(values)


def nearest(p: np.ndarray, words: np.ndarray, aim: float) -> np.ndarray:
    """0 or 1 for each of a few units: the choice whose word total is nearest to aim; in a tie the one nearest to p."""
    choices = (np.arange(1 << len(p))[:, None] >> np.arange(len(p))) & 1
    off = np.abs(choices @ words - aim)
    return choices[np.lexsort(((np.abs(choices - p)).sum(axis=1), np.round(off, 6)))[0]].astype(float)


def landing(p: np.ndarray, weight: np.ndarray, size: np.ndarray, seed: int, few: int = 10) -> np.ndarray:
    """Flight and landing of a source's last block, given largest documents first. The larger half flies, its open units (two at most) are
    rounded, and what that adds or lacks in words is taken from or given to the probabilities of the smaller half; then the
    larger half of those, and so on. The last few units are chosen together, so the error left is about that of the smallest documents."""
    out = p.astype(float).copy()
    words = weight.astype(float) * size
    rest = np.flatnonzero((out > 0) & (out < 1))
    owed = 0.0  # words that the units rounded so far lack
    while len(rest) > few:
        half, rest = rest[: len(rest) // 2], rest[len(rest) // 2 :]
        before = float(out[half] @ words[half])
        out[half] = flight(out[half], weight[half], size[half], seed + len(rest))
        left = half[(out[half] > 0) & (out[half] < 1)]
        out[left] = nearest(out[left], words[left], float(out[left] @ words[left]) + owed)
        owed += before - float(out[half] @ words[half])
        total = float(words[rest].sum())
        if total:
            moved = np.clip(out[rest] + owed / total, 0.0, 1.0)
            owed -= float((moved - out[rest]) @ words[rest])
            out[rest] = moved
    rest = rest[(out[rest] > 0) & (out[rest] < 1)]
    out[rest] = nearest(out[rest], words[rest], float(out[rest] @ words[rest]) + owed)
    return out


CELLS = 20_000  # of word totals in the search of settled


def _improved(taken: np.ndarray, words: np.ndarray, off: float) -> tuple[list[int], float]:
    """The swap of a taken and an open unit, or the one unit to take or drop, after which the word total, now off too high, is nearest to its aim; with
    what it is off then. A swap is preferred in a tie, as it keeps the number of documents."""
    ones, zeros = np.flatnonzero(taken > 0), np.flatnonzero(taken == 0)
    best: tuple[list[int], float] = ([], off)
    if len(ones) and len(zeros):
        order = zeros[np.argsort(words[zeros], kind="stable")]
        at = np.searchsorted(words[order], words[ones] - off)
        for shift in (-1, 0):
            other = order[np.clip(at + shift, 0, len(order) - 1)]
            left = off - words[ones] + words[other]
            i = int(np.argmin(np.abs(left)))
            if abs(left[i]) < abs(best[1]):
                best = ([int(ones[i]), int(other[i])], float(left[i]))
    for units, sign in ((ones, -1), (zeros, 1)):
        if len(units):
            left = off + sign * words[units]
            i = int(np.argmin(np.abs(left)))
            if abs(left[i]) < abs(best[1]):
                best = ([int(units[i])], float(left[i]))
    return best


def _searched(taken: np.ndarray, words: np.ndarray, aim: float, seed: int) -> np.ndarray:
    """A choice of units whose word total is nearest to aim, by all totals that can be reached, in CELLS steps up to the aim and the largest unit. Units that
    are taken now are tried first."""
    limit = aim + float(words.max())
    step = max(1.0, limit / CELLS)
    cells = np.round(words / step).astype(np.int64)
    reached = np.full(int(limit / step) + 2, -1, np.int64)  # the unit by which a total was first reached
    reached[0] = len(words)
    order = np.random.Generator(np.random.PCG64(seed)).permutation(len(words))
    for i in order[np.argsort(-taken[order], kind="stable")].tolist():
        c = int(cells[i])
        if 0 < c < len(reached):
            new = np.flatnonzero((reached[:-c] >= 0) & (reached[c:] < 0)) + c
            reached[new] = i
    found = np.flatnonzero(reached >= 0)
    at, out = int(found[np.argmin(np.abs(found * step - aim))]), np.zeros(len(words))
    while at:
        i = int(reached[at])
        out[i], at = 1.0, at - int(cells[i])
    return out


def settled(taken: np.ndarray, words: np.ndarray, aim: float, seed: int, near: float = 0.001) -> np.ndarray:
    """taken (0 or 1 for each unit) with its word total brought near to aim: the best swap of two units, or unit to take or drop, as long as one helps and the total
    is off by more than near of the aim. If it then still is, all totals that can be reached are searched."""

    def swapped(out: np.ndarray) -> tuple[np.ndarray, float]:
        out, off = out.copy(), float(out @ words) - aim
        while abs(off) > near * aim:
            units, left = _improved(out, words, off)
            if abs(left) >= abs(off) - 1e-9:
                break
            out[units] = 1 - out[units]
            off = left
        return out, abs(off)

    out, off = swapped(taken)
    if len(words) and off > near * aim:
        other, less = swapped(_searched(out, words, aim, seed))
        out = other if less < off else out
    return out


_UNIT = "_s int, _k long, _id {kind}, _crc long, size long, m long, p double, base int"


def _fly(units: DataFrame, seed: int) -> DataFrame:
    """Units (_s, _k, ...) after the flight of each block; a source's only block also lands (_last)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for block in by_key(batches, ["_s", "_k"]):
            block = block.reset_index(drop=True)
            m, size = block["m"].to_numpy(), block["size"].to_numpy()
            last, before, own = bool(block["_last"][0]), block["p"].to_numpy(), seed * 1_000_003 + int(block["_s"][0]) * 8191 + int(block["_k"][0])
            p = (landing if last else flight)(before, m, size, own)
            if last:
                p = settled(p, m * size.astype(float), float(before @ (m * size)), own)
            yield block.drop(columns="_last").assign(p=p)

    dealt = units.repartition(shuffle_parts(units.sparkSession), "_s", "_k").sortWithinPartitions("_s", "_k", F.desc("size"), "_crc", "_id", "m", "p")
    return dealt.mapInPandas(run, _UNIT.format(kind=units.schema["_id"].dataType.simpleString()))


def _blocks(units: DataFrame, level: int) -> DataFrame:
    """Deals each source's open units into blocks of about BLOCK; _last where one is enough."""
    n = units.groupBy("_s").agg(F.ceil(F.count("*") / BLOCK).alias("_n"))
    return units.drop("_k").join(n, "_s").withColumn("_k", F.pmod(F.xxhash64(F.lit(level), "_id", "_crc"), F.col("_n"))).withColumn("_last", F.col("_n") == 1).drop("_n")


def mix_plan(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0, seed: int = 11) -> DataFrame:
    """One row for each distinct (_id, source, _crc, size): how many rows of docs it stands for (m), the source's size and target, and how
    often the mix takes each of them (copies).

    A unit is taken floor(r) times, r being target over size of its source, and once more with the rest of r as its inclusion probability.
    The cube method draws that: the flight moves probabilities in blocks of about BLOCK units of a source, keeping the source's
    total of documents and of words exactly; the two units or fewer that each block leaves open are gathered and fly again,
    level by level, until one block holds a source's last ones, lands them (see landing) and settles what is then off (see settled).
    Draws depend on seed and units alone, ties in size are ordered by hash and id. Nulls, repeated rows and very long texts as in mix_report; an empty
    table has an empty plan. Other columns are ignored.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id").alias("_id"), F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size"), F.xxhash64(text).alias("_crc"))
    units = saved(rows.groupBy("_id", "source", "size", "_crc").agg(F.count("*").alias("m")))
    targets = saved(source_targets(units.select("source", (F.col("size") * F.col("m")).alias("size"))).withColumn("_s", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    placed = units.join(targets, units["source"].eqNullSafe(targets["source"])).select("_s", F.lit(0).cast("long").alias("_k"), "_id", "_crc", "size", "m", (rate - F.floor(rate)).alias("p"), F.floor(rate).cast("int").alias("base"))
    done: list[DataFrame] = []
    level = 0
    while True:
        level += 1
        flown = saved(_fly(_blocks(placed, level), seed + level))
        done.append(flown.where("p = 0 or p = 1"))
        placed = flown.where("p > 0 and p < 1")
        if not placed.take(1):
            break
    out = done[0]
    for more in done[1:]:
        out = out.union(more)
    return out.join(targets, "_s").select("_id", "source", "_crc", "size", "m", "source_size", "target", (F.col("base") + F.col("p")).cast("long").alias("copies"))


def mix_report(docs: DataFrame, **options) -> DataFrame:
    """doc_id, size, source_size, target and taken (words the mix takes, repeats counted) of each row of docs.

    Size is the number of runs of characters other than white space; null texts have 0. A null source is a source of its own. Repeated rows
    (same id, source and text) are taken alike. Null ids are ids. Very long texts count whole. Other columns are ignored. An empty table gives no rows.
    """
    plan = mix_plan(docs, **options).select("_id", "m", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))
    return repeated(plan, "m").select(F.col("_id").alias("doc_id"), "size", "source_size", "target", "taken")


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: each row of docs as often as the plan takes it, with its own columns, whatever their names; rules as in mix_report. Units that
    stand for a large share of all rows are joined by broadcast."""
    plan = saved(mix_plan(docs, **options).select("_id", "source", "_crc", "m", F.col("copies").cast("int").alias("copies")))
    total = plan.agg(F.sum("m")).first()[0] or 0
    known = lambda c: F.struct(c.isNull().alias("null"), F.coalesce(c.cast("string"), F.lit("")).alias("value"))
    units = plan.select(known(F.col("_id")).alias("i"), known(F.col("source")).alias("s"), F.col("_crc").alias("c"), "m", "copies")
    whole = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    rows = docs.select(known(F.col("doc_id")).alias("i"), known(F.col("source").cast("string")).alias("s"), F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("c"), whole.alias("row"))
    taken = join_groups(rows, units, ["i", "s", "c"], "m", total).where("copies > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy")).select("row.*")
