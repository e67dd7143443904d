"""Graph metrics of each subnetwork and the percentile-based composite score."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import require_columns
from ..functions.places import GROUP_ROWS, large_groups, running_total, with_dense_ranks, with_pct_ranks, with_places
from ..sources.tables import saved

GROUP = "merged_subnetwork_id"
WEIGHTS = {"pr": 0.60, "val": 0.30, "in": 0.07, "out": 0.03}
EPS = 1e-12


def simple_edges(edges: DataFrame, weight: str | None = None) -> DataFrame:
    """One row for each (group, src, dst): g, s, d and w, the sum of weight or 1; null ends are dropped."""
    e = edges.where("src_txn_id is not null and dst_txn_id is not null").groupBy(F.col(GROUP).alias("g"), F.col("src_txn_id").alias("s"), F.col("dst_txn_id").alias("d"))
    return e.agg((F.sum(weight).cast("double") if weight else F.lit(1.0)).alias("w"))


def _nodes(e: DataFrame) -> DataFrame:
    return e.select("g", F.col("s").alias("node")).union(e.select("g", F.col("d").alias("node"))).distinct()


def _spread(df: DataFrame, *keys: str, parts: int = 1) -> DataFrame:
    """df dealt by keys into a fixed number of partitions, at least as many as a shuffle has. Adaptive execution would put small partitions together by their bytes,
    but a group's work is far more than its bytes, and one task would be left with all of it."""
    return df.repartition(max(parts, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))), *keys)


#: Edges of a group up to which one task iterates over it in memory (some 30 MB); larger groups iterate as distributed tables.
GROUP_EDGES = 500_000


def _each_group(e: DataFrame, run, schema: str, call_edges: int = 50_000) -> DataFrame:
    """run on the edges of each group (e: g, n = edges of the group, ...). Groups of up to call_edges edges share a Python call with others."""
    calls = max(1, (e.agg(F.count("*").alias("k")).first().k or 0) // call_edges, int(e.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    call = F.when(F.col("n") > call_edges, F.xxhash64("g")).otherwise(F.pmod(F.xxhash64("g"), F.lit(calls)))

    def many(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.concat([run(own) for _, own in pdf.groupby("g", sort=False)])

    return _spread(e.withColumn("_call", call), "_call", parts=calls).groupBy("_call").applyInPandas(many, schema)


def _pagerank_small(alpha: float, max_iter: int, tol: float):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        nodes, at = np.unique(np.concatenate([pdf["s"], pdf["d"]]), return_inverse=True)
        n, (s, d) = len(nodes), (at[: len(pdf)], at[len(pdf) :])
        out = np.bincount(s, pdf["w"], n)
        share, pr, done = pdf["w"].to_numpy() / out[s], np.full(n, 1 / n), False
        for _ in range(max_iter):
            new = (1 - alpha) / n + alpha * (np.bincount(d, pr[s] * share, n) + pr[out == 0].sum() / n)
            done = bool(np.abs(new - pr).sum() < n * tol)
            pr = new
            if done:
                break
        return pd.DataFrame({"g": pdf["g"].iloc[0], "node": nodes, "pr": pr, "done": done})

    return run


def _pagerank_large(e: DataFrame, alpha: float, max_iter: int, tol: float) -> DataFrame:
    """Power iteration of whole tables; every round is saved, so its plan never holds an earlier round."""
    out = e.groupBy("g", F.col("s").alias("node")).agg(F.sum("w").alias("out_w"))
    base = _nodes(e).join(out, ["g", "node"], "left")
    state = saved(base.join(base.groupBy("g").agg(F.count("*").alias("n")), "g").select("g", "node", "out_w", "n", (1 / F.col("n")).alias("pr"), F.lit(False).alias("done")))
    links = saved(e.select("g", F.col("s").alias("node"), "d", "w"))
    for _ in range(max_iter):
        if not state.where("not done").take(1):
            break
        flow = state.join(links, ["g", "node"]).groupBy("g", F.col("d").alias("node")).agg(F.sum(F.col("pr") * F.col("w") / F.col("out_w")).alias("flow"))
        lost = state.groupBy("g").agg(F.sum(F.when(F.col("out_w").isNull(), F.col("pr")).otherwise(0.0)).alias("lost"))
        new = state.join(flow, ["g", "node"], "left").join(lost, "g").withColumn("next", (1 - alpha) / F.col("n") + alpha * (F.coalesce("flow", F.lit(0.0)) + F.col("lost") / F.col("n")))
        new = saved(new.select("g", "node", "out_w", "n", "pr", "done", F.when(F.col("done"), F.col("pr")).otherwise(F.col("next")).alias("next")))
        change = new.groupBy("g").agg(F.sum(F.abs(F.col("next") - F.col("pr"))).alias("change"))
        state = saved(new.join(change, "g").select("g", "node", "out_w", "n", F.col("next").alias("pr"), (F.col("done") | (F.col("change") < F.col("n") * tol)).alias("done")))
    return state.select("g", "node", "pr", "done")


def pagerank(edges: DataFrame, weight: str | None = None, alpha: float = 0.85, max_iter: int = 100, tol: float = 1e-8, group_edges: int = GROUP_EDGES) -> DataFrame:
    """(group, node, pagerank, pr_rank, converged) by power iteration with uniform teleport and dangling mass. A group stops when its change
    is below N * tol; one that doesn't get there keeps its last values with converged = false. Groups of up to group_edges edges are
    each iterated in one task; larger ones by joins, never gathered."""
    e = saved(simple_edges(edges, weight))
    sizes = e.groupBy("g").agg(F.count("*").alias("n"))
    small = e.join(sizes.where(F.col("n") <= group_edges), "g")
    state = _each_group(small, _pagerank_small(alpha, max_iter, tol), "g long, node long, pr double, done boolean")
    large = sizes.where(F.col("n") > group_edges).select(F.col("g").alias(GROUP))
    if any_large := bool(large.take(1)):
        state = state.union(_pagerank_large(e.join(large.withColumnRenamed(GROUP, "g"), "g", "left_semi"), alpha, max_iter, tol))
    named = state.select(F.col("g").alias(GROUP), "node", F.col("pr").alias("pagerank"), F.col("done").alias("converged"))
    return with_dense_ranks(named, [GROUP], {"pr_rank": ("pagerank", False)}, large if any_large else None).select(GROUP, "node", "pagerank", "pr_rank", "converged")


def complete_pagerank(pr: DataFrame, nodes: DataFrame) -> DataFrame:
    """(group, node, pagerank) of every node of the groups; one without a value gets 1 over its group's size."""
    n = nodes.select(GROUP, F.col("txn_id").alias("node")).distinct()
    sized = n.join(n.groupBy(GROUP).agg(F.count("*").alias("_n")), GROUP)
    return sized.join(pr.select(GROUP, "node", "pagerank"), [GROUP, "node"], "left").select(GROUP, "node", F.coalesce("pagerank", 1 / F.col("_n")).alias("pagerank"))


def degrees(edges: DataFrame, group_rows: int = GROUP_ROWS) -> DataFrame:
    """in_degree, out_degree, rank_inDeg (largest first) and rank_outDeg (smallest first) on the simple graph."""
    e = saved(simple_edges(edges))
    o, i = e.groupBy("g", F.col("s").alias("node")).agg(F.count("*").alias("o")), e.groupBy("g", F.col("d").alias("node")).agg(F.count("*").alias("i"))
    both = o.join(i, ["g", "node"], "full").select(F.col("g").alias(GROUP), "node", F.coalesce("i", F.lit(0)).alias("in_degree"), F.coalesce("o", F.lit(0)).alias("out_degree"))
    large = large_groups(e.select(F.col("g").alias(GROUP)), [GROUP], group_rows)
    return with_dense_ranks(both, [GROUP], {"rank_inDeg": ("in_degree", False), "rank_outDeg": ("out_degree", True)}, large)


def min_hops(edges: DataFrame) -> DataFrame:
    """Least hop of each node over its roles as source and target of an edge."""
    a = edges.select(GROUP, F.col("src_txn_id").alias("node"), F.col("min_src_hop").alias("h"))
    b = edges.select(GROUP, F.col("dst_txn_id").alias("node"), F.col("min_dst_hop").alias("h"))
    return a.union(b).groupBy(GROUP, "node").agg(F.min("h").alias("min_hop"))


def _paths(pdf: pd.DataFrame, sources: np.ndarray, between: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(nodes, harmonic, through) of one group from some of its sources at once: for each node the sum of 1/distance from the sources, and with
    between the sum of the shares of their shortest paths that pass it. All sources advance together, a layer a round, over flat (source, node)
    places; shares are gathered backwards, layer by layer, so work is sources x edges."""
    nodes, at = np.unique(np.concatenate([pdf["s"], pdf["d"]]), return_inverse=True)
    n, s, d = len(nodes), at[: len(pdf)], at[len(pdf) :]
    order = np.argsort(s, kind="stable")
    far, first = d[order], np.searchsorted(s[order], np.arange(n + 1))
    k = len(sources)
    hop, paths = np.full(k * n, -1, np.int32), np.zeros(k * n)
    front = np.arange(k) * n + np.searchsorted(nodes, sources)
    hop[front], paths[front] = 0, 1.0
    harmonic, layers, h = np.zeros(n), [], 0
    while len(front):
        h += 1
        v = front % n
        count = first[v + 1] - first[v]
        total = int(count.sum())
        if not total:
            break
        a = np.repeat(front, count)
        edge = np.arange(total) - np.repeat(np.cumsum(count) - count, count) + np.repeat(first[v], count)
        b = a - a % n + far[edge]
        new = hop[b] < 0
        a, b = a[new], b[new]
        if not len(b):
            break
        front, place = np.unique(b, return_inverse=True)
        paths[front] = np.bincount(place, paths[a], len(front))
        hop[front] = h
        harmonic += np.bincount(front % n, minlength=n) / h
        if between:
            layers.append((a, b))
    through = np.zeros(n)
    if between:
        share = np.zeros(k * n)
        for a, b in reversed(layers):
            up, place = np.unique(a, return_inverse=True)
            share[up] += np.bincount(place, paths[a] / paths[b] * (1 + share[b]), len(up))
        share[np.arange(k) * n + np.searchsorted(nodes, sources)] = 0.0
        through = share.reshape(k, n).sum(axis=0)
    return nodes, harmonic, through


#: Places (source, node) and (source, edge) that one task holds at once.
PATH_CELLS = 4_000_000
#: Tasks that a group's sources are dealt to at most; a task with more sources than it can hold at once goes through them in turn.
PATH_TASKS = 256


def _path_sums(edges: DataFrame, limit: int | None, between: bool, cells: int = PATH_CELLS, tasks: int = PATH_TASKS) -> DataFrame:
    """(g, node, h): path values of all groups, or with a limit of those of at most so many nodes. The sources of a group are dealt into blocks; each block is one task's
    work over the group's edges, as many sources at once as fit in memory, and the blocks' sums are added up."""
    e = saved(simple_edges(edges).select("g", "s", "d"))
    nodes = saved(_nodes(e))
    sizes = nodes.groupBy("g").agg(F.count("*").alias("n")).join(e.groupBy("g").agg(F.count("*").alias("m")), "g")
    if limit is not None:
        sizes = sizes.where(F.col("n") <= limit)
    each = F.greatest(F.lit(1), F.floor(F.lit(cells) / (F.col("n") + F.col("m"))))
    blocks = saved(sizes.select("g", F.least(F.lit(tasks), F.greatest(F.lit(1), F.ceil(F.col("n") / each))).cast("long").alias("blocks")))
    sources = nodes.join(blocks, "g").groupBy(F.col("g").alias("sg"), F.pmod(F.xxhash64("node"), F.col("blocks")).alias("sb")).agg(F.collect_list("node").alias("sources"))
    dealt = e.join(blocks, "g").select("g", "s", "d", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"))

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"g": [], "node": [], "h": []}).astype({"g": "int64", "node": "int64"})
        own, total = np.array(right["sources"].iloc[0]), 0.0
        once = max(1, cells // (len(np.unique(left[["s", "d"]].to_numpy())) + len(left)))
        for at in range(0, len(own), once):
            found, harmonic, through = _paths(left, own[at : at + once], between)
            total = total + (through if between else harmonic)
        return pd.DataFrame({"g": left["g"].iloc[0], "node": found, "h": total})

    parts = _spread(dealt, "g", "block").groupBy("g", "block").cogroup(_spread(sources, "sg", "sb").groupBy("sg", "sb")).applyInPandas(run, "g long, node long, h double")
    return parts.groupBy("g", "node").agg(F.sum("h").alias("h"))


def harmonic(edges: DataFrame, limit: int | None = None) -> DataFrame:
    """Sum of 1/distance from the other nodes of the group; with a limit, 0 in groups of more nodes."""
    return _with_all(edges, _path_sums(edges, limit, False), "harmonic")


def betweenness(edges: DataFrame, limit: int | None = None) -> DataFrame:
    """Share of shortest paths between two others that pass a node, normalised by (N-1)(N-2); with a limit, 0 in groups of more nodes."""
    total = _path_sums(edges, limit, True)
    n = _nodes(simple_edges(edges)).groupBy("g").agg(F.count("*").alias("n"))
    return _with_all(edges, total.join(n, "g").select("g", "node", (F.col("h") / F.nullif((F.col("n") - 1) * (F.col("n") - 2), F.lit(0))).alias("h")), "betweenness")


def _with_all(edges: DataFrame, values: DataFrame, name: str) -> DataFrame:
    out = saved(_nodes(simple_edges(edges))).join(values, ["g", "node"], "left").select(F.col("g").alias(GROUP), "node", F.coalesce("h", F.lit(0.0)).alias(name))
    large = large_groups(out.select(GROUP), [GROUP])
    return with_dense_ranks(out, [GROUP], {f"rank_{name}": (name, False)}, large)


#: Nodes of a group up to which Katz is solved as a dense matrix (32 MB); larger groups iterate.
MATRIX_NODES = 2_000


class _Arrays:
    """The simple graph of one group in memory. A vector is an array with a value for each node."""

    def __init__(self, pdf: pd.DataFrame):
        self.nodes, at = np.unique(np.concatenate([pdf["s"], pdf["d"]]), return_inverse=True)
        self.n, self.s, self.d = len(self.nodes), at[: len(pdf)], at[len(pdf) :]

    def undirected(self) -> _Arrays:
        out = object.__new__(_Arrays)
        pairs = np.unique(np.concatenate([self.s * self.n + self.d, self.d * self.n + self.s]))
        out.nodes, out.n, out.s, out.d = self.nodes, self.n, pairs // self.n, pairs % self.n
        return out

    def full(self, value: float) -> np.ndarray:
        return np.full(self.n, value)

    def along(self, x: np.ndarray) -> np.ndarray:
        """Of each node, the sum of x over the sources of its edges."""
        return np.bincount(self.d, x[self.s], self.n)

    def against(self, x: np.ndarray) -> np.ndarray:
        """Of each node, the sum of x over the targets of its edges."""
        return np.bincount(self.s, x[self.d], self.n)

    def mix(self, a: float, x: np.ndarray, b: float, y: np.ndarray) -> np.ndarray:
        return a * x + b * y

    def scale(self, a: float, x: np.ndarray) -> np.ndarray:
        return a * x

    def dot(self, x: np.ndarray, y: np.ndarray) -> float:
        return float(x @ y)

    def gap(self, x: np.ndarray, y: np.ndarray) -> float:
        return float(np.abs(x - y).sum())

    def settled(self, x: np.ndarray, last: np.ndarray, before: np.ndarray | None, tol: float) -> bool:
        """Whether rounding alone moves x: it equals one of the two before it. A tolerance would leave errors that ranks at nine decimals can show."""
        return np.array_equal(x, last) or before is not None and np.array_equal(x, before)

    def total(self, x: np.ndarray) -> float:
        return float(x.sum())

    def peak(self, x: np.ndarray) -> float:
        return float(x.max())

    def solved_katz(self, alpha: float) -> np.ndarray | None:
        """The dense solution of a small group (zeros where it has none), else None."""
        if self.n > MATRIX_NODES:
            return None
        m = np.eye(self.n)
        m[self.d, self.s] -= alpha
        try:
            return np.linalg.solve(m, np.ones(self.n))
        except np.linalg.LinAlgError:
            return np.zeros(self.n)

    def coreness(self) -> np.ndarray:
        """By peeling the undirected graph, least degree first; a self-loop anywhere makes the group's values zero."""
        if (self.s == self.d).any():
            return np.zeros(self.n)
        u = self.undirected()
        degree = np.bincount(u.s, minlength=self.n)
        at, near, left = [0, *np.cumsum(degree).tolist()], u.d.tolist(), degree.tolist()
        waiting: list[list[int]] = [[] for _ in range(max(left) + 1)]
        for v, k in enumerate(left):
            waiting[k].append(v)
        core, k = [-1] * self.n, 0
        while k < len(waiting):
            if not waiting[k]:
                k += 1
                continue
            v = waiting[k].pop()
            if core[v] >= 0 or left[v] > k:
                continue
            core[v] = k
            for w in near[at[v] : at[v + 1]]:
                if core[w] < 0 and left[w] > k:
                    left[w] -= 1
                    waiting[left[w]].append(w)
        return np.array(core, float)


class _Tables:
    """The same for a group that is never gathered. A vector is a table (node, x); each is saved, so no plan holds an earlier round."""

    def __init__(self, e: DataFrame):
        self.e = e.select("s", "d")
        self.nodes = saved(_nodes(e).select("node"))
        self.n = self.nodes.count()

    def undirected(self) -> _Tables:
        out = object.__new__(_Tables)
        out.nodes, out.n, out.e = self.nodes, self.n, saved(self.e.union(self.e.select("d", "s")).distinct())
        return out

    def full(self, value: float) -> DataFrame:
        return self.nodes.withColumn("x", F.lit(float(value)))

    def _sums(self, x: DataFrame, near: str, far: str) -> DataFrame:
        flow = self.e.join(x.withColumnRenamed("node", near), near).groupBy(F.col(far).alias("node")).agg(F.sum("x").alias("x"))
        return saved(self.nodes.join(flow, "node", "left").select("node", F.coalesce("x", F.lit(0.0)).alias("x")))

    def along(self, x: DataFrame) -> DataFrame:
        return self._sums(x, "s", "d")

    def against(self, x: DataFrame) -> DataFrame:
        return self._sums(x, "d", "s")

    def _both(self, x: DataFrame, y: DataFrame) -> DataFrame:
        return x.join(y.withColumnRenamed("x", "y"), "node")

    def mix(self, a: float, x: DataFrame, b: float, y: DataFrame) -> DataFrame:
        return saved(self._both(x, y).select("node", (F.lit(a) * F.col("x") + F.lit(b) * F.col("y")).alias("x")))

    def scale(self, a: float, x: DataFrame) -> DataFrame:
        return saved(x.select("node", (F.lit(a) * F.col("x")).alias("x")))

    def dot(self, x: DataFrame, y: DataFrame) -> float:
        return self._both(x, y).agg(F.sum(F.col("x") * F.col("y"))).first()[0]

    def gap(self, x: DataFrame, y: DataFrame) -> float:
        return self._both(x, y).agg(F.sum(F.abs(F.col("x") - F.col("y")))).first()[0]

    def settled(self, x: DataFrame, last: DataFrame, before: DataFrame | None, tol: float) -> bool:
        """By tolerance: the order of a distributed sum changes, so rounding never settles."""
        return self.gap(x, last) < tol

    def total(self, x: DataFrame) -> float:
        return x.agg(F.sum("x")).first()[0]

    def peak(self, x: DataFrame) -> float:
        return x.agg(F.max("x")).first()[0]

    def solved_katz(self, alpha: float) -> DataFrame | None:
        return None

    def coreness(self) -> DataFrame:
        """Each round peels all nodes of at most the degree that is reached; a round ends on the nodes left over."""
        if self.e.where("s = d").take(1):
            return self.full(0.0)
        left, k = self.undirected().e, 0
        state = self.nodes.withColumn("x", F.lit(None).cast("double"))
        while True:
            degree = left.groupBy(F.col("s").alias("node")).agg(F.count("*").alias("_n"))
            state = saved(state.join(degree, "node", "left").withColumn("_n", F.coalesce("_n", F.lit(0))))
            least = state.where("x is null").agg(F.min("_n")).first()[0]
            if least is None:
                return state.select("node", "x")
            k = max(k, least)
            state = saved(state.select("node", F.coalesce("x", F.when(F.col("_n") <= k, F.lit(float(k)))).alias("x")))
            alive = state.where("x is null").select("node")
            left = saved(left.join(alive.withColumnRenamed("node", "s"), "s", "left_semi").join(alive.withColumnRenamed("node", "d"), "d", "left_semi").select("s", "d"))


#: Rounds that a power iteration has at most, if it doesn't settle before.
ROUNDS = {"hits": 1000, "eigenvector": 10_000}


def _hits(g, rounds: int) -> tuple:
    """Power iteration from an even start; hubs and authorities each sum to 1."""
    h, last = g.full(1 / g.n), None
    for _ in range(rounds):
        before, last = last, h
        h = g.against(g.along(h))
        top = g.peak(h)
        h = g.scale(1 / top, h) if top > 0 else h
        if g.settled(h, last, before, 1e-12):
            break
    auth = g.along(h)
    return g.scale(1 / max(g.total(h), 1e-300), h), g.scale(1 / max(g.total(auth), 1e-300), auth)


def _eigenvector(g, rounds: int):
    """Of the undirected graph; A + I has the same leading vector and doesn't oscillate. Zeros under three nodes."""
    if g.n < 3:
        return g.full(0.0)
    u = g.undirected()
    x, last = u.full(1 / np.sqrt(u.n)), None
    for _ in range(rounds):
        before, last = last, x
        x = u.mix(1.0, last, 1.0, u.along(last))
        x = u.scale(1 / np.sqrt(u.dot(x, x)), x)
        if u.settled(x, last, before, u.n * 1e-12):
            break
    return x


def _katz_iterated(g, alpha: float, rounds: int = 1000, growing: int = 20):
    """x = 1 + alpha A'x by its series, which ends where there are no cycles. Where its terms grow for so many rounds, or don't end, the
    same equation is solved by conjugate gradients on its normal equations, which need no small radius; the last values count."""
    ones, x, last, grown = g.full(1.0), g.full(1.0), np.inf, 0
    for _ in range(rounds):
        new = g.mix(1.0, ones, alpha, g.along(x))
        change = g.gap(new, x)
        x = new
        if change <= 1e-13 * g.total(x):
            return x
        grown, last = grown + 1 if change > last else 0, change
        if grown >= growing:
            break
    r, z = ones, g.mix(1.0, ones, -alpha, g.against(ones))
    x, p, size = g.full(0.0), z, g.dot(z, z)
    for _ in range(rounds):
        w = g.mix(1.0, p, -alpha, g.along(p))
        length = g.dot(w, w)
        if not length or not size:
            break
        x, r = g.mix(1.0, x, size / length, p), g.mix(1.0, r, -size / length, w)
        if g.dot(r, r) <= g.n * 1e-26:
            break
        z = g.mix(1.0, r, -alpha, g.against(r))
        before, size = size, g.dot(z, z)
        p = g.mix(1.0, z, size / before, p)
    return x


def _katz(g, alpha: float = 0.1):
    x = g.solved_katz(alpha)
    x = _katz_iterated(g, alpha) if x is None else x
    sign = -1.0 if g.total(x) < 0 else 1.0
    return g.scale(sign / max(np.sqrt(g.dot(x, x)), 1e-300), x)


def _metrics(g, names: Sequence[str], rounds: dict) -> dict:
    hub, authority = _hits(g, rounds["hits"]) if {"hub", "authority"} & set(names) else (None, None)
    made = {"hub": lambda: hub, "authority": lambda: authority, "eigenvector": lambda: _eigenvector(g, rounds["eigenvector"]), "katz": lambda: _katz(g), "coreness": g.coreness}
    return {k: made[k]() for k in names}


def matrix_metrics(edges: DataFrame, names: Sequence[str] = ("hub", "authority", "eigenvector", "katz", "coreness"), limit: int | None = None, group_edges: int = GROUP_EDGES, rounds: dict | None = None) -> DataFrame:
    """The named metrics of each node with their dense ranks. Groups of up to group_edges edges are each computed in one task; larger ones by
    joins, one group after the other, never gathered. A limit, where one is given, sets the nodes of groups of more nodes to zero. rounds: the most
    rounds of hits and of eigenvector, where other than ROUNDS."""
    names, rounds = list(names), ROUNDS | (rounds or {})
    e = saved(simple_edges(edges).select("g", "s", "d"))
    zero = None
    if limit is not None:
        over = _nodes(e).groupBy("g").agg(F.count("*").alias("n")).where(F.col("n") > limit).select("g")
        zero = _nodes(e.join(over, "g", "left_semi")).select("g", "node", *(F.lit(0.0).alias(k) for k in names))
        e = saved(e.join(over, "g", "left_anti"))
    sizes = saved(e.groupBy("g").agg(F.count("*").alias("n")))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        g = _Arrays(pdf)
        return pd.DataFrame({"g": pdf["g"].iloc[0], "node": g.nodes, **_metrics(g, names, rounds)})

    small = e.join(sizes.where(F.col("n") <= group_edges), "g")
    out = _each_group(small, run, "g long, node long, " + ", ".join(f"{k} double" for k in names))
    for row in sizes.where(F.col("n") > group_edges).select("g").collect():
        t = _Tables(saved(e.where(F.col("g") == row.g)))
        table = t.nodes.select(F.lit(row.g).cast("long").alias("g"), "node")
        for k, x in _metrics(t, names, rounds).items():
            table = table.join(x.withColumnRenamed("x", k), "node")
        out = out.union(saved(table.select("g", "node", *names)))
    out = (out if zero is None else out.union(zero)).withColumnRenamed("g", GROUP)
    large = sizes.where(F.col("n") > group_edges).select(F.col("g").alias(GROUP))
    return with_dense_ranks(out, [GROUP], {f"rank_{k}": (k, False) for k in names}, large if large.take(1) else None)


def composite(features: DataFrame, pr: DataFrame, nodes: DataFrame, weights: dict | None = None, invert_out_degree: bool = True, group_rows: int = GROUP_ROWS) -> DataFrame:
    """The composite score of each node of its group. features: txId, in_BTC_total, in_txs_degree, out_txs_degree. A transaction in several
    groups counts in the one of least id.

    Within a group: percentiles of pagerank, value and degrees (out-degree inverted), weighted and summed; a missing pagerank adds 0."""
    w = weights or WEIGHTS
    require_columns(features, ["txId", "in_BTC_total", "in_txs_degree", "out_txs_degree"])
    if abs(sum(w.values()) - 1) > 1e-6:
        raise ValueError("weights must sum to 1")
    one = nodes.groupBy(F.col("txn_id").alias("node")).agg(F.min(GROUP).alias(GROUP))
    f = features.select(F.col("txId").alias("node"), "in_BTC_total", "in_txs_degree", "out_txs_degree")
    df = one.join(f, "node", "left").join(pr.select(GROUP, "node", "pagerank"), [GROUP, "node"], "left")
    c, keys = F.col, [GROUP]
    large = large_groups(one, keys, group_rows)
    df = df.withColumn("pagerank_missing", c("pagerank").isNull()).na.fill(0, ["in_BTC_total", "in_txs_degree", "out_txs_degree"])
    df = with_pct_ranks(df, keys, {"pagerank_pct": "pagerank", "in_btc_pct": "in_BTC_total", "in_deg_pct": "in_txs_degree", "out_deg_pct": "out_txs_degree"}, large)
    # whole cents add up exactly, so the order of summation can't matter
    cents = df.groupBy(GROUP).agg((F.sum(F.round(c("in_BTC_total") * 100).cast("long")) / F.lit(100.0)).alias("_total"))
    df = df.join(cents, GROUP).withColumns({"out_deg_pct_inv": (1 - c("out_deg_pct")) if invert_out_degree else c("out_deg_pct"), "in_btc_share": c("in_BTC_total") / (c("_total") + EPS)}).drop("_total")
    df = df.withColumn("pagerank_pct_filled_for_contrib", F.coalesce(c("pagerank_pct"), F.lit(0.0)))
    df = df.withColumns({f"{k}_weight": F.lit(float(w[k])) for k in ("pr", "val", "in", "out")})
    parts = {"pr_contrib": ("pagerank_pct_filled_for_contrib", "pr"), "val_contrib": ("in_btc_pct", "val"), "in_deg_contrib": ("in_deg_pct", "in"), "out_deg_contrib": ("out_deg_pct_inv", "out")}
    df = df.withColumns({k: c(f"{x}_weight") * F.coalesce(c(p), F.lit(0.0)) for k, (p, x) in parts.items()})
    df = df.withColumn("composite_raw", c("pr_contrib") + c("val_contrib") + c("in_deg_contrib") + c("out_deg_contrib"))
    df = saved(df) if large is not None else df
    return with_dense_ranks(with_pct_ranks(df, keys, {"composite_pct": "composite_raw"}, large), keys, {"composite_rank": ("composite_raw", False)}, large)


# The weight sets that are compared.
WEIGHT_SETS = {
    "equal": {"pr": 0.25, "val": 0.25, "in": 0.25, "out": 0.25},
    "balanced": {"pr": 0.50, "val": 0.40, "in": 0.07, "out": 0.03},
    "current": {"pr": 0.60, "val": 0.30, "in": 0.07, "out": 0.03},
    "pr_heavy": {"pr": 0.70, "val": 0.20, "in": 0.07, "out": 0.03},
    "pr_extreme": {"pr": 0.80, "val": 0.15, "in": 0.03, "out": 0.02},
    "pr_mid": {"pr": 0.55, "val": 0.35, "in": 0.07, "out": 0.03},
    "val_heavy": {"pr": 0.20, "val": 0.70, "in": 0.06, "out": 0.04},
    "val_mid": {"pr": 0.40, "val": 0.50, "in": 0.06, "out": 0.04},
    "val_extreme": {"pr": 0.10, "val": 0.80, "in": 0.05, "out": 0.05},
    "deg_heavy": {"pr": 0.40, "val": 0.30, "in": 0.20, "out": 0.10},
    "deg_equal": {"pr": 0.33, "val": 0.33, "in": 0.17, "out": 0.17},
}


def _medians(df: DataFrame, keys: list[str], value: str, out: str, large: DataFrame | None) -> DataFrame:
    """(keys, out): the median of value, nulls left out, from the one or two rows in the middle of each group's order."""
    held = saved(df.where(F.col(value).isNotNull()).select(*keys, value))
    sizes = held.groupBy(*keys).agg(F.count("*").alias("_m"))
    placed = with_places(held, keys, [value], "_at", large).join(sizes, keys)
    middle = (F.col("_at") == F.floor((F.col("_m") - 1) / 2)) | (F.col("_at") == F.floor(F.col("_m") / 2))
    return placed.where(middle).groupBy(*keys).agg(((F.min(value) + F.max(value)) / 2).alias(out))


def compare_weights(scored: DataFrame, sets: dict | None = None, top_frac: float = 0.10, min_nodes: int = 5, details: bool = False, group_rows: int = GROUP_ROWS) -> DataFrame:
    """For each weight set: in the groups of at least min_nodes, the share of value held by the top ceil(top_frac * n) nodes, and their median
    pagerank percentile; medians over groups, best first by the latter. scored: a composite frame; the weight sets are a small
    literal table, and all are ranked in one plan. Groups of more than group_rows nodes are ordered by ranges, so no task holds one."""
    sets = sets or WEIGHT_SETS
    keys = ["set_no", GROUP]
    table = scored.sparkSession.createDataFrame([(i, k, *(float(v[x]) for x in ("pr", "val", "in", "out"))) for i, (k, v) in enumerate(sets.items())], "set_no int, name string, w1 double, w2 double, w3 double, w4 double")
    zero = lambda x: F.coalesce(F.col(x), F.lit(0.0))
    sizes = saved(scored.groupBy(GROUP).agg(F.count("*").alias("_n")).where(F.col("_n") >= min_nodes))
    over = sizes.where(F.col("_n") > group_rows).select(GROUP)
    large = over.crossJoin(table.select("set_no")).select(*keys) if over.take(1) else None
    raw = F.round(F.col("w1") * zero("pagerank_pct") + F.col("w2") * zero("in_btc_pct") + F.col("w3") * zero("in_deg_pct") + F.col("w4") * zero("out_deg_pct_inv"), 9)
    rows = scored.join(sizes, GROUP).crossJoin(F.broadcast(table)).withColumn("_raw", raw)
    rows = rows.select(*keys, "node", "_raw", "_n", F.round(F.col("in_BTC_total") * 100).cast("long").alias("_value"), zero("pagerank_pct").alias("_pct"))
    placed = saved(with_places(rows, keys, [F.desc("_raw"), F.asc("node")], "_place", large))
    top = F.col("_place") < F.greatest(F.lit(1), F.ceil(F.lit(top_frac) * F.col("_n")))
    shares = placed.groupBy(*keys).agg(F.sum(F.when(top, F.col("_value")).otherwise(0)).alias("_t"), F.sum("_value").alias("_s"))
    middles = _medians(placed.where(top), keys, "_pct", "_med", large)
    per = shares.join(middles, keys, "left").join(F.broadcast(table.select("set_no", "name")), "set_no")
    per = per.select("set_no", "name", GROUP, F.when(F.col("_s") > 0, F.col("_t") / F.col("_s")).otherwise(0.0).alias("btc_share"), (F.col("_med") * 100).alias("pr_percentile_med"))
    if details:
        return per
    per = saved(per)
    by_set = table.select("set_no") if sizes.where("true").count() > group_rows else None
    both = _medians(per, ["set_no"], "btc_share", "median_btc_share", by_set).join(_medians(per, ["set_no"], "pr_percentile_med", "median_pr_percentile", by_set), "set_no")
    out = per.groupBy("set_no", "name").agg(F.count("*").alias("groups")).join(both, "set_no")
    return out.select("set_no", "name", "median_btc_share", "median_pr_percentile", "groups").orderBy(F.desc("median_pr_percentile"), "set_no")


def _tau(x: np.ndarray, y: np.ndarray) -> float:
    """Kendall's tau-b from a sorted merge: n log n. NaN without variance."""
    order = np.lexsort((y, x))
    x, y = x[order], np.unique(y[order], return_inverse=True)[1]
    n = len(x)
    pairs = lambda k: float((k * (k - 1) // 2).sum())
    tied_x = pairs(np.unique(x, return_counts=True)[1])
    tied_y = pairs(np.bincount(y)) if n else 0.0
    tied_both = pairs(np.unique(np.stack([np.unique(x, return_inverse=True)[1], y]), axis=1, return_counts=True)[1])
    against, width, rows = 0, 1, y.astype(np.int64)
    while width < n:  # bottom-up merge sort; an element of a right half passes the greater ones of its left half
        block = np.arange(n) // (2 * width)
        right = np.arange(n) // width % 2 == 1
        top = int(rows.max()) + 1
        keyed = block * top + rows
        lefts = keyed[~right]
        ends = np.searchsorted(lefts, (block[right] + 1) * top)
        against += int((ends - np.searchsorted(lefts, keyed[right], "right")).sum())
        rows = rows[np.argsort(keyed, kind="stable")]
        width *= 2
    every = n * (n - 1) / 2
    spread = np.sqrt((every - tied_x) * (every - tied_y))
    return (every - tied_x - tied_y + tied_both - 2 * against) / spread if spread else np.nan


def _kendall(whole: DataFrame, keys: list[str], group_rows: int) -> DataFrame:
    """(keys, corr). Groups of up to group_rows rows are each merged in one task; larger ones are counted by ranges."""
    large = large_groups(whole, keys, group_rows)
    types = ", ".join(f"{k} {whole.schema[k].dataType.simpleString()}" for k in keys)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({**{k: [pdf[k].iloc[0]] for k in keys}, "corr": [_tau(pdf["x"].to_numpy(), pdf["y"].to_numpy())]})

    small = whole if large is None else whole.join(F.broadcast(large), keys, "left_anti")
    out = _spread(small.select(*keys, "x", "y"), *keys).groupBy(*keys).applyInPandas(run, f"{types}, corr double").withColumn("corr", F.nanvl("corr", F.lit(None).cast("double")))
    if large is None:
        return out
    per = saved(whole.join(F.broadcast(large), keys, "left_semi").groupBy(*keys, "x", "y").agg(F.count("*").alias("n")))
    return out.unionByName(_kendall_by_ranges(per, keys, large))


def _kendall_by_ranges(per: DataFrame, keys: list[str], large: DataFrame) -> DataFrame:
    """(keys, corr) of counted pairs (keys, x, y, n). Pairs of rows that x and y order differently are counted as a merge sort of y meets them: on each level the
    rows whose ranks in y agree but for the last bits form a block, and its rows of the lower half are met by those of the upper half that come before them
    in x. All levels are rows of one table, whose running sums are taken by ranges; so it is n log n, and no task sees a group."""
    ranked = saved(with_dense_ranks(per, keys, {"_r": ("y", True)}, large).select(*keys, "x", "y", "n", F.col("_r").cast("long").alias("_r")))
    levels = int(ranked.agg(F.max("_r")).first()[0] or 0).bit_length()
    cells = ranked.withColumn("_level", F.explode(F.sequence(F.lit(0), F.lit(max(0, levels - 1)))))
    cells = cells.withColumn("_block", F.expr("shiftright(_r, _level + 1)")).withColumn("_upper", F.expr("shiftright(_r, _level) & 1"))
    at = [*keys, "_level", "_block"]
    halves = cells.groupBy(*at, "x").agg(F.sum(F.col("n") * F.col("_upper")).alias("_ones"), F.sum(F.col("n") * (1 - F.col("_upper"))).alias("_zeros"))
    whole = lambda c: c.cast("decimal(19,0)")
    before = F.col("_upto") - F.col("_ones")
    met = running_total(halves, [*at, "x"], F.col("_ones"), "_upto").groupBy(*at).agg((F.sum(whole(F.col("_zeros")) * whole(before)).cast("double") - F.min(before).cast("double") * F.sum("_zeros")).alias("_d"))
    against = met.groupBy(*keys).agg(F.sum("_d").alias("_d"))
    pairs = lambda c: (F.col(c) * (F.col(c) - 1)).cast("double") / 2

    def tied(by: list[str], out: str) -> DataFrame:
        return per.groupBy(*keys, *by).agg(F.sum("n").alias("_c")).groupBy(*keys).agg(F.sum(pairs("_c")).alias(out))

    sums = tied([], "_all").join(tied(["x"], "_x"), keys).join(tied(["y"], "_y"), keys).join(tied(["x", "y"], "_xy"), keys).join(against, keys)
    top = F.col("_all") - F.col("_x") - F.col("_y") + F.col("_xy") - 2 * F.col("_d")
    return sums.select(*keys, F.try_divide(top, F.sqrt((F.col("_all") - F.col("_x")) * (F.col("_all") - F.col("_y")))).alias("corr"))


def rank_correlations(ranks: DataFrame, columns: Sequence[str], method: str = "spearman", min_nodes: int = 2, group_rows: int = GROUP_ROWS) -> DataFrame:
    """(group, metric_a, metric_b, corr) between negated ranks, over the rows that have both; null in groups under min_nodes or without
    variance. Pearson, Spearman (average ranks among the complete rows) or Kendall (tau-b). Each unordered pair of metrics is computed once
    and given in both orders."""
    sizes = saved(ranks.groupBy(GROUP).agg(F.count("*").alias("_n")))
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    cells = F.explode(F.array(*(F.struct(F.lit(a).alias("metric_a"), F.lit(b).alias("metric_b"), (-F.col(a).cast("double")).alias("x"), (-F.col(b).cast("double")).alias("y")) for a, b in pairs)))
    wanted = sizes.where(F.col("_n") >= min_nodes).select(GROUP)
    whole = ranks.join(wanted, GROUP, "left_semi").select(GROUP, cells.alias("z")).select(GROUP, "z.*").where("x is not null and y is not null")
    keys = [GROUP, "metric_a", "metric_b"]
    r = lambda x, y: F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))
    if method == "kendall":
        corr = _kendall(whole, keys, group_rows)
    elif method == "spearman":
        ranked = with_pct_ranks(whole, keys, {"rx": "x", "ry": "y"}, large_groups(whole, keys, group_rows))
        corr = ranked.groupBy(*keys).agg(r("rx", "ry").alias("corr"))
    else:
        corr = whole.groupBy(*keys).agg(r("x", "y").alias("corr"))
    both = corr.union(corr.where("metric_a != metric_b").select(GROUP, F.col("metric_b").alias("metric_a"), F.col("metric_a").alias("metric_b"), "corr"))
    every = sizes.select(GROUP, "_n", F.explode(F.array(*(F.struct(F.lit(a).alias("metric_a"), F.lit(b).alias("metric_b")) for a in columns for b in columns))).alias("z")).select(GROUP, "_n", "z.*")
    return every.join(both, keys, "left").select(*keys, "corr")


def average_correlations(corr: DataFrame, summary: DataFrame, min_nodes: int = 5) -> DataFrame:
    """Mean of the groups' correlations, nulls ignored, over groups of at least min_nodes; the size column may have any of its usual names."""
    size = next((c for c in ("node_count", "txn_count", "tx_count", "n_nodes", "size", "nodes") if c in summary.columns), None)
    if size is None:
        raise ValueError("no size column")
    wanted = summary.where(F.col(size) >= min_nodes).select(GROUP)
    return corr.join(wanted, GROUP, "left_semi").groupBy("metric_a", "metric_b").agg(F.avg("corr").alias("corr"), F.countDistinct(GROUP).alias("groups"))


def rank_scores(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """<rank>_score = -rank for each rank column present."""
    return df.select("*", *[(-F.col(c)).alias(f"{c}_score") for c in columns if c in df.columns])


def join_metrics(base: DataFrame, *frames: DataFrame) -> DataFrame:
    """base left-joined with each frame on (group, node); all share one partitioning."""
    for f in frames:
        base = base.join(f, [GROUP, "node"], "left")
    return base
