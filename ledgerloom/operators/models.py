"""Training, tuning, scoring and explanation of the transaction classifiers with Spark ML."""

from __future__ import annotations

import json
import math
import random
from collections.abc import Sequence
from dataclasses import dataclass, field
from multiprocessing.pool import ThreadPool

import numpy as np
import pandas as pd
from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.exprs import require_columns, safe_div
from ..functions.places import numbered
from ..sources.tables import saved
from . import features as feats
from . import reports
from .forests import Cells, Forest, GrownForest, binned, votes_by_bin


@dataclass
class Scaler:
    """Means and population deviations of the columns to scale; a zero deviation counts as 1."""

    mean: dict[str, float]
    scale: dict[str, float]

    @classmethod
    def fit(cls, df: DataFrame, columns: Sequence[str]) -> Scaler:
        row = df.agg(*(F.avg(c).alias(f"a{i}") for i, c in enumerate(columns)), *(F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(columns))).first()
        return cls({c: row[f"a{i}"] or 0.0 for i, c in enumerate(columns)}, {c: row[f"s{i}"] or 1.0 for i, c in enumerate(columns)})

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c: (F.col(c).cast("double") - F.lit(m)) / F.lit(self.scale[c]) for c, m in self.mean.items()})


@dataclass
class Bundle:
    """A fitted pipeline with its feature order, scaler and decision threshold."""

    model: PipelineModel
    columns: list[str]
    scaler: Scaler
    threshold: float = 0.4
    name: str = "model"
    params: dict = field(default_factory=dict)

    def save(self, path: str) -> None:
        self.model.write().overwrite().save(f"{path}/model")
        meta = {"feat_order": self.columns, "to_scale": list(self.scaler.mean), "mean": self.scaler.mean, "scale": self.scaler.scale, "threshold": self.threshold, "name": self.name}
        SparkSession.getActiveSession().createDataFrame([(json.dumps(meta),)], "value string").write.mode("overwrite").text(f"{path}/metadata")

    @classmethod
    def load(cls, spark, path: str) -> Bundle:
        meta = json.loads(spark.read.text(f"{path}/metadata").first()[0])
        return cls(PipelineModel.load(f"{path}/model"), meta["feat_order"], Scaler(meta["mean"], meta["scale"]), meta["threshold"], meta["name"])


def balanced(df: DataFrame, label: str = "class") -> DataFrame:
    """_weight: n / (2 * rows of the label)."""
    return _weighted(df, label)[0]


def _weighted(df: DataFrame, label: str) -> tuple[DataFrame, int]:
    n = df.agg(F.count("*").alias("n"), F.count_if(F.col(label) == 1).alias("p")).first()
    out = df.withColumn("_weight", F.when(F.col(label) == 1, F.lit(n.n / (2 * max(1, n.p)))).otherwise(F.lit(n.n / (2 * max(1, n.n - n.p)))))
    return out, n.n


def forest(trees: int = 200, depth: int = 30, seed: int = 42, weighted: bool = True) -> RandomForestClassifier:
    out = Forest(featuresCol="_features", labelCol="class", numTrees=trees, maxDepth=depth, seed=seed, maxMemoryInMB=1024, cacheNodeIds=True)
    return out.setWeightCol("_weight") if weighted else out


def logistic(max_iter: int = 1000, reg: float = 0.0, l1_ratio: float = 0.0, weighted: bool = False) -> LogisticRegression:
    out = LogisticRegression(featuresCol="_features", labelCol="class", maxIter=max_iter, regParam=reg, elasticNetParam=l1_ratio, standardization=False, tol=1e-4)
    return out.setWeightCol("_weight") if weighted else out


#: Bytes of feature values that a partition of a linear fit holds, about.
FIT_BYTES = 32 << 20


def fit(df: DataFrame, columns: Sequence[str], estimator, to_scale: Sequence[str] | None = None, threshold: float = 0.4, name: str = "model") -> Bundle:
    """Fits on rows with class 0 or 1; the scaler is fitted on the same rows."""
    require_columns(df, [*columns, "class"])
    scaler = Scaler.fit(df, list(columns if to_scale is None else to_scale))
    data, rows = _weighted(scaler.transform(df), "class")
    if isinstance(estimator, LogisticRegression):  # each iteration is a job over all partitions, so there are as few as FIT_BYTES allows
        data = data.coalesce(max(1, 8 * rows * len(columns) // FIT_BYTES))
    model = Pipeline(stages=[VectorAssembler(inputCols=list(columns), outputCol="_features", handleInvalid="error"), estimator]).fit(data)
    return Bundle(model, list(columns), scaler, threshold, name)


def score(bundle: Bundle, df: DataFrame, drop_nulls: bool = True) -> DataFrame:
    """Batch scoring: rows with a null feature go (or keep a null score), the columns to scale are scaled, pred_proba is the probability of
    class 1; then class and label by the bundle's threshold."""
    require_columns(df, bundle.columns)
    if overlap := set(bundle.scaler.mean) - set(bundle.columns):
        raise ValueError(f"columns to scale that are no features: {sorted(overlap)}")
    rows = df.na.drop(subset=bundle.columns) if drop_nulls else df
    out = bundle.model.transform(bundle.scaler.transform(rows)).withColumn("pred_proba", vector_to_array("probability")[1])
    return reports.threshold_predictions(out.drop("_features", "rawPrediction", "probability", "prediction"), bundle.threshold, bundle.name).withColumn("run_timestamp", F.current_timestamp())


def cross_validate(df: DataFrame, columns: Sequence[str], make, windows: Sequence[tuple[int, int]], train_ratio: float = 0.5, threshold: float = 0.5) -> tuple[DataFrame, list[Bundle]]:
    """Fits a fresh estimator on the training half of each window of rows in time order, scores the whole window, and evaluates it; returns the
    evaluation (a row for each fold) and the bundles. Each fold is one distributed fit."""
    folds = feats.temporal_split(feats.take_folds(df, windows), train_ratio, keys=["fold"])
    folds = saved(folds)
    bundles, scored = [], []
    for i in range(len(windows)):
        own = folds.where(F.col("fold") == i + 1)
        bundles.append(fit(own.where("training_label = 'Train'"), columns, make(), threshold=threshold))
        scored.append(score(bundles[-1], own).select("fold", "class", "training_label", "time_step", "pred_proba"))
    every = scored[0]
    for s in scored[1:]:
        every = every.union(s)
    return reports.fold_evaluation(every, threshold), bundles


def best_bundle(evaluation: DataFrame, bundles: Sequence[Bundle]) -> Bundle:
    return bundles[reports.best_folds(evaluation, 1).first()["fold"] - 1]


def _time_blocks(df: DataFrame, splits: int) -> list[tuple[DataFrame, DataFrame]]:
    """(growing training block, the time block after it) for each split; the rows in time order are written once."""
    placed = saved(numbered(df, ["time_step", "txId"], "_place"))
    n = placed.count()
    ends = [n * i // (splits + 1) for i in range(1, splits + 2)]
    return [(placed.where(F.col("_place") < a), placed.where((F.col("_place") >= a) & (F.col("_place") < b))) for a, b in zip(ends, ends[1:])]


def _halved(grid: Sequence[dict], resources: Sequence[int], factor: int, recalls_of) -> list[dict]:
    """The rounds of successive halving: recalls_of(resource, candidates) gives each candidate's recalls, and the best of them, one in factor rounded
    up, enter the next round; of equal ones the least. A record for each candidate and round, with its mean, deviation and recalls."""
    alive, records = list(range(len(grid))), []
    for round_no, resource in enumerate(resources):
        found = recalls_of(resource, alive)
        for k in alive:
            mean = sum(found[k]) / len(found[k])
            std = (sum((r - mean) ** 2 for r in found[k]) / len(found[k])) ** 0.5
            records.append({"round": round_no, "resource": resource, "candidate": k, "recall": mean, "recall_std": std, "splits": found[k], **grid[k]})
        ranked = sorted((r for r in records if r["round"] == round_no), key=lambda r: (-r["recall"], r["candidate"]))
        alive = [r["candidate"] for r in ranked[: math.ceil(len(alive) / factor)]]
    return records


def successive_halving(df: DataFrame, columns: Sequence[str], grid: Sequence[dict], make, resources: Sequence[int], factor: int = 3, splits: int = 3, parallel: int = 8) -> list[dict]:
    """Successive halving over parameter sets: all at the least resource (iterations), the best 1/factor of them at the next, and so on (_halved).
    Quality is recall on the next time block, averaged over growing training blocks. Each fit is distributed; up to parallel run side by side. A fit
    that ended before its limit of iterations is the same under a larger one, so its recall is kept."""
    blocks = _time_blocks(df, splits)
    ended: dict[tuple[int, int], float] = {}

    def recall(resource: int, k: int, i: int) -> float:
        if (k, i) in ended:
            return ended[k, i]
        train, after = blocks[i]
        bundle = fit(train, columns, make(resource, **grid[k]), threshold=0.5)
        found = score(bundle, after).agg(safe_div(F.count_if(F.expr("class = 1 and pred_class = 1")), F.count_if(F.expr("class = 1"))).alias("r")).first().r or 0.0
        last = bundle.model.stages[-1]
        if getattr(last, "hasSummary", False) and last.summary.totalIterations < resource:
            ended[k, i] = found
        return found

    def recalls(resource: int, alive: Sequence[int]) -> dict[int, list[float]]:
        keys = sorted(((k, i) for k in alive for i in range(splits)), key=lambda at: -at[1])  # the largest blocks first
        found = dict(zip(keys, _side_by_side(df.sparkSession, [lambda at=at: recall(resource, *at) for at in keys], parallel), strict=True))
        return {k: [found[k, i] for i in range(splits)] for k in alive}

    return _halved(grid, resources, factor, recalls)


#: Levels that a Spark forest can have at most; deeper limits, and none, mean this one.
DEEPEST = 30


def forest_draws(n: int, seed: int = 42) -> list[dict]:
    """n random parameter sets of a forest: max_depth (None: no limit), min_samples_split, min_samples_leaf, max_features and class_weight."""
    # The ranges that the parameters are drawn from.
    depths, features, weights = [None, 12, 16, 20, 24, 28, 32, 36], ["sqrt", "log2", None], ["balanced", "balanced_subsample"]
    rng = random.Random(seed)
    return [{"max_depth": rng.choice(depths), "min_samples_split": rng.randrange(2, 20), "min_samples_leaf": rng.randrange(1, 20), "max_features": rng.choice(features), "class_weight": rng.choice(weights)} for _ in range(n)]


def drawn_forest(trees: int, seed: int, max_depth: int | None, min_samples_split: int, min_samples_leaf: int, max_features: str | None, class_weight: str) -> RandomForestClassifier:
    """The forest of a parameter set. Spark bounds the rows of a child, not of a node to split: min_samples_split asks for children of half as many, which
    is stricter. Both kinds of class weight are the training rows' own; Spark draws the trees' samples inside the fit."""
    if class_weight not in ("balanced", "balanced_subsample"):
        raise ValueError("class_weight is balanced or balanced_subsample")
    return forest(trees, min(max_depth or DEEPEST, DEEPEST), seed).setMinInstancesPerNode(max(min_samples_leaf, -(-min_samples_split // 2))).setFeatureSubsetStrategy(max_features or "all")


@dataclass
class Growing:
    """A forest that grows on a training block (cells: its packed rows, if it can be packed): how many parts and trees so far, and the votes of all trees on the rows of the
    block after it."""

    train: DataFrame
    votes: DataFrame
    cells: Cells | None = None
    trees: int = 0
    parts: int = 0

    def grow(self, trees: int, make) -> float:
        """Adds what is missing to trees, make(number, part), and returns the recall of all. Earlier trees are neither fitted nor asked again."""
        estimator = make(trees - self.trees, self.parts)
        part = estimator.fit(self.train) if self.cells is None else estimator.fit_cells(self.cells, self.train.sparkSession)
        given = vector_to_array("rawPrediction")
        yes, both = F.coalesce(F.get(given, F.lit(1)), F.lit(0.0)), F.aggregate(given, F.lit(0.0), lambda a, b: a + b)
        asked = part.transform(self.votes).select("class", "_features", (F.col("_yes") + yes).alias("_yes"), (F.col("_all") + both).alias("_all"))
        self.votes, self.trees, self.parts = saved(asked), trees, self.parts + 1
        if self.cells is not None:
            part.release()
        found = F.count_if((F.col("class") == 1) & (2 * F.col("_yes") > F.col("_all")))
        return self.votes.agg(safe_div(found, F.count_if(F.col("class") == 1)).alias("r")).first().r or 0.0


def _side_by_side(spark: SparkSession, tasks: Sequence, parallel: int) -> list:
    """Results of the tasks, which run at most parallel at a time; each is jobs of its own, and Spark shares the executors among them."""
    with ThreadPool(max(1, min(parallel, len(tasks)))) as pool:
        return pool.map(lambda f: f(), [inheritable_thread_target(spark)(t) for t in tasks])


def forest_search(df: DataFrame, columns: Sequence[str], draws: Sequence[dict], resources: Sequence[int] = (100, 300, 900), factor: int = 3, splits: int = 3, seed: int = 42, parallel: int = 8) -> list[dict]:
    """Successive halving of forests over drawn parameter sets (forest_draws); the resource is the number of trees. Quality as in successive_halving.

    A candidate's trees are kept from round to round, so 300 trees add 200 to the 100 there are. The blocks' feature vectors are written and packed once, and
    candidates and blocks are fitted side by side. Rows with a null feature don't count; a block without rows of class 1 gives recall 0."""
    assemble = VectorAssembler(inputCols=list(columns), outputCol="_features", handleInvalid="error")
    ready = []
    for train, after in _time_blocks(df.na.drop(subset=[*columns, "class"]), splits):
        weighted, rows = _weighted(train, "class")
        if not rows:
            raise ValueError(f"{splits} time blocks need more rows")
        zero = F.lit(0.0)
        block = saved(assemble.transform(weighted).select("class", "_features", "_weight"))
        later = saved(assemble.transform(after).select("class", "_features", zero.alias("_yes"), zero.alias("_all")))
        ready.append((block, later, forest().pack(block)))
    growing = {(k, i): Growing(*block) for k in range(len(draws)) for i, block in enumerate(ready)}

    def recalls(resource: int, alive: Sequence[int]) -> dict[int, list[float]]:
        keys = sorted(((k, i) for k in alive for i in range(splits)), key=lambda at: -at[1])  # the largest blocks first
        seeds = {at: seed + 1000 * at[0] + 100 * at[1] for at in keys}
        tasks = [lambda at=at: growing[at].grow(resource, lambda n, part: drawn_forest(n, seeds[at] + part, **draws[at[0]])) for at in keys]
        found = dict(zip(keys, _side_by_side(df.sparkSession, tasks, parallel), strict=True))
        return {k: [found[k, i] for i in range(splits)] for k in alive}

    return _halved(draws, resources, factor, recalls)


def refitted(df: DataFrame, columns: Sequence[str], records: Sequence[dict], seed: int = 42, threshold: float = 0.5) -> Bundle:
    """The search's best forest, fitted to all rows with as many trees as its last round had."""
    best = best_record(records)
    params = {k: best[k] for k in ("max_depth", "min_samples_split", "min_samples_leaf", "max_features", "class_weight")}
    out = fit(df, columns, drawn_forest(best["resource"], seed, **params), threshold=threshold, name="rf")
    out.params = params
    return out


def best_record(records: Sequence[dict]) -> dict:
    """The record of the best recall in the last round; of equal ones the least candidate."""
    last = max(r["round"] for r in records)
    return max((r for r in records if r["round"] == last), key=lambda r: (r["recall"], -r["candidate"]))


def tuning_report(spark: SparkSession, records: Sequence[dict], params: Sequence[str], fold: str = "fold_1", factor: int = 3, method: str = "SuccessiveHalving", scoring: str = "recall", blocks: str = "TimeBlocks", words: Sequence[str] = ()) -> DataFrame:
    """One row on a search: method, scoring, kind and number of splits, the best score with its deviation and each split's, the candidates tested, the
    tuned parameters (tuned__ and used__; words: those that are strings), and the schedule of resources and candidates. Without records the scores are null."""
    rounds = sorted({r["round"] for r in records})
    best = best_record(records) if records else {"recall": None, "recall_std": None, "splits": []}
    resources = [next(r["resource"] for r in records if r["round"] == k) for k in rounds]
    row = {
        "fold": fold, "tuning_method": method if records else "None", "inner_cv_scoring": scoring if records else None, "inner_cv_class": blocks if records else None, "inner_cv_n_splits": len(best["splits"]) if records else None,
        "best_score": best["recall"], "best_score_std": best["recall_std"], "n_candidates_tested": len(records) if records else None,
        **{f"best_split{i}_score": x for i, x in enumerate(best["splits"])},
        **{f"{kind}__{k}": best.get(k) for k in params for kind in ("used", "tuned")},
        "halving__min_resources": resources[0] if resources else None, "halving__max_resources": resources[-1] if resources else None, "halving__factor": factor, "halving__n_iterations": len(rounds),
        "halving__resources_schedule": ";".join(map(str, resources)), "halving__candidates_schedule": ";".join(str(sum(r["round"] == k for r in records)) for k in rounds),
    }
    text = ("fold", "tuning_method", "inner_cv_scoring", "inner_cv_class", "halving__resources_schedule", "halving__candidates_schedule")
    count = ("inner_cv_n_splits", "n_candidates_tested", "halving__min_resources", "halving__max_resources", "halving__factor", "halving__n_iterations")
    types = {k: "string" if k in text or isinstance(row[k], str) or k.partition("__")[2] in words else "int" if k in count else "double" for k in row}
    return spark.createDataFrame([tuple(None if v is None else float(v) if types[k] == "double" else v for k, v in row.items())], ", ".join(f"`{k}` {t}" for k, t in types.items()))


#: Rows of a block of the random order that permutation_importance pairs rows in.
BLOCK_ROWS = 1 << 15
#: The same for a forest, which asks its trees for all values that a column of a row could have.
FOREST_ROWS = 1 << 11
#: Scores of a range that one task counts the pairs of.
RANGE_SCORES = 1_000_000


def _blocks(placed: DataFrame, n: int, repeats: int, rows: int | None = None) -> tuple[DataFrame, list[int]]:
    """(rows with _block, _at and _own; the repeats' shifts): blocks of the order _place, each with the rows after it that the shifts reach, _own of those that
    are the block's. The order is closed: after the last row comes the first."""
    shifts = [1 + r % max(1, n - 1) for r in range(repeats)]
    halo = max(shifts, default=1)
    twice = placed.withColumn("_at", F.explode(F.when(F.col("_place") < halo, F.array(F.col("_place"), F.col("_place") + n)).otherwise(F.array("_place"))))
    block = lambda c: F.floor(c / (rows or BLOCK_ROWS))
    dealt = twice.withColumn("_block", F.explode(F.sequence(block(F.greatest(F.col("_at") - halo, F.lit(0))), block(F.least(F.col("_at"), F.lit(n - 1))))))
    return dealt.withColumn("_own", (F.col("_at") < n) & (block(F.col("_at")) == F.col("_block"))).drop("_place"), shifts


def _swapped(blocks: DataFrame, columns: Sequence[str], shifts: Sequence[int]) -> DataFrame:
    """A row for each row of the blocks, repeat _r and column _c, in which the column has the value of the repeat's other row; _c = -1: none has."""
    order = Window.partitionBy("_block").orderBy("_at")
    other = F.struct(*(F.col(c).alias(f"v{i}") for i, c in enumerate(columns)))
    pairs = blocks.withColumn("_others", F.array(*(F.lead(other, k).over(order) for k in shifts))).where("_own")
    pairs = pairs.select("class", *columns, F.posexplode("_others").alias("_r", "_other")).withColumn("_c", F.explode(F.sequence(F.lit(-1), F.lit(len(columns) - 1))))
    return pairs.select("_r", "_c", "class", *(F.when(F.col("_c") == i, F.col(f"_other.v{i}")).otherwise(F.col(c)).alias(c) for i, c in enumerate(columns)))


def _linear_scores(bundle: Bundle, shifts: Sequence[int]):
    """Of a logistic regression: a function that gives (_r, _c, classes, scores) of a block, as score does on the rows of _swapped. All terms of a
    sum are added in the same order, so rows of equal values have equal scores."""
    last = bundle.model.stages[-1]
    weights, start = [float(x) for x in last.coefficients.toArray()], float(last.intercept)
    columns, mean, scale = list(bundle.columns), bundle.scaler.mean, bundle.scaler.scale

    def run(block: pd.DataFrame):
        block = block.sort_values("_at")
        own = np.flatnonzero(block["_own"].to_numpy(bool) & block["class"].isin([0, 1]).to_numpy())
        kind = block["class"].to_numpy()[own]
        terms = [w * ((block[c].to_numpy(float) - mean[c]) / scale[c] if c in mean else block[c].to_numpy(float)) for c, w in zip(columns, weights)]
        for r, k in enumerate(shifts):
            for swapped in range(-1, len(columns)):
                margin = np.full(len(own), start)
                for i, t in enumerate(terms):
                    margin += t[own + k] if i == swapped else t[own]
                with np.errstate(over="ignore"):
                    yield r, swapped, kind, 1 / (1 + np.exp(-margin))

    return run


def _forest_scores(bundle: Bundle, shifts: Sequence[int], spark: SparkSession):
    """The same of a grown forest: the votes of each row for every bin that a column could have are gathered once, and repeats only look them up."""
    columns, mean, scale = list(bundle.columns), bundle.scaler.mean, bundle.scaler.scale
    sent = bundle.model.stages[-1].sent(spark)

    def run(block: pd.DataFrame):
        bounds, trees = sent.value
        block = block.sort_values("_at")
        own = np.flatnonzero(block["_own"].to_numpy(bool) & block["class"].isin([0, 1]).to_numpy())
        kind = block["class"].to_numpy()[own]
        x = [(block[c].to_numpy(float) - mean[c]) / scale[c] if c in mean else block[c].to_numpy(float) for c in columns]
        bins = binned(np.stack(x, axis=1), bounds)
        given = votes_by_bin(trees, bins[own], max(len(b) for b in bounds) + 1) / len(trees)
        rows = np.arange(len(own))
        for r, k in enumerate(shifts):
            for swapped in range(-1, len(columns)):
                c = max(swapped, 0)
                yield r, swapped, kind, given[rows, c, bins[own if swapped < 0 else own + k, c]]

    return run


def _block_scores(bundle: Bundle, blocks: DataFrame, shifts: Sequence[int]):
    return _forest_scores(bundle, shifts, blocks.sparkSession) if isinstance(bundle.model.stages[-1], GrownForest) else _linear_scores(bundle, shifts)


def _linear_counts(bundle: Bundle, blocks: DataFrame, shifts: Sequence[int]) -> DataFrame:
    """(_r, _c, tp, tn, fp, fn) of a logistic regression or a grown forest; each block is counted in one task."""
    scores, threshold = _block_scores(bundle, blocks, shifts), bundle.threshold

    def run(block: pd.DataFrame) -> pd.DataFrame:
        found = [(r, c, *np.bincount(2 * (kind == 1) + (p >= threshold), minlength=4)) for r, c, kind, p in scores(block)]
        return pd.DataFrame(found, columns=["_r", "_c", "tn", "fp", "fn", "tp"])

    kinds = ("tn", "fp", "fn", "tp")
    parts = blocks.groupBy("_block").applyInPandas(run, "_r int, _c int, tn long, fp long, fn long, tp long")
    return parts.groupBy("_r", "_c").agg(*(F.sum(k).alias(k) for k in kinds))


def _linear_areas(bundle: Bundle, blocks: DataFrame, shifts: Sequence[int], cuts: Sequence[float]) -> DataFrame:
    """(_r, _c, auc) of a logistic regression or a grown forest, exact as reports.auc. A block gives the distinct scores of each repeat and column with their counts of both classes, packed and
    dealt into ranges at the cuts, which only balance the work; each range counts its pairs, and the ranges' sums make the area."""
    scores, cuts = _block_scores(bundle, blocks, shifts), np.array(cuts)

    def packed(block: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for r, c, kind, p in scores(block):
            values, at = np.unique(p, return_inverse=True)
            ones, zeros = (np.bincount(at, kind == k, len(values)).astype(np.uint32) for k in (1, 0))
            ends = [0, *np.searchsorted(values, cuts), len(values)]
            rows += [(r, c, k, values[a:b].tobytes(), ones[a:b].tobytes(), zeros[a:b].tobytes()) for k, (a, b) in enumerate(zip(ends, ends[1:])) if a < b]
        return pd.DataFrame(rows, columns=["_r", "_c", "_k", "values", "ones", "zeros"])

    def pairs(part: pd.DataFrame) -> pd.DataFrame:
        values, at = np.unique(np.frombuffer(b"".join(part["values"])), return_inverse=True)
        ones, zeros = (np.bincount(at, np.frombuffer(b"".join(part[c]), np.uint32), len(values)).astype(np.int64) for c in ("ones", "zeros"))
        won = float((ones * (2 * (np.cumsum(zeros) - zeros) + zeros)).sum())
        return pd.DataFrame({"_r": part["_r"].iloc[:1], "_c": part["_c"].iloc[:1], "_k": part["_k"].iloc[:1], "won": won, "p": ones.sum(), "n": zeros.sum()})

    parts = blocks.groupBy("_block").applyInPandas(packed, "_r int, _c int, _k int, values binary, ones binary, zeros binary")
    per = parts.groupBy("_r", "_c", "_k").applyInPandas(pairs, "_r int, _c int, _k int, won double, p long, n long")
    below = F.coalesce(F.sum("n").over(Window.partitionBy("_r", "_c").orderBy("_k").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    won = F.sum(F.col("won") / 2 + F.col("p").cast("double") * F.col("_below"))
    return per.withColumn("_below", below).groupBy("_r", "_c").agg(safe_div(won, F.sum("p").cast("double") * F.sum("n")).alias("m"))


def permutation_importance(bundle: Bundle, df: DataFrame, repeats: int = 10, seed: int = 42, metric: str = "f1") -> DataFrame:
    """feature, importance (mean loss of the metric, one of reports.metrics or roc_auc, when the column is shuffled), importance_std, importance_index (0 to 100) and rank.

    Rows are put in a random order (by seeded hash) once. In repeat r each row meets the row r + 1 places after it there, the first coming after the last, and each
    column in turn takes that row's value: a permutation for each repeat, and no row is shuffled for any of them. A logistic regression and a grown forest are
    scored block by block, so a repeat's scores leave their task as counts, or packed for the area; other models score a row for each repeat and column."""
    known = reports.metrics(F.col("tp"), F.col("tn"), F.col("fp"), F.col("fn"))
    if metric not in (*known, "roc_auc"):
        raise ValueError(f"metric is one of {sorted([*known, 'roc_auc'])}")
    base = df.na.drop(subset=bundle.columns).select("txId", "class", *bundle.columns)
    placed = saved(numbered(base, [F.xxhash64(F.lit(seed), "txId"), "txId"], "_place"))
    n = placed.count()
    last = bundle.model.stages[-1]
    grown = isinstance(last, GrownForest)
    blocks, shifts = _blocks(placed, n, repeats, FOREST_ROWS if grown else None)
    if grown:  # few bytes, much work
        blocks = blocks.repartition(max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 4 * df.sparkSession.sparkContext.defaultParallelism), "_block")
    linear = grown or isinstance(last, LogisticRegressionModel) and last.numClasses <= 2
    if metric == "roc_auc" and linear:
        ranges = -(-n // RANGE_SCORES)
        cuts = score(bundle, placed).approxQuantile("pred_proba", [k / ranges for k in range(1, ranges)], 0.1 / ranges) if ranges > 1 else []
        values = _linear_areas(bundle, blocks, shifts, sorted(set(cuts)))
    elif metric == "roc_auc":
        scored = score(bundle, _swapped(blocks, bundle.columns, shifts))
        values = reports.auc(scored.select("_r", "_c", "class", "pred_proba"), ["_r", "_c"]).select("_r", "_c", F.col("auc").alias("m"))
    else:
        if linear:
            counts = _linear_counts(bundle, blocks, shifts)
        else:
            scored = score(bundle, _swapped(blocks, bundle.columns, shifts))
            counts = scored.groupBy("_r", "_c").agg(*(v.alias(k) for k, v in reports.confusion(F.col("class"), F.col("pred_class")).items()))
        values = counts.select("_r", "_c", known[metric].alias("m"))
    got = values.collect()  # a row for each column and repeat
    whole = {r["_r"]: r.m for r in got if r["_c"] < 0}
    losses = {c: [(whole[r["_r"]] or 0.0) - (r.m or 0.0) for r in got if r["_c"] == i] for i, c in enumerate(bundle.columns)}
    mean = {c: sum(x) / len(x) if x else 0.0 for c, x in losses.items()}
    std = {c: (sum((v - mean[c]) ** 2 for v in x) / len(x)) ** 0.5 if x else 0.0 for c, x in losses.items()}
    top = max(mean.values(), default=0) or 1.0
    rows = sorted(mean.items(), key=lambda kv: (-kv[1], kv[0]))
    return df.sparkSession.createDataFrame([(c, float(v), float(std[c]), float(max(0.0, v) / top * 100), i + 1) for i, (c, v) in enumerate(rows)], "feature string, importance double, importance_std double, importance_index double, rank long")


def model_importance(bundle: Bundle, spark) -> DataFrame:
    """feature and importance, largest first: absolute coefficients of a linear model, impurity importance of a forest, zeros for others."""
    last = bundle.model.stages[-1]
    values = [abs(float(x)) for x in last.coefficients] if hasattr(last, "coefficients") else [float(x) for x in last.featureImportances.toArray()] if hasattr(last, "featureImportances") else [0.0] * len(bundle.columns)
    return spark.createDataFrame(sorted(zip(bundle.columns, values, strict=True), key=lambda kv: -kv[1]), "feature string, importance double")


def importance_ranks(permutation: DataFrame, model: DataFrame) -> DataFrame:
    """Both importances side by side (full join), each with its rank."""
    a, b = permutation.select("feature", F.col("importance").alias("permutation"), F.col("importance_std").alias("permutation_std"), F.col("rank").alias("rank_permutation")), model.select("feature", F.col("importance").alias("model"))
    return a.join(b.withColumn("rank_model", F.rank().over(Window.orderBy(F.desc("model"))).cast("long")), "feature", "full")
