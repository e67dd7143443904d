"""Toxicity: two class-conditional Kneser-Ney models with a shared backoff."""

from __future__ import annotations

import posixpath
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import batched, join_groups, saved, shared_folder
from .labelled import held_out, known_labels, labelled_texts, likely_labelled
from .textcore import ALNUM, Words, as_bytes, column_bytes, mix, pieces

PER_LABEL = 2000  # labelled rows of each class that the fit of the four weights takes at most; the counts take all
PREFIXES = (3, 4, 5, 6, 7, 8)  # bytes of a word that the backoff keeps, coarsest first
DISCOUNT = 2.0
SPLIT = 4  # parts by which the neighbours of a word are counted, so that a very common word is not one task's
PARTS = ("all", "one", "two")  # all labelled rows, and either half of them
BROADCAST_KEYS = 1 << 20  # keys up to which the models are broadcast (25 MB); beyond, texts are joined with them


def _left(h: np.ndarray, doc_at: np.ndarray) -> np.ndarray:
    """Each word's left neighbour, 0 at the start of a text."""
    left = np.concatenate([np.zeros(1, np.uint64), h[:-1]]) if len(h) else h.copy()
    starts = doc_at[:-1]
    left[starts[starts < len(h)]] = 0
    return left


@dataclass
class Tokens:
    """Words of some texts: hash and first eight bytes, the left neighbours, the texts' bounds."""

    word: np.ndarray
    head: np.ndarray
    left: np.ndarray
    doc_at: np.ndarray

    def of(self) -> np.ndarray:
        """Each word's text."""
        return np.repeat(np.arange(len(self.doc_at) - 1), np.diff(self.doc_at))


def tokens(texts: list[bytes]) -> Tokens:
    w = Words(texts, ALNUM)
    buf, length = np.concatenate([w.buf, np.zeros(8, np.uint8)]), w.end - w.start
    head = np.zeros(len(w.start), np.uint64)
    for j in range(8):
        head |= np.where(length > j, buf[w.start + j], 0).astype(np.uint64) << np.uint64(8 * j)
    return Tokens(w.hash, head, _left(w.hash, w.doc_at), w.doc_at)


def _level_keys(t: Tokens) -> list[np.ndarray]:
    """Keys of the words on each backoff level: prefixes, then the word."""
    return [t.head & np.uint64((1 << 8 * k) - 1) for k in PREFIXES] + [t.word]


@dataclass
class Level:
    """Sorted keys of a level. step: log P(key | the level before) of the toxic model less that of the ordinary one; rest: the same of the key's
    continuations that no class has often enough to count."""

    keys: np.ndarray
    step: np.ndarray
    rest: np.ndarray


@dataclass
class Ratio:
    levels: list[Level]
    rest: float

    def of(self, t: Tokens) -> np.ndarray:
        """log P(word | toxic) - log P(word | ordinary) of each word. Where a level lacks the key, both models give the shared estimate, weighted by
        what each has left over, and so do all finer levels."""
        value, left, open_ = np.zeros(len(t.word)), np.full(len(t.word), self.rest), np.arange(len(t.word))
        for level, keys in zip(self.levels, _level_keys(t), strict=True):
            at = np.searchsorted(level.keys, keys[open_])
            found = np.append(level.keys, np.uint64(0))[at] == keys[open_]
            found &= at < len(level.keys)
            value[open_[~found]] += left[open_[~found]]
            open_, at = open_[found], at[found]
            value[open_] += level.step[at]
            left[open_] = level.rest[at]
        return value


def summarise(r: Ratio, t: Tokens) -> np.ndarray:
    """For each text: 1, then three length-normalised ratios of its words: their mean, their largest, and the logarithm of their mean
    likelihood ratio. Zeros without words."""
    out = np.zeros((len(t.doc_at) - 1, 4))
    out[:, 0] = 1
    n = np.diff(t.doc_at)
    has = np.flatnonzero(n)
    if len(has):
        value, at = r.of(t), t.doc_at[:-1][has]
        out[has, 1] = np.add.reduceat(value, at) / n[has]
        out[has, 2] = np.maximum.reduceat(value, at)
        out[has, 3] = np.log(np.add.reduceat(np.exp(np.clip(value, -10, 10)), at) / n[has])
    return out


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Newton's method with a small ridge."""
    b = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + np.diag([1e-3] + [0.05] * (x.shape[1] - 1))
        b = b - np.linalg.solve(hessian, x.T @ (p - y) + np.array([1e-3] + [0.05] * (x.shape[1] - 1)) * b)
    return b


def _half(id_col: str) -> Column:
    """The half of the labelled rows that an id belongs to, for scoring the weights' sample by counts of the other half."""
    return F.pmod(F.xxhash64(F.col(id_col).cast("string")), F.lit(2)).cast("int")


def _signed(a: np.ndarray) -> pa.Array:
    return pa.array(a.view(np.int64))


def _occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, head, part, lefts): the distinct left neighbours of each word of a batch, dealt to SPLIT parts by their hash. The lowest four bits of
    an entry tell the labels and halves it occurs in (bit 2 * label + half), the others are of the neighbour's hash."""
    for batch in batches:
        raw, found = column_bytes(batch, "text"), []
        kind = 2 * batch.column("_label").to_numpy(zero_copy_only=False) + batch.column("_half").to_numpy(zero_copy_only=False)
        for a, b in pieces(raw):
            t = tokens(raw[a:b])
            left = (mix(t.left) & ~np.uint64(15)) | (np.uint64(1) << kind[a:b][t.of()].astype(np.uint64))
            found.append(_once(t.word, t.head, left))
        word, head, left = _once(*(np.concatenate(x) for x in zip(*found))) if found else (np.zeros(0, np.uint64),) * 3
        part = (left >> np.uint64(4)) % np.uint64(SPLIT)
        order = np.lexsort((part, word))
        word, head, left, part = word[order], head[order], left[order], part[order]
        first = np.flatnonzero(np.concatenate([np.ones(min(1, len(word)), bool), (word[1:] != word[:-1]) | (part[1:] != part[:-1])]))
        lists = pa.ListArray.from_arrays(pa.array(np.append(first, len(word)).astype(np.int32)), _signed(left))
        yield pa.RecordBatch.from_arrays([_signed(word[first]), _signed(head[first]), pa.array(part[first].astype(np.int32)), lists], ["word", "head", "part", "lefts"])


def _once(word: np.ndarray, head: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each word and neighbour once, with the kinds of all its rows."""
    order = np.lexsort((left, word))
    word, head, left = word[order], head[order], left[order]
    same = (word[1:] == word[:-1]) & ((left[1:] ^ left[:-1]) < np.uint64(16))
    first = np.flatnonzero(np.concatenate([np.ones(min(1, len(word)), bool), ~same]))
    return word[first], head[first], np.bitwise_or.reduceat(left, first) if len(first) else left


def _table(df: DataFrame) -> DataFrame:
    """df as a written table in the shared folder."""
    path = posixpath.join(shared_folder(df.sparkSession), f"toxicity-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def vocabulary(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(word, head, all0, all1, one0, one1, two0, two1) of every word of every labelled training text: by how many left neighbours it follows in
    texts of label 0 and 1, among all of them and in either half. Counted on the executors, so it grows with the labelled rows."""
    known = known_labels(labels, "toxic", 3, 1).withColumn("_half", _half("_id"))
    texts = likely_labelled(docs.select(F.col("doc_id").alias("_doc"), "text").where("text is not null"), known, "_doc")
    texts = texts.join(known, F.col("_doc") == F.col("_id")).select("text", "_label", "_half")
    lists = batched(texts).mapInArrow(_occurrences, "word long, head long, part int, lefts array<long>").repartition("word", "part")
    kinds = F.bit_or(F.col("left").bitwiseAND(F.lit(15).cast("long"))).alias("kinds")
    pairs = lists.select("word", "head", "part", F.explode("lefts").alias("left")).groupBy("word", "part", "head", F.shiftright("left", 4).alias("left")).agg(kinds)
    bits = {"all0": 3, "all1": 12, "one0": 1, "one1": 4, "two0": 2, "two1": 8}
    return _table(pairs.groupBy("word", "head").agg(*(F.count_if(F.col("kinds").bitwiseAND(F.lit(b).cast("long")) > 0).alias(c) for c, b in bits.items())))


def _keys_of(level: int) -> Column:
    """The words' key on a level, as in _level_keys; a constant above the first."""
    if level < 0:
        return F.lit(0).cast("long")
    if level == len(PREFIXES):
        return F.col("word")
    k = PREFIXES[level]
    return F.col("head") if k == 8 else F.col("head").bitwiseAND(F.lit((1 << 8 * k) - 1).cast("long"))


def models(vocab: DataFrame) -> DataFrame:
    """(level, key, step_all, rest_all, step_one, ...): class-conditional Kneser-Ney continuation models, counted in all rows and in either half; level -1
    holds the rest of the whole vocabulary.

    A word counts once for each left neighbour it has in a class, so copied passages weigh nothing. A word backs off to its prefixes, longest
    first, so that rare expressions of a common stem share evidence, and at each step to the counts of both classes together. Each count is
    discounted by DISCOUNT, and the shared estimate deals out DISCOUNT for each key of a parent and one more. Counts of the ordinary class are scaled
    to the size of the toxic one, so that an unseen expression is no evidence for the class with fewer texts. Keys that no class
    has more than DISCOUNT times are left out, since what they'd give is their parent's rest. Estimates of whole bigrams are left out: on held-out
    rows they made the result worse (README).
    """
    counts = [f"{p}{c}" for p in PARTS for c in (0, 1)]
    totals = vocab.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in counts)).first()
    kept, sums = [], []
    for p in PARTS:
        scale = min(1.0, totals[f"{p}1"] / max(1, totals[f"{p}0"]))
        for c, by in ((0, scale), (1, 1.0)):
            kept.append((F.greatest(F.col(f"{p}{c}") - F.lit(DISCOUNT), F.lit(0.0)) * F.lit(by)).alias(f"k_{p}{c}"))
            sums.append(F.sum(f"k_{p}{c}").alias(f"s_{p}{c}"))
        kept.append((F.col(f"{p}0") * F.lit(scale) + F.col(f"{p}1")).alias(f"pooled_{p}"))
        sums.append(F.sum(f"pooled_{p}").alias(f"sp_{p}"))
        sums.append((F.lit(DISCOUNT) * (F.count_if(F.col(f"{p}0") + F.col(f"{p}1") > 0) + 1)).alias(f"given_{p}"))
    stem = _keys_of(0).alias("stem")
    all_counts = [F.sum(c).alias(c) for c in counts]
    root = vocab.groupBy(stem).agg(*all_counts).select("*", *kept).agg(*sums).select(F.lit(0).cast("long").alias("stem"), F.lit(0).alias("level"), F.lit(0).cast("long").alias("up"), "*")

    # one shuffle, by the first level's key; every finer level is grouped and joined where it lies
    at = F.explode(F.array(*(F.struct(F.lit(i).alias("level"), _keys_of(i - 1).alias("up"), _keys_of(i).alias("key")) for i in range(len(PREFIXES) + 1))))
    keys = vocab.withColumn("stem", stem).repartition("stem").select("stem", at.alias("at"), *counts).groupBy("stem", "at.level", "at.up", "at.key").agg(*all_counts).select("*", *kept)
    ups = keys.where("level > 0").groupBy("stem", "level", "up").agg(*sums)
    often = keys.where((F.col("all0") > DISCOUNT) | (F.col("all1") > DISCOUNT))
    of_root = F.broadcast(root.drop("stem", "up"))
    often = often.where("level = 0").join(of_root, "level").unionByName(often.where("level > 0").join(ups, ["stem", "level", "up"]))
    steps = []
    for p in PARTS:
        shared = F.col(f"given_{p}") * F.col(f"pooled_{p}") / F.greatest(F.col(f"sp_{p}"), F.lit(1e-12))
        both = [F.log(F.greatest((F.col(f"k_{p}{c}") + shared) / (F.col(f"s_{p}{c}") + F.col(f"given_{p}")), F.lit(1e-300))) for c in (0, 1)]
        steps.append((both[1] - both[0]).alias(f"step_{p}"))
    rests = [F.log((F.col(f"s_{p}0") + F.col(f"given_{p}")) / (F.col(f"s_{p}1") + F.col(f"given_{p}"))).alias(f"rest_{p}") for p in PARTS]
    below = [(F.col("level") - 1).alias("level"), F.col("up").alias("key"), *rests]
    found = often.select("stem", "level", "key", *steps).join(ups.select("stem", *below), ["stem", "level", "key"], "left").drop("stem").na.fill(0.0)
    return _table(found.unionByName(root.na.fill(0.0).select(*below, *(F.lit(0.0).alias(f"step_{p}") for p in PARTS))))


def _ratio(table: pa.Table, part: str) -> Ratio:
    """The model of a part from the collected rows of models."""
    level, key = table["level"].to_numpy(), table["key"].to_numpy().view(np.uint64)
    step, rest, found = table[f"step_{part}"].to_numpy(), table[f"rest_{part}"].to_numpy(), []
    for i in range(len(PREFIXES) + 1):
        own = np.flatnonzero(level == i)
        own = own[np.argsort(key[own])]
        found.append(Level(key[own], step[own], rest[own]))
    return Ratio(found, float(rest[level == -1].sum()))


def _values(types: DataFrame, model: DataFrame, part: str) -> DataFrame:
    """types (word, head, ...) with value, which is what Ratio.of gives, by joins of tables of the vocabulary's size."""
    top = model.where("level = -1").select(f"rest_{part}").first()
    out = types.select("*", F.lit(0.0).alias("value"), F.lit(float(top[0]) if top else 0.0).alias("_left"), F.lit(True).alias("_open"))
    for i in range(len(PREFIXES) + 1):
        level = model.where(F.col("level") == i).select(F.col("key").alias("_key"), F.col(f"step_{part}").alias("_step"), F.col(f"rest_{part}").alias("_rest"))
        found = out.withColumn("_of", _keys_of(i)).join(level, F.col("_open") & (F.col("_of") == F.col("_key")), "left")
        value = F.col("value") + F.when(F.col("_open"), F.coalesce("_step", F.col("_left"))).otherwise(F.lit(0.0))
        out = found.select(*types.columns, value.alias("value"), F.coalesce("_rest", F.lit(0.0)).alias("_left"), (F.col("_open") & F.col("_key").isNotNull()).alias("_open"))
    return saved(out.select(*types.columns, "value"))


def _text_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(_text, word, head, n): how often each text has each word."""
    for batch in batches:
        raw, name = column_bytes(batch, "text"), batch.column("_text")
        for a, b in pieces(raw):
            t = tokens(raw[a:b])
            of = t.of()
            order = np.lexsort((t.word, of))
            of, word = of[order], t.word[order]
            first = np.flatnonzero(np.concatenate([np.ones(min(1, len(of)), bool), (of[1:] != of[:-1]) | (word[1:] != word[:-1])]))
            n = np.diff(np.append(first, len(of)))
            yield pa.RecordBatch.from_arrays([name.take(pa.array(of[first] + a)), _signed(word[first]), _signed(t.head[order][first]), pa.array(n.astype(np.int64))], ["_text", "word", "head", "n"])


def joined_summaries(texts: DataFrame, model: DataFrame, part: str) -> DataFrame:
    """(_text, mean, most, likely): what summarise gives of each text (_text, text) that has words, for models of any size. Words of
    texts are joined with their values, the common ones by broadcast."""
    words = saved(batched(texts).mapInArrow(_text_words, "_text string, word long, head long, n long"))
    types = words.groupBy("word").agg(F.min("head").alias("head"), F.count("*").alias("copies"))
    found = join_groups(words.select("_text", "word", "n"), _values(types, model, part).select("word", "copies", "value"), ["word"], "copies", words.count())
    n, likely = F.sum("n"), F.exp(F.greatest(F.least("value", F.lit(10.0)), F.lit(-10.0)))
    return found.groupBy("_text").agg((F.sum(F.col("value") * F.col("n")) / n).alias("mean"), F.max("value").alias("most"), F.log(F.sum(likely * F.col("n")) / n).alias("likely"))


SUMMARIES = ["mean", "most", "likely"]


def _weights(x: np.ndarray, label: np.ndarray, prior: float) -> np.ndarray:
    """Weights of the summaries x of a sample that was drawn by class, shifted to prior, the share of label 1 among all labelled rows."""
    if len(label) == 0 or min(np.bincount(label, minlength=2)) < 4:
        share = (label.sum() + 0.5) / (len(label) + 1)
        return np.array([np.log(share / (1 - share)), 0, 0, 0])
    weights = _logistic(x, label.astype(float))
    weights[0] += np.log(prior / (1 - prior)) - np.log(label.mean() / (1 - label.mean()))
    return weights


def _prior(labels: DataFrame) -> float:
    share = known_labels(labels, "toxic", 3, 1).agg(F.avg("_label")).first()[0]
    return float(np.clip(0.5 if share is None else share, 1e-3, 1 - 1e-3))


def toxicity_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, per_label: int = PER_LABEL, most_keys: int = BROADCAST_KEYS) -> DataFrame:
    """doc_id, held_out, score (0 to 1, higher: label 1 likelier) and predicted of each row of docs.

    Words are runs of letters and digits, lower-cased. The score is a logistic function of length-normalised log-likelihood ratios of
    the toxic to the ordinary model; see summarise. The models count all labelled training rows; the four weights are fitted to at most per_label
    rows of each class (labelled.labelled_texts), each scored by counts of the half of the rows that it isn't in. Models of up to most_keys keys
    are broadcast, larger ones are joined, with the same scores. The text alone decides. A null
    text counts as empty; a text without words gets the score of ratio 0. Very long texts count whole. Repeated rows score alike; a score equal to
    threshold is predicted 1. Null labels, labels other than 0 and 1 and labels of ids that aren't in docs don't count; without labels every score is 0.5.
    An empty table gives no rows. Other columns are ignored.
    """
    model = models(vocabulary(docs, labels))
    rows = labelled_texts(docs, labels, "toxic", per_label, 3, 1, ["text"]).select(F.col("id").cast("string"), "label", "text", _half("id").alias("half"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    result = [held_out("doc_id", 3, 1).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")]
    if model.count() > most_keys:
        return _joined_scores(docs, rows, model, _prior(labels)).select("doc_id", *result)

    known = model.toArrow()
    sent = docs.sparkSession.sparkContext.broadcast({part: _ratio(known, part) for part in PARTS})
    del known

    def summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, half, parts = column_bytes(batch, "text"), batch.column("half").to_numpy(zero_copy_only=False), [np.zeros((0, 4))]
            for a, b in pieces(raw):
                t = tokens(raw[a:b])
                parts.append(np.where((half[a:b] == 0)[:, None], summarise(sent.value["two"], t), summarise(sent.value["one"], t)))
            x = np.concatenate(parts)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), *(pa.array(x[:, i]) for i in (1, 2, 3))], ["id", "label", *SUMMARIES])

    got = batched(rows).mapInArrow(summaries, "id string, label int, mean double, most double, likely double").toPandas().sort_values("id")
    x = np.column_stack([np.ones(len(got)), got[SUMMARIES].to_numpy(float)])
    weights = _weights(x, got["label"].to_numpy(np.int64), _prior(labels))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ratio = sent.value["all"]
        for batch in batches:
            raw, parts = column_bytes(batch, "text"), [np.zeros(0)]
            for a, b in pieces(raw):
                parts.append(1 / (1 + np.exp(-np.clip(summarise(ratio, tokens(raw[a:b])) @ weights, -30, 30))))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.concatenate(parts))], ["doc_id", "score"])

    return batched(docs.select("doc_id", "text")).mapInArrow(score, f"doc_id {kind}, score double").select("doc_id", *result)


def _joined_scores(docs: DataFrame, rows: DataFrame, model: DataFrame, prior: float) -> DataFrame:
    """(doc_id, score) by joins with the models. Equal texts are scored once."""
    name = F.sha2(F.coalesce("text", F.lit("")), 256).alias("_text")
    sample = saved(rows.select(name, "text", "label", "half"))
    parts = []
    for k, other in ((0, "two"), (1, "one")):
        own = sample.where(F.col("half") == k)
        parts.append(own.select("_text", "label").join(joined_summaries(own.select("_text", "text").dropDuplicates(["_text"]), model, other), "_text", "left"))
    got = parts[0].unionByName(parts[1]).toPandas().sort_values(["_text", "label"])
    x = np.column_stack([np.ones(len(got)), got[SUMMARIES].to_numpy(float)])
    weights = _weights(np.nan_to_num(x), got["label"].to_numpy(np.int64), prior)

    ids = docs.select("doc_id", name, "text")
    found = joined_summaries(ids.select("_text", "text").dropDuplicates(["_text"]), model, "all")
    groups = ids.groupBy("_text").agg(F.count("*").alias("copies")).join(found, "_text", "left")
    margin = F.lit(float(weights[0]))
    for w, c in zip(weights[1:], SUMMARIES, strict=True):
        margin = margin + F.lit(float(w)) * F.coalesce(c, F.lit(0.0))
    score = 1 / (1 + F.exp(-F.greatest(F.least(margin, F.lit(30.0)), F.lit(-30.0))))
    return join_groups(ids.select("doc_id", "_text"), saved(groups), ["_text"], "copies", docs.count()).select("doc_id", score.alias("score"))
