"""Quality classifier: a factorisation machine over hashed words, structure statistics and the length from the metadata."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batched
from .labelled import held_out, label_counts, labelled_texts
from .textcore import NON_SPACE, Words, column_bytes, pieces

BUCKETS = 1 << 15  # of hashed words
STATS = 16  # dense features after them
PER_LABEL = 2000  # labelled rows of each class that the fit takes at most
RANK = 8

_CLASS = np.zeros((5, 256), bool)
_CLASS[0, 0x41:0x5B] = True  # capitals, before lower-casing
_CLASS[1, 0x30:0x3A] = True  # digits
_CLASS[2, [c for c in range(0x21, 0x7F) if not chr(c).isalnum()]] = True  # symbols
_CLASS[3, [ord(c) for c in ".,;:'?-()"]] = True  # of these, those of plain prose
_CLASS[4, 0x0A] = True  # line ends


@dataclass
class Features:
    """Sparse rows: entries row_at[i]:row_at[i+1] of column and value are those of text i."""

    row_at: np.ndarray
    column: np.ndarray
    value: np.ndarray


def _line_repeats(t: bytes) -> float:
    lines = [x for x in t.split(b"\n") if x.strip()]
    return 1 - len(set(lines)) / len(lines) if lines else 0.0


def featurise(texts: list[bytes], n_chars: np.ndarray) -> Features:
    """n_chars: the length in the metadata, NaN where it is missing; the text's bytes then stand in."""
    w = Words(texts, NON_SPACE)
    counts, docs = w.counts(), w.doc_of()
    pairs, times = np.unique(docs * BUCKETS + (w.hash & np.uint64(BUCKETS - 1)).astype(np.int64), return_counts=True)
    row = pairs // BUCKETS
    value = 1 + np.log(times)
    norm = np.sqrt(np.bincount(row, value**2, len(texts)))
    size = np.fromiter(map(len, texts), np.float64, len(texts))
    raw = np.frombuffer(b"\n".join(texts), np.uint8)
    shares = []
    for table in _CLASS:
        total = np.concatenate([[0], np.cumsum(table[raw], dtype=np.int64)])
        ends = np.minimum(w.text_at[1:], len(raw))
        shares.append((total[np.maximum(w.text_at[1:] - 1, 0)] - total[np.minimum(w.text_at[:-1], ends)]) / np.maximum(size, 1))
    length = (w.end - w.start).astype(np.float64)
    words = np.maximum(counts, 1)
    mean = np.bincount(docs, length, len(texts)) / words
    spread = np.sqrt(np.maximum(np.bincount(docs, length**2, len(texts)) / words - mean**2, 0))
    ends_alnum = np.isin(w.buf[w.end - 1], np.frombuffer(b".,;:?)", np.uint8)) if len(w.end) else np.zeros(0, bool)
    odd_end = _CLASS[2][w.buf[w.end - 1]] & ~ends_alnum if len(w.end) else np.zeros(0, bool)
    chars = np.where(np.isnan(n_chars), size, n_chars)
    single = (length == 1) & _CLASS[2][w.buf[w.start]] if len(length) else np.zeros(0, bool)
    short = length <= 3
    dense = np.stack(
        [
            np.log1p(size) / 10,
            np.log1p(counts) / 8,
            np.log1p(np.maximum(chars, 0)) / 10,
            shares[0] * 3,
            shares[1] * 5,
            shares[2] * 5,
            (shares[2] - shares[3]) * 8,
            shares[4] * 20,
            mean / 10,
            spread / 6,
            np.bincount(row, minlength=len(texts)) / words,
            np.bincount(docs, odd_end, len(texts)) / words * 2,
            np.bincount(docs, single, len(texts)) / words * 3,
            np.bincount(docs, short, len(texts)) / words * 2,
            np.bincount(docs, ends_alnum, len(texts)) / words * 3,
            np.fromiter(map(_line_repeats, texts), np.float64, len(texts)) * 2,
        ],
        axis=1,
    )
    rows = np.concatenate([row, np.repeat(np.arange(len(texts)), STATS)])
    order = np.argsort(rows, kind="stable")
    column = np.concatenate([pairs % BUCKETS, np.tile(np.arange(BUCKETS, BUCKETS + STATS), len(texts))])[order]
    return Features(np.searchsorted(rows[order], np.arange(len(texts) + 1)), column, np.concatenate([value / np.maximum(norm[row], 1e-9), dense.ravel()])[order])


@dataclass
class Machine:
    bias: float
    weight: np.ndarray
    factor: np.ndarray

    def score(self, x: Features) -> np.ndarray:
        """Probability of label 1. Pairs cost as much as single features: sum of v_i.v_j x_i x_j = ((sum v x)^2 - sum (v x)^2) / 2."""
        return 1 / (1 + np.exp(-np.clip(self._margin(x)[0], -30, 30)))

    def _margin(self, x: Features) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Every row has its dense features, so no row is empty and reduceat is safe."""
        at = x.row_at[:-1]
        if not len(at):
            return np.zeros(0), np.zeros((0, RANK)), np.zeros((0, RANK))
        vx = self.factor[x.column] * x.value[:, None]
        total = np.add.reduceat(vx, at, axis=0)
        return self.bias + np.add.reduceat(self.weight[x.column] * x.value, at) + 0.5 * (total**2 - np.add.reduceat(vx**2, at, axis=0)).sum(axis=1), total, vx


def _rows(x: Features, rows: np.ndarray) -> Features:
    length = x.row_at[rows + 1] - x.row_at[rows]
    at = np.concatenate([[0], np.cumsum(length)])
    take = np.repeat(x.row_at[rows] - at[:-1], length) + np.arange(at[-1])
    return Features(at, x.column[take], x.value[take])


def fit(x: Features, y: np.ndarray, epochs: int = 12, batch: int = 256, rate: float = 0.02, decay: float = 1e-4) -> Machine:
    """Adam on the log loss. Without rows, every score is a half."""
    size, rng = BUCKETS + STATS, np.random.Generator(np.random.PCG64(5))
    m = Machine(0.0, np.zeros(size), rng.normal(0, 0.02, (size, RANK)))
    if not len(y):
        return Machine(0.0, m.weight, m.factor * 0)
    share = np.clip(y.mean(), 0.01, 0.99)
    m.bias = float(np.log(share / (1 - share)))
    moments = [np.zeros(size), np.zeros(size), np.zeros((size, RANK)), np.zeros((size, RANK))]
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for a in range(0, len(y), batch):
            rows = order[a : a + batch]
            b = _rows(x, rows)
            margin, total, vx = m._margin(b)
            error = (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - y[rows]) / len(rows)
            of = np.repeat(np.arange(len(rows)), np.diff(b.row_at))
            g = error[of] * b.value
            step += 1
            m.bias -= rate * float(error.sum())
            gw = np.bincount(b.column, g, size) + decay * m.weight
            gv = decay * m.factor
            pair = g[:, None] * (total[of] - vx)
            for k in range(RANK):
                gv[:, k] += np.bincount(b.column, pair[:, k], size)
            for p, q, value, grad in ((0, 1, m.weight, gw), (2, 3, m.factor, gv)):
                moments[p] = 0.9 * moments[p] + 0.1 * grad
                moments[q] = 0.999 * moments[q] + 0.001 * grad**2
                value -= rate * (moments[p] / (1 - 0.9**step)) / (np.sqrt(moments[q] / (1 - 0.999**step)) + 1e-8)
    return m


def _lengths(batch: pa.RecordBatch) -> np.ndarray:
    return np.array([np.nan if x is None else float(x) for x in batch.column(batch.schema.names.index("n_chars")).to_pylist()])


def _with_length(docs: DataFrame) -> DataFrame:
    return docs if "n_chars" in docs.columns else docs.withColumn("n_chars", F.lit(None).cast("long"))


def train(docs: DataFrame, labels: DataFrame, per_label: int = PER_LABEL) -> Machine:
    """A machine fitted to at most per_label rows of each class whose crc32(id) mod 5 isn't 0; see labelled.sample_ids. The executors
    compute the features; only those of the sample reach the driver. The bias is shifted from the log odds of the sample to those of all
    training rows, so that a score means the same however many rows of a class are left out."""
    rows = labelled_texts(_with_length(docs), labels, "quality", per_label, 5, 0, ["text", "n_chars"])

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = featurise(column_bytes(batch, "text"), _lengths(batch))
            cut = [slice(a, b) for a, b in zip(x.row_at[:-1], x.row_at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("id").cast(pa.string()), batch.column("label").cast(pa.int32()), pa.array([x.column[c].astype(np.int32).tobytes() for c in cut], pa.binary()), pa.array([x.value[c].astype(np.float32).tobytes() for c in cut], pa.binary())], ["id", "label", "c", "v"])

    got = batched(rows).mapInArrow(features, "id string, label int, c binary, v binary").toPandas().sort_values("id")
    columns = [np.frombuffer(c, np.int32) for c in got["c"]]
    x = Features(np.concatenate([[0], np.cumsum([len(c) for c in columns])]).astype(np.int64), np.concatenate([*columns, np.empty(0, np.int32)]).astype(np.int64), np.concatenate([*(np.frombuffer(v, np.float32) for v in got["v"]), np.empty(0, np.float32)]).astype(np.float64))
    m = fit(x, got["label"].to_numpy(np.float64))
    if 0 < (ones := int(got["label"].sum())) < len(got):
        bad, good = label_counts(docs, labels, "quality", 5, 0)
        m.bias += float(np.log(good / bad) - np.log(ones / (len(got) - ones)))
    return Machine(m.bias, m.weight.astype(np.float32), m.factor.astype(np.float32))


def _scores(m: Machine, batch: pa.RecordBatch, text_col: str) -> np.ndarray:
    raw, n_chars = column_bytes(batch, text_col), _lengths(batch)
    parts = [m.score(featurise(raw[a:b], n_chars[a:b])) for a, b in pieces(raw)]
    return np.concatenate([np.zeros(0), *parts]).astype(np.float64)


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, per_label: int = PER_LABEL) -> DataFrame:
    """doc_id, held_out, score (0 to 1, higher: label 1 likelier) and predicted of each row of docs.

    The model sees the text and n_chars, nothing else. A null text counts as empty and is scored by its structure statistics;
    a null or missing n_chars by the text's length. Repeated rows score alike. Labels of ids that aren't in docs, null labels and
    labels other than 0 and 1 don't count. Very long texts are scored whole, but don't teach (labelled.bounded). A score equal to threshold is
    predicted 1. Without labelled rows every score is 0.5; an empty table gives no rows. Other columns are ignored.
    """
    sent = docs.sparkSession.sparkContext.broadcast(train(docs, labels, per_label))
    rows = _with_length(docs).select("doc_id", "text", "n_chars")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(_scores(sent.value, batch, "text"))], ["doc_id", "score"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return batched(rows).mapInArrow(score, f"doc_id {kind}, score double").select("doc_id", held_out("doc_id", 5, 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, per_label: int = PER_LABEL) -> DataFrame:
    """The rows of docs that score at least threshold, with their own columns, scored as in quality_scores. Repeated rows stay or go together, null and
    empty texts by their score; without labelled rows all stay up to a threshold of 0.5. An empty table gives no rows."""
    sent = docs.sparkSession.sparkContext.broadcast(train(docs, labels, per_label))
    own = docs.schema

    def good(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(_scores(sent.value, batch, "text") >= threshold))

    return batched(_with_length(docs)).mapInArrow(good, _with_length(docs).schema).select(*(F.col(f"`{c}`") for c in own.names))
