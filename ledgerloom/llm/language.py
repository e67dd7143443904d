"""Language identification: word-first backoff to shorter and shorter character n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batched
from .labelled import bounded, held_out
from .textcore import LETTERS, Words, column_bytes, mix, pieces

PER_LANG = 400  # documents of each language that the fit takes, about
LONGEST = 5
SURE_WORDS = 20  # a text's mean evidence counts as that of so many words at most


def _word_texts(w: Words, which: np.ndarray) -> list[str]:
    raw = w.buf.tobytes()
    return [raw[a:b].decode("utf-8", "replace").lower() for a, b in zip(w.start[which].tolist(), w.end[which].tolist(), strict=True)]


def _ngrams(words: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each length from 1: (hash, word) of every n-gram of the words, each word between two marks; position by position, so that
    entry i of every length ends at the same place. Word is -1 where the n-gram would reach over the word's start."""
    joined = "".join(f"\0{x}\0" for x in words)
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    of = np.repeat(np.arange(len(words)), np.fromiter((len(x) + 2 for x in words), np.int64, len(words)))
    out, h = [], np.zeros(len(points), np.uint64)
    for n in range(1, LONGEST + 1):
        if n > len(points):
            out.append((h, np.full(len(points), -1)))
            continue
        h = np.concatenate([np.zeros(n - 1, np.uint64), mix((h[n - 2 : -1] if n > 1 else np.zeros(len(points), np.uint64)) * np.uint64(0x9FB21C651E98DF25) + points[n - 1 :] + np.uint64(n << 32))])
        valid = np.concatenate([np.full(n - 1, False), of[n - 1 :] == of[: len(of) - n + 1]])
        if n == 1:
            valid &= points != 0
        out.append((h, np.where(valid, of, -1)))
    return out


@dataclass
class Table:
    keys: np.ndarray  # sorted
    log_p: np.ndarray  # keys x languages

    def find(self, h: np.ndarray) -> np.ndarray:
        """Index of each h, -1 if unknown."""
        if not len(self.keys):
            return np.full(len(h), -1)
        at = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
        return np.where(self.keys[at] == h, at, -1)


def _table(h: np.ndarray, lang: np.ndarray, weight: np.ndarray, langs: int, least: int) -> Table:
    keys, at = np.unique(h, return_inverse=True)
    counts = np.stack([np.bincount(at[lang == g], weight[lang == g], len(keys)) for g in range(langs)], axis=1) if len(keys) else np.zeros((0, langs))
    often = counts.sum(axis=1) >= least
    total = counts.sum(axis=0)
    return Table(keys[often], np.log((counts[often] + 0.1) / (total + 0.1 * max(1, len(keys)))).astype(np.float32))


@dataclass
class Model:
    langs: list[str]
    words: Table
    grams: list[Table]

    def of_words(self, words: list[str]) -> np.ndarray:
        """Evidence of unseen words: the mean over positions of the longest known n-gram that ends there."""
        out, n = np.zeros((len(words), len(self.langs))), np.zeros(len(words))
        if not words:
            return out
        grams = _ngrams(words)
        open_at = np.arange(len(grams[0][0]))
        for table, (h, of) in zip(self.grams[::-1], grams[::-1], strict=True):
            at = table.find(h[open_at])
            found = (at >= 0) & (of[open_at] >= 0)
            own = of[open_at[found]]
            rows = table.log_p[at[found]]
            n += np.bincount(own, minlength=len(words))
            for g in range(len(self.langs)):
                out[:, g] += np.bincount(own, rows[:, g], len(words))
            open_at = open_at[~found]
        return out / np.maximum(n, 1)[:, None]

    def evidence(self, w: Words) -> np.ndarray:
        """Mean evidence of each text's words."""
        keys, first, of = np.unique(w.hash, return_index=True, return_inverse=True)
        at = self.words.find(keys)
        rows = np.zeros((len(keys), len(self.langs)))
        known = at >= 0
        rows[known] = self.words.log_p[at[known]]
        rows[~known] = self.of_words(_word_texts(w, first[~known]))
        docs, counts = w.doc_of(), w.counts()
        total = np.stack([np.bincount(docs, rows[of, g], len(counts)) for g in range(len(self.langs))], axis=1)
        return total / np.maximum(counts, 1)[:, None]


def fit(texts: list[bytes], langs: list[str]) -> Model:
    """Words seen twice or more get a log frequency in each language; n-grams come from the distinct words, with their counts damped."""
    names = sorted(set(langs), key=lambda x: x.encode())
    index = {x: i for i, x in enumerate(names)}
    lang_of_doc = np.array([index[x] for x in langs], np.int64)
    w = Words(texts, LETTERS)
    lang = lang_of_doc[w.doc_of()] if len(w.start) else np.empty(0, np.int64)
    words = _table(w.hash, lang, np.ones(len(lang)), len(names), 2)
    _, first, times = np.unique(mix(w.hash) + lang.astype(np.uint64), return_index=True, return_counts=True)
    weight, pair_lang = np.sqrt(times), lang[first]
    grams = []
    for n, (h, of) in enumerate(_ngrams(_word_texts(w, first)), 1):
        own = of >= 0
        grams.append(_table(h[own], pair_lang[of[own]], weight[of[own]], len(names), 1 if n < 3 else 3))
    return Model(names, words, grams)


def train(docs: DataFrame, per_lang: int = PER_LANG) -> Model:
    """A model of about per_lang documents of each language (those whose id hashes least) whose crc32(id) mod 3 isn't 1. Each language's
    share is known from a count over all rows; the sample reaches the driver, repeated rows once and with at most SAMPLE_BYTES of text a language."""
    own = docs.where(F.col("lang").isNotNull() & ~held_out("doc_id", 3, 1)).select("doc_id", "text", F.col("lang").cast("string").alias("lang"))
    counts = {r.lang: r.n for r in own.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return Model([], Table(np.empty(0, np.uint64), np.zeros((0, 0), np.float32)), [])
    fine = 1 << 30
    below = F.create_map(*(F.lit(x) for k, n in counts.items() for x in (k, min(fine, fine * per_lang // n))))
    place = F.pmod(F.xxhash64("doc_id", "text"), F.lit(fine))
    chosen = own.where(place < below[F.col("lang")]).select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "lang", place.alias("place")).distinct()
    got = bounded(chosen, "lang", F.col("place")).toPandas().sort_values(["doc_id", "lang", "text"])
    return fit([t.encode("utf-8", "surrogatepass") for t in got["text"]], got["lang"].tolist())


def languages(docs: DataFrame, per_lang: int = PER_LANG) -> DataFrame:
    """doc_id, held_out, lang_pred and score (the prediction's posterior, 0 to 1) of each row of docs.

    A text's words (runs of letters, lower-cased) speak first: one that the sample knows counts with its log frequency in each language,
    an unseen one with its longest known character n-grams, of five characters down to one. The text alone decides. A text that is null
    or has no letter gets und and score 0, as every text does where no language can be learned. Ties go to the language that is first by
    code point. Very long texts are predicted whole, but don't teach (labelled.bounded). Repeated rows are predicted alike. Rows without lang teach
    nothing, a null id counts as the empty one. An empty table gives no rows. Other columns are ignored.
    """
    sent = docs.sparkSession.sparkContext.broadcast(train(docs, per_lang))
    rows = docs.select("doc_id", "text")

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for batch in batches:
            raw = column_bytes(batch, "text")
            names: list[str] = []
            score: list[float] = []
            for a, b in pieces(raw):
                w = Words(raw[a:b], LETTERS)
                ascii_letter = np.zeros(b - a, bool)
                docs_of = w.doc_of()
                letters = np.concatenate([[0], np.cumsum((w.buf >= 0x61) & (w.buf <= 0x7A))])
                ascii_letter[docs_of[letters[w.end] > letters[w.start]]] = True
                if not m.langs:
                    names += ["und"] * (b - a)
                    score += [0.0] * (b - a)
                    continue
                e = m.evidence(w) * np.minimum(w.counts(), SURE_WORDS)[:, None]
                p = np.exp(e - e.max(axis=1, keepdims=True))
                p /= p.sum(axis=1, keepdims=True)
                best = p.argmax(axis=1)
                for i, g in enumerate(best.tolist()):
                    if ascii_letter[i] or any(c.isalpha() for c in raw[a + i].decode("utf-8", "replace")):
                        names.append(m.langs[g])
                        score.append(float(p[i, g]))
                    else:
                        names.append("und")
                        score.append(0.0)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(names, pa.string()), pa.array(score, pa.float64())], ["doc_id", "lang_pred", "score"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return batched(rows).mapInArrow(predict, f"doc_id {kind}, lang_pred string, score double").select("doc_id", held_out("doc_id", 3, 1).alias("held_out"), "lang_pred", "score")
