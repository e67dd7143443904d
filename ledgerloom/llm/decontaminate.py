"""Benchmark decontamination by winnowed fingerprints."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batched, saved
from .textcore import ALNUM, Words, as_bytes, column_bytes, kgrams, pieces

#: Bytes of benchmark text that a block holds; a larger benchmark is matched block by block.
BLOCK_BYTES = 16 << 20


@dataclass
class Fingerprints:
    """Winnowed fingerprints of one block of benchmark items, and its items shorter than a window, by length."""

    span: int
    k: int
    words: np.ndarray  # word hashes of all items, end to end
    item_at: np.ndarray
    ids: list[list[str]]  # of each item text, the ids of all items with that text
    fp: np.ndarray  # sorted
    fp_item: np.ndarray
    fp_pos: np.ndarray
    short: dict[int, tuple[np.ndarray, np.ndarray]]  # length -> sorted hashes, items


def winnow(grams: np.ndarray, window: int) -> np.ndarray:
    """True where a k-gram hash is the least of some window of that many consecutive ones. All positions of an equal least
    hash are taken, so the choice depends on the window's content alone."""
    n = len(grams) - window + 1
    if n < 1:
        return np.zeros(len(grams), bool)
    least = grams[:n].copy()
    for i in range(1, window):
        np.minimum(least, grams[i : n + i], out=least)
    taken = np.zeros(len(grams), bool)
    for i in range(window):
        taken[i : n + i] |= grams[i : n + i] == least
    return taken


def fingerprints(ids: list[list[str]], texts: list, span: int, k: int) -> Fingerprints:
    w = Words(as_bytes(texts), ALNUM)
    fps, items, places = [], [], []
    short: dict[int, list[tuple[int, int]]] = {}
    for i, (a, b) in enumerate(zip(w.doc_at[:-1], w.doc_at[1:], strict=True)):
        if b - a >= span:
            g = kgrams(w.hash[a:b], k)
            at = np.flatnonzero(winnow(g, span - k + 1))
            fps.append(g[at])
            items.append(np.full(len(at), i))
            places.append(at)
        elif b > a:
            short.setdefault(int(b - a), []).append((int(kgrams(w.hash[a:b], int(b - a))[0]), i))
    none = np.empty(0, np.int64)
    fp = np.concatenate(fps) if fps else np.empty(0, np.uint64)
    order = np.argsort(fp, kind="stable")
    packed = {}
    for m, pairs in short.items():
        pairs.sort()
        packed[m] = (np.array([p[0] for p in pairs], np.uint64), np.array([p[1] for p in pairs]))
    return Fingerprints(span, k, w.hash, w.doc_at, ids, fp[order], (np.concatenate(items) if items else none)[order], (np.concatenate(places) if places else none)[order], packed)


def _among(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Positions of values that occur in sorted known; a table of low bits turns most away first."""
    if not len(known):
        return np.empty(0, np.int64)
    bits = 20
    table = np.zeros(1 << bits, bool)
    table[(known & np.uint64((1 << bits) - 1)).astype(np.int64)] = True
    at = np.flatnonzero(table[(values & np.uint64((1 << bits) - 1)).astype(np.int64)])
    found = np.searchsorted(known, values[at])
    return at[known[np.minimum(found, len(known) - 1)] == values[at]]


def match(w: Words, f: Fingerprints) -> dict[int, tuple[list[tuple[int, int]], set[int]]]:
    """For each text with a hit: word ranges, relative to the text, and items."""
    out: dict[int, tuple[list[tuple[int, int]], set[int]]] = {}
    doc_at = w.doc_at

    def hit(doc: int, a: int, b: int, item: int) -> None:
        spans, items = out.setdefault(doc, ([], set()))
        spans.append((a - int(doc_at[doc]), b - int(doc_at[doc])))
        items.add(item)

    for m, (known, items) in f.short.items():
        grams = kgrams(w.hash, m)
        at = _among(grams, known)
        docs = np.searchsorted(doc_at, at, "right") - 1
        for p, doc in zip(at[at + m <= doc_at[docs + 1]].tolist(), docs[at + m <= doc_at[docs + 1]].tolist(), strict=True):
            for i in range(np.searchsorted(known, grams[p], "left"), np.searchsorted(known, grams[p], "right")):
                hit(doc, p, p + m, int(items[i]))
    if len(f.fp):
        grams = kgrams(w.hash, f.k)
        at = _among(grams, f.fp)
        docs = np.searchsorted(doc_at, at, "right") - 1
        inside = at + f.k <= doc_at[docs + 1]
        done: dict[tuple[int, int], int] = {}  # item and diagonal -> end of its last extension
        now = -1
        for p, doc in zip(at[inside].tolist(), docs[inside].tolist(), strict=True):
            if doc != now:
                now, done = doc, {}
            lo, hi = int(doc_at[doc]), int(doc_at[doc + 1])
            for i in range(np.searchsorted(f.fp, grams[p], "left"), np.searchsorted(f.fp, grams[p], "right")):
                item = int(f.fp_item[i])
                ia, ib = int(f.item_at[item]), int(f.item_at[item + 1])
                q = ia + int(f.fp_pos[i])
                if done.get((item, p - q), -1) > p:
                    continue
                left = min(p - lo, q - ia)
                same = w.hash[p - left : p][::-1] == f.words[q - left : q][::-1]
                back = left if same.all() else int(np.argmin(same))
                right = min(hi - p, ib - q)
                same = w.hash[p : p + right] == f.words[q : q + right]
                on = right if same.all() else int(np.argmin(same))
                done[item, p - q] = p + on
                if back + on >= f.span:
                    hit(doc, p - back, p + on, item)
    return out


def covered(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The union of spans as disjoint ranges in order."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _blocks(benchmark: DataFrame, item_id: str, item_text: str, span: int, k: int, block_bytes: int) -> tuple[int, Iterator[Broadcast]]:
    """The number of blocks, and the broadcast fingerprints of one block at a time. Items of equal text are matched as one."""
    items = benchmark.select(F.coalesce(F.col(item_id).cast("string"), F.lit("null")).alias("id"), F.coalesce(F.col(item_text), F.lit("")).alias("text"))
    items = saved(items.groupBy("text").agg(F.array_sort(F.collect_set("id")).alias("ids")))
    blocks = max(1, -(-(items.agg(F.sum(F.octet_length("text") + F.aggregate("ids", F.lit(0), lambda n, x: n + F.octet_length(x)))).first()[0] or 0) // block_bytes))

    def sent() -> Iterator[Broadcast]:
        for block in range(blocks):
            rows = items.where(F.pmod(F.xxhash64("text"), F.lit(blocks)) == block).orderBy("text").collect()
            yield benchmark.sparkSession.sparkContext.broadcast(fingerprints([r.ids for r in rows], [r.text for r in rows], span, k))

    return blocks, sent()


_SPANS, _ITEMS = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())])), pa.list_(pa.string())


def mark_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", span: int = 10, k: int = 5, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """id, n_words, spans (disjoint ranges of words that lie in an occurrence of a window of some item, in order) and items (ids
    of items with an occurring window, sorted as strings) of each row of docs.

    Words are runs of letters and digits (bytes 30-39, 61-7A after lower-casing A-Z, and all above 7F). A window is span
    consecutive words of an item; an item with fewer words, but not none, is one window. Method: winnowing. Of each span - k + 1
    consecutive k-gram hashes the least is a fingerprint, on both sides, so every shared run of span words shares one. Each match
    of fingerprints is extended word by word in both directions, and counts where it reaches span words. The fingerprints meet
    inside the scan of docs, without a shuffle.

    What is sent to the executors is bounded: items are dealt into blocks of about block_bytes of text, and a benchmark of more
    blocks is matched block after block, the marks saved in between. Only one block is on the driver at a time.

    Null texts have no words; texts of any length are matched whole, in pieces of bounded size. Null items count as empty and match nothing; null item ids appear
    as "null". Repeated rows are marked alike, each on its own; repeated items count once. Other columns of either table are ignored, whatever their names. Empty tables give no rows or no marks.
    """
    blocks, sent = _blocks(benchmark, item_id, item_text, span, k, block_bytes)
    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.lit(0).cast("long").alias("n_words"), F.array().cast("array<struct<a:long,b:long>>").alias("spans"), F.array().cast("array<string>").alias("items"))
    for block, known in enumerate(sent):

        last = block + 1 == blocks

        def mark(batches: Iterator[pa.RecordBatch], known=known, last=last) -> Iterator[pa.RecordBatch]:
            f = known.value
            for batch in batches:
                raw, n_words = column_bytes(batch, "text"), []
                spans, items = batch.column("spans").to_pylist(), batch.column("items").to_pylist()
                for a, b in pieces(raw):
                    w = Words(raw[a:b], ALNUM)
                    n_words.extend(w.counts().tolist())
                    for doc, (new, found) in match(w, f).items():
                        before = [(s["a"], s["b"]) for s in spans[a + doc]]
                        spans[a + doc] = [{"a": x, "b": y} for x, y in covered(before + new)]
                        items[a + doc] = sorted({*items[a + doc], *(x for i in found for x in f.ids[i])})
                made = {"id": batch.column("id"), "text": batch.column("text"), "n_words": pa.array(n_words, pa.int64()), "spans": pa.array(spans, _SPANS), "items": pa.array(items, _ITEMS)}
                if last:  # the text has served
                    del made["text"]
                yield pa.RecordBatch.from_arrays(list(made.values()), list(made))

        schema = (out.drop("text") if last else out).schema
        out = batched(out).mapInArrow(mark, schema)
        if not last:
            out = saved(out)
    return out.select(F.col("id").alias(id_col), "n_words", "spans", "items")


def contamination(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """id, n_words, n_hit, n_items, items_sha256 (of the comma-joined ids), contaminated; see mark_contaminated."""
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x["b"] - x["a"])
    return mark_contaminated(docs, benchmark, **options).select(options.get("id_col", "doc_id"), "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", span: int = 10, k: int = 5, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The documents without a hit, with all their own columns; the rules are those of mark_contaminated."""
    blocks, sent = _blocks(benchmark, item_id, item_text, span, k, block_bytes)
    for block, known in enumerate(sent):

        def clean(batches: Iterator[pa.RecordBatch], known=known) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                raw, keep = column_bytes(batch, text_col), np.ones(batch.num_rows, bool)
                for a, b in pieces(raw):
                    keep[[a + doc for doc in match(Words(raw[a:b], ALNUM), known.value)]] = False
                yield batch.filter(pa.array(keep))

        docs = batched(docs).mapInArrow(clean, docs.schema)
        if block + 1 < blocks:
            docs = saved(docs)
    return docs
