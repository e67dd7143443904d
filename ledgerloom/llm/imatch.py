"""Document fingerprints by I-Match with randomised lexicons.

1. The lexicon: for each of CELLS hashed terms, in how many documents it occurs, counted over all of them. Terms outside a band of inverse document
   frequency are dropped: very common ones tell nothing, very rare ones are mostly noise. It travels as one bit a cell.
2. A text's distinct terms in the band are sorted and hashed once for each of several random subsets of the lexicon. A family of subsets is nested:
   each holds half of the one before, so some subset fits a text of any length.
3. Two texts agree in a subset exactly if it holds none of the terms in which they differ. Of all their terms a share d, of n families, the number
   of non-empty subsets that agree is on average n * log2(1 / d); the likeness is what follows from it for the terms that they share.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import batched, shuffle_parts
from .textcore import ALNUM, Words, column_bytes, mix, pieces

CELL_BITS = 20
CELLS = 1 << CELL_BITS
#: ln(documents / documents with the term): terms in over 8 % of the documents, and in fewer than one of 1.2 million, are dropped.
IDF_BAND = (2.5, 14.0)
FAMILIES, LEVELS = 16, 12
SLOTS = FAMILIES * LEVELS
EMPTY = "...."
PART_BYTES = 16 << 20

_SEEDS = mix(np.arange(1, FAMILIES + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
_HEX = np.array([f"{i:04x}" for i in range(1 << 16)] + [EMPTY], dtype="S4")
_NONE = 1 << 16


def _terms(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(text, term): the distinct terms of each text in ascending order, as 64-bit hashes."""
    w = Words(raw, ALNUM)
    doc = w.doc_of()
    order = np.lexsort((w.hash, doc))
    doc, term = doc[order], w.hash[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (term[1:] != term[:-1])
    return doc[new], term[new]


def _cells(term: np.ndarray) -> np.ndarray:
    return (term >> np.uint64(64 - CELL_BITS)).astype(np.int64)


def document_frequencies(docs: DataFrame, text_col: str = "text") -> tuple[int, np.ndarray]:
    """The number of documents and, of each cell of hashed terms, the documents with a term there, over all rows. Each task adds up its own before
    anything is shuffled; the driver gets a table of CELLS rows at most, whatever the size of docs."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, rows = np.zeros(CELLS, np.int64), 0
        for batch in batches:
            raw = column_bytes(batch, "text")
            rows += len(raw)
            for a, b in pieces(raw):
                doc, term = _terms(raw[a:b])
                cell = _cells(term)  # sorted within a text, as its terms are
                once = np.ones(len(cell), bool)
                once[1:] = (doc[1:] != doc[:-1]) | (cell[1:] != cell[:-1])
                counts += np.bincount(cell[once], minlength=CELLS)
        found = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(found, -1)), pa.array(np.append(counts[found], rows))], ["cell", "n"])

    found = batched(docs.select(F.col(text_col).alias("text"))).mapInArrow(add, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    cell, n = found.column("cell").to_numpy(), found.column("n").to_numpy()
    counts = np.zeros(CELLS, np.int64)
    counts[cell[cell >= 0]] = n[cell >= 0]
    return int(n[cell < 0].sum()), counts


def lexicon(docs: DataFrame, text_col: str = "text", band: tuple[float, float] = IDF_BAND) -> bytes:
    """One bit for each cell of hashed terms: whether its inverse document frequency lies in the band."""
    total, counts = document_frequencies(docs, text_col)
    idf = np.log(max(total, 1) / np.maximum(counts, 1))
    return np.packbits((counts > 0) & (idf >= band[0]) & (idf <= band[1])).tobytes()


def _slots(raw: list[bytes], known: np.ndarray) -> np.ndarray:
    """For each text and subset a hash of 16 bits of its terms there, _NONE without any."""
    out = np.full((len(raw), SLOTS), _NONE, np.int32)
    for a, b in pieces(raw):
        part, n = raw[a:b], b - a
        doc, term = _terms(part)
        inside = known[_cells(term)]
        some = np.bincount(doc[inside], minlength=n) > 0
        use = inside | ~some[doc]
        doc, term = doc[use], term[use]
        odd = [i for i in np.flatnonzero(np.bincount(doc, minlength=n) == 0).tolist() if part[i]]
        if odd:  # texts without a word stand for themselves
            doc = np.concatenate([doc, np.array(odd)])
            term = np.concatenate([term, np.array([int.from_bytes(hashlib.sha256(part[i]).digest()[:8], "little") for i in odd], np.uint64)])
        if not len(doc):
            continue
        for f, seed in enumerate(_SEEDS):
            x = mix(term ^ seed)
            level = np.minimum(64 - np.frexp(x.astype(np.float64))[1], LEVELS - 1).clip(0)
            weight = ((mix(x) >> np.uint64(40)) + np.uint64(1)).astype(np.float64)
            sums = np.bincount(doc * LEVELS + level, weight, n * LEVELS).reshape(n, LEVELS)
            sums = sums[:, ::-1].cumsum(axis=1)[:, ::-1].astype(np.uint64)  # a subset holds all finer ones
            out[a:b, f * LEVELS : (f + 1) * LEVELS] = np.where(sums > 0, (mix(sums) >> np.uint64(48)).astype(np.int32), _NONE)
    return out


def _written(slots: np.ndarray) -> pa.Array:
    return pa.array(_HEX[slots].reshape(-1).view(f"S{4 * SLOTS}").astype(str).tolist() if len(slots) else [], pa.string())


def _near(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The likeness of the texts of each two rows of slots."""
    agree = ((a == b) & (a != _NONE)).sum(axis=1)
    return np.where((a == b).all(axis=1), 1.0, 1 - 0.5 ** (agree / FAMILIES))


def likeness(a: Column, b: Column) -> Column:
    """The likeness of two fingerprints, 0 to 1: 1 where they are equal, else the estimated share of all terms of the two texts that both have."""
    places = F.sequence(F.lit(0), F.lit(SLOTS - 1))
    one = lambda c, i: F.substr(c, i * 4 + 1, F.lit(4))
    agree = F.size(F.filter(places, lambda i: (one(a, i) == one(b, i)) & (one(a, i) != EMPTY)))
    return F.when(a == b, F.lit(1.0)).otherwise(1 - F.pow(F.lit(0.5), agree / FAMILIES))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", known: bytes | None = None) -> DataFrame:
    """Per row: its id and fingerprint. known: a lexicon; without one that of docs. Rules as in edited_fingerprints."""
    bits = known if known is not None else lexicon(docs, text_col)
    kind = dict(docs.dtypes)[id_col]

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mask = np.unpackbits(np.frombuffer(bits, np.uint8)).astype(bool)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), _written(_slots(column_bytes(batch, "text"), mask))], ["id", "fingerprint"])

    return batched(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))).mapInArrow(apply, f"id {kind}, fingerprint string").withColumnRenamed("id", id_col)


class Ranges:
    """Consecutive parts of about the same number of rows in ascending order of an integer id. An id that fills several parts has them for itself;
    its rows, and those without an id, are dealt to theirs by a salt."""

    def __init__(self, bounds: Sequence[int], for_nulls: int):
        self.ids = sorted(set(bounds))
        self.many = [sum(1 for b in bounds if b == i) for i in self.ids]
        self.first, at = [], 1
        for m in self.many:
            self.first.append(at)
            at += m + (m > 1)
        self.nulls, self.count = at, at + for_nulls

    def part(self, doc_id: Column, salt: Column) -> Column:
        """The part of a row, from 0 to count - 1."""
        nulls = self.nulls + F.pmod(salt, F.lit(max(1, self.count - self.nulls)))
        if not self.ids:
            return F.when(doc_id.isNull(), nulls).otherwise(F.lit(0).cast("long")).cast("int")
        step = max(1, int(len(self.ids) ** 0.5))
        longs = lambda xs: f"array({', '.join(f'{x}L' if x >= 0 else f'(-{-x}L)' for x in xs)})"
        blocks = [self.ids[i : i + step] for i in range(0, len(self.ids), step)]
        block = F.size(F.filter(F.expr(longs([b[0] for b in blocks])), lambda b: b <= doc_id))
        inside = F.size(F.filter(F.element_at(F.expr(f"array({', '.join(map(longs, blocks))})"), F.greatest(block, F.lit(1))), lambda b: b <= doc_id))
        at = (F.greatest(block, F.lit(1)) - 1) * step + inside  # ids of bounds up to doc_id
        of = lambda xs: F.element_at(F.expr(longs(xs)), F.greatest(at, F.lit(1)))
        shared = F.when(of(self.ids) == doc_id, F.pmod(salt, of(self.many))).otherwise(of([m if m > 1 else 0 for m in self.many]))
        return F.when(doc_id.isNull(), nulls).when(at == 0, F.lit(0).cast("long")).otherwise(of(self.first) + shared).cast("int")


def with_next(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """_id, _text, _copy, one part of the ids in each partition, in descending order: first a copy (_copy = 1) of the document after the part's last
    one, then the part's rows. So the row before a row of another id is the document after it. Texts are shuffled once, and one more for each part.

    The document after an id is that of the next greater id, after the greatest the least; ids that are null come before all. Of several rows of that
    id it is the one whose text has the least hash."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), text.alias("_text")).withColumn("_hash", F.xxhash64("_text"))
    total = rows.agg(F.count("*").alias("n"), F.count("_id").alias("known"), F.coalesce(F.sum(F.octet_length("_text")), F.lit(0)).alias("size")).first()
    parts = max(1, shuffle_parts(docs.sparkSession), -(-total.size // PART_BYTES))
    for_nulls = -(-(total.n - total.known) * parts // max(1, total.n))
    shares = [i / parts for i in range(1, parts)]
    bounds = rows.agg(F.percentile_approx("_id", shares, max(10_000, 10 * parts)).alias("b")).first().b if shares and total.known else None
    ranges = Ranges(bounds or [], for_nulls)
    dealt = rows.withColumn("_part", ranges.part(F.col("_id"), F.xxhash64("_hash", F.monotonically_increasing_id())))
    held = dealt.groupBy("_part").agg(F.min("_id").alias("low"), F.max("_id").alias("high")).collect()
    lows = sorted(p.low for p in held if p.low is not None)
    around = None if any(p.low is None for p in held) else lows[0] if lows else None
    after = [(p._part, (lows[0] if lows else None) if p.high is None else next((x for x in lows if x > p.high), around)) for p in held]
    spark = docs.sparkSession
    wanted = F.broadcast(spark.createDataFrame(after, "_part int, _after long"))
    needed = F.broadcast(spark.createDataFrame([(x,) for x in {x for _, x in after}], "_after long"))
    one = rows.join(needed, F.col("_id").eqNullSafe(F.col("_after")), "left_semi").groupBy("_id").agg(F.min(F.struct("_hash", "_text")).alias("_least"))
    copies = one.join(wanted, F.col("_id").eqNullSafe(F.col("_after"))).select("_part", F.lit(1).alias("_copy"), "_id", "_least._hash", "_least._text")
    both = dealt.select("_part", F.lit(0).alias("_copy"), "_id", "_hash", "_text").union(copies).repartitionById(ranges.count, F.col("_part"))
    return both.sortWithinPartitions("_part", F.desc("_copy"), F.desc_nulls_last("_id"), F.desc("_hash"), F.desc("_text")).select("_id", "_copy", "_text")


def edited_fingerprints(docs: DataFrame, share: int = 4, id_col: str = "doc_id", text_col: str = "text", known: bytes | None = None) -> DataFrame:
    """Per row: its id, n_chars (code points), edited_sha256 (of the edited text), fingerprint and edited_fingerprint (of the text and the edited text),
    near_edited and near_next (the likeness of its fingerprint to that of the edited text and of the next document). Edited: the last n_chars / share
    code points, rounded down, are replaced by the first as many (or all) of the next document, see with_next. known: a lexicon; without one that of docs.

    Terms are runs of ASCII letters and digits and other characters beyond ASCII, lower-cased in A-Z. A text without a term in the band is fingerprinted by all its
    terms, one without terms by itself, the empty text by nothing; null counts as empty. Equal texts have equal fingerprints and likeness 1. The
    only document's next one is itself. Rows of one id all have the same next document; repeated rows each get a row. Very long texts are
    read whole; memory follows the longest text. Other columns are ignored, whatever their names. An empty table gives no rows. Ids are integers.
    """
    bits = known if known is not None else lexicon(docs, text_col)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mask = np.unpackbits(np.frombuffer(bits, np.uint8)).astype(bool)
        before: tuple = (None, None, None, None)  # is it a copy, id, text, slots of the row before
        after: tuple = ("", None)  # text and slots of the next document
        for batch in batches:
            ids, copies, texts = (batch.column(i).to_pylist() for i in range(3))
            raw = column_bytes(batch, "_text")
            for a, b in pieces(raw):
                own = _slots(raw[a:b], mask)
                edited, next_slots = [], []
                for i in range(a, b):
                    if before[0] or before[1] != ids[i]:
                        after = before[2:]
                    before = (copies[i], ids[i], texts[i], own[i - a])
                    if not copies[i]:
                        cut = len(texts[i]) // share
                        edited.append(texts[i][: len(texts[i]) - cut] + after[0][:cut])
                        next_slots.append(after[1])
                if not edited:
                    continue
                kept = [i for i in range(a, b) if not copies[i]]
                own = own[[i - a for i in kept]]
                blobs = [t.encode() for t in edited]
                changed = _slots(blobs, mask)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([ids[i] for i in kept], pa.int64()),
                        pa.array([len(texts[i]) for i in kept], pa.int64()),
                        pa.array([hashlib.sha256(t).hexdigest() for t in blobs], pa.string()),
                        _written(own),
                        _written(changed),
                        pa.array(_near(own, changed)),
                        pa.array(_near(own, np.stack(next_slots))),
                    ],
                    ["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
                )

    schema = "id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return batched(with_next(docs, id_col, text_col)).mapInArrow(apply, schema).withColumnRenamed("id", id_col)
