"""Bounded samples of labelled rows, and which rows are held out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import doc_remainder


def held_out(id_col: str, modulus: int, remainder: int) -> Column:
    """True for rows whose crc32 of the id as text has this remainder; they never serve training."""
    return doc_remainder(F.col(id_col), modulus) == remainder


def known_labels(labels: DataFrame, label_col: str, modulus: int, remainder: int, id_col: str = "doc_id") -> DataFrame:
    """(_id, _label) of all rows that may teach, once for each id: not held out, label 0 or 1; an id with both counts as 1."""
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1) & ~held_out(id_col, modulus, remainder))
    return known.groupBy(F.col(id_col).alias("_id")).agg(F.max(label_col).cast("int").alias("_label"))


#: Rows of 64 bits of the table by which likely_labelled asks for ids.
SLOTS = 1 << 18


def likely_labelled(docs: DataFrame, known: DataFrame, id_col: str) -> DataFrame:
    """docs less most rows whose id isn't an _id of known, so that their texts aren't shuffled; an exact join must follow. Ids are asked for in a
    table of SLOTS * 64 bits, broadcast because it has SLOTS rows at most, however many ids there are. With far more ids than bits it is
    full, and all rows go on. Ids of unlike or other types than numbers and strings all go on."""
    if docs.schema[id_col].dataType != known.schema["_id"].dataType or docs.schema[id_col].dataType.simpleString() not in ("int", "bigint", "string"):
        return docs
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(SLOTS * 64))
    bit = F.expr("shiftleft(1L, cast(_place & 63 as int))")
    bits = known.select(place("_id").alias("_place")).groupBy(F.shiftright("_place", 6).alias("_slot")).agg(F.bit_or(bit).alias("_bits"))
    asked = docs.withColumn("_place", place(id_col))
    there = (F.shiftright("_place", 6) == F.col("_slot")) & (F.col("_bits").bitwiseAND(bit) != 0)
    return asked.join(F.broadcast(bits), there, "left_semi").drop("_place")


def label_counts(docs: DataFrame, labels: DataFrame, label_col: str, modulus: int, remainder: int, id_col: str = "doc_id") -> tuple[int, int]:
    """How many ids of docs have label 0 and label 1 for training, none left out; see sample_ids."""
    there = known_labels(labels, label_col, modulus, remainder, id_col).join(docs.select(F.col(id_col).alias("_id")), "_id", "left_semi")
    row = there.agg(F.count_if(F.col("_label") == 0), F.count_if(F.col("_label") == 1)).first()
    return row[0], row[1]


def sample_ids(labels: DataFrame, label_col: str, per_label: int, modulus: int, remainder: int, id_col: str = "doc_id") -> DataFrame:
    """(id, label) of at most per_label rows for each of the labels 0 and 1: those whose id hashes least. Rows without id or label and
    held-out rows don't count; an id with both labels counts as 1."""
    known = known_labels(labels, label_col, modulus, remainder, id_col)
    parts = [known.where(F.col("_label") == x).orderBy(F.xxhash64("_id"), "_id").limit(per_label) for x in (0, 1)]
    return parts[0].union(parts[1])


#: Bytes of text of a label that a sample holds at most.
SAMPLE_BYTES = 32 << 20


def bounded(rows: DataFrame, key: str, order: Column, most: int = SAMPLE_BYTES) -> DataFrame:
    """The rows (key, text, ...) of a sample, in order within each key, as long as their texts add up to most bytes; a longer text is passed over
    whole, never cut. For samples of few rows only."""
    window = Window.partitionBy(key).orderBy(order, "text").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    size = F.octet_length("text")
    fits = rows.where(size <= most // 16)
    return fits.withColumn("_held", F.sum(size).over(window)).where(F.col("_held") <= most).drop("_held")


def labelled_texts(docs: DataFrame, labels: DataFrame, label_col: str, per_label: int, modulus: int, remainder: int, columns: list[str], id_col: str = "doc_id") -> DataFrame:
    """(id, label, columns) of the sampled rows; columns starts with text. The sample has at most 2 * per_label ids, so these are broadcast. Rows of one id
    become one on the executors, that of the least text; texts together have at most SAMPLE_BYTES for each label, and one of over a sixteenth of
    that doesn't teach."""
    ids = sample_ids(labels, label_col, per_label, modulus, remainder, id_col)
    kept = F.struct(F.coalesce(F.col(columns[0]), F.lit("")).alias(columns[0]), *(F.col(c) for c in columns[1:]))
    rows = docs.select(F.col(id_col).alias("id"), kept.alias("row")).join(F.broadcast(ids), F.col("id") == F.col("_id"))
    one = rows.groupBy("id", F.col("_label").alias("label")).agg(F.min("row").alias("row")).select("id", "label", "row.*")
    return bounded(one, "label", F.xxhash64("id"))
