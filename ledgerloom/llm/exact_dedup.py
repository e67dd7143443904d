"""Exact deduplication in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import join_groups, saved

#: Bits of the table that keeps texts without a copy from the shuffle: MARKS_EACH for each group, MARKS (16 MB) at most.
MARKS, MARKS_EACH = 1 << 27, 16
_BUCKET = 32768  # bits of one of Spark's bitmaps


def digest(text: Column) -> Column:
    """The 128-bit content hash."""
    return F.unhex(F.md5(text))


def _best(keep: str, order: Column) -> Column:
    pick = {"smallest": F.min, "largest": F.max}[keep]
    return F.coalesce(pick(F.when(order["id"].isNotNull(), order)), pick(order))


def _marked(rows: DataFrame, groups: DataFrame, bits: int) -> DataFrame:
    """The rows (md5, text) whose MD5 may be among groups: the bits set by groups are broadcast, in a table of fixed size, and looked up."""
    cell = F.pmod(F.xxhash64("md5"), F.lit(bits)) + 1  # Spark's bitmaps count from 1
    table = groups.select(cell.alias("c")).groupBy(F.bitmap_bucket_number("c").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("c")).alias("bits"))
    placed = rows.withColumn("bucket", F.bitmap_bucket_number(cell)).withColumn("at", F.bitmap_bit_position(cell).cast("int"))
    byte = F.conv(F.hex(F.substring(F.col("bits"), F.floor(F.col("at") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    set_ = F.call_function("shiftright", byte, F.col("at") % 8).bitwiseAND(F.lit(1)) == 1
    return placed.join(F.broadcast(table), "bucket").where(set_).select("md5", "text")


def _members(docs: DataFrame, id_col: str, text_col: str, keep: str) -> DataFrame:
    """id, md5, sha, keep_id, group_size and kept of each row; see exact_duplicates."""
    texts = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.col(id_col).alias("id"))
    texts = texts.withColumn("md5", digest(F.col("text")))
    rows = saved(texts.select("id", "md5", F.unhex(F.sha2("text", 256)).alias("sha")).withColumn("row", F.monotonically_increasing_id()))
    total = rows.count()
    by_hash = saved(rows.groupBy("md5").agg(F.count("*").alias("group_size"), _best(keep, F.struct("id", "row")).alias("best")))
    several = by_hash.where("group_size > 1").select("md5")
    bits = _BUCKET * max(1, min(MARKS, MARKS_EACH * several.count()) // _BUCKET)
    # bytes inside the groups: the hash table of this aggregation compares whole texts, a copy is dropped before the shuffle
    distinct = _marked(texts.select("md5", "text"), several, bits).groupBy("md5", "text").agg(F.lit(1).alias("one"))
    collided = saved(distinct.groupBy("md5").agg(F.count("*").alias("texts")).where("texts > 1").select("md5"))
    if not collided.take(1):
        found = join_groups(rows, by_hash, ["md5"], "group_size", total)
    else:
        alone = join_groups(rows.join(collided, "md5", "left_anti"), by_hash, ["md5"], "group_size", total)
        # rows that share an MD5 with another text: grouped by the text itself
        whole = saved(texts.join(collided, "md5", "left_semi").withColumn("sha", F.unhex(F.sha2("text", 256))).withColumn("row", F.monotonically_increasing_id()))
        by_text = whole.groupBy("md5", "text").agg(F.count("*").alias("group_size"), _best(keep, F.struct("id", "row")).alias("best"))
        found = alone.unionByName(join_groups(whole, by_text, ["md5", "text"], "group_size", total).drop("text"))
    return found.select("id", "md5", "sha", F.col("best.id").alias("keep_id"), "group_size", (F.col("row") == F.col("best.row")).alias("kept"))


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest") -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    Rows are grouped by the 128-bit MD5 of the text; only ids and hashes are shuffled for that. In groups of more than one row the texts
    themselves are then compared byte by byte, as keys of an aggregation that drops copies before its shuffle; a table of bits, at most 16 MB,
    keeps other texts away. Rows of an MD5 that several texts share, if there ever are any, are grouped by their texts instead. A group
    with a third of all rows is aggregated before the shuffle and joined by broadcast.

    keep names the row that stays: "smallest" or "largest" id. Null texts count as empty. Null ids never win against others; a
    group of null ids only has a null keep_id. In each group exactly one row has kept = true, also where rows are repeated. Texts of any length are
    hashed and compared whole. Other columns are ignored, whatever their names. An empty table gives an empty result.
    """
    rows = _members(docs, id_col, text_col, keep)
    return rows.select(F.col("id").alias(id_col), "keep_id", "group_size", "kept", F.lower(F.hex("sha")).alias("text_sha256"))


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest") -> DataFrame:
    """One row of docs for each distinct text, with all its columns: the row that exact_duplicates keeps. Of rows with the same id and text any one
    stays; which of their other columns' values that brings isn't defined."""
    kept = _members(docs, id_col, text_col, keep).where("kept").select("id", "sha")
    whole = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    rows = docs.select(F.col(id_col).alias("id"), F.unhex(F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256)).alias("sha"), whole.alias("row"))
    same = rows["id"].eqNullSafe(kept["id"]) & (rows["sha"] == kept["sha"])
    return rows.join(kept, same, "left_semi").dropDuplicates(["id", "sha"]).select("row.*")
