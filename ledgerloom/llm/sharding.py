"""Sharding by a two-pass external shuffle, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import saved

BUCKET_BYTES = 16 << 20
CHUNK = 4096  # equal rows that share a bucket at most


def shard_of(id_col: Column, shards: int, seed: int) -> Column:
    """The shard of the largest of one hash for each shard (rendezvous hashing). It depends on id and shard count only; with one more
    shard, a row stays or goes to the new shard. A null id hashes like an absent value."""
    weighed = [F.struct(F.xxhash64(F.lit(seed), F.lit(i), id_col.cast("string")).alias("h"), F.lit(i).alias("shard")) for i in range(shards)]
    return (F.greatest(*weighed) if shards > 1 else weighed[0])["shard"]


def _free_names(columns: list[str], taken: set[str]) -> list[str]:
    """Names for columns beside those taken: a name that is taken gets doc_ before it, as often as needed."""
    out = []
    for c in columns:
        while c in taken:
            c = f"doc_{c}"
        taken = taken | {c}
        out.append(c)
    return out


def _apart(rows: DataFrame) -> DataFrame:
    """rows with _part: 0, but for rows that are equal in id, checksum and size more than CHUNK times the run of CHUNK among them that a row is in.
    Those are numbered by ranges of a sort, in which equal rows may lie in several ranges, so no task sees all of them."""
    key = ["_id", "_crc", "_size"]
    often = saved(rows.groupBy(*key).agg(F.count("*").alias("_times")).where(F.col("_times") > CHUNK).select(*(F.col(k).alias(f"{k}_") for k in key)))
    if not often.take(1):
        return rows.withColumn("_part", F.lit(0).cast("long"))
    same = rows["_id"].eqNullSafe(often["_id_"]) & (rows["_crc"] == often["_crc_"]) & (rows["_size"] == often["_size_"])
    few = rows.join(often, same, "left_anti").withColumn("_part", F.lit(0).cast("long"))
    many = saved(rows.join(often, same, "left_semi").withColumn("_u", F.monotonically_increasing_id()))
    ranged = saved(many.repartitionByRange(*key, "_u").sortWithinPartitions(*key, "_u").withColumn("_m", F.monotonically_increasing_id())).withColumn("_p", F.shiftright("_m", 33))
    sizes = ranged.groupBy("_p").agg(F.count("*").alias("_n"))
    before = sizes.select("_p", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_b"))
    placed = ranged.join(F.broadcast(before), "_p").withColumn("_at", F.col("_b") + F.col("_m").bitwiseAND(F.lit((1 << 33) - 1)))
    first = placed.groupBy(*(F.col(k).alias(f"{k}_") for k in key)).agg(F.min("_at").alias("_first"))
    own = placed["_id"].eqNullSafe(first["_id_"]) & (placed["_crc"] == first["_crc_"]) & (placed["_size"] == first["_size_"])
    numbered = placed.join(F.broadcast(first), own).withColumn("_part", F.floor((F.col("_at") - F.col("_first")) / CHUNK).cast("long"))
    return few.unionByName(numbered.select(*few.columns))


def _shuffled(docs: DataFrame, shards: int, seed: int, payload: list[str], id_col: str, text_col: str, bucket_bytes: int) -> DataFrame:
    """_id, _size, _crc, _shard, _slot, _grown and _with (a struct p0, p1, ... of the payload) of each row; see shard_rows."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("_id"),
        (F.octet_length(text) + 8).cast("long").alias("_size"),
        F.crc32(text.cast("binary")).alias("_crc"),
        F.struct(*(F.col(f"`{c}`").alias(f"p{i}") for i, c in enumerate(payload))).alias("_with") if payload else F.lit(None).cast("int").alias("_with"),
    )
    held = F.sum("_size") if payload else F.count("*") * 64
    total = rows.agg(held.alias("n")).first()["n"] or 0
    buckets = max(1, -(-total // (shards * bucket_bytes)))
    bucket = F.pmod(F.xxhash64(F.lit(seed + 1), F.col("_id").cast("string"), "_crc", "_part"), F.lit(buckets))
    rows = _apart(rows).select("*", shard_of(F.col("_id"), shards, seed).alias("_shard"), shard_of(F.col("_id"), shards + 1, seed).alias("_grown"), bucket.alias("_bucket"))
    before = Window.partitionBy("_shard").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy("_shard", "_bucket").agg(F.count("*").alias("_n"))
    first = counts.select("_shard", "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    scattered = rows.repartition(shards * buckets, "_shard", "_bucket").sortWithinPartitions("_shard", "_bucket", "_id", "_crc", "_size")
    held_rows = scattered.groupBy("_shard", "_bucket").agg(F.collect_list(F.struct("_id", "_size", "_crc", "_grown", "_with")).alias("_rows")).sortWithinPartitions("_shard", "_bucket")
    shuffled = held_rows.select("_shard", "_bucket", F.posexplode(F.shuffle("_rows", F.lit(seed))).alias("_at", "_r"))
    return shuffled.join(first, ["_shard", "_bucket"]).select("_r.*", "_shard", (F.col("_first") + F.col("_at")).alias("_slot"))


def shard_rows(docs: DataFrame, shards: int = 24, seed: int = 17, payload: list[str] | None = None, id_col: str = "doc_id", text_col: str = "text", bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """Each row's id, size (UTF-8 bytes of the text, 0 for null, plus 8), text_crc32, law, shard, slot (its place in the shard, from 0
    without gaps) and grown_shard (its shard with one shard more), then the columns named in payload; one that has the name of a column
    before it gets doc_ in front of its name.

    Pass 1 scatters rows by seeded hash to shards (law: key) and within them to buckets that fit in memory: as many as keep a bucket's mean
    at bucket_bytes of what the result carries. Pass 2 shuffles each bucket (Spark's shuffle(array, seed) is a Fisher-Yates shuffle)
    from a fixed starting order; buckets follow each other in the shard. The number of partitions follows from the data, so
    reruns agree. Rows of one id share a shard; their texts, and each CHUNK of equal rows, are scattered over its buckets. Rows with a null id
    are treated as rows of one id. Repeated rows each get a slot. A very long text is a row like any other; it is never cut, so its bucket
    is larger by it. Columns that aren't named are ignored. An empty table gives no rows.
    """
    payload = payload or []
    names = _free_names(payload, {id_col, "size", "text_crc32", "law", "shard", "slot", "grown_shard"})
    return _shuffled(docs, shards, seed, payload, id_col, text_col, bucket_bytes).select(
        F.col("_id").alias(id_col),
        F.col("_size").alias("size"),
        F.col("_crc").alias("text_crc32"),
        F.lit("key").alias("law"),
        F.col("_shard").alias("shard"),
        F.col("_slot").alias("slot"),
        F.col("_grown").alias("grown_shard"),
        *(F.col(f"_with.p{i}").alias(n) for i, n in enumerate(names)),
    )


def write_shards(docs: DataFrame, path: str, shards: int = 24, seed: int = 17, id_col: str = "doc_id", text_col: str = "text", bucket_bytes: int = BUCKET_BYTES) -> None:
    """Parquet files of the rows of docs below path/shard=N, in slot order within each file: slot, then all columns of docs. Columns of docs named shard or slot
    are written as doc_shard and doc_slot. Rules as in shard_rows. What lies below path is replaced."""
    names = _free_names(docs.columns, {"shard", "slot"})
    rows = _shuffled(docs, shards, seed, docs.columns, id_col, text_col, bucket_bytes)
    out = rows.select(F.col("_shard").alias("shard"), F.col("_slot").alias("slot"), *(F.col(f"_with.p{i}").alias(n) for i, n in enumerate(names)))
    out.sortWithinPartitions("shard", "slot").write.mode("overwrite").partitionBy("shard").parquet(path)
