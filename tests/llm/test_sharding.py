import zlib

import pytest

from ledgerloom.llm import sharding

from .corpora import awkward, frame


@pytest.mark.parametrize("bucket_bytes", [16 << 20, 200])
def test_awkward_rows(spark, bucket_bytes):
    rows = awkward()
    got = sharding.shard_rows(frame(spark, rows), bucket_bytes=bucket_bytes).collect()
    want = sorted((r[0], len((r[1] or "").encode()) + 8, zlib.crc32((r[1] or "").encode())) for r in rows if r[0] is not None)
    assert sorted((r.doc_id, r["size"], r.text_crc32) for r in got if r.doc_id is not None) == want and len(got) == len(rows)
    shards = {}
    for r in got:
        shards.setdefault(r["shard"], []).append(r.slot)
        assert r.grown_shard in (r["shard"], 24) and 0 <= r["shard"] < 24 and r.law == "key"
    assert all(sorted(s) == list(range(len(s))) for s in shards.values())
    assert len({(r.doc_id, r["shard"]) for r in got}) == len({r.doc_id for r in got})
    again = sharding.shard_rows(frame(spark, rows).repartition(7), bucket_bytes=bucket_bytes).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, again))


def test_order_is_shuffled_and_shards_are_even(spark):
    rows = [(i, f"text {i}", "en", "a", 1) for i in range(6000)]
    got = sharding.shard_rows(frame(spark, rows), shards=8).toPandas()
    assert got.groupby("shard").size().between(650, 850).all()
    one = got[got["shard"] == 0].sort_values("slot").doc_id.tolist()
    assert one != sorted(one) and sum(a < b for a, b in zip(one, one[1:])) < 0.6 * len(one)


def brute_shard(doc, shards, seed):
    """Rendezvous hashing told anew: the shard whose hash with the id is largest; ties go to the larger shard."""
    return max((h, i) for i, h in enumerate(doc[:shards]))[1]


def test_shards_equal_brute_force_and_grow_into_the_new_one_only(spark):
    from pyspark.sql import functions as F

    df = spark.range(500).selectExpr("id as doc_id", "concat('t', id) as text")
    hashes = {r.doc_id: r.h for r in df.select("doc_id", F.array(*(F.xxhash64(F.lit(17), F.lit(i), F.col("doc_id").cast("string")) for i in range(25))).alias("h")).collect()}
    for r in sharding.shard_rows(df).collect():
        assert r["shard"] == brute_shard(hashes[r.doc_id], 24, 17) and r.grown_shard == brute_shard(hashes[r.doc_id], 25, 17)


def test_a_row_repeated_very_often(spark):
    df = spark.range(100_000).selectExpr("7L as doc_id", "'same' as text").union(spark.range(50).selectExpr("id + 100 as doc_id", "concat('t', id) as text"))
    runs = [sharding.shard_rows(d, bucket_bytes=1 << 15) for d in (df, df.repartition(5))]
    a, b = (sorted(map(tuple, r.collect())) for r in runs)
    assert a == b and len(a) == 100_050 and len({x[4] for x in a if x[0] == 7}) == 1
    own = next(x[4] for x in a if x[0] == 7)
    slots = sorted(x[5] for x in a if x[4] == own)
    assert slots == list(range(len(slots)))


def test_columns_of_the_same_names_are_kept(spark, tmp_path):
    df = frame(spark, awkward()[:30])
    out = sharding.shard_rows(df, payload=[c for c in df.columns if c != "doc_id"])
    assert {"doc_size", "doc_law", "doc_shard", "doc_slot", "doc_text_crc32", "doc_grown_shard"} < set(out.columns) and len(set(out.columns)) == len(out.columns)
    assert {r.doc_shard for r in out.collect()} == {"clash"}
    sharding.write_shards(df, str(tmp_path / "t"), shards=3)
    back = spark.read.parquet(str(tmp_path / "t"))
    assert {"size", "law", "doc_shard", "doc_slot", "text_crc32", "grown_shard"} < set(back.columns) and back.where("size = 'clash' and doc_shard = 'clash'").count() == 30


def test_payload_written_shards_native_plan_and_empty(spark, tmp_path):
    df = frame(spark)
    out = sharding.shard_rows(df, payload=["text", "lang"])
    assert sorted((r.doc_id, r.text) for r in out.collect() if r.doc_id is not None and r.text) == sorted((r[0], r[1]) for r in awkward() if r[0] is not None and r[1])
    assert not any(x in out._jdf.queryExecution().toString() for x in ("Python", "Pandas", "Arrow"))
    sharding.write_shards(df, str(tmp_path / "s"), shards=3)
    assert spark.read.parquet(str(tmp_path / "s")).count() == df.count()
    assert sharding.shard_rows(frame(spark, [])).collect() == []
