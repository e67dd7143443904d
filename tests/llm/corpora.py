"""Small corpora with the awkward cases that every operator must stand."""

import random

from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng, n, vocabulary=300, stem="w"):
    return " ".join(f"{stem}{rng.randrange(vocabulary)}" for _ in range(n))


def awkward(seed=5, n=40):
    """Nulls in every column, empty, blank and very long texts, ties, repeated rows, near and exact copies."""
    rng = random.Random(seed)
    rows = [(i, words(rng, rng.choice((1, 4, 30, 80))), rng.choice(("en", "de", None)), rng.choice(("a", "b", None)), rng.choice((10, None))) for i in range(n)]
    copy = rows[3][1]
    near = words(rng, 60)
    rows += [(100 + i, copy, "en", "a", 5) for i in range(5)]
    rows += [(200 + i, near + f" tail{i}", "en", "b", 5) for i in range(4)]
    rows += [(300, None, None, None, None), (301, "", "en", "a", 0), (302, " \t\n ", "de", "b", 3), (None, "only text here is one two three four five", "en", "a", 1), (None, None, "en", None, None)]
    rows += [(303, words(rng, 60_000), "en", "a", 1), (304, "x" * 300_000, "de", "b", 1), (305, "été ÉTÉ naïve — “quoted” 日本語 😀", "fr", "a", 9)]
    rows += [rows[0], rows[0], rows[1]]
    return rows


def frame(spark, rows=None, clash=True):
    df = spark.createDataFrame(awkward() if rows is None else rows, SCHEMA).repartition(3)
    if clash:
        for c in ("id", "node", "n", "size", "token", "shard", "target", "keep_id", "score", "label", "held_out", "_id", "_text", "spans", "items", "c", "hi", "_s", "_i", "_copies", "_copy", "_text_hash", "h", "row", "i", "slot", "law", "text_crc32", "grown_shard", "id_", "md5", "sha", "copies", "_part", "_crc", "_size", "_with", "none"):
            df = df.withColumn(c, F.lit("clash"))
    return df
