import hashlib
from collections import defaultdict

from ledgerloom.llm import exact_dedup

from .corpora import awkward, frame


def brute(rows, largest):
    groups = defaultdict(list)
    for doc, text, *_ in rows:
        groups[text or ""].append(doc)
    out = []
    for text, ids in groups.items():
        known = [i for i in ids if i is not None]
        keep, seen = (max(known) if largest else min(known)) if known else None, set()
        for i in sorted(ids, key=repr):
            out.append((i, keep, len(ids), i == keep and keep not in seen, hashlib.sha256(text.encode()).hexdigest()))
            if i == keep:
                seen.add(keep)
    return sorted(out, key=repr)


def test_equals_brute_force(spark):
    rows = awkward()
    for keep in ("largest", "smallest"):
        got = exact_dedup.exact_duplicates(frame(spark, rows), keep=keep).collect()
        assert sorted(map(tuple, got), key=repr) == brute(rows, keep == "largest")


def test_empty_table_and_native_plan(spark):
    df = exact_dedup.exact_duplicates(frame(spark, []))
    assert df.collect() == []
    plan = df._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


def test_texts_that_share_a_hash_stay_apart(spark, monkeypatch):
    """With a hash of three values nearly all texts collide, so the comparison of texts decides."""
    from pyspark.sql import functions as F

    monkeypatch.setattr(exact_dedup, "digest", lambda text: F.lpad(F.pmod(F.length(text), F.lit(3)).cast("string"), 1, "0").cast("binary"))
    rows = awkward()
    assert sorted(map(tuple, exact_dedup.exact_duplicates(frame(spark, rows), keep="largest").collect()), key=repr) == brute(rows, True)


def test_a_row_repeated_very_often(spark):
    df = spark.range(100_000).selectExpr("7L as doc_id", "'same' as text").union(spark.createDataFrame([(1, "other"), (9, "same")], "doc_id long, text string"))
    got = exact_dedup.exact_duplicates(df, keep="largest").groupBy("doc_id", "keep_id", "group_size", "kept").count().collect()
    assert sorted(map(tuple, got)) == [(1, 1, 1, True, 1), (7, 9, 100_001, False, 100_000), (9, 9, 100_001, True, 1)]


def test_drop(spark):
    repeats = [(1, "a", None, None, None)] * 3 + [(1, "b", None, None, None), (2, "b", None, None, None)]
    assert sorted((r.doc_id, r.text) for r in exact_dedup.drop_exact_duplicates(frame(spark, repeats)).collect()) == [(1, "a"), (1, "b")]
    rows = [(1, "a", None, None, None), (2, "a", None, None, None), (3, None, None, None, None)]
    assert sorted(r.doc_id for r in exact_dedup.drop_exact_duplicates(frame(spark, rows)).collect()) == [1, 3]
