"""The corpus pipeline against its stages told anew in plain Python, on the awkward corpus."""

import zlib

import corpus_pipeline
from ledgerloom.llm import quality

from .corpora import awkward, frame, words
from .test_decontaminate import brute as leaks
from .test_mixing import sizes_of, targets
from .test_models import LABELS
from .test_ngram_join import brute as near


def tables(spark, tmp_path, docs):
    import random

    rng = random.Random(8)
    items = [(i, words(rng, 14, 60)) for i in range(5)]
    leaky = [(700 + i, f"{words(rng, 20, 60)} {items[i][1]} {words(rng, 9, 60)}", "en", "a", 5) for i in range(3)]
    frame(spark, [*docs, *leaky]).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([(i, i % 2, 0) for i in range(30)], LABELS).write.parquet(str(tmp_path / "labels.parquet"))
    return items


def test_stages_equal_brute_force(spark, tmp_path):
    items = tables(spark, tmp_path, awkward())
    where = str(tmp_path)
    docs = spark.read.parquet(f"{where}/documents.parquet")
    plain = lambda df: [(r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in df.collect()]
    before, columns = plain(docs), docs.columns
    for number, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, where)
        out.write.parquet(f"{where}/{number}")
        out = spark.read.parquet(f"{where}/{number}")
        got = out.collect()
        if number == 0:  # the score of each text is the query's, so the threshold decides
            good = {(r.doc_id, r.n) for r in quality.quality_scores(docs, spark.read.parquet(f"{where}/labels.parquet")).where("score >= 0.3").groupBy("doc_id").count().withColumnRenamed("count", "n").collect()}
            kept = {}
            for r in got:
                kept[r.doc_id] = kept.get(r.doc_id, 0) + 1
            assert set(kept.items()) == good
        elif number == 1:
            found = near([(r[0], r[1]) for r in before])
            groups = {c for (_, n, c) in found if n}
            blank = sum(1 for (_, n, _) in found if not n)
            assert len(got) == len(groups) + blank
            assert {r.doc_id for r in got if r.doc_id is not None and (r.text or "").strip()} == {c for c in groups if c is not None}
        elif number == 2:
            clean = sorted(repr(d[0]) for d in leaks([(r[0], r[1]) for r in before], items) if not d[5])
            assert sorted(repr(r.doc_id) for r in got) == clean and len(clean) < len(before)
        elif number == 3:
            want, taken = targets(sizes_of(before)), sizes_of(plain(out))
            assert all(abs(taken.get(k, 0) - t) <= max(r[0] for r in [(len((x[1] or "").split()),) for x in before if x[3] == k]) for k, t in want.items())
        if number < 4:
            assert out.columns == columns
            docs, before = out, plain(out)
    assert sorted((r.doc_id, r.doc_size) for r in got if r.doc_id is not None) == sorted((b[0], "clash") for b in before if b[0] is not None)
    assert all(r.text_crc32 == zlib.crc32((r.text or "").encode()) and r["size"] == len((r.text or "").encode()) + 8 for r in got)
    slots = {}
    for r in got:
        slots.setdefault(r["shard"], []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_run_on_whole_and_empty_tables(spark, tmp_path):
    tables(spark, tmp_path, awkward())
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0
    frame(spark, []).write.mode("overwrite").parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
