import hashlib
import random
import re

from ledgerloom.llm import decontaminate

from .corpora import awkward, frame, words

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def tokens(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items):
    windows = []
    for item, text in items:
        w = tokens(text)
        if w:
            m = min(10, len(w))
            windows += [(item, tuple(w[i : i + m])) for i in range(len(w) - m + 1)]
    out, of = [], {}
    for item, g in windows:
        of.setdefault(g, []).append(item)
    for doc, text in docs:
        w = tokens(text)
        hit, found = set(), set()
        for m in {len(g) for _, g in windows}:
            for i in range(len(w) - m + 1):
                for item in of.get(tuple(w[i : i + m]), ()):
                    hit.update(range(i, i + m))
                    found.add("null" if item is None else str(item))
        out.append((doc, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


def case(seed=4):
    rng = random.Random(seed)
    items = [(i, words(rng, rng.choice((3, 9, 10, 11, 40)), 60)) for i in range(25)] + [(90, None), (91, ""), (None, words(rng, 12))]
    items += [(95 + i, items[4][1]) for i in range(3)] + [items[6]]
    docs = [r[:2] for r in awkward()]
    for i in range(40):
        w = tokens(rng.choice(items)[1])
        a = rng.randrange(max(1, len(w)))
        docs.append((500 + i, f"{words(rng, 20, 60)} {' '.join(w[a : a + rng.choice((6, 9, 10, 14, 40))])}, {words(rng, 15, 60)}".upper()))
    return docs, items


def run(spark, docs, items, **options):
    a = frame(spark, [(d, t, None, None, None) for d, t in docs])
    b = spark.createDataFrame(items, "item_id long, text string")
    return sorted(map(tuple, decontaminate.contamination(a, b, **options).collect()), key=repr)


def test_equals_brute_force(spark):
    docs, items = case()
    assert run(spark, docs, items) == brute(docs, items)


def test_a_large_benchmark_goes_block_by_block(spark):
    docs, items = case(9)
    assert run(spark, docs, items, block_bytes=1000) == brute(docs, items)


def test_another_id_column(spark):
    docs, items = case()
    a = frame(spark, [(d, t, None, None, None) for d, t in docs], clash=False).withColumnRenamed("doc_id", "key")
    got = decontaminate.contamination(a, spark.createDataFrame(items, "item_id long, text string"), id_col="key")
    assert got.columns[0] == "key" and got.where("contaminated").count() == sum(r[5] for r in brute(docs, items))


def test_empty_tables(spark):
    docs, items = case()
    assert run(spark, [], items) == []
    assert run(spark, docs, []) == brute(docs, [])


def test_clean_documents_stay_with_their_columns(spark):
    docs, items = case()
    a = frame(spark, [(d, t, None, None, None) for d, t in docs])
    kept = decontaminate.decontaminate(a, spark.createDataFrame(items, "item_id long, text string"), block_bytes=1500)
    assert kept.columns == a.columns
    assert sorted((r.doc_id, r.text) for r in kept.collect() if r.doc_id is not None) == sorted((d, t) for (d, t), x in zip(sorted(docs, key=repr), sorted(docs, key=repr)) if d is not None and not brute([(d, t)], items)[0][5])
