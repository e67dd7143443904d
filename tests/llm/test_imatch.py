import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import imatch
from ledgerloom.llm.textcore import mix

from .corpora import awkward, frame, words


def brute_terms(text, known):
    """The hashes of the distinct terms that a text is fingerprinted by."""
    _, term = imatch._terms([text.encode()])
    inside = [t for t in term.tolist() if known[t >> (64 - imatch.CELL_BITS)]]
    if inside or len(term):
        return set(inside or term.tolist())
    return {int.from_bytes(hashlib.sha256(text.encode()).digest()[:8], "little")} if text else set()


def brute_slots(terms):
    """A subset of family f and level l holds the terms whose mixed hash begins with l zero bits; hashes of a subset are summed."""
    out = []
    one = lambda x: int(mix(np.array([x], np.uint64))[0])
    for f in range(imatch.FAMILIES):
        seen = [one(t ^ int(imatch._SEEDS[f])) for t in terms]
        for level in range(imatch.LEVELS):
            inside = [x for x in seen if x >> (64 - level) == 0]
            out.append(f"{one(sum((one(x) >> 40) + 1 for x in inside)) >> 48:04x}" if inside else imatch.EMPTY)
    return "".join(out)


def brute_near(a, b):
    if a == b:
        return 1.0
    same = sum(a[i : i + 4] == b[i : i + 4] != imatch.EMPTY for i in range(0, len(a), 4))
    return 1 - 0.5 ** (same / imatch.FAMILIES)


def hash_of(spark, texts):
    return {r.t: r.h for r in spark.createDataFrame([(t,) for t in set(texts)], "t string").select("t", F.xxhash64("t").alias("h")).collect()}


def next_texts(spark, rows):
    """The text of the document after each id."""
    h = hash_of(spark, [t or "" for _, t in rows])
    ids = sorted({i for i, _ in rows if i is not None})
    order = ([None] if any(i is None for i, _ in rows) else []) + ids
    first = {i: min((t or "" for j, t in rows if j == i), key=lambda t: (h[t], t)) for i in order}
    return {i: first[order[(k + 1) % len(order)]] for k, i in enumerate(order)}


def check(spark, rows):
    docs = frame(spark, rows)
    known = np.unpackbits(np.frombuffer(imatch.lexicon(docs), np.uint8)).astype(bool)
    after = next_texts(spark, [(r[0], r[1]) for r in rows])
    prints = {}

    def of(text):
        if text not in prints:
            prints[text] = brute_slots(brute_terms(text, known))
        return prints[text]

    want = []
    for doc, text, *_ in rows:
        text, nxt = text or "", after[doc]
        cut = len(text) // 4
        edited = text[: len(text) - cut] + nxt[:cut]
        want.append((doc, len(text), hashlib.sha256(edited.encode()).hexdigest(), of(text), of(edited), brute_near(of(text), of(edited)), brute_near(of(text), of(nxt))))
    got = [tuple(r) for r in imatch.edited_fingerprints(docs).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def small(rows):
    """Without the very long texts, which the brute force would take minutes for."""
    return [r for r in rows if len(r[1] or "") < 50_000]


def test_equals_brute_force(spark):
    check(spark, small(awkward()) + [(500, "!!! ???", None, None, None), (501, "...", None, None, None), (500, "another text of the same id", None, None, None)])
    check(spark, [(7, "the only document", "en", "a", 1)])
    check(spark, [(None, "no id", "en", "a", 1), (None, "nor here", "en", "a", 1)])


def test_one_id_with_a_third_of_all_rows(spark, monkeypatch):
    monkeypatch.setattr(imatch, "PART_BYTES", 200)
    rng = random.Random(2)
    rows = [(i, words(rng, 20), None, None, None) for i in range(-20, 60)] + [(30, "hot", None, None, None)] * 40 + [(30, "hot too", None, None, None)] * 10 + [(None, words(rng, 5), None, None, None) for _ in range(15)]
    check(spark, rows)
    docs = frame(spark, rows, clash=False)
    sizes = [len(p) for p in imatch.with_next(docs, "doc_id", "text").rdd.glom().collect()]
    assert max(sizes) <= 25 and sum(sizes) <= len(rows) + len(sizes)


def test_long_texts_and_empty_table(spark):
    rows = awkward()
    got = imatch.edited_fingerprints(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    by_text = {}
    for r in imatch.fingerprints(frame(spark, rows)).join(spark.createDataFrame([(r[0], r[1]) for r in rows if r[0] is not None], "doc_id long, t string"), "doc_id").collect():
        assert by_text.setdefault(r.t or "", r.fingerprint) == r.fingerprint
    assert imatch.edited_fingerprints(frame(spark, [])).collect() == []


def test_document_frequencies_count_all_documents(spark):
    rows = [(i, f"common word{i % 7} word{i % 7}", None, None, None) for i in range(70)] + [(100, None, None, None, None)]
    total, counts = imatch.document_frequencies(frame(spark, rows))
    cell = lambda w: int(imatch._cells(imatch._terms([w.encode()])[1])[0])
    assert total == 71 and counts[cell("common")] == 70 and all(counts[cell(f"word{i}")] == 10 for i in range(7)) and counts.sum() == 140
    assert np.unpackbits(np.frombuffer(imatch.lexicon(frame(spark, rows), band=(1.0, 3.0)), np.uint8)).sum() == 7


def test_likeness_estimates_the_shared_terms(spark):
    rng = random.Random(8)
    base = [f"t{i}" for i in range(400)]
    known = np.packbits(np.ones(imatch.CELLS, bool)).tobytes()
    for keep in (1.0, 0.9, 0.6, 0.2, 0.0):
        pairs = []
        for j in range(30):
            own = [f"{j}{t}" for t in base]
            other = own[: int(400 * keep)] + [f"u{j}{t}" for t in base[int(400 * keep) :]]
            rng.shuffle(other)
            pairs.append((2 * j, " ".join(own)))
            pairs.append((2 * j + 1, " ".join(other)))
        f = imatch.fingerprints(spark.createDataFrame(pairs, "doc_id long, text string"), known=known)
        a, b = f.where("doc_id % 2 = 0").selectExpr("doc_id", "fingerprint a"), f.where("doc_id % 2 = 1").selectExpr("doc_id - 1 doc_id", "fingerprint b")
        near = [r.n for r in a.join(b, "doc_id").select(imatch.likeness(F.col("a"), F.col("b")).alias("n")).collect()]
        jaccard = keep / (2 - keep)
        assert sum(near) / len(near) == pytest.approx(jaccard, abs=0.07)
