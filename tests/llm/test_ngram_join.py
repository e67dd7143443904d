import random
import re

import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import ngram_join

from .corpora import awkward, frame, words


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                parent[root(a)] = root(b)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[root(i)] = min(doc, least.get(root(i), doc))
    return [(doc, len(sets[i]), least.get(root(i)) if sets[i] else doc) for i, (doc, _) in enumerate(rows)]


def sort(rows):
    return sorted(map(tuple, rows), key=repr)


def corpus(seed, n):
    rng = random.Random(seed)
    base = [words(rng, rng.choice((3, 5, 20, 60, 150))).split() for _ in range(n // 6)]
    shared = [words(rng, 30).split() for _ in range(3)]
    out = []
    for i in range(n):
        b = list(rng.choice(base))
        for _ in range(rng.choice((0, 0, 1, 1, 2, 3, 6))):
            b[rng.randrange(len(b))] = f"w{rng.randrange(300)}"
        out.append((i * 3 + 1, " ".join(b + rng.choice(shared) if rng.random() < 0.3 else b)))
    return out


@pytest.mark.parametrize(("tile", "seed"), [(512, 1), (8, 2), (4, 3)])
def test_equals_brute_force_with_whole_and_cut_tiles(spark, monkeypatch, tile, seed):
    monkeypatch.setattr(ngram_join, "TILE_NODES", tile)
    rows = corpus(seed, 150)
    got = ngram_join.ngram_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sort(got) == sort(brute(rows))


def test_awkward_rows(spark):
    rows = awkward()
    got = ngram_join.ngram_components(frame(spark, rows)).collect()
    assert sort(got) == sort(brute([r[:2] for r in rows]))


def test_threshold_is_exact(spark):
    # sets of 7 and 7 shingles with 6 in common: 6/8 = 0.75 links; 5 in common: 5/9 doesn't
    rows = [(1, "a b c d e f g h i j k"), (2, "a b c d e f g h i j z"), (3, "a b c d e f g h i y z")]
    got = {r.doc_id: r.component_id for r in ngram_join.ngram_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 1, 2: 1, 3: 3}
    assert sort((k, 7, v) for k, v in got.items()) == sort(brute(rows))


def test_empty_table(spark):
    assert ngram_join.ngram_components(frame(spark, [])).collect() == []


def test_drop_keeps_one_row_of_each_component(spark):
    text = " ".join(f"w{i}" for i in range(30))
    other = " ".join(f"v{i}" for i in range(30))
    rows = [(1, text)] * 4 + [(2, text + " x"), (1, other), (5, other), (None, "n1 n2 n3 n4 n5 n6"), (None, "n1 n2 n3 n4 n5 n6"), (8, ""), (8, None), (9, " ")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("h", F.lit("clash"))
    kept = ngram_join.drop_near_duplicates(df)
    assert kept.columns == df.columns
    assert sort((r.doc_id, r.text) for r in kept.collect()) == sort([(1, text), (1, other), (None, "n1 n2 n3 n4 n5 n6"), (8, ""), (8, None), (9, " ")])


def test_one_shingle_common_to_thousands(spark):
    """All texts share a passage, so one tile has all nodes; its cuts are compared and links between them found."""
    rng = random.Random(3)
    rows = [(i, "p q r s t " + words(rng, 12, 5000, f"z{i % 1200}x")) for i in range(2500)]
    rows += [(5000 + i, rows[i][1]) for i in range(300)] + [(9000 + i, rows[i][1] + " end") for i in range(300)]
    got = {r.doc_id: r.component_id for r in ngram_join.ngram_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[i] == i for i in range(2500)) and all(got[5000 + i] == i and got[9000 + i] == i for i in range(300))


def test_drop_keeps_one_of_each_group(spark):
    rows = corpus(7, 80)
    kept = [r.doc_id for r in ngram_join.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sorted(kept) == sorted({c for _, _, c in brute(rows)})


def test_shingles_are_shuffled_once(spark):
    prefixes = spark.createDataFrame([(1, 5, [10, 11]), (2, 5, [11, 12]), (3, 4, [12]), (4, 4, [13])], "node long, n long, tokens array<long>")
    members = ngram_join._members(prefixes)
    assert sorted(map(tuple, members.collect())) == [(1, 1, 5), (1, 2, 5), (2, 2, 5), (2, 3, 4)]
    assert members._jdf.queryExecution().sparkPlan().toString().count("Generate explode") == 1


def test_sets_go_only_where_a_pair_may_link(spark, monkeypatch):
    """Texts that share a passage but are far apart meet in cut tiles; their sets, most of what could be sent, stay where they are."""
    monkeypatch.setattr(ngram_join, "TILE_NODES", 4)
    rng = random.Random(7)
    shared = words(rng, 12)
    rows = [(i, f"{shared} {' '.join(f'own{i}x{k}' for k in range(12))}") for i in range(40)]
    rows += [(100 + i, f"{rows[i][1]} end") for i in range(3)]
    sent, plain = [], ngram_join._links
    monkeypatch.setattr(ngram_join, "_links", lambda tiles, sets, threshold: sent.append(tiles.count()) or plain(tiles, sets, threshold))
    monkeypatch.setattr(ngram_join, "CELLS", 1)  # the order is as good as random, so the shared passage leads to tiles
    got = ngram_join.ngram_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sort(got) == sort(brute(rows))
    assert sum(sent) <= 40


def test_the_whole_join_runs_few_jobs(spark):
    """Each job, and each shuffle that is one, leaves threads and records in the driver (101 jobs here when each shuffle was one)."""
    docs = spark.createDataFrame(corpus(1, 150), "doc_id long, text string")
    spark.sparkContext.setJobGroup("few-jobs", "op1")
    try:
        got = ngram_join.ngram_components(docs).collect()
        jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("few-jobs"))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(got) == 150
    assert jobs < 80
