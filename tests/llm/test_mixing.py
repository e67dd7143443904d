import numpy as np

from ledgerloom.llm import mixing

from .corpora import awkward, frame


def targets(sizes):
    """By the rule as it is told: share by weight, stop at twice the size, deal the excess anew until nobody is above."""
    names = sorted((k for k in sizes if k is not None), key=lambda x: x.encode()) + [None] * (None in sizes)
    w = {k: (3, 1, 2)[i % 3] for i, k in enumerate(names)}
    left, out, todo = 1.5 * sum(sizes.values()), {}, set(names)
    while todo:
        share = {k: left * w[k] / sum(w[x] for x in todo) for k in todo}
        over = {k for k in todo if share[k] >= 2 * sizes[k]}
        if not over:
            return out | share
        for k in over:
            out[k] = 2.0 * sizes[k]
        left -= sum(out[k] for k in over)
        todo -= over
    return out


def sizes_of(rows):
    out = {}
    for r in rows:
        out[r[3]] = out.get(r[3], 0) + len([w for w in (r[1] or "").replace("\t", " ").replace("\n", " ").split(" ") if w])
    return out


def test_report_on_awkward_rows(spark):
    rows = awkward()
    got = mixing.mix_report(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    sizes = sizes_of(rows)
    want = {(sizes[k], round(t, 6)) for k, t in targets(sizes).items()}
    assert {(r.source_size, round(r.target, 6)) for r in got} == want
    assert all(r.taken in (0, r.size, 2 * r.size) for r in got)
    assert sorted(got, key=repr) == sorted(mixing.mix_report(frame(spark, rows).repartition(5)).collect(), key=repr)


def test_sources_come_near_their_targets(spark):
    rng = np.random.default_rng(3)
    rows = [(i, " ".join(["w"] * int(rng.integers(1, 900))), "en", f"s{i % 7}", 1) for i in range(1400)]
    got = mixing.mix_report(frame(spark, rows)).toPandas().merge(frame(spark, rows).select("doc_id", "source").toPandas(), on="doc_id")
    by = got.groupby("source").agg(taken=("taken", "sum"), target=("target", "max"))
    assert (abs(by.taken - by.target) / by.target).max() < 0.01
    assert abs(by.target.sum() - 1.5 * got["size"].sum()) < 1e-3


def test_settled_reaches_what_can_be_reached():
    rng = np.random.default_rng(9)
    for n in (1, 2, 6, 12):
        for k in range(40):
            words = np.round(rng.lognormal(4, 1.5, n)) + 1
            aim = float(rng.uniform(0.05, 0.95, n) @ words)
            totals = (np.arange(1 << n)[:, None] >> np.arange(n) & 1) @ words
            got = mixing.settled((rng.random(n) < 0.5).astype(float), words, aim, k)
            assert set(got) <= {0.0, 1.0}
            best = abs(totals - aim).min()
            assert abs(got @ words - aim) <= max(best, 0.001 * aim) + n * (aim + words.max()) / mixing.CELLS + n


def test_skewed_sources_come_near_their_targets(spark):
    """Sources of 30 to 80 documents, most words in a few of them."""
    rng = np.random.default_rng(12)
    sizes = [[int(x) + 1 for x in rng.lognormal(4.5, 1.6, int(rng.integers(30, 80)))] for _ in range(60)]
    rows = [(1000 * s + i, " ".join(["w"] * n), "en", f"s{s:03}", 1) for s, each in enumerate(sizes) for i, n in enumerate(each)]
    got = mixing.mix_report(frame(spark, rows, clash=False)).toPandas()
    by = got.assign(source=got.doc_id // 1000).groupby("source").agg(taken=("taken", "sum"), target=("target", "max"))
    assert (abs(by.taken - by.target) / by.target).max() < 0.01
    assert (got.taken <= 2 * got["size"]).all()


def test_flight_keeps_both_totals_and_its_expectation():
    rng = np.random.default_rng(1)
    size, m, p = rng.integers(1, 1000, 300), np.ones(300), rng.uniform(0.05, 0.95, 300)
    runs = np.array([mixing.flight(p, m, size, s) for s in range(300)])
    assert np.allclose(runs.sum(axis=1), p.sum()) and np.allclose(runs @ size, p @ size)
    assert ((runs > 0) & (runs < 1)).sum(axis=1).max() <= 2
    assert abs(runs.mean(axis=0) - p).max() < 0.13


def test_blocks_of_a_large_source(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK", 32)
    rows = [(i, " ".join(["w"] * (1 + i * 37 % 200)), "en", "b" if i % 3 else "a", 1) for i in range(900)]
    got = mixing.mix_report(frame(spark, rows)).toPandas()
    by = got.groupby("source_size").agg(taken=("taken", "sum"), target=("target", "max"))
    assert (abs(by.taken - by.target) / by.target).max() < 0.02


def test_mix_repeats_rows_as_the_plan_says(spark):
    rows = [r for r in awkward() if r[0] not in (0, 1)]
    df = frame(spark, rows)
    plan = {(r.doc_id): r.taken // r.size if r.size else 0 for r in mixing.mix_report(df).collect() if r.size and r.doc_id is not None}
    mixed = mixing.mix(df)
    assert mixed.columns == df.columns
    seen = {}
    for r in mixed.collect():
        seen[r.doc_id] = seen.get(r.doc_id, 0) + 1
    assert all(seen.get(k, 0) == n for k, n in plan.items())


def test_a_row_repeated_very_often(spark):
    df = spark.range(20_000).selectExpr("7L as doc_id", "'a b c' as text", "'s' as source", "'x' as _s").union(spark.createDataFrame([(i, f"w{i} " * i, "s", "y") for i in range(20, 60)], "doc_id long, text string, source string, _s string"))
    got = mixing.mix_report(df)
    assert got.where("doc_id = 7").count() == 20_000 and got.where("doc_id = 7").select("taken").distinct().count() == 1
    mixed = mixing.mix(df)
    assert mixed.columns == df.columns and mixed.where("doc_id = 7").count() == 20_000 * (got.where("doc_id = 7").first().taken // 3)


def test_empty_table(spark):
    assert mixing.mix_report(frame(spark, [])).collect() == []
