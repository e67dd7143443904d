import random
import zlib

import numpy as np

from ledgerloom.llm import html_text, language, quality, toxicity

from .corpora import awkward, frame, words

LABELS = "doc_id long, quality int, toxic int"


def held(doc, modulus, remainder):
    return zlib.crc32(("" if doc is None else str(doc)).encode()) % modulus == remainder


def corpus(n=400):
    rng = random.Random(2)
    docs, labels = [], []
    for i in range(n):
        bad, toxic = rng.random() < 0.3, rng.random() < 0.3
        w = words(rng, 60, 120).split()
        if toxic:
            for _ in range(3):
                w[rng.randrange(60)] = rng.choice(("vilex", "vilexer", "grumpf"))
        text = " ".join(x + "###" for x in w) if bad else " ".join(w) + "."
        docs.append((i, text, rng.choice("ab"), "s", None))
        labels.append((i, int(not bad), int(toxic)))
    return docs, labels


def test_quality_and_toxicity_on_held_out_rows(spark):
    docs, labels = corpus()
    truth = {d: (q, t) for d, q, t in labels}
    a, b = frame(spark, docs), spark.createDataFrame([*labels, (None, 1, 1), (9999, None, None), (3, None, 7)], LABELS)
    for f, at, modulus, remainder in ((quality.quality_scores, 0, 5, 0), (toxicity.toxicity_scores, 1, 3, 1)):
        got = f(a, b).collect()
        assert len(got) == len(docs) and all(0 <= r.score <= 1 and r.held_out == held(r.doc_id, modulus, remainder) for r in got)
        own = [r for r in got if r.held_out]
        assert np.mean([r.predicted == truth[r.doc_id][at] for r in own]) > 0.95


def test_scores_use_the_text_alone(spark):
    docs, labels = corpus(120)
    b = spark.createDataFrame(labels, LABELS)
    other = [(d + 0, t, "zz", "other", n) for d, t, _, _, n in docs]
    for f in (quality.quality_scores, toxicity.toxicity_scores):
        assert sorted(f(frame(spark, docs), b).collect()) == sorted(f(frame(spark, other), b).collect())


def test_awkward_rows_and_empty_tables(spark):
    df, none = frame(spark), spark.createDataFrame([], LABELS)
    rows = awkward()
    labels = spark.createDataFrame([(i, i % 2, (i + 1) % 2) for i in range(30)], LABELS)
    for f in (quality.quality_scores, toxicity.toxicity_scores):
        got = f(df, labels).collect()
        assert len(got) == len(rows) and all(r.score is not None for r in got)
        assert {r.score for r in f(df, none).collect()} == {0.5}
        assert f(frame(spark, []), labels).collect() == []
    kept = quality.keep_good(df, labels)
    assert kept.columns == df.columns and kept.count() <= len(rows)


def test_sum_of_squares_identity():
    rng = np.random.default_rng(0)
    m = quality.Machine(0.3, rng.normal(size=quality.BUCKETS + quality.STATS), rng.normal(size=(quality.BUCKETS + quality.STATS, quality.RANK)))
    x = quality.Features(np.array([0, 4]), np.array([1, 5, 9, 20]), np.array([0.5, -1.0, 2.0, 0.1]))
    pairs = sum(m.factor[a] @ m.factor[b] * u * v for i, (a, u) in enumerate(zip(x.column, x.value)) for b, v in list(zip(x.column, x.value))[i + 1 :])
    assert np.isclose(m._margin(x)[0][0], 0.3 + m.weight[x.column] @ x.value + pairs)


def test_language(spark):
    rng = random.Random(6)
    stems = {"xx": ("lor", "rolo", "olor"), "yy": ("nib", "bini", "inib")}
    rows = [(i, " ".join("".join(rng.choice(stems[g]) for _ in range(rng.choice((1, 2, 3)))) for _ in range(8)), g, None, None) for i in range(200) for g in [rng.choice(("xx", "yy"))]]
    odd = [(900, None, None, None, None), (901, "", "xx", None, None), (902, "123 — … 456", "xx", None, None), (903, "\U0001f600 !!", None, None, None), (904, "日本語", None, None, None), (None, "lorolor", None, None, None), rows[0]]
    got = language.languages(frame(spark, rows + odd)).collect()
    truth = {r[0]: r[2] for r in rows}
    assert len(got) == len(rows) + len(odd)
    assert all(r.lang_pred == truth[r.doc_id] for r in got if r.held_out and r.doc_id in truth)
    by = {r.doc_id: r for r in got}
    assert all(by[k].lang_pred == "und" for k in (900, 901, 902, 903)) and by[904].lang_pred in ("xx", "yy") and by[None].lang_pred == "xx"
    assert all(0 <= r.score <= 1 and r.held_out == held(r.doc_id, 3, 1) for r in got)
    assert {r.lang_pred for r in language.languages(frame(spark, [(1, "lor", None, None, None)])).collect()} == {"und"}
    assert language.languages(frame(spark, [])).collect() == []


PAGE = """<html><head><title>T</title><script>var a="</p>";</script></head><body><div class="cookie-banner">We use cookies.</div><nav><a href=x>Home</a></nav>
<article><h1>Title</h1><p>First  paragraph &amp; more&nbsp;words in it, quite a few of them.<br>Next line.<div class="ad">Buy now.</div><p>Second paragraph with enough words too.</p>
<section class="comments"><h2>Comments</h2><p>I like this article very much indeed.</p></section></article><footer>&copy; me</footer></body></html>"""


def test_html(spark):
    rows = [(1, "u", PAGE), (2, "u", None), (3, None, ""), (None, "u", PAGE[:-300]), (5, "u", "<p" * 5), (6, "u", "<div>" * 3000 + "deep"), (1, "u", PAGE)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'x' as text", "'y' as n_chars")
    got = html_text.main_texts(df).collect()
    text = "Title\nFirst paragraph & more words in it, quite a few of them. Next line.\nSecond paragraph with enough words too."
    assert len(got) == len(rows) and all(r.n_chars == len(r.text) for r in got)
    assert [r.text for r in got if r.page_id == 1] == [text, text] and all(r.text == "" for r in got if r.page_id in (2, 3))
    assert html_text.main_texts(df.limit(0)).collect() == []


def test_deep_pages_and_short_pieces():
    import time

    model = html_text.default_model()
    began = time.process_time()
    nodes = html_text.parse("<div>" * 60_000 + "words" + "<p>a" * 60_000 + "<ul><li>" * 30_000)
    assert time.process_time() - began < 10
    assert len(nodes) == 1 + 60_000 + 1 + 120_000 + 60_000
    page = "<html><body><nav><ul><li><a href=x>Home</a></li></ul></nav>{}<footer>c 2020</footer></body></html>"
    for inside, want in (
        ("<div class='storyBody'><p>A paragraph with some words in it.</p><ul><li>First</li><li>Second</li></ul></div>", "A paragraph with some words in it.\nFirst\nSecond"),
        ("<article><h1>Title</h1><p>Some words of the article.</p><p><a href=x>A paragraph that is one link</a></p></article>", "Title\nSome words of the article.\nA paragraph that is one link"),
        ("<article><p>Let <math><mi>x</mi></math> be it, for all that follows.</p></article>", "Let x be it, for all that follows."),
    ):
        assert model.main_text(page.format(inside)) == want


def test_elements_close_as_before():
    def shape(html):
        nodes = html_text.parse(html)
        return [(n.tag, n.parent, n.text) for n in nodes[1:]]

    assert shape("<p>a<p>b") == [("p", 0, ""), ("#text", 1, "a"), ("p", 0, ""), ("#text", 3, "b")]
    assert shape("<p>a<button><p>b") == [("p", 0, ""), ("#text", 1, "a"), ("button", 0, ""), ("p", 3, ""), ("#text", 4, "b")]
    assert shape("<ul><li>a<ul><li>b</ul><li>c") == [("ul", 0, ""), ("li", 1, ""), ("#text", 2, "a"), ("ul", 2, ""), ("li", 4, ""), ("#text", 5, "b"), ("li", 1, ""), ("#text", 7, "c")]
    assert shape("<div><p>a</div>b</p>c") == [("div", 0, ""), ("p", 1, ""), ("#text", 2, "a"), ("#text", 0, "b"), ("#text", 0, "c")]


def test_marginals_equal_enumeration():
    model = html_text.default_model()
    nodes = html_text.parse("<div class=post><p>Some words here.</p><p><a href=x>link</a></p></div>")
    kinds = [n.tag == "#text" for n in nodes]
    emit = [[1.0] * 3 for _ in nodes]
    for i, n in enumerate(nodes):
        for f in html_text.features(n, nodes[n.parent]):
            e = model.emit.get(f)
            emit[i] = [a * b for a, b in zip(emit[i], e)] if e else emit[i]
        if kinds[i]:
            emit[i][2] = 0.0
    total, content = 0.0, [0.0] * len(nodes)
    for code in range(3 ** len(nodes)):
        y = [code // 3**i % 3 for i in range(len(nodes))]
        p = model.start[y[0]]
        for i, n in enumerate(nodes):
            p *= emit[i][y[i]] * (model.moves[kinds[i]][y[n.parent]][y[i]] if i else 1)
        total += p
        content = [c + p * (v == 1) for c, v in zip(content, y)]
    assert np.allclose(model.marginals(nodes), [c / total for c in content], atol=1e-9)


def test_held_out_template_pages():
    template, wrong, total = html_text._Template(77), 0, 0
    model = html_text.default_model()
    for _ in range(120):
        root, page = template.page()
        nodes, label = html_text.parse(page), []
        for i, (n, p) in enumerate(zip(nodes, model.marginals(nodes))):
            above = label[n.parent] if i else "bcm".index(root)
            label.append("bcm".index(n.given) if n.given else 0 if n.tag == "#text" and above == 2 else above)
            if n.tag == "#text":
                total += 1
                wrong += (p >= 0.5) != (label[i] == 1)
    assert wrong / total < 0.04
