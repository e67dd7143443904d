import math
import re
from collections import defaultdict

import numpy as np
import pytest

from ledgerloom.llm import labelled, toxicity
from ledgerloom.llm.textcore import LOWER

from .corpora import awkward, frame
from .test_models import LABELS, corpus, held


def split(text):
    return re.findall(rb"[0-9a-z\x80-\xff]+", (text or "").encode().translate(LOWER))


def word_ratio(docs, labels):
    """log P(word | toxic) - log P(word | ordinary), told with dictionaries over all labelled training rows."""
    label = {}
    for i, _, toxic in labels:
        if i is not None and toxic in (0, 1) and not held(i, 3, 1):
            label[i] = max(label.get(i, 0), toxic)
    seen = [set(), set()]
    for i, text, *_ in docs:
        if i in label:
            w = split(text)
            seen[label[i]].update(zip([None, *w[:-1]], w))
    scale = min(1.0, len(seen[1]) / max(1, len(seen[0])))

    def chain(w):
        return [(0, w[:k].ljust(k, b"\0")) for k in toxicity.PREFIXES] + [(1, w)]

    counts, children = defaultdict(lambda: [0, 0]), defaultdict(set)
    for c in (0, 1):
        for _, w in seen[c]:
            for parent, key in zip([None, *chain(w)[:-1]], chain(w)):
                counts[key][c] += 1
                children[parent].add(key)

    def parts(key):
        a, b = counts.get(key, (0, 0))
        return max(a - toxicity.DISCOUNT, 0) * scale, max(b - toxicity.DISCOUNT, 0), a * scale + b

    def ratio(w):
        total = 0.0
        for parent, key in zip([None, *chain(w)[:-1]], chain(w)):
            below = [parts(k) for k in children.get(parent, ())]
            s0, s1, pooled = (sum(x[j] for x in below) for j in range(3))
            given = toxicity.DISCOUNT * (len(below) + 1)
            k0, k1, own = parts(key)
            if k0 == k1 == 0:
                return total + math.log((s0 + given) / (s1 + given))
            total += math.log((k1 + given * own / pooled) / (s1 + given)) - math.log((k0 + given * own / pooled) / (s0 + given))
        return total

    return ratio


def test_models_equal_brute_force_over_all_rows(spark):
    docs, labels = corpus(150)
    docs += [(1000 + i, t, a, b, n) for i, (_, t, a, b, n) in enumerate(awkward()[:60])] + [docs[0], docs[0]]
    labels += [(1000 + i, 1, i % 2) for i in range(60)] + [(2, 1, 1)]
    model = toxicity.models(toxicity.vocabulary(frame(spark, docs), spark.createDataFrame(labels, LABELS)))
    ratio, told = toxicity._ratio(model.toArrow(), "all"), word_ratio(docs, labels)
    words = sorted({w for d in docs for w in split(d[1])} | {b"vile", b"vilexest", b"unseen", b"q"})
    t = toxicity.tokens([b" ".join(words)])
    assert np.allclose(ratio.of(t), [told(w) for w in words], atol=1e-9)
    types = spark.createDataFrame([(int(a), int(b)) for a, b in zip(t.word.view(np.int64), t.head.view(np.int64))], "word long, head long")
    by = {r.word: r.value for r in toxicity._values(types, model, "all").collect()}
    assert np.allclose([by[int(a)] for a in t.word.view(np.int64)], [told(w) for w in words], atol=1e-9)


@pytest.mark.parametrize("empty", [False, True])
def test_joined_models_score_like_broadcast_ones(spark, empty):
    docs, labels = corpus(150)
    a, b = frame(spark, docs + [(5000 + (r[0] or 0), *r[1:]) for r in awkward()]), spark.createDataFrame([] if empty else labels, LABELS)
    near, far = (sorted(toxicity.toxicity_scores(a, b, most_keys=n).select("doc_id", "held_out", "score", "predicted").collect()) for n in (1 << 20, -1))
    assert len(near) == len(far) and all(x[:2] == y[:2] and abs(x.score - y.score) < 1e-9 for x, y in zip(near, far))


@pytest.mark.parametrize("slots", [1, 1 << 18])
@pytest.mark.parametrize("kind", ["long", "int", "string", "double"])
def test_no_labelled_row_is_lost_to_the_bit_table(spark, monkeypatch, slots, kind):
    monkeypatch.setattr(labelled, "SLOTS", slots)
    ids = spark.range(3000).selectExpr(f"cast(if(id = 7, null, id) as {kind}) as doc", "if(id % 9 = 0, 'x', 'y') as text")
    known = spark.range(0, 3500, 5).selectExpr(f"cast(id as {kind}) as _id")
    left = labelled.likely_labelled(ids, known, "doc")
    wanted = {r.doc for r in ids.collect()} & {r[0] for r in known.collect()}
    assert left.columns == ids.columns and wanted <= {r.doc for r in left.collect()}
    if slots > 1 and kind != "double":
        assert left.count() < 660
    assert labelled.likely_labelled(ids, known.where("false"), "doc").count() == (3000 if kind == "double" else 0)


def test_ids_of_unlike_types_still_meet(spark):
    ids, known = spark.range(100).selectExpr("cast(id as int) as doc"), spark.range(0, 100, 5).selectExpr("id as _id")
    assert labelled.likely_labelled(ids, known, "doc").count() == 100
