"""Language identification against the same model told with dictionaries."""

import math
import random
import re
from collections import Counter, defaultdict

import pytest

from ledgerloom.llm import language
from ledgerloom.llm.textcore import LOWER

from .corpora import awkward, frame
from .test_models import held


def split(text):
    return re.findall(rb"[a-z\x80-\xff]+", (text or "").encode().translate(LOWER))


def grams_of(word):
    """For each position of the marked word the n-grams that end there, longest first."""
    marked = f"\0{word.decode('utf-8', 'replace').lower()}\0"
    for end in range(1, len(marked) + 1):
        yield [marked[end - n : end] for n in range(min(language.LONGEST, end), 0, -1) if not (n == 1 and marked[end - 1] == "\0")]


def logs(counts, langs, least):
    """{key: log frequency in each language} of the keys that are frequent enough."""
    total = [sum(c[g] for c in counts.values()) for g in langs]
    return {k: [math.log((c[g] + 0.1) / (t + 0.1 * len(counts))) for g, t in zip(langs, total)] for k, c in counts.items() if sum(c.values()) >= least}


def told(docs):
    """{(id, text): (language, score)} of all rows."""
    own = {(i, t or "", g) for i, t, g, *_ in docs if g is not None and not held(i, 3, 1)}
    langs = sorted({g for *_, g in own}, key=lambda g: g.encode())
    counts, grams = defaultdict(Counter), defaultdict(lambda: defaultdict(Counter))
    for _, text, g in own:
        for w in split(text):
            counts[w][g] += 1
    for w, by in counts.items():
        for g, times in by.items():
            for ending in grams_of(w):
                for gram in ending:
                    grams[len(gram)][gram][g] += math.sqrt(times)
    known = logs(counts, langs, 2)
    tables = {n: logs(c, langs, 1 if n < 3 else 3) for n, c in grams.items()}

    def of_word(w):
        if w in known:
            return known[w]
        rows = [next((tables[len(x)][x] for x in ending if x in tables.get(len(x), ())), None) for ending in grams_of(w)]
        rows = [r for r in rows if r]
        return [sum(r[k] for r in rows) / len(rows) if rows else 0.0 for k in range(len(langs))]

    seen, out = {}, {}
    for i, text, *_ in docs:
        if not langs or not any(c.isalpha() for c in text or ""):
            out[i, text] = ("und", 0.0)
            continue
        words = split(text)
        for w in set(words) - set(seen):
            seen[w] = of_word(w)
        sums = [sum(seen[w][k] for w in words) / len(words) * min(len(words), language.SURE_WORDS) for k in range(len(langs))]
        parts = [math.exp(x - max(sums)) for x in sums]
        best = parts.index(max(parts))
        out[i, text] = (langs[best], parts[best] / sum(parts))
    return out


def mixed():
    rng = random.Random(6)
    stems = {"xx": ("lor", "rolo", "olör"), "yy": ("nib", "Bini", "inib"), "zz": ("lor", "nib", "ßa")}
    return [(1000 + i, " ".join("".join(rng.choice(stems[g]) for _ in range(rng.choice((1, 2, 3)))) for _ in range(rng.choice((1, 3, 30)))), g, None, None) for i in range(150) for g in [rng.choice(sorted(stems))]]


@pytest.mark.parametrize("rows", [awkward(), mixed(), awkward() + mixed() + [(5000, "日本語", None, None, None), (5001, "qqq lorq Nibbi", None, None, None)]], ids=["awkward", "mixed", "both"])
def test_every_prediction_equals_brute_force(spark, rows):
    got = language.languages(frame(spark, rows)).select("doc_id", "held_out", "lang_pred", "score").join(frame(spark, rows, clash=False).select("doc_id", "text").distinct(), "doc_id").collect()
    want = told(rows)
    ids = Counter(i for i, _ in want)
    checked = 0
    for r in got:
        if ids[r.doc_id] == 1:
            lang, score = want[r.doc_id, r.text]
            assert r.score == pytest.approx(score, abs=2e-4) and (r.lang_pred == lang or abs(r.score - 0.5) < 1e-4), (r, lang, score)
            checked += 1
    assert checked >= len([k for k in ids if ids[k] == 1 and k is not None])


def test_ties_go_to_the_first_language_by_code_point(spark):
    free = [i for i in range(100) if not held(i, 3, 1)]
    rows = [(i, "same words here", g, None, None) for i, g in zip(free, ["é", "z", "Z", "é", "z", "Z"])]
    rows += [(500, "same words", None, None, None), (501, "日本", None, None, None)]
    got = {r.doc_id: r for r in language.languages(frame(spark, rows)).collect()}
    assert {r.lang_pred for r in got.values()} == {"Z"} and all(r.score == pytest.approx(1 / 3, abs=1e-6) for r in got.values())
