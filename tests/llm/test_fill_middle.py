import hashlib
import re

from pyspark.sql import functions as F

from ledgerloom.llm import fill_middle

from .corpora import awkward, frame

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def brute(doc, text, seed=42):
    text = text or ""
    units = UNIT.findall(text)
    assert "".join(units) == text
    digest = hashlib.sha256(f"{seed}:{'' if doc is None else doc}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[i : i + 8], 16) for i in (0, 8, 16, 24))
    a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return (doc, len(units), "plain", None, None, text)
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    form = "spm" if h4 % 100 < 80 else "psm"
    return (doc, len(units), form, len(p), len(m), f"<P>{p}<S>{s}<M>{m}" if form == "psm" else f"<S>{s}<P>{p}<M>{m}")


def rows(extra=()):
    out = awkward()
    out += [(400 + i, t, None, None, None) for i, t in enumerate(("a <P> mark", "x<S>", "<M>", "< P> no mark <", "  lead and tail \n\t ", "\x0b\x0c", "é 日本 😀😀 x", "a\x85b c", "<<S", "word"))]
    return out + list(extra)


def test_equals_brute_force_and_rebuilds_the_text(spark):
    data = rows([(i, f"w{i} " * (i % 9) + "<" * (i % 3), None, None, None) for i in range(500, 900)])
    df = fill_middle.fill_in_middle(frame(spark, data))
    got = df.withColumn("again", fill_middle.restored(F.col("output"), F.col("form"))).collect()
    assert sorted((tuple(r)[:-1] for r in got), key=repr) == sorted((brute(r[0], r[1]) for r in data), key=repr)
    assert sorted(r.again for r in got) == sorted(r[1] or "" for r in data)
    assert {r.form for r in got} == {"plain", "psm", "spm"}


def test_all_are_cut_with_other_parameters(spark):
    got = fill_middle.fill_in_middle(frame(spark, rows(), clash=False), seed=7, percent=100, suffix_first=0).collect()
    texts = {r[0]: r[1] or "" for r in rows()}
    for r in got:
        if r.doc_id is not None:
            assert r.form == ("plain" if not texts[r.doc_id] or any(m in texts[r.doc_id] for m in ("<P>", "<S>", "<M>")) else "psm")


def test_texts_are_shuffled_once(spark):
    df = fill_middle.fill_in_middle(frame(spark, rows(), clash=False))
    df.write.format("noop").mode("overwrite").save()
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    shuffles = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert sum("ReusedExchange" in line for line in shuffles) == 2 and len(shuffles) == 3
    assert not any(x in plan for x in ("Python", "Broadcast"))


def test_empty_table(spark):
    assert fill_middle.fill_in_middle(frame(spark, [])).collect() == []
