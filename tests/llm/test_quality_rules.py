"""Counts against brute force, the learned list on planted kinds of junk, and the plan's nativeness."""

import re
from collections import Counter


from shoplens.llm import quality_rules as qr
from .conftest import DOC_SCHEMA, prose

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    windows = Counter(tuple(words[i:i + 8]) for i in range(len(words) - 7))
    covered = {j for i in range(len(words) - 7) if windows[tuple(words[i:i + 8])] > 1 for j in range(i, i + 8)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)),
            len(covered))


def test_counts(llm_spark, messy, no_docs, clashing):
    extra = ["a b c d e f g h " * 3, "x " * 9, "1 2 3 4 5 6 7 8", "l\nl\n l\n\nl\n", "# $ | < > & % *", "q w e r t y u i o " * 2 + "z"]
    docs = messy.union(llm_spark.createDataFrame([(50 + i, x, "en", "a", 1) for i, x in enumerate(extra)], DOC_SCHEMA))
    for r in qr.statistics(docs).collect():
        assert tuple(r[c] for c in qr.COUNTS) == brute(r["text"]), r["doc_id"]
    assert qr.statistics(no_docs).count() == 0
    assert qr.statistics(clashing).columns.count("n_words") == 1


def junk(spark, n=240):
    rows, labels = [], []
    for i in range(n):
        text = prose(1000 + i, 60 + i % 50)
        if i % 6 == 0:
            text = text.replace(" ", " *** ")
        elif i % 6 == 1:
            text = text.upper().replace(" ", "!! ")
        rows.append((i, text, "en", "a", len(text)))
        if i % 4 != 3:
            labels.append((i, 0 if i % 6 < 2 else 1))
    return spark.createDataFrame(rows, DOC_SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int")


def test_learned_list(llm_spark):
    docs, labels = junk(llm_spark)
    rows = qr.judge(docs, labels).collect()
    bad = [r["doc_id"] for r in rows if (r["doc_id"] % 6 < 2) != (not r["kept"])]
    assert not bad
    assert len({r["verdict"] for r in rows}) == 3           # two rules and keep
    assert all(r["kept"] == (r["verdict"] == "keep") for r in rows)


def test_rows(messy, no_docs, clashing, few_labels):
    judged = qr.judge(messy, few_labels, payload=True)
    for r in judged.collect():
        n, _, _, _, repeats = brute(r["text"])
        assert r["base_failed"] == (n < 20 or 100 * repeats > 30 * n)
        assert not (r["base_failed"] and r["kept"])
    assert judged.count() == messy.count()
    assert qr.judge(no_docs, few_labels).count() == 0
    none = few_labels.where("false")
    assert qr.judge(messy, none).where("kept = base_failed").count() == 0
    assert qr.judge(clashing, few_labels, payload=True).columns.count("kept") == 1


def test_no_python_in_the_plan(messy, few_labels):
    plan = qr.judge(messy, few_labels, payload=True)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_verdict_is_ordered(llm_spark):
    docs, _ = junk(llm_spark, 12)
    rules = [(qr.Test("symbols", True, 20),), (qr.Test("upper", True, 100), qr.Test("words", True, 0))]
    rows = qr.statistics(docs).select("doc_id", qr.verdict(rules).alias("v")).collect()
    assert {r["v"] for r in rows if r["doc_id"] % 6 == 0} == {"symbols > 20"}
    assert {r["v"] for r in rows if r["doc_id"] % 6 == 1} == {"upper > 100 and words > 0"}
    assert str(qr.Test("words", False, 3)) == "words <= 3"
