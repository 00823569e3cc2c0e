"""Spelling variants against brute force over all pairs."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from shoplens.llm import spelling as sp

RUN = re.compile("[A-Za-zÀ-ÿ]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def plain(counts, ratio=2):
    form, found = {}, {}
    for w, n in counts.items():
        ns = [x for x in counts if near(w, x)]
        f = min(ns, key=lambda x: (-counts[x], x), default=None)
        form[w] = f if f is not None and counts[f] >= ratio * n else None
        found[w] = len(ns)
    rows = {}
    for w, n in counts.items():
        root = w
        while form[root] is not None:
            root = form[root]
        rows[w] = (form[w], root, n, found[w], counts[form[w]] if form[w] is not None else None)
    return rows


def got(spark, counts, **args):
    words = spark.createDataFrame(list(counts.items()), "word string, n long")
    rows = sp.variants(words, **args).collect()
    assert len(rows) == len(counts)
    return {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in rows}


def invented(seed, n, letters="abé", sizes=(1, 9)):
    rng = random.Random(seed)
    return {"".join(rng.choice(letters) for _ in range(rng.randrange(*sizes))): rng.randrange(1, 60) for _ in range(n)}


@pytest.mark.parametrize("meet", [2048, 2])
def test_variants(llm_spark, meet):
    counts = invented(1, 500) | {"a" * 40: 3, "a" * 41: 9, "a" * 20 + "b" + "a" * 20: 4, "b" + "a" * 40: 9,
                                 "😀aaaa": 2, "aaaa😀": 9, "x": 5, "xy": 2}
    assert got(llm_spark, counts, meet=meet) == plain(counts)


def test_a_group_of_one_prefix_and_suffix(llm_spark):
    rng = random.Random(7)
    counts = {"same" + "".join(rng.choice("abcdefgh") for _ in range(3)) + "tail": rng.randrange(3, 99) for _ in range(400)}
    assert got(llm_spark, counts, meet=16) == plain(counts)


def test_one_edit_by_rows():
    words = sorted(invented(3, 400, "ab", (1, 12)))
    size = np.array([len(w) for w in words])
    u, v = sp.one_edit(words, np.zeros(len(words), np.int64), size > 0, np.ones(len(words), bool))
    assert sorted(zip(u.tolist(), v.tolist())) == sorted(
        (i, j) for i, a in enumerate(words) for j, b in enumerate(words) if near(a, b))


def test_one_edit_of_very_long_words():
    rng = random.Random(2)
    long = "".join(rng.choice("ab") for _ in range(5000))
    words = sorted({long, long[:4000] + "c" + long[4001:], long + "a", long[1:], long[:-2], "a"})
    u, v = sp.one_edit(words, np.zeros(len(words), np.int64), np.ones(len(words), bool), np.ones(len(words), bool))
    assert {(words[a], words[b]) for a, b in zip(u, v)} == {(a, b) for a in words for b in words if near(a, b)}


def test_chains_end_at_roots(llm_spark):
    chain = ["a" * (5 + i) for i in range(20)]
    counts = {w: 2 ** i for i, w in enumerate(chain)}
    assert {r[1] for r in got(llm_spark, counts).values()} == {chain[-1]}


def test_ratio_must_double(llm_spark):
    with pytest.raises(ValueError):
        sp.variants(llm_spark.createDataFrame([("a", 1)], "word string, n long"), ratio=1)


def plain_vocabulary(rows, least_length, least_count, strike):
    counts = Counter()
    for key, text in rows:
        for run in RUN.findall(text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if strike and h % strike == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            if len(run) >= least_length:
                counts[run] += 1
    return {w: n for w, n in counts.items() if n >= least_count}


def test_vocabulary(llm_spark, messy, no_docs, clashing, monkeypatch):
    extra = llm_spark.createDataFrame([(20 + i, "Größe ÀÉ×÷ÿ naïve NAÏVE İstanbul Kelvinß привет größe " * 30, "de", "a", 1)
                                       for i in range(9)], messy.schema)
    docs = messy.union(extra)
    rows = [(d["doc_id"], d["text"]) for d in docs.collect()]
    for strike in (None, 7):
        made = sp.vocabulary(docs, strike=strike).collect()
        assert {r["word"]: r["n"] for r in made} == plain_vocabulary(rows, 5, 3, strike) and len(made) > 100
    assert sp.variants(sp.vocabulary(no_docs)).count() == 0
    assert sp.vocabulary(clashing.withColumn("word", F.lit("q")).withColumn("n", F.lit(1))).columns == ["word", "n"]
    words = sp.vocabulary(clashing, strike=7)
    counts = {r["word"]: r["n"] for r in words.collect()}
    made = {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in sp.variants(words).collect()}
    assert made == plain(counts)


def test_short_words_and_no_pairs(llm_spark):
    assert got(llm_spark, {"abcde": 3, "vwxyz": 9}) == {"abcde": (None, "abcde", 3, 0, None), "vwxyz": (None, "vwxyz", 9, 0, None)}
    assert got(llm_spark, {"": 3, "v": 9})[""][3] == 0          # an empty word is in no group
