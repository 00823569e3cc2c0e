"""Forward-backward against enumeration, gradients' effect, held-out accuracy, and odd rows."""

import itertools
import random

import numpy as np

from shoplens.llm import crf_langid as crf
from .conftest import DOC_SCHEMA

SYLLABLES = {"aa": ["ka", "to", "mi", "ru"], "bb": ["sch", "erg", "ung", "ein"], "cc": ["eau", "oi", "ment", "que"]}


def sentence(lang, rng, n):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(n))


def documents(spark, n=240):
    rng = random.Random(4)
    rows = []
    for i in range(n):
        lang = "aa bb cc".split()[i % 3]
        rows.append((i, sentence(lang, rng, 20) + ".\n" + sentence(lang, rng, 90), lang, "s", 1))
    return spark.createDataFrame(rows, DOC_SCHEMA)


def test_forward_backward_equals_enumeration():
    rng = np.random.default_rng(1)
    n, k = 4, 3
    energy, first, step = rng.normal(size=(1, n, k)), rng.normal(size=k), rng.normal(size=(k, k))
    total, marginal, moves = 0.0, np.zeros((n, k)), np.zeros((k, k))
    for path in itertools.product(range(k), repeat=n):
        p = np.exp(first[path[0]] + sum(energy[0, t, y] for t, y in enumerate(path))
                   + sum(step[a, b] for a, b in zip(path, path[1:])))
        total += p
        for t, y in enumerate(path):
            marginal[t, y] += p
        for a, b in zip(path, path[1:]):
            moves[a, b] += p
    padded = np.concatenate([energy, rng.normal(size=(1, 2, k))], axis=1)
    inside = np.array([[True] * n + [False] * 2])
    gamma, got, log_z = crf.forward_backward(padded, inside, first, step)
    assert np.allclose(gamma[0, :n], marginal / total)
    assert np.allclose(got, moves / total)
    assert np.isclose(log_z, np.log(total))


def test_features_of_affixes():
    owner, places = crf.features(["schein", "schule", "kato"], [frozenset(["kato"])])
    sets = [set(places[owner == i].tolist()) for i in range(3)]
    assert len(sets[0] & sets[1]) >= 7 and len(sets[0] & sets[2]) <= 2
    assert 0 in sets[2] and len(crf.features([], [])[0]) == 0


def test_held_out_accuracy_and_switches(llm_spark):
    docs = documents(llm_spark)
    model = crf.learn(docs)
    rows = crf.predict(docs, model).collect()
    assert all(r["lang"] == r["lang_pred"] and 0.5 < r["score"] <= 1 for r in rows)
    rng = random.Random(9)
    mixed = llm_spark.createDataFrame([(1, sentence("aa", rng, 20) + " " + sentence("bb", rng, 20), None, None, None)],
                                      DOC_SCHEMA)
    langs = crf.predict(mixed, model, words=True).first()["word_langs"]
    want = ["aa"] * 20 + ["bb"] * 20
    assert sum(a == b for a, b in zip(langs, want)) >= 37


def test_memo_limit_does_not_change_results(llm_spark, monkeypatch):
    model = crf.learn(documents(llm_spark, 60))
    chains = crf.chains("kato miru sch ungein eau que ment oi " * 4)
    a, _ = model.marginals(chains)
    monkeypatch.setattr(crf, "MEMO", 2)
    b, _ = crf.Model(model.languages, model.lexicons, model.weight, model.first, model.step).marginals(chains)
    assert np.allclose(a, b)


def test_held_out_labels_are_not_read(llm_spark):
    from pyspark.sql import functions as F
    from shoplens.llm.common import fold
    docs = documents(llm_spark, 60)
    changed = docs.withColumn("lang", F.when(fold("doc_id", 4) == 2, "zz").otherwise(F.col("lang")))
    assert crf.learn(changed).languages == ["aa", "bb", "cc"]


def test_rows(messy, no_docs, clashing):
    model = crf.learn(messy)
    rows = crf.predict(messy, model).collect()
    assert len(rows) == messy.count()
    for r in rows:
        has = any(c.isalpha() for c in r["text"] or "")
        assert (r["lang_pred"] == "und") == (not has) and 0 <= r["score"] <= 1
    assert crf.predict(no_docs, model).count() == 0
    nothing = crf.learn(no_docs)
    assert {r["lang_pred"] for r in crf.predict(messy, nothing).collect()} == {"und"}
    assert crf.predict(clashing, model).columns.count("lang_pred") == 1
