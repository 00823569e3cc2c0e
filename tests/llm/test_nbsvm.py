"""Held-out accuracy of the classifier, its parts, and odd rows."""

import numpy as np

from shoplens.llm import nbsvm
from shoplens.llm.common import fold_of
from .test_quality_rules import junk


def test_indicators_see_the_whole_text(monkeypatch):
    a = nbsvm.indicators(b"x" * (1 << 20) + b"qzj")
    assert a.sum() > nbsvm.indicators(b"x" * (1 << 20)).sum()
    runs = nbsvm.indicators(b"one two two two three")[nbsvm.RUNS].tolist()
    assert runs == [True, True, False]
    assert not nbsvm.indicators(b"").any()


def test_coordinate_descent_separates():
    rng = np.random.default_rng(0)
    rows, y = [], []
    for i in range(200):
        sign = 1 if i % 2 else -1
        at = np.array([10 if sign > 0 else 20, *rng.choice(np.arange(100, 200), 5, replace=False)])
        rows.append((at, np.ones(len(at)) / np.sqrt(len(at))))
        y.append(sign)
    w, bias = nbsvm.descend(rows, np.array(y, dtype=float))
    margins = [float(w[a] @ v) + bias for a, v in rows]
    assert all((m > 0) == (s > 0) for m, s in zip(margins, y))


def test_calibration_is_monotone_and_centred():
    slope, offset = nbsvm.calibrate(np.array([-2.0, -1, 1, 2]), np.array([-1.0, -1, 1, 1]), np.ones(4))
    assert slope > 0 and abs(offset) < 1e-6


def test_held_out_accuracy(llm_spark):
    docs, labels = junk(llm_spark, 400)
    model = nbsvm.learn(docs, labels)
    rows = nbsvm.score(docs, model).collect()
    held = [r for r in rows if fold_of(r["doc_id"], 5) == 0]
    assert held and all(0 <= r["score"] <= 1 for r in rows)
    right = [(r["score"] >= 0.5) == (r["doc_id"] % 6 >= 2) for r in held]
    assert sum(right) >= 0.97 * len(right)


def test_labels_of_the_held_out_fold_are_not_read(llm_spark):
    docs, labels = junk(llm_spark, 200)
    flipped = labels.rdd.map(lambda r: (r[0], 1 - r[1] if fold_of(r[0], 5) == 0 else r[1])).toDF(["doc_id", "quality"])
    a, b = nbsvm.learn(docs, labels), nbsvm.learn(docs, flipped)
    assert np.array_equal(a.weight, b.weight) and a.slope == b.slope


def test_rows(messy, no_docs, clashing, few_labels):
    model = nbsvm.learn(messy, few_labels)
    rows = nbsvm.score(messy, model).collect()
    assert len(rows) == messy.count() and all(0 <= r["score"] <= 1 for r in rows)
    empty = {r["score"] for r in rows if not r["text"]}
    assert len(empty) == 1
    assert nbsvm.score(no_docs, model).count() == 0
    one = nbsvm.learn(messy, few_labels.where("quality = 1"))
    assert all(r["score"] > 0.99 for r in nbsvm.score(messy, one).collect())
    none = nbsvm.learn(messy, few_labels.where("false"))
    assert all(abs(r["score"] - 0.5) < 1e-3 for r in nbsvm.score(messy, none).collect())
    assert nbsvm.score(clashing, model).columns.count("score") == 1
