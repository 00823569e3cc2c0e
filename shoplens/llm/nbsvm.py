"""Quality classifier: Naive Bayes log-count ratios times n-gram indicators, with a linear hinge-loss model.

A text's features say which byte n-grams (1 to 4 bytes) and which runs of one
repeated word (2 to 4 times) occur in it, hashed to ``WIDTH`` places. Each
place is scaled by the log ratio of its smoothed counts in the two classes,
rows are brought to unit length, and the weights come from dual coordinate
descent. A logistic curve fitted on rows held back turns margins into scores
at the class balance of all labelled rows.

Learning reads a bounded sample: of each class the ``per_class`` labelled rows
of smallest hash, as one bitmap of ``WIDTH`` bits each, so the driver holds
2 x ``per_class`` x 8 KB at most. Every row is scored in its own task from its
whole text; there is no other shuffle.

Rows: a null text is empty and scored like one. Null labels are not learned
from; a document with several labels counts by their mean. If a class has no
labelled rows, every score is the share of the class that has (0.5 if there
is none). Very long texts are read block by block, whole; repeated rows get the
same score; rows of equal hash are sampled by id; an empty table stays empty.
Output columns replace input columns of the same name.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import byte_blocks, fold, hashed_sample, slices, text_input, with_fields

#: Places that features are hashed to.
WIDTH = 1 << 16
#: Odd multipliers of the n-gram hashes (fixed values: any odd 32-bit numbers do).
ODD = [2654435761, 2246822519, 3266489917, 668265263]
#: Places of "one word 2, 3, 4 times in a row".
RUNS = [WIDTH - 1, WIDTH - 2, WIDTH - 3]


def indicators(data: bytes) -> np.ndarray:
    """Bool per place: the features of a text (its UTF-8 bytes)."""
    seen = np.zeros(WIDTH, dtype=bool)
    for at in range(0, len(data), 1 << 20):
        points = np.frombuffer(data[at:at + (1 << 20) + 3], np.uint8).astype(np.uint32)
        code = points
        for n, odd in enumerate(ODD):
            if n:
                if len(points) <= n:
                    break
                code = (code[:-1] << np.uint32(8)) | points[n:]
            seen[(code * np.uint32(odd)) >> np.uint32(16)] = True
    seen[RUNS] = False
    last: list[bytes] = []
    for block in byte_blocks(data):
        words = last + block.split()
        same = np.fromiter((a == b for a, b in zip(words, words[1:])), bool, max(0, len(words) - 1))
        for place in RUNS:
            if not same.any():
                break
            seen[place] = True
            same = same[1:] & same[:-1]
        last = words[-3:]
    return seen


@dataclass(frozen=True)
class Model:
    scale: np.ndarray       # log-count ratio per place
    weight: np.ndarray      # of the scaled indicators
    bias: float
    slope: float            # of the logistic curve over margins
    offset: float

    def margin(self, seen: np.ndarray) -> float:
        at = np.flatnonzero(seen)
        x = self.scale[at]
        norm = float(np.sqrt(x @ x))
        return (float(self.weight[at] @ x) / norm if norm else 0.0) + self.bias

    def score(self, seen: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * self.margin(seen) + self.offset, -30, 30))))


def descend(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, cost: float = 1.0, rounds: int = 30,
            seed: int = 7) -> tuple[np.ndarray, float]:
    """Dual coordinate descent for the hinge loss: rows are (places, values), a constant 1 is the bias feature."""
    w, bias = np.zeros(WIDTH), 0.0
    alpha = np.zeros(len(rows))
    square = np.array([float(v @ v) + 1.0 for _, v in rows])
    order = np.random.default_rng(seed)
    for _ in range(rounds):
        most = 0.0
        for i in order.permutation(len(rows)):
            at, v = rows[i]
            slack = y[i] * (float(w[at] @ v) + bias) - 1.0
            new = min(max(alpha[i] - slack / square[i], 0.0), cost)
            step = (new - alpha[i]) * y[i]
            if step:
                w[at] += step * v
                bias += step
                alpha[i] = new
                most = max(most, abs(step))
        if most < 1e-3:
            break
    return w, bias


def calibrate(margins: np.ndarray, y: np.ndarray, weights: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the logistic curve of largest weighted likelihood (Newton steps, targets off 0 and 1)."""
    target = np.where(y > 0, 0.99, 0.01)
    a, b = 1.0, 0.0
    x = np.stack([margins, np.ones_like(margins)], axis=1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margins + b, -30, 30)))
        g = x.T @ (weights * (target - p))
        h = (x * (weights * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        step = np.linalg.solve(h, g)
        a, b = a + step[0], b + step[1]
        if np.abs(step).max() < 1e-6:
            break
    return float(a), float(b)


def fit(bits: list[bytes], labels: list[int], counts: tuple[int, int]) -> Model:
    """Model of the sampled rows; ``counts`` are the labelled rows of class 0 and 1 in the whole table."""
    y = np.where(np.array(labels, dtype=int) > 0, 1.0, -1.0)
    flat = Model(np.zeros(WIDTH), np.zeros(WIDTH), 0.0, 0.0, 0.0)
    if not len(y) or (y > 0).all() or (y < 0).all():
        share = counts[1] / sum(counts) if sum(counts) else 0.5
        return Model(flat.scale, flat.weight, 0.0, 0.0, float(np.log((share + 1e-6) / (1 - share + 1e-6))))
    places = [np.flatnonzero(np.unpackbits(np.frombuffer(b, np.uint8))).astype(np.int32) for b in bits]
    learn = np.arange(len(y)) % 5 != 0
    tally = {s: np.ones(WIDTH) for s in (1.0, -1.0)}
    for p, label, use in zip(places, y, learn):
        if use:
            tally[label][p] += 1
    scale = np.log(tally[1.0] / tally[1.0].sum()) - np.log(tally[-1.0] / tally[-1.0].sum())
    rows = []
    for p in places:
        v = scale[p]
        norm = np.sqrt(v @ v)
        rows.append((p, v / norm if norm else v))
    w, bias = descend([r for r, use in zip(rows, learn) if use], y[learn])
    rest = np.flatnonzero(~learn)
    margins = np.array([float(w[rows[i][0]] @ rows[i][1]) + bias for i in rest])
    weights = np.where(y[rest] > 0, counts[1] / max(1, (y[rest] > 0).sum()), counts[0] / max(1, (y[rest] < 0).sum()))
    slope, offset = calibrate(margins, y[rest], weights / weights.mean())
    return Model(scale, w, bias, slope, offset)


def learn(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality",
          folds: int = 5, held_out: int = 0, per_class: int = 2500) -> Model:
    """Fit on labelled rows whose id is not in the held-out fold, ``per_class`` of each class at most."""
    graded = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull() & (fold(key, folds) != held_out)) \
        .groupBy(key).agg((F.avg(label) >= 0.5).cast("int").alias("label"))
    counts = {r["label"]: r["n"] for r in graded.groupBy("label").agg(F.count("*").alias("n")).collect()}
    chosen = hashed_sample(graded, "label", key, per_class)                             # 2 x per_class rows at most
    texts = docs.select(key, F.col(f"`{text}`").cast("string").cast("binary").alias("data")) \
        .join(F.broadcast(chosen), key).select("label", "place", "data")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for pdf in slices(batch, "data"):
                yield pd.DataFrame({"label": pdf["label"], "place": pdf["place"], "bits": [
                    np.packbits(indicators(x or b"")).tobytes() for x in pdf["data"]]})

    got = texts.mapInPandas(run, "label int, place int, bits binary").dropDuplicates(["label", "place"]) \
        .orderBy("place", "label").collect()
    return fit([bytes(r["bits"]) for r in got], [r["label"] for r in got], (counts.get(0, 0), counts.get(1, 0)))


def score(docs: DataFrame, model: Model, text: str = "text", keep_text: bool = True) -> DataFrame:
    """Add ``score`` (probability of label 1) to every row, from its whole text."""
    src, names, column = text_input(docs, text, ["score"], keep_text)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for pdf in slices(batch, column):
                made = pdf[names].copy()
                made["score"] = [model.score(indicators((x or "").encode())) for x in pdf[column]]
                yield made

    return src.mapInPandas(run, with_fields(docs, names, {"score": T.DoubleType()}))
