"""Language of words and texts by a linear-chain conditional random field.

A word's features are its first and last 1 to 4 letters, its character
n-grams and the learned lexicons that have it; learned transitions link
neighbouring words, so that a text may switch its language. Chains are lines,
cut after ``CHAIN`` words. Forward-backward over all chains of a batch at once
gives each word's distribution over the languages; a text's language is the
one of largest mean over its words with a letter.

Learning reads a bounded sample: of each language the ``per_language``
labelled documents of smallest hash, and of each of these the ``chains``
chains of smallest hash. Documents carry one label, so chains are also spliced
from several languages for the transitions to learn switches from. Every text
is labelled whole, in its own task; nothing is shuffled.

Rows: a null text, or one without a letter, is ``und`` with score 0; null
labels are not learned from; without labelled rows everything is ``und``.
Repeated rows are labelled each. Languages tie in favour of the first by name.
Output columns replace input columns of the same name.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WORD, fold, hashed_sample, slices, text_input, with_fields

#: Words of a chain at most.
CHAIN = 64
#: Places that features are hashed to.
WIDTH = 1 << 16
#: Multipliers of the feature hash (fixed values: any odd numbers of that size do).
PRIME, ODD = 1_000_003, 0x9E3779B97F4A7C15
#: Distinct words a worker remembers before it starts anew.
MEMO = 300_000

_WORDS = re.compile(WORD)
_LETTER = regex.compile(r"\p{L}")
_EDGE = re.compile(r"^[\W\d_]+|[\W\d_]+$")


def bare(word: str) -> str:
    """The word in lower case without what is not a letter at its ends."""
    return _EDGE.sub("", word).lower()


def features(words: list[str], lexicons: list[frozenset[str]]) -> tuple[np.ndarray, np.ndarray]:
    """(number of the word, hashed place) of each feature of bare words, computed over all words at once.

    With its ends marked, a word's n-grams of 1 to 3 letters hold its shorter affixes too; those of 3 and 4 letters
    are its first and last n-grams of 4 and 5."""
    points = np.frombuffer("".join(f"^{w}$" for w in words).encode("utf-32-le"), "<u4").astype(np.uint64)
    size = np.fromiter(map(len, words), np.int64, len(words)) + 2
    owner = np.repeat(np.arange(len(words)), size)
    at = np.arange(len(points)) - np.repeat(np.cumsum(size) - size, size)
    left = size[owner] - at
    owners, places = [], []
    code = np.zeros(len(points), dtype=np.uint64)
    for n in range(1, 6):
        code = code[:len(points) - n + 1] * np.uint64(PRIME) + points[n - 1:]
        here = left[:len(code)] >= n
        if n > 3:
            here &= (at[:len(code)] == 0) | (left[:len(code)] == n)
        owners.append(owner[:len(code)][here])
        places.append(((code[here] + np.uint64(n)) * np.uint64(ODD)) >> np.uint64(48))
    for k, known in enumerate(lexicons):
        has = np.flatnonzero(np.fromiter((w in known for w in words), bool, len(words)))
        owners.append(has)
        places.append(np.full(len(has), k, dtype=np.uint64))
    return np.concatenate(owners), np.concatenate(places).astype(np.int64)


def chains(text: str) -> list[list[str]]:
    """The words of a text, by line, at most ``CHAIN`` in a row."""
    out = []
    for line in text.split("\n"):
        words = _WORDS.findall(line)
        out += [words[i:i + CHAIN] for i in range(0, len(words), CHAIN)]
    return out


def forward_backward(energy: np.ndarray, inside: np.ndarray, first: np.ndarray, step: np.ndarray):
    """Marginals of padded chains (n, length, k), expected transitions (k, k), and the log of the partition functions.

    ``inside`` marks the words that there are; ``first`` and ``step`` are the start and transition potentials."""
    n, length, k = energy.shape
    top = energy.max(axis=2, keepdims=True)
    local = np.where(inside[:, :, None], np.exp(energy - top), 1.0)
    move = np.exp(step)
    alpha, beta = np.empty_like(local), np.empty_like(local)
    scale = np.ones((n, length))
    a = local[:, 0] * np.exp(first)
    scale[:, 0] = a.sum(axis=1)
    alpha[:, 0] = a / scale[:, :1]
    for t in range(1, length):
        a = (alpha[:, t - 1] @ move) * local[:, t]
        total = a.sum(axis=1)
        on = inside[:, t]
        scale[:, t] = np.where(on, total, 1.0)
        alpha[:, t] = np.where(on[:, None], a / total[:, None], alpha[:, t - 1])
    beta[:, -1] = 1.0
    moves = np.zeros((k, k))
    for t in range(length - 2, -1, -1):
        on = inside[:, t + 1]
        ahead = local[:, t + 1] * beta[:, t + 1] / scale[:, t + 1:t + 2]
        beta[:, t] = np.where(on[:, None], ahead @ move.T, beta[:, t + 1])
        if on.any():
            moves += move * (alpha[on, t].T @ ahead[on])
    gamma = alpha * beta
    gamma /= gamma.sum(axis=2, keepdims=True)
    return gamma, moves, np.log(scale).sum() + (top[:, :, 0] * inside).sum()


@dataclass
class Model:
    languages: list[str]
    lexicons: list[frozenset[str]]
    weight: np.ndarray                  # places x languages
    first: np.ndarray
    step: np.ndarray
    memo: dict[str, int] = field(default_factory=dict, repr=False)
    rows: np.ndarray | None = field(default=None, repr=False)          # energies of the remembered words
    letters: np.ndarray | None = field(default=None, repr=False)       # whether they have a letter

    def remember(self, words: list[str]) -> np.ndarray:
        """Row numbers of words in ``rows``, for which new words are added."""
        new = sorted(set(words).difference(self.memo))
        if self.rows is None or len(self.memo) + len(new) > MEMO:
            new = sorted(set(words))
            self.memo.clear()
            self.rows, self.letters = np.zeros((0, len(self.languages))), np.zeros(0, dtype=bool)
        if new:
            known = [bare(w) for w in new]
            self.rows = np.concatenate([self.rows, energies(known, self.lexicons, self.weight)])
            self.letters = np.concatenate([self.letters, np.fromiter((any(map(str.isalpha, w)) for w in known), bool, len(known))])
            self.memo.update(zip(new, range(len(self.memo), len(self.memo) + len(new))))
        return np.fromiter(map(self.memo.__getitem__, words), np.int64, len(words))

    def marginals(self, chains_: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """Distribution of every word of the chains, one after the other, and which words have a letter."""
        size = np.array([len(r) for r in chains_])
        at = self.remember([w for r in chains_ for w in r])
        inside = np.arange(size.max()) < size[:, None]
        energy = np.zeros((*inside.shape, len(self.languages)))
        energy[inside] = self.rows[at]
        return forward_backward(energy, inside, self.first, self.step)[0][inside], self.letters[at]


def energies(known: list[str], lexicons: list[frozenset[str]], weight: np.ndarray) -> np.ndarray:
    """Sum of a bare word's feature weights, per language; a word without letters has none."""
    owner, places = features(known, lexicons)
    keep = np.fromiter(map(bool, known), bool, len(known))[owner]
    owner, places = owner[keep], places[keep]
    return np.stack([np.bincount(owner, weight[places, j], len(known)) for j in range(weight.shape[1])], axis=1)


def _batches(data: list[tuple[list[str], list[int]]], size: int, order: np.random.Generator):
    for at in np.array_split(order.permutation(len(data)), max(1, len(data) // size)):
        yield [data[i] for i in at]


def train(data: list[tuple[list[str], list[int]]], languages: list[str], lexicons: list[frozenset[str]],
          rounds: int = 4, rate: float = 0.3, ridge: float = 1e-6) -> Model:
    """Weights of largest conditional likelihood by adaptive gradient steps over batches of chains (words without letters share a few features)."""
    k = len(languages)
    w, first, step = np.zeros((WIDTH, k)), np.zeros(k), np.zeros((k, k))
    past = [np.full_like(x, 1e-4) for x in (w, first, step)]
    order = np.random.default_rng(11)
    for _ in range(rounds):
        for batch in _batches(data, 64, order):
            words = sorted({x for row, _ in batch for x in row})
            number = {x: i for i, x in enumerate(words)}
            owner, places = features([bare(x) for x in words], lexicons)
            by_word = np.stack([np.bincount(owner, w[places, j], len(words)) for j in range(k)], axis=1)
            size = np.array([len(r) for r, _ in batch])
            inside = np.arange(size.max()) < size[:, None]
            at = np.array([number[x] for r, _ in batch for x in r])
            truth = np.array([y for _, ys in batch for y in ys])
            energy = np.zeros((*inside.shape, k))
            energy[inside] = by_word[at]
            gamma, moves, _ = forward_backward(energy, inside, first, step)
            miss = np.eye(k)[truth] - gamma[inside]
            pull = np.stack([np.bincount(at, miss[:, j], len(words)) for j in range(k)], axis=1)
            grad_w = np.stack([np.bincount(places, pull[owner, j], WIDTH) for j in range(k)], axis=1)
            starts = np.concatenate([[0], np.cumsum(size)[:-1]])
            grad_first = miss[starts].sum(axis=0)
            inner = np.ones(len(truth), dtype=bool)
            inner[starts] = False
            now = np.flatnonzero(inner)
            grad_step = np.bincount(truth[now - 1] * k + truth[now], minlength=k * k).reshape(k, k) - moves
            for x, g, h in zip((w, first, step), (grad_w, grad_first, grad_step), past):
                g = g / len(batch) - ridge * x
                h += g * g
                x += rate * g / np.sqrt(h)
    return Model(languages, lexicons, w, first, step)


def spliced(data: list[tuple[list[str], int]], seed: int = 5) -> list[tuple[list[str], list[int]]]:
    """Each chain as it is, and as many chains again made of runs of 6 to 24 words of changing origin."""
    order = np.random.default_rng(seed)
    out = [(words, [y] * len(words)) for words, y in data]
    for _ in range(len(data)):
        words: list[str] = []
        labels: list[int] = []
        while len(words) < CHAIN - 24:
            row, y = data[order.integers(len(data))]
            n = int(order.integers(6, 25))
            at = int(order.integers(max(1, len(row) - n + 1)))
            words += row[at:at + n]
            labels += [y] * len(row[at:at + n])
        out.append((words, labels))
    return out


def learn(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", folds: int = 4,
          held_out: int = 2, per_language: int = 250, per_document: int = 6, lexicon: int = 2000) -> Model:
    """Fit on labelled rows outside the held-out fold; see the module for the sample's bounds."""
    labelled = docs.where(F.col(lang).isNotNull() & F.col(key).isNotNull() & (fold(key, folds) != held_out))
    chosen = F.broadcast(hashed_sample(labelled.select(key, lang), lang, key, per_language))    # few rows a language
    texts = labelled.select(key, F.col(f"`{text}`").cast("string").alias("body")) \
        .join(chosen.select(key, F.col(lang).alias("lang"), "place"), key)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for pdf in slices(batch, "body"):
                rows = []
                for y, x in zip(pdf["lang"], pdf["body"]):
                    some = sorted(chains(x or ""), key=lambda r: zlib.crc32(" ".join(r).encode()))[:per_document]
                    rows += [(y, " ".join(r)) for r in some]
                yield pd.DataFrame(rows, columns=["lang", "words"])

    got = texts.select("lang", "body").mapInPandas(run, "lang string, words string").distinct() \
        .orderBy("lang", "words").collect()
    languages = sorted({r["lang"] for r in got})
    data = [(r["words"].split(" "), languages.index(r["lang"])) for r in got]
    lexicons = []
    for k in range(len(languages)):
        counts = Counter(bare(x) for words, y in data if y == k for x in words)
        lexicons.append(frozenset(x for x, n in counts.most_common(lexicon) if x and n > 2))
    if not data:
        return Model([], [], np.zeros((WIDTH, 0)), np.zeros(0), np.zeros((0, 0)))
    return train(spliced(data), languages, lexicons)


def predict(docs: DataFrame, model: Model, text: str = "text", words: bool = False,
            keep_text: bool = True) -> DataFrame:
    """Add ``lang_pred`` and ``score`` to every row, and on demand ``word_langs``, the language of each word."""
    made = {"lang_pred": T.StringType(), "score": T.DoubleType()}
    if words:
        made["word_langs"] = T.ArrayType(T.StringType())
    src, names, column = text_input(docs, text, list(made), keep_text)
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)            # WIDTH x languages numbers and the lexicons

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        learned = shared.value
        for batch in batches:
            for pdf in slices(batch, column):
                result = pdf[names].copy()
                rows, owner = [], []
                for i, x in enumerate(pdf[column]):
                    own = chains(x) if x and learned.languages and _LETTER.search(x) else []
                    rows += own
                    owner += [i] * len(own)
                langs, scores = ["und"] * len(pdf), [0.0] * len(pdf)
                labels: list[list[str]] = [[] for _ in range(len(pdf))]
                if rows:
                    gamma, letters = learned.marginals(rows)
                    doc = np.repeat(owner, [len(r) for r in rows])
                    n = np.bincount(doc, letters, len(pdf))
                    mean = np.stack([np.bincount(doc, gamma[:, j] * letters, len(pdf))
                                     for j in range(gamma.shape[1])], axis=1) / np.maximum(n, 1)[:, None]
                    for i in np.flatnonzero(n):
                        best = int(mean[i].argmax())
                        langs[i], scores[i] = learned.languages[best], float(min(1.0, mean[i, best]))
                    if words:
                        for i, best in zip(doc, gamma.argmax(axis=1)):
                            labels[i].append(learned.languages[best])
                result["lang_pred"], result["score"] = langs, scores
                if words:
                    result["word_langs"] = labels
                yield result

    return src.mapInPandas(run, with_fields(docs, names, made))
