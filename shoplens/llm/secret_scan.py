"""Secret scan: fixed patterns, and formats inferred from the credentials that they find.

Two passes read every whole text. The first notes the values that the base
patterns find (labelled credentials) and the other long runs of token
characters; of each kind a bounded sample (the ``sample`` distinct values of
smallest hash) is kept. The credentials of a kind make a prefix tree, whose
states are merged while their end and symbol frequencies are statistically
compatible (Hoeffding bound); states seen fewer than ``FEW`` times merge only
with states of their own depth, so that lengths and places survive where there
is little evidence. That gives one probabilistic automaton a kind, smoothed, so
that every run has a likelihood.

The second pass scores all candidates: every run of token characters of
``LEAST_RUN`` or more, and what stands of it beside a base span. One whose mean
log-likelihood a symbol reaches that of all but the least likely credentials
held back from the automaton is a secret too, if it is likelier by ``MARGIN`` a
symbol than under the pairs of symbols that the corpus' other runs have. An
automaton that cannot tell half of its own kind from those runs is dropped.

What passes a task are samples: of each batch the values of smallest hash.
Automata have at most as many states as the sample has prefixes. Nothing is
grouped by document and no candidate is stored.

Rows: a null text counts as empty; values and texts of any length are read
whole. Repeated rows count each in the result and once in the sample; equal
hashes go by value. Empty tables, or tables without credentials, give no
automata and no added spans. Output columns replace input columns of the same
name.
"""

from __future__ import annotations

import heapq
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shoplens.session import cut_lineage

from .common import hashed_sample, others, slices, text_input, with_fields

#: Kinds in the order of results, their patterns and least lengths.
KINDS = ["assign", "access", "hex", "format"]
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
                    re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LEAST = {"assign": 12, "access": 18, "hex": 16}
KEYWORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")

#: Runs that can hold an access key, a hex string or a candidate.
LEAST_RUN = 12
RUN = re.compile(r"[A-Za-z0-9+/_.=-]{%d,}" % LEAST_RUN)
#: Visits below which a state merges only with states of its own depth.
FEW = 30
REPLACEMENT = "[SECRET]"

Span = tuple[int, int, int, int, str]       # kind, start, end, start of the value, value


def scan(text: str) -> list[Span]:
    """Base spans, and candidates as kind 3, by start and kind; ``end`` is exclusive, in code points."""
    found: list[Span] = []
    low = text.encode().lower()
    if any(k in low for k in KEYWORDS):
        for m in ASSIGN.finditer(text):
            if len(m.group(2)) >= LEAST["assign"]:
                found.append((0, m.start(), m.end(), m.start(2), m.group(2)))
    for run in RUN.finditer(text):
        token, at = run.group(), run.start()
        if len(token) < min(LEAST["access"], LEAST["hex"]):
            continue
        inside = [(1, m) for m in ACCESS.finditer(token)] if "AKIA" in token else []
        inside += [(2, m) for m in HEX.finditer(token)]
        for kind, m in inside:
            if m.end() - m.start() >= LEAST[KINDS[kind]]:
                found.append((kind, at + m.start(), at + m.end(), at + m.start(), m.group()))
    base = sorted(found, key=lambda s: (s[1], s[0]))
    near = 0                                                # base spans before it end before the run
    for run in RUN.finditer(text):
        at, end = run.span()
        while near < len(base) and base[near][2] <= at:
            near += 1
        for span in base[near:]:
            if span[1] >= end:
                break
            found += _candidate(text, at, min(span[1], end))
            at = max(at, span[2])
        found += _candidate(text, at, end)
    return sorted(found, key=lambda s: (s[1], s[0]))


def _candidate(text: str, start: int, end: int) -> list[Span]:
    """A stretch of token characters as a candidate, without points and dashes at its ends, if it is long enough."""
    while start < end and text[start] in ".-":
        start += 1
    while start < end and text[end - 1] in ".-":
        end -= 1
    return [(3, start, end, start, text[start:end])] if end - start >= LEAST_RUN else []


def symbols(value: str) -> str:
    """The value as symbols of an automaton: digit, a-f, other lower, upper, and each sign for itself."""
    return "".join("0" if c.isdigit() else "a" if c in "abcdef" else "g" if c.islower() else "A" if c.isupper() else c
                   for c in value)


#: By how much (mean log-likelihood of a symbol) a credential must be likelier than an ordinary run.
MARGIN = 0.3
#: What each of the symbols (four classes and six signs) and the end gets of the visit that smooths a state.
SHARE = 1 / 11


@dataclass
class Automaton:
    """Deterministic probabilistic automaton: per state the visits, ends, and per symbol (next state, count)."""

    visits: list[int]
    ends: list[int]
    arcs: list[dict[str, tuple[int, int]]]
    least: float = -math.inf

    def score(self, word: str) -> float:
        """Mean log-likelihood of a symbol and the end. One visit of each state is spread evenly over all symbols and the
        end; a symbol that a state has never seen goes where its likeliest one does."""
        state, total = 0, 0.0
        for c in word:
            arcs, unit = self.arcs[state], self.visits[state] + 1
            arc = arcs.get(c)
            total += math.log(((arc[1] if arc else 0) + SHARE) / unit)
            if arc is None and arcs:
                arc = max(arcs.values(), key=lambda x: x[1])
            state = arc[0] if arc else state
        return (total + math.log((self.ends[state] + SHARE) / (self.visits[state] + 1))) / (len(word) + 1)


class Ordinary:
    """How likely a run is among the corpus' other runs: frequencies of its pairs of neighbouring symbols."""

    def __init__(self, runs: list[str]):
        self.pairs: Counter = Counter()
        self.firsts: Counter = Counter()
        for word in map(symbols, runs):
            for pair in zip("^" + word, word + "$"):
                self.pairs[pair] += 1
                self.firsts[pair[0]] += 1

    def score(self, word: str) -> float:
        """Mean log-likelihood of a symbol and the end, smoothed like an automaton's."""
        return sum(math.log((self.pairs[p] + SHARE) / (self.firsts[p[0]] + 1)) for p in zip("^" + word, word + "$")) \
            / (len(word) + 1)


def prefix_tree(words: list[str]) -> Automaton:
    tree = Automaton([0], [0], [{}])
    for word in words:
        state = 0
        tree.visits[0] += 1
        for c in word:
            arc = tree.arcs[state].get(c)
            if arc is None:
                arc = (len(tree.visits), 0)
                tree.visits.append(0)
                tree.ends.append(0)
                tree.arcs.append({})
            tree.arcs[state][c] = (arc[0], arc[1] + 1)
            state = arc[0]
            tree.visits[state] += 1
        tree.ends[state] += 1
    return tree


def merge_states(tree: Automaton, alpha: float = 0.05) -> Automaton:
    """Merge compatible states, shallow ones first: each frontier state joins the compatible settled state of nearest
    depth (of its own, if it has few visits), or settles itself."""
    bound = math.sqrt(0.5 * math.log(2 / alpha))
    visits, ends, arcs = tree.visits, tree.ends, tree.arcs

    def differ(k1: int, n1: int, k2: int, n2: int) -> bool:
        return abs(k1 / n1 - k2 / n2) > bound * (1 / math.sqrt(n1) + 1 / math.sqrt(n2))

    def compatible(a: int, b: int) -> bool:
        todo = [(a, b)]
        while todo:
            p, q = todo.pop()
            if differ(ends[p], visits[p], ends[q], visits[q]):
                return False
            for c in arcs[p].keys() | arcs[q].keys():
                x, y = arcs[p].get(c), arcs[q].get(c)
                if differ(x[1] if x else 0, visits[p], y[1] if y else 0, visits[q]):
                    return False
                if x and y:
                    todo.append((x[0], y[0]))
        return True

    def fold(a: int, b: int) -> None:
        todo = [(a, b)]
        while todo:
            p, q = todo.pop()
            visits[p] += visits[q]
            ends[p] += ends[q]
            for c, (to, n) in arcs[q].items():
                own = arcs[p].get(c)
                arcs[p][c] = (own[0], own[1] + n) if own else (to, n)
                if own:
                    todo.append((own[0], to))

    depth = {0: 0}                                          # of settled states
    frontier = [(1, 0, c) for c in sorted(arcs[0])]
    while frontier:
        level, parent, c = heapq.heappop(frontier)
        state, n = arcs[parent][c]
        if state in depth:
            continue
        joins = next((s for s in sorted(depth, key=lambda s: (abs(depth[s] - level), depth[s], s))
                      if (depth[s] == level or visits[state] >= FEW) and compatible(s, state)), None)
        if joins is None:
            depth[state] = level
            grown = state
        else:
            arcs[parent][c] = (joins, n)
            fold(joins, state)
            grown = joins
        for x in sorted(arcs[grown]):
            if arcs[grown][x][0] not in depth:
                heapq.heappush(frontier, (depth[grown] + 1, grown, x))
    settled = list(depth)
    number = {s: i for i, s in enumerate(settled)}
    return Automaton([visits[s] for s in settled], [ends[s] for s in settled],
                     [{c: (number[to], n) for c, (to, n) in arcs[s].items()} for s in settled])


def infer(values: list[str], refuse: float = 0.05, ordinary: Ordinary | None = None) -> Automaton | None:
    """Automaton of the credentials at even places, with the score that all but ``refuse`` of the rest reach; None if
    there are too few, or if over half of the rest are no likelier than as ordinary runs."""
    words = [symbols(v) for v in values]
    learn, held = words[::2], words[1::2]
    if len(learn) < 20:
        return None
    made = merge_states(prefix_tree(learn))
    scores = sorted(made.score(w) for w in held)
    made.least = scores[int(refuse * len(scores))]
    if ordinary is not None:
        told = sum(made.score(w) >= ordinary.score(w) + MARGIN for w in held)
        if 2 * told < len(held):
            return None
    return made


_ITEM = [T.StructField("kind", T.IntegerType()), T.StructField("start", T.IntegerType()),
         T.StructField("end", T.IntegerType()), T.StructField("at", T.IntegerType()),
         T.StructField("value", T.StringType())]


def labelled(docs: DataFrame, text: str = "text", sample: int = 2000) -> DataFrame:
    """``(kind, value)``: of each batch of texts and each kind the ``sample`` distinct values of smallest hash (kind 3:
    runs that no base pattern has found)."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for pdf in slices(batch, text):
                kinds: dict[int, set[str]] = {}
                for x in pdf[text]:
                    for span in scan(x or ""):
                        kinds.setdefault(span[0], set()).add(span[4])
                rows = [(kind, v) for kind, values in kinds.items() for v in heapq.nsmallest(
                    sample, values, key=lambda v: (xxhash.xxh64_intdigest(v.encode(), 42), v))]
                yield pd.DataFrame(rows, columns=["kind", "value"])

    return docs.select(F.col(f"`{text}`").cast("string").alias(text)).mapInPandas(run, "kind int, value string").distinct()


Models = tuple[list[Automaton], Ordinary]


def automata(docs: DataFrame, text: str = "text", sample: int = 2000) -> Models:
    """One automaton per kind that has enough credentials, and the model of ordinary runs; ``sample`` bounds what is
    learned from, per kind."""
    rows = hashed_sample(cut_lineage(labelled(docs, text, sample)), "kind", "value", sample).orderBy("kind", "place").collect()
    values = {k: [r["value"] for r in rows if r["kind"] == k] for k in range(4)}
    ordinary = Ordinary(values[3])
    made = [infer(values[k], ordinary=ordinary) for k in range(3)]
    return [m for m in made if m is not None], ordinary


def clean(body: str | None, spans: list[dict]) -> str | None:
    """The text with the values of the spans replaced (values that overlap are replaced as one)."""
    if body is None or not spans:
        return body
    pieces, at = [], 0
    for a, b in sorted((s["at"], s["end"]) for s in spans):
        if b <= at:
            continue
        if a >= at:
            pieces += [body[at:a], REPLACEMENT]
        at = b
    return "".join(pieces) + body[at:]


def find(docs: DataFrame, models: Models, text: str = "text", keep_text: bool = True,
         redacted: bool = False) -> DataFrame:
    """Add ``spans`` to every row, from its whole text: base spans and the candidates that the automata accept, with each
    span's ``score``; on demand the values of all of them are replaced in the text."""
    src, names, column = text_input(docs, text, ["spans"], keep_text)
    item = T.ArrayType(T.StructType([*_ITEM, T.StructField("score", T.DoubleType())]))
    fields = [f.name for f in item.elementType.fields]

    formats, ordinary = models

    def judged(body: str) -> list[dict]:
        kept = []
        for s in scan(body):
            if s[0] == 3 and not formats:
                continue
            word = symbols(s[4])
            scores = [(m.score(word), m.least) for m in formats]
            usual = ordinary.score(word) + MARGIN if s[0] == 3 else 0.0
            if s[0] < 3 or any(score >= least and score >= usual for score, least in scores):
                kept.append(dict(zip(fields, (*s, max((score for score, _ in scores), default=None)))))
        return kept

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for pdf in slices(batch, column):
                made = pdf[names].copy()
                made["spans"] = [judged(x or "") for x in pdf[column]]
                if redacted:
                    made[column] = [clean(x, s) for x, s in zip(pdf[column], made["spans"])]
                yield made

    return src.mapInPandas(run, with_fields(docs, names, {"spans": item}))


def scan_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", sample: int = 2000) -> DataFrame:
    """``(key, spans)`` per row; spans are structs of kind number, start, end, start of the value, value and score."""
    return find(docs.select(key, text), automata(docs, text, sample), text, keep_text=False)


def redact(docs: DataFrame, text: str = "text", sample: int = 2000) -> DataFrame:
    """All rows and columns of ``docs`` with the values of all secrets replaced in the text, and ``spans``. The texts are
    read twice, so ``docs`` should be a stored table."""
    return find(docs.select(*others(docs, ["spans"])), automata(docs, text, sample), text, redacted=True)


def joined(spans, kinds: int):
    """``kind:start:end`` of the spans below a kind number, comma-joined."""
    names = F.lit(KINDS)
    some = F.filter(spans, lambda s: s["kind"] < kinds)
    return F.array_join(F.transform(some, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")
