"""Quality rules: text statistics and a learned decision list over them, in DataFrame functions only.

``statistics`` computes counts of every whole text inside its own row (no
shuffle). ``learn`` covers the low-quality labelled rows one rule after the
other: a rule grows by the threshold test of largest information gain, read
from one small histogram per step, is pruned on rows held back, and ends the
list once it is not precise enough. Histograms have (features x edges) rows
whatever the input, so that is all that ever reaches the driver. ``verdict``
turns the rules into one ordered conditional expression.

Rows: a null text has no words (all counts 0). Null labels are left out, and
a document with several labels counts by their mean. Repeated rows count each.
Very long texts are counted whole. Of equally good tests the first by feature
and edge is taken.
Empty tables give no rules (everything but the base rule's failures is kept).
Output columns replace input columns of the same name.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shoplens.session import cut_lineage

from .common import SPACE, fold, others, words_of

#: Words in a window whose repetition counts.
WINDOW = 8
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
MORE_COUNTS = ["n_upper", "n_marks", "n_distinct_words"]
#: What rules test: whole numbers (thousandths of a share, hundredths of a mean), so thresholds are exact.
FEATURES = ["words", "word_length", "symbols", "dup_lines", "repeats", "upper", "marks", "distinct"]


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value`` with the value computed once (a lambda variable, where a column would be inlined)."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _windows(words: Column) -> Column:
    """Hash of each window of 8 words by doubling: of 2 words, of 4, of 8 (one array pass each)."""
    def doubled(hashes: Column, step: int) -> Column:
        return let(hashes, lambda h: F.transform(h, lambda x, i: F.xxhash64(x, F.get(h, i + step))))

    hashes = F.transform(words, lambda w: F.xxhash64(w))
    for step in (1, 2, 4):
        hashes = doubled(hashes, step)
    return F.slice(hashes, F.lit(1), F.greatest(F.size(words) - (WINDOW - 1), F.lit(0)))


def _covered(windows: Column) -> Column:
    """Words inside windows whose hash occurs again: sort (hash, place), keep equal neighbours, measure the union."""
    def places(s: Column) -> Column:
        twice = F.filter(s, lambda e, i: (F.get(s, i - 1)["h"] == e["h"]) | (F.get(s, i + 1)["h"] == e["h"]))
        return F.sort_array(F.transform(twice, lambda e: e["at"]))

    def union(p: Column) -> Column:
        steps = F.transform(p, lambda v, i: F.least(F.lit(WINDOW), F.coalesce(F.get(p, i + 1) - v, F.lit(WINDOW))))
        return F.aggregate(steps, F.lit(0).cast("long"), lambda a, x: a + x)

    pairs = F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("at")))
    return let(F.sort_array(pairs), lambda s: let(places(s), union))


def _repeat_words(words: Column) -> Column:
    def counted(h: Column) -> Column:
        return F.when(F.size(F.array_distinct(h)) < F.size(h), _covered(h)).otherwise(F.lit(0).cast("long"))

    return F.when(F.size(words) > WINDOW, let(_windows(words), counted)).otherwise(F.lit(0).cast("long"))


def statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add the counts of ``COUNTS`` and ``MORE_COUNTS`` (long)."""
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    lines = F.filter(F.split(body, "\n", -1), lambda x: F.length(F.regexp_replace(x, SPACE + "+", "")) > 0)
    split = docs.select(*others(docs, [*COUNTS, *MORE_COUNTS, "__words", "__lines"]), words_of(docs[f"`{text}`"])
                        .alias("__words"), lines.alias("__lines"))
    w = F.col("__words")
    made = {
        "n_words": F.size(w), "word_chars": F.length(F.array_join(w, "")),
        "n_symbols": F.regexp_count(body, F.lit(r"[#*$%&|<>]")),
        "n_dup_lines": F.size("__lines") - F.size(F.array_distinct("__lines")),
        "n_repeat_words": _repeat_words(w),
        "n_upper": F.regexp_count(body, F.lit(r"\p{Lu}")), "n_marks": F.regexp_count(body, F.lit(r"[!?;:|]")),
        "n_distinct_words": F.size(F.array_distinct(w)),
    }
    return split.withColumns({k: v.cast("long") for k, v in made.items()}).drop("__words", "__lines")


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def features() -> dict[str, Column]:
    """The tested quantities as longs, from the counts."""
    words, chars = F.greatest("n_words", F.lit(1)), F.greatest("word_chars", F.lit(1))
    share = {"word_length": F.floor(100 * F.col("word_chars") / words), "words": F.col("n_words"),
             "dup_lines": F.col("n_dup_lines")}
    for name, top, bottom in (("symbols", "n_symbols", chars), ("repeats", "n_repeat_words", words),
                              ("upper", "n_upper", chars), ("marks", "n_marks", chars),
                              ("distinct", "n_distinct_words", words)):
        share[name] = F.floor(1000 * F.col(top) / bottom)
    return {k: share[k].cast("long") for k in FEATURES}


@dataclass(frozen=True)
class Test:
    feature: str
    above: bool
    edge: int

    def column(self) -> Column:
        value = features()[self.feature]
        return value > self.edge if self.above else value <= self.edge

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.edge}"


Rule = tuple[Test, ...]


def _holds(rule: Rule) -> Column:
    out = F.lit(True)
    for t in rule:
        out = out & t.column()
    return out


def _gain(p0: int, n0: int, p1: int, n1: int) -> float:
    """Information gain of a test on the covered low-quality rows."""
    return p1 * (math.log2(p1 / (p1 + n1)) - math.log2(p0 / (p0 + n0))) if p1 else 0.0


def _between(values: list[int] | None) -> list[int]:
    """Edges halfway between neighbouring quantiles: a rule keeps its distance from both sides."""
    known = sorted(set(values or []))
    return sorted({(a + b) // 2 for a, b in zip(known, known[1:])})


def _histogram(rows: DataFrame, edges: dict[str, list[int]]) -> dict[str, list[tuple[int, int]]]:
    """Low and high rows per feature and bin (bin k: value in (edge k-1, edge k])."""
    def bin_of(value: Column, cuts: list[int]) -> Column:
        return F.size(F.filter(F.lit(cuts), lambda e: e < value))

    value = features()
    cells = [F.struct(F.lit(k).alias("f"), bin_of(value[f], edges[f]).alias("b"))
             for k, f in enumerate(FEATURES) if edges[f]]
    counts = {f: [(0, 0)] * (len(edges[f]) + 1) for f in FEATURES}
    if not cells:
        return counts
    got = rows.select("low", F.explode(F.array(*cells)).alias("c")).groupBy("c.f", "c.b") \
        .agg(F.sum("low").alias("low"), F.sum(1 - F.col("low")).alias("high")).collect()
    for r in got:
        counts[FEATURES[r["f"]]][r["b"]] = (r["low"], r["high"])
    return counts


def _best_test(rows: DataFrame, edges: dict[str, list[int]]) -> tuple[float, Test | None, int, int]:
    """The test of largest gain (ties: first feature, lowest edge), with the rows it leaves."""
    best: tuple[float, Test | None, int, int] = (0.0, None, 0, 0)
    for f, bins in _histogram(rows, edges).items():
        p0, n0 = sum(p for p, _ in bins), sum(n for _, n in bins)
        if not p0:
            continue
        p = n = 0
        for k, edge in enumerate(edges[f]):
            p, n = p + bins[k][0], n + bins[k][1]
            for above, p1, n1 in ((False, p, n), (True, p0 - p, n0 - n)):
                gain = _gain(p0, n0, p1, n1)
                if gain > best[0] + 1e-9:
                    best = (gain, Test(f, above, edge), p1, n1)
    return best


def _pruned(rule: Rule, held: DataFrame) -> tuple[Rule, int, int]:
    """The prefix of the rule that is worth most, (low - high) / (low + high), on the rows held back."""
    sums = []
    for k in range(1, len(rule) + 1):
        hit = _holds(rule[:k]).cast("long")
        sums += [F.sum(hit * F.col("low")).alias(f"p{k}"), F.sum(hit * (1 - F.col("low"))).alias(f"n{k}")]
    got = held.agg(*sums).first()
    best, worth = (rule, 0, 0), -2.0
    for k in range(1, len(rule) + 1):
        p, n = got[f"p{k}"] or 0, got[f"n{k}"] or 0
        value = (p - n) / (p + n) if p + n else -1.0
        if value > worth:
            best, worth = (rule[:k], p, n), value
    return best


def learn(stats: DataFrame, labels: DataFrame, key: str = "doc_id", label: str = "quality", max_rules: int = 8,
          max_tests: int = 3, edges_per_feature: int = 48, min_precision: float = 0.95,
          min_support: int = 5) -> list[Rule]:
    """Rules for low quality (label 0), in order, from all labelled rows of ``stats``.

    A rule is taken if at least ``min_precision`` of the held-back rows that it covers, and at least
    ``min_support`` of them, are of low quality. A third of the rows is held back, by id."""
    graded = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(key) \
        .agg((F.avg(label) < 0.5).cast("long").alias("low"))
    rows = cut_lineage(stats.select(key, *COUNTS, *MORE_COUNTS).where(~base_failed()).join(graded, key))
    value = features()
    steps = [k / edges_per_feature for k in range(1, edges_per_feature)]
    cuts = rows.agg(*[F.percentile_approx(value[f], F.lit(steps), F.lit(10_000)).alias(f) for f in FEATURES]).first()
    edges = {f: _between(cuts[f]) for f in FEATURES}
    rules: list[Rule] = []
    left = rows
    while len(rules) < max_rules:
        grow, held = left.where(fold(key, 3) != 0), left.where(fold(key, 3) == 0)
        rule: Rule = ()
        while len(rule) < max_tests:
            gain, test, _, high = _best_test(grow.where(_holds(rule)), edges)
            if test is None:
                break
            rule += (test,)
            if not high:
                break
        if not rule:
            break
        rule, p, n = _pruned(rule, held)
        if p < min_support or p < min_precision * (p + n):
            break
        rules.append(rule)
        left = left.where(~_holds(rule))
    return rules


def verdict(rules: list[Rule]) -> Column:
    """``base``, the first rule that holds (as text), or ``keep``."""
    out = F.when(base_failed(), F.lit("base"))
    for rule in rules:
        out = out.when(_holds(rule), F.lit(" and ".join(map(str, rule))))
    return out.otherwise(F.lit("keep"))


def judge(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text",
          payload: bool = False) -> DataFrame:
    """Counts and verdict of every document; with ``payload`` all its columns, else only its key."""
    stats = statistics(docs if payload else docs.select(key, text), text)
    stats = cut_lineage(stats if payload else stats.drop(text))     # read by the learner and by the verdict
    rules = learn(stats, labels, key)
    return stats.withColumn("base_failed", base_failed()).withColumn("verdict", verdict(rules)) \
        .withColumn("kept", F.col("verdict") == "keep")
