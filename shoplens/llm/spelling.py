"""Spelling variants: words one edit apart, found by scanning sorted word lists with a banded edit matrix.

Words are sorted, and each is matched against the sorted list with rows of
the edit matrix that are three cells wide: a row belongs to a prefix, so it
is worked out once for a run of adjacent words whose longest common prefix
(LCP) covers it, and a run whose prefix is more than one edit away from the
word is skipped whole. The rows of many words go forward together in numpy.

What is dealt out over the cluster are groups of words that may meet. Take
two words at one edit, the shorter of ``m`` characters, and the place of
their first difference (0 to ``m``). Cut these places in two: with the place
in the first half, the words agree behind it; with the place in the second,
before it. So the pair meets in just one group, under ``m``, the half, and
the text outside it, and only what stands inside is scanned there. A group
of over ``meet`` words is dealt out again by halves of its half, until one
place is left: then at most two characters are free, and the group is as
small as the alphabet makes it. No pair is lost, none is found twice.

Per batch a word leaves the scan as one row (its near words counted, the best
one kept), so words with many near words do not spread. Forms are followed to
their roots by pointer doubling, in as many rounds as the logarithm of the
longest chain; counts at least double along it (``ratio`` 2), which bounds it.

Rows: null texts have no words; a null id counts as the empty text; repeated
rows count each; very long texts and words are read whole. Of near words with
equal counts the smallest in code-point order is the form. Empty tables give
empty results. Other columns of the input are not passed on.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoplens.session import cut_lineage

from .common import byte_blocks, slices

#: Words in a group; a larger one is dealt out on finer keys.
MEET = 2048
#: Words that are scanned at once, and distinct words that a worker counts before it hands them on.
SCANNED = 20_000
HELD = 400_000

#: Latin-1 bytes of words (A-Z to lower case); all other bytes to a space.
_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 0xC0 else 32 for b in range(256))


def counted(text: str, key: str, least_length: int, strike: int | None, into: Counter) -> None:
    """Count the words of a whole text, runs of letters with A-Z lowered, of ``least_length`` characters or more.

    With ``strike``, a run whose CRC-32 behind ``key:`` it divides loses the character at the CRC modulo its length."""
    runs: Counter = Counter()
    for block in byte_blocks(text.encode("latin-1", "replace")):       # beyond Latin-1: "?", which parts words as well
        runs.update(block.translate(_LETTERS).split())
    start = crc32(f"{key}:".encode())
    for run, n in runs.items():
        if len(run) < least_length:
            continue
        if strike is not None:
            h = crc32(run if run.isascii() else run.decode("latin-1").encode(), start)
            if h % strike == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1:]
                if len(run) < least_length:
                    continue
        into[run] += n


def vocabulary(docs: DataFrame, key: str = "doc_id", text: str = "text", least_length: int = 5, least_count: int = 3,
               strike: int | None = None) -> DataFrame:
    """``(word, n)``: the words that occur ``least_count`` times or more over all texts."""
    rows = docs.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("key"), F.col(text).alias("text")) \
        .where(F.col("text").isNotNull())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def handed() -> pd.DataFrame:
            words = pd.Series([w.decode("latin-1") for w in held], dtype=object)
            made = pd.DataFrame({"word": words, "n": np.array(list(held.values()), np.int64)})
            held.clear()
            return made

        held: Counter = Counter()
        for batch in batches:
            for pdf in slices(batch, "text"):
                for k, x in zip(pdf["key"], pdf["text"]):
                    counted(x, k, least_length, strike, held)
                if len(held) > HELD:
                    yield handed()
        yield handed()

    return rows.mapInPandas(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")) \
        .where(F.col("n") >= least_count)


# ---- the scan ------------------------------------------------------------------------------

def lcps(flat: np.ndarray, off: np.ndarray, size: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Per row the characters that it shares with the row before it; -1 where a group begins."""
    lcp = np.full(len(size), -1, dtype=np.int64)
    same = np.flatnonzero(group[1:] == group[:-1]) + 1
    lcp[same] = 0
    depth = 0
    while len(same):
        same = same[(size[same] > depth) & (size[same - 1] > depth)]
        same = same[flat[off[same] + depth] == flat[off[same - 1] + depth]]
        lcp[same] = depth + 1
        depth += 1
    return lcp


def one_edit(parts: list[str], group: np.ndarray, asks: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (row that asks, row found) at one edit within a group; rows are sorted by group and part.

    ``last``: the part reaches the end of its word. Elsewhere a part that is another one with a character behind it is
    none of this group's: that pair's first difference lies behind the part."""
    size = np.fromiter(map(len, parts), np.int64, len(parts))
    flat = np.frombuffer("".join(parts).encode("utf-32-le"), np.uint32)
    flat = np.append(flat, np.zeros(3, np.uint32))
    off = np.cumsum(size) - size
    lcp = lcps(flat, off, size, group)
    heads = np.flatnonzero(lcp < 0)
    tails = np.append(heads[1:], len(parts))
    of = np.cumsum(lcp < 0) - 1
    q = np.flatnonzero(asks)
    lo, hi = heads[of[q]], tails[of[q]]
    far = 9
    n = len(q)
    # the row of the edit matrix at a depth: cells one before, at and one behind the diagonal; and the cell before it
    left, mid = np.full(n, far, np.int8), np.zeros(n, np.int8)
    right, above = np.where(size[q] >= 1, 1, far).astype(np.int8), np.full(n, far, np.int8)
    found: list[tuple[np.ndarray, np.ndarray]] = []
    depth = 0
    while len(q):
        ended = size[lo] == depth
        longer = size[q] - depth
        cell = np.select([longer == -1, longer == 0, longer == 1], [left, mid, right], far)
        beyond = (longer == -1) & (above == 0) & ~last[q]                    # the asking part with one character behind
        short = (longer == 1) & (mid == 0) & ~last[q]
        hit = ended & (cell == 1) & ~beyond & ~short
        found.append((q[hit], lo[hit]))
        lo = lo + ended
        go = lo < hi
        q, lo, hi, left, mid, right = (x[go] for x in (q, lo, hi, left, mid, right))
        if not len(q):
            break
        # the runs of words that share one more character
        if depth < 64:
            cuts = np.flatnonzero(lcp <= depth)
            upto = np.cumsum(lcp <= depth)
            first, runs = upto[lo], upto[hi - 1] - upto[lo] + 1
        else:                                                                # few words share so long a prefix
            wide = hi - lo
            rows = np.repeat(lo, wide) + np.arange(wide.sum()) - np.repeat(np.cumsum(wide) - wide, wide)
            cut = (lcp[rows] <= depth) & (rows > np.repeat(lo, wide))
            cuts = rows[cut]
            owner = np.repeat(np.arange(len(lo)), wide)[cut]
            runs = 1 + np.bincount(owner, minlength=len(lo))
            first = np.cumsum(runs - 1) - (runs - 1)
        state = np.repeat(np.arange(len(q)), runs)
        nth = np.arange(len(state)) - np.repeat(np.cumsum(runs) - runs, runs)
        base = first[state] + nth - 1
        begin = np.where(nth == 0, lo[state], cuts[np.maximum(base, 0)] if len(cuts) else 0)
        final = nth == runs[state] - 1
        end = np.where(final, hi[state], cuts[np.minimum(base + 1, len(cuts) - 1)] if len(cuts) else 0)
        q, l0, m0, r0 = q[state], left[state], mid[state], right[state]
        c = flat[off[begin] + depth]
        word, long = off[q], size[q]
        here = word + depth
        if depth:
            nl = np.minimum(m0 + 1, l0 + (c != flat[np.minimum(here - 1, len(flat) - 1)]))
        else:
            nl = m0 + 1
        nl = np.where(long >= depth, nl, far)
        nm = np.minimum(np.minimum(r0 + 1, nl + 1), m0 + (c != flat[np.minimum(here, len(flat) - 1)]))
        nm = np.where(long >= depth + 1, nm, far)
        nr = np.minimum(nm + 1, r0 + (c != flat[np.minimum(here + 1, len(flat) - 1)]))
        nr = np.where(long >= depth + 2, nr, far)
        near = np.minimum(np.minimum(nl, nm), nr) <= 1
        q, lo, hi = q[near], begin[near], end[near]
        left, mid, right, above = (np.minimum(x[near], far).astype(np.int8) for x in (nl, nm, nr, m0))
        depth += 1
    return (np.concatenate([a for a, _ in found]), np.concatenate([b for _, b in found])) if found else (q, q)


def _best(pdf: pd.DataFrame) -> pd.DataFrame:
    """Near words among the rows of whole groups: per word how many, and the one of largest count (smallest of equal)."""
    words, counts = pdf["word"].tolist(), pdf["n"].to_numpy(np.int64)
    group = (pdf["key"] != pdf["key"].shift()).cumsum().to_numpy()
    size = np.fromiter(map(len, words), np.int64, len(words))
    asks = size == pdf["m"].to_numpy()
    u, v = one_edit(pdf["part"].tolist(), group, asks, pdf["last"].to_numpy(bool))
    back = ~asks[v]                                          # a longer word has not asked itself
    u, v = np.concatenate([u, v[back]]), np.concatenate([v, u[back]])
    rank = np.empty(len(words), np.int64)
    rank[sorted(range(len(words)), key=words.__getitem__)] = np.arange(len(words))
    order = np.lexsort((rank[v], -counts[v], u))
    u, v = u[order], v[order]
    first = np.flatnonzero(np.append(True, u[1:] != u[:-1])) if len(u) else u
    near = np.diff(np.append(first, len(u)))
    names = np.array(words, dtype=object)
    return pd.DataFrame({"word": names[u[first]], "n_near": near.astype(np.int64), "best_n": counts[v[first]],
                         "best": names[v[first]]})


def _scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    held: list[pd.DataFrame] = []
    rows = 0
    for batch in batches:
        held.append(batch)
        rows += len(batch)
        if rows < SCANNED:
            continue
        pdf = pd.concat(held, ignore_index=True)
        whole = int((pdf["key"] != pdf["key"].iloc[-1]).sum())               # the last group may go on
        for at, to in _runs(pdf["key"].iloc[:whole]):
            yield _best(pdf.iloc[at:to])
        held, rows = [pdf.iloc[whole:]], len(pdf) - whole
    if rows:
        pdf = pd.concat(held, ignore_index=True)
        for at, to in _runs(pdf["key"]):
            yield _best(pdf.iloc[at:to])


def _runs(keys: pd.Series) -> Iterator[tuple[int, int]]:
    """Stretches of whole groups of about ``SCANNED`` rows."""
    if not len(keys):
        return
    starts = np.append(np.flatnonzero((keys != keys.shift()).to_numpy()), len(keys))
    at = 0
    for start, stop in zip(starts[:-1].tolist(), starts[1:].tolist()):
        if stop - at > SCANNED and start > at:
            yield at, start
            at = start
    yield at, len(keys)


# ---- groups ----------------------------------------------------------------------------------

def _halves(rows: DataFrame) -> DataFrame:
    """Each row of places ``from`` to ``to`` once for each half of them."""
    middle = F.expr("(from + to) div 2").cast("int")
    return rows.withColumn("half", F.explode(F.array(F.struct(F.col("from"), middle.alias("to")),
                                                     F.struct(middle.alias("from"), F.col("to"))))) \
        .select("word", "n", "m", "half.from", "half.to")


def _keyed(rows: DataFrame) -> DataFrame:
    """Adds what two words share that meet (``key``), and what stands between (``part``)."""
    behind = F.greatest(F.col("m") - F.col("to"), F.lit(0))
    size = F.length("word")
    return rows.select("word", "n", "m", "from", "to", (F.col("to") > F.col("m")).alias("last"), F.concat_ws(
        ":", "m", "from", "to", F.col("word").substr(F.lit(1), F.col("from")),
        F.col("word").substr(size - behind + 1, behind)).alias("key"),
        F.col("word").substr(F.col("from") + 1, size - behind - F.col("from")).alias("part"))


def near_words(words: DataFrame, meet: int = MEET) -> DataFrame:
    """``(word, n_near, best_n, best)`` of the words that have another at one edit: how many, and the most frequent."""
    size = F.length("word")
    rows = words.where(size > 0).select("word", "n", F.explode(F.array(size, size - 1)).alias("m")) \
        .where("m > 0").select("word", "n", "m", F.lit(0).alias("from"), (F.col("m") + 1).alias("to"))
    parts = []
    keyed = _keyed(_halves(rows))
    while True:
        large = cut_lineage(keyed.where("to - from > 1").groupBy("key").agg(F.count("*").alias("size"))
                            .where(F.col("size") > meet).select("key"))
        if large.isEmpty():
            parts.append(keyed)
            break
        parts.append(keyed.join(large, "key", "left_anti").select(keyed.columns))
        keyed = _keyed(_halves(cut_lineage(keyed.join(large, "key", "left_semi").select("word", "n", "m", "from", "to"))))
    dealt = parts[0]
    for part in parts[1:]:
        dealt = dealt.unionByName(part)
    found = dealt.select("key", "part", "word", "n", "m", "last").repartition("key").sortWithinPartitions("key", "part") \
        .mapInPandas(_scan, "word string, n_near long, best_n long, best string")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"),
                                     F.min(F.struct((-F.col("best_n")).alias("n"), F.col("best"))).alias("s")) \
        .select("word", "n_near", (-F.col("s.n")).alias("best_n"), F.col("s.best").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """``(word, root)``: for rows ``(word, form)`` the last form that forms lead to, by pointer doubling."""
    held = cut_lineage(forms.select("word", F.col("form").alias("root")))
    while True:
        up = held.select(F.col("word").alias("root"), F.col("root").alias("beyond"))
        next_ = cut_lineage(held.join(up, "root", "left").select(
            "word", F.coalesce("beyond", "root").alias("root"), F.col("beyond").isNotNull().alias("moved")))
        held = next_.select("word", "root")
        if next_.where("moved").isEmpty():
            return held


def variants(words: DataFrame, ratio: int = 2, meet: int = MEET) -> DataFrame:
    """``(word, form, root, n, n_near, form_n)`` for every row of ``(word, n)``: the most frequent word one edit away
    if it has ``ratio`` times the count or more (1 would allow circles, so it must be more), and the last of its forms."""
    if ratio <= 1:
        raise ValueError("forms must be more frequent than their variants")
    words = cut_lineage(words.select("word", "n"))
    near = near_words(words, meet)
    chosen = F.col("best_n") >= ratio * F.col("n")
    rows = cut_lineage(words.join(near, "word", "left").select(
        "word", F.when(chosen, F.col("best")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
        F.when(chosen, F.col("best_n")).alias("form_n")))
    found = roots(rows.where("form is not null").select("word", "form"))
    return rows.join(found, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
