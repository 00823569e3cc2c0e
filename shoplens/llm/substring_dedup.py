"""Removal of repeated lines, paragraphs and passages by hashing normalised units.

Units are lines and paragraphs (runs of lines without a blank one) of
``line_words`` words or more, and every window of ``min_words`` words anywhere
in a text, across lines too, because passages are pasted anywhere. All are
normalised (A-Z in lower case, any white space between words) and their digests
grouped over all documents. A unit that an earlier document (smaller id) or
place has is removed: whole lines and paragraphs, and every repeated run of
``min_words`` words from its first word to its last, whatever surrounds it.
Shorter repeats stay. A later unit that overlaps the earliest one in its own
document loses only what lies behind it.

Lines and paragraphs are rows of a 128-bit digest and a place. Windows do not
travel one by one. Each has an anchor: the 8-word run of least
hash in it, which depends on its own words alone. Neighbouring windows with the
anchor in one place make a group (nine or ten on average, at most 18), which is
one row. Anchors are counted first with partial aggregation, and groups whose anchor
occurs once are never made, since equal windows have equal anchors. Equal groups
are reduced to their earliest occurrence, and later ones are removed whole.
What is left to compare are the windows of the earliest groups whose anchor has
several different groups: the ends of passages, and short common phrases.
Digests and anchors are counted before rows meet them, so that rows of a very
common one are spread over tasks (:func:`common.met`).

Rows: a null text has no units and stays null; a null id ranks first; ids that
are no integers rank as text. Rows that
repeat id and text are one document and lose the same spans; rows that share an
id only are different documents. Empty tables give empty results. Output
columns replace input columns of the same name. Spans are code points of the
original text, merged per document.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import lru_cache
from hashlib import blake2b
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shoplens.session import cut_lineage, drop_tables, tables

from .common import met, others, slices

#: Words of an anchor (fewer if windows have under 24 words).
ANCHOR_WORDS = 8
#: Bytes whose words are hashed at once (a longer word is taken whole).
BLOCK = 1 << 20
WHITE = " \t\n\x0b\x0c\r"
NO_LINES = pd.DataFrame({c: pd.Series([], dtype=object) for c in ("digest", "__id", "__mark", "start", "end")})
#: Odd bases of the polynomial hashes over the bytes of a word and over words, modulo 2**64.
BYTE_BASE, WORD_BASE = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD95


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the finalizer of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: A random number for each byte.
BYTES = _mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


@lru_cache(maxsize=8)
def _some_powers(base: int, size: int) -> np.ndarray:
    factors = np.full(size, base, dtype=np.uint64)
    factors[0] = 1
    return np.multiply.accumulate(factors)


def _powers(base: int, n: int) -> np.ndarray:
    """The powers 0 to n - 1 of a base or, more of them, kept for the next call unless they are many."""
    size = max(1 << 16, 1 << (n - 1).bit_length())
    return (_some_powers if size <= 2 * BLOCK else _some_powers.__wrapped__)(base, size)[:n]


def _inverse(base: int) -> int:
    return pow(base, -1, 1 << 64)


def _word_hashes(low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word, from sums over its bytes."""
    out = np.empty(len(starts), dtype=np.uint64)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + BLOCK, "right")))
        base, top = int(starts[i]), int(ends[j - 1])
        sums = np.zeros(top - base + 1, dtype=np.uint64)
        np.cumsum(BYTES[low[base:top]] * _powers(BYTE_BASE, top - base), out=sums[1:])
        at = starts[i:j] - base
        out[i:j] = (sums[ends[i:j] - base] - sums[at]) * _powers(_inverse(BYTE_BASE), top - base)[at]
        i = j
    return _mix(out + (ends - starts).astype(np.uint64))


class Windows(NamedTuple):
    """The windows of some texts, in order, and their groups."""
    digest: np.ndarray      #: of each window
    start: np.ndarray       #: its first code point
    end: np.ndarray         #: the code point behind it
    head: np.ndarray        #: first window of each group, and the number of windows
    doc: np.ndarray         #: text of each group
    anchor: np.ndarray      #: hash of the anchor of each group
    whole: np.ndarray       #: hash of all words of each group


def windows(texts: Sequence[str], min_words: int) -> Windows:
    """All windows of the texts."""
    coded = [t.encode() for t in texts]
    data = b"\n".join(coded)
    origin = np.cumsum([0] + [len(x) + 1 for x in coded[:-1]])
    low = np.frombuffer(data.lower(), np.uint8)             # bytes.lower: A-Z alone, so places stay
    word = np.zeros(len(low) + 2, dtype=bool)
    word[1:-1] = (low != 32) & ((low < 9) | (low > 13))
    change = np.flatnonzero(word[1:] != word[:-1])
    starts, ends = change[::2], change[1::2]
    n, k = len(starts), max(1, min(ANCHOR_WORDS, min_words // 3))
    doc = np.searchsorted(origin, starts, "right") - 1
    at = np.flatnonzero(doc[:max(0, n - min_words + 1)] == doc[min_words - 1:])
    if not len(at):
        none = np.zeros(0, dtype=np.int64)
        return Windows(none, none, none, np.zeros(1, dtype=np.int64), none, none, none)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(_word_hashes(low, starts, ends) * _powers(WORD_BASE, n), out=sums[1:])
    back = _powers(_inverse(WORD_BASE), n)
    short = _mix((sums[k:] - sums[:-k]) * back[:n - k + 1])
    # least anchor of each window, the leftmost of equal ones, by doubling
    least, place, size, span = short, np.arange(len(short)), 1, min_words - k + 1
    while size < span:
        step = min(size, span - size)
        right = least[step:] < least[:-step]
        least = np.where(right, least[step:], least[:-step])
        place = np.where(right, place[step:], place[:-step])
        size += step
    place = place[at]
    head = np.concatenate([[0], np.flatnonzero(place[1:] != place[:-1]) + 1, [len(at)]])
    opens, closes = at[head[:-1]], at[head[1:] - 1] + min_words
    digest = _mix((sums[at + min_words] - sums[at]) * back[at])
    whole = _mix((sums[closes] - sums[opens]) * back[opens] + (closes - opens).astype(np.uint64))
    begin, end, zero = starts[at], ends[at + min_words - 1], origin
    if not data.isascii():                                  # places in bytes to places in code points
        points = np.concatenate([[0], np.cumsum((low & 0xC0) != 0x80)])
        begin, end, zero = points[begin], points[end], points[origin]
    own = zero[doc[at]]
    return Windows(digest.view(np.int64), begin - own, end - own, head, doc[opens],
                   short[place[head[:-1]]].view(np.int64), whole.view(np.int64))


def units(text: str, min_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Digest, first and end code point of the windows of a text."""
    return windows([text], min_words)[:3]


def lines(text: str, line_words: int) -> Iterator[tuple[bytes, int, int]]:
    """Digest, first and end code point of the lines and paragraphs of at least ``line_words`` words."""
    def unit(body: str, start: int, end: int) -> Iterator[tuple[bytes, int, int]]:
        if len(body) >= 2 * line_words - 1:
            words = body.encode().lower().split()           # bytes.lower: A-Z alone; bytes.split: space and \x09-\x0D
            if len(words) >= line_words:
                yield blake2b(b" ".join(words), digest_size=16).digest(), start, end

    held: list[tuple[str, int, int]] = []                   # the lines of the paragraph so far
    at = 0
    for line in text.split("\n"):
        body = line.strip(WHITE)
        start = at + line.index(body) if body else at
        if body:
            held.append((body, start, start + len(body)))
            yield from unit(*held[-1])
        if not body or at + len(line) == len(text):
            if len(held) > 1:
                yield from unit(" ".join(b for b, _, _ in held), held[0][1], held[-1][2])
            held = []
        at += len(line) + 1


def _ident(docs: DataFrame, key: str, text: str) -> dict[str, Column]:
    """What stands for a document: its id, in order, and a hash of its text."""
    own = F.col(f"`{key}`")
    number = isinstance(docs.schema[key].dataType, T.IntegralType)
    return {"__id": F.coalesce(own.cast("long"), F.lit(-(1 << 63))) if number else F.coalesce(own.cast("string"), F.lit("")),
            "__mark": F.xxhash64(F.col(f"`{text}`").cast("string"))}


def _source(docs: DataFrame, key: str, text: str, least: int) -> DataFrame:
    """``(__id, __mark, __text)`` of the documents that can have a unit of ``least`` words."""
    return docs.select(*[c.alias(n) for n, c in _ident(docs, key, text).items()],
                       F.col(f"`{text}`").cast("string").alias("__text")) \
        .where(F.length("__text") >= 2 * least - 1)


def _lines(src: DataFrame, line_words: int) -> DataFrame:
    """``(digest, __id, __mark, start, end)`` of all lines and paragraphs that are units."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for pdf in slices(batch, "__text"):
                rows = [(digest, i, start, end) for i, x in enumerate(pdf["__text"]) for digest, start, end in lines(x, line_words)]
                at = [r[1] for r in rows]
                yield pd.DataFrame({"digest": [r[0] for r in rows], "__id": pdf["__id"].to_numpy()[at],
                                    "__mark": pdf["__mark"].to_numpy()[at], "start": [r[2] for r in rows],
                                    "end": [r[3] for r in rows]}) if rows else NO_LINES

    return src.mapInPandas(run, f"digest binary, __id {dict(src.dtypes)['__id']}, __mark long, start int, end int")


def _anchors(src: DataFrame, min_words: int, names: list[str]) -> DataFrame:
    """The anchor of each group, after the columns ``names`` of its document."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for pdf in slices(batch, "__text"):
                w = windows(pdf["__text"].tolist(), min_words)
                yield pd.DataFrame({c: pdf[c].to_numpy()[w.doc] for c in names} | {"anchor": w.anchor})

    types = dict(src.dtypes)
    return src.select(*names, "__text").mapInPandas(run, ", ".join([*(f"{c} {types[c]}" for c in names), "anchor long"]))


def _groups(src: DataFrame, min_words: int) -> DataFrame:
    """The groups whose anchor is among the ``anchors`` of their document: ``(__id, __mark, anchor, whole, start,
    first_end, end, digests, places)``; the last two hold the windows' digests, and their starts and ends counted from
    the group's start."""
    def packed(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
        until = np.concatenate([[0], np.cumsum(sizes * values.nbytes // max(1, len(values)))]).astype(np.int32)
        return pa.Array.from_buffers(pa.binary(), len(sizes), [
            None, pa.py_buffer(until), pa.py_buffer(np.ascontiguousarray(values))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for pdf in slices(batch.to_pandas(), "__text"):
                w = windows(pdf["__text"].tolist(), min_words)
                at = np.flatnonzero(np.isin(w.anchor, np.concatenate(pdf["anchors"].tolist())))
                sizes, first, last = np.diff(w.head)[at], w.head[at], w.head[at + 1] - 1
                own = np.arange(sizes.sum()) + np.repeat(first - np.cumsum(sizes) + sizes, sizes)
                base = np.repeat(w.start[first], sizes)
                places = np.stack([w.start[own] - base, w.end[own] - base], axis=1)
                places = places.astype("<u2" if places.max(initial=0) < 1 << 16 else "<u4")
                row = pa.array(pdf.index.to_numpy()[w.doc[at]].astype(np.int64))
                yield pa.RecordBatch.from_arrays([
                    batch.column("__id").take(row), batch.column("__mark").take(row),
                    pa.array(w.anchor[at]), pa.array(w.whole[at]), pa.array(w.start[first].astype(np.int32)),
                    pa.array(w.end[first].astype(np.int32)), pa.array(w.end[last].astype(np.int32)),
                    packed(w.digest[own], sizes), packed(places, sizes)],
                    ["__id", "__mark", "anchor", "whole", "start", "first_end", "end", "digests", "places"])

    return src.mapInArrow(run, f"__id {dict(src.dtypes)['__id']}, __mark long, anchor long, whole long, start int, "
                               "first_end int, end int, digests binary, places binary")


def _opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per window of the groups."""
    for batch in batches:
        digests, places = batch.column("digests").to_pylist(), batch.column("places").to_pylist()
        n = [len(d) // 8 for d in digests]
        at = np.concatenate([np.frombuffer(p, "<u2" if len(p) == 4 * m else "<u4").astype(np.int32)
                             for p, m in zip(places, n)] or [np.zeros(0, np.int32)]).reshape(-1, 2)
        at = at + np.repeat(batch.column("start").to_numpy(), n)[:, None].astype(np.int32)
        row = pa.array(np.repeat(np.arange(len(n)), n))
        yield pa.RecordBatch.from_arrays([
            pa.array(np.frombuffer(b"".join(digests), np.int64)),
            batch.column("__id").take(row), batch.column("__mark").take(row),
            pa.array(np.ascontiguousarray(at[:, 0])), pa.array(np.ascontiguousarray(at[:, 1]))],
            ["digest", "__id", "__mark", "start", "end"])


def _stored(df: DataFrame) -> DataFrame:
    """``cut_lineage``; the shuffle files of what is written go when it is, not at some later collection."""
    conf, name = df.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = conf.get(name)
    conf.set(name, "true")
    try:
        return cut_lineage(df)
    finally:
        conf.set(name, before)


def _later(found: DataFrame, first: DataFrame, names: list[str], first_end: str) -> DataFrame:
    """``(__id, __mark, start, end)`` of what is found after its first occurrence, behind that one's (first) window;
    ``first`` counts in ``n`` what is found under each name."""
    f = F.col("first")
    own = (F.col("__id") == f["__id"]) & (F.col("__mark") == f["__mark"])
    later = met(found, first, names, PLACE).where(~own | (F.col("start") > f["start"]))
    return later.select("__id", "__mark", F.when(own, F.greatest("start", f[first_end])).otherwise(F.col("start"))
                        .alias("start"), "end").where("start < end")


PLACE = ["__id", "__mark", "start"]


def _first_of(rows: DataFrame, names: list[str]) -> DataFrame:
    """Of each name that occurs in several places, its earliest place as ``first`` and their number ``n``."""
    place = F.struct(*PLACE, "end")
    return _stored(rows.groupBy(*names).agg(F.min(place).alias("first"), F.max(place).alias("last"), F.count("*").alias("n"))
                   .where("first <> last").drop("last"))


def repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", min_words: int = 25,
            line_words: int = 14) -> DataFrame:
    """``(__id, __mark, spans)``: the merged spans to remove, per document that has any."""
    spark = docs.sparkSession
    before = set(tables(spark))
    ident = ["__id", "__mark"]
    # lines and paragraphs
    units = _stored(_lines(_source(docs, key, text, line_words), line_words))
    whole_lines = _later(units, _first_of(units, ["digest"]), ["digest"], "end")
    # windows
    src = _source(docs, key, text, min_words)
    shared = _stored(_anchors(src, min_words, []).groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1"))
    of_doc = met(_anchors(src, min_words, ident), shared, ["anchor"], ident) \
        .groupBy(*ident).agg(F.collect_set("anchor").alias("anchors"))
    groups = _stored(_groups(src.join(of_doc, ident), min_words))
    first = _stored(groups.groupBy("anchor", "whole").agg(
        F.min(F.struct(*PLACE, "first_end", "digests", "places")).alias("first"), F.max(F.struct(*PLACE)).alias("last"),
        F.count("*").alias("n")))
    # copies of one row (same id and text) count once
    again = first.where(F.struct(*[F.col("first")[c] for c in PLACE]) != F.col("last")) \
        .select("anchor", "whole", F.struct(*[F.col("first")[c].alias(c) for c in [*PLACE, "first_end"]]).alias("first"), "n")
    whole = _later(groups.drop("digests", "places"), again, ["anchor", "whole"], "first_end")
    several = _stored(first.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1"))
    found = _stored(met(first.drop("n"), several, ["anchor"], ["whole"]).select("first.*").drop("first_end").mapInArrow(
        _opened, f"digest long, __id {dict(src.dtypes)['__id']}, __mark long, start int, end int"))
    parts = _later(found, _first_of(found, ["digest"]), ["digest"], "end")
    spans = F.array_sort(F.collect_set(F.struct("start", "end")))
    done = _stored(whole_lines.union(whole).union(parts).groupBy("__id", "__mark").agg(spans.alias("spans"))
                   .withColumn("spans", _merged(F.col("spans"))))
    drop_tables(spark, [t for t in tables(spark)[:-1] if t not in before])
    return done


def _merged(spans: Column) -> Column:
    """Sorted spans with overlapping and touching ones made one."""
    def add(done: Column, s: Column) -> Column:
        top = F.element_at(done, -1)
        joined = F.struct(top["start"].alias("start"), F.greatest(top["end"], s["end"]).alias("end"))
        return F.when((F.size(done) > 0) & (F.try_element_at(done, F.lit(-1))["end"] >= s["start"]),
                      F.concat(F.slice(done, 1, F.size(done) - 1), F.array(joined))) \
            .otherwise(F.concat(done, F.array(s)))

    empty = F.expr("cast(array() as array<struct<start:int,end:int>>)")
    return F.aggregate(spans, empty, add)


def remove(docs: DataFrame, key: str = "doc_id", text: str = "text", min_words: int = 25,
           line_words: int = 14) -> DataFrame:
    """All rows and columns of ``docs`` with repeats cut out of the text, and ``spans`` (array of start and end in the
    original text; empty where nothing was removed)."""
    ident = _ident(docs, key, text)
    found = repeats(docs, key, text, min_words, line_words)
    joined = docs.select(*others(docs, ["spans"]), *[c.alias(n) for n, c in ident.items()]) \
        .join(found, ["__id", "__mark"], "left")
    body, spans = F.col(f"`{text}`"), F.col("spans")
    pieces = F.transform(F.sequence(F.lit(0), F.size(spans)), lambda i: F.substring(
        body, F.coalesce(F.get(spans, i - 1)["end"], F.lit(0)) + 1,
        F.coalesce(F.get(spans, i)["start"], F.length(body)) - F.coalesce(F.get(spans, i - 1)["end"], F.lit(0))))
    left = F.when(spans.isNull(), body).otherwise(F.array_join(pieces, ""))
    empty = F.expr("cast(array() as array<struct<start:int,end:int>>)")
    columns = [left.alias(c) if c.lower() == text.lower() else F.col(f"`{c}`")
               for c in docs.columns if c.lower() != "spans"]
    return joined.select(*columns, F.coalesce(spans, empty).alias("spans"))
