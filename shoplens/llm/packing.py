"""Best-fit packing of token sequences by exact-complement hashing.

Every document is encoded once and cut into pieces that fit; what packing
needs of them is how many pieces there are of each length, at most ``size``
numbers whatever the input. The plan is made from these counts: the sums of one,
two and three lengths are indexed, gaps are filled exactly by any combination of
their size while pieces of those lengths are left; the rest goes best-fit into
the tightest open sequence. The plan is a list of patterns with a
multiplicity, each step uses up a length or a pattern, so its size is bounded
by ``size`` as well.

A piece finds its place by its rank among the pieces of its length. Ranks come
from counts per (length, bucket) and places inside a bucket; buckets hash the
piece and hold some 10,000 rows, so a length that a third of all pieces have
is spread like any other. Full pieces (1,024 tokens) need a rank only for
their sequence number.

Rows: a null text is empty and makes a piece of one end token; very long texts
are encoded whole. Repeated rows are packed each. Ties in rank go by id, piece
and checksum; rows equal in all three are interchangeable. Empty tables give an
empty plan. Other columns of the input, whatever their names, are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shoplens.session import cut_lineage

from .bpe import json_codec
from .common import slices

#: Rows of a bucket inside which pieces are ranked, on average.
BUCKET_ROWS = 10_000


def pieces(docs: DataFrame, tokenizer: str, pattern: str, end_id: int, size: int = 1024, key: str = "doc_id",
           text: str = "text", with_ids: bool = False) -> DataFrame:
    """``(key, piece, start, length, ids_crc32)`` and on demand ``ids`` (packed unsigned 32-bit) of every piece."""
    kind = docs.schema[key].dataType.simpleString()
    src = docs.select(F.col(f"`{key}`").alias("__key"), F.col(f"`{text}`").cast("string").alias("__text"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codec = json_codec(tokenizer, pattern)
        stop = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            for pdf in slices(batch, "__text"):
                rows = []
                for at, x in enumerate(pdf["__text"]):
                    ids = codec.encode(x or "") + stop
                    n = len(ids) // 4
                    begin, finish = 0, n % size or size
                    piece = 0
                    while begin < n:
                        part = ids[4 * begin:4 * finish]
                        rows.append((at, piece, begin, finish - begin, zlib.crc32(part), part))
                        begin, finish, piece = finish, finish + size, piece + 1
                columns = list(zip(*rows))
                made = pd.DataFrame({"__key": pdf["__key"].iloc[list(columns[0])].reset_index(drop=True),
                                     "piece": columns[1], "start": columns[2], "length": columns[3],
                                     "ids_crc32": columns[4]})
                if with_ids:
                    made["ids"] = list(columns[5])
                yield made

    schema = f"__key {kind}, piece int, start long, length long, ids_crc32 long" + (", ids binary" if with_ids else "")
    return src.mapInPandas(run, schema).withColumnRenamed("__key", key)


class Sums:
    """The sums of the lengths that there are, one and two at a time; three are a length beside an indexed pair."""

    def __init__(self, left: np.ndarray, size: int):
        lengths = np.flatnonzero(left)
        i, j = np.triu_indices(len(lengths))
        total = lengths[i] + lengths[j]
        order = np.lexsort((lengths[i], total))
        order = order[total[order] <= size]
        self.low, self.high = lengths[i][order], lengths[j][order]
        self.at = np.searchsorted(total[order], np.arange(size + 2))

    def pairs(self, total: int) -> list[tuple[int, int]]:
        """``(low, high)`` of the given sum, by rising ``low``."""
        here = slice(*self.at[max(total, 0):max(total, 0) + 2]) if total > 0 else slice(0, 0)
        return list(zip(self.low[here].tolist(), self.high[here].tolist()))


def plan(counts: dict[int, int], size: int = 1024) -> list[tuple[int, list[int]]]:
    """Patterns ``(multiplicity, lengths)`` that use up exactly ``counts`` (length → pieces).

    Single complements first, for they use fewest pieces. Then every pair, and every triple, that fills the gap beside a
    piece of over half the size, while pieces of those lengths are left: no combination is passed over. The rest goes
    best-fit, where each gap that opens is filled exactly in the same way as soon as it can be."""
    left = np.zeros(size + 1, dtype=np.int64)
    for length, n in counts.items():
        left[length] = n
    patterns: list[tuple[int, list[int]]] = []

    def use(parts: list[int]) -> None:
        times = _take(left, parts)
        if times:
            patterns.append((times, sorted(parts, reverse=True)))

    use([size])
    for length in range(size - 1, size // 2 - 1, -1):
        use([length, size - length])
    sums = Sums(left, size)
    for fills in (_pairs, _triples):
        for length in range(size // 2 + 1, size):
            for parts in fills(left, sums, size - length):
                if not left[length]:
                    break
                use([length, *parts])
    return patterns + _best_fit(left, size)


def _take(left: np.ndarray, parts: list[int], most: int | None = None) -> int:
    """How often (``most`` times at most) pieces of the lengths ``parts`` are left together; they are used up."""
    need = {p: parts.count(p) for p in parts}
    times = min(int(left[p]) // k for p, k in need.items())
    if most is not None:
        times = min(times, most)
    if times:
        for p, k in need.items():
            left[p] -= k * times
    return times


def _pairs(left: np.ndarray, sums: Sums, gap: int, most: int | None = None) -> Iterator[list[int]]:
    """The pairs that fill ``gap``, of lengths up to ``most``, as long as there are pieces of them."""
    for low, high in sums.pairs(gap):
        if left[low] and left[high] and (most is None or high <= most):
            yield [high, low]


def _triples(left: np.ndarray, sums: Sums, gap: int, most: int | None = None) -> Iterator[list[int]]:
    """The triples that fill ``gap``, of lengths up to ``most``, as long as there are pieces of them."""
    for last in range(1, gap // 3 + 1):
        for low, high in reversed(sums.pairs(gap - last) if left[last] else []):
            if low < last:                                                  # named under its own least length
                continue
            if not left[last]:
                break
            if left[low] and left[high] and (most is None or high <= most):
                yield [high, low, last]


def _closing(length: int, gap: int, sums: Sums) -> Iterator[list[int]]:
    """The ways to fill ``gap`` exactly with ``length`` and at most two pieces that are no longer."""
    rest = gap - length
    if not rest:
        yield [length]
        return
    if rest <= length:
        yield [length, rest]
    for low, high in reversed(sums.pairs(rest)):
        if high <= length:
            yield [length, high, low]


def _best_fit(left: np.ndarray, size: int) -> list[tuple[int, list[int]]]:
    """Pieces of over half the size each open a sequence and take of the others what fits; what is then left fills
    sequences exactly where pairs and triples do, and opens the others by falling length."""
    by_gap: dict[int, list[tuple[int, list[int]]]] = {}
    sums = Sums(left, size)
    for length in range(size // 2 + 1, size + 1):
        if left[length]:
            by_gap[size - length] = [(int(left[length]), [length])]
            left[length] = 0
    for length in range(size // 2, 0, -1):
        _into_open(left, sums, by_gap, length)
    for fills in (_pairs, _triples):
        for length in range(size // 2, 0, -1):
            for parts in fills(left, sums, size - length, length):
                if not left[length]:
                    break
                times = _take(left, [length, *parts])
                if times:
                    by_gap.setdefault(0, []).append((times, [length, *parts]))
    for length in range(size // 2, 0, -1):
        _into_open(left, sums, by_gap, length)
        n, fits = int(left[length]), size // length
        left[length] = 0
        if n // fits:
            by_gap.setdefault(size - fits * length, []).append((n // fits, [length] * fits))
        if n % fits:
            by_gap.setdefault(size - n % fits * length, []).append((1, [length] * (n % fits)))
    return [p for gap in sorted(by_gap) for p in by_gap[gap]]


def _into_open(left: np.ndarray, sums: Sums, by_gap: dict[int, list[tuple[int, list[int]]]], length: int) -> None:
    """Pieces of ``length`` into the open patterns of smallest sufficient gap: with one or two shorter ones where they
    fill it exactly, else as many as fit."""
    for gap in sorted(g for g in by_gap if g >= length):
        if not left[length]:
            break
        later = []
        for times, parts in by_gap.pop(gap):
            for exact in _closing(length, gap, sums):
                if not times or not left[length]:
                    break
                full = _take(left, exact, times)
                if full:
                    by_gap.setdefault(0, []).append((full, parts + exact))
                    times -= full
            n, fits = int(left[length]), gap // length
            if n and times:
                full = min(times, n // fits)                                # patterns that take as many as fit
                if full:
                    by_gap.setdefault(gap - fits * length, []).append((full, parts + [length] * fits))
                    n -= full * fits
                    times -= full
                if n and times and n < fits:
                    by_gap.setdefault(gap - n * length, []).append((1, parts + [length] * n))
                    n = 0
                    times -= 1
                left[length] = n
            if times:
                later.append((times, parts))
        if later:
            by_gap.setdefault(gap, []).extend(later)


def slots(patterns: list[tuple[int, list[int]]]) -> dict[int, np.ndarray]:
    """Per length, rows (first rank, first sequence, pieces a sequence, first offset), by first rank."""
    taken: dict[int, int] = {}
    out: dict[int, list[tuple[int, int, int, int]]] = {}
    sequence = 0
    for times, parts in patterns:
        offset = 0
        for length in sorted(set(parts), reverse=True):
            each = parts.count(length)
            out.setdefault(length, []).append((taken.get(length, 0), sequence, each, offset))
            taken[length] = taken.get(length, 0) + times * each
            offset += each * length
        sequence += times
    return {length: np.array(rows, dtype=np.int64) for length, rows in out.items()}


def ranked(cut: DataFrame, key: str, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Add ``rank`` (from 0) among the pieces of a length; no window holds more than a bucket."""
    total = cut.count()
    buckets = max(1, -(-total // bucket_rows))
    dealt = cut.withColumn("bucket", F.pmod(F.xxhash64(key, "piece", "ids_crc32"), F.lit(buckets)))
    sizes = dealt.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    first = sizes.select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    inside = Window.partitionBy("length", "bucket").orderBy(F.col(key), "piece", "ids_crc32")
    placed = dealt.withColumn("place", F.row_number().over(inside))
    return placed.join(first, ["length", "bucket"]) \
        .withColumn("rank", F.col("first") + F.col("place") - 1).drop("bucket", "first", "place")


def pack(cut: DataFrame, key: str = "doc_id", size: int = 1024, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to a table of pieces (written once before, as it is read twice)."""
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}
    places = slots(plan(counts, size))
    rows = ranked(cut, key, bucket_rows)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            made = pdf.drop(columns="rank")
            length, rank = pdf["length"].to_numpy(), pdf["rank"].to_numpy()
            sequence, offset = np.zeros(len(pdf), np.int64), np.zeros(len(pdf), np.int64)
            for one in np.unique(length):
                at = np.flatnonzero(length == one)
                table = places[int(one)]
                row = table[np.searchsorted(table[:, 0], rank[at], side="right") - 1]
                nth = rank[at] - row[:, 0]
                sequence[at] = row[:, 1] + nth // row[:, 2]
                offset[at] = row[:, 3] + nth % row[:, 2] * one
            yield made.assign(sequence_id=sequence, offset=offset)

    names = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name != "rank"]
    return rows.mapInPandas(run, ", ".join([*names, "sequence_id long", "offset long"]))


def pack_documents(docs: DataFrame, tokenizer: str, pattern: str, end_id: int, size: int = 1024, key: str = "doc_id",
                   text: str = "text", with_ids: bool = False) -> DataFrame:
    """Encode, cut and pack all documents: one row per piece with its sequence and place there."""
    cut = cut_lineage(pieces(docs, tokenizer, pattern, end_id, size, key, text, with_ids))
    return pack(cut, key, size)
