"""Plans against the counts they pack and a lower bound; rows against the tokenizers library."""

import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from shoplens.llm import packing
from .conftest import DOC_SCHEMA


def bound(counts, size):
    """Sequences that no packing can do without: for each K, long pieces stand alone, short ones fill what is left."""
    best = 0
    for k in range(0, size // 2 + 1):
        alone = sum(n for x, n in counts.items() if x > size - k)
        half = [(x, n) for x, n in counts.items() if size // 2 < x <= size - k]
        small = sum(x * n for x, n in counts.items() if k <= x <= size // 2)
        free = sum((size - x) * n for x, n in half)
        best = max(best, alone + sum(n for _, n in half) + max(0, -(-(small - free) // size)))
    return best


@pytest.mark.parametrize("seed", range(6))
def test_plan_uses_each_piece_once_and_is_tight(seed):
    rng = random.Random(seed)
    size = 64
    counts = {x: rng.randrange(0, 400) for x in rng.sample(range(1, size + 1), rng.randrange(3, size))}
    patterns = packing.plan(counts, size)
    used: dict[int, int] = {}
    for times, parts in patterns:
        assert times > 0 and sum(parts) <= size
        for p in parts:
            used[p] = used.get(p, 0) + times
    assert used == {x: n for x, n in counts.items() if n}
    sequences = sum(times for times, _ in patterns)
    assert sequences <= 1.03 * bound(counts, size) + 1
    assert len(patterns) <= 4 * size


def test_exact_fills_find_pairs_and_triples():
    assert packing.plan({60: 10, 4: 10}, 64) == [(10, [60, 4])]
    assert packing.plan({50: 3, 8: 3, 6: 3}, 64) == [(3, [50, 8, 6])]
    assert packing.plan({40: 1, 12: 1, 7: 1, 5: 1}, 64) == [(1, [40, 12, 7, 5])]
    assert packing.plan({}, 64) == []
    assert sum(t for t, _ in packing.plan({1: 129}, 64)) == 3


def test_sums_index_every_pair():
    left = np.zeros(65, dtype=np.int64)
    left[[3, 5, 9, 20, 40, 60]] = 1
    sums = packing.Sums(left, 64)
    here = np.flatnonzero(left).tolist()
    for total in range(0, 65):
        assert sums.pairs(total) == sorted((a, b) for a in here for b in here if a <= b and a + b == total)
    assert packing.Sums(np.zeros(65, np.int64), 64).pairs(10) == []


def test_pairs_and_triples_close_gaps_that_nothing_else_does():
    # 700 + 320 + 4, and 600 + 300 + 120 + 4: no single complement, and the closing piece is a small one
    assert packing.plan({700: 5, 320: 5, 4: 5}) == [(5, [700, 320, 4])]
    assert packing.plan({600: 2, 300: 2, 120: 2, 4: 2}) == [(2, [600, 300, 120, 4])]
    rng = random.Random(8)
    counts = {}
    for _ in range(4000):
        x = min(1024, max(2, int(rng.gammavariate(1.3, 300))))
        counts[x] = counts.get(x, 0) + 1
    patterns = packing.plan(counts)
    exact = {k: sum(t for t, p in patterns if len(p) == k and sum(p) == 1024) for k in (2, 3, 4)}
    assert min(exact.values()) > 0
    assert sum(t for t, _ in patterns) <= 1.005 * bound(counts, 1024) + 1


def test_exact_fills_are_not_passed_over():
    # the closing piece may be of any size: 300 of 400, and 100 of 412
    assert packing.plan({624: 2, 260: 2, 250: 2, 140: 2}) == [(2, [624, 260, 140]), (1, [250, 250])]
    assert packing.plan({612: 1, 204: 1, 108: 1, 100: 1, 300: 1}) == [(1, [612, 204, 108, 100]), (1, [300])]
    # and no sequence has to have a piece of over half the size
    assert packing.plan({400: 1, 330: 1, 294: 1, 350: 1}) == [(1, [400, 330, 294]), (1, [350])]
    rng = random.Random(3)
    counts = {x: rng.randrange(1, 50) for x in rng.sample(range(100, 900), 300)}
    left = dict(counts)
    for times, parts in packing.plan(counts):
        if len(parts) > 1 and sum(parts) == 1024 and parts[0] > 512:
            for x in parts:
                left[x] -= times
    rest = np.array([x for x, n in left.items() if n])
    for x in rest[rest > 512].tolist():                      # no pair of what is left would have filled its gap
        assert not any(left[a] and left.get(1024 - x - a, 0) > (2 * a == 1024 - x) for a in rest.tolist())


def check(rows, docs, size, tokenizer):
    whole = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    want = []
    for d in docs:
        ids = whole.encode(d["text"] or "", add_special_tokens=False).ids + [2]
        at, end, piece = 0, len(ids) % size or size, 0
        while at < len(ids):
            want.append((d["doc_id"], piece, at, end - at, zlib.crc32(np.array(ids[at:end], "<u4").tobytes())))
            at, end, piece = end, end + size, piece + 1
    key = lambda t: tuple((x is None, x or 0) for x in t)
    assert sorted([tuple(r[:5]) for r in rows], key=key) == sorted(want, key=key)
    places: dict[int, list] = {}
    for r in rows:
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in places.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= size
    return len(places)


def test_rows(llm_spark, messy, no_docs, clashing):
    path = P.path("byte_bpe_50k.json")
    marked = llm_spark.createDataFrame([(300, "a <|endoftext|> b" * 50, "en", "a", 1), (301, "<|endoftext|>", None, "a", 1)], DOC_SCHEMA)
    for table in (messy.union(marked), clashing):
        docs = table.select("doc_id", "text").collect()
        rows = packing.pack_documents(table, path, P.PATTERN, 2, size=128).select(
            "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset").collect()
        check(rows, docs, 128, path)
    assert packing.pack_documents(no_docs, path, P.PATTERN, 2).count() == 0


def test_ranks_do_not_depend_on_buckets(messy):
    cut = packing.pieces(messy, P.path("byte_bpe_50k.json"), P.PATTERN, 2, size=32).cache()
    for bucket_rows in (5, 10_000):
        ranks: dict[int, list[int]] = {}
        for r in packing.ranked(cut, "doc_id", bucket_rows).collect():
            ranks.setdefault(r["length"], []).append(r["rank"])
        assert all(sorted(x) == list(range(len(x))) for x in ranks.values())
