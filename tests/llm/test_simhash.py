"""Fingerprints and components against brute force."""

import re

import numpy as np
import pytest
import xxhash

from shoplens.llm import components, simhash
from shoplens.llm.simhash import cluster, fingerprint, keep_first, link, near_duplicates

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = WORD.findall(low)
    shingles = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(ids, prints):
    """Smallest id reachable over links of at most 3 bits."""
    parent = list(range(len(ids)))

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(ids)):
        for j in range(i):
            if (int(prints[i]) ^ int(prints[j])).bit_count() <= 3:
                parent[top(i)] = top(j)
    least: dict[int, int] = {}
    for i, x in enumerate(ids):
        if x is not None:
            least[top(i)] = min(least.get(top(i), x), x)
    return [least.get(top(i)) for i in range(len(ids))]


def planted(seed=5):
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 2**63, 60, dtype=np.uint64)
    prints = list(base)
    for b in base[:25]:
        for _ in range(6):
            f = int(b)
            for bit in rng.choice(64, rng.integers(1, 6), replace=False):
                f ^= 1 << int(bit)
            prints.append(f)
    prints += [(int(x) << 32) | 12345 for x in rng.integers(0, 2**32, 120)]         # many share a half
    prints += [(77 << 32) | sum(1 << int(k) for k in rng.choice(10, rng.integers(0, 10), replace=False))
               for _ in range(120)]                                                # a dense ball
    return np.unique(np.array([int(x) for x in prints] + [0], dtype=np.uint64))


@pytest.mark.parametrize("meet", [8192, 40])
def test_components_equal_brute_force(llm_spark, meet):
    prints = planted()
    df = llm_spark.createDataFrame([(int(x),) for x in prints.view(np.int64)], "fp long").repartition(5)
    found = link(df, 3, meet)
    pairs = found.collect()
    signed = {int(x) for x in prints.view(np.int64)}
    assert all(r["u"] in signed and r["v"] in signed for r in pairs)
    roots = {r["node"]: r["component"] for r in components.components(found).collect()}
    ids = [int(x) for x in prints.view(np.int64)]
    assert [roots.get(x, x) for x in ids] == brute_components(ids, prints)


def test_link_refuses_more_than_three_bits(llm_spark):
    with pytest.raises(ValueError):
        link(llm_spark.createDataFrame([], "fp long"), 4)


@pytest.mark.parametrize("text", ["", " \n", "One", "A b", "a B c", "ÄÖ x ÄÖ\x1c y z", "a b c " * 50])
def test_fingerprint(text):
    assert int.from_bytes(fingerprint(text.encode()), "big") == brute_fingerprint(text)


def test_fingerprint_does_not_depend_on_blocks(monkeypatch):
    text = " ".join(f"w{i % 97}" for i in range(5000)).encode()
    whole = fingerprint(text)
    monkeypatch.setattr(simhash, "byte_blocks", lambda data: __import__(
        "shoplens.llm.common", fromlist=["x"]).byte_blocks(data, 100))
    assert fingerprint(text) == whole


def test_rows(messy, no_docs, clashing):
    docs = messy.collect()
    prints = [brute_fingerprint(d["text"]) for d in docs]
    want = sorted(((d["doc_id"], f"{p:016x}", c) for d, p, c in zip(
        docs, prints, brute_components([d["doc_id"] for d in docs], prints))), key=str)
    for table in (messy, clashing):
        assert sorted((tuple(r) for r in near_duplicates(table).collect()), key=str) == want
    assert near_duplicates(no_docs).count() == 0


def test_one_of_each_group_stays(messy, no_docs):
    kept = keep_first(messy).collect()
    prints = [brute_fingerprint(d["text"]) for d in kept]
    assert len({c for c in prints}) == len(kept)
    groups = set(zip(brute_components(list(range(messy.count())), [brute_fingerprint(d["text"]) for d in messy.collect()])))
    assert len(kept) == len(groups)
    assert {1, 3, 6} <= {d["doc_id"] for d in kept} and 2 not in {d["doc_id"] for d in kept}
    assert kept[0].asDict().keys() == set(messy.columns)
    assert keep_first(no_docs).count() == 0


def test_long_chain_is_one_component(llm_spark):
    n = 300
    df = llm_spark.createDataFrame([(i, i + 1) for i in range(n)] + [(1000, 1000)], "u long, v long")
    got = {r["node"]: r["component"] for r in components.components(df).collect()}
    assert got == {i: 0 for i in range(n + 1)}


def test_forest_keeps_connectivity():
    rng = np.random.default_rng(0)
    u, v = rng.integers(0, 200, 150), rng.integers(0, 200, 150)
    a, b = components.forest(u, v)
    parent = list(range(200))

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for x, y in zip(u, v):
        parent[max(top(x), top(y))] = min(top(x), top(y))
    assert all(top(x) == y for x, y in zip(a, b))
    assert len(a) == len({x for x in [*u, *v]}) - len({top(x) for x in [*u, *v]})


def test_cluster_names_first_rows(llm_spark):
    tagged = llm_spark.createDataFrame([(5, 0, 1), (3, 1, 2), (None, 3, 3), (9, 2**40 - 1, 4)], "doc_id long, fp long, __row long")
    got = {r["fp"]: (r["component_id"], r["first_row"]) for r in cluster(tagged).collect()}
    assert got == {0: (3, 2), 1: (3, 2), 3: (3, 2), 2**40 - 1: (9, 4)}
