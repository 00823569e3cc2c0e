"""Links, counts and components against brute force; the walk against a sort of all cells."""

import numpy as np

from shoplens.llm import multi_index as mi

SCHEMA = "vec_id long, embedding array<float>, label int, n_links long, v string, node string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 0, 9, "x", "y") for i, v in rows], SCHEMA).repartition(4)


def brute(rows, least=0.9):
    good = [v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v) for _, v in rows]
    unit = [np.array(v, dtype=np.float32).astype(float) if g else None for (_, v), g in zip(rows, good)]
    unit = [u / np.linalg.norm(u) if u is not None else None for u in unit]
    parent = list(range(len(rows)))

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    links = [0] * len(rows)
    for i in range(len(rows)):
        for j in range(i):
            if good[i] and good[j] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= least:
                links[i] += 1
                links[j] += 1
                parent[top(i)] = top(j)
    least_id: dict[int, int] = {}
    for i, (key, _) in enumerate(rows):
        if key is not None:
            least_id[top(i)] = min(least_id.get(top(i), key), key)
    comps = [least_id.get(top(i)) for i in range(len(rows))]
    return sorted([(key, n, c, key == c) for (key, _), n, c in zip(rows, links, comps)], key=str)


def planted(n=300, size=16, seed=0, near=40, bases=8):
    rng = np.random.default_rng(seed)
    rows = [(i, rng.normal(size=size).tolist()) for i in range(n)]
    for i in range(near):                                   # neighbours of cosine about 0.9 to 1
        base = np.array(rows[i % bases][1])
        rows.append((n + i, (base + rng.normal(size=size) * rng.uniform(0.01, 0.3)).tolist()))
    rows += [(5000 + i, rows[3][1]) for i in range(5)] + [(5010, (2 * np.array(rows[3][1])).tolist())]
    return rows


def test_pairs_equal_brute_force_when_all_cells_are_visited(llm_spark, monkeypatch):
    rows = planted()
    monkeypatch.setattr(mi, "BLOCK", 32)                    # many blocks per cell
    got = [tuple(r) for r in mi.near_duplicates(frame(llm_spark, rows), recall=1.0).collect()]
    assert sorted(got, key=str) == brute(rows)


def test_recall_of_the_default(llm_spark, monkeypatch):
    rows = planted(1500, 16, 3, 400, 200)
    monkeypatch.setattr(mi, "CELL", 40)
    got = {r["vec_id"]: r["n_links"] for r in mi.near_duplicates(frame(llm_spark, rows)).collect()}
    want = {r[0]: r[1] for r in brute(rows)}
    assert all(got[k] <= want[k] for k in want)
    assert sum(got.values()) >= 0.9 * sum(want.values())


def test_odd_rows(llm_spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, None), (4, []), (5, [0.0, 0.0]), (6, [nan, 1.0]), (7, [inf, 1.0]),
            (8, [None, 1.0]), (9, [1.0, 0.0, 0.0]), (10, [1.0, 0.0, 0.0]), (None, [1.0, 0.01]), (None, None),
            (11, [1.0, 0.0]), (11, [1.0, 0.0]), (12, [-1.0, 0.0]), (13, [5.0]), (14, [1e-30, 0.0]), (None, [0.0, -7.0])]
    got = [tuple(r) for r in mi.near_duplicates(frame(llm_spark, rows)).collect()]
    want = [(k, n, c, k == c) for k, n, c, _ in brute(rows)]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_empty_table(llm_spark):
    assert mi.near_duplicates(frame(llm_spark, [])).count() == 0
    only = mi.near_duplicates(frame(llm_spark, [(1, None)])).collect()
    assert [tuple(r) for r in only] == [(1, 0, 1, True)]


def test_walk_is_in_order():
    rng = np.random.default_rng(1)
    grid = mi.Grid(rng.normal(size=(6, 4)), rng.normal(size=(5, 4)))
    u = rng.normal(size=(20, 8))
    d1, d2 = grid.distances(u)
    for visits in (1, 7, 30):
        walk = grid.walk(u, visits)
        for r in range(len(u)):
            sums = (d1[r][:, None] + d2[r][None, :]).ravel()
            assert np.allclose(np.sort(sums)[:visits], sums[walk[r]])
            assert len(set(walk[r].tolist())) == visits
