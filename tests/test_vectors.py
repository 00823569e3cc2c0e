"""Vector operators (V1-V9, J8-J9) against numpy brute force on small tables."""

import threading
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from shoplens.operators import vectors as vx


def _table(spark, rows):
    return spark.createDataFrame([(i, [float(x) if x is not None else None for x in v]) for i, v in rows],
                                 "client_id long, embedding array<double>")


def _as_dict(df):
    return {r.client_id: r.embedding for r in df.collect()}


def test_sanitize_and_normalize(spark):
    t = _table(spark, [(1, [0, 0]), (2, [3, 4]), (3, [0, -2])])
    assert sorted(_as_dict(vx.sanitize(t))) == [2, 3]
    assert sorted(_as_dict(vx.sanitize(t, drop_zeros=False))) == [1, 2, 3]
    n = _as_dict(vx.l2_normalize(t))
    assert n[1] == [0.0, 0.0] and np.allclose(n[2], [0.6, 0.8]) and np.allclose(n[3], [0.0, -1.0])


def test_outer_merge_complete_impute(spark):
    a = _table(spark, [(1, [1, 2]), (2, [3, 4])])
    b = _table(spark, [(2, [10]), (3, [30])])
    m = _as_dict(vx.outer_merge([a, b]))
    assert m == {1: [1.0, 2.0, None], 2: [3.0, 4.0, 10.0], 3: [None, None, 30.0]}
    rel = spark.createDataFrame([(1,), (3,), (4,)], "client_id long")
    c = vx.complete(vx.outer_merge([a, b]), rel, fill=None)
    got = _as_dict(vx.impute_mean(c))
    # means over relevant rows only: pos0 = 1, pos1 = 2, pos2 = 30
    assert got == {1: [1.0, 2.0, 30.0], 3: [1.0, 2.0, 30.0], 4: [1.0, 2.0, 30.0]}
    assert _as_dict(vx.impute_constant(c))[4] == [0.0, 0.0, 0.0]


def test_quantile_small_matches_mid_rank(spark):
    rng = np.random.default_rng(1)
    x = rng.integers(0, 5, size=(40, 3)).astype(float)
    t = _table(spark, [(i, list(r)) for i, r in enumerate(x)])
    got = _as_dict(vx.quantile_transform(t))
    n = len(x)
    for j in range(x.shape[1]):
        col = x[:, j]
        s = np.sort(col)
        for i, v in enumerate(col):
            lo, hi = np.searchsorted(s, v, "left"), np.searchsorted(s, v, "right") - 1
            want = 0.0 if v == s[0] else 1.0 if v == s[-1] else (lo + hi) / 2 / (n - 1)
            assert abs(got[i][j] - want) < 1e-9


def test_pca_matches_numpy_up_to_sign(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(200, 6)) @ rng.normal(size=(6, 6))
    t = _table(spark, [(i, list(r)) for i, r in enumerate(x)])
    got = _as_dict(vx.pca(t, 3))
    y = np.array([got[i] for i in range(len(x))])
    c = x - x.mean(axis=0)
    _, _, vt = np.linalg.svd(c, full_matrices=False)
    ref = c @ vt[:3].T
    for k in range(3):
        assert np.allclose(np.abs(y[:, k]), np.abs(ref[:, k]), atol=1e-6)


def test_global_standard(spark):
    t = _table(spark, [(1, [1, 2]), (2, [3, 4])])
    got = _as_dict(vx.scale_global_standard(t))
    cells = np.array([1, 2, 3, 4], dtype=float)
    z = (cells - cells.mean()) / cells.std()
    assert np.allclose(got[1] + got[2], z)


def test_quantile_grid_is_exact_above_and_below_its_size(spark):
    rng = np.random.default_rng(4)
    for n, m in ((1, 1000), (2, 1000), (37, 1000), (300, 50), (2500, 1000)):
        x = np.stack([rng.normal(size=n), rng.integers(0, 9, n).astype(float)], axis=1)
        grid = vx.quantile_grid(_table(spark, list(enumerate(x.tolist()))), m)
        want = np.quantile(x, np.linspace(0, 1, min(m, n)), axis=0).T
        assert all(np.allclose(g, w, atol=1e-12) for g, w in zip(grid, want)), n


def test_outer_merge_refuses_duplicates_and_mixed_widths(spark):
    a, b = _table(spark, [(1, [1, 2]), (1, [3, 4])]), _table(spark, [(1, [5])])
    with pytest.raises(Exception, match="several rows in left: 1"):
        vx.outer_merge([a, b], ["left", "right"]).collect()
    with pytest.raises(Exception, match="mixed widths in table 1"):
        vx.outer_merge([b, _table(spark, [(1, [5]), (2, [5, 6])])]).collect()


def test_outer_merge_with_an_empty_table(spark):
    a, empty = _table(spark, [(1, [1, 2])]), _table(spark, [(2, [0, 0])])
    assert _as_dict(vx.outer_merge([a, vx.sanitize(empty)])) == {1: [1.0, 2.0]}


def test_quantile_grid_takes_the_same_edges_everywhere(spark, monkeypatch):
    """Approximate percentiles differ between evaluations where partial results meet in another order; here always."""
    real = vx.F.percentile_approx

    def moving(x, probs, accuracy):
        by = vx.F.expr("cast(java_method('java.lang.Math', 'random') as double)")
        return vx.F.transform(real(x, probs, accuracy), lambda c: c + by)

    monkeypatch.setattr(vx.F, "percentile_approx", moving)
    x = np.random.default_rng(4).normal(size=(3000, 2))
    grid = vx.quantile_grid(_table(spark, list(enumerate(x.tolist()))), 100)
    assert np.allclose(grid, np.quantile(x, np.linspace(0, 1, 100), axis=0).T, atol=1e-12)


def test_a_row_is_normalized_in_time_that_rises_with_its_width(spark):
    """the length was computed anew for each number of the row."""
    wide = spark.range(1).select(F.col("id").alias("client_id"), F.sequence(F.lit(1), F.lit(20_000)).cast("array<double>").alias("embedding"))
    start = time.perf_counter()
    got = np.array(vx.l2_normalize(wide).first()["embedding"])
    assert time.perf_counter() - start < 10
    x = np.arange(1, 20_001)
    assert np.allclose(got, x / np.linalg.norm(x), rtol=1e-12)


def test_the_tables_of_a_run_are_made_at_the_same_time(spark):
    """the tables of a run do not wait for each other."""
    from shoplens.plans import q_vec
    both = threading.Barrier(2, timeout=60)

    def table(shift):
        both.wait()
        return spark.createDataFrame([(i, [i + shift, 1.0]) for i in range(4)], "client_id long, embedding array<double>")

    config = {"save_name": "two", "submit": True, "embeddings_list": [{"name": "a"}, {"name": "b"}],
              "imputer": {"name": "SimpleImputer", "strategy": "mean"}}
    got = q_vec._run_over(spark, config, {"a": lambda: table(1.0), "b": lambda: table(2.0)}, spark.range(3).withColumnRenamed("id", "client_id"))
    assert {r.client_id: r.embedding for r in got.collect()} == {i: [i + 1.0, 1.0, i + 2.0, 1.0] for i in range(3)}
