"""Queries without an SQL oracle: invariants on the whole small tables (rows-only in the driver check)."""

import numpy as np
import pytest

from shoplens.plans.registry import entries

NOSQL = sorted(n for n, e in entries().items() if e.sql is None)


@pytest.mark.parametrize("name", NOSQL)
def test_runs_with_stable_schema(spark, sf_dir, name):
    df = entries()[name].build(spark, sf_dir)
    schema = df.schema
    rows = df.collect()
    assert entries()[name].build(spark, sf_dir).schema == schema
    assert len(rows) > 0


def _vectors(spark, sf_dir, name):
    return {r.client_id: np.asarray(r.embedding, dtype=float) for r in entries()[name].build(spark, sf_dir).collect()}


@pytest.mark.parametrize("name,width", [("als_categories", 64), ("als_urls", 64), ("als_signed", 64),
                                        ("enc_bag_pca", 64), ("enc_item2vec", 64), ("enc_text", 64),
                                        ("enc_text_searches", 64), ("enc_event_day", 64), ("enc_sku_text", 64)])
def test_vector_tables(spark, sf_dir, name, width):
    v = _vectors(spark, sf_dir, name)
    widths = {len(x) for x in v.values()}
    assert len(widths) == 1 and widths.pop() <= width
    assert all(np.isfinite(x).all() for x in v.values())
    assert len(v) < 20 or len({tuple(np.round(x, 6)) for x in v.values()}) > 10          # no constant vector


def test_als_is_repeatable(spark, sf_dir):
    a = _vectors(spark, sf_dir, "als_urls")
    b = _vectors(spark, sf_dir, "als_urls")
    assert a.keys() == b.keys()
    assert all(np.allclose(a[k], b[k], atol=1e-4) for k in a)


def _plain_negatives(spark, histories, K, n, seed):
    """The draws of every client by its polynomial, looked up in the sorted list of its unseen items."""
    from shoplens.operators import sequences as sq
    rows = spark.createDataFrame([(c,) for c in histories], "client_id long").select("client_id", *sq.draw_coefficients("client_id", seed))
    out = {}
    for c, c0, c1, c2 in rows.collect():
        free = [i for i in range(1, K + 1) if i not in histories[c]]
        out[c] = [free[((c2 * j + c1) % sq.DRAW_PRIME * j + c0) % sq.DRAW_PRIME % len(free)] for j in range(n)] if free else []
    return out


@pytest.mark.parametrize("limit", [511, 3, 0])
def test_negatives_are_the_drawn_unseen_items(spark, limit):
    import random

    from shoplens.operators import sequences as sq
    rng = random.Random(limit)
    K = 3000
    histories = {c: set(rng.sample(range(1, K + 1), rng.choice([1, 2, 5, 60]))) for c in range(12)}
    histories |= {50: set(range(1, K + 1)), 51: set(range(1, K)), 52: set(range(1, 1500)), 53: set(range(2, K + 1, 2))}
    rows = [(c, i) for c, s in histories.items() for i in s] + [(0, next(iter(histories[0])))]      # a repeated event
    df = spark.createDataFrame(rows, "client_id long, item long")
    total = spark.createDataFrame([(K,)], "K long")
    got = {c: [] for c in histories}
    for r in sorted(sq.negatives(df, total, n=200, limit=limit).collect(), key=lambda r: r["place"]):
        got[r["client_id"]].append(r["item"])
    assert got == _plain_negatives(spark, histories, K, 200, 42)
    assert all(not set(v) & histories[c] for c, v in got.items())


def test_als_factors_solve_the_weighted_least_squares(spark, sf_dir):
    from shoplens.operators import factors
    from shoplens.operators import interactions as ia
    from shoplens.sources.inputs import load_fixture
    cells = ia.signed(load_fixture(spark, sf_dir))                   # weights of both signs
    users, items = factors.fit_als(cells, "sku", "action", rank=8, max_iter=3)
    implied = {r.client_id: np.array(r.embedding) for r in factors.half_step(cells, items, "sku", "action").collect()}
    held = {r.client_id: np.array(r.embedding) for r in users.collect()}
    assert implied.keys() <= held.keys() and len(implied) > 50
    for c, x in implied.items():
        assert np.abs(x - held[c]).max() <= 1e-3 * max(1.0, np.abs(x).max())


def test_half_step_is_the_plain_solution(spark):
    from shoplens.operators import factors
    rng = np.random.default_rng(4)
    y = rng.normal(size=(6, 3))
    cells = [(1, 0, 2.0), (1, 3, 1.0), (2, 1, -1.5), (2, 2, 0.5), (3, 5, 4.0), (4, 0, 0.0)]
    items = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(y)], "sku long, embedding array<double>")
    got = {r.client_id: np.array(r.embedding) for r in factors.half_step(
        spark.createDataFrame(cells, "client_id long, sku long, weight double"), items, "sku", reg=0.1, alpha=2.0).collect()}
    for u in (1, 2, 3):
        a, b = y.T @ y, np.zeros(3)
        for c, i, w in cells:
            if c == u:
                a += 2 * abs(w) * np.outer(y[i], y[i]) + (0.1 * np.eye(3) if w > 0 else 0)
                b += (1 + 2 * abs(w)) * y[i] * (w > 0)
        assert np.allclose(got[u], np.linalg.solve(a, b))
    assert 4 not in got                                                  # no cell of weight other than 0


def test_side_codes_change_the_signed_factors(spark, sf_dir):
    from shoplens.operators import factors
    from shoplens.operators import interactions as ia
    from shoplens.sources.inputs import load_fixture
    inputs = load_fixture(spark, sf_dir)
    s = ia.signed(inputs)
    search, names = ia.search_codes(inputs), ia.item_codes_long(inputs.product_properties, s)

    def vectors(a, b):
        return {r.client_id: np.array(r.embedding) for r in factors.als_signed(s, a, b, rank=4).collect()}

    whole, no_search, no_names = vectors(search, names), vectors(search.limit(0), names), vectors(search, names.limit(0))
    assert whole.keys() == no_search.keys() == no_names.keys()
    for other in (no_search, no_names):
        assert np.mean([np.abs(whole[c] - other[c]).max() > 1e-3 for c in whole]) > 0.5


def test_random_slice_lengths(spark):
    from shoplens.operators import sequences as sq
    df = spark.createDataFrame([(i, list(range(i))) for i in range(1, 40)], "client_id long, a array<long>")
    for r in sq.random_slice(df, ["a"], 3, 8).collect():
        n = r.client_id
        assert min(n, 3) <= len(r.a) <= min(n, 8)
        assert r.a == list(range(r.a[0], r.a[0] + len(r.a))) if r.a else True


def test_apply_encoder_batches(spark):
    from shoplens.operators import encoders as en
    docs = spark.createDataFrame([(1, "a bb"), (2, "ccc"), (3, None)], "client_id long, text string")
    out = {r.client_id: r.embedding for r in en.apply_encoder(
        docs, lambda texts: np.array([[len(t), 1.0] for t in texts]), 2).collect()}
    assert out == {1: [4.0, 1.0], 2: [3.0, 1.0], 3: [0.0, 1.0]}


def test_batches_stay_within_the_budget(spark):
    from shoplens.operators import encoders as en
    assert en.batches_of([5, 5, 3, 1], 10) == [(0, 2), (2, 4)] and en.batches_of([99, 1, 0], 10) == [(0, 1), (1, 3)]
    assert en.batches_of([], 10) == []
    texts = [(i, "w " * (i * 37 % 101)) for i in range(300)] + [(300, "w " * 5000), (301, None)]
    docs = spark.createDataFrame(texts, "client_id long, text string").repartition(4)
    sizes = spark.sparkContext.accumulator(0)

    def encode(batch):
        words = [len(t.split()) for t in batch]
        assert len(batch) == 1 or max(*words, 1) * len(words) <= 400, words
        assert words == sorted(words, reverse=True)
        sizes.add(1)
        return np.array([[n, len(batch)] for n in words], dtype=float)

    got = {r.client_id: r.embedding for r in en.apply_encoder(docs, encode, 2, budget=400).collect()}
    assert {c: int(v[0]) for c, v in got.items()} == {i: len((t or "").split()) for i, t in texts}
    assert sizes.value > 30


def test_random_slice_long_equals_array_slice(spark):
    from shoplens.operators import sequences as sq
    rows = [(c, p, c * 100 + p) for c in range(1, 30) for p in range(c)]
    long = spark.createDataFrame(rows, "client_id long, pos long, v long")
    arr = sq.arrays(long, ["v"])
    want = {r.client_id: r.v for r in sq.random_slice(arr, ["v"], 4, 9).collect()}
    got = {}
    for r in sq.random_slice_long(long, 4, 9).orderBy("client_id", "pos").collect():
        got.setdefault(r.client_id, []).append(r.v)
    assert got == want


def test_half_step_of_clients_with_many_cells_and_across_batches(spark, monkeypatch):
    """Clients below and above the bound, a null client and cells that batches cut apart give the plain solution."""
    from shoplens.operators import factors
    monkeypatch.setattr(factors, "MANY_CELLS", 30)
    rng = np.random.default_rng(5)
    y = rng.normal(size=(50, 4))
    cells = [(c, int(i), float(rng.choice([-1, 0, 1, 2]))) for c, n in ((1, 5), (2, 29), (3, 50), (None, 7), (5, 30))
             for i in rng.choice(50, n, replace=False)]
    items = spark.createDataFrame([(i, y[i].tolist()) for i in range(50)], "sku long, embedding array<double>")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 4)
    try:
        step = factors.half_step(spark.createDataFrame(cells, "client_id long, sku long, weight double"), items, "sku", reg=0.1)
        plan = step._jdf.queryExecution().optimizedPlan().toString()
        got = {r.client_id: np.array(r.embedding) for r in step.collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert "RepartitionByExpression" in plan                             # cells travel, not a matrix for each of them
    assert got.keys() == {1, 2, 3, None, 5}
    for u in got:
        a, b = y.T @ y, np.zeros(4)
        for c, i, w in cells:
            if c == u:
                a += abs(w) * np.outer(y[i], y[i]) + (0.1 * np.eye(4) if w > 0 else 0)
                b += (1 + abs(w)) * y[i] * (w > 0)
        assert np.allclose(got[u], np.linalg.solve(a, b))


def test_solver_drops_its_shuffle_files_in_every_iteration(spark, monkeypatch):
    """ALS removes shuffle files only where it checkpoints; between checkpoints they add up."""
    from pyspark.ml.recommendation import ALS

    from shoplens.operators import factors
    seen, real = [], ALS.fit
    monkeypatch.setattr(ALS, "fit", lambda self, data: seen.append(self.getCheckpointInterval()) or real(self, data))
    cells = spark.createDataFrame([(c, i, 1.0) for c in range(6) for i in range(4) if (c + i) % 3], "client_id long, sku long, weight double")
    assert factors.als(cells, "sku", rank=2, max_iter=2).count() == 6
    assert seen == [1]


@pytest.mark.parametrize("few", [256, 0])
@pytest.mark.parametrize("n_items", [5, 20])
def test_few_items_are_sent_instead_of_the_clients(spark, monkeypatch, few, n_items):
    """Spark's solver ships each client's factors to nearly every item block; with few items only item sums travel."""
    from pyspark.ml.recommendation import ALS

    from shoplens.operators import factors
    fits, real = [], ALS.fit
    monkeypatch.setattr(ALS, "fit", lambda self, data: fits.append(1) or real(self, data))
    monkeypatch.setattr(factors, "MANY_CLIENTS", 40)
    monkeypatch.setattr(factors, "FEW_ITEMS", few)
    monkeypatch.setattr(factors, "SOLVED_AT_ONCE", 7)
    rng = np.random.default_rng(n_items)
    rows = [(u, 100 + int(i), float(rng.choice([-1.5, 0.5, 3.0]))) for u in range(60) for i in rng.choice(n_items, 4, replace=False)]
    rows += [(None, 101, 1.0), (61, None, 1.0)] + [(60, 100, -2.0)] * (few > 0)     # no client; no item; nothing preferred
    cells = spark.createDataFrame(rows, "client_id long, sku long, weight double")
    users, items = factors.fit_als(cells, "sku", rank=8, max_iter=6, reg=0.1)
    y = {r.sku: np.array(r.embedding) for r in items.collect()}
    got = {r.client_id: np.array(r.embedding) for r in users.collect()}
    assert len(fits) == (0 if few else 1)
    assert users.schema["embedding"].dataType.simpleString() == "array<float>" and items.columns == ["sku", "embedding"]
    assert sorted(got) == list(range(61 if few else 60)) and sorted(y) == sorted({i for u, i, _ in rows if u is not None and i is not None})
    g, loss = sum(np.outer(v, v) for v in y.values()), 0.0
    for u in got:
        own = [(y[i], w) for c, i, w in rows if c == u]
        a = g + sum(abs(w) * np.outer(v, v) for v, w in own) + 0.1 * sum(w > 0 for _, w in own) * np.eye(8)
        b = sum((1 + abs(w)) * v * (w > 0) for v, w in own)
        assert np.abs(got[u] - (np.linalg.solve(a, b) if b.any() else 0)).max() < 1e-3
        loss += sum((1 + abs(w)) * ((w > 0) - got[u] @ v) ** 2 for v, w in own)
    assert loss < 0.5 * sum(1 + abs(w) for _, _, w in rows)
