"""Hashed token bags, their PCA and the token vectors against numpy and hand-made cases."""

import numpy as np

from shoplens.operators import encoders as en


def _long(spark, rows):
    return spark.createDataFrame(rows, "client_id long, pos long, a string, b long")


def test_no_token_is_left_out(spark):
    rows = [(c, p, f"v{c}-{p}", p) for c in range(5) for p in range(40)] + [(9, 0, None, None)]
    counts = en.token_counts(_long(spark, rows), ["a", "b"])
    entries = en.bag_entries(counts, 16)
    for slots in (16, 4096):
        total = en.bag_entries(counts, slots).selectExpr("client_id", "value").collect()
        assert {r.client_id for r in total} == set(range(5))
    assert entries.groupBy("client_id").count().agg({"count": "max"}).first()[0] <= 16
    wide = en.bag_entries(counts, 1 << 40).groupBy("client_id").agg({"value": "count"}).collect()
    assert all(r[1] == 80 for r in wide)


def test_projection_matches_numpy(spark):
    rng = np.random.default_rng(5)
    rows = [(c, p, f"t{rng.integers(0, 30)}", int(rng.integers(0, 7))) for c in range(60) for p in range(rng.integers(1, 30))]
    long = _long(spark, rows)
    bags = {r.client_id: r.embedding for r in en.bag_vectors(en.bag_entries(en.token_counts(long, ["a", "b"]), 16), 16).collect()}
    x = np.array([bags[c] for c in range(60)])
    got = {r.client_id: r.embedding for r in en.bag_pca(long, ["a", "b"], 4, 16).collect()}
    y = np.array([got[c] for c in range(60)])
    c = x - x.mean(axis=0)
    _, s, vt = np.linalg.svd(c, full_matrices=False)
    for k in range(4):
        assert np.allclose(np.abs(y[:, k]), np.abs(c @ vt[k]), atol=1e-6)
    errors = {r.client_id: r.error for r in en.reconstruction_error(long, ["a", "b"], 4, 16).collect()}
    want = (c ** 2).sum(axis=1) - ((c @ vt[:4].T) ** 2).sum(axis=1)
    assert np.allclose([errors[i] for i in range(60)], want, atol=1e-6)


def test_items_in_the_same_surroundings_get_close_vectors(spark):
    rows = [(c, p, x, 0) for c in range(40) for p, x in enumerate(
        ["l1", "X" if c % 2 else "Y", "r1", "l2", "Z", "r2"])]
    vectors = {}
    for r in en.token_vectors(_long(spark, rows), "a", 64, window=1).collect():
        vectors.setdefault(r.token, np.zeros(64))[r.dim] = r.value
    assert all(abs(np.linalg.norm(v) - 1) < 1e-9 for v in vectors.values())
    assert vectors["X"] @ vectors["Y"] > 0.99 and abs(vectors["X"] @ vectors["Z"]) < 0.7
    clients = {r.client_id: np.array(r.embedding) for r in en.item2vec(_long(spark, rows), "a", 64, window=1).collect()}
    want = np.mean([vectors[x] for x in ("l1", "Y", "r1", "l2", "Z", "r2")], axis=0)
    assert np.allclose(clients[0], want)


def test_left_truncation(spark):
    docs = spark.createDataFrame([(1, "a b c d"), (2, "c d")], "client_id long, text string")
    got = {(r.client_id, r.token): r.n for r in en.text_counts(docs, 2).collect()}
    assert got == {(1, "c"): 1, (1, "d"): 1, (2, "c"): 1, (2, "d"): 1}


def test_client_without_neighbours_gets_zeros(spark):
    got = en.item2vec(_long(spark, [(1, 0, "only", 0)]), "a", 8).first()
    assert got.embedding == [0.0] * 8


def test_sequences_are_not_broadcast_by_their_file_size(spark):
    """A sequence table of few bytes may have many rows; neighbours meet by a shuffle."""
    from shoplens.session import cut_lineage
    events = cut_lineage(spark.range(2000).selectExpr("id % 100 as client_id", "id div 100 as pos", "id % 7 as item"))
    counts = en.neighbour_counts(events, "item", 2)
    assert "BroadcastHashJoin" not in counts._jdf.queryExecution().executedPlan().toString()
    want = {}
    rows = {(r.client_id, r.pos): r.item for r in events.collect()}
    for (c, p), item in rows.items():
        for d in (-2, -1, 1, 2):
            if (c, p + d) in rows:
                want[item, rows[c, p + d]] = want.get((item, rows[c, p + d]), 0) + 1
    assert {(r.token, r.near): r.n for r in counts.collect()} == want


def test_word_bags_are_the_bags_of_the_word_counts(spark):
    """Words were drawn for every client that has them; now once in a worker."""
    from shoplens.operators import encoders as en
    docs = spark.createDataFrame([(1, "To be or  not to be"), (1, "be"), (2, ""), (3, None), (4, "\u00e9t\u00e9 x x"), (None, "x y")],
                                 "client_id long, text string")
    for n in (None, 3):
        got = en.text_entries(docs, n)
        want = en.bag_entries(en.text_counts(docs, n))
        assert got.dtypes == want.dtypes
        assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))
        assert "MapInArrow" in got._jdf.queryExecution().executedPlan().toString()


def test_event_day_bags_look_their_draws_up(spark, sf_dir):
    from shoplens.plans.registry import entries
    plan = entries()["enc_bag_entries"].build(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "_known" in plan
