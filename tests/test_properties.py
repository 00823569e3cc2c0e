"""Property tests (hypothesis): skew-safe positions, closed-form gaps, monotone quantiles, MRR <= hit rate."""

import datetime as dt

import numpy as np
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from shoplens.operators import client_stats as cs
from shoplens.operators import ordering as od
from shoplens.operators import rank_metrics as rm
from shoplens.operators import vectors as vx

SETTINGS = settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
T0 = dt.datetime(2024, 1, 1)

# events: (client, minutes after T0, item); client 0 is hot, times repeat so ties are common
events = st.lists(st.tuples(st.sampled_from([0, 0, 0, 1, 2, 3]), st.integers(0, 3 * 24 * 60), st.integers(1, 5)),
                  min_size=1, max_size=60)


def _frame(spark, rows):
    return spark.createDataFrame([(c, T0 + dt.timedelta(minutes=m), i) for c, m, i in rows],
                                 "client_id long, timestamp timestamp_ntz, item long")


@SETTINGS
@given(rows=events)
def test_positions_match_sort_and_ignore_partitioning(spark, rows):
    df = _frame(spark, rows)
    want = {}
    for c in {r[0] for r in rows}:
        mine = sorted((T0 + dt.timedelta(minutes=m), i) for cc, m, i in rows if cc == c)
        for p, (t, i) in enumerate(mine):
            want.setdefault((c, t, i), set()).add(p)
    for d in (df, df.repartition(5)):
        got = {}
        for r in od.positions(d, "client_id", ["timestamp", "item"], rev="rev", materialize=False).collect():
            got.setdefault((r.client_id, r.timestamp, r.item), set()).add(r.pos)
            n = sum(1 for x in rows if x[0] == r.client_id)
            assert r.rev == n - 1 - r.pos
        assert got == want


@SETTINGS
@given(rows=events)
def test_mean_interval_is_mean_of_neighbour_gaps(spark, rows):
    got = {r.client_id: r.mean_x_interval_days for r in cs.mean_interval(_frame(spark, rows), "x").collect()}
    for c, v in got.items():
        ts = sorted(m for cc, m, _ in rows if cc == c)
        gaps = np.diff(ts) / (24 * 60)
        assert abs(v - (gaps.mean() if len(gaps) else 0.0)) < 1e-9


@SETTINGS
@given(xs=st.lists(st.floats(-5, 5, allow_nan=False), min_size=2, max_size=40))
def test_quantile_transform_is_monotone_in_unit_interval(spark, xs):
    t = spark.createDataFrame([(i, [float(x)]) for i, x in enumerate(xs)], "client_id long, embedding array<double>")
    got = sorted((xs[r.client_id], r.embedding[0]) for r in vx.quantile_transform(t).collect())
    ys = [y for _, y in got]
    assert all(0.0 <= y <= 1.0 for y in ys)
    assert all(a <= b + 1e-12 for a, b in zip(ys, ys[1:]))


@SETTINGS
@given(ranks=st.lists(st.one_of(st.none(), st.integers(1, 10)), min_size=1, max_size=30))
def test_mrr_never_exceeds_hit_rate(spark, ranks):
    recs, labels = [], []
    for u, r in enumerate(ranks):
        labels.append((u, 1000))
        for k in range(1, 11):
            recs.append((u, 1000 if r == k else k, k))
    m = rm.ranking(spark.createDataFrame(recs, "user_id long, item_id long, rank long"),
                   spark.createDataFrame(labels, "user_id long, item_id long"), k=10).first()
    assert m.mrr_10 <= m.hit_rate_10 + 1e-12
    assert m.ndcg_10 <= m.hit_rate_10 + 1e-12
    assert abs(m.hit_rate_10 - sum(r is not None for r in ranks) / len(ranks)) < 1e-12


vec_rows = st.lists(st.tuples(st.integers(0, 15), st.lists(st.floats(-3, 3, allow_nan=False), min_size=2, max_size=2)),
                    min_size=1, max_size=12, unique_by=lambda t: t[0])


@SETTINGS
@given(a=vec_rows, b=vec_rows)
def test_outer_merge_key_set_is_symmetric_and_partition_free(spark, a, b):
    ta = spark.createDataFrame(a, "client_id long, embedding array<double>")
    tb = spark.createDataFrame(b, "client_id long, embedding array<double>")
    ab = {r.client_id: r.embedding for r in vx.outer_merge([ta, tb]).collect()}
    ba = {r.client_id: r.embedding for r in vx.outer_merge([tb.repartition(3), ta.repartition(2)]).collect()}
    assert set(ab) == set(ba) == {k for k, _ in a} | {k for k, _ in b}
    for k in ab:
        assert ab[k][:2] == ba[k][2:] and ab[k][2:] == ba[k][:2]


@SETTINGS
@given(rows=vec_rows)
def test_l2_rows_have_unit_norm(spark, rows):
    t = spark.createDataFrame(rows, "client_id long, embedding array<double>")
    for r in vx.l2_normalize(t).collect():
        n = float(np.linalg.norm(r.embedding))
        assert n == 0.0 or abs(n - 1.0) < 1e-9
