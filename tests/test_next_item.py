"""Next-item recommendation and ranking metrics against a brute-force Python model."""

import math
import random
from collections import Counter

from shoplens.operators import next_item as ni
from shoplens.operators import rank_metrics as rm


def _history(seed=3, clients=60, items=25):
    rnd = random.Random(seed)
    rows = []
    for c in range(clients):
        for p in range(rnd.randint(1, 12)):
            rows.append((c, p, rnd.randint(1, items) if rnd.random() < 0.8 else rnd.randint(1, 4)))
    return rows


def _brute(rows, k, filter_seen):
    seqs = {}
    for c, p, i in sorted(rows):
        seqs.setdefault(c, []).append(i)
    succ = Counter()
    for s in seqs.values():
        succ.update(zip(s, s[1:]))
    pop = Counter(i for _, _, i in rows)
    pop_order = sorted(pop, key=lambda i: (-pop[i], i))
    out = {}
    for c, s in seqs.items():
        seen = set(s) if filter_seen else set()
        cand = sorted(((n, cnt) for (p, n), cnt in succ.items() if p == s[-1] and n not in seen),
                      key=lambda t: (-t[1], t[0]))[:k]
        picks = [(n, float(cnt)) for n, cnt in cand]
        chosen = {n for n, _ in picks}
        for i in pop_order:
            if len(picks) >= k:
                break
            if i not in seen and i not in chosen:
                picks.append((i, 0.0))
        out[c] = picks
    return out


def _spark_recs(spark, rows, k, filter_seen):
    h = spark.createDataFrame(rows, "client_id long, pos long, item long")
    got = {}
    for r in ni.recommend(h, k, filter_seen).collect():
        got.setdefault(r.user_id, []).append((r.rank, r.item_id, r.prediction))
    return {c: [(i, p) for _, i, p in sorted(v)] for c, v in got.items()}


def test_recommend_unseen_matches_brute_force(spark):
    rows = _history()
    assert _spark_recs(spark, rows, 5, True) == _brute(rows, 5, True)


def test_recommend_with_seen_matches_brute_force(spark):
    rows = _history(seed=11)
    assert _spark_recs(spark, rows, 4, False) == _brute(rows, 4, False)


def test_ranking_metrics(spark):
    recs = spark.createDataFrame([(1, 10, 1), (1, 11, 2), (2, 20, 1), (2, 21, 2), (3, 30, 1)],
                                 "user_id long, item_id long, rank long")
    labels = spark.createDataFrame([(1, 11), (2, 20), (3, 99), (4, 1)], "user_id long, item_id long")
    r = rm.ranking(recs, labels, k=2).first()
    assert r.users == 3
    assert math.isclose(r.hit_rate_1, 1 / 3) and math.isclose(r.hit_rate_2, 2 / 3)
    assert math.isclose(r.mrr_2, (0.5 + 1.0) / 3)
    assert math.isclose(r.ndcg_2, (1 / math.log2(3) + 1.0) / 3)


def test_recommendations_are_made_once(spark):
    h = spark.createDataFrame(_history(), "client_id long, pos long, item long")
    recs = ni.recommend(h, 5, False)
    plan = recs._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("row_number") == 0                     # the picks are written: the result and the top-up read them
    labels = spark.createDataFrame([(0, 1)], "user_id long, item_id long")
    plan = rm.ranking(recs, labels, 5)._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" not in plan                               # users and hits read one table
