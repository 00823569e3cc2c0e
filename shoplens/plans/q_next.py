"""Next-item and metric queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.draws import draw_sql
from ..operators import next_item as nx
from ..operators import rank_metrics as rm
from ..operators import sequences as sq
from ..session import cut_lineage
from ..sources.inputs import load_fixture
from .q_seq import CART_SEQ_CTES, VISIT_CTES, VISIT_MIN
from .registry import register
from .sqlkit import r6, with_bindings

K = 10


def visit_history(spark, sf_dir):
    """Held-out split of the visit sequences: (inputs long form, labels)."""
    v = sq.visits(load_fixture(spark, sf_dir), VISIT_MIN)
    hist = v.where(F.col("time_idx_reversed") > 0).select(
        "client_id", F.col("time_idx").alias("pos"), F.col("url_code").alias("item"))
    labels = v.where(F.col("time_idx_reversed") == 0).select(
        F.col("client_id").alias("user_id"), F.col("url_code").alias("item_id"))
    return hist, labels


HIST_CTES = VISIT_CTES + [
    ("hist", "SELECT client_id, time_idx AS pos, url_code AS item FROM vs WHERE time_idx_reversed > 0"),
    ("labels", "SELECT client_id AS user_id, url_code AS item_id FROM vs WHERE time_idx_reversed = 0"),
    ("succ", """SELECT a.item AS prev, b.item AS next, count(*) AS count FROM hist a
                JOIN hist b ON a.client_id = b.client_id AND b.pos = a.pos + 1 GROUP BY a.item, b.item"""),
    ("pop", "SELECT item, count(*) AS cnt, row_number() OVER (ORDER BY count(*) DESC, item) AS pr FROM hist GROUP BY item"),
    ("lastv", "SELECT client_id, arg_max(item, pos) AS last FROM hist GROUP BY client_id"),
    ("seen", "SELECT DISTINCT client_id, item FROM hist"),
]


def _recs_ctes(filter_seen: bool):
    seen_f = ("AND NOT EXISTS (SELECT 1 FROM seen WHERE seen.client_id = l.client_id AND seen.item = s.next)"
              if filter_seen else "")
    seen_p = ("AND NOT EXISTS (SELECT 1 FROM seen WHERE seen.client_id = n.client_id AND seen.item = p.item)"
              if filter_seen else "")
    return [
        ("cand", f"""SELECT l.client_id, s.next AS item_id, CAST(s.count AS DOUBLE) AS prediction
                     FROM lastv l JOIN succ s ON l.last = s.prev WHERE TRUE {seen_f}"""),
        ("topr", f"""SELECT *, row_number() OVER (PARTITION BY client_id ORDER BY prediction DESC, item_id) AS rank
                     FROM cand QUALIFY rank <= {K}"""),
        ("ntop", "SELECT l.client_id, count(t.item_id) AS n FROM lastv l LEFT JOIN topr t USING (client_id) GROUP BY l.client_id"),
        ("fillr", f"""SELECT n.client_id, p.item AS item_id, 0.0 AS prediction,
                        n.n + row_number() OVER (PARTITION BY n.client_id ORDER BY p.pr) AS rank
                      FROM ntop n CROSS JOIN pop p
                      WHERE n.n < {K} {seen_p}
                        AND NOT EXISTS (SELECT 1 FROM topr t WHERE t.client_id = n.client_id AND t.item_id = p.item)
                      QUALIFY rank <= {K}"""),
        ("recs", """SELECT client_id AS user_id, item_id, prediction, CAST(rank AS BIGINT) AS rank FROM topr
                    UNION ALL SELECT client_id, item_id, prediction, CAST(rank AS BIGINT) FROM fillr"""),
    ]


@register("successor_counts", with_bindings(*HIST_CTES, body="SELECT prev, next, count FROM succ"))
def successor_counts(spark, sf_dir):
    """K7 fit: transition counts between consecutive visits (held-out last visit excluded)."""
    hist, _ = visit_history(spark, sf_dir)
    return nx.successors(hist)


@register("next_item_topk", with_bindings(*HIST_CTES, *_recs_ctes(False), body=f"SELECT user_id, item_id, {r6('prediction')} AS prediction, rank FROM recs"))
def next_item_topk(spark, sf_dir):
    """K7 + T3 + K11: top-10 next urls per client, popularity top-up, seen items allowed."""
    hist, _ = visit_history(spark, sf_dir)
    return nx.recommend(hist, K, filter_seen=False)


@register("next_item_unseen", with_bindings(*HIST_CTES, *_recs_ctes(True), body=f"SELECT user_id, item_id, {r6('prediction')} AS prediction, rank FROM recs"))
def next_item_unseen(spark, sf_dir):
    """T4: top-10 next urls per client excluding urls it has visited."""
    hist, _ = visit_history(spark, sf_dir)
    return nx.recommend(hist, K, filter_seen=True)


@register("metrics_rank", with_bindings(*HIST_CTES, *_recs_ctes(True), body=f"""
    SELECT CAST(count(*) AS BIGINT) AS users,
           {r6("avg(CASE WHEN r.rank = 1 THEN 1.0 ELSE 0.0 END)")} AS hit_rate_1,
           {r6("avg(CASE WHEN r.rank IS NOT NULL THEN 1.0 ELSE 0.0 END)")} AS hit_rate_10,
           {r6("avg(coalesce(1.0 / r.rank, 0.0))")} AS mrr_10,
           {r6("avg(coalesce(1.0 / log2(r.rank + 1), 0.0))")} AS ndcg_10
    FROM labels l LEFT JOIN recs r ON l.user_id = r.user_id AND l.item_id = r.item_id AND r.rank <= 10
    WHERE l.user_id IN (SELECT user_id FROM recs)"""))
def metrics_rank(spark, sf_dir):
    """G1-G4 + J10: hit rate @1/@10, MRR@10, NDCG@10 of the unseen recommendations."""
    hist, labels = visit_history(spark, sf_dir)
    return rm.ranking(nx.recommend(hist, K, filter_seen=True), labels, K)


def cart_history(spark, sf_dir):
    long = sq.cart(load_fixture(spark, sf_dir))
    n = long.groupBy("client_id").agg(F.max("pos").alias("_last"))
    j = long.join(n, "client_id")
    hist = j.where(F.col("pos") < F.col("_last")).drop("_last")
    labels = j.where(F.col("pos") == F.col("_last")).select("client_id", F.col("price").alias("price_true"))
    return hist, labels


PRICE_CTES = CART_SEQ_CTES + [
    ("ch", "SELECT client_id, pos, sku, price FROM cs WHERE pos < n - 1"),
    ("ct", "SELECT client_id, price AS price_true FROM cs WHERE pos = n - 1"),
    ("pp_next", """SELECT a.sku AS prev, avg(CAST(b.price AS DOUBLE)) AS m FROM ch a
                   JOIN ch b ON a.client_id = b.client_id AND b.pos = a.pos + 1 GROUP BY a.sku"""),
    ("pred", """SELECT l.client_id, coalesce(p.m, (SELECT avg(CAST(price AS DOUBLE)) FROM ch)) AS prediction
                FROM (SELECT client_id, arg_max(sku, pos) AS last FROM ch GROUP BY client_id) l
                LEFT JOIN pp_next p ON l.last = p.prev"""),
]


@register("next_price", with_bindings(*PRICE_CTES, body=f"SELECT client_id, {r6('prediction')} AS prediction FROM pred"))
def next_price(spark, sf_dir):
    """K8: next price per client — count-weighted mean price after its last sku."""
    hist, _ = cart_history(spark, sf_dir)
    return nx.next_value(hist, "sku", "price")


@register("metrics_numeric", with_bindings(*PRICE_CTES,
    ("j", "SELECT p.prediction AS p, CAST(t.price_true AS DOUBLE) AS t FROM pred p JOIN ct t USING (client_id)"),
    ("rk", "SELECT p, t, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2.0 AS rp, "
           "rank() OVER (ORDER BY t) + (count(*) OVER (PARTITION BY t) - 1) / 2.0 AS rt FROM j"),
    body=f"""SELECT CAST(count(*) AS BIGINT) AS n, {r6("corr(rp, rt)")} AS price_spearman,
                    {r6("avg(abs(p - t))")} AS price_mae, {r6("sqrt(avg((p - t) * (p - t)))")} AS price_rmse,
                    {r6("1 - sum((p - t) * (p - t)) / sum((t - (SELECT avg(t) FROM j)) * (t - (SELECT avg(t) FROM j)))")} AS price_r2
             FROM rk"""))
def metrics_numeric(spark, sf_dir):
    """Spearman, MAE, RMSE, R² of the next-price predictions against the held-out price."""
    hist, labels = cart_history(spark, sf_dir)
    return rm.numeric(nx.next_value(hist, "sku", "price"), labels, "client_id", "price")


@register("sample_clients", with_bindings(body=f"""
    SELECT client_id FROM relevant_clients ORDER BY {draw_sql('client_id', 42)}, client_id LIMIT 10"""))
def sample_clients(spark, sf_dir):
    """T5: a reproducible sample of 10 relevant clients (the limit is the feature)."""
    return nx.sample_rows(load_fixture(spark, sf_dir).relevant_clients, 10)


def _field_history(cart, field):
    """Cart events of each client before its last one, with one field as the item, and the last one's value."""
    v = cart.where(F.col(field).isNotNull()).select("client_id", "pos", field)
    n = v.groupBy("client_id").agg(F.max("pos").alias("_last"))
    j = cut_lineage(v.join(n, "client_id"))                 # read by each count and by the labels
    hist = j.where(F.col("pos") < F.col("_last")).select("client_id", "pos", F.col(field).alias("item"))
    labels = j.where(F.col("pos") == F.col("_last")).select(
        F.col("client_id").alias("user_id"), F.col(field).alias("item_id"))
    return hist, labels


def _field_ctes(field: str) -> list[tuple[str, str]]:
    return CART_SEQ_CTES + [
        ("fl", f"""SELECT client_id, pos, CAST({field} AS BIGINT) AS item, max(pos) OVER (PARTITION BY client_id) AS last_pos
                   FROM cs WHERE {field} IS NOT NULL"""),
        ("hist", "SELECT client_id, pos, item FROM fl WHERE pos < last_pos"),
        ("labels", "SELECT client_id AS user_id, item AS item_id FROM fl WHERE pos = last_pos"),
        ("succ", """SELECT a.item AS prev, b.item AS next, count(*) AS count FROM hist a
                    JOIN hist b ON a.client_id = b.client_id AND b.pos = a.pos + 1 GROUP BY a.item, b.item"""),
        *[c for c in HIST_CTES if c[0] in ("pop", "lastv", "seen")], *_recs_ctes(False)]


_RECS = f"SELECT user_id, item_id, {r6('prediction')} AS prediction, rank FROM recs"


def _field_recs(cart, field):
    hist, labels = _field_history(cart, field)
    return nx.recommend(hist.withColumn("item", F.col("item").cast("long")), K, filter_seen=False), labels


@register("next_category_topk", with_bindings(*_field_ctes("category"), body=_RECS))
def next_category_topk(spark, sf_dir):
    """K7 on the cart: top-10 next categories per client."""
    return _field_recs(sq.cart(load_fixture(spark, sf_dir)), "category")[0]


@register("next_event_topk", with_bindings(*_field_ctes("event"), body=_RECS))
def next_event_topk(spark, sf_dir):
    """K7 on the cart: next event kinds per client, best first; one row per client and back."""
    return nx.rows_to_recs(nx.recs_to_rows(_field_recs(sq.cart(load_fixture(spark, sf_dir)), "event")[0]))


_METRICS = f"""SELECT CAST(count(*) AS BIGINT) AS users,
           {r6("avg(CASE WHEN r.rank = 1 THEN 1.0 ELSE 0.0 END)")} AS hit_rate_1,
           {r6("avg(CASE WHEN r.rank IS NOT NULL THEN 1.0 ELSE 0.0 END)")} AS hit_rate_10,
           {r6("avg(coalesce(1.0 / r.rank, 0.0))")} AS mrr_10,
           {r6("avg(coalesce(1.0 / log2(r.rank + 1), 0.0))")} AS ndcg_10
    FROM labels l LEFT JOIN recs r ON l.user_id = r.user_id AND l.item_id = r.item_id AND r.rank <= 10
    WHERE l.user_id IN (SELECT user_id FROM recs)"""


@register("metrics_next_sku", "SELECT 'category' AS field, * FROM (" + with_bindings(*_field_ctes("category"), body=_METRICS)
          + ") UNION ALL SELECT 'event' AS field, * FROM (" + with_bindings(*_field_ctes("event"), body=_METRICS) + ")")
def metrics_next_sku(spark, sf_dir):
    """Hit rates, MRR and NDCG of the next category and the next event, one row per field."""
    out, cart = None, sq.cart(load_fixture(spark, sf_dir))
    for field in ("category", "event"):
        recs, labels = _field_recs(cart, field)
        row = rm.ranking(recs, labels.withColumn("item_id", F.col("item_id").cast("long")), K) \
            .select(F.lit(field).alias("field"), "*")
        out = row if out is None else out.unionByName(row)
    return out


@register("metrics_rows", with_bindings(*_field_ctes("category"), body=_METRICS))
def metrics_rows(spark, sf_dir):
    """G1-G4 on one row per client: the next category's place in the array of recommended ones."""
    recs, labels = _field_recs(sq.cart(load_fixture(spark, sf_dir)), "category")
    return rm.ranking_rows(nx.recs_to_rows(recs), labels.withColumn("item_id", F.col("item_id").cast("long")), K)
