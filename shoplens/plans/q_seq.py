"""Sequence queries. Arrays are compared in long form."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.draws import draw_sql
from ..operators import sequences as sq
from ..operators.ordering import explode_arrays
from ..sources.inputs import load_fixture
from .q_vocab import CART_UNION_SQL, capped_sql
from .registry import register
from .sqlkit import with_bindings

# ---- oracle fragments ---------------------------------------------------------------

EVENT_DAY_CTES = [
    ("ed_u", """SELECT client_id, ts, 1 AS et FROM r_add UNION ALL SELECT client_id, ts, 2 FROM r_remove
               UNION ALL SELECT client_id, ts, 3 FROM r_buy UNION ALL SELECT client_id, ts, 4 FROM r_visit
               UNION ALL SELECT client_id, ts, 5 FROM r_search"""),
    ("ed", """SELECT client_id,
                CAST(row_number() OVER (PARTITION BY client_id ORDER BY ts, et) - 1 AS BIGINT) AS pos,
                CAST(et + 2 AS BIGINT) AS event_type,
                CAST(date_diff('day', (SELECT min(CAST(ts AS DATE)) FROM ed_u), CAST(ts AS DATE)) + 3 AS BIGINT) AS day,
                count(*) OVER (PARTITION BY client_id) AS n
              FROM ed_u"""),
]

FULL_BASE = """SELECT client_id, ts, 0 AS event_type, category + 1 AS category, sku + 1 AS sku, price + 1 AS price, 0 AS url
        FROM r_add JOIN product_properties USING (sku)
    UNION ALL SELECT client_id, ts, 1, category + 1, sku + 1, price + 1, 0 FROM r_remove JOIN product_properties USING (sku)
    UNION ALL SELECT client_id, ts, 2, category + 1, sku + 1, price + 1, 0 FROM r_buy JOIN product_properties USING (sku)
    UNION ALL SELECT client_id, ts, 3, 0, 0, 0, coalesce(url, 0) FROM r_visit
    UNION ALL SELECT client_id, ts, 4, 0, 0, 0, 0 FROM r_search"""


def _cap_ctes(src: str, col: str, cap: int, prefix: str):
    return [(name.replace("cap_", prefix), sql.replace("cap_", prefix)) for name, sql in
            capped_sql(f"SELECT {col} AS v FROM {src}", cap, col)]


FULL_CTES = (
    [("fb", FULL_BASE)]
    + _cap_ctes("fb", "url", 5000, "cu_")
    + [("fb2", "SELECT fb.* REPLACE (cu.code AS url) FROM fb JOIN cu_codes cu ON fb.url = cu.v")]
    + _cap_ctes("fb2", "sku", 5000, "cs_")
    + [("fb3", "SELECT fb2.* REPLACE (cs.code AS sku) FROM fb2 JOIN cs_codes cs ON fb2.sku = cs.v"),
       ("fm", "SELECT min(CAST(ts AS DATE)) AS d0, min(weekofyear(ts)) AS w0, min(month(ts)) AS m0 FROM fb3"),
       ("ff", """SELECT client_id, ts, CAST(event_type + 3 AS BIGINT) AS event_type,
                 CAST(category + 3 AS BIGINT) AS category, CAST(price + 3 AS BIGINT) AS price,
                 CAST(sku + 3 AS BIGINT) AS sku, CAST(url + 3 AS BIGINT) AS url,
                 CAST(date_diff('day', d0, CAST(ts AS DATE)) + 3 AS BIGINT) AS day,
                 CAST(weekofyear(ts) - w0 + 3 AS BIGINT) AS week, CAST(month(ts) - m0 + 3 AS BIGINT) AS month
                 FROM fb3, fm""")]
)

CART_SEQ_CTES = [
    ("cart_u", CART_UNION_SQL),
    ("cart_k", "SELECT * FROM cart_u WHERE client_id IN (SELECT client_id FROM cart_u GROUP BY client_id HAVING count(*) > 1)"),
    ("cs", """SELECT client_id, CAST(row_number() OVER (PARTITION BY client_id ORDER BY ts, event, sku) - 1 AS BIGINT) AS pos,
                sku, category, price, CAST(event AS BIGINT) AS event, count(*) OVER (PARTITION BY client_id) AS n
              FROM cart_k"""),
]

VISIT_MIN = 10
VISIT_CTES = [
    ("vv", f"SELECT * FROM r_visit WHERE url IN (SELECT url FROM r_visit GROUP BY url HAVING count(*) >= {VISIT_MIN})"),
    ("vcodes", "SELECT url, CAST(row_number() OVER (ORDER BY url) AS BIGINT) AS url_code FROM (SELECT DISTINCT url FROM vv)"),
    ("vs", """SELECT client_id, url, url_code,
                CAST(row_number() OVER (PARTITION BY client_id ORDER BY ts, url) - 1 AS BIGINT) AS time_idx,
                CAST(row_number() OVER (PARTITION BY client_id ORDER BY ts DESC, url DESC) - 1 AS BIGINT) AS time_idx_reversed
              FROM vv JOIN vcodes USING (url)"""),
]


# ---- queries --------------------------------------------------------------------------

@register("seq_event_day", with_bindings(*EVENT_DAY_CTES, body="SELECT client_id, pos, event_type, day FROM ed"))
def seq_event_day(spark, sf_dir):
    """Q1: event/day sequences of relevant clients (long form)."""
    return sq.event_day(load_fixture(spark, sf_dir))


@register("seq_full", with_bindings(*FULL_CTES, body="""
    SELECT client_id, CAST(row_number() OVER (PARTITION BY client_id
             ORDER BY ts, event_type, category, price, sku, url, day, week, month) - 1 AS BIGINT) AS pos,
           event_type, category, price, sku, url, day, week, month FROM ff"""))
def seq_full(spark, sf_dir):
    """Q2 + Q3: multi-feature sequences with capped sku/url codes and time offsets."""
    return sq.full(load_fixture(spark, sf_dir))


@register("seq_full_vocab", with_bindings(*FULL_CTES, body="""
    SELECT CAST(max(event_type) + 1 AS BIGINT) AS vocab_event_type, CAST(max(category) + 1 AS BIGINT) AS vocab_category,
           CAST(max(price) + 1 AS BIGINT) AS vocab_price, CAST(max(sku) + 1 AS BIGINT) AS vocab_sku,
           CAST(max(url) + 1 AS BIGINT) AS vocab_url, CAST(max(day) + 1 AS BIGINT) AS vocab_day,
           CAST(max(week) + 1 AS BIGINT) AS vocab_week, CAST(max(month) + 1 AS BIGINT) AS vocab_month FROM ff"""))
def seq_full_vocab(spark, sf_dir):
    """Q2's vocabulary sizes (max + 1 per column)."""
    return sq.vocab_sizes(sq.full_events(load_fixture(spark, sf_dir)), sq.FULL_COLUMNS)


@register("seq_sku_text", with_bindings(
    ("st_u", """SELECT e.client_id, e.ts, e.sku FROM product_buy e JOIN product_properties p ON e.sku = p.sku
                UNION ALL SELECT e.client_id, e.ts, e.sku FROM add_to_cart e JOIN product_properties p ON e.sku = p.sku
                UNION ALL SELECT e.client_id, e.ts, e.sku FROM remove_from_cart e JOIN product_properties p ON e.sku = p.sku"""),
    ("st_f", """SELECT f.client_id, f.ts, f.sku,
                  list_transform(regexp_extract_all(p.name, '(\\d+)', 1), lambda x: CAST(x AS BIGINT)) AS toks
                FROM (SELECT client_id, sku, min(ts) AS ts FROM st_u GROUP BY client_id, sku) f
                JOIN product_properties p ON f.sku = p.sku"""),
    ("st_t", "SELECT client_id, ts, sku, unnest(toks) AS tok, generate_subscripts(toks, 1) AS i FROM st_f"),
    body="""SELECT client_id, CAST(row_number() OVER (PARTITION BY client_id ORDER BY ts, sku, i) - 1 AS BIGINT) AS pos,
                   CAST(tok + 3 AS BIGINT) AS text FROM st_t"""))
def seq_sku_text(spark, sf_dir):
    """Q4: flattened name codes of each client's distinct skus in first-seen order."""
    return sq.sku_text(load_fixture(spark, sf_dir))


@register("seq_cart", with_bindings(*CART_SEQ_CTES, body="SELECT client_id, pos, sku, category, price, event FROM cs"))
def seq_cart(spark, sf_dir):
    """Q5: cart/buy sequences of clients with more than one event."""
    return sq.cart(load_fixture(spark, sf_dir)).select("client_id", "pos", *sq.CART_FIELDS)


@register("seq_visits", with_bindings(*VISIT_CTES, body="SELECT * FROM vs"))
def seq_visits(spark, sf_dir):
    """Q6 + W1: visit sequences with time index both ways and url codes from 1."""
    return sq.visits(load_fixture(spark, sf_dir), min_count=VISIT_MIN).select(
        "client_id", "url", "url_code", "time_idx", "time_idx_reversed")


@register("seq_encoder_view", with_bindings(*EVENT_DAY_CTES, body="""
    SELECT client_id, CAST(pos - (n - least(n, 126)) + 1 AS BIGINT) AS pos, event_type, day FROM ed WHERE pos >= n - 126
    UNION ALL SELECT DISTINCT client_id, CAST(0 AS BIGINT), CAST(1 AS BIGINT), CAST(1 AS BIGINT) FROM ed
    UNION ALL SELECT DISTINCT client_id, CAST(least(n, 126) + 1 AS BIGINT), CAST(2 AS BIGINT), CAST(2 AS BIGINT) FROM ed"""))
def seq_encoder_view(spark, sf_dir):
    """Q7: last 126 events + start/end tokens (max_length 128), exploded."""
    view = sq.encoder_view(sq.event_day(load_fixture(spark, sf_dir), last=126), ["event_type", "day"], 128)
    return explode_arrays(view, "client_id", ["event_type", "day"])


@register("seq_padded", with_bindings(*EVENT_DAY_CTES,
    ("ev", """SELECT client_id, CAST(pos - (n - least(n, 126)) + 1 AS BIGINT) AS pos, event_type, day FROM ed WHERE pos >= n - 126
              UNION ALL SELECT DISTINCT client_id, 0, 1, 1 FROM ed
              UNION ALL SELECT DISTINCT client_id, least(n, 126) + 1, 2, 2 FROM ed"""),
    ("L", "SELECT max(least(n, 126) + 2) AS L FROM ed"),
    ("grid", "SELECT DISTINCT client_id, CAST(unnest(range((SELECT L FROM L))) AS BIGINT) AS pos FROM ed"),
    body="""SELECT g.client_id, g.pos, CAST(coalesce(ev.event_type, 0) AS BIGINT) AS event_type,
                   CAST(coalesce(ev.day, 0) AS BIGINT) AS day,
                   CASE WHEN ev.pos IS NULL THEN 0 ELSE 1 END AS mask
            FROM grid g LEFT JOIN ev ON g.client_id = ev.client_id AND g.pos = ev.pos"""))
def seq_padded(spark, sf_dir):
    """Encoder view padded to the longest sequence with a mask."""
    view = sq.encoder_view(sq.event_day(load_fixture(spark, sf_dir), last=126), ["event_type", "day"], 128)
    padded = sq.pad_to_longest(view, ["event_type", "day"])
    return explode_arrays(padded, "client_id", ["event_type", "day", "mask"])


@register("seq_shift", with_bindings(*VISIT_CTES,
    ("vk", """SELECT client_id, time_idx, url_code,
                lead(url_code) OVER (PARTITION BY client_id ORDER BY time_idx) AS nxt,
                min(time_idx) OVER (PARTITION BY client_id) AS t0
              FROM vs WHERE time_idx_reversed <= 256"""),
    body="""SELECT client_id, CAST(time_idx - t0 AS BIGINT) AS pos, url_code AS input_ids, nxt AS labels
            FROM vk WHERE nxt IS NOT NULL"""))
def seq_shift(spark, sf_dir):
    """Causal training view — inputs all but last, labels all but first, last 257 visits."""
    view = sq.causal_train_view(sq.visits(load_fixture(spark, sf_dir), VISIT_MIN, last=257), 256)
    return explode_arrays(view, "client_id", ["input_ids", "labels"])


@register("last_event_holdout", with_bindings(*VISIT_CTES, body="""
    SELECT client_id, url_code AS item_id, time_idx AS n_inputs FROM vs WHERE time_idx_reversed = 0"""))
def last_event_holdout(spark, sf_dir):
    """the last visit of each client is its label; ``n_inputs`` events precede it."""
    _, labels = sq.holdout_last(sq.visits(load_fixture(spark, sf_dir), VISIT_MIN))
    return labels.select("client_id", F.col("url_code").alias("item_id"), F.col("time_idx").alias("n_inputs"))


@register("seq_predict_view", with_bindings(*CART_SEQ_CTES, body="""
    SELECT h.client_id, CAST(h.pos - (h.n - 1 - least(h.n - 1, 64)) AS BIGINT) AS pos, h.category, h.event, h.price,
           t.category AS category_true, t.event AS event_true, t.price AS price_true
    FROM cs h JOIN cs t ON h.client_id = t.client_id AND t.pos = t.n - 1
    WHERE h.pos < h.n - 1 AND h.pos >= h.n - 1 - 64"""))
def seq_predict_view(spark, sf_dir):
    """Q9: newest 64 cart events before the held-out last one, with its labels."""
    fields = ["category", "event", "price"]
    view = sq.next_event_predict_view(sq.cart_events(load_fixture(spark, sf_dir)), sq.CART_ORDER, fields, 64)
    rows = view.select("client_id", *[f"{f}_true" for f in fields], F.posexplode(F.arrays_zip(*fields)).alias("pos", "_z"))
    return rows.select("client_id", F.col("pos").cast("long").alias("pos"), *[F.col("_z")[f].alias(f) for f in fields],
                       *[f"{f}_true" for f in fields])


@register("seq_causal_predict", with_bindings(*VISIT_CTES, body="""
    SELECT v.client_id, t.url_code AS target, list(v.url_code ORDER BY v.time_idx) FILTER (v.time_idx_reversed <= 256) AS input_ids,
           list_sort(list_distinct(list(v.url_code))) AS history
    FROM vs v JOIN vs t ON v.client_id = t.client_id AND t.time_idx_reversed = 0
    WHERE v.time_idx_reversed > 0 GROUP BY v.client_id, t.url_code"""))
def seq_causal_predict(spark, sf_dir):
    """Q11: newest 256 visits before the last one, the last one as target, and the items seen before."""
    return sq.causal_predict_view(sq.visits(load_fixture(spark, sf_dir), VISIT_MIN), 256, full_history=True)


@register("seq_padded_labels", with_bindings(*VISIT_CTES,
    ("vk", """SELECT client_id, time_idx - min(time_idx) OVER (PARTITION BY client_id) AS pos, url_code,
                lead(url_code) OVER (PARTITION BY client_id ORDER BY time_idx) AS nxt FROM vs WHERE time_idx_reversed <= 16"""),
    ("ev", "SELECT * FROM vk WHERE nxt IS NOT NULL"),
    ("grid", "SELECT client_id, CAST(unnest(range((SELECT max(pos) + 1 FROM ev))) AS BIGINT) AS pos FROM (SELECT DISTINCT client_id FROM vs)"),
    body="""SELECT g.client_id, g.pos, CAST(coalesce(url_code, 0) AS BIGINT) AS input_ids, CAST(coalesce(nxt, -100) AS BIGINT) AS labels,
                   CASE WHEN ev.pos IS NULL THEN 0 ELSE 1 END AS mask
            FROM grid g LEFT JOIN ev ON g.client_id = ev.client_id AND g.pos = ev.pos"""))
def seq_padded_labels(spark, sf_dir):
    """The causal view of the last 17 visits, padded with 0, its labels with -100."""
    view = sq.causal_train_view(sq.visits(load_fixture(spark, sf_dir), VISIT_MIN, last=17), 16)
    padded = sq.pad_to_longest(view, ["input_ids", "labels"], label_fields=["labels"])
    return explode_arrays(padded, "client_id", ["input_ids", "labels", "mask"])


@register("seq_random_slice", with_bindings(*CART_SEQ_CTES,
    ("len0", f"SELECT DISTINCT client_id, n, least(n, 33 + {draw_sql('client_id', 42)} % 33) AS len FROM cs"),
    ("cut", f"SELECT *, {draw_sql('client_id', 43)} % greatest(n - len + 1, 1) AS lo FROM len0"),
    ("sl", """SELECT cs.*, lo, len, lead(category) OVER w AS category_next, lead(event) OVER w AS event_next, lead(price) OVER w AS price_next
              FROM cs JOIN cut USING (client_id) WHERE pos >= lo AND pos < lo + len WINDOW w AS (PARTITION BY client_id ORDER BY pos)"""),
    body="""SELECT client_id, CAST(pos - lo AS BIGINT) AS pos, category, event, price, category_next AS labels_category,
                   event_next AS labels_event, price_next AS labels_price FROM sl WHERE pos < lo + len - 1"""))
def seq_random_slice(spark, sf_dir):
    """Q8 / E5: next-event training view on a seeded random slice."""
    fields = ["category", "event", "price"]
    view = sq.next_event_train_view(sq.cart(load_fixture(spark, sf_dir)), fields, 32, 64)
    return explode_arrays(view, "client_id", [*fields, *[f"labels_{f}" for f in fields]])


#: Draw j of a client: its polynomial at j modulo the prime, modulo the number of unseen items.
NEGATIVE_CTES = [
    ("vw", "SELECT DISTINCT client_id, url_code AS h FROM vs WHERE time_idx_reversed <= 256"),
    ("hs", "SELECT client_id, h, row_number() OVER (PARTITION BY client_id ORDER BY h) - 1 AS i FROM vw"),
    ("gp", "SELECT client_id, h - i - 1 AS at, max(i + 1) AS below FROM hs GROUP BY 1, 2"),
    ("cl", f"""SELECT client_id, (SELECT max(url_code) FROM vs) - max(below) AS free, {draw_sql('client_id', 42)} % 2147483647 AS c0,
                 {draw_sql('client_id', 43)} % 2147483647 AS c1, {draw_sql('client_id', 44)} % 2147483647 AS c2 FROM gp GROUP BY client_id"""),
    ("dr", """SELECT client_id, j, (((c2 * j + c1) % 2147483647) * j + c0) % 2147483647 % free AS r
              FROM cl, (SELECT unnest(range(10000)) AS j) WHERE free > 0"""),
    ("ng", """SELECT d.client_id, d.j, d.r + 1 + coalesce(g.below, 0) AS item
              FROM dr d ASOF LEFT JOIN gp g ON d.client_id = g.client_id AND d.r >= g.at"""),
]


@register("seq_negatives", with_bindings(*VISIT_CTES, *NEGATIVE_CTES, body="""
    SELECT v.client_id, v.n_inputs, coalesce(n, 0) AS n_negatives, item_sum, place_sum FROM
      (SELECT client_id, least(count(*), 257) - 1 AS n_inputs FROM vs GROUP BY 1) v
    LEFT JOIN (SELECT client_id, count(*) AS n, CAST(sum(item) AS BIGINT) AS item_sum,
                      CAST(sum(item * (j + 1)) AS BIGINT) AS place_sum FROM ng GROUP BY 1) USING (client_id)"""))
def seq_negatives(spark, sf_dir):
    """Causal training view with 10,000 negatives per client: their count, and sums with and without their
    places."""
    view, drawn = sq.causal_train_with_negatives(sq.visits(load_fixture(spark, sf_dir), VISIT_MIN), 256, 10_000)
    sums = drawn.groupBy("client_id").agg(F.count(F.lit(1)).alias("n"), F.sum("item").alias("item_sum"),
                                          F.sum(F.col("item") * (F.col("place") + 1)).alias("place_sum"))
    return view.select("client_id", F.size("input_ids").cast("long").alias("n_inputs")).join(sums, "client_id", "left") \
        .select("client_id", "n_inputs", F.coalesce("n", F.lit(0)).alias("n_negatives"), "item_sum", "place_sum")
