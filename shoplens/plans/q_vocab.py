"""Sources, vocabulary and frequency-filter queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from ..functions.draws import draw_sql
from ..functions.dates import epoch_micros
from ..operators import vocab
from ..operators.client_stats import relevant_events
from ..sources.inputs import load_fixture, relevant_only
from .registry import register
from .sqlkit import with_bindings

CART = (("product_buy", "buy"), ("add_to_cart", "add"), ("remove_from_cart", "remove"))


def _union(frames):
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


ENRICHED_SQL = with_bindings(body=" UNION ALL ".join(
    f"""SELECT e.client_id, epoch_us(e.ts) AS ts_us, e.sku, p.category, p.price, '{k}' AS kind
        FROM {t} e JOIN product_properties p ON e.sku = p.sku""" for t, k in CART))


@register("events_enriched", ENRICHED_SQL)
def events_enriched(spark, sf_dir):
    """cart/buy events inner-joined to (category, price); unknown skus dropped."""
    inputs = load_fixture(spark, sf_dir)
    return _union([inputs.enriched(t).select("client_id", epoch_micros("timestamp").alias("ts_us"), "sku",
                                             "category", "price", F.lit(k).alias("kind"))
                   for t, k in CART])


RELEVANT_SQL = with_bindings(body="""
    SELECT client_id, epoch_us(ts) AS ts_us, 'buy' AS kind, sku, CAST(NULL AS BIGINT) AS url, CAST(NULL AS VARCHAR) AS query FROM r_buy
    UNION ALL SELECT client_id, epoch_us(ts), 'add', sku, NULL, NULL FROM r_add
    UNION ALL SELECT client_id, epoch_us(ts), 'remove', sku, NULL, NULL FROM r_remove
    UNION ALL SELECT client_id, epoch_us(ts), 'visit', NULL, url, NULL FROM r_visit
    UNION ALL SELECT client_id, epoch_us(ts), 'search', NULL, NULL, query FROM r_search""")


@register("relevant_events", RELEVANT_SQL)
def relevant_events_q(spark, sf_dir):
    """All five event tables restricted to relevant clients (semi join)."""
    inputs = load_fixture(spark, sf_dir)
    ev = relevant_events(inputs)
    frames = [ev[k].select("client_id", epoch_micros("timestamp").alias("ts_us"), F.lit(k).alias("kind"),
                           F.col("sku") if k != "visit" else F.lit(None).cast("long").alias("sku"),
                           F.col("url") if k == "visit" else F.lit(None).cast("long").alias("url"),
                           F.lit(None).cast("string").alias("query"))
              for k in ("buy", "add", "remove", "visit")]
    s = relevant_only(inputs.search_query, inputs.relevant_clients)
    frames.append(s.select("client_id", epoch_micros("timestamp").alias("ts_us"), F.lit("search").alias("kind"),
                           F.lit(None).cast("long").alias("sku"), F.lit(None).cast("long").alias("url"), "query"))
    return _union(frames)


@register("vocab_sorted", with_bindings(body="""
    SELECT url, CAST(row_number() OVER (ORDER BY url) - 1 AS BIGINT) AS code
    FROM (SELECT DISTINCT url FROM r_visit WHERE url IS NOT NULL)"""))
def vocab_sorted(spark, sf_dir):
    """Dense url codes from 0 in value order."""
    inputs = load_fixture(spark, sf_dir)
    return vocab.dense_codes(relevant_events(inputs)["visit"], "url", start=0)


CAP_VALUES_SQL = """SELECT e.sku + 1 AS v FROM r_add e JOIN product_properties p ON e.sku = p.sku
    UNION ALL SELECT e.sku + 1 FROM r_remove e JOIN product_properties p ON e.sku = p.sku
    UNION ALL SELECT e.sku + 1 FROM r_buy e JOIN product_properties p ON e.sku = p.sku
    UNION ALL SELECT 0 FROM r_visit UNION ALL SELECT 0 FROM r_search"""


def capped_sql(values_cte: str, cap: int, out_col: str) -> list[tuple[str, str]]:
    """Oracle CTEs for E3: ``cap_codes(v, code)``."""
    return [
        ("cap_vals", values_cte),
        ("cap_cnt", "SELECT v, count(*) AS n FROM cap_vals WHERE v IS NOT NULL GROUP BY v"),
        ("cap_top", f"SELECT v FROM cap_cnt ORDER BY n DESC, v ASC LIMIT {cap}"),
        ("cap_oth", "SELECT CASE WHEN (SELECT count(*) FROM cap_cnt) > (SELECT count(*) FROM cap_top) "
                    "THEN 1 ELSE 0 END AS o"),
        ("cap_kept", "SELECT v, row_number() OVER (ORDER BY v) AS r FROM cap_top WHERE v <> 0"),
        ("cap_codes", """SELECT c.v, CAST(CASE WHEN c.v = 0 AND c.v IN (SELECT v FROM cap_top) THEN 0
                                   WHEN k.r IS NULL THEN 1 ELSE k.r + o.o END AS BIGINT) AS code
                         FROM cap_cnt c LEFT JOIN cap_kept k ON c.v = k.v, cap_oth o"""),
    ]


VOCAB_CAP = 500


@register("vocab_capped", with_bindings(*capped_sql(CAP_VALUES_SQL, VOCAB_CAP, "sku"),
                                        body="SELECT v AS sku, code FROM cap_codes"))
def vocab_capped(spark, sf_dir):
    """Sku codes of the multi-feature sequences, capped at 500 of ~2,000 values."""
    inputs = load_fixture(spark, sf_dir)
    rel = inputs.relevant_clients
    vals = _union([relevant_only(inputs.enriched(t), rel).select((F.col("sku") + 1).alias("sku"))
                   for t in ("add_to_cart", "remove_from_cart", "product_buy")]
                  + [relevant_only(inputs.page_visit, rel).select(F.lit(0).cast("long").alias("sku")),
                     relevant_only(inputs.search_query, rel).select(F.lit(0).cast("long").alias("sku"))])
    return vocab.capped_codes(vals, "sku", VOCAB_CAP)


ITEMS_MIN = 30


@register("items_min_count", with_bindings(body=f"""
    SELECT client_id, url, count(*) AS n FROM r_visit
    WHERE url IN (SELECT url FROM r_visit GROUP BY url HAVING count(*) >= {ITEMS_MIN})
    GROUP BY client_id, url"""))
def items_min_count(spark, sf_dir):
    """relevant visits of urls with at least 30 visits, summarised per (client, url)."""
    inputs = load_fixture(spark, sf_dir)
    kept = vocab.min_count_items(relevant_events(inputs)["visit"], "url", ITEMS_MIN)
    return kept.groupBy("client_id", "url").agg(F.count(F.lit(1)).alias("n"))


CART_UNION_SQL = " UNION ALL ".join(
    f"SELECT e.client_id, e.ts, e.sku, p.category, p.price, {c} AS event FROM {t} e JOIN product_properties p ON e.sku = p.sku"
    for t, c in (("product_buy", 3), ("add_to_cart", 1), ("remove_from_cart", 2)))


def _cart_union(inputs):
    return _union([inputs.enriched(t).select("client_id", "timestamp", "sku", "category", "price",
                                             F.lit(c).cast("long").alias("event"))
                   for t, c in (("product_buy", 3), ("add_to_cart", 1), ("remove_from_cart", 2))])


@register("clients_min_events", with_bindings(("cart_u", CART_UNION_SQL), body="""
    SELECT client_id, count(*) AS n FROM cart_u GROUP BY client_id HAVING count(*) > 1"""))
def clients_min_events(spark, sf_dir):
    """clients with more than one cart/buy event, with their event count."""
    ev = vocab.min_events_clients(_cart_union(load_fixture(spark, sf_dir)), 2)
    return ev.groupBy("client_id").agg(F.count(F.lit(1)).alias("n"))


@register("stage_report", with_bindings(("cart_u", CART_UNION_SQL), body="""
    SELECT count(*) AS rows, count(DISTINCT client_id) AS distinct_client_id,
           count(DISTINCT sku) AS distinct_sku, count(DISTINCT category) AS distinct_category FROM cart_u"""))
def stage_report(spark, sf_dir):
    """Rows and distinct clients / skus / categories of the cart sequences' input."""
    return vocab.stage_report(_cart_union(load_fixture(spark, sf_dir)), ["client_id", "sku", "category"])


@register("client_split", with_bindings(body=f"""
    SELECT client_id, CASE WHEN {draw_sql('client_id', 42)} % 10000 < 200 THEN 'test'
                           WHEN {draw_sql('client_id', 43)} % 10000 < 100 THEN 'validation' ELSE 'train' END AS part
    FROM (SELECT DISTINCT client_id FROM relevant_clients)"""))
def client_split(spark, sf_dir):
    """Seeded split of the relevant clients."""
    inputs = load_fixture(spark, sf_dir)
    return vocab.split_clients(inputs.relevant_clients)


@register("top_items", with_bindings(body="""
    SELECT url, count(*) AS count FROM r_visit WHERE url IS NOT NULL GROUP BY url ORDER BY count DESC, url ASC LIMIT 20"""))
def top_items(spark, sf_dir):
    """The 20 most visited urls (the limit is the feature)."""
    return vocab.top_values(relevant_events(load_fixture(spark, sf_dir))["visit"], "url", 20)
