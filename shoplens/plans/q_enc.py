"""Encoder queries: hashed bags and token vectors have SQL, eigenvectors are checked in tests."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.draws import draw_sql
from ..operators import client_text as ct
from ..operators import decoding as de
from ..operators import encoders as en
from ..operators import event_state as es
from ..operators import sequences as sq
from ..operators import vectors as vx
from ..sources.inputs import load_fixture
from .q_seq import CART_SEQ_CTES, EVENT_DAY_CTES, VISIT_CTES, VISIT_MIN
from .registry import register
from .q_text import INTERACTIONS_SQL
from .sqlkit import with_bindings

BAG_FIELDS = ["event_type", "category", "price", "sku", "url"]
WEEK_FIELDS = ["week", *BAG_FIELDS]
#: Words of a client text that the text encoder reads (the last ones: left truncation).
TEXT_TOKENS = 512

BAG_CTES = [
    *EVENT_DAY_CTES,
    ("tok", """SELECT client_id, 'event_type=' || event_type AS token FROM ed
               UNION ALL SELECT client_id, 'day=' || day FROM ed"""),
    ("bag", f"""SELECT client_id, {draw_sql('token', 42)} % {en.SLOTS} AS slot,
                CAST(sum(CASE WHEN {draw_sql('token', 43)} % 2 = 0 THEN 1 ELSE -1 END) AS DOUBLE) AS value
                FROM tok GROUP BY 1, 2"""),
]


def _event_day_entries(spark, sf_dir):
    return en.field_entries(sq.event_day(load_fixture(spark, sf_dir)), ["event_type", "day"])


@register("enc_bag_entries", with_bindings(*BAG_CTES, body="SELECT * FROM bag"))
def enc_bag_entries(spark, sf_dir):
    """Hashed signed token sums of the event/day sequences."""
    return _event_day_entries(spark, sf_dir)


@register("enc_bag_cov", with_bindings(*BAG_CTES,
    ("n", "SELECT count(DISTINCT client_id) AS n FROM bag"),
    ("s", f"SELECT g.slot, coalesce(sum(value), 0) AS s FROM (SELECT unnest(range({en.SLOTS})) AS slot) g LEFT JOIN bag ON bag.slot = g.slot GROUP BY g.slot"),
    ("c", "SELECT a.slot AS x, b.slot AS y, sum(a.value * b.value) AS c FROM bag a JOIN bag b ON a.client_id = b.client_id GROUP BY 1, 2"),
    body="""SELECT CAST(p.slot AS BIGINT) AS pos, CAST(q.slot AS BIGINT) AS other,
                   (round((coalesce(c, 0) - p.s * q.s / n) / (n - 1), 6) + 0.0) AS value
            FROM s p CROSS JOIN s q CROSS JOIN n LEFT JOIN c ON c.x = p.slot AND c.y = q.slot"""))
def enc_bag_cov(spark, sf_dir):
    """K5 fit: covariance of the hashed bags."""
    return vx.covariance_rows(en.bag_vectors(_event_day_entries(spark, sf_dir)))


@register("enc_token_vectors", with_bindings(*VISIT_CTES,
    ("ev", "SELECT client_id, time_idx AS p, url_code AS token FROM vs WHERE time_idx_reversed < 256"),
    ("pairs", """SELECT a.token, b.token AS near, count(*) AS n FROM ev a JOIN ev b
                 ON a.client_id = b.client_id AND a.p <> b.p AND abs(a.p - b.p) <= 5 GROUP BY 1, 2"""),
    ("signs", "SELECT near, dim, CASE WHEN " + draw_sql("(near || '/' || dim)", 42) + """ % 2 = 0 THEN 1 ELSE -1 END AS sign
              FROM (SELECT DISTINCT near FROM pairs), (SELECT unnest(range(64)) AS dim)"""),
    ("sums", "SELECT token, dim, sum(n * sign) AS s FROM pairs JOIN signs USING (near) GROUP BY 1, 2"),
    body="""SELECT token, CAST(dim AS INT) AS dim, (round(coalesce(s / nullif(sqrt(sum(CAST(s AS DOUBLE) * s) OVER (PARTITION BY token)), 0), 0), 6) + 0.0)
            AS value FROM sums"""))
def enc_token_vectors(spark, sf_dir):
    """K6 fit: item vectors from the items around them in the newest 256 visits."""
    return en.token_vectors(_visits(spark, sf_dir), "item", 64)


def _visits(spark, sf_dir):
    return sq.visits(load_fixture(spark, sf_dir), VISIT_MIN, last=256).select(
        "client_id", F.col("time_idx").alias("pos"), F.col("url_code").alias("item"))


@register("enc_bag_pca")
def enc_bag_pca(spark, sf_dir):
    """K5 + K12: hashed bags of field=value tokens of the multi-feature sequences, centred PCA to 64."""
    return en.bag_pca(sq.full(load_fixture(spark, sf_dir), BAG_FIELDS), BAG_FIELDS, 64)


@register("enc_event_day")
def enc_event_day(spark, sf_dir):
    """K5 on the event/day sequences."""
    return en.bag_pca(sq.event_day(load_fixture(spark, sf_dir)), ["event_type", "day"], 64)


EVENT_FIELDS = ["event_type", "day"]


@register("enc_event_state", with_bindings(*EVENT_DAY_CTES,
    ("et", "SELECT client_id, n - 1 - pos AS age, 'event_type=' || event_type AS token FROM ed "
           "UNION ALL SELECT client_id, n - 1 - pos, 'day=' || day FROM ed"),
    body=f"""SELECT client_id, {draw_sql('token', 42)} % {en.SLOTS} AS slot, (round(sum(power(0.9, age)
             * CASE WHEN {draw_sql('token', 43)} % 2 = 0 THEN 1.0 ELSE -1.0 END), 6) + 0.0) AS value FROM et GROUP BY 1, 2"""))
def enc_event_state(spark, sf_dir):
    """K5 with order: decayed states of the event/day sequences."""
    return es.decayed_state(sq.event_days(load_fixture(spark, sf_dir)), EVENT_FIELDS, sq.EVENT_DAY_ORDER, slots=en.SLOTS)


@register("enc_event_state_pca")
def enc_event_state_pca(spark, sf_dir):
    """K5 with order: the states of enc_event_state, centred PCA to 64."""
    return en.state_pca(sq.event_days(load_fixture(spark, sf_dir)), EVENT_FIELDS, sq.EVENT_DAY_ORDER, 64)


@register("enc_sku_text")
def enc_sku_text(spark, sf_dir):
    """K5 on the sku text sequences."""
    return en.bag_pca(sq.sku_text(load_fixture(spark, sf_dir)), ["text"], 64)


@register("enc_week")
def enc_week(spark, sf_dir):
    """K5 on the multi-feature sequences with the week."""
    return en.bag_pca(sq.full(load_fixture(spark, sf_dir), WEEK_FIELDS), WEEK_FIELDS, 64)


@register("enc_recon_error")
def enc_recon_error(spark, sf_dir):
    """G8 re-aimed: per-client reconstruction error of the bag PCA."""
    return en.reconstruction_error(sq.full(load_fixture(spark, sf_dir), BAG_FIELDS), BAG_FIELDS, 64)


@register("enc_item2vec")
def enc_item2vec(spark, sf_dir):
    """K6 re-aimed: client vector = mean item vector over its newest 256 visits."""
    return en.item2vec(_visits(spark, sf_dir), "item", 64)


@register("enc_text")
def enc_text(spark, sf_dir):
    """K9 re-aimed: vectors of the clients' interaction texts (L1), left-truncated."""
    return en.text(ct.interactions(load_fixture(spark, sf_dir), 64), 64, TEXT_TOKENS)


@register("enc_text_searches")
def enc_text_searches(spark, sf_dir):
    """K9 re-aimed: vectors of the clients' search texts (L2), left-truncated."""
    return en.text(ct.searches(load_fixture(spark, sf_dir), 90), 64, TEXT_TOKENS)


CART_STATE_CTES = [
    *CART_SEQ_CTES,
    ("ctok", " UNION ALL ".join(f"SELECT client_id, n - 1 - pos AS age, '{f}=' || {f} AS token FROM cs" for f in sq.CART_FIELDS)),
    ("cstate", f"""SELECT client_id, {draw_sql('token', 42)} % {es.CART_WIDTH} AS slot, sum(power(0.9, age)
                   * CASE WHEN {draw_sql('token', 43)} % 2 = 0 THEN 1.0 ELSE -1.0 END) AS value FROM ctok GROUP BY 1, 2"""),
]


@register("enc_cart_state", with_bindings(*CART_STATE_CTES, body="SELECT client_id, slot, (round(value, 6) + 0.0) AS value FROM cstate"))
def enc_cart_state(spark, sf_dir):
    """K6 on the cart: decayed signed states of 128 slots over sku, category, price and event, order included."""
    return cart_state(load_fixture(spark, sf_dir))


def cart_state(inputs):
    return es.decayed_state(sq.cart_events(inputs), sq.CART_FIELDS, sq.CART_ORDER)


DECODED_FIELDS = ["event", "category", "sku"]
DECODED_STEPS = 5


def _decoding_ctes(f: str) -> list[tuple[str, str]]:
    return [
        (f"best_{f}", f"""SELECT prev, next FROM (SELECT a.{f} AS prev, b.{f} AS next, row_number() OVER (
                            PARTITION BY a.{f} ORDER BY count(*) DESC, b.{f}) AS r
                          FROM cs a JOIN cs b ON a.client_id = b.client_id AND b.pos = a.pos + 1
                          WHERE b.pos < b.n - {DECODED_STEPS} GROUP BY 1, 2) WHERE r = 1"""),
        (f"path_{f}", f"""WITH RECURSIVE p AS (
                            SELECT client_id, 0 AS step, {f} AS v FROM cs WHERE pos = n - {DECODED_STEPS + 1}
                            UNION ALL SELECT client_id, step + 1, b.next FROM p LEFT JOIN best_{f} b ON p.v = b.prev
                            WHERE step < {DECODED_STEPS})
                          SELECT client_id, step, v FROM p"""),
    ]


@register("decode_greedy", with_bindings(*CART_SEQ_CTES, *[c for f in DECODED_FIELDS for c in _decoding_ctes(f)],
    body=f"""SELECT t.client_id, CAST(pe.step AS BIGINT) AS step, {', '.join(f"path_{f}.v AS {f}, t.{f} AS {f}_true" for f in DECODED_FIELDS)}
             FROM path_event pe JOIN cs t ON t.client_id = pe.client_id AND t.pos = t.n - {DECODED_STEPS + 1} + pe.step
             {' '.join(f"JOIN path_{f} ON path_{f}.client_id = pe.client_id AND path_{f}.step = pe.step" for f in DECODED_FIELDS)}
             WHERE pe.step > 0"""))
def decode_greedy(spark, sf_dir):
    """The last five cart events decoded from the one before them, beside the true ones."""
    return de.decode_greedy(sq.cart(load_fixture(spark, sf_dir)), DECODED_FIELDS, DECODED_STEPS)


#: Words of a padded batch that the user's encoder gets.
BATCH_WORDS = 4096


@register("enc_batches", f"""
    WITH tx AS ({INTERACTIONS_SQL})
    SELECT client_id, CAST(length(text) AS DOUBLE) AS chars, CAST(len(list_filter(string_split_regex(text, '\\s+'),
           lambda w: w <> '')) AS DOUBLE) AS words, TRUE AS within FROM tx""")
def enc_batches(spark, sf_dir):
    """H4: a user's batch encoder over the clients' interaction texts, in batches of bounded padded size (here it measures
    each text, and whether its batch kept within the bound)."""
    def measure(texts):
        words = [len(t.split()) for t in texts]
        within = len(texts) == 1 or max(1, *words) * len(words) <= BATCH_WORDS
        return [[len(t), n, within] for t, n in zip(texts, words)]

    out = en.apply_encoder(ct.interactions(load_fixture(spark, sf_dir), 64), measure, 3, budget=BATCH_WORDS)
    at = F.col("embedding")
    return out.select("client_id", at[0].cast("double").alias("chars"), at[1].cast("double").alias("words"), (at[2] == 1).alias("within"))


@register("enc_text_entries", f"""
    WITH tx AS ({INTERACTIONS_SQL}),
    words AS (SELECT client_id, string_split_regex(lower(trim(text)), '\\s+') AS w FROM tx),
    tok AS (SELECT client_id, unnest(w[greatest(len(w) - {TEXT_TOKENS - 1}, 1):]) AS token FROM words)
    SELECT client_id, {draw_sql('token', 42)} % {en.SLOTS} AS slot,
           CAST(sum(CASE WHEN {draw_sql('token', 43)} % 2 = 0 THEN 1 ELSE -1 END) AS DOUBLE) AS value FROM tok GROUP BY 1, 2""")
def enc_text_entries(spark, sf_dir):
    """K9: hashed word bags of the last 512 words of the clients' interaction texts."""
    return en.text_entries(ct.interactions(load_fixture(spark, sf_dir), 64), TEXT_TOKENS)
