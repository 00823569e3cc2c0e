"""Vector queries, on two blocks cut from the ``embeddings`` table."""

from __future__ import annotations

import os
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import functions as F

from ..functions.draws import draw, draw_sql
from ..functions.halves import to_half
from ..operators import client_stats as cs
from ..operators import client_text as ct
from ..operators import encoders as en
from ..operators import event_state as es
from ..operators import factors
from ..operators import interactions as ia
from ..operators import merge_run
from ..operators import sequences as sq
from ..operators import transformers as tf
from ..operators import vectors as vx
from ..session import cut_lineage, scratch_dir
from ..sources.inputs import load_fixture
from ..sources.sinks import write_embedding_table
from .q_enc import BAG_FIELDS, CART_STATE_CTES, EVENT_FIELDS, TEXT_TOKENS, WEEK_FIELDS, cart_state
from .q_seq import VISIT_MIN
from .q_stats import ALL_PARTS, merged_sql
from .registry import register, round_doubles
from .sqlkit import with_bindings


def blocks(spark, sf_dir):
    """FIXTURES.md §2: block_a (32 wide, zero vectors where label = 9), block_b (32 wide)."""
    e = spark.read.parquet(os.path.join(sf_dir, "embeddings.parquet"))
    a = e.where(F.col("label") != 0).select(
        F.col("vec_id").cast("long").alias("client_id"),
        F.when(F.col("label") == 9, F.array_repeat(F.lit(0.0).cast("float"), 32))
         .otherwise(F.slice("embedding", 1, 32)).alias("embedding"))
    b = e.where(F.col("vec_id") % 4 != 0).select(
        F.col("vec_id").cast("long").alias("client_id"), F.slice("embedding", 33, 32).alias("embedding"))
    return a, b


def whole(spark, sf_dir):
    """All rows and positions of ``embeddings``; zero vectors where label = 9."""
    e = spark.read.parquet(os.path.join(sf_dir, "embeddings.parquet"))
    zero = F.array_repeat(F.lit(0.0).cast("float"), F.size("embedding"))
    return e.select(F.col("vec_id").cast("long").alias("client_id"),
                    F.when(F.col("label") == 9, zero).otherwise(F.col("embedding")).alias("embedding"))


WHOLE_CTES = [
    ("whole", """SELECT vec_id AS client_id, CASE WHEN label = 9 THEN list_transform(embedding, lambda x: CAST(0 AS FLOAT))
                 ELSE embedding END AS embedding FROM embeddings"""),
    ("sw", "SELECT * FROM whole WHERE len(list_filter(embedding, lambda x: x <> 0)) > 0"),
    ("lw", """SELECT client_id, CAST(generate_subscripts(embedding, 1) - 1 AS BIGINT) AS pos,
                     CAST(unnest(embedding) AS DOUBLE) AS value FROM sw"""),
]


def quantile_ctes(cells: str, fit: str | None = None) -> list[tuple[str, str]]:
    """``q0`` → ``grid``: min(1000, n) interpolated order statistics per position of ``fit`` (default: of the cells);
    ``mapped``: the place of every cell of ``cells (client_id, pos, value)`` between the last grid point not above and
    the first not below it."""
    return [
        ("q0", f"SELECT pos, value, row_number() OVER (PARTITION BY pos ORDER BY value) - 1 AS r, "
               f"count(*) OVER (PARTITION BY pos) AS n FROM {fit or cells}"),
        ("q1", "SELECT pos, n, least(n, 1000) AS m, unnest(range(least(n, 1000))) AS k FROM (SELECT DISTINCT pos, n FROM q0)"),
        ("q2", """SELECT pos, k, m, CASE WHEN m = 1 THEN 0 ELSE k * (n - 1) // (m - 1) END AS lo,
                         CASE WHEN m = 1 THEN 0 ELSE (k * (n - 1) + m - 2) // (m - 1) END AS hi,
                         CASE WHEN m = 1 THEN 0.0 ELSE k * (n - 1) / (m - 1) - k * (n - 1) // (m - 1) END AS part FROM q1"""),
        ("grid", """SELECT q2.pos, any_value(m) AS m, list(a.value + (b.value - a.value) * part ORDER BY k) AS q
                    FROM q2 JOIN q0 a ON a.pos = q2.pos AND a.r = lo JOIN q0 b ON b.pos = q2.pos AND b.r = hi GROUP BY q2.pos"""),
        ("mapped", f"""SELECT client_id, c.pos, value, m, q[1] AS mn, q[m] AS mx,
                       len(list_filter(q, lambda v: v <= value)) AS le, len(list_filter(q, lambda v: v < value)) AS lt, q
                       FROM {cells} c JOIN grid g ON c.pos = g.pos"""),
    ]


QUANTILE = """CASE WHEN m = 1 OR value - 1e-7 < mn THEN 0.0 WHEN value + 1e-7 > mx THEN 1.0
              WHEN le = lt THEN (le - 1 + (value - q[le]) / (q[le + 1] - q[le])) / (m - 1)
              ELSE (le - 1 + lt) / 2.0 / (m - 1) END"""

BLOCK_CTES = [
    ("blk_a", """SELECT vec_id AS client_id, CASE WHEN label = 9 THEN list_transform(range(32), lambda i: CAST(0 AS FLOAT))
                 ELSE embedding[1:32] END AS embedding FROM embeddings WHERE label <> 0"""),
    ("blk_b", "SELECT vec_id AS client_id, embedding[33:64] AS embedding FROM embeddings WHERE vec_id % 4 <> 0"),
    ("sa", "SELECT * FROM blk_a WHERE len(list_filter(embedding, lambda x: x <> 0)) > 0"),
    ("la", """SELECT client_id, CAST(generate_subscripts(embedding, 1) - 1 AS BIGINT) AS pos,
                     CAST(unnest(embedding) AS DOUBLE) AS value FROM sa"""),
    ("lb", """SELECT client_id, CAST(generate_subscripts(embedding, 1) - 1 AS BIGINT) AS pos,
                     CAST(unnest(embedding) AS DOUBLE) AS value FROM blk_b"""),
    ("merged", """SELECT g.client_id, g.pos, coalesce(la.value, lb.value) AS value
                  FROM (SELECT client_id, CAST(unnest(range(64)) AS BIGINT) AS pos
                        FROM (SELECT client_id FROM sa UNION SELECT client_id FROM blk_b)) g
                  LEFT JOIN la ON g.client_id = la.client_id AND g.pos = la.pos
                  LEFT JOIN lb ON g.client_id = lb.client_id AND lb.pos + 32 = g.pos"""),
]


def _out(expr_sql: str) -> str:
    return f"SELECT client_id, pos, (round({expr_sql}, 6) + 0.0) AS value FROM "


@register("vec_sanitize", with_bindings(*WHOLE_CTES, body=_out("value") + "lw"))
def vec_sanitize(spark, sf_dir):
    """Zero vectors removed (long form)."""
    return vx.explode_vectors(vx.sanitize(whole(spark, sf_dir)))


@register("vec_normalize", with_bindings(*WHOLE_CTES, body=_out(
    "CASE WHEN nrm = 0 THEN value ELSE value / nrm END")
    + "(SELECT *, sqrt(sum(value * value) OVER (PARTITION BY client_id)) AS nrm FROM lw)"))
def vec_normalize(spark, sf_dir):
    """V5: L2-normalized rows."""
    return vx.explode_vectors(vx.l2_normalize(vx.sanitize(whole(spark, sf_dir))))


@register("vec_outer_merge", with_bindings(*BLOCK_CTES, body=_out("value") + "merged"))
def vec_outer_merge(spark, sf_dir):
    """Full outer merge of the two blocks, missing blocks as nulls."""
    a, b = blocks(spark, sf_dir)
    return vx.explode_vectors(vx.outer_merge([vx.sanitize(a), b]))


@register("vec_complete", with_bindings(*BLOCK_CTES, body=_out("coalesce(lb.value, 0.0)") + """
    (SELECT r.client_id, g.pos, lb.value FROM relevant_clients r
       CROSS JOIN (SELECT CAST(unnest(range(32)) AS BIGINT) AS pos) g
       LEFT JOIN lb ON r.client_id = lb.client_id AND g.pos = lb.pos) lb"""))
def vec_complete(spark, sf_dir):
    """Restricted to relevant clients, the missing ones filled with zeros."""
    _, b = blocks(spark, sf_dir)
    rel = load_fixture(spark, sf_dir).relevant_clients
    return vx.explode_vectors(vx.complete(b, rel, 32, 0.0))


@register("vec_impute_mean", with_bindings(*BLOCK_CTES, body=_out("coalesce(value, avg(value) OVER (PARTITION BY pos))") + "merged"))
def vec_impute_mean(spark, sf_dir):
    """V9 (mean): nulls of the outer merge replaced by their position's mean."""
    a, b = blocks(spark, sf_dir)
    return vx.explode_vectors(vx.impute_mean(vx.outer_merge([vx.sanitize(a), b])))


@register("vec_impute_constant", with_bindings(*BLOCK_CTES, body=_out("coalesce(value, 0.0)") + "merged"))
def vec_impute_constant(spark, sf_dir):
    """V9 (constant): nulls of the outer merge replaced by 0."""
    a, b = blocks(spark, sf_dir)
    return vx.explode_vectors(vx.impute_constant(vx.outer_merge([vx.sanitize(a), b])))


@register("vec_quantile", with_bindings(*WHOLE_CTES, *quantile_ctes("lw"), body=_out(QUANTILE) + "mapped"))
def vec_quantile(spark, sf_dir):
    """V6: per-position quantile in [0, 1] (ties → mid-rank)."""
    return vx.explode_vectors(vx.quantile_transform(vx.sanitize(whole(spark, sf_dir))))


_STAT_CELLS = "SELECT client_id, CAST(pos AS BIGINT) AS pos, value FROM (" + " UNION ALL ".join(
    f"SELECT client_id, {i} AS pos, floor(CAST({c} AS DOUBLE) * 1000 + 0.0005) AS value FROM stats" for i, c in enumerate(cs.feature_columns())) + ")"


@register("vec_quantile_stats", "WITH stats AS (" + merged_sql(ALL_PARTS, cs.feature_columns()) + "), cells AS ("
          + _STAT_CELLS + "), " + ", ".join(f"{n} AS ({q})" for n, q in quantile_ctes("cells"))
          + " " + _out(QUANTILE) + "mapped")
def vec_quantile_stats(spark, sf_dir):
    """V6 over the 37 client statistics in thousandths (many ties, more rows than quantiles)."""
    return vx.explode_vectors(vx.quantile_transform(whole_statistics(spark, sf_dir)))


def whole_statistics(spark, sf_dir):
    """The 37 statistics in whole thousandths, written once (the transform reads them twice)."""
    stats = round_doubles(cs.features_all(load_fixture(spark, sf_dir), submit=True))
    cells = F.array([F.floor(F.col(c).cast("double") * 1000 + 0.0005).cast("double") for c in cs.feature_columns()])
    return cut_lineage(stats.select("client_id", cells.alias("embedding")))


@register("vec_scale_global", with_bindings(*WHOLE_CTES, body=_out("(value - mu) / sd") + """
    (SELECT lw.*, s.mu, s.sd FROM lw, (SELECT avg(value) AS mu, stddev_pop(value) AS sd FROM lw) s)"""))
def vec_scale_global(spark, sf_dir):
    """V7 (global): one standard scaler fitted over all cells of the table."""
    return vx.explode_vectors(vx.scale_global_standard(vx.sanitize(whole(spark, sf_dir))))


@register("vec_cov", with_bindings(*WHOLE_CTES, body="""
    SELECT a.pos AS pos, b.pos AS other, (round(covar_samp(a.value, b.value), 6) + 0.0) AS value
    FROM lw a JOIN lw b ON a.client_id = b.client_id GROUP BY a.pos, b.pos"""))
def vec_cov(spark, sf_dir):
    """V4 fit: the covariance whose eigenvectors the PCA takes."""
    return vx.covariance_rows(vx.sanitize(whole(spark, sf_dir)))


@register("vec_pca_norms", with_bindings(*WHOLE_CTES, body="""
    SELECT client_id, (round(sqrt(sum((value - mu) * (value - mu))), 6) + 0.0) AS norm
    FROM (SELECT *, avg(value) OVER (PARTITION BY pos) AS mu FROM lw) GROUP BY client_id"""))
def vec_pca_norms(spark, sf_dir):
    """V4 at full rank keeps every centred row's length."""
    full = vx.pca(vx.sanitize(whole(spark, sf_dir)), 64)
    return full.select("client_id", F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x)).alias("norm"))


@register("vec_pca")
def vec_pca(spark, sf_dir):
    """V4: centred PCA to 16 components (eigenvectors: numpy-checked in tests; covariance and row lengths have SQL)."""
    return vx.explode_vectors(vx.pca(vx.sanitize(whole(spark, sf_dir)), 16))


@register("vec_merge_all")
def vec_merge_all(spark, sf_dir):
    """The merge pipeline: statistics (quantile), block_a (L2), block_b (PCA 16 + L2), submit
    mode (completed to the relevant clients), mean imputation."""
    inputs = load_fixture(spark, sf_dir)
    a, b = blocks(spark, sf_dir)
    stats = cs.as_embedding(cs.features_all(inputs))
    specs = [
        vx.TableSpec("stat_features", stats, scaler="quantile"),
        vx.TableSpec("block_a", a, scaler="normalizer"),
        vx.TableSpec("block_b", b, processor=("pca", 16), scaler="normalizer"),
    ]
    return vx.merge_all(specs, relevant=inputs.relevant_clients, impute="mean")


_MERGED_STATS = "WITH stats AS (" + merged_sql(ALL_PARTS, cs.feature_columns()) + "), cells AS (" + _STAT_CELLS + "), " \
    + ", ".join(f"{n} AS ({q})" for n, q in quantile_ctes("cells")) \
    + f" SELECT client_id, pos, {QUANTILE} AS value FROM mapped"


@register("vec_merge_sql", with_bindings(*BLOCK_CTES,
    ("sq", _MERGED_STATS),
    ("na", "SELECT client_id, pos, CASE WHEN n = 0 THEN value ELSE value / n END AS value FROM (SELECT *, sqrt(sum(value * value) OVER (PARTITION BY client_id)) AS n FROM la)"),
    ("nb", "SELECT client_id, pos, CASE WHEN n = 0 THEN value ELSE value / n END AS value FROM (SELECT *, sqrt(sum(value * value) OVER (PARTITION BY client_id)) AS n FROM lb)"),
    ("grid3", f"SELECT client_id, CAST(unnest(range({len(cs.feature_columns())} + 64)) AS BIGINT) AS pos FROM relevant_clients"),
    ("m3", f"""SELECT g.client_id, g.pos, coalesce(sq.value, na.value, nb.value) AS value FROM grid3 g
               LEFT JOIN sq ON sq.client_id = g.client_id AND sq.pos = g.pos
               LEFT JOIN na ON na.client_id = g.client_id AND na.pos + {len(cs.feature_columns())} = g.pos
               LEFT JOIN nb ON nb.client_id = g.client_id AND nb.pos + {len(cs.feature_columns()) + 32} = g.pos"""),
    body=_out("coalesce(value, avg(value) OVER (PARTITION BY pos))") + "m3"))
def vec_merge_sql(spark, sf_dir):
    """The merge pipeline without PCA, end to end: statistics in thousandths (quantile), both blocks (L2), outer merge,
    completion with the relevant clients, mean imputation."""
    inputs = load_fixture(spark, sf_dir)
    a, b = blocks(spark, sf_dir)
    specs = [vx.TableSpec("stat_features", whole_statistics(spark, sf_dir), scaler="quantile"),
             vx.TableSpec("block_a", a, scaler="normalizer"), vx.TableSpec("block_b", b, scaler="normalizer")]
    merged = vx.merge_all(specs, relevant=inputs.relevant_clients, impute="mean", drop_zeros_of={"block_a"})
    return vx.explode_vectors(merged)


# ---- half precision, saved steps, runs from a configuration -------------------------------

def half_sql(x: str) -> str:
    """``x`` rounded to half precision: nearest, ties to even."""
    near = f"floor(log2(abs({x})))"
    exact = f"({near} + CASE WHEN power(2.0, {near} + 1) <= abs({x}) THEN 1 WHEN power(2.0, {near}) > abs({x}) THEN -1 ELSE 0 END)"
    unit = f"power(2.0, greatest({exact}, -14) - 10)"
    size = f"round_even(abs({x}) / {unit}, 0) * {unit}"
    return f"CASE WHEN {x} IS NULL OR {x} = 0 THEN {x} WHEN {size} > 65504 THEN sign({x}) * 'inf'::DOUBLE ELSE sign({x}) * {size} END"


@register("vec_half", with_bindings(*WHOLE_CTES,
    ("wide", "SELECT client_id, pos, value * power(2.0, pos % 64 - 36) AS x FROM lw"),
    ("h", f"SELECT client_id, pos, {half_sql('x')} AS h FROM wide"),
    body="""SELECT client_id, pos, CASE WHEN NOT isinf(h) THEN CAST(h * 16777216 AS BIGINT) END AS units, isinf(h) AS overflow FROM h"""))
def vec_half(spark, sf_dir):
    """Every number of the vectors, spread over the range of halves and beyond, as a half: in units of 2^-24."""
    cells = vx.explode_vectors(vx.sanitize(whole(spark, sf_dir)))
    x = F.col("value") * F.pow(F.lit(2.0), (F.col("pos") % 64 - 36).cast("double"))
    h = cells.select("client_id", "pos", to_half(x).alias("h"))
    over = F.abs("h") == float("inf")
    return h.select("client_id", "pos", F.when(~over, (F.col("h") * 16777216).cast("long")).alias("units"), over.alias("overflow"))


SAVED_STEPS = [{"name": "StandardScaler"}, {"name": "MinMaxScaler"}, {"name": "QuantileTransformer"}, {"name": "Normalizer"}]


@register("vec_saved_steps", with_bindings(*WHOLE_CTES,
    ("known", f"SELECT * FROM lw WHERE {draw_sql('client_id', 9)} % 2 = 0"),
    ("other", f"SELECT * FROM lw WHERE {draw_sql('client_id', 9)} % 2 = 1"),
    ("cols", "SELECT pos, avg(value) AS mu, stddev_pop(value) AS sd, min(value) AS lo, max(value) AS hi FROM known GROUP BY pos"),
    *quantile_ctes("other", "known"),
    body=f"""SELECT 'StandardScaler' AS step, client_id, pos, (round((value - mu) / CASE WHEN sd = 0 THEN 1 ELSE sd END, 6) + 0.0) AS value FROM other JOIN cols USING (pos)
      UNION ALL SELECT 'MinMaxScaler', client_id, pos, (round((value - lo) / CASE WHEN hi = lo THEN 1 ELSE hi - lo END, 6) + 0.0) FROM other JOIN cols USING (pos)
      UNION ALL SELECT 'QuantileTransformer', client_id, pos, (round({QUANTILE}, 6) + 0.0) FROM mapped
      UNION ALL SELECT 'Normalizer', client_id, pos, (round(value / sqrt(sum(value * value) OVER (PARTITION BY client_id)), 6) + 0.0) FROM other"""))
def vec_saved_steps(spark, sf_dir):
    """V3 / H1: steps fitted on one half of the vectors, saved, read back and applied to the other half."""
    table = cut_lineage(vx.sanitize(whole(spark, sf_dir)))
    half = draw("client_id", 9) % 2
    known, other = table.where(half == 0), table.where(half == 1)
    out = None
    for step in SAVED_STEPS:
        path = tf.fit(known, step).save(spark, scratch_dir(spark, "step"))
        made = vx.explode_vectors(tf.load(spark, path).transform(other)).select(F.lit(step["name"]).alias("step"), "*")
        out = made if out is None else out.unionByName(made)
    return out


def _normalized(name: str, components: int | None = None) -> dict:
    processor = {"processor": {"_target_": "sklearn.decomposition.PCA", "n_components": components}} if components else {}
    return {"name": name, **processor, "scaler": {"_target_": "sklearn.preprocessing.Normalizer"}}


#: The twelve tables of the original's best run, in its order, with their steps.
BEST_RUN = {
    "save_name": "best_solution", "submit": True, "drop_zeros": True,
    "embeddings_list": [
        _normalized("als_64_buy_add_categories"),
        _normalized("als_64_visits_relevant"),
        _normalized("next_sku_128_4_4"),
        _normalized("next_url_192_6_4"),
        {"name": "stat_features", "scaler": {"_target_": "sklearn.preprocessing.QuantileTransformer", "output_distribution": "uniform"}},
        _normalized("gru_ae_day_event"),
        _normalized("gru_ae_sku_text", 64),
        _normalized("smollm2_all_interactions", 128),
        _normalized("search_llm", 64),
        _normalized("gru_ae_event_cat_price_sku_url", 64),
        _normalized("gru_ae_week_event_cat_price_sku_url", 64),
        _normalized("lightfm"),
    ],
    "imputer": {"_target_": "sklearn.impute.SimpleImputer", "strategy": "mean"},
}


def _tables(spark, sf_dir) -> dict:
    """Builders of the twelve tables, by name. Tables that the run reduces come as hashed bags, the others final."""
    inputs = load_fixture(spark, sf_dir)
    signed = ia.signed(inputs)

    return {
        "als_64_buy_add_categories": lambda: factors.als(ia.buy_add(inputs, "category"), "category"),
        "als_64_visits_relevant": lambda: factors.als(ia.visits(inputs), "url"),
        "next_sku_128_4_4": lambda: es.dense(cart_state(inputs), es.CART_WIDTH),
        "next_url_192_6_4": lambda: en.item2vec(sq.visits(inputs, VISIT_MIN, last=256).select(
            "client_id", F.col("time_idx").alias("pos"), F.col("url_code").alias("item")), "item", 192),
        "stat_features": lambda: cs.as_embedding(cs.features_all(inputs)),
        "gru_ae_day_event": lambda: en.state_pca(sq.event_days(inputs), EVENT_FIELDS, sq.EVENT_DAY_ORDER, 64),
        "gru_ae_sku_text": lambda: en.bag_vectors(en.field_entries(sq.sku_text(inputs), ["text"])),
        "smollm2_all_interactions": lambda: en.bag_vectors(en.text_entries(ct.interactions(inputs, 64), TEXT_TOKENS)),
        "search_llm": lambda: en.bag_vectors(en.text_entries(ct.searches(inputs, 90), TEXT_TOKENS)),
        "gru_ae_event_cat_price_sku_url": lambda: en.bag_vectors(en.field_entries(sq.full(inputs, BAG_FIELDS), BAG_FIELDS)),
        "gru_ae_week_event_cat_price_sku_url": lambda: en.bag_vectors(en.field_entries(sq.full(inputs, WEEK_FIELDS), WEEK_FIELDS)),
        "lightfm": lambda: factors.als_signed(signed, ia.search_codes(inputs), ia.item_codes_long(inputs.product_properties, signed)),
    }


#: Tables with sums beyond the range of halves: kept as floats.
SINGLE = {"stat_features"}


#: Tables that are made at the same time: one table's short jobs leave cores to the others.
AT_ONCE = 3


def _run_over(spark, config: dict, tables: dict, relevant):
    base = scratch_dir(spark, "run")
    path = merge_run.save_run(spark, base, config)

    def made(name: str) -> str:
        return write_embedding_table(tables[name](), merge_run.tables_dir(base, config), name, half=name not in SINGLE)

    with ThreadPoolExecutor(AT_ONCE) as pool:
        written = [pool.submit(inheritable_thread_target(spark)(made), table["name"]) for table in config["embeddings_list"]]
        try:
            for job in written:
                job.result()
        finally:
            pool.shutdown(cancel_futures=True)
    return merge_run.run(spark, path, base, relevant)


@register("vec_merge_run")
def vec_merge_run(spark, sf_dir):
    """The run over all twelve tables, each written in half precision (statistics as floats), read
    back by name, checked, processed and scaled as the saved configuration says, merged, completed and imputed."""
    return _run_over(spark, BEST_RUN, _tables(spark, sf_dir), load_fixture(spark, sf_dir).relevant_clients)


SQL_RUN = {
    "save_name": "tables_with_sql", "submit": True, "drop_zeros": True,
    "embeddings_list": [
        {"name": "stat_features", "scaler": {"name": "QuantileTransformer"}},
        {"name": "next_sku_128_4_4", "scaler": {"name": "Normalizer"}},
        {"name": "search_mean", "scaler": {"name": "StandardScaler"}},
    ],
    "imputer": {"name": "SimpleImputer", "strategy": "mean"},
}
_STATS = len(cs.feature_columns())


@register("vec_merge_config", with_bindings(*CART_STATE_CTES,
    ("sq", "WITH stats AS (" + merged_sql(ALL_PARTS, cs.feature_columns()) + "), raw AS (" + _STAT_CELLS + "), "
           + "single AS (SELECT client_id, pos, CAST(CAST(value AS REAL) AS DOUBLE) AS value FROM raw), "
           + "cells AS (SELECT * FROM single WHERE client_id IN (SELECT client_id FROM single WHERE value <> 0)), "
           + ", ".join(f"{n} AS ({q})" for n, q in quantile_ctes("cells"))
           + f" SELECT client_id, pos, {QUANTILE} AS value FROM mapped"),
    ("cl0", "SELECT DISTINCT client_id FROM cstate"),
    ("ch", f"SELECT client_id, slot AS pos, {half_sql('value')} AS value FROM cstate"),
    ("cn", """SELECT client_id, pos, value / sqrt(sum(value * value) OVER (PARTITION BY client_id)) AS value FROM ch"""),
    ("sm0", """SELECT client_id, pos, avg(v) AS m FROM (
                 SELECT client_id, CAST(generate_subscripts(c, 1) - 1 AS BIGINT) AS pos, CAST(unnest(c) AS DOUBLE) AS v FROM (
                   SELECT client_id, list_transform(regexp_extract_all(query, '(\\d+)', 1), lambda x: CAST(x AS BIGINT)) AS c FROM r_search))
               GROUP BY client_id, pos"""),
    ("sh", f"SELECT client_id, pos, {half_sql('m')} AS value FROM sm0"),
    ("sn", """SELECT client_id, pos, (value - avg(value) OVER w) / CASE WHEN stddev_pop(value) OVER w = 0 THEN 1 ELSE stddev_pop(value) OVER w END AS value
              FROM sh WINDOW w AS (PARTITION BY pos)"""),
    ("grid", f"SELECT client_id, CAST(unnest(range({_STATS} + {es.CART_WIDTH} + 16)) AS BIGINT) AS pos FROM relevant_clients"),
    ("m", f"""SELECT g.client_id, g.pos, CASE WHEN g.pos < {_STATS} THEN sq.value WHEN g.pos >= {_STATS + es.CART_WIDTH} THEN sn.value
                     WHEN c.client_id IS NOT NULL THEN coalesce(cn.value, 0) END AS value
              FROM grid g LEFT JOIN sq ON sq.client_id = g.client_id AND sq.pos = g.pos
              LEFT JOIN cl0 c ON c.client_id = g.client_id
              LEFT JOIN cn ON cn.client_id = g.client_id AND cn.pos + {_STATS} = g.pos
              LEFT JOIN sn ON sn.client_id = g.client_id AND sn.pos + {_STATS + es.CART_WIDTH} = g.pos"""),
    ("im", "SELECT client_id, pos, coalesce(value, avg(value) OVER (PARTITION BY pos)) AS value FROM m"),
    body=_out(half_sql("value")) + "im"))
def vec_merge_config(spark, sf_dir):
    """V8 end to end from a saved configuration: statistics in thousandths (quantiles, kept as floats), cart states
    (length 1) and mean search vectors (standardized), both kept as halves, merged, completed, imputed with means and kept
    as halves."""
    inputs = load_fixture(spark, sf_dir)
    tables = {"stat_features": lambda: whole_statistics(spark, sf_dir),
              "next_sku_128_4_4": lambda: es.dense(cart_state(inputs), es.CART_WIDTH),
              "search_mean": lambda: ia.search_mean(inputs)}
    return vx.explode_vectors(_run_over(spark, SQL_RUN, tables, inputs.relevant_clients))
