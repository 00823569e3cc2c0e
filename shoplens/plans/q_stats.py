"""Client statistics queries and their DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import client_stats as cs
from ..sources.inputs import load_fixture
from .registry import register
from .sqlkit import r6, with_bindings

PREFIX_SRC = {"buy": "r_buy", "add": "r_add", "visit": "r_visit", "remove": "r_remove"}


# ---- oracle fragments ------------------------------------------------------------

def _act_sql(p: str) -> str:
    src = PREFIX_SRC[p]
    d = "CAST(ts AS DATE)"
    return f"""SELECT client_id,
      count(*) AS {p}_total_interactions,
      CASE WHEN count(*) > 1
           THEN (epoch_us(max(ts)) - epoch_us(min(ts))) / 86400000000.0 / (count(*) - 1)
           ELSE 0.0 END AS mean_{p}_interval_days,
      count(*) FILTER (WHERE {d} BETWEEN an - 6 AND an)
        - count(*) FILTER (WHERE {d} BETWEEN an - 13 AND an - 7) AS diff_{p}_week,
      count(*) FILTER (WHERE {d} BETWEEN lm AND last_day(lm))
        - count(*) FILTER (WHERE {d} BETWEEN pm AND last_day(pm)) AS diff_{p}_month,
      CAST(floor((epoch_us(min(ts)) - epoch_us(any_value(st))) / 86400000000.0) AS BIGINT)
        AS {p}_days_from_first_to_start,
      CAST(floor((epoch_us(max(ts)) - epoch_us(any_value(st))) / 86400000000.0) AS BIGINT)
        AS {p}_days_from_last_to_start
    FROM {src}, (SELECT min(ts) AS st, max({d}) AS an,
                        CAST(date_trunc('month', max({d}) - 1) AS DATE) AS lm,
                        CAST(date_trunc('month', max({d}) - 1) - INTERVAL 1 MONTH AS DATE) AS pm
                 FROM {src}) c
    GROUP BY client_id"""


def _item_pop_sql(p: str, item: str) -> str:
    src = PREFIX_SRC[p]
    return f"""SELECT e.client_id, avg(t.tot) AS average_pop_{p}
    FROM {src} e LEFT JOIN (SELECT {item}, count(*) AS tot FROM {src} WHERE {item} IS NOT NULL GROUP BY {item}) t
      ON e.{item} = t.{item}
    GROUP BY e.client_id"""


def _cat_pop_sql(p: str) -> str:
    src = PREFIX_SRC[p]
    return f"""SELECT ec.client_id, avg(ct.tot) AS category_popularity_{p}
    FROM (SELECT e.client_id, pp.category FROM {src} e LEFT JOIN product_properties pp ON e.sku = pp.sku) ec
    LEFT JOIN (SELECT pp.category, count(*) AS tot FROM {src} e LEFT JOIN product_properties pp ON e.sku = pp.sku
               WHERE pp.category IS NOT NULL GROUP BY pp.category) ct ON ec.category = ct.category
    GROUP BY ec.client_id"""


STABILITY_SQL = """SELECT client_id, count(DISTINCT strftime(ts, '%Y-%U')) AS unique_weeks,
    count(DISTINCT strftime(ts, '%Y-%m')) AS unique_months FROM r_visit GROUP BY client_id"""

PRICE_SQL = """SELECT e.client_id, CAST(sum(pp.price) AS BIGINT) AS total_spent, avg(pp.price) AS average_spent
    FROM r_buy e LEFT JOIN product_properties pp ON e.sku = pp.sku GROUP BY e.client_id"""

CONV_SKU_SQL = """SELECT a.client_id, avg(CASE WHEN b.client_id IS NULL THEN 0.0 ELSE 1.0 END) AS bought
    FROM (SELECT DISTINCT client_id, sku FROM r_add) a
    LEFT JOIN (SELECT DISTINCT client_id, sku FROM r_buy) b ON a.client_id = b.client_id AND a.sku = b.sku
    GROUP BY a.client_id"""

CONV_CAT_SQL = """SELECT a.client_id, avg(CASE WHEN b.client_id IS NULL THEN 0.0 ELSE 1.0 END) AS bought_cat
    FROM (SELECT DISTINCT e.client_id, pp.category FROM r_add e LEFT JOIN product_properties pp ON e.sku = pp.sku) a
    LEFT JOIN (SELECT DISTINCT e.client_id, pp.category FROM r_buy e LEFT JOIN product_properties pp ON e.sku = pp.sku) b
      ON a.client_id = b.client_id AND a.category IS NOT DISTINCT FROM b.category
    GROUP BY a.client_id"""

DOUBLE_PREFIXES = ("mean_", "average_", "category_popularity_", "bought")


def _is_double(col: str) -> bool:
    return col.startswith(DOUBLE_PREFIXES) or col == "average_spent"


def merged_sql(parts: dict[str, str], columns: list[str]) -> str:
    """Relevant clients LEFT JOIN every part, missing → 0, doubles rounded."""
    joins = " ".join(f"LEFT JOIN {name} USING (client_id)" for name in parts)
    sel = []
    for c in columns:
        e = f"coalesce({c}, 0)"
        sel.append(f"{r6(e)} AS {c}" if _is_double(c) else f"{e} AS {c}")
    body = f"SELECT client_id, {', '.join(sel)} FROM relevant_clients {joins}"
    return with_bindings(*parts.items(), body=body)


def _cols(prefixes, templates):
    return [t.format(p=p) for p in prefixes for t in templates]


ACT_PARTS = {f"act_{p}": _act_sql(p) for p in cs.ALL_PREFIXES}
ALL_PARTS = dict(ACT_PARTS)
for _p in cs.ACTION_PREFIXES:
    ALL_PARTS[f"catpop_{_p}"] = _cat_pop_sql(_p)
    ALL_PARTS[f"pop_{_p}"] = _item_pop_sql(_p, "sku")
ALL_PARTS["pop_visit"] = _item_pop_sql("visit", "url")
ALL_PARTS["stab"] = STABILITY_SQL
ALL_PARTS["price"] = PRICE_SQL
ALL_PARTS["conv"] = CONV_SKU_SQL
ALL_PARTS["convcat"] = CONV_CAT_SQL


# ---- Spark side ---------------------------------------------------------------------

def _merge(inputs, parts, columns):
    return cs.merge_features(inputs.relevant_clients, parts, columns)


def _act_family(spark, sf_dir, templates):
    inputs = load_fixture(spark, sf_dir)
    ev = cs.relevant_events(inputs)
    cols = _cols(cs.ALL_PREFIXES, templates)
    parts = [cs.activity(ev[p], p).select("client_id", *[t.format(p=p) for t in templates])
             for p in cs.ALL_PREFIXES]
    return _merge(inputs, parts, cols)


T_TOTAL = ["{p}_total_interactions"]
T_INTERVAL = ["mean_{p}_interval_days"]
T_DIFF = ["diff_{p}_week", "diff_{p}_month"]
T_DAYS = ["{p}_days_from_first_to_start", "{p}_days_from_last_to_start"]


@register("stat_total_interactions", merged_sql(ACT_PARTS, _cols(cs.ALL_PREFIXES, T_TOTAL)))
def stat_total_interactions(spark, sf_dir):
    """Minimum slice: relevant events → count per client → left join to all relevant clients → 0."""
    inputs = load_fixture(spark, sf_dir)
    ev = cs.relevant_events(inputs)
    parts = [cs.interaction_count(ev[p], p) for p in cs.ALL_PREFIXES]
    return _merge(inputs, parts, _cols(cs.ALL_PREFIXES, T_TOTAL))


@register("stat_intervals", merged_sql(ACT_PARTS, _cols(cs.ALL_PREFIXES, T_INTERVAL)))
def stat_intervals(spark, sf_dir):
    inputs = load_fixture(spark, sf_dir)
    ev = cs.relevant_events(inputs)
    parts = [cs.mean_interval(ev[p], p) for p in cs.ALL_PREFIXES]
    return _merge(inputs, parts, _cols(cs.ALL_PREFIXES, T_INTERVAL))


@register("stat_week_month_diff", merged_sql(ACT_PARTS, _cols(cs.ALL_PREFIXES, T_DIFF)))
def stat_week_month_diff(spark, sf_dir):
    return _act_family(spark, sf_dir, T_DIFF)


@register("stat_days_to_start", merged_sql(ACT_PARTS, _cols(cs.ALL_PREFIXES, T_DAYS)))
def stat_days_to_start(spark, sf_dir):
    return _act_family(spark, sf_dir, T_DAYS)


@register("stat_stability", merged_sql({"stab": STABILITY_SQL}, ["unique_weeks", "unique_months"]))
def stat_stability(spark, sf_dir):
    inputs = load_fixture(spark, sf_dir)
    ev = cs.relevant_events(inputs)
    return _merge(inputs, [cs.stability(ev["visit"])], ["unique_weeks", "unique_months"])


@register("stat_sku_popularity", merged_sql({f"pop_{p}": _item_pop_sql(p, "sku") for p in cs.ACTION_PREFIXES},
                                            [f"average_pop_{p}" for p in cs.ACTION_PREFIXES]))
def stat_sku_popularity(spark, sf_dir):
    inputs = load_fixture(spark, sf_dir)
    ev = cs.relevant_events(inputs)
    parts = [cs.item_popularity(ev[p], "sku", p) for p in cs.ACTION_PREFIXES]
    return _merge(inputs, parts, [f"average_pop_{p}" for p in cs.ACTION_PREFIXES])


@register("stat_category_popularity", merged_sql({f"catpop_{p}": _cat_pop_sql(p) for p in cs.ACTION_PREFIXES},
                                                 [f"category_popularity_{p}" for p in cs.ACTION_PREFIXES]))
def stat_category_popularity(spark, sf_dir):
    inputs = load_fixture(spark, sf_dir)
    ev = cs.relevant_events(inputs)
    parts = [cs.category_popularity(ev[p], inputs.product_properties, p) for p in cs.ACTION_PREFIXES]
    return _merge(inputs, parts, [f"category_popularity_{p}" for p in cs.ACTION_PREFIXES])


@register("stat_url_popularity", merged_sql({"pop_visit": _item_pop_sql("visit", "url")}, ["average_pop_visit"]))
def stat_url_popularity(spark, sf_dir):
    inputs = load_fixture(spark, sf_dir)
    ev = cs.relevant_events(inputs)
    return _merge(inputs, [cs.item_popularity(ev["visit"], "url", "visit")], ["average_pop_visit"])


@register("stat_price", merged_sql({"price": PRICE_SQL}, ["total_spent", "average_spent"]))
def stat_price(spark, sf_dir):
    inputs = load_fixture(spark, sf_dir)
    ev = cs.relevant_events(inputs)
    return _merge(inputs, [cs.price(ev["buy"], inputs.product_properties)], ["total_spent", "average_spent"])


@register("stat_conversion_sku", merged_sql({"conv": CONV_SKU_SQL}, ["bought"]))
def stat_conversion_sku(spark, sf_dir):
    inputs = load_fixture(spark, sf_dir)
    ev = cs.relevant_events(inputs)
    return _merge(inputs, [cs.conversion(ev["add"], ev["buy"], "sku", "bought")], ["bought"])


@register("stat_conversion_category", merged_sql({"convcat": CONV_CAT_SQL}, ["bought_cat"]))
def stat_conversion_category(spark, sf_dir):
    inputs = load_fixture(spark, sf_dir)
    ev = cs.relevant_events(inputs)
    p = inputs.product_properties
    part = cs.conversion(cs.with_category(ev["add"], p), cs.with_category(ev["buy"], p), "category", "bought_cat")
    return _merge(inputs, [part], ["bought_cat"])


@register("stat_features_all", merged_sql(ALL_PARTS, cs.feature_columns()))
def stat_features_all(spark, sf_dir):
    """Flagship: the full 37-column statistics table (submit mode: every relevant client)."""
    return cs.features_all(load_fixture(spark, sf_dir), submit=True)


_LOCAL_FILTER = " OR ".join(f"{c} <> 0" for c in cs.feature_columns())


@register("stat_features_local",
          "SELECT * FROM (" + merged_sql(ALL_PARTS, cs.feature_columns()) + f") WHERE {_LOCAL_FILTER}")
def stat_features_local(spark, sf_dir):
    """local mode drops clients whose 37 features are all 0."""
    return cs.features_all(load_fixture(spark, sf_dir), submit=False)


__all__ = ["F"]
