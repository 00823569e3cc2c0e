"""Client-text queries."""

from __future__ import annotations

from ..operators import client_text as ct
from ..sources.inputs import load_fixture
from .registry import register
from .sqlkit import with_bindings

NL = "chr(10)"
DIGITS = "regexp_extract_all({x}, '(\\d+)', 1)"


def _codes_text(x: str) -> str:
    return f"array_to_string({DIGITS.format(x=x)}, ' ')"


def _sentence(kind: str, fields: list[tuple[str, str]]) -> str:
    parts = [f"'event type: {kind.replace('_', ' ')}; '"]
    for name, value in fields:
        parts += [f"'{name}: '", f"CAST({value} AS VARCHAR)", "'; '"]
    return "trim(" + " || ".join(parts) + ")"


TS = ("timestamp", "strftime(ts, '%Y-%m-%d %H:%M')")
_CART_FIELDS = [TS, ("item", "sku"), ("category", "category"), ("price", "price"), ("name", "name")]
_SRC = {"add_to_cart": "r_add", "remove_from_cart": "r_remove", "product_buy": "r_buy"}

_SENTENCES = " UNION ALL ".join(
    [f"""SELECT client_id, ts, {k} AS kind, {_sentence(kind, _CART_FIELDS)} AS text
         FROM (SELECT client_id, sku, max(ts) AS ts FROM {_SRC[kind]} GROUP BY client_id, sku) d
         LEFT JOIN pp USING (sku)""" for k, kind in enumerate(ct.EVENT_KINDS[:3])]
    + [f"""SELECT client_id, ts, 3, {_sentence('page_visit', [TS, ('url', 'url')])}
           FROM (SELECT client_id, url, max(ts) AS ts FROM r_visit GROUP BY client_id, url)""",
       f"""SELECT client_id, ts, 4, {_sentence('search_query', [TS, ('query', _codes_text('query'))])}
           FROM (SELECT client_id, query, max(ts) AS ts FROM r_search GROUP BY client_id, query)"""])

INTERACTIONS_SQL = with_bindings(
    ("pp", f"SELECT sku, category, price, {_codes_text('name')} AS name FROM product_properties"),
    ("sent", _SENTENCES),
    ("rk", "SELECT *, row_number() OVER (PARTITION BY client_id ORDER BY ts DESC, kind ASC, text ASC NULLS FIRST) AS rn FROM sent"),
    body=f"SELECT client_id, coalesce(string_agg(text, {NL} ORDER BY rn), '') AS text FROM rk WHERE rn <= 64 GROUP BY client_id")


@register("text_interactions", INTERACTIONS_SQL)
def text_interactions(spark, sf_dir):
    """L1: newest 64 distinct interactions of each relevant client as sentences."""
    return ct.interactions(load_fixture(spark, sf_dir), 64)


_W = ct.SEARCH_WIDTH
_cells = [f"coalesce(CAST(CAST(cs[{i + 1}] AS BIGINT) AS VARCHAR), '')" for i in range(_W)]
_names = [str(i) for i in range(_W)] + ["timestamp"]
_wcols = [f"w{i}" for i in range(_W)] + ["wts"]
SEARCHES_SQL = with_bindings(
    ("s0", f"SELECT client_id, ts, query, {DIGITS.format(x='query')} AS cs FROM r_search"),
    ("s1", "SELECT client_id, ts, query, " + ", ".join(f"{c} AS c{i}" for i, c in enumerate(_cells)) + " FROM s0"),
    ("rk", """SELECT *, row_number() OVER (PARTITION BY client_id ORDER BY ts, query) - 1 AS pos,
                  count(*) OVER (PARTITION BY client_id) AS n FROM s1"""),
    ("k0", "SELECT * FROM rk WHERE pos >= n - 90"),
    ("fine", """SELECT client_id, bool_or(epoch_us(ts) % 1000 <> 0) AS us, bool_or(epoch_us(ts) % 1000000 <> 0) AS ms,
                bool_or(epoch_us(ts) % 86400000000 <> 0) AS sec FROM k0 GROUP BY client_id"""),
    ("k", """SELECT k0.*, CASE WHEN us THEN strftime(ts, '%Y-%m-%d %H:%M:%S.%f') WHEN ms THEN strftime(ts, '%Y-%m-%d %H:%M:%S.%g')
             WHEN sec THEN strftime(ts, '%Y-%m-%d %H:%M:%S') ELSE strftime(ts, '%Y-%m-%d') END AS cts
             FROM k0 JOIN fine USING (client_id)"""),
    ("w", "SELECT client_id, " + ", ".join(
        [f"CAST(greatest(max(length(c{i})), {len(str(i))}) AS INTEGER) AS w{i}" for i in range(_W)]
        + ["CAST(greatest(max(length(cts)), 9) AS INTEGER) AS wts"])
        + " FROM k GROUP BY client_id"),
    ("lines", "SELECT k.client_id, k.pos, " + " || ' ' || ".join(
        [f"lpad(c{i}, w{i}, ' ')" for i in range(_W)] + ["lpad(cts, wts, ' ')"]) + " AS line FROM k JOIN w USING (client_id)"),
    body="SELECT w.client_id, " + " || ' ' || ".join(f"lpad('{n}', {c}, ' ')" for n, c in zip(_names, _wcols))
         + f" || {NL} || string_agg(line, {NL} ORDER BY pos) AS text FROM lines JOIN w USING (client_id) GROUP BY w.client_id, "
         + ", ".join(_wcols))


@register("text_searches", SEARCHES_SQL)
def text_searches(spark, sf_dir):
    """L2 + X6: newest 90 searches of each relevant client as a right-aligned table."""
    return ct.searches(load_fixture(spark, sf_dir), 90)


@register("parse_codes", with_bindings(body=f"""
    SELECT sku, {_codes_text('name')} AS codes, regexp_full_match(name, '\\[[0-9 ]*\\]') AS valid
    FROM product_properties"""))
def parse_codes(spark, sf_dir):
    """X1 + X3: product name codes as text, with the strict form check."""
    return ct.product_codes(load_fixture(spark, sf_dir).product_properties)
