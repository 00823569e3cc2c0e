"""DuckDB-side bindings shared by every oracle query (FIXTURES.md §2).

The oracle is an independent statement of each query in SQL; it runs in the
driver's DuckDB on the same parquet tables.
"""

from __future__ import annotations

BINDINGS = {
    "relevant_clients": "SELECT c_custkey AS client_id FROM customer WHERE c_mktsegment <> 'HOUSEHOLD'",
    "product_properties": """SELECT p_partkey AS sku,
        CAST(regexp_extract(p_brand, '([0-9]+)', 1) AS INT) AS category,
        CAST(floor(p_retailprice - 900) AS INT) AS price,
        '[' || array_to_string(list_transform(range(16), lambda i: (p_partkey * (i + 7) + i * i) % 256), ' ') || ']' AS name
        FROM part""",
    "_lo": """SELECT o.o_custkey, o.o_orderdate, l.l_shipdate, l.l_partkey, l.l_returnflag, l.l_linestatus
        FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey""",
    "product_buy": "SELECT o_custkey AS client_id, l_shipdate AS ts, l_partkey AS sku FROM _lo WHERE l_returnflag = 'N'",
    "add_to_cart": "SELECT o_custkey AS client_id, o_orderdate AS ts, l_partkey AS sku FROM _lo WHERE l_linestatus = 'O'",
    "remove_from_cart": "SELECT o_custkey AS client_id, l_shipdate AS ts, l_partkey AS sku FROM _lo WHERE l_returnflag = 'R'",
    "page_visit": """SELECT user_id AS client_id, ts, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS url
        FROM events WHERE event_type IN ('view', 'click')""",
    "search_query": """SELECT user_id AS client_id, ts,
        '[' || array_to_string(list_transform(range(16), lambda i: (event_id * (i + 3) + i) % 256), ' ') || ']' AS query
        FROM events WHERE event_type = 'signup'""",
    # relevant-client restrictions (F1)
    "r_buy": "SELECT * FROM product_buy WHERE client_id IN (SELECT client_id FROM relevant_clients)",
    "r_add": "SELECT * FROM add_to_cart WHERE client_id IN (SELECT client_id FROM relevant_clients)",
    "r_remove": "SELECT * FROM remove_from_cart WHERE client_id IN (SELECT client_id FROM relevant_clients)",
    "r_visit": "SELECT * FROM page_visit WHERE client_id IN (SELECT client_id FROM relevant_clients)",
    "r_search": "SELECT * FROM search_query WHERE client_id IN (SELECT client_id FROM relevant_clients)",
}


def with_bindings(*ctes: tuple[str, str], body: str) -> str:
    """``WITH <bindings>, <ctes> <body>`` — unused CTEs cost nothing in DuckDB."""
    parts = [f"{name} AS ({sql})" for name, sql in BINDINGS.items()]
    parts += [f"{name} AS ({sql})" for name, sql in ctes]
    return "WITH " + ",\n".join(parts) + "\n" + body


def r6(expr: str) -> str:
    """Round a double to 6 places; ``+ 0.0`` folds -0.0 into 0.0 like Spark's decimal rounding."""
    return f"(round(CAST({expr} AS DOUBLE), 6) + 0.0)"
