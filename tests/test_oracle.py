"""Every registered query with an oracle matches DuckDB at sf0.001 (rows, columns, values)."""

import pytest

from shoplens.plans.registry import entries

SQL_NAMES = sorted(n for n, e in entries().items() if e.sql is not None)


@pytest.mark.parametrize("name", SQL_NAMES)
def test_matches_duckdb(spark, duck, sf_dir, name):
    from check_oracle import compare
    status, ns, nd, _, msg = compare(spark, duck, name, entries()[name], sf_dir)
    assert status == "OK", f"{name}: {status} spark={ns} duckdb={nd} {msg}"


def test_every_query_is_registered_once():
    names = list(entries())
    assert len(names) == len(set(names))
    assert len(SQL_NAMES) >= 40
