"""Query registry: name → (Spark builder, DuckDB oracle SQL or None).

Spark builders take ``(spark, sf_dir)`` and return a lazy DataFrame. Every
double column of a registered result is rounded to 6 places (the oracle SQL
does the same) so that results compare by value hash.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ship_package

Builder = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Entry:
    name: str
    build: Builder
    sql: str | None


_ENTRIES: dict[str, Entry] = {}


def round_doubles(df: DataFrame, places: int = 6) -> DataFrame:
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            cols.append(F.round(F.col(f.name).cast("double"), places).alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(cols)


def register(name: str, sql: str | None = None):
    def deco(fn: Builder) -> Builder:
        if name in _ENTRIES:
            raise ValueError(f"query {name!r} registered twice")

        def build(spark: SparkSession, sf_dir: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            ship_package(spark)
            return round_doubles(fn(spark, sf_dir))

        build.__name__ = fn.__name__
        build.__doc__ = fn.__doc__
        _ENTRIES[name] = Entry(name, build, sql)
        return fn
    return deco


def entries() -> dict[str, Entry]:
    from . import catalog  # noqa: F401  (registers every query)
    return dict(_ENTRIES)
