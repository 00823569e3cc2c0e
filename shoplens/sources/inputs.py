"""The seven inputs of the pipelines, as lazy DataFrames.

``load_inputs`` reads files laid out like the original data set
(``<base>/product_buy.parquet`` ... with ``relevant_clients.parquet``);
``load_fixture`` derives the same seven tables from the driver's
TPC-H-style test tables (bindings documented in FIXTURES.md §2).

Timestamps are naive (``TIMESTAMP_NTZ``): calendar arithmetic never depends
on the session time zone.
"""

from __future__ import annotations

import os
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

EVENT_SCHEMA = T.StructType([
    T.StructField("client_id", T.LongType()),
    T.StructField("timestamp", T.TimestampNTZType()),
    T.StructField("sku", T.LongType()),
])
VISIT_SCHEMA = T.StructType([
    T.StructField("client_id", T.LongType()),
    T.StructField("timestamp", T.TimestampNTZType()),
    T.StructField("url", T.LongType()),
])
SEARCH_SCHEMA = T.StructType([
    T.StructField("client_id", T.LongType()),
    T.StructField("timestamp", T.TimestampNTZType()),
    T.StructField("query", T.StringType()),
])
PRODUCT_SCHEMA = T.StructType([
    T.StructField("sku", T.LongType()),
    T.StructField("category", T.IntegerType()),
    T.StructField("price", T.IntegerType()),
    T.StructField("name", T.StringType()),
])
CLIENT_SCHEMA = T.StructType([T.StructField("client_id", T.LongType())])

SCHEMAS = {
    "product_buy": EVENT_SCHEMA,
    "add_to_cart": EVENT_SCHEMA,
    "remove_from_cart": EVENT_SCHEMA,
    "page_visit": VISIT_SCHEMA,
    "search_query": SEARCH_SCHEMA,
    "product_properties": PRODUCT_SCHEMA,
    "relevant_clients": CLIENT_SCHEMA,
}


@dataclass(frozen=True)
class Inputs:
    """Unfiltered inputs; each operator applies the relevant-client filter itself."""

    relevant_clients: DataFrame
    product_properties: DataFrame
    product_buy: DataFrame
    add_to_cart: DataFrame
    remove_from_cart: DataFrame
    page_visit: DataFrame
    search_query: DataFrame

    def enriched(self, name: str) -> DataFrame:
        """Event table inner-joined to ``(sku, category, price)``: unknown skus drop."""
        props = self.product_properties.select("sku", "category", "price")
        return getattr(self, name).join(props, "sku", "inner")


def _conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Select and cast to the declared schema; a missing column is an error."""
    missing = [f.name for f in schema.fields if f.name not in df.columns]
    if missing:
        raise ValueError(f"input is missing columns {missing}; has {df.columns}")
    return df.select([F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields])


def data_root(base: str, submit: bool = True) -> str:
    """Event files live in ``base`` when submitting, in ``base/input`` otherwise (S3)."""
    return base if submit else os.path.join(base, "input")


def load_inputs(spark: SparkSession, base: str, submit: bool = True) -> Inputs:
    """Read the seven inputs with their declared schemas."""
    root = data_root(base, submit)
    tables = {}
    for name, schema in SCHEMAS.items():
        folder = base if name in ("product_properties", "relevant_clients") else root
        if name == "relevant_clients":
            folder = os.path.join(base, "input")
        df = spark.read.parquet(os.path.join(folder, f"{name}.parquet"))
        tables[name] = _conform(df, schema)
    return Inputs(**tables)


def relevant_only(df: DataFrame, relevant: DataFrame) -> DataFrame:
    """Keep rows of relevant clients (a semi join, never a collect)."""
    return df.join(relevant.select("client_id"), "client_id", "left_semi")


# ---- fixture bindings over the driver tables --------------------------------------

def code_vector(key: Column, mult_offset: int, add_square: bool) -> Column:
    """Sixteen deterministic codes derived from an id, printed like ``[11 2 3]``."""
    def code(i: Column) -> Column:
        extra = i * i if add_square else i
        return ((key * (i + mult_offset) + extra) % 256).cast("string")
    body = F.transform(F.sequence(F.lit(0), F.lit(15)), code)
    return F.concat(F.lit("["), F.array_join(body, " "), F.lit("]"))


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def load_fixture(spark: SparkSession, sf_dir: str) -> Inputs:
    """The seven inputs bound to the driver's tables (FIXTURES.md §2)."""
    customer = _table(spark, sf_dir, "customer")
    part = _table(spark, sf_dir, "part")
    lineitem = _table(spark, sf_dir, "lineitem")
    orders = _table(spark, sf_dir, "orders")
    events = _table(spark, sf_dir, "events")

    relevant = customer.where(F.col("c_mktsegment") != "HOUSEHOLD").select(
        F.col("c_custkey").cast("long").alias("client_id"))
    products = part.select(
        F.col("p_partkey").cast("long").alias("sku"),
        F.regexp_extract("p_brand", "([0-9]+)", 1).cast("int").alias("category"),
        F.floor(F.col("p_retailprice") - 900).cast("int").alias("price"),
        code_vector(F.col("p_partkey"), 7, True).alias("name"),
    )
    li = lineitem.select("l_orderkey", "l_partkey", "l_returnflag", "l_linestatus", "l_shipdate")
    od = orders.select("o_orderkey", "o_custkey", "o_orderdate")
    lo = li.join(od, li.l_orderkey == od.o_orderkey, "inner")

    def cart(flag_col: str, flag: str, ts_col: str) -> DataFrame:
        return lo.where(F.col(flag_col) == flag).select(
            F.col("o_custkey").cast("long").alias("client_id"),
            F.col(ts_col).cast("timestamp_ntz").alias("timestamp"),
            F.col("l_partkey").cast("long").alias("sku"))

    visits = events.where(F.col("event_type").isin("view", "click")).select(
        F.col("user_id").cast("long").alias("client_id"),
        F.col("ts").cast("timestamp_ntz").alias("timestamp"),
        F.regexp_extract("props", "([0-9]+)", 1).cast("long").alias("url"))
    searches = events.where(F.col("event_type") == "signup").select(
        F.col("user_id").cast("long").alias("client_id"),
        F.col("ts").cast("timestamp_ntz").alias("timestamp"),
        code_vector(F.col("event_id"), 3, False).alias("query"))
    return Inputs(
        relevant_clients=relevant,
        product_properties=products,
        product_buy=cart("l_returnflag", "N", "l_shipdate"),
        add_to_cart=cart("l_linestatus", "O", "o_orderdate"),
        remove_from_cart=cart("l_returnflag", "R", "l_shipdate"),
        page_visit=visits,
        search_query=searches,
    )
