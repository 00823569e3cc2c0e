"""Sources and sinks: written, read back and compared with the tables they came from."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from ..operators import client_text as ct
from ..operators import vocab
from ..session import drop_tables, scratch_dir, tables
from ..sources import sinks
from ..sources.inputs import SCHEMAS, load_fixture, load_inputs, relevant_only
from .q_text import INTERACTIONS_SQL
from .registry import register
from .sqlkit import with_bindings

#: Whether a layout has its event tables beside the products (S3).
LAYOUTS = {"submit": True, "local": False}


def _key(name: str) -> str:
    return "sku" if name == "product_properties" else "client_id"


@register("inputs_loaded", with_bindings(body=" UNION ALL ".join(
    f"SELECT '{layout}' AS layout, '{name}' AS input, count(*) AS rows, CAST(sum({_key(name)}) AS BIGINT) AS key_sum FROM {name}"
    for layout in LAYOUTS for name in SCHEMAS)))
def inputs_loaded(spark, sf_dir):
    """The seven inputs laid out as files in both layouts and loaded with their schemas: rows and key sums."""
    fixture = load_fixture(spark, sf_dir)
    counts = []
    for layout, submit in LAYOUTS.items():
        base = scratch_dir(spark, "inputs")
        for name in SCHEMAS:
            inside = name == "relevant_clients" or not (submit or name == "product_properties")
            getattr(fixture, name).write.parquet(f"{base}/input/{name}.parquet" if inside else f"{base}/{name}.parquet")
        loaded = load_inputs(spark, base, submit)
        counts += [getattr(loaded, name).agg(F.count(F.lit(1)).alias("rows"), F.sum(_key(name)).alias("key_sum")).select(
            F.lit(layout).alias("layout"), F.lit(name).alias("input"), "rows", "key_sum") for name in SCHEMAS]
    return reduce(lambda a, b: a.unionByName(b), counts)


@register("texts_stored", f"WITH tx AS ({INTERACTIONS_SQL}) SELECT client_id, length(text) AS chars, TRUE AS same FROM tx")
def texts_stored(spark, sf_dir):
    """The clients' interaction texts as JSON lines and as parquet, read back from both and compared. Both are
    compressed, and the events go once the texts are written."""
    base, before = scratch_dir(spark, "texts"), set(tables(spark))
    texts = ct.interactions(load_fixture(spark, sf_dir), 64)
    columnar = sinks.read_texts(spark, sinks.write_texts(texts, f"{base}/texts", compression="zstd"))
    drop_tables(spark, [t for t in tables(spark) if t not in before and t != base])
    lines = sinks.read_texts(spark, sinks.write_texts(columnar, f"{base}/texts.jsonl", fmt="json", compression="gzip"))
    return columnar.join(lines.withColumnRenamed("text", "line"), "client_id", "full").select(
        "client_id", F.length("text").cast("long").alias("chars"), F.col("text").eqNullSafe(F.col("line")).alias("same"))


@register("codes_round_trip", with_bindings(
    ("u", "SELECT url, count(*) AS n FROM r_visit GROUP BY url"),
    body="SELECT url, CAST(row_number() OVER (ORDER BY url) AS BIGINT) AS code, n FROM u"))
def codes_round_trip(spark, sf_dir):
    """Every visit's url encoded and decoded again, counted by both."""
    inputs = load_fixture(spark, sf_dir)
    visits = relevant_only(inputs.page_visit, inputs.relevant_clients).select("url")
    codes = vocab.dense_codes(visits, "url", start=1)
    coded = vocab.encode(visits, codes, "url", "code", "_c").withColumn("code", F.col("_c"))
    return vocab.decode(coded, codes, "url", "code", "_c").groupBy("url", "code").agg(F.count(F.lit(1)).alias("n"))
