"""The corpus pipeline: documents in, packed training sequences out.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; all but
the last return the columns of ``docs``, whatever their names: the operators
see ids and texts, the other columns stand aside under names that no operator
uses, and come back as they were. A driver may write each result and
read it again as the next stage's ``docs``; ``run`` does so itself, in the
shared checkpoint folder.

Null texts count as empty (and stay null), null ids take part; repeated rows
are near duplicates of each other; texts are processed whole, however long;
among equals the smallest id stays. An empty table stays empty through every
stage. ``n_chars``, where there is such a column, follows the text.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shoplens.llm import packing, quality_rules, secret_scan, simhash, substring_dedup
from shoplens.llm.ship import ship
from shoplens.session import cut_lineage, drop_tables, tables

#: No SQL: the rules and formats are learned and the fingerprints are hashes of shingles (tests compare with brute force).
ORACLE_SQL = None


#: The columns that operators read, by the names they have in every table.
READ = ("doc_id", "text")


def _set_aside(docs: DataFrame) -> DataFrame:
    """``docs`` with all columns but those that operators read under names that none of them writes."""
    return docs.select([F.col(f"`{c}`").alias(c if c in READ else f"__kept_{i}") for i, c in enumerate(docs.columns)])


def _brought_back(rows: DataFrame, docs: DataFrame, recount: bool = False) -> DataFrame:
    """The columns of ``docs`` from the rows that an operator kept, with ``n_chars`` (if any) again the length of the
    text on demand."""
    def column(i: int, c: str) -> Column:
        if recount and c == "n_chars":
            return F.length("text").cast(docs.schema[c].dataType)
        return F.col(c if c in READ else f"__kept_{i}")

    return rows.select([column(i, c).alias(c) for i, c in enumerate(docs.columns)])


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rule and the learned decision list."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return _brought_back(quality_rules.judge(_set_aside(docs), labels, payload=True).where("kept"), docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (3-word shingles, 3 bits): the one of smallest id."""
    ship(spark)
    return _brought_back(simhash.keep_first(_set_aside(docs), shingle=3, distance=3), docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages that an earlier document (or place) has."""
    ship(spark)
    return _brought_back(substring_dedup.remove(_set_aside(docs)), docs, recount=True)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with the values of secrets replaced."""
    ship(spark)
    return _brought_back(secret_scan.redact(_set_aside(docs)), docs, recount=True)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 1,024 tokens with their sequence and place, and their ids (unsigned 32-bit, little-endian)."""
    ship(spark)
    rows = packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN,
                                  end_id=2, with_ids=True)
    return rows.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "ids")


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: Intermediate tables of the stage that ran last, by application.
_LEFT: dict[str, list[str]] = {}


def _tidy(stage: Stage) -> Stage:
    """The stage, which first drops the intermediate tables of the stage before it, unless ``docs`` still reads them
    (its result has been written by then)."""
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        app = spark.sparkContext.applicationId
        left = _LEFT.pop(app, [])
        if left:
            files = docs.inputFiles()
            drop_tables(spark, [t for t in left if not any(t.split("/")[-1] in f for f in files)])
        before = set(tables(spark))
        result = stage(spark, docs, sf_dir)
        _LEFT[app] = [t for t in tables(spark) if t not in before]
        return result

    run_stage.__name__, run_stage.__doc__ = stage.__name__, stage.__doc__
    return run_stage


STAGES: list[tuple[str, Stage]] = [
    ("quality rules", _tidy(quality)),
    ("SimHash near-dedup", _tidy(near_duplicates)),
    ("substring dedup", _tidy(repeated_passages)),
    ("secret scans", _tidy(secrets)),
    ("best-fit packing", _tidy(packed)),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the ``documents`` of ``sf_dir``; each stage's result is written once, and dropped when the next
    one's is."""
    docs, table = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for at, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if at + 1 < len(STAGES):
            before, docs = table, cut_lineage(docs)
            table = tables(spark)[-1]
            if before is not None:
                drop_tables(spark, [before])
    return docs
