"""Registered queries of this subpackage: ``QUERIES`` (name → builder) and ``SQL`` (name → DuckDB statement)."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shoplens.session import scratch_dir

from . import (bpe, collocations, crf_langid, license_scan, multi_index, nbsvm, packing, quality_rules, secret_scan,
               simhash, spelling, substring_dedup, warc)
from .common import fold
from .ship import ship

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(fn):
    def build(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return fn(spark, sf_dir)

    build.__name__, build.__doc__ = fn.__name__, fn.__doc__
    QUERIES[fn.__name__] = build
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text encoded by a rank file and decoded again: token counts and digests."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.fingerprints(bpe.encode(
        docs, ranks, public_tokenizers.PATTERN, decoded=True, keep_text=False), "doc_id")


@query
def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page archived with its payload stored once, then read back from the archive."""
    path = warc.write(table(spark, sf_dir, "pages"), scratch_dir(spark, "warc"), "page_id", "url", "html")
    return warc.index(spark, path).select(F.col("record_id").alias("page_id"), "payload_bytes", "payload_digest",
                                          "record_type", "refers_to")


SQL["op9_warc"] = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
     g AS (SELECT *, sha1(body) AS hex, max(page_id) OVER (PARTITION BY body) AS last FROM p)
SELECT page_id, CAST(octet_length(body) AS BIGINT) AS payload_bytes,
       array_to_string(list_transform(range(32), lambda i:
         substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                CAST((CAST('0x' || substr(hex, 1 + 10 * (i // 8), 10) AS BIGINT) >> (35 - 5 * (i % 8))) & 31 AS BIGINT) + 1,
                1)), '') AS payload_digest,
       CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> last THEN last END AS refers_to
FROM g
"""


@query
def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics of every text, the base rule, and the verdict of the learned decision list."""
    judged = quality_rules.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judged.select("doc_id", *quality_rules.COUNTS, "base_failed", "kept", "verdict")


@query
def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate component of every document: 3-word shingles, 3 bits."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, distance=3)


@query
def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with repeated passages removed: their spans in the original text and what is left."""
    cleaned = substring_dedup.remove(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return cleaned.select("doc_id", F.size("spans").cast("long").alias("n_spans"),
                          F.expr("aggregate(spans, 0L, (a, s) -> a + s.end - s.start)").alias("removed_chars"),
                          F.expr("array_join(transform(spans, s -> concat(s.start, ':', s.end)), ',')").alias("spans"),
                          "text")


def _of_kind(spans, kind: int):
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


@query
def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document: counts and digest of the base spans, and all spans with the inferred formats."""
    scanned = secret_scan.scan_documents(table(spark, sf_dir, "documents"))
    spans = F.col("spans")
    counts = [_of_kind(spans, k).alias(f"n_{name}")
              for k, name in enumerate(secret_scan.KINDS[:3])]
    return scanned.select("doc_id", *counts, F.sha2(secret_scan.joined(spans, 3).cast("binary"), 256).alias("base_sha256"),
                          secret_scan.joined(spans, 4).alias("spans"))


@query
def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded, cut at 1,024 tokens and packed into sequences."""
    return packed(table(spark, sf_dir, "documents"))


def packed(docs: DataFrame) -> DataFrame:
    rows = packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN, end_id=2)
    return rows.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


@query
def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document by a model that never saw the held-out fold."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = nbsvm.learn(docs, table(spark, sf_dir, "labels"))
    return nbsvm.score(docs, model, keep_text=False).select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score",
                                           (F.col("score") >= 0.3).cast("int").alias("predicted"))


@query
def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document by a model that never saw the held-out fold."""
    docs = table(spark, sf_dir, "documents")
    model = crf_langid.learn(docs.select("doc_id", "text", "lang"))
    return crf_langid.predict(docs.select("doc_id", "text"), model, keep_text=False).select(
        "doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")


@query
def op10_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links at cosine 0.9 or more among all embeddings, and their components."""
    return multi_index.near_duplicates(table(spark, sf_dir, "embeddings"))


@query
def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 2,000 strongest phrases of 2 to 4 words of each language."""
    return collocations.top_phrases(table(spark, sf_dir, "documents").select("lang", "text"), least=30, first=2000)


SQL["op11_collocations"] = r"""
WITH piece AS (
       SELECT lang, row_number() OVER () AS piece, words FROM (
         SELECT lang, list_filter(string_split_regex(p, '[\x20\x09]+'), lambda w: w <> '') AS words FROM (
           SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''),
             'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p FROM documents))
       WHERE len(words) > 0),
     gram AS (
       SELECT lang, k, array_to_string(words[i:i + k - 1], ' ') AS phrase, count(*) AS f FROM (
         SELECT lang, words, k, unnest(range(1, len(words) - k + 2)) AS i FROM piece, (SELECT unnest(range(1, 5)) AS k))
       GROUP BY ALL),
     total AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM gram WHERE k = 1 GROUP BY lang),
     often AS (SELECT * FROM gram WHERE f >= 30),
     cand AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS words FROM often WHERE k > 1),
     cut AS (
       SELECT c.lang, c.phrase, c.a, j, x.f AS l, y.f AS r,
              (CAST(2000000 AS HUGEINT) * c.a) // (x.f + y.f) AS score
       FROM (SELECT *, unnest(range(1, k)) AS j FROM cand) c
       JOIN often x ON x.lang = c.lang AND x.phrase = array_to_string(c.words[1:j], ' ')
       JOIN often y ON y.lang = c.lang AND y.phrase = array_to_string(c.words[j + 1:], ' ')),
     weakest AS (SELECT lang, phrase, a, arg_min(struct_pack(l := l, r := r, score := score), (score, j)) AS m
                 FROM cut GROUP BY lang, phrase, a),
     inside AS (
       SELECT lang, array_to_string(words[i:i + s - 1], ' ') AS phrase, max(a) AS most FROM (
         SELECT *, unnest(range(1, k - s + 2)) AS i FROM cand, (SELECT unnest([2, 3]) AS s) WHERE s < k)
       GROUP BY ALL),
     ranked AS (
       SELECT w.lang, row_number() OVER (PARTITION BY w.lang ORDER BY m.score DESC, a DESC, encode(w.phrase)) AS rank,
              w.phrase, a, m.l AS l, m.r AS r, n, CAST(m.score AS BIGINT) AS score
       FROM weakest w JOIN total t ON t.lang = w.lang
       LEFT JOIN inside i ON i.lang = w.lang AND i.phrase = w.phrase
       WHERE most IS NULL OR CAST(100 AS HUGEINT) * most < CAST(80 AS HUGEINT) * a)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked WHERE rank <= 2000
"""


@query
def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word of the vocabulary with its more frequent form one edit away, and the last form of that chain."""
    docs = table(spark, sf_dir, "documents")
    words = spelling.vocabulary(docs, least_length=5, least_count=3, strike=97)
    return spelling.variants(words, ratio=2)


@query
def op13_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence phrases and covered licence texts of every document."""
    return license_scan.summary(license_scan.find(table(spark, sf_dir, "documents").select("doc_id", "text"),
                                                  keep_text=False))
