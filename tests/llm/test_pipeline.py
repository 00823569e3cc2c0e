"""The pipeline's stages against brute force on a small folder of tables, and its registration."""

import zlib

import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry

from .conftest import DOC_SCHEMA, prose
from .test_quality_rules import brute as counts
from .test_secret_scan import brute as secrets
from .test_simhash import brute_components, brute_fingerprint
from .test_substring_dedup import brute as repeats
from .test_substring_dedup import cut


@pytest.fixture(scope="module")
def folder(llm_spark, messy, few_labels, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("sf"))
    passage = prose(77, 60).replace("\n", " ")
    rows = [(100 + i, prose(600 + i, 80) + "\n" + (passage if i < 8 else "") + f" token = '{i:018x}'", "en", "a", 1)
            for i in range(30)]
    messy.unionByName(llm_spark.createDataFrame(rows, DOC_SCHEMA)).coalesce(2).write.parquet(f"{path}/documents.parquet")
    few_labels.write.parquet(f"{path}/labels.parquet")
    return path


def test_each_stage_on_its_own_input(llm_spark, folder, tmp_path):
    docs = llm_spark.read.parquet(f"{folder}/documents.parquet")
    columns, key = docs.columns, lambda x: tuple(map(str, x))
    for at, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs.collect()
        stage(llm_spark, docs, folder).write.parquet(f"{tmp_path}/{at}")
        docs = llm_spark.read.parquet(f"{tmp_path}/{at}")
        after = docs.collect()
        if at < 4:
            assert docs.columns == columns
        if name == "quality rules":
            good = [r for r in before if counts(r["text"])[0] >= 20 and 100 * counts(r["text"])[4] <= 30 * counts(r["text"])[0]]
            assert sorted(map(tuple, after), key=key) == sorted(map(tuple, good), key=key)
        elif name == "SimHash near-dedup":
            prints = [brute_fingerprint(r["text"]) for r in before]
            groups = brute_components(list(range(len(before))), prints)
            assert len(after) == len(set(groups))
            assert {tuple(r) for r in after} <= {tuple(r) for r in before}
        elif name == "substring dedup":
            want = repeats(before, 25)
            texts = sorted(cut(r["text"], want.get((r["doc_id"], r["text"]), [])) for r in before)
            assert sorted(r["text"] for r in after) == texts
            assert all(r["n_chars"] == len(r["text"]) for r in after)
            assert sum(len(r["text"]) for r in after) < sum(len(r["text"]) for r in before)
        elif name == "secret scans":
            assert len(after) == len(before) and not [r for r in after if secrets(r["text"])]
            assert [r for r in before if secrets(r["text"])]
        else:
            by_doc = {}
            for r in sorted(after, key=lambda r: r["start"]):
                by_doc.setdefault(r["doc_id"], []).append(r)
            assert set(by_doc) == {r["doc_id"] for r in before}
            for parts in by_doc.values():
                ids = np.frombuffer(b"".join(bytes(p["ids"]) for p in parts), "<u4")
                assert ids[-1] == 2 and all(zlib.crc32(bytes(p["ids"])) == p["ids_crc32"] for p in parts)
    assert len(corpus_pipeline.STAGES) == 5


def test_stages_keep_every_column(llm_spark, folder, tmp_path):
    """Extra columns named like everything that the operators write keep their values and types."""
    names = ["fp", "__row", "found", "spans", "score", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
             "base_failed", "kept", "verdict", "ids", "piece", "start", "length", "sequence_id", "offset", "component_id",
             "__id", "__mark", "__text", "Spans2", "end", "digest", "anchor", "a.b"]
    docs = llm_spark.read.parquet(f"{folder}/documents.parquet")
    for i, n in enumerate(names):
        value = F.array(F.col("doc_id")) if i % 3 == 0 else F.concat_ws("/", "doc_id", F.lit(n)) if i % 3 == 1 else F.col("doc_id") * 1.5
        docs = docs.withColumn(n, value)
    docs.write.parquet(f"{tmp_path}/in")
    docs = llm_spark.read.parquet(f"{tmp_path}/in")
    schema, kept = docs.schema, [f"`{c}`" for c in docs.columns if c not in ("text", "n_chars")]
    key = lambda r: tuple(map(str, r))
    for at, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(llm_spark, docs, folder).write.parquet(f"{tmp_path}/{at}")
        after = llm_spark.read.parquet(f"{tmp_path}/{at}")
        if at < 4:
            assert [(f.name, f.dataType) for f in after.schema] == [(f.name, f.dataType) for f in schema]
            assert {key(r) for r in after.select(kept).collect()} <= {key(r) for r in docs.select(kept).collect()}
            assert after.count() > 20
        else:
            assert after.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "ids"]
        docs = after


def test_stages_keep_an_empty_table(llm_spark, folder, no_docs):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(llm_spark, no_docs, folder).count() == 0


def test_last_stage_fills_gaps_by_pairs(llm_spark, tmp_path):
    """700 + 200 + 124 tokens make one sequence: a pair closes the gap, whatever the size of its pieces."""
    want = {1: 700, 2: 200, 3: 124, 4: 300}
    docs = llm_spark.createDataFrame([(i, "x " * (n - 2), "en", "a", 1) for i, n in want.items()], DOC_SCHEMA)
    rows = {r["doc_id"]: r for r in corpus_pipeline.packed(llm_spark, docs, str(tmp_path)).collect()}
    assert {i: r["length"] for i, r in rows.items()} == want
    assert len({rows[i]["sequence_id"] for i in (1, 2, 3)}) == 1 and rows[4]["sequence_id"] != rows[1]["sequence_id"]


def test_run_equals_the_stages(llm_spark, folder):
    rows = corpus_pipeline.run(llm_spark, folder).collect()
    assert rows and sum(r["length"] for r in rows) > 1000
    assert len({(r["sequence_id"], r["offset"]) for r in rows}) == len(rows)


def test_registration():
    names = set(entry.queries())
    assert "pipeline" in names
    for n in range(1, 14):
        assert len([x for x in names if x.startswith(f"op{n}_")]) == 1
    assert set(entry.oracle_sql()) <= names


def test_warc_oracle(llm_spark, duck, sf_dir):
    got = entry.queries()["op9_warc"](llm_spark, sf_dir).toPandas().sort_values("page_id")
    want = duck.execute(entry.oracle_sql()["op9_warc"]).df()[list(got.columns)].sort_values("page_id")
    assert got.astype(str).replace("nan", "<NA>").values.tolist() == want.astype(str).replace("nan", "<NA>").values.tolist()
