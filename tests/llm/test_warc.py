"""The archive against a brute-force grouping, and its records as WARC."""

import base64
import hashlib

import pytest

from shoplens.llm import warc

SCHEMA = "page_id long, url string, html string, record_id string, payload string, digest string"


def pages(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", "z") for r in rows], SCHEMA)


ROWS = [(1, "http://a", "same"), (2, "http://b", "same"), (3, None, "same"), (4, "http://c\r\nX: y", "other ñ中"),
        (5, "http://d", ""), (6, "http://e", None), (7, "u", "WARC/1.1\r\nWARC-Type: fake\r\n\r\nbody"),
        (8, "u", "x" * 200_000), (9, "u", "twice"), (9, "u", "twice"), (None, "u", "same"), (None, None, None)]


def expected(rows, least):
    last: dict[bytes, int] = {}
    for key, _, html in rows:
        body = (html or "").encode()
        if key is not None:
            last[body] = max(last.get(body, key), key)
    out = []
    for key, _, html in rows:
        body = (html or "").encode()
        revisit = len(body) >= least and key != last.get(body)
        out.append((key, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(),
                    "revisit" if revisit else "response", last[body] if revisit else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("least", [0, 5])
def test_index_reads_back_what_was_written(spark, tmp_path, least):
    path = warc.write(pages(spark, ROWS), str(tmp_path / "a"), "page_id", "url", "html", least)
    got = [tuple(r) for r in warc.index(spark, path).drop("uri").collect()]
    assert sorted(got, key=str) == expected(ROWS, least)
    assert spark.read.parquet(f"{path}/payloads").count() == len({r[2] or "" for r in ROWS})


def test_records_are_warc(spark, tmp_path):
    path = warc.write(pages(spark, ROWS), str(tmp_path / "b"), "page_id", "url", "html")
    want = {}
    for key, _, html in ROWS:
        want[key] = (html or "").encode() if key is not None else None
    for r in warc.records(spark, path).collect():
        head, _, body = bytes(r["record"]).partition(b"\r\n\r\n")
        lines = head.decode().split("\r\n")
        fields = dict(x.split(": ", 1) for x in lines[1:])
        assert lines[0] == "WARC/1.1" and body.endswith(b"\r\n\r\n")
        assert len(body) - 4 == int(fields["Content-Length"])
        if r["record_id"] is not None:
            assert bytes(r["payload"]) == want[r["record_id"]]
            if fields["WARC-Type"] == "response":
                assert body[:-4] == want[r["record_id"]]


def test_damage_is_noticed(spark, tmp_path):
    path = warc.write(pages(spark, ROWS[:2]), str(tmp_path / "c"), "page_id", "url", "html")
    spark.read.parquet(f"{path}/payloads").selectExpr("address", "cast('changed' as binary) as payload") \
        .write.parquet(f"{path}/d/payloads")
    spark.read.parquet(f"{path}/headers").write.parquet(f"{path}/d/headers")
    with pytest.raises(Exception, match="damaged payload"):
        warc.index(spark, f"{path}/d").collect()


@pytest.mark.parametrize("field, other", [("Content-Length: 4", "Content-Length: 5"), ("sha1:", "sha1:A")])
def test_a_header_of_another_payload_is_noticed(spark, tmp_path, field, other):
    from pyspark.sql import functions as F
    path = warc.write(pages(spark, ROWS[:2]), str(tmp_path / "h"), "page_id", "url", "html")
    spark.read.parquet(f"{path}/payloads").write.parquet(f"{path}/d/payloads")
    spark.read.parquet(f"{path}/headers").withColumn("header", F.replace("header", F.lit(field), F.lit(other))) \
        .write.parquet(f"{path}/d/headers")
    with pytest.raises(Exception, match="not its payload"):
        warc.index(spark, f"{path}/d").collect()


def test_columns_that_clash(spark, tmp_path):
    names = ["address", "header", "payload_bytes", "payload_digest", "record_type", "refers_to", "uri", "largest_id"]
    docs = pages(spark, ROWS)
    for n in names:
        docs = docs.selectExpr("*", f"'z' as {n}")
    path = warc.write(docs, str(tmp_path / "x"), "page_id", "url", "html")
    assert sorted((tuple(r) for r in warc.index(spark, path).drop("uri").collect()), key=str) == expected(ROWS, 0)


def test_empty_table(spark, tmp_path):
    path = warc.write(pages(spark, []), str(tmp_path / "e"), "page_id", "url", "html")
    assert warc.index(spark, path).count() == 0
