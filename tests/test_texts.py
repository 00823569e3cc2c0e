"""Printed timestamps and the checkpoint folder's rules."""

import os

import pytest
from pyspark.sql import functions as F

from shoplens import session
from shoplens.operators import sequences as sq
from shoplens.operators.client_text import stamp_length
from shoplens.operators.ordering import positions
from shoplens.sources.inputs import SCHEMAS, Inputs


@pytest.mark.parametrize("stamps, printed", [
    (["2024-01-01 00:00:00.123456", "2024-01-02 00:00:00"], ["2024-01-01 00:00:00.123456", "2024-01-02 00:00:00.000000"]),
    (["2024-01-01 00:00:00.120", "2024-01-02 00:00:00"], ["2024-01-01 00:00:00.120", "2024-01-02 00:00:00.000"]),
    (["2024-01-01 10:00:00", "2024-01-02 00:00:00"], ["2024-01-01 10:00:00", "2024-01-02 00:00:00"]),
    (["2024-01-01 00:00:00", "2024-01-02 00:00:00"], ["2024-01-01", "2024-01-02"])])
def test_precision_of_the_finest_row(spark, stamps, printed):
    rows = spark.createDataFrame([(s,) for s in stamps], "s string").select(F.col("s").cast("timestamp_ntz").alias("t"))
    finest = F.date_format("t", "yyyy-MM-dd HH:mm:ss.SSSSSS")
    got = rows.crossJoin(rows.agg(stamp_length(F.col("t")).alias("n"))).select(F.substring(finest, F.lit(1), F.col("n")).alias("x"))
    assert sorted(r["x"] for r in got.collect()) == printed


def test_scratch_folder_is_for_local_masters_only():
    for master in ("local", "local[4]", "local[*]"):
        session.check_scratch_allowed(master)
    for master in ("local-cluster[2,1,1024]", "yarn", "spark://host:7077", "k8s://x"):
        with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
            session.check_scratch_allowed(master)


def test_tables_belong_to_the_application(spark):
    df = session.cut_lineage(spark.range(5).withColumn("s", F.lit("x")))
    path = session._tables_dir(spark)
    local = path.removeprefix("file:")
    assert df.count() == 5 and os.listdir(local)
    assert df.schema.simpleString() == "struct<id:bigint,s:string>"


def test_rows_that_stand_for_several_places(spark):
    rows = [(1, 0, 3), (1, 1, 2), (1, 2, 1), (2, 5, 4), (2, 6, 1)]
    df = spark.createDataFrame(rows, "k long, t long, n long")
    for bucket in ("0", "t", "t div 2"):
        got = positions(df, "k", ["t"], rev="r", length="l", bucket=F.expr(bucket), size="n").orderBy("k", "t").collect()
        assert [(r["pos"], r["l"]) for r in got] == [(0, 6), (3, 6), (5, 6), (0, 5), (4, 5)]


def test_sku_texts_sort_skus_not_codes(spark, monkeypatch):
    at = "timestamp_ntz'2024-01-0{} 00:00:00'".format
    tables = {name: spark.createDataFrame([], schema) for name, schema in SCHEMAS.items()}
    tables["product_properties"] = spark.sql(                # sku 2 comes twice, sku 3 has no codes, one has no sku
        "SELECT * FROM VALUES (1L, 0, 0, '[5 6 7]'), (2L, 0, 0, '[8 9]'), (2L, 0, 0, '[8 9]'), (3L, 0, 0, '[]'), (NULL, 0, 0, '[1]') t(sku, category, price, name)")
    tables["product_buy"] = spark.sql(
        f"SELECT * FROM VALUES (1L, {at(2)}, 1L), (1L, {at(1)}, 2L), (1L, {at(3)}, 3L), (1L, {at(4)}, 2L), (2L, {at(1)}, 1L) t(client_id, timestamp, sku)")
    sorted_rows = []
    monkeypatch.setattr(sq, "positions", lambda df, *a, **k: sorted_rows.append(df.count()) or positions(df, *a, **k))
    got = sq.sku_text(Inputs(**tables)).orderBy("client_id", "pos").collect()
    assert [tuple(r) for r in got] == [(1, i, c + 3) for i, c in enumerate([8, 8, 9, 9, 5, 6, 7])] + [(2, i, c + 3) for i, c in enumerate([5, 6, 7])]
    assert sorted_rows == [3]


@pytest.mark.parametrize("size", [None, "n"])
def test_positions_read_their_input_once_and_agree_for_long_histories(spark, size):
    rows = [(k, t * 1800, t % 3 + 1) for k, n in ((1, 40), (2, 3), (3, 1)) for t in range(n)] + [(None, 5, 1), (2, None, 1)]
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    df = spark.createDataFrame(rows, "k long, t long, n int").mapInArrow(counted, "k long, t long, n int") \
        .withColumn("t", F.timestamp_seconds("t"))
    made = [[tuple(r) for r in positions(df, "k", ["t"], rev="r", length="l", size=size, many=many).orderBy("k", "t").collect()]
            for many in (None, 2, 0)]
    assert read.value == 3 * len(rows)
    assert made[0] == made[1] == made[2] and len(made[0]) == len(rows) - 1
    plain = [tuple(r) for r in positions(df, "k", ["t"], rev="r", length="l", size=size, materialize=False).orderBy("k", "t").collect()]
    assert plain == made[0]


def test_texts_are_joined_in_partitions_that_rise_with_the_events(spark, sf_dir, monkeypatch):
    from shoplens.operators import client_text as ct
    from shoplens.sources.inputs import load_fixture
    inputs = load_fixture(spark, sf_dir)
    want = sorted(map(tuple, ct.interactions(inputs, 8).collect()))
    assert sorted(map(tuple, ct.interactions(inputs, 8, many=20).collect())) == want         # limited before they meet
    monkeypatch.setattr(ct, "EVENTS_A_TASK", 100)
    wide = ct.interactions(inputs, 8)
    n = ct.latest_events(inputs).count()
    plan = wide._jdf.queryExecution().executedPlan().toString()
    assert f", {-(-n // 100)}), REPARTITION_BY_NUM" in plan
    assert sorted(map(tuple, wide.collect())) == want
