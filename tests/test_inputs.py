"""The seven inputs read from a folder, in both layouts, and the codes' round trip."""

import pytest
from pyspark.sql import functions as F

from shoplens.operators import vocab
from shoplens.sources import inputs as src


@pytest.mark.parametrize("submit", [True, False])
def test_load_inputs(spark, sf_dir, tmp_path, submit):
    fixture = src.load_fixture(spark, sf_dir)
    root = str(tmp_path)
    for name in src.SCHEMAS:
        inside = name == "relevant_clients" or not (submit or name == "product_properties")
        getattr(fixture, name).write.parquet(f"{root}/input/{name}.parquet" if inside else f"{root}/{name}.parquet")
    loaded = src.load_inputs(spark, root, submit)
    for name, schema in src.SCHEMAS.items():
        got = getattr(loaded, name)
        assert [f.name for f in got.schema.fields] == [f.name for f in schema.fields]
        assert got.count() == getattr(fixture, name).count()
    assert src.data_root(root, submit) == (root if submit else f"{root}/input")


def test_missing_column_is_an_error(spark, tmp_path):
    with pytest.raises(ValueError, match="missing columns"):
        src._conform(spark.range(1), src.SCHEMAS["product_buy"])


def test_codes_round_trip(spark):
    df = spark.createDataFrame([("b", 1), ("a", 2), ("b", 3), (None, 4)], "v string, n long")
    codes = vocab.dense_codes(df, "v", start=1)
    coded = vocab.encode(df, codes, "v", "code", "c")
    assert sorted((r.c, r.n) for r in coded.collect()) == [(1, 2), (2, 1), (2, 3)]
    back = vocab.decode(coded, codes, "v", "code", "c")
    assert sorted((r.v, r.n) for r in back.collect()) == [("a", 2), ("b", 1), ("b", 3)]
    assert vocab.encode(df, codes, "v", "code").where(F.col("v") == 1).count() == 1
