"""Plan shapes that the scale design relies on (checked on the physical plan, sf0.001)."""

from shoplens.operators import sequences as sq
from shoplens.plans.registry import entries
from shoplens.sources.inputs import load_fixture


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_newest_texts_use_partial_top_n(spark, sf_dir):
    plan = _plan(entries()["text_interactions"].build(spark, sf_dir))
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_capped_codes_do_not_shuffle_events_by_item(spark, sf_dir):
    plan = _plan(sq.full_events(load_fixture(spark, sf_dir)))
    assert "SortMergeJoin" not in plan
    assert "ShuffledHashJoin" not in plan


def test_flagship_scans_are_pruned_and_filtered(spark, sf_dir):
    from shoplens.operators.client_stats import event_cells
    plan = _plan(event_cells(load_fixture(spark, sf_dir)))            # what the flagship query reads and writes once
    scans = [line for line in plan.splitlines() if "FileScan parquet" in line and "lineitem.parquet" in line]
    assert scans
    for s in scans:
        schema = s[s.index("ReadSchema"):]
        assert "l_comment" not in schema and "l_extendedprice" not in schema
        assert "PushedFilters: [" in s and "PushedFilters: []" not in s


def test_last_n_views_limit_before_the_shuffle_and_write_nothing(spark, sf_dir):
    from shoplens.operators import sequences as sq
    from shoplens.sources.inputs import load_fixture
    plan = sq.encoder_view(sq.event_day(load_fixture(spark, sf_dir), last=126), ["event_type", "day"], 128) \
        ._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "/tables/" not in plan
    assert plan.index("WindowGroupLimit") < len(plan)


def test_sku_codes_are_not_broadcast(spark, sf_dir, monkeypatch):
    """Products are few bytes of parquet, the codes of all of them are not: the driver must not hold them."""
    plans = []
    monkeypatch.setattr(sq, "positions", lambda df, *a, **k: plans.append(_plan(df)) or df.withColumn("pos", df["sku"]))
    sq.sku_text(load_fixture(spark, sf_dir))
    join = next(line for line in plans[0].splitlines() if "Join" in line)         # the last join comes first
    assert "SortMergeJoin [sku" in join


def test_product_names_are_not_broadcast(spark, sf_dir):
    """Nor the texts of all products' names, when the events become sentences."""
    from shoplens.operators import client_text as ct
    inputs = load_fixture(spark, sf_dir)
    events = inputs.page_visit.selectExpr("client_id", "0 AS kind", "url AS sku", "url", "'' AS query", "timestamp")
    plan = _plan(ct.sentences(events, inputs.product_properties))
    assert "SortMergeJoin [sku" in plan and "BroadcastHashJoin" not in plan


def test_recommendations_are_not_broadcast_to_be_ranked(spark):
    """A user's recommendations are few bytes of parquet but many rows: the driver must not hold them all."""
    from shoplens.operators.rank_metrics import ranking
    recs = spark.range(400).selectExpr("id div 4 AS user_id", "id % 4 AS item_id", "id % 4 + 1 AS rank")
    labels = spark.range(100).selectExpr("id AS user_id", "id % 5 AS item_id")
    out = ranking(recs, labels, 4)
    assert "BroadcastHashJoin" not in _plan(out) and "SortMergeJoin" in _plan(out)
    row = out.first()
    assert (row["users"], row["hit_rate_1"], row["hit_rate_4"]) == (100, 0.2, 0.8)


def test_draws_are_the_same_number_in_both_engines(spark, duck):
    from shoplens.functions.draws import draw, draw_sql
    got = [r[0] for r in spark.range(50).select(draw("id", 7)).collect()]
    want = [r[0] for r in duck.execute(f"SELECT {draw_sql('id', 7)} FROM (SELECT unnest(range(50)) AS id)").fetchall()]
    assert sorted(got) == sorted(want) and len(set(got)) == 50


def test_a_long_tail_of_equal_counts_is_ranked_in_many_tasks(spark):
    from pyspark.sql import functions as F

    from shoplens.operators.ordering import group_ranks
    n = 1_000_000
    succ = spark.range(n).select(F.lit(7).alias("prev"), F.col("id").alias("next"), F.lit(1).alias("count")).unionByName(
        spark.createDataFrame([(8, 5, 3), (8, 4, 3), (8, 9, 4)], "prev int, next long, count int"))
    ranked = group_ranks(succ, "prev", [F.col("count").desc(), F.col("next").asc()])
    assert [tuple(r) for r in ranked.where("prev = 8").orderBy("rank").select("next", "rank").collect()] == [(9, 0), (4, 1), (5, 2)]
    own = ranked.where("prev = 7")
    assert own.agg(F.count("*"), F.max(F.abs(F.col("rank") - F.col("next")))).first()[:] == (n, 0)
    assert "windowspecdefinition(prev" not in _plan(ranked)         # the one window counts the ranges, not the rows
    parts = succ.repartitionByRange(F.col("prev"), F.col("count").desc(), F.col("next")).groupBy(F.spark_partition_id()).count()
    assert parts.agg(F.max("count")).first()[0] < n / 2            # the group lies in several ranges


def test_search_tables_take_widths_once_per_client(spark, sf_dir):
    plan = _plan(entries()["text_searches"].build(spark, sf_dir))
    assert "array_max" not in plan and "max(" in plan


def test_reduced_cells_are_aggregated_once(spark, sf_dir):
    """Day and item cells were aggregated again from all cells by each feature that reads them."""
    from shoplens.operators.client_stats import features_all
    from shoplens.session import tables
    before = len(tables(spark))
    plan = _plan(features_all(load_fixture(spark, sf_dir)))
    cells, *later = tables(spark)[before:]
    assert cells not in plan and cells.rsplit("/", 1)[1] not in plan
    assert len(later) == 3
