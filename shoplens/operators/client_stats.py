"""Per-client statistics of the event tables.

Shapes chosen for scale:

* the four event tables are reduced together to cells per client, item and
  day, written once; every feature of every table is an aggregate of those
  cells, with the table's tag among the keys;
* two constants per table (one row each) join as a broadcast;
* popularity never re-joins raw events: events are first reduced to
  ``(client, item, n)`` pairs (map-side combined), item totals are summed from
  the pairs, and the client mean is ``sum(n * total) / sum(n)``;
* the feature tables are merged by one union + ``groupBy(client_id)``
  instead of a chain of joins.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.dates import (
    calendar_windows,
    elapsed_micros,
    fractional_days,
    whole_days,
    year_month,
    year_week_sunday,
)
from ..session import cut_lineage
from ..sources.inputs import Inputs, relevant_only

#: The event-table prefixes and the output column order of the
#: 37 statistics, as the original feature table has them.
ALL_PREFIXES = ("buy", "add", "visit", "remove")
ACTION_PREFIXES = ("buy", "add", "remove")
ACTIVITY_COLUMNS = (
    "{p}_total_interactions",
    "mean_{p}_interval_days",
    "diff_{p}_week",
    "diff_{p}_month",
    "{p}_days_from_first_to_start",
    "{p}_days_from_last_to_start",
)


def feature_columns() -> list[str]:
    cols = [c.format(p=p) for p in ALL_PREFIXES for c in ACTIVITY_COLUMNS]
    for p in ACTION_PREFIXES:
        cols += [f"category_popularity_{p}", f"average_pop_{p}"]
    cols += ["average_pop_visit", "unique_weeks", "unique_months",
             "total_spent", "average_spent", "bought", "bought_cat"]
    return cols


def table_constants(events: DataFrame) -> DataFrame:
    """One row — first timestamp and last date of an event table."""
    return events.agg(F.min("timestamp").alias("_start"),
                      F.max(F.to_date("timestamp")).alias("_anchor"))


def daily(events: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """``(*by, client_id, _day, _c, _f, _l)``: events, first and last timestamp per client and day (map-side combined)."""
    return events.groupBy(*by, "client_id", F.to_date("timestamp").alias("_day")).agg(
        F.count(F.lit(1)).alias("_c"), F.min("timestamp").alias("_f"), F.max("timestamp").alias("_l"))


def _activity(cells: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """A1, A3, A8, A9 of day cells, per client (and table): the values of ``ACTIVITY_COLUMNS`` as ``_a0`` ... ``_a5``."""
    start, anchor = F.min("_f").alias("_start"), F.max("_day").alias("_anchor")
    if by:      # one row per event table
        ev = cells.join(F.broadcast(cells.groupBy(*by).agg(start, anchor)), list(by))
    else:
        ev = cells.crossJoin(F.broadcast(cells.agg(start, anchor)))
    day = F.col("_day")
    win = calendar_windows(F.col("_anchor"))

    def in_window(name: str) -> F.Column:
        lo, hi = win[name]
        return F.sum(F.when(day.between(lo, hi), F.col("_c")).otherwise(0))

    g = ev.groupBy(*by, "client_id").agg(
        F.sum("_c").alias("_n"),
        F.min("_f").alias("_first"),
        F.max("_l").alias("_last"),
        F.min("_start").alias("_start"),
        in_window("last_week").alias("_lw"),
        in_window("prev_week").alias("_pw"),
        in_window("last_month").alias("_lm"),
        in_window("prev_month").alias("_pm"),
    )
    mean_gap = F.when(F.col("_n") > 1,
                      fractional_days("_first", "_last") / (F.col("_n") - 1)).otherwise(F.lit(0.0))
    return g.select(
        *by, "client_id",
        F.col("_n").alias("_a0"),
        mean_gap.alias("_a1"),
        (F.col("_lw") - F.col("_pw")).alias("_a2"),
        (F.col("_lm") - F.col("_pm")).alias("_a3"),
        whole_days("_start", "_first").alias("_a4"),
        whole_days("_start", "_last").alias("_a5"),
    )


def activity(events: DataFrame, prefix: str) -> DataFrame:
    """A1, A3, A8, A9 in one scan: count, mean gap, week/month change, days to start.

    ``events``: ``(client_id, timestamp)``, already restricted to relevant clients
    (start date and anchor are taken over exactly these rows).
    """
    return _activity(daily(events)).withColumnsRenamed(
        {f"_a{i}": c.format(p=prefix) for i, c in enumerate(ACTIVITY_COLUMNS)})


def interaction_count(events: DataFrame, prefix: str) -> DataFrame:
    """A1 alone: events per client."""
    return events.groupBy("client_id").agg(F.count(F.lit(1)).alias(f"{prefix}_total_interactions"))


def mean_interval(events: DataFrame, prefix: str) -> DataFrame:
    """A8 alone, closed form ``(last - first) / (n - 1)`` in days; 0 for one event."""
    g = events.groupBy("client_id").agg(F.count(F.lit(1)).alias("_n"),
                                        F.min("timestamp").alias("_a"),
                                        F.max("timestamp").alias("_b"))
    return g.select("client_id", F.when(F.col("_n") > 1, fractional_days("_a", "_b") / (F.col("_n") - 1))
                    .otherwise(0.0).alias(f"mean_{prefix}_interval_days"))


def stability(visits: DataFrame) -> DataFrame:
    """A2: distinct Sunday-weeks and months per client.

    The sets are bounded by the calendar span, so a hot client stays cheap
    and the partial aggregate combines them map-side.
    """
    return visits.groupBy("client_id").agg(
        F.size(F.collect_set(year_week_sunday("timestamp"))).cast("long").alias("unique_weeks"),
        F.size(F.collect_set(year_month("timestamp"))).cast("long").alias("unique_months"),
    )


def _pairs(events: DataFrame, key: str) -> DataFrame:
    """``(client_id, key, _n)``: events reduced before any shuffle by item."""
    return events.groupBy("client_id", key).agg(F.count(F.lit(1)).alias("_n"))


def _mean_of_totals(pairs: DataFrame, key: str, out: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Mean over a client's events of the key's event total (null keys skipped), per event table if ``by`` names one."""
    totals = (pairs.where(F.col(key).isNotNull())
              .groupBy(*by, key).agg(F.sum("_n").alias("_total")))
    j = pairs.join(totals, [*by, key], "left")
    return j.groupBy(*by, "client_id").agg(
        (F.sum(F.col("_n") * F.col("_total"))
         / F.sum(F.when(F.col("_total").isNotNull(), F.col("_n")))).alias(out))


def item_popularity(events: DataFrame, item: str = "sku", prefix: str = "buy") -> DataFrame:
    """A4: mean popularity of the client's items, every event counting once."""
    return _mean_of_totals(_pairs(events, item), item, f"average_pop_{prefix}")


def category_popularity(events: DataFrame, products: DataFrame, prefix: str = "buy") -> DataFrame:
    """A5: as A4 on the category of a left join to products (unknown sku: skipped)."""
    cells = _pairs(events, "sku").join(products.select("sku", "category"), "sku", "left") \
        .groupBy("client_id", "category").agg(F.sum("_n").alias("_n"))
    return _mean_of_totals(cells, "category", f"category_popularity_{prefix}")


def _prices(cells: DataFrame) -> DataFrame:
    return cells.groupBy("client_id").agg(
        F.sum("_spent").cast("long").alias("total_spent"),
        (F.sum("_spent") / F.sum("_priced")).alias("average_spent"),
    )


def price(buys: DataFrame, products: DataFrame) -> DataFrame:
    """A10: sum and mean price of bought items (left join: unknown sku adds nothing)."""
    return _prices(_pairs(buys, "sku").join(products.select("sku", "price"), "sku", "left").select(
        "client_id", (F.col("_n") * F.col("price")).alias("_spent"),
        F.when(F.col("price").isNotNull(), F.col("_n")).alias("_priced")))


def conversion(adds: DataFrame, buys: DataFrame, key: str, out: str) -> DataFrame:
    """Share of the client's distinct added keys that were also bought.

    One union + ``groupBy(client, key)`` replaces two distincts and a join; a
    null key is a group like any other, so null pairs match (null-safe).
    """
    u = (adds.select("client_id", key, F.lit(1).alias("_a"), F.lit(0).alias("_b"))
         .unionByName(buys.select("client_id", key, F.lit(0).alias("_a"), F.lit(1).alias("_b"))))
    pairs = u.groupBy("client_id", key).agg(F.max("_a").alias("_a"), F.max("_b").alias("_b"))
    return (pairs.where(F.col("_a") == 1)
            .groupBy("client_id").agg(F.avg("_b").alias(out)))


def with_category(events: DataFrame, products: DataFrame) -> DataFrame:
    """Left join to the product category (unknown sku: null category)."""
    return events.join(products.select("sku", "category"), "sku", "left")


def merge_features(clients: DataFrame, parts: list[DataFrame], columns: list[str] | None = None) -> DataFrame:
    """Every client of ``clients`` with each part's columns, missing → 0.

    Implemented as one union of the parts plus ``groupBy(client_id)``: each
    part has at most one value per client and column, so ``max`` picks it.
    """
    tagged = [clients.select("client_id", F.lit(1).alias("_keep"))]
    tagged += [p.withColumn("_keep", F.lit(0)) for p in parts]
    u = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)
    cols = columns or [c for p in parts for c in p.columns if c != "client_id"]
    g = (u.groupBy("client_id")
         .agg(F.max("_keep").alias("_keep"), *[F.max(c).alias(c) for c in cols])
         .where(F.col("_keep") == 1))
    return g.select("client_id", *[F.coalesce(F.col(c), F.lit(0)).alias(c) for c in cols])


def drop_all_zero(df: DataFrame) -> DataFrame:
    """keep rows where any feature differs from 0."""
    feats = [c for c in df.columns if c != "client_id"]
    return df.where(reduce(lambda a, b: a | b, [F.col(c) != 0 for c in feats]))


def relevant_events(inputs: Inputs) -> dict[str, DataFrame]:
    """The four event tables restricted to relevant clients."""
    rel = inputs.relevant_clients
    return {
        "buy": relevant_only(inputs.product_buy, rel),
        "add": relevant_only(inputs.add_to_cart, rel),
        "visit": relevant_only(inputs.page_visit, rel),
        "remove": relevant_only(inputs.remove_from_cart, rel),
    }


def event_cells(inputs: Inputs) -> DataFrame:
    """``(_p, client_id, sku, _day, _c, _f, _l)``: the four event tables of the relevant clients, tagged (a visit's item
    is its url) and reduced to cells per client, item and day by one scan, one semi join and one aggregate."""
    ev = relevant_only(reduce(lambda a, b: a.unionByName(b), [
        t.select(F.lit(p).alias("_p"), "client_id", "timestamp", F.col("url" if p == "visit" else "sku").alias("sku"))
        for p, t in (("buy", inputs.product_buy), ("add", inputs.add_to_cart), ("visit", inputs.page_visit),
                     ("remove", inputs.remove_from_cart))]), inputs.relevant_clients)
    return daily(ev, ("_p", "sku"))


def features_all(inputs: Inputs, submit: bool = True) -> DataFrame:
    """The full 37-column statistics table, one row per relevant client.

    The reduced events (:func:`event_cells`) are written once. Every feature is an aggregate of those cells, for all
    tables at the same time; what needs the products reads a second reduction, by category, behind a single join."""
    by = ("_p",)
    cells = cut_lineage(event_cells(inputs))
    days = cut_lineage(cells.groupBy(*by, "client_id", "_day").agg(F.sum("_c").alias("_c"), F.min("_f").alias("_f"), F.max("_l").alias("_l")))
    pairs = cut_lineage(cells.groupBy(*by, "client_id", "sku").agg(F.sum("_c").alias("_n")))
    bought = F.col("_p").isin(*ACTION_PREFIXES)
    spent = F.col("_n") * F.col("price")
    sorts = cut_lineage(pairs.where(bought).join(inputs.product_properties.select("sku", "category", "price"), "sku", "left")
                        .groupBy(*by, "client_id", "category").agg(
                            F.sum("_n").alias("_n"), F.sum(spent).alias("_spent"),
                            F.sum(F.when(F.col("price").isNotNull(), F.col("_n"))).alias("_priced")))

    def of(p: str, column: str, name: str) -> F.Column:
        return F.when(F.col("_p") == p, F.col(column)).alias(name)

    def both(rows: DataFrame, key: str, out: str) -> DataFrame:
        return conversion(rows.where("_p = 'add'"), rows.where("_p = 'buy'"), key, out)

    visits = days.where("_p = 'visit'").withColumn("timestamp", F.col("_day").cast("timestamp_ntz"))
    parts = [
        _activity(days, by).select("client_id", *[of(p, f"_a{i}", c.format(p=p)) for p in ALL_PREFIXES
                                                  for i, c in enumerate(ACTIVITY_COLUMNS)]),
        _mean_of_totals(sorts.select(*by, "client_id", "category", "_n"), "category", "_m", by).select(
            "client_id", *[of(p, "_m", f"category_popularity_{p}") for p in ACTION_PREFIXES]),
        _mean_of_totals(pairs, "sku", "_m", by).select("client_id", *[of(p, "_m", f"average_pop_{p}") for p in ALL_PREFIXES
                                                                      if f"average_pop_{p}" in feature_columns()]),
        stability(visits),
        _prices(sorts.where("_p = 'buy'")),
        both(pairs, "sku", "bought"),
        both(sorts, "category", "bought_cat"),
    ]
    out = merge_features(inputs.relevant_clients, parts, feature_columns())
    return out if submit else drop_all_zero(out)


def as_embedding(features: DataFrame) -> DataFrame:
    """The statistics as an embedding table ``(client_id, embedding ARRAY<FLOAT>)``."""
    feats = [c for c in features.columns if c != "client_id"]
    return features.select("client_id", F.array(*[F.col(c).cast("float") for c in feats]).alias("embedding"))


__all__ = [
    "activity", "interaction_count", "mean_interval", "stability", "item_popularity",
    "category_popularity", "price", "conversion", "merge_features", "drop_all_zero",
    "features_all", "feature_columns", "relevant_events", "table_constants", "as_embedding",
    "elapsed_micros",
]
