"""Client event sequences and their model views.

Sequence builders return the LONG form ``(client_id, pos, field...)``: one
row per event with its 0-based position in the client's history under an
explicit total order ``(timestamp, event type, item, ...)``. Long form has
no per-client size limit, so a client with a third of all events is still
spread over many tasks (see :func:`ordering.positions`).

Views that feed models take the newest ``n`` events only; they collect
bounded arrays with :func:`ordering.collect_ordered` and use Spark's array
functions (``slice``, ``concat``, ``transform``, ``aggregate``).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arrays import codes_to_array, last_n
from ..sources.inputs import Inputs, relevant_only
from ..functions.draws import draw
from ..session import cut_lineage
from .ordering import collect_ordered, newest, positions
from .vocab import apply_capped_many, dense_codes, min_count_items, min_events_clients

#: Special tokens of the sequence views.
PAD, START, END = 0, 1, 2
LABEL_PAD = -100


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


# ---- Q1: event/day sequences ------------------------------------------------------

EVENT_DAY_ORDER = ["timestamp", "event_type"]


def _tagged(inputs: Inputs, relevant: bool) -> DataFrame:
    """``(client_id, timestamp, event_type)`` of the five event tables; event codes add..search = 1..5 (+2)."""
    tagged = [inputs.add_to_cart, inputs.remove_from_cart, inputs.product_buy,
              inputs.page_visit, inputs.search_query]
    data = _union([t.select("client_id", "timestamp", F.lit(code + 2).cast("long").alias("event_type"))
                   for code, t in enumerate(tagged, start=1)])
    return relevant_only(data, inputs.relevant_clients) if relevant else data


def _with_day(data: DataFrame) -> DataFrame:
    """Add ``day``: calendar days since the first date of all events (+3)."""
    first = data.agg(F.min(F.to_date("timestamp")).alias("_d0"))
    return data.crossJoin(F.broadcast(first)).withColumn(
        "day", (F.datediff(F.to_date("timestamp"), F.col("_d0")) + 3).cast("long")).drop("_d0")


def event_days(inputs: Inputs, relevant: bool = True) -> DataFrame:
    """``(client_id, timestamp, event_type, day)`` of all events."""
    return _with_day(_tagged(inputs, relevant))


def event_day(inputs: Inputs, relevant: bool = True, last: int | None = None) -> DataFrame:
    """Q1: ``(client_id, pos, event_type, day)`` of :func:`event_days`. With ``last`` only each client's newest events, by
    a window limit. Without it the events are written before the first date of all is taken."""
    if last is None:
        data = _with_day(cut_lineage(_tagged(inputs, relevant)))
        return positions(data, "client_id", EVENT_DAY_ORDER).drop("timestamp")
    return newest(event_days(inputs, relevant), "client_id", EVENT_DAY_ORDER, last).drop("timestamp")


# ---- Q2/Q3: multi-feature sequences --------------------------------------------------

FULL_COLUMNS = ("event_type", "category", "price", "sku", "url", "day", "week", "month")


def full_events(inputs: Inputs, max_count: int = 5000, relevant: bool = True) -> DataFrame:
    """Q2 + Q3 in event form: every event with capped sku/url codes and time features. The events are written once, since
    the vocabularies, the first dates and the result read them."""
    def cart(t: DataFrame, code: int) -> DataFrame:
        return t.select("client_id", "timestamp", (F.col("category") + 1).alias("category"),
                        (F.col("sku") + 1).alias("sku"), (F.col("price") + 1).alias("price"),
                        F.lit(code).alias("event_type"))
    data = _union([
        cart(inputs.enriched("add_to_cart"), 0),
        cart(inputs.enriched("remove_from_cart"), 1),
        cart(inputs.enriched("product_buy"), 2),
        inputs.page_visit.select("client_id", "timestamp", "url", F.lit(3).alias("event_type")),
        inputs.search_query.select("client_id", "timestamp", F.lit(4).alias("event_type")),
    ])
    if relevant:
        data = relevant_only(data, inputs.relevant_clients)
    data = data.select("client_id", "timestamp", "event_type",
                       *[F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
                         for c in ("category", "sku", "price", "url")])
    data = apply_capped_many(cut_lineage(data), ["url", "sku"], max_count)
    mins = data.agg(F.min(F.to_date("timestamp")).alias("_d0"),
                    F.min(F.weekofyear("timestamp")).alias("_w0"),
                    F.min(F.month("timestamp")).alias("_m0"))
    d = data.crossJoin(F.broadcast(mins))
    return d.select(
        "client_id", "timestamp",
        (F.col("event_type") + 3).cast("long").alias("event_type"),
        (F.col("category") + 3).cast("long").alias("category"),
        (F.col("price") + 3).cast("long").alias("price"),
        (F.col("sku") + 3).cast("long").alias("sku"),
        (F.col("url") + 3).cast("long").alias("url"),
        (F.datediff(F.to_date("timestamp"), F.col("_d0")) + 3).cast("long").alias("day"),
        (F.weekofyear("timestamp") - F.col("_w0") + 3).cast("long").alias("week"),
        (F.month("timestamp") - F.col("_m0") + 3).cast("long").alias("month"),
    )


def full(inputs: Inputs, use_columns=FULL_COLUMNS, max_count: int = 5000, relevant: bool = True) -> DataFrame:
    """Q2: ``(client_id, pos, *use_columns)``, ordered by time then every column."""
    ev = full_events(inputs, max_count, relevant)
    order = ["timestamp", *FULL_COLUMNS]
    return positions(ev, "client_id", order).select("client_id", "pos", *use_columns)


def vocab_sizes(events: DataFrame, columns) -> DataFrame:
    """Q2's vocabulary: one row, ``max + 1`` per column."""
    return events.agg(*[(F.max(c) + 1).cast("long").alias(f"vocab_{c}") for c in columns])


# ---- Q4: sku-text sequences -----------------------------------------------------------

def sku_text(inputs: Inputs) -> DataFrame:
    """Q4: ``(client_id, pos, text)`` — name codes (+3) of each client's distinct skus,
    skus in order of first event, codes flattened (A16).

    What is sorted and written is a sku with its codes; a code's position is its sku's first one plus its place. Codes come
    by a shuffle of both sides: products are few bytes of parquet, by which Spark would hold the codes of all of them in
    the driver for a broadcast."""
    ev = _union([inputs.enriched(n).select("client_id", "timestamp", "sku")
                 for n in ("product_buy", "add_to_cart", "remove_from_cart")])
    first = ev.groupBy("client_id", "sku").agg(F.min("timestamp").alias("timestamp"))  # W5 as an aggregate
    codes = inputs.product_properties.select("sku", F.posexplode(codes_to_array("name")).alias("_i", "_tok")) \
        .groupBy("sku").agg(F.array_sort(F.collect_list(F.struct("_i", "_tok"))).alias("_codes"))
    named = first.join(codes.hint("merge"), "sku", "inner").withColumn("_size", F.size("_codes"))
    ranked = positions(named, "client_id", ["timestamp", "sku"], size="_size")
    return ranked.select("client_id", F.col("pos").alias("_p"), F.posexplode("_codes").alias("_at", "_code")).select(
        "client_id", (F.col("_p") + F.col("_at")).alias("pos"), (F.col("_code")["_tok"] + 3).cast("long").alias("text"))


# ---- Q5: cart/buy sequences -------------------------------------------------------------

CART_FIELDS = ("sku", "category", "price", "event")


#: A total order of a client's cart events.
CART_ORDER = ["timestamp", "event", "sku"]


def cart_events(inputs: Inputs, drop_short: bool = True, relevant: bool = False) -> DataFrame:
    """``(client_id, timestamp, sku, category, price, event)``; add 1, remove 2, buy 3.

    ``drop_short`` keeps clients with more than one event (counted before
    the relevant filter, as in the original)."""
    data = _union([inputs.enriched(n).select("client_id", "timestamp", "sku", "category", "price",
                                             F.lit(code).cast("long").alias("event"))
                   for n, code in (("product_buy", 3), ("add_to_cart", 1), ("remove_from_cart", 2))])
    if drop_short:
        data = min_events_clients(cut_lineage(data), 2)         # read for the counts and for the events
    return relevant_only(data, inputs.relevant_clients) if relevant else data


def cart(inputs: Inputs, drop_short: bool = True, relevant: bool = False, last: int | None = None) -> DataFrame:
    """Q5: ``(client_id, pos, sku, category, price, event)`` of :func:`cart_events`."""
    data = cart_events(inputs, drop_short, relevant)
    return (positions(data, "client_id", CART_ORDER) if last is None else newest(data, "client_id", CART_ORDER, last)) \
        .drop("timestamp")


# ---- Q6: visit sequences -----------------------------------------------------------------

def visits(inputs: Inputs, min_count: int | None = 10, relevant: bool = True, last: int | None = None) -> DataFrame:
    """Q6: ``(client_id, url, url_code, time_idx, time_idx_reversed)``.

    url codes are dense from 1 in url order (0 stays free for padding)."""
    data = inputs.page_visit
    if relevant:
        data = relevant_only(data, inputs.relevant_clients)
    if min_count is not None:
        data = min_count_items(data, "url", min_count)
    codes = dense_codes(data, "url", start=1, code="url_code")
    data = data.join(codes, "url", "inner")
    order, names = ["timestamp", "url"], {"pos": "time_idx", "rev": "time_idx_reversed"}
    return (positions(data, "client_id", order, **names) if last is None
            else newest(data, "client_id", order, last, **names)).drop("timestamp")


# ---- views (bounded arrays) ---------------------------------------------------------------

def arrays(long: DataFrame, fields, last: int | None = None, pos: str = "pos") -> DataFrame:
    """One row per client, one array per field in position order.

    ``last`` keeps the newest ``last`` events only (bounded arrays)."""
    fields = list(fields)
    if last is None:
        return collect_ordered(long, "client_id", pos, fields)
    return collect_ordered(newest(long, "client_id", [pos], last, pos="_p0"), "client_id", "_p0", fields)


def with_special_tokens(df: DataFrame, fields, max_length: int = 128) -> DataFrame:
    """Q7 / R1 + R2: last ``max_length - 2`` values, then ``[START] + a + [END]``."""
    out = df
    for f in fields:
        out = out.withColumn(f, F.concat(F.array(F.lit(START).cast("long")), last_n(F.col(f), max_length - 2),
                                         F.array(F.lit(END).cast("long"))))
    return out


def encoder_view(long: DataFrame, fields, max_length: int = 128) -> DataFrame:
    """Q7: encoder input arrays per client."""
    return with_special_tokens(arrays(long, fields, last=max_length - 2), fields, max_length)


def shift(df: DataFrame, fields, label_fields=None) -> DataFrame:
    """inputs = all but the last, labels = all but the first."""
    out = df
    for f in (label_fields or fields):
        out = out.withColumn(f"labels_{f}", F.slice(F.col(f), 2, F.greatest(F.size(F.col(f)) - 1, F.lit(0))))
    for f in fields:
        out = out.withColumn(f, F.slice(F.col(f), 1, F.greatest(F.size(F.col(f)) - 1, F.lit(0))))
    return out


def causal_train_view(visit_long: DataFrame, max_length: int = 256) -> DataFrame:
    """Q10 (without negatives): last ``max_length + 1`` items, ``input_ids`` and ``labels``."""
    a = arrays(visit_long.withColumnRenamed("url_code", "item"), ["item"], last=max_length + 1, pos="time_idx")
    return a.select("client_id",
                    F.slice("item", 1, F.greatest(F.size("item") - 1, F.lit(0))).alias("input_ids"),
                    F.slice("item", 2, F.greatest(F.size("item") - 1, F.lit(0))).alias("labels"))


def causal_predict_view(visit_long: DataFrame, max_length: int = 256, validation: bool = True,
                        full_history: bool = False) -> DataFrame:
    """Q11: ``input_ids`` (newest ``max_length`` before the target), ``target``.

    With ``full_history`` also ``history``, the sorted distinct items of the
    client (for filtering seen ones); it grows with the client's history, so
    the long form ``visit_long`` is to be preferred for hot clients."""
    v = visit_long
    if validation:
        target = v.where(F.col("time_idx_reversed") == 0).select("client_id", F.col("url_code").alias("target"))
        inputs = v.where(F.col("time_idx_reversed") > 0)
    else:
        target, inputs = None, v
    a = arrays(inputs.withColumnRenamed("url_code", "input_ids"), ["input_ids"], last=max_length, pos="time_idx")
    if full_history:
        a = a.join(inputs.groupBy("client_id").agg(F.array_sort(F.collect_set("url_code")).alias("history")), "client_id")
    return a.join(target, "client_id", "inner") if target is not None else a


def next_event_predict_view(events: DataFrame, order: list, fields, max_length: int = 64) -> DataFrame:
    """Q9: the newest ``max_length`` events before the held-out last one, plus the labels (one window limit and one
    ``groupBy`` on the same partitioning; clients with a single event have nothing to predict from and drop out)."""
    kept = newest(events, "client_id", order, max_length + 1, pos="_p0", rev="_rev")
    row = F.struct(F.col("_p0"), *[F.col(f) for f in fields])
    g = kept.groupBy("client_id").agg(
        F.array_sort(F.collect_list(F.when(F.col("_rev") > 0, row))).alias("_seq"),
        *[F.max(F.when(F.col("_rev") == 0, F.struct(F.col(f)))).alias(f"_{f}") for f in fields])

    def field_of(f: str):
        return lambda x: x[f]

    return g.where(F.size("_seq") > 0).select(
        "client_id", *[F.transform("_seq", field_of(f)).alias(f) for f in fields],
        *[F.col(f"_{f}")[f].alias(f"{f}_true") for f in fields])


def holdout_last(long: DataFrame, rev: str = "time_idx_reversed") -> tuple[DataFrame, DataFrame]:
    """(inputs, labels) — the last event of each client is its label."""
    return long.where(F.col(rev) > 0), long.where(F.col(rev) == 0)


def pad(df: DataFrame, fields, length: Column | int, label_fields=()) -> DataFrame:
    """Right-pad arrays to ``length`` (0; labels -100) and add a mask."""
    L = F.lit(length) if isinstance(length, int) else length
    out = df
    first = list(fields)[0]
    out = out.withColumn("mask", F.concat(F.array_repeat(F.lit(1), F.size(first)),
                                          F.array_repeat(F.lit(0), L - F.size(first))))
    for f in fields:
        fill = LABEL_PAD if f in label_fields else PAD
        out = out.withColumn(f, F.concat(F.col(f), F.array_repeat(F.lit(fill).cast("long"), L - F.size(f))))
    return out


def pad_to_longest(df: DataFrame, fields, label_fields=()) -> DataFrame:
    """Q12 over a whole frame: the longest array is a one-row aggregate."""
    first = list(fields)[0]
    L = df.agg(F.max(F.size(first)).alias("_L"))
    return pad(df.crossJoin(F.broadcast(L)), fields, F.col("_L"), label_fields).drop("_L")


def _slice_bounds(size: Column, key: str, min_len: int, max_len: int, seed: int) -> tuple[Column, Column]:
    """1-based start and length of E5's seeded slice for a sequence of ``size`` items."""
    want = F.lit(min_len) + draw(key, seed) % (max_len - min_len + 1)
    length = F.least(size, want)
    start = draw(key, seed + 1) % F.greatest(size - length + 1, F.lit(1)) + 1
    return start, length


def random_slice(df: DataFrame, fields, min_len: int, max_len: int, seed: int = 42,
                 key: str = "client_id") -> DataFrame:
    """E5: a seeded random contiguous slice of length in ``[min_len, max_len]`` (capped by size)."""
    first = list(fields)[0]
    start, length = _slice_bounds(F.size(first), key, min_len, max_len, seed)
    out = df.withColumn("_len", length).withColumn("_start", start)
    for f in fields:
        out = out.withColumn(f, F.slice(F.col(f), F.col("_start").cast("int"), F.col("_len").cast("int")))
    return out.drop("_len", "_start")


def random_slice_long(long: DataFrame, min_len: int, max_len: int, seed: int = 42,
                      key: str = "client_id", pos: str = "pos") -> DataFrame:
    """E5 on the long form: only the rows of each client's slice (same slice as
    :func:`random_slice` on the client's full arrays), so at most ``max_len``
    rows per client are ever collected, however long its history."""
    sizes = long.groupBy(key).agg(F.count(F.lit(1)).alias("_size"))
    start, length = _slice_bounds(F.col("_size"), key, min_len, max_len, seed)
    bounds = sizes.select(key, (start - 1).alias("_lo"), length.alias("_len"))
    j = long.join(bounds, key)
    return j.where((F.col(pos) >= F.col("_lo")) & (F.col(pos) < F.col("_lo") + F.col("_len"))).drop("_lo", "_len")


def next_event_train_view(long: DataFrame, fields, min_length: int = 32, max_length: int = 64,
                          seed: int = 42) -> DataFrame:
    """Q8: random slice of ``min+1 .. max+1`` events, then inputs / labels shift."""
    sliced = random_slice_long(long, min_length + 1, max_length + 1, seed)
    return shift(collect_ordered(sliced, "client_id", "pos", list(fields)), fields)


#: Modulus of the negative draws (a prime); gaps that a client's array holds at most (a power of two, less 1).
DRAW_PRIME = 2_147_483_647
GAPS = 511


def draw_coefficients(key: str, seed: int) -> list[Column]:
    """Coefficients of a key's polynomial: its value at ``j`` modulo the prime is the key's ``j``-th draw."""
    return [(draw(key, seed + i) % DRAW_PRIME).alias(f"_c{i}") for i in range(3)]


def gaps(history: DataFrame, item: str = "item") -> DataFrame:
    """``(client_id, at, below)``: from the ``at``-th unseen item (from 0) on, ``below`` seen items lie below it.

    The seen items ``h_i`` (sorted, i from 0) of a client lie below its r-th unseen item if ``h_i - i - 1 <= r``. Ranks
    come from code buckets, so a long history is spread; runs of neighbouring codes are one row."""
    seen = history.select("client_id", F.col(item).cast("long").alias("_h")).distinct()
    ranked = positions(seen, "client_id", ["_h"], pos="_i", bucket=F.shiftright("_h", 12))
    return ranked.groupBy("client_id", (F.col("_h") - F.col("_i") - 1).alias("at")).agg(F.max(F.col("_i") + 1).alias("below"))


def negatives(history: DataFrame, n_items: DataFrame, n: int = 10_000, seed: int = 42, item: str = "item",
              limit: int = GAPS) -> DataFrame:
    """``(client_id, place, item)``: ``n`` items per client drawn with replacement from items NOT in its history.

    Items are dense codes ``1..K`` (``n_items`` is a one-row ``K``). Draw ``j`` is the client's seeded polynomial at
    ``j``, modulo the number of unseen items: the r-th unseen item, which is ``r + 1`` plus the seen items below it
    (:func:`gaps`), exact, without rejection and without a client x item product. Clients of at most ``limit`` gaps look
    them up in an array, by halving, in generated code and where the client's row lies: their draws are not shuffled.
    The draws of others are joined to their gaps in buckets of 1,024 unseen items. A client without unseen items has no
    rows."""
    steps = [1 << i for i in reversed(range(limit.bit_length()))] or [1]
    total = n_items.select(F.col(n_items.columns[0]).cast("long").alias("_K"))
    found = cut_lineage(gaps(history, item))
    sizes = found.groupBy("client_id").agg(F.count(F.lit(1)).alias("_g"), F.max("below").alias("_seen"))
    clients = cut_lineage(sizes.crossJoin(F.broadcast(total)).select(
        "client_id", "_g", (F.col("_K") - F.col("_seen")).alias("_free"), *draw_coefficients("client_id", seed))
        .where("_free > 0"))
    places = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))).alias("place")

    def drawn(rows: DataFrame) -> DataFrame:
        j, prime = F.col("place"), F.lit(DRAW_PRIME).cast("long")
        return rows.withColumn("_r", ((F.col("_c2") * j + F.col("_c1")) % prime * j + F.col("_c0")) % prime % F.col("_free"))

    # few gaps: sorted arrays of bounded length
    light = clients.where(F.col("_g") <= limit)
    arrays = found.join(light.select("client_id"), "client_id", "left_semi").groupBy("client_id").agg(
        F.array_sort(F.collect_list(F.struct("at", "below"))).alias("_s"))
    held = light.join(arrays, "client_id").select("client_id", "_free", "_c0", "_c1", "_c2",
                                                  F.transform("_s", lambda x: x["at"]).alias("_at"),
                                                  F.transform("_s", lambda x: x["below"]).alias("_below"))
    rows = drawn(held.select("*", places)).withColumn("_p", F.lit(0))
    for step in steps:                                      # _p gaps begin at or below the draw
        further = F.coalesce(F.get("_at", F.col("_p") + (step - 1)) <= F.col("_r"), F.lit(False))
        rows = rows.withColumn("_p", F.when(further, F.col("_p") + step).otherwise(F.col("_p")))
    below = F.coalesce(F.get("_below", F.col("_p") - 1), F.lit(0))
    small = rows.select("client_id", "place", (F.col("_r") + 1 + below).alias("item"))

    # many gaps: draws meet the gaps of their bucket
    heavy = clients.where(F.col("_g") > limit)
    if heavy.isEmpty():
        return small
    asked = drawn(heavy.select("*", places)).select("client_id", "place", F.col("_r").alias("at"))
    both = asked.withColumn("below", F.lit(None).cast("long")).unionByName(
        found.join(heavy.select("client_id"), "client_id", "left_semi").withColumn("place", F.lit(None).cast("long"))) \
        .withColumn("_b", F.shiftright("at", 10))
    last = both.groupBy("client_id", "_b").agg(F.max("below").alias("_m"))
    before = Window.partitionBy("client_id").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    carried = last.select("client_id", "_b", F.coalesce(F.max("_m").over(before), F.lit(0)).alias("_carried"))
    inside = Window.partitionBy("client_id", "_b").orderBy("at", F.col("place").asc_nulls_first()) \
        .rowsBetween(Window.unboundedPreceding, 0)
    met = both.withColumn("_in", F.max("below").over(inside)).where("place is not null").join(carried, ["client_id", "_b"])
    large = met.select("client_id", "place", (F.col("at") + 1 + F.greatest(F.coalesce("_in", F.lit(0)), "_carried")).alias("item"))
    return small.unionByName(large)


def causal_train_with_negatives(visit_long: DataFrame, max_length: int = 256, n: int = 10_000,
                                seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Q10: the training view, and ``(client_id, place, item)`` negatives drawn against the truncated sequences."""
    window = visit_long.where(F.col("time_idx_reversed") <= max_length).select(
        "client_id", F.col("url_code").alias("item"))
    k = visit_long.agg(F.max("url_code").alias("K"))
    return causal_train_view(visit_long, max_length), negatives(window, k, n, seed)
