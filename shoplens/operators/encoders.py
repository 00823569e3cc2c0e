"""Client vectors from sequences and texts (K5, K6, K9, K12, G8, H4) — re-aimed.

The original trains GPU networks (a recurrent autoencoder, next-event
transformers, a language model). The same input/output contract —
``(client_id, embedding)`` with a fixed width — is served here by linear
models that Spark fits on the cluster, without any vocabulary:

* ``bag_pca``: a client's bag of ``field=value`` tokens (the sum of its
  events' field embeddings, K12), every token hashed with a sign into a fixed
  number of slots, reduced by a centred PCA — the linear autoencoder;
* ``state_pca``: the same over decayed states, in which the order of the events
  counts;
* ``token_vectors`` / ``item2vec``: an item's vector sums seeded ±1 vectors of
  the items around it in the clients' sequences; a client's vector is the
  mean over its newest items;
* ``text``: the bag model over the last ``max_tokens`` words of each text
  (the original's left truncation);
* ``apply_encoder``: any user batch encoder (numpy in, numpy out) through
  ``mapInPandas`` with Arrow batches.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.arrays import last_n
from ..functions.draws import draw
from ..session import cut_lineage
from .event_state import decayed_state, dense, known_slots, with_slots
from .ordering import newest
from .vectors import covariance, project, top_components

#: Slots of the hashed bags (the PCA's covariance is SLOTS x SLOTS on the driver).
SLOTS = 256


def token_counts(long: DataFrame, fields) -> DataFrame:
    """``(client_id, token, n)`` — every event contributes one ``field=value`` token per field (null: none)."""
    toks = long.select("client_id", F.explode(F.array(*[
        F.concat(F.lit(f"{f}="), F.col(f).cast("string")) for f in fields])).alias("token"))
    return toks.where(F.col("token").isNotNull()).groupBy("client_id", "token").agg(F.count(F.lit(1)).alias("n"))


def bag_entries(counts: DataFrame, slots: int = SLOTS, seed: int = 42, known: DataFrame | None = None) -> DataFrame:
    """``(client_id, slot, value)``: all tokens hashed into ``slots`` signed sums; nothing is left out or merged into
    a rest. A client has at most ``slots`` entries, whatever its number of events. ``known`` (:func:`known_slots`) has
    tokens drawn before; the others are drawn here."""
    placed = with_slots(counts, "token", slots, seed, known)
    return placed.groupBy("client_id", "slot").agg(F.sum(F.col("_sign") * F.col("n")).cast("double").alias("value"))


def field_entries(long: DataFrame, fields, slots: int = SLOTS, seed: int = 42) -> DataFrame:
    """:func:`bag_entries` of :func:`token_counts`, with the draws of fields of few values made once for each value."""
    return bag_entries(token_counts(long, fields), slots, seed, known_slots(long, fields, slots, seed))


def bag_vectors(entries: DataFrame, slots: int = SLOTS) -> DataFrame:
    """``(client_id, embedding)``: the entries as dense arrays of ``slots`` numbers."""
    return dense(entries, slots)


def _fitted_bags(entries: DataFrame, k: int, slots: int) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """The bags, written once as they are read by the fit and the transform, with mean and components."""
    bags = cut_lineage(bag_vectors(entries, slots))
    mean, cov = covariance(bags)
    return bags, mean, top_components(cov, k)


def bag_pca(long: DataFrame, fields, k: int = 64, slots: int = SLOTS) -> DataFrame:
    """K5: hashed token bags of each client's events, centred PCA to ``k`` components."""
    return project(*_fitted_bags(field_entries(long, fields, slots), k, slots))


def state_pca(events: DataFrame, fields, order: list, k: int = 64, slots: int = SLOTS) -> DataFrame:
    """K5 with order: decayed states of each client's events (:func:`event_state.decayed_state`), centred PCA to ``k``."""
    states = cut_lineage(dense(decayed_state(events, fields, order, slots=slots), slots))
    mean, cov = covariance(states)
    return project(states, mean, top_components(cov, k))


def reconstruction_error(long: DataFrame, fields, k: int = 64, slots: int = SLOTS) -> DataFrame:
    """G8 re-aimed: per client, squared distance between its centred bag and the bag's PCA reconstruction
    (``||x - mu||^2 - ||proj||^2``; components are orthonormal)."""
    bags, mean, comps = _fitted_bags(field_entries(long, fields, slots), k, slots)
    mu = F.lit(mean.tolist())
    length = bags.select("client_id", F.aggregate(F.zip_with("embedding", mu, lambda x, m: (x - m) * (x - m)),
                                                  F.lit(0.0), lambda a, x: a + x).alias("_sq"))
    inside = project(bags, mean, comps).select(
        "client_id", F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x).alias("_pp"))
    return length.join(inside, "client_id").select(
        "client_id", F.greatest(F.col("_sq") - F.col("_pp"), F.lit(0.0)).alias("error"))


def sign_of(token: Column, dim: Column, seed: int = 42) -> Column:
    """Seeded ±1 of a token in a dimension."""
    d = draw(F.concat_ws("/", token.cast("string"), dim.cast("string")), seed)
    return F.when(d % 2 == 0, F.lit(1)).otherwise(F.lit(-1))


def neighbour_counts(long: DataFrame, item: str, window: int = 5) -> DataFrame:
    """``(token, near, n)``: how often two items stand at most ``window`` places apart in a client's sequence.

    Each event goes to the places that it is near to, and the pairs are counted with partial aggregation. Both sides are
    shuffled: sequences lie in few bytes of parquet, by which Spark would hold all of them in the driver for a broadcast."""
    here = long.select("client_id", F.col("pos").alias("_p"), F.col(item).alias("token"))
    steps = F.array(*[F.lit(d) for d in range(-window, window + 1) if d])
    near = long.select("client_id", "pos", F.col(item).alias("near"), F.explode(steps).alias("_d")) \
        .select("client_id", (F.col("pos") + F.col("_d")).alias("_p"), "near")
    return here.join(near.hint("merge"), ["client_id", "_p"]).groupBy("token", "near").agg(F.count(F.lit(1)).alias("n"))


def _summed(rows: DataFrame, key: str, vector: Column) -> DataFrame:
    """``(key, _s, _n)``: elementwise sums of arrays of one width and of the counts ``n``, by partial aggregation."""
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    return rows.select(key, "n", array_to_vector(vector).alias("_v")).groupBy(key).agg(
        vector_to_array(Summarizer.sum(F.col("_v"))).alias("_s"), F.sum("n").alias("_n"))


def item_vectors(long: DataFrame, item: str, k: int = 64, window: int = 5, seed: int = 42) -> DataFrame:
    """``(token, vector)``: unit vectors, the count-weighted sum of the neighbours' seeded ±1 vectors (zeros if they
    cancel out). A pair of items is one row with an array of ``k`` signs."""
    pairs = neighbour_counts(long, item, window)
    signs = pairs.select("near").distinct().select("near", F.array(*[
        sign_of(F.col("near"), F.lit(d), seed).cast("double") for d in range(k)]).alias("_signs"))
    sums = _summed(pairs.join(signs, "near"), "token", F.transform("_signs", lambda s: s * F.col("n")))
    length = sums.select("token", "_s", F.sqrt(F.aggregate("_s", F.lit(0.0), lambda a, x: a + x * x)).alias("_l"))
    return length.select("token", F.transform("_s", lambda x: F.when(F.col("_l") > 0, x / F.col("_l")).otherwise(0.0)).alias("vector"))


def token_vectors(long: DataFrame, item: str, k: int = 64, window: int = 5, seed: int = 42) -> DataFrame:
    """``(token, dim, value)``: :func:`item_vectors` in long form."""
    return item_vectors(long, item, k, window, seed).select("token", F.posexplode("vector").alias("dim", "value"))


def item2vec(long: DataFrame, item: str, k: int = 64, max_length: int = 256, window: int = 5,
             seed: int = 42) -> DataFrame:
    """K6 re-aimed: a client's vector is the mean vector of its newest ``max_length`` items (zeros where they have no
    neighbours)."""
    recent = cut_lineage(newest(long, "client_id", ["pos"], max_length, pos="_p0").drop("pos")
                         .withColumnRenamed("_p0", "pos"))
    held = recent.groupBy("client_id", F.col(item).alias("token")).agg(F.count(F.lit(1)).alias("n"))
    zeros = F.array_repeat(F.lit(0.0), k)
    rows = held.join(item_vectors(recent, item, k, window, seed), "token", "left")
    sums = _summed(rows, "client_id", F.transform(F.coalesce("vector", zeros), lambda x: x * F.col("n")))
    return sums.where(F.col("client_id").isNotNull()).select("client_id", F.transform("_s", lambda x: x / F.col("_n")).alias("embedding"))


def tokens(text_col: str = "text") -> Column:
    """Lower-cased whitespace tokens of the whole text."""
    return F.split(F.lower(F.trim(F.col(text_col))), r"\s+")


def _words(max_tokens: int | None) -> Column:
    return tokens() if max_tokens is None else last_n(tokens(), max_tokens)


def text_counts(docs: DataFrame, max_tokens: int | None = None, key: str = "client_id") -> DataFrame:
    """``(client_id, token, n)`` of the texts, of their last ``max_tokens`` words if given."""
    return docs.select(F.col(key).alias("client_id"), F.explode(_words(max_tokens)).alias("token")) \
        .groupBy("client_id", "token").agg(F.count(F.lit(1)).alias("n"))


#: Tokens whose draws a worker remembers.
KNOWN_TOKENS = 500_000


def token_bags(rows: DataFrame, key: str, words: str, slots: int = SLOTS, seed: int = 42) -> DataFrame:
    """``(client_id, slot, value)`` of each row's array of words, as :func:`bag_entries` of their counts: a worker draws a
    word once and adds up a row's signs, so that neither words nor draws are made for each row."""
    schema = T.StructType([T.StructField("client_id", rows.schema[key].dataType), T.StructField("slot", T.LongType()),
                           T.StructField("value", T.DoubleType())])

    def run(batches):
        import hashlib

        import pyarrow as pa

        known: dict[str, tuple[int, int]] = {}

        def drawn(token: str) -> tuple[int, int]:       # functions.draws.draw
            slot, sign = (int(hashlib.md5(f"{token}:{s}".encode()).hexdigest()[:15], 16) for s in (seed, seed + 1))
            return slot % slots, 1 if sign % 2 == 0 else -1

        for batch in batches:
            lists = batch.column(1)
            lengths = lists.value_lengths().fill_null(0).to_numpy()
            coded = lists.flatten().dictionary_encode()
            if len(coded) == 0:
                continue
            if len(known) > KNOWN_TOKENS:
                known.clear()
            for token in (tokens := coded.dictionary.to_pylist()):
                if token not in known:
                    known[token] = drawn(token)
            at, sign = np.array([known[t] for t in tokens]).T
            index = coded.indices.to_numpy()
            cell = np.repeat(np.arange(len(lengths)), lengths) * slots + at[index]
            held = np.flatnonzero(np.bincount(cell))
            value = np.bincount(cell, weights=sign[index].astype("float64"))[held]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(held // slots)), pa.array(held % slots), pa.array(value)],
                                             ["client_id", "slot", "value"])

    sums = rows.select(key, words).mapInArrow(run, schema)
    return sums.groupBy("client_id", "slot").agg(F.sum("value").alias("value"))


def text_entries(docs: DataFrame, max_tokens: int | None = None, key: str = "client_id", slots: int = SLOTS) -> DataFrame:
    """K9: hashed word bags of the texts (left-truncated if asked), before the projection: the :func:`bag_entries` of
    :func:`text_counts`, made text by text."""
    return token_bags(docs.select(key, _words(max_tokens).alias("_w")), key, "_w", slots)


def text(docs: DataFrame, k: int = 64, max_tokens: int | None = None, key: str = "client_id",
         slots: int = SLOTS) -> DataFrame:
    """K9 re-aimed: hashed word bags of the texts (left-truncated if asked), centred PCA to ``k`` components."""
    return project(*_fitted_bags(text_entries(docs, max_tokens, key, slots), k, slots))


def batches_of(lengths: list[int], budget: int) -> list[tuple[int, int]]:
    """Stretches of neighbouring rows whose padded size (rows times longest) is at most ``budget``; a longer row stands
    alone."""
    out, start, longest = [], 0, 0
    for i, n in enumerate(lengths):
        longest = max(longest, n, 1)
        if i > start and longest * (i + 1 - start) > budget:
            out.append((start, i))
            start, longest = i, max(n, 1)
    return out + ([(start, len(lengths))] if start < len(lengths) else [])


def apply_encoder(docs: DataFrame, fn: Callable[[list[str]], np.ndarray], width: int,
                  key: str = "client_id", text_col: str = "text", budget: int | None = None) -> DataFrame:
    """H4: run a user batch encoder (list of texts → ``n × width`` array) on Arrow batches.

    With ``budget`` the rows of a partition are sorted by their number of words, longest first, and handed on in batches
    of at most that many words, counted with padding to the longest; a longer text is a batch of its own."""
    schema = T.StructType([T.StructField("client_id", T.LongType()),
                           T.StructField("embedding", T.ArrayType(T.FloatType()))])

    def run(batches):
        import pandas as pd
        for pdf in batches:
            if len(pdf) == 0:
                continue
            texts = pdf["_t"].fillna("").tolist()
            parts = [(0, len(texts))] if budget is None else batches_of(pdf["_n"].tolist(), budget)
            for start, stop in parts:
                emb = np.asarray(fn(texts[start:stop]), dtype="float32")
                if emb.shape != (stop - start, width):
                    raise ValueError(f"encoder returned shape {emb.shape}, expected {(stop - start, width)}")
                yield pd.DataFrame({"client_id": pdf["_k"].iloc[start:stop].astype("int64"), "embedding": list(emb)})

    rows = docs.select(F.col(key).cast("long").alias("_k"), F.col(text_col).alias("_t"),
                       F.greatest(F.size(F.filter(tokens(text_col), lambda w: w != "")), F.lit(0)).alias("_n"))
    return (rows if budget is None else rows.sortWithinPartitions(F.col("_n").desc())).mapInPandas(run, schema)
