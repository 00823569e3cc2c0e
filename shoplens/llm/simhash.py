"""SimHash near-duplicates by deletion-variant signatures.

A fingerprint has 64 bits. Cut into two halves, fingerprints at 3 or fewer
differing bits agree in one half up to a single bit. So each distinct
fingerprint is indexed, per half, under the half itself and under its 32
variants with one bit struck out; those that meet under a key are verified on
all 64 bits. Under a variant only fingerprints that differ in the struck bit
are compared, the others have met under the whole half.

Equal fingerprints are one class from the start, so copies never meet as
pairs. Keys are dealt out by hash and read in order; what a batch links leaves
it as a spanning forest, never as all pairs. A half that very many distinct
fingerprints share is dealt out as pairs of blocks of bounded size, each a
key of its own (``MEET``), so no task holds more than one such pair, and none
is left out.

Rows: a null text has no words, like an empty one (fingerprint zero, linked
like any other); a null id takes part but never names a component unless all
of its component are null; repeated rows are one class; very long texts are read whole. Empty tables give
empty results. Output columns replace input columns of the same name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shoplens.session import cut_lineage

from .common import byte_blocks, slices, text_input, with_fields
from .components import components, forest

#: Fingerprints compared with each other under one key; a larger key is dealt out in pairs of blocks of half this size.
MEET = 8192
#: Blocks of a crowded key at most (their numbers have 12 bits); beyond 2 ** 24 fingerprints under a key blocks grow.
MOST_BLOCKS = 4096
SEED = 42


def fingerprint(data: bytes, shingle: int = 3) -> bytes:
    """The 8 bytes of a text's fingerprint: bit set where over half of its shingles' hashes have it set."""
    counts, n, tail = np.zeros(64, dtype=np.int64), 0, []
    for block in byte_blocks(data.lower()):                 # bytes.lower: A-Z alone
        words = tail + block.split()                        # bytes.split: space and \x09-\x0D
        if len(words) >= shingle:
            joined = b" ".join(words)
            ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
            starts = [0, *(ends[:-shingle] + 1).tolist()]
            digests = [xxhash.xxh64_digest(joined[a:b], SEED) for a, b in zip(starts, ends[shingle - 1:].tolist())]
            for at in range(0, len(digests), 1 << 15):
                part = np.frombuffer(b"".join(digests[at:at + (1 << 15)]), np.uint8).reshape(-1, 8)
                counts += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
            n += len(digests)
        tail = words[1 - shingle:] if shingle > 1 else []
    if not n:
        if not tail:
            return bytes(8)
        return xxhash.xxh64_digest(b" ".join(tail), SEED)
    return np.packbits(2 * counts > n).tobytes()


def tag(docs: DataFrame, text: str = "text", shingle: int = 3, keep_text: bool = True) -> DataFrame:
    """Add ``fp`` (long, the fingerprint's bits); texts are read whole, in batches of bounded size."""
    src, names, column = text_input(docs, text, ["fp"], keep_text)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for pdf in slices(batch, column):
                made = pdf[names].copy()
                made["fp"] = np.array([int.from_bytes(fingerprint((x or "").encode(), shingle), "big", signed=True)
                                       for x in pdf[column]], dtype=np.int64)
                yield made

    return src.mapInPandas(run, with_fields(docs, names, {"fp": T.LongType()}))


def _halves(classes: DataFrame) -> DataFrame:
    return classes.select("fp", F.posexplode(F.array(
        F.shiftrightunsigned("fp", 32), F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF)))).alias("half", "whole"))


def _crowded(classes: DataFrame, meet: int) -> DataFrame:
    """``(half, whole, blocks)``: the halves that have a variant which more than ``meet`` fingerprints share, with the
    number of blocks per variant. A variant's crowd is the sum of two halves' crowds, so one of the two has over half
    of ``meet``, and such halves are few."""
    sizes = _halves(classes).groupBy("half", "whole").agg(F.count("*").alias("n"))
    large = cut_lineage(sizes.where(F.col("n") > meet // 2))
    if large.isEmpty():
        return large.select("half", "whole", F.lit(None).cast("map<int,long>").alias("blocks"))
    struck = F.explode(F.sequence(F.lit(0), F.lit(32))).alias("struck")
    keys = large.select("half", "whole", struck).select(
        "half", "struck", F.expr("if(struck < 32, whole & ~shiftleft(1L, struck), whole)").alias("value")).distinct()
    other = F.expr("if(struck < 32, value | shiftleft(1L, struck), null)")
    members = keys.select("*", F.explode(F.array("value", other)).alias("whole")).where("whole is not null")
    crowds = members.join(sizes, ["half", "whole"]).groupBy("half", "struck", "value").agg(F.sum("n").alias("n")) \
        .where(F.col("n") > meet)
    blocks = F.least(F.ceil(2 * F.col("n") / meet), F.lit(MOST_BLOCKS)).cast("long")
    return members.join(crowds, ["half", "struck", "value"]).groupBy("half", "whole").agg(
        F.map_from_entries(F.collect_list(F.struct("struck", blocks.alias("blocks")))).alias("blocks"))


def _keyed(classes: DataFrame, meet: int) -> DataFrame:
    """``(key, fp)``: 33 keys per half (``struck`` 32 is the whole half); under a crowded key a row stands once for
    each pair of blocks that its own takes part in. A key holds half and ``struck`` (7 bits), the value (32 bits) and
    the two blocks (12 bits each)."""
    crowded = cut_lineage(_crowded(classes, meet))
    rows = _halves(classes)
    if crowded.isEmpty():
        rows = rows.withColumn("blocks", F.lit(None).cast("map<int,long>"))
    else:
        rows = rows.join(crowded, ["half", "whole"], "left")
    dealt = F.expr("""if(coalesce(blocks[struck], 1) = 1, array(0L),
                      transform(filter(sequence(0L, blocks[struck] - 1), w -> w <> own),
                                w -> least(w, own) * 4096 + greatest(w, own)))""")
    return rows.withColumn("struck", F.explode(F.sequence(F.lit(0), F.lit(32)))) \
        .withColumn("value", F.expr("if(struck < 32, whole & ~shiftleft(1L, struck), whole)")) \
        .withColumn("own", F.expr("pmod(xxhash64(fp), blocks[struck])")) \
        .withColumn("pair", F.explode(dealt)) \
        .select(F.expr("shiftleft(shiftleft(cast(half * 33 + struck as bigint), 32) + value, 24) + pair").alias("key"), "fp")


def _compare(x: np.ndarray, struck: int, half: int, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links among the fingerprints that meet under one key, compared in blocks."""
    if struck < 32:
        bit = np.uint64(struck + (32 if half == 0 else 0))
        one = ((x >> bit) & np.uint64(1)).astype(bool)
        left, right = x[one], x[~one]
    else:
        left = right = x
    us, vs = [], []
    for at in range(0, len(left), 512):
        i, j = np.nonzero(np.bitwise_count(left[at:at + 512, None] ^ right[None, :]) <= distance)
        u, v = forest(left[at + i], right[j])
        us.append(u)
        vs.append(v)
    return (np.concatenate(us), np.concatenate(vs)) if us else (x[:0], x[:0])


def _link_sorted(distance: int):
    """Links of rows that come ordered by key, batch after batch."""

    def links(key: np.ndarray, x: np.ndarray) -> pd.DataFrame:
        new = np.ones(len(x), dtype=bool)
        new[1:] = key[1:] != key[:-1]
        run = np.cumsum(new) - 1
        size = np.bincount(run)
        first = np.flatnonzero(new)
        half, struck = np.divmod(key >> 56, 33)
        us, vs = [], []
        few = size[run] <= 64                               # small runs: compare neighbours at distance 1, 2, ...
        at = np.flatnonzero(few & (size[run] > 1))
        for d in range(1, 64):
            at = at[at + d < len(x)]
            at = at[run[at] == run[at + d]]
            if not len(at):
                break
            diff = x[at] ^ x[at + d]
            s, h = struck[at], half[at]
            bit = np.where(s < 32, s + np.where(h == 0, 32, 0), 0).astype(np.uint64)
            meant = (s == 32) | (((diff >> bit) & np.uint64(1)) == 1)
            hit = meant & (np.bitwise_count(diff) <= distance)
            us.append(x[at[hit]])
            vs.append(x[at[hit] + d])
        for r in np.flatnonzero(size > 64):
            a = first[r]
            u, v = _compare(x[a:a + size[r]], int(struck[a]), int(half[a]), distance)
            us.append(u)
            vs.append(v)
        u, v = forest(np.concatenate(us), np.concatenate(vs)) if us else (x[:0], x[:0])
        return pd.DataFrame({"u": u.view(np.int64), "v": v.view(np.int64)})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, x = np.zeros(0, np.int64), np.zeros(0, np.uint64)      # of the last key so far, which may go on
        for pdf in batches:
            key = np.concatenate([key, pdf["key"].to_numpy(np.int64)])
            x = np.concatenate([x, pdf["fp"].to_numpy(np.int64).view(np.uint64)])
            cut = np.searchsorted(key, key[-1]) if len(key) else 0
            if cut:
                yield links(key[:cut], x[:cut])
                key, x = key[cut:], x[cut:]
        if len(key):
            yield links(key, x)

    return run


def link(classes: DataFrame, distance: int = 3, meet: int = MEET) -> DataFrame:
    """Links ``(u, v)`` that connect exactly what pairs of distinct fingerprints at ``distance`` or fewer bits do."""
    if distance > 3:
        raise ValueError("two halves with one struck bit find at most 3 differing bits")
    return _keyed(classes, meet).repartition("key").sortWithinPartitions("key") \
        .mapInPandas(_link_sorted(distance), "u long, v long")


def cluster(tagged: DataFrame, key: str = "doc_id", distance: int = 3) -> DataFrame:
    """``(fp, component_id, ...)`` per distinct fingerprint: the smallest id of all rows in its component, and the
    first row to keep (``first_row``: smallest non-null id, then smallest row number) if ``tagged`` has ``__row``."""
    row = F.col("__row") if "__row" in tagged.columns else F.lit(0).cast("long")
    first = F.min(F.struct(F.col(key).isNull(), F.col(key), row)).alias("first")
    classes = cut_lineage(tagged.groupBy("fp").agg(first))
    found = components(link(classes.select("fp"), distance))
    named = classes.join(found, classes["fp"] == found["node"], "left") \
        .select("fp", "first", F.coalesce("component", "fp").alias("component"))
    smallest = named.groupBy("component").agg(F.min("first").alias("smallest"))
    return named.join(smallest, "component").select(
        "fp", F.col("smallest").getField(key).alias("component_id"),
        F.col("smallest").getField("__row" if "__row" in tagged.columns else "col3").alias("first_row"))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 3,
                    distance: int = 3) -> DataFrame:
    """One row per document: key, fingerprint (hex) and component."""
    tagged = cut_lineage(tag(docs.select(key, text), text, shingle, keep_text=False))
    return tagged.join(cluster(tagged, key, distance), "fp").select(
        key, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 3,
               distance: int = 3) -> DataFrame:
    """The rows of ``docs`` with all their columns, one of each component (the smallest id; of repeated rows one)."""
    tagged = cut_lineage(tag(docs.withColumn("__row", F.monotonically_increasing_id()), text, shingle))
    keep = cluster(tagged.select(key, "fp", "__row"), key, distance).select(F.col("first_row").alias("__row")).distinct()
    return tagged.join(keep, "__row", "left_semi").select(*docs.columns)
