"""Operator 5: near-duplicate documents by circulant MinHash, verified exactly.

A document's set is its distinct 5-word shingles (64-bit hashes). One permutation
scatters shingles over a circle of 2**64 places; a second one gives all signature
coordinates: coordinate k is the shingle that comes first in its order once the circle is
shifted by k * 2**44. It orders places by a table over their leading 20 bits, then by the
others, so a running minimum over table slices finds the leading bits of all coordinates,
and a look-up of each in the sorted shingles the rest. Coordinates are whole shingles: sets
of millions, which reach every entry of the table, share no more of them than their
similarity.

Signatures are cut into ``bands`` of ``rows``. Documents that share a band are
candidates. Unless ``bands`` is given there are as many as it takes for a pair at
the threshold to be missed with probability below 1e-6: at the default of 80 percent
35 bands of 5 rows, at 85 percent 24. Links are decided on full sets:

1. documents of equal word sequences are one class, with a number of its own;
2. in each bucket every member is compared with one pivot, the member that meets
   most others over all its buckets (no pairs within the bucket);
3. components of the links found leave most buckets with a single component;
4. in the others, members proven to have no link at all are peeled off: shingles
   that only one of the documents still in question holds cannot be common, so a
   document whose other shingles are fewer than the threshold share of its set has
   no link (repeated until few go);
5. the pairs of members of different components that are left (a pair in the first
   bucket they share, within the size bound and the pivot bound) are all compared.
   The pivot bound: what two sets have in common is at most the smaller of what
   either shares with the pivot, and the smaller of what either has besides that
   and not alone.

So no link between candidates is lost, large groups are compared with pivots and
not pairwise, and nothing of the corpus is collected. Buckets are aggregated before
they are shuffled; the pairs of a large bucket are dealt to several tasks, and the
other joins have a plain form that adaptive execution splits at hot keys.

Defined cases: null and empty texts (and texts without words) have an empty set and
are linked with nothing; fewer than five words make one shingle of the whole
sequence; rows, not ids, are what is compared: an id may stand at several texts,
and repeated rows are alike. A row with a null id takes part in links, but its own
component_id is null and kept true; dedup() decides on it as on any other row, null
ids coming last. An empty table gives no rows; columns besides id and text are not
read, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import connected_components
from .common import MAX_BROADCAST, dropped, near, picked, row_key, written

SHINGLE, ARCS = 5, 1 << 20
_MIX = np.uint64(0x9E3779B97F4A7C15)
KNOWN = 1 << 15  # word hashes that a task remembers
SLICE = 256  # rows of a batch that are worked on at a time
HOT = 512  # members of a bucket that one task compares with those outside the pivot's component
MISSED = 1e-6  # bound on the probability that a pair at the threshold shares no band


class Hashes:
    """Hashes of words, remembered up to a bound."""

    def __init__(self):
        self.known: dict[bytes, int] = {}

    def of(self, words: list[bytes]) -> np.ndarray:
        known, digest = self.known, xxhash.xxh64_intdigest
        if len(known) > KNOWN:
            known.clear()
        out = [known.get(w) for w in words]
        for k, v in enumerate(out):
            if v is None:
                out[k] = known[words[k]] = digest(words[k])
        return np.array(out, dtype=np.uint64)


def words_of(text: str | None) -> list[bytes]:
    """A-Z lower-cased; runs of anything but ASCII white space."""
    return (text or "").encode().lower().split()


def shingle_set(words: list[bytes], known: Hashes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles."""
    if not words:
        return np.empty(0, np.uint64)
    w = known.of(words)
    size = min(SHINGLE, len(w))
    n = len(w) - size + 1
    h = np.full(n, size, dtype=np.uint64)
    for k in range(size):
        h = (h ^ w[k : k + n]) * _MIX
        h ^= h >> np.uint64(29)
    return np.unique(h)


@lru_cache(2)
def circulant(count: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """The second permutation's table: row i holds its values at i, i + 1, ... around the circle (a view, not a copy); and its inverse."""
    table = np.random.RandomState(seed).permutation(ARCS).astype(np.int32)
    inverse = np.empty(ARCS, np.int64)
    inverse[table] = np.arange(ARCS)
    return np.lib.stride_tricks.sliding_window_view(np.concatenate([table, table[:count]]), count), inverse


def signature(shingles: np.ndarray, count: int, seed: int) -> np.ndarray:
    """For each of count shifts the place of the set's first shingle."""
    table, inverse = circulant(count, seed)
    places = np.sort(shingles * np.uint64(0xBF58476D1CE4E5B9))  # the first permutation
    arcs = (places >> np.uint64(44)).astype(np.int64)
    least = np.full(count, ARCS, dtype=np.int32)
    for lo in range(0, len(arcs), 512):
        np.minimum(least, table[arcs[lo : lo + 512]].min(axis=0), out=least)
    first = (inverse[least] - np.arange(count)) % ARCS  # the arc whose shifted value is the least
    return places[np.searchsorted(arcs, first)]  # its first place


def band_keys(sig: np.ndarray, bands: int, rows: int) -> list[int]:
    raw = sig.tobytes()
    step = 8 * rows
    return np.array([xxhash.xxh64_intdigest(raw[k * step : (k + 1) * step], seed=k + 1) for k in range(bands)], dtype=np.uint64).astype(np.int64).tolist()


def bands_for(percent: int, rows: int) -> int:
    """The fewest bands that miss a pair at the threshold with probability below MISSED."""
    share = (percent / 100) ** rows
    return math.floor(math.log(MISSED) / math.log1p(-share)) + 1 if share < 1 else 1


def signatures(docs: DataFrame, bands: int, rows: int, seed: int) -> DataFrame:
    """doc_id, row key, n_shingles, s1 and s2 (hash of the word sequence) and band keys of every row."""

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Hashes()
        for b in batches:
            for lo in range(0, b.num_rows, SLICE):
                part = b.slice(lo, SLICE)
                n, halves, keys = [], [], []
                for t in part.column("text").to_pylist():
                    words = words_of(t)
                    shingles = shingle_set(words, known)
                    halves.append(xxhash.xxh3_128_digest(b" ".join(words)))
                    n.append(len(shingles))
                    keys.append(band_keys(signature(shingles, bands * rows, seed), bands, rows) if len(shingles) else [])
                digests = np.frombuffer(b"".join(halves), "<i8").reshape(-1, 2)
                columns = [part.column(c) for c in ("doc_id", "k1", "k2")]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(n, pa.int64()), pa.array(digests[:, 0].copy()), pa.array(digests[:, 1].copy()), pa.array(keys, pa.list_(pa.int64()))], ["doc_id", "k1", "k2", "n_shingles", "s1", "s2", "keys"])

    return docs.mapInArrow(signed, "doc_id long, k1 long, k2 long, n_shingles long, s1 long, s2 long, keys array<long>")


def sets_of(texts: DataFrame) -> DataFrame:
    """id and the full shingle set of its text, once for each id of a task."""

    def full(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, seen = Hashes(), set()
        for b in batches:
            for lo in range(0, b.num_rows, SLICE):
                ids, got = [], []
                for i, t in zip(b.column("id").slice(lo, SLICE).to_pylist(), b.column("text").slice(lo, SLICE).to_pylist(), strict=True):
                    if i not in seen:
                        if len(seen) < KNOWN:
                            seen.add(i)
                        ids.append(i)
                        got.append(shingle_set(words_of(t), known).view(np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(got, pa.list_(pa.int64()))], ["id", "members"])

    return texts.mapInArrow(full, "id long, members array<long>")


def compared(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """pairs (a, b, ...) with common, the exact size of their intersection, and total, that of their union."""
    left = sets.select(F.col("id").alias("a"), F.col("members").alias("of_a"))
    right = sets.select(F.col("id").alias("b"), F.col("members").alias("of_b"))
    common = F.size(F.array_intersect("of_a", "of_b"))
    both = pairs.join(left, "a").join(right, "b")
    return both.select(*pairs.columns, common.cast("long").alias("common"), (F.size("of_a") + F.size("of_b") - common).cast("long").alias("total"))


def groups(df: DataFrame, *, id_col="doc_id", text_col="text", percent=80, bands=None, rows=5, seed=1, max_broadcast=MAX_BROADCAST, peelings=3) -> DataFrame:
    """doc_id, row key (k1, k2), n_shingles, component_id, and stays (whether the row is the first of its group, null ids last) for each row of df."""
    bands = bands or bands_for(percent, rows)
    docs = picked(df, doc_id=id_col, text=text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    k1, k2 = row_key(F.col("doc_id"), F.col("text"))
    docs = docs.select("doc_id", "text", k1.alias("k1"), k2.alias("k2"))
    signed = written(signatures(docs, bands, rows, seed), "signatures")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "k1", "k2"))
    classes = signed.where("n_shingles > 0").groupBy("s1", "s2").agg(first.alias("first"), F.first("n_shingles").alias("n"), F.first("keys").alias("keys"))
    classes = written(classes.select(F.monotonically_increasing_id().alias("id"), "s1", "s2", "first", "n", "keys"), "classes")  # numbered once: the table is what is read
    similar = (100 * F.col("common") >= percent * F.col("total"))
    fits = lambda a, b: 100 * F.least(F.col(a), F.col(b)) >= percent * F.greatest(F.col(a), F.col(b))

    # Buckets of two classes or more. Keys are counted first (partial sums), so the rows that are kept are few.
    entries = classes.select(F.explode("keys").alias("key"), "id", "n")
    full = entries.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    members = written(entries.join(full, "key"), "members")
    ids = written(members.groupBy("id").agg(F.sum("size").alias("meets")), "ids")
    asked = written(classes.join(ids, "id", "left_semi").select("id", F.col("first.k1").alias("k1"), F.col("first.k2").alias("k2")), "asked")
    sets = written(sets_of(docs.join(near(asked, 24, max_broadcast), ["k1", "k2"]).select("id", "text")), "sets")
    if sets.count() > asked.count():  # the same row may stand in several files
        once = written(sets.dropDuplicates(["id"]), "sets")
        dropped(sets)
        sets = once

    # Stars around pivots
    popular = members.join(ids, "id").groupBy("key").agg(F.max(F.struct("meets", (-F.col("id")).alias("last"), F.col("n").alias("pivot_n"))).alias("p"))
    pivots = written(popular.select("key", (-F.col("p.last")).alias("pivot"), "p.pivot_n"), "pivots")
    star = members.join(pivots, "key").where("id != pivot").where(fits("n", "pivot_n")).select(F.col("id").alias("a"), F.col("pivot").alias("b")).distinct()
    stars = written(compared(star, sets), "stars")
    links = stars.where(similar).select("a", "b")
    parts = connected_components(links)

    # Buckets that still hold several components
    placed = members.join(parts, "id", "left").select("key", "id", "n", F.coalesce("component", "id").alias("component"))
    placed = written(placed.select("key", "id", "n", "component"), "placed")
    mixed = placed.groupBy("key").agg((F.min("component") != F.max("component")).alias("mixed")).where("mixed").select("key")
    open_ = written(placed.join(mixed, "key", "left_semi"), "open")
    dropped(members, ids, asked, placed)
    lone = None
    for _ in range(max(peelings, 1)):
        dropped(lone)
        asked = open_.select("id").unionAll(open_.join(pivots, "key").select(F.col("pivot").alias("id"))).distinct()
        tokens = sets.join(asked, "id", "left_semi").select("id", F.explode("members").alias("token"))
        single = tokens.groupBy("token").agg(F.count("*").alias("c"), F.first("id").alias("only")).where("c = 1")
        lone = written(single.groupBy(F.col("only").alias("id")).agg(F.count("*").alias("lone")), "lone")
        gone = open_.select("id", "n").distinct().join(lone, "id").where(100 * (F.col("n") - F.col("lone")) < percent * F.col("n")).select("id")
        gone = written(gone, "gone")
        if gone.isEmpty():
            dropped(gone)
            break
        rest = open_.join(gone, "id", "left_anti")
        mixed = rest.groupBy("key").agg((F.min("component") != F.max("component")).alias("mixed")).where("mixed").select("key")
        rest = written(rest.join(mixed, "key", "left_semi"), "open")
        dropped(open_, gone)
        open_ = rest

    # What is left: members outside the pivot's component against the bucket's members of other components
    toward = stars.select(F.col("a").alias("id"), F.col("b").alias("pivot"), "common")
    known = open_.join(pivots.select("key", "pivot"), "key").join(toward, ["id", "pivot"], "left").join(lone, "id", "left").join(classes.select("id", "keys"), "id")
    with_pivot = F.when(F.col("id") == F.col("pivot"), F.col("n")).otherwise(F.col("common"))
    known = known.select("key", "id", "n", "component", "pivot", with_pivot.alias("inside"), (F.col("n") - with_pivot - F.coalesce("lone", F.lit(0))).alias("beside"), "keys")
    known = written(known, "known")
    deals = known.groupBy("key").agg(F.max(F.when(F.col("id") == F.col("pivot"), F.col("component"))).alias("main"), F.ceil(F.count("*") / HOT).cast("int").alias("deals"))
    deals = written(deals, "deals")
    dealt = known.join(near(deals, 20, max_broadcast), "key")
    outside = dealt.where("main IS NULL OR component != main").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("deals") - 1)))
    outside = outside.select(*[F.col(c).alias(f"{c}_2") for c in (*known.columns, "salt")])
    dealt = dealt.withColumn("salt", F.pmod(F.xxhash64("id"), "deals").cast("int"))
    most = F.least("inside", "inside_2") + F.least("beside", "beside_2")
    possible = F.when(F.col("inside").isNull() | F.col("inside_2").isNull(), True).otherwise(100 * most >= percent * (F.col("n") + F.col("n_2") - most))
    pairs = dealt.join(outside, (F.col("key") == F.col("key_2")) & (F.col("salt") == F.col("salt_2"))).where((F.col("component") != F.col("component_2")) & fits("n", "n_2") & possible & (F.element_at(F.array_intersect("keys", "keys_2"), 1) == F.col("key")))
    pairs = pairs.select(F.least("id", "id_2").alias("a"), F.greatest("id", "id_2").alias("b")).distinct()
    more = written(compared(pairs, sets).where(similar).select("a", "b"), "links")
    if not more.isEmpty():
        dropped(parts)
        parts = connected_components(links.unionAll(more))
    dropped(sets, open_, lone, known, deals, pivots, stars, more)

    # Back to all rows: class, first row of its component
    linked = classes.select("id", "s1", "s2", "first").join(parts, "id")
    firsts = linked.groupBy("component").agg(F.min("first").alias("c"))
    whole = linked.join(firsts, "component").select("s1", "s2", "c").unionAll(classes.join(parts, "id", "left_anti").select("s1", "s2", F.col("first").alias("c")))
    out = signed.where("n_shingles > 0").join(whole, ["s1", "s2"])
    stays = (F.col("k1") == F.col("c.k1")) & (F.col("k2") == F.col("c.k2"))
    out = out.select("doc_id", "k1", "k2", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("c.doc_id")).alias("component_id"), stays.alias("stays"))
    out = out.unionAll(signed.where("n_shingles = 0").select("doc_id", "k1", "k2", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(True).alias("stays")))
    out = written(out, "groups")
    dropped(signed, classes, parts)
    return out


def near_duplicates(df: DataFrame, **options) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest id of the group), and kept (doc_id = component_id) for each row of df; options as of groups()."""
    out = groups(df, **options)
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def dedup(df: DataFrame, *, id_col="doc_id", text_col="text", max_broadcast=MAX_BROADCAST, **options) -> DataFrame:
    """Of each group of near duplicates of df its first row, all columns kept; rows without words stay."""
    out = groups(df, id_col=id_col, text_col=text_col, max_broadcast=max_broadcast, **options)
    k1, k2 = row_key(df[f"`{id_col}`"], df[f"`{text_col}`"])
    among = lambda keys, how: df.join(near(keys, 16, max_broadcast), (k1 == keys["k1"]) & (k2 == keys["k2"]), how)
    gone = written(out.where("NOT stays").select("k1", "k2").distinct(), "copies")
    again = written(out.where("stays AND n_shingles > 0").groupBy("k1", "k2").agg(F.count("*").alias("n")).where("n > 1").select("k1", "k2"), "repeats")
    dropped(out)
    if again.isEmpty():
        return among(gone, "left_anti")
    return among(written(gone.unionAll(again), "gone"), "left_anti").unionAll(among(again, "left_semi").dropDuplicates([id_col, text_col]))
