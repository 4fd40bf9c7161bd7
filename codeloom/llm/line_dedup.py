"""Operator 6: line deduplication by a segment-partition edit join.

Two lines within ``edits`` edits of one another share, of the edits + 1 segments
into which the shorter is cut, at least one, at a place that the lengths bound.
So each distinct line is indexed under (its length, segment number, segment) and
probes, for every length from its own down to ``edits`` less, only those of its
substrings that can be such a segment (the multi-match window: the edits on the
left of segment i are fewer than i, those on its right at most edits + 1 - i).

1. one pass hashes every line (128 bits) and makes its index and probe keys, which
   are written; keys under which fewer than two different lines stand are dropped
   after a partial aggregation;
2. the live keys are joined; a pair must also agree in its character histogram up to
   two counts for each edit (a necessary condition, checked inside the join). Keys
   that many different lines share are dealt to several tasks: the lines indexed
   there by a salt, the probing ones to each of them;
3. pairs are verified by a bit-parallel edit distance in a band of 2 * edits + 1 bits;
4. links make classes (connected components); the earliest line of a class stays,
   and the others are duplicates.

Identical lines are one line in steps 1 to 3, however often they occur, so a line
that a third of all documents hold costs no more than any other. Lines of fewer
than ``min_words`` words are no evidence of copying: they are left alone.

A line's place is its row (id, then 128 bits of the text: ids may repeat) and its
number; the earliest line is the one of the smallest place, null ids coming last.

Defined cases: null and empty texts have no lines; blank lines are left alone;
very long lines are treated like others; rows that repeat an id with another text
are rows of their own; rows that repeat id and text are one row and keep or lose
their lines together; a null id comes after all others; an empty table gives no
rows; columns besides id and text are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import connected_components
from .common import MAX_BROADCAST, dropped, near, picked, row_key, written

_SPACE = " \t\n\x0b\x0c\r"


def segments(length: int, edits: int) -> list[tuple[int, int]]:
    """(start, length) of the edits + 1 segments of a line of that length; the last ones are longer by one."""
    count = edits + 1
    short, extra = divmod(length, count)
    out, at = [], 0
    for k in range(count):
        size = short + (k >= count - extra)
        out.append((at, size))
        at += size
    return out


@lru_cache(1 << 13)
def index_places(length: int, edits: int) -> list[tuple[int, int, int]]:
    """(seed, start, end) of each segment; the seed tells line length and segment number."""
    return [(length * 16 + i + 1, s, s + n) for i, (s, n) in enumerate(segments(length, edits))]


@lru_cache(1 << 13)
def probe_places(length: int, edits: int) -> list[tuple[int, int, int]]:
    """The same for the substrings that may equal a segment of a line shorter by 0 to edits."""
    out = []
    for other in range(max(length - edits, edits + 1), length + 1):
        gap = length - other
        for i, (start, size) in enumerate(segments(other, edits)):
            low = max(0, start - i, start + gap - (edits - i))
            high = min(length - size, start + i, start + gap + (edits - i))
            out += [(other * 16 + i + 1, at, at + size) for at in range(low, high + 1)]
    return out


def _keys(line: str, places: list[tuple[int, int, int]]) -> list[int]:
    digest = xxhash.xxh64_intdigest
    return [digest(line[s:e], seed) for seed, s, e in places]


def index_keys(line: str, edits: int) -> list[int]:
    return _keys(line, index_places(len(line), edits))


def probe_keys(line: str, edits: int) -> list[int]:
    return list(dict.fromkeys(_keys(line, probe_places(len(line), edits))))


def histogram(line: str) -> list[int]:
    """Counts of the line's code points in 16 classes; an edit changes at most two counts, by one each."""
    b = np.frombuffer(line.encode("utf-32-le"), np.uint32)
    return np.bincount((b * np.uint32(2654435761)) >> np.uint32(28), minlength=16).tolist()


def within(a: str, b: str, edits: int) -> bool:
    """Whether the edit distance is at most edits: a bit-parallel automaton in a band of 2 * edits + 1 diagonals."""
    if abs(len(a) - len(b)) > edits:
        return False
    lo, top = 0, min(len(a), len(b))
    while lo < top and a[lo] == b[lo]:
        lo += 1
    a, b, top = a[lo:], b[lo:], top - lo
    hi = 0
    while hi < top and a[-1 - hi] == b[-1 - hi]:
        hi += 1
    a, b = a[: len(a) - hi], b[: len(b) - hi]
    m, n = len(a), len(b)
    if max(m, n) <= edits:
        return True
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    band = (1 << (2 * edits + 1)) - 1
    rows = (1 << (m + 1)) - 1
    shift = lambda bits, j: (bits >> (j - edits) if j >= edits else bits << (edits - j)) & band  # noqa: E731  bit d stands for row j - edits + d
    reach = [0] * (edits + 1)
    for e in range(edits + 1):
        reach[e] = shift((1 << (e + 1)) - 1 & rows, 0)
    for j, c in enumerate(b):
        match, valid = shift(where.get(c, 0), j), shift(rows, j + 1)
        new: list[int] = []
        for e in range(edits + 1):
            bits = reach[e] & match
            if e:
                bits |= reach[e - 1] | reach[e - 1] >> 1 | new[e - 1] << 1
            new.append(bits & valid)
        reach = new
        if not reach[-1]:
            return False
    return bool(reach[edits] >> (m - n + edits) & 1)


def _lines(text: str | None, min_words: int) -> list[tuple[int, str]]:
    return [(k, s) for k, line in enumerate((text or "").split("\n")) if len((s := line.strip(_SPACE)).split(None, min_words - 1)) >= min_words]


SEEN = 1 << 16  # lines that a task remembers in order not to make their keys again
SLICE = 256  # rows of a batch that are worked on at a time
HOT = 512  # different lines that one task takes of those indexed under a key


def lines_of(docs: DataFrame, min_words: int, edits: int) -> DataFrame:
    """doc_id, row key, line_no, hash of the line, its length, and index and probe keys, for each line of enough words; keys only for the first of equal lines of a task."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b in batches:
            for lo in range(0, b.num_rows, SLICE):
                part = b.slice(lo, SLICE)
                at, number, length, own, asked = [], [], [], [], []
                digests: list[bytes] = []
                for row, t in enumerate(part.column("text").to_pylist()):
                    for k, s in _lines(t, min_words):
                        digest = xxhash.xxh3_128_digest(s)
                        mark = int.from_bytes(digest, "little")
                        new = len(s) > edits and mark not in seen
                        if new and len(seen) < SEEN:
                            seen.add(mark)
                        at.append(row)
                        number.append(k)
                        digests.append(digest)
                        length.append(len(s))
                        own.append(index_keys(s, edits) if new else [])
                        asked.append(probe_keys(s, edits) if new else [])
                halves = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
                of_row = [part.column(c).take(pa.array(at, pa.int64())) for c in ("doc_id", "k1", "k2")]
                columns = [*of_row, pa.array(number, pa.int32()), pa.array(halves[:, 0].copy()), pa.array(halves[:, 1].copy()), pa.array(length, pa.int32()), _longs(own), _longs(asked)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "k1", "k2", "line_no", "h1", "h2", "length", "own", "asked"])

    return docs.mapInArrow(hashed, "doc_id long, k1 long, k2 long, line_no int, h1 long, h2 long, length int, own array<long>, asked array<long>")


def _longs(keys: list[list[int]]) -> pa.Array:
    """Lists of unsigned 64-bit keys as lists of longs."""
    ends = np.cumsum([0, *map(len, keys)], dtype=np.int32)
    flat = np.fromiter(chain.from_iterable(keys), dtype=np.uint64, count=int(ends[-1]))
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.view(np.int64)))


def texts(docs: DataFrame, min_words: int) -> DataFrame:
    """Hash and text of every line of enough words, once for each task as far as it remembers."""

    def spelt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for b in batches:
            for lo in range(0, b.num_rows, SLICE):
                lines, digests = [], []
                for t in b.column("text").slice(lo, SLICE).to_pylist():
                    for _, s in _lines(t, min_words):
                        if (d := xxhash.xxh3_128_digest(s)) not in seen:
                            if len(seen) < SEEN:
                                seen.add(d)
                            lines.append(s)
                            digests.append(d)
                halves = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([pa.array(halves[:, 0].copy()), pa.array(halves[:, 1].copy()), pa.array(lines, pa.string())], ["h1", "h2", "spelt"])

    return docs.mapInArrow(spelt, "h1 long, h2 long, spelt string")


def with_histogram(lines: DataFrame) -> DataFrame:
    """line, spelt and the histogram of spelt."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bags = [histogram(s) for s in b.column("spelt").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("line"), b.column("spelt"), pa.array(bags, pa.list_(pa.int32()))], ["line", "spelt", "bag"])

    return lines.select("line", "spelt").mapInArrow(counted, "line long, spelt string, bag array<int>")


def links(docs: DataFrame, lines: DataFrame, *, edits: int, min_words: int, max_broadcast: int) -> tuple[DataFrame, DataFrame]:
    """Verified pairs (a, b) of different lines within the edit distance, and the lines (line, h1, h2) that a and b number; lines as of lines_of()."""
    every = lines.select(F.explode(F.concat("own", "asked")).alias("key"), "h1", "h2")
    live = every.groupBy("key").agg(*[f(h).alias(f"{f.__name__}_{h}") for h in ("h1", "h2") for f in (F.min, F.max)])  # in longs: it stays a hash aggregate
    live = written(live.where("min_h1 != max_h1 OR min_h2 != max_h2").select("key"), "keys")
    index = F.transform("own", lambda k: F.struct(k.alias("key"), F.lit(False).alias("probe")))
    probes = F.transform("asked", lambda k: F.struct(k.alias("key"), F.lit(True).alias("probe")))
    marked = lines.select("h1", "h2", "length", F.inline(F.concat(index, probes)))
    kept = written(marked.join(near(live, 8, max_broadcast), "key", "left_semi").groupBy("key", "h1", "h2", "probe").agg(F.max("length").alias("length")), "entries")
    some = written(kept.select("h1", "h2").distinct().select(F.monotonically_increasing_id().alias("line"), "h1", "h2"), "ends")  # numbered once: the table is what is read
    spelt = texts(docs, min_words).join(near(some, 24, max_broadcast), ["h1", "h2"]).select("line", "spelt").dropDuplicates(["line"])
    spelt = written(with_histogram(spelt), "texts")
    numbered = kept.join(some, ["h1", "h2"]).select("key", "line", "probe", "length").join(spelt.select("line", "bag"), "line")
    sizes = kept.where("NOT probe").groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > HOT)
    hot = written(sizes.select("key", F.ceil(F.col("n") / HOT).cast("int").alias("deals")), "hot-keys")
    numbered = numbered.join(near(hot, 12, max_broadcast), "key", "left").withColumn("deals", F.coalesce("deals", F.lit(1)))
    own = numbered.where("NOT probe").select("key", F.pmod(F.xxhash64("line"), "deals").cast("int").alias("salt"), F.col("line").alias("a"), F.col("length").alias("n"), F.col("bag").alias("of_a"))
    asked = numbered.where("probe").select("key", F.explode(F.sequence(F.lit(0), F.col("deals") - 1)).alias("salt"), F.col("line").alias("b"), F.col("length").alias("m"), F.col("bag").alias("of_b"))
    apart = F.aggregate(F.zip_with("of_a", "of_b", lambda x, y: F.abs(x - y)), F.lit(0), lambda s, x: s + x)
    pairs = own.join(asked, ["key", "salt"]).where((F.col("a") != F.col("b")) & (apart <= 2 * edits) & ((F.col("m") > F.col("n")) | (F.col("a") < F.col("b"))))
    pairs = written(pairs.select("a", "b").distinct(), "pairs")
    dropped(live, kept, hot)
    both = pairs.join(spelt.select(F.col("line").alias("a"), F.col("spelt").alias("of_a")), "a").join(spelt.select(F.col("line").alias("b"), F.col("spelt").alias("of_b")), "b")

    def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            d = b.to_pydict()
            keep = [within(x, y, edits) for x, y in zip(d["of_a"], d["of_b"], strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    found = written(both.select("a", "b", "of_a", "of_b").mapInArrow(verified, "a long, b long"), "links")
    dropped(pairs, spelt)
    return found, some


_PLACE = ["doc_id", "k1", "k2", "line_no"]


def placed_classes(docs: DataFrame, *, edits: int, min_words: int, max_broadcast: int) -> DataFrame:
    """For each line of enough words its place, the place c of its class's earliest line, and n_links (other lines within the distance); docs as of keyed()."""
    at = written(lines_of(docs, min_words, edits), "lines")
    pairs, ends = links(docs, at, edits=edits, min_words=min_words, max_broadcast=max_broadcast)
    first = at.groupBy("h1", "h2").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), *_PLACE)).alias("first"))
    parts = connected_components(pairs)
    degree = pairs.unionAll(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).groupBy(F.col("a").alias("line")).agg(F.countDistinct("b").alias("n_links"))
    info = parts.withColumnRenamed("id", "line").join(degree, "line").join(ends, "line").select("h1", "h2", "component", "n_links")
    lines = written(first.join(info, ["h1", "h2"], "left"), "line-classes")
    linked = lines.where("component IS NOT NULL")  # apart from the others: joined by a null component, all those would meet in one task
    firsts = linked.groupBy("component").agg(F.min("first").alias("class_first"))
    classes = linked.join(firsts, "component").select("h1", "h2", F.col("class_first").alias("c"), "n_links")
    classes = classes.unionAll(lines.where("component IS NULL").select("h1", "h2", F.col("first").alias("c"), F.lit(0).cast("long")))
    out = written(at.join(classes, ["h1", "h2"]).select(*_PLACE, "c", "n_links"), "placed")
    dropped(at, pairs, ends, parts, lines)
    return out


def _first() -> F.Column:
    """Whether a line is the earliest of its class."""
    same = F.lit(True)
    for c in _PLACE:
        same = same & F.col(c).eqNullSafe(F.col(f"c.{c}"))
    return same


def keyed(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, text and row key."""
    docs = picked(df, doc_id=id_col, text=text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    k1, k2 = row_key(F.col("doc_id"), F.col("text"))
    return docs.select("doc_id", "text", k1.alias("k1"), k2.alias("k2"))


def line_classes(df: DataFrame, *, id_col="doc_id", text_col="text", edits=2, min_words=5, max_broadcast=MAX_BROADCAST) -> DataFrame:
    """doc_id, line_no, class_doc and class_line (the class's earliest line), n_links (other lines within the distance) and kept, for each line of enough words."""
    out = placed_classes(keyed(df, id_col, text_col), edits=edits, min_words=min_words, max_broadcast=max_broadcast)
    return out.select("doc_id", "line_no", F.col("c.doc_id").alias("class_doc"), F.col("c.line_no").alias("class_line"), "n_links", _first().alias("kept"))


def dedup_lines(df: DataFrame, *, id_col="doc_id", text_col="text", edits=2, min_words=5, max_broadcast=MAX_BROADCAST) -> DataFrame:
    """df without its duplicate lines, all columns kept; a document all of whose words stood in duplicate lines goes."""
    places = placed_classes(keyed(df, id_col, text_col), edits=edits, min_words=min_words, max_broadcast=max_broadcast)
    gone = places.where(~_first()).groupBy("k1", "k2").agg(F.collect_set("line_no").alias("lines"))  # line numbers of one document
    gone = written(gone, "duplicate-lines")
    dropped(places)
    text = df[f"`{text_col}`"]
    k1, k2 = row_key(df[f"`{id_col}`"], text)
    few = near(gone, F.size("lines") * 4 + 32, max_broadcast)
    joined = df.join(few, (k1 == few["k1"]) & (k2 == few["k2"]), "left")
    left = lambda lines: F.transform(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), few["lines"]), lambda k: lines[k])  # noqa: E731  by hash set, in order
    rest = F.array_join(F.transform(F.array(F.split(text, "\n")), left)[0], "\n")
    cut = few["k1"].isNotNull()
    out = joined.where(~cut | rest.rlike(r"[^\x20\x09-\x0D]"))
    return out.select(*[F.when(cut, rest).otherwise(text).alias(c) if c == text_col else df[f"`{c}`"] for c in df.columns])
