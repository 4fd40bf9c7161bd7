"""Operator 12: target-distribution importance resampling by hashed word runs.

A text's features are all runs of 1 to ``n`` consecutive words; a feature's bucket is the
crc32 of its UTF-8 bytes, modulo ``buckets``. One scan of a document keeps a ring of
running zlib states, one for each of the last n starts: a new word extends each of them by
a space and itself and opens a state of its own, so no run is ever joined to a string. The
scan emits a document's bucket counts, packed, into a written table; texts are read once.

1. Bucket counts of the target and of all documents are summed within tasks, then over
   tasks; ``buckets`` rows reach the driver, however large the corpus is.
2. A bucket's gain is floor(1000 * ln of its smoothed share in the target over that in the
   documents); a document's weight is the sum of gains over its features.
3. Its score is weight + floor(1000 * Gumbel noise), the noise from a hash of seed and id,
   so the highest scores are a draw without replacement by importance.
4. Of the N documents with ``min_words`` words or more the floor(percent * N / 100) highest
   are drawn, ties to the smaller id. Ranks need no single sorting task: approximate
   quantiles cut the scores into ranges, whose exact counts give each range's first rank;
   ranges are ordered on their own. Equal rows are counted before they are ordered, so rows
   that repeat without end are one row of a range.

Defined cases: null and empty texts have no words and no features, weight 0 and their noise
as score; very long texts are scanned in chunks of words; a null id takes the noise of the
empty id, and comes last among equal scores; repeated rows are drawn one by one, each with
a rank of its own; empty documents give no rows; an empty target gives every bucket the
count 0; columns besides id and text are not read, whatever their names.
"""

from __future__ import annotations

import math
import re
from collections import deque
from collections.abc import Iterable, Iterator
from itertools import islice
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import MAX_BROADCAST, dropped, near, picked, row_key, written

_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")  # of UTF-8 bytes: those of code points from U+0080 on all belong to words
CHUNK = 1 << 16  # words whose codes are held at a time
SLICE = 256  # rows of a batch that are worked on at a time
RANGE_ROWS, MAX_RANGES = 2000, 512  # rows that a range of scores is meant to have, and the most ranges


def run_codes(words: Iterable[bytes], n: int) -> Iterator[int]:
    """crc32 of every run of 1 to n consecutive words, joined by single spaces."""
    if n == 1:
        yield from map(crc32, words)
        return
    ring: deque[int] = deque()
    for word in words:
        if len(ring) == n:
            ring.popleft()
        more = b" " + word
        for k, state in enumerate(ring):
            ring[k] = crc32(more, state)
        ring.append(crc32(word))
        yield from ring


def bucket_counts(raw: bytes | None, n: int, buckets: int) -> tuple[int, np.ndarray]:
    """Number of words of a text (UTF-8) and the counts of its features by bucket."""
    seen, counts = 0, np.zeros(buckets, np.int64)

    def words() -> Iterator[bytes]:
        nonlocal seen
        for m in _WORD.finditer((raw or b"").lower()):  # lower() of bytes changes A-Z only
            seen += 1
            yield m[0]

    codes = run_codes(words(), n)
    while len(chunk := np.fromiter(islice(codes, CHUNK), np.uint32)):
        counts += np.bincount(chunk % np.uint32(buckets), minlength=buckets)
    return seen, counts


def scan(df: DataFrame, *, id_col="doc_id", text_col="text", n=1, buckets=10000) -> DataFrame:
    """doc_id, row key (k1, k2), n_words, n_features and packed bucket counts (places, then counts, 4 bytes each) of every row."""

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, SLICE):
                part = b.slice(lo, SLICE)
                words, features, packed = [], [], []
                for raw in part.column("text").cast(pa.binary()).to_pylist():
                    seen, counts = bucket_counts(raw, n, buckets)
                    places = counts.nonzero()[0]
                    words.append(seen)
                    features.append(int(counts.sum()))
                    packed.append(places.astype("<u4").tobytes() + counts[places].astype("<u4").tobytes())
                columns = [part.column(c) for c in ("doc_id", "k1", "k2")]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(words, pa.int64()), pa.array(features, pa.int64()), pa.array(packed, pa.binary())], ["doc_id", "k1", "k2", "n_words", "n_features", "packed"])

    docs = picked(df, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    k1, k2 = row_key(F.col("doc_id"), F.col("text"))
    return docs.select("doc_id", "text", k1.alias("k1"), k2.alias("k2")).mapInArrow(scanned, "doc_id long, k1 long, k2 long, n_words long, n_features long, packed binary")


def _unpacked(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places and counts of all rows, one after the other, and how many each row has."""
    rows = [np.frombuffer(v, "<u4").reshape(2, -1) for v in column.to_pylist()]
    both = np.concatenate(rows, axis=1) if rows else np.empty((2, 0), np.uint32)
    return both[0].astype(np.int64), both[1].astype(np.int64), np.array([r.shape[1] for r in rows], np.int64)


def totals(scanned: DataFrame, buckets: int) -> np.ndarray:
    """Features in each bucket over all rows: summed within tasks, then over them; buckets rows reach the driver."""

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for b in batches:
            for lo in range(0, b.num_rows, SLICE):
                places, counts, _ = _unpacked(b.column("packed").slice(lo, SLICE))
                total += np.bincount(places, weights=counts, minlength=buckets).astype(np.int64)
        some = total.nonzero()[0]
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], ["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for r in scanned.select("packed").mapInArrow(summed, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(target: np.ndarray, source: np.ndarray) -> np.ndarray:
    """floor(1000 * ln((t + 1) * (S + buckets) / ((s + 1) * (T + buckets)))) for each bucket."""
    t, s, size = target.astype(float), source.astype(float), len(target)
    share = (t + 1) * (s.sum() + size) / ((s + 1) * (t.sum() + size))
    return np.array([math.floor(1000 * math.log(x)) for x in share], np.int64)


def scored(documents: DataFrame, target: DataFrame, *, id_col="doc_id", text_col="text", target_text="text", n=1, buckets=10000, seed=2024) -> DataFrame:
    """doc_id, row key, n_words, n_features, weight and score of every row of documents, as a written table."""
    if n < 1 or not 1 <= buckets <= 1 << 20:
        raise ValueError("n must be 1 or more, buckets between 1 and 2**20")
    scanned = written(scan(documents, id_col=id_col, text_col=text_col, n=n, buckets=buckets), "buckets")
    wanted = scan(picked(target, text=target_text).withColumn("doc_id", F.lit(None).cast("long")), n=n, buckets=buckets)
    gain = gains(totals(wanted, buckets), totals(scanned, buckets))

    def weighed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, SLICE):
                part = b.slice(lo, SLICE)
                places, counts, sizes = _unpacked(part.column("packed"))
                ends = np.concatenate([[0], np.cumsum(gain[places] * counts)])[np.concatenate([[0], np.cumsum(sizes)])]
                columns = [part.column(c) for c in ("doc_id", "k1", "k2", "n_words", "n_features")]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(np.diff(ends))], ["doc_id", "k1", "k2", "n_words", "n_features", "weight"])

    out = scanned.mapInArrow(weighed, "doc_id long, k1 long, k2 long, n_words long, n_features long, weight long")
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    uniform = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") + 0.5) / 4294967296.0
    out = written(out.withColumn("score", F.col("weight") + F.floor(-1000 * F.log(-F.log(uniform))).cast("long")), "scored")
    dropped(scanned)
    return out


def draw(rows: DataFrame, *, min_words=20, percent=10) -> tuple[DataFrame, DataFrame]:
    """Of a table of scored(): its drawn rows, equal ones as one (with n, how many there are, ahead, how many rows rank before, and drawn, how many of the n are drawn), and the rest, row by row."""
    able = F.col("n_words") >= min_words
    take = percent * rows.where(able).count() // 100
    none = F.array().cast("array<long>")
    cuts: list[int] = []
    if take:
        ranges = min(max(take // RANGE_ROWS, 1), MAX_RANGES)
        low = max(1 - 1.5 * percent / 100, 0)
        at = [low + (1 - low) * k / (ranges + 1) for k in range(1, ranges + 1)]
        found = rows.where(able).agg(F.percentile_approx("score", F.array(*[F.lit(p) for p in at]), F.lit(20 * MAX_RANGES))).first()[0]
        cuts = sorted(set(found))
    places = F.array(*[F.lit(c).cast("long") for c in cuts]) if cuts else none
    ranged = rows.withColumn("range", F.when(able, F.size(F.filter(places, lambda c: c > F.col("score")))))  # 0: the highest scores
    counts = {r["range"]: r["n"] for r in ranged.where(able).groupBy("range").agg(F.count("*").alias("n")).collect()}  # at most MAX_RANGES + 1 rows
    first, before = {}, 0
    for k in sorted(counts):
        if before < take:
            first[k] = before
        before += counts[k]
    inside = F.coalesce(F.col("range").isin(list(first)), F.lit(False)) if first else F.lit(False)
    keys = ["doc_id", "k1", "k2", "n_words", "n_features", "weight", "score"]
    once = ranged.where(inside).groupBy("range", *keys).agg(F.count("*").alias("n"))
    order = Window.partitionBy("range").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"), "k1", "k2")
    start = F.element_at(F.create_map(*[F.lit(x).cast("long") for kv in first.items() for x in kv]), F.col("range").cast("long")) if first else F.lit(0).cast("long")
    ahead = start + F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
    once = once.withColumn("ahead", ahead).withColumn("drawn", F.greatest(F.least(F.col("n"), F.lit(take) - F.col("ahead")), F.lit(0)))
    return once.select(*keys, "n", "ahead", "drawn"), ranged.where(~inside).select(*keys)


def ranked(documents: DataFrame, target: DataFrame, *, min_words=20, percent=10, **options) -> DataFrame:
    """doc_id, n_features, weight, score and rank (null: not drawn) for each row of documents."""
    drawn, rest = draw(scored(documents, target, **options), min_words=min_words, percent=percent)
    columns = ["doc_id", "n_features", "weight", "score"]
    drawn = drawn.select(*columns, "ahead", "drawn", F.explode(F.sequence(F.lit(1).cast("long"), "n")).alias("copy"))
    drawn = drawn.select(*columns, F.when(F.col("copy") <= F.col("drawn"), F.col("ahead") + F.col("copy")).alias("rank"))
    return drawn.unionAll(rest.select(*columns, F.lit(None).cast("long").alias("rank")))


def resample(documents: DataFrame, target: DataFrame, *, id_col="doc_id", text_col="text", min_words=20, percent=10, max_broadcast=MAX_BROADCAST, **options) -> DataFrame:
    """The drawn rows of documents, all columns kept. Rows of equal id and text are alike; of the one such group that the draw may cut, any are kept."""
    drawn, _ = draw(scored(documents, target, id_col=id_col, text_col=text_col, **options), min_words=min_words, percent=percent)
    drawn = written(drawn.where("drawn > 0").select("k1", "k2", "n", "drawn"), "drawn")
    k1, k2 = row_key(documents[f"`{id_col}`"].cast("long"), documents[f"`{text_col}`"].cast("string"))
    among = lambda keys: documents.join(near(keys, 16, max_broadcast), (k1 == keys["k1"]) & (k2 == keys["k2"]), "left_semi")
    out = among(drawn.where("drawn = n").select("k1", "k2"))
    for cut in drawn.where("drawn < n").collect():  # none or one
        out = out.unionAll(documents.where((k1 == cut["k1"]) & (k2 == cut["k2"])).limit(cut["drawn"]))
    return out


def oracle(buckets=10000, min_words=20, percent=10, seed=2024) -> str:
    """The same rows for runs of one word, with crc32 spelt as a fold over bytes."""
    words = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    bit = "CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END"
    steps = ", ".join(f"s{k + 1} AS (SELECT i, {bit} AS c FROM s{k})" for k in range(8))
    return f"""
    WITH s0 AS (SELECT i, i AS c FROM range(256) t(i)), {steps},
    lookup AS (SELECT list(c ORDER BY i) AS k FROM s8),
    d AS (SELECT row_number() OVER () AS r, doc_id, {words} AS w FROM documents),
    dw AS (SELECT r, unnest(w) AS word FROM d),
    bw AS (SELECT unnest({words}) AS word FROM benchmark),
    vocabulary AS (SELECT DISTINCT word, hex(word) AS x FROM (SELECT word FROM dw UNION ALL SELECT word FROM bw)),
    coded AS (SELECT word, xor(list_reduce(list_concat([4294967295], list_transform(range(0, len(x) // 2), lambda j: CAST('0x' || x[2 * j + 1 : 2 * j + 2] AS BIGINT))),
                lambda c, b: xor(c // 256, k[(xor(c, b) % 256) + 1])), 4294967295) % {buckets} AS bucket FROM vocabulary, lookup),
    s AS (SELECT bucket, count(*) AS s FROM dw JOIN coded USING (word) GROUP BY bucket),
    t AS (SELECT bucket, count(*) AS t FROM bw JOIN coded USING (word) GROUP BY bucket),
    size AS (SELECT (SELECT count(*) FROM dw) AS ss, (SELECT count(*) FROM bw) AS tt),
    gain AS (SELECT word, CAST(floor(1000 * ln((CAST(coalesce(t, 0) AS DOUBLE) + 1) * (ss + {buckets}) / ((CAST(coalesce(s, 0) AS DOUBLE) + 1) * (tt + {buckets})))) AS BIGINT) AS gain
             FROM coded LEFT JOIN s USING (bucket) LEFT JOIN t USING (bucket), size),
    weighed AS (SELECT r, CAST(sum(gain) AS BIGINT) AS weight FROM dw JOIN gain USING (word) GROUP BY r),
    noisy AS (SELECT r, doc_id, CAST(len(w) AS BIGINT) AS n_features, coalesce(weight, 0) AS weight,
              coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('{seed}:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) + 0.5e0) / 4294967296e0))) AS BIGINT) AS score FROM d LEFT JOIN weighed USING (r)),
    able AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS n FROM noisy WHERE n_features >= {min_words})
    SELECT doc_id, n_features, weight, score, CASE WHEN rank <= {percent} * n // 100 THEN rank END AS rank FROM noisy LEFT JOIN able USING (r)"""
