"""Operator 10: quality score by nearest-neighbour voting in a latent-semantic space.

A text's terms are its byte trigrams and its word patterns: pairs of neighbouring
words, each reduced to how it begins, how it ends, and whether it is one of the
three words before it (what tells listings, shouting and endless repeats from prose,
in any language). Both are hashed to ``dims`` columns and weighted by tf-idf; each of
the two has unit length, and patterns count ``pattern_share`` of the squared length.
A truncated SVD of a bounded sample of labelled rows (``max_fit`` of each class,
smallest id hash first) spans the latent space.
The sample's latent vectors (at most 2 * max_fit rows of ``rank`` floats, so the
broadcast is bounded; of an id that repeats, the text of the smallest hash) are sent to the executors, which multiply each block of
documents with all of them and let the ``neighbours`` nearest vote, weighted by
their cosine.

Only rows whose crc32(id as text) mod 3 is not 1 are learned from. Labels, lang,
source and id are not inputs of a score.

Defined cases: a null or empty text, or one without words, has no term, no neighbour
and score 0. Without labels of both classes every score is the share of good labels (0.5
without labels). Repeated rows score equally; a null id is scored and counts as
not held out. Ties between neighbours go to the smaller row of the sample.
"""

from __future__ import annotations

from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, picked

PATTERNS = 256  # columns of word patterns, the last ones
_CLASS = np.zeros(256, np.uint8)  # of a byte: 0 other marks, 1 a-z, 2 A-Z, 3 digits, 4 beyond ASCII, 5 end of a sentence, 6 pause
for _bytes, _kind in ((range(97, 123), 1), (range(65, 91), 2), (range(48, 58), 3), (range(128, 256), 4), (b".!?", 5), (b",;:", 6)):
    _CLASS[list(_bytes)] = _kind
_BLANK = np.zeros(256, bool)
_BLANK[list(b" \t\n\x0b\x0c\r")] = True


def word_patterns(raw: bytes) -> np.ndarray:
    """Counts of the hashed patterns of neighbouring words."""
    words = raw.split()
    if not words:
        return np.zeros(PATTERNS, np.float32)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))
    b = np.frombuffer(b"".join(words), np.uint8)
    again = np.zeros(len(words), bool)
    for lag in (1, 2, 3):
        again[lag:] |= np.fromiter(map(eq, words[lag:], words), bool, max(len(words) - lag, 0))
    code = again * np.uint32(49) + _CLASS[b[np.concatenate([[0], ends[:-1]])]] * np.uint32(7) + _CLASS[b[ends - 1]]
    pair = np.concatenate([[np.uint32(98)], code[:-1]]) * np.uint32(99) + code
    return np.bincount((pair.astype(np.uint32) * np.uint32(2654435761)) >> np.uint32(24), minlength=PATTERNS).astype(np.float32)


def term_counts(text: str | None, dims: int) -> np.ndarray:
    """Counts of hashed byte trigrams; the last PATTERNS columns are word patterns."""
    raw = (text or "").encode()
    out = np.zeros(dims, np.float32)
    wide = dims - PATTERNS
    for lo in range(0, max(len(raw) - 2, 0), 1 << 20):  # blocks keep the memory of very long texts bounded
        b = np.frombuffer(raw[lo : lo + (1 << 20) + 2], np.uint8).astype(np.uint32)
        key = (b[:-2] << 16 | b[1:-1] << 8 | b[2:]) * np.uint32(2654435761)
        out[:wide] += np.bincount((key >> np.uint32(16)) % np.uint32(wide), minlength=wide)
    out[wide:] = word_patterns(raw)
    return out


class Space:
    """idf, latent axes, and the sample's unit vectors with their labels."""

    def __init__(self, counts: np.ndarray, labels: np.ndarray, rank: int, pattern_share: float, seed: int = 5):
        df = (counts > 0).sum(0)
        self.idf = (np.log((1 + len(counts)) / (1 + df)) + 1).astype(np.float32)
        self.pattern_share = pattern_share
        x = self.weighted(counts)
        rng = np.random.default_rng(seed)
        rank = min(rank, *x.shape)
        q = np.linalg.qr(x @ rng.standard_normal((x.shape[1], min(rank + 16, *x.shape))).astype(np.float32))[0]
        for _ in range(3):
            q = np.linalg.qr(x @ (x.T @ q))[0]
        self.axes = np.linalg.svd(q.T @ x, full_matrices=False)[2][:rank].T.astype(np.float32)
        self.bank, self.labels = self.latent(x), labels.astype(np.float32)

    def weighted(self, counts: np.ndarray) -> np.ndarray:
        x = np.log1p(counts) * self.idf
        for part, share in ((x[:, :-PATTERNS], 1 - self.pattern_share), (x[:, -PATTERNS:], self.pattern_share)):
            part *= np.sqrt(share) / np.maximum(np.linalg.norm(part, axis=1, keepdims=True), 1e-9)
        return x

    def latent(self, x: np.ndarray) -> np.ndarray:
        y = x @ self.axes
        return y / np.maximum(np.linalg.norm(y, axis=1, keepdims=True), 1e-9)

    def vote(self, counts: np.ndarray, neighbours: int, power: float) -> np.ndarray:
        some = counts.any(1)
        near = self.latent(self.weighted(counts)) @ self.bank.T
        k = min(neighbours, near.shape[1])
        edge = np.partition(near, near.shape[1] - k, axis=1)[:, -k][:, None]
        above = near > edge
        ties = near == edge
        room = k - above.sum(1, keepdims=True)
        weight = np.where(above | (ties & (ties.cumsum(1) <= room)), np.maximum(near, 1e-6) ** power, 0)
        return np.where(some, np.clip((weight @ self.labels) / weight.sum(1), 0, 1), 0)


def fit(documents: DataFrame, labels: DataFrame, *, id_col="doc_id", text_col="text", max_fit=1500, dims=2048, rank=64, pattern_share=0.3):
    """A Space from labelled rows, or the prior where one class is missing."""
    marks = picked(labels, doc_id="doc_id", quality="quality").where("doc_id IS NOT NULL AND quality IN (0, 1)").where(~held_out(F.col("doc_id")))
    marks = marks.groupBy("doc_id").agg(F.min("quality").alias("quality"))
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    chosen = marks.where("quality = 1").orderBy(*order).limit(max_fit).unionAll(marks.where("quality = 0").orderBy(*order).limit(max_fit))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [term_counts(t, dims).tobytes() for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("quality"), pa.array(got, pa.binary())], ["doc_id", "quality", "x"])

    rows = picked(documents, doc_id=id_col, text=text_col).join(F.broadcast(chosen), "doc_id")
    rows = rows.groupBy("doc_id", "quality").agg(F.min(F.struct(F.xxhash64("text").alias("hash"), "text")).alias("first")).select("doc_id", "quality", "first.text")
    got = rows.mapInArrow(counted, "doc_id long, quality int, x binary").toPandas()  # at most 2 * max_fit rows of 4 * dims bytes
    got = got.sort_values(["doc_id", "x"], kind="stable")
    y = got["quality"].to_numpy()
    if len(np.unique(y)) < 2:
        return float(y.mean()) if len(y) else 0.5
    x = np.stack([np.frombuffer(v, np.float32) for v in got["x"]])
    return Space(x, y, rank, pattern_share)


def _scores(space, texts: list[str | None], dims: int, neighbours: int, power: float) -> np.ndarray:
    if not isinstance(space, Space):
        return np.full(len(texts), space)
    counts = np.stack([term_counts(t, dims) for t in texts])
    return space.vote(counts, neighbours, power).astype(np.float64)


def score(documents: DataFrame, labels: DataFrame, *, id_col="doc_id", text_col="text", neighbours=15, power=4.0, dims=2048, block=256, **options) -> DataFrame:
    """doc_id, held_out, score (0 to 1, higher: good likelier) and predicted (0 or 1), for each row of documents."""
    space = fit(documents, labels, id_col=id_col, text_col=text_col, dims=dims, **options)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, block):
                part = b.slice(lo, block)
                s = _scores(space, part.column("text").to_pylist(), dims, neighbours, power)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(s, pa.float64())], ["doc_id", "score"])

    rows = picked(documents, doc_id=id_col, text=text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    out = rows.mapInArrow(scored, "doc_id long, score double")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def accepted(documents: DataFrame, labels: DataFrame, *, id_col="doc_id", text_col="text", neighbours=15, power=4.0, dims=2048, block=256, **options) -> DataFrame:
    """The rows of documents that score() predicts to be good, all columns kept; a narrow pass that decides row by row."""
    space = fit(documents, labels, id_col=id_col, text_col=text_col, dims=dims, **options)
    at = documents.columns.index(text_col)

    def filtered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, block):
                part = b.slice(lo, block)
                yield part.filter(pa.array(_scores(space, part.column(at).to_pylist(), dims, neighbours, power) >= 0.5))

    picked(documents, doc_id=id_col, text=text_col)  # bounds the batches
    return documents.mapInArrow(filtered, documents.schema)
