"""Operator 11: hard negatives by vantage-point trees over norm-augmented vectors.

Vectors become whole numbers, floor(scale * x). Each gets one more component, which brings
all of them to the norm of the longest; a query's is 0. Then the distance between a query
q and a vector x falls as their inner product grows (|q|^2 + M - 2 q.x under the root), so
the vectors whose score lies in a window are those in a ring around q: an annulus.

1. A vantage-point tree is grown over a bounded sample (``SAMPLE`` rows, smallest content
   hash first); every vector is indexed: it goes down the tree to a cell. A cell's rows
   are dealt to blocks of some ``BLOCK`` rows, so a vector that a third of all rows hold
   fills many blocks; each block grows a tree of its own, with leaves of some ``LEAF``
   rows that know their least and greatest distance to each vantage point above them.
2. Searches come in packs of neighbouring anchors. A search is an anchor, a window of
   scores, and whether equal or different labels are wanted. The k-th best row of the
   sample bounds it from below, so it visits only cells that meet its annulus.
3. Packs and blocks of a cell are cogrouped by cell, lot of blocks and turn of packs, which
   bounds what one key holds on both sides, and brings each side to Python once for a key.
   Of a block only leaves that meet an annulus are read. An anchor's products with them are
   made once for all of its windows, and only those over the least bound are looked at;
   the k-th row found raises the bound for the next block. Scores are exact: sums of whole
   numbers.
4. Rows found, at most k for each search and key, are ranked with a limit ahead of the
   shuffle.

The positives of an anchor are one search (no window, equal label), the negatives of each
anchor and positive another (the window of the positive's score, different labels).

The trees prune, they never drop: results are those of comparing all pairs. Where vectors
spread evenly over many dimensions little can be pruned, and the work is the product of
anchors and rows, in blocks.

Defined cases: rows with a null label, a null vector or a null or infinite component take
no part, nor do vectors of squared norm 2**56 or more after scaling (their scores leave a
long); shorter vectors are filled up with zeros; a null id is no anchor and comes last
among ties; rows, not ids, are compared, so copies of an anchor may be its positives, and a
repeated anchor has results of its own; positives of negative score have an empty window;
empty tables and anchors without positives or negatives give no rows; other columns are
not read, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import dropped, picked, written

SAMPLE, BLOCK, LEAF, PACK = 2048, 2048, 256, 512
MAX_DEPTH = 9  # of the tree over the sample
LOT, TURN = 8, 16  # blocks and packs that one key holds
STRIPE = 128  # anchors whose products with a block are held at once
FAR = 1 << 60  # beyond every score
_SEARCH = "row long, tag long, label long, same boolean, low long, high long, vec binary"


class Tree:
    """A complete vantage-point tree: nodes in heap order, each with a point and the median distance to it."""

    def __init__(self, rows: np.ndarray, depth: int, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.depth = depth
        self.points = np.zeros(((1 << depth) - 1, rows.shape[1]))
        self.radii = np.zeros((1 << depth) - 1)
        held = [np.arange(len(rows))]
        for node in range((1 << depth) - 1):
            mine = held[node]
            if len(mine):
                tried = rng.choice(mine, min(8, len(mine)), replace=False)
                away = np.linalg.norm(rows[mine][None] - rows[tried][:, None], axis=2)
                best = int(away.std(axis=1).argmax())  # the point that tells the rows apart best
                self.points[node] = rows[tried[best]]
                self.radii[node] = np.median(away[best])
                outside = away[best] > self.radii[node]
            else:
                outside = np.empty(0, bool)
            held += [mine[~outside], mine[outside]]

    def path(self, leaf: np.ndarray) -> np.ndarray:
        """Nodes from the root down to the parent of each leaf."""
        return np.stack([((leaf + (1 << self.depth)) >> (self.depth - k)) - 1 for k in range(self.depth)], axis=-1) if self.depth else np.empty((*leaf.shape, 0), int)

    def leaf_of(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The leaf of each row and its distances to the points on the way."""
        node, away = np.zeros(len(rows), int), np.zeros((len(rows), self.depth))
        for k in range(self.depth):
            away[:, k] = np.linalg.norm(rows - self.points[node], axis=1)
            node = 2 * node + 1 + (away[:, k] > self.radii[node])
        return node - ((1 << self.depth) - 1), away

    def bounds(self, leaf: np.ndarray, away: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest distance between each leaf's rows and each point above it; an empty leaf's are infinite."""
        low = np.full((1 << self.depth, self.depth), np.inf)
        high = np.full((1 << self.depth, self.depth), -np.inf)
        np.minimum.at(low, leaf, away)
        np.maximum.at(high, leaf, away)
        return low, high

    def reach(self, queries: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bounds of the distance between each query and any row of each leaf."""
        if not self.depth:
            return np.zeros((len(queries), 1)), np.full((len(queries), 1), np.inf)
        squares = (queries**2).sum(1)[:, None] + (self.points**2).sum(1)[None] - 2 * queries @ self.points.T
        away = np.sqrt(np.maximum(squares, 0))[:, self.path(np.arange(1 << self.depth))]
        return np.maximum(low - away, away - high).max(axis=2), (away + high).min(axis=2)


def augmented(rows: np.ndarray, norm: int | None) -> np.ndarray:
    """Rows with the component that brings their squared norm to the given one; 0 for queries (None)."""
    rows = rows.astype(float)
    extra = np.zeros(len(rows)) if norm is None else np.sqrt(np.maximum(norm - (rows**2).sum(1), 0))
    return np.concatenate([rows, extra[:, None]], axis=1)


def distances(squares: np.ndarray, norm: int, scores: np.ndarray) -> np.ndarray:
    """How far from queries of these squared norms the rows of these scores lie."""
    return np.sqrt(np.maximum(squares + float(norm) - 2.0 * scores, 0))


def matrix(vectors: list[bytes], dims: int) -> np.ndarray:
    """Stored vectors as rows, filled up with zeros."""
    if all(len(v) == 4 * dims for v in vectors):
        return np.frombuffer(b"".join(vectors), "<i4").reshape(len(vectors), dims)
    out = np.zeros((len(vectors), dims), np.int32)
    for row, v in zip(out, vectors, strict=True):
        row[: len(v) // 4] = np.frombuffer(v, "<i4")
    return out


def exact_type(norm: int) -> type:
    """The fastest type in which sums of products of vectors of at most this squared norm are exact."""
    return np.float32 if norm < 1 << 24 else np.float64 if norm < 1 << 53 else np.int64


def whole(vector: list | None, scale: int) -> np.ndarray | None:
    """floor(scale * x) of each component; None where the vector takes no part."""
    if vector is None or any(x is None for x in vector):
        return None
    v = np.floor(scale * np.array(vector, float))
    return v if np.isfinite(v).all() and np.abs(v).max(initial=0) < 1 << 28 and (v**2).sum() < 2.0**56 else None


def vectors(df: DataFrame, *, id_col="vec_id", vector_col="embedding", label_col="label", scale=256) -> DataFrame:
    """row (a number of its own), vec_id, label, vec (whole numbers of 4 bytes), norm (its square) and dims of all rows that take part, as a written table."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            column = b.column("vec")
            n, flat = len(column), column.flatten()
            if n and not column.null_count and not flat.null_count and len(flat) % n == 0 and np.all(np.diff(column.offsets) == len(flat) // n):  # all of one length
                v = np.floor(scale * flat.to_numpy().reshape(n, -1))
                fine = np.isfinite(v).all(1) & (np.abs(v).max(1, initial=0) < 1 << 28)
                fine[fine] = (v[fine] ** 2).sum(1) < 2.0**56
                got = list(v[fine].astype("<i4"))
            else:
                made = [whole(x, scale) for x in column.to_pylist()]
                fine = np.array([x is not None for x in made], bool)
                got = [x.astype("<i4") for x in made if x is not None]
            part = b.filter(pa.array(fine))
            norms = [int((x.astype(np.int64) ** 2).sum()) for x in got]
            yield pa.RecordBatch.from_arrays([part.column("vec_id"), part.column("label"), pa.array([x.tobytes() for x in got], pa.binary()), pa.array(norms, pa.int64()), pa.array([len(x) for x in got], pa.int32())], ["vec_id", "label", "vec", "norm", "dims"])

    rows = picked(df, vec_id=id_col, vec=vector_col, label=label_col).where("label IS NOT NULL AND vec IS NOT NULL")
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("vec").cast("array<double>").alias("vec"), F.col("label").cast("long").alias("label"))
    rows = rows.mapInArrow(read, "vec_id long, label long, vec binary, norm long, dims int")
    return written(rows.select(F.monotonically_increasing_id().alias("row"), "*"), "vectors")  # numbered once: the table is what is read


class Index:
    """All vectors in blocks below a tree over a sample."""

    def __init__(self, rows: DataFrame):
        self.rows = rows
        count, norm, dims = rows.agg(F.count("*"), F.max("norm"), F.max("dims")).first()
        self.count, self.norm, self.dims = count, norm or 0, dims or 0
        sample = rows.orderBy(F.xxhash64("vec", "label", "vec_id"), "row").limit(SAMPLE).select("row", "label", "vec").collect()  # bounded by SAMPLE
        self.sample_rows = np.array([r["row"] for r in sample], np.int64)
        self.sample_labels = np.array([r["label"] for r in sample], np.int64)
        self.sample = matrix([bytes(r["vec"]) for r in sample], self.dims)
        depth = min(max(math.ceil(math.log2(max(count / BLOCK, 1))), 0), MAX_DEPTH)
        self.tree = Tree(augmented(self.sample, self.norm), depth)
        self.placed = written(self._placed(), "placed")
        bounds = self.placed.groupBy("cell").agg(F.count("*").alias("n"), *[f(F.col("away")[k]).alias(f"{f.__name__}{k}") for f in (F.min, F.max) for k in range(depth)]).collect()  # a row for each cell
        self.low, self.high = np.full((1 << depth, depth), np.inf), np.full((1 << depth, depth), -np.inf)
        for r in bounds:
            self.low[r["cell"]] = [r[f"min{k}"] for k in range(depth)]
            self.high[r["cell"]] = [r[f"max{k}"] for k in range(depth)]
        self.blocks = written(self._blocks({r["cell"]: r["n"] for r in bounds}), "blocks")

    def _placed(self) -> DataFrame:
        tree, norm, dims = self.tree, self.norm, self.dims

        def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                cell, away = tree.leaf_of(augmented(matrix(b.column("vec").to_pylist(), dims), norm))
                yield pa.RecordBatch.from_arrays([*[b.column(c) for c in ("row", "vec_id", "label", "vec")], pa.array(cell, pa.int32()), pa.array(list(away), pa.list_(pa.float64()))], ["row", "vec_id", "label", "vec", "cell", "away"])

        return self.rows.select("row", "vec_id", "label", "vec").mapInArrow(placed, "row long, vec_id long, label long, vec binary, cell int, away array<double>")

    def dealt(self, df: DataFrame, cell: Column, counts: dict[int, int], size: int) -> DataFrame:
        """df with salt: rows of a cell dealt to as many parts as it takes for some size rows each."""
        parts = {c: math.ceil(n / size) for c, n in counts.items() if n > size}
        of = F.element_at(F.create_map(*[F.lit(x) for kv in parts.items() for x in kv]), cell) if parts else F.lit(None)
        return df.withColumn("salt", F.pmod(F.xxhash64("row"), F.coalesce(of, F.lit(1))).cast("int"))

    def _blocks(self, counts: dict[int, int]) -> DataFrame:
        norm, dims = self.norm, self.dims

        def packed(t: pa.Table) -> pa.Table:
            vecs = matrix(t.column("vec").to_pylist(), dims)
            depth = max(math.ceil(math.log2(max(len(vecs) / LEAF, 1))), 0)
            rows = augmented(vecs, norm)
            tree = Tree(rows, depth)
            leaf, away = tree.leaf_of(rows)
            low, high = tree.bounds(leaf, away)
            order = np.argsort(leaf, kind="stable")
            ids = t.column("vec_id").to_pylist()
            arrays = {
                "rows": t.column("row").to_numpy()[order].astype("<i8"), "labels": t.column("label").to_numpy()[order].astype("<i8"),
                "ids": np.array([i or 0 for i in ids], "<i8")[order], "known": np.array([i is not None for i in ids], bool)[order], "vecs": vecs[order],
                "starts": np.searchsorted(leaf[order], np.arange((1 << depth) + 1)).astype("<i4"), "points": tree.points, "low": low, "high": high,
            }
            out = {"cell": pa.array([t.column("cell")[0].as_py()], pa.int32()), "salt": pa.array([t.column("salt")[0].as_py()], pa.int32()), "depth": pa.array([depth], pa.int32())}
            return pa.table(out | {k: pa.array([v.tobytes()], pa.binary()) for k, v in arrays.items()})

        schema = "cell int, salt int, depth int, rows binary, labels binary, ids binary, known binary, vecs binary, starts binary, points binary, low binary, high binary"
        return self.dealt(self.placed.drop("away"), F.col("cell"), counts, BLOCK).groupBy("cell", "salt").applyInArrow(packed, schema)

    def search(self, searches: DataFrame, k: int) -> DataFrame:
        """For searches (row, tag, label, same, low, high, vec, cell) the best k rows of all with low <= score <= high and the label wanted, the search's own row left out: row, tag, found (its row), vec_id, score and rank."""
        n = searches.select("row").distinct().count()
        shift = max(self.tree.depth - max(math.ceil(math.log2(max(n / PACK, 1))), 0), 0)
        searches = searches.withColumn("part", F.shiftright("cell", shift))
        sizes = {r["part"]: r["n"] for r in searches.groupBy("part").agg(F.count_distinct("row").alias("n")).collect()}  # at most a row for each cell
        packs = self.dealt(searches, F.col("part"), sizes, PACK).drop("cell").groupBy("part", "salt").applyInArrow(self._packer(k), "pack binary, cells array<int>")
        turns = max(math.ceil(sum(math.ceil(x / PACK) for x in sizes.values()) / TURN), 1)
        packs = packs.withColumn("turn", F.pmod(F.xxhash64("pack"), F.lit(turns)).cast("int")).withColumn("cell", F.explode("cells")).drop("cells")
        lots = self.blocks.groupBy("cell").agg((F.max("salt") / LOT).cast("int").alias("lots"))  # a row for each cell
        packs = packs.join(F.broadcast(lots), "cell").withColumn("lot", F.explode(F.sequence(F.lit(0), "lots"))).drop("lots")
        blocks = self.blocks.withColumn("lot", (F.col("salt") / LOT).cast("int")).withColumn("turn", F.explode(F.sequence(F.lit(0), F.lit(turns - 1))))
        key = ("cell", "lot", "turn")
        found = packs.groupBy(*key).cogroup(blocks.groupBy(*key)).applyInArrow(self._finder(k), "row long, tag long, found long, vec_id long, score long")
        order = Window.partitionBy("row", "tag").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "found")
        return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    def _packer(self, k: int):
        tree, low, high, norm, dims = self.tree, self.low, self.high, self.norm, self.dims
        sample, labels, rows = self.sample.astype(exact_type(norm)), self.sample_labels, self.sample_rows

        def pack(t: pa.Table) -> pa.Table:
            s = Searches(t, dims)
            for lo in range(0, len(s.rows) if len(sample) >= k else 0, PACK):  # the k-th best of the sample is the least that the k-th best of all can be
                at = slice(lo, lo + PACK)
                scores = s.vecs[s.who[at]].astype(sample.dtype) @ sample.T
                fits = s.fits(scores, at, labels, rows)
                kth = -np.partition(-np.where(fits, scores, -FAR).astype(float), k - 1, axis=1)[:, k - 1]
                s.low[at] = np.maximum(s.low[at], np.where(kth > -FAR, kth, -FAR).astype(np.int64))
            near, far = s.ring(norm)
            least, most = tree.reach(augmented(s.vecs, None), low, high)
            cells = np.flatnonzero(((least <= far[:, None]) & (most >= near[:, None])).any(0))
            return pa.table({"pack": pa.array([s.stored()], pa.binary()), "cells": pa.array([cells.tolist()], pa.list_(pa.int32()))})

        return pack

    def _finder(self, k: int):
        norm, dims = self.norm, self.dims

        def find(packs: pa.Table, blocks: pa.Table) -> pa.Table:
            read = [Block({c: blocks.column(c)[at].as_py() for c in blocks.column_names}, dims, exact_type(norm)) for at in range(blocks.num_rows)]
            out = []
            for raw in packs.column("pack") if read else ():
                s = Searches.read(raw.as_py(), dims)
                held = (np.empty(0, np.int64),) * 3 + (np.empty(0, bool), np.empty(0, np.int64))
                for block in read:
                    held = best(*(np.concatenate(x) for x in zip(held, found_in(block, s, k, norm), strict=True)), k)
                    which, scores = held[0], held[4]
                    last = np.flatnonzero(np.bincount(which, minlength=len(s.rows)) >= k)  # their k-th row draws the annulus in
                    s.low[last] = np.maximum(s.low[last], scores[np.searchsorted(which, last, "right") - 1])
                which, rows, ids, known, scores = held
                out.append([s.rows[which], s.tags[which], rows, pa.array(ids, pa.int64(), mask=~known), scores])
            columns = zip(*out, strict=True) if out else ((),) * 5
            return pa.table({name: pa.chunked_array([x if isinstance(x, pa.Array) else pa.array(x, pa.int64()) for x in c], pa.int64()) for name, c in zip(("row", "tag", "found", "vec_id", "score"), columns, strict=True)})

        return find


class Searches:
    """A pack of searches: whose (row), which of theirs (tag), for which label or all others, within which scores. They stand by rows: vecs holds a vector of each row, who its place for each search, starts the first search of each."""

    def __init__(self, t: pa.Table, dims: int):
        t = t.sort_by("row")
        take = lambda c: t.column(c).to_numpy().astype(np.int64)
        self.rows, self.tags, self.labels, self.low, self.high = map(take, ("row", "tag", "label", "low", "high"))
        self.same = t.column("same").to_numpy().astype(bool)
        self._stand()
        self.vecs = matrix(t.column("vec").take(pa.array(self.starts)).to_pylist(), dims)

    def _stand(self) -> None:
        _, self.starts, self.who = np.unique(self.rows, return_index=True, return_inverse=True)

    def stored(self) -> bytes:
        parts = [np.array([len(self.rows)]), self.rows, self.tags, self.labels, self.low, self.high, self.same]
        return b"".join(p.astype("<i8").tobytes() for p in parts) + self.vecs.astype("<i4").tobytes()

    @classmethod
    def read(cls, raw: bytes, dims: int) -> Searches:
        out = cls.__new__(cls)
        n = int(np.frombuffer(raw, "<i8", 1)[0])
        out.rows, out.tags, out.labels, out.low, out.high, same = np.frombuffer(raw, "<i8", 6 * n, 8).reshape(6, n)
        out.same, out.low = same.astype(bool), out.low.copy()
        out._stand()
        out.vecs = np.frombuffer(raw, "<i4", len(out.starts) * dims, 8 + 48 * n).reshape(len(out.starts), dims)
        return out

    def fits(self, scores: np.ndarray, at, labels: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Which scores, of the searches at these places with rows, are of a row wanted."""
        inside = (scores >= self.low[at][:, None]) & (scores <= self.high[at][:, None])
        return inside & ((labels == self.labels[at][:, None]) == self.same[at][:, None]) & (rows != self.rows[at][:, None])

    def ring(self, norm: int) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest distance of the rows that any search of each vector wants, with room for rounding."""
        squares = (self.vecs.astype(float) ** 2).sum(1)
        slack = 1e-6 * (1 + math.sqrt(norm))
        return distances(squares, norm, np.maximum.reduceat(self.high, self.starts)) - slack, distances(squares, norm, np.minimum.reduceat(self.low, self.starts)) + slack


class Block:
    """A block's rows in the order of its leaves, and its tree's points and bounds."""

    def __init__(self, r: dict, dims: int, kind: type):
        numbers = lambda c, t: np.frombuffer(r[c], t)
        self.rows, self.labels, self.ids, self.known = numbers("rows", "<i8"), numbers("labels", "<i8"), numbers("ids", "<i8"), numbers("known", bool)
        self.vecs = numbers("vecs", "<i4").reshape(len(self.rows), dims).astype(kind)
        self.starts = numbers("starts", "<i4")
        self.tree = Tree.__new__(Tree)
        self.tree.depth = r["depth"]
        self.tree.points = numbers("points", float).reshape(-1, dims + 1)
        self.low, self.high = (numbers(c, float).reshape(1 << r["depth"], r["depth"]) for c in ("low", "high"))


def found_in(block: Block, s: Searches, k: int, norm: int) -> tuple[np.ndarray, ...]:
    """The best k rows of a block for each search: place of the search, row, id, whether it has one, score."""
    least, most = block.tree.reach(augmented(s.vecs, None), block.low, block.high)
    near, far = s.ring(norm)
    visits = (least <= far[:, None]) & (most >= near[:, None])
    floor = np.minimum.reduceat(s.low, s.starts)
    of = np.diff(np.append(s.starts, len(s.rows)))  # searches of each vector
    hits = []
    for lo in range(0, len(s.vecs), STRIPE):
        part = visits[lo : lo + STRIPE]
        who = lo + np.flatnonzero(part.any(1))
        leaves = np.flatnonzero(part.any(0))
        if not len(who):
            continue
        spans = [slice(0, len(block.rows))] if 2 * len(leaves) > part.shape[1] else [slice(block.starts[x], block.starts[x + 1]) for x in leaves]
        vecs, least_wanted = s.vecs[who].astype(block.vecs.dtype), floor[who].astype(block.vecs.dtype)[:, None]
        for span in spans:
            scores = vecs @ block.vecs[span].T
            i, j = (scores >= least_wanted).nonzero()
            got, anchor = scores[i, j].astype(np.int64), who[i]
            n = of[anchor]  # each for all searches of its vector
            at = np.repeat(s.starts[anchor] - np.append(0, np.cumsum(n)[:-1]), n) + np.arange(n.sum()) if len(i) else np.empty(0, np.int64)
            got, j = np.repeat(got, n), np.repeat(j + span.start, n)
            fits = (got >= s.low[at]) & (got <= s.high[at]) & ((block.labels[j] == s.labels[at]) == s.same[at]) & (block.rows[j] != s.rows[at])
            at, j, got = at[fits], j[fits], got[fits]
            hits.append(best(at, block.rows[j], block.ids[j], block.known[j], got, k))
    if not hits:
        return *(np.empty(0, np.int64),) * 3, np.empty(0, bool), np.empty(0, np.int64)
    return best(*map(np.concatenate, zip(*hits, strict=True)), k)


def best(which: np.ndarray, rows: np.ndarray, ids: np.ndarray, known: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """The best k rows of each search: by score, then id (none last), then row."""
    order = np.lexsort((rows, ids, ~known, -scores, which))
    order = order[np.arange(len(order)) - np.searchsorted(which[order], which[order]) < k]
    return which[order], rows[order], ids[order], known[order], scores[order]


def mine(df: DataFrame, *, anchors: Column | str = "vec_id % 100 = 0", positives=5, negatives=10, low_tenths=3, high_tenths=9, **columns) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score, for the rows of df whose id (vec_id) meets the condition anchors.

    A negative's score lies between low_tenths and high_tenths tenths of the positive's.
    """
    rows = vectors(df, **columns)
    index = Index(rows)
    if not index.count:
        return rows.sparkSession.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    own = written(index.placed.where("vec_id IS NOT NULL").where(anchors).drop("away"), "anchors")
    first = own.select("row", F.lit(0).cast("long").alias("tag"), "label", F.lit(True).alias("same"), F.lit(-FAR).alias("low"), F.lit(FAR).alias("high"), "vec", "cell")
    pairs = written(index.search(first, positives).select("row", F.col("vec_id").alias("positive_id"), "score", F.col("rank").alias("place")), "positives")
    windows = pairs.where("score >= 0").select("row", F.col("score").alias("tag")).distinct()  # one search for equal windows of an anchor
    low, high = F.expr(f"(tag * {low_tenths} + 9) div 10"), F.expr(f"(tag * {high_tenths}) div 10")
    second = written(windows.join(own, "row").select("row", "tag", "label", F.lit(False).alias("same"), low.alias("low"), high.alias("high"), "vec", "cell"), "windows")
    found = index.search(second, negatives).withColumnRenamed("score", "negative_score").withColumnRenamed("vec_id", "negative_id").drop("found")
    out = pairs.withColumnRenamed("score", "tag").join(found, ["row", "tag"]).join(own.select("row", F.col("vec_id").alias("anchor_id")), "row")
    out = written(out.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", F.col("tag").alias("positive_score"), "negative_score"), "negatives")
    dropped(rows, index.placed, index.blocks, own, pairs, second)
    return out


def oracle() -> str:
    """The same rows by comparing all pairs."""
    return """
    WITH v AS (SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v
               FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    s AS (SELECT a.r AS a, a.vec_id AS anchor_id, b.r AS b, b.vec_id AS other, a.label = b.label AS same, CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.r <> b.r),
    p AS (SELECT a, anchor_id, other AS positive_id, b, score AS positive_score FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY score DESC, other, b) AS k FROM s WHERE same) WHERE k <= 5),
    n AS (SELECT p.*, s.other AS negative_id, s.score AS negative_score, row_number() OVER (PARTITION BY p.a, p.b ORDER BY s.score DESC, s.other, s.b) AS rank
          FROM p JOIN s ON s.a = p.a AND NOT s.same AND 30 * positive_score <= 100 * s.score AND 100 * s.score <= 90 * positive_score)
    SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10"""
