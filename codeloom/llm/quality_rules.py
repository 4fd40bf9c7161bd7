"""Operator 1: rule statistics of whole texts and an isolation forest on them.

Every text gets a few counts (words, repeats, symbols, ...). An isolation forest,
grown over all labelled rows, measures how few random splits set a document apart;
the anomaly score above which a document is rejected is calibrated on all labelled
rows, each scored by trees that did not see it. Held-out ids are not learned from.

Nothing is sampled: the statistics are a table in the shared folder, trees grow a
level at a time from the ranges and counts of all rows in their open nodes, and the
threshold is the exact one, found by narrowing histograms. The driver holds at most
``trees * 2 ** depth`` nodes, however many rows there are. ``depth`` bounds the trees
as it does in any isolation forest: what a leaf still holds counts as the mean path
of that many rows.

Labelled rows fall into two folds by id hash. Every other tree grows on the one, the
rest on the other, and every row, labelled or not, is scored by the trees of the fold
that its id is not in. So what is calibrated is what decides, and at most the stated share
of the labelled good rows is rejected. Good rows weigh 1; all bad rows of a fold together weigh at most ``contamination`` times its
good ones, and they stretch the ranges from which splits are drawn.

Defined cases: a null or empty text has no words and fails the base rules; with
no labelled good row there is no forest, the score is 0 and the base rules decide
alone; where one fold has no good row, all rows grow and calibrate all trees; with no
labelled bad row the threshold is the largest score of a good row. Repeated rows get
equal results and count as often as they stand in the table; of conflicting labels
the worst counts; a null id is scored as any other. Columns besides id and text are
not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, held_out, picked, written

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
FEATURES = ["log_words", "word_length", "symbols", "dup_lines", "repeats", "capitals", "marks", "digits", "distinct"]
_SPACE, _UPPER, _MARKS, _DIGITS = b" \t\n\x0b\x0c\r", bytes(range(65, 91)), b"!?", b"0123456789"
_SYMBOLS = b"#*$%&|<>"


def repeated_positions(words: list[bytes]) -> int:
    """Words that stand in a 3-word window found twice or more in the text."""
    n = len(words)
    if n < 4:
        return 0
    ids: dict[bytes, int] = {}
    a = np.fromiter((ids.setdefault(w, len(ids)) for w in words), dtype=np.int64, count=n)
    pairs = np.unique(a[:-2] * len(ids) + a[1:-1], return_inverse=True)[1]  # numbered anew: three numbers at once could pass 64 bits
    keys = pairs * len(ids) + a[2:]
    order = np.argsort(keys, kind="stable")
    s = keys[order]
    same = s[1:] == s[:-1]
    if not same.any():
        return 0
    twice = np.zeros(n - 2, dtype=bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    hit = np.zeros(n, dtype=bool)
    for k in range(3):
        hit[k : k + n - 2] |= twice
    return int(hit.sum())


def rule_statistics(text: str | None) -> tuple[list[int], list[float]]:
    """The five base counts of a text, and the forest's features."""
    raw = (text or "").encode()
    words = raw.split()
    n = len(words)
    chars = len(text or "") - (len(raw) - len(raw.translate(None, _SPACE)))
    symbols = len(raw) - len(raw.translate(None, _SYMBOLS))
    seen: set[bytes] = set()
    lines = dup = 0
    for line in raw.split(b"\n"):
        if line.strip(_SPACE):
            lines += 1
            dup += line in seen
            seen.add(line)
    repeats = repeated_positions(words)
    least = max(chars, 1)
    part = lambda kept: (len(raw) - len(raw.translate(None, kept))) / least
    features = [np.log1p(n), chars / max(n, 1), symbols / least, dup / max(lines, 1), repeats / max(n, 1), part(_UPPER), part(_MARKS), part(_DIGITS), len(set(words)) / max(n, 1) ** 0.8]
    return [n, chars, symbols, dup, repeats], features


class IsolationForest:
    """Random axis-parallel splits; the shorter the mean path, the nearer the score is to 1.

    Trees grow a level at a time from the ranges of the rows in their open nodes, so the rows may lie anywhere: in a
    table (``grown_over``) or in memory (``IsolationForest(rows)``, with ``sample`` of them for each tree). Nodes are
    numbered as in a heap; a leaf is its own child.
    """

    def __init__(self, rows: np.ndarray, trees: int = 100, sample: int = 256, seed: int = 7):
        rng = np.random.default_rng(seed)
        size = min(sample, len(rows))
        self._plant(trees, max(1, int(np.ceil(np.log2(max(size, 2))))), seed)
        drawn = [rows[rng.choice(len(rows), size, replace=False)] for _ in range(trees)]
        for level in range(self.depth + 1):
            found = Ranges(trees, level, rows.shape[1])
            for k, part in enumerate(drawn):
                found.add(self, part, np.ones(size, bool), [k])
            if not self.grow(level, found.lo, found.hi, found.good):
                break

    @classmethod
    def planted(cls, trees: int, depth: int, seed: int) -> IsolationForest:
        """Trees that have not grown yet."""
        out = cls.__new__(cls)
        out._plant(trees, depth, seed)
        return out

    def _plant(self, trees: int, depth: int, seed: int) -> None:
        nodes = 2 ** (depth + 1) - 1
        self.depth, self.seed = depth, seed
        self.size = np.zeros(trees)
        self.feature = np.zeros((trees, nodes), np.int32)
        self.split = np.full((trees, nodes), np.inf)
        self.child = np.tile(np.arange(nodes, dtype=np.int32)[None, :, None], (trees, 1, 2))
        self.path = np.zeros((trees, nodes))

    @staticmethod
    def mean_path(n) -> np.ndarray:
        """Mean length of an unsuccessful search in a binary search tree of n keys; between whole numbers it never falls."""
        n = np.asarray(n, dtype=np.float64)
        most = np.maximum(n, 2)
        return np.where(n <= 2, np.maximum(n - 1, 0), np.maximum(2 * (np.log(most - 1) + 0.5772156649) - 2 * (most - 1) / most, 1))

    def grow(self, level: int, lo: np.ndarray, hi: np.ndarray, mass: np.ndarray) -> bool:
        """Split the nodes of a level, given ranges and mass of the rows in each; False once nothing is left to split."""
        if level == 0:
            self.size = mass[:, 0].astype(np.float64)
        at = np.arange(2**level - 1, 2 ** (level + 1) - 1)
        rng = np.random.default_rng([self.seed, level])
        turn, share = rng.random(lo.shape), rng.random(mass.shape)
        spread = hi > lo
        split = spread.any(-1) & (level < self.depth)
        f = np.where(spread, turn, -1).argmax(-1)
        low, high = (np.where(split, np.take_along_axis(v, f[..., None], -1)[..., 0], 0) for v in (lo, hi))
        cut = np.minimum(low + share * (high - low), np.nextafter(high, low))  # below the largest value: no side is empty
        self.feature[:, at] = np.where(split, f, 0)
        self.split[:, at] = np.where(split, cut, np.inf)
        if split.any():
            self.child[:, at] = np.where(split[..., None], (2 * at + 1)[None, :, None] + np.arange(2), at[None, :, None])
        self.path[:, at] = np.where(split, 0, level + self.mean_path(mass))
        return bool(split.any())

    def reach(self, rows: np.ndarray, trees: np.ndarray, steps: int) -> np.ndarray:
        """The node of each row in each of those trees after that many steps."""
        at = np.zeros((len(rows), len(trees)), np.int32)
        for _ in range(steps):
            right = np.take_along_axis(rows, self.feature[trees, at], axis=1) > self.split[trees, at]
            at = self.child[trees, at, right.astype(np.int8)]
        return at

    def score(self, rows: np.ndarray, trees: np.ndarray | None = None) -> np.ndarray:
        """Anomaly of each row by those trees (all of them)."""
        trees = np.arange(len(self.feature)) if trees is None else trees
        out = np.empty(len(rows))
        scale = np.maximum(self.mean_path(self.size[trees]), 1e-9)
        for lo in range(0, len(rows), 2048):
            at = self.reach(rows[lo : lo + 2048], trees, self.depth)
            out[lo : lo + 2048] = 2.0 ** -(self.path[trees, at] / scale).mean(1)
        return out


class Ranges:
    """Least and largest values, and numbers of good and bad rows, in each node of a level."""

    def __init__(self, trees: int, level: int, width: int):
        self.level, nodes = level, 2**level
        self.lo = np.full((trees, nodes, width), np.inf)
        self.hi = np.full((trees, nodes, width), -np.inf)
        self.good = np.zeros((trees, nodes), np.int64)
        self.bad = np.zeros((trees, nodes), np.int64)

    def add(self, forest: IsolationForest, rows: np.ndarray, good: np.ndarray, trees) -> None:
        """Count rows in those trees; rows that ended in a leaf further up are left out."""
        nodes = self.good.shape[1]
        at = forest.reach(rows, np.asarray(trees), self.level) - (nodes - 1)
        for j, t in enumerate(trees):
            here = np.flatnonzero(at[:, j] >= 0)
            order = here[np.argsort(at[here, j], kind="stable")]
            if not len(order):
                continue
            node = at[order, j]
            some, first = np.unique(node, return_index=True)
            x = rows[order]
            self.lo[t, some] = np.minimum(self.lo[t, some], np.minimum.reduceat(x, first))
            self.hi[t, some] = np.maximum(self.hi[t, some], np.maximum.reduceat(x, first))
            kind = good[order]
            self.good[t] += np.bincount(node[kind], minlength=nodes)
            self.bad[t] += np.bincount(node[~kind], minlength=nodes)


def _vectors(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), len(FEATURES))


def _trees_of(fold: int, folds: int, trees: int) -> np.ndarray:
    """The trees that grow on a fold."""
    return np.arange(fold, trees, folds)


def _level(rows: DataFrame, forest: IsolationForest, level: int, folds: int) -> pa.Table:
    """Ranges and counts of all rows in each node of a level: at most trees * 2 ** level lines."""
    trees, width = len(forest.feature), len(FEATURES)
    names = [f"{side}{k}" for side in ("lo", "hi") for k in range(width)]
    columns = ["tree", "node", "good", "bad", *names]

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Ranges(trees, level, width)
        for b in batches:
            x, good, fold = _vectors(b.column("x")), b.column("good").to_numpy(zero_copy_only=False), b.column("fold").to_numpy() % folds
            for k in range(folds):
                out.add(forest, x[fold == k], good[fold == k], _trees_of(k, folds, trees))
        tree, node = np.nonzero(out.good + out.bad)
        parts = [tree.astype(np.int32), node.astype(np.int32), out.good[tree, node], out.bad[tree, node], *out.lo[tree, node].T, *out.hi[tree, node].T]
        yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(v)) for v in parts], columns)

    lines = rows.mapInArrow(found, "tree int, node int, good long, bad long, " + ", ".join(f"{c} double" for c in names))
    least = [(F.min if c.startswith("lo") else F.max)(c).alias(c) for c in names]
    return lines.groupBy("tree", "node").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"), *least).select(columns).toArrow()


def grown_over(rows: DataFrame, weights: list[float], *, trees=100, depth=8, seed=7) -> IsolationForest:
    """A forest over all rows (fold, good, x); weights: what a bad row counts in each fold."""
    folds = len(weights)
    forest = IsolationForest.planted(trees, depth, seed)
    for level in range(depth + 1):
        got = _level(rows, forest, level, folds)
        tree, node, good, bad, *sides = (got.column(k).to_numpy() for k in range(got.num_columns))
        whole = Ranges(trees, level, len(FEATURES))
        whole.lo[tree, node], whole.hi[tree, node] = np.split(np.stack(sides, axis=1), 2, axis=1)
        mass = np.zeros(whole.good.shape)
        mass[tree, node] = good + np.array(weights)[tree % folds] * bad
        if not forest.grow(level, whole.lo, whole.hi, mass):
            break
    return forest


def calibrated(good: np.ndarray, bad: np.ndarray, false_rejects: float) -> float:
    """The threshold that catches most bad rows among those that reject at most that share of the good ones."""
    if not len(bad):
        return float(good.max())
    cuts = np.unique(np.concatenate([good, bad]))
    allowed = cuts[[(good > c).mean() <= false_rejects for c in cuts]]
    caught = np.array([(bad > c).mean() for c in allowed])
    return float(allowed[np.flatnonzero(caught == caught.max())[-1]])


def _ranked(scores: DataFrame, rank: int) -> float:
    """The score of that rank (0: the largest), by histograms of narrower and narrower ranges: nothing is sorted or collected whole."""
    bins = 4096
    lo, hi = scores.agg(F.min("score"), F.max("score")).first()
    while lo < hi:
        part = F.least(F.floor((F.col("score") - F.lit(lo)) / F.lit(hi - lo) * bins), F.lit(bins)).alias("part")
        found = scores.where(F.col("score").between(lo, hi)).groupBy(part).agg(F.count("*").alias("n"), F.min("score").alias("lo"), F.max("score").alias("hi")).collect()
        for line in sorted(found, key=lambda r: -r.part):  # at most bins + 1 lines
            if rank < line.n:
                break
            rank -= line.n
        lo, hi = line.lo, line.hi
    return lo


def calibrated_over(scores: DataFrame, false_rejects: float) -> float:
    """``calibrated`` over a table (good, score) of any size, with the same result."""
    good, bad = scores.where("good"), scores.where("NOT good")
    n = good.count()
    allowed = int(false_rejects * n)  # good rows that may lie above the threshold
    allowed += (allowed + 1) / n <= false_rejects
    allowed -= allowed / n > false_rejects
    if bad.isEmpty():
        return good.agg(F.max("score")).first()[0]
    least = _ranked(good, allowed) if allowed < n else scores.agg(F.min("score")).first()[0]
    above = bad.where(F.col("score") > least).agg(F.min("score")).first()[0]  # a higher threshold may not let this one through
    return (scores if above is None else scores.where(F.col("score") < above)).agg(F.max("score")).first()[0]


_OUT = pa.schema([("doc_id", pa.int64()), *((c, pa.int64()) for c in COUNTS), ("anomaly", pa.float64())])
_STATISTICS = pa.schema([("doc_id", pa.int64()), *((c, pa.int64()) for c in COUNTS), ("x", pa.list_(pa.float64()))])


def statistics(documents: DataFrame, *, id_col="doc_id", text_col="text") -> DataFrame:
    """doc_id, the five counts and the forest's features (x) of every row."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [rule_statistics(t.as_py()) for t in b.column("text")]
            counts = np.array([c for c, _ in got], dtype=np.int64).reshape(len(got), len(COUNTS))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(counts[:, k]) for k in range(len(COUNTS))), pa.array([x for _, x in got], pa.list_(pa.float64()))], schema=_STATISTICS)

    rows = picked(documents, doc_id=id_col, text=text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    return rows.mapInArrow(counted, "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS) + ", x array<double>")


_FOLD = "CAST(pmod(xxhash64(doc_id), 2) AS INT) AS fold"


def _by_other_fold(forest: IsolationForest, b: pa.RecordBatch) -> np.ndarray:
    """Anomaly of each row of a batch (fold, x) by the trees that its fold did not grow (by all, where the folds are one)."""
    x, fold = _vectors(b.column("x")), b.column("fold").to_numpy() % forest.folds
    out = np.empty(len(x))
    for k in range(forest.folds):
        out[fold == k] = forest.score(x[fold == k], _trees_of(forest.folds - 1 - k, forest.folds, len(forest.feature)))
    return out


def fit(found: DataFrame, labels: DataFrame, *, trees=100, depth=8, false_rejects=0.01, contamination=0.03, seed=7):
    """(forest, threshold) from the statistics of all labelled rows that are not held out; (None, inf) where no good row is labelled."""
    marks = picked(labels, doc_id="doc_id", quality="quality").where("doc_id IS NOT NULL AND quality IN (0, 1)").where(~held_out(F.col("doc_id")))
    marks = marks.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("quality"))
    rows = found.select("doc_id", "x").join(marks, "doc_id").select(F.expr(_FOLD), (F.col("quality") == 1).alias("good"), "x")
    rows = written(rows, "rule-training")
    count = {(r.fold, r.good): r.n for r in rows.groupBy("fold", "good").agg(F.count("*").alias("n")).collect()}
    if not any(good for _, good in count):
        dropped(rows)
        return None, float("inf")
    split = (0, True) in count and (1, True) in count and trees > 1
    parts = [[0], [1]] if split else [[0, 1]]
    total = [[sum(count.get((fold, kind), 0) for fold in part) for kind in (True, False)] for part in parts]
    forest = grown_over(rows, [min(1.0, contamination * good / max(bad, 1)) for good, bad in total], trees=trees, depth=depth, seed=seed)

    forest.folds = len(parts)

    def unseen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("good"), pa.array(_by_other_fold(forest, b))], ["good", "score"])

    scores = written(rows.mapInArrow(unseen, "good boolean, score double"), "rule-scores")
    threshold = calibrated_over(scores, false_rejects)
    dropped(rows, scores)
    return forest, threshold


def assess(documents: DataFrame, labels: DataFrame, *, id_col="doc_id", text_col="text", min_words=50, max_repeat_percent=50, **options) -> DataFrame:
    """doc_id, the five counts, base_failed, kept, anomaly (0 to 1) and its threshold, for each row of documents."""
    found = written(statistics(documents, id_col=id_col, text_col=text_col), "rule-statistics")  # texts are read once
    forest, threshold = fit(found, labels, **options)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            anomaly = _by_other_fold(forest, b) if forest else np.zeros(b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(c) for c in ("doc_id", *COUNTS)] + [pa.array(anomaly)], schema=_OUT)

    out = found.selectExpr("*", _FOLD).mapInArrow(scored, "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, anomaly double")
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    return out.select("doc_id", *COUNTS, failed.alias("base_failed"), (~failed & (F.col("anomaly") <= F.lit(threshold))).alias("kept"), "anomaly", F.lit(threshold).alias("threshold"))
