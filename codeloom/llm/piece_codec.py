"""Operator 2: SentencePiece encoding and decoding, with a max-plus scan for giant documents.

The pieces of a BPE vocabulary that SentencePiece chooses for a text are the one
path through the lattice of its pieces on which every piece encodes to itself and
every two neighbours, put together, encode to just those two. Give such steps the
weight 0 and all others minus infinity: encoding is then the best path of a
max-plus product, and a giant document need not be read in one go:

1. it is split into chunks of ``chunk_chars`` code points, each with a margin of
   the longest piece on either side;
2. each chunk yields the matrix of best weights from the pieces that may cover its
   left edge to those that may cover its right edge (boundary states);
3. the matrices of a document are multiplied in pairs of neighbours, in rounds, up to
   one matrix for the whole (the product is associative); from its two ends the state
   at every edge is then found on the way back down;
4. each chunk is backtraced on its own from its two edge states.

Where a chunk has places that no piece can span (before a word mark that follows
another character), its matrix is the product of a small head, the inner part as a
single number, and a small tail; the inner part is encoded by the library. Texts
of up to ``giant_chars`` code points are one chunk without edges and are encoded by
the library in the same task.

The vocabulary file's path is a parameter; files are read once per worker from the
path, or shipped as bytes (a vocabulary, not data: about 0.5 MB).

Defined cases: a null text has null pieces and decodes to null; an empty text has
none and decodes to the empty text; the word mark U+2581 in a text, of whatever
length, is encoded as its three bytes (it is a piece of its own, told apart from the
marks that stand for blanks), so decode(encode(t)) equals t for every text; ids outside
the vocabulary make decode raise ValueError, and a text without a path LatticeError;
repeated rows are encoded alike; a null id is kept; an empty table gives no rows;
columns besides id and text are not read, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import picked

MARK = "▁"
BARE = "\ud800"  # stands for a word mark of the text itself; no text can hold a lone surrogate
_CUT = re.compile(r"(?<=[^ ▁]) (?=[^ ▁])")
_EDGE = re.compile(f"(?<=[^{MARK}{BARE}]){MARK}(?=[^{MARK}{BARE}])")


class LatticeError(ValueError):
    """No sequence of pieces leads from one end of a text to the other."""


class Codec:
    """One vocabulary file: pieces, exact encoding of short strings, lattice and matrices."""

    def __init__(self, model: bytes):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_proto=model)
        size = self.library.get_piece_size()
        self.pieces = [self.library.id_to_piece(i) for i in range(size)]
        special = lambda i: self.library.is_control(i) or self.library.is_unknown(i) or self.library.is_unused(i)
        self.bytes = {int(self.pieces[i][3:5], 16): i for i in range(size) if self.library.is_byte(i)}
        self.byte_of = {i: b for b, i in self.bytes.items()}
        self.ids = {p: i for i, p in enumerate(self.pieces) if i not in self.byte_of and not special(i)}
        self.rank = {p: -self.library.get_score(i) for p, i in self.ids.items()}
        self.spelt = [bytes([self.byte_of[i]]) if i in self.byte_of else p.replace(MARK, " ").encode() if p in self.ids else None for i, p in enumerate(self.pieces)]
        self.longest = max(map(len, self.ids))
        self.fits = lru_cache(1 << 15)(self._fits)
        self.whole = lru_cache(1 << 15)(self._whole)

    # -- exact rule on short strings
    def merged(self, text: str) -> list[str]:
        """Merge neighbours, best-ranked result first and leftmost among equals, until none is in the vocabulary."""
        parts = list(text)
        while True:
            best = min(((self.rank[a + b], k) for k, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in self.rank), default=None)
            if best is None:
                return parts
            k = best[1]
            parts[k : k + 2] = [parts[k] + parts[k + 1]]

    def _whole(self, piece: str) -> bool:
        return len(piece) == 1 or piece in self.rank and self.merged(piece) == [piece]

    def _fits(self, a: str, b: str) -> bool:
        return a + b not in self.rank if len(a) + len(b) == 2 else self.merged(a + b) == [a, b]

    def steps(self, text: str, at: int) -> list[int]:
        """Ends of the pieces that start at this place."""
        return [e for e in range(at + 1, min(at + self.longest, len(text)) + 1) if self.whole(text[at:e])]

    # -- lattice; a state is the (start, end) of a piece; weights are 0 or minus infinity, so reachable sets stand for rows
    def paths(self, text: str, start: tuple[int, int], stop: int) -> dict[tuple[int, int], tuple[int, int] | None]:
        """Predecessor of every state reachable from a state, up to the states that cover the place stop (or end there)."""
        came: dict[tuple[int, int], tuple[int, int] | None] = {start: None}
        if start[1] >= stop:
            return came
        todo = {start[1]: [start]}
        for at in range(start[1], stop):
            for state in todo.pop(at, ()):
                piece = text[state[0] : state[1]]
                for end in self.steps(text, at):
                    nxt = (at, end)
                    if nxt not in came and (not piece or self.fits(piece, text[at:end])):
                        came[nxt] = state
                        if end < stop:
                            todo.setdefault(end, []).append(nxt)
        return came

    def edges(self, text: str, at: int) -> list[tuple[int, int]]:
        """Pieces that cover the place before character at: states (start < at <= end)."""
        return [(s, e) for s in range(max(0, at - self.longest), at) for e in self.steps(text, s) if e >= at]

    @staticmethod
    def back(came: dict, state: tuple[int, int]) -> list[tuple[int, int]]:
        out = []
        while state is not None:
            out.append(state)
            state = came[state]
        return out[::-1]

    # -- whole texts
    @staticmethod
    def escaped(text: str) -> str:
        return text.replace(MARK, BARE).replace(" ", MARK)

    @staticmethod
    def plain(full: str) -> str:
        return full.replace(MARK, " ").replace(BARE, MARK)

    def to_ids(self, piece: str) -> list[int]:
        if piece in self.ids:
            return [self.ids[piece]]
        return [self.bytes[b] for b in (MARK if piece == BARE else piece).encode()]

    def encode(self, text: str) -> list[int]:
        """As the library encodes it; a word mark in the text itself becomes bytes."""
        if MARK not in text:
            out: list[int] = []
            at = 0
            while at < len(text):  # blocks of bounded size, cut where no piece spans; the library puts the cut's mark before each block
                cut = _CUT.search(text, at + 256)
                end = cut.start() if cut else len(text)
                out += self.library.encode(text[at:end])
                at = end + 1
            return out
        mark, out = [self.bytes[b] for b in MARK.encode()], []
        for k, part in enumerate(text.split(MARK)):
            if k:
                out += mark
            if part or not k:
                out += self.encode(part) if not k else self.inner(part)
        return out

    def inner(self, text: str) -> list[int]:
        """A part that does not begin the text: without the leading mark that the library adds. What follows the first place that no piece spans has a mark of its own."""
        cut = _CUT.search(text)
        full = self.escaped(text[: cut.start()] if cut else text)
        return [i for s, e in self._route(full) for i in self.to_ids(full[s:e])] + (self.encode(text[cut.end() :]) if cut else [])

    def _route(self, full: str) -> list[tuple[int, int]]:
        came = self.paths(full, (0, 0), len(full))
        ends = [s for s in came if s[1] == len(full) and s != (0, 0)]
        if full and not ends:
            raise LatticeError("a text has no path through its pieces")
        return self.back(came, ends[0])[1:] if ends else []

    def decode(self, ids: list[int]) -> str:
        if ids and not 0 <= min(ids) <= max(ids) < len(self.spelt):
            raise ValueError("an id is outside this vocabulary")
        try:
            text = b"".join(map(self.spelt.__getitem__, ids)).decode()
        except TypeError:
            raise ValueError("an id is no piece of text") from None
        return text[1:] if text.startswith(" ") and ids[0] not in self.byte_of else text


# A chunk is (left margin + body + right margin) of the escaped text, and the lengths of both margins.
def chunk_matrix(c: Codec, text: str, left: int, right: int) -> list[list[int]]:
    """Rows (start, end, start, end), relative to the chunk's edges: from that left state that right state can be reached."""
    stop = len(text) - right
    lefts = c.edges(text, left) if left else [(0, 0)]
    out = []
    cuts = _cuts(c, text, left, stop)
    if cuts:
        heads = [s for s in lefts if s[1] <= cuts[0] and any(x[1] == cuts[0] for x in c.paths(text, s, cuts[0]))]
        tails = c.paths(text, (cuts[-1], cuts[-1]), stop)
        rights = [s for s in tails if s[1] >= stop and s[0] < stop]
        pairs = [(s, e) for s in heads for e in rights]
    else:
        pairs = [(s, e) for s in lefts for e in c.paths(text, s, stop) if e[1] >= stop and e[0] < stop]
    for (a, b), (x, y) in pairs:
        if right or y == stop:
            out.append([a - left, b - left, x - stop, y - stop])
    return out


def _cuts(c: Codec, text: str, left: int, stop: int) -> list[int]:
    """First and last place inside the chunk that no piece spans: before a mark that follows another character."""
    lo, hi = left + c.longest, stop - c.longest
    found = []
    first = _EDGE.search(text, lo, hi)
    if first:
        found.append(first.start())
        for at in range(hi - 1, first.start(), -1):
            if text[at] == MARK and not {text[at - 1], text[at + 1]} & {MARK, BARE}:
                found.append(at)
                break
    return found


def chunk_ids(c: Codec, text: str, left: int, right: int, a: list[int], b: list[int]) -> list[int]:
    """Pieces of a chunk that end after its left edge state, up to and with its right edge state."""
    stop = len(text) - right
    start, end = (a[0] + left, a[1] + left), (b[0] + stop, b[1] + stop)
    cuts = _cuts(c, text, left, stop)
    if cuts:
        head = c.paths(text, start, cuts[0])
        states = c.back(head, next(s for s in head if s[1] == cuts[0]))[1:]
        inner = c.encode(c.plain(text[cuts[0] + 1 : cuts[-1]])) if cuts[-1] > cuts[0] else []
        tail = c.back(c.paths(text, (cuts[-1], cuts[-1]), stop), end)[1:]
    else:
        states, inner, tail = c.back(c.paths(text, start, stop), end)[1:], [], []
    spell = lambda states: [i for s, e in states for i in c.to_ids(text[s:e])]
    return spell(states) + inner + spell(tail)


State = tuple[int, int]
Matrix = dict[State, set[State]]  # the entries that are not minus infinity: left state to right states


def product(first: Matrix, second: Matrix) -> Matrix:
    """The max-plus product of two neighbouring stretches; associative."""
    return {a: to for a, mids in first.items() if (to := set().union(*(second.get(m, ()) for m in mids)))}


def combined(matrices: list[Matrix]) -> list[State]:
    """The state at each edge of a text, the left end (0, 0) first."""
    levels = [matrices]
    while len(levels[-1]) > 1:
        m = levels[-1]
        levels.append([product(m[k], m[k + 1]) if k + 1 < len(m) else m[k] for k in range(0, len(m), 2)])
    ends = levels[-1][0].get((0, 0))
    if not ends:
        raise LatticeError("a text has no path through its pieces")
    spans = [((0, 0), min(ends))]
    for m in reversed(levels[:-1]):
        below = []
        for k, (a, b) in enumerate(spans):
            if 2 * k + 1 < len(m):
                mid = min(s for s in m[2 * k][a] if b in m[2 * k + 1].get(s, ()))
                below += [(a, mid), (mid, b)]
            else:
                below.append((a, b))
        spans = below
    return [(0, 0), *(b for _, b in spans)]


@lru_cache(2)
def codec(model: bytes) -> Codec:
    return Codec(model)


def read_model(path: str) -> bytes:
    with open(path, "rb") as f:  # on the driver; executors get the bytes with the task
        return f.read()


_IDS = "doc_id long, ids array<int>"


def _decoded(c: Codec, ids: list | None) -> str | None:
    return None if ids is None else sha256(c.decode(ids).encode()).hexdigest()


def encode(df: DataFrame, model: bytes, *, id_col="doc_id", text_col="text", giant_chars=65536, chunk_chars=16384, digest=False) -> DataFrame:
    """doc_id and ids (array<int>) for each row of df; with digest also text_sha256, of the text that the ids decode to."""
    rows = picked(df, doc_id=id_col, text=text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    giant = F.length("text") > giant_chars
    names = ["doc_id", "ids", "text_sha256"][: 2 + digest]
    schema = _IDS + ", text_sha256 string" * digest

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model)
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                got = [None if t is None else c.encode(t) for t in part.column("text").to_pylist()]
                proof = [pa.array([_decoded(c, i) for i in got], pa.string())] if digest else []
                got = [None if i is None else np.array(i, dtype=np.int32) for i in got]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(got, pa.list_(pa.int32())), *proof], names)

    def proven(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model)
        for b in batches:
            got = [_decoded(c, i.as_py()) for i in b.column("ids")]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(got, pa.string())], names)

    small = rows.where(F.coalesce(~giant, F.lit(True))).mapInArrow(whole, schema)
    giants = _encode_giants(rows.where(giant), model, chunk_chars)
    return small.unionByName(giants.mapInArrow(proven, schema) if digest else giants)


def _encode_giants(rows: DataFrame, model: bytes, chunk_chars: int) -> DataFrame:
    c = codec(model)
    margin = c.longest
    # Equal giant texts of one id are encoded once and joined back, so the key of a chunk is unique without a generated row number.
    keyed = rows.withColumn("key", F.sha2(F.col("text"), 256))
    dummy = F.when(F.col("text").startswith(MARK), "").otherwise(" ")  # what the library puts first
    marked = keyed.dropDuplicates(["key"]).select("key", F.concat(dummy, F.col("text")).alias("full"))
    n = F.length("full")
    part = F.posexplode(F.sequence(F.lit(0), F.floor((n - 1) / chunk_chars).cast("int"))).alias("chunk", "_")
    lo = F.col("chunk") * chunk_chars
    left = F.least(lo, F.lit(margin))
    right = F.greatest(F.lit(0), F.least(F.lit(margin), n - lo - chunk_chars))
    cut = F.least(F.lit(chunk_chars), n - lo)
    chunks = marked.select("key", "full", part).select("key", "chunk", F.substring("full", lo - left + 1, left + cut + right).alias("body"), left.alias("left"), right.alias("right"))
    chunks = chunks.repartition("key", "chunk")

    def matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model)
        for b in batches:
            d = b.to_pydict()
            m = [[tuple(x) for x in chunk_matrix(c, c.escaped(t), p, q)] for t, p, q in zip(d["body"], d["left"], d["right"], strict=True)]
            m = [[dict(zip("abxy", x, strict=True)) for x in y] for y in m]
            yield pa.RecordBatch.from_arrays([b.column("key"), b.column("chunk"), pa.array(m, pa.list_(pa.struct([(k, pa.int32()) for k in "abxy"])))], ["key", "chunk", "m"])

    def states(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for key, ms in zip(b.column("key").to_pylist(), b.column("ms").to_pylist(), strict=True):
                ms.sort(key=lambda x: x["chunk"])
                matrices: list[Matrix] = [{} for _ in ms]
                for to, m in zip(matrices, ms, strict=True):
                    for x in m["m"]:
                        to.setdefault((x["a"], x["b"]), set()).add((x["x"], x["y"]))
                got = [list(s) for s in combined(matrices)]
                yield pa.RecordBatch.from_arrays([pa.array([key] * len(ms)), pa.array(range(len(ms)), pa.int32()), pa.array(got[:-1], pa.list_(pa.int32())), pa.array(got[1:], pa.list_(pa.int32()))], ["key", "chunk", "a", "b"])

    def traced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model)
        for b in batches:
            d = b.to_pydict()
            got = [chunk_ids(c, c.escaped(t), p, q, x, y) for t, p, q, x, y in zip(d["body"], d["left"], d["right"], d["a"], d["b"], strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("key"), b.column("chunk"), pa.array(got, pa.list_(pa.int32()))], ["key", "chunk", "ids"])

    per_chunk = chunks.mapInArrow(matrices, "key string, chunk int, m array<struct<a:int,b:int,x:int,y:int>>")
    per_text = per_chunk.groupBy("key").agg(F.collect_list(F.struct("chunk", "m")).alias("ms"))  # a few numbers for each chunk of one text
    edge = per_text.mapInArrow(states, "key string, chunk int, a array<int>, b array<int>")
    pieces = chunks.join(edge, ["key", "chunk"]).mapInArrow(traced, "key string, chunk int, ids array<int>")
    whole = pieces.groupBy("key").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("chunk", "ids"))), lambda x: x["ids"])).alias("ids"))
    return keyed.select("doc_id", "key").join(whole, "key").select("doc_id", "ids")


def decode(df: DataFrame, model: bytes, *, id_col="doc_id", ids_col="ids") -> DataFrame:
    """doc_id and text for each row of df."""

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model)
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                got = [None if i is None else c.decode(i) for i in part.column("ids").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(got, pa.string())], ["doc_id", "text"])

    rows = picked(df, doc_id=id_col, ids=ids_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    return rows.mapInArrow(decoded, T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType())]))


def round_trip(df: DataFrame, model: bytes, *, id_col="doc_id", text_col="text", **sizes) -> DataFrame:
    """doc_id, n_pieces, ids, and text_sha256 of the text that the ids decode to."""
    coded = encode(df, model, id_col=id_col, text_col=text_col, digest=True, **sizes)
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_pieces"), "ids", "text_sha256")
