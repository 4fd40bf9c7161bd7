"""Intervals of lines: points in blocks, nested blocks, depth of trees.

Points meet the intervals they lie in by buckets of lines: an interval stands in each
bucket it touches, a point in its own, so a function of any length is no all-pairs
comparison; the exact lines are checked after. Depth in a tree of parents is found by
doubling: each round a node jumps as far as it has come, so chains take few rounds and
rings are recognised by never ending.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..engine import frame_operator
from ..plans import rules
from ..plans.dialect import Dialect
from ..sources.braces import _TOKEN
from ..storage import dropped, written

BUCKET = 64  # lines


def inside(points: DataFrame, blocks: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """Rows of points (symbol_id, line, ...) with those of blocks (symbol_id, start_line, end_line, ...) of their symbol that their line lies in."""
    spread = blocks.where("start_line <= end_line").withColumn("bucket", F.explode(F.sequence(F.floor(F.col("start_line") / bucket), F.floor(F.col("end_line") / bucket))))
    own = points.withColumn("bucket", F.floor(F.col("line") / bucket))
    return own.join(spread, ["symbol_id", "bucket"]).where("line BETWEEN start_line AND end_line").drop("bucket")


@frame_operator("blocks call_lines", lambda d: "SELECT DISTINCT b.id AS block_id, c.callee_id FROM blocks b JOIN call_lines c ON c.caller_id = b.symbol_id AND c.line_number BETWEEN b.start_line AND coalesce(b.end_line, b.start_line)", calls="call_lines")
def d41_navigation_targets(t: dict[str, DataFrame], calls: str = "calls") -> DataFrame:
    """What the calls on a block's lines lead to, once for each block."""
    points = t[calls].select(F.col("caller_id").alias("symbol_id"), "callee_id", F.col("line_number").alias("line"))
    blocks = t["blocks"].select("symbol_id", F.col("id").alias("block_id"), "start_line", F.coalesce("end_line", "start_line").alias("end_line"))
    return inside(points, blocks).select("block_id", "callee_id").distinct()


def _listed(words: list[str]) -> str:
    return "(" + " OR ".join(f"contains(lower(code), '{w}')" for w in words) + ")"


#: Iterations of a loop over a collection, of one with a bare condition, and of any other; how much more a nested loop runs; and what is severe.
COLLECTION, CONDITION, OTHERS, NESTED = 100, 50, 10, 10
SEVERE = "CASE WHEN estimated_time > 10000 THEN 'critical' WHEN estimated_time > 1000 THEN 'high' WHEN estimated_time > 100 THEN 'medium' ELSE 'low' END"
_RUNS = f"CASE WHEN contains(code, 'size()') OR contains(code, 'length') THEN {COLLECTION} WHEN contains(code, 'while') THEN {CONDITION} ELSE {OTHERS} END"
_OTHERS = [("io", rules.IO_WORDS, "medium"), ("synchronization", rules.SYNC_WORDS, "high"), ("memory", rules.MEMORY_WORDS, "medium")]


def _bottleneck_sql(d: Dialect) -> str:
    body = f"""SELECT l.id, l.symbol_id, {_RUNS.replace('code', 'l.code')} * CASE WHEN count(b.id) FILTER (WHERE b.block_type = 'loop' AND b.start_line > l.start_line AND b.start_line < coalesce(l.end_line, l.start_line + 10)) > 0 THEN {NESTED} ELSE 1 END AS iterations, count(b.id) AS body
        FROM blocks l LEFT JOIN blocks b ON b.symbol_id = l.symbol_id AND b.id <> l.id AND b.start_line BETWEEN l.start_line AND coalesce(l.end_line, l.start_line + 10) WHERE l.block_type = 'loop' GROUP BY l.id, l.symbol_id, l.code"""
    rest = " UNION ALL ".join(f"SELECT id, symbol_id, '{k}' AS type, '{s}' AS severity, CAST(NULL AS BIGINT) AS body, CAST(NULL AS BIGINT) AS iterations, CAST(NULL AS BIGINT) AS estimated_time FROM blocks WHERE {_listed(w)}" for k, w, s in _OTHERS)
    return f"SELECT id, symbol_id, 'cpu' AS type, {SEVERE} AS severity, body, CAST(iterations AS BIGINT) AS iterations, CAST(estimated_time AS BIGINT) AS estimated_time FROM (SELECT *, body * iterations AS estimated_time FROM ({body}) x) y WHERE estimated_time > 100 UNION ALL {rest}"


@frame_operator("blocks", _bottleneck_sql)
def d14_bottlenecks(t: dict[str, DataFrame]) -> DataFrame:
    """Blocks that may be slow: loops by the blocks on their lines times how often they may run (more where a loop is nested), and blocks whose code has words of input and output, of waiting, or of memory."""
    blocks = t["blocks"].select("id", "symbol_id", "block_type", "start_line", "end_line", "code")
    loops = blocks.where("block_type = 'loop'").select(F.col("id").alias("loop_id"), "symbol_id", "start_line", F.coalesce("end_line", F.col("start_line") + 10).alias("end_line"))
    points = blocks.select("symbol_id", F.col("start_line").alias("line"), "id", "block_type")
    nested = F.count_if((F.col("block_type") == "loop") & (F.col("line") > F.col("start_line")) & (F.col("line") < F.col("end_line"))) > 0
    body = inside(points, loops).where("id != loop_id").groupBy("loop_id").agg(F.count("*").alias("body"), nested.alias("nested"))
    cost = blocks.join(body, blocks["id"] == body["loop_id"]).withColumn("iterations", (F.coalesce(F.expr(_RUNS), F.lit(OTHERS)) * F.when(F.col("nested"), NESTED).otherwise(1)).cast("long"))
    cost = cost.withColumn("estimated_time", F.col("body") * F.col("iterations")).where("estimated_time > 100")
    out = cost.select("id", "symbol_id", F.lit("cpu").alias("type"), F.expr(SEVERE).alias("severity"), "body", "iterations", "estimated_time")
    empty = [F.lit(None).cast("long").alias(c) for c in ("body", "iterations", "estimated_time")]
    for kind, words, severity in _OTHERS:
        out = out.unionAll(blocks.where(_listed(words)).select("id", "symbol_id", F.lit(kind).alias("type"), F.lit(severity).alias("severity"), *empty))
    return out


def tree_depths(nodes: DataFrame) -> DataFrame:
    """id and depth (0: no parent) of nodes (id, parent_id); null in or below a ring of parents. A parent that is no node counts as none."""
    here = nodes.select(F.col("id").alias("parent_id"), F.lit(True).alias("known"))
    rows = nodes.select("id", "parent_id").join(here, "parent_id", "left")
    level = written(rows.select("id", F.when(F.col("known"), F.col("parent_id")).alias("up"), F.col("known").isNotNull().cast("long").alias("depth")), "depths")
    rounds = max(level.count().bit_length(), 1)
    for _ in range(rounds):
        if level.where("up IS NOT NULL").isEmpty():
            break
        above = level.select(F.col("id").alias("up"), F.col("up").alias("higher"), F.col("depth").alias("more"))
        new = level.join(above, "up", "left").select("id", F.col("higher").alias("up"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"))
        new = written(new, "depths")
        dropped(level)
        level = new
    return level.select("id", F.when(F.col("up").isNull(), F.col("depth")).alias("depth"))


@frame_operator(
    "blocks",
    lambda d: """WITH RECURSIVE t(id, symbol_id, block_type, depth) AS (SELECT id, symbol_id, block_type, CAST(0 AS BIGINT) FROM blocks WHERE parent_id IS NULL OR parent_id NOT IN (SELECT id FROM blocks) UNION ALL SELECT b.id, b.symbol_id, b.block_type, t.depth + 1 FROM t JOIN blocks b ON b.parent_id = t.id)
        SELECT b.symbol_id, count(*) AS blocks, count(*) FILTER (WHERE b.block_type IN ('conditional', 'condition')) AS conditional_blocks, count(*) FILTER (WHERE b.block_type = 'loop') AS loop_blocks, count(*) FILTER (WHERE b.block_type IN ('try', 'catch', 'finally')) AS exception_blocks, max(t.depth) AS max_nesting_depth, count(*) FILTER (WHERE t.id IS NULL) AS in_rings
        FROM blocks b LEFT JOIN t ON t.id = b.id GROUP BY b.symbol_id""",
)
def p31_nesting(t: dict[str, DataFrame]) -> DataFrame:
    """Of each function: blocks by kind, the greatest depth of its tree of blocks, and blocks that stand in or below a ring of parents, which have no depth."""
    depths = tree_depths(t["blocks"])
    kinds = {"conditional_blocks": ("conditional", "condition"), "loop_blocks": ("loop",), "exception_blocks": ("try", "catch", "finally")}
    rows = t["blocks"].select("id", "symbol_id", "block_type").join(depths, "id")
    return rows.groupBy("symbol_id").agg(F.count("*").alias("blocks"), *[F.count_if(F.col("block_type").isin(*k)).alias(n) for n, k in kinds.items()], F.max("depth").alias("max_nesting_depth"), F.count_if(F.col("depth").isNull()).alias("in_rings"))


# --- Blocks of a text
#: Words that begin a block, and its type; those of Python stand at a line's beginning.
STARTS = {"if": "conditional", "elif": "conditional", "while": "loop", "for": "loop", "foreach": "loop", "do": "loop", "loop": "loop", "switch": "switch", "match": "switch", "try": "try", "catch": "catch", "except": "catch", "finally": "finally", "return": "return", "throw": "throw", "raise": "throw"}
_OPEN = {"conditional", "loop", "switch", "try", "catch", "finally"}
_NO_CALLS = frozenset("if else elif while for foreach do switch case try catch except finally return raise throw with pass break continue def class lambda yield assert sizeof typeof new delete namespace using instanceof async await function interface type enum declare match loop fn func impl synchronized noexcept defer go select".split())
_PYTHON = re.compile(r"([ \t]*)(?:async[ \t]+)?(if|elif|else|while|for|match|try|except|finally|return|raise)\b[ \t]*([^\n]*)")


class Block:
    """A block being read: its type, first line, condition, and the depth of braces (or the indent) it stands at."""

    def __init__(self, kind: str, line: int, condition: str, depth: int):
        self.kind, self.line, self.condition, self.depth = kind, line, condition, depth
        self.end, self.opened = line, False


def brace_blocks(text: str) -> tuple[list[tuple[str, int, int, str]], list[tuple[str, int]]]:
    """(type, first line, last line, condition) of each block, and (name, line) of each call, of a text whose blocks stand in braces; strings and comments are passed over."""
    tokens = [(m.lastgroup, m[0], m.start()) for m in _TOKEN.finditer(text) if m.lastgroup not in ("skip", "directive")]
    found: list[Block] = []
    waiting: list[Block] = []  # begun, and neither opened nor ended
    held: list[Block] = []  # opened by a brace
    calls: list[tuple[str, int]] = []
    line, depth, k = 1, 0, 0
    at = 0
    while k < len(tokens):
        kind, word, start = tokens[k]
        line += text.count("\n", at, start)
        at = start
        if kind == "word" and word in STARTS and (k == 0 or tokens[k - 1][1] not in (".", "->", "::")):
            condition, last = "", k
            if k + 1 < len(tokens) and tokens[k + 1][1] == "(" and STARTS[word] not in ("return", "throw"):
                level, last = 0, k + 1
                while last < len(tokens):
                    level += (tokens[last][1] == "(") - (tokens[last][1] == ")")
                    if not level:
                        break
                    last += 1
                close = tokens[min(last, len(tokens) - 1)][2]
                condition = text[tokens[k + 1][2] + 1 : close].strip()
            block = Block(STARTS[word], line, " ".join(condition.split()), depth)
            found.append(block)
            if block.kind in _OPEN:
                waiting.append(block)
                calls += [(w, line + text.count("\n", start, p)) for (g, w, p), nxt in zip(tokens[k + 1 : last], tokens[k + 2 : last + 1], strict=False) if g == "word" and nxt[1] == "(" and w not in _NO_CALLS]
                k = last + 1
                continue
        elif kind == "word" and word not in _NO_CALLS and k + 1 < len(tokens) and tokens[k + 1][1] == "(":
            calls.append((word, line))
        elif word == "{" and kind == "mark":
            if waiting and not waiting[-1].opened and waiting[-1].depth == depth:
                waiting[-1].opened = True
                held.append(waiting.pop())
            depth += 1
        elif word == "}" and kind == "mark":
            depth = max(depth - 1, 0)
            for b in [b for b in waiting if b.depth > depth]:
                b.end = line
            waiting = [b for b in waiting if b.depth <= depth]
            while held and held[-1].depth >= depth:
                held.pop().end = line
                while waiting and waiting[-1].depth >= depth:  # if (x) for (...) { }: the loop is the whole of what the condition guards
                    waiting.pop().end = line
        elif word == ";" and kind == "mark":
            while waiting and waiting[-1].depth == depth:
                waiting.pop().end = line
        k += 1
    last = line + text.count("\n", at)
    for b in (*held, *waiting):  # cut off: open to the text's end
        b.end = last
    return [(b.kind, b.line, b.end, b.condition) for b in found], calls


def indented_blocks(text: str) -> tuple[list[tuple[str, int, int, str]], list[tuple[str, int]]]:
    """The same of a text whose blocks are indented; what stands in triple quotes or after a hash is passed over."""
    blank = lambda m: "\n" * m[0].count("\n")
    bare = re.sub(r"""("{3}|'{3})[\s\S]*?(?:\1|\Z)|#[^\n]*|"(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*'""", blank, text)
    found, held, calls, last = [], [], [], 1
    for number, line in enumerate(bare.split("\n"), 1):
        if not line.strip():
            continue
        indent = len(line) - len(line.lstrip())
        while held and held[-1].depth >= indent:
            held.pop().end = last
        last = number
        if (m := _PYTHON.match(line)) and m[2] != "else":
            opens = STARTS[m[2]] in _OPEN
            block = Block(STARTS[m[2]], number, " ".join(m[3].rsplit(":", 1)[0].split()) if opens else "", indent)
            found.append(block)
            if opens:
                held.append(block)
        calls += [(m[1], number) for m in re.finditer(r"\b([A-Za-z_][A-Za-z0-9_]*)[ \t]*\(", line) if m[1] not in _NO_CALLS and not re.search(r"\b(?:def|class)[ \t]+$", line[: m.start()])]
    for b in held:
        b.end = last
    return [(b.kind, b.line, b.end, b.condition) for b in found], calls


def nested(spans: list[tuple[int, int]]) -> list[tuple[int | None, int]]:
    """The place of the innermost interval around each (they come sorted by start, the longer first), and how many are around it: a stack of those that are open."""
    out, held = [], []
    for k, (start, end) in enumerate(spans):
        while held and (spans[held[-1]][1] < start or spans[held[-1]][1] < end):
            held.pop()
        out.append((held[-1] if held else None, len(held)))
        held.append(k)
    return out


def _read(path: str | None, text: str | None):
    return (indented_blocks if (path or "").endswith(".py") else brace_blocks)(text or "")


def _of_texts(sources: DataFrame, rows_of, schema: str, types: list[pa.DataType]) -> DataFrame:
    names = [c.split()[0] for c in schema.split(", ")]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, path, text in zip(*(b.column(c).to_pylist() for c in ("id", "path", "text")), strict=True):
                columns = list(zip(*((i, *row) for row in rows_of(*_read(path, text))), strict=True)) or [()] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, types, strict=True)], names)

    return sources.select("id", "path", "text").mapInArrow(read, schema)


@frame_operator("sources")
def p27_blocks(t: dict[str, DataFrame]) -> DataFrame:
    """Blocks of each text (by indent in Python, else by braces): place, type, first and last line, condition, the block around it and depth. Null texts have none."""

    def rows(blocks, _):
        order = sorted(blocks, key=lambda b: (b[1], -b[2]))
        for k, (b, (parent, depth)) in enumerate(zip(order, nested([(b[1], b[2]) for b in order]), strict=True)):
            yield k + 1, b[0], b[1], b[2], b[3], None if parent is None else parent + 1, depth

    schema = "id long, place long, type string, start_line long, end_line long, condition string, parent long, depth long"
    return _of_texts(t["sources"], rows, schema, [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64()])


@frame_operator("sources")
def p27_calls(t: dict[str, DataFrame]) -> DataFrame:
    """Calls of each text by name and line; words of control flow are none."""
    return _of_texts(t["sources"], lambda _, calls: calls, "id long, name string, line long", [pa.int64(), pa.string(), pa.int64()])
