"""Paths and dependences in the control flow of functions.

The graph of one function is bounded by its source, so each is worked on whole in one
task; functions are dealt by one shuffle. Paths are found best first, with a bound on
what is left of each: only what may still be among the best is looked at, however many
paths there are.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from heapq import heappop, heappush

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..engine import frame_operator, sql_operator
from ..plans.dialect import DUCK, Dialect
from .dataflow import _REACH, _usages, d17_def_use
from .graph import EXITS, batched, by_function, one_by_one, walked

Graph = dict[int, dict[int, tuple[int, int]]]  # block -> next block -> cost of going there and steps (1)


def each_function(blocks: DataFrame, edges: DataFrame, block_columns: list[str], edge_columns: list[str], walk: Callable[[list[dict], list[dict]], Iterator[tuple]], schema: dict[str, pa.DataType]) -> DataFrame:
    """symbol_id and the rows that walk(blocks, edges) gives for each function."""
    of = blocks.groupBy("symbol_id").agg(F.collect_list(F.struct(*block_columns)).alias("blocks"))
    steps = edges.groupBy("symbol_id").agg(F.collect_list(F.struct(*edge_columns)).alias("edges"))
    names = ["symbol_id", *schema]

    def walk_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        functions = one_by_one(batches, "symbol_id", "blocks", "edges")
        rows = ((symbol, *row) for symbol, own, pairs in functions for row in walk(own, pairs or []))
        return batched(rows, names, [pa.int64(), *schema.values()])

    spelt = {pa.int64(): "long", pa.int32(): "int", pa.string(): "string", pa.float64(): "double", pa.bool_(): "boolean"}
    return by_function(of, steps, "symbol_id", "blocks", "edges").mapInArrow(walk_all, "symbol_id long, " + ", ".join(f"{n} {spelt[k]}" for n, k in schema.items()))


def components(start: int, out: Graph) -> list[list[int]]:
    """Strongly connected components of what start leads to, those that others lead to first."""
    order: dict[int, int] = {start: 0}
    low, done, found, held, stack = {start: 0}, set(), [], [start], [(start, iter(out.get(start, ())))]
    while stack:
        at, rest = stack[-1]
        for b in rest:
            if b not in order:
                order[b] = low[b] = len(order)
                held.append(b)
                stack.append((b, iter(out.get(b, ()))))
                break
            if b not in done:
                low[at] = min(low[at], order[b])
        else:
            stack.pop()
            if stack:
                low[stack[-1][0]] = min(low[stack[-1][0]], low[at])
            if low[at] == order[at]:
                part = held[held.index(at) :]
                del held[len(held) - len(part) :]
                done.update(part)
                found.append(part)
    return found


def without_returns(start: int, out: Graph) -> Graph:
    """The graph without edges to a block that every way from start to their own block passes: no path that repeats no block takes them."""
    places = {b: k for k, b in enumerate(walked([start], {a: list(x) for a, x in out.items()}))}  # breadth first
    into: dict[int, list[int]] = {}
    for a in places:
        for b in out.get(a, ()):
            into.setdefault(b, []).append(a)
    every = (1 << len(places)) - 1
    before = dict.fromkeys(places, every) | {start: 1 << places[start]}
    changed = True
    while changed:
        changed = False
        for b, k in places.items():
            if b != start:
                new = every
                for a in into[b]:
                    new &= before[a]
                new |= 1 << k
                if new != before[b]:
                    before[b], changed = new, True
    return {a: {b: c for b, c in out.get(a, {}).items() if not before[a] >> places[b] & 1} for a in places}


def bounds(start: int, targets: set[int], out: Graph) -> dict[int, tuple[int, int]]:
    """Of each block that leads from start to a target: a lower bound of cost and steps to one. Exact where it leads to no ring of blocks; a ring counts with all that its blocks may save."""
    into: dict[int, list[int]] = {}
    for a, nxt in out.items():
        for b in nxt:
            into.setdefault(b, []).append(a)
    steps = walked(sorted(targets), into)
    rest: dict[int, tuple[int, int]] = {}
    for part in components(start, {a: {b: c for b, c in nxt.items() if b in steps} for a, nxt in out.items() if a not in targets}):
        own, best = set(part), {}
        for a in part:
            if a in targets:
                best[a] = (0, 0)
            elif some := [(c[0] + rest[b][0], c[1] + rest[b][1]) for b, c in out.get(a, {}).items() if b in rest and b not in own]:
                best[a] = min(some)
        if not best:
            continue
        if len(part) == 1:
            rest |= best
        else:
            inner = [min((c[0] for a in part for x, c in out.get(a, {}).items() if x == b and a in own), default=0) for b in part]
            low = min(x[0] for x in best.values()) + sum(min(c, 0) for c in inner)
            rest |= {a: (low, steps[a]) for a in part}
    return rest


def best_paths(start: int, targets: set[int], out: Graph, k: int) -> list[tuple[int, list[int]]]:
    """The k paths of least cost, then steps, then blocks, that lead from start to the first target they meet and repeat no block: cost and blocks."""
    out = without_returns(start, out)
    rest = bounds(start, targets, out)
    heap = [(*rest[start], (start,), 0)] if start in rest else []
    found = []
    while heap and len(found) < k:
        _, _, path, cost = heappop(heap)
        if path[-1] in targets:
            found.append((cost, list(path)))
            continue
        for b, (more, _) in out.get(path[-1], {}).items():
            if b in rest and b not in path:
                heappush(heap, (cost + more + rest[b][0], len(path) + rest[b][1], (*path, b), cost + more))
    return found


def _exits() -> str:
    return ", ".join(f"'{x}'" for x in EXITS)


def _simple(start: str, carried: dict[str, tuple[str, str]], edges: str = "block_edges") -> str:
    """An oracle's table p of all paths from blocks of a condition on that repeat no block and end at the first exit; carried: columns, their first value and the next one."""
    first = "".join(f", {a} AS {c}" for c, (a, _) in carried.items())
    more = "".join(f", {b}" for _, b in carried.values())
    return f"""WITH RECURSIVE p AS (SELECT b.symbol_id, b.id AS first, b.id AS last, b.block_type, [b.id] AS nodes{first} FROM blocks b WHERE {start}
        UNION ALL SELECT p.symbol_id, p.first, b.id, b.block_type, list_append(p.nodes, b.id){more} FROM p JOIN {edges} e ON e.from_id = p.last AND e.symbol_id = p.symbol_id JOIN blocks b ON b.id = e.to_id WHERE p.block_type NOT IN ({_exits()}) AND NOT list_contains(p.nodes, b.id))"""


@frame_operator(
    "blocks block_edges",
    lambda d: _simple("b.block_type = 'entry'", {"complexity": ("coalesce(b.complexity, 0)", "p.complexity + coalesce(b.complexity, 0)")}, "(SELECT DISTINCT symbol_id, from_id, to_id FROM block_edges)")
    + f" SELECT symbol_id, CAST(row_number() OVER (PARTITION BY symbol_id ORDER BY complexity DESC, len(nodes), nodes) AS INTEGER) AS rank, array_to_string(nodes, '>') AS path, CAST(complexity AS BIGINT) AS complexity, CAST(len(nodes) AS BIGINT) AS length FROM p WHERE block_type IN ({_exits()}) QUALIFY rank <= 5",
)
def p29_hot_paths(t: dict[str, DataFrame], top: int = 5) -> DataFrame:
    """Of each function the paths of most complexity from an entry to an exit (ties: the shorter, then by blocks); no block twice on a path."""

    def walk(blocks: list[dict], edges: list[dict]) -> Iterator[tuple]:
        weight = {b["id"]: b["complexity"] or 0 for b in blocks}
        out: Graph = {}
        for e in edges:
            if e["to_id"] in weight:
                out.setdefault(e["from_id"], {})[e["to_id"]] = (-weight[e["to_id"]], 1)
        ends = {b["id"] for b in blocks if b["block_type"] in EXITS}
        found = [(cost - weight[s], len(path), path) for s in sorted({b["id"] for b in blocks if b["block_type"] == "entry"}) for cost, path in best_paths(s, ends, out, top)]
        for k, (cost, length, path) in enumerate(sorted(found)[:top]):
            yield k + 1, ">".join(map(str, path)), -cost, length

    schema = {"rank": pa.int32(), "path": pa.string(), "complexity": pa.int64(), "length": pa.int64()}
    return each_function(t["blocks"], t["block_edges"], ["id", "block_type", "complexity"], ["from_id", "to_id"], walk, schema)


def _shortest_sql() -> str:
    inner = "(SELECT DISTINCT symbol_id, from_id, to_id FROM block_edges)"
    condition = "CASE WHEN b.block_type IN ('conditional', 'condition', 'loop', 'switch') AND coalesce(b.code, '') <> '' THEN [b.code] ELSE [] END"
    carried = {"conditions": (condition, f"list_concat(p.conditions, {condition})"), "complexity": ("coalesce(b.complexity, 0)", "p.complexity + coalesce(b.complexity, 0)")}
    return _simple("b.block_type = 'entry'", carried, inner) + f""" SELECT q.symbol_id, first AS entry_id, last AS exit_id, array_to_string(nodes, '>') AS path, array_to_string(conditions, ' && ') AS conditions, CAST(complexity AS BIGINT) AS complexity,
        EXISTS (SELECT 1 FROM block_edges e WHERE e.symbol_id = q.symbol_id AND list_contains(nodes, e.from_id) AND list_contains(nodes, e.to_id) AND list_position(nodes, e.to_id) < list_position(nodes, e.from_id)) AS is_cyclic
        FROM (SELECT * FROM p WHERE block_type IN ({_exits()}) QUALIFY row_number() OVER (PARTITION BY symbol_id, first, last ORDER BY len(nodes), nodes) = 1) q"""


@frame_operator("blocks block_edges", lambda d: _shortest_sql())
def p30_shortest_paths(t: dict[str, DataFrame]) -> DataFrame:
    """From each entry of a function to each exit the shortest path (ties: by blocks), the code of its conditions and loops, its complexity, and whether an edge leads back along it. A path ends at the first exit."""

    def walk(blocks: list[dict], edges: list[dict]) -> Iterator[tuple]:
        of = {b["id"]: b for b in blocks}
        out: Graph = {}
        for e in edges:
            if e["to_id"] in of:
                out.setdefault(e["from_id"], {})[e["to_id"]] = (1, 1)
        ends = {b["id"] for b in blocks if b["block_type"] in EXITS}
        for start in sorted(b["id"] for b in blocks if b["block_type"] == "entry"):
            for end in sorted(ends):
                inner = {a: {b: c for b, c in nxt.items() if b == end or b not in ends} for a, nxt in out.items()}
                for _, path in best_paths(start, {end}, inner, 1):
                    place = {b: k for k, b in enumerate(path)}
                    said = [of[b]["code"] for b in path if of[b]["block_type"] in ("conditional", "condition", "loop", "switch") and of[b]["code"]]
                    back = any(place.get(e["to_id"], len(path)) < place.get(e["from_id"], -1) for e in edges)
                    yield start, end, ">".join(map(str, path)), " && ".join(said), sum(of[b]["complexity"] or 0 for b in path), back

    schema = {"entry_id": pa.int64(), "exit_id": pa.int64(), "path": pa.string(), "conditions": pa.string(), "complexity": pa.int64(), "is_cyclic": pa.bool_()}
    return each_function(t["blocks"], t["block_edges"], ["id", "block_type", "complexity", "code"], ["from_id", "to_id"], walk, schema)


#: How likely an edge of a kind is taken, any other being certain, and the factor of those that leave a loop.
LIKELY = {"true": 0.7, "false": 0.3, "exception": 0.05, "loop-back": 0.8}
LEAVES_LOOP = 0.2
#: Time of a block by its type, and of any other.
TIMES = {"loop": 50, "condition": 5, "conditional": 5, "statement": 1, "basic": 1}
OTHER_TIME = 2
CRITICAL = ("loop", "condition", "conditional")


def _likely_sql() -> str:
    kinds = " ".join(f"WHEN '{k}' THEN {p}e0" for k, p in LIKELY.items())
    return f"(CASE e.kind {kinds} ELSE 1e0 END * CASE WHEN f.block_type = 'loop' AND e.kind <> 'loop-back' THEN {LEAVES_LOOP}e0 ELSE 1e0 END)"


def _hot_sql(paths: int = 5) -> str:
    time = "CASE b.block_type " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in TIMES.items()) + f" ELSE {OTHER_TIME} END"
    critical = f"CASE WHEN b.block_type IN ({', '.join(repr(x) for x in CRITICAL)}) THEN 1 ELSE 0 END"
    carried = {"likely": ("1e0", "p.likely * e.likely"), "cost": ("CAST(0 AS BIGINT)", "p.cost + e.cost"), "t": (time, f"p.t + {time}"), "critical": (critical, f"p.critical + {critical}"), "caught": ("b.block_type = 'catch'", "p.caught OR b.block_type = 'catch'")}
    edges = f"(SELECT e.symbol_id, from_id, to_id, max({_likely_sql()}) AS likely, min(CAST(round(-1e6 * ln({_likely_sql()})) AS BIGINT)) AS cost FROM block_edges e JOIN blocks f ON f.id = e.from_id GROUP BY e.symbol_id, from_id, to_id)"
    first = "b.id IN (SELECT arg_min(id, (start_line, id)) FROM blocks WHERE block_type = 'entry' GROUP BY symbol_id)"
    return (
        _simple(first, carried, edges)
        + f""" SELECT symbol_id, last AS exit_id, CAST(row_number() OVER (PARTITION BY symbol_id, last ORDER BY cost, len(nodes), nodes) AS INTEGER) AS rank, array_to_string(nodes, '>') AS path, round(likely, 6) AS probability,
        CASE WHEN row_number() OVER (PARTITION BY symbol_id, last ORDER BY cost, len(nodes), nodes) = 1 THEN 'main' WHEN caught THEN 'error' WHEN len(nodes) BETWEEN 3 AND 4 THEN 'early-exit' ELSE 'alternative' END AS type, CAST(t AS BIGINT) AS estimated_time, CAST(critical AS BIGINT) AS critical_nodes
        FROM p WHERE block_type IN ({_exits()}) QUALIFY rank <= {paths}"""
    )


@frame_operator("blocks block_edges", lambda d: _hot_sql())
def d13_hot_paths(t: dict[str, DataFrame], paths: int = 5) -> DataFrame:
    """The most likely paths from a function's first entry to each of its exits, by the kinds of their edges.

    A path's likelihood is the product of its edges'; paths are ordered by the sum of their logarithms (in
    millionths), then length, then blocks. No block stands twice on a path, so a loop counts once. The first
    is the main path; others are of errors (over a catch block), early exits (3 or 4 blocks) or alternatives.
    """

    def walk(blocks: list[dict], edges: list[dict]) -> Iterator[tuple]:
        kind = {b["id"]: b["block_type"] for b in blocks}
        likely: dict[tuple[int, int], float] = {}
        for e in edges:
            if e["from_id"] in kind and e["to_id"] in kind:
                p = LIKELY.get(e["kind"], 1.0) * (LEAVES_LOOP if kind[e["from_id"]] == "loop" and e["kind"] != "loop-back" else 1.0)
                likely[e["from_id"], e["to_id"]] = max(p, likely.get((e["from_id"], e["to_id"]), 0.0))
        out: Graph = {}
        for (a, b), p in likely.items():
            out.setdefault(a, {})[b] = (math.floor(-1e6 * math.log(p) + 0.5), 1)
        ends = {b["id"] for b in blocks if b["block_type"] in EXITS}
        start = min(((b["start_line"], b["id"]) for b in blocks if b["block_type"] == "entry"), default=None)
        for end in sorted(ends) if start else ():
            inner = {a: {b: c for b, c in nxt.items() if b == end or b not in ends} for a, nxt in out.items()}  # a path ends at the first exit
            for k, (_, path) in enumerate(best_paths(start[1], {end}, inner, paths)):
                types = [kind[b] for b in path]
                shape = "main" if k == 0 else "error" if "catch" in types else "early-exit" if 3 <= len(path) <= 4 else "alternative"
                probability = math.prod(likely[x] for x in zip(path, path[1:], strict=False))
                yield end, k + 1, ">".join(map(str, path)), round(probability, 6), shape, sum(TIMES.get(x, OTHER_TIME) for x in types), sum(x in CRITICAL for x in types)

    schema = {"exit_id": pa.int64(), "rank": pa.int32(), "path": pa.string(), "probability": pa.float64(), "type": pa.string(), "estimated_time": pa.int64(), "critical_nodes": pa.int64()}
    return each_function(t["blocks"], t["block_edges"], ["id", "block_type", "start_line"], ["from_id", "to_id", "kind"], walk, schema)


def post_dominators(blocks: list[int], out: dict[int, list[int]], exits: set[int]) -> dict[int, int]:
    """Of each block that leads to an exit: the blocks, as bits of their places, that every way from it to an exit passes, itself among them."""
    place = {b: k for k, b in enumerate(blocks)}
    into: dict[int, list[int]] = {}
    for a, nxt in out.items():
        for b in nxt:
            into.setdefault(b, []).append(a)
    order = list(walked(sorted(exits), into))
    after = {b: 1 << place[b] if b in exits else -1 for b in order}
    changed = True
    while changed:
        changed = False
        for b in order:
            if b not in exits:
                new = -1
                for x in out.get(b, ()):
                    if x in after:
                        new &= after[x]
                new |= 1 << place[b]
                if new != after[b]:
                    after[b], changed = new, True
    return after


def control_dependences(blocks: DataFrame, edges: DataFrame) -> DataFrame:
    """symbol_id, from_id, to_id and kind: whether to_id runs is decided by the edge of that kind that from_id takes.

    A block depends on an edge if it is passed on every way from the edge's end to an exit, but not on every way
    from its beginning. Exits are blocks of a type that ends a function, and those without an edge; blocks that
    lead to no exit take no part.
    """

    def walk(own: list[dict], pairs: list[dict]) -> Iterator[tuple]:
        ids = sorted({b["id"] for b in own})
        out: dict[int, list[int]] = {}
        for e in pairs:
            out.setdefault(e["from_id"], []).append(e["to_id"])
        exits = {b["id"] for b in own if b["block_type"] in EXITS or b["id"] not in out}
        out = {a: nxt for a, nxt in out.items() if a not in exits}
        after = post_dominators(ids, out, exits)
        place = {b: k for k, b in enumerate(ids)}
        rows = set()
        for e in pairs:
            a, b = e["from_id"], e["to_id"]
            if a in after and b in after and a not in exits:
                left = after[b] & ~(after[a] & ~(1 << place[a]))
                while left:
                    bit = left & -left
                    rows.add((a, ids[bit.bit_length() - 1], e["kind"]))
                    left ^= bit
        yield from sorted(rows)

    return each_function(blocks, edges, ["id", "block_type"], ["from_id", "to_id", "kind"], walk, {"from_id": pa.int64(), "to_id": pa.int64(), "kind": pa.string()})


def _dependence_sql() -> str:
    """Oracle: of each pair of blocks of a function, whether the second leads to an exit without the first."""
    return f"""WITH RECURSIVE usages AS ({_usages(DUCK)}), {_REACH},
    ends AS (SELECT symbol_id, id FROM blocks b WHERE block_type IN ({_exits()}) OR NOT EXISTS (SELECT 1 FROM block_edges e WHERE e.from_id = b.id)),
    leads(symbol_id, id) AS (SELECT symbol_id, id FROM ends UNION SELECT e.symbol_id, e.from_id FROM leads l JOIN block_edges e ON e.to_id = l.id WHERE e.from_id NOT IN (SELECT id FROM ends)),
    avoids(b, id) AS (SELECT b.id, e.id FROM ends e JOIN blocks b ON b.symbol_id = e.symbol_id AND b.id <> e.id UNION SELECT a.b, e.from_id FROM avoids a JOIN block_edges e ON e.to_id = a.id WHERE e.from_id <> a.b AND e.from_id NOT IN (SELECT id FROM ends)),
    passes AS (SELECT l.id, b.id AS by FROM leads l JOIN blocks b ON b.symbol_id = l.symbol_id WHERE NOT EXISTS (SELECT 1 FROM avoids a WHERE a.b = b.id AND a.id = l.id)),
    control AS (SELECT DISTINCT e.symbol_id, e.from_id, y.by AS to_id, e.kind FROM block_edges e JOIN passes y ON y.id = e.to_id JOIN leads l ON l.id = e.from_id LEFT JOIN passes x ON x.id = e.from_id AND x.by = y.by AND x.by <> e.from_id WHERE x.id IS NULL AND e.from_id NOT IN (SELECT id FROM ends))
    SELECT symbol_id, from_id, to_id, 'control' AS type, string_agg(kind, ',' ORDER BY kind) AS through FROM control GROUP BY symbol_id, from_id, to_id
    UNION ALL SELECT symbol_id, from_id, to_id, 'data' AS type, string_agg(DISTINCT name, ',' ORDER BY name) AS through FROM flows GROUP BY symbol_id, from_id, to_id"""


@frame_operator("symbols blocks block_edges", lambda d: _dependence_sql())
def d18_dependencies(t: dict[str, DataFrame]) -> DataFrame:
    """Which block of a function depends on which: for control (through: the kinds of the deciding edges) and for data (through: the variables that flow)."""
    sorted_list = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",").alias("through")
    keys = ["symbol_id", "from_id", "to_id"]
    control = control_dependences(t["blocks"], t["block_edges"]).groupBy(*keys).agg(sorted_list("kind"))
    data = d17_def_use(t).groupBy(*keys).agg(sorted_list("name"))
    return control.select(*keys, F.lit("control").alias("type"), "through").unionAll(data.select(*keys, F.lit("data").alias("type"), "through"))


def _parameters(d: Dialect) -> str:
    """id, position (from 0), type and name of each parameter that stands between the first parentheses of a signature, split at commas outside angle brackets."""
    bare = d.extract("signature", r"\(([^)]*)\)")
    for _ in range(3):
        bare = d.replace(bare, "<[^<>]*>", "")
    parts = d.split(bare, ",")
    each = f"posexplode({parts}) AS (position, part)" if d.spark else f"unnest({parts}) AS part, unnest(range(len({parts}))) AS position"
    name = d.extract("trim(part)", r"([A-Za-z0-9_]+)$")
    kind = d.extract("trim(part)", r"^(.*[^A-Za-z0-9_])[A-Za-z0-9_]+$")
    return f"SELECT id, CAST(position AS BIGINT) AS position, trim({kind}) AS type, {name} AS name FROM (SELECT id, {each} FROM symbols) p WHERE trim(part) <> ''"


@sql_operator
def d18_parameter_flow(d: Dialect) -> str:
    """Of each parameter of a function with blocks: its place, where it is read and changed, and whether it is returned or handed on to a call."""
    n = "count(*) FILTER (WHERE u.kind {}) AS {}".format
    some = "count(*) FILTER (WHERE u.{0}) > 0 AS {0}".format
    return f"""SELECT p.id AS symbol_id, p.position, p.name, p.type, {n("= 'read'", "reads")}, {n("IN ('write', 'modify')", "changes")}, {some('is_returned')}, {some('is_passed')} FROM ({_parameters(d)}) p
        LEFT JOIN ({_usages(d)}) u ON u.symbol_id = p.id AND u.name = p.name AND u.scope = 'parameter' WHERE p.id IN (SELECT symbol_id FROM blocks) GROUP BY p.id, p.position, p.name, p.type"""


@sql_operator
def d18_argument_binding(d: Dialect) -> str:
    """Of each argument of a call site the parameter of the called function that it becomes; surplus arguments have none, parameters that no argument meets are not listed."""
    return f"SELECT a.caller_id, a.callee_id, a.line_number, a.position, a.argument, p.name AS parameter, p.type FROM arguments a LEFT JOIN ({_parameters(d)}) p ON p.id = a.callee_id AND p.position = a.position"
