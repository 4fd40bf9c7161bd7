"""Reachability, paths, components and cycles.

Reachability is an iterative frontier: one join with the edges, a distinct and an
anti-join with what is visited in each round, so what is carried is vertices and
not walks. Rounds are bounded or end with an empty frontier; tables between rounds
are written to the shared folder. Paths are enumerated only where the question is
about paths, along deduplicated edges and with a bound on depth.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..engine import frame_operator, sql_operator
from ..plans.dialect import Dialect
from ..storage import dropped, written
from .components import connected_components


class Reached:
    """What edges (a, b) lead to from seeds (seed) in at most depth steps (any number, if that is None).

    Seeds in the order of their ids stand in lots of 64, a bit each, so that one row (lot, id, depth, mask) tells of
    all seeds of a lot that first meet a vertex at that depth, and an edge is gone along once for all of them.
    """

    def __init__(self, edges: DataFrame, seeds: DataFrame, depth: int | None = None):
        self.deepest = 0
        self.edges = written(edges.select(F.col("a").alias("_a"), F.col("b").alias("_b")).where("_a IS NOT NULL AND _b IS NOT NULL").distinct(), "edges")
        numbered = seeds.select("seed").distinct().orderBy("seed").withColumn("n", F.monotonically_increasing_id())  # dense in a partition
        self.seeds = written(numbered.select("seed", F.shiftright("n", 6).alias("lot"), F.col("n").bitwiseAND(63).cast("int").alias("bit")), "seeds")
        frontier = self.seeds.groupBy("lot", F.col("seed").alias("id")).agg(F.expr("bit_or(shiftleft(1L, bit))").alias("mask"))
        frontier = written(frontier.select("lot", "id", F.lit(0).cast("long").alias("depth"), "mask"), "visited")
        parts, k = [frontier], 0
        while depth is None or k < depth:
            k += 1
            step = frontier.join(self.edges, F.col("id") == F.col("_a")).select("lot", F.col("_b").alias("id"), F.col("mask").alias("new"), F.lit(0).cast("long").alias("old"))
            met = step.unionByName(_union(parts).select("lot", "id", F.lit(0).cast("long").alias("new"), F.col("mask").alias("old")))
            mask = F.expr("bit_or(new) & ~bit_or(old)").alias("mask")
            fresh = written(met.groupBy("lot", "id").agg(mask).where("mask != 0").select("lot", "id", F.lit(k).cast("long").alias("depth"), "mask"), "frontier")
            if fresh.isEmpty():
                dropped(fresh)
                break
            frontier, self.deepest = fresh, k
            parts.append(fresh)
            if len(parts) > 6:  # one table in place of many; the frontier is still read by itself
                one = written(_union(parts[:-1]), "visited")
                dropped(*parts[:-1])
                parts = [one, fresh]
        self.masks = _union(parts)

    def by_seed(self, rows: DataFrame) -> DataFrame:
        """rows (lot, mask and others) with seed in their place, one for each bit of the mask."""
        seeds = self.seeds if self.seeds.count() > FEW_SEEDS else F.broadcast(self.seeds)
        return rows.join(seeds, "lot").where("shiftright(mask, bit) & 1 = 1").drop("lot", "mask", "bit")

    def rows(self) -> DataFrame:
        """seed, id and least depth."""
        return self.by_seed(self.masks).select("seed", "id", "depth")

    def steps(self) -> DataFrame:
        """lot, id, depth, before and mask: the vertices one step before each vertex, and from which seeds."""
        ahead = self.masks.select("lot", F.col("id").alias("before"), (F.col("depth") + 1).alias("depth"), F.col("mask").alias("near"))
        along = ahead.join(self.edges, F.col("before") == F.col("_a")).select("lot", F.col("_b").alias("id"), "depth", "before", "near")
        both = along.join(self.masks, ["lot", "id", "depth"]).withColumn("mask", F.col("mask").bitwiseAND(F.col("near")))
        return both.where("mask != 0").select("lot", "id", "depth", "before", "mask")

    def drop_edges(self) -> Reached:
        """Where only masks are read: the table of edges goes."""
        dropped(self.edges)
        return self

    def trees(self) -> DataFrame:
        """lot, id, depth, via (the smallest vertex one step before it) and mask (from which seeds), but for the seeds themselves."""
        first = """aggregate(array_sort(steps), named_struct('seen', 0L, 'kept', CAST(array() AS array<struct<via: bigint, mask: bigint>>)),
            (s, x) -> if((x.mask & ~s.seen) = 0, s, named_struct('seen', s.seen | x.mask, 'kept', concat(s.kept, array(named_struct('via', x.before, 'mask', x.mask & ~s.seen))))), s -> s.kept)"""
        kept = self.steps().groupBy("lot", "id", "depth").agg(F.collect_list(F.struct("before", "mask")).alias("steps")).select("lot", "id", "depth", F.explode(F.expr(first)).alias("x"))
        return kept.select("lot", "id", "depth", "x.via", "x.mask")

    def forest(self) -> DataFrame:
        """seed, id, depth and via (the smallest vertex one step before it; null at the seed)."""
        seeds = self.masks.where("depth = 0").select("lot", "id", "depth", F.lit(None).cast("long").alias("via"), "mask")
        return self.by_seed(self.trees().unionByName(seeds)).select("seed", "id", "depth", "via")

    def paths(self, trees: DataFrame) -> DataFrame:
        """seed, id, depth, via and path (text) of trees (lot, id, depth, via, mask; a table), the seeds in it.

        A level at a time; between levels only the paths of vertices that lead on to others are written, in lists of a
        lot. All other paths are made as they are read.
        """
        held = self.seeds.select("lot", F.col("seed").alias("id"), F.array(F.struct("bit", F.col("seed").cast("string").alias("path"))).alias("held"))
        found = [held.select("lot", "id", F.lit(0).cast("long").alias("depth"), F.lit(None).cast("long").alias("via"), "held")]
        longer = F.expr("transform(filter(held, x -> shiftright(mask, x.bit) & 1 = 1), x -> struct(x.bit AS bit, concat(x.path, '>', id) AS path))").alias("held")
        for k in range(1, self.deepest + 1):
            level, before = trees.where(F.col("depth") == k), held.select("lot", F.col("id").alias("via"), "held")
            found.append(level.join(before, ["lot", "via"]).select("lot", "id", "depth", "via", longer))
            if k < self.deepest:
                on = trees.where(F.col("depth") == k + 1).groupBy("lot", F.col("via").alias("id")).agg(F.expr("bit_or(mask)").alias("on"))
                inner = level.join(on, ["lot", "id"]).withColumn("mask", F.col("mask").bitwiseAND(F.col("on"))).where("mask != 0").join(before, ["lot", "via"])
                held = written(inner.select("lot", "id", longer).groupBy("lot", "id").agg(F.flatten(F.collect_list("held")).alias("held")), "paths")  # 64 paths at most
        seeds = self.seeds if self.seeds.count() > FEW_SEEDS else F.broadcast(self.seeds)
        return _union([x.select("lot", "id", "depth", "via", F.inline("held")) for x in found]).join(seeds, ["lot", "bit"]).select("seed", "id", "depth", "via", "path")


FEW_SEEDS = 1 << 19  # of 20 bytes each, that are broadcast


def reach(edges: DataFrame, seeds: DataFrame, depth: int | None = None) -> DataFrame:
    """seed, id, least depth and via (the smallest vertex one step before it; null at the seed) for every vertex that edges (a, b) lead to from seeds (seed) in at most depth steps (any number, if that is None); a seed reaches itself at 0."""
    return Reached(edges, seeds, depth).forest()


def distances(edges: DataFrame, seeds: DataFrame, depth: int | None = None) -> DataFrame:
    """The same without via, which takes a further join."""
    return Reached(edges, seeds, depth).drop_edges().rows()


def with_paths(forest: DataFrame) -> DataFrame:
    """forest (seed, id, depth, via) with path, the vertices from the seed on. A level at a time: each vertex is joined once, with the one before it."""
    forest = written(forest, "forest")
    level = written(forest.where("depth = 0").withColumn("path", F.array("id")), "paths")
    found = [level]
    for k in range(1, (forest.agg(F.max("depth")).first()[0] or 0) + 1):
        before = level.select("seed", F.col("id").alias("via"), F.col("path").alias("before"))
        level = written(forest.where(F.col("depth") == k).join(before, ["seed", "via"]).select("seed", "id", "depth", "via", F.concat("before", F.array("id")).alias("path")), "paths")
        found.append(level)
    dropped(forest)
    return _union(found)


def chained(edges: DataFrame, seeds: DataFrame, depth: int | None = None) -> DataFrame:
    """with_paths() of reach(), paths as text: trees stay in lots, so no table holds a path for each seed and vertex."""
    met = Reached(edges, seeds, depth)
    trees = written(met.trees(), "trees")
    return met.drop_edges().paths(trees)


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def strongly_connected(edges: DataFrame, max_rounds: int = 200) -> DataFrame:
    """id and component (smallest id in it) of vertices on a cycle (a self-loop is one).

    Trimming vertices without in or out edges, then the smallest label that reaches
    a vertex forwards and backwards; vertices where both agree are one component
    and leave the graph. Labels travel as aggregated minima, not as walks. Joins are
    by shuffle whatever the size: a broadcast in each round would pass the driver.
    """
    rest = written(edges.select("a", "b").where("a IS NOT NULL AND b IS NOT NULL").distinct(), "scc")
    loops = written(rest.where("a = b").select(F.col("a").alias("id"), F.col("a").alias("component")), "loops")
    found = None

    def least(pairs: DataFrame, marks: DataFrame) -> DataFrame:
        """Smallest label reaching each vertex along pairs (u, v)."""
        marks = written(marks, "marks")
        for _ in range(max_rounds):
            near = pairs.join(marks.withColumnRenamed("id", "u").hint("merge"), "u").groupBy(F.col("v").alias("id")).agg(F.min("mark").alias("near"))
            low = marks.join(near.hint("merge"), "id", "left").select("id", "mark", F.least("mark", "near").alias("low"))
            jump = marks.select(F.col("id").alias("low"), F.col("mark").alias("far"))  # what reaches the label reaches the vertex as well
            new = written(low.join(jump.hint("merge"), "low", "left").select("id", F.least("low", "far").alias("mark"), (F.least("low", "far") < F.col("mark")).alias("moved")), "marks")
            dropped(marks)
            marks = new.select("id", "mark")
            marks._codeloom_path = new._codeloom_path
            if new.where("moved").isEmpty():
                return marks
        raise RuntimeError("labels did not settle")

    for _ in range(max_rounds):
        while True:  # vertices without a way in or out are on no cycle
            kept = written(rest.join(rest.select(F.col("b").alias("a")).distinct().hint("merge"), "a", "left_semi").select("a", "b").join(rest.select(F.col("a").alias("b")).distinct().hint("merge"), "b", "left_semi").select("a", "b"), "scc")
            same = kept.count() == rest.count()
            dropped(rest)
            rest = kept
            if same:
                break
        if rest.isEmpty():
            break
        ids = rest.select(F.col("a").alias("id")).unionAll(rest.select("b")).distinct().select("id", F.col("id").alias("mark"))
        ahead = least(rest.select(F.col("a").alias("u"), F.col("b").alias("v")), ids)
        behind = least(rest.select(F.col("b").alias("u"), F.col("a").alias("v")), ids)
        both = ahead.join(behind.withColumnRenamed("mark", "back").hint("merge"), "id")
        done = written(both.where("mark = back").select("id", F.col("mark").alias("component")), "component")
        found = done if found is None else found.unionAll(done)
        sides = written(both.select("id", "mark", "back"), "sides")
        a = sides.select(F.col("id").alias("a"), F.col("mark").alias("m1"), F.col("back").alias("k1"))
        b = sides.select(F.col("id").alias("b"), F.col("mark").alias("m2"), F.col("back").alias("k2"))
        split = rest.join(a.hint("merge"), "a").join(b.hint("merge"), "b").where("m1 = m2 AND k1 = k2 AND m1 != k1").select("a", "b")  # only edges inside one class can lie on a further cycle
        new = written(split, "scc")
        dropped(rest)
        rest = new
    if found is None:
        return loops
    sizes = found.groupBy("component").agg(F.count("*").alias("n")).where("n > 1").select("component")
    return found.join(sizes.hint("merge"), "component").select("id", "component").unionAll(loops).groupBy("id").agg(F.min("component").alias("component"))


def _edges(calls: DataFrame, a: str = "caller_id", b: str = "callee_id") -> DataFrame:
    return calls.select(F.col(a).alias("a"), F.col(b).alias("b"))


def _reach_sql(edges: str, seeds: str, depth: int, result: str) -> str:
    """An oracle's table reached(seed, id, depth): depths are lowered in place until none falls."""
    return f"""WITH RECURSIVE e AS ({edges}), seeds AS ({seeds}), reached(seed, id, depth) USING KEY (seed, id) AS (SELECT seed, seed, CAST(0 AS BIGINT) FROM seeds
        UNION SELECT r.seed, e.b, min(r.depth + 1) FROM reached r JOIN e ON e.a = r.id LEFT JOIN recurring.reached o ON o.seed = r.seed AND o.id = e.b WHERE r.depth < {depth} AND (o.depth IS NULL OR o.depth > r.depth + 1) GROUP BY r.seed, e.b) {result}"""


_FORTH = "SELECT DISTINCT caller_id AS a, callee_id AS b FROM calls"
_BACK = "SELECT DISTINCT callee_id AS a, caller_id AS b FROM calls"


@sql_operator
def i01_ripple_edges(d: Dialect) -> str:
    """Certain edges (over 0.7) with both ends, by qualified name."""
    return "SELECT DISTINCT f.qualified_name AS from_name, t.qualified_name AS to_name FROM relationships r JOIN symbols f ON f.id = r.from_id JOIN symbols t ON t.id = r.to_id WHERE r.confidence > 0.7e0"


SEEDS = "id % 100 = 0"  # of the driver's queries: the symbols whose ids are divisible by 100
_RIPPLES = f"SELECT id AS seed FROM symbols WHERE {SEEDS}"


def _forest_sql(edges: str, seeds: str, depth: int, result: str) -> str:
    """An oracle's table p(seed, id, depth, via, path): of each vertex reached the smallest one before it, and the path over these."""
    return _reach_sql(edges, seeds, depth, f""", forest AS (SELECT r.seed, r.id, r.depth, min(e.a) AS via FROM reached r JOIN e ON e.b = r.id JOIN reached q ON q.seed = r.seed AND q.id = e.a AND q.depth = r.depth - 1 GROUP BY r.seed, r.id, r.depth),
        p(seed, id, depth, via, path) AS (SELECT seed, seed, CAST(0 AS BIGINT), CAST(NULL AS BIGINT), CAST(seed AS VARCHAR) FROM seeds UNION ALL SELECT f.seed, f.id, f.depth, f.via, p.path || '>' || CAST(f.id AS VARCHAR) FROM p JOIN forest f ON f.seed = p.seed AND f.via = p.id) {result}""")


def _joined(path: str) -> F.Column:
    return F.array_join(F.col(path).cast("array<string>"), ">")


@frame_operator("calls symbols", lambda d: _forest_sql(_BACK, _RIPPLES, 6, "SELECT seed, id, depth, path FROM p WHERE depth > 0"), seeds=SEEDS)
def i02_ripple(t: dict[str, DataFrame], seeds: str, depth: int = 6) -> DataFrame:
    """Who depends on the seeds (symbols of a condition), directly or through others: at what distance, and by which path from the seed (of equally short ones that over the smallest ids, from the end on)."""
    return chained(_edges(t["calls"], "callee_id", "caller_id"), _seeds(t, seeds), depth).where("depth > 0").select("seed", "id", "depth", "path")


def _seeds(t: dict[str, DataFrame], seeds: str) -> DataFrame:
    return chosen(t["symbols"], seeds).select(F.col("id").alias("seed"))


def _ripple(t: dict[str, DataFrame], seeds: str, depth: int) -> DataFrame:
    return distances(_edges(t["calls"], "callee_id", "caller_id"), _seeds(t, seeds), depth)


@frame_operator("calls symbols", lambda d: _reach_sql(_BACK, _RIPPLES, 6, "SELECT seed, depth AS distance, count(*) AS symbols, CASE WHEN depth = 1 THEN 'direct' ELSE 'indirect' END AS impact FROM reached WHERE depth > 0 GROUP BY seed, depth"), seeds=SEEDS)
def i13_ripple_waves(t: dict[str, DataFrame], seeds: str, depth: int = 6) -> DataFrame:
    """The ripple by distance."""
    waves = _ripple(t, seeds, depth).where("depth > 0").groupBy("seed", F.col("depth").alias("distance")).agg(F.count("*").alias("symbols"))
    return waves.withColumn("impact", F.when(F.col("distance") == 1, "direct").otherwise("indirect"))


@frame_operator("calls symbols", lambda d: _reach_sql(_BACK, _RIPPLES, 3, "SELECT seed, least(100, sum(CASE depth WHEN 1 THEN 10 WHEN 2 THEN 5 WHEN 3 THEN 3 ELSE 1 END))::BIGINT AS severity, round(min(greatest(0.3e0, 1e0 - 0.1e0 * depth)), 6) AS confidence FROM reached WHERE depth > 0 GROUP BY seed"), seeds=SEEDS)
def i14_fallback_impact(t: dict[str, DataFrame], seeds: str) -> DataFrame:
    """A plain estimate to distance 3: severity 10, 5, 3 by distance up to 100, confidence falling by a tenth a step."""
    points = F.when(F.col("depth") == 1, 10).when(F.col("depth") == 2, 5).when(F.col("depth") == 3, 3).otherwise(1)
    return _ripple(t, seeds, 3).where("depth > 0").groupBy("seed").agg(F.least(F.lit(100), F.sum(points)).cast("long").alias("severity"), F.round(F.min(F.greatest(F.lit(0.3), 1 - 0.1 * F.col("depth"))), 6).alias("confidence"))


_FROM_ENTRIES = _RIPPLES


def chosen(symbols: DataFrame, which: str) -> DataFrame:
    """id of the symbols of a condition, or of ids, comma-joined."""
    return symbols.where(f"id IN ({which})" if re.fullmatch(r"[\d\s,-]+", which) else which).select("id")


def _start(t: dict[str, DataFrame], entries: str | None) -> DataFrame:
    """The chosen symbols, or else the functions that nothing calls."""
    if entries:
        return chosen(t["symbols"], entries)
    called = t["calls"].select(F.col("callee_id").alias("id")).where("id IS NOT NULL").distinct()
    return t["symbols"].where("kind IN ('function', 'method')").join(called, "id", "left_anti").select("id")


@frame_operator("calls symbols", lambda d: _reach_sql(_FORTH, _FROM_ENTRIES, 20, "SELECT id, count(*) AS visits, min(depth) AS depth FROM reached WHERE depth > 0 GROUP BY id"), entries=SEEDS)
def i18_execution_counts(t: dict[str, DataFrame], entries: str | None = None, hops: int = 20) -> DataFrame:
    """Which functions runs from the entries pass: reachability counts in place of random walks."""
    seeds = _start(t, entries).select(F.col("id").alias("seed"))
    met = Reached(_edges(t["calls"]), seeds, hops).drop_edges().masks.where("depth > 0")
    return met.groupBy("id").agg(F.sum(F.bit_count("mask")).cast("long").alias("visits"), F.min("depth").alias("depth"))


@frame_operator("calls symbols", lambda d: _forest_sql(_FORTH, _FROM_ENTRIES, 10, "SELECT seed AS entry, id, via AS caller, depth, path FROM p"), entries=SEEDS)
def g18_call_chains(t: dict[str, DataFrame], entries: str | None = None, depth: int = 10) -> DataFrame:
    """From each entry point: functions reached, the least depth, the caller each was first met from (the smallest) and the chain of calls; as many rows as entries reach functions."""
    return chained(_edges(t["calls"]), _start(t, entries).select(F.col("id").alias("seed")), depth).select(F.col("seed").alias("entry"), "id", F.col("via").alias("caller"), "depth", "path")


def _dead_sql(result: str) -> str:
    """An oracle's table alive(id) over the calls of calls_returned."""
    return f"""WITH RECURSIVE e AS (SELECT DISTINCT caller_id AS a, callee_id AS b FROM calls_returned), entries AS (SELECT id FROM symbols WHERE {SEEDS}),
        alive(id) AS (SELECT id FROM entries UNION SELECT e.b FROM alive JOIN e ON e.a = alive.id) {result}"""


def _alive(t: dict[str, DataFrame], calls: str, entries: str | None) -> DataFrame:
    """id of all that some entry reaches: one walk from all entries at once."""
    seeds = _start({"symbols": t["symbols"], "calls": t[calls]}, entries)
    edges = _edges(t[calls]).unionAll(seeds.select(F.lit(ROOT).cast("long").alias("a"), F.col("id").alias("b")))
    return distances(edges, seeds.limit(1).select(F.lit(ROOT).cast("long").alias("seed"))).select("id")


ROOT = -(1 << 62)  # stands before all entries


@frame_operator("calls_returned symbols", lambda d: _dead_sql("SELECT s.id, s.kind, s.end_line - s.line AS lines, EXISTS (SELECT 1 FROM e WHERE e.b = s.id) AS is_called FROM symbols s WHERE s.id NOT IN (SELECT id FROM alive)"), entries=SEEDS, calls="calls_returned")
def d04_dead_code(t: dict[str, DataFrame], entries: str | None = None, calls: str = "calls") -> DataFrame:
    """Symbols that no entry reaches, with their lines, and whether anything (dead as well) calls them."""
    called = t[calls].select(F.col("callee_id").alias("id")).distinct().withColumn("is_called", F.lit(True))
    dead = t["symbols"].join(_alive(t, calls, entries), "id", "left_anti").join(called, "id", "left")
    return dead.select("id", "kind", (F.col("end_line") - F.col("line")).alias("lines"), F.coalesce("is_called", F.lit(False)).alias("is_called"))


@frame_operator("calls_returned symbols", lambda d: _dead_sql("SELECT e.a AS caller_id, e.b AS callee_id, CASE WHEN e.b IN (SELECT id FROM alive) THEN 'caller unreachable' ELSE 'both ends unreachable' END AS reason FROM e WHERE e.a NOT IN (SELECT id FROM alive)"), entries=SEEDS, calls="calls_returned")
def d04_dead_edges(t: dict[str, DataFrame], entries: str | None = None, calls: str = "calls") -> DataFrame:
    """Calls that are never made because no entry reaches the caller, and whether the callee lives by others."""
    alive = written(_alive(t, calls, entries), "alive")
    edges = t[calls].select("caller_id", "callee_id").distinct().join(alive.withColumnRenamed("id", "caller_id"), "caller_id", "left_anti")
    ends = edges.join(alive.select(F.col("id").alias("callee_id"), F.lit(True).alias("lives")), "callee_id", "left")
    return ends.select("caller_id", "callee_id", F.when(F.col("lives"), "caller unreachable").otherwise("both ends unreachable").alias("reason"))


@frame_operator("calls_returned symbols", lambda d: _dead_sql("SELECT s.file_path, count(*) AS symbols, count(*) FILTER (WHERE a.id IS NULL) AS dead, CAST(sum(s.end_line - s.line) AS BIGINT) AS lines, round(100e0 * coalesce(sum(s.end_line - s.line) FILTER (WHERE a.id IS NULL), 0) / sum(s.end_line - s.line), 6) AS dead_percent FROM symbols s LEFT JOIN alive a ON a.id = s.id GROUP BY s.file_path HAVING sum(s.end_line - s.line) > 0"), entries=SEEDS, calls="calls_returned")
def d04_dead_lines(t: dict[str, DataFrame], entries: str | None = None, calls: str = "calls") -> DataFrame:
    """Of each file with lines: symbols, those that no entry reaches, lines, and the share of dead ones in percent."""
    rows = t["symbols"].join(_alive(t, calls, entries).withColumn("lives", F.lit(True)), "id", "left").select("file_path", (F.col("end_line") - F.col("line")).alias("lines"), F.col("lives").isNull().alias("dead"))
    out = rows.groupBy("file_path").agg(F.count("*").alias("symbols"), F.count_if("dead").alias("dead"), F.sum("lines").alias("lines"), F.sum(F.when(F.col("dead"), F.col("lines")).otherwise(0)).alias("gone"))
    return out.where("lines > 0").select("file_path", "symbols", "dead", "lines", F.round(F.lit(100.0) * F.col("gone") / F.col("lines"), 6).alias("dead_percent"))


@frame_operator("calls", lambda d: """WITH RECURSIVE e AS (SELECT DISTINCT caller_id AS a, callee_id AS b FROM calls UNION SELECT callee_id, caller_id FROM calls), c(id, component) USING KEY (id) AS (SELECT a, a FROM (SELECT DISTINCT a FROM e) v
        UNION SELECT e.b, min(c.component) FROM c JOIN e ON e.a = c.id JOIN recurring.c o ON o.id = e.b WHERE c.component < o.component GROUP BY e.b) SELECT id, component FROM c""")
def d21_components(t: dict[str, DataFrame]) -> DataFrame:
    """Connected components."""
    return connected_components(t["calls"], "caller_id", "callee_id").select("id", "component")


@frame_operator("calls", lambda d: """WITH RECURSIVE e AS (SELECT DISTINCT caller_id AS a, callee_id AS b FROM calls), ways AS (SELECT a, b FROM e UNION SELECT b, a FROM e), c(id, component) USING KEY (id) AS (SELECT a, a FROM (SELECT DISTINCT a FROM ways) v
        UNION SELECT ways.b, min(c.component) FROM c JOIN ways ON ways.a = c.id JOIN recurring.c o ON o.id = ways.b WHERE c.component < o.component GROUP BY ways.b),
    n AS (SELECT component, count(*) AS nodes FROM c GROUP BY component), m AS (SELECT c.component, count(*) AS edges FROM e JOIN c ON c.id = e.a GROUP BY c.component)
    SELECT n.component, nodes, edges, round(2e0 * edges / nodes, 6) AS mean_degree FROM n JOIN m USING (component)""")
def d21_component_sizes(t: dict[str, DataFrame]) -> DataFrame:
    """Of each connected component: nodes, distinct edges and their mean number of ends a node."""
    parts = written(connected_components(t["calls"], "caller_id", "callee_id"), "components")
    edges = t["calls"].where("caller_id IS NOT NULL AND callee_id IS NOT NULL").select(F.col("caller_id").alias("id"), "callee_id").distinct().join(parts.select("id", "component"), "id").groupBy("component").agg(F.count("*").alias("edges"))
    return parts.groupBy("component").agg(F.count("*").alias("nodes")).join(edges, "component").select("component", "nodes", "edges", F.round(F.lit(2.0) * F.col("edges") / F.col("nodes"), 6).alias("mean_degree"))


@frame_operator("calls", lambda d: """WITH RECURSIVE e AS (SELECT DISTINCT caller_id AS a, callee_id AS b FROM calls), ways AS (SELECT a, b FROM e UNION SELECT b, a FROM e), c(id, component) USING KEY (id) AS (SELECT a, a FROM (SELECT DISTINCT a FROM ways) v
        UNION SELECT ways.b, min(c.component) FROM c JOIN ways ON ways.a = c.id JOIN recurring.c o ON o.id = ways.b WHERE c.component < o.component GROUP BY ways.b)
    SELECT n.nodes, m.edges, n.components, m.edges - n.nodes + 2 * n.components AS cyclomatic, round(CAST(m.edges AS DOUBLE) / m.callers, 6) AS branching, (SELECT count(*) FROM calls WHERE is_conditional) AS conditional, (SELECT count(*) FROM calls WHERE is_recursive) AS recursive
    FROM (SELECT count(*) AS nodes, count(DISTINCT component) AS components FROM c) n, (SELECT count(*) AS edges, count(DISTINCT a) AS callers FROM e) m""")
def d11_flow_statistics(t: dict[str, DataFrame]) -> DataFrame:
    """One row of the call graph: nodes, distinct edges, connected components, cyclomatic number (edges - nodes + 2 for each component), mean calls of a caller, and sites."""
    parts = written(connected_components(t["calls"], "caller_id", "callee_id"), "components").agg(F.count("*").alias("nodes"), F.count_distinct("component").alias("components"))
    pairs = t["calls"].where("caller_id IS NOT NULL AND callee_id IS NOT NULL").groupBy("caller_id", "callee_id").agg(F.count_if("is_conditional").alias("conditional"), F.count_if("is_recursive").alias("recursive"))
    of = pairs.groupBy("caller_id").agg(F.count("*").alias("n"), F.sum("conditional").alias("conditional"), F.sum("recursive").alias("recursive"))
    sums = of.agg(F.sum("n").alias("edges"), F.count("*").alias("callers"), F.sum("conditional").alias("conditional"), F.sum("recursive").alias("recursive"))
    row = parts.join(F.broadcast(sums), F.lit(True))  # one row each
    return row.select("nodes", "edges", "components", (F.col("edges") - F.col("nodes") + 2 * F.col("components")).alias("cyclomatic"), F.round(F.col("edges") / F.col("callers"), 6).alias("branching"), "conditional", "recursive")


@frame_operator("calls")
def m21_circular_dependencies(t: dict[str, DataFrame]) -> DataFrame:
    """Symbols on a cycle: strongly connected components of two or more, and self-loops. Independent of visit order."""
    found = written(strongly_connected(_edges(t["calls"])), "cycles")
    return found.join(found.groupBy("component").agg(F.count("*").alias("cycle_length")).hint("merge"), "component").select("id", "component", "cycle_length")


_SHORTEST = _reach_sql(_FORTH, _FROM_ENTRIES, 1_000_000, """, p(a, b, depth, path) AS (SELECT seed, seed, CAST(0 AS BIGINT), CAST(seed AS VARCHAR) FROM seeds
    UNION ALL SELECT p.a, r.id, r.depth, p.path || '>' || CAST(r.id AS VARCHAR) FROM p JOIN e ON e.a = p.b JOIN reached r ON r.seed = p.a AND r.id = e.b AND r.depth = p.depth + 1)
    SELECT a AS from_id, b AS to_id, depth, min(path) AS path FROM p WHERE depth > 0 GROUP BY a, b, depth""")


@frame_operator("calls symbols", lambda d: _SHORTEST, entries=SEEDS)
def g25_shortest_path(t: dict[str, DataFrame], entries: str | None = None, depth: int | None = None) -> DataFrame:
    """The shortest path from each entry to all that it reaches (within depth calls, if given); ties: the smallest path, as text. Breadth first: of each vertex one path is kept, so nothing is enumerated.

    Lots go by turns, each turn's steps (times their seeds) bounded by TURN; of a level only the paths that lead on are
    held for the next. What stays are trees in lots, whose paths are made as they are read.
    """
    met = Reached(_edges(t["calls"]), _start(t, entries).select(F.col("id").alias("seed")), depth)
    steps = written(met.steps(), "steps")
    met.drop_edges()
    turns = -(-(steps.agg(F.sum(F.bit_count("mask"))).first()[0] or 0) // TURN)
    trees = [met.masks.where("false").select("lot", "id", "depth", F.col("id").alias("via"), "mask")]
    for turn in range(turns):
        mine = steps.where(F.col("lot") % turns == turn)
        held = met.seeds.select("lot", F.col("seed").alias("id"), F.array(F.struct("bit", F.col("seed").cast("string").alias("path"))).alias("held"))
        last = None
        for k in range(1, met.deepest + 1):
            step = mine.where(F.col("depth") == k).join(held.withColumnRenamed("id", "before"), ["lot", "before"]).select("lot", "id", "mask", F.inline("held")).where("shiftright(mask, bit) & 1 = 1")
            level = written(step.groupBy("lot", "bit", "id").agg(F.min(F.concat_ws(">", "path", F.col("id").cast("string"))).alias("path")), "level")
            via = F.element_at(F.split("path", ">"), -2).cast("long").alias("via")
            trees.append(written(level.groupBy("lot", "id", F.lit(k).cast("long").alias("depth"), via).agg(F.expr("bit_or(shiftleft(1L, bit))").alias("mask")), "trees"))
            on = mine.where(F.col("depth") == k + 1).groupBy("lot", F.col("before").alias("id")).agg(F.expr("bit_or(mask)").alias("on"))
            held = level.join(on, ["lot", "id"]).where("shiftright(on, bit) & 1 = 1").groupBy("lot", "id").agg(F.collect_list(F.struct("bit", "path")).alias("held"))  # 64 paths at most
            dropped(last)
            last = level
        dropped(last)
    one = written(_union(trees), "trees")
    dropped(steps, *trees)
    return met.paths(one).where("depth > 0").select(F.col("seed").alias("from_id"), F.col("id").alias("to_id"), "depth", "path")


TURN = 1 << 26  # steps that g25 compares at once


@sql_operator
def d03_path_statistics(d: Dialect) -> str:
    """Stored paths joined with the costs of their nodes."""
    return f"SELECT f.id, f.frequency, count(b.id) AS blocks, round(coalesce(avg(b.cost), 0e0), 6) AS mean_cost FROM (SELECT id, frequency, {d.explode('nodes')} AS node FROM flow_paths) f LEFT JOIN blocks b ON b.symbol_id = f.node GROUP BY f.id, f.frequency"


@frame_operator(
    "calls symbols",
    lambda d: _reach_sql(_FORTH, _FROM_ENTRIES, 6, """, m AS (SELECT id, min(depth) AS layer FROM reached GROUP BY id)
        SELECT layer, count(*) AS nodes, count(*) FILTER (WHERE id IN (SELECT a FROM e WHERE a = b)) AS recursive, CAST(coalesce(sum(x.n), 0) AS BIGINT) AS cross_file_calls FROM m
        LEFT JOIN (SELECT e.a, count(*) AS n FROM e JOIN symbols f ON f.id = e.a JOIN symbols t ON t.id = e.b WHERE f.file_path <> t.file_path GROUP BY e.a) x ON x.a = m.id GROUP BY layer"""),
    entries=SEEDS,
)
def d08_call_layers(t: dict[str, DataFrame], entries: str | None = None, depth: int = 6) -> DataFrame:
    """Layers of the call graph from its roots, breadth first, all roots at once: nodes first met at each depth, how many of them call themselves, and their calls into other files."""
    edges = written(_edges(t["calls"]).where("a IS NOT NULL AND b IS NOT NULL").distinct(), "edges")
    roots = _start(t, entries)
    met = distances(edges.unionAll(roots.select(F.lit(ROOT).cast("long").alias("a"), F.col("id").alias("b"))), roots.limit(1).select(F.lit(ROOT).cast("long").alias("seed")), depth + 1)
    file = t["symbols"].select("id", "file_path")
    across = edges.join(file.select(F.col("id").alias("a"), F.col("file_path").alias("f1")), "a").join(file.select(F.col("id").alias("b"), F.col("file_path").alias("f2")), "b").where("f1 <> f2").groupBy(F.col("a").alias("id")).agg(F.count("*").alias("across"))
    selfish = edges.where("a = b").select(F.col("a").alias("id"), F.lit(True).alias("selfish"))
    nodes = met.where("depth > 0").select("id", (F.col("depth") - 1).alias("layer")).join(across, "id", "left").join(selfish, "id", "left")
    return nodes.groupBy("layer").agg(F.count("*").alias("nodes"), F.count("selfish").alias("recursive"), F.coalesce(F.sum("across"), F.lit(0)).alias("cross_file_calls"))


@frame_operator("calls symbols", lambda d: _reach_sql(_FORTH, _FROM_ENTRIES, 1_000_000, "SELECT seed AS root, count(*) AS descendants, max(depth) AS depth FROM reached WHERE depth > 0 GROUP BY seed"), entries=SEEDS)
def d31_process_tree(t: dict[str, DataFrame], entries: str | None = None, depth: int | None = None) -> DataFrame:
    """Spawn chains over call edges from roots: descendants of each root, however far (or within depth calls), and the depth of its tree, breadth first."""
    met = distances(_edges(t["calls"]), _start(t, entries).select(F.col("id").alias("seed")), depth).where("depth > 0")
    return met.groupBy(F.col("seed").alias("root")).agg(F.count("*").alias("descendants"), F.max("depth").alias("depth"))


# Control flow: the graph of one function is bounded by its source, so each is walked whole in one task; functions are dealt by one shuffle.
EXITS = ("exit", "return", "throw", "catch")  # blocks at which a function ends


def walked(entries: list[int], out: dict[int, list[int]]) -> dict[int, int]:
    """Least distance of every block from an entry, breadth first."""
    found, level = dict.fromkeys(entries, 0), list(entries)
    while level:
        nxt = []
        for a in level:
            for b in out.get(a, ()):
                if b not in found:
                    found[b] = found[a] + 1
                    nxt.append(b)
        level = nxt
    return found


BATCH = 4096  # rows that a task of Python hands on at once


def one_by_one(batches: Iterator[pa.RecordBatch], *columns: str) -> Iterator[tuple]:
    """The values of columns as Python objects, of one row at a time: a batch may hold ten thousand functions."""
    for batch in batches:
        held = [batch.column(c) for c in columns]
        for k in range(batch.num_rows):
            yield tuple(c[k].as_py() for c in held)


def batched(rows: Iterator[tuple], names: list[str], kinds: list[pa.DataType]) -> Iterator[pa.RecordBatch]:
    """Rows in batches of bounded size."""
    while some := list(islice(rows, BATCH)):
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*some, strict=True), kinds, strict=True)], names)


def by_function(blocks: DataFrame, steps: DataFrame, *columns: str) -> DataFrame:
    """Both of each function, its row in Arrow batches of 4 MB at most (or one function), unless the session sets a bound of its own."""
    conf = blocks.sparkSession.conf
    if conf.get(ARROW_BYTES) in ("64MB", "67108864b"):  # the default
        conf.set(ARROW_BYTES, "4m")
    return blocks.join(steps, "symbol_id", "left").select(*columns)


ARROW_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def control_flow(blocks: DataFrame, edges: DataFrame) -> DataFrame:
    """symbol_id, id, block_type, distance (from the function's entries, null if unreachable), reaches_exit and back_to (the smallest earlier block that it goes back to) of each block."""
    of = blocks.groupBy("symbol_id").agg(F.collect_list(F.struct("id", "block_type", "start_line")).alias("blocks"))
    steps = edges.groupBy("symbol_id").agg(F.collect_list(F.struct("from_id", "to_id")).alias("edges"))

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["symbol_id", "id", "block_type", "distance", "reaches_exit", "back_to"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.bool_(), pa.int64()]

        def rows() -> Iterator[tuple]:
            for symbol, own, pairs in one_by_one(batches, "symbol_id", "blocks", "edges"):
                out, into = {}, {}
                for e in pairs or ():
                    out.setdefault(e["from_id"], []).append(e["to_id"])
                    into.setdefault(e["to_id"], []).append(e["from_id"])
                ahead = walked([b["id"] for b in own if b["block_type"] == "entry"], out)
                behind = walked([b["id"] for b in own if b["block_type"] in EXITS], into)
                line = {b["id"]: b["start_line"] for b in own}
                for b in own:
                    back = [x for x in out.get(b["id"], ()) if line.get(x, b["start_line"] + 1) <= b["start_line"]]
                    yield symbol, b["id"], b["block_type"], ahead.get(b["id"]), b["id"] in behind, min(back, default=None)

        return batched(rows(), names, kinds)

    return by_function(of, steps, "symbol_id", "blocks", "edges").mapInArrow(walk, "symbol_id long, id long, block_type string, distance long, reaches_exit boolean, back_to long")


def _flow_sql(result: str) -> str:
    """Oracle tables: ahead(id, depth) from entries, behind(id) to exits."""
    exits = ", ".join(f"'{x}'" for x in EXITS)
    return f"""WITH RECURSIVE ahead(id, depth) USING KEY (id) AS (SELECT id, CAST(0 AS BIGINT) FROM blocks WHERE block_type = 'entry'
        UNION SELECT e.to_id, min(a.depth + 1) FROM ahead a JOIN block_edges e ON e.from_id = a.id LEFT JOIN recurring.ahead o ON o.id = e.to_id WHERE o.depth IS NULL OR o.depth > a.depth + 1 GROUP BY e.to_id),
        behind(id) AS (SELECT id FROM blocks WHERE block_type IN ({exits}) UNION SELECT e.from_id FROM behind b JOIN block_edges e ON e.to_id = b.id) {result}"""


@frame_operator("blocks block_edges", lambda d: _flow_sql("SELECT id, symbol_id FROM blocks WHERE id NOT IN (SELECT id FROM ahead)"))
def p28_unreachable_blocks(t: dict[str, DataFrame]) -> DataFrame:
    """Blocks that no walk along the edges from an entry block of their function meets."""
    return control_flow(t["blocks"], t["block_edges"]).where("distance IS NULL").select("id", "symbol_id")


@sql_operator
def p29_hot_blocks(d: Dialect, top: int = 5) -> str:
    """The five blocks of most complexity of each function."""
    return f"SELECT symbol_id, id, complexity, cost FROM (SELECT *, row_number() OVER (PARTITION BY symbol_id ORDER BY complexity DESC, cost DESC, id) AS k FROM blocks) x WHERE k <= {top}"


@frame_operator(
    "blocks block_edges",
    lambda d: _flow_sql(f"SELECT b.symbol_id, arg_min(b.id, row(a.depth, b.id)) AS exit_id, min(a.depth) AS length, max(CASE WHEN c.symbol_id IS NOT NULL THEN 1 ELSE 0 END) = 1 AS is_cyclic FROM blocks b JOIN ahead a ON a.id = b.id LEFT JOIN (SELECT DISTINCT e.symbol_id FROM block_edges e JOIN blocks f ON f.id = e.from_id JOIN blocks g ON g.id = e.to_id JOIN ahead r ON r.id = e.from_id WHERE g.start_line <= f.start_line) c ON c.symbol_id = b.symbol_id WHERE b.block_type IN ({', '.join(repr(x) for x in EXITS)}) GROUP BY b.symbol_id"),
)
def p30_entry_to_exit(t: dict[str, DataFrame]) -> DataFrame:
    """Of each function: the exit that is nearest to an entry along the edges (ties: the smallest id), the steps to it, and whether a reachable block goes back."""
    found = written(control_flow(t["blocks"], t["block_edges"]).where("distance IS NOT NULL"), "flow")
    exits = found.where(F.col("block_type").isin(*EXITS)).groupBy("symbol_id").agg(F.min(F.struct("distance", "id")).alias("m"))
    loops = found.groupBy("symbol_id").agg(F.max(F.col("back_to").isNotNull()).alias("is_cyclic"))
    return exits.join(loops, "symbol_id").select("symbol_id", F.col("m.id").alias("exit_id"), F.col("m.distance").alias("length"), "is_cyclic")


@sql_operator
def p31_block_statistics(d: Dialect) -> str:
    return "SELECT symbol_id, block_type, count(*) AS n, CAST(sum(complexity) AS BIGINT) AS complexity, round(avg(cost), 9) AS cost FROM blocks GROUP BY symbol_id, block_type"


@frame_operator("blocks block_edges", lambda d: _flow_sql("SELECT b.id, b.symbol_id, min(CASE WHEN g.start_line <= b.start_line THEN g.id END) AS back_to, b.id IN (SELECT id FROM behind) AS reaches_exit FROM blocks b LEFT JOIN block_edges e ON e.from_id = b.id LEFT JOIN blocks g ON g.id = e.to_id WHERE b.block_type = 'loop' GROUP BY b.id, b.symbol_id"))
def p32_exit_reachability(t: dict[str, DataFrame]) -> DataFrame:
    """For each loop: the block it goes back to, and whether a walk along the edges leads to an exit."""
    return control_flow(t["blocks"], t["block_edges"]).where("block_type = 'loop'").select("id", "symbol_id", "back_to", "reaches_exit")


_SPAWNS = "SELECT DISTINCT from_id AS a, to_id AS b FROM relationships WHERE type = '{}' AND to_id IS NOT NULL"


@frame_operator(
    "symbols relationships",
    lambda d: _reach_sql(_SPAWNS.format("inherits"), "SELECT DISTINCT a AS seed FROM e WHERE a NOT IN (SELECT b FROM e WHERE a <> b)", 1_000_000, "SELECT seed, id, depth FROM reached JOIN (SELECT id FROM symbols) s USING (id) WHERE seed IN (SELECT seed FROM reached WHERE depth > 0)"),
    kind="inherits",
)
def d38_spawn_chains(t: dict[str, DataFrame], kind: str = "spawn") -> DataFrame:
    """Everything that the first process of a chain of starts leads to, with the least steps to it. Chains begin where nothing else starts the process; a ring of processes has no first one and is left to M21."""
    edges = written(t["relationships"].where((F.col("type") == kind) & F.col("to_id").isNotNull()).select(F.col("from_id").alias("a"), F.col("to_id").alias("b")).distinct(), "spawns")
    others = edges.where("a <> b")
    first = others.select("a").distinct().join(others.select(F.col("b").alias("a")), "a", "left_anti").select(F.col("a").alias("seed"))  # with a start of another
    return distances(edges, first).join(t["symbols"].select("id"), "id", "left_semi").select("seed", "id", "depth")
