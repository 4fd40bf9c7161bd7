"""Call paths, chains and similar sets against plain searches."""

import random
import re

from pyspark.sql import functions as F

from codeloom.engine import Engine
from codeloom.operators import paths
from codeloom.operators.graph import reach, with_paths
from codeloom.operators.paths import chains, similar_classes, similar_sets, trace, walks, ways


def random_calls(rng, n, m):
    return list({(rng.randrange(n), rng.randrange(n)): rng.randrange(5) for _ in range(m)}.items())


def depth_first(edges, entry, depth, stops=()):
    """Paths in the order of a depth-first search, call sites by line and then id."""
    out = {}
    for (a, b), line in edges:
        out.setdefault(a, []).append((line, b))
    found = []

    def go(path):
        if len(path) > depth:
            found.append((path, "cut"))
        elif path[-1] not in out:
            found.append((path, "complete"))
        else:
            for _, b in sorted(out[path[-1]]):
                if b in path:
                    found.append(([*path, b], "cyclic"))
                elif b in stops:
                    found.append(([*path, b], "stopped"))
                else:
                    go([*path, b])

    go([entry])
    return found


def test_traced_paths_are_the_first_of_a_depth_first_search(spark):
    rng = random.Random(1)
    for n, m, depth, limit in ((6, 9, 4, 1000), (7, 18, 4, None), (9, 25, 5, 7), (4, 16, 6, 30), (12, 14, 8, 3)):
        edges = random_calls(rng, n, m)
        df = spark.createDataFrame([(a, b, line) for (a, b), line in edges], "a long, b long, line long")
        entries = spark.createDataFrame([(0,), (1,), (50,)], "id long")
        for stops in ((), (2, 3)):
            got = {}
            for r in trace(df, entries, depth=depth, limit=limit, stops=spark.createDataFrame([(s,) for s in stops], "id long") if stops else None).orderBy("entry", "place").collect():
                got.setdefault(r.entry, []).append((list(r.nodes), r.state))
                assert r.length == len(r.nodes) - 1
            assert got == {e: depth_first(edges, e, depth, stops)[:limit] for e in (0, 1, 50)}


def test_a_million_paths_are_counted_not_walked(spark):
    """20 diamonds: 2**20 paths, of which five are listed."""
    edges = [e for k in range(20) for e in ((3 * k, 3 * k + 1), (3 * k, 3 * k + 2), (3 * k + 1, 3 * k + 3), (3 * k + 2, 3 * k + 3))]
    df = spark.createDataFrame([(*e, 0) for e in edges], "a long, b long, line long")
    entry = spark.createDataFrame([(0,)], "id long")
    assert trace(df, entry, depth=3, limit=5).count() == 4
    counts = {(r.id, r.length): int(r.n) for r in ways(df, entry, 6).collect()}
    assert counts[(9, 6)] == 8 and counts[(3, 2)] == 2


def test_all_paths_are_listed(spark):
    """g02, d27: 144 paths of an entry, more than the hundred of a limit, each in its place."""
    calls = spark.createDataFrame([(1, 10 + k, k) for k in range(12)] + [(10 + k, 30 + m, m) for k in range(12) for m in range(12)] + [(30 + m, 50, 1) for m in range(12)], "caller_id long, callee_id long, line_number long")
    symbols = spark.createDataFrame([(k, k % 2 + 1) for k in range(60)], "id long, language_id long")
    engine = Engine(spark, symbols=symbols, calls=calls)
    got = engine.run("g02_execution_paths", entries="id = 1").orderBy("place").collect()
    assert [(r.place, r.path) for r in got] == [(12 * k + m + 1, f"1>{10 + k}>{30 + m}>50") for k in range(12) for m in range(12)]
    assert engine.run("d27_cross_language_chains", entries="id = 1").count() == 144


def test_ways_of_an_entry_are_summed_where_its_rows_meet(spark, monkeypatch):
    """d32: one exchange by entry alone before calls are spread out; the same rows where an entry has too many, where calls stand in several rows, and where numbers may pass a long."""
    rng = random.Random(8)
    pairs = sorted({(rng.randrange(12), rng.randrange(12)) for _ in range(40)})
    symbols = spark.createDataFrame([(k,) for k in range(12)], "id long")

    def counted(pairs, depth):
        out, level = {}, {(s, s): 1 for s in (0, 5)}
        for k in range(1, depth + 1):
            new = {}
            for (s, a), n in level.items():
                for b in (b for x, b in pairs if x == a):
                    new[s, b] = new.get((s, b), 0) + n
            for key, n in new.items():
                w, low, _ = out.get(key, (0, k, k))
                out[key] = (w + n, low, k)
            level = new
        return out

    for depth, more, most, row in ((4, [], paths.COUNTED, paths.CALLED), (4, [], 0, 2), (6, [(5, 100 + k) for k in range(3000)], paths.COUNTED, paths.CALLED)):
        monkeypatch.setattr(paths, "COUNTED", most)
        monkeypatch.setattr(paths, "CALLED", row)
        calls = spark.createDataFrame([*pairs, *more], "caller_id long, callee_id long")
        out = Engine(spark, symbols=symbols, calls=calls).run("d32_navigation", entries="id IN (0, 5)", depth=depth)
        if most:
            assert "hashpartitioning(entry" in (plan := out._jdf.queryExecution().executedPlan().toString()) and not re.search(r"hashpartitioning\(entry#\d+L, id#", plan)
        assert {(r.a, r.b): (r.ways, r.shortest, r.longest) for r in out.collect()} == counted([*pairs, *more], depth)


def test_all_paths_are_compared(spark):
    """d02: 144 paths of an entry, each with the 11 others that differ from it in one symbol at either place; the copy of a set has as many and its copy."""
    calls = spark.createDataFrame([(1, 10 + k, k) for k in range(12)] + [(10 + k, 30 + m, m) for k in range(12) for m in range(12)] + [(30 + m, 50, 1) for m in range(12)], "caller_id long, callee_id long, line_number long")
    symbols = spark.createDataFrame([(k,) for k in range(60)], "id long")
    got = Engine(spark, symbols=symbols, calls=calls).run("d02_redundant_paths", entries="id = 1", similarity=0.5).orderBy("place").collect()
    assert [(r.place, r.path, r.class_place, r.links) for r in got] == [(12 * k + m + 1, f"1>{10 + k}>{30 + m}>50", 1, 22) for k in range(12) for m in range(12)]
    calls = spark.createDataFrame([(1, 2, 1), (2, 3, 1), (3, 4, 1), (1, 3, 2), (3, 2, 2), (2, 4, 2)], "caller_id long, callee_id long, line_number long")
    got = Engine(spark, symbols=symbols, calls=calls).run("d02_redundant_paths", entries="id = 1", depth=3).collect()
    assert {(r.path, r.class_place, r.links) for r in got} == {("1>2>3>4", 1, 1), ("1>3>2>4", 1, 1), ("1>2>3>2", 2, 1), ("1>3>2>3", 2, 1), ("1>2>4", 3, 0), ("1>3>4", 4, 0)}


def test_walks_are_counted_from_their_ends(spark):
    """As many as ways leads to at that depth or to an end before it, for every caller, entry or not."""
    edges = [e for e, _ in random_calls(random.Random(6), 12, 20)]
    df = spark.createDataFrame(edges, "a long, b long")
    callers = sorted({a for a, _ in edges})
    want = dict.fromkeys(callers, 0)
    for r in ways(df, spark.createDataFrame([(a,) for a in callers], "id long"), 4).collect():
        want[r.entry] += int(r.n) if r.length == 4 or r.id not in callers else 0
    assert {r.id: int(r.n) for r in walks(df, 4).collect()} == want


def test_chains_are_the_shortest_simple_paths(spark):
    rng = random.Random(2)
    for n, m, depth in ((7, 14, 4), (6, 25, 5)):
        edges = sorted({(a, b) for (a, b), _ in random_calls(rng, n, m)})
        df = spark.createDataFrame(edges, "a long, b long")
        ids = spark.createDataFrame([(k,) for k in range(n)], "id long")
        want = {}
        for a in range(n):
            todo = [[a]]
            while todo:
                path = todo.pop()
                for x, b in edges:
                    if x == path[-1] and b not in path and len(path) <= depth:
                        want.setdefault((a, b), []).append([*path, b])
                        todo.append([*path, b])
        got = {}
        for r in chains(df, ids, ids, depth=depth, limit=10, width=1000).orderBy("place").collect():
            assert r.is_all
            got.setdefault((r.a, r.b), []).append(list(r.nodes))
        assert got == {k: sorted(v, key=lambda p: (len(p), p))[:10] for k, v in want.items()}
        few = chains(df, ids, ids, depth=depth, limit=10, width=1).collect()
        assert not all(r.is_all for r in few) and all(list(r.nodes) in want[(r.a, r.b)] for r in few)


def test_similar_sets_lose_no_pair(spark):
    rng = random.Random(3)
    base = [rng.sample(range(40), 12) for _ in range(6)]
    rows = []
    for k in range(150):
        items = [x for x in rng.choice(base) if rng.random() < 0.93] + rng.sample(range(40), rng.randrange(3))
        rows.append((k, k % 2, items))
    df = spark.createDataFrame([*rows, (900, 0, [])], "id long, grp long, items array<long>")
    for threshold in (0.5, 0.8, 1.0):
        for above in (False, True):
            want = set()
            for i, g, x in rows:
                for j, h, y in rows:
                    s = len(set(x) & set(y)) / len(set(x) | set(y))
                    if i < j and g == h and (s > threshold if above else s >= threshold):
                        want.add((i, j))
            assert {(r.a, r.b) for r in similar_sets(df, threshold, above=above).collect()} == want


def test_classes_of_similar_sets(spark):
    """Links (copies counted) and classes against all pairs; at 0.5 of up to five items, and at 0.8 of up to eleven, neighbours meet in parts, else by similar_sets."""
    rng = random.Random(5)
    for threshold, most, of in ((0.5, 5, 9), (0.8, 11, 12), (0.3, 5, 30)):
        sets = sorted({(g, frozenset(rng.sample(range(of), rng.randrange(1, most + 1)))) for g in range(2) for _ in range(40)}, key=lambda x: (x[0], sorted(x[1])))
        rows = [(i, g, sorted(x), rng.randrange(1, 4)) for i, (g, x) in enumerate(sets)]
        near = {i: [(j, w) for j, h, y, w in rows if h == g and j != i and len(set(x) & set(y)) / len(set(x) | set(y)) > threshold] for i, g, x, _ in rows}
        label = {i: i for i in near}
        while any(label[j] < label[i] for i in near for j, _ in near[i]):
            label |= {i: min([label[i], *(label[j] for j, _ in near[i])]) for i in near}
        got = {r.id: (r.links, r.component) for r in similar_classes(spark.createDataFrame(rows, "id long, grp long, items array<long>, copies long"), threshold).collect()}
        assert {i: n for i, (n, _) in got.items()} == {i: sum(w for _, w in near[i]) for i in near if near[i]}, threshold
        assert len({(got[i][1], label[i]) for i in got}) == len({got[i][1] for i in got}) == len({label[i] for i in got}), threshold


def test_paths_of_a_forest_lead_over_its_edges(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(40), rng.randrange(40)) for _ in range(70)] + [(100 + k, 101 + k) for k in range(9)]
    df = spark.createDataFrame(edges, "a long, b long")
    seeds = spark.createDataFrame([(0,), (7,), (100,)], "seed long")
    rows = with_paths(reach(df, seeds)).collect()
    have = set(edges)
    assert max(r.depth for r in rows) >= 9
    for r in rows:
        assert r.path[0] == r.seed and r.path[-1] == r.id and len(r.path) == r.depth + 1
        assert all(e in have for e in zip(r.path, r.path[1:], strict=False)) and (r.via is None) == (r.depth == 0) and (r.via in (None, r.path[-2] if r.depth else None))


def test_path_operators_on_a_ring(spark):
    """1 calls 2 and 3, 2 calls 4, 4 calls 1 (a ring), 3 calls nothing; 2 speaks another language."""
    symbols = spark.createDataFrame([(k, 2 if k == 2 else 1, "function", "f", 0, 10) for k in range(1, 6)], "id long, language_id long, kind string, file_path string, line long, end_line long")
    calls = spark.createDataFrame([(1, 2, 5), (1, 3, 4), (2, 4, 1), (4, 1, 1)], "caller_id long, callee_id long, line_number long")
    flow = spark.createDataFrame([([1, 3], 1.0)], "nodes array<long>, coverage double")
    engine = Engine(spark, symbols=symbols, calls=calls, flow_paths=flow)
    got = [(r.place, r.path, r.is_complete, r.is_cyclic) for r in engine.run("g02_execution_paths", entries="id = 1").orderBy("place").collect()]
    assert got == [(1, "1>3", True, False), (2, "1>2>4>1", False, True)]
    row = engine.run("d01_trace_paths", entries="id = 1").first()
    assert (row.paths, row.cyclic, row.longest, row.mean_coverage, row.critical, row.is_all) == (2, 1, 3, 75.0, 1, True)
    assert [(r.path, r.hops, r.crossings) for r in engine.run("d27_cross_language_chains", entries="id = 1").collect()] == [("1>2>4>1", 3, 2)]
    assert [(r.path, r.is_all) for r in engine.run("d09_call_chains_between", entries="id = 1", targets="id = 4").collect()] == [("1>2>4", True)]
    assert {(r.path, r.class_place, r.links) for r in engine.run("d02_redundant_paths", entries="id = 1", similarity=0.2).collect()} == {("1>3", 1, 1), ("1>2>4>1", 1, 1)}
    assert {(r.id, r.path) for r in engine.run("i02_ripple", seeds="id = 4").collect()} == {(2, "4>2"), (1, "4>2>1")}
    assert {(r.id, r.caller, r.path) for r in engine.run("g18_call_chains", entries="id = 1").where(F.col("depth") > 0).collect()} == {(2, 1, "1>2"), (3, 1, "1>3"), (4, 2, "1>2>4")}
    dead = engine.run("d04_dead_code", entries="id = 1").collect()
    assert [(r.id, r.is_called) for r in dead] == [(5, False)]
    assert [(r.symbols, r.dead, r.dead_percent) for r in engine.run("d04_dead_lines", entries="id = 3").collect()] == [(5, 4, 80.0)]
    assert {(r.caller_id, r.callee_id, r.reason) for r in engine.run("d04_dead_edges", entries="id = 3").collect()} == {(1, 2, "both ends unreachable"), (1, 3, "caller unreachable"), (2, 4, "both ends unreachable"), (4, 1, "both ends unreachable")}


def test_all_paths_are_placed_by_counts(spark):
    """g02: all paths of each entry by depth-first search, with stops; one that ends after as many calls as are followed, at what calls nothing, is complete. At most the rounds before the last stand in tables."""
    rng = random.Random(12)
    calls = [(rng.randrange(12), rng.randrange(14), rng.randrange(5)) for _ in range(40)] + [(20, 21, 1), (21, 22, 1), (22, 23, 1)]
    symbols = spark.createDataFrame([(k, k % 3) for k in range(24)], "id long, language_id long")
    engine = Engine(spark, symbols=symbols, calls=spark.createDataFrame(calls, "caller_id long, callee_id long, line_number long"))
    line = {}
    for a, b, n in calls:
        line[a, b] = min(n, line.get((a, b), n))
    ahead = {a: [b for _, b in sorted((n, b) for (x, b), n in line.items() if x == a)] for a, _ in line}

    def walk(nodes, depth, stops):
        for b in ahead.get(nodes[-1], ()):
            path = [*nodes, b]
            if b in nodes or b in stops or b not in ahead or len(path) > depth:
                yield path, b not in nodes and (b in stops or b not in ahead), b in nodes
            else:
                yield from walk(path, depth, stops)

    for depth, stops in ((3, ()), (4, (3, 7)), (1, ())):
        want = set()
        for entry in (0, 5, 20, 13):
            found = list(walk([entry], depth, stops)) or [([entry], True, False)]
            want |= {(entry, k, ">".join(map(str, nodes)), *state) for k, (nodes, *state) in enumerate(found, 1)}
        for limit in (None, 10**6):
            rows = engine.run("g02_execution_paths", entries="id IN (0, 5, 20, 13)", depth=depth, limit=limit, stops=",".join(map(str, stops)) or None).collect()
            assert {(r.start_id, r.place, r.path, r.is_complete, r.is_cyclic) for r in rows} == want and len(rows) == len(want), (depth, limit)
    kept = [{tuple(r) for r in engine.run("d27_cross_language_chains", entries="id IN (0, 5, 20, 13)", depth=4, limit=limit).collect()} for limit in (None, 10**6)]
    assert kept[0] == kept[1] and len(kept[0]) > 20
