"""Paths and dependences of control flow against plain searches and rows worked out by hand."""

import random
import time

import pytest

from codeloom.engine import Engine
from codeloom.operators.controlflow import best_paths


def all_paths(start, targets, out):
    """Every path that repeats no block and ends at the first target: (cost, steps, blocks)."""
    found, todo = [], [((start,), 0)]
    while todo:
        path, cost = todo.pop()
        if path[-1] in targets:
            found.append((cost, len(path), list(path)))
            continue
        todo += [((*path, b), cost + c) for b, (c, _) in out.get(path[-1], {}).items() if b not in path]
    return sorted(found)


def test_best_paths_of_any_graph_are_those_of_a_full_search():
    rng = random.Random(1)
    for _ in range(1500):
        n = rng.randrange(1, 8)
        out = {}
        for _ in range(rng.randrange(2 * n + 1)):
            out.setdefault(rng.randrange(n), {})[rng.randrange(n)] = (rng.choice([-3, -1, 0, 0, 1, 2]), 1)
        targets = {b for b in range(n) if rng.random() < 0.3}
        for k in (1, 5):
            assert best_paths(0, targets, out, k) == [(c, p) for c, _, p in all_paths(0, targets, out)[:k]]


@pytest.mark.parametrize("weights", [(2, 1), (1, 1)])
def test_thirty_diamonds_in_a_second(weights):
    """2**30 paths, of different and of equal complexity, each diamond with a way back to its head."""
    out = {}
    for k in range(30):
        a, b, c, d = 3 * k, 3 * k + 1, 3 * k + 2, 3 * k + 3
        out[a] = {b: (-weights[0], 1), c: (-weights[1], 1)}
        out[b], out[c] = {d: (0, 1)}, {d: (0, 1), a: (-9, 1)}
    began = time.perf_counter()
    found = best_paths(0, {90}, out, 5)
    assert time.perf_counter() - began < 1
    assert len(found) == 5 and found[0] == (-30 * weights[0], [x for k in range(30) for x in (3 * k, 3 * k + 1)] + [90])


# if/else (1), a loop (2) and an early return (3), as they are in source:
#  1: 10 entry, 11 if -> 12 or 13, both -> 14 exit
#  2: 20 entry, 21 loop head -> 22 body -> 21, 21 -> 23 exit
#  3: 30 entry, 31 if -> 32 return, or 33 -> 34 exit
BLOCKS = [(1, 10, "entry"), (1, 11, "conditional"), (1, 12, "basic"), (1, 13, "basic"), (1, 14, "exit"), (2, 20, "entry"), (2, 21, "loop"), (2, 22, "basic"), (2, 23, "exit"), (3, 30, "entry"), (3, 31, "conditional"), (3, 32, "return"), (3, 33, "basic"), (3, 34, "exit")]
EDGES = [(1, 10, 11, "next"), (1, 11, 12, "true"), (1, 11, 13, "false"), (1, 12, 14, "next"), (1, 13, 14, "next"), (2, 20, 21, "next"), (2, 21, 22, "true"), (2, 22, 21, "loop-back"), (2, 21, 23, "false"), (3, 30, 31, "next"), (3, 31, 32, "true"), (3, 31, 33, "false"), (3, 33, 34, "next")]
CODE = {11: "if (size > 0)", 12: "int total = size", 13: "size += 1", 14: "return use(total)", 22: "total += step"}
SYMBOLS = [(1, "int one(int size, map<int, long> table)"), (2, "void two(Step& step)"), (3, "int three()")]


@pytest.fixture(scope="module")
def engine(spark):
    blocks = spark.createDataFrame([(s, i, t, 10 * i, i - 9 if i < 20 else 1, CODE.get(i)) for s, i, t in BLOCKS], "symbol_id long, id long, block_type string, start_line long, complexity long, code string")
    return Engine(
        spark,
        symbols=spark.createDataFrame([(i, s, 1) for i, s in SYMBOLS], "id long, signature string, line long"),
        blocks=blocks,
        block_edges=spark.createDataFrame(EDGES, "symbol_id long, from_id long, to_id long, kind string"),
        arguments=spark.createDataFrame([(3, 1, 7, 0, "n"), (3, 1, 7, 1, "t"), (3, 1, 7, 2, "extra"), (1, 3, 8, 0, "none")], "caller_id long, callee_id long, line_number long, position long, argument string"),
    )


def test_control_dependences(engine):
    got = sorted((r.symbol_id, r.from_id, r.to_id, r.through) for r in engine.run("d18_dependencies").where("type = 'control'").collect())
    assert got == [(1, 11, 12, "true"), (1, 11, 13, "false"), (2, 21, 21, "true"), (2, 21, 22, "true"), (3, 31, 32, "true"), (3, 31, 33, "false"), (3, 31, 34, "false")]


def test_data_dependences_and_parameters(engine):
    data = sorted((r.from_id, r.to_id, r.through) for r in engine.run("d18_dependencies").where("type = 'data'").collect())
    assert (12, 14, "total") in data
    # what stands in parentheses after a word counts as handed on, a condition as well
    got = {(r.symbol_id, r.position): (r.name, r.type, r.reads, r.changes, r.is_passed) for r in engine.run("d18_parameter_flow").collect()}
    assert got == {(1, 0): ("size", "int", 2, 1, True), (1, 1): ("table", "map", 0, 0, False), (2, 0): ("step", "Step&", 1, 0, False)}
    bound = {(r.callee_id, r.position): (r.argument, r.parameter, r.type) for r in engine.run("d18_argument_binding").collect()}
    assert bound == {(1, 0): ("n", "size", "int"), (1, 1): ("t", "table", "map"), (1, 2): ("extra", None, None), (3, 0): ("none", None, None)}


def test_hot_paths(engine):
    assert [(r.symbol_id, r.rank, r.path, r.complexity, r.length) for r in engine.run("p29_hot_paths").orderBy("symbol_id", "rank").collect()] == [
        (1, 1, "10>11>13>14", 12, 4), (1, 2, "10>11>12>14", 11, 4), (2, 1, "20>21>23", 3, 3), (3, 1, "30>31>33>34", 4, 4), (3, 2, "30>31>32", 3, 3),
    ]
    got = {(r.exit_id, r["rank"]): (r.path, r.probability, r.type, r.estimated_time, r.critical_nodes) for r in engine.run("d13_hot_paths").collect()}
    assert got == {
        (14, 1): ("10>11>12>14", 0.7, "main", 10, 1), (14, 2): ("10>11>13>14", 0.3, "early-exit", 10, 1), (23, 1): ("20>21>23", 0.06, "main", 54, 1),
        (32, 1): ("30>31>32", 0.7, "main", 9, 1), (34, 1): ("30>31>33>34", 0.3, "main", 10, 1),
    }


def test_shortest_paths_of_functions(engine):
    got = {(r.entry_id, r.exit_id): (r.path, r.conditions, r.complexity, r.is_cyclic) for r in engine.run("p30_shortest_paths").collect()}
    assert got == {
        (10, 14): ("10>11>12>14", "if (size > 0)", 11, False), (20, 23): ("20>21>23", "", 3, False), (30, 32): ("30>31>32", "", 3, False), (30, 34): ("30>31>33>34", "", 4, False),
    }
