import random

import pytest

from codeloom.engine import Engine
from codeloom.operators import graph
from codeloom.operators.components import connected_components
from codeloom.operators.graph import Reached, reach, strongly_connected

GRAPHS = {
    "chain": [(1, 2), (2, 3), (3, 4)],
    "diamond": [(1, 2), (1, 3), (2, 4), (3, 4)],
    "cycle": [(1, 2), (2, 3), (3, 1)],
    "self_loop": [(1, 1)],
    "parallel": [(1, 2), (1, 2), (1, 2)],
    "islands": [(1, 2), (3, 4)],
    "dangling": [(1, None), (2, 3)],
    "two_cycles": [(1, 2), (2, 1), (2, 3), (3, 4), (4, 3), (5, 1)],
}


def frame(spark, edges):
    return spark.createDataFrame(edges, "a long, b long")


@pytest.mark.parametrize(
    ("name", "expected"),
    [
        ("chain", {1: 1, 2: 1, 3: 1, 4: 1}), ("self_loop", {1: 1}), ("parallel", {1: 1, 2: 1}),
        ("islands", {1: 1, 2: 1, 3: 3, 4: 3}), ("dangling", {2: 2, 3: 2}),
    ],
)
def test_components(spark, name, expected):
    assert {r.id: r.component for r in connected_components(frame(spark, GRAPHS[name])).collect()} == expected


@pytest.mark.parametrize(("name", "expected"), [("chain", {}), ("cycle", {1: 1, 2: 1, 3: 1}), ("self_loop", {1: 1}), ("two_cycles", {1: 1, 2: 1, 3: 3, 4: 3})])
def test_strongly_connected(spark, name, expected):
    assert {r.id: r.component for r in strongly_connected(frame(spark, GRAPHS[name])).collect()} == expected


def test_components_of_a_long_chain(spark):
    order = list(range(3000))
    random.Random(6).shuffle(order)
    got = connected_components(frame(spark, [*zip(order, order[1:], strict=False), (9001, 9000)]), max_rounds=20).collect()
    assert {r.component for r in got if r.id < 3000} == {0} and {r.component for r in got if r.id >= 3000} == {9000}


def test_reach_is_breadth_first(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(30), rng.randrange(30)) for _ in range(60)]
    got = {(r.seed, r.id): r.depth for r in reach(frame(spark, edges), spark.createDataFrame([(0,), (7,)], "seed long"), 4).collect()}
    want = {}
    for seed in (0, 7):
        level = {seed}
        for depth in range(5):
            for v in level:
                want.setdefault((seed, v), depth)
            level = {b for a, b in edges if a in level}
    assert got == want


def test_empty_graph(spark):
    assert connected_components(frame(spark, [])).collect() == []
    assert strongly_connected(frame(spark, [])).collect() == []


def test_masks_of_many_seeds_keep_each_seed_apart(spark):
    """150 seeds in lots of 64: distances and the smallest vertex before are those of a plain search for each; one row of a lot tells of many seeds."""
    rng = random.Random(9)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(500)]
    seeds = sorted(rng.sample(range(200), 150))
    met = Reached(frame(spark, edges), spark.createDataFrame([(s,) for s in seeds], "seed long"), 6)
    got = {(r.seed, r.id): (r.depth, r.via) for r in met.forest().collect()}
    want = {}
    for seed in seeds:
        level = {seed: None}
        for depth in range(7):
            want |= {(seed, v): (depth, via) for v, via in level.items()}
            level = {b: min(a for a, x in edges if x == b and a in level) for _, b in [e for e in edges if e[0] in level] if (seed, b) not in want}
    assert got == want
    assert met.masks.count() < len(want) / 4


def test_descendants_are_counted_however_far(spark):
    """d31: a chain of 13 calls."""
    calls = spark.createDataFrame([(k, k + 1) for k in range(1, 14)], "caller_id long, callee_id long")
    symbols = spark.createDataFrame([(k,) for k in range(1, 15)], "id long")
    run = Engine(spark, symbols=symbols, calls=calls).run
    assert [tuple(r) for r in run("d31_process_tree", entries="id = 1").collect()] == [(1, 13, 13)]
    assert [tuple(r) for r in run("d31_process_tree", entries="id = 1", depth=4).collect()] == [(1, 4, 4)]


def test_shortest_paths_however_far_and_by_turns(spark, monkeypatch):
    """g25: a chain of 13 calls, and a random graph; of equally short paths the smallest as text, whatever the turns."""
    rng = random.Random(3)
    calls = [(100 + k, 101 + k) for k in range(13)] + [(rng.randrange(30), rng.randrange(30)) for _ in range(80)]
    df = spark.createDataFrame(calls, "caller_id long, callee_id long")
    symbols = spark.createDataFrame([(k,) for k in range(120)], "id long")
    want = set()
    for seed in [*range(30), 100]:
        best = level = {seed: str(seed)}
        for depth in range(1, 20):
            new = {}
            for a, b in calls:
                if a in level and b not in best:
                    new[b] = min(new.get(b, "~"), f"{level[a]}>{b}")
            want |= {(seed, b, depth, path) for b, path in new.items()}
            best, level = best | new, new
    for turn in (graph.TURN, 400):
        monkeypatch.setattr(graph, "TURN", turn)
        rows = Engine(spark, symbols=symbols, calls=df).run("g25_shortest_path", entries="id < 30 OR id = 100").collect()
        assert {tuple(r) for r in rows} == want and len(rows) == len(want)
