"""Operators on a small code base with names as real code has them; every expected row is worked out by hand."""

import pytest

from codeloom.engine import Engine

SYMBOLS = [
    # id, name, kind, parent, signature, return_type, namespace, file_path, tag, language
    (1, "ConfigRegistry", "class", None, "class ConfigRegistry", "", "app::core", "src/core/registry.cpp", "core", 1),
    (2, "getInstance", "method", 1, "static ConfigRegistry& getInstance()", "ConfigRegistry&", "app::core", "src/core/registry.cpp", "", 1),
    (3, "TerrainRenderer", "class", None, "class TerrainRenderer : public gfx::BaseRenderer", "", "app::gfx", "src/gui/terrain.ixx", "gpu", 1),
    (4, "BaseRenderer", "class", None, "class BaseRenderer", "", "app::gfx", "include/base.h", "", 1),
    (5, "draw", "method", 4, "virtual void draw(int width)", "void", "app::gfx", "include/base.h", "", 1),
    (6, "draw", "method", 3, "void draw(int width)", "void", "app::gfx", "src/gui/terrain.ixx", "", 1),
    (7, "MakeRenderer", "function", None, "std::unique_ptr<TerrainRenderer> MakeRenderer()", "std::unique_ptr<TerrainRenderer>", "app", "src/make.cpp", "factory", 1),
    (8, "dispatchNoise", "function", None, "void dispatchNoise(compute::Kernel k)", "void", "app", "src/noise.cpp", "", 1),
    (9, "runFrame", "function", None, "HeightMap runFrame(int n)", "HeightMap", "app", "src/service/frame.cpp", "", 1),
    (10, "smooth", "function", None, "void smooth(HeightMap map)", "void", "app", "src/dao/smooth.cpp", "", 1),
    (11, "subscribe", "method", 1, "void subscribe(std::function<void()> callback)", "void", "app::core", "src/core/registry.cpp", "", 1),
    (12, "RegisterHook", "function", None, "void RegisterHook()", "void", "app", "src/hooks.cpp", "", 1),
    (13, "run_frame", "function", None, "def run_frame(n)", "", "tools", "tools/frame.py", "", 2),
    (14, "TerrainRenderer", "constructor", 3, "TerrainRenderer()", "", "app::gfx", "src/gui/terrain.ixx", "", 1),
    (15, "~TerrainRenderer", "destructor", 3, "~TerrainRenderer()", "", "app::gfx", "src/gui/terrain.ixx", "", 1),
    (16, "draw", "method", 4, "virtual void draw(float width)", "void", "app::gfx", "include/base.h", "", 1),
    (17, "resize", "method", 4, "void resize()", "void", "app::gfx", "include/base.h", "", 1),
    (18, "resize", "method", 3, "void resize()", "void", "app::gfx", "src/gui/terrain.ixx", "", 1),
]
EDGES = [(1, 3, 4, "inherits"), (2, 3, 4, "calls"), (3, 9, 8, "calls"), (4, 12, 11, "calls"), (5, 9, 10, "calls"), (6, 9, None, "calls")]
CALLS = [(9, 8, 1, False), (9, 10, 2, True), (9, 10, 3, False), (12, 11, 1, False), (10, 9, 4, False)]


@pytest.fixture(scope="module")
def engine(spark):
    symbols = spark.createDataFrame([(*s, 1.0, 10 * s[0], 10 * s[0] + 5) for s in SYMBOLS], "id long, name string, kind string, parent_symbol_id long, signature string, return_type string, namespace string, file_path string, tag string, language_id long, confidence double, line long, end_line long")
    edges = spark.createDataFrame([(*e, "printf" if e[2] is None else "") for e in EDGES], "id long, from_id long, to_id long, type string, to_name string")
    calls = spark.createDataFrame(CALLS, "caller_id long, callee_id long, line_number long, is_conditional boolean")
    blocks = spark.createDataFrame([(1, 9, "entry", 1), (2, 9, "conditional", 2), (3, 9, "loop", 3), (4, 9, "exit", 4), (5, 9, "basic", 5), (6, 8, "basic", 1)], "id long, symbol_id long, block_type string, start_line long")
    steps = spark.createDataFrame([(9, 1, 2), (9, 2, 3), (9, 2, 4), (9, 3, 2), (9, 5, 4)], "symbol_id long, from_id long, to_id long")
    return Engine(spark, symbols=symbols, relationships=edges, calls=calls, blocks=blocks, block_edges=steps)


def rows(engine, name, *columns, **parameters):
    return sorted(tuple(r[c] for c in columns) if len(columns) > 1 else r[columns[0]] for r in engine.run(name, **parameters).collect())


def test_patterns(engine):
    assert rows(engine, "p01_singletons", "id") == [1]
    assert rows(engine, "p02_factories", "id") == []
    assert rows(engine, "p02_factories", "id", words=["make"]) == [7]
    assert rows(engine, "p03_observers", "id") == [1]
    assert {r for r in rows(engine, "p21_suggest_tags", "id", "tag")} == {(2, "singleton")}
    layers = dict(rows(engine, "p11_layers", "id", "layer"))
    assert (layers[3], layers[9], layers[10], layers[1]) == ("presentation", "business", "data", "unknown")
    roles = dict(rows(engine, "p09_semantic_roles", "id", "role"))
    assert (roles[2], roles[9], roles[14]) == ("data", "behavior", "utility")


def test_inferred_edges(engine):
    assert rows(engine, "n17_overrides", "from_id", "to_id") == [(18, 17)]
    assert rows(engine, "n18_inherits", "from_id", "to_id") == [(3, 4)]
    assert rows(engine, "n19_overrides_by_name", "from_id", "to_id") == [(6, 5), (6, 16)]
    assert rows(engine, "n15_gpu_dispatch", "from_id", "to_id") == [(9, 8)]
    assert rows(engine, "n21_factories", "from_id", "to_id") == [(7, 3)]
    assert rows(engine, "n22_callbacks", "from_id", "to_id") == [(12, 11)]
    assert rows(engine, "n23_raii", "class_id", "acquire_id", "release_id") == [(3, 14, 15)]
    assert rows(engine, "n24_producers", "data_type", "role", "id") == [("HeightMap", "consumer", 9), ("HeightMap", "consumer", 10), ("HeightMap", "producer", 9), ("std::unique_ptr<TerrainRenderer>", "producer", 7)]
    assert rows(engine, "n10_standard_library", "id", "is_standard") == [(6, True)]


def test_impact_scores(engine):
    points = dict(rows(engine, "i04_criticality", "id", "criticality"))
    assert (points[1], points[3], points[4], points[7]) == (3.0, 3.0, 1.2, 1.0)  # core; gpu and .ixx; two uses and include/; factory
    hard = dict(rows(engine, "i05_node_complexity", "id", "node_complexity"))
    assert (hard[1], hard[3], hard[7], hard[13]) == (2.0, 3.0, 3.5, 1.5)  # two levels; two levels and gpu; template and one level; one level


def test_equivalents_meet_across_namespaces(engine):
    assert rows(engine, "x07_semantic_equivalents", "first_id", "second_id") == [(9, 13)]


def test_calls_are_read_whole(engine):
    assert rows(engine, "g04_unused_functions", "id") == [2, 5, 6, 7, 12, 13, 16, 17, 18]
    assert rows(engine, "d04_dead_code", "id", entries="9") == [1, 2, 3, 4, 5, 6, 7, 11, 12, 13, 14, 15, 16, 17, 18]
    assert rows(engine, "m21_circular_dependencies", "id", "component", "cycle_length") == [(9, 9, 2), (10, 9, 2)]
    assert rows(engine, "g25_shortest_path", "to_id", "path", entries="12, 9") == [(8, "9>8"), (10, "9>10"), (11, "12>11")]


def test_control_flow_is_walked(engine):
    assert rows(engine, "p28_unreachable_blocks", "id") == [5, 6]
    assert rows(engine, "p30_entry_to_exit", "symbol_id", "exit_id", "length", "is_cyclic") == [(9, 4, 2, True)]
    assert rows(engine, "p32_exit_reachability", "id", "back_to", "reaches_exit") == [(3, 2, True)]


def test_a_fresh_engine_knows_its_operators(spark, engine):
    assert "g09_hotspots" in Engine.operators() and len(Engine.operators()) > 280
    spark.sql("SELECT 1 AS one").createOrReplaceTempView("symbols")
    assert rows(engine, "p01_singletons", "id") == [1] and spark.table("symbols").columns == ["one"]
    spark.catalog.dropTempView("symbols")
    with pytest.raises(ValueError):
        engine.run("no_such_operator")
