"""Feature vectors and flows of variables on a small function; every expected row is worked out by hand."""

import math

import pytest

from codeloom.engine import Engine

SYMBOL = (1, "runFrame", "function", "int runFrame(map<int, int> &data, int n)", "int", "src/service/frame.cpp", 2, 4, 10, 15, 2)
CODE = [
    # id, line, type, code
    (1, 2, "entry", "int x = readline()"),
    (2, 3, "basic", "y = x + n"),
    (3, 4, "conditional", "if (check(y)) y += 1"),
    (4, 5, "exit", "printf(y)"),
    (5, 6, "return", "return x"),
    (6, 7, "basic", "printf(x)"),
]
TEXT = "#pragma once\nint runFrame() {\n  // go on\n  return x + 1; }\n"


@pytest.fixture(scope="module")
def engine(spark):
    empty = (2, "", "class", None, None, "gone.cpp", None, None, None, None, None)
    symbols = spark.createDataFrame([SYMBOL, empty], "id long, name string, kind string, signature string, return_type string, file_path string, line long, end_line long, complexity long, cognitive long, parameter_count long")
    edges = spark.createDataFrame([(1, 1, 2, "calls"), (2, 1, 1, "calls"), (3, 2, 1, "imports"), (4, 1, None, "uses")], "id long, from_id long, to_id long, type string")
    sources = spark.createDataFrame([(7, "src/service/frame.cpp", TEXT)], "id long, path string, text string")
    nodes = spark.createDataFrame([(1, "identifier", 4), (1, "identifier", 2), (1, "other", 0)], "symbol_id long, type string, depth long")
    blocks = spark.createDataFrame([(i, 1, line, kind, code) for i, line, kind, code in CODE] + [(7, 1, 8, "basic", None)], "id long, symbol_id long, start_line long, block_type string, code string")
    steps = spark.createDataFrame([(1, 1, 2), (1, 2, 3), (1, 3, 4), (1, 4, 5)], "symbol_id long, from_id long, to_id long")
    vectors = spark.createDataFrame([(1, [1.0, 2.0, 3.0]), (2, [1.0, 2.0, 3.0, 4.0, 5.0]), (3, [0.0] * 5), (4, [])], "id long, vec array<float>")
    return Engine(spark, symbols=symbols, relationships=edges, sources=sources, syntax_nodes=nodes, blocks=blocks, block_edges=steps, vectors=vectors)


def rows(engine, name, *columns, **parameters):
    return sorted(tuple(r[c] for c in columns) for r in engine.run(name, **parameters).collect())


def test_features(engine):
    got = {r.id: [r[f"f{k:02d}"] for k in range(80)] for r in engine.run("e01_feature_vector").collect()}
    f = got[1]
    assert (f[0], f[1], f[20], f[21]) == (2, 0, 0.4, 0.2)
    assert f[22:29] == [0.5, 0.5, 0.1, 2 / 15, 3 / 200, 0.4, 0.06]  # three lines; 40 characters of signature; three of type
    words = "int runFrame() { // go on return x + 1; }".split()
    text = "\n".join(TEXT.split("\n")[1:4])
    assert f[29:32] == [1 / len(words), 3 / len(text), 5 / len(words)]  # return; two slashes and a plus; int go on return x
    assert f[32:37] == [8 / 20, 1 / 8, 0, 1, 0] and f[37:39] == [1 / 3, 0]
    assert f[39:45] == [0, 0.55, 0, 0, 0, 0] and f[45:53] == [0, 0.3, 0, 0, 0, 0, 0, 0]  # a behaviour by its kind and "run"; three calls and uses
    assert f[53:62] == [0.2, 0.1, 0, 0, 0, 0, 0.1, 0, 0.2]
    assert f[62:72] == [0] * 9 + [1] and f[72:77] == [0, 0.8, 0, 0, 0]
    assert f[77:80] == [(len(text) - 2) / 3 / 80, 0, 0.03]
    assert (got[2][64], got[2][78], got[2][79]) == (1, 1, 0.01)  # a class without text has one blank line


def test_vectors_are_reduced(engine):
    assert rows(engine, "e02_reduced", "id", "r000", "r001", "r002", "r003", dimensions=4)[:1] == [(1, 1, 2, 3, 0)]
    size = math.sqrt(2**2 + 4.5**2)
    assert rows(engine, "e02_reduced", "id", "r000", "r001", dimensions=2) == [(1, round(1.5 / math.sqrt(11.25), 5), round(3 / math.sqrt(11.25), 5)), (2, round(2 / size, 5), round(4.5 / size, 5)), (3, 0, 0), (4, 0, 0)]
    whole = {r.id: [r[f"v{k:02d}"] for k in range(80)] for r in engine.run("e03_batch").collect()}
    assert all(abs(sum(x * x for x in v) - 1) < 1e-12 for v in whole.values())


def test_variables(engine):
    assert rows(engine, "d16_variable_usage", "name", "scope", "declared_line", "writes", "changes", "reads", "is_returned", "is_passed") == [
        ("data", "parameter", 2, 0, 0, 0, False, False),
        ("n", "parameter", 2, 0, 0, 1, False, False),
        ("x", "local", 2, 1, 0, 3, True, True),
        ("y", "local", 3, 1, 1, 1, False, True),
    ]
    assert rows(engine, "d17_def_use", "name", "from_id", "to_id", "kind") == [("x", 1, 2, "write"), ("x", 1, 5, "write"), ("y", 2, 4, "write"), ("y", 3, 4, "modify")]


def test_taint(engine):
    assert rows(engine, "d19_taint", "name", "source_id", "source_type", "sink_id", "sink_type", "is_sanitised") == [("x", 1, "file", 6, "output", False), ("x", 1, "user-input", 6, "output", False)]
