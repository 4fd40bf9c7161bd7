"""Bridges, services, contained texts and tags against plain searches and rows worked out by hand."""

import random

import pytest

from codeloom.engine import Engine
from codeloom.operators import crosslang
from codeloom.operators.textjoin import contained


def test_contained_texts_are_all_found(spark):
    rng = random.Random(1)
    word = lambda n: "".join(rng.choice("abc") for _ in range(n))
    needles = [word(rng.randrange(7)) for _ in range(60)] + ["", "zz", "a%", "é"]
    texts = [word(rng.randrange(20)) for _ in range(80)] + ["", "x a% y", "café", "az"]
    n, t = spark.createDataFrame([(x,) for x in [*needles, None]], "needle string"), spark.createDataFrame([(x,) for x in [*texts, None]], "text string")
    want = {(a, b) for a in needles for b in texts if a and a in b}
    for size in (1, 2, 3):
        got = [(r.needle, r.text) for r in contained(n, t, size).collect()]
        assert len(got) == len(set(got)) and set(got) == want
    assert contained(n.where("false"), t).collect() == []


SYMBOLS = [  # id, name, language, signature, tag
    (1, "UserApi", 1, "", ""), (2, "UserClient", 2, "", ""), (3, "SuperUserService", 3, "", "client"), (4, "OrderClient", 2, "", ""), (5, "UserClient", 1, "", ""),
    (6, "libopen", 1, "int(int)", "ffi"), (7, "py_open", 2, "void()", "ffi"), (8, "open_binding", 3, "int(int)", "extern"), (9, "close", 1, "x()", "ffi"),
    (10, "PointJson", 1, "", ""), (11, "json_point", 2, "", ""), (12, "PointJson", 1, "", ""), (13, "CarRepository", 1, "", ""), (14, "CarDao", 2, "", ""), (15, "get_port_config", 1, "", ""), (16, "PORT_SETTING", 2, "", ""), (17, "load_port_env", 2, "", ""),
]


def test_bridges(spark):
    df = spark.createDataFrame(SYMBOLS, "id long, name string, language_id long, signature string, tag string")
    engine = Engine(spark, symbols=df)
    got = {(r.bridge, r.from_key, r.to_key, r.from_language, r.to_language): (r.confidence, r.from_symbols, r.to_symbols, r.from_id, r.to_id) for r in engine.run("x10_bridges").collect()}
    assert got == {
        ("api", "user", "user", 2, 1): (0.7, 1, 1, 2, 1), ("api", "superuser", "user", 3, 1): (0.7, 1, 1, 3, 1),
        ("ffi", "core open", "core open", 1, 2): (0.8, 1, 1, 6, 7), ("ffi", "core open", "core open", 1, 3): (0.8, 1, 1, 6, 8), ("ffi", "core open", "core open", 2, 3): (0.8, 1, 1, 7, 8), ("ffi", "signature int(int)", "signature int(int)", 1, 3): (0.8, 1, 1, 6, 8),
        ("serialization", "point", "point", 1, 2): (0.6, 2, 1, 10, 11), ("database", "car", "car", 1, 2): (0.7, 1, 1, 13, 14), ("configuration", "port", "port", 1, 2): (0.8, 1, 2, 15, 16),
    }
    assert {r.id for r in engine.run("x10_bridge_members").where("bridge = 'serialization' AND key = 'point'").collect()} == {10, 11, 12}


def test_services_of_other_languages(spark):
    symbols = [(1, "CartService", "class", "shop.CartService"), (2, "MyPayServiceImpl", "class", "shop.MyPayServiceImpl"), (3, "MailServiceServer", "interface", "m.MailServiceServer"), (4, "BookClient", "function", "b.BookClient"), (5, "CartService", "function", "f")]
    edges = [(10, "Cart"), (11, "Pay"), (12, "mail_service"), (13, "Book"), (14, "None"), (15, "CartService"), (16, None), (17, "service")]
    rows = [(i, n, None, True) for i, n in edges] + [(18, "Cart", None, False), (19, "Cart", 1, True)]
    engine = Engine(spark, symbols=spark.createDataFrame(symbols, "id long, name string, kind string, qualified_name string"), relationships=spark.createDataFrame(rows, "id long, to_name string, to_id long, is_cross_language boolean"))
    got = {r.id: (r.symbol_id, r.strategy, r.confidence) for r in engine.run("n12_cross_language").collect()}
    assert got == {10: (1, "implementation", 0.8), 11: (2, "implementation", 0.8), 12: (3, "fuzzy", 0.6), 13: (4, "stub", 0.7), 15: (1, "implementation", 0.8)}


def test_tags(spark):
    tags = [(1, "code", None, "root", True, ["cpp"], True), (2, "pattern", 1, "pattern", False, ["cpp", "go"], True), (3, "factory", 2, "pattern", False, ["go"], True), (4, "old", 1, "root", True, ["go"], False), (5, "ring_a", 6, "ring", False, [], True), (6, "ring_b", 5, "ring", False, [], True), (7, "lost", 99, "root", False, ["go"], True)]
    held = [(100, 3, 0.6, True, "d1"), (100, 2, 0.9, False, "d2"), (101, 5, 0.5, True, "d1"), (101, 4, 0.4, True, "d1")]
    new = [(100, "factory", 0.3, False, "n"), (100, "factory", 0.7, True, "m"), (102, "old", 1.0, False, "n"), (102, "nothing", 1.0, False, "n"), (102, "code", 0.2, False, "n")]
    engine = Engine(
        spark, tags=spark.createDataFrame(tags, "id long, name string, parent_id long, category string, is_universal boolean, languages array<string>, is_active boolean"),
        tag_assignments=spark.createDataFrame(held, "symbol_id long, tag_id long, confidence double, is_automatic boolean, source string"), new_assignments=spark.createDataFrame(new, "symbol_id long, name string, confidence double, is_automatic boolean, source string"),
    )
    assert {(r.id, r.ancestor_id, r.depth) for r in engine.run("p20_tag_hierarchy").collect()} == {(k, k, 0) for k in range(1, 8)} | {(2, 1, 1), (3, 2, 1), (3, 1, 2), (4, 1, 1), (5, 6, 1), (6, 5, 1)}
    got = {(r.symbol_id, r.name): (r.is_own, r.confidence) for r in engine.run("p20_symbol_tags").collect()}
    assert got == {(100, "factory"): (True, 0.6), (100, "pattern"): (True, 0.9), (100, "code"): (False, 0.9), (101, "ring_a"): (True, 0.5), (101, "ring_b"): (False, 0.5), (101, "code"): (False, 0.4)}
    assert {r.name for r in engine.run("p20_tags_for_language", language="go").collect()} == {"code", "pattern", "factory", "lost"}
    assert {r.category: (r.tags, r.universal, r.assignments) for r in engine.run("p20_tags_by_category").collect()} == {"root": (2, 1, 0), "pattern": (2, 0, 2), "ring": (2, 0, 1)}
    after = {(r.symbol_id, r.tag_id): (r.confidence, r.source) for r in engine.run("p20_assign_tags").collect()}
    assert after == {(100, 3): (0.7, "m"), (100, 2): (0.9, "d2"), (101, 5): (0.5, "d1"), (101, 4): (0.4, "d1"), (102, 1): (0.2, "n")}


def test_names_by_context(spark):
    symbols = [(1, "main", "a", "a.cpp"), (2, "run", "a", "z.cpp"), (3, "run", "b", "b.cpp"), (4, "go", "c", "b.cpp"), (5, "go", "d", "a.cpp"), (6, "go", "e", "d.cpp"), (7, "far", "f", "e.cpp"), (8, "own", "g", "a.cpp"), (9, "own", "g", "c.cpp")]
    edges = [(1, 1, None, "calls", "run"), (2, 1, None, "calls", "go"), (3, 1, None, "calls", "far"), (4, 1, 3, "imports", "run"), (5, 1, None, "calls", "own"), (6, 1, None, "calls", "nothing")]
    engine = Engine(spark, symbols=spark.createDataFrame(symbols, "id long, name string, namespace string, file_path string"), relationships=spark.createDataFrame(edges, "id long, from_id long, to_id long, type string, to_name string"))
    assert {r.id: (r.symbol_id, r.level) for r in engine.run("n13_context").collect()} == {1: (2, "namespace"), 2: (4, "import"), 3: (7, "any"), 5: (8, "file")}


def test_layers_of_a_call_graph(spark):
    symbols = spark.createDataFrame([(k, f"f{k % 2}") for k in range(1, 7)], "id long, file_path string")
    calls = spark.createDataFrame([(1, 2), (2, 2), (2, 4), (1, 4), (4, 6), (5, 1), (1, None)], "caller_id long, callee_id long")
    got = {r.layer: tuple(r)[1:] for r in Engine(spark, symbols=symbols, calls=calls).run("d08_call_layers", entries="id IN (1, 2)").collect()}
    assert got == {0: (2, 1, 2), 1: (1, 0, 0), 2: (1, 0, 0)}


@pytest.mark.parametrize("lot", [3, 256])
def test_close_names_with_shared_stems(spark, monkeypatch, lot):
    """Names that differ by their numbers meet lot by lot, with the same result as all with all."""
    monkeypatch.setattr(crosslang, "LOT", lot)
    rng = random.Random(8)
    stems = ["red_ring_", "old_bolt_", "hot_bolt_", "blue_rings_", "", "x"]
    rows = [(k, rng.choice(stems) + str(rng.randrange(2000)), rng.randrange(3)) for k in range(120)] + [(500, "red_ring_7", 1), (501, "red_ring_7", 2), (502, None, 1)]

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, before = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y)))
        return row[-1]

    full = [r for r in rows if r[1] is not None]
    want = {(i, j) for i, a, x in full for j, b, y in full if i < j and x != y and 1.0 - distance(a, b) / max(len(a), len(b)) > 0.7}
    got = Engine(spark, symbols=spark.createDataFrame(rows, "id long, name string, language_id long")).run("x07_semantic_equivalents").collect()
    assert len(got) == len(want) and {(r.first_id, r.second_id) for r in got} == want
