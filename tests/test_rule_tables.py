"""Operators whose rules are tables of words, with their own defaults; every expected row is worked out by hand."""

import pytest

from codeloom.engine import Engine

SYMBOLS = [
    # id, name, kind, parent, signature, complexity, confidence, language, path
    (1, "Mesh", "class", None, "class Mesh", 1, 1.0, 1, "src/mesh.cpp"),
    (2, "createVertexBuffer", "method", 1, "VkBuffer createVertexBuffer(std::vector<float> v)", 2, 1.0, 1, "src/mesh.cpp"),
    (3, "BindBuffer", "method", 1, "void BindBuffer(VkBuffer b)", 2, 1.0, 1, "src/mesh.cpp"),
    (4, "LockQueue", "function", None, "void LockQueue(std::mutex& lock)", 2, 1.0, 1, "src/jobs.cpp"),
    (5, "makeWidgetFactory", "function", None, "Widget* makeWidgetFactory()", 4, 0.9, 1, "src/make.cpp"),
    (6, "EventListener", "class", None, "class EventListener", 20, 1.0, 2, "src/json/events.py"),
    (7, "UserEvent", "class", None, "class UserEvent", 1, 1.0, 1, "src/user.cpp"),
]
TEXTS = [
    (1, 'addr: os.Getenv("SERVICE_ADDR")\ncartConn = dial(addr)\nx := pb.NewCartClient(addr)\ny = OtherStub()'),
    (2, "function walk(n) {\n for (i) { total += i }\n walk(n - 1) }"),
    (3, "a = 10\nb = 200 // x\nc = 30\nd = 400\nif (a && b || c && d) switch (state) {}"),
    (4, ""),
]


@pytest.fixture(scope="module")
def engine(spark):
    symbols = spark.createDataFrame([(*s, f"app::{s[1]}", "", "app", 10, 20, 1, False, 1) for s in SYMBOLS], "id long, name string, kind string, parent_symbol_id long, signature string, complexity long, confidence double, language_id long, file_path string, qualified_name string, tag string, namespace string, line long, end_line long, parameter_count long, is_exported boolean, cognitive long")
    edges = spark.createDataFrame([(1, 4, 5, "spawn"), (2, 5, 6, "spawn"), (3, 6, 5, "spawn"), (4, 4, 99, "spawn"), (5, 7, 7, "spawn"), (6, 5, 3, "calls"), *((10 + k, 1, 6, "uses") for k in range(4))], "id long, from_id long, to_id long, type string").selectExpr("*", "1.0 AS confidence")
    calls = spark.createDataFrame([(5, 3, 1, False)], "caller_id long, callee_id long, line_number long, is_conditional boolean")
    languages = spark.createDataFrame([(1, "cpp"), (2, "python")], "id long, name string")
    return Engine(spark, symbols=symbols, relationships=edges, calls=calls, languages=languages, sources=spark.createDataFrame(TEXTS, "id long, text string"))


def rows(engine, name, *columns, **parameters):
    return sorted(tuple(r[c] for c in columns) for r in engine.run(name, **parameters).collect())


def test_use_of_interfaces(engine):
    assert rows(engine, "n30_api_tags", "id", "tag") == [
        (2, "external_api_vulkan"), (2, "stl_containers"), (2, "vulkan_buffer_management"),
        (3, "external_api_vulkan"), (3, "stl_functional"), (3, "vulkan_buffer_management"),
        (4, "stl_threading"), (4, "thread_safe"), (4, "threading_api"),
    ]
    assert rows(engine, "n30_buffer_lifecycle", "from_id", "to_id") == [(2, 3), (3, 3)]
    assert dict(rows(engine, "n31_api_usage", "tags", "symbols"))["stl_threading,thread_safe,threading_api"] == 1


def test_pattern_categories(engine):
    assert rows(engine, "d34_pattern_categories", "id", "k", "pattern", "family", "strength", "role", "health", "pattern_complexity", "refactoring", "stage") == [
        (2, 1, "Factory", "creational", 65, "creator", "warning", 20, "low", "stable"),
        (5, 1, "Factory", "creational", 72, "creator", "warning", 30, "low", "stable"),
        (6, 1, "Observer", "behavioral", 80, "observer", "problematic", 100, "medium", "stable"),
    ]


def test_shared_structures_and_processes(engine):
    assert rows(engine, "d37_shared_structures", "structure", "name", "languages", "uses") == [("boundary", "cpp_python_uses", "cpp,python", 4), ("format", "json", "python", 1), ("type", "Event", "cpp,python", 2), ("type", "User", "cpp", 1)]
    assert rows(engine, "d38_process_communication", "word", "symbols") == [("queue", 1)]
    assert rows(engine, "d38_spawn_chains", "seed", "id", "depth") == [(4, 4, 0), (4, 5, 1), (4, 6, 2)]


def test_texts(engine):
    assert rows(engine, "p14_quality_indicators", "id", "is_long", "complex_conditions", "magic_numbers") == [(1, False, False, False), (2, False, False, False), (3, False, True, True), (4, False, False, False)]
    assert rows(engine, "p15_algorithms", "id", "accumulates", "recursive", "state_machine", "pipeline") == [(1, False, False, False, False), (2, True, True, False, False), (3, False, False, True, False), (4, False, False, False, False)]
    assert rows(engine, "x12_connection_flow", "id", "line", "method", "field", "text") == [(1, 2, "connection", "addr", "cartConn = dial(addr"), (1, 3, "client-creation", "addr", "NewCartClient"), (1, 3, "connection", "addr", "NewCartClient(addr")]


def test_remote_services(spark):
    symbols = [(1, "checkout", "method", "app::checkout", "src/checkout.go"), (2, "CartService", "class", "Cart.CartService", "src/cart.cs"), (3, "cartService", "struct", "main::cartService", "src/cart.go"), (4, "CartServicer", "class", "CartServicer", "src/cart.py"), (5, "CartServiceImplBase", "class", "CartServiceImplBase", "gen/cart_pb2.py"), (6, "CartServiceStore", "class", "x", "src/Store.java"), (7, "MyCartService", "class", "MyCartService", "src/my.cs"), (8, "CartServiceHere", "class", "x", "src/checkout.go")]
    edges = [(1, 1, None, "invokes", "Cart"), (2, 1, None, "calls", "My"), (3, 1, None, "invokes", "")]
    e = Engine(spark, symbols=spark.createDataFrame(symbols, "id long, name string, kind string, qualified_name string, file_path string"), relationships=spark.createDataFrame(edges, "id long, from_id long, to_id long, type string, to_name string"))
    assert rows(e, "n26_rpc", "from_id", "to_id") == [(1, 2), (1, 3), (1, 4), (1, 6)]
