"""Metrics of texts, blocks of texts and intervals against values worked out by hand."""

import math
import random

import pytest

from codeloom.engine import Engine, load
from codeloom.operators.intervals import brace_blocks, indented_blocks, inside, nested, tree_depths

SIGNATURES = {
    "void f(map<int, vector<int>> m)": 1, "void g(int a, function<void(int, int)> cb, int c)": 3, "h()": 0, "no parentheses": 0, "k( )": 0, None: 0,
    'void q(const char* s = "a, (b", int x)': 2, "void r(int (*cb)(int, int), array<int, 3> a[2])": 2, "s(int a, , int b,)": 2, "t(char c = '\\'', int d)": 2, "u(int a = p->q, int b)": 2, "(x, y) => z": 2, "f(a)(b, c)": 2,
}


def test_parameters(spark):
    rows = list(enumerate(SIGNATURES))
    got = {r.id: r.parameters for r in Engine(spark, symbols=spark.createDataFrame(rows, "id long, signature string")).run("m04_parameter_count").collect()}
    assert {s: got[k] for k, s in rows} == SIGNATURES


TEXTS = {
    1: "/** Sum of two numbers */ int a;",
    2: '/* a * b ** c */ x = "// no comment"; // y\nz = \'/*\'; # w\n',
    3: "/****\n * boxed *\n ****/ f(1)",
    4: "",
    5: "a /* open",
    6: "int x = a + b; /* int y = c */ if (x) return x;",
    7: "function fact(n) { return n * fact(n - 1); }",
    8: "const go = function () { stop(); }",
}
TOKENS = {
    1: ["int", "a", ";"], 2: ["x", "=", '"', "/", "/", "no", "comment", '"', ";", "z", "=", "'", "/", "*", "'", ";"], 3: ["f", "(", "1", ")"], 4: [], 5: ["a", "/", "*", "open"],
    6: "int x = a + b ; if ( x ) return x ;".split(), 7: "function fact ( n ) { return n * fact ( n - 1 ) ; }".split(), 8: "const go = function ( ) { stop ( ) ; }".split(),
}


@pytest.fixture(scope="module")
def texts(spark):
    load()
    return Engine(spark, sources=spark.createDataFrame([(k, f"f{k}.js", v) for k, v in TEXTS.items()], "id long, path string, text string"))


def test_tokens_without_comments(texts):
    got = {r.id: (r.tokens, r.distinct_tokens) for r in texts.run("m07_tokens").collect()}
    assert got == {k: (len(v), len(set(v))) for k, v in TOKENS.items()}


def test_halstead_and_maintainability(texts):
    """Of text 6: operators = + if return (1 each), operands int x (3 times) a b."""
    row = texts.run("m08_halstead").where("id = 6").first()
    assert (row.operators, row.operands, row.vocabulary) == (4, 6, 8)
    assert row.volume == pytest.approx(10 * 3) and row.difficulty == pytest.approx(4 / 2 * 6 / 4)
    index = texts.run("m10_maintainability").where("id = 6").first().maintainability
    assert index == pytest.approx(min(100, 171 - 5.2 * math.log(30) - 0.23 * 2 - 16.2 * math.log(1)), abs=1e-4)
    assert {r.token: (r.n, r.texts) for r in texts.run("m09_language_tokens").where("token IN ('return', '+', 'class')").collect()} == {"return": (2, 2), "+": (1, 1), "class": (0, 0)}


def test_recursion(texts):
    assert {r.id for r in texts.run("m12_hints").where("is_recursive").collect()} == {7}


def test_performance_words(spark):
    rows = [(1, "Binary SEARCH for x"), (2, "read a file"), (3, "buffer in nested loops"), (4, None), (5, "log in parallel at random")]
    got = {r.id: tuple(r)[1:] for r in Engine(spark, sources=spark.createDataFrame(rows, "id long, text string")).run("p17_performance").collect()}
    assert got == {
        1: ("cpu-intensive", "linear", "low", "low", "low", False, True), 2: ("io-intensive", "unknown", "low", "low", "medium", False, True), 3: ("memory-intensive", "polynomial", "low", "medium", "low", False, True),
        4: ("balanced", "unknown", "low", "low", "low", False, True), 5: ("balanced", "logarithmic", "low", "low", "low", True, False),
    }


def test_names_fields_and_searches(spark):
    symbols = [(1, "load_all", "a", "function"), (2, "save_all", "a", "function"), (3, "LoadAll", "a", "class"), (4, "loadOne", "a", "method"), (5, "read_x", "b", "function"), (6, "read_y", "b", "function"), (7, "size", "c", "field"), (8, "size", "c", "field"), (9, "size", "c", "function")]
    edges = [(1, 1, "reads_field", "box.inner.size"), (2, 1, "calls", "box.size"), (3, 1, "writes_field", "size"), (4, 1, "reads_field", "box.none"), (5, 1, "reads_field", "box_size")]
    engine = Engine(
        spark, symbols=spark.createDataFrame(symbols, "id long, name string, namespace string, kind string"),
        relationships=spark.createDataFrame([(*e, None) for e in edges], "id long, from_id long, type string, to_name string, to_id long"),
    )
    assert [(r.namespace, r.dominant, r.symbols) for r in engine.run("e18_naming_inconsistency").collect()] == [("a", 2, 4)]  # c is one style: other
    assert {(r.id, r.segment, r.symbol_id) for r in engine.run("n03_field_fallback").collect()} == {(1, "size", 7), (3, "size", 7)}
    assert {r.id: r.relevance for r in engine.run("e09_similar_code", words="load all").collect()} == {1: 1, 2: 4, 3: 2, 4: 3}
    assert {r.id for r in engine.run("e09_similar_code", words="one").collect()} == {4}
    assert {r.id: r.relevance for r in engine.run("e09_similar_code", words="read x y").collect()} == {5: 3, 6: 3}


CPP = """int f(int a) {            // if (no) {
  if (a > g("}")) {
    for (int i = 0; i < size(a); i++) {
      while (true) { h(); }
    }
  } else if (a) return k(a);
  try {
    do { m(); } while (a);
  } catch (const E& e) {
    throw e;
  }
  if (a)
    for (;;)
      n();
  /* while (x) { */
  return 0;
}
"""


def test_blocks_between_braces():
    blocks, calls = brace_blocks(CPP)
    assert [(k, a, b, c) for k, a, b, c in blocks] == [
        ("conditional", 2, 6, 'a > g("}")'), ("loop", 3, 5, "int i = 0; i < size(a); i++"), ("loop", 4, 4, "true"), ("conditional", 6, 6, "a"), ("return", 6, 6, ""), ("try", 7, 9, ""), ("loop", 8, 8, ""), ("loop", 8, 8, "a"),
        ("catch", 9, 11, "const E& e"), ("throw", 10, 10, ""), ("conditional", 12, 14, "a"), ("loop", 13, 14, ";;"), ("return", 16, 16, ""),
    ]
    assert calls == [("f", 1), ("g", 2), ("size", 3), ("h", 4), ("k", 6), ("m", 8), ("n", 14)]
    for cut in range(len(CPP)):  # cut anywhere: no block ends before it begins
        assert all(a <= b for _, a, b, _ in brace_blocks(CPP[:cut])[0])


PYTHON = '''def f(a):
    if a > g(")"):  # while x:
        for x in h(a):
            k(x)

    elif a:
        return m(a)
    """
    while no: pass
    """
    try:
        n()
    except E:
        raise
'''


def test_blocks_by_indent():
    blocks, calls = indented_blocks(PYTHON)
    assert blocks == [("conditional", 2, 4, "a > g()"), ("loop", 3, 4, "x in h(a)"), ("conditional", 6, 7, "a"), ("return", 7, 7, ""), ("try", 11, 12, ""), ("catch", 13, 14, "E"), ("throw", 14, 14, "")]
    assert calls == [("g", 2), ("h", 3), ("k", 4), ("m", 7), ("n", 12)]


def test_blocks_of_files(spark):
    rows = [(1, "a.cpp", CPP), (2, "b.py", PYTHON), (3, "c.cpp", None), (4, None, "")]
    got = Engine(spark, sources=spark.createDataFrame(rows, "id long, path string, text string")).run("p27_blocks").orderBy("id", "place").collect()
    assert {r.id for r in got} == {1, 2}
    of = {(r.id, r.start_line, r.type): (r.parent and [p for p in got if (p.id, p.place) == (r.id, r.parent)][0].start_line, r.depth) for r in got}
    assert of[1, 2, "conditional"] == (None, 0) and of[1, 3, "loop"] == (2, 1) and of[1, 4, "loop"] == (3, 2) and of[1, 10, "throw"] == (9, 1) and of[2, 3, "loop"] == (2, 1) and of[2, 7, "return"] == (6, 1)


def test_nesting_of_random_intervals():
    rng = random.Random(1)
    for _ in range(300):
        spans = []

        def fill(lo, hi, spans=spans):
            while lo <= hi and rng.random() < 0.7:
                a = rng.randint(lo, hi)
                b = rng.randint(a, hi)
                spans.append((a, b))
                if b > a + 1:
                    fill(a + 1, b - 1)
                lo = b + 1

        fill(0, 30)
        spans.sort(key=lambda s: (s[0], -s[1]))
        for (a, b), (parent, depth) in zip(spans, nested(spans), strict=True):
            around = [k for k, (c, d) in enumerate(spans) if c < a and d > b]
            assert depth == len(around) and parent == (max(around) if around else None)


def test_points_in_intervals(spark):
    rng = random.Random(2)
    points = [(k, rng.randrange(3), rng.randrange(300)) for k in range(200)]
    blocks = [(k, rng.randrange(3), a := rng.randrange(300), a + rng.choice([-1, 0, 5, 63, 64, 200])) for k in range(40)]
    want = {(p, b) for p, s, x in points for b, t, lo, hi in blocks if s == t and lo <= x <= hi}
    for bucket in (1, 7, 64, 1000):
        got = inside(spark.createDataFrame(points, "p long, symbol_id long, line long"), spark.createDataFrame(blocks, "b long, symbol_id long, start_line long, end_line long"), bucket)
        assert sorted((r.p, r.b) for r in got.collect()) == sorted(want)


def test_depths_of_trees_and_rings(spark):
    rows = [(1, None), (2, 1), (3, 2), (4, 99), (5, 6), (6, 7), (7, 5), (8, 5), (9, 9)] + [(100 + k, 99 + k if k else None) for k in range(40)]
    got = {r.id: r.depth for r in tree_depths(spark.createDataFrame(rows, "id long, parent_id long")).collect()}
    assert got == {1: 0, 2: 1, 3: 2, 4: 0, 5: None, 6: None, 7: None, 8: None, 9: None} | {100 + k: k for k in range(40)}
    blocks = spark.createDataFrame([(i, 1, "loop" if i < 4 else "try", p) for i, p in rows[:9]], "id long, symbol_id long, block_type string, parent_id long")
    row = Engine(spark, blocks=blocks).run("p31_nesting").first()
    assert (row.blocks, row.loop_blocks, row.exception_blocks, row.max_nesting_depth, row.in_rings) == (9, 3, 6, 2, 5)


def test_bottlenecks_and_targets(spark):
    blocks = [(1, 7, "loop", 10, 30, "for (x = 0; x < v.size(); x++)"), (2, 7, "loop", 15, 20, "while (go)"), (3, 7, "basic", 16, 16, "fread(f)"), (4, 7, "basic", 40, 40, "mutex.lock()"), (5, 8, "basic", 15, 15, "x"), (6, 7, "basic", 18, None, None)]
    df = spark.createDataFrame(blocks, "id long, symbol_id long, block_type string, start_line long, end_line long, code string")
    calls = spark.createDataFrame([(7, 50, 16), (7, 50, 17), (7, 51, 40), (7, 52, 31), (8, 53, 16), (7, 54, 18)], "caller_id long, callee_id long, line_number long")
    engine = Engine(spark, blocks=df, calls=calls)
    got = {(r.id, r.type): (r.severity, r.body, r.estimated_time) for r in engine.run("d14_bottlenecks").collect()}
    assert got == {(1, "cpu"): ("high", 3, 3000), (3, "io"): ("medium", None, None), (4, "synchronization"): ("high", None, None)}
    assert {(r.block_id, r.callee_id) for r in engine.run("d41_navigation_targets").collect()} == {(1, 50), (1, 54), (2, 50), (2, 54), (3, 50), (4, 51), (6, 54)}


def test_members_by_their_qualified_names(spark):
    rows = [(1, "a::Box", "class", None), (2, "a::Box::size", "method", 1), (3, "a::Box::fill", "method", None), (4, "a::Box::Lid::open", "method", None), (5, "a::Boxer", "class", None), (6, "size", "function", None)]
    df = spark.createDataFrame([(*r, 0, 10, 1) for r in rows], "id long, qualified_name string, kind string, parent_symbol_id long, line long, end_line long, complexity long")
    assert {(r.class_id, r.member_id, r.source) for r in Engine(spark, symbols=df).run("d42_containment").collect()} == {(1, 2, "stored"), (1, 3, "inferred")}
