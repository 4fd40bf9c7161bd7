"""Services, embedded code, keys and merging against rows worked out by hand and plain loops."""

import random

from codeloom.engine import Engine
from codeloom.operators.vectors import greedy_merge
from codeloom.sources.services import protocol_of, service_addresses, service_of, service_registry

CODE = """package main
a := os.Getenv("PRODUCT_CATALOG_SERVICE_ADDR")
mustMapEnv(&svc.cart, "CART_SERVICE_ADDR")
b = process.env.REDIS_HOST; c = process.env['EMAIL_ADDR']
d = os.environ.get("DB_ADDR"), "cartservice:7070", "https://example.org:8443/x"
"redis:6379" 'postgres://u:p@store:5432/x' "broker:9092"
"""


def test_services_in_code(spark):
    df = spark.createDataFrame([(1, CODE), (2, None), (3, "")], "id long, text string")
    got = [(r.kind, r.written, r.service, r.port, r.protocol, r.line) for r in service_addresses(df).collect()]
    assert got == [
        ("variable", "PRODUCT_CATALOG_SERVICE_ADDR", "productcatalogservice", None, "go", 2), ("variable", "CART_SERVICE_ADDR", "cartservice", None, "go", 3), ("variable", "REDIS_HOST", "redis", None, "javascript", 4),
        ("variable", "EMAIL_ADDR", "emailservice", None, "javascript", 4), ("variable", "DB_ADDR", "db", None, "python", 5), ("address", "cartservice:7070", "cartservice", 7070, "grpc", 5),
        ("address", "https://example.org:8443/x", "example.org", 8443, "http", 5), ("address", "redis:6379", "redis", 6379, "redis", 6), ("address", "postgres://u:p@store:5432/x", "store", 5432, "database", 6), ("address", "broker:9092", "broker", 9092, "kafka", 6),
    ]
    assert [protocol_of(p) for p in (80, 5432, 8500, 5050, 1)] == ["http", "database", "http", "grpc", "grpc"]
    assert [service_of(v) for v in ("A_B_SERVICE_ADDR", "COLLECTOR_ADDR", "PAY_ADDR", "X_HOST")] == ["abservice", "collector", "payservice", "x"]


YAML = """spec:
  env:
  - name: CART_SERVICE_ADDR
    value: "cart:7070"
  - name: OTHER
    value: "x:1"
"""
COMPOSE = """version: "3"
services:
  web:
    image: "nginx:1"
    ports:
      - "8080:80"
      - 443
  db:
    expose:
      - "5432"
    environment:
      - "9999"
volumes:
  data:
"""


def test_service_registry(spark):
    df = spark.createDataFrame([(1, YAML), (2, COMPOSE), (3, None)], "id long, text string")
    got = {tuple(r) for r in service_registry(df).collect()}
    assert got == {(1, "cartservice", "CART_SERVICE_ADDR", "cart", 7070, "grpc"), (2, "web", "ports", "web", 80, "http"), (2, "web", "ports", "web", 443, "http"), (2, "db", "ports", "db", 5432, "database")}


def test_embedded_code(spark):
    text = "x = 'select a,\n b from t';\ny = \"it's\"\n<script src=a>\nf('insert into x values (1)')\n</script> `selected`"
    got = [tuple(r)[1:] for r in Engine(spark, sources=spark.createDataFrame([(1, text), (2, None)], "id long, text string")).run("x11_embedded_spans").collect()]
    assert got == [("sql", 1, 2, "'select a,\n b from t'"), ("javascript", 4, 6, "\nf('insert into x values (1)')\n"), ("sql", 5, 5, "'insert into x values (1)'")]


def test_keys_and_their_parts(spark):
    symbols = [(1, "f", "a::f", "src/c:x.cpp", 10, 3, 7), (2, "op@", "", "b.cpp", 1, None, None)]
    df = spark.createDataFrame(symbols, "id long, name string, qualified_name string, file_path string, line long, column long, complexity long")
    engine = Engine(spark, symbols=df)
    keys = engine.run("n29_symbol_keys").orderBy("id").collect()
    assert tuple(keys[0])[1:] == ("a::f@src/c:x.cpp:10:3", "src/c:x.cpp:f:10:3", "f", "a::f", "a::f@src/c:x.cpp:10:3:7") and keys[1].primary_key == "op@@b.cpp:1:0"
    given = [(1, keys[0].primary_key, "primary"), (2, keys[0].alternative_key, "alternative"), (3, keys[0].embedding_key, "embedding"), (4, "no key", "primary"), (5, keys[1].primary_key, "primary"), (6, "f", "simple")]
    got = {r.id: tuple(r)[2:] for r in Engine(spark, symbols=df, symbol_keys=spark.createDataFrame(given, "id long, key string, strategy string")).run("n29_parse_keys").collect()}
    none = (None,) * 4
    assert got == {1: ("a::f", "src/c:x.cpp", 10, 3), 2: ("f", "src/c:x.cpp", 10, 3), 3: ("a::f", "src/c:x.cpp", 10, 3), 4: none, 5: ("op@", "b.cpp", 1, 0), 6: none}


def test_merging_is_that_of_a_walk_in_order(spark):
    rng = random.Random(5)
    for n, m in ((12, 14), (9, 20), (6, 0)):
        pairs = sorted({tuple(sorted(rng.sample(range(n), 2))) for _ in range(m)})
        into = {}
        for i in range(n):
            if i not in into:
                into[i] = i
                into |= {b: i for a, b in pairs if a == i and b not in into}
        ids = spark.createDataFrame([(k,) for k in range(n)], "id long")
        got = greedy_merge(ids, spark.createDataFrame(pairs, "a long, b long"))
        assert {r.id: r.merged_into for r in got.collect()} == into
