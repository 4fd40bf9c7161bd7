import json

from pyspark.sql import functions as F

from codeloom.sources import ingest
from codeloom.streaming.changes import Progress, current, debounced, reindex

PYTHON = "import os\nclass A(B):\n    def f(self):\n        return g(1)\n"
CPP = '#include <vector>\n#define LIMIT 10\nnamespace n {\nclass C {\n  void run(int a) {\n    go(LIMIT);\n  }\n};\n}\nint main() {\n  run(1);\n}\n'


def test_discover_and_changes(spark, tmp_path):
    (tmp_path / "a.py").write_text(PYTHON)
    (tmp_path / "b.cpp").write_text(CPP)
    (tmp_path / "c.txt").write_text("no source")
    (tmp_path / "node_modules").mkdir()
    (tmp_path / "node_modules" / "d.js").write_text("x()")
    files = ingest.discover(spark, str(tmp_path))
    assert sorted(r.language for r in files.collect()) == ["cpp", "python"]
    index = files.withColumn("last_parsed", F.lit(1)).withColumn("hash", F.when(F.col("language") == "cpp", F.col("hash")).otherwise(F.lit("old")))
    assert [r.language for r in ingest.changed(files, index.select("path", "hash", "last_parsed")).collect()] == ["python"]


def test_parse(spark):
    files = spark.createDataFrame([("a.py", "python", PYTHON), ("b.cpp", "cpp", CPP), ("bad.py", "python", "def f(:\n"), ("e", "cpp", None)], "path string, language string, text string")
    got = {(r.path, r.kind, r.name, r.parent) for r in ingest.parsed(files).collect()}
    assert {("a.py", "class", "A", None), ("a.py", "inherits", "A", None), ("a.py", "method", "f", "A"), ("a.py", "call", "g", "A.f"), ("b.cpp", "namespace", "n", None), ("b.cpp", "class", "C", "n"), ("b.cpp", "method", "run", "C"), ("b.cpp", "function", "main", None), ("b.cpp", "call", "run", "main")} <= got
    macros = [(r.name, r.value, r.uses) for r in ingest.expanded_macros(files).collect()]
    assert macros == [("LIMIT", "10", 1)]


def test_macros(spark):
    code = "#define MAX(a, b) ((a) > (b) ? (a) : (b))\n#define LOG_INFO(m, ...) \\\n  do { app::Logger::getInstance().info(m); } \\\n  while(0)\n#define ON\nvoid f() {\n  LOG_INFO(1);\n  int x = MAX(1, 2);\n}\n"
    files = spark.createDataFrame([("a.h", "cpp", code), ("e.h", "cpp", None)], "path string, language string, text string")
    macros = ingest.expanded_macros(files)
    assert sorted((r.name, r.line, r.parameters, r.is_variadic, r.value, r.uses, r.complexity) for r in macros.collect()) == [
        ("LOG_INFO", 2, ["m", "..."], True, "do { app::Logger::getInstance().info(m); } while(0)", 1, 4),  # one, three calls, a loop, a statement: 1 + 1.5 + 1 + 0.3
        ("MAX", 1, ["a", "b"], False, "((a) > (b) ? (a) : (b))", 1, 2),  # one and a condition
    ]
    edges = ingest.macro_edges(ingest.parsed(files), macros).collect()
    assert sorted({(r.caller, r.target, r.type, r.confidence) for r in edges}) == [("f", "app::Logger", "uses", 0.95), ("f", "getInstance", "calls", 0.7), ("f", "getInstance", "calls", 0.95), ("f", "info", "calls", 0.7), ("f", "info", "calls", 0.95)]


def test_stores(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "id long, v string")
    new = spark.createDataFrame([(2, "x"), (3, "y"), (3, "y")], "id long, v string")
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    assert rows(ingest.insert_ignore(old, new, ["id"])) == [(1, "a"), (2, "b"), (3, "y")]
    assert rows(ingest.upsert(old, new, ["id"])) == [(1, "a"), (2, "x"), (3, "y")]
    assert rows(ingest.replace_latest(old, new, ["id"], "v")) == [(1, "a"), (2, "x"), (3, "y")]
    tables = {"symbols": spark.createDataFrame([(1, 1), (2, 2)], "id long, project_id long"), "calls": spark.createDataFrame([(1, 2), (2, 2)], "caller_id long, callee_id long")}
    left = ingest.delete_project(tables, 1)
    assert rows(left["symbols"]) == [(2, 2)] and rows(left["calls"]) == [(2, 2)]


EVENTS = [(1, "a", 0, "change"), (2, "a", 2, "change"), (3, "a", 20, "delete"), (4, "b", 1, "change"), (9, "z", 9000, "change")]


def events(spark):
    return spark.createDataFrame(EVENTS, "event_id long, path string, s long, event_type string").withColumn("ts", F.timestamp_seconds("s")).drop("s")


def test_debounce_on_a_table_and_a_stream(spark, tmp_path):
    want = [("a", 2), ("a", 3), ("b", 4)]
    got = sorted((r.path, r.event_id) for r in debounced(events(spark), delay="5 seconds").collect())
    assert got == [*want, ("z", 9)]
    events(spark).where("event_id < 9").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events(spark).schema).parquet(str(tmp_path / "in"))

    def run():
        q = debounced(stream, delay="5 seconds", watermark="10 seconds").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()

    run()
    events(spark).where("event_id = 9").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))  # moves the watermark past all bursts but its own
    run()
    assert sorted((r.path, r.event_id) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == want


def test_reindex_and_progress(spark, tmp_path):
    schema = "path string, language string, text string, deleted boolean"
    seen = []
    listener = Progress(seen.append)
    spark.streams.addListener(listener)
    for k, rows in enumerate([[("a.py", "python", PYTHON, False), ("b.cpp", "cpp", CPP, False)], [("b.cpp", "cpp", None, True)]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        reindex(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), ingest.parsed, str(tmp_path / "symbols"), str(tmp_path / "ck")).awaitTermination()
    spark.streams.removeListener(listener)
    paths = {r.path for r in current(spark.read.parquet(str(tmp_path / "symbols"))).collect()}
    assert paths == {"a.py"}
    json.dumps(seen)


def test_watched_files(spark, tmp_path):
    from codeloom.streaming.changes import watched

    (tmp_path / "in" / "node_modules").mkdir(parents=True)
    for name in ("a.py", "b.cpp", "node_modules/c.py"):
        (tmp_path / "in" / name).write_text(f"# {name}")
    stream = watched(spark, str(tmp_path / "in"), pattern="*.py", excluded="/node_modules/")

    def run():
        stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "at")).trigger(availableNow=True).start().awaitTermination()
        return sorted((r.path.split("/")[-1], r.text, r.event_type) for r in spark.read.parquet(str(tmp_path / "out")).collect())

    assert run() == [("a.py", "# a.py", "change")]
    (tmp_path / "in" / "d.py").write_text("# d")
    assert run() == [("a.py", "# a.py", "change"), ("d.py", "# d", "change")]
