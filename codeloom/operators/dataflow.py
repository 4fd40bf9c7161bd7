"""Variables of functions: where they are set and read, flows between those places, and taint.

blocks hold code, in the order of their lines. What belongs to one function is bounded
by its source, so each function's flows are found whole in one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..engine import Engine, frame_operator, sql_operator
from ..plans import rules
from ..plans.dialect import DUCK, SPARK, Dialect
from ..storage import written
from .graph import batched, by_function, one_by_one, walked

#: How code declares a variable, and names that none has.
DECLARED = [r"(?:int|float|double|char|bool|auto|const|string)\s+([A-Za-z0-9_]+)", r"([A-Za-z0-9_]+)\s*=", r"for\s*\(\s*(?:int|auto)?\s*([A-Za-z0-9_]+)"]
RESERVED = ["if", "else", "for", "while", "return", "class", "struct"]


def _about(d: Dialect, code: str, name: str, *ends: tuple[str, str]) -> str:
    """Whether code has a name between one of the pairs of patterns."""
    quoted = lambda p: f"'{d.escaped(p) if d.spark else p}'"
    test = "rlike({}, {})" if d.spark else "regexp_matches({}, {})"
    return "(" + " OR ".join(test.format(code, f"concat({quoted(a)}, {name}, {quoted(b)})") for a, b in ends) + ")"


def _kind(d: Dialect, code: str, name: str) -> str:
    written = _about(d, code, name, ("", r"\s*=([^=]|$)"))
    changed = _about(d, code, name, ("", r"\s*[-+*/]="), (r"[+][+]", ""), ("", r"[+][+]"), ("--", ""), ("", "--"))
    return f"CASE WHEN {written} THEN 'write' WHEN {changed} THEN 'modify' ELSE 'read' END"


def _variables(d: Dialect) -> str:
    """symbol_id, name, scope, declared_line and block_id (null for parameters): the first declaration of each variable.

    Parameters are what stands between the first parentheses of a signature, split at
    commas outside angle brackets; the last word is the name, without a mark of reference.
    """
    bare = d.extract("signature", r"\(([^)]*)\)")
    for _ in range(3):
        bare = d.replace(bare, "<[^<>]*>", "")
    last = d.extract("trim(part)", r"([^ \t]*)$")
    first_mark = d.replace(last, "^([^&*]*)[&*]", "$1" if d.spark else r"\1")
    named = d.extract_all("code", DECLARED[0]), d.extract_all("code", DECLARED[1]), d.extract_all("code", DECLARED[2])
    reserved = ", ".join(f"'{x}'" for x in RESERVED)
    return f"""SELECT symbol_id, name, scope, declared_line, block_id FROM (
        SELECT *, row_number() OVER (PARTITION BY symbol_id, name ORDER BY CASE scope WHEN 'parameter' THEN 0 ELSE 1 END, declared_line, block_id) AS k FROM (
          SELECT symbol_id, {first_mark} AS name, 'parameter' AS scope, declared_line, CAST(NULL AS BIGINT) AS block_id FROM (SELECT id AS symbol_id, line AS declared_line, {d.explode(d.split(bare, ','))} AS part FROM symbols WHERE id IN (SELECT symbol_id FROM blocks)) p
          UNION ALL SELECT symbol_id, {d.explode(d.union(d.union(*named[:2]), named[2]))} AS name, 'local' AS scope, start_line AS declared_line, id AS block_id FROM blocks WHERE code IS NOT NULL) a
        WHERE {d.matches('name', '^[a-zA-Z_][A-Za-z0-9_]*$')} AND name NOT IN ({reserved})) v WHERE k = 1"""


def _usages(d: Dialect) -> str:
    """symbol_id, name, scope, block_id, line, kind, is_returned, is_passed: blocks, from a variable's declaration on, with its name as a word."""
    calls = d.extract_all("b.code", r"[A-Za-z0-9_]+\s*\([^)]*\)", 0)
    words = d.explode(d.distinct(d.extract_all("code", "[A-Za-z0-9_]+", 0)))
    return f"""SELECT v.symbol_id, v.name, v.scope, b.id AS block_id, b.start_line AS line, {_kind(d, 'b.code', 'v.name')} AS kind, b.block_type = 'return' AS is_returned, {d.size(d.filter_lines(calls, d.contains('x', 'v.name')))} > 0 AS is_passed
        FROM ({_variables(d)}) v JOIN (SELECT *, {words} AS word FROM blocks WHERE code IS NOT NULL) b ON b.symbol_id = v.symbol_id AND b.word = v.name
        WHERE b.start_line > v.declared_line OR b.start_line = v.declared_line AND (v.block_id IS NULL OR b.id >= v.block_id)"""


@sql_operator
def d16_variable_usage(d: Dialect) -> str:
    """Variables of each function: scope, declaration, how many blocks write, modify and read them, whether they are returned or passed to a call."""
    n = "count(*) FILTER (WHERE u.kind = '{}') AS {}".format
    some = "count(*) FILTER (WHERE u.{0}) > 0 AS {0}".format
    return f"""SELECT v.symbol_id, v.name, v.scope, v.declared_line, {n('write', 'writes')}, {n('modify', 'changes')}, {n('read', 'reads')}, {some('is_returned')}, {some('is_passed')}
        FROM ({_variables(d)}) v LEFT JOIN ({_usages(d)}) u ON u.symbol_id = v.symbol_id AND u.name = v.name GROUP BY v.symbol_id, v.name, v.scope, v.declared_line"""


_REACH = """reach AS (SELECT DISTINCT symbol_id, block_id AS a, block_id AS b FROM usages WHERE kind <> 'read' UNION SELECT r.symbol_id, r.a, e.to_id FROM reach r JOIN block_edges e ON e.symbol_id = r.symbol_id AND e.from_id = r.b),
    flows AS (SELECT w.symbol_id, w.name, w.scope, w.block_id AS from_id, r.block_id AS to_id, w.kind, w.line FROM usages w JOIN usages r ON r.symbol_id = w.symbol_id AND r.name = w.name AND r.kind = 'read' JOIN reach x ON x.symbol_id = w.symbol_id AND x.a = w.block_id AND x.b = r.block_id WHERE w.kind <> 'read')"""


@frame_operator("symbols blocks block_edges", lambda d: f"WITH RECURSIVE usages AS ({_usages(DUCK)}), {_REACH} SELECT * FROM flows")
def d17_def_use(t: dict[str, DataFrame]) -> DataFrame:
    """From each block that writes or modifies a variable to each that reads it, where a walk along the edges leads there."""
    usages = Engine(t["blocks"].sparkSession, **t).sql(_usages(SPARK))
    of = usages.groupBy("symbol_id").agg(F.collect_list(F.struct("name", "scope", "block_id", "line", "kind")).alias("usages"))
    steps = t["block_edges"].groupBy("symbol_id").agg(F.collect_list(F.struct("from_id", "to_id")).alias("edges"))
    kinds = {"symbol_id": pa.int64(), "name": pa.string(), "scope": pa.string(), "from_id": pa.int64(), "to_id": pa.int64(), "kind": pa.string(), "line": pa.int64()}

    def flows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for symbol, own, pairs in one_by_one(batches, "symbol_id", "usages", "edges"):
                out, read, met = {}, {}, {}
                for e in pairs or ():
                    out.setdefault(e["from_id"], []).append(e["to_id"])
                for u in own:
                    if u["kind"] == "read":
                        read.setdefault(u["name"], []).append(u["block_id"])
                for u in own:
                    if u["kind"] != "read" and u["name"] in read:
                        at = u["block_id"]
                        if at not in met:
                            met[at] = walked([at], out)
                        yield from ((symbol, u["name"], u["scope"], at, b, u["kind"], u["line"]) for b in read[u["name"]] if b in met[at])

        return batched(rows(), list(kinds), list(kinds.values()))

    schema = "symbol_id long, name string, scope string, from_id long, to_id long, kind string, line long"
    return by_function(of, steps, "symbol_id", "usages", "edges").mapInArrow(flows, schema)


def _words(column: str, words: list[str]) -> str:
    """Whether one of the words is part of a column, without regard to case."""
    return "(" + " OR ".join(f"contains(lower({column}), '{w}')" for w in words) + ")"


def _ends(d: Dialect, kinds: dict[str, list[str]], sets: bool) -> str:
    """symbol_id, name, id, type, is_checked: blocks with a word of a kind, and the variables that stand there (sets: that they write)."""
    only = f" AND {_kind(d, 'b.code', 'v.name')} = 'write'" if sets else ""
    each = " UNION ALL ".join(f"SELECT symbol_id, id, code, '{k}' AS type FROM blocks WHERE {_words('code', w)}" for k, w in kinds.items())
    return f"SELECT v.symbol_id, v.name, b.id, b.type, {_words('b.code', rules.SANITISERS)} AS is_checked FROM ({each}) b JOIN ({_variables(d)}) v ON v.symbol_id = b.symbol_id WHERE {d.contains('b.code', 'v.name')}{only}"


def _taint_sql(d: Dialect) -> str:
    """The oracle."""
    return f"""WITH RECURSIVE usages AS ({_usages(DUCK)}), {_REACH} SELECT s.symbol_id, s.name, s.id AS source_id, s.type AS source_type, k.id AS sink_id, k.type AS sink_type, s.is_checked OR k.is_checked AS is_sanitised
        FROM ({_ends(DUCK, rules.TAINT_SOURCES, True)}) s JOIN ({_ends(DUCK, rules.TAINT_SINKS, False)}) k ON k.symbol_id = s.symbol_id AND k.name = s.name
        WHERE EXISTS (SELECT 1 FROM flows f WHERE f.symbol_id = s.symbol_id AND f.name = s.name AND (f.from_id = s.id OR f.to_id = k.id))"""


@frame_operator("symbols blocks block_edges", _taint_sql)
def d19_taint(t: dict[str, DataFrame], sources: dict[str, list[str]] = rules.TAINT_SOURCES, sinks: dict[str, list[str]] = rules.TAINT_SINKS) -> DataFrame:
    """Sources and sinks of one variable where a flow of it leaves the source or meets the sink; sanitised if either block has a word of checking.

    A source writes the variable; a sink holds its name anywhere in its code, as part of a word too.
    """
    engine = Engine(t["blocks"].sparkSession, **t)
    flows = written(d17_def_use(t), "flows")
    key = ["symbol_id", "name"]
    leaves = flows.select(*key, F.col("from_id").alias("source_id"), F.lit(True).alias("leaves")).distinct()
    meets = flows.select(*key, F.col("to_id").alias("sink_id"), F.lit(True).alias("meets")).distinct()
    s = engine.sql(_ends(SPARK, sources, True)).select(*key, F.col("id").alias("source_id"), F.col("type").alias("source_type"), F.col("is_checked").alias("checks"))
    s = written(s, "sources")  # each side in a plan of its own: Spark fails to bind columns of one that reads variables and blocks on both
    k = engine.sql(_ends(SPARK, sinks, False)).select(*key, F.col("id").alias("sink_id"), F.col("type").alias("sink_type"), F.col("is_checked").alias("checked"))
    k = written(k, "sinks")
    pairs = s.join(leaves, [*key, "source_id"], "left").join(k.join(meets, [*key, "sink_id"], "left"), key).where("leaves OR meets")
    return pairs.select(*key, "source_id", "source_type", "sink_id", "sink_type", (F.col("checks") | F.col("checked")).alias("is_sanitised"))
