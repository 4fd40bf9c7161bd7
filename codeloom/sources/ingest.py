"""Files, languages, parsing and storing.

Files come in by Spark's readers; parsing is one pass over partitions (mapInPandas
with an iterator, so memory is bounded by a batch); storing is an anti-join and an
append, or a rewrite of what changed.
"""

from __future__ import annotations

import ast
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..engine import frame_operator, sql_operator
from ..plans.dialect import Dialect
from .braces import parse_braces

#: File extensions of the languages that are read.
EXTENSIONS = {
    "cpp": ["cpp", "cc", "cxx", "hpp", "h", "ixx"], "python": ["py", "pyi"], "typescript": ["ts", "tsx"], "javascript": ["js", "jsx", "mjs"],
    "go": ["go"], "rust": ["rs"], "java": ["java"], "csharp": ["cs"],
}
EXCLUDED = ["node_modules", ".git", "build", "dist", "vendor"]


def discover(spark: SparkSession, root: str, languages: list[str] | None = None, max_files: int | None = None) -> DataFrame:
    """Path, language, size, sha256 and text of source files under a folder; max_files keeps the first by path."""
    wanted = [e for lang, es in EXTENSIONS.items() if not languages or lang in languages for e in es]
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{" + ",".join(wanted) + "}").load(root)
    files = files.where(~F.col("path").rlike("/(" + "|".join(map(re.escape, EXCLUDED)) + ")/"))
    files = files.select("path", language_of(F.col("path")).alias("language"), F.col("length").alias("size"), F.sha2("content", 256).alias("hash"), F.decode("content", "UTF-8").alias("text"))
    return files.orderBy("path").limit(max_files) if max_files else files


def language_of(path):
    """Language by extension, null where it is unknown."""
    extension = F.lower(F.regexp_extract(path, r"\.([A-Za-z]+)$", 1))
    pairs = [F.lit(x) for lang, es in EXTENSIONS.items() for e in es for x in (e, lang)]
    return F.element_at(F.create_map(*pairs), extension)


def changed(files: DataFrame, index: DataFrame) -> DataFrame:
    """Files that are new, differ in their hash, or were never parsed."""
    old = index.select("path", F.col("hash").alias("_old"), F.col("last_parsed").alias("_parsed"))
    return files.join(old, "path", "left").where("_old IS NULL OR _old != hash OR _parsed IS NULL").drop("_old", "_parsed")


def insert_ignore(table: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """Table with those rows whose key it does not have; the first of equal new rows."""
    return table.unionByName(rows.dropDuplicates(keys).join(table.select(*keys), keys, "left_anti").select(table.columns))


def upsert(table: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows replace those of equal key."""
    return table.join(rows.select(*keys), keys, "left_anti").select(table.columns).unionByName(rows.dropDuplicates(keys).select(table.columns))


def replace_latest(table: DataFrame, rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Of table and rows, the last by order of each key."""
    both = table.unionByName(rows)
    return both.withColumn("_k", F.row_number().over(W.partitionBy(*keys).orderBy(F.desc(order)))).where("_k = 1").drop("_k")


def delete_project(tables: dict[str, DataFrame], project: int) -> dict[str, DataFrame]:
    """Every table without a project's symbols and what hangs on them."""
    gone = tables["symbols"].where(F.col("project_id") == project).select("id")
    out = {"symbols": tables["symbols"].where(F.col("project_id") != project)}
    for name, ends in (("relationships", ["from_id", "to_id"]), ("calls", ["caller_id", "callee_id"])):
        if name in tables:
            df = tables[name]
            for end in ends:
                df = df.join(gone.withColumnRenamed("id", end), end, "left_anti")
            out[name] = df.select(tables[name].columns)
    return out


@sql_operator
def s02_changed_files(d: Dialect) -> str:
    """Files against an index in which a third has an old hash and a fifth was never seen."""
    return "SELECT f.id, CASE WHEN i.hash IS NULL THEN 'new' ELSE 'changed' END AS state FROM (SELECT id, sha256(text) AS hash FROM sources) f LEFT JOIN (SELECT id, CASE WHEN id % 3 = 0 THEN 'old' ELSE sha256(text) END AS hash FROM sources WHERE id % 5 <> 0) i ON i.id = f.id WHERE i.hash IS NULL OR i.hash <> f.hash".replace("sha256(text)", "sha2(text, 256)" if d.spark else "sha256(text)")


@sql_operator
def s03_language_map(d: Dialect) -> str:
    return "SELECT * FROM (VALUES " + ", ".join(f"('{e}', '{lang}')" for lang, es in EXTENSIONS.items() for e in es) + ") AS v(extension, language)"


@sql_operator
def s04_language_counts(d: Dialect) -> str:
    extension = d.extract("file_path", r"[.]([a-z]+)$")
    return f"SELECT {extension} AS extension, count(DISTINCT file_path) AS files, count(*) AS symbols FROM symbols GROUP BY {extension}"


@sql_operator
def s05_language_profile(d: Dialect) -> str:
    """Confidence 0.3 + 0.6 times the share of lines with a keyword + up to 0.2 for the number of files."""
    line = d.matches("l", r"(function|var|class|import|return)")
    return f"SELECT module, files, round(0.3e0 + 0.6e0 * hits / n + least(files / 10e0, 0.2e0), 6) AS confidence FROM (SELECT module, count(DISTINCT id) AS files, count(*) AS n, CAST(count(*) FILTER (WHERE {line}) AS DOUBLE) AS hits FROM (SELECT id, module, {d.explode(d.split('text', chr(10)))} AS l FROM files) x GROUP BY module) y"


@frame_operator("symbols", lambda d: "SELECT id, name FROM symbols WHERE id % 2 = 0 UNION ALL SELECT n.id, n.name FROM symbols n WHERE NOT EXISTS (SELECT 1 FROM symbols o WHERE o.id = n.id AND o.id % 2 = 0)", stored="id % 2 = 0")
def s06_insert_ignore(t: dict[str, DataFrame], stored: str = "false") -> DataFrame:
    """The store (symbols of a condition) after all symbols were offered to it: those it has stay as they are."""
    rows = t["symbols"].select("id", "name")
    return insert_ignore(rows.where(stored), rows, ["id"])


@sql_operator
def s07_edge_insert_ignore(d: Dialect) -> str:
    return "SELECT from_id, to_id, type, max(confidence) AS confidence FROM relationships GROUP BY from_id, to_id, type"


@frame_operator("projects", lambda d: "SELECT id, name, is_active FROM projects WHERE id > 2 UNION ALL SELECT id, name || ' (renamed)' AS name, true AS is_active FROM projects WHERE id <= 2", renamed="id <= 2")
def s08_dimension_upsert(t: dict[str, DataFrame], renamed: str) -> DataFrame:
    """The projects after those of a condition came in again, renamed and active."""
    table = t["projects"].select("id", "name", "is_active")
    return upsert(table, table.where(renamed).select("id", F.concat("name", F.lit(" (renamed)")).alias("name"), F.lit(True).alias("is_active")), ["id"])


@frame_operator("symbols", lambda d: "SELECT id, project_id FROM symbols WHERE project_id <> 1", project=1)
def s09_clean_project(t: dict[str, DataFrame], project: int) -> DataFrame:
    """The symbols once a project's are gone."""
    return delete_project({"symbols": t["symbols"]}, project)["symbols"].select("id", "project_id")


@frame_operator("symbols relationships", lambda d: "SELECT r.id FROM relationships r WHERE NOT EXISTS (SELECT 1 FROM symbols s WHERE s.id = r.from_id AND s.project_id = 1) AND NOT EXISTS (SELECT 1 FROM symbols s WHERE s.id = r.to_id AND s.project_id = 1)", project=1)
def s10_cascade_delete(t: dict[str, DataFrame], project: int) -> DataFrame:
    """Edges that are left once a project's symbols are gone."""
    return delete_project(t, project)["relationships"].select("id")


@frame_operator("symbols", lambda d: "SELECT file_path, v.language FROM (SELECT DISTINCT file_path, lower(regexp_extract(file_path, '[.]([A-Za-z]+)$', 1)) AS extension FROM symbols) f LEFT JOIN (VALUES " + ", ".join(f"('{e}', '{lang}')" for lang, es in EXTENSIONS.items() for e in es) + ") AS v(extension, language) ON v.extension = f.extension")
def s03_languages_of_files(t: dict[str, DataFrame]) -> DataFrame:
    """The language of each file by its extension, null where it is unknown."""
    return t["symbols"].select("file_path").distinct().select("file_path", language_of(F.col("file_path")).alias("language"))


@sql_operator
def s11_insert_or_replace(d: Dialect) -> str:
    return "SELECT id, label FROM (SELECT id, label, row_number() OVER (PARTITION BY id ORDER BY version DESC) AS k FROM (SELECT id, label, 1 AS version FROM vectors UNION ALL SELECT id, label + 100 AS label, 2 AS version FROM vectors WHERE id % 4 = 0) v) x WHERE k = 1"


@sql_operator
def s12_export_dot(d: Dialect) -> str:
    """Each caller's edges in DOT and Mermaid form; a graph's text is its rows in order."""
    t = "STRING" if d.spark else "VARCHAR"
    c = lambda x: f"CAST({x} AS {t})"
    return f"SELECT caller_id, {d.joined_list(c('caller_id') + ' || ' + repr(' -> ') + ' || ' + c('callee_id'), 'callee_id', '; ')} AS dot, {d.joined_list(c('caller_id') + ' || ' + repr(' --> ') + ' || ' + c('callee_id'), 'callee_id', '; ')} AS mermaid FROM (SELECT DISTINCT caller_id, callee_id FROM calls) c GROUP BY caller_id"


@sql_operator
def s14_service_registry(d: Dialect) -> str:
    """Hosts and ports named in a text."""
    host = d.extract("path", r"://([^/:?#]+)")
    return f"SELECT {host} AS service, count(*) AS paths, min(id) AS first_id FROM sources GROUP BY {host}"


# -- parsing
#: Kind -> pattern with one group for the name, by language family.
RULES = {
    "class": r"^\s*(?:export\s+|public\s+|abstract\s+|template\s*<[^>]*>\s*)*(?:class|struct|interface|enum)\s+([A-Za-z_]\w*)",
    "namespace": r"^\s*(?:export\s+)?(?:namespace|package|module)\s+([\w:.]+)",
    "import": r"^\s*(?:#include\s*[<\"]|import\s+(?:.*\bfrom\s+)?[\"'<]?|using\s+|use\s+)([\w./:]+)",
    "function": r"^\s*(?:export\s+|public\s+|private\s+|protected\s+|static\s+|async\s+|virtual\s+|inline\s+|pub\s+)*(?:function\s+|def\s+|func\s+|fn\s+|[\w:<>*&]+\s+)([A-Za-z_]\w*)\s*\([^;]*$",
    "macro": r"^\s*#define\s+([A-Za-z_]\w*)",
}
_CALL = re.compile(r"\b([A-Za-z_]\w*)\s*\(")
_NOT_CALLS = frozenset("if for while switch catch return sizeof function def class elif except with lambda and or not in new".split())
PARSED = "path string, kind string, name string, line int, parent string, target string"


def parse_python(path: str, text: str) -> list[tuple]:
    """Classes, functions, imports and calls by the language's own grammar."""
    out: list[tuple] = []

    def visit(node: ast.AST, parent: str | None) -> None:
        for child in ast.iter_child_nodes(node):
            name = parent
            if isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                kind = "class" if isinstance(child, ast.ClassDef) else "method" if parent and isinstance(node, ast.ClassDef) else "function"
                name = f"{parent}.{child.name}" if parent else child.name
                out.append((path, kind, child.name, child.lineno, parent, None))
                out.extend((path, "inherits", child.name, child.lineno, parent, b.id) for b in getattr(child, "bases", []) if isinstance(b, ast.Name))
            elif isinstance(child, (ast.Import, ast.ImportFrom)):
                module = getattr(child, "module", None)
                out.extend((path, "import", a.asname or a.name, child.lineno, parent, f"{module}.{a.name}" if module else a.name) for a in child.names)
            elif isinstance(child, ast.Call):
                f = child.func
                target = f.id if isinstance(f, ast.Name) else f.attr if isinstance(f, ast.Attribute) else None
                if target:
                    out.append((path, "call", target, child.lineno, parent, target))
            visit(child, name)

    visit(ast.parse(text), None)
    return out


def parse_lines(path: str, text: str) -> list[tuple]:
    """Symbols and calls line by line, with the enclosing class by depth of braces."""
    out: list[tuple] = []
    rules = [(k, re.compile(p)) for k, p in RULES.items()]
    scopes: list[tuple[str, int]] = []
    depth, current = 0, None
    for number, raw in enumerate(text.split("\n"), 1):
        line = re.sub(r"//.*|\"(?:\\.|[^\"\\])*\"", "", raw) if not raw.lstrip().startswith(("#include", "import")) else raw
        found = next(((k, m[1]) for k, p in rules if (m := p.match(line)) and m[1] not in _NOT_CALLS), None)
        if found:
            kind = "method" if found[0] == "function" and scopes else found[0]
            out.append((path, kind, found[1], number, scopes[-1][0] if scopes else None, None))
            if found[0] in ("class", "namespace"):
                scopes.append((found[1], depth))
            elif found[0] == "function":
                current = found[1]
        elif current:
            out.extend((path, "call", c, number, current, c) for c in _CALL.findall(line) if c not in _NOT_CALLS)
        depth += line.count("{") - line.count("}")
        while scopes and "}" in line and depth <= scopes[-1][1]:
            scopes.pop()
    return out


def parsed(files: DataFrame) -> DataFrame:
    """Symbols, imports, inheritance and calls of files (path, language, text). Python is read by its grammar (by lines, where it does not parse), other languages by their braces."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows: list[tuple] = []
            for path, language, text in zip(b["path"], b["language"], b["text"], strict=True):
                try:
                    rows += parse_python(path, text or "") if language == "python" else parse_braces(path, language, text or "")
                except (SyntaxError, ValueError, RecursionError):
                    rows += parse_lines(path, text or "")
            yield pd.DataFrame(rows, columns=["path", "kind", "name", "line", "parent", "target"])

    return files.select("path", "language", "text").mapInPandas(parse, PARSED)


_DEFINE = re.compile(r"^[ \t]*#define\s+([A-Z_][A-Z0-9_]*)[ \t]*(?:\(([^)]*)\))?[ \t]+((?:.*\\\n)*.*)", re.M)
MACROS = "path string, name string, line int, parameters array<string>, is_variadic boolean, value string, uses int, complexity int, targets array<struct<name:string,type:string,confidence:double>>"


def _macro_targets(name: str, value: str) -> list[tuple]:
    """What code that uses a macro calls and uses through it; a macro named LOG_... reaches its logger."""
    out = []
    chain = re.search(r":*([A-Za-z_:]+)::getInstance\(\)\.(\w+)\(", value) if name.startswith("LOG_") else None
    if chain:
        out += [(chain[1], "uses", 0.95), ("getInstance", "calls", 0.95), (chain[2], "calls", 0.95)]
    return out + [(c, "calls", 0.7) for c in re.findall(r"\b([A-Za-z_]\w*)\s*\(", value) if c != name and c not in ("if", "for", "while", "sizeof")]


def _macro_complexity(value: str) -> int:
    """1 to 5, by calls, loops, conditions and statements of the body."""
    points = 1 + min(len(re.findall(r"\w+\s*\(", value)) * 0.5, 2) + ("do {" in value or "while(" in value) + 0.5 * ("if" in value or "?" in value) + min(value.count(";") * 0.3, 1)
    return min(int(points + 0.5), 5)


def expanded_macros(files: DataFrame) -> DataFrame:
    """Macros of a file (upper-case names) with their bodies over continued lines, how often their names are used in it, and what they lead to."""

    def expand(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for path, text in zip(b["path"], b["text"], strict=True):
                words = Counter(re.findall(r"\w+", text or ""))
                at, line = 0, 1
                for m in _DEFINE.finditer(text or ""):
                    line += text.count("\n", at, m.start())
                    at = m.start()
                    name, listed = m[1], [p.strip() for p in (m[2] or "").split(",") if p.strip()]
                    value = " ".join(x.strip() for x in m[3].split("\\\n")).strip()
                    rows.append((path, name, line, listed, "..." in listed, value, words[name] - 1, _macro_complexity(value), _macro_targets(name, value)))
            yield pd.DataFrame(rows, columns=["path", "name", "line", "parameters", "is_variadic", "value", "uses", "complexity", "targets"])

    return files.select("path", "text").mapInPandas(expand, MACROS)


def macro_edges(calls: DataFrame, macros: DataFrame) -> DataFrame:
    """Edges of code that uses macros (calls: parsed rows) to what those lead to: path, line, caller, target, type, confidence."""
    led = macros.select("name", F.explode("targets").alias("t")).distinct()
    return calls.where("kind = 'call'").join(led, "name").select("path", "line", F.col("parent").alias("caller"), F.col("t.name").alias("target"), "t.type", "t.confidence")


def _spelt(symbols: DataFrame, line) -> DataFrame:
    """path, language and text of each file of the symbol table, its symbols spelt as declarations in order of id."""
    lines = F.transform(F.array_sort(F.collect_list(F.struct("id", line.alias("line")))), lambda x: x["line"])
    return symbols.groupBy(F.col("file_path").alias("path")).agg(F.array_join(lines, "\n").alias("text")).withColumn("language", F.lit("cpp"))


@frame_operator("symbols", lambda d: "SELECT file_path AS path, CASE WHEN kind IN ('class', 'struct') THEN kind ELSE 'function' END AS kind, count(*) AS n FROM symbols GROUP BY 1, 2")
def p25_parse(t: dict[str, DataFrame]) -> DataFrame:
    """The symbol table's declarations, spelt as source text and parsed again."""
    line = F.when(F.col("kind").isin("class", "struct"), F.concat(F.col("kind"), F.lit(" "), F.col("name"), F.lit(" {\n};"))).otherwise(F.concat("signature", F.lit(" {\n}")))
    return parsed(_spelt(t["symbols"], line)).groupBy("path", "kind").agg(F.count("*").alias("n"))


@frame_operator("symbols", lambda d: "SELECT replace(namespace, '#', '') AS parent, count(*) AS n FROM symbols GROUP BY 1")
def p24_scopes(t: dict[str, DataFrame]) -> DataFrame:
    """Declarations inside namespaces: each is a member of the scope it stands in."""
    line = F.concat(F.lit("namespace "), F.replace(F.col("namespace"), F.lit("#"), F.lit("")), F.lit(" {\nvoid f_"), F.col("tag"), F.lit("() {\n}\n}"))
    return parsed(_spelt(t["symbols"], line)).where("kind = 'function'").groupBy("parent").agg(F.count("*").alias("n"))


@frame_operator("symbols", lambda d: "SELECT file_path AS path, count(*) AS macros, CAST(2 * count(*) AS BIGINT) AS uses FROM symbols GROUP BY file_path")
def p26_macros(t: dict[str, DataFrame]) -> DataFrame:
    """A macro for each symbol, used twice."""
    line = F.concat(F.lit("#define "), F.upper("name"), F.lit(" "), F.col("id").cast("string"), F.lit("\nint x = "), F.upper("name"), F.lit(" + "), F.upper("name"), F.lit(";"))
    return expanded_macros(_spelt(t["symbols"], line)).groupBy("path").agg(F.count("*").alias("macros"), F.sum("uses").alias("uses"))


@sql_operator
def p23_line_symbols(d: Dialect) -> str:
    """Names defined in a text's lines by a plain rule, with the line."""
    return f"SELECT id, name, count(*) AS n FROM (SELECT id, {d.extract('l', r'(?:var|class|function) +([A-Za-z_]+)')} AS name FROM (SELECT id, {d.explode(d.split('text', chr(10)))} AS l FROM sources) s) x WHERE name <> '' GROUP BY id, name"
