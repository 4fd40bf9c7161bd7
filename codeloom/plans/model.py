"""The model's tables, and their projection from the test tables.

symbols, relationships, calls (one row for each call site), languages, projects,
arguments (of call sites), blocks and block_edges (control flow), syntax_nodes, flow_paths, insights, files, sources, tags, tag_assignments and
new_assignments are
what operators read. A user passes frames of these shapes; the driver's queries use
the projection below, which is plain SQL for both dialects. calls_returned is the calls
of one program among those that the lines tell of, the one whose lines were returned and
closed: in it some symbols are called by nothing, which questions about dead code ask for.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from .dialect import Dialect, SPARK

BASE = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

_SITES = """lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1"""


def definitions(d: Dialect) -> dict[str, str]:
    """SQL of each model table over the base tables and earlier model tables."""
    text = "CAST({} AS STRING)" if d.spark else "CAST({} AS VARCHAR)"
    s = text.format
    return {
        "languages": """SELECT * FROM (VALUES (1, 'cpp', '.cpp', true), (2, 'python', '.py', true), (3, 'typescript', '.ts', true), (4, 'javascript', '.js', true), (5, 'go', '.go', true), (6, 'rust', '.rs', false), (7, 'java', '.java', true)) AS v(id, name, extension, is_enabled)""",
        "projects": "SELECT CAST(row_number() OVER (ORDER BY name) AS BIGINT) AS id, name, name <> 'MACHINERY' AS is_active FROM (SELECT DISTINCT c_mktsegment AS name FROM customer) c",
        "symbols": f"""
            SELECT p_partkey AS id, p_partkey % 5 + 1 AS project_id, CAST(p_size % 7 + 1 AS BIGINT) AS language_id,
              replace(p_name, ' ', '_') || '_' || {s('p_partkey')} AS name,
              p_brand || '::' || p_type || '::' || replace(p_name, ' ', '_') || '_' || {s('p_partkey')} AS qualified_name,
              p_brand || '::' || p_type AS namespace,
              CASE p_partkey % 5 WHEN 0 THEN 'class' WHEN 1 THEN 'function' WHEN 2 THEN 'method' WHEN 3 THEN 'function' ELSE 'struct' END AS kind,
              'src/' || p_type || '/' || p_brand || CASE WHEN p_size % 2 = 0 THEN '.cpp' ELSE '.ixx' END AS file_path,
              CASE WHEN p_partkey % 5 IN (1, 2, 3) THEN p_partkey - p_partkey % 5 END AS parent_symbol_id,
              CAST(p_size AS BIGINT) AS complexity, CAST(p_size * 2 AS BIGINT) AS cognitive, CAST(p_size * 10 AS BIGINT) AS line, CAST(p_size * 10 + p_size * 6 AS BIGINT) AS end_line,
              CAST(p_partkey % 11 AS BIGINT) AS parameter_count, 0.5e0 + (p_partkey % 50) / 100e0 AS confidence, p_partkey % 2 = 0 AS is_exported,
              CASE p_partkey % 3 WHEN 0 THEN 'public' WHEN 1 THEN 'private' ELSE 'protected' END AS visibility,
              CASE p_size % 4 WHEN 0 THEN 'void' WHEN 1 THEN 'int' WHEN 2 THEN 'Buffer' ELSE 'Result' END AS return_type,
              CASE p_size % 4 WHEN 0 THEN 'void' WHEN 1 THEN 'int' WHEN 2 THEN 'Buffer' ELSE 'Result' END || ' ' || replace(p_name, ' ', '_') || '(' ||
                CASE p_partkey % 4 WHEN 0 THEN '' WHEN 1 THEN 'int count' WHEN 2 THEN 'Buffer data, int count' ELSE 'Result<int> value' END || ')' AS signature,
              split_part(p_name, ' ', 1) AS tag
            FROM part""",
        "calls": f"SELECT a.l_partkey AS caller_id, b.l_partkey AS callee_id, CAST(a.l_linenumber AS BIGINT) AS line_number, a.l_discount > 0.05e0 AS is_conditional, a.l_linestatus AS condition, a.l_partkey = b.l_partkey AS is_recursive FROM {_SITES}",
        "calls_returned": "SELECT c.* FROM (SELECT a.l_partkey AS caller_id, b.l_partkey AS callee_id, CAST(a.l_linenumber AS BIGINT) AS line_number, a.l_discount > 0.05e0 AS is_conditional, a.l_linestatus AS condition, a.l_partkey = b.l_partkey AS is_recursive, a.l_returnflag AS flag FROM " + _SITES + ") c WHERE flag = 'R' AND condition = 'F'",
        "call_lines": "SELECT caller_id, callee_id, line_number * 10 AS line_number FROM calls",  # by the lines of blocks, which are tens
        "relationships": f"""
            SELECT caller_id * 1000003 + callee_id * 3 + CASE type WHEN 'calls' THEN 0 WHEN 'uses' THEN 1 ELSE 2 END AS id, caller_id AS from_id, CASE WHEN (caller_id + callee_id) % 17 = 0 THEN NULL ELSE callee_id END AS to_id, type, confidence, to_name,
              (caller_id + callee_id) % 7 = 0 AS is_cross_language FROM (
              SELECT a.l_partkey AS caller_id, b.l_partkey AS callee_id, CASE WHEN a.l_partkey % 5 = 0 AND b.l_partkey % 5 = 0 THEN 'inherits' WHEN a.l_returnflag = 'R' THEN 'calls' WHEN a.l_returnflag = 'A' THEN 'uses' ELSE 'imports' END AS type, max(1e0 - 5e0 * a.l_discount) AS confidence, max(replace(p.p_name, ' ', '_') || '_' || {s('p.p_partkey')}) AS to_name
              FROM {_SITES} JOIN part p ON p.p_partkey = b.l_partkey GROUP BY a.l_partkey, b.l_partkey, CASE WHEN a.l_partkey % 5 = 0 AND b.l_partkey % 5 = 0 THEN 'inherits' WHEN a.l_returnflag = 'R' THEN 'calls' WHEN a.l_returnflag = 'A' THEN 'uses' ELSE 'imports' END) r""",
        "blocks": f"""
            SELECT event_id AS id, user_id AS symbol_id, CASE event_type WHEN 'view' THEN 'basic' WHEN 'click' THEN 'conditional' WHEN 'purchase' THEN 'loop' WHEN 'signup' THEN 'entry' ELSE 'catch' END AS block_type,
              lag(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS parent_id,
              CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) * 10 AS BIGINT) AS start_line,
              CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) * 10 + event_id % 25 AS BIGINT) AS end_line, CAST(event_id % 6 + 1 AS BIGINT) AS complexity, value AS cost,
              CASE event_type WHEN 'view' THEN 'int v' || {s('event_id % 7')} || ' = read(v' || {s('event_id % 5')} || ')' WHEN 'click' THEN 'if (check(v' || {s('event_id % 7')} || ')) v' || {s('event_id % 5')} || ' += v' || {s('event_id % 3')} WHEN 'purchase' THEN 'for (auto v' || {s('event_id % 7')} || ' = 0; count > v' || {s('event_id % 7')} || '; v' || {s('event_id % 7')} || '++) count = input(data)' WHEN 'signup' THEN 'auto v0 == value' ELSE 'printf(v' || {s('event_id % 7')} || ')' END AS code
            FROM events""",
        # A block goes on to the next one, unless it ends the function (catch); a loop also goes back, and a condition may skip a block.
        "block_edges": """
            SELECT e.symbol_id, from_id, to_id, CASE WHEN step = 'skip' THEN 'false' WHEN t.block_type = 'catch' THEN 'exception' WHEN b.block_type = 'conditional' THEN 'true' ELSE 'next' END AS kind FROM (
              SELECT symbol_id, id AS from_id, lead(id) OVER w AS to_id, 'next' AS step FROM blocks WINDOW w AS (PARTITION BY symbol_id ORDER BY start_line)
              UNION ALL SELECT symbol_id, id AS from_id, lead(id, 2) OVER w AS to_id, 'skip' AS step FROM (SELECT * FROM blocks) s WINDOW w AS (PARTITION BY symbol_id ORDER BY start_line)) e
            JOIN (SELECT id, block_type FROM blocks) b ON b.id = e.from_id JOIN (SELECT id, block_type FROM blocks) t ON t.id = e.to_id WHERE step = 'next' AND b.block_type <> 'catch' OR step = 'skip' AND b.block_type = 'conditional'
            UNION ALL SELECT symbol_id, id AS from_id, parent_id AS to_id, 'loop-back' AS kind FROM blocks WHERE block_type = 'loop' AND parent_id IS NOT NULL""",
        "arguments": f"SELECT a.l_partkey AS caller_id, b.l_partkey AS callee_id, CAST(a.l_linenumber AS BIGINT) AS line_number, CAST(n.position AS BIGINT) AS position, 'v' || {s('CAST(a.l_quantity AS BIGINT) % 7 + n.position')} AS argument FROM {_SITES} JOIN (SELECT * FROM (VALUES (0), (1)) AS v(position)) n ON n.position <= a.l_linenumber % 2",
        # Tags are the kinds of parts: brands below the first digit of their number, that below all brands; types of parts beside them.
        "tags": f"""SELECT CAST(n AS BIGINT) AS id, 'brand-' || {s('n')} AS name, CASE WHEN n >= 10 THEN CAST(floor(n / 10) AS BIGINT) WHEN n > 0 THEN CAST(0 AS BIGINT) END AS parent_id, CASE WHEN n >= 10 THEN 'brand' ELSE 'group' END AS category, n % 3 = 0 AS is_universal, {d.array("'cpp'", "CASE WHEN n % 2 = 0 THEN 'go' ELSE 'java' END")} AS languages, n % 11 <> 5 AS is_active
            FROM (SELECT DISTINCT CAST(replace(p_brand, 'Brand#', '') AS INT) AS n FROM part UNION SELECT DISTINCT CAST(floor(CAST(replace(p_brand, 'Brand#', '') AS INT) / 10) AS INT) AS n FROM part UNION SELECT 0 AS n) b""",
        "tag_assignments": "SELECT p_partkey AS symbol_id, CAST(replace(p_brand, 'Brand#', '') AS BIGINT) AS tag_id, 0.5e0 + (p_partkey % 50) / 100e0 AS confidence, p_partkey % 2 = 0 AS is_automatic, p_type AS source FROM part",
        "new_assignments": f"SELECT l_partkey AS symbol_id, 'brand-' || {s('l_suppkey % 30')} AS name, CAST(l_discount AS DOUBLE) AS confidence, l_returnflag = 'R' AS is_automatic, l_linestatus AS source FROM lineitem",
        "syntax_nodes": "SELECT symbol_id, CASE block_type WHEN 'basic' THEN 'expression_statement' WHEN 'conditional' THEN 'if_statement' WHEN 'loop' THEN 'for_statement' WHEN 'entry' THEN 'function_definition' ELSE 'catch_clause' END AS type, complexity AS depth FROM blocks",
        "flow_paths": f"SELECT caller_id * 1000003 + callee_id AS id, caller_id AS start_id, callee_id AS end_id, {d.array('caller_id', 'callee_id')} AS nodes, CAST(callee_id % 9 AS BIGINT) AS frequency, (caller_id % 5) / 4e0 AS coverage, caller_id = callee_id AS is_cyclic FROM (SELECT DISTINCT caller_id, callee_id FROM calls) c",
        "insights": """
            SELECT d.doc_id AS id, CASE WHEN l.quality = 0 THEN 'quality' WHEN l.toxic = 1 THEN 'security' ELSE 'architecture' END AS category, d.lang AS type,
              CASE d.doc_id % 4 WHEN 0 THEN 'critical' WHEN 1 THEN 'high' WHEN 2 THEN 'medium' ELSE 'low' END AS severity, 0.4e0 + (d.doc_id % 60) / 100e0 AS confidence,
              CASE d.doc_id % 3 WHEN 0 THEN 'active' WHEN 1 THEN 'resolved' ELSE 'dismissed' END AS status, d.doc_id % 200 AS symbol_id
            FROM documents d JOIN labels l ON l.doc_id = d.doc_id""",
        "sources": "SELECT page_id AS id, url AS path, html AS text FROM pages",
        "files": f"SELECT page_id AS id, url AS path, html AS text, 'm' || {s('page_id % 8')} AS module FROM pages",
        # Every twentieth vector measured anew, once a little off and under another label, and once as it was.
        "vectors_near": f"SELECT id, vec, label FROM vectors UNION ALL SELECT id + 1000000 AS id, {d.mapped('vec', 'CAST(x * 1.25e0 + 0.0078125e0 AS FLOAT)')} AS vec, (label + 1) % 10 AS label FROM vectors WHERE id % 20 = 0 UNION ALL SELECT id + 2000000 AS id, vec, label FROM vectors WHERE id % 20 = 0",
        "vectors": "SELECT vec_id AS id, embedding AS vec, CAST(label AS BIGINT) AS label FROM embeddings",
    }


def needed(body: str, defs: dict[str, str], leaves: dict[str, str]) -> list[str]:
    """Model tables that a text reads, dependencies first; leaves read nothing else."""
    out: list[str] = []

    def visit(text: str) -> None:
        for name in (*leaves, *defs):
            if name not in out and re.search(rf"\b{name}\b", text):
                if name not in leaves:
                    visit(defs[name])
                out.append(name)

    visit(body)
    return list(dict.fromkeys(out))


def projected(spark: SparkSession, sf_dir: str, reads: str) -> dict[str, DataFrame]:
    """The frames of the tables that are named: base tables, and model tables over them."""
    base = {t: f"SELECT * FROM parquet.`{sf_dir}/{t}.parquet`" for t in BASE}
    return {t: spark.sql(with_model(SPARK, f"SELECT * FROM {t}", base)) for t in reads.split()}


def with_tables(tables: dict[str, str], body: str) -> str:
    """The text with tables, given by their SQL, as common table expressions before its own."""
    if not tables:
        return body
    ctes = ", ".join(f"{n} AS ({t})" for n, t in tables.items())
    stripped = body.strip()
    if m := re.match(r"WITH( RECURSIVE)?\s", stripped):
        return f"WITH{m[1] or ''} {ctes}, {stripped[m.end():]}"
    return f"WITH {ctes} {stripped}"


def with_model(d: Dialect, body: str, base: dict[str, str] | None = None) -> str:
    """The text with the model tables that it reads (and base tables, if given by their SQL) as common table expressions."""
    defs, base = definitions(d), base or {}
    return with_tables({n: (base | defs)[n] for n in needed(body, defs, base)}, body)
