"""Catalogue queries over symbols, namespaces, projects, languages and modules."""

from __future__ import annotations

from ..engine import sql_operator
from ..plans.dialect import Dialect


@sql_operator
def a01_stats(d: Dialect) -> str:
    """Symbols, distinct namespaces, kinds and languages in use."""
    return "SELECT count(*) AS symbol_count, count(DISTINCT namespace) FILTER (WHERE namespace <> '') AS namespace_count, count(DISTINCT kind) AS kind_count, count(DISTINCT language_id) AS language_count FROM symbols"


@sql_operator
def a02_kind_breakdown(d: Dialect) -> str:
    return "SELECT kind, count(*) AS n FROM symbols GROUP BY kind ORDER BY n DESC, kind"


@sql_operator
def a03_language_breakdown(d: Dialect) -> str:
    """Symbols by language; a missing language is 'unknown'."""
    return "SELECT coalesce(l.name, 'unknown') AS language, count(*) AS n FROM symbols s LEFT JOIN languages l ON l.id = s.language_id AND l.is_enabled GROUP BY coalesce(l.name, 'unknown') ORDER BY n DESC, language"


@sql_operator
def a04_language_labels(d: Dialect) -> str:
    """Without the language table: 'lang_' and the id."""
    t = "STRING" if d.spark else "VARCHAR"
    return f"SELECT 'lang_' || CAST(language_id AS {t}) AS language, count(*) AS n FROM symbols GROUP BY language_id"


@sql_operator
def a05_search_symbols(d: Dialect, query: str = "red", kind: str = "function", limit: int = 50, offset: int = 5) -> str:
    """Fuzzy search of name or qualified name, a page of it in order of name."""
    return f"SELECT id, name, qualified_name, kind, namespace, file_path FROM symbols WHERE (name ILIKE '%{query}%' OR qualified_name ILIKE '%{query}%') AND kind = '{kind}' ORDER BY name, id LIMIT {limit} OFFSET {offset}"


@sql_operator
def a06_search_exact(d: Dialect, qualified_name: str = "Brand#17::ECONOMY::red_widget_1") -> str:
    return f"SELECT id, name, kind, file_path FROM symbols WHERE qualified_name = '{qualified_name}'"


@sql_operator
def a07_symbol(d: Dialect, symbol: int = 42) -> str:
    return f"SELECT * FROM symbols WHERE id = {symbol}"


@sql_operator
def a08_symbol_relationships(d: Dialect, symbol: int = 42) -> str:
    """Edges in and out of a symbol with both ends and their languages; an end that is missing is ''."""
    side = """SELECT '{dir}' AS direction, r.id, r.type, r.confidence, coalesce(f.name, '') AS from_name, coalesce(fl.name, '') AS from_language, coalesce(t.name, '') AS to_name, coalesce(tl.name, '') AS to_language
        FROM relationships r LEFT JOIN symbols f ON f.id = r.from_id LEFT JOIN languages fl ON fl.id = f.language_id LEFT JOIN symbols t ON t.id = r.to_id LEFT JOIN languages tl ON tl.id = t.language_id WHERE r.{col} = {id}"""
    return side.format(dir="outgoing", col="from_id", id=symbol) + " UNION ALL " + side.format(dir="incoming", col="to_id", id=symbol)


@sql_operator
def a09_namespaces(d: Dialect) -> str:
    return f"SELECT namespace, count(*) AS symbol_count, count(DISTINCT kind) AS kind_count, {d.joined_set('kind')} AS kinds FROM symbols WHERE namespace <> '' GROUP BY namespace"


@sql_operator
def a10_projects(d: Dialect) -> str:
    """Active projects with their symbols."""
    return "SELECT p.id, p.name, count(s.id) AS symbol_count FROM projects p LEFT JOIN symbols s ON s.project_id = p.id WHERE p.is_active GROUP BY p.id, p.name"


@sql_operator
def a11_languages(d: Dialect) -> str:
    return "SELECT l.id, l.name, l.extension, count(s.id) AS symbol_count FROM languages l LEFT JOIN symbols s ON s.language_id = l.id WHERE l.is_enabled GROUP BY l.id, l.name, l.extension"


@sql_operator
def a12_health(d: Dialect) -> str:
    return "SELECT count(*) > 0 AS healthy FROM (SELECT id FROM symbols LIMIT 1) s"


@sql_operator
def a13_edges_of(d: Dialect, symbol: int = 42) -> str:
    return f"SELECT id, from_id, to_id, type, CASE WHEN from_id = {symbol} THEN 'out' ELSE 'in' END AS direction FROM relationships WHERE from_id = {symbol} OR to_id = {symbol}"


@sql_operator
def a14_dependents(d: Dialect, symbol: int = 42) -> str:
    return f"SELECT DISTINCT s.id, s.name, s.qualified_name, r.type FROM relationships r JOIN symbols s ON s.id = r.from_id WHERE r.to_id = {symbol}"


@sql_operator
def a15_comprehensive_stats(d: Dialect) -> str:
    """Totals, mean complexity, and symbols of complexity over 10."""
    return "SELECT count(*) AS total, count(*) FILTER (WHERE kind = 'function') AS functions, count(*) FILTER (WHERE kind = 'class') AS classes, count(*) FILTER (WHERE kind = 'method') AS methods, round(avg(complexity), 9) AS avg_complexity, count(*) FILTER (WHERE complexity > 10) AS complex FROM symbols"


@sql_operator
def a16_top_relationships(d: Dialect, limit: int = 100) -> str:
    """The most certain edges with both ends."""
    return f"""SELECT r.id, r.type, r.confidence, f.name AS from_name, f.kind AS from_kind, f.file_path AS from_file, fl.name AS from_language, t.name AS to_name, t.kind AS to_kind, t.file_path AS to_file, tl.name AS to_language
        FROM (SELECT * FROM relationships ORDER BY confidence DESC, id LIMIT {limit}) r LEFT JOIN symbols f ON f.id = r.from_id LEFT JOIN languages fl ON fl.id = f.language_id LEFT JOIN symbols t ON t.id = r.to_id LEFT JOIN languages tl ON tl.id = t.language_id"""


@sql_operator
def a17_files_of_ids(d: Dialect, ids: tuple = (1, 2, 3, 5, 8, 13, 21, 34, 55, 89)) -> str:
    return f"SELECT DISTINCT file_path, namespace FROM symbols WHERE id IN ({', '.join(map(str, ids))})"


@sql_operator
def a18_import_dependencies(d: Dialect) -> str:
    """Files that each file imports."""
    return "SELECT DISTINCT f.file_path AS from_file, t.file_path AS to_file FROM relationships r JOIN symbols f ON f.id = r.from_id JOIN symbols t ON t.id = r.to_id WHERE r.type IN ('imports', 'includes')"


@sql_operator
def a19_unresolved(d: Dialect) -> str:
    return "SELECT id, from_id, type, to_name FROM relationships WHERE to_id IS NULL"


@sql_operator
def a20_project_inventory(d: Dialect) -> str:
    """By project: functions with a signature, classes and structs, methods, call edges, inheritance edges."""
    return """SELECT s.project_id, count(*) FILTER (WHERE kind IN ('function', 'method') AND signature <> '') AS functions, count(*) FILTER (WHERE kind IN ('class', 'struct')) AS classes,
        count(*) FILTER (WHERE kind = 'method') AS methods, coalesce(max(e.calls), 0) AS call_edges, coalesce(max(e.inherits), 0) AS inheritance_edges
        FROM symbols s LEFT JOIN (SELECT f.project_id, count(*) FILTER (WHERE type = 'calls') AS calls, count(*) FILTER (WHERE type = 'inherits') AS inherits FROM relationships r JOIN symbols f ON f.id = r.from_id GROUP BY f.project_id) e ON e.project_id = s.project_id GROUP BY s.project_id"""


@sql_operator
def a21_module_files(d: Dialect) -> str:
    return f"""SELECT namespace, file_path, CASE WHEN file_path LIKE '%.ixx' THEN 'interface' WHEN file_path LIKE '%.cpp' THEN 'implementation' ELSE 'other' END AS file_type, count(*) AS symbol_count, {d.joined_set('kind')} AS kinds
        FROM symbols GROUP BY namespace, file_path"""


@sql_operator
def a22_module_imports(d: Dialect) -> str:
    return "SELECT f.namespace AS importer, t.namespace AS imported, count(*) AS n FROM relationships r JOIN symbols f ON f.id = r.from_id JOIN symbols t ON t.id = r.to_id WHERE r.type = 'imports' AND f.namespace <> t.namespace GROUP BY f.namespace, t.namespace"


@sql_operator
def a23_top_level_symbols(d: Dialect) -> str:
    return "SELECT id, name, kind, namespace, file_path FROM symbols WHERE parent_symbol_id IS NULL ORDER BY namespace, name, id"


@sql_operator
def a24_module_details(d: Dialect, namespace: str = "Brand#17::ECONOMY", pattern: str = "%.ixx") -> str:
    return f"SELECT id, name, kind, line, end_line FROM symbols WHERE namespace = '{namespace}' AND file_path LIKE '{pattern}' ORDER BY line, id"


@sql_operator
def a25_module_hierarchy(d: Dialect) -> str:
    """Interface and implementation files of a namespace as one module, under each prefix of its namespace."""
    return f"""SELECT prefix, depth, count(DISTINCT module) AS modules, CAST(sum(n) AS BIGINT) AS symbols FROM (
        SELECT {d.replace("file_path", r"\.(ixx|cpp)$", "")} AS module, namespace AS prefix, CAST(2 AS BIGINT) AS depth, count(*) AS n FROM symbols GROUP BY 1, 2
        UNION ALL SELECT {d.replace("file_path", r"\.(ixx|cpp)$", "")} AS module, split_part(namespace, '::', 1) AS prefix, CAST(1 AS BIGINT) AS depth, count(*) AS n FROM symbols GROUP BY 1, 2) m GROUP BY prefix, depth"""


@sql_operator
def a26_namespace_symbols(d: Dialect, namespace: str = "Brand#17::ECONOMY", limit: int = 500) -> str:
    return f"SELECT id, name, kind, file_path FROM symbols WHERE namespace = '{namespace}' ORDER BY name, id LIMIT {min(limit, 500)}"


@sql_operator
def a27_file_symbols(d: Dialect, qualified_name: str = "Brand#17::ECONOMY::red_widget_1", part: str = "red_widget") -> str:
    """All symbols of the files that hold the qualified name; where there are none, symbols that match in part."""
    return f"""WITH exact AS (SELECT s.id, s.name, s.file_path FROM symbols s WHERE s.file_path IN (SELECT file_path FROM symbols WHERE qualified_name = '{qualified_name}'))
        SELECT id, name, file_path FROM exact UNION ALL SELECT id, name, file_path FROM symbols WHERE qualified_name ILIKE '%{part}%' AND NOT EXISTS (SELECT 1 FROM exact)"""


@sql_operator
def a28_search(d: Dialect, query: str = "bolt", project: int = 2) -> str:
    return f"SELECT id, name, kind, project_id FROM symbols WHERE (name ILIKE '%{query}%' OR qualified_name ILIKE '%{query}%') AND project_id = {project} ORDER BY name, id"


@sql_operator
def a29_project_stats(d: Dialect) -> str:
    """Symbols, files, mean confidence and edges of each project."""
    return """SELECT s.project_id, count(*) AS symbols, count(DISTINCT s.file_path) AS files, round(avg(s.confidence), 9) AS confidence, coalesce(max(e.n), 0) AS edges
        FROM symbols s LEFT JOIN (SELECT f.project_id, count(*) AS n FROM relationships r JOIN symbols f ON f.id = r.from_id GROUP BY f.project_id) e ON e.project_id = s.project_id GROUP BY s.project_id"""


@sql_operator
def a30_database_stats(d: Dialect) -> str:
    return "SELECT (SELECT count(*) FROM symbols) AS symbols, (SELECT count(*) FROM relationships) AS relationships, (SELECT count(DISTINCT file_path) FROM symbols) AS files, (SELECT count(*) FROM blocks) AS blocks, (SELECT count(*) FROM calls) AS calls"


@sql_operator
def a31_index_stats(d: Dialect) -> str:
    return "SELECT project_id, language_id, count(*) AS symbols, count(DISTINCT file_path) AS files, max(end_line) AS longest FROM symbols GROUP BY project_id, language_id"


@sql_operator
def a32_orphan_languages(d: Dialect) -> str:
    """Symbols of a language that is not enabled, by language."""
    return "SELECT s.language_id, count(*) AS orphans, min(s.id) AS sample FROM symbols s WHERE NOT EXISTS (SELECT 1 FROM languages l WHERE l.id = s.language_id AND l.is_enabled) GROUP BY s.language_id"


@sql_operator
def a33_language_matrix(d: Dialect) -> str:
    return "SELECT fl.name AS from_language, tl.name AS to_language, count(*) AS n FROM relationships r JOIN symbols f ON f.id = r.from_id JOIN symbols t ON t.id = r.to_id JOIN languages fl ON fl.id = f.language_id JOIN languages tl ON tl.id = t.language_id WHERE fl.id <> tl.id GROUP BY fl.name, tl.name"


@sql_operator
def a34_view_symbols_with_language(d: Dialect) -> str:
    return "SELECT s.id, s.name, s.kind, l.name AS language, p.name AS project FROM symbols s LEFT JOIN languages l ON l.id = s.language_id LEFT JOIN projects p ON p.id = s.project_id"


@sql_operator
def a34_view_relationships_with_names(d: Dialect) -> str:
    return "SELECT r.id, f.qualified_name AS from_name, t.qualified_name AS to_name, r.type, r.confidence FROM relationships r JOIN symbols f ON f.id = r.from_id LEFT JOIN symbols t ON t.id = r.to_id"


@sql_operator
def a35_find_in_namespace(d: Dialect, pattern: str = "Brand#1*::ECO*") -> str:
    """'*' matches anything; matches listed by namespace."""
    return f"SELECT namespace, count(*) AS n, {d.joined_list('name', 'name')} AS names FROM symbols WHERE namespace ILIKE '{pattern.replace('*', '%')}' GROUP BY namespace"


@sql_operator
def a36_resolve_symbol(d: Dialect, part: str = "red_widget", namespace: str = "Brand#17::ECONOMY") -> str:
    """Candidates in order: same namespace, the one around it, global, others."""
    around = namespace.rpartition("::")[0]
    return f"""SELECT id, qualified_name, CAST(CASE WHEN namespace = '{namespace}' THEN 1 WHEN namespace = '{around}' AND '{around}' <> '' THEN 2 WHEN coalesce(namespace, '') = '' THEN 3 ELSE 5 END AS BIGINT) AS priority
        FROM symbols WHERE name LIKE '{part}%' ORDER BY priority, qualified_name, id"""


@sql_operator
def a37_project_registry(d: Dialect) -> str:
    return f"SELECT p.id, p.name, p.is_active, count(s.id) AS symbols, {d.joined_set('l.name')} AS languages, CASE WHEN count(s.id) = 0 THEN 'empty' WHEN p.is_active THEN 'indexed' ELSE 'inactive' END AS status FROM projects p LEFT JOIN symbols s ON s.project_id = p.id LEFT JOIN languages l ON l.id = s.language_id GROUP BY p.id, p.name, p.is_active"
