"""Call-flow questions answered by joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..engine import frame_operator, sql_operator
from ..plans.dialect import Dialect
from ..storage import written


@sql_operator
def g01_call_graph(d: Dialect, symbol: int = 42) -> str:
    """Callers and callees of a function with sites and conditional sites."""
    return f"""SELECT direction, id, name, count(*) AS sites, count(*) FILTER (WHERE is_conditional) AS conditional FROM (
        SELECT 'caller' AS direction, s.id, s.name, c.is_conditional FROM calls c JOIN symbols s ON s.id = c.caller_id WHERE c.callee_id = {symbol}
        UNION ALL SELECT 'callee' AS direction, s.id, s.name, c.is_conditional FROM calls c JOIN symbols s ON s.id = c.callee_id WHERE c.caller_id = {symbol}) e GROUP BY direction, id, name"""


@sql_operator
def g03_branches(d: Dialect) -> str:
    """Conditional calls by caller and condition; coverage from the stored paths, null where there is none."""
    return """SELECT c.caller_id, c.condition, count(*) AS branches, count(DISTINCT c.callee_id) AS targets, round(max(p.coverage), 6) AS coverage FROM calls c
        LEFT JOIN (SELECT start_id, max(coverage) AS coverage FROM flow_paths GROUP BY start_id) p ON p.start_id = c.caller_id WHERE c.is_conditional GROUP BY c.caller_id, c.condition"""


@sql_operator(calls="calls_returned")
def g04_unused_functions(d: Dialect, limit: int = 100, calls: str = "calls") -> str:
    return f"SELECT s.id, s.name, s.file_path, s.line FROM symbols s WHERE s.kind IN ('function', 'method') AND NOT EXISTS (SELECT 1 FROM {calls} c WHERE c.callee_id = s.id) ORDER BY s.file_path, s.line, s.id LIMIT {limit}"


@sql_operator(calls="calls_returned")
def g05_rarely_used(d: Dialect, threshold: int = 1, calls: str = "calls") -> str:
    return f"SELECT s.id, s.name, count(c.caller_id) AS call_count FROM symbols s LEFT JOIN {calls} c ON c.callee_id = s.id WHERE s.kind IN ('function', 'method') GROUP BY s.id, s.name HAVING count(c.caller_id) <= {threshold}"


@sql_operator
def g06_unused_by_kind(d: Dialect, threshold: int = 1) -> str:
    """Unused and rarely used functions by kind; a function without calls is in both lists."""
    return f"""WITH used AS (SELECT callee_id AS used_id, count(*) AS c FROM calls GROUP BY callee_id), counted AS (SELECT s.id, s.kind, coalesce(u.c, 0) AS c FROM symbols s LEFT JOIN used u ON u.used_id = s.id WHERE s.kind IN ('function', 'method'))
        SELECT kind, CAST(sum(CASE WHEN c = 0 THEN 2 WHEN c <= {threshold} THEN 1 ELSE 0 END) AS BIGINT) AS n FROM counted GROUP BY kind"""


@sql_operator
def g07_control_flow(d: Dialect) -> str:
    """Of each function: blocks, edges, conditions, loops, first and last block."""
    return f"SELECT symbol_id, count(*) AS blocks, count(parent_id) AS edges, count(*) FILTER (WHERE block_type IN ('condition', 'conditional')) AS conditions, count(*) FILTER (WHERE block_type = 'loop') AS loops, {d.least_by('id', 'start_line')} AS entry, {d.most_by('id', 'start_line')} AS exit FROM blocks GROUP BY symbol_id"


@sql_operator
def g08_block_complexity(d: Dialect) -> str:
    """Cyclomatic from edges and nodes, cognitive from decisions weighted by how many precede, nesting, and a Halstead estimate."""
    return """SELECT symbol_id, greatest(CAST(1 AS BIGINT), count(parent_id) - count(*) + 2 + count(*) FILTER (WHERE decides = 1)) AS cyclomatic, CAST(sum(decides * (1 + before)) AS BIGINT) AS cognitive, CAST(max(before) AS BIGINT) AS nesting,
        round(count(*) * log2(greatest(count(DISTINCT block_type), 1) + 1), 6) AS volume FROM (
        SELECT symbol_id, parent_id, block_type, decides, sum(decides) OVER (PARTITION BY symbol_id ORDER BY start_line ROWS UNBOUNDED PRECEDING) - decides AS before
        FROM (SELECT *, CASE WHEN block_type IN ('condition', 'conditional', 'loop', 'catch') THEN 1 ELSE 0 END AS decides FROM blocks) x) b GROUP BY symbol_id"""


@sql_operator
def g09_hotspots(d: Dialect, min_calls: int = 10, limit: int = 100) -> str:
    """Most called functions; a bottleneck has over 5 callers and over 50 calls."""
    return f"""SELECT s.id, s.name, s.namespace, count(*) AS call_count, count(DISTINCT c.caller_id) AS unique_callers, count(DISTINCT c.caller_id) > 5 AND count(*) > 50 AS is_bottleneck
        FROM calls c JOIN symbols s ON s.id = c.callee_id GROUP BY s.id, s.name, s.namespace HAVING count(*) >= {min_calls} ORDER BY call_count DESC, s.id LIMIT {limit}"""


@sql_operator
def g10_critical_paths(d: Dialect) -> str:
    return f"SELECT path, count(*) AS n, CAST(sum(frequency) AS BIGINT) AS frequency FROM (SELECT {d.join_ints('nodes')} AS path, frequency FROM flow_paths) p GROUP BY path"


@sql_operator
def g11_flow_metrics(d: Dialect) -> str:
    """Totals over functions and calls; the mean calls both weighted by call and by function."""
    counted = "(SELECT caller_id, count(*) AS n FROM calls GROUP BY caller_id)"
    return f"""SELECT count(DISTINCT s.id) AS functions, count(c.callee_id) AS calls, count(c.callee_id) FILTER (WHERE c.is_conditional) AS conditional, count(c.callee_id) FILTER (WHERE c.is_recursive) AS recursive, count(DISTINCT c.caller_id) AS callers,
        round(avg(q.n), 9) AS mean_weighted_by_call, (SELECT round(avg(n), 6) FROM {counted} k WHERE caller_id IN (SELECT id FROM symbols)) AS mean_by_function FROM symbols s LEFT JOIN calls c ON c.caller_id = s.id
        LEFT JOIN {counted} q ON q.caller_id = s.id"""


@sql_operator
def g12_complexity_distribution(d: Dialect) -> str:
    return "SELECT level, count(*) AS functions FROM (SELECT s.id, CASE WHEN count(c.callee_id) = 0 THEN 'simple' WHEN count(c.callee_id) < 5 THEN 'moderate' WHEN count(c.callee_id) < 10 THEN 'complex' ELSE 'very_complex' END AS level FROM symbols s LEFT JOIN (SELECT DISTINCT caller_id, callee_id FROM calls) c ON c.caller_id = s.id GROUP BY s.id) x GROUP BY level"


@sql_operator
def g13_most_called(d: Dialect, limit: int = 10) -> str:
    return f"SELECT s.id, s.name, count(*) AS call_count FROM calls c JOIN symbols s ON s.id = c.callee_id GROUP BY s.id, s.name ORDER BY call_count DESC, s.id LIMIT {limit}"


@sql_operator
def g14_bottlenecks(d: Dialect, limit: int = 10) -> str:
    return f"SELECT s.id, s.name, count(*) AS outgoing FROM calls c JOIN symbols s ON s.id = c.caller_id GROUP BY s.id, s.name ORDER BY outgoing DESC, s.id LIMIT {limit}"


@sql_operator
def g15_multilanguage_flow(d: Dialect, symbol: int = 42) -> str:
    """Edges around a symbol, with the languages of both ends and whether they differ."""
    return f"SELECT c.caller_id, c.callee_id, fl.name AS from_language, tl.name AS to_language, fl.id <> tl.id AS is_cross_language, count(*) AS sites FROM calls c JOIN symbols f ON f.id = c.caller_id JOIN symbols t ON t.id = c.callee_id JOIN languages fl ON fl.id = f.language_id JOIN languages tl ON tl.id = t.language_id WHERE c.caller_id = {symbol} OR c.callee_id = {symbol} GROUP BY c.caller_id, c.callee_id, fl.name, tl.name, fl.id, tl.id"


@sql_operator
def g16_analyze_function(d: Dialect) -> str:
    """Calls out and in, branches, and a verdict for each function."""
    return """SELECT s.id, s.name, coalesce(o.n, 0) AS outgoing, coalesce(i.n, 0) AS incoming, coalesce(o.conditional, 0) AS branches,
        CASE WHEN coalesce(i.n, 0) = 0 THEN 'never called' WHEN coalesce(o.conditional, 0) > 10 THEN 'many branches' WHEN coalesce(i.n, 0) > 20 THEN 'widely used' ELSE 'ordinary' END AS insight
        FROM symbols s LEFT JOIN (SELECT caller_id, count(*) AS n, count(*) FILTER (WHERE is_conditional) AS conditional FROM calls GROUP BY caller_id) o ON o.caller_id = s.id LEFT JOIN (SELECT callee_id, count(*) AS n FROM calls GROUP BY callee_id) i ON i.callee_id = s.id WHERE s.kind IN ('function', 'method')"""


@sql_operator(calls="calls_returned")
def g17_entry_points(d: Dialect, calls: str = "calls") -> str:
    """Functions that no call edge targets; a null target excludes nothing."""
    return f"SELECT s.id, s.name FROM symbols s WHERE s.kind IN ('function', 'method') AND NOT EXISTS (SELECT 1 FROM {calls} r WHERE r.callee_id = s.id)"


@sql_operator
def g19_called_and_callers(d: Dialect, symbol: int = 42) -> str:
    return f"SELECT DISTINCT CASE WHEN from_id = {symbol} THEN 'calls' ELSE 'called by' END AS role, CASE WHEN from_id = {symbol} THEN to_id ELSE from_id END AS other FROM relationships WHERE type = 'calls' AND to_id IS NOT NULL AND (from_id = {symbol} OR to_id = {symbol})"


@sql_operator
def g20_execution_time(d: Dialect) -> str:
    return "SELECT symbol_id, round(avg(cost), 9) AS mean_cost, max(cost) AS max_cost FROM blocks WHERE block_type = 'entry' GROUP BY symbol_id"


@sql_operator
def g21_path_coverage(d: Dialect) -> str:
    return "SELECT count(DISTINCT id) AS paths, count(DISTINCT id) FILTER (WHERE coverage > 0e0) AS covered, round(avg(coverage), 9) AS mean_coverage FROM flow_paths"


@sql_operator
def g22_uncovered_symbols(d: Dialect, paths: str = "flow_paths") -> str:
    """Symbols that no covered path begins or ends at."""
    return f"SELECT s.id, s.name FROM symbols s WHERE NOT EXISTS (SELECT 1 FROM (SELECT start_id AS id FROM {paths} x WHERE coverage > 0e0 UNION ALL SELECT end_id FROM {paths} y WHERE coverage > 0e0) p WHERE p.id = s.id)"


@sql_operator
def g23_symbol_coverage(d: Dialect) -> str:
    return "SELECT start_id AS symbol_id, round(avg(coverage), 9) AS coverage FROM flow_paths GROUP BY start_id"


@sql_operator
def g24_module_dependencies(d: Dialect) -> str:
    return "SELECT DISTINCT f.file_path AS from_file, t.file_path AS to_file FROM relationships r JOIN symbols f ON f.id = r.from_id JOIN symbols t ON t.id = r.to_id WHERE r.type IN ('uses', 'calls', 'inherits', 'implements') AND f.file_path <> t.file_path"


@sql_operator
def g26_path_interfaces(d: Dialect) -> str:
    """Edges between consecutive nodes of every stored path."""
    at = "posexplode(nodes) AS (pos, node)" if d.spark else "generate_subscripts(nodes, 1) - 1 AS pos, unnest(nodes) AS node"
    return f"""WITH steps AS (SELECT id, {at} FROM flow_paths)
        SELECT a.id, a.node AS from_id, b.node AS to_id, r.type, r.confidence FROM steps a JOIN steps b ON b.id = a.id AND b.pos = a.pos + 1 JOIN relationships r ON r.from_id = a.node AND r.to_id = b.node"""


@sql_operator
def g27_cross_file_usages(d: Dialect) -> str:
    """Of each symbol: uses from other files, by the user's file name."""
    return f"SELECT t.id, {d.last(d.split('f.file_path', '/'))} AS used_by, count(*) AS n FROM relationships r JOIN symbols f ON f.id = r.from_id JOIN symbols t ON t.id = r.to_id WHERE f.file_path <> t.file_path GROUP BY t.id, {d.last(d.split('f.file_path', '/'))}"


@sql_operator
def g28_file_dependencies(d: Dialect, file: str = "src/ECONOMY/Brand#2.ixx") -> str:
    one = "SELECT '{role}' AS role, {other}.file_path AS other_file, count(*) AS n, {types} AS types FROM relationships r JOIN symbols f ON f.id = r.from_id JOIN symbols t ON t.id = r.to_id WHERE {own}.file_path = '{file}' AND {other}.file_path <> '{file}' GROUP BY {other}.file_path"
    types = d.joined_set("r.type")
    return one.format(role="depends on", own="f", other="t", file=file, types=types) + " UNION ALL " + one.format(role="used by", own="t", other="f", file=file, types=types)


def _downstream_sql(d: Dialect) -> str:
    return """SELECT file, count(*) FILTER (WHERE dir = 'out') AS outgoing, count(*) FILTER (WHERE dir = 'in') AS incoming, count(DISTINCT other) AS files, count(DISTINCT sym) AS symbols FROM (
        SELECT 'out' AS dir, f.file_path AS file, t.file_path AS other, t.id AS sym FROM relationships r JOIN symbols f ON f.id = r.from_id JOIN symbols t ON t.id = r.to_id WHERE f.file_path <> t.file_path
        UNION ALL SELECT 'in' AS dir, t.file_path AS file, f.file_path AS other, f.id AS sym FROM relationships r JOIN symbols f ON f.id = r.from_id JOIN symbols t ON t.id = r.to_id WHERE f.file_path <> t.file_path) e GROUP BY file"""


@frame_operator("relationships symbols", _downstream_sql)
def g29_downstream_impact(t: dict[str, DataFrame]) -> DataFrame:
    """Of each file: edges to and from other files, distinct files and symbols touched. Files go by numbers, and pairs of files and symbols of files are counted each by itself, so rows are short and none is repeated for a count."""
    files = written(t["symbols"].select("file_path").where("file_path IS NOT NULL").distinct().withColumn("file", F.monotonically_increasing_id()), "files")
    of = written(t["symbols"].join(files, "file_path").select("id", "file"), "files-of")
    edges = t["relationships"].select("from_id", "to_id").join(of.select(F.col("id").alias("from_id"), F.col("file").alias("f")), "from_id").join(of.select(F.col("id").alias("to_id"), F.col("file").alias("t")), "to_id").where("f <> t")
    edges = written(edges, "edges")
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    out = edges.groupBy("f", "t").agg(F.count("*").alias("n"))
    pairs = out.select(F.col("f").alias("file"), F.col("t").alias("other"), F.col("n").alias("outgoing"), none.alias("incoming")).unionAll(out.select("t", "f", none, "n"))
    sums = pairs.groupBy("file", "other").agg(F.sum("outgoing").alias("outgoing"), F.sum("incoming").alias("incoming")).groupBy("file").agg(F.sum("outgoing").alias("outgoing"), F.sum("incoming").alias("incoming"), F.count("*").alias("files"))
    ends = edges.select(F.col("f").alias("file"), F.col("to_id").alias("sym")).unionAll(edges.select("t", "from_id")).distinct()
    symbols = ends.groupBy("file").agg(F.sum(one).alias("symbols"))
    rows = sums.join(symbols, "file").join(files, "file")
    return rows.select(F.col("file_path").alias("file"), "outgoing", "incoming", "files", "symbols")


@sql_operator
def g30_dependency_matrix(d: Dialect) -> str:
    return "SELECT f.file_path AS from_file, t.file_path AS to_file, r.type, count(*) AS n FROM relationships r JOIN symbols f ON f.id = r.from_id JOIN symbols t ON t.id = r.to_id WHERE f.file_path <> t.file_path GROUP BY f.file_path, t.file_path, r.type"


@sql_operator
def g31_parents_and_children(d: Dialect) -> str:
    return f"SELECT p.id, p.name, count(c.id) AS children, {d.joined_list('c.name', 'c.id')} AS child_names FROM symbols p JOIN symbols c ON c.parent_symbol_id = p.id GROUP BY p.id, p.name"
