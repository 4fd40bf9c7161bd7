"""Graph analytics of the client side: coverage, statistics, languages, clusters, containment."""

from __future__ import annotations

from ..engine import sql_operator
from ..plans import rules
from ..plans.dialect import Dialect
from ..plans.rules import ON_TEST_TABLES, like_any
from .impact import _DEGREES
from .metrics import m23_anti_patterns

_XL = "SELECT r.id, r.from_id, r.to_id, r.type, r.confidence, f.file_path AS from_file, t.file_path AS to_file, f.namespace AS from_ns, t.namespace AS to_ns, fl.name AS from_language, tl.name AS to_language, f.name AS from_name, t.name AS to_name FROM relationships r JOIN symbols f ON f.id = r.from_id JOIN symbols t ON t.id = r.to_id JOIN languages fl ON fl.id = f.language_id JOIN languages tl ON tl.id = t.language_id"


@sql_operator(calls="calls_returned")
def d05_removal_candidates(d: Dialect, calls: str = "calls") -> str:
    """Uncalled, unexported and small or unsure symbols, with a confidence of removal."""
    return f"SELECT s.id, s.end_line - s.line AS lines, CASE WHEN s.visibility = 'private' THEN 'high' ELSE 'medium' END AS certainty FROM symbols s WHERE NOT s.is_exported AND NOT EXISTS (SELECT 1 FROM {calls} c WHERE c.callee_id = s.id)"


@sql_operator
def d06_branch_coverage(d: Dialect) -> str:
    """Branches keyed by (source, target): covered where a stored path runs over them."""
    return "SELECT b.caller_id, count(*) AS branches, count(p.id) AS covered, CASE WHEN count(p.id) = 0 THEN 'uncovered' WHEN count(p.id) < count(*) THEN 'partial' ELSE 'full' END AS state, CASE WHEN count(p.id) = 0 THEN 0e0 WHEN count(p.id) < count(*) THEN 0.5e0 ELSE 1e0 END AS score FROM (SELECT DISTINCT caller_id, callee_id FROM calls WHERE is_conditional) b LEFT JOIN (SELECT start_id, end_id, min(id) AS id FROM flow_paths WHERE coverage > 0e0 GROUP BY start_id, end_id) p ON p.start_id = b.caller_id AND p.end_id = b.callee_id GROUP BY b.caller_id"


@sql_operator
def d07_suggested_tests(d: Dialect) -> str:
    return "SELECT caller_id, count(*) AS branches, CASE WHEN count(*) > 20 THEN 'very complex' WHEN count(*) > 10 THEN 'complex' WHEN count(*) > 5 THEN 'moderate' ELSE 'simple' END AS complexity, least(count(*), 10) AS suggested_tests FROM (SELECT DISTINCT caller_id, callee_id FROM calls WHERE is_conditional) b GROUP BY caller_id"


@sql_operator
def d11_flow_by_kind(d: Dialect) -> str:
    """Edges, callers and mean branching factor by kind of caller."""
    return "SELECT s.kind, count(*) AS edges, count(DISTINCT c.caller_id) AS callers, round(CAST(count(*) AS DOUBLE) / count(DISTINCT c.caller_id), 6) AS branching, count(*) FILTER (WHERE c.is_conditional) AS conditional, count(*) FILTER (WHERE c.is_recursive) AS recursive FROM calls c JOIN symbols s ON s.id = c.caller_id GROUP BY s.kind"


@sql_operator(before="calls", after="(SELECT * FROM calls WHERE NOT is_conditional)")
def d12_compare_runs(d: Dialect, before: str = "calls_before", after: str = "calls_after") -> str:
    """Out-degrees in two runs' call tables, and the change."""
    degree = "(SELECT caller_id, count(DISTINCT callee_id) AS n FROM {} x GROUP BY caller_id)".format
    return f"SELECT coalesce(a.caller_id, b.caller_id) AS id, coalesce(a.n, 0) AS before, coalesce(b.n, 0) AS after, coalesce(b.n, 0) - coalesce(a.n, 0) AS change FROM {degree(before)} a FULL OUTER JOIN {degree(after)} b ON b.caller_id = a.caller_id"


@sql_operator
def d15_optimisations(d: Dialect) -> str:
    return "SELECT id, CASE WHEN block_type = 'loop' AND complexity >= 5 THEN 'unroll or hoist' WHEN block_type = 'catch' AND cost > 50 THEN 'avoid exceptions' WHEN block_type IN ('condition', 'conditional') AND complexity >= 5 THEN 'simplify condition' END AS advice FROM blocks WHERE block_type = 'loop' AND complexity >= 5 OR block_type = 'catch' AND cost > 50 OR block_type IN ('condition', 'conditional') AND complexity >= 5"


@sql_operator
def d20_graph_filter(d: Dialect, max_degree: int = 30) -> str:
    return f"SELECT r.id, r.from_id, r.to_id, r.type FROM relationships r JOIN ({_DEGREES}) f ON f.id = r.from_id JOIN ({_DEGREES}) t ON t.id = r.to_id WHERE r.type = 'calls' AND f.complexity BETWEEN 5 AND 40 AND f.fan_in + f.fan_out <= {max_degree} AND t.fan_in + t.fan_out <= {max_degree}"


@sql_operator
def d22_graph_nodes(d: Dialect) -> str:
    """Nodes of the edge list, with size by degree and their container."""
    return "SELECT s.id, s.namespace AS container, count(*) AS degree, least(50, 10 + 2 * count(*)) AS size FROM (SELECT from_id AS id FROM relationships UNION ALL SELECT to_id FROM relationships WHERE to_id IS NOT NULL) e JOIN symbols s ON s.id = e.id GROUP BY s.id, s.namespace"


@sql_operator
def d23_language_diversity(d: Dialect) -> str:
    """Of each namespace: Shannon entropy of its languages and the dominant one (ties: smallest id)."""
    return f"SELECT namespace, round(sum(0e0 - p * log2(p)) + 0e0, 6) AS entropy, {d.least_by('language_id', d.row('-p', 'language_id'))} AS dominant FROM (SELECT namespace, language_id, CAST(count(*) AS DOUBLE) / sum(count(*)) OVER (PARTITION BY namespace) AS p FROM symbols GROUP BY namespace, language_id) x GROUP BY namespace"


@sql_operator
def d24_language_boundaries(d: Dialect) -> str:
    return f"SELECT id, CASE WHEN cross_in > 0 AND cross_out > 0 THEN 'bridge' WHEN cross_in > 0 THEN 'entry' ELSE 'exit' END AS role, cross_in, cross_out FROM (SELECT id, count(*) FILTER (WHERE dir = 'in') AS cross_in, count(*) FILTER (WHERE dir = 'out') AS cross_out FROM (SELECT from_id AS id, 'out' AS dir FROM ({_XL}) a WHERE from_language <> to_language UNION ALL SELECT to_id, 'in' FROM ({_XL}) b WHERE from_language <> to_language) e GROUP BY id) x"


@sql_operator
def d25_language_pairs(d: Dialect) -> str:
    return f"SELECT from_language, to_language, count(*) AS n, round(avg(confidence), 9) AS confidence, {d.joined_set('type')} AS types FROM ({_XL}) x WHERE from_language <> to_language GROUP BY from_language, to_language"


@sql_operator
def d26_integration_metrics(d: Dialect) -> str:
    return f"SELECT count(*) AS edges, count(*) FILTER (WHERE from_language <> to_language) AS crossing, round(CAST(count(*) FILTER (WHERE from_language <> to_language) AS DOUBLE) / count(*), 6) AS share, count(DISTINCT from_language) AS languages FROM ({_XL}) x"


@sql_operator
def d28_interconnectivity(d: Dialect) -> str:
    """Of each language: edges inside and outside, cohesion, modularity in percent."""
    return f"SELECT from_language AS language, count(*) FILTER (WHERE from_language = to_language) AS inside, count(*) FILTER (WHERE from_language <> to_language) AS outside, round(100e0 * count(*) FILTER (WHERE from_language = to_language) / count(*), 6) AS modularity FROM ({_XL}) x GROUP BY from_language"


@sql_operator
def d29_related_clusters(d: Dialect, threshold: int = 5) -> str:
    return f"SELECT least(from_ns, to_ns) AS first, greatest(from_ns, to_ns) AS second, count(*) AS links FROM ({_XL}) x WHERE from_ns <> to_ns GROUP BY least(from_ns, to_ns), greatest(from_ns, to_ns) HAVING count(*) >= {threshold}"


@sql_operator
def d30_language_hierarchy(d: Dialect) -> str:
    return "SELECT l.name AS language, split_part(s.namespace, '::', 1) AS brand, split_part(s.namespace, '::', 2) AS type, count(*) AS n FROM symbols s JOIN languages l ON l.id = s.language_id GROUP BY l.name, split_part(s.namespace, '::', 1), split_part(s.namespace, '::', 2)"


@sql_operator
def d33_execution_analysis(d: Dialect) -> str:
    """Coverage by file: functions, those on a covered path, share."""
    return "SELECT s.file_path, count(*) AS functions, count(p.id) AS covered, round(CAST(count(p.id) AS DOUBLE) / count(*), 6) AS share FROM symbols s LEFT JOIN (SELECT DISTINCT start_id AS id FROM flow_paths WHERE coverage > 0e0) p ON p.id = s.id GROUP BY s.file_path"


@sql_operator(names=[("Factory", "widget"), ("Decorator", "bolt"), ("Observer", "red"), ("MVC", "ring|chain"), ("Repository", "small")])
def d34_pattern_categories(d: Dialect, names: list[tuple] = [(n.upper() if n == "mvc" else n.capitalize(), p) for n, p in rules.PATTERN_NAMES]) -> str:
    """The strongest pattern of a symbol and up to three more (ties in the order of the definitions), with strength and role; of the strongest its health, complexity, priority of refactoring and stage.

    Patterns are detected by name; a symbol's own tag is its only tag, and M23 gives
    its anti-patterns. Without a depth of nesting a pattern's complexity takes one.
    """
    defs, text = rules.PATTERN_DEFINITIONS, "lower(concat(g.name, ' ', coalesce(g.signature, ''), ' ', g.kind))"
    hits = lambda words, test: "(" + (" + ".join(f"CASE WHEN {test(w)} THEN 1 ELSE 0 END" for w in words) or "0") + ")"
    said = lambda w: f"contains(text, '{w.lower()}')"
    sign = lambda w: f"(contains(text, '{w}') OR contains(tag, '{w}'))"
    anti = lambda w: d.has("anti_patterns", f"'{w}'")
    of = lambda f: "CASE pattern " + " ".join(f"WHEN '{p}' THEN {f(p, v)}" for p, v in defs.items()) + " END"
    tagged = lambda words: "CASE WHEN " + " OR ".join(f"contains(lower(tag), '{w.lower()}')" for w in words) + " THEN 1 ELSE 0 END"
    role = lambda p, v: "CASE " + " ".join(f"WHEN ({' OR '.join(map(said, w))}){chr(32) + 'AND kind = ' + repr('class') if only else ''} THEN '{r}'" for r, only, w in rules.PATTERN_ROLES[p]) + " ELSE 'consumer' END" if p in rules.PATTERN_ROLES else "'consumer'"
    found = "(VALUES " + ", ".join(f"('{p}', '(?i)({'|'.join(r for q, r in names if q == p)})', {k})" for k, p in enumerate(defs) if any(q == p for q, _ in names)) + ") AS r(pattern, word, place)"
    test = "g.name rlike r.word" if d.spark else "regexp_matches(g.name, r.word)"
    kinds = "array_agg(DISTINCT pattern)" if not d.spark else "collect_set(pattern)"
    none = "CAST([] AS VARCHAR[])" if not d.spark else "CAST(array() AS ARRAY<STRING>)"
    base = f"SELECT g.id, g.kind, g.complexity, coalesce(g.tag, '') AS tag, g.confidence, r.pattern, r.place, {text} AS text, coalesce(m.anti_patterns, {none}) AS anti_patterns FROM ({_DEGREES}) g JOIN {found} ON {test} LEFT JOIN (SELECT id, {kinds} AS anti_patterns FROM ({m23_anti_patterns(d)}) q GROUP BY id) m ON m.id = g.id"
    strength = f"greatest(0e0, least(100e0, {d.half_up('(50 + 15 * indicators + 10 * tags - 20 * antis) * coalesce(confidence, 1e0)')}))"
    scored = f"""SELECT *, {of(lambda p, v: repr(v[0]))} AS family, {of(lambda p, v: hits(v[1], said))} AS indicators, {of(lambda p, v: tagged(v[1]))} AS tags, {of(lambda p, v: hits(v[2], anti))} AS antis, {of(role)} AS role, {of(lambda p, v: hits(v[3], sign))} AS good,
        {of(lambda p, v: hits(v[4], sign))} + CASE WHEN complexity > 10 AND complexity <= 15 THEN 1 ELSE 0 END AS warned, {of(lambda p, v: hits(v[5], anti))} + CASE WHEN complexity > 15 THEN 1 ELSE 0 END AS bad FROM ({base}) b"""
    ranked = f"SELECT *, row_number() OVER (PARTITION BY id ORDER BY strength DESC, place) AS k FROM (SELECT *, {strength} AS strength FROM ({scored}) s) t"
    judged = f"SELECT *, CASE WHEN k = 1 THEN CASE WHEN antis > 0 THEN 'anti-pattern' WHEN bad > 0 THEN 'problematic' WHEN warned > good THEN 'warning' WHEN good > 0 THEN 'healthy' ELSE 'warning' END END AS health FROM ({ranked}) u WHERE k <= 4"
    return f"""SELECT id, CAST(k AS BIGINT) AS k, pattern, family, strength, role, health, CASE WHEN k = 1 THEN least(100, 5 * greatest(coalesce(complexity, 1), 1) + 10) END AS pattern_complexity,
        CASE health WHEN 'healthy' THEN 'none' WHEN 'warning' THEN 'low' WHEN 'problematic' THEN 'medium' WHEN 'anti-pattern' THEN 'critical' END AS refactoring,
        CASE WHEN k > 1 THEN NULL WHEN strength > 0e0 THEN CASE WHEN health = 'healthy' THEN 'mature' ELSE 'stable' END WHEN health = 'anti-pattern' THEN 'legacy' ELSE 'degrading' END AS stage FROM ({judged}) j"""


@sql_operator
def d35_complexity_bands(d: Dialect) -> str:
    """Estimates for each function from its blocks: E - N + 2, volume with 0.7 and 0.6 uniqueness, band."""
    return "SELECT symbol_id, cyclomatic, round(volume, 4) AS volume, CASE WHEN cyclomatic <= 10 THEN 'low' WHEN cyclomatic <= 20 THEN 'moderate' WHEN cyclomatic <= 50 THEN 'high' ELSE 'very high' END AS band FROM (SELECT symbol_id, count(*) FILTER (WHERE block_type IN ('condition', 'conditional', 'loop', 'catch')) + 1 AS cyclomatic, (count(*) * 2) * log2(0.7e0 * count(*) + 0.6e0 * count(*)) AS volume FROM blocks GROUP BY symbol_id) x"


@sql_operator
def d36_call_classes(d: Dialect) -> str:
    return f"SELECT CASE WHEN from_language = to_language THEN 'direct' WHEN type = 'calls' AND from_language IN ('cpp', 'rust') THEN 'ffi' WHEN type = 'uses' THEN 'api' ELSE 'indirect' END AS class, count(*) AS n FROM ({_XL}) x GROUP BY 1"


@sql_operator(formats={"json": ["ring"], "xml": ["brass"], "avro": ["bolt"]}, types=["widget", "small"])
def d37_shared_structures(d: Dialect, formats: dict[str, list[str]] = rules.FORMATS, types: list[str] = rules.SHARED_TYPES, least: int = 3) -> str:
    """Data formats and common type names that symbols are named for, with their languages, and boundaries between languages of more than so many edges."""
    shared = "SELECT '{0}' AS structure, '{1}' AS name, {2} AS languages, count(*) AS uses FROM symbols s JOIN languages l ON l.id = s.language_id WHERE {3} HAVING count(*) > 0".format
    listed = d.joined_set("l.name")
    found = [shared("format", k, listed, f"{like_any('s.name', w)} OR {like_any('s.file_path', w)}") for k, w in formats.items()] + [shared("type", t, listed, d.contains("s.name", f"'{t}'")) for t in types]
    return " UNION ALL ".join(found) + f" UNION ALL SELECT 'boundary' AS structure, concat(from_language, '_', to_language, '_', type) AS name, concat(from_language, ',', to_language) AS languages, count(*) AS uses FROM ({_XL}) x WHERE from_language <> to_language GROUP BY from_language, to_language, type HAVING count(*) > {least}"


@sql_operator(words=["ring", "bolt", "gear", "brass"])
def d38_process_communication(d: Dialect, words: list[str] = rules.COMMUNICATION) -> str:
    """Means of communication that symbols are named for, by name or path. Chains of started processes are D38's other half, in graph.py."""
    named = "(VALUES " + ", ".join(f"('{w}')" for w in words) + ") AS k(word)"
    return f"SELECT k.word, count(*) AS symbols FROM symbols s JOIN {named} ON contains(lower(s.name), k.word) OR contains(lower(coalesce(s.file_path, '')), k.word) GROUP BY k.word"


@sql_operator
def d39_pair_complexity(d: Dialect) -> str:
    return f"SELECT from_language, to_language, 10e0 * count(*) * CASE WHEN 'cpp' IN (from_language, to_language) THEN 1.5e0 ELSE 1e0 END * CASE WHEN 'rust' IN (from_language, to_language) THEN 2e0 ELSE 1e0 END * CASE WHEN 'java' IN (from_language, to_language) THEN 1.3e0 ELSE 1e0 END AS complexity FROM ({_XL}) x WHERE from_language <> to_language GROUP BY from_language, to_language"


@sql_operator
def d40_boundary_groups(d: Dialect) -> str:
    return f"SELECT from_language, to_language, type, count(*) AS n, count(DISTINCT from_file) AS files FROM ({_XL}) x WHERE from_language <> to_language GROUP BY from_language, to_language, type"


@sql_operator
def d42_containment(d: Dialect) -> str:
    """Members of a class: those with it as parent (stored), and symbols whose qualified name is the class's own and one more name (inferred); and whether a member is simple (an accessor by its size)."""
    cut = "substr(qualified_name, 1, length(qualified_name) - length(last) - 2)"
    last = d.last(d.split("qualified_name", "::"))
    simple = "m.end_line - m.line <= 60 AND m.complexity <= 10 AS is_simple"
    owners = f"(SELECT *, {cut} AS owner FROM (SELECT *, {last} AS last FROM symbols WHERE qualified_name LIKE '%::%') x)"
    return f"""SELECT c.id AS class_id, m.id AS member_id, 'stored' AS source, {simple} FROM symbols c JOIN symbols m ON m.parent_symbol_id = c.id WHERE c.kind = 'class'
        UNION ALL SELECT c.id AS class_id, m.id AS member_id, 'inferred' AS source, {simple} FROM symbols c JOIN {owners} m ON m.owner = c.qualified_name WHERE c.kind = 'class' AND (m.parent_symbol_id IS NULL OR m.parent_symbol_id <> c.id)"""
