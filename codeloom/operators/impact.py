"""Change impact, risk and health (I03 to I26). Reachability itself is in graph.py; here are the scores over it."""

from __future__ import annotations

from ..engine import sql_operator
from ..plans import rules
from ..plans.dialect import Dialect
from ..plans.rules import ON_TEST_TABLES, like_any

_USAGE = "(SELECT to_id, count(*) AS n FROM relationships WHERE to_id IS NOT NULL GROUP BY to_id)"
#: Points that a kind of change adds to an impact, and how much longer it takes to mend.
CHANGE_BONUS = {"type": 3, "signature": 2, "removal": 4, "value": 1}
CHANGE_FACTOR = {"type": 1.3, "signature": 1.5, "removal": 2.0, "value": 1.0}


@sql_operator
def i03_usage(d: Dialect) -> str:
    return "SELECT to_id AS id, count(*) AS usage_count FROM relationships WHERE to_id IS NOT NULL GROUP BY to_id"


TAGS = rules.TAG_POINTS


def _by_tag(tags: dict[str, tuple], k: int, rest: str) -> str:
    return "CASE " + " ".join(f"WHEN s.tag = '{t}' THEN {p[k]}e0" for t, p in tags.items()) + f" ELSE {rest} END"


def _scored(tags: dict[str, tuple]) -> str:
    """criticality, complexity, time factor of each symbol; half a point of complexity for each level of its namespace."""
    levels = "CASE WHEN coalesce(s.namespace, '') = '' THEN 0e0 ELSE 0.5e0 * ((length(s.namespace) - length(replace(s.namespace, '::', ''))) / 2e0 + 1e0) END"
    return f"""SELECT s.id, s.kind, s.tag, s.confidence, coalesce(u.n, 0) AS usage_count, {_by_tag(tags, 2, '1e0')} AS time_factor,
        least(10e0, least(0.1e0 * coalesce(u.n, 0), 5e0) + {_by_tag(tags, 0, '0e0')} + CASE WHEN s.file_path LIKE '%.ixx' OR s.file_path LIKE '%include/%' THEN 1e0 ELSE 0e0 END) AS criticality,
        least(10e0, 1e0 + CASE WHEN s.signature LIKE '%<%' THEN 2e0 ELSE 0e0 END + {levels} + {_by_tag(tags, 1, '0e0')}) AS node_complexity
        FROM symbols s LEFT JOIN {_USAGE} u ON u.to_id = s.id"""


@sql_operator(tags=ON_TEST_TABLES["tag_points"])
def i04_criticality(d: Dialect, tags: dict[str, tuple] = TAGS) -> str:
    return f"SELECT id, round(criticality, 6) AS criticality FROM ({_scored(tags)}) x"


@sql_operator(tags=ON_TEST_TABLES["tag_points"])
def i05_node_complexity(d: Dialect, tags: dict[str, tuple] = TAGS) -> str:
    return f"SELECT id, round(node_complexity, 6) AS node_complexity, round(least(1e0, 0.1e0 * usage_count), 6) AS coverage_estimate, round(100e0 - 5e0 * node_complexity - 20e0 * (1e0 - confidence), 6) AS maintainability FROM ({_scored(tags)}) x"


def _severity(change: str, depth: str = "1") -> str:
    return f"greatest(0e0, least(10e0, 10e0 - {depth} + {CHANGE_BONUS[change]} + 0.5e0 * criticality + 0.1e0 * usage_count))"


def _fix_time(change: str, severity: str) -> str:
    return f"floor(15e0 * ({severity} / 10e0 + 0.5e0) * (node_complexity / 5e0) * {CHANGE_FACTOR[change]}e0 * time_factor + 0.5e0)"


@sql_operator(tags=ON_TEST_TABLES["tag_points"])
def i06_severity(d: Dialect, tags: dict[str, tuple] = TAGS) -> str:
    """Severity of each kind of change at distance 1."""
    return " UNION ALL ".join(f"SELECT id, '{c}' AS change, round({_severity(c)}, 6) AS severity FROM ({_scored(tags)}) x" for c in CHANGE_BONUS)


@sql_operator(tags=ON_TEST_TABLES["tag_points"])
def i07_fix_time(d: Dialect, tags: dict[str, tuple] = TAGS) -> str:
    return " UNION ALL ".join(f"SELECT id, '{c}' AS change, {_fix_time(c, _severity(c))} AS minutes FROM ({_scored(tags)}) x" for c in CHANGE_BONUS)


def _direct(tags: dict[str, tuple]) -> str:
    """Direct dependents of every symbol with the severity of a signature change."""
    return f"SELECT r.to_id AS source_id, x.id AS affected_id, x.time_factor, x.node_complexity, {_severity('signature')} AS severity FROM relationships r JOIN ({_scored(tags)}) x ON x.id = r.from_id WHERE r.to_id IS NOT NULL AND r.confidence > 0.7e0"


@sql_operator(tags=ON_TEST_TABLES["tag_points"])
def i08_risk(d: Dialect, tags: dict[str, tuple] = TAGS) -> str:
    """Of a signature change of each symbol: risk, likely breaks, reviewers asked for."""
    return f"""SELECT source_id, high, medium, low, least(10e0, 2e0 * high + medium + 0.5e0 * low) AS risk, high + {d.div('medium', '2')} AS breaking, CASE WHEN high > 3 THEN 'architect' WHEN high > 0 THEN 'senior' ELSE 'peer' END AS reviewer FROM (
        SELECT source_id, count(*) FILTER (WHERE severity >= 9.5e0) AS high, count(*) FILTER (WHERE severity >= 8e0 AND severity < 9.5e0) AS medium, count(*) FILTER (WHERE severity < 8e0) AS low FROM ({_direct(tags)}) a GROUP BY source_id) s"""


_SCENARIOS = "(VALUES ('class', 'type'), ('class', 'removal'), ('struct', 'type'), ('struct', 'removal'), ('function', 'signature'), ('function', 'removal'), ('function', 'value'), ('method', 'signature'), ('method', 'removal')) AS v(kind, change)"


def _scenarios(tags: dict[str, tuple]) -> str:
    cases = lambda f: "CASE change " + " ".join(f"WHEN '{c}' THEN {f(c)}" for c in CHANGE_BONUS) + " END"
    return f"SELECT id, change, {cases(_severity)} AS risk, {cases(lambda c: _fix_time(c, _severity(c)))} AS minutes, node_complexity FROM ({_scored(tags)}) x JOIN {_SCENARIOS} ON v.kind = x.kind"


@sql_operator(tags=ON_TEST_TABLES["tag_points"])
def i09_scenarios(d: Dialect, tags: dict[str, tuple] = TAGS) -> str:
    """Changes that make sense for a symbol of its kind, with risk and time."""
    return f"SELECT id, change, round(risk, 6) AS risk, minutes FROM ({_scenarios(tags)}) s"


@sql_operator(tags=ON_TEST_TABLES["tag_points"])
def i10_scenario_comparison(d: Dialect, tags: dict[str, tuple] = TAGS) -> str:
    """Each pair of a symbol's scenarios: differences and a verdict."""
    return f"""WITH s AS ({_scenarios(tags)}) SELECT a.id, a.change AS first, b.change AS second, round(a.risk - b.risk, 6) AS risk_difference, a.minutes - b.minutes AS minutes_difference,
        CASE WHEN a.risk < b.risk AND a.minutes <= b.minutes THEN a.change WHEN b.risk < a.risk AND b.minutes <= a.minutes THEN b.change ELSE 'trade-off' END AS verdict FROM s a JOIN s b ON b.id = a.id AND a.change < b.change"""


@sql_operator(tags=ON_TEST_TABLES["tag_points"])
def i11_optimal_scenario(d: Dialect, tags: dict[str, tuple] = TAGS) -> str:
    score = "100e0 - 5e0 * risk - 0.1e0 * minutes - 2e0 * node_complexity"
    return f"SELECT id, change, round(score, 6) AS score FROM (SELECT id, change, {score} AS score, row_number() OVER (PARTITION BY id ORDER BY {score} DESC, change) AS k FROM ({_scenarios(tags)}) s) r WHERE k = 1"


@sql_operator(tags=ON_TEST_TABLES["tag_points"])
def i12_timeline(d: Dialect, tags: dict[str, tuple] = TAGS) -> str:
    """Fix times in buckets (to 30, 240, 2400 minutes and beyond) and severity by kind of change."""
    return f"SELECT change, CASE WHEN minutes <= 30 THEN 'immediate' WHEN minutes <= 240 THEN 'short' WHEN minutes <= 2400 THEN 'medium' ELSE 'long' END AS bucket, count(*) AS n, round(avg(risk), 9) AS mean_risk, round(max(risk), 6) AS max_risk FROM ({_scenarios(tags)}) s GROUP BY 1, 2"


@sql_operator(tags=ON_TEST_TABLES["tag_points"])
def i15_enhanced_impact(d: Dialect, tags: dict[str, tuple] = TAGS) -> str:
    fix = _fix_time("signature", "severity")
    return f"SELECT source_id, count(*) AS affected, sum({fix}) AS minutes, count(*) FILTER (WHERE severity >= 7e0) AS critical, round(max(severity), 6) AS worst FROM ({_direct(tags)}) a GROUP BY source_id"


@sql_operator(tags=ON_TEST_TABLES["tag_points"])
def i16_scenario_picks(d: Dialect, tags: dict[str, tuple] = TAGS) -> str:
    """Of each symbol: the scenario of least risk, and the fastest (ties: by name)."""
    return f"SELECT id, {d.least_by('change', d.row('risk', 'change'))} AS lowest_risk, {d.least_by('change', d.row('minutes', 'change'))} AS fastest FROM ({_scenarios(tags)}) s GROUP BY id"


@sql_operator(tags=ON_TEST_TABLES["tag_points"])
def i17_bulk_impact(d: Dialect, tags: dict[str, tuple] = TAGS) -> str:
    """Of all symbols of a file together: severities summed, distinct symbols affected."""
    return f"SELECT s.file_path, round(sum(a.severity), 4) AS severity, count(DISTINCT a.affected_id) AS affected, count(DISTINCT a.source_id) AS changed FROM ({_direct(tags)}) a JOIN symbols s ON s.id = a.source_id GROUP BY s.file_path"


_DEGREES = """SELECT s.id, s.kind, s.name, s.complexity, s.cognitive, s.parameter_count, s.line, s.end_line, s.confidence, s.namespace, s.file_path, s.tag, s.language_id, s.signature, s.is_exported, coalesce(i.n, 0) AS fan_in, coalesce(o.n, 0) AS fan_out FROM symbols s
    LEFT JOIN (SELECT to_id, count(*) AS n FROM relationships WHERE to_id IS NOT NULL GROUP BY to_id) i ON i.to_id = s.id LEFT JOIN (SELECT from_id, count(*) AS n FROM relationships GROUP BY from_id) o ON o.from_id = s.id"""


@sql_operator
def i19_complexity_mix(d: Dialect) -> str:
    return f"SELECT id, round((complexity + cognitive + (fan_in + fan_out) + (fan_in + fan_in)) / 4e0, 6) AS overall FROM ({_DEGREES}) g"


@sql_operator
def i20_impact_metrics(d: Dialect) -> str:
    """Files touched by a change of each file's symbols, build time (3 s a file, test time at least 3 s, half a second a symbol), teams by namespace."""
    return f"""SELECT t.file_path, count(DISTINCT f.file_path) AS files, 3 * count(DISTINCT f.file_path) AS build_seconds, greatest(3e0, 0.5e0 * count(DISTINCT f.id)) AS test_seconds, {d.joined_set("split_part(f.namespace, '::', 1)")} AS teams
        FROM relationships r JOIN symbols f ON f.id = r.from_id JOIN symbols t ON t.id = r.to_id GROUP BY t.file_path"""


@sql_operator
def i21_health(d: Dialect) -> str:
    """Health class and technical debt; how often a symbol changes is not known and counts 0."""
    return f"SELECT id, CASE WHEN complexity > 30 OR fan_in > 30 THEN 'critical' WHEN complexity > 20 THEN 'poor' WHEN complexity > 10 THEN 'fair' ELSE 'good' END AS health, round(0.5e0 * complexity + 0.2e0 * fan_out + 10e0 * (1e0 - confidence), 6) AS debt FROM ({_DEGREES}) g"


@sql_operator
def i22_recommendations(d: Dialect) -> str:
    return """SELECT id, category, CASE category WHEN 'quality' THEN 'refactor' WHEN 'security' THEN 'harden' ELSE 'restructure' END AS action, CASE severity WHEN 'critical' THEN 1 WHEN 'high' THEN 2 WHEN 'medium' THEN 3 ELSE 4 END AS priority,
        CASE severity WHEN 'critical' THEN 'high' WHEN 'high' THEN 'high' WHEN 'medium' THEN 'medium' ELSE 'low' END AS effort FROM insights WHERE status = 'active'"""


@sql_operator
def i23_violations(d: Dialect) -> str:
    return "SELECT symbol_id, count(*) FILTER (WHERE category = 'quality') AS violations, count(*) FILTER (WHERE category = 'security') AS bugs FROM insights GROUP BY symbol_id"


@sql_operator
def i24_insights_of_symbol(d: Dialect, symbol: int = 7) -> str:
    return f"SELECT id, category, severity, confidence FROM insights WHERE symbol_id = {symbol}"


@sql_operator(types={"handle": ["bolt"], "collection": ["ring"], "buffer": ["gear"]})
def i25_data_flow_node(d: Dialect, types: dict[str, list[str]] = {"buffer": ["buffer"], "collection": ["list", "array", "map"], "text": ["name", "text", "string"], "number": ["count", "size", "index"], "flag": ["is", "has"]}) -> str:
    """In and out edges of each symbol, and a value type guessed from its name."""
    kind = "CASE " + " ".join(f"WHEN {like_any('name', w)} THEN '{k}'" for k, w in types.items()) + " ELSE 'unknown' END"
    return f"SELECT id, fan_in, fan_out, {kind} AS data_type FROM ({_DEGREES}) g"


@sql_operator(tags=ON_TEST_TABLES["tag_points"])
def i26_prediction(d: Dialect, tags: dict[str, tuple] = TAGS) -> str:
    return f"SELECT source_id, count(*) AS affected, CASE WHEN max(severity) >= 9.5e0 THEN 'stage the change' WHEN count(*) > 10 THEN 'feature flag' ELSE 'change at once' END AS advice FROM ({_direct(tags)}) a GROUP BY source_id"
