"""Patterns, tags, roles and detectors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..engine import frame_operator, sql_operator
from ..plans import rules
from ..plans.dialect import Dialect
from ..plans.rules import ON_TEST_TABLES, like_any
from .graph import distances
from .impact import _DEGREES


@sql_operator(members=["ring"])
def p01_singletons(d: Dialect, members: list[str] = rules.SINGLETON_MEMBERS) -> str:
    """Classes with a member whose name marks a single instance."""
    return f"SELECT c.id, c.name FROM symbols c WHERE c.kind = 'class' AND EXISTS (SELECT 1 FROM symbols m WHERE m.parent_symbol_id = c.id AND {like_any('m.name', members)})"


@sql_operator(words=["widget"])
def p02_factories(d: Dialect, words: list[str] = rules.FACTORY_NAMES) -> str:
    return f"SELECT id, name FROM symbols WHERE kind IN ('class', 'function', 'method') AND {like_any('name', words)}"


@sql_operator(members=["bolt", "gear"])
def p03_observers(d: Dialect, members: list[str] = rules.OBSERVER_MEMBERS) -> str:
    """Classes with a member whose name marks subscription or notification."""
    return f"SELECT c.id, c.name FROM symbols c WHERE c.kind = 'class' AND EXISTS (SELECT 1 FROM symbols m WHERE m.parent_symbol_id = c.id AND {like_any('m.name', members)})"


@sql_operator
def p04_god_classes(d: Dialect, threshold: int = 1) -> str:
    return f"SELECT c.id, c.name, count(*) AS members FROM symbols c JOIN symbols m ON m.parent_symbol_id = c.id AND m.kind = 'function' WHERE c.kind = 'class' GROUP BY c.id, c.name HAVING count(*) > {threshold}"


@sql_operator(singleton=["ring"], factory=["widget"], observer=["bolt", "gear"])
def p05_detect_patterns(d: Dialect, singleton: list[str] = rules.SINGLETON_MEMBERS, factory: list[str] = rules.FACTORY_NAMES, observer: list[str] = rules.OBSERVER_MEMBERS) -> str:
    """P01 to P04 in one list, each with its fixed confidence."""
    parts = {"singleton": (p01_singletons(d, singleton), 0.8), "factory": (p02_factories(d, factory), 0.7), "observer": (p03_observers(d, observer), 0.75), "god-class": (p04_god_classes(d), 0.9)}
    return " UNION ALL ".join(f"SELECT '{k}' AS pattern, id, CAST({c} AS DOUBLE) AS confidence FROM ({q}) x{k[0]}" for k, (q, c) in parts.items())


def _named(names: list[tuple[str, str]]) -> str:
    return "(VALUES " + ", ".join(f"('{p}', '{w}', {rules.NAMING_WEIGHT[p]}e0)" for p, w in names) + ") AS r(pattern, word, weight)"


@sql_operator(names=ON_TEST_TABLES["pattern_names"])
def p06_weighted_patterns(d: Dialect, threshold: float = 0.3, names: list[tuple[str, str]] = rules.PATTERN_NAMES) -> str:
    """Share of a pattern's name rules that a symbol meets (one is enough for half), times the symbol's confidence; kept from the threshold up."""
    test = "lower(s.name) rlike r.word" if d.spark else "regexp_matches(lower(s.name), r.word)"
    return f"""SELECT id, pattern, round(score, 6) AS score, CASE WHEN score >= 0.7e0 THEN 'strong' WHEN score >= 0.5e0 THEN 'fair' ELSE 'weak' END AS quality FROM (
        SELECT s.id, r.pattern, (0.5e0 + 0.5e0 * count(*) / max(r.rules)) * max(s.confidence) AS score FROM symbols s JOIN (SELECT pattern, word, count(*) OVER (PARTITION BY pattern) AS rules FROM {_named(names)}) r ON {test} GROUP BY s.id, r.pattern) x WHERE score >= {threshold}e0"""


@sql_operator
def p07_rules(d: Dialect, names: list[tuple[str, str]] = rules.PATTERN_NAMES) -> str:
    """The built-in patterns: name rules, and the weight of naming."""
    return f"SELECT pattern, count(*) AS rules, max(weight) AS weight FROM {_named(names)} GROUP BY pattern"


def naming_style(d: Dialect, name: str) -> str:
    return f"CASE WHEN {d.matches(name, '^[a-z]+(_[a-z0-9]+)+$')} THEN 'snake' WHEN {d.matches(name, '^[a-z]+([A-Z][a-z0-9]*)+$')} THEN 'camel' WHEN {d.matches(name, '^[A-Z]')} THEN 'pascal' ELSE 'other' END"


@sql_operator
def p08_naming(d: Dialect) -> str:
    """Naming style of each namespace and its consistency (share of the most frequent style)."""
    return f"SELECT namespace, {d.least_by('style', d.row('-n', 'style'))} AS style, round(CAST(max(n) AS DOUBLE) / sum(n), 6) AS consistency FROM (SELECT namespace, {naming_style(d, 'name')} AS style, count(*) AS n FROM symbols GROUP BY 1, 2) x GROUP BY namespace"


@sql_operator(names=ON_TEST_TABLES["role_names"])
def p09_semantic_roles(d: Dialect, names: dict[str, str] = rules.ROLE_NAMES) -> str:
    """Six scores by kind, text and name, and the largest (ties in the order of the roles); the confidence is held to 0.1..1. The signature stands for a symbol's text."""
    has = lambda c, *words: "(" + " OR ".join(f"{c} LIKE '%{w}%'" for w in words) + ")"
    typed, called = "kind IN ('class', 'struct')", "kind IN ('function', 'method')"
    part = {
        "data": f"CASE WHEN {typed} AND {has('signature', 'private:', 'public:')} THEN 4 WHEN {called} AND {has('name', 'get', 'set')} THEN 5 WHEN kind IN ('enum', 'constant') THEN 3 ELSE 0 END",
        "behavior": f"CASE WHEN {typed} THEN 3 WHEN {called} THEN 4 ELSE 0 END",
        "control": f"CASE WHEN {called} AND {has('name', 'control', 'manage')} THEN 6 ELSE 0 END",
        "interface": f"CASE WHEN {typed} AND {has('signature', 'virtual', 'override')} THEN 6 WHEN kind = 'interface' THEN 8 ELSE 0 END",
        "utility": f"CASE WHEN {called} AND {has('name', 'validate', 'check')} THEN 4 WHEN NOT ({typed} OR {called} OR kind IN ('interface', 'enum', 'constant')) THEN 5 ELSE 0 END",
        "configuration": "CASE WHEN kind IN ('enum', 'constant') THEN 7 ELSE 0 END",
    }
    cols = ", ".join(f"({e} + CASE WHEN {d.matches('lower(name)', names[r])} THEN 1.5e0 ELSE 0e0 END) / 10e0 AS {r}" for r, e in part.items())
    best = f"greatest({', '.join(part)})"
    return f"SELECT id, CASE {' '.join(f'WHEN {r} = {best} THEN {chr(39)}{r}{chr(39)}' for r in part)} END AS role, round(greatest(0.1e0, least(1e0, {best})), 6) AS confidence FROM (SELECT id, {cols} FROM symbols) x"


@sql_operator(creates=["imports"], observes=["inherits"], words=["bolt"])
def p10_usage_patterns(d: Dialect, creates: list[str] = rules.CREATING, uses: list[str] = rules.USING, observes: list[str] = rules.OBSERVING, words: list[str] = rules.TRANSFORMER_NAMES) -> str:
    """Usage patterns of each symbol and how often: what it creates, more than two uses, what notifies it, and names of transformation."""
    kinds = lambda types: ", ".join(f"'{t}'" for t in types)
    return f"""SELECT from_id AS id, 'creator' AS pattern, count(*) AS frequency FROM relationships WHERE type IN ({kinds(creates)}) GROUP BY from_id
        UNION ALL SELECT from_id, 'consumer', count(*) FROM relationships WHERE type IN ({kinds(uses)}) GROUP BY from_id HAVING count(*) > 2
        UNION ALL SELECT to_id, 'observer', count(*) FROM relationships WHERE type IN ({kinds(observes)}) AND to_id IS NOT NULL GROUP BY to_id
        UNION ALL SELECT id, 'transformer', CAST(1 AS BIGINT) FROM symbols WHERE {like_any("name", words)}"""


@sql_operator(paths=[("data", 0.8, [".ixx"])], names=[("presentation", 0.6, ["widget"]), ("business", 0.6, ["gear"])])
def p11_layers(d: Dialect, paths: list[tuple] = rules.LAYER_PATHS, names: list[tuple] = rules.LAYER_NAMES) -> str:
    """Layer by the first rule of the path, then of the name, that fits."""
    ladder = [(like_any("file_path", w), layer, c) for layer, c, w in paths] + [(like_any("name", w), layer, c) for layer, c, w in names]
    case = lambda f, rest: "CASE " + " ".join(f"WHEN {t} THEN {f(layer, c)}" for t, layer, c in ladder) + f" ELSE {rest} END"
    return f"SELECT id, {case(lambda layer, c: repr(layer), repr('unknown'))} AS layer, {case(lambda layer, c: f'{c}e0', '0.1e0')} AS confidence FROM symbols"


def _tags(names: list[tuple]) -> str:
    return "(VALUES " + ", ".join(f"('{t}', '{p}', {c}e0)" for t, p, c in names) + ") AS r(tag, pattern, confidence)"


@sql_operator
def p12_module_roles(d: Dialect) -> str:
    return f"SELECT id, CASE WHEN fan_in > 20 THEN 'core' WHEN fan_in > 5 AND fan_out > 5 THEN 'connector' WHEN fan_in > 5 THEN 'library' WHEN fan_out > 5 THEN 'client' ELSE 'leaf' END AS role FROM ({_DEGREES}) g"


@sql_operator
def p13_component_types(d: Dialect) -> str:
    return "SELECT id, CASE WHEN kind = 'class' AND is_exported THEN 'service' WHEN kind = 'class' THEN 'component' WHEN kind = 'struct' THEN 'model' WHEN is_exported THEN 'api' ELSE 'helper' END AS component FROM symbols"


@sql_operator
def p14_quality_indicators(d: Dialect) -> str:
    """Texts of over 50 lines, with a line of over two connectives, or with over two lines of bare numbers (two digits and more, no comment on the line)."""
    lines = d.split("text", "\n")
    connected = d.size(d.filter_lines("lines", f"{d.count_matches('x', '&&|[|][|]')} > 2"))
    numbers = d.size(d.filter_lines("lines", d.matches("x", r"\b[0-9]{2,}\b") + " AND NOT contains(x, '//')"))
    return f"SELECT id, {d.size('lines')} > 50 AS is_long, {connected} > 0 AS complex_conditions, {numbers} > 2 AS magic_numbers FROM (SELECT id, {lines} AS lines FROM sources) s"


@sql_operator
def p15_algorithms(d: Dialect) -> str:
    """Algorithmic patterns of a text: sums in loops, recursion (the first function of it is named before a parenthesis, its own included), state machines, pipelines."""
    named = r"(?:function\s+([A-Za-z0-9_]+)|([A-Za-z0-9_]+)\s*[=:]\s*(?:function|\(.*\)\s*=>))"
    has = lambda w: f"contains(lower(text), '{w}')"
    return f"""SELECT id, {has('for')} AND ({has('sum')} OR {has('total')} OR {has('+=')}) AS accumulates, own <> '' AND contains(text, concat(own, '(')) AS recursive, {has('switch')} AND {has('state')} AS state_machine,
        {has('pipe')} OR {has('transform')} AND {has('chain')} AS pipeline FROM (SELECT id, text, coalesce(nullif({d.extract('text', named, 1)}, ''), {d.extract('text', named, 2)}) AS own FROM sources) s"""


@sql_operator
def p16_semantic_relationships(d: Dialect, top: int = 10) -> str:
    """Edges by strength of their type and the Jaccard similarity of the ends' name words; ten for each source."""
    a, b = d.split("f.name", "_"), d.split("t.name", "_")
    jac = f"CAST({d.size(d.common('a', 'b'))} AS DOUBLE) / {d.size(d.union('a', 'b'))}"
    return f"SELECT id, from_id, to_id, round(strength, 6) AS strength, round(jaccard, 6) AS jaccard FROM (SELECT *, row_number() OVER (PARTITION BY from_id ORDER BY strength DESC, jaccard DESC, id) AS k FROM (SELECT id, from_id, to_id, CASE type WHEN 'calls' THEN 0.8e0 WHEN 'uses' THEN 0.6e0 ELSE 0.4e0 END * confidence AS strength, {jac} AS jaccard FROM (SELECT r.*, {a} AS a, {b} AS b FROM relationships r JOIN symbols f ON f.id = r.from_id JOIN symbols t ON t.id = r.to_id) e) s) x WHERE k <= {top}"


@sql_operator
def p17_performance(d: Dialect) -> str:
    """How a text seems to run, by words that stand in it (in any case, as parts of words too)."""
    has = lambda *words: "(" + " OR ".join(f"contains(t, '{w}')" for w in words) + ")"
    mode = " ".join(f"WHEN {has(*w)} THEN '{k}'" for k, w in rules.EXECUTION_MODES.items())
    scale = f"CASE WHEN {has('for')} AND NOT {has('nested')} THEN 'linear' WHEN {has('log', 'binary')} THEN 'logarithmic' WHEN {has('nested', 'double')} THEN 'polynomial' ELSE 'unknown' END"
    use = ", ".join(f"CASE WHEN {has(*w)} THEN 'medium' ELSE 'low' END AS {k}" for k, w in rules.RESOURCES.items())
    return f"SELECT id, CASE {mode} ELSE 'balanced' END AS execution_mode, {scale} AS scalability, {use}, {has('parallel', 'thread')} AS parallelizable, NOT {has('random', 'time')} AS cacheable FROM (SELECT id, lower(coalesce(text, '')) AS t FROM sources) s"


@sql_operator
def p18_naming_quality(d: Dialect) -> str:
    return f"SELECT id, length(name) AS name_length, CASE WHEN length(name) < 3 THEN 0.3e0 WHEN length(name) > 30 THEN 0.6e0 WHEN {d.matches('name', '_')} THEN 0.9e0 ELSE 0.7e0 END AS quality FROM symbols"


@sql_operator
def p19_refactoring(d: Dialect) -> str:
    return f"SELECT id, 'extract method' AS opportunity FROM symbols WHERE end_line - line > 200 UNION ALL SELECT id, 'introduce parameter object' AS opportunity FROM symbols WHERE parameter_count > 7 UNION ALL SELECT id, 'reduce coupling' AS opportunity FROM ({_DEGREES}) g WHERE fan_out > 20"


@sql_operator
def p20_tags(d: Dialect) -> str:
    """Tags in use, with the languages they are used in."""
    return f"SELECT s.tag, count(*) AS symbols, count(DISTINCT s.kind) AS kinds, {d.joined_set('l.name')} AS languages FROM symbols s LEFT JOIN languages l ON l.id = s.language_id GROUP BY s.tag"


_CLOSURE = """WITH RECURSIVE up(id, ancestor_id, depth) AS (SELECT id, parent_id, CAST(1 AS BIGINT) FROM tags WHERE parent_id IN (SELECT id FROM tags) UNION ALL SELECT u.id, t.parent_id, u.depth + 1 FROM up u JOIN tags t ON t.id = u.ancestor_id WHERE t.parent_id IN (SELECT id FROM tags) AND u.depth < 50),
    closure AS (SELECT id, ancestor_id, min(depth) AS depth FROM up GROUP BY id, ancestor_id UNION SELECT id, id, CAST(0 AS BIGINT) FROM tags)"""


def tag_closure(tags: DataFrame) -> DataFrame:
    """id, ancestor_id and depth (0: itself) of each tag and all tags above it. On a ring of parents every tag is above every other, each once, and itself at depth 0."""
    known = tags.select(F.col("id").alias("b"))
    up = tags.select(F.col("id").alias("a"), F.col("parent_id").alias("b")).join(known, "b", "left_semi").select("a", "b")
    return distances(up, tags.select(F.col("id").alias("seed"))).select(F.col("seed").alias("id"), F.col("id").alias("ancestor_id"), "depth")


@frame_operator("tags", lambda d: f"{_CLOSURE} SELECT id, ancestor_id, depth FROM closure")
def p20_tag_hierarchy(t: dict[str, DataFrame]) -> DataFrame:
    """The closure of the tags' hierarchy."""
    return tag_closure(t["tags"])


@frame_operator(
    "tags tag_assignments",
    lambda d: f"{_CLOSURE} SELECT symbol_id, name, category, is_own, confidence FROM (SELECT a.symbol_id, c.ancestor_id AS id, max(CASE WHEN c.depth = 0 THEN 1 ELSE 0 END) = 1 AS is_own, max(a.confidence) AS confidence FROM tag_assignments a JOIN closure c ON c.id = a.tag_id GROUP BY a.symbol_id, c.ancestor_id) x JOIN tags t ON t.id = x.id WHERE t.is_active",
)
def p20_symbol_tags(t: dict[str, DataFrame]) -> DataFrame:
    """The active tags of each symbol: assigned ones, and those above them with the largest confidence below."""
    up = tag_closure(t["tags"]).select(F.col("id").alias("tag_id"), F.col("ancestor_id").alias("id"), "depth")
    held = t["tag_assignments"].select("symbol_id", "tag_id", "confidence").join(up, "tag_id").groupBy("symbol_id", "id").agg((F.max((F.col("depth") == 0).cast("int")) == 1).alias("is_own"), F.max("confidence").alias("confidence"))
    return held.join(t["tags"].where("is_active").select("id", "name", "category"), "id").select("symbol_id", "name", "category", "is_own", "confidence")


@sql_operator
def p20_tags_by_category(d: Dialect) -> str:
    """Of each category: active tags, those for all languages, and assignments."""
    return "SELECT t.category, count(DISTINCT t.id) AS tags, count(DISTINCT CASE WHEN t.is_universal THEN t.id END) AS universal, count(a.symbol_id) AS assignments FROM tags t LEFT JOIN tag_assignments a ON a.tag_id = t.id WHERE t.is_active GROUP BY t.category"


@sql_operator(language="cpp")
def p20_tags_for_language(d: Dialect, language: str) -> str:
    """Active tags for all languages, or for this one."""
    return f"SELECT id, name, category FROM tags WHERE is_active AND (is_universal OR {d.has('languages', repr(language))})"


@frame_operator("tags tag_assignments new_assignments", lambda d: """SELECT symbol_id, tag_id, confidence, is_automatic, source FROM (SELECT *, row_number() OVER (PARTITION BY symbol_id, tag_id ORDER BY place DESC, confidence DESC, is_automatic, source) AS k FROM (
    SELECT *, 0 AS place FROM tag_assignments UNION ALL SELECT n.symbol_id, t.id, n.confidence, n.is_automatic, n.source, 1 FROM new_assignments n JOIN tags t ON t.name = n.name AND t.is_active) a) x WHERE k = 1""")
def p20_assign_tags(t: dict[str, DataFrame]) -> DataFrame:
    """The assignments after new ones (symbol_id, name, confidence, is_automatic, source): of a symbol and tag a new one takes the old one's place, of several the surest; names of no active tag are left out."""
    new = t["new_assignments"].join(t["tags"].where("is_active").select(F.col("id").alias("tag_id"), "name"), "name")
    columns = ["symbol_id", "tag_id", "confidence", "is_automatic", "source"]
    both = t["tag_assignments"].select(*columns, F.lit(0).alias("place")).unionAll(new.select(*columns, F.lit(1).alias("place")))
    best = both.groupBy("symbol_id", "tag_id").agg(F.min(F.struct((-F.col("place")).alias("place"), (-F.col("confidence")).alias("low"), "is_automatic", "source", "confidence")).alias("m"))
    return best.select("symbol_id", "tag_id", "m.confidence", "m.is_automatic", "m.source")


@sql_operator(names=ON_TEST_TABLES["tag_names"])
def p21_suggest_tags(d: Dialect, names: list[tuple] = rules.TAG_NAMES) -> str:
    """Tags whose rules a name meets, with the largest confidence of them."""
    test = "s.name rlike r.pattern" if d.spark else "regexp_matches(s.name, r.pattern)"
    return f"SELECT s.id, r.tag, max(r.confidence) AS confidence FROM symbols s JOIN {_tags(names)} ON {test} GROUP BY s.id, r.tag"


@sql_operator(names=ON_TEST_TABLES["tag_names"])
def p22_validate_tags(d: Dialect, names: list[tuple] = rules.TAG_NAMES) -> str:
    """Of each rule: symbols whose name meets it, and those whose name does not."""
    test = "s.name rlike r.pattern" if d.spark else "regexp_matches(s.name, r.pattern)"
    return f"SELECT r.tag, r.pattern, count(*) AS symbols, count(*) FILTER (WHERE {test}) AS valid, count(*) FILTER (WHERE NOT ({test})) AS invalid FROM symbols s CROSS JOIN {_tags(names)} GROUP BY r.tag, r.pattern"


@sql_operator
def p27_control_flow_text(d: Dialect) -> str:
    """Lines of a text that open a block, by its type."""
    kind = f"CASE WHEN {d.matches('l', r'(if|else|switch)[^A-Za-z]')} THEN 'conditional' WHEN {d.matches('l', r'(for|while)[^A-Za-z]')} THEN 'loop' WHEN {d.matches('l', r'try')} THEN 'try' WHEN {d.matches('l', r'catch')} THEN 'catch' END"
    return f"SELECT id, type, count(*) AS n FROM (SELECT id, {kind} AS type FROM (SELECT id, {d.explode(d.split('text', chr(10)))} AS l FROM sources) s) x WHERE type IS NOT NULL GROUP BY id, type"
