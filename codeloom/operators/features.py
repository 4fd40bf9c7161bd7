"""Feature vectors of symbols, their reduction and normalisation."""

from __future__ import annotations

from ..engine import sql_operator
from ..plans import rules
from ..plans.dialect import Dialect
from ..plans.rules import ON_TEST_TABLES
from .metrics import DEPTH_CAP, nesting_sql
from .patterns import p09_semantic_roles, p10_usage_patterns, p11_layers

DIMENSIONS = 256
#: What the features of each group count, in their order.
NODE_TYPES = "identifier function_definition compound_statement expression_statement assignment_expression call_expression parameter_list declaration if_statement for_statement while_statement return_statement binary_expression unary_expression field_expression subscript_expression type_identifier primitive_type pointer_declarator array_declarator".split()
KEYWORDS = "if else for while return class function const let var".split()
ROLES = "data behavior control interface utility configuration".split()
USAGE = "creator consumer transformer validator coordinator observer adapter facade".split()
RELATIONS = "calls uses creates inherits implements aggregates imports exports".split()
KINDS = "function method class struct interface enum variable constant namespace module".split()
LAYERS = "presentation business data infrastructure cross-cutting".split()
FEATURES = 80


def _nesting(d: Dialect, texts: str) -> str:
    """id and the greatest depth of braces of each text."""
    if not d.spark:
        return nesting_sql(texts)
    delta = "length(replace(l, '}', '')) - length(replace(l, '{', ''))"
    step = f"(s, l) -> named_struct('depth', greatest(s.depth + {delta}, 0), 'deepest', greatest(s.deepest, s.depth + {delta}))"
    return f"SELECT id, least(aggregate(split(text, '\\\\n'), named_struct('depth', 0, 'deepest', 0), {step}, s -> s.deepest), {DEPTH_CAP}) AS nesting FROM {texts}"


def _texts(d: Dialect, by_id: bool) -> str:
    """id and text of each symbol: its lines of the file, or the whole file where they are no lines of it or blank."""
    if by_id:
        return "SELECT s.id, coalesce(f.text, '') AS text FROM symbols s LEFT JOIN sources f ON f.id = s.id"
    own = d.slice("lines", "line", "greatest(coalesce(end_line, line) - line + 1, 1)")
    joined = f"array_join({own}, '\\n')" if d.spark else f"array_to_string({own}, chr(10))"
    inside = f"line >= 1 AND line <= {d.size('lines')}"
    return f"SELECT id, CASE WHEN {inside} AND {d.matches(joined, '[^ \t\r\n]')} THEN {joined} ELSE text END AS text FROM (SELECT s.id, greatest(s.line, 1) AS line, s.end_line, coalesce(f.text, '') AS text, {d.split(chr(99) + 'oalesce(f.text, ' + chr(39) * 2 + ')', chr(10))} AS lines FROM symbols s LEFT JOIN sources f ON f.path = s.file_path) x"


def _shares(d: Dialect) -> str:
    """Of each text: its length, lines, and what the lexical features count."""
    lines, words = d.split("text", "\n"), d.extract_all("text", r"[^ \t\n\r\f]+", 0)
    listed = ", ".join(f"'{k}'" for k in KEYWORDS)
    return f"""SELECT id, CAST(length(text) AS DOUBLE) AS chars, CAST({d.size('lines')} AS DOUBLE) AS lines, CAST({d.size('words')} AS DOUBLE) AS words, {d.count_matches('text', '[-+*/=<>]')} AS operators,
        {d.size(d.filter_lines('words', f'x IN ({listed})'))} AS keywords, {d.size(d.filter_lines('words', d.matches('x', '^[a-zA-Z_][a-zA-Z0-9_]*$')))} AS identifiers,
        {d.size(d.filter_lines('lines', d.matches('x', r'^[ \t\r\f]*(//|/[*])')))} AS comments, {d.size(d.filter_lines('lines', d.matches('x', r'^[ \t\r\f]*$')))} AS blanks, {d.contains('text', "'/**'")} AS documented
        FROM (SELECT id, text, {lines} AS lines, {words} AS words FROM texts) w"""


@sql_operator(by_id=True, roles=ON_TEST_TABLES["role_names"], usage=dict(creates=["imports"], observes=["inherits"], words=["bolt"]), layers=dict(paths=[("data", 0.8, [".ixx"])], names=[("presentation", 0.6, ["widget"]), ("business", 0.6, ["gear"])]))
def e01_feature_vector(d: Dialect, by_id: bool = False, roles: dict[str, str] = rules.ROLE_NAMES, usage: dict | None = None, layers: dict | None = None) -> str:
    """The 80 features of each symbol as f00 to f79, in twelve groups.

    Syntax node types (20), depth (2), complexity (7), tokens (3), naming (5), comments
    (2), role (6), usage (8), relationships (9), kind (10), layer (5), text (3). A
    function counts with the kinds that are not listed, in the last place, as in
    vectors already stored. Texts are lines of sources (by_id: the source of the same
    id); symbols without text, nodes or edges have zeros there, and one blank line.
    Names and lines are never cut.
    """
    double = "CAST({} AS DOUBLE)".format
    zero = lambda x: f"coalesce({x}, 0e0)"
    per = lambda a, b: f"CASE WHEN {b} > 0e0 THEN {double(a)} / {b} ELSE 0e0 END"
    place = f"CASE s.kind {' '.join(f'WHEN {k!r} THEN {i}' for i, k in enumerate(KINDS) if i)} ELSE {len(KINDS) - 1} END"
    named = "CAST(length(s.name) AS DOUBLE)"
    f = [zero(f"n.n{i}") for i in range(len(NODE_TYPES))] + [zero("n.deepest / 10e0"), zero("n.mean / 10e0")]
    f += [zero(f"{double(x)} / {by}e0") for x, by in (("s.complexity", 20), ("s.cognitive", 30), ("b.nesting", 10), ("s.parameter_count", 15), ("t.lines", 200), ("length(s.signature)", 100), ("length(s.return_type)", 50))]
    f += [per("t.keywords", "t.words"), f"CASE WHEN t.words > 0e0 THEN {double('t.operators')} / t.chars ELSE 0e0 END", per("t.identifiers", "t.words")]
    f += [zero(f"{named} / 20e0"), per(d.count_matches("s.name", "[A-Z]"), named), per(d.count_matches("s.name", "_"), named)]
    f += [f"CASE WHEN {test} THEN 1e0 ELSE 0e0 END" for test in (d.matches("s.name", "^[a-z]"), d.matches("s.name", "^[A-Z]"))]
    f += [per("t.comments", "t.lines"), "CASE WHEN t.documented THEN 1e0 ELSE 0e0 END"]
    f += [f"CASE WHEN r.role = '{x}' THEN r.confidence ELSE 0e0 END" for x in ROLES]
    f += [zero(f"u.u{i}") for i in range(len(USAGE))] + [zero(f"e.e{i}") for i in range(len(RELATIONS) + 1)]
    f += [f"CASE WHEN {place} = {i} THEN 1e0 ELSE 0e0 END" for i in range(len(KINDS))]
    f += [f"CASE WHEN l.layer = '{x}' THEN CAST(l.confidence AS DOUBLE) ELSE 0e0 END" for x in LAYERS]
    f += ["least(1e0, (t.chars - (t.lines - 1e0)) / t.lines / 80e0)", per("t.blanks", "t.lines"), "t.lines / 100e0"]
    assert len(f) == FEATURES
    capped = lambda n, by: f"least(1e0, {double(n)} / {by}e0)"
    return f"""WITH texts AS ({_texts(d, by_id)})
        SELECT s.id, {', '.join(f'{x} AS f{k:02d}' for k, x in enumerate(f))}
        FROM symbols s JOIN ({_shares(d)}) t ON t.id = s.id JOIN ({_nesting(d, 'texts')}) b ON b.id = s.id
        JOIN ({p09_semantic_roles(d, roles)}) r ON r.id = s.id JOIN ({p11_layers(d, **(layers or {}))}) l ON l.id = s.id
        LEFT JOIN (SELECT symbol_id, {', '.join(f"{double(f'count(*) FILTER (WHERE type = {x!r})')} AS n{i}" for i, x in enumerate(NODE_TYPES))}, {double('max(depth)')} AS deepest, {double('sum(depth)')} / count(*) AS mean FROM syntax_nodes GROUP BY symbol_id) n ON n.symbol_id = s.id
        LEFT JOIN (SELECT id, {', '.join(f"max(CASE WHEN pattern = {x!r} THEN {capped('frequency', 10)} ELSE 0e0 END) AS u{i}" for i, x in enumerate(USAGE))} FROM ({p10_usage_patterns(d, **(usage or {}))}) p GROUP BY id) u ON u.id = s.id
        LEFT JOIN (SELECT id, {', '.join(f"{capped(f'count(*) FILTER (WHERE type = {x!r})', 10)} AS e{i}" for i, x in enumerate(RELATIONS))}, {capped('count(*)', 20)} AS e{len(RELATIONS)}
          FROM (SELECT from_id AS id, type FROM relationships UNION ALL SELECT to_id, type FROM relationships WHERE to_id IS NOT NULL AND to_id <> from_id) a GROUP BY id) e ON e.id = s.id"""


def _norm(columns: list[str]) -> str:
    return f"sqrt({' + '.join(f'{c} * {c}' for c in columns)})"


@sql_operator(dimensions=20)
def e02_reduced(d: Dialect, dimensions: int = DIMENSIONS) -> str:
    """Vectors brought to a number of dimensions, r000 and on.

    Shorter ones are padded with zeros and left as they are; longer ones become the
    means of equal runs of elements (zero beyond the last run), at length one.
    """
    run = d.div(f"{d.size('vec')} + {dimensions - 1}", str(dimensions))
    part = lambda k: d.slice("vec", f"CAST({k} * run + 1 AS INT)", "CAST(run AS INT)")
    total = lambda k: f"aggregate(part{k}, 0e0, (a, x) -> a + CAST(x AS DOUBLE))" if d.spark else f"list_sum(CAST(part{k} AS DOUBLE[]))"
    names = [f"r{k:03d}" for k in range(dimensions)]
    parts = f"SELECT id, shrinks, {', '.join(f'{part(k)} AS part{k}' for k in range(dimensions))} FROM (SELECT id, vec, {run} AS run, {d.size('vec')} > {dimensions} AS shrinks FROM vectors) v"
    means = f"SELECT id, shrinks, {', '.join(f'CASE WHEN {d.size(f"part{k}")} > 0 THEN {total(k)} / {d.size(f"part{k}")} ELSE 0e0 END AS {n}' for k, n in enumerate(names))} FROM ({parts}) p"
    return f"SELECT id, {', '.join(f'round(CASE WHEN shrinks AND norm > 0e0 THEN {n} / norm ELSE {n} END, 5) + 0e0 AS {n}' for n in names)} FROM (SELECT *, {_norm(names)} AS norm FROM ({means}) m) x"


@sql_operator(by_id=True, roles=ON_TEST_TABLES["role_names"])
def e03_batch(d: Dialect, **of_features) -> str:
    """Feature vectors (of E01, whose parameters it takes) at length one, v00 to v79; padding to more dimensions adds zeros, and a vector of zeros stays."""
    names = [f"f{k:02d}" for k in range(FEATURES)]
    return f"SELECT id, {', '.join(f'CASE WHEN norm > 0e0 THEN {n} / norm ELSE 0e0 END AS v{n[1:]}' for n in names)} FROM (SELECT *, {_norm(names)} AS norm FROM ({e01_feature_vector(d, **of_features)}) f) x"
