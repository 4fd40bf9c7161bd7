"""Code metrics over source text and symbols (M01 to M28). Texts are measured by built-in functions; folds over lines are higher-order functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..engine import frame_operator, sql_operator
from ..plans.dialect import Dialect
from .impact import _DEGREES

#: What counts as a decision, at most CAP_EACH times each and CAP_ALL together; and what else does in a language.
DECISIONS = [r"\bif\s*\(", r"\belse\s+if\s*\(", r"\bwhile\s*\(", r"\bfor\s*\(", r"\bswitch\s*\(", r"\bcase\s", r"\bcatch\s*\(", r"\?\s*[^:]", r"&&", r"\|\|"]
_JS = [r"\btry\s*\{", r"\bawait\s", r"\byield\s"]
LANGUAGE_DECISIONS = {
    "cpp": [r"\btry\s*\{", r"\bco_await\b", r"\bco_yield\b", r"\bco_return\b"], "typescript": _JS, "javascript": _JS,
    "python": [r"\btry\s*:", r"\bexcept\s", r"\bfinally\s*:", r"\bawait\s", r"\byield\s"],
}
CAP_EACH, CAP_ALL = 20, 50
NESTING_CAP, COGNITIVE_CAP, DEPTH_CAP = 15, 150, 25
OPERATORS = "+ - * / % = < > ! & | ^ ~ ? :".split()
KEYWORDS = "if else for while do switch case return break continue class struct public private new delete try catch throw const static void var let function import export".split()


def _head(d: Dialect, text: str, lines: int | None) -> str:
    """A text, or its first lines where their number is bounded."""
    if lines is None:
        return text
    parts = d.slice(d.split(text, "\n"), "1", str(lines))
    return f"array_join({parts}, '\\n')" if d.spark else f"array_to_string({parts}, chr(10))"


@sql_operator(language="javascript")
def m01_cyclomatic(d: Dialect, language: str | None = None, lines: int | None = None) -> str:
    """Decisions in a text (of a language), each kind and all together capped; whole texts, unless lines bounds them. Edges minus nodes plus 2 for block graphs is G08."""
    total = " + ".join(f"least({d.count_matches('head', p)}, {CAP_EACH})" for p in DECISIONS + LANGUAGE_DECISIONS.get(language or "", []))
    return f"SELECT id, least(1 + {total}, {CAP_ALL}) AS cyclomatic FROM (SELECT id, {_head(d, 'text', lines)} AS head FROM sources) h"


def _lines(text: str) -> Column:
    return F.split(F.coalesce(F.col(text), F.lit("")), "\n")


def _brace(line: Column, c: str) -> Column:
    return F.length(line) - F.length(F.replace(line, F.lit(c), F.lit("")))


def cognitive(text: str) -> Column:
    """A fold over lines: control structures weigh 1 and the running depth; stops growing at its cap."""

    def step(s: Column, line: Column) -> Column:
        t = F.trim(line)
        depth = F.least(F.greatest(s["depth"] + _brace(t, "{") - _brace(t, "}"), F.lit(0)), F.lit(NESTING_CAP))
        gain = F.lit(0)
        for pattern, nested in _WEIGHTS:
            gain = gain + F.when(t.rlike(pattern), depth + 1 if nested else F.lit(1)).otherwise(0)
        done = s["score"] > COGNITIVE_CAP
        return F.struct(F.when(done, s["depth"]).otherwise(depth).alias("depth"), F.when(done, s["score"]).otherwise(s["score"] + gain).alias("score"))

    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("score"))
    return F.least(F.aggregate(_lines(text), start, step, lambda s: s["score"]), F.lit(COGNITIVE_CAP)).cast("long")


def nesting(text: str) -> Column:
    """Greatest depth of braces, never below 0 on the way."""

    def step(s: Column, line: Column) -> Column:
        depth = F.greatest(s["depth"] + _brace(line, "{") - _brace(line, "}"), F.lit(0))
        return F.struct(depth.alias("depth"), F.greatest(s["deepest"], depth).alias("deepest"))

    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("deepest"))
    return F.least(F.aggregate(_lines(text), start, step, lambda s: s["deepest"]), F.lit(DEPTH_CAP)).cast("long")


_WEIGHTS = [(r"\b(if|while|for|switch)\s*\(", True), (r"\belse\s+if\s*\(", True), (r"\bcatch\s*\(", True), (r"\b&&\b|\b\|\|\b", False), (r"\?\s*:", True), (r"\b(break|continue)\b", True), (r"\breturn\s+\w+\s*\(", False)]


def _cognitive_sql(d: Dialect) -> str:
    """The oracle: the fold as a recursion over the lines of each text."""
    line = "trim(lines[k + 1])"
    gain = " + ".join(f"CASE WHEN regexp_matches({line}, '{p}') THEN {'now + 1' if nested else '1'} ELSE 0 END" for p, nested in _WEIGHTS)
    now = f"least(greatest(depth + (length({line}) - length(replace({line}, '{{', ''))) - (length({line}) - length(replace({line}, '}}', ''))), 0), {NESTING_CAP})"
    return f"""WITH RECURSIVE l AS (SELECT id, string_split(coalesce(text, ''), chr(10)) AS lines FROM sources),
        walk AS (SELECT id, lines, 0 AS k, CAST(0 AS BIGINT) AS depth, CAST(0 AS BIGINT) AS score FROM l
          UNION ALL SELECT id, lines, k + 1, CASE WHEN score > {COGNITIVE_CAP} THEN depth ELSE now END, CASE WHEN score > {COGNITIVE_CAP} THEN score ELSE score + {gain} END FROM (SELECT *, {now} AS now FROM walk WHERE k < len(lines)) w)
        SELECT id, least(max(score), {COGNITIVE_CAP}) AS cognitive FROM walk GROUP BY id"""


@frame_operator("sources", _cognitive_sql)
def m02_cognitive(t: dict[str, DataFrame]) -> DataFrame:
    return t["sources"].select("id", cognitive("text").alias("cognitive"))


def nesting_sql(texts: str) -> str:
    """The oracle: the fold as a recursion over the lines of each text."""
    delta = "length(replace(lines[k + 1], '}', '')) - length(replace(lines[k + 1], '{', ''))"
    return f"""WITH RECURSIVE l AS (SELECT id, string_split(text, chr(10)) AS lines FROM {texts}),
        walk AS (SELECT id, lines, 0 AS k, CAST(0 AS BIGINT) AS depth, CAST(0 AS BIGINT) AS deepest FROM l
          UNION ALL SELECT id, lines, k + 1, greatest(0, depth + delta), greatest(deepest, greatest(0, depth + delta)) FROM (SELECT *, {delta} AS delta FROM walk WHERE k < len(lines)) w)
        SELECT id, least(max(deepest), {DEPTH_CAP}) AS nesting FROM walk GROUP BY id"""


@frame_operator("sources", lambda d: nesting_sql("sources"))
def m03_nesting(t: dict[str, DataFrame]) -> DataFrame:
    return t["sources"].select("id", nesting("text").alias("nesting"))


_OPENS, _CLOSES, _QUOTES = "(<[", ")>]", "\"'"
_ARROWS = "->|=>|<=|>="  # no brackets


def _inside(signature: Column) -> Column:
    """What stands between the first opening and the last closing parenthesis, without arrows."""
    inside = F.regexp_extract(signature, r"(?s)^[^(]*\((.*)\)[^)]*$", 1)
    return F.regexp_replace(F.coalesce(inside, F.lit("")), _ARROWS, "")


def parameters(signature: Column) -> Column:
    """Parts of a signature's parameter list that hold anything, split at commas outside brackets of all kinds and quoted text; a fold over its characters."""

    def step(s: Column, c: Column) -> Column:
        quoted = s["quote"] != ""
        quote = F.when(quoted, F.when((c == s["quote"]) & (s["last"] != "\\"), "").otherwise(s["quote"])).when(c.isin(*_QUOTES), c).otherwise("")
        depth = F.when(quoted, s["depth"]).otherwise(s["depth"] + F.when(c.isin(*_OPENS), 1).when(c.isin(*_CLOSES), -1).otherwise(0))
        ends = ~quoted & (c == ",") & (s["depth"] == 0)
        held = F.when(ends, False).otherwise(s["held"] | (F.trim(c) != ""))
        return F.struct(depth.alias("depth"), quote.alias("quote"), c.alias("last"), held.alias("held"), (s["n"] + F.when(ends & s["held"], 1).otherwise(0)).alias("n"))

    start = F.struct(F.lit(0).alias("depth"), F.lit("").alias("quote"), F.lit("").alias("last"), F.lit(False).alias("held"), F.lit(0).alias("n"))
    return F.aggregate(F.split(_inside(signature), ""), start, step, lambda s: s["n"] + s["held"].cast("int")).cast("long")


def _parameters_sql(d: Dialect) -> str:
    """The oracle: the fold as a recursion over the characters of each signature."""
    names = lambda cs: ", ".join("'" + c.replace("'", "''") + "'" for c in cs)
    return f"""WITH RECURSIVE l AS (SELECT id, string_split(regexp_replace(coalesce(regexp_extract(signature, '(?s)^[^(]*\\((.*)\\)[^)]*$', 1), ''), '{_ARROWS}', '', 'g'), '') AS cs FROM symbols),
        walk AS (SELECT id, cs, 0 AS k, 0 AS depth, '' AS quote, '' AS last, false AS held, 0 AS n FROM l UNION ALL
          SELECT id, cs, k + 1, CASE WHEN quote <> '' THEN depth ELSE depth + CASE WHEN c IN ({names(_OPENS)}) THEN 1 WHEN c IN ({names(_CLOSES)}) THEN -1 ELSE 0 END END, CASE WHEN quote <> '' THEN CASE WHEN c = quote AND last <> '\\' THEN '' ELSE quote END WHEN c IN ({names(_QUOTES)}) THEN c ELSE '' END, c,
            CASE WHEN ends THEN false ELSE held OR trim(c) <> '' END, n + CASE WHEN ends AND held THEN 1 ELSE 0 END FROM (SELECT *, cs[k + 1] AS c, quote = '' AND cs[k + 1] = ',' AND depth = 0 AS ends FROM walk WHERE k < len(cs)) w)
        SELECT id, CAST(n + CASE WHEN held THEN 1 ELSE 0 END AS BIGINT) AS parameters FROM walk WHERE k = len(cs)"""


@frame_operator("symbols", _parameters_sql)
def m04_parameter_count(t: dict[str, DataFrame]) -> DataFrame:
    """Parameters of each signature."""
    return t["symbols"].select("id", parameters(F.col("signature")).alias("parameters"))


@sql_operator
def m05_line_metrics(d: Dialect) -> str:
    """Lines in all, blank, comment and logical."""
    lines = d.split("text", "\n")
    blank = d.size(d.filter_lines(lines, "trim(x) = ''"))
    comment = d.size(d.filter_lines(lines, "trim(x) LIKE '//%' OR trim(x) LIKE '/*%' OR trim(x) LIKE '*%' OR trim(x) LIKE '#%'"))
    return f"SELECT id, total, blank, comments, total - blank - comments AS logical FROM (SELECT id, {d.size(lines)} AS total, {blank} AS blank, {comment} AS comments FROM sources) l"


@sql_operator
def m06_branches(d: Dialect) -> str:
    total = " + ".join(d.count_matches("text", p) for p in (r"\bif\b", r"\bcase\b", r"\bcatch\b", r"\?"))
    return f"SELECT id, {total} AS branches FROM sources"


#: Strings, which stay, or comments (in stars, after two slashes or a hash), which go.
_STRINGS_OR_COMMENTS = r'("[^"\\\n]*(?:\\.[^"\\\n]*)*"|\x27[^\x27\\\n]*(?:\\.[^\x27\\\n]*)*\x27)|/\*[\s\S]*?\*/|//[^\n]*|#[^\n]*'


def without_comments(d: Dialect, text: str) -> str:
    """A text without its comments; what looks like one inside a string stays."""
    return d.replace(text, _STRINGS_OR_COMMENTS, "$1 " if d.spark else r"\1 ")


def _tokens(d: Dialect) -> str:
    return d.extract_all(without_comments(d, "text"), r"[A-Za-z0-9_]+|[^A-Za-z0-9_\s]", 0)


@sql_operator
def m07_tokens(d: Dialect) -> str:
    """Tokens of a text without comments."""
    return f"SELECT id, {d.size('t')} AS tokens, {d.size(d.distinct('t'))} AS distinct_tokens FROM (SELECT id, {_tokens(d)} AS t FROM sources) s"


def _halstead(d: Dialect) -> str:
    names = ", ".join(f"'{x}'" for x in OPERATORS + KEYWORDS)
    return f"""SELECT id, count(*) FILTER (WHERE op) AS operators, count(*) FILTER (WHERE NOT op) AS operands, count(DISTINCT CASE WHEN op THEN token END) AS distinct_operators, count(DISTINCT CASE WHEN NOT op THEN token END) AS distinct_operands
        FROM (SELECT id, token, token IN ({names}) AS op FROM (SELECT id, {d.explode(_tokens(d))} AS token FROM sources) t WHERE token IN ({names}) OR {d.matches('token', '^[A-Za-z_][A-Za-z0-9_]*$')} OR {d.matches('token', '^[0-9]')}) k GROUP BY id"""


@sql_operator
def m08_halstead(d: Dialect) -> str:
    return f"""SELECT id, operators, operands, vocabulary, round(volume, 4) AS volume, round(difficulty, 6) AS difficulty, round(volume * difficulty, 2) AS effort, round(volume * difficulty / 18e0, 3) AS seconds, round(volume / 3000e0, 6) AS bugs FROM (
        SELECT id, operators, operands, distinct_operators + distinct_operands AS vocabulary, CASE WHEN distinct_operators + distinct_operands > 0 THEN (operators + operands) * log2(distinct_operators + distinct_operands) ELSE 0e0 END AS volume,
          CASE WHEN distinct_operands > 0 THEN distinct_operators / 2e0 * (CAST(operands AS DOUBLE) / distinct_operands) ELSE 0e0 END AS difficulty FROM ({_halstead(d)}) h) v"""


@sql_operator
def m09_language_tokens(d: Dialect) -> str:
    """The operator and keyword sets, with how often each stands in the texts and in how many."""
    sets = "(VALUES " + ", ".join(f"('{x}', '{k}')" for k, xs in (("operator", OPERATORS), ("keyword", KEYWORDS)) for x in xs) + ") AS v(token, kind)"
    return f"SELECT v.token, v.kind, coalesce(n.n, 0) AS n, coalesce(n.texts, 0) AS texts FROM (SELECT * FROM {sets}) v LEFT JOIN (SELECT token, count(*) AS n, count(DISTINCT id) AS texts FROM (SELECT id, {d.explode(_tokens(d))} AS token FROM sources) s GROUP BY token) n ON n.token = v.token"


@sql_operator(language="javascript")
def m10_maintainability(d: Dialect, language: str | None = None) -> str:
    """The maintainability index of a text from its volume, decisions, logical lines and their ratio of comment lines, held to 0..100."""
    return f"""SELECT id, round(greatest(0e0, least(100e0, 171e0 - 5.2e0 * ln(greatest(1e0, volume)) - 0.23e0 * cyclomatic - 16.2e0 * ln(CAST(greatest(1, logical) AS DOUBLE)) + 50e0 * sin(sqrt(2.4e0 * CASE WHEN logical > 0 THEN CAST(comments AS DOUBLE) / logical ELSE 0e0 END)))), 6) AS maintainability FROM (
        SELECT c.id, c.cyclomatic, l.logical, l.comments, coalesce(h.volume, 0e0) AS volume FROM ({m01_cyclomatic(d, language)}) c JOIN ({m05_line_metrics(d)}) l ON l.id = c.id LEFT JOIN ({m08_halstead(d)}) h ON h.id = c.id) x"""


_RISK = """(CASE WHEN complexity > 20 THEN 3 WHEN complexity > 10 THEN 2 WHEN complexity > 5 THEN 1 ELSE 0 END + CASE WHEN cognitive > 25 THEN 3 WHEN cognitive > 15 THEN 2 ELSE 0 END
    + CASE WHEN parameter_count > 7 THEN 2 WHEN parameter_count > 5 THEN 1 ELSE 0 END + CASE WHEN end_line - line > 200 THEN 2 WHEN end_line - line > 100 THEN 1 ELSE 0 END)"""


@sql_operator
def m11_risk_level(d: Dialect) -> str:
    return f"SELECT id, CAST(points AS BIGINT) AS points, CASE WHEN points >= 8 THEN 'critical' WHEN points >= 5 THEN 'high' WHEN points >= 2 THEN 'medium' ELSE 'low' END AS risk FROM (SELECT id, {_RISK} AS points FROM symbols) x"


@sql_operator
def m12_hints(d: Dialect) -> str:
    """Hints of cost, and whether the first function that a text defines is called in it again."""
    first = d.extract("text", r"function\s+([A-Za-z0-9_]+)|([A-Za-z0-9_]+)\s*[=:]\s*function|([A-Za-z0-9_]+)\s*[=:]\s*\([^\n]*\)\s*=>")
    second, third = first.replace(", 1)", ", 2)"), first.replace(", 1)", ", 3)")
    pattern = r"concat('\\b', f, '\\s*\\(')" if d.spark else r"concat('\b', f, '\s*\(')"
    again = f"regexp_count(text, {pattern})" if d.spark else f"len(regexp_extract_all(text, {pattern}))"
    hints = f"{d.matches('text', r'for[^;]*for')} AS nested_loops, {d.matches('text', r'new\s+[A-Z]')} AS allocates, {d.matches('text', 'await')} AS waits, length(text) > 20000 AS is_long"
    return f"SELECT id, {hints}, f <> '' AND {again} > 1 AS is_recursive FROM (SELECT id, text, concat({first}, {second}, {third}) AS f FROM sources) s"


@sql_operator
def m13_additional(d: Dialect) -> str:
    return f"SELECT id, {d.count_matches('text', r'(var|let|const|int|auto)\s+[a-z]')} AS locals, {d.count_matches('text', 'return')} AS returns FROM sources"


@sql_operator
def m14_architecture(d: Dialect) -> str:
    """Of each namespace: anti-patterns, mean maintainability, health."""
    return f"""SELECT namespace, count(*) AS symbols, count(*) FILTER (WHERE complexity > 15 AND fan_out > 10) AS anti_patterns, round(avg(100e0 - complexity - 0.5e0 * fan_out), 9) AS maintainability,
        CASE WHEN avg(complexity) > 30 THEN 'high' WHEN avg(complexity) > 20 THEN 'medium' ELSE 'low' END AS risk, count(*) FILTER (WHERE complexity <= 10) AS healthy FROM ({_DEGREES}) g GROUP BY namespace"""


@sql_operator(language="javascript")
def m15_quality(d: Dialect, test_coverage: float = 70.0, language: str | None = None) -> str:
    """One row for the project: confidence, coverage by symbols of a file, health, mean maintainability and debt; a fixed test coverage unless it is known."""
    whole = d.half_up
    return f"""SELECT confidence, coverage, {test_coverage}e0 AS test_coverage, code_health, round(maintainability, 6) AS maintainability, greatest(0e0, 100e0 - {whole('(maintainability + code_health) / 2e0')}) AS technical_debt FROM (
        SELECT *, {whole(f'(confidence + coverage + {test_coverage}e0) / 3e0')} AS code_health FROM (
          SELECT {whole('round(coalesce(avg(confidence), 0.8e0), 9) * 100e0')} AS confidence, CASE WHEN count(*) > 0 THEN least(100e0, {whole('CAST(count(*) AS DOUBLE) / count(DISTINCT file_path) / 20e0 * 100e0')}) ELSE 50e0 END AS coverage FROM symbols) s
        CROSS JOIN (SELECT coalesce(round(avg(maintainability), 9), 60e0) AS maintainability FROM ({m10_maintainability(d, language)}) i) m) q"""


@sql_operator
def m16_metrics_base(d: Dialect) -> str:
    return f"SELECT id, kind, complexity, cognitive, parameter_count, end_line - line AS loc, fan_in, fan_out FROM ({_DEGREES}) g WHERE confidence > 0.5e0"


_ANTI = {
    "god-class": ("complexity > 15 AND fan_out > 10 AND end_line - line > 200", "CASE WHEN complexity > 25 THEN 'critical' ELSE 'high' END"),
    "long-parameter-list": ("parameter_count > 7", "CASE WHEN parameter_count > 12 THEN 'high' ELSE 'medium' END"),
    "dead-code": ("fan_in = 0 AND NOT is_exported", "'low'"),
    "feature-envy": ("fan_out > 8 AND complexity > 5", "'medium'"),
    "shotgun-surgery": ("fan_in > 20", "CASE WHEN fan_in > 50 THEN 'critical' ELSE 'high' END"),
}


def _anti(kind: str) -> str:
    where, severity = _ANTI[kind]
    return f"SELECT id, '{kind}' AS pattern, {severity} AS severity FROM ({_DEGREES}) g WHERE {where}"


@sql_operator
def m17_god_class(d: Dialect) -> str:
    return _anti("god-class")


@sql_operator
def m18_long_parameter_list(d: Dialect) -> str:
    return _anti("long-parameter-list")


@sql_operator(calls="calls_returned")
def m19_dead_code(d: Dialect, calls: str = "calls") -> str:
    """Nothing calls it and it is not exported."""
    return f"SELECT s.id, s.name FROM symbols s WHERE NOT s.is_exported AND NOT EXISTS (SELECT 1 FROM {calls} c WHERE c.callee_id = s.id)"


@sql_operator
def m20_feature_envy(d: Dialect) -> str:
    return _anti("feature-envy")


@sql_operator
def m22_shotgun_surgery(d: Dialect) -> str:
    return _anti("shotgun-surgery")


@sql_operator
def m23_anti_patterns(d: Dialect) -> str:
    """All of them, with how many each symbol has."""
    return "WITH a AS (" + " UNION ALL ".join(map(_anti, _ANTI)) + ") SELECT id, pattern, severity, count(*) OVER (PARTITION BY id) AS of_symbol FROM a"


@sql_operator
def m24_potential_issues(d: Dialect, limit: int = 20) -> str:
    return f"""SELECT * FROM (SELECT 'complex' AS issue, id, complexity AS value FROM symbols WHERE kind IN ('function', 'method') ORDER BY complexity DESC, id LIMIT {limit}) a
        UNION ALL SELECT * FROM (SELECT 'many dependencies' AS issue, from_id AS id, count(DISTINCT to_id) AS value FROM relationships GROUP BY from_id HAVING count(DISTINCT to_id) > 15 ORDER BY value DESC, id LIMIT {limit}) b"""


@sql_operator
def m25_quality_rollup(d: Dialect) -> str:
    return f"SELECT kind, count(*) AS n, round(avg(complexity), 9) AS complexity, round(avg(fan_in + fan_out), 9) AS coupling, CASE WHEN avg(complexity) > 25 THEN 'split' WHEN avg(fan_in + fan_out) > 30 THEN 'decouple' ELSE 'keep' END AS advice FROM ({_DEGREES}) g GROUP BY kind"


_CPP = {"templates": (r"template\s*<", 2), "virtuals": (r"\b(virtual|override)\b", 1), "exceptions": (r"\b(try|catch)\b", 2), "throws": (r"\bthrow\b", 1), "stl": (r"std::", 1), "memory": (r"\b(new|delete|malloc|free)\b", 1)}


@sql_operator
def m26_cpp_complexity(d: Dialect) -> str:
    """Language features counted by weight; the module's total and its most complex member (ties: smallest id)."""
    total = " + ".join(f"{w} * {d.count_matches('text', p)}" for p, w in _CPP.values())
    return f"SELECT module, CAST(sum(score) AS BIGINT) AS total, round(avg(score), 9) AS mean, {d.least_by('id', d.row('-score', 'id'))} AS most_complex FROM (SELECT id, module, {total} AS score FROM files) f GROUP BY module"


@sql_operator
def m27_semantic_rollups(d: Dialect) -> str:
    """Of each namespace: mean strength of its edges, cohesion (share that stays inside), risk."""
    return "SELECT f.namespace, count(*) AS edges, round(avg(r.confidence), 9) AS strength, round(count(*) FILTER (WHERE f.namespace = t.namespace) / CAST(count(*) AS DOUBLE), 6) AS cohesion, CASE WHEN avg(r.confidence) < 0.7e0 THEN 'high' ELSE 'low' END AS risk FROM relationships r JOIN symbols f ON f.id = r.from_id JOIN symbols t ON t.id = r.to_id GROUP BY f.namespace"


@sql_operator
def m28_readability(d: Dialect) -> str:
    return f"SELECT id, {d.half_up('0.6e0 * confidence + 0.4e0 * (1e0 - least(cognitive, 20) / 20e0)', 2)} AS readability FROM symbols"
