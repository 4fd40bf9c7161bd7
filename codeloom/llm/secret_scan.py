"""Operator 13: secret scans with corpus-wide ownership frequency.

A scan of each text finds candidates: assignments to names of secrets, access key ids and
long hexadecimal runs (the base kinds, always reported), and besides them, where they do
not touch those, private keys, passwords in URLs and long tokens of mixed letters and
digits (the method's kinds).

Patterns alone cannot tell a live credential from one that every tutorial shows. So the
128-bit hashes of all candidates' values are aggregated over the whole corpus, by
repository, then by owner (a repository's name is taken within its owner's), then
altogether. A value that stands with more than ``max_owners`` owners or in more than
``max_repos`` repositories is a widely copied example; any other is owner-specific and
looks live. Spans of the method's kinds are reported only where they look live; for all
spans reported, live_spans says which do.

Texts are read once. What is written and shuffled holds hashes and places, never a value;
rows without candidates are never shuffled. A value that a third of all rows hold is
counted in three steps of partial sums, and meets its verdict in a join whose small side,
the copied values, is broadcast by its own bytes, else split by adaptive execution.

Defined cases: null and empty texts have no spans (base_sha256 is that of the empty
string); very long texts are scanned whole, in time proportional to their length; a null
owner or repository counts as one of its own; rows that repeat have equal results and
count once for each repository; ids may repeat or be null; an empty table gives no rows;
other columns are not read, whatever their names.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from hashlib import sha256
from itertools import accumulate
from typing import NamedTuple

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import MAX_BROADCAST, near, picked, written

BASE, OWN = ("assign", "access", "hex"), ("key", "url", "mixed")
KINDS = BASE + OWN
SLICE = 256  # rows of a batch that are worked on at a time
MIXED = 24  # least characters of a mixed token

# Patterns over UTF-8 bytes. Assignments are sought in the text with A-Z lower-cased, which moves no byte.
_ASSIGN = re.compile(rb"(?:password|passwd|secret|token|api_?key)[\"']?\x20*+[:=]\x20*+[\"']?([a-z0-9+/_.=-]++)")
_ACCESS = re.compile(rb"AKIA[A-Z0-9]++")
_HEX = re.compile(rb"(?<![0-9a-f])[0-9a-f]{32,}+")
_KEY = re.compile(rb"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----[\r\n]*+([A-Za-z0-9+/=]*+)")
_URL = re.compile(rb"://([^\x00-\x20/:@]++):([^\x00-\x20/:@]++)@")
_MIXED = re.compile(rb"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{%d,}+" % MIXED)
_PARTS = (re.compile(rb"[a-z]"), re.compile(rb"[A-Z]"), re.compile(rb"[0-9]"))


class Span(NamedTuple):
    """Bytes from start to end, the number of their kind, and the value."""

    start: int
    end: int
    kind: int
    value: bytes


def base_spans(raw: bytes) -> list[Span]:
    """Spans of the base kinds, by start and then kind."""
    low = raw.lower()  # of bytes: A-Z only
    found = [Span(m.start(), m.end(), 0, raw[m.start(1) : m.end(1)]) for m in _ASSIGN.finditer(low) if m.end(1) - m.start(1) >= 8]
    found += [Span(*m.span(), 1, m[0]) for m in _ACCESS.finditer(raw) if m.end() - m.start() >= 16]
    found += [Span(*m.span(), 2, m[0]) for m in _HEX.finditer(raw)]
    return sorted(found)


def own_spans(raw: bytes, base: list[Span]) -> list[Span]:
    """Spans of the method's kinds that touch no base span, by start and then kind."""
    found = [Span(*m.span(), 3, m[1]) for m in _KEY.finditer(raw)]
    found += [Span(m.start(1), m.end(2), 4, m[2]) for m in _URL.finditer(raw)]
    found += [Span(*m.span(), 5, m[0]) for m in _MIXED.finditer(raw) if all(p.search(m[0]) for p in _PARTS)]
    starts, ends = [s.start for s in base], list(accumulate((s.end for s in base), max))
    free = lambda s: not (k := bisect_left(starts, s.end)) or ends[k - 1] <= s.start  # noqa: E731  no base span begins before its end and ends after its start
    return [s for s in sorted(found) if free(s)]


def in_code_points(raw: bytes, spans: list[Span]) -> list[tuple[int, int]]:
    """Start and end of each span in code points."""
    if raw.isascii():
        return [(s.start, s.end) for s in spans]
    at, points, known = 0, 0, {}
    for place in sorted({p for s in spans for p in (s.start, s.end)}):
        points += len(raw[at:place].decode())
        at = place
        known[place] = points
    return [(known[s.start], known[s.end]) for s in spans]


def found_in(raw: bytes) -> tuple[list[int], str, list[dict]]:
    """Numbers of spans of the base kinds, the hash of their list, and all spans as rows."""
    base = base_spans(raw)
    spans = sorted(base + own_spans(raw, base))
    rows = [{"start": a, "kind": s.kind, "end": b, "value": xxhash.xxh3_128_digest(s.value)} for s, (a, b) in zip(spans, in_code_points(raw, spans), strict=True)]
    listed = ",".join(f"{KINDS[r['kind']]}:{r['start']}:{r['end']}" for r in rows if r["kind"] < len(BASE))
    return [sum(s.kind == k for s in base) for k in range(len(BASE))], sha256(listed.encode()).hexdigest(), rows


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64()), ("value", pa.binary())]))


def candidates(documents: DataFrame, *, id_col="doc_id", text_col="text", owner_col="source", repo_col="doc_id") -> DataFrame:
    """doc_id, owner, repo, n_assign, n_access, n_hex, base_sha256 and spans (start, kind, end, value's hash) of every row."""
    names = ["doc_id", "owner", "repo", *(f"n_{k}" for k in BASE), "base_sha256", "spans"]

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, SLICE):
                part = b.slice(lo, SLICE)
                got = [found_in(raw or b"") for raw in part.column("text").cast(pa.binary()).to_pylist()]
                counts = [pa.array([n[k] for n, _, _ in got], pa.int64()) for k in range(len(BASE))]
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in names[:3]], *counts, pa.array([h for _, h, _ in got], pa.string()), pa.array([s for _, _, s in got], _SPANS)], names)

    rows = picked(documents, doc_id=id_col, text=text_col, owner=owner_col, repo=repo_col)
    rows = rows.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("owner").cast("string").alias("owner"), F.col("repo").cast("string").alias("repo"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(scanned, "doc_id long, owner string, repo string, n_assign long, n_access long, n_hex long, base_sha256 string, spans array<struct<start long, kind int, end long, value binary>>")


def ownership(found: DataFrame) -> DataFrame:
    """Over rows of candidates(): for each value's hash the numbers of its places (n), repositories and owners."""
    values = found.select("owner", "repo", F.explode("spans").alias("s")).select("owner", "repo", F.col("s.value").alias("value"))
    repos = values.groupBy("value", "owner", "repo").agg(F.count("*").alias("n"))
    owners = repos.groupBy("value", "owner").agg(F.sum("n").alias("n"), F.count("*").alias("n_repos"))
    return owners.groupBy("value").agg(F.sum("n").alias("n"), F.sum("n_repos").alias("n_repos"), F.count("*").alias("n_owners"))


def scan(documents: DataFrame, *, max_owners=2, max_repos=10, max_broadcast=MAX_BROADCAST, **columns) -> DataFrame:
    """For each row of documents: doc_id, n_assign, n_access, n_hex, base_sha256, and found, its spans reported (start, kind, end, live), by start and kind."""
    all_rows = written(candidates(documents, **columns), "candidates")
    some = all_rows.where(F.size("spans") > 0)
    copied = written(ownership(some).where((F.col("n_owners") > max_owners) | (F.col("n_repos") > max_repos)).select("value", F.lit(True).alias("copied")), "copied")
    keep = ["doc_id", *(f"n_{k}" for k in BASE), "base_sha256"]
    each = some.withColumn("row", F.monotonically_increasing_id()).select("row", *keep, F.inline("spans"))
    live = F.col("copied").isNull()
    judged = each.join(near(copied, 24, max_broadcast), "value", "left").select("row", *keep, F.struct("start", "kind", "end", live.alias("live")).alias("span"), (live | (F.col("kind") < len(BASE))).alias("told"))
    judged = judged.groupBy("row", *keep).agg(F.array_sort(F.collect_list(F.when(F.col("told"), F.col("span")))).alias("found"))
    shape = judged.schema["found"].dataType
    return judged.drop("row").unionAll(all_rows.where(F.size("spans") == 0).select(*keep, F.array().cast(shape).alias("found")))


def listed(spans) -> F.Column:
    """kind:start:end of each span, comma-joined."""
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(kinds, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(documents: DataFrame, **options) -> DataFrame:
    """scan(), its spans as strings: spans, live_spans (of these, those that look live) and n_live."""
    live = F.filter("found", lambda s: s["live"])
    return scan(documents, **options).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", listed(F.col("found")).alias("spans"), F.size(live).cast("long").alias("n_live"), listed(live).alias("live_spans"))


def oracle(max_owners=2, max_repos=10) -> str:
    """The same rows: places from the lengths of what lies between matches."""
    name = lambda w: "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in w)
    names = "|".join(map(name, ("password", "passwd", "secret", "token"))) + "|" + name("api") + "_?" + name("key")
    quote = "[\"'']?"
    patterns = [  # kind, pattern, group of the value, group that the span begins with
        ("assign", f"(?:{names}){quote}\\x20*[:=]\\x20*{quote}([A-Za-z0-9+/_.=-]+)", 1, "length(v) >= 8"),
        ("access", "AKIA[A-Z0-9]+", 0, "length(v) >= 16"),
        ("hex", "[0-9a-f]{32,}", 0, "true"),
        ("key", "-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----[\\r\\n]*([A-Za-z0-9+/=]*)", 1, "true"),
        ("url", "://[^\\x00-\\x20/:@]+:([^\\x00-\\x20/:@]+)@", 1, "true"),
        ("mixed", f"[A-Za-z0-9+/_-]{{{MIXED},}}", 0, "regexp_matches(v, '[a-z]') AND regexp_matches(v, '[A-Z]') AND regexp_matches(v, '[0-9]')"),
    ]
    trim = {"url": (3, 1)}
    parts = []
    for k, (kind, pattern, group, test) in enumerate(patterns):
        a, b = trim.get(kind, (0, 0))
        parts.append(f"""SELECT r, {k} AS kind, p + {a} AS s, p + length(m) - {b} AS e, v FROM (
            SELECT r, unnest(m) AS m, unnest(v) AS v, unnest(list_transform(range(1, len(m) + 1), lambda i: CAST(list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS BIGINT))) AS p FROM (
                SELECT r, string_split_regex(t, '{pattern}') AS g, regexp_extract_all(t, '{pattern}', 0) AS m, regexp_extract_all(t, '{pattern}', {group}) AS v FROM d)) WHERE {test}""")
    union = " UNION ALL ".join(parts)
    names_list = "[" + ", ".join(f"'{k}'" for k in KINDS) + "]"
    text = f"string_agg({names_list}[kind + 1] || ':' || s || ':' || e, ',' ORDER BY s, kind)"
    return f"""
    WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS t FROM documents),
    every AS ({union}),
    spans AS (SELECT * FROM every x WHERE kind < 3 OR NOT EXISTS (SELECT 1 FROM every y WHERE y.kind < 3 AND y.r = x.r AND y.s < x.e AND y.e > x.s)),
    counts AS (SELECT v, count(DISTINCT coalesce(source, chr(1))) AS owners, count(DISTINCT (coalesce(source, chr(1)), coalesce(CAST(doc_id AS VARCHAR), chr(1)))) AS repos FROM spans JOIN d USING (r) GROUP BY v),
    judged AS (SELECT spans.*, owners <= {max_owners} AND repos <= {max_repos} AS live FROM spans JOIN counts USING (v)),
    rows_ AS (SELECT r, count(*) FILTER (WHERE kind = 0) AS a, count(*) FILTER (WHERE kind = 1) AS b, count(*) FILTER (WHERE kind = 2) AS c, {text} FILTER (WHERE kind < 3) AS base, {text} FILTER (WHERE kind < 3 OR live) AS told,
              count(*) FILTER (WHERE live) AS n_live, {text} FILTER (WHERE live) AS live_spans FROM judged GROUP BY r)
    SELECT doc_id, coalesce(a, 0) AS n_assign, coalesce(b, 0) AS n_access, coalesce(c, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(told, '') AS spans, coalesce(n_live, 0) AS n_live, coalesce(live_spans, '') AS live_spans
    FROM d LEFT JOIN rows_ USING (r)"""
