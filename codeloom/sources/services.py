"""Services named in code and configuration: variables, addresses, registries, embedded code.

Texts are read once each, line places counted in code points; what is found of one text
is a few rows, whatever the number of texts.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from ..engine import frame_operator

# How languages read a variable that names a service's address.
_ADDRESS, _HOST = r"[A-Z_]+(?:_SERVICE)?_ADDR", r"[A-Z_]+_HOST"
VARIABLES = [
    ("go", rf"os\.Getenv\s*\(\s*[\"']({_ADDRESS}|{_HOST})[\"']\s*\)"), ("go", rf"mustMapEnv\s*\([^,\n]+,\s*[\"']({_ADDRESS})[\"']\s*\)"), ("javascript", rf"process\.env(?:\.|\[[\"'])({_ADDRESS}|{_HOST})\b"),
    ("python", rf"os\.environ(?:\[|\.get\s*\(\s*)[\"']({_ADDRESS})[\"']"), ("csharp", r"Configuration\[[\"']([A-Z_]+_ADDR)[\"']\]"), ("java", rf"System\.getenv\s*\(\s*\"({_ADDRESS})\"\s*\)"),
]
# Addresses in quotes, by what they are of.
ADDRESSES = [
    ("redis", r"[\"'](redis://[^\"'\n]+|[^:\"'\n]+:6379)[\"']"), ("kafka", r"[\"']([^:\"'\n]+:9092)[\"']"), ("database", r"[\"']((?:postgres|mysql|mongodb)://[^\"'\n]+)[\"']"),
    ("amqp", r"[\"'](amqp://[^\"'\n]+)[\"']"), ("http", r"[\"'](https?://[^\"'\n]+)[\"']"), ("kubernetes", r"[\"']([a-z][\w-]*:\d{1,5})[\"']"),
]
# Protocols of ports, and names that are no services.
PORTS = {80: "http", 443: "http", 3000: "http", 8080: "http", 8081: "http", 8082: "http", 8090: "http", 5432: "database", 3306: "database", 27017: "database", 6379: "redis", 5672: "amqp", 9092: "kafka"}
NO_SERVICES = ("redis", "db", "database", "collector", "kafka", "rabbitmq", "amqp")
_SQL = re.compile(r"([\"'`])\s*(?:SELECT|INSERT|UPDATE|DELETE|CREATE|DROP|ALTER)\s(?:(?!\1)[\s\S])*\1", re.I)
_SCRIPT = re.compile(r"<script[^>]*>([\s\S]*?)</script>", re.I)


def protocol_of(port: int) -> str:
    return PORTS.get(port) or ("http" if 8000 <= port <= 8999 else "grpc")


def service_of(variable: str) -> str:
    """The service that a variable of an address or a host names."""
    base = re.sub(r"_(?:SERVICE_ADDR|ADDR|HOST)$", "", variable).lower().replace("_", "")
    if variable.endswith("_HOST"):
        return base
    if variable.endswith("_SERVICE_ADDR"):
        return base + "service"
    return base if any(x in base for x in NO_SERVICES) or base.endswith("service") else base + "service"


def found_in(text: str) -> Iterator[tuple[str, str, str, int | None, str, int]]:
    """kind (variable or address), what is written, service, port, protocol and line; in the text's order."""
    rows, taken = [], set()
    for language, pattern in VARIABLES:
        for m in re.finditer(pattern, text):
            rows.append((m.start(1), "variable", m[1], service_of(m[1]), None, language))
    for kind, pattern in ADDRESSES:
        for m in re.finditer(pattern, text):
            if m.start(1) not in taken:
                taken.add(m.start(1))
                port = re.search(r":(\d{1,5})(?:/|$)", m[1])
                host = re.match(r"(?:[a-z]+://)?(?:[^@/]*@)?([^:/]+)", m[1])
                number = int(port[1]) if port else None
                rows.append((m.start(1), "address", m[1], host[1].lower() if host else m[1], number, protocol_of(number) if kind == "kubernetes" and number is not None else kind))
    at, line = 0, 1
    for start, *row in sorted(rows, key=lambda r: (r[0], r[1])):
        line += text.count("\n", at, start)
        at = start
        yield (*row, line)


def registered(text: str) -> Iterator[tuple[str, str, str, int, str]]:
    """service, source, host, port and protocol: of Kubernetes variables (name, then value) and of Compose services with ports."""
    for m in re.finditer(r"name:\s*[\"']?([A-Z_]+_ADDR)[\"']?\s*\n\s*value:\s*[\"']?([^\"'\s:]+):(\d{1,5})", text):
        yield service_of(m[1]), m[1], m[2], int(m[3]), protocol_of(int(m[3]))
    inside, name, indent, listed = -1, None, None, False
    for line in text.split("\n"):
        bare = line.split(" #")[0].rstrip()
        depth = len(bare) - len(bare.lstrip())
        if not bare.strip():
            continue
        if re.fullmatch(r"\s*services:", bare):
            inside, name, indent = depth, None, None
        elif inside >= 0 and depth <= inside:
            inside = -1
        elif inside >= 0 and (indent is None or depth == indent) and (m := re.fullmatch(r"\s*([\w.-]+):", bare)):
            indent, name, listed = depth, m[1], False
        elif inside >= 0 and name:
            if re.fullmatch(r"\s*(?:ports|expose):", bare):
                listed = True
            elif listed and (m := re.fullmatch(r"\s*-\s*[\"']?(?:[\d.]+:)?(?:(\d{1,5}):)?(\d{1,5})(?:/tcp)?[\"']?", bare)):
                yield name, "ports", name, int(m[2]), protocol_of(int(m[2]))
            elif not bare.lstrip().startswith("-"):
                listed = False


def embedded(text: str) -> Iterator[tuple[str, int, int, str]]:
    """language, first line, last line and code: statements of SQL in quotes, and bodies of scripts; in the text's order."""
    rows = [(m.start(), m.end(), "sql", m[0]) for m in _SQL.finditer(text)] + [(m.start(), m.end(), "javascript", m[1]) for m in _SCRIPT.finditer(text)]
    at, line = 0, 1
    for start, end, language, code in sorted(rows):
        line += text.count("\n", at, start)
        at = start
        yield language, line, line + text.count("\n", start, end), code


def _each(sources: DataFrame, find: Callable[[str], Iterator[tuple]], columns: dict[str, pa.DataType]) -> DataFrame:
    names = ["id", *columns]
    spelt = {pa.int64(): "long", pa.string(): "string"}

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, text in zip(b.column("id").to_pylist(), b.column("text").to_pylist(), strict=True):
                rows = list(zip(*((i, *row) for row in find(text or "")), strict=True)) or [()] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, [pa.int64(), *columns.values()], strict=True)], names)

    return sources.select("id", "text").mapInArrow(read, "id long, " + ", ".join(f"{n} {spelt[k]}" for n, k in columns.items()))


def service_addresses(sources: DataFrame) -> DataFrame:
    """Variables that name services, and addresses in quotes, of each text (id, text): kind, what is written, service or host, port, language or protocol, and line."""
    return _each(sources, found_in, {"kind": pa.string(), "written": pa.string(), "service": pa.string(), "port": pa.int64(), "protocol": pa.string(), "line": pa.int64()})


def service_registry(sources: DataFrame) -> DataFrame:
    """Services of Kubernetes and Compose files (id, text) with their ports; where several files name one, each has its row."""
    return _each(sources, registered, {"service": pa.string(), "source": pa.string(), "host": pa.string(), "port": pa.int64(), "protocol": pa.string()})


@frame_operator("sources")
def x11_embedded_spans(t: dict[str, DataFrame]) -> DataFrame:
    """Code of another language in each text, with its lines."""
    return _each(t["sources"], embedded, {"language": pa.string(), "start_line": pa.int64(), "end_line": pa.int64(), "code": pa.string()})
