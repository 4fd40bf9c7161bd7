"""The few places where the two SQL dialects differ.

Operators are SQL texts over the model's tables, written once as a function of a
dialect. SPARK renders what the engine runs; DUCK renders the same question for an
independent engine, which the tests compare with.
"""

from __future__ import annotations


class Dialect:
    def __init__(self, spark: bool):
        self.spark = spark

    def joined_set(self, x: str) -> str:
        """Distinct non-null values of a group, sorted and comma-joined."""
        return f"array_join(array_sort(collect_set({x})), ',')" if self.spark else f"coalesce(array_to_string(list_sort(list(DISTINCT {x}) FILTER (WHERE {x} IS NOT NULL)), ','), '')"

    def joined_list(self, x: str, order: str, sep: str = ",") -> str:
        """Values of a group in the order of an expression that has no ties."""
        if self.spark:
            return f"array_join(transform(array_sort(collect_list(struct({order} AS o, {x} AS v))), s -> s.v), '{sep}')"
        return f"string_agg({x}, '{sep}' ORDER BY {order})"

    def div(self, a: str, b: str) -> str:
        """Whole quotient."""
        return f"CAST(floor(({a}) / ({b})) AS BIGINT)" if self.spark else f"CAST(floor(CAST(({a}) AS DOUBLE) / ({b})) AS BIGINT)"

    def count_matches(self, text: str, pattern: str) -> str:
        return f"CAST(regexp_count({text}, '{self.escaped(pattern)}') AS BIGINT)" if self.spark else f"CAST(len(regexp_extract_all({text}, '{pattern}')) AS BIGINT)"

    def matches(self, text: str, pattern: str) -> str:
        return f"({text} rlike '{self.escaped(pattern)}')" if self.spark else f"regexp_matches({text}, '{pattern}')"

    def extract(self, text: str, pattern: str, group: int = 1) -> str:
        return f"regexp_extract({text}, '{self.escaped(pattern)}', {group})" if self.spark else f"regexp_extract({text}, '{pattern}', {group})"

    def extract_all(self, text: str, pattern: str, group: int = 1) -> str:
        return f"regexp_extract_all({text}, '{self.escaped(pattern)}', {group})" if self.spark else f"regexp_extract_all({text}, '{pattern}', {group})"

    def replace(self, text: str, pattern: str, by: str) -> str:
        return f"regexp_replace({text}, '{self.escaped(pattern)}', '{by}')" if self.spark else f"regexp_replace({text}, '{pattern}', '{by}', 'g')"

    @staticmethod
    def escaped(pattern: str) -> str:
        return pattern.replace("\\", "\\\\")

    def split(self, text: str, sep: str) -> str:
        """By a literal separator."""
        if not self.spark:
            return f"string_split({text}, {'chr(10)' if sep == chr(10) else repr(sep)})"
        quoted = "\\\\n" if sep == "\n" else "".join("\\\\" + c if c in ".|*+?()[]{}^$\\" else c for c in sep)
        return f"split({text}, '{quoted}')"

    def size(self, array: str) -> str:
        return f"CAST(greatest(size({array}), 0) AS BIGINT)" if self.spark else f"CAST(coalesce(len({array}), 0) AS BIGINT)"

    def last(self, array: str) -> str:
        return f"element_at({array}, -1)" if self.spark else f"{array}[-1]"

    def contains(self, text: str, part: str) -> str:
        return f"contains({text}, {part})"

    def explode(self, array: str) -> str:
        return f"explode({array})" if self.spark else f"unnest({array})"

    def array(self, *items: str) -> str:
        return f"array({', '.join(items)})" if self.spark else f"[{', '.join(items)}]"

    def has(self, array: str, item: str) -> str:
        return f"array_contains({array}, {item})" if self.spark else f"list_contains({array}, {item})"

    def append(self, array: str, item: str) -> str:
        return f"array_append({array}, {item})" if self.spark else f"list_append({array}, {item})"

    def join_ints(self, array: str, sep: str = ">") -> str:
        return f"array_join(CAST({array} AS ARRAY<STRING>), '{sep}')" if self.spark else f"array_to_string({array}, '{sep}')"

    def filter_lines(self, array: str, condition: str) -> str:
        """Elements x that meet a condition."""
        return f"filter({array}, x -> {condition})" if self.spark else f"list_filter({array}, lambda x: {condition})"

    def mapped(self, array: str, body: str) -> str:
        return f"transform({array}, x -> {body})" if self.spark else f"list_transform({array}, lambda x: {body})"

    def distinct(self, array: str) -> str:
        return f"array_distinct({array})" if self.spark else f"list_distinct({array})"

    def common(self, a: str, b: str) -> str:
        return f"array_intersect({a}, {b})" if self.spark else f"list_intersect({a}, {b})"

    def union(self, a: str, b: str) -> str:
        return f"array_union({a}, {b})" if self.spark else f"list_distinct(list_concat({a}, {b}))"

    def sequence(self, a: str, b: str) -> str:
        return f"sequence({a}, {b})" if self.spark else f"range({a}, {b} + 1)"

    def slice(self, array: str, start: str, n: str) -> str:
        return f"slice({array}, {start}, {n})" if self.spark else f"list_slice({array}, {start}, {start} + {n} - 1)"

    def dot(self, a: str, b: str) -> str:
        """Inner product of two float arrays, in double."""
        if self.spark:
            return f"aggregate(zip_with({a}, {b}, (p, q) -> CAST(p AS DOUBLE) * CAST(q AS DOUBLE)), CAST(0 AS DOUBLE), (s, v) -> s + v)"
        return f"list_dot_product(CAST({a} AS DOUBLE[]), CAST({b} AS DOUBLE[]))"

    def half_up(self, x: str, digits: int = 0) -> str:
        """Rounded half towards plus infinity."""
        scale = 10**digits
        return f"(floor(({x}) * {scale} + 0.5e0) / {scale}e0)"

    def stddev_pop(self, x: str) -> str:
        return f"stddev_pop({x})"

    def least_by(self, value: str, order: str) -> str:
        return f"min_by({value}, {order})" if self.spark else f"arg_min({value}, {order})"

    def most_by(self, value: str, order: str) -> str:
        return f"max_by({value}, {order})" if self.spark else f"arg_max({value}, {order})"

    def row(self, *items: str) -> str:
        return f"struct({', '.join(items)})" if self.spark else f"row({', '.join(items)})"

    def json_int(self, text: str, key: str) -> str:
        return f"CAST(get_json_object({text}, '$.{key}') AS BIGINT)" if self.spark else f"CAST(json_extract({text}, '$.{key}') AS BIGINT)"


SPARK, DUCK = Dialect(True), Dialect(False)
