"""The engine: named operators over the model's tables."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .plans.dialect import DUCK, SPARK, Dialect
from .plans.model import BASE, projected, with_model, with_tables

#: name -> SQL text as a function of a dialect and the operator's parameters
SQL_OPERATORS: dict[str, Callable[..., str]] = {}
#: name -> (function of the engine's tables, oracle text or None)
FRAME_OPERATORS: dict[str, tuple[Callable[..., DataFrame], Callable[..., str] | None, str]] = {}
#: name -> the arguments of the driver's query, where the test tables ask for others than the defaults (their names, their entry points)
ON_TEST_TABLES: dict[str, dict] = {}


def sql_operator(f: Callable[..., str] | None = None, **on_test_tables):
    """Register an operator given as SQL; keywords are the arguments of the driver's query."""

    def register(f):
        SQL_OPERATORS[f.__name__] = f
        ON_TEST_TABLES[f.__name__] = on_test_tables
        return f

    return register(f) if f else register


def frame_operator(reads: str, oracle: Callable[..., str] | None = None, **on_test_tables):
    """Register an operator given as a function of (tables, **parameters); reads names its tables."""

    def register(f):
        FRAME_OPERATORS[f.__name__] = (f, oracle, reads)
        ON_TEST_TABLES[f.__name__] = on_test_tables
        return f

    return register


class Engine:
    """Runs operators over frames of the model's shapes: Engine(spark, symbols=..., calls=...).run("g09_hotspots", min_calls=3).

    Tables reach SQL under private names, so the session's own views stay as they are.
    """

    def __init__(self, spark: SparkSession, **tables: DataFrame):
        load()
        self.spark, self.tables = spark, tables
        self._views = {t: f"codeloom_{uuid.uuid4().hex}_{t}" for t in tables}
        for t, df in tables.items():
            df.createOrReplaceTempView(self._views[t])

    def run(self, name: str, **parameters) -> DataFrame:
        if name in SQL_OPERATORS:
            return self.sql(SQL_OPERATORS[name](SPARK, **parameters))
        if name not in FRAME_OPERATORS:
            raise ValueError(f"no operator is named {name}")
        return FRAME_OPERATORS[name][0](self.tables, **parameters)

    def sql(self, body: str) -> DataFrame:
        """A text over the engine's tables."""
        return self.spark.sql(with_tables({t: f"SELECT * FROM {v}" for t, v in self._views.items() if re.search(rf"\b{t}\b", body)}, body))

    @staticmethod
    def operators() -> list[str]:
        load()
        return sorted([*SQL_OPERATORS, *FRAME_OPERATORS])


def load() -> None:
    """Import every operator module."""
    from .operators import callgraph, controlflow, crosslang, dataflow, features, flow, graph, impact, intervals, metrics, paths, patterns, relational, resolution, vectors  # noqa: F401
    from .sources import ingest, services  # noqa: F401
    from .streaming import changes  # noqa: F401


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    load()
    out = {}
    for name, f in SQL_OPERATORS.items():

        def run(spark: SparkSession, sf_dir: str, f=f, given=ON_TEST_TABLES[name]) -> DataFrame:
            body = f(SPARK, **given)
            base = {t: f"SELECT * FROM parquet.`{sf_dir}/{t}.parquet`" for t in BASE}
            return spark.sql(with_model(SPARK, body, base))

        out[name] = run
    for name, (f, _, reads) in FRAME_OPERATORS.items():

        def run(spark: SparkSession, sf_dir: str, f=f, reads=reads, given=ON_TEST_TABLES[name]) -> DataFrame:
            return f(projected(spark, sf_dir, reads), **given)

        out[name] = run
    return dict(sorted(out.items()))


def oracle_sql() -> dict[str, str]:
    load()
    out = {name: with_model(DUCK, f(DUCK, **ON_TEST_TABLES[name])) for name, f in SQL_OPERATORS.items()}
    out |= {name: with_model(DUCK, oracle(DUCK)) for name, (_, oracle, _) in FRAME_OPERATORS.items() if oracle}
    return out
