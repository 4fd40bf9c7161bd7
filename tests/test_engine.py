"""Every operator with SQL against an independent engine, on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

from codeloom import engine
from codeloom.engine import Engine

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
ORACLE = engine.oracle_sql()


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.6g}"
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(plain, v)) + "]"
    return str(v)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.parametrize("family", sorted({n[0] for n in ORACLE}))
def test_operators_agree_with_the_oracle(spark, duck, family):
    queries = engine.queries()
    for name in (n for n in ORACLE if n[0] == family):
        df = queries[name](spark, SF)
        columns = sorted(df.columns)
        got = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
        result = duck.execute(ORACLE[name])
        names = [c[0] for c in result.description]
        assert sorted(names) == columns, name
        want = sorted(tuple(plain(dict(zip(names, r, strict=True))[c]) for c in columns) for r in result.fetchall())
        assert got == want, name


def test_engine_takes_its_own_tables(spark):
    symbols = spark.createDataFrame([(1, "f", "ns"), (2, "g", "ns")], "id long, name string, namespace string")
    calls = spark.createDataFrame([(1, 2, False)] * 3 + [(2, 2, True)], "caller_id long, callee_id long, is_conditional boolean")
    rows = Engine(spark, symbols=symbols, calls=calls).run("g09_hotspots", min_calls=2).collect()
    assert [(r.id, r.call_count, r.unique_callers, r.is_bottleneck) for r in rows] == [(2, 4, 2, False)]
