"""Registered queries against DuckDB on the smallest tables."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from conftest import DATA

QUERIES, SQL = entry.queries(), entry.oracle_sql()


def canon(v):
    if isinstance(v, float):
        return "nan" if v != v else round(v, 6) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(canon(x) for x in v)
    return v


@pytest.fixture(scope="module")
def duck():
    if not glob.glob(f"{DATA}/*.parquet"):
        pytest.skip("no test tables")
    c = duckdb.connect()
    for path in glob.glob(f"{DATA}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return c


@pytest.mark.parametrize("name", [n for n in SQL if not n.startswith("p")] + ["prompt_budget", "percentile_lower"])
def test_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    got = sorted(repr(tuple(canon(r[c]) for c in cols)) for r in df.collect())
    cursor = duck.execute(SQL[name])
    names = [x[0] for x in cursor.description]
    assert sorted(names) == cols
    want = sorted(repr(tuple(canon(r[names.index(c)]) for c in cols)) for r in cursor.fetchall())
    assert got == want


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in SQL and not n.startswith("p")])
def test_runs(spark, duck, name):
    QUERIES[name](spark, DATA).collect()


def test_entry(spark):
    assert entry.entry(spark).columns == ["qid", "rank_no", "vec_id", "score"]


def test_nothing_imports_the_optional_subpackage():
    root = os.path.dirname(entry.__file__)
    for path in glob.glob(f"{root}/quillvec/**/*.py", recursive=True):
        if "/llm/" not in path:
            assert "quillvec.llm" not in open(path).read(), path
