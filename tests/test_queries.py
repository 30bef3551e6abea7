"""Every query of the engine against its SQL on DuckDB."""

import datetime as dt
import math
import os

import duckdb
import pytest

import __spark_entry__
from pathval.queries import QUERIES, SQL

DATA = os.environ.get("PATHVAL_TEST_DATA", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no verification tables")


def plain(x):
    if isinstance(x, float) and math.isnan(x):
        return None
    if isinstance(x, dt.datetime):
        return x.date()
    return round(x, 4) if isinstance(x, float) else x


def rows(names, found):
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted((tuple(plain(r[k]) for k in order) for r in found), key=repr)


@pytest.fixture(scope="module")
def duck():
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return db


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    wanted = duck.execute(SQL[name])
    names = [c[0] for c in wanted.description]
    assert sorted(names) == sorted(df.columns)
    got = rows(df.columns, df.collect())
    expected = rows(names, wanted.fetchall())
    assert len(got) == len(expected)
    for g, e in zip(got, expected, strict=True):
        assert g == pytest.approx(e, abs=2e-4) if all(isinstance(x, (int, float)) for x in g) else g == e, name


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(SQL) <= set(QUERIES) <= set(__spark_entry__.queries())


def test_entry_without_the_text_operators():
    import subprocess
    import sys

    code = "import sys; sys.modules['pathval.llm'] = None; import __spark_entry__ as e; assert 'pipeline' not in e.queries() and set(e.oracle_sql()) < set(e.queries())"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def test_simulated_storage_is_valued_on_the_default_paths(spark, monkeypatch):
    from pathval import bench_contracts
    from pathval.api import PATHS

    asked, calc = [], bench_contracts.calc
    monkeypatch.setattr(bench_contracts, "calc", lambda *a, **k: asked.append(a[3]) or calc(*a, **k))
    assert QUERIES["gas_storage_simulated"](spark, "/root/testdata/sf0.001").count() > 0
    assert asked == [PATHS]
