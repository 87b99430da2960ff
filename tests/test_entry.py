"""The driver contract: queries against their SQL on the smallest tables."""

import math

import duckdb
import pytest

import __spark_entry__ as entry
from verbena.plans.operations import QUERIES, SQL

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(x):
    if x is None:
        return ""
    return ("nan" if math.isnan(x) else f"{x:.9g}") if isinstance(x, float) else str(x)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, con, name):
    df = QUERIES[name](spark, SF)
    want = con.sql(SQL[name])
    columns = sorted(df.columns)
    assert sorted(want.columns) == columns
    at = [want.columns.index(c) for c in columns]
    assert sorted(tuple(plain(r[c]) for c in columns) for r in df.collect()) == sorted(tuple(plain(r[i]) for i in at) for r in want.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_import_without_the_optional_parts(tmp_path):
    """The driver removes the operators' folder and the pipeline."""
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(entry.__file__).parent
    shutil.copytree(root / "verbena", tmp_path / "verbena", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    run = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"], cwd=tmp_path, capture_output=True, text=True, env={"PATH": "/usr/bin:/bin", "HOME": "/tmp"})
    assert run.stdout.split() == [str(len(QUERIES)), str(len(SQL))], run.stderr


WHOLE = {"select_predicates": ("lineitem", 1), "raw_sql": ("orders", 1), "join_right_self": ("customer", 1), "gather_long": ("lineitem", 2), "pivot_longer_value": ("lineitem", 2), "user_functions": ("orders", 1)}


@pytest.mark.parametrize("name", sorted(WHOLE))
def test_whole_tables_are_read(spark, con, name):
    table, times = WHOLE[name]
    assert QUERIES[name](spark, SF).count() == times * con.sql(f"SELECT count(*) FROM {table}").fetchall()[0][0]


def test_a_change_that_is_almost_a_tie(spark, tmp_path):
    """41.77 / 25.6 - 1 prints as 0.631640625, but the double is below it."""
    path = tmp_path / "events.parquet"
    con = duckdb.connect()
    con.sql(f"COPY (SELECT * REPLACE (event_id + 1 AS event_id, 7 AS user_id, [25.6, 41.77][event_id + 1] AS value) FROM '{SF}/events.parquet' WHERE event_id < 2) TO '{path}' (FORMAT parquet)")
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{path}'")
    want = con.sql(f"SELECT event_id, pct FROM ({SQL['running_again']}) ORDER BY 1").fetchall()
    assert want == [(1, None), (2, 0.63164062)]
    assert [tuple(r) for r in QUERIES["running_again"](spark, str(tmp_path)).select("event_id", "pct").orderBy("event_id").collect()] == want
