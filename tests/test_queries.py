"""Every registered query that has SQL, against DuckDB."""

import glob
import importlib
import os
import re

import duckdb
import pytest

import __spark_entry__ as entry

SQL = entry.oracle_sql()


@pytest.fixture(scope="module")
def db(sf_dir):
    connection = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        connection.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return connection


def values(rows):
    def text(x):
        return "" if x is None else x.isoformat() if hasattr(x, "isoformat") else repr(float(x)) if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x)

    return sorted([text(x) for x in r] for r in rows)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, db, sf_dir, name):
    got = entry.queries()[name](spark, sf_dir)
    columns = sorted(got.columns)
    want = db.execute(SQL[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    assert values(got.select(*columns).collect()) == values([[r[i] for i in order] for r in want.fetchall()])


def test_entry_and_registry(spark):
    assert entry.entry(spark).count() == 5
    assert set(SQL) <= set(entry.queries())


def test_nothing_else_imports_the_optional_subpackage():
    for path in glob.glob("archivelake/**/*.py", recursive=True):
        if not path.startswith("archivelake/llm/"):
            with open(path) as f:
                assert not re.search(r"\bllm\b", f.read()), path
    assert importlib.import_module("archivelake")
