"""Every registered query against its SQL on the smallest tables."""

import os
import re

import duckdb
import pytest

import __spark_entry__

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
ORACLES = __spark_entry__.oracle_sql()
QUERIES = {k: q for k, q in __spark_entry__.queries().items() if not re.match(r"op\d+_|pipeline$", k)}


@pytest.fixture(scope="module")
def tables():
    if not os.path.isdir(FOLDER):
        pytest.skip("no tables here")
    connection = duckdb.connect()
    for name in os.listdir(FOLDER):
        connection.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{FOLDER}/{name}'")
    return connection


def plain(value):
    if hasattr(value, "tolist"):
        value = value.tolist()
    if isinstance(value, float):
        return None if value != value else value + 0.0
    return value


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, tables, name):
    got = QUERIES[name](spark, FOLDER)
    columns = sorted(got.columns)
    rows = sorted((tuple(plain(r[c]) for c in columns) for r in got.collect()), key=repr)
    if name not in ORACLES:
        assert rows
        return
    cursor = tables.execute(ORACLES[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    assert rows == sorted((tuple(plain(r[i]) for i in order) for r in cursor.fetchall()), key=repr)


def test_nothing_else_imports_the_llm_folder():
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    for folder, _, files in os.walk(os.path.join(root, "orbitweave")):
        if "llm" not in os.path.relpath(folder, root).split(os.sep):
            for f in (f for f in files if f.endswith(".py")):
                with open(os.path.join(folder, f)) as text:
                    assert ".llm" not in text.read(), f
