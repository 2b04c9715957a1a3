from __future__ import annotations

import importlib
import re
from collections import Counter
from pathlib import Path

import duckdb
import pytest

from corpusloom.plans import registry

SQL_TYPES = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "boolean": "BOOLEAN", "double": "DOUBLE"}


@pytest.fixture(scope="module")
def views(small):
    db = duckdb.connect()
    for f in Path(small).glob("*.parquet"):
        db.execute(f"create view {f.stem} as select * from '{f}'")
    return db


def same(v):
    return round(v, 6) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, small, views, name):
    frame = registry.QUERIES[name](spark, small)
    columns = sorted(frame.columns)
    rows = Counter(tuple(same(r[c]) for c in columns) for r in frame.collect())
    if name not in registry.SQL:
        assert rows
        return
    result = views.execute(registry.SQL[name])
    kinds = {d[0]: str(d[1]) for d in result.description}
    assert sorted(kinds) == columns
    assert {c: kinds[c] for c in columns} == {c: SQL_TYPES.get(t, t) for c, t in frame.dtypes}
    order = [list(kinds).index(c) for c in columns]
    assert rows == Counter(tuple(same(r[i]) for i in order) for r in result.fetchall())


def test_entry(spark):
    module = importlib.import_module("__spark_entry__")
    assert module.entry(spark).count() > 0
    assert set(module.oracle_sql()) <= set(module.queries())


def test_the_rest_does_not_need_the_training_folder():
    root = Path(registry.__file__).resolve().parents[1]
    for f in root.rglob("*.py"):
        if "llm" not in f.relative_to(root).parts:
            assert not re.search(r"corpusloom\.llm|from \.+llm", f.read_text()), f
