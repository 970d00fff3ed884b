"""Every query against its SQL on the smallest tables, and the contract's module."""

import ast
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from lexaquarry.plans import catalog

ROOT = Path(__file__).resolve().parent.parent


@pytest.fixture(scope="module")
def con(data):
    con = duckdb.connect()
    for p in Path(data).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p / '*.parquet' if p.is_dir() else p}')")
    return con


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, data, con, name):
    got = catalog.QUERIES[name](spark, data).toPandas()
    if name not in catalog.ORACLES:
        assert len(got)
        return
    want = con.execute(catalog.ORACLES[name]).df()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    rows = lambda d: sorted(repr([None if x != x else x for x in r]) for r in d[columns].astype(object).values.tolist())
    assert rows(got) == rows(want)


def test_contract(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0


def test_the_rest_stands_without_the_training_operators():
    """Nothing outside the contract's module and the pipeline imports them."""
    for p in ROOT.glob("lexaquarry/**/*.py"):
        if "llm" in p.relative_to(ROOT).parts:
            continue
        for node in ast.walk(ast.parse(p.read_text())):
            names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or "", *[a.name for a in node.names]] if isinstance(node, ast.ImportFrom) else []
            assert not any("llm" in n.split(".") for n in names), p
