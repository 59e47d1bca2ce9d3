"""Every query of the library on the smallest driver tables, against its SQL where there is one."""

from __future__ import annotations

import os

import duckdb
import pytest

from tallyline.plans import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables aren't here")


def _rows(columns, rows):
    """Columns by name and sorted rows as texts: floats to nine digits, all else, integers too, as it is."""
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    text = lambda v: "" if v is None or v != v else f"{v:.9g}" if isinstance(v, float) else str(v)
    return [columns[i] for i in order], sorted(tuple(text(r[i]) for i in order) for r in rows)


@pytest.fixture(scope="module")
def db():
    with duckdb.connect() as connection:
        for t in os.listdir(DATA):
            connection.execute(f"CREATE VIEW {t[:-8]} AS SELECT * FROM '{DATA}/{t}'")
        yield connection


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, db, name):
    got = QUERIES[name](spark, DATA)
    rows = got.collect()
    if name in ORACLES:
        wanted = db.execute(ORACLES[name])
        assert _rows(got.columns, rows) == _rows([c[0] for c in wanted.description], wanted.fetchall())


def test_entry_imports_without_the_training_subpackage(monkeypatch):
    import sys

    import __spark_entry__ as entry

    for name in [m for m in sys.modules if m.startswith("tallyline.llm") or m == "corpus_pipeline"]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "tallyline.llm", None)
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    assert set(entry.queries()) == set(QUERIES) and set(entry.oracle_sql()) == set(ORACLES)
