"""Every query with an SQL twin gives the same rows on the smallest tables."""

from __future__ import annotations

from collections import Counter
from pathlib import Path

import duckdb
import pytest

from palimpsest import queries

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test tables")


def _norm(v):
    if isinstance(v, float):
        return round(v, 9)
    if isinstance(v, (list, tuple)):
        return tuple(map(_norm, v))
    return v.replace(tzinfo=None) if hasattr(v, "tzinfo") else v


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for p in DATA.glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from '{p}'")
    return con


def same(spark, tables, query, sql):
    df = query(spark, str(DATA))
    cols = sorted(df.columns)
    mine = Counter(tuple(_norm(r[c]) for c in cols) for r in df.collect())
    got = tables.execute(sql)
    names = [d[0] for d in got.description]
    assert sorted(names) == cols
    theirs = Counter(tuple(_norm(r[names.index(c)]) for c in cols) for r in got.fetchall())
    assert mine == theirs


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_twin(spark, tables, name):
    same(spark, tables, queries.QUERIES[name], queries.SQL[name])


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.SQL)))
def test_runs(spark, tables, name):
    """Queries without a twin give a row for every input row they are about, and nothing empty."""
    df = queries.QUERIES[name](spark, str(DATA))
    rows = df.collect()
    key = df.columns[0]
    assert rows and all(r[key] is not None for r in rows)
    texts = tables.execute("select count(*) from extraction_results").fetchone()[0]
    filled = tables.execute("select count(*) from extraction_results where raw_text is not null").fetchone()[0]
    if name in ("clean_text", "clean_text_enhanced", "clean_and_structure", "stream_clean"):
        assert len({r[key] for r in rows}) == len(rows) == texts
    if name == "native_books":
        assert len(rows) == filled
    if name == "page_similarity":
        assert all(0 <= r.similarity <= 1 for r in rows) and not any(r.same_number and r.page_no == 0 for r in rows)
