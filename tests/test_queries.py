"""Every registered query with SQL gives that SQL's rows; the others run and return rows."""

import math

import duckdb
import pytest

from pixelspark.plans import queries as images
from pixelspark.streaming import queries as streams

QUERIES, SQL = images.QUERIES | streams.STREAMS, images.ORACLES | streams.ORACLES


@pytest.fixture(scope="module")
def db(sf_dir):
    c = duckdb.connect()
    for t in ("events", "embeddings", "documents"):
        c.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return c


def _rows(rows):
    norm = lambda v: round(v, 5) + 0.0 if isinstance(v, float) else v
    return sorted((tuple(norm(v) for v in r) for r in rows), key=repr)


def _same(a, b):
    return all(x == y or (isinstance(x, float) and isinstance(y, (int, float)) and math.isclose(x, y, rel_tol=1e-6, abs_tol=2e-4)) for p, q in zip(a, b, strict=True) for x, y in zip(p, q, strict=True))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf_dir, db, name):
    df = QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    got = _rows(tuple(r) for r in df.select(*columns).collect())
    if name not in SQL:
        assert got
        return
    want = db.sql(SQL[name])
    assert sorted(want.columns) == columns
    want = _rows(want.select(*(f'"{c}"' for c in columns)).fetchall())
    assert len(got) == len(want) and _same(got, want)
