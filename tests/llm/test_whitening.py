"""Whitening against plain NumPy and Python integers over the expanded list of rows."""

import math

import numpy as np
import pytest

from pixelspark.llm import queries as q
from pixelspark.llm.whitening import component_rows, whiten_vectors

SCHEMA = "vec_id long, embedding array<double>, n int, dim int"


def plain(rows, most=32):
    """(vec_id, component) -> the expected figures, from every row by itself."""
    rows = [(i, [math.floor(64 * c) + 1_000_000 for c in v]) for i, v in rows]
    x = np.array([v for _, v in rows], dtype=object)
    n, s = len(x), x.sum(axis=0)
    c = np.array([[float((n * a - b)) / n for a, b in zip(v, s, strict=True)] for v in x])
    e, vectors = np.linalg.eigh(c.T @ c / n)
    e, vectors = e[::-1], vectors[:, ::-1]
    out = {}
    for (i, v), row in zip(rows, c, strict=True):
        deviation = sum((n * a - b) ** 2 for a, b in zip(v, s, strict=True))
        for k in range(min(most, len(e))):
            if e[k] > 1e-11 * e[0]:
                out[i, k + 1] = n, deviation, row @ vectors[:, k] / np.sqrt(e[k]), e[k] / e.sum()
    return out


def check(got, want):
    assert {(r.vec_id, r.component) for r in got} == set(want) and len(got) == len(want)
    by = {}
    for r in got:
        by.setdefault(r.component, []).append((r, want[r.vec_id, r.component]))
    for rows in by.values():
        sign = np.sign(sum(r.whitened * w[2] for r, w in rows)) or 1
        for r, (n, deviation, z, share) in rows:
            assert (r.n, r.deviation) == (n, deviation)
            assert r.whitened == pytest.approx(sign * z, abs=1e-7) and r.explained == pytest.approx(share, rel=1e-9) and r.identity_error <= 1e-6


def test_query(spark, sf_dir):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    check(q.QUERIES["op12_whitening"](spark, sf_dir).collect(), plain(rows))


def test_copies_flat_directions_and_rows_left_out(spark):
    rng = np.random.default_rng(3)
    good = [(i, [*rng.normal(size=3).tolist(), 0.5, 0.5]) for i in range(60)]
    good += [(100 + i, good[i % 3][1]) for i in range(500)]  # three hot vectors, in the same direction flat
    good = [(i, [*v, v[0]]) for i, v in good]  # a component twice: rank 3 of 6
    bad = [(900, None), (901, []), (902, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (903, [float("nan")] * 6), (904, [float("inf")] * 6)]
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in good + bad], SCHEMA)
    got = component_rows(whiten_vectors(df.repartition(3))).collect()
    assert max(r.component for r in got) == 3
    check(got, plain(good))


def test_edges(spark):
    assert component_rows(whiten_vectors(spark.createDataFrame([], SCHEMA))).collect() == []
    one = whiten_vectors(spark.createDataFrame([(None, [1.0, 2.0], 0, 0), (None, [1.0, 2.0], 0, 0)], SCHEMA)).collect()
    assert [(r.vec_id, r.n, r.deviation, r.whitened) for r in one] == [(None, 2, 0, [])] * 2
    # Lengths apart, sums beyond 2^63, deviations beyond a long.
    big = [(i, [2.0**40 * (-1) ** i, float(i)], 0, 0) for i in range(6)]
    two = [(10, [1.0], 0, 0), (11, [3.0], 0, 0)]
    got = {r.vec_id: r for r in whiten_vectors(spark.createDataFrame(big + two, SCHEMA)).collect()}
    assert [got[i].deviation for i in range(6)] == [None] * 6 and [got[i].n for i in (0, 10)] == [6, 2]
    assert [got[i].deviation for i in (10, 11)] == [128**2] * 2 and abs(got[10].whitened[0]) == pytest.approx(1)
    with pytest.raises(Exception, match="too large"):
        whiten_vectors(spark.createDataFrame([(1, [1e300], 0, 0)], SCHEMA))
