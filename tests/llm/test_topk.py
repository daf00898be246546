"""Top-k against brute force; ties, nulls, odd vectors, one very common vector."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pixelspark.llm import topk


def brute(rows, k):
    good = [(i, np.floor(1024 * np.array(v, float)).astype(np.int64)) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all()]
    out = set()
    for q, v in good:
        if q % 100 == 0:
            scores = sorted((-int(v @ w), i) for i, w in good if i != q and len(w) == len(v))[:k]
            out |= {(q, n, i, -s) for n, (s, i) in enumerate(scores, 1)}
    return out


def test_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(topk, "PIECE", 64)
    monkeypatch.setattr(topk, "LEAF", 8)
    r = np.random.default_rng(3)
    rows = [(i, r.normal(size=6).round(2).tolist()) for i in range(900)] + [(i, [0.5] * 6) for i in range(900, 1300)]
    rows += [(2000, None), (2100, []), (2200, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (2300, [float("nan")] * 6), (2400, [float("inf")] + [0.0] * 5), (None, [1.0] * 6), (2500, [1.0, 2.0]), (2501, [3.0, 4.0]), (2600, [1e6] * 6)]
    df = spark.createDataFrame([(*x, 1, 2) for x in rows], "vec_id long, embedding array<double>, rank int, score int").repartition(4)
    got = {tuple(x) for x in topk.exact_top_k(df, F.col("vec_id") % 100 == 0).collect()}
    assert got == brute(rows, 10)
    assert topk.exact_top_k(df.limit(0), F.col("vec_id") % 100 == 0).count() == 0


def test_wide_values_use_exact_integers():
    r = np.random.default_rng(0)
    v = r.integers(-(2**28), 2**28, (50, 5))
    tree = topk.build_tree(np.arange(50), v)
    ids, scores = topk.search(tree, 7, v[7], 5, -np.inf)
    want = sorted((-int(sum(int(a) * int(b) for a, b in zip(v[7], w, strict=True))), i) for i, w in enumerate(v) if i != 7)[:5]
    assert [(-s, i) for s, i in zip(scores.tolist(), ids.tolist(), strict=True)] == want


def test_components_beyond_integer_scores_raise(spark):
    df = spark.createDataFrame([(0, [1e300, 0.0]), (1, [1.0, 2.0])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="too large"):
        topk.exact_top_k(df, F.col("vec_id") % 100 == 0).collect()
