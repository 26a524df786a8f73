"""Nearest neighbours against brute force: recall, exact scores, odd rows, hot groups."""

import math
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from gleanwork.llm import nearest, queries

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")
SCHEMA = "vec_id long, embedding array<float>, rank string"


def brute(rows, k=5, size=None):
    """``{(query, rank): (id, score)}`` of rows ``(id, vector)`` in double precision."""
    good = [(i, np.array(v, np.float32).astype(float)) for i, v in rows if i is not None and v and None not in v and all(map(math.isfinite, v)) and any(v)]
    good = [x for x in good if len(x[1]) == (size or len(x[1]))]
    out = {}
    for i, v in good:
        if i % 50 == 0:
            near = {}
            for j, w in good:
                if j != i:
                    score = float((v * w).sum() / (math.sqrt((v * v).sum()) * math.sqrt((w * w).sum())))
                    near[j] = max(score, near.get(j, -2))
            for r, (j, score) in enumerate(sorted(near.items(), key=lambda x: (-x[1], x[0]))[:k], 1):
                out[i, r] = (j, score)
    return out


def found(df, **kw):
    return {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in nearest.nearest_neighbours(df, F.col("vec_id") % 50 == 0, **kw).collect()}


def recall(got, want):
    own = {(q, x[0]) for (q, _), x in got.items()}
    return sum((q, x[0]) in own for (q, _), x in want.items()) / max(1, len(want))


def made(n, seed, hot=0.0, size=24):
    rng = np.random.default_rng(seed)
    rows = rng.standard_normal((n, size))
    middle = rng.standard_normal(size)
    near = rng.random(n) < hot
    rows[near] = middle + 0.05 * rng.standard_normal((int(near.sum()), size))
    return [(i, [float(x) for x in r.astype(np.float32)]) for i, r in enumerate(rows)]


@pytest.mark.parametrize("hot", [0.0, 0.35])
def test_recall_with_a_small_sample(spark, monkeypatch, hot):
    monkeypatch.setattr(nearest, "SAMPLE_ROWS", 600)
    monkeypatch.setattr(nearest, "CANDIDATES", 64)
    monkeypatch.setattr(nearest, "QUERIES", 8)
    rows = made(4000, 3, hot)
    got, want = found(spark.createDataFrame(rows, "vec_id long, embedding array<float>")), brute(rows)
    assert len(got) == len(want) and recall(got, want) >= 0.95
    exact = {(q, v): s for (q, _), (v, s) in want.items()}
    assert all(abs(s - exact[q, v]) < 1e-12 for (q, _), (v, s) in got.items() if (q, v) in exact)
    for q in {q for q, _ in got}:
        own = [got[q, r] for r in range(1, 6)]
        assert own == sorted(own, key=lambda x: (-x[1], x[0])) and q not in [v for v, _ in own]


def test_registered_query(spark):
    table = spark.read.parquet(f"{SF}/embeddings.parquet")
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in queries.op11_nearest(spark, SF).collect()}
    want = brute([(r.vec_id, list(r.embedding)) for r in table.select("vec_id", "embedding").collect()])
    assert recall(got, want) >= 0.9 and len(got) == len(want)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [1.0, 0.0]), (0, [1.0, 0.0]), (1, [2.0, 0.0]), (1, [2.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 0.0]), (4, None), (5, [None, 1.0]), (6, [nan, 1.0]),
        (7, [1.0, -inf]), (8, []), (9, [1.0, 1.0, 1.0]), (None, [1.0, 0.0]), (50, [0.0, -3.0]), (100, [0.0, 0.0]),
    ]
    df = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA)
    got = found(df)
    assert {k: v[0] for k, v in got.items()} == {(0, 1): 1, (0, 2): 2, (0, 3): 50, (50, 1): 0, (50, 2): 1, (50, 3): 2}
    assert got == brute(rows, size=2)


@pytest.mark.parametrize("rows", [[], [(50, [1.0, 2.0])], [(1, [1.0]), (2, [2.0])], [(50, None)]])
def test_few_rows(spark, rows):
    assert found(spark.createDataFrame(rows, "vec_id long, embedding array<double>")) == {}


def test_far_exponents(spark):
    rows = [(0, [1e200, 1e200]), (1, [1e-200, 1e-200]), (2, [1e200, -1e200]), (3, [5e-324, 0.0])]
    got = found(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    assert [got[0, r][0] for r in (1, 2, 3)] == [1, 3, 2] and abs(got[0, 1][1] - 1) < 1e-12


def test_equal_vectors_tie_by_id(spark):
    rows = [(i, [0.3, 0.7, -0.2]) for i in range(300)]
    got = found(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    assert [got[0, r][0] for r in range(1, 6)] == [1, 2, 3, 4, 5] and [got[50, r][0] for r in range(1, 6)] == [0, 1, 2, 3, 4]


def test_the_test_keeps_near_pairs():
    rng = np.random.default_rng(1)
    q, c = nearest.units(rng.standard_normal((50, 64))), nearest.units(rng.standard_normal((3000, 64)))
    rotation = nearest.rotation_matrix(64)
    whole = 2 - 2 * (q @ c.T)
    bound = np.sort(whole, axis=1)[:, 4].astype(float)
    at_q, at_c = nearest.survivors(q @ rotation, c @ rotation, bound)
    kept = set(zip(at_q.tolist(), at_c.tolist(), strict=True))
    want = set(zip(*(x.tolist() for x in np.nonzero(whole <= bound[:, None])), strict=True))
    assert len(want & kept) >= 0.98 * len(want) and len(kept) < 0.02 * whole.size
