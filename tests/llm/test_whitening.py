"""Whitening against numpy's eigenvectors of the covariance, its solver on hard matrices, odd rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_points
from staffmart.llm import whitening

SF_DIR = "/root/testdata/sf0.001"


def expected(vectors):
    x = np.floor(1024 * np.asarray(vectors, np.float64)).astype(np.int64) + 100_000
    spread = len(x) * x - x.sum(axis=0)
    centred = spread / len(x)
    values, axes = np.linalg.eigh(centred.T @ centred / len(x))
    values, axes = values[::-1], axes[:, ::-1]
    return (spread**2).sum(axis=1), centred, values, axes


def test_query_equals_numpy(spark):
    rows = sorted(spark.read.parquet(f"{SF_DIR}/embeddings.parquet").collect(), key=lambda r: r.vec_id)
    deviation, centred, values, axes = expected([r.embedding for r in rows])
    found = sorted(entry_points.queries()["op11_whitening"](spark, SF_DIR).collect(), key=lambda r: (r.vec_id, r.component))
    assert [(r.vec_id, r.component) for r in found] == [(r.vec_id, c) for r in rows for c in range(1, 9)]
    assert [r.deviation for r in found[::8]] == deviation.tolist() and {r.n for r in found} == {len(rows)}
    white = np.array([r.whitened for r in found]).reshape(-1, 8)
    wanted = centred @ axes[:, :8] / np.sqrt(values[:8])
    assert np.allclose(white * np.sign((white * wanted).sum(axis=0)), wanted, atol=1e-9)
    assert np.allclose([r.explained for r in found[:8]], values[:8] / values.sum(), rtol=1e-12)
    assert len({r.identity_error for r in found}) == 1 and found[0].identity_error < 1e-9


@pytest.mark.parametrize("size", [1, 2, 3, 7, 40, 150])
@pytest.mark.parametrize("kind", ["random", "graded", "reversed", "clustered", "rank"])
def test_solver(size, kind):
    rng = np.random.default_rng(size)
    scale = {
        "random": np.ones(size), "graded": np.logspace(0, -9, size), "reversed": np.logspace(-9, 0, size),
        "clustered": 1 + 1e-13 * np.arange(size), "rank": np.arange(size) % 2 + (size == 1),
    }[kind]
    u, v = (np.linalg.qr(rng.standard_normal((size, size)))[0] for _ in "uv")
    square = rng.standard_normal((size, size)) * scale if kind == "random" else (u * scale) @ v.T
    square = np.linalg.qr(square, mode="r")
    values, vectors = whitening.directions(square, 8)
    assert np.allclose(np.sqrt(np.maximum(values, 0)), np.linalg.svd(square)[1], atol=1e-13 * np.sqrt(values[0]))
    assert np.abs(vectors.T @ vectors - np.eye(vectors.shape[1])).max() < 1e-12
    assert np.abs(square.T @ (square @ vectors) - vectors * values[: vectors.shape[1]]).max() < 1e-11 * values[0]


def test_small_values_of_a_bidiagonal_matrix_are_accurate():
    """A graded matrix whose least value a plain method loses altogether."""
    diagonal, upper = np.logspace(0, -14, 15), np.logspace(0, -14, 15)[:-1]
    values = whitening.squared_singular_values(diagonal, upper)
    product = float(np.prod(np.sqrt(values) / np.sort(diagonal)[::-1]))
    assert product == pytest.approx(1.0, rel=1e-12)  # the determinant


def test_odd_rows(spark):
    rng = np.random.default_rng(1)
    good = [(i if i else None, [float(c) for c in rng.integers(-4, 5, 3)], 1) for i in range(40)] + [(5, [1.0, 2.0, 3.0], 1)] * 2
    bad = [(100, None, 1), (101, [], 1), (102, [1.0, None, 2.0], 1), (103, [1.0, float("nan"), 0.0], 1), (104, [float("inf"), 0.0, 0.0], 1), (105, [1.0, 2.0], 1)]
    rows = spark.createDataFrame(good + bad, "vec_id long, embedding array<float>, id int").repartition(3)
    rows = rows.withColumns({c: F.lit(c) for c in ("v", "n", "deviation", "whitened")})
    found = whitening.whiten(rows).collect()
    deviation, centred, values, axes = expected([v for _, v, _ in good])
    assert sorted((str(r.id), r.deviation) for r in found) == sorted((str(g[0]), int(d)) for g, d in zip(good, deviation))
    assert {len(r.whitened) for r in found} == {3} and found[0].identity_error < 1e-9
    for empty in (rows.limit(0), rows.where("vec_id = 5 AND embedding[0] = 1 AND embedding[1] = 2"), rows.where("vec_id >= 100")):
        assert whitening.whiten(empty.where("size(embedding) <> 2")).collect() == []


def test_sums_beyond_64_bits(spark):
    rows = spark.createDataFrame([(i, [1e30 * (-1) ** i, float(i)]) for i in range(200)], "vec_id long, embedding array<float>")
    found = whitening.whiten(rows).collect()
    assert len(found) == 200 and {r.deviation for r in found} == {None} and {len(r.whitened) for r in found} == {1}
    assert {round(abs(r.whitened[0]), 6) for r in found} == {1.0}
