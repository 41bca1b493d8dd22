"""Whitening against a dense eigensolver and exact integers, and its behaviour on odd input."""

import math

import numpy as np
import pytest

from docweave.llm import whitening as w
from tests.conftest import DATA


def expected(rows, k=4):
    """(vec_id, x) -> n, deviation by row, whitened up to sign, explained."""
    x = [[math.floor(256 * float(c)) for c in v] for _, v in rows]
    fit = sorted(set(map(tuple, x)))
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    centred = np.array([[(n * c - s) / n for c, s in zip(v, sums)] for v in fit])
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    top = np.argsort(-values)[:k]
    out = [np.array([(n * c - s) / n for c, s in zip(v, sums)]) @ vectors[:, top] / np.sqrt(values[top]) for v in x]
    return n, [sum((n * c - s) ** 2 for c, s in zip(v, sums)) for v in x], np.array(out), values[top] / values.sum()


def table(spark, rows, folder, kind="float"):
    spark.createDataFrame([(*r, 1, 2, "k") for r in rows], f"vec_id long, embedding array<{kind}>, x int, n int, key string").write.parquet(f"{folder}/embeddings.parquet")
    return w.op12_whitening(spark, str(folder))


def compare(found, rows, k=4):
    n, deviation, white, explained = expected(rows, k)
    by = {(r["vec_id"], r["component"]): r for r in found}
    assert len(by) == len(found) == len(rows) * k
    for j in range(k):
        got = np.array([by[v, j + 1]["whitened"] for v, _ in rows])
        sign = np.sign(got @ white[:, j])
        assert np.allclose(got, sign * white[:, j], rtol=1e-8, atol=1e-8)
    for i, (v, _) in enumerate(rows):
        for j in range(k):
            r = by[v, j + 1]
            assert (r["n"], r["deviation"]) == (n, deviation[i]) and r["explained"] == pytest.approx(explained[j], rel=1e-9) and r["identity_error"] < 1e-9


def test_query(spark):
    folder = DATA / "sf0.001"
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
    compare(w.op12_whitening(spark, str(folder)).collect(), rows)


def test_odd_rows(spark, tmp_path):
    draw = np.random.default_rng(5)
    good = [(k, (draw.normal(size=6) * [5, 3, 2, 1, 0.5, 0.1] + 40).tolist()) for k in range(300)]
    good += [(1000 + k, good[k % 7][1]) for k in range(200)]  # copies count once
    good += [(5000, [-0.0, 0.0, 1e-9, -1e-9, 0.001, 2.0])]
    bad = [(6000, None), (6001, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (6002, [math.nan] * 6), (6003, [math.inf, *[0.0] * 5]), (6004, []), (6005, [1.0, 2.0])]
    found = table(spark, good + bad, tmp_path, "double").collect()
    compare(found, good)
    again = table(spark, [*good, *good[:3], (None, good[0][1])], tmp_path / "again", "double").collect()
    assert sum(r["vec_id"] is None for r in again) == 4 and len(again) == 4 * (len(good) + 4)


def test_fewer_components_than_four(spark, tmp_path):
    rows = [(k, [k / 16, 3.0, -k / 8]) for k in range(20)]
    found = table(spark, rows, tmp_path).collect()
    compare(found, rows, 1)
    assert {r["component"] for r in found} == {1} and found[0]["explained"] == pytest.approx(1)


@pytest.mark.parametrize("rows", [[], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])], [(1, None), (2, [])]])
def test_nothing_to_whiten(spark, tmp_path, rows):
    assert table(spark, rows, tmp_path).collect() == []


def test_exact_beyond_long(spark):
    """Entries near the ends of long: sums and deviations stay exact, and what doesn't fit into the query's long is null."""
    rows = [(1, [2.0**50, -(2.0**54)]), (2, [-(2.0**50), 3.0]), (3, [1e30, 5.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = {r["vec_id"]: r for r in w.whiten(df).collect()}
    x = [[max(-(2**63), min(2**63 - 1, math.floor(256 * c))) for c in v] for _, v in rows]
    sums = [sum(c) for c in zip(*x)]
    assert [int(found[k]["deviation"]) if found[k]["deviation"] is not None else None for k in (1, 2, 3)] == [e if (e := sum((3 * c - s) ** 2 for c, s in zip(v, sums))) < 10**38 else None for v in x]


@pytest.mark.parametrize("d", [1, 2, 5, 40])
def test_eigen(d):
    draw = np.random.default_rng(d)
    basis, _ = np.linalg.qr(draw.normal(size=(d, d)))
    values = 10.0 ** np.linspace(6, -4, d)
    matrix = (basis * values) @ basis.T
    found, vectors = w.eigen((matrix + matrix.T) / 2)
    assert np.allclose(found, values, rtol=1e-6) and np.allclose(vectors @ vectors.T, np.eye(d), atol=1e-12)
    factor, order = w.pivoted_cholesky(matrix)
    assert np.allclose(factor @ factor.T, matrix[np.ix_(order, order)]) and np.allclose(factor, np.tril(factor)) and (np.diff(factor.diagonal()) <= 1e-12 * factor[0, 0]).all()


def test_rank():
    tall = np.random.default_rng(0).normal(size=(7, 3))
    values, vectors = w.eigen(tall @ tall.T)
    assert len(values) == 3 and np.allclose((vectors.T * values) @ vectors, tall @ tall.T)
    assert len(w.eigen(np.zeros((4, 4)))[0]) == 0
    equal, axes = w.eigen(np.eye(5) * 3)
    assert np.allclose(equal, 3) and np.allclose(axes @ axes.T, np.eye(5))
