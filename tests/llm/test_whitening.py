"""Whitening against numpy's own decomposition, and exact figures."""
import math

import numpy as np
import pytest

from decisionlake.llm import whitening
from tests.llm.conftest import SF

KIND = "vec_id long, embedding array<float>, n string"


def plain(rows, k=8):
    x = np.array([[math.floor(1024 * float(c)) + 100_000 for c in e] for _, e in rows])
    n, s = len(x), x.sum(axis=0)
    centred = x - s / n
    v = centred.T @ centred / n
    values, vectors = np.linalg.eigh(v)
    values, vectors = values[::-1], vectors[:, ::-1]
    deviation = [sum((n * int(a) - int(b)) ** 2 for a, b in zip(row, s)) for row in x]
    return centred @ vectors[:, :k] / np.sqrt(values[:k]), values / np.trace(v), deviation


def check(found, rows, k=8):
    white, explained, deviation = plain(rows, k)
    at = {i: p for p, (i, _) in enumerate(rows)}
    got = np.full(white.shape, np.nan)
    for r in found:
        got[at[r.vec_id], r.component - 1] = r.whitened
        assert r.n == len(rows) and r.deviation == deviation[at[r.vec_id]]
        assert abs(r.explained / explained[r.component - 1] - 1) < 1e-9 and r.identity_error < 1e-9
    assert np.abs(got * np.sign((got * white).sum(axis=0)) - white).max() < 1e-8


def test_sample_equals_plain_decomposition(spark):
    table = spark.read.parquet(f"{SF}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in table.collect()]
    check(whitening.components_of(table.repartition(5)).collect(), rows)


@pytest.mark.parametrize("spectrum", [[5.0] * 9 + [3.0] * 9 + [0.0] * 9, [1.0] * 20, [0.0] * 12, list(10.0 ** -np.arange(25)), [1e6] + [1.0] * 30, [-3.0, 2.0, 2.0, 0.5]])
def test_divide_and_conquer_on_hard_spectra(spectrum):
    n = len(spectrum)
    q, _ = np.linalg.qr(np.random.default_rng(n).standard_normal((n, n)))
    a = q * np.array(spectrum) @ q.T
    a = (a + a.T) / 2
    values, vectors = whitening.eigh(a)
    top = max(map(abs, spectrum))
    assert np.allclose(values, sorted(spectrum, reverse=True), rtol=0, atol=1e-13 * top)
    assert np.abs(vectors.T @ vectors - np.eye(n)).max() < 1e-11 and np.abs(a @ vectors - vectors * values).max() <= 1e-13 * top


def test_polar_factor_is_the_matrix_sign():
    a = np.diag([3.0, -1e-9, 1e-6, -2.0])
    assert np.abs(whitening.polar(a) - np.diag([1, -1, 1, -1])).max() < 1e-12


def test_rows_that_go_and_small_tables(spark):
    rng = np.random.default_rng(3)
    good = [(i, rng.standard_normal(5).tolist()) for i in range(40)]
    bad = [(100, None), (101, [1.0, None, 2.0, 3.0, 4.0]), (102, [float("nan")] * 5), (103, [float("inf"), 0.0, 0.0, 0.0, 0.0]), (104, []), (105, [1.0, 2.0]), (106, [1e20] * 5)]
    table = spark.createDataFrame([(*r, "x") for r in good + bad], KIND)
    rows = [(r.vec_id, r.embedding) for r in table.where("vec_id < 100").collect()]
    found = whitening.components_of(table).collect()
    assert len(found) == 40 * 5
    check(found, rows, 5)
    for few in ([], bad, good[:1], [(1, [2.0] * 4), (2, [2.0] * 4)], [(1, [])]):
        assert whitening.components_of(spark.createDataFrame([(*r, "x") for r in few], KIND)).collect() == []
    two = whitening.components_of(spark.createDataFrame([(None, [0.0, 1.0], "x"), (7, [0.0, 2.0], "x"), (7, [0.0, 2.0], "x")], KIND)).collect()
    assert len(two) == 3 and {r.component for r in two} == {1}


def test_deviation_is_exact_beyond_a_long(spark):
    rows = [(i, [float(i * (1 << 20))] * 3) for i in range(-50, 50)]
    table = spark.createDataFrame([(*r, "x") for r in rows], KIND)
    stay = whitening.vectors(table)
    found = {r.vec_id: r.deviation for r in whitening.whiten(stay, whitening.fit(stay)).collect()}
    assert {i: int(d) for i, d in found.items()} == dict(zip([i for i, _ in rows], plain(rows, 1)[2]))
    assert all(r.deviation is None or r.deviation == found[r.vec_id] for r in whitening.components_of(table).collect())
