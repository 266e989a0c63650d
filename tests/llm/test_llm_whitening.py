"""Divide and conquer against numpy's solver, whitening against one numpy array."""

from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from pairscope.llm import whitening
from pairscope.llm.qdwh import leading_components, polar_factor

_Q, _ = np.linalg.qr(np.random.default_rng(3).standard_normal((30, 30)))
SPECTRA = {
    "falling": 10.0 ** -np.arange(30), "clusters": np.repeat([5.0, 1.0, 0.0], 10), "near": 1 + 1e-9 * np.arange(30),
    "one large": np.r_[1e8, np.ones(29)], "equal": np.ones(30), "none": np.zeros(30)}


@pytest.mark.parametrize("name", SPECTRA)
@pytest.mark.parametrize("wanted", [1, 7, 30])
def test_components_of_given_spectra(name, wanted):
    a = _Q @ np.diag(SPECTRA[name]) @ _Q.T
    values, vectors = leading_components((a + a.T) / 2, wanted)
    scale = max(SPECTRA[name].max(), 1e-300)
    assert np.abs(values - np.sort(SPECTRA[name])[::-1][:wanted]).max() <= 1e-13 * scale
    assert np.linalg.norm(vectors.T @ vectors - np.eye(wanted)) < 1e-12
    assert np.linalg.norm(a @ vectors - vectors * values) <= 1e-12 * scale


@given(st.integers(1, 12), st.integers(0, 10_000))
@settings(max_examples=60, deadline=None)
def test_components_of_random_matrices(d, seed):
    a = np.random.default_rng(seed).standard_normal((d, d + 2))
    values, _ = leading_components(a @ a.T, d)
    assert np.allclose(values, np.linalg.eigvalsh(a @ a.T)[::-1], rtol=1e-10, atol=1e-12)
    u = polar_factor(a @ a.T - np.eye(d))
    assert np.allclose(u @ u, np.eye(d), atol=1e-9)


def expected(rows, components=32):
    kept = [(i, v) for i, v in rows if v and all(c is not None and np.isfinite(c) for c in v)]
    sizes = [len(v) for _, v in kept]
    d = max(set(sizes), key=lambda s: (sizes.count(s), s))
    kept = [(i, v) for i, v in kept if len(v) == d]
    x = np.array([[int(np.floor(64 * float(c))) + 1_000_000 for c in v] for _, v in kept], dtype=object)
    n, s = len(x), x.sum(axis=0)
    centred = np.array([[float(Fraction(n * c - t, n)) for c, t in zip(row, s)] for row in x])
    v = centred.T @ centred / n
    values, vectors = np.linalg.eigh(v)
    real = values > 1e-12 * values.max()
    values, vectors = values[real][::-1][:components], vectors[:, real][:, ::-1][:, :components]
    deviation = [int(sum((n * c - t) ** 2 for c, t in zip(row, s))) for row in x]
    return kept, n, deviation, centred @ vectors / np.sqrt(values), values / np.trace(v)


def compare(table, rows, **more):
    kept, n, deviation, white, explained = expected(rows, **more)
    found = table.orderBy("vec_id", "component").collect()
    order = sorted(range(len(kept)), key=lambda k: kept[k][0])
    k = white.shape[1]
    assert len(found) == len(kept) * k
    got = np.array([r["whitened"] for r in found]).reshape(-1, k)
    assert [r["vec_id"] for r in found] == [kept[a][0] for a in order for _ in range(k)]
    assert [r["component"] for r in found[:k]] == list(range(1, k + 1))
    assert [r["deviation"] for r in found[::k]] == [deviation[a] for a in order] and {r["n"] for r in found} == {n}
    want = white[order]
    signs = np.sign((got * want).sum(axis=0))
    assert np.allclose(got, want * signs, atol=1e-8)
    assert np.allclose([r["explained"] for r in found[:k]], explained, rtol=1e-9)
    assert max(r["identity_error"] for r in found) < 1e-9
    assert np.abs(got.T @ got / n - np.eye(k)).max() < 1e-9


def test_whitening_of_odd_vectors(spark):
    rng = np.random.default_rng(5)
    rows = [(k, [float(c) for c in rng.normal(0.1, 1 + np.arange(6))]) for k in range(300)]
    rows += [(400, None), (401, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (402, [float("nan")] * 6), (403, [float("inf")] + [0.0] * 5), (404, []),
             (405, [1.0, 2.0]), (406, [9000.0, -9000.0, 0.0, 0.0, 1.0, 2.0]), (407, rows[3][1])]
    table = spark.createDataFrame([(i, v, 7, "clash") for i, v in rows], "vec_id bigint, embedding array<double>, n int, component string")
    compare(whitening.whiten(table), rows)
    compare(whitening.whiten(table.repartition(7), components=2), rows, components=2)
    again = whitening.whiten(spark.createDataFrame([(None, rows[0][1]), (1, rows[1][1]), (1, rows[1][1])], "vec_id bigint, embedding array<double>"))
    assert sorted(str(r["vec_id"]) for r in again.collect()) == ["1", "1", "None"]


def test_whitening_without_variance_or_vectors(spark):
    schema = "vec_id bigint, embedding array<float>"
    for rows in ([], [(1, None)], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])]):
        found = whitening.whiten(spark.createDataFrame(rows, schema))
        assert found.collect() == [] and len(found.columns) == 7
    flat = whitening.whiten(spark.createDataFrame([(k, [float(k), 3.0, -2.0 * k]) for k in range(9)], schema)).collect()
    assert {r["component"] for r in flat} == {1} and flat[0]["explained"] == pytest.approx(1.0)
    with pytest.raises(Exception, match="out of the range"):
        whitening.whiten(spark.createDataFrame([(1, [1e30]), (2, [0.0])], schema)).collect()


def test_query_over_the_smallest_table(spark):
    from pairscope.llm.queries import op11_embedding_whitening

    table = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    compare(op11_embedding_whitening(spark, "/root/testdata/sf0.001"), [(r["vec_id"], r["embedding"]) for r in table.collect()])
