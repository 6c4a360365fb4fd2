"""Whitening against a dense eigendecomposition in numpy, and exact integers."""

import numpy as np
import pytest

from fleetpulse.llm import whitening


def frame(spark, vectors):
    rows = [(i, v, "k", 1.0) for i, v in enumerate(vectors)]
    schema = "vec_id long, embedding array<float>, component string, whitened double"
    return spark.createDataFrame(rows, schema).repartition(3)


def direct(vectors, k):
    c = np.array(vectors, np.float32).astype(np.float64)
    x = np.floor(1024 * c).astype(np.int64) + 100_000
    n, sums = len(x), x.sum(0)
    values, axes = np.linalg.eigh(np.cov((x - sums / n).T, bias=True).reshape(x.shape[1], -1))
    return x, sums, values[::-1][:k], axes.T[::-1][:k]


def check(spark, vectors, k=8, rank=8, kept=None):
    kept = list(range(len(vectors))) if kept is None else kept
    x, sums, values, axes = direct([vectors[i] for i in kept], k)
    rows = whitening.whiten(frame(spark, vectors), k).collect()
    assert len(rows) == len(kept) * rank
    n, trace = len(kept), np.square(x - sums / len(kept)).sum() / len(kept)
    place = {v: i for i, v in enumerate(kept)}
    scores = np.zeros((n, rank))
    for row in rows:
        i = place[row.vec_id]
        exact = sum((n * int(c) - int(s)) ** 2 for c, s in zip(x[i], sums, strict=True))
        assert row.n == n and row.deviation == (exact if exact < 2**63 else None)
        assert row.explained == pytest.approx(values[row.component - 1] / trace, rel=1e-9)
        assert row.identity_error < 1e-9
        scores[i, row.component - 1] = row.whitened
    return scores, (x - sums / n) @ axes[:rank].T / np.sqrt(values[:rank])


def test_components_equal_a_dense_eigendecomposition(spark):
    pick = np.random.default_rng(1)
    vectors = (pick.standard_normal((700, 24)) * np.linspace(3, 0.1, 24) + 5).tolist()
    found, wanted = check(spark, vectors)
    signs = np.sign((found * wanted).sum(0))
    assert np.abs(found * signs - wanted).max() < 1e-9


def test_close_values_and_few_dimensions(spark):
    pick = np.random.default_rng(2)
    found, wanted = check(spark, pick.standard_normal((300, 5)).tolist(), rank=5)
    assert np.abs(np.abs(found) - np.abs(wanted)).max() < 1e-8


def test_exactly_equal_eigenvalues_are_all_found(spark):
    # Rows ±e_i: all directions but one have the same variance.
    eye = np.eye(12)
    vectors = np.vstack([eye, -eye, 2 * eye[:1], -2 * eye[:1]]).tolist()
    found, _ = check(spark, vectors)
    assert np.abs(found.T @ found / len(found) - np.eye(8)).max() < 1e-9


def test_flat_directions_are_left_out(spark):
    pick = np.random.default_rng(3)
    base = pick.integers(-50, 50, (200, 3)).astype(float)
    vectors = np.hstack([base, base[:, :1], np.zeros((200, 4))]).tolist()
    check(spark, vectors, rank=3)


def test_odd_rows_are_dropped_and_others_kept(spark):
    pick = np.random.default_rng(4)
    vectors = pick.standard_normal((60, 6)).tolist()
    vectors[3], vectors[7], vectors[9] = None, [1.0, None, 0.0, 0.0, 0.0, 0.0], [float("nan")] * 6
    vectors[11], vectors[13], vectors[15] = [float("inf")] + [0.0] * 5, [], [1.0] * 4
    vectors[20] = vectors[21]
    kept = [i for i in range(60) if i not in (3, 7, 9, 11, 13, 15)]
    check(spark, vectors, rank=6, kept=kept)


def test_tables_without_variance_give_no_rows(spark):
    for vectors in ([], [None], [[]], [[1.0, 2.0]], [[1.0, 2.0]] * 5):
        assert whitening.whiten(frame(spark, vectors)).collect() == []


def test_deviations_beyond_a_long_are_null():
    x = np.array([[2**40, 5], [6, 5]])
    sums = x.sum(0).tolist()
    found = whitening._deviations(x, 2, sums)
    assert found == [None, None]
    assert whitening._deviations(np.array([[2**29, 0], [0, 0]]), 2, [2**29, 0]) == [2**58, 2**58]


def test_partial_sums_of_many_tasks_are_added_by_tasks(spark, monkeypatch):
    monkeypatch.setattr(whitening, "AT_ONCE", 3)
    pick = np.random.default_rng(5)
    vectors = pick.standard_normal((90, 4)).tolist()
    written = whitening.blocks(frame(spark, vectors).repartition(13))
    total = whitening.Rows(written).summed(lambda x: x.sum(0), np.int64)
    assert total.tolist() == direct(vectors, 4)[1].tolist()


def test_whole_table_at_double_precision(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    held = {r.vec_id: r.embedding for r in rows.collect()}
    ids = sorted(held)
    x, sums, values, axes = direct([held[i] for i in ids], 8)
    wanted = (x - sums / len(x)) @ axes.T / np.sqrt(values)
    found = np.zeros_like(wanted)
    place = {v: i for i, v in enumerate(ids)}
    for row in whitening.whiten(rows).collect():
        found[place[row.vec_id], row.component - 1] = row.whitened
    signs = np.sign((found * wanted).sum(0))
    assert np.abs(found * signs - wanted).max() < 1e-8
