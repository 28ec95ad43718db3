"""Whitening against exact fractions and a plain eigendecomposition; odd vectors and large numbers."""

from __future__ import annotations

import math
import random
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest

from scholarmatch.llm import whitening as wh
from scholarmatch.llm.queries import op12_whitening

SHAPE = "vec_id long, embedding array<double>, n int, w string, entry int"


def table(spark, vectors, ids=None):
    ids = range(len(vectors)) if ids is None else ids
    return spark.createDataFrame([(i, v, 1, "x", 2) for i, v in zip(ids, vectors)], SHAPE)


def whole(vectors):
    return [[math.floor(Fraction(c) * 1024) + 100_000 for c in v] for v in vectors]


def plain(vectors):
    """n, covariance and deviations in exact fractions."""
    x = whole(vectors)
    n, dims = len(x), len(x[0])
    sums = [sum(r[d] for r in x) for d in range(dims)]
    z = [[n * r[d] - sums[d] for d in range(dims)] for r in x]
    matrix = [[Fraction(sum(r[i] * r[j] for r in z), n**3) for j in range(dims)] for i in range(dims)]
    return n, sums, matrix, [sum(c * c for c in r) for r in z]


def check(rows, vectors, ids=None, tolerance=1e-9):
    n, sums, matrix, deviations = plain(vectors)
    ids = list(range(len(vectors))) if ids is None else ids
    dims = len(sums)
    shown = min(8, dims)
    assert len(rows) == len(vectors) * shown and {r.n for r in rows} == {n}
    assert Counter((r.vec_id, int(r.deviation)) for r in rows) == Counter({k: v * shown for k, v in Counter(zip(ids, deviations)).items()})
    values, axes = np.linalg.eigh(np.array(matrix, float))
    values, axes = values[::-1], axes[:, ::-1]
    trace = float(sum(matrix[d][d] for d in range(dims)))
    centred = np.array([[float(Fraction(x) - Fraction(s, n)) for x, s in zip(r, sums)] for r in whole(vectors)])
    for k in range(shown):
        mine = [r for r in rows if r.component == k + 1]
        assert all(abs(r.explained - values[k] / trace) <= 1e-4 * values[k] / trace + 1e-15 for r in mine)
        if values[k] <= dims * 2.3e-16 * values[0]:
            assert all(r.whitened is None for r in mine)
            continue
        want = centred @ axes[:, k] / math.sqrt(values[k])
        got = np.array([dict((r.vec_id, r.whitened) for r in mine)[i] for i in ids])
        assert min(np.abs(got - want).max(), np.abs(got + want).max()) < tolerance
    assert all(r.identity_error < 1e-4 for r in rows)


def test_equals_exact_fractions_and_a_plain_eigendecomposition(spark):
    rng = random.Random(1)
    vectors = [[rng.gauss(m, s) for m, s in ((0, 1), (5, 0.2), (-40, 3), (0, 9), (1e3, 2))] for _ in range(80)]
    check(wh.whiten(table(spark, vectors).repartition(5)).collect(), vectors)


def test_the_table_whole(spark):
    rows = op12_whitening(spark, "/root/testdata/sf0.001").collect()
    vectors = {r.vec_id: [float(c) for c in r.embedding] for r in spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").collect()}
    check(rows, list(vectors.values()), list(vectors), 1e-7)


def test_odd_vectors_are_dropped_and_repeated_rows_stay(spark):
    good = [[1.0, 2.0], [3.0, -1.0], [0.5, 0.25], [0.5, 0.25], [-7.0, 2.5]]
    odd = [None, [], [1.0], [1.0, None], [float("nan"), 1.0], [1.0, float("inf")], [1.0, 2.0, 3.0], [1e300, 0.0]]
    ids = [3, 4, 5, 5, None]
    df = table(spark, good + odd, ids + [100 + i for i in range(len(odd))])
    rows = wh.whiten(df).collect()
    assert Counter(r.vec_id for r in rows) == Counter({3: 2, 4: 2, 5: 4, None: 2})
    n, sums, matrix, deviations = plain(good)
    assert Counter((r.vec_id, int(r.deviation)) for r in rows) == Counter({k: 2 * v for k, v in Counter(zip(ids, deviations)).items()})


@pytest.mark.parametrize("vectors", [[], [None, [], [None]]])
def test_tables_without_vectors(spark, vectors):
    rows = wh.whiten(table(spark, vectors))
    assert rows.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"] and rows.collect() == []


def test_components_without_variance(spark):
    rows = wh.whiten(table(spark, [[2.0, 5.0]] * 3)).collect()
    assert len(rows) == 6 and all(r.whitened is None and r.explained == 0 and r.deviation == 0 and r.identity_error == 0 for r in rows)
    line = [[float(i), 4.0, 4.0] for i in range(9)]
    check(wh.whiten(table(spark, line)).collect(), line)
    assert len(wh.whiten(table(spark, [[1.0, 2.0]])).collect()) == 2


def test_ties_of_vector_lengths_go_to_the_longest(spark):
    rows = wh.whiten(table(spark, [[1.0], [2.0], [1.0, 2.0], [3.0, 5.0]])).collect()
    assert {r.vec_id for r in rows} == {2, 3}


def test_large_entries_are_added_exactly(spark):
    rng = random.Random(2)
    vectors = [[rng.uniform(-1, 1) * 1e15, rng.uniform(-1, 1) * 1e15, rng.uniform(-1, 1) * 1e14] for _ in range(20)]
    n, sums, matrix, deviations = plain(vectors)
    rows = wh.whiten(table(spark, vectors)).collect()
    assert all((None if d >= 10**38 else d) == (None if r.deviation is None else int(r.deviation)) for r, d in zip(sorted((r for r in rows if r.component == 1), key=lambda r: r.vec_id), deviations))
    assert all(r.identity_error < 1e-4 for r in rows)


def test_square_sums_and_limbs_are_exact(monkeypatch):
    monkeypatch.setattr(wh, "BLOCK", 3)
    rng = random.Random(3)
    for size in (5, 1 << 20, 1 << 40, 1 << 61):
        rows = np.array([[rng.randrange(-size, size) for _ in range(4)] for _ in range(10)], np.int64)
        want = [sum(int(r[i]) ** 2 if i == j else (int(r[i]) + int(r[j])) ** 2 for r in rows) for i, j in wh.entries(4)]
        assert wh.square_sums(rows).tolist() == want
        assert wh._column_sums(rows).tolist() == [sum(int(r[d]) for r in rows) for d in range(4)]
    for value in (0, 1, -1, 10**45, -(10**45), (1 << 34) - 1):
        parts = [sum(p) for p in zip(*[wh._limbs(value)] * 7)]
        assert wh._from_limbs(parts) == 7 * value


def test_more_dimensions_than_the_matrix_holds_are_refused(spark, monkeypatch):
    monkeypatch.setattr(wh, "MAX_DIMS", 3)
    with pytest.raises(ValueError, match="at most 3"):
        wh.whiten(table(spark, [[1.0] * 4]))
