import math

import numpy as np
import pytest

from ledgerloom.llm import whitening
from ledgerloom.session import load


def brute(rows, components=16):
    """The contract's words, in integers of any size and numpy."""
    good = [(i, [math.floor(64 * float(c)) + 1_000_000 for c in v]) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    fit = sorted({tuple(x) for _, x in good})
    n, dims = len(fit), len(fit[0])
    sums = [sum(x[k] for x in fit) for k in range(dims)]
    away = np.array([[(n * c - s) / n for c, s in zip(x, sums)] for x in fit])
    covariance = away.T @ away / n
    values, vectors = np.linalg.eigh(covariance)
    values, vectors = values[::-1], vectors[:, ::-1]
    out = []
    for i, x in good:
        exact = [n * c - s for c, s in zip(x, sums)]
        z = (np.array(exact) / n) @ vectors
        for k in range(min(components, dims)):
            varies = values[k] > 1e-9 * max(values[0], 1e-300)
            out.append((i, k + 1, n, sum(d * d for d in exact), z[k] / math.sqrt(values[k]) if varies else None, values[k] / np.trace(covariance) if values[0] > 0 else None))
    return out


def check(got, want):
    """Equal up to the sign of each component."""
    got = sorted(got, key=lambda r: (r.component, r.deviation, repr(r.vec_id)))
    want = sorted(want, key=lambda r: (r[1], r[3], repr(r[0])))
    assert [(r.vec_id, r.component, r.n, r.deviation) for r in got] == [r[:4] for r in want]
    assert all(r.deviation_exact == r.deviation for r in got)
    for component in {r.component for r in got}:
        a = [r.whitened for r in got if r.component == component]
        b = [w[4] for w in want if w[1] == component]
        if b[0] is None:
            assert set(a) == {None}
            continue
        k = int(np.argmax(np.abs(b)))
        sign = np.sign(a[k] * b[k])
        assert np.allclose(np.array(a) * sign, b, atol=1e-6, rtol=1e-6)
    for r, w in zip(got, want):
        assert (r.explained is None) == (w[5] is None) and (w[5] is None or r.explained == pytest.approx(w[5], rel=1e-6))


def test_equals_numpy_on_embeddings(spark):
    table = load(spark, "/root/testdata/sf0.001", "embeddings")
    got = whitening.whiten(table).collect()
    check(got, brute([(r.vec_id, r.embedding) for r in table.collect()]))
    assert len({r.identity_error for r in got}) == 1 and got[0].identity_error < 1e-9
    assert [r.explained for r in got[:1]][0] <= 1


def rows_of(seed, n, dims):
    rng = np.random.default_rng(seed)
    return [(k, [float(c) for c in rng.normal(size=dims) * np.arange(1, dims + 1)]) for k in range(n)]


def test_copies_nulls_and_clashing_columns(spark):
    rows = rows_of(1, 60, 5)
    rows += [(100 + k, rows[3][1]) for k in range(40)] + [(0, rows[0][1]), (None, rows[1][1]), (200, None), (201, [1.0, None, 1.0, 1.0, 1.0]), (202, [float("nan")] * 5), (203, [float("inf"), 0.0, 0.0, 0.0, 0.0])]
    table = spark.createDataFrame([(i, v, 1, 2.0, "x") for i, v in rows], "vec_id long, embedding array<double>, component int, whitened double, x string")
    got = whitening.whiten(table).collect()
    check(got, brute(rows))
    assert {r.n for r in got} == {60} and len(got) == 102 * 5


def test_without_variance_and_with_fewer_rows_than_dimensions(spark):
    rows = [(1, [1.0, 2.0, 3.0]), (2, [2.0, 2.0, 3.0])]
    got = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    check(got, brute(rows))
    assert {r.component: r.whitened is None for r in got} == {1: False, 2: True, 3: True} and got[0].identity_error < 1e-9
    one = whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], "vec_id long, embedding array<float>")).collect()
    assert [(r.vec_id, r.component, r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in sorted(one)] == [(i, c, 1, 0, None, None, None) for i in (1, 2) for c in (1, 2)]


def test_lengths_are_fitted_apart_and_empty_gives_nothing(spark):
    short, long = rows_of(2, 30, 3), [(50 + k, v) for k, v in rows_of(3, 40, 4)]
    got = whitening.whiten(spark.createDataFrame([*short, *long, (99, [])], "vec_id long, embedding array<double>")).collect()
    check([r for r in got if r.vec_id < 50], brute(short))
    check([r for r in got if r.vec_id >= 50], brute(long))
    assert 99 not in {r.vec_id for r in got}
    for table in ([], [(1, None)]):
        none = whitening.whiten(spark.createDataFrame(table, "vec_id long, embedding array<double>"))
        assert none.collect() == [] and none.columns == whitening.whiten(spark.createDataFrame(short, "vec_id long, embedding array<double>")).columns


def test_a_deviation_beyond_64_bits_is_null_and_told_exactly(spark):
    rows = [(1, [1e8, 0.0]), (2, [-1e8, 1.0]), (3, [0.0, 5.0])]
    got = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    want = {r[0]: r[3] for r in brute(rows)}
    assert {r.vec_id: int(r.deviation_exact) for r in got} == want
    assert all(r.deviation == (want[r.vec_id] if want[r.vec_id] < 2**63 else None) for r in got)
    assert any(r.deviation is None for r in got)


def test_a_wide_triangle_is_summed_in_parts(spark):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([(v,) for _, v in rows_of(5, 40, 6)], "v array<double>")
    values = np.array([v for _, v in rows_of(5, 40, 6)])
    for most in (4000, 4):
        assert np.allclose(whitening.pair_sums(rows, F.col("v"), 6, most), values.T @ values)
