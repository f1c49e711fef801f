"""Whitening against a direct computation, and the edge cases that the docstring defines."""

import math
import sys
from fractions import Fraction
from pathlib import Path

import numpy as np
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

from cloakframe.llm import whitening as wh  # noqa: E402

SCHEMA = "vec_id long, x array<long>"


def exact_covariance(rows):
    n, dim = len(rows), len(rows[0])
    mean = [Fraction(sum(r[a] for r in rows), n) for a in range(dim)]
    return [[sum((r[a] - mean[a]) * (r[b] - mean[b]) for r in rows) / n for b in range(dim)] for a in range(dim)]


def check(spark, rows, k=wh.COMPONENTS):
    """All results of one length against numpy on the whole matrix."""
    out = wh.whiten(spark.createDataFrame(list(enumerate(rows)), SCHEMA).repartition(3), components=k).collect()
    n, dim = len(rows), len(rows[0])
    cov = np.array([[float(c) for c in r] for r in exact_covariance(rows)])
    values = np.linalg.eigvalsh(cov)[::-1]
    assert len(out) == n * min(k, dim) and {r.n for r in out} == {n}
    sums = [sum(r[a] for r in rows) for a in range(dim)]
    centred = np.array([[float(Fraction(n * v - s, n)) for v, s in zip(r, sums, strict=True)] for r in rows])
    for r in out:
        assert r.deviation == sum((n * v - s) ** 2 for v, s in zip(rows[r.vec_id], sums, strict=True))
        assert math.isclose(r.explained, values[r.component - 1] / np.trace(cov), rel_tol=1e-6, abs_tol=1e-14)
    table = np.full((n, min(k, dim)), np.nan)
    for r in out:
        table[r.vec_id, r.component - 1] = np.nan if r.whitened is None else r.whitened
    real = ~np.isnan(table[0])
    assert (np.isnan(table) == ~real).all()
    got = table[:, real]
    assert np.abs(got.T @ got / n - np.eye(got.shape[1])).max() < 1e-6
    # each column is the projection on a unit eigenvector: cov @ v = e * v
    vectors = np.linalg.lstsq(centred, got * np.sqrt(values[: table.shape[1]][real]), rcond=None)[0]
    assert np.abs(cov @ vectors - vectors * values[: table.shape[1]][real]).max() < 1e-6 * values[0]
    assert {r.identity_error for r in out} == {out[0].identity_error} and out[0].identity_error < 1e-6
    return out, real


def data(n, dim, seed, scale=30):
    rng = np.random.default_rng(seed)
    return (1_000_000 + rng.normal(0, scale, (n, dim)) @ rng.normal(0, 1, (dim, dim))).astype(np.int64).tolist()


def test_equals_a_direct_computation(spark):
    check(spark, data(300, 7, 1))
    check(spark, data(150, 40, 2))
    check(spark, data(80, 6, 3), k=2)


def test_polarisation_is_exact():
    rows = [[10**12 + 3 * i * i, -7 * i, 5 + i % 3] for i in range(50)]
    x = np.array(rows)
    sums = wh._sums(x)
    centre = [round(Fraction(sums[a, a], 50)) for a in range(3)]
    missed = [sums[a, a] - 50 * centre[a] for a in range(3)]
    assert wh.covariance(wh._squares(x - np.array(centre)), 50, missed) == exact_covariance(rows)
    wide = x * 10**6  # squares beyond 64 bits
    s = wh._squares(wide)
    assert s[0, 1] == sum((int(a) + int(b)) ** 2 for a, b, _ in wide.tolist())


def test_components_without_variance(spark):
    rows = [[v[0], v[1], v[0] + v[1], 5] for v in data(60, 2, 4)]
    _, real = check(spark, rows)
    assert real.tolist() == [True, True, False, False]
    out = wh.whiten(spark.createDataFrame([(1, [3, 4]), (2, [3, 4])], SCHEMA)).collect()
    assert {(r.whitened, r.explained, r.deviation, r.identity_error) for r in out} == {(None, 0.0, 0, 0.0)}


def test_odd_rows(spark):
    rows = [(i, v) for i, v in enumerate(data(40, 3, 5))]
    odd = [(None, rows[0][1]), (1, rows[1][1]), rows[2], (90, None), (91, []), (92, [1, 2]), (93, [4, 9]), (94, [7, 1])]
    clash = [F.lit(9).alias(c) for c in ("_id", "dim", "a", "b", "total", "n", "component", "whitened", "identity_error")]
    out = wh.whiten(spark.createDataFrame(rows + odd, SCHEMA).select("*", *clash)).collect()
    assert len(out) == 43 * 3 + 3 * 2 and {r.n for r in out} == {43, 3}
    assert sum(r.vec_id is None for r in out) == 3 and sum(r.vec_id == 2 for r in out) == 6
    assert wh.whiten(spark.createDataFrame([], SCHEMA)).collect() == []


def test_values_at_the_borders_of_64_bits(spark):
    rows = [(i, [(1 << 62) + i * i, -(1 << 62) + 5 * i]) for i in range(9)]
    out = wh.whiten(spark.createDataFrame(rows, SCHEMA)).collect()
    sums = [sum(x[a] for _, x in rows) for a in range(2)]
    want = {i: sum((9 * v - s) ** 2 for v, s in zip(x, sums, strict=True)) for i, x in rows}
    assert all(r.deviation == want[r.vec_id] for r in out) and out[0].identity_error < 1e-6
    far = [(i, [i << 60, 0]) for i in range(4)]
    assert {r.deviation for r in wh.whiten(spark.createDataFrame(far, SCHEMA)).collect()} == {None}


def test_integers(spark):
    rows = [(0, [0.5, -0.01]), (1, [None, 1.0]), (2, [float("nan"), 1.0]), (3, None), (4, [float("-inf"), 0.0]), (5, [])]
    df = spark.createDataFrame(rows, "vec_id long, v array<double>").select(wh.integers(F.col("v")).alias("x"))
    assert [r.x for r in df.collect()] == [[1_000_032, 999_999], None, None, None, None, []]
