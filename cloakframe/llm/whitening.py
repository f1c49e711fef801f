"""Whitening of integer vectors with covariances by polarisation.

No product of two dimensions is ever summed. Each task sums exact squares of the centred values of every dimension and of the sum of every pair of dimensions; the
variances that come of it give the covariances, cov(a, b) = (var(a + b) - var(a) - var(b)) / 2. All of it is in integers: values are centred by the whole number
next to the mean, a task adds in 64 bits where its largest value allows it and in Python's integers beyond, tasks are added as decimals of 38 digits, and what the whole
number misses of the mean is put right exactly. Only the matrix of one covariance for each pair of dimensions comes to the driver, for ``eigh``.

Every vector length is fitted on its own; its components are numbered by falling eigenvalue, the largest entry of each is positive. A component without
variance (an eigenvalue not above the rounding of the largest) has no whitened values: ``whitened`` is null, and it takes no part in ``identity_error``, which is measured on
the whitened values themselves. ``deviation`` is null where it does not fit 64 bits.

Rows with a null or empty vector are dropped; null ids, repeated rows and repeated ids are rows like any other. Fewer dimensions than asked for give as many
components as there are. An empty table gives an empty result. Only id and vector are read, so other columns cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal
from fractions import Fraction
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloakframe.llm.common import saved

COMPONENTS, CHUNK = 32, 1_024
SUMS = "dim int, a int, b int, total decimal(38,0)"
SCHEMA = "component int, n long, deviation long, whitened double, explained double"


def integers(vector: Column, scale: int = 64, shift: int = 1_000_000) -> Column:
    """floor(scale * c) + shift of every entry as an array of longs; null for vectors with null or non-finite entries."""
    ok = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return F.when(F.coalesce(ok, F.lit(False)), F.transform(vector, lambda c: F.floor(c.cast("double") * scale) + F.lit(shift).cast("long")))


class Fit(NamedTuple):
    """A length's fit list: rows, centre (whole numbers), n * mean - n * centre, components by column, their eigenvalues and shares of the trace."""

    n: int
    centre: np.ndarray
    missed: np.ndarray
    components: np.ndarray
    values: np.ndarray
    shares: np.ndarray


def _by_length(batch: pa.RecordBatch, at: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Rows of each vector length with their matrix, at most CHUNK at a time."""
    lengths = batch.column(at).value_lengths()
    for dim in lengths.unique().to_pylist():
        own = batch.filter(pc.equal(lengths, dim))
        for i in range(0, own.num_rows, CHUNK):
            part = own.slice(i, CHUNK)
            yield part, part.column(at).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _narrow(y: np.ndarray, factor: int, rows: int) -> np.ndarray:
    """As 64-bit integers if ``rows`` squares of ``factor`` times the largest value can be added there, as Python's integers if not."""
    most = max(abs(int(y.max(initial=0))), abs(int(y.min(initial=0))))
    return y.astype(np.int64) if (factor * most) ** 2 * max(rows, 1) < 1 << 63 else y.astype(object)


def _totals(vectors: DataFrame, of) -> dict[int, dict[tuple[int, int], int]]:
    """Sums of ``of`` (matrix -> {(a, b): whole number}) over all rows, for each vector length; tasks add first."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int, int], int] = {}
        for batch in batches:
            for _, x in _by_length(batch, 0):
                for (a, b), v in of(x).items():
                    key = (x.shape[1], a, b)
                    held[key] = held.get(key, 0) + v
        columns = [pa.array([k[i] for k in held], pa.int32()) for i in range(3)]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(map(Decimal, held.values()), pa.decimal128(38, 0))], names=["dim", "a", "b", "total"])

    out: dict[int, dict[tuple[int, int], int]] = {}
    for r in vectors.mapInArrow(partial, SUMS).groupBy("dim", "a", "b").agg(F.sum("total").alias("total")).toLocalIterator():
        out.setdefault(r["dim"], {})[r["a"], r["b"]] = int(r["total"])
    return out


def _sums(x: np.ndarray) -> dict[tuple[int, int], int]:
    """Number of rows at (-1, -1), the sum of each dimension at (a, a)."""
    wide = _narrow(x, 1, 1) if abs(int(x.max())) < 1 << 50 and abs(int(x.min())) < 1 << 50 else x.astype(object)
    return {(-1, -1): len(x)} | {(a, a): int(s) for a, s in enumerate(wide.sum(axis=0))}


def _squares(y: np.ndarray) -> dict[tuple[int, int], int]:
    """Sums of squares of every dimension, at (a, a), and of the sum of every pair of dimensions, at (a, b)."""
    y = _narrow(y, 2, len(y))
    out = {(a, a): int(s) for a, s in enumerate((y * y).sum(axis=0))}
    for a in range(y.shape[1] - 1):
        both = y[:, a + 1 :] + y[:, a : a + 1]
        out |= {(a, a + 1 + i): int(s) for i, s in enumerate((both * both).sum(axis=0))}
    return out


def covariance(squares: dict[tuple[int, int], int], n: int, missed: list[int]) -> list[list[Fraction]]:
    """Exact covariances from sums of squares of values whose sum is ``missed``: var = sum of squares / n - (missed / n)^2."""
    dim = len(missed)
    var = {(a, b): Fraction(s, n) - Fraction(missed[a] + (missed[b] if a != b else 0), n) ** 2 for (a, b), s in squares.items()}
    return [[var[a, a] if a == b else (var[min(a, b), max(a, b)] - var[a, a] - var[b, b]) / 2 for b in range(dim)] for a in range(dim)]


def fit(vectors: DataFrame, vector_col: str = "x", components: int = COMPONENTS) -> dict[int, Fit]:
    """The fit of every vector length; ``vectors`` is read twice."""
    rows = vectors.select(F.col(vector_col).alias("x")).filter(F.size("x") > 0)
    sums, centres, missed = _totals(rows, _sums), {}, {}
    for dim, s in sums.items():
        n = s[-1, -1]
        centres[dim] = np.array([round(Fraction(s[a, a], n)) for a in range(dim)], np.int64)
        missed[dim] = [s[a, a] - n * int(centres[dim][a]) for a in range(dim)]
    squares = _totals(rows, lambda x: _squares(_less(x, centres[x.shape[1]])))
    out = {}
    for dim, s in squares.items():
        n = sums[dim][-1, -1]
        exact = covariance(s, n, missed[dim])
        values, columns = np.linalg.eigh(np.array([[float(c) for c in row] for row in exact]))
        values, columns = values[::-1][:components], columns[:, ::-1][:, :components]
        columns = columns * np.sign(columns[np.abs(columns).argmax(axis=0), np.arange(columns.shape[1])])
        trace = float(sum(exact[a][a] for a in range(dim)))
        shares = values / trace if trace > 0 else np.zeros(len(values))
        out[dim] = Fit(n, centres[dim], np.array(missed[dim], object), columns, values, shares)
    return out


def _less(x: np.ndarray, centre: np.ndarray) -> np.ndarray:
    """x - centre, in Python's integers where 64 bits could overflow."""
    if max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0))), int(np.abs(centre).max(initial=0))) < 1 << 61:
        return x - centre
    return x.astype(object) - centre.astype(object)


def whitened(x: np.ndarray, f: Fit) -> np.ndarray:
    """(x - mean) on every component, over the root of its eigenvalue; not a number for components without variance."""
    centred = _less(x, f.centre).astype(np.float64) - np.array([float(Fraction(int(m), f.n)) for m in f.missed])
    real = f.values > np.finfo(float).eps * len(f.centre) * max(float(f.values[0]), 0.0)
    return np.where(real, centred @ f.components / np.sqrt(np.where(real, f.values, 1.0)), np.nan)


def deviations(x: np.ndarray, f: Fit) -> list[int | None]:
    """Sum over the dimensions of (n * x - sum of all x)^2, exact; None beyond 64 bits."""
    y = _less(x, f.centre)
    most = f.n * (max(abs(int(y.max(initial=0))), abs(int(y.min(initial=0)))) + 1)
    d = y.astype(np.int64 if most**2 * x.shape[1] < 1 << 63 else object) * f.n - f.missed.astype(np.int64 if most < 1 << 62 else object)
    return [int(s) if s < 1 << 63 else None for s in (d * d).sum(axis=1)]


def identity_error(vectors: DataFrame, fits: dict[int, Fit], vector_col: str = "x") -> float | None:
    """Largest absolute entry of the whitened values' covariance less the identity, over all lengths; None without any."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for _, x in _by_length(batch, 0):
                w = np.nan_to_num(whitened(x, fits[x.shape[1]]))
                moments = np.vstack([w.sum(axis=0), w.T @ w])
                sums[x.shape[1]] = sums.get(x.shape[1], 0) + moments
        for dim, m in sums.items():
            a, b = (i.ravel().astype("i4") for i in np.indices(m.shape))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(m.size, dim, "i4")), pa.array(a), pa.array(b), pa.array(m.ravel())], names=["dim", "a", "b", "v"])

    rows = vectors.select(F.col(vector_col).alias("x")).filter(F.size("x") > 0)
    worst = []
    moments: dict[int, np.ndarray] = {d: np.zeros((len(f.values) + 1, len(f.values))) for d, f in fits.items()}
    for r in rows.mapInArrow(partial, "dim int, a int, b int, v double").groupBy("dim", "a", "b").agg(F.sum("v").alias("v")).toLocalIterator():
        moments[r["dim"]][r["a"], r["b"]] = r["v"]
    for dim, m in moments.items():
        f = fits[dim]
        mean = m[0] / f.n
        real = ~np.isnan(whitened(f.centre[None, :], f)[0])
        off = np.abs(m[1:] / f.n - np.outer(mean, mean) - np.eye(len(f.values)))[np.ix_(real, real)]
        worst.append(float(off.max(initial=0.0)))
    return max(worst, default=None)


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "x", components: int = COMPONENTS) -> DataFrame:
    """One row of each vector and component: id, component, n, deviation, whitened, explained, identity_error. ``vector_col`` holds arrays of longs."""
    rows = saved(vectors.select(F.col(id_col).alias("_id"), F.col(vector_col).alias("x")).filter(F.size("x") > 0))
    fits = fit(rows, "x", components)
    error = identity_error(rows, fits)

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, x in _by_length(batch, 1):
                f = fits[x.shape[1]]
                k = len(f.values)
                row = pa.array(np.repeat(np.arange(len(x)), k))
                w = whitened(x, f).ravel()
                columns = [
                    part.column(0).take(row), pa.array(np.tile(np.arange(1, k + 1, dtype="i4"), len(x))), pa.array(np.full(k * len(x), f.n)),
                    pa.array(deviations(x, f), pa.int64()).take(row), pa.array(w, mask=np.isnan(w)), pa.array(np.tile(f.shares, len(x))),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["_id", "component", "n", "deviation", "whitened", "explained"])

    out = rows.mapInArrow(made, f"_id {rows.schema['_id'].dataType.simpleString()}, {SCHEMA}")
    return out.withColumnRenamed("_id", id_col).withColumn("identity_error", F.lit(error).cast("double"))
