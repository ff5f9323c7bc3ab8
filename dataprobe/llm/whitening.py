"""Whitening of embeddings from exact second moments.

Only squares are summed up: of every centred dimension and of the sum of every two. As var(a + b) = var(a) + var(b) + 2 cov(a, b),
differences of these variances are the covariances (polarisation). All sums are whole numbers, so they are exact in any order.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dataprobe.llm.common import map_arrow, materialize, row_column, with_new_columns

#: Whole numbers are kept within these bounds, as a cast to long would.
LEAST, MOST = -(1 << 63), (1 << 63) - 1
#: Rows whose pair sums are squared at once.
ROWS = 4096


@dataclass(frozen=True)
class Whitening:
    """What vectors of one length are whitened with: the fit list's rows and sums, the leading eigenvectors as columns, their
    eigenvalues, and the share of the trace that each explains."""

    n: int
    sums: list[int]
    vectors: np.ndarray
    values: np.ndarray
    explained: np.ndarray
    identity_error: float | None = None


def whole_numbers(array: pa.Array, scale: float) -> pa.Array:
    """Each vector's entries c as floor(scale * c), within 64 bits; null for a vector that is null or holds null or non-finite entries."""
    lengths = pc.fill_null(pc.list_value_length(array), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = array.flatten()
    gaps = pc.is_null(flat).to_numpy(zero_copy_only=False)
    values = pc.fill_null(flat, 0).to_numpy(zero_copy_only=False).astype(np.float64)
    with np.errstate(over="ignore"):
        whole = np.floor(values * scale) + 0.0
    offsets = np.concatenate([[0], np.cumsum(lengths)])
    bad = np.concatenate([[0], np.cumsum(gaps | ~np.isfinite(values))])[offsets]
    mask = (np.diff(bad) > 0) | pc.is_null(array).to_numpy(zero_copy_only=False)
    limits = whole < 2.0 ** 63, whole >= -2.0 ** 63
    numbers = np.where(limits[0] & limits[1], whole, 0.0).astype(np.int64)
    numbers[~limits[0]], numbers[~limits[1]] = MOST, LEAST
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(numbers), mask=pa.array(mask))


def _matrices(batch: pa.RecordBatch, column: str) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """``(length, rows, matrix)`` for the vectors of each length above 0; nulls are left out."""
    array = batch[column]
    lengths = pc.fill_null(pc.list_value_length(array), 0).to_numpy(zero_copy_only=False)
    flat = array.flatten().to_numpy(zero_copy_only=False)
    at = np.concatenate([[0], np.cumsum(lengths)])[:-1]
    for size in np.unique(lengths[lengths > 0]).tolist():
        rows = np.flatnonzero(lengths == size)
        yield size, rows, flat[at[rows][:, None] + np.arange(size)]


def _exact(matrix: np.ndarray, bound: int) -> np.ndarray:
    """The matrix as 64-bit numbers where results up to ``bound`` fit, else as Python's unbounded ones."""
    return matrix if bound < 1 << 62 else matrix.astype(object)


def _squared(matrix: np.ndarray) -> np.ndarray:
    return (matrix * matrix).sum(axis=0).astype(object)


def _limbs(values: np.ndarray) -> dict[str, pa.Array]:
    """Whole numbers as ``high * 2^60 + low``, which decimals can add up without loss."""
    kind = pa.decimal128(38, 0)
    numbers = [int(v) for v in values]
    return {"high": pa.array([v >> 60 for v in numbers], type=pa.int64()).cast(kind) if all(abs(v) < 1 << 120 for v in numbers)
            else pa.array([str(v >> 60) for v in numbers]).cast(kind),
            "low": pa.array([v & ((1 << 60) - 1) for v in numbers], type=pa.int64()).cast(kind)}


def moments(fit: DataFrame, centres: dict[int, list[int]] | None) -> dict[int, dict[tuple[int, int], int]]:
    """For each vector length the exact sums over ``fit (x)`` that (i, j) names: without centres of x_i, as (i, i), and of 1, as
    (-1, -1); with them of (x_i - c_i)^2 and of (x_i - c_i + x_j - c_j)^2. They are combined per task, then by Spark; what reaches
    the driver has d * (d + 1) / 2 numbers for length d, however many vectors there are."""
    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            for size, _, matrix in _matrices(batch, "x"):
                for at in range(0, len(matrix), ROWS):
                    part = matrix[at:at + ROWS]
                    largest = max(int(part.max()), -int(part.min()))
                    if centres is None:
                        new = np.append(_exact(part, largest * len(part)).sum(axis=0).astype(object), len(part))
                    else:
                        largest = 2 * (largest + max(map(abs, centres[size])))
                        centred = _exact(part, largest * largest * len(part)) - np.array(
                            centres[size], dtype=np.int64 if largest < 1 << 62 else object)
                        new = np.concatenate([_squared(centred)] + [
                            _squared(centred[:, i, None] + centred[:, i + 1:]) for i in range(size - 1)])
                    totals[size] = totals[size] + new if size in totals else new
        for size, total in totals.items():
            if centres is None:
                i = j = np.append(np.arange(size), -1)
            else:
                upper = np.triu_indices(size, 1)
                i, j = (np.concatenate([np.arange(size), upper[k]]) for k in (0, 1))
            yield pa.record_batch({"d": pa.array(np.full(len(i), size, dtype=np.int32)), "i": pa.array(i.astype(np.int32)),
                                   "j": pa.array(j.astype(np.int32)), **_limbs(total)})

    parts = map_arrow(fit, sums, "d int, i int, j int, high decimal(38,0), low decimal(38,0)")
    found: dict[int, dict[tuple[int, int], int]] = {}
    for d, i, j, high, low in parts.groupBy("d", "i", "j").agg(F.sum("high"), F.sum("low")).collect():
        found.setdefault(d, {})[i, j] = (int(high) << 60) + int(low)
    return found


def solve(n: int, sums: list[int], centres: list[int], squares: dict[tuple[int, int], int], components: int) -> Whitening:
    """The leading components from the squared sums around ``centres``. n^2 times each variance is n * (sum of squares) - (sum)^2, a
    whole number, where the centre's distance from the mean cancels out."""
    size = len(sums)
    rest = [s - n * c for s, c in zip(sums, centres)]
    single = [n * squares[i, i] - rest[i] ** 2 for i in range(size)]
    covariance = np.zeros((size, size))
    for i in range(size):
        covariance[i, i] = single[i] / n ** 2
        for j in range(i + 1, size):
            both = n * squares[i, j] - (rest[i] + rest[j]) ** 2
            covariance[i, j] = covariance[j, i] = (both - single[i] - single[j]) / (2 * n ** 2)
    values, vectors = np.linalg.eigh(covariance)
    values, vectors = values[::-1][:components], vectors[:, ::-1][:, :components]
    vectors = vectors * np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(vectors.shape[1])])
    trace = math.fsum(covariance.diagonal())
    flat = values <= max(trace, 0.0) * size * np.finfo(float).eps      # no variance to divide by
    return Whitening(n, sums, vectors, np.where(flat, np.nan, values), values / trace if trace > 0 else np.full(len(values), np.nan))


def fit_whitening(fit: DataFrame, components: int) -> dict[int, Whitening]:
    """The whitening of each vector length in ``fit (x)``, and how far the whitened fit list's covariance is from the identity."""
    first = moments(fit, None)
    totals = {d: [found[i, i] for i in range(d)] for d, found in first.items()}
    counts = {d: found[-1, -1] for d, found in first.items()}
    centres = {d: [(2 * s + counts[d]) // (2 * counts[d]) for s in totals[d]] for d in totals}      # the nearest whole number
    squares = moments(fit, centres) if centres else {}
    models = {d: solve(counts[d], totals[d], centres[d], squares[d], components) for d in totals}
    most = max([len(m.values) for m in models.values()], default=0)
    whitened = fit.select(F.size("x").alias("d"), _projection(models)("x")["whitened"].alias("w"))
    pairs = [(a, b) for a in range(most) for b in range(a, most)]
    entries = [F.covar_pop(F.get("w", F.lit(a)), F.get("w", F.lit(b))) for a, b in pairs]
    errors = {}
    for row in whitened.where("d > 0").groupBy("d").agg(*[e.alias(f"e{k}") for k, e in enumerate(entries)]).collect() if pairs else []:
        far = [abs(row[f"e{k}"] - (a == b)) for k, (a, b) in enumerate(pairs) if row[f"e{k}"] is not None]
        errors[row["d"]] = max(far, default=None)
    return {d: Whitening(m.n, m.sums, m.vectors, m.values, m.explained, errors.get(d)) for d, m in models.items()}


def _projection(models: dict[int, Whitening]):
    """An Arrow function from whole-number vectors to what ``whiten`` adds to their rows."""
    kind = "struct<n:long,deviation:long,whitened:array<double>,explained:array<double>,identity_error:double>"

    @F.arrow_udf(kind)
    def project(arrays: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for array in arrays:
            found: list[dict | None] = [None] * len(array)
            for size, rows, matrix in _matrices(pa.record_batch({"x": array}), "x"):
                m = models[size]
                largest = (max(int(matrix.max()), -int(matrix.min())) + 1) * m.n * 2
                centred = _exact(matrix, largest) * m.n - np.array(m.sums, dtype=np.int64 if largest < 1 << 62 else object)
                squares = _exact(centred, largest * largest * size)
                deviations = (squares * squares).sum(axis=1).tolist()
                whitened = (centred / m.n).astype(np.float64) @ m.vectors / np.sqrt(m.values)
                explained = _numbers(m.explained)
                for row, deviation, values in zip(rows.tolist(), deviations, whitened.tolist()):
                    found[row] = {"n": m.n, "deviation": deviation if deviation <= MOST else None, "whitened": _numbers(values),
                                  "explained": explained, "identity_error": m.identity_error}
            yield pa.array(found, type=pa.struct({
                "n": pa.int64(), "deviation": pa.int64(), "whitened": pa.list_(pa.float64()), "explained": pa.list_(pa.float64()),
                "identity_error": pa.float64()}))

    return project


def _numbers(values) -> list[float | None]:
    return [None if math.isnan(v) else float(v) for v in values]


def whiten(rows: DataFrame, vector: str = "embedding", components: int = 4, scale: float = 256) -> DataFrame:
    """For each row with a usable vector and each of the leading ``components``: the row's columns, ``component`` (from 1, by falling
    eigenvalue), ``n``, ``deviation``, ``whitened``, ``explained`` and ``identity_error``.

    A vector's entries c become x = floor(scale * c), kept within 64 bits. Rows whose vector is null, empty, or holds null or non-finite
    entries are left out. The fit list holds each distinct x once: n of them, with sums S; vectors of each length have a fit of
    their own. ``deviation`` is the sum of (n * x - S)^2 (null beyond 64 bits), ``whitened`` the projection of x - S / n on the
    component over the root of its eigenvalue, ``explained`` the eigenvalue's share of the trace; a component without variance has
    null for the first, and both are null where nothing varies. ``identity_error`` is the largest entry of the whitened fit list's covariance
    minus the identity. A component's sign is such that its largest entry is positive. Repeated rows are whitened each; rows with
    fewer dimensions than ``components`` have as many components as dimensions. Columns of ``rows`` with a new column's name are replaced.
    """
    @F.arrow_udf("array<long>")
    def numbers(arrays: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for array in arrays:
            yield whole_numbers(array, scale)

    coded = rows.select(row_column(rows).alias("row"), numbers(F.col(f"`{vector}`")).alias("x")).where("x IS NOT NULL")
    fit = materialize(coded.select("x").distinct(), "fit-list")
    models = fit_whitening(fit, components)
    found = coded.select("row", _projection(models)("x").alias("found")).select(
        "row", "found", F.posexplode(F.arrays_zip("found.whitened", "found.explained")).alias("place", "value"))
    return found.select(*with_new_columns(
        rows.columns, "row", component=(F.col("place") + 1).cast("int"), n=F.col("found.n"), deviation=F.col("found.deviation"),
        whitened=F.col("value.whitened"), explained=F.col("value.explained"), identity_error=F.col("found.identity_error")))
