"""Whitening of vectors: pivoted Cholesky of the centred scatter, then one-sided Jacobi on the factor.

Tasks add up exact integer sums and scatters, Spark adds those of the tasks, and the driver sees one
square matrix of the dimension. Its Cholesky factor with pivoting has as many columns as the rank; one-sided
Jacobi rotates these columns until they are orthogonal. The squares of their norms are the eigenvalues, to
high relative accuracy even where they are small, and the normalised columns are the components.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 32
# Scaled entries beyond this are taken as this.
LARGEST = 1 << 40
SWEEPS = 60
SMALL = 1e-15


def pivoted_cholesky(matrix: np.ndarray) -> np.ndarray:
    """``factor`` with ``factor @ factor.T`` equal to the positive semidefinite ``matrix``, one column for each unit of rank."""
    left = matrix.astype(float).copy()
    size = len(left)
    order = np.arange(size)
    factor = np.zeros((size, size))
    least = size * np.finfo(float).eps * max(left.diagonal().max(initial=0.0), 0.0)
    for k in range(size):
        pivot = k + int(np.argmax(left.diagonal()[k:]))
        if left[pivot, pivot] <= least:
            factor = factor[:, :k]
            break
        for rows in (left, left.T, factor):
            rows[[k, pivot]] = rows[[pivot, k]]
        order[[k, pivot]] = order[[pivot, k]]
        factor[k, k] = np.sqrt(left[k, k])
        factor[k + 1 :, k] = left[k + 1 :, k] / factor[k, k]
        left[k + 1 :, k + 1 :] -= np.outer(factor[k + 1 :, k], factor[k + 1 :, k])
    back = np.empty_like(factor)
    back[order] = factor
    return back


def one_sided_jacobi(factor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues of ``factor @ factor.T``, falling, and its unit eigenvectors as columns.

    Columns are paired as in a round-robin tournament, so that each round rotates disjoint pairs at once.
    """
    columns = factor.T.copy()
    count = len(columns)
    seats = np.arange(count + count % 2)
    for _ in range(SWEEPS):
        worst = 0.0
        for _ in range(len(seats) - 1):
            half = len(seats) // 2
            one, two = seats[:half], seats[half:][::-1]
            real = (one < count) & (two < count)
            one, two = one[real], two[real]
            p, q = columns[one], columns[two]
            a, b, c = (p * p).sum(1), (q * q).sum(1), (p * q).sum(1)
            cosine = np.abs(c) / np.sqrt(a * b)
            worst = max(worst, cosine.max(initial=0.0))
            turn = cosine > SMALL
            zeta = (b - a)[turn] / (2 * c[turn])
            tangent = np.where(zeta >= 0, 1.0, -1.0) / (np.abs(zeta) + np.sqrt(1 + zeta * zeta))
            cos = (1 / np.sqrt(1 + tangent * tangent))[:, None]
            sin = cos * tangent[:, None]
            columns[one[turn]], columns[two[turn]] = cos * p[turn] - sin * q[turn], sin * p[turn] + cos * q[turn]
            seats = np.concatenate([seats[:1], seats[-1:], seats[1:-1]])
        if worst <= SMALL * 10:
            break
    norms = np.sqrt((columns * columns).sum(1))
    falling = np.argsort(-norms, kind="stable")
    return norms[falling] ** 2, (columns[falling] / norms[falling, None]).T


def scatter(rows: np.ndarray) -> np.ndarray:
    """``rows.T @ rows`` of integers, exact, as Python integers."""
    largest = int(np.abs(rows).max(initial=0))
    out = np.zeros((rows.shape[1],) * 2, object)
    if largest < 1 << 26:
        # Sums of so many products are below 2 to the 53rd, so float products are exact.
        step = max(1, (1 << 52) // max(1, largest * largest))
        for i in range(0, len(rows), step):
            part = rows[i : i + step].astype(float)
            out += (part.T @ part).astype(np.int64)
        return out
    wide = rows.astype(object)
    return out + wide.T.dot(wide)


def _scaled(batch: pa.RecordBatch, size: int) -> np.ndarray:
    """floor(64 * entry) of the vectors of a batch, one row each."""
    flat = batch.column("vector").flatten().to_numpy(zero_copy_only=False)
    floors = np.floor(SCALE * flat.reshape(-1, size))
    return np.clip(floors, -LARGEST, LARGEST).astype(np.int64)


def _added(rows: DataFrame, part: Callable[[pa.RecordBatch], np.ndarray], width: int, kind: str) -> np.ndarray:
    """The sum of ``part`` over all batches: one row of ``width`` numbers a task, added up by Spark."""

    def tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(width, object)
        for batch in batches:
            if batch.num_rows:
                out = out + part(batch)
        yield pa.record_batch([pa.array([[str(v) if kind != "double" else repr(float(v)) for v in out]])], ["values"])

    parts = rows.mapInArrow(tasks, "values array<string>").select(F.posexplode("values").alias("at", "value"))
    sums = parts.groupBy("at").agg(F.sum(F.col("value").cast(kind)).alias("value"))
    out = np.zeros(width, object)
    for r in sums.collect():
        out[r["at"]] = int(r["value"]) if kind != "double" else r["value"]
    return out


def usable(vector: Column) -> Column:
    """Whether a vector has entries, all of them finite."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & ~bad


def whitened(vectors: DataFrame, column: str = "embedding", most: int = COMPONENTS) -> DataFrame:
    """``vec_id``, ``component``, ``n``, ``deviation``, ``whitened``, ``explained``, ``identity_error``.

    One row for each usable row of ``vectors`` and each component, ``most`` at most, fewer where the
    vectors span fewer dimensions; other columns are not read. Null vectors, empty ones, and those with null
    or non-finite entries take no part; nor do vectors whose length is not the commonest (of equally common
    lengths, the longest). Repeated rows and rows without an id count and are returned each. No usable
    vector, or equal ones only, give no rows. ``deviation`` is null where it does not fit a long.
    Components have their entry of largest absolute value positive.
    """
    clean = vectors.select("vec_id", F.col(column).cast("array<double>").alias("vector")).where(usable(F.col("vector")))
    lengths = clean.groupBy(F.size("vector").alias("length")).agg(F.count("*").alias("rows"))
    commonest = lengths.orderBy(F.desc("rows"), F.desc("length")).first()
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    schema = schema.replace("vec_id long", f"vec_id {clean.schema['vec_id'].dataType.simpleString()}")
    if commonest is None:
        return clean.sparkSession.createDataFrame([], schema)
    size = commonest["length"]
    fit = clean.where(F.size("vector") == size)

    counted = _added(fit, lambda b: np.append(_scaled(b, size).sum(0).astype(object), b.num_rows), size + 1, "decimal(38,0)")
    n, sums = int(counted[-1]), counted[:-1]
    near = np.array([(2 * s + n) // (2 * n) for s in sums], np.int64)
    rest = np.array([s - n * int(m) for s, m in zip(sums, near, strict=True)], object)

    def off(batch: pa.RecordBatch) -> np.ndarray:
        return _scaled(batch, size) - near

    # n^2 times the covariance is an integer: n * sum(z z') - sum(z) sum(z)', with z centred to the nearest integer.
    products = _added(fit, lambda b: scatter(off(b)).ravel(), size * size, "decimal(38,0)").reshape(size, size)
    exact = n * products - np.outer(rest, rest)
    covariance = np.array([[v / (n * n) for v in row] for row in exact])
    values, components = one_sided_jacobi(pivoted_cholesky(covariance))
    trace = sum(exact.diagonal()) / (n * n)
    kept = min(most, len(values))
    if not kept:
        return clean.sparkSession.createDataFrame([], schema)
    largest = np.abs(components).argmax(0)
    components = components * np.sign(components[largest, range(components.shape[1])])
    share = values[:kept] / trace
    basis = components[:, :kept] / np.sqrt(values[:kept])
    mean = np.array([s / n for s in rest])

    def projected(batch: pa.RecordBatch) -> np.ndarray:
        return (off(batch) - mean) @ basis

    def moments(batch: pa.RecordBatch) -> np.ndarray:
        points = projected(batch)
        return np.concatenate([points.sum(0), (points.T @ points).ravel()])

    sums_of = _added(fit, moments, kept + kept * kept, "double").astype(float) / n
    spread = sums_of[kept:].reshape(kept, kept) - np.outer(sums_of[:kept], sums_of[:kept])
    error = float(np.abs(spread - np.eye(kept)).max())
    squares = sum(int(s) * int(s) for s in rest)

    def deviations(z: np.ndarray) -> list[int | None]:
        """sum((n * z - rest)^2) of each row, by integers."""
        top, bound = int(np.abs(z).max(initial=0)), max((abs(int(s)) for s in rest), default=0)
        kind = np.int64 if size * max(top * top, top * bound) < 1 << 62 else object
        own, cross = (z.astype(kind) ** 2).sum(1).tolist(), z.astype(kind).dot(rest.astype(kind)).tolist()
        out = [n * n * a - 2 * n * b + squares for a, b in zip(own, cross, strict=True)]
        return [v if v < 1 << 63 else None for v in out]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # As many rows at a time as make about 65,536 of the result.
            for part in (batch.slice(i, 2048) for i in range(0, batch.num_rows, 2048)):
                count = part.num_rows
                each = pa.array(np.repeat(np.arange(count), kept))
                yield pa.record_batch(
                    [
                        part.column("vec_id").take(each),
                        pa.array(np.tile(np.arange(1, kept + 1, dtype=np.int32), count)),
                        pa.array(np.full(count * kept, n, np.int64)),
                        pa.array(deviations(off(part)), pa.int64()).take(each),
                        pa.array(projected(part).ravel()),
                        pa.array(np.tile(share, count)),
                        pa.array(np.full(count * kept, error)),
                    ],
                    ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return fit.mapInArrow(rows, schema)
