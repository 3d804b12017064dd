"""Whitening of embeddings by shifted CholeskyQR.

The centred rows Y are never factored in one place. A pass over them sums their Gram matrix, which
is as large as the dimension squared whatever the number of rows. Its Cholesky factor R1 (of the
Gram matrix and a small shift, so that it exists for ill-conditioned rows) turns the rows to
Q1 = Y R1^-1 by triangular solves; further passes orthogonalise again, and Y = Qk Rk ... R1. The
singular values and right singular vectors of the composed R are those of Y, without the squared
condition number that an eigendecomposition of one Gram matrix would suffer.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.llm.common import stored

SCALE = 256
COMPONENTS = 4
# Orthogonalisations at most; three reach double precision for any condition number.
PASSES = 5
ORTHOGONAL = 1e-12
# A component whose singular value is below this part of the largest one has no direction of its own.
RANK = 1e-7
# Rows that a task turns at a time.
BLOCK = 4_096
# Tasks that sum the rows of a matrix.
SUMMING = 32


def whole_vectors(rows: DataFrame, column: str = "embedding") -> DataFrame:
    """vec_id and `x`, floor(SCALE * entry) as longs, of rows without null or non-finite entries."""
    entries = F.col(column).cast("array<double>")
    good = F.forall(
        entries, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))
    )
    return rows.filter(F.col(column).isNotNull() & good).select(
        F.col("vec_id"), F.transform(entries, lambda c: F.floor(c * SCALE)).alias("x")
    )


def _padded(vectors: DataFrame, size: int) -> DataFrame:
    """All vectors of `size` entries; missing ones are 0."""
    fill = F.array_repeat(F.lit(0).cast("long"), F.lit(size) - F.size("x"))
    return vectors.withColumn("x", F.when(F.size("x") < size, F.concat("x", fill)).otherwise(F.col("x")))


def _blocks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Batches with their vectors as rows of a matrix."""
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK):
            part = batch.slice(at, BLOCK)
            values = part.column(part.schema.get_field_index("x")).flatten().to_numpy(zero_copy_only=False)
            yield part, values.reshape(part.num_rows, size)


def summed(vectors: DataFrame, size: int, shape: tuple[int, int], kind: str, part: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum of `part` over all blocks of vectors: a small matrix of `shape`.

    Each task adds up its blocks and sends the rows of its sum; rows of one number meet in one of
    SUMMING tasks, and the driver gets one matrix.
    """
    schema = pa.schema([("i", pa.int32()), ("row", pa.binary())])

    def send(total: dict[int, np.ndarray] | np.ndarray) -> pa.RecordBatch:
        rows = total.items() if isinstance(total, dict) else enumerate(total)
        pairs = [(i, row.tobytes()) for i, row in rows]
        return pa.RecordBatch.from_arrays(
            [pa.array([i for i, _ in pairs], pa.int32()), pa.array([r for _, r in pairs], pa.binary())], schema=schema
        )

    def own(batches):
        total = np.zeros(shape, kind)
        for _, values in _blocks(batches, size):
            total += part(values)
        yield send(total)

    def merge(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, octets in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                row = np.frombuffer(octets, kind)
                total[i] = total[i] + row if i in total else row
        yield send(total)

    rows = vectors.select("x").mapInArrow(own, "i int, row binary").repartition(min(SUMMING, shape[0]), "i")
    result = np.zeros(shape, kind)
    for row in rows.mapInArrow(merge, "i int, row binary").collect():
        result[row["i"]] = np.frombuffer(row["row"], kind)
    return result


def triangular_solve(rows: np.ndarray, upper: np.ndarray) -> np.ndarray:
    """The Q of Q @ upper = rows, column by column."""
    out = np.empty_like(rows)
    for j in range(rows.shape[1]):
        out[:, j] = (rows[:, j] - out[:, :j] @ upper[:j, j]) / upper[j, j]
    return out


def _factor(gram: np.ndarray, n: int, shifted: bool) -> np.ndarray:
    """The upper Cholesky factor of a Gram matrix, shifted if asked or if it has none."""
    size = len(gram)
    shift = 11 * (size * n + size * (size + 1)) * np.finfo(float).eps / 2 * np.trace(gram)
    while True:
        try:
            return np.linalg.cholesky(gram + (shift if shifted else 0) * np.eye(size)).T
        except np.linalg.LinAlgError:
            shift, shifted = (shift * 10 if shifted else shift), True


def principal(fit: DataFrame, n: int, size: int, mean: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Singular values and right singular vectors (as columns) of the centred rows of `fit`."""
    factors: list[np.ndarray] = []
    while True:
        def gram(values: np.ndarray) -> np.ndarray:
            rows = values - mean
            for upper in factors:
                rows = triangular_solve(rows, upper)
            return rows.T @ rows

        found = summed(fit, size, (size, size), "f8", gram)
        found = (found + found.T) / 2
        if not found.any():
            return np.zeros(size), np.eye(size)
        done = bool(factors) and np.abs(found - np.eye(size)).max() < ORTHOGONAL
        if done or len(factors) == PASSES:
            break
        factors.append(_factor(found, n, not factors))
    # Directions in which no row differs keep a Gram entry of 0; its root takes them out of R.
    values, vectors = np.linalg.eigh(found)
    composed = (vectors * np.sqrt(np.maximum(values, 0))) @ vectors.T
    for upper in reversed(factors):
        composed = composed @ upper
    _, sigma, right = np.linalg.svd(composed)
    return sigma, right.T


def _deviations(values: np.ndarray, n: int, sums: np.ndarray) -> list[int | None]:
    """The sum of (n * x - sum) ** 2 of every row, exactly; null beyond a long."""
    rough = ((n * values.astype(float) - sums) ** 2).sum(axis=1)
    most = max(float(np.abs(n * values.astype(float)).max(initial=0)), float(np.abs(sums).max(initial=0)))
    if rough.max(initial=0) < 2**62 and most < 2**62:
        return ((n * values - sums) ** 2).sum(axis=1).tolist()
    exact = [sum((n * x - s) ** 2 for x, s in zip(row, sums.tolist())) for row in values.tolist()]
    return [d if d < 2**63 else None for d in exact]


def whiten(rows: DataFrame, column: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """A row for every usable vector and component; see `whole_vectors` for what is left out.

    vec_id, component (1 has the largest variance), n (distinct vectors), deviation, whitened (unit
    variance over the distinct vectors), explained (part of all variance) and identity_error (of
    the whitened covariance). The components are fitted to each distinct vector once, so copies
    have no weight and share their values.

    Shorter vectors count as filled up with zeros; null and repeated ids stay. Directions without
    variance are no components: equal vectors only, or none, give no rows. A deviation beyond a
    long is null. Other columns are not read, whatever their names.
    """
    spark = rows.sparkSession
    vectors = whole_vectors(rows, column)
    size = vectors.agg(F.max(F.size("x"))).first()[0] or 0
    schema = f"vec_id {dict(vectors.dtypes)['vec_id']}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if not size:
        return spark.createDataFrame([], schema)
    vectors = _padded(vectors, size)
    fit = stored(vectors.select("x").distinct(), "whitening-fit")
    n = fit.count()
    sums = summed(fit, size, (1, size), "i8", lambda values: values.sum(axis=0, keepdims=True))[0]
    mean = sums / n
    sigma, right = principal(fit, n, size, mean)
    kept = min(components, int((sigma > RANK * sigma[0]).sum()))
    if not kept:
        return spark.createDataFrame([], schema)
    explained = (sigma[:kept] ** 2 / (sigma**2).sum()).tolist()
    turn = right[:, :kept] / (sigma[:kept] / np.sqrt(n))
    centre = summed(fit, size, (1, kept), "f8", lambda v: ((v - mean) @ turn).sum(axis=0, keepdims=True))[0] / n

    def spread(values: np.ndarray) -> np.ndarray:
        moved = (values - mean) @ turn - centre
        return moved.T @ moved

    error = float(np.abs(summed(fit, size, (kept, kept), "f8", spread) / n - np.eye(kept)).max())

    def task(batches):
        for part, values in _blocks(batches, size):
            count = part.num_rows
            ids = part.column(part.schema.get_field_index("vec_id")).take(pa.array(np.repeat(np.arange(count), kept)))
            deviation = np.repeat(np.array(_deviations(values, n, sums), object), kept)
            columns = [
                ids, pa.array(np.tile(np.arange(1, kept + 1, dtype=np.int32), count)),
                pa.array(np.full(count * kept, n)), pa.array(deviation.tolist(), pa.int64()),
                pa.array(((values - mean) @ turn).ravel()), pa.array(explained * count, pa.float64()),
                pa.array(np.full(count * kept, error)),
            ]
            names = ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
            yield pa.RecordBatch.from_arrays(columns, names)

    return vectors.mapInArrow(task, schema)
