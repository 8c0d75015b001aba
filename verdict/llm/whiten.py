"""Whitening of embeddings by shifted CholeskyQR.

Entries become whole numbers (floor of ``SCALE`` times the entry, plus ``OFFSET``). One pass counts them and sums every
dimension exactly. Rows are centred as (x - q) - r / n, where q and r are quotient and remainder of a
dimension's sum by n, so no digit is lost to the offset. Further passes orthogonalise the centred rows: each task solves
them against the triangular factors found so far, adds up the Gram matrix of the result, and sends its d x d sums; the sum
of all, shifted in the first pass by a small multiple of its trace so that it is positive definite at any
condition, is factored by Cholesky. Passes end when the Gram matrix is the identity to ``CLOSE``, or after ``PASSES``.
A later matrix that is no longer positive definite (dimensions that do not vary) is shifted in the same way.
The product of the factors is the R of the centred rows; its singular vectors are the components, and its squared
singular values over n their eigenvalues. One more pass measures the covariance of the whitened rows.

A task holds d x d sums and one Arrow batch, the driver d x d sums.

Defined cases: rows whose vector is null, empty, or holds null or non-finite entries take no part, nor do
vectors that have not the most frequent length (of lengths that are equally frequent, the greatest). Entries beyond
2^40 count as that, so that sums stay exact. Repeated rows and ids are rows of their own, null ids are passed through.
Components whose eigenvalue is below ``NOTHING`` of the trace have no whitened values and are left out; a single row,
or equal rows, give an empty result. A deviation beyond the range of long is null. Other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdict.llm.common import small_batches

SCALE, OFFSET, MOST = 64, 1_000_000, 1 << 40
PASSES, CLOSE, NOTHING = 8, 1e-13, 1e-13


def valid(embeddings: DataFrame, vector: str, key: str) -> DataFrame:
    """(id, v) of the rows that take part, whatever their lengths; v as doubles."""
    v = F.transform(F.col(vector), lambda x: x.cast("double"))
    rows = embeddings.select(F.col(key).cast("long").alias("id"), v.alias("v"))
    return rows.filter(F.expr("size(v) > 0 and forall(v, x -> x is not null and not isnan(x) and abs(x) < double('inf'))"))


def whole(batch: pa.RecordBatch, d: int) -> tuple[np.ndarray, np.ndarray]:
    """The rows of a batch with d entries: x (without the offset) of the last column, and a mask of these rows."""
    v = batch.column(batch.num_columns - 1)
    mask = pc.equal(pc.list_value_length(v), d).to_numpy(zero_copy_only=False)
    flat = pc.list_flatten(v.filter(pa.array(mask))).to_numpy(zero_copy_only=False).reshape(-1, d)
    return np.floor(np.clip(flat, -MOST / SCALE, MOST / SCALE) * SCALE).astype(np.int64), mask


@dataclass
class Centre:
    """n and, for each dimension, the sum of x without the offset, as whole numbers."""

    n: int
    sums: list[int]

    def __post_init__(self):
        self.quotient = np.array([s // self.n for s in self.sums], np.int64)
        self.rest = np.array([s % self.n for s in self.sums], np.int64)

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (x - self.quotient) - self.rest / self.n

    def deviations(self, x: np.ndarray) -> pa.Array:
        """Sum over dimensions of (n x - S)^2, which the offset does not change."""
        away = x - self.quotient
        guess = ((away.astype(float) * self.n - self.rest) ** 2).sum(axis=1)
        safe = (guess < 2.0**62) & (np.abs(away).max(axis=1, initial=0) * float(self.n) < 2.0**62)
        near = away * self.n - self.rest
        out = pa.array((near * near).sum(axis=1), pa.int64(), mask=~safe)
        if safe.all():
            return out
        # Close to the range or beyond it: numbers of any length.
        exact = out.to_pylist()
        for i in np.flatnonzero(~safe).tolist():
            total = sum((int(a) * self.n - int(r)) ** 2 for a, r in zip(away[i], self.rest, strict=True))
            exact[i] = total if total < 2**63 else None
        return pa.array(exact, pa.int64())


def solve(rows: np.ndarray, r: np.ndarray, block: int = 32) -> np.ndarray:
    """rows times the inverse of upper triangular r, by substitution in blocks of columns."""
    out = rows.astype(float)
    d = len(r)
    for a in range(0, d, block):
        b = min(a + block, d)
        if a:
            out[:, a:b] -= out[:, :a] @ r[:a, a:b]
        for j in range(a, b):
            out[:, j] = (out[:, j] - out[:, a:j] @ r[a:j, j]) / r[j, j]
    return out


def gram(rows: DataFrame, d: int, made, width: int) -> np.ndarray:
    """The sum over all rows of z' z, z being what ``made`` makes of whole numbers; z has ``width`` columns.

    Each task sends its sums, one row for each row of the matrix; Spark adds them.
    """

    def partial(batches):
        total = np.zeros((width, width))
        for batch in batches:
            z = made(whole(batch, d)[0])
            total += z.T @ z
        if total.any():
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(width), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], ["i", "sums"])

    parts = rows.select("v").mapInArrow(partial, "i int, sums array<double>")
    added = parts.select("i", F.posexplode("sums").alias("j", "part")).groupBy("i", "j").agg(F.sum("part").alias("part"))
    out = np.zeros((width, width))
    for i, j, part in added.collect():
        out[i, j] = part
    return (out + out.T) / 2


def centre(rows: DataFrame, d: int) -> Centre:
    def partial(batches):
        n, sums = 0, [0] * d
        for batch in batches:
            x, _ = whole(batch, d)
            n += len(x)
            # Sums of a batch stay below 2^63; those of a task are numbers of any length.
            sums = [s + int(more) for s, more in zip(sums, x.sum(axis=0), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(range(-1, d), pa.int32()), pa.array([str(s) for s in [n, *sums]], pa.string())], ["j", "part"])

    parts = rows.select("v").mapInArrow(partial, "j int, part string")
    found = {j: int(s) for j, s in parts.groupBy("j").agg(F.sum(F.col("part").cast("decimal(38,0)")).alias("s")).collect()}
    return Centre(found[-1], [found[j] for j in range(d)])


@dataclass
class Whitening:
    """What whitens a row: the centre, unit components as columns, and their eigenvalues, by falling eigenvalue."""

    d: int
    centre: Centre
    components: np.ndarray
    values: np.ndarray
    trace: float
    identity_error: float = 0.0

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return self.centre.centred(x) @ self.components / np.sqrt(self.values)


def fit(rows: DataFrame, components: int) -> Whitening | None:
    """The whitening of (id, v), or None where no row takes part or none differs from another."""
    small_batches(rows.sparkSession)
    length = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if length is None:
        return None
    d = length["d"]
    middle = centre(rows, d)
    factors: list[np.ndarray] = []

    def orthogonal(x):
        z = middle.centred(x)
        for r in factors:
            z = solve(z, r)
        return z

    product = np.eye(d)
    for turn in range(PASSES):
        g = gram(rows, d, orthogonal, d)
        if not g.any():
            return None
        if turn and np.abs(g - np.eye(d)).max() < CLOSE:
            break
        shift = 0.0 if turn else 11 * (d + 1) * d * np.finfo(float).eps * np.trace(g)
        while True:
            try:
                r = np.linalg.cholesky(g + shift * np.eye(d)).T
                break
            except np.linalg.LinAlgError:
                shift = max(2 * shift, d * np.finfo(float).eps * np.trace(g))
        factors.append(r)
        product = r @ product
    _, sigma, v = np.linalg.svd(product)
    values = sigma**2 / middle.n
    keep = min(components, int((values > NOTHING * values.sum()).sum()))
    found = Whitening(d, middle, np.ascontiguousarray(v[:keep].T), values[:keep], float(values.sum()))
    # The mean of whitened rows is zero but for rounding; a last column of ones measures it.
    g = gram(rows, d, lambda x: np.column_stack((found.whitened(x), np.ones(len(x)))), keep + 1) / middle.n
    mean = g[:-1, -1]
    found.identity_error = float(np.abs(g[:-1, :-1] - np.outer(mean, mean) - np.eye(keep)).max())
    return found


def whiten(embeddings: DataFrame, components: int = 32, vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: each row along the first components."""
    spark = embeddings.sparkSession
    rows = valid(embeddings, vector, key)
    found = fit(rows, components)
    shared = spark.sparkContext.broadcast(found)
    fields = [("vec_id", pa.int64()), ("component", pa.int32()), ("n", pa.int64()), ("deviation", pa.int64()), ("whitened", pa.float64()), ("explained", pa.float64()), ("identity_error", pa.float64())]

    def run(batches):
        w = shared.value
        for batch in batches if w is not None else ():
            x, mask = whole(batch, w.d)
            k = len(w.values)
            ids, deviation = batch.column(0).filter(pa.array(mask)), w.centre.deviations(x)
            row = pa.array(np.repeat(np.arange(len(x)), k))
            component = np.tile(np.arange(k), len(x))
            arrays = [
                ids.take(row), pa.array(component + 1, pa.int32()), pa.array(np.full(len(row), w.centre.n)), deviation.take(row),
                pa.array(w.whitened(x).ravel()), pa.array((w.values / w.trace)[component]), pa.array(np.full(len(row), w.identity_error)),
            ]
            yield pa.RecordBatch.from_arrays(arrays, schema=pa.schema(fields))

    return rows.mapInArrow(run, "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")
