"""Whitening of embeddings along their leading principal components, found by LOBPCG.

The covariance matrix is never formed: each iteration multiplies it with a
block of columns, as a sum over centred rows, (X - m)' ((X - m) Q) / n, to
which each task contributes one small matrix. The block is the orthonormal
basis of the current iterate, its residuals and the previous direction
(Rayleigh-Ritz on these three); as many components as are wanted are certified
when each residual |V u - e u| is at most TOLERANCE times the largest
eigenvalue. Only matrices of dimension x block reach the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.shared import discard, written

#: Values are floored at this many steps a unit.
SCALE = 256
COMPONENTS = 4
#: Columns of the iterate: those wanted and as many more as make the last of them converge fast.
BLOCK = 24
TOLERANCE = 1e-12
MAX_ITERATIONS = 1000
#: A component of less than this share of the trace is none: nothing can be scaled to variance one along it.
_NOTHING = 1e-12


@dataclass
class Whitening:
    n: int
    sums: np.ndarray  # exact, of each dimension
    vectors: np.ndarray  # dimension x components, unit columns
    values: np.ndarray  # eigenvalues, falling
    trace: float
    residuals: np.ndarray  # relative to the largest eigenvalue
    iterations: int
    identity_error: float

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums.tolist()])


def quantised(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, dim, x for rows whose vector and entries are all there and finite: x holds floor(256 c) as little-endian longs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, lists = batch.columns
            flat = lists.flatten()
            sizes = lists.value_lengths().fill_null(0).to_numpy().astype(np.int64)
            value = flat.cast(pa.float64()).fill_null(float("nan")).to_numpy(zero_copy_only=False)
            bounds = np.concatenate([[0], np.cumsum(sizes)])
            bad = np.concatenate([[0], np.cumsum(~np.isfinite(value))])
            good = np.flatnonzero(lists.is_valid().to_numpy(zero_copy_only=False) & (bad[bounds[1:]] == bad[bounds[:-1]]))
            edge = float(1 << 62)  # beyond this a floor isn't exact anyway
            x = np.floor(np.clip(np.where(np.isfinite(value), value, 0.0) * SCALE, -edge, edge)).astype("<i8")
            out = [x[bounds[i] : bounds[i + 1]].tobytes() for i in good.tolist()]
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(good)), pa.array(sizes[good], pa.int32()), pa.array(out, pa.binary())], names=["vec_id", "dim", "x"])

    return rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("v")).mapInArrow(run, "vec_id long, dim int, x binary")


def _summed(blocks: DataFrame, task, length: int) -> np.ndarray:
    """Sums over all blocks of what task(x) gives for each, an array of `length` doubles: one row a task, added up by place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(length)
        for batch in batches:
            for rows, block in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                total += task(np.frombuffer(block.as_buffer(), "<i8").reshape(rows, -1))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(length, dtype=np.int32)), pa.array(total)], names=["place", "value"])

    parts = blocks.select("rows", "block").mapInArrow(run, "place int, value double")
    # A row an entry of a matrix of dimension x block.
    got = parts.groupBy("place").agg(F.sum("value").alias("value")).collect()
    out = np.zeros(length)
    for r in got:
        out[r["place"]] = r["value"]
    return out


def _packed(rows: DataFrame) -> DataFrame:
    """Rows of x as blocks of many: rows, block, sums (exact, as text of whole numbers)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            block = b"".join(batch.column(0).to_pylist())
            x = np.frombuffer(block, "<i8").reshape(batch.num_rows, -1)
            low, high = (x & 0xFFFFFFFF).sum(axis=0), (x >> 32).sum(axis=0)
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int32()), pa.array([block], pa.binary()), pa.array([low.tolist()], pa.list_(pa.int64())), pa.array([high.tolist()], pa.list_(pa.int64()))], names=["rows", "block", "low", "high"])

    return rows.select("x").mapInArrow(run, "rows int, block binary, low array<long>, high array<long>")


def _orthonormal(columns: np.ndarray, against: np.ndarray | None) -> np.ndarray:
    """A basis of what the columns add to the space of `against` (orthonormal), dependent directions left out."""
    if against is not None:
        for _ in range(2):
            columns = columns - against @ (against.T @ columns)
    norms = np.linalg.norm(columns, axis=0)
    columns = columns[:, norms > 0] / norms[norms > 0]
    if not columns.shape[1]:
        return columns
    u, s, _ = np.linalg.svd(columns, full_matrices=False)
    u = u[:, s > 1e-8 * s[0]]
    if against is not None:
        for _ in range(2):  # scaling may have lifted rounding errors
            u = u - against @ (against.T @ u)
        u = np.linalg.qr(u)[0]
    return u[:, : columns.shape[0] - (0 if against is None else against.shape[1])]


def lobpcg(multiply, dim: int, wanted: int, block: int = BLOCK, tolerance: float = TOLERANCE, seed: int = 11) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(eigenvalues, vectors, relative residuals, iterations) of the `wanted` largest, of a symmetric matrix known by multiply(columns)."""
    size = min(dim, max(block, wanted))
    x = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, size)))[0]
    basis, best = x, np.inf
    for step in range(1, MAX_ITERATIONS + 1):
        image = multiply(basis)
        small = basis.T @ image
        e, y = np.linalg.eigh((small + small.T) / 2)
        e, y = e[::-1][:size], y[:, ::-1][:, :size]
        new = basis @ y
        residual = image @ y - new * e
        top = max(abs(e[0]), np.finfo(float).tiny)
        off = np.linalg.norm(residual[:, :wanted], axis=0) / top
        if off.max() <= tolerance:
            return e[:wanted], new[:, :wanted], off, step
        best = min(best, off.max())
        # The direction: what the new iterate has beyond the span of the old one.
        direction = new - x @ (x.T @ new)
        x = np.linalg.qr(new)[0]
        basis = np.hstack([x, _orthonormal(residual, x)])
        basis = np.hstack([basis, _orthonormal(direction, basis)])[:, :dim]
    raise ArithmeticError(f"residuals stay at {best:.1e} of the largest eigenvalue, above {tolerance:.1e}")


def fit(x: DataFrame, components: int = COMPONENTS, block: int = BLOCK) -> Whitening | None:
    """Of rows (x) of one dimension, each distinct one counted once. None where nothing varies."""
    packed = written(_packed(x.select("x").distinct()), "vectors")
    half = lambda c: packed.select(F.posexplode(c).alias("place", "v")).groupBy("place").agg(F.sum("v").alias("v")).collect()  # noqa: E731  a row a dimension
    low, high = ({r["place"]: r["v"] for r in half(c)} for c in ("low", "high"))
    if not low:
        discard(packed)
        return None
    n, dim = packed.agg(F.sum("rows")).first()[0], len(low)
    sums = np.array([low[i] + (high[i] << 32) for i in range(dim)], object)
    mean = np.array([s / n for s in sums.tolist()])

    def multiply(q: np.ndarray) -> np.ndarray:
        def task(rows: np.ndarray) -> np.ndarray:
            c = rows - mean
            return (c.T @ (c @ q)).ravel()

        return _summed(packed, task, q.size).reshape(q.shape) / n

    trace = float(_summed(packed, lambda rows: np.array([((rows - mean) ** 2).sum()]), 1)[0]) / n
    if trace <= 0:
        discard(packed)
        return None
    e, u, off, steps = lobpcg(multiply, dim, min(components, dim), block)
    some = int((e > _NOTHING * trace).sum())
    e, u, off = e[:some], u[:, :some], off[:some]
    u = u * np.sign(u[np.abs(u).argmax(axis=0), np.arange(some)])
    w = u / np.sqrt(e)

    def moments(rows: np.ndarray) -> np.ndarray:
        z = (rows - mean) @ w
        return np.concatenate([(z.T @ z).ravel(), z.sum(axis=0)])

    m = _summed(packed, moments, some * some + some) / n
    spread = m[: some * some].reshape(some, some) - np.outer(m[some * some :], m[some * some :])
    discard(packed)
    return Whitening(n, sums, u, e, trace, off, steps, float(np.abs(spread - np.eye(some)).max()))


def _deviations(x: np.ndarray, n: int, sums: np.ndarray) -> list[int]:
    """For each row the exact sum over dimensions of (n x - S)^2."""
    most = float(np.abs(x.astype(np.float64)).max(initial=0)) * n + float(max(map(abs, sums.tolist()), default=0))
    if most * most * x.shape[1] < 2.0**62:
        d = x * n - sums.astype(np.int64)
        return (d * d).sum(axis=1).tolist()
    return [sum((n * v - s) ** 2 for v, s in zip(row, sums.tolist(), strict=True)) for row in x.tolist()]


def whitened(rows: DataFrame, model: Whitening | None) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: a row for each row of (vec_id, x) and component. No shuffle."""
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if model is None:
        return rows.sparkSession.createDataFrame([], schema)
    mean, scaled = model.mean, model.vectors / np.sqrt(model.values)
    k = len(model.values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.frombuffer(b"".join(batch.column(1).to_pylist()), "<i8").reshape(batch.num_rows, -1)
            each = np.repeat(np.arange(batch.num_rows), k)
            deviation = _deviations(x, model.n, model.sums)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(each)),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), batch.num_rows)),
                    pa.array(np.full(len(each), model.n, np.int64)),
                    pa.array([deviation[i] for i in each.tolist()], pa.int64()),
                    pa.array(((x - mean) @ scaled).ravel()),
                    pa.array(np.tile(model.values / model.trace, batch.num_rows)),
                    pa.array(np.full(len(each), model.identity_error)),
                ],
                names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return rows.select("vec_id", "x").mapInArrow(run, schema)


def whiten(rows: DataFrame, components: int = COMPONENTS, block: int = BLOCK, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error for every usable row of rows and component.

    Rows whose vector is null or holds a null, NaN or infinite entry are
    dropped; so are vectors of another length than most have (of equally many,
    the longer). Null ids and repeated rows stay. Components are numbered from
    1 by falling variance, at most as many as there are dimensions; one
    without variance is left out, so a table of one distinct vector, and an
    empty table, give no rows. Of a component the entry of largest size is
    positive; components of equal variance are some orthonormal basis of their
    space. A deviation beyond a long is an error. Other columns take no part.
    """
    usable = written(quantised(rows, id_col, vector_col), "quantised")
    lengths = usable.filter("dim > 0").groupBy("dim").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("dim")).first()
    usable = usable.filter(F.col("dim") == (lengths["dim"] if lengths else 0)).drop("dim")
    return whitened(usable, fit(usable, components, block) if lengths else None)
