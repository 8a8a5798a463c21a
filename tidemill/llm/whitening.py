"""Embedding whitening by LOBPCG: eigenvectors of a covariance matrix that is never formed, from products of it with blocks of
vectors, each a pass over the centred rows.

Entries become integers, whose sums are exact, and rows are centred before anything is multiplied. A step of LOBPCG holds
three blocks: the iterate X, its residuals R and the previous direction P. Their span is made orthonormal, the covariance is
projected on it (Rayleigh-Ritz), and the best vectors of the span are the next iterate. Only the product with R needs the
rows; those with X and P follow by the same combinations. When the residuals of the wanted vectors are small, one more pass
multiplies X anew, and only residuals of that product count: they bound the distance to eigenvalues, so results are
certified or an error is raised. A block is a few vectors wider than asked for. Where three blocks span the whole space, as
with 64 dimensions and 32 components, two steps are exact.

Tasks reduce their rows to a block of dimensions x vectors; Spark sums these by dimension, and the driver gets one such
block a pass, whose size doesn't depend on the rows.

Rows whose vector is null, has no entries or holds null or non-finite entries are dropped. Vectors of different lengths have no
common covariance and raise ValueError. Rows with null or repeated ids count and come back like any others. Directions without
spread (eigenvalues below 1e-12 of the trace, so all of a table of equal vectors) have no whitened values and are left out; an
empty table gives no rows. Of equal eigenvalues any basis is taken. Columns but id and vector are ignored."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.llm._shared import pick


def integers(df: DataFrame, id: str, vector: str, scale: float, shift: int) -> DataFrame:
    """(id, x array<long>): floor(scale * entry) + shift of the rows that count."""
    entries = F.col(vector).cast("array<double>")
    good = F.forall(entries, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    rows = df.where(F.col(vector).isNotNull() & (F.size(vector) > 0) & good)
    return rows.select(F.col(id).alias("id"), F.transform(entries, lambda c: F.floor(c * F.lit(float(scale))) + F.lit(shift).cast("long")).alias("x"))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


@dataclass
class Centre:
    """Number of rows and exact sums of each dimension."""

    n: int
    sums: list[int]

    def deviations(self, x: np.ndarray) -> np.ndarray:
        """x - sums / n: the whole part is taken off in integers."""
        whole, part = zip(*[divmod(s, self.n) for s in self.sums], strict=True)
        return (x - np.array(whole, np.int64)) - np.array([p / self.n for p in part])

    def squares(self, x: np.ndarray) -> np.ndarray:
        """The sum over dimensions of (n * x - sums)**2, exact; raises OverflowError where that is no long."""
        whole, part = zip(*[divmod(s, self.n) for s in self.sums], strict=True)
        near = x - np.array(whole, np.int64)
        most = self.n * (int(np.abs(near).max(initial=0)) + 1)
        if most * most * x.shape[1] < 2**63:
            return ((self.n * near - np.array(part, np.int64)) ** 2).sum(axis=1)
        exact = ((self.n * near.astype(object) - np.array(part, object)) ** 2).sum(axis=1)
        return np.array([int(v) for v in exact], np.int64)


def centre(rows: DataFrame) -> Centre | None:
    """None for an empty table."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for batch in batches:
            column = pick(batch, "x")
            if batch.num_rows:
                lengths = np.unique(pa.compute.list_value_length(column).to_numpy(zero_copy_only=False))
                if len(lengths) > 1:
                    raise ValueError(f"vectors of different lengths: {lengths[:2].tolist()}")
                x = _matrix(column)
                # Halves of the bits apart, as a sum of many longs may be none.
                high, low = (x >> 20).sum(axis=0), (x & 0xFFFFF).sum(axis=0)
                own = held.setdefault(x.shape[1], [0, 0, 0])
                own[0] += len(x)
                own[1], own[2] = own[1] + high.astype(object), own[2] + low.astype(object)
        for d, (n, high, low) in held.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([d] * d, pa.int32()), pa.array(range(d), pa.int32()), pa.array([n] * d, pa.int64()), pa.array(high.tolist(), pa.int64()), pa.array(low.tolist(), pa.int64())],
                ["d", "dim", "n", "high", "low"],
            )

    summed = rows.mapInArrow(run, "d int, dim int, n long, high long, low long").groupBy("d", "dim")
    found = summed.agg(F.sum("n").alias("n"), *[F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("high", "low")]).sort("d", "dim").collect()
    if len({r.d for r in found}) > 1:
        raise ValueError(f"vectors of different lengths: {sorted({r.d for r in found})[:2]}")
    return Centre(found[0].n, [(int(r.high) << 20) + int(r.low) for r in found]) if found else None


def summed_blocks(rows: DataFrame, block: Callable[[np.ndarray], np.ndarray], shape: tuple[int, int]) -> np.ndarray:
    """The sum over all rows of block(x), a matrix of the given shape: summed in each task, then by its rows in Spark."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape)
        for batch in batches:
            if batch.num_rows:
                total += block(_matrix(pick(batch, "x")))
        values = pa.array(list(total), pa.list_(pa.float64()))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(shape[0], dtype=np.int32)), values], ["at", "p"])

    partial = rows.mapInArrow(run, "at int, p array<double>")
    found = partial.groupBy("at").agg(F.array(*[F.sum(F.col("p")[j]) for j in range(shape[1])]).alias("p")).sort("at").collect()
    return np.array([r.p for r in found]) if found else np.zeros(shape)


def _orthonormal(block: np.ndarray, against: list[np.ndarray], least: float = 1e-10) -> np.ndarray:
    """An orthonormal basis of what block has beside `against`, twice, as once leaves rounding errors."""
    norms = np.linalg.norm(block, axis=0)
    block = block[:, norms > 0] / norms[norms > 0]
    for _ in range(2):
        for q in against:
            block = block - q @ (q.T @ block)
        if not block.size:
            return block
        u, s, _ = np.linalg.svd(block, full_matrices=False)
        block = u[:, s > least]
    return block


def lobpcg(product: Callable[[np.ndarray], np.ndarray], d: int, k: int, tolerance: float = 1e-11, guard: int = 8, limit: int = 500) -> tuple[np.ndarray, np.ndarray]:
    """The k largest eigenvalues of a symmetric positive matrix, falling, and their unit vectors as columns, from products with
    blocks. Residuals are at most `tolerance` of the largest eigenvalue, in a product made for that alone."""
    m = min(d, k + guard)
    x = _orthonormal(np.random.default_rng(7).standard_normal((d, m)), [])
    ax = product(x)
    p = ap = np.zeros((d, 0))
    fresh = True
    for _ in range(limit):
        values, turn = np.linalg.eigh((x.T @ ax + ax.T @ x) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        x, ax = x @ turn, ax @ turn
        rest = ax - x * values
        norms = np.linalg.norm(rest, axis=0)
        if (norms[:k] <= tolerance * max(values[0], 0.0)).all():
            if fresh:
                return values[:k], x[:, :k]
            x = np.linalg.qr(x)[0]
            ax, fresh = product(x), True
            continue
        r = _orthonormal(rest[:, norms > tolerance * abs(values[0]) / 10], [x])
        if not r.shape[1]:
            r = _orthonormal(np.random.default_rng(11).standard_normal((d, min(m, d - m))), [x])
        if p.shape[1]:  # previous directions, made orthonormal along with their products
            for q, aq in ((x, ax), (r, None)):
                share = q.T @ p
                p = p - q @ share
                ap = ap - aq @ share if aq is not None else ap
                if aq is None:
                    share_r = share
        ar = product(r) if r.shape[1] else np.zeros((d, 0))
        if p.shape[1]:
            ap = ap - ar @ share_r
            u, s, v = np.linalg.svd(p, full_matrices=False)
            use = s > 1e-6 * max(s.max(initial=0.0), 1e-300)
            p, ap = u[:, use], ap @ (v[use].T / s[use])
        span, images = np.hstack([x, r, p]), np.hstack([ax, ar, ap])
        small = span.T @ images
        gram = span.T @ span
        root = np.linalg.cholesky((gram + gram.T) / 2)
        inner = np.linalg.solve(root, np.linalg.solve(root, (small + small.T) / 2).T)
        _, turn = np.linalg.eigh((inner + inner.T) / 2)
        turn = np.linalg.solve(root.T, turn[:, ::-1][:, :m])
        x, ax = span @ turn, images @ turn
        p, ap = span[:, m:] @ turn[m:], images[:, m:] @ turn[m:]
        fresh = False
    raise RuntimeError(f"residuals of {float(norms[:k].max() / values[0]):.1e} after {limit} steps; {tolerance:.0e} is asked for")


@dataclass
class Whitening:
    """A fitted whitening: centre, eigenvalues (falling), unit eigenvectors as columns, trace of the covariance, and the largest
    entry by which the covariance of the whitened fit rows differs from the identity."""

    centre: Centre
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    identity_error: float = float("nan")

    def whiten(self, x: np.ndarray) -> np.ndarray:
        return self.centre.deviations(x) @ self.vectors / np.sqrt(self.values)


def fit_whitening(rows: DataFrame, components: int = 32, tolerance: float = 1e-11) -> Whitening | None:
    """From (id, x): None for an empty table."""
    middle = centre(rows)
    if middle is None:
        return None
    d = len(middle.sums)

    def product(w: np.ndarray) -> np.ndarray:
        def block(x: np.ndarray) -> np.ndarray:
            y = middle.deviations(x)
            return y.T @ (y @ w)

        return summed_blocks(rows, block, (d, w.shape[1])) / middle.n

    trace = float(summed_blocks(rows, lambda x: (middle.deviations(x) ** 2).sum(axis=0, keepdims=True), (1, d)).sum()) / middle.n
    if not trace > 0:
        return Whitening(middle, np.zeros(0), np.zeros((d, 0)), trace)
    values, vectors = lobpcg(product, d, min(components, d), tolerance)
    spread = values > 1e-12 * trace
    values, vectors = values[spread], vectors[:, spread]
    vectors = vectors * np.where(vectors[np.abs(vectors).argmax(axis=0), np.arange(len(values))] < 0, -1.0, 1.0)
    model = Whitening(middle, values, vectors, trace)

    def moments(x: np.ndarray) -> np.ndarray:
        z = model.whiten(x)
        return np.vstack([z.T @ z, z.sum(axis=0)])

    k = len(values)
    found = summed_blocks(rows, moments, (k + 1, k)) / middle.n
    model.identity_error = float(np.abs(found[:k] - np.outer(found[k], found[k]) - np.eye(k)).max(initial=0.0))
    return model


def whitened_rows(rows: DataFrame, model: Whitening | None) -> DataFrame:
    """(id, component from 1, n, deviation, whitened, explained, identity_error) for each row and component."""
    schema = "id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if model is None or not len(model.values):
        return rows.sparkSession.createDataFrame([], schema)
    k, share = len(model.values), model.values / model.trace

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 4096):
                batch = whole.slice(at, 4096)
                x, m = _matrix(pick(batch, "x")), batch.num_rows
                ids = pick(batch, "id").cast(pa.int64()).take(pa.array(np.repeat(np.arange(m), k)))
                columns = [np.tile(np.arange(1, k + 1, dtype=np.int32), m), np.full(m * k, model.centre.n), np.repeat(model.centre.squares(x), k), model.whiten(x).ravel(), np.tile(share, m), np.full(m * k, model.identity_error)]
                yield pa.RecordBatch.from_arrays([ids, *[pa.array(c) for c in columns]], [f.split()[0] for f in schema.split(", ")])

    return rows.mapInArrow(run, schema)


def whiten(df: DataFrame, id: str = "vec_id", vector: str = "embedding", components: int = 32, scale: float = 64.0, shift: int = 1_000_000, tolerance: float = 1e-11) -> DataFrame:
    """Fits on all rows of df and returns whitened_rows of them, the id under its own name."""
    rows = integers(df, id, vector, scale, shift)
    return whitened_rows(rows, fit_whitening(rows, components, tolerance)).withColumnRenamed("id", id)
