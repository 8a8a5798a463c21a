"""Dense matrices in two forms.

Long form (matrix_id, i, j, v), 0-based, one row an element: elementwise operations are joins on position, products a join on
the shared index and a sum, so matrices of any size are spread over the cluster. Row form (matrix_id, a: array<array<double>>):
many small matrices, each factored whole in an Arrow kernel; faults of the data are in a `status` column ("ok", "singular",
"not positive definite"), faults of shape raise. Tile form (matrix_id, bi, bj, block): squares of `size` times `size` cells as
doubles row by row, cells outside the matrix or without a row being 0: products of large matrices move tiles instead of cells."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.functions import ieee
from tidemill.functions.ieee import col
from tidemill.operators.series import key_runs

LONG = ["matrix_id", "i", "j", "v"]
#: Rows and columns of a tile: 128 KB.
SIZE = 128
#: Tiles that a task adds up before it hands them on.
HELD = 256

# Making


def new(spark: SparkSession, matrix_id: int, rows: int, cols: int, value: float = 0.0) -> DataFrame:
    """Zeros, or another constant."""
    if rows < 0 or cols < 0:
        raise ValueError("negative size")
    cells = spark.range(rows).select(F.col("id").cast("int").alias("i"), F.explode(F.sequence(F.lit(0), F.lit(cols - 1))).alias("j")) if cols else spark.range(0).select(F.lit(0).alias("i"), F.lit(0).alias("j"))
    return cells.select(F.lit(matrix_id).cast("long").alias("matrix_id"), "i", "j", F.lit(float(value)).alias("v"))


def identity(spark: SparkSession, matrix_id: int, n: int) -> DataFrame:
    return new(spark, matrix_id, n, n).withColumn("v", F.when(F.col("i") == F.col("j"), 1.0).otherwise(0.0))


def from_rows(df: DataFrame, data: str, rows: int, cols: int) -> DataFrame:
    """Long form of a row-major array column; another length than rows * cols is an error."""
    checked = F.when(F.size(data) == rows * cols, F.col(data)).otherwise(F.raise_error(F.lit("length isn't rows * cols")))
    at = df.select("matrix_id", F.posexplode(checked).alias("p", "v"))
    return at.select("matrix_id", F.floor(F.col("p") / cols).cast("int").alias("i"), (F.col("p") % cols).cast("int").alias("j"), F.col("v").cast("double").alias("v"))


def to_arrays(m: DataFrame) -> DataFrame:
    """Row form of matrices that are small enough for one value each."""
    rows = m.groupBy("matrix_id", "i").agg(F.array_sort(F.collect_list(F.struct("j", "v"))).alias("r"))
    cells = rows.select("matrix_id", F.struct("i", F.transform("r", lambda c: c["v"]).alias("r")).alias("r"))
    return cells.groupBy("matrix_id").agg(F.transform(F.array_sort(F.collect_list("r")), lambda r: r["r"]).alias("a"))


def to_long(df: DataFrame, a: str = "a") -> DataFrame:
    rows = df.select("matrix_id", F.posexplode(a).alias("i", "r"))
    return rows.select("matrix_id", "i", F.posexplode("r").alias("j", "v"))


# Elements


def at(m: DataFrame, i: int, j: int) -> DataFrame:
    return m.where((F.col("i") == i) & (F.col("j") == j)).select("matrix_id", "v")


def set_(m: DataFrame, i: int, j: int, v: float) -> DataFrame:
    return m.withColumn("v", F.when((F.col("i") == i) & (F.col("j") == j), float(v)).otherwise(F.col("v")))


def row(m: DataFrame, i: int) -> DataFrame:
    return m.where(F.col("i") == i).select("matrix_id", "j", "v")


def fill(m: DataFrame, v: float) -> DataFrame:
    return m.withColumn("v", F.lit(float(v)))


def clone(m: DataFrame) -> DataFrame:
    """DataFrames don't change, so a copy is the same."""
    return m


copy = clone


def is_square(m: DataFrame) -> DataFrame:
    return m.groupBy("matrix_id").agg((F.max("i") == F.max("j")).alias("is_square"))


# Elementwise


def _paired(a: DataFrame, b: DataFrame, f: Callable[[Column, Column], Column]) -> DataFrame:
    other = b.withColumnRenamed("v", "w")
    return a.join(other, ["matrix_id", "i", "j"]).select("matrix_id", "i", "j", f(F.col("v"), F.col("w")).alias("v"))


def add(a: DataFrame, b: DataFrame) -> DataFrame:
    return _paired(a, b, lambda x, y: x + y)


def sub(a: DataFrame, b: DataFrame) -> DataFrame:
    return _paired(a, b, lambda x, y: x - y)


def scale(a: DataFrame, alpha: float) -> DataFrame:
    return a.withColumn("v", F.col("v") * float(alpha))


def transpose(m: DataFrame) -> DataFrame:
    return m.select("matrix_id", F.col("j").alias("i"), F.col("i").alias("j"), "v")


# Products and sums


def mul(a: DataFrame, b: DataFrame) -> DataFrame:
    """Products meet by the shared index; partial sums go before the second shuffle."""
    left = a.select("matrix_id", "i", F.col("j").alias("k"), "v")
    right = b.select("matrix_id", F.col("i").alias("k"), "j", F.col("v").alias("w"))
    return left.join(right, ["matrix_id", "k"]).groupBy("matrix_id", "i", "j").agg(F.sum(F.col("v") * F.col("w")).alias("v"))


_TILE = ["matrix_id", "bi", "bj"]
_TILES = "matrix_id long, bi long, bj long, block binary"


def _tiles(sums: dict[tuple[int, int, int], np.ndarray]) -> pa.RecordBatch:
    keys = [pa.array([k[c] for k in sums], pa.int64()) for c in range(3)]
    return pa.RecordBatch.from_arrays([*keys, pa.array([v.tobytes() for v in sums.values()], pa.binary())], [*_TILE, "block"])


def to_tiles(m: DataFrame, size: int = SIZE) -> DataFrame:
    """Tile form of a long form; repeated cells are added."""
    cells = m.select(F.col("matrix_id").cast("long").alias("matrix_id"), *[F.floor(F.col(p) / size).cast("long").alias(f"b{p}") for p in "ij"], (F.pmod("i", F.lit(size)) * size + F.pmod("j", F.lit(size))).cast("long").alias("p"), F.col("v").cast("double").alias("v"))

    def gather(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, block = None, np.zeros(size * size)
        for batch, runs in key_runs(batches, _TILE):
            p, v = batch.column("p").to_numpy(), batch.column("v").to_numpy(zero_copy_only=False)
            for fresh, first, end in runs:
                if fresh:
                    if key is not None:
                        yield _tiles({key: block})
                    key, block = tuple(batch.column(c)[first].as_py() for c in _TILE), np.zeros(size * size)
                np.add.at(block, p[first:end], v[first:end])
        if key is not None:
            yield _tiles({key: block})

    return cells.repartition(*_TILE).sortWithinPartitions(*_TILE).mapInArrow(gather, _TILES)


def from_tiles(tiles: DataFrame, rows: int | None = None, cols: int | None = None, size: int = SIZE) -> DataFrame:
    """Long form of the cells of tiles, up to the given numbers of rows and columns."""

    def cells(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for m, bi, bj, block in zip(*[batch.column(c).to_pylist() for c in (*_TILE, "block")], strict=True):
                i, j = (x.ravel() for x in np.indices((size, size)))
                i, j = i + bi * size, j + bj * size
                kept = (i < (rows if rows is not None else i + 1)) & (j < (cols if cols is not None else j + 1))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(kept.sum(), m)), pa.array(i[kept]), pa.array(j[kept]), pa.array(np.frombuffer(block)[kept])], LONG)

    return tiles.mapInArrow(cells, "matrix_id long, i long, j long, v double")


def mul_tiles(a: DataFrame, b: DataFrame, size: int = SIZE) -> DataFrame:
    """The product of matrices in tile form. Tiles meet by the shared index; a task adds up its products tile by tile before it
    hands them on, so that a long shared index, such as the rows of a table, gives few tiles for each task."""
    left = a.select("matrix_id", "bi", F.col("bj").alias("k"), F.col("block").alias("x"))
    right = b.select("matrix_id", F.col("bi").alias("k"), "bj", F.col("block").alias("y"))

    def products(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int, int], np.ndarray] = {}
        for batch in batches:
            for *key, x, y in zip(*[batch.column(c) for c in (*_TILE, "x", "y")], strict=True):
                at = tuple(k.as_py() for k in key)
                made = np.frombuffer(x.as_buffer()).reshape(size, size) @ np.frombuffer(y.as_buffer()).reshape(size, size)
                sums[at] = sums[at] + made if at in sums else made
                if len(sums) > HELD:
                    yield _tiles(sums)
                    sums = {}
        if sums:
            yield _tiles(sums)

    def added(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, total = None, None
        for batch, runs in key_runs(batches, _TILE):
            for fresh, first, end in runs:
                if fresh:
                    if key is not None:
                        yield _tiles({key: total})
                    key, total = tuple(batch.column(c)[first].as_py() for c in _TILE), np.zeros((size, size))
                for k in range(first, end):
                    total = total + np.frombuffer(batch.column("block")[k].as_buffer()).reshape(size, size)
        if key is not None:
            yield _tiles({key: total})

    partial = left.join(right, ["matrix_id", "k"]).select(*_TILE, "x", "y").mapInArrow(products, _TILES)
    return partial.repartition(*_TILE).sortWithinPartitions(*_TILE).mapInArrow(added, _TILES)


def mul_vec(a: DataFrame, x: DataFrame) -> DataFrame:
    """x: (matrix_id, j, x). Gives (matrix_id, i, v)."""
    return a.join(x, ["matrix_id", "j"]).groupBy("matrix_id", "i").agg(F.sum(F.col("v") * F.col("x")).alias("v"))


def dot(x: str, y: str) -> Column:
    return F.coalesce(F.sum(col(x) * col(y)), F.lit(0.0))


def axpy(alpha: float, x: str, y: str) -> Column:
    return float(alpha) * col(x) + col(y)


def norm2(x: str) -> Column:
    return F.sqrt(F.coalesce(F.sum(col(x) * col(x)), F.lit(0.0)))


def norm_inf(m: DataFrame) -> DataFrame:
    """Largest sum of a row's absolute values; rows with NaN are ignored."""
    sums = m.groupBy("matrix_id", "i").agg(F.sum(F.abs("v")).alias("s"))
    return sums.groupBy("matrix_id").agg(F.coalesce(F.max(F.when(~F.isnan("s"), F.col("s"))), F.lit(0.0)).alias("norm_inf"))


def trace(m: DataFrame) -> DataFrame:
    square = F.max("i") == F.max("j")
    return m.groupBy("matrix_id").agg(F.when(square, F.sum(F.when(F.col("i") == F.col("j"), F.col("v")).otherwise(0.0))).otherwise(F.raise_error(F.lit("not square"))).alias("trace"))


def is_symmetric(m: DataFrame, tolerance: float) -> DataFrame:
    """|a - b| <= tolerance * max(1, |a|, |b|) for all mirrored elements; NaN passes, another shape than square doesn't."""
    mirrored = m.join(transpose(m).withColumnRenamed("v", "w"), ["matrix_id", "i", "j"], "left")
    far = ieee.gt(F.abs(F.col("v") - F.col("w")), tolerance * F.greatest(F.lit(1.0), F.abs("v"), F.abs("w")))
    return mirrored.groupBy("matrix_id").agg(((F.max("i") == F.max("j")) & ~F.coalesce(F.bool_or(far), F.lit(False))).alias("is_symmetric"))


# Factorisations of small matrices


def _kernel(df: DataFrame, inputs: list[str], outputs: str, f: Callable[..., tuple]) -> DataFrame:
    """f(arrays of one row) gives the outputs' values; all other columns but the inputs stay."""
    names = [o.split()[0] for o in outputs.split(", ")]
    kept = [c for c in df.columns if c not in inputs]
    schema = ", ".join([*[f"`{x.name}` {x.dataType.simpleString()}" for x in df.schema.fields if x.name in kept], outputs])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = pa.Table.from_batches([batch])
            rows = [f(*[np.array(v, np.float64) for v in values]) for values in zip(*[table[c].to_pylist() for c in inputs], strict=True)]
            types = [pa.string() if o.split()[1] == "string" else pa.bool_() if o.split()[1] == "boolean" else pa.list_(pa.float64()) if o.split()[1] == "array<double>" else pa.list_(pa.list_(pa.float64())) for o in outputs.split(", ")]
            made = [pa.array([r[k].tolist() if isinstance(r[k], np.ndarray) else r[k] for r in rows], t) for k, t in enumerate(types)]
            yield pa.RecordBatch.from_arrays([*[table[c].combine_chunks() for c in kept], *made], [*kept, *names])

    return df.mapInArrow(run, schema)


def _square(a: np.ndarray) -> None:
    if a.ndim != 2 or a.shape[0] != a.shape[1]:
        raise ValueError("not square")


def _solved(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray | None, str]:
    _square(a)
    try:
        return np.linalg.solve(a, b), "ok"
    except np.linalg.LinAlgError:
        return None, "singular"


def solve(df: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """x with a x = b, and status."""
    return _kernel(df, [a, b], "x array<double>, status string", _solved)


def inverse(df: DataFrame, a: str = "a") -> DataFrame:
    return _kernel(df, [a], "inverse array<array<double>>, status string", lambda m: _solved(m, np.eye(len(m))))


def _lower(m: np.ndarray) -> tuple[np.ndarray | None, str]:
    _square(m)
    low = np.tril(m)
    try:
        out = np.linalg.cholesky(low + np.tril(low, -1).T)
    except np.linalg.LinAlgError:
        return None, "not positive definite"
    return (out, "ok") if np.isfinite(out).all() else (None, "not positive definite")


def cholesky(df: DataFrame, a: str = "a") -> DataFrame:
    """The lower factor; only the lower triangle is read."""
    return _kernel(df, [a], "l array<array<double>>, status string", _lower)


def _forward(low: np.ndarray, b: np.ndarray) -> np.ndarray:
    """x with low x = b for a lower triangle."""
    x = np.empty(len(b))
    for i in range(len(b)):
        x[i] = (b[i] - low[i, :i] @ x[:i]) / low[i, i]
    return x


def _backward(up: np.ndarray, b: np.ndarray) -> np.ndarray:
    """x with up x = b for an upper triangle."""
    return _forward(up[::-1, ::-1], b[::-1])[::-1]


def _substituted(low: np.ndarray, b: np.ndarray) -> tuple[np.ndarray]:
    return (_backward(low.T, _forward(low, b)),)


def cholesky_solve(df: DataFrame, l: str = "l", b: str = "b") -> DataFrame:
    return _kernel(df, [l, b], "x array<double>", _substituted)


def _qr(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if a.shape[0] < a.shape[1]:
        raise ValueError("fewer rows than columns")
    return np.linalg.qr(a)


def qr(df: DataFrame, a: str = "a") -> DataFrame:
    """Thin: q with orthonormal columns, r upper triangular."""
    return _kernel(df, [a], "q array<array<double>>, r array<array<double>>", _qr)


def _fitted(r: np.ndarray, qb: np.ndarray, m: int, norm: float) -> tuple[np.ndarray | None, str]:
    n = r.shape[1]
    if (np.abs(np.diag(r)) <= max(m, n) * np.finfo(float).eps * norm).any() or len(r) < n:
        return None, "singular"
    return _backward(r, qb), "ok"


def _least(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray | None, str]:
    q_, r = _qr(a)
    return _fitted(r, q_.T @ b, a.shape[0], float(np.linalg.norm(a)))


def least_squares(df: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    return _kernel(df, [a, b], "x array<double>, status string", _least)


def _reduced(a: np.ndarray) -> np.ndarray:
    return np.linalg.qr(a, mode="r") if len(a) > a.shape[1] else a


def least_squares_tall(rows: DataFrame, keys: list[str], x: list[str], y: str) -> DataFrame:
    """keys, coefficients, status: the fit of y on columns x over any number of rows. Each batch is reduced to a triangle
    of len(x) + 1 rows before the shuffle, and the triangles of a key are merged: what moves doesn't grow with the rows."""
    names = [*x, y]
    width = len(names)
    typed = rows.select(*keys, *[F.col(c).cast("double").alias(f"_x{k}") for k, c in enumerate(names)])
    key_fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in typed.schema.fields[: len(keys)])
    schema = ", ".join(p for p in (key_fields, "triangle array<double>, n long, square double") if p)

    def reduce(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = pa.Table.from_batches([batch])
            own = list(zip(*[table[k].to_pylist() for k in keys], strict=True)) if keys else [()] * table.num_rows
            data = np.column_stack([table[f"_x{k}"].to_numpy() for k in range(width)]) if table.num_rows else np.zeros((0, width))
            order: dict[tuple, list[int]] = {}
            for i, k in enumerate(own):
                order.setdefault(k, []).append(i)
            parts = {k: data[v] for k, v in order.items()}
            columns = [pa.array([k[c] for k in parts], table.schema.field(name).type) for c, name in enumerate(keys)]
            triangles = pa.array([_reduced(d).ravel().tolist() for d in parts.values()], pa.list_(pa.float64()))
            sizes = pa.array([len(d) for d in parts.values()], pa.int64())
            squares = pa.array([float((d[:, :-1] ** 2).sum()) for d in parts.values()], pa.float64())
            yield pa.RecordBatch.from_arrays([*columns, triangles, sizes, squares], [*keys, "triangle", "n", "square"])

    def merge(table: pa.Table) -> pa.Table:
        stacked = np.vstack([np.array(t).reshape(-1, width) for t in table["triangle"].to_pylist()])
        r = _reduced(stacked)
        m, norm = sum(table["n"].to_pylist()), sum(table["square"].to_pylist()) ** 0.5
        found, status = _fitted(r[: width - 1, :-1], r[: width - 1, -1], m, norm)
        made = [pa.array([found.tolist() if found is not None else None], pa.list_(pa.float64())), pa.array([status])]
        return pa.Table.from_arrays([*[table[k].combine_chunks().slice(0, 1) for k in keys], *made], [*keys, "coefficients", "status"])

    out = ", ".join(p for p in (key_fields, "coefficients array<double>, status string") if p)
    return typed.mapInArrow(reduce, schema).groupBy(*keys).applyInArrow(merge, out)


def _eigen(m: np.ndarray, tolerance: float) -> tuple[np.ndarray | None, np.ndarray | None, bool]:
    if not m.size:
        return np.zeros(0), np.zeros((0, 0)), True
    _square(m)
    m = (m + m.T) / 2
    try:
        values, vectors = np.linalg.eigh(m)
    except np.linalg.LinAlgError:
        return None, None, False
    rotated = vectors.T @ m @ vectors
    left, kept = float((np.triu(rotated, 1) ** 2).sum()), float((np.diag(rotated) ** 2).sum())
    return values, vectors, left <= tolerance * kept or left == 0


def eigen_sym(df: DataFrame, a: str = "a", tolerance: float = 0.0) -> DataFrame:
    """values (ascending), vectors (as columns) and converged of symmetric matrices: whether the squares that the vectors
    leave off the diagonal come to at most `tolerance` of those on it. A tolerance of 0 or less stands for 1e-24."""
    limit = tolerance if tolerance > 0 else 1e-24
    return _kernel(df, [a], "values array<double>, vectors array<array<double>>, converged boolean", lambda m: _eigen(m, limit))
