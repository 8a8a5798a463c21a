"""Hard-negative mining with a vector-approximation file.

Vectors become integers, floor(scale * entry). Each dimension is cut into cells at quantiles of all rows, and a row's
approximation is its cell in each dimension, a byte each. For an anchor, a table holds for each dimension and cell the least
and the greatest product of the anchor's entry with an entry of that cell; the sums of a row's table entries are a lower and
an upper bound of its score. Only rows whose bounds could still enter a window are scored exactly, in integers.

Two passes over all rows: the first finds each anchor's positives (the best rows of its label), the second, for each positive,
the best rows of other labels whose score lies in the window that the positive's score opens. In either pass rows and anchors
form a grid of tiles: a tile holds up to `anchors` anchors and streams its part of the rows past them, in a number of parts
that follows from the rows, and keeps what it has found best for each window: once there are as many as asked for, the worst of them bounds what may
still enter. Spark ranks what tiles keep. No window is capped, and nothing depends on how rows are dealt.

Rows with a null id, a null label, a null or empty vector, or null or non-finite entries take no part. Vectors are scored
only against those of their own length. Rows with a repeated id are rows of their own, each an anchor if that id is one; a row is never its
own positive, and of rows equal in score and id it doesn't matter which comes first. Entries whose integers are beyond 2**31,
or scores beyond 2**62, raise OverflowError. Without rows, anchors or positives there are no results. Other columns are ignored."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemill.llm._shared import materialize, pick
from tidemill.llm._vectors import binary_rows, finite_vectors, stacked

_LOWEST = np.iinfo(np.int64).min
#: Anchors and rows whose bounds are looked up together, so that sums stay in a processor's cache.
ANCHORS, ROWS = 64, 2048


def _integers(df: DataFrame, scale: float) -> DataFrame:
    """(row, id, label, anchor, size, x: int32 values as bytes)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, x in finite_vectors(pick(batch, "vector")):
                x = np.floor(x * scale)
                if len(x) and not np.abs(x).max() < 2**31:
                    raise OverflowError("an entry's integer is beyond 2**31")
                own = batch.take(pa.array(rows))
                yield pa.RecordBatch.from_arrays(
                    [pick(own, "id"), pick(own, "label"), pick(own, "anchor"), pa.array(np.full(len(x), x.shape[1], np.int32)), binary_rows(x.astype(np.int32))],
                    ["id", "label", "anchor", "size", "x"],
                )

    good = df.where("id is not null and label is not null and vector is not null")
    return good.mapInArrow(run, "id long, label long, anchor boolean, size int, x binary").withColumn("row", F.monotonically_increasing_id())


def cell_bounds(rows: DataFrame, cells: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By vector length: (dimensions, cells) least and greatest integers of each cell. Bounds between cells are quantiles of all
    rows, so that cells hold about as many each; the outermost end at the least and greatest value that occur."""

    def entries(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for size in np.unique(pick(batch, "size").to_numpy()).tolist():
                own = batch.filter(pa.compute.equal(pick(batch, "size"), size))
                x = stacked(pick(own, "x")).view(np.int32)
                columns = [np.full(x.size, size, np.int32), np.tile(np.arange(size, dtype=np.int32), len(x)), x.ravel()]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["size", "dim", "v"])

    cuts = F.percentile_approx("v", [i / cells for i in range(1, cells)], 1000) if cells > 1 else F.array().cast("array<int>")
    each = rows.mapInArrow(entries, "size int, dim int, v int").groupBy("size", "dim")
    found = each.agg(F.min("v").alias("low"), F.max("v").alias("high"), cuts.alias("cuts"))
    out: dict[int, tuple[list, list]] = {}
    for r in found.sort("size", "dim").collect():
        # A cell holds what is above the cut before it, up to its own; cells of equal cuts stay empty, as [cut, cut].
        lows, highs = out.setdefault(r["size"], ([], []))
        lows.append([r.low, *[min(c + 1, r.high) for c in r.cuts]])
        highs.append([*r.cuts, r.high])
    return {k: (np.array(low, np.int64), np.array(high, np.int64)) for k, (low, high) in out.items()}


def approximate(x: np.ndarray, highs: np.ndarray) -> np.ndarray:
    """(rows, dimensions): the cell of each entry."""
    return np.stack([np.searchsorted(highs[j, :-1], x[:, j], "left") for j in range(x.shape[1])], axis=1).astype(np.uint8)


def _approximated(rows: DataFrame, bounds: dict[int, tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for size in np.unique(pick(batch, "size").to_numpy()).tolist():
                own = batch.filter(pa.compute.equal(pick(batch, "size"), size))
                cells = approximate(stacked(pick(own, "x")).view(np.int32), bounds[size][1])
                yield pa.RecordBatch.from_arrays([*own.columns, binary_rows(cells)], [*own.schema.names, "cells"])

    return rows.mapInArrow(run, "id long, label long, anchor boolean, size int, x binary, row long, cells binary")


class Tables:
    """Lookup tables of some anchors: (dimensions, cells, 2 * anchors), least products first, then greatest."""

    def __init__(self, x: np.ndarray, lows: np.ndarray, highs: np.ndarray):
        a = x.T.astype(np.int64)[:, None, :]
        one, other = a * lows[:, :, None], a * highs[:, :, None]
        most = int(np.maximum(np.abs(one), np.abs(other)).max(axis=(1, 2), initial=0).astype(object).sum())
        if most >= 2**62:
            raise OverflowError("scores beyond 2**62")
        kind = np.int32 if most < 2**31 else np.int64
        self.count = x.shape[0]
        self.table = np.concatenate([np.minimum(one, other), np.maximum(one, other)], axis=2).astype(kind)

    def bounds(self, cells: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rows, anchors) lower and upper bounds of scores."""
        total = self.table[0].take(cells[:, 0], axis=0)
        for j in range(1, cells.shape[1]):
            total += self.table[j].take(cells[:, j], axis=0)
        return total[:, : self.count], total[:, self.count :]


class Best:
    """The k best (score, then smallest id) of each of some windows."""

    def __init__(self, windows: int, k: int):
        self.k = k
        self.score, self.id = np.full((windows, k), _LOWEST), np.full((windows, k), np.iinfo(np.int64).max)

    def worst(self) -> np.ndarray:
        return self.score[:, -1]

    def add(self, window: np.ndarray, score: np.ndarray, id: np.ndarray) -> None:
        if not len(window):
            return
        touched = np.unique(window)
        window = np.concatenate([window, np.repeat(touched, self.k)])
        score, id = np.concatenate([score, self.score[touched].ravel()]), np.concatenate([id, self.id[touched].ravel()])
        order = np.lexsort((id, -score.astype(np.float64), window)) if np.abs(score[score > _LOWEST]).max(initial=0) < 2**53 else np.lexsort((id, [-int(s) for s in score], window))
        window, score, id = window[order], score[order], id[order]
        rank = np.arange(len(window)) - np.searchsorted(window, window)
        best = rank < self.k
        self.score[window[best], rank[best]], self.id[window[best], rank[best]] = score[best], id[best]


def _exact(anchors: np.ndarray, rows: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Scores of pairs (anchor i, row j)."""
    return np.concatenate([np.zeros(0, np.int64), *[(anchors[i[s : s + 65536]] * rows[j[s : s + 65536]]).sum(axis=1) for s in range(0, len(i), 65536)]])


def _kth(values: np.ndarray, k: int) -> np.ndarray:
    """The k-th largest of each column, the lowest number if there are fewer."""
    if len(values) < k:
        return np.full(values.shape[1], _LOWEST)
    return np.partition(values, len(values) - k, axis=0)[len(values) - k].astype(np.int64)


class PositivePass:
    """Of each anchor the k best other rows of its label."""

    def __init__(self, anchors: pa.Table, bounds: tuple[np.ndarray, np.ndarray], k: int):
        anchors = anchors.sort_by([("label", "ascending"), ("row", "ascending")]).combine_chunks()
        self.row, self.label, self.k = anchors["row"].to_numpy(), anchors["label"].to_numpy(), k
        self.x, self.limits = stacked(anchors["x"].combine_chunks()).view(np.int32).astype(np.int64), bounds
        self.best = Best(len(self.row), k)

    def take(self, row: np.ndarray, id: np.ndarray, label: np.ndarray, x: np.ndarray, cells: np.ndarray) -> None:
        for name in np.unique(label).tolist():
            first, end = np.searchsorted(self.label, [name, name + 1])
            mine = np.flatnonzero(label == name)
            for a in range(first, end, ANCHORS):
                some = slice(a, min(a + ANCHORS, end))
                tables = Tables(self.x[some], *self.limits)
                for r in range(0, len(mine), ROWS):
                    at = mine[r : r + ROWS]
                    low, high = tables.bounds(cells[at])
                    other = row[at][:, None] != self.row[some]
                    least = np.maximum(self.best.worst()[some], _kth(np.where(other, low, np.iinfo(low.dtype).min), self.k) if len(at) > self.k else _LOWEST)
                    j, i = np.nonzero((high >= least) & other)
                    self.best.add(a + i, _exact(self.x[some], x[at], i, j), id[at[j]])

    def found(self) -> pa.RecordBatch:
        i, rank = np.nonzero(self.best.score > _LOWEST)
        return pa.RecordBatch.from_arrays([pa.array(self.row[i]), pa.array(self.best.id[i, rank]), pa.array(self.best.score[i, rank])], ["anchor_row", "other", "score"])


class NegativePass:
    """Of each anchor and each of its positives the k best rows of other labels with least * p <= 100 * score <= 100 * p. Windows of one
    anchor are open at the same places for all its positives of equal score."""

    def __init__(self, anchors: pa.Table, bounds: tuple[np.ndarray, np.ndarray], k: int, least: int):
        anchors = anchors.combine_chunks()
        self.row, self.label, self.k = anchors["row"].to_numpy(), anchors["label"].to_numpy(), k
        self.x, self.limits = stacked(anchors["x"].combine_chunks()).view(np.int32).astype(np.int64), bounds
        scores = anchors["scores"].to_pylist()
        width = max((len(s) for s in scores), default=0)
        # Windows in columns; where an anchor has fewer, an empty one.
        self.top = np.array([[*s, *[_LOWEST] * (width - len(s))] for s in scores], np.int64).reshape(len(scores), width)
        self.low = np.array([[*[-(-least * v // 100) for v in s], *[-_LOWEST - 1] * (width - len(s))] for s in scores], np.int64).reshape(len(scores), width)
        self.best = Best(self.top.size, k)

    def take(self, row: np.ndarray, id: np.ndarray, label: np.ndarray, x: np.ndarray, cells: np.ndarray) -> None:
        width = self.top.shape[1]
        for a in range(0, len(self.row), ANCHORS):
            some = slice(a, a + ANCHORS)
            top, low = self.top[some], self.low[some]
            open_ = top >= low
            if not open_.any():
                continue
            tables = Tables(self.x[some], *self.limits)
            for r in range(0, len(row), ROWS):
                at = slice(r, r + ROWS)
                lower, upper = tables.bounds(cells[at])
                worst = self.best.worst().reshape(-1, width)[some]
                least = np.where(open_, np.maximum(low, worst), -_LOWEST - 1)
                j, i = np.nonzero((upper >= least.min(axis=1)) & (lower <= top.max(axis=1)) & (label[at][:, None] != self.label[some]))
                if not len(i):
                    continue
                lower, upper = lower[j, i].astype(np.int64), upper[j, i].astype(np.int64)
                for w in range(width):
                    # Rows whose bounds lie in the window are in it: the k-th largest of their lower bounds is reached.
                    sure = np.flatnonzero((lower >= low[i, w]) & (upper <= top[i, w]))
                    reached = least[:, w].copy()
                    if len(sure) >= self.k:
                        order = sure[np.lexsort((-lower[sure], i[sure]))]
                        rank = np.arange(len(order)) - np.searchsorted(i[order], i[order])
                        last = order[rank == self.k - 1]
                        reached[i[last]] = np.maximum(reached[i[last]], lower[last])
                    may = np.flatnonzero((upper >= reached[i]) & (lower <= top[i, w]))
                    score = _exact(self.x[some], x[at], i[may], j[may])
                    inside = (score >= low[i[may], w]) & (score <= top[i[may], w])
                    may, score = may[inside], score[inside]
                    self.best.add((a + i[may]) * width + w, score, id[at][j[may]])

    def found(self) -> pa.RecordBatch:
        window, rank = np.nonzero(self.best.score > _LOWEST)
        width = max(1, self.top.shape[1])
        return pa.RecordBatch.from_arrays(
            [pa.array(self.row[window // width]), pa.array((window % width).astype(np.int32)), pa.array(self.best.id[window, rank]), pa.array(self.best.score[window, rank])],
            ["anchor_row", "place", "other", "score"],
        )


def _tiled(rows: DataFrame, anchors: DataFrame, make: Callable[[pa.Table, int], object], schema: str, per_tile: int, parts: int) -> DataFrame:
    """What `make(anchors, size)`, an object with take() and found(), finds in each tile of a grid: `parts` parts of the rows by
    as many of the anchors as per_tile asks for. Anchors come first in a tile; its rows are streamed."""
    blocks = max(1, -(-anchors.count() // per_tile))
    extra = [c for c in anchors.columns if c not in rows.columns]
    held = anchors.withColumn("h", F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int")).withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    dealt = rows.withColumn("g", F.pmod(F.xxhash64("row", F.lit(1)), F.lit(parts)).cast("int")).withColumn("h", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    for c in extra:
        dealt = dealt.withColumn(c, F.lit(None).cast(anchors.schema[c].dataType))
    both = held.withColumn("kind", F.lit(0)).unionByName(dealt.withColumn("kind", F.lit(1)))
    ready = both.drop("anchor").repartition(blocks * parts, "size", "g", "h").sortWithinPartitions("size", "g", "h", "kind")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, waiting, work = None, [], None
        for whole in batches:
            if not whole.num_rows:
                continue
            code = np.stack([pick(whole, c).to_numpy() for c in ("size", "g", "h", "kind")], axis=1)
            cuts = [0, *(np.flatnonzero((code[1:] != code[:-1]).any(axis=1)) + 1).tolist(), len(code)]
            for first, end in zip(cuts, cuts[1:], strict=False):
                if (tile := tuple(code[first, :3].tolist())) != now:
                    if work:
                        yield work.found()
                    now, waiting, work = tile, [], None
                batch = whole.slice(first, end - first)
                if code[first, 3] == 0:
                    waiting.append(batch)
                    continue
                if not work and waiting:
                    work, waiting = make(pa.Table.from_batches(waiting), tile[0]), []
                if work:
                    work.take(*[pick(batch, c).to_numpy() for c in ("row", "id", "label")], stacked(pick(batch, "x")).view(np.int32), stacked(pick(batch, "cells")))
        if work:
            yield work.found()

    return ready.mapInArrow(run, schema)


def hard_negatives(
    df: DataFrame, anchor: Column, id: str = "vec_id", vector: str = "embedding", label: str = "label", scale: float = 256.0, positives: int = 5, negatives: int = 5,
    least: int = 80, cells: int = 32, anchors_per_tile: int = 262_144, rows_per_part: int = 4_000_000, least_parts: int = 12,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): for each row for which `anchor` is true and
    each of its first `positives` other rows of the same label, the first `negatives` rows of other labels (rank from 1) with
    least * positive_score <= 100 * negative_score <= 100 * positive_score."""
    if not 1 <= cells <= 256:
        raise ValueError("cells must lie between 1 and 256")
    own = df.select(F.col(id).cast("long").alias("id"), F.col(label).cast("long").alias("label"), F.coalesce(anchor, F.lit(False)).alias("anchor"), F.col(vector).alias("vector"))
    exact = materialize(_integers(own, scale), "hard-exact")
    bounds = cell_bounds(exact, cells)
    rows = materialize(_approximated(exact, bounds), "hard-cells")
    parts = max(least_parts, -(-rows.count() // rows_per_part))
    chosen = rows.where("anchor")
    first = _tiled(rows, chosen, lambda a, size: PositivePass(a, bounds[size], positives), "anchor_row long, other long, score long", anchors_per_tile, parts)
    best = F.row_number().over(Window.partitionBy("anchor_row").orderBy(F.desc("score"), "other"))
    first = materialize(first.withColumn("place", best - 1).where(F.col("place") < positives), "hard-positives")
    listed = first.groupBy("anchor_row").agg(F.array_sort(F.collect_list(F.struct("place", "score"))).alias("p"))
    listed = listed.select(F.col("anchor_row").alias("row"), F.col("p.score").alias("scores"))
    second = _tiled(rows, chosen.join(listed, "row"), lambda a, size: NegativePass(a, bounds[size], negatives, least), "anchor_row long, place int, other long, score long", anchors_per_tile, parts)
    rank = F.row_number().over(Window.partitionBy("anchor_row", "place").orderBy(F.desc("score"), "other"))
    second = second.withColumn("rank", rank).where(F.col("rank") <= negatives).withColumnsRenamed({"other": "negative_id", "score": "negative_score"})
    named = first.withColumnsRenamed({"other": "positive_id", "score": "positive_score"}).join(chosen.select(F.col("row").alias("anchor_row"), F.col("id").alias("anchor_id")), "anchor_row")
    found = second.join(named, ["anchor_row", "place"])
    return found.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")
