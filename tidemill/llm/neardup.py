"""Embedding near-dedup: random-hyperplane sign hashing in several tables, exact cosine verification, connected components.

1. Rows of equal label and equal vector form a class, told by 128-bit digests; copies are counted, never compared.
2. A table's key is the signs of a vector's products with some random hyperplanes. Two vectors at angle t agree in a sign with
   probability 1 - t / pi. The number of signs follows from the number of classes (a bucket holds about 256 of the most
   frequent label), and the number of tables from that and the recall asked for at the threshold itself, 0.999; closer pairs
   are missed less. Nothing else about the search depends on size.
3. Dense groups: vectors within half of the threshold's angle of one centre all link with each other. Centres are the mean
   directions of a table's fullest buckets (1,024 at most, and at most one bucket in `tile_rows` classes can be such); a class
   belongs to the ball of its nearest centre or to none. Balls change what is computed, not what is found.
4. The classes of a bucket are compared in tiles of at most `tile_rows` by `tile_rows`: a fuller bucket is cut into blocks, by
   ball, with a tile for each two blocks; two blocks of one ball aren't compared, as what links there is known. Products of
   whole blocks give the cosines, in double precision; those within 1e-12 of the threshold are computed once more. A pair that
   agrees in several tables counts in the first of them only, so links are counted, pair by pair, without writing pairs: a
   tile gives each class its number of links and a spanning forest.
5. Components of the forest's edges by alternating stars.

Rows without a label, or whose vector is null, without entries, zero, or with null or non-finite entries, link with nothing;
each is a component of its own. Vectors of different lengths never link. Rows with a null or repeated id are rows like others, but
a null id never names a component. Ties don't arise. An empty table gives no rows. Other columns are ignored."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.llm._shared import connected_components, materialize, pick, runs
from tidemill.llm._vectors import finite_vectors, stacked

#: Cosines this near to the threshold are computed again, by a sum that isn't rounded on the way.
DOUBT = 1e-12


def unit(x: np.ndarray) -> np.ndarray:
    """Rows over their lengths; first over their largest entry, so that no square overflows."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def cosine(x: np.ndarray, y: np.ndarray) -> float:
    return math.fsum((x * y).tolist()) / math.sqrt(math.fsum((x * x).tolist()) * math.fsum((y * y).tolist()))


def planes(d: int, count: int, seed: int = 20240311) -> np.ndarray:
    return np.random.default_rng([seed, d]).standard_normal((d, count))


def shape_of(most: int, least: float, recall: float, bucket: int) -> tuple[int, int]:
    """Signs a key and tables for `most` vectors that may meet: key space of about most / bucket, and so many tables that a
    pair at cosine `least` agrees in one of them with probability `recall`."""
    bits = min(40, max(4, math.ceil(math.log2(max(1, most / bucket)))))
    same = (1 - math.acos(least) / math.pi) ** bits
    return bits, max(1, math.ceil(math.log(1 - recall) / math.log1p(-same)))


def _keys(x: np.ndarray, bits: int, tables: int) -> np.ndarray:
    """(rows, tables) keys."""
    signs = (x @ planes(x.shape[1], bits * tables) > 0).reshape(len(x), tables, bits)
    return signs @ (np.int64(1) << np.arange(bits, dtype=np.int64))


def _doubles(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """By length: row numbers and vectors of a binary column of doubles."""
    lengths = pa.compute.binary_length(column).to_numpy(zero_copy_only=False)
    for size in np.unique(lengths).tolist():
        rows = np.flatnonzero(lengths == size)
        yield rows, stacked(column.take(pa.array(rows))).view(np.float64)


def _valid(df: DataFrame, id: str, vector: str, label: str) -> DataFrame:
    """(id, label as text, x: the doubles' bytes, null for rows that link with nothing)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            labelled = pick(batch, "label").is_valid().to_numpy(zero_copy_only=False)
            out: list[bytes | None] = [None] * batch.num_rows
            for rows, x in finite_vectors(pick(batch, "vector")):
                for row, own in zip(rows.tolist(), x + 0.0, strict=True):  # no negative zeros
                    if labelled[row] and own.any():
                        out[row] = own.tobytes()
            yield pa.RecordBatch.from_arrays([pick(batch, "id"), pick(batch, "label"), pa.array(out, pa.binary())], ["id", "label", "x"])

    own = df.select(F.col(id).cast("long").alias("id"), F.col(label).cast("string").alias("label"), F.col(vector).alias("vector"))
    return own.mapInArrow(run, "id long, label string, x binary").withColumn("name", F.md5("x"))


def _centres(classes: DataFrame, bits: int, tile_rows: int, least: float, most: int = 1024) -> dict[tuple[str, int], np.ndarray]:
    """By label and length: mean directions of the buckets of the first table with more than tile_rows classes, the fullest
    first; of two within half of the threshold's angle the fuller one stays."""

    def keyed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = np.zeros(batch.num_rows, np.int64)
            for rows, x in _doubles(pick(batch, "x")):
                keys[rows] = _keys(x, bits, 1)[:, 0]
            yield pa.RecordBatch.from_arrays([pick(batch, "label"), pa.compute.binary_length(pick(batch, "x")), pa.array(keys)], ["label", "size", "key"])

    counted = classes.mapInArrow(keyed, "label string, size int, key long").groupBy("label", "size", "key").count()
    full = counted.where(F.col("count") > tile_rows).sort(F.desc("count"), "label", "size", "key").limit(most).collect()
    if not full:
        return {}
    wanted = {(r.label, r["size"], r.key): i for i, r in enumerate(full)}

    def summed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            labels = pick(batch, "label").to_pylist()
            for rows, x in _doubles(pick(batch, "x")):
                where = np.array([wanted.get((labels[r], 8 * x.shape[1], k), -1) for r, k in zip(rows.tolist(), _keys(x, bits, 1)[:, 0].tolist(), strict=True)])
                u = unit(x)
                for i in np.unique(where[where >= 0]).tolist():
                    total[i] = total.get(i, 0) + u[where == i].sum(axis=0)
        at = [(i, j, v) for i, own in total.items() for j, v in enumerate(own.tolist())]
        columns = list(zip(*at, strict=True)) or [(), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.float64()), strict=True)], ["i", "j", "v"])

    sums = classes.mapInArrow(summed, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).sort("i", "j").collect()
    found: dict[int, list[float]] = {}
    for r in sums:
        found.setdefault(r.i, []).append(r.v)
    out: dict[tuple[str, int], list[np.ndarray]] = {}
    for i, r in enumerate(full):
        c = np.array(found[i])
        if np.linalg.norm(c) > 0:
            c /= np.linalg.norm(c)
            held = out.setdefault((r.label, r["size"] // 8), [])
            if all(float(c @ o) < math.cos(math.acos(least) / 2) for o in held):
                held.append(c)
    return {k: np.array(v) for k, v in out.items()}


def _hashed(classes: DataFrame, bits: int, tables: int, centres: dict[tuple[str, int], np.ndarray], least: float) -> DataFrame:
    """(node, label, first, w, x, size, keys, ball): ball is 0, or the number of the centre, from 1, whose ball holds it."""
    inside = math.cos(math.acos(least) / 2) + 1e-9  # rounding never puts two into a ball that don't link
    base = {k: sum(len(v) for o, v in centres.items() if o < k) + 1 for k in centres}

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, ball = np.zeros((batch.num_rows, tables), np.int64), np.zeros(batch.num_rows, np.int32)
            labels = np.array(pick(batch, "label").to_pylist(), object)
            for rows, x in _doubles(pick(batch, "x")):
                keys[rows] = _keys(x, bits, tables)
                for name, own in centres.items():
                    if name[1] == x.shape[1] and len(mine := np.flatnonzero(labels[rows] == name[0])):
                        near = unit(x[mine]) @ own.T
                        best = near.argmax(axis=1)
                        ball[rows[mine]] = np.where(near[np.arange(len(mine)), best] >= inside, base[name] + best, 0)
            yield pa.RecordBatch.from_arrays(
                [*[pick(batch, c) for c in ("node", "label", "first", "w", "x")], pa.compute.binary_length(pick(batch, "x")), pa.array(list(keys), pa.list_(pa.int64())), pa.array(ball)],
                ["node", "label", "first", "w", "x", "size", "keys", "ball"],
            )

    return classes.mapInArrow(run, "node long, label string, first long, w long, x binary, size int, keys array<long>, ball int")


def _dealt(hashed: DataFrame, tile_rows: int) -> DataFrame:
    """(node, tile, check, t, side): the tiles of each class, named by two hashes. Side 0 is a tile's only or first block, 1
    its second."""
    at = ["label", "size", "t", "key"]
    keyed = hashed.select("node", "label", "size", "ball", F.posexplode("keys").alias("t", "key"))
    counts = keyed.groupBy(*at, "ball").agg(F.count("*").alias("c"))
    whole = counts.groupBy(*at).agg(F.sum("c").alias("all"), F.collect_list(F.struct("ball", "c")).alias("parts")).where("all > 1")
    # A bucket that fits is one block; of a fuller one each ball has its own blocks, as has what is in none.
    parts = F.transform("parts", lambda p: F.struct(p["ball"].alias("ball"), F.ceil(p["c"] / tile_rows).cast("int").alias("n")))
    whole = whole.select(*at, F.when(F.col("all") > tile_rows, parts).alias("parts"))
    rows = keyed.join(whole, at)
    own = F.filter("parts", lambda p: p["ball"] == F.col("ball"))[0]["n"]
    block = F.pmod(F.xxhash64("node", "t"), own).cast("int")
    blocks = F.flatten(F.transform("parts", lambda p: F.transform(F.sequence(F.lit(0), p["n"] - 1), lambda b: F.struct(p["ball"].alias("ball"), b.alias("b")))))
    mine = F.struct(F.col("ball").alias("ball"), F.col("block").alias("b"))
    others = F.filter("blocks", lambda o: (o["ball"] != F.col("ball")) | (F.col("ball") == 0))
    named = lambda *own: [F.xxhash64(*own).alias("tile"), F.xxhash64(F.lit(1), *own).alias("check")]
    tile = lambda o: F.struct(*named(*at, F.least(mine, o), F.greatest(mine, o)), F.when(o < mine, 1).otherwise(0).alias("side"))
    only = F.array(F.struct(*named(*at), F.lit(0).alias("side")))
    rows = rows.withColumn("block", block).withColumn("blocks", blocks)
    return rows.select("node", "t", F.inline(F.when(F.col("parts").isNull(), only).otherwise(F.transform(others, tile)))).select("node", "tile", "check", "t", "side")


def _verified(least: float, step: int = 512):
    """Of tiles: (a, b, n): a's links by weight (b null), and edges of a spanning forest (n null)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in (part for _, same in runs(batches, "tile") for _, part in runs(same.to_batches(), "check")):
            rows = rows.sort_by([("node", "ascending")]).combine_chunks()
            nodes, weights, balls, side, t = (rows[c].to_numpy() for c in ("node", "w", "ball", "side", "t"))
            x = np.vstack([own for _, own in _doubles(rows["x"].combine_chunks())])
            keys = rows["keys"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(nodes), -1)
            u, t = unit(x), int(t[0])
            left = np.flatnonzero(side == 0)
            right = np.flatnonzero(side == 1) if (side == 1).any() else left
            links, label, edges = np.zeros(len(nodes), np.int64), np.arange(len(nodes)), []
            for first in range(0, len(left), step):
                i = left[first : first + step]
                cos = u[i] @ u[right].T
                p, q = np.nonzero(cos >= least - DOUBT)
                near, p, q = cos[p, q], i[p], right[q]
                open_ = (p < q) if right is left else np.ones(len(p), bool)
                open_ &= (balls[p] == 0) | (balls[p] != balls[q])
                near, p, q = near[open_], p[open_], q[open_]
                for s in range(t):  # pairs of an earlier table were counted there
                    new = keys[p, s] != keys[q, s]
                    near, p, q = near[new], p[new], q[new]
                doubt = np.flatnonzero(near < least + DOUBT)
                if len(doubt):
                    sure = np.ones(len(p), bool)
                    sure[doubt] = [cosine(x[a], x[b]) >= least for a, b in zip(p[doubt], q[doubt], strict=True)]
                    p, q = p[sure], q[sure]
                np.add.at(links, p, weights[q])
                np.add.at(links, q, weights[p])
                cuts = [*np.flatnonzero(np.diff(p, prepend=-1)).tolist(), len(p)]
                for a, end in zip(cuts, cuts[1:], strict=False):
                    js = q[a:end]
                    js = js[label[js] != label[p[a]]]
                    for j in js[np.unique(label[js], return_index=True)[1]].tolist():
                        edges.append((nodes[p[a]], nodes[j]))
                        label[label == label[j]] = label[p[a]]
            held = np.flatnonzero(links)
            a = np.concatenate([nodes[held], np.array([e[0] for e in edges], np.int64)])
            b = pa.array([None] * len(held) + [e[1] for e in edges], pa.int64())
            n = pa.array(links[held].tolist() + [None] * len(edges), pa.int64())
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a), b, n], ["a", "b", "n"])

    return run


def embedding_components(
    df: DataFrame, least: float = 0.93, id: str = "vec_id", vector: str = "embedding", label: str = "label", recall: float = 0.999, bucket: int = 256, tile_rows: int = 2048
) -> DataFrame:
    """Per row: id, n_links (other rows of its label at cosine >= least), component_id (the smallest id that links reach), kept
    (whether that is its own)."""
    if not 0 < least < 1:
        raise ValueError("least must lie between 0 and 1")
    rows = materialize(_valid(df, id, vector, label), "near-rows")
    grouped = rows.where("x is not null").groupBy("label", "name")
    classes = grouped.agg(F.min("id").alias("first"), F.count("*").alias("w"), F.first("x").alias("x"))
    classes = materialize(classes.withColumn("node", F.monotonically_increasing_id()), "near-classes")
    most = classes.groupBy("label").count().agg(F.max("count")).first()[0] or 0
    bits, tables = shape_of(most, least, recall, bucket)
    plain = classes.select("node", "label", "first", "w", "x")
    hashed = materialize(_hashed(plain, bits, tables, _centres(plain, bits, tile_rows, least), least), "near-hashed")
    of_tile = _dealt(hashed, tile_rows).join(hashed.select("node", "w", "x", "keys", "ball"), "node")
    found = of_tile.repartition("tile").sortWithinPartitions("tile", "check").mapInArrow(_verified(least), "a long, b long, n long")
    found = materialize(found, "near-found")
    balls = hashed.where("ball > 0").groupBy("ball").agg(F.sum("w").alias("held"), F.min("node").alias("hub"))
    in_ball = hashed.where("ball > 0").select("node", "ball", "w").join(balls, "ball")
    edges = found.where("b is not null").select("a", "b").unionByName(in_ball.where("node != hub").select(F.col("node").alias("a"), F.col("hub").alias("b")))
    counts = found.where("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("n"))
    inside = in_ball.select("node", (F.col("held") - F.col("w")).alias("m"))
    linked = connected_components(edges, "near-linked")
    of_node = classes.select("node", "label", "name", "first", "w").join(linked, "node", "left").withColumn("component", F.coalesce("component", "node"))
    smallest = of_node.groupBy("component").agg(F.min("first").alias("component_id"))
    known = of_node.join(smallest, "component").join(counts, "node", "left").join(inside, "node", "left")
    known = known.select("label", "name", "component_id", (F.col("w") - 1 + F.coalesce("n", F.lit(0)) + F.coalesce("m", F.lit(0))).alias("n_links"))
    out = rows.select("id", "label", "name").join(known, ["label", "name"], "left")
    component = F.coalesce("component_id", "id")
    return out.select(F.col("id").alias(id), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"))
