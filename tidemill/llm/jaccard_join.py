"""N-gram Jaccard join: keys of smallest hashes (or, with `exact`, rarest shingles) deal sets into size-banded tiles, where
hashed bitmap signatures bound overlaps before exact sorted-array intersection.

1. Every whole text becomes its set of distinct word shingles, as 64-bit hashes. Sets equal by a name of 128 bits form a class,
   which is searched once; copies are never expanded into pairs.
2. A class's keys are its 24 smallest hashes. The smallest hash of a union lies in the intersection with probability J, so
   two sets of Jaccard 0.8 or more have no key in common with a chance of 0.2**24, about 2e-17; sets of up to 24 shingles
   put up all of them. With `exact` the keys are the fifth of a set's shingles that the fewest classes hold, of which two sets
   that link always share one; that takes a count of all shingles and about as many more rows as texts have words. Classes
   with a key in common form tiles. A key of more than `few` classes gives a tile for each band of set sizes, and a band too
   large for a tile is dealt into blocks, so that no task gathers a whole hot key. No key is left out.
3. In a tile, bitmaps of about one bit a shingle bound every overlap from above: each bit that A has and B lacks is at
   least one shingle of A that B lacks. Pairs that could still reach the threshold give candidate groups (only a spanning
   forest leaves the tile).
4. The classes of a candidate group get their whole sorted shingle arrays, again in size-banded tiles, and pairs that the
   bitmaps allow and that aren't connected yet are decided by exact intersection. Nothing is capped or sampled.

Nulls and empty texts have the empty set and link with nothing. A text with fewer words than a shingle is one shingle.
Texts of any length are read whole, some at a time. Repeated rows are copies, and of equally small hashes none is chosen, as sets have each
once. A null doc_id takes part and never names a component. Columns other than doc_id and text are
ignored. An empty table gives no rows."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemill.llm._shared import connected_components, materialize, pick, runs, sliced
from tidemill.llm._text import NOT_BLANK, mix, shingles, words

KEYS = 24


def bitmap(hashes: np.ndarray) -> bytes:
    """One bit for each hash in a power of two of bits, at least 64 and as many as hashes."""
    width = 1 << max(6, int(len(hashes) - 1).bit_length())
    bits = np.zeros(width, bool)
    bits[(hashes & np.uint64(width - 1)).astype(np.int64)] = True
    return np.packbits(bits, bitorder="little").tobytes()


def _folded(bits: np.ndarray, words_: int) -> np.ndarray:
    while bits.shape[1] > words_:
        half = bits.shape[1] // 2
        bits = bits[:, :half] | bits[:, half:]
    return bits


def _set_name(hashes: np.ndarray) -> tuple[int, int]:
    """128 bits as two longs."""
    size = np.array([len(hashes)], np.uint64)
    sums = [mix(hashes ^ np.uint64(salt)).sum(keepdims=True, dtype=np.uint64) for salt in (0x5851F42D4C957F2D, 0x2545F4914F6CDD1D)]
    return tuple(int(mix(total + size).view(np.int64)[0]) for total in sums)


def shingle_sets(column: pa.Array, size: int, word_bytes: np.ndarray = NOT_BLANK) -> Iterator[np.ndarray]:
    """Each row's sorted distinct shingle hashes."""
    hashes, bounds, _, _ = words(column, word_bytes)
    found, at = shingles(hashes, bounds, size)
    for first, end in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        yield np.unique(found[first:end])


def sketches(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, mark (as in docs), n_shingles, name1, name2 (the set's name, null for none), keys, bits."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text"):
            n, names, keys, bits = [], [], [], []
            for own in shingle_sets(pick(batch, "text"), size):
                n.append(len(own))
                names.append(_set_name(own) if len(own) else (None, None))
                keys.append(own[:KEYS].view(np.int64))
                bits.append(bitmap(own) if len(own) else b"")
            yield pa.RecordBatch.from_arrays(
                [pick(batch, "doc_id"), pick(batch, "mark"), pa.array(n, pa.int64()), *[pa.array([x[k] for x in names], pa.int64()) for k in (0, 1)], pa.array(keys, pa.list_(pa.int64())), pa.array(bits, pa.binary())],
                ["doc_id", "mark", "n_shingles", "name1", "name2", "keys", "bits"],
            )

    return docs.mapInArrow(run, "doc_id long, mark string, n_shingles long, name1 long, name2 long, keys array<long>, bits binary")


def _banded(grouped: DataFrame, rows: int, shingles_: int, percent: int) -> DataFrame:
    """(tile, node, n, own) from (grp, node, n): a tile for each group and size band, with the band's own classes and those
    of the next band, so each class stands in two bands. Sizes that can link differ by a factor of 100 / percent at most,
    and a band is a little wider than that. A band with more classes than a tile holds (`rows`, or `shingles_` shingles) is
    cut into blocks by size, equal sizes being dealt by hash, with a tile for any two blocks that can hold a link. Blocks
    follow from the counts of sizes; each class learns its own by its size, so nothing gathers a band's classes."""
    ratio = 100 / percent * 1.01
    band = F.floor(F.log("n") / math.log(ratio)).cast("int")
    both = F.array(F.struct(band.alias("band"), F.lit(True).alias("own")), F.struct((band - 1).alias("band"), F.lit(False).alias("own")))
    sizes = grouped.groupBy("grp", "n").agg(F.count("*").alias("c")).select("grp", "n", "c", F.inline(both))
    w = Window.partitionBy("grp", "band")
    reach = math.ceil(1e6 * math.log(100 / percent)) + 1
    near = w.orderBy(F.floor(1e6 * F.log("n"))).rangeBetween(-reach, reach)
    most = F.greatest(F.lit(8), F.least(F.lit(rows), F.floor(shingles_ / F.pow(F.lit(ratio), F.col("band") + 2))))
    sizes = sizes.select("*", F.sum("c").over(w).alias("count"), F.bool_or("own").over(w).alias("owned"), (F.sum("c").over(w.orderBy("n")) - F.col("c")).alias("before"), most.alias("most"))
    sizes = sizes.where("owned and count > 1")
    block = lambda at: F.when(F.col("count") <= F.col("most"), 0).otherwise(F.floor(at / F.col("most"))).cast("long")
    sizes = sizes.withColumns({"first": block(F.col("before")), "last": block(F.col("before") + F.col("c") - 1)})
    # The blocks that a size can link with; those beyond the band's own classes only with blocks of such.
    sizes = sizes.withColumns({"low": F.min("first").over(near), "high": F.max("last").over(near), "end": F.max(F.when(F.col("own"), F.col("last"))).over(w)})
    high = F.when(F.col("own"), F.col("high")).otherwise(F.least("high", "end"))
    of_size = sizes.where(F.col("low") <= high).groupBy("grp", "n").agg(F.collect_list(F.struct("band", "own", "first", "last", "low", high.alias("high"))).alias("bands"))

    def tiles(z: Column) -> Column:
        b = z["first"] + F.pmod(F.xxhash64("node"), z["last"] - z["first"] + 1)
        return F.transform(F.sequence(z["low"], z["high"]), lambda o: F.struct(F.xxhash64("grp", z["band"], F.least(b, o), F.greatest(b, o)).alias("tile"), z["own"].alias("own")))

    placed = grouped.repartition("node").join(of_size, ["grp", "n"]).select("node", "n", F.explode(F.flatten(F.transform("bands", tiles))).alias("t"))
    return placed.select("t.tile", "node", "n", "t.own")


def _tiles(keyed: DataFrame, few: int, rows: int, shingles_: int, percent: int) -> DataFrame:
    """(tile, node, n, own) from (key, node, n): groups of classes that have to be compared. The same group under several
    keys is compared once, if it has at most `few` classes."""
    df = keyed.groupBy("key").agg(F.count("*").alias("df")).where("df > 1")
    counted = materialize(keyed.join(df, "key"), "join-keys")
    small = counted.where(f"df <= {few}").groupBy("key").agg(F.sort_array(F.collect_list(F.struct("n", "node"))).alias("members"))
    small = small.where("size(members) > 1").select("members").distinct()
    small = small.select(F.xxhash64("members").alias("tile"), F.inline("members")).withColumn("own", F.lit(True))
    hot = counted.where(f"df > {few}").select(F.col("key").alias("grp"), "node", "n")
    return small.select("tile", "node", "n", "own").unionByName(_banded(hot, rows, shingles_, percent))


def _rarest(full: DataFrame, percent: int) -> DataFrame:
    """(key, node, n) from (node, n, hashes): of each set its n - ceil(percent * n / 100) + 1 rarest shingles, ties by hash. In
    any order of all shingles, two sets that link have one of these in common, so no link is left out."""

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for node, n, hashes in zip(*[pick(batch, c).to_pylist() for c in ("node", "n", "hashes")], strict=True):
                own = pa.array(np.frombuffer(hashes, np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, node)), pa.array(np.full(n, n)), own], ["node", "n", "key"])

    each = full.mapInArrow(cut, "node long, n long, key long")
    held = each.groupBy("key").agg(F.count("*").alias("df"))
    order = F.array_sort(F.collect_list(F.struct("df", "key")))
    chosen = each.join(held, "key").groupBy("node", "n").agg(order.alias("sorted"))
    chosen = chosen.select("node", "n", F.slice("sorted", F.lit(1), (F.col("n") - F.ceil(percent * F.col("n") / F.lit(100)) + 1).cast("int")).alias("prefix"))
    return chosen.select("node", "n", F.explode("prefix").alias("p")).select(F.col("p.key").alias("key"), "node", "n")


def _reach(n: np.ndarray, m: np.ndarray | int, overlap: np.ndarray, percent: int) -> np.ndarray:
    return 100 * overlap >= percent * (n + m - overlap)


def _allowed(sizes: np.ndarray, own: np.ndarray, bits: list[bytes], label: np.ndarray, percent: int) -> Iterator[tuple[int, np.ndarray]]:
    """Of rows in ascending size: each own row with the later rows that the bitmaps let link with it. Pairs of equal label,
    which the caller may change between rows, are left out."""
    widths = np.array([len(b) // 8 for b in bits])
    by_width = {int(w): np.flatnonzero(widths == w) for w in np.unique(widths)}
    sheets = {w: np.frombuffer(b"".join([bits[i] for i in rows]), np.uint64).reshape(len(rows), w) for w, rows in by_width.items()}
    for w, rows in by_width.items():
        # Sizes that can link differ by less than a factor of two, so widths by a factor of two at most.
        near = [(rows, sheets[w])]
        if 2 * w in by_width:
            near.append((by_width[2 * w], _folded(sheets[2 * w], w)))
        counts = [np.bitwise_count(sheet).sum(1, dtype=np.int64) for _, sheet in near]
        for at, i in enumerate(rows.tolist()):
            if not own[i]:
                continue
            found = []
            for k, (others, sheet) in enumerate(near):
                first = at + 1 if k == 0 else 0
                end = int(np.searchsorted(sizes[others], 100 * sizes[i] // percent, "right"))
                open_ = first + np.flatnonzero(label[others[first:end]] != label[i]) if first < end else ()
                if not len(open_):
                    continue
                common = np.bitwise_count(sheet[open_] & sheets[w][at]).sum(1, dtype=np.int64)
                m = sizes[others[open_]]
                most = np.minimum(sizes[i] - (counts[0][at] - common), m - (counts[k][open_] - common))
                found.append(others[open_][_reach(sizes[i], m, most, percent)])
            if found:
                yield i, np.concatenate(found)


def _ordered(rows: pa.Table) -> tuple[pa.Table, np.ndarray, np.ndarray, np.ndarray]:
    """A tile's rows by size, each class once: a class whose doc_id is repeated comes more than once."""
    rows = rows.sort_by([("n", "ascending"), ("node", "ascending")])
    nodes = rows["node"].to_numpy()
    once = np.append(True, nodes[1:] != nodes[:-1])
    if not once.all():
        rows = rows.filter(pa.array(once))
    return rows, rows["node"].to_numpy(), rows["n"].to_numpy(), rows["own"].to_numpy()


def _edges(a: list, b: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def _candidates(percent: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = [], []
        for _, rows in runs(batches, "tile"):
            rows, nodes, sizes, own = _ordered(rows)
            label = np.arange(len(nodes))
            for i, js in _allowed(sizes, own, rows["bits"].to_pylist(), label, percent):
                for j in js[np.unique(label[js], return_index=True)[1]].tolist():
                    a.append(nodes[i])
                    b.append(nodes[j])
                    label[label == label[j]] = label[i]
            if len(a) > 10_000:
                yield _edges(a, b)
                a, b = [], []
        yield _edges(a, b)

    return run


def _arrays(size: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text"):
            sets = list(shingle_sets(pick(batch, "text"), size))
            named = np.array([_set_name(s) if len(s) else (0, 0) for s in sets], np.int64)
            same = (named[:, 0] == pick(batch, "name1").to_numpy()) & (named[:, 1] == pick(batch, "name2").to_numpy())
            yield pa.RecordBatch.from_arrays(
                [pick(batch, "node"), pick(batch, "tiles"), pa.array([len(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())],
                ["node", "tiles", "n", "hashes"],
            ).filter(pa.array(same))

    return run


def _verified(percent: int, every: bool = False):
    """`every`: all pairs that link, also of classes that are connected already."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in runs(batches, "tile"):
            rows, nodes, sizes, own = _ordered(rows)
            sets = [np.frombuffer(x, np.uint64) for x in rows["hashes"].to_pylist()]
            label, a, b = np.arange(len(nodes)), [], []
            for i, js in _allowed(sizes, own, [bitmap(s) for s in sets], label, percent):
                while len(js):
                    j, js = int(js[0]), js[1:]
                    overlap = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                    if 100 * overlap >= percent * (len(sets[i]) + len(sets[j]) - overlap):
                        a.append(nodes[i])
                        b.append(nodes[j])
                        if every:
                            continue
                        label[label == label[j]] = label[i]
                        js = js[label[js] != label[i]]
                if len(a) > 10_000:
                    yield _edges(a, b)
                    a, b = [], []
            yield _edges(a, b)

    return run


def text_mark(text: str = "text") -> Column:
    """128 bits that tell a whole text, null as the empty text."""
    return F.md5(F.coalesce(F.col(text).cast("string"), F.lit("")))


def _joined(
    docs: DataFrame, size: int, percent: int, few: int, tile_rows: int, tile_shingles: int, every: bool = False, exact: bool = False
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(doc_id, mark, n_shingles, name1, name2, ...) of each row, the classes, which have names and a node of their own, and (node, component) of the classes that link; with
    `every` instead of these all pairs (a, b) of classes that link, once each."""
    if not 50 < percent <= 100:
        raise ValueError("percent must lie in (50, 100]: bitmap widths rely on it")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), text_mark().alias("mark"))
    marks = materialize(sketches(docs, size), "join-sets")
    # A class's text is read from one of its rows, told by doc_id and mark, so rows without a doc_id don't meet on one key.
    least = F.min_by(F.struct("keys", "bits", "mark"), F.struct(F.coalesce("doc_id", F.lit(2**63 - 1)), "mark")).alias("s")
    classes = marks.where("n_shingles > 0").groupBy("name1", "name2", F.col("n_shingles").alias("n")).agg(F.min("doc_id").alias("first"), least)
    classes = materialize(classes.select(F.monotonically_increasing_id().alias("node"), "name1", "name2", "n", "first", "s.mark", "s.keys", "s.bits"), "join-classes")

    def arrays(wanted: DataFrame) -> DataFrame:
        """node, tiles, n, hashes for (node, name1, name2, first, mark, tiles)."""
        wanted = wanted.withColumnRenamed("mark", "of").hint("merge")  # grows with docs, so it's never sent whole
        found = docs.join(wanted, F.col("doc_id").eqNullSafe(F.col("first")) & (F.col("mark") == F.col("of")))
        return found.select("text", "node", "name1", "name2", "tiles").mapInArrow(_arrays(size), "node long, tiles array<struct<tile:long,own:boolean>>, n long, hashes binary")

    if exact:
        none = F.array(F.struct(F.lit(0).cast("long").alias("tile"), F.lit(True).alias("own")))
        keyed = _rarest(arrays(classes.select("node", "name1", "name2", "first", "mark", none.alias("tiles"))).dropDuplicates(["node"]).select("node", "n", "hashes"), percent)
    else:
        keyed = classes.select(F.explode("keys").alias("key"), "node", "n")
    tiles = _tiles(keyed, few, tile_rows, tile_shingles, percent)
    compared = tiles.join(classes.select("node", "bits"), "node").repartition("tile").sortWithinPartitions("tile")
    rough = connected_components(compared.mapInArrow(_candidates(percent), "a long, b long"), "join-rough")
    grouped = rough.join(classes.select("node", "name1", "name2", "n", "first", "mark"), "node").select(F.col("component").alias("grp"), "node", "name1", "name2", "n", "first", "mark")
    grouped = materialize(grouped, "join-groups")
    placed = _banded(grouped.select("grp", "node", "n"), tile_rows, tile_shingles, percent)
    where = placed.groupBy("node").agg(F.collect_set(F.struct("tile", "own")).alias("tiles"))
    full = arrays(where.join(grouped.select("node", "name1", "name2", "first", "mark"), "node"))
    full = full.select(F.inline("tiles"), "node", "n", "hashes").repartition("tile").sortWithinPartitions("tile")
    if every:
        pairs = full.mapInArrow(_verified(percent, True), "a long, b long")
        return marks, classes, pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    linked = connected_components(full.mapInArrow(_verified(percent), "a long, b long"), "join-linked")
    return marks, classes, linked


def jaccard_components(
    docs: DataFrame, size: int = 5, percent: int = 80, few: int = 512, tile_rows: int = 4096, tile_shingles: int = 4_000_000, exact: bool = False
) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, n_shingles, component_id: the smallest doc_id that links reach, where two
    texts link if 100 * |intersection| >= percent * |union| of their sets of distinct runs of `size` words."""
    marks, classes, linked = _joined(docs, size, percent, few, tile_rows, tile_shingles, exact=exact)
    named = linked.join(classes.select("node", "first"), "node")
    least = named.groupBy("component").agg(F.min("first").alias("component_id"))
    of_node = named.join(least, "component").select("node", "component_id")
    alone = classes.join(of_node, "node", "left").select("name1", "name2", F.coalesce("component_id", "first").alias("component_id"))
    named = marks.select("doc_id", "n_shingles", "name1", "name2").join(alone, ["name1", "name2"], "left")
    return named.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def jaccard_links(
    docs: DataFrame, size: int = 5, percent: int = 80, few: int = 512, tile_rows: int = 4096, tile_shingles: int = 4_000_000, exact: bool = False
) -> tuple[DataFrame, DataFrame]:
    """All links, as pairs of classes (a, b) and the rows' membership (doc_id, n_shingles, node): two rows link if their
    nodes are a pair, or equal and not null. Rows with the empty set have a null node. No pair is skipped, so the work grows
    with the number of pairs of classes; use jaccard_components where the components are enough."""
    marks, classes, pairs = _joined(docs, size, percent, few, tile_rows, tile_shingles, every=True, exact=exact)
    members = marks.select("doc_id", "n_shingles", "name1", "name2").join(classes.select("node", "name1", "name2"), ["name1", "name2"], "left")
    return pairs, members.select("doc_id", "n_shingles", "node")


def one_per_component(
    docs: DataFrame, size: int = 5, percent: int = 80, few: int = 512, tile_rows: int = 4096, tile_shingles: int = 4_000_000, exact: bool = False
) -> DataFrame:
    """Of each component of docs one row, all columns: that of the smallest doc_id, null ids last; of rows equal in doc_id
    and text, any. Rows are told apart by doc_id and text, so that neither repeated nor null ids matter. Texts without words
    link with nothing and all stay, but for those repeated under a known doc_id."""
    marks, classes, linked = _joined(docs, size, percent, few, tile_rows, tile_shingles, exact=exact)
    of_row = marks.select("doc_id", "mark", "n_shingles", "name1", "name2")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "mark")).alias("f")
    least = of_row.where("n_shingles > 0").groupBy("name1", "name2").agg(first)
    least = least.join(classes.select("node", "name1", "name2"), ["name1", "name2"])
    least = least.join(linked, "node", "left").groupBy(F.coalesce("component", "node").alias("c")).agg(F.min("f").alias("f"))
    blank = of_row.where("n_shingles = 0")
    chosen = least.select("f.doc_id", "f.mark").unionByName(blank.where("doc_id is not null").select("doc_id", "mark").distinct())
    own, id, mark = (next(n for n in (k + "_" * i for i in range(len(docs.columns) + 1)) if n not in docs.columns) for k in ("_own", "_id", "_mark"))
    chosen = chosen.select(F.col("doc_id").alias(id), F.col("mark").alias(mark))
    worded = F.coalesce("text", F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    rows = docs.where(F.col("doc_id").isNotNull() | worded).withColumn(own, text_mark()).dropDuplicates(["doc_id", own])
    kept = rows.join(chosen, F.col("doc_id").cast("long").eqNullSafe(F.col(id)) & (F.col(own) == F.col(mark)), "left_semi")
    return kept.select(*docs.columns).unionByName(docs.where(F.col("doc_id").isNull() & ~worded))
