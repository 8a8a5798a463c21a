"""Benchmark decontamination: SimHash fingerprints of item-sized windows, searched by multi-index Hamming blocks, verified
by exact weighted-shingle similarity.

Texts are lower-cased and cut into words of letters, digits and underscores, so case, punctuation and line ends don't
matter. For each benchmark item of n words every window of n words is a candidate place; a document of fewer words is one window. The similarity of a window and an
item is their weighted Jaccard similarity: shingles are runs of five words with their multiplicities, weighted by how few
items hold them. A window whose shingles of any item weigh less than the threshold share of the lightest item of its size
cannot reach the threshold, so it isn't fingerprinted; that test is exact. The fingerprints have 64 bits; the index holds
their eight bytes, and a fingerprint within a radius of 23 bits is within 2 bits in one byte at least, so that looking up
each byte's neighbourhood misses none. A shingle adds to a fingerprint's sums by the root of its weight in the window, so that
the cosine of two windows' vectors is at least 0.88 where their similarity is 0.8, whatever the weights, and about 10 of 64 bits
differ. That is an expectation: a few heavy shingles can make the distance larger. So items beyond the radius aren't
given up: those whose shingles in the window weigh as much as the threshold demands are verified as well, and the result
misses nothing. Items of fewer than five words match as a whole sequence; items without words match nothing.

Null and empty texts leak nothing. Texts are searched whole, of any length. Items are read in blocks of bounded size, all rows of an item_id in one; weights are
those of the whole benchmark, whose counts of shingles are mapped files on each machine if there are several blocks, so the
number of blocks changes no result. Documents are never shuffled. Repeated rows are treated alike; an empty table on either side gives no leaks. Other columns, whatever their names, play no part."""

from __future__ import annotations

import math
import os
import uuid
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.llm._shared import pick, shared_dir, shared_file, sliced
from tidemill.llm._table import spread
from tidemill.llm._text import WORDLIKE, mix, shingles, words

BITS, BLOCKS = 64, 8
_FILTER = 1 << 22


def _lowered(column: pa.Array) -> pa.Array:
    return pc.utf8_lower(column.cast(pa.large_string()))


def simhash(hashes: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Fingerprints (uint64) of rows of weighted shingles: both arrays are (rows, shingles). What a shingle adds is the root of its
    weight times its occurrences in the row."""
    ordered = np.sort(hashes, axis=1)
    times = np.ones(hashes.shape)
    for row in np.flatnonzero((ordered[:, 1:] == ordered[:, :-1]).any(axis=1)).tolist():
        _, which, count = np.unique(hashes[row], return_inverse=True, return_counts=True)
        times[row] = count[which]
    weights = np.sqrt(weights / times)
    bits = np.unpackbits(mix(hashes + np.uint64(0x2545F4914F6CDD1D))[..., None].view(np.uint8), axis=-1).astype(np.float32)
    sums = ((2 * bits - 1) * weights[..., None].astype(np.float32)).sum(axis=-2)
    return np.packbits(sums > 0, axis=-1).view(np.uint64)[..., 0]


_NEAR_BYTES: dict[int, list[list[int]]] = {}


def near_bytes(radius: int) -> list[list[int]]:
    """For each byte, the bytes within `radius` bits of it."""
    if radius not in _NEAR_BYTES:
        _NEAR_BYTES[radius] = [[w for w in range(256) if (v ^ w).bit_count() <= radius] for v in range(256)]
    return _NEAR_BYTES[radius]


def _item_shingles(rows: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of items' texts: the shingles and their offsets, the numbers of words and which items have shingles of full size."""
    hashes, bounds, _, _ = words(_lowered(rows), WORDLIKE)
    found, at = shingles(hashes, bounds, size)
    counts = np.diff(bounds)
    return found, at, counts, counts >= size


class ItemCounts:
    """How many items of the whole benchmark hold each shingle: two files in the shared folder, sorted by shingle, that Spark
    brings to each machine and that are mapped, not loaded. Driver and tasks hold a batch of it."""

    def __init__(self, own: DataFrame, size: int, items: int):
        def held(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in sliced(batches, "text"):
                found, at, _, full = _item_shingles(pick(batch, "text"), size)
                sets = [np.unique(found[a:b]) for a, b, f in zip(at[:-1], at[1:], full, strict=True) if f]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, np.uint64), *sets]).view(np.int64))], ["shingle"])

        def packed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([np.ascontiguousarray(pick(batch, c).to_numpy()).tobytes()], pa.binary()) for c in ("shingle", "count")], ["shingle", "count"]
                )

        self.items, self.name = items, f"item-counts-{uuid.uuid4().hex}"
        counted = own.select("text").mapInArrow(held, "shingle long").groupBy("shingle").count().sort("shingle")
        spark = own.sparkSession
        paths = [f"{shared_dir(spark)}/{self.name}.{part}" for part in ("shingle", "count")]
        files = [shared_file(spark, p) for p in paths]
        for row in counted.mapInArrow(packed, "shingle binary, count binary").toLocalIterator():
            for file, part in zip(files, row, strict=True):
                file.write(bytearray(part))
        for file, path in zip(files, paths, strict=True):
            file.close()
            spark.sparkContext.addFile(path)

    def _files(self) -> tuple[np.ndarray, np.ndarray]:
        paths = [SparkFiles.get(f"{self.name}.{part}") for part in ("shingle", "count")]
        files = tuple(np.memmap(p, np.int64, "r") if os.path.getsize(p) else np.zeros(0, np.int64) for p in paths)
        self._files = lambda: files  # type: ignore[method-assign]
        return files

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "_files"}

    def get(self, found: np.ndarray) -> np.ndarray:
        """For each shingle (uint64) the number of items that hold it, 0 for none."""
        keys, values = self._files()
        if not len(keys):
            return np.zeros(len(found), np.int64)
        found = found.view(np.int64)
        at = np.minimum(np.searchsorted(keys, found), len(keys) - 1)
        return np.where(keys[at] == found, values[at], 0)


@dataclass
class ItemIndex:
    """What tasks need of a block of items."""

    size: int
    least: float
    radius: int
    ids: list[int]
    bags: list[dict[int, float]]
    prints: list[int]
    by_words: dict[int, list[int]]
    #: For each window size, what the lightest of its items weighs.
    lightest: dict[int, float]
    shingles: np.ndarray
    weights: np.ndarray
    #: For each window size and byte of a fingerprint: the items by byte value, within the byte's share of the radius.
    tables: dict[int, list[dict[int, list[int]]]]
    sizes_of: list[list[int]]
    short: dict[int, dict[int, list[int]]]
    #: For each shingle from posts[k] to posts[k + 1]: the items that hold it and what it weighs in each.
    posts: np.ndarray
    post_items: np.ndarray
    post_weights: np.ndarray
    #: The items' numbers of words and weights.
    words_of: np.ndarray
    totals: np.ndarray
    #: The weight of a shingle that no item holds.
    other: float = 0.0
    #: Of several blocks: the counts of the whole benchmark, for shingles that only items of other blocks hold.
    counts: ItemCounts | None = None
    #: Whether items beyond the radius are looked for.
    beyond: bool = True

    @classmethod
    def build(cls, rows: list[tuple[int, str | None]], size: int, least: float, radius: int, whole: ItemCounts | None = None) -> ItemIndex:
        """`whole`: the counts of the whole benchmark, where rows are a block of it."""
        found, at, counts, full = _item_shingles(pa.array([t or "" for _, t in rows], pa.large_string()), size)
        held: Counter[int] = Counter()
        own = [found[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)]
        for x, f in zip(own, full, strict=True):
            if f:
                held.update(set(x))
        if whole:
            held = Counter(dict(zip(held, whole.get(np.array(list(held), np.uint64)).tolist(), strict=True)))
        items = whole.items if whole else len(rows)
        weigh = {s: math.log(1 + items / k) for s, k in held.items()}
        index = cls(size, least, radius, [], [], [], defaultdict(list), {}, np.zeros(0, np.uint64), np.zeros(0), {}, [], defaultdict(lambda: defaultdict(list)), *[np.zeros(0)] * 5)
        sizes_of: dict[int, set[int]] = defaultdict(set)
        for (item, _), x, n in zip(rows, own, counts.tolist(), strict=True):
            if n == 0:
                continue
            if n < size:
                index.short[n][x[0]].append(item)
                continue
            bag: dict[int, float] = defaultdict(float)
            for s in x:
                bag[s] += weigh[s]
                sizes_of[s].add(n)
            total = sum(bag.values())
            index.lightest[n] = min(index.lightest.get(n, math.inf), total)
            index.by_words[n].append(len(index.ids))
            index.prints.append(int(simhash(np.array([x], np.uint64), np.array([[weigh[s] for s in x]]))[0]))
            index.ids.append(item)
            index.bags.append(dict(bag))
        index.shingles = np.array(sorted(weigh), np.uint64)
        index.weights = np.array([weigh[s] for s in index.shingles.tolist()])
        index.sizes_of = [sorted(sizes_of[s]) for s in index.shingles.tolist()]
        index.other, index.counts = math.log(1 + items), whole
        held_by = [(s, i, w) for i, bag in enumerate(index.bags) for s, w in bag.items()]
        names = np.searchsorted(index.shingles, np.array([h[0] for h in held_by], np.uint64))
        order = np.argsort(names, kind="stable")
        index.posts = np.searchsorted(names[order], np.arange(len(index.shingles) + 1))
        index.post_items, index.post_weights = np.array([h[1] for h in held_by], np.int64)[order], np.array([h[2] for h in held_by])[order]
        index.words_of = np.zeros(len(index.ids), np.int64)
        for n, members in index.by_words.items():
            index.words_of[members] = n
        index.totals = np.array([sum(bag.values()) for bag in index.bags])
        share = near_bytes(radius // BLOCKS)
        for n, members in index.by_words.items():
            tables: list[dict[int, list[int]]] = [defaultdict(list) for _ in range(BLOCKS)]
            for i in members:
                for b in range(BLOCKS):
                    for v in share[index.prints[i] >> 8 * b & 255]:
                        tables[b][v].append(i)
            index.tables[n] = [dict(t) for t in tables]
        index.by_words, index.short = dict(index.by_words), {n: dict(x) for n, x in index.short.items()}
        return index

    def search(self, column: pa.Array) -> dict[int, dict[int, tuple[float, int, int, int]]]:
        """By row and item: the best window as (similarity to nine places, -first word, -distance, words)."""
        hashes, bounds, _, _ = words(_lowered(column), WORDLIKE)
        out: dict[int, dict[int, tuple]] = defaultdict(dict)

        def keep(row: int, item: int, place: tuple) -> None:
            if place > out[row].get(item, (-1.0,)):
                out[row][item] = place

        for n, known in self.short.items():
            whole, at = shingles(hashes, bounds, n)
            names = np.array(sorted(known), np.uint64)
            # Runs of n words have hashes of their own; an item's name is that of a sequence shorter than a shingle.
            runs = _sequence_names(hashes, n)
            for p in np.flatnonzero(np.isin(runs, names)).tolist():
                row = int(np.searchsorted(bounds, p, "right")) - 1
                if p + n <= bounds[row + 1]:
                    for item in known[int(runs[p])]:
                        keep(row, item, (1.0, -(p - int(bounds[row])), 0, n))
        if not len(self.shingles):
            return out
        found, at = shingles(hashes, bounds, self.size)
        sieve = self._sieve()
        maybe = np.flatnonzero(sieve[(found & np.uint64(_FILTER - 1)).astype(np.int64)])
        place = np.minimum(np.searchsorted(self.shingles, found[maybe]), len(self.shingles) - 1)
        hit = self.shingles[place] == found[maybe]
        maybe, place = maybe[hit], place[hit]
        rows = np.searchsorted(at, maybe, "right") - 1
        for row in np.unique(rows).tolist():
            if bounds[row + 1] - bounds[row] >= self.size:
                mine = rows == row
                self._search_row(row, found[at[row] : at[row + 1]], maybe[mine] - at[row], place[mine], keep)
        return out

    def _sieve(self) -> np.ndarray:
        sieve = np.zeros(_FILTER, bool)
        sieve[(self.shingles & np.uint64(_FILTER - 1)).astype(np.int64)] = True
        self._sieve = lambda: sieve  # type: ignore[method-assign]
        return sieve

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "_sieve"}

    def _search_row(self, row: int, found: np.ndarray, at: np.ndarray, place: np.ndarray, keep) -> None:
        weights = np.full(len(found), self.other)
        weights[at] = self.weights[place]
        known = np.zeros(len(found) + 1)
        known[at + 1] = self.weights[place]
        known = np.cumsum(known)
        weighed = self.counts is None
        for n in sorted({n for p in np.unique(place).tolist() for n in self.sizes_of[p]}):
            m = min(n - self.size + 1, len(found))
            starts = np.flatnonzero(known[m:] - known[:-m] >= self.least * self.lightest[n] - 1e-9)
            if len(starts) and not weighed:
                self._weigh_others(found, weights, at)
                weighed = True
            for first in range(0, len(starts), 512):
                self._search_windows(row, n, m, starts[first : first + 512], found, weights, at, place, keep)

    def _weigh_others(self, found: np.ndarray, weights: np.ndarray, at: np.ndarray) -> None:
        """Sets the weights of shingles, all but those at `at`, that only items of other blocks hold."""
        others = np.ones(len(found), bool)
        others[at] = False
        others = np.flatnonzero(others)
        held = self.counts.get(found[others])
        weights[others[held > 0]] = [math.log(1 + self.counts.items / k) for k in held[held > 0].tolist()]

    def _sharing(self, n: int, places: np.ndarray) -> list[int]:
        """The items of n words of which these shingles hold the threshold's share, whatever their fingerprints."""
        places = np.unique(places)
        runs = spread(self.posts[places], self.posts[places + 1] - self.posts[places])
        items, which = np.unique(self.post_items[runs], return_inverse=True)
        shared = np.bincount(which, self.post_weights[runs], len(items))
        return items[(self.words_of[items] == n) & (shared >= self.least * self.totals[items] - 1e-9)].tolist()

    def _search_windows(self, row: int, n: int, m: int, starts: np.ndarray, found: np.ndarray, weights: np.ndarray, at: np.ndarray, place: np.ndarray, keep) -> None:
        spans = starts[:, None] + np.arange(m)
        prints = simhash(found[spans], weights[spans])
        tables = self.tables[n]
        for start, own in zip(starts.tolist(), prints.tolist(), strict=True):
            near = {i for b in range(BLOCKS) for i in tables[b].get(own >> 8 * b & 255, ())}
            near = {i for i in near if (own ^ self.prints[i]).bit_count() <= self.radius}
            if self.beyond:
                first, end = np.searchsorted(at, (start, start + m))
                near.update(self._sharing(n, place[first:end]))
            if not near:
                continue
            bag: dict[int, float] = defaultdict(float)
            for s, w in zip(found[start : start + m].tolist(), weights[start : start + m].tolist(), strict=True):
                bag[s] += w
            total = sum(bag.values())
            for i in near:
                common = sum(min(w, bag[s]) for s, w in self.bags[i].items() if s in bag)
                similarity = common / (total + sum(self.bags[i].values()) - common)
                if similarity >= self.least - 1e-9:
                    keep(row, self.ids[i], (round(similarity, 9), -start, -(own ^ self.prints[i]).bit_count(), m + self.size - 1))


def _sequence_names(hashes: np.ndarray, n: int) -> np.ndarray:
    """The hash that `shingles` gives a text of just these n words, for each run of n words."""
    from tidemill.llm._text import _FACTORS

    count = max(0, len(hashes) - n + 1)
    total = np.zeros(count, np.uint64)
    for j in range(n):
        total += hashes[j : j + count] * _FACTORS[j]
    return mix(total + _FACTORS[63] * np.array([n], np.uint64))


def item_indexes(items: DataFrame, size: int, least: float, radius: int, block_bytes: int) -> Iterator[ItemIndex]:
    """Indexes of all items, one after the other, in blocks of about block_bytes of text: the driver holds one, and so does a
    task, as documents are read once for each block. Rows of one item_id are in one block, so that the best of their windows
    is found."""
    own = items.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    total, count = own.agg(F.coalesce(F.sum(F.octet_length("text") + 64), F.lit(0)), F.count("*")).first()
    blocks = max(1, -(-int(total) // block_bytes))
    whole = ItemCounts(own, size, count) if blocks > 1 else None
    for b in range(blocks):
        rows = own.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b).collect()
        yield ItemIndex.build([tuple(r) for r in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1]))], size, least, radius, whole)


def find_leaks(
    docs: DataFrame, items: DataFrame, size: int = 5, least: float = 0.8, radius: int = 23, block_bytes: int = 8_000_000
) -> DataFrame:
    """One row for each document and item of which it holds a window: doc_id, item_id, similarity, distance (bits),
    first_word, n_words of the best window (the first of equals)."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = "doc_id long, item_id long, similarity double, distance int, first_word long, n_words int"

    def run_with(index: ItemIndex):
        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in sliced(batches, "text"):
                ids = pick(batch, "doc_id").to_pylist()
                rows = [(ids[r], i, p[0], -p[2], -p[1], p[3]) for r, x in sorted(index.search(pick(batch, "text")).items()) for i, p in sorted(x.items())]
                columns = list(zip(*rows, strict=True)) or [()] * 6
                types = [pa.int64(), pa.int64(), pa.float64(), pa.int32(), pa.int64(), pa.int32()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], [f.split()[0] for f in schema.split(", ")])

        return run

    out = None
    for index in item_indexes(items, size, least, radius, block_bytes):
        part = own.mapInArrow(run_with(index), schema)
        out = part if out is None else out.unionByName(part)
    return out


def drop_leaking(docs: DataFrame, items: DataFrame, size: int = 5, least: float = 0.8, radius: int = 23, block_bytes: int = 8_000_000) -> DataFrame:
    """The rows of docs, all columns, that hold no item's window."""

    def run_with(index: ItemIndex):
        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in sliced(batches, "text"):
                clean = np.ones(batch.num_rows, bool)
                clean[[r for r, x in index.search(pick(batch, "text")).items() if x]] = False
                yield batch.filter(pa.array(clean))

        return run

    for index in item_indexes(items, size, least, radius, block_bytes):
        docs = docs.mapInArrow(run_with(index), docs.schema)
    return docs
