"""Ordinal cumulative-link regression on hashed text: P(grade <= k) = logistic(threshold[k] - weights . features).

One weight vector serves all thresholds, which stay in order because their gaps are exponentials. Features are hashed: words and
their first bytes, runs of marks, and a few buckets of a text's shape. A feature has two values, log(1 + count) and
log(1 + count per hundred words), each with a weight. A feature enters the model if it
is in at least `least_docs` sampled texts and its share of texts differs between low and high grades by `least_z` standard
errors, which leaves a short list of weights. Fitting uses at most `sample` labelled rows (the lowest hashes of doc_id, so
the same rows each time), of each group of near copies one. Spark counts their features; the driver gets the counts of
features in `least_docs` texts or more and, of each row, the features that enter the model. Scoring covers all rows, whole
texts, without a shuffle."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.llm._shared import materialize, pick, scratch, sliced
from tidemill.llm._text import NOT_BLANK, WORDLIKE, column_bytes, mix, shingles, words

BITS = 20
MARKS = NOT_BLANK & ~WORDLIKE
_UPPER = np.zeros(256, bool)
_UPPER[ord("A") : ord("Z") + 1] = True


def _feature(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - BITS)).astype(np.int64)


#: Lengths in bytes of the word beginnings that are features beside whole words.
STEMS = (4, 6, 7)


def _stems(text: pa.Array, starts: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Which words are longer than `length` bytes, and the hashes of their first bytes."""
    data, _ = column_bytes(text)
    longer = np.flatnonzero(ends - starts > length)
    hashes = np.zeros(len(longer), np.uint64)
    for j in range(length):
        hashes = hashes * np.uint64(0x100000001B3) + data[starts[longer] + j].astype(np.uint64) + np.uint64(1)
    return longer, mix(hashes + np.uint64(length))


def values(count: np.ndarray, words_: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.log1p(count), np.log1p(100 * count / (words_ + 20))


def features(column: pa.Array, shape: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, feature, count) triples in order of row, and each row's number of words. With `shape`, also runs of marks and
    buckets of length, capital letters, marks per word and repetition."""
    text = pc.fill_null(column.cast(pa.large_string()), "")
    rows = len(text)
    lower = pc.utf8_lower(text)
    hashes, bounds, starts, ends = words(lower, WORDLIKE)
    n = np.diff(bounds)
    row, feature = [np.repeat(np.arange(rows), n)], [_feature(hashes)]
    for length in STEMS:
        longer, stems = _stems(lower, starts, ends, length)
        row.append(row[0][longer])
        feature.append(_feature(stems))
    if shape:
        marks, mark_bounds, _, _ = words(text, MARKS)
        m = np.diff(mark_bounds)
        row.append(np.repeat(np.arange(rows), m))
        feature.append(_feature(mix(marks ^ np.uint64(0xA5A5A5A5))))
        data, offsets = column_bytes(text)
        capitals = np.add.reduceat(np.append(_UPPER[data], False).astype(np.int64), offsets[:-1]) * (np.diff(offsets) > 0) if rows else np.zeros(0, np.int64)
        key = np.unique(np.stack([row[0], feature[0]]), axis=1)[0] if rows else np.zeros(0, np.int64)
        distinct = np.bincount(key, minlength=rows)
        for salt, bucket in enumerate((np.log2(1 + n).astype(np.int64), 20 * capitals // np.maximum(np.diff(offsets), 1), np.minimum(8 * m // np.maximum(n, 1), 40), 10 * distinct // np.maximum(n, 1))):
            row.append(np.arange(rows))
            feature.append(_feature(mix((bucket.astype(np.uint64) + np.uint64(1)) * np.uint64(1000003) + np.uint64(salt))))
    keys, counts = np.unique(np.concatenate(row) << BITS | np.concatenate(feature), return_counts=True)
    return keys >> BITS, keys & ((1 << BITS) - 1), counts, n


@dataclass
class Model:
    """Weights by feature, thresholds in order; `levels` grades from 0."""

    ids: np.ndarray
    weights: np.ndarray
    thresholds: np.ndarray
    shape: bool

    def scores(self, column: pa.Array) -> np.ndarray:
        """weights . features for each row."""
        row, feature, count, n = features(column, self.shape)
        if not len(self.ids):
            return np.zeros(len(n))
        at = np.minimum(np.searchsorted(self.ids, feature), len(self.ids) - 1)
        known = self.ids[at] == feature
        each = values(count[known], n[row[known]])
        parts = self.weights.reshape(2, -1)[:, at[known]]
        return np.bincount(row[known], parts[0] * each[0] + parts[1] * each[1], minlength=len(n))

    def tails(self, scores: np.ndarray) -> np.ndarray:
        """P(grade > k) for each threshold k."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - scores[:, None], -60, 60)))


def fit_cumulative_link(x: list[tuple[np.ndarray, np.ndarray]], grades: np.ndarray, size: int, levels: int, ridge: float = 1.0, rounds: int = 400) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds by gradient descent with momentum on the penalised likelihood. x: (positions, values) a row."""
    rows = np.repeat(np.arange(len(x)), [len(p) for p, _ in x])
    at = np.concatenate([p for p, _ in x]) if x else np.zeros(0, np.int64)
    values = np.concatenate([v for _, v in x]) if x else np.zeros(0)
    share = np.array([((grades <= k).sum() + 0.5) / (len(grades) + 1) for k in range(levels - 1)])
    cut = np.log(share / (1 - share))
    free = np.concatenate([[cut[0]], np.log(np.maximum(np.diff(cut), 1e-3))])
    weights, velocity_w, velocity_c = np.zeros(size), np.zeros(size), np.zeros(len(free))
    scale_w, scale_c = np.zeros(size), np.zeros(len(free))
    n = len(grades)
    for t in range(1, rounds + 1):
        theta = np.concatenate([[free[0]], free[0] + np.cumsum(np.exp(free[1:]))])
        z = np.bincount(rows, weights[at] * values, minlength=n)
        edges = np.concatenate([np.full((n, 1), -60.0), theta[None, :] - z[:, None], np.full((n, 1), 60.0)], axis=1)
        f = 1 / (1 + np.exp(-np.clip(edges, -60, 60)))
        slope = f * (1 - f)
        slope[:, 0] = slope[:, -1] = 0
        own = np.arange(n)
        p = np.maximum(f[own, grades + 1] - f[own, grades], 1e-12)
        up, down = slope[own, grades + 1] / p, slope[own, grades] / p
        grad_z = up - down  # of the negative log-likelihood
        grad_w = np.bincount(at, grad_z[rows] * values, minlength=size) + ridge * weights
        grad_theta = np.array([down[grades == k + 1].sum() - up[grades == k].sum() for k in range(levels - 1)])
        grad_c = np.concatenate([[grad_theta.sum()], [grad_theta[j:].sum() * np.exp(free[j]) for j in range(1, len(free))]])
        for value, grad, velocity, scale in ((weights, grad_w, velocity_w, scale_w), (free, grad_c, velocity_c, scale_c)):
            velocity *= 0.9
            velocity += 0.1 * grad
            scale *= 0.99
            scale += 0.01 * grad * grad
            value -= 0.05 * (velocity / (1 - 0.9**t)) / (np.sqrt(scale / (1 - 0.99**t)) + 1e-8)
    return weights, np.concatenate([[free[0]], free[0] + np.cumsum(np.exp(free[1:]))])


def sample_rows(docs: DataFrame, labels: DataFrame, columns: list[str], sample: int, shape: bool) -> DataFrame:
    """Sampled labelled texts as features, at most `sample` of them: doc_id, features and counts (arrays), n_words, copy and the
    labels. One row for each doc_id, of several that whose text has the smallest hash; then of those with equal `copy` the
    smallest doc_id. Texts without words and rows with a null label are left out."""
    chosen = (
        labels.where(F.col("doc_id").isNotNull())
        .groupBy(F.col("doc_id").cast("long").alias("label_id"))
        .agg(*[F.max(c).cast("int").alias(f"label_{c}") for c in columns])
        .orderBy(F.xxhash64("label_id"), "label_id")
        .limit(sample)
    )
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.xxhash64(F.col("text").cast("string")).alias("mark"))
    joined = own.join(F.broadcast(chosen), F.col("doc_id") == F.col("label_id")).drop("label_id")
    names = [f"label_{c}" for c in columns]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text"):
            row, feature, count, n = features(pick(batch, "text"), shape)
            hashes, bounds, _, _ = words(pick(batch, "text"))
            found, at = shingles(hashes, bounds)
            least = [int(found[a:b].min()) if b > a else 0 for a, b in zip(at[:-1], at[1:], strict=True)]
            cuts = np.searchsorted(row, np.arange(batch.num_rows + 1)).astype(np.int32)
            lists = [pa.ListArray.from_arrays(cuts, pa.array(v.astype(np.int32))) for v in (feature, count)]
            yield pa.RecordBatch.from_arrays(
                [pick(batch, "doc_id"), pick(batch, "mark"), *lists, pa.array(n.astype(np.int64)), pa.array(np.array(least, np.uint64).view(np.int64)), *[pick(batch, c) for c in names]],
                ["doc_id", "mark", "features", "counts", "n_words", "copy", *names],
            )

    schema = "doc_id long, mark long, features array<int>, counts array<int>, n_words long, copy long" + "".join(f", {c} int" for c in names)
    each = joined.mapInArrow(run, schema)
    one = each.groupBy("doc_id").agg(F.min_by(F.struct(*[c for c in each.columns if c not in ("doc_id", "mark")]), "mark").alias("r")).select("doc_id", "r.*")
    usable = one.where(" and ".join(["n_words > 0", *[f"{c} is not null" for c in names]]))
    return usable.groupBy("copy").agg(F.min_by(F.struct(*[c for c in one.columns if c != "copy"]), "doc_id").alias("r")).select("r.*", "copy")


@contextmanager
def fit_sample(docs: DataFrame, labels: DataFrame, columns: list[str], sample: int, shape: bool) -> Iterator[DataFrame]:
    """sample_rows, written to the shared folder for the time of a fit."""
    with scratch(docs.sparkSession):
        yield materialize(sample_rows(docs, labels, columns, sample, shape), "ordinal-sample")


def collected(rows: DataFrame) -> list[dict]:
    """sample_rows as dicts in order of doc_id."""
    found = rows.toArrow().combine_chunks().sort_by("doc_id")
    # Features stay in two flat arrays; a row's are views of them.
    flat = {c: found[c].combine_chunks() if found.num_rows else pa.array([], pa.list_(pa.int32())) for c in ("features", "counts")}
    bounds = flat["features"].offsets.to_numpy()
    ids, counts = (flat[c].values.to_numpy() for c in ("features", "counts"))
    kept = found.drop(["features", "counts"]).to_pylist()
    for r, first, end in zip(kept, bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        r["features"], r["counts"] = ids[first:end], counts[first:end]
    return kept


def sampled(docs: DataFrame, labels: DataFrame, columns: list[str], sample: int, shape: bool) -> list[dict]:
    """sample_rows with all their features, on the driver."""
    return collected(sample_rows(docs, labels, columns, sample, shape))


def discriminating(rows: DataFrame, high: Column, least_docs: int = 10, least_z: float = 6.0) -> tuple[np.ndarray, np.ndarray]:
    """Features of sample_rows whose share of texts differs between low and high rows, in order, and the sign of the
    difference. Features of fewer than `least_docs` texts never reach the driver."""
    each = rows.select(high.alias("high"), F.explode(F.concat(F.array(F.lit(-1)), "features")).alias("feature"))  # -1: all rows
    counts = each.groupBy("feature").agg(F.count("*").alias("both"), F.count_if("high").alias("high"))
    found = counts.where((F.col("both") >= least_docs) | (F.col("feature") < 0)).toArrow().sort_by("feature")
    ids, both, n_high = (found[c].to_numpy() for c in ("feature", "both", "high"))
    if not len(ids) or not 0 < n_high[0] < both[0]:
        return np.zeros(0, np.int64), np.zeros(0)
    n1, n0 = int(n_high[0]), int(both[0] - n_high[0])
    ids, both, n_high = ids[1:].astype(np.int64), both[1:], n_high[1:]
    share = both / (n1 + n0)
    error = np.sqrt(np.maximum(share * (1 - share), 1e-12) * (1 / n1 + 1 / n0))
    z = (n_high / n1 - (both - n_high) / n0) / error
    chosen = np.abs(z) >= least_z
    return ids[chosen], np.sign(z[chosen])


def with_features(rows: DataFrame, ids: np.ndarray) -> list[dict]:
    """sample_rows on the driver, with those of their features that are among ids (in order)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = [pick(batch, c) for c in ("features", "counts")]
            feature, count = (x.flatten().to_numpy() for x in lists)
            known = np.isin(feature, ids)
            ends = np.append(0, np.cumsum(known))[np.append(0, np.cumsum(pc.list_value_length(lists[0]).to_numpy()))]
            kept = [pa.ListArray.from_arrays(ends.astype(np.int32), pa.array(v[known])) for v in (feature, count)]
            yield batch.set_column(batch.schema.get_field_index("features"), "features", kept[0]).set_column(batch.schema.get_field_index("counts"), "counts", kept[1])

    return collected(rows.mapInArrow(run, rows.schema))


def fit(rows: list[dict], ids: np.ndarray, grade: Callable[[dict], int], levels: int, shape: bool) -> Model:
    """A model of grade(row) on the features ids; without rows of both kinds, one without weights that gives grade 0 to all."""
    grades = np.array([grade(r) for r in rows], np.int64)
    if not len(rows) or len(np.unique(grades)) < 2:
        return Model(np.zeros(0, np.int64), np.zeros(0), np.arange(levels - 1) + 10.0, shape)
    x = []
    for r in rows:
        at = np.searchsorted(ids, r["features"])
        x.append((np.concatenate([at, at + len(ids)]), np.concatenate(values(r["counts"], np.float64(r["n_words"])))))
    weights, thresholds = fit_cumulative_link(x, grades, 2 * len(ids), levels)
    return Model(ids, weights, thresholds, shape)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, expected (grade), tails (array: P(grade > 0), P(grade > 1), ...), grade (the likeliest, the lowest of equals)."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text"):
            tails = model.tails(model.scores(pick(batch, "text")))
            each = -np.diff(np.concatenate([np.ones((len(tails), 1)), tails, np.zeros((len(tails), 1))], axis=1), axis=1)
            yield pa.RecordBatch.from_arrays(
                [pick(batch, "doc_id"), pa.array(tails.sum(1)), pa.array(list(tails), pa.list_(pa.float64())), pa.array(each.argmax(1).astype(np.int32))],
                ["doc_id", "expected", "tails", "grade"],
            )

    return own.mapInArrow(run, "doc_id long, expected double, tails array<double>, grade int")


def keep_rows(docs: DataFrame, model: Model, keep: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """The rows of docs, all columns, whose tail probabilities `keep` accepts."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text"):
            yield batch.filter(pa.array(keep(model.tails(model.scores(pick(batch, "text"))))))

    return docs.mapInArrow(run, docs.schema)
