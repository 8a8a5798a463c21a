"""Operators on vectors against plain numpy over all pairs and whole matrices."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemill.llm.hardneg import Best, Tables, approximate, hard_negatives
from tidemill.llm.neardup import cosine, embedding_components, shape_of
from tidemill.llm.whitening import fit_whitening, integers, lobpcg, whiten

SCHEMA = "vec_id long, embedding array<float>, label int"
NAN = float("nan")


def _frame(spark, rows, schema=SCHEMA):
    return spark.createDataFrame(rows, schema)


def _groups(seed, d=16, labels=2):
    """Random vectors, tight and loose groups, chains, exact copies, and vectors turned by just about the threshold's angle."""
    rng = np.random.default_rng(seed)
    out = []
    for label in range(labels):
        own = [rng.standard_normal(d) for _ in range(40)]
        for spread, size in ((0.05, 120), (0.12, 60)):
            centre = rng.standard_normal(d)
            own += [centre + spread * rng.standard_normal(d) for _ in range(size)]
        link = rng.standard_normal(d)
        for _ in range(15):
            link = link + 0.3 * rng.standard_normal(d)
            own.append(link)
        own += [own[7]] * 5 + [2.5 * own[7]]
        out += [(v, label) for v in own]
    rng.shuffle(order := np.arange(len(out)))
    return [(3 * i, np.float32(out[o][0]).tolist(), out[o][1]) for i, o in enumerate(order)]


ODD = [(901, None, 0), (902, [0.0] * 16, 0), (903, [1.0] * 15 + [None], 0), (904, [1.0] * 15 + [NAN], 0), (905, [1.0] * 15 + [math.inf], 0), (906, [1.0] * 16, None), (907, [], 0),
       (908, [1.0, 2.0], 0), (909, [1.0, 2.0], 0), (910, [3e38] * 16, 1), (911, [2e38] * 16, 1), (912, [1e-44] * 16, 1)]


def _linked(rows, least):
    def good(v, label):
        return label is not None and v and all(c is not None and math.isfinite(c) for c in v) and any(v)

    n, up = [0] * len(rows), list(range(len(rows)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, (_, v, a) in enumerate(rows):
        for j in range(i):
            w, b = rows[j][1:]
            if good(v, a) and good(w, b) and a == b and len(v) == len(w) and cosine(np.float64(v) / max(map(abs, v)), np.float64(w) / max(map(abs, w))) >= least:
                n[i] += 1
                n[j] += 1
                up[find(i)] = find(j)
    first = {}
    for i, r in enumerate(rows):
        first[find(i)] = min(first.get(find(i), r[0]), r[0])
    return sorted((r[0], n[i], first[find(i)], first[find(i)] == r[0]) for i, r in enumerate(rows))


# Tiles of 16 rows make buckets full, cut them into blocks and draw balls around dense groups.
@pytest.mark.parametrize("tile_rows,bucket", [(2048, 256), (16, 8)])
def test_components_and_links_equal_all_pairs(spark, tile_rows, bucket):
    rows = _groups(tile_rows) + ODD
    df = _frame(spark, rows).withColumns({"node": F.lit("x"), "w": F.lit(1), "ball": F.lit(None)})
    found = embedding_components(df, 0.93, recall=1 - 1e-9, bucket=bucket, tile_rows=tile_rows)
    assert found.columns == ["vec_id", "n_links", "component_id", "kept"]
    assert sorted(map(tuple, found.collect())) == _linked(rows, 0.93)


def test_threshold_is_met_in_double_precision(spark):
    turned = [(i, [math.cos(t), math.sin(t)], 0) for i, t in enumerate([0.0, math.acos(0.93) - 1e-9, -math.acos(0.93) - 1e-9])]
    found = embedding_components(_frame(spark, turned, "vec_id long, embedding array<double>, label int"), recall=1 - 1e-9)
    assert sorted(map(tuple, found.collect())) == [(0, 1, 0, True), (1, 1, 0, False), (2, 0, 2, True)]


def test_components_of_null_and_repeated_ids_and_no_rows(spark):
    rows = [(None, [1.0, 0.0], 0), (5, [1.0, 0.01], 0), (5, [1.0, 0.0], 0), (4, [0.0, 1.0], 0), (None, [0.0, -1.0], 0)]
    found = embedding_components(_frame(spark, rows)).collect()
    assert sorted(map(str, map(tuple, found))) == sorted(map(str, [(None, 2, 5, False), (5, 2, 5, True), (5, 2, 5, True), (4, 0, 4, True), (None, 0, None, False)]))
    assert embedding_components(_frame(spark, [])).collect() == []


def test_shape_reaches_the_recall_at_any_size():
    for most in (10, 10_000, 10**9):
        bits, tables = shape_of(most, 0.93, 0.999, 256)
        assert 1 - (1 - (1 - math.acos(0.93) / math.pi) ** bits) ** tables >= 0.999


@pytest.mark.parametrize("d,k", [(12, 12), (64, 32), (300, 20)])
def test_lobpcg_against_a_dense_solver(d, k):
    rng = np.random.default_rng(d)
    b = rng.standard_normal((d, 2 * d)) * np.linspace(1, 2, d)[:, None]
    v = b @ b.T / d
    values, vectors = lobpcg(lambda w: v @ w, d, k)
    assert np.allclose(values, np.linalg.eigvalsh(v)[::-1][:k], rtol=1e-12)
    assert np.abs(v @ vectors - vectors * values).max() < 1e-9 and np.allclose(vectors.T @ vectors, np.eye(k), atol=1e-12)


def test_lobpcg_with_equal_and_zero_eigenvalues():
    v = np.diag([5.0, 5.0, 5.0, 1.0, *[0.0] * 60])
    values, vectors = lobpcg(lambda w: v @ w, 64, 6)
    assert np.allclose(values, [5, 5, 5, 1, 0, 0], atol=1e-9) and np.abs(v @ vectors - vectors * values).max() < 1e-9


def test_lobpcg_raises_where_residuals_stay():
    rng = np.random.default_rng(0)
    with pytest.raises(RuntimeError, match="residuals"):
        lobpcg(lambda w: np.diag(np.arange(1.0, 301.0)) @ w + 1e-3 * rng.standard_normal(w.shape), 300, 10, limit=8)


def test_whitening_equals_plain_numpy(spark):
    rng = np.random.default_rng(3)
    good = [(i, np.float32(rng.standard_normal(24) * np.linspace(0.2, 1, 24)).tolist(), 0) for i in range(400)]
    df = _frame(spark, [*good, (None, good[0][1], None), (7, good[3][1], 1), *[r for r in ODD if r[0] in (901, 903, 904, 905, 907)]]).withColumns({"id": F.lit("x"), "x": F.lit(2)}).repartition(5)
    found = whiten(df, components=10).collect()
    kept = [*[r[1] for r in good], good[0][1], good[3][1]]
    x = np.floor(64 * np.float64(kept)).astype(np.int64) + 1_000_000
    n, s = len(x), x.sum(axis=0)
    c = x - s / n
    values, vectors = np.linalg.eigh(c.T @ c / n)
    values, z = values[::-1], c @ vectors[:, ::-1]
    assert len(found) == 10 * n
    mine = {}
    for r in found:
        mine.setdefault(r.vec_id, {}).setdefault(r.component, []).append(r)
    for i in (0, 5, 399):
        for k in range(10):
            r = mine[i][k + 1][0]
            assert r.n == n and r.deviation == sum((n * int(a) - int(b)) ** 2 for a, b in zip(x[i], s, strict=True))
            assert abs(abs(r.whitened) - abs(z[i, k]) / math.sqrt(values[k])) < 1e-9 and abs(r.explained - values[k] / values.sum()) < 1e-12 and r.identity_error < 1e-10
    for k in range(10):  # one sign for all rows of a component
        signs = {np.sign(mine[i][k + 1][0].whitened * z[i, k]) for i in range(400) if i != 7}
        assert len(signs) == 1
    assert len(mine[None][1]) == 1 and len(mine[7][1]) == 2


def test_whitening_of_odd_tables(spark):
    assert whiten(_frame(spark, [])).collect() == [] and whiten(_frame(spark, [(1, None, 0)])).collect() == []
    assert whiten(_frame(spark, [(i, [1.0, 2.0], 0) for i in range(5)])).collect() == []
    flat = whiten(_frame(spark, [(i, [float(i), 7.0], 0) for i in range(5)])).collect()
    assert {r.component for r in flat} == {1} and abs(sum(r.whitened**2 for r in flat) / 5 - 1) < 1e-12
    with pytest.raises(ValueError, match="lengths"):
        whiten(_frame(spark, [(1, [1.0], 0), (2, [1.0, 2.0], 0)]))
    large = integers(_frame(spark, [(i, [(-1.0) ** i * 1e12, float(i)], 0) for i in range(4)], "vec_id long, embedding array<double>, label int"), "vec_id", "embedding", 64.0, 1_000_000)
    assert fit_whitening(large).centre.sums == [4_000_000, 64 * 6 + 4_000_000]


def _mined(rows, scale=256):
    good = [(i, np.floor(np.float64(v) * scale).astype(object), a) for i, v, a in rows if i is not None and a is not None and v and all(c is not None and math.isfinite(c) for c in v)]
    good = [(i, [int(c) for c in x], a) for i, x, a in good]
    out = []
    for k, (i, x, a) in enumerate(good):
        if i % 10:
            continue
        scored = sorted((-sum(p * q for p, q in zip(x, y, strict=True)), j, b) for m, (j, y, b) in enumerate(good) if m != k and len(x) == len(y))
        for s, j, _ in [r for r in scored if r[2] == a][:5]:
            hard = [r for r in scored if r[2] != a and 80 * -s <= 100 * -r[0] <= 100 * -s][:5]
            out += [(i, j, n, r[1], -s, -r[0]) for n, r in enumerate(hard, 1)]
    return sorted(out)


@pytest.mark.parametrize("cells,per_tile,parts", [(32, 1000, 3), (1, 7, 2), (256, 20, 5)])
def test_hard_negatives_equal_all_pairs(spark, cells, per_tile, parts):
    rng = np.random.default_rng(cells)
    centre = rng.standard_normal(8) / 3
    rows = [(i, np.float32(centre + rng.standard_normal(8) / 3).tolist(), int(rng.integers(3))) for i in range(300)]
    rows += [(300 + i, rows[20][1], i % 3) for i in range(30)]  # ties
    rows += [(400, [-c for c in rows[0][1]], 4), (410, [0.0] * 8, 1), (420, [1.0, 2.0], 1), (421, [1.0, 2.0], 1), (422, [1.0, 1.8], 2), *[(None if r[0] == 906 else 10 * r[0], *r[1:]) for r in ODD[:7]]]
    df = _frame(spark, rows).withColumns({"row": F.lit("x"), "size": F.lit(1), "anchor": F.lit(None)}).repartition(4)
    found = hard_negatives(df, F.col("vec_id") % 10 == 0, cells=cells, anchors_per_tile=per_tile, least_parts=parts)
    mine = sorted(map(tuple, found.collect()))
    assert mine == _mined(rows) and len(mine) > 100


def test_hard_negatives_of_odd_tables(spark):
    assert hard_negatives(_frame(spark, []), F.col("vec_id") % 10 == 0).collect() == []
    assert hard_negatives(_frame(spark, [(1, [1.0], 0), (2, [1.0], 1)]), F.col("vec_id") % 10 == 0).collect() == []
    twice = _frame(spark, [(10, [1.0], 0), (10, [1.0], 0), (3, [0.95], 1)])
    assert sorted(map(tuple, hard_negatives(twice, F.col("vec_id") == 10, scale=10.0).collect())) == [(10, 10, 1, 3, 100, 90)] * 2


def test_bounds_hold_and_narrow():
    rng = np.random.default_rng(5)
    x = rng.integers(-1000, 1000, (500, 12)).astype(np.int32)
    for cells in (2, 64):
        cuts = np.quantile(x, np.arange(1, cells) / cells, axis=0, method="nearest").T
        lows, highs = np.column_stack([x.min(axis=0), cuts + 1]), np.column_stack([cuts, x.max(axis=0)])
        low, high = Tables(x[:9], lows, highs).bounds(approximate(x, highs))
        exact = x.astype(np.int64) @ x[:9].T.astype(np.int64)
        assert (low <= exact).all() and (exact <= high).all()
        width = float((high - low).mean())
    assert width < 0.1 * 12 * 1000 * 1000
    best = Best(2, 3)
    best.add(np.array([0, 0, 0, 0, 1]), np.array([5, 9, 5, 5, -4]), np.array([4, 3, 2, 1, 8]))
    assert best.score[0].tolist() == [9, 5, 5] and best.id[0].tolist() == [3, 1, 2] and best.id[1, 0] == 8
