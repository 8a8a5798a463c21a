"""Products of matrices in tiles equal numpy's."""

import numpy as np
import pytest

from tidemill.operators import matrix as mat


def _long(spark, m, x):
    return spark.createDataFrame([(m, i, j, float(x[i, j])) for i in range(x.shape[0]) for j in range(x.shape[1])], "matrix_id long, i long, j long, v double")


@pytest.mark.parametrize("size", [3, 64])
def test_products_in_tiles(spark, size, monkeypatch):
    rng = np.random.default_rng(4)
    pairs = {1: (rng.normal(size=(20, 7)), rng.normal(size=(7, 11))), 2: (rng.normal(size=(1, 40)), rng.normal(size=(40, 2)))}
    a, b = (_long(spark, 1, pairs[1][k]).unionByName(_long(spark, 2, pairs[2][k])).repartition(4) for k in (0, 1))
    tiles = mat.mul_tiles(mat.to_tiles(a, size), mat.to_tiles(b, size), size)
    assert tiles.groupBy("matrix_id", "bi", "bj").count().where("count > 1").count() == 0
    found = {(r.matrix_id, r.i, r.j): r.v for r in mat.from_tiles(tiles, size=size).collect()}
    for m, (x, y) in pairs.items():
        want = x @ y
        got = np.array([[found[m, i, j] for j in range(want.shape[1])] for i in range(want.shape[0])])
        np.testing.assert_allclose(got, want, rtol=1e-12, atol=1e-12)
        assert all(v == 0 for (k, i, j), v in found.items() if k == m and (i >= want.shape[0] or j >= want.shape[1]))
    cut = mat.from_tiles(mat.to_tiles(_long(spark, 1, pairs[1][0]), size), 20, 7, size)
    assert {(r.i, r.j): r.v for r in cut.collect()} == {(i, j): pairs[1][0][i, j] for i in range(20) for j in range(7)}


def test_repeated_cells_and_empty_matrices(spark):
    twice = spark.createDataFrame([(1, 0, 0, 2.0), (1, 0, 0, 3.0)], "matrix_id long, i long, j long, v double")
    assert mat.from_tiles(mat.to_tiles(twice, 2), 1, 1, 2).first().v == 5
    assert mat.mul_tiles(mat.to_tiles(twice.limit(0)), mat.to_tiles(twice)).count() == 0
