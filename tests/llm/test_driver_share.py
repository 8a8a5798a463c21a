"""What reaches the driver, and how many rounds it plans: both decide how much memory it needs."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemill.llm import _shared, quality, toxicity


@pytest.fixture
def received(spark, monkeypatch):
    """Bytes of each table that the driver collects."""
    sizes = []
    kind = type(spark.range(1))
    old = kind.toArrow

    def counted(self):
        sizes.append((found := old(self)).nbytes)
        return found

    monkeypatch.setattr(kind, "toArrow", counted)
    return sizes


def _labelled(spark, n):
    """Texts of many words that tell nothing and a few that mark toxic ones."""
    rng = random.Random(1)
    rows = []
    for i in range(n):
        words = rng.sample(range(10**9), 300) + rng.choices(range(20), k=20)
        rows.append((i, " ".join([f"word{w}" for w in words] + ["vile", "nasty"] * (i % 2)), i % 2))
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    return docs, spark.createDataFrame([(i, 1 - t, t) for i, _, t in rows], "doc_id long, quality int, toxic int")


@pytest.mark.parametrize("model", [toxicity.fit_toxicity, quality.fit_quality])
def test_fit_collects_the_features_of_the_model_alone(spark, received, model):
    """A row's other features stay with Spark: about 600 of them here, 8 bytes each, against a few that enter the model."""
    n = 200
    docs, labels = _labelled(spark, n)
    fitted = model(docs, labels)
    assert 0 < len(fitted.ids) < 40
    assert received and sum(received) < 200 * n
    text = docs.where("doc_id in (0, 1)").orderBy("doc_id").toArrow()["text"].combine_chunks()
    clean, toxic = fitted.tails(fitted.scores(text))[:, 0]
    assert (clean < 0.5 < toxic) if model is toxicity.fit_toxicity else (toxic < 0.5 < clean)


def test_sample_keeps_the_first_of_near_copies_and_labelled_rows(spark):
    from tidemill.llm.ordinal import sampled

    text = " ".join(f"w{i}" for i in range(30))
    docs = spark.createDataFrame([(4, text), (2, text), (3, "other words here"), (5, ""), (6, None), (7, "no label")], "doc_id long, text string")
    labels = spark.createDataFrame([(2, 1), (3, 0), (4, 0), (5, 1), (6, 1), (7, None)], "doc_id long, toxic int")
    got = sampled(docs, labels, ["toxic"], 10, shape=False)
    assert [(r["doc_id"], r["label_toxic"], r["n_words"]) for r in got] == [(2, 1, 30), (3, 0, 3)]


def _rounds(monkeypatch):
    tags = []
    old = _shared.materialize
    monkeypatch.setattr(_shared, "materialize", lambda df, tag, keep=False: (tags.append(tag), old(df, tag, keep))[1])
    return tags


def test_stars_need_no_round(spark, monkeypatch):
    tags = _rounds(monkeypatch)
    edges = spark.range(100).select((F.col("id") + 1000).alias("a"), (F.col("id") % 7).alias("b"))
    found = {r.node: r.component for r in _shared.connected_components(edges).collect()}
    assert found == {i + 1000: i % 7 for i in range(100)} | {i: i for i in range(7)}
    assert len(tags) == 1


@pytest.mark.parametrize("seed", range(3))
def test_components_of_paths_and_odd_links(spark, seed):
    rng = np.random.default_rng(seed)
    n = 300
    names = rng.permutation(n).tolist()
    pairs = [(names[i], names[i + 1]) for i in range(n - 1) if i % 40] + [(int(a), int(b)) for a, b in rng.integers(1000, 1200, (120, 2))]
    pairs += pairs[:30] + [(b, a) for a, b in pairs[:30]] + [(5000, 5000)]
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in pairs:
        if a != b:
            a, b = find(a), find(b)
            up[max(a, b)] = min(a, b)
    edges = spark.createDataFrame(pairs, "a long, b long")
    assert {r.node: r.component for r in _shared.connected_components(edges).collect()} == {x: find(x) for x in list(up)}
    assert _shared.connected_components(edges.where("false")).count() == 0
