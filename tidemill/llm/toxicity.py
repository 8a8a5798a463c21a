"""Toxicity: an ordinal model of severity. Grade 0 is clean; a text labelled toxic has grade 2 if its share of words that
mark toxic texts is at least the median of the toxic sample, else 1. A text is rejected if P(grade > 0) reaches `limit`.

Null and empty texts have no features, so they get the base rates and pass. Repeated rows get equal results. Without labels
of both kinds nothing is rejected. A very long text costs time and
memory in proportion to itself. An empty table gives no rows. Extra columns are ignored, or kept by drop_toxic."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.llm.ordinal import Model, discriminating, fit, fit_sample, keep_rows, score, with_features


def fit_toxicity(docs: DataFrame, labels: DataFrame, sample: int = 6000) -> Model:
    with fit_sample(docs, labels, ["toxic"], sample, shape=False) as table:
        ids, signs = discriminating(table, F.col("label_toxic") > 0)
        rows = with_features(table, ids)
    marks = set(ids[signs > 0].tolist())
    for r in rows:
        r["density"] = sum(c for f, c in zip(r["features"].tolist(), r["counts"].tolist(), strict=True) if f in marks) / r["n_words"]
    densities = [r["density"] for r in rows if r["label_toxic"] > 0]
    middle = float(np.median(densities)) if densities else 0.0
    return fit(rows, ids, lambda r: 0 if r["label_toxic"] <= 0 else 1 + (r["density"] >= middle and r["density"] > 0), 3, shape=False)


def grade_toxicity(docs: DataFrame, labels: DataFrame, sample: int = 6000, limit: float = 0.5) -> DataFrame:
    """Per row of docs: doc_id, expected_severity (0 to 2), p_toxic, p_severe, severity (the likeliest grade), rejected."""
    found = score(docs, fit_toxicity(docs, labels, sample))
    tail = [F.get("tails", F.lit(k)) for k in range(2)]
    return found.select("doc_id", F.col("expected").alias("expected_severity"), tail[0].alias("p_toxic"), tail[1].alias("p_severe"), F.col("grade").alias("severity"), (tail[0] >= limit).alias("rejected"))


def drop_toxic(docs: DataFrame, train: DataFrame, labels: DataFrame, sample: int = 6000, limit: float = 0.5) -> DataFrame:
    """The rows of docs that the model fitted on `train` doesn't reject, with all columns."""
    return keep_rows(docs, fit_toxicity(train, labels, sample), lambda tails: tails[:, 0] < limit)
