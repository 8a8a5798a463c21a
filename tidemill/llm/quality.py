"""Quality: an ordinal model of ratings 0 (poor), 1 (good but toxic) and 2 (good), for selection by expected grade or tail.

Null and empty texts have the features of no words; repeated rows get equal results. Without labels of both kinds nothing is
known, and all rows get grade 0. A very long text costs time and
memory in proportion to itself. An empty table gives no rows; extra columns are ignored."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.llm.ordinal import Model, discriminating, fit, fit_sample, score, with_features


def fit_quality(docs: DataFrame, labels: DataFrame, sample: int = 6000) -> Model:
    with fit_sample(docs, labels, ["quality", "toxic"], sample, shape=True) as table:
        ids, _ = discriminating(table, F.col("label_quality") != 0)
        rows = with_features(table, ids)
    return fit(rows, ids, lambda r: 0 if not r["label_quality"] else 1 if r["label_toxic"] else 2, 3, shape=True)


def grade_quality(docs: DataFrame, labels: DataFrame, sample: int = 6000, limit: float = 0.5) -> DataFrame:
    """Per row of docs: doc_id, expected_grade (0 to 2), p_good (P(grade > 0)), p_best (P(grade > 1)), grade, selected."""
    found = score(docs, fit_quality(docs, labels, sample))
    tail = [F.get("tails", F.lit(k)) for k in range(2)]
    return found.select("doc_id", F.col("expected").alias("expected_grade"), tail[0].alias("p_good"), tail[1].alias("p_best"), "grade", (tail[0] >= limit).alias("selected"))
