"""The boosted classifier: what its query fits, and scores from outside the folds."""

import random

import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from quillstone import config as C
from quillstone.operators import training
from quillstone.plans.queries import feature_vector, gbt_score

DATA = "/root/testdata/sf0.001"


def test_gbt_score_fits_all_rows_and_words(spark, monkeypatch):
    seen, classifier = [], training.classifier

    class Few:
        """Records what is fitted; the model itself has few trees, so that the test is short."""

        def __init__(self, settings):
            self.settings = settings

        def fit(self, rows):
            seen.append((self.settings.trees, {r.doc_id: r.features.toArray().tolist() for r in rows.collect()}))
            return classifier(C.Settings(trees=2)).fit(rows)

    monkeypatch.setattr(training, "classifier", lambda settings=C.DEFAULT: Few(settings))
    scored = gbt_score(spark, DATA)
    assert scored.columns == ["doc_id", "label", "score"]
    [(trees, fitted)] = seen
    want = {r.doc_id: list(r)[2:] for r in feature_vector(spark, DATA).collect()}
    assert trees == C.DEFAULT.trees == 150 and set(fitted) == set(want)
    assert all(fitted[i] == pytest.approx(want[i], abs=1e-6) for i in want)
    assert {r.doc_id for r in scored.collect()} == set(want)


def test_out_of_fold(spark):
    r = random.Random(3)
    data = [(i, [r.random(), r.random()], float(i % 3 == 0)) for i in range(90)]
    rows = spark.createDataFrame(data, "doc_id long, v array<double>, label double").withColumn("features", array_to_vector("v"))
    settings = C.Settings(trees=2)
    got = {x.doc_id: x.score for x in training.out_of_fold(rows, 3, settings).collect()}
    assert set(got) == set(range(90))
    dealt = training.folds(rows, 3, settings.seed).cache()
    assert {(x.fold, x.label): x["count"] for x in dealt.groupBy("fold", "label").count().collect()} == {(f, y): 10 + 10 * (y == 0) for f in range(3) for y in (0.0, 1.0)}
    model = training.classifier(settings).fit(dealt.filter("fold != 1"))
    held = {x.doc_id: x.score for x in training.forged_probability(model, dealt.filter(F.col("fold") == 1)).collect()}
    assert len(held) == 30 and all(abs(got[i] - s) < 1e-9 for i, s in held.items())


def test_training_fits_all_rows(spark, monkeypatch):
    from quillstone.operators import models

    seen, classifier = [], training.classifier

    class Few:
        def fit(self, rows):
            seen.append(rows.count())
            return classifier(C.Settings(trees=1, depth=1)).fit(rows)

    monkeypatch.setattr(training, "classifier", lambda settings=C.DEFAULT: Few())
    n = 20_040
    docs = spark.range(n).select(F.col("id").alias("doc_id"), F.concat(F.lit("Shop\nTOTAL "), F.col("id").cast("string"), F.lit(".00")).alias("text"), F.lit("Shop").alias("true_vendor"), F.lit("2024-01-01").alias("true_date"), (F.col("id") % 2).cast("int").alias("is_forged"))
    bundle = models.train(docs)
    # Five folds without a fifth of the rows each, and then all rows.
    assert seen[-1] == n and sum(seen[:-1]) == 4 * n and bundle.forged_ratio == 0.5
