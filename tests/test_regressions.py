"""Regressions of many strengths at once against Spark's own, one at a time."""

import numpy as np
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from cairn.operators import catalogs, regressions

STRENGTHS = (1e-4, 0.01, 1.0, 100.0)


def made(spark, n=600, d=6, classes=4):
    rng = np.random.default_rng(7)
    centre = rng.normal(size=(classes, d))
    y = rng.integers(0, classes, n)
    x = centre[y] + rng.normal(size=(n, d))
    return spark.createDataFrame([(i, f"c{c}", v.tolist()) for i, (c, v) in enumerate(zip(y, x, strict=True))], "id long, label string, embedding array<double>").repartition(5)


def test_same_models_as_one_at_a_time(spark, monkeypatch):
    df = made(spark)
    models = regressions.fitted(df, STRENGTHS)
    vectors = df.select(array_to_vector("embedding").alias("features"), F.substring("label", 2, 1).cast("double").alias("label"))
    for i, c in enumerate(STRENGTHS):
        own = LogisticRegression(maxIter=500, tol=1e-12, regParam=1.0 / (c * 600), elasticNetParam=0.0, standardization=False, family="multinomial").fit(vectors)
        w, b = own.coefficientMatrix.toArray(), own.interceptVector.toArray()
        got = models.weights[i]
        assert np.allclose(got[:, :-1] - got[:, :-1].mean(0), w - w.mean(0), atol=2e-3)
        assert np.allclose(got[:, -1] - got[:, -1].mean(), b - b.mean(), atol=2e-3)
    # in several goes, and whatever the blocks
    monkeypatch.setattr(regressions, "WEIGHTS", 1)
    monkeypatch.setattr(regressions, "BLOCK", 100)
    again = regressions.fitted(df.repartition(2), STRENGTHS)
    assert np.allclose(again.weights, models.weights, atol=2e-3)
    told = {(r.id, r.strength): r.prediction for r in regressions.predicted(models, df).collect()}
    x = np.array([v for v, in df.orderBy("id").select("embedding").collect()])
    z = np.concatenate((x, np.ones((600, 1))), 1) @ models.weights[2].T
    assert [told[i, 1.0] for i in range(600)] == [f"c{c}" for c in z.argmax(1)]


def test_odd_rows_and_empty_tables(spark):
    rows = [(0, 1, [1.0, 2.0]), (1, 2, [-1.0, 0.5]), (2, None, [1.0, 1.0]), (3, 1, None), (4, 1, [1.0, None]), (5, 2, [float("nan"), 1.0]), (6, 1, []), (7, 2, [3.0]), (8, 1, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "id int, label int, embedding array<double>").selectExpr("*", "'clash' AS x", "1 AS y", "2 AS strength_")
    models = regressions.fitted(df, (1.0, 10.0))
    assert models.classes == [1, 2] and models.weights.shape == (2, 2, 3)
    told = regressions.predicted(models, df).collect()
    assert {r.prediction for r in told if r.id in (3, 4, 5, 6, 7)} == {None} and {r.prediction for r in told if r.id in (0, 8)} == {1} and len(told) == 18
    none = regressions.fitted(df.where("false"), (1.0,))
    assert none.classes == [] and [r.prediction for r in regressions.predicted(none, df.where("id = 0")).collect()] == [None]
    one = regressions.fitted(df.where("label = 1"), (1.0,))
    assert {r.prediction for r in regressions.predicted(one, df.where("id < 2")).collect()} == {1}


def test_sweep_over_strengths(spark):
    df = made(spark)
    got = {r.strength: r.accuracy for r in catalogs.swept(df.where("id < 400"), df.where("id >= 400"), STRENGTHS).collect()}
    assert set(got) == set(STRENGTHS) and got[1.0] > 0.6 and got[1.0] >= got[1e-4] - 0.02
