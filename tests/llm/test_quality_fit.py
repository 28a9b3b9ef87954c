"""The fit of op8 over tables: all labelled rows, all preference pairs, exact quantiles."""

import numpy as np
from pyspark.sql import functions as F

from textloom.llm import features, quality


def test_every_labelled_row_is_learned_from(spark):
    known = spark.range(30_000).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("quality"))
    assert quality.chosen(known, "doc_id", "quality", quality.LABELLED).count() == known.where(~quality.held_out(F.col("doc_id"))).count() > 20_000


def test_weights_are_those_of_all_pairs(spark):
    rng = np.random.default_rng(3)
    x = np.abs(rng.standard_normal((400, 3))).astype(np.float32)
    y = (x[:, 0] - x[:, 1] + rng.logistic(size=400) > 0).astype(int)
    table = spark.createDataFrame([(int(k), r.tolist()) for k, r in zip(y, x)], "label int, x array<float>").repartition(3)
    z = features.expand(x.astype(np.float64))
    mean, scale = z.mean(axis=0), z.std(axis=0)
    z = (z - mean) / scale
    d = (z[y == 1][:, None] - z[y == 0][None]).reshape(-1, z.shape[1])
    w = np.zeros(z.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(d @ w))
        w += np.linalg.solve((d * (p * (1 - p))[:, None]).T @ d / len(d) + 1e-3 * np.eye(len(w)), d.T @ p / len(d) - 1e-3 * w)
    assert np.allclose(quality.fit_all(table, mean, scale, np.bincount(y)), w, atol=2e-3)


def test_quantiles_are_exact(spark):
    s = np.concatenate([np.random.default_rng(2).standard_normal(999) ** 5, np.zeros(300), [1e12]])
    table = spark.createDataFrame([(float(v),) for v in s], "s double").repartition(4)
    for share in (0.0, 0.13, 0.5, 0.77, 1.0):
        assert np.isclose(quality.quantile(table, len(s), share), np.quantile(s, share), rtol=1e-12)
