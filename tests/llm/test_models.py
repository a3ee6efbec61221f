"""Held-out accuracy of the learned operators, and the trees and the solver on known answers."""

import numpy as np
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.01"


def test_trees_learn_a_rule():
    from tessella.llm.boosting import fit

    x = np.random.default_rng(1).normal(size=(3000, 5))
    y = ((x[:, 0] > 0.3) ^ (x[:, 2] < -0.2)).astype(float)
    trees = fit(x[:2000], y[:2000])
    assert ((trees.score(x[2000:]) > 0.5) == y[2000:]).mean() > 0.95
    walked = []
    for row in x[:50]:
        total = trees.base
        for t in range(len(trees.leaf)):
            node = 0
            while node < trees.feature.shape[1]:
                node = 2 * node + 1 + int(row[trees.feature[t, node]] > trees.cut[t, node])
            total += trees.leaf[t, node - trees.feature.shape[1]]
        walked.append(total)
    assert np.allclose(walked, trees.margin(x[:50]))


def test_weights_count_as_repeated_rows():
    from tessella.llm.boosting import fit

    x = np.random.default_rng(2).integers(0, 4, (200, 3)).astype(float)
    y = (x[:, 0] > 1).astype(float)
    w = np.random.default_rng(3).integers(1, 5, 200)
    a = fit(x, y, w.astype(float), trees=5)
    b = fit(np.repeat(x, w, axis=0), np.repeat(y, w), trees=5)
    assert np.allclose(a.score(x), b.score(x), atol=0.02)


def test_quality_on_held_out(spark):
    from tessella.llm.quality import op1_quality

    got = op1_quality(spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").where("held_out").toPandas()
    assert ((got.predicted == got.quality).mean() > 0.95) and got.score.between(0, 1).all()


def test_language_on_held_out(spark):
    from tessella.llm.langid import op6_language_id

    got = op6_language_id(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out and lang is not null").toPandas()
    assert (got.lang_pred == got.lang).mean() > 0.95 and got.score.between(0, 1).all()


def test_temperature():
    from tessella.llm.langid import temperature_of

    z = np.random.default_rng(4).normal(size=(4000, 3))
    p = np.exp(z) / np.exp(z).sum(axis=1, keepdims=True)
    y = np.array([np.random.default_rng(i).choice(3, p=q) for i, q in enumerate(p)])
    assert abs(temperature_of(3 * z, y) - 3) < 0.3


def test_elastic_net_leaves_useless_features_at_zero():
    from tessella.llm.langid import BUCKETS, ftrl

    rows = [(np.array([10 + i % 2, 100 + i % 7, BUCKETS]), np.array([1.0, 1.0, 1.0]), i % 2) for i in range(400)]
    w, _ = ftrl(rows, 2, 0.5, 1.0, 8.0, 0.1, 2)
    assert np.abs(w[10:12]).min() > 0.1 and not w[100:107].any() and not w[5000:].any()


def test_labels_and_ids_do_not_enter(spark):
    from tessella.llm.langid import identify, fit, learning_rows

    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(300)
    model = fit(learning_rows(docs), per_language=40)
    a = identify(docs, model).select("doc_id", "lang_pred", "score")
    b = identify(docs.withColumn("lang", F.lit("zz")).withColumn("source", F.lit("q")), model).select("doc_id", "lang_pred", "score")
    assert sorted(a.collect()) == sorted(b.collect())
