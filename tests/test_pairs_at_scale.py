"""Blocked pair measures against cell-by-cell ones, and how often a row is copied."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.operators import scores as sc
from tessella.operators import tiles

METHODS = ("cor", "cor2", "abscor", "dist", "dist.manhattan", "dist.maximum", "mi", "mi.empirical")


@pytest.mark.parametrize("method", METHODS)
def test_prepared_sides_measure_as_the_plain_form(method):
    rng = np.random.default_rng(3)
    x, y = rng.normal(size=(40, 16)), rng.normal(size=(30, 16))
    x[0] = 2.0  # does not vary
    y[1] = x[1] + 1e-3 * rng.normal(size=16)
    got = tiles._between(tiles._prepare(x, method), tiles._prepare(y, method), method)
    np.testing.assert_allclose(got, tiles._measure(x, y, method), rtol=1e-7, atol=1e-9)


def test_copies_correlate_fully():
    x = np.random.default_rng(4).normal(size=(50, 64))
    assert (tiles._between(tiles._prepare(x, "cor"), tiles._prepare(x.copy(), "cor"), "cor").diagonal() < -200).all()


def test_large_sides_have_few_tiles():
    assert tiles._tile_count(600_000, 64, blocked=True) <= 40 and tiles._tile_count(5_000, 64, blocked=True) == 5


def test_vectors_are_packed_once(spark):
    m = spark.range(30).select(F.col("id").alias("row_id"), F.explode(F.sequence(F.lit(0), F.lit(5))).alias("col_id")).withColumn("value", F.sin(F.col("row_id") * 7 + F.col("col_id") * F.col("col_id")))
    rows = spark.range(30).select((F.col("id") % 3).cast("int").alias("k"), F.col("id").alias("row_id"))
    out = sc.row_scores_to_members(m, rows, "dist")
    assert "map_from_entries" not in out._jdf.queryExecution().executedPlan().toString()
    x = {r["row_id"]: r["vec"] for r in tiles.pack_rows(m, tiles.column_axis(m)).collect()}
    for r in out.collect():
        others = [i for i in range(30) if i % 3 == r["k"] and i != r["row_id"]]
        want = np.log(np.mean([np.linalg.norm(np.array(x[r["row_id"]]) - np.array(x[i])) for i in others]) + 1e-99)
        assert abs(r["score"] - want) < 1e-9
