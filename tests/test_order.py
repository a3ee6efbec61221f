import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessella.functions import order as od


@pytest.fixture(scope="module")
def skewed(spark):
    """One key holds most rows; many tied values."""
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"k": np.where(np.arange(6000) < 4000, 0, rng.integers(1, 9, 6000)), "v": rng.normal(size=6000).round(2), "id": np.arange(6000)})
    return pdf, spark.createDataFrame(pdf).repartition(7)


def test_quantiles_match_numpy(skewed):
    pdf, df = skewed
    got = {r["k"]: r for r in od.quantiles(df, ["k"], "v", {"a": 0.01, "b": 0.5, "c": 0.95}).collect()}
    for k, part in pdf.groupby("k"):
        want = np.quantile(part["v"], [0.01, 0.5, 0.95])
        assert np.allclose([got[k]["a"], got[k]["b"], got[k]["c"]], want)


@pytest.mark.parametrize("listed", [3, 50, 100_000])
def test_scalar_quantiles_narrow_brackets(spark, skewed, listed):
    pdf, df = skewed
    got = od.scalar_quantiles(df, {"q": (F.col("v") * 2, 0.33), "top": (F.col("v"), 1.0), "low": (F.col("v"), 0.0)}, listed, eps=0.05)
    assert np.allclose([got["q"], got["top"], got["low"]], [np.quantile(pdf["v"] * 2, 0.33), pdf["v"].max(), pdf["v"].min()])
    ties = spark.createDataFrame([(float(x),) for x in [5] * 500 + [1, 2, 9]] + [(None,), (float("nan"),)], "v double")
    assert od.scalar_quantiles(ties, {"m": (F.col("v"), 0.5), "e": (F.lit(None).cast("double"), 0.5)}, listed, eps=0.05) == {"m": 5.0, "e": None}


def test_indexed_is_row_number(skewed):
    pdf, df = skewed
    got = od.indexed(df, ["k"], ["v", "id"]).toPandas().set_index("id")["pos"]
    want = pdf.sort_values(["k", "v", "id"]).assign(pos=lambda d: d.groupby("k").cumcount() + 1).set_index("id")["pos"]
    assert (got.sort_index() == want.sort_index()).all()


def test_running_sum_and_carry(skewed):
    pdf, df = skewed
    got = od.running_sum(df, ["k"], ["id"], "v", "s").toPandas().sort_values("id")["s"].to_numpy()
    assert np.allclose(got, pdf.groupby("k")["v"].cumsum().to_numpy())
    val = F.when(F.col("id") % 50 == 0, F.col("id"))
    got = od.carry_forward(df, ["k"], ["id"], val, "c", chunk=64).toPandas().sort_values("id")["c"]
    want = pdf["id"].where(pdf["id"] % 50 == 0).groupby(pdf["k"]).ffill()
    assert np.array_equal(got.fillna(-1).to_numpy(), want.fillna(-1).to_numpy())


def test_trimmed_mean(skewed):
    pdf, df = skewed
    got = {r["k"]: r["m"] for r in od.trimmed_mean(df, ["k"], "v", 0.05, ["id"], "m").collect()}
    for k, part in pdf.groupby("k"):
        v, n = np.sort(part["v"]), int(len(part) * 0.05)
        assert np.isclose(got[k], v[n:len(v) - n].mean())
