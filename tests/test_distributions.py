import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.functions import distributions as ds


def exact_tail(q, m, n, k):
    return sum(math.comb(m, x) * math.comb(n, k - x) for x in range(q + 1, min(m, k) + 1)) / math.comb(m + n, k)


@pytest.mark.parametrize("q,m,n,k", [(2, 5, 15, 6), (0, 3, 7, 4), (9, 50, 400, 60), (5, 5, 15, 6), (1, 200, 10, 150), (40, 300, 700, 100)])
def test_hypergeometric(q, m, n, k):
    assert np.isclose(ds.hypergeom_upper([q], [m], [n], [k])[0], exact_tail(q, m, n, k), rtol=1e-10, atol=1e-14)


def test_hypergeometric_inclusive():
    assert np.isclose(ds.hypergeom_upper([2], [5], [15], [6], True)[0], exact_tail(1, 5, 15, 6))


def test_student_and_normal():
    assert math.isclose(ds.student_upper(2.0, 10), 0.03669402, rel_tol=1e-6)
    assert math.isclose(ds.student_upper(-2.0, 10), 1 - 0.03669402, rel_tol=1e-6)
    assert math.isclose(ds.student_upper(1.0, 1), 0.25, rel_tol=1e-12)
    assert math.isclose(ds.norm_cdf_values(np.array([1.959963985]))[0], 0.975, rel_tol=1e-8)
    assert math.isclose(ds.normal_quantile(0.975), 1.959963985, rel_tol=1e-8)


def test_poisson(spark):
    df = spark.createDataFrame([(i,) for i in range(6)], "n int")
    got = [r[0] for r in df.select(ds.poisson_lower(F.col("n"), 2.0)).collect()]
    want = np.cumsum([math.exp(-2) * 2**i / math.factorial(i) for i in range(6)])
    assert np.allclose(sorted(got), want)
