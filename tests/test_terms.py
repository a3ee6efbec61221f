import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tessella.operators import enrich as en


def slow(scores: pd.DataFrame, term: pd.DataFrame):
    """Every term against the rest by plain distribution functions and variances."""
    for k, s in scores.dropna().groupby("k"):
        for name, rows in term.drop_duplicates().groupby("term")["row_id"]:
            flag = s["row_id"].isin(rows).to_numpy()
            a, b = s["score"].to_numpy()[flag], s["score"].to_numpy()[~flag]
            if len(a) and len(b):
                ks = max(abs((a <= v).mean() - (b <= v).mean()) for v in s["score"])
                t = df = None
                if len(a) > 1 and len(b) > 1 and a.var() + b.var() > 1e-12:
                    u, v = a.var(ddof=1) / len(a), b.var(ddof=1) / len(b)
                    t, df = (b.mean() - a.mean()) / math.sqrt(u + v), (u + v) ** 2 / (u * u / (len(a) - 1) + v * v / (len(b) - 1))
                yield (k, name), (len(a), len(b), ks, t, df)


def test_term_tests_equal_the_slow_version(spark):
    rng = np.random.default_rng(4)
    # ties, a missing score, a cluster of equal scores, a hot term, repeated rows, a term of one row and one of all
    cells = [(1, r, float(rng.integers(0, 9))) for r in range(60)] + [(2, r, float(rng.normal())) for r in range(40)] + [(3, r, 1.5) for r in range(6)] + [(1, 99, None), (2, 98, float("nan"))]
    listed = [("hot", r) for r in range(0, 60, 2)] * 2 + [("one", 5), ("all", 99)] + [("all", r) for r in range(60)] + [("few", r) for r in (1, 2, 3, 30)] + [("none", 1000)]
    s = spark.createDataFrame(cells, "k int, row_id int, score double")
    a = spark.createDataFrame(listed, "term string, row_id int").withColumn("score", F.lit("other"))
    got = {(r.k, r.term): r for r in en.term_tests(s, a).collect()}
    want = dict(slow(pd.DataFrame(cells, columns=["k", "row_id", "score"]), pd.DataFrame(listed, columns=["term", "row_id"])))
    assert set(got) == set(want) and (1, "hot") in got and (1, "all") not in got
    for key, (n_in, n_out, ks, t, df) in want.items():
        r = got[key]
        assert (r.n_in, r.n_out) == (n_in, n_out) and abs(r.ks - ks) < 1e-12 and 0 <= r.p_ks <= 1
        assert (r.t is None) == (t is None) and (r.p_t is None) == (t is None), key
        if t is not None:
            assert abs(r.t - t) < 1e-8 * max(1, abs(t)) and abs(r.df - df) < 1e-6 * df and 0 <= r.p_t <= 1
    assert en.term_tests(s.limit(0), a).count() == 0


def test_ks_tail_joins_its_two_series(spark):
    x = spark.createDataFrame([(0.0,), (0.3,), (0.999999,), (1.0,), (1.36,), (3.0,)], "x double")
    p = [r[0] for r in x.select(en.ks_tail(F.col("x"))).collect()]
    assert p[0] == 1.0 and p == sorted(p, reverse=True) and abs(p[2] - p[3]) < 1e-5 and abs(p[4] - 0.0495) < 5e-4
