import math

import numpy as np
import pandas as pd
import pytest

from tessella.operators import netfit
from tessella.operators import regulators as rg

# --- slow serial version: each fit from its own copy of the rows, every penalty from zero


def _standardize(x: np.ndarray, y: np.ndarray, w: np.ndarray):
    """Weighted Gram terms of standardised columns: (gram, xy, sd, mean x, mean y)."""
    w = w / w.sum()
    mx, my = w @ x, w @ y
    xc = x - mx
    sd = np.sqrt(w @ (xc * xc))
    sd[sd == 0] = 1.0
    xs = xc / sd
    return xs.T @ (w[:, None] * xs), xs.T @ (w * (y - my)), sd, mx, my


def _descend(gram: np.ndarray, xy: np.ndarray, lambdas: np.ndarray, alpha: float, factor: np.ndarray, tol: float = 1e-8, sweeps: int = 100_000) -> np.ndarray:
    """Elastic-net coefficients (fits, lambdas, p); coordinate descent on all fits and lambdas at once.

    Settled when no coefficient moves by ``tol`` of the largest covariance (a squared change of 1e-7, the usual bound of
    path solvers). Raises if ``sweeps`` passes don't settle it.
    """
    n_fit, p = xy.shape
    b = np.zeros((n_fit, len(lambdas), p))
    diag = np.einsum("fjj->fj", gram)
    scale = max(float(np.abs(xy).max()), 1e-12)
    for _ in range(sweeps):
        change = 0.0
        for j in range(p):
            z = xy[:, j, None] - np.einsum("flp,fp->fl", b, gram[:, j]) + diag[:, j, None] * b[:, :, j]
            t = lambdas[None, :] * factor[j]
            down = diag[:, j, None] + t * (1 - alpha)
            new = np.where(diag[:, j, None] > 0, np.sign(z) * np.maximum(np.abs(z) - t * alpha, 0.0) / np.maximum(down, 1e-12), 0.0)
            change = max(change, float(np.abs(new - b[:, :, j]).max()))
            b[:, :, j] = new
        if change < tol * scale:
            return b
    raise ArithmeticError("elastic net did not settle")


def _path(x: np.ndarray, y: np.ndarray, w: np.ndarray, alpha: float, factor: np.ndarray, n_lambda: int = 100, ratio: float = 1e-6):
    """Regularisation path of one fit: (lambdas, coefs, intercepts)."""
    factor = factor * len(factor) / factor.sum()
    gram, xy, sd, mx, my = _standardize(x, y, w)
    top = max(float(np.max(np.abs(xy) / np.maximum(factor, 1e-3))) / max(alpha, 1e-3), 1e-12)
    lambdas = np.geomspace(top, top * ratio, n_lambda)
    coefs = _descend(gram[None], xy[None], lambdas, alpha, factor)[0] / sd
    return lambdas, coefs, my - coefs @ mx


def fit_path(x, y, w, factor, alpha: float, folds: int, reps: int, rule: str, cutoff: float, min_coef: int | None, max_coef: int | None, refit: str, seed: int) -> dict[int, float]:
    """Selected coefficients of one cluster: path, repeated CV, cutoff, refit."""
    rng = np.random.default_rng(seed)
    lambdas, coefs, _ = _path(x, y, w, alpha, factor)
    scaled = factor * len(factor) / factor.sum()
    errors = []
    for _ in range(reps):
        fold = rng.permutation(len(y)) % min(folds, len(y))
        outs = [fold == f for f in range(min(folds, len(y)))]
        parts = [_standardize(x[~o], y[~o], w[~o]) for o in outs]
        b = _descend(np.stack([t[0] for t in parts]), np.stack([t[1] for t in parts]), lambdas, alpha, scaled)
        for o, c, (_, _, sd, mx, my) in zip(outs, b, parts):
            c = c / sd
            errors.append(((y[o][None, :] - (c @ x[o].T + (my - c @ mx)[:, None])) ** 2).mean(axis=1))
    if not errors:
        return {}
    e = np.stack(errors, axis=1)
    at = netfit.choose_lambda(e.mean(axis=1), np.sqrt(e.var(axis=1, ddof=1) / folds), rule)
    b = coefs[at]
    order = np.argsort(-np.abs(b), kind="stable")
    order = order[np.abs(b[order]) > 0]
    keep = [j for j in order if abs(b[j]) >= cutoff]
    if min_coef and len(keep) < min_coef <= len(order):
        keep = list(order[:min_coef])
    if max_coef and len(keep) > max_coef:
        keep = list(order[:max_coef])
    if not keep:
        return {}
    if refit == "ols":
        a = np.column_stack([np.ones(len(y)), x[:, keep]]) * np.sqrt(w)[:, None]
        b2 = np.linalg.lstsq(a, y * np.sqrt(w), rcond=None)[0][1:]
    elif refit == "path":
        b2 = _path(x[:, keep], y, w, alpha, factor[keep])[1][-1]
    else:
        b2 = b[keep]
    return {int(j): float(v) for j, v in zip(keep, b2) if abs(v) >= cutoff}


# --- tests


def test_elastic_net_finds_the_true_predictors(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(60, 8))
    y = 1.5 * x[:, 2] - 0.8 * x[:, 5] + rng.normal(size=60) * 0.1
    rows = [(1, i, float(y[i]), 1.0, f"p{j}", float(x[i, j]), 1.0) for i in range(60) for j in range(8)]
    d = spark.createDataFrame(rows, "k int, col_id int, y double, weight double, predictor string, value double, penalty double")
    got = {r["predictor"]: r["coef"] for r in rg.fit_elastic_net(d, folds=5, reps=2).collect()}
    assert {"p2", "p5"} <= set(got) and abs(got["p2"] - 1.5) < 0.1 and abs(got["p5"] + 0.8) < 0.1
    ols = {r["predictor"]: r["coef"] for r in rg.fit_lasso(d, folds=5, reps=2).collect()}
    assert abs(ols["p2"] - 1.5) < 0.1 and set(ols) <= set(got) | {"p2", "p5"}


def test_lasso_path_solves_the_normal_equations():
    rng = np.random.default_rng(0)
    x, w = rng.normal(size=(50, 4)), np.ones((1, 50))
    y = x @ np.array([1.0, 0.0, -2.0, 0.5]) + 0.3
    gram, xy, sd, mx, my = netfit.standardize(*netfit.moments(x, y[None], w), np.ones((1, 4), bool))
    b = netfit.descend(gram, xy, netfit.path_grid(xy, np.ones((1, 4)), 1.0), 1.0, np.ones((1, 4)))[0] / sd
    assert np.allclose(b[0], 0, atol=1e-8)
    assert np.allclose(b[-1], [1, 0, -2, 0.5], atol=1e-3) and abs((my - b[-1] @ mx[0])[0] - 0.3) < 1e-3


def problem(seed, n=45, p=9):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, p))
    x[:, 3] = 0.8 * x[:, 2] + 0.3 * x[:, 3]  # close to another
    x[:, 4] = 0.01 * x[:, 4]  # no spread to speak of
    y = 1.2 * x[:, 2] - 0.7 * x[:, 5] + 0.3 * rng.normal(size=n)
    return x, y, rng.uniform(0.3, 3.0, n), np.where(np.arange(p) == 6, 0.2, 1.0)


@pytest.mark.parametrize("alpha, refit, rule", [(0.9, "path", "min+2se"), (0.9, "none", "min"), (1.0, "ols", "min+1se"), (0.5, "path", "min")])
def test_moment_fits_equal_the_slow_version_on_the_same_folds(alpha, refit, rule):
    for seed in (0, 1):
        x, y, w, pen = problem(seed, p=7)
        live = x.var(axis=0, ddof=1) > 0.01
        want = fit_path(x[:, live], y, w, pen[live], alpha, 4, 1, rule, 0.02, None, None, refit, seed)
        want = {int(np.flatnonzero(live)[j]): b for j, b in want.items()}
        got = netfit.fit_boots(x, y[None], w[None], np.ones((1, len(y))), pen[None], [seed], alpha, 4, 1, rule, 0.02, refit=refit, tol=1e-8)[0]
        assert want and set(got) == set(want)
        assert np.allclose([got[j] for j in want], list(want.values()), atol=1e-5)


def test_counts_are_repeated_rows_and_candidates_differ_by_boot():
    """A count of c weighs as c copies do; boots of one call don't touch each other."""
    x, y, w, pen = problem(7)
    count = np.vstack([np.ones(len(y)), np.random.default_rng(1).poisson(1.0, len(y)), np.arange(len(y)) % 2])
    pens = np.vstack([pen, pen, np.where(np.arange(len(pen)) < 5, pen, np.nan)])
    ys, ws = np.tile(y, (3, 1)), np.tile(w, (3, 1))
    ys[0, 4] = np.nan
    all_at_once = netfit.fit_boots(x, ys, ws, count, pens, [1, 2, 3], folds=5, reps=2, tol=1e-8)
    for i in range(3):
        alone = netfit.fit_boots(x, ys[i:i + 1], ws[i:i + 1], count[i:i + 1], pens[i:i + 1], [i + 1], folds=5, reps=2, tol=1e-8)[0]
        assert set(alone) == set(all_at_once[i]) and np.allclose(list(alone.values()), [all_at_once[i][j] for j in alone], atol=1e-6)
    assert max(all_at_once[2]) < 5
    at = np.repeat(np.arange(len(y)), count[1].astype(int))
    many, few = netfit.moments(x[at], y[None, at], w[None, at]), netfit.moments(x, y[None], w[None] * count[1])
    assert np.allclose(many[0], few[0]) and np.allclose(many[1], few[1])


def test_wide_and_collinear_designs_settle_and_meet_the_conditions():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(20, 40))
    x = np.column_stack([x, x[:, :5], np.zeros(20)])
    y = x[:, 0] - x[:, 7] + 0.1 * rng.normal(size=20)
    alpha, factor = 0.9, np.ones((1, 46))
    gram, xy, *_ = netfit.standardize(*netfit.moments(x, y[None], np.ones((1, 20))), np.ones((1, 46), bool))
    lambdas = netfit.path_grid(xy, factor, alpha)
    b = netfit.descend(gram, xy, lambdas, alpha, factor, tol=1e-8)[0]
    for lam, row in zip(lambdas[0], b):
        g = xy[0] - gram[0] @ row
        on = row != 0
        assert np.allclose(g[on], np.sign(row[on]) * lam * alpha + lam * (1 - alpha) * row[on], atol=1e-6)
        assert (np.abs(g[~on]) <= lam * alpha + 1e-6).all()


def test_too_little_to_fit():
    x, y, w, pen = problem(1)
    none = np.zeros((1, len(y)))
    assert netfit.fit_boots(x, y[None], w[None], none, pen[None], [1]) == [{}]
    assert netfit.fit_boots(x, y[None], w[None], none + 1, pen[None] * np.nan, [1]) == [{}]
    assert netfit.fit_boots(x[:1], y[None, :1], w[None, :1], none[:, :1] + 1, pen[None], [1]) == [{}]
    assert netfit.fit_boots(x * 0 + 2.0, y[None], w[None], none + 1, pen[None], [1]) == [{}]
    with pytest.raises(ValueError):
        netfit.fit_boots(x, y[None], w[None], none + 1, pen[None], [1], folds=1)


def test_bootstraps_of_columns_and_of_folds(spark):
    x, y, w, pen = problem(5, n=40)
    rows = [(1, i, float(y[i]), float(w[i]), f"p{j}", float(x[i, j]), float(pen[j])) for i in range(40) for j in range(9)]
    d = spark.createDataFrame(rows, "k int, col_id int, y double, weight double, predictor string, value double, penalty double")
    for mode in ("columns", "cv"):
        got = rg.fit_elastic_net(d, n_boot=4, folds=5, reps=1, boots=mode).collect()
        by = {b: {r["predictor"]: r["coef"] for r in got if r["boot"] == b} for b in range(1, 5)}
        assert all({"p2", "p5"} <= set(v) | {"p3"} for v in by.values())
        first = netfit.fit_boots(x, y[None], w[None], np.ones((1, 40)), pen[None], [2], folds=5, reps=1)[0]
        assert {f"p{j}" for j in first} == set(by[1]) and all(abs(by[1][f"p{j}"] - b) < 1e-2 for j, b in first.items())
        assert len({round(v["p5"], 9) for v in by.values()}) > 1 or mode == "cv"
    counts = rg.boot_targets(d.select("k", "col_id", "y", "weight").distinct(), 50).groupBy("boot").agg({"count": "sum"}).collect()
    assert next(r[1] for r in counts if r["boot"] == 1) == 40 and abs(np.mean([r[1] for r in counts]) - 40) < 4


def test_drawn_members_give_their_profile(spark):
    rng = np.random.default_rng(2)
    cells = [(f"r{r}", c, float(rng.normal())) for r in range(12) for c in range(5) if (r, c) != (3, 2)] + [("r3", 2, None)]
    m = spark.createDataFrame(cells, "row_id string, col_id int, value double")
    member = spark.createDataFrame([(k, f"r{r}") for k in (1, 2) for r in range(6 * (k - 1), 6 * k)] + [(3, "r0")], "k int, row_id string")
    draws = rg.boot_members(member, 6, 3)
    d, p = draws.toPandas(), rg.boot_profile(m, draws).toPandas().set_index(["k", "boot", "col_id"])
    assert (d[d.boot == 1]["count"] == 1).all() and len(d[d.boot == 1]) == 13 and d["count"].max() > 1
    table = pd.DataFrame(cells, columns=["row_id", "col_id", "value"]).dropna()
    seen = 0
    for (k, boot), group in d.groupby(["k", "boot"]):
        many = group.loc[group.index.repeat(group["count"])].merge(table, on="row_id")
        for col, v in many.groupby("col_id")["value"]:
            mean, var = v.mean(), v.var(ddof=1) if v.nunique() > 1 else math.nan
            disp = var / (abs(mean) + 0.05)
            got = p.loc[(k, boot, col)]
            assert abs(got["y"] - mean) < 1e-9 and abs(got["weight"] - (1 / disp if disp > 0 else 1.0)) < 1e-6 * max(1, got["weight"])
            seen += 1
    assert seen == len(p)
    cols = spark.createDataFrame([(1, 0), (1, 1), (2, 4)], "k int, col_id int")
    drawn = rg.boot_columns(cols, m, 4).toPandas()
    assert (drawn.groupby(["k", "boot"]).size().unstack().to_numpy() == [[2] * 4, [1] * 4]).all() and not drawn.duplicated().any()
    assert set(rg.boot_columns(cols, m, 1).toPandas()["boot"]) == {1}


def test_choose_lambda_rule():
    cv, err = np.array([9.0, 5.0, 4.2, 4.0, 4.1]), np.array([1, 0.5, 0.2, 0.2, 0.2])
    assert netfit.choose_lambda(cv, err, "min") == 3
    assert netfit.choose_lambda(cv, err, "min+2se") == 2


def test_gap_fill(spark):
    meta = spark.createDataFrame([(i, 1 if i < 8 else 2, i % 8) for i in range(16)] + [(99, None, None)], "col_id int, series int, ord int")
    cols = spark.createDataFrame([(1, c) for c in (0, 1, 2, 3, 4, 5, 6)] + [(1, 10)] + [(1, 99)], "k int, col_id int")
    got = {r["col_id"] for r in rg.fill_time_series(cols, meta).collect()}
    assert got == set(range(8)) | {9, 10, 11, 99}
