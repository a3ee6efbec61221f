"""Elastic-net paths of many weighted fits over one design, from second moments alone.

A bootstrap or a fold is a weight vector over the rows of the design. Its moments come from one matrix product
(a fold's training moments are the whole fit's minus the held rows'), and all fits go down their paths together.
"""

from __future__ import annotations

import numpy as np

#: Numbers of all moment matrices that are held at once.
HELD = 1 << 23


def moments(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(A'WA, A'Wy) of every fit, A being ``x`` (n, p) with a leading one; ``y`` and ``w`` are (fits, n)."""
    a = np.column_stack([np.ones(len(x)), x])
    return (w[:, None, :] * a.T) @ a, (w * y) @ a


def standardize(m: np.ndarray, v: np.ndarray, live: np.ndarray):
    """Covariance terms of standardised columns: (gram, xy, sd, mean x, mean y).

    Columns outside ``live`` (fits, p) and columns without spread get zero rows, so their coefficients stay 0.
    """
    total = m[:, 0, 0]
    mx, my = m[:, 0, 1:] / total[:, None], v[:, 0] / total
    cov = m[:, 1:, 1:] / total[:, None, None] - mx[:, :, None] * mx[:, None, :]
    var = np.einsum("fjj->fj", cov)
    live = live & (var > 1e-12 * np.maximum(np.einsum("fjj->fj", m)[:, 1:] / total[:, None], 1e-12))
    sd = np.sqrt(np.where(live, var, 1.0))
    on = live / sd
    gram = cov * on[:, :, None] * on[:, None, :]
    xy = (v[:, 1:] / total[:, None] - mx * my[:, None]) * on
    return gram, xy, sd, mx, my


def descend(gram: np.ndarray, xy: np.ndarray, lambdas: np.ndarray, alpha: float, factor: np.ndarray, tol: float = 3e-4, rounds: int = 100_000) -> np.ndarray:
    """Coefficients (fits, lambdas, p) along falling ``lambdas`` (fits, lambdas); ``factor`` (fits, p) scales penalties.

    Each point starts from the one before. The strong rule names the columns that may enter, only those are visited,
    and a check of the others' optimality brings back any that it left out. A round is a coordinate pass, which moves
    columns in and out, and a solve for the columns in use, cut at the first sign change. A fit rests once no optimality
    condition is off by ``tol`` of its largest covariance; raises if ``rounds`` don't bring that.
    """
    n_fit, p = xy.shape
    diag = np.einsum("fjj->fj", gram).copy()
    settle = (tol * np.maximum(np.abs(xy).max(axis=1, initial=0.0), 1e-12))[:, None]
    b, g = np.zeros((n_fit, p)), xy.copy()
    out = np.empty((n_fit, lambdas.shape[1], p))
    before = lambdas[:, 0]
    for at in range(lambdas.shape[1]):
        lam = lambdas[:, at]
        bar, ridge = alpha * lam[:, None] * factor, (1 - alpha) * lam[:, None] * factor
        visit = ((b != 0) | ((diag > 0) & (np.abs(g) >= alpha * (2 * lam - before)[:, None] * factor))).any(axis=0)
        on = np.arange(n_fit)
        for _ in range(rounds):
            if len(on) == n_fit:
                part = (gram, diag, xy, bar, ridge)
            else:
                part = (gram[on], diag[on], xy[on], bar[on], ridge[on])
            bo, go = b[on], g[on]
            _pass(*part, bo, go, np.flatnonzero(visit))
            go = _solve_active(*part, bo)
            b[on], g[on] = bo, go
            used, near = bo != 0, settle[on]
            off = np.where(used, np.abs(go - part[3] * np.sign(bo) - part[4] * bo), np.abs(go) - part[3]) * (part[1] > 0)
            missed = off > near
            visit |= (missed & ~used).any(axis=0)
            on = on[missed.any(axis=1)]
            if not len(on):
                break
        else:
            raise ArithmeticError("elastic net did not settle")
        out[:, at], before = b, lam
    return out


def _pass(gram, diag, xy, bar, ridge, b, g, visit) -> None:
    """One coordinate pass over the columns ``visit``; ``b`` and ``g`` change in place."""
    down = diag + ridge
    down[down <= 0] = 1.0
    for j in visit:
        z = g[:, j] + diag[:, j] * b[:, j]
        step = np.sign(z) * np.maximum(np.abs(z) - bar[:, j], 0.0) / down[:, j] - b[:, j]
        if step.any():
            g -= step[:, None] * gram[:, j]
            b[:, j] += step


def _solve_active(gram, diag, xy, bar, ridge, b) -> np.ndarray:
    """Moves ``b`` in place to the optimum of its nonzero columns with their signs, or to the first sign change on the way.

    Returns the new covariances with the residual. Columns in use that depend on each other share a least ridge.
    """
    used = b != 0
    cols = np.flatnonzero(used.any(axis=0))
    if len(cols):
        u, bu = used[:, cols], b[:, cols]
        h = gram[:, cols[:, None], cols] * (u[:, :, None] & u[:, None, :])
        i = np.arange(len(cols))
        h[:, i, i] += np.where(u, ridge[:, cols] + 1e-10 * diag[:, cols], 1.0)
        to = np.linalg.solve(h, np.where(u, xy[:, cols] - bar[:, cols] * np.sign(bu), 0.0)[:, :, None])[:, :, 0]
        turn = u & (to * bu <= 0)
        share = np.where(turn, bu / np.where(turn, bu - to, 1.0), 1.0)
        first = share.min(axis=1, keepdims=True)
        bu = bu + first * (to - bu)
        bu[turn & (share <= first)] = 0.0
        b[:, cols] = np.where(u, bu, 0.0)
    return xy - np.einsum("fjp,fj->fp", gram[:, cols], b[:, cols]) if len(cols) else xy.copy()


def scaled_factor(factor: np.ndarray, live: np.ndarray) -> np.ndarray:
    """Penalty factors with mean 1 over each fit's live columns (all zero stays zero)."""
    f = np.where(live, factor, 0.0)
    total = f.sum(axis=1, keepdims=True)
    return f * live.sum(axis=1, keepdims=True) / np.where(total > 0, total, 1.0)


def path_grid(xy: np.ndarray, factor: np.ndarray, alpha: float, n_lambda: int = 100, ratio: float = 1e-6) -> np.ndarray:
    """(fits, lambdas) from the smallest penalty that leaves nothing in, down to ``ratio`` of it."""
    top = np.max(np.abs(xy) / np.maximum(factor, 1e-3), axis=1, initial=0.0) / max(alpha, 1e-3)
    return np.maximum(top, 1e-12)[:, None] * np.geomspace(1.0, ratio, n_lambda)[None, :]


def choose_lambda(cv: np.ndarray, err: np.ndarray, rule: str) -> int:
    """Index of the first path point within ``min+Nse`` of the smallest CV error."""
    best = int(np.argmin(cv))
    se = 0.0 if rule == "min" else float(rule.replace("min+", "").replace("se", ""))
    return int(np.nonzero(cv <= cv.min() + se * err[best])[0][0])


def pick(b: np.ndarray, cutoff: float, min_coef: int | None, max_coef: int | None) -> list[int]:
    """Columns kept of one fit, largest coefficient first: those over the cutoff, within the asked counts."""
    order = np.argsort(-np.abs(b), kind="stable")
    order = order[np.abs(b[order]) > 0]
    keep = [int(j) for j in order if abs(b[j]) >= cutoff]
    if min_coef and len(keep) < min_coef <= len(order):
        keep = [int(j) for j in order[:min_coef]]
    return keep[:max_coef] if max_coef else keep


def fit_boots(
    x: np.ndarray, y: np.ndarray, w: np.ndarray, count: np.ndarray, penalty: np.ndarray, seeds: list[int], alpha: float = 0.9, folds: int = 10,
    reps: int = 10, rule: str = "min+2se", cutoff: float = 0.02, min_coef: int | None = None, max_coef: int | None = None, refit: str = "path",
    tol: float = 3e-4,
) -> list[dict[int, float]]:
    """Selected coefficients of each bootstrap: path, repeated CV, cutoff, refit.

    ``x`` is (n, p) and shared; ``y``, ``w``, ``count`` are (boots, n), ``penalty`` is (boots, p) with NaN where a column
    is no candidate. A row with count 0, or without y or weight, takes no part in that bootstrap. Columns with a
    variance of at most 0.01 are left out. Fewer than two rows, or no column left, give no coefficients.
    """
    if folds < 2 or reps < 1:
        raise ValueError("cross validation needs two folds and one repeat")
    width = (1 + folds * reps) * (x.shape[1] + 1) ** 2
    size = max(1, HELD // width)
    out: list[dict[int, float]] = []
    for s in range(0, len(y), size):
        part = slice(s, s + size)
        out += _fit_block(x, y[part], w[part], count[part], penalty[part], seeds[part], alpha, folds, reps, rule, cutoff, min_coef, max_coef, refit, tol)
    return out


def _fit_block(x, y, w, count, penalty, seeds, alpha, folds, reps, rule, cutoff, min_coef, max_coef, refit, tol) -> list[dict[int, float]]:
    ok = (count > 0) & np.isfinite(y) & np.isfinite(w)
    c = np.where(ok, count, 0.0)
    y, w = np.where(ok, y, 0.0), np.where(ok, w, 0.0) * c
    x = x - x.mean(axis=0)
    n = c.sum(axis=1)
    with np.errstate(divide="ignore", invalid="ignore"):
        mean = c @ x / n[:, None]
        var = (c @ (x * x) - n[:, None] * mean * mean) / (n[:, None] - 1)
    live = np.isfinite(penalty) & (n[:, None] >= 2) & (var > 0.01)
    use = np.flatnonzero((ok.sum(axis=1) >= 2) & live.any(axis=1) & (w.sum(axis=1) > 0))
    out: list[dict[int, float]] = [{} for _ in y]
    if not len(use):
        return out
    y, w, c, ok, live = y[use], w[use], c[use], ok[use], live[use]
    factor = scaled_factor(np.nan_to_num(penalty[use]), live)
    m, v = moments(x, y, w)
    gram, xy, sd, mx, my = standardize(m, v, live)
    lambdas = path_grid(xy, factor, alpha)
    held: list[tuple[int, np.ndarray]] = []
    for i, b in enumerate(use):
        rng, rows = np.random.default_rng(seeds[b]), np.flatnonzero(ok[i])
        for _ in range(reps):
            fold = rng.permutation(len(rows)) % min(folds, len(rows))
            held += [(i, rows[fold == f]) for f in range(min(folds, len(rows)))]
    of = np.array([i for i, _ in held])
    out_m, out_v = np.empty((len(held), *m.shape[1:])), np.empty((len(held), v.shape[1]))
    for at, (i, rows) in enumerate(held):
        got = moments(x[rows], y[i:i + 1, rows], w[i:i + 1, rows])
        out_m[at], out_v[at] = got[0][0], got[1][0]
    rest_m = m[of] - out_m
    good = rest_m[:, 0, 0] > 1e-12 * m[of, 0, 0]
    of, rest_m, rest_v = of[good], rest_m[good], (v[of] - out_v)[good]
    held = [h for h, g in zip(held, good) if g]
    folded = standardize(rest_m, rest_v, live[of])
    coefs = descend(np.concatenate([gram, folded[0]]), np.concatenate([xy, folded[1]]), np.concatenate([lambdas, lambdas[of]]), alpha, np.concatenate([factor, factor[of]]), tol)
    whole, parts = coefs[: len(use)] / sd[:, None, :], coefs[len(use):] / folded[2][:, None, :]
    errors: list[list[np.ndarray]] = [[] for _ in use]
    for b, fx, fy, (i, rows) in zip(parts, folded[3], folded[4], held):
        off = y[i, rows][None, :] - (b @ (x[rows] - fx).T + fy)
        errors[i].append((off * off) @ c[i, rows] / c[i, rows].sum())
    kept: list[list[int]] = []
    for i in range(len(use)):
        e = np.stack(errors[i], axis=1) if errors[i] else np.zeros((lambdas.shape[1], 2))
        spread = e.var(axis=1, ddof=1) if e.shape[1] > 1 else np.zeros(len(e))
        chosen = whole[i, choose_lambda(e.mean(axis=1), np.sqrt(spread / folds), rule)]
        kept.append(pick(chosen, cutoff, min_coef, max_coef))
        out[use[i]] = dict(zip(kept[i], chosen[kept[i]]))
    if refit == "path":
        among = np.zeros_like(live)
        for i, keep in enumerate(kept):
            among[i, keep] = True
        some = np.flatnonzero(among.any(axis=1))
        if len(some):
            g2, xy2, sd2, _, _ = standardize(m[some], v[some], among[some])
            f2 = scaled_factor(np.nan_to_num(penalty[use][some]), among[some])
            last = descend(g2, xy2, path_grid(xy2, f2, alpha), alpha, f2, tol)[:, -1] / sd2
            for row, i in zip(last, some):
                out[use[i]] = {j: row[j] for j in kept[i]}
    elif refit == "ols":
        for i, keep in enumerate(kept):
            if keep:
                cov = m[i, 1:, 1:] / m[i, 0, 0] - np.outer(mx[i], mx[i])
                to_y = v[i, 1:] / m[i, 0, 0] - mx[i] * my[i]
                out[use[i]] = dict(zip(keep, np.linalg.lstsq(cov[np.ix_(keep, keep)], to_y[keep], rcond=None)[0]))
    return [{j: float(b) for j, b in fit.items() if abs(b) >= cutoff} for fit in out]
