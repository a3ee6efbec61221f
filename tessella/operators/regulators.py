"""Regression of cluster profiles on candidate regulators."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.functions.chance import poisson_one, uniform
from tessella.operators import netfit, tiles
from tessella.operators.matrix import clip
from tessella.operators.seeding import precluster_regulators
from tessella.session import materialize, spread

SEP = "~~"


def predictor_table(m: DataFrame, predictors: DataFrame, prefix: str, n_groups: int | None = None, starts: int = 5) -> tuple[DataFrame, DataFrame]:
    """(matrix, groups): regulators by name pattern (pre-clustered) and environment factors, distinct rows."""
    known = predictors.select("row_id").distinct().join(m.select("row_id").distinct(), "row_id", "left_semi")
    genetic, env = known.where(F.col("row_id").rlike(f"^{prefix}")), known.where(~F.col("row_id").rlike(f"^{prefix}"))
    if n_groups and n_groups < known.count():
        groups, mat = precluster_regulators(m.join(genetic, "row_id", "left_semi"), n_groups, starts)
        mat = mat.unionByName(m.join(env, "row_id", "left_semi").select("row_id", "col_id", "value"))
    else:
        groups = genetic.select(F.col("row_id").alias("group_id"), "row_id")
        mat = m.join(known, "row_id", "left_semi").select("row_id", "col_id", "value")
    return distinct_profiles(mat), groups


def distinct_profiles(m: DataFrame) -> DataFrame:
    """Keep the first of the rows with identical values in every column."""
    sig = m.groupBy("row_id").agg(F.bit_xor(F.xxhash64("col_id", "value")).alias("_a"), F.bit_xor(F.xxhash64(F.lit(3), "col_id", "value")).alias("_b"), F.count(F.lit(1)).alias("_n"))
    first = sig.groupBy("_a", "_b", "_n").agg(F.min("row_id").alias("row_id")).select("row_id")
    return m.join(first, "row_id", "left_semi")


def combine_predictors(m: DataFrame, r_filter: float = 0.8, func: str = "min") -> DataFrame:
    """(row_id, col_id, value) of pairwise minima named ``a~~b~~min``.

    Pairs correlated with either parent over ``r_filter`` are dropped inside the task that forms them,
    tile by tile, so only kept combinations leave it.
    """
    axis = tiles.column_axis(m)
    n_cols = axis.count()
    vec = materialize(tiles.pack_rows(m.select(F.col("row_id").cast("string").alias("row_id"), "col_id", "value"), axis), "vectors")
    left, right = tiles.tiled(vec.select(F.col("row_id").alias("a"), F.col("vec").alias("x")), vec.select(F.col("row_id").alias("b"), F.col("vec").alias("y")), n_cols, "a", "b")
    pick = np.fmin if func == "min" else np.fmax

    def block(p: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        rows = []
        if not p.empty and not q.empty:
            ys, names = np.stack(q["y"].to_numpy()).astype(float), q["b"].to_numpy()
            for a, x in zip(p["a"], p["x"]):
                x = np.array(x, dtype=float)
                later = names > a
                if not later.any():
                    continue
                y = ys[later]
                z = pick(x[None, :], y)
                to_a = tiles.pairwise_corr(z, x[None, :])[:, 0]
                to_b = np.array([tiles.pairwise_corr(z[i:i + 1], y[i:i + 1])[0, 0] for i in range(len(z))])
                ok = (np.nan_to_num(to_a) <= r_filter) & (np.nan_to_num(to_b) <= r_filter) if r_filter < 1 else np.ones(len(z), bool)
                rows += [(f"{a}{SEP}{b}{SEP}{func}", v.tolist()) for b, v in zip(names[later][ok], z[ok])]
        return pd.DataFrame(rows, columns=["row_id", "vec"])

    kept = left.groupBy("lt", "rt").cogroup(right.groupBy("lt", "rt")).applyInPandas(block, "row_id string, vec array<double>")
    cells = kept.select("row_id", F.posexplode("vec").alias("ci", "value")).where(~F.isnan("value"))
    return cells.join(axis, "ci").select("row_id", "col_id", "value")


def profile_fit(profile: DataFrame, m: DataFrame) -> DataFrame:
    """(k, predictor, n, r, syy): one-variable regression terms of every profile on every predictor."""
    j = profile.select("k", "col_id", "y").join(m.select(F.col("row_id").alias("predictor"), "col_id", "value"), "col_id")
    return j.groupBy("k", "predictor").agg(F.regr_count("y", "value").alias("n"), F.corr("y", "value").alias("r"), F.regr_syy("y", "value").alias("syy"))


def aic(n: Column, r: Column, syy: Column) -> Column:
    """AIC of a one-variable linear model (two coefficients and the variance)."""
    rss = syy * (1 - r * r)
    return n * (math.log(2 * math.pi) + F.log(rss / n) + 1) + 6


def aic_filter(profile: DataFrame, m: DataFrame, top: int, r_min: float = 0.2, signed: float | None = None) -> DataFrame:
    """(k, predictor, r, aic) of the best ``top`` predictors per cluster, or a signed split by correlation."""
    fit = profile_fit(profile, m).where(F.col("r").isNotNull())
    if signed is not None:
        from tessella.operators.matrix import positive_negative_split

        return positive_negative_split(fit, "k", "predictor", "r", top, signed).select("k", "predictor", "r", "side")
    scored = fit.where(F.abs("r") >= r_min).withColumn("aic", aic(F.col("n"), F.col("r"), F.col("syy")))
    w = Window.partitionBy("k").orderBy("aic", "predictor")
    return scored.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= top).select("k", "predictor", "r", "aic")


def possibly_regulates(row_member: DataFrame, groups: DataFrame, profile: DataFrame, m: DataFrame, r_cutoff: float = 1.0) -> DataFrame:
    """(k, group_id, share, r): regulator groups that overlap the cluster or correlate over ``r_cutoff``."""
    size = groups.groupBy("group_id").agg(F.count(F.lit(1)).alias("_n"))
    share = groups.join(row_member, "row_id").groupBy("k", "group_id").agg(F.count(F.lit(1)).alias("_c")).join(size, "group_id").select("k", "group_id", (F.col("_c") / F.col("_n")).alias("share"))
    r = profile_fit(profile, m).select("k", F.col("predictor").alias("group_id"), "r").join(groups.select("group_id").distinct(), "group_id", "left_semi")
    both = share.join(r, ["k", "group_id"], "full").select("k", "group_id", F.coalesce("share", F.lit(0.0)).alias("share"), F.coalesce("r", F.lit(0.0)).alias("r"))
    return both.where((F.col("share") > 0) | (F.col("r") > r_cutoff))


def candidate_predictors(
    row_member: DataFrame, groups: DataFrame, profile: DataFrame, single: DataFrame, combos: DataFrame | None, env: DataFrame,
    top: int = 25, r_cutoff: float = 1.0, r_min: float = 0.2,
) -> tuple[DataFrame, DataFrame]:
    """(predictors (k, predictor), excluded): AIC-filtered candidates without the cluster's own regulators."""
    out = possibly_regulates(row_member, groups, profile, single, r_cutoff)
    gone = out.select("k", F.col("group_id").alias("predictor"))
    fit = profile_fit(profile, single).where(F.col("r").isNotNull()).join(gone, ["k", "predictor"], "left_anti")
    scored = fit.where(F.abs("r") >= r_min).withColumn("aic", aic(F.col("n"), F.col("r"), F.col("syy")))
    w = Window.partitionBy("k").orderBy("aic", "predictor")
    best = scored.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= top).select("k", "predictor")
    ks = profile.select("k").distinct()
    env_list = env.agg(F.collect_list("row_id").alias("e")).scalar()
    picked = best.unionByName(ks.select("k", F.explode(env_list).alias("predictor")))
    if combos is not None:
        n_best, n_env = best.groupBy("k").agg(F.count(F.lit(1)).alias("_nb")), env.agg(F.count(F.lit(1)).alias("n")).scalar()
        cf = profile_fit(profile, combos).where(F.col("r").isNotNull() & (F.abs("r") >= r_min))
        parts = F.split("predictor", SEP)
        own = gone.select("k", F.col("predictor").alias("_g"))
        bad = cf.select("k", "predictor", F.explode(F.slice(parts, 1, 2)).alias("_g")).join(own, ["k", "_g"], "left_semi").select("k", "predictor").distinct()
        cf = cf.join(bad, ["k", "predictor"], "left_anti").withColumn("aic", aic(F.col("n"), F.col("r"), F.col("syy")))
        ranked = cf.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= top).join(n_best, "k", "left").withColumn("_ne", n_env)
        picked = picked.unionByName(ranked.where(F.col("rn") <= F.coalesce("_nb", F.lit(0)) + F.col("_ne")).select("k", "predictor"))
    return picked.distinct(), out


def fill_time_series(cols: DataFrame, meta: DataFrame, fill: float = 1.25, drop: float = 0.1, gap: int = 1) -> DataFrame:
    """(k, col_id): well covered series are completed, barely covered ones removed, others grown by neighbours.

    ``meta`` is (col_id, series, ord) with series NULL for columns outside a series.
    """
    n_all = meta.select("col_id").distinct().agg(F.count(F.lit(1)).alias("n")).scalar()
    base = cols.select("k", "col_id").distinct()
    share = base.groupBy("k").agg(F.count(F.lit(1)).alias("_c")).withColumn("_all", n_all).select("k", (F.col("_c") / F.col("_all")).alias("_f"))
    ts = meta.where(F.col("series").isNotNull())
    length = ts.groupBy("series").agg(F.count(F.lit(1)).alias("_n"))
    inside = base.join(ts, "col_id").groupBy("k", "series").agg(F.count(F.lit(1)).alias("_i")).join(length, "series").join(share, "k")
    kind = F.when(F.col("_i") / F.col("_n") >= F.col("_f") * fill, "fill").when(F.col("_i") / F.col("_n") < F.col("_f") * drop, "drop").otherwise("grow")
    plan = inside.select("k", "series", kind.alias("_kind"))
    full = plan.where("_kind = 'fill'").join(ts, "series").select("k", "col_id")
    at = base.join(ts, "col_id").join(plan.where("_kind = 'grow'"), ["k", "series"])
    near = at.select("k", "series", F.explode(F.sequence(F.col("ord") - gap, F.col("ord") + gap)).alias("ord")).distinct().join(ts, ["series", "ord"]).select("k", "col_id")
    gone = base.join(ts, "col_id").join(plan.where("_kind = 'drop'"), ["k", "series"], "left_semi").select("k", "col_id")
    return base.join(gone, ["k", "col_id"], "left_anti").unionByName(full).unionByName(near).distinct()


def difference_target(profile: DataFrame, meta: DataFrame, tau: float = 10.0, cutoff: float = 3.0) -> DataFrame:
    """(k, col_id, prev_col, y): tau / dt * (x_t - x_prev) + x_prev, clipped.

    Kept are the later points of a series and single steady-state columns (their own predecessor).
    """
    good = meta.where((F.col("is_ts") & F.col("first_last").isin("m", "l")) | (~F.col("is_ts") & (F.col("first_last") == "e")))
    g = good.select("col_id", F.coalesce("prev_col", "col_id").alias("prev_col"), F.greatest("delta_t", F.lit(1.0)).alias("dt"))
    j = profile.select("k", "col_id", "y").join(g, "col_id").join(profile.select("k", F.col("col_id").alias("prev_col"), F.col("y").alias("_p")), ["k", "prev_col"])
    y = F.lit(float(tau)) / F.col("dt") * (F.col("y") - F.col("_p")) + F.col("_p")
    return clip(j.select("k", "col_id", "prev_col", y.alias("y")), cutoff, "y")


def difference_predictors(m: DataFrame, meta: DataFrame, cutoff: float = 3.0) -> DataFrame:
    """Predictor values moved from the previous column to the current one, clipped."""
    good = meta.where((F.col("is_ts") & F.col("first_last").isin("m", "l")) | (~F.col("is_ts") & (F.col("first_last") == "e")))
    g = good.select(F.col("col_id").alias("_cur"), F.coalesce("prev_col", "col_id").alias("col_id"))
    return clip(m.join(g, "col_id").select("row_id", F.col("_cur").alias("col_id"), "value"), cutoff)


def cluster_profile(m: DataFrame, row_member: DataFrame) -> DataFrame:
    """(k, col_id, y): mean over the members."""
    return m.join(row_member, "row_id").groupBy("k", "col_id").agg(F.avg("value").alias("y"))


def profile_weights(m: DataFrame, row_member: DataFrame, exp_weights: DataFrame | None = None, normalize: bool = False) -> DataFrame:
    """(k, col_id, weight): inverse index of dispersion, times experiment weights."""
    g = m.join(row_member, "row_id").groupBy("k", "col_id").agg(F.var_samp("value").alias("_v"), F.avg("value").alias("_a"))
    w = 1 / F.coalesce(F.nullif(F.col("_v") / (F.abs("_a") + 0.05), F.lit(0.0)), F.lit(1.0))
    out = g.select("k", "col_id", w.alias("weight"))
    if exp_weights is not None:
        out = out.join(exp_weights.select("col_id", F.col("weight").alias("_e")), "col_id").select("k", "col_id", (F.col("weight") * F.col("_e")).alias("weight"))
    if normalize:
        win = Window.partitionBy("k")
        out = out.withColumn("weight", F.col("weight") / F.sum("weight").over(win) * F.count(F.lit(1)).over(win))
    return out


def boot_members(row_member: DataFrame, n_boot: int, seed: int = 1) -> DataFrame:
    """(k, boot, row_id, count): members with their Poisson draw counts; boot 1 holds every member once.

    A later boot that draws no member of a cluster has no rows for it.
    """
    each = row_member.select("k", "row_id").distinct().withColumn("boot", F.explode(F.sequence(F.lit(1), F.lit(n_boot))))
    count = F.when(F.col("boot") == 1, F.lit(1)).otherwise(poisson_one(uniform("k", "row_id", "boot", F.lit(seed))))
    return each.select("k", "boot", "row_id", count.alias("count")).where("count > 0")


def boot_profile(m: DataFrame, draws: DataFrame, exp_weights: DataFrame | None = None) -> DataFrame:
    """(k, boot, col_id, y, weight): mean and inverse index of dispersion over each boot's drawn members."""
    c, v = F.col("count"), F.col("value")
    g = m.where(v.isNotNull()).join(draws, "row_id").groupBy("k", "boot", "col_id").agg(F.sum(c).alias("_n"), F.sum(c * v).alias("_s"), F.sum(c * v * v).alias("_q"))
    var = F.when(F.col("_n") > 1, F.greatest(F.col("_q") - F.col("_s") * F.col("_s") / F.col("_n"), F.lit(0.0)) / (F.col("_n") - 1))
    # sums of equal values leave a rounding rest, which is no spread
    var = F.when(var > 1e-12 * F.col("_q") / F.col("_n"), var)
    y = F.col("_s") / F.col("_n")
    out = g.select("k", "boot", "col_id", y.alias("y"), (1 / F.coalesce(F.nullif(var / (F.abs(y) + 0.05), F.lit(0.0)), F.lit(1.0))).alias("weight"))
    if exp_weights is not None:
        out = out.join(exp_weights.select("col_id", F.col("weight").alias("_e")), "col_id").select("k", "boot", "col_id", "y", (F.col("weight") * F.col("_e")).alias("weight"))
    return out


def boot_columns(cols: DataFrame, every: DataFrame, n_boot: int, seed: int = 1) -> DataFrame:
    """(k, boot, col_id): a cluster's columns in boot 1, as many drawn from all columns without replacement in later ones."""
    own = cols.select("k", "col_id").distinct()
    size = own.groupBy("k").agg(F.count(F.lit(1)).alias("_n")).withColumn("boot", F.explode(F.sequence(F.lit(2), F.lit(max(n_boot, 2))))).where(F.col("boot") <= n_boot)
    axis = every.select("col_id").distinct().agg(F.sort_array(F.collect_list("col_id")).alias("_c")).scalar()
    drawn = size.select("k", "boot", "_n", F.explode(axis).alias("col_id")).withColumn("_u", uniform("k", "col_id", "boot", F.lit(seed)))
    w = Window.partitionBy("k", "boot").orderBy("_u", "col_id")
    later = drawn.withColumn("_r", F.row_number().over(w)).where("_r <= _n").select("k", "boot", "col_id")
    return own.select("k", F.lit(1).alias("boot"), "col_id").unionByName(later)


def boot_targets(target: DataFrame, n_boot: int = 1, boots: str = "columns", seed: int = 1) -> DataFrame:
    """(k, boot, col_id, y, weight, count): Poisson counts of columns per boot, or all columns with ``boots="cv"``.

    Boot 1 holds every column once; with ``cv`` the boots differ by their folds alone.
    """
    if boots not in ("columns", "cv"):
        raise ValueError(f"unknown bootstrap {boots!r}")
    each = target.select("k", "col_id", "y", "weight").withColumn("boot", F.explode(F.sequence(F.lit(1), F.lit(n_boot))))
    whole = F.lit(boots == "cv") | (F.col("boot") == 1)
    count = F.when(whole, F.lit(1)).otherwise(poisson_one(uniform("k", "col_id", "boot", F.lit(seed))))
    return each.select("k", "boot", "col_id", "y", "weight", count.alias("count")).where("count > 0")


def predictor_vectors(cells: DataFrame, *key: str) -> DataFrame:
    """(key…, cols, vals): one row per predictor, as long as the column axis."""
    g = cells.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("col_id", F.col("value").cast("double").alias("value")))).alias("_c"))
    return g.select(*key, F.col("_c.col_id").alias("cols"), F.col("_c.value").alias("vals"))


def fit_targets(targets: DataFrame, listed: DataFrame, vectors: DataFrame, seed: int = 1, **fit) -> DataFrame:
    """(k, boot, predictor, coef) of every cluster and boot.

    ``targets`` is (k, boot, col_id, y, weight, count), ``listed`` (k, predictor, penalty, boot) with boot NULL for a
    candidate of all boots, ``vectors`` (predictor, cols, vals). A task gets a cluster's candidates once, whatever the
    number of boots: boots and folds are weights in its moments (``netfit``). Candidates and columns are bounded by the
    candidate filter and the column axis. A predictor's missing cells count as 0.
    """
    per = listed.groupBy("k", "predictor").agg(F.collect_list(F.coalesce("boot", F.lit(0))).alias("boots"), F.collect_list(F.col("penalty").cast("double")).alias("penalties"))
    return _fit_groups(targets, per.join(vectors, "predictor"), seed, fit)


def _fit_groups(targets: DataFrame, candidates: DataFrame, seed: int, fit: dict) -> DataFrame:
    """``fit_targets`` with ``candidates`` (k, predictor, boots, penalties, cols, vals), boot 0 standing for all."""

    def run(t: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        rows: list[tuple] = []
        if len(t) and len(c):
            c = c.sort_values("predictor")
            axis, boots = pd.Index(np.unique(t["col_id"].to_numpy())), np.unique(t["boot"].to_numpy())
            x = np.zeros((len(axis), len(c)))
            penalty = np.full((len(boots), len(c)), np.nan)
            for j, (cols, vals, at, pen) in enumerate(zip(c["cols"], c["vals"], c["boots"], c["penalties"])):
                where = axis.get_indexer(np.asarray(cols))
                x[where[where >= 0], j] = np.nan_to_num(np.asarray(vals, dtype=float)[where >= 0])
                for b, p in zip(at, pen):
                    penalty[(boots == b) | (b == 0), j] = p
            i, j = np.searchsorted(boots, t["boot"].to_numpy()), axis.get_indexer(t["col_id"].to_numpy())
            y, w, count = np.full((len(boots), len(axis)), np.nan), np.zeros((len(boots), len(axis))), np.zeros((len(boots), len(axis)))
            y[i, j], w[i, j], count[i, j] = t["y"].to_numpy(float), t["weight"].to_numpy(float), t["count"].to_numpy(float)
            names, k = c["predictor"].to_numpy(), t["k"].iloc[0]
            for b, got in zip(boots, netfit.fit_boots(x, y, w, count, penalty, [seed + int(b) for b in boots], **fit)):
                rows += [(k, int(b), str(names[at]), coef) for at, coef in got.items()]
        return pd.DataFrame(rows, columns=["k", "boot", "predictor", "coef"])

    schema = T.StructType([T.StructField("k", targets.schema["k"].dataType), T.StructField("boot", T.IntegerType()), T.StructField("predictor", T.StringType()), T.StructField("coef", T.DoubleType())])
    return spread(targets, "k").groupBy("k").cogroup(spread(candidates.withColumnRenamed("k", "_k"), "_k").groupBy("_k")).applyInPandas(run, schema)


def fit_elastic_net(
    design: DataFrame, n_boot: int = 1, alpha: float = 0.9, folds: int = 10, reps: int = 10, rule: str = "min+2se", cutoff: float = 0.02,
    min_coef: int | None = None, max_coef: int | None = None, refit: str = "path", seed: int = 1, boots: str = "columns",
) -> DataFrame:
    """(k, boot, predictor, coef) from ``design`` (k, col_id, y, weight, predictor, value, penalty).

    Boot 1 uses all columns once, later ones weight them by Poisson counts, or draw new folds only (``boots="cv"``).
    """
    target = design.groupBy("k", "col_id").agg(F.first("y").alias("y"), F.first("weight").alias("weight"))
    own = predictor_vectors(design, "k", "predictor", "penalty")
    candidates = own.select("k", "predictor", F.array(F.lit(0)).alias("boots"), F.array(F.col("penalty").cast("double")).alias("penalties"), "cols", "vals")
    fit = {"alpha": alpha, "folds": folds, "reps": reps, "rule": rule, "cutoff": cutoff, "min_coef": min_coef, "max_coef": max_coef, "refit": refit}
    return _fit_groups(boot_targets(target, n_boot, boots, seed), candidates, seed, fit)


def fit_lasso(design: DataFrame, **options) -> DataFrame:
    """L1 path with an ordinary least squares refit."""
    return fit_elastic_net(design, **{"alpha": 1.0, "refit": "ols", **options})


def bootstrap_quantiles(coefs: DataFrame, n_boot: int, probs: Sequence[float] = (0.01, 0.05, 0.1, 0.5, 0.9, 0.95)) -> DataFrame:
    """(k, predictor, freq, q…): quantiles of |coef| over all boots with missing = 0, signed by the mean.

    A group holds at most one value per boot.
    """
    g = coefs.groupBy("k", "predictor").agg(F.collect_list(F.abs("coef")).alias("_v"), F.avg("coef").alias("_m"), F.count(F.lit(1)).alias("_c"))
    full = F.sort_array(F.concat(F.col("_v"), F.array_repeat(F.lit(0.0), F.greatest(F.lit(n_boot) - F.col("_c").cast("int"), F.lit(0)))))
    g = g.withColumn("_s", full)

    def at(p: float) -> Column:
        h = F.lit(float(p)) * (F.size("_s") - 1)
        lo = F.floor(h).cast("int")
        a, b = F.get("_s", lo), F.get("_s", F.ceil(h).cast("int"))
        return (a + (h - lo) * (b - a)) * F.signum("_m")

    return g.select("k", "predictor", (F.col("_c") / n_boot).alias("freq"), *[at(p).alias(f"q{round(p * 100):02d}") for p in probs])


def predict_profile(coefs: DataFrame, m: DataFrame, func_missing: float = 0.0, meta: DataFrame | None = None, profile: DataFrame | None = None, tau: float = 10.0, bound: float = 3.0) -> DataFrame:
    """(k, col_id, pred): sum of coefficient x predictor; combined predictors by their function.

    With ``meta`` the time-series form (tau * x_prev + dt * sum) / (tau + dt) is used.
    """
    parts = F.split("predictor", SEP)
    c = coefs.where("coef <> 0").withColumn("_a", parts[0]).withColumn("_b", F.coalesce(F.get(parts, F.lit(1)), parts[0])).withColumn("_f", F.coalesce(F.get(parts, F.lit(2)), F.lit("min")))
    cells = m.select(F.col("row_id").cast("string").alias("row_id"), "col_id", "value")
    a = c.join(cells.select(F.col("row_id").alias("_a"), "col_id", F.col("value").alias("_x")), "_a")
    j = a.join(cells.select(F.col("row_id").alias("_b"), "col_id", F.col("value").alias("_y")), ["_b", "col_id"], "left")
    v = F.when(F.col("_f") == "max", F.greatest("_x", "_y")).otherwise(F.least("_x", "_y"))
    total = j.groupBy("k", "col_id").agg(F.sum(F.col("coef") * F.coalesce(v, F.lit(func_missing))).alias("pred"))
    if meta is not None:
        steps = meta.select("col_id", "prev_col", F.greatest("delta_t", F.lit(1.0)).alias("dt"))
        prev = profile.select("k", F.col("col_id").alias("prev_col"), F.col("y").alias("_p"))
        t = total.join(steps, "col_id", "left").join(prev, ["k", "prev_col"], "left")
        total = t.select("k", "col_id", ((tau * F.coalesce("_p", F.lit(0.0)) + F.coalesce("dt", F.lit(1.0)) * F.col("pred")) / (tau + F.coalesce("dt", F.lit(1.0)))).alias("pred"))
    return clip(total, bound, "pred")


def prediction_rmsd(pred: DataFrame, profile: DataFrame, col_member: DataFrame, weights: DataFrame | None = None) -> DataFrame:
    """(k, rmsd_in, rmsd_out): weighted root mean square error inside and outside the cluster columns."""
    j = profile.join(pred, ["k", "col_id"], "left").withColumn("pred", F.coalesce("pred", F.lit(0.0)))
    j = j.join(weights, ["k", "col_id"]) if weights is not None else j.withColumn("weight", F.lit(1.0))
    j = j.join(col_member.select("k", "col_id").withColumn("_in", F.lit(1)), ["k", "col_id"], "left")
    sq = F.col("weight") * F.pow(F.col("pred") - F.col("y"), 2.0)
    side = lambda cond: F.sqrt(F.sum(F.when(cond, sq)) / F.sum(F.when(cond, F.col("weight"))))
    return j.groupBy("k").agg(side(F.col("_in").isNotNull()).alias("rmsd_in"), side(F.col("_in").isNull()).alias("rmsd_out"))


def repair_series_bounds(meta: DataFrame) -> DataFrame:
    """Mark the first and last remaining column of every series again."""
    ts = meta.where(F.col("series").isNotNull())
    ends = ts.groupBy("series").agg(F.min_by("col_id", "ord").alias("_f"), F.max_by("col_id", "ord").alias("_l"))
    mark = F.when(F.col("_f").isNull(), F.lit("e")).when(F.col("_f") == F.col("col_id"), F.lit("f")).when(F.col("_l") == F.col("col_id"), F.lit("l")).otherwise(F.lit("m"))
    return meta.drop("first_last").join(ends, "series", "left").withColumn("first_last", mark).drop("_f", "_l")


def regulator_edges(coefs: DataFrame, excluded: DataFrame | None = None) -> DataFrame:
    """(src, kind, dst, weight): regulators to clusters, with a gate node per combined predictor."""
    node = F.format_string("bicluster_%04d", F.col("k"))
    parts = F.split("predictor", SEP)
    c = coefs.withColumn("_p", parts)
    sign = F.when(F.col("coef") > 0, F.lit("activates")).otherwise(F.lit("represses"))
    one = c.where(F.size("_p") == 1).select(F.col("predictor").alias("src"), sign.alias("kind"), node.alias("dst"), F.col("coef").alias("weight"))
    many = c.where(F.size("_p") > 1)
    gate = F.concat(F.lit("AND_"), F.hex(F.xxhash64("predictor")))
    combo = many.select(F.explode(F.slice("_p", 1, 2)).alias("src"), F.lit("combines").alias("kind"), gate.alias("dst"), F.lit(None).cast("double").alias("weight")).distinct()
    out = one.unionByName(many.select(gate.alias("src"), sign.alias("kind"), node.alias("dst"), F.col("coef").alias("weight"))).unionByName(combo)
    if excluded is not None:
        out = out.unionByName(excluded.select(F.col("group_id").cast("string").alias("src"), F.lit("possibly_regulates").alias("kind"), node.alias("dst"), F.col("r").alias("weight")))
    return out
