"""Regulator inference for all clusters at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.operators import networks as nw
from tessella.operators import regulators as rg
from tessella.operators.matrix import mean_variance_normalize
from tessella.session import materialize


def infer_all(
    m: DataFrame, row_member: DataFrame, col_member: DataFrame, predictors: DataFrame, prefix: str, meta: DataFrame | None = None,
    priors: DataFrame | None = None, n_groups: int | None = 30, top: int = 25, r_cutoff: float = 1.0, tau: float = 10.0, n_boot: int = 1,
    combine: bool = True, exp_weights: DataFrame | None = None, boots: str = "columns", seed: int = 1, **fit,
) -> dict[str, DataFrame]:
    """Coefficients, quantiles, predictions and errors of every cluster.

    ``m`` has string row ids. ``meta`` is (col_id, series, ord, is_ts, first_last, prev_col, delta_t).
    ``boots`` says what the bootstraps after the first draw again: the ``columns`` of the fit, its folds (``cv``), the
    member ``rows`` (profile, weights and candidates follow), or member ``rows_columns``, where each bootstrap also has
    as many columns drawn from all. Each stage is one job over all clusters and bootstraps.
    """
    if boots not in ("columns", "cv", "rows", "rows_columns"):
        raise ValueError(f"unknown bootstrap {boots!r}")
    data = materialize(mean_variance_normalize(m), "normalized")
    single, groups = rg.predictor_table(data, predictors, prefix, n_groups)
    single = materialize(single, "predictors")
    combos = materialize(rg.combine_predictors(single), "combined") if combine else None
    env = single.select("row_id").distinct().join(groups.select(F.col("group_id").cast("string").alias("row_id")), "row_id", "left_anti")
    # with drawn members a bootstrap is a cluster of its own until the fit: its key is (k, boot)
    by_rows = boots in ("rows", "rows_columns")
    key = F.struct("k", "boot").alias("k") if by_rows else F.col("k")
    each = F.explode(F.sequence(F.lit(1), F.lit(n_boot))).alias("boot")

    def first(df: DataFrame) -> DataFrame:
        return df.where("k.boot = 1").withColumn("k", F.col("k.k")) if by_rows else df

    if by_rows:
        draws = materialize(rg.boot_members(row_member, n_boot, seed), "draws")
        members = draws.select(key, "row_id")
        profiles = materialize(rg.boot_profile(data, draws, exp_weights), "profiles")
        profile, weights = profiles.select(key, "col_id", "y"), profiles.select(key, "col_id", "weight")
        own = rg.boot_columns(col_member, data, n_boot, seed) if boots == "rows_columns" else col_member.select("k", "col_id", each)
        own = own.select(key, "col_id")
    else:
        members, own = row_member, col_member.select("k", "col_id")
        profile = materialize(rg.cluster_profile(data, row_member), "profile")
        weights = materialize(rg.profile_weights(data, row_member, exp_weights), "weights")
    cols = rg.fill_time_series(own, meta) if meta is not None else own
    cols = materialize(cols.join(data.select("col_id").distinct(), "col_id", "left_semi"), "cols")
    inside = profile.join(cols, ["k", "col_id"], "left_semi")
    picked, excluded = rg.candidate_predictors(members, groups, inside, single, combos, env, top, r_cutoff)
    every = single if combos is None else single.unionByName(combos)
    if priors is not None:
        known = priors.select("k", "predictor", "prior", each).select(key, "predictor", "prior") if by_rows else priors
        listed = nw.attach_priors(picked, known, every.select(F.col("row_id").alias("predictor")))
        excluded = excluded.join(listed.select("k", F.col("predictor").alias("group_id")), ["k", "group_id"], "left_anti")
    else:
        listed = picked.withColumn("penalty", F.lit(1.0))
    listed = materialize(listed, "candidates")
    scaled = mean_variance_normalize(every, None)
    if meta is not None and tau > 0:
        target = rg.difference_target(profile, meta, tau).select("k", "col_id", "y")
        inputs = rg.difference_predictors(scaled, meta)
    else:
        target, inputs = rg.clip(profile, 3.0, "y"), rg.clip(scaled, 3.0)
    target = target.join(cols, ["k", "col_id"], "left_semi").join(weights, ["k", "col_id"])
    if by_rows:
        targets = target.select("k.k", "k.boot", "col_id", "y", "weight", F.lit(1).alias("count"))
        listed = listed.select("k.k", "predictor", "penalty", "k.boot")
    else:
        targets = rg.boot_targets(target, n_boot, boots, seed)
        listed = listed.select("k", "predictor", "penalty", F.lit(None).cast("int").alias("boot"))
    vectors = rg.predictor_vectors(inputs.withColumnRenamed("row_id", "predictor"), "predictor")
    coefs = materialize(rg.fit_targets(targets, listed, vectors, seed, **fit), "coefs")
    one = coefs.where("boot = 1").select("k", "predictor", "coef")
    profile, weights, cols, excluded = first(profile), first(weights), first(cols), first(excluded)
    steady = rg.predict_profile(one, every)
    series = rg.predict_profile(one, every, meta=meta, profile=profile, tau=tau) if meta is not None else steady
    return {
        "coefs": one, "all_coefs": coefs, "quantiles": rg.bootstrap_quantiles(coefs, n_boot), "excluded": excluded, "columns": cols,
        "steady": steady, "predicted": series, "rmsd": rg.prediction_rmsd(series, profile, cols, weights),
        "edges": rg.regulator_edges(one, excluded), "profile": profile,
    }
