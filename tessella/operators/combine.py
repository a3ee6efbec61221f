"""Combining score families, noise, density probabilities and size compensation."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.functions.chance import normal
from tessella.functions.order import indexed, quantiles, running_sum, scalar_quantiles
from tessella.session import materialize

FLOOR = -20.0  # scores under this are effective zeros


def floor_low(df: DataFrame, col: str) -> DataFrame:
    """Raise values under the floor to the smallest value above it."""
    low = df.where(F.col(col) >= FLOOR).agg(F.min(col).alias("m")).scalar()
    return df.withColumn(col, F.when(F.col(col) < FLOOR, low).otherwise(F.col(col)))


def _floored(col: Column, low: float | None) -> Column:
    return col if low is None else F.when(col < FLOOR, F.lit(low)).otherwise(col)


def combine_scores(
    row: DataFrame, row_member: DataFrame, mot: DataFrame | None = None, net: DataFrame | None = None,
    weights: Sequence[float] = (1.0, 1.0, 1.0),
) -> DataFrame:
    """(row_id, k, score): row scores robustly scaled plus motif and network scores on the same range.

    The dense row scores define the grid; an absent motif or network score counts as 0. The families
    are joined and written once with a membership flag; five small aggregations over that copy give
    every scalar (floors, in-cluster median and mad, 1% and 99% quantiles).
    """
    inside = row_member.select("row_id", "k", F.lit(True).alias("_in")).distinct()
    wide = row.select("row_id", "k", F.col("score").alias("r")).join(inside, ["row_id", "k"], "left")
    for tag, df in (("m", mot), ("n", net)):
        if df is not None:
            wide = wide.join(df.select("row_id", "k", F.col("score").alias(tag)), ["row_id", "k"], "left").withColumn(tag, F.coalesce(tag, F.lit(0.0)))
    wide = materialize(wide, "families")
    low = lambda c: F.min(F.when(c >= FLOOR, c))
    first = wide.agg(low(F.col("r")).alias("r"), *([low(F.col("m")).alias("m")] if mot is not None else []), F.count("_in").alias("n_in")).first()
    r = _floored(F.col("r"), first["r"])
    mine, n_in = wide.where("_in"), first["n_in"]
    if n_in:
        med = scalar_quantiles(mine, {"m": (r, 0.5)})["m"]
        dev = med if med is None else scalar_quantiles(mine, {"d": (F.abs(r - med), 0.5)})["d"] * 1.4826
        if med is not None and not dev:
            dev = mine.agg(F.stddev_samp(r).alias("s")).first()["s"]
        if dev:
            r = (r - med) / dev
    edge = wide.agg(low(r).alias("low"), F.max(F.when(F.abs(r) < float("inf"), r)).alias("top")).first()
    r = _floored(r, edge["low"])
    r = F.coalesce(F.when(F.abs(r) < float("inf"), r), F.lit(edge["top"]))
    wanted = {"r01": (r, 0.01)} if mot is not None or net is not None else {}
    m = _floored(F.col("m"), first["m"]) if mot is not None else None
    if mot is not None:
        wanted |= {"m99": (m, 0.99), "m01": (m, 0.01)}
    if net is not None:
        wanted |= {"n99": (F.col("n"), 0.99), "n01": (F.col("n"), 0.01)}
    q = scalar_quantiles(wide, wanted) if wanted else {}
    total: Column = r * float(weights[0])
    if mot is not None:
        span = abs(q["m01"] - q["m99"])
        if span:
            total = total + (m - q["m99"]) / span * abs(q["r01"]) * float(weights[1])
    if net is not None:
        span = abs(q["n01"] - q["n99"])
        if span == 0:  # sparse networks: tenth smallest, then the smallest
            least = [x["n"] - q["n99"] for x in wide.select("n").orderBy("n").limit(10).collect()]
            span = least[-1] or least[0]
        part = F.col("n") - q["n99"]
        total = total + (part / span * abs(q["r01"]) if span else part) * float(weights[2])
    return wide.select("row_id", "k", total.alias("score"))


def quantile_normalize(sets: DataFrame, weights: dict[str, float] | None = None, ids: Sequence[str] = ("row_id", "k")) -> DataFrame:
    """Give all score sets of ``sets`` (set, ids, score) the same distribution.

    Values at equal sorted positions are averaged over the sets, then mapped back by the lowest rank.
    """
    pos = indexed(sets.where(F.col("score").isNotNull()), ["set"], ["score", *ids], "pos")
    names = [r["set"] for r in sets.select("set").distinct().collect()]
    w = {n: float((weights or {}).get(n, 1.0)) for n in names}
    weight = F.coalesce(*[F.when(F.col("set") == n, F.lit(v)) for n, v in w.items()])
    denom = F.lit(sum(w.values())) if weights else F.lit(1.0)
    mean = pos.groupBy("pos").agg((F.avg(F.col("score") * weight) / denom).alias("level"))
    low = pos.groupBy("set", "score").agg(F.min("pos").alias("pos"))
    mapped = low.join(mean, "pos").select("set", "score", "level")
    return pos.drop("pos").join(mapped, ["set", "score"]).select("set", *ids, F.col("level").alias("score"))


def fuzz(scores: DataFrame, member: DataFrame, index: float, iteration: int, seed: int, axis: str = "row_id") -> DataFrame:
    """Add seeded normal noise with sd = in-cluster sd * index."""
    if index <= 1e-5:
        return scores
    sd = scores.join(member.select(axis, "k"), [axis, "k"], "left_semi").agg(F.stddev_samp("score").alias("s")).scalar()
    return scores.withColumn("score", F.col("score") + normal(axis, "k", iteration, seed) * sd * F.lit(float(index)))


def fuzz_index(iteration: int, n_iter: int) -> float:
    return 0.75 * math.exp(-iteration / (n_iter / 4))


GRID = 512
POINTS = 256


def _smooth_tail(mass: np.ndarray, lo: float, up: float, start: float, stop: float, bw: float) -> np.ndarray:
    """Reverse cumulative Gaussian density on POINTS grid points from linearly binned mass.

    A bandwidth far under the grid step, down to the zero of a very large cluster, leaves the mass where it is.
    """
    n = GRID
    span = np.linspace(0, 2 * (up - lo), 2 * n)
    bw = max(bw, span[1] / 40)  # the next grid point already gets exp(-800) = 0
    span[n + 1:] = -span[n - 1:0:-1]
    kernel = np.exp(-0.5 * (span / bw) ** 2) / (bw * math.sqrt(2 * math.pi))
    y = np.zeros(2 * n)
    y[:n] = mass
    dens = np.fft.ifft(np.fft.fft(y) * np.conj(np.fft.fft(kernel))).real[:n]
    dens = np.maximum(dens, 0)
    at = np.interp(np.linspace(start, stop, POINTS), np.linspace(lo, up, n), dens)
    return np.cumsum(at[::-1])[::-1]


def density_scores(scores: DataFrame, member: DataFrame, axis: str = "row_id", rows: bool = True, has_other: DataFrame | None = None) -> DataFrame:
    """(axis, k, score): tail probability of each score under its cluster's member density, summing to 1.

    Member scores are reduced to at most GRID bins per cluster before the smoothing step, so the
    record handed to Python has a bounded size whatever the cluster size. A cluster without members
    (or, for columns, with one single value) gets a constant.
    """
    rng = scores.agg(F.min("score").alias("lo"), F.max("score").alias("hi")).first()
    base = max((rng["hi"] - rng["lo"]) / 100, 0.001)
    flagged = scores.join(member.select(axis, "k", F.lit(True).alias("_in")).distinct(), [axis, "k"], "left")
    if has_other is not None:
        live = has_other.select("k", F.lit(True).alias("_live")).distinct()
        flagged = flagged.join(live, "k", "left").withColumn("_in", F.col("_in") & F.col("_live")).drop("_live")
    mine = F.when(F.col("_in"), F.col("score"))
    spec = flagged.groupBy("k").agg((F.min("score") - 1).alias("_a"), (F.max("score") + 1).alias("_z"), F.count(mine).alias("_n"), F.min(mine).alias("_lo"), F.max(mine).alias("_hi")).where("_n > 0")
    if not rows:
        spec = spec.where(F.col("_hi") > F.col("_lo"))
    bw = F.lit(2 * base) * (10 * F.exp(-F.col("_n") / 10.0) if rows else F.lit(1.0))
    spec = spec.withColumn("_bw", bw).withColumn("_from", F.col("_a") - 4 * F.col("_bw")).withColumn("_to", F.col("_z") + 4 * F.col("_bw"))
    inside = flagged.where(F.col("_in") & F.col("score").isNotNull()).select("k", "score")
    x = (F.col("score") - F.col("_from")) / (F.col("_to") - F.col("_from")) * (GRID - 1)
    binned = inside.join(spec, "k").withColumn("_x", x).withColumn("_i", F.floor("_x").cast("int")).groupBy("k", "_i").agg(
        F.sum(1 - (F.col("_x") - F.col("_i"))).alias("_l"), F.sum(F.col("_x") - F.col("_i")).alias("_r"),
        *[F.first(c).alias(c) for c in ("_a", "_z", "_n", "_bw", "_from", "_to")])

    packed = binned.groupBy("k").agg(F.collect_list(F.struct("_i", "_l", "_r")).alias("_bins"), *[F.first(c).alias(c) for c in ("_a", "_z", "_n", "_bw", "_from", "_to")])

    def smooth(batches):
        for pdf in batches:
            tails = []
            for bins, a, z, n, h, lo, up in zip(pdf["_bins"], pdf["_a"], pdf["_z"], pdf["_n"], pdf["_bw"], pdf["_from"], pdf["_to"]):
                mass = np.zeros(GRID + 1)
                i = np.array([x["_i"] for x in bins])
                np.add.at(mass, i, np.array([x["_l"] for x in bins]))
                np.add.at(mass, i + 1, np.array([x["_r"] for x in bins]))
                tails.append(_smooth_tail(mass[:GRID] / n, lo, up, a, z, h).tolist())
            yield pd.DataFrame({"k": pdf["k"], "_a": pdf["_a"], "_step": (pdf["_z"] - pdf["_a"]) / (POINTS - 1), "_tail": tails})

    schema = T.StructType([T.StructField("k", scores.schema["k"].dataType), T.StructField("_a", T.DoubleType()), T.StructField("_step", T.DoubleType()), T.StructField("_tail", T.ArrayType(T.DoubleType()))])
    tails = packed.mapInPandas(smooth, schema)
    at = (F.col("score") - F.col("_a")) / F.col("_step")
    i = F.least(F.floor(at).cast("int"), F.lit(POINTS - 2))
    left, right = F.get("_tail", i), F.get("_tail", i + 1)
    p = F.when(F.col("_tail").isNull(), F.lit(1.0)).otherwise(left + (at - i) * (right - left))
    probs = scores.join(tails, "k", "left").select(axis, "k", p.alias("_p"))
    total = probs.groupBy("k").agg(F.sum("_p").alias("_s"))
    return probs.join(total, "k").select(axis, "k", (F.col("_p") / F.col("_s")).alias("score"))


def size_compensation(density: DataFrame, member: DataFrame, axis: str, n_axis: Column | int, per_item: int, n_clusters: Column | int, least: Column | float) -> DataFrame:
    """Times exp(-max(n, least) / (n_axis * per_item / n_clusters)) by cluster size."""
    size = member.groupBy("k").agg(F.count(F.lit(1)).alias("_n"))
    n = F.greatest(F.coalesce(F.col("_n"), F.lit(0)).cast("double"), (F.lit(least) if isinstance(least, (int, float)) else least).cast("double"))
    expect = (F.lit(n_axis) if isinstance(n_axis, int) else n_axis) * F.lit(float(per_item)) / (F.lit(n_clusters) if isinstance(n_clusters, int) else n_clusters)
    return density.join(size, "k", "left").select(axis, "k", (F.col("score") * F.exp(-n / expect)).alias("score"))


def filter_membership(density: DataFrame, member: DataFrame, q: float, axis: str = "row_id") -> DataFrame:
    """Drop memberships under the q-quantile of in-cluster density."""
    inside = member.select("k", axis).join(density, ["k", axis])
    cut = quantiles(inside, [], "score", {"q": q}).first()["q"]
    return inside.where(F.col("score") >= cut).select("k", axis)


def ecdf_density(scores: DataFrame, member: DataFrame, keys: Sequence[str] = ("k",), axis: str = "row_id") -> DataFrame:
    """1 - ECDF of the member values (with one extra point just above their maximum)."""
    keys = list(keys)
    j = scores.join(member.select("k", axis).withColumn("_in", F.lit(1)), ["k", axis], "left")
    tally = j.groupBy(*keys, "score").agg(F.count("_in").cast("double").alias("_c"))
    run = running_sum(tally, keys, ["score"], "_c", "_le").drop("_c")
    stat = j.groupBy(*keys).agg(
        F.count("_in").alias("_m"), F.max(F.when(F.col("_in").isNotNull(), F.col("score"))).alias("_top"),
        F.count(F.lit(1)).alias("_n"), F.min("score").alias("_lo"), F.max("score").alias("_hi"))
    full = j.join(run, [*keys, "score"]).join(stat, keys)
    le = F.col("_le") + F.when(F.col("score") >= F.col("_top") + 1e-5, 1).otherwise(0)
    p = F.when((F.col("_m") == 0) | (F.col("_lo") == F.col("_hi")), 1 / F.col("_n")).otherwise(1 - le / (F.col("_m") + 1))
    return full.select(*keys, axis, p.alias("score"))


def pareto_weights(stats: DataFrame, iteration: int, before: dict[str, float], planned: dict[str, float], window: int = 51, lag: int = 21, cap: float = 0.1) -> dict[str, float]:
    """Raise the weight of score families whose running-median trend went up.

    ``stats`` holds one record per iteration; the trend is over its last ``lag`` records.
    """
    if iteration < lag / 2:
        return dict(before)
    rows = stats.where(F.col("iter") > 0).orderBy("iter").collect()  # one record per iteration
    out = dict(before)
    lag, window = min(lag, iteration), min(window, iteration)
    for name, col in (("row", "row_scores"), ("mot", "mot_scores"), ("net", "net_scores")):
        vals = np.array([r[col] for r in rows if r[col] is not None], dtype=float)
        if len(vals) == 0:
            continue
        half = window // 2
        av = np.array([np.median(vals[max(0, i - min(half, i, len(vals) - 1 - i)): i + min(half, i, len(vals) - 1 - i) + 1]) for i in range(len(vals))])
        span = av.max() - av.min()
        if span > 0:
            out[name] = out[name] + min(cap, (av[-1] - av[max(0, len(av) - 1 - lag)]) / span)
        out[name] = max(out[name], planned[name])
    return out


def mean_difference_weights(stats: DataFrame, iteration: int, before: dict[str, float], delta_iter: int = 200, n_avg: int = 50, max_delta: float = 0.05) -> dict[str, float]:
    """Older variant: mean change over ``delta_iter`` iterations relative to the range."""
    if iteration < delta_iter + n_avg + 10:
        return dict(before)
    out = dict(before)
    recent = (F.col("iter") > iteration - n_avg) & (F.col("iter") <= iteration)
    past = (F.col("iter") > iteration - n_avg - delta_iter) & (F.col("iter") <= iteration - delta_iter)
    for name, col in (("row", "resid"), ("mot", "pclust"), ("net", "net_scores")):
        r = stats.agg(F.avg(F.when(recent, F.col(col))).alias("a"), F.avg(F.when(past, F.col(col))).alias("b"), (F.max(col) - F.min(col)).alias("s")).first()
        if r["a"] is not None and r["b"] is not None and r["s"] and out[name] > 0:
            gain = (r["a"] - r["b"]) / r["s"]
            if gain > 0:
                out[name] += min(out[name] * max_delta, gain)
    return out
