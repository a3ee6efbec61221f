"""Row, column, motif and network scores of every cluster."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions.order import quantiles
from tessella.operators import tiles
from tessella.session import materialize, spread


def cluster_sizes(member: DataFrame, out: str = "nrows") -> DataFrame:
    return member.groupBy("k").agg(F.count(F.lit(1)).alias(out))


def centroids(m: DataFrame, row_member: DataFrame) -> DataFrame:
    """Mean of the member rows per cluster and column."""
    return m.join(row_member, "row_id").groupBy("k", "col_id").agg(F.avg("value").alias("mu"))


def row_scores(m: DataFrame, row_member: DataFrame, col_member: DataFrame, col_weights: DataFrame | None = None) -> DataFrame:
    """ln(mean over cluster columns of (x - centroid)^2 + 1e-99) for every row and cluster.

    The matrix moves once, to have a row's cells in one task. The centroids, one per cluster and column, are written first,
    so that a table of known size joins it there and the terms of all clusters add up without another shuffle.
    """
    target = col_member.join(centroids(m, row_member), ["k", "col_id"])
    if col_weights is not None:
        target = target.join(col_weights, ["k", "col_id"])
    cells = spread(m, "row_id").join(materialize(target, "centroids"), "col_id")
    sq = F.pow(F.col("value") - F.col("mu"), 2.0)
    mean = F.avg(sq) if col_weights is None else F.sum(sq * F.col("weight")) / F.sum("weight")
    return cells.groupBy("row_id", "k").agg(F.log(mean + 1e-99).alias("score"))


def col_scores(m: DataFrame, row_member: DataFrame, norm: str = "mean", row_weights: DataFrame | None = None) -> DataFrame:
    """Mean squared deviation of the member rows per column, divided by the chosen norm.

    Partial aggregates combine before the shuffle, so a cluster with a third of all rows costs one
    accumulator per column and task.
    """
    present = m.select("row_id").distinct()
    big = cluster_sizes(row_member.join(present, "row_id", "left_semi")).where("nrows >= 2")
    cells = m.join(row_member.join(big, "k", "left_semi"), "row_id")
    if row_weights is None:
        g = cells.groupBy("k", "col_id").agg(F.avg("value").alias("mu"), F.var_pop("value").alias("msd"))
    else:
        g = cells.join(row_weights, ["k", "row_id"]).groupBy("k", "col_id").agg(
            (F.sum(F.col("value") * F.col("weight")) / F.sum("weight")).alias("mu"),
            F.avg("value").alias("_a"), F.var_pop("value").alias("_v"),
        ).withColumn("msd", F.col("_v") + F.pow(F.col("_a") - F.col("mu"), 2.0))
    if norm == "mean":
        return g.select("k", "col_id", (F.col("msd") / (F.abs("mu") + 0.01)).alias("score"))
    if norm == "all_col_vars":
        v = m.groupBy("col_id").agg(F.var_samp("value").alias("_cv"))
        return g.join(v, "col_id").select("k", "col_id", (F.col("msd") / (F.col("_cv") + 0.01)).alias("score"))
    return g.select("k", "col_id", F.col("msd").alias("score"))


def motif_scores(hits: DataFrame, row_member: DataFrame) -> DataFrame:
    """ln(best p-value) per row and cluster; clusters of at most one row get none."""
    best = hits.groupBy("k", "row_id").agg(F.min("pvalue").alias("p"))
    return best.join(cluster_sizes(row_member).where("nrows > 1"), "k", "left_semi").select("row_id", "k", F.log("p").alias("score"))


def network_scores(edges: DataFrame, row_member: DataFrame, combine: Callable[[str], Column] = F.sum) -> DataFrame:
    """-ln(1 + combined weight from member rows / cluster size); rows without such an edge are absent."""
    sizes = cluster_sizes(row_member)
    linked = edges.join(row_member, F.col("src") == F.col("row_id")).groupBy("k", F.col("dst").alias("node")).agg(combine("weight").alias("_w"))
    return linked.join(sizes, "k").select(F.col("node").alias("row_id"), "k", (-F.log(F.col("_w") / F.col("nrows") + 1)).alias("score"))


def group_network_scores(grp: DataFrame, row_member: DataFrame, max_size: Column | int) -> DataFrame:
    """Network scores of a grouping without building its edges.

    The grouping stands for an edge of weight (w_r + w_m) / 2 between all members of a group. The sum
    over cluster members m of r's group splits into per (cluster, group) sums, so the cost is linear
    in the memberships instead of quadratic in the group size.
    """
    sized = eligible_groups(grp, max_size)
    inside = sized.join(row_member, "row_id").groupBy("net", "group_id", "k").agg(F.sum("weight").alias("_sw"), F.count(F.lit(1)).alias("_n"))
    own = row_member.withColumn("_own", F.lit(1))
    pairs = sized.join(inside, ["net", "group_id"]).join(own, ["k", "row_id"], "left")
    mine = F.coalesce("_own", F.lit(0))
    total = (F.col("_sw") + F.col("weight") * F.col("_n") - 2 * mine * F.col("weight")) / 2
    cnt = F.col("_n") - mine
    per = pairs.where(cnt > 0).groupBy("row_id", "k").agg(F.sum(total).alias("_w"))
    return per.join(cluster_sizes(row_member), "k").select("row_id", "k", (-F.log(F.col("_w") / F.col("nrows") + 1)).alias("score"))


def eligible_groups(grp: DataFrame, max_size: Column | int) -> DataFrame:
    """Members of groups with 2..max_size members."""
    n = grp.groupBy("net", "group_id").agg(F.count(F.lit(1)).alias("_gn")).where((F.col("_gn") > 1) & (F.col("_gn") <= max_size))
    return grp.join(n, ["net", "group_id"]).drop("_gn")


def complete(scores: DataFrame, universe: DataFrame, ks: DataFrame, axis: str = "row_id") -> DataFrame:
    """One record per universe id and cluster, missing scores NULL.

    Every id is paired with the list of cluster numbers, which is bounded by the number of clusters.
    """
    all_k = ks.select("k").distinct().agg(F.sort_array(F.collect_list("k")).alias("_ks")).scalar()
    grid = universe.select(axis).distinct().select(axis, F.explode(all_k).alias("k"))
    return grid.join(scores, [axis, "k"], "left")


def fill_with_member_quantile(full: DataFrame, member: DataFrame, axis: str = "row_id", q: float = 0.95) -> DataFrame:
    """No measurement is an observation: missing scores take the 0.95 quantile of in-cluster scores."""
    inside = full.join(member, [axis, "k"], "left_semi")
    cut = quantiles(inside, [], "score", {"q": q}).select("q").scalar()
    return full.withColumn("score", F.coalesce(F.when(F.abs("score") < float("inf"), F.col("score")), cut))


def weighted_sum(parts: Mapping[str, tuple[DataFrame, float]], axis: str = "row_id") -> DataFrame:
    """Sum of weight * score over sources with a non-zero weight."""
    frames = [df.select(axis, "k", (F.col("score") * float(w)).alias("score")) for df, w in parts.values() if w]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out.groupBy(axis, "k").agg(F.sum("score").alias("score"))


def all_scores(
    matrices: Mapping[str, DataFrame], row_weights: Mapping[str, float], row_member: DataFrame, col_member: DataFrame,
    networks: Mapping[str, DataFrame] | None = None, net_weights: Mapping[str, float] | None = None,
    hits: DataFrame | None = None, mot_weight: float = 1.0, want: tuple[str, ...] = ("row", "col", "mot", "net"),
) -> dict[str, DataFrame]:
    """Every score family over all its sources, with the missing-data rule applied.

    Zero-weight sources are dropped before planning. Motif and network scores stay sparse: a missing
    one counts as 0 and is filled only where families are combined.
    """
    out: dict[str, DataFrame] = {}
    live = {n: m for n, m in matrices.items() if row_weights.get(n)}
    if "row" in want:
        out["row"] = weighted_sum({
            n: (fill_with_member_quantile(complete(row_scores(m, row_member, col_member), m, row_member), row_member), row_weights[n])
            for n, m in live.items()})
    if "col" in want:
        out["col"] = weighted_sum({
            n: (fill_with_member_quantile(complete(col_scores(m, row_member), m, row_member, "col_id"), col_member, "col_id"), row_weights[n])
            for n, m in live.items()}, "col_id")
    if "mot" in want and hits is not None and mot_weight:
        out["mot"] = motif_scores(hits, row_member).withColumn("score", F.col("score") * float(mot_weight))
    if "net" in want and networks:
        parts = {n: (network_scores(e, row_member), (net_weights or {}).get(n, 0.0)) for n, e in networks.items()}
        if any(w for _, w in parts.values()):
            out["net"] = weighted_sum(parts)
    return out


def row_scores_to_members(m: DataFrame, row_member: DataFrame, method: str) -> DataFrame:
    """Score by correlation (cor, cor2, abscor), distance (dist.*) or mutual information (mi.*) to the members."""
    axis = tiles.column_axis(m)
    # written once: both sides of the tiles read the vectors, and would pack them again for every copy
    vec = materialize(spread(tiles.pack_rows(m, axis), "row_id"), "vectors")
    sums = tiles.member_means(vec, row_member, axis.count(), method).where("n > 0")
    mean = F.col("total") / F.col("n")
    if method.startswith("dist"):
        mean = F.log(mean + 1e-99)
    elif method.startswith("mi"):
        mean = -mean
    return sums.select("row_id", "k", mean.alias("score"))


def col_scores_leave_one_out(m: DataFrame, row_member: DataFrame, col_member: DataFrame) -> DataFrame:
    """Ratio of the mean row score with and without each column.

    A column adds one term to a row's sum of squares, so each row needs its base sum once and every
    column only adds or subtracts its own term. Rows and member columns are read in one pass.
    """
    mu = centroids(m, row_member)
    cells = m.join(mu, "col_id").select("row_id", "k", "col_id", F.pow(F.col("value") - F.col("mu"), 2.0).alias("sq"))
    flagged = cells.join(col_member.withColumn("_in", F.lit(1)), ["k", "col_id"], "left")
    w = Window.partitionBy("row_id", "k")
    inside = F.col("_in").isNotNull()
    base = flagged.withColumn("_s", F.sum(F.when(inside, F.col("sq"))).over(w)).withColumn("_n", F.count(F.when(inside, 1)).over(w)).where("_n > 0")
    shown = F.log(F.col("_s") / F.col("_n") + 1e-99)
    less = F.when(F.col("_n") > 1, F.log(F.greatest(F.col("_s") - F.col("sq"), F.lit(0.0)) / (F.col("_n") - 1) + 1e-99))
    more = F.log((F.col("_s") + F.col("sq")) / (F.col("_n") + 1) + 1e-99)
    changed = base.select("k", "row_id", "col_id", "_in", (F.when(inside, less).otherwise(more) - shown).alias("_d"), shown.alias("_b"))
    # rows missing this column keep their base score: correct the mean by the change only
    means = changed.groupBy("k", "row_id").agg(F.max("_b").alias("_b")).groupBy("k").agg(F.avg("_b").alias("_mn"), F.count(F.lit(1)).alias("_r"))
    shift = changed.groupBy("k", "col_id").agg(F.sum("_d").alias("_ds"), F.max("_in").alias("_in"))
    other = F.col("_mn") + F.coalesce("_ds", F.lit(0.0)) / F.col("_r")
    ratio = F.when(F.col("_in").isNotNull(), F.col("_mn") / other).otherwise(other / F.col("_mn"))
    return shift.join(means, "k").select("k", "col_id", (-ratio).alias("score"))


def column_weights_dispersion(m: DataFrame, row_member: DataFrame, col_member: DataFrame) -> DataFrame:
    """Inverse index of dispersion over the member rows, normalised to mean 1 per cluster."""
    g = m.join(row_member, "row_id").join(col_member, ["k", "col_id"], "left_semi").groupBy("k", "col_id").agg(
        F.var_samp("value").alias("_v"), F.avg("value").alias("_a"))
    disp = F.col("_v") / (F.abs("_a") + 0.05)
    g = g.withColumn("_w", 1 / F.coalesce(F.nullif(disp, F.lit(0.0)), F.lit(1.0)))
    w = Window.partitionBy("k")
    return g.select("k", "col_id", (F.col("_w") / F.sum("_w").over(w) * F.count(F.lit(1)).over(w)).alias("weight"))


def score_correlation_pairs(scores: DataFrame, cutoff: float = 0.9) -> DataFrame:
    """Cluster pairs whose scores correlate over the rows."""
    return tiles.column_correlations(scores, "row_id", "k", "score").where(F.col("r") >= cutoff).select("a", "b", "r")


def scores_by_source(sources: Mapping[str, DataFrame], axis: str = "row_id") -> DataFrame:
    """Long (id, k, source, score) with sources named ``family.name``."""
    out = None
    for name, df in sources.items():
        part = df.select(axis, "k", F.lit(name).alias("source"), "score")
        out = part if out is None else out.unionByName(part)
    return out


def pivot_sources(long: DataFrame, names: list[str], axis: str = "row_id") -> DataFrame:
    return long.groupBy(axis, "k").pivot("source", names).agg(F.first("score"))


def collapse_families(long: DataFrame, axis: str = "row_id") -> DataFrame:
    """One score per family: sources of a family are summed."""
    return long.groupBy(axis, "k", F.split_part("source", F.lit("."), F.lit(1)).alias("family")).agg(F.sum("score").alias("score"))


KERNEL_CELLS = 1_000_000  # centroid cells sent to the tasks in one pass


def row_scores_packed(vectors: DataFrame, axis: DataFrame, m: DataFrame, row_member: DataFrame, col_member: DataFrame, n_clusters: int = 0, kernel_cells: int = KERNEL_CELLS) -> DataFrame:
    """``row_scores`` from packed row vectors: no shuffle of the matrix.

    Clusters are dealt into blocks of about ``kernel_cells`` centroid cells (a cluster has one per column at most), and each
    block is one pass over the vectors, so neither driver nor task holds more than a block. With ``n_clusters`` every row
    gets a record for each of the clusters 1..n and for no other, NULL where nothing was measured.
    """
    import numpy as np
    import pandas as pd
    from pyspark.sql import types as T

    spark = m.sparkSession
    kind = row_member.schema["k"].dataType
    cells = col_member.join(centroids(m, row_member), ["k", "col_id"]).join(axis, "col_id").select(F.col("k").cast(kind).alias("k"), "ci", "mu")
    if n_clusters:
        cells = spark.range(1, n_clusters + 1).select(F.col("id").cast(kind).alias("k")).join(cells, "k", "left")
    cells = materialize(cells, "centroids")
    blocks = max(1, -(-cells.count() // kernel_cells))
    cell = F.when(F.col("ci").isNotNull(), F.struct("ci", "mu"))
    packed = cells.groupBy("k").agg(F.sort_array(F.collect_list(cell)).alias("c")).select("k", F.col("c.ci").alias("ci"), F.col("c.mu").alias("mu"))

    def scorer(plan):
        shared = spark.sparkContext.broadcast(plan)

        def score(batches):
            plan = shared.value
            ks = np.array([k for k, _, _ in plan])
            for pdf in batches:
                x = np.stack(pdf["vec"].to_numpy()).astype(float)
                out = np.empty((len(x), len(plan)))
                for j, (_, ci, mu) in enumerate(plan):
                    d = x[:, ci] - mu
                    d *= d
                    ok = np.isfinite(d)
                    with np.errstate(all="ignore"):
                        out[:, j] = np.where(ok, d, 0.0).sum(axis=1) / ok.sum(axis=1)
                res = pd.DataFrame({"row_id": np.repeat(pdf["row_id"].to_numpy(), len(plan)), "k": np.tile(ks, len(x)), "score": np.log(out + 1e-99).ravel()})
                yield res if n_clusters else res[np.isfinite(res["score"].to_numpy())]

        return score

    schema = T.StructType([vectors.schema["row_id"], T.StructField("k", kind), T.StructField("score", T.DoubleType())])
    out = None
    for b in range(blocks):
        rows = packed.where(F.pmod(F.xxhash64("k"), F.lit(blocks)) == b).collect()
        if rows or out is None:
            plan = [(r["k"], np.array(r["ci"], dtype=int), np.array(r["mu"], dtype=float)) for r in sorted(rows, key=lambda r: r["k"])]
            part = vectors.mapInPandas(scorer(plan), schema)
            out = part if out is None else out.unionByName(part)
    return out.withColumn("score", F.nanvl("score", F.lit(None).cast("double")))
