"""Cluster tables: residuals, motif p-values, summaries, run statistics, histograms."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions.order import trimmed_mean
from tessella.operators.matrix import row_variance_mean


def _cells(m: DataFrame, row_member: DataFrame, col_member: DataFrame | None, outside: bool = False) -> DataFrame:
    cells = m.join(row_member.select("k", "row_id"), "row_id")
    if col_member is None:
        return cells
    return cells.join(col_member.select("k", "col_id"), ["k", "col_id"], "left_anti" if outside else "left_semi")


def residual(
    m: DataFrame, row_member: DataFrame, col_member: DataFrame, keys: Sequence[str] = (), outside: bool = False,
    var_norm: bool = False,
) -> DataFrame:
    """(keys, k, nrows, ncols, resid): mean |x - row mean - column mean + mean of row means|.

    1 when fewer than two rows or columns remain or over 95% of the block is missing. Row means come
    from a window over one row's cells (bounded by the columns); column and cluster means are
    map-side combined aggregates of the same shuffled frame.
    """
    by = [*keys, "k"]
    cells = _cells(m, row_member, col_member, outside)
    w = Window.partitionBy(*by, "row_id")
    cells = cells.withColumn("_rm", F.avg("value").over(w)).withColumn("_nr", F.count("value").over(w))
    if var_norm:
        cells = cells.withColumn("_rv", F.var_samp("value").over(w))
    per_row = 1 / F.col("_nr")
    aggs = [(F.sum(F.col("_rm") * per_row) / F.sum(per_row)).alias("_all"), F.round(F.sum(per_row)).cast("long").alias("nrows"), F.count("value").alias("_n")]
    if var_norm:
        aggs.append((F.sum(F.col("_rv") * per_row) / F.sum(F.when(F.col("_rv").isNotNull(), per_row))).alias("_var"))
    whole = cells.groupBy(*by).agg(*aggs)
    cols = cells.groupBy(*by, "col_id").agg(F.avg("value").alias("_cm"))
    width = cols.groupBy(*by).agg(F.count(F.lit(1)).alias("ncols"))
    # |x - rm - cm + all| needs the cluster mean before the absolute value
    dev = cells.join(cols, [*by, "col_id"]).join(whole.select(*by, "_all"), by).groupBy(*by).agg(
        F.avg(F.abs(F.col("value") - F.col("_rm") - F.col("_cm") + F.col("_all"))).alias("_r"))
    out = whole.join(width, by).join(dev, by)
    r = F.col("_r")
    if var_norm:
        top = row_variance_mean(m).select("max_row_var").scalar()
        r = r / F.least(F.coalesce("_var", top), top)
    poor = (F.col("nrows") <= 1) | (F.col("ncols") <= 1) | (1 - F.col("_n") / (F.col("nrows") * F.col("ncols")) > 0.95)
    return out.select(*by, "nrows", "ncols", F.when(poor, 1.0).otherwise(r).alias("resid"))


def combined_residual(resid: DataFrame, weights: Mapping[str, float]) -> DataFrame:
    """Row-weight mean of the per-matrix residuals."""
    w = F.coalesce(*[F.when(F.col("mat") == n, F.lit(float(v))) for n, v in weights.items()], F.lit(0.0))
    return resid.groupBy("k").agg((F.sum(w * F.col("resid")) / F.sum(w)).alias("resid"))


def motif_pvalue(hits: DataFrame, row_member: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Mean log10 p over the member rows."""
    best = hits.groupBy(*keys, "k", "row_id").agg(F.min("pvalue").alias("p"))
    return best.join(row_member, ["k", "row_id"], "left_semi").groupBy(*keys, "k").agg(F.avg(F.log10("p")).alias("pclust"))


def weighted_by_source(df: DataFrame, source: str, value: str, weights: Mapping[str, float]) -> DataFrame:
    """Weight mean over sources that have a value."""
    w = F.coalesce(*[F.when(F.col(source) == n, F.lit(float(v))) for n, v in weights.items()], F.lit(0.0))
    w = F.when(F.col(value).isNotNull(), w)
    return df.groupBy("k").agg((F.sum(w * F.col(value)) / F.sum(w)).alias(value))


def cluster_table(m: DataFrame, row_member: DataFrame, col_member: DataFrame, hits: DataFrame | None = None, motifs: DataFrame | None = None) -> DataFrame:
    """One record per cluster: sizes, residual, motif p-value and E-values."""
    rows = row_member.join(m.select("row_id").distinct(), "row_id", "left_semi").groupBy("k").agg(F.count(F.lit(1)).alias("nrows"))
    cols = col_member.join(m.select("col_id").distinct(), "col_id", "left_semi").groupBy("k").agg(F.count(F.lit(1)).alias("ncols"))
    out = rows.join(cols, "k", "full").join(residual(m, row_member, col_member).select("k", "resid"), "k", "left")
    out = out.select("k", F.coalesce("nrows", F.lit(0)).alias("nrows"), F.coalesce("ncols", F.lit(0)).alias("ncols"), "resid")
    if hits is not None:
        out = out.join(motif_pvalue(hits, row_member), "k", "left")
    if motifs is not None:
        ev = motifs.groupBy("k").agg(F.min(F.when(F.col("mot") == 1, F.col("e_value"))).alias("e_value1"), F.min(F.when(F.col("mot") == 2, F.col("e_value"))).alias("e_value2"))
        out = out.join(ev, "k", "left")
    return out


def cluster_summary(
    row_score: DataFrame, row_member: DataFrame, resid: DataFrame, mot: DataFrame | None = None, net: DataFrame | None = None,
    scaling: tuple[float, float, float] = (1.0, 1.0, 1.0), consensus: DataFrame | None = None, trim: float = 0.01, compat: bool = False,
) -> DataFrame:
    """Weighted trimmed-mean score per cluster with size, residual and consensus strings.

    ``compat`` drops the network term whenever motif scores exist.
    """
    out = row_member.groupBy("k").agg(F.count(F.lit(1)).alias("nrow"))
    total: Column = F.lit(0.0)
    every, tags = None, []
    for tag, df, w in (("r", row_score, scaling[0]), ("m", mot, scaling[1]), ("n", net, scaling[2])):
        if df is None or (compat and tag == "n" and mot is not None):
            continue
        inside = row_member.select("k", "row_id").join(df, ["row_id", "k"], "left").withColumn("score", F.coalesce("score", F.lit(0.0)) if tag != "r" else F.col("score"))
        part = inside.select("k", F.lit(tag).alias("_f"), "row_id", "score")
        every = part if every is None else every.unionByName(part)
        tags.append((tag, w))
    means = trimmed_mean(every, ["k", "_f"], "score", trim, ["row_id"], "_t")  # one sort for all families
    for tag, w in tags:
        total = total + F.coalesce(F.col(f"_{tag}"), F.lit(0.0)) * float(w)
    out = out.join(means.groupBy("k").agg(*[F.max(F.when(F.col("_f") == tag, F.col("_t"))).alias(f"_{tag}") for tag, _ in tags]), "k", "left")
    out = out.join(resid.select("k", "resid"), "k", "left").select("k", "nrow", total.alias("score"), "resid")
    if consensus is not None:
        pick = lambda i, c: F.max(F.when(F.col("mot") == i, F.col(c)))
        cons = consensus.groupBy("k").agg(pick(1, "consensus").alias("consensus1"), pick(1, "e_value").alias("e_value1"), pick(2, "consensus").alias("consensus2"), pick(2, "e_value").alias("e_value2"))
        out = out.join(cons, "k", "left").select(
            "k", "nrow", "score", "resid", F.coalesce("consensus1", F.lit("")).alias("consensus1"), F.coalesce("e_value1", F.lit(float("inf"))).alias("e_value1"),
            F.coalesce("consensus2", F.lit("")).alias("consensus2"), F.coalesce("e_value2", F.lit(float("inf"))).alias("e_value2"))
    return out


def size_adjusted_score(summary: DataFrame, e_cutoff: float | None = None, nrow_cutoff: int | None = 5) -> DataFrame:
    """score - trend(nrow) + residual; the trend is the least-squares line of score on size."""
    fit = summary.agg(F.regr_slope("score", "nrow").alias("b"), F.regr_intercept("score", "nrow").alias("a"))
    trend = fit.select("a").scalar() + fit.select("b").scalar() * F.col("nrow")
    out = summary.withColumn("score_norm", F.col("score") - trend + F.col("resid"))
    if nrow_cutoff is not None:
        out = out.where(F.col("nrow") >= nrow_cutoff)
    if e_cutoff is not None and "e_value1" in summary.columns:
        out = out.where((F.col("e_value1") <= e_cutoff) | (F.col("e_value2") <= e_cutoff))
    return out


def run_stats(
    iteration: int, row_score: DataFrame, row_member: DataFrame, col_score: DataFrame, col_member: DataFrame, table: DataFrame,
    mot: DataFrame | None = None, net: DataFrame | None = None,
) -> DataFrame:
    """One record: mean in-cluster scores, mean residual below 1, mean sizes, mean motif p-value."""

    def inside(df: DataFrame, member: DataFrame, axis: str, name: str, missing: float | None = None) -> DataFrame:
        j = member.select("k", axis).join(df, [axis, "k"], "left")
        s = F.col("score") if missing is None else F.coalesce("score", F.lit(missing))
        return j.agg(F.avg(s).alias(name))

    cols = [inside(row_score, row_member, "row_id", "row_scores").scalar().alias("row_scores"),
            inside(col_score, col_member, "col_id", "col_scores").scalar().alias("col_scores")]
    cols.append((inside(mot, row_member, "row_id", "s", 0.0).scalar() if mot is not None else F.lit(None).cast("double")).alias("mot_scores"))
    cols.append((inside(net, row_member, "row_id", "s", 0.0).scalar() if net is not None else F.lit(None).cast("double")).alias("net_scores"))
    base = table.agg(
        F.avg(F.when(F.col("resid") != 1.0, F.col("resid"))).alias("resid"), F.avg("nrows").alias("nrow"), F.avg("ncols").alias("ncol"),
        (F.avg("pclust") if "pclust" in table.columns else F.lit(None).cast("double")).alias("pclust"))
    return base.select(F.lit(iteration).alias("iter"), *cols, "resid", "nrow", "ncol", "pclust")


def stats_by_source(values: DataFrame, source: str, value: str, prefix: str, names: Sequence[str], weight: str | None = None) -> DataFrame:
    """One wide record: ``prefix.name`` = (weighted) mean over clusters for every named source."""
    val = F.col(value)
    aggs = []
    for n in names:
        hit = F.col(source) == n
        mean = F.avg(F.when(hit, val)) if weight is None else F.sum(F.when(hit, val * F.col(weight))) / F.sum(F.when(hit & val.isNotNull(), F.col(weight)))
        aggs.append(mean.alias(f"{prefix}_{n}"))
    return values.agg(*aggs)


def cluster_network_scores(scores: DataFrame, row_member: DataFrame, trim: float = 0.05) -> DataFrame:
    """Trimmed mean network score per source and cluster; a missing score of a member counts as 0."""
    nets = scores.select("net").distinct().agg(F.sort_array(F.collect_list("net")).alias("n")).scalar()
    grid = row_member.select("k", "row_id", F.explode(nets).alias("net"))
    full = grid.join(scores, ["net", "k", "row_id"], "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
    return trimmed_mean(full, ["net", "k"], "score", trim, ["row_id"], "score")


def members(member: DataFrame, universe: DataFrame, ks: DataFrame, axis: str) -> DataFrame:
    """Members of every cluster; a cluster without columns gets all of them."""
    empty = ks.select("k").distinct().join(member.select("k").distinct(), "k", "left_anti")
    none = empty.agg(F.collect_list("k").alias("k")).scalar()
    filler = universe.select(axis).distinct().select(F.explode(none).alias("k"), axis)
    return member.select("k", axis).unionByName(filler)


def membership_histogram(row_member: DataFrame, universe: DataFrame) -> DataFrame:
    """Number of rows by the number of clusters they are in, zero included."""
    per = row_member.groupBy("row_id").agg(F.count(F.lit(1)).alias("_c"))
    full = universe.select("row_id").distinct().join(per, "row_id", "left")
    return full.groupBy(F.coalesce("_c", F.lit(0)).alias("n_clusters")).agg(F.count(F.lit(1)).alias("n_rows"))


def score_histogram(scores: DataFrame, member: DataFrame, n_bins: int, axis: str = "row_id") -> DataFrame:
    """Equal-width bins of the scores of every cluster, split by membership."""
    rng = scores.groupBy("k").agg(F.min("score").alias("_lo"), F.max("score").alias("_hi"))
    tagged = scores.join(member.select("k", axis).withColumn("_in", F.lit(True)), ["k", axis], "left").join(rng, "k")
    width = (F.col("_hi") - F.col("_lo")) / n_bins
    b = F.when(width == 0, F.lit(1)).otherwise(F.least(F.floor((F.col("score") - F.col("_lo")) / width) + 1, F.lit(n_bins)))
    return tagged.groupBy("k", b.cast("int").alias("bin"), F.coalesce("_in", F.lit(False)).alias("inside")).agg(F.count(F.lit(1)).alias("n"))


def cluster_loglik(density: DataFrame, member: DataFrame) -> DataFrame:
    """sum ln(density inside) + ln(1 - density outside)."""
    j = density.join(member.select("k", "row_id").withColumn("_in", F.lit(1)), ["k", "row_id"], "left")
    term = F.log(F.when(F.col("_in").isNotNull(), F.col("score")).otherwise(1 - F.col("score")) + 1e-99)
    return j.groupBy("k").agg(F.sum(term).alias("loglik"))


def favourite_cluster(counts: DataFrame, count_col: str) -> DataFrame:
    """Cluster with the largest count, smallest number on ties."""
    return counts.agg(F.max_by("k", F.struct(F.col(count_col), -F.col("k"))).alias("k"), F.max(count_col).alias(count_col))


def operon_lists(operons: DataFrame, max_items: int = 10_000) -> DataFrame:
    """Genes per operon head; a head with more than ``max_items`` genes continues in further parts."""
    from tessella.functions.order import indexed

    idx = indexed(operons.select("head", "row_id").distinct(), ["head"], ["row_id"], "_p")
    return idx.groupBy("head", F.floor((F.col("_p") - 1) / max_items).cast("int").alias("part")).agg(F.sort_array(F.collect_list("row_id")).alias("genes"))
