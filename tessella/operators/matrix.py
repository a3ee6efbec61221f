"""Value-matrix cleaning, normalisation and restriction.

A matrix is long form ``(row_id, col_id, value)``; an absent row is a missing cell. One row holds at
most one cell per column, so windows over ``row_id`` are bounded by the column axis.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions.order import indexed


def axis_size(m: DataFrame, axis: str) -> Column:
    """Number of distinct ids on an axis as a scalar subquery."""
    return m.select(axis).distinct().agg(F.count(F.lit(1)).alias("n")).scalar()


def dedupe_rows(df: DataFrame, row_id: str, position: str, cols: Sequence[str]) -> DataFrame:
    """First record per id by position; ``min_by`` combines map-side, so a repeated id is no hot spot."""
    return df.groupBy(row_id).agg(*[F.min_by(F.struct(c), position)[c].alias(c) for c in cols])


def filter_unchanged(m: DataFrame, row_eps: float = 0.17, col_eps: float = 0.1, frac: float = 0.98) -> DataFrame:
    """Drop rows and columns that are missing or near zero almost everywhere.

    Both axes are judged on the unfiltered matrix. Missing cells count as unchanged.
    """

    def keep(axis: str, other: str, eps: float) -> DataFrame:
        total = axis_size(m, other)
        moved = m.groupBy(axis).agg(F.count(F.when(F.abs("value") > eps, 1)).alias("_n"))
        return moved.where((total - F.col("_n")) / total < frac).select(axis)

    rows, cols = keep("row_id", "col_id", row_eps), keep("col_id", "row_id", col_eps)
    return m.join(cols, "col_id", "left_semi").join(rows, "row_id", "left_semi")


def zscore_rows(m: DataFrame, col_groups: DataFrame | None = None) -> DataFrame:
    """(x - median) / sd per row and column group."""
    src = m.join(col_groups, "col_id") if col_groups is not None else m.withColumn("grp", F.lit(1))
    w = Window.partitionBy("row_id", "grp")
    z = (F.col("value") - F.percentile("value", 0.5).over(w)) / F.nullif(F.stddev_samp("value").over(w), F.lit(0.0))
    return src.withColumn("value", z).drop("grp")


def mean_variance_normalize(m: DataFrame, min_complete: float | None = 0.04, by_cols: bool = False) -> DataFrame:
    """(x - mean) / sd by row (a zero or missing sd counts as 1) or by column."""
    if min_complete is not None:
        n_cols = axis_size(m, "col_id")
        full = m.groupBy("row_id").agg(F.count("value").alias("_n")).where(F.col("_n") / n_cols >= min_complete)
        m = m.join(full, "row_id", "left_semi")
    if by_cols:
        mom = m.groupBy("col_id").agg(F.avg("value").alias("_m"), F.stddev_samp("value").alias("_s"))
        return m.join(mom, "col_id").select(*m.columns[:-1], ((F.col("value") - F.col("_m")) / F.nullif("_s", F.lit(0.0))).alias("value"))
    w = Window.partitionBy("row_id")
    sd = F.coalesce(F.nullif(F.stddev_samp("value").over(w), F.lit(0.0)), F.lit(1.0))
    return m.withColumn("value", (F.col("value") - F.avg("value").over(w)) / sd)


def filter_small_change(m: DataFrame, frac: float = 0.1) -> DataFrame:
    """Keep rows where at least ``frac`` of the cells change two-fold (values are log2)."""
    big = F.when((F.pow(F.lit(2.0), "value") < 0.5) | (F.pow(F.lit(2.0), "value") > 2), 1.0).otherwise(0.0)
    keep = m.groupBy("row_id").agg(F.avg(big).alias("_f")).where(F.col("_f") >= frac)
    return m.join(keep, "row_id", "left_semi")


def clip(m: DataFrame, cutoff: float, col: str = "value") -> DataFrame:
    return m.withColumn(col, F.greatest(F.least(F.col(col), F.lit(float(cutoff))), F.lit(-float(cutoff))))


def overlay_matrices(m: DataFrame, mats: Sequence[str]) -> DataFrame:
    """One matrix from many; a later matrix in ``mats`` overwrites an earlier one cell by cell."""
    rank = F.array_position(F.array(*[F.lit(x) for x in mats]), F.col("mat"))
    return m.where(F.col("mat").isin(*mats) & F.col("value").isNotNull()).groupBy("row_id", "col_id").agg(
        F.max_by("value", rank).alias("value"))


def row_variance_mean(m: DataFrame) -> DataFrame:
    return m.groupBy("row_id").agg(F.var_samp("value").alias("_v")).agg(F.avg("_v").alias("max_row_var"))


def column_variances(m: DataFrame) -> DataFrame:
    return m.groupBy("col_id").agg(F.var_samp("value").alias("col_var"))


def condition_groups(cols: DataFrame, name: str = "col_id", sep: str = "__") -> DataFrame:
    """Group number of each column from the part of its name before ``sep``."""
    named = cols.select(name).distinct().withColumn("prefix", F.split_part(F.col(name).cast("string"), F.lit(sep), F.lit(1)))
    numbered = indexed(named.select("prefix").distinct(), [], ["prefix"], "grp")
    return named.join(numbered, "prefix").select(name, "prefix", F.col("grp").cast("int").alias("grp"))


def submatrix(m: DataFrame, rows: DataFrame | None = None, cols: DataFrame | None = None) -> DataFrame:
    if cols is not None:
        m = m.join(cols.select("col_id").distinct(), "col_id", "left_semi")
    if rows is not None:
        m = m.join(rows.select("row_id").distinct(), "row_id", "left_semi")
    return m


def sort_columns_by_time(cols: DataFrame, col_meta: DataFrame) -> DataFrame:
    """Columns with metadata in time order; unmatched columns are dropped."""
    return indexed(cols.select("col_id").distinct().join(col_meta.select("col_id", "time"), "col_id"), [], ["time", "col_id"], "ord")


def low_variance_predictors(m: DataFrame, cutoff: float = 0.01) -> DataFrame:
    """Keep predictors whose variance exceeds ``cutoff``; missing cells of kept ones become 0."""
    keep = m.groupBy("row_id").agg(F.var_samp("value").alias("_v")).where(F.col("_v") > cutoff)
    return m.join(keep, "row_id", "left_semi").withColumn("value", F.coalesce("value", F.lit(0.0)))


def positive_negative_split(pairs: DataFrame, key: str, item: str, corr: str, top: int, share: float) -> DataFrame:
    """Per key: the top ``share`` of ``top`` items by correlation and the rest from the bottom."""
    n_up, n_down = round(top * share), round(top * (1 - share))
    up = Window.partitionBy(key).orderBy(F.col(corr).desc(), F.col(item))
    down = Window.partitionBy(key).orderBy(F.col(corr).asc(), F.col(item))
    best = pairs.withColumn("rn", F.row_number().over(up)).where(F.col("rn") <= n_up).withColumn("side", F.lit("pos"))
    worst = pairs.withColumn("rn", F.row_number().over(down)).where(F.col("rn") <= n_down).withColumn("side", F.lit("neg"))
    return best.unionByName(worst)


def annotation_matrix(ids: DataFrame, pattern: str, id_col: str = "id") -> DataFrame:
    """Matrix without measurements: one empty column over the annotated ids that match the pattern."""
    return ids.where(F.col(id_col).rlike(pattern)).select(F.col(id_col).alias("row_id")).distinct().select(
        "row_id", F.lit(1).alias("col_id"), F.lit(None).cast("double").alias("value"))
