"""Queries over value matrices: cleaning, normalisation, restriction."""

from pyspark.sql import functions as F

from tessella.functions.order import carry_forward, previous_row
from tessella.operators import matrix as mx
from tessella.plans import tables as t
from tessella.plans.registry import query
from tessella.plans.tables import sql


def r6(*names):
    return [F.round(n, 6).alias(n) for n in names]


@query("dedupe_rows", "select row_id, value, ord from (select l_partkey as row_id, l_extendedprice as value, l_orderkey * 100 + l_linenumber as ord, row_number() over (partition by l_partkey order by l_orderkey * 100 + l_linenumber, l_extendedprice) as rn from lineitem) where rn = 1")
def dedupe_rows(spark, sf):
    li = t.read(spark, sf, "lineitem").select(
        F.col("l_partkey").alias("row_id"), F.col("l_extendedprice").alias("value"), (F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("ord"))
    return mx.dedupe_rows(li.withColumn("_o", F.struct("ord", "value")), "row_id", "_o", ["value", "ord"])


@query("filter_unchanged", sql("sparse", """
, shifted as (select row_id, col_id, value - (select avg(value) from sparse) as value from sparse),
nr as (select count(distinct row_id) n from shifted), nc as (select count(distinct col_id) n from shifted),
kr as (select row_id from shifted group by 1 having ((select n from nc) - count(*) filter (where abs(value) > 0.17)) / (select n from nc)::double < 0.5),
kc as (select col_id from shifted group by 1 having ((select n from nr) - count(*) filter (where abs(value) > 0.1)) / (select n from nr)::double < 0.5)
select row_id, col_id, round(value, 6) as value from shifted where row_id in (select row_id from kr) and col_id in (select col_id from kc)"""))
def filter_unchanged(spark, sf):
    m = t.sparse(spark, sf)
    m = m.withColumn("value", F.col("value") - m.agg(F.avg("value").alias("a")).scalar())
    return mx.filter_unchanged(m, frac=0.5).select("row_id", "col_id", *r6("value"))


@query("zscore_rows", sql("sparse", """
select s.row_id, s.col_id, round((s.value - g.md) / nullif(g.sd, 0), 6) as value from sparse s join
(select row_id, col_id // 4 as grp, quantile_cont(value, 0.5) as md, stddev_samp(value) as sd from sparse group by 1, 2) g
on s.row_id = g.row_id and s.col_id // 4 = g.grp"""))
def zscore_rows(spark, sf):
    m = t.sparse(spark, sf)
    grp = m.select("col_id").distinct().withColumn("grp", F.floor(F.col("col_id") / 4))
    return mx.zscore_rows(m, grp).select("row_id", "col_id", *r6("value"))


@query("mean_variance_normalize", sql("sparse", """
, good as (select row_id, avg(value) m, coalesce(nullif(stddev_samp(value), 0), 1) s from sparse group by 1 having count(*) / (select count(distinct col_id)::double from sparse) >= 0.5)
select row_id, col_id, round((value - m) / s, 6) as value from sparse join good using (row_id)"""))
def mean_variance_normalize(spark, sf):
    return mx.mean_variance_normalize(t.sparse(spark, sf), 0.5).select("row_id", "col_id", *r6("value"))


@query("mean_variance_normalize_cols", sql("sparse", """
select row_id, col_id, round((value - m) / nullif(s, 0), 6) as value from sparse join (select col_id, avg(value) m, stddev_samp(value) s from sparse group by 1) using (col_id)"""))
def mean_variance_normalize_cols(spark, sf):
    return mx.mean_variance_normalize(t.sparse(spark, sf), None, by_cols=True).select("row_id", "col_id", *r6("value"))


@query("filter_small_change", sql("dense", """
, x as (select row_id, col_id, value * 6 as value from dense)
select row_id, col_id, round(value, 6) as value from x where row_id in (select row_id from x group by 1 having avg(case when pow(2.0, value) < 0.5 or pow(2.0, value) > 2 then 1.0 else 0.0 end) >= 0.2)"""))
def filter_small_change(spark, sf):
    m = t.dense(spark, sf).withColumn("value", F.col("value") * 6)
    return mx.filter_small_change(m, 0.2).select("row_id", "col_id", *r6("value"))


@query("clip", sql("dense", "select row_id, col_id, round(greatest(least(value, 0.1), -0.1), 6) as value from dense"))
def clip(spark, sf):
    return mx.clip(t.dense(spark, sf), 0.1).select("row_id", "col_id", *r6("value"))


@query("overlay_matrices", sql("multi", """
select row_id, col_id, round(arg_max(value, list_position(['R', 'A', 'N'], mat)), 6) as value from multi group by 1, 2"""))
def overlay_matrices(spark, sf):
    return mx.overlay_matrices(t.multi(spark, sf), ["R", "A", "N"]).select("row_id", "col_id", *r6("value"))


@query("row_variance_mean", sql("sparse", "select round(avg(v), 6) as max_row_var from (select var_samp(value) v from sparse group by row_id)"))
def row_variance_mean(spark, sf):
    return mx.row_variance_mean(t.sparse(spark, sf)).select(*r6("max_row_var"))


@query("column_variances", sql("sparse", "select col_id, round(var_samp(value), 6) as col_var from sparse group by 1"))
def column_variances(spark, sf):
    return mx.column_variances(t.sparse(spark, sf)).select("col_id", *r6("col_var"))


@query("condition_groups", """select name, split_part(name, '__', 1) as prefix, dense_rank() over (order by split_part(name, '__', 1))::int as grp
from (select distinct l_returnflag || l_linestatus || '__' || l_linenumber as name from lineitem)""")
def condition_groups(spark, sf):
    li = t.read(spark, sf, "lineitem").select(F.concat("l_returnflag", "l_linestatus", F.lit("__"), F.col("l_linenumber").cast("string")).alias("name"))
    return mx.condition_groups(li, "name")


@query("submatrix", sql("sparse sparse_rows sparse_cols", """
select row_id, col_id, round(value, 6) as value from sparse where row_id in (select row_id from sparse_rows where k = 7) and col_id in (select col_id from sparse_cols where k = 7)"""))
def submatrix(spark, sf):
    rows, cols = t.sparse_rows(spark, sf).where("k = 7"), t.sparse_cols(spark, sf).where("k = 7")
    return mx.submatrix(t.sparse(spark, sf), rows, cols).select("row_id", "col_id", *r6("value"))


@query("sort_columns_by_time", sql("sparse", """
select col_id, cast(col_id % 7 as double) as "time", row_number() over (order by col_id % 7, col_id) as ord from (select distinct col_id from sparse)"""))
def sort_columns_by_time(spark, sf):
    m = t.sparse(spark, sf)
    meta = m.select("col_id").distinct().withColumn("time", (F.col("col_id") % 7).cast("double"))
    return mx.sort_columns_by_time(m, meta)


@query("low_variance_predictors", sql("sparse", """
select row_id, col_id, round(coalesce(value, 0), 6) as value from sparse where row_id in (select row_id from sparse group by 1 having var_samp(value) > 0.01)"""))
def low_variance_predictors(spark, sf):
    return mx.low_variance_predictors(t.sparse(spark, sf)).select("row_id", "col_id", *r6("value"))


@query("annotation_matrix", "select distinct p_name as row_id, 1 as col_id, null::double as value from part where regexp_matches(p_name, '^s.*')")
def annotation_matrix(spark, sf):
    return mx.annotation_matrix(t.read(spark, sf, "part").select(F.col("p_name").alias("id")), "^s.*")


@query("forward_fill", """select conv_id, turn, last_value(v ignore nulls) over (partition by conv_id order by turn rows between unbounded preceding and current row) as filled
from (select conv_id, turn, case when turn % 2 = 0 then role || turn end as v from conversations)""")
def forward_fill(spark, sf):
    c = t.read(spark, sf, "conversations").select("conv_id", "turn", "role")
    v = F.when(F.col("turn") % 2 == 0, F.concat("role", F.col("turn").cast("string")))
    return carry_forward(c, ["conv_id"], ["turn"], v, "filled").select("conv_id", "turn", "filled")


@query("previous_time_point", sql("series", """select series, "time", round(value, 6) as value, lag("time") over (partition by series order by "time") as prev_col,
round(lag(value) over (partition by series order by "time"), 6) as prev_value from series"""))
def previous_time_point(spark, sf):
    out = previous_row(t.series(spark, sf), ["series"], ["time"], {"time": "prev_col", "value": "prev_value"})
    return out.select("series", "time", "prev_col", *r6("value", "prev_value"))
