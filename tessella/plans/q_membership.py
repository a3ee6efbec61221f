"""Queries for score combination, membership rules and seeding."""

from pyspark.sql import functions as F

from tessella.functions import order as od
from tessella.functions.chance import draw_sql as draw
from tessella.operators import combine as cb
from tessella.operators import enrich as en
from tessella.operators import membership as mb
from tessella.operators import scores as sc
from tessella.operators import seeding as sd
from tessella.plans import tables as t
from tessella.plans.q_matrix import r6
from tessella.plans.q_scores import NET, exact_null
from tessella.plans.registry import query
from tessella.plans.tables import sql
from tessella.session import materialize, spread


def sparse_scores(spark, sf):
    return sc.row_scores(t.sparse(spark, sf), t.sparse_rows(spark, sf), t.sparse_cols(spark, sf))


def dense_scores(spark, sf):
    return sc.row_scores(t.dense(spark, sf), t.dense_rows(spark, sf), t.dense_cols(spark, sf))


COMB = NET + """, f1 as (select row_id, k, case when score < -20 then (select min(score) from row_score where score >= -20) else score end r from row_score),
ins as (select r from f1 join sparse_rows using (row_id, k)), md as (select quantile_cont(r, 0.5) m from ins), sd as (select quantile_cont(abs(r - m), 0.5) * 1.4826::double s from ins, md),
f2 as (select row_id, k, (r - m) / s r from f1, md, sd), f3 as (select row_id, k, case when r < -20 then (select min(r) from f2 where r >= -20) else r end r from f2),
w as (select f3.row_id, f3.k, r, coalesce(case when ln(h.pvalue) < -20 then -20 else ln(h.pvalue) end, 0) m, coalesce(n.score, 0) n from f3 left join hits h on h.row_id = f3.row_id and h.k = f3.k and h.k in (select k from sz where n > 1) left join nscore n on n.net = 'order' and n.row_id = f3.row_id and n.k = f3.k),
q as (select abs(quantile_cont(r, 0.01)) rq, quantile_cont(m, 0.99) mh, abs(quantile_cont(m, 0.01) - quantile_cont(m, 0.99)) ms, quantile_cont(n, 0.99) nh, abs(quantile_cont(n, 0.01) - quantile_cont(n, 0.99)) ns from w)
select row_id, k, round(r + (m - mh) / ms * rq * 0.5::double + (n - nh) / ns * rq * 0.25::double, 5) as score from w, q"""


@query("combine_scores", sql("row_score hits edges sparse_rows", COMB))
def combine_scores(spark, sf):
    r = t.sparse_rows(spark, sf)
    out = cb.combine_scores(sparse_scores(spark, sf), r, sc.motif_scores(t.hits(spark, sf), r), sc.network_scores(t.edges(spark, sf).where("net = 'order'"), r), (1.0, 0.5, 0.25))
    return out.select("row_id", "k", F.round("score", 5).alias("score"))


QN = """, s as (select 'a' as "set", row_id, k, score from dense_score union all select 'b', row_id, k, score * score from dense_score),
p as (select *, row_number() over (partition by "set" order by score, row_id, k) as pos, rank() over (partition by "set" order by score) rk from s),
lv as (select pos, {level} as level from p group by 1) select "set", row_id, k, round(level, 6) as score from p join lv on lv.pos = p.rk"""


def _two_sets(spark, sf):
    s = dense_scores(spark, sf)
    return s.select(F.lit("a").alias("set"), "row_id", "k", "score").unionByName(s.select(F.lit("b").alias("set"), "row_id", "k", (F.col("score") * F.col("score")).alias("score")))


@query("quantile_normalize", sql("dense_score", QN.format(level="avg(score)")))
def quantile_normalize(spark, sf):
    return cb.quantile_normalize(_two_sets(spark, sf)).select("set", "row_id", "k", *r6("score"))


@query("quantile_normalize_weighted", sql("dense_score", QN.format(level="""avg(score * case "set" when 'a' then 2.0::double else 1.0::double end) / 3""")))
def quantile_normalize_weighted(spark, sf):
    return cb.quantile_normalize(_two_sets(spark, sf), {"a": 2.0, "b": 1.0}).select("set", "row_id", "k", *r6("score"))


@query("fuzz", sql("dense_score dense_rows", f", sd as (select stddev_samp(score) as s from dense_score join dense_rows using (k, row_id)) select row_id, k, round(score + sqrt(-2 * ln({draw('row_id', 'k', '10', '1', '11')})) * cos(2 * pi() * {draw('row_id', 'k', '10', '1', '29')}) * s * {cb.fuzz_index(10, 200)!r}::double, 6) as score from dense_score, sd"))
def fuzz(spark, sf):
    return cb.fuzz(dense_scores(spark, sf), t.dense_rows(spark, sf), cb.fuzz_index(10, 200), 10, 1).select("row_id", "k", *r6("score"))


@query("density_scores_rows")
def density_scores_rows(spark, sf):
    return cb.density_scores(dense_scores(spark, sf), t.dense_rows(spark, sf))


@query("density_scores_cols")
def density_scores_cols(spark, sf):
    return cb.density_scores(sc.col_scores(t.dense(spark, sf), t.dense_rows(spark, sf)), t.dense_cols(spark, sf), "col_id", rows=False)


@query("size_compensation", sql("dense_score dense_rows", """, n as (select k, count(*)::double n from dense_rows group by 1), a as (select count(distinct row_id)::double nr, count(distinct k)::double nk from dense_rows)
select row_id, k, round(score * exp(-greatest(coalesce(n, 0), 3) / (nr * 2 / nk)), 6) as score from dense_score left join n using (k), a"""))
def size_compensation(spark, sf):
    rows = t.dense_rows(spark, sf)
    n, k = rows.agg(F.countDistinct("row_id").alias("n")).scalar(), rows.agg(F.countDistinct("k").alias("n")).scalar()
    return cb.size_compensation(dense_scores(spark, sf), rows, "row_id", n, 2, k, 3).select("row_id", "k", *r6("score"))


@query("filter_membership", sql("dense_score dense_rows", ", i as (select k, row_id, score from dense_rows join dense_score using (k, row_id)) select k, row_id from i where score >= (select quantile_cont(score, 0.2) from i)"))
def filter_membership(spark, sf):
    return cb.filter_membership(dense_scores(spark, sf), t.dense_rows(spark, sf), 0.2)


ECDF = """, j as (select s.k, s.row_id, s.score, r.row_id is not null inn from dense_score s left join dense_rows r using (k, row_id)), m as (select k, score from j where inn), st as (select k, max(score) top, count(*) n from m group by 1)
select j.k, j.row_id, round(1 - ((select count(*) from m where m.k = j.k and m.score <= j.score) + (j.score >= top + 1e-5)::int) / (n + 1)::double, 6) as score from j join st using (k)"""


@query("ecdf_density", sql("dense_score dense_rows", ECDF))
def ecdf_density(spark, sf):
    return cb.ecdf_density(dense_scores(spark, sf), t.dense_rows(spark, sf)).select("k", "row_id", *r6("score"))


def part_clusters(spark, sf):
    li = t.read(spark, sf, "lineitem")
    return li.select((F.col("l_suppkey") % 25).cast("int").alias("k"), F.col("l_partkey").alias("row_id")).distinct()


def parts(spark, sf):
    return t.read(spark, sf, "part").select(F.col("p_partkey").alias("row_id"))


@query("membership_slots", """with m as (select distinct (l_suppkey % 25)::int as k, l_partkey as row_id from lineitem), l as (select p_partkey as row_id, coalesce(list(k order by k) filter (where k is not null), []) s from part left join m on row_id = p_partkey group by 1)
select row_id, list_concat(s, list_resize([]::int[], greatest(2 - len(s), 0), 0)) as slots from l""")
def membership_slots(spark, sf):
    return mb.membership_slots(part_clusters(spark, sf), parts(spark, sf), 2)


@query("slots_to_members", "select distinct (l_suppkey % 25)::int as k, l_partkey as row_id from lineitem where l_suppkey % 25 > 0")
def slots_to_members(spark, sf):
    return mb.slots_to_members(mb.membership_slots(part_clusters(spark, sf), parts(spark, sf), 2))


@query("top_clusters", sql("row_score", "select row_id, k, round(score, 6) as score, rank from (select *, row_number() over (partition by row_id order by score desc, k) as rank from row_score) where rank <= 2"))
def top_clusters(spark, sf):
    return mb.top_clusters(sparse_scores(spark, sf), 2).select("row_id", "k", *r6("score"), "rank")


@query("update_membership")
def update_membership(spark, sf):
    d = cb.density_scores(dense_scores(spark, sf), t.dense_rows(spark, sf))
    slots = mb.membership_slots(t.dense_rows(spark, sf), t.dense_rows(spark, sf), 2)
    return mb.update_membership(d, slots, 2, 0.5, 1, 1)


@query("merge_duplicates")
def merge_duplicates(spark, sf):
    near = t.sparse_rows(spark, sf).unionByName(t.sparse_rows(spark, sf).withColumn("k", F.when(F.col("row_id") % 3 == 0, F.col("k") % 5 + 1).otherwise(F.col("k")))).distinct()
    return mb.merge_duplicates(sparse_scores(spark, sf), near, cutoff=0.4)[0]


@query("reseed_small")
def reseed_small(spark, sf):
    rows = t.dense_rows(spark, sf).where("k <> 3")
    ks = t.dense_rows(spark, sf).select("k").distinct()
    return mb.reseed_small(t.dense(spark, sf), rows, ks, most=10_000)


@query("adjust_clusters")
def adjust_clusters(spark, sf):
    return mb.adjust_clusters(dense_scores(spark, sf), t.dense_rows(spark, sf), limit=1000, max_rows=10_000)


@query("adjust_clusters_shrink")
def adjust_clusters_shrink(spark, sf):
    ch = mb.adjust_clusters(dense_scores(spark, sf), t.dense_rows(spark, sf), limit=1000, expand_only=False, max_rows=10_000)
    return mb.apply_changes(t.dense_rows(spark, sf), ch)


@query("adjust_all")
def adjust_all(spark, sf):
    return mb.adjust_all(dense_scores(spark, sf), t.dense_rows(spark, sf), limit=1000, max_rows=10_000)


@query("global_greedy_membership", sql("row_score", "select k, row_id, round(score, 6) as score from (select *, row_number() over (order by score, row_id, k) rn from row_score) where rn <= 2 * (select count(distinct row_id) from row_score)"))
def global_greedy_membership(spark, sf):
    return mb.global_greedy_membership(sparse_scores(spark, sf), 2).select("k", "row_id", *r6("score"))


@query("sample_members")
def sample_members(spark, sf):
    p = cb.ecdf_density(dense_scores(spark, sf), t.dense_rows(spark, sf)).select("k", "row_id", "score")
    return mb.sample_members(p, t.dense_rows(spark, sf), 2, 10, 0.1, 5, 8.0, 1, 1)


@query("resplit_columns")
def resplit_columns(spark, sf):
    p = en.variance_pvalues(t.dense(spark, sf), t.dense_rows(spark, sf), exact_null(spark, sf))
    sizes = t.dense_rows(spark, sf).groupBy("k").agg(F.count(F.lit(1)).alias("nrows"))
    return mb.resplit_columns(p, sizes, 0.1)


SPLIT = """, p as (select k, col_id, var_samp(value) as p from dense join dense_rows using (row_id) group by 1, 2), sz as (select k, count(*) nrows from dense_rows group by 1),
x as (select *, row_number() over (partition by nrows order by p, k, col_id) pos, row_number() over (partition by k order by p, col_id) r from p join sz using (k)), c as (select nrows, count(*) n from sz group by 1),
ct as (select x.nrows, x.p cut from x join c using (nrows) where pos = n * 5), g as (select x.*, p < cut as ok, count(*) filter (where p < cut) over (partition by k) ng from x left join ct using (nrows))
select k, col_id from g where (ng > 2 and ok) or (ng <= 2 and r <= 2)"""


@query("resplit_columns_average", sql("dense dense_rows", SPLIT))
def resplit_columns_average(spark, sf):
    v = en.observed_variances(t.dense(spark, sf), t.dense_rows(spark, sf)).withColumnRenamed("var", "p")
    sizes = t.dense_rows(spark, sf).groupBy("k").agg(F.count(F.lit(1)).alias("nrows"))
    return mb.resplit_columns(v, sizes, ave_n=5)


@query("running_median", """with s as (select event_type, event_id, value, count(*) over w c, row_number() over (partition by event_type order by event_id) rn, count(*) over (partition by event_type) n, quantile_cont(value, 0.5) over w m from events window w as (partition by event_type order by event_id rows between 10 preceding and 10 following))
select event_type, event_id, round(m, 6) as med from s where rn > 10 and rn <= n - 10""")
def running_median(spark, sf):
    from pyspark.sql import Window

    ev = t.read(spark, sf, "events").select("event_type", "event_id", "value")
    halo = od.with_halo(ev, ["event_type"], ["event_id"], 10, 10, chunk=2048)
    w = Window.partitionBy("event_type", "_chunk").orderBy("_pos").rowsBetween(-10, 10)
    n = ev.groupBy("event_type").agg(F.count(F.lit(1)).alias("_n"))
    out = halo.withColumn("med", F.percentile("value", 0.5).over(w)).where("_own").join(n, "event_type")
    return out.where((F.col("_pos") > 10) & (F.col("_pos") <= F.col("_n") - 10)).select("event_type", "event_id", *r6("med"))


@query("sort_columns_by_cluster_mean", sql("dense dense_rows dense_cols", """, g as (select r.k, d.col_id, avg(value) m from dense d join dense_rows r using (row_id) group by 1, 2)
select g.k, g.col_id, c.k is not null as inside, row_number() over (partition by g.k order by (c.k is not null) desc, m, g.col_id) as ord from g left join dense_cols c on c.k = g.k and c.col_id = g.col_id"""))
def sort_columns_by_cluster_mean(spark, sf):
    g = t.dense(spark, sf).join(t.dense_rows(spark, sf), "row_id").groupBy("k", "col_id").agg(F.avg("value").alias("m"))
    j = g.join(t.dense_cols(spark, sf).withColumn("_i", F.lit(1)), ["k", "col_id"], "left").withColumn("inside", F.col("_i").isNotNull())
    return od.indexed(j, ["k"], [F.desc("inside"), "m", "col_id"], "ord").select("k", "col_id", "inside", "ord")


@query("top_correlated_rows", sql("dense", """, p as (select a.row_id as probe, b.row_id, corr(a.value, b.value) r from dense a join dense b using (col_id) where a.row_id <> b.row_id group by 1, 2)
select probe, row_id, round(r, 6) as r, rn from (select *, row_number() over (partition by probe order by r desc, row_id) rn from p) where rn <= 5"""))
def top_correlated_rows(spark, sf):
    from tessella.operators import tiles

    axis = tiles.column_axis(t.dense(spark, sf))
    vec = materialize(spread(tiles.pack_rows(t.dense(spark, sf), axis), "row_id"), "vectors")
    return tiles.top_correlated(vec, vec.select("row_id"), axis.count(), 5).select("probe", "row_id", *r6("r"), "rn")


@query("min_rank", "select l_returnflag, l_orderkey, l_linenumber, l_quantity, rank() over (partition by l_returnflag order by l_quantity) as rnk from lineitem")
def min_rank(spark, sf):
    li = t.read(spark, sf, "lineitem").select("l_returnflag", "l_orderkey", "l_linenumber", "l_quantity")
    return od.min_rank(li, ["l_returnflag"], "l_quantity", ["l_orderkey", "l_linenumber"])


@query("exact_quantiles", "select l_returnflag, round(quantile_cont(l_extendedprice, 0.01), 6) as q01, round(quantile_cont(l_extendedprice, 0.5), 6) as q50, round(quantile_cont(l_extendedprice, 0.95), 6) as q95 from lineitem group by 1")
def exact_quantiles(spark, sf):
    return od.quantiles(t.read(spark, sf, "lineitem"), ["l_returnflag"], "l_extendedprice", {"q01": 0.01, "q50": 0.5, "q95": 0.95}).select("l_returnflag", *r6("q01", "q50", "q95"))


@query("rank_clusters", sql("row_score sparse_rows", "select k, round(m, 6) as score, row_number() over (order by m, k) as ord from (select k, avg(score) m from row_score join sparse_rows using (k, row_id) group by 1)"))
def rank_clusters(spark, sf):
    g = sparse_scores(spark, sf).join(t.sparse_rows(spark, sf), ["k", "row_id"]).groupBy("k").agg(F.avg("score").alias("score"))
    return od.indexed(g, [], ["score", "k"], "ord").select("k", *r6("score"), "ord")


@query("seed_random", f"select k, row_id from (select k, row_id, row_number() over (partition by row_id order by {draw('row_id', 'k', '1')}, k) as r from (select distinct p_partkey as row_id from part), (select unnest(range(1, 26))::int as k)) where r <= 2")
def seed_random(spark, sf):
    return sd.seed_random(parts(spark, sf), 25, 2)


@query("seed_random_n", " union all ".join(f"select ((p - 1) // 5 + 1)::int as k, row_id, {s + 1} as slot from (select row_id, row_number() over (order by {draw('row_id', '1', str(s))}, row_id) as p from (select distinct p_partkey as row_id from part)) where p <= 125" for s in range(2)))
def seed_random_n(spark, sf):
    return sd.seed_random_n(parts(spark, sf), 25, 5, 2)


@query("seed_list", f"""with given as (select p_size::int as k, p_partkey as row_id from part where p_size <= 60), free as (select distinct p_partkey as row_id from part where p_size % 7 = 0)
select k, row_id from given where k % 7 <> 0 union all
select ((p - 1) // 5 + 1)::int + (select max(k)::int from given where k % 7 <> 0), row_id from (select row_id, row_number() over (order by {draw('row_id', '1', '0')}, row_id) as p from free)
where p <= 5 * (60 - (select max(k) from given where k % 7 <> 0))""")
def seed_list(spark, sf):
    lists = t.read(spark, sf, "part").where("p_size % 7 <> 0").select(F.col("p_size").cast("int").alias("k"), F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("name"))
    alias = t.read(spark, sf, "part").select(F.col("p_partkey").alias("row_id"), F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("alias"))
    return sd.seed_list(parts(spark, sf), lists, alias, 60)


@query("seed_kmeans")
def seed_kmeans(spark, sf):
    return sd.seed_kmeans(t.dense(spark, sf), 10)


@query("seed_trimmed_kmeans")
def seed_trimmed_kmeans(spark, sf):
    return sd.seed_trimmed_kmeans(t.dense(spark, sf), 10, 0.1, rounds=2)


@query("seed_correlated")
def seed_correlated(spark, sf):
    return sd.seed_correlated(t.dense(spark, sf), 10, 10)


def vec_edges(spark, sf):
    n = t.read(spark, sf, "embeddings").agg(F.count(F.lit(1)).alias("n")).scalar()
    e = t.edges(spark, sf).where("net = 'ship'")
    return e.select((F.col("src") % n).alias("src"), (F.col("dst") % n).alias("dst"), (F.col("weight") * 100).alias("weight"))


@query("seed_network_correlated")
def seed_network_correlated(spark, sf):
    return sd.seed_correlated(t.dense(spark, sf), 10, 10, edges=vec_edges(spark, sf))


@query("seed_network")
def seed_network(spark, sf):
    return sd.seed_network(t.edges(spark, sf).where("net = 'ship'"), 25, 5)


@query("seed_columns_best", sql("sparse sparse_rows", ", s as (select k, col_id, var_pop(value) / (abs(avg(value)) + 0.01::double) s from sparse join sparse_rows using (row_id) group by 1, 2) select k, col_id from (select *, row_number() over (partition by col_id order by s, k) r from s) where r <= 3"))
def seed_columns_best(spark, sf):
    return sd.seed_columns(t.sparse(spark, sf), t.sparse_rows(spark, sf), 3)


@query("seed_columns_random", sql("sparse", f"select k, col_id from (select k, col_id, row_number() over (partition by col_id order by {draw('col_id', 'k', '1')}, k) as r from (select distinct col_id from sparse), (select unnest(range(1, 26))::int as k)) where r <= 3"))
def seed_columns_random(spark, sf):
    return sd.seed_columns(t.sparse(spark, sf), t.sparse_rows(spark, sf), 3, "rnd", 25)


@query("precluster_regulators")
def precluster_regulators(spark, sf):
    return sd.precluster_regulators(t.dense(spark, sf), 30, starts=2)[0]
