"""Queries over networks, groups, identifiers and set operations."""

from pyspark.sql import functions as F

from tessella.operators import ids as ni
from tessella.operators import networks as nw
from tessella.plans import tables as t
from tessella.plans.q_matrix import r6
from tessella.plans.q_scores import GRP, groups
from tessella.plans.registry import query
from tessella.plans.tables import sql


@query("drop_self_edges", sql("raw_edges", "select net, src, dst, weight from raw_edges where src <> dst"))
def drop_self_edges(spark, sf):
    return nw.drop_self_edges(t.raw_edges(spark, sf))


@query("merge_duplicate_edges", sql("raw_edges", "select net, src, dst, sum(weight) as weight from raw_edges group by 1, 2, 3"))
def merge_duplicate_edges(spark, sf):
    return nw.merge_duplicate_edges(t.raw_edges(spark, sf))


@query("merge_duplicate_edges_compat", """with e as (select 'p' as net, l_partkey as src, l_suppkey as dst, l_quantity as weight, l_orderkey * 10000 + l_linenumber * 100 + l_quantity as pos from lineitem)
select net, src, dst, case when count(*) > 1 then sum(weight) - arg_min(weight, pos) else sum(weight) end as weight from e group by 1, 2, 3""")
def merge_duplicate_edges_compat(spark, sf):
    e = t.read(spark, sf, "lineitem").select(F.lit("p").alias("net"), F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst"), F.col("l_quantity").alias("weight"),
                                             (F.col("l_orderkey") * 10000 + F.col("l_linenumber") * 100 + F.col("l_quantity")).alias("at"))
    return nw.merge_duplicate_edges(e, compat=True, position="at")


def named_edges(spark, sf):
    """Customer-to-customer order links written by name, with a version suffix on the target."""
    o = t.read(spark, sf, "orders")
    name = lambda c: F.format_string("Customer#%09d", c)
    return o.select(F.lit("o").alias("net"), name(F.col("o_custkey")).alias("src"), name(F.col("o_orderkey") % 1500).alias("dst"), F.col("o_totalprice").alias("weight"))


@query("truncate_node_names", """select 'o' as net, printf('Customer#%09d', o_custkey) as src, printf('Customer#%09d', o_orderkey % 1500) as dst, round(o_totalprice, 2) as weight from orders""")
def truncate_node_names(spark, sf):
    e = named_edges(spark, sf)
    e = e.withColumn("src", F.concat("src", F.lit(".12"))).withColumn("dst", F.concat("dst", F.lit(".7x")))
    ids = t.read(spark, sf, "customer").select(F.col("c_name").alias("row_id"))
    return nw.truncate_node_names(e, ids).select("net", "src", "dst", F.round("weight", 2).alias("weight"))


@query("reconcile_edges", """select 'o' as net, o_custkey::varchar as src, (o_orderkey % 1500)::varchar as dst, round(o_totalprice, 2) as weight from orders
where o_custkey in (select c_custkey from customer) and o_orderkey % 1500 in (select c_custkey from customer)""")
def reconcile_edges(spark, sf):
    c = t.read(spark, sf, "customer")
    ids = c.select(F.col("c_custkey").cast("string").alias("row_id"))
    alias = c.select(F.col("c_custkey").cast("string").alias("row_id"), F.col("c_name").alias("alias"))
    return nw.reconcile_edges(named_edges(spark, sf), ids, alias).select("net", "src", "dst", F.round("weight", 2).alias("weight"))


SYM = """, b as (select net, src, dst, weight, 0 p from edges union all select net, dst, src, weight, 1 from edges), sym as (select net, src, dst, arg_min(weight, p) as weight from b group by 1, 2, 3)"""


@query("symmetrize_edges", sql("edges", SYM + "select * from sym"))
def symmetrize_edges(spark, sf):
    return nw.symmetrize_edges(t.edges(spark, sf))


@query("equalize_networks", sql("edges", ", s as (select net, sum(weight) s from edges group by 1) select net, src, dst, round(weight / s * (select max(s) from s), 6) as weight from edges join s using (net)"))
def equalize_networks(spark, sf):
    return nw.equalize_networks(t.edges(spark, sf)).select("net", "src", "dst", *r6("weight"))


@query("prepare_networks", sql("edges", SYM + ", s as (select net, sum(weight) s from sym group by 1) select net, src, dst, round(weight / s * (select max(s) from s), 6) as weight from sym join s using (net)"))
def prepare_networks(spark, sf):
    ids = t.read(spark, sf, "part").select(F.col("p_partkey").alias("row_id"))
    return nw.prepare_networks(t.raw_edges(spark, sf), ids).select("net", "src", "dst", *r6("weight"))


@query("rescale_links", sql("edges", "select net, src, dst, round(1000 * exp(weight / (select max(weight) from edges where net = 'order')) / exp(1), 6) as weight from edges where net = 'order'"))
def rescale_links(spark, sf):
    return nw.rescale_links(t.edges(spark, sf).where("net = 'order'")).select("net", "src", "dst", *r6("weight"))


@query("groups_to_edges", sql("", "with " + GRP[2:] + " select 'brand' as net, src as row_id, count(*) as n_edges, round(sum(weight), 6) as weight from pairs group by 2"))
def groups_to_edges(spark, sf):
    cap = t.read(spark, sf, "part").agg((F.count(F.lit(1)) / 20).alias("n")).scalar()
    return nw.group_network_degrees(groups(spark, sf), cap).select("net", "row_id", "n_edges", *r6("weight"))


@query("groups_to_edges_within", sql("sparse_rows", GRP + "select a.k, 'brand' as net, count(*) as n_edges, round(sum(weight), 6) as weight from pairs join sparse_rows a on src = a.row_id join sparse_rows b on dst = b.row_id and a.k = b.k where src < dst group by 1"))
def groups_to_edges_within(spark, sf):
    cap = t.read(spark, sf, "part").agg((F.count(F.lit(1)) / 20).alias("n")).scalar()
    out = nw.group_edges_within(groups(spark, sf), t.sparse_rows(spark, sf), cap).where("n_edges > 0")
    return out.select("k", "net", "n_edges", *r6("weight"))


@query("orient_groups", "select p_brand as group_id, p_partkey::varchar as row_id, 1.0::double as weight from part")
def orient_groups(spark, sf):
    p = t.read(spark, sf, "part")
    pairs = p.select(F.col("p_partkey").cast("string").alias("x"), F.col("p_brand").alias("y"), F.lit(1.0).alias("weight"))
    return nw.orient_groups(pairs, p.select(F.col("p_partkey").cast("string").alias("row_id")), "x", "y")


@query("cluster_subnetwork", sql("edges sparse_rows", "select a.k, net, src, dst, weight from edges join sparse_rows a on src = a.row_id join sparse_rows b on dst = b.row_id and a.k = b.k"))
def cluster_subnetwork(spark, sf):
    return nw.cluster_subnetwork(t.edges(spark, sf), t.sparse_rows(spark, sf))


@query("rows_not_in_network", sql("edges", "select row_id, net from (select p_partkey as row_id from part), (select distinct net from edges) except (select src, net from edges union select dst, net from edges)"))
def rows_not_in_network(spark, sf):
    return nw.rows_not_in_network(t.read(spark, sf, "part").select(F.col("p_partkey").alias("row_id")), t.edges(spark, sf))


@query("connected_components", """with recursive p as (select distinct l_partkey as src, l_partkey - least(l_partkey % 10, 1) as dst from lineitem), n as (select src as node from p union select dst from p),
up(node, top) as (select node, node from n union all select up.node, p.dst from up join p on p.src = up.top where p.src <> p.dst) select node, min(top) as label from up where node in (select src from p where src <> dst union select dst from p where src <> dst) group by 1""")
def connected_components(spark, sf):
    li = t.read(spark, sf, "lineitem").select(F.col("l_partkey").alias("src"), (F.col("l_partkey") - F.least(F.col("l_partkey") % 10, F.lit(1))).alias("dst")).distinct()
    return nw.connected_components(li)


def feature_pairs(spark, sf):
    """Neighbouring features of one contig that belong to the same block of four."""
    f = t.features(spark, sf).withColumn("i", F.split_part("id", F.lit("."), F.lit(2)).cast("int"))
    a = f.select("contig", "i", F.col("id").alias("src"))
    b = f.select("contig", (F.col("i") - 1).alias("i"), F.col("id").alias("dst"))
    return a.join(b, ["contig", "i"]).where("i % 4 <> 3")


@query("chain_pairs_to_operons", sql("features", """, f as (select id, contig, split_part(id, '.', 2)::int // 4 as g, min(id) over (partition by contig, split_part(id, '.', 2)::int // 4) as operon, count(*) over (partition by contig, split_part(id, '.', 2)::int // 4) n from features)
select operon, id as row_id from f where n > 1"""))
def chain_pairs_to_operons(spark, sf):
    return nw.chain_pairs_to_operons(feature_pairs(spark, sf))


@query("reciprocal_best_hits", """with h as (select l_partkey as query, l_suppkey as subject, l_extendedprice as bit_score, l_discount / 2000 as e_value, l_quantity as align_len from lineitem),
ok as (select h.* from h join part on p_partkey = query join supplier on s_suppkey = subject where e_value <= 1e-5 and align_len / (p_size + 20) >= 0.5 and align_len / (s_nationkey + 20) >= 0.5),
r as (select *, row_number() over (partition by query order by bit_score desc, e_value, query, subject) a, row_number() over (partition by subject order by bit_score desc, e_value, query, subject) b from ok)
select query, subject, bit_score, round(e_value, 9) as e_value from r where a = 1 and b = 1""")
def reciprocal_best_hits(spark, sf):
    h = t.read(spark, sf, "lineitem").select(F.col("l_partkey").alias("query"), F.col("l_suppkey").alias("subject"), F.col("l_extendedprice").alias("bit_score"), (F.col("l_discount") / 2000).alias("e_value"), F.col("l_quantity").alias("align_len"))
    lq = t.read(spark, sf, "part").select(F.col("p_partkey").alias("query"), (F.col("p_size") + 20).alias("q_len"))
    ls = t.read(spark, sf, "supplier").select(F.col("s_suppkey").alias("subject"), (F.col("s_nationkey") + 20).alias("s_len"))
    return nw.reciprocal_best_hits(h, lq, ls).select("query", "subject", "bit_score", F.round("e_value", 9).alias("e_value"))


@query("fuzzy_lookup", """with d as (select distinct c_name as name, levenshtein(lower(c_name), 'customer#00000x042') as distance from customer) select name, distance from d where distance <= 2 and distance = (select min(distance) from d)""")
def fuzzy_lookup(spark, sf):
    return nw.fuzzy_lookup(t.read(spark, sf, "customer"), "Customer#00000X042", "c_name")


@query("attach_priors", """with pred as (select distinct l_suppkey % 25 as k, l_partkey as predictor from lineitem), pri as (select l_suppkey % 25 as k, l_partkey as predictor, max(l_discount) * 10 as prior from lineitem group by 1, 2)
select k, predictor, round(1.5 - coalesce(prior, 0.5), 6) as penalty from (select * from pred union select k, predictor from pri where prior >= 0.5 and predictor in (select p_partkey from part)) left join pri using (k, predictor)""")
def attach_priors(spark, sf):
    li = t.read(spark, sf, "lineitem").select((F.col("l_suppkey") % 25).alias("k"), F.col("l_partkey").alias("predictor"), "l_discount", "l_quantity")
    pri = li.groupBy("k", "predictor").agg((F.max("l_discount") * 10).alias("prior"))
    avail = t.read(spark, sf, "part").select(F.col("p_partkey").alias("predictor"))
    return nw.attach_priors(li.select("k", "predictor").distinct(), pri, avail).select("k", "predictor", *r6("penalty"))


def name_table(spark, sf):
    c = t.read(spark, sf, "customer").select(F.concat(F.lit("C"), F.col("c_custkey").cast("string")).alias("id"), F.col("c_name").alias("name"))
    s = t.read(spark, sf, "supplier").select(F.concat(F.lit("C"), F.col("s_suppkey").cast("string")).alias("id"), F.col("s_name").alias("name"))
    return c.unionByName(s)


ALIAS = """with tab as (select 'C' || c_custkey as id, c_name as name from customer union select 'C' || s_suppkey, s_name from supplier), l as (select id a, name b from tab union select name, id from tab),
ids as (select distinct lower(c_name) || '_1' as row_id from customer union select 'none' || n_nationkey from nation), st as (select row_id, regexp_replace(row_id, 'm$|_[0-9]$|-[^ ]$', '', 'g') g from ids),
f as (select distinct row_id, g, unnest([a, b]) as alias from st join l on lower(a) = lower(g)),
al as (select row_id, alias from f union select row_id, g from f union select f.row_id, l.b from f join l on l.a = f.alias union select row_id, row_id from ids where row_id not in (select row_id from f))"""


def alias_ids(spark, sf):
    c = t.read(spark, sf, "customer").select(F.concat(F.lower("c_name"), F.lit("_1")).alias("row_id"))
    return c.unionByName(t.read(spark, sf, "nation").select(F.concat(F.lit("none"), F.col("n_nationkey").cast("string")).alias("row_id")))


@query("resolve_aliases", ALIAS + " select row_id, alias from al")
def resolve_aliases(spark, sf):
    return ni.resolve_aliases(alias_ids(spark, sf), name_table(spark, sf))


@query("rows_without_annotation", ALIAS + " select distinct row_id from ids where row_id not in (select row_id from al where alias in (select id from tab))")
def rows_without_annotation(spark, sf):
    ids = alias_ids(spark, sf)
    return ni.rows_without_annotation(ids, ni.resolve_aliases(ids, name_table(spark, sf)), name_table(spark, sf))


@query("alias_lists", ALIAS + " select row_id, string_agg(alias, '::' order by alias) as synonyms from al group by 1")
def alias_lists(spark, sf):
    return ni.alias_lists(ni.resolve_aliases(alias_ids(spark, sf), name_table(spark, sf)))


@query("long_names", """with ids as (select p_partkey::varchar as row_id from part union select 'x' || p_partkey from part) select row_id, coalesce(p_name, '') as long_name from ids left join part on row_id = p_partkey::varchar""")
def long_names(spark, sf):
    p = t.read(spark, sf, "part")
    ids = p.select(F.col("p_partkey").cast("string").alias("row_id")).unionByName(p.select(F.concat(F.lit("x"), F.col("p_partkey").cast("string")).alias("row_id")))
    feat = p.select(F.col("p_partkey").cast("string").alias("id"), F.col("p_brand").alias("name"), F.col("p_name").alias("description"))
    return ni.long_names(ids, ids.select("row_id", F.col("row_id").alias("alias")), feat)


@query("long_names_short", """select p_partkey::varchar as row_id, case when p_partkey % 2 = 0 then p_type else p_brand end as long_name from part""")
def long_names_short(spark, sf):
    p = t.read(spark, sf, "part")
    pid = F.col("p_partkey").cast("string")
    feat = p.select(pid.alias("id"), F.when(F.col("p_partkey") % 2 == 0, pid).otherwise(F.col("p_brand")).alias("name"), F.concat("p_name", F.lit(" ("), F.col("p_type"), F.lit(")")).alias("description"))
    ids = p.select(pid.alias("row_id"))
    return ni.long_names(ids, ids.select("row_id", F.col("row_id").alias("alias")), feat, short=True)


@query("infer_name_prefix", """with n as (select upper(c_name) as u from customer union all select upper(s_name) from supplier), c as (select len, substr(u, 1, len) as prefix, count(*) / (select count(*) from n)::double as share from n, (values (1),(2),(3),(4)) v(len) group by 1, 2),
b as (select len, arg_max(prefix, share) prefix, max(share) share from c group by 1), lv as (select case when max(share) > 0.9 then 0.9 when max(share) > 0.6 then 0.6 when max(share) > 0.4 then 0.4 end v from b)
select arg_max(prefix, len) as prefix, round(max(share) filter (where len = (select max(len) from b, lv where share > v)), 6) as share from b, lv where share > v""")
def infer_name_prefix(spark, sf):
    n = t.read(spark, sf, "customer").select(F.col("c_name").alias("name")).unionByName(t.read(spark, sf, "supplier").select(F.col("s_name").alias("name")))
    return ni.infer_name_prefix(n).select("prefix", *r6("share"))


@query("infer_name_regex", """with n as (select upper(p_brand) u from part), w as (select max(length(u)) w from n), c as (select distinct i, substr(rpad(u, w::int, ' '), i::int, 1) ch from n, w, range(1, 50) r(i) where i <= w),
p as (select i, string_agg(ch, '' order by ch) filter (where ch <> ' ') s, count(*) filter (where ch <> ' ') n, bool_or(ch = ' ') o from c group by 1)
select string_agg((case when n > 1 and not o and regexp_matches(s, '^[0-9]+$') and ascii(right(s, 1)) - ascii(left(s, 1)) + 1 = n then '[' || left(s, 1) || '-' || right(s, 1) || ']' when n > 1 then '[' || s || ']' else s end) || case when o then '?' else '' end, '' order by i) as regex from p""")
def infer_name_regex(spark, sf):
    return ni.infer_name_regex(t.read(spark, sf, "part"), "p_brand")


@query("select_ids_by_pattern", """select distinct c_name as row_id from customer where regexp_matches(c_name, '(?i)^customer#0000[0-9]+$')""")
def select_ids_by_pattern(spark, sf):
    c = t.read(spark, sf, "customer").select(F.col("c_name").alias("row_id"))
    s = t.read(spark, sf, "supplier").select(F.col("s_name").alias("row_id"))
    return ni.select_ids_by_pattern(c.unionByName(s), c, "customer#0000[0-9]+$", "cust")


@query("node_attributes", """with n as (select c_custkey as node, 'gene' as type from customer), a as (select s_suppkey as node, s_name as label, 'u' || s_suppkey as url from supplier), b as (select n_nationkey as node, n_name as nation, 'v' || n_nationkey as url from nation)
select coalesce(n.node, a.node, b.node)::bigint as node, type, label, nation, coalesce(b.url, a.url) as url from n full join a on n.node = a.node full join b on b.node = coalesce(n.node, a.node)""")
def node_attributes(spark, sf):
    n = t.read(spark, sf, "customer").select(F.col("c_custkey").alias("node"), F.lit("gene").alias("type"))
    a = t.read(spark, sf, "supplier").select(F.col("s_suppkey").alias("node"), F.col("s_name").alias("label"), F.concat(F.lit("u"), F.col("s_suppkey").cast("string")).alias("url"))
    b = t.read(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("node"), F.col("n_name").alias("nation"), F.concat(F.lit("v"), F.col("n_nationkey").cast("string")).alias("url"))
    return ni.node_attributes(n, a, b, coalesce=["url"])


@query("lookup_taxon", "select 'NATION_1' as name, coalesce((select min(n_nationkey) from nation where lower(n_name) = 'nation_1'), (select min(n_nationkey) from nation where lower(n_name) like '%nation_1%')) as taxon_id")
def lookup_taxon(spark, sf):
    return ni.lookup_taxon(t.read(spark, sf, "nation").select(F.col("n_name").alias("name"), F.col("n_nationkey").alias("taxon_id")), "NATION_1")


@query("union_networks", sql("raw_edges", "select net, src, dst, weight from raw_edges union all select 'cust', o_custkey, o_orderkey, o_totalprice from orders"))
def union_networks(spark, sf):
    o = t.read(spark, sf, "orders").select(F.lit("cust").alias("net"), F.col("o_custkey").alias("src"), F.col("o_orderkey").alias("dst"), F.col("o_totalprice").alias("weight"))
    return nw.union_networks([t.raw_edges(spark, sf), o])


@query("distinct_rows", "select distinct l_partkey as id, l_suppkey as name from lineitem")
def distinct_rows(spark, sf):
    return t.read(spark, sf, "lineitem").select(F.col("l_partkey").alias("id"), F.col("l_suppkey").alias("name")).distinct()


@query("set_difference", "select p_partkey as predictor from part except select l_partkey from lineitem where l_quantity > 40")
def set_difference(spark, sf):
    p = t.read(spark, sf, "part").select(F.col("p_partkey").alias("predictor"))
    return p.join(t.read(spark, sf, "lineitem").where("l_quantity > 40").select(F.col("l_partkey").alias("predictor")), "predictor", "left_anti").distinct()


@query("membership_intersection", """with m as (select distinct l_suppkey % 25 as k, l_partkey as row_id from lineitem) select a.k as a, b.k as b, count(*) as n from m a join m b using (row_id) where a.k < b.k group by 1, 2""")
def membership_intersection(spark, sf):
    from tessella.operators.tiles import column_correlations

    m = t.read(spark, sf, "lineitem").select((F.col("l_suppkey") % 25).alias("k"), F.col("l_partkey").alias("row_id")).distinct()
    return column_correlations(m.withColumn("one", F.lit(1.0)), "row_id", "k", "one", floor=1).where("n > 0").select("a", "b", "n")
