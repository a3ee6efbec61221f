"""Queries over genome coordinates, sequences and motifs."""

from pyspark.sql import functions as F

from tessella.operators import genome as ge
from tessella.operators import motifs as mo
from tessella.plans import tables as t
from tessella.plans.q_matrix import r6
from tessella.plans.registry import query
from tessella.plans.tables import sql


def seqs(spark, sf):
    return t.contigs(spark, sf).select(F.col("contig").alias("id"), "seq")


@query("reverse_complement", sql("contigs", "select contig as id, md5(reverse(translate(seq, 'ATCG', 'TAGC'))) as rc from contigs"))
def reverse_complement(spark, sf):
    return seqs(spark, sf).select("id", F.md5(ge.reverse_complement("seq")).alias("rc"))


KM4 = """, s as (select seq from contigs union select reverse(translate(seq, 'ATCG', 'TAGC')) from contigs), x as (select seq, unnest(range(1, length(seq) + 1))::int as i from s),
c as (select o, substr(seq, i, o + 1) as kmer, count(*)::double as n from x, (select unnest([0, 1, 2, 3]) as o) where i + o <= length(seq) group by 1, 2), l as (select unnest(['A', 'C', 'G', 'T']) as x),
al as (select 0 as o, x as kmer from l union all select 1, a.x || b.x from l a, l b union all select 2, a.x || b.x || c.x from l a, l b, l c union all select 3, a.x || b.x || c.x || d.x from l a, l b, l c, l d),
tot as (select o, sum(n) as t from c group by 1) """


@query("background_model", sql("contigs", KM4 + "select al.kmer, al.o as ord, round(coalesce(n, 0.1::double) / t, 6) as freq from al left join c on c.o = al.o and c.kmer = al.kmer join tot on tot.o = al.o"))
def background_model(spark, sf):
    return mo.background_model(seqs(spark, sf)).select("kmer", "ord", *r6("freq"))


@query("kmer_table", sql("contigs", """, s as (select distinct seq from contigs), l as (select unnest(['A', 'C', 'G', 'T']) x),
al as (select a.x || b.x || c.x || d.x || e.x || f.x as kmer from l a, l b, l c, l d, l e, l f), k as (select substr(seq, i::int, 6) kmer, count(*) n from s, unnest(range(1, length(seq) - 4)) r(i) group by 1)
select kmer, coalesce(n, 0) + 1 as n from al left join k using (kmer)"""))
def kmer_table(spark, sf):
    return mo.kmer_table(seqs(spark, sf), 6)


def _window_sql(kind):
    up = kind == "upstream"
    before, after = ("start_pos - 1 - 150", "start_pos - 1 - 20"), ("end_pos + 1 + 20", "end_pos + 1 + 150")
    d, r = (before, after) if up else (after, before)
    return sql("features contigs", f"""
, w as (select id, f.contig, strand, case strand when 'D' then {d[0]} else {r[0]} end as "start", case strand when 'D' then {d[1]} else {r[1]} end as "end", seq from features f join contigs using (contig)),
c as (select id, contig, strand, "start", "end", substr(seq, greatest("start", 1)::int, greatest("end" - greatest("start", 1) + 1, 0)::int) as s from w),
o as (select *, case when strand = 'R' then reverse(translate(s, 'ATCG', 'TAGC')) else s end as q from c)
select id, contig, strand, "start", "end", case when length(q) > 130 then case when strand = 'D' then substr(q, 1, 130) else right(q, 130) end else q end as seq from o""")


@query("promoter_window_upstream", _window_sql("upstream"))
def promoter_window_upstream(spark, sf):
    return ge.promoter_window(t.features(spark, sf), t.contigs(spark, sf), "upstream", (20, 150))


@query("promoter_window_downstream", _window_sql("downstream"))
def promoter_window_downstream(spark, sf):
    return ge.promoter_window(t.features(spark, sf), t.contigs(spark, sf), "downstream", (20, 150))


@query("promoter_window_gene", sql("features contigs", """select id, contig, strand, start_pos as "start", end_pos as "end", case when strand = 'R' then reverse(translate(substr(seq, start_pos::int, 200), 'ATCG', 'TAGC')) else substr(seq, start_pos::int, 200) end as seq from features join contigs using (contig)"""))
def promoter_window_gene(spark, sf):
    return ge.promoter_window(t.features(spark, sf), t.contigs(spark, sf), "gene")


def _nearest_sql(same):
    extra = "and b.strand = a.strand" if same else ""
    return sql("features", f"""select a.id, any_value(a.strand) as strand, case when any_value(a.strand) = 'D' then max(b.end_pos) filter (where b.end_pos < a.start_pos) else min(b.start_pos) filter (where b.start_pos > a.end_pos) end as nearest
from features a join features b on a.contig = b.contig {extra} group by a.id""")


@query("noncoding_upstream", _nearest_sql(False))
def noncoding_upstream(spark, sf):
    return ge.noncoding_upstream(t.features(spark, sf))


@query("noncoding_upstream_same_strand", _nearest_sql(True))
def noncoding_upstream_same_strand(spark, sf):
    return ge.noncoding_upstream(t.features(spark, sf), same_strand=True)


@query("nearest_earlier_event", """with q as (select event_id, user_id, epoch_us(ts) as us from events where event_type <> 'error'), r as (select user_id, epoch_us(ts) as us, event_id as prev from events where event_type = 'error')
select q.event_id, q.user_id, q.us, arg_max(prev, r.us) as nearest from q left join r on q.user_id = r.user_id and r.us < q.us group by 1, 2, 3""")
def nearest_earlier_event(spark, sf):
    e = t.read(spark, sf, "events").select("event_id", "user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), "event_type")
    left = e.where("event_type <> 'error'").select("event_id", "user_id", "us")
    right = e.where("event_type = 'error'").select("user_id", F.col("us").alias("rus"), F.col("event_id").alias("prev"))
    return ge.nearest_earlier(left, right, "user_id", "us", "rus", "prev")


def _regions(spark, sf):
    li = t.read(spark, sf, "lineitem").join(t.read(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    day = lambda c: F.unix_date(F.to_date(c)).cast("long")
    return li.select(F.col("l_partkey").alias("contig"), (F.col("l_orderkey") * 1000 + F.col("l_linenumber") * 100 + F.col("l_quantity")).cast("long").alias("id"),
                     F.least(day("o_orderdate"), day("l_shipdate")).alias("start"), F.greatest(day("o_orderdate"), day("l_shipdate")).alias("end")).dropDuplicates(["contig", "id"])


@query("overlapping_regions", """with r as (select l_partkey as contig, (l_orderkey * 1000 + l_linenumber * 100 + l_quantity)::bigint as id, min(least(epoch(o_orderdate), epoch(l_shipdate)) / 86400)::bigint s, min(greatest(epoch(o_orderdate), epoch(l_shipdate)) / 86400)::bigint e from lineitem join orders on l_orderkey = o_orderkey group by 1, 2)
select a.contig, count(*) as n_pairs, sum(greatest(a.s, b.s))::bigint as sum_from, sum(least(a.e, b.e))::bigint as sum_to from r a join r b on a.contig = b.contig and a.s <= b.e and b.s <= a.e and a.id <> b.id group by 1""")
def overlapping_regions(spark, sf):
    out = ge.overlapping_regions(_regions(spark, sf), bucket=90)
    return out.groupBy("contig").agg(F.count(F.lit(1)).alias("n_pairs"), F.sum("from").alias("sum_from"), F.sum("to").alias("sum_to"))


def operons(spark, sf):
    f = t.features(spark, sf).withColumn("i", F.split_part("id", F.lit("."), F.lit(2)).cast("int"))
    return f.select(F.concat_ws(":", F.col("contig").cast("string"), F.floor(F.col("i") / 3).cast("string")).alias("operon"), F.col("id").alias("row_id"))


OPERON = """, op as (select contig || ':' || (split_part(id, '.', 2)::int // 3) as operon, id as row_id, strand, start_pos, end_pos from features),
hd as (select operon, case when avg((strand = 'D')::int) > 0.6 then arg_min(row_id, start_pos) when avg((strand = 'R')::int) > 0.6 then arg_max(row_id, end_pos) end as head from op group by 1)"""


@query("operon_heads", sql("features", OPERON + "select operon, head from hd where head is not null"))
def operon_heads(spark, sf):
    return ge.operon_heads(operons(spark, sf), t.features(spark, sf))


@query("operon_table", sql("features", OPERON + "select distinct head, row_id from op join hd using (operon) where head is not null"))
def operon_table(spark, sf):
    o = operons(spark, sf)
    return ge.operon_table(o, ge.operon_heads(o, t.features(spark, sf)))


@query("operon_lists", sql("features", OPERON + "select head, 0 as part, count(*) as n, min(row_id) as first_gene, max(row_id) as last_gene from (select distinct head, row_id from op join hd using (operon) where head is not null) group by 1"))
def operon_lists(spark, sf):
    from tessella.operators.clusters import operon_lists as lists

    out = lists(operon_table(spark, sf))
    return out.select("head", "part", F.size("genes").cast("long").alias("n"), F.element_at("genes", 1).alias("first_gene"), F.element_at("genes", -1).alias("last_gene"))


def gene_alias(spark, sf):
    f = t.features(spark, sf)
    return f.select(F.concat(F.lit("G"), "id").alias("row_id"), F.explode(F.array(F.concat(F.lit("G"), "id"), F.col("id"))).alias("alias"))


@query("gene_coords", sql("features", "select 'G' || id as row_id, id, contig, strand, start_pos, end_pos from features"))
def gene_coords(spark, sf):
    return ge.gene_coords(gene_alias(spark, sf), t.features(spark, sf))


@query("gene_coords_operon_shift", sql("features", OPERON + """, ot as (select row_id, min(head) head from op join hd using (operon) where head is not null group by 1)
select 'G' || f.id as row_id, f.id, h.contig, h.strand, h.start_pos, h.end_pos from features f left join ot on ot.row_id = f.id join features h on h.id = coalesce(ot.head, f.id)"""))
def gene_coords_operon_shift(spark, sf):
    ops = operon_table(spark, sf).select(F.concat(F.lit("G"), "head").alias("head"), F.concat(F.lit("G"), "row_id").alias("row_id"))
    return ge.gene_coords(gene_alias(spark, sf), t.features(spark, sf), ops)


@query("operons_to_edges", sql("features", OPERON + ", m as (select distinct head, row_id from op join hd using (operon) where head is not null) select 'operons' as net, a.row_id, count(*) as n_edges, 1000.0::double * count(*) as weight from m a join m b using (head) where a.row_id <> b.row_id group by 2"))
def operons_to_edges(spark, sf):
    from tessella.operators.networks import group_network_degrees, operon_groups

    cap = t.features(spark, sf).agg((F.count(F.lit(1)) / 20).alias("n")).scalar()
    return group_network_degrees(operon_groups(operon_table(spark, sf)), cap).where("n_edges > 0")


@query("distinct_sequences", sql("contigs", "select min(contig) as id, md5(seq) as seq from contigs group by seq"))
def distinct_sequences(spark, sf):
    return ge.distinct_sequences(seqs(spark, sf)).select("id", F.md5("seq").alias("seq"))


LOW = """, ch as (select contig as id, i, substr(seq, i::int, 1) b, length(seq) n from contigs, unnest(range(1, length(seq) + 1)) r(i)),
cn as (select id, i, n, b, count(*) filter (where b = 'A') over w a, count(*) filter (where b = 'C') over w c, count(*) filter (where b = 'G') over w g, count(*) filter (where b = 'T') over w t from ch window w as (partition by id order by i rows between current row and 7 following)),
bd as (select id, i, b, (i <= n - 7 and greatest(a, c, g, t) >= 7) as bad from cn), cv as (select id, i, b, bool_or(bad) over (partition by id order by i rows between 7 preceding and current row) m from bd)"""


@query("mask_low_complexity", sql("contigs", LOW + "select id, count(*) filter (where m) as n_masked, sum(i) filter (where m)::bigint as pos_sum from cv group by 1"))
def mask_low_complexity(spark, sf):
    out = ge.mask_low_complexity(seqs(spark, sf)).where("seq <> ''")
    at = F.filter(F.transform(F.split("seq", ""), lambda x, i: F.when(x == "N", (i + 1).cast("long"))), lambda x: x.isNotNull())
    return out.select("id", F.size(at).cast("long").alias("n_masked"), F.when(F.size(at) > 0, F.aggregate(at, F.lit(0).cast("long"), lambda a, x: a + x)).alias("pos_sum"))


@query("mask_start", sql("contigs", "select contig as id, md5(case when length(seq) > 25 then substr(substr(seq, 1, 25) || 'NNNN' || substr(seq, 30), 1, length(seq)) else seq end) as seq from contigs"))
def mask_start(spark, sf):
    return ge.mask_start(seqs(spark, sf), 25).select("id", F.md5("seq").alias("seq"))


@query("mask_similar", sql("contigs", """, al as (select contig as id, (contig * 7) % 90 + 1 as a, (contig * 7) % 90 + 41 as b from contigs where length(seq) > 0)
select contig as id, md5(case when a is null or length(seq) < a then seq else substr(seq, 1, (a - 1)::int) || substr(repeat('N', (b - a + 1)::int), 1, (length(seq) - a + 1)::int) || substr(seq, (b + 1)::int) end) as seq from contigs left join al on al.id = contig"""))
def mask_similar(spark, sf):
    s = seqs(spark, sf)
    al = s.where("length(seq) > 0").select((F.col("id") - 1).alias("query"), F.col("id").alias("subject"), F.lit(41).alias("align_len"), F.lit(90.0).alias("identity"),
                                                          ((F.col("id") * 7) % 90 + 41).alias("s_start"), ((F.col("id") * 7) % 90 + 1).alias("s_end"))
    return ge.mask_similar(s, al).select("id", F.md5("seq").alias("seq"))


def upstream(spark, sf):
    return ge.promoter_window(t.features(spark, sf), t.contigs(spark, sf), "upstream", (-20, 150))


@query("mask_overlaps")
def mask_overlaps(spark, sf):
    wide = ge.promoter_window(t.features(spark, sf), t.contigs(spark, sf), "upstream", (0, 600))
    return ge.mask_overlaps(wide).select("id", F.length(F.regexp_replace("seq", "[^N]", "")).alias("n_masked"))


@query("filter_sequences")
def filter_sequences(spark, sf):
    return ge.filter_sequences(upstream(spark, sf), (-20, 150), overlaps=True, min_length=24).select("id", "seq")


DRAWN = "floor(((('0x' || substr(md5(id || '|' || i || '|1'), 1, 13))::bigint::double + 0.5::double) / 4503599627370496.0::double) * 12)::int"
LETTERS = " ".join(f"when '{c}' then substr('{v}', 1 + u // {12 // len(v)}, 1)" for c, v in ge.DEGENERATE.items())


@query("degenerate_resolve", f"""with d as (select doc_id as id, upper(regexp_replace(text, '[^ACGTRYKMSWN]', '', 'gi')) as s from documents), l as (select id, i, substr(s, i + 1, 1) as c, {DRAWN} as u from (select id, s, unnest(range(len(s))) as i from d)),
r as (select id, string_agg(case c {LETTERS} else c end, '' order by i) as seq from l group by id) select d.id, coalesce(seq, '') as seq from d left join r using (id)""")
def degenerate_resolve(spark, sf):
    raw = t.read(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.upper(F.regexp_replace("text", "(?i)[^ACGTRYKMSWN]", "")).alias("seq"))
    return ge.degenerate_resolve(raw)


@query("prep_motif_input", sql("contigs", "select contig as id, md5(seq) as seq, coalesce(quality, 0)::double as weight from contigs left join labels on doc_id = contig where length(seq) >= 24"))
def prep_motif_input(spark, sf):
    w = t.read(spark, sf, "labels").select(F.col("doc_id").alias("id"), F.col("quality").cast("double").alias("weight"))
    return mo.prep_motif_input(seqs(spark, sf), 24, w).select("id", F.md5("seq").alias("seq"), "weight")


@query("position_priors")
def position_priors(spark, sf):
    e = t.read(spark, sf, "embeddings").select("vec_id", F.transform("embedding", lambda x: F.abs(x).cast("double")).alias("p"))
    return e.select("vec_id", mo.normalize_priors("p").alias("p"))


@query("consensus", sql("pssm", """, b as (select k, mot, pos, greatest(a, c, g, t) v, case greatest(a, c, g, t) when a then 'A' when c then 'C' when g then 'G' else 'T' end l from pssm)
select k, mot, string_agg(case when v < 0.4 then 'n' when v < 0.7 then lower(l) else l end, '' order by pos) as consensus from b group by 1, 2"""))
def consensus(spark, sf):
    return mo.consensus(t.pssm(spark, sf))


def _sharp(spark, sf):
    """The same matrices sharpened, so that letters pass the cutoffs."""
    p = t.pssm(spark, sf)
    s = sum((F.pow(x, F.lit(4.0)) for x in "acgt"), F.lit(0.0))
    return p.select("k", "mot", "pos", *[(F.pow(x, F.lit(4.0)) / s).alias(x) for x in "acgt"])


SHARP = ", sh as (select k, mot, pos, pow(a,4)/(pow(a,4)+pow(c,4)+pow(g,4)+pow(t,4)) a, pow(c,4)/(pow(a,4)+pow(c,4)+pow(g,4)+pow(t,4)) c, pow(g,4)/(pow(a,4)+pow(c,4)+pow(g,4)+pow(t,4)) g, pow(t,4)/(pow(a,4)+pow(c,4)+pow(g,4)+pow(t,4)) t from pssm)"
RX = """, o as (select k, mot, pos, concat(case when a > 0.5 then 'A' end, case when c > 0.5 then 'C' end, case when g > 0.5 then 'G' end, case when t > 0.5 then 'T' end) hi, concat(case when a > 0.3 then 'A' end, case when c > 0.3 then 'C' end, case when g > 0.3 then 'G' end, case when t > 0.3 then 'T' end) lo,
(case when a > 0.3 then a else 0 end) + (case when c > 0.3 then c else 0 end) + (case when g > 0.3 then g else 0 end) + (case when t > 0.3 then t else 0 end) m from sh),
p as (select k, mot, pos, case when length(hi) = 1 then hi when length(lo) >= 2 and m > 0.5 then '[' || lo || ']' when length(lo) >= 2 and m > 0.3 then '[' || lower(lo) || ']' when length(lo) = 1 then lower(lo) else '[ACGT]' end as ch from o)"""


@query("consensus_regex", sql("pssm", SHARP + RX + "select k, mot, string_agg(ch, '' order by pos) as pattern from p group by 1, 2"))
def consensus_regex(spark, sf):
    return mo.consensus_regex(_sharp(spark, sf), 0.5, 0.3)


@query("consensus_ambiguity", sql("pssm", SHARP + RX + """, cd as (select pos, k, mot, case when length(ch) = 1 then ch else coalesce(map {'AG':'R','GT':'K','CG':'S','CT':'Y','AC':'M','AT':'W','CGT':'B','ACT':'H','AGT':'D','ACG':'V','ACGT':'N'}[upper(ch[2:-2])], '?') end c, ch from p)
select k, mot, string_agg(case when length(ch) > 1 and ch = lower(ch) then lower(c) else c end, '' order by pos) as pattern from cd group by 1, 2"""))
def consensus_ambiguity(spark, sf):
    return mo.consensus_regex(_sharp(spark, sf), 0.5, 0.3, regex=False)


ENT = " + ".join(f"-(case when {x} = 0 then 1e-5 else {x} end) * log2(case when {x} = 0 then 1e-5 else {x} end)" for x in "acgt")


@query("information_content", sql("pssm", f"select k, mot, pos, round({ENT}, 6) as entropy from pssm"))
def information_content(spark, sf):
    return mo.information_content(t.pssm(spark, sf)).select("k", "mot", "pos", *r6("entropy"))


def _pairs(spark, sf):
    m = t.pssm(spark, sf).select("k").distinct()
    return m.select(F.col("k").alias("pair"), F.col("k").alias("k1"), F.lit(1).alias("mot1"), F.col("k").alias("k2"), F.lit(2).alias("mot2"))


def _cmp_sql(score, rev=False):
    second = "select k, mot, 9 - pos as pos, t as a, g as c, c as g, a as t from pssm" if rev else "select * from pssm"
    return sql("pssm", f""", y as ({second}), j as (select x.k as pair, y.pos - x.pos as "offset", x.a xa, x.c xc, x.g xg, x.t xt, y.a ya, y.c yc, y.g yg, y.t yt from pssm x join y on x.k = y.k and x.mot = 1 and y.mot = 2)
select pair, "offset", count(*) as overlap, round(avg({score}), 6) as score from j group by 1, 2 having count(*) >= 6""")


PEAR = "(xa*ya+xc*yc+xg*yg+xt*yt - 0.25) / nullif(sqrt((xa*xa+xc*xc+xg*xg+xt*xt - 0.25) * (ya*ya+yc*yc+yg*yg+yt*yt - 0.25)), 0)"
EUC = "-sqrt((xa-ya)*(xa-ya)+(xc-yc)*(xc-yc)+(xg-yg)*(xg-yg)+(xt-yt)*(xt-yt))"


def info_sql(p):
    return "(2" + "".join(f" + greatest({p}{x}, 1e-5) * log2(greatest({p}{x}, 1e-5))" for x in "acgt") + ")"


@query("compare_pssms_pearson", _cmp_sql(PEAR))
def compare_pssms_pearson(spark, sf):
    return mo.compare_pssms(_pairs(spark, sf), t.pssm(spark, sf)).select("pair", "offset", "overlap", *r6("score"))


@query("compare_pssms_euclid_reverse", _cmp_sql(EUC, True))
def compare_pssms_euclid_reverse(spark, sf):
    return mo.compare_pssms(_pairs(spark, sf), t.pssm(spark, sf), "ed", reverse=True).select("pair", "offset", "overlap", *r6("score"))


@query("compare_pssms_weighted", _cmp_sql(f"({EUC}) * least({info_sql('x')}, {info_sql('y')}) / 2"))
def compare_pssms_weighted(spark, sf):
    return mo.compare_pssms(_pairs(spark, sf), t.pssm(spark, sf), "ed", weight=True).select("pair", "offset", "overlap", *r6("score"))


def rank_sql(p, x):
    """Rank of one letter's share among the four, ties shared, less one."""
    return "(" + " + ".join(f"case when {p}{o} < {p}{x} then 1.0::double when {p}{o} = {p}{x} then 0.5::double else 0 end" for o in "acgt" if o != x) + ")"


def rank_products(p, q):
    return " + ".join(f"{rank_sql(p, x)} * {rank_sql(q, x)}" for x in "acgt")


SPEAR = f"({rank_products('x', 'y')} - 9) / nullif(sqrt(({rank_products('x', 'x')} - 9) * ({rank_products('y', 'y')} - 9)), 0)"


@query("compare_pssms_spearman", _cmp_sql(SPEAR))
def compare_pssms_spearman(spark, sf):
    return mo.compare_pssms(_pairs(spark, sf), t.pssm(spark, sf), "spearman").select("pair", "offset", "overlap", *r6("score"))


SIM = """, rv as (select k, mot, 9 - pos as pos, t as a, g as c, c as g, a as t from pssm), y as (select *, '+' as o from pssm union all select *, '-' from rv),
al as (select x.k k1, x.mot mot1, y.k k2, y.mot mot2, y.o as orientation, y.pos - x.pos as "offset", count(*) overlap, avg(-sqrt((x.a-y.a)*(x.a-y.a)+(x.c-y.c)*(x.c-y.c)+(x.g-y.g)*(x.g-y.g)+(x.t-y.t)*(x.t-y.t))) score
from pssm x join y on (x.k < y.k or (x.k = y.k and x.mot < y.mot)) group by all having count(*) >= 4),
n as (select overlap, count(*) c from al group by 1), pl as (select n.overlap pool, m.overlap from n join n m on m.overlap = n.overlap or (n.c < 1000 and abs(m.overlap - n.overlap) = 1)),
tot as (select pool, sum(c) total from pl join n using (overlap) group by 1),
ps as (select pool, score from pl join al using (overlap)),
rk as (select a.*, (select count(*) from ps where ps.pool = a.overlap and ps.score > a.score + 1e-12) gt, total from al a join tot on pool = a.overlap)"""


@query("motif_similarity", sql("pssm", SIM + """select k1, mot1, k2, mot2, orientation, "offset"::int as "offset", overlap::int as overlap, round(score, 6) as score, 9 as n_tests, round(gt / total * 9 / 4, 6) as p_value from rk where gt < 0.2::double * (total - 1) and gt / total * 9 / 4 <= 0.2"""))
def motif_similarity(spark, sf):
    out = mo.motif_similarity(t.pssm(spark, sf), 4, 0.2)
    return out.select("k1", "mot1", "k2", "mot2", "orientation", "offset", "overlap", F.round("score", 6).alias("score"), "n_tests", *r6("p_value"))


def similar(spark, sf):
    return mo.motif_similarity(t.pssm(spark, sf), 4, 0.3)


@query("symmetrize_pairs", """with p as (select l_partkey % 40 as k1, l_linenumber as mot1, l_suppkey % 40 as k2, l_linenumber as mot2, l_discount + l_tax / 1000 as p_value, l_orderkey as q from lineitem where l_partkey % 40 <> l_suppkey % 40),
s as (select least(k1, k2) k1, mot1, greatest(k1, k2) k2, mot2, p_value, q from p) select k1, mot1, k2, mot2, round(min(p_value), 6) as p_value, arg_min(q, (p_value * 1e6)::bigint * 1000000 + q) as q from s group by 1, 2, 3, 4""")
def symmetrize_pairs(spark, sf):
    li = t.read(spark, sf, "lineitem").where("l_partkey % 40 <> l_suppkey % 40")
    p = li.select((F.col("l_partkey") % 40).alias("k1"), F.col("l_linenumber").alias("mot1"), (F.col("l_suppkey") % 40).alias("k2"), F.col("l_linenumber").alias("mot2"),
                  (F.col("l_discount") + F.col("l_tax") / 1000).alias("p_value"), F.col("l_orderkey").alias("q"))
    return mo.symmetrize_pairs(p).select("k1", "mot1", "k2", "mot2", F.round("p_value", 6).alias("p_value"), "q")


@query("cluster_motifs")
def cluster_motifs(spark, sf):
    sim = similar(spark, sf)
    name = lambda k, m: F.concat_ws("_", F.col(k).cast("string"), F.col(m).cast("string"))
    pairs = sim.select(name("k1", "mot1").alias("a"), name("k2", "mot2").alias("b"), F.col("p_value").alias("p"))
    return mo.cluster_motifs(pairs, 0.7, 2)


@query("combined_pssm")
def combined_pssm(spark, sf):
    sim = mo.symmetrize_pairs(similar(spark, sf)).withColumn("grp", F.col("k1")).withColumn("first", F.lit(1)).where("mot1 = 1")
    return mo.combined_pssm(sim, t.pssm(spark, sf))


def motif_table(spark, sf):
    p = t.pssm(spark, sf)
    return p.groupBy("k", "mot").agg(F.max("pos").alias("width"), F.lit(20).cast("long").alias("nsites"), F.max(F.col("a")).alias("e_value"))


MOT = ", mt as (select k, mot, max(pos) width, 20::bigint nsites, max(a) e_value from pssm group by 1, 2)"


@query("filter_motifs", sql("pssm dense dense_rows", MOT + ", rs as (select k, avg(value * value) resid from dense join dense_rows using (row_id) group by 1) select k, mot, width, nsites, round(e_value, 6) as e_value, round(resid, 6) as resid from mt join rs using (k) where e_value <= 0.5 and resid <= 0.0157"))
def filter_motifs(spark, sf):
    rs = t.dense(spark, sf).join(t.dense_rows(spark, sf), "row_id").groupBy("k").agg(F.avg(F.col("value") * F.col("value")).alias("resid"))
    return mo.filter_motifs(motif_table(spark, sf), rs, 0.5, 0.0157).select("k", "mot", "width", "nsites", *r6("e_value", "resid"))


@query("choose_palindrome", sql("pssm", MOT + """, pal as (select k, mot, width, nsites, e_value * 1.5 e_value from mt), ch as (select k, (select min(e_value) from pal p where p.k = m.k) < sqrt(min(e_value)) as is_pal from mt m group by k)
select k, mot, width, nsites, round(e_value, 6) as e_value, is_pal from (select * from mt join ch using (k) where not is_pal union all select * from pal join ch using (k) where is_pal)"""))
def choose_palindrome(spark, sf):
    m = motif_table(spark, sf)
    return mo.choose_palindrome(m, m.withColumn("e_value", F.col("e_value") * 1.5)).select("k", "mot", "width", "nsites", *r6("e_value"), "is_pal")


@query("motif_pvalue_matrix", sql("hits", "select row_id, " + ", ".join(f'round(min(pvalue) filter (where k = {k}), 8) as "{k}"' for k in range(t.HIT_CLUSTERS)) + " from hits group by 1"))
def motif_pvalue_matrix(spark, sf):
    ks = list(range(t.HIT_CLUSTERS))
    return mo.motif_pvalue_matrix(t.hits(spark, sf), ks).select("row_id", *[F.round(F.col(str(k)), 8).alias(str(k)) for k in ks])


#: Hits of the eight-letter motifs: all words with their score and the share of words at least as good, then the windows that are such words.
SCAN = (
    """
, up as (select id, f.contig, strand, case strand when 'D' then start_pos - 1 - 150 else end_pos + 1 - 20 end as a, case strand when 'D' then start_pos - 1 + 20 else end_pos + 1 + 150 end as b, seq from features f join contigs using (contig)),
cut as (select id, strand, substr(seq, greatest(a, 1)::int, greatest(b - greatest(a, 1) + 1, 0)::int) as s from up),
turned as (select id, strand, case when strand = 'R' then reverse(translate(s, 'ATCG', 'TAGC')) else s end as q from cut),
sq as (select id, case when length(q) > 170 then case when strand = 'D' then substr(q, 1, 170) else right(q, 170) end else q end as seq from turned),
lo as (select k, mot, pos, x, log2((f + 0.01) / (a + c + g + t + 0.04) / 0.25) as v from pssm, lateral (select unnest(['A', 'C', 'G', 'T']) as x, unnest([a, c, g, t]) as f)),
w1 as (select k, mot, x as word, v, round(v / 0.01)::bigint as i from lo where pos = 1)"""
    + "".join(f", w{j} as (select k, mot, word || x as word, w{j - 1}.v + lo.v as v, i + round(lo.v / 0.01)::bigint as i from w{j - 1} join lo using (k, mot) where pos = {j})" for j in range(2, 9))
    + f"""
, tail as (select k, mot, word, v, count(*) over (partition by k, mot order by i desc) / 65536.0::double as p from w8),
good as (select k, mot, word, '+' as strand, v, p from tail where p <= {mo.SCAN_CUTOFF} union all select k, mot, reverse(translate(word, 'ATCG', 'TAGC')), '-', v, p from tail where p <= {mo.SCAN_CUTOFF}),
win as (select id, i::int as pos, substr(seq, i::int, 8) as word from (select id, seq, unnest(range(1, length(seq) - 6)) as i from sq where length(seq) >= 8)),
hit as (select id, k, mot, pos, strand, round(v, 6) as score, p from win join good using (word) qualify row_number() over (partition by id, k, mot order by round(v, 6) desc, pos, strand) = 1)
"""
)


@query("scan_pssm", sql("features contigs pssm", SCAN + "select id, k, mot, pos, strand, score, round(p, 8) as pvalue from hit"))
def scan_pssm(spark, sf):
    hits = mo.scan_pssm(upstream(spark, sf).select("id", "seq"), t.pssm(spark, sf))
    return hits.select("id", "k", "mot", "pos", "strand", *r6("score"), F.round("pvalue", 8).alias("pvalue"))


@query("scan_sequence_pvalue", sql("features contigs pssm", SCAN + "select id, k, mot, pos, strand, score, round(1 - pow(1 - p, 2 * greatest(length(seq) - 7, 1)), 6) as pvalue from hit join sq using (id)"))
def scan_sequence_pvalue(spark, sf):
    s = upstream(spark, sf).select("id", "seq")
    hits = mo.sequence_pvalue(mo.scan_pssm(s, t.pssm(spark, sf), sizes=True))
    return hits.select("id", "k", "mot", "pos", "strand", *r6("score", "pvalue"))


@query("motif_positions")
def motif_positions(spark, sf):
    s = upstream(spark, sf).select("id", "seq")
    return mo.motif_positions(mo.scan_pssm(s, t.pssm(spark, sf), sizes=True), None, motif_table(spark, sf), 1.0, 0.05, 20)


def _seq_clusters(spark, sf):
    """Clusters of about 80 features: their number grows with the features, so none reaches the operators' size limit."""
    f = t.features(spark, sf)
    clusters = max(40, f.count() // 80)
    return f.select(F.pmod(F.crc32("id"), F.lit(clusters)).cast("int").alias("k"), F.col("id").alias("row_id"))


@query("kmer_enrichment")
def kmer_enrichment(spark, sf):
    return mo.kmer_enrichment(upstream(spark, sf).select("id", "seq"), _seq_clusters(spark, sf), 6, max_size=100_000)


@query("discover_kmers")
def discover_kmers(spark, sf):
    return mo.discover_kmers(upstream(spark, sf).select("id", "seq"), _seq_clusters(spark, sf), 6, max_size=100_000)[1]


@query("changed_clusters", sql("history", """, a as (select k, iter, count(*) n, sum(row_id) s, sum(row_id * row_id) s2 from history group by 1, 2) select distinct b.k from a b left join a p on p.k = b.k and p.iter = 1 where b.iter = 2 and (p.n is null or p.n <> b.n or p.s <> b.s or p.s2 <> b.s2)"""))
def changed_clusters(spark, sf):
    h = t.history(spark, sf)
    return mo.changed_clusters(h.where("iter = 1").select("k", "row_id"), h.where("iter = 2").select("k", "row_id"))


@query("motif_lines", sql("pssm", MOT + """, h as (select k, mot, unnest([0, 1, 2, 3]) as ord, unnest(['', printf('MOTIF bic_%03d_%02d', k, mot), printf('BL   MOTIF bic_%03d_%02d width=0 seqs=0', k, mot), printf('letter-probability matrix: alength= 4 w= %d nsites= %d E= %.3e', width, nsites, e_value)]) as line from mt)
select k, mot, ord, line from h union all select k, mot, pos + 3, printf('%5.3f %5.3f %5.3f %5.3f', a, c, g, t) from pssm"""))
def motif_lines(spark, sf):
    return mo.motif_lines(motif_table(spark, sf), t.pssm(spark, sf))
