"""Named inputs derived from the given tables, once as DataFrames and once as SQL for the oracle.

Every frame here is a plain linear derivation of a whole table; nothing is sampled or capped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def brand_no(col: str = "p_brand") -> Column:
    return F.regexp_extract(col, "([0-9]+)", 1).cast("int")


def dense(spark, sf):
    """One row per vector and dimension."""
    return read(spark, sf, "embeddings").select(
        F.col("vec_id").alias("row_id"), F.posexplode("embedding").alias("col_id", "_x")
    ).select("row_id", "col_id", F.col("_x").cast("double").alias("value"))


def dense_rows(spark, sf):
    return read(spark, sf, "embeddings").select(F.col("label").alias("k"), F.col("vec_id").alias("row_id"))


def dense_cols(spark, sf):
    cols = dense(spark, sf).select("col_id").distinct()
    return cols.select(F.explode(F.array(F.col("col_id") % 10, (F.col("col_id") + 9) % 10)).alias("k"), "col_id")


def _priced(spark, sf):
    li = read(spark, sf, "lineitem").where(F.col("l_quantity") > 0)
    return li.select(
        F.col("l_returnflag").alias("mat"),
        F.col("l_partkey").alias("row_id"),
        (F.year("l_shipdate") * 4 + F.quarter("l_shipdate")).cast("int").alias("col_id"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("_p"),
    )


def sparse(spark, sf):
    """Parts by ship quarter with missing cells."""
    return _priced(spark, sf).groupBy("row_id", "col_id").agg(F.log(F.avg("_p")).alias("value"))


def multi(spark, sf):
    return _priced(spark, sf).groupBy("mat", "row_id", "col_id").agg(F.log(F.avg("_p")).alias("value"))


def sparse_rows(spark, sf):
    return read(spark, sf, "part").select(brand_no().alias("k"), F.col("p_partkey").alias("row_id"))


def sparse_cols(spark, sf):
    cols = _priced(spark, sf).select("col_id").distinct()
    return cols.select(F.explode(F.sequence(F.col("col_id") % 5, F.lit(25), F.lit(5))).alias("k"), "col_id")


def raw_edges(spark, sf):
    """Part-to-supplier lines and part-to-order lines as two raw edge lists with duplicates."""
    li = read(spark, sf, "lineitem")
    ship = li.select(F.lit("ship").alias("net"), F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst"),
                     F.lit(1.0).alias("weight"))
    order = li.select(F.lit("order").alias("net"), F.col("l_partkey").alias("src"),
                      (F.col("l_orderkey") % 2000).alias("dst"), F.col("l_quantity").alias("weight"))
    return ship.unionByName(order)


def edges(spark, sf):
    return (raw_edges(spark, sf).where("src <> dst").groupBy("net", "src", "dst")
            .agg(F.sum("weight").alias("weight")))


#: Clusters of ``hits``.
HIT_CLUSTERS = 25


def hits(spark, sf):
    li = read(spark, sf, "lineitem")
    return li.groupBy((F.col("l_suppkey") % HIT_CLUSTERS).cast("int").alias("k"), F.col("l_partkey").alias("row_id")).agg(
        F.min((F.col("l_discount") + 0.001) * (F.col("l_tax") + 0.01)).alias("pvalue"))


def contigs(spark, sf):
    text = F.lower(F.regexp_replace("text", "[^A-Za-z]", ""))
    return read(spark, sf, "documents").select(
        F.col("doc_id").alias("contig"),
        F.translate(text, "abcdefghijklmnopqrstuvwxyz", "ACGTACGTACGTACGTACGTACGTAC").alias("seq"))


def features(spark, sf):
    c = contigs(spark, sf).where(F.length("seq") >= 500)
    starts = c.select("contig", F.posexplode(F.sequence(F.lit(300), F.length("seq") - 200, F.lit(500))).alias("i", "start_pos"))
    return starts.select(
        F.concat_ws(".", F.col("contig").cast("string"), F.col("i").cast("string")).alias("id"),
        "contig", F.when(F.col("i") % 2 == 0, "D").otherwise("R").alias("strand"),
        F.col("start_pos").cast("long").alias("start_pos"), (F.col("start_pos") + 199).cast("long").alias("end_pos"))


def pssm(spark, sf):
    """Letter frequencies of the eight letters behind every anchor word, over the whole sequences of each 100 documents.

    The number of motifs grows with the documents.
    """
    c = contigs(spark, sf).select(F.floor(F.col("contig") / 100).cast("int").alias("k"), "seq")
    site = None
    for mot, anchor in ((1, "GAT"), (2, "CCA")):
        behind = F.split("seq", anchor)
        part = c.select("k", F.lit(mot).alias("mot"), F.explode(F.slice(behind, F.lit(2), F.size(behind))).alias("s")).where(F.length("s") >= 8)
        site = part if site is None else site.unionByName(part)
    letter = site.select("k", "mot", F.posexplode(F.split(F.substring("s", 1, 8), "")).alias("pos", "b"))
    freq = [F.avg((F.col("b") == x).cast("double")).alias(x.lower()) for x in "ACGT"]
    return letter.groupBy("k", "mot", (F.col("pos") + 1).alias("pos")).agg(*freq)


def annotation(spark, sf):
    return read(spark, sf, "part").select(F.col("p_type").alias("term"), F.col("p_partkey").alias("row_id"),
                                          F.lower("p_type").alias("term_name"), F.lit("P").alias("ontology"))


def history(spark, sf):
    """Membership history: iteration = day, cluster = event type, row = user."""
    ev = read(spark, sf, "events")
    k = F.pmod(F.crc32(F.col("event_type")), F.lit(5)).cast("int")
    return ev.select(F.dayofmonth("ts").alias("iter"), F.ascii("event_type").alias("k"),
                     F.col("user_id").alias("row_id")).distinct()


def series(spark, sf):
    """Daily mean value per event type; the previous day is the previous column."""
    ev = read(spark, sf, "events")
    return ev.groupBy(F.col("event_type").alias("series"), F.dayofmonth("ts").alias("time")).agg(
        F.avg("value").alias("value"))


SQL = {
    "dense": "select vec_id as row_id, unnest(range(len(embedding)))::int as col_id, unnest(embedding)::double as value from embeddings",
    "dense_rows": "select label as k, vec_id as row_id from embeddings",
    "dense_cols": "select unnest([col_id % 10, (col_id + 9) % 10]) as k, col_id from (select distinct unnest(range(len(embedding)))::int as col_id from embeddings)",
    "sparse": "select l_partkey as row_id, (year(l_shipdate)*4+quarter(l_shipdate))::int as col_id, ln(avg(l_extendedprice/l_quantity)) as value from lineitem where l_quantity > 0 group by 1, 2",
    "multi": "select l_returnflag as mat, l_partkey as row_id, (year(l_shipdate)*4+quarter(l_shipdate))::int as col_id, ln(avg(l_extendedprice/l_quantity)) as value from lineitem where l_quantity > 0 group by 1, 2, 3",
    "sparse_rows": "select regexp_extract(p_brand, '[0-9]+')::int as k, p_partkey as row_id from part",
    "sparse_cols": "select unnest(generate_series(col_id % 5, 25, 5))::int as k, col_id from (select distinct (year(l_shipdate)*4+quarter(l_shipdate))::int as col_id from lineitem where l_quantity > 0)",
    "raw_edges": "select 'ship' as net, l_partkey as src, l_suppkey as dst, 1.0::double as weight from lineitem union all select 'order', l_partkey, l_orderkey % 2000, l_quantity from lineitem",
    "edges": "select net, src, dst, sum(weight) as weight from raw_edges where src <> dst group by 1, 2, 3",
    "hits": "select (l_suppkey % 25)::int as k, l_partkey as row_id, min((l_discount + 0.001::double) * (l_tax + 0.01::double)) as pvalue from lineitem group by 1, 2",
    "contigs": "select doc_id as contig, translate(lower(regexp_replace(text, '[^A-Za-z]', '', 'g')), 'abcdefghijklmnopqrstuvwxyz', 'ACGTACGTACGTACGTACGTACGTAC') as seq from documents",
    "features": "select contig || '.' || i as id, contig, case when i % 2 = 0 then 'D' else 'R' end as strand, (300 + 500*i)::bigint as start_pos, (499 + 500*i)::bigint as end_pos from (select contig, unnest(range((length(seq) - 500) // 500 + 1)) as i from contigs where length(seq) >= 500)",
    "pssm": "select k, mot, pos, avg((b='A')::int::double) as a, avg((b='C')::int::double) as c, avg((b='G')::int::double) as g, avg((b='T')::int::double) as t from (select k, mot, p.pos, substr(s, p.pos, 1) as b from (select (contig // 100)::int as k, w.mot, unnest(string_split(seq, w.anchor)[2:]) as s from contigs, (values (1, 'GAT'), (2, 'CCA')) w(mot, anchor)), (values (1),(2),(3),(4),(5),(6),(7),(8)) p(pos) where length(s) >= 8) group by 1, 2, 3",
    "annotation": "select p_type as term, p_partkey as row_id, lower(p_type) as term_name, 'P' as ontology from part",
    "history": "select distinct day(ts)::int as iter, ascii(event_type)::int as k, user_id as row_id from events",
    "series": "select event_type as series, day(ts)::int as \"time\", avg(value) as value from events group by 1, 2",
    "row_score": "select row_id, k, ln(avg((x.value - m.mu)*(x.value - m.mu)) + 1e-99::double) as score from (select s.row_id, c.k, s.col_id, s.value from sparse s join sparse_cols c using (col_id)) x join (select r.k, s.col_id, avg(s.value) as mu from sparse s join sparse_rows r using (row_id) group by 1, 2) m using (k, col_id) group by 1, 2",
    "dense_score": "select row_id, k, ln(avg((x.value - m.mu)*(x.value - m.mu)) + 1e-99::double) as score from (select s.row_id, c.k, s.col_id, s.value from dense s join dense_cols c using (col_id)) x join (select r.k, s.col_id, avg(s.value) as mu from dense s join dense_rows r using (row_id) group by 1, 2) m using (k, col_id) group by 1, 2",
    "dense_col_score": "select k, col_id, var_pop(value) / (abs(avg(value)) + 0.01::double) as score from dense join dense_rows using (row_id) group by 1, 2 having count(*) >= 2",
}

NEEDS = {
    "edges": ["raw_edges"], "features": ["contigs"], "pssm": ["contigs"],
    "row_score": ["sparse", "sparse_rows", "sparse_cols"],
    "dense_score": ["dense", "dense_rows", "dense_cols"],
    "dense_col_score": ["dense", "dense_rows"],
}


def sql(uses: str, body: str) -> str:
    """Prefix ``body`` with the common table expressions it uses."""
    done: list[str] = []

    def add(name: str) -> None:
        for dep in NEEDS.get(name, []):
            add(dep)
        if name not in done:
            done.append(name)

    for name in uses.split():
        add(name)
    head = ", ".join(f"{n} as materialized ({SQL[n]})" for n in done)
    body = body.strip()
    if head and body.lower().startswith("with "):
        return f"with {head}, {body[5:]}"
    return f"with {head} {body}" if head else body
