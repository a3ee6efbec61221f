"""Readers for the delimited and sequence files the engine takes. Schemas are explicit, never inferred."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions.order import carry_forward


def text_lines(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """(file, block, seq, value): lines with a key that restores their order within a file."""
    df = spark.read.text(path)
    return df.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("seq"), "value")


def _number(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return c.try_cast("double")


def tab_columns(spark: SparkSession, path: str, names: Sequence[str], sep: str = "\t", header: bool = False, comment: str | None = None) -> DataFrame:
    """Text columns with given names."""
    opts = {"sep": sep, "header": str(header).lower(), "enforceSchema": "true"}
    if comment:
        opts["comment"] = comment
    return spark.read.schema(", ".join(f"`{n}` string" for n in names)).options(**opts).csv(path)


def read_matrix(spark: SparkSession, path: str) -> DataFrame:
    """(row_id, col_id, value) from a tab file with header: the first text column is the row id, a second
    text column is dropped, the rest are numbers; anything not numeric is a missing cell."""
    names = spark.read.text(path).first()["value"].split("\t")
    df = tab_columns(spark, path, names, header=True)
    texty = df.agg(*[F.count(F.when(F.col(f"`{c}`").isNotNull() & (F.col(f"`{c}`") != "NA") & _number(F.col(f"`{c}`")).isNull(), 1)).alias(f"t{i}") for i, c in enumerate(names[:2])]).first()
    text_cols = [c for i, c in enumerate(names[:2]) if texty[f"t{i}"] > 0]
    rid = text_cols[0] if text_cols else names[0]
    values = [c for c in names if c != rid and c not in text_cols[1:]]
    long = df.select(F.col(f"`{rid}`").alias("row_id"), *[_number(F.col(f"`{c}`")).alias(c) for c in values]).unpivot(["row_id"], values, "col_id", "value")
    return long.where(F.col("value").isNotNull() & ~F.isnan("value"))


def read_geo_series(spark: SparkSession, paths: str | Sequence[str], titles: bool = True, name: str = r"([^/]+?)(\.txt)?(\.gz)?$") -> DataFrame:
    """(mat, row_id, col_id, value): one matrix per series file, named by the first group of ``name``.

    Lines with ``!`` are comments; the id is the text before the first bar; sample titles may name the
    columns. Header, title and data lines are told apart by prefix and joined by column position.
    """
    lines = text_lines(spark, paths).select(F.regexp_extract("file", name, 1).alias("mat"), F.regexp_replace("value", '"', "").alias("v")).where("v <> ''")
    fields = lines.withColumn("_a", F.split("v", "\t"))
    head = fields.where(F.col("v").startswith("ID_REF")).select("mat", F.posexplode("_a").alias("pos", "sample")).where("pos > 0")
    if titles:
        t = fields.where(F.col("v").startswith("!Sample_title")).select("mat", F.posexplode("_a").alias("pos", "title")).where("pos > 0")
        head = head.join(t, ["mat", "pos"], "left").select("mat", "pos", F.coalesce("title", "sample").alias("sample"))
    data = fields.where(~F.col("v").startswith("!") & ~F.col("v").startswith("ID_REF"))
    cells = data.select("mat", F.split_part(F.col("_a")[0], F.lit("|"), F.lit(1)).alias("row_id"), F.posexplode("_a").alias("pos", "x")).where("pos > 0")
    return cells.join(head, ["mat", "pos"]).select("mat", "row_id", F.col("sample").alias("col_id"), _number("x").alias("value")).where("value is not null")


FEATURE_FIELDS = ("id", "name", "contig", "strand", "start_pos", "end_pos", "description")


def _commented_table(spark: SparkSession, path: str) -> tuple[list[str], DataFrame]:
    """Field names of the ``-- id`` line and the split data lines of a table with ``--`` comments."""
    lines = spark.read.text(path)
    head = lines.where(F.col("value").startswith("-- id\t")).first()
    names = head["value"][3:].split("\t") if head else ["id"]
    return names, lines.where(~F.col("value").startswith("--") & (F.col("value") != "")).select(F.split("value", "\t").alias("_a"))


def read_features(spark: SparkSession, path: str, fallback: str | None = None) -> DataFrame:
    """Annotation table; an empty one is replaced by the ``fallback`` (coding sequence) table."""
    names, data = _commented_table(spark, path)
    if fallback and data.isEmpty():
        names, data = _commented_table(spark, fallback)
    pick = lambda f: F.get("_a", F.lit(names.index(f))) if f in names else F.lit(None).cast("string")
    return data.select(*[(pick(f).cast("long") if f.endswith("_pos") else pick(f)).alias(f) for f in FEATURE_FIELDS])


def read_feature_names(spark: SparkSession, path: str) -> DataFrame:
    """(id, name, type), distinct."""
    lines = spark.read.text(path).where(~F.col("value").startswith("--") & (F.col("value") != ""))
    a = F.split("value", "\t")
    return lines.select(F.get(a, F.lit(0)).alias("id"), F.get(a, F.lit(1)).alias("name"), F.get(a, F.lit(2)).alias("type")).distinct()


def read_contigs(spark: SparkSession, path: str, name: str = r"([^/]+?)\.raw(\.gz)?$", packed: bool = False) -> DataFrame:
    """(contig, seq): one raw file per contig, named by the first group of ``name``, upper case.

    Genomes of very many contigs come ``packed``: a file holds any number of raw files, each behind a line of ``>`` and
    its path. They are named and cleaned alike; a packed file is read in parallel and a contig costs no file.
    """
    if packed:
        raw = spark.read.option("lineSep", ">").text(path).where(F.col("value") != "")
        file, body = F.split_part("value", F.lit("\n"), F.lit(1)), F.regexp_replace("value", r"^[^\n]*\n?", "")
    else:
        raw = spark.read.text(path, wholetext=True)
        file, body = F.col("_metadata.file_path"), F.col("value")
    df = raw.select(F.regexp_extract(file, name, 1).alias("contig"), F.upper(F.regexp_replace(body, r"\s", "")).alias("seq"))
    return df.where("seq <> ''")


def features_on_contigs(features: DataFrame, contigs: DataFrame) -> DataFrame:
    return features.join(contigs.select("contig"), "contig", "left_semi")


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """(id, seq): records split on ``>``, so a large file is read in parallel."""
    rec = spark.read.option("lineSep", ">").text(path).where(F.trim("value") != "")
    return rec.select(F.trim(F.split_part("value", F.lit("\n"), F.lit(1))).alias("id"), F.regexp_replace(F.regexp_replace("value", r"^[^\n]*\n", ""), r"\s", "").alias("seq"))


def read_seq_csv(spark: SparkSession, path: str) -> DataFrame:
    return tab_columns(spark, path, ["id", "seq"], sep=",").select(F.upper("id").alias("id"), "seq")


def read_links(spark: SparkSession, path: str, net: str) -> DataFrame:
    """Three-column edge file."""
    return tab_columns(spark, path, ["src", "dst", "w"]).select(F.lit(net).alias("net"), "src", "dst", _number("w").alias("weight")).where("weight is not null")


def read_psimi_links(spark: SparkSession, path: str, score: str, net: str = "string") -> DataFrame:
    """Edges with the named score of the bar-separated ``key:value`` column 15; organism prefixes stripped."""
    df = tab_columns(spark, path, [f"c{i}" for i in range(1, 16)])
    strip = lambda c: F.regexp_replace(c, r"^string:[^.]*\.", "")
    w = F.regexp_extract("c15", rf"(?:^|\|){score}:([-0-9.eE]+)", 1)
    return df.select(F.lit(net).alias("net"), strip("c1").alias("src"), strip("c2").alias("dst"), _number(F.nullif(w, F.lit(""))).alias("weight")).where("weight is not null").distinct()


def read_links_by_org(spark: SparkSession, path: str, org: str, net: str = "string") -> DataFrame:
    """One organism's edges from a file of all organisms; the prefix test runs in the scan stage."""
    df = tab_columns(spark, path, ["a", "b", "w"], sep=" ")
    p = f"{org}."
    hit = df.where(F.col("a").startswith(p) & F.col("b").startswith(p))
    cut = lambda c: F.substr(c, F.lit(len(p) + 1))
    return hit.select(F.lit(net).alias("net"), cut("a").alias("src"), cut("b").alias("dst"), _number("w").alias("weight"))


def read_sif(spark: SparkSession, path: str, net: str) -> DataFrame:
    """Two or three columns; a numeric middle column is the weight scaled to a maximum of 1000, otherwise
    every weight is 1000; a missing weight is 0."""
    a = F.split(F.trim("value"), r"[\s,]+")
    df = spark.read.text(path).where(F.trim("value") != "").select(a.alias("_a"))
    three = F.size("_a") >= 3
    rows = df.select(F.col("_a")[0].alias("src"), F.when(three, F.get("_a", F.lit(2))).otherwise(F.get("_a", F.lit(1))).alias("dst"), F.when(three, F.get("_a", F.lit(1))).alias("_t"))
    rows = rows.withColumn("_w", F.when(F.col("_t") == "NA", F.lit(0.0)).otherwise(_number("_t")))
    st = rows.agg(F.max("_w").alias("top"), F.count(F.when(F.col("_t").isNotNull() & F.col("_w").isNull(), 1)).alias("text")).first()
    if not st["top"] or st["text"]:
        return rows.select(F.lit(net).alias("net"), "src", "dst", F.lit(1000.0).alias("weight"))
    return rows.select(F.lit(net).alias("net"), "src", "dst", (F.coalesce("_w", F.lit(0.0)) / st["top"] * 1000).alias("weight"))


def read_prolinks(spark: SparkSession, links: str, names: str) -> DataFrame:
    """Edges by id joined twice to names; one network per method."""
    e = tab_columns(spark, links, ["a", "b", "method", "w"])
    n = tab_columns(spark, names, ["id", "name"])
    j = e.join(n.select(F.col("id").alias("a"), F.col("name").alias("src")), "a").join(n.select(F.col("id").alias("b"), F.col("name").alias("dst")), "b")
    return j.select(F.concat(F.lit("prolinks."), "method").alias("net"), "src", "dst", _number("w").alias("weight"))


def read_predictome(spark: SparkSession, paths: dict[str, str], species: str) -> DataFrame:
    """Files by method, one species, weight 1."""
    out = None
    for method, path in paths.items():
        df = tab_columns(spark, path, ["species", "src", "dst"]).where(F.col("species") == species)
        part = df.select(F.lit(f"predictome.{method}").alias("net"), "src", "dst", F.lit(1.0).alias("weight"))
        out = part if out is None else out.unionByName(part)
    return out


def read_operon_pairs(spark: SparkSession, path: str) -> DataFrame:
    """(src, dst) gene pairs of one operon: blank system names come from the previous row, else the short name."""
    lines = text_lines(spark, path).where("value <> ''")
    a = lines.withColumn("_a", F.split("value", "\t"))
    names = lines.where(F.col("value").contains("SysName1") & F.col("value").contains("bOp")).first()["value"].split("\t")
    col = lambda f: F.nullif(F.get("_a", F.lit(names.index(f))), F.lit(""))
    rows = a.where(~F.col("value").startswith(names[0] + "\t")).select("file", "block", "seq", *[col(f).alias(f) for f in ("SysName1", "SysName2", "Name1", "Name2", "bOp")])
    for f in ("SysName1", "SysName2"):
        rows = carry_forward(rows, [], ["file", "block", "seq"], F.col(f), "_f").drop(f).withColumnRenamed("_f", f)
    good = rows.where(F.upper("bOp") == "TRUE")
    return good.select(F.coalesce("SysName1", "Name1").alias("src"), F.coalesce("SysName2", "Name2").alias("dst")).where("src is not null and dst is not null")


def read_thesaurus(spark: SparkSession, path: str) -> DataFrame:
    """(row_id, alias) from id and a semicolon list, upper case."""
    df = tab_columns(spark, path, ["id", "names"], sep=",")
    return df.select(F.upper("id").alias("row_id"), F.explode(F.split(F.upper("names"), r"\s*;\s*")).alias("alias")).where("alias <> ''")


def read_gene_lists(spark: SparkSession, path: str) -> DataFrame:
    """(k, name): one set per line, split on blank, tab or comma, numbered in file order."""
    from tessella.functions.order import indexed

    lines = indexed(text_lines(spark, path).where(F.trim("value") != ""), [], ["file", "block", "seq"], "_k")
    return lines.select(F.col("_k").cast("int").alias("k"), F.explode(F.split("value", r"[ \t,]")).alias("name")).where("name <> ''")


def read_cog_codes(spark: SparkSession, path: str, org: str) -> DataFrame:
    """(gene, code): the bracketed category letter of the last header line before each ``ORG:`` line."""
    lines = text_lines(spark, path)
    head = F.nullif(F.regexp_extract("value", r"^\[([A-Z])[A-Z]*\]\s*COG", 1), F.lit(""))
    filled = carry_forward(lines, [], ["file", "block", "seq"], head, "code")
    genes = F.regexp_extract("value", rf"^\s+{org}:\s+(.*)$", 1)
    hit = filled.where(F.col("value").rlike(rf"^\s+{org}:"))
    return hit.select(F.explode(F.split(F.trim(genes), r"\s+")).alias("gene"), "code").select(F.upper("gene").alias("gene"), "code").where("gene <> ''")


def assign_codes(ids: DataFrame, codes: DataFrame, alias: DataFrame | None = None) -> DataFrame:
    """(row_id, code) for every id, NULL when none; aliases reach ids the file names differently."""
    direct = ids.select("row_id", F.upper("row_id").alias("gene"))
    if alias is not None:
        direct = direct.unionByName(alias.select("row_id", F.upper("alias").alias("gene"))).distinct()
    best = direct.join(codes, "gene").groupBy("row_id").agg(F.min("code").alias("code"))
    return ids.select("row_id").distinct().join(best, "row_id", "left")


def read_matrix_mo(spark: SparkSession, path: str) -> DataFrame:
    return read_matrix(spark, path)


def read_genome_info_mo(spark: SparkSession, path: str) -> DataFrame:
    """Tab annotation with header: locus, name, scaffold, start, stop, strand, description."""
    names = spark.read.text(path).first()["value"].split("\t")
    df = tab_columns(spark, path, names, header=True)
    return df.select(F.col("sysName").alias("id"), "name", F.col("scaffoldId").alias("contig"), F.when(F.col("strand") == "+", "D").otherwise("R").alias("strand"),
                     F.least(F.col("start").cast("long"), F.col("stop").cast("long")).alias("start_pos"), F.greatest(F.col("start").cast("long"), F.col("stop").cast("long")).alias("end_pos"), F.col("desc").alias("description"))


def read_taxonomy(spark: SparkSession, path: str) -> DataFrame:
    return tab_columns(spark, path, ["taxon_id", "code", "name"]).select(F.col("taxon_id").cast("int").alias("taxon_id"), "code", "name")


def load_snapshot(spark: SparkSession, path: str, tables: Sequence[str]) -> dict[str, DataFrame]:
    """State tables of a saved run."""
    return {t: spark.read.parquet(f"{path}/{t}") for t in tables}
