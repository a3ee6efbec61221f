"""Exports: run tables, member lists, networks, cluster blocks and snapshots."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions.order import indexed
from tessella.operators.ids import node_attributes

# fixed values: digits kept per exported column
DIGITS = {
    "value": 4, "score": 4, "resid": 4, "weight": 4, "pclust": 3, "e_value": 4, "pvalue": 4,
    "a": 3, "c": 3, "g": 3, "t": 3,
}


def rounded(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(c, DIGITS[c]).alias(c) if c in DIGITS and t == "double" else F.col(c) for c, t in df.dtypes])


def export_run(tables: Mapping[str, DataFrame], path: str) -> list[str]:
    """One bzip2 tab-separated folder per table, numbers rounded to fixed digits."""
    for name, df in tables.items():
        rounded(df).write.mode("overwrite").option("header", "true").option("sep", "\t").option("compression", "bzip2").csv(f"{path}/{name}")
    return sorted(tables)


def read_export(spark: SparkSession, path: str, name: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", "true").option("sep", "\t").csv(f"{path}/{name}")


def register_run_tables(spark: SparkSession, path: str, schemas: Mapping[str, str]) -> list[str]:
    """Make the exported tables queryable by name in SQL."""
    for name, schema in schemas.items():
        read_export(spark, path, name, schema).createOrReplaceTempView(name)
    return sorted(schemas)


def member_lines(member: DataFrame, axis: str, per_piece: int = 10_000) -> DataFrame:
    """(k, line): cluster number and all its sorted members, tab separated; one line per cluster whatever its size.

    Members are ordered by a distributed sort and put together in pieces of ``per_piece``, so a task holds the text of a
    long line but never its members one by one.
    """
    idx = indexed(member.select("k", axis).distinct(), ["k"], [axis], "_p")
    piece = idx.withColumn("part", F.floor((F.col("_p") - 1) / per_piece)).groupBy("k", "part").agg(F.sort_array(F.collect_list(axis)).alias("_m"))
    text = F.when(F.size("_m") > 0, F.array_join(F.transform("_m", lambda x: x.cast("string")), "\t"))
    lines = piece.select("k", F.struct("part", text.alias("t")).alias("_t")).groupBy("k").agg(F.sort_array(F.collect_list("_t"))["t"].alias("_t"))
    return lines.select("k", F.concat_ws("\t", F.col("k").cast("string"), "_t").alias("line"))


def write_members(member: DataFrame, axis: str, path: str) -> None:
    member_lines(member, axis).sort("k").select("line").write.mode("overwrite").text(path)


def write_summary(summary: DataFrame, path: str) -> None:
    summary.sort("k").write.mode("overwrite").option("header", "true").option("sep", "\t").csv(path)


def cluster_node(k: str = "k"):
    return F.format_string("bicluster_%04d", F.col(k))


def motif_node(k: str = "k", mot: str = "mot"):
    return F.format_string("motif_%04d_%d", F.col(k), F.col(mot))


def network_edges(row_member: DataFrame, motifs: DataFrame | None = None, similar: DataFrame | None = None) -> DataFrame:
    """(node1, int, node2): members, motifs and motif similarities around the cluster nodes."""
    out = row_member.select(F.col("row_id").cast("string").alias("node1"), F.lit("gene_member").alias("int"), cluster_node().alias("node2"))
    if motifs is not None:
        out = out.unionByName(motifs.select(motif_node().alias("node1"), F.lit("motif").alias("int"), cluster_node().alias("node2")))
    if similar is not None:
        out = out.unionByName(similar.select(motif_node("k1", "mot1").alias("node1"), F.lit("motif_sim").alias("int"), motif_node("k2", "mot2").alias("node2")))
    return out


def network_nodes(rows: DataFrame, cols: DataFrame, ks: DataFrame, motifs: DataFrame | None = None) -> DataFrame:
    """(node, type) of genes, conditions, clusters and motifs."""
    out = rows.select(F.col("row_id").cast("string").alias("node"), F.lit("gene").alias("type")).distinct()
    out = out.unionByName(cols.select(F.col("col_id").cast("string").alias("node"), F.lit("condition").alias("type")).distinct())
    out = out.unionByName(ks.select("k").distinct().select(cluster_node().alias("node"), F.lit("bicluster").alias("type")))
    if motifs is not None:
        out = out.unionByName(motifs.select(motif_node().alias("node"), F.lit("motif").alias("type")))
    return out


def node_table(nodes: DataFrame, genes: DataFrame | None = None, clusters: DataFrame | None = None, motifs: DataFrame | None = None) -> DataFrame:
    """``nodes`` with attributes: columns of ``genes`` (row_id, ...), ``clusters`` (k, ...) and ``motifs`` (k, mot, ...).

    Outer joins on the node name, so an attribute of a node that no edge names stays; a column that several tables have is
    one column. A node that two kinds share (a gene called like a condition) is one row per kind.
    """
    named = [(genes, "row_id", F.col("row_id").cast("string"), "gene"), (clusters, "k", cluster_node(), "bicluster"), (motifs, "mot", motif_node(), "motif")]
    out = nodes.select(F.struct("node", "type").alias("node"))
    known: set[str] = set()
    for df, key, node, kind in named:
        if df is not None:
            keys = {key, "k"} if key == "mot" else {key}
            tab = df.select(F.struct(node.alias("node"), F.lit(kind).alias("type")).alias("node"), *[c for c in df.columns if c not in keys])
            out = node_attributes(out, tab, coalesce=tuple(known))
            known |= set(tab.columns) - {"node"}
    return out.select("node.node", "node.type", *[c for c in out.columns if c != "node"])


def motif_edge_attributes(motifs: DataFrame) -> DataFrame:
    edge = F.concat(motif_node(), F.lit(" (motif) "), cluster_node())
    return motifs.select(edge.alias("edge"), "width", "nsites", "e_value")


def write_network(edges: DataFrame, nodes: DataFrame, edge_attributes: Mapping[str, DataFrame], path: str) -> None:
    opts = {"header": "true", "sep": "\t"}
    edges.write.mode("overwrite").options(**opts).csv(f"{path}/all.sif")
    nodes.write.mode("overwrite").options(**opts).csv(f"{path}/all.noa")
    for name, df in edge_attributes.items():
        df.write.mode("overwrite").options(**opts).csv(f"{path}/{name}.eda")


def write_regulator_network(edges: DataFrame, path: str) -> None:
    """Regulator edges, their weights and node types as text tables."""
    edges.select(F.concat_ws("\t", "src", "kind", "dst").alias("line")).write.mode("overwrite").text(f"{path}/network.sif")
    edges.where("weight is not null").select(F.concat(F.concat_ws(" ", "src", F.concat(F.lit("("), "kind", F.lit(")")), "dst"), F.lit(" = "), F.col("weight").cast("string")).alias("line")).write.mode("overwrite").text(f"{path}/weights.eda")
    regulator_nodes(edges).select(F.concat_ws(" = ", "node", "type").alias("line")).write.mode("overwrite").text(f"{path}/types.noa")


def regulator_nodes(edges: DataFrame) -> DataFrame:
    both = edges.select(F.col("src").alias("node")).unionByName(edges.select(F.col("dst").alias("node"))).distinct()
    kind = F.when(F.col("node").startswith("AND_"), "logicGate").when(F.col("node").startswith("bicluster_"), "cluster").otherwise("regulator")
    return both.select("node", kind.alias("type"))


def cluster_matrix_extract(m: DataFrame, row_member: DataFrame, col_member: DataFrame, k: int) -> DataFrame:
    """Wide block of one cluster: members by cluster columns."""
    rows, cols = row_member.where(F.col("k") == k), col_member.where(F.col("k") == k)
    names = [r["col_id"] for r in cols.select("col_id").distinct().sort("col_id").collect()]  # the columns of one output table
    cells = m.join(cols, "col_id", "left_semi").join(rows, "row_id", "left_semi")
    return cells.groupBy("row_id").pivot("col_id", names).agg(F.first("value"))


def cluster_pssm_extract(pssm: DataFrame, k: int) -> DataFrame:
    """(mot, pos, a, c, g, t): the motif matrices of one cluster."""
    return pssm.where(F.col("k") == k).select("mot", "pos", "a", "c", "g", "t")


def write_cluster_blocks(m: DataFrame, row_member: DataFrame, col_member: DataFrame, pssm: DataFrame | None, k: int, path: str) -> None:
    """Matrix block and motif block of one cluster as tab-separated tables, in order of rows and of positions."""
    blocks = {"matrix": cluster_matrix_extract(m, row_member, col_member, k).sort("row_id")}
    if pssm is not None:
        blocks["pssm"] = cluster_pssm_extract(pssm, k).sort("mot", "pos")
    for name, df in blocks.items():
        df.write.mode("overwrite").option("header", "true").option("sep", "\t").csv(f"{path}/{name}")


def save_snapshot(tables: Mapping[str, DataFrame], path: str, iteration: int) -> str:
    """Every state table under ``path/iter=N``."""
    base = f"{path}/iter={iteration}"
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{base}/{name}")
    return base
