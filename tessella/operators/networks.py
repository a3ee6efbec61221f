"""Edge-table preparation: ``(net, src, dst, weight)``."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions.order import quantiles
from tessella.operators.scores import eligible_groups
from tessella.session import materialize


def drop_self_edges(edges: DataFrame) -> DataFrame:
    return edges.where(F.col("src") != F.col("dst"))


def merge_duplicate_edges(edges: DataFrame, compat: bool = False, position: str | None = None) -> DataFrame:
    """Sum the weights of repeated (net, src, dst).

    ``compat`` leaves out the first occurrence of a repeated edge, by ``position``.
    """
    g = edges.groupBy("net", "src", "dst")
    if not compat:
        return g.agg(F.sum("weight").alias("weight"))
    first = F.min_by("weight", position) if position else F.first("weight")
    out = g.agg(F.sum("weight").alias("_s"), first.alias("_f"), F.count(F.lit(1)).alias("_n"))
    return out.select("net", "src", "dst", F.when(F.col("_n") > 1, F.col("_s") - F.col("_f")).otherwise(F.col("_s")).alias("weight"))


def truncate_node_names(edges: DataFrame, ids: DataFrame, id_col: str = "row_id") -> DataFrame:
    """Cut node names to the median id length when no node is known but cut ones are."""
    nodes = edges.select(F.col("src").alias("node")).unionByName(edges.select(F.col("dst").alias("node"))).distinct()
    if not nodes.join(ids.select(F.col(id_col).alias("node")), "node", "left_semi").isEmpty():
        return edges
    med = lambda df, c: quantiles(df.select(F.length(c).alias("n")), [], "n", {"m": 0.5}).first()["m"]
    n_node, n_id = med(nodes, "node"), med(ids, id_col)
    cut = nodes.select(F.substring("node", 1, int(n_id)).alias("node"))
    if n_node <= n_id or cut.join(ids.select(F.col(id_col).alias("node")), "node", "left_semi").isEmpty():
        return edges
    return edges.withColumn("src", F.substring("src", 1, int(n_id))).withColumn("dst", F.substring("dst", 1, int(n_id)))


def reconcile_edges(edges: DataFrame, ids: DataFrame, alias: DataFrame, id_col: str = "row_id") -> DataFrame:
    """Rewrite unknown endpoints to row ids by alias and keep edges with both endpoints known."""
    known = ids.select(F.col(id_col).alias("node")).distinct()
    names = alias.join(known, alias["row_id"] == known["node"], "left_semi").groupBy("alias").agg(F.min("row_id").alias("_to"))
    out = edges
    for end in ("src", "dst"):
        k = known.select(F.col("node").alias(end), F.lit(1).alias("_k"))
        out = out.join(k, end, "left").join(names.select(F.col("alias").alias(end), "_to"), end, "left")
        out = out.withColumn(end, F.when(F.col("_k").isNotNull(), F.col(end)).otherwise(F.col("_to"))).drop("_k", "_to").where(F.col(end).isNotNull())
    return out.select("net", "src", "dst", "weight")


def symmetrize_edges(edges: DataFrame) -> DataFrame:
    """Add reversed edges; the original direction wins over a reversed duplicate."""
    back = edges.select("net", F.col("dst").alias("src"), F.col("src").alias("dst"), "weight", F.lit(1).alias("_p"))
    both = edges.select("net", "src", "dst", "weight", F.lit(0).alias("_p")).unionByName(back)
    return both.groupBy("net", "src", "dst").agg(F.min_by("weight", "_p").alias("weight"))


def equalize_networks(edges: DataFrame) -> DataFrame:
    """Scale every network to the largest total weight.

    The factors, one per network, go to the edges: joined by network, a task would read all edges of one.
    """
    sums = edges.groupBy("net").agg(F.sum("weight").alias("_s")).where(F.col("_s") > 0)
    top = sums.agg(F.max("_s").alias("m")).scalar()
    factor = sums.select("net", (top / F.col("_s")).alias("_f"))
    return edges.join(F.broadcast(factor), "net", "left").select("net", "src", "dst", (F.col("weight") * F.coalesce("_f", F.lit(1.0))).alias("weight"))


def rescale_links(edges: DataFrame) -> DataFrame:
    """Weights to a maximum of 1000, then 1000 * exp(w / 1000) / e."""
    top = edges.agg(F.max("weight").alias("m")).scalar()
    return edges.withColumn("weight", 1000 * F.exp(F.col("weight") / top) / F.lit(math.e))


def orient_groups(pairs: DataFrame, ids: DataFrame, a: str, b: str, id_col: str = "row_id") -> DataFrame:
    """(group_id, row_id, weight): the column with more known ids is the member column."""
    known = ids.select(id_col).distinct()
    n = {c: pairs.select(F.col(c).alias(id_col)).distinct().join(known, id_col, "left_semi").count() for c in (a, b)}
    member, group = (a, b) if n[a] > n[b] else (b, a)
    return pairs.select(F.col(group).alias("group_id"), F.col(member).alias("row_id"), "weight")


def group_network_degrees(grp: DataFrame, max_size: Column | int) -> DataFrame:
    """(net, row_id, n_edges, weight) of the network a grouping stands for.

    All members of a group are linked with weight (w_a + w_b) / 2. The group totals give every row's
    number of edges and summed weight directly, so the quadratic pair list is never built; scores come
    from ``scores.group_network_scores`` and single neighbourhoods from ``group_edges_within``.
    """
    sized = eligible_groups(grp, max_size)
    tot = sized.groupBy("net", "group_id").agg(F.sum("weight").alias("_s"), F.count(F.lit(1)).alias("_n"))
    j = sized.join(tot, ["net", "group_id"])
    w = ((F.col("_s") - F.col("weight")) + F.col("weight") * (F.col("_n") - 1)) / 2
    return j.groupBy("net", "row_id").agg(F.sum(F.col("_n") - 1).alias("n_edges"), F.sum(w).alias("weight"))


def operon_groups(operons: DataFrame, net: str = "operons") -> DataFrame:
    """Operons as groups of weight 1000."""
    return operons.select(F.lit(net).alias("net"), F.col("head").alias("group_id"), "row_id", F.lit(1000.0).alias("weight")).distinct()


def group_edges_within(grp: DataFrame, row_member: DataFrame, max_size: Column | int) -> DataFrame:
    """(k, net, n_edges, weight): edges of the grouping inside each cluster, counted without listing them."""
    inside = eligible_groups(grp, max_size).join(row_member, "row_id").groupBy("k", "net", "group_id").agg(
        F.count(F.lit(1)).alias("_n"), F.sum("weight").alias("_s"))
    return inside.groupBy("k", "net").agg(
        F.sum(F.col("_n") * (F.col("_n") - 1) / 2).cast("long").alias("n_edges"), F.sum(F.col("_s") * (F.col("_n") - 1) / 2).alias("weight"))


def cluster_subnetwork(edges: DataFrame, row_member: DataFrame, k: int | None = None) -> DataFrame:
    """Edges with both endpoints in the same cluster."""
    mem = row_member.select("k", "row_id") if k is None else row_member.where(F.col("k") == k).select("k", "row_id")
    return edges.join(mem.withColumnRenamed("row_id", "src"), "src").join(mem.withColumnRenamed("row_id", "dst"), ["k", "dst"], "left_semi").select("k", "net", "src", "dst", "weight")


def rows_not_in_network(ids: DataFrame, edges: DataFrame) -> DataFrame:
    nodes = edges.select("net", F.col("src").alias("row_id")).unionByName(edges.select("net", F.col("dst").alias("row_id"))).distinct()
    nets = edges.select("net").distinct().agg(F.sort_array(F.collect_list("net")).alias("n")).scalar()
    return ids.select("row_id").distinct().select("row_id", F.explode(nets).alias("net")).join(nodes, ["net", "row_id"], "left_anti")


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, label): smallest node id of each component.

    Every round takes the smallest neighbour label and then jumps to the label of the label, so the
    number of rounds grows with the logarithm of the diameter. Each round is written out; minima
    combine map-side, so a hub costs one record per task.
    """
    pairs = edges.select(F.col("src").alias("a"), F.col("dst").alias("b")).where("a <> b")
    both = materialize(pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "pairs")
    labels = materialize(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("node", "a"), "a").groupBy(F.col("b").alias("node")).agg(F.min("label").alias("_n"))
        step = labels.join(near, "node").select("node", "label", F.least("label", "_n").alias("_l"))
        jump = step.select(F.col("node").alias("_l"), F.col("_l").alias("_j"))
        nxt = materialize(step.join(jump, "_l", "left").select("node", F.least("_l", F.coalesce("_j", "_l")).alias("label"), (F.least("_l", F.coalesce("_j", "_l")) != F.col("label")).alias("_moved")), "labels")
        labels = nxt.select("node", "label")
        if nxt.where("_moved").isEmpty():
            return labels


def chain_pairs_to_operons(pairs: DataFrame) -> DataFrame:
    """(operon, row_id): genes linked by pairs form one operon of at least two genes."""
    comp = connected_components(pairs)
    return comp.select(F.col("label").alias("operon"), F.col("node").alias("row_id"))


def prepare_networks(raw: DataFrame, ids: DataFrame, alias: DataFrame | None = None, compat: bool = False) -> DataFrame:
    """Self edges, duplicates, names, symmetry and total weight in the reference order."""
    e = merge_duplicate_edges(drop_self_edges(raw), compat)
    e = truncate_node_names(e, ids) if dict(e.dtypes)["src"] == "string" else e
    if alias is not None:
        e = reconcile_edges(e, ids, alias)
    return equalize_networks(symmetrize_edges(e))


def attach_priors(predictors: DataFrame, priors: DataFrame, available: DataFrame, least: float = 0.5) -> DataFrame:
    """(k, predictor, penalty): strong priors join the predictor list, penalty = 1.5 - prior."""
    strong = priors.where(F.col("prior") >= least).join(available.select("predictor").distinct(), "predictor", "left_semi").select("k", "predictor")
    every = predictors.select("k", "predictor").unionByName(strong).distinct()
    return every.join(priors, ["k", "predictor"], "left").select("k", "predictor", (1.5 - F.coalesce("prior", F.lit(0.5))).alias("penalty"))


def reciprocal_best_hits(hits: DataFrame, len_q: DataFrame, len_s: DataFrame, e_cutoff: float = 1e-5, cover: float = 0.5) -> DataFrame:
    """Alignments that are the first of their query and of their subject by bit score, then E-value."""
    ok = hits.where(F.col("e_value") <= e_cutoff).join(len_q, "query").join(len_s, "subject").where(
        (F.col("align_len") / F.col("q_len") >= cover) & (F.col("align_len") / F.col("s_len") >= cover))
    order = F.struct(-F.col("bit_score"), F.col("e_value"), F.col("query"), F.col("subject"))
    best_q = ok.groupBy("query").agg(F.min(order).alias("_b")).select("query", F.col("_b.subject").alias("subject"))
    best_s = ok.groupBy("subject").agg(F.min(order).alias("_b")).select("subject", F.col("_b.query").alias("query"))
    both = best_q.join(best_s, ["query", "subject"])
    return ok.join(both, ["query", "subject"], "left_semi").groupBy("query", "subject").agg(F.max("bit_score").alias("bit_score"), F.min_by("e_value", order).alias("e_value"))


def fuzzy_lookup(names: DataFrame, name: str, col: str = "name", share: float = 0.1) -> DataFrame:
    """Names within an edit distance of ``share`` of the length, closest only."""
    d = F.levenshtein(F.lower("name"), F.lit(name.lower()))
    near = names.select(F.col(col).alias("name")).distinct().withColumn("distance", d).where(F.col("distance") <= math.ceil(share * len(name)))
    return near.where(F.col("distance") == near.agg(F.min("distance").alias("m")).scalar())


def union_networks(parts: Sequence[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
