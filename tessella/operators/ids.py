"""Identifier work: aliases, name patterns, long names, node attributes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# fixed value: suffixes removed from an id before it is looked up
ID_SUFFIX = r"m$|_\d$|-\S$"


def resolve_aliases(ids: DataFrame, names: DataFrame, extra: DataFrame | None = None, fast: bool = False) -> DataFrame:
    """(row_id, alias): every name an id is known by.

    The id without its suffix is matched to id or name ignoring case; all ids and names that share a
    hit follow, one hop further unless ``fast``. An id without a match keeps itself.
    """
    table = names.select("id", "name")
    if extra is not None:
        table = table.unionByName(extra.select("id", "name"))
    table = table.where((F.col("name") != "") & F.col("name").isNotNull()).distinct()
    links = table.select(F.col("id").alias("a"), F.col("name").alias("b")).unionByName(table.select(F.col("name").alias("a"), F.col("id").alias("b"))).distinct()
    start = ids.select("row_id").distinct().withColumn("_g", F.regexp_replace("row_id", ID_SUFFIX, ""))
    low = links.select(F.lower("a").alias("_key"), F.explode(F.array("a", "b")).alias("alias")).distinct()
    first = start.join(low, F.lower("_g") == F.col("_key")).select("row_id", "_g", "alias").distinct()
    found = first.select("row_id", "alias").unionByName(first.select("row_id", F.col("_g").alias("alias")))
    if not fast:
        more = first.join(links, first["alias"] == links["a"]).select("row_id", F.col("b").alias("alias"))
        found = found.unionByName(more)
    none = start.join(first, "row_id", "left_anti").select("row_id", F.col("row_id").alias("alias"))
    return found.unionByName(none).distinct()


def rows_without_annotation(ids: DataFrame, alias: DataFrame, known: DataFrame, col: str = "id") -> DataFrame:
    """Ids none of whose aliases is annotated."""
    good = alias.join(known.select(F.col(col).alias("alias")).distinct(), "alias", "left_semi").select("row_id")
    return ids.select("row_id").distinct().join(good, "row_id", "left_anti")


def long_names(ids: DataFrame, alias: DataFrame, features: DataFrame, short: bool = False) -> DataFrame:
    """First description (or name, or the text in parentheses) per id; blank if missing or equal to the id."""
    value = F.col("description")
    if short:
        inner = F.regexp_extract("description", r"\(([^()]*)", 1)
        value = F.when(F.col("_same").isNotNull() & F.col("description").contains("("), inner).otherwise(F.col("name"))
    feat = features
    if short:
        same = ids.select(F.col("row_id").alias("name"), F.lit(1).alias("_same")).distinct()
        feat = features.join(same, "name", "left")
    j = alias.join(feat, alias["alias"] == feat["id"]).groupBy("row_id").agg(F.min_by(value, F.struct("id", "description")).alias("_v"))
    return ids.select("row_id").distinct().join(j, "row_id", "left").select(
        "row_id", F.coalesce(F.when(F.col("_v") != F.col("row_id"), F.col("_v")), F.lit("")).alias("long_name"))


def infer_name_prefix(names: DataFrame, col: str = "name", levels: Sequence[float] = (0.9, 0.6, 0.4)) -> DataFrame:
    """(prefix, share): longest 1-4 letter prefix whose share passes the first level any prefix reaches."""
    n = names.agg(F.count(col).alias("n")).scalar()
    cut = names.select(F.explode(F.sequence(F.lit(1), F.lit(4))).alias("len"), F.upper(col).alias("_u")).groupBy("len", F.expr("substring(_u, 1, len)").alias("prefix")).agg(F.count(F.lit(1)).alias("_c"))
    best = cut.groupBy("len").agg(F.max(F.struct("_c", "prefix")).alias("_b")).select("len", F.col("_b.prefix").alias("prefix"), (F.col("_b._c") / n).alias("share"))
    level = F.coalesce(*[F.when(F.max("share") > v, F.lit(v)) for v in levels])
    reached = best.agg(level.alias("v")).scalar()
    return best.where(F.col("share") > reached).agg(F.max_by("prefix", "len").alias("prefix"), F.max_by("share", "len").alias("share"))


def infer_name_regex(names: DataFrame, col: str = "name") -> DataFrame:
    """(regex): per position a digit range, a set of characters and an optional mark.

    Only (position, character) pairs reach the final step: at most the alphabet per position.
    """
    src = names.select(F.upper(F.col(col).cast("string")).alias("_u")).distinct()
    width = src.agg(F.max(F.length("_u")).alias("w")).scalar()
    padded = src.withColumn("_w", width).select(F.expr("rpad(_u, _w, ' ')").alias("_u"))
    chars = padded.select(F.posexplode(F.split("_u", ""))).where("col <> ''").distinct()
    per = chars.groupBy("pos").agg(F.sort_array(F.collect_list("col")).alias("_c"))
    solid = F.filter("_c", lambda c: c != " ")
    n = F.size(solid)
    digits = F.forall(solid, lambda c: c.between("0", "9")) & (F.size("_c") == n)
    run = digits & (n > 1) & ((F.element_at(solid, -1).cast("int") - F.element_at(solid, 1).cast("int") + 1) == n)
    body = F.when(run, F.concat(F.lit("["), F.element_at(solid, 1), F.lit("-"), F.element_at(solid, -1), F.lit("]"))).when(
        n > 1, F.concat(F.lit("["), F.array_join(solid, ""), F.lit("]"))).otherwise(F.array_join(solid, ""))
    part = F.concat(F.regexp_replace(body, r"\.", r"\\\\."), F.when(F.size("_c") > n, F.lit("?")).otherwise(F.lit("")))
    parts = per.select("pos", part.alias("_p")).agg(F.sort_array(F.collect_list(F.struct("pos", "_p"))).alias("_a"))
    return parts.select(F.array_join(F.transform("_a", lambda x: x["_p"]), "").alias("regex"))


def select_ids_by_pattern(candidates: DataFrame, ids: DataFrame, regex: str, prefix: str | None = None) -> DataFrame:
    """Candidate ids in ``ids`` that match the pattern; the prefix widens the set when under half match."""
    known = candidates.select("row_id").distinct().join(ids.select("row_id").distinct(), "row_id", "left_semi")
    hit = known.where(F.col("row_id").rlike(f"(?i)^{regex}"))
    if prefix and hit.count() <= ids.select("row_id").distinct().count() / 2:
        hit = hit.unionByName(known.where(F.col("row_id").rlike(f"(?i)^{prefix}"))).distinct()
    return hit


def node_attributes(nodes: DataFrame, *tables: DataFrame, coalesce: Sequence[str] = ()) -> DataFrame:
    """Full outer merge of attribute tables on ``node``; columns in ``coalesce`` are united."""
    out = nodes
    for i, tab in enumerate(tables):
        clash = [c for c in tab.columns if c in out.columns and c != "node"]
        tab = tab.select("node", *[F.col(c).alias(f"_{i}_{c}") if c in clash else F.col(c) for c in tab.columns if c != "node"])
        out = out.join(tab, "node", "full")
        for c in clash:
            if c in coalesce:
                out = out.withColumn(c, F.coalesce(F.col(f"_{i}_{c}"), F.col(c))).drop(f"_{i}_{c}")
    return out


def alias_lists(alias: DataFrame, sep: str = "::") -> DataFrame:
    """One string of aliases per id. An id has a bounded number of names in the name table."""
    return alias.groupBy("row_id").agg(F.array_join(F.sort_array(F.collect_set("alias")), sep).alias("synonyms"))


def lookup_species(taxa: DataFrame, code: str) -> DataFrame:
    """Organism name by code: bracketed text removed, blanks to underscores."""
    name = F.regexp_replace(F.trim(F.regexp_replace("name", r"\s*\(.*\)", "")), r"\s+", "_")
    return taxa.where(F.col("code") == code).select("code", name.alias("species"))


def lookup_taxon(taxa: DataFrame, name: str) -> DataFrame:
    """Taxon id by exact name, else by substring."""
    key = F.lower("name")
    exact = taxa.where(key == name.lower()).agg(F.min("taxon_id").alias("t")).scalar()
    part = taxa.where(key.contains(name.lower())).agg(F.min("taxon_id").alias("t")).scalar()
    one = taxa.sparkSession.range(1)
    return one.select(F.lit(name).alias("name"), F.coalesce(exact, part).alias("taxon_id"))


def first_by_priority(df: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    w = Window.partitionBy(key).orderBy(*order)
    return df.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")
