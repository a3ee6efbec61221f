"""Coordinates, operons, promoter windows, as-of and interval joins, sequence masking."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.functions.chance import uniform
from tessella.functions.order import carry_forward
from tessella.session import materialize, small_batches

SEGMENT = 65536


def reverse_complement(col: Column | str) -> Column:
    c = F.col(col) if isinstance(col, str) else col
    return F.reverse(F.translate(F.upper(c), "ATCG", "TAGC"))


def gene_coords(alias: DataFrame, features: DataFrame, operons: DataFrame | None = None) -> DataFrame:
    """(row_id, id, contig, strand, start_pos, end_pos): coordinates of the first annotated alias.

    With ``operons`` (head, row_id) a gene takes the coordinates of its operon's head; a gene without
    operon keeps its own.
    """
    known = alias.join(features.select(F.col("id").alias("alias")), "alias", "left_semi")
    own = known.groupBy("row_id").agg(F.min("alias").alias("id"))
    place = features.select("id", "contig", "strand", "start_pos", "end_pos")
    if operons is None:
        return own.join(place, "id").select("row_id", "id", "contig", "strand", "start_pos", "end_pos")
    heads = operons.groupBy("row_id").agg(F.min("head").alias("head"))
    head_id = own.select(F.col("row_id").alias("head"), F.col("id").alias("_hid"))
    at = own.join(heads, "row_id", "left").withColumn("head", F.coalesce("head", "row_id")).join(head_id, "head", "left").withColumn("_at", F.coalesce("_hid", "head"))
    out = at.join(place.withColumnRenamed("id", "_at"), "_at")
    return out.select("row_id", "id", "contig", "strand", "start_pos", "end_pos").dropDuplicates(["row_id", "id", "contig", "strand"])


def operon_heads(operons: DataFrame, features: DataFrame) -> DataFrame:
    """(operon, head): first gene of a mostly forward operon, last of a mostly reverse one."""
    j = operons.join(features, operons["row_id"] == features["id"])
    g = j.groupBy("operon").agg(
        F.avg((F.col("strand") == "D").cast("double")).alias("_d"), F.avg((F.col("strand") == "R").cast("double")).alias("_r"),
        F.min_by("row_id", F.struct("start_pos", "row_id")).alias("_first"), F.max_by("row_id", F.struct("end_pos", "row_id")).alias("_last"))
    head = F.when(F.col("_d") > 0.6, F.col("_first")).when(F.col("_r") > 0.6, F.col("_last"))
    return g.select("operon", head.alias("head")).where(F.col("head").isNotNull())


def operon_table(operons: DataFrame, heads: DataFrame) -> DataFrame:
    return operons.join(heads, "operon").select("head", "row_id").distinct()


def segments(contigs: DataFrame, size: int = SEGMENT) -> DataFrame:
    """(contig, seg, piece): a contig cut into fixed pieces, so no task handles a whole one per feature."""
    pieces = F.regexp_extract_all("seq", F.lit("(?s).{1,%d}" % size), F.lit(0))
    return contigs.select("contig", F.posexplode(pieces).alias("seg", "piece"))


def cut_ranges(ranges: DataFrame, contigs: DataFrame, size: int = SEGMENT) -> DataFrame:
    """Add ``seq``: letters start..end (1-based, clipped) of the contig for every record of ``ranges``.

    Joins on (contig, segment): a contig with a third of all features still spreads by segment. A range in one segment is
    cut where it meets it, and its letters do not move again. Ranges over several segments, of a repeated id or on a
    repeated contig are put together by id.
    """
    shown = ranges.columns
    ranges = materialize(ranges, "ranges").withColumn("_lo", F.greatest(F.col("start"), F.lit(1)))
    segment = lambda at: F.floor((F.col(at) - 1) / size).cast("int")
    real = ranges.where(F.col("end") >= F.col("_lo"))
    many = lambda df, key: df.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(key)
    apart = many(ranges, "id").unionByName(real.where(segment("_lo") < segment("end")).select("id")).unionByName(real.join(many(contigs, "contig"), "contig", "left_semi").select("id"))
    apart = materialize(apart.where("id is not null").distinct(), "ids_apart")

    def letters(seg: str) -> Column:
        base = F.col(seg).cast("long") * size
        a = F.greatest(F.col("_lo") - base, F.lit(1))
        b = F.least(F.col("end") - base, F.lit(size))
        return F.col("piece").substr(a.cast("int"), (b - a + 1).cast("int"))

    # the ranges are the small side: hashing them leaves the segments unsorted
    lone = ranges.join(apart, "id", "left_anti").withColumn("seg", F.when((F.col("end") >= F.col("_lo")) & F.col("id").isNotNull(), segment("_lo")))
    out = lone.hint("shuffle_hash").join(segments(contigs, size), ["contig", "seg"], "left").select(*shown, F.coalesce(letters("seg"), F.lit("")).alias("seq"))
    if apart.isEmpty():
        return out
    rest = ranges.join(apart, "id", "left_semi")
    spans = rest.where(F.col("end") >= F.col("_lo")).withColumn("seg", F.explode(F.sequence(segment("_lo"), segment("end"))))
    j = spans.join(segments(contigs, size), ["contig", "seg"])
    whole = j.groupBy("id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seg", letters("seg").alias("_t")))), lambda x: x["_t"]), "").alias("seq"))
    return out.unionByName(rest.join(whole, "id", "left").select(*shown, F.coalesce("seq", F.lit("")).alias("seq")))


def window_range(kind: str, near: int, far: int) -> tuple[Column, Column]:
    """Start and end of the upstream, downstream or gene window by strand."""
    s, e, fwd = F.col("start_pos"), F.col("end_pos"), F.col("strand") == "D"
    before = (s - 1 - far, s - 1 - near)
    after = (e + 1 + near, e + 1 + far)
    if kind == "gene":
        return s, e
    first, second = (before, after) if kind == "upstream" else (after, before)
    return F.when(fwd, first[0]).otherwise(second[0]), F.when(fwd, first[1]).otherwise(second[1])


def promoter_window(coords: DataFrame, contigs: DataFrame, kind: str = "upstream", distance: tuple[int, int] = (-20, 150)) -> DataFrame:
    """(id, seq, contig, strand, start, end): window sequence on the gene's own strand."""
    near, far = distance
    start, end = window_range(kind, near, far)
    ranges = coords.select("id", "contig", "strand", start.alias("start"), end.alias("end"))
    cut = cut_ranges(ranges, contigs)
    width = abs(far - near)
    seq = F.when(F.col("strand") == "R", reverse_complement("seq")).otherwise(F.col("seq"))
    cut = cut.withColumn("seq", seq)
    if kind != "gene":
        trimmed = F.when(F.col("strand") == "D", F.substring("seq", 1, width)).otherwise(F.expr(f"right(seq, {width})"))
        cut = cut.withColumn("seq", F.when(F.length("seq") > width, trimmed).otherwise(F.col("seq")))
    return cut.select("id", "seq", "contig", "strand", "start", "end")


def noncoding_upstream(features: DataFrame, same_strand: bool = False, reach: int = 100_000) -> DataFrame:
    """(id, nearest): as-of join to the closest feature end below (D) or feature start above (R).

    Both directions run as a carry-forward over position order, which stays spread when one contig
    holds most features.
    """
    keys = ["contig", "strand"] if same_strand else ["contig"]
    # both directions and their range-partitioned sorts read the table several times
    features = materialize(features.select("id", "contig", "strand", "start_pos", "end_pos"), "features")

    def asof(own: Column, other: Column, sign: int) -> DataFrame:
        # queries sort before events at an equal position: the comparison is strict
        ask = features.select(*keys, "id", (own * sign).alias("_at"), F.lit(0).alias("_o"), F.lit(None).cast("long").alias("_v"), F.col("start_pos").alias("_s"), F.col("strand").alias("_st"))
        say = features.select(*keys, "id", (other * sign).alias("_at"), F.lit(1).alias("_o"), other.alias("_v"), F.col("start_pos").alias("_s"), F.col("strand").alias("_st"))
        pair = F.when(F.col("_v").isNotNull(), F.struct("_v", "_s"))
        got = carry_forward(ask.unionByName(say), keys, ["_at", "_o", "id"], pair, "_near").where("_o = 0")
        return got.select("id", F.col("_st").alias("strand"), F.when(F.abs(F.col("_near._s") - F.col("_s")) <= reach, F.col("_near._v")).alias("nearest"))

    below = asof(F.col("start_pos"), F.col("end_pos"), 1).where("strand = 'D'")
    above = asof(F.col("end_pos"), F.col("start_pos"), -1).where("strand = 'R'")
    return below.unionByName(above).select("id", "strand", "nearest")


def nearest_earlier(left: DataFrame, right: DataFrame, key: str, left_at: str, right_at: str, value: str) -> DataFrame:
    """As-of join: for each left record the value of the last right record strictly before it."""
    a = left.select("*", F.col(left_at).alias("_at"), F.lit(0).alias("_o"), F.lit(None).cast(right.schema[value].dataType).alias("_v"))
    b = right.select(key, F.col(right_at).alias("_at"), F.lit(1).alias("_o"), F.col(value).alias("_v"))
    both = a.unionByName(b, allowMissingColumns=True)
    return carry_forward(both, [key], ["_at", "_o"], F.col("_v"), "nearest").where("_o = 0").drop("_at", "_o", "_v")


def overlapping_regions(a: DataFrame, b: DataFrame | None = None, bucket: int = 1000) -> DataFrame:
    """(id, other) pairs of regions of one contig that intersect.

    Regions join on (contig, position bucket); a pair sharing several buckets is kept once, in the
    bucket where the later of the two starts.
    """
    b = a if b is None else b

    def bins(df: DataFrame, tag: str) -> DataFrame:
        lo, hi = F.floor(F.col("start") / bucket), F.floor(F.col("end") / bucket)
        return df.where(F.col("end") >= F.col("start")).select(
            "contig", F.col("id").alias(f"id{tag}"), F.col("start").alias(f"s{tag}"), F.col("end").alias(f"e{tag}"), F.explode(F.sequence(lo, hi)).alias("bin"))

    j = bins(a, "1").join(bins(b, "2"), ["contig", "bin"]).where((F.col("s1") <= F.col("e2")) & (F.col("s2") <= F.col("e1")) & (F.col("id1") != F.col("id2")))
    j = j.where(F.col("bin") == F.floor(F.greatest("s1", "s2") / bucket))
    return j.select("contig", F.col("id1").alias("id"), F.col("id2").alias("other"), F.greatest("s1", "s2").alias("from"), F.least("e1", "e2").alias("to"))


def distinct_sequences(seqs: DataFrame) -> DataFrame:
    """First id of each identical sequence."""
    return seqs.groupBy("seq").agg(F.min("id").alias("id")).select("id", "seq")


def mask_start(seqs: DataFrame, far: int) -> DataFrame:
    """Four letters after position ``far`` become N."""
    n = F.length("seq")
    cut = F.when(n > far, F.expr(f"substring(overlay(seq placing 'NNNN' from {far + 1} for 4), 1, length(seq))")).otherwise(F.col("seq"))
    return seqs.withColumn("seq", cut)


def _low_entropy(seq: str, length: int, cutoff: float) -> str:
    raw = np.frombuffer(seq.encode(), dtype=np.uint8)
    if len(raw) < length:
        return seq
    counts = np.stack([np.convolve((raw == ord(x)).astype(int), np.ones(length, int), "valid") for x in "ACGT"])
    p = counts / length + 1e-10
    entropy = -(np.where(counts > 0, p * np.log2(p), 0.0)).sum(axis=0)
    bad = (entropy <= cutoff) & (counts.sum(axis=0) == length)
    cover = np.convolve(bad.astype(int), np.ones(length, int)) > 0
    return np.where(cover, ord("N"), raw).astype(np.uint8).tobytes().decode()


def mask_low_complexity(seqs: DataFrame, length: int = 8, cutoff: float = 0.6) -> DataFrame:
    """Every window of ``length`` letters whose entropy is at most ``cutoff`` becomes N."""

    @F.pandas_udf(T.StringType())
    def mask(s: pd.Series) -> pd.Series:
        return s.map(lambda x: _low_entropy(x, length, cutoff), na_action="ignore")

    return small_batches(seqs).withColumn("seq", mask("seq"))


def mask_ranges(seqs: DataFrame, ranges: DataFrame) -> DataFrame:
    """Replace the union of (id, from, to) letter ranges by N.

    Ranges collapse to one 32-letter bit mask per piece of a sequence by a map-side combined bit-or, so
    an id with any number of overlapping ranges needs at most length / 32 masks.
    """
    piece = ranges.where(F.col("to") >= F.col("from")).select("id", "from", "to", F.explode(F.sequence(F.floor((F.col("from") - 1) / 32), F.floor((F.col("to") - 1) / 32))).alias("_w"))
    lo = F.greatest(F.col("from") - 1 - F.col("_w") * 32, F.lit(0))
    hi = F.least(F.col("to") - 1 - F.col("_w") * 32, F.lit(31))
    ones = (F.pow(F.lit(2.0), hi + 1) - F.pow(F.lit(2.0), lo)).cast("long")
    masks = piece.select("id", "_w", ones.alias("_b")).groupBy("id", "_w").agg(F.bit_or("_b").alias("_b"))
    lists = masks.groupBy("id").agg(F.collect_list(F.struct("_w", "_b")).alias("_m"))

    @F.pandas_udf(T.StringType())
    def put(seq: pd.Series, masks: pd.Series) -> pd.Series:
        out = []
        for s, ms in zip(seq, masks):
            if ms is None or s is None:
                out.append(s)
                continue
            raw = np.frombuffer(s.encode(), dtype=np.uint8).copy()
            for m in ms:
                for i in range(32):
                    at = int(m["_w"]) * 32 + i
                    if at < len(raw) and (int(m["_b"]) >> i) & 1:
                        raw[at] = ord("N")
            out.append(raw.tobytes().decode())
        return pd.Series(out)

    return small_batches(seqs.join(lists, "id", "left")).withColumn("seq", put("seq", "_m")).drop("_m")


def mask_overlaps(seqs: DataFrame, bucket: int = 1000) -> DataFrame:
    """Mask one copy (the later id) of every region shared by two sequences of a contig."""
    regions = seqs.select("id", "contig", "start", "end")
    hit = overlapping_regions(regions, bucket=bucket).where(F.col("id") > F.col("other"))
    place = seqs.select("id", "start", "end", "strand")
    j = hit.select("id", "from", "to").join(place, "id")
    fwd = F.col("strand") == "D"
    # letters of a reverse sequence run from its end
    a = F.when(fwd, F.col("from") - F.col("start") + 1).otherwise(F.col("end") - F.col("to") + 1)
    b = F.when(fwd, F.col("to") - F.col("start") + 1).otherwise(F.col("end") - F.col("from") + 1)
    return mask_ranges(seqs, j.select("id", a.alias("from"), b.alias("to")))


def mask_similar(seqs: DataFrame, alignments: DataFrame, length: int = 30, identity: float = 80.0) -> DataFrame:
    """Mask the subject region of long, similar alignments (query before subject by id)."""
    good = alignments.where((F.col("align_len") > length) & (F.col("identity") > identity) & (F.col("query") < F.col("subject")))
    return mask_ranges(seqs, good.select(F.col("subject").alias("id"), F.least("s_start", "s_end").alias("from"), F.greatest("s_start", "s_end").alias("to")))


def filter_sequences(seqs: DataFrame, distance: tuple[int, int], uniquify: bool = True, low_complexity: bool = True, starts: bool = True, overlaps: bool = False, min_length: int = 0) -> DataFrame:
    """Distinct, low-complexity, start-codon and overlap masking in the reference order."""
    # written once: the steps read the sequences, their ids and their places apart
    out = seqs = materialize(seqs, "sequences")
    if uniquify:
        out = out.join(distinct_sequences(seqs).select("id"), "id", "left_semi")
    if low_complexity:
        out = mask_low_complexity(out)
    if starts and min(distance) < 0:
        out = mask_start(out, distance[1])
    if overlaps:
        out = mask_overlaps(out)
    return out.where(F.length("seq") >= min_length)


# fixed values: letters a degenerate code stands for
DEGENERATE = {
    "R": "GA", "Y": "TC", "K": "GT", "M": "AC", "S": "GC", "W": "AT", "N": "GATC",
}


def degenerate_resolve(seqs: DataFrame, seed: int = 1) -> DataFrame:
    """Each degenerate code becomes one of its letters, picked by a hash of (id, position, seed)."""

    def pick(c: Column, i: Column) -> Column:
        u = F.floor(uniform("id", i, seed) * 12).cast("int")
        out = c
        for code, letters in DEGENERATE.items():
            choice = F.substring(F.lit(letters), 1, 1)
            for j in range(1, len(letters)):
                choice = F.when(u >= 12 // len(letters) * j, F.lit(letters[j])).otherwise(choice)
            out = F.when(c == code, choice).otherwise(out)
        return out

    return seqs.withColumn("seq", F.array_join(F.transform(F.split("seq", ""), pick), ""))
