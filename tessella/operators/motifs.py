"""k-mer background models, motif matrices, scanning, discovery and motif comparison."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from tessella.functions import distributions as dist
from tessella.functions.order import indexed
from tessella.operators.genome import reverse_complement
from tessella.session import drop_unused, materialize, recorded, small_batches, spread

LETTERS = "ACGT"
PIECE = 256


def pieces(seqs: DataFrame, overlap: int, size: int = PIECE) -> DataFrame:
    """(id, at, piece): short pieces that each carry the next ``overlap`` letters.

    Position look-ups inside a piece are cheap whatever the sequence length, and one long sequence
    becomes many records.
    """
    cut = seqs.withColumn("_p", F.regexp_extract_all("seq", F.lit("(?s).{1,%d}" % size), F.lit(0)))
    parts = F.transform(F.col("_p"), lambda x, i: F.concat(x, F.substring(F.concat(F.coalesce(F.get("_p", i + 1), F.lit("")), F.coalesce(F.get("_p", i + 2), F.lit("")) if overlap > size else F.lit("")), 1, overlap)))
    keep = [c for c in seqs.columns if c != "seq"]
    return cut.select(*keep, F.posexplode(parts).alias("_i", "piece")).withColumn("at", F.col("_i") * size).drop("_i")


def kmers(seqs: DataFrame, k: int) -> DataFrame:
    """(…, at, kmer): every k-letter window with its 0-based start."""
    p = pieces(seqs, k - 1)
    n = F.least(F.length("piece") - k + 1, F.lit(PIECE))
    keep = [c for c in p.columns if c not in ("piece", "at")]
    spots = p.where(n >= 1).select(*keep, "at", "piece", F.explode(F.sequence(F.lit(1), n)).alias("_j"))
    return spots.select(*keep, (F.col("at") + F.col("_j") - 1).alias("at"), F.expr(f"substring(piece, _j, {k})").alias("kmer"))


CODE = np.full(256, 4, dtype=np.int64)
for _i, _x in enumerate(LETTERS):
    CODE[ord(_x)] = _i


#: Letters that a task counts at a time.
COUNTED = 1_000_000


def kmer_counts(seqs: DataFrame, k: int, counted: int = COUNTED) -> DataFrame:
    """(kmer, n) of pure ACGT words plus one record with kmer NULL for the number of all windows.

    Every task encodes its sequences as base-4 numbers and keeps one counter per word, so at most
    4^k records per task are shuffled instead of one per letter. It holds ``counted`` letters at a time.
    """

    def stretches(batches):
        for pdf in batches:
            held, size = [], 0
            for s in pdf["seq"]:
                raw = (s or "").encode()
                for at in range(0, len(raw) - k + 1, counted):
                    held.append(raw[at:at + counted + k - 1])
                    size += len(held[-1])
                    if size >= counted:
                        yield held
                        held, size = [], 0
            if held:
                yield held

    def count(batches):
        acc, windows = np.zeros(4 ** k, dtype=np.int64), 0
        for held in stretches(batches):
            raw = np.frombuffer(b"\n".join(held), dtype=np.uint8)
            inside, c = raw != 10, CODE[raw]
            n = len(raw) - k + 1
            word, pure, whole = np.zeros(n, dtype=np.int64), np.ones(n, dtype=bool), np.ones(n, dtype=bool)
            for j in range(k):
                word = word * 4 + np.minimum(c[j:j + n], 3)
                pure &= c[j:j + n] < 4
                whole &= inside[j:j + n]
            acc += np.bincount(word[pure], minlength=4 ** k)
            windows += int(whole.sum())
        hit = np.nonzero(acc)[0]
        yield pd.DataFrame({"code": np.append(hit, -1), "n": np.append(acc[hit], windows)})

    sums = small_batches(seqs.select("seq")).mapInPandas(count, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))
    return sums.select(F.when(F.col("code") >= 0, word_of("code", k)).alias("kmer"), "n")


def word_of(code: str, k: int) -> Column:
    """ACGT word of a base-4 number."""
    return F.concat(*[F.expr(f"substring('{LETTERS}', cast(shiftright({code}, {2 * j}) & 3 as int) + 1, 1)") for j in reversed(range(k))])


def all_kmers(spark, k: int) -> DataFrame:
    """Every ACGT word of length k, generated from its base-4 number."""
    return spark.range(4 ** k).select(word_of("id", k).alias("kmer"))


def background_model(seqs: DataFrame, order: int = 3, revcomp: bool = True) -> DataFrame:
    """(kmer, ord, freq) for word lengths 1..order+1 over distinct sequences.

    Words that never occur count 0.1; windows with other letters only enter the total.
    """
    s = seqs.select("seq")
    if revcomp:
        s = s.unionByName(s.select(reverse_complement("seq").alias("seq")))
    s = s.distinct()
    out = None
    for o in range(order + 1):
        seen = kmer_counts(s, o + 1)
        total = seen.where("kmer is null").agg(F.sum("n").alias("t")).scalar()
        full = all_kmers(seqs.sparkSession, o + 1).join(seen, "kmer", "left")
        part = full.select("kmer", F.lit(o).alias("ord"), (F.coalesce("n", F.lit(0.1)) / total).alias("freq"))
        out = part if out is None else out.unionByName(part)
    return out


def kmer_table(seqs: DataFrame, k: int) -> DataFrame:
    """Counts + 1 of every ACGT word over distinct sequences."""
    seen = kmer_counts(seqs.select("seq").distinct(), k)
    return all_kmers(seqs.sparkSession, k).join(seen, "kmer", "left").select("kmer", (F.coalesce("n", F.lit(0)) + 1).alias("n"))


def _letters(pssm: DataFrame) -> list[Column]:
    return [F.col(x.lower()) for x in LETTERS]


def consensus(pssm: DataFrame, strong: float = 0.7, weak: float = 0.4) -> DataFrame:
    """(k, mot, consensus): best letter per position, lower case under 0.7, n under 0.4; ties alphabetical."""
    best = F.greatest(*_letters(pssm))
    letter = F.coalesce(*[F.when(F.col(x.lower()) == best, F.lit(x)) for x in LETTERS])
    c = F.when(best < weak, F.lit("n")).when(best < strong, F.lower(letter)).otherwise(letter)
    return _spell(pssm.select("k", "mot", "pos", c.alias("_c")), "consensus")


def _spell(chars: DataFrame, name: str) -> DataFrame:
    """Join the characters of a motif in position order; a motif has a fixed small width."""
    return chars.groupBy("k", "mot").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "_c"))), lambda x: x["_c"]), "").alias(name))


# fixed values: two- and three-letter sets and their ambiguity codes
AMBIGUITY = {
    "AG": "R", "GT": "K", "CG": "S", "CT": "Y", "AC": "M", "AT": "W",
    "CGT": "B", "ACT": "H", "AGT": "D", "ACG": "V", "ACGT": "N",
}


def consensus_regex(pssm: DataFrame, strong: float = 0.8, weak: float = 0.6, regex: bool = True) -> DataFrame:
    """(k, mot, pattern): letters over the cutoffs as a pattern, or as ambiguity codes."""
    over = lambda cut: F.concat(*[F.when(F.col(x.lower()) > cut, F.lit(x)).otherwise(F.lit("")) for x in LETTERS])
    mass = sum((F.when(F.col(x.lower()) > weak, F.col(x.lower())).otherwise(F.lit(0.0)) for x in LETTERS), F.lit(0.0))
    hi, lo = over(strong), over(weak)
    wrap = (lambda c: F.concat(F.lit("["), c, F.lit("]"))) if regex else _ambiguity
    several = F.when(mass > strong, wrap(lo)).when(mass > weak, wrap(F.lower(lo)))
    none = F.lit("[ACGT]") if regex else F.lit("N")
    c = F.coalesce(F.when(F.length(hi) == 1, hi).when(F.length(lo) >= 2, several).when(F.length(lo) == 1, F.lower(lo)), none)
    return _spell(pssm.select("k", "mot", "pos", c.alias("_c")), "pattern")


def _ambiguity(c: Column) -> Column:
    up = F.coalesce(*[F.when(F.upper(c) == s, F.lit(code)) for s, code in AMBIGUITY.items()], c)
    return F.when(c == F.lower(c), F.lower(up)).otherwise(up)


def information_content(pssm: DataFrame) -> DataFrame:
    """Entropy per position in bits, a zero counting as 1e-5."""
    p = [F.when(F.col(x.lower()) == 0, F.lit(1e-5)).otherwise(F.col(x.lower())) for x in LETTERS]
    h = sum((-(x * F.log2(x)) for x in p), F.lit(0.0))
    return pssm.select("k", "mot", "pos", h.alias("entropy"))


def filter_motifs(motifs: DataFrame, resid: DataFrame, e_cutoff: float, resid_cutoff: float) -> DataFrame:
    """Motifs whose E-value and cluster residual pass."""
    return motifs.join(resid.select("k", "resid"), "k").where((F.col("e_value") <= e_cutoff) & (F.col("resid") <= resid_cutoff))


def reverse_pssm(pssm: DataFrame) -> DataFrame:
    """Reverse complement of every motif."""
    w = Window.partitionBy("k", "mot")
    out = pssm.withColumn("_w", F.max("pos").over(w))
    return out.select("k", "mot", (F.col("_w") - F.col("pos") + 1).alias("pos"), F.col("t").alias("a"), F.col("g").alias("c"), F.col("c").alias("g"), F.col("a").alias("t"))


def column_similarity(metric: str, x: list[Column], y: list[Column]) -> Column:
    if metric == "ed":
        return -F.sqrt(sum(((a - b) * (a - b) for a, b in zip(x, y)), F.lit(0.0)))
    mean = lambda v: sum(v, F.lit(0.0)) / len(v)
    if metric == "spearman":
        rank = lambda v: [sum((F.when(o < c, 1.0).when(o == c, 0.5).otherwise(0.0) for o in v), F.lit(0.5)) for c in v]
        x, y = rank(x), rank(y)
    mx, my = mean(x), mean(y)
    cov = sum(((a - mx) * (b - my) for a, b in zip(x, y)), F.lit(0.0))
    vx, vy = sum(((a - mx) * (a - mx) for a in x), F.lit(0.0)), sum(((b - my) * (b - my) for b in y), F.lit(0.0))
    return cov / F.nullif(F.sqrt(vx * vy), F.lit(0.0))


def compare_pssms(pairs: DataFrame, pssm: DataFrame, metric: str = "pearson", min_overlap: int = 6, reverse: bool = False, weight: bool = False) -> DataFrame:
    """(pair, offset, overlap, score) for listed motif pairs (pair, k1, mot1, k2, mot2).

    Offset is the second motif's position minus the first's; the score is the mean column similarity.
    """
    second = reverse_pssm(pssm) if reverse else pssm
    one = pairs.join(pssm.select(F.col("k").alias("k1"), F.col("mot").alias("mot1"), F.col("pos").alias("p1"), *[F.col(x.lower()).alias(f"x{x}") for x in LETTERS]), ["k1", "mot1"])
    both = one.join(second.select(F.col("k").alias("k2"), F.col("mot").alias("mot2"), F.col("pos").alias("p2"), *[F.col(x.lower()).alias(f"y{x}") for x in LETTERS]), ["k2", "mot2"])
    x, y = [F.col(f"x{c}") for c in LETTERS], [F.col(f"y{c}") for c in LETTERS]
    s = column_similarity(metric, x, y)
    if weight:
        info = lambda v: 2 - sum((-(F.greatest(c, F.lit(1e-5)) * F.log2(F.greatest(c, F.lit(1e-5)))) for c in v), F.lit(0.0))
        s = s * F.least(info(x), info(y)) / 2
    g = both.groupBy("pair", (F.col("p2") - F.col("p1")).alias("offset")).agg(F.count(F.lit(1)).alias("overlap"), F.avg(s).alias("score"))
    return g.where(F.col("overlap") >= min_overlap)


BINS = 4096


def _align(a: np.ndarray, b: np.ndarray, min_overlap: int, metric: str):
    """Scores of every offset for motif stacks of one width each: yields (offset, overlap, scores[na, nb])."""
    if metric == "ed":
        sim = -np.sqrt(((a[:, None, :, None, :] - b[None, :, None, :, :]) ** 2).sum(axis=-1))
    else:
        ca = a - a.mean(axis=-1, keepdims=True)
        cb = b - b.mean(axis=-1, keepdims=True)
        num = np.einsum("aix,bjx->abij", ca, cb)
        den = np.sqrt((ca ** 2).sum(-1))[:, None, :, None] * np.sqrt((cb ** 2).sum(-1))[None, :, None, :]
        sim = num / np.where(den > 0, den, np.nan)
    w1, w2 = a.shape[1], b.shape[1]
    for off in range(-(w1 - 1), w2):
        lo, hi = max(0, -off), min(w1, w2 - off)
        if hi - lo >= min_overlap:
            i = np.arange(lo, hi)
            yield off, hi - lo, sim[:, :, i, i + off].mean(axis=-1)


def _stacks(pdf: pd.DataFrame) -> dict[int, tuple[pd.DataFrame, np.ndarray]]:
    out = {}
    for w, part in pdf.groupby(pdf["m"].map(len)):
        out[int(w)] = (part, np.stack([np.array([list(r) for r in m], dtype=float) for m in part["m"]]))
    return out


def pack_motifs(pssm: DataFrame) -> DataFrame:
    """(k, mot, m): one matrix per motif."""
    return pssm.groupBy("k", "mot").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", *[x.lower() for x in LETTERS]))), lambda r: F.array(*[r[x.lower()] for x in LETTERS])).alias("m"))


def motif_similarity(pssm: DataFrame, min_overlap: int = 4, p_cutoff: float = 0.01, metric: str = "ed", per_tile: int = 400) -> DataFrame:
    """Motif alignments in both orientations with an empirical p-value under ``p_cutoff``.

    p is 1 - ECDF of the score among alignments of the same overlap (overlap +-1 if fewer than 1000),
    times the number of offsets tried / 4. Motifs are cut into tiles and a task aligns one tile pair.
    Pass 1 only returns score histograms per overlap; they bound the score from which p can pass.
    Pass 2 emits the alignments above that bound with the bin of their score. An exact rank is the number of alignments in
    the bins above plus the rank within the bin, so they are shuffled once, by bin.
    """
    packed = materialize(pack_motifs(pssm), "motifs")
    size = packed.agg(F.count(F.lit(1)).alias("n"), F.min(F.size("m")).alias("w")).first()
    n_tiles = max(1, -(-size["n"] // per_tile))
    least_tests = max(1, 2 * max(size["w"] or 0, min_overlap) - 2 * min_overlap + 1)  # offsets of the narrowest motifs
    t = packed.withColumn("tile", F.pmod(F.xxhash64("k", "mot"), F.lit(n_tiles)).cast("int"))
    left = t.select("k", "mot", "m", F.col("tile").alias("ta"), F.explode(F.sequence(F.col("tile"), F.lit(n_tiles - 1))).alias("tb"))
    right = t.select(F.col("k").alias("k2"), F.col("mot").alias("mot2"), F.col("m").alias("m2"), F.col("tile").alias("tb"), F.explode(F.sequence(F.lit(0), F.col("tile"))).alias("ta"))
    left, right = spread(left, "ta", "tb"), spread(right, "ta", "tb")

    def runs(a: pd.DataFrame, b: pd.DataFrame):
        b = b.rename(columns={"k2": "k", "mot2": "mot", "m2": "m"})
        same = len(a) > 0 and len(b) > 0 and int(a["ta"].iloc[0]) == int(a["tb"].iloc[0])
        for pa, xa in _stacks(a).values():
            for pb, xb in _stacks(b).values():
                ka, ma, kb, mb = (v.to_numpy() for v in (pa["k"], pa["mot"], pb["k"], pb["mot"]))
                before = (ka[:, None] < kb[None, :]) | ((ka[:, None] == kb[None, :]) & (ma[:, None] < mb[None, :]))
                if same:
                    ok, flip = before, np.zeros_like(before)
                else:
                    ok, flip = np.ones_like(before), ~before
                for sign in (1, -1):
                    xr = xb if sign > 0 else xb[:, ::-1, ::-1]
                    found = list(_align(xa, xr, min_overlap, metric))
                    for off, ov, s in found:
                        yield (ka, ma, kb, mb), ok, flip, sign, off, ov, s, len(found), xa.shape[1], xb.shape[1]

    lo_edge, hi_edge = (-np.sqrt(2.0) - 1e-9, 1e-9) if metric == "ed" else (-1 - 1e-9, 1 + 1e-9)

    def to_bin(s: np.ndarray) -> np.ndarray:
        return np.clip(((s - lo_edge) / (hi_edge - lo_edge) * BINS).astype(int), 0, BINS - 1)

    def tally(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        acc: dict[int, np.ndarray] = {}
        for _, ok, _, _, _, ov, s, *_ in runs(a, b):
            acc.setdefault(ov, np.zeros(BINS, int))
            acc[ov] += np.bincount(to_bin(s[ok & np.isfinite(s)]), minlength=BINS)
        rows = [(ov, int(i), int(c[i])) for ov, c in acc.items() for i in np.nonzero(c)[0]]
        return pd.DataFrame(rows, columns=["overlap", "bin", "n"])

    hist = left.groupBy("ta", "tb").cogroup(right.groupBy("ta", "tb")).applyInPandas(tally, "overlap int, bin int, n long").groupBy("overlap", "bin").agg(F.sum("n").alias("n"))
    rows = hist.collect()  # overlaps x at most BINS records
    counts: dict[int, np.ndarray] = {}
    for r in rows:
        counts.setdefault(r["overlap"], np.zeros(BINS, dtype=np.int64))[r["bin"]] = r["n"]
    pools = {ov: [o for o in ((ov - 1, ov, ov + 1) if c.sum() < 1000 else (ov,)) if o in counts] for ov, c in counts.items()}
    size = {ov: int(sum(counts[o].sum() for o in p)) for ov, p in pools.items()}
    first_bin, above = {}, {}
    for ov, p in pools.items():
        # alignments of the pool in each bin and those above it; the last entry is zero
        above[ov] = np.append(np.cumsum(sum(counts[o] for o in p)[::-1])[::-1], 0)
        most = min(p_cutoff * (size[ov] - 1), p_cutoff * size[ov] * 4 / least_tests) * (1 + 1e-9)
        # a score with more alignments in the bins above it can't pass
        first_bin[ov] = int(np.nonzero(above[ov][1:] <= most)[0][0])
    keep_bin = {ov: min(first_bin[o] for o in counts if ov in pools[o]) for ov in counts}

    def emit(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        frames = []
        for (ka, ma, kb, mb), ok, flip, sign, off, ov, s, tests, w1, w2 in runs(a, b):
            i, j = np.nonzero(ok & np.isfinite(s) & (to_bin(s) >= keep_bin[ov]))
            if len(i) == 0:
                continue
            f = flip[i, j]
            # seen from the other motif the offset changes sign, and mirrors on the reverse strand
            other = -off if sign > 0 else off - w2 + w1
            frames.append(pd.DataFrame({
                "k1": np.where(f, kb[j], ka[i]), "mot1": np.where(f, mb[j], ma[i]), "k2": np.where(f, ka[i], kb[j]), "mot2": np.where(f, ma[i], mb[j]),
                "orientation": "+" if sign > 0 else "-", "offset": np.where(f, other, off), "overlap": ov, "score": s[i, j], "n_tests": tests, "bin": to_bin(s[i, j])}))
        cols = ["k1", "mot1", "k2", "mot2", "orientation", "offset", "overlap", "score", "n_tests", "bin"]
        return pd.concat(frames)[cols] if frames else pd.DataFrame({c: [] for c in cols})

    kt = pssm.schema["k"].dataType.simpleString()
    high = left.groupBy("ta", "tb").cogroup(right.groupBy("ta", "tb")).applyInPandas(
        emit, f"k1 {kt}, mot1 int, k2 {kt}, mot2 int, orientation string, offset int, overlap int, score double, n_tests int, bin int")
    shown = [c for c in high.columns if c != "bin"]
    spark = pssm.sparkSession
    if not pools:
        return high.select(*shown, F.lit(None).cast("double").alias("p_value"))
    pool = spark.createDataFrame([(ov, o) for ov, p in pools.items() for o in p], "pool int, overlap int")
    bins = spark.createDataFrame([(ov, i, int(above[ov][i + 1]), size[ov]) for ov in pools for i in range(first_bin[ov], BINS)], "pool int, bin int, _above long, total long")
    w = Window.partitionBy("pool", "bin").orderBy(F.desc("score"))
    ranked = high.join(F.broadcast(pool), "overlap").withColumn("_gt", F.rank().over(w) - 1).where(F.col("pool") == F.col("overlap"))
    j = ranked.join(F.broadcast(bins), ["pool", "bin"]).withColumn("_gt", F.col("_gt") + F.col("_above"))
    p = F.col("_gt") / F.col("total") * F.col("n_tests") / 4
    cut = F.col("_gt") < p_cutoff * (F.col("total") - 1)
    return j.where(cut).withColumn("p_value", p).where(F.col("p_value") <= p_cutoff).select(*shown, "p_value")


def symmetrize_pairs(pairs: DataFrame) -> DataFrame:
    """One record per unordered motif pair with the smaller p of both directions."""
    a, b = F.struct("k1", "mot1"), F.struct(F.col("k2").alias("k1"), F.col("mot2").alias("mot1"))
    rest = [c for c in pairs.columns if c not in ("k1", "mot1", "k2", "mot2", "p_value")]
    g = pairs.where(a != b).groupBy(F.least(a, b).alias("_a"), F.greatest(a, b).alias("_b")).agg(
        F.min("p_value").alias("p_value"), *[F.min_by(c, F.struct("p_value", *rest)).alias(c) for c in rest])
    return g.select(F.col("_a.k1").alias("k1"), F.col("_a.mot1").alias("mot1"), F.col("_b.k1").alias("k2"), F.col("_b.mot1").alias("mot2"), "p_value", *rest)


def combined_pssm(alignments: DataFrame, pssm: DataFrame) -> DataFrame:
    """(grp, pos, a, c, g, t): members of a motif group added up on the first motif's positions.

    ``alignments`` is (grp, k1, mot1, k2, mot2, orientation, offset) with the group's first motif as
    (k1, mot1) or (k2, mot2) and flagged by ``first`` = 1 or 2.
    """
    ref = F.col("first") == 1
    width = pssm.groupBy("k", "mot").agg(F.max("pos").alias("w"))
    al = alignments.select(
        "grp", "orientation", "offset", ref.alias("_ref1"),
        F.when(ref, F.col("k1")).otherwise(F.col("k2")).alias("rk"), F.when(ref, F.col("mot1")).otherwise(F.col("mot2")).alias("rm"),
        F.when(ref, F.col("k2")).otherwise(F.col("k1")).alias("k"), F.when(ref, F.col("mot2")).otherwise(F.col("mot1")).alias("mot"))
    al = al.join(width.select(F.col("k").alias("rk"), F.col("mot").alias("rm"), F.col("w").alias("rw")), ["rk", "rm"]).join(width, ["k", "mot"])
    cells = al.join(pssm, ["k", "mot"])
    plus = F.col("orientation") == "+"
    p = F.when(plus, F.col("pos")).otherwise(F.col("w") - F.col("pos") + 1)
    at = F.when(F.col("_ref1"), p - F.col("offset")).when(plus, p + F.col("offset")).otherwise(F.col("rw") - F.col("offset") - F.col("w") + p)
    flip = {"a": "t", "c": "g", "g": "c", "t": "a"}
    moved = cells.select("grp", at.alias("pos"), *[F.when(plus, F.col(x)).otherwise(F.col(flip[x])).alias(x) for x in "acgt"])
    first = al.select("grp", "rk", "rm").distinct().join(pssm.select(F.col("k").alias("rk"), F.col("mot").alias("rm"), "pos", "a", "c", "g", "t"), ["rk", "rm"]).select("grp", "pos", "a", "c", "g", "t")
    total = moved.unionByName(first).groupBy("grp", "pos").agg(*[F.sum(x).alias(x) for x in "acgt"])
    top = total.groupBy("grp").agg(F.max(F.greatest("a", "c", "g", "t")).alias("_m"))
    return total.join(top, "grp").select("grp", "pos", *[((F.col(x) + 1e-9) / (F.col("_m") + 1e-9)).alias(x) for x in "acgt"])


def cluster_motifs(pairs: DataFrame, cut: float = 0.5, min_size: int = 3) -> DataFrame:
    """(node, grp): average-linkage groups at height ``cut``, of at least ``min_size`` motifs.

    ``pairs`` is (a, b, p), one record per unordered pair; an absent pair has distance 1. Each round
    merges all reciprocal nearest neighbours under the cut, which for average linkage gives the same
    tree as one merge at a time; a group is only its label and summed distances, never a collected list.

    Motifs are numbered in the order of their names. A round shuffles the distances of the groups it merges and no
    others, and the tables of the round before are deleted, so one linkage table is kept at a time.
    """
    spark = pairs.sparkSession
    with recorded() as made:
        named = materialize(pairs.where(F.col("a") != F.col("b")).groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.min("p").alias("s")), "pairs")
        nodes = named.select(F.col("a").alias("node")).unionByName(named.select(F.col("b").alias("node"))).distinct()
        nodes = materialize(indexed(nodes, [], ["node"], "_i").select("node", F.col("_i").cast("int").alias("i")), "motif_names")
        numbered = named.join(nodes.select(F.col("node").alias("a"), F.col("i").alias("_a")), "a").join(nodes.select(F.col("node").alias("b"), F.col("i").alias("_b")), "b")
        dist_ = materialize(numbered.select(F.col("_a").alias("a"), F.col("_b").alias("b"), "s", F.lit(1).cast("long").alias("n")), "linkage")
        labels = materialize(nodes.select("i", F.col("i").alias("grp")), "labels")
        made[:] = drop_unused(spark, made, [dist_, labels, nodes])
        while True:  # every round merges one pair at least
            size = labels.groupBy("grp").agg(F.count(F.lit(1)).alias("c"))
            d = dist_.join(size.select(F.col("grp").alias("a"), F.col("c").alias("ca")), "a").join(size.select(F.col("grp").alias("b"), F.col("c").alias("cb")), "b")
            mean = (F.col("s") + F.col("ca") * F.col("cb") - F.col("n")) / (F.col("ca") * F.col("cb"))
            ends = d.select("a", "b", mean.alias("d")).where(F.col("d") <= cut).select(F.explode(F.array("a", "b")).alias("x"), "d", "a", "b")
            # the least distance first, then the pairs that have it: both aggregate by hash, where a struct would sort all pairs
            near = materialize(ends.groupBy("x").agg(F.min("d").alias("d")), "near")
            best = ends.join(near, ["x", "d"]).groupBy("x").agg(F.min(F.struct("d", "a", "b")).alias("key"))
            merge = materialize(best.groupBy("key").agg(F.count(F.lit(1)).alias("_n")).where("_n = 2").select(F.col("key.a").alias("into"), F.col("key.b").alias("gone")), "merge")
            if merge.isEmpty():
                drop_unused(spark, made, [dist_, labels, nodes])
                break
            labels = materialize(labels.join(merge, labels["grp"] == merge["gone"], "left").select("i", F.coalesce("into", "grp").alias("grp")), "labels")
            # both groups of a merge point to the one that stays
            to = merge.select(F.col("gone").alias("x"), F.col("into").alias("y")).unionByName(merge.select(F.col("into").alias("x"), F.col("into").alias("y")))
            moved = dist_.join(to.select(F.col("x").alias("a"), F.col("y").alias("_a")), "a", "left").join(to.select(F.col("x").alias("b"), F.col("y").alias("_b")), "b", "left")
            a, b = F.coalesce("_a", "a"), F.coalesce("_b", "b")
            same = F.col("_a").isNull() & F.col("_b").isNull()
            changed = moved.where(~same).select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b"), "s", "n").where("a <> b").groupBy("a", "b").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
            dist_ = materialize(moved.where(same).select("a", "b", "s", "n").unionByName(changed), "linkage")
            made[:] = drop_unused(spark, made, [dist_, labels, nodes])
    big = labels.groupBy("grp").agg(F.count(F.lit(1)).alias("_c")).where(F.col("_c") >= min_size)
    first = nodes.select(F.col("i").alias("grp"), F.col("node").alias("name"))
    return labels.join(big, "grp", "left_semi").join(nodes, "i").join(first, "grp").select("node", F.col("name").alias("grp"))


def _null_tail(logodds: np.ndarray, bg: np.ndarray, step: float = 0.01) -> tuple[int, np.ndarray]:
    """Tail probabilities of the integer score by convolving the positions under the background."""
    scaled = np.round(logodds / step).astype(int)
    low = int(scaled.min(axis=1).sum())
    dist_ = np.ones(1)
    for row in scaled:
        nxt = np.zeros(len(dist_) + row.max() - row.min())
        for x, p in zip(row - row.min(), bg):
            nxt[x:x + len(dist_)] += dist_ * p
        dist_ = nxt
    return low, np.minimum(1.0, np.cumsum(dist_[::-1])[::-1])


def _log_odds(m: list, bg: np.ndarray) -> np.ndarray:
    mat = np.array([list(r) for r in m], dtype=float) + 0.01
    return np.log2(mat / mat.sum(axis=1, keepdims=True) / bg)


#: Letters at the start of a window that are looked up together, and the window p that a hit needs.
GROUP, SCAN_CUTOFF = 8, 1e-4
#: Motifs of more letters than a group keep longer lists of open letter groups, so fewer of them go to the tasks at once.
WIDE_BLOCK = 200
#: Hits a task holds before it sends them, and hits in a batch it sends.
HELD, SENT = 500_000, 100_000


class _Strand:
    """One motif on one strand: integer steps by position and letter, the table of its first letters, and what is left to win."""

    def __init__(self, lo: np.ndarray, threshold: int):
        self.lo, self.threshold = lo, threshold
        self.steps = np.round(lo / 0.01).astype(np.int32)
        self.group = min(GROUP, len(lo))
        table = np.zeros(1, np.int32)
        for row in self.steps[:self.group]:
            table = (table[:, None] + row).ravel()
        best = self.steps.max(axis=1)
        self.rest = np.append(np.cumsum(best[::-1])[::-1], 0)  # most that the letters from each position on can add
        self.open = np.flatnonzero(table >= threshold - self.rest[self.group])
        self.start = table[self.open]
        letters = self.open[:, None] >> 2 * np.arange(self.group - 1, -1, -1) & 3
        #: Log odds of the open groups, where a group is all of the motif.
        self.score = lo[np.arange(self.group), letters].sum(axis=1) if self.group == len(lo) else None

    def hits(self, codes: np.ndarray, index: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(window, integer score, log odds) of the windows that reach the threshold.

        Only windows whose first letters can reach it are touched; one is left as soon as its other letters can't.
        """
        order, bounds = index
        n = bounds[self.open + 1] - bounds[self.open]
        at = order[np.repeat(bounds[self.open] - np.cumsum(n) + n, n) + np.arange(n.sum())]
        total = np.repeat(self.start, n)
        if self.score is not None:
            return at, total, np.repeat(self.score, n)
        for j in range(self.group, len(self.lo)):
            letter = codes[at + j]
            known = letter < 4
            total = total + self.steps[j][np.minimum(letter, 3)]
            live = known & (total >= self.threshold - self.rest[j + 1])
            at, total = at[live], total[live]
        return at, total, self.lo[np.arange(len(self.lo)), codes[at[:, None] + np.arange(len(self.lo))]].sum(axis=1)


def _window_index(codes: np.ndarray, starts: np.ndarray, group: int) -> tuple[np.ndarray, np.ndarray]:
    """Window starts sorted by their first ``group`` letters, and where each letter group begins among them."""
    key, whole = np.zeros(len(starts), np.int32), np.ones(len(starts), bool)
    for j in range(group):
        letter = codes[starts + j]
        whole &= letter < 4
        key = key * 4 + np.minimum(letter, 3)
    key = key[whole].astype(np.uint16)
    by = np.argsort(key, kind="stable")
    return starts[whole][by], np.searchsorted(key[by], np.arange(4**group + 1))


def scan_pssm(seqs: DataFrame, pssm: DataFrame, background: dict[str, float] | None = None, motif_block: int = 2000, cutoff: float = SCAN_CUTOFF, sizes: bool = False) -> DataFrame:
    """(id, k, mot, pos, strand, score, pvalue): best log-odds hit of every motif on every sequence, p of at most ``cutoff``.

    A motif's null tail turns the cutoff into a score threshold, so only hits leave the tasks. Windows are sorted by their
    first letters once a batch; a motif looks up which letter groups can still reach its threshold and follows those windows
    letter by letter under a look-ahead bound. Of several hits the highest score (to six places) counts, then the first
    position, then the plus strand. Pairs without a hit have no row; ``cutoff`` 1 gives all pairs with a window.

    Motifs go to the tasks in blocks of about ``motif_block``; a block is one pass over the pieces of the sequences, which are
    written once and spread over all tasks. A sequence of one piece, alone under its id, has its best hits within its task, so
    they are not shuffled; for the others a task keeps the best hit of its batch and ``max_by`` combines. ``sizes`` adds the
    sequence's length and the motif's width (``len``, ``w``), one row for each sequence of the id.
    """
    bg = np.array([(background or {}).get(x, 0.25) for x in LETTERS])
    spark = seqs.sparkSession
    k_type = to_arrow_type(pssm.schema["k"].dataType)
    names = ["id", "k", "mot", "pos", "strand", "score", "pvalue", *(["len", "w"] if sizes else [])]
    packed = materialize(pack_motifs(pssm), "motifs")
    size = packed.agg(F.max(F.size("m")).alias("w"), F.count(F.lit(1)).alias("n")).first()
    widest = size["w"] or 1
    blocks = max(1, -(-size["n"] // (motif_block if widest <= GROUP else min(motif_block, WIDE_BLOCK))))

    def scanner(rows):
        plan = []
        for r in rows:
            lo = _log_odds(r["m"], bg)
            low, tail = _null_tail(lo, bg)
            passing = np.flatnonzero(tail <= cutoff)
            if len(passing):
                threshold = low + int(passing[0])
                plan.append((r["k"], r["mot"], threshold, tail[passing[0]:], _Strand(lo, threshold), _Strand(lo[::-1, ::-1], threshold)))
        shared = spark.sparkContext.broadcast(plan)

        def scan(batches):
            plan = shared.value
            ks, mots, widths = pa.array([x[0] for x in plan], k_type), pa.array([x[1] for x in plan], pa.int32()), pa.array([len(x[4].lo) for x in plan], pa.int32())
            signs = pa.array(["+", "-"])
            for p in batches:
                number, at = p.column("id").dictionary_encode("encode").indices.to_numpy(), p.column("at").to_numpy()
                width = PIECE + widest
                codes = np.full((p.num_rows, width), 4, dtype=np.int8)
                for r, text in enumerate(p.column("piece").to_pylist()):
                    codes[r, :len(text)] = CODE[np.frombuffer(text.encode(), dtype=np.uint8)]
                codes = codes.ravel()
                starts = (np.arange(p.num_rows, dtype=np.int32)[:, None] * np.int32(width) + np.arange(PIECE, dtype=np.int32)).ravel()
                index = {g: _window_index(codes, starts, g) for g in {plus.group for *_, plus, _ in plan}}
                found, held = [], 0
                for m, (_, _, threshold, tail, *strands) in enumerate(plan):
                    for minus, one in enumerate(strands):
                        spot, total, score = one.hits(codes, index[one.group])
                        if len(spot):
                            row, col = np.divmod(spot, np.int32(width))
                            found.append((np.full(len(row), m, np.int32), row, at[row] + col + 1, np.full(len(row), minus, np.int8), np.round(score, 6), tail[total - threshold]))
                            held += len(spot)
                    if not found or held < HELD and m + 1 < len(plan):
                        continue
                    # all hits of a motif on the batch are here, and most pairs have one
                    m_, row, pos, minus, score, pvalue = (np.concatenate(x) for x in zip(*found))
                    found, held = [], 0
                    pair = m_.astype(np.int64) * (p.num_rows + 1) + number[row] + 1
                    by = np.argsort(pair)
                    tied = pair[by[1:]] == pair[by[:-1]]
                    if tied.any():
                        many = by[np.append(tied, False) | np.append(False, tied)]
                        many = many[np.lexsort((minus[many], pos[many], -score[many], pair[many]))]
                        worse = many[1:][pair[many[1:]] == pair[many[:-1]]]
                        keep = np.ones(len(pair), bool)
                        keep[worse] = False
                        m_, row, pos, minus, score, pvalue = (x[keep] for x in (m_, row, pos, minus, score, pvalue))
                    for lo in range(0, len(m_), SENT):
                        cut = slice(lo, lo + SENT)
                        which, rows_ = pa.array(m_[cut]), pa.array(row[cut])
                        cols = [p.column("id").take(rows_), ks.take(which), mots.take(which), pa.array(pos[cut].astype(np.int32)), signs.take(pa.array(minus[cut])), pa.array(score[cut]), pa.array(pvalue[cut])]
                        if sizes:
                            cols += [p.column("len").take(rows_), widths.take(which)]
                        yield pa.RecordBatch.from_arrays(cols, names)

        return scan

    idt, kt = seqs.schema["id"].dataType.simpleString(), pssm.schema["k"].dataType.simpleString()
    schema = f"id {idt}, k {kt}, mot int, pos int, strand string, score double, pvalue double" + (", len int, w int" if sizes else "")
    own = materialize(seqs.select("id", "seq", F.length("seq").alias("len")), "seqs")
    again = own.groupBy(F.col("id").alias("_id")).agg(F.count(F.lit(1)).alias("_rows")).where("_rows > 1")
    alone = own.join(again, F.col("id").eqNullSafe(F.col("_id")), "left").select("id", "seq", "len", (F.col("_rows").isNull() & (F.col("len") <= PIECE)).alias("alone"))
    cut = materialize(spread(pieces(alone, widest - 1), "id", "at"), "pieces")
    whole, parts = cut.where("alone"), cut.where("not alone")
    several = not parts.isEmpty()
    done = pieced = None
    for b in range(blocks):
        scan = scanner(packed.where(F.pmod(F.xxhash64("k", "mot"), F.lit(blocks)) == b).collect())
        best = whole.mapInArrow(scan, schema)
        done = best if done is None else done.unionByName(best)
        if several:
            best = parts.mapInArrow(scan, schema)
            pieced = best if pieced is None else pieced.unionByName(best)
    if not several:
        return done
    best = F.struct("score", -F.col("pos"), F.col("strand") == "+")
    kept = ["pos", "strand", "score", "pvalue", *(["w"] if sizes else [])]
    pieced = pieced.groupBy("id", "k", "mot").agg(*[F.max_by(c, best).alias(c) for c in kept])
    if sizes:
        pieced = pieced.join(own.select(F.col("id").alias("_id"), "len"), F.col("id").eqNullSafe(F.col("_id"))).drop("_id")
    return done.unionByName(pieced)


def sequence_pvalue(hits: DataFrame, lengths: DataFrame | None = None, widths: DataFrame | None = None) -> DataFrame:
    """p of the best hit over both strands of the whole sequence: 1 - (1 - p)^(2 (L - w + 1)).

    Without ``lengths`` and ``widths`` the hits carry them (``scan_pssm`` with ``sizes``).
    """
    n = 2 * F.greatest(F.col("len") - F.col("w") + 1, F.lit(1))
    p = -F.expm1(n * F.log1p(-F.least("pvalue", F.lit(1 - 1e-16))))
    sized = hits.where("id is not null and k is not null and mot is not null") if lengths is None else hits.join(lengths, "id").join(widths, ["k", "mot"])
    return sized.select("id", "k", "mot", "pos", "strand", "score", p.alias("pvalue"))


def _codes(text: str, k: int) -> np.ndarray:
    """The pure ACGT words of a sequence as base-4 numbers, in order."""
    c = CODE[np.frombuffer(text.encode(), dtype=np.uint8)]
    n = len(c) - k + 1
    if n < 1:
        return np.zeros(0, dtype=np.int64)
    word, pure = np.zeros(n, dtype=np.int64), np.ones(n, dtype=bool)
    for j in range(k):
        word = word * 4 + c[j:j + n]
        pure &= c[j:j + n] < 4
    return word[pure]


def distinct_words(seqs: DataFrame, k: int) -> DataFrame:
    """(row_id, words): the different pure ACGT words of each id as base-4 numbers.

    An id with one sequence has them within its task; only those of repeated ids meet in a shuffle.
    """
    own = materialize(seqs.select(F.col("id").alias("row_id"), "seq").where("seq is not null"), "seqs")
    again = own.groupBy(F.col("row_id").alias("_id")).agg(F.count(F.lit(1)).alias("_rows")).where("_rows > 1")
    flagged = own.join(again, F.col("row_id").eqNullSafe(F.col("_id")), "left").select("row_id", "seq", F.col("_rows").isNull().alias("alone"))

    def run(batches):
        for p in batches:
            words = pa.array([np.unique(_codes(s, k)) for s in p.column("seq").to_pylist()], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([p.column("row_id"), p.column("alone"), words], ["row_id", "alone", "words"])

    schema = T.StructType([own.schema["row_id"], T.StructField("alone", T.BooleanType()), T.StructField("words", T.ArrayType(T.LongType()))])
    found = materialize(small_batches(flagged).mapInArrow(run, schema), "words")
    met = found.where("not alone").select("row_id", F.explode("words").alias("_w")).groupBy("row_id").agg(F.collect_set("_w").alias("words"))
    return found.where("alone").select("row_id", "words").unionByName(met)


def word_text(word: Column, k: int) -> Column:
    return F.concat(*[F.substring(F.lit("".join(LETTERS)), F.shiftright(word, 2 * j).bitwiseAND(F.lit(3)).cast("int") + 1, F.lit(1)) for j in range(k - 1, -1, -1)])


def kmer_enrichment(seqs: DataFrame, row_member: DataFrame, k: int = 6, min_size: int = 3, max_size: int = 70, n_best: int = 2) -> DataFrame:
    """(k, mot, kmer, n_hit, n_in, n_hit_tot, n_tot, p_value, e_value): words over-represented in clusters."""
    words = distinct_words(seqs, k)
    mem = row_member.join(seqs.select(F.col("id").alias("row_id")).distinct(), "row_id", "left_semi")
    size = mem.groupBy("k").agg(F.count(F.lit(1)).alias("n_in")).where(F.col("n_in").between(min_size, max_size))
    tot = words.select(F.explode("words").alias("kmer")).groupBy("kmer").agg(F.count(F.lit(1)).alias("n_hit_tot"))
    n = seqs.agg(F.count(F.lit(1)).alias("n")).scalar()
    # the lists of a cluster, at most ``max_size``, come to one task and are counted there
    listed = spread(words.join(mem.join(size, "k", "left_semi"), "row_id").select("k", "words"), "k")
    inn = listed.select("k", F.explode("words").alias("kmer")).groupBy("k", "kmer").agg(F.count(F.lit(1)).alias("n_hit")).where("n_hit > 1")
    c = inn.join(size, "k").join(tot, "kmer").withColumn("n_tot", n)
    # only words more frequent inside than outside can be enriched
    c = c.where(F.col("n_hit") / F.col("n_in") > F.col("n_hit_tot") / F.col("n_tot"))
    d = lambda x: F.col(x).cast("double")
    p = dist.hypergeom_tail_inclusive(d("n_hit"), d("n_hit_tot"), d("n_tot") - d("n_hit_tot"), d("n_in"))
    c = c.withColumn("p_value", p).withColumn("kmer", word_text(F.col("kmer"), k))
    w = Window.partitionBy("k").orderBy("p_value", F.desc("n_hit"), "kmer")
    best = c.withColumn("mot", F.row_number().over(w)).where(F.col("mot") <= n_best)
    return best.select("k", "mot", "kmer", "n_hit", "n_in", "n_hit_tot", "n_tot", "p_value", (F.col("p_value") * float(4 ** k)).alias("e_value"))


def discover_kmers(seqs: DataFrame, row_member: DataFrame, k: int = 6, n_best: int = 2, **limits) -> tuple[DataFrame, DataFrame]:
    """(motifs, pssm): enriched words per cluster and their matrices from hits within one mismatch."""
    found = materialize(kmer_enrichment(seqs, row_member, k, n_best=n_best, **limits), "words")
    at = found.select("k", "mot", "kmer", F.explode(F.sequence(F.lit(1), F.lit(k))).alias("_i"))
    spots = at.select("k", "mot", "kmer", "_i", F.explode(F.array(*[F.lit(x) for x in LETTERS])).alias("_x"))
    near = spots.select("k", "mot", F.expr("overlay(kmer placing _x from _i for 1)").alias("word")).distinct()
    near = materialize(near.withColumn("code", F.conv(F.translate("word", LETTERS, "0123"), 4, 10).cast("long")), "near")
    wanted = near.groupBy("k").agg(F.collect_set("code").alias("near"))  # n_best times 3 k + 1 at most
    mem = row_member.select("k", F.col("row_id").alias("id")).distinct().join(wanted, "k")

    def count(batches):
        for p in batches:
            ks, codes, n = [], [], []
            for cluster, text, looked in zip(p["k"], p["seq"], p["near"]):
                code = _codes(text, k)
                got, c = np.unique(code[np.isin(code, looked)], return_counts=True)
                ks += [cluster] * len(got)
                codes.append(got)
                n.append(c)
            if ks:
                yield pd.DataFrame({"k": ks, "code": np.concatenate(codes), "n": np.concatenate(n)}).groupby(["k", "code"], as_index=False).sum()

    schema = T.StructType([row_member.schema["k"], T.StructField("code", T.LongType()), T.StructField("n", T.LongType())])
    members = seqs.select("id", "seq").where("seq is not null").join(mem, "id").select("k", "seq", "near")
    counted = small_batches(spread(members, "k")).mapInPandas(count, schema).groupBy("k", "code").agg(F.sum("n").alias("n"))
    occ = counted.join(near, ["k", "code"]).select("k", "mot", "word", "n")
    cells = occ.select("k", "mot", "n", "word", F.explode(F.sequence(F.lit(1), F.lit(k))).alias("pos")).withColumn("_b", F.expr("substring(word, pos, 1)"))
    pssm = cells.groupBy("k", "mot", "pos").agg(*[((F.sum(F.when(F.col("_b") == x, F.col("n")).otherwise(0)) + 0.25) / (F.sum("n") + 1)).alias(x.lower()) for x in LETTERS])
    sites = occ.groupBy("k", "mot").agg(F.sum("n").alias("nsites"))
    motifs = found.join(sites, ["k", "mot"]).select("k", "mot", "kmer", F.lit(k).alias("width"), "nsites", "p_value", "e_value")
    return motifs, pssm


def member_signature(row_member: DataFrame) -> DataFrame:
    """(k, n, sig): order-free signature of a member set, combined map-side."""
    return row_member.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("row_id")).alias("sig"), F.bit_xor(F.xxhash64(F.lit(7), "row_id")).alias("sig2"))


def changed_clusters(before: DataFrame, now: DataFrame) -> DataFrame:
    """Clusters whose member set differs from the previous run."""
    return member_signature(now).join(member_signature(before), ["k", "n", "sig", "sig2"], "left_anti").select("k")


def choose_palindrome(plain: DataFrame, pal: DataFrame) -> DataFrame:
    """Per cluster the form with the lower best E; the plain form's E counts as its square root."""
    a = plain.groupBy("k").agg(F.sqrt(F.min("e_value")).alias("_a"))
    b = pal.groupBy("k").agg(F.min("e_value").alias("_b"))
    pick = a.join(b, "k", "full").select("k", (F.coalesce("_b", F.lit(float("inf"))) < F.coalesce("_a", F.lit(float("inf")))).alias("is_pal"))
    keep = plain.join(pick.where("not is_pal"), "k", "left_semi").withColumn("is_pal", F.lit(False))
    return keep.unionByName(pal.join(pick.where("is_pal"), "k", "left_semi").withColumn("is_pal", F.lit(True)))


def prep_motif_input(seqs: DataFrame, max_width: int, weights: DataFrame | None = None) -> DataFrame:
    """Sequences long enough for the widest motif, with weight 0 where none is given."""
    out = seqs.where(F.col("seq").isNotNull() & (F.col("seq") != "") & (F.length("seq") >= max_width))
    if weights is None:
        return out.select("id", "seq", F.lit(0.0).alias("weight"))
    return out.join(weights, "id", "left").select("id", "seq", F.coalesce("weight", F.lit(0.0)).alias("weight"))


def normalize_priors(priors: Column | str) -> Column:
    """Position priors with missing or infinite values as 0, summing to less than 1."""
    c = F.col(priors) if isinstance(priors, str) else priors
    clean = F.transform(c, lambda x: F.when(F.isnan(x) | (F.abs(x) == float("inf")) | x.isNull(), F.lit(0.0)).otherwise(x))
    total = F.aggregate(clean, F.lit(0.0), lambda a, x: a + x) + 0.01
    return F.transform(clean, lambda x: x / total)


def motif_pvalue_matrix(hits: DataFrame, clusters: list[int]) -> DataFrame:
    """Row by cluster p-values, wide; only for export."""
    return hits.groupBy("row_id").pivot("k", clusters).agg(F.min("pvalue"))


def motif_positions(hits: DataFrame, lengths: DataFrame | None, motifs: DataFrame, e_cutoff: float, p_cutoff: float, n_bins: int, near: int = 0) -> DataFrame:
    """Histogram of hit positions relative to the sequence end; without ``lengths`` the hits carry them (``len``).

    Hits are tallied by motif and offset before anything else is joined, so a motif sends a row per offset at most.
    """
    good = hits.where((F.col("pvalue") < p_cutoff) & F.col("id").isNotNull())
    sized = good if lengths is None else good.join(lengths, "id")
    tally = sized.groupBy("k", "mot", (F.col("pos") - F.col("len") - near).alias("offset")).agg(F.count(F.lit(1)).alias("n"))
    passing = motifs.where(F.col("e_value") < e_cutoff)
    off = materialize(tally.join(passing, ["k", "mot"], "left_semi").groupBy("mot", "offset").agg(F.sum("n").alias("n")), "offsets")
    lo, hi = off.agg(F.min("offset").alias("v")).scalar(), off.agg((F.max("offset") + 1).alias("v")).scalar()
    return off.groupBy("mot", F.width_bucket(F.col("offset").cast("double"), lo.cast("double"), hi.cast("double"), F.lit(n_bins)).alias("bin")).agg(F.sum("n").alias("n"))


def motif_lines(motifs: DataFrame, pssm: DataFrame, logodds: bool = False) -> DataFrame:
    """(k, mot, ord, line): one text block per motif, ordered by ``ord`` within it."""
    kind = "log-odds matrix" if logodds else "letter-probability matrix"
    name = F.format_string("bic_%03d_%02d", F.col("k"), F.col("mot"))
    head = motifs.select("k", "mot", F.posexplode(F.array(
        F.lit(""), F.concat(F.lit("MOTIF "), name), F.concat(F.lit("BL   MOTIF "), name, F.lit(" width=0 seqs=0")),
        F.format_string(f"{kind}: alength= 4 w= %d nsites= %d E= %.3e", F.col("width").cast("int"), F.col("nsites").cast("long"), F.col("e_value")))).alias("ord", "line"))
    if logodds:
        row = F.format_string("%6d %6d %6d %6d", *[F.rint(F.log(F.col(x) + 0.01)).cast("long") for x in "acgt"])
    else:
        # format_number rounds the exact binary value half to even, as C printf does
        row = F.concat_ws(" ", *[F.expr(f"format_number({x}, '0.000')") for x in "acgt"])
    body = pssm.join(motifs.select("k", "mot"), ["k", "mot"], "left_semi").select("k", "mot", (F.col("pos") + 3).cast("int").alias("ord"), row.alias("line"))
    return head.unionByName(body)
