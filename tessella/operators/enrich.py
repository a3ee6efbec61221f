"""Overlap counts, enrichment tests, permutation and resampling nulls, membership history."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.functions import distributions as dist
from tessella.functions.chance import uniform
from tessella.functions.order import indexed, running_sum
from tessella.operators import tiles
from tessella.operators.clusters import residual
from tessella.session import materialize, spread


def count_members_in(member: DataFrame, listed: DataFrame, axis: str = "row_id", min_size: int = 2) -> DataFrame:
    """(k, n_in, n_hit) for every cluster of at least ``min_size`` members."""
    hit = listed.select(axis).distinct().withColumn("_hit", F.lit(1))
    j = member.select("k", axis).join(hit, axis, "left")
    return j.groupBy("k").agg(F.count(F.lit(1)).alias("n_in"), F.count("_hit").alias("n_hit")).where(F.col("n_in") >= min_size)


def overlap_pvalue(counts: DataFrame, n_listed: Column, n_total: Column, n_clusters: Column, inclusive: bool = False, cap: bool = False) -> DataFrame:
    """Hypergeometric tail times the number of clusters.

    The default is P(X > hits) without a cap at 1; ``inclusive`` gives P(X >= hits).
    """
    tail = dist.hypergeom_tail_inclusive if inclusive else dist.hypergeom_tail
    # scalar subqueries cannot feed a Python stage directly: pin them as columns first
    c = counts.withColumn("_m", n_listed.cast("double")).withColumn("_t", n_total.cast("double")).withColumn("_c", n_clusters.cast("double"))
    p = tail(F.col("n_hit").cast("double"), F.col("_m"), F.col("_t") - F.col("_m"), F.col("n_in").cast("double"))
    c = c.withColumn("p_value", p * F.col("_c"))
    if cap:
        c = c.withColumn("p_value", F.least("p_value", F.lit(1.0)))
    return c.drop("_m", "_t", "_c")


def count_of(df: DataFrame, col: str) -> Column:
    return df.select(col).distinct().agg(F.count(F.lit(1)).alias("n")).scalar()


def count_members_matching(row_member: DataFrame, long_names: DataFrame, regex: str, max_rows: int | None = 999, min_rows: int = 2) -> DataFrame:
    """Members whose description matches, case-insensitive, for clusters of ``min_rows`` or more; NULL for clusters of ``max_rows`` or more."""
    named = row_member.join(long_names, "row_id", "left")
    hit = F.count(F.when(F.col("long_name").rlike(f"(?i){regex}"), 1))
    out = named.groupBy("k").agg(F.count(F.lit(1)).alias("n_in"), hit.alias("n_hit")).where(F.col("n_in") >= min_rows)
    return out if max_rows is None else out.withColumn("n_hit", F.when(F.col("n_in") < max_rows, F.col("n_hit")))


def members_matching_pvalue(row_member: DataFrame, long_names: DataFrame, regex: str, inclusive: bool = False) -> DataFrame:
    """(k, n_in, n_hit, p_value): members whose description matches, with the hypergeometric tail against all described rows."""
    counts = count_members_matching(row_member, long_names, regex, max_rows=None)
    matching = long_names.where(F.col("long_name").rlike(f"(?i){regex}"))
    return overlap_pvalue(counts, count_of(matching, "row_id"), count_of(long_names, "row_id"), count_of(row_member, "k"), inclusive)


def enrich_terms(row_member: DataFrame, annotation: DataFrame, ontology: Sequence[str] | None = None, inclusive: bool = False) -> DataFrame:
    """(k, term, n_in, n_hit, n_tot, n_hit_tot, p_value) for terms with more than one hit.

    The hit genes themselves come from ``term_members`` as rows, not as one string per term.
    """
    ann = annotation if ontology is None else annotation.where(F.col("ontology").isin(*ontology))
    ann = ann.select("term", "row_id").distinct()
    annotated = annotation.select("row_id").distinct()
    sizes = row_member.join(annotated, "row_id", "left_semi").groupBy("k").agg(F.count(F.lit(1)).alias("n_in"))
    hits = row_member.join(ann, "row_id").groupBy("k", "term").agg(F.count(F.lit(1)).alias("n_hit")).where("n_hit > 1")
    tot = ann.groupBy("term").agg(F.count(F.lit(1)).alias("n_hit_tot"))
    out = hits.join(sizes, "k").join(tot, "term").withColumn("n_tot", annotated.agg(F.count(F.lit(1)).alias("n")).scalar())
    d = lambda c: F.col(c).cast("double")
    tail = dist.hypergeom_tail_inclusive if inclusive else dist.hypergeom_tail
    return out.select("k", "term", "n_in", "n_hit", "n_tot", "n_hit_tot", tail(d("n_hit"), d("n_hit_tot"), d("n_tot") - d("n_hit_tot"), d("n_in")).alias("p_value"))


def term_members(row_member: DataFrame, annotation: DataFrame) -> DataFrame:
    return row_member.join(annotation.select("term", "row_id").distinct(), "row_id").select("k", "term", "row_id")


def ks_statistic(scores: DataFrame, flagged: DataFrame, keys: Sequence[str], value: str, item: str) -> DataFrame:
    """Largest gap between the score distributions of flagged and other items per key.

    Counts are first tallied by value, then accumulated in order over a range-partitioned sort.
    """
    j = scores.join(flagged.withColumn("_f", F.lit(1)), [*keys, item] if set(keys) <= set(flagged.columns) else [item], "left")
    tally = j.groupBy(*keys, value).agg(F.count("_f").cast("double").alias("_in"), (F.count(F.lit(1)) - F.count("_f")).cast("double").alias("_out"))
    run = running_sum(running_sum(tally, keys, [value], "_in", "_ci").drop("_in"), keys, [value], "_out", "_co")
    tot = j.groupBy(*keys).agg(F.count("_f").alias("n_in"), (F.count(F.lit(1)) - F.count("_f")).alias("n_out"))
    gap = F.abs(F.col("_ci") / F.col("n_in") - F.col("_co") / F.col("n_out"))
    return run.join(tot, list(keys)).groupBy(*keys).agg(F.max(gap).alias("ks"), F.first("n_in").alias("n_in"), F.first("n_out").alias("n_out")).where("n_in > 0 and n_out > 0")


def score_ttest(scores: DataFrame, member: DataFrame, with_p: bool = True) -> DataFrame:
    """Welch one-sided t test: scores outside against inside, alternative outside > inside."""
    j = scores.join(member.select("k", "row_id").withColumn("_in", F.lit(1)), ["k", "row_id"], "left")
    inside = F.when(F.col("_in").isNotNull(), F.col("score"))
    outside = F.when(F.col("_in").isNull(), F.col("score"))
    g = j.groupBy("k").agg(
        F.avg(inside).alias("_mi"), F.var_samp(inside).alias("_vi"), F.count(inside).alias("n_in"),
        F.avg(outside).alias("_mo"), F.var_samp(outside).alias("_vo"), F.count(outside).alias("n_out")).where("n_in > 1 and n_out > 1")
    a, b = F.col("_vi") / F.col("n_in"), F.col("_vo") / F.col("n_out")
    g = g.withColumn("t", (F.col("_mo") - F.col("_mi")) / F.sqrt(a + b)).withColumn(
        "df", F.pow(a + b, 2.0) / (a * a / (F.col("n_in") - 1) + b * b / (F.col("n_out") - 1)))
    out = g.select("k", "n_in", "n_out", "t", "df")
    return out.withColumn("p_value", dist.student_tail("t", "df")) if with_p else out


def ks_tail(x: Column) -> Column:
    """Limit of P(D > d) for two samples, ``x`` = d * sqrt(n * m / (n + m))."""
    small = sum((F.exp(-F.lit((2 * i - 1) ** 2 * math.pi**2 / 8) / (x * x)) for i in range(1, 6)), F.lit(0.0))
    large = sum((F.lit(2.0 * (-1) ** (i - 1)) * F.exp(F.lit(-2.0 * i * i) * x * x) for i in range(1, 7)), F.lit(0.0))
    return F.when(x <= 0, F.lit(1.0)).when(x < 1, 1 - F.lit(math.sqrt(2 * math.pi)) / x * small).otherwise(large)


def term_tests(scores: DataFrame, annotation: DataFrame, with_p: bool = True) -> DataFrame:
    """(k, term, n_in, n_out, ks, p_ks, t, df, p_t): every term's scores against those of all other rows of the cluster.

    Scores are ordered once per cluster. The gap between the two distributions is largest just at or just before the score
    of a member, so a term costs its members only, with the counts of rows up to and below their scores; means and
    variances outside are the cluster's sums minus the term's. Welch's test is one-sided (outside above inside). Rows
    without a score take no part. A term needs a row on both sides; t needs two on both and some spread, else NULL.
    """
    s = materialize(scores.where(F.col("score").isNotNull() & ~F.isnan("score")).select("k", "row_id", "score"), "scored")
    at = s.groupBy("k", "score").agg(F.count(F.lit(1)).cast("double").alias("_c"))
    upto = running_sum(at, ["k"], ["score"], "_c", "_upto")
    mean = s.groupBy("k").agg(F.count(F.lit(1)).alias("_n"), F.avg("score").alias("_m"), (F.var_pop("score") * F.count(F.lit(1))).alias("_q"))
    member = s.join(annotation.select("row_id", "term").distinct(), "row_id")
    tally = materialize(member.groupBy("k", "term", "score").agg(F.count(F.lit(1)).cast("double").alias("_i")), "tally")
    inside = tally.join(mean.select("k", "_m"), "k").withColumn("_d", F.col("score") - F.col("_m")).groupBy("k", "term").agg(
        F.sum("_i").cast("long").alias("n_in"), F.sum(F.col("_i") * F.col("_d")).alias("_s1"), F.sum(F.col("_i") * F.col("_d") * F.col("_d")).alias("_s2"))
    total = materialize(inside.join(mean.select("k", "_n", "_q"), "k").withColumn("n_out", F.col("_n") - F.col("n_in")).where("n_out > 0"), "terms")
    run = running_sum(tally, ["k", "term"], ["score"], "_i", "_ci").join(upto, ["k", "score"]).join(total.select("k", "term", "n_in", "n_out"), ["k", "term"])
    after = F.abs(F.col("_ci") / F.col("n_in") - (F.col("_upto") - F.col("_ci")) / F.col("n_out"))
    ci, below = F.col("_ci") - F.col("_i"), F.col("_upto") - F.col("_c")
    before = F.abs(ci / F.col("n_in") - (below - ci) / F.col("n_out"))
    ks = run.groupBy("k", "term").agg(F.max(F.greatest(after, before)).alias("ks"))
    n, m = F.col("n_in"), F.col("n_out")
    # sums around the cluster's mean, where the outside's are the inside's with the other sign
    si, so = (F.col("_s2") - F.col("_s1") * F.col("_s1") / n), (F.col("_q") - F.col("_s2") - F.col("_s1") * F.col("_s1") / m)
    enough = (n > 1) & (m > 1) & (si + so > 1e-12 * F.col("_q"))
    a, b = F.greatest(si, F.lit(0.0)) / (n - 1) / n, F.greatest(so, F.lit(0.0)) / (m - 1) / m
    t = F.when(enough, (-F.col("_s1") / m - F.col("_s1") / n) / F.sqrt(a + b))
    df = F.when(enough, F.pow(a + b, 2.0) / (a * a / (n - 1) + b * b / (m - 1)))
    out = total.join(ks, ["k", "term"]).select("k", "term", "n_in", "n_out", "ks", ks_tail(F.col("ks") * F.sqrt(n * m / (n + m))).alias("p_ks"), t.alias("t"), df.alias("df"))
    return out.withColumn("p_t", F.when(F.col("t").isNotNull(), dist.student_tail("t", "df"))) if with_p else out


def subnetwork_score(edges: DataFrame, row_member: DataFrame, net_weights: dict[str, float] | None = None) -> DataFrame:
    """Minus the net-weighted mean of the summed weights inside each cluster."""
    inside = edges.join(row_member.select("k", F.col("row_id").alias("src")), "src").join(row_member.select("k", F.col("row_id").alias("dst")), ["k", "dst"])
    return _net_mean(row_member.select("k").distinct(), inside.groupBy("k", "net").agg(F.sum("weight").alias("_s")), edges, net_weights, ["k"])


def _net_mean(every: DataFrame, sums: DataFrame, edges: DataFrame, net_weights: dict[str, float] | None, by: Sequence[str]) -> DataFrame:
    """(by, score) of ``every`` from the sums (by, net, _s)."""
    nets = net_weights or {}
    w = F.coalesce(*[F.when(F.col("net") == n, F.lit(float(v))) for n, v in nets.items()], F.lit(0.0)) if nets else F.lit(1.0)
    total = float(sum(nets.values())) if nets else None
    denom = F.lit(total) if total else count_of(edges, "net")
    return every.join(sums.groupBy(*by).agg(F.sum(w * F.col("_s")).alias("_s")), list(by), "left").select(*by, (-F.coalesce("_s", F.lit(0.0)) / denom).alias("score"))


#: Steps of the draws: a prime that does not divide the number of ids visits all of them before it repeats one.
STEPS = [p for p in range(1009, 2000) if all(p % q for q in range(2, 45))]


#: Draws times columns of a block, which the tasks go through in one pass, and cells or pairs that a task looks at together.
DRAWN_CELLS, HELD_CELLS = 200_000, 2_000_000


def _places(universe: DataFrame, axis: str, seed: int) -> DataFrame:
    """(axis, _p): the distinct ids and their 0-based places in one hashed order."""
    return indexed(universe.select(axis).distinct().withColumn("_u", uniform(axis, seed)), [], ["_u", axis], "_p").select(axis, (F.col("_p") - 1).alias("_p"))


def _walks(shapes: DataFrame, size: str, n: int, total: int, seed: int) -> DataFrame:
    """(size, draw, _a, _b): step and first place of every draw."""
    steps = [p for p in STEPS if total % p]
    each = shapes.select(size).distinct().select(size, F.explode(F.sequence(F.lit(1), F.lit(n))).alias("draw"))
    step = F.element_at(F.array(*[F.lit(p) for p in steps]), (F.floor(uniform("draw", size, seed, 1) * len(steps)) + 1).cast("int"))
    return each.select(size, "draw", step.alias("_a"), F.floor(uniform("draw", size, seed, 2) * total).alias("_b")).where(F.col(size) > 0)


def draws(universe: DataFrame, axis: str, shapes: DataFrame, size: str, n: int, seed: int) -> DataFrame:
    """(shape, draw, axis): for every distinct size, ``n`` seeded draws of that many ids without replacement.

    The ids stand in one hashed order. A draw starts at a hashed place and walks on in steps of a hashed prime, so exactly
    the wanted rows are made, and joined to the ids by place; no draw is sorted or filtered.
    """
    ids = _places(universe, axis, seed)
    total = ids.count()
    each = _walks(shapes, size, n, total, seed)
    walk = each.withColumn("_j", F.explode(F.sequence(F.lit(0).cast("bigint"), F.least(F.col(size), F.lit(total)).cast("bigint") - 1)))
    return walk.withColumn("_p", (F.col("_b") + F.col("_j") * F.col("_a")) % F.lit(total)).join(ids, "_p").select(size, "draw", axis)


class _Drawn:
    """A block of draws in a task: whether a place is in a draw follows from the walk, so the drawn ids are never listed."""

    def __init__(self, total: int, step: Sequence[int], first: Sequence[int], size: Sequence[int]):
        self.total, self.first = total, np.array(first, dtype=np.int64)
        self.back = np.array([pow(int(a), -1, total) for a in step], dtype=np.int64)
        self.size = np.array([min(int(s), total) for s in size], dtype=np.int64)

    def __len__(self) -> int:
        return len(self.first)

    def holds(self, place: np.ndarray, draw: np.ndarray | slice = slice(None)) -> np.ndarray:
        """Whether each place is in the draw; ``place`` and the draws are broadcast against each other."""
        return (place - self.first[draw]) * self.back[draw] % self.total < self.size[draw]


def _mixed(x: np.ndarray) -> np.ndarray:
    """A one-to-one mix of 32-bit numbers (the finalizer of MurmurHash3)."""
    for shift, times in ((16, 0x85EBCA6B), (13, 0xC2B2AE35)):
        x = (x ^ (x >> np.uint32(shift))) * np.uint32(times)
    return x ^ (x >> np.uint32(16))


def _sample_keys(place: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Keys that order the places anew for every pair ``a``, ``b``; no two places below 2^32 share one."""
    return _mixed(_mixed(place.astype(np.uint32) ^ a) + b)


def _last_key(total: int, size: int, a: np.uint32, b: np.uint32, step: int = 1 << 20) -> int:
    """The ``size``-th smallest key of the places under ``total``; the places are gone through in steps, never held together."""
    if size >= total:
        return (1 << 32) - 1
    keys = lambda lo: _sample_keys(np.arange(lo, min(total, lo + step)), a, b)
    count = sum(np.bincount(keys(lo) >> np.uint32(16), minlength=1 << 16) for lo in range(0, total, step))
    at = int(np.searchsorted(np.cumsum(count), size))
    rest = np.concatenate([k[k >> np.uint32(16) == at] for k in map(keys, range(0, total, step))])
    return int(np.partition(rest, (nth := size - int(count[:at].sum()) - 1))[nth])


def _samples(shapes: DataFrame, size: str, n: int, total: int, seed: int) -> DataFrame:
    """(size, draw, _a, _b, _t): ``n`` independent draws of every distinct size without replacement.

    Two hashed numbers order the places anew for every draw, and the draw is the first ``size`` of them, those with a key of
    ``_t`` at most: all sets of places are equally likely, and rows are drawn together by chance only.
    """
    if total > 1 << 32:
        raise ValueError("keys of 32 bits order 2^32 rows at most")
    sized = shapes.select(F.col(size).cast("long").alias(size)).distinct().where(F.col(size) > 0)
    each = sized.select(size, F.explode(F.sequence(F.lit(1), F.lit(n))).alias("draw"))
    number = lambda i: F.floor(uniform("draw", size, seed, i) * float(1 << 32))
    each = each.select(size, "draw", number(1).alias("_a"), number(2).alias("_b"))

    def last(batches):
        for pdf in batches:
            ab = pdf[["_a", "_b"]].to_numpy().astype(np.uint32)
            yield pdf.assign(_t=np.array([_last_key(total, int(w), a, b) for w, (a, b) in zip(pdf[size], ab)], dtype=np.int64))

    return materialize(spread(each, size, "draw").mapInPandas(last, f"`{size}` long, draw int, _a long, _b long, _t long"), "samples")


class _Sampled:
    """A block of independent draws in a task: a place is in a draw if its key there is not above the draw's last one."""

    def __init__(self, a: Sequence[int], b: Sequence[int], last: Sequence[int]):
        self.a, self.b, self.last = (np.array(x, dtype=np.uint32) for x in (a, b, last))

    def __len__(self) -> int:
        return len(self.last)

    def holds(self, place: np.ndarray, draw: np.ndarray | slice = slice(None)) -> np.ndarray:
        """As for ``_Drawn``."""
        return _sample_keys(place, self.a[draw], self.b[draw]) <= self.last[draw]


def _numbered(walks: DataFrame, order: Sequence[str], per_block: int) -> tuple[DataFrame, list[tuple[int, int]]]:
    """The draws with their 0-based number ``i``, and the ranges of numbers of the blocks."""
    walks = materialize(indexed(walks, [], order, "_i").withColumn("i", F.col("_i") - 1).drop("_i"), "draws")
    n, per_block = walks.count(), max(1, per_block)
    return walks, [(lo, min(n, lo + per_block)) for lo in range(0, n, per_block)]


def _block(walks: DataFrame, lo: int, hi: int) -> pd.DataFrame:
    return walks.where((F.col("i") >= lo) & (F.col("i") < hi)).toPandas().sort_values("i")  # parameters of a block of draws


def _placed(m: DataFrame, ids: DataFrame, axis: str) -> DataFrame:
    """The cells with the place of their row, spread over the tasks by row; neither side is sent whole to all tasks."""
    return spread(m, axis).join(ids.hint("merge"), axis)


def _union(parts: Sequence[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _packed_cells(batch, n_cols: int):
    """(places, values, present, known) of packed rows: one line per row, one block of columns per repeat of a cell."""
    import pyarrow.compute as pc

    place = batch.column("_p").to_numpy()
    row = np.repeat(np.arange(len(place)), pc.list_value_length(batch.column("cols")).to_numpy(zero_copy_only=False))
    col, val = batch.column("cols").flatten().to_numpy(), batch.column("vals").flatten()
    by = np.lexsort((col, row))
    key = row[by] * n_cols + col[by]
    new = np.append(True, key[1:] != key[:-1]) if len(key) else np.zeros(0, bool)
    again = np.arange(len(key)) - np.maximum.accumulate(np.where(new, np.arange(len(key)), 0))
    layers = int(again.max()) + 1 if len(key) else 1
    at = (row[by], again * n_cols + col[by])
    x, present, known = np.zeros((len(place), layers * n_cols)), np.zeros((len(place), layers * n_cols), bool), np.zeros((len(place), layers * n_cols), bool)
    sure = val.is_valid().to_numpy(zero_copy_only=False)[by]
    x[at], present[at], known[at] = np.where(sure, val.fill_null(0.0).to_numpy(zero_copy_only=False)[by], 0.0), True, sure
    return place, x, present, known, layers


def random_residuals(m: DataFrame, shapes: DataFrame, n: int, seed: int) -> DataFrame:
    """(nrows, _b, draw, resid): ``clusters.residual`` of ``n`` random blocks for each shape (nrows, _b, _c).

    The matrix is packed by row and read twice for a block of draws: once for the sums that give its row, column and whole
    means, once for the deviations. Only sums leave the tasks, so nothing grows with the rows a draw holds.
    """
    spark = m.sparkSession
    shapes = materialize(shapes.select("nrows", F.col("_b").alias("_s"), "_c"), "shapes")
    rid, cid = materialize(_places(m, "row_id", seed), "places"), materialize(_places(m, "col_id", seed + 1), "places")
    n_rows, n_cols = rid.count(), cid.count()
    r = _walks(shapes, "nrows", n, n_rows, seed).select("nrows", "draw", F.col("_a").alias("ra"), F.col("_b").alias("rb"))
    c = _walks(shapes, "_c", n, n_cols, seed + 1).select("_c", "draw", F.col("_a").alias("ca"), F.col("_b").alias("cb"))
    walks, blocks = _numbered(shapes.join(r, "nrows").join(c, ["_c", "draw"]), ["nrows", "_s", "draw"], DRAWN_CELLS // max(1, n_cols + 1))
    cells = _placed(m.select("row_id", "col_id", F.col("value").cast("double").alias("value")), rid, "row_id")
    cells = cells.join(F.broadcast(cid.select("col_id", F.col("_p").cast("int").alias("_q"))), "col_id")
    packed = cells.groupBy("row_id", "_p").agg(F.collect_list(F.struct("_q", "value")).alias("_l")).select("_p", F.col("_l._q").alias("cols"), F.col("_l.value").alias("vals"))
    packed = materialize(packed, "rows")

    def each(shared, batches):
        """Cells of every draw in every stack of rows: (draw, columns, values, present, known)."""
        rows, columns = shared
        for whole in batches:
            for lo in range(0, whole.num_rows, step := max(1, HELD_CELLS // 4 // n_cols)):
                place, x, present, known, layers = _packed_cells(whole.slice(lo, step), n_cols)
                some = max(1, HELD_CELLS // max(1, len(place)))
                for first in range(0, len(rows), some):
                    inside = np.ascontiguousarray(rows.holds(place[:, None], slice(first, first + some)).T)
                    for d, members in enumerate(inside, first):
                        own = np.flatnonzero(members)
                        if len(own):
                            at = (own[:, None], np.concatenate([columns[d] + n_cols * j for j in range(layers)]))
                            yield d, layers, x[at], present[at], known[at]

    def row_means(x, known):
        n = known.sum(axis=1)
        with np.errstate(all="ignore"):
            return x.sum(axis=1) / n, n

    def sums_of(lo, shared):
        def run(batches):
            rows, columns = shared.value
            width = max(map(len, columns))
            total, by_col = np.zeros((3, len(rows))), np.zeros((3, len(rows), width))
            for d, layers, x, present, known in each(shared.value, batches):
                mean, n = row_means(x, known)
                ok, cells = n > 0, present.sum(axis=1)
                total[:, d] += ((cells[ok] * mean[ok] / n[ok]).sum(), (cells[ok] / n[ok]).sum(), n.sum())
                for j, v in enumerate((x, known, present)):
                    by_col[j, d, :len(columns[d])] += v.sum(axis=0).reshape(layers, -1).sum(axis=0)
            i, j = np.nonzero(by_col[2] > 0)
            seen = np.unique(i)
            yield pa.RecordBatch.from_arrays([
                pa.array(np.append(seen, i) + lo), pa.array(np.append(np.full(len(seen), -1), j)), pa.array(np.append(total[0, seen], by_col[0, i, j])),
                pa.array(np.append(total[2, seen], by_col[1, i, j])), pa.array(np.append(total[1, seen], by_col[2, i, j]))], ["i", "j", "x", "n", "q"])

        return run

    def deviations_of(lo, shared, means):
        def run(batches):
            rows, columns = shared.value
            whole, by_col = means.value
            total = np.zeros((2, len(rows)))
            for d, layers, x, _, known in each(shared.value, batches):
                mean, _ = row_means(x, known)
                with np.errstate(all="ignore"):
                    off = np.abs(x - mean[:, None] - np.tile(by_col[d, :len(columns[d])], layers) + whole[d])
                total[:, d] += off[known].sum(), known.sum()
            i = np.flatnonzero(total[1])
            yield pa.RecordBatch.from_arrays([pa.array(i + lo), pa.array(total[0, i]), pa.array(total[1, i])], ["i", "off", "n"])

        return run

    found = []
    for lo, hi in blocks:
        b = _block(walks, lo, hi)
        columns = [(f + np.arange(min(int(w), n_cols)) * a) % n_cols for a, f, w in zip(b["ca"], b["cb"], b["_c"])]
        shared = spark.sparkContext.broadcast((_Drawn(n_rows, b["ra"], b["rb"], b["nrows"]), columns))
        sums = materialize(packed.mapInArrow(sums_of(lo, shared), "i long, j long, x double, n double, q double").groupBy("i", "j").agg(*[F.sum(x).alias(x) for x in "xnq"]), "sums")
        got = sums.toPandas()  # a row per draw and column of the block
        whole, by_col = np.full(hi - lo, np.nan), np.full((hi - lo, max(map(len, columns))), np.nan)
        top = got["j"] < 0
        with np.errstate(all="ignore"):
            whole[got["i"][top] - lo] = (got["x"] / got["q"])[top]
            by_col[got["i"][~top] - lo, got["j"][~top]] = (got["x"] / got["n"])[~top]
        means = spark.sparkContext.broadcast((whole, by_col))
        off = packed.mapInArrow(deviations_of(lo, shared, means), "i long, off double, n double").groupBy("i").agg((F.sum("off") / F.sum("n")).alias("_r"))
        top = F.col("j") < 0
        size = sums.groupBy("i").agg(F.max(F.when(top, F.round("q"))).alias("_nr"), F.max(F.when(top, F.col("n"))).alias("_n"), F.count_if(~top).alias("_nc"))
        poor = (F.col("_nr") <= 1) | (F.col("_nc") <= 1) | (1 - F.col("_n") / (F.col("_nr") * F.col("_nc")) > 0.95)
        found.append(size.join(off, "i", "left").select("i", F.when(poor, 1.0).otherwise(F.col("_r")).alias("resid")))
    if not found:
        return walks.select("nrows", F.col("_s").alias("_b"), "draw", F.lit(None).cast("double").alias("resid"))
    return materialize(_union(found), "residuals").join(walks, "i").select("nrows", F.col("_s").alias("_b"), "draw", "resid")


def permutation_pvalue(m: DataFrame, row_member: DataFrame, col_member: DataFrame, n: int = 1000, seed: int = 1, near: int = 3) -> DataFrame:
    """(k, nrows, ncols, resid, p_value): share of random blocks of the same shape at least as tight.

    Clusters with equal row counts and column counts in the same bucket (within ``near``) share one
    null, so the null job scales with the distinct shapes, not with the clusters.
    """
    bucket = (F.col("ncols") / (2 * near + 1)).cast("int")
    shaped = materialize(residual(m, row_member, col_member).withColumn("_b", bucket), "seen")
    null = random_residuals(m, shaped.groupBy("nrows", "_b").agg(F.min("ncols").alias("_c")), n, seed)
    j = shaped.join(null.select("nrows", "_b", F.col("resid").alias("_null")), ["nrows", "_b"])
    return j.groupBy("k", "nrows", "ncols", "resid").agg(F.avg((F.col("_null") <= F.col("resid")).cast("double")).alias("p_value"))


def random_network_sums(edges: DataFrame, universe: DataFrame, sizes: DataFrame, size: str, n: int, seed: int, per_block: int = 50_000) -> tuple[DataFrame, DataFrame]:
    """((size, draw) of all draws, (size, draw, net, _s) summed weight of the edges inside each draw).

    Edges carry the places of both ends and are read once for a block of draws: a task finds the draws that hold an edge's
    source and tests its other end in these, so neither the draws nor their edges are listed.
    """
    spark = edges.sparkSession
    ids = materialize(_places(universe, "row_id", seed), "places")
    total = ids.count()
    walks, blocks = _numbered(_walks(sizes, size, n, total, seed), [size, "draw"], per_block)
    e = edges.where("weight is not null").select("net", "src", "dst", F.col("weight").cast("double").alias("weight"))
    e = e.join(ids.select(F.col("row_id").alias("dst"), F.col("_p").alias("_d")), "dst").join(ids.select(F.col("row_id").alias("src"), F.col("_p").alias("_s")), "src")
    e = materialize(spread(e.select("net", "_s", "_d", "weight"), "_s").sortWithinPartitions("_s"), "edges")
    schema = T.StructType([T.StructField("i", T.LongType()), edges.schema["net"], T.StructField("_s", T.DoubleType())])

    def inside(lo, shared):
        def run(batches):
            drawn = shared.value
            acc: dict = {}
            for pdf in batches:
                code, names = pd.factorize(pdf["net"])
                own, deg = np.unique(pdf["_s"].to_numpy(), return_counts=True)
                order = np.argsort(pdf["_s"].to_numpy(), kind="stable")
                end = np.append(0, np.cumsum(deg))
                some = max(1, HELD_CELLS // len(drawn))
                for a in range(0, len(own), some):
                    src, draw = np.nonzero(drawn.holds(own[a:a + some, None]))
                    count = np.bincount(src, minlength=len(own[a:a + some]))
                    start = np.cumsum(count) - count
                    at = order[end[a]:end[min(a + some, len(own))]]
                    of = np.repeat(np.arange(len(count)), deg[a:a + some])
                    cuts = np.unique(np.append(np.searchsorted(np.cumsum(count[of]), np.arange(0, count[of].sum(), HELD_CELLS)), len(at)))
                    for x, z in zip(cuts[:-1], cuts[1:]):
                        k = count[of[x:z]]
                        edge = np.repeat(at[x:z], k)
                        which = draw[np.repeat(start[of[x:z]] - np.cumsum(k) + k, k) + np.arange(k.sum())]
                        hit = drawn.holds(pdf["_d"].to_numpy()[edge], which)
                        edge, which = edge[hit], which[hit]
                        for c, name in enumerate(names):
                            mine = code[edge] == c
                            acc[name] = acc.get(name, 0.0) + np.bincount(which[mine], pdf["weight"].to_numpy()[edge[mine]], len(drawn))
            for name, s in acc.items():
                i = np.flatnonzero(s)
                yield pd.DataFrame({"i": i + lo, "net": name, "_s": s[i]})

        return run

    parts = []
    for lo, hi in blocks:
        b = _block(walks, lo, hi)
        shared = spark.sparkContext.broadcast(_Drawn(total, b["_a"], b["_b"], b[size]))
        parts.append(e.mapInPandas(inside(lo, shared), schema))
    sums = _union(parts) if parts else spark.createDataFrame([], schema)
    sums = sums.groupBy("i", "net").agg(F.sum("_s").alias("_s")).join(walks, "i").select(size, "draw", "net", "_s")
    return walks.select(size, "draw"), sums


def permutation_pvalue_network(edges: DataFrame, row_member: DataFrame, universe: DataFrame, n: int = 1000, seed: int = 1, net_weights: dict[str, float] | None = None) -> DataFrame:
    """Same for the summed network weight inside each cluster; one null per distinct cluster size."""
    edges = materialize(edges.select("net", "src", "dst", "weight"), "edges")
    sizes = materialize(row_member.groupBy("k").agg(F.count(F.lit(1)).alias("nrows")), "sizes")
    seen = subnetwork_score(edges, row_member, net_weights).join(sizes, "k")
    every, sums = random_network_sums(edges, universe, sizes, "nrows", n, seed)
    null = _net_mean(every, sums, edges, net_weights, ["nrows", "draw"]).select("nrows", F.col("score").alias("_null"))
    return seen.join(null, "nrows").groupBy("k", "nrows", "score").agg(F.avg((F.col("_null") <= F.col("score")).cast("double")).alias("p_value"))


def cooccurrence_cloud(history: DataFrame, axis: str = "row_id") -> DataFrame:
    """Number of (iteration, cluster) two ids share."""
    return tiles.co_occurrence(history, ["iter", "k"], axis)


def membership_changes(history: DataFrame, step: int = 1) -> DataFrame:
    """Memberships that differ between iterations ``step`` apart."""
    iters = indexed(history.select("iter").distinct(), [], ["iter"], "_p").where((F.col("_p") - 1) % step == 0)
    nxt = iters.select(F.col("iter").alias("prev"), ((F.col("_p") - 1) / step).cast("long").alias("_o"))
    pairs = iters.select("iter", ((F.col("_p") - 1) / step - 1).cast("long").alias("_o")).join(nxt, "_o").select("iter", "prev")
    now = history.join(pairs, "iter").select("iter", "k", "row_id", F.lit(1).alias("_now"))
    old = history.withColumnRenamed("iter", "prev").join(pairs, "prev").select("iter", "k", "row_id", F.lit(1).alias("_old"))
    both = now.join(old, ["iter", "k", "row_id"], "full").where(F.col("_now").isNull() | F.col("_old").isNull())
    changed = both.groupBy("iter").agg(F.count(F.lit(1)).alias("_c"))
    return pairs.join(changed, "iter", "left").select("iter", F.coalesce("_c", F.lit(0)).alias("changed"))


def drawn_variances(m: DataFrame, sizes: DataFrame, size: str, n: int, seed: int, walk: bool = True) -> DataFrame:
    """(size, draw, col_id, _v): column variances of ``n`` random row sets per size, by ``draws`` or independent (``walk`` false).

    A task multiplies its cells by the draws that hold their rows and keeps one sum per draw and column; the drawn rows
    are never listed. Values are taken from their column's mean, which keeps the sums of squares accurate.
    """
    spark = m.sparkSession
    ids = materialize(_places(m, "row_id", seed), "places")
    total = ids.count()
    axis = tiles.column_axis(m)
    finite = F.when(F.abs("value") < float("inf"), F.col("value"))
    centre = materialize(axis.join(m.groupBy("col_id").agg(F.avg(finite).alias("_c")).withColumnRenamed("col_id", "_col"), F.col("col_id").eqNullSafe(F.col("_col")), "left").select("col_id", "ci", F.coalesce("_c", F.lit(0.0)).alias("_c")), "columns")
    n_cols = centre.count()
    walks, blocks = _numbered((_walks if walk else _samples)(sizes, size, n, total, seed), [size, "draw"], DRAWN_CELLS // max(1, n_cols))
    at = F.broadcast(centre.withColumnRenamed("col_id", "_col"))
    cells = _placed(m.select("row_id", "col_id", "value"), ids, "row_id").join(at, F.col("col_id").eqNullSafe(F.col("_col")))
    x = F.col("value") - F.col("_c")
    cells = materialize(cells.select("_p", "ci", F.col("value").isNotNull().alias("known"), F.when((F.abs("value") < float("inf")), x).alias("x")), "cells")

    def tally(lo, shared):
        def run(batches):
            drawn = shared.value
            acc = np.zeros((len(drawn), 5 * n_cols))
            for pdf in batches:
                own, row = np.unique(pdf["_p"].to_numpy(), return_inverse=True)
                known, x = pdf["known"].to_numpy(bool), pdf["x"].to_numpy(float)
                bad = known & np.isnan(x)
                x = np.where(np.isnan(x), 0.0, x)
                some = max(1, HELD_CELLS // max(5 * n_cols, len(drawn)))
                flat, by = np.zeros((len(own), 5 * n_cols)), row * (5 * n_cols) + pdf["ci"].to_numpy()
                for j, v in enumerate((np.ones(len(x)), known, x, x * x, bad)):
                    flat += np.bincount(by + j * n_cols, v, flat.size).reshape(flat.shape)
                for a in range(0, len(own), some):
                    acc += drawn.holds(own[a:a + some, None]).T.astype(float) @ flat[a:a + some]
            cells, n, s, ss, bad = acc.reshape(len(drawn), 5, n_cols).transpose(1, 0, 2)
            i, j = np.nonzero(cells)
            yield pd.DataFrame({"i": i + lo, "ci": j, "_n": n[i, j], "_s": s[i, j], "_ss": ss[i, j], "_bad": bad[i, j]})

        return run

    parts = []
    for lo, hi in blocks:
        b = _block(walks, lo, hi)
        shared = spark.sparkContext.broadcast(_Drawn(total, b["_a"], b["_b"], b[size]) if walk else _Sampled(b["_a"], b["_b"], b["_t"]))
        parts.append(cells.mapInPandas(tally(lo, shared), "i long, ci int, _n double, _s double, _ss double, _bad double"))
    sums = _union(parts) if parts else spark.createDataFrame([], "i long, ci int, _n double, _s double, _ss double, _bad double")
    sums = sums.groupBy("i", "ci").agg(*[F.sum(c).alias(c) for c in ("_n", "_s", "_ss", "_bad")])
    v = F.greatest(F.col("_ss") - F.col("_s") * F.col("_s") / F.col("_n"), F.lit(0.0)) / (F.col("_n") - 1)
    v = F.when(F.col("_n") > 1, F.when(F.col("_bad") > 0, F.lit(float("nan"))).otherwise(v))
    return sums.join(walks, "i").join(F.broadcast(centre.select("ci", "col_id")), "ci").select(size, "draw", "col_id", v.alias("_v"))


def variance_null(m: DataFrame, sizes: DataFrame, size: str, n: int, seed: int = 1, pooled: bool = False, walk: bool = False) -> DataFrame:
    """Mean and sd of the column variance of ``n`` random row sets per size, by column or pooled.

    The sets are independent; ``walk`` takes those of ``draws``, which all step through one order of the rows.
    """
    v = drawn_variances(m, sizes, size, n, seed, walk)
    keys = [size] if pooled else [size, "col_id"]
    return v.groupBy(*keys).agg(F.avg("_v").alias("mean_var"), F.stddev_samp("_v").alias("sd_var"))


def variance_sample_size(m: DataFrame, size: int, alpha: float = 0.01, probe: int = 31, seed: int = 1) -> DataFrame:
    """Draws needed: round((30 z(alpha/2))^2 / largest probed variance)."""
    import math

    one = m.sparkSession.range(1).select(F.lit(size).alias("n_rows"))
    v = drawn_variances(m, one, "n_rows", probe, seed)
    z = dist.normal_quantile(alpha / 2)
    return v.agg(F.round(F.lit((30 * z) ** 2) / F.max("_v")).cast("long").alias("n_samples")).withColumn("alpha", F.lit(math.fabs(alpha)))


def observed_variances(m: DataFrame, row_member: DataFrame) -> DataFrame:
    return m.join(row_member, "row_id").groupBy("k", "col_id").agg(F.var_samp("value").alias("var"))


def variance_pvalues(m: DataFrame, row_member: DataFrame, null: DataFrame, size: str = "nrows") -> DataFrame:
    """(k, col_id, p): normal CDF of the observed column variance under the null for that cluster size."""
    sizes = row_member.groupBy("k").agg(F.count(F.lit(1)).alias(size))
    obs = observed_variances(m, row_member).join(sizes, "k")
    keys = [size] if "col_id" not in null.columns else [size, "col_id"]
    z = (F.col("var") - F.col("mean_var")) / F.col("sd_var")
    return obs.join(null, keys).select("k", "col_id", dist.normal_cdf(z).alias("p"))


def condition_cutoff(m: DataFrame, row_member: DataFrame, null: DataFrame, p: float, size: str = "nrows") -> DataFrame:
    """Columns whose variance lies under the p-quantile of the null."""
    z = dist.normal_quantile(p)
    sizes = row_member.groupBy("k").agg(F.count(F.lit(1)).alias(size))
    obs = observed_variances(m, row_member).join(sizes, "k")
    keys = [size] if "col_id" not in null.columns else [size, "col_id"]
    return obs.join(null, keys).where(F.col("var") < F.col("mean_var") + z * F.col("sd_var")).select("k", "col_id", "var")
