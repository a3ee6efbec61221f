"""Blocked row-by-row products.

Correlation, distance and mutual information between every row and the member rows need all column
cells of both rows at once. Joining cells on the column would emit one record per row pair and column.
Instead rows are packed into vectors, cut into tiles of bounded size, and each task multiplies one
tile of rows by one tile of member rows with numpy and emits only per-cluster partial sums.
"""

from __future__ import annotations

from collections.abc import Sequence

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from tessella.session import materialize, small_batches, spread

# largest number of cells one side of a tile holds
TILE_CELLS = 1_000_000
# rows of a tile and members that are measured at a time, small enough for a core's cache
BLOCK_ROWS, BLOCK_MEMBERS = 512, 1024
# probes that are compared with a whole tile at a time
BLOCK_PROBES = 64


def pack_rows(m: DataFrame, col_axis: DataFrame) -> DataFrame:
    """(row_id, vec): one dense vector per row, NaN for missing cells.

    ``col_axis`` is (col_id, ci) with ci = 0..n-1. A row holds at most one cell per column.
    """
    size = col_axis.agg(F.count(F.lit(1)).alias("n")).scalar()
    cells = m.join(col_axis, "col_id").groupBy("row_id").agg(F.map_from_entries(F.collect_list(F.struct("ci", "value"))).alias("_m")).withColumn("_n", size)
    spots = F.transform(F.sequence(F.lit(0), (F.col("_n") - 1).cast("int")), lambda i: F.coalesce(F.try_element_at("_m", i), F.lit(float("nan"))))
    return cells.select("row_id", spots.alias("vec"))


def column_axis(m: DataFrame, col: str = "col_id") -> DataFrame:
    """Stable 0-based index of the columns."""
    from tessella.functions.order import indexed

    return indexed(m.select(col).distinct(), [], [col], "_p").select(col, (F.col("_p") - 1).cast("int").alias("ci"))


def _ranks(x: np.ndarray) -> np.ndarray:
    """Average ranks per row, NaN kept."""
    return pd.DataFrame(x).rank(axis=1).to_numpy()


def _pair_sums(x: np.ndarray, y: np.ndarray):
    px, py = np.isfinite(x), np.isfinite(y)
    x0, y0 = np.where(px, x, 0.0), np.where(py, y, 0.0)
    fx, fy = px.astype(float), py.astype(float)
    return fx @ fy.T, x0 @ fy.T, fx @ y0.T, (x0 * x0) @ fy.T, fx @ (y0 * y0).T, x0 @ y0.T


def pairwise_corr(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Pearson correlation of all row pairs over the columns both have."""
    # centring first keeps the sum-of-products form accurate
    with np.errstate(all="ignore"):
        x = x - np.nanmean(x, axis=1, keepdims=True)
        y = y - np.nanmean(y, axis=1, keepdims=True)
        n, sx, sy, sxx, syy, sxy = _pair_sums(x, y)
        cov = sxy - sx * sy / n
        vx, vy = sxx - sx * sx / n, syy - sy * sy / n
        r = cov / np.sqrt(vx * vy)
    r[(n < 2) | (vx <= 1e-14 * np.maximum(sxx, 1e-300)) | (vy <= 1e-14 * np.maximum(syy, 1e-300))] = np.nan
    return np.clip(r, -1.0, 1.0)


def pairwise_distance(x: np.ndarray, y: np.ndarray, metric: str = "euclidean") -> np.ndarray:
    """Distances over shared columns; sums are scaled up for missing columns."""
    cols = x.shape[1]
    out = np.empty((len(x), len(y)))
    for j in range(len(y)):
        d = x - y[j]
        ok = np.isfinite(d)
        n = ok.sum(axis=1)
        d = np.where(ok, d, 0.0)
        with np.errstate(all="ignore"):
            if metric == "euclidean":
                out[:, j] = np.sqrt((d * d).sum(axis=1) * cols / n)
            elif metric == "manhattan":
                out[:, j] = np.abs(d).sum(axis=1) * cols / n
            elif metric == "maximum":
                out[:, j] = np.where(n > 0, np.abs(d).max(axis=1), np.nan)
            else:
                raise ValueError(f"unknown metric {metric}")
    return out


def _bins(x: np.ndarray, n_bins: int) -> np.ndarray:
    with np.errstate(all="ignore"):
        lo, hi = np.nanmin(x, axis=1, keepdims=True), np.nanmax(x, axis=1, keepdims=True)
        b = np.floor((x - lo) / np.where(hi > lo, hi - lo, 1.0) * n_bins)
    return np.where(np.isfinite(x), np.minimum(b, n_bins - 1), -1).astype(int)


def pairwise_information(x: np.ndarray, y: np.ndarray, estimator: str) -> np.ndarray:
    """Mutual information by equal-width bins (``empirical``) or from rank correlation (``spearman``)."""
    if estimator == "spearman":
        with np.errstate(all="ignore"):
            return -0.5 * np.log(1 - np.minimum(pairwise_corr(_ranks(x), _ranks(y)) ** 2, 1 - 1e-15))
    n_bins = max(2, int(np.sqrt(x.shape[1])))
    bx, by = _bins(x, n_bins), _bins(y, n_bins)
    on_x, on_y = (bx >= 0).astype(float), (by >= 0).astype(float)
    n = np.maximum(on_x @ on_y.T, 1)
    side_y = [(y_b := (by == b).astype(float), on_x @ y_b.T / n) for b in range(n_bins)]
    out = np.zeros_like(n)
    for a in range(n_bins):
        x_a = (bx == a).astype(float)
        pa = x_a @ on_y.T / n
        for y_b, pb in side_y:
            joint = x_a @ y_b.T / n
            with np.errstate(all="ignore"):
                out += np.where(joint > 0, joint * np.log(joint / (pa * pb)), 0.0)
    return out


def _unit(x: np.ndarray) -> np.ndarray:
    """Rows centred and scaled to length 1, NaN where a row does not vary."""
    x = x - x.mean(axis=1, keepdims=True)
    n, s, ss = x.shape[1], x.sum(axis=1), (x * x).sum(axis=1)
    var = ss - s * s / n
    var[var <= 1e-14 * np.maximum(ss, 1e-300)] = np.nan
    return (x - (s / n)[:, None]) / np.sqrt(var)[:, None]


def _joint_table(cols: int) -> np.ndarray:
    """c ln c of both counts packed into one number, low + (cols + 1) * high."""
    c = np.arange(cols + 1.0)
    f = c * np.log(np.maximum(c, 1.0))
    return (f[:, None] + f[None, :]).ravel()


#: Pairs of rows that almost agree, which are measured cell by cell.
NEAR = 1e-6


def _near(out: np.ndarray, at: np.ndarray, exact) -> None:
    """Put ``exact(i, j)`` at the marked pairs, some at a time."""
    i, j = np.nonzero(at)
    for lo in range(0, len(i), 16384):
        s, t = i[lo:lo + 16384], j[lo:lo + 16384]
        out[s, t] = exact(s, t)


def _prepare(x: np.ndarray, method: str) -> tuple[np.ndarray, ...]:
    """What a measure needs of one side, a row of each array per row; done once per tile. Rows must be whole."""
    kind, _, arg = method.partition(".")
    if kind in ("cor", "cor2", "abscor"):
        return (_unit(x),)
    if kind == "dist":
        return (x, (x * x).sum(axis=1))
    if kind == "mi" and arg == "empirical":
        n_bins = max(2, int(np.sqrt(x.shape[1])))
        hot = (_bins(x, n_bins)[:, :, None] == np.arange(n_bins)).astype(np.float32)
        c = hot.sum(axis=1, dtype=float)
        return (np.ascontiguousarray(hot.transpose(0, 2, 1)), (c * np.log(np.maximum(c, 1.0))).sum(axis=1))
    if kind == "mi":
        return (_unit(_ranks(x)),)
    raise ValueError(f"unknown method {method}")


def _corr_units(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    r = np.clip(x @ y.T, -1.0, 1.0)
    # the product of near copies is off by more than what is left of 1
    _near(r, r > 1 - NEAR, lambda i, j: 1 - 0.5 * ((x[i] - y[j]) ** 2).sum(axis=1))
    _near(r, r < NEAR - 1, lambda i, j: 0.5 * ((x[i] + y[j]) ** 2).sum(axis=1) - 1)
    return r


def _between(a: tuple[np.ndarray, ...], b: tuple[np.ndarray, ...], method: str) -> np.ndarray:
    """``_measure`` of all pairs of two prepared sides."""
    kind, _, arg = method.partition(".")
    x, y = a[0], b[0]
    if kind == "dist" and arg in ("", "euclidean"):
        squares = a[1][:, None] + b[1][None, :]
        d = squares - 2 * (x @ y.T)
        _near(d, d < NEAR * squares, lambda i, j: ((x[i] - y[j]) ** 2).sum(axis=1))
        return np.sqrt(d)
    if kind == "dist":
        out, gap = np.zeros((len(x), len(y))), np.empty((len(x), len(y)))
        for xc, yc in zip(np.ascontiguousarray(x.T), np.ascontiguousarray(y.T)):
            np.abs(np.subtract(xc[:, None], yc[None, :], out=gap), out=gap)
            if arg == "manhattan":
                out += gap
            elif arg == "maximum":
                np.maximum(out, gap, out=out)
            else:
                raise ValueError(f"unknown metric {arg}")
        return out
    if kind == "mi" and arg == "empirical":
        bins, cols = x.shape[1:]
        base = cols + 1
        f, n = _joint_table(cols), float(cols)
        total = np.zeros((len(x), len(y)))
        # counts are whole numbers up to the columns, so two of them fit one product
        two = [y[:, i] + (base * y[:, i + 1] if i + 1 < bins else 0) for i in range(0, bins, 2)]
        for i in range(bins):
            xi = np.ascontiguousarray(x[:, i])
            for pair in two:
                total += f[(xi @ pair.T).astype(np.int32)]
        return (total - a[1][:, None] - b[1][None, :]) / n + np.log(n)
    r = _corr_units(x, y)
    if kind == "mi":
        return -0.5 * np.log(1 - np.minimum(r * r, 1 - 1e-15))
    return np.log(1 - (r if kind == "cor" else r * r if kind == "cor2" else np.abs(r)) + 1e-99)


def _manhattan_sums(x: np.ndarray, y: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Summed Manhattan distance of every row of ``x`` to each run of rows of ``y``, the runs starting at ``first``.

    The distance is a sum over columns, and in a sorted column the sums of the values below and above a cell give those of
    its gaps, so no pair is looked at. Sums that are small beside the values they come from are measured pair by pair.
    """
    ends = np.append(first[1:], len(y))
    middle = y.mean(axis=0)
    x0, y0 = x - middle, y - middle
    total = np.zeros((len(x), len(first)))
    for xc, yc in zip(np.ascontiguousarray(x0.T), np.ascontiguousarray(y0.T)):
        by = np.argsort(xc)
        cell = xc[by]
        for i, (lo, hi) in enumerate(zip(first, ends)):
            run = np.sort(yc[lo:hi])
            upto = np.append(0.0, np.cumsum(run))
            under, over = np.searchsorted(run, cell, "left"), np.searchsorted(run, cell, "right")
            total[by, i] += (cell * under - upto[under]) + ((upto[-1] - upto[over]) - cell * (hi - lo - over))
    scale = np.abs(x0).sum(axis=1)[:, None] * (ends - first) + np.add.reduceat(np.abs(y0).sum(axis=1), first)
    for i, (lo, hi) in enumerate(zip(first, ends)):
        near = np.flatnonzero(total[:, i] < NEAR * scale[:, i])
        for at in range(0, len(near), BLOCK_ROWS):
            some = near[at:at + BLOCK_ROWS]
            total[some, i] = sum(_between((x[some],), (y[j:min(hi, j + BLOCK_MEMBERS)],), "dist.manhattan").sum(axis=1) for j in range(lo, hi, BLOCK_MEMBERS))
    return total


def _whole(method: str, *sides: np.ndarray) -> bool:
    """Whether no cell is missing, so that the pairs need no counts of shared columns."""
    fits = method != "mi.empirical" or (sides[0].shape[1] + 1) ** 2 < 1 << 22
    return fits and sides[0].shape[1] > 1 and all(np.isfinite(x).all() for x in sides)


def _measure(x: np.ndarray, y: np.ndarray, method: str) -> np.ndarray:
    kind, _, arg = method.partition(".")
    if kind == "cor":
        return np.log(1 - pairwise_corr(x, y) + 1e-99)
    if kind == "cor2":
        return np.log(1 - pairwise_corr(x, y) ** 2 + 1e-99)
    if kind == "abscor":
        return np.log(1 - np.abs(pairwise_corr(x, y)) + 1e-99)
    if kind == "dist":
        return pairwise_distance(x, y, arg or "euclidean")
    if kind == "mi":
        return pairwise_information(x, y, arg or "spearman")
    raise ValueError(f"unknown method {method}")


def _tile_count(n: int, n_cols: int, blocked: bool = False) -> int:
    """Tiles of one side: a tile holds at most TILE_CELLS numbers, and so do the pairs of two tiles.

    ``blocked`` is for tasks that hold the pairs of two blocks only: there a large side has fewer, larger tiles, and each
    row is copied less often.
    """
    side = max(1, min(TILE_CELLS // max(n_cols, 1), math.isqrt(TILE_CELLS)))
    if blocked:
        side = max(side, min(TILE_CELLS // max(n_cols, 1), -(-n // 8)))
    return max(1, -(-n // side))


def tiled(left: DataFrame, right: DataFrame, n_cols: int, left_key: str, right_key: str, blocked: bool = False) -> tuple[DataFrame, DataFrame]:
    """Assign both sides to tiles and copy each side once per tile of the other."""
    n_left = _tile_count(left.count(), n_cols, blocked)
    n_right = _tile_count(right.count(), n_cols, blocked)
    a = left.withColumn("lt", F.pmod(F.xxhash64(left_key), F.lit(n_left)).cast("int")).withColumn(
        "rt", F.explode(F.sequence(F.lit(0), F.lit(n_right - 1))))
    b = right.withColumn("rt", F.pmod(F.xxhash64(F.lit(7), right_key), F.lit(n_right)).cast("int")).withColumn(
        "lt", F.explode(F.sequence(F.lit(0), F.lit(n_left - 1))))
    return spread(a, "lt", "rt"), spread(b, "lt", "rt")


def member_means(vectors: DataFrame, row_member: DataFrame, n_cols: int, method: str) -> DataFrame:
    """(row_id, k, total, n): sum and count of ``method`` between a row and the other members of k."""
    members = row_member.join(vectors, "row_id").select("k", F.col("row_id").alias("member"), F.col("vec").alias("mvec"))
    left, right = tiled(vectors, members, n_cols, "row_id", "member", blocked=True)

    def block(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        b = b[b["k"].notna()].sort_values("k")
        if a.empty or b.empty:
            return pd.DataFrame({"row_id": [], "k": [], "total": [], "n": []})
        x, y = np.stack(a["vec"].to_numpy()).astype(float), np.stack(b["mvec"].to_numpy()).astype(float)
        rows, own = a["row_id"].to_numpy(), pd.Index(a["row_id"]).get_indexer(b["member"])
        number, ks = pd.factorize(b["k"])
        total, count = np.zeros((len(x), len(ks))), np.zeros((len(x), len(ks)), dtype=np.int64)
        whole = _whole(method, x, y)
        # a sorted run costs about as much as this many members one by one; sums of larger numbers might not be finite
        if whole and method == "dist.manhattan" and len(y) >= 16 * len(ks) and max(np.abs(x).max(), np.abs(y).max()) < 1e150:
            first = np.flatnonzero(np.append(True, number[1:] != number[:-1]))
            total[:, number[first]] = _manhattan_sums(x, y, first)
            count[:, number[first]] = np.diff(np.append(first, len(y)))
            mine = np.flatnonzero(own >= 0)
            np.subtract.at(count, (own[mine], number[mine]), 1)
            return sums(rows, ks, total, count)
        px, py = (_prepare(x, method), _prepare(y, method)) if whole else (None, None)
        for at in range(0, len(y), BLOCK_MEMBERS):
            ends = slice(at, at + BLOCK_MEMBERS)
            kinds = number[ends]
            first = np.flatnonzero(np.append(True, kinds[1:] != kinds[:-1]))
            here = kinds[first]
            side = tuple(v[ends] for v in py) if whole else None
            for lo in range(0, len(x), BLOCK_ROWS):
                d = _between(tuple(v[lo:lo + BLOCK_ROWS] for v in px), side, method) if whole else _measure(x[lo:lo + BLOCK_ROWS], y[ends], method)
                mine = own[ends] - lo
                j = np.flatnonzero((mine >= 0) & (mine < len(d)))
                d[mine[j], j] = np.nan
                ok = np.isfinite(d)
                total[lo:lo + len(d), here] += np.add.reduceat(np.where(ok, d, 0.0), first, axis=1)
                count[lo:lo + len(d), here] += np.add.reduceat(ok, first, axis=1, dtype=np.int64)
        return sums(rows, ks, total, count)

    def sums(rows: np.ndarray, ks: pd.Index, total: np.ndarray, count: np.ndarray) -> pd.DataFrame:
        return pd.DataFrame({"row_id": np.repeat(rows, len(ks)), "k": np.tile(np.asarray(ks), len(rows)), "total": total.ravel(), "n": count.ravel()})

    schema = T.StructType([
        T.StructField("row_id", vectors.schema["row_id"].dataType), T.StructField("k", row_member.schema["k"].dataType),
        T.StructField("total", T.DoubleType()), T.StructField("n", T.LongType())])
    parts = left.groupBy("lt", "rt").cogroup(right.groupBy("lt", "rt")).applyInPandas(block, schema)
    return parts.groupBy("row_id", "k").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))


def top_correlated(vectors: DataFrame, probes: DataFrame, n_cols: int, top: int) -> DataFrame:
    """(probe, row_id, r): the ``top`` rows most correlated with each probe row, itself excluded.

    Each tile keeps its own best ``top`` per probe, which contains the overall best, so only that
    bounded list is shuffled for the final rank.
    """
    side = probes.select(F.col("row_id").alias("probe")).join(vectors.select(F.col("row_id").alias("probe"), F.col("vec").alias("mvec")), "probe")
    left, right = tiled(vectors, side, n_cols, "row_id", "probe", blocked=True)

    def block(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if a.empty or b.empty:
            return pd.DataFrame({"probe": [], "row_id": [], "r": []})
        a = a.sort_values("row_id", ignore_index=True)  # ties go by position
        x, y = np.stack(b["mvec"].to_numpy()).astype(float), np.stack(a["vec"].to_numpy()).astype(float)
        own, frames = pd.Index(a["row_id"]).get_indexer(b["probe"]), []
        whole = _whole("cor", x, y)
        if whole:
            x, y = _unit(x), _unit(y)
        rows, probes = a["row_id"].to_numpy(), b["probe"].to_numpy()
        for lo in range(0, len(x), BLOCK_PROBES):
            r = _corr_units(x[lo:lo + BLOCK_PROBES], y) if whole else pairwise_corr(x[lo:lo + BLOCK_PROBES], y)
            mine = own[lo:lo + BLOCK_PROBES]
            j = np.flatnonzero(mine >= 0)
            r[j, mine[j]] = np.nan
            r = np.where(np.isfinite(r), r, -np.inf)
            least = np.partition(r, -top, axis=1)[:, -top] if top < r.shape[1] else np.full(len(r), -np.inf)
            i, c = np.nonzero((r >= least[:, None]) & (r > -np.inf))
            by = np.lexsort((c, -r[i, c], i))
            i, c = i[by], c[by]
            keep = np.arange(len(i)) - np.searchsorted(i, i) < top
            i, c = i[keep], c[keep]
            frames.append(pd.DataFrame({"probe": probes[lo + i], "row_id": rows[c], "r": r[i, c]}))
        return pd.concat(frames)

    rid = vectors.schema["row_id"].dataType
    schema = T.StructType([T.StructField("probe", rid), T.StructField("row_id", rid), T.StructField("r", T.DoubleType())])
    from pyspark.sql import Window

    best = left.groupBy("lt", "rt").cogroup(right.groupBy("lt", "rt")).applyInPandas(block, schema)
    w = Window.partitionBy("probe").orderBy(F.col("r").desc(), "row_id")
    return best.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= top)


def column_correlations(long: DataFrame, row: str, item: str, value: str, floor: int = 2) -> DataFrame:
    """(a, b, r, n) for item pairs a < b that share at least ``floor`` rows, correlated over those rows.

    Rows stream through each task once, adding to moment matrices over the items, so no pair is
    emitted per row; only one partial table per task is shuffled.
    """
    it = long.schema[item].dataType
    lists = long.where(F.col(value).isNotNull()).groupBy(row).agg(F.collect_list(F.struct(F.col(item).alias("i"), F.col(value).cast("double").alias("v"))).alias("cells"))

    def gram(batches):
        store: dict = {}
        keys: list = []
        acc = None
        for batch in batches:
            items = batch.column("i")
            known = items.flatten().dictionary_encode()
            for name in known.dictionary.to_pylist():
                if name not in store:
                    store[name] = len(keys)
                    keys.append(name)
            n = len(keys)
            if acc is None or acc.shape[1] < n:
                grown = np.zeros((4, n, n))
                if acc is not None:
                    grown[:, :acc.shape[1], :acc.shape[1]] = acc
                acc = grown
            column = np.array([store[x] for x in known.dictionary.to_pylist()], dtype=int)[known.indices.to_numpy()]
            cell = batch.column("v").flatten().to_numpy()
            end = np.append(0, np.cumsum(pc.list_value_length(items).to_numpy()))
            step = max(1, TILE_CELLS // max(1, n))
            for lo in range(0, len(items), step):
                hi = min(len(items), lo + step)
                at = (np.repeat(np.arange(hi - lo), np.diff(end[lo:hi + 1])), column[end[lo]:end[hi]])
                x, p = np.zeros((hi - lo, n)), np.zeros((hi - lo, n))
                x[at], p[at] = cell[end[lo]:end[hi]], 1.0
                acc[0] += p.T @ p
                acc[1] += x.T @ p
                acc[2] += (x * x).T @ p
                acc[3] += x.T @ x
        if acc is None:
            return
        ii, jj = np.triu_indices(len(keys), 1)
        swap = np.array([keys[i] > keys[j] for i, j in zip(ii, jj)], dtype=bool)
        a, b = np.where(swap, jj, ii), np.where(swap, ii, jj)
        names = pa.array(keys, to_arrow_type(it))
        for at in range(0, len(a), 100_000):
            s, t = a[at:at + 100_000], b[at:at + 100_000]
            sums = (acc[0][s, t], acc[1][s, t], acc[1][t, s], acc[2][s, t], acc[2][t, s], acc[3][s, t])
            yield pa.RecordBatch.from_arrays([names.take(pa.array(s)), names.take(pa.array(t)), *map(pa.array, sums)], ["a", "b", "n", "sa", "sb", "saa", "sbb", "sab"])

    schema = T.StructType([T.StructField("a", it), T.StructField("b", it)] + [T.StructField(c, T.DoubleType()) for c in ("n", "sa", "sb", "saa", "sbb", "sab")])
    sums = lists.select(F.col("cells.i").alias("i"), F.col("cells.v").alias("v")).mapInArrow(gram, schema).groupBy("a", "b").agg(*[F.sum(c).alias(c) for c in ("n", "sa", "sb", "saa", "sbb", "sab")])
    n = F.col("n")
    r = (F.col("sab") - F.col("sa") * F.col("sb") / n) / F.sqrt((F.col("saa") - F.col("sa") * F.col("sa") / n) * (F.col("sbb") - F.col("sb") * F.col("sb") / n))
    return sums.where(n >= floor).select("a", "b", r.alias("r"), n.cast("long").alias("n"))


def co_occurrence(long: DataFrame, groups: Sequence[str], item: str, block_rows: int = 256) -> DataFrame:
    """(a, b, n), a < b: number of groups two items share.

    Items are cut into blocks, each one record with its groups and a bit per item and group, and a task counts one pair of
    blocks at a time with incidence matrices, so a group holding a third of all items is never expanded into its pairs.
    Blocks travel in tiles of up to 16, one copy per tile of the other side.
    """
    it = long.schema[item].dataType
    inc = materialize(long.where(F.col(item).isNotNull()).select(F.xxhash64(*groups).alias("g"), F.col(item).alias("x")).distinct(), "incidence")
    cells, n_items = inc.agg(F.count(F.lit(1)), F.count_distinct("x")).first()
    n_blocks = max(1, -(-n_items // block_rows), -(-8 * cells // TILE_CELLS))
    n_tiles = max(min(n_blocks, 64), -(-n_blocks // 16))

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        x, i = np.unique(pdf["x"].to_numpy(), return_inverse=True)
        g, j = np.unique(pdf["g"].to_numpy(), return_inverse=True)
        bits = np.zeros((len(x), len(g)), dtype=bool)
        bits[i, j] = True
        return pd.DataFrame({"bl": [pdf["bl"].iloc[0]], "x": [list(x)], "g": [g], "m": [np.packbits(bits, axis=1).tobytes()]})

    by = inc.withColumn("bl", F.pmod(F.xxhash64("x"), F.lit(n_blocks)).cast("int"))
    shape = T.StructType([T.StructField("bl", T.IntegerType()), T.StructField("x", T.ArrayType(it)), T.StructField("g", T.ArrayType(T.LongType())), T.StructField("m", T.BinaryType())])
    blocks = materialize(spread(by, "bl").groupBy("bl").applyInPandas(pack, shape), "blocks")
    tile = F.floor(F.col("bl").cast("long") * n_tiles / n_blocks).cast("int")
    left = blocks.select(tile.alias("ta"), F.explode(F.sequence(tile, F.lit(n_tiles - 1))).alias("tb"), F.struct("bl", "x", "g", "m").alias("p"))
    right = blocks.select(F.explode(F.sequence(F.lit(0), tile)).alias("ta"), tile.alias("tb"), F.struct("bl", "x", "g", "m").alias("q"))
    # by sort, since Spark sizes the copies of a side as if they were not copied, and would broadcast them
    both = spread(left, "ta", "tb").join(spread(right, "ta", "tb").hint("merge"), ["ta", "tb"]).where("p.bl <= q.bl")

    def side(block):
        x, g = block["x"].values, block["g"].values.to_numpy()
        bits = np.frombuffer(block["m"].as_buffer(), dtype=np.uint8).reshape(len(x), -1)
        return x, g, np.unpackbits(bits, axis=1, count=len(g))

    def count(batches):
        for batch in batches:
            for p, q in zip(batch.column("p"), batch.column("q")):
                (xa, ga, ma), (xb, gb, mb) = side(p), side(q)
                shared, ia, ib = np.intersect1d(ga, gb, assume_unique=True, return_indices=True)
                if not len(shared):
                    continue
                # 0/1 products of 8,192 groups are whole numbers a float holds
                total = sum((ma[:, ia[at:at + 8192]].astype(np.float32) @ mb[:, ib[at:at + 8192]].astype(np.float32).T).astype(np.int32) for at in range(0, len(shared), 8192))
                total = np.triu(total, 1) if p["bl"].as_py() == q["bl"].as_py() else total
                rows = pa.ListArray.from_arrays(pa.array(np.arange(len(xa) + 1, dtype=np.int32) * len(xb)), pa.array(total.ravel()))
                lists = [pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), v) for v in (xa, xb, rows)]
                yield pa.RecordBatch.from_arrays(lists, ["x", "y", "n"])

    # Python gives one table of counts per pair of blocks, and Spark names the items of each
    counts = T.ArrayType(T.ArrayType(T.IntegerType()))
    schema = T.StructType([T.StructField("x", T.ArrayType(it)), T.StructField("y", T.ArrayType(it)), T.StructField("n", counts)])
    table = small_batches(both.select("p", "q")).mapInArrow(count, schema)
    line = table.select("x", "y", F.posexplode("n").alias("i", "n")).select(F.col("x")[F.col("i")].alias("u"), "y", "n")
    named = line.select("u", "y", F.posexplode("n").alias("j", "n")).where("n > 0").select("u", F.col("y")[F.col("j")].alias("v"), "n")
    return named.select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b"), F.col("n").cast("long").alias("n"))


def correlated_pairs(left: DataFrame, right: DataFrame, n_cols: int, cutoff: float) -> DataFrame:
    """(left_id, right_id, r) over ``cutoff`` between two vector tables (row_id, vec)."""
    a, b = tiled(left.select(F.col("row_id").alias("left_id"), F.col("vec").alias("lvec")), right.select(F.col("row_id").alias("right_id"), F.col("vec").alias("rvec")), n_cols, "left_id", "right_id")

    def block(p: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        if p.empty or q.empty:
            return pd.DataFrame({"left_id": [], "right_id": [], "r": []})
        r = pairwise_corr(np.stack(p["lvec"].to_numpy()).astype(float), np.stack(q["rvec"].to_numpy()).astype(float))
        i, j = np.nonzero(np.where(np.isfinite(r), r, -2) > cutoff)
        return pd.DataFrame({"left_id": p["left_id"].to_numpy()[i], "right_id": q["right_id"].to_numpy()[j], "r": r[i, j]})

    schema = T.StructType([T.StructField("left_id", left.schema["row_id"].dataType), T.StructField("right_id", right.schema["row_id"].dataType), T.StructField("r", T.DoubleType())])
    return a.groupBy("lt", "rt").cogroup(b.groupBy("lt", "rt")).applyInPandas(block, schema)
