"""Distributed order statistics that never put one group into one task.

A plain ``Window.partitionBy(key)`` sorts a whole key in a single task, and ``percentile`` keeps a
whole key's values in one buffer. Both break when one key holds a third of the data, so ranks come
from a range-partitioned global sort and quantiles from a sketch that brackets the wanted order
statistic followed by an exact count inside the bracket.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.session import materialize

CHUNK = 65536


def indexed(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], pos: str = "pos") -> DataFrame:
    """Add ``pos`` = 1-based position within ``keys`` in the given order.

    The sort is range partitioned on keys and order together, so a hot key spreads over tasks.
    """
    sort_cols = [F.col(k) for k in keys] + [F.col(o) if isinstance(o, str) else o for o in order]
    stamped = df.sort(*sort_cols).withColumn("_mid", F.monotonically_increasing_id())
    stamped = materialize(stamped, "indexed")
    stamped = stamped.withColumn("_part", F.shiftright("_mid", 33)).withColumn(
        "_off", F.col("_mid").bitwiseAND(F.lit((1 << 33) - 1))
    )
    # one row per (sort task, key): the group spans consecutive tasks
    spans = stamped.groupBy("_part", *keys).agg(F.count(F.lit(1)).alias("_n"), F.min("_off").alias("_first"))
    w = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.withColumn("_before", F.coalesce(F.sum("_n").over(w), F.lit(0))).select(
        "_part", *[F.col(k).alias(f"_k_{k}") for k in keys], (F.col("_before") - F.col("_first")).alias("_shift")
    )
    cond = [F.col("_part") == F.col("_sp")] + [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys]
    joined = stamped.join(spans.withColumnRenamed("_part", "_sp"), cond)
    return joined.select(*df.columns, (F.col("_off") + F.col("_shift") + 1).cast("long").alias(pos))


def min_rank(df: DataFrame, keys: Sequence[str], value: str, tie: Sequence[str], out: str = "rnk") -> DataFrame:
    """Rank with ties sharing the lowest position (``rank(ties="min")``)."""
    idx = indexed(df, keys, [value, *tie], "_pos")
    low = idx.groupBy(*keys, value).agg(F.min("_pos").alias(out))
    return idx.drop("_pos").join(low, [*keys, value])


def quantiles(
    df: DataFrame, keys: Sequence[str], value: str, probs: dict[str, float], eps: float = 0.001
) -> DataFrame:
    """Exact type-7 quantiles per key: one output column per entry of ``probs``.

    Pass 1 brackets each wanted order statistic with a mergeable sketch (map-side combined).
    Pass 2 counts the values below the bracket and tallies only the values inside it.
    """
    keys = list(keys)
    names = list(probs)
    src = df.where(F.col(value).isNotNull() & ~F.isnan(value)).select(*keys, F.col(value).cast("double").alias("_v"))
    cuts: list[float] = []
    for n in names:
        cuts += [max(0.0, probs[n] - eps), min(1.0, probs[n] + eps)]
    sketch = src.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"),
        F.min("_v").alias("_min"),
        F.max("_v").alias("_max"),
        F.percentile_approx("_v", cuts, int(10 / eps)).alias("_cuts"),
    )
    wanted = F.array(
        *[
            F.struct(
                F.lit(n).alias("p"),
                (F.lit(float(probs[n])) * (F.col("_n") - 1)).alias("h"),
                F.when(F.lit(probs[n] <= eps) | (F.col("_n") < 3 / eps), F.col("_min"))
                .otherwise(F.col("_cuts")[2 * i])
                .alias("lo"),
                F.when(F.lit(probs[n] >= 1 - eps) | (F.col("_n") < 3 / eps), F.col("_max"))
                .otherwise(F.col("_cuts")[2 * i + 1])
                .alias("hi"),
            )
            for i, n in enumerate(names)
        ]
    )
    sketch = sketch.select(*keys, wanted.alias("_w"))
    if keys:
        marked = src.join(materialize(sketch, "brackets"), keys)
    else:
        found = sketch.first()["_w"]
        marked = src.withColumn(
            "_w",
            F.array(*[F.struct(F.lit(b["p"]).alias("p"), F.lit(b["h"]).alias("h"), F.lit(b["lo"]).cast("double").alias("lo"), F.lit(b["hi"]).cast("double").alias("hi")) for b in found]),
        )
    marked = marked.select(*keys, "_v", F.explode("_w").alias("_b")).where(F.col("_v") <= F.col("_b.hi"))
    tally = marked.groupBy(
        *keys,
        F.col("_b.p").alias("_p"),
        F.col("_b.h").alias("_h"),
        F.when(F.col("_v") < F.col("_b.lo"), F.lit(None).cast("double")).otherwise(F.col("_v")).alias("_v"),
    ).agg(F.count(F.lit(1)).alias("_c"))
    w = Window.partitionBy(*keys, "_p").orderBy(F.col("_v").asc_nulls_first())
    run = tally.withColumn("_hi", F.sum("_c").over(w)).withColumn("_lo", F.col("_hi") - F.col("_c"))
    floor_pos, ceil_pos = F.floor("_h"), F.ceil("_h")
    picked = run.groupBy(*keys, "_p", "_h").agg(
        F.max(F.when((F.col("_lo") <= floor_pos) & (floor_pos < F.col("_hi")), F.col("_v"))).alias("_a"),
        F.max(F.when((F.col("_lo") <= ceil_pos) & (ceil_pos < F.col("_hi")), F.col("_v"))).alias("_z"),
    )
    val = F.col("_a") + (F.col("_h") - F.floor("_h")) * (F.col("_z") - F.col("_a"))
    picked = picked.withColumn("_q", val)
    aggs = [F.max(F.when(F.col("_p") == n, F.col("_q"))).alias(n) for n in names]
    return picked.groupBy(*keys).agg(*aggs)


LISTED = 100_000  # rows of a bracket that are tallied on the driver


def scalar_quantiles(df: DataFrame, wanted: dict[str, tuple[Column, float]], listed: int = LISTED, eps: float = 0.001) -> dict[str, float | None]:
    """Exact type-7 quantiles of several expressions over the whole frame as driver scalars; NULL and NaN are skipped.

    A mergeable sketch brackets every wanted order statistic, all in one pass, and the values inside a bracket are
    bracketed again until at most ``listed`` rows (or one value) are left, which the last pass tallies. An expression without
    a value gives None. The same steps run at every size.
    """
    value = {x: F.when(c.isNotNull() & ~F.isnan(c.cast("double")), c.cast("double")) for x, (c, _) in wanted.items()}
    names = list(wanted)
    st = df.agg(*[f(value[x]).alias(f"{s}{i}") for i, x in enumerate(names) for s, f in (("n", F.count), ("a", F.min), ("z", F.max))]).first()
    out: dict[str, float | None] = {x: None for x in names}
    # per name: lowest and highest value of the bracket, values below it, values in it, wanted position
    state = {x: (st[f"a{i}"], st[f"z{i}"], 0, st[f"n{i}"], wanted[x][1] * (st[f"n{i}"] - 1)) for i, x in enumerate(names) if st[f"n{i}"]}
    while todo := [x for x, (lo, hi, _, n, _) in state.items() if n > listed and lo < hi]:
        aggs = []
        for i, x in enumerate(todo):
            lo, hi, below, n, h = state[x]
            inside = F.when((value[x] >= lo) & (value[x] <= hi), value[x])
            share = (h - below) / max(1, n - 1)
            aggs.append(F.percentile_approx(inside, [max(0.0, share - eps), min(1.0, share + eps)], int(10 / eps)).alias(f"c{i}"))
        sketch = df.agg(*aggs).first()
        aggs = []
        for i, x in enumerate(todo):
            lo, hi = sketch[f"c{i}"]
            aggs += [F.count_if(value[x] < lo).alias(f"b{i}"), F.count_if((value[x] >= lo) & (value[x] <= hi)).alias(f"n{i}")]
        counts = df.agg(*aggs).first()
        for i, x in enumerate(todo):
            (lo, hi), (_, _, _, n, h) = sketch[f"c{i}"], state[x]
            below, now = counts[f"b{i}"], counts[f"n{i}"]
            if not below <= int(h) or not -int(-h // 1) < below + now or now >= n:
                listed = max(listed, n)  # ties fill the bracket: few values, so the tally is short
            else:
                state[x] = (lo, hi, below, now, h)
    if not state:
        return out
    items = [F.when((value[x] >= lo) & (value[x] <= hi), F.struct(F.lit(x).alias("q"), value[x].alias("v"))) for x, (lo, hi, *_) in state.items()]
    flat = df.select(F.explode(F.array(*items)).alias("e")).where("e is not null")
    tally: dict[str, list[tuple[float, int]]] = {x: [] for x in state}
    for r in flat.groupBy("e.q", "e.v").agg(F.count(F.lit(1)).alias("c")).collect():
        tally[r["q"]].append((r["v"], r["c"]))
    for x, (_, _, seen, _, h) in state.items():
        low, high = None, None
        for v, c in sorted(tally[x]):
            if low is None and seen + c > int(h):
                low = v
            if seen + c > -int(-h // 1):
                high = v
                break
            seen += c
        out[x] = low + (h - int(h)) * (high - low)
    return out


def trimmed_mean(df: DataFrame, keys: Sequence[str], value: str, trim: float, tie: Sequence[str], out: str) -> DataFrame:
    """Mean after dropping ``floor(n*trim)`` values from each end."""
    src = df.where(F.col(value).isNotNull())
    idx = indexed(src, keys, [value, *tie], "_pos")
    cnt = src.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    both = idx.join(cnt, list(keys))
    drop = F.floor(F.col("_n") * F.lit(float(trim)))
    kept = both.where((F.col("_pos") > drop) & (F.col("_pos") <= F.col("_n") - drop))
    return kept.groupBy(*keys).agg(F.avg(value).alias(out))


def carry_forward(
    df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], value: Column, out: str, chunk: int = CHUNK
) -> DataFrame:
    """Last non-null ``value`` at or before each row, in two levels so a hot key stays spread."""
    idx = indexed(df.withColumn("_val", value), keys, order, "_pos").withColumn(
        "_chunk", F.floor((F.col("_pos") - 1) / F.lit(chunk)).cast("long")
    )
    tails = idx.groupBy(*keys, "_chunk").agg(
        F.max_by("_val", F.when(F.col("_val").isNotNull(), F.col("_pos"))).alias("_tail")
    )
    w = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    tails = tails.withColumn("_carry", F.last("_tail", ignorenulls=True).over(w)).drop("_tail")
    inner = Window.partitionBy(*keys, "_chunk").orderBy("_pos").rowsBetween(Window.unboundedPreceding, 0)
    local = idx.withColumn("_here", F.last("_val", ignorenulls=True).over(inner))
    return local.join(tails, [*keys, "_chunk"], "left").select(
        *df.columns, F.coalesce("_here", "_carry").alias(out)
    )


def with_halo(
    df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], before: int, after: int, chunk: int = CHUNK
) -> DataFrame:
    """Split each ordered key into chunks and copy the neighbouring rows a bounded frame needs.

    Returns the rows with ``_chunk``, ``_pos`` and ``_own`` (false for copied border rows); a frame of
    at most ``before``/``after`` rows partitioned by (keys, _chunk) is then exact for own rows.
    """
    idx = indexed(df, keys, order, "_pos")
    at = F.col("_pos") - 1
    home = F.floor(at / F.lit(chunk)).cast("long")
    homes = F.sequence(
        F.floor((at - after) / F.lit(chunk)).cast("long"), F.floor((at + before) / F.lit(chunk)).cast("long")
    )
    return idx.withColumn("_home", home).withColumn("_chunk", F.explode(homes)).withColumn(
        "_own", F.col("_chunk") == F.col("_home")
    )


def running_sum(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], amount: str, out: str) -> DataFrame:
    """Cumulative sum in order, two levels."""
    idx = indexed(df, keys, order, "_pos").withColumn("_chunk", F.floor((F.col("_pos") - 1) / F.lit(CHUNK)).cast("long"))
    part = idx.groupBy(*keys, "_chunk").agg(F.sum(amount).alias("_s"))
    w = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    part = part.withColumn("_before", F.coalesce(F.sum("_s").over(w), F.lit(0.0))).drop("_s")
    inner = Window.partitionBy(*keys, "_chunk").orderBy("_pos").rowsBetween(Window.unboundedPreceding, 0)
    local = idx.withColumn("_in", F.sum(amount).over(inner)).join(part, [*keys, "_chunk"])
    return local.select(*df.columns, (F.col("_in") + F.col("_before")).alias(out))


def previous_row(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], cols: dict[str, str]) -> DataFrame:
    """``lag`` over a possibly hot key: join each position to the one before it."""
    idx = indexed(df, keys, order, "_pos")
    prev = idx.select(*keys, (F.col("_pos") + 1).alias("_pos"), *[F.col(c).alias(o) for c, o in cols.items()])
    return idx.join(prev, [*keys, "_pos"], "left").select(*df.columns, *cols.values())
