"""Initial memberships: random, listed, k-means, correlation and network seeds."""

from __future__ import annotations

from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions.chance import uniform
from tessella.functions.order import indexed, quantiles
from tessella.operators import tiles
from tessella.operators.scores import col_scores
from tessella.session import materialize


def seed_random(universe: DataFrame, n_clusters: int, n: int, seed: int = 1, axis: str = "row_id") -> DataFrame:
    """(k, axis): ``n`` distinct clusters per id, the ones with the smallest hash."""
    picks = F.slice(F.array_sort(F.transform(F.sequence(F.lit(1), F.lit(n_clusters)), lambda k: F.struct(uniform(axis, k, seed).alias("h"), k.cast("int").alias("k")))), 1, n)
    return universe.select(axis).distinct().select(F.explode(picks).alias("_p"), axis).select(F.col("_p.k").alias("k"), axis)


def seed_random_n(universe: DataFrame, n_clusters: int, size: int, slots: int = 1, seed: int = 1) -> DataFrame:
    """(k, row_id, slot): ``size`` unused rows per cluster, drawn afresh for each slot."""
    out = None
    for s in range(slots):
        idx = indexed(universe.select("row_id").distinct().withColumn("_u", uniform("row_id", seed, s)), [], ["_u", "row_id"], "_p")
        part = idx.select((F.floor((F.col("_p") - 1) / size) + 1).cast("int").alias("k"), "row_id", F.lit(s + 1).alias("slot")).where(F.col("k") <= n_clusters)
        out = part if out is None else out.unionByName(part)
    return out


def seed_list(universe: DataFrame, lists: DataFrame, alias: DataFrame, n_clusters: int, rest: int = 5, seed: int = 1) -> DataFrame:
    """(k, row_id): the listed sets by resolved id, the remaining clusters ``rest`` random unlisted rows."""
    known = universe.select("row_id").distinct()
    given = lists.join(alias, lists["name"] == alias["alias"]).select("k", "row_id").distinct().join(known, "row_id", "left_semi").where(F.col("k") <= n_clusters)
    top = lists.agg(F.max("k").alias("m")).first()["m"] or 0
    free = known.join(given, "row_id", "left_anti")
    if top >= n_clusters:
        return given.select("k", "row_id")
    more = seed_random_n(free, n_clusters - int(top), rest, 1, seed).select((F.col("k") + int(top)).cast("int").alias("k"), "row_id")
    return given.select(F.col("k").cast("int").alias("k"), "row_id").unionByName(more)


def _vectors(m: DataFrame) -> DataFrame:
    axis = tiles.column_axis(m)
    vec = tiles.pack_rows(m, axis)
    return vec.select("row_id", F.transform("vec", lambda x: F.when(F.isnan(x), F.lit(0.0)).otherwise(x)).alias("vec"))


def _best_kmeans(df: DataFrame, k: int, iters: int, starts: int, seed: int) -> KMeansModel:
    """Best of several starts by training cost."""
    fits = [KMeans(k=k, maxIter=iters, seed=seed + s, featuresCol="features").fit(df) for s in range(starts)]
    return min(fits, key=lambda f: f.summary.trainingCost)


def seed_kmeans(m: DataFrame, n_clusters: int, iters: int = 20, starts: int = 2, seed: int = 1) -> DataFrame:
    """(k, row_id) by k-means over the matrix with missing cells as 0."""
    df = materialize(_vectors(m), "vectors").select("row_id", array_to_vector("vec").alias("features"))
    model = _best_kmeans(df, n_clusters, iters, starts, seed)
    return model.transform(df).select((F.col("prediction") + 1).alias("k"), "row_id")


def _distance(x: Column, y: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(x, y, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v))


def seed_trimmed_kmeans(m: DataFrame, n_clusters: int, trim: float = 0.1, rounds: int = 5, seed: int = 1) -> DataFrame:
    """(k, row_id) by k-means that leaves out the farthest ``trim`` share; left-out rows get k = 0."""
    vec = materialize(_vectors(m), "vectors")
    kept, placed = vec, None
    for r in range(rounds):
        model = _best_kmeans(kept.select("row_id", array_to_vector("vec").alias("features")), n_clusters, 20, 2, seed + 10 * r)
        centres = vec.sparkSession.createDataFrame([(i, [float(v) for v in c]) for i, c in enumerate(model.clusterCenters())], "prediction int, centre array<double>")
        full = model.transform(vec.withColumn("features", array_to_vector("vec"))).join(centres, "prediction")
        placed = materialize(full.select("row_id", "vec", (F.col("prediction") + 1).alias("k"), _distance(F.col("vec"), F.col("centre")).alias("d")), "placed")
        cut = quantiles(placed, [], "d", {"q": 1 - trim}).first()["q"]
        placed = placed.withColumn("k", F.when(F.col("d") <= cut, F.col("k")).otherwise(0))
        kept = placed.where("k > 0").select("row_id", "vec")
    return placed.select("k", "row_id")


def settle_claims(cand: DataFrame, size: int) -> tuple[DataFrame, DataFrame]:
    """Serial claims without a serial loop: (accepted (k, row_id), rejected (k, row_id)).

    Every cluster wants its ``size`` best candidates; a row goes to the lowest cluster that wants it.
    Clusters keep proposing their next best row after a rejection until nothing changes, which is the
    outcome of serving the clusters one after the other.
    """
    rejected = cand.select("k", "row_id").limit(0)
    w = Window.partitionBy("k").orderBy(F.desc("r"), "row_id")
    while True:  # every round rejects one candidate at least
        live = cand.join(rejected, ["k", "row_id"], "left_anti")
        wants = live.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= size)
        win = wants.groupBy("row_id").agg(F.min("k").alias("_w"))
        state = materialize(wants.join(win, "row_id").select("k", "row_id", (F.col("k") == F.col("_w")).alias("ok")), "claims")
        lost = state.where("not ok").select("k", "row_id")
        if lost.isEmpty():
            return state.select("k", "row_id"), rejected
        rejected = materialize(rejected.unionByName(lost), "rejected")


def _grow_claims(make, seeds: DataFrame, size: int, n_rows: int) -> DataFrame:
    """Settle claims over candidate lists that double until no cluster runs out of candidates."""
    length = size * 4
    while True:
        cand = materialize(make(min(length, n_rows)).join(seeds.select("row_id"), "row_id", "left_anti"), "candidates")
        got, rejected = settle_claims(cand, size)
        if length >= n_rows:
            return got
        listed = cand.groupBy("k").agg(F.count(F.lit(1)).alias("_l"))
        short = got.groupBy("k").agg(F.count(F.lit(1)).alias("_g")).join(listed, "k", "right").where(F.coalesce("_g", F.lit(0)) < size)
        if short.isEmpty():
            return got
        length *= 2


def _pick_seeds(rows: DataFrame, n_clusters: int, seed: int) -> DataFrame:
    idx = indexed(rows.select("row_id").distinct().withColumn("_u", uniform("row_id", seed)), [], ["_u", "row_id"], "_p")
    return materialize(idx.where(F.col("_p") <= n_clusters).select(F.col("_p").cast("int").alias("k"), "row_id"), "seeds")


def seed_correlated(m: DataFrame, n_clusters: int, size: int, seed: int = 1, edges: DataFrame | None = None) -> DataFrame:
    """(k, row_id): a random row per cluster plus its ``size`` - 1 most correlated unused rows.

    With ``edges`` the correlation gains weight / 1000 between linked rows. Only neighbours of a seed
    can pass the plain ranking, so just those pairs are scored on top of it.
    """
    axis = tiles.column_axis(m)
    n_cols = axis.count()
    vec = materialize(tiles.pack_rows(m, axis), "vectors")
    seeds = _pick_seeds(vec, n_clusters, seed)
    n_rows = vec.count()

    def make(length: int) -> DataFrame:
        near = tiles.top_correlated(vec, seeds, n_cols, length).join(seeds.select("k", F.col("row_id").alias("probe")), "probe").select("k", "row_id", "r")
        if edges is None:
            return near
        link = edges.join(seeds.select("k", F.col("row_id").alias("src")), "src").groupBy("k", "src", F.col("dst").alias("row_id")).agg(F.max("weight").alias("_w"))
        both = link.join(vec.select(F.col("row_id").alias("src"), F.col("vec").alias("_x")), "src").join(vec.select("row_id", F.col("vec").alias("_y")), "row_id")
        ext = both.select("k", "row_id", _corr(F.col("_x"), F.col("_y")).alias("r0"), "_w").where(F.col("r0").isNotNull())
        ext = ext.select("k", "row_id", (F.col("r0") + F.col("_w") / 1000).alias("r"))
        return near.join(ext, ["k", "row_id"], "left_anti").unionByName(ext)

    if size <= 1:
        return seeds.select("k", "row_id")
    return seeds.select("k", "row_id").unionByName(_grow_claims(make, seeds, size - 1, n_rows))


def _corr(x: Column, y: Column) -> Column:
    """Pearson correlation of two arrays over positions present in both."""
    both = F.filter(F.arrays_zip(x.alias("a"), y.alias("b")), lambda p: ~F.isnan(p["a"]) & ~F.isnan(p["b"]))
    s = lambda fn: F.aggregate(both, F.lit(0.0), lambda acc, p: acc + fn(p))
    n = F.size(both)
    sx, sy = s(lambda p: p["a"]), s(lambda p: p["b"])
    cov = s(lambda p: p["a"] * p["b"]) - sx * sy / n
    vx, vy = s(lambda p: p["a"] * p["a"]) - sx * sx / n, s(lambda p: p["b"] * p["b"]) - sy * sy / n
    return F.when((n > 1) & (vx > 0) & (vy > 0), cov / F.sqrt(vx * vy))


def seed_network(edges: DataFrame, n_clusters: int, size: int, seed: int = 1, max_rounds: int = 20) -> DataFrame:
    """(k, row_id): a random node per cluster grown by its neighbours.

    All clusters grow together, one join per round. The last neighbours of a cluster are a weighted
    draw without replacement; a row reached twice goes to the higher cluster number.
    """
    links = materialize(edges.select("src", "dst", "weight"), "links")
    grown = _pick_seeds(links.select(F.col("src").alias("row_id")), n_clusters, seed)
    for r in range(max_rounds):
        have = grown.groupBy("k").agg(F.count(F.lit(1)).alias("_h")).where(F.col("_h") < size)
        if have.isEmpty():
            break
        near = grown.join(have, "k").join(links, F.col("row_id") == F.col("src")).groupBy("k", "_h", F.col("dst").alias("row_id")).agg(F.sum("weight").alias("_w"))
        near = near.join(grown, ["k", "row_id"], "left_anti")
        w = Window.partitionBy("k").orderBy(-F.log(uniform("row_id", "k", seed, r)) / F.col("_w"), "row_id")
        add = near.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= size - F.col("_h")).select("k", "row_id")
        nxt = materialize(grown.select("k", "row_id").unionByName(add), "grown")
        if nxt.count() == grown.count():
            break
        grown = nxt
    return grown.groupBy("row_id").agg(F.max("k").alias("k")).select("k", "row_id")


def seed_columns(m: DataFrame, row_member: DataFrame, n: int, method: str = "best", n_clusters: int = 0, seed: int = 1) -> DataFrame:
    """(k, col_id): the ``n`` clusters with the lowest column score per column, or random ones."""
    if method == "rnd":
        return seed_random(m, n_clusters, n, seed, "col_id")
    w = Window.partitionBy("col_id").orderBy("score", "k")
    return col_scores(m, row_member).withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).select("k", "col_id")


def precluster_regulators(m: DataFrame, n_groups: int = 30, starts: int = 25, cutoff: float = 0.85, seed: int = 31337, iters: int = 200) -> tuple[DataFrame, DataFrame]:
    """(groups (group_id, row_id), means (row_id, col_id, value)) of clustered regulators.

    Rows correlated with a group's centre over ``cutoff`` join it and the means are taken again; a
    group of one keeps that row's name.
    """
    vec = materialize(_vectors(m), "vectors")
    model = _best_kmeans(vec.select("row_id", array_to_vector("vec").alias("features")), n_groups, iters, starts, seed)
    label = lambda c: F.concat(F.lit("TFGROUP"), c.cast("string"))
    base = model.transform(vec.withColumn("features", array_to_vector("vec"))).select(label(F.col("prediction") + 1).alias("group_id"), "row_id")
    centres = vec.sparkSession.createDataFrame([(f"TFGROUP{i + 1}", [float(v) for v in c]) for i, c in enumerate(model.clusterCenters())], "row_id string, vec array<double>")
    n_cols = len(model.clusterCenters()[0])
    high = tiles.correlated_pairs(vec, centres, n_cols, cutoff).select(F.col("right_id").alias("group_id"), F.col("left_id").alias("row_id"))
    groups = materialize(base.unionByName(high).distinct(), "groups")
    single = groups.groupBy("group_id").agg(F.count(F.lit(1)).alias("_n"), F.min("row_id").alias("_one"))
    groups = groups.join(single, "group_id").select(F.when(F.col("_n") == 1, F.col("_one").cast("string")).otherwise(F.col("group_id")).alias("group_id"), "row_id")
    means = m.join(groups, "row_id").groupBy(F.col("group_id").alias("row_id"), "col_id").agg(F.avg("value").alias("value"))
    return groups, means
