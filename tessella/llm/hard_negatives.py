"""Hard-negative mining by cover trees over norm-augmented candidates.

A candidate gets one more component, so that all candidates of a shard are equally long; then its inner product with an
anchor falls as their distance grows. A shard's cover tree halves the covering radius from level to level: a node's centre
is one of its points, all its points are within its radius, and the centres of its children are further apart than half of
it. Distance to the centre and radius bound the inner products of a node from both sides. A descent goes level by level,
all rows of a block of anchors together, and leaves out nodes that are outside a row's window or under its weakest kept
score; leaves are visited best bound first, and their points are verified on exact integer products.

Shards are cut by label and a hash, so a label with a third of all rows is many shards. Tasks meet a stripe of shards with a
group of anchor blocks, and keep their rows' best results from shard to shard, which tightens the bounds.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tessella.llm.common import BATCH_BYTES, keep_best, read
from tessella.session import materialize, spread

#: Components of this size or more (after scaling) have no exact product in 64 bits; rows that hold one take no part.
LIMIT = 1 << 25
#: Rows of a shard and anchors of a block, on average; shards of a stripe, at least; stripes, at most; blocks of a group.
SHARD_ROWS, BLOCK_ANCHORS, STRIPE_SHARDS, STRIPES, GROUP_BLOCKS = 1536, 256, 4, 512, 64
#: Points of a leaf, at most, unless they are equal.
LEAF = 16
LEAST, MOST = -(1 << 62), 1 << 62


def fixed_points(embeddings: DataFrame, scale: int = 256) -> DataFrame:
    """(vec_id, label, vec): distinct rows with components ``floor(scale * x)``.

    Rows with a null id, label, vector or component, a component that is not finite or is ``LIMIT`` or more in size take no
    part. Repeated rows are one. A shorter vector counts as filled up with zeros.
    """
    scaled = F.transform("embedding", lambda x: F.floor(scale * x.cast("double")))
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(scale * x.cast("double")) < LIMIT - 1))
    rows = embeddings.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & fine)
    return rows.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("label").cast("bigint").alias("label"), scaled.cast("array<int>").alias("vec")).distinct()


# -- trees


def matrix(lists: pa.ChunkedArray) -> np.ndarray:
    """List rows as an integer matrix, filled up with zeros."""
    values, ends = [], []
    for part in lists.chunks:
        values.append(part.flatten().to_numpy())
        ends.append(np.diff(part.offsets.to_numpy()))
    size = np.concatenate(ends)
    out = np.zeros((len(size), int(size.max(initial=0))), np.int32)
    out[np.arange(out.shape[1]) < size[:, None]] = np.concatenate(values)
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of integer rows, all of ``a`` with all of ``b``."""
    d = min(a.shape[1], b.shape[1])
    a, b = a[:, :d], b[:, :d]
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(1, d)
    return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64) if most < 1 << 53 else a.astype(np.int64) @ b.T.astype(np.int64)


class CoverTree:
    """Points in tree order, and nodes level by level: centre, radius, point range and child range of each."""

    FIELDS = {"ids": np.int64, "labels": np.int64, "points": np.int32, "center": np.int64, "radius": np.float64, "lo": np.int64, "hi": np.int64, "child": np.int64, "children": np.int64}

    def __init__(self, **fields):
        self.__dict__.update(fields)
        self.points = self.points.reshape(len(self.ids), -1)
        self.squares = np.einsum("ij,ij->i", self.points.astype(np.int64), self.points.astype(np.int64))
        self.longest = float(self.squares.max(initial=0))
        starts = np.stack([self.lo, self.hi], axis=1).ravel()
        padded = np.append(self.labels, 0)
        self.least_label, self.most_label = np.minimum.reduceat(padded, starts)[::2], np.maximum.reduceat(padded, starts)[::2]

    @classmethod
    def build(cls, ids: np.ndarray, labels: np.ndarray, points: np.ndarray) -> CoverTree:
        inner = products(points, points).astype(np.float64)
        square = np.diag(inner).copy()
        longest = square.max()
        extra = np.sqrt(np.maximum(longest - square, 0))
        far = np.sqrt(np.maximum(2 * (longest - inner - np.outer(extra, extra)), 0))
        np.fill_diagonal(far, 0)
        slack = 1e-5 * np.sqrt(longest)
        order = np.arange(len(ids))
        nodes = [[0, 0.0, 0, len(ids), 0, 0]]
        at = 0
        while at < len(nodes):
            center, _, lo, hi, _, _ = nodes[at]
            mine = order[lo:hi]
            to = far[center, mine]
            radius = to.max()
            nodes[at][1] = radius + slack if len(mine) > 1 else 0.0
            if len(mine) > LEAF and radius > slack:
                chosen, nearest, owner = [center], to.copy(), np.zeros(len(mine), np.int64)
                while (worst := nearest.argmax(), nearest[worst] > radius / 2)[1]:
                    closer = far[mine[worst], mine]
                    owner[closer < nearest] = len(chosen)
                    nearest = np.minimum(nearest, closer)
                    chosen.append(int(mine[worst]))
                by = np.argsort(owner, kind="stable")
                order[lo:hi] = mine[by]
                ends = lo + np.cumsum(np.bincount(owner, minlength=len(chosen)))
                nodes[at][4:] = len(nodes), len(chosen)
                nodes += [[c, 0.0, int(b), int(e), 0, 0] for c, b, e in zip(chosen, [lo, *ends[:-1]], ends)]
            at += 1
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        center, radius, lo, hi, child, children = (np.array(c) for c in zip(*nodes))
        return cls(ids=ids[order], labels=labels[order], points=points[order], center=place[center], radius=radius.astype(float), lo=lo, hi=hi, child=child, children=children)

    def packed(self) -> dict[str, bytes]:
        return {f: np.ascontiguousarray(getattr(self, f), t).tobytes() for f, t in self.FIELDS.items()}

    @classmethod
    def unpacked(cls, row: dict[str, bytes]) -> CoverTree:
        return cls(**{f: np.frombuffer(row[f], t) for f, t in cls.FIELDS.items()})


class Rows:
    """Search rows of one block of anchors: a window of scores each, and the best results so far (highest, then smallest id)."""

    FIELDS = {"anchors": np.int64, "keys": np.int64, "anchor_labels": np.int64, "queries": np.int32, "of": np.int64, "least": np.int64, "most": np.int64, "positive": np.int64, "positive_score": np.int64}

    def __init__(self, keep: int, same_label: bool, **fields):
        self.__dict__.update(fields)
        self.queries = self.queries.reshape(len(self.anchors), -1)
        self.squares = np.einsum("ij,ij->i", self.queries.astype(np.int64), self.queries.astype(np.int64)).astype(float)
        self.same, self.keep = same_label, keep
        self.score = np.full((len(self.of), keep), LEAST, np.int64)
        self.found = np.full((len(self.of), keep), MOST, np.int64)
        self.visited = 0

    @classmethod
    def unpacked(cls, row: dict[str, bytes], keep: int, same_label: bool) -> Rows:
        return cls(keep, same_label, **{f: np.frombuffer(row[f], t) for f, t in cls.FIELDS.items()})

    def floor(self) -> np.ndarray:
        """Scores under this can't enter a row's results; an equal one may, by its id."""
        return np.maximum(self.least, self.score[:, -1])

    def search(self, tree: CoverTree) -> None:
        """Takes the points of ``tree`` into the results."""
        nodes = np.zeros(1, np.int64)
        alive = np.ones((len(self.of), 1), bool)
        floor = self.floor()
        rows, leaves, bounds = [], [], []
        while len(nodes):
            inner = products(self.queries, tree.points[tree.center[nodes]]).astype(float)
            most = tree.longest + self.squares[:, None]
            away, radius = np.sqrt(np.maximum(most - 2 * inner, 0)), tree.radius[nodes]
            upper = np.where(radius == 0, inner, (most - np.maximum(away - radius, 0) ** 2) / 2)
            lower = np.where(radius == 0, inner, (most - (away + radius) ** 2) / 2)
            label = self.anchor_labels[:, None]
            held = (tree.least_label[nodes] <= label) & (label <= tree.most_label[nodes])
            only = (tree.least_label[nodes] == label) & (label == tree.most_label[nodes])
            open_ = held if self.same else ~only
            alive = alive & (upper[self.of] >= floor[:, None]) & (lower[self.of] <= self.most[:, None]) & open_[self.of]
            leaf = tree.children[nodes] == 0
            r, n = np.nonzero(alive & leaf)
            rows.append(r)
            leaves.append(nodes[n])
            bounds.append(np.minimum(upper[self.of[r], n], self.most[r]))
            go = np.flatnonzero(~leaf & alive.any(axis=0))
            count = tree.children[nodes[go]]
            alive = np.repeat(alive[:, go], count, axis=1)
            nodes = np.repeat(tree.child[nodes[go]] - np.cumsum(count) + count, count) + np.arange(count.sum())
        row, leaf, bound = (np.concatenate(x) for x in (rows, leaves, bounds))
        by = np.lexsort((-bound, row))
        row, leaf, bound = row[by], leaf[by], bound[by]
        at, end = (np.searchsorted(row, np.arange(len(self.of)), side=s) for s in ("left", "right"))
        step = 2 * self.keep
        while True:
            go = np.flatnonzero(at < end)
            go = go[bound[at[go]] >= self.floor()[go]]
            if not len(go):
                return
            n = np.minimum(end[go] - at[go], step)
            some = np.repeat(at[go] - np.cumsum(n) + n, n) + np.arange(n.sum())
            at[go] += n
            step *= 2
            some = some[bound[some] >= self.floor()[row[some]]]
            for part in np.array_split(some, -(-len(some) // 20_000)):
                self._verify(tree, row[part], leaf[part])

    def _verify(self, tree: CoverTree, row: np.ndarray, leaf: np.ndarray) -> None:
        size = tree.hi[leaf] - tree.lo[leaf]
        point = np.repeat(tree.lo[leaf] - np.cumsum(size) + size, size) + np.arange(size.sum())
        row = np.repeat(row, size)
        of = self.of[row]
        fits = ((tree.labels[point] == self.anchor_labels[of]) == self.same) & (tree.ids[point] != self.anchors[of])
        row, of, point = row[fits], of[fits], point[fits]
        self.visited += len(row)
        d = min(self.queries.shape[1], tree.points.shape[1])
        score = np.einsum("ij,ij->i", self.queries[of, :d].astype(np.int64), tree.points[point, :d].astype(np.int64))
        fits = (score >= self.floor()[row]) & (score <= self.most[row])
        keep_best(self.score, self.found, row[fits], score[fits], tree.ids[point[fits]])

    def results(self) -> dict[str, np.ndarray]:
        row, k = np.nonzero(self.score > LEAST)
        of = self.of[row]
        return {"anchor_id": self.anchors[of], "key": self.keys[of], "positive_id": self.positive[row], "positive_score": self.positive_score[row], "found_id": self.found[row, k], "score": self.score[row, k]}


# -- jobs

_TREE = T.StructType([T.StructField(f, T.BinaryType()) for f in CoverTree.FIELDS])
_BLOCK = T.StructType([T.StructField(f, T.BinaryType()) for f in Rows.FIELDS])
_RESULT = T.StructType([T.StructField(c, T.LongType()) for c in ("anchor_id", "key", "positive_id", "positive_score", "found_id", "score")])


def _tree(table: pa.Table) -> pa.Table:
    """The rows of one shard -> one row with its tree."""
    tree = CoverTree.build(table.column("vec_id").to_numpy(), table.column("label").to_numpy(), matrix(table.column("vec")))
    keys = {c: [table.column(c)[0].as_py()] for c in ("class", "part")}
    return pa.table(keys | {f: [b] for f, b in tree.packed().items()}, schema=to_arrow_schema(T.StructType([T.StructField("class", T.StringType()), T.StructField("part", T.IntegerType()), *_TREE])))


def _block(table: pa.Table) -> pa.Table:
    """The anchors of one block with their ``windows`` -> one row of packed search rows."""
    windows = table.column("windows").to_pylist()
    rows = [(i, w) for i, x in enumerate(windows) for w in x]
    values = {
        "anchors": table.column("vec_id").to_numpy(), "keys": table.column("key").to_numpy(), "anchor_labels": table.column("label").to_numpy(), "queries": matrix(table.column("vec")), "of": [i for i, _ in rows],
        **{f: [w[f] for _, w in rows] for f in ("least", "most", "positive", "positive_score")},
    }
    keys = {c: [table.column(c)[0].as_py()] for c in ("class", "block")}
    packed = {f: [np.ascontiguousarray(values[f], t).tobytes()] for f, t in Rows.FIELDS.items()}
    return pa.table(keys | packed, schema=to_arrow_schema(T.StructType([T.StructField("class", T.StringType()), T.StructField("block", T.IntegerType()), *_BLOCK])))


def _searcher(keep: int, same_label: bool):
    schema = to_arrow_schema(_RESULT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, state = None, {}

        def out() -> Iterator[pa.RecordBatch]:
            for rows in state.values():
                r = rows.results()
                yield pa.RecordBatch.from_arrays([pa.array(r[f.name]) for f in schema], schema=schema)

        for batch in batches:
            for r in batch.to_pylist():
                if (key := (r["class"], r["stripe"], r["group"])) != here:
                    yield from out()
                    here, state = key, {}
                if r["block"] not in state:
                    state[r["block"]] = Rows.unpacked(r, keep, same_label)
                state[r["block"]].search(CoverTree.unpacked(r))
        yield from out()

    return run


def _meet(blocks: DataFrame, trees: DataFrame, n_blocks: Column | int, n_stripes: Column | int, keep: int, same_label: bool) -> DataFrame:
    """Every block with every tree of its class: a task takes the trees of a stripe and the blocks of a group.

    Both are copied for it, which Spark does not count when it sizes them, so the join is by sort and holds the blocks of one group.
    """
    blocks = blocks.withColumn("group", (F.col("block") / GROUP_BLOCKS).cast("int")).withColumn("stripe", F.explode(F.sequence(F.lit(0), n_stripes - F.lit(1))))
    trees = trees.withColumn("stripe", F.pmod(F.xxhash64("own_class", "part"), n_stripes).cast("int"))
    trees = trees.withColumn("group", F.explode(F.sequence(F.lit(0), ((n_blocks - F.lit(1)) / GROUP_BLOCKS).cast("int"))))
    keys = ["class", "stripe", "group"]
    pairs = spread(trees.select(*keys, *CoverTree.FIELDS), *keys).join(spread(blocks.select(*keys, "block", *Rows.FIELDS), *keys).hint("merge"), keys)
    conf = blocks.sparkSession.conf
    conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return pairs.mapInArrow(_searcher(keep, same_label), _RESULT)


def _best(found: DataFrame, keys: list[str], keep: int) -> DataFrame:
    by = Window.partitionBy(*keys).orderBy(F.desc("score"), "found_id")
    return found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= keep)


def mine(points: DataFrame, anchors: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90) -> DataFrame:
    """``points(vec_id, label, vec)`` (see :func:`fixed_points`) -> (anchor_id, positive_id, rank, negative_id,
    positive_score, negative_score).

    Rows where ``anchors`` holds are anchors. Scores are integer inner products; higher ones come first, ties by smaller id.
    An anchor's positives are its first ``positives`` rows of its label under another id. For each, the first ``negatives``
    rows of other labels with ``low * positive <= 100 * negative <= high * positive`` are returned, fewer if there are fewer,
    none for a positive with a score under zero. An id with several vectors has an anchor for each. An empty table gives none.
    """
    points = materialize(points, "points")
    sizes = materialize(points.groupBy("label").agg(F.count(F.lit(1)).alias("rows"), F.count(F.when(anchors, 1)).alias("n_anchors")), "labels")
    few = sizes.where(F.col("rows") < SHARD_ROWS).agg(F.coalesce(F.sum("rows"), F.lit(0)), F.coalesce(F.sum("n_anchors"), F.lit(0))).first()
    mixed = max(1, math.ceil(few[0] / SHARD_ROWS))
    own = F.col("rows") >= SHARD_ROWS  # a label of its own shards; the other labels share some, each in one
    of = sizes.select(
        "label", F.when(own, F.concat(F.lit("label "), "label")).otherwise(F.concat(F.lit("mixed "), F.pmod(F.xxhash64("label"), F.lit(mixed)))).alias("class"),
        F.when(own, F.ceil(F.col("rows") / SHARD_ROWS)).otherwise(1).cast("int").alias("parts"),
    )
    shards = sizes.join(of, "label").groupBy("class").agg(F.max("parts").alias("parts"), F.sum("n_anchors").alias("n_anchors"))
    shards = materialize(shards.withColumn("blocks", F.greatest(F.lit(1), F.ceil(F.col("n_anchors") / BLOCK_ANCHORS)).cast("int")).withColumn("stripes", _stripes(F.col("parts"))), "classes")
    total = shards.agg(F.coalesce(F.sum("parts"), F.lit(0)), F.coalesce(F.sum("n_anchors"), F.lit(0))).first()
    placed = points.join(of, "label").withColumn("key", F.xxhash64("vec_id", "label", "vec"))
    placed = placed.withColumn("part", F.pmod("key", "parts").cast("int"))
    trees = spread(placed.select("class", "part", "vec_id", "label", "vec"), "class", "part").groupBy("class", "part")
    trees = materialize(trees.applyInArrow(_tree, T.StructType([T.StructField("class", T.StringType()), T.StructField("part", T.IntegerType()), *_TREE])), "trees").withColumn("own_class", F.col("class"))
    chosen = placed.where(anchors).select("class", "vec_id", "label", "vec", "key")
    block_type = T.StructType([T.StructField("class", T.StringType()), T.StructField("block", T.IntegerType()), *_BLOCK])

    any_score = F.array(F.struct(F.lit(LEAST + 1).cast("bigint").alias("least"), F.lit(MOST).cast("bigint").alias("most"), F.lit(0).cast("bigint").alias("positive"), F.lit(0).cast("bigint").alias("positive_score")))
    first = chosen.join(shards.select("class", "blocks"), "class").withColumn("block", F.pmod("key", "blocks").cast("int")).withColumn("windows", any_score).drop("blocks")
    first = spread(first, "class", "block").groupBy("class", "block").applyInArrow(_block, block_type)
    first = first.join(shards.select("class", "blocks", "stripes"), "class")
    found = _meet(first, trees.join(shards.select("class", "blocks", "stripes"), "class"), F.col("blocks"), F.col("stripes"), positives, True)
    positive = materialize(_best(found, ["anchor_id", "key"], positives), "positives").withColumnsRenamed({"found_id": "positive", "score": "of_positive"})

    least, most = F.ceil(F.col("of_positive").cast("decimal(38,0)") * low / 100), F.floor(F.col("of_positive").cast("decimal(38,0)") * high / 100)
    window = F.struct(least.cast("bigint").alias("least"), most.cast("bigint").alias("most"), "positive", F.col("of_positive").alias("positive_score"))
    windows = positive.where("of_positive >= 0").groupBy(F.col("anchor_id").alias("vec_id"), "key").agg(F.collect_list(window).alias("windows"))
    n_blocks, n_stripes = max(1, math.ceil(total[1] / BLOCK_ANCHORS)), min(STRIPES, max(1, math.ceil(total[0] / STRIPE_SHARDS)))
    second = chosen.join(windows.hint("merge"), ["vec_id", "key"]).withColumn("class", F.lit("all")).withColumn("block", F.pmod("key", F.lit(n_blocks)).cast("int"))
    second = spread(second, "block").groupBy("class", "block").applyInArrow(_block, block_type)
    found = _meet(second, trees.withColumn("class", F.lit("all")), F.lit(n_blocks), F.lit(n_stripes), negatives, False)
    best = _best(found, ["anchor_id", "key", "positive_id"], negatives)
    return best.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("found_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def _stripes(shards: Column) -> Column:
    return F.least(F.lit(STRIPES), F.greatest(F.lit(1), F.ceil(shards / STRIPE_SHARDS))).cast("int")


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "embeddings").select("vec_id", "embedding", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).alias("label"))
    return mine(fixed_points(rows), F.col("vec_id") % 100 == 0)


OP12_SQL = """
with clean as (select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, [cast(floor(256 * cast(x as double)) as bigint) for x in embedding] as v
               from embeddings where vec_id is not null and label is not null and embedding is not null
               and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
     p as (select distinct vec_id, label, v from clean),
     scored as (select a.vec_id as anchor_id, b.vec_id as id, a.label = b.label as same, cast(list_sum([x[1] * x[2] for x in list_zip(a.v, b.v)]) as bigint) as score
                from p a join p b on a.vec_id <> b.vec_id where a.vec_id % 100 = 0),
     pos as (select anchor_id, id as positive_id, score as positive_score from scored where same qualify row_number() over (partition by anchor_id order by score desc, id) <= 5),
     neg as (select anchor_id, positive_id, positive_score, id as negative_id, score as negative_score, row_number() over (partition by anchor_id, positive_id order by score desc, id) as rank
             from pos join (select * from scored where not same) using (anchor_id) where 30 * positive_score <= 100 * score and 100 * score <= 90 * positive_score)
select anchor_id, positive_id, cast(rank as integer) as rank, negative_id, positive_score, negative_score from neg where rank <= 10
"""
