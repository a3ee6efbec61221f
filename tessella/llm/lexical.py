"""Ranked lexical search of items in documents, by two hierarchies at once.

Scores are sums over an item's terms of integer term weights that fall with the term's document frequency and saturate with
its count and the document's length. Only the terms of the items matter, so a document is a sparse vector over them.

Items stand in a tree whose nodes hold, of every term, the largest count of any item below; the documents of a block stand in
a tree whose nodes hold the largest weight of any document below. The product of two nodes bounds every score between them.
A descent of both trees drops a pair of nodes as soon as its bound is under the weakest kept score of all items below, so
whole batches go at once; what is left at the leaves is scored exactly, best bounds first. A task keeps the best of its
blocks for each item, which raises the bar from block to block.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tessella.llm.common import BATCH_BYTES, BATCH_ROWS, blocks, keep_best, read, utf8
from tessella.llm.decontam import PASS_BYTES, words_of

#: Children of a node; documents of a leaf of theirs, items of a leaf of theirs.
FAN, LEAF_DOCS, LEAF_ITEMS = 4, 4, 2
#: Columns that an item's terms are folded into to find items alike.
FOLDED = 256
#: Text of one document tree, and cells (documents x terms that occur) of its matrix.
TREE_BYTES, CELLS = 2 << 20, 1 << 22
TOP = 20
NO_SCORE, NO_ID, NULL_ID = -(1 << 62), 1 << 62, (1 << 62) - 1


def together(rows: np.ndarray) -> np.ndarray:
    """An order in which rows that point the same way are neighbours: nearest of some pivot rows, then the sum of the row."""
    if not len(rows):
        return np.zeros(0, np.int64)
    worth = rows.sum(axis=1)
    by = np.argsort(-worth, kind="stable")
    pivots = by[np.linspace(0, len(by) - 1, min(len(by), math.isqrt(len(by)) + 1)).astype(np.int64)]
    unit = (rows / np.maximum(1, np.sqrt(np.square(rows.astype(np.float64)).sum(axis=1)))[:, None]).astype(np.float32)
    return np.lexsort((-worth, (unit @ unit[pivots].T).argmax(axis=1)))


class Items:
    """Items of one pass: their terms, weights, and the tree of largest counts.

    ``levels[0]`` are the leaves, the last level the root; a node is (terms, largest counts, first item, end).
    """

    def __init__(self, names: list, texts: list[bytes]):
        words = [Counter(words_of(t)) for t in texts]
        self.vocab: dict[bytes, int] = {}
        for w in words:
            for term in w:
                self.vocab.setdefault(term, len(self.vocab))
        self.names, self.words = names, words
        self.weight = np.zeros(len(self.vocab), np.int64)
        self.levels: list[list[tuple[np.ndarray, np.ndarray, int, int]]] = []

    def weighted(self, n_docs: int, n_terms: int, df: dict[int, int]) -> Items:
        self.n_docs, self.n_terms = n_docs, n_terms
        for term, count in df.items():
            self.weight[term] = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * count + 1)))
        counted = []
        for w in self.words:
            term, count = np.fromiter(map(self.vocab.get, w), np.int64, len(w)), np.fromiter(w.values(), np.int64, len(w))
            by = np.argsort(term)
            counted.append((term[by], count[by]))
        folded = np.zeros((len(counted), FOLDED), np.float32)
        for row, (t, c) in zip(folded, counted):
            np.add.at(row, t % FOLDED, self.weight[t] * c)
        order = together(folded).tolist()
        self.names, counted = [self.names[i] for i in order], [counted[i] for i in order]
        self.words = []
        self.exact_in_double = max((int(c.sum()) for _, c in counted), default=0) * int(self.weight.max(initial=0)) * 1_000_000 < 1 << 53
        self.counted = counted
        nodes = [(t, c, i, i + 1) for i, (t, c) in enumerate(counted)]
        size = LEAF_ITEMS
        while nodes:
            nodes = [self._joined(nodes[lo : lo + size]) for lo in range(0, len(nodes), size)]
            self.levels.append(nodes)
            size = FAN
            if len(nodes) == 1:
                break
        return self

    @staticmethod
    def _joined(nodes: list) -> tuple[np.ndarray, np.ndarray, int, int]:
        term, count = (np.concatenate([n[k] for n in nodes]) for k in (0, 1))
        by = np.lexsort((-count, term))
        term, count = term[by], count[by]
        first = np.concatenate(([True], term[1:] != term[:-1])) if len(term) else np.zeros(0, bool)
        return term[first], count[first], nodes[0][2], nodes[-1][3]


class Search:
    """Best documents of every item so far, and the descent that takes a block of documents in."""

    def __init__(self, items: Items, top: int):
        self.items = items
        self.score = np.full((len(items.names), top), NO_SCORE, np.int64)
        self.found = np.full((len(items.names), top), NO_ID, np.int64)
        self.scored = 0

    def add(self, ids: np.ndarray, texts: list[bytes]) -> None:
        get, width = self.items.vocab.get, len(self.items.vocab)
        sizes, known = np.zeros(len(texts), np.int64), []
        for i, t in enumerate(texts):
            w = words_of(t)
            sizes[i] = len(w)
            known.append(np.fromiter(map(get, w, repeat(-1)), np.int64, len(w)))
        term = np.concatenate(known)
        cell, tf = np.unique((np.repeat(np.arange(len(texts)), sizes) * width + term)[term >= 0], return_counts=True)
        if not len(cell):
            return
        doc, term = np.divmod(cell, width)
        n, total = self.items.n_docs, self.items.n_terms
        length = np.array([75 + 25 * s * n // total for s in sizes.tolist()], np.int64)
        value = self.items.weight[term] * (1_000_000_000 * tf // (1000 * tf + 12 * length[doc]))
        place = np.empty(len(texts), np.int64)
        place[order := np.argsort(length, kind="stable")] = np.arange(len(texts))  # if the block is halved, by length
        self._grow(ids[order], place[doc], term, value)

    def _grow(self, ids: np.ndarray, doc: np.ndarray, term: np.ndarray, value: np.ndarray) -> None:
        """Tree of documents, or of halves of them while the matrix would be too large; then the descent."""
        present, col = np.unique(term, return_inverse=True)
        if len(ids) > 1 and len(ids) * len(present) > CELLS:
            half = len(ids) // 2
            left = doc < half
            self._grow(ids[:half], doc[left], term[left], value[left])
            self._grow(ids[half:], doc[~left] - half, term[~left], value[~left])
            return
        leaf = np.zeros((len(ids), len(present)), np.float64 if self.items.exact_in_double else np.int64)
        leaf[doc, col] = value
        order = together(leaf)
        self.ids, self.leaf = ids[order], (leaf := leaf[order])
        self.col_of = np.full(len(self.items.vocab), -1, np.int64)
        self.col_of[present] = np.arange(len(present))
        self.levels, size = [], LEAF_DOCS
        while True:
            leaf = np.maximum.reduceat(leaf, np.arange(0, len(leaf), size), axis=0)
            self.levels.append(leaf)
            if len(leaf) <= FAN:
                break
            size = FAN
        if self.items.levels:
            self._descend(len(self.items.levels) - 1, 0, len(self.levels) - 1, np.arange(len(leaf)))

    def _floor(self, lo: int, hi: int) -> np.ndarray:
        return np.maximum(self.score[lo:hi, -1], 1)

    def _descend(self, level: int, node: int, depth: int, docs: np.ndarray) -> None:
        """One item node against document nodes of one depth."""
        term, count, lo, hi = self.items.levels[level][node]
        col = self.col_of[term]
        col, count = col[col >= 0], count[col >= 0]
        if not len(col):
            return
        bound = self.levels[depth][docs[:, None], col] @ count.astype(self.leaf.dtype)
        docs = docs[live := bound >= self._floor(lo, hi).min()]
        docs = docs[np.argsort(-bound[live], kind="stable")]
        if not len(docs):
            return
        if level == 0 and depth == 0:
            self._verify(lo, hi, docs, np.sort(-bound[live]) * -1)
            return
        if depth:
            docs = (docs[:, None] * FAN + np.arange(FAN)).ravel()
            docs = docs[docs < len(self.levels[depth - 1])]
        for child in range(node * FAN, min((node + 1) * FAN, len(self.items.levels[level - 1]))) if level else [node]:
            self._descend(max(level - 1, 0), child, max(depth - 1, 0), docs)

    def _verify(self, lo: int, hi: int, docs: np.ndarray, bound: np.ndarray) -> None:
        """Exact scores of the items of a leaf in the documents of leaves, best bounds first."""
        term = np.unique(np.concatenate([t for t, _ in self.items.counted[lo:hi]]))
        term = term[self.col_of[term] >= 0]
        count = np.zeros((hi - lo, len(term)), self.leaf.dtype)
        for k, (t, c) in enumerate(self.items.counted[lo:hi]):
            known = self.col_of[t] >= 0
            count[k, np.searchsorted(term, t[known])] = c[known]
        step, at = 2, 0
        while at < len(docs) and bound[at] >= self._floor(lo, hi).min():
            rows = (docs[at : at + step, None] * LEAF_DOCS + np.arange(LEAF_DOCS)).ravel()
            rows = rows[rows < len(self.ids)]
            score = self.leaf[rows[:, None], self.col_of[term]] @ count.T
            self.scored += score.size
            doc, item = np.nonzero(score >= self._floor(lo, hi))
            if len(doc):
                keep_best(self.score, self.found, item + lo, score[doc, item].astype(np.int64), self.ids[rows[doc]])
            at += step
            step *= 2


def _statistics(docs: DataFrame, vocab: dict[bytes, int]) -> tuple[int, int, dict[int, int]]:
    """Documents with a term, all terms of all documents, and the documents that hold each term of ``vocab``."""
    shared = docs.sparkSession.sparkContext.broadcast(vocab)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get, df, n_docs, n_terms = shared.value.get, np.zeros(len(shared.value), np.int64), 0, 0
        for batch in batches:
            for text in utf8(batch.column(0)):
                w = words_of(text)
                n_docs, n_terms = n_docs + bool(w), n_terms + len(w)
                df[[k for x in set(w) if (k := get(x)) is not None]] += 1
        held = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(([-1, -2], held))), pa.array(np.concatenate(([n_docs, n_terms], df[held])))], names=["term", "n"])

    counted = {r["term"]: r["n"] for r in docs.select("text").mapInArrow(run, "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n")).collect()}
    return counted.pop(-1, 0), counted.pop(-2, 0), counted


def rank_documents(docs: DataFrame, items: DataFrame, top: int = TOP) -> DataFrame:
    """``docs(doc_id, text)``, ``items(item_id, text)`` -> (item_id, rank, doc_id, score): the ``top`` best documents of every
    item with a score above zero, ties by smaller doc_id (null last).

    Terms are runs of ASCII letters and digits and of characters beyond ASCII; only A-Z is lower-cased. Null texts have no
    term. Repeated document rows are documents of their own; repeated items are one, and an id with several texts is ranked
    for each. Items are sent in passes of ``PASS_BYTES`` of text, cut by a hash, so what a task receives is bounded.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    items = items.select("item_id", F.coalesce("text", F.lit("")).alias("text")).distinct()
    total = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    passes = max(1, math.ceil(total / PASS_BYTES))
    schema = T.StructType([T.StructField("item", T.StringType()), T.StructField("item_id", items.schema["item_id"].dataType), T.StructField("doc_id", T.LongType()), T.StructField("score", T.LongType())])
    arrow = to_arrow_schema(schema)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    found = []
    for k in range(passes):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(passes)) == k).collect()
        known = Items([r["item_id"] for r in part], [r["text"].encode() for r in part])
        shared = spark.sparkContext.broadcast(known.weighted(*_statistics(docs, known.vocab)))

        def run(batches: Iterator[pa.RecordBatch], k=k, shared=shared) -> Iterator[pa.RecordBatch]:
            search = Search(shared.value, top)
            for batch in batches:
                ids, texts = batch.column(0).fill_null(NULL_ID).to_numpy(), utf8(batch.column(1))
                for lo, hi in blocks(texts, TREE_BYTES):
                    search.add(ids[lo:hi], texts[lo:hi])
            item, nth = np.nonzero(search.score > NO_SCORE)
            doc = [None if d == NULL_ID else d for d in search.found[item, nth].tolist()]
            names = shared.value.names
            yield pa.RecordBatch.from_arrays([pa.array([f"{k}:{i}" for i in item.tolist()], arrow[0].type), pa.array([names[i] for i in item.tolist()], arrow[1].type), pa.array(doc, pa.int64()), pa.array(search.score[item, nth])], schema=arrow)

        found.append(docs.mapInArrow(run, schema))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    out = out.withColumn("lot", F.spark_partition_id() % 128)  # the best of some tasks first, so no item meets all tasks' rows
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    out = out.withColumn("rank", F.row_number().over(Window.partitionBy("item", "lot").orderBy(*order))).where(F.col("rank") <= top)
    out = out.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).where(F.col("rank") <= top)
    return out.select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank_documents(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


OP13_SQL = r"""
with dw as (select doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term from documents),
     bw as (select item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term from benchmark),
     sizes as (select doc_id, count(*) as n from dw group by doc_id),
     total as (select cast(count(*) as bigint) as nn, cast(sum(n) as bigint) as ll from sizes),
     tfs as (select doc_id, term, count(*) as tf from dw where term in (select term from bw) group by doc_id, term),
     w as (select term, cast(floor(1000 * ln((2 * nn + 2)::double / (2 * count(*) + 1)::double)) as bigint) as w from tfs, total group by term, nn),
     part as (select doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * nn) // ll))) as s from tfs join w using (term) join sizes using (doc_id), total),
     scored as (select item_id, doc_id, cast(sum(c * s) as bigint) as score from (select item_id, term, count(*) as c from bw group by item_id, term) join part using (term) group by item_id, doc_id)
select item_id, cast(row_number() over (partition by item_id order by score desc, doc_id) as integer) as rank, doc_id, score from scored where score > 0
qualify row_number() over (partition by item_id order by score desc, doc_id) <= 20
"""
