"""Benchmark decontamination: an FM-index per shard of documents, searched for every window of the benchmark.

A shard is a block of documents of one task (``SHARD_BYTES`` of text, or one longer document). Its words become symbols:
the words of the benchmark keep a number each, any run of other words is one separator, as no window can hold it. The
index is a suffix array kept as samples, the Burrows-Wheeler transform in a wavelet matrix, and symbol counts. All windows
are searched backwards together, matched rows walk to the next sampled suffix position, and the spans are merged.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.common import blocks, map_rows, read, utf8

SHARD_BYTES = 4 << 20
#: Benchmark text that one pass over the documents searches; a larger benchmark takes several passes.
PASS_BYTES = 8 << 20
SAMPLE = 8
WINDOW = 10
#: Lower-cases A-Z and turns every other ASCII byte that is no digit or letter into a space.
WORD_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(WORD_BYTES).split()


def suffix_array(seq: np.ndarray) -> np.ndarray:
    """Suffix order of non-negative symbols by prefix doubling; later rounds touch unresolved groups only."""
    n = len(seq)
    bits = max(1, int(seq.max()).bit_length())
    step = max(1, 62 // bits)
    key = np.zeros(n, np.int64)
    for k in range(step):
        key <<= bits
        key[: max(0, n - k)] |= seq[k:]
    order = np.argsort(key, kind="stable")
    rank = np.empty(n, np.int64)
    head = np.concatenate(([True], key[order[1:]] != key[order[:-1]]))
    rank[order] = np.maximum.accumulate(np.where(head, np.arange(n), 0))
    slots = np.arange(n)
    while True:
        alone = head & np.concatenate((head[1:], [True]))
        keep = ~alone
        slots, head = slots[keep], head[keep]
        if not len(slots):
            return order
        at = order[slots]
        ahead = at + step
        second = np.where(ahead < n, rank[np.minimum(ahead, n - 1)], -1)
        first = rank[at]
        by = np.lexsort((second, first))
        at, first, second = at[by], first[by], second[by]
        order[slots] = at
        head = np.concatenate(([True], (first[1:] != first[:-1]) | (second[1:] != second[:-1])))
        rank[at] = slots[np.maximum.accumulate(np.where(head, np.arange(len(slots)), 0))]
        step *= 2


class FMIndex:
    """Full-text index of symbols 1 and up; a closing 0 is added."""

    def __init__(self, seq: np.ndarray, sigma: int):
        seq = np.append(seq, 0)
        order = suffix_array(seq)
        self.counts = np.concatenate(([0], np.cumsum(np.bincount(seq, minlength=sigma))))
        level, self.levels = seq[order - 1].astype(np.int32), []
        starts = np.zeros(sigma, np.int64)
        symbols = np.arange(sigma)
        for b in range(max(1, (sigma - 1).bit_length()) - 1, -1, -1):
            bit = (level >> b) & 1
            ones = np.concatenate(([0], np.cumsum(bit, dtype=np.int32)))
            zeros = len(level) - int(ones[-1])
            self.levels.append((b, ones, zeros))
            starts = np.where((symbols >> b) & 1, zeros + ones[starts], starts - ones[starts])
            level = np.concatenate((level[bit == 0], level[bit == 1]))
        self.starts = starts
        self.marked = order % SAMPLE == 0
        self.sampled = order[self.marked]
        self.sample_rank = np.cumsum(self.marked) - 1

    def rank(self, symbol: np.ndarray, row: np.ndarray) -> np.ndarray:
        """Times ``symbol`` stands before ``row`` in the transform."""
        for b, ones, zeros in self.levels:
            before = ones[row]
            row = np.where((symbol >> b) & 1, zeros + before, row - before)
        return row - self.starts[symbol]

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row range of every pattern (patterns, length), read backwards."""
        lo = np.zeros(len(patterns), np.int64)
        hi = np.full(len(patterns), self.counts[-1])
        live = np.arange(len(patterns))
        for k in range(patterns.shape[1] - 1, -1, -1):
            symbol = patterns[live, k]
            base = self.counts[symbol]
            lo[live], hi[live] = base + self.rank(symbol, lo[live]), base + self.rank(symbol, hi[live])
            live = live[hi[live] > lo[live]]
        hi[hi < lo] = lo[hi < lo]
        gone = np.ones(len(patterns), bool)
        gone[live] = False
        hi[gone] = lo[gone]
        return lo, hi

    def back(self, row: np.ndarray) -> np.ndarray:
        """Row of the suffix one symbol longer."""
        symbol = np.zeros(len(row), np.int64)
        for _, ones, zeros in self.levels:
            before = ones[row]
            bit = ones[row + 1] - before
            symbol = symbol * 2 + bit
            row = np.where(bit == 1, zeros + before, row - before)
        return self.counts[symbol] + row - self.starts[symbol]

    def locate(self, rows: np.ndarray) -> np.ndarray:
        out, walked, row = np.empty(len(rows), np.int64), 0, rows
        todo = np.arange(len(rows))
        while len(todo):
            found = self.marked[row]
            out[todo[found]] = self.sampled[self.sample_rank[row[found]]] + walked
            todo, row = todo[~found], self.back(row[~found])
            walked += 1
        return out


class Benchmark:
    """Windows of the items of one pass, as symbol arrays by length, and the items of every window."""

    def __init__(self, items: list[tuple[str, bytes]], window: int = WINDOW):
        self.vocab: dict[bytes, int] = {}
        grams: dict[tuple[int, ...], set[str]] = {}
        for name, text in items:
            ids = [self.vocab.setdefault(w, len(self.vocab) + 2) for w in words_of(text)]
            size = min(window, len(ids))
            for i in range(len(ids) - size + 1 if size else 0):
                grams.setdefault(tuple(ids[i : i + size]), set()).add(name)
        by_length: dict[int, list] = {}
        for g, names in grams.items():
            by_length.setdefault(len(g), []).append((g, sorted(names)))
        self.patterns = {n: (np.array([g for g, _ in x], np.int64), [names for _, names in x]) for n, x in by_length.items()}
        self.sigma = len(self.vocab) + 2
        self.shortest = min(by_length, default=0)


def search_shard(texts: list[bytes], bench: Benchmark) -> tuple[np.ndarray, list[list[tuple[int, int]]], list[list[str]]]:
    """Words of each document, merged spans (first word, end) inside any window's occurrence, and the items that occur."""
    get, symbols, sizes = bench.vocab.get, [], []
    for t in texts:
        w = words_of(t)
        sizes.append(len(w))
        symbols += map(get, w, [1] * len(w))
        symbols.append(1)
    spans: list[list] = [[] for _ in texts]
    items: list[list] = [[] for _ in texts]
    n_words = np.array(sizes, np.int64)
    word = np.array(symbols, np.int64)
    known = word > 1
    edge = np.flatnonzero(np.diff(np.concatenate(([0], known.view(np.int8), [0]))))
    runs = edge.reshape(-1, 2)
    runs = runs[runs[:, 1] - runs[:, 0] >= bench.shortest] if bench.shortest else runs[:0]
    if not len(runs):
        return n_words, spans, items
    lens = runs[:, 1] - runs[:, 0] + 1  # each run with the word behind it, that is no benchmark word
    at = np.repeat(runs[:, 0] - np.concatenate(([0], np.cumsum(lens)[:-1])), lens) + np.arange(lens.sum())
    index = FMIndex(word[at], bench.sigma)
    doc_start = np.concatenate(([0], np.cumsum(n_words + 1)[:-1]))
    cover = np.zeros(len(word) + 1, np.int32)
    named: list[set] = [set() for _ in texts]
    for size, (patterns, names) in bench.patterns.items():
        lo, hi = index.search(patterns)
        n = hi - lo
        if not n.any():
            continue
        rows = np.repeat(lo - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
        which = np.repeat(np.arange(len(n)), n)
        first = at[index.locate(rows)]
        np.add.at(cover, first, 1)
        np.add.at(cover, first + size, -1)
        doc = np.searchsorted(doc_start, first, side="right") - 1
        for d, p in np.unique(np.stack([doc, which], axis=1), axis=0).tolist():
            named[d].update(names[p])
    hit = np.cumsum(cover[:-1]) > 0
    edge = np.flatnonzero(np.diff(np.concatenate(([0], hit.view(np.int8), [0])))).reshape(-1, 2)
    for d, (a, b) in zip(np.searchsorted(doc_start, edge[:, 0], side="right") - 1, edge.tolist()):
        spans[d].append((a - int(doc_start[d]), b - int(doc_start[d])))
    return n_words, spans, [sorted(x) for x in named]


def merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def without_words(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """``text`` without the words of the spans and what stands between them."""
    at = [m.span() for m in re.finditer(rb"[^ ]+", text.translate(WORD_BYTES))]
    out, done = [], 0
    for a, b in spans:
        out.append(text[done : at[a][0]])
        done = at[b - 1][1]
    return b"".join([*out, text[done:]])


def find_leaks(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` with n_words, ``leak_spans`` (merged word ranges) and ``leak_items`` (sorted ids) added; own columns of
    these names are replaced.

    Null and wordless texts have no words; null, empty or wordless items have no window; an item with a null id counts under
    the id of empty text. Rows map one to one, so repeated rows and null ids stay as they are. The benchmark is sent in
    passes of ``PASS_BYTES`` of text, cut by a hash of the item, so what a task receives is bounded whatever its size.
    """
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), F.coalesce("text", F.lit("")).alias("text"))
    total = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    passes = max(1, math.ceil(total / PASS_BYTES))
    added = ("n_words", "leak_spans", "leak_items")
    kept = [c for c in docs.columns if c not in added]
    out = docs.select(*kept, F.lit(0).cast("bigint").alias("n_words"), F.expr("cast(array() as array<struct<a:bigint,b:bigint>>)").alias("leak_spans"), F.expr("cast(array() as array<string>)").alias("leak_items"))
    at = kept.index("text")
    for k in range(passes):
        part = items.where(F.pmod(F.xxhash64("item", "text"), F.lit(passes)) == k).collect()
        shared = docs.sparkSession.sparkContext.broadcast(Benchmark([(r["item"], r["text"].encode()) for r in part], window))

        def work(batch: pa.RecordBatch, shared=shared) -> dict:
            texts = utf8(batch.column(at))
            counts, spans, found = [], [], []
            for lo, hi in blocks(texts, SHARD_BYTES):
                n, s, i = search_shard(texts[lo:hi], shared.value)
                counts.append(n)
                spans += s
                found += i
            was_spans, was_items = batch.column("leak_spans").to_pylist(), batch.column("leak_items").to_pylist()
            spans = [merge(s + [(x["a"], x["b"]) for x in w]) for s, w in zip(spans, was_spans)]
            found = [sorted({*i, *w}) for i, w in zip(found, was_items)]
            new = {"n_words": pa.array(np.concatenate(counts)), "leak_spans": [[{"a": a, "b": b} for a, b in s] for s in spans], "leak_items": found}
            return dict(zip(kept, batch.columns)) | new

        out = map_rows(out, out.schema, work)
    return out


def remove_leaks(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` with every occurrence of a benchmark window cut from ``text`` (and ``n_chars``, if there, brought up to date)."""
    own = {c: f"__own_{c}" for c in ("n_words", "leak_spans", "leak_items") if c in docs.columns}
    found = find_leaks(docs.withColumnsRenamed(own), benchmark, window).drop("n_words", "leak_items")
    at, cut = found.columns.index("text"), found.columns.index("leak_spans")

    def work(batch: pa.RecordBatch) -> dict:
        spans = batch.column(cut).to_pylist()
        texts = batch.column(at).to_pylist()
        for i, s in enumerate(spans):
            if s:
                texts[i] = without_words(texts[i].encode(), [(x["a"], x["b"]) for x in s]).decode()
        return dict(zip(batch.schema.names, batch.columns)) | {"text": texts}

    out = map_rows(found, found.schema, work)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.size("leak_spans") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.drop("leak_spans").withColumnsRenamed({v: k for k, v in own.items()}).select(*docs.columns)


def op8_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_leaks(read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("leak_spans", F.lit(0).cast("bigint"), lambda s, x: s + x["b"] - x["a"])
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("leak_items").cast("bigint").alias("n_items"), F.sha2(F.concat_ws(",", "leak_items"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


OP8_SQL = r"""
with lower_docs as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
     bench as (select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
     sized as (select item_id, w, least(10, len(w)) as size from bench where len(w) > 0),
     starts as (select item_id, w, size, unnest(range(1, len(w) - size + 2)) as i from sized),
     grams as (select distinct item_id, size, array_to_string(w[i:i + size - 1], ' ') as g from starts),
     doc_starts as (select doc_id, w, size, unnest(range(1, len(w) - size + 2)) as i from lower_docs, (select distinct size from grams) where len(w) >= size),
     doc_grams as (select doc_id, size, i, array_to_string(w[i:i + size - 1], ' ') as g from doc_starts),
     found as (select doc_id, item_id, doc_grams.size, i from doc_grams join grams using (size, g)),
     hits as (select doc_id, count(distinct j) as n_hit from (select doc_id, unnest(range(i, i + size)) as j from found) group by doc_id),
     names as (select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as names from (select distinct doc_id, cast(item_id as varchar) as item from found) group by doc_id)
select d.doc_id, cast(len(d.w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
       sha256(coalesce(names, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from lower_docs d left join hits using (doc_id) left join names using (doc_id)
"""
