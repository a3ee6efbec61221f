"""SimHash fingerprints and near-duplicate groups by pivot distance tables; near copies by shingle similarity."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.llm.common import ASCII_LOWER, blocks, components, map_rows, popcount, read, utf8
from tessella.session import materialize

#: Reference fingerprints of the pivot table: any fixed well-spread values do.
PIVOTS = [xxhash.xxh64_intdigest(str(i).encode(), 7) for i in range(24)]
#: Fingerprints of one candidate bucket that are compared by the pivot table; fuller buckets take the shared-neighbour way.
BUCKET_ROWS = 256
#: Words of a shingle and least Jaccard similarity, in fifths, of near copies.
COPY_WORDS, COPY_FIFTHS = 5, 4
#: Share of the pairs at the least similarity that meet as candidates, and bits in which candidates differ at most.
RECALL, NEAR_BITS = 0.95, 17
#: Rounds that compare each node of a bucket with one of its nodes only, and nodes beyond which a bucket is cut into chunks.
STAR_ROUNDS, BUCKET_NODES = 1, 2048
#: Bits of the parities that candidates of a bucket are compared by.
MARK_BITS = 512


def shingles(words: list[bytes], size: int, seed: int = 42) -> np.ndarray:
    """Hashes of all ``size``-word strings in order; of fewer words, of the one string they form; none of no word."""
    if not words:
        return np.zeros(0, np.uint64)
    text, size = b" ".join(words), min(size, len(words))
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    digest = xxhash.xxh64_intdigest
    return np.array([digest(text[i:j], seed) for i, j in zip(starts[: len(words) - size + 1].tolist(), ends[size - 1 :].tolist())], np.uint64)


def fingerprint(words: list[bytes], size: int = 3, seed: int = 42) -> int:
    """64-bit SimHash of a word list: a bit is set if over half the shingle hashes have it; no word gives zero."""
    if not words:
        return 0
    if len(words) < size:
        return xxhash.xxh64_intdigest(b" ".join(words), seed)
    return majority(shingles(words, size, seed))


def majority(hashes: np.ndarray) -> int:
    """The bits that over half of the hashes have."""
    ones = np.zeros(64, np.int64)
    for lo in range(0, len(hashes), 1 << 16):
        part = hashes[lo : lo + (1 << 16)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3) -> DataFrame:
    """(doc_id, fp): the fingerprint of every whole text as a signed long. Null and blank texts give zero."""
    schema = f"doc_id {docs.schema[id_col].dataType.simpleString()}, fp bigint"

    def work(batch: pa.RecordBatch) -> dict:
        texts = utf8(batch.column(1))
        fps = np.empty(len(texts), np.uint64)
        for lo, hi in blocks(texts):
            for i in range(lo, hi):
                fps[i] = fingerprint(texts[i].translate(ASCII_LOWER).split(), size)
        return {"doc_id": batch.column(0), "fp": pa.array(fps.view(np.int64))}

    return map_rows(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), schema, work)


def _bands(fp: Column, distance: int) -> Column:
    """Keys of which two fingerprints within ``distance`` bits share one at least: all pairs of ``distance + 2`` blocks."""
    n = distance + 2
    cuts = [64 * i // n for i in range(n + 1)]
    block = [F.shiftrightunsigned(fp, cuts[i]).bitwiseAND(F.lit((1 << (cuts[i + 1] - cuts[i])) - 1)) for i in range(n)]
    return F.array(*[F.struct(F.lit(k).alias("band"), F.shiftleft(block[i], 32).bitwiseOR(block[j]).alias("key")) for k, (i, j) in enumerate(combinations(range(n), 2))])


def _pivot_links(distance: int):
    """Links within sorted buckets (band, key, fp, pivots): pairs are discarded by the largest pivot difference, then verified."""

    def forest(pairs: np.ndarray) -> Iterator[tuple[int, int]]:
        root: dict[int, int] = {}

        def find(x: int) -> int:
            while (p := root.setdefault(x, x)) != x:
                root[x] = root[p]
                x = p
            return x

        for a, b in pairs.tolist():
            a, b = find(a), find(b)
            if a != b:
                root[max(a, b)] = min(a, b)
        return ((x, find(x)) for x in list(root) if find(x) != x)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = None
        for batch in batches:
            if not batch.num_rows:
                continue
            kept, out = step(pa.Table.from_batches([batch] if kept is None else [kept, batch]).combine_chunks(), False)
            yield out
        if kept is not None:
            yield step(pa.Table.from_batches([kept]), True)[1]

    def step(table: pa.Table, last: bool) -> tuple[pa.RecordBatch | None, pa.RecordBatch]:
        band, key, fp = (table.column(c).to_numpy() for c in ("band", "key", "fp"))
        same = np.concatenate(([False], (band[1:] == band[:-1]) & (key[1:] == key[:-1])))
        n = len(fp)
        cut = n if last else int(np.flatnonzero(~same)[-1])  # the last bucket may go on in the next batch
        run_id = np.cumsum(~same)[:cut]
        table_of = np.stack([table.column(f"p{k}").to_numpy()[:cut] for k in range(len(PIVOTS))], axis=1)
        bits, found, at = fp.view(np.uint64), [], np.arange(cut)
        lag = 1
        while len(at := at[at + lag < cut]) and len(at := at[run_id[at] == run_id[at + lag]]):
            for lo in range(0, len(at), 1 << 15):
                a = at[lo : lo + (1 << 15)]
                near = a[np.abs(table_of[a] - table_of[a + lag]).max(axis=1) <= distance]
                near = near[popcount(bits[near] ^ bits[near + lag]) <= distance]
                if len(near):
                    found.append(np.stack([fp[near], fp[near + lag]], axis=1))
            lag += 1
        links = list(forest(np.concatenate(found))) if found else []
        out = pa.RecordBatch.from_arrays([pa.array([x[i] for x in links], pa.int64()) for i in (0, 1)], names=["x", "y"])
        rest = None if last else table.slice(cut).combine_chunks().to_batches()[0]
        return rest, out

    return run


def fingerprint_links(distinct: DataFrame, distance: int = 2) -> DataFrame:
    """Links (x, y) that connect all fingerprints of ``distinct(fp)`` within ``distance`` bits of each other.

    Candidates share two of ``distance + 2`` bit blocks. In a bucket the pivot table (Hamming distances to the reference
    fingerprints, made once per fingerprint) discards a pair if any coordinate differs by more than ``distance``; the rest
    is verified on the bits and kept as a spanning forest. Fingerprints of a bucket with over ``BUCKET_ROWS`` rows are
    linked through the values one bit away instead (exact for two bits): two fingerprints within two bits share such a value,
    and at most 65 share one, so no bucket is large and no pair is lost.
    """
    if distance != 2:
        raise ValueError("links are exact for a distance of 2")
    table = distinct.select("fp", *[F.bit_count(F.col("fp").bitwiseXOR(F.lit(p - (1 << 64) if p >> 63 else p))).cast("tinyint").alias(f"p{k}") for k, p in enumerate(PIVOTS)])
    keyed = distinct.select("fp", F.explode(_bands(F.col("fp"), distance)).alias("b")).select("fp", "b.band", "b.key")
    sizes = materialize(keyed.groupBy("band", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "buckets")
    shared = keyed.join(sizes, ["band", "key"])
    small = shared.where(F.col("n") <= BUCKET_ROWS).select("band", "key", "fp").join(table, "fp")
    small = small.repartition("band", "key").sortWithinPartitions("band", "key", "fp").mapInArrow(_pivot_links(distance), "x bigint, y bigint")
    full = shared.where(F.col("n") > BUCKET_ROWS).select("fp").distinct()
    flips = [0, *[1 << i for i in range(63)], -(1 << 63)]
    around = full.select("fp", F.explode(F.array(*[F.col("fp").bitwiseXOR(F.lit(f)) for f in flips])).alias("at"))
    starred = around.join(around.groupBy("at").agg(F.min("fp").alias("least")), "at").where("fp <> least").select(F.col("fp").alias("x"), F.col("least").alias("y"))
    return small.unionByName(starred).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = 2) -> DataFrame:
    """(doc_id, fp, component_id): documents whose fingerprints are linked, directly or in steps, share the smallest doc_id.

    Equal fingerprints are one node, so copies never form pairs. A row with a null id takes part under its fingerprint but
    can't name a component; repeated rows stay repeated; an empty table gives none.
    """
    prints = materialize(fingerprints(docs, id_col, text_col), "prints")
    nodes = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "nodes")
    found = materialize(components(materialize(fingerprint_links(nodes.select("fp"), distance).select(F.col("x").alias("a"), F.col("y").alias("b")), "links")), "found")
    named = found.join(nodes, found["node"] == nodes["fp"]).select("node", "component", "first_id")
    smallest = named.groupBy("component").agg(F.min("first_id").alias("component_id"))
    of_print = nodes.join(named.join(smallest, "component").select(F.col("node").alias("fp"), "component_id"), "fp", "left")
    of_print = of_print.select("fp", F.coalesce("component_id", "first_id").alias("component_id"))
    return prints.join(of_print, "fp").select("doc_id", "fp", "component_id")


def _words(text: bytes) -> np.ndarray:
    return np.unique(shingles(text.translate(ASCII_LOWER).split(), COPY_WORDS))


def _parities(h: np.ndarray, bits: int = 0) -> bytes:
    """Bitmap of at least as many bits as ``h`` has members, or of ``bits``: a bit is set if an odd number of members fall on it."""
    bits = bits or max(64, 1 << (len(h) - 1).bit_length())
    n = np.bincount((h >> np.uint64(20)).astype(np.uint64) % np.uint64(bits), minlength=bits) & 1 if len(h) else np.zeros(bits, np.int64)
    return np.packbits(n.astype(np.uint8)).tobytes()


def shingle_sets(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, row_hash, set_id, n, fp, bits, mark) of every row of ``docs``: the set of a whole text's shingles.

    ``set_id`` hashes the set and ``n`` counts it; ``fp`` is its SimHash fingerprint, ``bits`` its parities and
    ``mark`` those of one size for all. ``row_hash`` covers all columns but maps.
    """
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, text_hash bigint, row_hash bigint, set_id bigint, n bigint, fp bigint, bits binary, mark binary"

    def work(batch: pa.RecordBatch) -> dict:
        out: dict[str, list] = {"set_id": [], "n": [], "fp": [], "bits": [], "mark": []}
        for text in utf8(batch.column(3)):
            h = _words(text)
            out["set_id"].append(int(np.uint64(xxhash.xxh64_intdigest(h.tobytes(), 7)).view(np.int64)))
            out["n"].append(len(h))
            out["fp"].append(int(np.uint64(majority(h)).view(np.int64)))
            out["bits"].append(_parities(h))
            out["mark"].append(_parities(h, MARK_BITS))
        return dict(zip(("doc_id", "text_hash", "row_hash"), batch.columns)) | out

    hashed = F.xxhash64(*[f.name for f in docs.schema if not isinstance(f.dataType, T.MapType)])
    return map_rows(docs.select("doc_id", F.xxhash64("text").alias("text_hash"), hashed.alias("row_hash"), "text"), schema, work)


def _possible(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """``pairs(a, b)`` without those whose parities differ in more bits than similar sets have members of one only."""
    both = pairs.join(nodes.toDF("a", "n", "x").hint("merge"), "a").join(nodes.toDF("b", "m", "y").hint("merge"), "b")

    def work(batch: pa.RecordBatch) -> dict:
        keep = np.zeros(batch.num_rows, bool)
        columns = [batch.column(c).to_pylist() for c in ("n", "m", "x", "y")]
        for i, (n, m, x, y) in enumerate(zip(*columns)):
            x, y = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
            if len(x) != len(y):
                x, y = (_folded(v, min(len(x), len(y))) for v in (x, y))
            keep[i] = 9 * int(popcount(x ^ y).sum()) <= n + m
        return {c: pa.array(batch.column(c).to_numpy()[keep]) for c in ("a", "b")}

    near = both.where(5 * F.least("n", "m") >= COPY_FIFTHS * F.greatest("n", "m"))
    return map_rows(near.select("a", "b", "n", "m", "x", "y"), "a bigint, b bigint", work)


def _folded(bits: np.ndarray, size: int) -> np.ndarray:
    return np.bitwise_xor.reduce(bits.reshape(-1, size), axis=0)


def _similar(pairs: DataFrame, sets: DataFrame, docs: DataFrame) -> DataFrame:
    """Those of ``pairs(a, b)`` whose shingle sets are similar; sets are made again from the texts of the pairs left."""
    nodes = sets.select("set_id", "n", "bits").dropDuplicates(["set_id"])
    pairs = materialize(_possible(pairs, nodes), "possible")
    ends = pairs.select(F.col("a").alias("set_id")).unionByName(pairs.select(F.col("b").alias("set_id"))).distinct()
    chosen = sets.join(ends.hint("merge"), "set_id", "left_semi").groupBy("set_id").agg(F.min("text_hash").alias("__hash"))
    held = docs.select("text", F.xxhash64("text").alias("__hash")).join(chosen.hint("merge"), "__hash").groupBy("set_id").agg(F.min("text").alias("text"))
    held = materialize(held, "held")
    both = pairs.join(held.toDF("a", "x").hint("merge"), "a").join(held.toDF("b", "y").hint("merge"), "b")

    def work(batch: pa.RecordBatch) -> dict:
        keep = np.zeros(batch.num_rows, bool)
        few = lru_cache(256)(lambda text: _words(text.encode()))
        known = lambda text: few(text) if len(text) < 1 << 16 else _words(text.encode())
        for i, (x, y) in enumerate(zip(batch.column(2), batch.column(3))):
            x, y = (known(v.as_py()) for v in (x, y))
            common = len(np.intersect1d(x, y, assume_unique=True))
            keep[i] = 5 * common >= COPY_FIFTHS * (len(x) + len(y) - common)
        return {c: pa.array(batch.column(c).to_numpy()[keep]) for c in ("a", "b")}

    return map_rows(both.select("a", "b", "x", "y"), "a bigint, b bigint", work)


def table_bits(nodes: int) -> list[list[int]]:
    """Bit places of every candidate table, for so many fingerprints.

    A key has as many bits as tell the fingerprints apart, so buckets stay small at every size. Fingerprints of two sets at
    the least similarity differ in each bit with a chance of ``angle / pi``, and there are so many tables that ``RECALL`` of
    such pairs share a bucket; of more similar pairs more do.
    """
    least = COPY_FIFTHS / 5
    same = 1 - math.acos(2 * least / (1 + least)) / math.pi
    size = min(48, max(8, math.ceil(math.log2(max(2, nodes)))))
    n = math.ceil(math.log(1 - RECALL) / math.log(1 - same**size))
    r = np.random.default_rng(5)
    return [sorted(r.permutation(64)[:size].tolist()) for _ in range(n)]


def _keyed(nodes: DataFrame, tables: list[list[int]]) -> DataFrame:
    """(key, set_id, n, fp, part): every node under its key in each table, with the table's number in the key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column("fp").to_numpy().view(np.uint64)
            key = np.empty((len(tables), len(fp)), np.uint64)
            for t, places in enumerate(tables):
                k = np.full(len(fp), t, np.uint64)
                for b in places:
                    k = k << np.uint64(1) | fp >> np.uint64(b) & np.uint64(1)
                key[t] = k
            again = [pa.concat_arrays([batch.column(c)] * len(tables)) for c in ("set_id", "n", "fp", "part")]
            yield pa.RecordBatch.from_arrays([pa.array(key.ravel().view(np.int64)), *again], names=["key", "set_id", "n", "fp", "part"])

    return nodes.select("set_id", "n", "fp", "part").mapInArrow(run, "key bigint, set_id bigint, n bigint, fp bigint, part bigint")


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows (key, i, j, chunk, set_id, n, fp, part, mark) -> pairs (a, b) of different parts that may be near copies.

    A pair is discarded if any coordinate of the pivot table (distances to the reference fingerprints) differs by more than
    ``NEAR_BITS``, then by its own distance, by the sizes of the sets, and if their parities differ in more bits than similar
    sets have members of one only.
    """
    fields = ("key", "i", "j", "chunk", "set_id", "n", "fp", "part")
    pivots = np.array(PIVOTS, np.uint64)

    def pairs(c: dict[str, np.ndarray]) -> pa.RecordBatch:
        new = np.concatenate(([True], (c["key"][1:] != c["key"][:-1]) | (c["i"][1:] != c["i"][:-1]) | (c["j"][1:] != c["j"][:-1])))
        run_id, fp, found = np.cumsum(new), c["fp"].view(np.uint64), []
        table = np.stack([popcount(fp ^ p) for p in pivots], axis=1).astype(np.int8)
        at, lag = np.arange(len(fp)), 1
        while len(at := at[at + lag < len(fp)]) and len(at := at[run_id[at] == run_id[at + lag]]):
            for lo in range(0, len(at), 1 << 15):
                a = at[lo : lo + (1 << 15)]
                b = a + lag
                ok = (c["part"][a] != c["part"][b]) & ((c["i"][a] == c["j"][a]) | (c["chunk"][a] != c["chunk"][b]))
                ok &= 5 * np.minimum(c["n"][a], c["n"][b]) >= COPY_FIFTHS * np.maximum(c["n"][a], c["n"][b])
                a, b = a[ok], b[ok]
                ok = np.abs(table[a] - table[b]).max(axis=1, initial=0) <= NEAR_BITS
                a, b = a[ok], b[ok]
                ok = popcount(fp[a] ^ fp[b]) <= NEAR_BITS
                a, b = a[ok], b[ok]
                ok = 9 * popcount(c["mark"][a] ^ c["mark"][b]).sum(axis=1, dtype=np.int64) <= c["n"][a] + c["n"][b]
                if ok.any():
                    found.append(np.stack([c["set_id"][a[ok]], c["set_id"][b[ok]]], axis=1))
            lag += 1
        both = np.unique(np.sort(np.concatenate(found), axis=1), axis=0) if found else np.zeros((0, 2), np.int64)
        return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], names=["a", "b"])

    kept = None
    for batch in batches:
        c = {f: batch.column(f).to_numpy() for f in fields}
        c["mark"] = np.frombuffer(b"".join(batch.column("mark").to_pylist()), np.uint64).reshape(batch.num_rows, -1)
        if kept is not None:
            c = {f: np.concatenate((kept[f], c[f])) for f in c}
        if not len(c["key"]):
            continue
        last = (c["key"] == c["key"][-1]) & (c["i"] == c["i"][-1]) & (c["j"] == c["j"][-1])
        cut = int(last.argmax())  # the last bucket may go on in the next batch
        if cut:
            yield pairs({f: v[:cut] for f, v in c.items()})
        kept = {f: v[cut:] for f, v in c.items()}
    if kept is not None:
        yield pairs(kept)


def copy_links(sets: DataFrame, docs: DataFrame) -> DataFrame:
    """Links (a, b) of sets with a Jaccard similarity of four fifths or more, verified on the sets.

    Candidates share a bucket of some table of fingerprint bits (:func:`table_bits`) and lie within ``NEAR_BITS`` of each
    other, which pivot distances tell first. To begin with, the nodes of a bucket are compared with one of them only, another
    one in each table and round, which joins large groups of copies in steps; then all pairs of a bucket that are in parts
    not yet joined. A bucket of over ``BUCKET_NODES`` nodes is cut into chunks, and every two chunks are compared in a task
    of their own. Joins are by sort: Spark sizes the keyed nodes by the nodes they are made of, and would broadcast them.
    """
    nodes = materialize(sets.groupBy("set_id").agg(F.min("n").alias("n"), F.min("fp").alias("fp")), "nodes")
    tables = table_bits(nodes.count())
    links = seen = None
    for turn in range(STAR_ROUNDS):
        keyed = _keyed(_parts(nodes, links), tables)
        one = F.struct(F.xxhash64("set_id", "key", F.lit(turn)), "set_id", "n", "fp", "part")
        ones = keyed.groupBy("key").agg(F.min(one).alias("low"), F.min("part").alias("l"), F.max("part").alias("h")).where("l <> h").select("key", "low")
        near = (F.col("part") != F.col("low.part")) & (F.bit_count(F.col("fp").bitwiseXOR(F.col("low.fp"))) <= NEAR_BITS)
        star = keyed.join(ones.hint("merge"), "key").where(near & (5 * F.least("n", "low.n") >= COPY_FIFTHS * F.greatest("n", "low.n")))
        star = star.select(F.least("low.set_id", "set_id").alias("a"), F.greatest("low.set_id", "set_id").alias("b")).distinct()
        star = materialize(star if seen is None else star.join(seen.hint("merge"), ["a", "b"], "left_anti"), "star")
        found = materialize(_similar(star, sets, docs), "near")
        links, seen = (found, star) if links is None else (links.unionByName(found), seen.unionByName(star))
    keyed = _keyed(_parts(nodes, links), tables)
    sizes = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("rows"), F.min("part").alias("l"), F.max("part").alias("h")).where("rows > 2 and l <> h")
    sizes = materialize(sizes.select("key", F.ceil(F.col("rows") / BUCKET_NODES).cast("int").alias("chunks")), "buckets")
    held = keyed.join(sizes.hint("merge"), "key").withColumn("chunk", F.pmod(F.xxhash64("set_id"), "chunks").cast("int"))
    held = held.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    held = held.withColumn("i", F.least("chunk", "other")).withColumn("j", F.greatest("chunk", "other")).select("key", "i", "j", "chunk", "set_id", "n", "fp", "part")
    held = held.join(sets.groupBy("set_id").agg(F.min("mark").alias("mark")).hint("merge"), "set_id")
    rest = held.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(_near, "a bigint, b bigint").distinct()
    return links.unionByName(_similar(materialize(rest.join(seen.hint("merge"), ["a", "b"], "left_anti"), "rest"), sets, docs))


def _parts(nodes: DataFrame, links: DataFrame | None) -> DataFrame:
    """``nodes`` with the part that the links so far put each in."""
    if links is None:
        return nodes.withColumn("part", F.col("set_id"))
    part = nodes.join(components(links).toDF("set_id", "part").hint("merge"), "set_id", "left")
    return materialize(part.withColumn("part", F.coalesce("part", "set_id")), "parts")


def keep_one(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each group of near copies: the document with the smallest id.

    Near copies have five-word shingle sets with a Jaccard similarity of 0.8 or more, directly or in steps; texts without a
    word are copies of each other. Rows without an id stay. A row of an id that other rows share stays only if its own text
    represents a group; of several such rows of one id, one stays, the first by the hash of its text, then of the row.
    """
    sets = materialize(shingle_sets(docs), "sets")
    found = components(materialize(copy_links(sets, docs.select("doc_id", "text")), "links")).toDF("set_id", "part")
    same = ["doc_id", "text_hash", "row_hash"]
    rows = sets.where("doc_id is not null").groupBy(*same).agg(F.min("set_id").alias("set_id"), F.count(F.lit(1)).alias("rows")).join(found.hint("merge"), "set_id", "left")
    first = rows.groupBy(F.coalesce("part", "set_id").alias("part")).agg(F.min(F.struct(*same, "rows")).alias("r"))
    kept = materialize(first.groupBy(F.col("r.doc_id").alias("__kept")).agg(F.min(F.struct("r.text_hash", "r.row_hash", "r.rows")).alias("__r")), "kept")
    hashed = F.xxhash64(*[f.name for f in docs.schema if not isinstance(f.dataType, T.MapType)])
    fits = (F.col("doc_id") == F.col("__kept")) & (F.xxhash64("text") == F.col("__r.text_hash")) & (hashed == F.col("__r.row_hash"))
    with_id = docs.where("doc_id is not null").join(kept.where("__r.rows = 1").hint("merge"), fits, "left_semi")
    repeated = kept.where("__r.rows > 1")
    if not repeated.isEmpty():  # rows that are equal throughout
        with_id = with_id.unionByName(docs.where("doc_id is not null").join(repeated.hint("merge"), fits, "left_semi").dropDuplicates(["doc_id"]))
    return with_id.unionByName(docs.where("doc_id is null"))


def op10_simhash_groups(spark, sf_dir: str) -> DataFrame:
    out = near_duplicates(read(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
