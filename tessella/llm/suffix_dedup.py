"""Removal of byte strings that an earlier document holds already, by suffix order and longest-previous-factor arrays.

A string of ``SPAN`` bytes that starts in a document goes if it starts in a document with a smaller id too.

1. Every ``SPAN``-byte window has a minimizer, the least hash of its ``GRAM``-byte strings; equal windows have equal ones.
   Consecutive windows with one minimizer are a run. Runs are sent as (minimizer, hash of the content, document, number of
   the run), 14 bytes each, packed by minimizer bucket.
2. A bucket task takes its runs in as a stream. Runs of equal content are one: the smallest document stays, the others are
   covered whole. Where different contents share a minimizer, each is asked for; over ``HOT`` contents of one minimizer are
   asked for window by window, so that a passage of very many documents spreads over all tasks.
3. The documents asked send those runs' bytes to the partition of the minimizer. Single windows are aggregated to their least
   document and joined with it, so no task gathers the records of a window.
4. There all windows are put in suffix order. The previous and the next entry of a smaller document, with the common prefix
   up to it, give the longest previous factor; ``SPAN`` or more means the window goes.
5. The removed ranges meet their texts. Texts are compressed on both trips.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.common import blocks, map_rows, read, utf8
from tessella.session import materialize

SPAN = 50
GRAM = 20
#: Text bytes whose runs go to one bucket, and bytes of runs that are sorted in one task, on average.
BUCKET_BYTES = 16 << 20
SORT_BYTES = 4 << 20
#: Different contents of a minimizer beyond which its windows are dealt out one by one.
HOT = 4096
#: Runs a bucket task gathers before it folds equal ones.
FOLD_RUNS = 1_500_000
BLOCK = 1 << 18
#: A run is cut after so many windows.
LONGEST_RUN = 4 * SPAN
COVERED, ASKED, BY_WINDOW = 0, 1, 2
ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]
BYTE_HASH = np.random.default_rng(1).integers(0, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
BASE, UNBASE = 0x5851F42D4C957F2D, pow(0x5851F42D4C957F2D, -1, 1 << 64)


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, np.uint64(base))
    out[:1] = 1
    return np.multiply.accumulate(out)


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = max(2 * BLOCK, 1 << n.bit_length())
    if size not in _POWERS:
        _POWERS.clear()
        _POWERS[size] = powers(BASE, size), powers(UNBASE, size)
    return _POWERS[size]


def span_hash(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums of a rolling hash, and the factors that make a span's difference independent of its place."""
    up, down = power_tables(len(data) + 1)
    return np.concatenate((np.zeros(1, np.uint64), np.cumsum(BYTE_HASH[data] * up[: len(data)], dtype=np.uint64))), down


def runs_of(texts: list[bytes]) -> dict[str, np.ndarray]:
    """Runs of all texts: text index, number in the text, first window, windows, minimizer and content hash."""
    lens = np.fromiter(map(len, texts), np.int64, len(texts))
    starts = np.cumsum(lens) - lens
    data = np.frombuffer(b"".join(texts), np.uint8)
    n = len(data) - SPAN + 1
    if n <= 0:
        none = np.zeros(0, np.int64)
        return {k: none for k in ("text", "number", "first", "windows")} | {k: none.astype(np.uint64) for k in ("key", "content")}
    two = data.astype(np.uint16)
    two = two[:-1] | two[1:] << 8
    four = two.astype(np.uint32)
    four = (four[:-2] | four[2:] << 16).astype(np.uint64)
    eight = four[:-4] | four[4:] << np.uint64(32)
    m = len(data) - GRAM + 1
    h = eight[:m] * ODD[0]
    h ^= h >> np.uint64(32)
    h += eight[8 : 8 + m]
    h *= ODD[1]
    h ^= h >> np.uint64(29)
    h += four[16 : 16 + m]
    h *= ODD[2]
    h ^= h >> np.uint64(32)
    width, have = SPAN - GRAM + 1, 1
    while have < width:
        step = min(have, width - have)
        h = np.minimum(h[:-step], h[step:])
        have += step
    count = np.maximum(lens - SPAN + 1, 0)
    edges = np.zeros(n + 1, np.int8)
    live = count > 0
    edges[starts[live]] += 1
    edges[(starts + count)[live]] -= 1
    inside = np.cumsum(edges[:n], dtype=np.int8) > 0
    fresh = np.ones(n, bool)
    fresh[1:] = (h[1:] != h[:-1]) | ~inside[:-1]
    fresh[starts[live]] = True
    first = np.flatnonzero(fresh & inside)
    text = np.searchsorted(starts, first, side="right") - 1
    windows = np.minimum(np.append(first[1:], n + SPAN), (starts + count)[text]) - first
    if len(windows) and windows.max() > LONGEST_RUN:
        parts = -(-windows // LONGEST_RUN)
        nth = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        first, text = np.repeat(first, parts) + nth * LONGEST_RUN, np.repeat(text, parts)
        windows = np.minimum(np.repeat(windows, parts) - nth * LONGEST_RUN, LONGEST_RUN)
    prefix, down = span_hash(data)
    content = (prefix[first + windows + SPAN - 1] - prefix[first]) * down[first]
    content ^= content >> np.uint64(31)
    key = h[first] * ODD[0]
    key ^= key >> np.uint64(29)
    key *= ODD[1]
    return {"text": text, "number": np.arange(len(first)) - np.searchsorted(text, text), "first": first - starts[text], "windows": windows, "key": key, "content": content}


def _records(buckets: int):
    def work(batch: pa.RecordBatch) -> dict:
        texts = utf8(batch.column("text"))
        parts = []
        for lo, hi in blocks(texts, BLOCK):
            r = runs_of(texts[lo:hi])
            parts.append((r["text"] + lo, r["number"], r["key"], r["content"]))
        text, number, key, content = (np.concatenate(x) for x in zip(*parts))
        bucket = ((key >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)
        by = np.argsort(bucket, kind="stable")
        ids, sums = batch.column("doc_id").to_numpy(), batch.column("text_hash").to_numpy()
        out: dict[str, list] = {"bucket": [], "docs": [], "counts": [], "numbers": [], "keys": [], "contents": []}
        cuts = np.searchsorted(bucket[by], np.arange(buckets + 1))
        for b in np.flatnonzero(np.diff(cuts)).tolist():
            at = by[cuts[b] : cuts[b + 1]]
            rows, count = np.unique(text[at], return_counts=True)
            out["bucket"].append(b)
            out["docs"].append(np.stack([ids[rows], sums[rows]]).tobytes())
            out["counts"].append(count.astype(np.uint32).tobytes())
            out["numbers"].append(number[at].astype(np.uint32 if number[at].max() >> 16 else np.uint16).tobytes())
            out["keys"].append((key[at] & np.uint64(0xFFFFFFFF)).astype(np.uint32).tobytes())
            out["contents"].append(content[at].tobytes())
        return out

    return work


def _requests(limit: int):
    """Runs of a partition -> (doc_id, text_hash, ask), a row for each asked run: its number times four plus what is to be done."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fields = ("key", "content", "doc", "hash", "number")
        kept: list[dict[str, np.ndarray]] = []
        hot = np.zeros(0, np.uint64)

        def take(part: dict, rows: np.ndarray) -> dict:
            return {f: part[f][rows] for f in fields}

        def rows_out(part: dict, what: np.ndarray) -> pa.RecordBatch:
            asks = (part["number"] * 4 + what).astype(np.int32)
            return pa.RecordBatch.from_arrays([pa.array(part["doc"]), pa.array(part["hash"]), pa.array(asks)], names=["doc_id", "text_hash", "ask"])

        def fold(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal kept, hot
            part = {f: np.concatenate([k[f] for k in kept]) for f in fields}
            known = np.isin(part["key"], hot)
            if known.any():
                yield rows_out(take(part, known), np.full(known.sum(), BY_WINDOW))
                part = take(part, ~known)
            part = take(part, np.lexsort((part["doc"], part["content"], part["key"])))
            new_key = np.concatenate(([True], part["key"][1:] != part["key"][:-1]))
            new = new_key | np.concatenate(([True], part["content"][1:] != part["content"][:-1]))
            least = part["doc"][np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))]
            later = part["doc"] > least
            if later.any():
                yield rows_out(take(part, later), np.full(later.sum(), COVERED))
            part, new_key, new = take(part, ~later), new_key[~later], new[~later]
            heads = np.flatnonzero(new_key)
            if len(heads):
                contents = np.add.reduceat(new.astype(np.int64), heads)
                size = np.diff(np.append(heads, len(new)))
                many = contents > limit
                if many.any():
                    hot = np.union1d(hot, part["key"][heads[many]])
                    rows = np.repeat(many, size)
                    yield rows_out(take(part, rows), np.full(rows.sum(), BY_WINDOW))
                    part, contents, size = take(part, ~rows), contents[~many], size[~many]
                    heads = np.cumsum(size) - size
                if last and len(heads):
                    apart = np.minimum.reduceat(part["doc"], heads) != np.maximum.reduceat(part["doc"], heads)
                    rows = np.repeat((contents > 1) & apart, size)
                    yield rows_out(take(part, rows), np.full(rows.sum(), ASKED))
            kept = [part]

        for batch in batches:
            for r in batch.to_pylist():
                docs = np.frombuffer(r["docs"], np.int64).reshape(2, -1)
                count = np.frombuffer(r["counts"], np.uint32)
                n = int(count.sum())
                keys = np.frombuffer(r["keys"], np.uint32).astype(np.uint64) | np.uint64(r["bucket"]) << np.uint64(32)
                kept.append({"key": keys, "content": np.frombuffer(r["contents"], np.uint64), "doc": np.repeat(docs[0], count), "hash": np.repeat(docs[1], count), "number": np.frombuffer(r["numbers"], np.uint16 if len(r["numbers"]) == 2 * n else np.uint32).astype(np.int64)})
                if sum(len(k["doc"]) for k in kept[1:]) >= FOLD_RUNS:
                    yield from fold(False)
        if kept:
            yield from fold(True)

    return run


def ranges(first: np.ndarray, windows: np.ndarray) -> list[tuple[int, int]]:
    """Merged byte ranges that sorted windows cover."""
    out: list[list[int]] = []
    for a, w in zip(first.tolist(), windows.tolist()):
        b = a + w + SPAN - 1
        if out and a <= out[-1][1]:
            out[-1][1] = max(b, out[-1][1])
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _answers(batch: pa.RecordBatch) -> dict:
    """Documents with asks -> one row of covered ranges each, and a row for every piece: with a route it has to be sorted, without it is one window."""
    out: dict[str, list] = {k: [] for k in ("doc_id", "text_hash", "route", "at", "piece", "cuts")}
    ids, sums, asks = batch.column("doc_id").to_pylist(), batch.column("text_hash").to_pylist(), batch.column("asks")
    unpack = zstandard.ZstdDecompressor().decompress

    def add(i: int, **values) -> None:
        for k in out:
            out[k].append(values.get(k, ids[i] if k == "doc_id" else sums[i] if k == "text_hash" else None))

    packed = batch.column("packed").to_pylist()
    for i, z in enumerate(packed):
        text = unpack(z)
        r = runs_of([text])
        ask = np.sort(asks[i].values.to_numpy())
        number, what = ask >> 2, ask & 3
        first, windows = r["first"][number], r["windows"][number]
        whole = what == COVERED
        if whole.any():
            add(i, cuts=[x for pair in ranges(first[whole], windows[whole]) for x in pair])
        for n, w, a, c in zip(number.tolist(), what.tolist(), first.tolist(), windows.tolist()):
            if w == ASKED:
                add(i, route=int(r["key"][n].view(np.int64)), at=a, piece=text[a : a + c + SPAN - 1])
            elif w == BY_WINDOW:
                for k in range(a, a + c):
                    add(i, at=k, piece=text[k : k + SPAN])
    return out


def longest_previous(docs: np.ndarray, common: np.ndarray) -> np.ndarray:
    """Longest previous factor of each entry in suffix order: the longest prefix shared with an entry of a smaller document.

    ``common[i]`` is the prefix shared by entries i - 1 and i. The nearest entry of a smaller document before and behind is
    found by jumping along earlier candidates, with the least common prefix on the way.
    """

    def side(doc: np.ndarray, shared: np.ndarray) -> np.ndarray:
        n = len(doc)
        to, least = np.arange(-1, n - 1), shared.copy()
        live = np.flatnonzero((to >= 0) & (least >= SPAN))
        least[:1] = 0
        while len(live := live[doc[to[live]] >= doc[live]]):
            step = to[live]
            least[live] = np.minimum(least[live], least[step])
            to[live] = to[step]
            least[live[to[live] < 0]] = 0
            live = live[(to[live] >= 0) & (least[live] >= SPAN)]
        return least

    if not len(docs):
        return common
    behind = side(docs[::-1], np.concatenate(([0], common[:0:-1])))[::-1]
    return np.maximum(side(docs, common), behind)


def _sorted_pieces(table: pa.Table) -> pa.Table:
    """Pieces of a partition -> (doc_id, text_hash, cuts): ranges of the windows with an earlier match."""
    pieces = table.column("piece").to_pylist()
    lens = np.fromiter(map(len, pieces), np.int64, len(pieces))
    data = np.frombuffer(b"".join(pieces) + bytes(8), np.uint8)
    count = lens - SPAN + 1
    starts = np.cumsum(lens) - lens
    owner = np.repeat(np.arange(len(pieces)), count)
    at = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + starts[owner]
    docs = table.column("doc_id").to_numpy()[owner]
    wide = data[:-7].astype(np.uint64)
    for k in range(1, 8):
        wide = wide << np.uint64(8) | data[k : len(data) - 7 + k]
    words = [wide[at + 8 * k] for k in range(SPAN // 8)] + [wide[at + 8 * (SPAN // 8)] >> np.uint64(64 - 8 * (SPAN % 8))]
    order = np.lexsort(words[::-1])
    common = np.zeros(len(order), np.int64)
    same = np.ones(max(0, len(order) - 1), bool)
    for k, w in enumerate(words):  # common prefix in whole words, which is all that matters under SPAN
        same &= w[order[1:]] == w[order[:-1]]
        common[1:][same] = min(8 * (k + 1), SPAN)
    hit = np.zeros(len(order), bool)
    hit[order] = longest_previous(docs[order], common) >= SPAN
    where = np.flatnonzero(hit)
    fresh = np.concatenate(([True], (where[1:] != where[:-1] + 1) | (owner[where[1:]] != owner[where[:-1]]))) if len(where) else np.zeros(0, bool)
    heads = np.flatnonzero(fresh)
    size = np.diff(np.append(heads, len(where)))
    piece = owner[where[heads]]
    first = table.column("at").to_numpy()[piece] + at[where[heads]] - starts[piece]
    flat = np.stack([first, first + size + SPAN - 1], axis=1).reshape(-1).astype(np.int32)
    cuts = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, 2, dtype=np.int32)), pa.array(flat))
    return pa.table({"doc_id": table.column("doc_id").take(pa.array(piece)), "text_hash": table.column("text_hash").take(pa.array(piece)), "cuts": cuts})


def find_repeats(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """``docs(doc_id, text)`` -> (doc_id, text_hash, cuts): unmerged byte ranges to remove, flat (start, end, ...), of each
    document that has some. ``text_hash`` tells rows apart that have one id and different texts."""
    docs = docs.where("doc_id is not null")
    total = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    buckets = max(1, math.ceil(total / BUCKET_BYTES))
    keyed = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")
    records = map_rows(keyed, "bucket int, docs binary, counts binary, numbers binary, keys binary, contents binary", _records(buckets))
    asks = records.repartitionById(buckets, F.col("bucket")).mapInArrow(_requests(hot), "doc_id bigint, text_hash bigint, ask int")
    asks = materialize(asks, "asks").groupBy("doc_id", "text_hash").agg(F.collect_list("ask").alias("asks"))
    answers = map_rows(asks.join(_packed(keyed), ["doc_id", "text_hash"]), "doc_id bigint, text_hash bigint, route bigint, at int, piece binary, cuts array<int>", _answers)
    answers = materialize(answers, "answers")
    pieces = answers.where("route is not null").select("doc_id", "text_hash", "route", "at", "piece")
    windows = answers.where("piece is not null and route is null").select("doc_id", "text_hash", "at", "piece")
    first = windows.groupBy("piece").agg(F.min("doc_id").alias("first_doc"))
    later = windows.join(first, "piece").where("doc_id > first_doc").select("doc_id", "text_hash", F.array("at", F.col("at") + SPAN).alias("cuts"))
    groups = max(1, math.ceil((pieces.agg(F.sum(F.octet_length("piece"))).first()[0] or 0) / SORT_BYTES))
    found = pieces.withColumn("group", F.pmod(F.xxhash64("route"), F.lit(groups))).groupBy("group").applyInArrow(_sorted_pieces, "doc_id bigint, text_hash bigint, cuts array<int>")
    every = answers.where("cuts is not null").select("doc_id", "text_hash", "cuts").unionByName(found).unionByName(later)
    return every.groupBy("doc_id", "text_hash").agg(F.flatten(F.collect_list("cuts")).alias("cuts"))


def _packed(keyed: DataFrame) -> DataFrame:
    """(doc_id, text_hash, packed): compressed texts, so that a trip through a shuffle costs less disk."""

    def work(batch: pa.RecordBatch) -> dict:
        pack = zstandard.ZstdCompressor(3).compress
        return {"doc_id": batch.column(0), "text_hash": batch.column(1), "packed": [pack(t) for t in utf8(batch.column(2))]}

    return map_rows(keyed.select("doc_id", "text_hash", "text"), "doc_id bigint, text_hash bigint, packed binary", work)


def remove_repeats(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """(doc_id, n_bytes, spans, kept): removed byte ranges (flat, merged) and the bytes that are left, of every row.

    Matches never cross documents, and strings are judged on the input. A null text is empty. Rows with a null id keep their
    text whole and take nothing from others; repeated rows of one id are one document and give equal rows.
    """
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    keyed = rows.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    joined = _packed(keyed).join(find_repeats(rows, hot), ["doc_id", "text_hash"], "left")

    def work(batch: pa.RecordBatch) -> dict:
        unpack = zstandard.ZstdDecompressor().decompress
        texts = [unpack(z) for z in batch.column("packed").to_pylist()]
        spans, kept = [], []
        for text, cuts in zip(texts, batch.column("cuts")):
            merged = []
            if cuts.is_valid:
                pairs = cuts.values.to_numpy().reshape(-1, 2).astype(np.int64)
                pairs = pairs[np.argsort(pairs[:, 0], kind="stable")]
                merged = ranges(pairs[:, 0], pairs[:, 1] - pairs[:, 0] - SPAN + 1)
            ends = [0, *[x for pair in merged for x in pair], len(text)]
            spans.append(ends[1:-1])
            kept.append(b"".join(text[a:b] for a, b in zip(ends[::2], ends[1::2])))
        return {"doc_id": batch.column("doc_id"), "n_bytes": [len(t) for t in texts], "spans": spans, "kept": kept}

    return map_rows(joined, "doc_id bigint, n_bytes bigint, spans array<bigint>, kept binary", work)


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(read(spark, sf_dir, "documents"))
    removed = F.col("n_bytes") - F.octet_length("kept")
    return out.select("doc_id", "n_bytes", removed.cast("bigint").alias("n_removed"), (F.size("spans") / 2).cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


OP2_SQL = f"""
with d as (select doc_id, hex(encode(coalesce(text, ''))) as h, octet_length(encode(coalesce(text, ''))) as n from documents),
     w as (select doc_id, i, substr(h, 2 * i + 1, {2 * SPAN}) as s from (select doc_id, h, unnest(range(n - {SPAN - 1})) as i from d where n >= {SPAN})),
     f as (select s, min(doc_id) as first_doc from w group by s),
     hit as (select doc_id, i from w join f using (s) where first_doc < doc_id),
     gap as (select doc_id, i, lag(i) over (partition by doc_id order by i) as before from hit),
     run as (select doc_id, i, sum(case when before is null or i > before + {SPAN} then 1 else 0 end) over (partition by doc_id order by i) as g from gap),
     span as (select doc_id, min(i) as a, max(i) + {SPAN} as b from run group by doc_id, g),
     piece as (select doc_id, a, b, coalesce(lag(b) over (partition by doc_id order by a), 0) as done from span),
     kept as (select doc_id, count(*) as n_spans, sum(b - a) as n_removed, string_agg(substr(h, 2 * done + 1, 2 * (a - done)), '' order by a) || substr(any_value(h), 2 * max(b) + 1) as h
              from piece join d using (doc_id) group by doc_id)
select d.doc_id, cast(d.n as bigint) as n_bytes, cast(coalesce(n_removed, 0) as bigint) as n_removed, coalesce(n_spans, 0) as n_spans, sha256(unhex(coalesce(kept.h, d.h))) as kept_sha256
from d left join kept using (doc_id)
"""
