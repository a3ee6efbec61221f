"""Byte codec, hard negatives and lexical search against the library or slow plain-Python versions, and on odd inputs."""

import base64
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import SCHEMA, odd_rows, prose

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# -- 11


@pytest.fixture(scope="module")
def library():
    import public_tokenizers
    import tiktoken
    from tessella.llm.byte_codec import default_ranks

    with open(default_ranks(), "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_byte_codec_equals_library(library):
    from tessella.llm.byte_codec import ByteCodec, default_ranks

    r = random.Random(1)
    parts = ["a", "b", "ab", "the", " ", "  ", "\n", "\t", "é", "日", "😀", "=", "\x00", "ing", "aaaa", "'s", "'ll", "0", "12", "     ", " ", "　", "\x1c", "\x85", "<|endoftext|>", "zq"]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 60))) for _ in range(3000)] + [f"{chr(c)}a {chr(c)}" for c in range(0, 0x110000, 11) if not 0xD800 <= c < 0xE000]
    texts += [" " * k + x for k in range(80) for x in ("", "a")] + ["x" * k for k in range(1, 1500, 97)] + ["abcab" * k for k in range(1, 400, 37)] + ["".join(r.choice("abcdexyzthe") for _ in range(k)) for k in range(400, 1200, 97)]
    texts += ["x" * 20_000, " " * 20_001, "日本語中文字" * 1000, "".join(chr(r.randint(0x4E00, 0x9FFF)) for _ in range(4000)), "ab" * 5000 + "c", None]
    model = ByteCodec(default_ranks())
    ids, offsets = model.encode(texts)
    assert [ids[a:b].tolist() for a, b in zip(offsets, offsets[1:])] == library.encode_ordinary_batch([t or "" for t in texts])
    assert model.decode(ids, offsets) == [(t or "").encode() for t in texts]
    odd_ids = [[r.randint(0, 50_255) for _ in range(r.randint(0, 12))] for _ in range(500)]
    assert model.decode(np.array(sum(odd_ids, [])), np.cumsum([0, *map(len, odd_ids)])) == [library.decode_bytes(x) for x in odd_ids]
    with pytest.raises(ValueError):
        model.decode(np.array([50_256]), np.array([0, 1]))


def test_pair_table_holds_colliding_keys():
    from tessella.llm.byte_codec import NEVER, PairTable

    r = np.random.default_rng(4)
    pairs = np.unique(r.integers(0, 60, (1500, 2)).astype(np.int32), axis=0)
    table = PairTable(pairs[:, 0], pairs[:, 1], np.arange(len(pairs), dtype=np.int32))
    assert (table(pairs[:, 0], pairs[:, 1]) == np.arange(len(pairs))).all()
    assert (table(pairs[:, 0] + 60, pairs[:, 1]) == NEVER).all() and (table(np.full(3, -1, np.int32), np.arange(3, dtype=np.int32)) == NEVER).all()


# -- 12


def mined(rows, every=10, keep=(5, 10)):
    """(vec_id, label, embedding) rows -> expected result rows."""
    points = set()
    for i, label, e in rows:
        if i is not None and label is not None and e is not None and all(x is not None and math.isfinite(x) and abs(256 * x) < (1 << 25) - 1 for x in e):
            points.add((i, label, tuple(math.floor(256 * float(x)) for x in e)))
    out = []
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    for i, label, v in points:
        if i % every:
            continue
        pos = sorted((-dot(v, w), j) for j, k, w in points if k == label and j != i)[: keep[0]]
        for s, p in pos:
            neg = sorted((-dot(v, w), j) for j, k, w in points if k != label and 30 * -s <= 100 * dot(v, w) <= 90 * -s)[: keep[1]]
            out += [(i, p, n + 1, j, -s, -t) for n, (t, j) in enumerate(neg)]
    return sorted(out)


def vectors(seed: int, n: int, dim: int = 6, labels: int = 4):
    r = random.Random(seed)
    centers = [[r.gauss(0, 1) for _ in range(dim)] for _ in range(12)]
    rows = [(i, r.randrange(labels), [float(np.float32(x + r.gauss(0, 0.05))) for x in r.choice(centers)]) for i in range(n)]
    same = rows[3][2]
    return rows + [(n + i, i % labels, same) for i in range(n // 3)]  # a common vector


ODD_VECTORS = [(None, 1, [0.5] * 6), (9000, None, [0.5] * 6), (9001, 1, None), (9002, 1, [0.5, None] + [0.1] * 4), (9010, 1, [float("nan")] * 6), (9020, 1, [float("inf")] * 6), (9030, 2, [1e30] * 6), (9040, 2, []), (9050, 3, [0.5, 0.25]), (9060, 1, [0.0] * 6)]
EMBEDDINGS = "vec_id bigint, label int, embedding array<float>"


@pytest.mark.parametrize("sizes", [{}, {"SHARD_ROWS": 40, "BLOCK_ANCHORS": 3, "STRIPE_SHARDS": 2, "GROUP_BLOCKS": 2, "LEAF": 4}])
def test_hard_negatives(spark, sizes, monkeypatch):
    from tessella.llm import hard_negatives as op

    for name, value in sizes.items():
        monkeypatch.setattr(op, name, value)
    rows = vectors(5, 300) + ODD_VECTORS
    rows += rows[:20] + [(10, 1, [0.25] * 6)]  # repeated rows, an id with two vectors
    df = spark.createDataFrame(rows, EMBEDDINGS).withColumns({c: F.lit("own") for c in ("key", "part", "class", "rank", "score", "vec")}).repartition(4)
    out = op.mine(op.fixed_points(df), F.col("vec_id") % 10 == 0)
    assert out.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert sorted(map(tuple, out.collect())) == mined(rows)


def test_hard_negatives_of_no_rows(spark):
    from tessella.llm import hard_negatives as op

    for rows in ([], [(7, 1, [1.0])], [(i, 1, [1.0, 2.0]) for i in range(30)]):
        assert op.mine(op.fixed_points(spark.createDataFrame(rows, EMBEDDINGS)), F.col("vec_id") % 10 == 0).count() == 0


def test_cover_tree_covers_and_prunes():
    from tessella.llm.hard_negatives import LEAST, MOST, CoverTree, Rows

    r = np.random.default_rng(2)
    centers = r.normal(0, 200, (30, 16))
    points = (centers[r.integers(0, 30, 1500)] + r.normal(0, 8, (1500, 16))).astype(np.int32)
    tree = CoverTree.build(np.arange(1500), np.zeros(1500, np.int64), points)
    extra = np.sqrt(tree.longest - tree.squares)
    full = np.concatenate([tree.points, extra[:, None]], axis=1)
    for c, radius, lo, hi, child, children in zip(tree.center, tree.radius, tree.lo, tree.hi, tree.child, tree.children):
        assert lo <= c < hi and (np.linalg.norm(full[lo:hi] - full[c], axis=1) <= radius + 1e-6).all()
        if children:
            kids = full[tree.center[child : child + children]]
            apart = np.linalg.norm(kids[:, None] - kids[None], axis=2)[np.triu_indices(children, 1)]
            assert tree.lo[child] == lo and tree.hi[child + children - 1] == hi and (apart > radius / 2 - 1).all()
    assert (np.sort(tree.ids) == np.arange(1500)).all()
    queries = points[:40]
    base = {"anchors": np.arange(40) + 10_000, "keys": np.arange(40), "anchor_labels": np.ones(40, np.int64), "queries": queries, "of": np.arange(40), "positive": np.zeros(40, np.int64), "positive_score": np.zeros(40, np.int64)}
    exact = queries.astype(np.int64) @ points.T.astype(np.int64)
    for top in (MOST, int(np.median(exact))):
        rows = Rows(5, False, least=np.full(40, LEAST + 1), most=np.full(40, top), **base)
        rows.search(tree)
        for q in range(40):
            want = sorted((-int(s), i) for i, s in enumerate(exact[q]) if s <= top)[:5]
            assert list(zip((-rows.score[q]).tolist(), rows.found[q].tolist())) == want
        assert rows.visited < 0.5 * exact.size, "outside nodes are left out"


# -- 13


def ranked(docs, items, top=20):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
    held = [(i, Counter(words(t))) for i, t in docs]
    held = [(i, c, sum(c.values())) for i, c in held if c]
    n_docs, total = len(held), sum(n for _, _, n in held)
    df = Counter(t for _, c, _ in held for t in c)
    out = []
    for name, text in set(items):
        want, scores = Counter(words(text)), []
        for i, c, n in held:
            m = 75 + 25 * n * n_docs // total
            s = sum(k * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 12 * m)) for t, k in want.items() if t in c)
            if s > 0:
                scores.append((-s, i is None, i or 0))
        out += [(name, k + 1, None if none else i, -s) for k, (s, none, i) in enumerate(sorted(scores)[:top])]
    return sorted(out, key=str)


@pytest.mark.parametrize("sizes", [{}, {"PASS_BYTES": 400, "TREE_BYTES": 3000, "CELLS": 500, "FAN": 2}, {"LEAF_DOCS": 1, "LEAF_ITEMS": 1}])
def test_lexical_search(spark, sizes, monkeypatch):
    from tessella.llm import lexical as op

    for name, value in sizes.items():
        monkeypatch.setattr(op, name, value)
    r = random.Random(9)
    items = [(i, prose(100 + i, r.randint(1, 30))) for i in range(25)] + [(30, None), (31, " ! "), (None, prose(300, 12)), (2, prose(102, 10)), (3, "ba BA ba ke Émile 7x"), (3, "ba BA ba ke Émile 7x")]
    docs = [r[:2] for r in odd_rows() if len(r[1] or "") < 100_000] + [(100 + i, " ".join(r.choice([prose(400 + i, 9), r.choice(items)[1] or "", "X, y-Z"]) for _ in range(r.randint(0, 8)))) for i in range(200)]
    docs += docs[:30]
    df = spark.createDataFrame(docs, "doc_id bigint, text string").withColumns({c: F.lit("own") for c in ("item", "score", "rank", "lot")}).repartition(3)
    out = op.rank_documents(df, spark.createDataFrame(items, "item_id bigint, text string"))
    assert sorted(map(tuple, out.collect()), key=str) == ranked(docs, items)


def test_lexical_search_of_no_rows(spark, odd, empty):
    from tessella.llm.lexical import rank_documents

    bench = spark.createDataFrame([(1, "word"), (2, None)], "item_id bigint, text string")
    assert rank_documents(empty, bench).count() == 0 and rank_documents(odd, bench.where("false")).count() == 0
    assert rank_documents(odd.where("text is null"), bench).count() == 0
    assert [r.doc_id for r in rank_documents(odd, bench).orderBy("rank").collect()] == [10, 11]


def test_batches_are_dropped():
    from tessella.llm.lexical import Items, Search

    r = random.Random(3)
    topics = [[f"t{k}w{i}" for i in range(60)] for k in range(12)]
    texts = [" ".join(r.choice(t) for _ in range(40)).encode() for t in topics for _ in range(60)]
    r.shuffle(texts)
    items = Items(list(range(12)), [" ".join(t[:15]).encode() for t in topics])
    df = Counter(items.vocab[w] for t in texts for w in set(t.decode().split()) if w.encode() in items.vocab for w in [w.encode()])
    search = Search(items.weighted(len(texts), 40 * len(texts), df), 20)
    search.add(np.arange(len(texts)), texts)
    assert search.scored < 0.3 * 12 * len(texts)


# -- odd rows


def test_odd_texts(spark, odd, clashing, empty, library):
    from tessella.llm import byte_codec

    want = Counter(((r[0], len(library.encode_ordinary(r[1] or ""))) for r in odd_rows()))
    for df in (odd, clashing):
        assert Counter((r.doc_id, r.n_tokens) for r in byte_codec.digest(df).collect()) == want
        back = byte_codec.decode(byte_codec.encode(df.withColumn("byte_ids", F.lit("own"))).withColumn("decoded", F.lit("own")))
        assert Counter((r.doc_id, bytes(r.decoded)) for r in back.collect()) == Counter((r[0], (r[1] or "").encode()) for r in odd_rows())
    assert byte_codec.digest(empty).count() == 0 and SCHEMA
