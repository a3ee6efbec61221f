"""The operators against slow plain-Python versions of their contracts."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tests.llm.conftest import SCHEMA, odd_rows, prose

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def distinct_ids(rows):
    """The rows without the second text of an id, in the order of ids."""
    return sorted({r[0]: r for r in reversed(rows) if r[0] is not None}.values())


# -- 2


def repeats(rows, span=50):
    first: dict[bytes, int] = {}
    for i, t in sorted(rows):
        for k in range(len(t) - span + 1):
            first.setdefault(t[k : k + span], i)
    out = {}
    for i, t in rows:
        gone = bytearray(len(t))
        for k in range(len(t) - span + 1):
            if first[t[k : k + span]] < i:
                gone[k : k + span] = b"\1" * span
        kept = bytes(c for c, g in zip(t, gone) if not g)
        out[i] = (len(t), sum(gone), len(re.findall(rb"\x01+", bytes(gone))), sha(kept))
    return out


def span_rows(out):
    return {r.doc_id: (r.n_bytes, r.n_bytes - len(r.kept), len(r.spans) // 2, sha(bytes(r.kept))) for r in out.collect()}


@pytest.mark.parametrize("hot", [1, 4096])
def test_suffix_dedup(spark, hot):
    from tessella.llm.suffix_dedup import remove_repeats

    r = random.Random(3)
    passages = [prose(s, 12) for s in range(4)]
    rows = [(i, " ".join(r.choice([prose(50 + i, 15), *passages, "ab" * r.randint(0, 150)]) for _ in range(r.randint(0, 6)))) for i in range(60)]
    rows += [(100, rows[5][1]), (101, "ünï" * 40), (102, "ünï" * 40 + "x"), (103, "a" * 49), (104, "a" * 50), (105, "a" * 3000), (106, "")]
    got = span_rows(remove_repeats(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5), hot))
    assert got == repeats([(i, t.encode()) for i, t in rows])


# -- 3


def test_host_rules_measures():
    from tessella.llm.host_rules import measure

    r = random.Random(5)
    for _ in range(300):
        t = "".join(r.choice(["a", "b", "ab", " ", "\n", "\t", "é", "\x0b", "#", "<", "\x1f"]) for _ in range(r.randint(0, 80)))
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        hit = {j for i, g in enumerate(grams) if grams.count(g) > 1 for j in range(i, i + 3)}
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        assert measure(t.encode()) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(hit))


def test_host_verdict_shrinks_small_hosts(spark):
    from tessella.llm.host_rules import apply_rules

    rows = [(i, "too short", "bad") for i in range(40)] + [(100 + i, prose(i, 60), "good") for i in range(40)] + [(200, "short", "tiny"), (201, prose(9, 60), "bad")]
    kept = {r.doc_id: r.kept for r in apply_rules(spark.createDataFrame(rows, "doc_id bigint, text string, source string")).collect()}
    assert all(kept[100 + i] for i in range(40)) and not kept[201] and not kept[200]


# -- 4


def test_sentencepiece_equals_library():
    import sentencepiece
    from tessella.llm.piece_codec import PieceCodec, default_model

    model, sp = PieceCodec(default_model()), sentencepiece.SentencePieceProcessor(model_file=default_model())
    r = random.Random(1)
    parts = ["a", "b", "ab", "the", " ", "  ", "\n", "\t", "é", "▁", "日", "😀", "=", "\x00", "ing", "aaaa", "ｆ", "�", "0", " " * 5, "𝒳", "__"]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 60))) for _ in range(3000)] + [" " * k + x for k in range(60) for x in ("", "a", "the")] + ["x" + " " * k + "the" for k in range(70)] + ["a" * k for k in range(60)]
    ids, offsets = model.encode(texts)
    assert [ids[a:b].tolist() for a, b in zip(offsets, offsets[1:])] == sp.encode(texts)
    assert model.decode(ids, offsets) == sp.decode(sp.encode(texts))
    odd_ids = [[r.randint(0, 400) for _ in range(r.randint(0, 12))] for _ in range(2000)]
    assert model.decode(np.array(sum(odd_ids, [])), np.cumsum([0, *map(len, odd_ids)])) == [sp.decode(x) for x in odd_ids]


# -- 5


def test_quotes_link_to_originals(spark):
    from tessella.llm.quotes import parse, reply_order

    assert parse("hi\nOn Monday Ann wrote:\n> one two\n>> three\nbye")[0] == "hi\nbye"
    talk = [
        (1, 0, "user", "How do I bake bread at home?\n\nI have no oven."), (1, 1, "user", "What about rice and beans tonight?"),
        (1, 2, "assistant", "> How do I bake bread\n> at home?\nUse a pan."), (1, 3, "assistant", "> What about rice and  BEANS tonight?\nGood idea."),
        (1, 4, "user", "> Use a pan.\n>> How do I bake bread at home?\nThanks!"), (2, 0, "user", "> Use a pan.\nno such source"), (2, 1, None, None), (None, 0, "user", "x"), (2, 1, None, None),
    ]
    rows = reply_order(spark.createDataFrame(talk, "conv_id bigint, turn bigint, role string, text string")).collect()
    got = {(r.conv_id, r.turn): r for r in rows}
    assert len(rows) == len(talk)
    assert [got[1, t].parent_turn for t in range(5)] == [None, None, 0, 1, 2] and [got[1, t].root_turn for t in range(5)] == [0, 1, 0, 1, 0]
    assert [got[1, t].depth for t in range(5)] == [0, 0, 1, 1, 2] and [got[1, t].position for t in range(5)] == [1, 4, 2, 5, 3]
    assert got[1, 4].own == "Thanks!" and (got[1, 4].n_quotes, got[1, 4].n_linked) == (2, 2)
    assert got[2, 0].n_linked == 0 and got[2, 0].own == "no such source" and got[2, 1].own == ""


def test_long_reply_chain(spark):
    from tessella.llm.quotes import reply_order

    talk = [(1, 0, "user", "message number 0 here")] + [(1, t, "user", f"> message number {t - 1} here\nmessage number {t} here") for t in range(1, 40)]
    got = {r.turn: r for r in reply_order(spark.createDataFrame(talk, "conv_id bigint, turn bigint, role string, text string")).collect()}
    assert all((got[t].root_turn, got[t].depth, got[t].position) == (0, t, t + 1) for t in range(40))


# -- 7

KINDS = ("email", "ip", "card", "phone")


def strict(t: str) -> str:
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = [int(c) for c in re.sub("[^0-9]", "", m[0])][::-1]
        if 14 <= len(d) <= 19 and sum(x if i % 2 == 0 else 2 * x - 9 * (x > 4) for i, x in enumerate(d)) % 10 == 0:
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(out))


def test_strict_spans(spark):
    from tessella.llm import pii

    r = random.Random(2)
    parts = ["1", "25", "300", ".", ".", "@", "a", "b.c", "+", "-", " ", "(", ")", "_", "😀", "é", "4111111111111111", "1.2.3.4", "x@y.z", "+1 (988) 555-2485", "%"]
    texts = dict(enumerate(["".join(r.choice(parts) for _ in range(r.randint(0, 40))) for _ in range(1500)] + ["7" * 50_000, "a" * 50_000 + "@", "+1" + "(" * 50_000, "1.2.3.4.5.6.7.8"]))
    df = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    got = {x.doc_id: x.b for x in df.select("doc_id", pii.listed(pii.strict_spans(F.col("text"))).alias("b")).collect()}
    assert all(got[i] == strict(t) for i, t in texts.items())


def test_redaction_and_added_spans(spark):
    from tessella.llm import pii

    rows = [(i, f"call 4111111111111111 or mail a{i}@b.com and 10.0.0.{i % 250}, not 999.1.1.1 or 4111111111111112") for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert {r.text for r in pii.redact(df).collect()} == {"call <CARD> or mail <EMAIL> and <IP>, not 999.1.1.1 or 4111111111111112"}
    assert all(pii.listed(F.col("base")) is not None and not r.added for r in pii.find_spans(df).collect())



CARDS = ["4111111111111111", "5500005555555559", "4012888888881881", "4465758382889437"]


def test_glued_cards_and_phones_are_added(spark):
    """Neighbours whose joint match fails its check are found one by one, and redacted; odd stretches of them are not."""
    from tessella.llm import pii

    plain = [(i, f"paid with {CARDS[i % 4]} by ana{i}@mail.example.com phone +1 (826) 555-{4000 + i} at home, order 1234 5678 12") for i in range(80)]
    glued = {
        1000: (f"paid with {CARDS[0]} {CARDS[1]} today", ["2:10:26", "2:27:43"]),
        1001: (f"paid with {CARDS[2]} {CARDS[3]} {CARDS[0]} today", ["2:10:26", "2:27:43", "2:44:60"]),
        1002: ("phone +1 (826) 555-4081 22 33 44 56 now", ["3:6:23"]),
        1003: ("phone +1 (826) 555-4081 190.137.223.204 now", ["3:6:23"]),
        1004: ("numbers " + " ".join(str(n) for n in range(100, 400)) + " end", []),
        1005: ("token 8c9b45435718dcc700c184a7 and 1.2.3.4444 and 12.5.2020", []),
    }
    df = spark.createDataFrame(plain + [(i, t) for i, (t, _) in glued.items()] * 7, "doc_id bigint, text string").repartition(3)
    got = pii.find_spans(df).collect()
    assert len(got) == 80 + 7 * len(glued)
    for row in got:
        spans = [f"{x['k']}:{x['s']}:{x['e']}" for x in row.added]
        assert spans == (glued[row.doc_id][1] if row.doc_id in glued else []), row.doc_id
    clean = {r.doc_id: r.text for r in pii.redact(df).collect()}
    assert clean[1001] == "paid with <CARD> <CARD> <CARD> today"
    assert clean[1003] == "phone <PHONE> <IP> now"


def stretches(t: str) -> set:
    """Valid stretches of digit groups, from the rules read one by one."""
    out = set()
    for m in re.finditer(r"\+?[0-9](?:[ ().+-]{0,3}[0-9]){3,}", t):
        groups = [(m.start() + g.start(), m.start() + g.end()) for g in re.finditer("[0-9]+", m[0])]
        for i, (a, _) in enumerate(groups):
            for j in range(i, len(groups)):
                v, s = t[a : groups[j][1]], a
                d = [int(c) for c in v if c.isdigit()]
                if len(d) > 19:
                    break
                luhn = sum(x if n % 2 == 0 else 2 * x - 9 * (x > 4) for n, x in enumerate(d[::-1])) % 10 == 0
                kind = None
                if s > m.start() and t[s - 1] == "+" and 10 <= len(d) <= 15:
                    kind, s = 3, s - 1
                elif re.fullmatch(r"[0-9]+(\.[0-9]+){3}", v) and all(int(x) <= 255 for x in v.split(".")):
                    kind = 1
                elif len(d) >= 14 and luhn and re.fullmatch(r"[0-9](?:[ -]{0,2}[0-9])*", v):
                    kind = 2
                if kind is not None:
                    out.add((kind, s, groups[j][1]))
    return out


def test_candidate_stretches(spark):
    from tessella.llm import pii

    r = random.Random(9)
    parts = ["1", "25", "7", ".", ".", "+", "-", " ", " ", "(", ")", "x", "😀", "41", "4111111111111111", "1.2.3.4", "+1 (988) 555-2485", "555", "2485"]
    texts = dict(enumerate(["".join(r.choice(parts) for _ in range(r.randint(0, 60))) for _ in range(1200)] + ["1 " * 4000, "12-34 " * 500]))
    df = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string").repartition(8)
    c = pii.candidates(F.col("text"), pii.strict_spans(F.col("text")))
    rows = df.select("doc_id", c.alias("c")).collect()
    assert all(sorted((x["kind"], x["s"], x["e"]) for x in row.c) == sorted(stretches(texts[row.doc_id])) for row in rows)


# -- 8


def leaks(docs, items, size=10):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
    grams: dict[tuple, set] = {}
    for i, t in items:
        w = words(t)
        n = min(size, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            grams.setdefault(tuple(w[k : k + n]), set()).add("" if i is None else str(i))
    out = []
    for i, t in docs:
        w, hit, names = words(t), set(), set()
        for n in {len(g) for g in grams}:
            for k in range(len(w) - n + 1):
                if g := grams.get(tuple(w[k : k + n])):
                    hit |= set(range(k, k + n))
                    names |= g
        out.append((i, len(w), len(hit), sorted(names)))
    return sorted(out, key=str)


@pytest.mark.parametrize("pass_bytes", [1 << 20, 300])
def test_fm_index_decontamination(spark, pass_bytes, monkeypatch):
    from tessella.llm import decontam

    monkeypatch.setattr(decontam, "PASS_BYTES", pass_bytes)
    r = random.Random(8)
    items = [(i, prose(100 + i, n)) for i, n in enumerate([3, 9, 10, 11, 25, 40, 1])] + [(30, None), (31, " ! "), (None, prose(300, 12)), (2, prose(102, 10)), (33, prose(103, 11))]
    docs = [(i, " ".join(r.choice([prose(400 + i, 5), (r.choice(items)[1] or ""), "X, y-Z"]) for _ in range(r.randint(0, 8)))) for i in range(80)] + [(1, None), (2, ""), (3, prose(105, 40).upper())]
    found = decontam.find_leaks(spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3), spark.createDataFrame(items, "item_id bigint, text string"))
    got = sorted(((x.doc_id, x.n_words, sum(s.b - s.a for s in x.leak_spans), x.leak_items) for x in found.collect()), key=str)
    assert got == leaks(docs, items)


def test_fm_index_rank_and_locate():
    from tessella.llm.decontam import FMIndex

    seq = np.random.default_rng(3).integers(1, 5, 400)
    seq[100:200] = seq[200:300]
    index = FMIndex(seq, 5)
    for size in (1, 2, 3, 6):
        patterns = np.stack([seq[i : i + size] for i in range(0, 390, 7)])
        lo, hi = index.search(patterns)
        for p, a, b in zip(patterns, lo, hi):
            assert sorted(index.locate(np.arange(a, b))) == [i for i in range(len(seq) - size + 1) if (seq[i : i + size] == p).all()]


def test_leaks_are_cut(spark):
    from tessella.llm.decontam import remove_leaks

    item = prose(7, 12)
    docs = spark.createDataFrame([(1, f"keep this, {item.upper()}! and that", 99), (2, "clean text", 10), (3, None, None)], "doc_id bigint, text string, n_chars int")
    got = {r.doc_id: r for r in remove_leaks(docs, spark.createDataFrame([(1, item)], "item_id bigint, text string")).collect()}
    assert got[1].text == "keep this, ! and that" and got[1].n_chars == 21 and got[2].text == "clean text" and got[3].text is None


# -- 9


def test_differencing_balances_and_keeps_groups(spark, monkeypatch):
    from tessella.llm import sharding

    monkeypatch.setattr(sharding, "BLOCK_GROUPS", 50)
    monkeypatch.setattr(sharding, "FAN", 3)
    r = random.Random(4)
    rows = [(i, prose(i % 700, r.randint(1, 60)) if i % 3 else f"copy {i % 50}") for i in range(1500)] + [(2000, None), (2001, ""), (2000, None)]
    out = sharding.shard_documents(spark.createDataFrame(rows, "doc_id bigint, text string"), 7).toPandas()
    assert len(out) == len(rows)
    sums = out.groupby("shard")["size"].sum()
    assert sums.max() - sums.min() <= 40 and len(sums) == 7
    by = {}
    texts = dict(rows)
    for d, s in zip(out.doc_id, out.shard):
        by.setdefault(texts[d] or "", set()).add(s)
    assert all(len(s) == 1 for s in by.values())
    for _, g in out.groupby("shard"):
        assert sorted(g.slot) == list(range(len(g)))
    assert all(zlib.crc32((texts[d] or "").encode()) == c and len((texts[d] or "").encode()) + 16 == n for d, c, n in zip(out.doc_id, out.text_crc32, out["size"]))


# -- 10


def simhash(t):
    w = (t or "").translate(LOWER).encode().split()
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 3]), 42) for i in range(max(1, len(w) - 2))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def linked(prints: dict[int, int]) -> dict[int, int]:
    group = {i: i for i in prints}
    ids = sorted(prints)
    changed = True
    while changed:
        changed = False
        for a in ids:
            for b in ids:
                if (prints[a] ^ prints[b]).bit_count() <= 2 and group[a] != group[b]:
                    group[a] = group[b] = min(group[a], group[b])
                    changed = True
    return group


@pytest.mark.parametrize("bucket_rows", [256, 2])
def test_simhash_groups(spark, bucket_rows, monkeypatch):
    from tessella.llm import simhash as op

    monkeypatch.setattr(op, "BUCKET_ROWS", bucket_rows)
    rows = [r for r in distinct_ids(odd_rows()) if len(r[1] or "") < 100_000]
    rows += [(100 + i, prose(7, 200) + f" end{i}", None, None, None) for i in range(40)]
    got = {r.doc_id: r for r in op.near_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(4)).collect()}
    prints = {r[0]: simhash(r[1]) for r in rows}
    assert {i: r.fp % (1 << 64) for i, r in got.items()} == prints
    assert {i: r.component_id for i, r in got.items()} == linked(prints)


@pytest.mark.parametrize("bucket_rows", [256, 3])
def test_links_of_random_fingerprints(spark, bucket_rows, monkeypatch):
    from tessella.llm import simhash as op
    from tessella.llm.common import components

    monkeypatch.setattr(op, "BUCKET_ROWS", bucket_rows)
    r = random.Random(6)
    seeds = [r.getrandbits(64) for _ in range(30)] + [0, (1 << 64) - 1]
    prints = set(seeds)
    for s in seeds:
        for _ in range(12):
            s ^= 1 << r.randrange(64) ^ (1 << r.randrange(64) if r.random() < 0.7 else 0)
            prints.add(s)
    signed = sorted(p - (1 << 64) if p >> 63 else p for p in prints)
    links = op.fingerprint_links(spark.createDataFrame([(p,) for p in signed], "fp bigint"))
    got = {x.node: x.component for x in components(links.toDF("a", "b")).collect()}
    want = linked({p: p % (1 << 64) for p in signed})
    assert {p: got.get(p, p) for p in signed} == want


def test_near_copies_of_five_words(spark):
    from tessella.llm import simhash as op

    r = random.Random(3)
    texts = {}
    for g in range(12):
        base = prose(100 + g, 150).split()
        for c in range(8):
            w = list(base)
            for at in r.sample(range(len(w)), r.randrange(6)):
                w[at] = f"x{g}y{c}"
            texts[len(texts)] = " ".join(w)
    own = " ".join(f"w{i}" for i in range(60))
    texts |= {200 + i: own + " " + " ".join(f"v{i}z{j}" for j in range(10)) for i in range(30)}  # much in common, not enough
    sets = {}
    for i, t in texts.items():
        w = t.split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)}
    group = {i: i for i in texts}
    for a in texts:
        for b in texts:
            if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) and group[a] != group[b]:
                lo, hi = sorted((group[a], group[b]))
                group = {i: lo if g == hi else g for i, g in group.items()}
    docs = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string").repartition(4)
    assert len(set(group.values())) < 100 and {x.doc_id for x in op.keep_one(docs).collect()} == set(group.values())


def test_shared_id_keeps_the_text_that_represents(spark):
    from tessella.llm.simhash import keep_one

    a, b = prose(31, 80), prose(32, 80)
    rows = [(3, a), (5, a + " end"), (5, b), (9, b)]
    for order in (rows, rows[::-1]):
        assert sorted((x.doc_id, x.text) for x in keep_one(spark.createDataFrame(order, "doc_id bigint, text string").coalesce(1)).collect()) == [(3, a), (5, b)]


def test_windows_of_many_documents_are_not_gathered(spark, monkeypatch):
    from tessella.llm import suffix_dedup as op

    plain = op._sorted_pieces

    def few(table):
        assert table.num_rows < 100, "the records of one window met in a task"
        return plain(table)

    monkeypatch.setattr(op, "_sorted_pieces", few)
    shared = prose(41, 30)
    rows = [(i, prose(1000 + i, 12) + shared + prose(5000 + i, 12)) for i in range(300)]
    got = span_rows(op.remove_repeats(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3), hot=4))
    assert got == repeats([(i, t.encode()) for i, t in rows])


def test_fingerprints_find_the_near_copies_of_the_table(spark):
    """Pairs of different texts of the given table, all against all: at least nine in ten must be linked."""
    from tessella.llm import simhash as op

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    sets = op.shingle_sets(docs).cache()
    texts = {r.set_id: set(op._words((r.text or "").encode()).tolist()) for r in docs.join(sets.select("doc_id", "set_id"), "doc_id").collect()}
    links = {frozenset((r.a, r.b)) for r in op.copy_links(sets, docs).collect()}
    ids = sorted(texts)
    pairs = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if 5 * min(len(texts[a]), len(texts[b])) >= 4 * max(len(texts[a]), len(texts[b])) > 0]
    near = {frozenset(p) for p in pairs if 5 * len(texts[p[0]] & texts[p[1]]) >= 4 * len(texts[p[0]] | texts[p[1]])}
    assert links <= near and len(links) >= 0.9 * len(near) > 0, (len(links), len(near))
    print("pairs", len(near), "linked", len(links))
