"""Quotation linking against a slow serial version on random threads, and on odd inputs."""

import random
from collections import Counter

from pyspark.sql import functions as F

from tests.llm.conftest import prose

TALK = "conv_id bigint, turn bigint, role string, text string"


def threads(seed: int):
    """Random conversations whose messages quote own passages of earlier ones, at one or two levels."""
    r = random.Random(seed)
    rows = []
    for conv in range(12):
        said: list[str] = []
        for turn in range(r.randint(1, 14)):
            parts = []
            for _ in range(r.randint(0, 2)):
                if said and r.random() < 0.8:
                    parts.append("\n".join(r.choice(["> ", "> > "]) + line for line in r.choice(said).split("\n")))
                else:
                    parts.append("> " + prose(r.randint(0, 9), 6))
                parts.append("")
            own = r.choice(["ok thanks a lot", prose(r.randint(100, 10_000), r.randint(4, 9))])
            said.append(own)
            rows.append((conv, turn, "user", "\n".join([*parts, own])))
    return rows


def serial(rows):
    from tessella.llm.quotes import parse

    out = {}
    for conv in {r[0] for r in rows}:
        units = {t: parse(text)[1] for c, t, _, text in rows if c == conv}
        parent, linked = {}, {}
        for t in units:
            best = {}
            for passage, level, width, key, words in units[t]:
                sources = [s for s in units if s < t and any(p == 0 and k == key for p, _, _, k, _ in units[s])]
                first = min((s for s in units if any(p == 0 and k == key for p, _, _, k, _ in units[s])), default=None)
                if passage and sources and first < t:
                    best[passage] = max(best.get(passage, ()), (-level, width, words, first))
            if best:
                parent[t], linked[t] = max(best.values())[3], len(best)
        order = []
        for t in units:
            root, depth = t, 0
            while root in parent:
                root, depth = parent[root], depth + 1
            order.append((root, t, depth))
        for k, (root, t, depth) in enumerate(sorted(order)):
            out[conv, t] = (parent.get(t), root, depth, k + 1, linked.get(t, 0))
    return out


def test_random_threads(spark):
    from tessella.llm.quotes import reply_order

    rows = threads(7)
    got = reply_order(spark.createDataFrame(rows, TALK).repartition(3)).collect()
    assert {(r.conv_id, r.turn): (r.parent_turn, r.root_turn, r.depth, r.position, r.n_linked) for r in got} == serial(rows)
    assert sum(r.n_linked > 0 for r in got) > 20


def test_odd_messages(spark):
    from tessella.llm.quotes import reply_order

    rows = [(1, 0, None, "a line of some words here"), (1, 1, "user", None), (1, 2, "user", ""), (None, 0, "user", "> x"), (1, None, "user", "> a line of some words here"), (None, None, None, None), (2, 0, "user", "word " * 60_000), (2, 1, "user", "> " + "word " * 60_000)]
    rows += rows[:3]
    df = spark.createDataFrame(rows, TALK)
    for talk in (df, df.withColumns({c: F.lit("own") for c in ("own", "units", "position", "parent_turn", "hash")})):
        out = reply_order(talk).collect()
        assert Counter((r.conv_id, r.turn) for r in out) == Counter(r[:2] for r in rows)
        assert {r.parent_turn for r in out if (r.conv_id, r.turn) == (2, 1)} == {0} and all(r.n_linked == 0 for r in out if r.conv_id is None or r.turn is None)
    assert reply_order(spark.createDataFrame([], TALK)).count() == 0
