"""Chat formatting by quotation linking: quoted passages are traced to the messages they repeat.

Lines of a message carry a quote level, the number of leading ``>``. Passages (neighbouring lines of one level), their
paragraphs and their lines are normalised and hashed, and so is a message's own text. A quoted unit links to the first
earlier message of its conversation whose own text has the same hash. A message replies to the source of its shallowest,
widest, longest linked unit. Conversations are ordered by thread: each message that replies to none, followed by all
messages that hang on it in the order of their turns.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions.order import indexed
from tessella.llm.common import map_rows, read
from tessella.session import materialize

QUOTED = re.compile(r"[ \t]{0,3}((?:>[ \t]?)+)(.*)", re.S)
#: A line that introduces a quotation; it goes with the quotation it stands before.
INTRO = re.compile(r"\s*(?:On\b.{1,200}\bwrote|Le\b.{1,200}a écrit|Am\b.{1,200}schrieb|El\b.{1,200}escribió)\s*:\s*")
#: Words below which a single line proves nothing.
LINE_WORDS = 4


def levels(text: str) -> list[tuple[int, str]]:
    """(quote level, line without its markers) of each line."""
    out = []
    for line in text.split("\n"):
        m = QUOTED.fullmatch(line)
        out.append((m[1].count(">"), m[2]) if m else (0, line))
    return out


def _units(lines: list[str]) -> list[tuple[int, str, int]]:
    """(width, hash, words) of a passage (2), its paragraphs (1) and its lines (0); equal ones once, the widest."""
    paragraphs = [p for p in re.split(r"\n\s*\n", "\n".join(lines)) if p.strip()]
    found: dict[str, tuple[int, str, int]] = {}
    for width, texts in ((2, ["\n".join(lines)]), (1, paragraphs), (0, lines)):
        for t in texts:
            words = t.casefold().split()
            if words and (width or len(words) >= LINE_WORDS):
                key = hashlib.blake2b(" ".join(words).encode("utf-8", "surrogatepass"), digest_size=16).hexdigest()
                found.setdefault(key, (width, key, len(words)))
    return list(found.values())


def parse(text: str | None) -> tuple[str, list[tuple[int, int, int, str, int]]]:
    """The text without quotations, and (passage, level, width, hash, words) of its units; passage 0 is the own text."""
    lines = levels(text or "")
    own, passages, last = [], [], None
    for k, (level, line) in enumerate(lines):
        if not level:
            if not (k + 1 < len(lines) and lines[k + 1][0] and INTRO.fullmatch(line)):
                own.append(line)
        elif level == last:
            passages[-1][1].append(line)
        else:
            passages.append((level, [line]))
        last = level
    clean = re.sub(r"\n{3,}", "\n\n", "\n".join(own)).strip("\n") if passages else text or ""
    units = [(0, 0, *u) for u in _units(own)]
    for k, (level, block) in enumerate(passages, 1):
        units += [(k, level, *u) for u in _units(block)]
    return clean, units


def parsed(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, own, units) of every message."""
    base = conversations.select("conv_id", "turn", F.col("role").cast("string").alias("role"), F.col("text").alias("own"))
    schema = base.withColumn("units", F.expr("cast(array() as array<struct<passage:int,level:int,width:int,hash:string,words:int>>)")).schema

    def work(batch: pa.RecordBatch) -> dict:
        found = [parse(t) for t in batch.column(3).to_pylist()]
        names = ("passage", "level", "width", "hash", "words")
        return dict(zip(("conv_id", "turn", "role"), batch.columns)) | {"own": [t for t, _ in found], "units": [[dict(zip(names, u)) for u in x] for _, x in found]}

    return map_rows(base, schema, work)


def reply_links(messages: DataFrame) -> DataFrame:
    """``messages(conv_id, turn, units)`` -> (conv_id, turn, parent_turn, n_linked), only messages with a linked quotation.

    Sources are one row per conversation and hash before the join, so a line that everybody writes makes no pairs.
    """
    units = messages.select("conv_id", "turn", F.explode("units").alias("u")).select("conv_id", "turn", "u.*")
    source = units.where("passage = 0").groupBy("conv_id", "hash").agg(F.min("turn").alias("source_turn"))
    linked = units.where("passage > 0").join(source, ["conv_id", "hash"]).where("source_turn < turn")
    best = F.struct(-F.col("level"), "width", "words", "source_turn")
    each = linked.groupBy("conv_id", "turn", "passage").agg(F.max(best).alias("best"))
    return each.groupBy("conv_id", "turn").agg(F.max("best").alias("best"), F.count(F.lit(1)).alias("n_linked")).select("conv_id", "turn", F.col("best.source_turn").alias("parent_turn"), "n_linked")


def thread_roots(links: DataFrame) -> DataFrame:
    """(conv_id, turn, root_turn, depth) of linked messages: every round doubles the way each has gone, until all have arrived."""
    state = links.select("conv_id", "turn", F.col("parent_turn").alias("root_turn"), F.lit(1).cast("bigint").alias("depth"))
    while True:
        state = materialize(state, "threads")
        ahead = state.select("conv_id", F.col("turn").alias("root_turn"), F.col("root_turn").alias("next"), F.col("depth").alias("more"))
        step = state.join(ahead, ["conv_id", "root_turn"])
        if step.isEmpty():
            return state
        state = state.join(ahead, ["conv_id", "root_turn"], "left").select("conv_id", "turn", F.coalesce("next", "root_turn").alias("root_turn"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"))


def reply_order(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, own, parent_turn, root_turn, depth, position, n_quotes, n_linked) of every message.

    ``own`` is the text without quotations, ``position`` counts from 1 in the conversation's reply order. Null texts are
    empty; a message with a null conversation or turn has no links and stands under that null. Repeated messages (equal
    conversation and turn) share links and position. Threads can't loop, as a source is always an earlier turn.
    """
    messages = materialize(parsed(conversations), "messages")
    links = materialize(reply_links(messages), "replies")
    roots = thread_roots(links)
    keys = messages.select("conv_id", "turn").distinct().join(roots, ["conv_id", "turn"], "left").join(links, ["conv_id", "turn"], "left")
    keys = keys.withColumn("root_turn", F.coalesce("root_turn", "turn")).withColumn("depth", F.coalesce("depth", F.lit(0))).withColumn("n_linked", F.coalesce("n_linked", F.lit(0)))
    placed = indexed(keys, ["conv_id"], ["root_turn", "turn"], "position").withColumnsRenamed({"conv_id": "__conv", "turn": "__turn"})
    same = F.col("conv_id").eqNullSafe(F.col("__conv")) & F.col("turn").eqNullSafe(F.col("__turn"))
    n_quotes = F.coalesce(F.array_max(F.transform("units", lambda u: u["passage"])), F.lit(0))
    return messages.withColumn("n_quotes", n_quotes.cast("bigint")).join(placed, same).select("conv_id", "turn", "role", "own", "parent_turn", "root_turn", "depth", "position", "n_quotes", "n_linked")


def chat_lines(ordered: DataFrame) -> DataFrame:
    """``reply_order`` rows with ``chat``: the message in chat markup, to be written in the order of ``position``."""
    return ordered.withColumn("chat", F.concat(F.lit("<|"), F.coalesce("role", F.lit("user")), F.lit("|>\n"), "own", F.lit("\n<|end|>\n")))


def op5_quote_threads(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = chat_lines(reply_order(read(spark, sf_dir, "conversations")))
    return out.select("conv_id", "turn", "role", "parent_turn", "root_turn", "depth", "position", "n_quotes", "n_linked", F.sha2("chat", 256).alias("chat_sha256"))
