"""Personal data by candidate gradient boosting, in DataFrame functions only.

High-recall generators propose overlapping spans: every stretch of neighbouring digit groups that is a valid card, telephone
number or address by its own rule, and every e-mail address with letters of any script. Boosted trees see their format and
context, not the facts that make them valid, and learn which of them the strict patterns take whole. Spans of the strict patterns
always stay; candidates that touch none of them (cards side by side, a number glued to the next) are unlabelled, not wrong. So a
candidate's score is divided by the mean score of the confirmed ones of its kind, counted over all candidates of the corpus, and
the span is added where that estimate is high.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import boosting
from tessella.llm.common import read
from tessella.session import materialize

#: Kinds in their order.
KINDS = ("email", "ip", "card", "phone")
#: The strict patterns; a match that could only start inside a longer run is left out at once, so a long run costs one pass.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[0-9]|[ -][0-9])++"
PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
BYTE_PARTS = r"^0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})(?:\.0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})){3}$"
#: The generators: addresses with a dotted host, and runs of at least four digits with short gaps, cut into groups.
MAIL = r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]{1,64}+@[\p{L}\p{N}-]{1,63}+(?:\.[\p{L}\p{N}-]{1,63}+)++"
RUN = r"\+?[0-9](?:[ ().+-]{0,3}+[0-9]){3,}+"
CARD_FORM = r"^[0-9](?:[ -]{0,2}[0-9])*$"
MOST_DIGITS = 19
CUES = r"(?i)(mail|phone|tel|call|mobile|fax|card|visa|account|contact|address|server)\W{0,6}$"
#: Rows of the table that the trees are fitted on, the commonest feature vectors first. Thresholds count all vectors.
VECTORS = 20_000
#: Least estimated probability of an added span.
LEAST = 0.8
FEATURES = ("kind", "groups", "first", "last", "digits", "seps", "before", "after", "cue")


def matches(text: Column, pattern: str, possible: Column) -> Column:
    """array<struct<s, e, v>> of the matches in order: start, end (code points) and value."""
    pieces, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    both = F.filter(F.zip_with(pieces, found, lambda p, v: F.struct(F.length(p).alias("gap"), v.alias("v"))), lambda x: x["v"].isNotNull())
    empty = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<s:int,e:int,v:string>>)").alias("out"))

    def add(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["gap"]
        end = start + F.length(x["v"])
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(F.struct(start.alias("s"), end.alias("e"), x["v"].alias("v")))).alias("out"))

    return F.when(possible, F.aggregate(both, empty, add, lambda acc: acc["out"])).otherwise(empty["out"])


def digits_of(v: Column) -> Column:
    return F.regexp_replace(v, "[^0-9]", "")


def luhn(v: Column) -> Column:
    """Whether the digits of ``v``, 14 to 19, pass the Luhn check."""
    d = digits_of(v)
    doubled = F.transform(F.sequence(F.lit(1), F.length(d)), lambda i: F.substr(d, -i, F.lit(1)).cast("int") * (2 - i % 2))
    total = F.aggregate(doubled, F.lit(0), lambda s, x: s + x - F.when(x > 9, 9).otherwise(0))
    return F.when(F.length(d).between(14, 19), total % 10 == 0).otherwise(False)


def strict_spans(text: Column) -> Column:
    """array<struct<s, k, e>>, sorted: spans of the strict patterns; k is the place of the kind in ``KINDS``."""
    has_digit = text.rlike("[0-9]")
    rules = [
        (EMAIL, F.contains(text, F.lit("@")), lambda v: F.lit(True)),
        (IP, has_digit & F.contains(text, F.lit(".")), lambda v: v.rlike(BYTE_PARTS)),
        (CARD, has_digit, luhn),
        (PHONE, F.contains(text, F.lit("+")) & has_digit, lambda v: F.length(digits_of(v)).between(10, 15)),
    ]

    def spans(k: int, pattern: str, possible: Column, ok) -> Column:
        right = F.filter(matches(text, pattern, possible), lambda x: ok(x["v"]))
        return F.transform(right, lambda x: F.struct(x["s"].alias("s"), F.lit(k).alias("k"), x["e"].alias("e")))

    parts = [spans(k, *rule) for k, rule in enumerate(rules)]
    return F.array_sort(F.concat(*parts))


def bound(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def kind_of_char(c: Column) -> Column:
    return F.when(c == "", 0).when(c.rlike(r"\s"), 1).when(c.rlike("[0-9]"), 2).when(c.rlike(r"\w"), 3).otherwise(4)


def number_spans(text: Column, run: Column) -> Column:
    """Cards, numbers and addresses in one run of digits: stretches of neighbouring groups with at most ``MOST_DIGITS`` digits."""
    outside = F.when(run["s"] > 0, F.substr(text, run["s"], F.lit(1))).otherwise(""), F.substr(text, run["e"] + 1, F.lit(1))
    cue = F.substr(text, F.greatest(run["s"] - 19, F.lit(1)), F.least(run["s"], F.lit(20))).rlike(CUES)

    def in_chars(c: Column) -> Column:
        n = F.size(c)

        def digit(i: Column) -> Column:
            return F.coalesce(F.get(c, i).between("0", "9"), F.lit(False))

        places = F.sequence(F.lit(0), n - 1)
        first, last = F.filter(places, lambda i: digit(i) & ~digit(i - 1)), F.filter(places, lambda i: digit(i) & ~digit(i + 1))
        groups = F.zip_with(first, last, lambda a, b: F.struct(a.alias("s"), (b + 1).alias("e")))

        def stretch(g: Column, i: Column, j: Column) -> Column:
            s, e = F.get(g, i)["s"], F.get(g, j)["e"]

            def described(v: Column) -> Column:
                digits = F.length(digits_of(v))
                plus = F.coalesce(F.get(c, s - 1) == "+", F.lit(False))
                kind = F.when(plus & digits.between(10, 15), 3).when((j - i == 3) & v.rlike(BYTE_PARTS), 1).when(v.rlike(CARD_FORM) & luhn(v), 2)

                def placed(at: Column) -> Column:
                    before = F.when(at > 0, F.get(c, at - 1)).otherwise(outside[0])
                    after = F.when(e < n, F.get(c, e)).otherwise(outside[1])
                    values = {
                        "kind": kind, "groups": j - i + 1, "first": F.get(g, i)["e"] - s, "last": e - F.get(g, j)["s"], "digits": digits,
                        "seps": e - s - digits, "before": kind_of_char(before), "after": kind_of_char(after), "cue": cue,
                    }
                    return F.struct((run["s"] + at).alias("s"), (run["s"] + e).alias("e"), *[values[f].cast("int").alias(f) for f in FEATURES])

                return bound(s - F.when(kind == 3, 1).otherwise(0), placed)

            return bound(F.array_join(F.slice(c, s + 1, e - s), ""), described)

        def from_group(g: Column, i: Column) -> Column:
            ends = F.filter(F.sequence(i, F.least(i + MOST_DIGITS - 1, F.size(g) - 1)), lambda j: F.get(g, j)["e"] - F.get(g, i)["s"] <= 4 * MOST_DIGITS)
            return F.filter(F.transform(ends, lambda j: stretch(g, i, j)), lambda x: x["kind"].isNotNull())

        return bound(groups, lambda g: F.flatten(F.transform(F.sequence(F.lit(0), F.size(g) - 1), lambda i: from_group(g, i))))

    return bound(F.regexp_extract_all(run["v"], F.lit("."), F.lit(0)), in_chars)


def mail_span(text: Column, x: Column) -> Column:
    local, host = F.substring_index(x["v"], "@", 1), F.substring_index(x["v"], "@", -1)
    before = F.when(x["s"] > 0, F.substr(text, x["s"], F.lit(1))).otherwise("")
    cue = F.substr(text, F.greatest(x["s"] - 19, F.lit(1)), F.least(x["s"], F.lit(20))).rlike(CUES)
    values = {
        "kind": F.lit(0), "groups": F.size(F.split(host, r"\.")), "first": F.length(local), "last": F.length(F.substring_index(host, ".", -1)),
        "digits": F.length(digits_of(local)), "seps": F.length(F.regexp_replace(local, r"[\p{L}\p{N}]", "")), "before": kind_of_char(before),
        "after": kind_of_char(F.substr(text, x["e"] + 1, F.lit(1))), "cue": cue,
    }
    return F.struct(x["s"].alias("s"), x["e"].alias("e"), *[values[f].cast("int").alias(f) for f in FEATURES])


def candidates(text: Column, strict: Column) -> Column:
    """array<struct<confirmed, touching, s, e, features...>> of both generators.

    ``confirmed``: a strict span of the kind has the same ends. ``touching``: some strict span shares a character.
    """
    mails = F.transform(matches(text, MAIL, F.contains(text, F.lit("@"))), lambda x: mail_span(text, x))
    numbers = F.flatten(F.transform(matches(text, RUN, text.rlike("[0-9]")), lambda x: number_spans(text, x)))

    def compared(x: Column) -> Column:
        same = F.exists(strict, lambda b: (b["s"] == x["s"]) & (b["e"] == x["e"]) & (b["k"] == x["kind"]))
        near = F.exists(strict, lambda b: (b["s"] < x["e"]) & (x["s"] < b["e"]))
        return F.struct(same.cast("int").alias("confirmed"), near.cast("int").alias("touching"), *[x[f].alias(f) for f in ("s", "e", *FEATURES)])

    return F.transform(F.concat(mails, numbers), compared)


class Selector:
    """Trees as a column expression, and the least score of each kind; a kind that is not in ``least`` gets no further span."""

    def __init__(self, trees: boosting.Trees, least: dict[int, float] | None = None):
        self.trees, self.least = trees, least or {}

    def score(self, x: Column) -> Column:
        def walk(t: int, node: int) -> Column:
            inner = self.trees.feature.shape[1]
            if node >= inner:
                return F.lit(float(self.trees.leaf[t, node - inner]))
            cut = float(self.trees.cut[t, node])
            left = walk(t, 2 * node + 1)
            return left if np.isinf(cut) else F.when(x[FEATURES[self.trees.feature[t, node]]] > cut, walk(t, 2 * node + 2)).otherwise(left)

        margin = reduce(lambda a, b: a + b, [walk(t, 0) for t in range(len(self.trees.leaf))], F.lit(self.trees.base))
        return 1 / (1 + F.exp(-margin))

    def least_of(self, kind: Column) -> Column:
        return reduce(lambda acc, k: F.when(kind == k, self.least[k]).otherwise(acc), self.least, F.lit(2.0))


def fit(found: DataFrame, trees: int = 12, depth: int = 3, fewest: int = 20, vectors: int = VECTORS, least: float = LEAST) -> Selector:
    """Fit on ``found(cands)``: confirmed candidates against all others, the score of a kind calibrated on all its candidates.

    A vector of candidates that touch no strict span weighs as the logarithm of its count: copies of one text with a missed
    span must not teach that its format is wrong. A kind with under ``fewest`` confirmed candidates gets no further span.
    """
    table = found.select(F.explode("cands").alias("c")).select("c.*").groupBy("confirmed", "touching", *FEATURES).agg(F.count(F.lit(1)).alias("n"))
    table = materialize(table, "candidate_vectors")
    rows = table.orderBy(F.desc("n"), "confirmed", "touching", *FEATURES).limit(vectors).collect()
    x = np.array([[r[f] for f in FEATURES] for r in rows], float).reshape(-1, len(FEATURES))
    y = np.array([r["confirmed"] for r in rows], float)
    w = np.array([r["n"] if r["touching"] else 1 + np.log(r["n"]) for r in rows], float)
    model = boosting.fit(x, y, w, trees=trees, depth=depth, bins=24, rate=0.4, least=2.0)
    score = Selector(model).score(F.struct(*FEATURES))
    rates = table.where("confirmed = 1").groupBy("kind").agg(F.sum("n").alias("n"), (F.sum(score * F.col("n")) / F.sum("n")).alias("mean")).collect()
    return Selector(model, {r["kind"]: least * r["mean"] for r in rates if r["n"] >= fewest})


def added_spans(cands: Column, selector: Selector) -> Column:
    """array<struct<s, k, e>>: accepted candidates that touch no strict span.

    From left to right; of two that overlap the one with the higher score stays, then the longer, then the first.
    """
    loose = F.filter(cands, lambda x: x["touching"] == 0)
    scored = F.transform(loose, lambda x: F.struct(x["s"].alias("s"), x["kind"].alias("k"), x["e"].alias("e"), selector.score(x).alias("p")))
    kept = F.array_sort(F.filter(scored, lambda x: x["p"] >= selector.least_of(x["k"])))

    def better(acc: Column, x: Column) -> Column:
        last = F.element_at(acc, -1)
        wins = (x["p"] > last["p"]) | ((x["p"] == last["p"]) & (x["e"] - x["s"] > last["e"] - last["s"]))
        in_place = F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(x))
        return F.when((F.size(acc) == 0) | (last["e"] <= x["s"]), F.concat(acc, F.array(x))).when(wins, in_place).otherwise(acc)

    none = F.expr("cast(array() as array<struct<s:int,k:int,e:int,p:double>>)")
    return F.transform(F.aggregate(kept, none, better), lambda x: F.struct(x["s"].alias("s"), x["k"].alias("k"), x["e"].alias("e")))


def listed(spans: Column) -> Column:
    """``kind:start:end`` of sorted spans, joined by commas."""
    name = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", name[x["k"]], x["s"].cast("string"), x["e"].cast("string"))), ",")


def find_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, base, added) of every row: strict spans, and spans the trees add.

    A null or empty text has none; rows map one to one, whatever their ids.
    """
    text = F.coalesce("text", F.lit(""))
    found = docs.select("doc_id", text.alias("text")).withColumn("base", strict_spans(F.col("text")))
    found = materialize(found.select("doc_id", "base", candidates(F.col("text"), F.col("base")).alias("cands")), "candidates")
    return found.select("doc_id", "base", added_spans(F.col("cands"), fit(found)).alias("added"))


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with every found span of ``text`` replaced by ``<KIND>``, and ``n_chars``, if there, brought up to date.

    Overlapping spans are one: the name is that of the span that starts first. A null text stays null.
    """
    text = F.coalesce("text", F.lit(""))
    found = docs.select(text.alias("text")).withColumn("base", strict_spans(F.col("text")))
    selector = fit(materialize(found.select(candidates(F.col("text"), F.col("base")).alias("cands")), "candidates"))
    marked = docs.withColumn("__base", strict_spans(text))
    marked = marked.withColumn("__spans", F.array_sort(F.concat("__base", added_spans(candidates(text, F.col("__base")), selector))))
    name = F.array(*[F.lit(f"<{k.upper()}>") for k in KINDS])
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        fresh = x["s"] >= acc["at"]
        kept = F.concat(acc["out"], F.substr("text", acc["at"] + 1, x["s"] - acc["at"]), name[x["k"]])
        return F.struct(F.greatest(acc["at"], x["e"]).alias("at"), F.when(fresh, kept).otherwise(acc["out"]).alias("out"))

    clean = F.aggregate("__spans", start, step, lambda acc: F.concat(acc["out"], F.substr("text", acc["at"] + 1)))
    marked = marked.withColumn("text", F.when(F.size("__spans") > 0, clean).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        marked = marked.withColumn("n_chars", F.when(F.size("__spans") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return marked.select(*docs.columns)


def op7_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_spans(read(spark, sf_dir, "documents"))

    def count(k: int) -> Column:
        return F.size(F.filter("base", lambda x: x["k"] == k)).cast("bigint")

    counts = [count(k).alias(f"n_{name}") for k, name in enumerate(KINDS)]
    return found.select("doc_id", *counts, F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.array_sort(F.concat("base", "added"))).alias("spans"))
