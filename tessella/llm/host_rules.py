"""Quality rules of documents and of their hosts.

Every document is measured; rule failures are summed by host (``source``), each rule's failure rates over the hosts give an
empirical beta prior that shrinks the rates of small hosts, and the verdict of a host is joined back to its documents.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.common import map_rows, read, utf8
from tessella.session import materialize

#: Rule -> condition on the measures under which a document fails it.
RULES = {
    "short": "n_words < 50",
    "repetitive": "100 * n_repeat_words > 50 * n_words",
    "symbols": "2 * n_symbols > n_words",
    "word_length": "n_words > 0 and (word_chars < 3 * n_words or word_chars > 12 * n_words)",
    "copied_lines": "4 * n_dup_lines > n_words",
}
#: A host goes if the shrunk failure rate of a rule is above this.
HOST_LIMIT = 0.6
#: Bounds of the prior's weight, in documents.
PRIOR_WEIGHT = (2.0, 1000.0)


def measure(text: bytes) -> tuple[int, int, int, int, int]:
    """Words, their code points, symbols, copied lines, and words in repeated three-word windows."""
    words = text.split()
    n = len(words)
    chars = int((np.frombuffer(b"".join(words), np.uint8) & 0xC0 != 0x80).sum()) if n else 0
    symbols = len(text) - len(text.translate(None, b"#*$%&|<>"))
    lines = [x for x in text.split(b"\n") if x.strip()] if n else []
    repeated = 0
    if n >= 4:
        ids: dict[bytes, int] = {}
        at = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, n)
        pairs = at[:-1] * len(ids) + at[1:]
        if len(ids) >= 1 << 20:
            pairs = np.unique(pairs, return_inverse=True)[1].astype(np.int64)
        _, back, count = np.unique(pairs[:-1] * (len(ids) + 1) + at[2:], return_inverse=True, return_counts=True)
        twice = np.zeros(n + 2, bool)
        twice[:-4] = count[back] > 1
        repeated = int((twice[:n] | np.concatenate(([False], twice[: n - 1])) | np.concatenate(([False, False], twice[: n - 2]))).sum())
    return n, chars, symbols, len(lines) - len(set(lines)), repeated


MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def measures(docs: DataFrame, host_col: str = "source") -> DataFrame:
    """(doc_id, host, measures) of every whole text; a null text has no words."""

    def work(batch: pa.RecordBatch) -> dict:
        rows = np.array([measure(t) for t in utf8(batch.column(2))], np.int64)
        return {"doc_id": batch.column(0), "host": batch.column(1)} | {m: pa.array(rows[:, k]) for k, m in enumerate(MEASURES)}

    df = docs.select("doc_id", F.col(host_col).cast("string").alias("host"), "text")
    return map_rows(df, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, host string, " + ", ".join(f"{m} bigint" for m in MEASURES), work)


def host_verdicts(measured: DataFrame) -> DataFrame:
    """(host, n_docs, rate_<rule>..., host_kept): failure rates shrunk by the beta prior of all hosts (method of moments)."""
    fails = [F.sum(F.expr(f"cast({c} as int)")).alias(r) for r, c in RULES.items()]
    hosts = measured.where("host is not null").groupBy("host").agg(F.count(F.lit(1)).alias("n_docs"), *fails)
    prior = hosts.agg(*[f(F.col(r) / F.col("n_docs")).alias(f"{s}_{r}") for r in RULES for s, f in (("m", F.avg), ("v", F.var_pop))]).first()
    for r in RULES:
        m, v = prior[f"m_{r}"] or 0.0, prior[f"v_{r}"] or 0.0
        weight = min(max(m * (1 - m) / v - 1, PRIOR_WEIGHT[0]), PRIOR_WEIGHT[1]) if v > 0 else PRIOR_WEIGHT[1]
        hosts = hosts.withColumn(f"rate_{r}", (F.col(r) + m * weight) / (F.col("n_docs") + weight))
    passed = reduce(lambda a, b: a & b, [F.col(f"rate_{r}") <= HOST_LIMIT for r in RULES])
    return hosts.select("host", "n_docs", *[f"rate_{r}" for r in RULES], passed.alias("host_kept"))


def apply_rules(docs: DataFrame, host_col: str = "source") -> DataFrame:
    """(doc_id, host, measures, base_failed, kept) of every row.

    A document without a host is judged alone. Rows map one to one: repeated rows, also of one id, stay. The verdicts are
    joined by host; Spark sends them to all tasks if they are small and splits a host with very many rows otherwise.
    """
    measured = materialize(measures(docs, host_col), "measures")
    verdicts = host_verdicts(measured).select("host", "host_kept")
    failed = F.expr(f"{RULES['short']} or {RULES['repetitive']}")
    out = measured.join(verdicts, "host", "left").withColumn("base_failed", failed)
    return out.select("doc_id", "host", *MEASURES, "base_failed", (~F.col("base_failed") & F.coalesce("host_kept", F.lit(True))).alias("kept"))


def op3_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return apply_rules(read(spark, sf_dir, "documents")).drop("host")


def _sql() -> str:
    duck = {r: f"sum(case when {c} then 1 else 0 end) as {r}" for r, c in RULES.items()}
    weight = {r: f"case when v_{r} > 0 then least(greatest(m_{r} * (1 - m_{r}) / v_{r} - 1, {PRIOR_WEIGHT[0]}), {PRIOR_WEIGHT[1]}) else {PRIOR_WEIGHT[1]} end" for r in RULES}
    return rf"""
with d as (select doc_id, source, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
     spots as (select doc_id, w, unnest(range(1, len(w) - 1)) as i from d where len(w) >= 3),
     grams as (select doc_id, i, count(*) over (partition by doc_id, w[i], w[i + 1], w[i + 2]) as n from spots),
     reps as (select doc_id, count(distinct j) as n from (select doc_id, unnest([i, i + 1, i + 2]) as j from grams where n > 1) group by doc_id),
     lines as (select doc_id, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as l from d),
     m as (select doc_id, source, cast(len(w) as bigint) as n_words, cast(length(array_to_string(w, '')) as bigint) as word_chars,
                  cast(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) as bigint) as n_symbols,
                  cast(len(l) - len(list_distinct(l)) as bigint) as n_dup_lines, coalesce(reps.n, 0) as n_repeat_words
           from d join lines using (doc_id) left join reps using (doc_id)),
     hosts as (select source, count(*) as n_docs, {', '.join(duck.values())} from m where source is not null group by source),
     prior as (select {', '.join(f'avg({r} / n_docs) as m_{r}, var_pop({r} / n_docs) as v_{r}' for r in RULES)} from hosts),
     verdicts as (select source, {' and '.join(f'({r} + m_{r} * ({weight[r]})) / (n_docs + ({weight[r]})) <= {HOST_LIMIT}' for r in RULES)} as host_kept from hosts, prior),
     f as (select *, ({RULES['short']} or {RULES['repetitive']}) as base_failed from m)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and coalesce(host_kept, true) as kept
from f left join verdicts using (source)
"""


OP3_SQL = _sql()
