"""Quality classifier: histogram gradient-boosted trees over statistics of the whole text.

The trees are fitted on the driver from a bounded sample of labelled documents (``max_rows``, chosen by a hash of the id);
every document is scored. Only the text enters a score.
"""

from __future__ import annotations

from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import boosting
from tessella.llm.common import blocks, crc_fold, map_rows, read, utf8

#: Byte classes of the histogram features.
CLASSES = {
    "upper": set(range(65, 91)), "lower": set(range(97, 123)), "digit": set(range(48, 58)), "space": {32, 9, 11, 12, 13}, "line": {10},
    "stop": set(b".!?"), "comma": set(b",;:"), "symbol": set(b"#*$%&|<>"), "bracket": set(b"()[]{}"), "slash": set(b"/\\_=+~^@"), "wide": set(range(128, 256)),
}
CLASS_OF = np.array([[float(b in c) for c in CLASSES.values()] for b in range(256)])
NAMES = [
    *[f"share_{c}" for c in CLASSES], "log_bytes", "log_words", "word_bytes", "word_spread", "longest_word", "distinct_words", "top_word", "repeated_next", "distinct_pairs",
    "log_lines", "line_bytes", "distinct_lines", "top_line", "entropy", "words_with_symbol_end", "stop_end_lines", "short_words", "words_per_stop",
]


def statistics(text: bytes) -> list[float]:
    """The features of one text; an empty one has zeros."""
    if not text:
        return [0.0] * len(NAMES)
    hist = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    n = len(text)
    p = hist[hist > 0] / n
    words = text.split()
    lines = [x for x in text.split(b"\n") if x.strip()]
    m, k = max(1, len(words)), max(1, len(lines))
    size = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1, np.int64)
    counts: dict[bytes, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    of_line: dict[bytes, int] = {}
    for x in lines:
        of_line[x] = of_line.get(x, 0) + 1
    pairs = list(pairwise(words))
    shares = hist @ CLASS_OF
    return [
        *(shares / n).tolist(), float(np.log1p(n)), float(np.log1p(len(words))), float(size.mean()), float(size.std()), float(np.log1p(size.max())), len(counts) / m, max(counts.values(), default=0) / m, sum(a == b for a, b in pairs) / m, len(set(pairs)) / m,
        float(np.log1p(len(lines))), float(np.log1p(n / k)), len(of_line) / k, max(of_line.values(), default=0) / k, float(-(p * np.log2(p)).sum()), sum(w[-1] in b"#*$%&|<>" for w in words) / m, sum(x.rstrip()[-1] in b".!?" for x in lines) / k, float((size <= 3).mean()), float(np.log1p(len(words) / (1 + hist[46] + hist[33] + hist[63]))),
    ]


def features(docs: DataFrame) -> DataFrame:
    """``docs(doc_id, text, ...)`` without its text, with ``stats`` (array<double>)."""
    kept = [c for c in docs.columns if c not in ("text", "stats")]
    df = docs.select("text", *kept)
    schema = df.select(*kept, F.expr("cast(null as array<double>)").alias("stats")).schema

    def work(batch: pa.RecordBatch) -> dict:
        return dict(zip(kept, batch.columns[1:])) | {"stats": [statistics(t) for t in utf8(batch.column(0))]}

    return map_rows(df, schema, work)


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = 12_000, **options) -> boosting.Trees:
    """Trees from ``labels(doc_id, quality)``; about ``max_rows`` labelled documents are used, the same on every run.

    Null labels and null ids are no examples; a repeated label row counts as often as it stands there.
    """
    given = labels.where("quality is not null and doc_id is not null").select(F.col("doc_id").alias("__id"), F.col("quality").cast("double").alias("__label"))
    n = given.count()
    unit = F.pmod(F.xxhash64(F.lit(3), "__id"), F.lit(1 << 30)) / float(1 << 30)
    chosen = F.broadcast(given.where(unit < max_rows / max(1, n)))  # about max_rows rows whatever the table
    rows = features(docs.select("doc_id", "text").join(chosen, F.col("doc_id") == F.col("__id")).select("doc_id", "text", "__label")).orderBy("doc_id", "__label").toArrow()
    x = np.array(rows.column("stats").to_pylist(), float).reshape(-1, len(NAMES))
    return boosting.fit(x, rows.column("__label").to_numpy().astype(float), **options)


def score(docs: DataFrame, trees: boosting.Trees) -> DataFrame:
    """``docs(doc_id, text)`` -> (doc_id, score): the chance of label 1, 0 to 1, for every row. Null texts count as empty."""
    shared = docs.sparkSession.sparkContext.broadcast(trees)

    def work(batch: pa.RecordBatch) -> dict:
        texts, out = utf8(batch.column(1)), []
        for lo, hi in blocks(texts):
            out.append(shared.value.score(np.array([statistics(t) for t in texts[lo:hi]])))
        return {"doc_id": batch.column(0), "score": pa.array(np.concatenate(out))}

    return map_rows(docs.select("doc_id", "text"), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double", work)


#: A document scored lower is taken for low quality.
THRESHOLD = 0.3


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    trees = fit(docs, read(spark, sf_dir, "labels").where(crc_fold(F.col("doc_id"), 5) != 0))
    out = score(docs, trees)
    return out.select("doc_id", (crc_fold(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
