"""Language ID: sparse multinomial logistic regression on TF-IDF character n-grams.

Text is folded to lower-case letters, everything else to a space. N-grams of one to three characters are hashed to
``BUCKETS`` features with the value count / n-grams of the text * idf. Document frequencies cover every learning
document; the weights are fitted by follow-the-regularised-leader with elastic-net penalties on a bounded sample
(``per_language`` documents of each language), and a temperature is fitted on a fold of that sample kept apart.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.common import BATCH_ROWS, blocks, bounded_sample, crc_fold, map_rows, read

BITS = 16
BUCKETS = 1 << BITS
ORDERS = 3
#: Odd multipliers of the n-gram hash.
MIX = np.array([2654435761, 2246822519, 3266489917], np.uint32)
SCALE = 20.0


@lru_cache(1)
def fold_table() -> np.ndarray:
    """Lower-case code point of every letter, a space for all else."""
    out = np.full(0x110000, 32, np.uint32)
    for c in range(0x110000):
        if (s := chr(c)).isalpha():
            low = s.lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


def ngram_buckets(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Feature of every n-gram, (positions, orders), and the first position of each text. Feature 0 means none."""
    block = " " + "   ".join(t + " " for t in texts) + "   "
    codes = fold_table()[np.frombuffer(block.encode("utf-32-le", "surrogatepass"), "<u4")]
    lens = np.fromiter((len(t) for t in texts), np.int64, len(texts)) + 4
    starts = np.concatenate(([0], np.cumsum(lens)[:-1]))
    n = int(lens.sum())
    codes = np.concatenate([codes, np.full(max(0, n + 2 - len(codes)), 32, np.uint32)])
    out = np.empty((n, ORDERS), np.int32)
    mixed = np.zeros(n, np.uint32)
    blank = codes[:n] == 32
    for k in range(ORDERS):
        mixed = (mixed ^ codes[k : k + n]) * MIX[k]
        mixed ^= mixed >> np.uint32(15)
        feature = ((mixed * MIX[0]) >> np.uint32(32 - BITS)).astype(np.int32)
        np.maximum(feature, 1, out=feature)
        if k:
            blank = blank & (codes[k : k + n] == 32)
        feature[blank] = 0
        out[:, k] = feature
    for back in (1, 2):
        out[starts + lens - back] = 0
    return out, starts


class LanguageModel:
    """Weights (BUCKETS, languages) that hold idf already, bias, temperature and the language names."""

    def __init__(self, names: list[str], weights: np.ndarray, bias: np.ndarray, temperature: float):
        self.names, self.weights, self.bias, self.temperature = names, weights, bias, temperature

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        names, scores = ["und"] * len(texts), np.zeros(len(texts))
        live = [i for i, t in enumerate(texts) if t and any(map(str.isalpha, t))] if self.names else []
        some = [texts[i] for i in live]
        for lo, hi in blocks(some, max(1 << 12, (1 << 20) // max(1, len(self.names) // 8))):
            features, starts = ngram_buckets(some[lo:hi])
            each = self.weights[features[:, 0]]
            for k in range(1, ORDERS):
                each += self.weights[features[:, k]]
            count = np.add.reduceat((features > 0).sum(axis=1), starts)
            logits = SCALE * np.add.reduceat(each, starts, axis=0) / np.maximum(count, 1)[:, None] + self.bias
            p = softmax(logits / self.temperature)
            best = p.argmax(axis=1)
            for i, b, s in zip(live[lo:hi], best.tolist(), p[np.arange(len(best)), best].tolist()):
                names[i], scores[i] = self.names[b], s
        return names, scores


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def document_frequencies(learn: DataFrame) -> np.ndarray:
    """Documents of all of ``learn(text)`` that hold each feature; a task sends one row per feature at most."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            texts = [t or "" for t in batch.column(0).to_pylist()]
            for lo, hi in blocks(texts):
                features, starts = ngram_buckets(texts[lo:hi])
                for a, b in zip(starts, [*starts[1:], len(features)]):
                    seen = np.zeros(BUCKETS, bool)
                    seen[features[a:b].ravel()] = True
                    total += seen
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["feature", "n"])

    learn.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    out = np.zeros(BUCKETS)
    for r in learn.select("text").mapInArrow(count, "feature int, n bigint").groupBy("feature").agg(F.sum("n").alias("n")).collect():
        out[r["feature"]] = r["n"]
    return out


def sparse_rows(sample: DataFrame) -> list[tuple]:
    """(id, lang, features, shares) of the bounded sample."""

    def work(batch: pa.RecordBatch) -> dict:
        at, share = [], []
        for t in batch.column(2).to_pylist():
            features, _ = ngram_buckets([t or ""])
            f, n = np.unique(features[features > 0], return_counts=True)
            at.append(f.astype(np.int32))
            share.append((n / max(1, n.sum())).astype(np.float32))
        return {"doc_id": batch.column(0), "lang": batch.column(1), "at": at, "share": share}

    rows = map_rows(sample.select(F.col("doc_id").cast("string"), "lang", "text"), "doc_id string, lang string, at array<int>, share array<float>", work).toArrow().to_pylist()
    return sorted(((r["doc_id"] or "", r["lang"], np.array(r["at"], np.int64), np.array(r["share"])) for r in rows), key=lambda r: (r[0], r[1]))


def ftrl(rows: list[tuple], n_lang: int, alpha: float, beta: float, l1: float, l2: float, epochs: int) -> tuple[np.ndarray, np.ndarray]:
    """Per-coordinate FTRL-proximal on (features, values, label); feature BUCKETS is the unpenalised bias."""
    z, n = np.zeros((BUCKETS + 1, n_lang)), np.zeros((BUCKETS + 1, n_lang))
    free = np.zeros(BUCKETS + 1)
    free[:BUCKETS] = 1

    def weights(at: np.ndarray) -> np.ndarray:
        pen = free[at][:, None]
        zz = z[at]
        return np.where(np.abs(zz) > l1 * pen, -(zz - np.sign(zz) * l1 * pen) / ((beta + np.sqrt(n[at])) / alpha + l2 * pen), 0.0)

    order = np.random.default_rng(5)
    for _ in range(epochs):
        for i in order.permutation(len(rows)):
            at, x, y = rows[i]
            w = weights(at)
            p = softmax((x @ w)[None])[0]
            p[y] -= 1
            g = x[:, None] * p
            s = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha
            z[at] += g - s * w
            n[at] += g * g
    w = weights(np.arange(BUCKETS + 1))
    return w[:BUCKETS], w[BUCKETS]


def temperature_of(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature with the least log loss, by golden section over its logarithm."""
    if not len(labels):
        return 1.0

    def loss(t: float) -> float:
        return float(-np.log(softmax(logits / np.exp(t))[np.arange(len(labels)), labels] + 1e-12).mean())

    lo, hi, r = np.log(0.05), np.log(20.0), (5**0.5 - 1) / 2
    while hi - lo > 1e-3:
        a, b = hi - r * (hi - lo), lo + r * (hi - lo)
        lo, hi = (lo, b) if loss(a) < loss(b) else (a, hi)
    return float(np.exp((lo + hi) / 2))


def fit(learn: DataFrame, per_language: int = 400, alpha: float = 0.5, beta: float = 1.0, l1: float = 1e-3, l2: float = 1e-3, epochs: int = 3) -> LanguageModel:
    """Fit on ``learn(doc_id, text, lang)``. ``per_language`` bounds the sample the weights are fitted on, nothing else."""
    learn = learn.where("lang is not null and text is not null").select("doc_id", "text", "lang")
    n_docs = learn.select("lang").count()
    df = document_frequencies(learn)
    idf = np.where(df > 0, np.log((1 + n_docs) / (1 + df)) + 0.1, 0.0)
    idf[0] = 0
    rows = sparse_rows(bounded_sample(learn, "lang", per_language))
    names = sorted({r[1] for r in rows})
    if not names:
        return LanguageModel([], np.zeros((BUCKETS, 0), np.float32), np.zeros(0), 1.0)
    code = {c: i for i, c in enumerate(names)}
    vectors = [(np.append(at, BUCKETS), np.append(SCALE * share * idf[at], 1.0), code[lang]) for _, lang, at, share in rows]
    held = [i for i in range(len(rows)) if i % 5 == 4]
    w, bias = ftrl([v for i, v in enumerate(vectors) if i % 5 != 4], len(names), alpha, beta, l1, l2, epochs)
    full = np.vstack([w, bias])
    logits = np.array([vectors[i][1] @ full[vectors[i][0]] for i in held]).reshape(-1, len(names))
    t = temperature_of(logits, np.array([vectors[i][2] for i in held], int))
    return LanguageModel(names, (w * idf[:, None]).astype(np.float32), bias, t)


def identify(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score`` added (earlier columns of these names are replaced).

    A null text, an empty text and one without a letter give ``und`` and 0, and so does a model without languages.
    Rows map one to one: repeated rows stay, ids may be null.
    """
    kept = [c for c in docs.columns if c not in ("lang_pred", "score")]
    df = docs.select(*kept)
    shared = df.sparkSession.sparkContext.broadcast(model)  # fixed size: BUCKETS x languages
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + ", lang_pred string, score double"
    at = kept.index("text")

    def work(batch: pa.RecordBatch) -> dict:
        names, scores = shared.value.predict(batch.column(at).to_pylist())
        return dict(zip(kept, batch.columns)) | {"lang_pred": pa.array(names, pa.string()), "score": pa.array(scores)}

    return map_rows(df, schema, work)


def learning_rows(docs: DataFrame) -> DataFrame:
    return docs.where(crc_fold(F.col("doc_id"), 4) != 2)


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    out = identify(docs.select("doc_id", "text"), fit(learning_rows(docs)))
    return out.select("doc_id", (crc_fold(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score")
