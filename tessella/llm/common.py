"""Shared pieces: Arrow text access in bounded blocks, hash splits, connected components."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.session import materialize

#: Bytes of text that one numpy step works on. A longer document is a block of its own.
BLOCK_BYTES = 1 << 20
#: Rows and bytes of an Arrow batch: what a Python worker holds at once, several times over while it works. A batch ends at
#: the row with which it reaches either; a longer document is a batch of its own.
BATCH_ROWS = 1000
BATCH_BYTES = 4 << 20
#: Maps A-Z to a-z in UTF-8 bytes and leaves all else.
ASCII_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def crc_fold(id_col: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds`` (a null id counts as the empty text)."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % folds


def blocks(texts: list[str | bytes | None], limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges whose texts hold at most ``limit`` bytes or characters together, one row at least."""
    lo, total = 0, 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if i > lo and total + n > limit:
            yield lo, i
            lo, total = i, 0
        total += n
    if lo < len(texts):
        yield lo, len(texts)


def utf8(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text; a null is empty."""
    return column.fill_null("").cast(pa.large_binary()).to_pylist()


def map_rows(df: DataFrame, schema: T.StructType | str, work: Callable[[pa.RecordBatch], dict[str, object]]) -> DataFrame:
    """``work`` on every Arrow batch; it returns the output columns by name."""
    schema = schema if isinstance(schema, T.StructType) else T._parse_datatype_string(schema)
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                out = work(batch)
                yield pa.RecordBatch.from_arrays([c if isinstance(c := out[f.name], pa.Array) else pa.array(c, f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(run, schema)


def bounded_sample(df: DataFrame, by: str, per_value: int, id_col: str = "doc_id") -> DataFrame:
    """About ``per_value`` rows of each value of ``by``, chosen by a hash of the id: the same rows on every run.

    Only for fitting a model. The counts that set the rates cover all rows. The ids are chosen on narrow rows and sent to
    the wide ones, about ``per_value`` for each value, so no text is shuffled and no value gathers its rows in a task.
    """
    rates = df.groupBy(by).agg(F.least(F.lit(1.0), per_value / F.count(F.lit(1))).alias("__rate"))
    unit = F.pmod(F.xxhash64(F.lit(11), F.col(id_col)), F.lit(1 << 30)) / float(1 << 30)
    chosen = df.select(id_col, by).join(rates, by).where(unit < F.col("__rate")).select(F.col(id_col).alias("__id")).distinct()
    return df.join(F.broadcast(chosen), F.col(id_col) == F.col("__id")).drop("__id")


def components(links: DataFrame, label: str = "components") -> DataFrame:
    """Connected components of ``links(a, b)`` (long): one row (node, component) per node, component the smallest node.

    Alternates large-star and small-star steps on tables in the shared folder until the edge set stands still, so the
    rounds grow with the logarithm of the longest path. Stars are built by joins and minima, never by lists, and a node
    of very high degree is one more key for adaptive skew splitting. No cap on rounds.
    """
    edges = materialize(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), label)
    before = None
    while True:
        now = edges.agg(F.count(F.lit(1)), F.coalesce(F.bit_xor(F.xxhash64("a", "b")), F.lit(0))).first()
        if now == before or not now[0]:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct()
        before = now
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.first("a"), F.min("b")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = materialize(large, label)
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = materialize(small.unionByName(least.select("a", F.col("m").alias("b"))).distinct(), label)


def popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)


def keep_best(score: np.ndarray, found: np.ndarray, row: np.ndarray, new_score: np.ndarray, new_id: np.ndarray) -> None:
    """Takes new (row, score, id) entries into tables of the best of each row, in place: highest score, then smallest id."""
    changed, keep = np.unique(row), score.shape[1]
    row = np.concatenate((row, np.repeat(changed, keep)))
    new_score, new_id = np.concatenate((new_score, score[changed].ravel())), np.concatenate((new_id, found[changed].ravel()))
    by = np.lexsort((new_id, -new_score, row))
    row, new_score, new_id = row[by], new_score[by], new_id[by]
    nth = np.arange(len(row)) - np.searchsorted(row, row)
    first = nth < keep
    score[row[first], nth[first]], found[row[first], nth[first]] = new_score[first], new_id[first]
