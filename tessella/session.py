"""Session helpers: shared scratch folder, durable intermediate tables, tuned builder."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

SESSION_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(app: str = "tessella", master: str | None = None, **conf) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, val in {**SESSION_CONF, **conf}.items():
        builder = builder.config(key, val)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach: the cluster's ``spark.checkpoint.dir``.

    A temporary folder is made only for local sessions that name none.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    made = tempfile.mkdtemp(prefix="tessella-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


_RECORDS: list[list[str]] = []


@contextmanager
def recorded() -> Iterator[list[str]]:
    """Collects the scratch folders that are named inside the block."""
    made: list[str] = []
    _RECORDS.append(made)
    try:
        yield made
    finally:
        _RECORDS.remove(made)


def drop_unused(spark: SparkSession, paths: list[str], frames: Iterable[DataFrame]) -> list[str]:
    """Deletes those of the scratch folders ``paths`` that none of ``frames`` reads, and returns the others."""
    read = {f.rsplit("/", 2)[-2] for df in frames for f in df.inputFiles()}
    kept = [p for p in paths if p.rsplit("/", 1)[-1] in read]
    for p in set(paths) - set(kept):
        folder = spark._jvm.org.apache.hadoop.fs.Path(p)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    return kept


def scratch_path(spark: SparkSession, label: str) -> str:
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    for made in _RECORDS:
        made.append(path)
    return path


#: Deletes the shuffle files of a query when it ends.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize(df: DataFrame, label: str = "stage") -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Cuts lineage and pins non-repeatable steps (sampled range bounds, sketches), so a lost
    executor can never make two consumers see two versions of the same intermediate. Nothing reads the
    shuffles of the write again, so their files go with it and not only when the driver collects garbage.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    before = spark.conf.get(SHUFFLE_CLEANUP, "false")
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(SHUFFLE_CLEANUP, before)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Bytes of an Arrow batch where the rows are whole texts or sequences.
BATCH_BYTES = 4 << 20


def small_batches(df: DataFrame) -> DataFrame:
    """``df`` itself; Python tasks get at most BATCH_BYTES of it at a time, since 10,000 long rows are too much."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Hash partition by ``keys`` into the configured number of shuffle partitions.

    Grouped Python stages are heavy on compute and light on bytes, and size-based coalescing would run
    them in a few tasks. The grouping reuses this partitioning, so no shuffle is added.
    """
    spark = df.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions", "200")), spark.sparkContext.defaultParallelism)
    return df.repartition(n, *keys)
