"""Headline timings: one JSON line. BENCH_SF_DIR picks the data, BENCH_CPUS the local cores."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import functions as F

from tessella.config import Settings
from tessella.operators import motifs as mo
from tessella.plans import tables as t
from tessella.plans.biclustering import BiclusterRun
from tessella.plans.catalog import REGISTRY
from tessella.session import build_session, materialize

HEADLINE = [
    "residual", "filter_unchanged", "zscore_rows", "row_scores", "row_scores_packed", "col_scores", "all_scores_row",
    "network_scores", "prepare_networks", "group_network_scores", "combine_scores", "quantile_normalize", "density_scores_rows",
    "row_scores_correlation", "score_correlation_pairs", "cooccurrence_cloud", "enrich_terms", "cluster_summary",
    "resolve_aliases", "noncoding_upstream", "overlapping_regions", "promoter_window_upstream", "background_model",
    "scan_pssm", "aic_filter", "prediction_rmsd",
]


def loop_iteration(spark, sf: str) -> float:
    """Mean time of iterations 2-6 of a run with 2,072 rows, 268 columns and 250 clusters.

    Row and column refreshes and one set of statistics fall into it, a network refresh or a motif search does not.
    """
    li = t.read(spark, sf, "lineitem")
    m = li.groupBy((F.col("l_partkey") % 2072).alias("row_id"), (F.xxhash64("l_orderkey", "l_linenumber") % 134 + 134).cast("int").alias("col_id")).agg(F.avg("l_extendedprice").alias("p")).select("row_id", "col_id", F.log("p").alias("value"))
    e = li.select((F.col("l_partkey") % 2072).alias("src"), (F.col("l_suppkey") * 7 % 2072).alias("dst")).where("src <> dst").groupBy("src", "dst").agg(F.count(F.lit(1)).cast("double").alias("weight"))
    run = BiclusterRun(spark, {"ratios": m}, Settings(n_clusters=250, n_iter=2000, stats_every=5), networks={"n": e}).seed("random")
    run.step()
    t0 = time.time()
    run.run(5)
    return (time.time() - t0) / 5


def similarity_150(spark, sf: str) -> float:
    """All-pairs comparison of 150 motifs, p <= 0.1."""
    c = t.contigs(spark, sf).select((F.col("contig") % 75).cast("int").alias("k"), "seq")
    cut = [(1, F.split("seq", "GAT")), (2, F.split("seq", "CCA"))]
    parts = [c.select("k", F.lit(mot).alias("mot"), F.explode(F.slice(p, F.lit(2), F.size(p))).alias("s")) for mot, p in cut]
    sites = parts[0].unionByName(parts[1]).where(F.length("s") >= 12)
    pos = sites.select("k", "mot", F.posexplode(F.split(F.substring("s", 1, 12), "")).alias("pos", "b")).withColumn("pos", F.col("pos") + 1)
    pssm = pos.groupBy("k", "mot", "pos").agg(*[F.avg((F.col("b") == x).cast("double")).alias(x.lower()) for x in "ACGT"])
    pssm = materialize(pssm, "pssm")
    t0 = time.time()
    mo.motif_similarity(pssm, 6, 0.1).write.format("noop").mode("overwrite").save()
    return time.time() - t0


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", f"local[{cpus}]", **{"spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": "16g"})
    spark.sparkContext.setLogLevel("OFF")
    spark.read.parquet(f"{sf}/lineitem.parquet").groupBy("l_returnflag").count().collect()
    times: dict[str, float] = {}
    for name in HEADLINE:
        t0 = time.time()
        REGISTRY[name][0](spark, sf).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t0, 3)
    times["motif_similarity_150"] = round(similarity_150(spark, sf), 3)
    times["loop_iteration_2072x268_k250"] = round(loop_iteration(spark, sf), 3)
    print(json.dumps({"metric": "total_headline_time", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": sf.rsplit("sf", 1)[-1]}))
    spark.stop()


if __name__ == "__main__":
    main()
