"""Hits stay in their tasks, and sizes carried with them equal sizes joined to them."""

import random

from pyspark.sql import functions as F

from tessella.operators import motifs as mo

PSSM = "k int, mot int, pos int, a double, c double, g double, t double"


def some(spark, ids, lengths):
    draw = random.Random(5)
    seqs = spark.createDataFrame([(i, "".join(draw.choices("ACGT", k=n))) for i, n in zip(ids, lengths)], "id string, seq string")
    rows = []
    for k in (1, 2):
        for pos in range(1, 9):
            p = [draw.random() ** 3 + 0.01 for _ in range(4)]
            rows.append((k, 1, pos, *[x / sum(p) for x in p]))
    return seqs, spark.createDataFrame(rows, PSSM)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_short_sequences_send_no_hits_through_a_shuffle(spark):
    seqs, pssm = some(spark, [f"s{i}" for i in range(30)], [170] * 30)
    hits = mo.scan_pssm(seqs, pssm, cutoff=0.05)
    assert "Exchange" not in plan(hits) and hits.count() > 0
    lone = mo.sequence_pvalue(mo.scan_pssm(seqs, pssm, cutoff=0.05, sizes=True))
    assert "Exchange" not in plan(lone) and "Join" not in plan(lone)


def test_carried_sizes_equal_joined_ones(spark):
    # long sequences, a repeated id, one empty row under a used id
    seqs, pssm = some(spark, ["a", "b", "c", "c", "d", "d", "e"], [170, 900, 150, 160, 120, 0, 7])
    lengths = seqs.select("id", F.length("seq").alias("len"))
    widths = pssm.groupBy("k", "mot").agg(F.max("pos").alias("w"))
    plain, sized = mo.scan_pssm(seqs, pssm, cutoff=0.05), mo.scan_pssm(seqs, pssm, cutoff=0.05, sizes=True)
    want = sorted(map(tuple, mo.sequence_pvalue(plain, lengths, widths).collect()))
    assert sorted(map(tuple, mo.sequence_pvalue(sized).collect())) == want and len(want) > 10
    motifs = pssm.groupBy("k", "mot").agg(F.max("a").alias("e_value"))
    joined = mo.motif_positions(plain, lengths, motifs, 1.0, 0.05, 7).collect()
    assert sorted(map(tuple, mo.motif_positions(sized, None, motifs, 1.0, 0.05, 7).collect())) == sorted(map(tuple, joined))
    assert sum(r["n"] for r in joined) == len(want)
