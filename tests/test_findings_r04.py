"""Findings of the fourth round: caps and switches, and what is sent to the driver."""

import itertools
import random
import re
import statistics


def test_favourite_cluster_counts_large_and_single_clusters(spark, tmp_path):
    from tessella.plans import q_scores

    def favourite(rows):
        path = f"{tmp_path}/{len(rows)}"
        spark.createDataFrame(rows, "p_partkey long, p_name string, p_brand string").write.parquet(f"{path}/part.parquet")
        return [tuple(r) for r in q_scores.favourite_cluster(spark, path).collect()]

    many = [(i, "steel ring" if i % 2 else "bolt", "Brand#11") for i in range(1200)]
    few = [(5000 + i, "Ring", "Brand#12") for i in range(3)]
    assert favourite(many + few) == [(11, 600)]
    assert favourite([(1, "a ring", "Brand#13"), (2, "bolt", "Brand#14"), (3, "bolt", "Brand#14")]) == [(13, 1)]


def test_members_of_a_cluster_are_one_line(spark):
    from tessella.sources import writers as wr

    rows = [(1, i) for i in range(25_000)] + [(1, 7), (2, 5), (2, None), (3, None), (None, 4)]
    member = spark.createDataFrame(rows, "k int, row_id long").repartition(5)
    got = sorted(r["line"] for r in wr.member_lines(member, "row_id").collect())
    assert got == sorted(["1\t" + "\t".join(map(str, range(25_000))), "2\t5", "3", "4"])


def recorded_plans(monkeypatch, module):
    """Plans by label of what ``module`` writes."""
    plans, real = {}, module.materialize

    def spy(df, label="stage"):
        plans[label] = df._jdf.queryExecution().executedPlan().toString()
        return real(df, label)

    monkeypatch.setattr(module, "materialize", spy)
    return plans


def test_near_copies_broadcast_no_keyed_nodes(spark, monkeypatch):
    from tessella.llm import simhash

    plans = recorded_plans(monkeypatch, simhash)
    words = [f"w{i}" for i in range(60)]
    texts = {1: words, 2: [*words, "x"], 3: words[::-1], 4: words}
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in texts.items()], "doc_id long, text string")
    assert sorted(r["doc_id"] for r in simhash.keep_one(docs).collect()) == [1, 3]
    assert {"star", "rest", "possible", "held", "kept"} <= set(plans)
    assert not [label for label, p in plans.items() if "Broadcast" in p]


def test_hard_negatives_broadcast_no_trees_or_anchors(spark, monkeypatch):
    from pyspark.sql import functions as F

    from tessella.llm import hard_negatives as hn

    plans = recorded_plans(monkeypatch, hn)
    points = [(i, i % 2, [i % 7, 3 * i % 11, 5]) for i in range(60)]
    found = hn.mine(spark.createDataFrame(points, "vec_id long, label long, vec array<int>"), F.col("vec_id") < 6)
    plans["found"] = found._jdf.queryExecution().executedPlan().toString()
    assert all("MapInArrow" in plans[x] and not re.search(r"BroadcastHashJoin \[[^\]]*(stripe|key)#", plans[x]) for x in ("positives", "found"))
    assert found.count() > 0


def test_variance_null_draws_every_set_of_rows(spark):
    from tessella.operators import enrich as en

    values = [0.0, 0.0, 0.0, 0.0, 60.0, 60.0]  # rows next to each other in the order of ``draws`` spread less
    m = spark.createDataFrame([(i, 1, v) for i, v in enumerate(values)], "row_id long, col_id int, value double")
    sizes = spark.createDataFrame([(2,), (4,), (6,)], "n long")
    got = {r["n"]: (r["mean_var"], r["sd_var"]) for r in en.variance_null(m, sizes, "n", 2000).collect()}
    for n, (mean, sd) in got.items():
        every = [statistics.variance(x) for x in itertools.combinations(values, n)]
        assert abs(mean - statistics.mean(every)) <= 4 * statistics.pstdev(every) / 2000**0.5 + 1e-9
        assert abs(sd - statistics.pstdev(every)) <= 0.1 * statistics.pstdev(every) + 1e-9
    assert set(got) == {2, 4, 6}


def test_samples_are_the_first_rows_by_key():
    import numpy as np

    from tessella.operators import enrich as en

    place, draw = np.arange(5000), random.Random(4)
    for size in (1, 17, 2500, 4999, 5000, 9000):
        a, b = (np.uint32(draw.getrandbits(32)) for _ in "ab")
        last = en._last_key(5000, size, a, b, step=700)
        keys = en._sample_keys(place, a, b)
        assert len(set(keys.tolist())) == 5000
        held = en._Sampled([a], [b], [last]).holds(place)
        assert set(place[held]) == set(np.argsort(keys)[:size])


def test_manhattan_sums_need_no_pairs():
    import time

    import numpy as np

    from tessella.operators import tiles

    draw = np.random.default_rng(3)
    x, y = draw.normal(size=(300, 5)) + 1e6, draw.normal(size=(200, 5)) + 1e6
    y[:40], y[40:60] = x[7], x[7] + 1e-9  # copies and near copies
    x[20:60] = x[7]
    first = np.array([0, 40, 60, 61, 190])
    want = np.add.reduceat(tiles.pairwise_distance(x, y, "manhattan"), first, axis=1)
    got = tiles._manhattan_sums(x, y, first)
    assert np.allclose(got, want, rtol=1e-9, atol=0) and (got[20:60, 0] == 0).all()
    x, y = draw.normal(size=(2, 15_000, 16))
    began = time.process_time()
    tiles._manhattan_sums(x, y, np.arange(0, 15_000, 1500))
    assert time.process_time() - began < 4  # all pairs take over 10 s


def test_manhattan_row_scores_leave_out_the_row_itself(spark):
    import numpy as np

    from tessella.operators import tiles

    draw = np.random.default_rng(5)
    x = draw.normal(size=(90, 4))
    x[50] = x[10]
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "row_id long, vec array<double>")
    member = [(i % 2, i) for i in range(80)] + [(1, 10), (0, 10)]
    got = {(r["row_id"], r["k"]): (r["total"], r["n"]) for r in tiles.member_means(vectors, spark.createDataFrame(member, "k int, row_id long"), 4, "dist.manhattan").collect()}
    assert len(got) == 180
    for (row, k), (total, n) in got.items():
        others = [m for c, m in member if c == k and m != row]
        assert n == len(others) and abs(total - sum(np.abs(x[row] - x[m]).sum() for m in others)) < 1e-9


def test_co_occurrence_broadcasts_no_copied_blocks(spark):
    from tessella.operators import tiles

    long = spark.createDataFrame([(g, x) for g in range(3) for x in range(4 + g)], "g int, x long")
    got = tiles.co_occurrence(long, ["g"], "x", 2)
    assert "Broadcast" not in got._jdf.queryExecution().executedPlan().toString()
    assert sum(r["n"] for r in got.collect()) == 6 + 10 + 15
