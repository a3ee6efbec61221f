"""Faults that only larger tables showed, each on few rows or a bounded case."""

import math
import random
from collections import Counter

import pandas as pd
from pyspark.sql import functions as F

from tessella.operators import combine as cb
from tessella.operators import enrich as en
from tessella.operators import motifs as mo
from tessella.operators import networks as nw
from tessella.operators import tiles
from tessella.operators.clusters import residual
from tessella.session import recorded


def test_density_of_a_cluster_whose_bandwidth_underflows(spark):
    # exp(-n / 10) is zero from about 7,450 members on
    n = 9000
    scores = spark.range(n + 100).select(F.col("id").alias("row_id"), F.lit(1).alias("k"), (F.col("id") % 97 / 10.0).alias("score"))
    member = spark.range(n).select(F.lit(1).alias("k"), F.col("id").alias("row_id"))
    got = [(r["score"], r["p"]) for r in cb.density_scores(scores, member).withColumnRenamed("score", "p").join(scores, ["row_id", "k"]).select("score", "p").collect()]
    assert len(got) == n + 100 and all(p is not None and math.isfinite(p) and p >= 0 for _, p in got)
    assert abs(sum(p for _, p in got) - 1) < 1e-9
    by = dict(got)
    assert by[0.0] > by[4.8] > by[9.6]


def cells(spark, rows=40, cols=9):
    """Gaps, one NaN, and one row that comes twice."""
    draw = random.Random(3)
    at = [(r, f"c{c}", draw.gauss(r % 3, 1.0)) for r in range(rows) for c in range(cols) if draw.random() > 0.15]
    return spark.createDataFrame(at + [x for x in at if x[0] == 5], "row_id long, col_id string, value double")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_random_residuals_equal_listed_blocks(spark, monkeypatch):
    m = cells(spark)
    shapes = spark.createDataFrame([(4, 0, 5), (4, 1, 8), (1, 0, 3), (60, 1, 9)], "nrows long, _b int, _c long")
    monkeypatch.setattr(en, "DRAWN_CELLS", 70)  # several blocks
    got = {(r["nrows"], r["_b"], r["draw"]): r["resid"] for r in en.random_residuals(m, shapes, 6, 2).collect()}
    rows = en.draws(m, "row_id", shapes, "nrows", 6, 2).join(shapes, "nrows")
    cols = en.draws(m, "col_id", shapes, "_c", 6, 3).join(shapes, "_c")
    key = F.struct("nrows", "_b", "draw").alias("k")
    want = {tuple(r["k"]): r["resid"] for r in residual(m, rows.select(key, "row_id"), cols.select(key, "col_id")).collect()}
    assert len(want) == 24 and got.keys() == want.keys()
    assert all(abs(got[x] - want[x]) < 1e-9 for x in want)


def test_random_network_sums_equal_listed_ones(spark, monkeypatch):
    draw = random.Random(4)
    e = spark.createDataFrame([(draw.choice("ab"), draw.randrange(30), draw.randrange(30), draw.random()) for _ in range(400)], "net string, src long, dst long, weight double")
    ids, sizes = spark.range(25).select(F.col("id").alias("row_id")), spark.createDataFrame([(6,), (11,), (40,)], "n long")
    monkeypatch.setattr(en, "HELD_CELLS", 60)
    every, sums = en.random_network_sums(e, ids, sizes, "n", 5, 1, per_block=7)
    got = {(r["n"], r["draw"], r["net"]): r["_s"] for r in sums.collect()}
    d = en.draws(ids, "row_id", sizes, "n", 5, 1)
    both = e.join(d.withColumnRenamed("row_id", "src"), "src").join(d.withColumnRenamed("row_id", "dst"), ["n", "draw", "dst"])
    want = {(r["n"], r["draw"], r["net"]): r["s"] for r in both.groupBy("n", "draw", "net").agg(F.sum("weight").alias("s")).collect()}
    assert every.count() == 15 and len(want) > 20 and got.keys() == want.keys()
    assert all(abs(got[x] - want[x]) < 1e-9 for x in want)


def test_drawn_variances_equal_listed_ones(spark, monkeypatch):
    m = cells(spark).unionByName(spark.createDataFrame([(3, "c0", float("nan")), (4, "c1", None)], "row_id long, col_id string, value double"))
    sizes = spark.createDataFrame([(2,), (9,), (70,)], "n long")
    monkeypatch.setattr(en, "DRAWN_CELLS", 40)
    shown = lambda df: {(r["n"], r["draw"], r["col_id"]): "nan" if r["_v"] is not None and math.isnan(r["_v"]) else r["_v"] for r in df.collect()}
    made = en.drawn_variances(m, sizes, "n", 4, 1)
    got = shown(made)
    want = shown(m.join(en.draws(m, "row_id", sizes, "n", 4, 1), "row_id").groupBy("n", "draw", "col_id").agg(F.var_samp("value").alias("_v")))
    assert got.keys() == want.keys() and "nan" in want.values() and None in want.values()
    assert all(got[x] == want[x] or abs(got[x] - want[x]) < 1e-9 for x in want)
    assert "Generate" not in plan(made)  # the drawn rows are not listed


def test_factors_of_networks_do_not_gather_a_network_in_a_task(spark):
    e = spark.createDataFrame([("a", 1, 2, 1.0), ("a", 2, 3, 3.0), ("b", 1, 2, 8.0)], "net string, src long, dst long, weight double")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = nw.equalize_networks(e)
        assert "SortMergeJoin" not in plan(out)
        assert sorted((r["net"], r["weight"]) for r in out.collect()) == [("a", 2.0), ("a", 6.0), ("b", 8.0)]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_words_counted_a_few_letters_at_a_time(spark):
    draw = random.Random(6)
    texts = ["".join(draw.choices("ACGTN", [5, 5, 5, 5, 1], k=n)) for n in (0, 2, 3, 7, 8, 9, 50)] + [None]
    want = Counter(t[i:i + 3] for t in texts if t for i in range(len(t) - 2))
    total = sum(want.values())
    df = spark.createDataFrame([(t,) for t in texts], "seq string").coalesce(1)
    for counted in (1, 4, 7, 1000):
        got = {r["kmer"]: r["n"] for r in mo.kmer_counts(df, 3, counted).collect()}
        assert got.pop(None) == total
        assert got == {w: n for w, n in want.items() if "N" not in w}


def test_words_come_as_one_list_an_id(spark):
    draw = random.Random(7)
    rows = [(i % 12 if i % 5 else None, "".join(draw.choices("ACGTN", [5, 5, 5, 5, 1], k=n))) for i, n in enumerate([0, 3, 4, 30, 40, 700] * 4)]
    seqs = spark.createDataFrame([*rows, (50, None)], "id long, seq string")
    got = {r["row_id"]: sorted(r["words"]) for r in mo.distinct_words(seqs, 4).collect() if r["words"]}
    want = {}
    for i, s in rows:
        want.setdefault(i, set()).update(sum("ACGT".index(x) * 4 ** (3 - j) for j, x in enumerate(w)) for p in range(len(s) - 3) if "N" not in (w := s[p:p + 4]))
    assert got == {i: sorted(w) for i, w in want.items() if w}


def test_motif_sites_are_counted_within_the_members(spark):
    draw = random.Random(8)
    seqs = [(i, "".join(draw.choices("ACGT", k=60)) + ("ACGTGG" if i < 8 else "") + "".join(draw.choices("ACGT", k=300))) for i in range(40)] + [(3, "TTACGTGGAACGTGG")]
    member = [(1, i) for i in range(8)] + [(2, i) for i in range(20, 32)] + [(1, 0), (2, 5)]
    motifs, pssm = mo.discover_kmers(spark.createDataFrame(seqs, "id long, seq string"), spark.createDataFrame(member, "k int, row_id long"), 6)
    assert "explode(sequence" not in plan(motifs)  # windows are not listed
    letters = {(r["k"], r["mot"], r["pos"]): [r[x] for x in "acgt"] for r in pssm.collect()}
    assert len(letters) == 24
    for r in motifs.collect():
        own = {i for k, i in member if k == r["k"]}
        windows = [s[p:p + 6] for i, s in seqs if i in own for p in range(len(s) - 5)]
        sites = [w for w in windows if sum(a != b for a, b in zip(w, r["kmer"])) <= 1]
        assert r["nsites"] == len(sites)
        for p in range(6):
            assert all(abs(got - (sum(w[p] == x for w in sites) + 0.25) / (len(sites) + 1)) < 1e-12 for x, got in zip("ACGT", letters[r["k"], r["mot"], p + 1]))


def test_motif_ranks_come_from_one_shuffle(spark):
    draw = random.Random(9)
    rows = []
    for k in range(20):
        for pos in range(1, 6 + k % 4):
            p = [round(draw.random(), 1) + 0.1 for _ in range(4)]
            rows.append((k, 1, pos, *[x / sum(p) for x in p]))
    pssm = spark.createDataFrame(rows, "k int, mot int, pos int, a double, c double, g double, t double")
    with recorded() as made:
        few = mo.motif_similarity(pssm, 4, 0.3)
    assert [x.rsplit("/", 1)[1].split("-")[0] for x in made] == ["motifs"]
    every = mo.motif_similarity(pssm, 4, 1e9).collect()  # all alignments, ranked
    n = Counter(r["overlap"] for r in every)
    assert len(n) > 3 and min(n.values()) < 1000 < sum(n.values())
    key = lambda r: (r["k1"], r["k2"], r["orientation"], r["offset"])
    want = {}
    for r in every:
        pool = [x["score"] for x in every if abs(x["overlap"] - r["overlap"]) <= (n[r["overlap"]] < 1000)]
        above = sum(s > r["score"] for s in pool)
        p = above / len(pool) * r["n_tests"] / 4
        assert abs(p - r["p_value"]) < 1e-12
        if above < 0.3 * (len(pool) - 1) and p <= 0.3:
            want[key(r)] = p
    got = {key(r): r["p_value"] for r in few.collect()}
    assert got.keys() == want.keys() and len(want) > 100


def test_correlations_of_named_items(spark):
    draw = random.Random(10)
    rows = [(r, x, draw.gauss(0, 1) + r / 9) for r in range(60) for x in "abcde" if draw.random() > 0.2] + [(1, "f", 2.0), (2, "f", None)]
    df = spark.createDataFrame(rows, "row_id long, k string, score double")
    out = tiles.column_correlations(df, "row_id", "k", "score")
    assert "MapInArrow" in plan(out)
    wide = pd.DataFrame(rows, columns=["r", "k", "s"]).pivot(index="r", columns="k", values="s")
    got = {(r["a"], r["b"]): (r["r"], r["n"]) for r in out.collect()}
    assert set(got) == {(a, b) for a in "abcde" for b in "abcde" if a < b}
    for (a, b), (r, n) in got.items():
        assert n == wide[[a, b]].dropna().shape[0] and abs(r - wide[a].corr(wide[b])) < 1e-9
