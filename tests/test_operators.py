import itertools

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessella.operators import clusters as cl
from tessella.operators import combine as cb
from tessella.operators import enrich as en
from tessella.operators import genome as ge
from tessella.operators import membership as mb
from tessella.operators import motifs as mo
from tessella.operators import networks as nw
from tessella.operators import scores as sc
from tessella.operators import seeding as sd
from tessella.operators import tiles


def long(spark, x):
    rows = [(i, j, float(v)) for i, r in enumerate(x) for j, v in enumerate(r) if np.isfinite(v)]
    return spark.createDataFrame(rows, "row_id long, col_id int, value double")


def members(spark, sets, axis="row_id", kind="long"):
    return spark.createDataFrame([(k, int(i)) for k, s in sets.items() for i in s], f"k int, {axis} {kind}")


def test_residual_of_additive_matrix_is_zero(spark):
    x = np.arange(4)[:, None] * 2.0 + np.arange(5)[None, :] ** 2
    m = long(spark, x)
    got = cl.residual(m, members(spark, {1: range(4), 2: [0]}), members(spark, {1: range(5), 2: range(5)}, "col_id", "int")).collect()
    by = {r["k"]: r["resid"] for r in got}
    assert abs(by[1]) < 1e-12 and by[2] == 1.0


def test_constant_column_scores_zero(spark):
    x = np.array([[1.0, 2.0], [1.0, 4.0], [1.0, 9.0]])
    got = {r["col_id"]: r["score"] for r in sc.col_scores(long(spark, x), members(spark, {1: range(3)})).collect()}
    assert got[0] == 0 and got[1] > 0


def test_duplicate_edges_modes(spark):
    e = spark.createDataFrame([("n", "a", "b", 1.0, 1), ("n", "a", "b", 2.0, 2), ("n", "a", "b", 4.0, 3)], "net string, src string, dst string, weight double, at int")
    assert nw.merge_duplicate_edges(e).first()["weight"] == 7
    assert nw.merge_duplicate_edges(e, compat=True, position="at").first()["weight"] == 6


def test_symmetrize_is_idempotent(spark):
    e = spark.createDataFrame([("n", 1, 2, 1.0), ("n", 2, 1, 5.0), ("n", 3, 4, 2.0)], "net string, src int, dst int, weight double")
    once = nw.symmetrize_edges(e)
    assert sorted(once.collect()) == sorted(nw.symmetrize_edges(once).collect())


def test_components_of_a_long_chain_and_a_hub(spark):
    chain = [(i, i + 1) for i in range(100, 160)]
    hub = [(0, i) for i in range(1, 60)]
    got = {r["node"]: r["label"] for r in nw.connected_components(spark.createDataFrame(chain + hub, "src int, dst int")).collect()}
    assert all(got[i] == 100 for i in range(100, 161)) and all(got[i] == 0 for i in range(60))


def test_group_scores_equal_the_expanded_pairs(spark):
    rng = np.random.default_rng(1)
    grp = [("n", int(g), int(r), float(rng.integers(1, 9))) for g in range(6) for r in rng.choice(40, rng.integers(1, 20), replace=False)]
    mem = {k: rng.choice(40, 8, replace=False) for k in (1, 2)}
    got = {(r["row_id"], r["k"]): r["score"] for r in sc.group_network_scores(spark.createDataFrame(grp, "net string, group_id int, row_id long, weight double"), members(spark, mem), 15).collect()}
    want: dict = {}
    for g in range(6):
        rows = [(r, w) for _, gg, r, w in grp if gg == g]
        if 1 < len(rows) <= 15:
            for (a, wa), (b, wb) in itertools.permutations(rows, 2):
                for k, s in mem.items():
                    if a in s:
                        want[(b, k)] = want.get((b, k), 0) + (wa + wb) / 2
    assert set(got) == set(want)
    assert all(np.isclose(got[x], -np.log(want[x] / 8 + 1)) for x in want)


def test_density_sums_to_one_and_follows_the_tail(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(200, 2))
    s = spark.createDataFrame([(i, k + 1, float(x[i, k])) for i in range(200) for k in range(2)], "row_id long, k int, score double")
    got = cb.density_scores(s, members(spark, {1: range(40)})).toPandas()
    assert np.allclose(got.groupby("k")["score"].sum(), 1)
    assert np.allclose(got[got["k"] == 2]["score"], 1 / 200)
    bw = 2 * max((x.max() - x.min()) / 100, 0.001) * 10 * np.exp(-4.0)
    from math import erf, sqrt
    tail = np.array([np.mean([0.5 - 0.5 * erf((v - m) / bw / sqrt(2)) for m in x[:40, 0]]) for v in x[:, 0]])
    one = got[got["k"] == 1].set_index("row_id").sort_index()["score"].to_numpy()
    assert np.corrcoef(one, tail)[0, 1] > 0.995


def test_quantile_normalize_gives_equal_distributions(spark):
    rng = np.random.default_rng(5)
    rows = [(s, i, 1, float(v)) for s, f in (("a", 1), ("b", 5)) for i, v in enumerate(rng.normal(size=50) * f)]
    got = cb.quantile_normalize(spark.createDataFrame(rows, "set string, row_id long, k int, score double")).toPandas()
    a, b = (np.sort(got[got["set"] == s]["score"]) for s in "ab")
    assert np.allclose(a, b)


def test_slot_rule():
    gain = {1: 0.1, 2: 0.2, 3: 0.9, 4: 0.8}
    assert mb.choose_slot([1, 0], [3, 4], gain, 0.5, set(), True) == [1, 4]
    assert mb.choose_slot([1, 1], [3, 4], gain, 0.5, set(), True) == [3, 1]
    assert mb.choose_slot([1, 2], [3, 4], gain, 0.5, set(), True) == [3, 2]
    assert mb.choose_slot([1, 2], [3, 4], gain, 0.5, {1}, True) == [1, 2]
    assert mb.choose_slot([3, 4], [3, 4], gain, 0.5, set(), True) == [3, 4]


def serial_adjust(score, rows, q, limit, expand_only, max_rows):
    rows = set(rows)
    inside = lambda: [score[r] for r in rows]
    wh = [r for r in range(len(score)) if r not in rows and score[r] < np.quantile(inside(), q)]
    if len(wh) > limit:
        return rows
    tries = 0
    while wh and tries < 50:
        new = max(wh, key=lambda r: score[r])
        worst = max(rows, key=lambda r: score[r])
        rows.add(new)
        if not expand_only:
            rows.discard(worst)
        wh = [r for r in range(len(score)) if r not in rows and score[r] < np.quantile(inside(), q)]
        if len(rows) > max_rows:
            break
        tries += 1
    return rows


@pytest.mark.parametrize("expand", [True, False])
def test_adjust_matches_the_serial_rule(spark, expand):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(900, 3))
    mem = {k + 1: rng.choice(900, n, replace=False) for k, n in enumerate((400, 60, 20))}
    s = spark.createDataFrame([(i, k + 1, float(x[i, k])) for i in range(900) for k in range(3)], "row_id long, k int, score double")
    ch = mb.adjust_clusters(s, members(spark, mem), limit=400, expand_only=expand, max_rows=10_000)
    got = mb.apply_changes(members(spark, mem), ch).toPandas()
    for k in mem:
        assert set(got[got["k"] == k]["row_id"]) == serial_adjust(x[:, k - 1], mem[k], 0.33, 400, expand, 10_000)


def test_correlated_seeds_match_serial_picks(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(60, 12))
    got = sd.seed_correlated(long(spark, x), 5, 6).toPandas()
    seeds = sd._pick_seeds(spark.createDataFrame([(i,) for i in range(60)], "row_id long"), 5, 1).toPandas().set_index("k")["row_id"]
    r, used = np.corrcoef(x), set(seeds)
    for k in range(1, 6):
        order = [i for i in np.argsort(-r[seeds[k]], kind="stable") if i not in used]
        want = set(order[:5])
        used |= want
        assert set(got[got["k"] == k]["row_id"]) == want | {seeds[k]}


def test_random_seeds_are_distinct(spark):
    u = spark.createDataFrame([(i,) for i in range(50)], "row_id long")
    got = sd.seed_random(u, 7, 3).toPandas()
    assert (got.groupby("row_id")["k"].nunique() == 3).all() and got["k"].between(1, 7).all()


def test_pairwise_measures_with_gaps():
    rng = np.random.default_rng(0)
    x, y = rng.normal(size=(5, 9)), rng.normal(size=(4, 9))
    x[1, 2] = y[3, 5] = np.nan
    r = tiles.pairwise_corr(x, y)
    for i in range(5):
        for j in range(4):
            ok = np.isfinite(x[i]) & np.isfinite(y[j])
            assert np.isclose(r[i, j], np.corrcoef(x[i, ok], y[j, ok])[0, 1])
    d = tiles.pairwise_distance(x, y)
    ok = np.isfinite(x[1])
    assert np.isclose(d[1, 0], np.sqrt(((x[1, ok] - y[0, ok]) ** 2).sum() * 9 / 8))


def test_reverse_complement(spark):
    df = spark.createDataFrame([("AACGT",)], "seq string")
    rc = df.select(ge.reverse_complement("seq").alias("seq"))
    assert rc.first()["seq"] == "ACGTT"
    assert rc.select(ge.reverse_complement("seq")).first()[0] == "AACGT"


def test_operon_heads(spark):
    f = spark.createDataFrame([("a", "c", "D", 10, 20), ("b", "c", "D", 30, 40), ("x", "c", "R", 10, 20), ("y", "c", "R", 30, 40), ("p", "c", "D", 1, 2), ("q", "c", "R", 3, 4)], "id string, contig string, strand string, start_pos long, end_pos long")
    o = spark.createDataFrame([("1", "a"), ("1", "b"), ("2", "x"), ("2", "y"), ("3", "p"), ("3", "q")], "operon string, row_id string")
    assert {r["operon"]: r["head"] for r in ge.operon_heads(o, f).collect()} == {"1": "a", "2": "y"}


def test_windows_crossing_segments(spark):
    seq = "".join(np.random.default_rng(1).choice(list("ACGT"), 300))
    c = spark.createDataFrame([("c", seq)], "contig string, seq string")
    r = spark.createDataFrame([("x", "c", 55, 140), ("y", "c", -5, 10), ("z", "c", 290, 400)], "id string, contig string, start long, end long")
    got = {x["id"]: x["seq"] for x in ge.cut_ranges(r, c, size=32).collect()}
    assert got == {"x": seq[54:140], "y": seq[:10], "z": seq[289:]}


def test_overlap_masking(spark):
    s = spark.createDataFrame([("a", "ACGTACGTAC", "c", "D", 1, 10), ("b", "TTTTTGGGGG", "c", "D", 6, 15), ("r", "CCCCCAAAAA", "c", "R", 13, 22), ("o", "ACGT", "d", "D", 1, 4)], "id string, seq string, contig string, strand string, start long, end long")
    got = {r["id"]: r["seq"] for r in ge.mask_overlaps(s, bucket=4).collect()}
    # b keeps its letters after position 10; r runs from its end, so its last letters overlap b
    assert got == {"a": "ACGTACGTAC", "b": "NNNNNGGGGG", "r": "CCCCCAANNN", "o": "ACGT"}


def test_low_complexity_and_degenerate(spark):
    s = spark.createDataFrame([("a", "ACGTACGTAAAAAAAAACGTACGT"), ("b", "ACGTTGCA")], "id string, seq string")
    got = {r["id"]: r["seq"] for r in ge.mask_low_complexity(s).collect()}
    assert got["b"] == "ACGTTGCA" and "NNNNNNNN" in got["a"] and got["a"].startswith("ACGT")
    d = ge.degenerate_resolve(spark.createDataFrame([("a", "RYKMSWNACGT" * 30)], "id string, seq string")).first()["seq"]
    assert set(d) == set("ACGT") and all(set(d[i::11]) <= set(v) for i, v in enumerate(["GA", "TC", "GT", "AC", "GC", "AT", "ACGT"]))


def pssm_rows(mats):
    return [(k, m, i + 1, *map(float, row)) for (k, m), mat in mats.items() for i, row in enumerate(mat)]


PSSM = "k int, mot int, pos int, a double, c double, g double, t double"


def test_consensus_levels(spark):
    p = spark.createDataFrame(pssm_rows({(1, 1): [[0.9, 0.05, 0.03, 0.02], [0.2, 0.5, 0.2, 0.1], [0.3, 0.25, 0.25, 0.2]]}), PSSM)
    assert mo.consensus(p).first()["consensus"] == "Acn"


def test_scan_matches_brute_force(spark):
    rng = np.random.default_rng(8)
    mats = {(1, 1): rng.dirichlet(np.ones(4), 6), (2, 1): rng.dirichlet(np.ones(4), 9)}
    seqs = {f"s{i}": "".join(rng.choice(list("ACGTN"), n, p=[0.24] * 4 + [0.04])) for i, n in enumerate((700, 40, 256, 5))}
    got = mo.scan_pssm(spark.createDataFrame(list(seqs.items()), "id string, seq string"), spark.createDataFrame(pssm_rows(mats), PSSM), cutoff=1.0).collect()
    best = {(r["id"], r["k"]): (r["pos"], r["strand"], r["score"]) for r in got}
    comp = {"A": "T", "C": "G", "G": "C", "T": "A", "N": "N"}
    for (k, _), m in mats.items():
        lo = np.log2((m + 0.01) / (m + 0.01).sum(axis=1, keepdims=True) / 0.25)
        for sid, s in seqs.items():
            top = None
            for i in range(len(s) - len(m) + 1):
                word = s[i:i + len(m)]
                if "N" in word:
                    continue
                for strand, w in (("+", word), ("-", "".join(comp[c] for c in reversed(word)))):
                    v = sum(lo[j, "ACGT".index(c)] for j, c in enumerate(w))
                    if top is None or v > top[2] + 1e-9:
                        top = (i + 1, strand, v)
            if top is None:
                assert (sid, k) not in best
            else:
                assert np.isclose(best[(sid, k)][2], top[2]) and best[(sid, k)][0] == top[0]


@pytest.mark.parametrize("cutoff", [0.05, 1e-3])
def test_threshold_scan_matches_brute_force(spark, cutoff):
    """Hits under a cutoff, over widths below and above a letter group, against all windows of all sequences."""
    rng = np.random.default_rng(9)
    mats = {(k, 1): rng.dirichlet(np.full(4, 0.4), w) for k, w in enumerate((3, 6, 8, 15))}
    seqs = {f"s{i}": "".join(rng.choice(list("ACGTN"), n, p=[0.24] * 4 + [0.04])) for i, n in enumerate((900, 40, 256, 2, 513))}
    bg = {"A": 0.3, "C": 0.2, "G": 0.2, "T": 0.3}
    got = mo.scan_pssm(spark.createDataFrame(list(seqs.items()), "id string, seq string"), spark.createDataFrame(pssm_rows(mats), PSSM), bg, 2, cutoff).collect()
    comp, want = str.maketrans("ACGT", "TGCA"), {}
    for (k, _), m in mats.items():
        lo = np.log2((m + 0.01) / (m + 0.01).sum(axis=1, keepdims=True) / np.array(list(bg.values())))
        low, tail = mo._null_tail(lo, np.array(list(bg.values())))
        steps, w = np.round(lo / 0.01).astype(int), len(m)
        for sid, s in seqs.items():
            for i in range(len(s) - w + 1):
                for strand, word in (("+", s[i:i + w]), ("-", s[i:i + w].translate(comp)[::-1])):
                    if "N" not in word:
                        at = ["ACGT".index(c) for c in word]
                        p = tail[steps[np.arange(w), at].sum() - low]
                        key = (-round(float(lo[np.arange(w), at].sum()), 6), i + 1, strand)
                        if p <= cutoff and ((sid, k) not in want or key < want[sid, k][0]):
                            want[sid, k] = key, p
    assert {(r["id"], r["k"]): (r["pos"], r["strand"]) for r in got} == {x: v[0][1:] for x, v in want.items()}
    assert all(np.isclose(r["pvalue"], want[r["id"], r["k"]][1]) and np.isclose(-r["score"], want[r["id"], r["k"]][0][0], atol=2e-6) for r in got) and want


def test_scan_null_is_a_tail():
    lo, tail = mo._null_tail(np.log2(np.full((3, 4), 0.25) + np.eye(3, 4) * 0.5), np.full(4, 0.25))
    assert np.isclose(tail[0], 1) and (np.diff(tail) <= 1e-12).all() and np.isclose(tail[-1], 1 / 64)


def average_linkage(names, d, cut):
    groups = [{n} for n in names]
    while True:
        best = min(((np.mean([d(a, b) for a in x for b in y]), i, j) for (i, x), (j, y) in itertools.combinations(enumerate(groups), 2)), default=None)
        if best is None or best[0] > cut:
            return {frozenset(g) for g in groups}
        groups[best[1]] |= groups[best[2]]
        del groups[best[2]]


def test_motif_groups_match_serial_average_linkage(spark):
    rng = np.random.default_rng(11)
    names = [f"m{i:02d}" for i in range(14)]
    pairs = {(a, b): float(rng.uniform(0, 0.9)) for a, b in itertools.combinations(names, 2) if rng.random() < 0.5}
    got = mo.cluster_motifs(spark.createDataFrame([(a, b, p) for (a, b), p in pairs.items()], "a string, b string, p double"), 0.5, 2).toPandas()
    want = {g for g in average_linkage(names, lambda a, b: pairs.get((min(a, b), max(a, b)), 1.0), 0.5) if len(g) >= 2}
    assert {frozenset(g) for _, g in got.groupby("grp")["node"]} == want


def test_draws_have_exact_size(spark):
    u = spark.createDataFrame([(i,) for i in range(300)], "row_id long")
    d = en.draws(u, "row_id", spark.createDataFrame([(5,), (150,), (299,)], "n long"), "n", 4, 1).groupBy("n", "draw").agg(F.countDistinct("row_id").alias("c")).collect()
    assert len(d) == 12 and all(r["c"] == r["n"] for r in d)


def test_planted_word_is_discovered(spark):
    rng = np.random.default_rng(3)
    seqs = [(i, "".join(rng.choice(list("ACGT"), 60)) + ("GATTACAG" if i < 20 else "") + "".join(rng.choice(list("ACGT"), 60))) for i in range(200)]
    mem = members(spark, {1: range(20), 2: range(100, 120)})
    motifs, pssm = mo.discover_kmers(spark.createDataFrame(seqs, "id long, seq string"), mem, 6)
    first = motifs.where("k = 1 and mot = 1").first()["kmer"]
    assert first in "GATTACAG"
    assert np.allclose(pssm.select(F.col("a") + F.col("c") + F.col("g") + F.col("t")).toPandas().to_numpy(), 1)
    assert mo.changed_clusters(mem, members(spark, {1: range(20), 2: range(100, 121)})).toPandas()["k"].tolist() == [2]


def test_similarity_between_tiles_equals_one_tile(spark):
    rng = np.random.default_rng(6)
    mats = {(k, m): rng.dirichlet(np.ones(4) * 0.5, 6 + k % 3) for k in range(12) for m in (1, 2)}
    p = spark.createDataFrame(pssm_rows(mats), PSSM)
    one = mo.motif_similarity(p, 4, 0.3).toPandas()
    many = mo.motif_similarity(p, 4, 0.3, per_tile=5).toPandas()
    key = list(one.columns)
    a, b = (df.sort_values(key).reset_index(drop=True).round(9) for df in (one, many))
    pd.testing.assert_frame_equal(a, b, check_dtype=False)


def test_node_table(spark):
    from tessella.sources import writers as wr

    rows, cols = spark.createDataFrame([(1, 7), (1, 8)], "k int, row_id long"), spark.createDataFrame([(8,)], "col_id int")
    genes = spark.createDataFrame([(7, "seven"), (9, "nine")], "row_id long, name string")
    clusters, motifs = spark.createDataFrame([(1, "first", 2)], "k int, name string, nrow int"), spark.createDataFrame([(1, 2, 6)], "k int, mot int, width int")
    got = wr.node_table(wr.network_nodes(rows, cols, rows), genes, clusters, motifs).collect()
    assert sorted(map(tuple, got), key=str) == sorted([
        ("7", "gene", "seven", None, None), ("8", "gene", None, None, None), ("8", "condition", None, None, None),
        ("9", "gene", "nine", None, None), ("bicluster_0001", "bicluster", "first", 2, None), ("motif_0001_2", "motif", None, None, 6),
    ], key=str)


def test_cluster_blocks(spark, tmp_path):
    from tessella.sources import writers as wr

    m = spark.createDataFrame([(r, c, r + c / 10) for r in range(4) for c in range(3)], "row_id long, col_id int, value double")
    rows, cols = spark.createDataFrame([(1, 2), (1, 3), (2, 0)], "k int, row_id long"), spark.createDataFrame([(1, 0), (1, 2)], "k int, col_id int")
    pssm = spark.createDataFrame([(1, 1, 2, 0.0, 1.0, 0.0, 0.0), (1, 1, 1, 0.5, 0.5, 0.0, 0.0), (2, 1, 1, 1.0, 0.0, 0.0, 0.0)], "k int, mot int, pos int, a double, c double, g double, t double")
    wr.write_cluster_blocks(m, rows, cols, pssm, 1, str(tmp_path / "b"))
    text = {n: [x.value for x in spark.read.text(str(tmp_path / "b" / n)).collect()] for n in ("matrix", "pssm")}
    assert set(text["matrix"]) == {"row_id\t0\t2", "2\t2.0\t2.2", "3\t3.0\t3.2"}
    assert set(text["pssm"]) == {"mot\tpos\ta\tc\tg\tt", "1\t1\t0.5\t0.5\t0.0\t0.0", "1\t2\t0.0\t1.0\t0.0\t0.0"}
