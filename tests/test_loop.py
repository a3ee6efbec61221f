import numpy as np
from pyspark.sql import functions as F

from tessella.config import Settings, ramp
from tessella.plans.biclustering import BiclusterRun


def planted(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(60, 30))
    x[:15, :10] = np.linspace(-3, 3, 10)[None, :] + rng.normal(size=(15, 10)) * 0.1
    return spark.createDataFrame([(i, j, float(x[i, j])) for i in range(60) for j in range(30)], "row_id long, col_id int, value double")


def settings(**kw):
    return Settings(n_clusters=4, n_iter=40, per_col=2, per_row=1, stats_every=100, post_adjust=False, **kw)


def test_planted_bicluster_is_recovered(spark):
    run = BiclusterRun(spark, {"x": planted(spark)}, settings(use_fuzz=False)).seed("kmeans").run(6)
    best = max(sum(r["row_id"] < 15 for r in run.members_of(k).collect()) for k in range(1, 5))
    assert best >= 12
    assert run.row_member.groupBy("row_id").count().agg(F.max("count")).first()[0] <= 1


def test_same_seed_gives_the_same_run_for_any_partitioning(spark):
    m = planted(spark)
    outs = []
    for n in (1, 8):
        run = BiclusterRun(spark, {"x": m.repartition(n, "row_id")}, settings()).seed("random").run(2)
        outs.append(sorted(map(tuple, run.row_member.collect())))
    assert outs[0] == outs[1]


def test_snapshot_resumes(spark, tmp_path):
    run = BiclusterRun(spark, {"x": planted(spark)}, settings()).seed("random").run(1)
    run.save(str(tmp_path))
    again = BiclusterRun(spark, {"x": planted(spark)}, settings()).resume(str(tmp_path), 1)
    assert sorted(again.row_member.collect()) == sorted(run.row_member.collect()) and again.iteration == 1


def test_resumed_run_equals_the_whole_run(spark, tmp_path):
    m = planted(spark)
    edges = spark.createDataFrame([(i, (i * 7 + 1) % 60, 1.0 + i % 3) for i in range(60)], "src long, dst long, weight double")
    groups = spark.createDataFrame([("g", i % 6, i, 5.0) for i in range(60)], "net string, group_id long, row_id long, weight double")
    make = lambda: BiclusterRun(spark, {"x": m}, settings(), networks={"n": edges}, groups=groups)
    whole = make().seed("random").run(3)
    whole.save(str(tmp_path))
    whole.run(2)
    again = make().resume(str(tmp_path), 3).run(2)
    for one, two in ((whole.row_member, again.row_member), (whole.col_member, again.col_member)):
        assert sorted(map(tuple, one.select(*one.columns).collect())) == sorted(map(tuple, two.select(*one.columns).collect()))
    assert again.net_weights == {"n": 0.5, "groups": 0.5}
    heaviest = edges.agg(F.sum("weight")).first()[0]
    from tessella.operators.networks import group_network_degrees

    assert np.isclose(group_network_degrees(again.group_edges(), 100).agg(F.sum("weight")).first()[0], heaviest) or again.n_rows // 20 < 10


def test_schedules():
    s = Settings(n_clusters=10, n_iter=2000)
    assert [i for i in range(1, 8) if s.rows_on(i)] == [1, 3, 5, 7]
    assert [i for i in range(1, 20) if s.nets_on(i)] == [1, 8, 15]
    assert [i for i in range(1, 25) if s.motifs_on(i)] == [2, 12, 22]
    assert ramp(1, 0, 1, 5) == 0 and ramp(9, 0, 1, 5) == 1 and s.scaling(50)[1] == 1e-5


def test_reseeding(spark):
    from tessella.operators import membership as mb

    m = planted(spark)
    ks = spark.range(1, 5).select(F.col("id").cast("int").alias("k"))
    rows = spark.createDataFrame([(1, i) for i in range(0, 8)] + [(2, i) for i in range(8, 30)] + [(3, 30), (3, 31), (3, 32), (3, 33)], "k int, row_id long")
    same = mb.reseed_small(m, rows, ks.where("k < 4"), 3, 20, 6)
    assert sorted(map(tuple, same.collect())) == sorted(map(tuple, rows.collect()))
    out = {tuple(r) for r in mb.reseed_small(m, rows, ks, 3, 20, 6).collect()}
    old = {tuple(r) for r in rows.collect()}
    assert old <= out and {k for k, _ in out - old} == {2, 4} and all(r >= 34 for _, r in out - old)
    cols = spark.createDataFrame([(1, 0), (2, 1), (3, 2)], "k int, col_id int")
    new = {tuple(r) for r in mb.reseed_columns(m, cols, ks).collect()} - {tuple(r) for r in cols.collect()}
    assert len(new) == 5 and {k for k, _ in new} == {4} and all(c > 2 for _, c in new)


def test_hooks_and_merging_in_the_loop(spark):
    seen = []
    run = BiclusterRun(spark, {"x": planted(spark)}, settings(
        preprocess=lambda m: m.withColumn("value", F.col("value") * 2), on_iteration=lambda r: seen.append(r.iteration), merge_every=2, merge_cutoff=0.5,
        member_weights=lambda m, rows, cols: rows.select("k", "row_id", F.lit(1.0).alias("weight")))).seed("random").run(2)
    assert seen == [1, 2] and run.row_member.count() > 0 and run.matrices["x"].agg(F.max("value")).first()[0] > 5


def test_superseded_tables_are_dropped(spark):
    from pathlib import Path

    from tessella.session import shared_dir

    run = BiclusterRun(spark, {"x": planted(spark)}, settings()).seed("random").run(4)
    folder = Path(shared_dir(spark).removeprefix("file://"))
    before = len(list(folder.iterdir()))
    run.run(6)
    assert len(list(folder.iterdir())) <= before + 2 and run.row_member.count() and run.row.count()


def test_export_holds_genome_tables_and_motif_sites(spark, tmp_path):
    import pytest

    from tessella.plans.biclustering import MotifSource
    from tessella.sources.writers import read_export

    seqs = spark.createDataFrame([(i, "ACGGTC" * 5 + ("TTGACATTGACA" if i < 15 else "CCCCCC") + "GATTCG" * 4) for i in range(60)], "id long, seq string")
    source = MotifSource(seqs)
    word = "TTGACATTGACA"
    source.pssm = spark.createDataFrame([(k, 1, p + 1, *[0.97 if x == b else 0.01 for x in "ACGT"]) for k in (1, 2) for p, b in enumerate(word)], "k int, mot int, pos int, a double, c double, g double, t double")
    source.motifs = spark.createDataFrame([(1, 1, 12, 15, 0.001), (2, 1, 12, 15, 0.001)], "k int, mot int, width int, nsites int, e_value double")
    source.hits = spark.createDataFrame([(1, 0, 1e-6)], "k int, row_id long, pvalue double")
    run = BiclusterRun(spark, {"x": planted(spark)}, settings(), motifs=source).seed("random")
    run.row_member = spark.createDataFrame([(1, r) for r in (0, 3, 40)] + [(2, 50)], "k int, row_id long")
    operons = spark.createDataFrame([("a", "b")], "head string, row_id string")
    with pytest.raises(ValueError):
        run.export(str(tmp_path / "bad"), {"operon": operons})
    names = run.export(str(tmp_path / "e"), {"operons": operons})
    assert {"operons", "motif_meme_posn", "motif_pssm", "bicluster_genes"} <= set(names)
    cols = ", ".join(f"{c} {t}" for c, t in source.sites(run.row_member).dtypes)
    sites = read_export(spark, str(tmp_path / "e"), "motif_meme_posn", cols).collect()
    assert sorted((r.k, r.mot, r.id, r.strand) for r in sites) == sorted((1, 1, i, sites[0].strand) for i in (0, 3))
    assert read_export(spark, str(tmp_path / "e"), "operons", "head string, row_id string").collect()[0].row_id == "b"
