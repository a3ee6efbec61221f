"""Findings of the third round: what a step leaves on disk, and how often it moves its rows."""

import itertools
import random
from pathlib import Path

from pyspark.sql import functions as F

from tessella.operators import motifs as mo
from tessella.session import shared_dir


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_motif_groups_keep_one_linkage_table(spark):
    draw = random.Random(3)
    pairs = [(a, b, draw.random() * 0.6) for a, b in itertools.combinations([f"m{i}" for i in range(10)], 2)]
    folder = Path(shared_dir(spark))
    before = set(folder.iterdir())
    got = mo.cluster_motifs(spark.createDataFrame(pairs, "a string, b string, p double"), 0.5, 2)
    left = sorted(p.name.split("-")[0] for p in set(folder.iterdir()) - before)
    assert left == ["labels", "linkage", "motif_names"]
    assert got.where("grp > node").count() == 0 and got.count() > 0


def test_contigs_share_files(spark, tmp_path):
    from tessella.plans import q_files

    rows = [(i, "Some letters of text " * (i + 1)) for i in range(60)] + [(7, "more"), (None, "no id"), (61, ""), (62, None)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    folder = Path(shared_dir(spark))
    before = set(folder.iterdir())
    got = {r["contig"] for r in q_files.read_contigs(spark, str(tmp_path)).collect()}
    assert got == {str(i) for i in range(60)} | {"__HIVE_DEFAULT_PARTITION__"}
    (made,) = set(folder.iterdir()) - before
    assert len([p for p in made.rglob("part-*") if not p.name.endswith(".crc")]) <= 8


def test_packed_raw_files_equal_single_ones(spark, tmp_path):
    from tessella.sources import readers as rd

    raw = {"c1": "acgt\nAC GT\n", "c2": "ttt", "c3": "\n"}
    (tmp_path / "single").mkdir()
    for name, text in raw.items():
        (tmp_path / "single" / f"{name}.raw").write_text(text)
    (tmp_path / "packed.txt").write_text("\n".join(f">genome/{name}.raw\n{text}" for name, text in raw.items()))
    single = rd.read_contigs(spark, f"{tmp_path}/single")
    packed = rd.read_contigs(spark, f"{tmp_path}/packed.txt", packed=True)
    assert sorted(map(tuple, single.collect())) == sorted(map(tuple, packed.collect())) == [("c1", "ACGTACGT"), ("c2", "TTT")]


def test_row_scores_move_the_matrix_once(spark):
    from tessella.operators import scores as sc

    m = spark.createDataFrame([(i, c, float(i * c % 7)) for i in range(40) for c in range(6)], "row_id long, col_id int, value double")
    rows = spark.createDataFrame([(i % 3, i) for i in range(40)], "k int, row_id long")
    cols = spark.createDataFrame([(k, c) for k in range(3) for c in range(k, 6)], "k int, col_id int")
    got = sc.row_scores(m, rows, cols)
    assert plan(got).count("Exchange hashpartitioning") == 1 and "SortMergeJoin" not in plan(got)
    assert got.count() == 120


def test_ranges_in_one_segment_are_not_collected(spark):
    from tessella.operators import genome as ge

    contigs = spark.createDataFrame([("c1", "ACGTACGTAC"), ("c2", "TTTTGGGG")], "contig string, seq string")
    spots = [("a", "c1", 2, 4), ("b", "c2", 7, 20), ("d", "c1", 5, 3), ("e", "c9", 1, 2), ("f", "c1", -3, 2), (None, "c1", 1, 2)]
    shape = "id string, contig string, start long, end long"
    got = ge.cut_ranges(spark.createDataFrame(spots, shape), contigs)
    assert "collect_list" not in plan(got)
    want = {("a", "CGT"), ("b", "GG"), ("d", ""), ("e", ""), ("f", "AC"), (None, "")}
    assert {(r["id"], r["seq"]) for r in got.collect()} == want
    # a repeated id and a range over two segments go together by id
    more = ge.cut_ranges(spark.createDataFrame([*spots, ("g", "c1", 1, 1), ("g", "c2", 1, 1), ("h", "c2", 3, 6)], shape), contigs, size=4)
    assert {(r["id"], r["seq"]) for r in more.collect()} == want | {("g", "AT"), ("h", "TTGG")}


def test_sequence_filter_reads_written_sequences(spark):
    from tessella.operators import genome as ge

    s = spark.createDataFrame([("a", "ACGTACGTACGG", "c", "D", 1, 12), ("b", "ACGTACGTACGG", "c", "D", 101, 112)], "id string, seq string, contig string, strand string, start long, end long")
    got = ge.filter_sequences(s.withColumn("seq", F.upper("seq")), (-20, 150), overlaps=True)
    assert "/sequences-" in plan(got) and "upper(" not in plan(got)
    assert [r["id"] for r in got.collect()] == ["a"]


def test_psimi_lines_come_from_one_pass(spark, tmp_path, monkeypatch):
    from tessella.plans import q_files

    spark.createDataFrame([(1, 2, 3, 5.0), (1, 2, 4, 6.0), (8, 9, 5, 1.0)], "l_partkey long, l_suppkey long, l_orderkey long, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    seen, table = [], q_files.table
    monkeypatch.setattr(q_files, "table", lambda df, *a: seen.append(df) or table(df, *a))
    got = sorted((r["src"], r["dst"], r["weight"]) for r in q_files.read_psimi_links(spark, str(tmp_path)).collect())
    assert got == [("1", "2", 0.2), ("8", "9", 0.1)]
    assert "Union" not in plan(seen[0]) and seen[0].count() == 4


def test_overlapping_clusters_are_found_row_by_row(spark, monkeypatch):
    from tessella.operators import membership as mb

    r = {(1, 2): 0.99, (1, 3): 0.98, (2, 3): 0.97, (1, 4): 0.96, (3, 4): 0.95}
    pairs = spark.createDataFrame([(a, b, x) for (a, b), x in r.items()], "a int, b int, r double")
    monkeypatch.setattr(mb, "score_correlation_pairs", lambda *a: pairs)
    members = [(1, 10), (1, 10), (2, 11), (3, 10), (3, 11), (3, 12), (4, 13), (1, None), (4, None), (None, 13), (2, 14), (2, 14)]
    seen, collect = [], type(pairs).collect
    monkeypatch.setattr(type(pairs), "collect", lambda df: seen.append(plan(df)) or collect(df))
    out, moves = mb.merge_duplicates(pairs, spark.createDataFrame(members, "k int, row_id long"), n=9)
    assert "LeftSemi" not in seen[0] and "collect_set" in seen[0]
    # 1 and 3 share row 10, 2 and 3 share row 11; no row without a number is shared
    assert moves == [(1, 3), (2, 3)]
    assert {tuple(x) for x in collect(out)} == {(1, 10), (1, 11), (1, 12), (1, None), (2, 11), (2, 14), (4, 13), (4, None), (None, 13)}


def test_shared_groups_are_counted_from_packed_blocks(spark):
    from tessella.operators import tiles

    draw = random.Random(5)
    rows = [(draw.randrange(7), draw.randrange(3), draw.choice([None, *range(-20, 21)])) for _ in range(400)]
    got = tiles.co_occurrence(spark.createDataFrame(rows, "iter int, k int, row_id long"), ["iter", "k"], "row_id", block_rows=4)
    assert "/blocks-" in plan(got) and "xxhash64(iter" not in plan(got)
    held = {}
    for i, k, x in rows:
        held.setdefault(x, set()).add((i, k))
    known = sorted(x for x in held if x is not None)
    want = {(a, b, len(held[a] & held[b])) for a, b in itertools.combinations(known, 2) if held[a] & held[b]}
    assert sorted(map(tuple, got.collect())) == sorted(want)
    names = spark.createDataFrame([(i, f"u{x}") for i, _, x in rows], "iter int, row_id string")
    text = {(r["a"], r["b"]): r["n"] for r in tiles.co_occurrence(names, ["iter"], "row_id", block_rows=4).collect()}
    by = {}
    for i, _, x in rows:
        by.setdefault(f"u{x}", set()).add(i)
    assert text == {(a, b): len(by[a] & by[b]) for a, b in itertools.combinations(sorted(by), 2) if by[a] & by[b]}
    assert tiles.co_occurrence(names.where("iter > 99"), ["iter"], "row_id").count() == 0
