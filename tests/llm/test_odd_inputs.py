"""Nulls, empty and long texts, repeated rows, empty tables and clashing extra columns, for every operator and stage."""

from collections import Counter

import pytest

from tests.llm.conftest import CLASHING

BENCH = "item_id bigint, text string"


def ids(df):
    return Counter(r[0] for r in df.select("doc_id").collect())


def labels(spark):
    return spark.createDataFrame([(i, i % 2, 0) for i in range(1, 17)] + [(None, 1, 0), (3, None, None), (3, 1, 0)], "doc_id bigint, quality int, toxic int")


def operators(spark):
    from tessella.llm import decontam, host_rules, langid, piece_codec, pii, quality, sharding, simhash, suffix_dedup

    bench = spark.createDataFrame([(1, "lorem ipsum dolor sit amet consectetur lorem ipsum dolor sit amet"), (2, None), (None, "word")], BENCH)
    return {
        "1": lambda d: quality.score(d, quality.fit(d, labels(spark))),
        "2": suffix_dedup.remove_repeats,
        "3": host_rules.apply_rules,
        "4": piece_codec.digest,
        "4 encode": lambda d: piece_codec.decode(piece_codec.encode(d)),
        "6": lambda d: langid.identify(d, langid.fit(langid.learning_rows(d), per_language=20)),
        "7": pii.find_spans,
        "7 redact": pii.redact,
        "8": lambda d: decontam.find_leaks(d, bench),
        "8 cut": lambda d: decontam.remove_leaks(d, bench),
        "8 no items": lambda d: decontam.find_leaks(d, bench.where("false")),
        "9": sharding.shard_documents,
        "10": simhash.near_duplicates,
    }


NAMES = ["1", "2", "3", "4", "4 encode", "6", "7", "7 redact", "8", "8 cut", "8 no items", "9", "10"]


@pytest.mark.parametrize("name", NAMES)
def test_one_row_for_each_row(spark, odd, clashing, name):
    run = operators(spark)[name]
    want = ids(odd)
    assert ids(run(odd)) == want
    assert ids(run(clashing)) == want


@pytest.mark.parametrize("name", NAMES)
def test_empty_table(spark, empty, name):
    assert operators(spark)[name](empty).count() == 0


def test_defined_results(spark, odd):
    ops = operators(spark)
    lang = {(r.doc_id, r.text): (r.lang_pred, r.score) for r in ops["6"](odd).collect()}
    assert lang[5, None] == lang[4, ""] == lang[9, "12345 !!"] == ("und", 0.0)
    group = {r.doc_id: r.component_id for r in ops["10"](odd).where("doc_id > 1").collect()}
    assert group[2] == 1 and group[4] == group[5] == group[6] == 4 and group[8] == 7 and group[11] == 10
    spans = {r.doc_id: r for r in ops["2"](odd).where("doc_id > 1").collect()}
    assert len(spans[2].kept) == 0 and len(spans[8].kept) == 0 and bytes(spans[10].kept) == b"word" and spans[5].n_bytes == 0
    shard = {r.doc_id: r.shard for r in ops["9"](odd).where("doc_id > 1").collect()}
    assert shard[4] == shard[5] and shard[7] == shard[8] and shard[10] == shard[11]
    decoded = {r.doc_id: (r.token_ids, r.decoded) for r in ops["4 encode"](odd).where("doc_id in (4, 5, 12)").collect()}
    assert decoded[4] == decoded[5] == ([], "") and decoded[12][1] == "é ü ß 日本語 😀  x"


def test_null_ids_stay_whole(spark, odd):
    from tessella.llm.suffix_dedup import remove_repeats

    assert sorted(r.n_bytes - len(r.kept) for r in remove_repeats(odd).where("doc_id is null").collect()) == [0, 0]


def test_one_language_or_class(spark, odd):
    from tessella.llm import langid, quality

    one = langid.identify(odd, langid.fit(odd.where("lang = 'aa'")))
    assert {r.lang_pred for r in one.collect()} == {"aa", "und"}
    same = quality.score(odd, quality.fit(odd, labels(spark).where("quality = 1")))
    assert same.where("score < 0 or score > 1").count() == 0


@pytest.mark.parametrize("extra", [False, True])
def test_pipeline_stages(spark, odd, clashing, empty, table_dir, extra):
    import corpus_pipeline

    bench = spark.createDataFrame([(1, "lorem ipsum dolor sit amet consectetur")], BENCH)
    sf = table_dir(benchmark=bench)
    for docs in (clashing if extra else odd, empty):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, sf)
            if name != corpus_pipeline.STAGES[-1][0]:
                assert out.columns == docs.columns and dict(out.dtypes) == dict(docs.dtypes)
                if extra and docs is not empty:
                    assert all(r[c] == f"own {c}" for r in out.collect() for c in CLASHING)
            out.count()


def test_pipeline_runs(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    out = corpus_pipeline.run(spark, sf)
    n = spark.read.parquet(f"{sf}/documents.parquet").count()
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and 0.8 * n < out.count() <= n
    assert out.select("doc_id").distinct().count() == out.count()


def test_near_dedup_stage_keeps_one(spark, odd):
    from tessella.llm.simhash import keep_one

    kept = ids(keep_one(odd))
    assert kept[1] == 1 and kept[2] == 0 and kept[7] == 1 and kept[8] == 0 and kept[4] == 1 and kept[5] == 0 and kept[None] == 2
