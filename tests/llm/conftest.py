import random

import pytest
from pyspark.sql import types as T

LONG = "lorem ipsum dolor sit amet consectetur " * 6000
CLASHING = ["score", "lang_pred", "fp", "component_id", "n_words", "leak_spans", "leak_items", "token_ids", "decoded", "stats", "shard", "slot", "size", "bytes", "base", "cands", "host", "kept", "cuts", "bucket", "key", "n"]


def prose(seed: int, words: int) -> str:
    r = random.Random(seed)
    return " ".join("".join(r.choice(["ba", "ke", "li", "mo", "tu", "ra", "se"]) for _ in range(r.randint(1, 4))) for _ in range(words))


def odd_rows() -> list[tuple]:
    """(doc_id, text, lang, source, n_chars): nulls, empty and long texts, ties, repeated rows, one id with two texts."""
    base = prose(1, 120)
    texts = {
        1: base, 2: base, 3: base + " tail", 4: "", 5: None, 6: " \n\t ", 7: LONG, 8: LONG, 9: "12345 !!", 10: "word", 11: "word", 12: "é ü ß 日本語 😀 ▁x",
        13: prose(2, 300), 14: prose(2, 300)[40:] + prose(3, 40), 15: "write to ann.b@mail.example.com or +1 (988) 555-2485 now", 16: "x" * 70_000,
    }
    rows = [(i, t, "aa" if i % 2 else "bb", f"s{i % 3}", len(t or "")) for i, t in texts.items()]
    return [*rows, rows[0], rows[0], (1, prose(4, 90), "aa", None, 5), (None, base, None, "s1", None), (None, None, None, None, None), (20, prose(5, 80), None, None, None)]


SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def clashing(spark, odd):
    from pyspark.sql import functions as F

    return odd.select("*", *[F.lit(f"own {c}").alias(c) for c in CLASHING])


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], T._parse_datatype_string(SCHEMA))


@pytest.fixture
def table_dir(spark, tmp_path):
    """Writes tables as the queries read them and names the folder."""

    def write(**tables):
        for name, df in tables.items():
            df.write.mode("overwrite").parquet(f"{tmp_path}/{name}.parquet")
        return str(tmp_path)

    return write
