from __future__ import annotations

import random

import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
#: Columns of the operators' own results, to clash with.
CLASHES = "kept boolean, keep_id string, component_id string, text_sha256 string, possible_copy int, text_digest int, copies int, target string, size string, score string, dropped_id int, mixed_id int, p int, source_size int, number int"


def prose(seed: int, words: int) -> str:
    rng = random.Random(seed)
    return " ".join("".join(rng.choice(["ka", "lo", "mi", "ten", "ur", "sa", "Be"]) for _ in range(rng.randint(1, 4))) for _ in range(words))


#: Null, empty, blank, short, one very long, ties, repeated rows, and characters outside ASCII.
ODD = [
    (1, None, None, None, None), (2, "", "en", "a", 0), (3, " \t\n", "en", "a", 3), (4, "one", "en", None, 3), (5, "One", "en", "a", 3),
    (6, prose(1, 300), "en", "a", 1), (7, prose(1, 300).upper(), None, "b", 1), (8, prose(2, 60_000), "de", "b", 1), (9, "été   ñandú " * 40, "es", "c", 1),
    (10, "word " * 400, "en", "c", 1), (10, "word " * 400, "en", "c", 1), (11, "é" * 500, "fr", "", 1), (12, "a\u0000b \u0085 c", "en", "a", 1), (13, prose(1, 299), "en", "a", 1),
    (None, prose(3, 80), "en", "a", 1), (None, None, None, None, None),
]


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def clashing(spark, odd):
    from pyspark.sql import functions as F

    names = [x.strip().split() for x in CLASHES.split(",")]
    return odd.select("*", *[F.lit(None).cast(kind).alias(name) for name, kind in names])


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
