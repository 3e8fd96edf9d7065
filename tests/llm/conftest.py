import random

import pytest

SMALL = "/root/testdata/sf0.001"

#: Columns that operators use as names of their own.
CLASHES = ["size", "target", "rate", "copy", "keep_id", "row", "digest", "fp", "root", "score", "times", "cell", "key_doc_id", "_score", "ids"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in CLASHES)


def odd_rows():
    rng = random.Random(5)
    words = ["alpha", "Beta", "gamma,", "délta", "x", "日本", "<|end|>"]
    prose = [" ".join(rng.choice(words) for _ in range(rng.randint(5, 60))) for _ in range(12)]
    long = " ".join(rng.choice(words) + str(rng.randint(0, 99)) for _ in range(30_000))
    rows = [(k, p, f"s{k % 3}") for k, p in enumerate(prose)]
    rows += [(20, prose[3].replace(" ", " \n "), "s1"), (3, prose[3], "s0"), (3, prose[3], "s0"), (21, prose[0] + " tail", None)]
    rows += [(None, prose[1], "s2"), (None, prose[1], "s2"), (None, None, None), (None, "only here", "s1"), (30, None, "s0"), (31, "", "s0"), (32, " \t\n ", None)]
    rows += [(33, "a" * 50_000, "s1"), (34, long, "s1"), (35, "one", "s2"), (36, "one two", ""), (37, "\x00\x85  ﻿", "s2"), (38, "\U0001f600" * 50, "s0")]
    return [(i, t, "en", s, len(t or ""), *(["z"] * len(CLASHES))) for i, t, s in rows]


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with nulls, empty and very long texts, ties, repeated rows and columns of clashing names."""
    return spark.createDataFrame(odd_rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    """An empty table of documents."""
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")
