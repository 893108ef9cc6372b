import random

import pytest

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, shard string, kept string, fp string, n string"


@pytest.fixture(scope="session")
def documents(spark):
    from tallyfloor.llm.common import ship

    ship(spark)
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet")


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls in any column, empty and long texts, ties, repeated rows, and extra columns with names that operators use."""
    rnd = random.Random(5)
    words = ["alpha", "Beta", "gämma", "delta,", "ÉPSILON", "zeta.", "1 2", "x" * 50, "don't", "\n", "\t", "日本 語", "<|endoftext|>"]
    long = " ".join(rnd.choice(words) for _ in range(30_000))
    texts = [None, "", " \n\t ", "one", "one two", "ONE two", "a\x00b", "é" * 9, long, long + " tail", "same same same " * 40, "line\nline\n\nline\n", "double  blank \n lead", "\x1c odd \x85 space", "mixed\r\nbreaks"]
    texts += [" ".join(rnd.choice(words) for _ in range(rnd.randint(1, 60))) for _ in range(40)]
    rows = [(i, t, rnd.choice(["en", "de", None]), rnd.choice(["a", "a", "a", "b", None]), None, "s", "k", "f", "n") for i, t in enumerate(texts)]
    rows += [(None, "no id", "en", "a", 1, "s", "k", "f", "n"), (None, None, None, None, None, None, None, None, None)]
    rows += [rows[5]] * 3 + [rows[8]] + [(100 + i, "copy of one text " * 5, "en", "hot", 1, "s", "k", "f", "n") for i in range(60)]
    rows += [(300, "Copy Of one text " * 5, "en", "hot", 1, None, None, None, None), (7, "tie on the id", "en", "b", 1, None, None, None, None)]
    return rows


@pytest.fixture(scope="session")
def odd(spark, odd_rows, documents):
    return spark.createDataFrame(odd_rows, SCHEMA)


@pytest.fixture(scope="session")
def nothing(spark, documents):
    return spark.createDataFrame([], SCHEMA)
