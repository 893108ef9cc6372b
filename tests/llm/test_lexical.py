"""Ranked search beside plain Python."""

import collections
import math
import random
import re

import pytest

from tallyfloor.llm import lexical

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def plain(docs, items, k=50):
    """{place of the item: [(score, doc_id)]}, best first, null ids last among equals."""
    counts = [(d, collections.Counter(words(t))) for d, t in docs]
    n = [sum(c.values()) for _, c in counts]
    rows, total = sum(x > 0 for x in n), sum(n)
    df = collections.Counter(t for _, c in counts for t in c)
    out = []
    for item, text in items:
        w = {t: math.floor(1000 * math.log((2 * rows + 2) / (2 * df[t] + 1))) for t in set(words(text))}
        found = []
        for (d, c), size in zip(counts, n):
            m = 50 + 50 * size * rows // max(1, total)
            score = sum(w[t] * (1_000_000_000 * c[t] // (1000 * c[t] + 20 * m)) for t in w if t in c)
            if score > 0:
                found.append((-score, d is None, d or 0))
        out += [(item, r, None if lacks else d, -s) for r, (s, lacks, d) in enumerate(sorted(found)[:k], 1)]
    return out


def key(row):
    return tuple((v is None, v or 0) for v in row)


def same(got, docs, items, k=50):
    assert sorted(map(tuple, got.collect()), key=key) == sorted(plain(docs, items, k), key=key)


@pytest.fixture
def small(monkeypatch):
    monkeypatch.setattr(lexical, "BLOCK", 8)


def test_given_documents(spark, documents):
    items = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    same(lexical.query(spark, documents, items), documents.select("doc_id", "text").collect(), items.select("item_id", "text").collect())


ITEMS = [(1, "copy of ONE text"), (2, "same same"), (3, None), (4, ""), (5, "absent words only"), (None, "gämma delta"), (1, "one"), (6, "日本 1 2 zeta")]


def test_odd_rows(spark, odd, odd_rows, small):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    same(lexical.query(spark, odd, items), [r[:2] for r in odd_rows], ITEMS)


def test_blocks_of_items(spark, odd, odd_rows, small, monkeypatch):
    monkeypatch.setattr(lexical, "ITEMS", 3)
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    same(lexical.search(odd, items, 7), [r[:2] for r in odd_rows], ITEMS, 7)


def test_hot_stratum_is_split(spark, small):
    """All documents have one length: many blocks, many ties on the score."""
    rnd = random.Random(9)
    docs = [(i, " ".join(rnd.choice("abcdefgh") for _ in range(6))) for i in range(300)]
    items = [(i, " ".join(rnd.choice("abcdefgh") for _ in range(3))) for i in range(12)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    same(lexical.search(frame, spark.createDataFrame(items, "item_id long, text string"), 20), docs, items, 20)
    index = lexical.build(lexical.occurrences(frame, [b"a", b"b"]))
    blocks = index.selectExpr("m", "size(tags) AS n").collect()
    assert {r["m"] for r in blocks} == {100} and max(r["n"] for r in blocks) <= 40 and len(blocks) > 20


def test_nothing(spark, nothing, documents):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert lexical.query(spark, nothing, items).count() == 0
    assert lexical.query(spark, documents, items.where("false")).columns == ["item_id", "rank", "doc_id", "score"]
    assert lexical.query(spark, documents, items.where("false")).count() == 0
