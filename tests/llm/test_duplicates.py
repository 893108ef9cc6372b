"""Exact and near deduplication beside plain Python."""

import collections
import hashlib
import tracemalloc

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tallyfloor.llm import digest_index, simhash
from tallyfloor.llm.common import scratch, without
from tallyfloor.llm.components import connected


def lower(text):
    return bytes(b + 32 if 65 <= b <= 90 else b for b in (text or "").encode())


def test_exact_decisions(spark, odd, odd_rows):
    groups = collections.defaultdict(list)
    for r in odd_rows:
        groups[hashlib.sha256(lower(r[1])).hexdigest()].append(r[0])
    rows = [tuple(r) for r in digest_index.query(spark, odd).collect()]
    assert len(rows) == len(odd_rows)
    for d, ids in groups.items():
        own = [r for r in rows if r[4] == d]
        keep = max((i for i in ids if i is not None), default=None)
        assert collections.Counter(r[0] for r in own) == collections.Counter(ids)
        assert {r[1] for r in own} == {keep} and {r[2] for r in own} == {len(ids)}
        assert [r[0] for r in own if r[3]] == [keep]


def test_exact_kept_rows(spark, odd, odd_rows):
    got = digest_index.deduplicate(odd)
    assert got.columns == odd.columns
    rows = got.collect()
    assert len(rows) == len({lower(r[1]) for r in odd_rows}) == len({lower(r["text"]) for r in rows})


def test_exact_kept_rows_with_unique_ids(spark, documents):
    rows = digest_index.deduplicate(documents).collect()
    all_rows = documents.collect()
    best = {}
    for r in all_rows:
        best[lower(r["text"])] = max(best.get(lower(r["text"]), -1), r["doc_id"])
    assert sorted(r["doc_id"] for r in rows) == sorted(best.values())


def test_index_outlives_its_name(spark, odd):
    path = scratch(spark, "index")
    digests = digest_index.digest_rows(odd)
    first = digest_index.DigestIndex(spark, path, 8)
    first.append(digests.where("doc_id < 20"), 0)
    n = first.table().count()
    first.close()
    again = digest_index.DigestIndex(spark, path, 8)
    assert again.table().count() == n > 0
    again.append(digests, 1)
    again.append(digests, 2)
    kept = again.table().groupBy("batch").count().collect()
    assert {r["batch"]: r["count"] for r in kept} == {0: n, 1: digests.select("digest").distinct().count() - n}
    again.close()


def test_anti_join_does_not_shuffle_the_index(spark, odd):
    index = digest_index.DigestIndex(spark, scratch(spark, "index"), 8)
    digests = digest_index.digest_rows(odd)
    index.append(digests.where("doc_id < 20"), 0)
    plan = digests.select("digest").distinct().join(index.table().select("digest").hint("merge"), "digest", "left_anti")
    text = plan._jdf.queryExecution().toString()
    assert "SortMergeJoin" in text and text.split("== Physical Plan ==")[1].count("Exchange hashpartitioning") <= 2
    index.close()


def test_exact_of_nothing(spark, nothing):
    assert digest_index.query(spark, nothing).count() == 0 and digest_index.deduplicate(nothing).count() == 0


def plain_fingerprint(text):
    w = [x.decode() for x in lower(text).split()]
    if not w:
        return 0
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)]
    bits = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        for i in range(64):
            bits[i] += h >> i & 1
    return sum(1 << i for i in range(64) if 2 * bits[i] > len(shingles))


def plain_components(pairs):
    """Smallest id reachable over links of at most two bits; pairs of id and fingerprint."""
    fps = sorted({f for _, f in pairs})
    root = {f: f for f in fps}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f

    for i, a in enumerate(fps):
        for b in fps[:i]:
            if (a ^ b).bit_count() <= 2:
                root[find(a)] = find(b)
    low = {}
    for i, f in pairs:
        if i is not None:
            low[find(f)] = min(low.get(find(f), i), i)
    return {f: low.get(find(f)) for f in fps}


def test_near_duplicates(spark, odd, odd_rows):
    pairs = [(r[0], plain_fingerprint(r[1])) for r in odd_rows]
    low = plain_components(pairs)
    got = collections.Counter(tuple(r) for r in simhash.query(spark, odd).collect())
    assert got == collections.Counter((i, f"{f:016x}", low[f]) for i, f in pairs)


def test_near_duplicates_of_documents(spark, documents):
    pairs = [(r["doc_id"], plain_fingerprint(r["text"])) for r in documents.collect()]
    low = plain_components(pairs)
    assert {tuple(r) for r in simhash.query(spark, documents).collect()} == {(i, f"{f:016x}", low[f]) for i, f in pairs}
    kept = simhash.deduplicate(documents)
    assert kept.columns == documents.columns and sorted(r["doc_id"] for r in kept.collect()) == sorted(set(low.values()))


def test_long_text_is_hashed_in_blocks(monkeypatch):
    text = " ".join(f"w{i % 97} x{i % 13}" for i in range(3000))
    whole = simhash.fingerprint(text.encode())
    monkeypatch.setattr(simhash, "BLOCK", 100)
    assert simhash.fingerprint(text.encode()) == whole == plain_fingerprint(text)


@pytest.mark.parametrize("bucket", [0, 3, 1000])
@pytest.mark.parametrize("probes", [None, [(list(range(40)), 1), (list(range(40, 64)), 0)], [(list(range(64)), 2)]])
def test_links_find_all_pairs(spark, bucket, probes):
    import random

    rnd = random.Random(3)
    centres = [rnd.getrandbits(64) for _ in range(6)]
    fps = {0}
    for c in centres:
        for _ in range(12):
            f = c
            for _ in range(rnd.randint(0, 4)):
                f ^= 1 << rnd.randrange(64)
            fps.add(f)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    frame = spark.createDataFrame([(f,) for f in signed], "fp long")
    links = simhash.links(frame, 2, bucket, probes)
    for a, b in links.collect():
        assert ((a ^ b) & (2**64 - 1)).bit_count() <= 2
    roots = {r["fp"]: r["root"] for r in connected(links, "fp", "root").collect()}
    want = plain_components([(i, f) for i, f in zip(signed, (s % 2**64 for s in signed))])
    for a in signed:
        assert roots.get(a, a) == want[a % 2**64]


def test_radii_add_up(spark):
    import numpy as np

    bits = np.random.default_rng(1).integers(0, 2, (500, 64)).astype(float)
    for rows in (10, 10**6, 10**11):
        probes = simhash.plan(bits, rows, 2)
        assert sum(r + 1 for _, r in probes) == 3 and len({i for g, _ in probes for i in g}) == sum(len(g) for g, _ in probes)


def test_chain_and_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(1000, i) for i in range(1001, 1200)] + [(5, 5)]
    frame = spark.createDataFrame(edges, "a long, b long")
    roots = {r["n"]: r["root"] for r in connected(frame, "n", "root").collect()}
    assert roots == {i: 0 for i in range(41)} | {i: 1000 for i in range(1000, 1200)}


def test_near_of_nothing(spark, nothing):
    assert simhash.query(spark, nothing).count() == 0 and simhash.deduplicate(nothing).count() == 0


def test_near_kept_rows_are_one_for_each_component(spark, odd, odd_rows):
    root = plain_components([(k, f) for k, f in enumerate(plain_fingerprint(r[1]) for r in odd_rows)])
    best = {}
    for i, f in ((r[0], plain_fingerprint(r[1])) for r in odd_rows):
        best[root[f]] = min(best.get(root[f], (True, 0)), (i is None, i or 0))
    kept = simhash.deduplicate(odd).collect()
    assert collections.Counter(root[plain_fingerprint(r["text"])] for r in kept) == collections.Counter(best.keys())
    assert all((r["doc_id"] is None, r["doc_id"] or 0) == best[root[plain_fingerprint(r["text"])]] for r in kept)


def test_near_keeps_clean_rows_without_own_ids(spark):
    texts = ["the quick brown fox jumps over it", "an entirely different line of words here", "numbers one two three four five six", "yet more text about other things"]
    rows = [(None, texts[0]), (None, texts[1]), (7, texts[2]), (7, texts[3]), (None, texts[3])]
    kept = simhash.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"] or 0, r["text"]) for r in kept) == sorted([(0, texts[0]), (0, texts[1]), (7, texts[2]), (7, texts[3])])


@pytest.mark.parametrize("cells", [64, 1 << 24])
def test_few_rows_taken_out(spark, cells):
    """Rows go by their keys, however many share a bit; null keys stay."""
    rows = spark.range(2000).select(F.when(F.col("id") % 50 > 0, F.col("id")).alias("k"), F.col("id").alias("v"))
    gone = spark.range(0, 2000, 7).select(F.col("id").alias("k"))
    assert sorted(r["v"] for r in without(rows, gone, "k", cells).collect()) == [i for i in range(2000) if i % 50 == 0 or i % 7]
    assert without(rows, gone.limit(0), "k", cells).count() == 2000


def test_texts_that_stay_are_not_shuffled(spark, documents):
    """Also where the ids that go are too many to be broadcast, only rows that may go meet them in a shuffle."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = digest_index.deduplicate(documents)
        assert 0 < out.count() < documents.count()
        plan = out._jdf.queryExecution().sparkPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.index("Union") < plan.index("BroadcastHashJoin") < plan.index("SortMergeJoin") and plan.count("LeftAnti") == 1


def test_plan_does_not_hold_all_pairs_of_its_sample():
    bits = np.random.default_rng(1).integers(0, 2, (simhash.SAMPLE, simhash.BITS)).astype(float)
    tracemalloc.start()
    try:
        near = simhash.pair_share(bits, list(range(8)), 1)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 32 << 20 and abs(near - 9 / 256) < 0.01
