"""Spelling variants beside plain Python."""

import collections
import random
import re
import zlib

import pytest

from tallyfloor.llm import spelling

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_counts(rows):
    n = collections.Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    return {w: k for w, k in n.items() if len(w) >= 6 and k >= 5}


def plain_rows(words):
    """By neighbourhoods of deletions, another way than pivotal grams."""
    cut = collections.defaultdict(set)
    for w in words:
        for i in range(len(w)):
            cut[w[:i] + w[i + 1 :], i].add(w)
    near = collections.defaultdict(set)
    for (short, _), own in cut.items():
        for w in own:
            near[w] |= own - {w}
            if short in words:
                near[w].add(short)
                near[short].add(w)
    best = {w: min(near[w], key=lambda v: (-words[v], v)) for w in words if near[w]}
    form = {w: v for w, v in best.items() if words[v] >= 5 * words[w]}
    rows = []
    for w in words:
        root = w
        while root in form:
            root = form[root]
        rows.append((w, form.get(w), root, words[w], len(near[w]), words[form[w]] if w in form else None))
    return sorted(rows)


def collected(df):
    return sorted(map(tuple, df.collect()))


def test_given_documents(spark, documents):
    got = collected(spelling.query(spark, documents))
    assert got == plain_rows(plain_counts(documents.select("doc_id", "text").collect()))
    assert any(r[1] for r in got) and any(r[4] > 1 for r in got)


def test_odd_rows(spark, odd, odd_rows):
    assert collected(spelling.query(spark, odd)) == plain_rows(plain_counts([r[:2] for r in odd_rows]))


def test_nothing(spark, nothing):
    got = spelling.query(spark, nothing)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"] and got.count() == 0


@pytest.mark.parametrize("alphabet", ["ab", "abé÷", "abcdefghij"])
def test_pairs_of_made_words(spark, alphabet):
    """Few letters give repeated grams, ties of rank and words that differ in a run of equal letters."""
    rnd = random.Random(len(alphabet))
    words = {"".join(rnd.choice(alphabet) for _ in range(rnd.randint(6, 9))) for _ in range(400)}
    words |= {w[:i] + rnd.choice(alphabet) + w[i:] for w in list(words)[:60] for i in (0, 3, len(w))}
    frame = spark.createDataFrame([(w, rnd.choice([5, 6, 25, 126, 700])) for w in sorted(words)], "word string, n long")
    counts = {r["word"]: r["n"] for r in frame.collect()}
    pairs = spelling.near_pairs(frame)
    assert pairs.count() == sum(r[4] for r in plain_rows(counts)) // 2
    got = spelling.forms(frame, pairs).select("word", "form", "root", "n", "n_near", "form_n")
    assert collected(got) == plain_rows(counts)


def test_roots_follow_long_ways(spark):
    words = {"b" * k + "a" * (12 - k): 5 * 6**k for k in range(12)}
    frame = spark.createDataFrame(sorted(words.items()), "word string, n long")
    got = spelling.forms(frame, spelling.near_pairs(frame)).select("word", "form", "root", "n", "n_near", "form_n")
    assert collected(got) == plain_rows(words)
    assert {r[2] for r in collected(got)} == {"b" * 11 + "a"}


def test_pivots_are_the_cheapest_disjoint_pair():
    rnd = random.Random(3)
    for _ in range(300):
        places = sorted(rnd.sample(range(9), rnd.randint(3, 7)))
        costs = [rnd.randint(1, 9) for _ in range(9)]
        one, two = spelling.pivots(costs, places)
        assert two - one >= 2 and {one, two} <= set(places)
        assert costs[one] + costs[two] == min(costs[p] + costs[q] for p in places for q in places if q - p >= 2)
