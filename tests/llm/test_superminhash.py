"""SuperMinHash near-duplicates beside plain Python."""

import random

import numpy as np
import pytest

from tallyfloor.llm import superminhash as smh


def plain_set(text, width):
    w = bytes(b + 32 if 65 <= b <= 90 else b for b in (text or "").encode()).split()
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + width]) for i in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)])


def plain(rows, width=2, least=80):
    """[(doc_id, set size, smallest doc_id of the component, component)]: all pairs, by definition."""
    sets = [plain_set(t, width) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= least * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            low[find(i)] = min(low.get(find(i), d), d)
    return [(d, len(s), low.get(find(i)), find(i)) for i, ((d, _), s) in enumerate(zip(rows, sets))]


def key(row):
    return tuple((v is None, v or 0) for v in row)


def same(frame, rows, width=2):
    got = [tuple(r) for r in smh.near_duplicates(frame, width).collect()]
    assert sorted(got, key=key) == sorted((r[:3] for r in plain(rows, width)), key=key)


def test_given_documents(spark, documents):
    rows = [tuple(r) for r in documents.select("doc_id", "text").collect()]
    same(documents, rows)
    kept = smh.query(spark, documents).collect()
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in kept)


def test_five_words_on_given_documents(spark, documents):
    same(documents, [tuple(r) for r in documents.select("doc_id", "text").collect()], 5)


def test_odd_rows(spark, odd, odd_rows):
    same(odd, [r[:2] for r in odd_rows])


def test_nothing(spark, nothing):
    got = smh.query(spark, nothing)
    assert got.columns == ["doc_id", "n_shingles", "component_id", "kept"] and got.count() == 0
    assert smh.deduplicate(nothing).count() == 0


def test_kept_rows(spark, odd, odd_rows):
    got = smh.deduplicate(odd)
    assert got.columns == odd.columns
    low = {}
    for d, _, c, root in plain([r[:2] for r in odd_rows], 5):
        low[root] = c
    assert sorted((r["doc_id"] for r in got.collect()), key=lambda d: (d is None, d or 0)) == sorted(low.values(), key=lambda d: (d is None, d or 0))


@pytest.fixture(scope="module")
def crowd():
    """Families of edited copies: near their source, not always near each other; and chains, linked from one to the next only."""
    rnd = random.Random(8)
    word = lambda: rnd.choice("abcdefghijklmnop") + str(rnd.randint(0, 400))
    texts = []
    for family in range(3):
        base = [word() for _ in range(80)]
        texts.append(base)
        for _ in range(70):
            copy = list(base)
            for _ in range(rnd.randint(1, 5)):
                copy[rnd.randrange(80)] = word()
            texts.append(copy)
    link = [word() for _ in range(60)]
    for _ in range(25):
        link = link[3:] + [word() for _ in range(3)]
        texts.append(link)
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    rnd.shuffle(rows)
    return rows


def test_crowded_bands_and_chains(spark, crowd):
    same(spark.createDataFrame(crowd, "doc_id long, text string").repartition(5), crowd)


def test_few_pivots_lose_no_link(spark, crowd, monkeypatch):
    monkeypatch.setattr(smh, "FEW", 2)
    monkeypatch.setattr(smh, "FIRST", 1)
    same(spark.createDataFrame(crowd, "doc_id long, text string"), crowd)


def plain_signature(own):
    """The method by its letter: a permutation drawn step by step for each element."""
    won = [None] * smh.POSITIONS
    for e in own:
        places = list(range(smh.POSITIONS))
        for level in range(smh.POSITIONS):
            seed = np.array([e], np.uint64) + smh._A * np.uint64(2 * level + 1)
            rank, draw = int(smh.mix(seed)[0]), int(smh.mix(seed + smh._A)[0])
            k = level + draw % (smh.POSITIONS - level)
            places[level], places[k] = places[k], places[level]
            now = won[places[level]]
            if now is None or (level, rank) < now:
                won[places[level]] = (level, rank)
    return [r for _, r in won]


def test_signatures_follow_the_definition():
    rnd = np.random.default_rng(4)
    sets = [np.unique(rnd.integers(0, 2**63, n).astype(np.uint64)) for n in (1, 2, 7, 40, 400)]
    made = smh.sign(sets)
    for own, row in zip(sets, made):
        assert row.tolist() == plain_signature(own.tolist())


def test_agreement_estimates_similarity():
    rnd = np.random.default_rng(6)
    errors = []
    for _ in range(60):
        both, left, right = rnd.integers(0, 2**63, 80), rnd.integers(0, 2**63, 10), rnd.integers(0, 2**63, 10)
        x, y = (np.unique(np.concatenate([both, v]).astype(np.uint64)) for v in (left, right))
        a, b = smh.sign([x, y])
        errors.append((a == b).mean() - 0.8)
    assert abs(np.mean(errors)) < 0.01 and np.std(errors) < 0.0316  # no more spread than independent hashes have
    assert min(errors) * smh.POSITIONS + 0.8 * smh.POSITIONS >= smh.AGREE


def test_far_copies_of_a_crowd_meet_few_others(spark, monkeypatch):
    """Edited copies of one text, most of them near it and many just too far from all others: pairs grow with the rows, not with their square."""
    rnd = random.Random(12)
    word = lambda: "".join(rnd.choice("abcdefghijklmnop") for _ in range(7))
    base = [word() for _ in range(120)]
    rows = [(0, " ".join(base))]
    for i in range(1, 500):
        copy = list(base)
        for k in rnd.sample(range(0, 120, 3), rnd.choice([2, 3, 4, 9])):  # each takes two pairs out and puts two in; nine are too far from the base
            copy[k] = word()
        rows.append((i, " ".join(copy)))
    seen, agreeing = [], smh._agreeing
    monkeypatch.setattr(smh, "_agreeing", lambda pairs: seen.append(pairs.count()) or agreeing(pairs))
    same(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), rows)
    assert sum(seen) < 20 * len(rows), seen
