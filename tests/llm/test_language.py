"""Rules, classifier, language model and byte-level BPE beside plain Python."""

import base64
import collections
import hashlib
import math
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F

from tallyfloor.llm import byte_bpe, kneser_ney, ppm, quality_rules

MULTI = P.path("byte_bpe_multi_50k.tiktoken")


def lower(text):
    return bytes(b + 32 if 65 <= b <= 90 else b for b in (text or "").encode())


# --- quality rules ------------------------------------------------------------------------


def plain_counts(text):
    words = [w.decode() for w in (text or "").encode().split()]
    n, windows = len(words), collections.Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    inside = {k for i in range(n - 7) if windows[tuple(words[i : i + 8])] > 1 for k in range(i, i + 8)}
    lines = [x for x in (text or "").split("\n") if x.encode().split()]
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(inside)


def signed(h):
    return h - (1 << 64) if h >> 63 else h


def long_hash(*values):
    return kneser_ney.hash_longs(*(np.array([v], np.int64) for v in values))[0]


def plain_grams(text):
    h = [signed(xxhash.xxh64_intdigest(w, 42)) for w in (text or "").encode().split()]
    return [x & (quality_rules.BUCKETS - 1) for x in [*h, *(int(long_hash(a, b)) for a, b in zip(h, h[1:]))]]


def check_rules(spark, docs, rows, labels):
    good = {r[0] for r in labels if r[1] == 1 and not r[2] and r[0] is not None}
    raw, target = np.ones(quality_rules.BUCKETS), np.ones(quality_rules.BUCKETS)
    for r in rows:
        for g in plain_grams(r[1]):
            raw[g] += 1
            target[g] += r[0] in good
    weight = np.log(target / target.sum()) - np.log(raw / raw.sum())
    want = collections.Counter()
    for r in rows:
        counts, grams = plain_counts(r[1]), plain_grams(r[1])
        score = float(np.mean(weight[grams])) if grams else None
        failed = counts[0] < 20 or 100 * counts[4] > 30 * counts[0]
        want[r[0], *counts, failed, not failed and score >= quality_rules.THRESHOLD, None if score is None else round(score, 6)] += 1
    frame = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = quality_rules.query(spark, docs, frame).collect()
    assert collections.Counter((*tuple(r)[:8], None if r[8] is None else round(r[8], 6)) for r in got) == want


def test_rules_on_odd_rows(spark, odd, odd_rows):
    check_rules(spark, odd, odd_rows, [(20, 1, 0), (21, 1, 0), (22, 1, 1), (23, 0, 0), (None, 1, 0), (24, None, None), (25, 1, None)])
    check_rules(spark, odd, odd_rows, [])


def test_rules_on_documents(spark, documents, labels):
    check_rules(spark, documents, [(r["doc_id"], r["text"]) for r in documents.collect()], [tuple(r) for r in labels.collect()])


def test_rules_keep_columns(spark, odd, labels, nothing):
    assert quality_rules.filtered(odd, labels).columns == odd.columns
    assert quality_rules.query(spark, nothing, labels.limit(0)).count() == 0


def test_rules_run_without_python(spark, documents, labels):
    plan = quality_rules.query(spark, documents, labels)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_repeats(spark):
    base = [f"w{i}" for i in range(30)]
    texts = [" ".join(x) for x in (base + base[4:13] + base, base[:8] * 2, ["a"] * 20, base[:7] * 2, base[:9] + ["x"] + base[:9], base + base[:3] + base[10:14])]
    frame = spark.createDataFrame([(t,) for t in texts], "text string")
    got = [r["n_repeat_words"] for r in quality_rules.add_counts(frame).select("n_repeat_words").collect()]
    assert got == [plain_counts(t)[4] for t in texts]


# --- classifier ---------------------------------------------------------------------------


def test_hash_of_longs_is_that_of_sql(spark):
    rows = [(1, 2, 3), (-5, 0, 2**62), (-(2**63), 2**63 - 1, 7)]
    got = spark.createDataFrame(rows, "x long, y long, z long").select(F.xxhash64("x", "y", "z"), F.xxhash64("x", "y")).collect()
    a = np.array(rows, np.int64).T.copy()
    assert [tuple(r) for r in got] == list(zip(kneser_ney.hash_longs(*a).tolist(), kneser_ney.hash_longs(*a[:2]).tolist()))


def plain_kneser_ney(train, text):
    """log10 probability of a text's words and end under an interpolated modified Kneser-Ney trigram model of the training texts."""
    runs = collections.Counter()
    for t in train:
        w = ["<", "<", *t.split(), ">"]
        runs.update(zip(w, w[1:], w[2:]))
    levels = [runs, collections.Counter(k[1:] for k in runs)]
    levels.append(collections.Counter(k[1:] for k in levels[1]))

    def discounts(counts):
        n = [sum(v == k for v in counts.values()) for k in range(5)]
        y = n[1] / (n[1] + 2 * n[2]) if n[1] + 2 * n[2] else 0.5
        d = [(k - (k + 1) * y * n[k + 1] / n[k]) if n[k] else y for k in (1, 2, 3)]
        return [min(max(v, 0.05), k + 0.95) for k, v in enumerate(d)]

    d = [discounts(c) for c in levels]

    def p(gram):
        order = 3 - len(gram)
        context = {k: v for k, v in levels[order].items() if k[:-1] == gram[:-1]}
        lower_p = p(gram[1:]) if len(gram) > 1 else 1 / (len(levels[2]) + 1)
        if not context:
            return lower_p
        total, cut = sum(context.values()), lambda v: d[order][min(v, 3) - 1]
        own = max(context[gram] - cut(context[gram]), 0) / total if gram in context else 0
        return own + sum(map(cut, context.values())) / total * lower_p

    w = ["<", "<", *text.split(), ">"]
    return sum(math.log10(p(g)) for g in zip(w, w[1:], w[2:]))


def test_classifier_is_the_model(spark, tmp_path):
    train = ["the cat sat on the mat", "the cat ate the rat", "a dog sat on the cat and the dog ate", "the cat sat on a hat", "it is on the mat"]
    texts = ["the cat sat on the mat", "a zebra ate the cat", "", "mat", "the the the", "the cat sat"]
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(train + texts)], "doc_id long, text string, lang string")
    fitted = kneser_ney.train(docs, spark.range(len(train)).withColumnRenamed("id", "doc_id"), f"{tmp_path}/model")
    got = {r["doc_id"]: r["log10_prob"] for r in kneser_ney.score(docs, fitted).collect()}
    for i, t in enumerate(texts):
        assert got[len(train) + i] == pytest.approx(plain_kneser_ney(train, t), abs=1e-9)


def test_a_long_trusted_text_is_passed_over(spark, tmp_path):
    ids = [r["id"] for r in spark.range(6).orderBy(F.xxhash64("id")).collect()]
    texts = ["word " * 60, "the cat sat on the mat", "the cat ate the rat", "a dog sat on the cat", "it is on the mat", "the cat sat"]
    docs = spark.createDataFrame([(i, t, "en") for i, t in zip(ids, texts)], "doc_id long, text string, lang string")
    trusted = docs.select("doc_id")
    fitted = kneser_ney.train(docs, trusted, f"{tmp_path}/model", max_words=50)
    got = {r["doc_id"]: r["log10_prob"] for r in kneser_ney.score(docs, fitted).collect()}
    for i, t in zip(ids, texts):
        assert got[i] == pytest.approx(plain_kneser_ney(texts[1:], t), abs=1e-9)
    with pytest.raises(ValueError):
        kneser_ney.train(docs, trusted.where(F.col("doc_id") == ids[0]), f"{tmp_path}/none", max_words=50)


def test_one_held_out_text_does_not_set_a_threshold(spark):
    ids = [r["doc_id"] for r in spark.range(600).withColumnRenamed("id", "doc_id").where(~kneser_ney._fit_fold()).collect()]
    rows = [(i, "en", 3.0 + k / 1000) for k, i in enumerate(ids[1:])] + [(ids[0], "xx", 9.0)]
    scored = spark.createDataFrame(rows, "doc_id long, lang string, rate double")
    labels = spark.createDataFrame([(i, 1, 0) for i in ids], "doc_id long, quality int, toxic int")
    by_lang, (middle, limit) = kneser_ney.thresholds(scored, labels)
    limits = {r["lang"]: r["limit"] for r in by_lang.collect()}
    assert limits["xx"] < limit + 0.6 and abs(limits["en"] - limit) < 0.05
    assert kneser_ney.thresholds(scored, labels.limit(0))[1] == (0.0, float("inf"))


def test_classifier_separates_held_out_labels(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    got = kneser_ney.query(spark, docs, labels).join(labels, "doc_id").groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("kept")).collect()
    kept = {r["quality"]: r["kept"] for r in got}
    assert kept[1] >= 0.99 and kept[0] <= 0.75


def test_classifier_on_odd_rows(spark, odd, odd_rows, labels, nothing):
    own = spark.createDataFrame([(i, 1, 0) for i in range(15, 50)] + [(None, 1, 0)], labels.schema)
    rows = kneser_ney.query(spark, odd, own).collect()
    assert collections.Counter(r["doc_id"] for r in rows) == collections.Counter(r[0] for r in odd_rows)
    tokens = collections.Counter((r["doc_id"], r["n_tokens"]) for r in rows)
    assert tokens == collections.Counter((r[0], len((r[1] or "").encode().split()) + 1) for r in odd_rows)
    assert all(math.isfinite(r["log10_prob"]) and r["kept"] is not None for r in rows)
    assert kneser_ney.filtered(odd, own).columns == odd.columns
    assert kneser_ney.filtered(odd, labels.limit(0)).count() == len(odd_rows)
    assert kneser_ney.query(spark, nothing, own).count() == 0


# --- language model -----------------------------------------------------------------------


def plain_ppm(train, order):
    """Counts of what followed each context (the longest by occurrence, shorter ones by the longer contexts it followed), escapes by method D."""
    seen = collections.defaultdict(collections.Counter)
    for t in train:
        b = bytes([ppm.BEFORE]) * order + t + bytes([ppm.END])
        for i in range(order, len(b)):
            seen[b[i - order : i]][b[i]] += 1
    for j in range(order, 0, -1):
        for context in [k for k in seen if len(k) == j]:
            for s in seen[context]:
                seen[context[1:]][s] += 1
    seen = {k: {s: 2 * c - 1 for s, c in v.items()} for k, v in seen.items()}

    def score(text):
        b, out = bytes([ppm.BEFORE]) * order + text + bytes([ppm.END]), 0.0
        for i in range(order, len(b)):
            p, barred = 1.0, set()
            for j in range(order, -1, -1):
                context = seen.get(b[i - j : i])
                if context is None:
                    continue
                left = {s: c for s, c in context.items() if s not in barred}
                if not left:
                    continue
                total = sum(left.values()) + len(left)
                if b[i] in left:
                    p *= left[b[i]] / total
                    break
                p *= len(left) / total
                barred |= set(context)
            else:
                p /= max(1, 256 - len(seen.get(b"", ())))
            out += math.log10(p)
        return out

    return score


def check_ppm(spark, docs, rows, order=3, **options):
    train = [r for r in rows if zlib.crc32(b"" if r[0] is None else str(r[0]).encode()) % 7 != 2]
    counts = collections.Counter(w for r in train for w in [*lower(r[1]).split(), b" "])
    n, v = sum(counts.values()), len(counts)
    model, memo, want = plain_ppm([lower(r[1]) for r in train], order), {}, []
    for r in rows:
        words, t = [*lower(r[1]).split(), b" "], lower(r[1])
        if t not in memo:
            memo[t] = model(t)
        base = sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in words)
        want.append((r[0], zlib.crc32(b"" if r[0] is None else str(r[0]).encode()) % 7 == 2, len(words), sum(counts[w] > 0 for w in words), n, base, memo[t]))
    got = [tuple(r) for r in ppm.scores(docs, order=order, **options).collect()]
    key = lambda r: (r[0] is None, r[0] or 0, r[2], round(r[6], 3))
    assert len(got) == len(want)
    for a, b in zip(sorted(got, key=key), sorted(want, key=key)):
        assert a[:5] == b[:5] and a[5:] == pytest.approx(b[5:], rel=1e-9, abs=1e-7)


@pytest.mark.parametrize("frequent", [1 << 20, 30])
def test_scores_of_odd_rows(spark, odd, odd_rows, frequent):
    short = odd.where("text IS NULL OR length(text) < 3000")
    check_ppm(spark, short, [(r[0], r[1]) for r in odd_rows if len(r[1] or "") < 3000], frequent=frequent)


def test_rare_contexts_of_a_large_corpus_are_used(spark):
    rows = [(i, "lorem ipsum " * 5000) for i in range(14)] + [(i, f"word{i} qzxvkj") for i in range(14, 40)]
    assert sum(len(t) for i, t in rows if ppm.learns(i)) > 1 << 19
    check_ppm(spark, spark.createDataFrame(rows, "doc_id long, text string"), rows, order=5)


@pytest.mark.parametrize("order", [1, 2, 4])
def test_scores_of_many_chunks(spark, documents, order):
    docs = documents.orderBy("doc_id").limit(60)
    check_ppm(spark, docs.repartition(2), [(r["doc_id"], r["text"]) for r in docs.collect()], order=order, chunk=2000)


def test_model_beats_the_base_on_held_out_texts():
    import pyarrow.parquet as pq

    t = pq.read_table("/root/testdata/sf0.1/documents.parquet", columns=["doc_id", "text"])
    rows = [(i, lower(x)) for i, x in zip(t["doc_id"].to_pylist(), t["text"].to_pylist())]
    train, held = ([x for i, x in rows if ppm.learns(i) is b] for b in (True, False))
    counts = collections.Counter(w for x in train for w in [*x.split(), b" "])
    n = sum(counts.values()) + len(counts) + 1
    base = sum(math.log10((counts[w] + 1) / n) for x in held for w in [*x.split(), b" "])
    keys, c = np.unique(ppm.gram_keys(train)[0], return_counts=True)
    levels = {ppm.ORDER: (keys, c)}
    for j in range(ppm.ORDER - 1, -1, -1):
        keys, c = np.unique(keys & np.uint64((1 << 8 * (j + 1)) - 1), return_counts=True)
        levels[j] = (keys, c)
    assert ppm.Trie(levels).score(held).sum() > base


def test_trie_bound_only_shortens_contexts(spark, documents):
    full = {r["doc_id"]: r["score"] for r in ppm.scores(documents, order=4).collect()}
    cut = {r["doc_id"]: r["score"] for r in ppm.scores(documents, order=4, contexts=200).collect()}
    assert full.keys() == cut.keys() and all(math.isfinite(v) for v in cut.values()) and sum(cut.values()) < sum(full.values())


def test_scores_without_training(spark, nothing, documents):
    assert ppm.scores(nothing).count() == 0
    alone = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    row = ppm.scores(spark.createDataFrame([(alone, "ab")], "doc_id long, text string")).first()
    assert row["held_out"] and row["n_known"] == 0 and row["score"] == pytest.approx(-3 * math.log10(256))


def test_probabilities_add_up():
    grams, _ = ppm.gram_keys([b"abracadabra", b"abra", b"cab"], 2)
    keys = [np.unique(grams & np.uint64((1 << 8 * (j + 1)) - 1), return_counts=True) for j in range(3)]
    trie = ppm.Trie(dict(enumerate(keys)), 2)
    for context in (b"ab", b"zz", b"ra", bytes([ppm.BEFORE]) * 2, b"xa"):
        g = np.array([context[0] << 16 | context[1] << 8 | s for s in range(256)], np.uint64)
        assert (10 ** trie.log_p(g)).sum() == pytest.approx(1.0)


# --- byte-level BPE -----------------------------------------------------------------------


@pytest.mark.parametrize("frequent", [1 << 18, 20])
def test_bpe_equals_the_library(spark, odd, odd_rows, frequent):
    with open(MULTI, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    short = odd.where("text IS NULL OR length(text) < 3000")
    coded = byte_bpe.decode(byte_bpe.encode(short, MULTI, P.PATTERN, frequent), MULTI).collect()
    want = collections.Counter((r[0], ",".join(map(str, library.encode_ordinary(r[1] or ""))), (r[1] or "").encode()) for r in odd_rows if len(r[1] or "") < 3000)
    assert collections.Counter((r["doc_id"], r["ids"], bytes(r["decoded"])) for r in coded) == want


def test_bpe_query(spark, documents, nothing):
    with open(MULTI, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = set()
    for r in documents.collect():
        ids = library.encode_ordinary(r["text"])
        want.add((r["doc_id"], len(ids), sha(",".join(map(str, ids)).encode()), sha(r["text"].encode())))
    assert {tuple(r) for r in byte_bpe.query(spark, documents).collect()} == want
    assert byte_bpe.query(spark, nothing).count() == 0
