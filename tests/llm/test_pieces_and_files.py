"""Token counts, token files, packing and sharding beside plain Python."""

import collections
import math
import os
import subprocess
import sys
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from tallyfloor.llm import interleave, packing, token_files, token_trie
from tallyfloor.llm.encoding import TextEncoder
from tallyfloor.llm.common import scratch

BYTES, WORDS, UNIGRAM = (P.path(f) for f in ("byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"))


def library(path):
    t = Tokenizer.from_file(path)
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


LETTERS = st.text(alphabet=st.sampled_from(list("abTİσΣé́ \n\n  ,.'ts-19²ǅ\t\x1c\x85\xa0　<|endoftext|>世界😀")), max_size=40)


@pytest.mark.parametrize("path", [BYTES, WORDS])
def test_encoder_equals_the_library(path):
    encoder, want = TextEncoder(path, max_words=50), library(path)

    @settings(max_examples=300, deadline=None)
    @given(st.lists(st.one_of(LETTERS, st.text(max_size=20)), max_size=4))
    def run(texts):
        got = [np.frombuffer(b, encoder.dtype).tolist() for b in encoder.encode(texts)]
        assert got == [want(t) for t in texts]

    run()


def test_released_memory_goes_back():
    """What an operator's memory of words took is given back to the system when a worker turns to another operator."""
    run = """
import re, sys
sys.path.insert(0, sys.argv[1])
import numpy, pyarrow as pa, public_tokenizers as P
from tallyfloor.llm import encoding
from tallyfloor.llm.common import held

def used():
    return sum(map(int, re.findall(r"\\nPss_(?:Anon|Shmem):\\s+(\\d+)", open("/proc/self/smaps_rollup").read()))) / 1024

before = used()
enc = encoding.encoder(P.path("word_bpe_49k.json"))
assert "whole" not in vars(enc)  # made for texts with a special token's string only
for at in range(0, 300_000, 10_000):
    column = pa.array([" ".join("w" + "".join(chr(97 + int(d)) for d in str(7919 * (at + i + k))) for k in range(100)) for i in range(0, 10_000, 100)])
    enc.encode(column.to_pylist())
full = used()
del enc, column
held("another", 1, lambda: None)
print(full - before, used() - before)
"""
    out = subprocess.run([sys.executable, "-c", run, os.getcwd()], capture_output=True, text=True, check=True).stdout
    full, left = map(float, out.split())
    assert full > 60 and left < 0.75 * full, out


def crc(ids):
    return zlib.crc32(np.asarray(ids, "<u4").tobytes())


def test_token_files(spark, odd, odd_rows, tmp_path):
    folder = f"{tmp_path}/files"
    manifest = token_files.write(odd, BYTES, folder, 2, length=64, file_ids=5000)
    got = [tuple(r) for r in token_files.read_documents(manifest, folder).orderBy("start").select("doc_id", "start", "n_tokens", "ids").collect()]
    enc, start = library(BYTES), 0
    assert [r[0] for r in got] == sorted((r[0] for r in odd_rows), key=lambda k: (k is not None, k or 0))
    left = collections.Counter((r[0], tuple(enc(r[1]) + [2])) for r in odd_rows)
    for doc, at, n, ids in got:
        own = tuple(np.frombuffer(ids, "<u4").tolist())
        assert at == start and n == len(own)
        start += n
        left[doc, own] -= 1
    assert set(left.values()) == {0}
    files = manifest.orderBy("part", "number").collect()
    assert len(files) > 1
    reader, flat = token_files.SequenceReader(folder, files[0]["file"]), []
    for k in range(-(-files[0]["ids"] // 64)):
        ids, mask = reader[k]
        assert len(ids) == len(mask) == 64
        flat += ids[mask].tolist()
    assert flat == [i for _, own in reader.documents() for i in own.tolist()] and len(flat) == files[0]["ids"]


def test_token_files_of_nothing(spark, nothing, tmp_path):
    manifest = token_files.write(nothing, BYTES, f"{tmp_path}/none", 2)
    assert manifest.count() == 0 and token_files.read_documents(manifest, f"{tmp_path}/none").count() == 0


def check_pieces(rows, ids_of, length, n_docs):
    """Every id lies in one piece, sequences have no gaps, only the last one is short."""
    by_doc, by_seq = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r), by_seq[r["sequence_id"]].append(r)
    for doc, pieces in by_doc.items():
        want = collections.Counter()
        for ids in ids_of[doc]:
            want.update((p, i) for p, i in enumerate(ids))
        got = collections.Counter()
        for r in pieces:
            own = np.frombuffer(r["ids"], "<u4").tolist()
            got.update((r["start"] + k, i) for k, i in enumerate(own))
            assert r["doc_tokens"] in {len(x) for x in ids_of[doc]}
        assert got == want
    assert len(by_doc) == n_docs
    for s, pieces in by_seq.items():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += len(r["ids"]) // 4
        assert at == length or s == max(by_seq) and at <= length
    assert sorted(by_seq) == list(range(len(by_seq)))


@pytest.mark.parametrize("queues", [4096, 1])
def test_packing(spark, odd, odd_rows, queues):
    enc, ids_of = library(WORDS), collections.defaultdict(list)
    for r in odd_rows:
        ids_of[r[0]].append(enc(r[1]) + [2])
    rows = packing.pack(odd.repartition(3), WORDS, 2, length=128, window=4, queues=queues).collect()
    check_pieces(rows, ids_of, 128, len(ids_of))


def test_packing_holds_the_mixture(spark, documents):
    window = 4 * 256
    rows = packing.pack(documents.repartition(5), WORDS, 2, length=256, window=4).collect()
    total, seen = collections.Counter(), collections.defaultdict(collections.Counter)
    for r in rows:
        n, place = len(r["ids"]) // 4, r["sequence_id"] * 256 + r["offset"]
        total[r["source"]] += n
        seen[place // window][r["source"]] += n
    whole = sum(total.values())
    for w, c in seen.items():
        if (w + 1) * window <= whole:
            for s, n in total.items():
                assert abs(c[s] - window * n / whole) <= 2 + len(total)


def test_packing_with_given_shares(spark, documents):
    rows = packing.pack(documents, WORDS, 2, length=256, window=4, shares={"src0": 9_000_000}).collect()
    first = sum(len(r["ids"]) // 4 for r in rows if r["source"] == "src0" and r["sequence_id"] < 4)
    assert first > 0.8 * 4 * 256


def test_packing_loads_no_tokenizer_on_the_driver(spark, documents, monkeypatch):
    driver = os.getpid()

    def only_in_workers(path):
        import os

        from tallyfloor.llm.encoding import encoder

        assert os.getpid() != driver
        return encoder(path)

    monkeypatch.setattr(packing, "encoder", only_in_workers)
    rows = packing.query(spark, documents).collect()
    assert len({r["doc_id"] for r in rows}) == documents.count()


def test_packing_of_nothing(spark, nothing):
    assert packing.pack(nothing, WORDS, 2).count() == 0


def test_sharding(spark, odd, odd_rows):
    rows = interleave.interleave(odd, 16).collect()
    assert len(rows) == len(odd_rows) and "shard" in rows[0]
    by = collections.defaultdict(list)
    for r in rows:
        by[r["shard"]].append(r["slot"])
    counts = [len(by[k]) for k in range(16)]
    assert max(counts) - min(counts) <= 1 and all(sorted(v) == list(range(len(v))) for v in by.values())


def test_shards_hold_the_mixture(spark, documents):
    rows = interleave.interleave(documents.select("doc_id", "source"), 16, seed=3).collect()
    total = collections.Counter(r["source"] for r in rows)
    for k in range(16):
        own = collections.Counter(r["source"] for r in rows if r["shard"] == k)
        assert all(abs(own[s] - n / 16) <= 1.5 for s, n in total.items())
    again = interleave.interleave(documents.select("doc_id", "source").repartition(7), 16, seed=3).collect()
    assert {tuple(r) for r in rows} == {tuple(r) for r in again}


def test_sharding_of_nothing(spark, nothing):
    assert interleave.interleave(nothing, 16).count() == 0


def test_written_shards(spark, documents, tmp_path):
    interleave.write_shards(documents, f"{tmp_path}/shards", 4)
    back = spark.read.parquet(f"{tmp_path}/shards")
    assert back.count() == documents.count() and back.select("shard").distinct().count() == 4


def best_cut(word, log_p, byte_p):
    """Unigram segmentation of one word by itself."""
    best = [(0.0, 0)] + [(-math.inf, 0)] * len(word)
    for end in range(1, len(word) + 1):
        options = [(best[s][0] + log_p[word[s:end]], s, best[s][1] + 1) for s in range(end) if word[s:end] in log_p]
        if word[end - 1] not in log_p:
            n = len(word[end - 1].encode())
            options.append((best[end - 1][0] + n * byte_p, end - 1, best[end - 1][1] + n))
        top = max(options, key=lambda o: (o[0], -o[1]))
        best[end] = (top[0], top[2])
    return best[-1]


@pytest.mark.parametrize("nodes", [400_000, 40])
def test_token_counts(spark, odd, odd_rows, nodes):
    log_p, byte_p = token_trie.zipf_scores(UNIGRAM)
    memo = {}
    want = collections.Counter()
    for r in odd_rows:
        words = ["▁" + w.decode() for w in (r[1] or "").encode().split()]
        for w in words:
            if w not in memo:
                memo[w] = best_cut(w, log_p, byte_p)
        want[r[0], len(words), sum(memo[w][1] for w in words), round(sum(memo[w][0] for w in words), 3)] += 1
    got = collections.Counter((r[0], r[1], r[2], round(r[3], 3)) for r in token_trie.token_counts(odd, UNIGRAM, max_nodes=nodes).collect())
    assert got == want


def test_token_counts_of_nothing(spark, nothing):
    assert token_trie.token_counts(nothing, UNIGRAM).count() == 0


def test_manifest_folder_is_shared(spark):
    assert scratch(spark, "x") != scratch(spark, "x")


@pytest.mark.parametrize("path", [BYTES, WORDS])
def test_paragraphs_special_strings_and_long_texts(path):
    """Against the library's own call; the memory of words and pieces may be as small as can be."""
    words = "the Quick brown élan, naïve. 日本語 don't x1y2 ... <|endof text|> < |".split(" ")
    long = "".join(w + (" ", "\n", "\n\n", "  ", "\t")[i % 5] for i, w in enumerate(words * 3000))
    texts = [
        "one\n\ntwo\n\n\nthree", " \n\n lead", "a<|endoftext|>b", "<|endoftext|>", "x <|EndOfText|> y", "<|startoftext|>\n\nz", "<|end", long, long + "<|endoftext|> tail",
    ]
    for most in (1, 1_000_000):
        own = TextEncoder(path, most)
        for _ in range(2):
            for text, ids in zip(texts, own.encode(texts)):
                assert np.frombuffer(ids, own.dtype).tolist() == library(path)(text)
