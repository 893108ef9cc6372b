"""Language-model scores by prediction by partial matching over bytes, with a word-unigram base score."""

from __future__ import annotations

import functools
import math
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import scratch, settle

#: Bytes of the longest context.
ORDER = 5
#: Contexts up to this length are read by every task of the model; their number is bounded by the alphabet. Longer ones are partitioned.
SHORT = 2
#: Distinct grams of a task of the model, about.
GRAMS = 1 << 18
#: Bytes of text that share a list of distinct grams.
CHUNK = 16 << 20
#: Words above a share of 1 / FREQUENT of all words are looked up in the task: fewer than FREQUENT.
FREQUENT = 1 << 20
#: Bytes that a task counts or scores at a time.
BLOCK = 2 << 20

#: Bytes that UTF-8 never has: before a text, and its end.
BEFORE, END = 0xFE, 0xFF
#: Stands for the end among words, none of which has a blank.
END_WORD = b" "


def learns(doc_id: int | None) -> bool:
    """Whether a document is one to learn from."""
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 7 != 2


def gram_keys(texts: list[bytes], order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """For each byte of each text and its end: the byte with the ``order`` bytes before it, the latest lowest but one, as one
    number; and the number of these for each text."""
    flat = np.frombuffer(b"".join(bytes([BEFORE]) * order + t + bytes([END]) for t in texts), np.uint8)
    keys = np.zeros(max(0, len(flat) - order), np.uint64)
    for k in range(order + 1):
        keys = (keys << np.uint64(8)) | flat[k : len(flat) - order + k]
    return keys[flat[order:] != BEFORE], np.array([len(t) + 1 for t in texts])


def _blocks(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[int, list, list[bytes]]]:
    """Rows of about BLOCK bytes and one chunk: the chunk, the ids and the texts with A-Z lower-cased."""
    for b in batches:
        ids, texts, size, at = [], [], 0, None
        chunks = b.column(2).to_pylist() if b.num_columns > 2 else [0] * len(b)
        for i, t, chunk in zip(b.column(0), b.column(1), chunks):
            if ids and (size >= BLOCK or chunk != at):
                yield at, ids, texts
                ids, texts, size = [], [], 0
            at = chunk
            ids.append(i.as_py()), texts.append((t.as_py() or b"").lower())
            size += len(texts[-1])
        if ids:
            yield at, ids, texts


def _narrow(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))


# --- counts -------------------------------------------------------------------------------


def word_counts(docs: DataFrame, most: int = 400_000) -> DataFrame:
    """word, learned, c: counts over the documents to learn from and over all. Tasks send partial sums."""

    def rows(counts: tuple[Counter, Counter]) -> pa.RecordBatch:
        words = list(counts[1])
        return pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array([counts[0][w] for w in words], pa.int64()), pa.array(list(counts[1].values()), pa.int64())], names=["word", "learned", "c"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = (Counter(), Counter())
        for _, ids, texts in _blocks(batches):
            for i, t in zip(ids, texts):
                words = [*t.split(), END_WORD]
                counts[1].update(words)
                if learns(i):
                    counts[0].update(words)
            if len(counts[1]) > most:
                yield rows(counts)
                counts = (Counter(), Counter())
        yield rows(counts)

    partial = _narrow(docs).mapInArrow(run, "word binary, learned long, c long")
    return settle(partial.groupBy("word").agg(F.sum("learned").alias("learned"), F.sum("c").alias("c")))


def _merged(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    k, c = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(k)
    k, c = k[order], c[order]
    first = np.flatnonzero(np.r_[True, k[1:] != k[:-1]]) if len(k) else np.zeros(0, int)
    return k[first], np.add.reduceat(c, first) if len(k) else c


def _written(df: DataFrame) -> DataFrame:
    """:func:`settle` with a denser compression, for what is as large as the texts."""
    path = scratch(df.sparkSession, "ppm-written")
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def chunked(docs: DataFrame, size: int = CHUNK) -> DataFrame:
    """doc_id, text, chunk: rows that a task reads one after the other share a chunk of about ``size`` bytes."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        chunk, filled = TaskContext.get().partitionId() << 32, 0
        for b in batches:
            own = []
            for n in pc.fill_null(pc.binary_length(b.column(1)), 0).to_pylist():
                if filled >= size:
                    chunk, filled = chunk + 1, 0
                own.append(chunk)
                filled += n + 1
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(own, pa.int64())], names=["doc_id", "text", "chunk"])

    return _written(_narrow(docs).mapInArrow(run, "doc_id long, text binary, chunk long"))


def chunk_grams(texts: DataFrame, order: int = ORDER, most: int = 1 << 21) -> DataFrame:
    """chunk, key, c for the distinct grams of each chunk: how often each byte followed the ``order`` bytes before it in documents to learn
    from (zero for those that only others have). A chunk's gram may have several rows."""

    def rows(chunk: int, k: np.ndarray, c: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(k), chunk, np.int64)), pa.array(k.view(np.int64)), pa.array(c, pa.int64())], names=["chunk", "key", "c"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, k, c = 0, np.zeros(0, np.uint64), np.zeros(0, np.int64)
        for chunk, ids, own in _blocks(batches):
            if len(k) and (chunk != at or len(k) > most):
                yield rows(at, k, c)
                k, c = k[:0], c[:0]
            at, keys, counts = chunk, [k], [c]
            for kind in (True, False):
                some = [t for i, t in zip(ids, own) if learns(i) is kind]
                if some:
                    found, n = np.unique(gram_keys(some, order)[0], return_counts=True)
                    keys.append(found), counts.append(n if kind else np.zeros(len(n), np.int64))
            k, c = _merged(keys, counts)
        yield rows(at, k, c)

    return _written(texts.select("doc_id", "text", "chunk").mapInArrow(run, "chunk long, key long, c long"))


def write_short(grams: DataFrame, folder: str, length: int) -> None:
    """Writes what followed the contexts of ``length`` bytes and fewer, with counts, below ``folder``. A byte counts once for each longer context
    that it followed, as a context is asked only when the longer ones have failed."""
    low = lambda j: F.col("key").bitwiseAND(F.lit((1 << 8 * (j + 1)) - 1).cast("long")).alias("key")
    level, out = grams.where("c > 0").select(low(length + 1)).distinct(), []
    for j in range(length, -1, -1):
        level = settle(level.groupBy(low(j)).agg(F.count(F.lit(1)).alias("c")))
        out.append(level.select(F.lit(j).alias("length"), "key", "c"))
    if out:
        functools.reduce(DataFrame.unionByName, out).write.parquet(folder)


def long_levels(keys: np.ndarray, seen: np.ndarray, order: int, shortest: int, least: float = 0.0) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """What followed contexts of ``order`` down to ``shortest`` bytes, with counts, from distinct grams and their occurrences. The longest contexts count
    every occurrence, shorter ones as in :func:`write_short`. Contexts with ``least`` occurrences or fewer are left out."""
    out, counts = {}, seen
    for j in range(order, shortest - 1, -1):
        if j < order:
            keys, place = np.unique(keys & np.uint64((1 << 8 * (j + 1)) - 1), return_inverse=True)
            counts, seen = np.bincount(place, minlength=len(keys)), np.bincount(place, seen, len(keys))
        _, place = np.unique(keys >> np.uint64(8), return_inverse=True)
        kept = np.bincount(place, seen)[place] > least if len(keys) else np.zeros(0, bool)
        out[j] = keys[kept], counts[kept]
    return out


def gram_scores(grams: DataFrame, folder: str, order: int = ORDER, contexts: int | None = None) -> DataFrame:
    """chunk, key, log_p for each row of ``grams`` (chunk, key, c; a written table, in which a gram has a row for each chunk that holds it).

    Rows meet in tasks by the last bytes of their context, so that a task has all that is known of the longer contexts of its grams: it adds up
    their occurrences over all chunks, and gives each row its probability, which nothing needs to be joined for. The
    number of tasks follows the number of rows. All contexts are used; with ``contexts``, those of more than ``SHORT`` bytes only above
    a share of 1 / ``contexts`` of all training bytes."""
    rows, total = grams.agg(F.count(F.lit(1)), F.sum("c")).first()
    short, least = min(SHORT, order - 1), (total or 0) / contexts if contexts else 0.0
    write_short(grams, folder, short)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [(b.column(0).to_numpy(), b.column(1).to_numpy().view(np.uint64), b.column(2).to_numpy()) for b in batches]
        if parts:
            chunks, keys, c = (np.concatenate(x) for x in zip(*parts))
            at = np.argsort(keys, kind="stable")
            chunks, keys, c = chunks[at], keys[at], c[at]
            own, sums = _merged([keys], [c])
            trie = Trie(load_short(folder, short) | long_levels(own[sums > 0], sums[sums > 0], order, short + 1, least), order)
            value = np.concatenate([trie.log_p(own[k : k + (1 << 16)]) for k in range(0, len(own), 1 << 16)])
            place = np.cumsum(np.r_[False, keys[1:] != keys[:-1]])
            for k in range(0, len(keys), 1 << 16):
                part = slice(k, k + (1 << 16))
                yield pa.RecordBatch.from_arrays([pa.array(chunks[part]), pa.array(keys[part].view(np.int64)), pa.array(value[place[part]])], names=["chunk", "key", "log_p"])

    suffix = F.shiftright("key", 8).bitwiseAND(F.lit((1 << 8 * (short + 1)) - 1).cast("long"))
    return grams.select("chunk", "key", "c").repartition(rows // GRAMS + 1, suffix).mapInArrow(run, "chunk long, key long, log_p double")


# --- the model in a task ------------------------------------------------------------------


def _find(have: np.ndarray, want: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of each wanted key among sorted ones, and whether it is there."""
    if not len(have):
        return np.zeros(len(want), np.int64), np.zeros(len(want), bool)
    at = np.minimum(np.searchsorted(have, want), len(have) - 1)
    return at, have[at] == want


class Trie:
    """Contexts of 0 to ``order`` bytes and what followed them.

    A byte is predicted in its longest known context; if it never followed there, the model escapes to the context without its first byte, where
    all bytes that followed the longer one are excluded. Of k distinct bytes with counts c, one has the weight 2 c - 1 and the escape the
    weight k (method D). What no context predicts is one of the bytes never seen, all alike."""

    def __init__(self, levels: dict[int, tuple[np.ndarray, np.ndarray]], order: int = ORDER):
        self.order, log = order, np.log10
        self.keys, self.counts, self.contexts, self.start_low, self.start_escape, self.step_low, self.step_sum = ([] for _ in range(7))
        total = distinct = None
        for j in range(order + 1):
            keys, c = levels.get(j, (np.zeros(0, np.uint64), np.zeros(0, np.int64)))
            own = np.argsort(keys)
            keys, c = keys[own], 2 * c[own] - 1
            context = keys >> np.uint64(8)
            first = np.flatnonzero(np.r_[True, context[1:] != context[:-1]]) if len(keys) else np.zeros(0, np.int64)
            add = lambda v: np.add.reduceat(v, first) if len(first) else np.zeros(0, np.int64)
            sums, kinds, context = add(c), add(np.ones(len(c), np.int64)), context[first]
            low, chain = np.zeros(len(context)), np.zeros(len(context))
            if j and len(context):
                above, _ = _find(self.contexts[j - 1], context & np.uint64((1 << 8 * (j - 1)) - 1))
                same, _ = _find(self.keys[j - 1], keys & np.uint64((1 << 8 * j) - 1))
                left, new = total[above] - add(self.counts[j - 1][same]), distinct[above] - kinds
                low = np.where(new > 0, log(np.maximum(left + new, 1)), 0.0)
                chain = np.where(new > 0, log(np.maximum(new, 1)) - low, 0.0) + self.step_sum[j - 1][above]
            self.keys.append(keys), self.counts.append(c), self.contexts.append(context)
            self.start_low.append(log(np.maximum(sums + kinds, 1))), self.start_escape.append(log(np.maximum(kinds, 1)) - log(np.maximum(sums + kinds, 1)))
            self.step_low.append(low), self.step_sum.append(chain)
            total, distinct = sums, kinds
        self.unseen = -math.log10(max(1, 256 - len(self.keys[0])))

    def log_p(self, grams: np.ndarray) -> np.ndarray:
        """log10 probability of the last byte of each (distinct, sorted) gram after the others."""
        n = len(grams)
        out, found, longest = np.zeros(n), np.zeros(n, bool), np.full(n, -1)
        escape, chain, below_low, below_chain = np.zeros(n), np.zeros(n), np.zeros(n), np.zeros(n)
        open_ = np.arange(n)
        for j in range(self.order, -1, -1):
            if not len(open_):
                break
            g = grams[open_]
            at, known = _find(self.contexts[j], (g >> np.uint64(8)) & np.uint64((1 << 8 * j) - 1))
            place, hit = _find(self.keys[j], g & np.uint64((1 << 8 * (j + 1)) - 1))
            new = known & (longest[open_] < 0)
            own = open_[hit]
            value = np.log10(self.counts[j][place[hit]])
            direct = new[hit]
            # found in the longest context, or after escapes: the start's, those between, and the last step's own sum
            out[own] = np.where(direct, value - self.start_low[j][at[hit]], escape[own] + chain[own] - below_chain[own] + value - below_low[own])
            found[own] = True
            first = open_[new & ~hit]
            longest[first], escape[first], chain[first] = j, self.start_escape[j][at[new & ~hit]], self.step_sum[j][at[new & ~hit]]
            missed = open_[known & ~hit]
            below_low[missed], below_chain[missed] = self.step_low[j][at[known & ~hit]], self.step_sum[j][at[known & ~hit]]
            open_ = open_[~hit]
        rest = ~found
        out[rest] = escape[rest] + chain[rest] + self.unseen
        return out

    def score(self, texts: list[bytes]) -> np.ndarray:
        """log10 probability of each text and its end."""
        grams = np.unique(gram_keys(texts, self.order)[0])
        return score(texts, (grams, self.log_p(grams)), self.order)


def _table(folder: str):
    import pyarrow.dataset as ds
    from pyarrow import fs

    system, root = fs.FileSystem.from_uri(folder) if ":" in folder else (fs.LocalFileSystem(), folder)
    return ds.dataset(root, filesystem=system, format="parquet").to_table()


@functools.lru_cache(1)
def load_short(folder: str, length: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    t = _table(folder) if length >= 0 else None
    if not t:
        return {}
    n, key, c = t["length"].to_numpy(), t["key"].to_numpy().view(np.uint64), t["c"].to_numpy()
    return {j: (key[n == j], c[n == j]) for j in range(length + 1)}


@functools.lru_cache(1)
def load_chunk(folder: str, chunk: int) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct grams of a chunk and their log10 probabilities."""
    t = _table(f"{folder}/chunk={chunk}")
    key, value = t["key"].to_numpy().view(np.uint64), t["log_p"].to_numpy()
    at = np.argsort(key)
    return key[at], value[at]


def score(texts: list[bytes], known: tuple[np.ndarray, np.ndarray], order: int = ORDER) -> np.ndarray:
    """log10 probability of each text and its end, from those of all grams of their chunk."""
    keys, sizes = gram_keys(texts, order)
    distinct, place = np.unique(keys, return_inverse=True)
    at, hit = _find(known[0], distinct)
    if not hit.all():
        raise ValueError("a gram of a text is not among those of its chunk")
    return np.add.reduceat(known[1][at][place], np.r_[0, np.cumsum(sizes)[:-1]])


@functools.lru_cache(1)
def load_words(folder: str) -> tuple[dict[bytes, int], np.ndarray]:
    t = _table(folder)
    return {w: i for i, w in enumerate(t["word"].to_pylist())}, t["learned"].to_numpy()


def scores(docs: DataFrame, order: int = ORDER, contexts: int | None = None, frequent: int = FREQUENT, chunk: int = CHUNK) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for each row.

    Words and byte contexts are counted over all documents to learn from, and all contexts are used unless ``contexts`` bounds them. The distinct
    grams of each ``chunk`` of texts go to the task that has their part of the model, come back with their probabilities and are written for the chunk; a gram has
    a few rows for each chunk, so no key is hot. A task scores its rows with their chunk's grams and looks frequent words up; each text's rarer words
    are joined with their counts, and none of those has more than 1 / ``frequent`` of all words.

    Null and empty texts have the end alone; a null id counts as an empty text of its digits; repeated rows are each scored and each learned from;
    other columns are ignored; an empty table gives no rows, and without documents to learn from every byte is equally likely."""
    spark = docs.sparkSession
    words = word_counts(docs)
    n_train, n_all, distinct = (r or 0 for r in words.agg(F.sum("learned"), F.sum("c"), F.count_if(F.col("learned") > 0)).first())
    word_folder, short_folder, gram_folder = (scratch(spark, f"ppm-{k}") for k in ("words", "short", "grams"))
    words.where(F.col("c") * frequent > n_all).select("word", "learned").write.parquet(word_folder)
    texts = chunked(docs, chunk)
    lists = chunk_grams(texts, order)
    named = gram_scores(lists, short_folder, order, contexts).repartition("chunk")
    named.sortWithinPartitions("chunk").write.option("compression", "zstd").partitionBy("chunk").parquet(gram_folder)
    whole = math.log10(n_train + distinct + 1)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, learned = load_words(word_folder)
        gain, known = np.append(np.log10(learned + 1.0), 0.0), np.append(learned > 0, False)
        for at, ids, texts in _blocks(batches):
            tokens, base, hits, rare = [], [], [], []
            for t in texts:
                own = [*t.split(), END_WORD]
                code = np.fromiter((number.get(w, -1) for w in own), np.int64, len(own))
                tokens.append(len(own)), base.append(float(gain[code].sum())), hits.append(int(known[code].sum()))
                rare.append([{"word": w, "n": n} for w, n in Counter(own[k] for k in np.flatnonzero(code < 0).tolist()).items()])
            yield pa.RecordBatch.from_arrays([
                pa.array(ids, pa.int64()), pa.array([not learns(i) for i in ids]), pa.array(tokens, pa.int64()), pa.array(hits, pa.int64()), pa.array(base),
                pa.array(rare, pa.list_(pa.struct([("word", pa.binary()), ("n", pa.int64())]))), pa.array(score(texts, load_chunk(gram_folder, at), order)),
            ], names=["doc_id", "held_out", "n_tokens", "hits", "gain", "rare", "score"])

    kind = "doc_id long, held_out boolean, n_tokens long, hits long, gain double, rare array<struct<word:binary,n:bigint>>, score double"
    scored = settle(texts.select("doc_id", "text", "chunk").mapInArrow(run, kind).withColumn("tag", F.monotonically_increasing_id()))
    rest = scored.select("tag", F.inline("rare")).join(words.where(F.col("c") * frequent <= n_all).select("word", "learned").hint("merge"), "word")
    more = rest.groupBy("tag").agg(F.sum(F.when(F.col("learned") > 0, F.col("n")).otherwise(0)).alias("more"), F.sum(F.col("n") * F.log10(F.col("learned") + 1.0)).alias("rise"))
    base = F.col("gain") + F.coalesce("rise", F.lit(0.0)) - F.col("n_tokens") * F.lit(whole)
    return scored.drop("rare").join(more, "tag", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("hits") + F.coalesce("more", F.lit(0))).alias("n_known"),
        F.lit(n_train).cast("long").alias("train_tokens"), base.alias("base_score"), "score",
    )


def query(spark: SparkSession, docs: DataFrame) -> DataFrame:
    return scores(docs)
