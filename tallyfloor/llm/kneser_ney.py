"""Quality classifier: perplexity under an interpolated modified Kneser-Ney model of trusted text."""

from __future__ import annotations

import dataclasses
import functools
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .arrays import open_array, write_array
from .common import held, relieve, scratch, settle, without
from .quality_rules import trusted_ids, words_of

#: Trusted documents and words that the model is fitted on at most. They bound it at any size of the corpus.
TRUSTED_DOCS, TRUSTED_WORDS = 4_000, 1_000_000
#: Parts of the model's tables, and the tables: discounted shares (a) and what is left to the lower order (g, the gap).
SHARDS, KINDS = 8, ("a3", "g3", "a2", "g2", "a1")
#: Quantile of trusted texts' log-perplexity in a language, and how many spreads (that quantile less the median) a text may lie above it.
QUANTILE, SLACK = 0.99, 0.6
#: Texts with the overall quantiles that temper the quantiles of a language with few held-out ones.
PRIOR_TEXTS = 20
#: Tokens at the median that temper the verdict on a short text.
PRIOR_TOKENS = 20
#: Bytes of text that a task scores at a time.
BLOCK = 2 << 20
#: Cells of the log10 scale on which quantiles are counted.
GRID = 1000

#: Stand for the places before the first word and after the last one.
START, END = -1, -2

P1, P2, P3, P4, P5 = (np.uint64(x) for x in (  # fixed values of the XXH64 hash
    0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def _rotate(x: np.ndarray, r: int) -> np.ndarray:
    return (x << np.uint64(r)) | (x >> np.uint64(64 - r))


def hash_longs(*columns: np.ndarray) -> np.ndarray:
    """What SQL's xxhash64 gives for these longs."""
    h: np.ndarray = np.full(len(columns[0]), 42, np.uint64)
    with np.errstate(over="ignore"):
        for c in columns:
            h = h + P5 + np.uint64(8)
            h = h ^ (_rotate(c.view(np.uint64) * P2, 31) * P1)
            h = _rotate(h, 27) * P1 + P4
            h = (h ^ (h >> np.uint64(33))) * P2
            h = (h ^ (h >> np.uint64(29))) * P3
            h = h ^ (h >> np.uint64(32))
    return h.view(np.int64)


# --- the model ----------------------------------------------------------------------------


def _discounts(counts: DataFrame) -> list[float]:
    """Discounts of counts of one, two, and three or more, from how often counts of 1 to 4 occur."""
    seen = {r["c"]: r["count"] for r in counts.where("c <= 4").groupBy("c").count().collect()}
    n1, n2, n3, n4 = (float(seen.get(k, 0)) for k in (1, 2, 3, 4))
    y = n1 / (n1 + 2 * n2) if n1 + 2 * n2 else 0.5
    raw = [1 - 2 * y * n2 / n1 if n1 else y, 2 - 3 * y * n3 / n2 if n2 else y, 3 - 4 * y * n4 / n3 if n3 else y]
    return [min(max(d, 0.05), k + 0.95) for k, d in enumerate(raw)]


def _parts(counts: DataFrame, context: list[str]) -> tuple[DataFrame, list[float]]:
    """Adds a (the discounted share of its context) and back (the share left to the lower order)."""
    d = _discounts(counts)
    own = F.when(F.col("c") == 1, d[0]).when(F.col("c") == 2, d[1]).otherwise(d[2])
    sums = counts.groupBy(*context).agg(F.sum("c").alias("total"), F.sum(own).alias("left")) if context else None
    if sums is None:
        total, left = counts.agg(F.sum("c"), F.sum(own)).first()
        return counts.withColumns({"a": (F.col("c") - own) / float(total or 1)}), [float(left or 1) / float(total or 1)]
    return counts.join(sums, context).withColumns({"a": (F.col("c") - own) / F.col("total"), "back": F.col("left") / F.col("total")}), d


def train(docs: DataFrame, trusted: DataFrame, folder: str, max_words: int = TRUSTED_WORDS) -> "Model":
    """Counts three-word runs of the trusted documents, derives the lower orders' continuation counts, joins counts with the sums of
    their contexts, and writes all tables in ``SHARDS`` parts sorted by key below ``folder``. Documents are taken in the order of their hashes; one that
    does not fit into what is left of ``max_words`` is passed over, and if none fits, that is an error."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(trusted), "doc_id")
    own = settle(own.select("doc_id", F.transform(words_of(F.col("text")), lambda w: F.xxhash64(w)).alias("w")))
    sizes = own.groupBy("doc_id").agg(F.sum(F.size("w")).alias("n")).orderBy(F.xxhash64("doc_id"), "doc_id").collect()  # at most TRUSTED_DOCS rows
    fit, words = [], 0
    for r in sizes:
        if words + r["n"] <= max_words:
            fit.append((r["doc_id"],))
            words += r["n"]
    if sizes and not fit:
        raise ValueError(f"no trusted document has {max_words} words or fewer, so the model would be fitted on nothing")
    w = own.join(F.broadcast(own.sparkSession.createDataFrame(fit, "doc_id long")), "doc_id").select(F.concat(F.array(F.lit(START), F.lit(START)).cast("array<long>"), F.col("w"), F.array(F.lit(END)).cast("array<long>")).alias("w"))
    runs = w.select(F.inline(F.transform(F.sequence(F.lit(1), F.size("w") - 2), lambda i: F.struct(
        F.element_at("w", i).alias("x"), F.element_at("w", i + 1).alias("y"), F.element_at("w", i + 2).alias("z")))))
    three = settle(runs.groupBy("x", "y", "z").agg(F.count(F.lit(1)).alias("c")))
    two = settle(three.groupBy("y", "z").agg(F.count(F.lit(1)).alias("c")))
    one = settle(two.groupBy("z").agg(F.count(F.lit(1)).alias("c")))
    t3, _ = _parts(three, ["x", "y"])
    t2, _ = _parts(two, ["y"])
    t1, left = _parts(one, [])
    row = lambda df, kind, key, value: df.select(F.lit(KINDS.index(kind)).cast("tinyint").alias("kind"), key.alias("key"), value.alias("value"))
    tables = [
        row(t3, "a3", F.xxhash64("x", "y", "z"), F.col("a")), row(t3.select("x", "y", "back").distinct(), "g3", F.xxhash64("x", "y"), F.col("back")),
        row(t2, "a2", F.xxhash64("y", "z"), F.col("a")), row(t2.select("y", "back").distinct(), "g2", F.col("y"), F.col("back")),
        row(t1, "a1", F.col("z"), F.col("a")),
    ]
    model = functools.reduce(DataFrame.unionByName, tables).withColumn("shard", F.pmod("key", F.lit(SHARDS)).cast("int"))

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = list(batches)  # a shard of the bounded model
        t = pa.Table.from_batches(batches).cast(schema) if batches else schema.empty_table()
        kind, shard, key, value = (t[c].to_numpy() for c in ("kind", "shard", "key", "value"))
        rows = []
        for s in np.unique(shard):
            for k in np.unique(kind):
                own = (kind == k) & (shard == s)
                rows.append((int(k), int(s), write_array(folder, key[own]), write_array(folder, value[own])))
        yield pa.RecordBatch.from_pylist([dict(zip(("kind", "shard", "keys", "values"), r)) for r in rows], parts)

    schema = pa.schema([("kind", pa.int8()), ("key", pa.int64()), ("value", pa.float64()), ("shard", pa.int32())])
    parts = pa.schema([("kind", pa.int32()), ("shard", pa.int32()), ("keys", pa.string()), ("values", pa.string())])
    spread = model.repartition(SHARDS, "shard").sortWithinPartitions("shard", "kind", "key")
    files = spread.mapInArrow(write, "kind int, shard int, keys string, values string").collect()  # SHARDS x KINDS rows
    names = tuple(sorted((KINDS[r["kind"]], r["shard"], r["keys"], r["values"]) for r in files))
    return Model(folder, names, left[0], float(one.count()))


@dataclasses.dataclass(frozen=True)
class Model:
    """Where the tables are, the share of the unigrams left to unseen words, and the number of distinct words."""

    folder: str
    names: tuple[tuple[str, int, str, str], ...]
    left: float
    words: float


def _load(folder: str, names: tuple) -> dict[tuple[str, int], tuple[np.ndarray, np.ndarray]]:
    """The worker's copy of the tables: sorted keys and values of each kind and shard."""
    return held("kneser_ney", (folder, names), lambda: _mapped(folder, names))


def _mapped(folder: str, names: tuple) -> dict[tuple[str, int], tuple[np.ndarray, np.ndarray]]:
    nothing = (np.empty(0, np.int64), np.empty(0))
    out = {(kind, shard): nothing for kind in KINDS for shard in range(SHARDS)}
    return out | {(kind, shard): (open_array(folder, keys), open_array(folder, values)) for kind, shard, keys, values in names}


def _join(model: dict, kind: str, keys: np.ndarray, missing: float) -> np.ndarray:
    """Values of keys: the distinct ones, sorted, meet one shard after the other."""
    distinct, place = np.unique(keys, return_inverse=True)
    out = np.full(len(distinct), missing)
    shard = distinct % SHARDS
    for s in range(SHARDS):
        have, value = model[kind, s]
        own = np.flatnonzero(shard == s)
        if len(have) and len(own):
            at = np.minimum(np.searchsorted(have, distinct[own]), len(have) - 1)
            hit = have[at] == distinct[own]
            out[own[hit]] = value[at[hit]]
    return out[place]


def mark():
    """Digest of what a verdict depends on: id, language and text."""
    part = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit(""))
    return F.unhex(F.md5(F.concat_ws("|", part("doc_id"), part("lang"), F.coalesce(F.col("text"), F.lit(""))).cast("binary")))


def score(docs: DataFrame, fitted: Model, marked: bool = False) -> DataFrame:
    """doc_id, lang, n_tokens (words and one end), log10_prob for each row, in the task that reads it; with ``marked`` also its :func:`mark`."""
    carried = ["doc_id", "lang", *(["mark"] if marked else [])]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        model, digest = _load(fitted.folder, fitted.names), xxhash.xxh64_intdigest
        for b in batches:
            texts, at = b.column("text"), 0
            while at < len(b):
                stop, size, sizes, flat = at, 0, [], []
                while stop < len(b) and size < BLOCK:
                    t = texts[stop].as_py() or b""
                    w = np.fromiter((digest(x, 42) for x in t.split()), np.uint64).view(np.int64)
                    flat.append(np.concatenate([[START, START], w, [END]]).astype(np.int64))
                    sizes.append(len(w) + 1)
                    size += len(t)
                    stop += 1
                h = np.concatenate(flat)
                x, y, z = h[:-2], h[1:-1], h[2:]
                inside = np.concatenate([np.r_[np.ones(n, bool), np.zeros(2, bool)] for n in sizes])[:-2]
                x, y, z = x[inside], y[inside], z[inside]
                p = _join(model, "a1", z, 0.0) + fitted.left / (fitted.words + 1)
                p = _join(model, "a2", hash_longs(y, z), 0.0) + _join(model, "g2", y, 1.0) * p
                p = _join(model, "a3", hash_longs(x, y, z), 0.0) + _join(model, "g3", hash_longs(x, y), 1.0) * p
                total = np.add.reduceat(np.log10(p), np.r_[0, np.cumsum(sizes)[:-1]])
                yield pa.RecordBatch.from_arrays(
                    [*(b.column(c).slice(at, stop - at) for c in carried), pa.array(sizes, pa.int64()), pa.array(total)],
                    names=[*carried, "n_tokens", "log10_prob"])
                at = stop
            relieve()

    narrow = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), *([mark().alias("mark")] if marked else []), F.col("text").cast("binary").alias("text"))
    return narrow.mapInArrow(run, f"doc_id long, lang string, {'mark binary, ' if marked else ''}n_tokens long, log10_prob double")


def _fit_fold():
    """Half of the ids, by a hash: good ones of it may train the model, those of the other half set the thresholds."""
    return F.pmod(F.xxhash64(F.col("doc_id").cast("long"), F.lit("fold")), F.lit(2)) == 0


def thresholds(scored: DataFrame, labels: DataFrame, quantile: float = QUANTILE, slack: float = SLACK) -> tuple[DataFrame, tuple[float, float]]:
    """lang, middle, limit: the median log10 perplexity of a language's documents that are labelled good and in the half that the model has not seen, and their
    quantile plus ``slack`` times its distance from the median. All such documents count, in cells of 1 / GRID; the second value is the
    same over all languages, for those without any. A language's median and quantile are drawn to those over all by ``PRIOR_TEXTS`` texts, so
    that a few texts do not set a threshold alone."""
    held_out = labels.where("quality = 1 AND coalesce(toxic, 0) = 0").where(~_fit_fold()).select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    cells = scored.join(held_out, "doc_id").groupBy("lang", F.floor(F.col("rate") * GRID).alias("cell")).agg(F.count(F.lit(1)).alias("n"))
    cells = settle(cells)  # a row for each language and cell

    def at(share: float, keys: list[str]) -> DataFrame:
        w = Window.partitionBy(*keys, F.lit(0))
        tally = cells.groupBy(*keys, "cell").agg(F.sum("n").alias("n"))
        part = tally.withColumn("below", F.sum("n").over(w.orderBy("cell"))).withColumn("all", F.sum("n").over(w))
        return part.where(F.col("below") >= share * F.col("all")).groupBy(*keys).agg(((F.min("cell") + 1) / GRID).alias("v"), F.first("all").alias("texts"))

    m, u = ((t.first() or [0.0])[0] for t in (at(0.5, []), at(quantile, [])))
    if m is None or not cells.limit(1).count():
        m, u = 0.0, float("inf")
    drawn = lambda over: (F.col("texts") * F.col("v") + PRIOR_TEXTS * F.lit(over)) / (F.col("texts") + PRIOR_TEXTS)
    mid = at(0.5, ["lang"]).select("lang", drawn(m).alias("middle"))
    top = at(quantile, ["lang"]).select("lang", drawn(u).alias("top"))
    both = mid.join(top, mid["lang"].eqNullSafe(top["lang"])).select(mid["lang"], "middle", (F.col("top") + slack * (F.col("top") - F.col("middle"))).alias("limit"))
    return both, (m, u + slack * (u - m))


def classify(docs: DataFrame, labels: DataFrame, trusted_docs: int = TRUSTED_DOCS, trusted_words: int = TRUSTED_WORDS, quantile: float = QUANTILE, slack: float = SLACK, marked: bool = False) -> DataFrame:
    """doc_id, lang, n_tokens, log10_prob, perplexity, threshold, kept for each row; with ``marked`` also its :func:`mark`.

    A text is kept if its log10 perplexity, drawn to the median of its language by ``PRIOR_TOKENS`` tokens, is at most the language's threshold.
    Null texts are empty (one end token), a null language is one of its own, languages without trusted texts use the threshold over all, null ids are
    never trusted, repeated rows are each judged, without labels all is kept, and other columns are ignored."""
    trusted = settle(trusted_ids(labels.where(_fit_fold()), trusted_docs))
    fitted = train(docs, trusted, scratch(docs.sparkSession, "kneser-ney"), trusted_words)
    scored = settle(score(docs, fitted, marked).withColumn("rate", -F.col("log10_prob") / F.col("n_tokens")))
    by_lang, (middle, limit) = thresholds(scored, labels, quantile, slack)
    by_lang = settle(by_lang)  # a row for each language
    same = scored["lang"].eqNullSafe(by_lang["lang"])
    judged = scored.join(F.broadcast(by_lang) if by_lang.count() <= 10_000 else by_lang, same, "left").select(
        scored["*"], F.coalesce("middle", F.lit(middle)).alias("middle"), F.coalesce("limit", F.lit(limit)).alias("limit"))
    tempered = (F.col("rate") * F.col("n_tokens") + PRIOR_TOKENS * F.col("middle")) / (F.col("n_tokens") + PRIOR_TOKENS)
    return judged.select("doc_id", "lang", *(["mark"] if marked else []), "n_tokens", "log10_prob", F.pow(F.lit(10.0), "rate").alias("perplexity"),
                         F.pow(F.lit(10.0), "limit").alias("threshold"), (tempered <= F.col("limit")).alias("kept"))


def filtered(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that are not rejected, with their columns. A verdict belongs to an id, language and text, so rows without an id are judged
    like others, and of rows that share an id each goes or stays by its own text. Only the digests of rejected rows are joined back."""
    gone = settle(classify(docs, labels, marked=True, **options).where("NOT kept").select("mark").distinct())
    return without(docs.select(F.struct(*docs.columns).alias("row"), mark().alias("mark")), gone, "mark").select("row.*")


def query(spark, docs: DataFrame, labels: DataFrame) -> DataFrame:
    return classify(docs, labels)
