"""Quality rules: counts of a text, and a likelihood ratio of hashed n-grams. DataFrame functions only."""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, functions as F

#: Buckets of n-grams, which bounds the table of weights at any size of the corpus.
BUCKETS = 1 << 14
#: Trusted documents at most whose words estimate the target; the raw corpus is counted whole.
TRUSTED = 20_000
#: Mean log ratio per n-gram below which a text is unlike the trusted ones.
THRESHOLD = -0.2

BLANKS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, also where a lambda uses it for each element."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    """Maximal runs of anything but ASCII white space (null: none)."""
    plain = F.translate(F.coalesce(text, F.lit("")), BLANKS, " " * len(BLANKS))
    return F.array_remove(F.split(plain, " "), "")


def _bucket(hashed: Column) -> Column:
    return hashed.bitwiseAND(F.lit(BUCKETS - 1).cast("long"))


def joined_hashes(hashes: Column, apart: int) -> Column:
    """Hashes of each element with the one ``apart`` places on: of runs twice as long."""
    n = F.greatest(F.size(hashes) - apart, F.lit(0))
    return F.zip_with(F.slice(hashes, 1, n), F.slice(hashes, 1 + apart, n), lambda x, y: F.xxhash64(x, y))


def repeated_words(pairs: Column) -> Column:
    """Words that lie in windows of 8 words found twice or more, the first included; ``pairs`` has a hash of each two
    neighbours. Only texts with a repeated run of 4 come as far as 8."""
    width = 8

    def covered(windows: Column) -> Column:
        def places(placed: Column) -> Column:
            twin = lambda x, i: F.get(placed, i)["h"].eqNullSafe(x["h"])
            return F.sort_array(F.array_compact(F.transform(placed, lambda x, i: F.when(twin(x, i - 1) | twin(x, i + 1), x["i"]))))

        def cover(at: Column) -> Column:
            return F.aggregate(F.transform(at, lambda p, i: F.least(F.lit(width), F.coalesce(F.get(at, i + 1) - p, F.lit(width)))), F.lit(0), lambda a, g: a + g)

        return let(let(F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i")))), places), cover)

    distinct = lambda x: F.size(F.array_distinct(x)) == F.size(x)
    eights = lambda four: let(joined_hashes(four, 4), lambda w: F.when(distinct(w), 0).otherwise(covered(w)))
    return let(pairs, lambda two: let(joined_hashes(two, 2), lambda four: F.when(distinct(four), 0).otherwise(eights(four)))).cast("long")


def add_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long), base_failed and the hashes
    of words and of word pairs, ``_hashes`` and ``_pairs``."""
    t = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: F.btrim(x, F.lit(BLANKS)) != "")
    d = docs.withColumn("_words", words_of(F.col(text)))
    d = d.withColumns({
        "_hashes": F.transform("_words", lambda w: F.xxhash64(w)), "n_words": F.size("_words").cast("long"),
        "word_chars": F.length(F.array_join("_words", "")).cast("long"),
    }).drop("_words")
    d = d.withColumn("_pairs", let(F.col("_hashes"), lambda h: joined_hashes(h, 1)))
    d = d.withColumns({
        "n_symbols": (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long"),
        "n_dup_lines": let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
        "n_repeat_words": repeated_words(F.col("_pairs")),
    })
    return d.withColumn("base_failed", (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")))


def trusted_ids(labels: DataFrame, limit: int = TRUSTED) -> DataFrame:
    """Ids of documents labelled good and not toxic; of more than ``limit``, those with the smallest hashes."""
    good = labels.where("quality = 1 AND coalesce(toxic, 0) = 0 AND doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    return good.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)


def weights(docs: DataFrame, trusted: DataFrame) -> list[float]:
    """log of target to raw probability for each bucket of words and word pairs, with one added to every count. The raw
    multinomial counts all documents, the target the trusted ones; both are partial sums over a fixed number of buckets."""
    flag = F.broadcast(trusted.select("doc_id", F.lit(1).alias("_good")))  # at most TRUSTED ids
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(flag, "doc_id", "left").select("_good", words_of(F.col("text")).alias("w"))
    pairs = own.select("_good", F.inline(F.arrays_zip(F.col("w").alias("a"), F.slice("w", 2, F.greatest(F.size("w"), F.lit(1))).alias("b"))))
    grams = pairs.select("_good", F.explode(F.array(_bucket(F.xxhash64("a")), F.when(F.col("b").isNotNull(), _bucket(F.xxhash64(F.xxhash64("a"), F.xxhash64("b")))))).alias("k"))
    counts = grams.where("k IS NOT NULL").groupBy("k").agg(F.count(F.lit(1)).alias("raw"), F.count("_good").alias("good")).collect()  # a row for each bucket
    raw, good = [1] * BUCKETS, [1] * BUCKETS
    for r in counts:
        raw[r["k"]] += r["raw"]
        good[r["k"]] += r["good"]
    shift = math.log(sum(raw)) - math.log(sum(good))
    return [math.log(g) - math.log(c) + shift for g, c in zip(good, raw)]


def score(table: list[float]) -> Column:
    """Mean weight of a row's words and word pairs, from ``_hashes`` and ``_pairs``."""
    literal = F.from_json(F.lit(json.dumps(table)), "array<double>")
    total = lambda hashes, first: F.aggregate(hashes, first, lambda a, x: a + F.get(literal, _bucket(x)))
    n = F.size("_hashes") + F.size("_pairs")
    return total(F.col("_pairs"), total(F.col("_hashes"), F.lit(0.0))) / F.when(n > 0, n)


def judge(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, trusted: int = TRUSTED) -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, score and kept.

    A text is kept if the base rules hold and its score, the log-likelihood ratio of trusted to raw n-grams divided by their number,
    reaches ``threshold``. Scoring is done in the row; nothing is shuffled but the bucket counts.

    A null text has no words and fails, as a blank one does; null ids are never trusted; repeated rows are each judged; without
    trusted documents all weights come from the raw counts alone. Columns of ``docs`` with one of the new names are replaced."""
    table = weights(docs, trusted_ids(labels, trusted))
    own = docs.drop("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "score", "kept")
    d = add_counts(own).withColumn("score", score(table)).drop("_hashes", "_pairs")
    return d.withColumn("kept", ~F.col("base_failed") & F.coalesce(F.col("score") >= threshold, F.lit(False)))


def filtered(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that :func:`judge` keeps, with their columns."""
    return judge(docs.withColumn("_row", F.struct(*docs.columns)), labels, **options).where("kept").select("_row.*")


def query(spark, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The contract's rows, and the score."""
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score"]
    return judge(docs.select("doc_id", "text"), labels).select(*names)
