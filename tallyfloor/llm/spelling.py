"""Spelling variants: words one edit apart, found by pivotal grams, and the frequent form each rare one stands for."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import normalised, settle

#: A word: letters a-z and U+00C0 to U+00FF, 90 of them once A-Z is lower-cased, so there are 8100 bigrams at most.
RUN = "[A-Za-zÀ-ÿ]+"
GRAM = 2
#: Bigrams that one edit can destroy, and one more: so many of the rarest form a word's prefix.
PREFIX = GRAM + 1


def word_counts(docs: DataFrame, misprint: int = 199, least_length: int = 6, least_count: int = 5) -> DataFrame:
    """word, n for the words of all texts that are long and frequent enough.

    A-Z is lower-cased. Where ``misprint`` divides the CRC-32 of ``<doc_id>:<word>``, the word loses the code point at CRC-32 mod length.
    Null texts have no words; a null id counts as an empty one."""
    runs = docs.select(
        F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"),
        F.explode(F.regexp_extract_all(normalised(F.col("text")), F.lit(RUN), F.lit(0))).alias("run"),
    ).where(F.length("run") >= least_length)
    hashed = runs.withColumn("h", F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")))
    shorter = F.expr("concat(substring(run, 1, int(h % length(run))), substring(run, int(h % length(run)) + 2))")
    words = hashed.select(F.when(F.col("h") % misprint == 0, shorter).otherwise(F.col("run")).alias("word"))
    counted = words.where(F.length("word") >= least_length).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counted.where(F.col("n") >= least_count)


def pivots(costs: list[int], places: list[int]) -> tuple[int, int]:
    """Two places at least ``GRAM`` apart with the smallest sum of costs, by dynamic programming over the sorted places:
    the cheapest single gram that ends before a place is carried along."""
    best, choice = None, (0, 0)
    single: tuple[int, int] | None = None
    waiting = 0
    for p in places:
        while places[waiting] + GRAM <= p:
            one = (costs[places[waiting]], places[waiting])
            single = one if single is None else min(single, one)
            waiting += 1
        if single is not None and (best is None or single[0] + costs[p] < best):
            best, choice = single[0] + costs[p], (single[1], p)
    return choice


def signatures(words: DataFrame) -> DataFrame:
    """word, n, first and second (places of the pivots), places (of the prefix) and last (rank of its last gram).

    Grams are ranked by how many places of the distinct words hold them, the rarest first. A prefix is the
    ``PREFIX`` rarest grams of a word and all others of the rank of the last of them; the pivots are two disjoint grams of it."""
    grams = F.explode(F.transform(F.sequence(F.lit(1), F.length("word") - 1), lambda i: F.substring("word", i, F.lit(GRAM))))
    counts = words.select(grams.alias("g")).groupBy("g").count().collect()  # 8100 rows at most
    order = sorted((r["count"], r["g"]) for r in counts)
    rank = {g: k for k, (_, g) in enumerate(order)}
    seen = [c for c, _ in order]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            first, second, held, last = [], [], [], []
            for w in b.column(0).to_pylist():
                ranks = [rank[w[i : i + GRAM]] for i in range(len(w) - 1)]
                end = sorted(ranks)[PREFIX - 1]
                places = [i for i, r in enumerate(ranks) if r <= end]
                one, two = pivots([seen[r] for r in ranks], places)
                first.append(one)
                second.append(two)
                held.append(places)
                last.append(end)
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array(first, pa.int32()), pa.array(second, pa.int32()), pa.array(held, pa.list_(pa.int32())), pa.array(last, pa.int32())],
                names=["word", "n", "first", "second", "places", "last"],
            )

    return words.select("word", "n").mapInArrow(run, "word string, n long, first int, second int, places array<int>, last int")


def near_pairs(words: DataFrame) -> DataFrame:
    """a, a_n, b, b_n: every pair of distinct words (a < b) that differ by exactly one inserted, deleted or replaced code point.
    ``words`` (word, n; words of four code points or more) should be a written table.

    Of two such words let s be the one whose prefix ends no later in the order of grams. One edit leaves a pivot of s whole, and
    since the prefix of the other word r holds all its grams up to that rank, the pivot is in it, at the same place counted
    from the word's start if the edit lies behind the first pivot, else at the same place counted from its end. Position and length limits are sharpened by
    that: up to the end of the first pivot, or from the start of the second one, the two words are equal. Pivots so probe the prefixes by (side, length, that
    part); what meets is verified inside the join. A crowded part is split by the planner's skew handling."""
    marked = settle(signatures(words))
    size = F.length("word")
    head = lambda p: F.substring("word", F.lit(1), p + GRAM)
    tail = lambda p: F.substring("word", p + 1, size)
    part = lambda left, text, length: F.struct(F.lit(left).alias("left"), length.alias("length"), text.alias("part"))
    index = marked.select(
        F.col("word").alias("r"), F.col("n").alias("r_n"), F.col("last").alias("r_last"),
        F.explode(F.concat(F.transform("places", lambda p: part(True, head(p), size)), F.transform("places", lambda p: part(False, tail(p), size)))).alias("at"),
    ).select("r", "r_n", "r_last", "at.*")
    lengths = F.array(size - 1, size, size + 1)
    probe = marked.select(
        F.col("word").alias("s"), F.col("n").alias("s_n"), F.col("last").alias("s_last"),
        F.explode(F.concat(
            F.transform(lengths, lambda n: part(True, head(F.col("first")), n)), F.transform(lengths, lambda n: part(False, tail(F.col("second")), n))
        )).alias("at"),
    ).select("s", "s_n", "s_last", "at.*")
    met = probe.join(index.hint("merge"), ["left", "length", "part"]).where((F.col("s_last") <= F.col("r_last")) & (F.levenshtein("s", "r", 1) == 1))
    ordered = F.col("s") < F.col("r")
    pick = lambda yes, no: F.when(ordered, F.col(yes)).otherwise(F.col(no))
    return met.select(pick("s", "r").alias("a"), pick("s_n", "r_n").alias("a_n"), pick("r", "s").alias("b"), pick("r_n", "s_n").alias("b_n")).distinct()


def forms(words: DataFrame, pairs: DataFrame, ratio: int = 5) -> DataFrame:
    """word, n, n_near, form, form_n, root for each word.

    A word's form is its most frequent near word (ties: the smallest) if that is ``ratio`` times as frequent; ``root`` is what
    following the forms ends in. Frequencies grow along the way, so there are no cycles, and the way halves in each round."""
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("near"), F.col("b_n").alias("near_n")).unionByName(
        pairs.select(F.col("b").alias("word"), F.col("a").alias("near"), F.col("a_n").alias("near_n")))
    best = both.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("low"), "near")).alias("best"))
    strong = -F.col("best.low") >= ratio * F.col("n")
    named = settle(words.select("word", "n").join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(strong, F.col("best.near")).alias("form"), F.when(strong, -F.col("best.low")).alias("form_n"),
    ))
    roots = settle(named.where("form IS NOT NULL").select("word", F.col("form").alias("root")))
    while True:
        onward = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = settle(roots.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        roots = moved.select("word", "root")
        if moved.where("moved").limit(1).count() == 0:
            break
    return named.join(roots, "word", "left").withColumn("root", F.coalesce("root", "word"))


def variants(docs: DataFrame, **limits: int) -> DataFrame:
    """The words of ``docs`` with their forms and roots; ``limits`` are those of :func:`word_counts`.

    Null and empty texts add nothing, repeated rows count again, other columns are ignored, and an empty table has no words."""
    words = settle(word_counts(docs, **limits))
    return forms(words, settle(near_pairs(words)))


def query(spark, docs: DataFrame) -> DataFrame:
    """The contract's rows: word, form, root, n, n_near, form_n."""
    return variants(docs).select("word", "form", "root", "n", "n_near", "form_n")
