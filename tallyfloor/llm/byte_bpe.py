"""Byte-level BPE encoding and decoding with higher-order functions."""

from __future__ import annotations

import base64
import functools
import json

from pyspark.sql import Column, DataFrame, functions as F

from .common import settle
from .quality_rules import let

#: Cells of the rank map, so that a look-up passes over a few entries only.
CELLS = 1 << 14
#: Words that make up more than 1 / FREQUENT of all are looked up in the row (fewer than FREQUENT can be that frequent).
FREQUENT = 1 << 20
#: In the fold's numbers ranks are shifted above any place in a word; the rank that stands for none.
SHIFT = 31
PLACES, NO_PAIR = 1 << SHIFT, (1 << 31) - 1


@functools.cache
def _ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def _cells(entries: dict[str, object]) -> str:
    """JSON of an array of small maps; a key is in the cell that its xxhash64 gives."""
    import xxhash

    cells: list[dict[str, object]] = [{} for _ in range(CELLS)]
    for k, v in entries.items():
        cells[xxhash.xxh64_intdigest(k, 42) & (CELLS - 1)][k] = v
    return json.dumps(cells, ensure_ascii=False, separators=(",", ":"))


def _look_up(cells: Column, key: Column) -> Column:
    return F.try_element_at(F.get(cells, F.xxhash64(key).bitwiseAND(F.lit(CELLS - 1).cast("long"))), key)


class Bpe:
    """Encoding and decoding expressions for a vocabulary of byte pieces with ranks.

    Bytes are written in hexadecimal, two characters each, so pieces are strings whose concatenation is that of their bytes. The
    ranks (shifted, see ``SHIFT``) are one literal, an array of maps, which an expression binds once."""

    def __init__(self, path: str):
        ranks = _ranks(path)
        self.literal = F.from_json(F.lit(_cells({k.hex().upper(): v << SHIFT for k, v in ranks.items()})), "array<map<string,bigint>>")
        pieces = [""] * (max(ranks.values(), default=-1) + 1)
        for k, v in ranks.items():
            pieces[v] = k.hex().upper()
        self.pieces = F.from_json(F.lit(json.dumps(pieces)), "array<string>")

    def bound(self, body) -> Column:
        """``body`` of a function that gives a word's ids, with the ranks at hand."""
        return let(self.literal, lambda ranks: body(functools.partial(self._fold, lambda piece: _look_up(ranks, piece))))

    def _fold(self, rank, word: Column) -> Column:
        """Ids of one pre-token: from its single bytes, the adjacent pair of the lowest rank (the first of equal ones) is merged as long as
        there is one. The state is one array with a number for each piece, the shifted rank of its pair with the next one plus the place where it starts
        among the hexadecimal digits, and one for the word's end. So its least number is the next pair to merge, which drops a number and renews two."""
        start = lambda number: number.bitwiseAND(F.lit(PLACES - 1)).cast("int")
        no_pair = F.lit(NO_PAIR * PLACES)

        def merge_all(spelled: Column) -> Column:
            n = F.length(spelled)
            pair = lambda at, end: F.coalesce(rank(F.substr(spelled, at, end - at)), no_pair) + at

            def merge(state: Column, at: Column, begin: Column) -> Column:
                renewed = pair(begin, start(F.get(state, at + 3)))
                before = lambda own: pair(own, start(F.get(state, at + 2)))
                both = F.when(at > 0, F.array(let(start(F.get(state, at - 1)), before), renewed)).otherwise(F.array(renewed))
                return F.flatten(F.array(F.slice(state, F.lit(1), F.greatest(at - 1, F.lit(0))), both, F.slice(state, at + 3, n)))

            def step(state: Column, _) -> Column:
                return let(F.array_min(state), lambda least: F.when(least >= no_pair, state).otherwise(
                    let((F.array_position(state, least) - 1).cast("int"), lambda at: merge(state, at, start(least)))))

            first = F.transform(F.sequence(F.lit(1), n + 1, F.lit(2)), lambda i: F.coalesce(F.when(i + 2 < n, rank(F.substr(spelled, i, F.lit(4)))), no_pair) + i)
            merged = F.aggregate(F.sequence(F.lit(2), F.greatest(n / 2, F.lit(2)).cast("int")), first, step)
            return let(merged, lambda m: F.transform(F.slice(m, F.lit(1), F.size(m) - 1), lambda x, i: F.shiftright(rank(
                let(start(x), lambda at: F.substr(spelled, at, start(F.get(m, i + 1)) - at))), SHIFT).cast("int")))

        return F.when(F.length(word) > 0, let(F.hex(word.cast("binary")), merge_all)).otherwise(F.array().cast("array<int>"))

    def decode(self, ids: Column) -> Column:
        """The bytes that ids stand for: their pieces in a row."""
        return F.unhex(F.array_join(let(self.pieces, lambda pieces: F.transform(ids, lambda i: F.get(pieces, i))), ""))


def pre_tokens(text: Column, pattern: str) -> Column:
    """The pattern's matches in the whole text (null: none); its classes are Unicode ones."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("(?U)" + pattern), F.lit(0))


def encode(docs: DataFrame, ranks: str, pattern: str, frequent: int = FREQUENT) -> DataFrame:
    """doc_id, ids (decimal, joined by commas) for each row, as a byte-level BPE library gives them for the pattern's matches.

    Distinct pre-tokens are counted; those above a share of 1 / ``frequent`` of all are folded once and go into a literal map, in which
    every row looks its pre-tokens up. What is rarer is folded where it stands, so texts are never shuffled and no word is a hot key.

    Null and empty texts have no ids, null ids stay null, repeated rows are each encoded, other columns are ignored, and an empty table
    gives no rows. A pre-token of n bytes takes time that grows with n squared. Letters are those of the Java runtime's Unicode."""
    bpe = Bpe(ranks)
    words = docs.select(F.explode(pre_tokens(F.col("text"), pattern)).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("c"))
    words = settle(words)
    total = words.agg(F.sum("c")).first()[0] or 0
    common = words.where(F.col("c") * frequent > total).repartition("word").select("word", F.array_join(bpe.bound(lambda fold: fold(F.col("word"))), ",").alias("code")).collect()  # fewer than ``frequent``
    known = F.from_json(F.lit(_cells({r["word"]: r["code"] for r in common})), "array<map<string,string>>")
    found = pre_tokens(F.col("text"), pattern)
    codes = bpe.bound(lambda fold: let(known, lambda k: F.transform(found, lambda w: F.coalesce(_look_up(k, w), F.array_join(fold(w), ",")))))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.array_join(codes, ",").alias("ids"))


def decode(encoded: DataFrame, ranks: str) -> DataFrame:
    """Adds ``decoded``, the bytes of ``ids``."""
    numbers = F.when(F.col("ids") != "", F.transform(F.split("ids", ","), lambda x: x.cast("int"))).otherwise(F.array().cast("array<int>"))
    return encoded.withColumn("decoded", Bpe(ranks).decode(numbers))


def query(spark, docs: DataFrame) -> DataFrame:
    """The contract's rows."""
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    coded = decode(encode(docs, path, public_tokenizers.PATTERN), path)
    n = F.when(F.col("ids") == "", 0).otherwise(F.length("ids") - F.length(F.replace("ids", F.lit(","), F.lit(""))) + 1)
    return coded.select("doc_id", n.cast("long").alias("n_tokens"), F.sha2(F.col("ids").cast("binary"), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
