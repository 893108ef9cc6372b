"""Ranked lexical search over a length-stratified index."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import keyed_join, settle

#: Letters, digits and everything that is not ASCII, in UTF-8 bytes.
TERM = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
#: Documents of a block of the index: a stratum with more is split, so a task holds a bounded part of any stratum.
BLOCK = 1024
#: Blocks of the index that a worker holds at a time, in whose midst bounds order the visits.
HELD = 32
#: Items searched for in one go; their terms and weights go to every worker.
ITEMS = 2048
#: Terms in one go. Items with so many terms are searched for with fewer others.
TERMS = 1 << 18


def terms(text: bytes | None) -> list[bytes]:
    """The terms of a text with only A-Z lower-cased; null has none."""
    return TERM.findall((text or b"").lower())


def _columns(names: list[str], *columns: list, types: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)


def occurrences(docs: DataFrame, wanted: list[bytes]) -> DataFrame:
    """tag, doc_id, n (terms with repeats), ids and tfs (of those terms that are wanted, by their place in the list) for each row."""
    place = {t: k for k, t in enumerate(wanted)}

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes, ids, tfs = [], [], []
            for text in b.column(2):
                found = terms(text.as_py())
                own = [(place[t], c) for t, c in Counter(found).items() if t in place]
                sizes.append(len(found))
                ids.append([k for k, _ in own])
                tfs.append([c for _, c in own])
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(sizes, pa.int64()), pa.array(ids, pa.list_(pa.int32())), pa.array(tfs, pa.list_(pa.int32()))],
                names=["tag", "doc_id", "n", "ids", "tfs"],
            )

    narrow = docs.select(F.monotonically_increasing_id().alias("tag"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return settle(narrow.mapInArrow(run, "tag long, doc_id long, n long, ids array<int>, tfs array<int>"))


def unit_impacts(tfs: np.ndarray, m: int) -> np.ndarray:
    """What an occurrence count contributes for a weight of one, in a stratum."""
    return (1_000_000_000 * tfs.astype(np.int64)) // (1000 * tfs.astype(np.int64) + 20 * m)


def build(found: DataFrame) -> DataFrame:
    """The index: a row for each block of a stratum, with its normaliser ``m``, its documents (tags, doc_ids) and its postings.

    Postings are sorted by (term, tf): run k has a term ``term[k]``, a count ``tf[k]`` and the documents
    ``docs[ends[k-1] : ends[k]]``, by place in the block. A stratum is all documents of equal ``m`` = 50 + (50 n N) div L; it is
    split by a hash of the tag into blocks of about ``BLOCK`` documents, so a stratum with a third of all documents is spread."""
    named = found.where(F.size("ids") > 0)
    totals = found.agg(F.count(F.when(F.col("n") > 0, 1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    n_docs, n_terms = int(totals[0]), max(1, int(totals[1]))
    m = F.expr(f"50 + (50 * n * {n_docs}L) div {n_terms}L")
    strata = named.groupBy(m.alias("m")).agg(F.count(F.lit(1)).alias("rows"))
    dealt = keyed_join(named.withColumn("m", m), settle(strata), "m", "rows", n_docs)
    part = F.expr(f"cast(pmod(xxhash64(tag), (rows + {BLOCK - 1}) div {BLOCK}) as int)")
    order = ["m", "tags", "doc_ids", "term", "tf", "ends", "docs"]

    def block(key, table):
        columns = {c: table.column(c).combine_chunks() for c in ("tag", "doc_id", "ids", "tfs")}
        size = np.diff(columns["ids"].offsets.to_numpy())
        ids, tfs = (columns[c].flatten().to_numpy(zero_copy_only=False) for c in ("ids", "tfs"))
        docs = np.repeat(np.arange(len(size), dtype=np.int32), size)
        by = np.lexsort((docs, tfs, ids))
        ids, tfs, docs = ids[by], tfs[by], docs[by]
        ends = np.append(np.flatnonzero((np.diff(ids) != 0) | (np.diff(tfs) != 0)) + 1, len(ids)).astype(np.int32)
        lists = (columns["tag"], columns["doc_id"], ids[ends - 1], tfs[ends - 1], ends, docs)
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32())
        return pa.table([pa.array([key[0].as_py()], pa.int64()), *(pa.array([v.to_pylist() if isinstance(v, pa.Array) else v], pa.list_(t)) for v, t in zip(lists, kinds))], names=order)

    schema = "m long, tags array<long>, doc_ids array<long>, term array<int>, tf array<int>, ends array<int>, docs array<int>"
    grouped = dealt.select("m", part.alias("part"), "tag", "doc_id", "ids", "tfs").groupBy("m", "part")
    return settle(grouped.applyInArrow(block, schema).select(F.monotonically_increasing_id().alias("block"), "*"))


class _Block:
    """A block in a worker: the impacts of its runs, once for each count, and the greatest of each term."""

    def __init__(self, batch: pa.RecordBatch, at: int, weights: np.ndarray):
        cell = lambda name: batch.column(name)[at]
        self.tags, self.doc_ids = cell("tags").values, cell("doc_ids").values
        self.docs, self.ends, term, tf = (cell(c).values.to_numpy().astype(np.int64) for c in ("docs", "ends", "term", "tf"))
        counts, of = np.unique(tf, return_inverse=True)
        self.impact = weights[term] * unit_impacts(counts, cell("m").as_py())[of]
        self.starts = np.concatenate([[0], self.ends[:-1]])
        last = np.append(np.flatnonzero(np.diff(term)), len(term) - 1)  # runs of a term end with its greatest count
        first = np.concatenate([[0], last[:-1] + 1])
        self.runs = {int(t): (int(a), int(z) + 1) for t, a, z in zip(term[last], first, last)}
        self.top = np.zeros(len(weights), np.int64)
        self.top[term[last]] = self.impact[last]

    def scores(self, query: list[int]) -> np.ndarray:
        out = np.zeros(len(self.tags), np.int64)
        for t in query:
            if t in self.runs:
                a, z = self.runs[t]
                at, end = self.starts[a], self.ends[z - 1]
                out[self.docs[at:end]] += np.repeat(self.impact[a:z], self.ends[a:z] - self.starts[a:z])
        return out


def _held(batches: Iterable[pa.RecordBatch], weights: np.ndarray) -> Iterator[list[tuple[int, _Block]]]:
    """The blocks of a task with their numbers, ``HELD`` at a time."""
    for b in batches:
        for first in range(0, len(b), HELD):
            yield [(b.column("block")[i].as_py(), _Block(b, i, weights)) for i in range(first, min(first + HELD, len(b)))]


_VISITED = "item int, score long, doc_id long, tag long"


def _visit(index: DataFrame, queries: list[list[int]], weights: np.ndarray, floors: list[int], k: int) -> DataFrame:
    """The best rows of each task for each item: item (its place), score, doc_id, tag, those that can be among the first ``k`` of all.

    A task reads its blocks in batches; for each item the blocks of a batch are visited in the order of their bounds (the sum of the
    greatest impacts of its terms), until a bound is below the item's floor or the ``k``-th score that the task has found."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[list[tuple]] = [[] for _ in queries]
        floor = list(floors)
        for held in _held(batches, weights):
            rows = [r for _, r in held]
            for q, query in enumerate(queries):
                if not query:
                    continue
                bounds = [int(r.top[query].sum()) for r in rows]
                for at in sorted(range(len(rows)), key=lambda i: -bounds[i]):
                    if bounds[at] < max(1, floor[q]):
                        break
                    score = rows[at].scores(query)
                    hits = np.flatnonzero(score >= max(1, floor[q]))
                    if not len(hits):
                        continue
                    own = rows[at]
                    if len(hits) > k:  # those below the k-th score of the block can't be among the first k
                        hits = hits[score[hits] >= np.partition(score[hits], len(hits) - k)[len(hits) - k]]
                    ids, tags = own.doc_ids.take(pa.array(hits)).to_pylist(), own.tags.take(pa.array(hits)).to_pylist()
                    new = [(-s, d is None, d or 0, t) for s, d, t in zip(score[hits].tolist(), ids, tags)]
                    best[q] = sorted(best[q] + new)[:k]
                    if len(best[q]) == k:
                        floor[q] = max(floor[q], -best[q][-1][0])
        out = [(q, -s, None if lacks else d, tag) for q, found in enumerate(best) for s, lacks, d, tag in found]
        cols = list(zip(*out)) if out else [[], [], [], []]
        yield _columns(["item", "score", "doc_id", "tag"], *cols, types=[pa.int32(), pa.int64(), pa.int64(), pa.int64()])

    return index.mapInArrow(run, _VISITED)


def _bounds(index: DataFrame, queries: list[list[int]], weights: np.ndarray) -> DataFrame:
    """block, item, bound for the block that promises most to an item, of each task."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, tuple[int, int]] = {}
        for held in _held(batches, weights):
            for number, block in held:
                for q, query in enumerate(queries):
                    if query:
                        best[q] = max(best.get(q, (0, -1)), (int(block.top[query].sum()), number))
        yield _columns(["item", "bound", "block"], list(best), [v[0] for v in best.values()], [v[1] for v in best.values()], types=[pa.int32(), pa.int64(), pa.int64()])

    return index.mapInArrow(run, "item int, bound long, block long")


def _search(docs: DataFrame, items: DataFrame, k: int) -> DataFrame:
    """Rows of :func:`search` for a bounded set of items (place, item_id, text)."""
    spark = docs.sparkSession
    held = items.select("place", F.col("text").cast("binary").alias("text")).orderBy("place").collect()
    words = [sorted(set(terms(bytes(r["text"]) if r["text"] is not None else None))) for r in held]
    wanted = sorted(set().union(*words)) if words else []
    found = occurrences(docs, wanted)
    n_docs = found.where("n > 0").count()
    df = {r["t"]: r["df"] for r in found.select(F.explode("ids").alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("df")).collect()}  # a row for each wanted term
    weights = np.array([np.floor(1000 * np.log((2 * n_docs + 2) / (2 * df.get(t, 0) + 1))) for t in range(len(wanted))], np.int64)
    place = {t: i for i, t in enumerate(wanted)}
    queries = [[place[t] for t in w if place[t] in df] for w in words]
    index = build(found)
    # the block that promises most gives each item a floor for its k-th score
    first = settle(_bounds(index, queries, weights).groupBy("item").agg(F.max(F.struct("bound", "block")).alias("top")).select("top.block").distinct())
    start = _visit(index.join(F.broadcast(first), "block", "left_semi"), queries, weights, [0] * len(queries), k)
    kth = start.groupBy("item").agg(F.slice(F.sort_array(F.collect_list("score"), asc=False), k, 1).alias("kth"))  # a few tasks, k rows each at most
    floors = [0] * len(queries)
    for r in kth.collect():  # a row for each item
        floors[r["item"]] = r["kth"][0] if r["kth"] else 0
    best = settle(_visit(index, queries, weights, floors, k))
    ids = spark.createDataFrame([(i, r["place"]) for i, r in enumerate(held)], "item int, place long")
    return best.join(F.broadcast(ids), "item").select("place", "score", "doc_id", "tag")


def search(docs: DataFrame, items: DataFrame, k: int = 50) -> DataFrame:
    """item_id, rank (int, from 1), doc_id, score for the ``k`` best rows of ``docs`` (doc_id, text) for each row of ``items`` (item_id, text).

    Items are taken in blocks of about ``ITEMS`` (fewer if they have many terms); for each block one scan counts the wanted terms in all texts, and the index is
    built over them: documents in strata of equal normaliser, postings by count within. Bounds of the strata order the visits.
    Every task keeps ``k`` rows for an item, which are merged.

    Null and empty texts have no terms, score nothing and still count as rows with a score of 0, which are left out; equal scores are ranked by doc_id (null last), repeated rows are
    each ranked, items that share an id or text are each searched for, and other columns are ignored."""
    from pyspark.sql import Window

    numbered = settle(items.select(F.monotonically_increasing_id().alias("place"), "item_id", "text"))
    size = numbered.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    blocks = max(1, -(-size[0] // ITEMS), -(-size[1] // (2 * TERMS)))  # a term has at least two bytes with what parts it from the next
    found = None
    for b in range(blocks):
        part = _search(docs, numbered.where(F.pmod(F.xxhash64("place"), F.lit(blocks)) == b), k)
        found = part if found is None else found.unionByName(part)
    order = Window.partitionBy("place").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"), "tag")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.join(numbered.select("place", "item_id"), "place").select("item_id", "rank", "doc_id", "score")


def query(spark, docs: DataFrame, items: DataFrame) -> DataFrame:
    """The contract's rows for the items of ``benchmark``."""
    return search(docs, items, 50)


SQL = r"""
WITH t AS (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
c AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY ALL),
d AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM c GROUP BY doc_id),
s AS (SELECT count(*) AS N_docs, sum(n)::BIGINT AS L FROM d),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
w AS (SELECT term, floor(1000 * ln((2.0::DOUBLE * N_docs + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM c, s GROUP BY term, N_docs),
r AS (SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * N_docs) // L))))::BIGINT AS score
  FROM q JOIN c USING (term) JOIN w USING (term) JOIN d USING (doc_id), s GROUP BY item_id, doc_id),
k AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM r WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM k WHERE rank <= 50
"""
