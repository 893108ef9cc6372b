"""Packing documents into sequences with a controlled mixture of sources."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import relieve, settle
from .encoding import encoder

#: Sources that have a queue of their own; with more, sources share queues by their hash.
MAX_QUEUES = 4096
#: Sequences in a window of the mixture.
WINDOW = 64

PIECES = "doc_id long, source string, start long, doc_tokens long, sequence_id long, offset long, ids binary"


def encode(docs: DataFrame, tokenizer: str, end_id: int, queues: int = MAX_QUEUES) -> DataFrame:
    """Writes each document's packed ids once, with its queue and its place there: ``part`` (the task) and ``before`` (ids of the
    queue before it in that task). Queues run in the order in which tables are read, so nothing is shuffled."""
    columns = "doc_id long, source string, queue string, part int, before long, n long, ids binary"

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc, part = encoder(tokenizer), TaskContext.get().partitionId()
        end, filled = np.asarray([end_id], enc.dtype).tobytes(), {}
        for b in batches:
            for at in range(0, len(b), 1000):
                own = b.slice(at, 1000)
                packed = [p + end for p in enc.encode([t or "" for t in own.column(1).to_pylist()])]
                n = [len(p) // enc.dtype.itemsize for p in packed]
                before = []
                for q, k in zip(own.column(3).to_pylist(), n):
                    before.append(filled.get(q, 0))
                    filled[q] = before[-1] + k
                yield pa.RecordBatch.from_arrays([
                    own.column(0), own.column(2), own.column(3), pa.array(np.full(len(n), part, np.int32)), pa.array(before, pa.int64()),
                    pa.array(n, pa.int64()), pa.array(packed, pa.binary()),
                ], names=["doc_id", "source", "queue", "part", "before", "n", "ids"])
                relieve()

    source = F.col("source").cast("string")
    few = docs.select(source).distinct().limit(queues + 1).count() <= queues
    queue = F.coalesce(F.concat(F.lit("="), source), F.lit("")) if few else F.pmod(F.xxhash64(source), F.lit(queues)).cast("string")
    return settle(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", source.alias("source"), queue.alias("queue")).mapInArrow(run, columns))


class Mixture:
    """Deficit round-robin in closed form. Queue s with share w_s / w of the mixture has been granted
    g(r) = floor(r * window * w_s / w) ids (but no more than it holds) after r windows: every window grants its exact share, and the
    fraction of an id that a window can't grant is the deficit that the next one makes up, in whichever task it is filled."""

    def __init__(self, totals: list[int], shares: list[int], window: int):
        self.totals, self.shares, self.window, self.sum = totals, shares, window, sum(shares)
        self.known: dict[int, list[int]] = {}

    def granted(self, s: int, r: int) -> int:
        return min(self.totals[s], r * self.window * self.shares[s] // self.sum)

    def window_of(self, s: int, t: int) -> int:
        """The window in which queue s gives its id number t."""
        return -(-(t + 1) * self.sum // (self.window * self.shares[s])) - 1

    def starts(self, r: int) -> list[int]:
        """Where each queue's ids of window r begin in the whole stream: windows follow each other, in them queues in their order."""
        if r not in self.known:
            if len(self.known) > 4096:
                self.known.clear()
            at, out = sum(self.granted(s, r) for s in range(len(self.totals))), []
            for s in range(len(self.totals)):
                out.append(at)
                at += self.granted(s, r + 1) - self.granted(s, r)
            self.known[r] = out
        return self.known[r]

    def pieces(self, s: int, at: int, n: int, length: int) -> Iterator[tuple[int, int, int]]:
        """Cuts ids at .. at + n of queue s into (first id, ids, place in the stream), none of which crosses a sequence of ``length``."""
        t, stop = at, at + n
        while t < stop:
            r = self.window_of(s, t)
            place = self.starts(r)[s] + t - self.granted(s, r)
            take = min(stop - t, self.granted(s, r + 1) - t, length - place % length)
            yield t - at, take, place
            t += take


def pack(docs: DataFrame, tokenizer: str, end_id: int, length: int = 4096, window: int = WINDOW, shares: dict[str, int] | None = None, queues: int = MAX_QUEUES) -> DataFrame:
    """A row for each piece: doc_id, source, start (ids of its document before it), doc_tokens, sequence_id, offset, ids (packed).

    Documents wait in a queue for each source; windows of ``window`` sequences are filled from the queues in turn, each with its share
    of the window, and deficits are carried on. Shares are the sources' part of all ids, or ``shares`` (whole numbers by source; sources
    that are not named get their part of the ids); when a queue runs dry, windows get shorter. The stream is cut every ``length`` ids, so
    only the last sequence is padded. A task finds the places of its own pieces from the queues' totals: one sum for each (task, queue).

    Null texts are empty (the end id alone), null sources have a queue of their own, null ids stay null, repeated rows are packed each,
    an empty table gives no rows, and other columns are ignored."""
    coded = encode(docs, tokenizer, end_id, queues)
    sums = coded.groupBy("queue", "part").agg(F.sum("n").alias("n"))
    earlier = F.coalesce(F.sum("n").over(Window.partitionBy("queue").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    base = settle(sums.select("queue", "part", earlier.alias("base")))  # its written size tells the planner how to join it
    totals = {r["queue"]: r["n"] for r in sums.groupBy("queue").agg(F.sum("n").alias("n")).orderBy("queue").collect()}  # at most ``queues`` rows
    names = list(totals)
    weight = [max(1, (shares or {}).get(q.removeprefix("="), totals[q])) for q in names]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mix, number = Mixture(list(totals.values()), weight, window * length), {q: i for i, q in enumerate(names)}
        for b in batches:
            rows: list[tuple] = []
            size = 0
            for doc, source, queue, at, n, ids in zip(*(c.to_pylist() for c in b.columns)):
                full = np.frombuffer(ids, f"<u{len(ids) // n}").astype("<u4").tobytes()  # n is 1 at least: the end id
                for start, take, place in mix.pieces(number[queue], at, n, length):
                    rows.append((doc, source, start, n, place // length, place % length, full[4 * start : 4 * (start + take)]))
                size += len(full)
                if size > 8 << 20:
                    yield _rows(rows)
                    rows, size = [], 0
            yield _rows(rows)

    return (coded.join(base, ["queue", "part"]).select("doc_id", "source", "queue", (F.col("base") + F.col("before")).alias("at"), "n", "ids")
            .mapInArrow(run, PIECES))


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    names = ["doc_id", "source", "start", "doc_tokens", "sequence_id", "offset", "ids"]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
    columns = zip(*rows) if rows else [[] for _ in names]
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], names=names)


def query(spark, docs: DataFrame) -> DataFrame:
    """The contract's rows."""
    import public_tokenizers

    return pack(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=2).select(
        "doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("length"), F.crc32("ids").alias("ids_crc32"),
        "doc_tokens", "sequence_id", "offset", "source",
    )
