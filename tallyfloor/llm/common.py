"""Helpers that several text operators share."""

from __future__ import annotations

import ctypes
import functools
import gc
import tempfile
import zipfile
from collections.abc import Callable, Iterable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from tallyfloor.operators.settle import scratch, settle  # noqa: F401  (re-exported)

#: A key with more than this share of all rows is joined by broadcast; fewer than 1 / share keys can have that many.
HEAVY_SHARE = 1 / 1000
#: Bits that keys of rows to be taken out may mark, which bounds what is broadcast of them (2 MB of bits).
CELLS = 1 << 24


_HELD: dict[str, dict] = {}


def held(owner: str, key, make: Callable):
    """What a worker keeps between tasks: ``make()`` for a key of an operator, made once. Workers serve one operator after the other, so what
    another operator has left is released first, and of the same operator all but the last few keys."""
    others = [o for o in _HELD if o != owner]
    for other in others:
        del _HELD[other]
    if others:
        gc.collect()
        relieve()
    own = _HELD.setdefault(owner, {})
    if key not in own:
        while len(own) >= 4:
            del own[next(iter(own))]
        own[key] = make()
    return own[key]


@functools.cache
def _trim() -> Callable | None:
    try:
        return ctypes.CDLL(None).malloc_trim
    except (OSError, AttributeError):
        return None  # not glibc


def relieve() -> None:
    """Gives memory that a worker has freed back to the system. Workers live on from stage to stage, and the allocators of Arrow and C else keep
    it for each of them, beside an executor's heap. It takes some milliseconds."""
    pa.default_memory_pool().release_unused()
    if trim := _trim():
        trim(0)


def read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def normalised(text) -> F.Column:
    """Lower-cases A-Z only; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def keyed_join(left: DataFrame, right: DataFrame, key: str, size: str, total: int) -> DataFrame:
    """Inner join of ``left`` with ``right``, which has one row for each ``key`` and in ``size`` the
    number of rows of ``left`` with it; ``total`` is the number of rows of ``left``. A key that holds more than
    ``HEAVY_SHARE`` of the rows is taken out of the shuffle: fewer than 1 / HEAVY_SHARE such keys can exist,
    so that side is broadcast whatever the input. ``left`` is read twice and should be a written table."""
    limit = max(1, int(total * HEAVY_SHARE))
    heavy = F.broadcast(right.where(F.col(size) > limit))
    rest = left.join(F.broadcast(heavy.select(key)), key, "left_anti")
    return left.join(heavy, key).unionByName(rest.join(right.where(F.col(size) <= limit).hint("merge"), key))


def without(rows: DataFrame, gone: DataFrame, key: str, cells: int = CELLS) -> DataFrame:
    """Left anti-join of ``rows`` with ``gone`` (the one column ``key``, a written table), for wide rows of which few go.

    Keys of ``gone`` mark one of ``cells`` bits by their hash, 64 in a word; the words (cells / 64 at most, whatever the input) are broadcast.
    A row whose bit is not set stays where it is read. The others, that is rows that go and a few that share a bit with one, are
    joined by their keys, so hardly more than what goes is shuffled."""
    cell = F.xxhash64(key).bitwiseAND(F.lit(cells - 1).cast("long"))
    word = F.shiftright(cell, 6)
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), cell.bitwiseAND(F.lit(63).cast("long")).cast("int"))
    marks = F.broadcast(gone.select(word.alias("_word"), bit.alias("_bit")).groupBy("_word").agg(F.bit_or("_bit").alias("_bits")))
    marked = rows.withColumns({"_word": word, "_bit": bit}).join(marks, "_word", "left").withColumn("_met", F.coalesce(F.col("_bits").bitwiseAND(F.col("_bit")) != 0, F.lit(False)))
    stay = marked.where("NOT _met").select(*rows.columns)
    return stay.unionByName(marked.where("_met").select(*rows.columns).join(gone, key, "left_anti").select(*rows.columns))


def running_totals(df: DataFrame, order: list[str], value: str, out: str) -> DataFrame:
    """Adds ``out``: the sum of ``value`` (long) over all rows before this one in the order of ``order``.

    Rows are dealt to sorted ranges by one shuffle; each range adds up its own rows while it streams, the totals
    of the ranges (a row for each) are added up, and a broadcast of them shifts the ranges. ``df`` should be a
    written table, since finding the ranges reads it once more; ``order`` must tell all rows apart, also
    repeated ones, or a range of equal rows stays whole."""
    names = df.columns
    schema = T.StructType([*df.schema.fields, T.StructField("_range", T.IntegerType()), T.StructField("_local", T.LongType())])

    def add_up(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seen = TaskContext.get().partitionId(), 0
        for b in batches:
            v = b.column(names.index(value)).to_numpy(zero_copy_only=False).astype(np.int64)
            after = seen + np.cumsum(v)
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array(np.full(len(v), part, np.int32)), pa.array(after - v)], names=[*names, "_range", "_local"]
            )
            seen = int(after[-1]) if len(v) else seen

    ranged = settle(df.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(add_up, schema))
    sums = ranged.groupBy("_range").agg(F.sum(value).alias("_sum")).collect()  # a row for each task of the shuffle
    before, at = [], 0
    for r in sorted(sums):
        before.append((r["_range"], at))
        at += r["_sum"]
    shift = df.sparkSession.createDataFrame(before, "_range int, _before long")
    return ranged.join(F.broadcast(shift), "_range").select(*names, (F.col("_before") + F.col("_local")).alias(out))


def ship(spark: SparkSession) -> None:
    """Sends this package to the Python workers, once for a session, so that it need not be installed on the executors."""
    sc = spark.sparkContext
    if getattr(sc, "_shipped_tallyfloor", None):
        return
    package = Path(__file__).resolve().parent.parent
    target = Path(tempfile.mkdtemp(prefix="spark-")) / "tallyfloor.zip"  # on the driver, whose file server hands it out
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(package.rglob("*.py")):
            z.write(p, p.relative_to(package.parent))
    sc.addPyFile(str(target))
    sc._shipped_tallyfloor = True
