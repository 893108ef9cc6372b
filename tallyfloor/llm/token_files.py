"""Token ids in Arrow files of equal-length sequences, read without copying."""

from __future__ import annotations

import itertools
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import scratch, settle
from .encoding import encoder

#: Sequences in a record batch, and ids in a file before the next one begins (a document is never split over files).
BATCH_SEQUENCES, FILE_IDS = 256, 32 << 20

MANIFEST = "part int, number int, file string, docs long, first_doc long, ids long"


def _filesystem(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)


class SequenceWriter:
    """One file: fixed-size lists of ids and of a mask (true where an id stands, false in the padding of the last
    sequence), and beside it ``.docs``, the documents' keys and lengths in the same order. Both are Arrow IPC files,
    so any sequence is found by its number: batch n // BATCH_SEQUENCES, row n % BATCH_SEQUENCES."""

    def __init__(self, folder: str, length: int, dtype: np.dtype):
        self.length, self.dtype = length, dtype
        self.name = f"{uuid.uuid4().hex}.arrow"  # a new name for each attempt, so one that is lost leaves no half-written file in use
        self.fs, root = _filesystem(folder)
        self.path = f"{root}/{self.name}"
        self.schema = pa.schema([("ids", pa.list_(pa.from_numpy_dtype(dtype), length)), ("mask", pa.list_(pa.bool_(), length))])
        self.sink = self.fs.open_output_stream(self.path)
        self.out = pa.ipc.new_file(self.sink, self.schema)
        self.waiting: list[bytes] = []
        self.bytes_waiting = self.ids = 0
        self.keys: list[int | None] = []
        self.sizes: list[int] = []

    def add(self, key: int | None, ids: bytes) -> None:
        n = len(ids) // self.dtype.itemsize
        self.keys.append(key), self.sizes.append(n), self.waiting.append(ids)
        self.bytes_waiting += len(ids)
        self.ids += n
        if self.bytes_waiting >= BATCH_SEQUENCES * self.length * self.dtype.itemsize:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        flat = np.frombuffer(b"".join(self.waiting), self.dtype)
        step = BATCH_SEQUENCES * self.length
        whole = len(flat) // step * step
        for at in range(0, len(flat) if last else whole, step):
            part = flat[at : at + step]
            rows = -(-len(part) // self.length)
            ids = np.zeros(rows * self.length, self.dtype)
            ids[: len(part)] = part
            mask = np.arange(rows * self.length) < len(part)
            self.out.write_batch(pa.record_batch([
                pa.FixedSizeListArray.from_arrays(pa.array(ids), self.length), pa.FixedSizeListArray.from_arrays(pa.array(mask), self.length),
            ], schema=self.schema))
        rest = b"" if last else flat[whole:].tobytes()
        self.waiting, self.bytes_waiting = [rest], len(rest)

    def close(self) -> tuple[str, int, int]:
        self._flush(True)
        self.out.close(), self.sink.close()
        table = pa.table({"doc_id": pa.array(self.keys, pa.int64()), "n_tokens": pa.array(self.sizes, pa.int64())})
        with self.fs.open_output_stream(f"{self.path}.docs") as sink, pa.ipc.new_file(sink, table.schema) as out:
            out.write_table(table, max_chunksize=1 << 16)
        return self.name, len(self.keys), self.ids


class SequenceReader:
    """Random access to one file: ``reader[n]`` gives sequence n as views of ids and mask, ``stream`` the ids in order."""

    def __init__(self, folder: str, name: str):
        self.fs, root = _filesystem(folder)
        self.path = f"{root}/{name}"
        self.source = pa.memory_map(self.path) if self.fs.type_name == "local" else self.fs.open_input_file(self.path)
        self.file = pa.ipc.open_file(self.source)

    def _batch(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        b = self.file.get_batch(k)
        length = b.schema.field("ids").type.list_size
        return b.column("ids").flatten().to_numpy().reshape(-1, length), b.column("mask").flatten().to_numpy(zero_copy_only=False).reshape(-1, length)

    def __getitem__(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        ids, mask = self._batch(n // BATCH_SEQUENCES)
        return ids[n % BATCH_SEQUENCES], mask[n % BATCH_SEQUENCES]

    def documents(self) -> Iterator[tuple[int | None, np.ndarray]]:
        """Key and ids of each document, in order."""
        with self.fs.open_input_file(f"{self.path}.docs") as f:
            table = pa.ipc.open_file(f).read_all()
        batches, held, at = iter(range(self.file.num_record_batches)), np.empty(0, np.uint16), 0
        for key, n in zip(table["doc_id"].to_pylist(), table["n_tokens"].to_pylist()):
            more = [held[at:]]
            have = len(more[0])
            while have < n:
                ids, mask = self._batch(next(batches))
                more.append(ids[mask] if not mask[-1, -1] else ids.ravel())
                have += len(more[-1])
            if len(more) > 1:
                held, at = np.concatenate(more) if len(more[0]) or len(more) > 2 else more[1], 0
            yield key, held[at : at + n]
            at += n


def write(docs: DataFrame, tokenizer: str, folder: str, end_id: int, length: int = 2048, file_ids: int = FILE_IDS) -> DataFrame:
    """Encodes every whole text, appends ``end_id`` and writes all ids in ascending ``doc_id`` order (rows without an id first) to
    files below ``folder``, which all executors can reach. Returns the manifest, a row for each file in order.

    Texts are dealt to sorted ranges of the id and encoded where they arrive, once. Null texts are empty (just the end id),
    rows that share an id follow each other, an empty table gives no file. A lost task writes new files; only names that a finished
    task reports are in the manifest."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc, part, number = encoder(tokenizer), TaskContext.get().partitionId(), 0
        end, writer, rows, first = np.asarray([end_id], enc.dtype).tobytes(), None, [], None
        for b in batches:
            for at in range(0, len(b), 1000):
                keys, texts = b.column(0).slice(at, 1000).to_pylist(), [t or "" for t in b.column(1).slice(at, 1000).to_pylist()]
                for key, ids in zip(keys, enc.encode(texts)):
                    if writer is None:
                        writer, first = SequenceWriter(folder, length, enc.dtype), key
                    writer.add(key, ids + end)
                    if writer.ids >= file_ids:
                        rows.append((part, number, first, *writer.close()))
                        writer, number = None, number + 1
        if writer is not None:
            rows.append((part, number, first, *writer.close()))
        names = ["part", "number", "file", "docs", "first_doc", "ids"]
        yield pa.RecordBatch.from_pydict({
            "part": pa.array([r[0] for r in rows], pa.int32()), "number": pa.array([r[1] for r in rows], pa.int32()),
            "file": pa.array([r[3] for r in rows], pa.string()), "docs": pa.array([r[4] for r in rows], pa.int64()),
            "first_doc": pa.array([r[2] for r in rows], pa.int64()), "ids": pa.array([r[5] for r in rows], pa.int64()),
        }).select(names)

    make_folder(docs.sparkSession, folder)
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    ranged = narrow.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return settle(ranged.mapInArrow(run, MANIFEST))


def make_folder(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(path)


def read_documents(manifest: DataFrame, folder: str, end_width: int = 4) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids (packed little-endian, ``end_width`` bytes each), from the files."""
    spark = manifest.sparkSession
    rows = manifest.orderBy("part", "number").collect()  # a row for each file of some ten million ids
    starts = list(itertools.accumulate((r["ids"] for r in rows), initial=0))
    order = spark.createDataFrame([(i, r["file"], s) for i, (r, s) in enumerate(zip(rows, starts))], "number int, file string, start long")
    kind = np.dtype(f"<u{end_width}")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file, start in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                held: list[tuple] = []
                size = 0
                for key, ids in SequenceReader(folder, file).documents():
                    held.append((key, start, len(ids), ids.astype(kind).tobytes()))
                    start += len(ids)
                    size += len(held[-1][3])
                    if size > 8 << 20:
                        yield _rows(held)
                        held, size = [], 0
                yield _rows(held)

    spread = order.repartition(max(1, len(rows)), "number").select("file", "start")
    return spread.mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")


def _rows(held: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
    columns = zip(*held) if held else [[], [], [], []]
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], names=["doc_id", "start", "n_tokens", "ids"])


def query(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The contract's rows, from the files read back."""
    import public_tokenizers

    folder = scratch(spark, "token-files")
    manifest = write(docs, public_tokenizers.path("byte_bpe_50k.json"), folder, end_id=2)
    return read_documents(manifest, folder).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
