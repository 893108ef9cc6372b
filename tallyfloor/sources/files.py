"""Files in and out (A1-A10)."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F, types as T

from tallyfloor.operators.audit import retained_and_excluded
from tallyfloor.operators.settle import settle
from tallyfloor.sources.digests import file_sha256


def list_inputs(spark: SparkSession, root: str, glob: str) -> DataFrame:
    """Matching files below a folder; only their listing is read, never their content."""
    return _binary(spark, root, glob).select("path", F.col("length").alias("bytes"), F.col("modificationTime").alias("modified"))


def _binary(spark: SparkSession, root: str, glob: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(root)


def file_manifest(spark: SparkSession, root: str, glob: str) -> DataFrame:
    """Path, name, size, digest and role. A file whose digest another file has is a duplicate
    candidate unless its path sorts first. Files of any size: a task reads a file in parts, once."""
    files = settle(_binary(spark, root, glob).select(
        "path", F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("bytes"),
        file_sha256(spark, "path").alias("sha256"),
    ))
    first = files.groupBy("sha256").agg(F.min("path").alias("first"), F.count("*").alias("copies"))
    role = F.when(F.col("path") == F.col("first"), "canonical").otherwise("duplicate_candidate")
    return files.join(first, "sha256").withColumn("role", role).drop("first")


def read_zip_csv(spark: SparkSession, root: str, columns: Sequence[str], glob: str = "*.zip", chunk: int = 50_000) -> DataFrame:
    """Every CSV member of every archive as text columns with its member name and row number
    (first data row is 1). Archives are spread over tasks; a member streams in chunks, since an
    archive cannot be split. Columns a member lacks are null."""
    names = list(columns)

    def unpack(batches: Iterator) -> Iterator:
        import csv
        import io
        import zipfile

        import pandas as pd

        for batch in batches:
            for path, content in zip(batch["path"], batch["content"]):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for member in z.namelist():
                        base = member.rsplit("/", 1)[-1]
                        if not member.lower().endswith(".csv") or member.startswith("__MACOSX/") or base.startswith("._"):
                            continue
                        rows = csv.reader(io.TextIOWrapper(z.open(member), encoding="utf-8-sig", newline=""))
                        header = [" ".join(h.split()).lower() for h in next(rows, [])]
                        at = [header.index(n.lower()) if n.lower() in header else -1 for n in names]
                        held, number = [], 0
                        for row in rows:
                            number += 1
                            held.append([path, member, number] + [row[i] if 0 <= i < len(row) else None for i in at])
                            if len(held) >= chunk:
                                yield pd.DataFrame(held, columns=["path", "member", "row_number", *names])
                                held = []
                        if held:
                            yield pd.DataFrame(held, columns=["path", "member", "row_number", *names])

    schema = T.StructType(
        [T.StructField("path", T.StringType()), T.StructField("member", T.StringType()), T.StructField("row_number", T.LongType())]
        + [T.StructField(n, T.StringType()) for n in names]
    )
    files = _binary(spark, root, glob).select("path", "content")
    return files.mapInPandas(unpack, schema)


def _text(columns: Sequence[str]) -> T.StructType:
    return T.StructType([T.StructField(c, T.StringType()) for c in columns])


_LINES = "file string, start long, id long, line string, odd boolean, since0 long, since1 long, count0 long, count1 long"


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines with what is needed to put them together to records, whatever stands before their split.

    A line starts a record if the number of quotes before it is even. A split does not know the quotes of earlier ones, so it
    carries both cases: ``since0`` and ``since1`` are the id of the last line that starts a record if the quotes before the split are even, or odd;
    ``count0`` and ``count1`` how many such lines there are so far, blank ones left out. A split streams through; no line is shuffled."""
    import pyarrow as pa

    text = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("id"), F.col("value").alias("line"))

    def run(batches):
        import numpy as np
        import pyarrow.compute as pc

        split, parity, since, count = None, 0, [-1, -1], [0, 0]
        for b in batches:
            lines = b.column("line")
            quotes = pc.count_substring(lines, '"').to_numpy(zero_copy_only=False).astype(np.int64)
            filled = pc.greater(pc.binary_length(pc.utf8_trim_whitespace(lines)), 0).to_numpy(zero_copy_only=False)
            ids = b.column("id").to_numpy()
            runs = pc.run_end_encode(b.column("start")).run_ends.to_numpy(), pc.run_end_encode(b.column("file")).run_ends.to_numpy()
            first = 0
            for end in np.union1d(*runs):
                here = (b.column("file")[first].as_py(), b.column("start")[first].as_py())
                if here != split:
                    split, parity, since, count = here, 0, [-1, -1], [0, 0]
                before = (parity + np.concatenate([[0], np.cumsum(quotes[first:end])])) % 2
                own, full = ids[first:end], filled[first:end]
                out = []
                for case in (0, 1):
                    starts = before[:-1] == case
                    at = np.maximum.accumulate(np.where(starts, np.arange(len(own)), -1))
                    out += [np.where(at >= 0, own[np.maximum(at, 0)], since[case]), count[case] + np.cumsum(starts & full)]
                    since[case], count[case] = int(out[-2][-1]), int(out[-1][-1])
                parity = int(before[-1])
                part = b.slice(first, end - first)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(quotes[first:end] % 2 == 1), *(pa.array(out[i], pa.int64()) for i in (0, 2, 1, 3))],
                    names=["file", "start", "id", "line", "odd", "since0", "since1", "count0", "count1"])
                first = int(end)

    return text.mapInArrow(run, _LINES)


def _records(spark: SparkSession, path: str) -> DataFrame:
    """file, number and record of each record that is not blank, the header included as number 1. A line break inside quotes belongs to the field.

    Splits are totalled (a row for each) and the totals summed up within a file; that says for each split whether quotes are open at its start, how many records
    came before and which one goes on. Records of one line, nearly all, pass straight through; only lines of longer ones are grouped."""
    lines = settle(_lines(spark, path))
    case = lambda name: F.when(F.col("open") == 0, F.col(f"{name}0")).otherwise(F.col(f"{name}1"))
    splits = lines.groupBy("file", "start").agg(
        F.sum(F.col("odd").cast("int")).alias("odd"), *[F.max(c).alias(c) for c in ("since0", "since1", "count0", "count1")])
    earlier = W.partitionBy("file").orderBy("start").rowsBetween(W.unboundedPreceding, -1)
    splits = splits.withColumn("open", F.coalesce(F.sum("odd").over(earlier), F.lit(0)) % 2)
    splits = splits.select("file", "start", "open", case("count").alias("count"), F.when(case("since") >= 0, case("since")).alias("last"))
    splits = splits.select(
        "file", "start", "open", F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("before"), F.last("last", ignorenulls=True).over(earlier).alias("goes_on"))
    placed = lines.join(splits, ["file", "start"]).select(
        "file", "id", "line", "odd", F.when(case("since") >= 0, case("since")).otherwise(F.col("goes_on")).alias("first"), (F.col("before") + case("count")).alias("number"))
    alone = (F.col("id") == F.col("first")) & ~F.col("odd")
    single = placed.where(alone & (F.length(F.trim("line")) > 0)).select("file", "number", F.col("line").alias("record"))
    rest = placed.where(~alone).groupBy("file", "first").agg(
        F.min("number").alias("number"), F.array_sort(F.collect_list(F.struct("id", "line"))).alias("parts"))  # the lines of one record
    joined = rest.select("file", "number", F.array_join(F.transform("parts", lambda p: p["line"]), "\n").alias("record"))
    return single.unionByName(joined)


def _scan(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """file, number, the columns as text, short records padded with nulls, and ``__long``: whether a record has more fields than there are columns.
    A record with another number of fields comes with its raw text, in which separators outside quotes are counted. The header must name the columns in their order."""
    parsed = _records(spark, path).select("file", "number", F.from_csv(
        "record", _text([*columns, "__raw"]).simpleString(), {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "__raw", "escape": '"'}).alias("__r"))
    same = F.array(*[F.lower(F.trim(F.regexp_replace(F.coalesce(F.col("__r")[c], F.lit("")), "^\ufeff", ""))) for c in columns]) == F.array(*[F.lit(c.lower()) for c in columns])
    wrong = F.raise_error(F.concat(F.lit("the header of "), "file", F.lit(" does not name the columns"))).cast("boolean")
    df = parsed.where(F.when(F.col("number") > 1, True).when(same, False).otherwise(wrong)).select("file", "number", "__r.*")
    bare = F.regexp_replace("__raw", '"([^"]|"")*"', "")
    fields = F.length(bare) - F.length(F.replace(bare, F.lit(","), F.lit(""))) + 1
    return df.withColumn("__long", F.coalesce(fields > len(columns), F.lit(False)))


def read_csv_tolerant(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """All text; records with too few fields are padded with nulls, those with too many are left out; the file of each row is kept.
    A quoted field may hold separators, doubled quotes and line breaks (kept as a line feed)."""
    return _scan(spark, path, columns).where("NOT __long").select(*columns, "file")


def read_csv_strict(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """All text; a record with too many fields fails the job, one with too few is padded with nulls; rows are numbered from 1 in each file.
    A quoted field may hold separators, doubled quotes and line breaks, which do not count as rows."""
    broken = F.raise_error(F.concat(F.lit("MALFORMED_RECORD, too many fields: "), "__raw")).cast("boolean")
    df = _scan(spark, path, columns).where(F.when(F.col("__long"), broken).otherwise(True))
    return df.select(*columns, "file", (F.col("number") - 1).alias("row_number"))


def write_partitioned(df: DataFrame, path: str, by: Sequence[str]) -> None:
    """zstd Parquet by partition; only the partitions present in the frame are replaced."""
    df.write.mode("overwrite").option("compression", "zstd").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def write_retained_and_excluded(df: DataFrame, retained: str, excluded: str, by: Sequence[str]) -> None:
    """Both sides of a quarantined frame from one evaluation, which is written once to the shared folder."""
    good, bad = retained_and_excluded(settle(df))
    write_partitioned(good, retained, by)
    write_partitioned(bad, excluded, by)


def write_table_csv(df: DataFrame, path: str) -> None:
    """A small result table as one gzip CSV; meant for summaries, not for panels."""
    df.repartition(1).write.mode("overwrite").csv(path, header=True, compression="gzip")


def parquet_inventory(spark: SparkSession, root: str) -> DataFrame:
    """Rows per file."""
    files = spark.read.option("recursiveFileLookup", "true").parquet(root)
    return files.select(F.col("_metadata.file_path").alias("file")).groupBy("file").agg(F.count("*").alias("rows"))
