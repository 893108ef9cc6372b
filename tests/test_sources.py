"""File scans and sinks."""

import io
import os
import zipfile

import pytest
from pyspark.sql import functions as F

from tallyfloor.functions.cleaning import resolve_columns
from tallyfloor.operators import audit as au
from tallyfloor.sources import files as fl


def test_zip_members(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("one.csv", "﻿Ride ID, Start \n1,x\n2,y\n")
        z.writestr("__MACOSX/._one.csv", "junk")
        z.writestr("sub/two.csv", 'start,ride id\n"a, b",3\n')
        z.writestr("readme.txt", "no")
    out = fl.read_zip_csv(spark, str(tmp_path), ["ride id", "start", "end"], chunk=1).orderBy("member", "row_number").collect()
    assert [(r.member, r.row_number, r["ride id"], r["start"], r["end"]) for r in out] == [
        ("one.csv", 1, "1", "x", None), ("one.csv", 2, "2", "y", None), ("sub/two.csv", 1, "3", "a, b", None)]


def test_strict_rows_are_numbered_over_splits(spark, tmp_path):
    for name, n in (("a.csv", 700), ("b.csv", 30)):
        (tmp_path / name).write_text("k,v\n" + "".join(f"{i},{'x' * 40}\n" for i in range(1, n + 1)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        out = fl.read_csv_strict(spark, str(tmp_path), ["k", "v"])
        assert out.where("row_number <> cast(k as long)").count() == 0 and out.count() == 730
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


@pytest.mark.parametrize("size", ["64", "700", "134217728"])
def test_records_with_line_breaks_over_splits(spark, tmp_path, size):
    """Beside Python's csv reader: breaks, separators and quotes inside fields, short and blank lines, however the file is split."""
    import csv
    import random

    rnd = random.Random(3)
    fields = ["x", "", "two\nlines", 'say ""so""', "a,b", "\n\n\n", "z" * 90, "tail\n"]
    for name in ("a.csv", "b.csv"):
        body = ["k,v,w"]
        for i in range(120):
            f = [f'"{rnd.choice(fields)}"' for _ in range(2)]
            body.append(f"{i}" if i % 17 == 0 else f"{i},{f[0]}" if i % 11 == 0 else f"{i},{f[0]},{f[1]}")
            if i % 13 == 0:
                body.append("")
        (tmp_path / name).write_text("\n".join(body) + "\n", newline="")
    want = []
    for name in ("a.csv", "b.csv"):
        with open(tmp_path / name, newline="") as f:
            rows = [r for r in csv.reader(f) if r][1:]
        want += [(name, i, *[(r + [None] * 3)[j] or None for j in range(3)]) for i, r in enumerate(rows, 1)]
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    try:
        out = fl.read_csv_strict(spark, str(tmp_path), ["k", "v", "w"]).collect()
        loose = fl.read_csv_tolerant(spark, str(tmp_path), ["k", "v", "w"]).count()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    got = sorted((r.file.rsplit("/", 1)[-1], r.row_number, r.k, r.v or None, r.w or None) for r in out)
    assert got == sorted(want) and loose == len(want)


def test_header_must_name_the_columns(spark, tmp_path):
    (tmp_path / "a.csv").write_text("k,other\n1,x\n")
    with pytest.raises(Exception, match="header"):
        fl.read_csv_tolerant(spark, str(tmp_path), ["k", "v"]).collect()


def test_strict_fails_and_tolerant_skips(spark, tmp_path):
    (tmp_path / "a.csv").write_text("k,v\n1,x\n2,y,z\n3,w\n")
    assert fl.read_csv_tolerant(spark, str(tmp_path), ["k", "v"]).count() == 2
    with pytest.raises(Exception):
        fl.read_csv_strict(spark, str(tmp_path), ["k", "v"]).collect()


def test_manifest_marks_duplicates(spark, tmp_path):
    for name, text in (("a.csv", "1"), ("b.csv", "1"), ("c.csv", "2")):
        (tmp_path / name).write_text(text)
    out = {r.name: (r.role, r.copies) for r in fl.file_manifest(spark, str(tmp_path), "*.csv").collect()}
    assert out == {"a.csv": ("canonical", 2), "b.csv": ("duplicate_candidate", 2), "c.csv": ("canonical", 1)}
    assert fl.list_inputs(spark, str(tmp_path), "c*.csv").count() == 1


def _sha256(path):
    import hashlib

    with open(path, "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


def test_manifest_of_a_file_above_2_gb(spark, tmp_path):
    """More than one value or array holds; the file is sparse, so it takes no disk."""
    for name in ("a.bin", "b.bin"):
        with open(tmp_path / name, "wb") as f:
            f.write(b"head")
            f.truncate(2**31 + 5)
            f.seek(2**31 + 2)
            f.write(b"end")
    (tmp_path / "c.bin").write_bytes(b"small")
    out = {r.name: (r.bytes, r.sha256, r.copies, r.role) for r in fl.file_manifest(spark, str(tmp_path), "*.bin").collect()}
    large, small = _sha256(tmp_path / "a.bin"), _sha256(tmp_path / "c.bin")
    assert out == {
        "a.bin": (2**31 + 5, large, 2, "canonical"), "b.bin": (2**31 + 5, large, 2, "duplicate_candidate"), "c.bin": (5, small, 1, "canonical")}


def test_manifest_of_odd_files(spark, tmp_path):
    """Sizes about that of a part, odd names and an ending that stands for a codec; also by a path that only Spark's readers know."""
    import gzip

    (tmp_path / "in" / "sub").mkdir(parents=True)
    part = os.urandom(1 << 20)
    content = {"less": part[:-1], "part": part, "more": part + b"x", "a b%20#é.csv": b"odd", "sub/text.gz": gzip.compress(b"text"), "sub/twin": b"odd"}
    for name, c in content.items():
        (tmp_path / "in" / name).write_bytes(c)
    twice = {"a b%20#é.csv": (2, "canonical"), "twin": (2, "duplicate_candidate")}
    want = {(n := path.rsplit("/", 1)[-1]): (len(c), _sha256(tmp_path / "in" / path), *twice.get(n, (1, "canonical"))) for path, c in content.items()}
    store = f"m{os.getpid()}"
    spark.conf.set(f"fs.viewfs.mounttable.{store}.link./there", f"file://{tmp_path}/in")
    try:
        for root in (str(tmp_path / "in"), f"viewfs://{store}/there"):
            assert {r.name: (r.bytes, r.sha256, r.copies, r.role) for r in fl.file_manifest(spark, root, "*").collect()} == want
    finally:
        spark.conf.unset(f"fs.viewfs.mounttable.{store}.link./there")
    assert fl.file_manifest(spark, str(tmp_path), "*.none").count() == 0


def test_dual_sink_and_dynamic_overwrite(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1, ""), ("a", 2, "bad"), ("b", 3, "")], "p string, v int, reasons string").withColumn("primary_reason", F.lit(None).cast("string"))
    good, bad = str(tmp_path / "good"), str(tmp_path / "bad")
    fl.write_retained_and_excluded(rows, good, bad, ["p"])
    assert spark.read.parquet(good).count() == 2 and spark.read.parquet(bad).count() == 1
    fl.write_partitioned(spark.createDataFrame([("a", 9)], "p string, v int"), good, ["p"])
    assert sorted(r.v for r in spark.read.parquet(good).collect()) == [3, 9]
    assert sum(r["rows"] for r in fl.parquet_inventory(spark, good).collect()) == 2
    out = str(tmp_path / "t")
    fl.write_table_csv(rows.drop("primary_reason"), out)
    assert [f for f in os.listdir(out) if f.endswith(".csv.gz")].__len__() == 1


def test_aliases(spark):
    raw = spark.createDataFrame([("1", "n")], ["  Start   Station ID", "name"])
    out = resolve_columns(raw, {"id": ["bike id", "start station id"], "label": ["name"], "lat": ["lat"]}).first()
    assert (out.id, out.label, out.lat) == ("1", "n", None)


def test_repeats_never_confuse_null_and_text(spark):
    rows = spark.createDataFrame([("f", 1, None, "a"), ("f", 2, "<NA>", "a"), ("f", 3, None, "a"), ("f", 4, "a|1:b", None), ("f", 5, "a", "b")], "file string, row int, x string, y string")
    assert [r.row for r in au.repeated_rows(rows, "file", "row", ["x", "y"]).collect()] == [3]
