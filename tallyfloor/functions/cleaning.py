"""Cleaning of raw text columns."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T


def clean_text(c: Column) -> Column:
    """Take white space off both ends; an empty string becomes null."""
    return F.nullif(F.regexp_replace(c.cast("string"), r"(?U)^\s+|\s+$", ""), F.lit(""))


def normal_header(name: str) -> str:
    """Drop a byte-order mark, trim, collapse blanks, lower-case."""
    return " ".join(name.replace("﻿", "").split()).lower()


def resolve_columns(
    df: DataFrame, aliases: Mapping[str, Sequence[str]], keep: Iterable[str] = ()
) -> DataFrame:
    """Select one column per target name: the first alias present, else a typed null."""
    present: dict[str, str] = {}
    for name in df.columns:
        present.setdefault(normal_header(name), name)
    picked = [F.col(f"`{k}`") for k in keep]
    for target, names in aliases.items():
        hit = next((present[normal_header(n)] for n in names if normal_header(n) in present), None)
        source = F.lit(None).cast("string") if hit is None else F.col(f"`{hit}`").cast("string")
        picked.append(source.alias(target))
    return df.select(*picked)


def safe_double(c: Column) -> Column:
    """Number or null; only decimal notation counts as a number, not type suffixes or names of special values."""
    text = clean_text(c)
    number = text.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$")
    return F.when(number, text.try_cast("double"))


def safe_timestamp(c: Column, formats: Sequence[str]) -> Column:
    """First format that parses; null when none does."""
    text = clean_text(c)
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in formats]).cast("timestamp_ntz")


# Curly quotes and dashes and their plain forms, position by position.
_FANCY = "‘’“”–—"
_PLAIN = "''\"\"--"


def plain_name(c: Column) -> Column:
    """Lower-case, plain quotes and dashes, single blanks; for text already in composed form."""
    text = F.translate(F.lower(c), _FANCY, _PLAIN)
    return F.nullif(F.trim(F.regexp_replace(text, r"\s+", " ")), F.lit(""))


def norm_names(df: DataFrame, column: str, out: str) -> DataFrame:
    """Add the compatibility-folded name. Unicode folding has no built-in, so only rows
    that hold a non-ASCII character are folded in Python, to which the others go as null. The
    rows are read once, whatever they are derived from."""

    def fold(batches):
        for s in batches:
            yield s.map(lambda v: None if v is None else unicodedata.normalize("NFKC", v).casefold())

    from collections.abc import Iterator

    import pandas as pd

    fold.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    folded = F.pandas_udf(fold, T.StringType())
    # A text is ASCII if it has as many bytes as characters.
    odd = F.when(F.octet_length(column) > F.length(column), F.col(column))
    both = df.withColumn("__folded", folded(odd))
    return both.withColumn(out, plain_name(F.coalesce("__folded", F.col(column)))).drop("__folded")


def station_id(c: Column) -> Column:
    """Trimmed id without a trailing ``.0``."""
    return F.regexp_replace(clean_text(c), r"^(\d+)\.0$", "$1")


def station_key(identifier: Column, name: Column) -> Column:
    """``I:<id>`` when there is an id, else ``N:<name>``, else null."""
    return F.when(identifier.isNotNull(), F.concat(F.lit("I:"), identifier)).when(
        name.isNotNull(), F.concat(F.lit("N:"), name)
    )


def split_station(c: Column) -> tuple[Column, Column]:
    """Four-digit id and remaining name of a combined station label."""
    text = clean_text(c)
    code = F.nullif(F.regexp_extract(text, r"^\s*(\d{4})\b", 1), F.lit(""))
    name = F.nullif(F.trim(F.regexp_replace(text, r"^\s*\d{4}\b\s*", "")), F.lit(""))
    return code, name


def valid_coordinate(lat: Column, lon: Column) -> Column:
    ok = lat.between(-90, 90) & lon.between(-180, 180) & ~F.isnan(lat) & ~F.isnan(lon)
    return F.coalesce(ok, F.lit(False))


def combine_flags(rules: Mapping[str, Column], sep: str = "|") -> Column:
    """Names of the rules that hold, in rule order; empty when none does."""
    return F.concat_ws(sep, *[F.when(cond, F.lit(name)) for name, cond in rules.items()])


def remove_flag(flags: Column, flag: str) -> Column:
    return F.concat_ws("|", F.array_remove(F.array_remove(F.split(flags, r"\|"), flag), ""))


def add_flag(flags: Column, flag: str) -> Column:
    kept = F.array_remove(F.split(F.coalesce(flags, F.lit("")), r"\|"), "")
    return F.concat_ws("|", F.array_union(kept, F.array(F.lit(flag))))


def primary_reason(rules: Mapping[str, Column]) -> Column:
    """First rule that holds, else null."""
    return F.coalesce(*[F.when(cond, F.lit(name)) for name, cond in rules.items()])


def period_from_path(path: Column) -> Column:
    """``YYYY-MM`` from a file name holding ``YYYYMM`` or ``YYYY-MM``; null when absent."""
    found = F.regexp_extract(path, r"((?:19|20)\d{2})[-_]?(0[1-9]|1[0-2])", 0)
    digits = F.regexp_replace(found, r"[-_]", "")
    return F.when(
        F.length(digits) == 6, F.concat_ws("-", F.substring(digits, 1, 4), F.substring(digits, 5, 2))
    )


def event_id(city: Column, source_hash: Column, row: Column) -> Column:
    return F.format_string("CR-%s-%s-%09d", city, F.substring(source_hash, 1, 12), row)


def trip_id(city: Column, source_hash: Column, member: Column, row: Column) -> Column:
    return F.format_string("BI-%s-%s-%03d-%09d", city, F.substring(source_hash, 1, 12), member, row)


def duration_seconds(given: Column, start: Column, end: Column) -> Column:
    """Stated duration, else the difference of the two wall-clock times."""
    span = F.unix_micros(end.cast("timestamp")) - F.unix_micros(start.cast("timestamp"))
    return F.coalesce(given, span / F.lit(1e6))


# Flag text of the source and the ride type it stands for.
_RIDE = {"true": "electric", "1": "electric", "false": "classic", "0": "classic"}


def ride_type(existing: Column, flag: Column) -> Column:
    low = F.lower(clean_text(flag))
    known = F.create_map(*[F.lit(v) for pair in _RIDE.items() for v in pair])
    return F.coalesce(clean_text(existing), known[low])
