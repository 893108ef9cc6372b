"""Row rules, file audits and reconciliation tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tallyfloor.functions.cleaning import combine_flags, primary_reason, valid_coordinate


def is_blank(*columns: str) -> Column:
    return F.coalesce(*[F.col(c).cast("string") for c in columns]).isNull()


def _with_reasons(df: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    return df.withColumns({"reasons": combine_flags(rules), "primary_reason": primary_reason(rules)})


def quarantine_events(df: DataFrame, at: str, lat: str, lon: str, kind: str, allowed: Sequence[str],
                      start: str, end: str) -> DataFrame:
    """Every row with the rules it breaks; a row without reasons is retained."""
    t = F.col(at)
    return _with_reasons(df, {
        "invalid_datetime": t.isNull(),
        "outside_period": t.isNotNull() & ((t < F.lit(start).cast("timestamp_ntz")) | (t >= F.lit(end).cast("timestamp_ntz"))),
        "invalid_coordinate": ~valid_coordinate(F.col(lat), F.col(lon)),
        "missing_type": F.col(kind).isNull(),
        "unexpected_type": F.col(kind).isNotNull() & ~F.col(kind).isin(*allowed),
    })


def quarantine_trips(df: DataFrame, start: str, month: str, raw: Sequence[str]) -> DataFrame:
    t, blank = F.col(start), is_blank(*raw)
    return _with_reasons(df, {
        "blank_row": blank,
        "invalid_start": ~blank & t.isNull(),
        "outside_month": t.isNotNull() & F.coalesce(F.date_format(t, "yyyy-MM") != F.col(month), F.lit(True)),
    })


def retained_and_excluded(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The two sides of a quarantined frame."""
    return df.where(F.col("reasons") == "").drop("reasons", "primary_reason"), df.where(F.col("reasons") != "")


def endpoint_eligible(lat: Column, lon: Column, start_non_public: Column, end_non_public: Column, end_time: Column) -> Column:
    return valid_coordinate(lat, lon) & ~start_non_public & ~end_non_public & end_time.isNotNull()


def non_public(name: Column, prefixes: Sequence[str] = (), patterns: Sequence[str] = ()) -> Column:
    tests = [F.coalesce(name, F.lit("")).startswith(p) for p in prefixes]
    tests += [F.coalesce(name, F.lit("")).rlike(p) for p in patterns]
    out = F.lit(False)
    for t in tests:
        out = out | t
    return out


def eligible_units(df: DataFrame, unit: str, period: str, target: str, side: str, side_state: str,
                   rules: Mapping[str, int], run: DataFrame) -> DataFrame:
    """Support of each unit against six thresholds. ``run`` holds (unit, max_zero_run)."""
    table = df.groupBy(unit).agg(
        F.count("*").alias("valid_days"),
        F.sum(target).alias("total_events"),
        F.count_if(F.col(target) > 0).alias("nonzero_days"),
        F.count_if(F.col(side) > 0).alias("positive_side_days"),
        F.count_distinct(target).alias("target_states"),
        F.count_distinct(side_state).alias("side_states"),
    ).join(run, unit)
    c = F.col
    checks = {
        "insufficient_valid_days": c("valid_days") < rules["valid_days"],
        "insufficient_events": c("total_events") < rules["events"],
        "insufficient_positive_side_days": c("positive_side_days") < rules["positive_side_days"],
        "coverage_discontinuity": c("max_zero_run") > rules["zero_run"],
        "insufficient_target_states": c("target_states") < rules["target_states"],
        "insufficient_side_states": c("side_states") < rules["side_states"],
    }
    return table.withColumn("exclusion_reasons", combine_flags(checks, ";")).withColumn(
        "eligible", c("exclusion_reasons") == ""
    )


# --- audits -------------------------------------------------------------------------------


def row_signature(columns: Sequence[str]) -> Column:
    """128-bit digest of the row text; null and text never collide thanks to the length marks."""
    parts = [F.coalesce(F.concat(F.length(F.col(c).cast("string")), F.lit(":"), F.col(c).cast("string")), F.lit("<NA>")) for c in columns]
    return F.md5(F.concat_ws("|", *parts))


def audit_events(df: DataFrame, file: str, at: str, lat: str, lon: str, kind: str, allowed: Sequence[str],
                 start: str, end: str, identity: Sequence[str]) -> DataFrame:
    """Counters per file. Repeats come from a tally of row signatures, so a signature that
    fills a third of a file is one partial row per task."""
    t = F.col(at)
    tagged = df.select(
        file, t.alias("at"), row_signature(identity).alias("__sig"),
        t.isNull().alias("__bad_time"),
        (t.isNotNull() & ((t < F.lit(start).cast("timestamp_ntz")) | (t >= F.lit(end).cast("timestamp_ntz")))).alias("__outside"),
        (~valid_coordinate(F.col(lat), F.col(lon))).alias("__bad_place"),
        F.col(kind).isNull().alias("__no_type"),
        F.coalesce(~F.col(kind).isin(*allowed), F.lit(False)).alias("__odd_type"),
    )
    flags = ["bad_time", "outside", "bad_place", "no_type", "odd_type"]
    per_sig = tagged.groupBy(file, "__sig").agg(
        F.count("*").alias("n"), F.min("at").alias("lo"), F.max("at").alias("hi"),
        *[F.count_if(f"__{f}").alias(f) for f in flags],
    )
    return per_sig.groupBy(file).agg(
        F.sum("n").alias("rows"), (F.sum("n") - F.count("*")).alias("repeated_rows"),
        F.min("lo").alias("first_at"), F.max("hi").alias("last_at"), *[F.sum(f).alias(f) for f in flags],
    )


def audit_trips(df: DataFrame, file: Sequence[str], start: str, end: str, identity: Sequence[str], trip: str | None = None) -> DataFrame:
    """Counters per file and member: physical and blank rows; over the rows that are not blank their number, repeats (of the trip id where
    there is one), missing times, ends before starts, durations that are not positive, and the first and last start."""
    key = F.coalesce(F.col(trip).cast("string"), row_signature(identity)) if trip else row_signature(identity)
    s, e, blank = F.col(start), F.col(end), F.col("__blank")
    flags = {"no_start": s.isNull(), "no_end": e.isNull(), "reversed": F.coalesce(e < s, F.lit(False)), "not_positive": F.coalesce(e <= s, F.lit(False))}
    own = df.withColumn("__blank", is_blank(*identity))
    per = own.groupBy(*file, "__blank", F.when(~blank, key).alias("__key")).agg(
        F.count("*").alias("n"), F.min(s).alias("lo"), F.max(s).alias("hi"), *[F.count_if(c & ~blank).alias(f) for f, c in flags.items()])
    full = F.when(~blank, F.col("n"))
    return per.groupBy(*file).agg(
        F.sum("n").alias("physical_rows"), F.coalesce(F.sum(F.when(blank, F.col("n"))), F.lit(0)).alias("blank_rows"),
        F.coalesce(F.sum(full), F.lit(0)).alias("rows"), (F.coalesce(F.sum(full), F.lit(0)) - F.count(full)).alias("repeats"),
        *[F.sum(f).alias(f) for f in flags], F.min(F.when(~blank, F.col("lo"))).alias("first_start"), F.max(F.when(~blank, F.col("hi"))).alias("last_start"))


def issue_list(audit: DataFrame, keys: Sequence[str], rules: Mapping[str, tuple[str, str, str]]) -> DataFrame:
    """Long list of non-zero counters: counter -> (severity, code, action)."""
    rows = [
        F.struct(F.lit(sev).alias("severity"), F.lit(code).alias("code"), F.col(c).cast("long").alias("rows"), F.lit(act).alias("action"))
        for c, (sev, code, act) in rules.items()
    ]
    return audit.select(*keys, F.explode(F.array(*rows)).alias("r")).select(*keys, "r.*").where("rows > 0")


def metric_table(df: DataFrame, metrics: Mapping[str, Column]) -> DataFrame:
    """Named one-row aggregates as (metric, value)."""
    one = df.agg(*[m.cast("double").alias(k) for k, m in metrics.items()])
    rows = [F.struct(F.lit(k).alias("metric"), F.col(k).alias("value")) for k in metrics]
    return one.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def reconcile(df: DataFrame, keys: Sequence[str], counters: Mapping[str, Column]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("physical_rows"), *[F.count_if(c).alias(k) for k, c in counters.items()])


def class_shares(df: DataFrame, keys: Sequence[str], label: str) -> DataFrame:
    """Counts and shares per class; the shares of a key add up to one."""
    tally = df.groupBy(*keys, label).agg(F.count("*").alias("n"))
    total = tally.groupBy(*keys).agg(F.sum("n").alias("total"))
    return tally.join(total, list(keys)).withColumn("share", F.col("n") / F.col("total"))


def repeated_rows(df: DataFrame, file: str, row: str, identity: Sequence[str]) -> DataFrame:
    """Rows equal to an earlier row of the same file. The first of each signature is found by
    a partial minimum and taken out by its unique (file, row), so no group is ever collected."""
    signed = df.withColumn("__sig", row_signature(identity))
    first = signed.groupBy(file, "__sig").agg(F.min(row).alias(row)).select(file, row)
    return signed.drop("__sig").join(first, [file, row], "left_anti")


def repeat_decision(rows: DataFrame, repeats: DataFrame, file: str) -> DataFrame:
    """Share of repeats per file and the largest effect dropping them could have (two ends each)."""
    a = rows.groupBy(file).agg(F.count("*").alias("rows"))
    b = repeats.groupBy(file).agg(F.count("*").alias("repeats"))
    out = a.join(b, file, "left").fillna(0, ["repeats"])
    return out.withColumns({"repeat_share": F.col("repeats") / F.col("rows"), "worst_case_endpoints": F.col("repeats") * 2})


def station_exceptions(df: DataFrame, keys: Sequence[str], source: str) -> DataFrame:
    label = F.when(F.col(source) == "non_public_node", F.lit("non_public_node")).when(
        F.col(source) == "unresolved", F.lit("unresolved_public_or_unknown"))
    return df.withColumn("classification", label).where(F.col("classification").isNotNull()).groupBy(
        *keys, "classification").agg(F.count("*").alias("row_count"))


def disposition(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("rows"))


def shared_token_columns(frames: Sequence[DataFrame], tokens: Sequence[str]) -> list[str]:
    """Columns present in every frame whose name holds one of the tokens."""
    shared = set(frames[0].columns).intersection(*[set(f.columns) for f in frames[1:]])
    return sorted(c for c in shared if any(t.lower() in c.lower() for t in tokens))
