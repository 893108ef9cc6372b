"""Near-duplicates by SimHash and the generalised pigeonhole principle."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import keyed_join, settle, without
from .components import connected

BITS = 64
#: Shingles hashed at a time, which bounds the memory for a very long text.
BLOCK = 1 << 16
#: Fingerprints that estimate costs of a plan. The plan decides how pairs are found, never which.
SAMPLE = 4096
#: Fingerprints of the sample that are compared with all of it at a time.
PAIRED = 128
#: Fingerprints that probe one signature before its members are probed on all bits instead.
BUCKET = 16


def fingerprint(text: bytes | None, width: int = 3) -> int:
    """SimHash of word shingles (repeats included, A-Z lower-cased); zero without words."""
    import xxhash

    words = (text or b"").lower().split()
    if not words:
        return 0
    n = max(1, len(words) - width + 1)
    counts = np.zeros(BITS, np.int64)
    for at in range(0, n, BLOCK):
        part = words[at : min(at + BLOCK, n) + width - 1]
        rows = [part[k : len(part) - width + 1 + k] for k in range(width)] if len(words) >= width else [[b" ".join(words)]]
        h = np.fromiter((xxhash.xxh64_intdigest(b" ".join(s), 42) for s in zip(*rows)), np.uint64)
        counts += np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(sum(1 << i for i in range(BITS) if 2 * counts[i] > n))


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """doc_id, tag, fp (the 64 bits as a long) for each row; ``tag`` is that of ``docs``, or one that tells rows apart once the result is written."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.fromiter((fingerprint(t.as_py(), width) for t in b.column(2)), np.uint64, len(b))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fp.view(np.int64))], names=["doc_id", "tag", "fp"])

    tag = F.col("tag") if "tag" in docs.columns else F.monotonically_increasing_id()
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), tag.cast("long").alias("tag"), F.col("text").cast("binary").alias("text"))
    return narrow.mapInArrow(run, "doc_id long, tag long, fp long")


# --- the plan -----------------------------------------------------------------------------


def group_bits(bits: np.ndarray, parts: int) -> list[list[int]]:
    """Bits (columns of 0/1) in ``parts`` groups of near-equal size, correlated ones together: each group starts from the
    most balanced free bit and takes the free bit with the largest mean absolute correlation to it."""
    p = bits.mean(0)
    centred = bits - p
    spread = np.sqrt(np.maximum((centred**2).mean(0), 1e-12))
    corr = np.abs((centred.T @ centred) / max(1, len(bits)) / np.outer(spread, spread))
    free, groups = set(range(BITS)), []
    for k in range(parts):
        group = [min(free, key=lambda i: (abs(p[i] - 0.5), i))]
        free.remove(group[0])
        while free and len(group) < BITS // parts + (k < BITS % parts):
            best = max(free, key=lambda i: (corr[i, group].mean(), -i))
            group.append(best)
            free.remove(best)
        groups.append(sorted(group))
    return groups


def pair_share(bits: np.ndarray, group: list[int], radius: int) -> float:
    """Estimated share of pairs of fingerprints within ``radius`` on the bits of a group: what the sample shows, but at least what
    independent bits would give."""
    part = bits[:, group].astype(np.float32)
    n = len(part)
    if n < 2:
        return 0.0
    ones, near = part.sum(1), 0
    for at in range(0, n, PAIRED):  # the driver never holds all pairs
        own = slice(at, at + PAIRED)
        near += int((ones[own, None] + ones[None, :] - 2 * (part[own] @ part.T) <= radius + 0.5).sum())
    seen = (float(near) - n) / (n * (n - 1))
    law = np.zeros(radius + 1)
    law[0] = 1.0
    for q in part.mean(0):
        differ = float(2 * q * (1 - q))
        law = law * (1 - differ) + np.concatenate([[0.0], law[:-1]]) * differ
    return max(seen, float(law.sum()))


def variants(width: int, radius: int) -> int:
    return sum(len(list(combinations(range(width), k))) for k in range(radius + 1)) if radius >= 0 else 0


def plan(bits: np.ndarray, rows: int, distance: int, most_parts: int | None = None) -> list[tuple[list[int], int]]:
    """Groups of bits with their radii (only those that are probed).

    By the generalised pigeonhole principle, if the radii of m groups add up to distance - m + 1 (a radius of -1 skips a group),
    two fingerprints within the distance agree to within the radius on some group. For each m, dynamic programming over
    (group, radii spent) finds the radii with the fewest estimated candidates plus probes; the cheapest m is taken. However crowded
    signatures are, their members emit their neighbours at one bit once, which bounds what candidates can cost."""
    best: tuple[float, list[tuple[list[int], int]]] = (float("inf"), [])
    for m in range(1, (most_parts or distance + 2) + 1):
        groups, total = group_bits(bits, m), distance - m + 1
        state: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
        for g in groups:
            met = lambda r: min(float(rows) ** 2 / 2 * pair_share(bits, g, r), float(rows) * (BITS + 1) / m)
            cost = {r: 0.0 if r < 0 else float(rows) * (1 + variants(len(g), r)) + met(r) for r in range(-1, distance + 1)}
            then: dict[int, tuple[float, list[int]]] = {}
            for spent, (so_far, radii) in state.items():
                for r, c in cost.items():
                    if spent + r not in then or so_far + c < then[spent + r][0]:
                        then[spent + r] = (so_far + c, [*radii, r])
            state = then
        if total in state and state[total][0] < best[0]:
            best = (state[total][0], [(g, r) for g, r in zip(groups, state[total][1]) if r >= 0])
    return best[1]


def _mask(bits: Iterable[int]) -> int:
    m = sum(1 << i for i in bits)
    return m - (1 << 64) if m >= 1 << 63 else m


def _flipped(value: Column, masks: list[int]) -> Column:
    return F.transform(F.array(*[F.lit(m).cast("long") for m in masks]), lambda m: value.bitwiseXOR(m))


def links(distinct: DataFrame, distance: int = 2, bucket: int = BUCKET, probes: list[tuple[list[int], int]] | None = None) -> DataFrame:
    """Links a, b (a != b) between distinct fingerprints (column ``fp``, a written table), enough to join all that
    differ in at most ``distance`` (2) bits.

    Every fingerprint probes the signatures (group, value within the radius); candidates meet on them and are
    verified by their distance. Members of a signature with more than ``bucket`` probes are not paired: they probe all 64 bits
    from both sides, that is, each emits itself and its 64 neighbours at one bit. Two fingerprints within 2 bits
    share such a key, all that share one are within 2 bits, and it has 65 members at most, which link to its smallest."""
    if distance != 2:
        raise ValueError("links meet half-way at one bit, which is for a distance of 2")
    rows = distinct.count()
    if probes is None:
        near = distinct.orderBy(F.xxhash64("fp")).limit(SAMPLE).collect()  # a bounded sample
        sample = np.array([r["fp"] for r in near], np.int64).view(np.uint64)
        bits = ((sample[:, None] >> np.arange(BITS, dtype=np.uint64)) & np.uint64(1)).astype(np.float64) if len(sample) else np.zeros((1, BITS))
        probes = plan(bits, max(1, rows), distance)
    keys = []
    for k, (group, radius) in enumerate(probes):
        base = F.col("fp").bitwiseAND(F.lit(_mask(group)).cast("long"))
        flips = [0, *(_mask(c) for r in range(1, radius + 1) for c in combinations(group, r))]
        keys.append(distinct.select("fp", F.lit(k).alias("part"), F.explode(_flipped(base, flips)).alias("value")).withColumn("own", F.col("value") == base))
    probed = keys[0]
    for more in keys[1:]:
        probed = probed.unionByName(more)
    probed = settle(probed)
    sizes = settle(probed.groupBy("part", "value").agg(F.count(F.lit(1)).alias("n")).where("n > 1").withColumn("sig", F.struct("part", "value")).drop("part", "value"))
    met = settle(keyed_join(probed.select("fp", "own", F.struct("part", "value").alias("sig")), sizes, "sig", "n", probed.count()))
    small = met.where(F.col("n") <= bucket)
    a = small.select("sig", F.col("fp").alias("a"))
    b = small.where("own").select("sig", F.col("fp").alias("b"))
    differ = F.bit_count(F.col("a").bitwiseXOR(F.col("b")))
    found = a.join(b, "sig").where((F.col("a") < F.col("b")) & (differ <= distance)).select("a", "b").distinct()
    large = met.where(F.col("n") > bucket).select("fp").distinct()
    half = large.select("fp", F.explode(_flipped(F.col("fp"), [0, *(_mask([i]) for i in range(BITS))])).alias("key"))
    shared = half.groupBy("key").agg(F.min("fp").alias("a"), F.collect_set("fp").alias("own")).where("size(own) > 1")  # 65 at most
    wide = shared.select("a", F.explode("own").alias("b")).where("a <> b").distinct()
    return found.unionByName(wide)


def _labelled(docs: DataFrame, distance: int, bucket: int) -> DataFrame:
    """doc_id, tag, fp and ``low`` for each row of docs (doc_id, text and maybe tag): the least row of its component as (has no id, doc_id, tag)."""
    own = settle(fingerprints(docs))
    nodes = settle(own.groupBy("fp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("lacks"), "doc_id", "tag")).alias("low"), F.count(F.lit(1)).alias("n")))
    roots = connected(settle(links(nodes.select("fp"), distance, bucket)), "fp", "root")
    named = nodes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    named = settle(named)
    lows = settle(named.where("root <> fp").groupBy("root").agg(F.min("low").alias("least"), F.count(F.lit(1)).alias("members")))
    heads = named.where("root = fp").join(lows.select(F.col("root").alias("fp"), "least"), "fp", "left").select("fp", "n", F.least("low", "least").alias("low"))
    heads = settle(heads)
    tails = keyed_join(named.where("root <> fp").select("fp", "n", "root"), settle(heads.select(F.col("fp").alias("root"), "low").join(lows, "root")), "root", "members", named.count())
    labels = settle(heads.unionByName(tails.select("fp", "n", "low")))
    return keyed_join(own, labels, "fp", "n", own.count()).select("doc_id", "tag", "fp", "low")


def near_duplicates(docs: DataFrame, distance: int = 2, bucket: int = BUCKET) -> DataFrame:
    """doc_id, fp, component_id for each row: the smallest doc_id that links of at most ``distance`` differing bits reach.

    Copies share a fingerprint and are one node from the start. Null and blank texts have fingerprint zero, null ids
    are never the smallest (a component of null ids only has a null id), repeated rows are each returned, and other columns
    are ignored."""
    return _labelled(docs.select("doc_id", "text"), distance, bucket).select("doc_id", "fp", F.col("low.doc_id").alias("component_id"))


def deduplicate(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each component: that of the smallest doc_id, and of rows that share it, or of those of a component without any
    id, the first in the order of reading. Rows are told apart by a tag, so ids may be null or repeated."""
    tagged = settle(docs.select(F.monotonically_increasing_id().alias("tag"), F.struct(*docs.columns).alias("row")))
    found = _labelled(tagged.select("tag", "row.doc_id", "row.text"), 2, BUCKET)
    gone = settle(found.where(F.col("tag") != F.col("low.tag")).select("tag"))
    return without(tagged, gone, "tag").select("row.*")


def query(spark, docs: DataFrame) -> DataFrame:
    return near_duplicates(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
