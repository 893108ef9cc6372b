"""Near-duplicates by SuperMinHash signatures, banding, verification on full sets and connected components."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import keyed_join, settle
from .components import connected

#: A signature has BANDS x ROWS positions. A pair of similarity 0.8 shares no band with a probability of (1 - 0.8^6)^32 = 6e-5, one of 0.85 with 3e-7.
BANDS, ROWS = 32, 6
POSITIONS = BANDS * ROWS
#: Pairs that agree in fewer positions are not verified. At a similarity of 0.8 the mean is 153.6 and the spread at most 5.6, so this is 6.7 spreads below.
AGREE = 116
#: Texts to be read again whose keys may be broadcast; of more, keys and texts are shuffled.
BROADCAST_ROWS = 500_000
#: Shingles whose signatures are made together.
TOGETHER = 1 << 16
#: Members of a band that are all compared at once.
FEW = 16
#: Pivots of a larger band in the first round, and how many times as many each further one has.
FIRST, GROWTH = 1, 16
#: Hashes that more than one of so many members of a crowd have are not told apart from those of its lead.
COMMON = 8
#: Members outside a band's largest component that are all pivots, once the band is divided.
STRANGERS = 256

_A, _B, _C = (np.uint64(v) for v in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))  # fixed values: constants of the SplitMix64 finaliser
_FULL = np.uint64(0xFFFFFFFFFFFFFFFF)


def mix(v: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose bits all depend on each other (the SplitMix64 finaliser)."""
    v = (v ^ (v >> np.uint64(30))) * _B
    v = (v ^ (v >> np.uint64(27))) * _C
    return v ^ (v >> np.uint64(31))


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        import xxhash

        h = self[word] = xxhash.xxh64_intdigest(word, 42)
        return h


def shingle_set(text: bytes | None, width: int, known: dict) -> np.ndarray:
    """The sorted 64-bit hashes of a text's distinct word shingles (A-Z lower-cased; with fewer words the whole sequence; none without words)."""
    words = (text or b"").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    size = min(width, len(words))
    n = len(words) - size + 1
    out = np.full(n, np.uint64(size))
    for k in range(size):
        out = mix(out * _A + h[k : k + n])
    return np.unique(out)


def sign(sets: list[np.ndarray]) -> np.ndarray:
    """SuperMinHash signatures of non-empty sets, a row of ``POSITIONS`` 64-bit values for each.

    On level i every element draws a rank i + r and the next place of its own random permutation of the positions; a position takes the smallest
    rank. Ranks of later levels are larger, so a position that is filled stays, and a set is done on the first
    level that leaves none of its positions open. As r is a hash of element and level, two sets agree on a position if the same element won it on the same level."""
    sizes = np.array([len(s) for s in sets])
    element = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets), dtype=np.int64), sizes)
    won = np.full(len(sets) * POSITIONS, _FULL)
    order = None
    for level in range(POSITIONS):
        seed = element + _A * np.uint64(2 * level + 1)
        rank, draw = mix(seed), mix(seed + _A)
        k = level + (draw % np.uint64(POSITIONS - level)).astype(np.int64)
        if order is None:
            place, order_at = k, k  # places are still in their order, so the swap need not be made yet
        else:
            at = np.arange(len(element))
            place = order[at, k].astype(np.int64)
            order[at, k] = order[at, level]
        slot = owner * POSITIONS + place
        free = won[slot] == _FULL
        np.minimum.at(won, slot[free], rank[free])
        unfinished = (won.reshape(-1, POSITIONS) == _FULL).any(1)
        if not unfinished.any():
            break
        keep = unfinished[owner]
        element, owner = element[keep], owner[keep]
        if order is None:
            order = np.tile(np.arange(POSITIONS, dtype=np.uint8), (len(element), 1))
            order[np.arange(len(element)), order_at[keep]] = 0  # what stood first has gone to the place drawn on level 0
        else:
            order = order[keep]
    return won.reshape(-1, POSITIONS)


def _together(texts: Iterable, width: int) -> Iterator[list[np.ndarray]]:
    """The shingle sets of texts, about ``TOGETHER`` shingles at a time."""
    known, held, size = _Words(), [], 0
    for t in texts:
        held.append(shingle_set(t.as_py(), width, known))
        size += len(held[-1])
        if len(known) > 1 << 18:
            known.clear()
        if size >= TOGETHER or len(held) >= 2048:
            yield held
            held, size = [], 0
    if held:
        yield held


def _digest(own: np.ndarray) -> bytes:
    import xxhash

    return xxhash.xxh3_128_digest(own.tobytes())


_SIGNED = "doc_id long, tag long, seen long, n long, digest binary, sig binary, bands array<long>"


def _text_key():
    """Tells rows apart on a second reading; rows that share it by chance are told apart by the digest of their sets."""
    return F.xxhash64("doc_id", "text")


def signatures(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, tag, seen (key of id and text), n (set size), digest (of the set), sig (a byte for each position) and bands for each row of docs."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            first = 0
            for sets in _together(b.column("text"), width):
                part = b.slice(first, len(sets))
                first += len(sets)
                real = [s for s in sets if len(s)]
                sig, bands = [None] * len(sets), [None] * len(sets)
                if real:
                    made = sign(real)
                    band = np.full((len(real), BANDS), 0, np.uint64) + np.arange(BANDS, dtype=np.uint64)
                    for r in range(ROWS):
                        band = mix(band * _A + made.reshape(-1, BANDS, ROWS)[:, :, r])
                    low = (made & np.uint64(255)).astype(np.uint8)
                    at = [i for i, s in enumerate(sets) if len(s)]
                    for k, i in enumerate(at):
                        sig[i], bands[i] = low[k].tobytes(), band[k].view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("tag"), part.column("seen"), pa.array([len(s) for s in sets], pa.int64()),
                     pa.array([_digest(s) for s in sets], pa.binary()), pa.array(sig, pa.binary()), pa.array(bands, pa.list_(pa.int64()))],
                    names=["doc_id", "tag", "seen", "n", "digest", "sig", "bands"],
                )

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("tag").cast("long").alias("tag"), _text_key().alias("seen"), F.col("text").cast("binary").alias("text"))
    return narrow.mapInArrow(run, _SIGNED)


def _full_sets(docs: DataFrame, nodes: DataFrame, width: int) -> DataFrame:
    """node, own (the sorted hashes, 8 bytes each) for each of ``nodes`` (node, seen, digest), from a second reading of their texts."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            first = 0
            for sets in _together(b.column("text"), width):
                nodes, digests = (b.column(c).slice(first, len(sets)).to_pylist() for c in ("node", "digest"))
                first += len(sets)
                found = [(n, s.tobytes()) for n, d, s in zip(nodes, digests, sets) if _digest(s) == d]
                yield pa.RecordBatch.from_arrays([pa.array([n for n, _ in found], pa.int64()), pa.array([s for _, s in found], pa.binary())], names=["node", "own"])

    texts = docs.select(_text_key().alias("seen"), F.col("text").cast("binary").alias("text"))
    few = nodes.count() <= BROADCAST_ROWS
    met = texts.join(F.broadcast(nodes) if few else nodes, "seen").select("node", "digest", "text")
    once = met.mapInArrow(run, "node long, own binary")
    return once.groupBy("node").agg(F.min("own").alias("own"))  # repeated rows give the same set


def _compare(pairs: DataFrame, least: int) -> DataFrame:
    """a, b of those pairs (a, b, own_a, own_b) for which 100 times the intersection is at least ``least`` times the union."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for left, right in zip(b.column("own_a"), b.column("own_b")):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (left, right))
                both = len(x) + len(y) - len(np.union1d(x, y))
                keep.append(100 * both >= least * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return pairs.select("a", "b", "own_a", "own_b").mapInArrow(run, "a long, b long")


def _agreeing(pairs: DataFrame) -> DataFrame:
    """a, b, agree of those pairs (a, b, sig_a, sig_b) whose signatures agree in ``AGREE`` positions or more."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y = (np.frombuffer(b"".join(b.column(c).to_pylist()), np.uint8).reshape(-1, POSITIONS) for c in ("sig_a", "sig_b"))
            agree = (x == y).sum(1)
            out = pa.RecordBatch.from_arrays([b.column("a"), b.column("b"), pa.array(agree, pa.int32())], names=["a", "b", "agree"])
            yield out.filter(pa.array(agree >= AGREE))

    return pairs.select("a", "b", "sig_a", "sig_b").mapInArrow(run, "a long, b long, agree int")


def _both_sides(pairs: DataFrame, table: DataFrame, *columns: str) -> DataFrame:
    """``pairs`` with columns of ``table`` (node, ...) for a and for b, as ``<column>_a`` and ``<column>_b``."""
    side = lambda s: table.select(F.col("node").alias(s), *[F.col(c).alias(f"{c}_{s}") for c in columns])
    return pairs.join(side("a"), "a").join(side("b"), "b")


def _labels(links: DataFrame) -> DataFrame:
    """node, root for the nodes of ``links``: the smallest node within a few steps. Equal labels mean connected; connected nodes that are far
    apart may have different ones, which costs comparisons and no result."""
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = settle(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("a")).alias("root")))
    for _ in range(2):
        onward = low.select(F.col("node").alias("root"), F.col("root").alias("next"))
        low = low.join(onward, "root").select("node", F.col("next").alias("root"))
        around = both.join(low.select(F.col("node").alias("b"), "root"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("near"))
        low = settle(low.join(around, "node").select("node", F.least("root", "near").alias("root")))
    return low


class _Graph:
    """The links found so far."""

    def __init__(self, docs: DataFrame, nodes: DataFrame, width: int, least: int):
        self.docs, self.nodes, self.width, self.least = docs, nodes, width, least
        self.links = self.labels = None

    def verify(self, pairs: DataFrame) -> None:
        """Adds the links among ``pairs`` (a, b, agree; a written table) that matter to the components: those whose full sets are near. The texts are read once more for
        all of them. Each node's best pair comes first; of the rest those are left out whose two nodes have the same least neighbour by then, and are so connected."""
        wanted = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
        sets = settle(_full_sets(self.docs, settle(self.nodes.join(wanted, "node").select("node", "seen", "digest")), self.width))
        near = lambda p: settle(_compare(_both_sides(p, sets, "own"), self.least))
        best = settle(_best_of_each(pairs))
        new = near(best)
        both = new.unionByName(new.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = settle(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("a")).alias("low")))
        side = lambda s: low.select(F.col("node").alias(s), F.col("low").alias(f"low_{s}"))
        rest = pairs.select("a", "b").join(best, ["a", "b"], "left_anti").join(side("a"), "a", "left").join(side("b"), "b", "left")
        rest = settle(rest.where(F.coalesce("low_a", "a") != F.coalesce("low_b", "b")).select("a", "b"))
        if rest.limit(1).count():
            new = new.unionByName(near(rest))
        self.links = new if self.links is None else self.links.unionByName(new)
        self.labels = _labels(self.links)


def _best_of_each(pairs: DataFrame) -> DataFrame:
    """For each node the pair whose signatures agree most."""
    own = pairs.select(F.col("a").alias("node"), "agree", "a", "b").unionByName(pairs.select(F.col("b").alias("node"), "agree", "a", "b"))
    return own.groupBy("node").agg(F.max(F.struct("agree", "a", "b")).alias("top")).select("top.a", "top.b").distinct()


def _divided(docs: DataFrame, crowd: DataFrame, nodes: DataFrame, width: int, least: int) -> DataFrame:
    """band, node, n, at, degree: narrower bands for the members of crowded ones (band, node, n, degree, lead, lowest: a node for each band, and its smallest set).

    A set's hashes are put in an order that is the same for all members of a band: first those that the lead lacks, then the lead's and those that more than 1 / ``COMMON``
    of its members have. Two sets that are near share one of their first few hashes, as what is left after those is less than they must have in common. These hashes are the
    new bands; ``at`` is how many hashes stand before it. Edited copies of the lead's text so meet by their edits, not by what all copies have. Any lead gives right bands."""

    def lacking(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lead, own, other in zip(*(b.column(c) for c in ("lead", "own", "own_lead"))):
                x, p = (np.frombuffer(v.as_buffer(), np.uint64) for v in (own, other))
                rest = x[~np.isin(x, p, assume_unique=True)]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rest), lead.as_py(), np.int64)), pa.array(rest.view(np.int64))], names=["lead", "hash"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for node, n, degree, lead, lowest, own, other, more in zip(*(b.column(c) for c in ("node", "n", "degree", "lead", "lowest", "own", "own_lead", "more"))):
                x, p = (np.frombuffer(v.as_buffer(), np.uint64) for v in (own, other))
                if more.is_valid:
                    p = np.concatenate([p, np.array(more.as_py(), np.int64).view(np.uint64)])
                shared = np.isin(x, p)
                size = len(x)
                smallest = max(lowest.as_py(), -(-least * size // 100))
                first = np.concatenate([x[~shared], x[shared]])[: size + least * (size + smallest) // -(100 + least) + 1]
                band = mix(first * _A + mix(np.array([lead.as_py()], np.int64).view(np.uint64)))
                same = lambda v, k=len(first): pa.array(np.full(k, v.as_py(), np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(band.view(np.int64)), same(node), same(n), pa.array(np.arange(len(first))), same(degree)], names=["band", "node", "n", "at", "degree"])

    led = settle(crowd.groupBy("node", "lead").agg(F.first("n").alias("n"), F.first("degree").alias("degree"), F.min("lowest").alias("lowest")))
    wanted = led.select("node").union(led.select("lead")).distinct()
    sets = settle(_full_sets(docs, settle(nodes.join(wanted, "node").select("node", "seen", "digest")), width))
    both = led.join(sets, "node").join(sets.select(F.col("node").alias("lead"), F.col("own").alias("own_lead")), "lead")
    met = led.groupBy("lead").agg(F.count(F.lit(1)).alias("met"))
    often = both.select("lead", "own", "own_lead").mapInArrow(lacking, "lead long, hash long").groupBy("lead", "hash").agg(F.count(F.lit(1)).alias("c"))
    common = settle(often.join(met, "lead").where(F.col("c") * COMMON > F.col("met")).groupBy("lead").agg(F.collect_list("hash").alias("more")))  # less than COMMON sets' hashes for each lead
    return both.join(common, "lead", "left").select("node", "n", "degree", "lead", "lowest", "own", "own_lead", "more").mapInArrow(run, "band long, node long, n long, at long, degree long")


def _components(docs: DataFrame, nodes: DataFrame, width: int, least: int) -> DataFrame | None:
    """node, root for the nodes (distinct sets) that links join; None without any link.

    Nodes meet in the bands that their signatures share. Within a band a few members, the pivots, are compared with all others that are not
    yet known to be in their component, and leave the band: they are done with it. A band ends when all that are left in it are in one component; else the next round takes
    ``GROWTH`` times as many pivots. So every two members of a band are compared or known to be connected, while a crowd of copies of one text, which links to
    its first pivots, costs a number of pairs in proportion to its size. The first pivot is the member with most others in its bands, so that the
    bands of a crowd have the same one. What is then left of crowded bands is divided (:func:`_divided`; a band's lead is the most connected pivot in all bands of its own pivot), and there the members outside of a band's largest component are pivots; copies that are
    too far from all others of a crowd so meet few of them. Of the pairs whose signatures agree, each node's best is verified first; pairs that become
    connected by that need no verification."""
    members = nodes.select("node", "n", F.lit(0).cast("long").alias("at"), F.explode("bands").alias("band"))
    shared = members.groupBy("band").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    members = settle(members.join(shared.hint("merge"), "band"))
    degrees = members.groupBy("node").agg(F.sum("size").alias("degree"))
    members = settle(members.join(degrees, "node").select("band", "node", "n", "at", "degree", F.lit(None).cast("long").alias("lead")))
    graph, most, tested, parted = _Graph(docs, nodes, width, least), FIRST, None, False
    # what two sets have in common at most, against what they must have
    sizes = F.least(F.col("n") - F.col("at"), F.col("p_n") - F.col("p_at")) * (100 + least) >= (F.col("n") + F.col("p_n")) * least
    while True:
        if graph.labels is None:
            named = members.withColumn("root", F.col("node"))
        else:
            named = settle(members.join(graph.labels, "node", "left").withColumn("root", F.coalesce("root", "node")))
        alive = settle(named.groupBy("band").agg(
            F.min("root").alias("low"), F.max("root").alias("high"), F.count(F.lit(1)).alias("left"), F.min("n").alias("lowest"),
            F.max(F.struct("degree", F.xxhash64("node").alias("turn"), "node")).alias("top")).where("low <> high"))
        if alive.limit(1).count() == 0:
            return None if graph.links is None else connected(graph.links, "node", "root")
        live = settle(named.join(alive.select("band", "left", "lowest", "top", F.col("top.node").alias("first")), "band"))
        crowd = live.where((F.col("left") > FEW) & F.col("lead").isNotNull())
        if not parted and crowd.limit(1).count():
            own = lambda df: df.select("band", "node", "n", "at", "degree", F.lit(None).cast("long").alias("lead"))
            members, parted, most = settle(own(_divided(docs, crowd, nodes, width, least)).unionByName(own(live.where(F.col("left") <= FEW)))), True, FIRST
            continue
        # the first, and each other one with a chance of most / left
        share = F.pmod(F.xxhash64("node"), F.lit(1 << 40)).cast("double") * F.col("left") < float((most - 1) * (1 << 40))
        chosen = (F.col("left") <= FEW) | (F.col("node") == F.col("first")) | share
        if parted:
            kin = live.groupBy("band", "root").agg(F.count(F.lit(1)).alias("kin")).groupBy("band").agg(F.max(F.struct("kin", "root")).alias("main"))
            live = settle(live.join(kin, "band").withColumn("strange", (F.col("root") != F.col("main.root")) & (F.col("left") - F.col("main.kin") <= STRANGERS)).drop("main"))
            chosen = chosen | F.col("strange")
        pivots = live.where(chosen).select("band", F.col("node").alias("p"), F.col("root").alias("p_root"), F.col("n").alias("p_n"), F.col("at").alias("p_at"))
        met = live.select("band", "node", "root", "n", "at").join(pivots, "band").where((F.col("root") != F.col("p_root")) & sizes)
        pairs = met.select(F.least("node", "p").alias("a"), F.greatest("node", "p").alias("b")).distinct()
        agreeing = _agreeing(_both_sides(pairs, nodes, "sig"))
        agreeing = settle(agreeing if tested is None else agreeing.join(tested, ["a", "b"], "left_anti"))
        if agreeing.limit(1).count():
            graph.verify(agreeing)
            tested = agreeing.select("a", "b") if tested is None else tested.unionByName(agreeing.select("a", "b"))
        members = live.where(~chosen)
        if parted:
            members = settle(members.select("band", "node", "n", "at", "degree", F.lit(None).cast("long").alias("lead")))
        else:
            leads = live.groupBy(F.col("node").alias("first")).agg(F.max("top")["node"].alias("lead"))
            members = settle(alive.select("band", F.col("top.node").alias("first")).join(leads, "first").select("band", "lead").join(members.drop("lead"), "band").select("band", "node", "n", "at", "degree", "lead"))
        most *= GROWTH


def _labelled(docs: DataFrame, width: int, least: int) -> DataFrame:
    """doc_id, tag, n, digest and ``low`` for each row of docs (doc_id, text, tag): the least row of its component as (has no id, doc_id, tag)."""
    own = settle(signatures(docs, width))
    kinds = own.where("n > 0").groupBy("digest").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("lacks"), "doc_id", "tag", "seen")).alias("low"), F.count(F.lit(1)).alias("rows"),
        F.first("n").alias("n"), F.first("sig").alias("sig"), F.first("bands").alias("bands"),  # equal in all rows of a set
    )
    nodes = settle(kinds.select(F.col("low.tag").alias("node"), "digest", "n", "rows", "sig", "bands", F.col("low.seen").alias("seen"), F.struct("low.lacks", "low.doc_id", "low.tag").alias("low")))
    roots = _components(docs, nodes, width, least)
    named = nodes.select("node", "digest", "rows", "low")
    if roots is not None:
        joined = settle(named.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")))
        least_of = settle(joined.groupBy("root").agg(F.min("low").alias("least"), F.count(F.lit(1)).alias("members")))
        named = keyed_join(joined, least_of, "root", "members", joined.count()).select("digest", "rows", F.col("least").alias("low"))
    labels = settle(named.select("digest", "rows", "low"))
    full = settle(own.where("n > 0").select("doc_id", "tag", "n", "digest"))
    out = keyed_join(full, labels, "digest", "rows", full.count()).select("doc_id", "tag", "n", "low")
    lone = own.where("n = 0").select("doc_id", "tag", "n", F.struct(F.col("doc_id").isNull().alias("lacks"), "doc_id", "tag").alias("low"))
    return out.unionByName(lone)


def near_duplicates(docs: DataFrame, width: int = 5, least: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id for each row: documents are linked when their sets of ``width``-word shingles have a Jaccard similarity of
    ``least`` percent or more (80 to 100; the bands are made for that), and the component is named by the smallest doc_id that links reach.

    Links are confirmed on full sets (64-bit hashes of the shingles). Texts with equal sets are one node from the start. Null and blank texts
    have an empty set and are linked with nothing, null ids are never the smallest (a component of null ids only has a null id), repeated rows are
    each returned, and other columns are ignored."""
    if not 80 <= least <= 100:
        raise ValueError("the bands are made for a similarity of 80 to 100 percent")
    tagged = docs.select("doc_id", "text", F.monotonically_increasing_id().alias("tag"))
    return _labelled(tagged, width, least).select("doc_id", F.col("n").alias("n_shingles"), F.col("low.doc_id").alias("component_id"))


def deduplicate(docs: DataFrame, width: int = 5, least: int = 80) -> DataFrame:
    """``docs`` with one row of each component: that of the smallest doc_id, and of rows that share it, or of those of a component without any id,
    the first in the order of reading. Blank texts are components of their own. Rows are told apart by a tag, so ids may be null or repeated."""
    tagged = settle(docs.select(F.monotonically_increasing_id().alias("tag"), F.struct(*docs.columns).alias("row")))
    found = _labelled(tagged.select("tag", "row.doc_id", "row.text"), width, least)
    gone = settle(found.where(F.col("tag") != F.col("low.tag")).select("tag"))
    return tagged.join(gone, "tag", "left_anti").select("row.*")


def query(spark, docs: DataFrame) -> DataFrame:
    """The contract's rows, with two-word shingles: doc_id, n_shingles, component_id, kept."""
    return near_duplicates(docs, 2, 80).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))
