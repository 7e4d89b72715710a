"""Operator 5 at a Jaccard similarity: the pipeline's near-duplicate stage.

Two texts are linked if the Jaccard similarity of their sets of five-word shingles is 0.8 or more. SimHash alone can't find
that: at 0.8, two fingerprints differ in 9.7 of 64 bits on average, and no radius that a pigeonhole can probe reaches all
such pairs. So fingerprints group what is nearly equal (generalised pigeonhole, simhash.links), each group's members are
verified against its first, and so is each set against the first one that shares most of its prefix; what is linked by then
is one class. Pairs of different classes come from the sets, without a gap. A set's prefix is its 0.3 n smallest hashes (n:
its size) and one more. Of two similar sets, the one whose prefix ends first has all but 1/9 of both sizes' sum, less the
other's surplus, in the other's prefix; that is a tenth of its own size at least, so that sets made up of shingles of their
own are out before anything meets. Where many of the sets that are left share a hash, these sets are ordered anew: any order
that all sets have in common gives prefixes, and one by how often hashes occur keeps a passage that many texts hold out of
them. All candidates are verified on whole sets.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, positional, restored, same_key, text_key, written
from .components import components
from .simhash import SEED, links
from .suffixes import Filter
from .urls import blocked_bloom, filter_blocks, mark, may_contain

#: Words in a shingle.
WORDS = 5
SIMILAR_PCT = 80
#: Parts of the prefixes that meet one after the other, so that shuffles take less disk at a time.
PARTS = 4
#: Sets that share a hash from which on it comes later in the order; each further level takes so many times more.
OFTEN = 16


def _prefix(n, pct: int):
    """Hashes in the prefix of a set of n: 0.3 n and one more, for 80 percent."""
    return 3 * n * (100 - pct) // 200 + 1


def shingles(text: str | None) -> np.ndarray:
    """The distinct XXH64 of a text's shingles, sorted. Fewer words than a shingle: the whole sequence is one. No word: none."""
    import xxhash

    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    whole = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    n = max(1, len(words) - WORDS + 1)
    first, last = np.concatenate(([0], ends[:-1] + 1))[:n].tolist(), ends[min(WORDS, len(words)) - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(whole[a:b], SEED) for a, b in zip(first, last, strict=True)), np.uint64, n))


def _lists(parts: list[np.ndarray]) -> pa.Array:
    """Arrays of hashes as lists of longs, without the lowest bit, so that they are positive and keep their order."""
    at = np.concatenate(([0], np.cumsum([len(x) for x in parts])))
    flat = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
    return pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array((flat >> np.uint64(1)).view(np.int64)))


def _fingerprint(h: np.ndarray) -> int:
    bits = np.unpackbits(h.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * bits > len(h)).tobytes(), "big", signed=True)


def with_sets(docs: DataFrame, pct: int) -> DataFrame:
    """Of (id, text): id, th (the text's key), key (128 bits of its set), n (the set's size), fp (its SimHash), head (the prefix of its hashes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            sets = [shingles(x) for x in batch.column(2).to_pylist()]
            heads = [x[: _prefix(len(x), pct)] for x in sets]
            cols = [pa.array([xxhash.xxh3_128_digest(x.tobytes()) for x in sets], pa.binary()), pa.array([len(x) for x in sets], pa.int64()), pa.array([_fingerprint(x) if len(x) else 0 for x in sets], pa.int64()), _lists(heads)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *cols], names=["id", "th", "key", "n", "fp", "head"])

    kind = docs.schema["id"].dataType.simpleString()
    return docs.select("id", text_key(F.col("text")).alias("th"), "text").mapInArrow(run, f"id {kind}, th struct<a:bigint,b:bigint>, key binary, n bigint, fp bigint, head array<bigint>")


def _whole(docs: DataFrame) -> DataFrame:
    """Of (r, text): r, grams (the whole set)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), _lists([shingles(x) for x in batch.column(1).to_pylist()])], names=["r", "grams"])

    return docs.select("r", "text").mapInArrow(run, "r bigint, grams array<bigint>")


def _named(docs: DataFrame, named: DataFrame) -> DataFrame:
    """Of (r, id, th), one row for each set: r, grams. Only those texts are read again, found by a filter of bounded size."""
    blocks = filter_blocks(named.count())
    bloom = written(blocked_bloom(named.select(F.xxhash64("id", "th").alias("key")), "key", blocks), "bloom")
    keyed = docs.select("id", text_key(F.col("text")).alias("th"), "text")
    some = may_contain(keyed.withColumn("key", F.xxhash64("id", "th")), "key", bloom, blocks)
    texts = some.join(named, same_key(some, named, "id", "th")).select("r", "text").dropDuplicates(["r"])
    out = written(_whole(texts), "whole")
    discard(bloom)
    return out


def verified(docs: DataFrame, sets: DataFrame, pairs: DataFrame, pct: int) -> DataFrame:
    """The pairs (u, v) of numbers of sets that are similar."""
    left = written(pairs.select("u", "v"), "candidates")
    named = written(left.select(F.explode(F.array("u", "v")).alias("r")).distinct().join(sets.select("r", "p.id", "p.th"), "r"), "named")
    whole = _named(docs, named)
    common = F.size(F.array_intersect("a", "b"))
    met = left.join(whole.select(F.col("r").alias("u"), F.col("grams").alias("a")), "u").join(whole.select(F.col("r").alias("v"), F.col("grams").alias("b")), "v")
    out = written(met.where(100 * common >= pct * (F.size("a") + F.size("b") - common)).select("u", "v"), "linked")
    for t in (named, whole, left):
        discard(t)
    return out


def _labelled(sets: DataFrame, edges: DataFrame) -> DataFrame:
    """`sets` and label: the smallest number that edges reach."""
    roots = components(edges).select(F.col("node").alias("r"), F.col("root").alias("to"))
    return sets.join(roots, "r", "left").withColumn("label", F.coalesce("to", "r")).drop("to")


def _enough(pct: int) -> Column:
    """Whether so many of a set's prefix (`count` of `n`) are shared that it may be similar to another."""
    return 200 * F.col("count") >= (100 - pct) * F.col("n")


def _shared(sets: DataFrame, pct: int) -> DataFrame:
    """Rows (h, r, n) of the prefixes' hashes that several sets have, of sets that share enough."""
    parts = []
    for k in range(PARTS):
        rows = sets.select("r", "n", F.explode("head").alias("h")).where(F.pmod("h", F.lit(PARTS)) == k)
        several = rows.groupBy("h").agg(F.min("r").alias("a"), F.max("r").alias("b")).where("a <> b").select("h")
        parts.append(written(rows.join(several, "h"), "shared"))
    every = reduce(DataFrame.unionByName, parts)
    out = written(every.join(every.groupBy("r", "n").count().where(_enough(pct)).select("r"), "r"), "postings")
    for t in parts:
        discard(t)
    return out


def _by_frequency(whole: DataFrame, pct: int) -> DataFrame:
    """Of (r, grams): r, n, head (the prefix in an order in which hashes that more of these sets have come later).

    Levels are filters of bounded size: where one takes a hash for another, it does so in every set, so that the order is still one."""
    parts = [written(whole.select(F.explode("grams").alias("h")).where(F.pmod("h", F.lit(PARTS)) == k).groupBy("h").count().where(F.col("count") >= OFTEN), "often") for k in range(PARTS)]
    often, levels, least = reduce(DataFrame.unionByName, parts), [], OFTEN
    while not (some := often.where(F.col("count") >= least)).isEmpty():
        levels.append(Filter(some.select("h"), "h"))
        least *= OFTEN
    for t in parts:
        discard(t)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.diff(batch.column(1).offsets.to_numpy())
            h = batch.column(1).flatten().to_numpy()
            level = sum((x.may_hold(h.view(np.uint64)).astype(np.int8) for x in levels), np.zeros(len(h), np.int8))
            # Sets stay one after the other, each in the new order; then what lies in its prefix stays.
            owner = np.repeat(np.arange(len(sizes)), sizes)
            order = np.lexsort((h, level, owner))
            heads = np.minimum(sizes, _prefix(sizes.astype(np.int64), pct))
            inside = np.arange(len(h)) - np.repeat(np.cumsum(sizes) - sizes, sizes) < np.repeat(heads, sizes)
            at = np.concatenate(([0], np.cumsum(heads)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(h[order][inside]))], names=["r", "n", "head"])

    return whole.mapInArrow(run, "r bigint, n bigint, head array<bigint>")


def _postings(docs: DataFrame, sets: DataFrame, pct: int) -> DataFrame:
    """_shared() of the sets' prefixes, by hash; if some hash is in many of them, then of those sets' prefixes by frequency. Other sets are similar to none."""
    rows = _shared(sets, pct)
    if rows.groupBy("h").count().where(F.col("count") >= OFTEN).isEmpty():
        return rows
    named = written(rows.select("r").distinct().join(sets.select("r", "p.id", "p.th"), "r"), "named")
    whole = _named(docs, named)
    heads = written(_by_frequency(whole, pct), "heads")
    out = _shared(heads, pct)
    for t in (rows, named, whole, heads):
        discard(t)
    return out


def _led(rows: DataFrame, pct: int) -> DataFrame:
    """Pairs (u, v): each set and, of the first ones that have some hash of its prefix, the one that has most."""
    firsts = rows.groupBy("h").agg(F.min("r").alias("v"))
    met = rows.join(firsts, "h").where("r <> v").groupBy("r", "n", "v").count().where(_enough(pct))
    return met.groupBy(F.col("r").alias("u")).agg(F.max_by("v", F.struct("count", -F.col("v"))).alias("v"))


def _apart(rows: DataFrame, pct: int) -> DataFrame:
    """Pairs (u, v) of sets of different labels that share as many hashes of their prefixes as similar sets do. Hashes that one label alone has are left out before anything meets."""
    several = rows.groupBy("h").agg(F.min("label").alias("a"), F.max("label").alias("b")).where("a <> b").select("h")
    rows = rows.join(several, "h")
    # Two sets share no more than either has left.
    rows = rows.join(rows.groupBy("r", "n").count().where(_enough(pct)).select("r", F.col("count").alias("m")), "r")
    u, v = (rows.select("h", *(F.col(c).alias(f"{k}{c}") for c in ("r", "n", "label", "m"))) for k in "uv")
    shorter = (F.col("un") < F.col("vn")) | ((F.col("un") == F.col("vn")) & (F.col("ur") < F.col("vr")))
    size = lambda c: F.call_function("div", 3 * F.col(c) * (100 - pct), F.lit(200).cast("bigint")) + 1
    least = (100 + pct) * F.least(size("un") - F.col("un"), size("vn") - F.col("vn")) + pct * (F.col("un") + F.col("vn"))
    may = shorter & (100 * F.col("un") >= pct * F.col("vn")) & ((100 + pct) * F.least("um", "vm") >= least)
    met = u.join(v, (u["h"] == v["h"]) & (F.col("ulabel") != F.col("vlabel")) & may).groupBy("ur", "un", "vr", "vn").count()
    return met.where((100 + pct) * F.col("count") >= least).select(F.col("ur").alias("u"), F.col("vr").alias("v"))


def near_dedup(docs: DataFrame, pct: int = SIMILAR_PCT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` without all but one document of each group that links connect: that of the smallest id stays (rows with null ids only where no other of the group has an id).

    Null and empty texts, and texts of white space, have no shingle and are copies of each other. Equal sets are known by 128
    bits of hash, others are compared whole, by 63 bits of each shingle's hash. Rows that share an id and are of one group
    stay or go together. Other columns stay as they are, whatever their names; an empty table gives an empty table. Rows
    that stay don't move, but for those that a filter can't tell from others.
    """
    own = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    sets = written(with_sets(own, pct), "sets")
    place = F.struct(F.col("id").isNull().alias("last"), "id", "th")
    reps = sets.groupBy("key").agg(F.min(place).alias("p"), F.min("id").alias("first_id"), *(F.first(c).alias(c) for c in ("n", "fp", "head")))
    reps = written(reps.withColumn("r", F.monotonically_increasing_id()), "reps")
    slim = written(sets.select("id", "th", "key"), "slim")
    discard(sets)
    full = reps.where("n > 0")

    near = written(components(links(full.select("fp").distinct())), "near")
    grouped = full.select("r", "fp").join(near.select(F.col("node").alias("fp"), "root"), "fp", "left").select("r", F.coalesce("root", "fp").alias("root"))
    firsts = grouped.groupBy("root").agg(F.min("r").alias("v"))
    edges = verified(own, full, grouped.join(firsts, "root").where("r <> v").select(F.col("r").alias("u"), "v"), pct)
    rows = _postings(own, full, pct)
    edges = edges.unionByName(verified(own, full, _led(rows, pct), pct))
    edges = edges.unionByName(verified(own, full, _apart(_labelled(rows, edges), pct), pct))

    grouped = _labelled(reps.select("r", "key", "first_id"), edges)
    least = grouped.groupBy("label").agg(F.min("first_id").alias("keep"))
    keep = grouped.join(least, "label").select("key", "keep")
    gone = written(slim.join(keep, "key").where(~F.col("id").eqNullSafe(F.col("keep"))).select("id", "th").distinct(), "gone")
    blocks = filter_blocks(gone.count())
    bloom = written(blocked_bloom(gone.select(F.xxhash64("id", "th").alias("key")), "key", blocks), "bloom")
    rows = positional(docs, id=F.col(f"`{id_col}`"), th=text_key(F.col(f"`{text_col}`")))
    marked = mark(rows.withColumn("key", F.xxhash64("id", "th")), "key", bloom, blocks)
    some = marked.where("may")
    return restored(marked.where("not may").unionByName(some.join(gone, same_key(some, gone, "id", "th"), "left_anti")), docs.columns)
