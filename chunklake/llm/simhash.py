"""SimHash near-duplicates by generalised pigeonhole (operator 5).

The 64 fingerprint bits are split into groups of correlated bits. A pair within r bits is within t_i bits in some group i
if the t_i + 1 add up to r + 1 (Qin et al. 2018). Dynamic programming chooses unequal t_i, with as many groups as are
cheapest, by the candidates expected of each. Fingerprints meet in buckets (group, value), or (group, value with up to
t_i bits flipped); pairs in a bucket are verified on all 64 bits.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import positional, restored, table, written
from .components import components

BITS = 64
#: Two fingerprints are linked at so many differing bits, or fewer.
RADIUS = 2
#: Words in a shingle.
WORDS = 3
SEED = 42
#: A bucket up to this size is verified pair by pair in one task; larger ones go another, exact way.
BUCKET = 1024
#: Shingles that are counted at once.
BLOCK = 1 << 16


def fingerprint(text: str | None) -> int:
    """The SimHash of a text: a bit is 1 if it is set in over half the XXH64 of the shingles, repeats included. Fewer words than a shingle: the whole sequence is one. No word: 0."""
    import xxhash

    words = (text or "").encode().lower().split()
    if not words:
        return 0
    whole = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    first = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - WORDS + 1)
    first, last = first[:n].tolist(), ends[min(WORDS, len(words)) - 1 :].tolist()
    digest = xxhash.xxh64_digest
    total = np.zeros(BITS, np.int64)
    for k in range(0, n, BLOCK):
        raw = b"".join([digest(whole[a:b], SEED) for a, b in zip(first[k : k + BLOCK], last[k : k + BLOCK], strict=True)])
        total += np.unpackbits(np.frombuffer(raw, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * total > n).tobytes(), "big")


def with_fingerprints(docs: DataFrame, text_col: str = "text", name: str = "fingerprint") -> DataFrame:
    """`docs` and a column of fingerprints (long; the sign bit is bit 63). No shuffle."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = np.array([fingerprint(x) for x in batch.column(at).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, pa.int64())], names=[*batch.schema.names, name])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(run, f"{kinds}, {name} bigint")


def bit_counts(fps: DataFrame) -> np.ndarray:
    """64 x 64: how many fingerprints have both bits; the driver gets these 4096 sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((BITS, BITS))
        for batch in batches:
            raw = batch.column(0).to_numpy(zero_copy_only=False).astype(">i8").view(np.uint8).reshape(-1, 8)
            bits = np.unpackbits(raw, axis=1)[:, ::-1].astype(np.float32)
            total += bits.T @ bits
        i, j = np.indices(total.shape)
        yield pa.RecordBatch.from_arrays([pa.array((i * BITS + j).ravel(), pa.int32()), pa.array(total.ravel().astype(np.int64))], names=["cell", "n"])

    out = np.zeros(BITS * BITS)
    for cell, n in fps.select("fp").mapInArrow(run, "cell int, n bigint").groupBy("cell").agg(F.sum("n")).collect():
        out[cell] = n
    return out.reshape(BITS, BITS)


def grouped(counts: np.ndarray, n: int, m: int) -> list[list[int]]:
    """m groups of nearly as many bits each. Each begins with the strongest correlated pair that is left and takes the bit that goes best with it, again and again."""
    p = np.diag(counts) / max(n, 1)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-9))
    tie = np.abs((counts / max(n, 1) - np.outer(p, p)) / np.outer(spread, spread))
    np.fill_diagonal(tie, -1)
    left, out = set(range(BITS)), []
    for g in range(m):
        size = len(left) // (m - g)
        rest = sorted(left)
        a = rest[int(np.argmax(tie[np.ix_(rest, rest)].max(axis=1)))]
        group = [a]
        left.discard(a)
        while len(group) < size:
            rest = sorted(left)
            group.append(rest[int(np.argmax(tie[np.ix_(rest, group)].mean(axis=1)))])
            left.discard(group[-1])
        out.append(sorted(group))
    return out


def expected(group: list[int], p: np.ndarray, n: int, t: int) -> float:
    """Work for a group with threshold t: signatures, and the pairs expected within t bits in it."""
    if t < 0:
        return 0.0
    within = np.zeros(t + 2)
    within[0] = 1
    for b in group:
        d = 2 * p[b] * (1 - p[b])
        within[1:] = within[1:] * (1 - d) + within[:-1] * d
        within[0] *= 1 - d
    return n * sum(math.comb(len(group), k) for k in range(t + 1)) + n * n / 2 * within[: t + 1].sum()


def plan(counts: np.ndarray, n: int, radius: int = RADIUS) -> list[tuple[list[int], int]]:
    """The groups that are probed, each with its threshold: the cheapest of all m and all allocations."""
    p = np.diag(counts) / max(n, 1)
    best, chosen = math.inf, []
    for m in range(1, radius + 4):
        groups = grouped(counts, n, m)
        # cost[s]: of the groups so far, the least work whose t + 1 add up to s.
        cost: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
        for group in groups:
            new: dict[int, tuple[float, list[int]]] = {}
            for s, (c, ts) in cost.items():
                for t in range(-1, radius + 1):
                    to, work = min(radius + 1, s + t + 1), c + expected(group, p, n, t)
                    if to not in new or work < new[to][0]:
                        new[to] = work, [*ts, t]
            cost = new
        if cost[radius + 1][0] < best:
            best, chosen = cost[radius + 1][0], [(g, t) for g, t in zip(groups, cost[radius + 1][1], strict=True) if t >= 0]
    return chosen


def local_roots(fps: np.ndarray, radius: int) -> np.ndarray:
    """For each of some distinct fingerprints, the smallest one that it reaches by links among them."""
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= radius
    label = np.arange(len(fps))
    while True:
        new = np.where(near, label[None, :], len(fps)).min(axis=1)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def links(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Edges (u, v) of distinct fingerprints `fp` that connect just what links of at most `radius` bits connect."""
    n = fps.count()
    if n < 2:
        return fps.select(F.col("fp").alias("u"), F.col("fp").alias("v")).limit(0)
    chosen = plan(bit_counts(fps), n, radius)

    def mask(bits) -> int:
        x = sum(1 << b for b in bits)
        return x - (1 << 64) if x >> 63 else x

    signs = []
    for g, (group, t) in enumerate(chosen):
        value = F.col("fp").bitwiseAND(F.lit(mask(group)))
        flips = [mask(c) for k in range(t + 1) for c in combinations(group, k)]
        keys = F.explode(F.transform(F.lit(flips).cast("array<bigint>"), lambda x, v=value: v.bitwiseXOR(x))) if t else value
        signs.append(fps.select(F.lit(g).alias("g"), keys.alias("key"), "fp"))
    rows = signs[0]
    for x in signs[1:]:
        rows = rows.unionByName(x)
    # Whoever shares a bucket may be a pair. Buckets of one row are gone before any list is made.
    sizes = rows.groupBy("g", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    met = written(rows.join(sizes, ["g", "key"]), "buckets")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            us, vs = [], []
            for x in batch.column(0):
                own = np.unique(np.array(x.as_py(), np.int64))
                root = local_roots(own.view(np.uint64), radius)
                apart = root != np.arange(len(own))
                us.append(own[apart])
                vs.append(own[root[apart]])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(us or [np.zeros(0, np.int64)])), pa.array(np.concatenate(vs or [np.zeros(0, np.int64)]))], names=["u", "v"])

    small = met.where(F.col("n") <= BUCKET).groupBy("g", "key").agg(F.collect_list("fp").alias("fps")).select("fps").mapInArrow(run, "u bigint, v bigint")
    # Exact for large buckets, in time linear in their rows: two fingerprints are within 2 bits if and only if flipping one
    # bit or none in each can make them equal, and all that share such a key are within 2 bits of each other. A key is
    # shared by 65 fingerprints at most.
    if radius != 2:
        raise ValueError("large buckets are handled for a radius of 2")
    one = [0, *(mask([b]) for b in range(BITS))]
    hot = met.where(F.col("n") > BUCKET).select("fp").distinct()
    shared = hot.select("fp", F.explode(F.transform(F.lit(one).cast("array<bigint>"), lambda x: F.col("fp").bitwiseXOR(x))).alias("key")).groupBy("key").agg(F.min("fp").alias("v"), F.collect_set("fp").alias("us"))
    large = shared.where(F.size("us") > 1).select(F.explode("us").alias("u"), "v")
    return small.unionByName(large).where("u <> v")


def classes(prints: DataFrame, id_col: str = "doc_id", name: str = "fingerprint", linked: Callable[[DataFrame], DataFrame] = links) -> DataFrame:
    """For each distinct fingerprint (or other number `name` of which `linked` gives edges): it, first_id and component_id (the smallest id with it, and of all that links reach), n (its rows). Null ids are passed over; where there is no other, null."""
    reps = written(prints.groupBy(F.col(name).alias("fp")).agg(F.min(id_col).alias("first_id"), F.count(F.lit(1)).alias("n")), "prints")
    roots = written(components(linked(reps)), "roots")
    of = reps.join(roots, reps["fp"] == roots["node"]).groupBy("root").agg(F.min("first_id").alias("of_all"))
    low = roots.join(of, "root").select(F.col("node").alias("fp"), "of_all")
    return reps.join(low, "fp", "left").select(F.col("fp").alias(name), "first_id", F.coalesce("of_all", "first_id").alias("component_id"), "n")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of `docs`: id, fingerprint (long), component_id (the smallest id that links reach).

    Null and empty texts, and texts of white space, have fingerprint 0 and are linked like any other; texts of fewer
    words than a shingle are one shingle. Rows that are equal, or share an id, are rows like any other. Null ids: see
    classes(). An empty table gives an empty table; other columns aren't read.
    """
    prints = written(with_fingerprints(docs.select(F.col(id_col), F.col(text_col)), text_col).drop(text_col), "fingerprints")
    return prints.join(classes(prints, id_col).select("fingerprint", "component_id"), "fingerprint").select(id_col, "fingerprint", "component_id")


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` without all but one document of each group that links of fingerprints connect: that of the smallest id stays (rows with null ids only where no other of the group has an id).

    Rows that share an id and are of one group stay or go together; of null, empty and equal texts see near_duplicates().
    Other columns stay as they are, whatever their names; an empty table gives an empty table. nearcopies.near_dedup()
    links by similarity instead.
    """
    rows = positional(docs, id=F.col(f"`{id_col}`"), text=F.col(f"`{text_col}`"))
    prints = written(with_fingerprints(rows.select("id", "text"), "text").drop("text"), "fingerprints")
    of = classes(prints, "id").select("fingerprint", "component_id")
    kept = with_fingerprints(rows, "text").join(of, "fingerprint").where(F.col("id").eqNullSafe(F.col("component_id")))
    return restored(kept, docs.columns)


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


QUERIES = {"op5_simhash": op5_simhash}
