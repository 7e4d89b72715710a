"""Substring dedup over all documents by column-wise suffix sorting (operator 1).

A byte goes if it lies in a string of WINDOW bytes that also starts earlier. Building one Burrows-Wheeler transform of the
whole collection takes a round for each byte of its longest text, and each round passes over all text; so the collection is
split first, in such a way that equal windows always meet:

1. The smallest gram hash in a window is its anchor; equal windows have equal anchors at equal places. Windows of a text
   that share an anchor are a run, of few bytes. Runs whose anchor occurs once in the corpus hold nothing that repeats.
2. Runs of equal bytes: all but the earliest go, as a whole.
3. Different runs with one anchor share some windows, or none. Their strings, 170 bytes or fewer, are a collection that is
   sorted column-wise, from a window's last symbols to its first: each round puts some symbols of each window before what
   is sorted so far, and drops windows that are alone by then; of those that are equal in the end all but the earliest go.
   Collections are bounded; an anchor with more runs than LARGEST is split by the windows' hashes instead.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .anchors import WINDOW, runs
from .common import table, written

#: Strings of which a collection is made at least: it is built when it has so many.
COLLECTION = 512
#: Symbols of each window that a round of a collection's sort takes; WINDOW is a multiple of it, and a rank takes what they leave of 64 bits.
COLUMNS = 4
#: Strings of one anchor that a collection takes at most: 3 MB of text, and arrays of 100 MB.
LARGEST = 1 << 14
#: Blocks of 256 bits of a filter at most: 8 MB. Beyond what it holds well, more rows pass; results stay the same.
MAX_BLOCKS = 1 << 18


class Filter:
    """A blocked Bloom filter of 64-bit hashes, built in Spark, probed in numpy. Keys are hashes already, so their bits serve directly."""

    def __init__(self, keys: DataFrame, key: str):
        n = keys.count()
        self.blocks = min(MAX_BLOCKS, max(1, 1 << (n // 12).bit_length()))
        k = F.col(key)
        bit = lambda i: F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(k, 20 + 6 * i).bitwiseAND(63).cast("int"))
        words = keys.select(k.bitwiseAND(self.blocks - 1).alias("b"), *(bit(i).alias(f"w{i}") for i in range(4))).groupBy("b").agg(*(F.expr(f"bit_or(w{i})").alias(f"w{i}") for i in range(4)))
        got = words.toArrow()
        table = np.zeros((self.blocks, 4), np.uint64)
        for i in range(4):
            table[got["b"].to_numpy(), i] = got[f"w{i}"].to_numpy().view(np.uint64)
        self.sent = keys.sparkSession.sparkContext.broadcast(table)

    def __getstate__(self):
        return self.blocks, self.sent

    def __setstate__(self, state):
        self.blocks, self.sent = state

    def may_hold(self, keys: np.ndarray) -> np.ndarray:
        """For each key (uint64), false if it is certainly not one of the filter's."""
        words = self.sent.value[(keys & np.uint64(self.blocks - 1)).astype(np.int64)]
        held = np.ones(len(keys), bool)
        for i in range(4):
            held &= (words[:, i] >> ((keys >> np.uint64(20 + 6 * i)) & np.uint64(63))) & np.uint64(1) == 1
        return held


def sorted_suffixes(strings: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All suffixes of some strings in order, built column-wise: for each its string, its length, and the symbol before it (0: none), which is the transform.

    Each round prepends one symbol to the suffixes of every string: a stable sort by the new symbol keeps their order. A
    suffix that is a prefix of another comes first; equal ones come in the order of their strings.
    """
    n = len(strings)
    sizes = np.array([len(x) for x in strings], np.int32)
    width = int(sizes.max(initial=0))
    # column[j]: the symbol before the suffix of length j of each string; 0 before a whole string.
    # Byte 255 never occurs in UTF-8, so that symbols fit in a byte; where it does, they take two.
    kind = np.uint16 if any(b"\xff" in x for x in strings) else np.uint8
    column = np.zeros((width + 1, n), kind)
    for k, x in enumerate(strings):
        column[: len(x), k] = np.frombuffer(x, np.uint8)[::-1].astype(kind) + kind(1)
    flat = column.ravel()
    # A suffix is known by where its next symbol is: length * n + string.
    empty = np.arange(n, dtype=np.int32)
    now = empty
    for _ in range(width):
        before = flat[now]
        order = np.argsort(before, kind="stable")
        # Whole strings have no symbol before them and sort first; they aren't extended.
        order = order[np.count_nonzero(before == 0) :]
        now = np.concatenate((empty, now[order] + np.int32(n)))
    return now % n, now // n, flat[now]


def sorted_windows(strings: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The windows that some strings hold more than once, sorted by symbols: for each its string, its start and the rank that equal ones share.

    Suffixes are sorted by their first WINDOW symbols only (a transform of bounded context), which is all that decides. Each
    round puts the COLUMNS symbols before what is sorted so far of each window in front of its rank; a window that no other
    equals in the columns so far equals none in the end, and goes.
    """
    sizes = np.array([len(x) for x in strings], np.int64)
    held = np.maximum(sizes - (WINDOW - 1), 0)
    who = np.repeat(np.arange(len(strings)), held)
    start = np.arange(len(who)) - np.repeat(np.cumsum(held) - held, held)
    data = np.frombuffer(b"".join(strings), np.uint8)
    # COLUMNS symbols from each place on as one number, in the upper half; ranks take the lower.
    joined = np.zeros(max(0, len(data) - COLUMNS + 1), np.uint64)
    for k in range(COLUMNS):
        joined |= data[k : k + len(joined)].astype(np.uint64) << np.uint64(56 - 8 * k)
    begin = np.cumsum(sizes) - sizes
    at, left, rank = begin[who] + start, np.arange(len(who)), np.zeros(len(who), np.uint64)
    for column in range(WINDOW - COLUMNS, -1, -COLUMNS):
        key = joined[at + column] | rank
        order = np.argsort(key)
        key = key[order]
        new = np.append(True, key[1:] != key[:-1])[: len(key)]
        some = ~(new & np.append(new[1:], True)[: len(key)])
        order = order[some]
        at, left, rank = at[order], left[order], np.cumsum(new)[some].astype(np.uint64)
        if not len(at):
            break
    return who[left], start[left], rank


def repeated_windows(strings: list[bytes]) -> np.ndarray:
    """Pairs (string, start) of windows that also occur in an earlier string, or earlier in the same."""
    who, start, rank = sorted_windows(strings)
    order = np.lexsort((start, who, rank))
    again = order[1:][rank[order][1:] == rank[order][:-1]]
    return np.stack([who[again], start[again]], axis=1)


def _spans(starts: np.ndarray) -> list[tuple[int, int]]:
    """Sorted starts of windows as byte spans."""
    cut = np.flatnonzero(np.diff(starts) > 1)
    return list(zip(starts[np.concatenate(([0], cut + 1))].tolist(), (starts[np.append(cut, len(starts) - 1)] + WINDOW).tolist(), strict=True)) if len(starts) else []


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Byte spans (id, th: hash of the text, lo, hi) whose union is what goes."""
    own = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(id_col)).alias("idh"), F.xxhash64(F.col(text_col)).alias("th"), F.col(text_col).cast("binary").alias("t")).where(F.length("t") >= WINDOW)
    kind = docs.schema[id_col].dataType.simpleString()

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in runs(batch.column(0).to_pylist()):
                a, n = np.unique(r.anchor, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(n)], names=["a", "n"])

    counts = own.select("t").mapInArrow(anchors, "a bigint, n bigint").groupBy("a").agg(F.sum("n").alias("n")).where("n > 1")
    several = Filter(written(counts.select("a"), "anchors"), "a")

    def keys(anchor, h, th, idh, lo) -> np.ndarray:
        return anchor ^ h ^ th ^ idh ^ (lo.astype(np.uint64) << np.uint64(20))

    def rows(wanted: Filter | None):
        """Runs whose anchor may repeat; with `wanted`, those of its keys, with their bytes."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            import xxhash

            for batch in batches:
                th, idh = (batch.column(k).to_numpy().view(np.uint64) for k in (1, 2))
                for r in runs(batch.column(3).to_pylist()):
                    some = np.flatnonzero(several.may_hold(r.anchor))
                    found = r.strings(some)
                    h = np.fromiter(map(xxhash.xxh64_intdigest, found), np.uint64, len(found))
                    out = [pa.array(r.anchor[some].view(np.int64)), pa.array(h.view(np.int64)), batch.column(0).take(pa.array(r.text[some])), batch.column(1).take(pa.array(r.text[some])), pa.array(r.first[some]), pa.array(r.last[some])]
                    if wanted is None:
                        yield pa.RecordBatch.from_arrays(out, names=["a", "h", "id", "th", "lo", "last"])
                        continue
                    at = np.flatnonzero(wanted.may_hold(keys(r.anchor[some], h, th[r.text[some]], idh[r.text[some]], r.first[some])))
                    cols = [out[k].take(pa.array(at)) for k in (0, 2, 3, 4)]
                    yield pa.RecordBatch.from_arrays([*cols, pa.array([found[k] for k in at.tolist()], pa.binary())], names=["a", "id", "th", "lo", "s"])

        return run

    base = own.select("id", "th", "idh", "t")
    found = written(base.mapInArrow(rows(None), f"a bigint, h bigint, id {kind}, th bigint, lo bigint, last bigint"), "runs")
    place = F.struct(F.col("id").isNull().alias("late"), "id", "th", "lo")
    firsts = written(found.groupBy("a", "h").agg(F.min(place).alias("p"), F.count(F.lit(1)).alias("n")), "firsts")
    copies = found.join(firsts.where("n > 1").select("a", "h", "p"), ["a", "h"]).where(place != F.col("p")).select("id", "th", "lo", (F.col("last") + WINDOW).alias("hi"))

    mixed = firsts.groupBy("a").agg(F.count(F.lit(1)).alias("k")).where("k > 1")
    apart = firsts.join(mixed, "a").select("p.id", "p.th", "p.lo", "a", "h", F.xxhash64("p.id").alias("idh"))
    key = F.col("a").bitwiseXOR(F.col("h")).bitwiseXOR(F.col("th")).bitwiseXOR(F.col("idh")).bitwiseXOR(F.call_function("shiftleft", F.col("lo"), F.lit(20)))
    wanted = Filter(written(apart.select(key.alias("key")), "apart"), "key")
    strings = written(base.mapInArrow(rows(wanted), f"a bigint, id {kind}, th bigint, lo bigint, s binary"), "strings")
    sizes = strings.groupBy("a").agg(F.count(F.lit(1)).alias("k"))
    dealt = strings.join(sizes, "a")

    def collections(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def solved(groups) -> pa.RecordBatch:
            flat = [x for g in groups for x in g]
            got = repeated_windows([x["s"] for x in flat])
            got = got[np.lexsort((got[:, 1], got[:, 0]))]
            ids, ths, los, his = [], [], [], []
            cut = np.flatnonzero(np.diff(got[:, 0])) + 1
            for part in np.split(got, cut) if len(got) else []:
                x = flat[part[0, 0]]
                for lo, hi in _spans(part[:, 1]):
                    ids.append(x["id"])
                    ths.append(x["th"])
                    los.append(x["lo"] + lo)
                    his.append(x["lo"] + hi)
            return pa.RecordBatch.from_arrays([pa.array(ids, id_type), pa.array(ths, pa.int64()), pa.array(los, pa.int64()), pa.array(his, pa.int64())], names=["id", "th", "lo", "hi"])

        id_type, groups, n = None, [], 0
        for batch in batches:
            id_type = batch.schema.field(0).type.value_type.field("id").type
            for g in batch.column(0).to_pylist():
                # Rows that share id and text are one document: what they bring is in order, side by side, and counts once.
                g = [x for k, x in enumerate(g) if not k or any(x[c] != g[k - 1][c] for c in ("id", "th", "lo"))]
                groups.append(g)
                n += len(g)
                if n >= COLLECTION:
                    yield solved(groups)
                    groups, n = [], 0
        if groups:
            yield solved(groups)

    # Windows of different anchors differ, so that several anchors' strings may share a collection.
    small = dealt.where((F.col("k") > 1) & (F.col("k") <= LARGEST)).groupBy("a").agg(F.array_sort(F.collect_list(F.struct(F.col("id").isNull().alias("late"), "id", "th", "lo", "s"))).alias("g")).select("g")
    shared = small.mapInArrow(collections, f"id {kind}, th bigint, lo bigint, hi bigint")

    window = F.explode(F.sequence(F.lit(0), F.length("s") - WINDOW)).alias("o")
    each = dealt.where(F.col("k") > LARGEST).select("a", "id", "th", "lo", "s", window).select("a", "id", "th", (F.col("lo") + F.col("o")).alias("lo"), F.xxhash64(F.expr(f"substring(s, o + 1, {WINDOW})")).alias("w"))
    earliest = each.groupBy("a", "w").agg(F.min(place).alias("p"), F.count(F.lit(1)).alias("n")).where("n > 1").select("a", "w", "p")
    hot = each.join(earliest, ["a", "w"]).where(place != F.col("p")).select("id", "th", "lo", (F.col("lo") + WINDOW).alias("hi"))
    return copies.unionByName(shared).unionByName(hot)


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of `docs`: id, n_bytes, n_removed, n_spans (maximal removed runs), kept (the remaining bytes, joined).

    Texts are whole, as UTF-8 bytes; null is empty. Earlier: the smaller id (null ids last), of rows with one id the smaller
    hash of the text, then the earlier start. Rows that share id and text are one document, with one result. Matches never
    cross documents. Other columns aren't read; an empty table gives an empty table.
    """
    spans = repeated_spans(docs, id_col, text_col).groupBy("id", "th").agg(F.sort_array(F.collect_set(F.struct("lo", "hi"))).alias("spans"))
    gone = written(spans.select(F.xxhash64("id", "th").alias("_key"), "spans"), "spans")
    own = docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("t"), F.xxhash64(F.col(id_col), F.xxhash64(F.col(text_col))).alias("_key"))
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, removed, runs_, kept = [], [], [], []
            for text, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                parts, at, n = [], 0, 0
                for x in spans or ():
                    # Spans come by their start; those that touch are one.
                    if x["lo"] > at or not n:
                        parts.append(text[at : x["lo"]])
                        n += 1
                    at = max(at, x["hi"])
                parts.append(text[at:])
                kept.append(b"".join(parts))
                sizes.append(len(text))
                removed.append(len(text) - len(kept[-1]))
                runs_.append(n)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(runs_, pa.int64()), pa.array(kept, pa.binary())], names=[id_col, "n_bytes", "n_removed", "n_spans", "kept"])

    both = own.join(gone, "_key", "left").select(id_col, "t", "spans")
    return both.mapInArrow(run, f"`{id_col}` {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary")


def op1_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_substrings(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


QUERIES = {"op1_substrings": op1_substrings}
