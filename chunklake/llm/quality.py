"""Quality rules by suffix-array repetition (operator 6).

A suffix array of the words of many texts at once (prefix doubling; words of different texts never compare equal) gives,
by longest common prefixes of neighbours, for each word the longest run that starts there and occurs elsewhere in the same
text: the maximal repeats. Their spans are united; a text whose covered share or longest repeat is too large is rejected.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: Characters that count as symbols. Fixed values.
SYMBOLS = "#*$%&|<>"
#: Words of which one suffix array is made at least (a longer text makes a larger one).
WORDS_AT_ONCE = 300_000


@dataclass(frozen=True)
class Limits:
    """Production limits. A text fails if it has under `min_words` words, over `repeat_words_pct` percent of its words in repeated 3-word windows, or repeats of `repeat_len` words or more that cover over `max_covered` of its words, or one repeat, its places apart from each other, over `max_longest` of its words. Both lie well below what the 3-word windows imply."""

    min_words: int = 50
    repeat_words_pct: int = 50
    repeat_len: int = 10
    max_covered: float = 0.25
    max_longest: float = 0.15


class Repeats:
    """Suffix array and longest common prefixes over the words of several texts. `words`: their numbers, text after text; `ends`: for each word, where its text ends."""

    def __init__(self, words: np.ndarray, ends: np.ndarray):
        n = len(words)
        key = ends.astype(np.int64) * (int(words.max(initial=0)) + 1) + words
        rank, count = self._dense(key)
        levels = [rank.astype(np.int32)]
        active = np.flatnonzero(count > 1)
        step = 1
        while len(active):
            after = active + step
            inside = after < ends[active]
            follow = np.where(inside, rank[np.minimum(after, n - 1)] + 1, 0)
            key = rank[active] * (n + 1) + follow
            order = np.argsort(key)
            key = key[order]
            new = np.empty(len(key), bool)
            new[0] = True
            np.not_equal(key[1:], key[:-1], out=new[1:])
            starts = np.flatnonzero(new)
            size = np.diff(np.append(starts, len(key)))
            # A rank is the place of a class's first suffix: that of the old class and what sorts before within it.
            old = key // (n + 1)
            first = np.concatenate(([0], np.flatnonzero(old[1:] != old[:-1]) + 1))
            base = np.repeat(first, np.diff(np.append(first, len(key))))
            at = np.repeat(starts, size)
            rank = rank.copy()
            rank[active[order]] = old + at - base
            levels.append(rank.astype(np.int32))
            active = active[order[np.repeat(size, size) > 1]]
            step *= 2
        order = np.empty(n, np.int64)
        order[rank] = np.arange(n)
        #: longest[i]: of the runs that start at word i and occur elsewhere in its text, the length of the longest.
        self.longest = np.zeros(n, np.int32)
        a, b = order[:-1], order[1:]
        same = levels[0][a] == levels[0][b]
        a, b = a[same], b[same]
        common = np.zeros(len(a), np.int64)
        for k in range(len(levels) - 1, -1, -1):
            x, y = a + common, b + common
            fits = (x < ends[a]) & (y < ends[b])
            x, y = np.minimum(x, n - 1), np.minimum(y, n - 1)
            common += (fits & (levels[k][x] == levels[k][y])).astype(np.int64) << k
        np.maximum.at(self.longest, a, common)
        np.maximum.at(self.longest, b, common)
        self.order = order
        #: next_common[k]: how many words the suffixes at places k - 1 and k of the order have in common.
        self.next_common = np.zeros(n, np.int64)
        self.next_common[1:][same] = common

    @staticmethod
    def _dense(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each key: how many are smaller, and how many are equal."""
        order = np.argsort(key, kind="stable")
        by = key[order]
        starts = np.flatnonzero(np.concatenate((np.ones(min(1, len(by)), bool), by[1:] != by[:-1])))
        size = np.diff(np.append(starts, len(by)))
        rank, count = np.empty(len(by), np.int64), np.empty(len(by), np.int64)
        rank[order], count[order] = np.repeat(starts, size), np.repeat(size, size)
        return rank, count

    def covered(self, least: int, first: np.ndarray) -> np.ndarray:
        """For each text (`first`: where it starts), how many of its words lie in a repeat of `least` words or more."""
        reach = np.where(self.longest >= least, np.arange(len(self.longest)) + self.longest, 0)
        inside = np.maximum.accumulate(reach) > np.arange(len(reach))
        return np.add.reduceat(inside.astype(np.int64), first) if len(first) else np.zeros(0, np.int64)

    def apart(self, first: np.ndarray) -> np.ndarray:
        """For each text, the most words of a run that occurs at two places that don't overlap: by halving, for all texts at once."""
        n = len(self.order)
        low = np.zeros(len(first), np.int64)
        # Texts come one after the other in the order of suffixes too.
        high = np.minimum(np.maximum.reduceat(self.longest, first), np.diff(np.append(first, n)) // 2).astype(np.int64)
        text = np.repeat(np.arange(len(first)), np.diff(np.append(first, n)))
        while (low < high).any():
            middle = (low + high + 1) // 2
            new = self.next_common < middle[text]
            new[first] = True
            starts = np.flatnonzero(new)
            wide = np.maximum.reduceat(self.order, starts) - np.minimum.reduceat(self.order, starts)
            fits = np.zeros(len(first), bool)
            fits[text[starts[wide >= middle[text[starts]]]]] = True
            fits |= low == high
            low, high = np.where(fits, middle, low), np.where(fits, high, middle - 1)
        return low


#: The columns that measure() adds: name and type.
MEASURES = "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, covered_words bigint, longest_repeat bigint, longest_apart bigint"


def measures(texts: list[str | None], repeat_len: int) -> list[np.ndarray]:
    """For each text, the eight measures of MEASURES; texts share suffix arrays but no repeats."""
    plain = np.zeros((4, len(texts)), np.int64)
    found = np.zeros((4, len(texts)), np.int64)
    number: dict[bytes, int] = {}
    ids: list[int] = []
    sizes: list[tuple[int, int]] = []

    def close() -> None:
        if ids:
            lengths = np.array([n for _, n in sizes])
            first = np.cumsum(lengths) - lengths
            r = Repeats(np.array(ids, np.int64), np.repeat(first + lengths, lengths))
            at = [k for k, _ in sizes]
            found[0, at] = r.covered(3, first)
            found[1, at] = r.covered(repeat_len, first)
            found[2, at] = np.maximum.reduceat(r.longest, first)
            found[3, at] = r.apart(first)
        ids.clear()
        sizes.clear()
        number.clear()

    for k, text in enumerate(texts):
        text = text or ""
        raw = text.encode()
        words = raw.split()
        spaces = sum(map(raw.count, (b" ", b"\t", b"\n", b"\v", b"\f", b"\r")))
        lines = [x for x in raw.split(b"\n") if x and not x.isspace()]
        plain[:, k] = len(words), len(text) - spaces, sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines))
        if words:
            put = number.setdefault
            ids += [put(w, len(number)) for w in words]
            sizes.append((k, len(words)))
            if len(ids) >= WORDS_AT_ONCE:
                close()
    close()
    return [*plain, *found]


def with_measures(docs: DataFrame, repeat_len: int, text_col: str = "text") -> DataFrame:
    """`docs` with the columns of MEASURES, which must not be in it yet. No shuffle."""
    at = docs.columns.index(text_col)
    names = [x.split()[0] for x in MEASURES.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = measures(batch.column(at).to_pylist(), repeat_len)
            yield pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, made)], names=[*batch.schema.names, *names])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(run, f"{kinds}, {MEASURES}")


def verdicts(docs: DataFrame, limits: Limits = Limits(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of `docs`: id, the measures, base_failed and kept.

    Null and empty texts have no words: all measures are 0 and they fail. Texts are taken whole; memory is in proportion
    to the longest. Ids may be null or repeated; other columns aren't read. An empty table gives an empty table.
    """
    out = with_measures(docs.select(F.col(id_col), F.col(text_col)), limits.repeat_len, text_col).drop(text_col)
    failed = (F.col("n_words") < limits.min_words) | (100 * F.col("n_repeat_words") > limits.repeat_words_pct * F.col("n_words"))
    fine = (F.col("covered_words") <= limits.max_covered * F.col("n_words")) & (F.col("longest_apart") <= limits.max_longest * F.col("n_words"))
    return out.select("*", failed.alias("base_failed"), (~failed & fine).alias("kept"))


def keep_good(docs: DataFrame, limits: Limits = Limits(), text_col: str = "text") -> DataFrame:
    """The rows of `docs` whose texts verdicts() keeps, with their columns as they are."""
    inner = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col(text_col).alias("_text"))
    at = verdicts(inner, limits, "row", "_text")
    return at.where("kept").select(*(F.col(f"row.`{c}`").alias(c) for c in docs.columns))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = verdicts(table(spark, sf_dir, "documents"))
    first = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return out.select(*first, *(c for c in out.columns if c not in first))


QUERIES = {"op6_quality": op6_quality}
