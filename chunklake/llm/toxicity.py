"""Toxicity by a subsequence string-kernel support vector machine with Nyström landmarks (operator 10).

The kernel of two strings counts common subsequences of three characters, gaps allowed, each weighted by DECAY to the power
of its spans; so gapped and padded insults stay close to plain ones. A text is a bag of short strings (its words, long ones
in overlapping windows, and runs of single characters joined); its score is its worst string's. The machine is trained on
labelled texts as bags: the worst string of a toxic text stands for it, strings of other texts are all negative. Landmarks
give the Nyström features; the trained machine folds into one weight for each character triple, so that scoring costs a
table lookup for each subsequence and is the same sum.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: For each character that a subsequence spans, in either string.
DECAY = 0.7
#: Longer strings are cut into windows so long, each beginning half a window after the last.
WINDOW = 24
LANDMARKS = 96
#: Labelled rows that training takes of each class at most (in the order of a hash of the id).
ROWS = 3000
#: Distinct strings of clean texts that training takes at most.
NEGATIVES = 40_000
ROUNDS = 3
#: Directions of the landmarks' kernel with smaller eigenvalues are left out.
FLOOR = 0.02
#: The sum of the examples' weights, against a penalty of 1.
WEIGHT = 20_000.0
#: Words that a worker remembers at most; beyond that it starts anew, which costs time only.
MEMORY = 300_000
EDGE = ".,:;!?\"'()[]{}<>«»„“”¡¿-–—…*_~`"


def strings(words: list[str]) -> list[str]:
    """The strings that a text's words give besides themselves: runs of three or more single characters, joined."""
    out, run = [], []
    for w in [*words, "  "]:
        if len(w) == 1:
            run.append(w)
        else:
            if len(run) >= 3:
                out.append("".join(run))
            run = []
    return out


def windows(word: str) -> list[str]:
    """What of a word is compared: without punctuation at its edges; also without any inside, if there is some; in windows if long."""
    word = word.strip(EDGE)
    plain = re.sub(r"[\W_]+", "", word)
    out = []
    for w in {word, plain}:
        out += [w] if len(w) <= WINDOW else [w[i : i + WINDOW] for i in range(0, len(w) - WINDOW // 2, WINDOW // 2)]
    return [w for w in out if len(w) >= 3]


def _triples(n: int) -> tuple[np.ndarray, np.ndarray]:
    at = np.array(list(combinations(range(n), 3)), np.int64).T
    return at, DECAY ** (at[2] - at[0] + 1.0)


_known_triples: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def by_length(words: list[str], most: int = 4_000_000) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Blocks of words of one length: their places, characters, and the places and weights of all triples."""
    of = defaultdict(list)
    for k, w in enumerate(words):
        of[len(w)].append(k)
    for n, places in of.items():
        if n not in _known_triples:
            _known_triples[n] = _triples(n)
        at, weight = _known_triples[n]
        size = max(1, most // len(weight))
        for i in range(0, len(places), size):
            block = places[i : i + size]
            chars = np.frombuffer("".join(words[k] for k in block).encode("utf-32-le"), np.uint32).reshape(len(block), n)
            yield np.array(block), chars, at, weight


@dataclass
class Machine:
    """A trained machine. `alphabet`: sorted code points that have a code, from 1 on; `weights`: of each triple of codes."""

    alphabet: np.ndarray
    weights: np.ndarray
    bias: float
    slope: float
    offset: float
    lowest: float

    def codes(self, chars: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.alphabet, chars), len(self.alphabet) - 1)
        return np.where(self.alphabet[at] == chars, at + 1, 0)

    def margins(self, words: list[str]) -> np.ndarray:
        """The decision value of each string of at least three characters."""
        out = np.zeros(len(words))
        size = len(self.alphabet) + 1
        for block, chars, at, weight in by_length(words):
            c = self.codes(chars)
            triple = (c[:, at[0]] * size + c[:, at[1]]) * size + c[:, at[2]]
            out[block] = (self.weights[triple] * weight).sum(axis=1) / np.sqrt(self_kernel(chars, at, weight))
        return out + self.bias

    def probability(self, margin: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * np.asarray(margin) + self.offset, -500, 500)))


def self_kernel(chars: np.ndarray, at: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """The kernel of each string with itself."""
    dense = np.unique(chars, return_inverse=True)[1].reshape(chars.shape).astype(np.int64)
    size = int(dense.max(initial=0)) + 1
    triple = (dense[:, at[0]] * size + dense[:, at[1]]) * size + dense[:, at[2]]
    order = np.argsort(triple, axis=1)
    triple = np.take_along_axis(triple, order, 1)
    w = np.broadcast_to(weight, triple.shape)
    w = np.take_along_axis(w, order, 1)
    new = np.ones(triple.shape, bool)
    new[:, 1:] = triple[:, 1:] != triple[:, :-1]
    starts = np.flatnonzero(new.ravel())
    sums = np.add.reduceat(w.ravel(), starts)
    row = starts // triple.shape[1]
    return np.bincount(row, sums**2, len(chars))


def _features(words: list[str], alphabet: np.ndarray) -> np.ndarray:
    """Dense subsequence features of a few strings (landmarks), over the length of all their features. Triples with a character outside the alphabet, whose code is 0, are left out, and so out of every kernel with them."""
    size = len(alphabet) + 1
    m = Machine(alphabet, np.zeros(0), 0, 1, 0, 0)
    out = np.zeros((len(words), size**3), np.float32)
    for block, chars, at, weight in by_length(words):
        c = m.codes(chars)
        triple = (c[:, at[0]] * size + c[:, at[1]]) * size + c[:, at[2]]
        for row, t in zip(block, triple, strict=True):
            np.add.at(out[row], t, weight.astype(np.float32))
        out[block] /= np.sqrt(self_kernel(chars, at, weight))[:, None].astype(np.float32)
    by_place = out.reshape(len(words), size, size, size)
    by_place[:, 0] = by_place[:, :, 0] = by_place[:, :, :, 0] = 0
    return out


def kernel(words: list[str], landmarks: np.ndarray, alphabet: np.ndarray) -> np.ndarray:
    """Normalised kernel of each string with each landmark."""
    size = len(alphabet) + 1
    m = Machine(alphabet, np.zeros(0), 0, 1, 0, 0)
    by_triple = np.ascontiguousarray(landmarks.T)
    out = np.zeros((len(words), len(landmarks)), np.float32)
    for block, chars, at, weight in by_length(words, 400_000):
        c = m.codes(chars)
        triple = (c[:, at[0]] * size + c[:, at[1]]) * size + c[:, at[2]]
        part = np.zeros((len(block), len(landmarks)), np.float32)
        for k in range(len(weight)):
            part += by_triple[triple[:, k]] * np.float32(weight[k])
        out[block] = part / np.sqrt(self_kernel(chars, at, weight))[:, None].astype(np.float32)
    return out


def squared_hinge(x: np.ndarray, y: np.ndarray, weight: np.ndarray, penalty: float = 1.0, steps: int = 30) -> np.ndarray:
    """The linear machine that minimises penalty/2 |w|² + Σ weight · max(0, 1 - y·(x·w + b))², by Newton steps; b last."""
    x = np.hstack([x, np.ones((len(x), 1), x.dtype)]).astype(np.float64)
    w = np.zeros(x.shape[1])
    ridge = np.full(len(w), penalty)
    ridge[-1] = 1e-6
    loss = lambda w: 0.5 * (ridge * w * w).sum() + (weight * np.maximum(0, 1 - y * (x @ w)) ** 2).sum()
    now = loss(w)
    for _ in range(steps):
        gap = 1 - y * (x @ w)
        on = gap > 0
        g = ridge * w - 2 * x[on].T @ (weight[on] * y[on] * gap[on])
        h = np.diag(ridge) + 2 * (x[on] * weight[on, None]).T @ x[on]
        step, size = np.linalg.solve(h, g), 1.0
        while size > 1e-4 and loss(w - size * step) > now:
            size /= 2
        w = w - size * step
        new = loss(w)
        if now - new < 1e-7 * max(1, now):
            break
        now = new
    return w


def platt(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the logistic curve through margins and labels (0/1), with Platt's targets."""
    n1, n0 = y.sum(), (1 - y).sum()
    target = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    x = np.stack([margin, np.ones_like(margin)], 1)
    w = np.array([1.0, 0.0])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (p - target) + 1e-3 * w
        h = (x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        step = np.linalg.solve(h, g)
        w = w - step * min(1, 5 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-8:
            break
    return float(max(w[0], 1e-3)), float(w[1])


def inserted(word: str) -> list[str]:
    """The word with a character doubled, or a foreign one put in, at each inner place."""
    return [word[:k] + c + word[k:] for k in range(1, len(word)) for c in (word[k], "*")]


def bag(text: str | None) -> set[str]:
    words = (text or "").lower().split()
    return {x for w in {*words, *strings(words)} for x in windows(w)}


def train(rows: list[tuple[str | None, int]]) -> Machine:
    """A machine from labelled texts."""
    return train_bags([(bag(t), int(y)) for t, y in rows])


def train_bags(bags: list[tuple[set[str], int]]) -> Machine:
    """A machine from labelled bags. With one class only, or no string, every text gets that class's share."""
    pos, neg = [b for b, y in bags if y and b], [b for b, y in bags if not y]
    share = sum(y for _, y in bags) / max(1, len(bags))
    if not pos or not any(neg):
        return Machine(np.array([0], np.uint32), np.zeros(8), 0.0, 0.0, float(np.log((share + 1e-3) / (1 - share + 1e-3))), 0.0)
    df1, df0 = Counter(w for b in pos for w in b), Counter(w for b in neg for w in b)
    odds = {w: np.log((n + 0.2) / (len(pos) + 1)) - np.log((df0[w] + 2.0) / (len(neg) + 1)) for w, n in df1.items()}
    # Strings that many toxic texts and hardly any clean ones have stand for a text, all of them; where there is none, its worst.
    clear = {w for w, n in df1.items() if n >= 4 and odds[w] > 1}
    stands = lambda b, by: sorted(b & clear) or [max(sorted(b), key=by.__getitem__)]
    witness = [w for b in pos for w in stands(b, odds)]
    clean = sorted(df0, key=lambda w: (-df0[w], w))
    rest = clean[NEGATIVES // 2 :]
    clean = clean[: NEGATIVES // 2] + rest[:: max(1, len(rest) // (NEGATIVES // 2) + 1)]
    for at in range(ROUNDS):
        seen = Counter(witness)
        # Half of the landmarks are what stands for toxic texts, most frequent first; the others are strings of clean texts, those like the former first.
        top = sorted(seen, key=lambda w: (-seen[w], w))[: LANDMARKS // 2]
        other = [w for w in clean if w not in seen]
        marks = top + other[:: max(1, len(other) // (LANDMARKS - len(top)))][: LANDMARKS - len(top)]
        alphabet = np.array(sorted({ord(c) for w in top for c in w}), np.uint32)
        marked = _features(marks, alphabet)
        values, vectors = np.linalg.eigh((marked @ marked.T).astype(np.float64))
        root = vectors / np.sqrt(np.maximum(values, FLOOR))
        root[:, values < FLOOR] = 0
        # Virtual examples: landmarks with one character inserted, so that the margin also holds for them.
        grown = Counter({v: seen[w] / (4 * len(w)) for w in top if len(w) >= 5 for v in inserted(w)})
        seen = seen + Counter({w: n for w, n in grown.items() if w not in seen and w not in df0})
        positive = sorted(seen)
        x = kernel(positive + clean, marked, alphabet) @ root
        y = np.array([1.0] * len(positive) + [-1.0] * len(clean))
        n = np.array([float(seen[w]) for w in positive] + [1.0 + np.log1p(df0[w]) for w in clean])
        n[: len(positive)] *= n[len(positive) :].sum() / max(1.0, n[: len(positive)].sum()) / 10
        w = squared_hinge(x, y, n * (WEIGHT / n.sum()))
        m = Machine(alphabet, (marked.T @ (root @ w[:-1])).astype(np.float64), float(w[-1]), 1.0, 0.0, 0.0)
        every = sorted(df1)
        margin = dict(zip(every, m.margins(every), strict=True))
        if at < ROUNDS - 1:
            witness = [w for b in pos for w in stands(b, margin)]
    other = sorted(df0)
    margin |= dict(zip(other, m.margins(other), strict=True))
    m.lowest = min(margin.values())
    worst = np.array([max((margin[w] for w in b), default=m.lowest) for b, _ in bags])
    m.slope, m.offset = platt(worst, np.array([float(y) for _, y in bags]))
    return m


def scores(docs: DataFrame, machine: Machine, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of `docs`: id, score (0 to 1), predicted (1 if the score is 0.5 or more, else 0).

    Null and empty texts, and texts without a string of three characters, get the lowest score. Texts are taken whole.
    Ids may be null or repeated and other columns aren't read. No shuffle.
    """
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(machine)
    kind = docs.schema[id_col].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Machine = sent.value
        known: dict[str, float] = {}
        for batch in batches:
            bags = []
            for text in batch.column(1).to_pylist():
                words = (text or "").lower().split()
                bags.append({*words, *strings(words)})
            for k in range(0, len(bags), 64):
                block = bags[k : k + 64]
                if len(known) > MEMORY:
                    known.clear()
                new = list({w for b in block for w in b if w not in known})
                if new:
                    parts = [windows(w) for w in new]
                    flat = m.margins([x for p in parts for x in p]).tolist()
                    at = 0
                    for w, p in zip(new, parts, strict=True):
                        known[w] = max(flat[at : at + len(p)], default=m.lowest)
                        at += len(p)
                bags[k : k + 64] = [max(map(known.__getitem__, b), default=m.lowest) for b in block]
            p = m.probability(np.array(bags, float))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], names=[id_col, "score", "predicted"])

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, f"`{id_col}` {kind.simpleString()}, score double, predicted int")


def held_out(id_col: Column) -> Column:
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, rows: int = ROWS) -> Machine:
    """A machine from the labelled rows that aren't held out: at most `rows` of each class, in the order of a hash of the id. The driver gets their bags alone.

    Texts count whole, however long; null and empty ones are empty bags. Labels that are null or repeated, and labels of no
    document, change nothing; a document with both labels counts once with each. Documents that share an id share its label.
    """
    ids = [labels.where((~held_out(F.col("doc_id"))) & (F.col("toxic") == y)).select("doc_id", "toxic").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows) for y in (0, 1)]

    def bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sorted(bag(t)) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.string())), batch.column(0)], names=["strings", "toxic"])

    # At most 2 * rows ids are broadcast; texts move only if they are in the sample.
    known = docs.select("doc_id", "text").join(F.broadcast(ids[0].unionByName(ids[1])), "doc_id")
    first = known.orderBy(F.xxhash64("doc_id"), "text", "toxic").limit(2 * rows).select(F.col("toxic").cast("int"), "text")
    got, one = first.mapInArrow(bags, "strings array<string>, toxic int").toArrow(), {}
    # Equal strings of different bags are one object.
    return train_bags([({one.setdefault(w, w) for w in x.as_py()}, y) for x, y in zip(got["strings"], got["toxic"].to_pylist(), strict=True)])


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = scores(docs, fit(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


QUERIES = {"op10_toxicity": op10_toxicity}
