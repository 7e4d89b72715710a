"""Language-model scores by class-based bigrams (operator 7).

Exchange clustering assigns every training word that occurs twice or more to a class, so that classes predict their
neighbours; the number of classes grows with the vocabulary. Words that occur once, and unknown ones, are one more class,
and the end of a text is a class of its own. Class transitions and word emissions, both counted over all training texts,
give each text's log probability.

Texts are read once: tasks turn them into blocks of bounded size, each with a dictionary of its own (a row of binary
columns). Dictionaries, not tokens, meet the corpus counts in a shuffle. Clustering has two parts. The most frequent words
weigh much against their classes: their bigrams (a matrix of bounded size) come to the driver, and they move one after the
other, all counts following at once (Martin, Liermann and Ney 1998). Each of the others weighs little: they move side by
side, by word, against the classes' sums, as in Uszkoreit and Brants (2008), with gains of first order.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel, TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bucketed, collected, discard, table, written

#: Bytes of text in a block; a longer text is a block of its own.
BLOCK_BYTES = 4 << 20
#: Words that move one after the other: the driver gets (HEAD + 2)² sums at most. The rest moves in Spark.
HEAD = 2048
#: Passes of the exchange over these.
PASSES = 3
#: There are so many classes as this power of the number of distinct training words.
GROWTH = 0.3
#: Added to each class transition.
TRANSITION = 0.5
#: Added to each count of a word in its class, an unknown one included.
EMISSION = 0.5
#: The end of a text as a word: no word holds a line feed.
END = b"\n"
#: Bits of a word's number in its block's dictionary.
_LID = 24
#: Rows whose gains are held at once.
PIECE = 1000
#: Steps of a first-order gain: whole numbers, so that sums don't depend on their order.
_STEPS = 1 << 20


def _hash(word: bytes) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(word, 42)


def packed(numbers: np.ndarray) -> bytes:
    """32-bit numbers, all first bytes first: most last ones are zero and shrink to nothing."""
    return np.ascontiguousarray(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def unpacked(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(4, -1).T).view("<u4").ravel()


def encoded(docs: DataFrame, held_out, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each block of texts: block, ids, held, sizes (tokens, with the end), tokens (numbers in the block's dictionary), words (the dictionary: 64-bit hashes), counts (in training texts)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, seq = TaskContext.get().partitionId(), 0
        end = _hash(END)
        ids, held, sizes, tokens, number, size = [], [], [], [], {END: 0}, 0

        def block() -> pa.RecordBatch:
            flat = np.array(tokens, np.uint32)
            train = np.repeat(~np.array(held, bool), sizes)
            counts = np.bincount(flat[train], minlength=len(number)).astype(np.uint32)
            words = np.fromiter((end if w == END else _hash(w) for w in number), np.uint64, len(number))
            cols = [pa.array([at << 16 | seq]), pa.array([ids], pa.list_(kind)), pa.array([held], pa.list_(pa.bool_())), pa.array([sizes], pa.list_(pa.int32())), *(pa.array([x], pa.binary()) for x in (packed(flat), words.tobytes(), counts.tobytes()))]
            return pa.RecordBatch.from_arrays(cols, names=names)

        for batch in batches:
            kind = batch.schema.field(0).type
            for i, text, out in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                words = (text or "").encode().lower().split()
                put = number.setdefault
                tokens += [put(w, len(number)) for w in words]
                tokens.append(0)
                ids.append(i)
                held.append(out)
                sizes.append(len(words) + 1)
                size += len(text or "") + 16
                if size >= BLOCK_BYTES:
                    yield block()
                    seq += 1
                    ids, held, sizes, tokens, number, size = [], [], [], [], {END: 0}, 0
        if ids:
            yield block()

    names = ["block", "ids", "held", "sizes", "tokens", "words", "counts"]
    id_kind = docs.schema[id_col].dataType.simpleString()
    chosen = docs.select(F.col(id_col), F.col(text_col), F.coalesce(held_out, F.lit(False)).alias("held"))
    return chosen.mapInArrow(run, f"block bigint, ids array<{id_kind}>, held array<boolean>, sizes array<int>, tokens binary, words binary, counts binary")


def vocabulary(blocks: DataFrame) -> DataFrame:
    """Training counts: h (a word's hash), n (at least 1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for words, counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                n = np.frombuffer(counts, np.uint32)
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(words, np.int64)[n > 0]), pa.array(n[n > 0].astype(np.int64))], names=["h", "n"])

    return blocks.select("words", "counts").mapInArrow(run, "h bigint, n bigint").groupBy("h").agg(F.sum("n").alias("n"))


@dataclass
class Head:
    """The most frequent words by sorted hash, with counts and classes; how many classes words may have; and the corpus's totals."""

    hashes: np.ndarray
    counts: np.ndarray
    classes: np.ndarray
    words_classes: int
    total: int
    distinct: int

    @property
    def rare(self) -> int:
        """The class of words that occur once or never."""
        return self.words_classes

    @property
    def end(self) -> int:
        return self.words_classes + 1

    @property
    def size(self) -> int:
        return self.words_classes + 2

    def find(self, words: np.ndarray) -> np.ndarray:
        """Places of a block's dictionary: of words of the head theirs, of others the number of those, of the end (each dictionary's first word) one more."""
        k = len(self.hashes)
        out = np.full(len(words), k)
        if k:
            at = np.minimum(np.searchsorted(self.hashes, words), k - 1)
            out = np.where(self.hashes[at] == words, at, k)
        out[0] = k + 1
        return out

    @property
    def place_classes(self) -> np.ndarray:
        """The class of each place that find() gives."""
        return np.append(self.classes, [self.rare, self.end]).astype(np.int64)


def head_of(vocab: DataFrame, most: int = HEAD) -> Head:
    """The most frequent words, classes dealt in turn by frequency."""
    total, distinct = vocab.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    end = np.array([_hash(END)], np.uint64).view(np.int64)[0].item()
    top = vocab.where((F.col("h") != end) & (F.col("n") > 1)).orderBy(F.desc("n"), "h").limit(most).toArrow()
    hashes, counts = top["h"].to_numpy(), top["n"].to_numpy()
    order, classes = np.argsort(hashes), max(4, round(distinct**GROWTH))
    return Head(hashes[order], counts[order], (np.arange(len(hashes)) % classes)[order], classes, int(total), int(distinct))


def _training(row_tokens: bytes, held: list, sizes: list) -> np.ndarray:
    return unpacked(row_tokens)[np.repeat(~np.array(held, bool), sizes)]


def _summed(blocks: DataFrame, columns: list[str], cells: int, count) -> np.ndarray:
    """Sums over all blocks of what `count` makes of one: numbers of cells, each occurrence once. Tasks hold `cells` counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(cells, np.int64)
        for batch in batches:
            for i in range(batch.num_rows):
                at, n = np.unique(count(*(c[i].as_py() for c in batch.columns)), return_counts=True)
                total[at] += n
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["cell", "n"])

    out = np.zeros(cells, np.int64)
    got = blocks.select(*columns).mapInArrow(run, "cell int, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    out[got["cell"].to_numpy()] = got["n"].to_numpy()
    return out


def bigrams(blocks: DataFrame, head: Head) -> np.ndarray:
    """How often each place of the head (others and the end are places, too) follows each, in training texts. The first word of a text follows an end."""
    sent, size = blocks.sparkSession.sparkContext.broadcast(head), len(head.hashes) + 2

    def count(tokens, words, held, sizes):
        at = sent.value.find(np.frombuffer(words, np.int64))[_training(tokens, held, sizes)]
        return np.concatenate(([size - 1], at[:-1])) * size + at if len(at) else at

    return _summed(blocks, ["tokens", "words", "held", "sizes"], size * size, count).reshape(size, size)


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


def by_class(counts: np.ndarray, classes: np.ndarray, size: int) -> np.ndarray:
    """Bigrams of places as bigrams of classes."""
    rows = np.zeros((size, counts.shape[1]), np.int64)
    np.add.at(rows, classes, counts)
    out = np.zeros((size, size), np.int64)
    np.add.at(out.T, classes, rows.T)
    return out


def information(pairs: np.ndarray) -> float:
    """What exchange makes as large as it can: the log likelihood of classes given the class before, but for a constant. Each token follows one and is followed by one, so rows and columns have the same sums."""
    return float(_xlogx(pairs).sum() - 2 * _xlogx(pairs.sum(axis=0)).sum())


def exchange(head: Head, counts: np.ndarray, passes: int = PASSES) -> np.ndarray:
    """Classes of the head after `passes` in which each word, the most frequent first, moves to the class that gains most."""
    k, size, free = len(head.hashes), head.size, head.words_classes
    classes = head.place_classes
    pairs, follows = by_class(counts, classes, size), np.ascontiguousarray(counts.T)
    sums = pairs.sum(axis=0)
    for _ in range(passes):
        moved = 0
        for w in np.lexsort((np.arange(k), -head.counts)):
            a, n, own = classes[w], follows[w].sum(), counts[w, w]
            left = np.bincount(classes, follows[w], size).astype(np.int64)
            right = np.bincount(classes, counts[w], size).astype(np.int64)
            # A word after itself is in both, and once in the pairs.
            left[a] -= own
            right[a] -= own
            pairs[:, a] -= left
            pairs[a, :] -= right
            pairs[a, a] -= own
            sums[a] -= n
            x = np.flatnonzero(left)
            gain = (_xlogx(pairs[x] + left[x, None]) - _xlogx(pairs[x])).sum(axis=0)
            y = np.flatnonzero(right)
            gain += (_xlogx(pairs[:, y] + right[None, y]) - _xlogx(pairs[:, y])).sum(axis=1)
            d = np.diag(pairs)
            gain += _xlogx(d + left + right + own) - _xlogx(d + left) - _xlogx(d + right) + _xlogx(d)
            gain -= 2 * (_xlogx(sums + n) - _xlogx(sums))
            b = int(np.argmax(gain[:free]))
            if gain[b] <= gain[a] + 1e-9:
                b = a
            moved += b != a
            classes[w] = b
            pairs[:, b] += left
            pairs[b, :] += right
            pairs[b, b] += own
            sums[b] += n
        if not moved:
            break
    return classes[:k]


def _binary(numbers: np.ndarray, first: np.ndarray) -> pa.Array:
    """Numbers of 16 bits as binary values, each beginning at one of `first`."""
    offsets = np.append(first, len(numbers)).astype(np.int32) * 2
    return pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(offsets), pa.py_buffer(numbers.astype(np.uint16))])


def _numbers(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """What _binary() packed, and where each value begins in it."""
    _, offsets, data = values.buffers()
    at = np.frombuffer(offsets, np.int32)[values.offset : values.offset + len(values) + 1]
    return np.frombuffer(data, np.uint16, (at[-1] - at[0]) // 2, at[0]), (at[:-1] - at[0]) // 2


def gains(pairs: np.ndarray, free: int) -> np.ndarray:
    """What one more occurrence after class c (row c), or before it (row size + c), adds for each class that a word may have: the logarithm of the transition, in whole steps."""
    size, sums = len(pairs), pairs.sum(axis=0)
    share = np.log(pairs + TRANSITION), np.log(sums + TRANSITION * size)
    before = share[0][:, :free] - share[1][None, :free]
    after = share[0].T[:, :free] - share[1][None, :free]
    return np.rint(np.concatenate((before, after)) * _STEPS).astype(np.int64)


def others(blocks: DataFrame, head: Head, pairs: np.ndarray) -> DataFrame:
    """Each training word outside the head: h, n, c (its class). Neighbours' classes are those of the head; words that occur once are `rare`."""
    spark = blocks.sparkSession
    sent, table_of = spark.sparkContext.broadcast(head), spark.sparkContext.broadcast(gains(pairs, head.words_classes))

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Head = sent.value
        classes, k, size = m.place_classes, len(m.hashes), m.size
        for batch in batches:
            for tokens, words, held, sizes in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                h = np.frombuffer(words, np.int64)
                place, flat = m.find(h), _training(tokens, held, sizes)
                if not len(flat):
                    continue
                c = classes[place[flat]]
                asks = np.flatnonzero(place[flat] == k)
                word = flat[asks].astype(np.int64) * (2 * size)
                # No text begins without an end before it, and none but the end is last.
                before = np.concatenate(([m.end], c[:-1]))[asks]
                cell = np.sort(np.concatenate((word + before, word + size + c[asks + 1])))
                if not len(cell):
                    continue
                first = np.flatnonzero(np.diff(cell // (2 * size), prepend=-1))
                yield pa.RecordBatch.from_arrays([pa.array(h[cell[first] // (2 * size)]), _binary(cell % (2 * size), first)], names=["h", "cells"])

    def moved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, gain = sent.value, table_of.value

        def made(h, n, score):
            return pa.RecordBatch.from_arrays([pa.array(h), pa.array(n), pa.array(np.where(n > 1, score.argmax(axis=1), m.rare).astype(np.int32))], names=["h", "n", "c"])

        # Rows come by word; the last word of a batch may go on in the next.
        last = None
        for piece in (batch.slice(i, PIECE) for batch in batches for i in range(0, batch.num_rows, PIECE)):
            h = piece.column(0).to_numpy()
            cell, start = _numbers(piece.column(1))
            at = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
            score = np.add.reduceat(gain[cell], start[at], axis=0)
            # Each occurrence has one class before it.
            seen, names = np.add.reduceat((cell < m.size).astype(np.int64), start[at]), h[at]
            if last is not None:
                if last[0][0] == names[0]:
                    seen[0] += last[1][0]
                    score[0] += last[2][0]
                else:
                    yield made(*last)
            if len(names) > 1:
                yield made(names[:-1], seen[:-1], score[:-1])
            last = names[-1:], seen[-1:], score[-1:]
        if last is not None:
            yield made(*last)

    asked = blocks.select("tokens", "words", "held", "sizes").mapInArrow(cells, "h bigint, cells binary")
    return asked.repartition("h").sortWithinPartitions("h").mapInArrow(moved, "h bigint, n bigint, c int")


def labelled(blocks: DataFrame, head: Head, rest: DataFrame, buckets: int) -> DataFrame:
    """Blocks with counts and classes of their words outside the head: x (a word's number in the dictionary, then 16 bits for its class) and n. Dictionaries alone meet the corpus's words; what they got meets the blocks bucket by bucket, where these lie."""
    sent = blocks.sparkSession.sparkContext.broadcast(head)

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Head = sent.value
        for batch in batches:
            for block, words in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                h = np.frombuffer(words, np.int64)
                lid = np.flatnonzero(m.find(h) == len(m.hashes))
                yield pa.RecordBatch.from_arrays([pa.array(h[lid]), pa.array(block << _LID | lid)], names=["h", "at"])

    def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(block, parts):
            x, n = (np.concatenate(p).tobytes() for p in zip(*parts, strict=True))
            return pa.RecordBatch.from_arrays([pa.array([block]), pa.array([x], pa.binary()), pa.array([n], pa.binary())], names=["block", "x", "n"])

        # Rows come by block; a block has no more of them than words.
        last, parts = None, []
        for batch in batches:
            at, n = (x.to_numpy(zero_copy_only=False) for x in batch.columns)
            block, x, n = at >> _LID, (at & ((1 << _LID) - 1)) << 16 | n & 0xFFFF, n >> 16
            for i in np.split(np.arange(len(at)), np.flatnonzero(np.diff(block)) + 1):
                if not len(i):
                    continue
                if parts and last != block[i[0]]:
                    yield made(last, parts)
                    parts = []
                last = int(block[i[0]])
                parts.append((x[i], n[i]))
        if parts:
            yield made(last, parts)

    asked = blocks.select("block", "words").mapInArrow(entries, "h bigint, at bigint").join(rest.hint("merge"), "h").select("at", F.shiftleft("n", 16).bitwiseOR(F.col("c")).alias("n"))
    by_block = asked.repartition(buckets, F.shiftright("at", _LID)).sortWithinPartitions("at")
    collected(blocks.sparkSession)
    known = bucketed(by_block.mapInArrow(gathered, "block bigint, x binary, n binary"), "known", "block", buckets)
    # A bucket's share of `known` is hashed, so that blocks needn't be sorted.
    return blocks.join(known.hint("shuffle_hash"), "block", "left").select("ids", "held", "sizes", "tokens", "words", "x", "n")


def counts_and_classes(head: Head, words: bytes, x: bytes | None, n: bytes | None) -> tuple[np.ndarray, np.ndarray]:
    """Of each word of a block's dictionary."""
    place = head.find(np.frombuffer(words, np.int64))
    count, kind = np.append(head.counts, [0, 0]).astype(np.int64)[place], head.place_classes[place]
    if x is not None:
        x = np.frombuffer(x, np.int64)
        count[x >> 16] = np.frombuffer(n, np.int64)
        kind[x >> 16] = x & 0xFFFF
    return count, kind


@dataclass
class Model:
    #: log10 of class transitions.
    transition: np.ndarray
    #: Of each class, training tokens and distinct words; of the rare one, an unknown word is one more.
    in_class: np.ndarray
    words: np.ndarray
    head: Head


def model_of(ready: DataFrame, head: Head, rest: DataFrame) -> Model:
    """Transitions of the classes that all words have in the end, from all training texts."""
    size, sent = head.size, ready.sparkSession.sparkContext.broadcast(head)

    def count(tokens, words, x, n, held, sizes):
        at = counts_and_classes(sent.value, words, x, n)[1][_training(tokens, held, sizes)]
        return np.concatenate(([sent.value.end], at[:-1])) * size + at if len(at) else at

    pairs = _summed(ready, ["tokens", "words", "x", "n", "held", "sizes"], size * size, count).reshape(size, size)
    words = np.bincount(head.classes, minlength=size) if len(head.classes) else np.zeros(size, np.int64)
    for c, n in rest.groupBy("c").count().collect():  # one row a class
        words[c] += n
    words[head.rare] += 1
    transition = np.log10((pairs + TRANSITION) / (pairs.sum(axis=1, keepdims=True) + TRANSITION * size))
    return Model(transition, pairs.sum(axis=0), words, head)


def scores(docs: DataFrame, held_out, id_col: str = "doc_id", text_col: str = "text", head_words: int = HEAD) -> DataFrame:
    """One row for each row of `docs`: id, held_out, n_tokens, n_known, train_tokens, base_score, score (both log10).

    `held_out`: a condition; texts for which it is true aren't learned from (null: false). A null or empty text is its end
    alone. Texts are taken whole, with up to 2^24 distinct words each. Rows that are equal, or share an id, count as often as
    they occur. Without training texts every word is unknown. An empty table gives an empty table. Other columns aren't read.
    """
    made = encoded(docs, held_out, id_col, text_col)
    buckets = 2 * max(1, made.rdd.getNumPartitions())
    blocks = bucketed(made, "blocks", "block", buckets)
    # What a lost executor kept of this follows again from the blocks, and is the same.
    vocab = vocabulary(blocks).persist(StorageLevel.DISK_ONLY)
    head = head_of(vocab, head_words)
    vocab.unpersist()
    del vocab
    counts = bigrams(blocks, head)
    head.classes = exchange(head, counts)
    # Written, so that the shuffle of all cells is gone before dictionaries are shuffled.
    rest = written(others(blocks, head, by_class(counts, head.place_classes, head.size)), "rest")
    ready = labelled(blocks, head, rest, buckets)
    sent = docs.sparkSession.sparkContext.broadcast(model_of(ready, head, rest))
    discard(rest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = sent.value
        for batch in batches:
            kind = batch.schema.field("ids").type.value_type
            for row in (x for i in range(batch.num_rows) for x in batch.slice(i, 1).to_pylist()):
                tokens = unpacked(row["tokens"])
                n, c = counts_and_classes(m.head, row["words"], row["x"], row["n"])
                # The end is a word like others: every training text has one.
                n[0] = m.in_class[m.head.end]
                base = np.log10((n + 0.5) / (m.head.total + 0.5 * (m.head.distinct + 1)))
                emit = np.log10((n + EMISSION) / (m.in_class[c] + EMISSION * m.words[c]))
                emit[0] = 0
                kinds = c[tokens]
                before = np.concatenate(([m.head.end], kinds[:-1]))
                sizes = np.array(row["sizes"])
                first = np.cumsum(sizes) - sizes
                add = lambda x, first=first: np.add.reduceat(x, first)
                made = [pa.array(sizes.astype(np.int64)), pa.array(add((n[tokens] > 0).astype(np.int64))), pa.array(np.full(len(sizes), m.head.total)), pa.array(add(base[tokens])), pa.array(add(m.transition[before, kinds] + emit[tokens]))]
                yield pa.RecordBatch.from_arrays([pa.array(row["ids"], kind), pa.array(row["held"]), *made], names=names)

    names = [id_col, "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    id_kind = docs.schema[id_col].dataType.simpleString()
    return ready.mapInArrow(run, f"`{id_col}` {id_kind}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")


def op7_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 1
    return scores(table(spark, sf_dir, "documents"), out)


QUERIES = {"op7_lm": op7_lm}
