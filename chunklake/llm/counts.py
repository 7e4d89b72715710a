"""Edit-aware token counts (operator 2).

A text's pre-tokens are the leaves of a segment tree whose nodes hold sums of characters and tokens. An edit re-encodes
only from the last pre-token that it can't have changed to where old and new pre-tokens meet again, puts what it found into
the first changed leaf, empties the other changed ones, and updates the sums above them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import Encoder, encoder, specification, tokenizer_path
from .common import table

#: An edit (at: characters before it; remove: characters that go; insert: text that comes), as a Spark type.
EDIT = "struct<at:bigint,remove:bigint,insert:string>"


class Tree:
    """The segment tree of one text."""

    def __init__(self, text: str, encode: Encoder, leaves: np.ndarray | None = None):
        """`leaves`: two rows, characters and tokens of each pre-token, if they are known from before."""
        self.text, self.encode = text, encode
        #: A pre-token's end depends on so many characters after it, at most: what makes it an added token, or the lookahead.
        self.margin = max([3, *map(len, encode.added)]) + 1
        if leaves is None:
            leaves = self._leaves(text)
        n = leaves.shape[1]
        self.slots = 1 << max(0, n - 1).bit_length()
        self.sums = np.zeros((2, 2 * self.slots), np.int64)
        self.sums[:, self.slots : self.slots + n] = leaves
        k = self.slots
        while k > 1:
            self.sums[:, k // 2 : k] = self.sums[:, k : 2 * k].reshape(2, k // 2, 2).sum(axis=2)
            k //= 2
        #: Of leaves that an edit filled: the pre-tokens in them.
        self.filled: dict[int, np.ndarray] = {}

    def _leaves(self, text: str) -> np.ndarray:
        e = self.encode
        sizes, tokens = [], []
        for k, piece in enumerate(e.split_added(text) if e.split_added else [text]):
            if k % 2:
                sizes.append(len(piece))
                tokens.append(4)
                continue
            words = e.split(piece)
            got = list(map(e.known.get, words))
            if None in got:
                got = [x if x is not None else e.packed(w) for x, w in zip(got, words, strict=True)]
            sizes += map(len, words)
            tokens += map(len, got)
        return np.array([sizes, np.array(tokens, np.int64) // 4], np.int64).reshape(2, -1)

    @property
    def tokens(self) -> int:
        return int(self.sums[1, 1])

    def leaves(self) -> np.ndarray:
        """Characters and tokens of each pre-token."""
        at = np.flatnonzero(self.sums[0, self.slots :])
        parts = [self.filled[k] if k in self.filled else self.sums[:, self.slots + k : self.slots + k + 1] for k in at.tolist()]
        return np.concatenate(parts, axis=1) if parts else np.zeros((2, 0), np.int64)

    def find(self, offset: int) -> tuple[int, int]:
        """The leaf that holds the character at `offset`, and where it begins; beyond the text: the number of leaves, and the text's length."""
        if offset >= self.sums[0, 1]:
            return self.slots, int(self.sums[0, 1])
        node, begin = 1, 0
        while node < self.slots:
            node *= 2
            if offset >= begin + self.sums[0, node]:
                begin += int(self.sums[0, node])
                node += 1
        return node - self.slots, begin

    def _next(self, text: str, at: int) -> int:
        """Where the pre-token that begins at `at` ends."""
        e = self.encode
        for added in e.added:
            if text.startswith(added, at):
                return at + len(added)
        end = e.pattern.match(text, at).end()
        # An added token that begins before the end, or right there, ends the search for it; one further on changes nothing.
        found = [k for k in (text.find(added, at, end + len(added)) for added in e.added) if k >= 0]
        return e.pattern.match(text, at, min(found)).end() if found else end

    def edit(self, at: int, remove: int, insert: str | None) -> int:
        """Applies an edit, clipped to the text; returns how many characters it re-encoded."""
        insert = insert or ""
        at = min(max(0, at), len(self.text))
        remove = min(max(0, remove), len(self.text) - at)
        new = self.text[:at] + insert + self.text[at + remove :]
        if not remove and not insert:
            return 0
        first, begin = self.find(max(0, at - self.margin)) if self.text else (0, 0)
        shift = len(insert) - remove
        pos, sizes, tokens = begin, [], []
        while pos < len(new):
            if pos >= at + len(insert):
                until, start = self.find(pos - shift)
                if start == pos - shift and until > first:
                    break
            end = self._next(new, pos)
            word = new[pos:end]
            sizes.append(end - pos)
            tokens.append(1 if word in self.encode.added else len(self.encode.packed(word)) // 4)
            pos = end
        else:
            until = self.slots
        first = min(first, self.slots - 1)
        made = np.array([sizes, tokens], np.int64).reshape(2, -1)
        lo, hi = first, max(first, until - 1)
        for k in [k for k in self.filled if lo <= k <= hi]:
            del self.filled[k]
        self.sums[:, self.slots + lo : self.slots + hi + 1] = 0
        self.sums[:, self.slots + first] = made.sum(axis=1)
        if made.shape[1] != 1:
            self.filled[first] = made
        lo, hi = self.slots + lo, self.slots + hi
        while lo > 1:
            lo, hi = lo // 2, hi // 2
            self.sums[:, lo : hi + 1] = self.sums[:, 2 * lo : 2 * hi + 2].reshape(2, -1, 2).sum(axis=2)
        self.text = new
        return pos - begin


def counted(docs: DataFrame, tokenizer: str, edits_col: str | None = None, tree_col: str | None = None, id_col: str = "doc_id", text_col: str = "text", trees_too: bool = True) -> DataFrame:
    """One row for each row of `docs`: id, n_tokens (of the text as given), n_after (after its edits), n_edits, n_encoded (characters that the edits re-encoded), text (after the edits), tree (null without `trees_too`).

    `edits_col`: an array of EDIT, applied in order, each to what the one before left; clipped to the text; a null array,
    edit or field changes nothing. `tree_col`: trees of an earlier result, which must belong to the texts; where null or not
    given, trees are built. Null texts are empty. Ids may be null or repeated; other columns aren't read. No shuffle; an empty
    table gives an empty table.
    """
    spec = docs.sparkSession.sparkContext.broadcast(specification(tokenizer))
    kind = docs.schema[id_col].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(spec.value)
        for batch in batches:
            before, after, n, work, texts, trees = [], [], [], [], [], []
            for text, edits, tree in zip(*(batch.column(k).to_pylist() for k in (1, 2, 3)), strict=True):
                t = Tree(text or "", e, None if tree is None else np.frombuffer(tree, np.uint32).reshape(2, -1).astype(np.int64))
                before.append(t.tokens)
                edits = [x for x in edits or () if x and x["at"] is not None]
                work.append(sum(t.edit(x["at"], x["remove"] or 0, x["insert"]) for x in edits))
                after.append(t.tokens)
                n.append(len(edits))
                texts.append(t.text)
                trees.append(t.leaves().astype(np.uint32).tobytes() if trees_too else None)
            cols = [pa.array(x, pa.int64()) for x in (before, after, n, work)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *cols, pa.array(texts, pa.string()), pa.array(trees, pa.binary())], names=[id_col, "n_tokens", "n_after", "n_edits", "n_encoded", "text", "tree"])

    edits = F.col(edits_col) if edits_col else F.lit(None).cast(f"array<{EDIT}>")
    tree = F.col(tree_col) if tree_col else F.lit(None).cast("binary")
    chosen = docs.select(F.col(id_col), F.col(text_col), edits.alias("e"), tree.alias("t"))
    return chosen.mapInArrow(run, f"`{id_col}` {kind.simpleString()}, n_tokens bigint, n_after bigint, n_edits bigint, n_encoded bigint, text string, tree binary")


def standard_edits(text: Column) -> Column:
    """The query's edits: a word changed at a third, words put in at the middle, the last ten characters gone."""
    n = F.length(text).cast("long")
    edit = lambda at, remove, insert: F.struct(at.cast("long").alias("at"), F.lit(remove).cast("long").alias("remove"), F.lit(insert).alias("insert"))
    return F.array(edit(F.floor(n / 3), 5, "edit"), edit(F.floor(n / 2), 0, "'s new  words\n\n"), edit(n - 2, 10, ""))


def op2_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("edits", standard_edits(F.col("text")))
    return counted(docs, tokenizer_path(), "edits", trees_too=False).select("doc_id", "n_tokens", "n_edits", "n_after", "n_encoded", F.sha2(F.col("text").cast("binary"), 256).alias("after_sha256"))


QUERIES = {"op2_counts": op2_counts}
