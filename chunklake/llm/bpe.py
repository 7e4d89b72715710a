"""Exact byte-pair encoding and decoding by dynamic programming over prefixes (operator 8).

For each prefix of a pre-token exactly one token can be the last of its encoding. The automaton of the vocabulary (its
suffix links give every token that ends at a byte, longest first) proposes tokens; a token fits if it is compatible with
the last token of the prefix before it: two tokens are compatible if encoding their joined bytes gives just these two.
The last token of every prefix is stored; back-pointers from the end give the ids, with no merge loop over the text.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: Of byte-level tokenizers: text is cut by this pattern before the merges. Fixed values.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
#: Pre-tokens that a worker remembers at most; beyond that it starts anew, which costs time only.
MEMORY = 200_000
#: Longer pre-tokens aren't remembered.
LONGEST = 64


def byte_letters() -> dict[str, int]:
    """The byte for each letter that stands for it in byte-level vocabularies: printable bytes stand for themselves, the others are numbered from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Encoder:
    """Encodes and decodes as the tokenizer in the JSON file `spec` (its content) does with add_special_tokens=False. Texts of added tokens become these tokens."""

    def __init__(self, spec: str):
        import ahocorasick
        import regex

        data = json.loads(spec)
        letters = byte_letters()
        raw = lambda token: bytes(letters[x] for x in token)
        vocab = data["model"]["vocab"]
        self.ids = {raw(k): v for k, v in vocab.items()}
        self.added = {x["content"]: x["id"] for x in data["added_tokens"]}
        self.text_of = {v: k for k, v in self.ids.items()} | {v: k.encode() for k, v in self.added.items()}
        self.pattern = regex.compile(PATTERN)
        self.split = self.pattern.findall
        self.split_added = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")").split if self.added else None
        # A token's age: bytes are oldest, then merges in order. `parts`: what a token was merged from.
        self.merged: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        self.age = {i: -1 for k, i in self.ids.items() if len(k) == 1}
        for age, pair in enumerate(data["model"]["merges"]):
            left, right = (vocab[x] for x in (pair if isinstance(pair, list) else pair.split(" ")))
            whole = self.ids[self.text_of[left] + self.text_of[right]]
            self.merged[left, right] = whole
            self.parts.setdefault(whole, (left, right))
            self.age.setdefault(whole, age)
        self.automaton = ahocorasick.Automaton()
        for k, i in self.ids.items():
            if i in self.age:
                self.automaton.add_word(k.decode("latin-1"), (i, len(k)))
        self.automaton.make_automaton()
        self.fits: dict[tuple[int, int], bool] = {}
        self.known: dict[str, bytes] = {}

    def compatible(self, a: int, b: int) -> bool:
        """Whether the encoding of a's and b's joined bytes is a, b. Undoes the younger of the two tokens at the seam step by step: no pair that meets there may merge before the merge that then hides it."""
        key = a, b
        known = self.fits.get(key)
        if known is not None:
            return known
        age, parts, until = self.age, self.parts, 1 << 60
        fits = True
        while True:
            joined = self.merged.get((a, b))
            if joined is not None and age[joined] < until:
                fits = False
                break
            # The seam's younger side was made last; of equal ages, the left one was.
            if age[a] > age[b] and age[a] >= 0:
                until, a = age[a], parts[a][1]
            elif age[b] >= 0:
                until, b = age[b] + 1, parts[b][0]
            else:
                break
        if len(self.fits) >= 4 * MEMORY:
            self.fits.clear()
        self.fits[key] = fits
        return fits

    def word(self, data: bytes) -> list[int]:
        """The ids of one pre-token."""
        whole = self.ids.get(data)
        if whole is not None and (whole in self.parts or len(data) == 1):
            return [whole]
        last = [-1] * (len(data) + 1)
        size = [0] * (len(data) + 1)
        for end, (token, n) in self.automaton.iter(data.decode("latin-1")):
            end += 1
            if last[end] < 0:
                before = end - n
                if before == 0 or (last[before] >= 0 and self.compatible(last[before], token)):
                    last[end], size[end] = token, n
        out = []
        at = len(data)
        while at:
            out.append(last[at])
            at -= size[at]
        return out[::-1]

    def packed(self, word: str) -> bytes:
        """The ids of one pre-token, each as 4 bytes, the lowest first."""
        found = self.known.get(word)
        if found is None:
            found = b"".join(x.to_bytes(4, "little") for x in self.word(word.encode()))
            if len(word) <= LONGEST:
                if len(self.known) >= MEMORY:
                    self.known.clear()
                self.known[word] = found
        return found

    def encode(self, text: str) -> bytes:
        """The ids of a whole text, packed."""
        known, split = self.known.get, self.split
        out = []
        for k, piece in enumerate(self.split_added(text) if self.split_added else [text]):
            if k % 2:
                out.append(self.added[piece].to_bytes(4, "little"))
                continue
            words = split(piece)
            got = list(map(known, words))
            if None in got:
                got = [x if x is not None else self.packed(w) for x, w in zip(got, words, strict=True)]
            out += got
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.text_of.__getitem__, memoryview(ids).cast("I"))).decode("utf-8", "replace")


#: Encoders of this Python worker, by the content of their files.
_made: dict[str, Encoder] = {}


def encoder(spec: str) -> Encoder:
    if spec not in _made:
        _made.clear()
        _made[spec] = Encoder(spec)
    return _made[spec]


def specification(path: str) -> str:
    """The tokenizer file's content, read on the driver; its size is that of one vocabulary."""
    with open(path, encoding="utf-8") as f:
        return f.read()


def encode_decode(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of `docs`: id, ids (binary: 4 bytes each, the lowest first), n_tokens, decoded (string).

    No shuffle: each text is encoded where it is read. Null and empty texts give no ids and an empty decoded text; ids
    may be null or repeated and are passed through; other columns are not read. Texts are taken whole, at any length; a
    pre-token needs memory in proportion to its own length. An empty table gives an empty table.
    """
    spark = docs.sparkSession
    spec = spark.sparkContext.broadcast(specification(tokenizer))
    kind = docs.schema[id_col].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(spec.value)
        for batch in batches:
            ids = [e.encode(x or "") for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(ids, pa.binary()), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(map(e.decode, ids), pa.string())],
                names=[id_col, "ids", "n_tokens", "decoded"],
            )

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, f"`{id_col}` {kind.simpleString()}, ids binary, n_tokens bigint, decoded string")


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def digest(docs: DataFrame, tokenizer: str) -> DataFrame:
    out = encode_decode(docs, tokenizer)
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(table(spark, sf_dir, "documents"), tokenizer_path())


QUERIES = {"op8_bpe": op8_bpe}
