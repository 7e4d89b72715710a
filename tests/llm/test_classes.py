"""The class model against plain versions: bigrams, moves of the exchange, classes of other words, and scores."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from chunklake.llm import brown

from . import brute

HEAD = 12
OUT = "doc_id % 5 = 1"


@pytest.fixture(scope="module")
def texts():
    rnd = random.Random(3)
    names, verbs, more = ["ann", "bob", "cy", "dee"], ["sees", "hits", "likes"], ["the", "a"]
    out = []
    for i in range(120):
        w = [x for _ in range(rnd.randint(0, 12)) for x in (rnd.choice(names), rnd.choice(verbs), rnd.choice(more), rnd.choice(["dog", "cat", "house", f"thing{rnd.randint(0, 30)}"]))]
        out.append((i, " ".join(w + ["no"] * (i % 4))))
    return [*out, (200, None), (201, ""), (202, "Only ONE"), (203, "no no no no"), (206, "never seen words é")]


@pytest.fixture(scope="module")
def fitted(spark, texts):
    docs = spark.createDataFrame(texts, "doc_id int, text string").repartition(3)
    blocks = brown.encoded(docs, F.expr(OUT)).cache()
    head = brown.head_of(brown.vocabulary(blocks), HEAD)
    counts = brown.bigrams(blocks, head)
    return blocks, head, counts


def training(texts):
    return [[*brute.words(t), brown.END] for i, t in texts if i % 5 != 1]


def named(head, texts):
    """Places of the head's words, by word."""
    every = {w for t in training(texts) for w in t}
    where = {h: k for k, h in enumerate(head.hashes.tolist())}
    signed = lambda w: int(np.array([brown._hash(w)], np.uint64).view(np.int64)[0])
    return {w: signed(w) for w in every}, where


def test_bigrams(fitted, texts):
    _, head, counts = fitted
    hashes, where = named(head, texts)
    place = lambda w: HEAD + 1 if w == brown.END else where.get(hashes[w], HEAD)
    plain = Counter((place(a), place(b)) for t in training(texts) for a, b in zip([brown.END, *t], t, strict=False))
    assert {(a, b): int(counts[a, b]) for a, b in zip(*np.nonzero(counts), strict=True)} == plain


def test_each_move_gains_most(fitted):
    _, head, counts = fitted
    size = head.size

    def info(classes):
        return brown.information(brown.by_class(counts, np.append(classes, [head.rare, head.end]), size))

    classes = head.classes.copy()
    for w in np.lexsort((np.arange(HEAD), -head.counts)):
        by = []
        for b in range(head.words_classes):
            classes[w] = b
            by.append(info(classes))
        classes[w] = int(np.argmax(by))
    once = brown.exchange(head, counts, 1)
    assert info(once) == pytest.approx(info(classes)) and info(once) >= info(head.classes)
    assert info(brown.exchange(head, counts, 3)) >= info(once) - 1e-6


@pytest.mark.parametrize("rows", [10_000, 3])
def test_classes_and_scores(spark, fitted, texts, rows):
    blocks, head, counts = fitted
    head = brown.Head(head.hashes, head.counts, brown.exchange(head, counts), head.words_classes, head.total, head.distinct)
    pairs = brown.by_class(counts, head.place_classes, head.size)
    assert (pairs >= 0).all() and (pairs.sum(axis=0) == pairs.sum(axis=1)).all()
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    try:
        rest = {r.h: (r.n, r.c) for r in brown.others(blocks, head, pairs).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    hashes, where = named(head, texts)
    train = training(texts)
    n = Counter(w for t in train for w in t)
    assert {h for h in rest} == {hashes[w] for w in n if w != brown.END and hashes[w] not in where}
    first = {w: head.end if w == brown.END else int(head.classes[where[hashes[w]]]) if hashes[w] in where else head.rare for w in n}
    step = brown.gains(pairs, head.words_classes)
    final = dict(first)
    for w in n:
        if w == brown.END or hashes[w] in where:
            continue
        if n[w] > 1:
            total = sum(step[first[a]] + step[head.size + first[c]] for t in train for a, b, c in zip([brown.END, *t], t, t[1:], strict=False) if b == w)
            final[w] = int(np.argmax(total))
        assert rest[hashes[w]] == (n[w], final[w])
    # Scores, given the classes.
    size = head.size
    move = Counter((final[a], final[b]) for t in train for a, b in zip([brown.END, *t], t, strict=False))
    of, tokens, kinds = Counter(), Counter(), Counter(final.values())
    for (a, b), k in move.items():
        of[a] += k
        tokens[b] += k
    kinds[head.rare] += 1

    def score(text):
        out, a = 0.0, head.end
        for w in [*brute.words(text), brown.END]:
            b = final.get(w, head.rare)
            out += math.log10((move[a, b] + brown.TRANSITION) / (of[a] + brown.TRANSITION * size))
            if w != brown.END:
                out += math.log10((n[w] + brown.EMISSION) / (tokens[b] + brown.EMISSION * kinds[b]))
            a = b
        return out

    docs = spark.createDataFrame(texts, "doc_id int, text string").repartition(2)
    got = {r.doc_id: r.score for r in brown.scores(docs, F.expr(OUT), head_words=HEAD).collect()}
    assert got == {i: pytest.approx(score(t)) for i, t in texts}
    # Emissions and transitions are shares.
    for c in range(size):
        assert sum((move[c, b] + brown.TRANSITION) / (of[c] + brown.TRANSITION * size) for b in range(size)) == pytest.approx(1)


def test_classes_grow_with_the_vocabulary(spark):
    def classes(k):
        vocab = spark.range(k).select((F.col("id") + 1).alias("h"), F.lit(2).cast("bigint").alias("n"))
        return brown.head_of(vocab, 3).words_classes

    assert classes(10) < classes(10_000) < classes(200_000)


def test_packed_numbers():
    x = np.array([0, 1, 255, 256, 70_000, 2**32 - 1], np.uint32)
    assert (brown.unpacked(brown.packed(x)) == x).all() and len(brown.unpacked(brown.packed(x[:0]))) == 0
