"""The pipeline's near-duplicate stage against a plain comparison of all pairs."""

import random

import corpus_pipeline

from . import brute
from .test_llm import ODD, prose


def shingles(text):
    w = brute.words(text)
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def similar(a, b):
    return a == b or 5 * len(a & b) >= 4 * len(a | b)


def kept(rows):
    sets = {i: shingles(t) for i, t in rows}
    left, out = set(sets), set()
    while left:
        out.add(min(left))
        queue = [min(left)]
        left -= set(queue)
        while queue:
            at = queue.pop()
            new = {i for i in left if similar(sets[at], sets[i])}
            left -= new
            queue += new
    return out


def test_near_copies_go(spark, frame):
    rnd = random.Random(3)
    base = [prose(rnd, rnd.randint(60, 300), "abcdefghijklm") for _ in range(20)]
    rows = []
    for i in range(160):
        w = rnd.choice(base).split(" ")
        for _ in range(rnd.randint(0, max(1, len(w) // 30))):
            w[rnd.randrange(len(w))] = prose(rnd, 1, "nopq")
        rows.append((i, " ".join(w)))
    rows += [(200 + k, base[k][: len(base[k]) // 2] + " " + prose(rnd, 40)) for k in range(20)] + ODD
    expected = kept(rows)
    got = corpus_pipeline.near_dedup(spark, frame(rows, extra=True).repartition(3), "")
    assert got.columns == frame([], extra=True).columns
    assert sorted(r.doc_id for r in got.collect()) == sorted(expected)
    assert 40 < len(expected) < 120


def test_odd_rows(spark, frame):
    t = "some words that are long enough to be compared with others"
    got = corpus_pipeline.near_dedup(spark, frame([(3, t), (1, t), (1, t.upper()), (None, t), (None, "alone here"), (5, None), (6, "")]), "")
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=str) == [(1, t.upper()), (1, t), (5, None), (None, "alone here")]
    assert corpus_pipeline.near_dedup(spark, frame([]), "").count() == 0
