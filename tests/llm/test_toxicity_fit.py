"""Training of the toxicity machine: what it reads, and its folded sum against the plain kernel."""

import itertools
import random
import zlib

import numpy as np
import pytest

from chunklake.llm import toxicity

BAD = ["idiot", "moron", "scum", "pathetic"]


def texts(n):
    rnd = random.Random(9)
    out = []
    for i in range(n):
        w = ["".join(rnd.choice("thenrdaliou") for _ in range(rnd.randint(3, 7))) for _ in range(rnd.randint(5, 25))]
        if i % 3 == 0:
            w.insert(rnd.randrange(len(w)), rnd.choice(BAD))
        out.append((i, " ".join(w)))
    return out


def held(i):
    return zlib.crc32(str(i).encode()) % 5 == 0


def plain(s, t):
    return sum(toxicity.DECAY ** (a[-1] - a[0] + b[-1] - b[0] + 2) for a in itertools.combinations(range(len(s)), 3) for b in itertools.combinations(range(len(t)), 3) if [s[k] for k in a] == [t[k] for k in b])


def test_characters_outside_the_alphabet_equal_nothing():
    alphabet = np.array(sorted(map(ord, "abc")), np.uint32)
    marks = ["abcab", "xbay"]
    got = toxicity.kernel(["xbzaby", "abab", "uvwxyz"], toxicity._features(marks, alphabet), alphabet)
    inside = lambda s: "".join(c if c in "abc" else chr(0x4E00 + k) for k, c in enumerate(s))
    for i, s in enumerate(["xbzaby", "abab", "uvwxyz"]):
        for j, t in enumerate(marks):
            # Renamed apart, characters outside the alphabet agree with none of the other string.
            apart = plain(inside(s), inside(t).translate({k: k + 0x100 for k in range(0x4E00, 0x4F00)}))
            assert got[i, j] == pytest.approx(apart / (plain(s, s) * plain(t, t)) ** 0.5, rel=1e-4, abs=1e-7)


def test_fit_reads_what_is_not_held_out(spark):
    rows = texts(400)
    long = "clean words here " * 3000
    rows += [(1000, None), (1001, ""), (1002, long + "idiot"), (1003, long)]
    labels = [(i, int(i % 3 == 0)) for i, _ in rows[:400]] + [(1000, 0), (1001, None), (1002, 1), (1003, 0), (5000, 1), (1, 0)]
    docs = spark.createDataFrame(rows, "doc_id int, text string")
    fitted = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id int, toxic int"))
    of = {i: y for i, y in labels if y is not None}
    order = [(t, of[i]) for i, t in rows if i in of and not held(i)]
    direct = toxicity.train(order)
    words = sorted({w for _, t in rows[:50] for w in t.split() if len(w) >= 3})
    assert fitted.margins(words) == pytest.approx(direct.margins(words), abs=1e-4)
    # Labels of held-out documents change nothing.
    flipped = [(i, 1 - y if y is not None and held(i) else y) for i, y in labels]
    again = toxicity.fit(docs, spark.createDataFrame(flipped, "doc_id int, toxic int"))
    assert again.margins(words) == pytest.approx(fitted.margins(words), abs=1e-6)
    got = {r.doc_id: r for r in toxicity.scores(docs, fitted).collect()}
    assert got[1002].predicted == 1 and got[1003].predicted == 0
    assert sum(got[i].predicted == int(i % 3 == 0) for i in range(400) if held(i)) >= 0.9 * sum(map(held, range(400)))


def test_folded_machine_is_the_sum_over_landmarks():
    alphabet, marks = np.array(sorted(map(ord, "idotmrn")), np.uint32), ["idiot", "moron", "tidy"]
    marked = toxicity._features(marks, alphabet)
    share = np.array([0.7, -0.4, 0.2])
    m = toxicity.Machine(alphabet, (marked.T @ share).astype(np.float64), 0.3, 1.0, 0.0, 0.0)
    words = ["idxiot", "dotty", "mirror", "zzz"]
    assert m.margins(words) == pytest.approx(toxicity.kernel(words, marked, alphabet) @ share + 0.3, abs=1e-5)
