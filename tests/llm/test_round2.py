"""Findings of the second round: what a stage does may not outgrow what it must, and rows stay those of the plain versions."""

import random

import numpy as np
from pyspark.sql import functions as F

from chunklake.llm import brown, nearcopies, suffixes

from .test_llm import prose
from .test_nearcopies import kept



def test_collections_sort_windows_not_all_suffixes(monkeypatch):
    rnd = random.Random(5)
    base = [bytes(rnd.choice(b"abc\xff") for _ in range(168)) for _ in range(20)]
    strings = [b"", b"short", b"q" * 130]
    for _ in range(200):
        x = bytearray(rnd.choice(base))
        x[rnd.randrange(168)] = rnd.randrange(256)
        strings.append(bytes(x[rnd.randrange(40) :]))
    windows = [(x[k : k + 100], i, k) for i, x in enumerate(strings) for k in range(len(x) - 99)]
    seen, expected = set(), []
    for w, i, k in windows:
        expected += [(i, k)] if w in seen else []
        seen.add(w)
    sorted_, sort = [], np.argsort
    monkeypatch.setattr(np, "argsort", lambda x, *a, **k: sorted_.append(len(x)) or sort(x, *a, **k))
    assert sorted(map(tuple, suffixes.repeated_windows(strings).tolist())) == sorted(expected)
    assert len(expected) > 500 and sum(sorted_) < 26 * len(windows)
    who, start, rank = suffixes.sorted_windows(strings)
    made = [strings[w][k : k + 100] for w, k in zip(who, start, strict=True)]
    assert made == sorted(made) and len(set(made)) == len(set(rank.tolist()))
    assert all(made.count(x) > 1 for x in made[:50])
    # The whole suffixes' order is that of the windows.
    w, n, _ = suffixes.sorted_suffixes(strings)
    assert [x for x in (strings[a][len(strings[a]) - b :][:100] for a, b in zip(w, n, strict=True)) if len(x) == 100 and x in set(made)] == made


def test_a_common_passage_does_not_pair_all_texts(spark, frame, monkeypatch):
    rnd = random.Random(9)
    passage = prose(rnd, 40, "hijklmn")
    rows = [(i, f"{prose(rnd, rnd.randint(30, 50))} {passage} {prose(rnd, 30)}") for i in range(200)]
    # Texts that are little more than the passage, in steps of similarity, and copies of some that hold it.
    rows += [(300 + i, f"{passage} {prose(rnd, i % 14)}") for i in range(60)]
    rows += [(400 + i, rows[i][1] + " and more") for i in range(40)]
    met, apart = [], nearcopies._apart
    monkeypatch.setattr(nearcopies, "_apart", lambda postings, pct: met.append(postings.groupBy("h").count().selectExpr("sum(count * count)").first()[0]) or apart(postings, pct))
    got = nearcopies.near_dedup(frame(rows, extra=True).repartition(3))
    assert sorted(r.doc_id for r in got.collect()) == sorted(kept(rows))
    # By hash alone each of 200 texts met each other at a dozen hashes.
    assert (met[0] or 0) < 200 * len(rows)


def test_prefixes_by_frequency(spark):
    rnd = random.Random(2)
    common = list(range(1000, 1020))
    sets = [(r, sorted(common + [rnd.randrange(10**6, 10**18) for _ in range(50)] if r else common)) for r in range(300)]
    got = {x.r: x for x in nearcopies._by_frequency(spark.createDataFrame(sets, "r bigint, grams array<bigint>").repartition(3), 80).collect()}
    assert all(got[r].n == len(s) and len(got[r].head) == nearcopies._prefix(len(s), 80) for r, s in sets)
    assert not any(set(common) & set(got[r].head) for r in range(1, 300)) and got[0].head == common[:7]


def test_words_classes_keep_no_shuffle(frame, monkeypatch):
    rnd = random.Random(4)
    plans, labelled = [], brown.labelled
    monkeypatch.setattr(brown, "labelled", lambda blocks, head, rest, buckets: plans.append(rest._jdf.queryExecution().executedPlan().toString()) or labelled(blocks, head, rest, buckets))
    got = brown.scores(frame([(i, prose(rnd, 60)) for i in range(40)]).repartition(2), F.col("doc_id") % 5 == 1, head_words=20).collect()
    assert len(got) == 40 and all(r.score < 0 and r.n_tokens == 61 for r in got)
    assert len(plans) == 1 and "Exchange" not in plans[0]
