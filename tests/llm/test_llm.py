"""The operators against plain versions, with nulls, empty and long texts, ties, repeated rows, empty tables and clashing names."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from chunklake.llm import anchors, bpe, brown, common, components, contamination, counts, lines, quality, simhash, suffixes, toxicity, urls

from . import brute

ODD = [(900, None), (901, ""), (902, " \t\n"), (903, "one"), (904, "one"), (905, "a " * 3000), (906, "x" * 5000), (907, "é漢字 😀 <|endoftext|> it's 12"), (908, "two words")]


def prose(rnd, n, letters="abcdefg"):
    return " ".join("".join(rnd.choice(letters) for _ in range(rnd.randint(1, 6))) for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    rnd = random.Random(7)
    base = [prose(rnd, rnd.randint(20, 160)) for _ in range(25)]
    rows = []
    for i in range(90):
        t = rnd.choice(base)
        if rnd.random() < 0.5:
            w = t.split(" ")
            w[rnd.randrange(len(w))] = "changed"
            t = " ".join(w)
        if rnd.random() < 0.4:
            t += "\n" + rnd.choice(base)[: rnd.randint(90, 300)] + "\n" + prose(rnd, 12)
        rows.append((i, t))
    return rows + ODD


# 1


def _removed(df):
    return {r[0]: tuple(r)[1:] for r in suffixes.dedup_substrings(df).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256)).collect()}


@pytest.mark.parametrize("largest", [suffixes.LARGEST, 3])
def test_substrings(frame, corpus, monkeypatch, largest):
    monkeypatch.setattr(suffixes, "LARGEST", largest)
    got = _removed(frame(corpus, extra=True).repartition(3))
    assert got == brute.substrings(corpus)
    assert sum(x[1] for x in got.values()) > 1000


def test_substrings_of_odd_rows(frame):
    t = "q" * 120 + "w" * 120
    got = _removed(frame([(None, t), (1, t), (2, t), (2, t)]))
    assert got[1] == brute.substrings([(1, t)])[1]
    assert got[2][1] == 240 and got[None][1] == 240
    assert suffixes.dedup_substrings(frame([])).count() == 0


def test_suffixes_are_sorted():
    rnd = random.Random(1)
    strings = [bytes(rnd.choice(b"ab\xff") for _ in range(rnd.randint(0, 12))) for _ in range(30)]
    who, length, before = suffixes.sorted_suffixes(strings)
    made = [strings[w][len(strings[w]) - n :] for w, n in zip(who, length, strict=True)]
    assert made == sorted(s[k:] for s in strings for k in range(len(s) + 1))
    assert all(b == (strings[w][len(strings[w]) - n - 1] + 1 if n < len(strings[w]) else 0) for w, n, b in zip(who, length, before, strict=True))


def test_long_texts_lose_no_window(monkeypatch):
    rnd = random.Random(3)
    text = bytes(rnd.choice(b"abc") for _ in range(3000))
    whole = [(int(a), k) for r in anchors.runs([text]) for a, b in zip(r.first, r.last, strict=True) for k in range(a, b + 1)]
    monkeypatch.setattr(anchors, "CHUNK", 500)
    cut = [k for r in anchors.runs([b"", text, b"short"]) for a, b in zip(r.first, r.last, strict=True) for k in range(a, b + 1)]
    assert sorted(k for _, k in whole) == sorted(cut) == list(range(3000 - 99))


# 2


def test_edits_equal_a_full_count():
    e = bpe.Encoder(bpe.specification(bpe.tokenizer_path()))
    rnd = random.Random(3)
    some = lambda n: "".join(rnd.choice("aab'sre  \n\t é12.!?") for _ in range(n)) + rnd.choice(["", "", "<|endoftext|>", "<|endof"])
    for _ in range(400):
        t = counts.Tree(some(rnd.randint(0, 60)), e)
        for _ in range(4):
            at, n, put = rnd.randint(0, len(t.text) + 2), rnd.randint(0, 12), some(rnd.randint(0, 6)) if rnd.random() < 0.7 else ""
            expected = t.text[:at] + put + t.text[at + n :]
            t.edit(at, n, put)
            assert t.text == expected and t.tokens == len(e.encode(expected)) // 4 and int(t.sums[0, 1]) == len(expected)


def test_counts_and_kept_trees(spark, frame):
    path = bpe.tokenizer_path()
    first = counts.counted(frame(ODD, extra=True), path)
    e = bpe.Encoder(bpe.specification(path))
    assert {r.doc_id: r.n_tokens for r in first.collect()} == {i: len(e.encode(t or "")) // 4 for i, t in ODD}
    again = first.select("doc_id", "text", "tree").withColumn("edits", counts.standard_edits(F.col("text")))
    for r in counts.counted(again, path, "edits", "tree").collect():
        assert r.n_after == len(e.encode(r.text)) // 4
    long = counts.counted(frame([(1, "some words here " * 3000)]).withColumn("edits", counts.standard_edits(F.col("text"))), path, "edits").first()
    assert long.n_encoded < 400
    assert counts.counted(frame([]), path).count() == 0


# 3


def test_urls(spark):
    pages = [(1, "http://a.example.org/es/x?y#z"), (2, "HTTPS://Example.ORG/en/12"), (3, "x://b.com/fr/1"), (4, "x://com/de/"), (5, None), (6, "no scheme/de/"), (7, "x://org"), (8, "x://notorg/"), (9, "x://.org/"), (9, "x://.org/"), (None, "x://example.org/en/2"), (10, "x://a.com/DE/"), (11, "http://?q"), (12, "x://" + "a." * 300 + "com/de/" + "p" * 3000)]
    df = spark.createDataFrame(pages, "page_id bigint, url string").withColumn("host", F.lit("clash")).withColumn("rule", F.lit(1))
    rules = spark.createDataFrame([*urls.RULES, (None, "/", "block"), ("org", "/", "allow")], "host string, path string, verdict string")
    got = sorted(((r.page_id, r.rule, r.verdict) for r in urls.url_verdicts(df, rules).collect()), key=str)
    expected = {1: ("example.org/es/", "block"), 2: ("example.org/en/1", "block"), 3: ("com/fr/", "allow"), 4: ("com/de/", "block"), 9: ("org/", "allow"), None: ("org/", "allow"), 12: ("com/de/", "block")}
    assert got == sorted(((i, *expected.get(i, (None, "allow"))) for i, _ in pages), key=str)
    assert urls.url_verdicts(df.limit(0), rules).count() == 0
    assert {r.verdict for r in urls.url_verdicts(df, rules.limit(0), "block").collect()} == {"block"}


def test_bloom_never_loses_a_key(spark):
    keys = spark.range(3000).select(F.concat(F.lit("k"), F.col("id")).alias("key"))
    bloom = urls.blocked_bloom(keys, "key", 128)
    assert urls.may_contain(keys, "key", bloom, 128).count() == 3000
    others = spark.range(3000, 9000).select(F.concat(F.lit("k"), F.col("id")).alias("key"))
    assert urls.may_contain(others, "key", bloom, 128).count() < 1200


# 4


def test_contamination(spark, frame):
    rnd = random.Random(5)
    items = [(j, prose(rnd, rnd.choice([1, 3, 5, 8, 30, 90]), "abcdefghij")) for j in range(24)] + [(50, None), (51, ""), (52, "?!")]
    rows = []
    for i in range(60):
        w = items[rnd.randrange(24)][1].split(" ")
        if rnd.random() < 0.4:
            w[rnd.randrange(len(w))] = "other"
        rows.append((i, prose(rnd, rnd.randint(0, 60)) + " " + ", ".join(w).upper() + ". " + prose(rnd, 9)))
    table = spark.createDataFrame(items, "item_id bigint, text string").withColumn("k", F.lit(1))
    got = {(r.doc_id, r.item_id): (r.n_shingles, r.n_found) for r in contamination.contained(frame(rows + ODD, extra=True), table).collect()}
    assert got == brute.contained(rows + ODD, items) and len(got) > 10
    left = contamination.decontaminate(frame(rows + ODD, extra=True), table)
    assert left.columns == frame([], extra=True).columns
    assert {r.doc_id for r in left.collect()} == {i for i, _ in rows + ODD} - {i for i, _ in got}
    assert contamination.contained(frame([]), table).count() == 0
    assert contamination.contained(frame(rows), table.limit(0)).count() == 0


# 5


@pytest.mark.parametrize("bucket", [simhash.BUCKET, 2])
def test_simhash(frame, corpus, monkeypatch, bucket):
    monkeypatch.setattr(simhash, "BUCKET", bucket)
    got = {r.doc_id: (r.fingerprint & (2**64 - 1), r.component_id) for r in simhash.near_duplicates(frame(corpus, extra=True)).collect()}
    prints = {i: brute.fingerprint(t) for i, t in corpus}
    roots = brute.components(prints)
    assert got == {i: (prints[i], roots[i]) for i in prints}
    assert len(set(roots.values())) < len(roots)


def test_links_lose_nothing(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BUCKET", 8)
    rnd = random.Random(2)
    base = [rnd.getrandbits(64) for _ in range(12)]
    values = {b ^ sum(1 << k for k in rnd.sample(range(64), rnd.randint(0, 4))) for b in base for _ in range(20)}
    signed = [v - (1 << 64) if v >> 63 else v for v in sorted(values)]
    got = components.components(simhash.links(spark.createDataFrame([(v,) for v in signed], "fp bigint")))
    expected = brute.components({v: v & (2**64 - 1) for v in signed})
    assert {r.node: r.root for r in got.collect()} == {k: v for k, v in expected.items() if sum(1 for x in expected.values() if x == v) > 1}


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(7, 7), (None, 3), (100, 99)], "u bigint, v bigint")
    got = {r.node: r.root for r in components.components(edges).collect()}
    assert got == {k: 0 for k in range(41)} | {99: 99, 100: 99}


def test_near_dedup(frame):
    t = "some words that are long enough to be compared with others"
    kept = simhash.near_dedup(frame([(3, t), (1, t), (None, t), (None, "alone here with several words"), (5, None), (6, "")], extra=True))
    assert kept.columns == frame([], extra=True).columns
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == [(1, t), (5, None), (None, "alone here with several words")]
    assert simhash.near_dedup(frame([])).count() == 0


# 6


def test_quality(frame):
    rnd = random.Random(2)
    rows = [(i, "".join(rnd.choice("ab \n#é") for _ in range(rnd.randint(0, 90)))) for i in range(60)] + ODD[:5] + [(905, "a " * 120)]
    got = {r.doc_id: tuple(r)[1:8] for r in quality.verdicts(frame(rows, extra=True), quality.Limits(repeat_len=4)).collect()}
    assert got == {i: brute.quality(t, 4) for i, t in rows}
    assert quality.verdicts(frame([])).count() == 0


def test_quality_keeps_clean_texts(frame):
    rnd = random.Random(9)
    clean, phrase = prose(rnd, 200, "abcdefghijklm"), prose(rnd, 30, "abcdefghijklm")
    rows = [(1, clean), (2, clean + " " + phrase + " " + phrase), (3, (phrase + "\n") * 9), (4, "short"), (5, None)]
    kept = quality.keep_good(frame(rows, extra=True))
    assert kept.columns == frame([], extra=True).columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 2]


# 7


def test_language_model(frame, corpus):
    out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 1
    got = {r.doc_id: r for r in brown.scores(frame(corpus, extra=True).repartition(3), out).collect()}
    for i, (held, n, known, total, base) in brute.unigram(corpus).items():
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held, n, known, total)
        assert r.base_score == pytest.approx(base) and r.score < 0
    assert sum(r.score for r in got.values()) > sum(r.base_score for r in got.values())


def test_language_model_without_training(frame):
    r = brown.scores(frame([(1, "a b"), (None, None)]), F.lit(True)).collect()
    assert {(x.doc_id, x.n_tokens, x.n_known, x.train_tokens) for x in r} == {(1, 3, 0, 0), (None, 1, 0, 0)}
    assert brown.scores(frame([]), F.lit(False)).count() == 0


# 8


def test_encoding_equals_the_tokenizer(frame, corpus):
    from tokenizers import Tokenizer

    path = bpe.tokenizer_path()
    t = Tokenizer.from_file(path)
    for r, (_, text) in zip(sorted(bpe.encode_decode(frame(corpus, extra=True), path).collect()), sorted(corpus), strict=True):
        ids = t.encode(text or "", add_special_tokens=False).ids
        assert list(memoryview(bytes(r.ids)).cast("I")) == ids and r.n_tokens == len(ids)
        assert r.decoded == t.decode(ids, skip_special_tokens=False)
    assert bpe.encode_decode(frame([]), path).count() == 0


def test_digest(frame):
    r = bpe.digest(frame([(1, None)]), bpe.tokenizer_path()).first()
    assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (0, hashlib.sha256(b"").hexdigest(), hashlib.sha256(b"").hexdigest())


# 9


def test_lines(frame, corpus):
    got = {r.doc_id: (r.n_removed, r.text or "") for r in lines.dedup_lines(frame(corpus, extra=True), counts=True).collect()}
    expected = brute.lines(corpus)
    assert got == expected and sum(n for n, _ in expected.values()) > 20


def test_lines_of_odd_rows(frame):
    t = "alpha beta gamma delta epsilon\n\nalpha beta gamma delta epsilon\nzeta"
    rows = [(None, "zeta\nother"), (1, t), (2, "epsilon delta gamma beta alpha\r"), (3, None), (1, t)]
    got = sorted(((r.doc_id, r.text) for r in lines.dedup_lines(frame(rows, extra=True)).collect()), key=str)
    once = "alpha beta gamma delta epsilon\n\nzeta"
    assert got == sorted([(None, "other"), (1, once), (1, once), (2, ""), (3, None)], key=str)
    assert lines.dedup_lines(frame([])).count() == 0


# 10


def test_toxicity_on_held_out_texts(frame):
    rnd = random.Random(4)
    bad = ["idiot", "moron", "scum", "pathetic", "stupid"]

    def text(y):
        w = prose(rnd, rnd.randint(5, 40), "thenrdaliou").split(" ")
        if y:
            w.insert(rnd.randrange(len(w)), rnd.choice(bad))
        return " ".join(w)

    rows = [(text(k % 4 == 0), int(k % 4 == 0)) for k in range(900)]
    m = toxicity.train(rows[:700])
    tests = [(i, t) for i, (t, _) in enumerate(rows[700:])] + ODD
    got = {r.doc_id: r for r in toxicity.scores(frame(tests, extra=True), m).collect()}
    right = sum(got[i].predicted == y for i, (_, y) in enumerate(rows[700:]))
    assert right >= 195 and all(0 <= r.score <= 1 for r in got.values()) and got[900].predicted == got[901].predicted == 0
    gapped = {r.doc_id: r.predicted for r in toxicity.scores(frame([(1, "you i d i o t there"), (2, "you i-d-i-o-t"), (3, "a stu.pid thing")]), m).collect()}
    assert gapped == {1: 1, 2: 1, 3: 1}
    assert toxicity.scores(frame([]), m).count() == 0


def test_toxicity_with_one_class():
    m = toxicity.train([("a text here", 0), (None, 0)])
    assert float(m.probability(m.margins(["some"]))[0]) < 0.5
    assert toxicity.train([]) is not None


def test_string_kernel_counts_subsequences():
    import itertools

    import numpy as np

    def plain(s, t):
        return sum(toxicity.DECAY ** (a[-1] - a[0] + b[-1] - b[0] + 2) for a in itertools.combinations(range(len(s)), 3) for b in itertools.combinations(range(len(t)), 3) if [s[k] for k in a] == [t[k] for k in b])

    alphabet = np.array(sorted(map(ord, "abc")), np.uint32)
    marks = ["abcab", "cba"]
    got = toxicity.kernel(["abab", "abxcab", "bcaabc"], toxicity._features(marks, alphabet), alphabet)
    for i, s in enumerate(["abab", "abxcab", "bcaabc"]):
        for j, t in enumerate(marks):
            assert got[i, j] == pytest.approx(plain(s, t) / (plain(s, s) * plain(t, t)) ** 0.5, rel=1e-4)


def test_written_tables_are_cut_off(spark):
    df = common.written(spark.range(5).select((F.col("id") + 1).alias("x")), "t")
    assert df.count() == 5 and "Range" not in df._jdf.queryExecution().optimizedPlan().toString()
