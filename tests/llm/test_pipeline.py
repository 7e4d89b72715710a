"""The pipeline against its stages' plain versions."""

import hashlib
import random

import corpus_pipeline
from chunklake.llm import bpe, quality

from . import brute
from .test_llm import prose
from .test_nearcopies import kept


def test_pipeline(spark, tmp_path):
    rnd = random.Random(11)
    item = prose(rnd, 40, "abcdefghijkl")
    base = [prose(rnd, 90, "abcdefghijklmnop") for _ in range(8)]
    rows = [(k, rnd.choice(base) + "\n" + prose(rnd, 60, "abcdefghijklmnop") if k % 3 else base[k % 8]) for k in range(30)]
    rows += [(100, prose(rnd, 70) + "\n" + item), (101, "short"), (102, None), (103, "same words " * 80)]
    spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("doc_id", "text", "'en' as lang", "'s' as source", "cast(length(text) as bigint) as n_chars").write.parquet(f"file://{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(f"file://{tmp_path}/benchmark.parquet")

    limits = quality.Limits()
    left = {}
    for i, t in rows:
        n, _, _, _, three, covered, longest = brute.quality(t, limits.repeat_len)
        if n >= 50 and 100 * three <= 50 * n and covered <= limits.max_covered * n and longest <= limits.max_longest * n:
            left[i] = t
    left = {i: t for i, (_, t) in brute.lines(left.items()).items()}
    alone = kept(left.items())
    left = {i: t for i, t in left.items() if i in alone}
    leaked = {i for i, _ in brute.contained(left.items(), [(1, item)])}
    left = {i: t for i, t in left.items() if i not in leaked}
    assert leaked == {100} and 5 < len(left) < 30
    e = bpe.Encoder(bpe.specification(bpe.tokenizer_path()))
    expected = {i: (len(e.encode(t)) // 4, hashlib.sha256(e.encode(t)).hexdigest(), hashlib.sha256(t.encode()).hexdigest()) for i, t in left.items()}

    docs = spark.read.parquet(f"file://{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        new = stage(spark, docs, f"file://{tmp_path}")
        assert new.schema.simpleString() == docs.schema.simpleString()
        docs = new
    got = {r.doc_id: tuple(r)[1:] for r in corpus_pipeline.run(spark, f"file://{tmp_path}").collect()}
    assert got == expected


def test_pipeline_of_odd_tables(spark, tmp_path):
    """No rows; repeated rows and ids, nulls everywhere, columns that clash."""
    kinds = "doc_id bigint, text string, lang string, source string, n_chars bigint, key string, gone int, w0 bigint"
    text = " ".join(f"word{k}" for k in range(80))
    rows = [(1, text, None, None, None, "a", 1, 2), (1, text, None, None, None, "a", 1, 2), (1, "other " + text.upper(), "en", "s", 5, None, None, None), (None, None, None, None, None, None, None, None), (None, text, "en", "s", 5, "b", 3, 4), (2, "", "en", "s", 0, "c", 5, 6)]
    for k, some in enumerate(([], rows)):
        at = f"file://{tmp_path}/{k}"
        spark.createDataFrame(some, kinds).write.parquet(f"{at}/documents.parquet")
        spark.createDataFrame([(None, None), (1, ""), (2, None)], "item_id bigint, text string").write.parquet(f"{at}/benchmark.parquet")
        got = corpus_pipeline.run(spark, at)
        assert got.columns[0] == "doc_id"
        assert {r.doc_id for r in got.collect()} == ({1} if some else set())
