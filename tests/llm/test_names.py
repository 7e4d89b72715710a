"""Callers' columns keep their names and values, whatever the operators call their own."""

import re
from pathlib import Path

import corpus_pipeline
import pytest
from chunklake import llm
from chunklake.llm import simhash
from pyspark.sql import functions as F

NAME = re.compile(r"[\"']([A-Za-z_][A-Za-z_0-9]{0,20})[\"']")


def inner_names():
    """Every word between quotes in the subpackage, its own columns' names among them, and those that are made of parts."""
    found = {w for p in Path(llm.__file__).parent.glob("*.py") for w in NAME.findall(p.read_text())}
    found |= {"_key", "_may", "_block", "_gone", "_print", "_keep", "_of", "_th", "row", "_text", "c0", "c1", "c2"} | {f"w{i}" for i in range(4)}
    return sorted({w.lower() for w in found} - {"doc_id", "text"})


@pytest.fixture
def crowded(spark):
    rows = [(k, f"some words of text number {k} that are {'long ' * (k % 3)}enough\nthe same line in all of them is here" + f" {k} other things" * 20) for k in range(6)] + [(7, None), (8, ""), (1, "again with an id that is there already")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    return df.select("doc_id", "text", *(F.lit(k).alias(f"{w}") for k, w in enumerate(inner_names()) if w != "n_chars"), F.lit(5).cast("long").alias("n_chars"))


@pytest.mark.parametrize("name", ["quality rules", "line dedup", "near-duplicates", "decontamination", "fingerprints"])
def test_stages_leave_other_columns_alone(spark, crowded, sf, name):
    stage = dict(corpus_pipeline.STAGES).get(name, lambda spark, docs, sf_dir: simhash.near_dedup(docs))
    out = stage(spark, crowded, sf)
    assert out.columns == crowded.columns
    others = [c for c in crowded.columns if c not in ("doc_id", "text", "n_chars")]
    want = tuple(crowded.select(*others).first())
    got = out.select(*others).collect()
    assert all(tuple(r) == want for r in got)
    assert got or name == "quality rules"
