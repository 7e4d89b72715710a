"""A corpus pipeline: quality rules, line dedup, near-duplicate removal, benchmark decontamination, encoding.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept; run() writes each stage's rows to the
shared folder and reads them again for the next. All but the last return the columns that they get, which may be more than
those of documents and may have any names but doc_id and text twice. Null and empty texts have no words, so the first stage
rejects them; rows that share id and text are one document everywhere and stay or go together; an empty table gives an
empty result. The operators' docstrings say more.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chunklake.llm import bpe, contamination, lines, nearcopies, quality
from chunklake.llm.common import table, written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the rules go, null and empty texts among them."""
    return quality.keep_good(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that are similar to an earlier one go; n_chars, where there is such a column, follows the text. A text may end up empty; null stays null."""
    out = lines.dedup_lines(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (five-word shingles, Jaccard 0.8 or more) the document of the smallest id stays. Texts that line dedup left empty are one group."""
    return nearcopies.near_dedup(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go; items that are null, or have no word, are in none."""
    return contamination.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Digests of each text's token ids, and of what they decode to; one row for each document, null text as empty."""
    return bpe.digest(docs, bpe.tokenizer_path())


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("near-duplicates", near_dedup),
    ("decontamination", decontamination),
    ("encoding", encoding),
]

#: Suffix arrays, fingerprints and encoding are beyond SQL; tests/llm/ holds the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
