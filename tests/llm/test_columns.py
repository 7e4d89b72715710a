"""The columns that queries return, in their order."""

from chunklake.llm import quality


def test_quality_columns(spark, sf):
    out = quality.op6_quality(spark, sf)
    assert out.columns[:8] == ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
