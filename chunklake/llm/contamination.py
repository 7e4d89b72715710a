"""Benchmark decontamination by size-partitioned MinHash containment search (operator 4); DataFrame operations only.

A document that contains a share c of an item's n shingles lacks at most (1-c)·n of them. So of the item's K smallest
shingle hashes (a bottom-K MinHash sketch) it has at least K - (1-c)·n. Items are partitioned by size; each partition's K
follows from its largest size, so that at least SPARE sketch hashes must be found (or all of a small item's needed ones):
no item is missed, whatever the document's length. Candidates are verified on the shingles' texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import positional, restored, same_key, table, text_key, written
from .urls import blocked_bloom, filter_blocks, mark, may_contain

WORDS = 5
CONTAINMENT_PCT = 80
#: Sketch hashes that a document must share at least, in partitions of items large enough.
SPARE = 6


def words(text: Column) -> Column:
    """Runs of letters and digits in lower case, so that case and punctuation don't matter."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def _shingles(w: str, k: int, made) -> Column:
    """`made` of the k words from each place on, as an array; `w` names a column."""
    return F.transform(F.when(F.size(w) >= k, F.sequence(F.lit(0), F.size(w) - k)), lambda i: made(*(F.get(F.col(w), i + j) for j in range(k))))


def _text(*parts: Column) -> Column:
    return F.concat_ws(" ", *parts)


def contained(docs: DataFrame, items: DataFrame, pct: int = CONTAINMENT_PCT, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """Pairs of a document and an item of which it contains at least `pct` percent of the distinct shingles: id, text_hash, item, n_shingles, n_found.

    An item of fewer words than a shingle is one shingle of all its words; one without words never matches. Null texts
    are empty. Rows of `docs` that share id and text are one document (text_hash, a key of 128 bits, tells texts of one id
    apart); so are rows of `items` that share an id, whose shingles count together. Null ids are ids like any other. Other
    columns aren't read, so their names don't matter. No items, or no documents: no pairs. The driver learns which shingle lengths there are (five at most) and counts.
    """
    item = items.select(F.col(f"`{item_col}`").alias("item"), words(F.col(f"`{item_text}`")).alias("w")).where(F.size("w") > 0).withColumn("k", F.least(F.size("w"), F.lit(WORDS)))
    ks = [r[0] for r in item.select("k").distinct().collect()]
    own = docs.select(F.col(f"`{id_col}`").alias("id"), text_key(F.col(f"`{text_col}`")).alias("text_hash"), F.col(f"`{text_col}`").alias("t"))
    if not ks:
        return own.select(F.col("id").alias(id_col), "text_hash", F.lit(None).cast(items.schema[item_col].dataType).alias(item_col), F.lit(0).cast("long").alias("n_shingles"), F.lit(0).cast("long").alias("n_found")).limit(0)

    def exploded(df: DataFrame, made, name: str, keep: list[str]) -> DataFrame:
        """A row for each shingle of each length; array_distinct keeps a text's repeats out."""
        arrays = [F.coalesce(F.array_distinct(_shingles("w", k, made)), F.array().cast("array<string>" if made is _text else "array<bigint>")) for k in ks]
        return df.select(*keep, F.explode(F.concat(*arrays) if len(arrays) > 1 else arrays[0]).alias(name))

    shingles = [item.where(F.col("k") == k).select("item", F.explode(F.arrays_zip(_shingles("w", k, _text).alias("s"), _shingles("w", k, F.xxhash64).alias("h"))).alias("z")) for k in ks]
    every = shingles[0]
    for x in shingles[1:]:
        every = every.unionByName(x)
    every = written(every.select("item", F.col("z.s").alias("s"), F.col("z.h").alias("h")).distinct(), "items")
    sizes = every.groupBy("item").agg(F.count(F.lit(1)).alias("n"))
    # The size partition 2^p .. 2^(p+1) - 1 of an item, and its K.
    at_most = F.pow(F.lit(2), F.floor(F.log2("n")) + 1).cast("long") - 1
    sizes = sizes.withColumn("k", F.floor(at_most * (100 - pct) / 100).cast("long") + SPARE)
    sketch = written(
        every.join(sizes, "item")
        .groupBy("item", "n", "k")
        .agg(F.sort_array(F.collect_set("h")).alias("hs"))
        .select("item", "n", F.explode(F.expr("slice(hs, 1, cast(least(k, size(hs)) as int))")).alias("h"), F.expr("least(k, size(hs)) - (n * %d) div 100" % (100 - pct)).alias("need")),
        "sketch",
    )
    n_keys = sketch.count()
    bloom = written(blocked_bloom(sketch.select("h").distinct(), "h", filter_blocks(n_keys)), "bloom")
    tokens = own.select("id", "text_hash", words(F.col("t")).alias("w"))
    probed = may_contain(exploded(tokens, F.xxhash64, "h", ["id", "text_hash"]), "h", bloom, filter_blocks(n_keys))
    found = probed.join(sketch, "h").groupBy("id", "text_hash", "item", "n", "need").agg(F.count(F.lit(1)).alias("hits"))
    pairs = written(found.where("hits >= need").select("id", "text_hash", "item", "n"), "candidates")

    # Verification reads the documents again, those of candidate pairs (a filter of bounded size finds them without a shuffle of texts).
    keyed = own.withColumn("key", F.xxhash64("id", "text_hash"))
    several = pairs.select(F.xxhash64("id", "text_hash").alias("key")).distinct()
    n_docs = several.count()
    of_pairs = may_contain(keyed, "key", written(blocked_bloom(several, "key", filter_blocks(n_docs)), "bloom"), filter_blocks(n_docs))
    texts = exploded(of_pairs.select("id", "text_hash", words(F.col("t")).alias("w")), _text, "s", ["id", "text_hash"]).join(every.select("item", "s"), "s")
    counted = texts.groupBy("id", "text_hash", "item").agg(F.count_distinct("s").alias("n_found"))
    a, b = pairs.alias("a"), counted.alias("b")
    same = F.col("a.id").eqNullSafe(F.col("b.id")) & (F.col("a.text_hash") == F.col("b.text_hash")) & F.col("a.item").eqNullSafe(F.col("b.item"))
    return a.join(b, same).where(100 * F.col("n_found") >= pct * F.col("n")).select(F.col("a.id").alias(id_col), F.col("a.text_hash").alias("text_hash"), F.col("a.item").alias(item_col), F.col("n").alias("n_shingles"), "n_found")


def decontaminate(docs: DataFrame, items: DataFrame, pct: int = CONTAINMENT_PCT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` without the documents that contain an item (see contained()); columns as they are, whatever their names.

    Rows that share id and text go or stay together; null and empty texts stay. Only
    documents that a filter of bounded size may hold move, to meet the found ones in a join that decides. No items: all
    stay. An empty table gives an empty table.
    """
    found = written(contained(docs, items, pct, id_col, text_col).select(F.col(f"`{id_col}`").alias("id"), F.col("text_hash").alias("th")).distinct(), "found")
    blocks = filter_blocks(found.count())
    bloom = written(blocked_bloom(found.select(F.xxhash64("id", "th").alias("key")), "key", blocks), "bloom")
    own = positional(docs, id=F.col(f"`{id_col}`"), th=text_key(F.col(f"`{text_col}`")))
    marked = mark(own.withColumn("key", F.xxhash64("id", "th")), "key", bloom, blocks)
    some = marked.where("may")
    return restored(marked.where("not may").unionByName(some.join(found, same_key(some, found, "id", "th"), "left_anti")), docs.columns)


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = contained(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "item_id", "n_shingles", "n_found", F.round(F.col("n_found") / F.col("n_shingles"), 6).alias("containment"))


QUERIES = {"op4_decontamination": op4_decontamination}
ORACLE_SQL = {
    "op4_decontamination": r"""
with d as (select doc_id, list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') as w from documents),
b as (select item_id, list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') as w from benchmark),
bs as (select distinct item_id, array_to_string(w[i:i+least(len(w),5)-1], ' ') as s from (select item_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) as i from b where len(w) > 0)),
ks as (select distinct least(len(w), 5) as k from b where len(w) > 0),
ds as (select distinct doc_id, array_to_string(w[i:i+k-1], ' ') as s from (select doc_id, w, k, unnest(range(1, len(w) - k + 2)) as i from d, ks)),
n as (select item_id, count(*) as n_shingles from bs group by item_id)
select doc_id, item_id, n_shingles, n_found, round(n_found / n_shingles, 6) as containment
from (select doc_id, item_id, count(*) as n_found from ds join bs using (s) group by doc_id, item_id) join n using (item_id)
where 100 * n_found >= 80 * n_shingles
"""
}
