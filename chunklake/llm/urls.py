"""URL filters: a blocked Bloom filter before an exact hash join (operator 3).

A rule lists a canonical URL prefix (host, path). Its key goes into a Bloom filter of 256-bit blocks: one lookup of one
block answers for a key, so probing is one broadcast hash join by block number. Keys that pass go to an exact join with
the rules, which removes false positives.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lower_ascii, table

#: Blocks of 4 longs; the filter never has more, so that its broadcast is at most 10 MB. A longer list has more false positives, which the exact join removes.
MAX_BLOCKS = 1 << 18
#: Listed keys for each block: about 13 bits a key.
KEYS_PER_BLOCK = 20


def host_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first :// up to /, ?, # or the end, A-Z lower-cased; path: from there up to ?, # or the end. Null, or no ://: both empty."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(host) + 1), r"^[^?#]*", 0)
    return F.coalesce(lower_ascii(host), F.lit("")), F.coalesce(path, F.lit(""))


def _spot(key: Column, blocks: int) -> tuple[Column, list[Column]]:
    """The block of a key, and two bits in each of its four words."""
    one, two = F.xxhash64(key), F.xxhash64(key, F.lit("bits"))
    bit = lambda k: F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(two, k).bitwiseAND(F.lit(63)).cast("int"))
    return F.pmod(one, F.lit(blocks)), [bit(12 * i).bitwiseOR(bit(12 * i + 6)) for i in range(4)]


def blocked_bloom(keys: DataFrame, key: str, blocks: int) -> DataFrame:
    """One row for each block that isn't empty: block, w0 to w3."""
    block, words = _spot(F.col(key), blocks)
    return keys.select(block.alias("block"), *(w.alias(f"w{i}") for i, w in enumerate(words))).groupBy("block").agg(*(F.expr(f"bit_or(w{i})").alias(f"w{i}") for i in range(4)))


def filter_blocks(n: int) -> int:
    """Blocks for n keys."""
    return min(MAX_BLOCKS, max(1, 1 << (n // KEYS_PER_BLOCK).bit_length()))


def mark(df: DataFrame, key: str, bloom: DataFrame, blocks: int, name: str = "may") -> DataFrame:
    """`df` and a column `name` that is false for rows whose key is certainly not in the filter. `df` is an operator's own table, whose columns aren't called w0 .. w3 or spot."""
    at, words = _spot(F.col(key), blocks)
    probed = df.withColumn("spot", at).join(F.broadcast(bloom.withColumnRenamed("block", "spot")), "spot", "left")
    held = F.lit(True)
    for i, w in enumerate(words):
        held = held & (F.col(f"w{i}").bitwiseAND(w) == w)
    return probed.withColumn(name, F.coalesce(held, F.lit(False))).select(*df.columns, name)


def may_contain(df: DataFrame, key: str, bloom: DataFrame, blocks: int) -> DataFrame:
    """The rows of `df` whose key may be in the filter: all that are, and some others."""
    return mark(df, key, bloom, blocks).where("may").drop("may")


def url_verdicts(pages: DataFrame, rules: DataFrame, otherwise: str = "allow", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row for each row of `pages`: id, host, path, rule (string or null), verdict.

    `rules`: host, path, verdict. A rule fits its host and all subdomains if the url's path starts with the rule's; the
    longest host and path together wins (then the longer host, then the greater text; of repeated rules the smaller
    verdict). Where none fits: null and `otherwise`. Rules with a null field are left out. A null url, or one without
    ://, has an empty host and path, which only a rule of an empty host could fit. Ids may be null or repeated; other
    columns aren't read. No rules, or no pages: no row is blocked, or none returned.

    The verdict depends on host and path alone, so the filter and the joins run over distinct ones. Candidate keys of a
    URL: its last labels, as many as some rule has, by its path's prefixes, as long as some rule's. The driver learns
    only these two sets of numbers and the count of rules.
    """
    rules = rules.where("host is not null and path is not null and verdict is not null").groupBy("host", "path").agg(F.min("verdict").alias("verdict"))
    n, labels, lengths = rules.agg(F.count(F.lit(1)), F.sort_array(F.collect_set(F.size(F.split("host", r"\.")))), F.sort_array(F.collect_set(F.length("path")))).first()
    host, path = host_path(F.col(url_col))
    own = pages.select(F.col(id_col), host.alias("host"), path.alias("path"))
    if not n:
        return own.withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit(otherwise)})
    blocks = filter_blocks(n)
    listed = rules.select(F.concat_ws("\n", "host", "path").alias("key"), F.concat("host", "path").alias("rule"), F.length("host").alias("host_length"), "verdict")
    bloom = blocked_bloom(listed, "key", blocks)

    parts = F.split("host", r"\.", -1)
    hosts = F.array_distinct(F.array(*(F.when(F.size(parts) >= k, F.array_join(F.slice(parts, -k, k), ".")) for k in labels)))
    paths = F.array(*(F.when(F.length("path") >= k, F.substring("path", 1, k)) for k in lengths))
    keys = own.select("host", "path").distinct().withColumn("h", F.explode(F.array_compact(hosts))).withColumn("p", F.explode(F.array_compact(paths)))
    hits = may_contain(keys.select("host", "path", F.concat_ws("\n", "h", "p").alias("key")), "key", bloom, blocks)
    best = hits.join(listed, "key").groupBy("host", "path").agg(F.max_by(F.struct("rule", "verdict"), F.struct(F.length("rule"), "host_length", "rule")).alias("best"))
    return own.join(best, ["host", "path"], "left").select(id_col, "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(otherwise)).alias("verdict"))


#: The query's rules. Host, path, verdict.
RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]


def op3_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_verdicts(table(spark, sf_dir, "pages"), spark.createDataFrame(RULES, "host string, path string, verdict string"))


QUERIES = {"op3_urls": op3_urls}
ORACLE_SQL = {
    "op3_urls": r"""
with a as (
  select page_id, case when contains(url, '://') then substr(url, strpos(url, '://') + 3) end as rest from pages
), b as (
  select page_id, rest, regexp_extract(rest, '^[^/?#]*') as raw_host from a
), c as (
  select page_id, coalesce(translate(raw_host, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') as host,
         coalesce(regexp_extract(substr(rest, length(raw_host) + 1), '^[^?#]*'), '') as path from b
), r(rh, rp, v) as (
  values ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')
), k as (
  select host, path, arg_max(rh || rp, length(rh || rp)) as rule, arg_max(v, length(rh || rp)) as verdict
  from (select distinct host, path from c) join r on (host = rh or ends_with(host, '.' || rh)) and starts_with(path, rp) group by host, path
)
select c.page_id, c.host, c.path, k.rule, coalesce(k.verdict, 'allow') as verdict from c left join k using (host, path)
"""
}
