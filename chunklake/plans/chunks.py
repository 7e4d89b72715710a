"""Queries on chunks: their metadata, what each mode of pruning skips, and results that pruning must not change; layouts and joins."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dates import date_dimension
from ..operators import aggregates, joins, layout, metadata, pruning
from ..operators.advisor import sample_codecs
from ..operators.joins import Dimension
from ..operators.predicates import equals, every
from ..operators.pruning import Points, Range
from ..sources.generator import generate
from ..sources.tables import shared_folder, stored, table
from . import adapt, tpch
from . import trips as trip_queries
from .adapt import sql
from .ssb import FLIGHT1, FLIGHT3
from .ssb import ORACLE_SQL as SSB_SQL

#: Order keys in a chunk.
KEYS = 1000
BUCKETS = 16
BLOOM = metadata.Bloom(p=0.01, size=2048)
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def denormalized(spark: SparkSession, d: str, customers: bool = True) -> DataFrame:
    """Fact rows with the dimension attributes that metadata is kept of."""
    dims = [Dimension(date_dimension(spark), "d_key", "lo_orderdate", ("d_year", "d_yearmonthnum", "d_weeknuminyear", "d_yearmonth"))]
    if customers:
        dims += [Dimension(adapt.customer(spark, d), "c_key", "lo_custkey", ("c_city", "c_nation", "c_region")), Dimension(adapt.supplier(spark, d), "s_key", "lo_suppkey", ("s_city", "s_nation", "s_region"))]
    return joins.prejoin(adapt.lineorder(spark, d), dims)


def by_key(df: DataFrame, key: str = "lo_key") -> DataFrame:
    return df.withColumn("chunk_id", F.call_function("div", F.col(key), F.lit(KEYS).cast("bigint")))


def pruned(data: DataFrame, predicates: list, mode: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The metadata of the predicates' columns, the rows of it that survive, and their chunks' rows."""
    columns = list(dict.fromkeys(p.column for p in predicates))
    kinds = {f.name: f.dataType for f in data.schema}
    meta = metadata.chunk_metadata(data, columns, BUCKETS, BLOOM if mode in ("bloom", "combined") else None, histograms=columns if mode in ("hist", "combined") else [])
    kept = pruning.surviving(meta, predicates, mode, kinds, BUCKETS, BLOOM)
    return meta, kept, pruning.pruned_scan(data, kept)


#: Chunks of the stored fact table.
CHUNKS = 32
FACT_COLUMNS = ["d_year", "d_yearmonthnum", "d_weeknuminyear", "d_yearmonth", "lo_discount", "lo_quantity", "c_region", "c_nation", "c_city"]


def stored_fact(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The fact table with its dimension attributes in chunks, in the order of a day's position, and the chunks' metadata: both written once in an application and read by every pruned query."""
    data = stored(spark, "fact", d, lambda path: layout.clustered_write(denormalized(spark, d), path, CHUNKS, ["d_yearmonthnum", "lo_discount"], "zstd"))
    meta = stored(spark, "fact-meta", d, lambda path: metadata.chunk_metadata(data, FACT_COLUMNS, BUCKETS, BLOOM).write.parquet(path))
    return data, meta


def pruned_fact(spark: SparkSession, d: str, predicates: list, mode: str) -> DataFrame:
    """The rows of the stored chunks that metadata leaves; other chunks aren't listed, so not read."""
    data, meta = stored_fact(spark, d)
    kept = pruning.surviving(meta, predicates, mode, {f.name: f.dataType for f in data.schema}, BUCKETS, BLOOM)
    return pruning.listed_scan(data, kept)


PREDICATES1 = {
    "1": [Range("d_year", 1996, 1996), Range("lo_discount", 1, 3), Range("lo_quantity", 1, 24)],
    "2": [Range("d_yearmonthnum", 199601, 199601), Range("lo_discount", 4, 6), Range("lo_quantity", 26, 35)],
    "3": [Range("d_weeknuminyear", 6, 6), Range("d_year", 1997, 1997), Range("lo_discount", 5, 7), Range("lo_quantity", 26, 35)],
}
_CITIES = ("NATION_61", "NATION_65")
PREDICATES3 = {
    "1": [Points("c_region", ("ASIA",)), Range("d_year", 1996, 2000)],
    "2": [Points("c_nation", ("NATION_6",)), Range("d_year", 1996, 2000)],
    "3": [Points("c_city", _CITIES), Range("d_year", 1996, 2000)],
    "4": [Points("c_region", ("AMERICA",)), Points("d_yearmonth", ("Dec1997",))],
}


def pruned_q1(k: str, mode: str) -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        rows = pruned_fact(spark, d, PREDICATES1[k], mode)
        return rows.where(every(*FLIGHT1[k][:2])()).agg(F.sum(F.col("lo_extendedprice") * F.col("lo_discount")).alias("revenue"))

    return run


def pruned_q3(k: str, mode: str) -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        level, *chosen, _ = FLIGHT3[k]
        rows = pruned_fact(spark, d, PREDICATES3[k], mode)
        return rows.where(every(*chosen)()).groupBy(f"c_{level}", f"s_{level}", "d_year").agg(F.sum("lo_revenue").alias("revenue"))

    return run


for _mode in pruning.MODES:
    for _k in "123":
        QUERIES[f"prune_q1_{_k}_{_mode}"], ORACLE_SQL[f"prune_q1_{_k}_{_mode}"] = pruned_q1(_k, _mode), SSB_SQL[f"ssb_q1_{_k}"]
for _mode in ("minmax", "hist", "bloom", "combined"):
    for _k in "1234":
        QUERIES[f"prune_q3_{_k}_{_mode}"], ORACLE_SQL[f"prune_q3_{_k}_{_mode}"] = pruned_q3(_k, _mode), SSB_SQL[f"ssb_q3_{_k}"]


def _kept_lines(spark: SparkSession, d: str, mode: str) -> DataFrame:
    """The lines of the chunks that may hold a line of the order-table query 1, which has no first day."""
    data = by_key(table(spark, d, "lineitem").withColumn("l_day", F.col("l_shipdate").cast("date")), "l_orderkey")
    return pruned(data, [Range("l_day", None, "1998-09-02")], mode)[2]


def _pruned_lines(spark: SparkSession, d: str, mode: str) -> DataFrame:
    """The order-table query 1's filter on pruned chunks, as a count."""
    rows = _kept_lines(spark, d, mode)
    return rows.where("l_day <= date'1998-09-02'").groupBy("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"))


def _kept_orders(spark: SparkSession, d: str, low: str | None, high: str, mode: str) -> DataFrame:
    """The orders of the chunks that may hold one of some days."""
    data = by_key(table(spark, d, "orders").withColumn("o_day", F.col("o_orderdate").cast("date")), "o_orderkey")
    return pruned(data, [Range("o_day", low, high)], mode)[2]


def _pruned_q3(spark: SparkSession, d: str, mode: str) -> DataFrame:
    data = by_key(table(spark, d, "lineitem").withColumn("l_day", F.col("l_shipdate").cast("date")), "l_orderkey")
    lines = pruned(data, [Range("l_day", "1998-03-15", None)], mode)[2]
    return tpch.q3(spark, d, "1998-03-15", lines, _kept_orders(spark, d, None, "1998-03-15", mode))


def _pruned_trips(spark: SparkSession, d: str, mode: str, low: int = 2, high: int = 5) -> DataFrame:
    data = adapt.trips(spark, d).withColumn("chunk_id", F.call_function("div", F.col("location_id"), F.lit(50).cast("bigint")))
    rows = pruned(data, [Range("distance", float(low), float(high))], mode)[2]
    return rows.where(F.col("distance").between(low, high)).groupBy(F.month("pickup").cast("bigint").alias("month")).agg(F.count(F.lit(1)).alias("trips"))


for _mode in ("minmax", "hist"):
    QUERIES[f"prune_tpch_q1_{_mode}"] = lambda s, d, m=_mode: _pruned_lines(s, d, m)
    ORACLE_SQL[f"prune_tpch_q1_{_mode}"] = "select l_returnflag, l_linestatus, count(*) as n from lineitem where cast(l_shipdate as date) <= date '1998-09-02' group by 1, 2"
    QUERIES[f"prune_tpch_q1_sums_{_mode}"] = lambda s, d, m=_mode: tpch.q1_of(_kept_lines(s, d, m))
    ORACLE_SQL[f"prune_tpch_q1_sums_{_mode}"] = tpch.ORACLE_SQL["tpch_q1"]
    QUERIES[f"prune_trips_q1_{_mode}"] = lambda s, d, m=_mode: _pruned_trips(s, d, m)
    ORACLE_SQL[f"prune_trips_q1_{_mode}"] = trip_queries.ORACLE_SQL["trips_q1_1"]
    QUERIES[f"prune_tpch_q3_{_mode}"], ORACLE_SQL[f"prune_tpch_q3_{_mode}"] = (lambda s, d, m=_mode: _pruned_q3(s, d, m)), tpch.ORACLE_SQL["tpch_q3_1998"]
    QUERIES[f"prune_tpch_q5_{_mode}"], ORACLE_SQL[f"prune_tpch_q5_{_mode}"] = (lambda s, d, m=_mode: tpch.q5(s, d, _kept_orders(s, d, "1996-01-01", "1996-12-31", m))), tpch.ORACLE_SQL["tpch_q5"]
    for _k, (_lo, _hi) in {"2": (5, 15), "3": (15, 5000)}.items():
        QUERIES[f"prune_trips_q1_{_k}_{_mode}"], ORACLE_SQL[f"prune_trips_q1_{_k}_{_mode}"] = (lambda s, d, m=_mode, lo=_lo, hi=_hi: _pruned_trips(s, d, m, lo, hi)), trip_queries.ORACLE_SQL[f"trips_q1_{_k}"]


def join_pruned_q1(spark: SparkSession, d: str) -> DataFrame:
    """Chunks in whose range of order dates no day of the year falls are skipped."""
    dim = Dimension(date_dimension(spark), "d_key", "lo_orderdate", where=FLIGHT1["1"][0])
    data = by_key(adapt.lineorder(spark, d))
    kept = pruning.join_pruned(metadata.min_max(data, ["lo_orderdate"]), "lo_orderdate", joins.build_keys(dim), "d_key")
    rows = joins.star_join(pruning.pruned_scan(data, kept), [dim])
    return rows.where(FLIGHT1["1"][1]()).agg(F.sum(F.col("lo_extendedprice") * F.col("lo_discount")).alias("revenue"))


def clustered(sort: str, query: Callable[[DataFrame], DataFrame], predicates: list, mode: str, customers: bool) -> Query:
    """Writes the fact table in a named order, then reads the chunks that its metadata leaves."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        data = layout.clustered_write(denormalized(spark, d, customers), f"{shared_folder(spark)}/clustered-{uuid.uuid4().hex}", 16, layout.STAR_SORTS[sort], "zstd")
        return query(pruned(data, predicates, mode)[2])

    return run


QUERIES["join_prune_q1_1"], ORACLE_SQL["join_prune_q1_1"] = join_pruned_q1, SSB_SQL["ssb_q1_1"]
QUERIES["clustered_q1_1"] = clustered("sortq11", lambda rows: rows.where(every(*FLIGHT1["1"][:2])()).agg(F.sum(F.col("lo_extendedprice") * F.col("lo_discount")).alias("revenue")), PREDICATES1["1"], "combined", False)
ORACLE_SQL["clustered_q1_1"] = SSB_SQL["ssb_q1_1"]
QUERIES["clustered_q3_1"] = clustered("general_dimsort", lambda rows: rows.where(every(*FLIGHT3["1"][1:4])()).groupBy("c_nation", "s_nation", "d_year").agg(F.sum("lo_revenue").alias("revenue")), PREDICATES3["1"], "minmax", True)
ORACLE_SQL["clustered_q3_1"] = SSB_SQL["ssb_q3_1"]

_CHUNKED = "(select *, lo_key // 1000 as chunk_id from lineorder join date_d on lo_orderdate = d_key join customer_d on lo_custkey = c_key)"
_MM = ("lo_discount", "lo_quantity", "lo_extendedprice", "lo_orderdate", "d_year", "c_region")
QUERIES["meta_minmax"] = lambda s, d: metadata.min_max(by_key(denormalized(s, d)), list(_MM))
ORACLE_SQL["meta_minmax"] = sql(f"select chunk_id, count(*) as rows, {', '.join(f'min({c}) as {c}_min, max({c}) as {c}_max' for c in _MM)} from {_CHUNKED} group by chunk_id")
QUERIES["meta_hist"] = lambda s, d: metadata.histogram(by_key(adapt.lineorder(s, d)), "lo_extendedprice", BUCKETS)
ORACLE_SQL["meta_hist"] = sql(
    "select chunk_id, bucket, count(*) as n from (select chunk_id, least(15, (v - mn) * 16 // greatest(mx - mn, 1)) as bucket from (select lo_key // 1000 as chunk_id, lo_extendedprice as v, min(lo_extendedprice) over (partition by lo_key // 1000) as mn, max(lo_extendedprice) over (partition by lo_key // 1000) as mx from lineorder)) group by chunk_id, bucket"
)
QUERIES["meta_bloom_rows"] = lambda s, d: metadata.bloom_words(by_key(adapt.lineorder(s, d)), "lo_suppkey", BLOOM)


def _skipped(spark: SparkSession, d: str) -> DataFrame:
    """What least and greatest values skip of chunks of one priority and month each."""
    data = denormalized(spark, d, False).withColumn("chunk_id", F.col("d_yearmonthnum"))
    meta, kept, _ = pruned(data, PREDICATES1["1"], "minmax")
    return pruning.skipped(meta, kept)


QUERIES["prune_skipped"] = _skipped
ORACLE_SQL["prune_skipped"] = sql(
    ", m as (select d_yearmonthnum, count(*) as n, min(d_year) as y0, max(d_year) as y1, min(lo_discount) as d0, max(lo_discount) as d1, min(lo_quantity) as q0, max(lo_quantity) as q1 from lineorder join date_d on lo_orderdate = d_key group by 1), k as (select *, y0 <= 1996 and y1 >= 1996 and d0 <= 3 and d1 >= 1 and q0 <= 24 and q1 >= 1 as keep from m) select count(*) as chunks, count(*) filter (not keep) as pruned_chunks, cast(sum(n) as bigint) as rows, cast(coalesce(sum(n) filter (not keep), 0) as bigint) as pruned_rows from k"
)
QUERIES["join_count"] = lambda s, d: joins.join_count(table(s, d, "lineitem").withColumnRenamed("l_orderkey", "key"), table(s, d, "orders").where("o_orderstatus = 'F'").withColumnRenamed("o_orderkey", "key"), "key")
ORACLE_SQL["join_count"] = "select count(*) as hits from lineitem where l_orderkey in (select o_orderkey from orders where o_orderstatus = 'F')"
QUERIES["join_rows"] = lambda s, d: joins.matching(table(s, d, "orders").withColumnRenamed("o_custkey", "key"), table(s, d, "customer").where(equals("c_mktsegment", "BUILDING")()).withColumnRenamed("c_custkey", "key"), "key").select("o_orderkey")
ORACLE_SQL["join_rows"] = "select o_orderkey from orders where o_custkey in (select c_custkey from customer where c_mktsegment = 'BUILDING')"
QUERIES["join_materialized"] = lambda s, d: joins.lookup(table(s, d, "orders").select("o_orderkey", F.col("o_custkey").alias("key")), table(s, d, "customer").select("c_custkey", "c_name"), "key", "c_custkey").select("o_orderkey", "c_name")
ORACLE_SQL["join_materialized"] = "select o_orderkey, c_name from orders join customer on o_custkey = c_custkey"
QUERIES["prejoin"] = lambda s, d: denormalized(s, d).select("lo_key", "lo_linenumber", "lo_revenue", "d_year", "d_weeknuminyear", "c_city", "s_region")
ORACLE_SQL["prejoin"] = sql("select lo_key, lo_linenumber, lo_revenue, d_year, d_weeknuminyear, c_city, s_region from lineorder join date_d on lo_orderdate = d_key join customer_d on lo_custkey = c_key join supplier_d on lo_suppkey = s_key")
QUERIES["distinct_counts"] = lambda s, d: aggregates.distinct_counts(adapt.part(s, d))
ORACLE_SQL["distinct_counts"] = sql("select " + ", ".join(f"count(distinct {c}) as {c}" for c in ("p_key", "p_name", "p_mfgr", "p_category", "p_brand1", "p_type", "p_size")) + " from part_d")
QUERIES["min_max_prices"] = lambda s, d: aggregates.reduced(adapt.lineorder(s, d), low=F.min("lo_extendedprice"), high=F.max("lo_extendedprice"))
ORACLE_SQL["min_max_prices"] = sql("select min(lo_extendedprice) as low, max(lo_extendedprice) as high from lineorder")
QUERIES["fold_max"] = lambda s, d: aggregates.folded(adapt.lineorder(s, d), "lo_extendedprice", F.lit(0).cast("bigint"), lambda a, b: F.greatest(a, b))
QUERIES["fold_sum_from"] = lambda s, d: aggregates.folded(adapt.lineorder(s, d), "lo_quantity", F.lit(10).cast("bigint"), lambda a, b: a + b)
ORACLE_SQL["fold_sum_from"] = sql("select cast(10 + sum(lo_quantity) as bigint) as value from lineorder")
QUERIES["fold_empty"] = lambda s, d: aggregates.folded(adapt.lineorder(s, d).where("lo_quantity < 0"), "lo_quantity", F.lit(10).cast("bigint"), lambda a, b: a + b)
ORACLE_SQL["fold_empty"] = sql("select cast(10 + coalesce(sum(lo_quantity), 0) as bigint) as value from lineorder where lo_quantity < 0")
ORACLE_SQL["fold_max"] = sql("select max(lo_extendedprice) as value from lineorder")
QUERIES["sort_permutation"] = lambda s, d: layout.permutation(table(s, d, "orders"), "o_orderkey", "o_orderpriority", "o_orderdate")
ORACLE_SQL["sort_permutation"] = "select o_orderkey, row_number() over (order by o_orderpriority, o_orderdate, o_orderkey) - 1 as place from orders"
QUERIES["tpch_q3_top"] = lambda s, d: tpch.q3(s, d, "1998-03-15").orderBy(F.desc("revenue"), "l_orderkey").limit(10)
ORACLE_SQL["tpch_q3_top"] = f"select * from ({tpch.ORACLE_SQL['tpch_q3_1998']}) order by revenue desc, l_orderkey limit 10"
QUERIES["shuffle_rows"] = lambda s, d: layout.shuffled(table(s, d, "orders").select("o_orderkey"), 0.2, by="o_orderkey")
ORACLE_SQL["shuffle_rows"] = "select o_orderkey from orders"
QUERIES["kmeans_layout"] = lambda s, d: layout.kmeans_chunks(adapt.lineorder(s, d), ["lo_discount", "lo_quantity"], 8, 5, most_rows=20_000).groupBy("chunk_id").agg(F.count(F.lit(1)).alias("rows"), F.min("lo_quantity").alias("q_min"), F.max("lo_quantity").alias("q_max"))
QUERIES["codec_sample"] = lambda s, d: sample_codecs(adapt.lineorder(s, d), ["lo_discount"], shared_folder(s), ("snappy", "zstd")).select("column", "codec", "bytes")
QUERIES["generated_rows"] = lambda s, d: generate(s, 0.001)["lineorder"].groupBy("lo_discount").agg(F.count(F.lit(1)).alias("n"))
QUERIES["date_dimension"] = lambda s, d: date_dimension(s)
ORACLE_SQL["date_dimension"] = sql("select * from date_d")

