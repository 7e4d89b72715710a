"""Layouts: the order in which rows are written, cut into chunks that are partitions of the written table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.files import CODECS

#: Named orders of the star schema's fact table; dimension attributes come by prejoin. Fixed values.
STAR_SORTS = {
    "natural": [],
    "lo_key": ["lo_key"],
    "lo_discount": ["lo_discount"],
    "lo_quantity": ["lo_quantity"],
    "lo_discount_quantity": ["lo_discount", "lo_quantity"],
    "lo_orderdate": ["lo_orderdate"],
    "lo_extendedprice": ["lo_extendedprice"],
    "sortq11": ["d_year", "lo_discount", "lo_quantity"],
    "sortq12": ["d_yearmonthnum", "lo_discount", "lo_quantity"],
    "sortq13": ["d_weeknuminyear", "d_year", "lo_discount", "lo_quantity"],
    "sortq31": ["c_region", "d_year"],
    "sortq32": ["c_nation", "d_year"],
    "sortq33": ["c_city", "d_year"],
    "sortq34": ["c_city", "d_yearmonth"],
    "general_dimsort": ["c_region", "lo_discount", "c_nation", "lo_quantity", "d_yearmonthnum", "c_city"],
}
ORDER_SORTS = {"natural": [], "general_dimsort": ["l_quantity", "o_orderdate", "l_shipdate"]}
TRIP_SORTS = {"natural": [], "general_dimsort": ["fare", "distance"]}


def sort_by(df: DataFrame, *columns: str, ascending: bool = True) -> DataFrame:
    """A total order; descending is its reverse."""
    return df.orderBy(*(F.col(c).asc() if ascending else F.col(c).desc() for c in columns))


def permutation(df: DataFrame, index: str, *columns: str) -> DataFrame:
    """index, place: where each row would stand (0 is first). Ranks are numbered over sorted partitions, not in one task."""
    order = [*columns, index]
    ranged = df.select(*dict.fromkeys(order)).repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    sizes = ranged.groupBy(F.shiftright("_at", 33).alias("_part")).agg(F.count(F.lit(1)).alias("n"))
    # As many rows as there are partitions.
    before = sizes.withColumn("_before", F.coalesce(F.sum("n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    return ranged.withColumn("_part", F.shiftright("_at", 33)).join(F.broadcast(before), "_part").select(index, (F.col("_at").bitwiseAND((1 << 33) - 1) + F.col("_before")).alias("place"))


def shuffled(df: DataFrame, ratio: float = 1.0, seed: int = 1, by: str | None = None) -> DataFrame:
    """Rows in random order; with a ratio under 1, that share of them moves and the others stay where `by` puts them."""
    if ratio >= 1 or by is None:
        return df.orderBy(F.rand(seed))
    low, high = df.agg(F.min(by), F.max(by)).first()
    if low is None:
        return df
    return df.orderBy(F.when(F.rand(seed) < ratio, F.lit(low) + F.rand(seed + 1) * (high - low)).otherwise(F.col(by)))


def with_chunks(df: DataFrame, chunks: int, columns: list[str]) -> DataFrame:
    """`df` and chunk_id: rows in the order of `columns`, in ranges; without columns, dealt as they come."""
    ranged = df.repartitionByRange(chunks, *columns).sortWithinPartitions(*columns) if columns else df.repartition(chunks)
    return ranged.withColumn("chunk_id", F.spark_partition_id())


def clustered_write(df: DataFrame, path: str, chunks: int, columns: list[str], codec: str = "snappy") -> DataFrame:
    """Writes a table whose partitions are chunks, in order; returns it as it is read."""
    with_chunks(df, chunks, columns).write.mode("overwrite").option("compression", CODECS.get(codec, codec)).partitionBy("chunk_id").parquet(path)
    return df.sparkSession.read.parquet(path)


def kmeans_chunks(df: DataFrame, columns: list[str], k: int, rounds: int = 10, seed: int = 1234, most_rows: int = 1 << 20) -> DataFrame:
    """`df` and chunk_id by k-means: columns scaled to [0, 1], clusters as chunks; a cluster of over `most_rows` rows is cut into as many as it takes. Rows with a null in `columns` form a cluster of their own."""
    from pyspark.ml import Pipeline
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import MinMaxScaler, VectorAssembler

    whole = df.where(" and ".join(f"{c} is not null" for c in columns))
    raw = VectorAssembler(inputCols=columns, outputCol="_raw", handleInvalid="skip")
    model = Pipeline(stages=[raw, MinMaxScaler(inputCol="_raw", outputCol="_scaled"), KMeans(k=k, maxIter=rounds, seed=seed, featuresCol="_scaled", predictionCol="_cluster")]).fit(whole)
    put = model.transform(whole).drop("_raw", "_scaled").unionByName(df.where(" or ".join(f"{c} is null" for c in columns)).withColumn("_cluster", F.lit(k)))
    sizes = put.groupBy("_cluster").count().collect()
    pieces = {c: -(-n // most_rows) for c, n in sizes}
    first, total = {}, 0
    for c in sorted(pieces):
        first[c], total = total, total + pieces[c]
    look = lambda m: F.create_map(*(F.lit(x) for p in m.items() for x in p))
    piece: Column = F.pmod(F.xxhash64(*columns, F.monotonically_increasing_id()), F.element_at(look(pieces), F.col("_cluster"))) if pieces else F.lit(0)
    return put.withColumn("chunk_id", (F.element_at(look(first), F.col("_cluster")) + piece).cast("int")).drop("_cluster") if pieces else put.withColumnRenamed("_cluster", "chunk_id")


def pairwise_distances(points: DataFrame, index: str, columns: list[str]) -> DataFrame:
    """i, j, distance (squared), i < j: of a small sample, such as cluster centres."""
    a = points.select(F.col(index).alias("i"), *(F.col(c).alias(f"a_{c}") for c in columns))
    b = points.select(F.col(index).alias("j"), *(F.col(c).alias(f"b_{c}") for c in columns))
    total = sum(((F.col(f"a_{c}") - F.col(f"b_{c}")) ** 2 for c in columns), F.lit(0.0))
    return a.join(b, F.col("i") < F.col("j")).select("i", "j", total.alias("distance"))
