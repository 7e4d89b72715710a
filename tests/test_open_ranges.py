"""Ranges without an end, and query 1 on pruned chunks."""

import __spark_entry__ as repo
import pytest
from chunklake.operators import metadata, pruning
from chunklake.operators.pruning import Range
from pyspark.sql import functions as F


@pytest.mark.parametrize("mode", ["minmax", "hist", "combined"])
def test_open_ends_keep_chunks(spark, mode):
    df = spark.sql("select cast(id div 10 as int) as chunk_id, cast(if(id >= 40, null, id) as int) as v from range(50)")
    kinds = {f.name: f.dataType for f in df.schema}
    meta = metadata.chunk_metadata(df, ["v"], 4, metadata.Bloom(0.05, 64))
    for low, high, keep in ((None, 15, {0, 1}), (25, None, {2, 3}), (None, None, {0, 1, 2, 3}), (None, -1, set()), (40, None, set())):
        got = pruning.surviving(meta, [Range("v", low, high)], mode, kinds, 4, metadata.Bloom(0.05, 64))
        assert {r.chunk_id for r in got.collect()} == keep


@pytest.mark.parametrize("mode", ["minmax", "hist"])
def test_query_1_counts_lines_before_the_first_day_of_the_test_data(spark, sf, tmp_path, mode):
    early = spark.read.parquet(f"{sf}/lineitem.parquet").withColumn("l_shipdate", (F.col("l_shipdate") - F.expr("interval 10 years")).cast("timestamp_ntz"))
    early.write.parquet(f"file://{tmp_path}/lineitem.parquet")
    n = early.count()
    for name, column in ((f"prune_tpch_q1_{mode}", "n"), (f"prune_tpch_q1_sums_{mode}", "count_order")):
        assert repo.queries()[name](spark, f"file://{tmp_path}").agg(F.sum(column)).first()[0] == n
