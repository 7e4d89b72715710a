"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query runs once to warm up and then `REPEATS` times; the best counts, as in the reference's published figures. The
clustered layout and its metadata are made before its queries are timed, as loading is there; `pruning` compares them with
the same query on the same rows without metadata.
"""

from __future__ import annotations

import json
import os
import tempfile
import time

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
REPEATS = 2
NAMES = ["ssb_q1_1", "ssb_q1_2", "ssb_q1_3", "ssb_q2_1", "ssb_q2_2", "ssb_q2_3", "ssb_q3_1", "ssb_q3_2", "ssb_q3_3", "ssb_q3_4", "ssb_q4_1", "ssb_q4_2", "ssb_q4_3", "ssb_q2_1_pre_aggr", "tpch_q1", "tpch_q3", "tpch_q5", "trips_q1_1", "trips_q2_3"]


def main() -> None:
    from pyspark.sql import functions as F

    from chunklake.operators import layout, metadata, pruning
    from chunklake.operators.predicates import every
    from chunklake.plans import catalogue, chunks
    from chunklake.plans.ssb import FLIGHT1
    from chunklake.session import session

    spark = session(CPUS, int(CPUS))
    spark.sparkContext.setLogLevel("ERROR")

    def best(make) -> float:
        took = []
        for _ in range(1 + REPEATS):
            t = time.perf_counter()
            make().collect()
            took.append(time.perf_counter() - t)
        return round(min(took[1:]), 4)

    times = {name: best(lambda q=catalogue.QUERIES[name]: q(spark, SF_DIR)) for name in NAMES}

    with tempfile.TemporaryDirectory() as folder:
        predicates = chunks.PREDICATES1["1"]
        columns = [p.column for p in predicates]
        data = layout.clustered_write(chunks.denormalized(spark, SF_DIR, False), f"file://{folder}/fact", 32, layout.STAR_SORTS["sortq11"])
        metadata.chunk_metadata(data, columns, 16).write.parquet(f"file://{folder}/meta")
        meta = spark.read.parquet(f"file://{folder}/meta")
        kinds = {f.name: f.dataType for f in data.schema}
        answer = lambda rows: rows.where(every(*FLIGHT1["1"][:2])()).agg(F.sum(F.col("lo_extendedprice") * F.col("lo_discount")).alias("revenue"))
        kept = lambda: pruning.surviving(meta, predicates, "combined", kinds, 16)
        times["clustered_q1_1_unpruned"] = best(lambda: answer(data))
        times["clustered_q1_1_pruned"] = best(lambda: answer(pruning.listed_scan(data, kept())))
        skipped = pruning.skipped(meta, kept()).first().asDict()

    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": SF_DIR.rsplit("sf", 1)[-1], "pruning": skipped}))


if __name__ == "__main__":
    main()
