"""A sweep over layouts, codecs, chunk counts and pruning modes; one row of metrics for each run."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass
from itertools import product

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import layout, metadata, pruning
from .advisor import files_bytes


@dataclass
class Metric:
    """One run. Bytes: of all chunks, and of those skipped; times in milliseconds. Writing and metadata are not in `time_ms`."""

    query: str
    sort: str
    codec: str
    chunks: int
    mode: str
    repeat: int
    rows: int
    stored_bytes: int
    pruned_chunks: int
    pruned_rows: int
    prune_ms: float
    time_ms: float


def sweep(
    data: DataFrame,
    query: Callable[[DataFrame], DataFrame],
    predicates: list,
    folder: str,
    name: str = "query",
    sorts: dict[str, list[str]] | None = None,
    codecs: tuple[str, ...] = ("snappy",),
    chunks: tuple[int, ...] = (16,),
    modes: tuple[str, ...] = pruning.MODES,
    repeats: int = 1,
    bloom: metadata.Bloom = metadata.Bloom(),
) -> list[Metric]:
    """Writes each layout once, gathers its metadata, and runs `query` on the chunks that each mode leaves."""
    spark, out = data.sparkSession, []
    columns = list(dict.fromkeys(p.column for p in predicates))
    for (sort, by), codec, n in product((sorts or {"natural": []}).items(), codecs, chunks):
        path = f"{folder}/sweep-{uuid.uuid4().hex}"
        table = layout.clustered_write(data, path, n, by, codec)
        metadata.chunk_metadata(table, columns, 16, bloom).write.parquet(f"{path}-meta")
        meta = spark.read.parquet(f"{path}-meta")
        kinds = {f.name: f.dataType for f in table.schema}
        stored = files_bytes(spark, path)
        for mode, repeat in product(modes, range(repeats)):
            began = time.perf_counter()
            kept = pruning.surviving(meta, predicates, mode, kinds, 16, bloom)
            rows = pruning.listed_scan(table, kept)
            ready = time.perf_counter()
            query(rows).write.format("noop").mode("overwrite").save()
            done = time.perf_counter()
            s = pruning.skipped(meta, kept).first()
            out.append(Metric(name, sort, codec, s.chunks, mode, repeat, s.rows, stored, s.pruned_chunks, s.pruned_rows, 1000 * (ready - began), 1000 * (done - began)))
    return out


def metrics(spark: SparkSession, runs: list[Metric]) -> DataFrame:
    """The runs as a table, with what follows from them: gib_s (bytes of chunks read or skipped by the second, as if all had been read), read_gib_s (of those read), skipped (share of rows)."""
    df = spark.createDataFrame([asdict(r) for r in runs], "query string, sort string, codec string, chunks bigint, mode string, repeat bigint, rows bigint, stored_bytes bigint, pruned_chunks bigint, pruned_rows bigint, prune_ms double, time_ms double")
    share = F.try_divide("pruned_rows", "rows")
    gib = F.col("stored_bytes") / (1 << 30)
    return df.withColumns({"gib_s": F.try_divide(gib, F.col("time_ms") / 1000), "read_gib_s": F.try_divide(gib * (1 - share), F.col("time_ms") / 1000), "skipped": share})
