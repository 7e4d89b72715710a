"""Readers of the table directory: one Parquet file or folder for each table."""

from __future__ import annotations

import tempfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

#: Schemas of the fixed tables. Given to the reader, they spare it a job that looks into files for each table of each query.
SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table `name` below `sf_dir`, by Spark's own reader, so that any store will do."""
    reader = spark.read.schema(SCHEMAS[name]) if name in SCHEMAS else spark.read
    return reader.parquet(f"{sf_dir}/{name}.parquet")


_local: dict[str, str] = {}
_stored: dict[tuple[str, str, str], str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset, a local session gets a folder of this machine; a cluster's raises, since its executors don't see one another's disks."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        app = spark.sparkContext.applicationId
        found = _local.get(app) or _local.setdefault(app, f"file://{tempfile.mkdtemp(prefix='chunklake-')}")
    return found.rstrip("/")


def stored(spark: SparkSession, name: str, sf_dir: str, make: Callable[[str], object]) -> DataFrame:
    """A table derived from those below `sf_dir`, which `make` writes to a path when an application asks first; later queries read what is there. The files go when the application ends."""
    app = spark.sparkContext.applicationId
    key = (app, name, sf_dir)
    if key not in _stored:
        path = f"{shared_folder(spark)}/{name}-{app}-{len(_stored)}"
        make(path)
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
        _stored[key] = path
    return spark.read.parquet(_stored[key])
