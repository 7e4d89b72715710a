"""Files, generator, dates and the streaming extra."""

from datetime import date

from pyspark.sql import functions as F

from chunklake.functions.dates import week_in_year, weekday
from chunklake.functions.fixed import cents, times_cents
from chunklake.sources import files
from chunklake.sources.generator import generate
from chunklake.sources.schemas import schema
from chunklake.streaming import rollup

SCHEMA = "ente int, gans double, kartoffel string"


def test_csv_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(i, (20 - i) * 1.1, f"K {i % 3}") for i in range(50)], SCHEMA).coalesce(1)
    for trailing in (False, True):
        path = f"file://{tmp_path}/t{trailing}"
        files.write_csv(df, path, ";", trailing)
        back = files.read_csv(spark, path, SCHEMA, ";")
        assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))
    part = files.read_csv(spark, path, SCHEMA, ";", start=3, end=6)
    assert [r.ente for r in part.collect()] == [2, 3, 4]


def test_table_directories(spark, tmp_path):
    t = {"a": spark.range(5).toDF("x"), "b": spark.range(3).toDF("y")}
    files.write_tables(t, f"file://{tmp_path}/p", codec="gdeflate")
    assert files.read_tables(spark, f"file://{tmp_path}/p", ["a", "b"])["b"].count() == 3
    files.write_tables(t, f"file://{tmp_path}/c", "csv", sep="|")
    back = files.read_tables(spark, f"file://{tmp_path}/c", ["a"], {"a": "x bigint"}, "|")
    assert len(files.peek(back["a"])) == 5


def test_generator(spark):
    t = generate(spark, 0.001)
    fact = t["lineorder"].cache()
    assert fact.count() > 1500 and set(fact.columns) <= set(schema("lineorder").names)
    assert fact.where("lo_custkey % 3 = 0").count() == 0
    assert fact.where("lo_revenue <> lo_extendedprice * (100 - lo_discount) div 100").count() == 0
    assert fact.join(t["part"], fact.lo_partkey == t["part"].p_key, "left_anti").count() == 0
    assert fact.join(t["date"], fact.lo_orderdate == t["date"].d_key, "left_anti").count() == 0
    assert generate(spark, 0.001, 2)["customer"].count() == 2 * t["customer"].count()


def test_dates(spark):
    r = spark.sql("select date'1995-01-01' as d").select(weekday(F.col("d")), week_in_year(F.col("d"))).first()
    assert date(1995, 1, 1).isoweekday() % 7 == r[0] and r[1] == (0 + 7 - (0 + 6) % 7) // 7 + 1


def test_fixed_point(spark):
    assert spark.range(1).select(cents(F.lit(1.005) * 0 + 901.82)).first()[0] == 90182
    assert spark.range(1).select(times_cents(F.lit(199), F.lit(99))).first()[0] == 197


def test_rollup_of_a_stream(spark, tmp_path):
    src, out = f"file://{tmp_path}/in", f"file://{tmp_path}/out"
    rows = spark.createDataFrame([(19960101, 1, 10), (19960102, 1, 5), (19960101, 2, 7)], "lo_orderdate bigint, lo_suppkey bigint, lo_revenue bigint")
    rows.write.parquet(src)
    rollup.maintain(spark.readStream.schema(rows.schema).parquet(src), out, f"file://{tmp_path}/state").awaitTermination()
    assert {(r.lo_suppkey, r.rev_per_week) for r in rollup.current(spark.read.parquet(out)).collect()} == {(1, 15), (2, 7)}
