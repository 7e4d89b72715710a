"""Metadata and pruning: exact cases, soundness for random predicates, false-positive rates."""

import random

import pytest
from pyspark.sql import functions as F

from chunklake.operators import advisor, aggregates, joins, layout, metadata, pruning, sweep
from chunklake.operators.joins import Dimension
from chunklake.operators.pruning import Points, Range

CHUNKS = [list(range(15, 23)), [0, 1, 7, 8, 9, 10, 11, 12], [1993] * 8]


@pytest.fixture(scope="module")
def exact(spark):
    return spark.createDataFrame([(c, v) for c, values in enumerate(CHUNKS) for v in values], "chunk_id int, v int")


@pytest.mark.parametrize(
    "low, high, keep",
    [(3, 5, "000"), (12, 12, "01-"), (0, 0, "01-"), (15, 16, "1-0"), (1993, 1993, "001"), (1994, 1994, "000"), (14, 15, "100")],
)
def test_histogram_keeps_and_skips(exact, low, high, keep):
    meta = metadata.chunk_metadata(exact, ["v"], buckets=4)
    kept = {r.chunk_id for r in pruning.surviving(meta, [Range("v", low, high)], "hist", {"v": exact.schema["v"].dataType}, 4).collect()}
    for c, k in enumerate(keep):
        assert k == "-" or (c in kept) == (k == "1")


def test_histogram_counts_every_row(exact):
    assert metadata.histogram(exact, "v", 4).agg(F.sum("n")).first()[0] == 24


def test_minmax_would_keep_what_histograms_skip(exact):
    kept = pruning.surviving(metadata.min_max(exact, ["v"]), [Range("v", 3, 5)], "minmax", {"v": exact.schema["v"].dataType})
    assert [r.chunk_id for r in kept.collect()] == [1]


@pytest.mark.parametrize("mode", pruning.MODES)
def test_pruning_is_sound(spark, mode):
    rnd = random.Random(mode)
    rows = [(rnd.randrange(8), rnd.randrange(-50, 50), round(rnd.uniform(-9, 9), 2), f"h{rnd.randrange(30)}") if rnd.random() > 0.05 else (rnd.randrange(8), None, None, None) for _ in range(400)]
    df = spark.createDataFrame(rows, "chunk_id int, a int, b double, s string").cache()
    kinds = {f.name: f.dataType for f in df.schema}
    bloom = metadata.Bloom(0.05, 64)
    meta = metadata.chunk_metadata(df, ["a", "b", "s"], 6, bloom).cache()
    for _ in range(4):
        lo = rnd.randrange(-60, 60)
        preds = rnd.choice([[Range("a", lo, lo + rnd.randrange(6))], [Range("b", lo / 7, lo / 7 + 1.5)], [Points("s", (f"h{rnd.randrange(40)}", f"h{rnd.randrange(40)}"))], [Range("a", lo, lo + 9), Points("s", (f"h{rnd.randrange(30)}",))]])
        rule = F.lit(True)
        for p in preds:
            rule = rule & (F.col(p.column).between(p.low, p.high) if isinstance(p, Range) else F.col(p.column).isin(*p.values))
        kept = pruning.surviving(meta, preds, mode, kinds, 6, bloom)
        assert pruning.pruned_scan(df, kept).where(rule).count() == df.where(rule).count()


def test_dates_have_histograms(spark):
    df = spark.sql("select cast(id div 10 as int) as chunk_id, date_add(date'2000-01-01', cast(id * 3 as int)) as d, timestamp_ntz'2000-01-01 00:00:00' + make_dt_interval(cast(id as int)) as t from range(40)")
    kinds = {f.name: f.dataType for f in df.schema}
    meta = metadata.chunk_metadata(df, ["d", "t"], 5)
    kept = pruning.surviving(meta, [Range("d", "2000-01-31", "2000-02-02")], "hist", kinds, 5)
    assert {r.chunk_id for r in kept.collect()} == {1}
    assert pruning.surviving(meta, [Range("t", "1999-01-01", "1999-12-31")], "combined", kinds, 5).count() == 0


def test_strings_have_no_histogram(spark):
    with pytest.raises(TypeError):
        metadata.histogram(spark.sql("select 0 as chunk_id, 'a' as s"), "s", 4)


@pytest.mark.parametrize("p", [0.05, 0.25])
def test_bloom_rate(spark, p):
    bloom = metadata.Bloom(p, 256)
    n = bloom.load
    df = spark.range(n).select(F.lit(0).alias("chunk_id"), F.col("id").alias("v"))
    words = {r.word: r.bits for r in metadata.bloom_words(df, "v", bloom).collect()}
    probe = spark.range(n, n + 4000).select(*(b.alias(f"b{i}") for i, b in enumerate(bloom.places(F.col("id"))))).collect()
    hit = sum(all(words.get(b // 64, 0) >> (b % 64) & 1 for b in r) for r in probe)
    assert hit / 4000 <= p + 0.05


def test_join_pruning(spark):
    meta = spark.createDataFrame([(0, 1, 10), (1, 11, 20), (2, 21, 30)], "chunk_id int, k_min bigint, k_max bigint")
    keys = spark.createDataFrame([(5,), (29,), (99,)], "k bigint")
    assert sorted(r.chunk_id for r in pruning.join_pruned(meta, "k", keys, "k", 3).collect()) == [0, 2]


def test_prejoin_needs_every_row(spark):
    fact, dim = spark.createDataFrame([(1,), (2,)], "f bigint"), spark.createDataFrame([(1, "x")], "d bigint, a string")
    with pytest.raises(Exception, match="no row of d"):
        joins.prejoin(fact, [Dimension(dim, "d", "f", ("a",))]).collect()


def test_lookup_takes_one_match(spark):
    a, b = spark.createDataFrame([(1,), (1,), (3,)], "k bigint"), spark.createDataFrame([(1, "x"), (1, "y")], "k bigint, v string")
    assert joins.lookup(a, b, "k").count() == 2
    assert joins.join_count(a, b, "k").first().hits == 2


def test_clustered_layout(spark, tmp_path):
    df = spark.range(1000).select((F.col("id") * 7 % 100).alias("v"))
    t = layout.clustered_write(df, f"file://{tmp_path}/t", 5, ["v"], "zstd")
    ends = t.groupBy("chunk_id").agg(F.min("v").alias("a"), F.max("v").alias("b")).orderBy("chunk_id").collect()
    assert t.count() == 1000 and all(x.b <= y.a for x, y in zip(ends, ends[1:], strict=False))
    plan = pruning.pruned_scan(t, spark.range(1).select(F.col("id").cast("int").alias("chunk_id")))._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan or "PartitionFilters" in plan


def test_listed_scan(spark, tmp_path):
    t = layout.clustered_write(spark.range(100).select(F.col("id").alias("v")), f"file://{tmp_path}/t", 4, ["v"])
    some = spark.sql("select 1 as chunk_id")
    rows = [pruning.listed_scan(t, some, n).count() for n in (10, 0)]
    assert rows[0] == rows[1] and 0 < rows[0] < 100


def test_kmeans_chunks(spark):
    df = spark.range(600).select((F.col("id") % 3 * 100 + F.rand(1)).alias("x"), F.rand(2).alias("y"))
    chunks = layout.kmeans_chunks(df, ["x", "y"], 3, 5, most_rows=150)
    sizes = [r["count"] for r in chunks.groupBy("chunk_id").count().collect()]
    assert sum(sizes) == 600 and len(sizes) > 3


def test_sorts(spark):
    df = spark.createDataFrame([(i, i % 3, (20 - i) * 1.1) for i in range(20)], "i int, a int, b double")
    place = {r.i: r.place for r in layout.permutation(df, "i", "a", "b").collect()}
    order = sorted(range(20), key=lambda i: (i % 3, (20 - i) * 1.1))
    assert [place[i] for i in order] == list(range(20))
    assert [r.i for r in layout.sort_by(df, "i", ascending=False).collect()] == list(range(19, -1, -1))


def test_pairwise(spark):
    df = spark.createDataFrame([(0, 0.0), (1, 3.0), (2, 4.0)], "i int, x double")
    assert {(r.i, r.j): r.distance for r in layout.pairwise_distances(df, "i", ["x"]).collect()} == {(0, 1): 9.0, (0, 2): 16.0, (1, 2): 1.0}


def test_fold_and_average(spark):
    df = spark.range(1, 101).select("id")
    assert aggregates.folded(df, "id", F.lit(0).cast("bigint"), lambda a, b: a + b).first().value == 5050
    assert spark.range(1).select(aggregates.average(F.lit(1), F.lit(0)).alias("a")).first().a is None


def test_advice(spark, tmp_path):
    s = advisor.sample_codecs(spark.range(2000).select((F.col("id") % 4).alias("v")), ["v"], f"file://{tmp_path}", ("uncompressed", "zstd"), 1.0)
    assert advisor.advise(s).first().best_ratio in ("uncompressed", "zstd")
    with pytest.raises(ValueError):
        advisor.sample_rows(spark.range(3), 5)


def test_slices():
    assert [len(x) for x in advisor.slices(6, 8)] == [1] * 6 + [0, 0]
    assert sum(len(x) for x in advisor.slices(29, 4)) == 29


def test_sweep(spark, tmp_path):
    df = spark.range(400).select((F.col("id") * 7 % 100).alias("v"), F.col("id").alias("w"))
    runs = sweep.sweep(df, lambda rows: rows.where("v between 3 and 5").agg(F.sum("w")), [Range("v", 3, 5)], f"file://{tmp_path}", sorts={"natural": [], "v": ["v"]}, chunks=(4,), modes=("none", "combined"))
    by = {(r.sort, r.mode): r for r in sweep.metrics(spark, runs).collect()}
    assert by["v", "combined"].pruned_chunks >= 2 and by["v", "none"].pruned_chunks == 0
    assert 0.4 < by["v", "combined"].skipped < 1 and by["natural", "none"].gib_s > 0


def test_command_line(spark, tmp_path):
    from chunklake.sources import files

    spark.range(5).selectExpr("5 - id as a", "id as b").write.parquet(f"file://{tmp_path}/in")
    files.main(["sort", f"file://{tmp_path}/in", f"file://{tmp_path}/out", "--by", "a"])
    assert spark.read.parquet(f"file://{tmp_path}/out").count() == 5
