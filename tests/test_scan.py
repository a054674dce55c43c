"""Scans by ranges against windows, with half of all rows in one group, ties and nulls."""

from pyspark.sql import functions as F

from moments.operators import scan as sc
from moments.operators import stats, thin


def frames(spark):
    x = F.col("id")
    return spark.range(20_000).select(
        F.when(x % 2 == 0, "hot").when(x % 1000 == 1, None).otherwise(F.concat(F.lit("v"), (x % 13).cast("string"))).alias("video_id"), x.alias("idx"), (x * 0.3 - x % 7 * 2.0).alias("media_ts")
    )


def plain(df):
    return sorted(map(str, df.collect()))


def test_decimation_and_batches(spark):
    f = frames(spark)
    assert plain(sc.decimated(f, 0.5).select("video_id", "idx", "bucket")) == plain(thin.decimate(f, 0.5).select("video_id", "idx", "bucket"))
    by = ["video_id"]
    assert plain(sc.batched(f, by, ["media_ts", "idx"], 7).select("video_id", "idx", "batch")) == plain(stats.batched(f, by, ["media_ts", "idx"], 7).select("video_id", "idx", "batch"))
    assert sc.batched(f.limit(0), by, ["idx"], 7).count() == 0


def test_a_value_of_all_rows_is_spread(spark):
    same = spark.range(40_000).select(F.lit("g").alias("g"), F.lit(1.0).alias("v"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # small ranges are joined to one otherwise
    try:
        parts = sc.ranged(same, ["g"], [F.col("v")]).groupBy("_part").count().collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(parts) >= 6 and max(r["count"] for r in parts) < 12_000
    n = [r.n for r in sc.numbered(same, ["g"], [F.col("v")]).select("n").collect()]
    assert sorted(n) == list(range(1, 40_001))


def test_order_statistics(spark):
    rows = [("a", float(x % 37)) for x in range(1001)] + [("b", 5.0)] + [("c", 1.0), ("c", 2.0)] + [("d", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    assert {r.g: r.median for r in sc.upper_median(df, ["g"], "v").collect()} == {"a": sorted(v for g, v in rows if g == "a")[500], "b": 5.0, "c": 2.0}
    want = {r.g: r.q for r in df.filter("v IS NOT NULL").groupBy("g").agg(F.percentile("v", 0.95).alias("q")).collect()}
    got = {r.g: r.quantile for r in sc.quantile(df, ["g"], "v", 0.95).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in got)
