"""A hundred thousand rows without doc_id, or of one text, spread over shards and tasks."""

from collections import Counter

from pyspark.sql import functions as F

from moments.llm import mixing, sharding


def test_rows_without_doc_id_fill_many_shards(spark):
    hot = spark.range(100_000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("a few words of text here").alias("text"), F.lit("x").alias("source"))
    some = spark.range(500).select(F.col("id").alias("doc_id"), F.lit("other words").alias("text"), F.lit("y").alias("source"))
    sizes = hot.unionByName(some).select("doc_id", F.lit(6).alias("size"), F.lit("00000000").alias("draw"), F.monotonically_increasing_id().alias("row_place"))
    out = mixing.spread_out(sizes, 1 << 16)
    assert out.filter("doc_id IS NULL").select("draw").distinct().count() == 100_000
    assert out.filter("doc_id IS NOT NULL").select("draw").distinct().count() == 1
    mixed = mixing.mix(hot.unionByName(some), shard_words=1 << 16)
    got = {r.name: r for r in mixed.groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.sum("taken").alias("t"), F.first("target").alias("g"), F.max("taken").alias("m")).collect()}
    assert got["x"].n == 100_000 and got["y"].n == 500
    assert abs(got["x"].t - got["x"].g) < 0.01 * got["x"].g and got["x"].m <= 12


def test_equal_rows_take_each_place_once(spark):
    hot = spark.range(100_000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("the same").alias("text"), F.col("id").cast("string").alias("source"))
    some = spark.range(2_000).select((F.col("id") % 700).alias("doc_id"), F.lit("another").alias("text"), F.lit("s").alias("source"))
    out = sharding.sharded_documents(hot.unionByName(some)).select("source", "shard", "slot").collect()
    assert len(out) == 102_000 and len({r.source for r in out}) == 100_001
    slots = Counter(r.shard for r in out)
    assert len({(r.shard, r.slot) for r in out}) == 102_000
    assert all(max(r.slot for r in out if r.shard == k) == n - 1 for k, n in slots.items())


def test_very_long_texts(spark):
    long = "word " * 400_000
    docs = spark.createDataFrame([(1, long, "x"), (2, "short text", "x"), (3, long + "end", "y"), (None, None, None)], "doc_id long, text string, source string")
    mixed = {r.doc_id: (r["size"], r.taken) for r in mixing.mix(docs).collect()}
    assert mixed[1][0] == 400_000 and all(t <= 2 * s for s, t in mixed.values())
    out = sharding.sharded_documents(docs).collect()
    assert {r.doc_id for r in out} == {1, 2, 3, None} and {len(r.text or "") for r in out} == {2_000_000, 10, 2_000_003, 0}
