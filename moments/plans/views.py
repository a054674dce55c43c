"""The data model's tables, read from the star-schema tables. Each has the same name and columns as SQL text in CTES."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

START = "timestamp_ntz'2024-01-01 00:00:00'"
#: Speech is read at 60 ms a character.
MS = 60


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sampled frames: video = user, sampler = event type, index = event."""
    return table(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("video_id"),
        F.col("event_type").alias("sampler_id"),
        F.col("event_id").alias("idx"),
        (F.expr(f"timestampdiff(MICROSECOND, {START}, ts)") / 1e6).alias("media_ts"),
        F.col("value").alias("score"),
    )


def media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames(spark, sf_dir).groupBy("video_id").agg(F.max("media_ts").alias("duration_s"))


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Speaker turns: video = conversation; the system speaks without a name; times add up characters and pauses."""
    pause = (F.col("conv_id") * 31 + F.col("turn") * 17) % 10 * 200 - 400
    length = F.length("text") * MS
    order = W.partitionBy("conv_id").orderBy("turn")
    before = order.rowsBetween(W.unboundedPreceding, -1)
    start = F.coalesce(F.sum(length + F.greatest(pause, -length)).over(before), F.lit(0))
    return (
        table(spark, sf_dir, "conversations")
        .withColumn("ms", start)
        .select(
            F.col("conv_id").cast("string").alias("video_id"),
            F.col("turn").alias("seq"),
            F.when(F.col("role") != "system", F.col("role")).alias("speaker"),
            (F.col("ms") / 1000.0).alias("start"),
            ((F.col("ms") + length) / 1000.0).alias("end"),
            "text",
        )
    )


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words with times inside their turn."""
    cut = turns(spark, sf_dir).select("video_id", "seq", "speaker", "start", F.posexplode(F.split("text", " ")).alias("n", "word"))
    before = W.partitionBy("video_id", "seq").orderBy("n").rowsBetween(W.unboundedPreceding, -1)
    offset = F.coalesce(F.sum(F.length("word") + 1).over(before), F.lit(0)) * MS
    base = F.round(F.col("start") * 1000).cast("long")
    return (
        cut.withColumn("ms", base + offset)
        .filter("word <> ''")
        .select(
            "video_id", "seq", "n", "speaker", "word",
            (F.col("ms") / 1000.0).alias("start"), ((F.col("ms") + F.length("word") * MS) / 1000.0).alias("end"),
        )
    )


def units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text units: video = source, chunk = document, sampler = language."""
    return table(spark, sf_dir, "documents").select(
        F.col("source").alias("video_id"), F.col("doc_id").alias("chunk_id"), F.col("lang").alias("sampler_id"),
        F.col("text").alias("content"), "n_chars",
    )


CTES = f"""
frames AS (SELECT CAST(user_id AS VARCHAR) AS video_id, event_type AS sampler_id, event_id AS idx,
  date_diff('microsecond', TIMESTAMP '2024-01-01', ts) / 1e6 AS media_ts, value AS score FROM events),
media AS (SELECT video_id, max(media_ts) AS duration_s FROM frames GROUP BY video_id),
turns0 AS (SELECT *, length(text) * {MS} AS len, (conv_id * 31 + turn * 17) % 10 * 200 - 400 AS pause FROM conversations),
turns1 AS (SELECT *, CAST(coalesce(sum(len + greatest(pause, -len)) OVER (PARTITION BY conv_id ORDER BY turn
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS ms FROM turns0),
turns AS (SELECT CAST(conv_id AS VARCHAR) AS video_id, turn AS seq, CASE WHEN role <> 'system' THEN role END AS speaker,
  ms / 1000.0 :: DOUBLE AS start, (ms + len) / 1000.0 :: DOUBLE AS "end", text FROM turns1),
words0 AS (SELECT CAST(conv_id AS VARCHAR) AS video_id, turn AS seq, CASE WHEN role <> 'system' THEN role END AS speaker, ms,
  string_split(text, ' ') AS ws FROM turns1),
words1 AS (SELECT video_id, seq, speaker, ms, unnest(ws) AS word, unnest(range(len(ws))) AS n FROM words0),
words2 AS (SELECT *, ms + {MS} * CAST(coalesce(sum(length(word) + 1) OVER (PARTITION BY video_id, seq ORDER BY n
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS wms FROM words1),
words AS (SELECT video_id, seq, n, speaker, word, wms / 1000.0 :: DOUBLE AS start,
  (wms + length(word) * {MS}) / 1000.0 :: DOUBLE AS "end" FROM words2 WHERE word <> ''),
units AS (SELECT source AS video_id, doc_id AS chunk_id, lang AS sampler_id, text AS content, n_chars FROM documents)
"""
DAY = 86400.0
#: The uniform grid of a day a chunk, its tail merged below a quarter.
GRID = f"""
grid0 AS (SELECT video_id, duration_s, k * {DAY}::DOUBLE AS s, least((k + 1) * {DAY}::DOUBLE, duration_s) AS e, k,
  CAST(ceil(duration_s / {DAY}::DOUBLE) AS BIGINT) AS n FROM media, range(40) r(k) WHERE k < ceil(duration_s / {DAY}::DOUBLE)),
chunks AS (SELECT video_id, k AS chunk_id, s AS start_ts,
  CASE WHEN k = n - 2 AND duration_s - (n - 1) * {DAY}::DOUBLE < {DAY}::DOUBLE * 0.25 THEN duration_s ELSE e END AS end_ts
  FROM grid0 WHERE NOT (k = n - 1 AND n > 1 AND e - s < {DAY}::DOUBLE * 0.25))
"""


def sql(body: str, *more: str) -> str:
    return "WITH " + ",".join([CTES, *more]) + body
