"""Chunk grids from durations and cuts, and joins of points and windows with a grid.

A grid is chunks(video_id, chunk_id, start_ts, end_ts), contiguous within a video. Spans are (video_id, start_ts, end_ts).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

TAIL = 0.25


def in_video():
    return W.partitionBy("video_id").orderBy("start_ts")


def numbered(spans: DataFrame) -> DataFrame:
    return spans.select("video_id", (F.row_number().over(in_video()) - 1).cast("long").alias("chunk_id"), "start_ts", "end_ts")


def merge_tail(spans: DataFrame, floor: float) -> DataFrame:
    """The last span, where it is shorter than the floor, joins its predecessor. One window over each video."""
    last = W.partitionBy("video_id").orderBy(F.desc("start_ts"))
    n = F.count(F.lit(1)).over(W.partitionBy("video_id"))
    whole = spans.withColumn("back", F.row_number().over(last)).withColumn("n", n)
    short = F.first("tail").over(last.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)) < floor
    marked = whole.withColumn("tail", F.col("end_ts") - F.col("start_ts")).withColumn("short", short & (F.col("n") > 1))
    end = F.when(F.col("short") & (F.col("back") == 2), F.lag("end_ts").over(last)).otherwise(F.col("end_ts"))
    return marked.withColumn("end_ts", end).filter("not (short and back = 1)").select("video_id", "start_ts", "end_ts")


def uniform(media: DataFrame, chunk_s: float = 20.0, tail: float = TAIL) -> DataFrame:
    """A fixed grid, truncated at the duration; no window is needed, since every chunk knows its place."""
    n = F.ceil(F.col("duration_s") / chunk_s).cast("long")
    rows = media.filter("duration_s > 0").select(
        "video_id", "duration_s", n.alias("n"), F.explode(F.sequence(F.lit(0).cast("long"), n - 1)).alias("chunk_id")
    )
    start = F.col("chunk_id") * F.lit(float(chunk_s))
    short = (F.col("n") > 1) & (F.col("duration_s") - (F.col("n") - 1) * F.lit(float(chunk_s)) < chunk_s * tail)
    end = F.when(
        (F.col("chunk_id") == F.col("n") - 1) | (short & (F.col("chunk_id") == F.col("n") - 2)), F.col("duration_s")
    ).otherwise(start + chunk_s)
    return rows.filter(~(short & (F.col("chunk_id") == F.col("n") - 1))).select(
        "video_id", "chunk_id", start.alias("start_ts"), end.alias("end_ts")
    )


def spans_of(media: DataFrame, cuts: DataFrame) -> DataFrame:
    """Spans between 0, the cuts inside (0, duration) and the duration; empty ones are dropped."""
    inner = cuts.join(media, "video_id").filter("at > 0 and at < duration_s").select("video_id", "at")
    ends = media.select("video_id", F.explode(F.array(F.lit(0.0), "duration_s")).alias("at"))
    edge = W.partitionBy("video_id").orderBy("at")
    return (
        inner.unionByName(ends)
        .distinct()
        .select("video_id", F.col("at").alias("start_ts"), F.lead("at").over(edge).alias("end_ts"))
        .filter("end_ts > start_ts")
    )


def min_merge(spans: DataFrame, min_s: float) -> DataFrame:
    """A span shorter than min_s joins the group before it; a first group that is still short takes in the next. Each span
    is judged by its own length, so a running sum numbers the groups."""
    length = F.col("end_ts") - F.col("start_ts")
    opens = ((F.row_number().over(in_video()) == 1) | (length >= min_s)).cast("long")
    grouped = spans.withColumn("g", F.sum(opens).over(in_video().rowsBetween(W.unboundedPreceding, 0)))
    merged = grouped.groupBy("video_id", "g").agg(F.min("start_ts").alias("start_ts"), F.max("end_ts").alias("end_ts"))
    first = F.max(F.when(F.col("g") == 1, length)).over(W.partitionBy("video_id"))
    many = F.max("g").over(W.partitionBy("video_id")) > 1
    fixed = merged.withColumn("g", F.when(many & (first < min_s), F.greatest("g", F.lit(2))).otherwise(F.col("g")))
    return fixed.groupBy("video_id", "g").agg(F.min("start_ts").alias("start_ts"), F.max("end_ts").alias("end_ts")).drop("g")


def max_split(spans: DataFrame, max_s: float) -> DataFrame:
    """Longer spans are cut into the least number of equal pieces."""
    length = F.col("end_ts") - F.col("start_ts")
    k = F.greatest(F.lit(1), F.ceil(length / max_s)).cast("long")
    cut = spans.select("video_id", "start_ts", "end_ts", k.alias("k"), F.explode(F.sequence(F.lit(0).cast("long"), k - 1)).alias("i"))
    step = (F.col("end_ts") - F.col("start_ts")) / F.col("k")
    return cut.select(
        "video_id",
        (F.col("start_ts") + step * F.col("i")).alias("start_ts"),
        F.when(F.col("i") == F.col("k") - 1, F.col("end_ts")).otherwise(F.col("start_ts") + step * (F.col("i") + 1)).alias("end_ts"),
    )


def from_cuts(media: DataFrame, cuts: DataFrame, min_s: float = 5.0, max_s: float | None = 30.0) -> DataFrame:
    spans = min_merge(spans_of(media, cuts), min_s)
    spans = max_split(spans, max_s) if max_s else spans
    return numbered(merge_tail(spans, min_s))


POLICIES = ("uniform", "scene", "vad", "speaker")


def build(media, policy: str, cuts=None, chunk_s: float = 20.0, min_s: float = 5.0, max_s: float | None = None) -> DataFrame:
    """One grid, whatever the policy; the longest chunk defaults to the chunk length."""
    if policy not in POLICIES:
        raise ValueError(f"policy must be one of {POLICIES}")
    if policy == "uniform":
        return uniform(media, chunk_s)
    if cuts is None:
        raise ValueError(f"policy {policy} needs cuts")
    top = chunk_s if max_s is None else max_s
    if min_s > top:
        raise ValueError("the least chunk is longer than the longest")
    return from_cuts(media, cuts, min_s, top)


def rethreshold(scores: DataFrame, threshold: float) -> DataFrame:
    """Cuts from a cached score series."""
    return scores.filter(F.col("value") >= threshold).select("video_id", "at", "value")


def sweep(scores: DataFrame, thresholds: list[float]) -> DataFrame:
    """For each threshold: cuts, their share of the scores, and the upper median gap between cuts."""
    t = F.array(*map(F.lit, thresholds))
    met = scores.select("video_id", "at", F.explode(F.filter(t, lambda x: F.col("value") >= x)).alias("threshold"))
    gap = F.col("at") - F.lag("at").over(W.partitionBy("video_id", "threshold").orderBy("at"))
    cut = met.withColumn("gap", gap).groupBy("video_id", "threshold").agg(
        F.count(F.lit(1)).alias("cuts"), F.array_sort(F.collect_list("gap")).alias("gaps")
    )
    total = scores.groupBy("video_id").agg(F.count(F.lit(1)).alias("n"))
    every = total.select("video_id", "n", F.explode(t).alias("threshold"))
    out = every.join(cut, ["video_id", "threshold"], "left")
    return out.select(
        "video_id", "threshold", F.coalesce("cuts", F.lit(0)).alias("cuts"), (F.coalesce("cuts", F.lit(0)) / F.col("n")).alias("rate"),
        F.get("gaps", F.floor(F.size("gaps") / 2).cast("int")).alias("median_gap"),
    )


def grid_stats(chunks: DataFrame, cuts: DataFrame) -> DataFrame:
    length = F.col("end_ts") - F.col("start_ts")
    offered = cuts.groupBy("video_id").agg(F.count(F.lit(1)).alias("offered"))
    return (
        chunks.groupBy("video_id")
        .agg(F.count(F.lit(1)).alias("chunks"), F.min(length).alias("shortest"), F.max(length).alias("longest"))
        .join(offered, "video_id", "left")
        .fillna(0, ["offered"])
    )


def _bins(low: Column, high: Column, width: float) -> Column:
    return F.explode(F.sequence(F.floor(low / width), F.floor(high / width)))


def point_join(points: DataFrame, chunks: DataFrame, at: str, width: float, how: str = "inner") -> DataFrame:
    """Points with the chunk_id that holds them: start <= at < end, and the end of the last chunk too. Both sides meet on
    (video, bin of width seconds), so the join is an equi-join; a chunk lies in as many bins as it is wide."""
    last = F.row_number().over(W.partitionBy("video_id").orderBy(F.desc("start_ts"))) == 1
    binned = chunks.withColumn("is_last", last).select(
        F.col("video_id").alias("c_video"), "chunk_id", "start_ts", "end_ts", "is_last", _bins(F.col("start_ts"), F.col("end_ts"), width).alias("c_bin")
    )
    on = (
        (points["video_id"] == F.col("c_video"))
        & (F.floor(points[at] / width) == F.col("c_bin"))
        & (points[at] >= F.col("start_ts"))
        & ((points[at] < F.col("end_ts")) | (F.col("is_last") & (points[at] == F.col("end_ts"))))
    )
    return points.join(binned, on, how).drop("c_video", "c_bin", "is_last")


def nearest_join(points: DataFrame, chunks: DataFrame, at: str, width: float) -> DataFrame:
    """As point_join, but points before the first or past the last chunk go to it."""
    ends = chunks.groupBy("video_id").agg(
        F.min("chunk_id").alias("first_id"), F.max("chunk_id").alias("last_id"), F.min("start_ts").alias("first_ts")
    )
    found = point_join(points, chunks, at, width, "left").join(ends, "video_id")
    clamp = F.when(F.col(at) < F.col("first_ts"), F.col("first_id")).otherwise(F.col("last_id"))
    return found.withColumn("chunk_id", F.coalesce("chunk_id", clamp)).drop("first_id", "last_id", "first_ts", "start_ts", "end_ts")


def window_chunks(chunks: DataFrame, after: float | None = None, before: float | None = None) -> DataFrame:
    """Chunks that overlap a time window with open bounds."""
    out = chunks if after is None else chunks.filter(F.col("end_ts") > after)
    return out if before is None else out.filter(F.col("start_ts") < before)


def widen(chosen: DataFrame, chunks: DataFrame, n: int) -> DataFrame:
    """chosen (video_id, chunk_id) with n neighbours on both sides, kept to the grid; a video whose grid knows none of them
    keeps its own."""
    keys = chosen.select("video_id", "chunk_id")
    around = F.explode(F.sequence(F.col("chunk_id") - n, F.col("chunk_id") + n))
    near = keys.select("video_id", around.alias("chunk_id")).distinct()
    kept = near.join(chunks.select("video_id", "chunk_id"), ["video_id", "chunk_id"], "left_semi")
    lost = keys.distinct().join(kept.select("video_id").distinct(), "video_id", "left_anti")
    return kept.unionByName(lost.select("video_id", "chunk_id"))


def span_of(cited: DataFrame, chunks: DataFrame, key: str) -> DataFrame:
    """(key, start_ts, end_ts) of cited (key, video_id, chunk_id); ids that the grid lacks are ignored, none valid is (0, 0)."""
    met = cited.join(chunks, ["video_id", "chunk_id"], "left")
    return met.groupBy(key).agg(
        F.coalesce(F.min("start_ts"), F.lit(0.0)).alias("start_ts"), F.coalesce(F.max("end_ts"), F.lit(0.0)).alias("end_ts")
    )
