"""Thinning of frame streams, in batch form: decimation, rate limits, strides and change samplers.

frames: (video_id, sampler_id, idx, media_ts, ...), in arrival order of idx.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from moments.operators.grid import nearest_join


def bucket(ts: Column, rate: float) -> Column:
    return F.floor(ts * rate).cast("long")


def decimate(frames: DataFrame, rate: float = 1.0, by: tuple = ("video_id",), order: str = "idx") -> DataFrame:
    """The first frame of each bucket of media time; a late frame of an older bucket is rejected, so a bucket must exceed every
    bucket before it."""
    w = W.partitionBy(*by).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    top = F.max("bucket").over(w)
    return frames.withColumn("bucket", bucket(F.col("media_ts"), rate)).withColumn("top", top).filter("top is null or bucket > top").drop("top")


def stride(frames: DataFrame, every: int, by: tuple = ("video_id", "chunk_id"), order: str = "media_ts") -> DataFrame:
    n = F.row_number().over(W.partitionBy(*by).orderBy(order, "idx"))
    return frames.withColumn("n", n).filter((F.col("n") - 1) % every == 0).drop("n")


def rate_limit(frames: DataFrame, min_interval: float, most: int | None = None, by: tuple = ("video_id", "sampler_id", "chunk_id")) -> DataFrame:
    """(by, idx) kept: the first of a chunk always, then those at least min_interval after the last kept, up to ``most``. The
    fold runs over the ordered frames of one chunk, whose number the chunk length bounds."""
    item = F.array_sort(F.collect_list(F.struct("media_ts", "idx")))
    full = F.lit(False) if most is None else lambda a: F.size(a.kept) >= most
    start = F.struct(F.lit(None).cast("double").alias("last"), F.array().cast("array<bigint>").alias("kept"))

    def step(a, x):
        ok = a.last.isNull() | (x.media_ts - a.last >= min_interval)
        ok = ok if most is None else ok & ~full(a)
        return F.when(ok, F.struct(x.media_ts.alias("last"), F.concat(a.kept, F.array(x.idx)).alias("kept"))).otherwise(a)

    kept = F.aggregate("items", start, step, lambda a: a.kept)
    return frames.groupBy(*by).agg(item.alias("items")).select(*by, F.explode(kept).alias("idx"))


def change_sampler(frames: DataFrame, threshold: float, by: tuple = ("video_id", "chunk_id")) -> DataFrame:
    """(by, idx) kept: the first, then those whose cosine to the last *kept* vector is below the threshold. The comparison is
    with a moving reference, so each chunk is walked in one task; chunks run in parallel."""
    names = list(by)

    def walk(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("idx")
        v = np.stack(pdf["vector"].to_numpy()).astype("float64")
        v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
        kept, reference = [], None
        for i in range(len(v)):
            if reference is None or float(np.round(v[i] @ reference, 9)) < threshold:
                kept.append(i)
                reference = v[i]
        out = pd.DataFrame({"idx": pdf["idx"].to_numpy()[kept]})
        for n, k in zip(names, key):
            out[n] = k
        return out[[*names, "idx"]]

    kinds = dict(frames.dtypes)
    schema = ", ".join(f"{n} {kinds[n]}" for n in [*names, "idx"])
    return frames.select(*names, "idx", "vector").groupBy(*names).applyInPandas(walk, schema)


def consecutive_changes(frames: DataFrame, similarity, threshold: float, by: tuple = ("video_id", "chunk_id")) -> DataFrame:
    """(by, idx) kept: the first, then those that differ from the frame before. similarity takes two vector Columns."""
    before = F.lag("vector").over(W.partitionBy(*by).orderBy("idx"))
    sim = F.round(similarity(F.col("vector"), F.col("before")), 9)
    return frames.withColumn("before", before).filter(F.col("before").isNull() | (sim < threshold)).select(*by, "idx")


def region_sampler(frames: DataFrame, threshold: float, similarity, by: tuple = ("video_id",)) -> DataFrame:
    """(by, idx) kept, by regions: frames (by, idx, regions ARRAY<ARRAY<DOUBLE>>). A frame's score is the least over its regions
    of the best similarity to the reference's; nothing in shot is not kept and leaves the reference; something after nothing is
    kept. similarity(current, reference) gives the matrix of two lists of regions."""
    names = list(by)

    def walk(key, pdf: pd.DataFrame) -> pd.DataFrame:
        kept, reference = [], None
        for idx, regions in pdf.sort_values("idx")[["idx", "regions"]].itertuples(index=False):
            now = np.array([np.asarray(r, "float64") for r in regions])
            if not len(now):
                continue
            if reference is None or float(similarity(now, reference).max(axis=1).min()) < threshold:
                kept.append(idx)
                reference = now
        out = pd.DataFrame({"idx": kept})
        for n, k in zip(names, key):
            out[n] = k
        return out[[*names, "idx"]]

    kinds = dict(frames.dtypes)
    schema = ", ".join(f"{n} {kinds[n]}" for n in [*names, "idx"])
    return frames.select(*names, "idx", "regions").groupBy(*names).applyInPandas(walk, schema)


@dataclass(frozen=True)
class Sampler:
    """A frame sampler as data. ``describe`` makes a Column of a frame that ``compare`` takes twice, for a similarity; ``propose``
    is the rule that keeps frames:

    "stride": every ``every``-th offered frame of a chunk; "interval": at least ``min_interval`` seconds after the last kept, at
    most ``most`` a chunk; "change": the first of a chunk, and those whose similarity to the frame before is below
    ``threshold``; "drift": the same against the last kept frame (vectors by cosine)."""

    sampler_id: str
    propose: str = "stride"
    every: int = 1
    min_interval: float = 0.0
    most: int | None = None
    threshold: float = 0.5
    describe: Callable[[], Column] | None = None
    compare: Callable[[Column, Column], Column] | None = None

    def __post_init__(self):
        if self.propose not in ("stride", "interval", "change", "drift"):
            raise ValueError("propose must be stride, interval, change or drift")
        if self.propose in ("change", "drift") and self.describe is None or self.propose == "change" and self.compare is None:
            raise ValueError("change and drift need describe, change also compare")

    def kept(self, offered: DataFrame) -> DataFrame:
        """(video_id, chunk_id, idx, score) of the offered frames that stay; score is what ``compare`` gave, if anything."""
        by, none = ["video_id", "chunk_id"], F.lit(None).cast("double").alias("score")
        if self.propose == "stride":
            return stride(offered, self.every, tuple(by), "idx").select(*by, "idx", none)
        if self.propose == "interval":
            return rate_limit(offered, self.min_interval, self.most, tuple(by)).select(*by, "idx", none)
        told = offered.select(*by, "idx", self.describe().alias("vector"))
        if self.propose == "drift":
            return change_sampler(told, self.threshold, tuple(by)).select(*by, "idx", none)
        before = F.lag("vector").over(W.partitionBy(*by).orderBy("idx"))
        scored = told.withColumn("before", before).withColumn("score", F.round(self.compare(F.col("vector"), F.col("before")), 4))
        return scored.filter("before is null or score < " + repr(self.threshold)).select(*by, "idx", "score")


def ingest(frames: DataFrame, chunks: DataFrame, samplers: list[Sampler], rate: float, width: float) -> DataFrame:
    """Frames decimated, placed in their nearest chunk and offered to every sampler, which starts anew in each chunk: a record
    for each frame and sampler that keeps it (video_id, chunk_id, sampler_id, idx, media_ts, chunk_local_index, score)."""
    names = [x.sampler_id for x in samplers]
    if not names or len(set(names)) < len(names):
        raise ValueError("name samplers, each by its own id")
    placed = nearest_join(decimate(frames.drop("sampler_id"), rate), chunks, "media_ts", width)
    local = (F.row_number().over(W.partitionBy("video_id", "chunk_id").orderBy("idx")) - 1).cast("long")
    offered = placed.withColumn("chunk_local_index", local)
    kept = reduce(DataFrame.unionByName, [x.kept(offered).withColumn("sampler_id", F.lit(x.sampler_id)) for x in samplers])
    met = kept.join(offered.select("video_id", "chunk_id", "idx", "media_ts", "chunk_local_index"), ["video_id", "chunk_id", "idx"])
    return met.select("video_id", "chunk_id", "sampler_id", "idx", F.round("media_ts", 3).alias("media_ts"), "chunk_local_index", "score")


def box_iou(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Matrix of intersection over union of boxes (x1, y1, x2, y2)."""
    w = np.maximum(np.minimum(a[:, None, 2], b[None, :, 2]) - np.maximum(a[:, None, 0], b[None, :, 0]), 0)
    h = np.maximum(np.minimum(a[:, None, 3], b[None, :, 3]) - np.maximum(a[:, None, 1], b[None, :, 1]), 0)
    size = lambda x: (x[:, 2] - x[:, 0]) * (x[:, 3] - x[:, 1])
    union = size(a)[:, None] + size(b)[None, :] - w * h
    return np.where(union > 0, w * h / np.where(union > 0, union, 1), 0.0)
