"""Candidate links of mentions by matrix tiles: similarities stay in the task that makes them.

The mentions of a video are dealt to blocks by answer, so an answer is whole in its block, and every two blocks of a video are one
tile of one task: a matrix product gives all similarities of the tile, and what is best for a mention in an answer is known there, so
only links leave the task. A video of n mentions has (n / block)^2 / 2 tiles, spread over all tasks, however large it is. Pairs of one
answer, which calibrate the threshold, arise inside an answer only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moments.functions.vectors import dot, unit

BLOCK = 512
LINKS = "video_id string, mention_i long, mention_j long, answer_i long, answer_j long, sim double"


def calibration_pairs(mentions: DataFrame, digits: int = 9) -> DataFrame:
    """(video_id, mention_i, mention_j, answer_i, answer_j, sim) of the pairs of one answer: provably different."""
    u = mentions.select("video_id", "answer", "mention", unit(F.col("vector")).alias("u"))
    a, b = (u.withColumnsRenamed({"mention": f"mention_{k}", "u": f"u_{k}"}) for k in "ij")
    met = a.join(b, ["video_id", "answer"]).filter("mention_i < mention_j")
    sim = F.round(dot(F.col("u_i"), F.col("u_j")), digits)
    return met.select("video_id", "mention_i", "mention_j", F.col("answer").alias("answer_i"), F.col("answer").alias("answer_j"), sim.alias("sim"))


def tiles(mentions: DataFrame, bars: DataFrame, block: int = BLOCK) -> DataFrame:
    """(video_id, threshold, left, right): every two blocks of a video that has a threshold; blocks are arrays of mentions in order."""
    size = mentions.groupBy("video_id").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("n")).join(bars, "video_id")
    at = F.pmod(F.xxhash64("answer"), F.col("n")).cast("int")
    dealt = mentions.join(size, "video_id").withColumn("at", at)
    item = F.struct("answer", "mention", "field", F.transform("vector", lambda x: x.cast("double")).alias("vector"))
    held = dealt.groupBy("video_id", "n", "threshold", "at").agg(F.array_sort(F.collect_list(item)).alias("items"))  # about ``block`` rows
    # a block meets each block once: as left of those from its own number on, as right of those up to it
    last = F.col("n") - 1
    left = held.select("video_id", "threshold", F.col("at").alias("i"), F.explode(F.sequence(F.col("at"), last)).alias("j"), F.col("items").alias("left"))
    right = held.select("video_id", F.col("at").alias("j"), F.explode(F.sequence(F.lit(0), F.col("at"))).alias("i"), F.col("items").alias("right"))
    return left.join(right, ["video_id", "i", "j"])


def links_of(left: list, right: list, threshold: float, mutual: bool, same: bool, digits: int = 9) -> list[tuple]:
    """The links of a tile: pairs of two answers and one field above the threshold which, under ``mutual``, are each other's best in the
    other's answer (the least mention of equal ones). Items: (answer, mention, field, unit vector), by answer and mention."""
    a, b = (np.array([x[0] for x in side]) for side in (left, right))
    sim = np.round(np.stack([x[3] for x in left]) @ np.stack([x[3] for x in right]).T, digits)
    rows, cols = np.nonzero((sim > threshold) & (a[:, None] != b[None, :]))
    if mutual and len(rows):
        starts_b, starts_a = np.flatnonzero(np.r_[True, b[1:] != b[:-1]]), np.flatnonzero(np.r_[True, a[1:] != a[:-1]])
        group_b, group_a = np.searchsorted(starts_b, cols, side="right") - 1, np.searchsorted(starts_a, rows, side="right") - 1
        there = np.maximum.reduceat(sim, starts_b, axis=1)[rows, group_b] == sim[rows, cols]
        back = np.maximum.reduceat(sim, starts_a, axis=0)[group_a, cols] == sim[rows, cols]
        best = np.flatnonzero(there & back)
        rows, cols, first_b, first_a = rows[best], cols[best], starts_b[group_b[best]], starts_a[group_a[best]]
        least = [not (sim[r, fb:c] == sim[r, c]).any() and not (sim[fa:r, c] == sim[r, c]).any() for r, c, fb, fa in zip(rows, cols, first_b, first_a)]
        rows, cols = rows[least], cols[least]
    out = []
    for r, c in zip(rows.tolist(), cols.tolist()):
        x, y = left[r], right[c]
        if x[2] != y[2] or same and x[1] >= y[1]:
            continue
        x, y = (x, y) if x[1] < y[1] else (y, x)
        out.append((x[1], y[1], x[0], y[0], float(sim[r, c])))
    return out


def linked(mentions: DataFrame, bars: DataFrame, mutual: bool = True, block: int = BLOCK) -> DataFrame:
    """The links (video_id, mention_i, mention_j, answer_i, answer_j, sim) of mentions (video_id, mention, answer, field, vector) above
    bars (video_id, threshold); a video without a threshold links nothing."""

    def unit_items(items):
        out = []
        for x in items:
            v = np.asarray(x["vector"], "float64")
            n = np.linalg.norm(v)
            out.append((x["answer"], x["mention"], x["field"], v / n if n else v))
        return out

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for video, threshold, i, j, left, right in batch[["video_id", "threshold", "i", "j", "left", "right"]].itertuples(index=False):
                found = links_of(unit_items(left), unit_items(right), threshold, mutual, i == j)
                yield pd.DataFrame([(video, *x) for x in found], columns=["video_id", "mention_i", "mention_j", "answer_i", "answer_j", "sim"])

    return tiles(mentions, bars, block).mapInPandas(run, LINKS)
