"""Frame samplers as one fold, for tables and for streams.

A sampler sees the frames of a chunk in order. Three things lie over every rule: a chunk that has its most frames takes no more; a
frame less than the least interval after the last kept one is not shown to the rule; the first frame is always kept. The rules:

* "stride": every ``every``-th frame of the chunk, counted over all that were offered
* "interval": every frame that is shown
* "consecutive": the similarity to the frame shown before is below ``threshold``
* "reference": the similarity to the last frame that the rule chose is below it, so slow change adds up
* "regions": frames are lists of vectors; the weakest of the best matches with the reference is below it. A frame with nothing in it is not
  chosen and leaves the reference; something after nothing is chosen

``describe`` makes a Column of a frame, evaluated by Spark before the fold; ``similarity`` takes two described frames in Python.
The state of a fold is a small dict that JSON can hold: counts, a time and one reference.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RULES = ("stride", "interval", "consecutive", "reference", "regions")
RECORD = "sampler_id string, idx long, media_ts double, chunk_local_index long, score double"


def cosine(a, b) -> float:
    """Cosine of two vectors to nine places; 0 where one has no length."""
    a, b = np.asarray(a, "float64"), np.asarray(b, "float64")
    size = np.linalg.norm(a) * np.linalg.norm(b)
    return round(float(a @ b / size), 9) if size else 0.0


@dataclass(frozen=True)
class FrameRule:
    sampler_id: str
    rule: str = "stride"
    every: int = 1
    min_interval: float = 0.0
    most: int | None = None
    threshold: float = 0.5
    describe: Callable[[], Column] | None = None
    similarity: Callable = cosine

    def __post_init__(self):
        if self.rule not in RULES:
            raise ValueError(f"rule must be one of {', '.join(RULES)}")
        if self.min_interval < 0 or self.most is not None and self.most < 1 or self.every < 1:
            raise ValueError("min_interval must be 0 or more, most and every 1 or more")
        if self.rule in RULES[2:] and self.describe is None:
            raise ValueError(f"the rule {self.rule} needs describe")

    def offer(self, state: dict, ts: float, place: int, told) -> tuple[bool, float | None]:
        """Whether the frame is kept, and the score of the rule; state ({} at the start of a chunk) is moved on."""
        if self.most is not None and state.get("kept", 0) >= self.most:
            return False, None
        last = state.get("last")
        if last is not None and ts - last < self.min_interval:
            return False, None
        chosen, score = self._choose(state, place, told)
        if chosen or last is None:
            state["kept"], state["last"] = state.get("kept", 0) + 1, ts
            return True, score
        return False, score

    def _choose(self, state: dict, place: int, told) -> tuple[bool, float | None]:
        if self.rule == "stride":
            return place % self.every == 0, None
        if self.rule == "interval":
            return True, None
        if "reference" not in state:
            state["reference"] = told
            return True, None
        if self.rule == "regions":
            if not len(told):
                return False, 1.0
            known = state["reference"]
            score = float(self.similarity(np.asarray(told, "float64"), np.asarray(known, "float64")).max(axis=1).min()) if len(known) else 0.0
        else:
            score = self.similarity(told, state["reference"])
        chosen = score < self.threshold
        if chosen or self.rule == "consecutive":
            state["reference"] = told
        return chosen, score


def described(frames: DataFrame, rules: list[FrameRule]) -> Column:
    """What the rules compare, of one frame, as JSON."""
    told = [r.describe().alias(f"d{i}") for i, r in enumerate(rules) if r.describe is not None]
    return F.to_json(F.struct(*told)) if told else F.lit("{}")


def walk(rules: list[FrameRule], states: list[dict], place: int, idx: int, ts: float, told: str) -> list[tuple]:
    """The records of one frame of a chunk, one for each sampler that keeps it."""
    seen, out = {} if told == "{}" else json.loads(told), []
    for i, (rule, state) in enumerate(zip(rules, states)):
        kept, score = rule.offer(state, ts, place, seen.get(f"d{i}"))
        if kept:
            out.append((rule.sampler_id, idx, ts, place, score))
    return out


def named_apart(rules: list[FrameRule]) -> None:
    names = [r.sampler_id for r in rules]
    if not names or len(set(names)) < len(names):
        raise ValueError("name samplers, each by its own id")


def sampled(frames: DataFrame, rules: list[FrameRule], by: tuple = ("video_id", "chunk_id"), order: str = "idx") -> DataFrame:
    """(by, sampler_id, idx, media_ts, chunk_local_index, score) of frames (by, idx, media_ts, what the rules describe): every
    group is walked in order of (order, idx) by all samplers at once. A group is a chunk, whose length the grid bounds."""
    named_apart(rules)
    names = list(by)

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["_order", "idx"], kind="stable")
        states, out = [{} for _ in rules], []
        for place, (idx, ts, told) in enumerate(zip(pdf["idx"].tolist(), pdf["media_ts"].tolist(), pdf["told"])):
            out += [(*key, *record) for record in walk(rules, states, place, idx, ts, told)]
        return pd.DataFrame(out, columns=[*names, "sampler_id", "idx", "media_ts", "chunk_local_index", "score"]).astype({"score": "float64"})

    kinds = dict(frames.dtypes)
    told = frames.select(*names, F.col(order).alias("_order"), "idx", "media_ts", described(frames, rules).alias("told"))
    return told.groupBy(*names).applyInPandas(run, ", ".join(f"{n} {kinds[n]}" for n in names) + f", {RECORD}")
