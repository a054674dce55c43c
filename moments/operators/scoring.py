"""A user's batch scorer over texts: embedders, taggers and classifiers plug in here."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame


def score_texts(rows: DataFrame, key: str, text: str, scorer: Callable[[list], list], kind: str = "long", batch: int = 64) -> DataFrame:
    """(key, score): the scorer gets lists of at most ``batch`` texts and returns as many results."""

    def scan(frames):
        for pdf in frames:
            out = []
            for at in range(0, len(pdf), batch):
                out += list(scorer(pdf[text].iloc[at : at + batch].fillna("").tolist()))
            yield pd.DataFrame({key: pdf[key], "score": out})

    return rows.select(key, text).mapInPandas(scan, f"{key} {dict(rows.dtypes)[key]}, score {kind}")
