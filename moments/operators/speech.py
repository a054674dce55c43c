"""Speech on the grid: cuts from silences and speakers, words to speakers, turns and chunk texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from moments.operators.grid import point_join


def midpoint():
    return (F.col("start") + F.col("end")) / 2


def silence_cuts(spans: DataFrame, silence_s: float = 0.65) -> DataFrame:
    """The middle of every gap of at least silence_s between consecutive spans; the gap is the score."""
    nxt = F.lead("start").over(W.partitionBy("video_id").orderBy("start", "end"))
    gap = F.col("next") - F.col("end")
    return (
        spans.select("video_id", "start", "end", nxt.alias("next"))
        .filter(gap >= silence_s)
        .select("video_id", ((F.col("end") + F.col("next")) / 2).alias("at"), gap.alias("value"))
    )


def speech_spans(turns: DataFrame, segments: DataFrame) -> DataFrame:
    """The turns of videos that have any, else their segments."""
    without = segments.join(turns.select("video_id").distinct(), "video_id", "left_anti")
    return turns.select("video_id", "start", "end").unionByName(without.select("video_id", "start", "end"))


def speaker_cuts(turns: DataFrame) -> DataFrame:
    """Where the speaker differs from the turn before (two unknown ones are the same)."""
    order = W.partitionBy("video_id").orderBy("start", "seq")
    before = turns.select(
        "video_id", "speaker", "start", F.lag("speaker").over(order).alias("p"), F.lag("end").over(order).alias("p_end"),
        F.row_number().over(order).alias("rn"),
    )
    gap = F.col("start") - F.col("p_end")
    return before.filter((F.col("rn") > 1) & ~F.col("speaker").eqNullSafe(F.col("p"))).select(
        "video_id", F.when(gap > 0, (F.col("p_end") + F.col("start")) / 2).otherwise(F.col("start")).alias("at"),
        F.greatest(gap, F.lit(0.0)).alias("value"),
    )


def word_speakers(words: DataFrame, turns: DataFrame, width: float = 30.0) -> DataFrame:
    """Each word with the speaker of the first turn that holds its midpoint, else null. Words and turns meet by time bin."""
    bins = F.explode(F.sequence(F.floor(F.col("start") / width), F.floor(F.col("end") / width)))
    held = turns.select(
        F.col("video_id").alias("t_video"), F.col("seq").alias("t_seq"), F.col("speaker").alias("t_speaker"),
        F.col("start").alias("t_start"), F.col("end").alias("t_end"), bins.alias("t_bin"),
    )
    w = words.withColumn("mid", midpoint())
    on = (
        (F.col("video_id") == F.col("t_video")) & (F.floor(F.col("mid") / width) == F.col("t_bin"))
        & (F.col("mid") >= F.col("t_start")) & (F.col("mid") < F.col("t_end"))
    )
    keys = [F.col(c) for c in words.columns]
    return w.join(held, on, "left").groupBy(*keys).agg(F.min_by("t_speaker", "t_seq").alias("found_speaker"))


def segment_speakers(words: DataFrame, segment: str) -> DataFrame:
    """The speaker who holds most word-seconds of a segment; of equals the one heard first."""
    held = (
        words.filter("found_speaker is not null")
        .groupBy("video_id", segment, "found_speaker")
        .agg(F.sum(F.round((F.col("end") - F.col("start")) * 1000).cast("long")).alias("ms"), F.min("n").alias("first"))
    )
    best = held.groupBy("video_id", segment).agg(F.max_by("found_speaker", F.struct("ms", -F.col("first"))).alias("speaker"))
    return words.select("video_id", segment).distinct().join(best, ["video_id", segment], "left")


def speaker_turns(words: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """Runs of one speaker (unknown counts as one), texts joined without a separator, then trimmed."""
    w = W.partitionBy(*by).orderBy(*order)
    first = F.row_number().over(w) == 1
    change = F.when(first | ~F.col("speaker").eqNullSafe(F.lag("speaker").over(w)), 1).otherwise(0)
    runs = words.withColumn("change", change).withColumn("run", F.sum("change").over(w.rowsBetween(W.unboundedPreceding, 0)))
    piece = F.struct(*order, "word", "end")
    return (
        runs.groupBy(*by, "run")
        .agg(F.first("speaker").alias("speaker"), F.min("start").alias("start"), F.array_sort(F.collect_list(piece)).alias("p"))
        .select(
            *by, "run", "speaker", "start", F.element_at("p", -1)["end"].alias("end"),
            F.trim(F.array_join(F.transform("p", lambda x: x["word"]), "")).alias("text"),
        )
    )


def placed_words(words: DataFrame, chunks: DataFrame, width: float, how: str = "inner") -> DataFrame:
    return point_join(words.withColumn("mid", midpoint()), chunks, "mid", width, how)


def chunk_texts(words: DataFrame, chunks: DataFrame, width: float) -> DataFrame:
    """One row a chunk, silent ones too: text, word count, sorted distinct speakers."""
    piece = F.struct("seq", "n", "word")
    cut = (
        placed_words(words, chunks, width)
        .groupBy("video_id", "chunk_id")
        .agg(
            F.array_sort(F.collect_list(piece)).alias("p"), F.count(F.lit(1)).alias("word_count"),
            F.array_sort(F.collect_set("speaker")).alias("speakers"),
        )
    )
    out = chunks.select("video_id", "chunk_id").join(cut, ["video_id", "chunk_id"], "left")
    return out.select(
        "video_id", "chunk_id",
        F.coalesce(F.trim(F.array_join(F.transform("p", lambda x: x["word"]), " ")), F.lit("")).alias("text"),
        F.coalesce("word_count", F.lit(0)).alias("word_count"),
        F.coalesce("speakers", F.array().cast("array<string>")).alias("speakers"),
    )


def placement_stats(words: DataFrame, chunks: DataFrame, width: float) -> DataFrame:
    found = placed_words(words, chunks, width, "left")
    return found.groupBy("video_id").agg(
        F.count(F.lit(1)).alias("words_in_transcript"), F.count("chunk_id").alias("words"),
        F.count_if(F.col("chunk_id").isNull()).alias("words_outside_grid"), F.countDistinct("chunk_id").alias("chunks_with_speech"),
    )


def signal_level(samples: DataFrame, floor: float = 1e-3) -> DataFrame:
    rms = F.sqrt(F.avg(F.col("sample") * F.col("sample")))
    return samples.groupBy("video_id").agg(rms.alias("rms"), F.max(F.abs("sample")).alias("peak")).withColumn("silent", F.col("rms") < floor)
