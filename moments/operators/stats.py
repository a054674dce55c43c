"""Aggregates of a video over its grid."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from moments.operators.folder import saved


def upper_median(values: Column) -> Column:
    """sorted[n // 2]; null for none."""
    return F.get(F.array_sort(values), F.floor(F.size(values) / 2).cast("int"))


def video_stats(chunks: DataFrame, texts: DataFrame, frames: DataFrame) -> DataFrame:
    """Duration, chunk lengths, frames, words and speaking rate by video. texts: (video_id, chunk_id, word_count)."""
    length = F.col("end_ts") - F.col("start_ts")
    grid = chunks.groupBy("video_id").agg(
        F.max("end_ts").alias("duration_s"), F.count(F.lit(1)).alias("chunks"), F.min(length).alias("min_s"),
        F.collect_list(length).alias("lengths"), F.max(length).alias("max_s"),
    )
    said = texts.groupBy("video_id").agg(F.sum("word_count").alias("words"), F.count_if(F.col("word_count") > 0).alias("chunks_with_speech"))
    seen = frames.groupBy("video_id").agg(F.count(F.lit(1)).alias("frames_sampled"))
    out = grid.join(said, "video_id", "left").join(seen, "video_id", "left").fillna(0, ["words", "chunks_with_speech", "frames_sampled"])
    rate = F.when(F.col("duration_s") > 0, F.col("words") / (F.col("duration_s") / 60)).otherwise(0.0)
    return out.withColumn("median_s", upper_median(F.col("lengths"))).withColumn("words_per_minute", rate).drop("lengths")


def speaker_stats(turns: DataFrame, media: DataFrame, order: list[str]) -> DataFrame:
    """By video and speaker: seconds and share, with the video's turns, handovers, monologue flag and dominant speaker."""
    known = turns.filter("speaker is not null")
    w = W.partitionBy("video_id").orderBy(*order)
    changed = known.withColumn("handover", (F.lag("speaker").over(w) != F.col("speaker")).cast("int"))
    ms = F.sum(F.round((F.col("end") - F.col("start")) * 1000).cast("long"))
    per = changed.groupBy("video_id", "speaker").agg(
        ms.alias("ms"), F.count(F.lit(1)).alias("n"), F.sum(F.coalesce("handover", F.lit(0))).alias("h"), F.min(F.struct(*order)).alias("first")
    )
    video = W.partitionBy("video_id")
    total = F.sum("ms").over(video)
    rank = F.row_number().over(video.orderBy(F.desc("ms"), "first"))
    return per.join(media, "video_id").select(
        "video_id", "speaker", (F.col("ms") / 1000.0).alias("seconds"),
        F.when(total > 0, F.col("ms") / total).otherwise(0.0).alias("share"), F.sum("n").over(video).alias("turns"),
        F.sum("h").over(video).alias("handovers"), (total / 1000.0 / F.col("duration_s")).alias("speech_ratio"),
        ((F.count(F.lit(1)).over(video) == 1) & (F.sum("h").over(video) == 0)).alias("monologue"), (rank == 1).alias("dominant"),
    )


def coverage(chunks: DataFrame, accounts: DataFrame, sound: str = "transcript") -> DataFrame:
    """Each chunk with its sources and what they cover. accounts: (video_id, chunk_id, source)."""
    found = accounts.groupBy("video_id", "chunk_id").agg(F.array_sort(F.collect_set("source")).alias("sources"))
    out = chunks.join(found, ["video_id", "chunk_id"], "left").withColumn("sources", F.coalesce("sources", F.array().cast("array<string>")))
    has_sound = F.array_contains("sources", sound)
    has_picture = F.size(F.array_remove("sources", sound)) > 0
    kind = F.when(has_picture & has_sound, "both").when(has_picture, "picture_only").when(has_sound, "sound_only").otherwise("neither")
    return out.withColumn("kind", kind).select("video_id", "chunk_id", "sources", "kind")


def coverage_counts(covered: DataFrame) -> DataFrame:
    kinds = ["both", "picture_only", "sound_only", "neither"]
    silent = F.array_sort(F.collect_list(F.when(F.col("kind") == "neither", F.col("chunk_id"))))
    return covered.groupBy("video_id").agg(*[F.count_if(F.col("kind") == k).alias(k) for k in kinds], silent.alias("silent_chunks"))


def entity_rollup(spans: DataFrame) -> DataFrame:
    """Detected (video_id, chunk_id, text, label): distinct chunks of each name. ``mentions`` counts chunks."""
    named = spans.withColumn("text", F.trim("text")).filter("text <> ''")
    out = named.groupBy("video_id", "text", "label").agg(
        F.array_sort(F.collect_set("chunk_id")).alias("chunk_ids"), F.count(F.lit(1)).alias("occurrences")
    )
    out = out.withColumn("mentions", F.size("chunk_ids").cast("long"))
    order = W.partitionBy("video_id").orderBy(F.desc("mentions"), F.lower("text"), "text", "label")
    return out.withColumn("place", F.row_number().over(order))


def label_counts(entities: DataFrame) -> DataFrame:
    return entities.groupBy("video_id", "label").agg(F.count(F.lit(1)).alias("entities"))


def sentiment(pieces: DataFrame) -> DataFrame:
    """Scored pieces (video_id, chunk_id, weight, signed) to one row a chunk, with turning points."""
    chunk = pieces.groupBy("video_id", "chunk_id").agg(
        (F.sum(F.col("weight") * F.col("signed")) / F.sum("weight")).alias("raw"), F.count(F.lit(1)).alias("pieces")
    )
    before = F.lag("signed").over(W.partitionBy("video_id").orderBy("chunk_id"))
    out = chunk.withColumn("signed", F.round("raw", 4)).withColumn("label", F.when(F.col("raw") >= 0, "positive").otherwise("negative"))
    turn = before.isNotNull() & ((before < 0) != (F.col("signed") < 0))
    return out.withColumn("turning_point", turn).select("video_id", "chunk_id", "label", "signed", "pieces", "turning_point")


def sentiment_totals(scored: DataFrame) -> DataFrame:
    return scored.groupBy("video_id").agg(
        F.round(F.avg("signed"), 4).alias("mean"), F.count_if(F.col("signed") > 0).alias("positive_chunks"),
        F.count_if(F.col("signed") < 0).alias("negative_chunks"),
        F.array_sort(F.collect_list(F.when(F.col("turning_point"), F.col("chunk_id")))).alias("turning_points"),
    )


def batched(rows: DataFrame, by: list[str], order: list[str], size: int) -> DataFrame:
    """Numbers the fixed-size batches of each group in order."""
    n = F.row_number().over(W.partitionBy(*by).orderBy(*order))
    return rows.withColumn("batch", F.floor((n - 1) / size).cast("long"))


def fold(rows: DataFrame, reduce, size: int = 25, most: int = 1) -> DataFrame:
    """rows (video_id, pos, text, chunk_ids) in layers: batches of ``size`` become one row each by ``reduce`` (a Column function
    of the ordered array of texts), until no video has more than ``most``. Every layer is kept, and written before the next reads
    it. The number of layers is the logarithm of the longest video, so the loop asks for one count a layer."""
    if size < 2 or most < 1:
        raise ValueError("size must be 2 or more and most 1 or more, or the layers never end")
    layer = rows.select("video_id", F.lit(0).alias("layer"), "pos", "text", "chunk_ids")
    layer, depth = saved(layer), 0
    out = layer
    while (layer.groupBy("video_id").count().agg(F.max("count")).first()[0] or 0) > most:
        depth += 1
        cut = batched(layer, ["video_id"], ["pos"], size)
        item = F.array_sort(F.collect_list(F.struct("pos", "text")))
        layer = cut.groupBy("video_id", "batch").agg(
            item.alias("items"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("chunk_ids")))).alias("chunk_ids")
        ).select(
            "video_id", F.lit(depth).alias("layer"), F.col("batch").alias("pos"),
            reduce(F.transform("items", lambda x: x["text"])).alias("text"), "chunk_ids",
        )
        layer = saved(layer)
        out = out.unionByName(layer)
    return out


def cited_spans(cited: DataFrame, chunks: DataFrame) -> DataFrame:
    """(video_id, item, first, last) to the valid chunk ids between them, with their times."""
    ids = cited.select("video_id", "item", F.explode(F.sequence("first", "last")).alias("chunk_id"))
    met = ids.join(chunks, ["video_id", "chunk_id"])
    return met.groupBy("video_id", "item").agg(
        F.array_sort(F.collect_set("chunk_id")).alias("chunk_ids"), F.min("start_ts").alias("start_ts"), F.max("end_ts").alias("end_ts")
    )


def uncovered(cited: DataFrame, chunks: DataFrame) -> DataFrame:
    """By video, the chunks that no cited span covers."""
    ids = cited.select("video_id", F.explode(F.sequence("first", "last")).alias("chunk_id")).distinct()
    left = chunks.select("video_id", "chunk_id").join(ids, ["video_id", "chunk_id"], "left_anti")
    holes = left.groupBy("video_id").agg(F.array_sort(F.collect_list("chunk_id")).alias("uncovered"))
    out = chunks.select("video_id").distinct().join(holes, "video_id", "left")
    return out.select(
        "video_id", F.coalesce("uncovered", F.array().cast("array<bigint>")).alias("uncovered"), F.col("uncovered").isNull().alias("covers_all_chunks")
    )


KINDS = ("fold", "spans", "items")


def apply_definition(definition: dict, rows: DataFrame, chunks: DataFrame) -> DataFrame:
    """A custom aggregate as data: {"kind", "fields", "reduce"}.

    fold: rows (video_id, pos, text, chunk_ids) folded by ``reduce``, a Column function. spans: rows (video_id, item, first_chunk,
    last_chunk) and fields to the valid chunks between them with their times. items: rows (video_id, item, chunk_id) and fields,
    each resolved to its chunk's time and numbered in time order; items of chunks that the grid lacks are dropped."""
    kind, fields = definition.get("kind"), list(definition.get("fields", ()))
    if kind not in KINDS:
        raise ValueError(f"kind must be one of {', '.join(KINDS)}")
    if kind == "fold":
        return fold(rows, definition["reduce"], definition.get("size", 25))
    own = {"spans": {"first_chunk", "last_chunk"}, "items": {"chunk_id"}}[kind] & set(fields)
    if own:
        raise ValueError(f"fields that the kind itself writes: {', '.join(sorted(own))}")
    if kind == "spans":
        cited = rows.select("video_id", "item", F.col("first_chunk").alias("first"), F.col("last_chunk").alias("last"))
        return cited_spans(cited, chunks).join(rows.select("video_id", "item", *fields), ["video_id", "item"])
    place = F.row_number().over(W.partitionBy("video_id").orderBy("start_ts", "item"))
    met = rows.select("video_id", "item", "chunk_id", *fields).join(chunks, ["video_id", "chunk_id"])
    return met.select("video_id", "item", "chunk_id", *fields, "start_ts", "end_ts", place.alias("place"))


def dwell(sightings: DataFrame) -> DataFrame:
    """First and last seen, span and observed seconds of each entity. sightings: (video_id, entity, start_ts, end_ts)."""
    return sightings.groupBy("video_id", "entity").agg(
        F.min("start_ts").alias("first_seen"), F.max("end_ts").alias("last_seen"),
        (F.max("end_ts") - F.min("start_ts")).alias("span_s"), F.sum(F.col("end_ts") - F.col("start_ts")).alias("observed_s"),
    )


def longest_present(dwelled: DataFrame) -> DataFrame:
    return dwelled.groupBy("video_id").agg(F.max_by("entity", F.struct("observed_s", "entity")).alias("longest"))


def by_chunks(objects: DataFrame, top: int = 20) -> DataFrame:
    """Objects by the number of chunks they are in; the top of each video."""
    n = objects.groupBy("video_id", "object").agg(F.countDistinct("chunk_id").alias("chunks"))
    place = F.row_number().over(W.partitionBy("video_id").orderBy(F.desc("chunks"), "object"))
    return n.withColumn("place", place).filter(F.col("place") <= top)


def co_presence(present: DataFrame, top: int = 50) -> DataFrame:
    """Pairs of entities (a < b) on shared chunks, the most frequent of each video. Pairs arise inside a chunk only."""
    one = present.select("video_id", "chunk_id", "entity").distinct()
    a, b = one.withColumnRenamed("entity", "a"), one.withColumnRenamed("entity", "b")
    pairs = a.join(b, ["video_id", "chunk_id"]).filter("a < b").groupBy("video_id", "a", "b").agg(F.count(F.lit(1)).alias("count"))
    place = F.row_number().over(W.partitionBy("video_id").orderBy(F.desc("count"), "a", "b"))
    return pairs.withColumn("place", place).filter(F.col("place") <= top)


def per_chunk(people: DataFrame) -> DataFrame:
    """(video_id, chunk_id, people): how many different people each chunk shows."""
    return people.select("video_id", "chunk_id", "entity").distinct().groupBy("video_id", "chunk_id").agg(F.count(F.lit(1)).alias("people"))


def described(answers: DataFrame, chunks: DataFrame) -> DataFrame:
    """(video_id, sampler_id, chunks, share): in how many chunks of the grid each sampler has an answer."""
    all_ = chunks.groupBy("video_id").agg(F.count(F.lit(1)).alias("all"))
    met = answers.select("video_id", "sampler_id", "chunk_id").distinct().join(chunks.select("video_id", "chunk_id"), ["video_id", "chunk_id"], "left_semi")
    n = met.groupBy("video_id", "sampler_id").agg(F.count(F.lit(1)).alias("chunks"))
    return n.join(all_, "video_id").select("video_id", "sampler_id", "chunks", F.round(F.col("chunks") / F.col("all"), 4).alias("share"))
