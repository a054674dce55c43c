"""Queries for the aggregates of a video."""

from __future__ import annotations

from pyspark.sql import functions as F

from moments.operators import grid as g
from moments.operators import stats as st
from moments.plans.grid import PLACED, _grid
from moments.plans.registry import query
from moments.plans.speech import TALK, WIDTH, talk_chunks
from moments.plans.views import DAY, GRID, frames, sql, table, turns, words


@query(sql(""" SELECT video_id, duration_s, chunks, min_s, ls[len(ls) // 2 + 1] AS median_s, max_s, coalesce(f, 0) AS frames_sampled,
  coalesce(w, 0) AS words, coalesce(cs, 0) AS chunks_with_speech, coalesce(w, 0) / (duration_s / 60) AS words_per_minute FROM
  (SELECT video_id, max(end_ts) AS duration_s, count(*) AS chunks, min(end_ts - start_ts) AS min_s, max(end_ts - start_ts) AS max_s,
    list_sort(list(end_ts - start_ts)) AS ls FROM tchunks GROUP BY 1)
  LEFT JOIN (SELECT video_id, count(chunk_id) AS w, count(DISTINCT chunk_id) AS cs FROM tplaced GROUP BY 1) USING (video_id)
  LEFT JOIN (SELECT video_id, count(*) AS f FROM frames GROUP BY 1) USING (video_id)""", TALK))
def a1_video_stats(spark, sf):
    from moments.operators.speech import chunk_texts

    chunks = talk_chunks(spark, sf)
    return st.video_stats(chunks, chunk_texts(words(spark, sf), chunks, WIDTH), frames(spark, sf))


@query(sql(""" SELECT video_id, speaker, ms / 1000.0::DOUBLE AS seconds, ms / sum(ms) OVER v AS share, (sum(n) OVER v)::BIGINT AS turns, (sum(h) OVER v)::BIGINT AS handovers,
  sum(ms) OVER v / 1000.0::DOUBLE / d AS speech_ratio, count(*) OVER v = 1 AND sum(h) OVER v = 0 AS monologue,
  row_number() OVER (PARTITION BY video_id ORDER BY ms DESC, f) = 1 AS dominant FROM
  (SELECT video_id, speaker, sum(round(("end" - start) * 1000)::BIGINT) AS ms, count(*) AS n, coalesce(sum((p <> speaker)::INT), 0) AS h, min(seq) AS f
   FROM (SELECT *, lag(speaker) OVER (PARTITION BY video_id ORDER BY seq) AS p FROM turns WHERE speaker IS NOT NULL) GROUP BY ALL)
  JOIN (SELECT video_id, max("end") AS d FROM turns GROUP BY 1) USING (video_id) WINDOW v AS (PARTITION BY video_id)"""))
def a2_speaker_stats(spark, sf):
    t = turns(spark, sf)
    return st.speaker_stats(t, t.groupBy("video_id").agg(F.max("end").alias("duration_s")), ["seq"])


ACCOUNTS = """acc AS (SELECT DISTINCT video_id, chunk_id, CASE WHEN sampler_id = 'click' THEN 'transcript' ELSE sampler_id END AS source FROM placed WHERE score > 30),
cov AS (SELECT c.video_id, c.chunk_id, coalesce(list_sort(list(source) FILTER (source IS NOT NULL)), []) AS sources FROM chunks c
  LEFT JOIN acc USING (video_id, chunk_id) GROUP BY ALL),
kinds AS (SELECT *, CASE WHEN list_contains(sources, 'transcript') AND len(sources) > 1 THEN 'both' WHEN list_contains(sources, 'transcript')
  THEN 'sound_only' WHEN len(sources) > 0 THEN 'picture_only' ELSE 'neither' END AS kind FROM cov)"""


def _accounts(spark, sf):
    found = g.point_join(frames(spark, sf).filter("score > 30"), _grid(spark, sf), "media_ts", DAY)
    source = F.when(F.col("sampler_id") == "click", F.lit("transcript")).otherwise(F.col("sampler_id"))
    return found.select("video_id", "chunk_id", source.alias("source"))


@query(sql(" SELECT video_id, chunk_id, sources, kind FROM kinds", GRID, PLACED, ACCOUNTS))
def a3_coverage(spark, sf):
    return st.coverage(_grid(spark, sf), _accounts(spark, sf))


@query(sql(""" SELECT video_id, count(*) FILTER (kind = 'both') AS "both", count(*) FILTER (kind = 'picture_only') AS picture_only,
  count(*) FILTER (kind = 'sound_only') AS sound_only, count(*) FILTER (kind = 'neither') AS neither,
  coalesce(list_sort(list(chunk_id) FILTER (kind = 'neither')), []) AS silent_chunks FROM kinds GROUP BY video_id""", GRID, PLACED, ACCOUNTS))
def a3_coverage_counts(spark, sf):
    return st.coverage_counts(st.coverage(_grid(spark, sf), _accounts(spark, sf)))


NAMED = """named AS (SELECT source AS video_id, doc_id AS chunk_id, unnest(regexp_extract_all(text, '[A-Z][a-z]+')) AS text, lang AS label FROM documents
  ), ents AS (SELECT video_id, text, label, list_sort(list(DISTINCT chunk_id)) AS chunk_ids, count(*) AS occurrences,
  count(DISTINCT chunk_id) AS mentions FROM named GROUP BY ALL)"""


def _named(spark, sf):
    """Capitalised ASCII words stand for detected names."""
    d = table(spark, sf, "documents")
    found = F.explode(F.regexp_extract_all("text", F.lit("[A-Z][a-z]+"), F.lit(0)))
    return d.select(F.col("source").alias("video_id"), F.col("doc_id").alias("chunk_id"), found.alias("text"), F.col("lang").alias("label"))


@query(sql(""" SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY mentions DESC, lower(text), text, label) AS place FROM ents""", NAMED))
def a4_entity_rollup(spark, sf):
    return st.entity_rollup(_named(spark, sf))


@query(sql(" SELECT video_id, label, count(*) AS entities FROM ents GROUP BY ALL", NAMED))
def a4_label_counts(spark, sf):
    return st.label_counts(st.entity_rollup(_named(spark, sf)))


SIGNED = """sgn AS (SELECT source AS video_id, doc_id // 3 AS chunk_id, n_chars AS w, (quality * 2 - 1) * (1 - toxic * 0.5) AS s
  FROM documents JOIN labels USING (doc_id)),
sc AS (SELECT video_id, chunk_id, sum(w * s) / sum(w) AS raw, count(*) AS pieces FROM sgn GROUP BY ALL),
sent AS (SELECT video_id, chunk_id, CASE WHEN raw >= 0 THEN 'positive' ELSE 'negative' END AS label, round(raw, 4) AS signed, pieces,
  coalesce((lag(round(raw, 4)) OVER w < 0) <> (round(raw, 4) < 0), false) AS turning_point FROM sc WINDOW w AS (PARTITION BY video_id ORDER BY chunk_id))"""


def _signed(spark, sf):
    both = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id")
    return both.select(
        F.col("source").alias("video_id"), F.floor(F.col("doc_id") / 3).cast("long").alias("chunk_id"), F.col("n_chars").alias("weight"),
        ((F.col("quality") * 2 - 1) * (1 - F.col("toxic") * 0.5)).alias("signed"),
    )


@query(sql(" SELECT * FROM sent", SIGNED))
def a5_sentiment(spark, sf):
    return st.sentiment(_signed(spark, sf))


@query(sql(""" SELECT video_id, round(avg(signed), 4) AS mean, count(*) FILTER (signed > 0) AS positive_chunks, count(*) FILTER (signed < 0) AS negative_chunks,
  coalesce(list_sort(list(chunk_id) FILTER (turning_point)), []) AS turning_points FROM sent GROUP BY video_id""", SIGNED))
def a5_sentiment_totals(spark, sf):
    return st.sentiment_totals(st.sentiment(_signed(spark, sf)))


@query(sql(" SELECT video_id, chunk_id, turning_point FROM sent WHERE turning_point", SIGNED))
def w14_turning_points(spark, sf):
    return st.sentiment(_signed(spark, sf)).filter("turning_point").select("video_id", "chunk_id", "turning_point")


@query(sql(""" , l0 AS (SELECT source AS video_id, 0 AS layer, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS pos, substr(md5(coalesce(text, '')), 1, 6) AS text,
    [doc_id] AS chunk_ids FROM documents),
  l1 AS (SELECT video_id, 1 AS layer, pos // 25 AS pos, string_agg(text, '+' ORDER BY pos) AS text, list_sort(list_distinct(flatten(list(chunk_ids)))) AS chunk_ids
    FROM l0 GROUP BY video_id, pos // 25),
  l2 AS (SELECT video_id, 2 AS layer, pos // 25 AS pos, string_agg(text, '+' ORDER BY pos) AS text, list_sort(list_distinct(flatten(list(chunk_ids)))) AS chunk_ids
    FROM l1 WHERE (SELECT max(n) FROM (SELECT count(*) AS n FROM l1 GROUP BY video_id)) > 1 GROUP BY video_id, pos // 25)
  SELECT * FROM l0 UNION ALL SELECT * FROM l1 UNION ALL SELECT * FROM l2""".replace(" , l0", ", l0", 1)))
def a6_fold(spark, sf):
    from pyspark.sql import Window as W

    d = table(spark, sf, "documents")
    pos = F.row_number().over(W.partitionBy("source").orderBy("doc_id")) - 1
    rows = d.select(
        F.col("source").alias("video_id"), pos.cast("long").alias("pos"), F.substring(F.md5(F.coalesce("text", F.lit(""))), 1, 6).alias("text"),
        F.array("doc_id").alias("chunk_ids"),
    )
    return st.fold(rows, lambda texts: F.array_join(texts, "+"))


CITED = """cited AS (SELECT video_id, idx AS item, idx % 37 AS "first", idx % 37 + idx % 4 AS "last" FROM frames)"""


def _cited(spark, sf):
    return frames(spark, sf).select(
        "video_id", F.col("idx").alias("item"), (F.col("idx") % 37).alias("first"), (F.col("idx") % 37 + F.col("idx") % 4).alias("last")
    )


@query(sql(""" SELECT video_id, item, list_sort(list(DISTINCT chunk_id)) AS chunk_ids, min(start_ts) AS start_ts, max(end_ts) AS end_ts FROM cited
  JOIN chunks USING (video_id) WHERE chunk_id BETWEEN "first" AND "last" GROUP BY video_id, item""", GRID, CITED))
def a7_cited_spans(spark, sf):
    return st.cited_spans(_cited(spark, sf), _grid(spark, sf))


@query(sql(""" SELECT video_id, coalesce(list_sort(list(chunk_id) FILTER (NOT hit)), []) AS uncovered, bool_and(hit) AS covers_all_chunks FROM
  (SELECT c.video_id, c.chunk_id, EXISTS (SELECT 1 FROM cited x WHERE x.video_id = c.video_id AND c.chunk_id BETWEEN x."first" AND x."last") AS hit FROM chunks c)
  GROUP BY video_id""", GRID, CITED))
def u4_uncovered(spark, sf):
    return st.uncovered(_cited(spark, sf), _grid(spark, sf))


@query(sql(""" SELECT video_id, idx AS item, start_ts, end_ts, row_number() OVER (PARTITION BY video_id ORDER BY start_ts, idx) AS place FROM frames
  JOIN chunks ON chunks.video_id = frames.video_id AND chunk_id = idx % 40""".replace("SELECT video_id", "SELECT frames.video_id", 1).replace("PARTITION BY video_id", "PARTITION BY frames.video_id"), GRID))
def a8_items(spark, sf):
    """Items that cite one chunk, resolved to its time and put in time order; a chunk the grid lacks drops the item."""
    from pyspark.sql import Window as W

    items = frames(spark, sf).select("video_id", F.col("idx").alias("item"), (F.col("idx") % 40).alias("chunk_id"))
    place = F.row_number().over(W.partitionBy("video_id").orderBy("start_ts", "item"))
    met = items.join(_grid(spark, sf), ["video_id", "chunk_id"])
    return met.select("video_id", "item", "start_ts", "end_ts", place.alias("place"))


SEEN = """seen AS (SELECT video_id, sampler_id || (idx % 3) AS entity, chunk_id FROM placed),
sight AS (SELECT DISTINCT s.video_id, entity, s.chunk_id, start_ts, end_ts FROM seen s JOIN chunks c ON c.video_id = s.video_id AND c.chunk_id = s.chunk_id),
dw AS (SELECT video_id, entity, min(start_ts) AS first_seen, max(end_ts) AS last_seen, max(end_ts) - min(start_ts) AS span_s,
  sum(end_ts - start_ts) AS observed_s FROM sight GROUP BY ALL)"""


def _seen(spark, sf):
    found = g.point_join(frames(spark, sf), _grid(spark, sf), "media_ts", DAY)
    entity = F.concat("sampler_id", (F.col("idx") % 3).cast("string"))
    return found.select("video_id", entity.alias("entity"), "chunk_id", "start_ts", "end_ts").distinct()


@query(sql(" SELECT video_id, entity, first_seen, last_seen, span_s, round(observed_s, 3) AS observed_s FROM dw", GRID, PLACED, SEEN))
def a17_dwell(spark, sf):
    return st.dwell(_seen(spark, sf)).withColumn("observed_s", F.round("observed_s", 3))


@query(sql(" SELECT video_id, arg_max(entity, (round(observed_s, 3), entity)) AS longest FROM dw GROUP BY video_id", GRID, PLACED, SEEN))
def a17_longest_present(spark, sf):
    return st.longest_present(st.dwell(_seen(spark, sf)).withColumn("observed_s", F.round("observed_s", 3)))


@query(sql(""" SELECT * FROM (SELECT video_id, entity AS object, count(DISTINCT chunk_id) AS chunks,
  row_number() OVER (PARTITION BY video_id ORDER BY count(DISTINCT chunk_id) DESC, entity) AS place FROM seen GROUP BY video_id, entity) WHERE place <= 20""", GRID, PLACED, SEEN))
def a18_objects_by_chunks(spark, sf):
    return st.by_chunks(_seen(spark, sf).withColumnRenamed("entity", "object"))


@query(sql(""" SELECT * FROM (SELECT x.video_id, x.entity AS a, y.entity AS b, count(*) AS count,
  row_number() OVER (PARTITION BY x.video_id ORDER BY count(*) DESC, x.entity, y.entity) AS place FROM sight x JOIN sight y
  ON x.video_id = y.video_id AND x.chunk_id = y.chunk_id AND x.entity < y.entity GROUP BY x.video_id, x.entity, y.entity) WHERE place <= 50""", GRID, PLACED, SEEN))
def j10_co_presence(spark, sf):
    return st.co_presence(_seen(spark, sf))


@query(sql(""" SELECT video_id, idx, (row_number() OVER (PARTITION BY video_id ORDER BY media_ts, idx) - 1) // 25 AS batch FROM frames"""))
def w15_batches(spark, sf):
    return st.batched(frames(spark, sf), ["video_id"], ["media_ts", "idx"], 25).select("video_id", "idx", "batch")


@query(sql(""" SELECT video_id, idx, row_number() OVER (PARTITION BY video_id, sampler_id ORDER BY media_ts, idx) AS number FROM frames"""))
def w13_observation_numbers(spark, sf):
    from pyspark.sql import Window as W

    order = W.partitionBy("video_id", "sampler_id").orderBy("media_ts", "idx")
    return frames(spark, sf).select("video_id", "idx", F.row_number().over(order).alias("number"))


@query("""WITH l0 AS (SELECT CAST(conv_id AS VARCHAR) AS video_id, turn AS pos, CAST(length(text) AS VARCHAR) AS text FROM conversations)
  SELECT video_id, 0 AS layer, pos, text FROM l0 UNION ALL SELECT video_id, 1, pos // 25, CAST(max(text::BIGINT) AS VARCHAR) FROM l0 WHERE video_id IN (SELECT video_id FROM l0 GROUP BY 1 HAVING true) GROUP BY video_id, pos // 25""")
def p1_custom_fold(spark, sf):
    """A fold as data: the reducer is a Column function, here the longest turn."""
    c = table(spark, sf, "conversations")
    rows = c.select(F.col("conv_id").cast("string").alias("video_id"), F.col("turn").alias("pos"), F.length("text").cast("string").alias("text"), F.array("turn").alias("chunk_ids"))
    longest = {"kind": "fold", "reduce": lambda t: F.array_max(F.transform(t, lambda x: x.cast("long"))).cast("string")}
    return st.apply_definition(longest, rows, None).select("video_id", "layer", "pos", "text")


@query(sql(""" SELECT video_id, item, list_sort(list(DISTINCT chunk_id)) AS chunk_ids, min(start_ts) AS start_ts, max(end_ts) AS end_ts, 'part ' || item AS title FROM cited
  JOIN chunks USING (video_id) WHERE chunk_id BETWEEN "first" AND "last" GROUP BY video_id, item""", GRID, CITED))
def p1_custom_spans(spark, sf):
    """Spans as data: cited chunks with a field of the answer."""
    rows = _cited(spark, sf).withColumnsRenamed({"first": "first_chunk", "last": "last_chunk"}).withColumn("title", F.concat(F.lit("part "), F.col("item").cast("string")))
    return st.apply_definition({"kind": "spans", "fields": ["title"]}, rows, _grid(spark, sf))


@query(sql(""" SELECT f.video_id, idx AS item, chunk_id, sampler_id AS what, start_ts, end_ts, row_number() OVER (PARTITION BY f.video_id ORDER BY start_ts, idx) AS place FROM frames f
  JOIN chunks c ON c.video_id = f.video_id AND chunk_id = idx % 40""", GRID))
def p1_custom_items(spark, sf):
    """Items as data: each cites one chunk and carries a field."""
    rows = frames(spark, sf).select("video_id", F.col("idx").alias("item"), (F.col("idx") % 40).alias("chunk_id"), F.col("sampler_id").alias("what"))
    return st.apply_definition({"kind": "items", "fields": ["what"]}, rows, _grid(spark, sf))


@query(sql(" SELECT video_id, chunk_id, count(DISTINCT entity) AS people FROM seen GROUP BY ALL", GRID, PLACED, SEEN))
def a18_people_per_chunk(spark, sf):
    return st.per_chunk(_seen(spark, sf))


@query(sql(""" SELECT video_id, sampler_id, n AS chunks, round(n / alln, 4) AS share FROM (SELECT video_id, sampler_id, count(DISTINCT chunk_id) AS n FROM placed GROUP BY ALL)
  JOIN (SELECT video_id, count(*)::DOUBLE AS alln FROM chunks GROUP BY 1) USING (video_id)""", GRID, PLACED))
def a1_described_per_sampler(spark, sf):
    from moments.operators import grid as g

    chunks = _grid(spark, sf)
    return st.described(g.point_join(frames(spark, sf), chunks, "media_ts", DAY), chunks)


@query(sql(""" SELECT video_id, "window", count(*) AS items, min(media_ts) AS first_ts, max(media_ts) AS last_ts FROM (SELECT video_id, media_ts, (row_number() OVER (PARTITION BY video_id ORDER BY media_ts, idx) - 1) // 100 AS "window" FROM frames) GROUP BY ALL"""))
def a8_item_windows(spark, sf):
    """Items are found in windows of a hundred; each window's number, size and span."""
    cut = st.batched(frames(spark, sf), ["video_id"], ["media_ts", "idx"], 100)
    return cut.groupBy("video_id", F.col("batch").alias("window")).agg(F.count(F.lit(1)).alias("items"), F.min("media_ts").alias("first_ts"), F.max("media_ts").alias("last_ts"))
