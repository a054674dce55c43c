"""Queries over speech: videos are conversations, chunks last 20 seconds."""

from __future__ import annotations

from pyspark.sql import functions as F

from moments.operators import grid as g
from moments.operators import speech as s
from moments.plans.registry import query
from moments.plans.views import frames, sql, turns, words

WIDTH = 20.0
TALK = """
talk AS (SELECT video_id, max("end") * 0.9 AS duration_s FROM turns GROUP BY video_id HAVING max("end") > 0),
tg AS (SELECT video_id, duration_s, k, k * 20.0::DOUBLE AS s, least((k + 1) * 20.0::DOUBLE, duration_s) AS e,
  CAST(ceil(duration_s / 20.0::DOUBLE) AS BIGINT) AS n FROM talk, range(2000) r(k) WHERE k < ceil(duration_s / 20.0::DOUBLE)),
tchunks AS (SELECT video_id, k AS chunk_id, s AS start_ts, CASE WHEN k = n - 2 AND duration_s - (n - 1) * 20.0::DOUBLE < 5.0 THEN duration_s
  ELSE e END AS end_ts, row_number() OVER (PARTITION BY video_id ORDER BY k DESC) = 1 AS is_last
  FROM tg WHERE NOT (k = n - 1 AND n > 1 AND e - s < 5.0)),
tplaced AS (SELECT w.*, c.chunk_id FROM words w LEFT JOIN tchunks c ON w.video_id = c.video_id
  AND (w.start + w."end") / 2 >= c.start_ts AND ((w.start + w."end") / 2 < c.end_ts OR (c.is_last AND (w.start + w."end") / 2 = c.end_ts)))"""


def talk_chunks(spark, sf):
    """The grid covers nine tenths of the talk, so that some words lie outside."""
    media = turns(spark, sf).groupBy("video_id").agg((F.max("end") * 0.9).alias("duration_s"))
    return g.uniform(media, WIDTH)


@query(sql(""" SELECT video_id, ("end" + nxt) / 2 AS "at", nxt - "end" AS value FROM
  (SELECT *, lead(start) OVER (PARTITION BY video_id ORDER BY start, "end") AS nxt FROM turns) WHERE nxt - "end" >= 0.65"""))
def w1_silence_cuts(spark, sf):
    return s.silence_cuts(turns(spark, sf))


@query(sql(""" SELECT video_id, CASE WHEN start - pe > 0 THEN (pe + start) / 2 ELSE start END AS "at", greatest(start - pe, 0) AS value FROM
  (SELECT *, lag(speaker) OVER w AS p, lag("end") OVER w AS pe, row_number() OVER w AS rn FROM turns
   WINDOW w AS (PARTITION BY video_id ORDER BY start, seq)) WHERE rn > 1 AND speaker IS DISTINCT FROM p"""))
def w2_speaker_cuts(spark, sf):
    return s.speaker_cuts(turns(spark, sf))


SPOKEN = """spoken AS (SELECT w.video_id, w.seq, w.n, w.word, w.start, w."end", arg_min(coalesce(t.speaker, ''), t.seq) AS fs FROM words w
  LEFT JOIN turns t ON w.video_id = t.video_id AND (w.start + w."end") / 2 >= t.start AND (w.start + w."end") / 2 < t."end" GROUP BY ALL)"""


@query(sql(""" SELECT video_id, seq, n, nullif(fs, '') AS found_speaker FROM spoken""", SPOKEN))
def j4_word_speaker(spark, sf):
    return s.word_speakers(words(spark, sf).drop("speaker"), turns(spark, sf)).select("video_id", "seq", "n", "found_speaker")


@query(sql(""" SELECT video_id, seq, (SELECT fs FROM (SELECT fs, sum(round(("end" - start) * 1000)::BIGINT) AS ms, min(n) AS f FROM spoken x
  WHERE x.video_id = s.video_id AND x.seq = s.seq AND fs <> '' GROUP BY fs) ORDER BY ms DESC, f LIMIT 1) AS speaker
  FROM (SELECT DISTINCT video_id, seq FROM spoken) s""", SPOKEN))
def a11_segment_speaker(spark, sf):
    return s.segment_speakers(s.word_speakers(words(spark, sf).drop("speaker"), turns(spark, sf)), "seq")


@query(sql(""" SELECT video_id, chunk_id, run, any_value(speaker) AS speaker, min(start) AS start, arg_max("end", seq * 1000000 + n) AS "end",
  trim(string_agg(word, '' ORDER BY seq, n), ' ') AS text FROM (SELECT *, (sum(c) OVER (PARTITION BY video_id, chunk_id ORDER BY seq, n))::BIGINT AS run FROM
  (SELECT *, CASE WHEN row_number() OVER w = 1 OR speaker IS DISTINCT FROM lag(speaker) OVER w THEN 1 ELSE 0 END AS c FROM tplaced
   WHERE chunk_id IS NOT NULL WINDOW w AS (PARTITION BY video_id, chunk_id ORDER BY seq, n))) GROUP BY video_id, chunk_id, run""", TALK))
def w10_speaker_turns(spark, sf):
    found = s.placed_words(words(spark, sf), talk_chunks(spark, sf), WIDTH)
    return s.speaker_turns(found, ["video_id", "chunk_id"], ["seq", "n"])


@query(sql(""" SELECT c.video_id, c.chunk_id, coalesce(trim(string_agg(word, ' ' ORDER BY seq, n), ' '), '') AS text, count(word) AS word_count,
  coalesce(list_sort(list(DISTINCT speaker) FILTER (speaker IS NOT NULL)), []) AS speakers
  FROM tchunks c LEFT JOIN tplaced USING (video_id, chunk_id) GROUP BY c.video_id, c.chunk_id""", TALK))
def a12_cut_to_chunks(spark, sf):
    return s.chunk_texts(words(spark, sf), talk_chunks(spark, sf), WIDTH)


@query(sql(""" SELECT video_id, count(*) AS words_in_transcript, count(chunk_id) AS words, count(*) - count(chunk_id) AS words_outside_grid,
  count(DISTINCT chunk_id) AS chunks_with_speech FROM tplaced GROUP BY video_id""", TALK))
def a13_placement_stats(spark, sf):
    return s.placement_stats(words(spark, sf), talk_chunks(spark, sf), WIDTH)


@query(sql(""" SELECT video_id, sqrt(avg(x * x)) AS rms, max(abs(x)) AS peak, sqrt(avg(x * x)) < 0.001 AS silent FROM
  (SELECT video_id, (score - 50) / 100000 AS x FROM frames) GROUP BY video_id"""))
def a19_signal_level(spark, sf):
    return s.signal_level(frames(spark, sf).select("video_id", ((F.col("score") - 50) / 100000).alias("sample")))


@query(sql(""" SELECT video_id, seq, n, (start + "end") / 2 AS mid FROM words"""))
def x22_midpoint(spark, sf):
    return words(spark, sf).select("video_id", "seq", "n", s.midpoint().alias("mid"))
