"""Queries over grids: scores and frames are events, a chunk is a day."""

from __future__ import annotations

from pyspark.sql import functions as F

from moments.operators import grid as g
from moments.plans.registry import query
from moments.plans.views import DAY, GRID, frames, media, sql

CUTS = """cuts AS (SELECT video_id, media_ts AS "at", score AS value FROM frames WHERE score >= 60)"""
SPANS = """
edges AS (SELECT video_id, "at" FROM cuts JOIN media USING (video_id) WHERE "at" > 0 AND "at" < duration_s
  UNION SELECT video_id, 0.0 FROM media UNION SELECT video_id, duration_s FROM media),
spans0 AS (SELECT video_id, "at" AS start_ts, lead("at") OVER (PARTITION BY video_id ORDER BY "at") AS end_ts FROM edges),
spans AS (SELECT * FROM spans0 WHERE end_ts > start_ts)"""
MIN = f"""
m0 AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY video_id ORDER BY start_ts) = 1 OR end_ts - start_ts >= {DAY / 2}
  THEN 1 ELSE 0 END AS o FROM spans),
m1 AS (SELECT *, sum(o) OVER (PARTITION BY video_id ORDER BY start_ts) AS g FROM m0),
m2 AS (SELECT video_id, g, min(start_ts) AS start_ts, max(end_ts) AS end_ts FROM m1 GROUP BY ALL),
m3 AS (SELECT *, max(CASE WHEN g = 1 THEN end_ts - start_ts END) OVER (PARTITION BY video_id) AS f,
  max(g) OVER (PARTITION BY video_id) AS n FROM m2),
merged AS (SELECT video_id, min(start_ts) AS start_ts, max(end_ts) AS end_ts FROM m3
  GROUP BY video_id, CASE WHEN n > 1 AND f < {DAY / 2} THEN greatest(g, 2) ELSE g END)"""
SPLIT = f"""
k0 AS (SELECT *, greatest(1, ceil((end_ts - start_ts) / {2 * DAY}))::BIGINT AS k FROM merged),
pieces AS (SELECT video_id, start_ts + (end_ts - start_ts) / k * i AS start_ts,
  CASE WHEN i = k - 1 THEN end_ts ELSE start_ts + (end_ts - start_ts) / k * (i + 1) END AS end_ts
  FROM k0, range(40) r(i) WHERE i < k)"""
TAIL = f"""
t0 AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY start_ts DESC) AS back, count(*) OVER (PARTITION BY video_id) AS n FROM pieces),
t1 AS (SELECT *, max(CASE WHEN back = 1 THEN end_ts - start_ts END) OVER (PARTITION BY video_id) < {DAY / 2} AND n > 1 AS short,
  max(end_ts) OVER (PARTITION BY video_id) AS stop FROM t0),
tailed AS (SELECT video_id, start_ts, CASE WHEN short AND back = 2 THEN stop ELSE end_ts END AS end_ts FROM t1
  WHERE NOT (short AND back = 1)),
scene AS (SELECT video_id, row_number() OVER (PARTITION BY video_id ORDER BY start_ts) - 1 AS chunk_id, start_ts, end_ts FROM tailed)"""


def _scores(spark, sf):
    return frames(spark, sf).select("video_id", F.col("media_ts").alias("at"), F.col("score").alias("value"))


def _cuts(spark, sf):
    return g.rethreshold(_scores(spark, sf), 60.0)


def _grid(spark, sf):
    return g.uniform(media(spark, sf), DAY)


@query(sql(" SELECT * FROM chunks", GRID))
def w7_uniform_grid(spark, sf):
    return _grid(spark, sf)


@query(sql(" SELECT video_id, \"at\", value FROM cuts", CUTS))
def w9_rethreshold(spark, sf):
    return _cuts(spark, sf)


@query(sql(" SELECT * FROM spans", CUTS, SPANS))
def w3_spans(spark, sf):
    return g.spans_of(media(spark, sf), _cuts(spark, sf))


@query(sql(" SELECT * FROM merged", CUTS, SPANS, MIN))
def w4_min_merge(spark, sf):
    return g.min_merge(g.spans_of(media(spark, sf), _cuts(spark, sf)), DAY / 2)


@query(sql(" SELECT * FROM pieces", CUTS, SPANS, MIN, SPLIT))
def w5_max_split(spark, sf):
    return g.max_split(g.min_merge(g.spans_of(media(spark, sf), _cuts(spark, sf)), DAY / 2), 2 * DAY)


@query(sql(" SELECT * FROM tailed", CUTS, SPANS, MIN, SPLIT, TAIL))
def w6_merge_tail(spark, sf):
    spans = g.max_split(g.min_merge(g.spans_of(media(spark, sf), _cuts(spark, sf)), DAY / 2), 2 * DAY)
    return g.merge_tail(spans, DAY / 2)


@query(sql(" SELECT * FROM scene", CUTS, SPANS, MIN, SPLIT, TAIL))
def w8_policy_grid(spark, sf):
    return g.build(media(spark, sf), "scene", _cuts(spark, sf), chunk_s=2 * DAY, min_s=DAY / 2)


@query(sql(""" SELECT video_id, t AS threshold, count("at") AS cuts, count("at") / any_value(n) AS rate,
  list_sort(list(gap) FILTER (gap IS NOT NULL))[len(list(gap) FILTER (gap IS NOT NULL)) // 2 + 1] AS median_gap
  FROM (SELECT v.video_id, v.t, v.n, m."at", m.gap FROM
    (SELECT video_id, count(*) AS n, unnest([20.0, 60.0, 120.0]::DOUBLE[]) AS t FROM frames GROUP BY video_id) v
    LEFT JOIN (SELECT video_id, t, media_ts AS "at", media_ts - lag(media_ts) OVER (PARTITION BY video_id, t ORDER BY media_ts) AS gap
      FROM frames, (SELECT unnest([20.0, 60.0, 120.0]::DOUBLE[]) AS t) WHERE score >= t) m ON v.video_id = m.video_id AND v.t = m.t)
  GROUP BY video_id, t"""))  # fmt: skip
def a15_threshold_sweep(spark, sf):
    return g.sweep(_scores(spark, sf), [20.0, 60.0, 120.0])


@query(sql(""" SELECT video_id, count(*) AS chunks, min(end_ts - start_ts) AS shortest, max(end_ts - start_ts) AS longest,
  coalesce(any_value(o), 0) AS offered FROM scene LEFT JOIN (SELECT video_id, count(*) AS o FROM cuts GROUP BY 1) USING (video_id)
  GROUP BY video_id""", CUTS, SPANS, MIN, SPLIT, TAIL))  # fmt: skip
def a16_grid_stats(spark, sf):
    cuts = _cuts(spark, sf)
    return g.grid_stats(g.build(media(spark, sf), "scene", cuts, chunk_s=2 * DAY, min_s=DAY / 2), cuts)


PLACED = """placed AS (SELECT f.*, c.chunk_id FROM frames f JOIN chunks c ON f.video_id = c.video_id AND f.media_ts >= c.start_ts
  AND (f.media_ts < c.end_ts OR (f.media_ts = c.end_ts AND c.chunk_id = (SELECT max(chunk_id) FROM chunks x WHERE x.video_id = c.video_id))))"""


@query(sql(" SELECT video_id, idx, media_ts, chunk_id FROM placed", GRID, PLACED))
def j2_point_in_interval(spark, sf):
    found = g.point_join(frames(spark, sf), _grid(spark, sf), "media_ts", DAY)
    return found.select("video_id", "idx", "media_ts", "chunk_id")


@query(sql(""" SELECT f.video_id, f.idx, coalesce(max(p.chunk_id), CASE WHEN any_value(f.late) < 0 THEN min(c.chunk_id) ELSE max(c.chunk_id) END) AS chunk_id
  FROM (SELECT *, media_ts + CASE WHEN idx % 3 = 0 THEN 200000.0 ELSE 0.0 END AS late FROM frames) f JOIN chunks c USING (video_id)
  LEFT JOIN chunks p ON p.video_id = f.video_id AND p.chunk_id = c.chunk_id AND f.late >= p.start_ts AND f.late < p.end_ts
  GROUP BY f.video_id, f.idx""", GRID))  # fmt: skip
def j3_nearest_chunk(spark, sf):
    late = frames(spark, sf).withColumn("late", F.col("media_ts") + F.when(F.col("idx") % 3 == 0, 200000.0).otherwise(0.0))
    return g.nearest_join(late, _grid(spark, sf), "late", DAY).select("video_id", "idx", "chunk_id")


@query(sql(" SELECT video_id, chunk_id FROM chunks WHERE end_ts > 500000 AND start_ts < 800000", GRID))
def f5_window_to_chunks(spark, sf):
    return g.window_chunks(_grid(spark, sf), 500000, 800000).select("video_id", "chunk_id")


@query(sql(""" SELECT DISTINCT c.video_id, c.chunk_id FROM chunks c JOIN
  (SELECT video_id, chunk_id FROM placed WHERE score > 150) p ON c.video_id = p.video_id AND abs(c.chunk_id - p.chunk_id) <= 1""", GRID, PLACED))  # fmt: skip
def f6_widen(spark, sf):
    chunks = _grid(spark, sf)
    chosen = g.point_join(frames(spark, sf), chunks, "media_ts", DAY).filter("score > 150")
    return g.widen(chosen, chunks, 1)


@query(sql(""" SELECT f.idx, coalesce(min(start_ts), 0.0) AS start_ts, coalesce(max(end_ts), 0.0) AS end_ts FROM
  (SELECT video_id, idx, unnest([idx % 40, idx % 7]) AS chunk_id FROM frames) f LEFT JOIN chunks USING (video_id, chunk_id) GROUP BY f.idx""", GRID))  # fmt: skip
def j5_resolve_span(spark, sf):
    cited = frames(spark, sf).select("video_id", "idx", F.explode(F.array(F.col("idx") % 40, F.col("idx") % 7)).alias("chunk_id"))
    return g.span_of(cited, _grid(spark, sf), "idx")


@query(sql(""" SELECT c.video_id, c.chunk_id, s.sampler_id, count(p.idx) AS frames, min(p.media_ts) AS first_ts FROM chunks c
  JOIN (SELECT DISTINCT sampler_id FROM frames) s ON true LEFT JOIN placed p ON p.video_id = c.video_id AND p.chunk_id = c.chunk_id
  AND p.sampler_id = s.sampler_id GROUP BY ALL""", GRID, PLACED))  # fmt: skip
def a14_sampling_stats(spark, sf):
    """Frames by chunk and sampler, empty ones included; the few samplers multiply the grid."""
    seen, chunks = frames(spark, sf), _grid(spark, sf)
    counts = (
        g.point_join(seen, chunks, "media_ts", DAY)
        .groupBy("video_id", "chunk_id", "sampler_id")
        .agg(F.count(F.lit(1)).alias("frames"), F.min("media_ts").alias("first_ts"))
    )
    names = F.array_sort(F.collect_set("sampler_id"))
    every = chunks.join(F.broadcast(seen.agg(names.alias("s"))), F.lit(True)).select("video_id", "chunk_id", F.explode("s").alias("sampler_id"))
    return every.join(counts, ["video_id", "chunk_id", "sampler_id"], "left").fillna(0, ["frames"])
