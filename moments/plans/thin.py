"""Queries for thinning and its streaming forms."""

from __future__ import annotations

from pyspark.sql import functions as F

from moments.functions import vectors as vx
from moments.operators import grid as g
from moments.operators import sampling as sp
from moments.operators import scan as sc
from moments.operators import thin as th
from moments.operators.folder import saved
from moments.plans.grid import PLACED, _grid
from moments.plans.registry import ORACLES, query
from moments.plans.views import DAY, GRID, START, frames, sql, table
from moments.streaming import sampling as ss
from moments.streaming import stream as st

RATE = 1 / 3600.0
#: Some frames arrive late: their media time is up to two hours older than their place says.
LATE = f"""late AS (SELECT video_id, sampler_id, idx, media_ts - idx % 3 * 3600.0::DOUBLE AS media_ts FROM frames),
dec AS (SELECT video_id, idx, b AS bucket FROM (SELECT *, max(b) OVER (PARTITION BY video_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM
  (SELECT *, floor(media_ts * {RATE!r}::DOUBLE)::BIGINT AS b FROM late)) WHERE top IS NULL OR b > top)"""


def _late(df):
    return df.withColumn("media_ts", F.col("media_ts") - F.col("idx") % 3 * F.lit(3600.0))


@query(sql(" SELECT * FROM dec", LATE))
def t1_decimate(spark, sf):
    return th.decimate(_late(frames(spark, sf)), RATE).select("video_id", "idx", "bucket")


@query(sql(" SELECT * FROM dec", LATE))
def t1_decimate_stream(spark, sf):
    events = st.file_stream(spark, sf, "events")
    seen = events.select(
        F.col("user_id").cast("string").alias("video_id"), F.col("event_id").alias("idx"), (F.expr(f"timestampdiff(MICROSECOND, {START}, ts)") / 1e6).alias("media_ts")
    )
    return st.run(st.decimated(_late(seen), RATE))


@query(sql(f" SELECT idx, floor(media_ts * {RATE!r}::DOUBLE)::BIGINT AS bucket FROM frames"))
def x21_time_bucket(spark, sf):
    return frames(spark, sf).select("idx", th.bucket(F.col("media_ts"), RATE).alias("bucket"))


def _placed(spark, sf):
    return g.point_join(frames(spark, sf), _grid(spark, sf), "media_ts", DAY)


def RATED(rows: str, apart: float, most: int, by: str) -> str:
    """Frames of rows kept by a rate limit: each step of the recursion finds the next frame of every group."""
    same = " AND ".join(f"p.{c} = r.{c}" for c in by.split(", "))
    cols = ", ".join(f"p.{c}" for c in by.split(", "))
    return f"""rl AS (SELECT * FROM (SELECT {by}, idx, media_ts, 1 AS n FROM {rows} QUALIFY row_number() OVER (PARTITION BY {by} ORDER BY media_ts, idx) = 1)
  UNION ALL SELECT * FROM (SELECT {cols}, p.idx, p.media_ts, r.n + 1 AS n FROM rl r JOIN {rows} p ON {same} AND p.media_ts - r.media_ts >= {apart!r}::DOUBLE
    WHERE r.n < {most} QUALIFY row_number() OVER (PARTITION BY {cols} ORDER BY p.media_ts, p.idx) = 1))"""


def recursive(text: str) -> str:
    return text.replace("WITH", "WITH RECURSIVE", 1)


@query(recursive(sql(" SELECT video_id, sampler_id, chunk_id, idx FROM rl", GRID, PLACED, RATED("placed", 7200.0, 5, "video_id, sampler_id, chunk_id"))))
def t2_rate_limit(spark, sf):
    return th.rate_limit(_placed(spark, sf), 7200.0, 5)


@query(sql(""" SELECT video_id, chunk_id, idx FROM (SELECT *, row_number() OVER (PARTITION BY video_id, chunk_id ORDER BY media_ts, idx) AS n FROM placed) WHERE (n - 1) % 3 = 0""", GRID, PLACED))
def t3_stride(spark, sf):
    return th.stride(_placed(spark, sf), 3).select("video_id", "chunk_id", "idx")


def _vectors(spark, sf):
    return table(spark, sf, "embeddings").select(
        F.floor(F.col("vec_id") / 50).cast("string").alias("video_id"), F.floor(F.col("vec_id") / 10).cast("long").alias("chunk_id"),
        F.col("vec_id").alias("idx"), vx.doubles(F.col("embedding")).alias("vector"),
    )


_COSINE = "round(list_dot_product(p.v, r.v) / (sqrt(list_dot_product(p.v, p.v)) * sqrt(list_dot_product(r.v, r.v))), 9)"


@query(f"""WITH RECURSIVE fr AS (SELECT CAST(vec_id // 50 AS VARCHAR) AS video_id, vec_id // 10 AS chunk_id, vec_id AS idx, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
  kp AS (SELECT * FROM (SELECT * FROM fr QUALIFY row_number() OVER (PARTITION BY chunk_id ORDER BY idx) = 1) UNION ALL
    SELECT * FROM (SELECT p.* FROM kp r JOIN fr p ON p.chunk_id = r.chunk_id AND p.idx > r.idx AND {_COSINE} < 0.2 QUALIFY row_number() OVER (PARTITION BY p.chunk_id ORDER BY p.idx) = 1))
  SELECT video_id, chunk_id, idx FROM kp""")
def t4_change_reference(spark, sf):
    return th.change_sampler(_vectors(spark, sf), 0.2)


@query("""WITH v AS (SELECT vec_id, vec_id // 50 AS vid, vec_id // 10 AS chunk_id, CAST(embedding AS DOUBLE[]) AS v, lag(CAST(embedding AS DOUBLE[])) OVER (PARTITION BY vec_id // 10 ORDER BY vec_id) AS p FROM embeddings)
  SELECT CAST(vid AS VARCHAR) AS video_id, chunk_id, vec_id AS idx FROM v WHERE p IS NULL OR round(list_dot_product(v, p) / (sqrt(list_dot_product(v, v)) * sqrt(list_dot_product(p, p))), 9) < 0.2""")
def t5_change_consecutive(spark, sf):
    return th.consecutive_changes(_vectors(spark, sf), vx.cosine, 0.2)


_W = "greatest(least(a[3], b[3]) - greatest(a[1], b[1]), 0) * greatest(least(a[4], b[4]) - greatest(a[2], b[2]), 0)"
_IOU = f"({_W}) / ((a[3] - a[1]) * (a[4] - a[2]) + (b[3] - b[1]) * (b[4] - b[2]) - {_W})"


@query(f"""WITH RECURSIVE fr AS (SELECT * FROM (SELECT l_orderkey % 500 AS video_id, l_orderkey AS idx,
    list([l_quantity, l_discount * 100, l_quantity + 10, l_discount * 100 + 5]) FILTER (l_returnflag <> 'N') AS g FROM lineitem GROUP BY l_orderkey) WHERE len(g) > 0),
  kp AS (SELECT * FROM (SELECT * FROM fr QUALIFY row_number() OVER (PARTITION BY video_id ORDER BY idx) = 1) UNION ALL
    SELECT * FROM (SELECT p.* FROM kp r JOIN fr p ON p.video_id = r.video_id AND p.idx > r.idx
      AND list_min(list_transform(p.g, lambda a: list_max(list_transform(r.g, lambda b: {_IOU})))) < 0.3 QUALIFY row_number() OVER (PARTITION BY p.video_id ORDER BY p.idx) = 1))
  SELECT video_id, idx FROM kp""")
def t6_region_change(spark, sf):
    li = table(spark, sf, "lineitem")
    box = F.array(F.col("l_quantity"), F.col("l_discount") * 100, F.col("l_quantity") + 10, F.col("l_discount") * 100 + 5)
    seen = li.groupBy((F.col("l_orderkey") % 500).alias("video_id"), F.col("l_orderkey").alias("idx")).agg(
        F.sort_array(F.collect_list(F.when(F.col("l_returnflag") != "N", box))).alias("regions")
    )
    return th.region_sampler(seen, 0.3, th.box_iou)


def _closeness(a, b):
    return 1 / (1 + F.abs(a - b))


SAMPLERS = [
    th.Sampler("stride", every=2),
    th.Sampler("interval", "interval", min_interval=3600.0, most=10),
    th.Sampler("change", "change", threshold=0.05, describe=lambda: F.col("score"), compare=_closeness),
]

_INGEST = """dec7 AS (SELECT video_id, idx, media_ts, score FROM (SELECT *, max(b) OVER (PARTITION BY video_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM
  (SELECT *, floor(media_ts * %r::DOUBLE)::BIGINT AS b FROM frames)) WHERE top IS NULL OR b > top),
off7 AS (SELECT d.*, c.chunk_id, row_number() OVER (PARTITION BY d.video_id, c.chunk_id ORDER BY idx) - 1 AS chunk_local_index FROM dec7 d JOIN
  (SELECT *, max(chunk_id) OVER (PARTITION BY video_id) AS last FROM chunks) c ON c.video_id = d.video_id AND d.media_ts >= start_ts AND (d.media_ts < end_ts OR c.chunk_id = last))""" % RATE
_CHANGE = "round(1 / (1 + abs(score - lag(score) OVER (PARTITION BY video_id, chunk_id ORDER BY idx))), 4)"


@query(recursive(sql(f""", rec AS (SELECT video_id, chunk_id, 'stride' AS sampler_id, idx, NULL::DOUBLE AS score FROM off7 WHERE chunk_local_index % 2 = 0
    UNION ALL SELECT video_id, chunk_id, 'interval', idx, NULL FROM rl
    UNION ALL SELECT video_id, chunk_id, 'change', idx, s FROM (SELECT *, {_CHANGE} AS s FROM off7) WHERE s IS NULL OR s < 0.05)
  SELECT rec.video_id, rec.chunk_id, sampler_id, rec.idx, round(media_ts, 3) AS media_ts, chunk_local_index, coalesce(rec.score, -1) AS score FROM rec JOIN off7 o USING (video_id, chunk_id, idx)""",
  GRID, _INGEST, RATED("off7", 3600.0, 10, "video_id, chunk_id"))))
def t7_ingest(spark, sf):
    """Decimated frames offered to a stride, a rate limit and a change sampler; records with place and score."""
    out = th.ingest(frames(spark, sf), _grid(spark, sf), SAMPLERS, RATE, DAY)
    return out.withColumn("score", F.coalesce("score", F.lit(-1.0)))


def _events(spark, sf, *columns):
    """Events in three files and a closing one, every other event up to a day late; no row of the closing time is a result."""
    rows = table(spark, sf, "events").select(F.expr("unix_micros(CAST(ts AS TIMESTAMP))").alias("us"), *columns)
    return ss.arrivals(rows, "us", 3, DAY * 1e6, {}).withColumn("ts", F.timestamp_micros("us"))


@query("""SELECT epoch_us(time_bucket(INTERVAL 1 DAY, ts)) AS start_us, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY ALL""")
def t8_tumbling_stream(spark, sf):
    """Windows leave the state once the watermark has passed them."""
    return st.run_counted(st.tumbling(_events(spark, sf, "event_type", "value"), "1 day", late=WAIT))[0]


@query("""SELECT user_id, epoch_us(min(ts)) AS start_us, count(*) AS n FROM (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY ts) AS g FROM
  (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 6 HOUR THEN 0 ELSE 1 END AS s FROM events)) GROUP BY user_id, g""")
def t9_silence_sessions_stream(spark, sf):
    """Sessions leave the state, and are written once, when the watermark has passed their pause."""
    return st.run_counted(st.sessions(_events(spark, sf, "user_id"), "6 hours", late=WAIT))[0]


@query("SELECT user_id, count(*) AS n, max(event_id) AS last_event FROM events GROUP BY user_id")
def t10_incremental_upsert_stream(spark, sf):
    """Only the keys of a micro-batch are recomputed, and only their rows of the table are written."""
    events = st.file_stream(spark, sf, "events", 4)
    counted = lambda df: df.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.max("event_id").alias("last_event"))
    merged = lambda df: df.groupBy("user_id").agg(F.sum("n").alias("n"), F.max("last_event").alias("last_event"))
    return st.maintain(events, ["user_id"], counted, merged)


@query("""WITH v AS (SELECT vec_id, vec_id // 50 AS vid, vec_id // 10 AS chunk_id, CAST(embedding AS DOUBLE[]) AS v, lag(CAST(embedding AS DOUBLE[])) OVER (PARTITION BY vec_id // 10 ORDER BY vec_id) AS p FROM embeddings),
  s AS (SELECT *, CASE WHEN p IS NOT NULL THEN round(list_sum(list_transform(v, lambda x, i: ((x > 0) = (p[i] > 0))::INT::DOUBLE)) / len(v), 4) END AS score FROM v)
  SELECT CAST(vid AS VARCHAR) AS video_id, chunk_id, vec_id AS idx, coalesce(score, -1) AS score FROM s WHERE score IS NULL OR score < 0.5""")
def p5_sampler_protocol(spark, sf):
    """A sampler of the user's own: it describes a frame by the signs of its vector and compares by the share of equal ones."""

    def same(a, b):
        return F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("double")), F.lit(0.0), lambda s, x: s + x) / F.size(a)

    own = th.Sampler("signs", "change", threshold=0.5, describe=lambda: F.transform("vector", lambda x: x > 0), compare=same)
    return own.kept(_vectors(spark, sf)).withColumn("score", F.coalesce("score", F.lit(-1.0)))


#: Frames come in three files and a closing one, every other frame up to a day later than its time; the watermark waits two.
LATER, WAIT = DAY, "2 days"


def _arriving(rows, order: str, late: float, **closing):
    return ss.arrivals(rows, order, 3, late, {"video_id": "-1"} | closing)


def _media_time():
    return F.timestamp_micros((F.col("media_ts") * 1e6).cast("long") + 1)


def _index_time():
    return F.timestamp_seconds(F.col("idx") + 1)


def _chunk_time():
    """The last time of a frame of its chunk, after which the chunk's state can go."""
    return F.timestamp_micros((F.col("end_ts") * 1e6).cast("long") + 1)


def _streamed(rows, rules, at, late, **options):
    slots = 16 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return st.run_counted(ss.sampled_stream(rows, rules, at, late, slots=slots, **options))[0]


def _kinds(spark, sf):
    return frames(spark, sf).withColumnRenamed("sampler_id", "kind")


@query(ORACLES["t1_decimate"])
def t1_decimate_in_order_stream(spark, sf):
    """Frames arrive in three files, mixed in time; the watermark puts them in order before a bucket is decided."""
    seen = _arriving(_late(frames(spark, sf)).select("video_id", "idx", "media_ts"), "idx", 500, media_ts=0.0)
    kept = _streamed(seen, [sp.FrameRule("all", "interval")], _index_time(), "1000 seconds", by=("video_id",), rate=RATE)
    return kept.select("video_id", "idx", th.bucket(F.col("media_ts"), RATE).alias("bucket"))


@query(ORACLES["t2_rate_limit"])
def t2_rate_limit_stream(spark, sf):
    seen = _arriving(_kinds(spark, sf).drop("score"), "media_ts", LATER, kind="end", idx=0)
    chunks = saved(_grid(spark, sf))
    place = lambda x: g.point_join(x, chunks, "media_ts", DAY)
    rules = [sp.FrameRule("rate", "interval", min_interval=7200.0, most=5)]
    kept = _streamed(seen, rules, _media_time(), WAIT, by=("video_id", "kind", "chunk_id"), end=_chunk_time(), place=place)
    return kept.select("video_id", F.col("kind").alias("sampler_id"), "chunk_id", "idx")


@query(ORACLES["t3_stride"])
def t3_stride_stream(spark, sf):
    seen = _arriving(frames(spark, sf).select("video_id", "idx", "media_ts"), "media_ts", LATER, idx=0)
    chunks = saved(_grid(spark, sf))
    place = lambda x: g.point_join(x, chunks, "media_ts", DAY)
    return _streamed(seen, [sp.FrameRule("third", every=3)], _media_time(), WAIT, end=_chunk_time(), place=place).select("video_id", "chunk_id", "idx")


def _arriving_vectors(spark, sf):
    rows = _vectors(spark, sf).withColumn("media_ts", F.col("idx").cast("double"))
    return _arriving(rows, "idx", 40, chunk_id=-1, media_ts=0.0)


@query(ORACLES["t4_change_reference"])
def t4_change_reference_stream(spark, sf):
    """A chunk ends with its ten vectors: ten seconds later its state has gone."""
    rules = [sp.FrameRule("drift", "reference", threshold=0.2, describe=lambda: F.col("vector"))]
    end = F.timestamp_seconds((F.col("chunk_id") + 1) * 10 + 1)
    return _streamed(_arriving_vectors(spark, sf), rules, _index_time(), "100 seconds", end=end).select("video_id", "chunk_id", "idx")


@query(ORACLES["t5_change_consecutive"])
def t5_change_consecutive_stream(spark, sf):
    rules = [sp.FrameRule("step", "consecutive", threshold=0.2, describe=lambda: F.col("vector"))]
    end = F.timestamp_seconds((F.col("chunk_id") + 1) * 10 + 1)
    return _streamed(_arriving_vectors(spark, sf), rules, _index_time(), "100 seconds", end=end).select("video_id", "chunk_id", "idx")


#: Frames with regions: an order is a frame, its lines that came back or were kept are what is in shot; 100 orders are a chunk.
_REGIONS = """fr AS (SELECT l_orderkey % 500 AS video_id, l_orderkey // 20000 AS chunk_id, l_orderkey AS idx,
    coalesce(list([l_quantity, l_discount * 100, l_quantity + 10, l_discount * 100 + 5]) FILTER (l_returnflag <> 'N'), []) AS g FROM lineitem GROUP BY ALL),
  seq AS (SELECT *, row_number() OVER (PARTITION BY video_id, chunk_id ORDER BY idx) AS n FROM fr)"""


def _walked(kept: str) -> str:
    """Frame by frame: ref is the last chosen frame, k the number of kept ones, t the index of the last."""
    return f"""WITH RECURSIVE {_REGIONS},
  w AS (SELECT video_id, chunk_id, idx, n, g AS ref, true AS kept, 1 AS k, idx AS t FROM seq WHERE n = 1
    UNION ALL SELECT video_id, chunk_id, idx, n, CASE WHEN c THEN g ELSE ref END, c, k + c::INT, CASE WHEN c THEN idx ELSE t END FROM (
      SELECT s.*, w.ref, w.k, w.t, {kept} AND len(s.g) > 0 AND (len(w.ref) = 0 OR
        list_min(list_transform(s.g, lambda a: list_max(list_transform(w.ref, lambda b: {_IOU})))) < 0.3) AS c
      FROM w JOIN seq s ON s.video_id = w.video_id AND s.chunk_id = w.chunk_id AND s.n = w.n + 1))
  SELECT video_id, chunk_id, idx FROM w WHERE kept"""


def _regions(spark, sf):
    li = table(spark, sf, "lineitem")
    box = F.array(F.col("l_quantity"), F.col("l_discount") * 100, F.col("l_quantity") + 10, F.col("l_discount") * 100 + 5)
    idx = F.col("l_orderkey")
    return li.groupBy((idx % 500).alias("video_id"), F.floor(idx / 20000).cast("long").alias("chunk_id"), idx.alias("idx")).agg(
        F.sort_array(F.collect_list(F.when(F.col("l_returnflag") != "N", box))).alias("regions"), idx.cast("double").alias("media_ts")
    )


def _boxes(**more):
    return [sp.FrameRule("boxes", "regions", threshold=0.3, describe=lambda: F.col("regions"), similarity=th.box_iou, **more)]


@query(_walked("true"))
def t6_region_chunks(spark, sf):
    """Regions anew in each chunk; a first frame with nothing in it is kept."""
    return sp.sampled(_regions(spark, sf), _boxes()).select("video_id", "chunk_id", "idx")


@query(_walked("true"))
def t6_region_chunks_stream(spark, sf):
    seen = ss.arrivals(_regions(spark, sf), "idx", 3, 5000, {"video_id": -1, "chunk_id": -1, "media_ts": 0.0})
    end = F.timestamp_seconds((F.col("chunk_id") + 1) * 20000 + 1)
    return _streamed(seen, _boxes(), _index_time(), "10000 seconds", end=end).select("video_id", "chunk_id", "idx")


@query(_walked("k < 6 AND s.idx - w.t >= 1200"))
def t6_region_limits(spark, sf):
    """The least interval and the most of a chunk lie over the rule, which does not see the frames in between."""
    return sp.sampled(_regions(spark, sf), _boxes(min_interval=1200.0, most=6)).select("video_id", "chunk_id", "idx")


def _near(a, b):
    return round(1 / (1 + abs(a - b)), 4)


@query(ORACLES["t7_ingest"])
def t7_ingest_stream(spark, sf):
    """Frames decimated, placed in the grid and offered to three samplers as they arrive, one state a video."""
    seen = _arriving(frames(spark, sf).drop("sampler_id"), "idx", 500, media_ts=0.0, score=0.0)
    chunks = _grid(spark, sf)
    rules = [
        sp.FrameRule("stride", every=2),
        sp.FrameRule("interval", "interval", min_interval=3600.0, most=10),
        sp.FrameRule("change", "consecutive", threshold=0.05, describe=lambda: F.col("score"), similarity=_near),
    ]
    place = lambda x: g.nearest_join(x, chunks, "media_ts", DAY)
    kept = _streamed(seen, rules, _index_time(), "1000 seconds", by=("video_id",), rate=RATE, place=place)
    return kept.withColumn("media_ts", F.round("media_ts", 3)).withColumn("score", F.coalesce(F.round("score", 4), F.lit(-1.0)))


@query(ORACLES["t1_decimate"])
def t1_decimate_by_ranges(spark, sf):
    """A video of any size: buckets before a frame come from its range and from the ranges before."""
    return sc.decimated(_late(frames(spark, sf)), RATE).select("video_id", "idx", "bucket")


@query(sql(""" SELECT video_id, idx, (row_number() OVER (PARTITION BY video_id ORDER BY media_ts, idx) - 1) // 25 AS batch FROM frames"""))
def w15_batches_by_ranges(spark, sf):
    return sc.batched(frames(spark, sf), ["video_id"], ["media_ts", "idx"], 25).select("video_id", "idx", "batch")


@query("""SELECT l_returnflag AS flag, list_sort(list(l_extendedprice))[count(*) // 2 + 1] AS median, quantile_cont(l_extendedprice, 0.9) AS q90 FROM lineitem GROUP BY 1""")
def a1_order_statistics_by_ranges(spark, sf):
    """Upper medians and quantiles of groups that no array holds."""
    li = table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("flag"), F.col("l_extendedprice").alias("price"))
    return sc.upper_median(li, ["flag"], "price").join(sc.quantile(li, ["flag"], "price", 0.9).withColumnRenamed("quantile", "q90"), "flag")
