"""Samplers over a table and over 1, 3 and 20 micro-batches give the same records; late frames are dropped and counted; state leaves."""

import random

import pytest
from pyspark.sql import functions as F

from moments.operators import sampling as sp
from moments.operators.thin import box_iou
from moments.streaming import sampling as ss
from moments.streaming.stream import run_counted

KIND = "video_id string, chunk_id long, idx long, media_ts double, v array<double>, g array<array<double>>"
CLOSING = {"video_id": "end", "chunk_id": 0, "idx": 0, "media_ts": 0.0}
RULES = [
    sp.FrameRule("stride", every=3, most=4),
    sp.FrameRule("interval", "interval", min_interval=5.0, most=3),
    sp.FrameRule("step", "consecutive", threshold=0.4, min_interval=1.0, describe=lambda: F.col("v")),
    sp.FrameRule("drift", "reference", threshold=0.4, most=9, describe=lambda: F.col("v")),
    sp.FrameRule("boxes", "regions", threshold=0.3, describe=lambda: F.col("g"), similarity=box_iou),
]


def frames(n=240):
    rnd = random.Random(7)

    def boxes():
        return [[x, y, x + 5.0, y + 5.0] for x, y in ((rnd.random() * 6, rnd.random() * 6) for _ in range(rnd.choice([0, 0, 1, 2])))]

    return [(f"v{i % 4}", int(i * 0.5 // 20), i, i * 0.5 + rnd.choice([0, 0.25]), [rnd.gauss(0, 1) for _ in range(3)], boxes()) for i in range(n)]


def at(column):
    return F.timestamp_micros((F.col(column) * 1e6).cast("long"))


def plain(rows):
    return sorted(tuple(r) for r in rows)


def by_hand(rows, rule, told):
    """A sampler as the words of its rule have it, on the frames of one chunk."""
    kept, shown, chosen = [], None, None
    for place, r in enumerate(sorted(rows, key=lambda r: (r[3], r[2]))):
        if rule.most is not None and len(kept) >= rule.most or kept and r[3] - kept[-1][3] < rule.min_interval:
            continue
        now = told(r)
        if rule.rule in ("stride", "interval"):
            yes = rule.rule == "interval" or place % rule.every == 0
        elif rule.rule == "regions":
            if chosen is None:
                yes, chosen = True, now
            elif not now:
                yes = False
            else:
                best = [max(float(box_iou(sp.np.array([a]), sp.np.array([b]))[0, 0]) for b in chosen) for a in now] if chosen else [0.0]
                yes = min(best) < rule.threshold
                chosen = now if yes else chosen
        else:
            known = shown if rule.rule == "consecutive" else chosen
            yes = known is None or sp.cosine(now, known) < rule.threshold
            shown, chosen = now, now if yes else chosen
        if yes or not kept:
            kept.append(r)
    return [(r[0], r[1], rule.sampler_id, r[2]) for r in kept]


def test_the_fold_against_the_rules(spark):
    rows = frames()
    got = sp.sampled(spark.createDataFrame(rows, KIND), RULES, order="media_ts").select("video_id", "chunk_id", "sampler_id", "idx").collect()
    want = []
    for key in {r[:2] for r in rows}:
        mine = [r for r in rows if r[:2] == key]
        for rule in RULES:
            want += by_hand(mine, rule, lambda r, rule=rule: r[5] if rule.rule == "regions" else r[4])
    assert plain(got) == sorted(want)
    with pytest.raises(ValueError):
        sp.FrameRule("x", "regions")
    with pytest.raises(ValueError):
        sp.sampled(spark.createDataFrame(rows, KIND), [RULES[0], RULES[0]])


@pytest.mark.parametrize("files", [1, 3, 20])
def test_streams_give_the_rows_of_the_table(spark, files):
    df = spark.createDataFrame(frames(), KIND)
    want = plain(sp.sampled(df, RULES, order="media_ts").collect())
    end = at("chunk_end")
    place = lambda x: x.withColumn("chunk_end", (F.col("chunk_id") + 1) * 20.0 + 1)
    stream = ss.arrivals(df, "media_ts", files, 8.0, CLOSING)
    kept, progress = run_counted(ss.sampled_stream(stream, RULES, at("media_ts"), "60 seconds", end=end, place=place))
    assert plain(kept.filter("video_id <> 'end'").select("video_id", "chunk_id", "sampler_id", "idx", "media_ts", "chunk_local_index", "score").collect()) == want
    assert sum(p["late"] for p in progress) == 0
    assert progress[-1]["state_rows"] <= 4  # the closing frame only: every chunk has gone


def test_late_frames_are_dropped_and_counted(spark):
    df = spark.createDataFrame(frames(), KIND)
    stream = ss.arrivals(df, "media_ts", 20, 60.0, CLOSING)
    kept, progress = run_counted(ss.sampled_stream(stream, RULES[:1], at("media_ts"), "5 seconds"))
    assert sum(p["late"] for p in progress) > 0
    assert kept.count() > 0


@pytest.mark.parametrize("files", [1, 3])
def test_a_video_is_decimated_and_sampled_in_one_state(spark, files):
    rows = [(v, c, i, ts - i % 3 * 2.0, x, g) for v, c, i, ts, x, g in frames()]
    df = spark.createDataFrame(rows, KIND)
    top, want = {}, []
    for r in sorted(rows, key=lambda r: r[2]):
        if int(r[3] // 2) > top.get(r[0], -99):
            top[r[0]] = int(r[3] // 2)
            want.append(r)
    want = plain(sp.sampled(spark.createDataFrame(want, KIND), RULES).select("video_id", "chunk_id", "sampler_id", "idx", "score").collect())
    stream = ss.arrivals(df, "idx", files, 10, CLOSING)
    kept, _ = run_counted(ss.sampled_stream(stream, RULES, F.timestamp_seconds(F.col("idx") + 1), "60 seconds", by=("video_id",), rate=0.5))
    assert plain(kept.filter("video_id <> 'end'").select("video_id", "chunk_id", "sampler_id", "idx", "score").collect()) == want


@pytest.mark.parametrize("slots", [1, 16])
def test_many_keys_of_a_frame_share_the_state_of_a_slot(spark, slots):
    rows = [(f"v{i}" if i % 50 else None, i % 3, i, float(i % 900 + 1), [0.0], []) for i in range(3000)]
    df = spark.createDataFrame(rows, KIND)
    rules = [sp.FrameRule("rate", "interval", min_interval=5.0, most=2)]
    want = sorted(map(str, sp.sampled(df, rules, order="media_ts").select("video_id", "chunk_id", "idx", "media_ts").collect()))
    stream = ss.arrivals(df, "media_ts", 3, 100.0, CLOSING)
    end = at("media_ts") + F.expr("INTERVAL 1000 SECONDS")
    kept, progress = run_counted(ss.sampled_stream(stream, rules, at("media_ts"), "200 seconds", end=end, slots=slots))
    got = kept.filter("video_id IS NULL OR video_id <> 'end'").select("video_id", "chunk_id", "idx", "media_ts").collect()
    assert sorted(map(str, got)) == want
    assert all(p["state_rows"] <= 4 * slots for p in progress)  # blocks, folds and a timer


def test_an_arrival_of_many_files_is_one_micro_batch(spark, monkeypatch):
    monkeypatch.setattr(ss, "FILE", 20)
    df = spark.createDataFrame(frames(), KIND)
    stream = ss.arrivals(df, "media_ts", 3, 8.0, CLOSING)
    kept, progress = run_counted(ss.sampled_stream(stream, RULES[:1], at("media_ts"), "60 seconds"))
    assert [p["rows"] for p in progress if p["rows"]][-1] == 1 and sum(p["rows"] > 0 for p in progress) == 4
    assert plain(kept.filter("video_id <> 'end'").collect()) == plain(sp.sampled(df, RULES[:1], order="media_ts").collect())
