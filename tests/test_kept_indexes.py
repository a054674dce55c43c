"""Kept indexes give the rows of full scans, also after changes, and skip what their bounds allow."""

import random

import numpy as np
from pyspark.sql import functions as F

from moments.operators import answers as an
from moments.operators import index as ix
from moments.operators import search as se
from moments.operators import stats

WORDS = "river stone light house garden winter morning letter street music paper market doctor station kitchen window evening summer bridge forest".split()


def units(rnd, n):
    return [(f"v{i % 4}", i, "s", " ".join(rnd.choices(WORDS[: 3 + i % 18], k=rnd.choice([0, 3, 8, 300 if i % 25 == 0 else 12])))) for i in range(n)]


def plain(rows):
    return sorted(tuple(r) for r in rows)


def ranking(index, queries, k):
    columns = ["q", *se.KEY, "shared", "text_score", "text_rank"]
    ranked, reading = index.top(queries, k)
    return plain(ranked.select(*columns).collect()), reading.first()


def test_text_index_before_and_after_changes(spark):
    rnd = random.Random(1)
    kind = "video_id string, chunk_id long, sampler_id string, content string"
    rows = units(rnd, 900)
    queries = spark.createDataFrame([(1, "river music"), (2, "Forest!"), (3, "garden garden window bridge"), (4, "nothing of it"), (5, "")], "q long, text string")
    df = spark.createDataFrame(rows, kind)
    full = lambda d, k: plain(se.lexical_top(d, queries, k).select("q", *se.KEY, "shared", "text_score", "text_rank").collect())
    index = ix.TextIndex.build(df)
    for k in (5, 60):
        got, reading = ranking(index, queries, k)
        assert got == full(df, k)
        assert reading.read <= reading.asked <= reading.held
    changed = [(v, c, s, "river " * 40 if c % 50 == 0 else t + " bridge") for v, c, s, t in rows if c % 10 == 0] + [("new", 5000, "s", "forest forest river")]
    gone = [r[:3] for r in rows if r[1] % 10 == 3]
    left = [r for r in rows if r[1] % 10 not in (0, 3)] + changed
    index.upsert(spark.createDataFrame(changed, kind), spark.createDataFrame(gone, "video_id string, chunk_id long, sampler_id string"))
    assert ranking(index, queries, 20)[0] == full(spark.createDataFrame(left, kind), 20)
    empty = ix.TextIndex.build(df.limit(0))
    assert ranking(empty, queries, 5)[0] == []


def test_long_units_are_found_without_the_others(spark, monkeypatch):
    monkeypatch.setattr(ix, "SEEDS", 4)  # a small table has few blocks
    rnd = random.Random(2)
    rows = [("v", i, "s", " ".join(rnd.choices(WORDS, k=4000 if i < 40 else rnd.randint(5, 60)))) for i in range(4000)]
    df = spark.createDataFrame(rows, "video_id string, chunk_id long, sampler_id string, content string")
    queries = spark.createDataFrame([(1, "river music stone")], "q long, text string")
    got, reading = ranking(ix.TextIndex.build(df), queries, 5)
    assert got == plain(se.lexical_top(df, queries, 5).select("q", *se.KEY, "shared", "text_score", "text_rank").collect())
    assert reading.read < reading.asked / 10


def test_vector_index_with_two_widths(spark):
    rng = np.random.default_rng(3)
    centres = {8: rng.normal(size=(12, 8)), 5: rng.normal(size=(3, 5))}
    rows = []
    for i in range(1500):
        w = 8 if i % 3 else 5
        v = centres[w][i % len(centres[w])] + 0.02 * rng.normal(size=w)
        rows.append((f"v{i % 7}", i, "s", [float(x) for x in v]))
    rows += [("z", 9000, "s", [0.0] * 8), ("z", 9001, "s", rows[1][3]), ("z", 9002, "s", None)]
    vectors = spark.createDataFrame(rows, "video_id string, chunk_id long, sampler_id string, vector array<double>")
    asked = [(k, [float(x) for x in centres[8][k % 12]]) for k in (1, 2, 4, 5, 7, 8)]  # centres that have vectors
    queries = spark.createDataFrame(asked + [(50, [1.0, 0.0, 0.0, 0.0, 0.0])], "q long, vector array<double>")
    index = ix.VectorIndex.build(vectors, pivots=12)
    for k in (3, 200):
        got, reading = index.top(queries, k)
        columns = ["q", *se.KEY, "sim", "dense_rank"]
        want = []
        for width in (8, 5):
            mine = vectors.filter(F.size("vector") == width)
            want += plain(se.dense_top(mine, queries.filter(F.size("vector") == width), k).select(*columns).collect())
        assert plain(got.select(*columns).collect()) == sorted(want)


    near = spark.createDataFrame(asked, "q long, vector array<double>")
    reading = index.top(near, 3)[1].first()
    assert reading.held == 6 * 1002 and reading.read < reading.held / 3


def test_tasks_give_their_best_once(spark):
    rng = np.random.default_rng(4)
    rows = [("v", i, "s", [float(x) for x in rng.normal(size=4)]) for i in range(1000)] + [("w", 1, "s", [1.0, 2.0]), ("w", 2, "s", None)]
    vectors = spark.createDataFrame(rows, "video_id string, chunk_id long, sampler_id string, vector array<double>").coalesce(1)
    queries = spark.createDataFrame([(1, [1.0, 0.0, 0.0, 0.0])], "q long, vector array<double>")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        got = [r.chunk_id for r in se.dense_top(vectors, queries, 10).orderBy("dense_rank").collect()]
        last = se.dense_top(vectors, queries, 1002).orderBy("dense_rank").collect()[-2:]
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    v = np.array([r[3] for r in rows[:1000]])
    assert got == np.argsort(-np.round(v[:, 0] / np.linalg.norm(v, axis=1), 9), kind="stable")[:10].tolist()
    assert [r.sim for r in last] == [-1.0, -1.0]


def test_folds_go_on_to_the_end(spark):
    rows = spark.range(5000).select(F.lit("v").alias("video_id"), F.col("id").alias("pos"), F.lit("x").alias("text"), F.array("id").alias("chunk_ids"))
    out = stats.fold(rows, lambda t: F.lit("y"), size=2)
    sizes = [r.n for r in out.groupBy("layer").agg(F.count(F.lit(1)).alias("n")).orderBy("layer").collect()]
    assert sizes == [5000, 2500, 1250, 625, 313, 157, 79, 40, 20, 10, 5, 3, 2, 1]
    for bad in (1, 0):
        try:
            stats.fold(rows, lambda t: t[0], size=bad)
        except ValueError:
            continue
        raise AssertionError("a fold that cannot end")


def test_odd_answers(spark):
    spec = {"mood": an.Field(one_of=("calm",)), "n": an.Field("number"), "on": an.Field("flag"), "people": an.Field("entries", of=("name", "age"))}
    texts = [
        '{"mood":"calm","n":3,"on":true,"people":[{"name":" Ann ","age":""},{"name":"","age":" "}]}', '{"mood":"odd","n":"x","people":[1,{"name":"B","size":"9"}]}', "[]", "not json", None, "{}",
        '{"mood":null,"people":{"name":"x"},"other":1}',
    ]
    df = spark.createDataFrame([(i, t, " Said. ") for i, t in enumerate(texts)], "i int, a string, s string").withColumn("p", an.parsed(F.col("a"), spec))
    v = F.try_parse_json("a")
    got = df.select(
        an.render(F.col("s"), F.col("p"), spec).alias("text"), an.conformance(F.col("a"), F.col("s"), spec).alias("bad"),
        an.contains(v, {"people": [{"name": " Ann "}], "n": 3}).alias("has"), an.contains(v, {"on": True}).alias("on"),
    ).collect()
    assert got[0].text == "Said.. mood: calm. n: 3. on: True. people: name Ann" and got[0].bad == [] and got[0].has and got[0].on
    assert got[1].bad == ["mood: not one of the values", "n: not number", "on: missing", "people: not all objects", "people.age: missing", "people: unknown keys"]
    assert got[2].bad == got[3].bad == got[4].bad == ["no object"] and got[5].bad == [f"{k}: missing" for k in spec]
    assert got[6].bad == ["mood: not text", "n: missing", "on: missing", "people: not entries", "other: unknown field"]
    assert [r.text for r in got[3:6]] == ["Said."] * 3
    assert an.pick_problems(["*", "summary", "mood.x", "people.size", "hat"], spec) == [("mood.x", "mood has no keys"), ("people.size", "unknown key size of people"), ("hat", "unknown field hat")]


def test_postings_name_units_by_number_and_are_dealt_once(spark):
    kind = "video_id string, chunk_id long, sampler_id string, content string"
    df = spark.createDataFrame(units(random.Random(3), 200), kind)
    index = ix.TextIndex.build(df)
    index.upsert(df.filter("chunk_id < 20").withColumn("content", F.lit("river river stone")), df.filter("chunk_id = 30").select(*se.KEY))
    held = index.table("postings").select("part", "block", F.inline("units"))
    assert set(held.columns) == {"part", "block", "u", "tf"}
    names = index.table("keys")
    assert names.count() == 199 and names.select("part", "block", "u").distinct().count() == 199
    assert held.join(names, ["part", "block", "u"], "left_anti").count() == 0
    plan = ix._rows(ix._numbered(df, 4, 0))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1
