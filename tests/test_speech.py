from moments.operators import speech as s
from moments.operators import stats as st


def turns(spark, *rows):
    return spark.createDataFrame([("v", i, *r) for i, r in enumerate(rows)], "video_id string, seq int, speaker string, start double, end double")


def test_silence_cut(spark):
    got = s.silence_cuts(turns(spark, ("a", 0.0, 1.0), ("a", 2.0, 3.0)), 0.65).collect()
    assert [(r["at"], r.value) for r in got] == [(1.5, 1.0)]
    assert s.silence_cuts(turns(spark, ("a", 0.0, 1.0), ("a", 1.65, 2.0)), 0.65).count() == 0  # 1.65 - 1 is below 0.65


def test_speaker_cuts_treat_nulls_as_one(spark):
    got = s.speaker_cuts(turns(spark, (None, 0.0, 1.0), (None, 2.0, 3.0), ("a", 4.0, 5.0), ("b", 4.5, 6.0))).orderBy("at").collect()
    assert [(r["at"], r.value) for r in got] == [(3.5, 1.0), (4.5, 0.0)]


def test_silent_chunk_keeps_its_row(spark):
    chunks = spark.createDataFrame([("v", 0, 0.0, 10.0), ("v", 1, 10.0, 20.0)], "video_id string, chunk_id long, start_ts double, end_ts double")
    words = spark.createDataFrame([("v", 0, 0, "a", "hi", 1.0, 2.0), ("v", 0, 1, None, "you", 2.0, 3.0)], "video_id string, seq int, n int, speaker string, word string, start double, end double")
    got = {r.chunk_id: (r.text, r.word_count, r.speakers) for r in s.chunk_texts(words, chunks, 10.0).collect()}
    assert got == {0: ("hi you", 2, ["a"]), 1: ("", 0, [])}


def test_sentiment_of_zero_is_positive_and_in_neither_count(spark):
    p = spark.createDataFrame([("v", 0, 1, 0.0), ("v", 1, 1, -0.5), ("v", 2, 1, 0.5)], "video_id string, chunk_id int, weight int, signed double")
    out = st.sentiment(p)
    assert {r.chunk_id: r.label for r in out.collect()} == {0: "positive", 1: "negative", 2: "positive"}
    t = st.sentiment_totals(out).first()
    assert (t.positive_chunks, t.negative_chunks, t.turning_points) == (1, 1, [1, 2])


def test_fold_ends_with_one_row(spark):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([("v", i, f"t{i:02d}", [i]) for i in range(60)], "video_id string, pos long, text string, chunk_ids array<int>")
    out = st.fold(rows, lambda t: F.array_join(t, ""))
    by = {r.layer: r.n for r in out.groupBy("layer").agg(F.count("*").alias("n")).collect()}
    assert by == {0: 60, 1: 3, 2: 1}
    last = out.filter("layer = 2").first()
    assert last.text == "".join(f"t{i:02d}" for i in range(60)) and last.chunk_ids == list(range(60))
