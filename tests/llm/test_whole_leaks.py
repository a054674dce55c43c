"""Leaks that are short, partial or repeated."""

import random

from moments.llm import decontam


def places(spark, docs, items, rules=decontam.LeakRules()):
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    return sorted((r.doc_id, r.item_id, r.start, r.end, r.edits) for r in decontam.leaks(df, bench, rules).collect())


def test_short_items_match_on_word_bounds(spark):
    items = ["Who wrote Ivanhoe?", "Why so?", "日本の首都はどこ", "Name the largest moon of Saturn.", "a"]
    docs = [
        "Quiz: who wrote Ivanhoe? Nobody knew.", "he who wrote ivanhoes", "anyhow, why so", "whysoever it is", "問題。日本の首都はどこですか",
        "Please name the largest mon of Saturn!", "Surname the largest moon of Saturnia", "is it a?", None, "", "who wrote Ivanho",
    ]
    assert places(spark, docs, items) == [
        (0, 0, 4, 19, 0), (1, 0, 2, 18, 1), (2, 1, 6, 11, 0), (4, 2, 2, 10, 0), (5, 3, 6, 31, 1), (7, 4, 4, 5, 0), (10, 0, 0, 14, 1),
    ]


def test_parts_of_long_items_and_every_copy(spark):
    rnd = random.Random(12)
    rand = lambda n: "".join(rnd.choice("abcdefghij") for _ in range(n))
    item, short = rand(600), rand(60)
    half = item[150:450]
    docs = [rand(90) + half + rand(70), rand(50) + item[:100] + rand(30), rand(10) + short + rand(40) + short + rand(5) + short, item + rand(300) + item, rand(60) + item[:159] + rand(10)]
    for slice_chars in (1_000_000, 150):
        got = places(spark, docs, [item, short], decontam.LeakRules(slice_chars=slice_chars))
        by = {d: [x[1:] for x in got if x[0] == d] for d in range(5)}
        assert by[0] and all(i == 0 and 90 <= a and b <= 390 and b - a == 120 for i, a, b, e in by[0] if e == 0)
        assert any(e == 0 for *_, e in by[0]) and not by[1]
        assert by[2] == [(1, 10, 70, 0), (1, 110, 170, 0), (1, 175, 235, 0)]
        assert by[3] == [(0, 0, 600, 0), (0, 900, 1500, 0)]
        assert any(i == 0 for i, *_ in by[4])
        for regions in by.values():
            regions = sorted((i, a, b) for i, a, b, _ in regions)
            assert all(x[0] != y[0] or x[2] <= y[1] for x, y in zip(regions, regions[1:]))
