"""Removed bytes against a dictionary of all strings, and the column order against plain sorting."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

from moments.llm import repeats

KIND = "doc_id long, text string, row long, h string, s int"


def expected(rows, length):
    bodies = [(d, (t or "").encode()) for d, t in rows]
    count = Counter(b[i : i + length] for _, b in bodies for i in range(len(b) - length + 1))
    out = []
    for d, b in bodies:
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - length + 1):
            if count[b[i : i + length]] > 1:
                gone[i : i + length] = True
        spans = int(np.sum(np.diff(np.concatenate([[0], gone.astype(int)])) == 1))
        out.append((d, len(b), int(gone.sum()), spans, hashlib.sha256(bytes(np.frombuffer(b, "uint8")[~gone])).hexdigest()))
    return sorted(out, key=str)


def got(spark, rows, **options):
    df = spark.createDataFrame([(*r, 5, "h", 1) for r in rows], KIND).repartition(5)
    return sorted(map(tuple, repeats.removed(df, **options).collect()), key=str)


def prose(rnd, n):
    return "".join(rnd.choice("abcdefgh ü") for _ in range(n))


def near_copies(rnd, n):
    base = prose(rnd, 3000)
    for _ in range(n):
        t = list(base)
        for _ in range(rnd.randint(0, 8)):
            t[rnd.randrange(len(t))] = rnd.choice("xyz")
        cut = rnd.randrange(300)
        yield "".join(t)[cut : len(t) - rnd.randrange(300)]


def corpus(rnd):
    passage = prose(rnd, 700)
    rows = [(i, prose(rnd, rnd.randint(0, 900)) + (passage[rnd.randrange(200) :] if i % 3 == 0 else "") + prose(rnd, 100)) for i in range(60)]
    rows += [(100 + i, t) for i, t in enumerate(near_copies(rnd, 12))]
    rows += [(200, "b" * 2500), (201, "ab" * 300), (202, prose(rnd, 399)), (203, rows[5][1]), (203, rows[5][1]), (None, passage), (None, None), (204, "")]
    rows += [(205, rows[60][1] * 2), (206, "漢字" * 90 + "x"), (207, "漢字" * 90 + "y")]
    return rows


@pytest.mark.parametrize("wide", [repeats.WIDE, 2])
def test_all_strings(spark, wide):
    rows = corpus(random.Random(1))
    assert got(spark, rows, wide=wide) == expected(rows, 400)


def test_short_strings_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(repeats, "BLOCK", 97)
    monkeypatch.setattr(repeats, "CHUNK", 10)
    rnd = random.Random(2)
    rows = [(i, "".join(rnd.choice("ab") for _ in range(rnd.randint(0, 300)))) for i in range(80)]
    assert got(spark, rows, length=12, gram=4) == expected(rows, 12)
    assert got(spark, rows, length=12, gram=4, wide=3) == expected(rows, 12)
    assert got(spark, rows, length=1, gram=1) == expected(rows, 1)


def test_empty_and_hot(spark):
    assert got(spark, []) == []
    assert got(spark, [(None, None)]) == expected([(None, None)], 400)
    rnd = random.Random(3)
    line, long = prose(rnd, 500), prose(rnd, 200_000)
    rows = [(i, f"{rnd.random()} {i}" * 5 + line + f"{rnd.random()}" * 9) for i in range(1500)] + [(9000, long), (9001, long[100_000:] + long[:90_000])]
    assert got(spark, rows, wide=100) == expected(rows, 400) == got(spark, rows)


def test_columns_against_sorting():
    rnd = random.Random(4)
    for _ in range(40):
        parts = [("".join(rnd.choice("ab") for _ in range(rnd.randint(3, 30))).encode(), rnd.randint(0, 2)) for _ in range(rnd.randint(1, 12))]
        length = rnd.randint(2, 8)
        count = Counter((i - a, b[i : i + length]) for b, a in parts for i in range(len(b) - length + 1))
        want = {(k, i) for k, (b, a) in enumerate(parts) for i in range(len(b) - length + 1) if count[i - a, b[i : i + length]] > 1}
        runs = repeats.column_runs(parts, length)
        assert {(k, i) for k, p, q in runs for i in range(p, q + 1)} == want


def test_range_least():
    rnd = np.random.RandomState(5)
    values = rnd.randint(0, 500, 300).astype("uint16")
    first = rnd.randint(0, 300, 900)
    last = np.minimum(299, first + rnd.randint(0, 300, 900))
    assert repeats.range_least(values, first, last).tolist() == [values[a : b + 1].min() for a, b in zip(first, last)]


def expected_words(rows, words):
    bodies = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    strings = [[tuple(b[i : i + words]) for i in range(len(b) - words + 1)] for b in bodies]
    count = Counter(s for own in strings for s in own)
    return [len({k for i, s in enumerate(own) if count[s] > 1 for k in range(i, i + words)}) for own in strings]


def told(spark, rows, **options):
    df = spark.createDataFrame([(*r, 5, "h", 1) for r in rows], KIND).repartition(5)
    got = repeats.removed(df, **options).collect()
    assert sorted((tuple(r)[:5] for r in got), key=str) == expected(rows, options.get("length", 400))
    return sorted(((r.doc_id, r.n_passage_words) for r in got), key=str)


def test_short_passages_of_many_words(spark):
    rnd = random.Random(6)
    words = lambda n: [prose(rnd, rnd.randint(2, 7)).replace(" ", "x") for _ in range(n)]
    passage = words(53)
    assert len(" ".join(passage).encode()) < 400
    rows = [(i, " ".join(words(150) + passage * (i % 4 == 0) + words(90))) for i in range(40)]
    rows += [(50, "\n".join(passage)), (51, "\t ".join(passage[1:51])), (52, " ".join(passage[:49])), (53, None), (54, " \n")]
    assert told(spark, rows, words=repeats.WORDS) == sorted(((i, 53 if i % 4 == 0 or i == 50 else 50) if i in (50, 51) or i < 40 and i % 4 == 0 else (i, 0) for i, _ in rows), key=str)
    rows += [(60, "b" * 399), (60, "b" * 399), (61, " ".join("abcd" for _ in range(80))), (62, " ".join("abcd" for _ in range(80))[:399]), (63, "w" * 3000 + " x" * 70)]
    rows += [(64, rows[0][1]), (64, rows[0][1]), (None, " ".join(passage)), *corpus(rnd)]
    want = sorted(zip([d for d, _ in rows], expected_words(rows, 50)), key=str)
    assert told(spark, rows, words=50) == want == told(spark, rows, words=50, wide=2)


def test_words_over_blocks(spark, monkeypatch):
    for name, value in (("BLOCK", 97), ("FEW", 3), ("CHUNK", 10)):
        monkeypatch.setattr(repeats, name, value)
    rnd = random.Random(7)
    rows = [(i, "".join(rnd.choice(["a", "bc", "é", " ", "\n", "\x0b "]) for _ in range(rnd.randint(0, 300)))) for i in range(60)] + [(99, "a" * 300 + " bc")]
    for words in (1, 4, 12):
        want = sorted(zip([d for d, _ in rows], expected_words(rows, words)), key=str)
        assert told(spark, rows, words=words, length=12, gram=4) == want == told(spark, rows, words=words, length=12, gram=4, wide=3)
