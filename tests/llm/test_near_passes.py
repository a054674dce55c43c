"""How often near duplicates are written and compared: components stop where stars are left, small buckets of all levels are one pass."""

import random

import numpy as np
import pytest

from moments.llm import near


@pytest.fixture
def saves(monkeypatch):
    made, save = [], near.save
    monkeypatch.setattr(near, "save", lambda df, *by: made.append(1) or save(df, *by))
    return made


def test_stars_need_no_step(spark, saves):
    rows = [(i, 0) for i in range(1, 50)] + [(200, 100), (100, 201), (100, 200)]
    got = {r.node: r.label for r in near.components(spark.createDataFrame(rows, "src long, dst long")).collect()}
    assert got == {**{i: 0 for i in range(50)}, 100: 100, 200: 100, 201: 100}
    assert len(saves) == 1


def test_random_graphs(spark):
    rnd = random.Random(3)
    for n, m in ((40, 20), (60, 60), (30, 0)):
        pairs = [(rnd.randrange(n), rnd.randrange(n)) for _ in range(m)]
        a, b = (np.array([p[k] for p in pairs], "int64") for k in (0, 1))
        root = near._forest(a, b, n)
        want = {int(x): int(root[x]) for p in pairs if p[0] != p[1] for x in p}
        got = near.components(spark.createDataFrame(pairs, "src long, dst long")).collect()
        assert len(got) == len(want) and {r.node: r.label for r in got} == want


def test_small_buckets_of_all_levels_are_one_pass(spark, monkeypatch):
    passes, compare = [], near._compare_small
    monkeypatch.setattr(near, "_compare_small", lambda rows, rules: passes.append(1) or compare(rows, rules))
    rnd = random.Random(4)
    base = [f"w{i}" for i in range(60)]
    texts = []
    for i in range(40):
        t = list(base)
        for _ in range(i % 7):
            t[rnd.randrange(len(t))] = f"x{rnd.random()}"
        texts.append(" ".join(t))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.n_links for r in near.near_duplicates(docs, near.NearRules(small=4)).collect()}
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (t.split() for t in texts)]
    # buckets of 4 are too small for these groups to be found whole; what is found is right
    want = {i: sum(j != i and len(s & o) >= 0.8 * len(s | o) for j, o in enumerate(sets)) for i, s in enumerate(sets)}
    assert len(got) == 40 and all(0 <= got[i] <= want[i] for i in want) and sum(got.values()) > 0
    assert len(passes) == 1
