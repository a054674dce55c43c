"""Near duplicates, leaks, mixing, sharding, pages and language-model scores against brute force."""

import math
import random
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from moments.llm import decontam, maxent, mixing, near, sharding, wrapper


def noisy(rnd, words, edits):
    w = list(words)
    for _ in range(edits):
        w[rnd.randrange(len(w))] = f"x{rnd.randrange(9999)}"
    return " ".join(w)


@pytest.fixture(scope="module")
def copies(spark):
    rnd = random.Random(3)
    rows = []
    for b in range(6):
        base = [f"b{b}w{rnd.randrange(300)}" for _ in range(120)]
        rows += [(b * 100 + i, noisy(rnd, base, rnd.randrange(0, 5))) for i in range(30)]
    rows += [(i, " ".join(f"u{rnd.randrange(5000)}" for _ in range(60))) for i in range(1000, 1060)]
    rows += [(2000, ""), (2001, None), (2002, "a b"), (2003, "A  b"), (2004, "a b c"), (None, "hello there my dear old friend"), (2005, "hello there my dear old friend"), (1000, rows[200][1]), (7, rows[7][1])]
    return rows


def shingles(t):
    w = (t or "").encode().lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute_near(rows):
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    links = [set() for _ in rows]
    for i, s in enumerate(sets):
        for j in range(i):
            same = s == sets[j] if not s or not sets[j] else len(s & sets[j]) / len(s | sets[j]) >= 0.8
            if same:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
                if s and rows[i][1] != rows[j][1]:
                    links[i].add(rows[j][1])
                    links[j].add(rows[i][1])
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(find(i), []).append(i)
    out = Counter()
    for g in groups.values():
        ids = [rows[i][0] for i in g if rows[i][0] is not None]
        for i in g:
            out[(rows[i][0], min(ids) if ids else None, len(links[i]))] += 1
    return out, len(groups)


@pytest.mark.parametrize("block,small,tile", [(512, 128, 32), (16, 8, 32), (1, 8, 4)])
def test_near_duplicates(spark, copies, block, small, tile):
    df = spark.createDataFrame(copies, "doc_id long, text string")
    rules = near.NearRules(block=block, small=small, tile=tile)
    expected, n = brute_near(copies)
    got = Counter((r.doc_id, r.class_id, r.n_links) for r in near.near_duplicates(df, rules).collect())
    assert got == expected
    assert near.one_of_each(df, rules).count() == n


def test_components_of_paths_and_failure_to_converge(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 102), (102, 100)]
    df = spark.createDataFrame(edges, "src long, dst long")
    assert {r.node: r.label for r in near.components(df).collect()} == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 102: 100}
    with pytest.raises(RuntimeError):
        near.components(df, most=2)


def test_recall_of_links_of_every_fiftieth_document(spark):
    """Documents of ids divisible by 50 against all rows, by brute force over the sets."""
    rnd = random.Random(21)
    rows = []
    for b in range(60):
        base = [f"b{b}w{rnd.randrange(4000)}" for _ in range(rnd.randrange(60, 300))]
        rows += [(50 * b + i, noisy(rnd, base, rnd.randrange(0, 1 + len(base) // 45))) for i in range(12)]
    sets = [shingles(t) for _, t in rows]
    expected = {d: sum(1 for t in {rows[j][1] for j in range(len(rows)) if rows[j][1] != rows[i][1] and len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.8}) for i, (d, _) in enumerate(rows) if d % 50 == 0}
    got = {r.doc_id: r.n_links for r in near.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).filter("doc_id % 50 = 0").collect()}
    assert sum(expected.values()) > 150
    assert sum(min(got[d], expected[d]) for d in expected) >= 0.99 * sum(expected.values()) and all(got[d] <= expected[d] for d in expected)


def test_near_duplicates_of_very_long_texts(spark):
    rnd = random.Random(31)
    base = [f"w{rnd.randrange(10**6)}" for _ in range(150_000)]
    rows = [(1, " ".join(base)), (2, noisy(rnd, base, 500)), (3, noisy(rnd, base, 60_000)), (4, " ".join(base[::-1])), (5, "short text")]
    got = {(r.doc_id, r.class_id, r.n_links) for r in near.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(1, 1, 1), (2, 1, 1), (3, 3, 0), (4, 4, 0), (5, 5, 0)}


def test_near_duplicates_of_nothing(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert near.near_duplicates(df).count() == 0


def edit_distance(p, t):
    row = [0] * (len(t) + 1)
    for i, c in enumerate(p, 1):
        new = [i] + [0] * len(t)
        for j, x in enumerate(t, 1):
            new[j] = min(row[j - 1] + (c != x), row[j] + 1, new[j - 1] + 1)
        row = new
    return min(row)


@pytest.mark.parametrize("slice_chars", [1_000_000, 150])
def test_leaks_match_the_edit_distance(spark, slice_chars):
    rnd = random.Random(1)
    rules = decontam.LeakRules(slice_chars=slice_chars, block_chars=200)
    rand = lambda n: "".join(rnd.choice("abcdef") for _ in range(n))
    items = [(i, rand(rnd.randint(40, 110))) for i in range(6)] + [(6, None), (7, ""), (8, "too short")]
    docs = [(900, None), (901, ""), (902, items[0][1][:20])]
    for d in range(50):
        p = list(rnd.choice(items[:6])[1])
        for _ in range(rnd.randint(0, int(len(p) * 0.13))):
            at = rnd.randrange(len(p))
            k = rnd.randint(0, 2)
            if k == 0:
                p[at] = rnd.choice("abcdef")
            elif k == 1:
                del p[at]
            else:
                p.insert(at, rnd.choice("abcdef"))
        docs.append((d, rand(rnd.randint(0, 200)) + "".join(p).upper() + rand(rnd.randint(0, 90))))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontam.leaks(df, bench, rules).collect()}
    expected = {
        (d, i) for d, t in docs for i, p in items
        if p and len(p) >= rules.min_chars and edit_distance(p, (t or "").lower()) <= int(len(p) * rules.rate)
    }
    assert got == expected
    assert {r.doc_id for r in decontam.drop_leaks(df, bench, rules).collect()} == {d for d, _ in docs} - {d for d, _ in expected}
    assert decontam.leaks(df, bench.limit(0), rules).count() == 0


def brute_targets(sizes):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target, capped, left = {}, set(), 1.5 * sum(sizes.values())
    while True:
        rest = [s for s in names if s not in capped]
        share = left - sum(2 * sizes[s] for s in capped)
        target = {s: 2.0 * sizes[s] if s in capped else share * weight[s] / sum(weight[x] for x in rest) for s in names}
        over = {s for s in rest if target[s] > 2 * sizes[s]}
        if not over:
            return target
        capped |= over


def test_mixing(spark):
    rnd = random.Random(5)
    rows = [(i, "w " * rnd.randint(0, 400), rnd.choice(["s1", "s2", "s3", "s4", None, "big", "big", "big"])) for i in range(600)]
    rows += [(601, None, "s1"), (3, rows[3][1], rows[3][2])]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = mixing.mix(df, shard_words=5000).collect()
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len((t or "").split())
    expected = brute_targets(sizes)
    taken = Counter()
    for r in out:
        name = None if r.no_source else r.name
        assert r.source_size == sizes[name] and math.isclose(r.target, expected[name], rel_tol=1e-9)
        assert 0 <= r.taken <= 2 * r.size
        taken[name] += r.taken
    for s in sizes:
        assert abs(taken[s] - expected[s]) <= 0.02 * expected[s] + 200
    again = mixing.mix(df.repartition(7), shard_words=5000).collect()
    pick = lambda rows: Counter((r.doc_id, r.size, r.taken) for r in rows)
    assert pick(out) == pick(again)
    assert mixing.mix(df.limit(0)).count() == 0
    assert mixing.mixed_documents(df, shard_words=5000).columns == df.columns


def test_apportion_is_sainte_lague(spark):
    rnd = random.Random(2)
    rows, expected = [], {}
    for g in range(12):
        votes = [rnd.randint(0, 1000) for _ in range(rnd.randint(1, 9))]
        seats = rnd.randint(0, 60)
        won = [0] * len(votes)
        for _ in range(seats if sum(votes) else 0):
            won[max(range(len(votes)), key=lambda i: (votes[i] / (2 * won[i] + 1), -i))] += 1
        rows += [(g, i, v, seats) for i, v in enumerate(votes)]
        expected.update({(g, i): w for i, w in enumerate(won)})
    df = spark.createDataFrame(rows, "g int, i int, votes long, seats long")
    got = {(r.g, r.i): r.out for r in mixing.apportion(df, ["g"], "votes", "seats", ["i"], "out").collect()}
    assert got == expected


def test_sharding(spark):
    rnd = random.Random(9)
    texts = ["copy of a text " * 20] * 900 + ["t" * rnd.randint(0, 900) + str(i) for i in range(2000)] + [None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").unionByName(spark.createDataFrame([(5, texts[5])], "doc_id long, text string"))
    out = sharding.assign_shards(df).collect()
    slots, size = {}, Counter()
    for r in out:
        slots.setdefault(r.shard, []).append(r.slot)
        size[r.shard] += r.size
    assert set(slots) == set(range(40)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    mean = sum(size.values()) / 40
    assert all(abs(s - mean) < 0.12 * mean for s in size.values())
    for r in out:
        t = (texts[r.doc_id] or "").encode()
        assert r.size == len(t) + 16 and r.text_crc32 == zlib.crc32(t)
    placed = sharding.sharded_documents(df.withColumn("shard", F.lit("mine")))
    assert placed.count() == df.count() and placed.select("shard", "slot").distinct().count() == df.count()
    assert sharding.assign_shards(df.limit(0)).count() == 0


def test_sharding_of_one_repeated_row_and_of_null_ids(spark):
    for doc_id in (None, 7):
        df = spark.range(3000, numPartitions=5).select(F.lit(doc_id).cast("long").alias("doc_id"), F.lit("the same text again").alias("text"))
        out = sharding.assign_shards(df).groupBy("shard").agg(F.count(F.lit(1)).alias("n"), F.max("slot").alias("last")).collect()
        assert len(out) == 40 and all(r.last == r.n - 1 and 55 < r.n < 95 for r in out)
    long = spark.createDataFrame([(1, "x" * 3_000_000), (2, "short"), (3, None)], "doc_id long, text string")
    got = sharding.assign_shards(long).collect()
    assert sorted((r.doc_id, r["size"]) for r in got) == [(1, 3_000_016), (2, 21), (3, 16)] and all(r.slot >= 0 for r in got)


def test_ranks_without_one_task_for_a_group(spark):
    df = spark.range(2000).select((F.col("id") % 3 == 0).cast("int").alias("g"), (F.col("id") * 7919 % 50).alias("v"), "id")
    got = mixing.ranked(df.repartition(9), ["g"], [F.col("v").desc(), F.col("id")], "r").collect()
    for g in (0, 1):
        mine = sorted((r for r in got if r.g == g), key=lambda r: (-r.v, r.id))
        assert [r.r for r in mine] == list(range(1, len(mine) + 1))


def test_main_text(spark):
    page = """<html><head><title>t</title><style>x</style></head><body><header>Top</header><div id="cookie-banner">We use cookies</div><nav><a>Home</a></nav>
<main><h1>T &amp; t&nbsp;x</h1><p>One <b>two</b>
 three<p>Four<ul><li>a<li>b</ul><aside>side</aside><form>f</form><div class="comments"><p>hi</p></div><script>if (a<b) {}</script></main><footer>f</footer></body></html>"""
    rows = [(1, "http://a.b/c", page), (2, None, None), (3, "http://a.b/d", ""), (4, "x", "just < text"), (1, "http://a.b/c", page), (5, "http://deep/", "<div>" * 3000 + "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = Counter((r.page_id, r.text) for r in wrapper.main_text(df).collect())
    assert got == Counter({(1, "T & t x\nOne two three\nFour\na\nb"): 2, (2, ""): 1, (3, ""): 1, (4, "just < text"): 1, (5, "x"): 1})
    assert wrapper.main_text(df.limit(0)).count() == 0


def test_constant_text_of_a_host_is_template(spark):
    rows = []
    for i in range(12):
        body = f"<div><p>Read our daily letter</p><p>Story {i} of this site with its own words number {i * i}</p></div>"
        rows.append((i, f"http://host.example/{i}", f"<html><body>{body}</body></html>"))
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    for r in wrapper.main_text(df).collect():
        assert r.text == f"Story {r.page_id} of this site with its own words number {r.page_id ** 2}"


@pytest.mark.parametrize("frequent", [4, 1000])
def test_language_model(spark, frequent):
    rnd = random.Random(4)
    follow = {w: [f"{w}{k}" for k in "xy"] for w in "abcdefgh"}
    rows = []
    for i in range(400):
        words = []
        for _ in range(60):
            w = rnd.choice("abcdefgh")
            words += [w, rnd.choice(follow[w])]
        rows.append((i, " ".join(words).title() if i % 2 else " ".join(words)))
    rows += [(None, "a b"), (900, None), (901, ""), (902, "never seen words"), (7, rows[7][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = maxent.score(df, maxent.MaxentRules(frequent=frequent)).collect()
    tokens = lambda t: (t or "").encode().lower().split() + [None]
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1
    c = Counter(x for i, t in rows if not held(i) for x in tokens(t))
    n, v = sum(c.values()), len(c)
    by = {i: t for i, t in rows}
    assert len(out) == len(rows)
    for r in out:
        t = tokens(by[r.doc_id])
        base = sum(math.log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in t)
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held(r.doc_id), len(t), sum(c[x] > 0 for x in t), n)
        assert math.isclose(r.base_score, base, rel_tol=1e-9)
    away = [r for r in out if r.held_out and r.n_tokens > 50]
    assert sum(r.score for r in away) > sum(r.base_score for r in away)  # the history helps on texts it has not seen


def test_language_model_probabilities_add_up_to_one(spark):
    import numpy as np

    rnd = random.Random(5)
    words = [f"w{i}{e}" for i in range(60) for e in ("ing", "ed", "s")]
    rows = [(i, " ".join(rnd.choice(words[:20] if rnd.random() < 0.7 else words) for _ in range(30))) for i in range(120)]
    rules = maxent.MaxentRules(frequent=100, own_forms=40, rounds=5)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    counts = maxent.word_counts(df, rules)
    f = maxent.fit(df, counts, rules)
    known = counts.toPandas()
    hashes = known["word"].to_numpy("int64").view("uint64")
    rank = maxent._Ranks(f.words).of(hashes)
    c = f.classes[maxent._form(rank, known["ending"].to_numpy(), rules)]
    inside = np.zeros(rules.classes)
    np.add.at(inside, c, 10 ** (np.log10(known["c"].to_numpy() - f.discount) - f.log_mass[c]))
    inside[1:] += 10 ** (f.log_unseen[1:] - f.log_mass[1:])
    assert np.allclose(inside, 1, atol=1e-9)
    table = 10 ** f.model.log_table().reshape(-1, rules.classes).astype("float64")
    assert np.abs(table @ inside - 1).max() < 1e-5  # a history's table is kept in single precision
    assert 0 < len(f.words) <= 100 and (c[hashes == maxent.END] == 0).all() and (c == 0).sum() == 1


def test_language_model_of_nothing_and_of_long_texts(spark):
    rules = maxent.MaxentRules(rounds=2)
    none = spark.createDataFrame([], "doc_id long, text string")
    assert maxent.score(none, rules).count() == 0
    only = next(i for i in range(99) if zlib.crc32(str(i).encode()) % 5 == 1)
    alone = maxent.score(spark.createDataFrame([(only, "a b")], "doc_id long, text string"), rules).first()
    assert (alone.n_tokens, alone.n_known, alone.train_tokens) == (3, 0, 0) and alone.score <= 0
    long = spark.createDataFrame([(0, "word " * 400_000), (only, "word other " * 200_000)], "doc_id long, text string")
    assert {r.doc_id: r.n_tokens for r in maxent.score(long, rules).collect()} == {0: 400_001, only: 400_001}


def test_stages_hand_on_documents(spark):
    import corpus_pipeline

    rnd = random.Random(8)
    common = "the of and to in a is that for it on was with as be by".split()
    prose = lambda k: " ".join(rnd.choice(common) if rnd.random() < 0.5 else f"{rnd.choice('abcdefgh')}{rnd.choice(['lor', 'min', 'tas'])}{k}{rnd.randrange(90)}" for _ in range(140))
    rows = [(i, prose(i), "en", f"s{i % 4}", 1) for i in range(80)]
    rows += [(100, rows[0][1], "en", "s0", 1), (101, "tiny", "en", "s1", 1), (102, None, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES[:2]:
        df = stage(spark, df, "")
        assert df.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert {r.doc_id for r in df.collect()} == set(range(80))
