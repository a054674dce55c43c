"""Wrapper induction: matching against an exhaustive one, tags with odd quotes, and hosts with known articles."""

import random

import numpy as np

from moments.llm import wrapper


def tree(rnd, depth):
    node = wrapper.Node(rnd.choice("abc"))
    if depth:
        node.kids = [tree(rnd, depth - 1) for _ in range(rnd.randint(0, 3))]
    return node


def exhaustive(x, y):
    """Nodes of the best matching, by trying every order-keeping pairing of the children."""
    if x.tag != y.tag:
        return 0

    def below(a, b):
        if not a or not b:
            return 0
        return max(below(a[1:], b), below(a, b[1:]), exhaustive(a[0], b[0]) + below(a[1:], b[1:]))

    return 1 + below(x.kids, y.kids)


def test_matching_is_the_best_one():
    rnd = random.Random(3)
    for _ in range(150):
        m = wrapper.Matcher()
        a, b = m.shape(tree(rnd, 3)), m.shape(tree(rnd, 3))
        assert m.score(a.shape, b.shape) == exhaustive(a, b)
        found = m.match(a, b) if a.tag == b.tag else {}
        assert len(found) == exhaustive(a, b)
        nodes = {id(x): x for x in wrapper._in_order(a)}
        assert all(nodes[k].tag == v.tag for k, v in found.items()) and len({id(v) for v in found.values()}) == len(found)


def test_long_lists_by_halves_score_the_same():
    rng = np.random.default_rng(5)
    for _ in range(30):
        a, b = rng.integers(0, 4, rng.integers(1, 40)), rng.integers(0, 5, rng.integers(1, 40))
        s = rng.integers(0, 6, (4, 5))
        whole, halves = wrapper._aligned(a, b, s), wrapper._aligned(a, b, s, cells=8)
        for pairs in (whole, halves):
            assert all(i < k and j < n for (i, j), (k, n) in zip(pairs, pairs[1:]))
        assert sum(s[a[i], b[j]] for i, j in whole) == sum(s[a[i], b[j]] for i, j in halves) == wrapper._last_row(a, b, s)[-1]


def said(spark, pages):
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    return {r.page_id: r.text for r in wrapper.main_text(df).collect()}


def test_names_inside_an_article_and_odd_quotes(spark):
    article = """<article><div class="post-header"><h1>The heading</h1></div><p class="side">A side remark.</p><div class="search-results-study">
      <p>Results of a study.</p></div><p data-x='a">Lost text</p><p title="a > b">Last &amp; least.</p><div class="comments"><p>I agree</p></div>
      <div class="ad">Buy now {}</div><section role="complementary">beside</section></article>"""
    expected = "The heading\nA side remark.\nResults of a study.\nLost text\nLast & least."
    pages = [(i, "http://h.example/x", f"<body><div class='top-banner'>Hello</div>{article.format(i)}<div id=comments><p>no</p></div></body>") for i in range(2)]
    deep = "<html><body><article>" + "<div>" * 1500 + "deep text" + "</div>" * 1500 + "</article></body></html>"
    pages += [(10, "http://deep.example/1", deep), (11, "http://deep.example/2", deep.replace("<div>", "<div><i></i>", 1))]
    pages += [(20, "http://q.example/", "<p>one <b>two</b> 1 < 2 <br/ >three<p class=\"x>four"), (21, "http://q.example/", '<p class="a>b">five</p')]
    assert said(spark, pages) == {0: expected, 1: expected, 10: "deep text", 11: "deep text", 20: "one two 1 < 2\nthree\nfour", 21: "five"}


def test_hosts_with_known_articles(spark):
    """Two layouts on a host, a stub as the least page, a long disclaimer, a small host, and near copies that are no template."""
    rnd = random.Random(6)
    words = lambda n: " ".join(rnd.choice("sun moon star cloud rain wind snow leaf tree root stone river".split()) + str(rnd.randrange(99)) for _ in range(n))
    disclaimer = "All views are those of the writer and of nobody else. " * 8
    pages, expected = [], {}

    def add(url, html, text):
        expected[len(pages)] = text
        pages.append((len(pages), url, html))

    add("http://two.example/stub", "<html><body>gone</body></html>", "gone")
    for i in range(14):
        story, more = words(60), words(20)
        if i % 2:
            html = f"<html><body><div class='wrap'><p>Daily letter of the town</p><div class='text'><p>{story}</p><p>{more}</p></div><p>{disclaimer}</p></div></body></html>"
        else:
            html = f"<html><body><section><article><h2>Opinion</h2><p>{story}</p><p>{more}</p></article></section><section>Other</section></body></html>"
        add(f"http://two.example/{i}", html, f"{story}\n{more}")
    for i in range(3):
        story = words(50)
        add(f"http://small.example/{i}", f"<body><div><p>Read on paper too</p><p>{story}</p></div></body>", story)
    copy = [words(40) for _ in range(5)]
    for i in range(6):
        paras = [f"{p} {i}" if k == 2 else p for k, p in enumerate(copy)]
        add(f"http://copies.example/{i}", "<body><article>" + "".join(f"<p>{p}</p>" for p in paras) + "</article></body>", "\n".join(paras))
    got = said(spark, pages)
    assert got == expected
    few = wrapper.WrapperRules(broadcast_bytes=1, salt_pages=3)  # every join by shuffle, the large host under salts
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    assert {r.page_id: r.text for r in wrapper.main_text(df, few).collect()} == expected


def test_alignment_alone_takes_what_is_constant(spark):
    rnd = random.Random(8)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(6))
    page = lambda body: f"<html><body><nav><a>Home</a><a>News</a></nav><div><p>Sign up to our letter today</p></div><article><p>{body}</p><p>All rights are kept</p></article></body></html>"
    bodies = [" ".join(word() for _ in range(60)) for _ in range(8)]
    df = spark.createDataFrame([(i, f"https://one.example/{i}", page(b)) for i, b in enumerate(bodies)], "page_id long, url string, html string")
    rows = {r.page_id: r for r in wrapper.main_text(df, wrapper.WrapperRules(named=False)).collect()}
    assert [rows[i].text for i in range(8)] == bodies and all(r.n_aligned > 40 for r in rows.values())
    assert [r.text for r in wrapper.main_text(df).orderBy("page_id").collect()] == bodies


def test_odd_pages(spark):
    """Nulls in every column, repeated rows, an empty table, and columns named like the operator's own."""
    page = "<body><article><p>Some text</p></article></body>"
    rows = [(1, "http://a.example/", page), (1, "http://a.example/", page), (2, None, page), (3, "http://a.example/x", None), (4, "not a url", ""), (None, None, None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    want = [(None, None, ""), (1, "http://a.example/", "Some text"), (1, "http://a.example/", "Some text"), (2, None, "Some text"), (3, "http://a.example/x", ""), (4, "not a url", "")]
    order = lambda out: sorted(((r.page_id, r.url, r.text) for r in out.collect()), key=str)
    assert order(wrapper.main_text(df)) == sorted(want, key=str)
    assert wrapper.main_text(df.limit(0)).collect() == []
    clash = df.selectExpr("*", "'x' AS host", "1 AS layout", "2 AS pieces", "3 AS text", "4 AS ref", "5 AS nodes", "6 AS n_aligned")
    assert order(wrapper.main_text(clash)) == sorted(want, key=str)
