"""The manifest against a plain tree in Python: several passes, odd rows, hot sources, and layouts of every small height."""

import hashlib
import zlib

import pytest

from moments.llm import merkle

KIND = "doc_id long, text string, lang string, source string, n_chars long, place string, digest string, n int"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(r, text):
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (r[0], r[3], r[2], r[4], text)])


def tree(digests):
    """Root, and for each leaf its siblings by level as (left, right)."""
    steps, at, row = [[] for _ in digests], list(range(len(digests))), digests
    while len(row) > 1:
        for k, i in enumerate(at):
            first = i - i % 3
            steps[k].append(("".join(row[first:i]), "".join(row[i + 1 : first + 3])))
        at, row = [i // 3 for i in at], [h(*row[i : i + 3]) for i in range(0, len(row), 3)]
    return row[0], steps


def expected(rows):
    out, groups = [], {}
    for r in rows:
        even = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0
        seen = r[1].replace("\n", "") if even and r[1] is not None else r[1]
        groups.setdefault(r[3], []).append((r[0] is not None, r[0] or 0, leaf(r, r[1]), leaf(r, seen), r[0]))
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    inner = {s: tree([x[2] for x in sorted(groups[s], key=lambda x: x[:3])]) for s in order}
    root, outer = tree([inner[s][0] for s in order]) if order else (None, [])
    for s, above in zip(order, outer):
        for x, steps in zip(sorted(groups[s], key=lambda x: x[:3]), inner[s][1]):
            cur = x[3]
            for a, b in steps + above:
                cur = h(a, cur, b)
            out.append((x[4], x[2], inner[s][0], root, h(*[a + b for a, b in steps + above]), cur, cur == root))
    return sorted(out, key=str)


def got(spark, rows):
    return sorted(map(tuple, merkle.verified(spark.createDataFrame([(*r, "p", "d", 1) for r in rows], KIND)).collect()), key=str)


def test_layout_of_every_height():
    for height in range(1, 8):
        at = {merkle.address(height, d, p) for d in range(height) for p in range(3**d)}
        assert at == set(range(merkle.size_of(height)))
    assert merkle.address(4, 2, 5) == merkle.size_of(2) + 5 * merkle.size_of(2)  # the lower trees follow each other whole


@pytest.mark.parametrize("n", [1, 2, 3, 4, 9, 10, 100, 729])
def test_a_block_and_its_siblings(n):
    digests = [h(str(i)) for i in range(n)]
    levels = merkle.levels_of(n)
    root, nodes = merkle.lay_out(digests, levels)
    want, steps = tree(digests)
    assert root == want
    assert [[(s["left"], s["right"]) for s in merkle.siblings(nodes, n, levels, i)] for i in range(n)] == steps


def test_odd_rows(spark):
    rows = [
        (1, "a\nb", "en", "x", 3), (2, "a\nb", "en", "x", 3), (None, None, None, None, None), (None, "t\n", "en", "x", 2), (4, "", "de", "", 0),
        (5, "\n\n", None, "ü", 2), (6, "ünï\n", "en", "x", None), (7, "long " * 200_000 + "\nend", "en", "x", 9), (2, "other", "en", "x", 5),
        (9, "same", "en", "z", 4), (9, "same", "en", "z", 4), (-3, "neg\native", "en", "x", 1),
    ]
    assert got(spark, rows) == expected(rows)
    assert got(spark, rows[:1]) == expected(rows[:1])
    assert got(spark, []) == []


def test_a_source_of_several_blocks_and_many_sources(spark, monkeypatch):
    monkeypatch.setattr(merkle, "LEVELS", 2)
    monkeypatch.setattr(merkle, "WIDE", 9)
    rows = [(i, f"text\n{i}", "en", "hot" if i % 3 else f"s{i % 37}", i) for i in range(900)]
    assert got(spark, rows) == expected(rows)


def test_blocks_as_they_are(spark):
    rows = [(i, f"text\n{i}", "en", "hot", i) for i in range(1500)]
    assert got(spark, rows) == expected(rows)
