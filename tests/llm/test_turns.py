"""Conversations against a search over all edits, in plain Python."""

import hashlib
import heapq
import random
import re
import zlib

from moments.llm import turns

KIND = "conv_id long, turn long, role string, text string, copy string, state int"
ORDER = re.compile(r"(s?(ua)+)?")
BODY = " \t\n\x0b\x0c\r"


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        luck = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if luck == 1 else re.sub("[.!?]", "", text) if luck == 2 else text
        role = "user" if luck == 4 else role
        out += [(conv, turn, role, text)] * (0 if luck == 0 else 2 if luck == 3 else 1)
    return out


def cheapest(rows, faults):
    """Cheapest first, then least audit, over whole edit strings: no state is shared between different strings."""
    start = (0, "", 0, "", ())
    heap, done = [start], set()
    while heap:
        cost, audit, i, initials, kept = heapq.heappop(heap)
        if i == len(rows) and ORDER.fullmatch(initials):
            return cost, audit, "\n".join(kept)
        if (i, initials[-1:], len(initials) > 0) in done:
            continue
        done.add((i, initials[-1:], len(initials) > 0))
        for role in ("user", "assistant"):
            heapq.heappush(heap, (cost + 5, audit + "I", i, initials + role[0], (*kept, role + ":")))
        if i < len(rows):
            role, text = rows[i]
            late = 5 if faults[i] == "truncated" else 0
            heapq.heappush(heap, (cost + 2, audit + "D", i + 1, initials, kept))
            if faults[i] not in ("blank", "duplicate"):
                heapq.heappush(heap, (cost + late, audit + "K", i + 1, initials + role[:1], (*kept, f"{role}:{text}")))
                for to in ("user", "assistant"):
                    heapq.heappush(heap, (cost + late + 1, audit + "R", i + 1, initials + to[0], (*kept, f"{to}:{text}")))
        heap = [x for x in heap if re.fullmatch(r"(s?(ua)*u?)?", x[3])]
        heapq.heapify(heap)


def expected(rows):
    out = []
    for conv in {r[0] for r in rows}:
        mine = sorted((r for r in damage(rows) if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), r[3].encode()))
        seen, faults = set(), []
        for _, _, role, text in mine:
            body = text.strip(BODY)
            fault = "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else ""
            faults.append(fault)
            seen.add((role, text))
        ts = [r[1] for r in mine if r[1] is not None]
        pairs = [a[2][:1] + b[2][:1] for a, b in zip(mine, mine[1:])]
        cost, audit, text = cheapest([r[2:] for r in mine], faults)
        count = [faults.count(k) for k in ("blank", "duplicate", "truncated")]
        gaps = max(ts) - min(ts) + 1 - len(set(ts)) if ts else 0
        out.append((conv, gaps, *count, sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=str)


NAMES = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def got(spark, rows, **options):
    df = turns.repaired(spark.createDataFrame([(*r, "c", 7) for r in rows], KIND), **options)
    return sorted((tuple(r[c] for c in NAMES) for r in df.collect()), key=str)


def made(rnd, conv, n):
    roles = ["user", "assistant", "user", "assistant", "system", "tool", None, ""]
    texts = ["Yes.", "No!", "cut off", "", " \n", None, "Why?", "ünï. ", "a.\t", "b"]
    return [(conv, rnd.choice([None, *range(n), k]), rnd.choice(roles), rnd.choice(texts) if rnd.random() < 0.5 else f"{k}.") for k in range(n)]


def test_small_conversations(spark):
    rnd = random.Random(1)
    rows = [r for conv in range(150) for r in made(rnd, conv, rnd.randint(1, 9))]
    assert got(spark, rows) == expected(rows)


def test_long_conversations_leave_in_blocks(spark):
    rnd = random.Random(2)
    rows = [r for conv in (1, None, -3) for r in made(rnd, conv, 40)] + made(rnd, 9, 6)
    want = expected(rows)
    assert got(spark, rows, spill_rows=4) == want
    assert got(spark, rows, spill_rows=1) == want
    assert got(spark, rows) == want


def test_odd_rows(spark):
    gone = next(c for c in range(99) if all(zlib.crc32(f"{c}:{t}".encode()) % 20 == 0 for t in (0,)))
    rows = [(gone, 0, "user", "lost."), (500, None, None, None), (501, None, "user", "x."), (502, 3, "user", "same."), (502, 3, "user", "same.")]
    rows += [(503, 0, "user", "word " * 200_000 + "end."), (503, 1, "assistant", "ok.")]
    out = got(spark, rows)
    assert out == expected(rows)
    assert (gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) in out
    assert got(spark, []) == []
