"""Pseudonyms and shards against plain versions in Python."""

import hashlib
import random
import re
import zlib
from datetime import date, timedelta

from moments.llm import pii, sharding

KEY = "a key of the tests"
DIGITS, LOW, UP = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def feistel(left, right, a, b, tweak):
    for i in range(8):
        said = hashlib.sha256(f"{KEY}|{tweak}|{i}|{left if i % 2 else right}".encode()).hexdigest()
        n = int(said[:15], 16)
        left, right = (left, (right + n) % b) if i % 2 else ((left + n) % a, right)
    return left, right


def own_sets(chars):
    return [DIGITS if c in DIGITS else LOW if c in LOW else UP for c in chars]


def spelled(n, sets):
    out = ""
    for s in reversed(sets):
        n, k = divmod(n, len(s))
        out = s[k] + out
    return out


def permuted(chars, sets, tweak):
    out = ""
    for at in range(0, len(chars), 20):
        c, s = chars[at : at + 20], sets[at : at + 20]
        h = len(c) // 2
        numbers, sizes = [], []
        for cs, ss in ((c[:h], s[:h]), (c[h:], s[h:])):
            n, size = 0, 1
            for x, alphabet in zip(cs, ss):
                n, size = n * len(alphabet) + alphabet.index(x), size * len(alphabet)
            numbers.append(n)
            sizes.append(size)
        left, right = feistel(*numbers, *sizes, f"{tweak}|{at // 20}|{'/'.join(s)}")
        out += spelled(left, s[:h]) + spelled(right, s[h:])
    return out


def refilled(form, new):
    new = iter(new)
    return re.sub("[A-Za-z0-9]", lambda m: next(new), form)


def luhn(payload):
    total = 0
    for i, c in enumerate(reversed(payload)):
        d = int(c) * (2 if i % 2 == 0 else 1)
        total += d - 9 if d > 9 else d
    return str(-total % 10)


def mod97(text):
    return int("".join(str(int(c, 36)) for c in text)) % 97


def card(v):
    p = re.sub("[^0-9]", "", v)[:-1]
    p = permuted(p, [DIGITS] * len(p), "card")
    return refilled(v, p + luhn(p))


def iban(v):
    plain = v.replace(" ", "")
    p = permuted(plain[4:], own_sets(plain[4:]), "iban" + plain[:2])
    return refilled(v, f"{plain[:2]}{98 - mod97(p + plain[:2] + '00'):02d}{p}")


def ssn(v):
    area, group, serial = map(int, v.split("-"))
    left, right = feistel(area - 1 - (area > 666), (group - 1) * 9999 + serial - 1, 898, 99 * 9999, "ssn")
    return f"{left + 1 + (left + 1 >= 666):03d}-{right // 9999 + 1:02d}-{right % 9999 + 1:04d}"


def ip(v):
    a, b, c, d = map(int, v.split("."))
    left, right = feistel(a * 256 + b, c * 256 + d, 65536, 65536, "ip")
    return f"{left // 256}.{left % 256}.{right // 256}.{right % 256}"


def day(v):
    n = (date.fromisoformat(v) - date(1900, 1, 1)).days
    left, right = feistel(n // 229, n % 229, 319, 229, "date")
    return (date(1900, 1, 1) + timedelta(left * 229 + right)).isoformat()


def phone(v):
    digits = re.sub("[^0-9]", "", v)
    own, rest = digits[:-10], digits[-10:]
    sets = [DIGITS[2:] if len(rest) == 10 and i in (0, 3) and c >= "2" else DIGITS for i, c in enumerate(rest)]
    return refilled(v, own + permuted(rest, sets, "phone"))


def email(v):
    local, host = v.split("@")
    c = re.sub("[^A-Za-z0-9]", "", local)
    return refilled(local, permuted(c, own_sets(c), "email")) + "@" + host


def test_whole_texts_against_a_plain_version(spark):
    rnd = random.Random(11)
    number = lambda n: "".join(rnd.choice(DIGITS) for _ in range(n))

    def made_iban():
        country, rest = rnd.choice(["DE", "FR"]), number(18)
        return f"{country}{98 - mod97(rest + country + '00'):02d}{rest}"

    makers = {
        "card": (lambda: (lambda p: p + luhn(p))("4" + number(14)), card),
        "iban": (made_iban, iban),
        "ssn": (lambda: f"{rnd.choice([1, 665, 667, 899, 123]):03d}-{rnd.randint(1, 99):02d}-{rnd.randint(1, 9999):04d}", ssn),
        "ip": (lambda: ".".join(str(rnd.randint(0, 255)) for _ in range(4)), ip),
        "date": (lambda: (date(1900, 1, 1) + timedelta(rnd.randrange(319 * 229))).isoformat(), day),
        "phone": (lambda: f"+{rnd.randint(1, 99)} {rnd.randint(200, 999)}-{rnd.randint(200, 999)}-{number(4)}", phone),
        "email": (lambda: f"{rnd.choice(['jo.Doe7', 'A-long_name.of.24letters99x', 'xy'])}@mail.example.org", email),
    }
    left_alone = ["4111111111111112", "000-12-3456", "300.1.2.3", "2021-02-30", "DE00123412341234123412"]
    rows = []
    for k in range(60):
        text, want, kinds = "", "", []
        for _ in range(rnd.randrange(5)):
            kind = rnd.choice(sorted(makers))
            make, plain = makers[kind]
            value = make()
            text, want = text + f"before {value} after\n", want + f"before {plain(value)} after\n"
            kinds.append(kind)
        other = rnd.choice(left_alone)
        rows.append((k, f"{text}and {other} end", f"{want}and {other} end", kinds))
    docs = spark.createDataFrame([r[:2] for r in rows] + [(98, ""), (99, None)], "doc_id long, text string")
    got = {r.doc_id: (r.text, r.pii) for r in pii.pseudonymise(docs, KEY).collect()}
    for k, _, want, kinds in rows:
        assert got[k] == (want, kinds)
    assert got[98] == ("", []) and got[99] == (None, [])


def test_shards_against_a_sort_of_all_records(spark):
    rnd = random.Random(5)
    texts = [" ".join(rnd.choice(["alpha", "bravo", "delta"]) for _ in range(30)) + f" {k}" for k in range(4_000)]
    rows = [(k, t) for k, t in enumerate(texts)] + [(10_000 + k, rnd.choice(texts[:900])) for k in range(900)]
    rows += [(None, t) for t in texts[900:1_000]]
    shards, ranges = 40, 64
    out = sharding.assign_shards(spark.createDataFrame(rows, "doc_id long, text string"), shards, ranges_per_shard=ranges).collect()
    assert len(out) == len(rows)
    text_of = dict(enumerate(texts)) | {i: t for i, t in rows if i is not None and i >= 10_000}
    by_crc = {}
    for t in texts:
        by_crc.setdefault(zlib.crc32(t.encode()), []).append(t)
    assert all(len(v) == 1 for v in by_crc.values())
    total, run, border = sum(r["size"] for r in out), 0, -1
    for k in range(shards):
        mine = [(int(hashlib.md5(by_crc[r.text_crc32][0].encode()).hexdigest()[:15], 16), r.doc_id if r.doc_id is not None else -1, r.slot, r["size"]) for r in out if r.shard == k]
        mine.sort()
        assert [m[2] for m in mine] == list(range(len(mine)))  # slots are ranks by key and id
        assert mine[0][0] > border  # shards are ranges of keys, equal texts in one
        border = mine[-1][0]
        run += sum(m[3] for m in mine)
        assert abs(run - total * (k + 1) / shards) <= total / (shards * ranges) * 8
    assert run == total == sum(len(t.encode()) + 16 for _, t in rows)
    assert all(text_of[r.doc_id] == by_crc[r.text_crc32][0] for r in out if r.doc_id is not None)
