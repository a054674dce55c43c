"""The randomness battery against the same statistics in plain Python; random tokens of each encoding, alone and among prose."""

import math
import random
import string
from collections import Counter

from pyspark.sql import functions as F

from moments.llm import secrets

MIXED = string.ascii_letters + string.digits
NAMES = [
    "user_name_2024_internal_report_v2", "benutzerVerzeichnisRechnung2019", "north-river-history-department-007-general-answer",
    "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa1", "550e8400-e29b-41d4-a716-446655440000", "Donaudampfschifffahrtsgesellschaftskapitaen",
    "getUserAccountDetailsFromDatabaseTable", "INV-2024-000123-XYZ-778", "20240101123456789012345678", "docs/2024/report-final-version/index",
    "MAX_BUFFER_SIZE_IN_BYTES_DEFAULT", "=====================", "ABCDEFGHIJKLMNOPQRSTUVWXYZ",
]


def found(df):
    return {r.doc_id: r.n_random for r in secrets.secrets(df).collect() if r.n_random}


def test_lone_keys_of_rare_lengths(spark):
    rnd = random.Random(11)
    keys = ["".join(rnd.choice(MIXED) for _ in range(n)) for n in (64, 96, 150, 300, 48)]
    rows = [(i, f"see {k} here") for i, k in enumerate(keys)] + [(100 + i, f"see {x} here") for i, x in enumerate(NAMES)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert set(found(df)) == set(range(5))
    assert found(df.filter("doc_id = 0")) == {0: 1}  # alone in its table
    assert found(df.filter("doc_id >= 100")) == {}


def test_twelve_keys_in_twelve_documents_and_every_encoding(spark):
    rnd = random.Random(12)
    rows = [(i, f"the key is {''.join(rnd.choice(MIXED) for _ in range(40))} and so on") for i in range(12)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert len(found(df)) == 12
    kinds = [k for k in secrets.ALPHABETS if k != "hex"]  # lower-case hex is a base span
    rows = [(100 * i + j, f"x {''.join(rnd.choice(secrets.ALPHABETS[k]) for _ in range(64))}\n") for i, k in enumerate(kinds) for j in range(20)]
    each = Counter(kinds[d // 100] for d in found(spark.createDataFrame(rows, "doc_id long, text string")))
    assert all(each[k] >= 19 for k in kinds), each
    long = "word " * 50_000 + rows[0][1] + "word " * 50_000
    out = secrets.secrets(spark.createDataFrame([(1, long)], "doc_id long, text string")).first()
    # the key of this seed holds a run of 18 digits, which is a base span of its own: both stay
    assert out.spans == f"random:{250_000 + 2}:{250_000 + 66},hex:{250_000 + 7}:{250_000 + 25}"


def half(token, alphabet):
    """The three tests as their definitions have it."""
    above = lambda z: 1 / (1 + math.exp(0.07056 * z**3 + 1.5976 * z)) if abs(z) < 8 else above(math.copysign(7.999999999, z))
    codes, n, k = [alphabet.index(c) for c in token], len(token), len(alphabet)
    chi = sum((c - n / k) ** 2 / (n / k) for c in (Counter(codes)[i] for i in range(k)))
    side = [c * 2 >= k for c in codes]
    runs, high = 1 + sum(a != b for a, b in zip(side, side[1:])), sum(side)
    two = 2 * high * (n - high)
    mean = sum(codes) / n
    spread = sum((c - mean) ** 2 for c in codes)
    serial = (sum((a - mean) * (b - mean) for a, b in zip(codes, codes[1:])) / spread + 1 / n if spread else 1) * math.sqrt(n)
    v = 2 / (9 * (k - 1))
    ps = [
        above(((chi / (k - 1)) ** (1 / 3) - 1 + v) / math.sqrt(v)),
        2 * above(abs(runs - two / n - 1) / math.sqrt(max(0.05, two * (two - n) / (n * n * (n - 1))))),
        2 * above(abs(serial)),
    ]
    return -sum(math.log(min(1, p)) for p in ps)


def test_the_three_statistics(spark):
    rnd = random.Random(13)
    tokens = ["".join(rnd.choice(a) for _ in range(n)) for a in secrets.ALPHABETS.values() for n in (16, 31, 90)]
    tokens += ["abcabcabcabcabcabc", "aaaaaaaaaaaaaaaaa", "Zz" * 10, "user-name_file/path+x=="]
    df = spark.createDataFrame([(t,) for t in tokens], "t string").select("t", secrets.battery(F.col("t")).alias("b"))
    for r in df.collect():
        plain = r.t.translate(str.maketrans("-_", "+/")).replace("=", "")
        name = next(k for k, a in secrets.ALPHABETS.items() if not set(plain) - set(a))
        assert (r.b.encoding, r.b.n) == (name, len(plain))
        assert math.isclose(r.b.half, half(plain, secrets.ALPHABETS[name]), rel_tol=1e-6, abs_tol=1e-6), r.t


def test_false_discoveries_are_controlled_over_all_lengths():
    assert secrets.accepted({}, 0.05) is None
    assert secrets.accepted({0: (1, 1)}, 0.05) is None
    assert secrets.accepted({18: (1, 1)}, 0.05) == 18  # alone: a chance of 2^-4.5 is below 0.05
    assert secrets.accepted({18: (1, 1), 0: (99, 0)}, 0.05) is None  # among a hundred it is not
    assert secrets.accepted({18: (40, 40), 60: (60, 60)}, 0.05) == 18
    assert secrets.accepted({60: (10, 0), 0: (10, 0)}, 0.05) is None  # the battery rejects them all
    natural = {i: (round(10_000 * (2 ** (-i / 4) - 2 ** (-(i + 1) / 4))),) * 2 for i in range(40)}
    assert secrets.accepted(natural, 0.05) is None  # tokens as the reference has them give no discovery


def test_natural_tokens_are_seldom_taken(spark):
    rnd = random.Random(14)
    words = "house garden window letter street morning evening summer winter paper music doctor market station kitchen".split()
    rows = [(i, "_".join(rnd.choice(words) for _ in range(rnd.randint(3, 8)))) for i in range(500)]
    assert sum(found(spark.createDataFrame(rows, "doc_id long, text string")).values()) <= 2
