"""Secret scans: fixed patterns, and a battery of randomness tests, in DataFrame functions only.

Every long token of key-like characters gets an encoding, the smallest alphabet that holds it (hex, letters or alphanumeric of
one or both cases, base64), and three p-values under the null of uniform random characters: chi-squared of the alphabet, runs
about the middle of the alphabet, and lag-1 serial correlation. Fisher's rule joins them; a token that it rejects at
``REJECTED`` is no key. Whether the rest are keys depends on what such a token could score without being one: a reference of
identifiers made of words and numbers is scored by the same battery, and its mean and spread by encoding and length give each
token the chance that a natural one of its length looks as random. Short tokens, on which the tests have little power, so
need a better score than long ones. Benjamini-Hochberg over these chances, for all tokens of all lengths of the table, holds
the share of false discoveries at ``rate``: a lone key of a rare length, or in a small table, can be accepted.

A token that lies inside a base span is that span's; one that only meets a base span is judged as a whole, and both stay.

Tokens of digits alone are left out: serial numbers, times and amounts are as even as random digits.

Defined results: null and empty texts have no spans; repeated rows get the same spans; an empty table gives no rows.
Positions are code points, end exclusive; the span is the whole match. Work is linear in the length of a text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from moments.functions.arrays import running_sums
from moments.llm.common import let, save

ASSIGN = (
    r"(?i)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
)
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"(?<![0-9a-f])[0-9a-f]{16,}"
TOKEN = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{16,}"
KINDS = ("assign", "access", "hex", "random")
_DIGITS, _LOW, _UP = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: The encodings in the order in which they are tried; base64 of either form is read as the one with + and /.
ALPHABETS = {
    "hex": _DIGITS + _LOW[:6],
    "HEX": _DIGITS + _UP[:6],
    "low": _LOW,
    "up": _UP,
    "low36": _DIGITS + _LOW,
    "up36": _DIGITS + _UP,
    "letters": _UP + _LOW,
    "mixed": _DIGITS + _UP + _LOW,
    "base64": "+/" + _DIGITS + _UP + _LOW,
}
#: The battery rejects randomness at this combined p-value, whatever the reference says.
REJECTED = 0.001
#: Chances are kept as whole steps of a quarter power of 2; the last step holds all lower ones.
STEPS = 400
#: Words and numbers of the reference, its bands of lengths (quarter octaves from 16 to 128), the tokens in each, and the least
#: spread of a band.
WORDS = (
    "user name file path index value table data config server client request response handler service manager default internal "
    "version update release summary report customer account order product image upload download session message language "
    "north south river mountain history question answer general science department benutzer datei verzeichnis antwort rechnung "
    "fichier utilisateur reponse commande archivo usuario respuesta pedido"
).split()
NUMBERS = "2024 2019 01 10 2 007 1 3 64 12 1999 365 80 443".split()
HEX_WORDS = "ab cafe face add bad dead beef fade".split()
BANDS = range(16, 28)
EACH = 150
LEAST_SPREAD = 0.3
SPAN = "array<struct<s:int,e:int,m:string>>"


def located(text: Column, pattern: str) -> Column:
    """All leftmost non-overlapping matches with their code point positions."""
    none = F.array().cast(SPAN)

    def placed(found):
        def ends(between):
            steps = F.zip_with(
                F.slice(between, F.lit(1), F.size(found)), found, lambda b, m: F.length(b) + F.length(m)
            )
            return let(
                running_sums(steps),
                lambda end: F.zip_with(
                    end,
                    found,
                    lambda e, m: F.struct((e - F.length(m)).cast("int").alias("s"), e.cast("int").alias("e"), m.alias("m")),
                ),
            )

        return let(F.split(text, pattern, -1), ends)

    return let(
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)),
        lambda found: F.when(F.size(found) > 0, placed(found)).otherwise(none),
    )


def base_spans(text: Column) -> list[Column]:
    """The spans of assign, access and hex."""
    value = r"^" + ASSIGN
    none = F.array().cast(SPAN)
    assign = F.filter(located(text, ASSIGN), lambda x: F.length(F.regexp_extract(x.m, value, 2)) >= 12)
    access = F.when(text.contains("AKIA"), located(text, ACCESS)).otherwise(none)
    return [assign, access, located(text, HEX)]


def _above(z: Column) -> Column:
    """P(N > z) of a standard normal, by the logistic approximation with a cubic term (error below 2e-4)."""
    x = F.greatest(F.lit(-8.0), F.least(F.lit(8.0), z))
    return 1.0 / (1.0 + F.exp(x * x * x * 0.07056 + x * 1.5976))


def encoding(token: Column) -> Column:
    """The name of the first alphabet that holds the token."""
    return F.coalesce(*[F.when(F.translate(token, a, "") == "", F.lit(k)) for k, a in ALPHABETS.items()])


def told(token: Column) -> Column:
    """The token as the alphabets spell it: one form of base64, no padding."""
    return F.regexp_replace(F.translate(token, "-_", "+/"), "=+", "")


def battery(token: Column) -> Column:
    """Struct of encoding, n and half: minus the sum of the logs of the three p-values under the null that the characters are
    uniform and independent, half of Fisher's statistic."""

    def with_codes(t):
        n, k = F.size(t.codes).cast("double"), t.k.cast("double")
        counts = F.transform(F.array_distinct(t.codes), lambda c: F.size(F.filter(t.codes, lambda x: x == c)))
        chi = F.aggregate(counts, F.lit(0.0), lambda a, c: a + c * c) * k / n - n
        df = k - 1
        chi_z = (F.pow(chi / df, F.lit(1 / 3)) - (1 - 2 / (9 * df))) / F.sqrt(2 / (9 * df))
        mean = F.aggregate(t.codes, F.lit(0.0), lambda a, c: a + c) / n
        next_ = F.slice(t.codes, 2, F.size(t.codes) - 1)
        runs = F.aggregate(
            F.zip_with(t.codes, next_, lambda a, b: ((a * 2 >= k) != (b * 2 >= k)).cast("int")),
            F.lit(1),
            lambda a, x: a + F.coalesce(x, F.lit(0)),
        )
        high = F.size(F.filter(t.codes, lambda c: c * 2 >= k)).cast("double")
        pairs = high * (n - high) * 2
        expected = pairs / n + 1
        spread = F.sqrt(F.greatest(F.lit(0.05), pairs * (pairs - n) / (n * n * (n - 1))))
        variance = F.aggregate(t.codes, F.lit(0.0), lambda a, c: a + (c - mean) * (c - mean))
        covariance = F.aggregate(
            F.zip_with(t.codes, next_, lambda a, b: (a - mean) * (b - mean)),
            F.lit(0.0),
            lambda a, x: a + F.coalesce(x, F.lit(0.0)),
        )
        serial = F.when(variance > 0, covariance / variance + 1 / n).otherwise(1.0) * F.sqrt(n)
        ps = [_above(chi_z), 2 * _above(F.abs((runs - expected) / spread)), 2 * _above(F.abs(serial))]
        half = -sum(F.ln(F.least(F.lit(1.0), p)) for p in ps)
        return F.struct(t["name"].alias("encoding"), F.size(t.codes).alias("n"), half.alias("half"))

    def coded(x):  # the alphabet once a token, not once a character
        alphabet = F.try_element_at(F.create_map(*[F.lit(y) for kv in ALPHABETS.items() for y in kv]), x["name"])
        codes = lambda a: F.transform(F.split(x.token, ""), lambda c: F.call_function("instr", a, c) - 1)
        return let(alphabet, lambda a: F.struct(codes(a).alias("codes"), F.length(a).alias("k"), x["name"].alias("name")))

    named = let(told(token), lambda t: F.struct(t.alias("token"), encoding(t).alias("name")))
    return let(let(named, coded), with_codes)


def combined(half: Column) -> Column:
    """Fisher's combined p-value: chi-squared with 6 degrees, closed form."""
    return F.exp(-half) * (1 + half + half * half / 2)


def band(n: Column) -> Column:
    return F.least(F.lit(BANDS[-1]), F.greatest(F.lit(BANDS[0]), F.floor(F.log2(n.cast("double")) * 4))).cast("int")


def reference(spark: SparkSession) -> DataFrame:
    """(encoding, token): run-together words and numbers in the spelling of each encoding; the same in every run."""
    names = [k for k in ALPHABETS if k not in ("HEX", "up", "up36")]  # these are as hex, low and low36
    of = F.get(F.array(*map(F.lit, names)), (F.col("id") % len(names)).cast("int"))
    group = (F.floor(F.col("id") / len(names)) % len(BANDS) + BANDS[0]).cast("double")
    drawn = lambda seed, i, n: F.pmod(F.xxhash64(F.lit(seed), F.col("id"), i), F.lit(n)).cast("int")
    pick = lambda seed, i, values: F.get(F.array(*map(F.lit, values)), drawn(seed, i, len(values)))

    def piece(i):
        word, number, mixed = pick("w", i, WORDS), pick("n", i, NUMBERS), drawn("m", i, 4) == 0
        capital = F.initcap(word)
        return (
            F.when(of == "hex", F.when(drawn("h", i, 5) < 2, pick("x", i, HEX_WORDS)).otherwise(number))
            .when(of == "low", word)
            .when(of == "low36", F.when(mixed, number).otherwise(word))
            .when(of == "letters", capital)
            .when(of == "mixed", F.when(mixed, number).otherwise(capital))
            .otherwise(F.concat(F.when(mixed, number).otherwise(capital), pick("k", i, ["+", "/"])))
        )

    low, high = F.pow(F.lit(2.0), group / 4), F.pow(F.lit(2.0), (group + 1) / 4)
    size = F.ceil(low + (high - low - 1) * (drawn("size", F.lit(0), 1000) / 1000)).cast("int")
    text = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(140)), piece), "")
    rows = spark.range(EACH * len(BANDS) * len(names))
    return save(rows.select(of.alias("encoding"), F.substring(text, F.lit(1), size).alias("token")))


def norms(spark: SparkSession) -> dict[tuple[str, int], tuple[float, float]]:
    """By encoding and band of length, mean and spread of ln(1 + half) over the reference: a fixed number of rows."""
    t = reference(spark).select("encoding", battery(F.col("token")).alias("b"))
    score = F.ln(1 + F.col("b.half"))
    rows = (
        t.groupBy("encoding", band(F.col("b.n")).alias("band"))
        .agg(F.avg(score).alias("m"), F.stddev_pop(score).alias("s"), F.count(F.lit(1)).alias("n"))
        .filter(F.col("n") >= EACH // 2)
        .collect()
    )
    out = {(r.encoding, r.band): (r.m, max(r.s, LEAST_SPREAD)) for r in rows}
    alike = {"HEX": "hex", "up": "low", "up36": "low36"}
    return out | {(k, b): out[v, b] for k, v in alike.items() for b in BANDS if (v, b) in out}


def step(half: Column, of: Column, n: Column, known: dict) -> Column:
    """How unlikely a natural token of the encoding and length is to look as random: -4 log2 of the chance, rounded down."""
    table = F.create_map(
        *[F.lit(x) for (k, b), (m, s) in sorted(known.items()) for x in (f"{k}:{b}", f"{m!r}:{s!r}")]
    )

    def chance(found):
        m, s = F.split(found, ":")[0].cast("double"), F.split(found, ":")[1].cast("double")
        return _above((m - F.ln(1 + half)) / s)

    p = F.coalesce(let(F.try_element_at(table, F.concat_ws(":", of, band(n).cast("string"))), chance), F.lit(1.0))
    return F.least(F.lit(STEPS), F.floor(F.log2(p) * -4)).cast("int")


def scanned(docs: DataFrame, *carry: str) -> DataFrame:
    """carry, the base spans, and every candidate token with its place and the result of the battery."""
    text = F.coalesce("text", F.lit(""))
    base = docs.select(*carry, text.alias("t"), *[x.alias(k) for x, k in zip(base_spans(text), KINDS)])
    spans = F.concat("assign", "access", "hex")
    free = F.filter(
        located(F.col("t"), TOKEN),
        lambda x: x.m.rlike("[A-Za-z]") & (F.length(told(x.m)) >= 16) & ~F.exists(spans, lambda b: (b.s <= x.s) & (x.e <= b.e)),
    )
    scored = F.transform(free, lambda x: F.struct(x.s.alias("s"), x.e.alias("e"), battery(x.m).alias("b")))
    narrow = [F.transform(k, lambda x: F.struct(x.s.alias("s"), x.e.alias("e"))).alias(k) for k in KINDS[:3]]
    return base.select(*carry, *narrow, scored.alias("tokens"))


def threshold(scans: DataFrame, known: dict, rate: float = 0.05) -> int | None:
    """The least step that is accepted, None where none is. One row a step reaches the driver, at most STEPS + 1."""
    x = F.col("x.b")
    rows = (
        scans.select(F.explode("tokens").alias("x"))
        .groupBy(step(x.half, x.encoding, x.n, known).alias("step"))
        .agg(F.count(F.lit(1)).alias("n"), F.count_if(combined(x.half) >= REJECTED).alias("random"))
        .collect()
    )
    return accepted({r.step: (r.n, r.random) for r in rows}, rate)


def accepted(counts: dict[int, tuple[int, int]], rate: float) -> int | None:
    """Benjamini-Hochberg over tokens by step: the least step at which the false discoveries to be expected among all tokens
    are at most the rate times the tokens found there or beyond."""
    total, found, least = sum(n for n, _ in counts.values()), 0, None
    for at in sorted(counts, reverse=True):
        found += counts[at][1]
        if total * 2.0 ** (-at / 4) <= rate * found:
            least = at
    return least


def find_secrets(scans: DataFrame, known: dict, least: int | None) -> DataFrame:
    """Adds ``random``: the tokens from that step on which the battery does not reject."""
    passes = lambda x: (combined(x.b.half) >= REJECTED) & (step(x.b.half, x.b.encoding, x.b.n, known) >= least)
    kept = F.filter("tokens", passes) if least is not None else F.filter("tokens", lambda x: F.lit(False))
    chosen = F.transform(kept, lambda x: F.struct(x.s.alias("s"), x.e.alias("e")))
    return scans.withColumn("random", chosen).drop("tokens")


def joined(*kinds: str) -> Column:
    """kind:start:end by start, then kind in the order of KINDS, comma-joined."""
    def tagged(kind):
        place = F.lit(KINDS.index(kind))
        return F.transform(kind, lambda x: F.struct(x.s.alias("s"), place.alias("k"), x.e.alias("e")))

    ranked = F.concat(*map(tagged, kinds))
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(
        F.transform(F.array_sort(ranked), lambda x: F.concat_ws(":", F.get(names, x.k), x.s.cast("string"), x.e.cast("string"))),
        ",",
    )


def secrets(docs: DataFrame, rate: float = 0.05) -> DataFrame:
    scans = save(scanned(docs, "doc_id"))
    known = norms(docs.sparkSession)
    found = find_secrets(scans, known, threshold(scans, known, rate))
    return found.select(
        "doc_id",
        *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS],
        F.sha2(joined(*KINDS[:3]), 256).alias("base_sha256"),
        joined(*KINDS).alias("spans"),
    )
