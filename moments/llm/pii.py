"""Format-preserving pseudonyms of personal data, in DataFrame functions only.

Candidates are found by one pattern; those that pass the check of their kind (Luhn, mod 97, octets, calendar, area numbers)
are permuted by a keyed Feistel network over exactly their own set of values: a string of characters with one alphabet each
is a pair of mixed-radix numbers (left, right), and rounds add a keyed hash of one half to the other, modulo its size. So a
pseudonym has the format of the value, two values never share one, and equal values stay equal in every document. Check
digits are computed anew. Dates are permuted as days of 1900-2099, whatever the notation.

Defined results: null texts stay null and empty ones empty; unvalidated candidates are left as they are; repeated rows get
the same pseudonyms; an empty table gives no rows; the kinds go to a column ``pii``, with underscores behind where docs has one.
Dates are read day first, and month first where that gives none; a pseudonym is spelled as the value was read. Work is
proportional to the length of the text and its candidates.
"""

from __future__ import annotations

from secrets import token_hex

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from moments.llm.common import free_name, let

DIGITS, LOW, UP = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
PARTS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "iban": r"\b[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)\b",
    "card": r"(?<![0-9.+-])(?:[0-9]{13,19}|[0-9]{4}(?<gap>[ -])[0-9]{4}\k<gap>[0-9]{4}\k<gap>[0-9]{4})(?![0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "ip": r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9])(?!\.[0-9])",
    "date": r"(?<![0-9/.-])(?:(?:19|20)[0-9]{2}-[01][0-9]-[0-3][0-9]|[0-3]?[0-9](?<dot>[/.])[0-3]?[0-9]\k<dot>(?:19|20)[0-9]{2})(?![0-9])",
    "phone": r"(?<![0-9+])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{2,4}\) ?|[0-9]{2,4}[ .-])[0-9]{3,4}[ .-][0-9]{3,4}(?![0-9])",
}
CANDIDATE = "|".join(PARTS.values())
KINDS = tuple(PARTS)
ROUNDS = 8
#: 1900-01-01 to 2099-12-31 has 319 x 229 days.
DAYS = (319, 229)


def _round(key: str, tweak: Column, i: Column, half: Column) -> Column:
    said = F.sha2(F.concat_ws("|", F.lit(key), tweak, i.cast("string"), half.cast("string")), 256)
    return F.conv(F.substring(said, 1, 15), 16, 10).cast("long")


def feistel(left: Column, right: Column, a: Column, b: Column, key: str, tweak: Column) -> Column:
    """A keyed permutation of the pairs (left < a, right < b), as a struct of l and r."""
    return F.aggregate(
        F.sequence(F.lit(0), F.lit(ROUNDS - 1)),
        F.struct(left.cast("long").alias("l"), right.cast("long").alias("r")),
        lambda x, i: F.when(
            i % 2 == 0, F.struct(((x.l + _round(key, tweak, i, x.r) % a) % a).alias("l"), x.r.alias("r"))
        ).otherwise(F.struct(x.l.alias("l"), ((x.r + _round(key, tweak, i, x.l) % b) % b).alias("r"))),
    )


def _number(chars: Column, sets: Column) -> Column:
    return F.aggregate(
        F.arrays_zip(chars.alias("c"), sets.alias("s")),
        F.lit(0).cast("long"),
        lambda n, x: n * F.length(x.s) + F.call_function("instr", x.s, x.c) - 1,
    )


def _size(sets: Column) -> Column:
    return F.aggregate(sets, F.lit(1).cast("long"), lambda n, s: n * F.length(s))


def _spelled(number: Column, sets: Column) -> Column:
    """The characters of a mixed-radix number."""
    return F.aggregate(
        F.reverse(sets),
        F.struct(number.alias("n"), F.lit("").alias("out")),
        lambda x, s: F.struct(
            F.call_function("div", x.n, F.length(s)).alias("n"),
            F.concat(F.substr(s, (x.n % F.length(s) + 1).cast("int"), F.lit(1)), x.out).alias("out"),
        ),
        lambda x: x.out,
    )


def permuted(chars: Column, sets: Column, key: str, tweak: Column) -> Column:
    """The characters, each from its own alphabet, as another string over the same alphabets; 20 at a time."""

    def alone(t):
        """One character: the alphabet in the order of its keyed hashes; a network of one half would only shift it."""
        own = F.get(t.s, 0)
        hashed = F.transform(
            F.split(own, ""),
            lambda c: F.struct(F.sha2(F.concat_ws("|", F.lit(key), tweak, F.lit("one"), own, c), 256).alias("h"), c.alias("c")),
        )
        return F.get(F.array_sort(hashed), F.call_function("instr", own, F.get(t.c, 0)) - 1).c

    def chunk(at):
        part = lambda x: F.slice(x, at * 20 + 1, F.lit(20))

        def both(t):
            half = F.call_function("div", F.size(t.c), F.lit(2)).cast("int")
            cut = lambda x: (F.slice(x, F.lit(1), half), F.slice(x, half + 1, F.size(t.c) - half))
            (cl, cr), (sl, sr) = cut(t.c), cut(t.s)
            salt = F.concat_ws("|", tweak, at.cast("string"), F.array_join(t.s, "/"))
            return let(
                feistel(_number(cl, sl), _number(cr, sr), _size(sl), _size(sr), key, salt),
                lambda x: F.concat(_spelled(x.l, sl), _spelled(x.r, sr)),
            )

        return let(
            F.struct(part(chars).alias("c"), part(sets).alias("s")), lambda t: F.when(F.size(t.c) == 1, alone(t)).otherwise(both(t))
        )

    last = F.call_function("div", F.size(chars) - 1, F.lit(20)).cast("int")
    return F.when(F.size(chars) == 0, F.lit("")).otherwise(
        F.array_join(F.transform(F.sequence(F.lit(0), last), chunk), "")
    )


def _sets(chars: Column) -> Column:
    return F.transform(
        chars,
        lambda c: F.when(c.between("0", "9"), F.lit(DIGITS)).when(c.between("a", "z"), F.lit(LOW)).otherwise(F.lit(UP)),
    )


def _alnum(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit("[A-Za-z0-9]"), F.lit(0))


def _refilled(form: Column, new: Column) -> Column:
    """form with its letters and digits replaced by the characters of new, in order."""
    return F.aggregate(
        F.regexp_extract_all(form, F.lit("(?s)."), F.lit(0)),
        F.struct(F.lit(1).alias("i"), F.lit("").alias("out")),
        lambda x, c: F.when(
            c.rlike("[A-Za-z0-9]"),
            F.struct((x.i + 1).alias("i"), F.concat(x.out, F.substr(new, x.i, F.lit(1))).alias("out")),
        ).otherwise(F.struct(x.i.alias("i"), F.concat(x.out, c).alias("out"))),
        lambda x: x.out,
    )


def _luhn_digit(payload: Column) -> Column:
    """The check digit that makes payload + digit pass the Luhn test."""
    total = F.aggregate(
        F.transform(
            F.reverse(F.split(payload, "")),
            lambda c, i: let(c.cast("int") * F.when(i % 2 == 0, 2).otherwise(1), lambda d: d - F.when(d > 9, 9).otherwise(0)),
        ),
        F.lit(0),
        lambda a, d: a + d,
    )
    return ((10 - total % 10) % 10).cast("string")


def _mod97(text: Column) -> Column:
    """The value of letters and digits as a number modulo 97; letters count 10 to 35."""
    return F.aggregate(
        F.split(text, ""),
        F.lit(0),
        lambda a, c: F.when(c.between("0", "9"), (a * 10 + c.try_cast("int")) % 97).otherwise(
            (a * 100 + F.ascii(c) - 55) % 97
        ),
    )


def _date_form(v: Column) -> list[tuple[Column, str]]:
    return [
        (v.rlike("^[0-9]{4}-"), "yyyy-MM-dd"),
        (v.rlike("^[0-9]{2}/[0-9]{2}/"), "dd/MM/yyyy"),
        (v.rlike(r"^[0-9]{2}\.[0-9]{2}\."), "dd.MM.yyyy"),
        (v.rlike("^[0-9]{1,2}/[0-9]{1,2}/"), "d/M/yyyy"),
        (v.contains("."), "d.M.yyyy"),
        (v.rlike("^[0-9]{2}/[0-9]{2}/"), "MM/dd/yyyy"),
        (v.contains("/"), "M/d/yyyy"),
    ]


def kind_of(v: Column) -> Column:
    """The kind whose form a candidate has and whose check it passes, else null."""
    form = lambda k: v.rlike(f"^(?:{PARTS[k]})$")
    digits = F.regexp_replace(v, "[^0-9]", "")
    octets = F.transform(F.split(v, r"\."), lambda x: x.try_cast("int"))
    plain = F.regexp_replace(v, " ", "")
    day = F.coalesce(*[F.when(c, F.try_to_date(v, f)) for c, f in _date_form(v)])
    return (
        F.when(form("email"), F.lit("email"))
        .when(form("iban") & (_mod97(F.concat(F.substring(plain, 5, 40), F.substring(plain, 1, 4))) == 1), F.lit("iban"))
        .when(form("card") & F.call_function("luhn_check", digits) & (digits.rlike("[1-9]")), F.lit("card"))
        .when(form("ssn") & ~v.rlike("^(000|666|9)|-00-|-0000$"), F.lit("ssn"))
        .when(form("ip") & F.forall(octets, lambda x: x <= 255), F.lit("ip"))
        .when(form("date") & day.isNotNull(), F.lit("date"))
        .when(form("phone") & F.length(digits).between(7, 15), F.lit("phone"))
    )


def pseudonym(v: Column, kind: Column, key: str) -> Column:
    digits = F.regexp_replace(v, "[^0-9]", "")
    chars = F.split(digits, "")

    def card():
        payload = F.slice(chars, F.lit(1), F.size(chars) - 1)
        return let(permuted(payload, _sets(payload), key, F.lit("card")), lambda p: _refilled(v, F.concat(p, _luhn_digit(p))))

    def iban():
        plain = F.regexp_replace(v, " ", "")
        rest = F.split(F.substring(plain, 5, 40), "")
        country = F.substring(plain, 1, 2)

        def checked(p):
            check = 98 - _mod97(F.concat(p, country, F.lit("00")))
            return _refilled(v, F.concat(country, F.lpad(check.cast("string"), 2, "0"), p))

        return let(permuted(rest, _sets(rest), key, F.concat(F.lit("iban"), country)), checked)

    def ssn():
        area, rest = F.substring(digits, 1, 3).try_cast("int"), F.substring(digits, 4, 6).try_cast("int")
        left = area - 1 - F.when(area > 666, 1).otherwise(0)
        right = (F.call_function("div", rest, F.lit(10000)) - 1) * 9999 + rest % 10000 - 1
        return let(
            feistel(left, right, F.lit(898), F.lit(99 * 9999), key, F.lit("ssn")),
            lambda x: let(
                x.l + 1 + F.when(x.l + 1 >= 666, 1).otherwise(0),
                lambda a: F.format_string(
                    "%03d-%02d-%04d", a, F.call_function("div", x.r, F.lit(9999)) + 1, x.r % 9999 + 1
                ),
            ),
        )

    def ip():
        o = F.transform(F.split(v, r"\."), lambda x: x.try_cast("int"))
        return let(
            feistel(F.get(o, 0) * 256 + F.get(o, 1), F.get(o, 2) * 256 + F.get(o, 3), F.lit(65536), F.lit(65536), key, F.lit("ip")),
            lambda x: F.concat_ws(
                ".", *[f.cast("string") for h in (x.l, x.r) for f in (F.call_function("div", h, F.lit(256)), h % 256)]
            ),
        )

    def date():
        a, b = DAYS
        start = F.lit("1900-01-01").cast("date")
        day = F.coalesce(*[F.when(c, F.try_to_date(v, f)) for c, f in _date_form(v)])
        moved = let(
            F.datediff(day, start),
            lambda n: let(
                feistel(F.call_function("div", n, F.lit(b)), n % b, F.lit(a), F.lit(b), key, F.lit("date")),
                lambda x: F.date_add(start, (x.l * b + x.r).cast("int")),
            ),
        )
        return let(moved, lambda m: F.coalesce(*[F.when(c & F.try_to_date(v, f).isNotNull(), F.date_format(m, f)) for c, f in _date_form(v)]))

    def phone():
        own = F.greatest(F.lit(0), F.size(chars) - 10)  # the country code stays
        rest = F.slice(chars, own + 1, F.size(chars) - own)
        sets = F.transform(
            rest,
            lambda c, i: F.when((F.size(rest) == 10) & i.isin(0, 3) & c.between("2", "9"), F.lit(DIGITS[2:])).otherwise(
                F.lit(DIGITS)
            ),
        )
        return let(
            permuted(rest, sets, key, F.lit("phone")), lambda p: _refilled(v, F.concat(F.substr(digits, F.lit(1), own), p))
        )

    def email():
        local = F.substring_index(v, "@", 1)
        c = _alnum(local)
        return F.concat(
            _refilled(local, permuted(c, _sets(c), key, F.lit("email"))), F.lit("@"), F.substring_index(v, "@", -1)
        )

    made = {"card": card, "iban": iban, "ssn": ssn, "ip": ip, "date": date, "phone": phone, "email": email}
    out = None
    for name, f in made.items():
        out = F.when(kind == name, f()) if out is None else out.when(kind == name, f())
    return out


def session_key(spark: SparkSession) -> str:
    """The secret of ``moments.pii.key``; where it is unset, a random one that lasts as long as the session."""
    found = spark.conf.get("moments.pii.key", None)
    if not found:
        found = token_hex(32)
        spark.conf.set("moments.pii.key", found)
    return found


def pseudonymise(docs: DataFrame, key: str) -> DataFrame:
    """docs with the text pseudonymised and ``pii``: the kinds found, in order. Who has the key can undo the pseudonyms."""
    if not key:
        raise ValueError("pseudonyms need a key")
    into, held_in = free_name(docs, "pii"), free_name(docs, "pii_found")
    text = F.col("text")
    found = F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(0))
    judged = F.transform(found, lambda v: F.struct(v.alias("v"), kind_of(v).alias("k")))
    changed = lambda items: F.transform(
        items, lambda x: F.when(x.k.isNull(), x.v).otherwise(pseudonym(x.v, x.k, key))
    )
    filled = lambda new: F.array_join(
        F.zip_with(F.split(text, CANDIDATE, -1), new, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), ""
    )
    held = F.when(text.rlike("[0-9@]"), judged)
    any_found = F.exists(held_in, lambda x: x.k.isNotNull())
    return (
        docs.withColumn(held_in, held)
        .withColumn("text", F.when(any_found, let(changed(F.col(held_in)), filled)).otherwise(text))
        .withColumn(
            into,
            F.coalesce(
                F.transform(F.filter(held_in, lambda x: x.k.isNotNull()), lambda x: x.k), F.array().cast("array<string>")
            ),
        )
        .drop(held_in)
    )
