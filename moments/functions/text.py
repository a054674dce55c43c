"""Scalar functions on texts, all Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters of a word for matching.
TOKEN = "[a-z0-9£$€%.:'-]+"
#: Words that matching ignores.
STOPWORDS = """
a an the and or but if then than that this these those of in on at to from by
for with without into onto over under again further is are was were be been
being am do does did doing have has had having i you he she it we they them
his her its our their as so such no nor not only own same too very can will
just should now there here when where why how all any both each few more most
other some what which who whom
""".split()


def tokens(text: Column) -> Column:
    """Lower-case words without stop words; prices and times stay whole."""
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(0))
    return F.filter(found, lambda x: ~x.isin(STOPWORDS))


def fingerprint(text: Column, digits: int = 16) -> Column:
    return F.left(F.sha2(F.coalesce(text, F.lit("")), 256), F.lit(digits))


def _rendered(value: Column, kind: str) -> Column:
    """Null for blank values; kind is string, number, boolean or strings (array); entries are rendered by ``operators.answers``."""
    if kind == "string":
        return F.nullif(F.trim(value), F.lit(""))
    if kind == "number":
        return value.cast("string")
    if kind == "boolean":
        return F.initcap(value.cast("string"))
    if kind == "strings":
        kept = F.filter(F.transform(value, lambda x: F.trim(x)), lambda x: x != "")
        return F.nullif(F.array_join(kept, " | "), F.lit(""))
    raise ValueError(f"unknown kind {kind}")


def render(summary: Column, fields: dict[str, tuple[Column, str]]) -> Column:
    """The summary, then every non-blank field in key order as ``name: value``, joined by ``. ``."""
    parts = [F.nullif(F.trim(summary), F.lit(""))]
    for name in sorted(fields):
        value, kind = fields[name]
        parts.append(F.concat(F.lit(f"{name}: "), _rendered(value, kind)))
    return F.concat_ws(". ", *parts)


def entry(fields: dict[str, Column]) -> Column:
    """An entry of a list: ``name value`` of its non-blank fields in key order, joined by ``; ``."""
    return F.concat_ws("; ", *[F.concat(F.lit(f"{k} "), F.nullif(F.trim(v.cast("string")), F.lit(""))) for k, v in sorted(fields.items())])


def signature(values: list[Column]) -> Column:
    """Identity values joined by ``; ``, blanks dropped."""
    return F.concat_ws("; ", *[F.nullif(F.trim(v), F.lit("")) for v in values])


def slug(text: Column) -> Column:
    return F.left(F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "_"), "^_+|_+$", ""), F.lit(48))


def line(chunk: Column, start: Column, end: Column, label: Column, said: Column) -> Column:
    return F.format_string("[%d] %.0f-%.0fs  %s: %s", chunk, start, end, label, said)


def prompt(template: Column, values: dict[str, Column]) -> Column:
    """The template with {name} replaced by its value."""
    out = template
    for name, value in values.items():
        out = F.replace(out, F.lit("{" + name + "}"), value.cast("string"))
    return out


#: How texts are announced to embedding models, by a part of the model's name: (query, document).
PREFIXES = {"e5": ("query: ", "passage: "), "nomic": ("search_query: ", "search_document: ")}


def prefixes(model: Column, side: int) -> Column:
    out = F.lit("")
    for part, pair in PREFIXES.items():
        out = F.when(F.lower(model).contains(part), F.lit(pair[side])).otherwise(out)
    return out


def json_answer(raw: Column) -> Column:
    """The JSON object of an answer: plain, in a fence, or from the first brace to the last; null where none parses."""
    inner = F.nullif(F.regexp_extract(raw, r"(?s)\{.*\}", 0), F.lit(""))
    return F.when(F.get_json_object(inner, "$").isNotNull(), inner)


def pieces(text: Column, limit: int) -> Column:
    """The text cut at sentence ends, then at spaces, into pieces of at most limit characters; nothing is dropped."""
    text = F.trim(F.coalesce(text, F.lit("")))

    def halves(s: Column) -> Column:
        """A sentence in parts of at most limit characters, cut at the last space before it, else at it."""
        head = F.substring(s, 1, limit)
        back = F.call_function("instr", F.reverse(head), F.lit(" "))
        at = F.when((back == 0) | (back == F.length(head)), F.lit(limit)).otherwise(F.length(head) - back)
        return F.struct(F.trim(F.substr(s, F.lit(1), at)).alias("a"), F.trim(F.substr(s, at + 1, F.length(s))).alias("b"))

    def split(s: Column) -> Column:
        steps = F.sequence(F.lit(1), (F.ceil(F.length(s) / limit) * 2 + 2).cast("int"))
        return F.aggregate(
            steps,
            F.struct(F.array().cast("array<string>").alias("parts"), s.alias("rest")),
            lambda a, _: F.when(F.length(a.rest) <= limit, a).otherwise(
                F.struct(F.concat(a.parts, F.array(halves(a.rest).a)).alias("parts"), halves(a.rest).b.alias("rest"))
            ),
        )

    none = F.array().cast("array<string>")

    def pack(acc: Column, parts: Column) -> Column:
        flushed = F.when((F.size(parts.parts) > 0) & (acc.now != ""), F.concat(acc.out, F.array(acc.now), parts.parts)).otherwise(
            F.concat(acc.out, parts.parts)
        )
        now = F.when(F.size(parts.parts) > 0, F.lit("")).otherwise(acc.now)
        fits = F.length(now) + 1 + F.length(parts.rest) <= limit
        return F.when(now == "", F.struct(flushed.alias("out"), parts.rest.alias("now"))).when(
            fits, F.struct(flushed.alias("out"), F.concat_ws(" ", now, parts.rest).alias("now"))
        ).otherwise(F.struct(F.concat(flushed, F.array(now)).alias("out"), parts.rest.alias("now")))

    packed = F.aggregate(
        F.transform(F.split(text, r"(?<=[.!?])\s+"), split),
        F.struct(none.alias("out"), F.lit("").alias("now")),
        pack,
        lambda a: F.concat(a.out, F.array(a.now)),
    )
    return F.filter(packed, lambda p: p != "")


#: Words for colours and for garments.
COLOURS = """
black white grey gray dark light navy blue red maroon burgundy pink green olive khaki tan beige cream brown yellow orange purple
""".split()
GARMENTS = """
jacket coat top shirt sweater hoodie hooded cardigan puffer vest trousers pants jeans leggings skirt dress shorts shoes trainers sneakers
boots cap beanie hat scarf bag backpack
""".split()


def colour_garments(text: Column) -> Column:
    """What a description says is worn: each garment with the colours among the three words before it, or alone where none is."""
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z]+"), F.lit(0))

    def worn(words):
        def of(word, i):
            start = F.greatest(i - 2, F.lit(1)).cast("int")
            near = F.filter(F.slice(words, start, i + 1 - start), lambda c: c.isin(COLOURS))
            pairs = F.transform(near, lambda c: F.concat(c, F.lit(" "), word))
            alone = F.when(F.size(near) == 0, F.array(word)).otherwise(pairs)
            return F.when(word.isin(GARMENTS), alone).otherwise(F.array().cast("array<string>"))

        return F.array_distinct(F.flatten(F.transform(words, of)))

    return F.element_at(F.transform(F.array(found), worn), 1)


def dice(a: Column, b: Column) -> Column:
    """Twice the shared share of two sets; two empty ones share nothing."""
    both = F.size(a) + F.size(b)
    return F.when(both > 0, 2 * F.size(F.array_intersect(a, b)) / both).otherwise(0.0)


def space_key(name: Column, model: Column, dims: Column, query: Column, document: Column) -> Column:
    """The key of a vector space: ``name:model:dims``, and a digest of the prefixes where they are not the model's own."""
    own = (query == prefixes(model, 0)) & (document == prefixes(model, 1))
    digest = F.left(F.sha1(F.concat(query, F.lit("\0"), document)), F.lit(6))
    key = F.concat_ws(":", name, model, dims.cast("string"))
    return F.when(own, key).otherwise(F.concat(key, F.lit(":p"), digest))
