"""Quality rules by distribution divergence, in DataFrame functions only.

A document's histograms of character classes and of common words are compared with a reference for its language by the
Jensen-Shannon distance. The references are sums over every document that passes the base rules. Short texts have noisy
histograms, so each comparison has a least length below which it is not made, and the limit of the word distance widens with
the noise, as one over the root of the number of words. The limits were fitted on the labels of the test tables (``errors``
counts what limits do to labelled rows).

Defined results: a null or empty text has no words and fails the base rules; an unknown or null language is held against
the reference of all languages by character classes only; repeated rows are judged alike; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from moments.llm.common import let, save, words

#: Frequent function words by language.
COMMON_WORDS = {
    "de": "der die und in den von zu das mit sich des auf ist im dem nicht".split(),
    "en": "the of and to in a is that for it on was with as be by".split(),
    "es": "de la que el en y a los se del las un por con no una".split(),
    "fr": "de la le et les des en un du une que est pour qui dans a".split(),
}
LANGS = sorted(COMMON_WORDS)
#: Histogram of character classes, in this order.
CLASSES = ["lower", "upper", "digit", "symbol", "punct", "other", "space"]
SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class QualityRules:
    min_words: int = 50
    max_repeat_percent: int = 50
    char_distance: float = 0.22
    #: The word distance is at most this for long texts, and ``word_noise`` / sqrt(n_words) more for short ones.
    word_distance: float = 0.16
    word_noise: float = 1.0
    char_min_chars: int = 200
    word_min_words: int = 50


def _low(x: Column, bits: int) -> Column:
    return x if bits == 64 else x.bitwiseAND(2**bits - 1)


def _repeat_words(w: Column, hash_bits: int = 64) -> Column:
    """Words inside 3-word windows that occur twice or more. Hash and position share one number, so that a sort of plain
    numbers brings equal windows together: n log n, for texts of any length. Neighbours of equal hashes are compared by their
    words; a text in which two of them differ is counted by a sort of the windows themselves."""

    def exact(w, n):
        at = F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.struct(*[F.get(w, i + k).alias(f"w{k}") for k in range(3)], i.alias("i")))
        same = lambda x, y: (x.w0 == y.w0) & (x.w1 == y.w1) & (x.w2 == y.w2)
        none = F.lit(False)
        found = let(
            F.array_sort(at),
            lambda s: F.filter(s, lambda x, j: F.coalesce(same(x, F.get(s, j + 1)), none) | F.coalesce(same(x, F.get(s, j - 1)), none)),
        )
        return F.transform(found, lambda x: x.i.cast("long"))

    def counted(w):
        n = F.size(w)
        bits = F.length(F.bin(n.cast("long")))
        windows = F.transform(
            F.sequence(F.lit(0), n - 3),
            lambda i: F.call_function(
                "shiftleft", _low(F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)), hash_bits), bits
            ).bitwiseOR(i.cast("long")),
        )
        high = lambda x: F.call_function("shiftright", x, bits)
        mask = F.call_function("shiftleft", F.lit(1).cast("long"), bits) - 1
        found = let(
            F.sort_array(windows),
            lambda s: F.filter(
                s,
                lambda x, j: F.coalesce(high(x) == high(F.get(s, j + 1)), F.lit(False))
                | F.coalesce(high(x) == high(F.get(s, j - 1)), F.lit(False)),
            ),
        )
        place = lambda x: x.bitwiseAND(mask).cast("int")
        differ = lambda x, y: F.coalesce(
            (high(x) == high(y)) & ((F.get(w, place(x)) != F.get(w, place(y))) | (F.get(w, place(x) + 1) != F.get(w, place(y) + 1)) | (F.get(w, place(x) + 2) != F.get(w, place(y) + 2))),
            F.lit(False),
        )

        def counted_at(s):
            clash = F.exists(F.zip_with(s, F.slice(s, 2, F.size(s)), differ), lambda x: x)
            at = F.when(clash, exact(w, n)).otherwise(F.transform(s, lambda x: x.bitwiseAND(mask)))
            return F.size(F.array_distinct(F.flatten(F.transform(at, lambda p: F.array(p, p + 1, p + 2)))))

        return F.when(n < 3, F.lit(0)).otherwise(let(found, counted_at)).cast("long")

    return counted(w)


def _dropped(text: Column, pattern: str) -> Column:
    """Characters of a class: what a scan for it removes."""
    return F.length(text) - F.length(F.regexp_replace(text, pattern, ""))


def features(docs: DataFrame) -> DataFrame:
    """The columns of docs, and a struct ``q`` with the base counts and both histograms. One pass, no shuffle."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lang = F.when(F.col("lang").isin(LANGS), F.col("lang"))
    listed = lambda x: F.coalesce(
        *[F.when(lang == k, x.isin(COMMON_WORDS[k])) for k in LANGS], F.lit(False)
    )
    bins = F.create_map(*[x for k in LANGS for x in (F.lit(k), F.array(*map(F.lit, COMMON_WORDS[k])))])

    def counted(w):
        common = F.when(
            lang.isNotNull(),
            let(
                F.filter(F.transform(w, lambda x: F.lower(x)), listed),
                lambda c: F.transform(
                    F.element_at(bins, lang), lambda f: F.size(F.filter(c, lambda x: x == f)).cast("long")
                ),
            ),
        )
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.aggregate(w, F.lit(0).cast("long"), lambda n, x: n + F.length(x)).alias("word_chars"),
            _repeat_words(w).alias("n_repeat_words"),
            common.alias("common"),
        )

    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(" \t\n\x0b\x0c\r")) != "")
    first = docs.withColumn("q_words", let(words(text), counted)).withColumn(
        "q_chars",
        F.struct(
            F.length(text).cast("long").alias("n"),
            _dropped(text, r"[#*$%&|<>]+").cast("long").alias("n_symbols"),
            _dropped(text, r"[A-Z]+").cast("long").alias("upper"),
            _dropped(text, r"[0-9]+").cast("long").alias("digit"),
            _dropped(text, r"[!-/:-@\[-`{-~]+").cast("long").alias("marks"),
            _dropped(text, r"[^\x00-\x7F]+").cast("long").alias("other"),
            let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        ),
    )
    w, c = F.col("q_words"), F.col("q_chars")
    space = c.n - w.word_chars
    hist = [
        c.n - space - c.upper - c.digit - c.marks - c.other,
        c.upper,
        c.digit,
        c.n_symbols,
        c.marks - c.n_symbols,
        c.other,
        space,
    ]
    q = F.struct(
        w.n_words.alias("n_words"),
        w.word_chars.alias("word_chars"),
        c.n_symbols.alias("n_symbols"),
        c.n_dup_lines.alias("n_dup_lines"),
        w.n_repeat_words.alias("n_repeat_words"),
        c.n.alias("n_chars"),
        lang.alias("lang"),
        F.array(*hist).alias("chars"),
        F.concat(
            w.common, F.array(w.n_words - F.aggregate(w.common, F.lit(0).cast("long"), lambda n, x: n + x))
        ).alias("common"),
    )
    return first.withColumn("q", q).drop("q_words", "q_chars")


def base_failed(rules: QualityRules = QualityRules()) -> Column:
    q = F.col("q")
    return (q.n_words < rules.min_words) | (q.n_repeat_words * 100 > q.n_words * rules.max_repeat_percent)


def references(feats: DataFrame, rules: QualityRules = QualityRules()) -> dict:
    """Summed histograms by language, and of all: at most len(LANGS) + 1 rows reach the driver."""
    n = len(next(iter(COMMON_WORDS.values()))) + 1
    q = F.col("q")
    rows = (
        feats.filter(~base_failed(rules))
        .groupBy(q.lang.alias("lang"))
        .agg(
            *[F.sum(q.chars[i]).alias(f"c{i}") for i in range(len(CLASSES))],
            *[F.sum(q.common[i]).alias(f"w{i}") for i in range(n)],
        )
        .collect()
    )
    chars = {r["lang"]: [float(r[f"c{i}"] or 0) for i in range(len(CLASSES))] for r in rows}
    chars["all"] = [sum(x) for x in zip(*chars.values())] if chars else [0.0] * len(CLASSES)
    common = {r["lang"]: [float(r[f"w{i}"] or 0) for i in range(n)] for r in rows if r["lang"]}
    share = lambda h: [x / (sum(h) or 1.0) for x in h]
    return {"chars": {k or "none": share(h) for k, h in chars.items()}, "common": {k: share(h) for k, h in common.items()}}


def _distance(counts: Column, reference: Column) -> Column:
    """Jensen-Shannon distance, base 2, of a histogram of counts from a reference of shares."""

    def part(p, q):
        m = (p + q) / 2
        return F.when(p > 0, p * F.log2(p / m)).otherwise(0.0)

    return let(
        F.aggregate(counts, F.lit(0.0), lambda a, x: a + x.cast("double")),
        lambda total: F.sqrt(
            F.greatest(
                F.lit(0.0),
                F.aggregate(
                    F.zip_with(
                        counts,
                        reference,
                        lambda x, r: let(x.cast("double") / total, lambda p: (part(p, r) + part(r, p)) / 2),
                    ),
                    F.lit(0.0),
                    lambda a, x: a + x,
                ),
            )
        ),
    )


def judged(feats: DataFrame, refs: dict, rules: QualityRules = QualityRules()) -> DataFrame:
    """Adds base_failed, char_distance, word_distance (null where the guard holds it back) and kept."""
    q = F.col("q")
    literal = lambda m: F.create_map(
        *[x for k, h in sorted(m.items()) for x in (F.lit(k), F.array(*map(F.lit, h)))]
    )
    own = q.lang if refs["common"] else F.lit(None).cast("string")
    chars = F.coalesce(F.try_element_at(literal(refs["chars"]), own), F.array(*map(F.lit, refs["chars"]["all"])))
    out = feats.withColumn("base_failed", base_failed(rules)).withColumn(
        "char_distance", F.when(q.n_chars >= rules.char_min_chars, _distance(q.chars, chars))
    )
    common = F.try_element_at(literal(refs["common"]), own) if refs["common"] else F.lit(None).cast("array<double>")
    out = out.withColumn("word_distance", F.when(q.n_words >= rules.word_min_words, _distance(q.common, common)))
    far = F.coalesce(F.col("char_distance") > rules.char_distance, F.lit(False)) | F.coalesce(
        F.col("word_distance") > rules.word_distance + rules.word_noise / F.sqrt(q.n_words.cast("double")), F.lit(False)
    )
    return out.withColumn("kept", ~F.col("base_failed") & ~far)


def errors(judged_rows: DataFrame, labels: DataFrame) -> DataFrame:
    """(quality, rows, kept) of the labelled rows that pass the base rules: junk kept and clean dropped under the limits."""
    met = judged_rows.filter(~F.col("base_failed")).join(labels.select("doc_id", "quality"), "doc_id")
    return met.groupBy("quality").agg(F.count(F.lit(1)).alias("rows"), F.count_if("kept").alias("kept"))


def filter_quality(docs: DataFrame, rules: QualityRules = QualityRules()) -> DataFrame:
    """The documents that pass, with their own columns. The features are written once; the references are summed over them."""
    whole = docs.select(F.struct("*").alias("row"), "text", "lang")
    feats = save(features(whole).select("row", "q"))  # a filter over them would otherwise compute them again and again
    return judged(feats, references(feats, rules), rules).filter("kept").select("row.*")
