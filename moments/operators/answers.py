"""Nested answers: one field spec compiled to schema, projection, rendering, conformance, containment and mentions.

A model's answer is prose (``summary``) and a structured part, whose fields a spec names: a text, a list of texts, a number, a flag, or a list
of entries, each an object of texts. Answers are kept as JSON text; ``parsed`` reads them once by the schema of the spec, and all
else are Column expressions over the struct, so Spark prunes the nested columns that a query does not use.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLANKS = " \t\n\r\x0b\x0c"
PROSE = "summary"


@dataclass(frozen=True)
class Field:
    """kind: text, list, number, flag or entries. one_of: the values that texts may have. of: the keys of an entry."""

    kind: str = "text"
    one_of: tuple = ()
    of: tuple = ()

    def __post_init__(self):
        if self.kind not in ("text", "list", "number", "flag", "entries"):
            raise ValueError("kind must be text, list, number, flag or entries")
        if (self.kind == "entries") != bool(self.of):
            raise ValueError("entries, and only they, name their keys")
        if self.one_of and self.kind not in ("text", "list"):
            raise ValueError("one_of is for texts")

    @property
    def type(self) -> str:
        if self.kind == "entries":
            return f"array<struct<{', '.join(f'`{k}`: string' for k in self.of)}>>"
        return {"list": "array<string>", "flag": "boolean"}.get(self.kind, "string")


def schema(spec: dict[str, Field]) -> str:
    return f"struct<{', '.join(f'`{name}`: {f.type}' for name, f in spec.items())}>"


def parsed(answer: Column, spec: dict[str, Field]) -> Column:
    """The structured part as a struct; what is no JSON object is null, a field of another type too."""
    return F.from_json(answer, schema(spec), {"mode": "PERMISSIVE"})


def _said(text: Column) -> Column:
    return F.nullif(F.trim(text, F.lit(BLANKS)), F.lit(""))


def _entry(x: Column, keys) -> Column:
    """``key value`` of the keys with a value, in key order."""
    return F.nullif(F.concat_ws("; ", *[F.concat(F.lit(f"{k} "), _said(x[k])) for k in sorted(keys)]), F.lit(""))


def rendered(value: Column, field: Field, keys=None) -> Column:
    """A value as text, null if it is blank; keys: of an entry, those that count."""
    if field.kind == "flag":
        return F.initcap(value.cast("string"))
    if field.kind in ("text", "number"):
        return _said(value)
    one = _said if field.kind == "list" else lambda x: _entry(x, keys or field.of)
    return F.nullif(F.array_join(F.transform(value, one), " | "), F.lit(""))  # array_join leaves nulls out


def render(prose: Column | None, structured: Column, spec: dict[str, Field], picks: list[str] | None = None) -> Column:
    """One text of an answer: the prose, then each field with a value as ``name: value`` in the order of names, at every level.

    picks: "summary" is the prose, "*" every field, "field" one, "field.key" a key of the entries, of which those without any picked
    value go; a field picked whole stays whole. Without picks prose and all fields, with an empty list the prose alone."""
    picks = [PROSE, "*"] if picks is None else picks or [PROSE]
    whole = {p for p in picks if p in spec} | (set(spec) if "*" in picks else set())
    nested: dict[str, list[str]] = {}
    for p in picks:
        top, dot, key = p.partition(".")
        if dot and top in spec and top not in whole and spec[top].kind == "entries" and key in spec[top].of:
            nested.setdefault(top, []).append(key)
    parts = [_said(prose)] if prose is not None and PROSE in picks else []
    for name in sorted(whole | set(nested)):
        parts.append(F.concat(F.lit(f"{name}: "), rendered(structured[name], spec[name], nested.get(name))))
    return F.concat_ws(". ", *parts)


def pick_problems(picks: list[str], spec: dict[str, Field]) -> list[tuple[str, str]]:
    """(pick, problem) of what a selection names and the spec lacks."""
    out = []
    for p in picks:
        top, dot, key = p.partition(".")
        if p in (PROSE, "*"):
            continue
        if top not in spec:
            out.append((p, f"unknown field {top}"))
        elif dot and spec[top].kind != "entries":
            out.append((p, f"{top} has no keys"))
        elif dot and key not in spec[top].of:
            out.append((p, f"unknown key {key} of {top}"))
    return out


def _holds(pattern):
    return lambda x: F.coalesce(contains(x, pattern), F.lit(False))


def _is_not(kind: str):
    return lambda x: ~F.schema_of_variant(x).startswith(kind)


def _is_none_of(values):
    return lambda x: ~F.try_variant_get(x, "$", "string").isin(*values)


def _lacks(key: str):
    return lambda keys: ~F.array_contains(keys, key)


def _has_more(known):
    return lambda keys: F.size(F.array_except(keys, F.array(*map(F.lit, known)))) > 0


def contains(value: Column, pattern) -> Column:
    """Whether a VARIANT holds a pattern (of dicts, lists and plain values) at every level: an object all named keys, a list all named
    elements in any order, a plain value an equal one of its type. Null where the value is null."""
    if isinstance(pattern, dict):
        tests = [F.coalesce(contains(F.try_variant_get(value, f"$['{k}']", "variant"), v), F.lit(False)) for k, v in pattern.items()]
        return reduce(lambda a, b: a & b, tests, F.schema_of_variant(value).startswith("OBJECT"))
    if isinstance(pattern, (list, tuple)):
        items = F.try_variant_get(value, "$", "array<variant>")
        tests = [F.coalesce(F.exists(items, _holds(v)), F.lit(False)) for v in pattern]
        return reduce(lambda a, b: a & b, tests, F.schema_of_variant(value).startswith("ARRAY"))
    kind = F.schema_of_variant(value)
    if pattern is None:
        return kind == "VOID"
    if isinstance(pattern, bool):
        return (kind == "BOOLEAN") & (F.try_variant_get(value, "$", "boolean") == pattern)
    if isinstance(pattern, str):
        return (kind == "STRING") & (F.try_variant_get(value, "$", "string") == pattern)
    number = (kind == "BIGINT") | (kind == "DOUBLE") | (kind == "FLOAT") | kind.startswith("DECIMAL")
    return number & (F.try_variant_get(value, "$", "double") == float(pattern))


def conformance(answer: Column, prose: Column, spec: dict[str, Field]) -> Column:
    """Problems of an answer as an array of texts, in the order of the spec: no object, blank prose, fields that are missing, of another kind or
    unknown, texts that ``one_of`` does not list, entries that lack keys or have more."""
    value = F.try_parse_json(answer)
    no_object = ~F.coalesce(F.schema_of_variant(value).startswith("OBJECT"), F.lit(False))
    found = [F.when(_said(prose).isNull(), F.lit(f"{PROSE}: blank"))]
    for name, field in spec.items():
        x = F.try_variant_get(value, f"$['{name}']", "variant")
        kind = F.schema_of_variant(x)
        wanted = {"text": "STRING", "flag": "BOOLEAN", "list": "ARRAY", "entries": "ARRAY"}.get(field.kind)
        number = (kind == "BIGINT") | (kind == "DOUBLE") | kind.startswith("DECIMAL")
        fits = number if wanted is None else kind.startswith(wanted)
        problem = F.when(x.isNull(), F.lit(f"{name}: missing")).when(~fits, F.lit(f"{name}: not {field.kind}"))
        if field.kind in ("list", "entries"):
            items = F.try_variant_get(x, "$", "array<variant>")
            plain = "STRING" if field.kind == "list" else "OBJECT"
            problem = problem.when(F.exists(items, _is_not(plain)), F.lit(f"{name}: not all {'texts' if plain == 'STRING' else 'objects'}"))
        if field.one_of and field.kind == "text":
            problem = problem.when(~F.try_variant_get(x, "$", "string").isin(*field.one_of), F.lit(f"{name}: not one of the values"))
        if field.one_of and field.kind == "list":
            problem = problem.when(F.exists(items, _is_none_of(field.one_of)), F.lit(f"{name}: not one of the values"))
        found.append(problem)
        if field.kind == "entries":
            keys = F.transform(F.filter(items, lambda i: F.schema_of_variant(i).startswith("OBJECT")), lambda i: F.json_object_keys(F.to_json(i)))
            for key in field.of:
                found.append(F.when(F.exists(keys, _lacks(key)), F.lit(f"{name}.{key}: missing")))
            more = F.exists(keys, _has_more(field.of))
            found.append(F.when(more, F.lit(f"{name}: unknown keys")))
    unknown = F.array_sort(F.array_except(F.json_object_keys(answer), F.array(*map(F.lit, spec))))
    listed = F.array_compact(F.concat(F.array(*found), F.transform(unknown, lambda k: F.concat(k, F.lit(": unknown field")))))
    return F.when(no_object, F.array(F.lit("no object"))).otherwise(listed)


def mentions(answers: DataFrame, spec: dict[str, Field], field: str, keys: tuple = (), speech: DataFrame | None = None) -> DataFrame:
    """(video_id, chunk_id, source, field, place, signature, entry): what a link profile's selection finds.

    answers: (video_id, chunk_id, source, summary, structured struct). With keys, each entry of a list field that has a value in one of
    them, signed by those values; without, the field's whole value or the prose ("summary"), one mention an answer; "transcript" takes
    speech (video_id, chunk_id, text). Blank signatures are no mention."""
    place = ["video_id", "chunk_id"]
    whole = lambda said: F.to_json(F.map_from_arrays(F.array(F.lit(field)), F.array(said)))
    if field == "transcript":
        if speech is None:
            raise ValueError("mentions of the transcript need speech")
        said = _said(F.col("text"))
        rows = speech.select(*place, F.lit("transcript").alias("source"), F.lit(0).alias("place"), said.alias("signature"), whole(said).alias("entry"))
    elif keys:
        if spec[field].kind != "entries" or set(keys) - set(spec[field].of):
            raise ValueError(f"{field} has no entries with these keys")
        x = F.col("x")
        sign = F.nullif(F.concat_ws("; ", *[_said(x[k]) for k in keys]), F.lit(""))
        rows = answers.select(*place, "source", F.posexplode(F.col("structured")[field]).alias("place", "x")).select(
            *place, "source", "place", sign.alias("signature"), F.to_json("x").alias("entry")
        )
    else:
        said = _said(F.col("summary")) if field == PROSE else rendered(F.col("structured")[field], spec[field])
        rows = answers.select(*place, "source", F.lit(0).alias("place"), said.alias("signature"), whole(said).alias("entry"))
    return rows.filter("signature IS NOT NULL").select(*place, "source", F.lit(field).alias("field"), F.col("place").cast("long").alias("place"), "signature", "entry")


@dataclass(frozen=True)
class Source:
    """What answers a selection takes: all of a sampler, all of a question, a pair of both, or (neither) every one."""

    sampler: str | None = None
    question: str | None = None

    @property
    def label(self) -> str:
        return "*" if not (self.sampler or self.question) else f"{self.sampler}:{self.question or '*'}" if self.sampler else self.question

    def matches(self) -> Column:
        tests = [F.col(c) == v for c, v in (("sampler", self.sampler), ("question", self.question)) if v is not None]
        return reduce(lambda a, b: a & b, tests, F.lit(True))


def selected(answers: DataFrame, sources: list[Source], picks: list[str] | None, spec: dict[str, Field], speech: DataFrame | None = None) -> DataFrame:
    """(video_id, chunk_id, text): what a selection reads of each chunk, the parts in the order of its sources, then of sampler and question. answers:
    (video_id, chunk_id, sampler, question, summary, structured). speech (video_id, chunk_id, text) comes last; chunks
    with nothing are left out."""
    order = F.coalesce(*[F.when(s.matches(), F.lit(i)) for i, s in enumerate(sources)]) if sources else F.lit(None).cast("int")
    text = render(F.col("summary"), F.col("structured"), spec, picks)
    parts = answers.withColumn("_at", order).filter("_at IS NOT NULL").select("video_id", "chunk_id", "_at", "sampler", "question", text.alias("text"))
    if speech is not None:
        said = _said(F.col("text"))
        parts = parts.unionByName(speech.select("video_id", "chunk_id", F.lit(len(sources)).alias("_at"), F.lit("").alias("sampler"), F.lit("").alias("question"), said.alias("text")))
    item = F.array_sort(F.collect_list(F.struct("_at", "sampler", "question", "text")))
    kept = parts.filter("text <> ''").groupBy("video_id", "chunk_id").agg(item.alias("items"))
    return kept.select("video_id", "chunk_id", F.array_join(F.transform("items", lambda x: x.text), "\n").alias("text"))


def selection_problems(asked: DataFrame, answers: DataFrame, spec: dict[str, Field]) -> DataFrame:
    """(input, problem) of asked (input, sampler, question, pick), nulls where a part is not named: samplers, questions and pairs that no answer has, and fields
    and keys that the spec lacks."""
    known = answers.select("sampler", "question").distinct()
    samplers, questions = known.select("sampler").distinct(), known.select("question").distinct()
    row = asked.select("input", "sampler", "question").distinct()
    bad = lambda df, text: df.select("input", text.alias("problem"))
    out = bad(row.filter("sampler IS NOT NULL").join(samplers, "sampler", "left_anti"), F.concat(F.lit("unknown sampler "), "sampler"))
    out = out.unionByName(bad(row.filter("question IS NOT NULL").join(questions, "question", "left_anti"), F.concat(F.lit("unknown question "), "question")))
    both = row.filter("sampler IS NOT NULL AND question IS NOT NULL").join(samplers, "sampler", "left_semi").join(questions, "question", "left_semi")
    out = out.unionByName(bad(both.join(known, ["sampler", "question"], "left_anti"), F.concat(F.lit("no answer of "), "sampler", F.lit(" to "), "question")))
    top, key = F.substring_index("pick", ".", 1), F.when(F.contains("pick", F.lit(".")), F.regexp_extract("pick", r"\.(.*)", 1))
    names = F.create_map(*[x for n, f in spec.items() for x in (F.lit(n), F.array(*map(F.lit, f.of)).cast("array<string>"))])
    has = F.try_element_at(names, top)
    problem = (
        F.when(F.col("pick").isin(PROSE, "*"), None).when(has.isNull(), F.concat(F.lit("unknown field "), top))
        .when(key.isNotNull() & (F.size(has) == 0), F.concat(top, F.lit(" has no keys")))
        .when(key.isNotNull() & ~F.array_contains(has, F.coalesce(key, F.lit(""))), F.concat(F.lit("unknown key "), key, F.lit(" of "), top))
    )
    return out.unionByName(asked.filter("pick IS NOT NULL").select("input", problem.alias("problem")).filter("problem IS NOT NULL").distinct())


def slug(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"[^a-z0-9]+", "-"), F.lit("-"))


def input_ids(inputs: DataFrame, base: str) -> DataFrame:
    """(input, label, id, refused) of inputs (input, selector, picks array): a single input keeps the base id. Others get base and a label: the slug of
    their picks, or of the selector where nothing is picked; labels that meet are made anew from the selector and the picks, and those that still meet are refused."""
    n = inputs.agg(F.count(F.lit(1)).alias("n"))
    first = F.coalesce(F.nullif(slug(F.array_join("picks", " ")), F.lit("")), slug(F.col("selector")))
    again = slug(F.concat_ws(" ", "selector", F.array_join("picks", " ")))
    rows = inputs.select("input", first.alias("first"), again.alias("again"))
    met = rows.join(rows.groupBy("first").agg(F.count(F.lit(1)).alias("same")), "first")
    met = met.withColumn("label", F.when(F.col("same") > 1, F.col("again")).otherwise(F.col("first")))
    met = met.join(met.groupBy("label").agg(F.count(F.lit(1)).alias("left")), "label").join(F.broadcast(n), F.lit(True))
    single = F.col("n") == 1
    return met.select(
        "input", F.when(single, F.lit("")).otherwise(F.col("label")).alias("label"),
        F.when(single, F.lit(base)).otherwise(F.concat_ws("-", F.lit(base), "label")).alias("id"), (~single & (F.col("left") > 1)).alias("refused"),
    )

