"""Queries over nested answers: each document is an answer to one of three questions, with texts, lists and entries."""

from __future__ import annotations

from pyspark.sql import functions as F

from moments.operators import answers as an
from moments.plans.registry import query
from moments.plans.views import table

SPEC = {
    "lang": an.Field(one_of=("en", "de", "fr")),
    "mood": an.Field(),
    "count": an.Field("number"),
    "tags": an.Field("list"),
    "people": an.Field("entries", of=("name", "wears", "does")),
}
#: The same JSON text in both dialects: entries lack a key here and there, moods are blank or missing.
_PEOPLE = """'{"name":"p' || (doc_id + i) % 11 || '"' || CASE WHEN (doc_id + i) % 3 = 0 THEN '' ELSE ',"wears":"c' || doc_id * i % 5 || '"' END || ',"does":"' || CASE WHEN i % 2 = 0 THEN 'walks ' ELSE ' ' END || '"}'"""
_JSON = """'{"lang":"' || lang || '"' || CASE WHEN doc_id % 5 = 0 THEN '' WHEN doc_id % 5 = 1 THEN ',"mood":" "' ELSE ',"mood":"m' || doc_id % 3 || '"' END || ',"count":' || n_chars ||
  ',"tags":["' || lang || '","","' || source || '"],"people":[' || %s || ']' || CASE WHEN doc_id %% 13 = 0 THEN ',"extra":{"deep":[1,{"x":"y"}]}' ELSE '' END || '}'"""
_DUCK = _JSON.replace("doc_id % ", "doc_id %% ") % f"array_to_string(list_transform(range(doc_id % 4), lambda i: {_PEOPLE}), ',')"
_SPARK = _JSON.replace("doc_id % ", "doc_id %% ") % f"array_join(transform(slice(sequence(0, 3), 1, cast(doc_id % 4 AS int)), i -> {_PEOPLE}), ',')"
ANSWERS = f"""WITH a AS (SELECT doc_id, source AS video_id, doc_id AS chunk_id, 's' || doc_id % 2 AS sampler, 'q' || doc_id % 3 AS question, CASE WHEN doc_id % 7 = 0 THEN ' ' ELSE left(text, 20) END AS summary,
  ({_DUCK})::JSON AS j FROM documents),
e AS (SELECT a.*, unnest(range(len(ps)))::BIGINT AS place, unnest(ps) AS p FROM (SELECT *, (j->'$.people')::JSON[] AS ps FROM a) a),
b AS (SELECT *, nullif(trim(summary, ' ' || chr(10)), '') AS prose, nullif(trim(j->>'$.mood'), '') AS mood,
  nullif(array_to_string(list_filter(list_transform((j->'$.tags')::VARCHAR[], lambda x: trim(x)), lambda x: x <> ''), ' | '), '') AS tags FROM a)"""
_TEXT = """coalesce(list_aggregate(list_filter(list_transform((j->'$.people')::JSON[], lambda p: concat_ws('; ', %s)), lambda x: x <> ''), 'string_agg', ' | '), '')"""
_KEY = "'{0} ' || nullif(trim(p->>'$.{0}'), '')"
_WHOLE = _TEXT % ", ".join(_KEY.format(k) for k in ("does", "name", "wears"))
_PICKED = _TEXT % ", ".join(_KEY.format(k) for k in ("name", "wears"))


def answers(spark, sf):
    d = table(spark, sf, "documents")
    mine = d.select(
        "doc_id", F.col("source").alias("video_id"), F.col("doc_id").alias("chunk_id"), F.expr("'s' || doc_id % 2").alias("sampler"), F.expr("'q' || doc_id % 3").alias("question"),
        F.expr("CASE WHEN doc_id % 7 = 0 THEN ' ' ELSE left(text, 20) END").alias("summary"), F.expr(_SPARK).alias("answer"),
    )
    return mine.withColumn("structured", an.parsed(F.col("answer"), SPEC))


@query(f"""{ANSWERS} SELECT doc_id, json_contains(j, '{{"tags":["en"],"people":[{{"name":"p3","does":"walks "}}]}}') AS has_walker, json_contains(j, '{{"extra":{{"deep":[{{"x":"y"}}]}}}}') AS has_deep,
  json_contains(j, '{{"people":[{{"name":"p1"}},{{"name":"p2"}}]}}') AS has_both FROM a""")
def f2_nested_containment(spark, sf):
    v = F.try_parse_json("answer")
    patterns = {
        "has_walker": {"tags": ["en"], "people": [{"name": "p3", "does": "walks "}]}, "has_deep": {"extra": {"deep": [{"x": "y"}]}},
        "has_both": {"people": [{"name": "p1"}, {"name": "p2"}]},
    }
    return answers(spark, sf).select("doc_id", *[an.contains(v, p).alias(k) for k, p in patterns.items()])


@query(f"""{ANSWERS} SELECT doc_id, concat_ws('. ', prose, 'count: ' || (j->>'$.count'), 'lang: ' || (j->>'$.lang'), 'mood: ' || mood, 'people: ' || nullif({_WHOLE}, ''), 'tags: ' || tags) AS content FROM b""")
def x2_nested_render(spark, sf):
    return answers(spark, sf).select("doc_id", an.render(F.col("summary"), F.col("structured"), SPEC).alias("content"))


@query(f"""{ANSWERS} SELECT doc_id, concat_ws('. ', 'mood: ' || mood, 'people: ' || nullif({_PICKED}, '')) AS nested, concat_ws('. ', prose, 'people: ' || nullif({_WHOLE}, '')) AS whole, coalesce(prose, '') AS prose_only FROM b""")
def f8_nested_projection(spark, sf):
    """Keys of entries, a whole field that beats its keys, and nothing picked."""
    text = lambda picks: an.render(F.col("summary"), F.col("structured"), SPEC, picks)
    return answers(spark, sf).select(
        "doc_id", text(["people.wears", "people.name", "mood"]).alias("nested"), text(["summary", "people.name", "people"]).alias("whole"), text([]).alias("prose_only")
    )


@query(f"""{ANSWERS} SELECT doc_id, list_filter([CASE WHEN prose IS NULL THEN 'summary: blank' END, CASE WHEN (j->>'$.lang') NOT IN ('en', 'de', 'fr') THEN 'lang: not one of the values' END,
  CASE WHEN (j->'$.mood') IS NULL THEN 'mood: missing' END, CASE WHEN len(list_filter((j->'$.people')::JSON[], lambda p: (p->'$.wears') IS NULL)) > 0 THEN 'people.wears: missing' END,
  CASE WHEN (j->'$.extra') IS NOT NULL THEN 'extra: unknown field' END], lambda x: x IS NOT NULL) AS problems FROM b""")
def x9_spec_conformance(spark, sf):
    return answers(spark, sf).select("doc_id", an.conformance(F.col("answer"), F.col("summary"), SPEC).alias("problems"))


_SIGN = "concat_ws('; ', nullif(trim(p->>'$.name'), ''), nullif(trim(p->>'$.wears'), ''))"


@query(f"""{ANSWERS} SELECT video_id, chunk_id, sampler AS source, 'people' AS field, place, {_SIGN} AS signature, p->>'$.does' AS does FROM e WHERE {_SIGN} <> ''
  UNION ALL SELECT video_id, chunk_id, sampler, 'tags', 0, tags, NULL FROM b WHERE tags IS NOT NULL
  UNION ALL SELECT video_id, chunk_id, sampler, 'summary', 0, prose, NULL FROM b WHERE prose IS NOT NULL""")
def l1_selected_mentions(spark, sf):
    """Entries by identity keys, whole values and prose; an entry keeps its other keys."""
    rows = answers(spark, sf).withColumn("source", F.col("sampler"))
    found = [an.mentions(rows, SPEC, "people", ("name", "wears")), an.mentions(rows, SPEC, "tags"), an.mentions(rows, SPEC, "summary")]
    both = found[0].unionByName(found[1]).unionByName(found[2])
    return both.withColumn("does", F.get_json_object("entry", "$.does")).drop("entry")


@query(f"""{ANSWERS}, t AS (SELECT *, CASE WHEN question = 'q1' THEN 0 WHEN sampler = 's1' AND question = 'q2' THEN 1 END AS pos, concat_ws('. ', prose, 'mood: ' || mood) AS text FROM b),
  u AS (SELECT video_id, chunk_id % 50 AS chunk_id, pos, sampler, question, text FROM t WHERE pos IS NOT NULL AND text <> '')
  SELECT video_id, chunk_id, string_agg(text, chr(10) ORDER BY pos, sampler, question, text) AS text FROM u GROUP BY ALL""")
def f7_selected_answers(spark, sf):
    """A question of any sampler, then one pair of sampler and question; several answers of a chunk stand in that order."""
    rows = answers(spark, sf).withColumn("chunk_id", F.col("chunk_id") % 50)
    return an.selected(rows, [an.Source(question="q1"), an.Source("s1", "q2")], ["summary", "mood"], SPEC)


_ASKED = [("i1", None, "q1", "mood"), ("i2", "s9", None, None), ("i3", "s0", "q7", "people.name"), ("i4", "s1", "q2", "people.age"), ("i5", None, None, "tags.x"), ("i6", None, None, "*"), ("i7", None, None, "shoes")]


@query("""SELECT 'i2' AS input, 'unknown sampler s9' AS problem WHERE NOT EXISTS (SELECT 1 FROM documents WHERE 's' || doc_id % 2 = 's9') UNION ALL SELECT 'i3', 'unknown question q7' WHERE NOT EXISTS (SELECT 1 FROM documents WHERE 'q' || doc_id % 3 = 'q7')
  UNION ALL SELECT 'i4', 'unknown key age of people' UNION ALL SELECT 'i5', 'tags has no keys' UNION ALL SELECT 'i7', 'unknown field shoes'""")
def f9_selection_problems(spark, sf):
    asked = spark.createDataFrame(_ASKED, "input string, sampler string, question string, pick string")
    return an.selection_problems(asked, answers(spark, sf), SPEC)


@query("""WITH i AS (SELECT s_suppkey AS input, 'nation:' || s_nationkey AS selector, CASE WHEN s_suppkey % 3 = 0 THEN [] WHEN s_suppkey % 3 = 1 THEN ['people.name', 'k ' || s_suppkey % 40] ELSE ['mood'] END AS picks FROM supplier),
  f AS (SELECT *, trim(regexp_replace(lower(array_to_string(picks, ' ')), '[^a-z0-9]+', '-', 'g'), '-') AS s, trim(regexp_replace(lower(selector), '[^a-z0-9]+', '-', 'g'), '-') AS t,
    trim(regexp_replace(lower(selector || ' ' || array_to_string(picks, ' ')), '[^a-z0-9]+', '-', 'g'), '-') AS again FROM i),
  l AS (SELECT *, CASE WHEN count(*) OVER (PARTITION BY coalesce(nullif(s, ''), t)) > 1 THEN again ELSE coalesce(nullif(s, ''), t) END AS label FROM f)
  SELECT input, label, 'themes-' || label AS id, count(*) OVER (PARTITION BY label) > 1 AS refused FROM l""")
def f10_input_ids(spark, sf):
    key = F.col("s_suppkey")
    none = F.array().cast("array<string>")
    picks = F.when(key % 3 == 0, none).when(key % 3 == 1, F.array(F.lit("people.name"), F.concat(F.lit("k "), (key % 40).cast("string")))).otherwise(F.array(F.lit("mood")))
    inputs = table(spark, sf, "supplier").select(key.alias("input"), F.concat(F.lit("nation:"), F.col("s_nationkey").cast("string")).alias("selector"), picks.alias("picks"))
    return an.input_ids(inputs, "themes")
