"""Queries over JSON documents: orders are videos, their lines are chunks; documents are written and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from moments.operators import documents as dc
from moments.plans.registry import query
from moments.plans.views import table

SCHEMAS = {
    "timeline": "policy string, duration_s double, chunks array<struct<start_ts:double,end_ts:double>>",
    "manifest": "samplers map<string,struct<prompts:array<string>>>, chunks array<struct<chunk_id:bigint,samplers:map<string,struct<frame_count:bigint>>>>",
    "descriptions": "fingerprints struct<timeline:string,manifest:string>, chunks array<struct<chunk_id:bigint,answers:map<string,struct<summary:string,structured:struct<mode:string,tags:array<string>>>>>>",
}
#: Every fourth order has no descriptions, every ninth timeline is cut short, every eleventh order was written twice.
LINES = """WITH l AS (SELECT l_orderkey AS k, l_linenumber AS n, l_quantity AS q, l_linestatus AS mode, l_returnflag AS flag, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_quantity, l_linestatus, l_returnflag) - 1 AS i FROM lineitem),
o AS (SELECT k, k::VARCHAR AS video_id, CASE WHEN k % 11 = 0 THEN 'scene' ELSE 'uniform' END AS policy, (count(*) * 10)::DOUBLE AS duration_s, count(*) AS n, k % 9 <> 0 AS ok FROM l GROUP BY k)"""


def _lines(spark, sf):
    li = table(spark, sf, "lineitem")
    item = F.struct("l_linenumber", "l_quantity", "l_linestatus", "l_returnflag")
    return li.groupBy(F.col("l_orderkey").alias("k")).agg(F.array_sort(F.collect_list(item)).alias("ls"))


def store(spark, sf):
    """The documents of all orders; timelines of every eleventh order were uniform before."""
    s = dc.DocumentStore(spark, SCHEMAS)
    lines = _lines(spark, sf)
    video = F.col("k").cast("string").alias("video_id")
    chunk = F.transform("ls", lambda x, i: F.struct((i * 10.0).alias("start_ts"), (i * 10.0 + 10).alias("end_ts")))

    def timeline(policy):
        whole = F.to_json(F.struct(F.lit(policy).alias("policy"), (F.size("ls") * 10.0).alias("duration_s"), chunk.alias("chunks")))
        return F.when(F.col("k") % 9 == 0, F.substring(whole, F.lit(1), F.length(whole) - 3)).otherwise(whole).alias("document")

    s.write("timeline", lines.select(video, timeline("uniform")))
    s.write("timeline", lines.filter("k % 11 = 0").select(video, timeline("scene")))
    prompts = F.create_map(F.lit("clip"), F.struct(F.array(F.lit("text"), F.lit("scene")).alias("prompts")), F.lit("uniform"), F.struct(F.array().cast("array<string>").alias("prompts")))
    runs = F.transform("ls", lambda x, i: F.struct(i.cast("long").alias("chunk_id"), F.when(
        x.l_returnflag == "N", F.create_map(F.lit("clip"), F.struct(x.l_quantity.cast("long").alias("frame_count")))
    ).otherwise(F.create_map(F.lit("clip"), F.struct(F.lit(1).cast("long").alias("frame_count")), F.lit("uniform"), F.struct(F.lit(2).cast("long").alias("frame_count")))).alias("samplers")))
    s.write("manifest", lines.select(video, F.to_json(F.struct(prompts.alias("samplers"), runs.alias("chunks"))).alias("document")))
    answer = lambda x, key: F.create_map(F.lit(key), F.struct(F.concat(F.lit("by "), x.l_linestatus).alias("summary"), F.struct(x.l_linestatus.alias("mode"), F.array(x.l_returnflag, F.lit("tag")).alias("tags")).alias("structured")))
    answers = F.transform("ls", lambda x, i: F.struct(i.cast("long").alias("chunk_id"), F.when(x.l_returnflag == "N", answer(x, "clip:text")).otherwise(answer(x, "uniform")).alias("answers")))
    prints = F.struct(F.concat(F.lit("t"), "k").alias("timeline"), F.concat(F.lit("m"), "k").alias("manifest"))
    s.write("descriptions", lines.filter("k % 4 <> 0").select(video, F.to_json(F.struct(prints.alias("fingerprints"), answers.alias("chunks"))).alias("document")))
    return s


@query(LINES + " SELECT video_id, policy, n AS chunks, CASE WHEN k % 4 <> 0 THEN n END AS answered FROM o WHERE ok")
def s1_document_context(spark, sf):
    met = store(spark, sf).context("timeline", ["manifest", "descriptions"])
    n = lambda c: F.size(c).cast("long")
    return met.select("video_id", "timeline.policy", n("timeline.chunks").alias("chunks"), F.when(F.col("descriptions").isNotNull(), n("descriptions.chunks")).alias("answered"))


@query(LINES + " SELECT video_id, i AS chunk_id, i * 10.0::DOUBLE AS start_ts, i * 10.0::DOUBLE + 10 AS end_ts, policy FROM l JOIN o USING (k) WHERE ok")
def s4_document_chunks(spark, sf):
    return dc.chunk_rows(store(spark, sf).read("timeline"))


@query(LINES + """ SELECT k::VARCHAR AS video_id, i AS chunk_id, 'clip' AS sampler, CASE WHEN flag = 'N' THEN q::BIGINT ELSE 1 END AS frame_count, ['text', 'scene'] AS questions FROM l
  UNION ALL SELECT k::VARCHAR, i, 'uniform', 2, ['uniform'] FROM l WHERE flag <> 'N'""")
def s6_document_runs(spark, sf):
    return dc.run_rows(store(spark, sf).read("manifest"))


@query(LINES + """ SELECT k::VARCHAR AS video_id, i AS chunk_id, CASE WHEN flag = 'N' THEN 'clip' ELSE 'uniform' END AS sampler, CASE WHEN flag = 'N' THEN 'text' ELSE 'uniform' END AS question, 'by ' || mode AS summary,
  mode, [flag, 'tag'] AS tags, 't' || k AS timeline, 'm' || k AS manifest FROM l WHERE k % 4 <> 0""")
def s7_document_answers(spark, sf):
    return dc.answer_rows(store(spark, sf).read("descriptions")).select("*", "structured.mode", "structured.tags").drop("structured")


@query(LINES + """ SELECT video_id, list_sort(['manifest', 'timeline'] || CASE WHEN k % 4 <> 0 THEN ['descriptions'] ELSE [] END) AS artifacts, CASE WHEN ok THEN policy END AS policy, CASE WHEN ok THEN n END AS chunks, CASE WHEN ok THEN duration_s END AS duration_s FROM o""")
def s18_document_inventory(spark, sf):
    d = F.col("document")
    return store(spark, sf).inventory("timeline", d.policy, F.when(d.isNotNull(), F.size(d.chunks)), d.duration_s)


@query(LINES + """ SELECT video_id, 'timeline' AS kind, CASE WHEN NOT ok THEN 'cannot be read' ELSE 'policy is not uniform' END AS problem FROM o WHERE NOT ok OR policy <> 'uniform'
  UNION ALL SELECT video_id, 'timeline', 'over five chunks' FROM o WHERE ok AND n > 5""")
def s23_document_problems(spark, sf):
    d = F.col("document")
    return store(spark, sf).problems("timeline", {"policy is not uniform": d.policy == "uniform", "over five chunks": F.size(d.chunks) <= 5})
