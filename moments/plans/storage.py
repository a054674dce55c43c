"""Queries over keyed tables, flattened documents, units and selections."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from moments.functions import text as tx
from moments.operators import grid as g
from moments.operators import store as so
from moments.operators.folder import new_folder
from moments.plans.grid import PLACED, _grid
from moments.plans.registry import query
from moments.plans.views import DAY, GRID, frames, sql, table

ORD = "o_orderkey, o_custkey, o_orderstatus, o_totalprice"


def _orders(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")


@query("SELECT c_custkey, c_mktsegment, n, total FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1) ON o_custkey = c_custkey")
def s1_context_with_missing(spark, sf):
    """The required document with the optional one; a missing artifact is null."""
    o = table(spark, sf, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))
    c = table(spark, sf, "customer").select("c_custkey", "c_mktsegment")
    return c.join(o, c["c_custkey"] == o["o_custkey"], "left").drop("o_custkey")


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice, o_orderstatus FROM orders")
def s2_partition_overwrite(spark, sf):
    """Atomic rewrite of one partition: dynamic overwrite leaves the others alone."""
    path = new_folder(spark)
    o = table(spark, sf, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus")
    o.write.partitionBy("o_orderstatus").parquet(path)
    again = o.filter("o_orderstatus = 'F'").withColumn("o_totalprice", F.col("o_totalprice") + 1)
    again.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("o_orderstatus").parquet(path)
    return spark.read.parquet(path)


@query("""SELECT 'parquet' AS sink, true AS written, count(*) AS rows, sum(o_orderkey)::BIGINT AS keys FROM orders UNION ALL SELECT 'json', true, count(*), sum(o_orderkey)::BIGINT FROM orders
  UNION ALL SELECT 'broken', false, 0, 0""")
def s3_fan_out(spark, sf):
    """One result to several sinks, computed once: the first must succeed, the others are best-effort; the report counts what
    each holds."""
    o, at = _orders(spark, sf), new_folder(spark, "sinks")

    def broken(df):
        raise OSError("no such store")

    sinks = {k: (lambda df, k=k: df.write.format(k).save(f"{at}/{k}")) for k in ("parquet", "json")} | {"broken": broken}
    report = so.fan_out(o, sinks)
    held = [
        spark.read.format(k).schema(o.schema).load(f"{at}/{k}").agg(F.lit(k).alias("sink"), F.count(F.lit(1)).alias("rows"), F.sum("o_orderkey").alias("keys"))
        for k in ("parquet", "json")
    ]
    return report.select("sink", "written").join(held[0].unionByName(held[1]), "sink", "left").fillna(0, ["rows", "keys"])


def _timelines(spark, sf):
    spans = F.array_sort(F.collect_list(F.struct("chunk_id", "start_ts", "end_ts")))
    return _grid(spark, sf).groupBy("video_id").agg(spans.alias("spans"), F.lit("uniform").alias("policy"))


@query(sql(" SELECT video_id, chunk_id, start_ts, end_ts, 'uniform' AS policy, count(*) OVER (PARTITION BY video_id) AS chunk_count FROM chunks", GRID))
def s4_flatten_timeline(spark, sf):
    t = _timelines(spark, sf)
    return t.select("video_id", "policy", F.size("spans").cast("long").alias("chunk_count"), F.posexplode("spans").alias("pos", "s")).select(
        "video_id", F.col("pos").cast("long").alias("chunk_id"), "s.start_ts", "s.end_ts", "policy", "chunk_count"
    )


@query("SELECT CAST(conv_id AS VARCHAR) AS video_id, turn AS pos, length(text) AS chars, count(*) OVER (PARTITION BY conv_id) AS chunks FROM conversations")
def s5_flatten_transcript(spark, sf):
    c = table(spark, sf, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("chunks"))
    return c.select(F.col("conv_id").cast("string").alias("video_id"), F.size("chunks").cast("long").alias("n"), F.explode("chunks").alias("c")).select(
        "video_id", F.col("c.turn").alias("pos"), F.length("c.text").alias("chars"), F.col("n").alias("chunks")
    )


QUESTIONS = "(VALUES ('click', ['what', 'who']), ('view', ['view'])) q(s, questions)"


def _questions(spark, sf):
    names = frames(spark, sf).select("sampler_id").distinct()
    listed = F.when(F.col("sampler_id") == "click", F.array(F.lit("what"), F.lit("who"))).when(F.col("sampler_id") == "view", F.array(F.lit("view")))
    return names.select("sampler_id", listed.alias("questions")).filter("questions is not null")


@query(sql(f""" SELECT video_id, chunk_id, sampler_id, count(*) AS frames, coalesce(any_value(questions), [sampler_id]) AS questions FROM placed LEFT JOIN {QUESTIONS} ON s = sampler_id
  GROUP BY video_id, chunk_id, sampler_id""", GRID, PLACED))
def s6_flatten_manifest(spark, sf):
    """One row a (chunk, sampler run) with its questions; a run without any asks the one of its name."""
    placed = g.point_join(frames(spark, sf), _grid(spark, sf), "media_ts", DAY)
    runs = placed.groupBy("video_id", "chunk_id", "sampler_id").agg(F.count(F.lit(1)).alias("frames"))
    return runs.join(_questions(spark, sf), "sampler_id", "left").withColumn("questions", F.coalesce("questions", F.array("sampler_id")))


@query("SELECT doc_id, k AS answer, v AS said, left(sha256(coalesce(text, '')), 16) AS fingerprint FROM documents, (SELECT unnest(['lang', 'source']) AS k) CROSS JOIN LATERAL (SELECT CASE k WHEN 'lang' THEN lang ELSE source END AS v)")
def s7_flatten_descriptions(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", tx.fingerprint(F.col("text")).alias("fingerprint"), F.create_map(F.lit("lang"), "lang", F.lit("source"), "source").alias("answers"))
    return d.select("doc_id", "fingerprint", F.explode("answers").alias("answer", "said"))


@query(sql(" SELECT video_id, duration_s, duration_s IS NOT NULL AS has_duration, (SELECT count(*) FROM frames f WHERE f.video_id = media.video_id AND score >= 60) AS cuts FROM media"))
def s8_flatten_media_and_cuts(spark, sf):
    f = frames(spark, sf)
    return f.groupBy("video_id").agg(F.max("media_ts").alias("duration_s"), F.count_if(F.col("score") >= 60).alias("cuts")).withColumn("has_duration", F.col("duration_s").isNotNull())


@query("SELECT o_custkey AS entity, o_orderkey AS mention, o_orderstatus AS field, count(*) OVER (PARTITION BY o_custkey) AS appearances FROM orders")
def s9_flatten_entities(spark, sf):
    o = table(spark, sf, "orders").groupBy("o_custkey").agg(F.collect_list(F.struct("o_orderkey", "o_orderstatus")).alias("mentions"))
    return o.select(F.col("o_custkey").alias("entity"), F.size("mentions").cast("long").alias("appearances"), F.explode("mentions").alias("m")).select(
        "entity", F.col("m.o_orderkey").alias("mention"), F.col("m.o_orderstatus").alias("field"), "appearances"
    )


NEW = "SELECT o_orderkey + 5000 AS o_orderkey, o_custkey, 'N' AS o_orderstatus, o_totalprice FROM orders WHERE o_orderstatus = 'O'"


def _new(spark, sf):
    return _orders(spark, sf).filter("o_orderstatus = 'O'").withColumn("o_orderkey", F.col("o_orderkey") + 5000).withColumn("o_orderstatus", F.lit("N"))


@query(f"WITH n AS ({NEW}) SELECT {ORD} FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM n) UNION ALL SELECT {ORD} FROM n")
def s10_keyed_upsert(spark, sf):
    return so.upsert(_orders(spark, sf), _new(spark, sf), ["o_orderkey"])


@query(sql(" SELECT p.video_id, p.idx, p.chunk_id FROM placed p WHERE p.chunk_id < (SELECT count(*) FROM chunks c WHERE c.video_id = p.video_id AND c.start_ts < 1000000)", GRID, PLACED))
def s11_delete_stale_chunks(spark, sf):
    chunks = _grid(spark, sf)
    rows = g.point_join(frames(spark, sf), chunks, "media_ts", DAY).select("video_id", "idx", "chunk_id")
    return so.delete_stale_chunks(rows, chunks.filter("start_ts < 1000000"))


@query(f"SELECT {ORD} FROM orders WHERE o_orderstatus <> 'F' OR o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def s12_delete_except(spark, sf):
    keep = table(spark, sf, "customer").filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return so.delete_except(_orders(spark, sf), F.col("o_orderstatus") == "F", "o_custkey", keep)


@query(f"SELECT {ORD} FROM orders WHERE NOT (o_orderstatus = 'F' AND o_custkey = 7)")
def s13_delete_where(spark, sf):
    return so.delete_where(_orders(spark, sf), o_orderstatus="F", o_custkey=7)


@query("""WITH p AS (SELECT o_orderkey AS k FROM orders WHERE o_orderstatus = 'O') SELECT 'frames' AS t, l_orderkey AS k, l_linenumber AS line FROM lineitem WHERE l_orderkey IN (SELECT k FROM p)
  UNION ALL SELECT 'paid', l_orderkey, l_linenumber FROM lineitem""")
def s14_cascade(spark, sf):
    li = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("line"))
    parents = table(spark, sf, "orders").filter("o_orderstatus = 'O'").select(F.col("o_orderkey").alias("k"))
    out = so.cascade({"frames": li, "paid": li}, parents, "k", ["frames"])
    return out["frames"].select(F.lit("frames").alias("t"), "k", "line").unionByName(out["paid"].select(F.lit("paid").alias("t"), "k", "line"))


@query("SELECT c_mktsegment AS name, left(sha256(c_name), 12) AS version FROM customer")
def s15_versioned_provenance(spark, sf):
    v = table(spark, sf, "customer").select(F.col("c_mktsegment").alias("name"), tx.fingerprint(F.col("c_name"), 12).alias("version"))
    return so.append_versions(v, v, ["name", "version"])


@query("""SELECT o_orderkey, o_custkey, o_totalprice, count(*) OVER () AS total FROM orders WHERE o_totalprice > 1000 AND o_orderpriority ILIKE '%high%' ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 10""")
def s16_browse(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority")
    filters = [("o_totalprice", "gt", 1000), ("o_orderpriority", "ilike", "%high%"), ("o_custkey", "eq", "")]
    return so.browse(o, filters, [F.desc("o_totalprice"), "o_orderkey"], 20, 10).drop("o_orderpriority")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 50 OFFSET 100")
def k5_paged_browse(spark, sf):
    return so.browse(table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), (), ["o_totalprice", "o_orderkey"], 50, 100).drop("total")


@query("""SELECT 'customer' AS "table", count(*) AS rows FROM customer UNION ALL SELECT 'documents', count(*) FROM documents UNION ALL SELECT 'events', count(*) FROM events""")
def s17_row_counts(spark, sf):
    return so.row_counts({n: table(spark, sf, n) for n in ("customer", "documents", "events")})


@query("""SELECT k, list_sort(list(DISTINCT a)) AS artifacts FROM (SELECT c_custkey AS k, 'media' AS a FROM customer UNION ALL SELECT o_custkey, 'timeline' FROM orders UNION ALL SELECT user_id, 'manifest' FROM events) GROUP BY k""")
def s18_inventory(spark, sf):
    kinds = {"media": ("customer", "c_custkey"), "timeline": ("orders", "o_custkey"), "manifest": ("events", "user_id")}
    return so.inventory({n: table(spark, sf, t).select(F.col(c).alias("k")) for n, (t, c) in kinds.items()}, "k")


@query("SELECT l_orderkey AS video_id, l_linenumber AS idx, min((l_partkey, l_suppkey))[1] AS part FROM lineitem GROUP BY ALL")
def s19_distinct_frames(spark, sf):
    """The first record of each (video, index) wins."""
    first = F.row_number().over(W.partitionBy("l_orderkey", "l_linenumber").orderBy("l_partkey", "l_suppkey"))
    li = table(spark, sf, "lineitem").withColumn("n", first).filter("n = 1")
    return li.select(F.col("l_orderkey").alias("video_id"), F.col("l_linenumber").alias("idx"), F.col("l_partkey").alias("part"))


@query("""WITH a AS (SELECT page_id + 3 AS k, CASE WHEN length(html) > 3000 THEN html ELSE 'x' END AS h FROM pages), b AS (SELECT page_id AS k, html AS h FROM pages)
  SELECT count(*) FILTER (a.k IS NOT NULL AND b.k IS NOT NULL) AS compared, count(*) FILTER (a.h = b.h) AS identical, count(*) FILTER (a.h <> b.h) AS differing,
  count(*) FILTER (a.k IS NULL) AS missing, count(*) FILTER (b.k IS NULL) AS orphaned FROM a FULL OUTER JOIN b ON a.k = b.k""")
def s20_compare_stores(spark, sf):
    b = table(spark, sf, "pages").select(F.col("page_id").alias("k"), F.col("html").alias("h"))
    a = b.select((F.col("k") + 3).alias("k"), F.when(F.length("h") > 3000, F.col("h")).otherwise(F.lit("x")).alias("h"))
    return so.compare_stores(a, b, "k", "h")


@query("""SELECT o_orderkey AS k, 'status' AS attribute, o_orderstatus AS source, CASE WHEN o_orderkey % 3 = 0 THEN 'F' END AS manifest FROM orders WHERE o_orderkey % 3 = 0 AND o_orderstatus <> 'F'""")
def s21_source_check(spark, sf):
    """Unknown on either side is no mismatch."""
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("status"), "o_custkey")
    m = o.select("k", F.when(F.col("k") % 3 == 0, F.lit("F")).alias("status"), "o_custkey")
    return so.attribute_mismatches(o, m, "k", ["status", "o_custkey"])


@query("SELECT page_id FROM pages WHERE page_id NOT IN (SELECT item_id FROM benchmark)")
def s22_prune_store(spark, sf):
    return so.stale(table(spark, sf, "pages"), table(spark, sf, "benchmark").select(F.col("item_id").alias("page_id")), ["page_id"])


@query("""SELECT event_id, 'v is missing' AS problem FROM events UNION ALL SELECT event_id, 'k is no BOOLEAN' FROM events""")
def s23_validate(spark, sf):
    e = table(spark, sf, "events")
    return so.validate(e, "event_id", "props", {"v": "STRING", "k": "BIGINT"}).unionByName(so.validate(e, "event_id", "props", {"k": "BOOLEAN"}))


@query("SELECT doc_id FROM documents d JOIN labels l USING (doc_id) WHERE d.lang = 'en' AND l.quality = 1")
def f2_containment(spark, sf):
    """Every requested value is present; a list means all of its elements."""
    d = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id")
    have = F.array("lang", F.col("quality").cast("string"))
    return d.filter(F.forall(F.array(F.lit("en"), F.lit("1")), lambda x: F.array_contains(have, x))).select("doc_id")


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus IN ('F', 'O') AND o_totalprice >= 500 AND o_orderpriority LIKE '%H%' AND o_custkey <> 3 AND o_orderdate IS NOT NULL")
def f3_browse_predicates(spark, sf):
    o = table(spark, sf, "orders")
    rules = [("o_orderstatus", "in", "F, O"), ("o_totalprice", "gte", 500), ("o_orderpriority", "like", "%H%"), ("o_custkey", "neq", 3), ("o_totalprice", "lt", "")]
    kept = o
    for name, op, value in rules:
        kept = kept if value == "" else kept.filter(so.OPERATORS[op](F.col(name), value))
    return kept.filter(~so.OPERATORS["is"](F.col("o_orderdate"), None)).select("o_orderkey")


def _answers(spark, sf):
    e = table(spark, sf, "events")
    return e.select(F.col("event_id"), F.col("user_id").cast("string").alias("video_id"), F.col("event_type").alias("sampler"), F.when(F.col("event_id") % 3 == 0, F.lit("text")).otherwise(F.col("event_type")).alias("question"), "props")


@query("""SELECT event_id, pos FROM (SELECT event_id, event_type AS s, CASE WHEN event_id % 3 = 0 THEN 'text' ELSE event_type END AS q FROM events)
  JOIN (VALUES (0, '*', 'text'), (1, 'click', 'click'), (2, 'view', '*')) x(pos, xs, xq) ON (xs = '*' OR xs = s) AND (xq = '*' OR xq = q)""")
def f7_selection(spark, sf):
    """A list of (sampler, question) sources, * for any, in order: a question of any sampler, a pairing, a whole sampler."""
    a = _answers(spark, sf)
    sources = [("*", "text"), ("click", "click"), ("view", "*")]
    hit = [
        F.when((F.lit(s == "*") | (F.col("sampler") == s)) & (F.lit(q == "*") | (F.col("question") == q)), F.lit(i)) for i, (s, q) in enumerate(sources)
    ]
    return a.select("event_id", F.explode(F.array_compact(F.array(*hit))).alias("pos"))


@query("""SELECT event_id, CAST(json_extract(props, '$.k') AS INT) AS k FROM events""")
def f8_field_projection(spark, sf):
    v = F.try_variant_get(F.try_parse_json("props"), "$.k", "int")
    return table(spark, sf, "events").select("event_id", v.alias("k"))


@query("""SELECT DISTINCT x.s AS sampler, x.q AS question FROM (VALUES ('click', 'click'), ('click', 'nothing'), ('nobody', 'text')) x(s, q)
  WHERE NOT EXISTS (SELECT 1 FROM (SELECT event_type AS s, CASE WHEN event_id % 3 = 0 THEN 'text' ELSE event_type END AS q FROM events) e WHERE e.s = x.s AND e.q = x.q)""")
def f9_selection_check(spark, sf):
    """Sources that the vocabulary of the data does not know."""
    known = _answers(spark, sf).select("sampler", "question").distinct()
    asked = spark.createDataFrame([("click", "click"), ("click", "nothing"), ("nobody", "text")], "sampler string, question string")
    return asked.join(known, ["sampler", "question"], "left_anti")


@query("""SELECT p_partkey, left(trim(regexp_replace(lower(p_name), '[^a-z0-9]+', '_', 'g'), '_'), 48) AS label, count(*) OVER (PARTITION BY left(trim(regexp_replace(lower(p_name), '[^a-z0-9]+', '_', 'g'), '_'), 48)) AS same FROM part""")
def f10_input_labels(spark, sf):
    """Slug labels (X19), and how many inputs share one."""
    p = table(spark, sf, "part").select("p_partkey", tx.slug(F.col("p_name")).alias("label"))
    return p.withColumn("same", F.count(F.lit(1)).over(W.partitionBy("label")))


@query("""SELECT CAST(user_id AS VARCHAR) AS video_id, list_sort(list(DISTINCT event_type)) AS sources, CASE WHEN NOT list_contains(list(event_type), 'purchase') THEN 'no purchase' END AS skip FROM events GROUP BY user_id""")
def f11_sources_of_video(spark, sf):
    s = frames(spark, sf).groupBy("video_id").agg(F.array_sort(F.collect_set("sampler_id")).alias("sources"))
    return s.withColumn("skip", F.when(~F.array_contains("sources", "purchase"), F.lit("no purchase")))


@query("SELECT 'lang' AS field, lang AS value, count(*) AS n FROM documents GROUP BY lang UNION ALL SELECT 'source', source, count(*) FROM documents GROUP BY source")
def f12_facets(spark, sf):
    d = table(spark, sf, "documents")
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("value")) for c in ("lang", "source")]))
    return d.select(pairs.alias("p")).groupBy("p.field", "p.value").agg(F.count(F.lit(1)).alias("n"))


PLAN = f"""asked AS (SELECT video_id, chunk_id, sampler_id, unnest(coalesce(questions, [sampler_id])) AS question FROM (SELECT DISTINCT video_id, chunk_id, sampler_id FROM placed) LEFT JOIN {QUESTIONS} ON s = sampler_id),
plan AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY chunk_id, sampler_id, question) AS place FROM asked WHERE NOT (question = 'who' AND chunk_id < 5)) WHERE place <= 40)"""


def _plan(spark, sf):
    placed = g.point_join(frames(spark, sf), _grid(spark, sf), "media_ts", DAY)
    done = placed.filter("chunk_id < 5").select("video_id", "chunk_id", "sampler_id", F.lit("who").alias("question")).distinct()
    return so.planned(placed, _questions(spark, sf), done, 40)


@query(sql(" SELECT video_id, chunk_id, sampler_id, question, place FROM plan", GRID, PLACED, PLAN))
def f13_answers_to_plan(spark, sf):
    return _plan(spark, sf).drop("frames")


@query(sql(" SELECT video_id, chunk_id, CASE WHEN sampler_id = question THEN sampler_id ELSE sampler_id || ':' || question END AS answer_id FROM plan", GRID, PLACED, PLAN))
def f14_answer_ids(spark, sf):
    return _plan(spark, sf).select("video_id", "chunk_id", so.answer_id(F.col("sampler_id"), F.col("question")).alias("answer_id"))


@query(sql(" SELECT c.video_id, c.chunk_id, count(p.idx) AS frames, max(score) AS top FROM chunks c LEFT JOIN placed p ON p.video_id = c.video_id AND p.chunk_id = c.chunk_id GROUP BY ALL", GRID, PLACED))
def j1_grid_context(spark, sf):
    chunks = _grid(spark, sf)
    seen = g.point_join(frames(spark, sf), chunks, "media_ts", DAY).groupBy("video_id", "chunk_id").agg(F.count(F.lit(1)).alias("frames"), F.max("score").alias("top"))
    return chunks.select("video_id", "chunk_id").join(seen, ["video_id", "chunk_id"], "left").fillna(0, ["frames"])


HASH = "left(sha256(coalesce(text, '')), 16)"
STORED = f"SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'old' ELSE {HASH} END AS text_hash FROM documents WHERE doc_id % 7 <> 0 UNION ALL SELECT doc_id + 10000000, 'gone' FROM documents WHERE doc_id % 11 = 0"


def _current(spark, sf):
    return table(spark, sf, "documents").select("doc_id", tx.fingerprint(F.col("text")).alias("text_hash"))


def _stored(spark, sf):
    """An index as it might stand: some rows old, some missing, some vanished from the corpus."""
    c = _current(spark, sf)
    old = c.filter("doc_id % 7 <> 0").withColumn("text_hash", F.when(F.col("doc_id") % 5 == 0, F.lit("old")).otherwise(F.col("text_hash")))
    gone = c.filter("doc_id % 11 = 0").select((F.col("doc_id") + 10000000).alias("doc_id"), F.lit("gone").alias("text_hash"))
    return old.unionByName(gone)


@query(f"SELECT doc_id, {HASH} AS text_hash FROM documents WHERE doc_id % 7 = 0 OR doc_id % 5 = 0")
def j11_changed_units(spark, sf):
    return so.changed(_current(spark, sf), _stored(spark, sf), ["doc_id"])


@query("SELECT doc_id + 10000000 AS doc_id FROM documents WHERE doc_id % 11 = 0")
def u3_stale_keys(spark, sf):
    return so.stale(_stored(spark, sf), _current(spark, sf), ["doc_id"])


@query(f"SELECT doc_id, {HASH} AS text_hash FROM documents")
def r8_incremental_index(spark, sf):
    return so.maintain(_stored(spark, sf), _current(spark, sf), ["doc_id"], lambda changed: changed)


@query(sql(" SELECT video_id, idx FROM frames WHERE idx NOT IN (SELECT page_id FROM pages)"))
def j12_missing_frames(spark, sf):
    """Frames that the manifest names and the store lacks."""
    return frames(spark, sf).select("video_id", "idx").join(table(spark, sf, "pages").select(F.col("page_id").alias("idx")), "idx", "left_anti")


@query(f"SELECT doc_id, {HASH} AS text_hash FROM documents WHERE doc_id % 7 <> 0 AND doc_id % 5 <> 0")
def j13_resumable_answers(spark, sf):
    return so.resumable(_stored(spark, sf), _current(spark, sf), ["doc_id"], ["text_hash"])


@query(f"SELECT doc_id, {HASH} AS text_hash, doc_id % 7 <> 0 AND doc_id % 5 <> 0 AS reused FROM documents")
def j14_answer_reuse(spark, sf):
    s = _stored(spark, sf).select("doc_id", F.col("text_hash").alias("made"))
    return _current(spark, sf).join(s, "doc_id", "left").select("doc_id", "text_hash", F.coalesce(F.col("made") == F.col("text_hash"), F.lit(False)).alias("reused"))


@query(f"SELECT doc_id, {HASH} AS expected, 'old' AS found FROM documents WHERE doc_id % 5 = 0 AND doc_id % 7 <> 0")
def j15_fingerprint_violations(spark, sf):
    s = _stored(spark, sf).select("doc_id", F.col("text_hash").alias("found"))
    return _current(spark, sf).join(s, "doc_id").filter("text_hash <> found").select("doc_id", F.col("text_hash").alias("expected"), "found")


@query("""SELECT 'd' || doc_id AS unit, trim(text) AS content FROM documents WHERE trim(coalesce(text, '')) <> '' UNION ALL SELECT 'c' || conv_id || '.' || turn, trim(text) FROM conversations WHERE trim(coalesce(text, '')) <> ''""")
def r7_units_of_both(spark, sf):
    """Units of described and of spoken text (U1); blank ones make none."""
    d = table(spark, sf, "documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("unit"), F.trim("text").alias("content"))
    c = table(spark, sf, "conversations").select(F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit("."), F.col("turn").cast("string")).alias("unit"), F.trim("text").alias("content"))
    return d.unionByName(c).filter("content <> ''")


@query("""SELECT source AS video_id, -1 AS chunk_id, 'summary. languages: ' || string_agg(DISTINCT lang, ' | ' ORDER BY lang) || '. units: ' || count(*) AS content FROM documents GROUP BY source""")
def r9_whole_video_unit(spark, sf):
    d = table(spark, sf, "documents").groupBy("source").agg(F.array_sort(F.collect_set("lang")).alias("langs"), F.count(F.lit(1)).alias("n"))
    content = tx.render(F.lit("summary"), {"units": (F.col("n"), "number"), "languages": (F.col("langs"), "strings")})
    return d.select(F.col("source").alias("video_id"), F.lit(-1).alias("chunk_id"), content.alias("content"))


@query("SELECT label, min(len(embedding)) AS least, max(len(embedding)) AS most, count(*) AS rows, min(len(embedding)) = max(len(embedding)) AS ok FROM embeddings GROUP BY label")
def r10_width_check(spark, sf):
    return so.width_check(table(spark, sf, "embeddings"), "label", "embedding")


@query("SELECT source AS video_id, list(doc_id ORDER BY doc_id) AS units, sum(length(text))::BIGINT AS chars, list_sort(list(DISTINCT lang)) AS samplers FROM documents GROUP BY source")
def a20_index_dump(spark, sf):
    d = table(spark, sf, "documents").groupBy("source").agg(
        F.array_sort(F.collect_list("doc_id")).alias("units"), F.sum(F.length("text")).alias("chars"), F.array_sort(F.collect_set("lang")).alias("samplers")
    )
    return d.withColumnRenamed("source", "video_id")


@query(sql(" SELECT video_id, chunk_id FROM placed WHERE score > 100 INTERSECT SELECT video_id, chunk_id FROM chunks WHERE end_ts > 500000 AND start_ts < 1500000", GRID, PLACED))
def u2_window_intersection(spark, sf):
    """A chunk set cut with a time window, by (video, chunk), never by the bare chunk id."""
    chunks = _grid(spark, sf)
    chosen = g.point_join(frames(spark, sf), chunks, "media_ts", DAY).filter("score > 100").select("video_id", "chunk_id")
    return chosen.intersect(g.window_chunks(chunks, 500000, 1500000).select("video_id", "chunk_id"))


@query("""SELECT n_name AS name, n_regionkey AS v, 'builtin' AS origin FROM nation UNION ALL SELECT n, v, CASE WHEN n IN (SELECT n_name FROM nation) THEN 'shadowed' ELSE 'custom' END FROM
  (SELECT s_name AS n, s_nationkey AS v FROM supplier UNION ALL SELECT n_name, n_nationkey FROM nation WHERE n_regionkey = 1)""")
def u5_layered_registry(spark, sf):
    n = table(spark, sf, "nation")
    builtin = n.select(F.col("n_name").alias("name"), F.col("n_regionkey").alias("v"))
    custom = table(spark, sf, "supplier").select(F.col("s_name").alias("name"), F.col("s_nationkey").alias("v")).unionByName(
        n.filter("n_regionkey = 1").select(F.col("n_name").alias("name"), F.col("n_nationkey").alias("v"))
    )
    return so.layered(builtin, custom, "name")


@query("""SELECT doc_id, concat_ws('. ', nullif(trim(text), ''), 'lang: ' || lang, 'n_chars: ' || n_chars, 'tags: ' || lang || ' | ' || source, 'zero: 0') AS content FROM documents""")
def x2_render(spark, sf):
    d = table(spark, sf, "documents")
    fields = {
        "zero": (F.lit(0), "number"), "n_chars": (F.col("n_chars"), "number"), "lang": (F.col("lang"), "string"), "blank": (F.lit(" "), "string"),
        "tags": (F.array("lang", "source"), "strings"), "none": (F.array().cast("array<string>"), "strings"),
    }
    return d.select("doc_id", tx.render(F.col("text"), fields).alias("content"))


@query(f"SELECT doc_id, {HASH} AS text_hash, left(sha256(coalesce(lang, '')), 12) AS version FROM documents")
def x3_text_hash(spark, sf):
    """Text hash, and the twelve digits of a definition's version (X23)."""
    return table(spark, sf, "documents").select("doc_id", tx.fingerprint(F.col("text")).alias("text_hash"), tx.fingerprint(F.col("lang"), 12).alias("version"))


#: One step takes or cuts one sentence: what is held (now) goes out when the next does not fit.
_PIECES = r"""WITH RECURSIVE sn AS (SELECT doc_id, unnest(ss) AS s, unnest(range(1, len(ss) + 1)) AS i FROM
  (SELECT doc_id, string_split(regexp_replace(trim(coalesce(text, '')), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)) AS ss FROM documents)),
st AS (SELECT doc_id, i, s, '' AS now, NULL::VARCHAR AS piece, 0 AS n FROM sn WHERE i = 1 UNION ALL
  SELECT c.doc_id, CASE WHEN long THEN c.i ELSE c.i + 1 END, CASE WHEN c.s IS NULL THEN NULL WHEN long AND now <> '' THEN c.s WHEN long THEN trim(substr(c.s, cut + 1)) ELSE nx.s END,
    CASE WHEN c.s IS NULL THEN NULL WHEN long THEN '' WHEN now = '' THEN c.s WHEN fits THEN now || ' ' || c.s ELSE c.s END,
    CASE WHEN c.s IS NULL THEN now WHEN long AND now <> '' THEN now WHEN long THEN trim(left(c.s, cut)) WHEN now <> '' AND NOT fits THEN now END, n + 1
  FROM (SELECT *, coalesce(length(s) > 400, false) AS long, CASE WHEN back IN (0, 400) THEN 400 ELSE 400 - back END AS cut, length(now) + 1 + length(s) <= 400 AS fits FROM
    (SELECT *, instr(reverse(left(s, 400)), ' ') AS back FROM st WHERE now IS NOT NULL)) c LEFT JOIN sn nx ON nx.doc_id = c.doc_id AND nx.i = c.i + 1)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY n) - 1 AS pos, piece FROM st WHERE piece <> ''"""


@query(_PIECES)
def x4_pieces(spark, sf):
    cut = table(spark, sf, "documents").select("doc_id", F.posexplode(tx.pieces(F.col("text"), 400)).alias("pos", "piece"))
    return cut.withColumn("pos", F.col("pos").cast("long"))


@query(sql(" SELECT video_id, chunk_id, '[' || chunk_id || '] ' || round(start_ts)::BIGINT || '-' || round(end_ts)::BIGINT || 's  grid: day' AS line FROM chunks", GRID))
def x5_lines(spark, sf):
    line = tx.line(F.col("chunk_id"), F.col("start_ts"), F.col("end_ts"), F.lit("grid"), F.lit("day"))
    return _grid(spark, sf).select("video_id", "chunk_id", line.alias("line"))


@query("SELECT event_id, 'Describe ' || event_type || ' in ' || event_id || ' frames.' AS prompt FROM events")
def x6_prompt_text(spark, sf):
    p = tx.prompt(F.lit("Describe {vocabulary} in {n} frames."), {"vocabulary": F.col("event_type"), "n": F.col("event_id")})
    return table(spark, sf, "events").select("event_id", p.alias("prompt"))


@query("SELECT o_custkey, string_agg('(' || n || ') ' || o_orderstatus || ': ' || o_orderpriority, chr(10) ORDER BY n) AS prompt FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders) GROUP BY o_custkey")
def x7_narration_prompt(spark, sf):
    n = F.row_number().over(W.partitionBy("o_custkey").orderBy("o_orderkey"))
    said = F.format_string("(%d) %s: %s", F.col("n"), F.col("o_orderstatus"), F.col("o_orderpriority"))
    rows = table(spark, sf, "orders").withColumn("n", n).withColumn("said", said)
    items = F.transform(F.array_sort(F.collect_list(F.struct("n", "said"))), lambda x: x["said"])
    return rows.groupBy("o_custkey").agg(F.array_join(items, "\n").alias("prompt"))


@query("SELECT event_id, CASE WHEN event_id % 4 <> 3 THEN props END AS answer FROM events")
def x8_tolerant_json(spark, sf):
    raw = (
        F.when(F.col("event_id") % 4 == 0, F.col("props")).when(F.col("event_id") % 4 == 1, F.concat(F.lit("```json\n"), "props", F.lit("\n```")))
        .when(F.col("event_id") % 4 == 2, F.concat(F.lit("Sure: "), "props", F.lit(" done"))).otherwise(F.lit("no answer"))
    )
    return table(spark, sf, "events").select("event_id", tx.json_answer(raw).alias("answer"))


@query("SELECT event_id, event_type IN ('click', 'view') AS known, CAST(json_extract(props, '$.k') AS INT) IS NOT NULL AS has_k FROM events")
def x9_conformance(spark, sf):
    """Enum membership and a required typed key."""
    k = F.from_json("props", "k int")["k"]
    return table(spark, sf, "events").select("event_id", F.col("event_type").isin("click", "view").alias("known"), k.isNotNull().alias("has_k"))


@query("SELECT p_partkey, CASE WHEN lower(p_brand) LIKE '%e5%' THEN 'query: ' ELSE '' END AS query, CASE WHEN lower(p_brand) LIKE '%e5%' THEN 'passage: ' ELSE '' END AS document FROM part")
def x18_prefixes(spark, sf):
    return table(spark, sf, "part").select("p_partkey", tx.prefixes(F.col("p_brand"), 0).alias("query"), tx.prefixes(F.col("p_brand"), 1).alias("document"))


@query("SELECT p_partkey, left(trim(regexp_replace(lower(p_type || ' ' || p_name), '[^a-z0-9]+', '_', 'g'), '_'), 48) AS slug FROM part")
def x19_slug(spark, sf):
    return table(spark, sf, "part").select("p_partkey", tx.slug(F.concat_ws(" ", "p_type", "p_name")).alias("slug"))


@query("""SELECT s_suppkey AS name, p AS problem FROM (SELECT s_suppkey, unnest(list_filter([CASE WHEN s_nationkey % 4 = 3 THEN 'unknown kind' END, CASE WHEN s_nationkey % 5 = 0 THEN 'blank instruction' END,
  CASE WHEN s_nationkey > 20 THEN 'unknown field' END], lambda x: x IS NOT NULL)) AS p FROM supplier)""")
def p3_definition_checks(spark, sf):
    s = table(spark, sf, "supplier")
    kinds = F.element_at(F.array(*map(F.lit, ["fold", "spans", "items", "other"])), (F.col("s_nationkey") % 4 + 1).cast("int"))
    d = s.select(
        F.col("s_suppkey").alias("name"), kinds.alias("kind"), F.when(F.col("s_nationkey") % 5 == 0, F.lit(" ")).otherwise(F.lit("say")).alias("instruction"),
        F.col("s_nationkey").alias("field"),
    )
    known = table(spark, sf, "nation").filter("n_nationkey <= 20").select(F.col("n_nationkey").alias("field"))
    return so.definition_problems(d, ["fold", "spans", "items"], known)


@query("SELECT doc_id, length(text) AS score FROM documents")
def p4_batch_scorer(spark, sf):
    """Any callable over batches of texts; here it scores their length."""
    from moments.operators.scoring import score_texts

    return score_texts(table(spark, sf, "documents"), "doc_id", "text", lambda texts: [len(t) for t in texts])


@query("SELECT 'described' AS kind, count(*) AS units FROM documents WHERE trim(coalesce(text, '')) <> '' UNION ALL SELECT 'spoken', count(*) FROM conversations WHERE trim(coalesce(text, '')) <> ''")
def u1_union_of_units(spark, sf):
    both = r7_units_of_both(spark, sf).withColumn("kind", F.when(F.col("unit").startswith("d"), "described").otherwise("spoken"))
    return both.groupBy("kind").agg(F.count(F.lit(1)).alias("units"))


@query("SELECT c_custkey, left(sha256(c_name || '/' || c_mktsegment), 12) AS version FROM customer")
def x23_version_hash(spark, sf):
    c = table(spark, sf, "customer")
    return c.select("c_custkey", tx.fingerprint(F.concat_ws("/", "c_name", "c_mktsegment"), 12).alias("version"))


@query("""SELECT p_partkey, 'text:' || m || ':' || p_size || CASE WHEN (q, d) = (CASE WHEN m LIKE '%e5-%' THEN 'query: ' ELSE '' END, CASE WHEN m LIKE '%e5-%' THEN 'passage: ' ELSE '' END) THEN '' ELSE ':p' || left(sha1(q || chr(0) || d), 6) END AS space
  FROM (SELECT *, CASE WHEN p_partkey % 2 = 0 THEN 'multilingual-e5-small' ELSE 'plain' END AS m, CASE WHEN p_partkey % 3 = 0 THEN 'query: ' ELSE '' END AS q, CASE WHEN p_partkey % 3 = 0 THEN 'passage: ' ELSE '' END AS d FROM part)""")
def x18_space_keys(spark, sf):
    """The key of an embedding space has a suffix where its prefixes are not the model's own."""
    k = F.col("p_partkey")
    model = F.when(k % 2 == 0, "multilingual-e5-small").otherwise("plain")
    said = lambda text: F.when(k % 3 == 0, text).otherwise("")
    return table(spark, sf, "part").select("p_partkey", tx.space_key(F.lit("text"), model, F.col("p_size"), said("query: "), said("passage: ")).alias("space"))
