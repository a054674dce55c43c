"""Queries over units and their vectors: a benchmark item asks, the vector of its number stands for its embedding."""

from __future__ import annotations

from pyspark.sql import functions as F

from moments.functions import text as tx
from moments.functions import vectors as vx
from moments.operators import search as se
from moments.operators.index import TextIndex, VectorIndex, hashed_terms
from moments.plans.registry import ORACLES, query
from moments.plans.views import sql, table, units

STOP = ", ".join(f"'{w}'" for w in tx.STOPWORDS)
LIMIT = 10


def TOK(c):
    return f"list_filter(regexp_extract_all(lower(coalesce({c}, '')), '[a-z0-9£$€%.:''-]+'), lambda x: x NOT IN ({STOP}))"


SEARCH = f"""
vecs AS (SELECT source AS video_id, doc_id AS chunk_id, lang AS sampler_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings JOIN documents ON doc_id = vec_id),
qs AS (SELECT item_id AS q, b.text, CAST(embedding AS DOUBLE[]) AS v FROM benchmark b JOIN embeddings ON vec_id = item_id),
dn AS (SELECT q, video_id, chunk_id, sampler_id, round(list_dot_product(qs.v, vecs.v) / (sqrt(list_dot_product(qs.v, qs.v)) * sqrt(list_dot_product(vecs.v, vecs.v))), 9) AS sim FROM qs, vecs),
dense AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY sim DESC, video_id, chunk_id, sampler_id) AS dense_rank FROM dn) WHERE dense_rank <= 40),
qt AS (SELECT q, token, count(*) AS qtf FROM (SELECT q, unnest({TOK('text')}) AS token FROM qs) GROUP BY ALL),
post AS (SELECT video_id, chunk_id, sampler_id, token, count(*) AS tf FROM (SELECT video_id, chunk_id, sampler_id, unnest({TOK('content')}) AS token FROM units)
  WHERE token IN (SELECT token FROM qt) GROUP BY ALL),
idf AS (SELECT token, ln(1 + ((SELECT count(*) FROM units) - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM post GROUP BY token),
lx AS (SELECT q, video_id, chunk_id, sampler_id, count(*) AS shared, round(sum(qtf * tf * idf), 6) AS text_score FROM post JOIN qt USING (token) JOIN idf USING (token)
  JOIN (SELECT q, least(2, count(*)) AS floor FROM qt GROUP BY q) USING (q) GROUP BY q, video_id, chunk_id, sampler_id HAVING count(*) >= min(floor)),
lexical AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY text_score DESC, video_id, chunk_id, sampler_id) AS text_rank FROM lx) WHERE text_rank <= 40),
fused AS (SELECT q, video_id, chunk_id, sampler_id, dense_rank, text_rank, round(coalesce(1.0::DOUBLE / (dense_rank + 60), 0) + coalesce(1.0::DOUBLE / (text_rank + 60), 0), 12) AS score
  FROM dense FULL OUTER JOIN lexical USING (q, video_id, chunk_id, sampler_id)),
hits AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, dense_rank NULLS LAST, video_id, chunk_id, sampler_id) AS rank FROM fused) WHERE rank <= {LIMIT}),
mo0 AS (SELECT *, row_number() OVER (PARTITION BY q, video_id, chunk_id ORDER BY rank) AS place FROM hits),
mo1 AS (SELECT q, video_id, chunk_id, round(sum(CASE place WHEN 1 THEN 1.0::DOUBLE / (rank + 10) WHEN 2 THEN 0.5::DOUBLE / (rank + 10) END), 12) AS moment_score, count(*) AS units,
  list(sampler_id ORDER BY rank) AS samplers, count(text_rank) AS lexical_hits FROM mo0 GROUP BY ALL),
found AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY moment_score DESC, video_id, chunk_id) AS moment_rank FROM mo1) WHERE moment_rank <= 5),
relevant AS (SELECT item_id AS q, doc_id AS chunk_id FROM benchmark JOIN documents ON doc_id // 25 = item_id),
grades AS (SELECT q, coalesce(1.0::DOUBLE / min(moment_rank) FILTER (hit), 0) AS mrr, coalesce((min(moment_rank) FILTER (hit) = 1)::INT::DOUBLE, 0) AS top1,
  coalesce(count(DISTINCT chunk_id) FILTER (hit) / any_value(n)::DOUBLE, 0) AS recall, coalesce(sum(lexical_hits), 0)::BIGINT AS lexical_hits
  FROM qs LEFT JOIN (SELECT f.*, r.chunk_id IS NOT NULL AS hit FROM found f LEFT JOIN relevant r ON f.q = r.q AND f.chunk_id = r.chunk_id) USING (q)
  LEFT JOIN (SELECT q, count(*) AS n FROM relevant GROUP BY 1) USING (q) GROUP BY q),
vocab AS (SELECT DISTINCT unnest({TOK('content')}) AS token FROM units),
bands AS (SELECT q, o AS overlap, CASE WHEN o < 0.34 THEN 'low overlap' WHEN o < 0.67 THEN 'mixed' ELSE 'high overlap' END AS band FROM
  (SELECT q, avg(CASE WHEN token IN (SELECT token FROM vocab) THEN 1.0::DOUBLE ELSE 0 END) AS o FROM (SELECT q, unnest({TOK('text')}) AS token FROM qs) GROUP BY q))
"""


def _vectors(spark, sf):
    d, e = table(spark, sf, "documents"), table(spark, sf, "embeddings")
    met = e.join(d, e["vec_id"] == d["doc_id"])
    return met.select(F.col("source").alias("video_id"), F.col("doc_id").alias("chunk_id"), F.col("lang").alias("sampler_id"), vx.doubles(F.col("embedding")).alias("vector"))


def _queries(spark, sf):
    b, e = table(spark, sf, "benchmark"), table(spark, sf, "embeddings")
    return b.join(e, b["item_id"] == e["vec_id"]).select(F.col("item_id").alias("q"), "text", vx.doubles(F.col("embedding")).alias("vector"))


def _dense(spark, sf):
    return se.dense_top(_vectors(spark, sf), _queries(spark, sf), se.depth(LIMIT))


def _fused(spark, sf):
    return se.fuse(_dense(spark, sf), se.lexical_top(units(spark, sf), _queries(spark, sf), se.depth(LIMIT)))


def _found(spark, sf):
    return se.moments(se.hits(_fused(spark, sf), LIMIT))


def _relevant(spark, sf):
    b, d = table(spark, sf, "benchmark"), table(spark, sf, "documents")
    """Each item asks for 25 documents in a row; a document is relevant to one item at most."""
    of = F.floor(F.col("doc_id") / 25).cast("long")
    return b.join(d.select("doc_id", of.alias("of")), F.col("of") == F.col("item_id")).select(F.col("item_id").alias("q"), F.col("doc_id").alias("chunk_id"))


@query(sql(" SELECT q, video_id, chunk_id, sampler_id, sim, dense_rank FROM dense", SEARCH))
def k1_dense_top(spark, sf):
    return _dense(spark, sf)


@query(sql(" SELECT q, video_id, chunk_id, sampler_id, shared, text_score, text_rank FROM lexical", SEARCH))
def k2_lexical_top(spark, sf):
    return se.lexical_top(units(spark, sf), _queries(spark, sf), se.depth(LIMIT))


@query(sql(" SELECT q, video_id, chunk_id, sampler_id, shared FROM lx", SEARCH))
def r1_lexical_floor(spark, sf):
    return se.lexical_scores(units(spark, sf), _queries(spark, sf)).drop("text_score")


@query(sql(" SELECT q, video_id, chunk_id, sampler_id, text_score FROM lx", SEARCH))
def r2_idf_score(spark, sf):
    return se.lexical_scores(units(spark, sf), _queries(spark, sf)).drop("shared")


@query(sql(" SELECT q, video_id, chunk_id, sampler_id, dense_rank, text_rank, score FROM fused", SEARCH))
def r3_rank_fusion(spark, sf):
    return _fused(spark, sf)


@query(sql(" SELECT q, video_id, chunk_id, sampler_id, dense_rank, text_rank FROM fused", SEARCH))
def j6_full_outer_ranks(spark, sf):
    return _fused(spark, sf).drop("score")


@query(sql(" SELECT q, video_id, chunk_id, sampler_id, score, rank FROM hits", SEARCH))
def w12_total_order(spark, sf):
    return se.hits(_fused(spark, sf), LIMIT).drop("dense_rank", "text_rank")


@query(sql(" SELECT q, video_id, chunk_id, sampler_id, rank, n_chars FROM hits JOIN units USING (video_id, chunk_id, sampler_id)", SEARCH))
def j7_hits_with_units(spark, sf):
    met = se.hits(_fused(spark, sf), LIMIT).join(units(spark, sf), se.KEY)
    return met.select("q", *se.KEY, "rank", "n_chars")


@query(sql(" SELECT q, video_id, chunk_id, moment_score, units, moment_rank FROM found", SEARCH))
def r4_moments(spark, sf):
    return _found(spark, sf).drop("samplers", "lexical_hits", "hits")


_PAYLOAD = """, held AS (SELECT h.q, h.video_id, h.chunk_id, string_agg(h.sampler_id, ',' ORDER BY h.rank) AS samplers, string_agg(coalesce(h.dense_rank::VARCHAR, '-'), ',' ORDER BY h.rank) AS dense,
  string_agg(coalesce(h.text_rank::VARCHAR, '-'), ',' ORDER BY h.rank) AS text, string_agg('is it ' || h.sampler_id, ',' ORDER BY h.rank) AS questions,
  string_agg(md5(coalesce(u.content, '')), ',' ORDER BY h.rank) AS contents, string_agg(u.n_chars::VARCHAR, ',' ORDER BY h.rank) AS structured FROM hits h JOIN units u USING (video_id, chunk_id, sampler_id) GROUP BY ALL)"""


def _asked(spark, sf):
    """The units with a question and a structured answer."""
    question = F.concat(F.lit("is it "), F.col("sampler_id"))
    return units(spark, sf).select("*", question.alias("question"), F.struct(F.col("n_chars").alias("chars")).alias("structured"))


@query(sql(_PAYLOAD + " SELECT held.* FROM held JOIN found USING (q, video_id, chunk_id)", SEARCH))
def r5_moment_payload(spark, sf):
    """What each unit of a moment gave: sampler, question, content, structured answer and its rank in both halves."""
    found = se.moments(se.hits(_fused(spark, sf), LIMIT).join(_asked(spark, sf), se.KEY))
    told = lambda f: F.array_join(F.transform("hits", f), ",")
    rank = lambda c: told(lambda x: F.coalesce(x[c].cast("string"), F.lit("-")))
    return found.select(
        "q", "video_id", "chunk_id", told(lambda x: x["sampler_id"]).alias("samplers"), rank("dense_rank").alias("dense"), rank("text_rank").alias("text"),
        told(lambda x: x["question"]).alias("questions"), told(lambda x: F.md5(F.coalesce(x["content"], F.lit("")))).alias("contents"),
        told(lambda x: x["structured"]["chars"].cast("string")).alias("structured"),
    )


@query(sql(" SELECT * FROM found", SEARCH))
def r6_hybrid_search(spark, sf):
    return se.search(units(spark, sf), _vectors(spark, sf), _queries(spark, sf), LIMIT).drop("hits")


#: A grid of 20 seconds a unit, some videos, two languages, texts of more than 300 characters, and a window with neighbours.
def _grid_of_units(spark, sf):
    u = units(spark, sf)
    return u.select("video_id", "chunk_id", (F.col("chunk_id") * 20.0).alias("start_ts"), (F.col("chunk_id") * 20.0 + 20).alias("end_ts")).distinct()


def _within(spark, sf, **more):
    named = table(spark, sf, "benchmark").select(F.concat(F.lit("src"), F.col("item_id").cast("string")).alias("video_id"))
    return se.Scope(videos=named, after=1000.0, before=9000.0, widen=2, equal={"sampler_id": ["en", "fr"]}, having=F.col("structured.chars") > 300, **more)


SCOPED = """win AS (SELECT DISTINCT video_id, chunk_id FROM units WHERE chunk_id * 20 + 20 > 1000 AND chunk_id * 20 < 9000),
near AS (SELECT DISTINCT u.video_id, u.chunk_id FROM units u JOIN win ON win.video_id = u.video_id AND abs(win.chunk_id - u.chunk_id) <= 2),
cands AS (SELECT * FROM units JOIN near USING (video_id, chunk_id) WHERE video_id IN (SELECT 'src' || item_id FROM benchmark) AND sampler_id IN ('en', 'fr') AND n_chars > 300)"""
SCOPED_SEARCH = SEARCH.replace("FROM units)", "FROM cands)").replace("FROM embeddings JOIN documents ON doc_id = vec_id)", "FROM embeddings JOIN cands ON chunk_id = vec_id)").replace(
    "SELECT source AS video_id, doc_id AS chunk_id, lang AS sampler_id, CAST(embedding", "SELECT video_id, chunk_id, sampler_id, CAST(embedding"
)


@query(sql(" SELECT found.*, chunk_id * 20.0::DOUBLE AS start_ts, chunk_id * 20.0::DOUBLE + 20 AS end_ts FROM found", SCOPED, SCOPED_SEARCH))
def r6_scoped_search(spark, sf):
    """Every filter at once, before the rankings: videos, samplers, structured answers, a time window and its neighbours."""
    grid = _grid_of_units(spark, sf)
    return se.search(_asked(spark, sf), _vectors(spark, sf), _queries(spark, sf), LIMIT, within=_within(spark, sf), chunks=grid).drop("hits")


@query(sql(""" SELECT q, unnest(['filters lower scores: a chunk has fewer units', 'scope is ' || (SELECT count(DISTINCT item_id) FROM benchmark) || ' videos: a chunk id counts inside its video only']) AS note FROM qs
  UNION ALL SELECT q, 'no lexical match' FROM qs WHERE q NOT IN (SELECT q FROM found WHERE lexical_hits > 0)""", SCOPED, SCOPED_SEARCH))
def r6_search_notes(spark, sf):
    grid, within = _grid_of_units(spark, sf), _within(spark, sf)
    asked, queries = _asked(spark, sf), _queries(spark, sf)
    found = se.search(asked, _vectors(spark, sf), queries, LIMIT, within=within, chunks=grid)
    return se.search_notes(asked, queries, found, within, grid)


@query(sql(" SELECT q, video_id, chunk_id, moment_rank FROM found WHERE moment_rank <= 3", SEARCH))
def k3_top_moments(spark, sf):
    return se.moments(se.hits(_fused(spark, sf), LIMIT), 3).select("q", "video_id", "chunk_id", "moment_rank")


@query(sql(f""" SELECT q, video_id, chunk_id, sampler_id, sim, row_number() OVER (PARTITION BY q ORDER BY sim DESC, video_id, chunk_id, sampler_id) AS dense_rank FROM dn
  WHERE video_id IN ('src1', 'src2') AND sampler_id = 'en' QUALIFY dense_rank <= 40""", SEARCH))
def f1_candidate_filter(spark, sf):
    """Filters come before the ranking: they change ranks."""
    kept = se.scope(_vectors(spark, sf), video_id=["src1", "src2"], sampler_id="en", chunk_id=None)
    return se.dense_top(kept, _queries(spark, sf), se.depth(LIMIT))


@query(sql(" SELECT video_id, chunk_id, sampler_id FROM units WHERE video_id IN (SELECT 'src' || item_id FROM benchmark)"))
def f4_video_scope(spark, sf):
    named = table(spark, sf, "benchmark").select(F.concat(F.lit("src"), F.col("item_id").cast("string")).alias("video_id"))
    return se.scope(units(spark, sf), named).select(*se.KEY)


@query(sql("""  SELECT q, label AS video, sim, row_number() OVER (PARTITION BY q ORDER BY sim DESC, label) AS rank FROM
  (SELECT q, label, round(list_dot_product(qs.v, s.v) / (sqrt(list_dot_product(qs.v, qs.v)) * sqrt(list_dot_product(s.v, s.v))), 9) AS sim FROM qs,
   (SELECT label, CAST(arg_min(embedding, vec_id) AS DOUBLE[]) AS v FROM embeddings GROUP BY label) s) QUALIFY rank <= 5""", SEARCH))
def k4_whole_video_ranking(spark, sf):
    """The first vector of each label stands for a whole video's summary; ranked as any vectors are, by blocks of queries."""
    whole = table(spark, sf, "embeddings").groupBy("label").agg(F.min_by("embedding", "vec_id").alias("v"))
    vectors = whole.select(
        F.format_string("%010d", "label").alias("video_id"), F.col("label").cast("long").alias("chunk_id"), F.lit("").alias("sampler_id"), vx.doubles(F.col("v")).alias("vector")
    )
    found = se.dense_top(vectors, _queries(spark, sf), 5)
    return found.select("q", F.col("chunk_id").cast("int").alias("video"), "sim", F.col("dense_rank").alias("rank"))


@query(sql(" SELECT q, mrr, top1, recall, lexical_hits FROM grades", SEARCH))
def e1_reciprocal_rank(spark, sf):
    return se.graded(_found(spark, sf), _relevant(spark, sf), _queries(spark, sf))


@query(sql(" SELECT q, overlap, band FROM bands", SEARCH))
def e2_overlap_bands(spark, sf):
    return se.overlaps(_queries(spark, sf), _vocabulary(spark, sf))


def _vocabulary(spark, sf):
    return units(spark, sf).select(F.explode(tx.tokens(F.col("content"))).alias("token")).distinct()


@query(sql(""" , timed AS (SELECT q, length(text) / 1000.0::DOUBLE AS elapsed_s FROM qs)
  SELECT band, count(*) AS n, round(avg(mrr), 4) AS mrr, round(avg(top1), 4) AS top1, round(avg(recall), 4) AS recall,
  count(*) FILTER (lexical_hits > 0) AS lexical_fired_on, round(quantile_cont(elapsed_s, 0.5), 3) AS median_s FROM grades JOIN (SELECT q, unnest([band, 'all']) AS band FROM bands) USING (q) JOIN timed USING (q) GROUP BY band""", SEARCH))
def e3_summary(spark, sf):
    """The time of a case is given; here a millisecond a character of its text stands for it."""
    timed = _queries(spark, sf).select("q", (F.length("text") / 1000.0).alias("elapsed_s"))
    return se.summary(e1_reciprocal_rank(spark, sf), e2_overlap_bands(spark, sf), timed)


@query(sql(""" SELECT q, kind, overlap, band, kind = 'paraphrase' AND overlap > 0.67 OR kind = 'literal' AND overlap < 0.34 AS disagrees FROM
  (SELECT *, CASE WHEN q % 3 = 0 THEN 'paraphrase' ELSE 'literal' END AS kind FROM bands)""", SEARCH))
def e4_label_check(spark, sf):
    bands = e2_overlap_bands(spark, sf)
    kinds = bands.select("q", F.when(F.col("q") % 3 == 0, F.lit("paraphrase")).otherwise(F.lit("literal")).alias("kind"))
    return se.label_check(bands, kinds)


@query(sql(""" SELECT g.q, g.mrr AS mrr_fused, coalesce(1.0::DOUBLE / d.r, 0) AS mrr_dense, g.mrr - coalesce(1.0::DOUBLE / d.r, 0) AS gain FROM grades g LEFT JOIN
  (SELECT q, min(dense_rank) AS r FROM dense JOIN relevant USING (q, chunk_id) WHERE dense_rank <= 5 GROUP BY q) d USING (q)""", SEARCH))
def e4_compare_configurations(spark, sf):
    dense = _dense(spark, sf).withColumn("moment_rank", F.col("dense_rank")).withColumn("lexical_hits", F.lit(0))
    cases, relevant = _queries(spark, sf), _relevant(spark, sf)
    one = se.graded(_found(spark, sf), relevant, cases).select("q", F.col("mrr").alias("mrr_fused"))
    two = se.graded(dense, relevant, cases).select("q", F.col("mrr").alias("mrr_dense"))
    return one.join(two, "q").withColumn("gain", F.col("mrr_fused") - F.col("mrr_dense"))


@query(sql(" SELECT token FROM vocab", SEARCH))
def a21_corpus_vocabulary(spark, sf):
    return _vocabulary(spark, sf)


@query(f"SELECT doc_id, {TOK('text')} AS tokens FROM documents")
def x1_tokenise(spark, sf):
    return table(spark, sf, "documents").select("doc_id", tx.tokens(F.col("text")).alias("tokens"))


@query(f"SELECT doc_id, token, count(*) AS tf FROM (SELECT doc_id, unnest({TOK('text')}) AS token FROM documents) GROUP BY ALL")
def x24_term_counts(spark, sf):
    found = table(spark, sf, "documents").select("doc_id", F.explode(tx.tokens(F.col("text"))).alias("token"))
    return found.groupBy("doc_id", "token").agg(F.count(F.lit(1)).alias("tf"))


@query(f"""SELECT doc_id, dim, round(n / sqrt(sum(n * n) OVER (PARTITION BY doc_id)), 9) AS value FROM
  (SELECT doc_id, ('0x' || left(sha256(token), 8))::BIGINT % 256 AS dim, count(*)::DOUBLE AS n FROM (SELECT doc_id, unnest({TOK('text')}) AS token FROM documents) GROUP BY ALL)""")
def x17_hash_embedder(spark, sf):
    """The hashed bag of words as sparse rows (doc_id, dim, value) of length 1."""
    from pyspark.sql import Window as W

    found = table(spark, sf, "documents").select("doc_id", F.explode(tx.tokens(F.col("text"))).alias("token"))
    dim = F.conv(F.left(F.sha2("token", 256), F.lit(8)), 16, 10).cast("long") % 256
    n = found.groupBy("doc_id", dim.alias("dim")).agg(F.count(F.lit(1)).cast("double").alias("n"))
    length = F.sqrt(F.sum(F.col("n") * F.col("n")).over(W.partitionBy("doc_id")))
    return n.select("doc_id", "dim", F.round(F.col("n") / length, 9).alias("value"))


@query(sql(" SELECT q, chunk_id, dense_rank AS rank, 'dense' AS half FROM dense UNION ALL SELECT q, chunk_id, text_rank, 'text' FROM lexical", SEARCH))
def w11_dense_and_text_ranks(spark, sf):
    a = _dense(spark, sf).select("q", "chunk_id", F.col("dense_rank").alias("rank"), F.lit("dense").alias("half"))
    b = se.lexical_top(units(spark, sf), _queries(spark, sf), se.depth(LIMIT))
    return a.unionByName(b.select("q", "chunk_id", F.col("text_rank").alias("rank"), F.lit("text").alias("half")))


@query(ORACLES["k2_lexical_top"])
def k2_kept_index(spark, sf):
    """The best units from an inverted index that skips blocks by their bounds."""
    return TextIndex.build(units(spark, sf).select(*se.KEY, "content")).top(_queries(spark, sf), se.depth(LIMIT))[0]


@query(ORACLES["k2_lexical_top"])
def r8_kept_index_upsert(spark, sf):
    """An index of an older corpus, kept up: some units had another text, some were missing, some are gone since."""
    now = units(spark, sf).select(*se.KEY, "content")
    turn = F.col("chunk_id") % 10
    old = now.filter(turn != 1).withColumn("content", F.when(turn == 0, F.concat(F.lit("once there was more of it "), "content")).otherwise(F.col("content")))
    dropped = now.filter(turn == 2).withColumn("chunk_id", -F.col("chunk_id") - 1)
    index = TextIndex.build(old.unionByName(dropped))
    index.upsert(now.filter(turn <= 1), dropped)
    return index.top(_queries(spark, sf), se.depth(LIMIT))[0]


@query(ORACLES["k1_dense_top"])
def k1_vector_index(spark, sf):
    """The nearest vectors from cells around pivots, skipped where the triangle inequality allows."""
    found = VectorIndex.build(_vectors(spark, sf)).top(_queries(spark, sf).select("q", "vector"), se.depth(LIMIT))[0]
    return found.select("q", *se.KEY, "sim", "dense_rank")


@query(f"SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(list_transform({TOK('text')}, lambda x: ('0x' || left(sha256(x), 8))::BIGINT & 2147483647)) AS term FROM documents) GROUP BY ALL")
def x24_hashed_terms(spark, sf):
    """Terms by 31-bit id."""
    return hashed_terms(table(spark, sf, "documents"), "doc_id", "text")


@query("SELECT source AS video_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS place, doc_id AS chunk_id, lang AS sampler_id, length(text) AS length, left(sha256(text), 16) AS text_hash FROM documents")
def a20_index_rows(spark, sf):
    """An index dump as rows: the units of each video in order, with length and hash."""
    from pyspark.sql import Window as W

    u = units(spark, sf)
    place = F.row_number().over(W.partitionBy("video_id").orderBy("chunk_id", "sampler_id"))
    return u.select("video_id", place.cast("long").alias("place"), "chunk_id", "sampler_id", F.length("content").cast("long").alias("length"), tx.fingerprint(F.col("content")).alias("text_hash"))
