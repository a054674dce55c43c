"""Queries for linking: a mention is an embedding, five make an answer, fifty a video, its label is the true subject."""

from __future__ import annotations

from pyspark.sql import functions as F

from moments.functions import text as tx
from moments.functions import vectors as vx
from moments.operators import link as ln
from moments.operators.folder import saved
from moments.plans.registry import query
from moments.plans.views import table

LINK = """WITH men AS (SELECT CAST(vec_id // 50 AS VARCHAR) AS video_id, vec_id AS mention, vec_id // 5 AS answer, 'people' AS field, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
nrm AS (SELECT *, greatest(sqrt(list_dot_product(v, v)), 1e-12) AS n FROM men),
pr AS (SELECT a.video_id, a.mention AS mention_i, b.mention AS mention_j, a.answer AS answer_i, b.answer AS answer_j, a.label AS li, b.label AS lj,
  round(list_dot_product(a.v, b.v) / (a.n * b.n), 9) AS sim FROM nrm a JOIN nrm b ON a.video_id = b.video_id AND a.mention < b.mention),
th AS (SELECT video_id, max(sim) AS mx, quantile_cont(sim, 0.95) AS q95, quantile_cont(sim, 0.90) AS q90 FROM pr WHERE answer_i = answer_j GROUP BY video_id),
sides AS (SELECT video_id, mention_i AS m, answer_j AS a, mention_j AS o, sim FROM pr WHERE answer_i <> answer_j UNION ALL
  SELECT video_id, mention_j, answer_i, mention_i, sim FROM pr WHERE answer_i <> answer_j),
best AS (SELECT video_id, m, a, o FROM sides QUALIFY row_number() OVER (PARTITION BY video_id, m, a ORDER BY sim DESC, o) = 1),
cand AS (SELECT pr.video_id, mention_i, mention_j, answer_i, answer_j, sim FROM pr JOIN th USING (video_id) WHERE answer_i <> answer_j AND sim > q90
  AND EXISTS (SELECT 1 FROM best b WHERE b.video_id = pr.video_id AND b.m = mention_i AND b.a = answer_j AND b.o = mention_j)
  AND EXISTS (SELECT 1 FROM best b WHERE b.video_id = pr.video_id AND b.m = mention_j AND b.a = answer_i AND b.o = mention_i))"""
Q90 = ln.LinkProfile(rule="q90")


def _cand(bar: str = "sim > q90", mutual: bool = True) -> str:
    """The candidate pairs under a bar, with or without mutual best."""
    best = """ AND EXISTS (SELECT 1 FROM best b WHERE b.video_id = pr.video_id AND b.m = mention_i AND b.a = answer_j AND b.o = mention_j)
  AND EXISTS (SELECT 1 FROM best b WHERE b.video_id = pr.video_id AND b.m = mention_j AND b.a = answer_i AND b.o = mention_i)"""
    return f"""cand AS (SELECT pr.video_id, mention_i, mention_j, answer_i, answer_j, sim FROM pr LEFT JOIN th USING (video_id)
  WHERE answer_i <> answer_j AND {bar}{best if mutual else ''})"""


#: One step of the recursion takes one pair: the groups of all mentions of a video are a list, changed where the pair may join.
_GROW = """op AS (SELECT video_id, row_number() OVER (PARTITION BY video_id ORDER BY sim DESC, mention_i, mention_j) AS k,
  mention_i - video_id::BIGINT * 50 + 1 AS i, mention_j - video_id::BIGINT * 50 + 1 AS j FROM cand),
st AS (SELECT video_id, 0::BIGINT AS k, list(mention ORDER BY mention) AS g, list(answer ORDER BY mention) AS an FROM men GROUP BY video_id
  UNION ALL SELECT st.video_id, st.k + 1, CASE WHEN g[i] = g[j] OR list_has_any(list_filter(an, lambda a, x: g[x] = g[i]), list_filter(an, lambda a, x: g[x] = g[j])) THEN g
    ELSE list_transform(g, lambda v: CASE WHEN v = g[j] THEN g[i] ELSE v END) END, an FROM st JOIN op ON op.video_id = st.video_id AND op.k = st.k + 1),
fin AS (SELECT video_id, unnest(g) AS gr, unnest(range(len(g))) + video_id::BIGINT * 50 AS mention FROM (SELECT * FROM st QUALIFY row_number() OVER (PARTITION BY video_id ORDER BY k DESC) = 1)),
grp AS (SELECT video_id, mention, min(mention) OVER (PARTITION BY video_id, gr) AS "group" FROM fin)"""


def linked(body: str, bar: str = "sim > q90", mutual: bool = True, vector: str = "embedding", only: str = "true", more: str = "") -> str:
    """DuckDB SQL over grp, the groups of greedy linking."""
    head = LINK[: LINK.index(",\ncand AS")].replace("WITH men", "WITH RECURSIVE men").replace("CAST(embedding AS", f"CAST({vector} AS")
    head = head.replace("FROM embeddings)", f"FROM embeddings WHERE {only})", 1)
    return f"{head},\n{_cand(bar, mutual)},\n{_GROW}{more} {body}"


def _mentions(spark, sf):
    e = table(spark, sf, "embeddings")
    return e.select(
        F.floor(F.col("vec_id") / 50).cast("string").alias("video_id"), F.col("vec_id").alias("mention"), F.floor(F.col("vec_id") / 5).cast("long").alias("answer"),
        F.lit("people").alias("field"), vx.doubles(F.col("embedding")).alias("vector"), F.col("label").alias("subject"),
    )


def _truth(spark, sf):
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("mention"), F.col("label").alias("subject"))


def _pairs(spark, sf):
    return ln.pairs(_mentions(spark, sf))


@query(LINK + " SELECT video_id, mention_i, mention_j, answer_i, answer_j, sim FROM pr")
def l2_pairwise_cosine(spark, sf):
    return _pairs(spark, sf).drop("field_i", "field_j")


@query(LINK + " SELECT video_id, mention_i, mention_j, sim FROM pr WHERE answer_i <> answer_j")
def j8_similarity_self_join(spark, sf):
    return _pairs(spark, sf).filter("answer_i <> answer_j").select("video_id", "mention_i", "mention_j", "sim")


@query(LINK + " SELECT video_id, mention_i, mention_j FROM pr WHERE answer_i = answer_j")
def j9_cannot_link(spark, sf):
    return ln.cannot_link(_pairs(spark, sf)).select("video_id", "mention_i", "mention_j")


@query(LINK + " SELECT video_id, mx AS max, q95, q90 FROM th")
def l3_calibrated_threshold(spark, sf):
    p = _pairs(spark, sf)
    out = [ln.thresholds(p, ln.LinkProfile(rule=r)).withColumnRenamed("threshold", r) for r in ("max", "q95", "q90")]
    return out[0].join(out[1], "video_id").join(out[2], "video_id")


@query(LINK + " SELECT video_id, mention_i, mention_j, sim FROM cand")
def l4_mutual_best(spark, sf):
    return ln.tiled_candidates(_mentions(spark, sf), Q90).select("video_id", "mention_i", "mention_j", "sim")


@query(linked('SELECT video_id, mention, "group" FROM grp'))
def l5_greedy_groups(spark, sf):
    return ln.link(_mentions(spark, sf), Q90)


def UNSURE(c):
    return f"({c}.mention % 11 = 0)"


ENT = """, grid AS (SELECT DISTINCT video_id, k AS chunk_id, k * 20.0::DOUBLE AS start_ts, k * 20.0::DOUBLE + 20 AS end_ts FROM grp, range(10) r(k)),
sn AS (SELECT video_id, "group", mention // 5 % 10 AS chunk_id, 'm' || mention AS signature FROM grp),
tm AS (SELECT video_id, "group", list_sort(list(chunk_id)) AS chunk_ids, count(*) AS appearances, min(start_ts) AS start_ts, max(end_ts) AS end_ts, round(sum(end_ts - start_ts), 3) AS observed_s
  FROM (SELECT DISTINCT video_id, "group", chunk_id FROM sn) JOIN grid USING (video_id, chunk_id) GROUP BY ALL),
nm AS (SELECT video_id, "group", arg_max(signature, (length(signature), -chunk_id)) AS label, count(*) AS mentions FROM sn GROUP BY ALL),
ent0 AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY appearances DESC, start_ts, "group") AS place FROM nm JOIN tm USING (video_id, "group")),
ent AS (SELECT *, printf('e%03d', place - 1) AS entity_id FROM ent0),
nar AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY place) AS turn FROM ent WHERE appearances >= 2 QUALIFY turn <= 12)"""


def _entities(spark, sf):
    grouped = l5_greedy_groups(spark, sf)
    chunk = (F.floor(F.col("mention") / 5) % 10).cast("long")
    seen = grouped.select("video_id", "group", chunk.alias("chunk_id"), F.concat(F.lit("m"), F.col("mention").cast("string")).alias("signature"))
    return ln.entities(seen, _link_grid(seen))


def _link_grid(seen):
    """Ten chunks of 20 seconds of each video."""
    grid = seen.select("video_id").distinct().select("video_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(9).cast("long"))).alias("chunk_id"))
    return grid.select("*", (F.col("chunk_id") * 20.0).alias("start_ts"), (F.col("chunk_id") * 20.0 + 20).alias("end_ts"))


@query(linked('SELECT video_id, "group", label, mentions, chunk_ids, appearances, start_ts, end_ts, observed_s, place, entity_id FROM ent', more=ENT))
def l6_linked_entities(spark, sf):
    return _entities(spark, sf)


@query(linked("""SELECT m.video_id, m.mentions, count(e.entity_id) AS count, count(e.entity_id) FILTER (appearances >= 2) AS linked,
  (SELECT count(*) FROM nar n WHERE n.video_id = m.video_id) AS narrated, any_value(th.q90) AS threshold,
  (SELECT count(*) FROM pr WHERE pr.video_id = m.video_id AND answer_i = answer_j) AS calibration_pairs, (SELECT count(*) FROM cand c WHERE c.video_id = m.video_id) AS candidate_pairs,
  coalesce((SELECT list(a || ':' || b || ':' || n ORDER BY n DESC, a, b) FROM (SELECT * FROM tg WHERE tg.video_id = m.video_id ORDER BY n DESC, a, b LIMIT 50)), []) AS together
  FROM (SELECT video_id, count(*) AS mentions FROM men GROUP BY 1) m JOIN ent e USING (video_id) LEFT JOIN th USING (video_id) GROUP BY m.video_id, m.mentions""", more=ENT + """,
  os AS (SELECT video_id, entity_id, unnest(chunk_ids) AS chunk_id FROM ent WHERE appearances >= 2),
  tg AS (SELECT x.video_id, x.entity_id AS a, y.entity_id AS b, count(*) AS n FROM os x JOIN os y ON x.video_id = y.video_id AND x.chunk_id = y.chunk_id AND x.entity_id < y.entity_id GROUP BY ALL)"""))
def l6_link_answer(spark, sf):
    """Counts, calibration, candidates and shared presence of a profile's answer."""
    m = _mentions(spark, sf).withColumn("chunk_id", (F.floor(F.col("mention") / 5) % 10).cast("long"))
    m = m.withColumn("signature", F.concat(F.lit("m"), F.col("mention").cast("string")))
    return ln.link_answer(m, _link_grid(m), Q90)


@query(linked("SELECT video_id, entity_id, label, appearances, start_ts, end_ts, observed_s FROM ent", more=ENT))
def a9_entity_assembly(spark, sf):
    return _entities(spark, sf).select("video_id", "entity_id", "label", "appearances", "start_ts", "end_ts", "observed_s")


@query(linked("SELECT video_id, entity_id, turn FROM nar", more=ENT))
def k6_narrated_entities(spark, sf):
    return ln.narrated(_entities(spark, sf), ln.LinkProfile()).select("video_id", "entity_id", "turn")


@query(LINK + """, bth AS (SELECT video_id, mention_i AS m, sim FROM pr UNION ALL SELECT video_id, mention_j, sim FROM pr),
  outs AS (SELECT video_id, m FROM bth GROUP BY ALL HAVING avg(sim) >= 0.3 UNION SELECT video_id, mention_j FROM pr WHERE answer_i = answer_j AND sim >= 0.6)
  SELECT video_id, mention_i, mention_j, answer_i, answer_j, sim FROM pr WHERE answer_i <> answer_j AND sim >= 0.4
  AND NOT EXISTS (SELECT 1 FROM outs o WHERE o.video_id = pr.video_id AND o.m IN (mention_i, mention_j))""")
def l7_fixed_threshold_pairs(spark, sf):
    """The older linker's pairs, at thresholds that suit these vectors."""
    return ln.fixed_link(_mentions(spark, sf), same=0.6, link_at=0.4, generic=0.3)


def _score_sql(where: str = "true") -> str:
    """Precision, recall and F1 of grp by video, over all pairs."""
    return f"""SELECT video_id, coalesce(tp / nullif(tp + fp, 0), 1.0) AS precision, coalesce(tp / nullif(tp + fn, 0), 1.0) AS recall, tp, fp, fn, unchecked,
  coalesce(2 * coalesce(tp / nullif(tp + fp, 0), 1.0) * coalesce(tp / nullif(tp + fn, 0), 1.0) / nullif(coalesce(tp / nullif(tp + fp, 0), 1.0) + coalesce(tp / nullif(tp + fn, 0), 1.0), 0), 0.0) AS f1 FROM
  (SELECT video_id, (count(*) FILTER (sure AND same AND linked))::DOUBLE AS tp, (count(*) FILTER (linked AND (sure AND NOT same OR known)))::DOUBLE AS fp,
    (count(*) FILTER (sure AND same AND NOT linked))::DOUBLE AS fn, (count(*) FILTER (linked AND NOT sure AND NOT known))::DOUBLE AS unchecked FROM
    (SELECT a.video_id, a."group" = b."group" AS linked, x.label = y.label AS same, NOT ({UNSURE('a')} OR {UNSURE('b')}) AS sure,
      {UNSURE('a')} <> {UNSURE('b')} AND CASE WHEN {UNSURE('a')} THEN y.label = (x.label + 1) % 8 ELSE x.label = (y.label + 1) % 8 END AS known
     FROM grp a JOIN grp b ON a.video_id = b.video_id AND a.mention < b.mention JOIN embeddings x ON x.vec_id = a.mention JOIN embeddings y ON y.vec_id = b.mention) GROUP BY video_id) WHERE {where}"""


@query(linked(_score_sql()))
def e5_pairwise_score(spark, sf):
    """Every eleventh mention is unsure; of each of these the next subject is known to be someone else."""
    truth, unsure = _truth(spark, sf), _truth(spark, sf).filter("mention % 11 = 0")
    different = unsure.select("mention", ((F.col("subject") + 1) % 8).cast("int").alias("subject"))
    return ln.pair_score(l5_greedy_groups(spark, sf), truth, unsure, different)


@query(LINK + """ SELECT video_id, mention_i, mention_j, answer_i, answer_j, sim FROM cand""")
def e12_rules_over_similarities(spark, sf):
    """The rules over a similarity table that is given, not computed from vectors here."""
    return ln.candidates(saved(_pairs(spark, sf)), Q90)


@query(LINK + """ SELECT video_id, CASE WHEN count(*) FILTER (li = lj) * count(*) FILTER (li <> lj) > 0 THEN sum(CASE WHEN li = lj THEN below + same / 2.0::DOUBLE END)
  / (count(*) FILTER (li = lj) * count(*) FILTER (li <> lj)) END AS auc FROM (SELECT *, coalesce(sum((li <> lj)::INT) OVER (PARTITION BY video_id ORDER BY sim
  RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW EXCLUDE TIES) - (li <> lj)::INT - 0, 0) AS below0,
  sum((li <> lj)::INT) OVER (PARTITION BY video_id, sim) AS same, sum((li <> lj)::INT) OVER (PARTITION BY video_id ORDER BY sim) - sum((li <> lj)::INT) OVER (PARTITION BY video_id, sim) AS below FROM pr) GROUP BY video_id""")
def e7_auc(spark, sf):
    truth = _truth(spark, sf)
    p = _pairs(spark, sf)
    for side in ("i", "j"):
        p = p.join(truth.select(F.col("mention").alias(f"mention_{side}"), F.col("subject").alias(f"s_{side}")), f"mention_{side}")
    return ln.auc(p.select("video_id", "sim", (F.col("s_i") == F.col("s_j")).alias("same")))


@query(linked("""SELECT k.video_id, k.subject, count(*) AS mentions, list_sort(list(DISTINCT k."group")) AS groups, any_value(w.strangers) AS strangers FROM k JOIN
  (SELECT o.video_id, o.subject, sum(a.n - o.n)::BIGINT AS strangers FROM o JOIN (SELECT video_id, "group", count(*) AS n FROM k GROUP BY ALL) a USING (video_id, "group") GROUP BY ALL) w
  ON w.video_id = k.video_id AND w.subject = k.subject GROUP BY k.video_id, k.subject""",
  more=""", k AS (SELECT video_id, "group", label AS subject FROM grp JOIN embeddings ON vec_id = mention), o AS (SELECT video_id, "group", subject, count(*) AS n FROM k GROUP BY ALL)"""))
def e11_wrong_links(spark, sf):
    return ln.wrong_links(l5_greedy_groups(spark, sf), _truth(spark, sf))


#: Two embedders: the vectors, and their first half.
EMBEDDERS = {"whole": "embedding", "half": "embedding[1:32]"}
_BAR = {"max": "sim > mx", "q95": "sim > q95", "q90": "sim > q90"}
_PLAIN = _score_sql().replace(UNSURE("a"), "false").replace(UNSURE("b"), "false")


def _configs_sql() -> str:
    one = lambda e, r, u: linked(f"SELECT '{e}' AS embedder, '{r}' AS rule, {u} AS mutual, video_id, precision, f1 FROM ({_PLAIN})", _BAR[r], u, EMBEDDERS[e])
    rows = " UNION ALL ".join(f"SELECT * FROM ({one(e, r, u)})" for e in EMBEDDERS for r in _BAR for u in (True, False))
    return f"""WITH c AS ({rows}), t AS (SELECT * FROM c WHERE video_id = '0') SELECT embedder, t.rule, t.mutual, precision, f1, others, safe,
  row_number() OVER (PARTITION BY embedder ORDER BY precision >= 0.9 DESC, f1 DESC, precision DESC, t.rule, t.mutual) AS place
  FROM t LEFT JOIN (SELECT embedder, rule, mutual, round(avg(f1), 9) AS others FROM c WHERE video_id <> '0' GROUP BY ALL) USING (embedder, rule, mutual)
  JOIN (SELECT rule, mutual, min(precision) >= 0.9 AS safe FROM t GROUP BY ALL) USING (rule, mutual)"""


@query(_configs_sql())
def e6_config_grid(spark, sf):
    """The rules of each embedder, tuned on the first video."""
    from functools import reduce

    m, truth = _mentions(spark, sf), _truth(spark, sf)
    kinds = {"whole": m, "half": m.withColumn("vector", F.slice("vector", 1, 32))}
    grouped = [
        ln.link(p, ln.LinkProfile(rule=r, mutual=u)).withColumn("video_id", F.concat_ws("|", F.lit(e), F.lit(r), F.lit(str(u).lower()), "video_id"))
        for e, p in kinds.items() for r in ("max", "q95", "q90") for u in (True, False)
    ]
    scores = ln.pair_score(saved(reduce(lambda a, b: a.unionByName(b), grouped)), truth)  # all configurations at once
    part = lambda i: F.split("video_id", r"\|")[i]
    told = scores.select(part(0).alias("embedder"), part(1).alias("rule"), part(2).cast("boolean").alias("mutual"), part(3).alias("video_id"), "precision", "f1")
    return ln.choose_config(saved(told), "0")


TRACK = """tr AS (SELECT o_custkey AS track, o_orderkey AS member, o_orderkey AS pos, o_orderkey % 7 AS detection, abs(o_totalprice % 97 - (o_orderkey % 7) * 10) AS distance,
  o_orderstatus = 'P' AS veto FROM orders)"""


@query(f"""WITH {TRACK} SELECT track, detection, CASE WHEN bool_or(veto) THEN 'inf'::DOUBLE ELSE min(distance) FILTER (rn <= 2) END AS last2,
  CASE WHEN bool_or(veto) THEN 'inf'::DOUBLE ELSE avg(distance) END AS mean, CASE WHEN bool_or(veto) THEN 'inf'::DOUBLE ELSE quantile_cont(distance, 0.5) END AS median,
  CASE WHEN bool_or(veto) THEN 'inf'::DOUBLE ELSE max(distance) END AS max FROM
  (SELECT *, row_number() OVER (PARTITION BY track, detection ORDER BY pos DESC) AS rn FROM tr) GROUP BY ALL""")
def e9_track_cost(spark, sf):
    o = table(spark, sf, "orders")
    detection = F.col("o_orderkey") % 7
    return ln.track_costs(
        o.select(
            F.col("o_custkey").alias("track"), F.col("o_orderkey").alias("pos"), detection.alias("detection"),
            F.abs(F.col("o_totalprice") % 97 - detection * 10).alias("distance"), (F.col("o_orderstatus") == "P").alias("veto"),
        )
    )


@query("""SELECT a.doc_id AS doc_id, b.doc_id AS other, a.doc_id // 10 AS answer FROM documents a JOIN documents b ON a.doc_id // 10 = b.doc_id // 10 AND a.doc_id < b.doc_id
  WHERE a.lang <> b.lang""")
def e8_attribute_veto(spark, sf):
    """Pairs of one answer whose language contradicts."""
    d = table(spark, sf, "documents").select("doc_id", "lang", F.floor(F.col("doc_id") / 10).cast("long").alias("answer"))
    b = d.select(F.col("doc_id").alias("other"), F.col("lang").alias("other_lang"), "answer")
    return d.join(b, "answer").filter("doc_id < other and lang <> other_lang").select("doc_id", "other", "answer")


BAGS, SCARS, SIDES = ["basket", "hat"], ["scar", "long scar", "tattoo", "none", "nothing"], ["arm", "neck"]
COLORS = ["black", "dark_blue", "blue", "grey", "white", "unclear"]


def _people(spark, sf):
    pick = lambda m, values: F.element_at(F.array(*map(F.lit, values)), (F.col("event_id") % m % len(values) + 1).cast("int"))
    return table(spark, sf, "events").select(
        F.col("event_id").alias("id"), F.floor(F.col("event_id") / 6).cast("long").alias("g"),
        F.struct(
            pick(2, ["male", "female"]).alias("gender"), pick(11, ["teen", "young_adult", "adult"]).alias("age_group"), pick(13, COLORS).alias("hair_color"),
            pick(17, ["short", "long", "bun", "ponytail"]).alias("hair_style"), pick(19, COLORS).alias("top_color"), pick(23, ["jacket", "coat", "shirt"]).alias("top_type"),
            pick(29, COLORS).alias("bottom_color"), pick(31, ["jeans", "trousers"]).alias("bottom_type"), F.array("event_type", pick(7, BAGS)).alias("accessories"),
            F.concat(F.lit("a "), pick(5, SCARS), F.lit(" on the "), pick(3, SIDES)).alias("distinguishing"),
        ).alias("p"),
    )


def _pick(m, values):
    listed = ", ".join(f"'{v}'" for v in values)
    return f"[{listed}][event_id % {m} % {len(values)} + 1]"


_PEOPLE = {
    "gender": _pick(2, ["male", "female"]), "age_group": _pick(11, ["teen", "young_adult", "adult"]), "hair_color": _pick(13, COLORS),
    "hair_style": _pick(17, ["short", "long", "bun", "ponytail"]), "top_color": _pick(19, COLORS), "top_type": _pick(23, ["jacket", "coat", "shirt"]),
    "bottom_color": _pick(29, COLORS), "bottom_type": _pick(31, ["jeans", "trousers"]),
}
_NEARS = ", ".join(f"'{min(p)}|{max(p)}'" for p in ln.NEAR)
_COST = " + ".join(
    f"{w} * CASE WHEN a.{k} = 'unclear' OR b.{k} = 'unclear' OR a.{k} = b.{k} THEN 0 WHEN least(a.{k}, b.{k}) || '|' || greatest(a.{k}, b.{k}) IN ({_NEARS}) THEN 0.5 ELSE 1 END"
    for k, w in ln.WEIGHTS.items()
)


_MARKS = f"list_filter(list_distinct(regexp_extract_all('a ' || {_pick(5, SCARS)} || ' on the ' || {_pick(3, SIDES)}, '[a-z]+')), lambda w: w NOT IN ({', '.join(repr(w) for w in ln.PLAIN_WORDS)}))"


@query("WITH p AS (SELECT event_id AS id, event_id // 6 AS g, [event_type, " + _pick(7, BAGS) + "] AS acc, " + _MARKS + " AS mk, " + ", ".join(f"{v} AS {k}" for k, v in _PEOPLE.items())
  + f""" FROM events), d AS (SELECT a.id, b.id AS other, ({_COST})::DOUBLE AS c, list_intersect(a.acc, b.acc) AS sh, len(a.mk) > 0 AND len(b.mk) > 0 AND
    len(list_intersect(a.mk, b.mk)) / greatest(len(list_distinct(a.mk || b.mk)), 1) >= 0.3 AS alike FROM p a JOIN p b ON a.g = b.g AND a.id < b.id)
  SELECT id, other, c - 2.0::DOUBLE * len(sh) - CASE WHEN alike THEN 2.0::DOUBLE ELSE 0 END AS distance,
    c - 2.0::DOUBLE * len(list_filter(sh, lambda x: x NOT IN ({', '.join(repr(w) for w in ln.CARRIED)}))) AS plain FROM d""")
def x26_attribute_distance(spark, sf):
    """With shared marks and all accessories, and without marks and what is carried."""
    a = _people(spark, sf)
    b = a.select(F.col("id").alias("other"), "g", F.col("p").alias("q"))
    p, q = F.col("p"), F.col("q")
    distance = ln.attribute_distance(p, q, marks=True).alias("distance")
    return a.join(b, "g").filter("id < other").select("id", "other", distance, ln.attribute_distance(p, q, carried=False).alias("plain"))


@query("SELECT vec_id, list_transform(CAST(embedding AS DOUBLE[]), lambda x: round(x / greatest(sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))), 1e-12), 9)) AS unit FROM embeddings")
def x12_l2_normalise(spark, sf):
    u = vx.unit(vx.doubles(F.col("embedding")))
    return table(spark, sf, "embeddings").select("vec_id", F.transform(u, lambda x: vx.rounded(x, 9)).alias("unit"))


_V = "CAST(a.embedding AS DOUBLE[])"
_U = "CAST(b.embedding AS DOUBLE[])"


@query(f"""SELECT a.vec_id, round(list_dot_product({_V}, {_U}) / (sqrt(list_dot_product({_V}, {_V})) * sqrt(list_dot_product({_U}, {_U}))), 9) AS cosine,
  round(least(greatest(list_dot_product({_V}, {_U}), 0), 1), 9) AS clipped FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""")
def x11_cosine(spark, sf):
    """Each vector with the next: cosine, and the dot product clipped to [0, 1] (X16)."""
    e = table(spark, sf, "embeddings").select("vec_id", vx.doubles(F.col("embedding")).alias("v"))
    b = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("v").alias("w"))
    met = e.join(b, "vec_id")
    return met.select("vec_id", F.round(vx.cosine(F.col("v"), F.col("w")), 9).alias("cosine"), F.round(vx.clipped(F.col("v"), F.col("w")), 9).alias("clipped"))


@query("SELECT vec_id, list_transform(CAST(embedding AS DOUBLE[]), lambda x: round(x, 6)) AS v FROM embeddings")
def x10_vector_parse(spark, sf):
    text = F.concat(F.lit("["), F.array_join(F.transform("embedding", lambda x: x.cast("double").cast("string")), ",", "null"), F.lit("]"))
    v = F.transform(vx.parsed(text), lambda x: vx.rounded(x, 6))
    return table(spark, sf, "embeddings").select("vec_id", F.when(text.isNotNull(), v).alias("v"))


BOX = """WITH bx AS (SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_returnflag AS label, l_quantity AS x1, l_discount * 100 AS y1, l_quantity + l_tax * 100 + 1 AS x2,
  l_discount * 100 + l_linenumber + 2 AS y2 FROM lineitem),
pb AS (SELECT *, lag(x1) OVER w AS a1, lag(y1) OVER w AS b1, lag(x2) OVER w AS a2, lag(y2) OVER w AS b2, lag(label) OVER w AS lb FROM bx WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_extendedprice)),
ia AS (SELECT *, greatest(least(x2, a2) - greatest(x1, a1), 0) * greatest(least(y2, b2) - greatest(y1, b1), 0) AS i, (x2 - x1) * (y2 - y1) AS sa, (a2 - a1) * (b2 - b1) AS sb FROM pb WHERE a1 IS NOT NULL)"""


def _boxes(spark, sf):
    from pyspark.sql import Window as W

    li = table(spark, sf, "lineitem")
    box = F.struct(
        F.col("l_quantity").alias("x1"), (F.col("l_discount") * 100).alias("y1"), (F.col("l_quantity") + F.col("l_tax") * 100 + 1).alias("x2"),
        (F.col("l_discount") * 100 + F.col("l_linenumber") + 2).alias("y2"), F.col("l_returnflag").alias("label"),
    )
    rows = li.select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", box.alias("b"))
    order = W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_extendedprice")
    return rows.withColumn("a", F.lag("b").over(order))


@query(BOX + " SELECT l_orderkey, l_linenumber, round(CASE WHEN sa + sb - i > 0 THEN i / (sa + sb - i) ELSE 0 END, 9) AS iou FROM ia")
def x13_iou(spark, sf):
    return _boxes(spark, sf).filter("a is not null").select("l_orderkey", "l_linenumber", F.round(vx.iou(F.col("b"), F.col("a")), 9).alias("iou"))


@query(BOX + """ SELECT l_orderkey, l_linenumber, round(CASE WHEN label <> lb THEN 0 ELSE 1 / (1 + sqrt(((x1 + x2) / 2 - (a1 + a2) / 2) ** 2 + ((y1 + y2) / 2 - (b1 + b2) / 2) ** 2)
  / greatest((sqrt((x2 - x1) ** 2 + (y2 - y1) ** 2) + sqrt((a2 - a1) ** 2 + (b2 - b1) ** 2)) / 2, 1e-9)) * sqrt(least(sa, sb) / greatest(sa, sb, 1e-9)) END, 9) AS proximity FROM ia""")
def x14_proximity(spark, sf):
    return _boxes(spark, sf).filter("a is not null").select("l_orderkey", "l_linenumber", F.round(vx.proximity(F.col("b"), F.col("a")), 9).alias("proximity"))


@query(BOX + """ SELECT l_orderkey, l_linenumber, round((x2 - x1) * (y2 - y1), 6) AS area, CASE WHEN l >= 0 AND r - l >= 2 AND d - t >= 2 THEN l END AS crop_x1, CASE WHEN r - l >= 2 AND d - t >= 2 THEN d END AS crop_y2 FROM
  (SELECT *, greatest(floor(x1 - (x2 - x1) * 0.08), 0)::BIGINT AS l, greatest(floor(y1 - (y2 - y1) * 0.08), 0)::BIGINT AS t, least(ceil(x2 + (x2 - x1) * 0.08), 50)::BIGINT AS r,
   least(ceil(y2 + (y2 - y1) * 0.08), 12)::BIGINT AS d FROM bx)""")
def x15_crop(spark, sf):
    c = vx.crop(F.col("b"), F.lit(50), F.lit(12))
    return _boxes(spark, sf).select("l_orderkey", "l_linenumber", F.round(vx.area(F.col("b")), 6).alias("area"), c["x1"].alias("crop_x1"), c["y2"].alias("crop_y2"))


@query("""WITH t AS (SELECT doc_id, list_distinct(regexp_extract_all(lower(coalesce(text, '')), '[a-z]+')) AS w FROM documents)
  SELECT a.doc_id, len(list_intersect(a.w, b.w)) AS shared, CASE WHEN len(list_distinct(a.w || b.w)) > 0 THEN len(list_intersect(a.w, b.w)) / len(list_distinct(a.w || b.w)) ELSE 0 END AS jaccard
  FROM t a JOIN t b ON b.doc_id = a.doc_id + 1""")
def x25_word_jaccard(spark, sf):
    """Each document with the next."""
    found = F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit("[a-z]+"), F.lit(0)))
    a = table(spark, sf, "documents").select("doc_id", found.alias("w"))
    b = a.select((F.col("doc_id") - 1).alias("doc_id"), F.col("w").alias("v"))
    shared, union = F.size(F.array_intersect("w", "v")), F.size(F.array_union("w", "v"))
    return a.join(b, "doc_id").select("doc_id", shared.alias("shared"), F.when(union > 0, shared / union).otherwise(0.0).alias("jaccard"))


@query("""SELECT doc_id, concat_ws('; ', nullif(trim(lang), ''), nullif(trim(source), '')) AS signature FROM documents""")
def x20_signature(spark, sf):
    return table(spark, sf, "documents").select("doc_id", tx.signature([F.col("lang"), F.col("source")]).alias("signature"))


@query("""SELECT 'd' || doc_id AS key, u.pos, u.entry FROM (SELECT doc_id, unnest([{'pos': 0, 'entry': lang}, {'pos': 1, 'entry': source}]) AS u FROM documents) WHERE trim(u.entry) <> ''""")
def l1_mentions(spark, sf):
    """List entries of a document, one mention each, keyed by document and place; blank ones make none."""
    d = table(spark, sf, "documents").select("doc_id", F.posexplode(F.array("lang", "source")).alias("pos", "entry"))
    return d.filter(F.trim("entry") != "").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("key"), "pos", "entry")


@query("""SELECT o_custkey AS entity, o_orderkey, number, doubt, count(doubt) OVER (PARTITION BY o_custkey) = count(*) OVER (PARTITION BY o_custkey) AS disputed FROM
  (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS number FROM orders) o LEFT JOIN
  (SELECT e, n, arg_min(r, p) AS doubt FROM (SELECT o_custkey AS e, o_orderkey % 5 AS n, o_orderkey AS p, o_orderpriority AS r FROM orders) GROUP BY e, n) f ON f.e = o.o_custkey AND f.n = o.number""")
def a10_doubts(spark, sf):
    from pyspark.sql import Window as W

    o = table(spark, sf, "orders")
    number = F.row_number().over(W.partitionBy("o_custkey").orderBy("o_orderkey")).cast("long")
    seen = o.select(F.col("o_custkey").alias("entity"), "o_orderkey", number.alias("number"))
    flagged = o.select(F.col("o_custkey").alias("entity"), (F.col("o_orderkey") % 5).alias("number"), F.col("o_orderkey").alias("pos"), F.col("o_orderpriority").alias("reason"))
    return ln.doubts(seen, flagged)


@query(linked('SELECT video_id, mention, "group" AS track FROM grp', "1 - sim < 0.7", False))
def e10_track_merge(spark, sf):
    costs = _pairs(spark, sf).select("video_id", "mention_i", "mention_j", "answer_i", "answer_j", (1 - F.col("sim")).alias("cost"))
    return ln.merge_tracks(costs, 0.7)


@query(f"""SELECT a.vec_id, round(least(greatest(list_dot_product({_V}, {_U}), 0), 1), 9) AS similarity FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""")
def x16_clipped_similarity(spark, sf):
    return x11_cosine(spark, sf).select("vec_id", F.col("clipped").alias("similarity"))


@query(" UNION ALL ".join(
    f"SELECT * FROM ({linked(f"SELECT video_id, mention, \"group\", '{k}' AS profile FROM grp", bar, u)})"
    for k, bar, u in (("strict", "sim > mx", True), ("loose", "sim > q90", False), ("fixed", "sim > 0.5", True))
))
def p2_link_profiles(spark, sf):
    """Link definitions as data: each profile links the same mentions."""
    m = _mentions(spark, sf)
    out = None
    for name, profile in {"strict": ln.LinkProfile(), "loose": ln.LinkProfile("q90", mutual=False), "fixed": ln.LinkProfile(threshold=0.5)}.items():
        one = ln.link(m, profile).withColumn("profile", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


_WORN = """CASE k % 4 WHEN 0 THEN 'a dark blue jacket and plain old jeans' WHEN 1 THEN 'red hat, brown  leather BOOTS' WHEN 2 THEN 'blue jacket over a white shirt' ELSE 'nothing known' END"""


@query(f"""WITH w AS (SELECT p_partkey AS k, CASE p_partkey % 4 WHEN 0 THEN ['dark jacket', 'blue jacket', 'jeans'] WHEN 1 THEN ['red hat', 'brown boots'] WHEN 2 THEN ['blue jacket', 'white shirt'] ELSE [] END AS worn FROM part)
  SELECT a.k, a.worn, CASE WHEN len(a.worn) + len(b.worn) > 0 THEN 2 * len(list_intersect(a.worn, b.worn)) / (len(a.worn) + len(b.worn))::DOUBLE ELSE 0 END AS dice FROM w a JOIN w b ON b.k = a.k + 2""")
def x25_garment_dice(spark, sf):
    """What each describes as worn, with the next but one."""
    a = table(spark, sf, "part").select(F.col("p_partkey").alias("k")).select("k", tx.colour_garments(F.expr(_WORN)).alias("worn"))
    b = a.select((F.col("k") - 2).alias("k"), F.col("worn").alias("other"))
    return a.join(b, "k").select("k", "worn", tx.dice(F.col("worn"), F.col("other")).alias("dice"))
