"""DuckDB SQL of the queries that it can express."""

ORACLES: dict[str, str] = {}

WS = r"' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

ORACLES["op4_line_runs"] = f"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, ls, unnest(range(len(ls))) AS i FROM d),
k AS (SELECT doc_id, i, ls[i + 1] AS line,
             translate(trim(ls[i + 1], {WS}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
o AS (SELECT key, min(doc_id) AS first FROM k WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2),
f AS (SELECT k.*, o.first IS NOT NULL AND k.doc_id <> o.first AS gone FROM k LEFT JOIN o ON k.key = o.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM f GROUP BY doc_id
"""

WORD = r"[^\x20\x09-\x0D]+"


def _seats(source: str, group: str, votes: str, seats: str, tie: str, out: str) -> str:
    """Highest quotients votes / (2k + 1) inside a group, over all seats that can be in doubt."""
    over = f"PARTITION BY {group}" if group else ""
    return f"""
(WITH p0 AS (SELECT *, count(*) OVER ({over}) AS pn, (sum({votes}) OVER ({over}))::DOUBLE AS pt FROM {source}),
 p1 AS (SELECT *, CASE WHEN pt > 0 THEN {votes} * {seats}::DOUBLE / pt ELSE 0 END AS quota0, CASE WHEN {seats} > 0 THEN pn / (2.0::DOUBLE * {seats}) ELSE 0 END AS play FROM p0),
 p2 AS (SELECT *, greatest(0, floor(quota0 * (1 - play)) - 1)::BIGINT AS low, (ceil(quota0 * (1 + play)) + 1)::BIGINT AS high FROM p1),
 p3 AS (SELECT *, {seats} - sum(low) OVER ({over}) AS free FROM p2),
 p4 AS (SELECT *, unnest(range(low, high + 1)) AS k FROM p3),
 p5 AS (SELECT *, row_number() OVER ({over} ORDER BY {votes} / (2.0::DOUBLE * k + 1) DESC, {tie}, k) AS rk FROM p4)
 SELECT * EXCLUDE (pn, pt, quota0, play, low, high, free, k, rk), (any_value(low) + count(*) FILTER (rk <= free AND {votes} > 0))::BIGINT AS {out} FROM p5 GROUP BY ALL)"""


ORACLES["op7_sainte_lague_mix"] = f"""
WITH d AS (SELECT doc_id, (source IS NULL)::INT AS ns, coalesce(source, '') AS nm, len(regexp_extract_all(coalesce(text, ''), '{WORD}'))::BIGINT AS size,
  md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS draw FROM documents),
s0 AS (SELECT ns, nm, sum(size)::BIGINT AS ss FROM d GROUP BY ALL),
s1 AS (SELECT *, row_number() OVER (ORDER BY ns, nm) AS place FROM s0),
s2 AS (SELECT *, [5, 2, 1][(place - 1) % 3 + 1] AS w FROM s1),
s3 AS (SELECT *, (sum(ss) OVER ())::DOUBLE * 1.5::DOUBLE AS words, coalesce(sum(ss) OVER q, 0)::DOUBLE AS cs, coalesce(sum(w) OVER q, 0)::DOUBLE AS cw, (sum(w) OVER ())::DOUBLE AS tw
  FROM s2 WINDOW q AS (ORDER BY ss / w, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
s4 AS (SELECT *, 2 * ss * (tw - cw) < w * (words - 2 * cs) AS capped FROM s3),
s5 AS (SELECT ns, nm, ss, place, CASE WHEN capped THEN 2.0::DOUBLE * ss ELSE w * ((words - 2 * coalesce(sum(ss) FILTER (capped) OVER (), 0)::DOUBLE) / (sum(w) FILTER (NOT capped) OVER ())::DOUBLE) END AS target,
  floor(words / 32 + 0.5::DOUBLE)::BIGINT AS seats FROM s4),
q0 AS {_seats("s5", "", "target", "seats", "place", "won")},
q1 AS (SELECT *, greatest(1, ceil(ss / 262144.0::DOUBLE))::BIGINT AS shards FROM q0),
l0 AS (SELECT d.*, q1.ss, q1.target, q1.won, ('0x' || left(draw, 8))::BIGINT % shards AS shard FROM d JOIN q1 USING (ns, nm)),
h0 AS (SELECT ns, nm, shard, sum(size)::BIGINT AS words, any_value(won) AS won FROM l0 GROUP BY ALL),
h1 AS {_seats("h0", "ns, nm", "words", "won", "shard", "quota")},
h2 AS (SELECT *, ceil(words / 32.0::DOUBLE)::BIGINT AS n FROM h1),
h3 AS (SELECT *, least(quota, 2 * n) AS q FROM h2),
h4 AS (SELECT ns, nm, shard, n, CASE WHEN n > 0 THEN q // n ELSE 0 END AS rounds, q - CASE WHEN n > 0 THEN q // n ELSE 0 END * n AS rest,
  CASE WHEN n > 0 THEN ('0x' || left(md5('mix:' || nm || ':' || ns || ':' || shard), 8))::BIGINT % greatest(n, 1) ELSE 0 END AS start FROM h3),
e0 AS (SELECT *, sum(size) OVER (PARTITION BY ns, nm, shard ORDER BY draw, doc_id, size ROWS UNBOUNDED PRECEDING) AS stop FROM l0),
e1 AS (SELECT *, stop - size AS begin, start * 32 AS a, (start + rest) * 32 AS b, (start + rest) * 32 - n * 32 AS c FROM e0 JOIN h4 USING (ns, nm, shard))
SELECT doc_id, size, ss AS source_size, target, (rounds * size + greatest(0, least(stop, b) - greatest(begin, a)) + greatest(0, least(stop, c) - begin))::BIGINT AS taken FROM e1
"""


def _quality() -> str:
    from moments.llm.quality import COMMON_WORDS, QualityRules

    r = QualityRules()
    bins = "CASE lang " + " ".join(f"WHEN '{k}' THEN [{', '.join(repr(x) for x in v)}]" for k, v in sorted(COMMON_WORDS.items())) + " END"
    known = ", ".join(f"'{k}'" for k in sorted(COMMON_WORDS))
    gone = lambda p: f"(length(t) - length(regexp_replace(t, '{p}', '', 'g')))"
    distance = """sqrt(greatest(0, sum((CASE WHEN p > 0 THEN p * log2(p / ((p + r) / 2)) ELSE 0 END + CASE WHEN r > 0 THEN r * log2(r / ((p + r) / 2)) ELSE 0 END) / 2)))"""
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, CASE WHEN lang IN ({known}) THEN lang END AS lang, regexp_extract_all(coalesce(text, ''), '{WORD}') AS w FROM documents),
tri AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS x FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, 1))) AS i FROM d)),
dup AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, x) AS c FROM tri) WHERE c > 1),
cov AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM dup) GROUP BY doc_id),
f AS (SELECT doc_id, lang, length(t) AS n, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
  {gone('[#*$%&|<>]+')} AS n_symbols, coalesce(cov.n, 0) AS n_repeat_words, {gone('[A-Z]+')} AS up, {gone('[0-9]+')} AS dg, {gone('[!-/:-@[-`{-~]+')} AS mk, {gone('[^\\x00-\\x7F]+')} AS ot,
  list_filter(string_split(t, chr(10)), lambda x: trim(x, {WS}) <> '') AS ls, {bins} AS b, list_transform(w, lambda x: lower(x)) AS lw FROM d LEFT JOIN cov USING (doc_id)),
g AS (SELECT *, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, n_words < {r.min_words} OR n_repeat_words * 100 > n_words * {r.max_repeat_percent} AS base_failed,
  [word_chars - up - dg - mk - ot, up, dg, n_symbols, mk - n_symbols, ot, n - word_chars] AS chars, list_transform(b, lambda y: len(list_filter(lw, lambda x: x = y))) AS cw FROM f),
h AS (SELECT *, CASE WHEN cw IS NOT NULL THEN list_append(cw, n_words - list_sum(cw)::BIGINT) END AS common FROM g),
c0 AS (SELECT doc_id, lang, base_failed, n_words, unnest(chars) AS v, unnest(range(len(chars))) AS i FROM h WHERE n >= {r.char_min_chars} OR NOT base_failed),
c1 AS (SELECT lang, i, sum(v)::DOUBLE AS v FROM (SELECT lang, i, v FROM c0 WHERE NOT base_failed UNION ALL SELECT 'all', i, v FROM c0 WHERE NOT base_failed) GROUP BY lang, i),
c2 AS (SELECT lang, i, v / sum(v) OVER (PARTITION BY lang) AS r FROM c1 WHERE lang IS NOT NULL),
cd AS (SELECT doc_id, {distance} AS dist FROM (SELECT doc_id, c0.i, v::DOUBLE / sum(v) OVER (PARTITION BY doc_id) AS p, c2.r FROM c0 JOIN c2 ON c2.i = c0.i
  AND c2.lang = CASE WHEN c0.lang IN (SELECT lang FROM c2) THEN c0.lang ELSE 'all' END) GROUP BY doc_id),
w0 AS (SELECT doc_id, lang, base_failed, n_words, unnest(common) AS v, unnest(range(len(common))) AS i FROM h WHERE common IS NOT NULL),
w1 AS (SELECT lang, i, sum(v)::DOUBLE AS v FROM w0 WHERE NOT base_failed GROUP BY lang, i),
w2 AS (SELECT lang, i, v / sum(v) OVER (PARTITION BY lang) AS r FROM w1),
wd AS (SELECT doc_id, {distance} AS dist FROM (SELECT doc_id, w0.i, v::DOUBLE / sum(v) OVER (PARTITION BY doc_id) AS p, w2.r FROM w0 JOIN w2 ON w2.i = w0.i AND w2.lang = w0.lang
  WHERE n_words >= {r.word_min_words}) GROUP BY doc_id)
SELECT h.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT coalesce(n >= {r.char_min_chars} AND cd.dist > {r.char_distance}, false)
  AND NOT coalesce(wd.dist > {r.word_distance}::DOUBLE + {r.word_noise}::DOUBLE / sqrt(n_words), false) AS kept FROM h LEFT JOIN cd USING (doc_id) LEFT JOIN wd USING (doc_id)
"""


ORACLES["op5_quality_divergence"] = _quality()


def crc32(text: str) -> str:
    """The unsigned checksum of an ASCII text, bit by bit."""
    bits = "list_reduce(list_concat([xor(c, b)], [0, 0, 0, 0, 0, 0, 0, 0]), lambda a, z: xor(a >> 1, 3988292384 * (a & 1)))"
    codes = f"list_transform(string_split({text}, ''), lambda x: ord(x)::BIGINT)"
    return f"xor(list_reduce(list_concat([4294967295], {codes}), lambda c, b: {bits}), 4294967295)"


def _leaf(text: str) -> str:
    parts = [f"coalesce(strlen({x}) || ':' || {x}, '-')" for x in ("doc_id::VARCHAR", "source", "lang", "n_chars::VARCHAR", text)]
    return f"sha256({' || '.join(parts)})"


ORACLES["op13_merkle_manifest"] = f"""
WITH RECURSIVE d AS (SELECT doc_id, source, {_leaf("text")} AS leaf,
  {_leaf("(CASE WHEN " + crc32("doc_id::VARCHAR") + " % 2 = 0 THEN replace(text, chr(10), '') ELSE text END)")} AS seen FROM documents),
r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY source) AS n FROM d),
t AS (SELECT source, 0 AS level, i, n, leaf AS h FROM r
  UNION ALL SELECT source, level + 1, i // 3, (any_value(n) + 2) // 3, sha256(string_agg(h, '' ORDER BY i)) FROM t WHERE n > 1 GROUP BY source, level, i // 3),
sub AS (SELECT source, h AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS i, count(*) OVER () AS n FROM t WHERE n = 1),
u AS (SELECT 0 AS level, i, n, subroot AS h FROM sub
  UNION ALL SELECT level + 1, i // 3, (any_value(n) + 2) // 3, sha256(string_agg(h, '' ORDER BY i)) FROM u WHERE n > 1 GROUP BY level, i // 3),
tl AS (SELECT source, level, i // 3 AS run, list(h ORDER BY i) AS hs FROM t WHERE n > 1 GROUP BY ALL),
ul AS (SELECT level, i // 3 AS run, list(h ORDER BY i) AS hs FROM u WHERE n > 1 GROUP BY ALL),
top AS (SELECT h AS root FROM u WHERE n = 1),
p AS (SELECT doc_id, source, leaf, i AS k, 0 AS level, i AS pos, seen AS cur, '' AS proof FROM r
  UNION ALL SELECT doc_id, p.source, leaf, k, p.level + 1, pos // 3, sha256(list_aggregate(hs[:pos % 3] || [cur] || hs[pos % 3 + 2:], 'string_agg', '')),
    proof || coalesce(list_aggregate(hs[:pos % 3] || hs[pos % 3 + 2:], 'string_agg', ''), '') FROM p JOIN tl ON tl.source IS NOT DISTINCT FROM p.source AND tl.level = p.level AND run = pos // 3),
f AS (SELECT p.*, subroot, sub.i AS place FROM p JOIN sub ON sub.source IS NOT DISTINCT FROM p.source QUALIFY row_number() OVER (PARTITION BY p.source, k ORDER BY level DESC) = 1),
q AS (SELECT doc_id, source, k, leaf, subroot, 0 AS level, place AS pos, cur, proof FROM f
  UNION ALL SELECT doc_id, source, k, leaf, subroot, q.level + 1, pos // 3, sha256(list_aggregate(hs[:pos % 3] || [cur] || hs[pos % 3 + 2:], 'string_agg', '')),
    proof || coalesce(list_aggregate(hs[:pos % 3] || hs[pos % 3 + 2:], 'string_agg', ''), '') FROM q JOIN ul ON ul.level = q.level AND run = pos // 3)
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, cur AS folded_root, cur = root AS verified FROM q, top
QUALIFY row_number() OVER (PARTITION BY source, k ORDER BY level DESC) = 1
"""
