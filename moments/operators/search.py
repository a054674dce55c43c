"""Hybrid search for a batch of queries: dense and lexical rankings, their fusion, and moments.

units: (video_id, chunk_id, sampler_id, content, ...); vectors carry the same key. Every step is one job over all queries.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from moments.functions.text import tokens
from moments.operators import grid
from moments.operators.folder import new_folder

KEY = ["video_id", "chunk_id", "sampler_id"]


def depth(limit: int) -> int:
    return max(4 * limit, 40)


def scope(units: DataFrame, videos: DataFrame | None = None, **equal) -> DataFrame:
    """Candidates: optional set of videos, and equalities; a None or empty value is no constraint, a list is any of them."""
    for name, value in equal.items():
        if value in (None, [], ""):
            continue
        units = units.filter(F.col(name).isin(value) if isinstance(value, list) else F.col(name) == value)
    return units if videos is None else units.join(videos.select("video_id").distinct(), "video_id", "left_semi")


def _blocks(queries: DataFrame, size: int):
    """(ids, unit vectors) of the queries, a block at a time: the driver holds one block."""
    ids, rows = [], []

    def packed():
        m = np.array(rows, "float64")
        return ids, m / np.where((n := np.linalg.norm(m, axis=1, keepdims=True)) == 0, 1, n)

    for r in queries.select("q", F.col("vector").cast("array<double>").alias("vector")).orderBy("q").toLocalIterator():
        ids.append(r["q"])
        rows.append(r["vector"])
        if len(ids) == size:
            yield packed()
            ids, rows = [], []
    if ids:
        yield packed()


def _similarities(m: np.ndarray, vectors: pa.Array) -> np.ndarray:
    """Cosines of unit queries with vectors, to nine places; -1 where widths differ or a vector is null."""
    values, ends = vectors.values.to_numpy(zero_copy_only=False).astype("float64"), vectors.offsets.to_numpy().astype("int64")
    out = np.full((len(m), len(vectors)), -1.0)
    fits = np.flatnonzero((np.diff(ends) == m.shape[1]) & vectors.is_valid().to_numpy(zero_copy_only=False))
    if len(fits):
        v = values[(ends[fits][:, None] + np.arange(m.shape[1])).ravel()].reshape(len(fits), -1)
        v = v / np.where((n := np.linalg.norm(v, axis=1, keepdims=True)) == 0, 1, n)
        out[:, fits] = np.round(m @ v.T, 9)
    return out


def _best(sim: np.ndarray, keys: pa.RecordBatch, k: int) -> pa.RecordBatch:
    """The first k by similarity, ties by key. Only rows at or above the k-th similarity are sorted."""
    few = np.arange(len(sim)) if len(sim) <= k else np.flatnonzero(sim >= np.partition(sim, len(sim) - k)[len(sim) - k])
    rows = keys.take(pa.array(few))
    rows = pa.RecordBatch.from_arrays([*rows.columns, pa.array(sim[few])], names=[*KEY, "sim"])
    return rows.sort_by([("sim", "descending"), *[(c, "ascending") for c in KEY]]).slice(0, k)


def _merged(a: pa.RecordBatch, b: pa.RecordBatch, k: int) -> pa.RecordBatch:
    if not b.num_rows or a.num_rows == k and b.column("sim")[0].as_py() < a.column("sim")[k - 1].as_py():
        return a
    both = pa.concat_batches([a, b])
    return _best(both.column("sim").to_numpy(), both.select(KEY), k)


def dense_top(vectors: DataFrame, queries: DataFrame, k: int, block: int = 2048) -> DataFrame:
    """(q, video_id, chunk_id, sampler_id, sim, dense_rank): exact cosine top k of each query.

    The queries are a stated set of one width, taken in blocks; each block travels to the tasks as a broadcast of a bounded size. A task
    keeps its own top k of each query over all its batches and gives them once, so the shuffle holds k rows a query and task.
    Vectors of another width score -1. What a block found is written before the next block is read."""
    spark, at = vectors.sparkSession, None
    schema = "q long, video_id string, chunk_id long, sampler_id string, sim double"
    for ids, m in _blocks(queries, block):
        shared = spark.sparkContext.broadcast((ids, m))

        def scan(batches, shared=shared):
            ids, m = shared.value
            held = None  # (sim, key columns) of the best k of each query so far
            for b in batches:
                sim = _similarities(m, b.column("vector"))
                part = [_best(sim[i], b.select(KEY), k) for i in range(len(ids))] if b.num_rows else []
                if part:
                    held = part if held is None else [_merged(x, y, k) for x, y in zip(held, part)]
            for q, rows in zip(ids, held or []):
                q = pa.array(np.full(rows.num_rows, q, "int64"))
                yield pa.RecordBatch.from_arrays([q, *[rows.column(c) for c in (*KEY, "sim")]], names=["q", *KEY, "sim"])

        at = at or new_folder(spark)
        vectors.select(*KEY, "vector").mapInArrow(scan, schema).write.mode("append").parquet(at)
        shared.destroy()
    kept = spark.read.schema(schema).parquet(at) if at else spark.createDataFrame([], schema)
    rank = F.row_number().over(W.partitionBy("q").orderBy(F.desc("sim"), *KEY))
    return kept.withColumn("dense_rank", rank).filter(F.col("dense_rank") <= k)


def postings(units: DataFrame) -> DataFrame:
    """(token, key, tf)."""
    return units.select(*KEY, F.explode(tokens(F.col("content"))).alias("token")).groupBy(*KEY, "token").agg(F.count(F.lit(1)).alias("tf"))


def query_terms(queries: DataFrame) -> DataFrame:
    found = queries.select("q", F.explode(tokens(F.col("text"))).alias("token"))
    return found.groupBy("q", "token").agg(F.count(F.lit(1)).alias("qtf"))


def lexical_scores(units: DataFrame, queries: DataFrame, salts: int = 16) -> DataFrame:
    """(q, key, shared, text_score): tf of the query times tf of the unit times idf; a unit must share two different terms,
    or the only one. Postings are cut to the queries' terms before they are counted, and a term meets the queries under
    ``salts`` keys, so the units of one frequent term are spread over tasks."""
    terms = query_terms(queries)
    asked = terms.select("token").distinct()
    held = units.select(*KEY, F.explode(tokens(F.col("content"))).alias("token")).join(asked, "token", "left_semi")
    post = held.groupBy(*KEY, "token").agg(F.count(F.lit(1)).alias("tf"))
    df = post.groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    n = units.agg(F.count(F.lit(1)).alias("n"))
    idf = df.join(F.broadcast(n), F.lit(True)).select("token", F.log1p((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))
    floor = terms.groupBy("q").agg(F.least(F.lit(2), F.count(F.lit(1))).alias("floor"))
    salt = F.pmod(F.xxhash64(*KEY), F.lit(salts)).cast("int")
    asking = terms.join(idf, "token").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    met = post.withColumn("salt", salt).join(asking, ["token", "salt"])
    score = F.round(F.sum(F.col("qtf") * F.col("tf") * F.col("idf")), 6)
    hits = met.groupBy("q", *KEY).agg(F.count(F.lit(1)).alias("shared"), score.alias("text_score"))
    return hits.join(floor, "q").filter("shared >= floor").drop("floor")


def lexical_top(units: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(W.partitionBy("q").orderBy(F.desc("text_score"), *KEY))
    return lexical_scores(units, queries).withColumn("text_rank", rank).filter(F.col("text_rank") <= k)


def fuse(dense: DataFrame, lexical: DataFrame, k: int = 60) -> DataFrame:
    """Reciprocal rank fusion: a full outer join of both rankings."""
    key = ["q", *KEY]
    both = dense.select(*key, "dense_rank").join(lexical.select(*key, "text_rank"), key, "full_outer")
    part = lambda r: F.coalesce(1.0 / (F.col(r) + k), F.lit(0.0))
    return both.withColumn("score", F.round(part("dense_rank") + part("text_rank"), 12))


def hits(fused: DataFrame, limit: int) -> DataFrame:
    """The best of each query in a total order."""
    order = W.partitionBy("q").orderBy(F.desc("score"), F.asc_nulls_last("dense_rank"), *KEY)
    return fused.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit)


def moments(ranked: DataFrame, limit: int = 5, k: int = 10, second: float = 0.5) -> DataFrame:
    """Hits grouped by (video, chunk): the best counts whole, the second half, further ones not. ``hits`` holds what each unit
    gave, in rank order: sampler, question, content and structured answer where the hits carry them, and its rank in both
    halves (null where a half was silent)."""
    place = F.row_number().over(W.partitionBy("q", "video_id", "chunk_id").orderBy("rank"))
    weight = F.when(F.col("place") == 1, 1.0 / (F.col("rank") + k)).when(F.col("place") == 2, second / (F.col("rank") + k))
    held = [c for c in ("sampler_id", "question", "content", "structured", "dense_rank", "text_rank") if c in ranked.columns]
    out = ranked.withColumn("place", place).groupBy("q", "video_id", "chunk_id").agg(
        F.round(F.sum(weight), 12).alias("moment_score"), F.count(F.lit(1)).alias("units"),
        F.array_sort(F.collect_list(F.struct("rank", *held))).alias("hits"), F.count("text_rank").alias("lexical_hits"),
    )
    out = out.withColumn("samplers", F.transform("hits", lambda x: x["sampler_id"]))
    order = W.partitionBy("q").orderBy(F.desc("moment_score"), "video_id", "chunk_id")
    return out.withColumn("moment_rank", F.row_number().over(order)).filter(F.col("moment_rank") <= limit)


@dataclass(frozen=True)
class Scope:
    """What a search may look at. Empty values are no constraint; chunks and a time window meet, and ``widen`` adds neighbours.

    videos: (video_id); chunks: (video_id, chunk_id); equal: columns of the units with a value or a list of values; having:
    a condition on the structured answer, as a Column."""

    videos: DataFrame | None = None
    chunks: DataFrame | None = None
    after: float | None = None
    before: float | None = None
    widen: int = 0
    equal: dict = field(default_factory=dict)
    having: Column | None = None

    @property
    def narrow(self) -> bool:
        return self.chunks is not None or self.after is not None or self.before is not None

    @property
    def filtered(self) -> bool:
        return self.having is not None or any(v not in (None, [], "") for v in self.equal.values())

    def wanted(self, chunks: DataFrame) -> DataFrame | None:
        """The (video_id, chunk_id) in question over the grid ``chunks``; None is all."""
        if not self.narrow:
            return None
        out = chunks if self.chunks is None else self.chunks
        if self.after is not None or self.before is not None:
            inside = grid.window_chunks(chunks, self.after, self.before).select("video_id", "chunk_id")
            out = out.select("video_id", "chunk_id").join(inside, ["video_id", "chunk_id"], "left_semi")
        out = out.select("video_id", "chunk_id").distinct()
        return grid.widen(out, chunks, self.widen) if self.widen else out

    def of(self, rows: DataFrame, wanted: DataFrame | None) -> DataFrame:
        out = scope(rows, self.videos, **{k: v for k, v in self.equal.items() if k in rows.columns})
        out = out if self.having is None else out.filter(self.having)
        return out if wanted is None else out.join(wanted, ["video_id", "chunk_id"], "left_semi")


def search(
    units: DataFrame, vectors: DataFrame, queries: DataFrame, limit: int = 20, moments_limit: int = 5,
    within: Scope | None = None, chunks: DataFrame | None = None,
) -> DataFrame:
    """The whole: candidates in scope, both rankings at the same depth over them, fused, cut, met with their units and grouped;
    with ``chunks`` moments have their times."""
    within = within or Scope()
    wanted = within.wanted(chunks) if within.narrow else None
    units = within.of(units, wanted)
    kept = vectors.join(units.select(*KEY).distinct(), KEY, "left_semi")
    fused = fuse(dense_top(kept, queries, depth(limit)), lexical_top(units, queries, depth(limit)))
    found = moments(hits(fused, limit).join(units, KEY), moments_limit)
    return found if chunks is None else found.join(chunks.select("video_id", "chunk_id", "start_ts", "end_ts"), ["video_id", "chunk_id"], "left")


def search_notes(units: DataFrame, queries: DataFrame, found: DataFrame, within: Scope, chunks: DataFrame) -> DataFrame:
    """(q, note): what a caller should know of the ranking of each query, as rows: an empty window, nothing in scope, filters
    that lower scores, more than one video, no lexical half."""
    wanted = within.wanted(chunks)
    said = []
    empty = wanted is not None and wanted.isEmpty()
    if empty:
        said.append("no chunk matches that window")
    elif within.of(units, wanted).isEmpty():
        said.append("nothing matched those filters")
    if within.filtered:
        said.append("filters lower scores: a chunk has fewer units")
    n = units.select("video_id").distinct() if within.videos is None else within.videos.select("video_id").distinct()
    if within.videos is None or n.count() > 1:
        said.append(f"scope is {n.count()} videos: a chunk id counts inside its video only")
    asked = queries.select("q")
    general = asked.select("q", F.explode(F.array(*map(F.lit, said)) if said else F.array().cast("array<string>")).alias("note"))
    fired = found.groupBy("q").agg(F.sum("lexical_hits").alias("n")).filter("n > 0")
    return general.unionByName(asked.join(fired, "q", "left_anti").select("q", F.lit("no lexical match").alias("note")))


# evaluation of rankings: relevant is (q, chunk_id)


def graded(found: DataFrame, relevant: DataFrame, cases: DataFrame, k: int = 5) -> DataFrame:
    """Reciprocal rank, top-1 and recall at k of each case; cases without relevant chunks have 0."""
    good = found.join(relevant, ["q", "chunk_id"], "left_semi").filter(F.col("moment_rank") <= k)
    best = good.groupBy("q").agg(F.min("moment_rank").alias("first"), F.countDistinct("chunk_id").alias("got"))
    size = relevant.groupBy("q").agg(F.countDistinct("chunk_id").alias("all"))
    fired = found.groupBy("q").agg(F.sum("lexical_hits").alias("lexical_hits"))
    out = cases.select("q").join(best, "q", "left").join(size, "q", "left").join(fired, "q", "left")
    return out.select(
        "q", F.coalesce(1.0 / F.col("first"), F.lit(0.0)).alias("mrr"), F.coalesce((F.col("first") == 1).cast("double"), F.lit(0.0)).alias("top1"),
        F.coalesce(F.col("got") / F.col("all"), F.lit(0.0)).alias("recall"), F.coalesce("lexical_hits", F.lit(0)).alias("lexical_hits"),
    )


def overlaps(queries: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Share of a query's words that the corpus has, and its band."""
    words = queries.select("q", F.posexplode_outer(tokens(F.col("text"))).alias("n", "token"))
    known = vocabulary.select("token", F.lit(1.0).alias("known"))
    share = F.coalesce(F.sum(F.coalesce("known", F.lit(0.0))) / F.nullif(F.count("token"), F.lit(0)), F.lit(0.0))
    out = words.join(known, "token", "left").groupBy("q").agg(share.alias("overlap"))
    band = F.when(F.col("overlap") < 0.34, "low overlap").when(F.col("overlap") < 0.67, "mixed").otherwise("high overlap")
    return out.withColumn("band", band)


def summary(grades: DataFrame, bands: DataFrame, timed: DataFrame | None = None) -> DataFrame:
    """Means by band and over all cases (band "all"); timed (q, elapsed_s) adds the median time."""
    mean = [F.round(F.avg(c), 4).alias(c) for c in ("mrr", "top1", "recall")]
    fired = F.count_if(F.col("lexical_hits") > 0).alias("lexical_fired_on")
    met = grades.join(bands.select("q", F.explode(F.array("band", F.lit("all"))).alias("band")), "q")
    if timed is None:
        return met.groupBy("band").agg(F.count(F.lit(1)).alias("n"), *mean, fired)
    median = F.round(F.percentile("elapsed_s", 0.5), 3).alias("median_s")
    return met.join(timed, "q", "left").groupBy("band").agg(F.count(F.lit(1)).alias("n"), *mean, fired, median)


def label_check(bands: DataFrame, kinds: DataFrame) -> DataFrame:
    """kinds (q, kind): whether a case's label disagrees with its wording. A paraphrase should share little of the corpus's
    words, a literal case much."""
    disagrees = (F.col("kind") == "paraphrase") & (F.col("overlap") > 0.67) | (F.col("kind") == "literal") & (F.col("overlap") < 0.34)
    return kinds.join(bands, "q").select("q", "kind", "overlap", "band", F.coalesce(disagrees, F.lit(False)).alias("disagrees"))
