"""Documents as a source: one JSON document for each video and kind, read by declared nested schemas.

A kind is a folder of versions. A write puts the documents of its videos into a new version and then adds the version's number to the
pointers, so a reader sees all of a write or nothing; of each video the newest version counts. A document that is not JSON, or not of its
schema's shape, comes as a row with its raw text; a video without a document of some kind is null in that kind.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from moments.operators.folder import new_folder

RAW = "_raw"


class DocumentStore:
    """Documents under a root folder. ``schemas``: kind to the DDL of its document, without the version tag."""

    def __init__(self, spark: SparkSession, schemas: dict[str, str], root: str | None = None):
        self.spark, self.schemas, self.root = spark, schemas, root or new_folder(spark, "documents")

    def _versions(self, kind: str) -> list[int]:
        try:
            return sorted(r.version for r in self.spark.read.parquet(f"{self.root}/{kind}/pointers").collect())
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return []

    def write(self, kind: str, documents: DataFrame) -> int:
        """documents (video_id, document as JSON text): adds them, or replaces those of the same videos. One video, one row."""
        version = max(self._versions(kind), default=0) + 1
        rows = documents.select(F.col("video_id").cast("string").alias("video_id"), F.regexp_replace("document", r"[\r\n]", " ").alias("value"))
        # a line a document, the video before the first tab, so that any text is held as it is
        rows.select(F.concat_ws("\t", "video_id", "value").alias("value")).write.mode("overwrite").option("compression", "gzip").text(f"{self.root}/{kind}/v{version}")
        self.spark.createDataFrame([(version,)], "version int").coalesce(1).write.mode("append").parquet(f"{self.root}/{kind}/pointers")
        return version

    def read(self, kind: str) -> DataFrame:
        """(video_id, document struct, _raw): the newest document of each video; _raw holds the text where it could not be read."""
        schema, out = self.schemas[kind], None
        for version in self._versions(kind):
            lines = self.spark.read.text(f"{self.root}/{kind}/v{version}")
            one = lines.select(
                F.substring_index("value", "\t", 1).alias("video_id"), F.regexp_extract("value", r"^[^\t]*\t(.*)$", 1).alias("text"), F.lit(version).alias("version")
            )
            out = one if out is None else out.unionByName(one)
        if out is None:
            out = self.spark.createDataFrame([], "video_id string, text string, version int")
        newest = out.groupBy("video_id").agg(F.max_by("text", "version").alias("text"))
        held = F.from_json("text", f"{schema}, {RAW} string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": RAW})
        read = newest.select("video_id", "text", held.alias("x"))
        names = [f.name for f in read.schema["x"].dataType.fields if f.name != RAW]
        bad = F.when(F.col("x").isNull(), F.col("text")).otherwise(F.col(f"x.{RAW}"))
        return read.select("video_id", F.when(bad.isNull(), F.struct(*[F.col(f"x.`{n}`").alias(n) for n in names])).alias("document"), bad.alias(RAW))

    def context(self, grid: str, kinds: list[str]) -> DataFrame:
        """(video_id, one struct a kind): the videos that have a grid, and null where one lacks another kind."""
        out = self.read(grid).filter("document IS NOT NULL").select("video_id", F.col("document").alias(grid))
        for kind in kinds:
            out = out.join(self.read(kind).select("video_id", F.col("document").alias(kind)), "video_id", "left")
        return out

    def problems(self, kind: str, required: dict[str, Column]) -> DataFrame:
        """(video_id, kind, problem): documents that cannot be read, and for each test of ``required`` those that fail it."""
        read = self.read(kind)
        tests = [F.when(~F.coalesce(test, F.lit(False)), F.lit(name)) for name, test in required.items()]
        found = F.when(F.col(RAW).isNotNull(), F.array(F.lit("cannot be read"))).otherwise(F.array_compact(F.array(*tests)))
        return read.select("video_id", F.lit(kind).alias("kind"), F.explode(found).alias("problem"))

    def inventory(self, grid: str, policy: Column, chunks: Column, duration: Column) -> DataFrame:
        """(video_id, artifacts, policy, chunks, duration_s): what each video has, and what its grid says."""
        held = None
        for kind in sorted(self.schemas):
            one = self.read(kind).select("video_id", F.lit(kind).alias("kind"))
            held = one if held is None else held.unionByName(one)
        kinds = held.groupBy("video_id").agg(F.array_sort(F.collect_set("kind")).alias("artifacts"))
        told = self.read(grid).select("video_id", policy.alias("policy"), chunks.cast("long").alias("chunks"), duration.alias("duration_s"))
        return kinds.join(told, "video_id", "left")


def chunk_rows(documents: DataFrame) -> DataFrame:
    """(video_id, chunk_id, start_ts, end_ts, policy) of timelines {policy, duration_s, chunks: [{start_ts, end_ts}]}."""
    x = documents.select("video_id", F.col("document.policy").alias("policy"), F.posexplode("document.chunks").alias("chunk_id", "c"))
    return x.select("video_id", F.col("chunk_id").cast("long").alias("chunk_id"), "c.start_ts", "c.end_ts", "policy")


def run_rows(documents: DataFrame) -> DataFrame:
    """(video_id, chunk_id, sampler, frame_count, questions) of manifests {samplers: map of {prompts}, chunks: [{chunk_id, samplers: map of
    {frame_count}}]}: the questions of a run are those of its sampler, or the sampler's own name."""
    x = documents.select("video_id", F.col("document.samplers").alias("config"), F.explode("document.chunks").alias("c"))
    y = x.select("video_id", "config", "c.chunk_id", F.explode("c.samplers").alias("sampler", "run"))
    asked = F.try_element_at("config", F.col("sampler")).prompts
    return y.select("video_id", "chunk_id", "sampler", "run.frame_count", F.when(F.size(asked) > 0, asked).otherwise(F.array("sampler")).alias("questions"))


def answer_rows(documents: DataFrame) -> DataFrame:
    """(video_id, chunk_id, sampler, question, summary, structured, timeline, manifest): descriptions {fingerprints: {timeline, manifest}, chunks:
    [{chunk_id, answers: map of {summary, structured}}]} with keys ``sampler`` or ``sampler:question``; both fingerprints go on each row."""
    x = documents.select("video_id", F.col("document.fingerprints").alias("f"), F.explode("document.chunks").alias("c"))
    y = x.select("video_id", "f", "c.chunk_id", F.explode("c.answers").alias("key", "a"))
    sampler = F.substring_index("key", ":", 1)
    question = F.coalesce(F.nullif(F.regexp_extract("key", r"^[^:]*:(.*)$", 1), F.lit("")), sampler)
    return y.select("video_id", "chunk_id", sampler.alias("sampler"), question.alias("question"), "a.summary", "a.structured", "f.timeline", "f.manifest")


def entity_rows(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entities, mentions) of link answers {entities: [{entity_id, label, mentions: [map of texts]}]}: a mention's entry is all of its map but key,
    chunk, sampler and doubt."""
    e = documents.select("video_id", F.explode("document.entities").alias("e"))
    entities = e.select("video_id", "e.entity_id", "e.label", F.size("e.mentions").cast("long").alias("n"))
    m = e.select("video_id", "e.entity_id", F.posexplode("e.mentions").alias("place", "m"))
    own = ("key", "chunk", "sampler", "doubt")
    told = lambda k: F.try_element_at("m", F.lit(k))
    return entities, m.select(
        "video_id", "entity_id", F.col("place").cast("long").alias("place"), told("chunk").cast("long").alias("chunk_id"), told("sampler").alias("sampler"), told("doubt").alias("doubt"),
        F.map_filter("m", lambda k, v: ~k.isin(*own)).alias("entry"),
    )

