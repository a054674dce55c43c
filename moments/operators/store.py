"""Keyed tables: upserts, deletes, cascades, incremental maintenance, browsing and checks, as joins over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from moments.operators.folder import new_folder


def fan_out(rows: DataFrame, sinks: dict[str, Callable[[DataFrame], None]]) -> DataFrame:
    """Writes rows to every sink and returns the report (sink, written, error). The rows are computed once, into the shared
    folder. The first sink must succeed and raises if it does not; the others are best-effort."""
    spark, at = rows.sparkSession, new_folder(rows.sparkSession, "fan-out")
    rows.write.parquet(at)
    once = spark.read.schema(rows.schema).parquet(at)
    report = []
    for n, (name, write) in enumerate(sinks.items()):
        try:
            write(once)
            report.append((name, True, None))
        except Exception as problem:  # of a user's sink, whatever it is
            if n == 0:
                raise
            report.append((name, False, str(problem)))
    return spark.createDataFrame(report, "sink string, written boolean, error string")


def upsert(target: DataFrame, source: DataFrame, keys: list[str], order: str | None = None) -> DataFrame:
    """Last write wins on the key; of several rows of the source the last by ``order``."""
    if order:
        last = F.row_number().over(W.partitionBy(*keys).orderBy(F.desc(order)))
        source = source.withColumn("_n", last).filter("_n = 1").drop("_n")
    return target.join(source.select(*keys), keys, "left_anti").unionByName(source.select(*target.columns))


def delete_stale_chunks(rows: DataFrame, grid: DataFrame) -> DataFrame:
    """Rows whose chunk the video's grid still has; videos without a grid keep theirs."""
    n = grid.groupBy("video_id").agg(F.count(F.lit(1)).alias("_n"))
    return rows.join(n, "video_id", "left").filter("_n is null or chunk_id < _n").drop("_n")


def delete_except(rows: DataFrame, match: Column, column: str, keep: DataFrame) -> DataFrame:
    """Inside the matched scope only the listed keys stay; other rows are left alone."""
    inside = rows.filter(match).join(keep.select(column).distinct(), column, "left_semi")
    return rows.filter(~F.coalesce(match, F.lit(False))).unionByName(inside.select(*rows.columns))


def delete_where(rows: DataFrame, **equal) -> DataFrame:
    hit = F.lit(True)
    for name, value in equal.items():
        hit = hit & F.col(name).eqNullSafe(F.lit(value))
    return rows.filter(~hit)


def cascade(tables: dict[str, DataFrame], parents: DataFrame, key: str, children: list[str]) -> dict[str, DataFrame]:
    """The listed children lose the rows of vanished parents; other tables (paid answers) never do."""
    left = parents.select(key).distinct()
    return {n: t.join(left, key, "left_semi") if n in children else t for n, t in tables.items()}


def append_versions(kept: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Append-only: a version that is already there is never written again."""
    return kept.unionByName(new.dropDuplicates(keys).join(kept.select(*keys), keys, "left_anti").select(*kept.columns))


def changed(current: DataFrame, stored: DataFrame, keys: list[str], mark: str = "text_hash") -> DataFrame:
    """Rows that the store lacks or holds with another hash."""
    old = stored.select(*keys, F.col(mark).alias("_old"))
    return current.join(old, keys, "left").filter(~F.col(mark).eqNullSafe(F.col("_old"))).drop("_old")


def stale(stored: DataFrame, live: DataFrame, keys: list[str]) -> DataFrame:
    """Keys of the store that are no longer named."""
    return stored.select(*keys).join(live.select(*keys), keys, "left_anti")


def maintain(stored: DataFrame, current: DataFrame, keys: list[str], compute, mark: str = "text_hash") -> DataFrame:
    """The store after an incremental run: what changed is computed and upserted, what vanished is dropped."""
    fresh = compute(changed(current, stored, keys, mark))
    return upsert(stored, fresh, keys).join(current.select(*keys), keys, "left_semi")


def resumable(answers: DataFrame, plan: DataFrame, keys: list[str], marks: list[str]) -> DataFrame:
    """Stored answers that are still current: every mark (grid, model, question) equals the plan's."""
    return answers.join(plan.select(*keys, *marks).distinct(), [*keys, *marks], "left_semi")


def planned(frames: DataFrame, questions: DataFrame, done: DataFrame, limit: int) -> DataFrame:
    """(video_id, chunk_id, sampler_id, question) still to ask, at most limit a video, in order. Runs without an entry in
    questions ask the one named after themselves."""
    runs = frames.groupBy("video_id", "chunk_id", "sampler_id").agg(F.count(F.lit(1)).alias("frames"))
    asked = runs.join(questions, "sampler_id", "left").withColumn("question", F.explode(F.coalesce("questions", F.array("sampler_id"))))
    left = asked.join(done, ["video_id", "chunk_id", "sampler_id", "question"], "left_anti")
    place = F.row_number().over(W.partitionBy("video_id").orderBy("chunk_id", "sampler_id", "question"))
    return left.withColumn("place", place).filter(F.col("place") <= limit).drop("questions")


def answer_id(sampler: Column, question: Column) -> Column:
    return F.when(sampler == question, sampler).otherwise(F.concat_ws(":", sampler, question))


OPERATORS = {
    "eq": lambda c, v: c == v, "neq": lambda c, v: c != v, "gt": lambda c, v: c > v, "gte": lambda c, v: c >= v, "lt": lambda c, v: c < v,
    "lte": lambda c, v: c <= v, "like": lambda c, v: c.like(v), "ilike": lambda c, v: c.ilike(v),
    "is": lambda c, v: c.isNull() if v in (None, "null", "") else c == v,
    "in": lambda c, v: c.isin([x.strip() for x in v.split(",")] if isinstance(v, str) else list(v)),
    "cs": lambda c, v: F.size(F.array_except(F.array(*map(F.lit, v)), c)) == 0,
    "cd": lambda c, v: F.size(F.array_except(c, F.array(*map(F.lit, v)))) == 0,
}


def browse(rows: DataFrame, filters=(), order: list | None = None, limit: int = 100, offset: int = 0, heavy: tuple = ()) -> DataFrame:
    """A page of an allow-listed query with the exact total of the unpaged result; wide columns are left out. Blank values are
    no filter, except for ``is``."""
    for name, op, value in filters:
        if name not in rows.columns or op not in OPERATORS:
            raise ValueError(f"unknown filter {name} {op}")
        if value in ("", None) and op != "is":
            continue
        rows = rows.filter(OPERATORS[op](F.col(name), value))
    shown = rows.select(*[c for c in rows.columns if c not in heavy])
    total = shown.agg(F.count(F.lit(1)).alias("total"))
    page = shown.orderBy(*(order or [])).offset(offset).limit(limit)
    return page.join(F.broadcast(total), F.lit(True))


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    out = None
    for name, t in sorted(tables.items()):
        one = t.agg(F.lit(name).alias("table"), F.count(F.lit(1)).alias("rows"))
        out = one if out is None else out.unionByName(one)
    return out


def inventory(artifacts: dict[str, DataFrame], key: str) -> DataFrame:
    """By key, which artifacts exist."""
    out = None
    for name, t in artifacts.items():
        one = t.select(key, F.lit(name).alias("artifact")).distinct()
        out = one if out is None else out.unionByName(one)
    return out.groupBy(key).agg(F.array_sort(F.collect_set("artifact")).alias("artifacts"))


def compare_stores(rebuilt: DataFrame, original: DataFrame, key: str, content: str) -> DataFrame:
    """Counts of compared, identical, differing, missing and orphaned entries by digest; orphans are no failure."""
    a = rebuilt.select(key, F.sha2(F.col(content).cast("binary"), 256).alias("a"))
    b = original.select(key, F.sha2(F.col(content).cast("binary"), 256).alias("b"))
    both = a.join(b, key, "full_outer")
    here, there = F.col("a").isNotNull(), F.col("b").isNotNull()
    return both.agg(
        F.count_if(here & there).alias("compared"), F.count_if(F.col("a") == F.col("b")).alias("identical"),
        F.count_if(F.col("a") != F.col("b")).alias("differing"), F.count_if(~here & there).alias("missing"), F.count_if(here & ~there).alias("orphaned"),
    )


def attribute_mismatches(source: DataFrame, manifest: DataFrame, key: str, names: list[str]) -> DataFrame:
    """(key, attribute, source, manifest) where both sides know the attribute and differ."""
    both = source.alias("s").join(manifest.alias("m"), key)
    pairs = F.explode(
        F.array(*[F.struct(F.lit(n).alias("attribute"), F.col(f"s.{n}").cast("string").alias("a"), F.col(f"m.{n}").cast("string").alias("b")) for n in names])
    )
    found = both.select(key, pairs.alias("p")).filter("p.a <> p.b")
    return found.select(key, "p.attribute", F.col("p.a").alias("source"), F.col("p.b").alias("manifest"))


def validate(documents: DataFrame, key: str, column: str, required: dict[str, str]) -> DataFrame:
    """(key, problem) of JSON documents: unparsable, a required key missing, or of another type than required (BIGINT, STRING,
    BOOLEAN and so on)."""
    v = F.try_parse_json(column)
    rows = documents.select(key, column, v.alias("v"))
    problems = [F.when(F.col("v").isNull(), F.lit("not json"))]
    for name, kind in required.items():
        value = F.try_variant_get("v", f"$.{name}", "variant")
        problems.append(F.when(F.col("v").isNotNull() & value.isNull(), F.lit(f"{name} is missing")))
        problems.append(F.when(F.schema_of_variant(value) != kind, F.lit(f"{name} is no {kind}")))
    return rows.select(key, F.explode(F.array_compact(F.array(*problems))).alias("problem"))


def layered(builtin: DataFrame, custom: DataFrame, key: str) -> DataFrame:
    """Built-ins win; customs that they shadow are reported, not used."""
    shadow = builtin.select(key).distinct().withColumn("_b", F.lit(True))
    marked = custom.join(shadow, key, "left")
    own = marked.select(*custom.columns, F.when(F.col("_b"), "shadowed").otherwise("custom").alias("origin"))
    return builtin.select(*custom.columns, F.lit("builtin").alias("origin")).unionByName(own)


def definition_problems(definitions: DataFrame, kinds: list[str], fields: DataFrame) -> DataFrame:
    """(name, problem) of definitions (name, kind, instruction, field): unknown kind, blank instruction, unknown field."""
    known = fields.select("field", F.lit(True).alias("_f")).distinct()
    met = definitions.join(known, "field", "left")
    problems = F.array_compact(
        F.array(
            F.when(~F.col("kind").isin(kinds), F.lit("unknown kind")), F.when(F.trim("instruction") == "", F.lit("blank instruction")),
            F.when(F.col("_f").isNull(), F.lit("unknown field")),
        )
    )
    return met.select("name", F.explode(problems).alias("problem"))


def width_check(vectors: DataFrame, space: str, vector: str) -> DataFrame:
    """Least and greatest width of each embedding space, and whether they agree."""
    n = F.size(vector)
    out = vectors.groupBy(space).agg(F.min(n).alias("least"), F.max(n).alias("most"), F.count(F.lit(1)).alias("rows"))
    return out.withColumn("ok", F.col("least") == F.col("most"))
