"""Mixing sources to target weights by Sainte-Lague apportionment, in DataFrame functions only.

Targets are shares by weight, capped at a multiple of each source and refilled by weight. Blocks of ``block`` words are then
seats: the sources get them by the highest quotients target / (2k + 1), and the shards of a source by words / (2k + 1).
Inside a shard the documents stand in seeded order and their words are cut into blocks; every block is taken once for each
whole round of the quota, and the rest are the blocks that follow a seeded start.

Shards grow in number with their source, so that no window holds more than about ``shard_words`` words of documents; documents
without words take nothing and enter no window. Only the seats that are in doubt (about three for each party) are ranked, by
ranges of quotients and the counts of the ranges before, so the shards of the largest source need not meet in one task. The
sources themselves, whose number is that of a catalogue, do. A shard takes each of its blocks twice at most; what rounding
gives it beyond that (less than a block) is not taken.

Rows of one doc_id, or without any, that hold more words than a shard are drawn one by one, so they fill shards like other rows.

Defined results: a null text has size 0 and takes 0; a text of any length is one document of one shard, of which blocks are taken; a null source is a source of its own, after all others; repeated rows
are separate documents of the same order; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from moments.llm.common import hex_long, n_words, save

WEIGHTS = (5, 2, 1)


def ranked(df: DataFrame, group: list[str], order: list[Column], out: str) -> DataFrame:
    """Adds column out: the rank of each row inside its group under a total order. Rows are dealt by ranges of (group, order);
    a rank is the one in its range plus the rows of the group in the ranges before, so no task holds a large group."""
    parts = save(df.repartitionByRange(*[F.col(c) for c in group], *order).withColumn("_part", F.spark_partition_id()))
    sizes = parts.groupBy(*group, "_part").agg(F.count(F.lit(1)).alias("_rows"))  # a row for each range and group in it
    earlier = W.partitionBy(*group).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    before = sizes.select(*group, "_part", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_before"))
    inside = F.row_number().over(W.partitionBy(*group, "_part").orderBy(*order))
    met = parts.withColumn("_inside", inside).join(before, [*group, "_part"])
    return met.withColumn(out, F.col("_inside") + F.col("_before")).drop("_part", "_inside", "_before")


def apportion(parties: DataFrame, group: list[str], votes: str, seats: str, tie: list[str], out: str) -> DataFrame:
    """Adds column out: the seats of each party, by highest quotients votes / (2k + 1) inside its group.

    A party's seats lie within its quota times 1 +- parties / (2 seats), so only those are ranked."""
    quota = F.when(F.col("_total") > 0, F.col(votes) * F.col(seats) / F.col("_total")).otherwise(0.0)
    play = F.when(F.col(seats) > 0, F.col("_n") / (2.0 * F.col(seats))).otherwise(0.0)
    low = F.greatest(F.lit(0), F.floor(quota * (1 - play)) - 1).cast("long")
    high = (F.ceil(quota * (1 + play)) + 1).cast("long")
    columns = parties.columns
    parties = save(parties)
    whole = parties.groupBy(*group).agg(F.count(F.lit(1)).alias("_n"), F.sum(votes).cast("double").alias("_total"))
    sized = parties.join(whole, group).withColumn("_low", low).withColumn("_high", high)
    given = sized.groupBy(*group).agg(F.sum("_low").alias("_given"))
    doubtful = sized.withColumn("_k", F.explode(F.sequence("_low", "_high"))).withColumn("_quotient", F.col(votes) / (2.0 * F.col("_k") + 1))
    order = [F.col("_quotient").desc(), *[F.col(c) for c in tie], F.col("_k")]
    won = (F.col("_rank") <= F.col(seats) - F.col("_given")) & (F.col(votes) > 0)
    return (
        ranked(doubtful, group, order, "_rank").join(given, group).groupBy(*columns)
        .agg((F.first("_low") + F.sum(F.when(won, 1).otherwise(0))).cast("long").alias(out))
    )


def targets(sources: DataFrame, weights=WEIGHTS, share: float = 1.5, cap: int = 2) -> DataFrame:
    """sources (no_source, name, source_size) with order, weight and target. Sources below the water line by size over
    weight stop at their cap; the rest share what is left by weight."""
    order = W.partitionBy("one").orderBy("no_source", "name")
    ordered = sources.withColumn("one", F.lit(1)).withColumn("place", F.row_number().over(order))
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.col("place") - 1) % len(weights) + 1).cast("int"))
    w = ordered.withColumn("weight", weight.cast("long"))
    by_need = (
        W.partitionBy("one")
        .orderBy(F.col("source_size") / F.col("weight").cast("double"), "place")
        .rowsBetween(W.unboundedPreceding, -1)
    )
    whole = W.partitionBy("one")
    words = F.sum("source_size").over(whole).cast("double") * share
    left = words - cap * F.coalesce(F.sum("source_size").over(by_need), F.lit(0)).cast("double")
    weight_left = F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(by_need), F.lit(0))
    capped = cap * F.col("source_size") * weight_left.cast("double") < F.col("weight") * left
    w = w.withColumn("words", words).withColumn("capped", capped)
    rest = F.col("words") - cap * F.coalesce(F.sum(F.when(F.col("capped"), F.col("source_size"))).over(whole), F.lit(0))
    level = rest / F.sum(F.when(~F.col("capped"), F.col("weight"))).over(whole)
    return w.withColumn("level", level).withColumn(
        "target",
        F.when(F.col("capped"), cap * F.col("source_size").cast("double")).otherwise(F.col("weight") * F.col("level")),
    ).select("one", "no_source", "name", "source_size", "place", "weight", "words", "target")


def spread_out(sizes: DataFrame, shard_words: int) -> DataFrame:
    """sizes, in which rows of one doc_id (or of none) that would overfill a shard get draws of their own, by their place in the table.
    Such ids have a ten thousandth of all words or more, so they are 10,000 at most."""
    total = sizes.agg(F.sum("size")).first()[0] or 0
    heavy = sizes.groupBy(F.col("doc_id").alias("heavy_id")).agg(F.sum("size").alias("heavy_words"))
    heavy = heavy.filter(F.col("heavy_words") >= max(shard_words, total / 10_000)).select("heavy_id", F.lit(True).alias("heavy"))
    own = F.md5(F.concat_ws(":", "draw", F.col("row_place").cast("string")))
    met = sizes.join(F.broadcast(heavy), F.col("doc_id").eqNullSafe(F.col("heavy_id")), "left")
    return met.withColumn("draw", F.when(F.col("heavy"), own).otherwise(F.col("draw"))).drop("heavy_id", "heavy", "row_place")


def mix(
    docs: DataFrame, size: Column | None = None, weights=WEIGHTS, share: float = 1.5, cap: int = 2, block: int = 32,
    shard_words: int = 1 << 18, seed: str = "mix", carry: tuple = (),
) -> DataFrame:
    """(doc_id, size, no_source, name, source_size, target, taken), one row per document, with the columns of carry."""
    size = n_words(F.col("text")) if size is None else size
    sizes = spread_out(save(
        docs.select(
            "doc_id",
            *carry,
            size.alias("size"),
            F.col("source").isNull().cast("int").alias("no_source"),
            F.coalesce("source", F.lit("")).alias("name"),
            F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))).alias("draw"),
            F.monotonically_increasing_id().alias("row_place"),
        )
    ), shard_words)
    source = ["no_source", "name"]
    sums = sizes.groupBy(*source).agg(F.sum("size").alias("source_size"))
    aims = targets(sums, weights, share, cap).withColumn("all_seats", F.floor(F.col("words") / block + 0.5).cast("long"))
    quotas = save(
        apportion(aims, ["one"], "target", "all_seats", ["place"], "source_seats")
        .withColumn("n_shards", F.greatest(F.lit(1), F.ceil(F.col("source_size") / shard_words)).cast("long"))
        .select(*source, "source_size", "target", "source_seats", "n_shards")
    )
    met = sizes.join(quotas, source)
    placed = met.filter("size > 0").withColumn("shard", hex_long(F.col("draw")) % F.col("n_shards"))
    shards = apportion(
        placed.groupBy(*source, "shard").agg(
            F.sum("size").alias("shard_words"), F.first("source_seats").alias("source_seats")
        ),
        source, "shard_words", "source_seats", ["shard"], "quota",
    )
    n = F.ceil(F.col("shard_words") / block).cast("long")
    start = hex_long(F.md5(F.concat_ws(":", F.lit(seed), "name", "no_source", "shard")))
    shards = save(
        shards.withColumn("n", n)
        .withColumn("q", F.least("quota", cap * F.col("n")))
        .withColumn("rounds", F.when(F.col("n") > 0, F.floor(F.col("q") / F.col("n"))).otherwise(0).cast("long"))
        .withColumn("rest", F.col("q") - F.col("rounds") * F.col("n"))
        .withColumn("start", F.when(F.col("n") > 0, start % F.greatest(F.col("n"), F.lit(1))).otherwise(0))
        .select(*source, "shard", "rounds", "rest", "start", "n")
    )
    end = F.sum("size").over(
        W.partitionBy(*source, "shard").orderBy("draw", "doc_id", "size").rowsBetween(W.unboundedPreceding, 0)
    )
    laid = placed.withColumn("end", end).withColumn("begin", F.col("end") - F.col("size"))

    def within(low, high):
        return F.greatest(F.lit(0), F.least("end", high) - F.greatest("begin", low))

    first, last = F.col("start") * block, (F.col("start") + F.col("rest")) * block
    taken = F.col("rounds") * F.col("size") + within(first, last) + within(F.lit(0), last - F.col("n") * block)
    columns = ["doc_id", "size", *source, "source_size", "target"]
    some = laid.join(shards, [*source, "shard"]).select(*columns, taken.cast("long").alias("taken"), *carry)
    return some.unionByName(met.filter("size = 0").select(*columns, F.lit(0).cast("long").alias("taken"), *carry))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """docs, each row repeated as often as the mix takes it, to the nearest whole copy (halves up). Rows that are equal in
    doc_id and text share what they take."""
    keys = docs.select("doc_id", "source", n_words(F.col("text")).alias("mix_size"), F.xxhash64("text").alias("mix_text"))
    taken = mix(keys, F.col("mix_size"), carry=("mix_text",), **options)
    copies = (
        taken.groupBy("doc_id", "mix_text")
        .agg(F.sum("taken").alias("t"), F.sum("size").alias("s"))
        .select(
            F.col("doc_id").alias("mix_id"), "mix_text",
            F.when(F.col("s") > 0, F.floor(F.col("t") / F.col("s") + 0.5)).otherwise(0).cast("int").alias("mix_copies"),
        )
        .filter("mix_copies > 0")
    )
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    met = rows.join(
        copies, F.col("row.doc_id").eqNullSafe(F.col("mix_id")) & (F.xxhash64("row.text") == F.col("mix_text"))
    )
    return met.select("row", F.explode(F.array_repeat(F.lit(0), F.col("mix_copies"))).alias("copy")).select("row.*")
