"""Sharding by sampled splitters: shards of nearly equal bytes, equal texts side by side.

The key of a record is a hash of its text. A sample of keys, drawn with a chance in proportion to the record's size, gives
quantile splitters for many fine ranges. All records are then counted by range: ranges that one text overfills are divided
by a second hash of the record, and the ranges are dealt to shards in key order by their exact bytes. A slot is the rank in
the range plus the records of the shard's ranges before it, so no sort holds a whole shard.

Records of one key and doc_id are one entry of the sample, whatever their number, and where such an entry alone overfills a range
(repeated rows, or one text under many null ids) its rows are divided by their place in the table; they are equal, so it does
not matter which goes where. What reaches the driver is bounded by parameters: about ``oversample`` keys and one count for each
of the fine ranges.

Defined results: texts of any length are single records, and one that overfills a range has a range of its own; a null text has no bytes and goes with the empty ones; a null doc_id sorts first; repeated rows take
neighbouring slots; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from moments.llm.common import hex_long, save
from moments.llm.mixing import ranked

HEAD = 16
#: Equal rows beyond which a group is numbered by ranges and not in one array.
MANY = 1_000


def record_keys(docs: DataFrame, *carry: str) -> DataFrame:
    """Size, checksum, key and second hash of each record, and a hash of its place in the table; no text goes further."""
    text = F.coalesce("text", F.lit(""))
    return docs.select(
        *carry,
        "doc_id",
        (F.octet_length(text) + HEAD).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        hex_long(F.md5(text), 15).alias("key"),
        hex_long(F.md5(F.concat_ws(":", F.lit("spread"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))), 8).alias("spread"),
        F.pmod(F.xxhash64(F.lit("place"), F.monotonically_increasing_id()), F.lit(2**32)).alias("place"),
    )


def _weighted_splitters(keys: np.ndarray, weights: np.ndarray, n: int) -> np.ndarray:
    order = np.argsort(keys, kind="stable")
    run = np.cumsum(weights[order])
    at = np.searchsorted(run, run[-1] * np.arange(1, n) / n) if len(run) else []
    return np.unique(keys[order][at]) if len(run) else np.zeros(0, "int64")


def shard_by_bytes(records: DataFrame, shards: int = 40, ranges_per_shard: int = 64, oversample: int = 16) -> DataFrame:
    """records (key, spread, place, size, ...), which are written, with shard and slot."""
    spark = records.sparkSession
    n = shards * ranges_per_shard
    total = records.agg(F.sum("size")).first()[0] or 0
    rate = n * oversample / max(total, 1)
    entries = records.groupBy("key", "spread").agg(F.sum("size").alias("size"))
    chance = F.pmod(F.xxhash64(F.lit("sample"), "key", "spread"), F.lit(2**32))
    sample = (  # the weights of all entries add up to n * oversample
        entries.filter(chance < F.least(F.lit(1.0), F.col("size") * rate) * 2.0**32)
        .select("key", F.greatest(F.lit(1.0), F.col("size") * rate).alias("w"))
        .toPandas()
    )
    splitters = _weighted_splitters(sample["key"].to_numpy("int64"), sample["w"].to_numpy("float64"), n)
    limit = total / n * 4

    @F.pandas_udf("int")
    def range_of(key: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(splitters, key.to_numpy(), side="left").astype("int32"))

    ranged = records.withColumn("range", range_of("key"))
    full = ranged.groupBy("range").agg(F.sum("size").alias("bytes")).filter(F.col("bytes") > limit)
    hot = (  # at most total / limit keys
        ranged.join(F.broadcast(full.select("range")), "range", "left_semi")
        .groupBy("key")
        .agg(F.sum("size").alias("bytes"))
        .filter(F.col("bytes") > limit)
        .orderBy("key")
        .toPandas()
    )
    hot_keys = hot["key"].to_numpy("int64")
    alone = records.groupBy("key", "spread").agg(F.sum("size").alias("bytes")).filter(F.col("bytes") > limit / 4)
    alone_keys = np.sort(alone.select("key").distinct().toPandas()["key"].to_numpy("int64"))  # at most 4 total / limit
    parts = np.ceil(hot["bytes"].to_numpy("float64") / max(limit / 4, 1)).astype("int64")
    # a hot key cuts its range in two: fine ranges are numbered in key order, with a hot key's parts between
    cuts = np.unique(np.concatenate([splitters, hot_keys, hot_keys - 1])) if len(hot_keys) else splitters
    width = np.ones(len(cuts) + 1, "int64")
    width[np.searchsorted(cuts, hot_keys, side="left")] = parts
    first = np.concatenate([[0], np.cumsum(width)[:-1]])

    @F.pandas_udf("int")
    def fine_of(key: pd.Series, spread: pd.Series, place: pd.Series) -> pd.Series:
        at = np.searchsorted(cuts, key.to_numpy(), side="left")
        by = np.where(np.isin(key.to_numpy(), alone_keys), place.to_numpy(), spread.to_numpy())
        return pd.Series((first[at] + by * width[at] // 2**32).astype("int32"))

    fine = records.withColumn("fine", fine_of("key", "spread", "place"))
    counts = fine.groupBy("fine").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n")).orderBy("fine").toPandas()
    if counts.empty:
        return records.withColumn("shard", F.lit(0)).withColumn("slot", F.lit(0).cast("long"))
    run = counts["bytes"].cumsum() - counts["bytes"] / 2
    counts["shard"] = np.minimum(run * shards // max(total, 1), shards - 1).astype("int32")
    counts["before"] = counts.groupby("shard")["n"].cumsum() - counts["n"]
    plan = spark.createDataFrame(counts[["fine", "shard", "before"]], "fine int, shard int, before long")
    rank = F.row_number().over(W.partitionBy("fine").orderBy("key", "doc_id", "size"))
    return (
        fine.withColumn("rank", rank)
        .join(F.broadcast(plan), "fine")  # bounded: one row for each fine range
        .withColumn("slot", (F.col("before") + F.col("rank") - 1).cast("long"))
        .drop("rank", "before", "fine")
    )


def assign_shards(docs: DataFrame, shards: int = 40, **options) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law, shard, slot, grown_shard."""
    placed = shard_by_bytes(save(record_keys(docs)), shards, **options)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def sharded_documents(docs: DataFrame, shards: int = 40, **options) -> DataFrame:
    """docs with shard and slot. Only keys are ranked; texts meet their places in one shuffle."""
    text_hash = lambda x: F.xxhash64(x)
    keys = save(record_keys(docs.select("doc_id", "text", text_hash("text").alias("place_text")), "place_text"))
    placed = shard_by_bytes(keys, shards, **options).select(
        F.col("doc_id").alias("place_id"), "place_text", "shard", "slot"
    )
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row")).withColumn("row_hash", text_hash("row.text"))
    same = F.col("row.doc_id").eqNullSafe(F.col("place_id")) & (F.col("row_hash") == F.col("place_text"))
    keep = [c for c in docs.columns if c not in ("shard", "slot")]
    columns = [F.col(f"row.`{c}`") for c in keep]
    placed = save(placed)
    sizes = placed.groupBy("place_id", "place_text").agg(F.count(F.lit(1)).alias("n"))
    least = max(MANY, placed.count() / 100_000)
    heavy = F.broadcast(sizes.filter(F.col("n") >= least).select("place_id", "place_text"))  # at most 100,000 groups
    # rows that are equal in doc_id and text take the places of their group in any order
    places = (
        placed.join(heavy.withColumnsRenamed({"place_id": "h_id", "place_text": "h_text"}), F.col("place_id").eqNullSafe(F.col("h_id")) & (F.col("place_text") == F.col("h_text")), "left_anti")
        .groupBy("place_id", "place_text").agg(F.sort_array(F.collect_list(F.struct("shard", "slot"))).alias("places"))
    )
    met = rows.join(places, same)
    many = W.partitionBy(F.col("row.doc_id"), "row_hash").orderBy("row_hash")
    met = met.withColumn("nth", F.when(F.size("places") == 1, F.lit(1)).otherwise(F.row_number().over(many)))
    place = F.element_at("places", F.col("nth"))
    out = met.select(*columns, place["shard"].alias("shard"), place["slot"].alias("slot"))
    if heavy.isEmpty():
        return out
    # of a large group both sides are numbered by ranges, and no task holds the group
    known = [F.col("no_id"), F.col("id"), F.col("text_key")]
    keyed = lambda df, i, h: df.withColumns({"no_id": i.isNull(), "id": F.coalesce(i, F.lit(0)), "text_key": h})
    group = ["no_id", "id", "text_key"]
    left = keyed(rows.join(heavy, same, "left_semi"), F.col("row.doc_id"), F.col("row_hash")).select("row", *known)
    right = keyed(placed, F.col("place_id"), F.col("place_text")).join(
        keyed(heavy, F.col("place_id"), F.col("place_text")).select(*group), group, "left_semi"
    ).select("shard", "slot", *known)
    left = ranked(left.withColumn("tie", F.monotonically_increasing_id()), group, [F.col("tie")], "nth")
    both = left.join(ranked(right, group, [F.col("shard"), F.col("slot")], "nth"), [*group, "nth"])
    return out.unionByName(both.select(*columns, "shard", "slot"))
