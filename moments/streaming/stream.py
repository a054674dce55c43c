"""Streaming forms: stateful decimation, tumbling and session windows, incremental maintenance.

Inputs are file streams; results go to files in the shared folder, so a restarted query goes on from its checkpoint.
"""

from __future__ import annotations

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from moments.operators.folder import new_folder
from moments.streaming.sampling import rocks

#: Parts of a maintained table; a micro-batch rewrites the parts that hold its keys.
PARTS = 64


def file_stream(spark: SparkSession, sf_dir: str, table: str, files: int = 1) -> DataFrame:
    """The table as a stream; with ``files`` it arrives in so many files, one a micro-batch."""
    path = f"{sf_dir}/{table}.parquet"
    schema = spark.read.parquet(path).schema
    stream = spark.readStream.schema(schema)
    if files == 1:
        return stream.option("pathGlobFilter", f"{table}.parquet").parquet(sf_dir)
    at = new_folder(spark, "arrivals")
    spark.read.parquet(path).repartition(files).write.parquet(at)
    return stream.option("maxFilesPerTrigger", 1).parquet(at)


def _started(stream: DataFrame, mode: str, write, at: str):
    """Runs over all files that are there, and returns the finished query."""
    q = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return q


def run_counted(stream: DataFrame) -> tuple[DataFrame, list[dict]]:
    """An append stream that keeps state in RocksDB: what was written, and for each micro-batch its rows, the rows that came too late
    and the rows of state after it."""
    spark = stream.sparkSession
    at = new_folder(spark, "stream")
    with rocks(spark):
        q = _started(stream, "append", lambda batch, number: batch.write.mode("overwrite").parquet(f"{at}/out/batch={number}"), at)
    steps = [
        {
            "rows": p.numInputRows,
            "late": sum(o.numRowsDroppedByWatermark for o in p.stateOperators),
            "state_rows": sum(o.numRowsTotal for o in p.stateOperators),
        }
        for p in q.recentProgress
    ]
    return spark.read.schema(stream.schema).parquet(f"{at}/out").select(*stream.columns), steps


def upsert(spark: SparkSession, path: str, rows: DataFrame, keys: list[str], number: int, merged=None) -> None:
    """Upserts a micro-batch into the table at path: the parts that hold its keys are read, changed and written, the others stay.
    ``merged`` joins an old row and a new one of a key (rows of both in, one a key out); without it the new row counts. Each
    part remembers the last micro-batch it took, so one that is repeated after a failure changes nothing."""
    names = rows.columns
    fresh = rows.withColumn("part", F.pmod(F.xxhash64(*keys), F.lit(PARTS)).cast("int"))
    staged = new_folder(spark, "staged")
    fresh.write.parquet(staged)
    fresh = spark.read.schema(fresh.schema).parquet(staged)
    parts = [r.part for r in fresh.select("part").distinct().collect()]  # at most PARTS
    if not parts:
        return
    try:
        old = spark.read.parquet(path).filter(F.col("part").isin(parts))
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        old = None  # no table yet: the first micro-batch
    if old is None:
        both = fresh
    else:
        taken = [r.part for r in old.groupBy("part").agg(F.max("batch").alias("b")).filter(F.col("b") >= number).collect()]
        old, fresh = (df.filter(~F.col("part").isin(taken)) if taken else df for df in (old, fresh))
        if merged is None:
            both = old.join(fresh, keys, "left_anti").select(*names, "part").unionByName(fresh)
        else:
            both = merged(old.select(*names).unionByName(fresh.select(*names))).select(*names)
            both = both.withColumn("part", F.pmod(F.xxhash64(*keys), F.lit(PARTS)).cast("int"))
    made = new_folder(spark, "staged")
    both.withColumn("batch", F.lit(number).cast("long")).write.parquet(made)
    out = spark.read.parquet(made).repartition("part").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    out.partitionBy("part").parquet(path)


def run(stream: DataFrame, mode: str = "append", keys: list[str] | None = None) -> DataFrame:
    """Runs over all that is there and returns what was written: rows as they came (append), the last state of the whole table
    (complete), or the last row of each key (update), of which a micro-batch writes only the keys that it changed."""
    spark = stream.sparkSession
    at = new_folder(spark, "stream")

    def write(batch: DataFrame, number: int) -> None:
        if mode == "update":
            upsert(batch.sparkSession, f"{at}/out", batch, keys, number)
        else:
            batch.write.mode("overwrite").parquet(f"{at}/out" if mode == "complete" else f"{at}/out/batch={number}")

    _started(stream, mode, write, at)
    return spark.read.parquet(f"{at}/out").select(*stream.columns)


def maintain(stream: DataFrame, keys: list[str], counted, merged) -> DataFrame:
    """A table of aggregates by key, kept up with the stream: each micro-batch is ``counted`` and ``merged`` into the rows of its
    keys. No state stays in memory; the table is the state."""
    spark = stream.sparkSession
    at = new_folder(spark, "stream")

    def write(batch: DataFrame, number: int) -> None:
        upsert(batch.sparkSession, f"{at}/out", counted(batch), keys, number, merged)

    _started(stream, "append", write, at)
    return spark.read.parquet(f"{at}/out").drop("part", "batch")


def tumbling(events: DataFrame, width: str, late: str = "1 hour") -> DataFrame:
    """Counts by window and kind."""
    seen = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return seen.groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 6).alias("total")).select(
        F.unix_micros("window.start").alias("start_us"), "event_type", "n", "total"
    )


def sessions(events: DataFrame, gap: str, late: str = "1 hour") -> DataFrame:
    """Runs of a user's events without a pause of the gap."""
    seen = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return seen.groupBy(F.session_window("ts", gap), "user_id").agg(F.count(F.lit(1)).alias("n")).select(
        "user_id", F.unix_micros("session_window.start").alias("start_us"), "n"
    )


def decimated(frames: DataFrame, rate: float) -> DataFrame:
    """The stateful form of decimation: each video's state is the last accepted bucket, one number, and stays for good, since a
    video may go on at any time. Rows of a micro-batch are taken in order of idx."""

    def accept(key, batches, state: GroupState):
        last = state.get[0] if state.exists else None
        rows = pd.concat(list(batches)).sort_values("idx")
        kept = []
        for idx, ts in rows[["idx", "media_ts"]].itertuples(index=False):
            b = int(ts * rate // 1)
            if last is None or b > last:
                kept.append((key[0], idx, b))
                last = b
        state.update((last,))
        yield pd.DataFrame(kept, columns=["video_id", "idx", "bucket"])

    return frames.groupBy("video_id").applyInPandasWithState(
        accept, "video_id string, idx long, bucket long", "last long", "append", GroupStateTimeout.NoTimeout
    )
