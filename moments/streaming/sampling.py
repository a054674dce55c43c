"""Samplers on arriving frames: the fold of ``operators.sampling`` as a state that the watermark moves.

A frame waits in list state until the watermark has passed it, so frames are walked in their order however the files cut or mix
them; frames later than the watermark are dropped and counted by Spark. What stays between micro-batches is the frames above
the watermark and, for each key, the state of the samplers of one open chunk, until the end of the chunk; a timer wakes what has become
due. Keys are dealt to slots by hash, and a slot is what Spark groups by: with a state, a timer and a call of its own, a key of
a few frames costs about a hundred times what its frames do. State is kept in RocksDB, so it need not fit an executor's heap.
"""

from __future__ import annotations

import contextlib
import json
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.types import StructField, StructType

from moments.operators.folder import new_folder, saved
from moments.operators.sampling import RECORD, FrameRule, described, named_apart, walk

STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
FOREVER = 2**62
COLUMNS = ["at", "idx", "media_ts", "chunk_id", "told", "close_at", "who"]
#: Frames of a block of list state, and of one file of ``arrivals``.
BLOCK, FILE = 20_000, 250_000
#: Micros of the times in a key; numbers and texts are as they are.
KEYS = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}


@contextlib.contextmanager
def rocks(spark: SparkSession):
    """The state store that streams with timers need, while a query is started."""
    before = spark.conf.get(STORE, None)
    spark.conf.set(STORE, ROCKS)
    try:
        yield
    finally:
        spark.conf.unset(STORE) if before is None else spark.conf.set(STORE, before)


def _packed(rows: pd.DataFrame) -> list[tuple]:
    out = []
    for start in range(0, len(rows), BLOCK):
        told = pa.Table.from_pandas(rows.iloc[start : start + BLOCK], preserve_index=False)
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, told.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
            writer.write_table(told)
        out.append((sink.getvalue().to_pybytes(),))
    return out


def _unpacked(block: tuple) -> pd.DataFrame:
    return pa.ipc.open_stream(pa.py_buffer(bytes(block[0]))).read_all().to_pandas()


class Walker(StatefulProcessor):
    """Holds the frames of a slot back until the watermark has passed them, then walks those of each key in order of (at, idx)."""

    def __init__(self, rules: list[FrameRule], rate: float | None, names: list[str], chunked: bool):
        self.rules, self.rate, self.names, self.chunked = rules, rate, names, chunked

    def init(self, handle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", "block binary")
        self.folds = handle.getValueState("folds", "json string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        kinds = {"at": "int64", "idx": "int64", "media_ts": "float64", "chunk_id": "int64", "close_at": "int64"}
        fresh = pd.concat([pdf[COLUMNS] for pdf in rows], ignore_index=True).astype(kinds)
        watermark, timers = timerValues.getCurrentWatermarkInMs(), list(self.handle.listTimers())
        if min(timers, default=FOREVER) > watermark and fresh["at"].min() > watermark * 1000:
            self.held.appendList(_packed(fresh))  # nothing is due
            self._wake(timers, None, min([*timers, -(-int(fresh["at"].min()) // 1000)]))
        else:
            yield from self._advance(fresh, watermark, timers)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        yield from self._advance(None, timerValues.getCurrentWatermarkInMs(), list(self.handle.listTimers()), expiredTimerInfo.getExpiryTimeInMs())

    def close(self) -> None:
        pass

    def _wake(self, timers: list[int], expired: int | None, due: int | None) -> None:
        """Leaves the slot with one timer; Spark itself deletes the one that has just expired."""
        for t in timers:
            if t not in (due, expired):
                self.handle.deleteTimer(t)
        if due is not None and due not in timers:
            self.handle.registerTimer(due)

    def _advance(self, fresh: pd.DataFrame | None, watermark: int, timers: list[int], expired: int | None = None) -> Iterator[pd.DataFrame]:
        blocks = [*([] if not self.held.exists() else map(_unpacked, self.held.get())), *([] if fresh is None else [fresh])]
        rows = pd.concat(blocks, ignore_index=True) if blocks else pd.DataFrame(columns=COLUMNS)
        folds = json.loads(self.folds.get()[0]) if self.folds.exists() else {}
        passed = rows["at"] <= watermark * 1000  # times of rows are microseconds, so their order is whole
        ready, waiting = rows[passed].sort_values(COLUMNS[:6]), rows[~passed]
        out = []
        for at, idx, ts, chunk, told, close, key in zip(*(ready[c].tolist() for c in COLUMNS)):
            fold = folds.get(key)
            if fold is None:
                fold = folds[key] = {"bucket": None, "chunk": None, "place": 0, "states": [], "close": 0}
            fold["close"] = max(fold["close"], close)
            out += self._frame(key, fold, idx, ts, chunk, told)
        over = [k for k, fold in folds.items() if fold["close"] <= watermark * 1000]
        if over:
            still = set(waiting["who"])
            for k in over:
                if k not in still:  # nothing of the key comes any more
                    del folds[k]
        if passed.any() or fresh is not None:
            self.held.put(_packed(waiting)) if len(waiting) else self.held.clear()
        self.folds.update((json.dumps(folds),)) if folds else self.folds.clear()
        times = [*([waiting["at"].min()] if len(waiting) else []), *(f["close"] for f in folds.values() if watermark * 1000 < f["close"] < FOREVER)]
        self._wake(timers, expired, -(-int(min(times)) // 1000) if times else None)
        if out:
            yield pd.DataFrame(out, columns=self.names).astype({"score": "float64"})

    def _frame(self, key: str, fold: dict, idx: int, ts: float, chunk: int, told: str) -> list[tuple]:
        if self.rate is not None:
            bucket = int(ts * self.rate // 1)
            if fold["bucket"] is not None and bucket <= fold["bucket"]:
                return []
            fold["bucket"] = bucket
        if fold["chunk"] != chunk or not fold["states"]:
            fold |= {"chunk": chunk, "place": 0, "states": [{} for _ in self.rules]}
        found = walk(self.rules, fold["states"], fold["place"], idx, ts, told)
        fold["place"] += 1
        return [(key, *([chunk] if self.chunked else []), *record) for record in found]


def sampled_stream(
    frames: DataFrame, rules: list[FrameRule], at: Column, late: str, by: tuple = ("video_id", "chunk_id"), rate: float | None = None,
    end: Column | None = None, place=None, slots: int = 256,
) -> DataFrame:
    """The records of ``operators.sampling.sampled`` for a stream of frames in order of (at, idx); at is a timestamp that the watermark
    follows, ``late`` behind (times lie after 1970, where a watermark starts). With ``rate`` frames are decimated first, and samplers start anew in each chunk of a key (by
    video). end: the time at which nothing of the key comes any more. place: a stateless step after the watermark, such as a join
    with the grid. slots: groups of keys, a few for each shuffle partition; a task holds the waiting frames of one slot at a time, so more frames
    want more slots. It belongs to the checkpoint, so a query that goes on keeps it."""
    named_apart(rules)
    chunked = "chunk_id" not in by
    seen = frames.withColumn("_at", at).withWatermark("_at", late)
    seen = seen if place is None else place(seen)
    chunk = F.col("chunk_id").cast("long") if "chunk_id" in seen.columns else F.lit(0).cast("long")
    us = F.unix_micros
    told = seen.select(
        F.pmod(F.xxhash64(*by), F.lit(slots)).cast("int").alias("_slot"), F.to_json(F.struct(*by), KEYS).alias("who"), chunk.alias("chunk_id"), "_at",
        us(F.col("_at")).alias("at"), F.col("idx").cast("long").alias("idx"),
        F.col("media_ts").cast("double").alias("media_ts"), described(seen, rules).alias("told"), (F.lit(FOREVER) if end is None else us(end)).alias("close_at"),
    )
    kinds = dict(seen.dtypes)
    record = ["sampler_id", "idx", "media_ts", "chunk_local_index", "score"]
    names = ["who", *(["chunk_id"] if chunked else []), *record]
    schema = "who string" + (", chunk_id long" if chunked else "") + f", {RECORD}"
    walker = Walker(rules, rate, names, chunked)
    found = told.groupBy("_slot").transformWithStateInPandas(statefulProcessor=walker, outputStructType=schema, outputMode="Append", timeMode="EventTime")
    key = F.from_json("who", ", ".join(f"{n} {kinds[n]}" for n in by), KEYS)
    return found.withColumn("who", key).select(*(F.col("who")[n].alias(n) for n in by), *names[1:])


def arrivals(rows: DataFrame, order: str, files: int, late: float, closing: dict) -> DataFrame:
    """rows as a stream of so many arrivals in order of time, one a micro-batch; every other row comes up to ``late`` later than it
    should. An arrival is a file, or as many files as all others if it is large, so that no task writes it alone. The last one holds one row,
    ``closing``, whose place in order lies far after all others, so the watermark passes everything."""
    spark = rows.sparkSession
    path = new_folder(spark, "arrivals")
    rows = saved(rows)
    low, high, n = rows.agg(F.min(order), F.max(order), F.count(F.lit(1))).first()
    step = ((high or 0) - (low or 0) + late) / files + 1e-9
    when = F.col(order) + F.when(F.pmod(F.xxhash64(*rows.columns), F.lit(2)) == 0, late).otherwise(0.0)
    dealt = rows.withColumn("_file", F.least(F.lit(files - 1), F.floor((when - (low or 0)) / step)))
    schema = StructType([StructField(f.name, f.dataType) for f in rows.schema.fields])
    parts = max(1, -(-n // (files * FILE)))
    for k in range(files):
        mine = dealt.filter(F.col("_file") == k).drop("_file")
        (mine.coalesce(1) if parts == 1 else mine.repartition(parts)).write.mode("append").parquet(path)
        if parts > 1:  # a part without rows has no file
            for _ in range((k + 1) * parts - len(spark.read.schema(schema).parquet(path).inputFiles())):
                spark.createDataFrame([], schema).coalesce(1).write.mode("append").parquet(path)
    values = {f.name: closing.get(f.name) for f in schema.fields}
    values[order] = type(high)(high + max(10 * late, 1e7)) if high is not None else None
    spark.createDataFrame([tuple(values.values())], schema).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", parts).parquet(path)
