"""Line deduplication by levelled sorted runs of line hashes, in DataFrame functions only.

Batches arrive in order of doc_id. The line keys seen so far lie in runs, each sorted by hash; a new batch anti-joins every
run by merge join, and what is new becomes a run of its own. When a level holds ``fanout`` runs they are compacted into one of
the next level, so the number of runs grows with the logarithm of the batches. A table is taken in four batches: the runs of
the first two are compacted before the third arrives.

Defined results: a null or empty text is one empty line; a null doc_id counts as one document after all others; rows with
the same doc_id are one document; keys shorter than ``min_chars`` are kept; an empty table gives no rows; columns of docs
named like those that are added are replaced by them.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from moments.llm.common import SPACE, lower_ascii, save

KEY = ["h1", "h2"]
LAST = 2**63 - 1


def line_key(line: Column) -> Column:
    return lower_ascii(F.btrim(line, F.lit(SPACE)))


def line_hashes(docs: DataFrame, bounds: list[int], min_chars: int = 10) -> DataFrame:
    """One row per line that can be dropped: document, hash of its text, position, 128-bit key hash and batch."""
    owner = F.coalesce("doc_id", F.lit(LAST))
    batch = sum([(owner > b).cast("int") for b in bounds], F.lit(0))
    key = F.col("key")
    return (
        docs.select(
            owner.alias("owner"),
            F.xxhash64("text").alias("version"),
            batch.alias("batch"),
            F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("pos", "line"),
        )
        .select("owner", "version", "batch", "pos", line_key(F.col("line")).alias("key"))
        .filter(F.length(key) >= min_chars)
        .select("owner", "version", "pos", F.xxhash64(key).alias("h1"), F.xxhash64(key, F.lit("second")).alias("h2"), "batch")
    )


@dataclass
class LineRuns:
    """The runs by level; each is a table of key hashes sorted within its files."""

    fanout: int = 2
    levels: list[list[DataFrame]] = field(default_factory=list)

    def unseen(self, keys: DataFrame) -> DataFrame:
        for run in (r for level in self.levels for r in level):
            keys = keys.join(run.hint("merge"), KEY, "left_anti")
        return keys

    def add(self, keys: DataFrame) -> None:
        run, level = self._sorted(keys), 0
        while True:
            if level == len(self.levels):
                self.levels.append([])
            self.levels[level].append(run)
            if len(self.levels[level]) < self.fanout:
                return
            merged = self.levels[level][0]
            for other in self.levels[level][1:]:
                merged = merged.unionByName(other)
            self.levels[level] = []
            run, level = self._sorted(merged), level + 1

    @staticmethod
    def _sorted(keys: DataFrame) -> DataFrame:
        return save(keys.select(*KEY).repartition(*KEY).sortWithinPartitions(*KEY))


def duplicate_lines(docs: DataFrame, batches: int = 4, min_chars: int = 10, runs: LineRuns | None = None) -> DataFrame:
    """The lines to drop: (owner, version, pos). ``runs`` may hold the keys of earlier tables."""
    runs = LineRuns() if runs is None else runs
    marks = docs.agg(F.percentile_approx("doc_id", [i / batches for i in range(1, batches)], 1000)).first()[0]
    bounds = sorted(set(marks or []))
    lines = save(line_hashes(docs, bounds, min_chars), "batch")
    out = None
    for b in range(len(bounds) + 1):
        batch = lines.filter(F.col("batch") == b).drop("batch")
        keys = save(batch.groupBy(*KEY).agg(F.min("owner").alias("first"), F.max("owner").alias("last")))
        if runs.levels:
            new = save(runs.unseen(keys))
            old = keys.join(new, KEY, "left_anti").select(*KEY, F.lit(None).cast("long").alias("keeper"))  # an earlier batch
        else:
            new, old = keys, None
        twice = new.filter(F.col("first") < F.col("last")).select(*KEY, F.col("first").alias("keeper"))
        keepers = save(twice if old is None else twice.unionByName(old))
        found = batch.join(keepers, KEY).filter("keeper is null or owner > keeper").select("owner", "version", "pos")
        out = found if out is None else out.unionByName(found)
        if b < len(bounds):
            runs.add(new)
    return out


def drop_lines(docs: DataFrame, **options) -> DataFrame:
    """docs with ``kept_text``, ``n_lines`` and ``n_dropped``; texts meet their dropped positions in one shuffle."""
    dropped = (
        duplicate_lines(docs, **options)
        .groupBy("owner", "version")
        .agg(F.collect_set("pos").alias("dropped_pos"))
        .withColumnsRenamed({"owner": "dd_owner", "version": "dd_version"})
    )
    joined = docs.join(
        dropped,
        (F.coalesce(docs["doc_id"], F.lit(LAST)) == F.col("dd_owner")) & (F.xxhash64(docs["text"]) == F.col("dd_version")),
        "left",
    ).drop("dd_owner", "dd_version")
    lines = F.split(F.coalesce("text", F.lit("")), "\n")
    gone = F.coalesce("dropped_pos", F.array().cast("array<int>"))
    kept = F.when(
        F.size(gone) > 0,
        F.element_at(
            F.transform(
                F.array(lines),
                lambda x: F.array_join(
                    F.transform(F.array_except(F.sequence(F.lit(0), F.size(x) - 1), gone), lambda i: F.get(x, i)), "\n"
                ),
            ),
            1,
        ),
    ).otherwise(F.coalesce("text", F.lit("")))
    return (
        joined.withColumn("kept_text", kept)
        .withColumn("n_lines", F.size(lines).cast("long"))
        .withColumn("n_dropped", F.size(gone).cast("long"))
        .drop("dropped_pos")
    )
