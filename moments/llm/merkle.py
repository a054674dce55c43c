"""Merkle dataset manifest: a tree of threes for each source, a tree of threes over the sources, and a proof for each row.

Trees are cut into aligned blocks of up to ``3 ** LEVELS`` leaves. A block is one row of a table in the shared folder: its
nodes, 32 bytes each, in the van Emde Boas order, in which a tree is its upper half followed by its lower subtrees, each laid
out in the same way. Addresses come from arithmetic on (depth, place) alone, so building a block and reading the siblings of a
leaf need no pointers and touch few neighbouring bytes at any size of cache or page. The roots of the blocks are the leaves of
the next pass, until one block is left of each tree: three passes cover 387 million rows of one source.

Ranks inside a source come from ranges of (source, doc_id) and the counts of the ranges before, and no task holds more than a
block of a source, so a source of any size is spread over all executors.

Defined results: a null in any hashed column is ``-``; a null source is a source of its own, before all others; rows without
doc_id come first in their source; rows of one doc_id stand in the order of their leaves, and equal rows have equal leaves, so
their order does not matter; empty texts are hashed as such; other columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from moments.llm.common import save
from moments.llm.mixing import ranked

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
FAN = 3
#: Levels of inner nodes in a block: 729 leaves, 1,093 nodes, 35 kB.
LEVELS = 6
WIDE = FAN**LEVELS
STEP = "array<struct<left:string,right:string>>"


def size_of(height: int) -> int:
    """Nodes of a whole tree of so many levels."""
    return (FAN**height - 1) // (FAN - 1)


@functools.lru_cache(maxsize=None)
def address(height: int, depth: int, place: int) -> int:
    """Where the node at (depth, place) of a tree of so many levels stands in the van Emde Boas order."""
    if height == 1:
        return 0
    upper = height // 2
    if depth < upper:
        return address(upper, depth, place)
    lower, down = height - upper, depth - upper
    tree, inside = divmod(place, FAN**down)
    return size_of(upper) + tree * size_of(lower) + address(lower, down, inside)


def levels_of(n: int) -> int:
    """Inner levels until one node is left of n."""
    levels = 0
    while n > 1:
        n, levels = -(-n // FAN), levels + 1
    return levels


def lay_out(leaves: list[str], levels: int) -> tuple[str, bytes]:
    """Root and nodes of the block over these leaves, with so many levels above them."""
    height, nodes, row = levels + 1, bytearray(32 * size_of(levels + 1)), leaves
    for depth in range(levels, -1, -1):
        for place, digest in enumerate(row):
            at = 32 * address(height, depth, place)
            nodes[at : at + 32] = bytes.fromhex(digest)
        if depth:
            row = [hashlib.sha256("".join(row[i : i + FAN]).encode()).hexdigest() for i in range(0, len(row), FAN)]
    return row[0], bytes(nodes)


def siblings(nodes: bytes, n: int, levels: int, leaf: int) -> list[dict]:
    """For each level from the leaf to below the root, the digests left and right of the path in its run of three."""
    height, found = levels + 1, []
    for depth in range(levels, 0, -1):
        first = leaf - leaf % FAN
        run = [nodes[(at := 32 * address(height, depth, p)) : at + 32].hex() for p in range(first, min(first + FAN, n))]
        found.append({"left": "".join(run[: leaf - first]), "right": "".join(run[leaf - first + 1 :])})
        leaf, n = leaf // FAN, -(-n // FAN)
    return found


def _built(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = [
            lay_out([m["digest"] for m in members], levels_of(len(members)) if whole else LEVELS)
            for members, whole in zip(batch.column("members").to_pylist(), batch.column("whole").to_pylist())
        ]
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array([r for r, _ in out], pa.string()), pa.array([b for _, b in out], pa.binary())],
            names=[*batch.schema.names, "top", "nodes"],
        )


def _proven(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())])))
    for batch in batches:
        for k in range(batch.num_rows):  # the proofs of a block are twenty times its size
            row = batch.slice(k, 1)
            n, nodes = len(row.column("members")[0]), row.column("nodes")[0].as_py()
            levels = levels_of(n) if row.column("whole")[0].as_py() else LEVELS
            steps = pa.array([[siblings(nodes, n, levels, leaf) for leaf in range(n)]], kind)
            keep = [i for i, name in enumerate(row.schema.names) if name != "nodes"]
            yield pa.RecordBatch.from_arrays([*[row.column(i) for i in keep], steps], names=[*[row.schema.names[i] for i in keep], "inner"])


def blocks(members: DataFrame, tree: list[str], carry: list[str]) -> DataFrame:
    """members (tree, place from 0, n of the tree, digest, carry) by aligned blocks, written: the manifest of one pass."""
    group = members.groupBy(*tree, F.floor(F.col("place") / WIDE).cast("long").alias("block")).agg(
        F.sort_array(F.collect_list(F.struct("place", "digest", *carry))).alias("members"),  # at most WIDE rows
        (F.first("n") <= WIDE).alias("whole"),
        F.first("n").alias("n"),
    )
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in group.schema.fields)
    return save(group.mapInArrow(_built, f"{schema}, top string, nodes binary"))


def proven(members: DataFrame, tree: list[str], order: list[Column], carry: list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows, tops): members with ``steps``, the siblings up to the root of their tree, as struct m; and the root of each tree."""
    sized = members.groupBy(*tree).agg(F.count(F.lit(1)).alias("n"))
    placed = ranked(members, tree, order, "rank").join(sized, tree).withColumn("place", F.col("rank") - 1)
    passes = [blocks(placed.select(*tree, "place", "n", "digest", *carry), tree, carry)]
    most = passes[0].agg(F.max("n")).first()[0] or 0
    while most > WIDE:
        most = -(-most // WIDE)
        up = passes[-1].filter(~F.col("whole")).select(
            *tree, F.col("block").alias("place"), F.ceil(F.col("n") / WIDE).cast("long").alias("n"), F.col("top").alias("digest")
        )
        passes.append(blocks(up, tree, []))
    tops = None
    above = None  # (tree, block, up): what stands above each block of the pass below
    for k in range(len(passes) - 1, -1, -1):
        done = passes[k].filter("whole").select(*tree, "top")
        tops = done if tops is None else tops.unionByName(done)
        met = passes[k]
        none = F.array().cast(STEP)
        met = met.withColumn("up", none) if above is None else met.join(above, [*tree, "block"], "left").withColumn("up", F.coalesce("up", none))
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in met.schema.fields if f.name != "nodes")
        rows = met.mapInArrow(_proven, f"{schema}, inner array<{STEP}>").select(
            *tree, "block", "up", F.explode(F.arrays_zip("members", "inner")).alias("x")
        )
        rows = rows.select(*tree, "block", F.col("x.members").alias("m"), F.concat("x.inner", "up").alias("steps"))
        above = rows.select(*tree, F.col("m.place").alias("block"), F.col("steps").alias("up"))
    return rows, tops


def field(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_of(text: Column) -> Column:
    return F.sha2(F.concat(*[field(text if c == "text" else F.col(c)) for c in FIELDS]), 256)


def fold(digest: Column, steps: Column) -> Column:
    """The root that follows from a digest and its siblings."""
    return F.aggregate(steps, digest, lambda d, s: F.sha2(F.concat(s.left, d, s.right), 256))


def manifest(docs: DataFrame, found: Column | None = None) -> DataFrame:
    """(doc_id, leaf, subroot, root, steps, folded_root): steps are the siblings from the leaf over the subroot to the root.
    found: the texts as they are met later; the root is recomputed from them."""
    source = ["no_source", "name"]
    text = F.col("text")
    rows = docs.select(*FIELDS).select(
        F.col("source").isNotNull().cast("int").alias("no_source"),
        F.coalesce("source", F.lit("")).alias("name"),
        "doc_id",
        leaf_of(text).alias("digest"),
        leaf_of(text if found is None else found).alias("seen"),
    )
    inside, subroots = proven(rows, source, [F.col("doc_id").asc_nulls_first(), F.col("digest"), F.col("seen")], ["doc_id", "seen"])
    forest = subroots.select(F.lit(1).alias("all"), *source, F.col("top").alias("digest"))
    order = [F.col(c) for c in source]
    outside, root = proven(forest, ["all"], order, source)
    roots = outside.join(root, "all").select(
        *[F.col(f"m.{c}").alias(c) for c in source], F.col("m.digest").alias("subroot"), F.col("top").alias("root"), F.col("steps").alias("outer")
    )
    met = inside.join(save(roots), source).withColumn("steps", F.concat("steps", "outer"))
    return met.select(
        F.col("m.doc_id").alias("doc_id"), F.col("m.digest").alias("leaf"), "subroot", "root", "steps",
        fold(F.col("m.seen"), F.col("steps")).alias("folded_root"),
    )


def tampered(doc_id: Column, text: Column) -> Column:
    """Texts without line feeds where 2 divides the checksum of doc_id; the others as they are."""
    even = F.crc32(doc_id.cast("string").cast("binary")) % 2 == 0
    return F.when(even, F.replace(text, F.lit("\n"), F.lit(""))).otherwise(text)


def verified(docs: DataFrame) -> DataFrame:
    """The manifest of docs, held against the tampered texts."""
    m = manifest(docs, tampered(F.col("doc_id"), F.col("text")))
    joined = F.array_join(F.transform("steps", lambda s: F.concat(s.left, s.right)), "")
    return m.select(
        "doc_id", "leaf", "subroot", "root", F.sha2(joined, 256).alias("proof_sha256"), "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"),
    )
