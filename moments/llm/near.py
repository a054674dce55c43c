"""N-gram Jaccard self-join by chosen paths.

A text is the set of its five-word shingles (one shingle of all its words where it has fewer). Equal sets are one node. A
node carries the least hashed shingle under each of ``coordinates`` hash functions; two sets agree on a coordinate with a
chance equal to their Jaccard similarity. From its root, each run splits the nodes: a path samples coordinates with an
expected 1 / similarity of them, and nodes that share the value of a sampled coordinate go on together. A bucket of at most
``small`` nodes is compared by brute force; a larger one is split again, up to ``depth`` times, and what then stays together
is taken as one candidate group. In a large bucket the nodes that look like its least node join it in a group at once, and a
bucket in which all do is split no further. The
runs repeat this with other samples: one run meets a pair at the similarity in a bucket of the first level with a chance of
0.8 or more, so ten runs miss it with one below 1e-6. Pairs at the similarity in buckets that stay crowded through all splits,
and that do not look like the least node, survive a run with a chance of about 0.3 and ten runs with 0.97; more similar pairs
do so more often. So the target recall of 0.95 for such pairs fixes the number of runs; every run draws another root.

Candidates only form groups. Inside each group all pairs of sets are then compared exactly, in square blocks of ``block``
nodes spread over tasks, so large groups of near copies need neither a row for each pair nor one task for all; each block
returns the number of links of each node and a spanning forest. In groups of many blocks a task takes a square tile of up to
``tile`` x ``tile`` blocks (fewer where sets are long, so that its sets stay below ``tile_shingles``), so a set is sent once
for each tile and not for each block. Classes are the components of the exact links.

Defined results: texts without words are linked to nothing, but equal sets (so also empty texts) share a class; a null
doc_id is carried through; class_id is the least doc_id of the class; repeated rows share class and links; an empty table
gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from moments.llm.common import save
from moments.llm.tokens import hashed_texts, mix, raw


_CHECK = np.uint64(0xC2B2AE3D27D4EB4F)


@dataclass(frozen=True)
class NearRules:
    similarity: float = 0.8
    shingle: int = 5
    coordinates: int = 64
    runs: int = 10
    depth: int = 5
    small: int = 128
    block: int = 512
    tile: int = 32
    tile_shingles: int = 1 << 24
    #: Estimates of similarity from the coordinates that still count as candidates: six standard deviations below, so a pair at
    #: the similarity fails it with a chance of about 1e-8.
    slack: float = 0.3


def _odd(n: int, seed: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype="uint64") * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)) | np.uint64(1)


def shingle_sets(texts: list[bytes], k: int):
    """For each text in order, the sorted distinct hashes of its k-word shingles."""
    factor = _odd(k, 77)
    for _, words, counts, *_ in hashed_texts(texts):
        n = len(words)
        rolled = np.zeros(max(0, n - k + 1), "uint64")
        for i in range(k):
            rolled += words[i : i + len(rolled)] * factor[i]
        rolled = mix(rolled)
        at = 0
        for c in counts:
            if c >= k:
                yield np.unique(rolled[at : at + c - k + 1])
            elif c:
                yield mix(np.array([(words[at : at + c] * factor[:c]).sum() + np.uint64(c)], "uint64"))
            else:
                yield np.zeros(0, "uint64")
            at += c


def _signature(s: np.ndarray, odd: np.ndarray) -> np.ndarray:
    """The least 32-bit hash of the set under each function; of long sets in parts."""
    out = np.full(len(odd), 0xFFFFFFFF, "uint64")
    for at in range(0, len(s), 4096):
        np.minimum(out, ((s[at : at + 4096, None] * odd[None, :]) >> np.uint64(32)).min(axis=0), out=out)
    return out


def _first_coordinates(rules: NearRules) -> list[tuple[int, int]]:
    """(run, coordinate) at the roots: one for certain, others with the chance that makes 1 / similarity in all."""
    rng, out = np.random.default_rng(11), []
    for run, sure in enumerate(map(int, rng.permutation(rules.coordinates)[: rules.runs])):
        more = np.flatnonzero(rng.random(rules.coordinates) < (1 / rules.similarity - 1) / rules.coordinates)
        out += [(run, i) for i in {sure, *map(int, more)}]
    return out


def nodes_of(docs: DataFrame, rules: NearRules) -> DataFrame:
    """(doc_id, text_hash, set_hash, check, size, signature, paths) of each document: one pass, no shuffle. set_hash and check
    are two independent hashes of the set, 128 bits together."""
    odd, roots = _odd(rules.coordinates, 5), _first_coordinates(rules)
    run_of = np.array([r for r, _ in roots], "uint64")
    place = np.array([i for _, i in roots])
    schema = "doc_id long, text_hash long, set_hash long, check long, size int, signature binary, paths array<long>"

    def scan(batches):
        for batch in batches:
            texts = raw(batch.column("text"))
            node, check, size, sig, paths = [], [], [], [], []
            for s in shingle_sets(texts, rules.shingle):
                m = _signature(s, odd)
                node.append(int(mix(np.array([s.sum() + np.uint64(len(s))], "uint64"))[0].astype("int64")))
                check.append(int(mix(np.array([mix(s ^ _CHECK).sum()], "uint64"))[0].astype("int64")))
                size.append(len(s))
                sig.append((m & np.uint64(0xFFFF)).astype("uint16").tobytes())
                p = mix(mix(run_of * np.uint64(1 << 20) + place.astype("uint64")) ^ m[place])
                paths.append(p.astype("int64").tolist() if len(s) else [])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    batch.column("text_hash"),
                    pa.array(node, pa.int64()),
                    pa.array(check, pa.int64()),
                    pa.array(size, pa.int32()),
                    pa.array(sig, pa.binary()),
                    pa.array(paths, pa.list_(pa.int64())),
                ],
                names=["doc_id", "text_hash", "set_hash", "check", "size", "signature", "paths"],
            )

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")
    return narrow.mapInArrow(scan, schema)


def _split(rows: DataFrame, level: int, rules: NearRules) -> DataFrame:
    """(path, node, signature) one level further: each path samples coordinates by its own hash."""
    t = rules.coordinates
    chance = np.uint64(int(2**64 * min(1.0, 1 / (rules.similarity * t))))

    def scan(batches):
        for batch in batches:
            path = np.array(batch.column("path").to_pylist(), "int64").view("uint64")
            sig = np.frombuffer(b"".join(batch.column("signature").to_pylist()), "uint16").reshape(len(path), t)
            draw = mix(path[:, None] ^ _odd(t, 1000 + level)[None, :])
            row, i = np.nonzero(draw < chance)
            child = mix(mix(path[row] + i.astype("uint64")) ^ sig[row, i].astype("uint64")).view("int64")
            yield pa.RecordBatch.from_arrays(
                [pa.array(child), batch.column("node").take(pa.array(row)), batch.column("signature").take(pa.array(row))],
                names=["path", "node", "signature"],
            )

    return rows.mapInArrow(scan, "path long, node long, signature binary")


def _forest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """For each of n items the least item of its component under the pairs (a, b)."""
    root = np.arange(n)
    while len(a):
        low, high = np.minimum(root[a], root[b]), np.maximum(root[a], root[b])
        if (low == high).all():
            break
        np.minimum.at(root, high, low)
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
    return root


def _runs(keys: np.ndarray) -> np.ndarray:
    """Bounds of the runs of equal keys."""
    return np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]]) if len(keys) else np.zeros(1, int)


def _whole_groups(batches, keys: list[str]):
    """Arrow batches of rows sorted by keys, as tables that never cut a group in two."""
    held = None
    for batch in batches:
        t = pa.Table.from_batches([batch])
        held = t if held is None else pa.concat_tables([held, t])
        last = {k: held.column(k)[-1].as_py() for k in keys}
        cut = held.num_rows
        cols = [held.column(k).to_numpy() for k in keys]
        same = np.ones(held.num_rows, bool)
        for k, c in zip(keys, cols):
            same &= c == last[k]
        cut = int(np.flatnonzero(same)[0])
        if cut:
            yield held.slice(0, cut)
            held = held.slice(cut)
    if held is not None and held.num_rows:
        yield held


def _compare_small(rows: DataFrame, rules: NearRules) -> DataFrame:
    """Edges (src, dst) of a spanning forest of the likely pairs in every small bucket."""
    least = rules.similarity - rules.slack
    t = rules.coordinates

    def scan(batches):
        for table in _whole_groups(batches, ["path"]):
            path, node = table.column("path").to_numpy(), table.column("node").to_numpy()
            sig = np.frombuffer(b"".join(table.column("signature").to_pylist()), "uint16").reshape(len(path), t)
            src, dst = [], []
            bounds = _runs(path)
            for lo, hi in zip(bounds[:-1], bounds[1:]):
                s = sig[lo:hi]
                a, b = np.triu_indices(hi - lo, 1)
                ok = (s[a] == s[b]).sum(axis=1) >= least * t
                root = _forest(a[ok], b[ok], hi - lo)
                moved = np.flatnonzero(root != np.arange(hi - lo))
                src.append(node[lo:hi][moved])
                dst.append(node[lo:hi][root[moved]])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(x) if x else np.zeros(0, "int64")) for x in (src, dst)], names=["src", "dst"]
            )

    return rows.repartition("path").sortWithinPartitions("path").mapInArrow(scan, "src long, dst long")


def _near_pivot(large: DataFrame, rules: NearRules) -> DataFrame:
    """(path, node, least, near) of large buckets, whose rows carry the signature of the least node as pivot: whether a node looks like it.
    A large group of near copies is found at once, and not only by what is left of it after more splits."""
    bar, t = (rules.similarity - rules.slack) * rules.coordinates, rules.coordinates

    def scan(batches):
        for batch in batches:
            a, b = (np.frombuffer(b"".join(batch.column(k).to_pylist()), "uint16").reshape(-1, t) for k in ("signature", "pivot"))
            near = pa.array((a == b).sum(axis=1) >= bar)
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in ("path", "node", "least")), near], names=["path", "node", "least", "near"])

    return large.select("path", "node", "least", "signature", "pivot").mapInArrow(scan, "path long, node long, least long, near boolean")


def candidate_edges(reps: DataFrame, rules: NearRules) -> DataFrame:
    """reps: (node, signature, paths), one row a node. Edges may come twice."""
    reps = save(reps)
    rows, signatures = reps.select(F.explode("paths").alias("path"), "node"), reps.select("node", "signature")
    small_buckets, stars = [], []
    for level in range(1, rules.depth + 1):
        sizes = save(rows.groupBy("path").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("least")).filter("n > 1"))
        # the pivot of a large bucket comes with its size, so rows meet their bucket once
        pivots = sizes.filter(F.col("n") > rules.small).join(signatures.select(F.col("node").alias("least"), F.col("signature").alias("pivot")), "least")
        small = sizes.filter(F.col("n") <= rules.small).withColumn("pivot", F.lit(None).cast("binary"))
        met = rows.join(save(small.unionByName(pivots)).hint("merge"), "path")
        if level == 1:  # most paths lead to one node; only the others need signatures
            met = save(met).join(signatures.hint("merge"), "node")
        met = save(met)
        small_buckets.append(met.filter(F.col("n") <= rules.small).select("path", "node", "signature"))
        large = met.filter(F.col("n") > rules.small)
        marked = save(_near_pivot(large, rules))
        if marked.isEmpty():
            break
        stars.append(marked.filter("near and node <> least").select(F.col("node").alias("src"), F.col("least").alias("dst")))
        # a bucket whose nodes all look like its least one is one group already: splits would find no other pair of it
        large = save(large.join(marked.filter("not near").select("path").distinct(), "path", "left_semi"))
        if large.isEmpty():
            break
        if level == rules.depth:
            stars.append(large.select(F.col("node").alias("src"), F.col("least").alias("dst")).filter("src <> dst"))
        else:
            rows = save(_split(large.select("path", "node", "signature"), level, rules))
    # a path is one level's, so the small buckets of all levels are compared in one pass
    return reduce(DataFrame.unionByName, [_compare_small(reduce(DataFrame.unionByName, small_buckets), rules), *stars])


def _all_stars(edges: DataFrame) -> bool:
    """Whether every node of the distinct edges points to one other, which points to none."""
    ends = edges.select(F.col("src").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(
        edges.select(F.col("dst").alias("x"), F.lit(0).alias("up"), F.lit(1).alias("down"))
    )
    sides = ends.groupBy("x").agg(F.sum("up").alias("up"), F.sum("down").alias("down"))
    return not sides.agg(F.count_if(F.expr("up > 1 or (up > 0 and down > 0)"))).first()[0]


def components(edges: DataFrame, most: int = 60) -> DataFrame:
    """(node, label): the least node of each component, by alternating large-star and small-star steps, until only stars are
    left. The steps grow with the logarithm of the nodes; raises if ``most`` are not enough."""
    # towards the less node: centres of stars are then the least of theirs
    now = save(edges.filter("src <> dst").select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")).distinct())
    for _ in range(most):
        if _all_stars(now):
            break
        both = now.unionByName(now.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        least = both.groupBy("src").agg(F.least(F.min("dst"), F.col("src")).alias("m"))
        large = save(both.join(least, "src").filter("dst > src and dst <> m").select(F.col("dst").alias("src"), F.col("m").alias("dst")))
        down = large.select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst"))
        least = down.groupBy("src").agg(F.min("dst").alias("m"))
        small = down.join(least, "src").select(F.explode(F.array("src", "dst")).alias("x"), "m").filter("x <> m")
        now = save(small.select(F.col("x").alias("src"), F.col("m").alias("dst")).distinct())
    else:
        raise RuntimeError(f"components not found in {most} steps")
    roots = now.select(F.col("dst").alias("node"), F.col("dst").alias("label")).distinct()
    return now.select(F.col("src").alias("node"), F.col("dst").alias("label")).unionByName(roots)


def _exact_blocks(members: DataFrame, rules: NearRules) -> DataFrame:
    """members: (label, ti, tj, side, block, node, weight, set). (node, links, root, label) for each pair of blocks of a tile."""
    need = rules.similarity

    def links(x: list[np.ndarray], y: list[np.ndarray] | None) -> np.ndarray:
        """Which pairs reach the similarity; shared shingles are counted by matrix products over slices of the shingles."""
        z = x + (y or [])
        size = np.array([len(s) for s in z])
        row = np.repeat(np.arange(len(z)), size)
        vocabulary, col = np.unique(np.concatenate(z), return_inverse=True)
        seen = np.bincount(col, minlength=len(vocabulary))
        rank = np.cumsum(seen > 1) - 1  # shingles of one set alone share nothing
        keep = seen[col] > 1
        row, col = row[keep], rank[col[keep]]
        order = np.argsort(col, kind="stable")
        row, col = row[order], col[order]
        n, m = len(x), len(z) if y is None else len(y)
        shared = np.zeros((n, n if y is None else m), "float32")
        for at in range(0, int(col[-1]) + 1 if len(col) else 0, 4096):
            lo, hi = np.searchsorted(col, [at, at + 4096])
            dense = np.zeros((len(z), 4096), "float32")
            dense[row[lo:hi], col[lo:hi] - at] = 1
            shared += dense[:n] @ (dense[:n] if y is None else dense[n:]).T
        sx, sy = size[:n], size[:n] if y is None else size[n:]
        union = sx[:, None] + sy[None, :] - shared
        return (shared >= need * union - 1e-6) & (shared > 0)

    def scan(batches):
        for table in _whole_groups(batches, ["label", "ti", "tj"]):
            label, ti, tj = (table.column(k).to_numpy() for k in ("label", "ti", "tj"))
            node, weight, side, block = (table.column(k).to_numpy() for k in ("node", "weight", "side", "block"))
            sets = [np.frombuffer(s, "uint64") for s in table.column("set").to_pylist()]
            bounds = np.unique(np.concatenate([_runs(k) for k in (label, ti, tj)]))
            out = [[], [], [], []]
            for left, right in (x for lo, hi in zip(bounds[:-1], bounds[1:]) for x in block_pairs(lo, hi, ti[lo] == tj[lo], side, block, node)):
                if right is None:
                    ok = links([sets[i] for i in left], None)
                    np.fill_diagonal(ok, False)
                    a, b = np.nonzero(np.triu(ok))
                    ids, count = left, ok @ weight[left]
                else:
                    ok = links([sets[i] for i in left], [sets[i] for i in right])
                    a, b = np.nonzero(ok)
                    b = b + len(left)
                    ids = np.concatenate([left, right])
                    count = np.concatenate([ok @ weight[right], ok.T @ weight[left]])
                order = np.argsort(node[ids], kind="stable")  # roots are the least nodes
                place = np.empty(len(ids), "int64")
                place[order] = np.arange(len(ids))
                root = _forest(place[a], place[b], len(ids))[place]
                for o, v in zip(out, (node[ids], count, node[ids][order][root], label[ids])):
                    o.append(v.astype("int64"))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(o) if o else np.zeros(0, "int64")) for o in out],
                names=["node", "links", "root", "label"],
            )

    def block_pairs(lo, hi, same, side, block, node):
        """The places of the two sides of each pair of blocks of a tile; None for the second side where they are one block."""
        rows = [{}, {}]
        for k in (0, 1):
            mine = np.flatnonzero(side[lo:hi] == k) + lo
            for b in np.unique(block[mine]):
                here = mine[block[mine] == b]
                rows[k][b] = here[np.unique(node[here], return_index=True)[1]]  # repeated rows once
        if same:
            for b, left in rows[0].items():
                yield left, None
                yield from ((left, right) for c, right in rows[0].items() if c > b)
        else:
            yield from ((left, right) for left in rows[0].values() for right in rows[1].values())

    keys = ["label", "ti", "tj"]
    return members.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(scan, "node long, links long, root long, label long")


def _members(docs: DataFrame, groups: DataFrame, rules: NearRules) -> DataFrame:
    """The shingle sets of the grouped nodes, one copy for each tile that needs them."""

    def scan(batches):
        for batch in batches:
            sets = [s.tobytes() for s in shingle_sets(raw(batch.column("text")), rules.shingle)]
            cols = [batch.column(k) for k in ("label", "node", "weight", "block", "blocks", "tile")]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(sets, pa.binary())], names=["label", "node", "weight", "block", "blocks", "tile", "set"])

    text = docs.select(F.col("doc_id").cast("long").alias("rep"), F.xxhash64("text").alias("rep_text"), "text")
    # both sides grow with the corpus: one shuffle of the texts, at every size
    joined = (
        text.join(groups.hint("merge"), text["rep"].eqNullSafe(groups["rep_id"]) & (text["rep_text"] == groups["rep_hash"]))
        .select("label", "node", "weight", "block", "blocks", "tile", "text")
    )
    sets = joined.mapInArrow(scan, "label long, node long, weight long, block int, blocks int, tile int, set binary")
    own = F.floor(F.col("block") / F.col("tile")).cast("int")
    pairs = F.explode(
        F.transform(
            F.sequence(F.lit(0), F.ceil(F.col("blocks") / F.col("tile")).cast("int") - 1),
            lambda j: F.struct(F.least(own, j).alias("ti"), F.greatest(own, j).alias("tj"), (own > j).cast("int").alias("side")),
        )
    )
    return sets.withColumn("p", pairs).select("label", "p.ti", "p.tj", "p.side", "block", "node", "weight", "set")


def near_duplicates(docs: DataFrame, rules: NearRules = NearRules()) -> DataFrame:
    """(doc_id, text_hash, class_node, class_id, n_links), one row for each row of docs.

    text_hash tells rows of one doc_id apart, and class_node classes without any doc_id."""
    seen = save(nodes_of(docs, rules))
    both = ["set_hash", "check"]
    texts = seen.groupBy(*both, "text_hash").agg(F.min("doc_id").alias("d"), F.max("size").alias("size"))
    # sets that share one of their two hashes get ids of their own
    node = F.col("set_hash") + F.row_number().over(W.partitionBy("set_hash").orderBy("check")) - 1
    nodes = save(
        texts.groupBy(*both).agg(
            F.count(F.lit(1)).alias("weight"),
            F.min("d").alias("least"),
            F.min(F.struct(F.coalesce("d", F.lit(2**63 - 1)).alias("o"), "d", "text_hash")).alias("rep"),
            F.max("size").alias("size"),
        )
        .withColumn("node", node)
        .select("node", *both, "weight", "least", F.col("rep.d").alias("rep_id"), F.col("rep.text_hash").alias("rep_hash"), "size")
    )
    chosen = nodes.select("node", *both, F.col("rep_id").alias("doc_id"), F.col("rep_hash").alias("text_hash"))
    first = (
        seen.filter("size > 0")
        .alias("s")
        .join(
            chosen.alias("c"),
            (F.col("s.set_hash") == F.col("c.set_hash"))
            & (F.col("s.check") == F.col("c.check"))
            & F.col("s.doc_id").eqNullSafe(F.col("c.doc_id"))
            & (F.col("s.text_hash") == F.col("c.text_hash")),
        )
        .select("c.node", "s.signature", "s.paths")
        .dropDuplicates(["node"])
    )
    edges = candidate_edges(first, rules)
    groups = save(components(edges))
    grouped = groups.join(nodes.select("node", "size"), "node")
    sizes = save(grouped.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.max("size").alias("longest")))
    blocks = F.ceil(F.col("n") / rules.block).cast("int")
    # at least 16 tiles a side before tiles grow, and a bounded number of shingles in a tile
    room = F.floor(F.lit(rules.tile_shingles) / (F.col("longest") * rules.block))
    tile = F.greatest(F.lit(1), F.least(F.lit(rules.tile), F.ceil(blocks / 16), room)).cast("int")
    placed = save(
        groups.join(sizes, "label")
        .join(nodes, "node")
        .select(
            "label", "node", "weight", "rep_id", "rep_hash", blocks.alias("blocks"), tile.alias("tile"),
            F.pmod(F.xxhash64("node"), blocks.cast("long")).cast("int").alias("block"),
        )
    )
    found = save(_exact_blocks(_members(docs, placed, rules), rules))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    # a group of one block has its components already; only forests of several blocks are joined
    whole = sizes.filter(F.col("n") <= rules.block).select("label")
    parts = found.join(whole, "label", "left_anti").select(F.col("node").alias("src"), F.col("root").alias("dst"))
    classes = found.join(whole, "label", "left_semi").select("node", F.col("root").alias("label"))
    parts = save(parts)
    if not parts.isEmpty():
        classes = classes.unionByName(components(parts))
    of = (
        nodes.join(links, "node", "left")
        .join(classes, "node", "left")
        .select(
            "node", *both, "weight", "least", "size", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("label", "node").alias("label")
        )
    )
    of = save(of)
    names = of.groupBy("label").agg(F.min("least").alias("class_id"))
    own = F.when(F.col("size_of") > 0, F.col("weight") - 1).otherwise(0)
    joined = of.join(names, "label").select(*both, "label", "class_id", "weight", "links", F.col("size").alias("size_of"))
    return seen.select("doc_id", "text_hash", *both).join(joined, both).select(
        "doc_id", "text_hash", F.col("label").alias("class_node"), "class_id", (F.col("links") + own).cast("long").alias("n_links")
    )


def one_of_each(docs: DataFrame, rules: NearRules = NearRules()) -> DataFrame:
    """docs with one row of each class: the least doc_id, of its rows the least text hash, and of equal rows any one."""
    classes = save(near_duplicates(docs, rules))
    row = F.struct(F.coalesce("doc_id", F.lit(2**63 - 1)).alias("id"), "text_hash")
    kept = classes.groupBy("class_node").agg(F.min(row).alias("k")).select("k.id", "k.text_hash")
    keys = (F.coalesce(docs["doc_id"].cast("long"), F.lit(2**63 - 1)), F.xxhash64(docs["text"]))
    out = docs.join(kept, (keys[0] == kept["id"]) & (keys[1] == kept["text_hash"]), "left_semi")
    if classes.groupBy("doc_id", "text_hash").count().filter("count > 1").isEmpty():
        return out
    whole = out.select(F.struct("*").alias("row"), *[k.alias(f"key{i}") for i, k in enumerate((F.col("doc_id"), F.xxhash64("text")))])
    return whole.dropDuplicates(["key0", "key1"]).select("row.*")
