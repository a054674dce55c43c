"""Entity linking: mentions of one video grouped under calibrated rules.

mentions: (video_id, mention LONG, answer, field, vector). Two mentions of one answer are provably different, so their
similarities say how alike different subjects can look; the threshold comes from them.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from moments.functions.vectors import dot, unit
from moments.operators import tiles
from moments.operators.components import components
from moments.operators.folder import saved

QUANTILE = {"q95": 0.95, "q90": 0.90}


@dataclass(frozen=True)
class LinkProfile:
    """A link definition as data."""

    rule: str = "max"
    mutual: bool = True
    threshold: float | None = None
    min_appearances: int = 2
    max_narratives: int = 12

    def __post_init__(self):
        if self.rule not in ("max", *QUANTILE):
            raise ValueError("rule must be max, q95 or q90")


def pairs(mentions: DataFrame, digits: int = 9) -> DataFrame:
    """All pairs i < j of a video with their cosine; pairs arise inside a video only."""
    u = mentions.select("video_id", "mention", "answer", "field", unit(F.col("vector")).alias("u"))
    a = u.select("video_id", *[F.col(c).alias(f"{c}_i") for c in ("mention", "answer", "field", "u")])
    b = u.select("video_id", *[F.col(c).alias(f"{c}_j") for c in ("mention", "answer", "field", "u")])
    met = a.join(b, "video_id").filter("mention_i < mention_j")
    return met.withColumn("sim", F.round(dot(F.col("u_i"), F.col("u_j")), digits)).drop("u_i", "u_j")


def cannot_link(paired: DataFrame) -> DataFrame:
    """Pairs of one answer."""
    return paired.filter("answer_i = answer_j")


def thresholds(paired: DataFrame, profile: LinkProfile) -> DataFrame:
    """(video_id, threshold): from the provably different pairs; a video without any gets none and links nothing."""
    if profile.threshold is not None:
        return paired.select("video_id").distinct().withColumn("threshold", F.lit(float(profile.threshold)))
    level = F.max("sim") if profile.rule == "max" else F.percentile("sim", QUANTILE[profile.rule])
    return cannot_link(paired).groupBy("video_id").agg(level.alias("threshold"))


def candidates(paired: DataFrame, profile: LinkProfile = LinkProfile()) -> DataFrame:
    """Pairs of different answers and one field above the threshold that are each other's best in the other's answer."""
    across = paired.filter("answer_i <> answer_j")
    passed = across.join(thresholds(paired, profile), "video_id").filter("field_i = field_j and sim > threshold")
    if not profile.mutual:
        return passed.select("video_id", "mention_i", "mention_j", "answer_i", "answer_j", "sim")
    sides = across.select("video_id", F.col("mention_i").alias("m"), F.col("answer_j").alias("a"), F.col("mention_j").alias("o"), "sim").unionByName(
        across.select("video_id", F.col("mention_j").alias("m"), F.col("answer_i").alias("a"), F.col("mention_i").alias("o"), "sim")
    )
    best = sides.groupBy("video_id", "m", "a").agg(F.max_by("o", F.struct("sim", -F.col("o"))).alias("best"))
    there = best.select("video_id", F.col("m").alias("mention_i"), F.col("a").alias("answer_j"), F.col("best").alias("mention_j"))
    back = best.select("video_id", F.col("m").alias("mention_j"), F.col("a").alias("answer_i"), F.col("best").alias("mention_i"))
    kept = passed.join(there, ["video_id", "mention_i", "mention_j", "answer_j"], "left_semi").join(
        back, ["video_id", "mention_i", "mention_j", "answer_i"], "left_semi"
    )
    return kept.select("video_id", "mention_i", "mention_j", "answer_i", "answer_j", "sim")


def parted(linked: DataFrame, most: int = 100_000) -> DataFrame:
    """linked with ``part``: groups never leave a component of the links, so the links of a video that has more than ``most`` of them
    are parted by component; those of other videos, which any task holds, stay together."""
    large = linked.groupBy("video_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > most).select("video_id")
    if large.isEmpty():
        return linked.withColumn("part", F.lit(0).cast("long"))
    linked = saved(linked)
    many = linked.join(large, "video_id", "left_semi")
    node = lambda k: F.struct("video_id", f"mention_{k}")
    ids = saved(
        many.select(F.explode(F.array(node("i").cast("struct<video_id:string,mention:bigint>"), node("j").cast("struct<video_id:string,mention:bigint>"))).alias("x"))
        .select("x.*").distinct().withColumn("node", F.monotonically_increasing_id())
    )
    end = lambda k, name: ids.select("video_id", F.col("mention").alias(f"mention_{k}"), F.col("node").alias(name))
    edges = many.join(end("i", "a"), ["video_id", "mention_i"]).join(end("j", "b"), ["video_id", "mention_j"])
    of = ids.join(components(edges.select("a", "b")), "node").select("video_id", F.col("mention").alias("mention_i"), F.col("component").alias("part"))
    few = linked.join(large, "video_id", "left_anti").withColumn("part", F.lit(0).cast("long"))
    return few.unionByName(many.join(of, ["video_id", "mention_i"]).select(*few.columns))


def greedy_groups(mentions: DataFrame, linked: DataFrame) -> DataFrame:
    """(video_id, mention, group): pairs by (-sim, i, j) join their groups unless both hold a mention of one answer. The merge
    is sequential inside a component of the links, so a task holds a small video or a component of a large one."""

    def merge(key, pdf: pd.DataFrame) -> pd.DataFrame:
        group, members, answers = {}, {}, {}
        for i, j, a, b in pdf.sort_values(["sim", "mention_i", "mention_j"], ascending=[False, True, True])[
            ["mention_i", "mention_j", "answer_i", "answer_j"]
        ].itertuples(index=False):
            for m, ans in ((i, a), (j, b)):
                if m not in group:
                    group[m], members[m], answers[m] = m, [m], {ans}
            x, y = group[i], group[j]
            if x == y or answers[x] & answers[y]:
                continue
            for m in members[y]:
                group[m] = x
            members[x] += members.pop(y)
            answers[x] |= answers.pop(y)
        least = {g: min(ms) for g, ms in members.items()}
        return pd.DataFrame({"video_id": key[0], "mention": list(group), "group": [least[g] for g in group.values()]})

    found = parted(linked).groupBy("video_id", "part").applyInPandas(merge, "video_id string, mention long, group long")
    out = mentions.select("video_id", "mention").join(found, ["video_id", "mention"], "left")
    return out.select("video_id", "mention", F.coalesce("group", "mention").alias("group"))


def tiled_candidates(mentions: DataFrame, profile: LinkProfile = LinkProfile(), calibration: DataFrame | None = None) -> DataFrame:
    """As ``candidates``, straight from the mentions: pairs are made and judged in matrix tiles, and only links become rows."""
    if profile.threshold is not None:
        bars = mentions.select("video_id").distinct().withColumn("threshold", F.lit(float(profile.threshold)))
    else:
        bars = thresholds(tiles.calibration_pairs(mentions) if calibration is None else calibration, profile)
    return tiles.linked(mentions, bars, profile.mutual)


def link(mentions: DataFrame, profile: LinkProfile = LinkProfile()) -> DataFrame:
    return greedy_groups(mentions, tiled_candidates(mentions, profile))


def entities(grouped: DataFrame, chunks: DataFrame) -> DataFrame:
    """grouped (video_id, group, chunk_id, signature) to one row an entity: distinct chunks, span, observed seconds, the longest
    signature as label, numbered by (-appearances, start)."""
    label = F.max_by("signature", F.struct(F.length("signature"), -F.col("chunk_id")))
    name = grouped.groupBy("video_id", "group").agg(label.alias("label"), F.count(F.lit(1)).alias("mentions"))
    time = (
        grouped.select("video_id", "group", "chunk_id").distinct().join(chunks, ["video_id", "chunk_id"], "left")
        .groupBy("video_id", "group")
        .agg(
            F.array_sort(F.collect_list("chunk_id")).alias("chunk_ids"), F.count(F.lit(1)).alias("appearances"),
            F.min("start_ts").alias("start_ts"), F.max("end_ts").alias("end_ts"),
            F.round(F.sum(F.col("end_ts") - F.col("start_ts")), 3).alias("observed_s"),
        )
    )
    order = W.partitionBy("video_id").orderBy(F.desc("appearances"), "start_ts", "group")
    out = name.join(time, ["video_id", "group"]).withColumn("place", F.row_number().over(order))
    return out.withColumn("entity_id", F.format_string("e%03d", F.col("place") - 1))


def link_answer(mentions: DataFrame, chunks: DataFrame, profile: LinkProfile = LinkProfile(), top: int = 50) -> DataFrame:
    """The whole answer of a profile, one row a video: how many mentions, entities, linked and narrated ones, the threshold with
    the pairs that calibrated it, the candidate pairs, and the entities that share most chunks. mentions carry chunk_id and
    signature beside the columns of linking; a video of one mention has counts of one and no pair."""
    paired = saved(tiles.calibration_pairs(mentions))
    linked = saved(tiled_candidates(mentions, profile, paired))
    grouped = greedy_groups(mentions, linked)
    found = saved(entities(mentions.select("video_id", "mention", "chunk_id", "signature").join(grouped, ["video_id", "mention"]), chunks))
    often = found.filter(F.col("appearances") >= profile.min_appearances)
    seen = often.select("video_id", "entity_id", F.explode("chunk_ids").alias("chunk_id"))
    a, b = seen.withColumnRenamed("entity_id", "a"), seen.withColumnRenamed("entity_id", "b")
    met = a.join(b, ["video_id", "chunk_id"]).filter("a < b").groupBy("video_id", "a", "b").agg(F.count(F.lit(1)).alias("count"))
    place = F.row_number().over(W.partitionBy("video_id").orderBy(F.desc("count"), "a", "b"))
    best = met.withColumn("place", place).filter(F.col("place") <= top).groupBy("video_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("place", "a", "b", "count"))), lambda x: F.concat_ws(":", x.a, x.b, x["count"].cast("string"))).alias("together")
    )
    count = lambda df, name: df.groupBy("video_id").agg(F.count(F.lit(1)).alias(name))
    out = count(mentions, "mentions")
    for part in (
        count(found, "count"), count(often, "linked"), count(narrated(found, profile), "narrated"), thresholds(paired, profile),
        count(cannot_link(paired), "calibration_pairs"), count(linked, "candidate_pairs"), best,
    ):
        out = out.join(part, "video_id", "left")
    none = F.array().cast("array<string>")
    return out.fillna(0, ["count", "linked", "narrated", "calibration_pairs", "candidate_pairs"]).withColumn("together", F.coalesce("together", none))


def narrated(found: DataFrame, profile: LinkProfile) -> DataFrame:
    """The first entities of each video that appear often enough."""
    often = found.filter(F.col("appearances") >= profile.min_appearances)
    place = F.row_number().over(W.partitionBy("video_id").orderBy("place"))
    return often.withColumn("turn", place).filter(F.col("turn") <= profile.max_narratives)


def doubts(observations: DataFrame, flagged: DataFrame) -> DataFrame:
    """observations (entity, number) with the first reason flagged (entity, number, pos, reason); numbers out of range are
    ignored; ``disputed`` marks entities whose every observation is in doubt."""
    first = flagged.groupBy("entity", "number").agg(F.min_by("reason", "pos").alias("doubt"))
    out = observations.join(first, ["entity", "number"], "left")
    every = F.count("doubt").over(W.partitionBy("entity")) == F.count(F.lit(1)).over(W.partitionBy("entity"))
    return out.withColumn("disputed", every)


def fixed_link(mentions: DataFrame, same: float = 0.95, link_at: float = 0.88, generic: float = 0.80) -> DataFrame:
    """The older linker's pairs: near equal ones of an answer are one, mentions that resemble everything take no part."""
    paired = saved(pairs(mentions))
    both = paired.select("video_id", F.col("mention_i").alias("m"), "sim").unionByName(paired.select("video_id", F.col("mention_j").alias("m"), "sim"))
    plain = both.groupBy("video_id", "m").agg(F.avg("sim").alias("mean")).filter(F.col("mean") >= generic)
    twin = cannot_link(paired).filter(F.col("sim") >= same).select("video_id", F.col("mention_j").alias("m")).distinct()
    out = plain.select("video_id", "m").unionByName(twin).distinct()
    kept = paired.filter((F.col("answer_i") != F.col("answer_j")) & (F.col("sim") >= link_at))
    for side in ("mention_i", "mention_j"):
        kept = kept.join(out.withColumnRenamed("m", side), ["video_id", side], "left_anti")
    return kept.select("video_id", "mention_i", "mention_j", "answer_i", "answer_j", "sim")


# evaluation


def pair_score(grouped: DataFrame, truth: DataFrame, unsure: DataFrame | None = None, different: DataFrame | None = None) -> DataFrame:
    """Pairwise precision, recall and F1 by video. grouped (video_id, mention, group), truth (mention, subject). A link of an
    ``unsure`` (mention) is ``unchecked``, but wrong where ``different`` (mention, subject) knows the other mention's subject to
    be someone else; a sure mention without a label is nobody else's. Counted from group sizes, so no pair is made."""

    def chosen(n):
        return F.col(n) * (F.col(n) - 1) / 2

    doubted = grouped.select("mention").limit(0) if unsure is None else unsure.select("mention").distinct()
    known = grouped.join(truth, "mention", "left").join(doubted.withColumn("doubt", F.lit(True)), "mention", "left")
    known = known.withColumn("sure", F.col("doubt").isNull()).withColumn("subject", F.when(F.col("sure"), F.col("subject")))
    both = known.filter("sure").groupBy("video_id", "group", "subject").agg(F.count(F.lit(1)).alias("n"))
    tp = both.filter("subject is not null").groupBy("video_id").agg(F.sum(chosen("n")).alias("tp"))
    by_group = known.groupBy("video_id", "group").agg(F.count(F.lit(1)).alias("n"), F.count_if("sure").alias("k"))
    linked = by_group.groupBy("video_id").agg(F.sum(chosen("k")).alias("linked"), F.sum(chosen("n") - chosen("k")).alias("unchecked"))
    if different is not None:
        other = known.filter("not sure").select("video_id", "group", "mention").join(different.distinct(), "mention")
        wrong = other.join(both, ["video_id", "group", "subject"]).groupBy("video_id").agg(F.sum("n").alias("wrong"))
        linked = linked.join(wrong, "video_id", "left").fillna(0, ["wrong"])
        linked = linked.withColumn("linked", F.col("linked") + F.col("wrong")).withColumn("unchecked", F.col("unchecked") - F.col("wrong")).drop("wrong")
    same = both.filter("subject is not null").groupBy("video_id", "subject").agg(F.sum("n").alias("n")).groupBy("video_id").agg(F.sum(chosen("n")).alias("same"))
    out = linked.join(tp, "video_id", "left").join(same, "video_id", "left").fillna(0.0, ["tp", "same"])
    p = F.when(F.col("linked") > 0, F.col("tp") / F.col("linked")).otherwise(1.0)
    r = F.when(F.col("same") > 0, F.col("tp") / F.col("same")).otherwise(1.0)
    return out.select(
        "video_id", p.alias("precision"), r.alias("recall"), F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0).alias("f1"),
        F.col("tp").alias("tp"), (F.col("linked") - F.col("tp")).alias("fp"), (F.col("same") - F.col("tp")).alias("fn"), "unchecked",
    )


def choose_config(scores: DataFrame, tuned_on: str, least: float = 0.9) -> DataFrame:
    """scores (embedder, rule, mutual, video_id, precision, f1) to the configurations of each embedder in order: those whose
    precision on the tuning video reaches ``least`` first, then by F1 and precision there. ``others`` is the mean F1 of the
    other videos, ``safe`` whether every embedder keeps the precision with that configuration."""
    by = ["embedder", "rule", "mutual"]
    tune = scores.filter(F.col("video_id") == tuned_on).select(*by, "precision", "f1")
    rest = scores.filter(F.col("video_id") != tuned_on).groupBy(*by).agg(F.round(F.avg("f1"), 9).alias("others"))
    safe = tune.groupBy("rule", "mutual").agg((F.min("precision") >= least).alias("safe"))
    order = W.partitionBy("embedder").orderBy((F.col("precision") >= least).desc(), F.desc("f1"), F.desc("precision"), "rule", "mutual")
    return tune.withColumn("place", F.row_number().over(order)).join(rest, by, "left").join(safe, ["rule", "mutual"])


def auc(scored: DataFrame) -> DataFrame:
    """How often a same pair outscores a different one, ties a half: by ranks of distinct scores, never by pairs of pairs."""
    by = scored.groupBy("video_id", "sim").agg(F.count_if("same").alias("s"), F.count_if(~F.col("same")).alias("d"))
    below = F.coalesce(F.sum("d").over(W.partitionBy("video_id").orderBy("sim").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    won = by.withColumn("won", F.col("s") * (below + F.col("d") / 2))
    out = won.groupBy("video_id").agg(F.sum("won").alias("w"), F.sum("s").alias("s"), F.sum("d").alias("d"))
    return out.select("video_id", F.when(F.col("s") * F.col("d") > 0, F.col("w") / (F.col("s") * F.col("d"))).alias("auc"))


def track_costs(distances: DataFrame) -> DataFrame:
    """(track, pos, member, detection, distance, veto) to the cost of each (track, detection): of the last two members, mean,
    median and largest; a vetoed pair is infinite."""
    newest = W.partitionBy("track", "detection").orderBy(F.desc("pos"))
    placed = distances.withColumn("place", F.row_number().over(newest))
    added = F.sum("distance").over(newest.rowsBetween(W.unboundedPreceding, W.currentRow))  # in one order, so its last digits never vary
    out = placed.withColumn("added", added).groupBy("track", "detection").agg(
        F.min(F.when(F.col("place") <= 2, F.col("distance"))).alias("last2"),
        (F.max_by("added", "place") / F.nullif(F.count("distance"), F.lit(0))).alias("mean"),
        F.percentile("distance", 0.5).alias("median"), F.max("distance").alias("max"), F.max("veto").alias("veto"),
    )
    cost = lambda c: F.when(F.col("veto"), F.lit(float("inf"))).otherwise(F.col(c)).alias(c)
    return out.select("track", "detection", *[cost(c) for c in ("last2", "mean", "median", "max")])


def merge_tracks(costs: DataFrame, threshold: float, how: str = "min") -> DataFrame:
    """(video_id, mention, track): the closest compatible pair of tracks joins, until no cost is below the threshold. costs:
    (video_id, mention_i, mention_j, answer_i, answer_j, cost) of all pairs, and perhaps ``veto``; tracks that share an answer or hold a
    vetoed pair never join. how: the cost of two tracks from those of their members: "min" (or "last2"), "mean", "median" or "max"; a pair
    that costs lacks is infinitely far.

    Every rule needs a pair below the threshold to join two tracks, so tracks stay inside the components of such pairs, and a task holds a
    small video or the pairs of one component, whose members are the largest matrix. Under the least cost without a veto only the pairs below the
    threshold matter, and a merge is a walk over them in order."""
    if how not in ("min", "last2", "mean", "median", "max"):
        raise ValueError("how must be min, last2, mean, median or max")
    how = "min" if how == "last2" else how
    near = costs.filter((F.col("cost") < threshold) & (F.col("answer_i") != F.col("answer_j")))
    i, j = (F.col(f"mention_{k}") for k in "ij")
    ends = costs.select("video_id", F.explode(F.array(i, j)).alias("mention")).distinct()
    if how == "min" and "veto" not in costs.columns:
        return greedy_groups(ends, near.withColumn("sim", -F.col("cost"))).withColumnRenamed("group", "track")
    veto = F.coalesce(F.col("veto"), F.lit(False)) if "veto" in costs.columns else F.lit(False)
    placed = saved(parted(saved(near.select("video_id", "mention_i", "mention_j"))))
    part = placed.select("video_id", F.explode(F.array("mention_i", "mention_j")).alias("mention"), "part").distinct()
    of = lambda k: part.select("video_id", F.col("mention").alias(f"mention_{k}"), F.col("part").alias(f"part_{k}"))
    inside = costs.withColumn("veto", veto).join(of("i"), ["video_id", "mention_i"]).join(of("j"), ["video_id", "mention_j"]).filter("part_i = part_j")

    def merge(key, pdf: pd.DataFrame) -> pd.DataFrame:
        ids = np.unique(np.concatenate([pdf["mention_i"], pdf["mention_j"]]))
        rows = merged_tracks(
            np.searchsorted(ids, pdf["mention_i"]), np.searchsorted(ids, pdf["mention_j"]), pdf["answer_i"].to_numpy(), pdf["answer_j"].to_numpy(),
            pdf["cost"].to_numpy("float64"), pdf["veto"].to_numpy(bool), len(ids), threshold, how,
        )
        return pd.DataFrame([(key[0], int(ids[m]), int(ids[min(g)])) for g in rows for m in g], columns=["video_id", "mention", "track"])

    found = inside.groupBy("video_id", "part_i").applyInPandas(merge, "video_id string, mention long, track long")
    out = ends.join(found, ["video_id", "mention"], "left")
    return out.select("video_id", "mention", F.coalesce("track", "mention").alias("track"))


def merged_tracks(i, j, answer_i, answer_j, costs, veto, n: int, threshold: float, how: str) -> list[list[int]]:
    """The tracks of n members. After a merge only the row of the joined track is made anew, from the costs of its members."""
    combine = {"min": np.min, "mean": np.mean, "median": np.median, "max": np.max}[how]
    cost, apart = np.full((n, n), np.inf), np.zeros((n, n), bool)
    cost[i, j] = cost[j, i] = costs
    apart[i, j] = apart[j, i] = veto | (answer_i == answer_j)
    members = [[k] for k in range(n)]
    live = np.where(apart, np.inf, cost)
    np.fill_diagonal(live, np.inf)
    while n > 1:
        a, b = divmod(int(np.argmin(live)), n)
        if not live[a, b] < threshold:
            break
        a, b = min(a, b), max(a, b)
        members[a], members[b] = members[a] + members[b], []
        apart[a] |= apart[b]
        apart[:, a] |= apart[:, b]
        live[b], live[:, b] = np.inf, np.inf
        for k in range(n):
            if k != a and members[k]:
                live[a, k] = live[k, a] = np.inf if apart[a, k] else combine(cost[np.ix_(members[a], members[k])])
    return [g for g in members if g]


def wrong_links(grouped: DataFrame, truth: DataFrame) -> DataFrame:
    """By video and subject: mentions, the groups they are split over, and mentions of other subjects in those groups."""
    known = grouped.join(truth, "mention")
    split = known.groupBy("video_id", "subject").agg(
        F.count(F.lit(1)).alias("mentions"), F.array_sort(F.collect_set("group")).alias("groups")
    )
    n = known.groupBy("video_id", "group").agg(F.count(F.lit(1)).alias("all"))
    own = known.groupBy("video_id", "group", "subject").agg(F.count(F.lit(1)).alias("own"))
    wrong = own.join(n, ["video_id", "group"]).groupBy("video_id", "subject").agg(F.sum(F.col("all") - F.col("own")).alias("strangers"))
    return split.join(wrong, ["video_id", "subject"])


#: Weights of attributes and values that count as near.
WEIGHTS = {
    "gender": 3.0, "age_group": 2.0, "hair_color": 2.5, "hair_style": 1.0,
    "top_color": 2.0, "top_type": 1.0, "bottom_color": 2.0, "bottom_type": 1.0,
}
UNKNOWN = ["unclear", "covered", ""]
NEAR = [
    ("dark_blue", "black"), ("dark_blue", "blue"), ("blue", "light_blue"), ("grey", "white"), ("beige", "white"), ("beige", "brown"),
    ("red", "pink"), ("blonde", "grey"), ("blonde", "brown"), ("jacket", "coat"), ("jacket", "puffer"), ("coat", "puffer"),
    ("sweater", "hoodie"), ("sweater", "jacket"), ("shirt", "t_shirt"), ("trousers", "jeans"), ("trousers", "leggings"),
    ("teen", "young_adult"), ("young_adult", "adult"), ("adult", "older_adult"), ("short", "shaved"), ("ponytail", "bun"),
    ("long", "ponytail"),
]


#: Accessories that are carried, and words that do not distinguish.
CARRIED = ["shopping_bag", "basket", "box", "stroller"]
PLAIN_WORDS = "a an the and with of on in none nothing no".split()


def _marks(text):
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z]+"), F.lit(0))
    return F.array_distinct(F.filter(found, lambda w: ~w.isin(PLAIN_WORDS)))


def attribute_distance(x, y, weights=None, carried: bool = True, marks: bool = False):
    """Weighted attribute distance of two structs: unknown costs nothing, near values half, shared accessories give 2 back each
    (those that are carried only if ``carried``), and so does a shared description of marks (``distinguishing``, word Jaccard
    of 0.3 or more)."""
    total = F.lit(0.0)
    near = [f"{min(p)}|{max(p)}" for p in NEAR]
    for name, w in (weights or WEIGHTS).items():
        a, b = F.coalesce(x[name], F.lit("unclear")), F.coalesce(y[name], F.lit("unclear"))
        both = F.concat_ws("|", F.least(a, b), F.greatest(a, b))
        cost = F.when(a.isin(UNKNOWN) | b.isin(UNKNOWN) | (a == b), 0.0).when(both.isin(near), 0.5).otherwise(1.0)
        total = total + w * cost
    shared = F.array_intersect(x["accessories"], y["accessories"])
    shared = shared if carried else F.filter(shared, lambda a: ~a.isin(CARRIED))
    total = total - 2.0 * F.size(shared)
    if not marks:
        return total
    a, b = _marks(x["distinguishing"]), _marks(y["distinguishing"])
    alike = (F.size(a) > 0) & (F.size(b) > 0) & (F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)) >= 0.3)
    return total - F.when(alike, 2.0).otherwise(0.0)
