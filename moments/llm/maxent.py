"""Language-model scores: a smoothed unigram base and a hashed maximum-entropy model with class-factored softmax.

P(word | history) = P(class | history) * P(word | class). The history gives hashed features: the previous word (bigram), the
class of the word before it (skip) and both together (trigram). The weights are fitted by gradient rounds: every round is a
Spark job in which tasks send the gradient of their share of the data. The gradient needs the data only as counts of
(previous, before, class), so those are gathered once from all training texts.

Classes are learned from all training texts too: each of the ``own_forms`` most frequent words, and each ending of three
bytes for all other words, has a histogram of its neighbours; the histograms are clustered by k-means (square roots, so that distance
is Hellinger's). The end of a text is a class of its own. Inside a class every known word gives up the same discount of its
count, estimated from the words that occur once and twice; what they give up is the chance of an unseen word, which is one
symbol of its class as it is one in the base. So the probabilities of all known words, of the end, and of an unseen word of
each class add up to 1 after every history.

Word counts are shuffled by word and grow with the corpus. Scoring runs over batches of texts in numpy: one gather of log
P(class | history) a word. The counts of the frequent words (a bounded list) travel to the tasks; all other words are joined
with their counts by shuffle, so the join has no hot key and its vocabulary no bound.

Defined results: a null text counts as empty and has the end token only; a null doc_id takes part in training; repeated rows
are scored alike; with no training text every probability is that of an unseen token; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moments.llm.common import save
from moments.llm.tokens import hashed_texts, mix, raw

END = np.uint64(0x5EED0F00D5EED0F1)


@dataclass(frozen=True)
class MaxentRules:
    #: At most so many words, the most frequent ones, have their counts sent to the tasks; all others are joined.
    frequent: int = 1 << 16
    own_forms: int = 1 << 14
    endings: int = 1 << 12
    classes: int = 64
    #: Columns of a histogram of neighbours: the most frequent words, and hashed endings for the rest.
    contexts: int = 64
    own_contexts: int = 48
    #: Buckets of the previous word: the most frequent words have one each, the rest one for each class and hash.
    own_previous: int = 3072
    previous: int = 4096
    trigrams: int = 4096
    rounds: int = 30
    rate: float = 0.5
    #: Strength of the Gaussian prior of each weight, in tokens.
    prior: float = 2.0
    fold: int = 5
    held_out: int = 1


def held_out(doc_id, rules: MaxentRules = MaxentRules()):
    text = F.coalesce(doc_id.cast("string"), F.lit(""))
    return F.crc32(text.cast("binary")) % rules.fold == rules.held_out


def _stream(texts: list[bytes], rules: MaxentRules):
    """For each slice of texts: (first text, word hashes with one end a text, end positions, endings)."""
    for first, h, counts, data, start, end in hashed_texts(texts):
        size = counts + 1
        stop = np.cumsum(size) - 1
        words = np.empty(int(size.sum()), "uint64")
        is_end = np.zeros(len(words), bool)
        is_end[stop] = True
        words[is_end] = END
        words[~is_end] = h
        tail = np.zeros(len(h), "uint64")
        for back in (1, 2, 3):
            tail = tail * np.uint64(256) + np.where(end - start >= back, data[np.maximum(end - back, 0)], 0).astype("uint64")
        ending = np.full(len(words), rules.endings)  # the end has one of its own
        ending[~is_end] = (mix(tail) % np.uint64(rules.endings)).astype("int64")
        yield first, words, stop, ending


class _Ranks:
    """Ranks of the frequent words, by a table of the low bits of their hashes; other words have none (-1)."""

    BITS = 19

    def __init__(self, words: np.ndarray):
        rank = np.argsort(words, kind="stable")
        self.words, self.rank = words[rank], rank
        low = (self.words & np.uint64((1 << self.BITS) - 1)).astype("int64")
        self.slots = np.full(1 << self.BITS, -1, "int32")
        self.slots[low] = np.arange(len(words))
        self.crowded = np.bincount(low, minlength=1 << self.BITS) > 1  # words that share a slot are searched

    def of(self, words: np.ndarray) -> np.ndarray:
        if not len(self.words):
            return np.full(len(words), -1)
        slot = (words & np.uint64((1 << self.BITS) - 1)).astype("int64")
        at = self.slots[slot].astype("int64")
        more = np.flatnonzero(self.crowded[slot])
        at[more] = np.minimum(np.searchsorted(self.words, words[more]), len(self.words) - 1)
        hit = (at >= 0) & (self.words[at] == words)
        return np.where(hit, self.rank[at], -1)


def _rows(names: list[str], *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(list(columns), names=names)


def _longs(x) -> pa.Array:
    return pa.array(np.asarray(x, "int64"))


def _blobs(rows: np.ndarray) -> pa.Array:
    """Rows of counts, each compressed by itself."""
    return pa.array([zlib.compress(np.ascontiguousarray(r, "int64").tobytes(), 1) for r in rows], pa.binary())


def _counts(blob: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(blob), "int64")


def word_counts(docs: DataFrame, rules: MaxentRules) -> DataFrame:
    """(word, ending, c) of all tokens; each task sends each of its words once for a run of about a million."""

    def scan(batches):
        keys, ends, counts, held = [], [], [], 0
        names = ["word", "ending", "n"]

        def packed():
            k, at, inverse = np.unique(np.concatenate(keys), return_index=True, return_inverse=True)
            return k, np.concatenate(ends)[at], np.bincount(inverse, weights=np.concatenate(counts)).astype("int64")

        for batch in batches:
            for _, words, _, ending in _stream(raw(batch.column("text")), rules):
                k, at, n = np.unique(words, return_index=True, return_counts=True)
                keys.append(k)
                ends.append(ending[at])
                counts.append(n)
                held += len(k)
            if held > 2_000_000:
                k, e, n = packed()
                keys, ends, counts, held = [k], [e], [n], len(k)
                if held > 1_000_000:
                    yield _rows(names, pa.array(k.view("int64")), _longs(e), _longs(n))
                    keys, ends, counts, held = [], [], [], 0
        if keys:
            k, e, n = packed()
            yield _rows(names, pa.array(k.view("int64")), _longs(e), _longs(n))

    found = docs.select("text").mapInArrow(scan, "word long, ending long, n long")
    return found.groupBy("word").agg(F.first("ending").alias("ending"), F.sum("n").alias("c"))


def _added(tables: DataFrame, width: int, parts: int = 64) -> DataFrame:
    """(key, counts): the rows of all tasks, added by key as they stream by, in two steps: each of the first adds a share of the tasks, so
    what meets in one of the second grows with ``parts`` and not with the number of tasks."""

    def add(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, blob in zip(batch.column("key").to_pylist(), batch.column("counts").to_pylist()):
                if k not in total:
                    total[k] = np.zeros(width, "int64")
                total[k] += _counts(blob)
        keys = sorted(total)
        yield _rows(["key", "counts"], _longs(keys), _blobs([total[k] for k in keys]))

    schema = "key long, counts binary"
    share = tables.withColumn("share", F.pmod(F.spark_partition_id(), F.lit(parts)))
    first = share.repartition("share", F.pmod("key", F.lit(8))).select("key", "counts").mapInArrow(add, schema)
    return first.repartition(8, "key").mapInArrow(add, schema)  # bounded: a row a key


def _form(rank: np.ndarray, ending: np.ndarray, rules: MaxentRules) -> np.ndarray:
    return np.where((rank >= 0) & (rank < rules.own_forms), rank, rules.own_forms + ending)


def neighbours(docs: DataFrame, ranks, rules: MaxentRules) -> DataFrame:
    """(key, counts): for each form (rank of a frequent word, or their number plus an ending) the contexts before and after it."""
    forms, width = rules.own_forms + rules.endings + 1, rules.contexts
    spare = width - rules.own_contexts

    def scan(batches):
        known, table = _Ranks(ranks.value), np.zeros((forms, width), "int32")
        for batch in batches:
            for _, words, _, ending in _stream(raw(batch.column("text")), rules):
                rank = known.of(words)
                form = _form(rank, ending, rules)
                context = np.where((rank >= 0) & (rank < rules.own_contexts), rank, rules.own_contexts + ending % spare)
                cell = np.concatenate([form[1:] * width + context[:-1], form[:-1] * width + context[1:]])
                at, n = np.unique(cell, return_counts=True)
                table.ravel()[at] += n.astype("int32")
        used = np.flatnonzero(table.any(axis=1))
        yield _rows(["key", "counts"], _longs(used), _blobs(table[used]))

    return docs.select("text").mapInArrow(scan, "key long, counts binary")


def clustered(keys: np.ndarray, table: np.ndarray, rules: MaxentRules, steps: int = 15) -> np.ndarray:
    """The class (1 or more) of each form, by k-means on the square roots of the shares of its neighbours; forms count by the
    square root of their tokens, so neither the few frequent nor the many rare ones decide alone."""
    out = np.ones(rules.own_forms + rules.endings + 1, "int64")
    out[-1] = 0
    if not len(keys):
        return out
    mass = table.sum(axis=1).astype("float64")
    x, weight = np.sqrt(table / np.maximum(mass, 1)[:, None]).astype("float32"), np.sqrt(mass)
    rng, k = np.random.default_rng(17), min(rules.classes - 1, len(keys))
    centres = [x[int(np.argmax(weight))]]
    far = ((x - centres[0]) ** 2).sum(axis=1)
    while len(centres) < k and (far * weight).sum() > 1e-9:
        centres.append(x[rng.choice(len(x), p=far * weight / (far * weight).sum())])
        far = np.minimum(far, ((x - centres[-1]) ** 2).sum(axis=1))
    c = np.array(centres)
    for _ in range(steps):
        near = np.argmax(2 * x @ c.T - (c**2).sum(axis=1), axis=1)
        for i in range(len(c)):
            mine = near == i
            if mine.any():
                c[i] = np.average(x[mine], axis=0, weights=weight[mine])
    out[keys] = near + 1
    out[-1] = 0
    return out


class _Histories:
    """Previous bucket, class before and class of every token of a slice."""

    def __init__(self, words: np.ndarray, classes: np.ndarray, rules: MaxentRules):
        self.known, self.classes, self.rules = _Ranks(words), classes, rules

    def of(self, words: np.ndarray, stop: np.ndarray, ending: np.ndarray):
        r = self.rules
        rank = self.known.of(words)
        cls = self.classes[_form(rank, ending, r)]
        spread = (r.previous - r.own_previous) // r.classes
        own = np.where(
            (rank >= 0) & (rank < r.own_previous), rank, r.own_previous + cls * spread + (mix(words) % np.uint64(spread)).astype("int64")
        )
        own[stop] = r.own_previous  # the end, which stands before every text: class 0
        p = np.concatenate([[r.own_previous], own[:-1]])
        b = np.concatenate([[0, 0], cls[:-2]])[: len(words)]
        first = np.concatenate([[0], stop[:-1] + 1])
        b[first] = 0  # nothing of the text before
        return rank, p, b, cls


def histories(docs: DataFrame, shared, rules: MaxentRules) -> DataFrame:
    """(key, counts): for each previous bucket its tokens by (class before, class)."""
    width = rules.classes * rules.classes

    def scan(batches):
        of, table = _Histories(*shared.value[:2], rules), np.zeros((rules.previous, width), "int32")
        for batch in batches:
            for _, words, stop, ending in _stream(raw(batch.column("text")), rules):
                _, p, b, c = of.of(words, stop, ending)
                at, n = np.unique((p * rules.classes + b) * rules.classes + c, return_counts=True)
                table.ravel()[at] += n.astype("int32")
        used = np.flatnonzero(table.any(axis=1))
        yield _rows(["key", "counts"], _longs(used), _blobs(table[used]))

    return docs.select("text").mapInArrow(scan, "key long, counts binary")


def _hashed_pair(p: np.ndarray, b: np.ndarray, rules: MaxentRules) -> np.ndarray:
    return (mix(p.astype("uint64") * np.uint64(1 << 20) + b.astype("uint64")) % np.uint64(rules.trigrams)).astype("int64")


def _log_softmax(x: np.ndarray) -> np.ndarray:
    x = x - x.max(axis=-1, keepdims=True)
    return x - np.log(np.exp(x).sum(axis=-1, keepdims=True))


class Maxent:
    """Weights by feature and class; their number is set by the rules, not by the corpus."""

    def __init__(self, rules: MaxentRules):
        self.rules, c = rules, rules.classes
        self.weights = [np.zeros((n, c), "float32") for n in (1, rules.previous, c, rules.trigrams)]

    def logits(self, p: np.ndarray, b: np.ndarray) -> np.ndarray:
        bias, wp, wb, wt = self.weights
        return bias[0] + wp[p] + wb[b] + wt[_hashed_pair(p, b, self.rules)]

    def gradient(self, p: np.ndarray, b: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Of the log-likelihood of the counts by class after each history, with respect to its logits."""
        return counts - counts.sum(axis=1, keepdims=True) * np.exp(_log_softmax(self.logits(p, b)))

    def log_table(self) -> np.ndarray:
        """log10 P(class | previous, before), by previous, before and class."""
        r = self.rules
        out = np.empty((r.previous, r.classes, r.classes), "float32")
        b = np.arange(r.classes)
        for p in range(r.previous):
            out[p] = _log_softmax(self.logits(np.full_like(b, p), b)) / np.log(10)
        return out.ravel()


def _mean_gradient(batches):
    """The sum of all rows (g, mass) a token, in an order that does not depend on how they come; no row where no token is."""
    rows = sorted((m, g) for b in batches for m, g in zip(b.column("mass").to_pylist(), b.column("g").to_pylist()))
    if mass := sum(m for m, _ in rows):
        flat = np.zeros(len(rows[0][1]) // 4)
        for _, g in rows:
            flat += np.frombuffer(g, "float32")
        yield _rows(["g", "mass"], pa.array([(flat / mass).astype("float32").tobytes()], pa.binary()), pa.array([mass]))


def train(tables: DataFrame, rules: MaxentRules) -> Maxent:
    """Gradient rounds with AdaGrad steps; at most 8 tasks sum the gradients of their histories, one more adds the sums, and the driver gets
    one row of the model's size a round."""
    model, r = Maxent(rules), rules
    squares = [np.zeros(w.shape) for w in model.weights]
    parts = tables.coalesce(8)  # read in as many parts as were written, at most 8
    for _ in range(rules.rounds):
        now = tables.sparkSession.sparkContext.broadcast(model)

        def part(batches, now=now):
            model = now.value
            grads = [np.zeros(w.shape) for w in model.weights]
            mass = 0.0
            for batch in batches:
                keys, blobs = batch.column("key").to_numpy(), batch.column("counts").to_pylist()
                for at in range(0, len(keys), 64):  # a few thousand histories at a time
                    counts = np.array([_counts(x) for x in blobs[at : at + 64]]).reshape(-1, r.classes)
                    rows = np.flatnonzero(counts.any(axis=1))
                    p, b = keys[at + rows // r.classes], rows % r.classes
                    g = model.gradient(p, b, counts[rows])
                    mass += float(counts.sum())
                    grads[0][0] += g.sum(axis=0)
                    for table, feature in zip(grads[1:], (p, b, _hashed_pair(p, b, r))):
                        order = np.argsort(feature, kind="stable")
                        names, first = np.unique(feature[order], return_index=True)
                        table[names] += np.add.reduceat(g[order], first, axis=0)
            flat = np.concatenate([g.ravel() for g in grads]).astype("float32")
            yield _rows(["g", "mass"], pa.array([flat.tobytes()], pa.binary()), pa.array([mass]))

        sums = parts.mapInArrow(part, "g binary, mass double").repartition(1)  # at most 8 rows of the model's size
        found = sums.mapInArrow(_mean_gradient, "g binary, mass double").first()
        now.destroy()
        if found is None:
            break
        mass, flat = found["mass"], np.frombuffer(found["g"], "float32").astype("float64")
        at = 0
        for w, s in zip(model.weights, squares):
            g = flat[at : at + w.size].reshape(w.shape) - rules.prior * w / mass
            at += w.size
            s += g * g
            w += (rules.rate * g / np.sqrt(s + 1e-16)).astype("float32")
    return model


@dataclass(frozen=True)
class Fitted:
    """What scoring needs beside the word counts: a bounded model."""

    words: np.ndarray
    classes: np.ndarray
    counts: np.ndarray
    model: Maxent
    #: What a known word gives up, and by class the log10 of the chance of an unseen word and of the whole mass.
    discount: float
    log_unseen: np.ndarray
    log_mass: np.ndarray
    tokens: int
    types: int


def most_frequent(counts: DataFrame, rules: MaxentRules) -> DataFrame:
    """The words of the highest counts, as many whole eighths of octaves of counts as hold at most ``frequent`` words."""
    of = F.floor(F.log2(F.col("c")) * 8)
    sizes = {r.b: r.n for r in counts.groupBy(of.alias("b")).agg(F.count(F.lit(1)).alias("n")).collect()}  # some hundred rows
    held, least = 0, None
    for b in sorted(sizes, reverse=True):
        held += sizes[b]
        if held > rules.frequent:
            break
        least = b
    return counts.filter(F.lit(False) if least is None else of >= least)


def fit(docs: DataFrame, counts: DataFrame, rules: MaxentRules) -> Fitted:
    """The model of the training texts ``docs`` with their word counts."""
    spark = docs.sparkSession
    total = counts.agg(
        F.sum("c").alias("n"), F.count(F.lit(1)).alias("v"), F.count_if(F.col("c") == 1).alias("once"), F.count_if(F.col("c") == 2).alias("twice")
    ).first()
    top = most_frequent(counts, rules).toPandas().sort_values(["c", "word"], ascending=[False, True])
    words, c = top["word"].to_numpy("int64").view("uint64"), top["c"].to_numpy("int64")
    ranks = spark.sparkContext.broadcast(words)
    near = _added(neighbours(docs, ranks, rules), rules.contexts).toPandas()  # at most a row for each form
    near = near.sort_values("key")
    table = np.array([_counts(x) for x in near["counts"]]).reshape(len(near), rules.contexts)
    classes = clustered(near["key"].to_numpy("int64"), table, rules)
    classes[np.flatnonzero(words[: rules.own_forms] == END)] = 0
    shared = spark.sparkContext.broadcast((words, classes))
    model = train(save(_added(histories(docs, shared, rules), rules.classes**2)), rules)

    # tokens and types of each class: the frequent words by themselves, all others by their ending
    tokens, types = np.zeros(rules.classes), np.zeros(rules.classes)
    ending = top["ending"].to_numpy("int64")
    own = classes[_form(np.arange(len(words)), ending, rules)]
    np.add.at(tokens, own, c)
    np.add.at(types, own, 1)
    ends = counts.groupBy("ending").agg(F.sum("c").alias("c"), F.count(F.lit(1)).alias("v")).toPandas()  # a row an ending
    by_ending = np.zeros((2, rules.endings + 1))
    at = ends["ending"].to_numpy("int64")
    by_ending[0, at], by_ending[1, at] = ends["c"], ends["v"]
    np.subtract.at(by_ending[0], ending, c)
    np.subtract.at(by_ending[1], ending, 1)
    np.add.at(tokens, classes[rules.own_forms :], by_ending[0])
    np.add.at(types, classes[rules.own_forms :], by_ending[1])
    # Ney's estimate; of the half that is added, so that a class without words has a chance too, all goes to the unseen
    discount = min(0.9, max(0.1, total["once"] / max(1, total["once"] + 2 * total["twice"])))
    log_unseen, log_mass = np.log10(discount * types + 0.5), np.log10(tokens + 0.5)
    log_unseen[0] = log_mass[0] = np.log10(max(tokens[0], 1) - discount)  # no other token ends a text
    return Fitted(words, classes, c, model, discount, log_unseen, log_mass, int(total["n"] or 0), int(total["v"] or 0))


def score(docs: DataFrame, rules: MaxentRules = MaxentRules()) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score), one row for each row of docs."""
    spark = docs.sparkSession
    training = docs.filter(~held_out(F.col("doc_id"), rules)).select("text")
    counts = save(word_counts(training, rules))
    fitted = fit(training, counts, rules)
    shared = spark.sparkContext.broadcast(fitted)
    schema = "doc_id long, n_tokens long, known long, logs double, model double, rare array<struct<word:long,c:int>>"
    kind = pa.struct([("word", pa.int64()), ("c", pa.int32())])

    def scan(batches):
        f = shared.value
        of, table = _Histories(f.words, f.classes, rules), f.model.log_table()
        base_log = np.append(np.log10(f.counts + 0.5), 0.0)  # rank -1, a word to be joined, adds nothing here
        own_log = np.append(np.log10(np.maximum(f.counts - f.discount, 1e-9)), 0.0)
        for batch in batches:
            texts = raw(batch.column("text"))
            out = [np.zeros(len(texts)) for _ in range(4)]
            left, lengths = [], []
            for first, tokens, stop, ending in _stream(texts, rules):
                begin = np.concatenate([[0], stop[:-1] + 1])
                rank, p, b, c = of.of(tokens, stop, ending)
                gained = table[(p * rules.classes + b) * rules.classes + c] + own_log[rank] - f.log_mass[c]
                for o, x in zip(out, (np.ones(len(tokens)), rank >= 0, base_log[rank], gained)):
                    o[first : first + len(stop)] = np.add.reduceat(x, begin)
                rare = rank < 0
                left.append((tokens[rare].view("int64"), c[rare].astype("int32")))
                lengths.append(np.add.reduceat(rare.astype("int64"), begin))
            ends = np.concatenate([[0], *lengths]).cumsum().astype("int32")
            names, of_class = (np.concatenate(x) for x in zip(*left)) if left else (np.zeros(0, "int64"), np.zeros(0, "int32"))
            both = pa.StructArray.from_arrays([pa.array(names), pa.array(of_class)], fields=list(kind))
            yield _rows(
                ["doc_id", "n_tokens", "known", "logs", "model", "rare"],
                batch.column("doc_id"), _longs(out[0]), _longs(out[1]), pa.array(out[2]), pa.array(out[3]),
                pa.ListArray.from_arrays(pa.array(ends), both),
            )

    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = save(keyed.mapInArrow(scan, schema).withColumn("row", F.monotonically_increasing_id()))
    unseen = F.get(F.array(*[F.lit(float(x)) for x in fitted.log_unseen]), F.col("of_class"))
    known = F.col("c").isNotNull()
    met = (
        rows.select("row", F.explode("rare").alias("x"))
        .groupBy("row", "x.word")
        .agg(F.count(F.lit(1)).alias("times"), F.min("x.c").alias("of_class"))
        .join(counts, "word", "left")
        .groupBy("row")
        .agg(
            F.sum(F.when(known, F.col("times")).otherwise(0)).alias("rare_known"),
            F.sum(F.col("times") * F.log10(F.coalesce("c", F.lit(0)) + 0.5)).alias("rare_logs"),
            F.sum(F.col("times") * F.when(known, F.log10(F.col("c") - fitted.discount)).otherwise(unseen)).alias("rare_model"),
        )
    )
    logs = F.col("logs") + F.coalesce("rare_logs", F.lit(0.0))
    base = float(np.log10(fitted.tokens + 0.5 * (fitted.types + 1)))
    return rows.drop("rare").join(met, "row", "left").select(
        "doc_id",
        held_out(F.col("doc_id"), rules).alias("held_out"),
        "n_tokens",
        (F.col("known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"),
        F.lit(fitted.tokens).cast("long").alias("train_tokens"),
        (logs - F.col("n_tokens") * base).alias("base_score"),
        (F.col("model") + F.coalesce("rare_model", F.lit(0.0))).alias("score"),
    )
