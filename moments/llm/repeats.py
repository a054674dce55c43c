"""Exact substring dedup by columns: the bytes of every string of ``LENGTH`` bytes that also starts elsewhere.

The order is built as in column-wise construction of the Burrows-Wheeler transform of a collection: each round puts one more symbol
before the string of every document, the symbols in the present order are the transform of that column, a stable sort by them is
the next order, and common prefixes follow from range minima over the column before. A string of ``LENGTH`` bytes is repeated
where a neighbour shares that many bytes. Rounds read one column after the other; nothing is searched.

What is inserted are not whole documents but their segments around anchors. The anchor of a string of ``LENGTH`` bytes is the
least hash of its ``GRAM``-byte grams (the leftmost), which depends on the string alone, so equal strings meet in segments of one anchor, aligned
at it: only equal columns can match, and a segment holds the strings that chose its anchor, about 135 of them, so the segments of
a document share out its strings. That cuts the collection into parts that are sorted apart, in as many tasks as there are, by
Spark's external sort: the segments of a part come as a sequential file, and a task holds up to ``CHUNK`` of them.

* Anchors that occur once hold nothing repeated. They are most, and their bytes are never sent.
* Segments that equal another one (128 bits of hash, and the anchor's place) are repeated as a whole; one of each class stays
  in the collection as the partner of others, so a passage in a third of all rows is one segment.
* An anchor with more than ``WIDE`` different segments (the edge of such a passage) would not fit a task. Its strings are counted
  one by one under 128 bits of hash, with partial sums before the shuffle, at any number of segments.

Heavy keys of the joins are at most 10,000 (each holds a ten thousandth of all anchors or more) and are joined by broadcast.

With ``words`` given, the same order of work also tells the words of every string of that many words that starts elsewhere: passages of
50 words can be shorter than ``LENGTH`` bytes. Symbols are then words (64 bits of hash), anchors the least hash of ``WORD_GRAM`` words, and the
segments of a part, again Spark's sorted rows, bring 128 bits of hash of each string, which a task sorts. It removes nothing.

Defined results: null and empty texts have no bytes; texts of under ``LENGTH`` bytes lose nothing; repeated rows and equal texts lose
everything if they are long enough; a run of one byte is its own repeat; overlapping matches count, also inside one text; the kept bytes may cut a character;
empty tables give no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from moments.llm.common import SPACE, save

LENGTH = 400
GRAM = 128
#: Strings of a block of bytes that are hashed at once: bounds the memory, whatever the length of a text.
BLOCK = 1 << 19
#: The words of a string, and of an anchor's gram, where passages are told by words.
WORDS = 50
WORD_GRAM = 10
CHUNK = 8_192
WIDE = 4_096
#: Segments or rows that a Python worker makes at once.
FEW = 1_000
ANCHORS = "array<struct<h:long,s:long,x:int,lo:int,hi:int,words:boolean>>"
SPANS = "array<struct<lo:int,hi:int>>"
_U = np.uint64
_SPACE = np.isin(np.arange(256), list(SPACE.encode()))


def _tables(seed: int) -> tuple[np.ndarray, int]:
    rnd = np.random.RandomState(seed)
    return rnd.randint(0, 2**63, 256, dtype="int64").astype(_U) * _U(2) + _U(1), int(rnd.randint(1, 2**62)) * 4 + 3


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    def run(b):
        out = np.full(n, b, _U)
        out[0] = 1
        return np.cumprod(out, dtype=_U)

    return run(base), run(pow(base, -1, 2**64))


class Rolling:
    """Hashes of any substring of a block of bytes, or of words' hashes, from running sums, modulo 2^64, and mixed."""

    def __init__(self, seed: int, most: int):
        self.codes, base = _tables(seed)
        self.up, self.down = _powers(base, most + 1)

    def sums(self, data: np.ndarray) -> np.ndarray:
        out = np.zeros(len(data) + 1, _U)
        np.cumsum((self.codes[data] if data.dtype == "uint8" else data) * self.down[: len(data)], out=out[1:])
        return out

    def at(self, sums: np.ndarray, start, stop) -> np.ndarray:
        return mixed((sums[stop] - sums[start]) * self.up[start])


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(32))) * _U(0xD6E8FEB86659FD93)
    x = (x ^ (x >> _U(32))) * _U(0xD6E8FEB86659FD93)
    return x ^ (x >> _U(32))


def sliding_least(keys: np.ndarray, width: int) -> np.ndarray:
    """The least of every width keys in a row: least from the left and from the right inside pieces of that width."""
    n = len(keys) - width + 1
    padded = np.full(-(-len(keys) // width) * width, np.iinfo(_U).max, _U)
    padded[: len(keys)] = keys
    piece = padded.reshape(-1, width)
    left = np.minimum.accumulate(piece, axis=1).ravel()
    right = np.minimum.accumulate(piece[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[:n], left[width - 1 : width - 1 + n])


def _bytes_of(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts of a column side by side, and where each begins."""
    wide = pa.types.is_large_string(array.type) or pa.types.is_large_binary(array.type)
    offsets = np.frombuffer(array.buffers()[1], "int64" if wide else "int32")[array.offset : array.offset + len(array) + 1].astype("int64")
    data = array.buffers()[2]
    data = np.frombuffer(data, "uint8") if data is not None else np.zeros(0, "uint8")
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of the words of texts side by side, and where the words of each begin. A word ends at its text's end too."""
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = ~_SPACE[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[offsets] = True
    starts = np.flatnonzero(inside[1:] & (cut | ~inside[:-1]))
    stops = np.flatnonzero(inside[:-1] & (cut | ~inside[1:]))
    out = np.zeros(len(starts), _U)
    edges = np.unique(np.append(np.searchsorted(starts, np.arange(0, len(data), BLOCK)), len(starts)))
    if len(starts):
        rolling = Rolling(5, int((stops[edges[1:] - 1] - starts[edges[:-1]]).max()))
    for i, j in zip(edges[:-1], edges[1:]):
        b = starts[i]
        out[i:j] = rolling.at(rolling.sums(data[b : stops[j - 1]]), starts[i:j] - b, stops[i:j] - b)
    return out, np.searchsorted(starts, offsets)


def segments(data: np.ndarray, offsets: np.ndarray, first: Rolling, second: Rolling, length: int, gram: int):
    """(text, h, s, x, lo, hi) of all segments: strings lo to hi of a text choose the anchor at x, whose gram hashes to h; s tells the
    segment's bytes."""
    width, low = length - gram + 1, _U((1 << 21) - 1)
    out = []
    for b in range(0, max(0, len(data) - length + 1), BLOCK):
        block = data[b : b + BLOCK + length - 1]
        n = len(block) - length + 1
        ends = offsets[1:][(offsets[1:] > b) & (offsets[1:] < b + len(block))] - b
        before = np.cumsum(np.bincount(ends, minlength=len(block)), dtype="int32")
        valid = np.flatnonzero(before[length - 1 : length - 1 + n] == before[:n])  # no text ends inside the string
        if not len(valid):
            continue
        one = first.sums(block)
        starts = np.arange(len(block) - gram + 1)
        h = first.at(one, starts, starts + gram)
        least = sliding_least((h & ~low) | starts.astype(_U), width)[valid]
        x = (least & low).astype("int64")
        new = np.flatnonzero((x[1:] != x[:-1]) | (valid[1:] != valid[:-1] + 1)) + 1
        head = np.concatenate([[0], new])
        lo, hi, x = valid[head], valid[np.concatenate([new - 1, [len(valid) - 1]])], x[head]
        two = second.sums(block)
        s = mixed(second.at(two, lo, hi + length) + mixed((hi - lo).astype(_U) * _U(1 << 20) + (x - lo).astype(_U)))
        text = np.searchsorted(offsets, lo + b, side="right") - 1
        shift = b - offsets[text]
        out.append((text, h[x].view("int64"), s.view("int64"), x + shift, lo + shift, hi + shift))
    return [np.concatenate(c) for c in zip(*out)] if out else [np.zeros(0, "int64")] * 6


def _anchored(length: int, gram: int, words: int | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        most = BLOCK + max(length, words or 0)
        first, second = Rolling(1, most), Rolling(2, most)
        for batch in (b.slice(k, FEW) for b in batches for k in range(0, b.num_rows, FEW)):
            data, offsets = _bytes_of(batch.column("text"))
            found = [*segments(data, offsets, first, second, length, gram)]
            kind = np.zeros(len(found[0]), bool)
            if words:
                more = segments(*word_hashes(data, offsets), first, second, words, min(words, WORD_GRAM))
                kind = np.concatenate([kind, np.ones(len(more[0]), bool)])
                found = [np.concatenate(c) for c in zip(found, more)]
                order = np.argsort(found[0], kind="stable")
                found, kind = [c[order] for c in found], kind[order]
                found[3][kind] = 0  # the place of the anchor is read for bytes only
            text, h, s, *places = found
            bounds = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=batch.num_rows))]).astype("int32")
            inner = pa.StructArray.from_arrays(
                [pa.array(h), pa.array(s), *[pa.array(p.astype("int32")) for p in places], pa.array(kind)], names=["h", "s", "x", "lo", "hi", "words"]
            )
            keep = [i for i, name in enumerate(batch.schema.names) if name != "text"]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(i) for i in keep], pa.ListArray.from_arrays(pa.array(bounds), inner)],
                names=[*[batch.schema.names[i] for i in keep], "anchors"],
            )

    return run


def column_runs(parts: list[tuple[bytes, int]], length: int = LENGTH) -> list[tuple[int, int, int]]:
    """(part, first, last): the strings of each part, by their start, that some other part has at the same distance from its anchor.
    parts: bytes and the place of the anchor in them.

    One round a column, from the last to the first: order holds the parts by what stands from the column on, common the bytes that each
    shares with the one before it."""
    m = len(parts)
    anchor = np.array([a for _, a in parts], "int64")
    size = np.array([len(b) for b, _ in parts], "int64")
    left, right = int(anchor.max()), int((size - anchor).max())
    columns = np.zeros((m, left + right), "uint8")
    for i, (body, a) in enumerate(parts):
        columns[i, left - a : left - a + len(body)] = np.frombuffer(body, "uint8")
    columns = np.ascontiguousarray(columns.T)
    begins, stops = left - anchor, left - anchor + size
    by_stop, by_begin = np.argsort(-stops, kind="stable"), np.argsort(-begins, kind="stable")
    entered = gone = 0
    order, common = np.zeros(0, "int64"), np.zeros(0, "uint16")
    hits = np.zeros((left + right + 1, m), bool)
    for col in range(left + right - 1, -1, -1):
        fresh = entered
        while entered < m and stops[by_stop[entered]] > col:
            entered += 1
        if entered > fresh:  # strings of no bytes yet come first
            order = np.concatenate([by_stop[fresh:entered], order])
            common = np.concatenate([np.zeros(entered - fresh, "uint16"), common])
        over = gone
        while gone < m and begins[by_begin[gone]] > col:
            gone += 1
        if gone > over:  # parts that begin right of the column leave; what a neighbour shares is the least over the gap
            stays = np.flatnonzero(begins[order] <= col)
            common = np.minimum.reduceat(common[: stays[-1] + 1], np.concatenate([[0], stays[:-1] + 1])) if len(stays) else common[:0]
            order = order[stays]
        if not len(order):
            continue
        transform = columns[col][order]
        to = np.argsort(transform, kind="stable")
        symbols = transform[to]
        shared = np.zeros(len(order), "uint16")
        same = np.flatnonzero(symbols[1:] == symbols[:-1]) + 1
        if len(same):
            shared[same] = 1 + range_least(common, to[same - 1] + 1, to[same])
        order, common = order[to], shared
        far = common >= length
        if far.any():
            hits[col, order[far]] = True
            hits[col, order[:-1][far[1:]]] = True
    del columns
    flat = hits.T.ravel()  # the last column is never hit: runs of two parts do not meet
    edge = np.flatnonzero(flat[1:] != flat[:-1]) + 1
    edge = np.concatenate([[0], edge]) if flat[0] else edge
    part, col = np.divmod(edge, left + right + 1)
    return [(int(i), int(a - begins[i]), int(b - begins[i] - 1)) for i, a, b in zip(part[::2], col[::2], col[1::2])]


def range_least(values: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """The least value of each range, ends included: two overlapping spans of a power of two."""
    span = last - first + 1
    level = np.frexp(span.astype("float64"))[1] - 1
    tables = [values]
    for k in range(int(level.max())):
        t = tables[-1]
        step = 1 << k
        tables.append(np.concatenate([np.minimum(t[:-step], t[step:]), t[-step:]]))
    flat, n = np.concatenate(tables), len(values)
    return np.minimum(flat[level * n + first], flat[level * n + last + 1 - (1 << level)])


def _cut(wide: bool, length: int):
    """Rows (h, row, lo, anchor, bytes) of the segments that need their bytes."""

    def told(out: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*out)) or [()] * 5
        return pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()))],
            names=["h", "row", "lo", "anchor", "body"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        for batch in batches:
            for row, text, need in zip(batch.column("row"), batch.column("text"), batch.column("need")):
                wanted = [s for s in need.as_py() if s["wide"] == wide]
                body = text.as_py() if wanted else b""
                for s in wanted:
                    out.append((s["h"], row.as_py(), s["lo"], s["x"] - s["lo"], body[s["lo"] : s["hi"] + length]))
                    if len(out) >= FEW:
                        yield told(out)
                        out = []
        yield told(out)

    return run


def _sorted_columns(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, last = [], None

        def flush():
            runs = column_runs([(b, a) for _, _, a, b in held], length)
            found = [(held[i][0], held[i][1] + p, held[i][1] + q) for i, p, q in runs]
            return pa.RecordBatch.from_arrays(
                [pa.array([r[i] for r in found], t) for i, t in enumerate((pa.int64(), pa.int32(), pa.int32()))], names=["row", "lo", "hi"]
            )

        for batch in batches:
            for h, *rest in zip(*[batch.column(c).to_pylist() for c in ("h", "row", "lo", "anchor", "body")]):
                if h != last and len(held) >= CHUNK:
                    yield flush()
                    held = []
                last = h
                held.append(rest)
        if held:
            yield flush()

    return run


def _cut_words(wide: bool, words: int):
    """Rows (h, row, lo, body) of the segments of words that need to be compared; body: 128 bits of hash of each of their strings."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = [Rolling(seed, BLOCK + words) for seed in (3, 4)]
        for batch in (b.slice(k, FEW) for b in batches for k in range(0, b.num_rows, FEW)):
            hashes, offsets = word_hashes(*_bytes_of(batch.column("text")))
            strings = np.zeros((max(0, len(hashes) - words + 1), 2), _U)
            for b in range(0, len(strings), BLOCK):
                block = hashes[b : b + BLOCK + words - 1]
                at = np.arange(len(block) - words + 1)
                for k, rolling in enumerate(both):
                    strings[b : b + len(at), k] = rolling.at(rolling.sums(block), at, at + words)
            sought = batch.column("sought")
            text, found = pc.list_parent_indices(sought), sought.flatten()
            chosen = pc.equal(found.field("wide"), wide)
            text, h, lo, hi = (c.filter(chosen).to_numpy(zero_copy_only=False) for c in (text, *map(found.field, ("h", "lo", "hi"))))
            n = hi.astype("int64") - lo + 1
            ends = np.cumsum(n)
            body = strings[np.repeat(offsets[text] + lo - (ends - n), n) + np.arange(n.sum())]
            bounds = np.concatenate([[0], ends * 16]).astype("int32")
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(h), batch.column("row").take(pa.array(text)), pa.array(lo),
                    pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(body))]),
                ],
                names=["h", "row", "lo", "body"],
            )

    return run


def _placed(row: list[int], lo: list[int], body: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, segment, at) of all strings of segments."""
    strings = np.frombuffer(b"".join(body), "int64").reshape(-1, 2)
    n = np.array([len(x) // 16 for x in body], "int64")
    return strings[:, 0], strings[:, 1], np.repeat(np.arange(len(n)), n), np.arange(len(strings)) + np.repeat(np.array(lo, "int64") - (np.cumsum(n) - n), n)


def _sorted_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(row, lo, hi): the strings of segments, sorted by anchor, that stand twice or more under their anchor."""
    held, last = [], None

    def flush():
        row, lo, body = zip(*held)
        a, b, segment, at = _placed(row, lo, body)
        order = np.lexsort((b, a))
        same = np.flatnonzero((a[order][1:] == a[order][:-1]) & (b[order][1:] == b[order][:-1]))
        hit = np.zeros(len(a), bool)
        hit[order[same]] = hit[order[same + 1]] = True
        joined = hit[1:] & hit[:-1] & (segment[1:] == segment[:-1])
        first, final = np.flatnonzero(hit & ~np.concatenate([[False], joined])), np.flatnonzero(hit & ~np.concatenate([joined, [False]]))
        columns = [np.array(row, "int64")[segment[first]], at[first].astype("int32"), at[final].astype("int32")]
        return pa.RecordBatch.from_arrays([*map(pa.array, columns)], names=["row", "lo", "hi"])

    for batch in batches:
        for h, *rest in zip(*[batch.column(c).to_pylist() for c in ("h", "row", "lo", "body")]):
            if h != last and len(held) >= CHUNK:
                yield flush()
                held = []
            last = h
            held.append(rest)
    if held:
        yield flush()


def _single_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (a, b, row, at), one for each string of a segment of words."""
    for batch in batches:
        row = batch.column("row").to_numpy()
        a, b, segment, at = _placed(row, batch.column("lo").to_pylist(), batch.column("body").to_pylist())
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(row[segment]), pa.array(at.astype("int32"))], names=["a", "b", "row", "at"])


def _single_strings(length: int):
    """Rows (a, b, row, at): 128 bits of hash of each string of a segment."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, second = Rolling(3, 2 * length), Rolling(4, 2 * length)
        for batch in batches:
            for row, lo, body in zip(batch.column("row").to_pylist(), batch.column("lo").to_pylist(), batch.column("body").to_pylist()):
                data = np.frombuffer(body, "uint8")
                at = np.arange(len(data) - length + 1)
                a, b = (r.at(r.sums(data), at, at + length).view("int64") for r in (first, second))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(a), pa.array(b), pa.array(np.full(len(at), row)), pa.array((at + lo).astype("int32"))], names=["a", "b", "row", "at"]
                )

    return run


def _kept(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(k, FEW) for b in batches for k in range(0, b.num_rows, FEW)):
            out = []
            for row, text, spans, more in zip(*[batch.column(c).to_pylist() for c in ("row", "text", "whole", "found")]):
                runs, kept, end = [], hashlib.sha256(), 0
                for x in sorted((*spans, *(more or ())), key=lambda x: x["lo"]):
                    if runs and x["lo"] <= runs[-1][1]:
                        runs[-1][1] = max(runs[-1][1], x["hi"] + length)
                    else:
                        runs.append([x["lo"], x["hi"] + length])
                for a, b in runs:
                    kept.update(text[end:a])
                    end = b
                kept.update(text[end:])
                out.append((row, sum(b - a for a, b in runs), len(runs), kept.hexdigest()))
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[i] for r in out], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.string()))],
                names=["row", "n_removed", "n_spans", "kept"],
            )

    return run


def met(left: DataFrame, right: DataFrame, keys: list[str], weight: str, least: float) -> DataFrame:
    """Inner join with a right side of single keys: those of weight least or more, which are few, by broadcast, the others by shuffle."""
    heavy = F.broadcast(right.filter(F.col(weight) >= least))
    light = left.join(heavy.select(*keys), keys, "left_anti").join(right.filter(F.col(weight) < least), keys)
    return left.join(heavy, keys).unionByName(light)


def _windows(spans: Column) -> Column:
    return F.aggregate(spans, F.lit(0).cast("long"), lambda a, x: a + (x.hi - x.lo + 1))


def _covered(spans: Column, words: int) -> Column:
    """The words of all strings lo to hi."""
    return F.aggregate(
        F.array_sort(spans), F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end")),
        lambda a, x: F.struct((a.n + F.greatest(F.lit(0), x.hi + words - F.greatest(a.end, x.lo))).alias("n"), F.greatest(a.end, x.hi + words).alias("end")),
        lambda a: a.n,
    )


def removed(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, wide: int = WIDE, words: int | None = None) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256), one row per row of docs; with words also n_passage_words, the words of strings of
    so many words that start elsewhere too."""
    text = F.coalesce("text", F.lit(""))
    known = docs.select("doc_id", F.octet_length(text).cast("long").alias("n_bytes"), F.sha2(text.cast("binary"), 256).alias("sha"), text.cast("binary").alias("text"))
    rows = known.withColumn("row", F.monotonically_increasing_id())
    kind = docs.schema["doc_id"].dataType.simpleString()
    table = save(rows.mapInArrow(_anchored(length, gram, words), f"doc_id {kind}, n_bytes long, sha string, row long, anchors {ANCHORS}"))
    all_ = table.filter(F.size("anchors") > 0).select("row", F.inline("anchors"))
    total = table.agg(F.sum(F.size("anchors"))).first()[0] or 0
    least = max(1000.0, total / 10_000)
    classes = all_.groupBy("h", "s").agg(F.count(F.lit(1)).alias("n"), F.min("row").alias("keeper"))
    anchors = classes.groupBy("h").agg(F.count(F.lit(1)).alias("d"), F.sum("n").alias("t")).filter("t > 1")
    shared = save(met(classes, anchors, ["h"], "d", least).filter("n > 1 OR d > 1").select("h", "s", "n", "d", "keeper"))
    place = F.struct("lo", "hi")
    need = F.struct("h", "x", "lo", "hi", (F.col("d") > wide).alias("wide"))
    alone = (F.col("d") > 1) & ((F.col("n") == 1) | (F.col("row") == F.col("keeper")))
    marks = (
        met(all_, shared, ["h", "s"], "n", least)
        .groupBy("row")
        .agg(
            F.collect_list(F.when(~F.col("words") & (F.col("n") > 1), place)).alias("whole"),
            F.collect_list(F.when(~F.col("words") & alone, need)).alias("need"),
            F.collect_list(F.when(F.col("words") & (F.col("n") > 1), place)).alias("phrases"),
            F.collect_list(F.when(F.col("words") & alone, F.struct("h", "lo", "hi", (F.col("d") > wide).alias("wide")))).alias("sought"),
        )
    )
    marks = save(marks.join(table.select("row", "doc_id", "sha", "n_bytes"), "row").withColumn("full", (F.size("whole") > 0) & (_windows(F.col("whole")) == F.col("n_bytes") - (length - 1))))
    partly = ~F.col("full") & ((F.size("whole") > 0) | (F.size("need") > 0))
    asked = marks.filter(partly | (F.size("need") > 0) | (F.size("sought") > 0)).withColumnRenamed("doc_id", "id").drop("n_bytes", "phrases")
    bodies = save(
        known.filter(F.col("n_bytes") >= min(length, 2 * (words or length) - 1)).select("doc_id", "sha", "text").join(asked, ["sha"]).filter(F.col("doc_id").eqNullSafe(F.col("id")))
        .select("row", "text", "whole", "need", "sought", "full")
    )
    cut = "h long, row long, lo int, anchor int, body binary"
    by_columns = (
        bodies.mapInArrow(_cut(False, length), cut).repartition("h").sortWithinPartitions("h")
        .mapInArrow(_sorted_columns(length), "row long, lo int, hi int")
    )
    string = "a long, b long, row long, at int"
    hashed = bodies.filter(F.exists("need", lambda x: x.wide)).mapInArrow(_cut(True, length), cut).mapInArrow(_single_strings(length), string)
    found = by_columns.unionByName(_often(hashed, least)).groupBy("row").agg(F.collect_list(place).alias("found"))
    part = bodies.filter(partly).select("row", "text", "whole").join(found, "row", "left")
    part = part.mapInArrow(_kept(length), "row long, n_removed long, n_spans long, kept string")
    whole = marks.filter("full").select("row", F.col("n_bytes").alias("n_removed"), F.lit(1).cast("long").alias("n_spans"), F.sha2(F.lit(""), 256).alias("kept"))
    out = (
        table.select("row", "doc_id", "n_bytes", "sha").join(part.unionByName(whole), "row", "left")
        .select(
            "row", "doc_id", "n_bytes", F.coalesce("n_removed", F.lit(0)).alias("n_removed"), F.coalesce("n_spans", F.lit(0)).alias("n_spans"),
            F.coalesce("kept", "sha").alias("kept_sha256"),
        )
    )
    if words:
        single = bodies.filter(F.size("sought") > 0).select("row", "text", "sought")
        cut = "h long, row long, lo int, body binary"
        sought = single.mapInArrow(_cut_words(False, words), cut).repartition("h").sortWithinPartitions("h").mapInArrow(_sorted_words, "row long, lo int, hi int")
        hashed = single.filter(F.exists("sought", lambda x: x.wide)).mapInArrow(_cut_words(True, words), cut).mapInArrow(_single_words, string)
        found = sought.unionByName(_often(hashed, least)).groupBy("row").agg(F.collect_list(place).alias("found"))
        told = marks.filter((F.size("phrases") > 0) | (F.size("sought") > 0)).select("row", "phrases").join(found, "row", "left")
        told = told.select("row", _covered(F.concat("phrases", F.coalesce("found", F.array().cast(SPANS))), words).alias("n_passage_words"))
        out = out.join(told, "row", "left").withColumn("n_passage_words", F.coalesce("n_passage_words", F.lit(0)))
    return out.drop("row")


def _often(hashed: DataFrame, least: float) -> DataFrame:
    """(row, lo, hi) of the strings that occur twice or more."""
    often = hashed.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return met(hashed, often, ["a", "b"], "n", least * 100).select("row", F.col("at").alias("lo"), F.col("at").alias("hi"))
