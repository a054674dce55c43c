"""Benchmark decontamination by q-gram lemma filtering with banded verification.

Benchmark items and texts are brought to one form: lower case, letters and digits only. An item of m characters that lies in
a text with at most k = floor(m * rate) edits shares at least t = m + 1 - q - k q of its q-grams with the text, and all of
them on diagonals (text position - item position) that differ by at most k (the q-gram lemma). So the shared q-grams are
counted in overlapping bands of diagonals, each 2 (k + 1) wide and half a band apart; bands with t or more are regions, and
each region is verified by an edit-distance computation that keeps only the band.

Long items are also cut into overlapping windows, which are found in the same way: a text that quotes a part of an item holds
every window inside that part. A quoted run of window + step - 1 characters always holds one. Items of fewer than ``min_chars``
characters count only where they start and end on word bounds of the text, since their letters may also occur inside other
words; in scripts written without spaces every character is a word. They are found by shorter q-grams, for which the lemma
still gives a bound, and those whose budget is 0 by a look-up of exactly their length.

The items are a bounded side: they are read in blocks of at most ``block_chars`` characters, windows included, and every block is held against
all texts. Texts are split between tasks by Spark and scanned whole, in slices of a bounded size that overlap by more than
the longest region.

Defined results: null and empty texts and items match nothing; an item gets a row for every region of a text that overlaps no
better one of that item (whole before window, fewer edits before more, then the earlier); repeated rows give repeated rows;
empty tables give no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moments.llm.common import free_name

_FORM = re.compile(r"[\W_]+")


@dataclass(frozen=True)
class LeakRules:
    rate: float = 0.08
    q: int = 8
    #: Shorter items match on word bounds only, by q-grams of ``short_q`` characters.
    min_chars: int = 40
    short_q: int = 6
    #: Characters of the windows of long items, and from one window to the next.
    window: int = 120
    step: int = 40
    block_chars: int = 8_000_000
    slice_chars: int = 1_000_000


def plain(text: str | None) -> str:
    return _FORM.sub("", (text or "").lower())


#: Scripts written without spaces: Thai and Lao, Burmese, Khmer, kana, Han.
_UNSPACED = [(0x0E00, 0x0EFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x3040, 0x30FF), (0x31F0, 0x31FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0xFF66, 0xFF9F), (0x20000, 0x3FFFF)]


def word_bounds(text: str | None) -> np.ndarray:
    """For each place of the plain form, from 0 to its length: whether a word of the text starts or ends there."""
    runs = _FORM.split((text or "").lower())
    ends = np.cumsum([len(x) for x in runs])
    bound = np.zeros(int(ends[-1]) + 1, bool)
    bound[0], bound[ends] = True, True
    codes = _codes("".join(runs))
    alone = np.zeros(len(codes), bool)
    for a, b in _UNSPACED:
        alone |= (codes >= a) & (codes <= b)
    bound[:-1] |= alone
    bound[1:] |= alone
    return bound


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), dtype="<u4")


def _grams(codes: np.ndarray, q: int) -> np.ndarray:
    """A 64-bit hash of each q-gram; every character is spread over the word before it is rotated in."""
    if len(codes) < q:
        return np.zeros(0, "uint64")
    c = (codes.astype("uint64") + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    n = len(c) - q + 1
    out = c[:n].copy()
    for i in range(1, q):
        out *= np.uint64(0x100000001B3)
        out ^= c[i : i + n]
    return out ^ (out >> np.uint64(31))


class _Index:
    """The q-grams of a block of items: a bit table for the first look, then sorted hashes with (item, position)."""

    BITS = 22
    #: Hits that are expanded by their items at a time.
    PART = 1 << 21

    def __init__(self, items: list[tuple[int, str]], rules: LeakRules, q: int):
        self.q, self.items = q, items
        self.codes = [_codes(x) for _, x in items]
        grams = [_grams(c, q) for c in self.codes]
        hashes = np.concatenate(grams) if grams else np.zeros(0, "uint64")
        which = np.repeat(np.arange(len(items)), [len(g) for g in grams])
        at = np.concatenate([np.arange(len(g)) for g in grams]) if grams else np.zeros(0, "int64")
        order = np.argsort(hashes, kind="stable")
        self.hashes, self.which, self.at = hashes[order], which[order], at[order]
        self.table = np.zeros(1 << self.BITS, dtype=bool)
        self.table[(self.hashes & np.uint64((1 << self.BITS) - 1)).astype("int64")] = True
        lengths = np.array([len(c) for c in self.codes], "int64")
        self.budget = (lengths * rules.rate).astype("int64")
        self.least = np.maximum(lengths + 1 - q - self.budget * q, 1)
        self.longest = int((lengths + 2 * self.budget).max()) if len(lengths) else 0

    def regions(self, grams: np.ndarray) -> Iterator[tuple[int, int]]:
        """(item, first diagonal of a band that holds enough shared q-grams)."""
        hits = np.flatnonzero(self.table[(grams & np.uint64((1 << self.BITS) - 1)).astype("int64")])
        if not len(hits):
            return
        lo = np.searchsorted(self.hashes, grams[hits], "left")
        count = np.searchsorted(self.hashes, grams[hits], "right") - lo
        hits, lo, count = hits[count > 0], lo[count > 0], count[count > 0]
        if not len(hits):
            return
        shift = 2 * self.longest  # keeps the numbers of bands positive
        keys, n = np.zeros(0, "int64"), np.zeros(0, "int64")
        done = 0
        while done < len(hits):  # a q-gram of very many items is taken in bounded parts, and so are many such q-grams
            upto = max(done + 1, int(np.searchsorted(np.cumsum(count[done:]), self.PART)) + done)
            h, l, c = hits[done:upto], lo[done:upto], count[done:upto]
            rows = np.repeat(l - np.concatenate([[0], np.cumsum(c)[:-1]]), c) + np.arange(c.sum())
            item, diagonal = self.which[rows], np.repeat(h, c) - self.at[rows]
            band = (diagonal + shift) // (self.budget[item] + 1)
            both = np.concatenate([item * (1 << 40) + band, item * (1 << 40) + band - 1])  # the two bands over each diagonal
            k, m = np.unique(both, return_counts=True)
            if len(keys):
                k, inverse = np.unique(np.concatenate([keys, k]), return_inverse=True)
                m = np.bincount(inverse, weights=np.concatenate([n, m])).astype("int64")
            keys, n, done = k, m, upto
        its = keys >> 40
        for k, i in zip(keys[n >= self.least[its]], its[n >= self.least[its]]):
            yield int(i), int((k & ((1 << 40) - 1)) * (self.budget[i] + 1) - shift)

    def inner(self, item: int, diagonal: int) -> tuple[int, int]:
        """Places that every region of the item in the band covers."""
        k = int(self.budget[item])
        return diagonal + 3 * k + 2, diagonal + len(self.codes[item]) - 2 * k

    def verified(self, said: str, text: np.ndarray, item: int, diagonal: int, bound: np.ndarray | None = None) -> tuple[int, int, int] | None:
        """(start, end, edits) of the item in the text with its diagonals in the band, if within the budget; with
        ``bound``, only from and to places that it marks."""
        k = int(self.budget[item])
        low, width = diagonal - k, 4 * k + 3
        pattern = self.codes[item]
        whole = said.find(self.items[item][1], max(0, low), max(0, low + width + len(pattern)))
        while whole >= 0 and bound is not None and not (bound[whole] and bound[whole + len(pattern)]):
            whole = said.find(self.items[item][1], whole + 1, max(0, low + width + len(pattern)))
        if whole >= 0:
            return whole, whole + len(pattern), 0
        # row i, column j stands for text position i + low + j; a path may start and end anywhere in the band
        col = np.arange(width)
        cost = np.zeros(width, "int32")
        start = low + col
        if bound is not None:
            cost[~_marked(bound, start)] = 1 << 20
        for i, c in enumerate(pattern):
            at = i + low + col
            inside = (at >= 0) & (at < len(text))
            same = np.zeros(width, bool)
            same[inside] = text[at[inside]] == c
            best, origin = cost + ~same, start
            up = np.append(cost[1:] + 1, 1 << 20)  # a character of the item is missing in the text
            better = up < best
            best, origin = np.where(better, up, best), np.where(better, np.append(start[1:], 0), origin)
            # characters of the text that the item lacks: a running minimum along the row
            run = np.minimum.accumulate(best - col)
            first = np.maximum.accumulate(np.where(best - col == run, col, 0))
            cost, start = run + col, origin[first]
        if bound is not None:
            cost = np.where(_marked(bound, len(pattern) + low + col), cost, 1 << 20)
        edits = int(cost.min())
        if edits > k:
            return None
        j = int(np.flatnonzero(cost == edits)[0])
        return max(0, int(start[j])), min(len(text), len(pattern) + low + j), edits


def _marked(bound: np.ndarray, at: np.ndarray) -> np.ndarray:
    inside = (at >= 0) & (at < len(bound))
    out = np.zeros(len(at), bool)
    out[inside] = bound[at[inside]]
    return out


class _Taken:
    """The regions of each item so far, none over another."""

    def __init__(self):
        self.by: dict[int, list[tuple[int, int, int]]] = {}

    def meets(self, item: int, start: int, end: int, edits: int | None = None) -> bool:
        """Whether a region of the item, of at most so many edits, has a place in common with start to end."""
        return any(start < e and s < end and (edits is None or n <= edits) for s, e, n in self.by.get(item, ()))

    def add(self, found: list[tuple[int, int, int, int]]) -> None:
        """(edits, start, end, item): the best first."""
        for edits, start, end, item in sorted(set(found)):
            if not self.meets(item, start, end):
                self.by.setdefault(item, []).append((start, end, edits))


class _Matcher:
    """A block of items: long ones whole, their windows, and short ones on word bounds."""

    def __init__(self, items: list[tuple[int, str]], rules: LeakRules):
        self.rules = rules
        long = [x for x in items if len(x[1]) >= rules.min_chars]
        short = [x for x in items if len(x[1]) < rules.min_chars]
        fuzzy = [x for x in short if int(len(x[1]) * rules.rate) and len(x[1]) >= rules.short_q]
        self.whole, self.parts = _Index(long, rules, rules.q), _Index([w for x in long for w in _windows(x, rules)], rules, rules.q)
        self.short = _Index(fuzzy, rules, rules.short_q)
        self.bounded = bool(short)
        self.exact: dict[int, dict[str, list[int]]] = {}
        for i, x in short:
            if not int(len(x) * rules.rate) or len(x) < rules.short_q:
                self.exact.setdefault(len(x), {}).setdefault(x, []).append(i)
        self.hashes = {n: np.unique(np.concatenate([_grams(_codes(x), n) for x in known])) for n, known in self.exact.items()}

    def _found(self, index: _Index, text: str, codes: np.ndarray, taken: _Taken, bound: np.ndarray | None) -> list:
        """All verified regions (edits, start, end, item id) of an index, but those over a region that goes before them."""
        out, best, step = [], _Taken(), self.rules.slice_chars
        for at in range(0, max(1, len(codes)) if index.items else 0, step):
            part = codes[at : at + step + index.longest + index.q]
            said = text if len(part) == len(text) else text[at : at + len(part)]
            near = None if bound is None else bound[at : at + len(part) + 1]
            for item, diagonal in index.regions(_grams(part, index.q)):
                name, (a, b) = index.items[item][0], index.inner(item, diagonal)
                if a < b and (taken.meets(name, a + at, b + at) or best.meets(name, a + at, b + at, 0)):
                    continue
                found = index.verified(said, part, item, diagonal, near)
                if found:
                    start, end, edits = found[0] + at, found[1] + at, found[2]
                    out.append((edits, start, end, name))
                    if edits == 0 and not best.meets(name, start, end):
                        best.by.setdefault(name, []).append((start, end, 0))
        return out

    def _looked_up(self, text: str, codes: np.ndarray, bound: np.ndarray) -> list:
        out = []
        for n, known in self.exact.items():
            at = np.flatnonzero(bound[: max(0, len(codes) - n + 1)] & bound[n:]) if len(codes) >= n else np.zeros(0, "int64")
            for i in at[np.isin(_grams(codes, n)[at], self.hashes[n])].tolist():
                out += [(0, i, i + n, item) for item in known.get(text[i : i + n], ())]
        return out

    def matches(self, said: str | None) -> list[tuple[int, int, int, int]]:
        """(item id, start, end, edits) over the plain form of a text: every region that overlaps no better one of its item."""
        text, taken = plain(said), _Taken()
        codes = _codes(text)
        taken.add(self._found(self.whole, text, codes, taken, None))
        taken.add(self._found(self.parts, text, codes, taken, None))
        if self.bounded:
            bound = word_bounds(said)
            taken.add(self._found(self.short, text, codes, taken, bound) + self._looked_up(text, codes, bound))
        return [(item, *region) for item, regions in sorted(taken.by.items()) for region in sorted(regions)]


def _windows(item: tuple[int, str], rules: LeakRules) -> list[tuple[int, str]]:
    last = len(item[1]) - rules.window
    starts = sorted({*range(0, last, rules.step), last}) if last > 0 else []
    return [(item[0], item[1][i : i + rules.window]) for i in starts]


def _blocks(benchmark: DataFrame, rules: LeakRules) -> Iterator[list[tuple[int, str]]]:
    """Blocks of items in plain form; only one block is held at a time."""
    block, size = [], 0
    for r in benchmark.select("item_id", "text").orderBy("item_id").toLocalIterator():
        x = plain(r["text"])
        if not x:
            continue
        held = len(x) + sum(len(w) for _, w in _windows((r["item_id"], x), rules))
        if block and size + held > rules.block_chars:
            yield block
            block, size = [], 0
        block.append((r["item_id"], x))
        size += held
    if block:
        yield block


def leaks(docs: DataFrame, benchmark: DataFrame, rules: LeakRules = LeakRules()) -> DataFrame:
    """(doc_id, item_id, start, end, edits): positions in the plain form of the text. No shuffle."""
    out_type = "doc_id long, item_id long, start long, end long, edits long"
    out = None
    for block in _blocks(benchmark, rules):
        shared = docs.sparkSession.sparkContext.broadcast(block)  # bounded by block_chars

        def scan(batches, shared=shared):
            index = _Matcher(shared.value, rules)
            for batch in batches:
                rows = [
                    (d, *m)
                    for d, t in zip(batch.column("doc_id").to_pylist(), batch.column("text"))
                    for m in index.matches(t.as_py())
                ]
                cols = list(zip(*rows)) if rows else [[]] * 5
                names = ["doc_id", "item_id", "start", "end", "edits"]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=names)

        found = docs.select("doc_id", "text").mapInArrow(scan, out_type)
        out = found if out is None else out.unionByName(found)
    return docs.sparkSession.createDataFrame([], out_type) if out is None else out


def drop_leaks(docs: DataFrame, benchmark: DataFrame, rules: LeakRules = LeakRules()) -> DataFrame:
    """docs without the documents that hold a benchmark item. Rows without doc_id are told apart by their text."""
    row = F.coalesce(F.col("doc_id"), F.xxhash64("text"))
    marked = docs.select(row.alias("doc_id"), "text")
    name = free_name(docs, "leak_row")
    found = leaks(marked, benchmark, rules).select(F.col("doc_id").alias(name)).distinct()
    return docs.join(found, row == F.col(name), "left_anti")
