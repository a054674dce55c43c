"""Conversation structure repair: faults and cheapest edits of each conversation, by streaming over its sorted turns.

Rows are repartitioned by conversation and sorted by turn; ``mapInPandas`` reads them as one stream and carries the state of the
conversation at hand over Arrow batches: counts, and for each of four states of the wanted order (nothing, s, a user turn, an
assistant turn) the least cost, its rank among the states by audit, and the running hash of the repaired text. No text is kept.
What each state came from is one byte a row and state. The bytes of a conversation are kept up to ``spill_rows`` rows; those of
longer ones leave the task as rows of the written result, block by block, and a second stream reads the blocks of such a
conversation backwards and turns them into its audit, so memory does not grow with a conversation but for digests of the
different messages seen (16 bytes each), which tell repeats.

Two edits with as many rows behind them are never prefixes of one another (an insert belongs to the row that follows), so their
order holds whatever follows: the least audit follows from the ranks of the four states and the last edit alone.

Defined results: a null role or text counts as one space, in the checksum a null conv_id or turn too; null conv_ids are one
conversation; a turn that is null comes first and is left out of gaps; rows of one turn stand by role, then text; repeated rows
are rows; a role without characters leaves the order as it is; empty tables give no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moments.llm.common import SPACE, save

SPILL_ROWS = 65_536
#: States of the order s?(ua)+ : nothing yet, s, after a user, after an assistant. Where a role leads, and where one may end.
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
WANTED = {START: "user", SYSTEM: "user", USER: "assistant", ASSISTANT: "user"}
ENDS = (START, ASSISTANT)
LEGAL = ("su", "ua", "au")
RANKED = {c: i for i, c in enumerate("DIKR")}
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: More inserts in a row than two come back to a state that fewer reach.
MOST_INSERTS = 2


def damaged(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text after the damage that the checksum of conv_id and turn decides; dropped rows keep a mark."""
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    luck = F.crc32(F.concat(said("conv_id"), F.lit(":"), said("turn")).cast("binary")) % 20
    text = F.when(luck == 1, "").when(luck == 2, F.translate(said("text"), ".!?", "")).otherwise(said("text"))
    return rows.select(
        "conv_id",
        "turn",
        F.when(luck == 4, "user").otherwise(said("role")).alias("role"),
        text.alias("text"),
        F.explode(F.when(luck == 0, F.array(F.lit(0))).when(luck == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("copy"),
    )


def runs_from(state: int) -> list[tuple[int, int, str]]:
    """(inserts, state after them, roles inserted) from a state."""
    out, roles = [(0, state, [])], []
    for n in range(1, MOST_INSERTS + 1):
        roles = [*roles, WANTED[state]]
        state = NEXT[state, WANTED[state][0]]
        out.append((n, state, roles))
    return out


INSERTS = {s: runs_from(s) for s in range(4)}


class Repair:
    """The state of one conversation while its rows pass by."""

    def __init__(self):
        self.n = self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.turns, self.least, self.most, self.last_turn = 0, None, None, None
        self.seen, self.last = set(), None
        self.live = {START: (0, 0, hashlib.sha256(), True)}  # cost, rank by audit, hash of the repaired rows, no row yet
        self.back = array("B")

    def add(self, turn: int | None, role: str, text: str) -> None:
        if turn is not None and turn != self.last_turn:
            self.turns, self.last_turn, self.most = self.turns + 1, turn, turn
            self.least = turn if self.least is None else self.least
        initial, body = role[:1], text.strip(SPACE)
        if self.last is not None and self.last + initial not in LEGAL:
            self.illegal += 1
        self.n, self.last = self.n + 1, initial
        mark = hashlib.blake2b(f"{len(role)}:{role}:{text}".encode(), digest_size=16).digest()
        again, must_go, extra = mark in self.seen, False, 0
        self.seen.add(mark)
        if not body:
            self.blank, must_go = self.blank + 1, True
        elif again:
            self.duplicate, must_go = self.duplicate + 1, True
        elif body[-1] not in ".!?":
            self.truncated, extra = self.truncated + 1, TRUNCATED
        self._step(role, text, initial, must_go, extra)

    def _step(self, role, text, initial, must_go, extra):
        best = {}
        for state, (cost, rank, _, _) in self.live.items():
            for inserts, at, _ in INSERTS[state]:
                spent = cost + INSERT * inserts
                ways = [("D", at, DELETE)]
                if not must_go:
                    to = at if not initial else NEXT.get((at, initial))
                    if to is not None:
                        ways.append(("K", to, extra))
                    ways.append(("R", NEXT[at, WANTED[at][0]], REROLE + extra))
                for edit, to, price in ways:
                    key = (spent + price, rank, "I" * inserts + edit)
                    if to not in best or key < best[to][0]:
                        best[to] = (key, state, inserts, at, edit)
        order = {s: i for i, s in enumerate(sorted(best, key=lambda s: best[s][0][1:]))}
        live = {}
        for to in range(4):
            if to not in best:
                self.back.append(255)
                continue
            key, state, inserts, at, edit = best[to]
            digest, none_yet = self.live[state][2].copy(), self.live[state][3]
            for r in INSERTS[state][inserts][2]:
                none_yet = _said(digest, none_yet, r, "")
            if edit != "D":
                none_yet = _said(digest, none_yet, role if edit == "K" else WANTED[at], text)
            live[to] = (key[0], order[to], digest, none_yet)
            self.back.append(state | inserts << 2 | RANKED[edit] << 4)
        self.live = live

    def end(self) -> dict:
        """The sums, the state that the audit ends in, and the inserts after the last row."""
        best = None
        for state, (cost, rank, digest, none_yet) in self.live.items():
            for inserts, at, roles in INSERTS[state]:
                if at in ENDS:
                    key = (cost + INSERT * inserts, rank, inserts)
                    if best is None or key < best[0]:
                        best = (key, state, inserts, digest, none_yet, roles)
        key, state, inserts, digest, none_yet, roles = best
        digest = digest.copy()
        for r in roles:
            none_yet = _said(digest, none_yet, r, "")
        gaps = 0 if self.least is None else self.most - self.least + 1 - self.turns
        return {
            "gaps": gaps, "blank": self.blank, "duplicate": self.duplicate, "truncated": self.truncated, "illegal": self.illegal,
            "cost": key[0], "state": state, "tail": "I" * inserts, "repaired_sha256": digest.hexdigest(),
        }


def _said(digest, none_yet: bool, role: str, text: str) -> bool:
    digest.update(("" if none_yet else "\n").encode() + f"{role}:{text}".encode())
    return False


def walked(back: bytes, state: int) -> tuple[str, int]:
    """The edits of a block of rows that ends in a state, and the state before it."""
    edits = []
    for row in range(len(back) // 4 - 1, -1, -1):
        code = back[4 * row + state]
        edits.append("I" * (code >> 2 & 3) + "DIKR"[code >> 4])
        state = code & 3
    return "".join(reversed(edits)), state


SUMS = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long"
STREAMED = f"conv_id long, block long, back binary, audit string, state int, {SUMS}, repaired_sha256 string"
EMPTY = {k: None for k in re.findall(r"(\w+) ", STREAMED)}


def streamed(spill_rows: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, repair, block = None, None, 0

        def finish():
            end = repair.end()
            state, tail = end.pop("state"), end.pop("tail")
            row = EMPTY | end | {"conv_id": at[0], "block": block, "state": state}
            if block == 0:
                return row | {"audit": walked(repair.back.tobytes(), state)[0] + tail}
            return row | {"back": repair.back.tobytes(), "audit": tail}

        for batch in batches:
            out = []
            turns, ids = batch["turn"].tolist(), batch["conv_id"].tolist()
            for conv, has_conv, turn, has_turn, role, text, copy in zip(
                ids, batch["has_conv"], turns, batch["has_turn"], batch["role"], batch["text"], batch["copy"]
            ):
                key = (int(conv) if has_conv else None,)
                if key != at:
                    if repair:
                        out.append(finish())
                    at, repair, block = key, Repair(), 0
                if copy:
                    repair.add(int(turn) if has_turn else None, role, text)
                    if len(repair.back) >= 4 * spill_rows:
                        out.append(EMPTY | {"conv_id": at[0], "block": block, "back": repair.back.tobytes()})
                        repair.back, block = array("B"), block + 1
            if out:
                yield _frame(out)
        if repair:
            yield _frame([finish()])

    return run


def _frame(rows: list[dict]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=list(EMPTY))
    for c, kind in re.findall(r"(\w+) (long|int)", STREAMED):
        out[c] = out[c].astype("Int64" if kind == "long" else "Int32")
    return out


def _backwards(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Blocks of long conversations, the last first, as pieces of their audits."""
    at, state = None, START
    for batch in batches:
        out = []
        for conv, has_conv, block, back, tail, known in zip(batch["conv_id"], batch["has_conv"], batch["block"], batch["back"], batch["audit"], batch["state"]):
            key = (conv if has_conv else None,)
            if key != at:
                at, state = key, int(known)
            edits, state = walked(back, state)
            out.append((key[0], block, edits + (tail or "")))
        frame = pd.DataFrame(out, columns=["conv_id", "block", "piece"])
        frame["conv_id"] = frame["conv_id"].astype("Int64")
        yield frame


def repaired(rows: DataFrame, spill_rows: int = SPILL_ROWS) -> DataFrame:
    """One row per conv_id of rows: its faults, the cost and initials of its cheapest edits, and the hash of what they give."""
    known = (F.coalesce(F.col("conv_id"), F.lit(0)).alias("conv_id"), F.col("conv_id").isNotNull().alias("has_conv"))
    turns = (F.coalesce(F.col("turn"), F.lit(0)).alias("turn"), F.col("turn").isNotNull().alias("has_turn"))
    sorted_ = (
        damaged(rows.select("conv_id", "turn", "role", "text"))
        .select(*known, *turns, "role", "text", "copy")
        .repartition("has_conv", "conv_id")
        .sortWithinPartitions("has_conv", "conv_id", "has_turn", "turn", "role", "text", "copy")
    )
    found = save(sorted_.mapInPandas(streamed(spill_rows), STREAMED))
    last = found.filter("repaired_sha256 IS NOT NULL")
    names = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    short = last.filter("block = 0").select("conv_id", *names, "audit", "repaired_sha256")
    long = last.filter("block > 0").select("conv_id", *names, "repaired_sha256")
    pieces = (
        found.filter("back IS NOT NULL")
        .select(*known, "block", "back", "audit", "state")
        .repartition("has_conv", "conv_id")
        .sortWithinPartitions("has_conv", "conv_id", F.col("block").desc())
        .mapInPandas(_backwards, "conv_id long, block long, piece string")
        .groupBy("conv_id")
        .agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("block", "piece"))), lambda x: x.piece), "").alias("audit"))
        .withColumnRenamed("conv_id", "long_id")
    )
    met = long.join(pieces, F.col("conv_id").eqNullSafe(F.col("long_id"))).select("conv_id", *names, "audit", "repaired_sha256")
    return short.unionByName(met)
