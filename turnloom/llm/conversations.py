"""Conversation structure repair by a secondary-sorted stream.

``damage`` spoils rows in a repeatable way.  ``repair`` lays rows out by
conversation, the last turn first, and one pass of Python carries the state of a
dynamic program across Arrow batches: from each of four places in the pattern
``(s?(ua)+)?`` (nothing yet, after s, after u, after a) the least cost of what is
still to come.  Per row that leaves one byte: for each place the first edit of a
cheapest way on, the ASCII-least letter where several are cheapest.  Place and
letter name the next place, so at the first turn the bytes are followed forwards
and give audit and repaired rows.

A conversation of more than ``SPILL`` bytes of text is spilled in segments of
pointers and rows to the shared folder and read back segment by segment, so a
task never holds more than a segment, whatever the length of a conversation.
Earlier copies of a row lie ahead of such a stream: they are found beforehand by
partial minima per conversation and digest, and a row without text that marks a
later copy is sorted in front of it.  Texts are shuffled once.

Rows of one turn are ordered by the digest of role and text.  Edits: keep 0,
rerole to user or assistant 3, delete 4 (required for blank and duplicate rows),
insert an empty user or assistant row 3; a truncated row that stays adds 3.

Cases: a null conversation is one of its own; a null turn comes first and does
not count for gaps; a null role or text is one blank.  Repeated rows are
duplicates of the first.  A conversation without rows has zeros, an empty audit
and the hash of the empty text.  An empty table gives no rows.  Other columns of
the input are not touched.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnloom.llm.files import attempt_name, create, new_folder, open_read
from turnloom.llm.spread import join_groups

SPILL = 1 << 24
SPACE = " \t\n\x0b\x0c\r"
_PLAIN, _BLANK, _COPY, _CUT = range(4)  # first fault of a row
_START, _S, _U, _A = range(4)  # places in the pattern
_D, _I, _K, _R = range(4)  # edits in ASCII order
_NEXT = (_U, _U, _A, _U)  # where an inserted or reroled row leads
_KEEP = {(_START, "s"): _S, (_START, "u"): _U, (_S, "u"): _U, (_U, "a"): _A, (_A, "u"): _U}
_ROLE = {_U: b"user", _A: b"assistant"}
_AT_END = (0, 6, 3, 0)


def damage(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, present: rows spoiled by crc32 of ``conv_id:turn`` modulo 20 (nulls as one blank).

    0 drops a row (it stays as a row without ``present``, so that its
    conversation is known), 1 empties its text, 2 removes its ``[.!?]``, 3
    repeats it, 4 makes it the user's.
    """
    src = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit(" ")).alias("text"))
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    code = F.crc32(F.concat(name("conv_id"), F.lit(":"), name("turn")).cast("binary")) % 20
    text = F.when(F.col("code") == 1, "").when(F.col("code") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    times = F.explode(F.when(F.col("code") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("_time")
    return src.withColumn("code", code).select(
        "conv_id", "turn", F.when(F.col("code") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"),
        (F.col("code") != 0).alias("present"), times).drop("_time")


@lru_cache(maxsize=100_000)
def _step(initial: str, fault: int, after: tuple[int, ...]) -> tuple[tuple[int, ...], int]:
    """Least costs from each place before a row, given those behind it, and the row's byte of first edits."""
    late = 3 if fault == _CUT else 0
    ways: list[list[tuple[int, int]]] = []
    for place in range(4):
        ways.append([(4 + after[place], _D)])
        if fault not in (_BLANK, _COPY):
            ways[place].append((3 + late + after[_NEXT[place]], _R))
            if (to := _KEEP.get((place, initial))) is not None:
                ways[place].append((late + after[to], _K))
    cost = [min(w)[0] for w in ways]
    cost[_U], cost[_A] = min(cost[_U], 3 + cost[_A]), min(cost[_A], 3 + cost[_U])
    for place in range(4):
        ways[place].append((3 + cost[_NEXT[place]], _I))
    best = [min(w) for w in ways]
    return tuple(c for c, _ in best), sum(edit << 2 * place for place, (_, edit) in enumerate(best))


class Conversation:
    """One conversation, fed from its last row to its first."""

    def __init__(self, folder: str):
        self.folder, self.after, self.shift = folder, _AT_END, 0
        self.pointers, self.rows, self.held, self.segments = bytearray(), [], 0, []
        self.gone = [0, 0, 0, 0]
        self.illegal = self.turns = 0
        self.low = self.high = self.later = None

    def add(self, turn: int | None, role: str, text: str, fault: int) -> None:
        self.gone[fault] += 1
        initial = role[:1]
        if self.later is not None and initial + self.later not in ("su", "ua", "au"):
            self.illegal += 1
        self.later = initial
        if turn is not None and turn != self.low:
            self.low, self.turns = turn, self.turns + 1
            self.high = turn if self.high is None else self.high
        costs, pointer = _step(initial, fault, self.after)
        least = min(costs)
        self.after, self.shift = tuple(c - least for c in costs), self.shift + least
        self.pointers.append(pointer)
        pair = (role.encode("utf-8", "surrogatepass"), text.encode("utf-8", "surrogatepass"))
        self.rows.append(pair)
        self.held += len(pair[0]) + len(pair[1]) + 100
        if self.held >= SPILL:
            uri = f"{self.folder}/{attempt_name()}"
            with create(uri) as out:
                pickle.dump((bytes(self.pointers), self.rows), out)
            self.segments.append(uri)
            self.pointers, self.rows, self.held = bytearray(), [], 0

    def _forwards(self) -> Iterator[tuple[int, tuple[bytes, bytes]]]:
        yield from zip(reversed(self.pointers), reversed(self.rows), strict=True)
        self.rows = []
        for uri in reversed(self.segments):
            with open_read(uri) as src:
                pointers, rows = pickle.loads(src.read())
            yield from zip(reversed(pointers), reversed(rows), strict=True)
            system, path = fs.FileSystem.from_uri(uri)
            system.delete_file(path)

    def result(self) -> tuple:
        sha, audit, place, first = hashlib.sha256(), bytearray(), _START, True

        def put(role: bytes, text: bytes) -> None:
            nonlocal first
            sha.update((b"" if first else b"\n") + role + b":" + text)
            first = False

        for pointer, (role, text) in self._forwards():
            while (edit := pointer >> 2 * place & 3) == _I:
                audit += b"I"
                place = _NEXT[place]
                put(_ROLE[place], b"")
            audit += b"DIKR"[edit : edit + 1]
            if edit == _K:
                place = _KEEP[place, role[:1].decode("latin-1")]
                put(role, text)
            elif edit == _R:
                place = _NEXT[place]
                put(_ROLE[place], text)
        while place in (_S, _U):
            audit += b"I"
            place = _NEXT[place]
            put(_ROLE[place], b"")
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return (gaps, self.gone[_BLANK], self.gone[_COPY], self.gone[_CUT], self.illegal, self.after[_START] + self.shift,
                audit.decode(), sha.hexdigest())


_OUT = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
_SCHEMA = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def _stream(folder: str):
    def frame(rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=_OUT).astype({"conv_id": "Int64"})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now = at = marked = None
        ready = None  # a row whose fault is known only when the one before it in the conversation is seen

        def settle(before: tuple | None) -> None:
            nonlocal ready
            if ready is not None:
                key, turn, role, text, fault, copy = ready
                if fault != _BLANK and (copy or key == before):
                    fault = _COPY
                now.add(turn, role, text, fault)
                ready = None

        for pdf in batches:
            done = []
            columns = [pdf[c].tolist() for c in ("known", "conv", "kind", "dated", "turn", "sha", "role", "text", "fault")]
            for known, conv, kind, dated, turn, sha, role, text, fault in zip(*columns, strict=True):
                if at != (known, conv):
                    if now is not None:
                        settle(None)
                        done.append((at[1] if at[0] else None, *now.result()))
                    now, at, marked = Conversation(folder), (known, conv), None
                if kind == 2:
                    continue
                key = (dated, turn, sha)
                if kind == 0:
                    marked = key
                    continue
                settle(key)
                ready = (key, turn if dated else None, role, text, fault, key == marked)
            if done:
                yield frame(done)
        if now is not None:
            settle(None)
            yield frame([(at[1] if at[0] else None, *now.result())])

    return run


def _fault(text: Column) -> Column:
    """Blank or truncated, what a row's own text tells."""
    seen = F.rtrim(text, F.lit(SPACE))
    return F.when(seen == "", _BLANK).when(F.substring(seen, -1, 1).isin(".", "!", "?"), _PLAIN).otherwise(_CUT)


def repair(rows: DataFrame) -> DataFrame:
    """Faults, cost, audit and hash of the repaired rows of each conversation of conv_id, turn, role, text.

    Where there is a column ``present``, rows without it only name their conversation.
    """
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    here = F.coalesce(F.col("present"), F.lit(False)) if "present" in rows.columns else F.lit(True)
    turn = F.col("turn").cast("long")
    src = rows.select(
        F.col("conv_id").isNotNull().alias("known"), F.coalesce(F.col("conv_id").cast("long"), F.lit(0)).alias("conv"),
        turn.isNotNull().alias("dated"), F.coalesce(turn, F.lit(0)).alias("turn"), blank("role"), blank("text"),
        F.when(here, 1).otherwise(2).alias("kind"))
    src = src.withColumn("sha", F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256)))
    small = src.where("kind = 1").select("known", "conv", "sha", F.struct("dated", "turn").alias("at"))
    again = small.groupBy("known", "conv", "sha").agg(F.min("at").alias("first"), F.max("at").alias("last"), F.count("*").alias("n"))
    again = again.where("first < last").drop("last")
    later = join_groups(small, again, ["known", "conv", "sha"], "n", rows.count()).where("at > first").select("known", "conv", "sha", "at").distinct()
    marks = later.select(
        "known", "conv", F.lit(0).alias("kind"), "at.dated", "at.turn", "sha", F.lit("").alias("role"), F.lit("").alias("text"), F.lit(0).alias("fault"))
    full = src.select("known", "conv", "kind", "dated", "turn", "sha", "role", F.when(F.col("kind") == 1, F.col("text")).otherwise("").alias("text"),
                      _fault(F.col("text")).alias("fault"))
    laid = full.unionByName(marks).repartition("known", "conv").sortWithinPartitions(
        "known", "conv", F.desc("dated"), F.desc("turn"), F.desc("sha"), "kind")
    return laid.mapInPandas(_stream(new_folder(rows.sparkSession, "conversations")), _SCHEMA)
