"""Repair of conversations: the cheapest edits that make roles alternate, found by iterative-deepening A*.

Rows meet by conversation in order, first as one letter each and then, in the same sorted stream, with their
texts: a task searches on letters and hashes or returns texts as they pass, so it never holds a conversation's texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLANKS = " \t\n\x0b\x0c\r"
#: Turns searched at a time; a longer conversation is searched in blocks from its end.
BLOCK = 64
DELETE, INSERT, REROLE, TRUNCATED = 3, 2, 2, 1

# What the repaired conversation ends with so far: nothing, system, user, assistant.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
NEVER = 1 << 60
#: Cost of stopping in each state at the conversation's end: empty, or an assistant has the last word.
END = (0, NEVER, NEVER, 0)


def kept_state(state: int, initial: str) -> int | None:
    """The state after a row whose role begins with `initial`, None where it may not stand."""
    if initial == "s":
        return SYSTEM if state == NOTHING else None
    if initial == "a":
        return ASSISTANT if state == USER else None
    return USER if initial == "u" and state != USER else None


def next_state(state: int) -> int:
    """The only one of user and assistant that may follow."""
    return ASSISTANT if state == USER else USER


@lru_cache(maxsize=100_000)
def search(rows: str, entry: int, ends: tuple[int, ...], last: bool) -> tuple[int, str, int]:
    """(cost, edits, state at the end) of the first path, in ASCII order, among the cheapest.

    `rows` has a letter a row: `d` must be deleted, else its initial (`x` for any but s, u and a), in upper case if
    the text is truncated. `ends` are the costs of what comes behind, by state; rows are inserted behind the last
    one only in the `last` block, as the next block inserts before its first. Depth-first search goes under a
    bound that grows by one; a state that failed with some budget is not entered again with no more.
    """
    n = len(rows)
    rest = [min(ends)] * (n + 1)  # what is still to be paid at least
    for i in range(n - 1, -1, -1):
        rest[i] = rest[i + 1] + (DELETE if rows[i] == "d" else TRUNCATED if rows[i].isupper() else 0)
    failed: dict[tuple[int, int], int] = {}
    path: list[str] = []

    def reach(i: int, state: int, budget: int) -> int | None:
        if rest[i] > budget or failed.get((i, state), -1) >= budget:
            return None
        if i == n and ends[state] <= budget:
            return state
        for edit, j, then, cost in edits(i, state):
            path.append(edit)
            end = reach(j, then, budget - cost)
            if end is not None:
                return end
            path.pop()
        failed[i, state] = budget
        return None

    def edits(i: int, state: int) -> Iterator[tuple[str, int, int, int]]:
        then = next_state(state)
        if i < n:
            yield "D", i + 1, state, DELETE
        if i < n or last:
            yield "I", i, then, INSERT
        if i < n and rows[i] != "d":
            more = TRUNCATED if rows[i].isupper() else 0
            kept = kept_state(state, rows[i].lower())
            if kept is not None:
                yield "K", i + 1, kept, more
            yield "R", i + 1, then, REROLE + more

    bound = rest[0]
    while (end := reach(0, entry, bound)) is None:
        bound += 1
    return bound, "".join(path), end


def cheapest_edits(rows: str) -> tuple[int, str]:
    """(cost, edits) of a whole conversation. Blocks are searched from the last to the first, each from every state
    that it may be entered in, with the costs that the next one found; their paths join to the first of the cheapest."""
    places = range(0, max(len(rows), 1), BLOCK)
    ends, found = END, []
    for a in reversed(places):
        found.append([search(rows[a:a + BLOCK], s, ends, a == places[-1]) for s in (range(4) if a else [NOTHING])])
        ends = tuple(x[0] for x in found[-1])
    state, out = NOTHING, []
    for block in reversed(found):
        _, edits, state = block[state]
        out.append(edits)
    return ends[0], "".join(out)


# ------------------------------------------------------------- rows


def damage(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, dropped: rows of a dialogue log as they might come in, damaged by a checksum of
    `conv_id:turn` modulo 20 (nulls: one space): 0 is dropped, 1 loses its text, 2 its `.!?`, 3 comes twice, 4 gets the role user."""
    def said(c: str) -> Column:
        return F.coalesce(F.col(c).cast("string"), F.lit(" "))

    kind = F.crc32(F.concat(said("conv_id"), F.lit(":"), said("turn")).cast("binary")) % 20
    one = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), said("role").alias("role"),
                               said("text").alias("text"), kind.alias("kind"))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    times = F.when(F.col("kind") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return one.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"),
                      (F.col("kind") == 0).alias("dropped"), F.explode(times).alias("copy")).drop("copy")


SUMMARY = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
TURNS = "conv_id long, place long, edit string, role string, text string"
#: The fault of a row, its first one.
SOUND, BLANK, DUPLICATE, SHORT, GONE = range(5)


def _stream(rows: DataFrame) -> DataFrame:
    """Letters of all rows of a conversation before their texts, both by turn, role and digest of the text."""
    dropped = F.col("dropped") if "dropped" in rows.columns else F.lit(False)
    keyed = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"),
                        F.coalesce("text", F.lit(" ")).alias("text"), dropped.alias("dropped")).withColumn("digest", F.unhex(F.sha2("text", 256)))
    seen = F.row_number().over(Window.partitionBy("conv_id", "role", "digest", "dropped").orderBy("turn")) > 1
    bare = F.rtrim("text", F.lit(BLANKS))
    tail = F.substring(bare, -1, 1)
    letters = keyed.select("conv_id", "turn", "role", "digest", "dropped", (bare == "").alias("empty"), tail.isin(".", "!", "?").alias("ended"))
    fault = (F.when(F.col("dropped"), GONE).when(F.col("empty"), BLANK).when(seen, DUPLICATE).when(~F.col("ended"), SHORT).otherwise(SOUND))
    facts = letters.select("conv_id", F.lit(0).alias("part"), "turn", "role", "digest", fault.alias("fault"), F.lit(None).cast("string").alias("text"))
    texts = keyed.where("not dropped").select("conv_id", F.lit(1).alias("part"), "turn", "role", "digest", F.lit(None).cast("int").alias("fault"), "text")
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return facts.unionByName(texts).repartition(n, "conv_id").sortWithinPartitions("conv_id", "part", "turn", "role", "digest").drop("digest")


class _Conversation:
    """One conversation as its sorted rows pass."""

    def __init__(self, conv_id: int | None, turns: bool):
        self.conv_id, self.turns, self.out = conv_id, turns, []
        self.letters, self.faults, self.illegal, self.before = bytearray(), [0] * 5, 0, None
        self.low = self.high = None
        self.distinct = 0
        self.audit = self.cost = None
        self.at, self.place, self.state, self.hash = 0, 0, NOTHING, hashlib.sha256()

    def fact(self, turn: int | None, role: str, fault: int) -> None:
        self.faults[fault] += 1
        if fault == GONE:
            return
        initial = role[:1]
        self.illegal += self.before is not None and self.before + initial not in ("su", "ua", "au")
        self.before = initial
        if turn is not None and turn != self.high:
            self.low, self.high, self.distinct = turn if self.low is None else self.low, turn, self.distinct + 1
        letter = initial if initial in ("s", "u", "a") else "x"
        self.letters += (b"d" if fault in (BLANK, DUPLICATE) else (letter.upper() if fault == SHORT else letter).encode())

    def _settle(self) -> None:
        if self.audit is None:
            self.cost, self.audit = cheapest_edits(self.letters.decode())

    def _say(self, edit: str, role: str, text: str) -> None:
        if self.turns:
            self.out.append((self.conv_id, self.place, edit, role, text))
        else:
            self.hash.update((b"\n" if self.place else b"") + f"{role}:{text}".encode())
        self.place += 1

    def _insert(self) -> None:
        while self.audit[self.at:self.at + 1] == "I":
            self.state = next_state(self.state)
            self._say("I", "assistant" if self.state == ASSISTANT else "user", "")
            self.at += 1

    def text(self, role: str, text: str) -> None:
        self._settle()
        self._insert()
        edit, self.at = self.audit[self.at], self.at + 1
        if edit == "K":
            self.state = kept_state(self.state, role[:1])
            self._say(edit, role, text)
        elif edit == "R":
            self.state = next_state(self.state)
            self._say(edit, "assistant" if self.state == ASSISTANT else "user", text)

    def close(self) -> list[tuple]:
        self._settle()
        self._insert()
        if self.turns:
            return self.out
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.distinct
        return [(self.conv_id, gaps, self.faults[BLANK], self.faults[DUPLICATE], self.faults[SHORT], self.illegal, self.cost, self.audit, self.hash.hexdigest())]


def _repair(turns: bool):
    names = [c.split()[0] for c in (TURNS if turns else SUMMARY).split(", ")]
    kinds = [pa.string() if c.endswith("string") else pa.int64() for c in (TURNS if turns else SUMMARY).split(", ")]

    def table(rows: list[tuple]) -> pa.RecordBatch:
        return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    def repair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, out = None, []
        for batch in batches:
            for conv_id, part, turn, role, fault, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "part", "turn", "role", "fault", "text"))):
                if now is None or now.conv_id != conv_id:
                    if now is not None:
                        out += now.close()
                    now = _Conversation(conv_id, turns)
                if part:
                    now.text(role, text)
                    if now.out:
                        out += now.out
                        now.out = []
                else:
                    now.fact(turn, role, fault)
                if len(out) >= 4096:
                    yield table(out)
                    out = []
        if now is not None:
            out += now.close()
        if out:
            yield table(out)

    return repair


def repair_conversations(rows: DataFrame) -> DataFrame:
    """SUMMARY, a row per conversation of `rows` (conv_id, turn, role, text and perhaps dropped); a null role or text is one space.

    Rows are taken by turn, those without one first, equal ones by role and then by SHA-256 of the text. A row's
    first fault counts: blank (no character but blanks), duplicate (role and text seen earlier), truncated (the
    last character but blanks is none of `.!?`). Edits: keep (0), rerole to user or assistant (2), delete (3, a must
    for blank and duplicate rows), insert an empty user or assistant row (2); a truncated row that is not deleted
    costs 1 more. The roles' initials shall be `(s?(ua)+)?`; an empty or null role has none of them. Of the cheapest edits those whose
    initials come first in ASCII order are `audit`. `gaps` are turns between the least and the greatest that no row has;
    `illegal` are neighbours other than su, ua and au. Rows marked `dropped` count for nothing, but their conversation
    is there: zeros, no edits and the hash of nothing if no row is left. A null conv_id is a conversation of its own;
    an empty table has none; other columns are ignored. A conversation passes one task, row by row, as its audit and its
    hash are one value each; the task holds its letters and edits.
    """
    return _stream(rows).mapInArrow(_repair(False), SUMMARY)


def repaired_turns(rows: DataFrame) -> DataFrame:
    """TURNS, the repaired conversations' rows in order: `edit` is K, R or I. See repair_conversations."""
    return _stream(rows).mapInArrow(_repair(True), TURNS)
