"""Speech chunks from a stream of voice-activity segments, per (device, run, epoch).

State is typed: one row of positions, the runs since the open chunk's start, and the segments behind a gap. Its size is
bounded by the longest chunk and by what may arrive while a gap is open, whatever the age of the stream.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.speech import HOLD, SILENT, SPEECH, Open, Rules, Tape, chunks_of

OUT = ("device_id string, run_id string, epoch bigint, kind string, n_start bigint, n_end bigint, cut_reason string")
HEAD = "mark bigint, at bigint, start bigint, speech bigint, now bigint, floor bigint, seen bigint"
RUN = "lo bigint, hi bigint, kind int"
WAITING = "first_idx bigint, probs array<double>, ends string, n_end bigint, at bigint"


@dataclass
class Segment:
    first_idx: int
    probs: list[float]
    ends: str | None = None
    n_end: int | None = None
    at: int | None = None  # when it arrived, ms


@dataclass
class Chain:
    """What a key has come to.

    `mark`: window up to which all is final, None before the first. `at`: window that continues the live chain, None
    without one. `runs`: (lo, hi, kind) in samples since the open chunk's start, none while nothing is open.
    """

    mark: int | None = None
    at: int | None = None
    open: Open | None = None
    floor: int = 0
    runs: list[tuple[int, int, int]] = field(default_factory=list)
    waiting: list[Segment] = field(default_factory=list)

    def first_seen(self) -> int | None:
        """When the first of the waiting segments arrived, which is when the gap before them was seen."""
        return min((s.at for s in self.waiting if s.at is not None), default=None)

    def take(self, arrivals: list[Segment], rules: Rules, idle: bool = False, seen_by: int | None = None) -> list[tuple]:
        """Use what has arrived, in position order; rows out: (kind, n_start, n_end, cut_reason).

        A gap waits until the key is `idle` or the gap was seen (`at`) by `seen_by`; it then ends the chain, as idleness
        ends an open chunk. A segment behind the chain, or behind the mark, is reported as late, for a refill.
        """
        out: list[tuple] = []
        self.waiting = sorted(self.waiting + arrivals, key=lambda s: (s.first_idx, -len(s.probs)))
        while self.waiting:
            seg = self.waiting[0]
            due = self.at if self.at is not None else self.mark
            if due is not None and seg.first_idx < due:
                out.append(("late", seg.first_idx * rules.window, (seg.first_idx + len(seg.probs)) * rules.window, None))
            elif due is not None and seg.first_idx > due and not (idle or self._gap_is_final(seen_by)):
                return out
            elif self.at is not None and seg.first_idx > self.at:
                out += self._end(rules, "shutdown", None)
                continue
            else:
                out += self._use(seg, rules)
            self.waiting.pop(0)
        if idle:
            out += self._end(rules, "shutdown", None)
        return out

    def _gap_is_final(self, seen_by: int | None) -> bool:
        seen = self.first_seen()
        return seen_by is not None and seen is not None and seen <= seen_by

    def _tape(self, rules: Rules) -> Tape:
        lo, hi, kind = zip(*self.runs) if self.runs else ((), (), ())
        return Tape(lo, hi, kind, rules, led=self.open is not None and self.open.speech < 0)

    def _use(self, seg: Segment, rules: Rules) -> list[tuple]:
        w, p = rules.window, np.asarray(seg.probs)
        if self.at is None:
            self.at, self.floor, self.open, self.runs = seg.first_idx, seg.first_idx * w, None, []
        start = self.at * w
        kind = np.where(p >= rules.threshold, SPEECH, np.where(p < rules.neg_threshold, SILENT, HOLD))
        cuts = [0, *(np.flatnonzero(kind[1:] != kind[:-1]) + 1).tolist(), len(kind)]
        for a, b in zip(cuts, cuts[1:]):
            if a < b:
                lo = self.runs.pop()[0] if self.runs and self.runs[-1][2] == kind[a] else start + a * w
                self.runs.append((lo, start + b * w, int(kind[a])))
        self.at += len(p)
        tape = self._tape(rules)
        found, self.open, _, self.floor = chunks_of(tape, self.open, start, self.floor)
        self._forget(tape, rules)
        out = [("chunk", c.n_start, c.n_end, c.cut_reason) for c in found]
        if seg.ends:
            out += self._end(rules, seg.ends, seg.n_end)
        return out

    def _forget(self, tape: Tape, rules: Rules) -> None:
        """Runs before the open chunk go; of a quiet stretch that began before it one window stays."""
        if self.open is None:
            self.runs = []
            return
        at = self.open.start
        quiet = bool(((tape.quiet < at) & (tape.back > at)).any())
        self.runs = [r for r in self.runs if r[1] > max(at, self.open.speech)]
        if quiet and self.runs and (self.runs[0][2] == HOLD or self.runs[0][0] == at):
            self.runs.insert(0, (self.runs[0][0] - rules.window, self.runs[0][0], SILENT))

    def _end(self, rules: Rules, reason: str, n_end: int | None) -> list[tuple]:
        """The chain is over: what is open closes, and the mark moves to its end."""
        last = self._tape(rules).last(self.open, reason, n_end) if self.open is not None else None
        if self.at is not None:
            self.mark = self.at
        self.at, self.open, self.runs = None, None, []
        return [("chunk", last.n_start, last.n_end, last.cut_reason)] if last is not None else []


class ChunkProcessor(StatefulProcessor):
    """`Chain` in typed state, with a timer for the next gap or the key's idleness."""

    def __init__(self, rules: Rules, idle_ms: int, late_ms: int):
        self.rules, self.idle_ms, self.late_ms = rules, idle_ms, late_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.head = handle.getValueState("head", HEAD)  # stays: the mark tells late segments at any age
        self.runs = handle.getListState("runs", RUN, self.late_ms)
        self.waiting = handle.getListState("waiting", WAITING, self.late_ms)

    def _load(self) -> tuple[Chain, int | None]:
        if not self.head.exists():
            return Chain(), None
        mark, at, start, speech, now, floor, seen = self.head.get()
        runs = [tuple(r) for r in self.runs.get()] if self.runs.exists() else []
        waiting = [Segment(r[0], list(r[1]), r[2], r[3], r[4]) for r in self.waiting.get()] if self.waiting.exists() else []
        return Chain(mark, at, None if start is None else Open(start, speech, now), floor, runs, waiting), seen

    def _save(self, c: Chain, seen: int, now: int) -> None:
        o = c.open
        self.head.update((c.mark, c.at, *((o.start, o.speech, o.now) if o else (None, None, None)), c.floor, seen))
        for state, rows in ((self.runs, c.runs), (self.waiting, [(s.first_idx, [float(p) for p in s.probs], s.ends, s.n_end, s.at) for s in c.waiting])):
            if rows:
                state.put(rows)
            else:
                state.clear()
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        since = [s for s in (c.first_seen(), seen if c.at is not None or c.waiting else None) if s is not None]
        if since:
            self.handle.registerTimer(max(min(since) + self.idle_ms, now + 1))

    def _rows(self, key, out: list[tuple]) -> Iterator[pd.DataFrame]:
        if out:
            frame = pd.DataFrame([(*key, *row) for row in out], columns=[c.split()[0] for c in OUT.split(", ")])
            yield frame.astype({"n_start": "Int64", "n_end": "Int64"})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentProcessingTimeInMs()
        chain, _ = self._load()
        arrivals = [Segment(int(r.first_idx), [float(p) for p in r.probs], r.ends if isinstance(r.ends, str) else None,
                            None if pd.isna(r.n_end) else int(r.n_end), now) for pdf in rows for r in pdf.itertuples(index=False)]
        out = chain.take(arrivals, self.rules, False, now - self.idle_ms)
        self._save(chain, now, now)
        yield from self._rows(key, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentProcessingTimeInMs()
        chain, seen = self._load()
        out = chain.take([], self.rules, seen is not None and now - seen >= self.idle_ms, now - self.idle_ms)
        self._save(chain, now if seen is None else seen, now)
        yield from self._rows(key, out)

    def close(self) -> None:
        pass


def chunk_stream(segments: DataFrame, rules: Rules | None = None, idle_ms: int = 120_000, late_ms: int = 86_400_000) -> DataFrame:
    """Chunks and late notices of a stream of segments.

    `segments`: device_id, run_id, epoch, first_idx, probs (array of double, windows on the epoch's
    grid), ends (discontinuity or shutdown on the last one, else NULL), n_end. A gap that was visible for `idle_ms` is
    final even while the device goes on recording; a key without input for `idle_ms` is final. The rest of a key's
    state lives `late_ms` at most; its mark stays, so that what arrives later still is late. The session needs the
    RocksDB state store (see session.RUNTIME_CONF).
    """
    return segments.groupBy("device_id", "run_id", "epoch").transformWithStateInPandas(
        ChunkProcessor(rules or Rules(), idle_ms, late_ms), OUT, "Append", "ProcessingTime")
