"""Where speech chunks begin and end, looked up in tables of speech runs and quiet stretches.

Spark partitions, orders and compresses the windows (operators.audio, streaming.segments); a `Tape` holds the
runs of some consecutive windows as sorted arrays and answers, for an open chunk, what ends it next.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

SILENT, HOLD, SPEECH = 0, 1, 2
FAR = 1 << 62


@dataclass(frozen=True)
class Rules:
    """Lengths in samples; defaults at 16 kHz."""

    window: int = 512
    threshold: float = 0.5
    neg_threshold: float = 0.35
    pad: int = 4_800
    min_silence: int = 24_000
    min_speech: int = 4_000
    max_len: int = 480_000
    min_pause: int = 1_600

    @property
    def reset_len(self) -> int:
        """A silent run this long leaves nothing open and no padding in reach, whatever came before."""
        return 2 * self.min_silence + 2 * self.pad


@dataclass(frozen=True)
class Open:
    """An open chunk: where it starts, its first speech (-1 behind a cap cut), and up to where windows are used."""

    start: int
    speech: int
    now: int


@dataclass(frozen=True)
class Chunk:
    n_start: int
    n_end: int
    cut_reason: str


class Tape:
    """Runs (start, end, kind) of consecutive windows on the grid at `origin`; positions are samples.

    A quiet stretch lies between two speech runs, from the first silent window on; windows between the thresholds
    neither begin nor end one. `led`: speech came before the first run.
    """

    def __init__(self, start, end, kind, rules: Rules, origin: int = 0, led: bool = False):
        start, end, kind = (np.asarray(x, np.int64) for x in (start, end, kind))
        self.rules, self.origin = rules, origin
        self.end = int(end[-1]) if len(end) else origin
        talk = kind == SPEECH
        self.speech_from = start[talk & ~np.append(False, talk[:-1])]
        self.speech_to = end[talk & ~np.append(talk[1:], False)]
        self.silent_from, self.silent_to = start[kind == SILENT], end[kind == SILENT]
        before = np.append(start[:1], self.speech_to) if led and len(kind) and not talk[0] else self.speech_to
        back = np.append(self.speech_from[len(self.speech_from) - len(before) + 1:], FAR)[:len(before)]
        first = np.append(self.silent_from, FAR)[np.searchsorted(self.silent_from, before)]
        self.quiet, self.back = first[first < back], back[first < back]
        closes = self._closing(self.quiet, self.back, self.quiet)
        self.closers = np.flatnonzero(closes < FAR)
        self.closes = closes[self.closers]

    def _grid(self, at):
        """The first window end at or after `at`."""
        w = self.rules.window
        return self.origin - (self.origin - at) // w * w

    def _closing(self, base, back, now):
        """End of the first silent window, later than `now` and before speech is `back`, that completes the silence from `base`."""
        need = np.maximum(base + self.rules.min_silence, now + 1)
        j = np.searchsorted(self.silent_to, need)
        begin = np.append(self.silent_from, FAR)[j]
        return np.where(begin < back, np.maximum(self._grid(need), begin + self.rules.window), FAR)

    def opening(self, now: int, floor: int) -> Open | None:
        """The chunk that the next speech opens, padded up to `floor`, the end of the last one."""
        k = int(np.searchsorted(self.speech_from, now))
        if k == len(self.speech_from):
            return None
        at = int(self.speech_from[k])
        return Open(max(at - self.rules.pad, floor), at, at + self.rules.window)

    def _heard(self, o: Open, by: int) -> bool:
        k = int(np.searchsorted(self.speech_to, o.start, "right"))
        return k < len(self.speech_to) and int(self.speech_from[k]) + self.rules.window <= by

    def _kept(self, o: Open, end: int, stop: int, by: int, reason: str) -> Chunk | None:
        good = self._heard(o, by) if o.speech < 0 else stop - o.speech >= self.rules.min_speech
        return Chunk(o.start, end, reason) if good and end > o.start else None

    def running(self, o: Open) -> int:
        """Index of the first quiet stretch that had not ended when `o` was last looked at."""
        return int(np.searchsorted(self.back, o.now - self.rules.window, "right"))

    def outcome(self, o: Open) -> tuple[Chunk | None, int, Open | None] | None:
        """(chunk, time, what follows: a chunk behind a cap cut or nothing), or None if the runs end before it is decided."""
        r = self.rules
        cap = max(o.now + r.window, int(self._grid(o.start + r.max_len)))
        i, at, base = self.running(o), FAR, 0
        if i < len(self.quiet):
            base = max(int(self.quiet[i]), o.start)
            at = int(self._closing(base, self.back[i], o.now))
            if at == FAR and (j := int(np.searchsorted(self.closers, i, "right"))) < len(self.closers):
                at, base = int(self.closes[j]), int(self.quiet[self.closers[j]])
        if at <= cap:
            return self._kept(o, base + r.pad, base, at, "silence"), at, None
        if self.end < cap:
            return None
        cut = self._cut(o, cap, i)
        return Chunk(o.start, cut, "cap"), cap, Open(cut, -1, cap)

    def _cut(self, o: Open, cap: int, running: int) -> int:
        """Middle of the longest pause of the chunk up to `cap`, the first of equals, else its greatest length."""
        r = self.rules
        part = slice(min(int(np.searchsorted(self.quiet, o.start)), running), int(np.searchsorted(self.quiet, cap - r.window, "right")))
        begin = np.maximum(self.quiet[part], o.start)
        size = np.minimum(self.back[part], cap) - begin
        size = np.where((size >= r.min_pause) & (begin + size // 2 > o.start), size, 0)
        if not size.any():
            return o.start + r.max_len
        k = int(np.argmax(size))
        return int(begin[k] + size[k] // 2)

    def last(self, o: Open, reason: str, n_end: int | None) -> Chunk | None:
        """The chunk that the end of the audio leaves, at `n_end` or before."""
        end = stop = self.end if n_end is None else min(n_end, self.end)
        i = self.running(Open(o.start, o.speech, self.end))
        if i < len(self.quiet) and self.quiet[i] < self.end:
            stop = max(int(self.quiet[i]), o.start)
            end = min(end, stop + self.rules.pad)
        return self._kept(o, end, stop, self.end, reason)


def chunks_of(tape: Tape, o: Open | None, now: int, floor: int) -> tuple[list[Chunk], Open | None, int, int]:
    """(chunks, what is left open, time, floor): all that the tape decides, from an open chunk or from `now` on."""
    out: list[Chunk] = []
    while o is not None or (o := tape.opening(now, floor)) is not None:
        got = tape.outcome(o)
        if got is None:
            break
        chunk, now, o = got
        if chunk is not None:
            out.append(chunk)
            floor = chunk.n_end
    return out, o, now, floor
