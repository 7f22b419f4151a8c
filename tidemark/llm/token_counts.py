"""Token counts by compiled transducers, without building the tokens.

Two deterministic transducers annotate their transitions with what they emit:

* `PARTS` reads classes of characters and emits 1 where a pre-token begins. It has nine states. A text is
  cut in chunks; each chunk's state map (entry state to exit state, nine entries) is computed for all
  chunks in step, maps are composed by a parallel prefix scan, and with its entry state known each chunk
  is read once more for its emissions.
* `Merges` reads bytes of a pre-token and emits the change in the number of tokens. Its state holds, for
  each place where a token of the vocabulary may still be under way, the node of the vocabulary's trie
  reached from there, the token that ends there and the count there relative to now. The last token of a
  prefix is the only one that ends it and forms a valid pair with the token before it, so the next state
  and the emission depend on state and byte alone. States are compiled as they are met and kept in a
  table for the worker's life; a full table is started anew, which changes no result. Pre-tokens run
through the table in step, in lanes, and each distinct one once.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import pre_tokenizers

from . import bpe
from .storage import as_text
from .text import rows_of, span_hashes

#: Bytes of text that are counted together.
SLICE = 1 << 21

LIMIT = 512
CHUNK, LANE = 64, 96
#: States of the merge transducer (about 0.6 KB of table and 0.5 KB of keys each) and counted pre-tokens
#: (10 bytes each) that a worker keeps before it starts them anew.
MOST_STATES, MOST_PARTS = 220_000, 4_000_000
#: Larger sets of tokens below a trie node are taken to hold one that fits.
MOST_BELOW = 48

# classes: letter, number, other, apostrophe before one or two letters of a contraction, white space
# (blank or not) inside a run and at its end before something else
L, N, O, A1, A2, MID, BLANK, WHITE, PAD = range(9)
START, IN_L, IN_N, IN_O, IN_SPACE, AFTER_BLANK, NEED1, NEED2, ENDED = range(9)


@cache
def _parts() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Next state by state * 9 + class, what it emits, and next state by (state * 9 + class) * 9 + class,
    of the fixed byte-level pattern. PAD leaves every state."""
    step, emit = np.zeros((9, 9), np.uint8), np.ones((9, 9), np.uint8)
    for s in range(9):
        for c, own in ((L, IN_L), (N, IN_N), (O, IN_O)):
            step[s, c], emit[s, c] = own, s not in (own, AFTER_BLANK)
        for c, own in ((A1, NEED1), (A2, NEED2)):  # a contraction only where a pre-token begins
            inside = s in (IN_O, AFTER_BLANK)
            step[s, c], emit[s, c] = (IN_O, 0) if inside else (own, 1)
        step[s, MID], emit[s, MID] = IN_SPACE, s != IN_SPACE
        step[s, BLANK], step[s, WHITE] = AFTER_BLANK, ENDED
        step[s, PAD], emit[s, PAD] = s, 0
    step[NEED2, L], emit[NEED2, L] = NEED1, 0
    step[NEED1, L], emit[NEED1, L] = ENDED, 0
    return step.reshape(-1), emit.reshape(-1), step[step].reshape(-1)


_KNOWN = np.full(0x110000, 255, np.uint8)


def _kinds(points: np.ndarray) -> np.ndarray:
    """L, N, O, and for white space MID, of code points, as the library's pre-tokenizer parts them."""
    kind = _KNOWN[points]
    if (kind == 255).any():
        parts = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True).pre_tokenize_str
        for p in np.unique(points[kind == 255]).tolist():
            starts = [span[0] for _, span in parts(f"a{chr(p)}1")]
            _KNOWN[p] = MID if len(parts(f"!{chr(p)}!")) > 1 and 1 in starts and chr(p).isspace() else L if 1 not in starts else N if 2 not in starts and p != 32 else O
        kind = _KNOWN[points]
    return kind


def part_starts(points: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Flags of the characters where a pre-token begins. `begins`: where a text of its own begins."""
    n = len(points)
    kind = _kinds(points)
    space = kind == MID
    last = np.zeros(n, bool)
    last[np.append(begins[1:], n)[np.append(begins[1:], n) > 0] - 1] = True
    follow = np.zeros(n, bool)  # white space with something else after it in its text
    follow[:-1] = space[:-1] & ~space[1:]
    follow &= ~last
    kind[follow] = np.where(points[follow] == 32, BLANK, WHITE)
    for i in np.flatnonzero(points == 39).tolist():
        after = 0 if last[i] else 1 if i + 1 >= n - 1 or last[i + 1] else 2
        a = chr(points[i + 1]) if after else ""
        b = chr(points[i + 2]) if after > 1 else ""
        if a in ("s", "t", "m", "d"):
            kind[i] = A1
        elif a + b in ("re", "ve", "ll"):
            kind[i] = A2
    step, emit, step2 = _parts()
    # chunks never cross texts; the rest of a text's last chunk is padding
    sizes = np.diff(np.append(begins, n))
    per = -(-sizes // CHUNK)
    first = np.cumsum(per) - per
    total = int(per.sum())
    text_of = np.repeat(np.arange(len(begins)), per)
    within = np.arange(total) - first[text_of]
    place = np.arange(n) + np.repeat(first * CHUNK - begins, sizes)
    seen = np.full(total * CHUNK, PAD, np.uint8)
    seen[place] = kind
    seen = np.ascontiguousarray(seen.reshape(total, CHUNK).T)
    pairs = seen[0::2].astype(np.uint16) * 9 + seen[1::2]
    maps = np.broadcast_to(np.arange(9, dtype=np.uint16)[:, None], (9, total)).copy()
    for both in pairs:
        maps *= 81
        maps += both
        maps = step2[maps].astype(np.uint16)
    # prefix scan: compose each chunk's map with those before it in its text
    reach = 1
    while reach <= int(within.max(initial=0)):
        has = np.flatnonzero(within >= reach)
        maps[:, has] = np.take_along_axis(maps[:, has], maps[:, has - reach].astype(np.int64), axis=0)
        reach *= 2
    state = np.zeros(total, np.uint16)
    later = np.flatnonzero(within > 0)
    state[later] = maps[START, later - 1]
    flags = np.zeros((CHUNK, total), np.uint8)
    for k in range(CHUNK):
        key = state * 9 + seen[k]
        flags[k] = emit[key]
        state = step[key].astype(np.uint16)
    return flags.T.reshape(-1)[place].astype(bool)


class Merges:
    """The merge transducer of a vocabulary, compiled as far as its input has needed it."""

    def __init__(self, tok: bpe.Bpe):
        self.merges = tok.merges
        self.node: dict[int, int] = {}  # trie: node * 256 + byte
        self.token: list[int] = [-1]  # of each trie node
        self.below: list[list[int]] = [[]]  # tokens that go on from a node, as far as MOST_BELOW
        for t, i in tok.ranks.items():
            at, path = 0, []
            for b in t:
                path.append(at)
                key = at << 8 | b
                if key not in self.node:
                    self.node[key] = len(self.token)
                    self.token.append(-1)
                    self.below.append([])
                at = self.node[key]
            self.token[at] = i
            for node in path:
                if len(self.below[node]) <= MOST_BELOW:
                    self.below[node].append(i)
        split = {m: pair for pair, m in tok.merges.items()}
        # a token's first (last) parts from the token itself down to its byte, each with its rank and the
        # rank of the merge that takes it up
        self.first, self.last = ({}, {})
        for i in tok.ranks.values():
            for out, side in ((self.first, 0), (self.last, 1)):
                spine, up, x = [], 1 << 30, i
                while True:
                    spine.append((x, x if x in split else -1, up))
                    if x not in split:
                        break
                    up, x = x, split[x][side]
                out[i] = spine
        self.pairs: dict[int, bool] = {}
        self.lives: dict[int, bool] = {}
        self.clear()

    def clear(self) -> None:
        # a place under way: (trie node from there, token that ends there or -1 at the beginning, count there - count now)
        self.states: list[tuple] = [((0, -1, 0),)]
        self.number = {self.states[0]: 0}
        self.column = np.full(256, -1, np.int32)  # bytes get a column of the table when first met
        self.step = np.full((1024, 32), -1, np.int32)
        self.emit = np.zeros((1024, 32), np.int8)

    def columns(self, data: np.ndarray) -> np.ndarray:
        """The column of each byte."""
        new = np.flatnonzero((np.bincount(data, minlength=256) > 0) & (self.column < 0))
        self.column[new] = int(self.column.max()) + 1 + np.arange(len(new))
        self.byte = {int(c): b for b, c in enumerate(self.column.tolist()) if c >= 0}
        while self.column.max() >= self.step.shape[1]:
            self.step = np.concatenate([self.step, np.full_like(self.step[:, :32], -1)], axis=1)
            self.emit = np.concatenate([self.emit, np.zeros_like(self.emit[:, :32])], axis=1)
        return self.column[data]

    def _pair(self, a: int, b: int) -> bool:
        """Do a and b stay apart side by side? Merges run by rank, and a merge's rank is above its parts',
        so the last part of a and the first part of b at any rank are known; a merge of the two at its rank
        would win over a later one on either side, and over an equal one to its right."""
        key = a << 20 | b
        if (got := self.pairs.get(key)) is None:
            got = True
            for x, x_rank, x_up in self.last[a]:
                for y, y_rank, y_up in self.first[b]:
                    m = self.merges.get((x, y))
                    if m is not None and x_rank < m < x_up and y_rank < m <= y_up:
                        got = False
            self.pairs[key] = got
        return got

    def _alive(self, node: int, token: int) -> bool:
        """Can any token that goes on from the node stand after `token`?"""
        below = self.below[node]
        if not below or token < 0 or len(below) > MOST_BELOW:
            return bool(below)
        key = node << 20 | token
        if (got := self.lives.get(key)) is None:
            got = self.lives[key] = any(self._pair(token, t) for t in below)
        return got

    def compile(self, state: int, column: int) -> None:
        moved, end, byte = [], None, self.byte[column]
        for node, token, count in self.states[state]:
            to = self.node.get(node << 8 | byte)
            if to is None:
                continue
            moved.append((to, token, count))
            t = self.token[to]
            if end is None and t >= 0 and (token < 0 or self._pair(token, t)):
                end = (t, count + 1)
        t, emit = end
        key = (*((to, token, count - emit) for to, token, count in moved if self._alive(to, token)), (0, t, 0))
        if key not in self.number:
            self.number[key] = len(self.states)
            self.states.append(key)
            if len(self.states) > len(self.step):
                self.step = np.concatenate([self.step, np.full_like(self.step, -1)])
                self.emit = np.concatenate([self.emit, np.zeros_like(self.emit)])
        self.step[state, column], self.emit[state, column] = self.number[key], emit

    def run(self, data: np.ndarray, fresh: np.ndarray) -> np.ndarray:
        """What each byte emits; `fresh` flags the bytes where a pre-token begins, the first one among them."""
        n = len(data)
        out = np.zeros(n, np.int16)
        if not n:
            return out
        if len(self.states) > MOST_STATES:
            self.clear()
        data = self.columns(data)
        edges = np.flatnonzero(fresh)
        starts = edges[np.unique(np.searchsorted(edges, np.arange(0, edges[-1] + 1, LANE)))]
        ends = np.append(starts[1:], n)
        order = np.argsort(starts - ends, kind="stable")  # longest first, so running lanes are a prefix
        at, left = starts[order], (ends - starts)[order]
        state = np.zeros(len(at), np.int32)
        live, k = len(at), 0
        while live > 4:
            b = data[at[:live] + k]
            s = np.where(fresh[at[:live] + k], 0, state[:live])
            to = self.step[s, b]
            if (to < 0).any():
                for key in np.unique((s[to < 0].astype(np.int64) << 8) | b[to < 0]).tolist():
                    if self.step[key >> 8, key & 255] < 0:
                        self.compile(key >> 8, key & 255)
                to = self.step[s, b]
            out[at[:live] + k] = self.emit[s, b]
            state[:live] = to
            k += 1
            live = int(np.searchsorted(-left, -k, "left"))
        for i in range(live):  # the few longest lanes, such as giant pre-tokens
            s = int(state[i])
            for p in range(int(at[i]) + k, int(at[i] + left[i])):
                s = 0 if fresh[p] else s
                b = int(data[p])
                if self.step[s, b] < 0:
                    self.compile(s, b)
                out[p] = self.emit[s, b]
                s = int(self.step[s, b])
        return out


class Counter:
    """Tokens of pre-tokens. Each distinct one (by a 64-bit hash) runs through the transducer once."""

    def __init__(self, path: str):
        self.merges = Merges(bpe.load(path))
        self.hashes, self.counts = np.zeros(0, np.uint64), np.zeros(0, np.int32)

    def count(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Tokens of the pre-tokens data[start:end]."""
        h = span_hashes(data, starts, ends)
        distinct, sample, which = np.unique(h, return_index=True, return_inverse=True)
        at = np.searchsorted(self.hashes, distinct)
        got = np.zeros(len(distinct), np.int32)
        known = np.zeros(len(distinct), bool)
        inside = at < len(self.hashes)
        known[inside] = self.hashes[at[inside]] == distinct[inside]
        got[known] = self.counts[at[known]]
        new = np.flatnonzero(~known)
        if len(new):
            s, n = starts[sample[new]], (ends - starts)[sample[new]]
            first = np.cumsum(n) - n
            fresh = np.zeros(int(n.sum()), bool)
            fresh[first] = True
            emits = self.merges.run(data[np.arange(len(fresh)) + np.repeat(s - first, n)], fresh)
            got[new] = np.add.reduceat(emits, first, dtype=np.int64)
            if len(self.hashes) > MOST_PARTS:
                self.hashes, self.counts = distinct, got
            else:
                self.hashes = np.insert(self.hashes, at[new], distinct[new])
                self.counts = np.insert(self.counts, at[new], got[new])
        return got[which]


@cache
def _counter(path: str) -> Counter:
    return Counter(path)


def count_tokens(data: np.ndarray, offsets: np.ndarray, path: str) -> np.ndarray:
    """Tokens of each text of a slice."""
    tok, n = bpe.load(path), len(offsets) - 1
    extra = np.zeros(n, np.int64)
    if not len(data):
        return extra
    begins, hidden = set(offsets[:-1][np.diff(offsets) > 0].tolist()), []
    raw = data.tobytes()
    for special in tok.special:  # a token of its own that parts the text
        mark, p = special.encode(), raw.find(special.encode())
        while p >= 0:
            row = int(np.searchsorted(offsets, p, "right")) - 1
            if p + len(mark) <= offsets[row + 1]:
                extra[row] += 1
                hidden.append((p, p + len(mark)))
                begins |= {p, p + len(mark)} - {len(data)}
                p = raw.find(mark, p + len(mark))
            else:
                p = raw.find(mark, p + 1)
    begins = np.array(sorted(begins), np.int64)
    lead = (data & 0xC0) != 0x80
    char = np.cumsum(lead) - 1
    points = np.frombuffer(raw.decode().encode("utf-32-le"), np.uint32)
    flags = part_starts(points, char[begins])
    starts = np.flatnonzero(lead)[flags]
    counts = _counter(path).count(data, starts, np.append(starts[1:], len(data)))
    for a, b in hidden:
        counts[np.searchsorted(starts, a):np.searchsorted(starts, b)] = 0
    sums = np.append(0, np.cumsum(counts, dtype=np.int64))
    at = np.searchsorted(starts, offsets)
    return sums[at[1:]] - sums[at[:-1]] + extra


def token_counts(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", limit: int = LIMIT) -> DataFrame:
    """key, n_bytes, n_tokens, over_limit (n_tokens > limit) for each row, as byte-level BPE file `path` counts.

    Null and empty texts have no bytes and no tokens; special strings in a text are one token each; repeated
    rows and rows without id are counted like others; other columns are ignored. No shuffle.
    """

    def count(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offsets in rows_of(it, "text", SLICE):
            n = count_tokens(data, offsets, path)
            yield pa.record_batch([part.column("id"), pa.array(np.diff(offsets)), pa.array(n), pa.array(n > limit)], ["id", "n_bytes", "n_tokens", "over_limit"])

    source = docs.select(F.col(key).cast("long").alias("id"), as_text(docs, text).alias("text"))
    return source.mapInArrow(count, "id long, n_bytes long, n_tokens long, over_limit boolean").withColumnRenamed("id", key)
