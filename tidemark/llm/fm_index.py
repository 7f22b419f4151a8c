"""A bidirectional FM-index over word ids: the interval of a phrase is extended by a word to either side.

The text is pieces of ids 1, 2, ..., each with a 0 before it, read as a ring. `left` holds the id before each
suffix of the text in sorted order (its Burrows-Wheeler transform), `right` the same of the text read backwards.
A phrase is an interval of one size in both orders. Suffixes are sorted by their first `depth` ids only: the
interval of a phrase of at most so many words is the same as under the full order, which equal long
texts would make costly.
"""

from __future__ import annotations

import io
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import zstandard


def pack(*arrays: np.ndarray) -> bytes:
    out = io.BytesIO()
    for a in arrays:
        np.save(out, a, allow_pickle=False)
    return zstandard.compress(out.getvalue(), 1)


def unpack(blob: bytes) -> list[np.ndarray]:
    raw = zstandard.decompress(blob)
    source, out = io.BytesIO(raw), []
    while source.tell() < len(raw):
        out.append(np.load(source, allow_pickle=False))
    return out


def narrow(a: np.ndarray) -> np.ndarray:
    """Non-negative integers in their least width."""
    return a.astype(np.min_scalar_type(int(a.max(initial=0))))


@dataclass
class Phrases:
    """Many phrases at once: where their intervals begin in either order, and their counts."""
    left: np.ndarray
    right: np.ndarray
    size: np.ndarray


@dataclass
class FmIndex:
    starts: np.ndarray  # suffixes that begin with a lesser id, for every id and one beyond
    left: np.ndarray
    right: np.ndarray

    @classmethod
    def build(cls, text: np.ndarray, n_ids: int, depth: int) -> FmIndex:
        starts = np.append(0, np.cumsum(np.bincount(text, minlength=n_ids)))
        small = np.min_scalar_type(n_ids)
        return cls(starts, *(np.roll(t, 1)[_order(t, n_ids, depth)].astype(small) for t in (text, text[::-1])))

    def to_bytes(self) -> bytes:
        return pack(self.starts, self.left, self.right)

    @classmethod
    def from_bytes(cls, blob: bytes) -> FmIndex:
        return cls(*unpack(blob))

    def words(self, ids: np.ndarray) -> Phrases:
        """The phrases of one word each."""
        at = self.starts[ids]
        return Phrases(at, at, self.starts[ids + 1] - at)

    def extend(self, of: Phrases, left: bool, both: bool = True) -> tuple[np.ndarray, np.ndarray, Phrases]:
        """(phrase extended, id, extended phrase) of all that occur, ordered by phrase and id.

        The ids beside a phrase are those in its interval. In the other order its extensions lie in its interval
        one after another by id; in this order an extension begins behind the lesser ids and behind the same id
        in earlier places (left out, as -1, without `both`)."""
        beside, own, other = (self.left, of.left, of.right) if left else (self.right, of.right, of.left)
        first = np.append(0, np.cumsum(of.size))
        owner = np.repeat(np.arange(len(of.size)), of.size)
        places = np.arange(first[-1]) - np.repeat(first[:-1] - own, of.size)
        n_ids = len(self.starts)
        found, count = np.unique(owner * n_ids + beside[places], return_counts=True)
        phrase, word = np.divmod(found, n_ids)
        before = np.append(0, np.cumsum(count))[:-1] - first[phrase]
        here = np.full(len(found), -1)
        if both:
            here = np.searchsorted(self._places[0 if left else 1], word * len(self.left) + own[phrase])
        there, some = other[phrase] + before, word > 0
        made = Phrases(here, there, count) if left else Phrases(there, here, count)
        return phrase[some], word[some], Phrases(made.left[some], made.right[some], made.size[some])

    @cached_property
    def _places(self) -> list[np.ndarray]:
        """Per order: id * length + place of every id in the transform, ascending; the rank structure."""
        out = []
        for t in (self.left, self.right):
            at = np.argsort(t, kind="stable")
            out.append(t[at].astype(np.int64) * len(t) + at)
        return out

    def count(self, phrase: list[int]) -> int:
        """Occurrences of a phrase of at most depth + 1 words."""
        p = self.words(np.array(phrase[-1:]))
        for w in phrase[-2::-1]:
            _, ids, more = self.extend(p, left=True)
            hit = ids == w
            p = Phrases(more.left[hit], more.right[hit], more.size[hit])
        return int(p.size.sum())


def _order(text: np.ndarray, n_ids: int, depth: int) -> np.ndarray:
    """Places of the ring's suffixes by their first `depth` ids."""
    ahead = [np.roll(text, -k).astype(np.int64) for k in range(depth)]
    if n_ids ** depth < 1 << 62:
        key = ahead[0]
        for a in ahead[1:]:
            key = key * n_ids + a
        return np.argsort(key, kind="stable")
    return np.lexsort(ahead[::-1])
