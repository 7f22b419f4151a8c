"""Monotone integer sequences in Elias-Fano form, read in bulk from memory-mapped files."""

from __future__ import annotations

import json
import os
import tempfile
from dataclasses import dataclass

import numpy as np

from .storage import file_system


@dataclass(frozen=True)
class EliasFano:
    """n values below `universe`: `width` low bits of each, packed, and the high parts in unary."""
    n: int
    width: int
    low: np.ndarray  # 64-bit words
    high: np.ndarray  # 64-bit words: value i sets bit (value >> width) + i
    ones: np.ndarray  # ones before each word of `high`

    def _select(self, k: np.ndarray, zeros: bool) -> np.ndarray:
        """Place of the k-th (from 0) one, or zero, of `high`."""
        before = 64 * np.arange(len(self.ones)) - self.ones if zeros else self.ones
        w = np.searchsorted(before, k, "right") - 1
        bits = ~self.high[w] if zeros else self.high[w]
        rest = k - before[w]
        at = np.zeros(len(k), np.uint64)
        for half in (32, 16, 8, 4, 2, 1):  # halve the word that holds it
            mask = np.uint64((1 << half) - 1)
            n = np.bitwise_count((bits >> at) & mask)
            over = rest >= n
            rest = rest - np.where(over, n, 0)
            at = at + np.where(over, np.uint64(half), np.uint64(0))
        return 64 * w + at.astype(np.int64)

    def lows(self, i: np.ndarray) -> np.ndarray:
        if not self.width:
            return np.zeros(len(i), np.int64)
        bit = i.astype(np.int64) * self.width
        w, off = bit >> 6, (bit & 63).astype(np.uint64)
        got = (self.low[w] >> off) | ((self.low[w + 1] << np.uint64(1)) << (np.uint64(63) - off))
        return (got & np.uint64((1 << self.width) - 1)).astype(np.int64)

    def get(self, i: np.ndarray) -> np.ndarray:
        return ((self._select(i, zeros=False) - i) << self.width) | self.lows(i)

    def successor(self, x: np.ndarray) -> np.ndarray:
        """Index of the first value that is not below x (n if there is none)."""
        h = x >> self.width
        start = np.where(h > 0, self._select(np.maximum(h - 1, 0), zeros=True) - np.maximum(h - 1, 0), 0)
        stop = self._select(h, zeros=True) - h
        target = x & ((1 << self.width) - 1)
        while (open_ := np.flatnonzero(start < stop)).size:  # lows of one high part ascend
            mid = (start[open_] + stop[open_]) >> 1
            below = self.lows(mid) < target[open_]
            start[open_] = np.where(below, mid + 1, start[open_])
            stop[open_] = np.where(below, stop[open_], mid)
        return start


def encode(values: np.ndarray, universe: int) -> dict[str, np.ndarray]:
    """Arrays of the form of ascending `values`, all below `universe`."""
    n = len(values)
    width = max(0, (max(universe, 1) // max(n, 1)).bit_length() - 1)
    values = values.astype(np.uint64)
    size = n + (max(universe, 1) >> width) + 2
    flags = np.zeros(-(-size // 64) * 64, np.uint8)
    flags[(values >> np.uint64(width)).astype(np.int64) + np.arange(n)] = 1
    high = np.packbits(flags, bitorder="little").view(np.uint64)
    ones = np.cumsum(np.bitwise_count(high), dtype=np.int64)
    low = np.zeros((-(-n // 64), max(width, 1)), np.uint64)
    if width:
        lanes = np.zeros(len(low) * 64, np.uint64)
        lanes[:n] = values & np.uint64((1 << width) - 1)
        lanes = lanes.reshape(-1, 64)
        for k in range(64):  # 64 values fill `width` words
            w, off = divmod(k * width, 64)
            low[:, w] |= lanes[:, k] << np.uint64(off)
            if off + width > 64:
                low[:, w + 1] |= lanes[:, k] >> np.uint64(64 - off)
    return {"shape": np.array([n, width], np.int64), "low": np.append(low.reshape(-1), np.uint64(0)), "high": high, "ones": np.append(0, ones[:-1]).astype(np.int64)}


def decoded(arrays: dict[str, np.ndarray], name: str) -> EliasFano:
    n, width = arrays[name + ".shape"].tolist()
    return EliasFano(n, width, arrays[name + ".low"], arrays[name + ".high"], arrays[name + ".ones"])


def write_arrays(uri: str, arrays: dict[str, np.ndarray]) -> None:
    """One file: a line of JSON that names the arrays, then their bytes at multiples of 64."""
    fs, path = file_system(uri)
    fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
    at, head = 0, []
    for name, a in arrays.items():
        head.append([name, a.dtype.str, len(a), at])
        at += -(-a.nbytes // 64) * 64
    line = json.dumps(head).encode()
    line += b" " * (-(len(line) + 1) % 64) + b"\n"
    with fs.open_output_stream(path) as f:
        f.write(line)
        for a in arrays.values():
            f.write(np.ascontiguousarray(a).tobytes() + b"\0" * (-a.nbytes % 64))


def map_arrays(uri: str) -> dict[str, np.ndarray]:
    """The arrays of a file, mapped into memory. A file of a remote store is copied first, to a local file
    that goes when the mapping does."""
    fs, path = file_system(uri)
    if type(fs).__name__ == "LocalFileSystem":
        raw = np.memmap(path, np.uint8, "r")
    else:
        with fs.open_input_stream(path) as src, tempfile.NamedTemporaryFile(delete=False) as local:
            while part := src.read(1 << 20):
                local.write(part)
        raw = np.memmap(local.name, np.uint8, "r")
        os.unlink(local.name)
    end = int(np.flatnonzero(raw[:1 << 20] == 10)[0]) + 1
    return {name: raw[end + at:end + at + n * np.dtype(kind).itemsize].view(kind) for name, kind, n, at in json.loads(raw[:end].tobytes())}
