"""BPE encoding and decoding with reuse of content-defined chunks.

Texts are cut where a rolling hash of the bytes before a place meets a mask, so documents that share a
passage share its chunks wherever it stands. A chunk's bytes are sent, once from each page of documents,
to the bucket of their digest; there each distinct chunk is encoded once. Its ids go back once to every
page that asked, and documents are put together from their chunks.

Joins: a place before white space and after an ASCII non-space always parts two pre-tokens, whatever
stands around it, so ids of chunks that meet there agree with those of the whole text. Cuts prefer
such places. Where a chunk had to be cut elsewhere, the join is repaired: the bytes from the last such
place to the next one are encoded again, widening over further chunks until both ends agree.

Blobs are packed and compressed by page and bucket, so the shuffles carry each text and its ids about
once, in less space than the input. A page is PAGE_BYTES of text of one task, a bucket
BUCKET_BYTES of all chunks. A bucket answers in the order it was asked, so digests travel once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bpe
from .storage import as_text
from .text import SPACE, buffers

#: Mean of about 1 KB: cuts fall on one in 128 word ends, no nearer than MIN, no farther than MAX bytes.
MASK, MIN_CHUNK, MAX_CHUNK = np.uint64(127), 128, 4096
WINDOW = 16
PAGE_BYTES, BUCKET_BYTES = 16 << 20, 64 << 20

_GEAR = (np.random.default_rng(7).integers(0, 2**63, 256, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
_STEP = 0x5851F42D4C957F2D


def rolling(data: np.ndarray) -> np.ndarray:
    """At i, a hash of the WINDOW bytes before i (fewer at the start)."""
    h = np.zeros(len(data) + 1, np.uint64)
    h[1:] = _GEAR[data]
    width = 1
    while width < WINDOW:  # hashes of twice the width from two neighbours
        h[width + 1:] = h[width + 1:] + h[1:-width] * np.uint64(pow(_STEP, width, 1 << 64))
        width *= 2
    return h[:-1] ^ (h[:-1] >> np.uint64(29))


def safe_places(data: np.ndarray) -> np.ndarray:
    """Offsets that part pre-tokens in any context: before ASCII white space, after ASCII non-space."""
    if len(data) < 2:
        return np.zeros(0, np.int64)
    solid = (data > 32) & (data < 127)
    return np.flatnonzero(SPACE[data[1:]] & solid[:-1]) + 1


def cuts(data: np.ndarray) -> list[int]:
    """Ends of the chunks of one text, depending on its bytes alone."""
    n = len(data)
    safe = safe_places(data)
    marked = safe[(rolling(data)[safe] & MASK) == 0] if len(safe) else safe
    out, at, i = [], 0, 0
    marks = marked.tolist()
    while n - at > MAX_CHUNK or i < len(marks):
        while i < len(marks) and marks[i] - at < MIN_CHUNK:
            i += 1
        if i < len(marks) and marks[i] - at <= MAX_CHUNK:
            at = marks[i]
        elif n - at > MAX_CHUNK:
            # no mark in reach: the last safe place in reach, else the last character that fits
            j = int(np.searchsorted(safe, at + MAX_CHUNK, "right")) - 1
            end = int(safe[j]) if j >= 0 and safe[j] > at else at + MAX_CHUNK
            while (data[end] & 0xC0) == 0x80:
                end -= 1
            at = end
        else:
            break
        out.append(at)
    return [*out, n] if n > at else out


def _pack(*arrays: np.ndarray | bytes, level: int = 3) -> bytes:
    parts = [a if isinstance(a, bytes) else np.ascontiguousarray(a).tobytes() for a in arrays]
    head = np.array([len(parts), *map(len, parts)], np.int64).tobytes()
    return zstandard.ZstdCompressor(level=level).compress(head + b"".join(parts))


def _unpack(blob: bytes) -> list[bytes]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n = int(np.frombuffer(raw, np.int64, 1)[0])
    sizes = np.frombuffer(raw, np.int64, n, 8)
    ends = np.cumsum(sizes) + 8 * (n + 1)
    return [raw[e - s:e] for s, e in zip(sizes.tolist(), ends.tolist())]


PACKED = "place int, page long, kind int, blob binary"


def _packed(rows: list[tuple[int, int, int, bytes]]) -> pa.RecordBatch:
    a, b, c, d = zip(*rows)
    return pa.record_batch([pa.array(a, pa.int32()), pa.array(b, pa.int64()), pa.array(c, pa.int32()), pa.array(d, pa.binary())], ["place", "page", "kind", "blob"])


def _digest(chunk: bytes) -> bytes:
    return hashlib.blake2b(chunk, digest_size=16).digest()


def _page(page: int, ids: list, texts: list[np.ndarray], buckets: int) -> pa.RecordBatch:
    """Kind 0: distinct chunks, by bucket. Kind 1: ids of the documents, and the chunks that make them up,
    numbered through the page's buckets in ascending order."""
    chunks: dict[bytes, bytes] = {}
    order, counts = [], []
    for data in texts:
        raw, at = data.tobytes(), 0
        ends = cuts(data)
        for end in ends:
            d = _digest(raw[at:end])
            chunks.setdefault(d, raw[at:end])
            order.append(d)
            at = end
        counts.append(len(ends))
    by: dict[int, list[bytes]] = {}
    for d in chunks:
        by.setdefault(int.from_bytes(d[:6], "little") % buckets, []).append(d)
    rows = [(b, page, 0, _pack(b"".join(ds), np.array([len(chunks[d]) for d in ds], np.int32), b"".join(chunks[d] for d in ds), level=6)) for b, ds in by.items()]
    number = {d: i for i, d in enumerate(d for b in sorted(by) for d in by[b])}
    known = np.array([i is not None for i in ids])
    rows.append((page % buckets, page, 1, _pack(np.array([i or 0 for i in ids], np.int64), known, np.array(counts, np.int32), np.array([number[d] for d in order], np.int32))))
    return _packed(rows)


def _cut(buckets: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        page = TaskContext.get().partitionId() << 32
        ids, texts, size = [], [], 0
        for batch in batches:
            data, offsets = buffers(batch.column("text"))
            for i, d in enumerate(batch.column("id").to_pylist()):
                ids.append(d)
                texts.append(data[offsets[i]:offsets[i + 1]].copy())
                size += len(texts[-1])
                if size >= PAGE_BYTES:
                    yield _page(page, ids, texts, buckets)
                    page, ids, texts, size = page + 1, [], [], 0
        if ids:
            yield _page(page, ids, texts, buckets)
    return cut


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, int, bytes]]:
    for batch in batches:
        columns = [batch.column(c) for c in ("place", "page", "kind", "blob")]
        for i in range(batch.num_rows):
            yield tuple(c[i].as_py() for c in columns)


def _encode(path: str):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Chunks of a bucket, sorted together: each digest is encoded once."""
        tok, bucket, known = bpe.load(path), None, {}
        for place, page, kind, blob in _rows(batches):
            if kind == 1:
                yield _packed([(-1, page, 1, blob)])
                continue
            if place != bucket:
                bucket, known = place, {}
            digests, sizes, text = _unpack(blob)
            at, out = 0, []
            for k, n in enumerate(np.frombuffer(sizes, np.int32).tolist()):
                d = digests[16 * k:16 * k + 16]
                if d not in known:
                    known[d] = tok.encode(text[at:at + n].decode())
                out.append(known[d])
                at += n
            yield _packed([(place, page, 0, _pack(np.array([len(x) for x in out], np.int32), np.concatenate(out).astype(np.uint16) if len(tok.tokens) <= 1 << 16 else np.concatenate(out)))])
    return encode


def join_chunks(parts: list[np.ndarray], tok: bpe.Bpe) -> np.ndarray:
    """The ids of the whole text from those of its chunks.

    Joins at safe places agree as they are. Around another join the bytes from the last safe place
    before it to the first one after it are encoded again; both are token ends in the chunks' own ids."""
    if len(parts) < 2:
        return parts[0] if parts else np.zeros(0, np.uint32)
    done: list[np.ndarray] = []
    left = parts[0]
    for right in parts[1:]:
        if not len(left) or not len(right):
            left = np.concatenate([left, right])
            continue
        a, b = tok.tokens[left[-1]][-1], tok.tokens[right[0]][0]
        if 32 < a < 127 and SPACE[b]:
            done.append(left)
            left = right
            continue
        left = _repair(left, right, tok)
    return np.concatenate([*done, left])


def _repair(left: np.ndarray, right: np.ndarray, tok: bpe.Bpe) -> np.ndarray:
    """Encode a window around the join again; it widens until it starts and ends at safe places."""
    span, edge = 16, None
    while edge is None or edge != (0, len(right)):
        edge = max(0, len(left) - span), min(len(right), span)
        head = b"".join(tok.tokens[i] for i in left[edge[0]:].tolist())
        tail = b"".join(tok.tokens[i] for i in right[:edge[1]].tolist())
        from_head = safe_places(np.frombuffer(head, np.uint8))
        from_tail = safe_places(np.frombuffer(tail, np.uint8))
        if (edge[0] == 0 or len(from_head)) and (edge[1] == len(right) or len(from_tail)):
            a = int(from_head[-1]) if len(from_head) else 0
            b = int(from_tail[0]) if len(from_tail) else len(tail)
            before = edge[0] + _tokens_of(left[edge[0]:], a, tok)
            after = _tokens_of(right, b, tok)
            fresh = tok.encode((head[a:] + tail[:b]).decode())
            return np.concatenate([left[:before], fresh.astype(left.dtype), right[after:]])
        span *= 4
    raise AssertionError("a window over both sides is always encoded")


def _tokens_of(ids: np.ndarray, size: int, tok: bpe.Bpe) -> int:
    """How many tokens make up the first `size` bytes; they end there exactly."""
    k, at = 0, 0
    while at < size:
        at += len(tok.tokens[ids[k]])
        k += 1
    if at != size:
        raise AssertionError("a safe place is a token end")
    return k


def _assemble(path: str, full: bool):
    def page_rows(blobs: list[bytes], skeleton: bytes, tok: bpe.Bpe) -> Iterator[pa.RecordBatch]:
        found: list[np.ndarray] = []
        kind = np.uint16 if len(tok.tokens) <= 1 << 16 else np.uint32
        for blob in blobs:
            counts, ids = _unpack(blob)
            found += np.split(np.frombuffer(ids, kind), np.cumsum(np.frombuffer(counts, np.int32))[:-1])
        ids, known, counts, order = _unpack(skeleton)
        names, refs, at, rows = np.frombuffer(ids, np.int64).tolist(), np.frombuffer(order, np.int32).tolist(), 0, []
        for name, has, n in zip(names, np.frombuffer(known, bool).tolist(), np.frombuffer(counts, np.int32).tolist()):
            got = join_chunks([found[k] for k in refs[at:at + n]], tok).tolist()
            at += n
            text = b"".join(map(tok.tokens.__getitem__, got))
            row = (name if has else None, len(got), hashlib.sha256(",".join(map(str, got)).encode()).hexdigest(), hashlib.sha256(text).hexdigest())
            rows.append((*row, got, text.decode()) if full else row)
            if full and len(rows) >= 64:
                yield out(rows)
                rows = []
        if rows:
            yield out(rows)

    def out(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.int32()), pa.string()]
        return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], SCHEMA[:6 if full else 4])

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, page, blobs, skeleton = bpe.load(path), None, [], None
        for _, p, kind, blob in _rows(batches):
            if p != page and page is not None:
                yield from page_rows(blobs, skeleton, tok)
                blobs, skeleton = [], None
            page = p
            if kind == 1:
                skeleton = blob
            else:
                blobs.append(blob)
        if page is not None:
            yield from page_rows(blobs, skeleton, tok)

    return assemble


SCHEMA = ["id", "n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded"]


def encode_decode(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", full: bool = False) -> DataFrame:
    """Encode every whole text with the byte-level BPE file at `path` and decode it again.

    Returns key, n_tokens, ids_sha256 (of decimal ids joined by commas), decoded_sha256 and, with `full`,
    ids and decoded. A row for each row of `docs`, also for repeated ones and those without id; a null or
    empty text has no tokens; special strings in a text are special tokens; other columns are ignored.
    `path` must exist on every executor. The input must give its rows in one order each time it is read
    (tables do), as pages are numbered by task and place.
    """
    source = docs.select(F.col(key).cast("long").alias("id"), as_text(docs, text).alias("text"))
    size = source.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(1, -(-size // BUCKET_BYTES))
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(buckets, 200_000))
    done = source.mapInArrow(_cut(buckets), PACKED).repartition(parts, "place").sortWithinPartitions("place")
    done = done.mapInArrow(_encode(path), PACKED).repartition(parts, "page").sortWithinPartitions("page", "place")
    kinds = "id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>, decoded string" if full else "")
    return done.mapInArrow(_assemble(path, full), kinds).withColumnRenamed("id", key)
