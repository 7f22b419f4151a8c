"""A word-bigram language model in an Elias-Fano trie, learned and scored on Spark.

Level 1 is the vocabulary: words are numbered by the rank of their 64-bit hashes; a word has its count,
its backoff weight and a pointer to its successors. Level 2 has the successors of each word, ascending.
Pointers and successors are Elias-Fano sequences; a successor is stored as context * V + word, so the
level ascends as a whole and a lookup is a successor search for it in the context's range. Smoothed
log-probabilities and backoff weights take 8 bits each. A level is cut into shards of contiguous words;
each shard is built by one task from the counts that were shuffled to it, written to the shared folder
and memory-mapped by the tasks that score, so a worker holds the pages that it reads and no more.

p(w | h) = (c(h, w) - D) / c(h) + D * n(h) / c(h) * p(w), D by n1 / (n1 + 2 * n2) of the shard, n(h) the
number of distinct successors; p(w) = (c + 0.1) / (N + 0.1 * (V + 1)), which is also the base model. The
first word of a text and one after an unknown word have p(w).
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .elias_fano import decoded, encode, map_arrays, write_arrays
from .storage import as_text, fresh_path
from .text import LOWER, mix, rows_of, span_hashes, word_spans

END = mix(np.array([0xE0D], np.uint64))[0]
#: Bytes of text to a shard, most shards, and words that a task counts before it sends its counts on.
SHARD_BYTES, MOST_SHARDS, FLUSH_WORDS = 16 << 20, 20_000, 4_000_000
LEVELS = 255


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of the words of each text and of one end after them."""
    row, start, end = word_spans(data, offsets)
    n = len(offsets) - 1
    count = np.bincount(row, minlength=n) + 1
    last = np.cumsum(count) - 1
    out = np.empty(int(count.sum()), np.uint64)
    word = np.ones(len(out), bool)
    word[last] = False
    out[last], out[word] = END, span_hashes(LOWER[data], start, end)
    return np.repeat(np.arange(n), count), out


def _pack(keys: np.ndarray, counts: np.ndarray) -> bytes:
    """Ascending keys and their counts, as compressed byte planes of differences."""
    step = np.diff(keys, prepend=np.uint64(0))
    planes = [np.ascontiguousarray(a.view(np.uint8).reshape(-1, 8).T).tobytes() for a in (step, counts.astype(np.uint64))]
    return zstandard.ZstdCompressor(level=3).compress(b"".join(planes))


def _unpack(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8).reshape(2, 8, -1)
    step, counts = (np.ascontiguousarray(a.T).view(np.uint64).reshape(-1) for a in raw)
    return np.cumsum(step, dtype=np.uint64), counts.astype(np.int64)


def _sums(keys: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, ascending, with the sums of their counts (1 each without any)."""
    if not len(keys):
        return keys, np.zeros(0, np.int64)
    order = np.argsort(keys, kind="stable") if counts is not None else None
    keys = keys[order] if order is not None else np.sort(keys)
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    if counts is None:
        return keys[first], np.diff(np.append(first, len(keys)))
    return keys[first], np.add.reduceat(counts[order], first)


def _dealt(keys: np.ndarray, counts: np.ndarray, shards: np.ndarray) -> Iterator[pa.RecordBatch]:
    cuts = np.flatnonzero(np.append(True, shards[1:] != shards[:-1])) if len(shards) else []
    for a, b in zip(cuts, [*cuts[1:], len(shards)]):
        yield pa.record_batch([pa.array([int(shards[a])], pa.int32()), pa.array([_pack(keys[a:b], counts[a:b])], pa.binary())], ["shard", "blob"])


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(shard, keys, counts) of blobs sorted by shard. Runs merge as they come, so copies do not pile up."""
    shard, parts, size, floor = None, [], 0, 0

    def merge() -> None:
        nonlocal parts, size, floor
        parts = [_sums(np.concatenate([k for k, _ in parts]), np.concatenate([c for _, c in parts]))]
        size = floor = len(parts[0][0])

    for batch in batches:
        for s, blob in zip(batch.column("shard").to_pylist(), batch.column("blob")):
            if s != shard and shard is not None:
                merge()
                yield shard, *parts[0]
                parts, size, floor = [], 0, 0
            shard = s
            parts.append(_unpack(blob.as_py()))
            size += len(parts[-1][0])
            if size > 2 * floor + FLUSH_WORDS:
                merge()
    if shard is not None:
        merge()
        yield shard, *parts[0]


def _shard_of(hashes: np.ndarray, shards: int) -> np.ndarray:
    """Ranges of hashes of equal width."""
    return ((hashes >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


class Trie:
    """The mapped levels of a model."""

    def __init__(self, words: list[tuple[str, int]], successors: list[tuple[int, str]], total: int):
        self.shards = len(words)
        sizes = [n for _, n in words]
        self.first = np.append(0, np.cumsum(sizes)).astype(np.int64)  # the first word of each shard
        self.size, self.total = int(self.first[-1]), total
        self.words = [map_arrays(uri) if uri else None for uri, _ in words]
        self.level2 = {s: map_arrays(uri) for s, uri in successors}
        self.pointers = {s: decoded(a, "pointers") for s, a in self.level2.items()}
        self.follow = {s: decoded(a, "successors") for s, a in self.level2.items()}

    def numbers(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(word or -1, count) of ascending hashes."""
        out, counts = np.full(len(hashes), -1, np.int64), np.zeros(len(hashes), np.int64)
        shard = _shard_of(hashes, self.shards)
        cuts = np.searchsorted(shard, np.arange(self.shards + 1))
        for s in np.flatnonzero(np.diff(cuts)).tolist():
            if self.words[s] is None:
                continue
            a, b = cuts[s], cuts[s + 1]
            known = self.words[s]["hashes"]
            at = np.searchsorted(known, hashes[a:b])
            ok = np.flatnonzero(known[np.minimum(at, len(known) - 1)] == hashes[a:b])
            out[a + ok], counts[a + ok] = self.first[s] + at[ok], self.words[s]["counts"][at[ok]]
        return out, counts

    def uniform(self, counts: np.ndarray) -> np.ndarray:
        """log10 of the base model's probability."""
        return np.log10((counts + 0.1) / (self.total + 0.1 * (self.size + 1)))

    def bigrams(self, keys: np.ndarray, base: np.ndarray) -> np.ndarray:
        """log10 p(word | context) of ascending context * V + word; `base` is log10 p(word)."""
        out = base.copy()
        v = np.uint64(max(self.size, 1))
        context = (keys // v).astype(np.int64)
        edges = np.searchsorted(context, self.first)
        for s in self.level2:
            a, b = int(edges[s]), int(edges[s + 1])
            if a == b:
                continue
            data, follow = self.level2[s], self.follow[s]
            local = context[a:b] - self.first[s]
            some, of = np.unique(local, return_inverse=True)
            start, stop = (self.pointers[s].get(some + k) for k in (0, 1))
            low, step, b_low, b_step = data["book"].tolist()
            got = base[a:b] + np.where(stop > start, b_low + b_step * data["backoff"][some], 0.0)[of]
            open_ = np.flatnonzero(stop[of] > start[of])
            target = (keys[a:b][open_] - np.uint64(self.first[s]) * v).astype(np.int64)
            at = follow.successor(target)
            inside = np.flatnonzero((at >= start[of][open_]) & (at < stop[of][open_]))
            hit = inside[follow.get(at[inside]) == target[inside]]
            got[open_[hit]] = low + step * data["prob"][at[hit]]
            out[a:b] = got
        return out

    def backoffs(self, context: np.ndarray) -> np.ndarray:
        """log10 backoff weights of ascending words, 0 of one without successors."""
        out = np.zeros(len(context))
        edges = np.searchsorted(context, self.first)
        for s, data in self.level2.items():
            local = context[edges[s]:edges[s + 1]] - self.first[s]
            if len(local):
                start, stop = (self.pointers[s].get(local + k) for k in (0, 1))
                low, step = data["book"].tolist()[2:]
                out[edges[s]:edges[s + 1]] = np.where(stop > start, low + step * data["backoff"][local], 0.0)
        return out


@cache
def _open(words: tuple, successors: tuple, total: int) -> Trie:
    return Trie(list(words), list(successors), total)


def _vocabulary(train: DataFrame, shards: int, parts: int, path: str) -> list:
    def count(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for _, data, offsets in rows_of(it, "text"):
            held.append(tokens(data, offsets)[1])
            if sum(map(len, held)) >= FLUSH_WORDS:
                k, c = _sums(np.concatenate(held))
                yield from _dealt(k, c, _shard_of(k, shards))
                held = []
        if held:
            k, c = _sums(np.concatenate(held))
            yield from _dealt(k, c, _shard_of(k, shards))

    def build(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, keys, counts in _merged(it):
            uri = f"{path}/words-{shard}-{uuid.uuid4().hex}"
            write_arrays(uri, {"hashes": keys, "counts": counts})
            yield pa.record_batch([pa.array([shard], pa.int32()), [uri], [len(keys)], [int(counts.sum())]], ["shard", "uri", "n", "total"])

    dealt = train.mapInArrow(count, "shard int, blob binary").repartition(parts, "shard").sortWithinPartitions("shard")
    # a row for each shard comes to the driver
    return dealt.mapInArrow(build, "shard int, uri string, n long, total long").collect()


def _successors(train: DataFrame, shards: int, parts: int, path: str, words: tuple, total: int) -> list:
    def count(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, held, size = _open(words, (), total), [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            k, c = _sums(np.concatenate(held))
            context = (k // np.uint64(trie.size)).astype(np.int64)
            yield from _dealt(k, c, np.searchsorted(trie.first, context, "right") - 1)

        for _, data, offsets in rows_of(it, "text"):
            row, h = tokens(data, offsets)
            distinct, which = np.unique(h, return_inverse=True)
            ids = trie.numbers(distinct)[0][which].astype(np.uint64)
            held.append((ids[:-1] * np.uint64(trie.size) + ids[1:])[row[1:] == row[:-1]])
            size += len(held[-1])
            if size >= FLUSH_WORDS:
                yield from flush()
                held, size = [], 0
        if size:
            yield from flush()

    def build(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = _open(words, (), total)
        v = np.uint64(trie.size)
        for shard, keys, counts in _merged(it):
            lo, n = int(trie.first[shard]), int(trie.first[shard + 1] - trie.first[shard])
            context, word = (keys // v).astype(np.int64) - lo, (keys % v).astype(np.int64)
            width = np.bincount(context, minlength=n)
            mass = np.bincount(context, counts, n)
            n1, n2 = int((counts == 1).sum()), int((counts == 2).sum())
            less = n1 / (n1 + 2 * n2) if 0 < n1 and n2 else 0.5
            share = less * width / np.maximum(mass, 1)
            p = (counts - less) / mass[context] + share[context] * 10 ** trie.uniform(_counts(trie, word))
            prob, backoff = np.log10(p), np.log10(np.where(width > 0, share, 1))
            book = []
            for x in (prob, backoff):
                book += [float(x.min()), max(float(x.max() - x.min()), 1e-9) / LEVELS]
            code = lambda x, low, step: np.clip(np.rint((x - low) / step), 0, LEVELS).astype(np.uint8)
            levels = {"pointers": encode(np.append(0, np.cumsum(width)), len(keys) + 1),
                      "successors": encode(keys - np.uint64(lo) * v, n * int(v))}
            arrays = {f"{k}.{name}": a for k, form in levels.items() for name, a in form.items()}
            uri = f"{path}/successors-{shard}-{uuid.uuid4().hex}"
            write_arrays(uri, arrays | {"prob": code(prob, *book[:2]), "backoff": code(backoff, *book[2:]), "book": np.array(book)})
            yield pa.record_batch([pa.array([shard], pa.int32()), [uri]], ["shard", "uri"])

    dealt = train.mapInArrow(count, "shard int, blob binary").repartition(parts, "shard").sortWithinPartitions("shard")
    return dealt.mapInArrow(build, "shard int, uri string").collect()


def _counts(trie: Trie, word: np.ndarray) -> np.ndarray:
    """Counts of words by number."""
    out = np.zeros(len(word), np.int64)
    shard = np.searchsorted(trie.first, word, "right") - 1
    order = np.argsort(shard, kind="stable")
    cuts = np.searchsorted(shard[order], np.arange(trie.shards + 1))
    for s in np.flatnonzero(np.diff(cuts)).tolist():
        some = order[cuts[s]:cuts[s + 1]]
        out[some] = trie.words[s]["counts"][word[some] - trie.first[s]]
    return out


def score_texts(docs: DataFrame, learn: Column, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Learn from the rows that `learn` admits, score all rows.

    Returns key, learned (took part), n_tokens, n_known, train_tokens, base_score and score (log10
    probabilities of the text and its end). A null or empty text is its end alone; rows for which `learn`
    is null are not learned from; repeated rows count as often as they stand there; without a row to learn
    from N and V are 0 and every token has probability 1; other columns are ignored.
    """
    spark = docs.sparkSession
    source = docs.select(F.col(key).cast("long").alias("id"), F.coalesce(learn, F.lit(False)).alias("learned"), as_text(docs, text).alias("text"))
    train, path = source.where("learned").select("text"), fresh_path(spark, "ngrams")
    size = train.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = min(MOST_SHARDS, max(1, -(-size // SHARD_BYTES)))
    parts = max(shards, int(spark.conf.get("spark.sql.shuffle.partitions")))
    found = {r["shard"]: r for r in _vocabulary(train, shards, parts, path)}
    words = tuple((found[s]["uri"], found[s]["n"]) if s in found else ("", 0) for s in range(shards))
    total = sum(r["total"] for r in found.values())
    # of retried tasks only the files that the finished ones name are read
    level2 = tuple(sorted((r["shard"], r["uri"]) for r in _successors(train, shards, parts, path, words, total))) if total else ()

    def rate(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = _open(words, level2, total)
        for part, data, offsets in rows_of(it, "text", 4 << 20):
            row, h = tokens(data, offsets)
            n = part.num_rows
            distinct, which = np.unique(h, return_inverse=True)
            number, count = trie.numbers(distinct)
            base = trie.uniform(count)
            own = base[which]
            score = own.copy()
            pair = np.flatnonzero((row[1:] == row[:-1]) & (number[which[:-1]] >= 0))
            context, word = number[which[pair]], number[which[pair + 1]]
            # an unknown word after a known one: the context's backoff, then the base
            keys = context.astype(np.uint64) * np.uint64(max(trie.size, 1)) + np.maximum(word, 0).astype(np.uint64)
            seen, of = np.unique(keys[word >= 0], return_inverse=True)
            of_base = np.empty(len(seen))
            of_base[of] = own[pair + 1][word >= 0]
            score[pair[word >= 0] + 1] = trie.bigrams(seen, of_base)[of] if len(seen) else 0
            new = np.flatnonzero(word < 0)
            if len(new):
                some, at = np.unique(context[new], return_inverse=True)
                score[pair[new] + 1] += trie.backoffs(some)[at]
            sums = [np.bincount(row, x, n) for x in (own, score)]
            yield pa.record_batch([part.column("id"), part.column("learned"), pa.array(np.bincount(row, minlength=n)), pa.array(np.bincount(row, count[which] > 0, n).astype(np.int64)),
                                   pa.array(np.full(n, total, np.int64)), pa.array(sums[0]), pa.array(sums[1])],
                                  ["id", "learned", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    done = source.mapInArrow(rate, "id long, learned boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    return done.withColumnRenamed("id", key)
