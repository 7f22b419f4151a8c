"""Collocations: phrases of two or three words that occur together more often than their parts would have it.

Documents become shards of bounded size, each an FM-index in a file of the shared folder. Words are counted over
all shards; the frequent ones get global ids. Each shard extends them to the right, the pairs are summed over
shards in buckets, and the answers name the pairs that are frequent in the whole corpus. Each shard extends those
to the left by words that form a frequent pair with their first, and the triples are summed alike. A phrase is
never rarer than a phrase that holds it, so nothing is lost. A bucket holds one entry a shard and phrase,
however often the phrase occurs; shards and buckets are processed one at a time in a task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .fm_index import FmIndex, Phrases, narrow, pack, unpack
from .storage import as_text, file_system, fresh_path, stored
from .text import LOWER, mix, rows_of, word_spans

#: Words of a shard: what a task holds at a time. A longer piece makes a larger shard of its own.
SHARD_WORDS = 1_000_000
#: Words of the corpus per bucket of phrases.
BUCKET_WORDS = 2_000_000
MAX_IDS = 1 << 31

BREAK, BLANK = np.zeros(256, bool), np.zeros(256, bool)
BREAK[[*b".,;:!?\n\x0b\x0c\r"]] = True
BLANK[[*b" \t"]] = True

VOCABULARY = "shard long, id int, lang string, word string, n long"
PARCEL = "bucket int, shard long, blob binary"


# ------------------------------------------------------------- shards


def _words(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(words, row of each, whether it begins a piece) of texts."""
    data = LOWER[data]
    row, start, end = word_spans(data, offsets, BREAK | BLANK)
    breaks = np.append(0, np.cumsum(BREAK[data]))[start]
    opens = np.ones(len(row), bool)
    opens[1:] = (row[1:] != row[:-1]) | (breaks[1:] != breaks[:-1])
    ends = np.append(0, np.cumsum(end - start))
    inside = ~(BREAK | BLANK)[data]
    words = pa.Array.from_buffers(pa.large_binary(), len(row), [None, pa.py_buffer(ends), pa.py_buffer(data[inside])])
    return words, row, opens


def _shard(words: list[pa.Array], langs: list[np.ndarray], opens: list[np.ndarray], depth: int) -> tuple[FmIndex, np.ndarray, pa.Array, np.ndarray]:
    """(index, language number, word, count of each id from 1) of one shard."""
    coded = pa.chunked_array(words).combine_chunks().dictionary_encode()
    lang, new = np.concatenate(langs), np.concatenate(opens)
    kinds = len(coded.dictionary)
    both = lang.astype(np.int64) * kinds + coded.indices.to_numpy().astype(np.int64)
    pairs, ids, n = np.unique(both, return_inverse=True, return_counts=True)
    text = np.zeros(len(ids) + int(new.sum()), np.int64)
    text[np.arange(len(ids)) + np.cumsum(new)] = ids + 1
    return FmIndex.build(text, len(pairs) + 1, depth), pairs // kinds, coded.dictionary.take(pa.array(pairs % kinds)), n


def build_shards(docs: DataFrame, path: str, shard_words: int, depth: int) -> DataFrame:
    """Writes the shards of (lang, text) under `path`, a file each; VOCABULARY of all of them, stored."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, top = file_system(path)
        fs.create_dir(top, recursive=True)
        names: dict[str, int] = {}
        words, langs, opens, held = [], [], [], 0
        number = TaskContext.get().taskAttemptId() << 20  # of this attempt alone

        def flush() -> pa.RecordBatch:
            nonlocal held, number
            index, lang, word, n = _shard(words, langs, opens, depth)
            with fs.open_output_stream(f"{top}/{number}") as sink:
                sink.write(index.to_bytes())
            said = pa.array(list(names)).take(pa.array(lang))
            out = pa.record_batch([pa.array(np.full(len(n), number)), pa.array(np.arange(1, len(n) + 1), pa.int32()), said,
                                   word.cast(pa.large_string()).cast(pa.string()), pa.array(n.astype(np.int64))], ["shard", "id", "lang", "word", "n"])
            number, held = number + 1, 0
            words.clear(), langs.clear(), opens.clear()
            return out

        for rows, data, offsets in rows_of(batches, "text"):
            code = np.array([names.setdefault(x, len(names)) for x in rows.column("lang").to_pylist()], np.int32)
            w, row, new = _words(data, offsets)
            at = np.append(np.flatnonzero(new), len(row))  # places to cut at
            a = 0
            while a < len(row):
                room = max(shard_words - held, 1)
                b = int(at[max(np.searchsorted(at, a + room, "right") - 1, np.searchsorted(at, a, "right"))])
                if held and b - a > room:  # a piece that does not fit
                    yield flush()
                    continue
                words.append(w[a:b]), langs.append(code[row[a:b]]), opens.append(new[a:b])
                held, a = held + b - a, b
                if held >= shard_words:
                    yield flush()
        if held:
            yield flush()

    return stored(docs.mapInArrow(build, VOCABULARY), "vocabulary")


def _load(path: str, shard: int) -> FmIndex:
    fs, top = file_system(path)
    with fs.open_input_stream(f"{top}/{shard}") as source:
        return FmIndex.from_bytes(source.read())


# ------------------------------------------------------------- words


def frequent_words(vocabulary: DataFrame, min_count: int) -> DataFrame:
    """(gid, lang, word, f): words of at least `min_count` occurrences, numbered without gaps, stored."""
    words = vocabulary.groupBy("lang", "word").agg(F.sum("n").alias("f")).where(F.col("f") >= min_count)
    numbered = words.select("*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at"))
    placed = stored(numbered.withColumn("at", F.col("at").bitwiseAND((1 << 33) - 1)), "words")
    # One row a written partition.
    parts = placed.groupBy("part").agg((F.max("at") + 1).alias("n"))
    before = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    return placed.join(F.broadcast(before), "part").select((F.col("before") + F.col("at")).alias("gid"), "lang", "word", "f")


# ------------------------------------------------------------- extension in shards, sums in buckets


def _groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[int, list[pa.RecordBatch]]]:
    """Runs of equal `key` in sorted rows."""
    held, last = [], None
    for batch in batches:
        k = batch.column(key).to_numpy()
        cuts = [0, *(np.flatnonzero(k[1:] != k[:-1]) + 1).tolist(), len(k)]
        for a, b in zip(cuts, cuts[1:]):
            if a == b:
                continue
            if held and k[a] != last:
                yield int(last), held
                held = []
            last = k[a]
            held.append(batch.slice(a, b - a))
    if held:
        yield int(last), held


def _column(parts: list[pa.RecordBatch], name: str) -> np.ndarray:
    return np.concatenate([p.column(name).to_numpy() for p in parts])


def _blobs(bucket: np.ndarray, *columns: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    """The buckets and a blob for each; the first column ascends in it and is kept as differences."""
    order = np.lexsort((columns[0], bucket))
    bucket, columns = bucket[order], [c[order] for c in columns]
    cuts = [0, *(np.flatnonzero(bucket[1:] != bucket[:-1]) + 1).tolist(), len(bucket)] if len(bucket) else [0]
    return bucket[cuts[:-1]], [pack(narrow(np.diff(columns[0][a:b], prepend=0)), *(narrow(c[a:b]) for c in columns[1:])) for a, b in zip(cuts, cuts[1:])]


def _parcels(shard: int, key: np.ndarray, buckets: int, *columns: np.ndarray) -> pa.RecordBatch:
    """PARCEL of a shard's entries, placed by a hash of `key`."""
    bucket, blobs = _blobs(mix(key) % np.uint64(buckets), *columns)
    return pa.record_batch([pa.array(bucket.astype(np.int32)), pa.array(np.full(len(blobs), shard)), pa.array(blobs, pa.binary())], ["bucket", "shard", "blob"])


def _opened(parts: list[pa.RecordBatch]) -> tuple[np.ndarray, list[np.ndarray]]:
    """(shard, columns) of the entries of all blobs; a column has 64 bits."""
    shards, blobs = [], []
    for p in parts:
        for s, blob in zip(p.column("shard").to_pylist(), p.column("blob").to_pylist()):
            first, *rest = unpack(blob)
            blobs.append([np.cumsum(first.astype(np.int64)), *(c.astype(np.int64) for c in rest)])
            shards.append(np.full(len(first), s))
    return np.concatenate(shards), [np.concatenate(c) for c in zip(*blobs)]


def _pairs(path: str, buckets: int):
    """Rows (shard, id, gid) by shard: its pairs of frequent words, as PARCEL of (pair, place of its interval, count)."""

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, parts in _groups(batches, "shard"):
            index, ids = _load(path, shard), _column(parts, "id").astype(np.int64)
            gid = np.full(len(index.starts), -1)
            gid[ids] = _column(parts, "gid")
            phrase, word, found = index.extend(index.words(ids), left=False, both=False)
            known = gid[word] >= 0
            pair = (gid[ids][phrase[known]] << 32) | gid[word[known]]
            yield _parcels(shard, pair.astype(np.uint64), buckets, pair, found.left[known], found.size[known])

    return pairs


def _sum_pairs(min_count: int):
    """PARCEL by bucket: (pair, f) of the frequent ones, and to each shard a blob of those that it holds."""

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, parts in _groups(batches, "bucket"):
            shard, (pair, place, n) = _opened(parts)
            kinds, which = np.unique(pair, return_inverse=True)
            f = np.bincount(which, n).astype(np.int64)
            good = f >= min_count
            yield pa.record_batch([pa.nulls(good.sum(), pa.int64()), pa.nulls(good.sum(), pa.binary()), pa.array(kinds[good]), pa.array(f[good])],
                                  ["shard", "blob", "pair", "f"])
            stay = good[which]
            whom, blobs = _blobs(shard[stay], pair[stay], place[stay], n[stay])
            none = pa.nulls(len(whom), pa.int64())
            yield pa.record_batch([pa.array(whom), pa.array(blobs, pa.binary()), none, none], ["shard", "blob", "pair", "f"])

    return total


def _triples(path: str, buckets: int):
    """Blobs of frequent pairs by shard: their extensions to the left that begin with a frequent pair, as PARCEL of (pair, third word, count)."""

    def triples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, parts in _groups(batches, "shard"):
            index, (_, (pair, place, n)) = _load(path, shard), _opened(parts)
            gid = np.full(len(index.starts), -1)
            gid[np.searchsorted(index.starts, place, "right") - 1] = pair >> 32  # the id that a pair's suffixes begin with
            phrase, word, found = index.extend(Phrases(place, place, n), left=True, both=False)
            known = gid[word] >= 0
            phrase, first, size = phrase[known], gid[word[known]], found.size[known]
            front, pairs = (first << 32) | (pair[phrase] >> 32), np.sort(pair)
            good = pairs[np.searchsorted(pairs, front).clip(max=len(pairs) - 1)] == front if len(pairs) else np.zeros(0, bool)
            front, last, size = front[good], (pair[phrase] & (MAX_IDS * 2 - 1))[good], size[good]
            yield _parcels(shard, front.astype(np.uint64) ^ mix(last.astype(np.uint64)), buckets, front, last, size)

    return triples


def _sum_triples(min_count: int):
    """PARCEL by bucket: (pair, third, f) of the frequent triples."""

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, parts in _groups(batches, "bucket"):
            _, (pair, third, n) = _opened(parts)
            kinds, which = np.unique(pair, return_inverse=True)
            both, at = np.unique(which * MAX_IDS + third, return_inverse=True)
            f = np.bincount(at, n).astype(np.int64)
            good = f >= min_count
            yield pa.record_batch([pa.array(kinds[both[good] // MAX_IDS]), pa.array(both[good] % MAX_IDS), pa.array(f[good])], ["pair", "third", "f"])

    return total


def count_phrases(docs: DataFrame, min_count: int = 10, lang: str = "lang", text: str = "text") -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Four tables: totals (lang, n), words (gid, lang, word, f), pairs (g1, g2, f) and triples (g1, g2, g3, f)
    of all phrases with at least `min_count` occurrences within pieces. Ids are of a language's word."""
    spark, path = docs.sparkSession, fresh_path(docs.sparkSession, "phrases")
    source = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), as_text(docs, text).alias("text"))
    vocabulary = build_shards(source, f"{path}/shards", SHARD_WORDS, depth=2)
    words = stored(frequent_words(vocabulary, min_count), "frequent")
    totals = stored(vocabulary.groupBy("lang").agg(F.sum("n").alias("n")), "totals")
    size, shards = vocabulary.agg(F.sum("n"), F.count_distinct("shard")).first()
    if words.count() >= MAX_IDS:
        raise ValueError("more than 2^31 frequent words")
    buckets = max(1, -(-(size or 0) // BUCKET_WORDS))
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    by_shard, by_bucket = (max(least, min(k, 200_000)) for k in (shards, buckets))

    def dealt(df: DataFrame, n: int, by: str, *then: str) -> DataFrame:
        return df.repartition(n, by).sortWithinPartitions(by, *then)

    mapped = vocabulary.select("shard", "id", "lang", "word").join(words.select("gid", "lang", "word"), ["lang", "word"]).select("shard", "id", "gid")
    parcels = dealt(mapped, by_shard, "shard").mapInArrow(_pairs(f"{path}/shards", buckets), PARCEL)
    summed = stored(dealt(parcels, by_bucket, "bucket").mapInArrow(_sum_pairs(min_count), "shard long, blob binary, pair long, f long"), "pairs")
    answers = summed.where("blob is not null").select("shard", "blob")
    parcels = dealt(answers, by_shard, "shard").mapInArrow(_triples(f"{path}/shards", buckets), PARCEL)
    triples = stored(dealt(parcels, by_bucket, "bucket").mapInArrow(_sum_triples(min_count), "pair long, third long, f long"), "triples")

    first, second = F.shiftright("pair", 32), F.col("pair").bitwiseAND((1 << 32) - 1)
    pairs = summed.where("blob is null").select(first.alias("g1"), second.alias("g2"), "f")
    return totals, words, pairs, triples.select(first.alias("g1"), second.alias("g2"), F.col("third").alias("g3"), "f")


# ------------------------------------------------------------- scores


def _score(a: str, l: str, r: str) -> Column:
    """floor(1000000 a a / (l r)) in decimals of 38 digits, so for counts up to 10^16."""
    return F.expr(f"(1000000 * cast({a} as decimal(38, 0)) * {a}) div (cast({l} as decimal(38, 0)) * {r})")


def collocations(docs: DataFrame, top: int = 2000, min_count: int = 10, lang: str = "lang", text: str = "text") -> DataFrame:
    """Each language's `top` phrases of two or three words: lang, rank, phrase, a, l, r, n, score.

    Texts are lower-cased (A-Z), split at `[.,;:!?\\x0A-\\x0D]` into pieces and at blanks and tabs into words. n is a
    language's words, a, l and r the counts of a phrase and of its two parts at the cut that scores least, the first
    of equals; score is floor(1000000 a a / (l r)). Phrases of fewer than `min_count` occurrences are none; a pair
    within a triple that has at least half its occurrences is dropped. Order: score, a, phrase by bytes.
    A null lang is `und`, a null or empty text has no words, every row counts, also repeated ones; a long text is cut
    between pieces; an empty table has no phrases; other columns are ignored.
    """
    totals, words, pairs, triples = count_phrases(docs, min_count, lang, text)

    def named(df: DataFrame, g: str, f: str, *more: str) -> DataFrame:
        return df.join(words.select(F.col("gid").alias(g), F.col("f").alias(f), *more), g)

    longer = triples.select("g1", "g2", "f").unionByName(triples.select(F.col("g2").alias("g1"), F.col("g3").alias("g2"), "f"))
    longest = longer.groupBy("g1", "g2").agg(F.max("f").alias("held"))
    two = pairs.withColumnRenamed("f", "a").join(longest, ["g1", "g2"], "left").where("held is null or 100 * held < 50 * a")
    two = named(named(two, "g1", "l", "lang"), "g2", "r").select("lang", "g1", "g2", F.lit(None).cast("long").alias("g3"), "a", "l", "r", _score("a", "l", "r").alias("score"))

    three = (triples.withColumnRenamed("f", "a").join(pairs.withColumnRenamed("f", "f12"), ["g1", "g2"])
             .join(pairs.select(F.col("g1").alias("g2"), F.col("g2").alias("g3"), F.col("f").alias("f23")), ["g2", "g3"]))
    three = named(named(three, "g1", "f1", "lang"), "g3", "f3").withColumn("s1", _score("a", "f1", "f23")).withColumn("s2", _score("a", "f12", "f3"))
    late = F.col("s2") < F.col("s1")
    three = three.select("lang", "g1", "g2", "g3", "a", F.when(late, F.col("f12")).otherwise(F.col("f1")).alias("l"),
                         F.when(late, F.col("f3")).otherwise(F.col("f23")).alias("r"), F.least("s1", "s2").alias("score"))

    best = [F.desc("score"), F.desc("a")]
    # All that tie with the last are named before the phrases decide.
    near = two.unionByName(three).withColumn("place", F.rank().over(Window.partitionBy("lang").orderBy(*best))).where(F.col("place") <= top)
    for k in (1, 2, 3):
        near = near.join(words.select(F.col("gid").alias(f"g{k}"), F.col("word").alias(f"w{k}")), f"g{k}", "left")
    phrased = near.withColumn("phrase", F.concat_ws(" ", "w1", "w2", "w3"))
    ranked = phrased.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best, "phrase")).cast("long")).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
