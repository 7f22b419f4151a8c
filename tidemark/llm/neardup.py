"""Near copies by MinHash with tensored banding, confirmed on full shingle sets.

Instead of K minimums for each of L tables, two collections of m half keys of K/2 minimums are made;
table (i, j) is keyed by half key i of the first and half key j of the second. L = m * m tables so
cost 2 * m * K/2 minimums, about the square root of L * K. Two sets of similarity s meet in a table
with probability (1 - (1 - s^(K/2))^m)^2: 0.9995 at s = 0.75, over 0.99999 at 0.85.

1. Texts with equal sets become one class (a shuffle of signatures, not of texts).
2. Each class is compared with the centres (a few classes of a table) that it meets most often, so a
   group of thousands of near copies costs thousands of pairs, not millions. Verified pairs give
   components; classes that still meet other components are compared with other centres.
3. Tables where classes of different components still meet are searched in full, blocks of members
   against blocks, across components only; lengths and a bitmap of each set bound the overlap from
   above, and only pairs that the bounds allow are verified. A pair comes out of the first table that
   it shares and of no other. No bucket is capped or sampled.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .components import components
from .storage import as_text, stored
from .text import LOWER, mix, rows_of, span_hashes, word_spans

WORDS = 5
#: Half keys of a collection, minimums of a half key, words of a set's bitmap, members of a block.
HALF_KEYS, HALF_WIDTH, BITMAP_WORDS, BLOCK = 10, 2, 32, 512
#: Rounds of few pairs a class before the full search, centres of a table and of a class in a round,
#: and rows of three numbers that may be broadcast.
TURNS, CENTRES, BROADCAST_ROWS = 2, 4, 100_000
#: Similarity as a fraction of integers: link where DEN * common >= NUM * union.
NUM, DEN = 75, 100

_RNG = np.random.default_rng(20240607)
_A = (_RNG.integers(1, 2**63, 2 * HALF_KEYS * HALF_WIDTH, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
_B = _RNG.integers(0, 2**63, 2 * HALF_KEYS * HALF_WIDTH, dtype=np.uint64)
_Q = [np.uint64(pow(0xD6E8FEB86659FD93, k + 1, 1 << 64)) for k in range(WORDS)]
_SEEDS = mix(np.arange(1, 2 * HALF_KEYS + 1, dtype=np.uint64))


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows, hashes): the distinct shingles of each text, ordered by row and hash. A text of fewer than
    five words has one shingle, its whole sequence; a text without words has none."""
    row, start, end = word_spans(data, offsets)
    h = span_hashes(LOWER[data], start, end)
    n = len(offsets) - 1
    count = np.bincount(row, minlength=n)
    out_r, out_h = [], []
    if len(h) >= WORDS:
        full = np.flatnonzero(row[:len(h) - WORDS + 1] == row[WORDS - 1:])
        s = reduce(lambda acc, k: acc + h[full + k] * _Q[k], range(WORDS), np.zeros(len(full), np.uint64))
        out_r.append(row[full])
        out_h.append(mix(s))
    first = np.cumsum(count) - count
    for size in range(1, WORDS):
        short = np.flatnonzero(count == size)
        s = reduce(lambda acc, k: acc + h[first[short] + k] * _Q[k], range(size), np.full(len(short), size, np.uint64) * _SEEDS[0])
        out_r.append(short)
        out_h.append(mix(s))
    r, s = np.concatenate(out_r), np.concatenate(out_h)
    order = np.lexsort((s, r))
    r, s = r[order], s[order]
    fresh = np.ones(len(r), bool)
    fresh[1:] = (r[1:] != r[:-1]) | (s[1:] != s[:-1])
    return r[fresh], s[fresh]


def _per_row(values: np.ndarray, n: int, width: int) -> pa.Array:
    return pa.FixedSizeListArray.from_arrays(pa.array(values.reshape(-1)), width).cast(pa.list_(pa.int64())) if n else pa.array([], pa.list_(pa.int64()))


def signatures(docs: DataFrame, key: str, text: str) -> DataFrame:
    """id, n (set size), p1, p2 (128 bits of the set), halves (2 * HALF_KEYS hashes), bits (bitmap)."""

    def sign(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offsets in rows_of(it, "text"):
            n = len(offsets) - 1
            r, s = shingle_sets(data, offsets)
            count = np.bincount(r, minlength=n)
            some = np.flatnonzero(count)
            first = (np.cumsum(count) - count)[some]
            marks = np.zeros((n, 2), np.uint64)
            mins = np.zeros((n, len(_A)), np.uint64)
            bits = np.zeros((n, BITMAP_WORDS), np.uint64)
            if len(s):
                marks[some, 0] = np.add.reduceat(mix(s ^ _SEEDS[0]), first)
                marks[some, 1] = np.add.reduceat(mix(s ^ _SEEDS[1]), first)
                for i, (a, b) in enumerate(zip(_A, _B)):
                    mins[some, i] = np.minimum.reduceat((s * a + b) >> np.uint64(16), first)
                place = (s >> np.uint64(5)) % np.uint64(64 * BITMAP_WORDS)
                flat = np.zeros(n * 64 * BITMAP_WORDS, np.uint8)
                flat[r * (64 * BITMAP_WORDS) + place.astype(np.int64)] = 1
                bits = np.packbits(flat, bitorder="little").view(np.uint64).reshape(n, BITMAP_WORDS)
            halves = np.zeros((n, 2 * HALF_KEYS), np.uint64)
            for j in range(HALF_WIDTH):
                halves = mix(halves ^ mins[:, j::HALF_WIDTH])
            halves ^= _SEEDS[None, :]
            yield pa.record_batch([part.column("id"), pa.array(count.astype(np.int64)), pa.array(marks[:, 0].view(np.int64)), pa.array(marks[:, 1].view(np.int64)),
                                   _per_row(halves.view(np.int64), n, 2 * HALF_KEYS), _per_row(np.ascontiguousarray(bits).view(np.int64), n, BITMAP_WORDS)],
                                  ["id", "n", "p1", "p2", "halves", "bits"])

    src = docs.select(F.col(key).cast("long").alias("id"), as_text(docs, text).alias("text"))
    return src.mapInArrow(sign, "id long, n long, p1 long, p2 long, halves array<long>, bits array<long>")


def _keys() -> F.Column:
    """Keys of all tables: every pair of a half key of the first and one of the second collection."""
    return F.transform(F.sequence(F.lit(0), F.lit(HALF_KEYS * HALF_KEYS - 1)), lambda t: F.xxhash64(
        t, F.get(F.col("halves"), (t / HALF_KEYS).cast("int")), F.get(F.col("halves"), (t % HALF_KEYS).cast("int") + HALF_KEYS)))


def _few(df: DataFrame) -> DataFrame:
    """The frame of a few numbers a row, to be broadcast if its counted rows allow it."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _similar(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough. `texts` is (id, text).

    Every pair draws its two texts to itself, so pairs of one text are dealt out. Sets are made again from
    the texts, in the task that compares them."""
    ends = pairs.select(F.explode(F.array("a", "b")).alias("id"), "a", "b")
    drawn = texts.join(_few(ends), "id").repartition("a", "b").sortWithinPartitions("a", "b").select("a", "b", "id", "text")

    def close(a: int, b: int, found: list[tuple[int, np.ndarray]]) -> bool:
        for i, x in found:
            for j, y in found:
                common = len(np.intersect1d(x, y, assume_unique=True)) if i == a and j == b else 0
                if common and DEN * common >= NUM * (len(x) + len(y) - common):
                    return True
        return False

    def confirm(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, found, good = None, [], []
        for part, data, offsets in rows_of(it, "text"):
            r, s = shingle_sets(data, offsets)
            sets = np.split(s, np.searchsorted(r, np.arange(1, len(offsets) - 1)))
            for a, b, i, x in zip(*(part.column(c).to_pylist() for c in ("a", "b", "id")), sets):
                if key != (a, b):
                    if key and close(*key, found):
                        good.append(key)
                    key, found = (a, b), []
                found.append((i, x.copy()))
            if len(good) >= 10_000:
                yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*good)], ["a", "b"])
                good = []
        if key and close(*key, found):
            good.append(key)
        if good:
            yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*good)], ["a", "b"])

    return drawn.mapInArrow(confirm, "a long, b long")


def _components_of(met: DataFrame, groups: DataFrame | None) -> DataFrame:
    """Bucket members with their component so far."""
    if groups is None:
        return met.withColumn("component", F.col("id"))
    return met.join(groups.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))


def _sizes_allow(n: str, other: str) -> F.Column:
    return DEN * F.least(n, other) >= NUM * F.greatest(n, other)


def _stars(met: DataFrame, groups: DataFrame | None, turn: int) -> DataFrame:
    """Pairs of each class that meets another component: with the CENTRES centres it meets most often.

    A table's centres are the least classes in CENTRES orders, which change with each turn. What is
    collected for a class is bounded by its tables times CENTRES."""
    known = _components_of(met, groups)
    least = [F.min(F.struct(F.xxhash64("id", F.lit(turn * CENTRES + k)).alias("h"), F.col("id"), F.col("n"), F.col("component"))) for k in range(CENTRES)]
    centre = (known.groupBy("bucket").agg(F.array_distinct(F.array(*least)).alias("c"), F.min("component").alias("low"), F.max("component").alias("high"))
              .where("low < high").select("bucket", "c"))
    apart = (known.join(centre, "bucket").select("id", "n", "component", F.explode("c").alias("c"))
             .where((F.col("component") != F.col("c.component")) & _sizes_allow("n", "c.n"))
             .groupBy("id", F.col("c.id").alias("centre")).agg(F.count("*").alias("times")))
    best = apart.groupBy("id").agg(F.slice(F.sort_array(F.collect_list(F.struct("times", "centre")), asc=False), 1, CENTRES).alias("best"))
    pairs = best.select("id", F.explode("best.centre").alias("centre"))
    return pairs.select(F.greatest("id", "centre").alias("a"), F.least("id", "centre").alias("b")).distinct()


def _first_equal(start: int) -> F.Column:
    """Place of the first half key of a collection that both sides have; null without one."""
    return F.coalesce(*[F.when(F.get("halves", F.lit(start + k)) == F.get("x_halves", F.lit(start + k)), F.lit(k)) for k in range(HALF_KEYS)])


def _rest(met: DataFrame, groups: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs of classes that share a table across components and may be similar enough.

    In a bucket, members outside its largest component are compared with all others, so a settled group
    of thousands meets a stranger once. Members are dealt to salted parts of about BLOCK rows, to which
    the outsiders are copied; conditions run inside the join, so only possible pairs come out, each of
    the first of its common tables. `sets` is (id, halves, bits)."""
    known = _components_of(met, groups)
    counts = known.groupBy("bucket", "component").agg(F.count("*").alias("size"))
    large = counts.groupBy("bucket").agg(F.max_by("component", F.struct("size", "component")).alias("large"), F.sum("size").alias("members"),
                                         F.count("*").alias("kinds")).where("kinds > 1").drop("kinds")
    parts = F.ceil(F.col("members") / BLOCK).cast("int")
    rows = known.join(large, "bucket").join(sets, "id")
    there = rows.select("bucket", F.pmod(F.xxhash64("id"), parts).cast("int").alias("part"), "id", "n", "component", "large", "place", "halves", "bits")
    here = rows.where("component <> large").select(F.explode(F.sequence(F.lit(0), parts - 1)).alias("x_part"),
                                                   *[F.col(c).alias("x_" + c) for c in ("bucket", "id", "n", "component", "halves", "bits")])
    apart = reduce(lambda t, k: t + F.bit_count(F.get("bits", F.lit(k)).bitwiseXOR(F.get("x_bits", F.lit(k)))), range(BITMAP_WORDS), F.lit(0))
    near = ((F.col("component") != F.col("x_component")) & _sizes_allow("n", "x_n")
            # two outsiders meet on both sides
            & ((F.col("component") == F.col("large")) | (F.col("id") < F.col("x_id")))
            & (F.col("place") == _first_equal(0) * HALF_KEYS + _first_equal(HALF_KEYS))
            # each bit that differs stands for an element that only one of the sets has
            & ((DEN - NUM) * (F.col("n") + F.col("x_n")) >= (DEN + NUM) * apart))
    joined = there.join(here, (F.col("bucket") == F.col("x_bucket")) & (F.col("part") == F.col("x_part")) & near)
    return (joined.select(F.greatest("id", "x_id").alias("a"), F.least("id", "x_id").alias("b")).distinct())


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of `docs`.

    Null and empty texts have no shingle and are linked with nothing; component_id is the smallest id
    reachable over links, kept marks it. Repeated rows get the same values. Ids should be unique: rows
    that share an id but not a text each get the component of their own text. A row without id gets the
    component of its text's copies, or null if none has an id, and is never kept. Other columns are
    ignored. No rows give no rows.
    """
    signed = stored(signatures(docs, key, text), "signatures")
    sets = signed.where("n > 0")
    # one class for each set; its id is the smallest document
    classes = sets.where("id is not null").groupBy("p1", "p2", "n").agg(F.min("id").alias("class"))
    member = stored(sets.select("id", "n", "p1", "p2").join(classes, ["p1", "p2", "n"], "left").select("id", "n", "class"), "members")
    reps = sets.join(classes.withColumnRenamed("class", "id"), ["id", "p1", "p2", "n"], "left_semi").dropDuplicates(["id", "p1"])

    # tables in which classes meet
    table = reps.select("id", "n", F.posexplode(_keys()).alias("place", "bucket"))
    bucket = Window.partitionBy("bucket")
    met = stored(table.withColumn("least", F.min("id").over(bucket)).withColumn("most", F.max("id").over(bucket))
                 .where("least < most").select("id", "n", F.col("place").cast("short").alias("place"), "bucket"), "buckets")
    source = docs.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("id"), as_text(docs, text).alias("text"))
    texts = stored(source.join(_few(met.select("id").distinct()), "id", "left_semi"), "texts")

    links, groups = None, None
    for turn in range(TURNS + 1):
        pairs = _stars(met, groups, turn) if turn < TURNS else _rest(met, groups, reps.select("id", "halves", "bits"))
        pairs = stored(pairs if links is None else pairs.join(links, ["a", "b"], "left_anti"), "pairs")
        if turn and not pairs.limit(1).count():
            continue
        fresh = stored(_similar(pairs, texts), "verified")
        links = fresh if links is None else links.union(fresh)
        groups = stored(components(links), "components")

    found = member.join(groups.withColumnRenamed("node", "class"), "class", "left").select(
        F.col("id"), "n", F.coalesce("component", "class").alias("component_id"))
    alone = signed.where("n = 0").select("id", "n", F.col("id").alias("component_id"))
    return found.union(alone).select(F.col("id").alias(key), F.col("n").alias("n_shingles"), "component_id",
                                     F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"))
