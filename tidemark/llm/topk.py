"""Exact top-k inner-product search with MaxScore over shards of postings.

A dimension is a term, a vector's component its weight. In a shard the contribution of term d to a
query is q[d] * c[d]; its least value over the shard is moved into a base, so that what remains is a
score from 0 to a known bound. Terms are ordered by bound. The essential terms are the fewest whose
remainder cannot lift a vector over the threshold; their postings are traversed for all vectors of
the shard, the others are probed only for vectors that can still reach the k best. Every comparison
is on integers and keeps equals, so the result is exact. A task reads the shards of a group of vectors one after
another for a group of queries; what a query has found so far is its threshold in the next shard. Results of
groups merge by (query).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Vectors of a shard, queries that meet it at once: 2 MB and 0.13 MB at 64 dimensions.
SHARD_ROWS, BLOCK_ROWS = 4096, 256
#: Terms are traversed until no more than this share of a query's bound is left; below it, probes of the few that remain cost less.
LEFT = 1 / 32
#: Queries that a task holds, and their bytes as they are sent. Vectors of a group at least.
QUERY_ROWS, QUERY_BYTES, GROUP_ROWS = 1 << 16, 16 << 20, 1024

HITS = "query_id long, vec_id long, score long"


def _clean(df: DataFrame, key: str, vector: str, is_query) -> DataFrame:
    x = F.col(vector)
    good = x.isNotNull() & F.col(key).isNotNull() & ~F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == F.lit(float("inf"))))
    # null conditions (a null vector) are not good either
    ints = F.transform(x, lambda v: F.floor(v.cast("double") * 1024).cast("long"))
    return df.where(F.coalesce(good, F.lit(False))).select(F.col(key).cast("long").alias("id"), ints.alias("terms"), F.coalesce(is_query, F.lit(False)).alias("asks"))


def _matrix(batches: list[pa.RecordBatch], dims: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(ids, vectors x terms) of rows; a shorter vector has no posting in the missing terms."""
    rows = pa.Table.from_batches(batches).combine_chunks()
    terms = rows.column("terms").combine_chunks()
    lengths, flat = np.asarray(terms.value_lengths()), np.asarray(terms.flatten())
    out = np.zeros((len(lengths), max(dims, int(lengths.max(initial=0)))), flat.dtype)
    out[np.arange(out.shape[1])[None, :] < lengths[:, None]] = flat
    return np.asarray(rows.column("id")), out


def shard_topk(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, postings: np.ndarray, k: int, floors: np.ndarray | None = None,
               known: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """(place of the query, vec_id, score) of each query's k best of the shard by MaxScore; ties to the smaller id.

    `postings` is terms x vectors. Where `known`, `floors` is a score that k vectors of other shards reach, and less is left out.
    """
    big = max(1, int(np.abs(queries).max(initial=0))) * max(1, int(np.abs(postings).max(initial=0))) * max(1, len(postings))
    kind = np.float64 if big < 2**52 else np.int64  # both exact; doubles use the fast product
    post = postings.astype(kind)
    low, high = post.min(axis=1, initial=0), post.max(axis=1, initial=0)
    seeds = min(len(ids), 4 * k + 16)
    out_q, out_v, out_s = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for lo in range(0, len(query_ids), BLOCK_ROWS):
        q = queries[lo:lo + BLOCK_ROWS].astype(kind)
        some_ids, n = query_ids[lo:lo + BLOCK_ROWS], len(q)
        a, b = q * low, q * high
        least, bound = np.minimum(a, b), np.abs(b - a)
        order = np.argsort(-bound, axis=1, kind="stable")
        base = least.sum(axis=1)
        # what terms from i on can still add
        rest = np.append(np.cumsum(np.take_along_axis(bound, order, 1)[:, ::-1], axis=1)[:, ::-1], np.zeros((n, 1), kind), axis=1)
        floor = np.zeros(n, kind) if floors is None else floors[lo:lo + BLOCK_ROWS].astype(kind)
        sure = np.zeros(n, bool) if known is None else known[lo:lo + BLOCK_ROWS].copy()
        for i in np.flatnonzero(~sure):
            first = (q[i] @ post[:, :seeds])[ids[:seeds] != some_ids[i]]
            if len(first) >= k:
                floor[i], sure[i] = np.partition(first, len(first) - k)[len(first) - k], True
        # essential: without them no vector passes the floor; where it is out of reach there are none
        useful = (bound > 0).sum(axis=1)
        essential = np.where(sure, (rest > (floor - base)[:, None]).sum(axis=1), useful)
        hopeless = sure & (base + rest[:, 0] < floor)
        essential = np.minimum(np.maximum(essential, (rest > rest[:, :1] * LEFT).sum(axis=1)), useful)
        leads = np.arange(len(post))[None, :] < essential[:, None]
        lead = np.zeros_like(leads)
        np.put_along_axis(lead, order, leads, 1)
        scores = np.where(lead, q, 0) @ post + (base - np.where(lead, least, 0).sum(axis=1))[:, None]
        reach = scores >= (floor - rest[np.arange(n), essential])[:, None]
        reach[~sure] = True
        reach[hopeless] = False
        for i in np.flatnonzero(reach.any(axis=1)):
            at, alive = essential[i], np.flatnonzero(reach[i])
            alive = alive[ids[alive] != some_ids[i]]
            score, least_floor = scores[i, alive], floor[i] if sure[i] else None
            while at < useful[i] and len(alive):
                to = min(at + 8, useful[i])
                terms = order[i, at:to]
                score = score + q[i, terms] @ post[np.ix_(terms, alive)] - least[i, terms].sum()
                if len(score) >= k:
                    kth = np.partition(score, len(score) - k)[len(score) - k]
                    least_floor = kth if least_floor is None else max(least_floor, kth)
                if least_floor is not None:
                    keep = score + rest[i, to] >= least_floor
                    alive, score = alive[keep], score[keep]
                at = to
            if len(score) > k:
                keep = score >= np.partition(score, len(score) - k)[len(score) - k]
                alive, score = alive[keep], score[keep]
            if len(score):
                best = np.lexsort((ids[alive], -score))[:k]
                out_q.append(np.full(len(best), lo + i, np.int64))
                out_v.append(ids[alive][best])
                out_s.append(score[best].astype(np.int64))
    return np.concatenate(out_q), np.concatenate(out_v), np.concatenate(out_s)


def _best(places: np.ndarray, vecs: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """The k best of each place, in order."""
    order = np.lexsort((vecs, -scores, places))
    places, vecs, scores = places[order], vecs[order], scores[order]
    keep = np.arange(len(places)) - np.searchsorted(places, places, "left") < k
    return places[keep], vecs[keep], scores[keep]


def _search(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Rows (cell, side, id, terms), the queries of a cell before its vectors: the k best of the cell for each of its queries."""
    cell, asked, held, size, queries, found = None, [], [], 0, None, None

    def meet() -> None:
        nonlocal queries, found, held, size
        if queries is None:
            queries = _matrix(asked) if asked else (np.empty(0, np.int64), np.zeros((0, 0), np.int64))
            found = (np.empty(0, np.int64),) * 3
        if held and len(queries[0]):
            ids, mat = _matrix(held, queries[1].shape[1])
            if mat.shape[1] > queries[1].shape[1]:
                queries = queries[0], np.pad(queries[1], ((0, 0), (0, mat.shape[1] - queries[1].shape[1])))
            floors, known = np.zeros(len(queries[0]), np.int64), np.zeros(len(queries[0]), bool)
            last = np.flatnonzero(np.bincount(found[0], minlength=len(floors)) == k)
            floors[last], known[last] = found[2][np.searchsorted(found[0], last, "right") - 1], True
            more = shard_topk(*queries, ids, mat.T, k, floors, known)
            found = _best(*(np.concatenate(both) for both in zip(found, more)), k)
        held, size = [], 0

    def answer() -> Iterator[pa.RecordBatch]:
        meet()
        for lo in range(0, len(found[0]), 10_000):
            q, v, s = (x[lo:lo + 10_000] for x in found)
            yield pa.record_batch([pa.array(queries[0][q]), pa.array(v), pa.array(s)], ["query_id", "vec_id", "score"])

    for batch in batches:
        kinds = np.asarray(batch.column("cell")).astype(np.int64) * 2 + np.asarray(batch.column("side"))
        edges = [0, *(np.flatnonzero(np.diff(kinds)) + 1).tolist(), batch.num_rows]
        for lo, hi in zip(edges, edges[1:]):
            if lo == hi:
                continue
            here, side = divmod(int(kinds[lo]), 2)
            if here != cell:
                if cell is not None:
                    yield from answer()
                cell, asked, held, size, queries, found = here, [], [], 0, None, None
            while lo < hi:
                part = batch.slice(lo, min(hi - lo, SHARD_ROWS - size) if side else hi - lo)
                (held if side else asked).append(part)
                size, lo = size + part.num_rows * side, lo + part.num_rows
                if size == SHARD_ROWS:
                    meet()
    if cell is not None:
        yield from answer()


def top_k(vectors: DataFrame, is_query, k: int = 10, key: str = "vec_id", vector: str = "embedding", shards: int | None = None) -> DataFrame:
    """The k best other vectors of each query by integer inner product of floor(1024 * x).

    `is_query` is a condition on `vectors`. Returns query_id, rank from 1, vec_id, score. A null key, a
    null vector and one with a null or non-finite component take no part; shorter vectors (also empty
    ones) count as filled with zeros; rows with one key are candidates each, and none of them for a
    query with that key; fewer than k others give fewer rows; other columns are ignored. Components must
    fit 64-bit sums of products.

    Queries, a share of the rows, meet every vector: that product is the result's definition. The product is cut
    into cells of a group of vectors (`shards` of them) and a group of queries, and each row is sent to its cells. Queries
    that fit a task are one group, so vectors are sent once; the number of cells follows the shuffle partitions,
    not the rows, so neither the copies of queries nor what the driver knows of the tasks grows with the square of the input.
    """
    spark = vectors.sparkSession
    base = _clean(vectors, key, vector, is_query)
    rows, asking, dims, largest = base.agg(
        F.count("*"), F.count_if("asks"), F.max(F.size("terms")),
        F.max(F.greatest(F.coalesce(F.array_max("terms"), F.lit(0)), -F.coalesce(F.array_min("terms"), F.lit(0))))).first()
    width = next((w for w in (2, 4) if (largest or 0) < 1 << 8 * w - 1), 8)
    groups = max(1, -(-asking // QUERY_ROWS), -(-asking * (dims or 0) * width // QUERY_BYTES))
    n = shards or max(1, min(-(-rows // GROUP_ROWS), -(-2 * int(spark.conf.get("spark.sql.shuffle.partitions")) // groups)))

    sent = base.withColumn("terms", F.col("terms").cast({2: "array<smallint>", 4: "array<int>", 8: "array<bigint>"}[width]))
    group, place = F.pmod(F.xxhash64("id"), F.lit(n)), F.pmod(F.xxhash64("id", F.lit(1)), F.lit(groups))

    def cells(df: DataFrame, side: int, times: int, cell) -> DataFrame:
        all_cells = F.transform(F.sequence(F.lit(0), F.lit(times - 1)), lambda i: cell(i).cast("int"))
        return df.select(F.explode(all_cells).alias("cell"), F.lit(side).alias("side"), "id", "terms")

    dealt = cells(sent.where("asks"), 0, n, lambda i: i * groups + place).unionByName(
        cells(sent, 1, groups, lambda i: group * groups + i)).repartitionById(n * groups, "cell")
    hits = dealt.sortWithinPartitions("cell", "side", "id").mapInArrow(lambda it: _search(it, k), HITS)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    # Spark keeps k rows of each query before the shuffle too
    return hits.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
