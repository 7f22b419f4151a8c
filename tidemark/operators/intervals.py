"""Interval algebra on device timelines: half-open `[start, end)` longs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.times import col, floor_div
from .sliced import SLICE, SLICE_MS, Carry, scan, with_slice

BUCKET_MS = 3_600_000


# ------------------------------------------------------------- predicates


def overlaps_window(lo: Column | int, hi: Column | int, start: str = "start_utc_ms",
                    end: str = "end_utc_ms") -> Column:
    """Row overlaps `[lo, hi)`; a point row counts when it lies inside."""
    s, e, lo, hi = F.col(start), F.col(end), _lit(lo), _lit(hi)
    return (s < hi) & ((e > lo) | ((e == s) & (s >= lo)))


def starts_in(lo: Column | int | None, hi: Column | int | None, start: str = "start_utc_ms") -> Column:
    out = F.lit(True)
    if lo is not None:
        out = out & (F.col(start) >= _lit(lo))
    if hi is not None:
        out = out & (F.col(start) < _lit(hi))
    return out


def touches_range(lo: Column | int | None, hi: Column | int | None, start: str = "start_utc_ms",
                  end: str = "end_utc_ms") -> Column:
    """Closed left edge: `end >= lo and start < hi`."""
    out = F.lit(True)
    if lo is not None:
        out = out & (F.col(end) >= _lit(lo))
    if hi is not None:
        out = out & (F.col(start) < _lit(hi))
    return out


def _lit(v) -> Column:
    return v if isinstance(v, Column) else F.lit(int(v)).cast("bigint")


# ------------------------------------------------------------- pair joins


def interval_join(left: DataFrame, right: DataFrame, keys: Sequence[str], left_span: tuple[str, str],
                  right_span: tuple[str, str], width: int = BUCKET_MS) -> DataFrame:
    """All pairs whose closed extents meet, equal on `keys`; filter further on the result.

    Both sides are spread over time buckets and joined on `(keys, bucket)`, so one device's history
    is many join keys. A pair is produced in one bucket only, the later of the two start buckets,
    hence no de-duplication. The fan-out is `length / width + 1`. Column names must be disjoint
    apart from `keys`.
    """
    (ls, le), (rs, re) = left_span, right_span
    lhs = _spread(left, ls, le, width).withColumn("_lb", floor_div(F.col(ls), width))
    rhs = _spread(right, rs, re, width).withColumn("_rb", floor_div(F.col(rs), width))
    cond = (F.col("_bucket") == F.greatest("_lb", "_rb"))
    return lhs.join(rhs, [*keys, "_bucket"]).where(cond).drop("_bucket", "_lb", "_rb")


def _spread(df: DataFrame, start: str, end: str, width: int) -> DataFrame:
    first, last = floor_div(F.col(start), width), floor_div(F.greatest(F.col(start), F.col(end)), width)
    return df.withColumn("_bucket", F.explode(F.sequence(first, last)))


def first_overlap(left: DataFrame, right: DataFrame, keys: Sequence[str], left_span: tuple[str, str],
                  right_span: tuple[str, str], tie: str, take: Sequence[str], width: int = SLICE_MS) -> DataFrame:
    """Each left row with the first right row, by `(start, tie)`, that strictly overlaps it.

    No pairs are produced. A right row can be the first overlap of something only if its end
    exceeds every earlier end, and along those rows start and end both grow; so the candidate for
    a left row is the smallest such end after its start, found by one backward scan. `take` names
    the right columns to return, in one struct column `hit` (NULL without an overlap).
    """
    (ls, le), (rs, re) = left_span, right_span
    ordered = with_slice(right.select(*keys, F.col(rs).alias("_rs"), F.col(re).alias("_re"),
                                      F.col(tie).alias("_tie"),
                                      F.struct(*take).alias("_hit")), "_rs", width)
    records = (scan(ordered, keys, ["_rs", "_tie"], [Carry("_best", "max_before", F.col("_re"))])
               .where("_best is null or _re > _best"))
    marks = records.select(*keys, F.col("_re").alias("_at"), F.lit(0).alias("_side"),
                           F.struct(F.col("_rs").alias("s"), F.col("_hit").alias("h")).alias("_rec"),
                           F.lit(None).cast(_struct_type(left)).alias("_row"))
    probes = left.select(*keys, F.col(ls).alias("_at"), F.lit(1).alias("_side"),
                         F.lit(None).cast(marks.schema["_rec"].dataType).alias("_rec"),
                         F.struct(*left.columns).alias("_row"))
    both = with_slice(marks.unionByName(probes), "_at", width)
    # Backward: larger positions first; at one position probes before records (strict `end > start`).
    seen = scan(both, keys, ["_at", "_side"], [Carry("_next", "last", F.col("_rec"))], reverse=True)
    out = seen.where("_side = 1").select("_row.*", F.col("_next"))
    hit = F.when(F.col("_next.s") < F.col(le), F.col("_next.h"))
    return out.withColumn("hit", hit).drop("_next")


def _struct_type(df: DataFrame) -> str:
    return df.schema.simpleString()


def as_of(left: DataFrame, right: DataFrame, keys: Sequence[str], left_at: str, right_at: str,
          take: Sequence[str], tie: str | None = None, width: int = SLICE_MS) -> DataFrame:
    """Each left row with the last right row at or before it, as the struct column `hit`."""
    order_tie = F.col(tie).cast("bigint") if tie else F.lit(0).cast("bigint")
    marks = right.select(*keys, F.col(right_at).alias("_at"), F.lit(0).alias("_side"), order_tie.alias("_tie"),
                         F.struct(*take).alias("_rec"), F.lit(None).cast(_struct_type(left)).alias("_row"))
    probes = left.select(*keys, F.col(left_at).alias("_at"), F.lit(1).alias("_side"),
                         F.lit(0).cast("bigint").alias("_tie"),
                         F.lit(None).cast(marks.schema["_rec"].dataType).alias("_rec"),
                         F.struct(*left.columns).alias("_row"))
    both = with_slice(marks.unionByName(probes), "_at", width)
    seen = scan(both, keys, ["_at", "_side", "_tie"], [Carry("hit", "last", F.col("_rec"))])
    return seen.where("_side = 1").select("_row.*", "hit")


# ------------------------------------------------------------- union and difference


def clip_to_slices(df: DataFrame, start: str, end: str, width: int) -> DataFrame:
    """Cut each non-empty interval at slice edges."""
    return (
        df.where(F.col(end) > F.col(start))
        .withColumn(SLICE, F.explode(F.sequence(floor_div(F.col(start), width), floor_div(F.col(end) - 1, width))))
        .withColumn("_a", F.greatest(F.col(start), F.col(SLICE) * width))
        .withColumn("_b", F.least(F.col(end), (F.col(SLICE) + 1) * width))
    )


def edge_deltas(pieces: DataFrame, keys: Sequence[str], flags: Sequence[str]) -> DataFrame:
    """Sum of +1/-1 per instant for every flag column (0/1) of `pieces` with `_a`, `_b`.

    Aggregating per instant happens before the shuffle and bounds a slice by its width in
    milliseconds (or samples), however many intervals fall into it.
    """
    marks = F.explode(F.array(F.struct(F.col("_a").alias("at"), F.lit(1).alias("sign")),
                              F.struct(F.col("_b").alias("at"), F.lit(-1).alias("sign"))))
    return (pieces.withColumn("_m", marks)
            .groupBy(*keys, F.col("_m.at").alias("_at"))
            .agg(*[F.sum(F.col("_m.sign") * F.col(f)).alias(f) for f in flags]))


def covered(df: DataFrame, keys: Sequence[str], start: str, end: str, inside: Column,
            flags: Sequence[str], width: int = SLICE_MS) -> DataFrame:
    """Maximal stretches where `inside`, a predicate over depth columns `d_<flag>`, holds.

    `df` has one interval per row and 0/1 flag columns. Slices are independent because intervals
    are clipped to them; only stretches that touch a slice edge are stitched across slices, at most
    two per slice.
    """
    pieces = clip_to_slices(df.select(*keys, start, end, *flags), start, end, width)
    deltas = edge_deltas(pieces, [*keys, SLICE], flags)
    w = Window.partitionBy(*keys, SLICE).orderBy("_at")
    run = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    depth = deltas.select(*keys, SLICE, "_at", *[F.sum(f).over(run).alias(f"d_{f}") for f in flags])
    state = depth.withColumn("_in", inside).withColumn("_was", F.coalesce(F.lag("_in").over(w), F.lit(False)))
    turns = state.where("_in <> _was").withColumn("_b", F.lead("_at").over(w))
    local = turns.where("_in").select(*keys, SLICE, F.col("_at").alias("_a"), "_b")
    lo, hi = F.col(SLICE) * width, (F.col(SLICE) + 1) * width
    at_edge = (F.col("_a") == lo) | (F.col("_b") == hi)
    inner = local.where(~at_edge).select(*keys, "_a", "_b")
    along = Window.partitionBy(*keys).orderBy("_a")
    edge = (local.where(at_edge)
            .withColumn("_new", F.coalesce((F.lag("_b").over(along) != F.col("_a")).cast("int"), F.lit(1)))
            .withColumn("_g", F.sum("_new").over(along.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
            .groupBy(*keys, "_g").agg(F.min("_a").alias("_a"), F.max("_b").alias("_b")).drop("_g"))
    return inner.unionByName(edge).select(*keys, F.col("_a").alias(start), F.col("_b").alias(end))


def union(df: DataFrame, keys: Sequence[str], start: str = "start_utc_ms", end: str = "end_utc_ms",
          width: int = SLICE_MS) -> DataFrame:
    """Merge touching or overlapping intervals per key; empty ones vanish."""
    flagged = df.select(*keys, start, end, F.lit(1).alias("a"))
    return covered(flagged, keys, start, end, F.col("d_a") > 0, ["a"], width)


def subtract(df: DataFrame, removed: DataFrame, keys: Sequence[str], start: str = "start_utc_ms",
             end: str = "end_utc_ms", width: int = SLICE_MS) -> DataFrame:
    """Union of `df` minus union of `removed`, as maximal stretches."""
    cols = [*keys, start, end]
    both = (df.select(*cols, F.lit(1).alias("a"), F.lit(0).alias("b"))
            .unionByName(removed.select(*cols, F.lit(0).alias("a"), F.lit(1).alias("b"))))
    return covered(both, keys, start, end, (F.col("d_a") > 0) & (F.col("d_b") == 0), ["a", "b"], width)


def clipped_totals(df: DataFrame, buckets: DataFrame, keys: Sequence[str], start: str = "start_utc_ms",
                   end: str = "end_utc_ms", width: int = BUCKET_MS) -> DataFrame:
    """Covered length of each bucket: `sum(least(ends) - greatest(starts))` over the union.

    `buckets` has `bucket_from`, `bucket_to` and, optionally, no key columns; it is a calendar
    grid, bounded by the requested range.
    """
    merged = union(df, keys, start, end)
    pieces = to_buckets(merged, buckets, start, end, width)
    return pieces.groupBy(*keys, "bucket_from", "bucket_to").agg(F.sum(F.col("_b") - F.col("_a")).alias("covered_ms"))


def to_buckets(df: DataFrame, buckets: DataFrame, start: str, end: str, width: int = BUCKET_MS) -> DataFrame:
    """Clip intervals to calendar buckets through a UTC cell equi-join.

    Adds `bucket_from`, `bucket_to`, `_a`, `_b` and `_opens`, which is true on the first piece of
    an interval inside a bucket. A point row gives one piece with `_a = _b`.
    """
    e_last = F.greatest(F.col(start), F.col(end) - 1)
    cells = df.withColumn("_cell", F.explode(F.sequence(floor_div(F.col(start), width), floor_div(e_last, width))))
    grid = buckets.select("bucket_from", "bucket_to").withColumn(
        "_cell", F.explode(F.sequence(floor_div(F.col("bucket_from"), width),
                                      floor_div(F.col("bucket_to") - 1, width))))
    lo = F.greatest(F.col("bucket_from"), F.col("_cell") * width)
    hi = F.least(F.col("bucket_to"), (F.col("_cell") + 1) * width)
    joined = cells.join(grid, "_cell")
    point = F.col(end) <= F.col(start)
    hits = F.when(point, (F.col(start) >= lo) & (F.col(start) < hi)).otherwise(
        (F.col(start) < hi) & (F.col(end) > lo))
    return (joined.where(hits)
            .withColumn("_a", F.greatest(F.col(start), lo))
            .withColumn("_b", F.greatest(F.col("_a"), F.least(F.col(end), hi)))
            .withColumn("_opens", F.col("_a") == F.greatest(F.col(start), F.col("bucket_from")))
            .drop("_cell"))


def coverage(targets: DataFrame, ranges: DataFrame, keys: Sequence[str], lo: str, hi: str,
             start: str, end: str, width: int) -> DataFrame:
    """`targets` plus `is_covered`: one stretch of the union of `ranges` contains `[lo, hi)`."""
    islands = union(ranges, keys, start, end, width).select(
        *keys, F.col(start).alias("_is"), F.col(end).alias("_ie"))
    # Stretches are disjoint, so the one containing the target is the last that starts at or before it.
    found = as_of(targets, islands, keys, lo, "_is", ["_ie"], width=width)
    return found.withColumn("is_covered", (F.col(hi) <= F.col(lo)) |
                            F.coalesce(F.col("hit._ie") >= F.col(hi), F.lit(False))).drop("hit")
