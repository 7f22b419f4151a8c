"""Ordered scans that never put a whole key into one task.

A window partitioned by device alone sends a busy device's whole history to one task. Here a
key's timeline is cut into slices of fixed width; the window runs inside `(key, slice)`, one
summary row per slice is scanned per key, and the value carried in from earlier slices is joined
back. Per key the second scan sees one row per occupied slice, so its size is bounded by the time
range and not by the number of rows. The summary aggregates before its shuffle, and it is joined
on the columns the rows are already partitioned by, so the rows are shuffled once.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.times import col, floor_div

SLICE_MS = 6 * 3_600_000
SLICE = "_slice"


@dataclass(frozen=True)
class Carry:
    """One running value: `kind` is lag, last, sum, max or max_before."""

    name: str
    kind: str
    value: Column


def with_slice(df: DataFrame, position: Column | str, width: int = SLICE_MS) -> DataFrame:
    return df.withColumn(SLICE, floor_div(col(position), width))


def scan(df: DataFrame, keys: Sequence[str], order: Sequence[str], carries: Sequence[Carry],
         reverse: bool = False) -> DataFrame:
    """Add running values over `keys` ordered by `order`, for a frame that has `_slice`.

    * lag: the previous row's value (never NULL itself);
    * last: the latest non-null value up to and including this row;
    * sum, max: over the rows up to and including this one;
    * max_before: the maximum over the rows strictly before this one.

    `reverse` runs the same scans from the end. `order` must be a total order that agrees with
    the slice number.
    """
    def directed(c: str) -> Column:
        return F.col(c).desc() if reverse else F.col(c).asc()

    local = Window.partitionBy(*keys, SLICE).orderBy(*[directed(c) for c in order])
    upto = local.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = local.rowsBetween(Window.unboundedPreceding, -1)
    rank = F.col(order[0]) if len(order) == 1 else F.struct(*order)
    latest = F.min_by if reverse else F.max_by

    here, per_slice, merged = [], [], []
    for c in carries:
        mine, carried = F.col(f"_l_{c.name}"), F.col(f"_c_{c.name}")
        if c.kind == "lag":
            here.append(F.lag(c.value).over(local))
            per_slice.append(latest(c.value, rank))
            merged.append(F.coalesce(mine, carried))
        elif c.kind == "last":
            here.append(F.last(c.value, ignorenulls=True).over(upto))
            per_slice.append(latest(c.value, F.when(c.value.isNotNull(), rank)))
            merged.append(F.coalesce(mine, carried))
        elif c.kind == "sum":
            here.append(F.sum(c.value).over(upto))
            per_slice.append(F.sum(c.value))
            merged.append(F.coalesce(mine, F.lit(0)) + F.coalesce(carried, F.lit(0)))
        elif c.kind in ("max", "max_before"):
            here.append(F.max(c.value).over(upto if c.kind == "max" else before))
            per_slice.append(F.max(c.value))
            merged.append(F.greatest(mine, carried))
        else:
            raise ValueError(f"unknown scan kind {c.kind}")

    summary = df.groupBy(*keys, SLICE).agg(*[e.alias(f"_s_{c.name}") for e, c in zip(per_slice, carries)])
    along = Window.partitionBy(*keys).orderBy(directed(SLICE))
    earlier = along.rowsBetween(Window.unboundedPreceding, -1)
    fold = {"last": lambda v: F.last(v, ignorenulls=True).over(earlier),
            "lag": lambda v: F.lag(v).over(along),
            "sum": lambda v: F.sum(v).over(earlier),
            "max": lambda v: F.max(v).over(earlier),
            "max_before": lambda v: F.max(v).over(earlier)}
    carried = summary.select(*keys, SLICE, *[fold[c.kind](F.col(f"_s_{c.name}")).alias(f"_c_{c.name}")
                                             for c in carries])
    rows = df.select("*", *[e.alias(f"_l_{c.name}") for e, c in zip(here, carries)])
    joined = rows.join(carried, [*keys, SLICE], "left")
    out = {c.name: m for c, m in zip(carries, merged)}
    return joined.select(*df.columns, *[m.alias(n) for n, m in out.items()])


def drop_slice(df: DataFrame) -> DataFrame:
    return df.drop(SLICE)
