"""Ordering, limits and keyset pages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from .sliced import SLICE_MS, Carry, drop_slice, scan, with_slice

ROW_KEY = ("start_utc_ms", "device_id", "id")


def clamp(value: int, low: int, high: int) -> int:
    return max(low, min(int(value), high))


def keyset_page(df: DataFrame, key: Sequence[str], after: Sequence[object] | None, limit: int) -> DataFrame:
    """Rows after a key tuple, in key order, `limit` + 1 of them so the caller sees whether more follow."""
    out = df
    if after is not None:
        typed = [F.lit(v).cast(df.schema[k].dataType).alias(k) for k, v in zip(key, after)]
        out = out.where(F.struct(*key) > F.struct(*typed))
    return out.orderBy(*key).limit(limit + 1)


def claim_queue(chunks: DataFrame, as_of_ms: int, hold_s: float = 20.0, max_attempts: int = 3,
                batch: int | None = 50) -> DataFrame:
    """Pending chunks whose audio ended at least `hold_s` ago, in (device, start, id) order."""
    ready = chunks.where((F.col("status") == "pending") & (F.col("attempts") < max_attempts)
                         & (F.col("end_utc_ms") <= as_of_ms - int(hold_s * 1000)))
    if batch is None:
        return ready
    return ready.orderBy("device_id", "start_utc_ms", "id").limit(batch)


#: Fixed value: what stands for the middle of a text, with a line end on both sides.
OMITTED = "\n[... truncated ...]\n"


def head_and_tail(lines: DataFrame, key: str, order: Sequence[str], line: str, max_chars: int, width: int = SLICE_MS) -> DataFrame:
    """(key, n_rows, text): each key's lines as one text, its middle left out where it is longer than `max_chars` (0: never).

    The first of `order` is a time. Running lengths over its slices say how far a line lies from either end, so only
    lines within the budget meet in one value.
    """
    sized = lines.withColumn("_len", F.char_length(line).cast("bigint") + 1)
    total = sized.groupBy(key).agg(F.count("*").alias("n_rows"), (F.sum("_len") - 1).alias("_total"))
    room = max(0, max_chars - len(OMITTED))
    front, back = room // 2, room - room // 2
    placed = drop_slice(scan(with_slice(sized, order[0], width), [key], order, [Carry("_to", "sum", F.col("_len"))])).join(total, key)
    whole = (F.col("_total") <= max_chars) | F.lit(max_chars <= 0)
    near = placed.withColumn("_whole", whole).withColumn("_front", F.col("_to") - F.col("_len") < front).withColumn("_back", F.col("_total") - F.col("_to") + 1 < back)
    kept = near.where("_whole or _front or _back").groupBy(key).agg(
        F.sort_array(F.collect_list(F.struct(*order, F.col(line).alias("line"), "_front", "_back"))).alias("_l"), F.first("_whole").alias("_whole"))

    def joined(part: str | None) -> Column:
        rows = F.col("_l") if part is None else F.filter("_l", lambda r: r[part])
        return F.array_join(F.transform(rows, lambda r: r["line"]), "\n")

    # The line end beside the last line within the budget counts as a character of the text.
    line_end = F.lit("\n")
    short = F.concat(F.substring(F.concat(joined("_front"), line_end), 1, front), F.lit(OMITTED), F.right(F.concat(line_end, joined("_back")), F.lit(back)))
    # Without room for a single character only the mark is left.
    text = F.when(F.col("_l").isNull(), OMITTED).when(F.col("_whole"), joined(None)).otherwise(short)
    return total.join(kept, key, "left").select(key, "n_rows", text.alias("text"))
