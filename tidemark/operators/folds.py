"""Greedy chains over ordered rows, split into blocks.

Packing and overlap removal pick rows one after another, each pick depending on the one before.
Here a key's rows are numbered and cut into blocks of a fixed row count. What a block does to any
incoming state is a step function of one integer, and chains entered at different rows soon run
into each other, so the function has few steps. Pass one computes it per block, a small fold per
key runs through the blocks' steps, pass two replays each block from its known entry. No task ever
holds a key's rows, and the result equals the sequential one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from ..functions.times import floor_div
from .sliced import Carry, drop_slice, scan, with_slice

BLOCK_ROWS = 100_000
FAR = np.int64(1 << 62)


@dataclass
class Links:
    """A block as a chain: `nxt[i]` follows pick i (n when it leaves), `cuts` is sorted and a state x
    enters at the first i with `cuts[i] >= x`, `tail[i]` is the state after a chain that ends at i,
    and a state nothing in the block answers leaves as `x - shift`."""

    nxt: np.ndarray
    cuts: np.ndarray
    tail: np.ndarray
    shift: int


def spread(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Hash partitions in the configured number and one: Python work is far heavier than its bytes suggest,
    so adaptive merging of small partitions would leave it to one task. Of equal number, the shuffle would be left out
    behind a join on the same keys, and what is then a join's own shuffle may be read in pieces that part groups."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) + 1, *keys)


def whole_groups(batches: Iterator[pd.DataFrame], keys: Sequence[str]) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    """Sorted batches, cut anew where a group of `keys` ends: (rows, where each of their groups starts)."""
    def changes(pdf: pd.DataFrame) -> np.ndarray:
        change = np.zeros(len(pdf), bool)
        for k in keys:
            v = pdf[k].to_numpy()
            change[1:] |= v[1:] != v[:-1]
        return change

    held: list[pd.DataFrame] = []
    for pdf in batches:
        if not len(pdf):
            continue
        change = changes(pdf)
        change[0] = bool(held) and any(held[-1][k].iat[-1] != pdf[k].iat[0] for k in keys)
        at = np.flatnonzero(change)
        if not len(at):
            held.append(pdf)
            continue
        ready = pd.concat([*held, pdf.iloc[:at[-1]]], ignore_index=True)
        held = [pdf.iloc[at[-1]:]]
        yield ready, np.flatnonzero(np.append(True, changes(ready)[1:]))
    if held:
        ready = pd.concat(held, ignore_index=True)
        yield ready, np.flatnonzero(np.append(True, changes(ready)[1:]))


def map_groups(df: DataFrame, keys: Sequence[str], order: str, fn: Callable[[pd.DataFrame], pd.DataFrame],
               schema: str) -> DataFrame:
    """Run `fn` on each group of `keys`, rows sorted by `order`.

    Rows stream through sorted partitions and a task holds one batch and one group at a time; against one pandas
    call per shuffle group this keeps many small groups cheap.
    """
    keys = list(keys)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows, starts in whole_groups(batches, keys):
            yield pd.concat([fn(rows.iloc[a:b].reset_index(drop=True)) for a, b in zip(starts, [*starts[1:], len(rows)])], ignore_index=True)

    return spread(df, keys).sortWithinPartitions(*keys, order).mapInPandas(run, schema)


def number_blocks(df: DataFrame, keys: Sequence[str], order: Sequence[str], position: str, width: int,
                  carries: Sequence[Carry] = (), block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Add `_rn` (0-based), `_block` and the given running values, by one sliced scan."""
    numbered = scan(with_slice(df, position, width), keys, order,
                    [Carry("_rn", "sum", F.lit(1).cast("bigint")), *carries])
    return (drop_slice(numbered).withColumn("_rn", F.col("_rn") - 1)
            .withColumn("_block", floor_div("_rn", block_rows)))


def chain(df: DataFrame, keys: Sequence[str], links: Callable[[pd.DataFrame], Links], first: int) -> DataFrame:
    """Add `_owner`, the `_rn` of the pick a row belongs to (its own for a pick, -1 before any).

    `df` comes from `number_blocks`; `first` is the state before the first row. Blocks are read three times by keys of
    several blocks, once by others.
    """
    keys, columns = list(keys), list(df.columns)
    key_schema = ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in keys)

    def steps(pdf: pd.DataFrame) -> pd.DataFrame:
        ln, rn = links(pdf), pdf["_rn"].to_numpy()
        n = len(pdf)
        out = np.empty(n, np.int64)
        last = np.empty(n, np.int64)
        for i in range(n - 1, -1, -1):
            j = ln.nxt[i]
            out[i], last[i] = (ln.tail[i], rn[i]) if j >= n else (out[j], last[j])
        keep = np.ones(n, bool)
        keep[:-1] = (out[1:] != out[:-1]) | (last[1:] != last[:-1])
        reach = int(np.searchsorted(ln.cuts, FAR, side="left"))  # rows past it cannot be entered
        at = np.flatnonzero(keep | (np.arange(n) == reach))
        at = at[at <= reach]
        hi = np.append(ln.cuts[at], FAR)
        frame = {"_hi": hi, "_out": np.append(out[at], np.int64(ln.shift)), "_last": np.append(last[at], -1)}
        for k in keys:
            frame[k] = pdf[k].iloc[0]
        frame["_block"] = pdf["_block"].iloc[0]
        frame["_pass"] = np.append(np.zeros(len(at), bool), True)
        return pd.DataFrame(frame)[[*keys, "_block", "_hi", "_out", "_last", "_pass"]]

    def resolve(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["_block", "_pass", "_hi"])
        x, owner, rows = np.int64(first), np.int64(-1), []
        for block, part in pdf.groupby("_block", sort=True):
            rows.append((block, x, owner))
            hi, skip = part["_hi"].to_numpy(), part["_pass"].to_numpy()
            i = int(np.searchsorted(hi[~skip], x, side="left"))
            if skip[i]:
                x = x - part["_out"].iloc[i]
            else:
                x, owner = part["_out"].iloc[i], part["_last"].iloc[i]
        out = pd.DataFrame(rows, columns=["_block", "_x", "_in_owner"])
        for k in keys:
            out[k] = pdf[k].iloc[0]
        return out[[*keys, "_block", "_x", "_in_owner"]]

    def replay(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows, starts in whole_groups(batches, block):
            owner, entry, before = np.empty(len(rows), np.int64), rows["_x"].to_numpy(), rows["_in_owner"].to_numpy()
            number = rows["_rn"].to_numpy()
            for a, b in zip(starts, [*starts[1:], len(rows)]):
                ln, picked = links(rows.iloc[a:b]), np.full(b - a, -1, np.int64)
                i = int(np.searchsorted(ln.cuts, entry[a], side="left"))
                while i < b - a:
                    picked[i] = number[a + i]
                    i = int(ln.nxt[i])
                owner[a:b] = np.maximum.accumulate(np.maximum(picked, before[a]))
            yield rows[columns].assign(_owner=owner)

    # A key's first block is entered as `first` says; only keys of more blocks have steps to find the other entries by.
    block = [*keys, "_block"]
    many = df.where("_block > 0").select(keys).distinct()
    table = map_groups(df.join(many, keys, "left_semi"), block, "_rn", steps,
                       f"{key_schema}, _block bigint, _hi bigint, _out bigint, _last bigint, _pass boolean")
    entries = map_groups(table, keys, "_block", resolve, f"{key_schema}, _block bigint, _x bigint, _in_owner bigint")
    cols = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema.fields)
    entered = df.join(entries.where("_block > 0"), block, "left").fillna({"_x": int(first), "_in_owner": -1})
    return spread(entered, block).sortWithinPartitions(*block, "_rn").mapInPandas(replay, f"{cols}, _owner bigint")


# ------------------------------------------------------------- overlap removal


def first_of_starts(rows: DataFrame, keys: Sequence[str], start: str, length: str) -> DataFrame:
    """(keys, id, start, length): of rows with one start, in order of id, those that can be kept when overlapping ones go:
    the empty ones before the first that has a length, and that one."""
    full = rows.where(F.col(length) > 0).groupBy(*keys, start).agg(F.min(F.struct("id", length)).alias("_one")).select(
        *keys, "_one.id", start, f"_one.{length}")
    ahead = full.select(*keys, start, F.col("id").alias("_first"))
    empty = rows.where(F.col(length) <= 0).join(ahead, [*keys, start], "left").where("_first is null or id < _first")
    return full.unionByName(empty.select(full.columns))


def drop_overlaps(rows: DataFrame, keys: Sequence[str], start: str = "n_start", length: str = "n_samples",
                  width: int = 16_000 * 3600, block_rows: int = BLOCK_ROWS, distinct: bool = False) -> DataFrame:
    """(keys, id, start, length) of rows kept when every row overlapping the last kept one is dropped.

    Rows go by (start, id). Of rows with one start only the first with a length can be kept, and empty ones
    before it, so the others go before the scan; `distinct` says that no two rows have one start.
    """
    first = rows.select(*keys, "id", start, length) if distinct else first_of_starts(rows, keys, start, length)
    blocks = number_blocks(first, keys, [start, "id"], start, width, block_rows=block_rows)

    def links(pdf: pd.DataFrame) -> Links:
        s = pdf[start].to_numpy()
        e = s + pdf[length].to_numpy()
        nxt = np.maximum(np.searchsorted(s, e, side="left"), np.arange(len(s)) + 1)
        return Links(nxt, s, e, 0)

    done = chain(blocks, keys, links, -int(FAR))
    return done.where("_owner = _rn").select(*keys, "id", start, length)


# ------------------------------------------------------------- window packing


def pack_windows(chunks: DataFrame, window_s: float = 30.0, gap_s: float = 0.3, session_gap_s: float = 300.0,
                 block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Chunks packed into transcription windows, in (start, id) order per device.

    Adds `window_id` (the id of the window's first chunk) , `ord` and `offset_ms` inside it. A
    window holds chunks while their lengths plus a gap between each fit; it breaks on a silence
    longer than `session_gap_s`; a lone longer chunk is its own window.
    """
    limit, gap, session_gap = round(window_s * 1000), round(gap_s * 1000), round(session_gap_s * 1000)
    rows = chunks.select("device_id", "id", "start_utc_ms", "end_utc_ms", "duration_ms")
    blocks = number_blocks(rows, ["device_id"], ["start_utc_ms", "id"], "start_utc_ms", 6 * 3_600_000,
                           [Carry("_prev", "lag", F.col("end_utc_ms"))], block_rows)
    blocks = blocks.withColumn("_break", F.coalesce(F.col("start_utc_ms") - F.col("_prev") > session_gap, F.lit(True)))

    def links(pdf: pd.DataFrame) -> Links:
        # State: one more than the room left, counting each chunk as its length plus one gap.
        room = limit + gap
        n = len(pdf)
        used = np.concatenate([[0], np.cumsum(pdf["duration_ms"].to_numpy() + gap)]).astype(np.int64)
        breaks = np.flatnonzero(pdf["_break"].to_numpy())
        after = np.append(breaks, n)
        at = np.arange(n)
        stop = after[np.searchsorted(after, at, side="right").clip(max=len(after) - 1)]
        nxt = np.minimum(np.maximum(np.searchsorted(used[1:], used[:-1] + room, side="right"), at + 1), stop)
        cuts = used[1:].copy()
        if len(breaks):
            cuts[breaks[0]:] = FAR
        return Links(nxt, cuts, room - (used[n] - used[:-1]) + 1, int(used[n]))

    done = chain(blocks, ["device_id"], links, 0)
    w = Window.partitionBy("device_id", "_owner").orderBy("_rn")  # one window: seconds of audio
    before = F.coalesce(F.sum(F.col("duration_ms") + gap).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return done.select("device_id", "id", "start_utc_ms", "end_utc_ms", "duration_ms", F.first("id").over(w).alias("window_id"),
                       (F.row_number().over(w) - 1).alias("ord"), before.alias("offset_ms"))


def window_spans(packed: DataFrame) -> DataFrame:
    """(window_id, device_id, spans): the packed layout as one array per window, in seconds."""
    span = F.struct(F.col("ord").cast("int").alias("ord"), (F.col("offset_ms") / 1000).alias("off"),
                    ((F.col("offset_ms") + F.col("duration_ms")) / 1000).alias("end"), F.col("id").alias("chunk_id"),
                    F.col("start_utc_ms").alias("chunk_start_utc_ms"), "duration_ms")
    return packed.groupBy("window_id", "device_id").agg(F.sort_array(F.collect_list(span)).alias("spans"))
