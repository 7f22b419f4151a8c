"""Sample counters anchored to UTC: block timelines, clock steps, offset probes."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.times import floor_div, ns_to_iso
from ..session import materialise
from .folds import map_groups, number_blocks, spread, whole_groups
from .intervals import as_of
from .sliced import Carry, drop_slice, scan, with_slice

NS = 1_000_000_000
BLOCK_SLICE = 1 << 20
Unpack = Callable[[DataFrame], DataFrame]


def samples_to_ns(n: Column, rate: int) -> Column:
    """Sample count to ns, half to even, without passing through a double."""
    if NS % rate == 0:
        return n * (NS // rate)
    return F.bround(n.cast("decimal(20,0)") * NS / rate).cast("bigint")


# ------------------------------------------------------------- block timeline


TIMELINE = ("run_id string, seq bigint, n_start bigint, n_end bigint, epoch bigint, new_epoch boolean, epoch_start_n bigint, lateness_ns bigint, "
            "step_ns bigint, offset_ns bigint, anchor_n bigint, anchor_mono_ns bigint")


def _walk(blocks: DataFrame, tell: Callable[[pd.DataFrame, np.ndarray, dict[str, np.ndarray]], pd.DataFrame], schema: str, unpack: Unpack | None,
          rate: int = 16_000, late_ns: int = 200_000_000, late_blocks: int = 3, step_ns: int = 50_000_000, reref_ns: int = 60 * NS,
          to_end: bool = False) -> DataFrame:
    """What `tell` makes of the blocks of whole stretches: (rows, where their stretches start, columns).

    `blocks`: run_id, seq (order within the run), n_frames, mono_ns, real_ns, adc_latency_ns, overflow. With `unpack`
    a row is a packet: seq is that of its first block, n_frames the sum, only its first block may have an overflow, and what `unpack` reads
    stands in place of the times. It is given sorted packets where they are walked, so that only these are shuffled,
    and returns a row for each block, in order, with seq, n_frames, n_before (frames of the packet before the block), the
    three times and all other columns as they were.

    Sample positions are a sliced sum. An overflow opens an epoch whatever came before, so a run is
    cut there into independent stretches; a stretch is one group, walked from event to event (a
    loss, a new reference, a step) and not block by block, and a batch of rows holds many. A first
    walk leaves one row per stretch; epoch numbers, steps and anchors across stretches come from these
    rows and enter the second walk with the packets. `to_end` adds `_later`, the steps of all later stretches.
    """
    sliced = with_slice(blocks, "seq", BLOCK_SLICE)
    counted = drop_slice(scan(sliced, ["run_id"], ["seq"], [
        Carry("n_start", "sum", F.col("n_frames").cast("bigint")),
        Carry("_part", "sum", F.col("overflow").cast("bigint"))])).withColumn("n_start", F.col("n_start") - F.col("n_frames"))
    stretch = ["run_id", "_part"]
    rows = spread(counted.drop("overflow"), stretch)
    limits = (rate, late_ns, late_blocks, step_ns, reref_ns)

    def in_order(df: DataFrame, more: Sequence[str] = ()) -> DataFrame:
        df = df.sortWithinPartitions(*stretch, "seq")
        df = unpack(df) if unpack else df.withColumn("n_before", F.lit(0))
        return df.select(*stretch, *more, "seq", (F.col("n_start") + F.col("n_before")).alias("n_start"), F.col("n_frames").cast("bigint").alias("n_frames"),
                         "mono_ns", "real_ns", "adc_latency_ns")

    def walked(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[pd.DataFrame, np.ndarray, dict[str, np.ndarray]]]:
        for pdf, starts in whole_groups(batches, stretch):
            yield pdf, starts, _stretches(*(pdf[c].to_numpy(np.int64) for c in ("n_start", "mono_ns", "real_ns", "adc_latency_ns")), starts, *limits)

    def ends(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """How many epochs each stretch holds, its steps, the offset it begins with, the offset and the anchor it ends with."""
        for pdf, starts, got in walked(batches):
            anchors = np.flatnonzero(got["anchored"])
            last = np.append(starts[1:], len(pdf)) - 1
            at = anchors[np.searchsorted(anchors, last, "right") - 1]  # a stretch begins with one
            yield pd.DataFrame({"run_id": pdf["run_id"].to_numpy()[starts], "_part": pdf["_part"].to_numpy()[starts], "_n": got["epoch"][last] + 1,
                                "_first": got["offset_ns"][starts], "_steps": np.add.reduceat(got["step_ns"], starts),
                                "_last": got["offset_ns"][last], "_an": got["anchor_n"][at], "_at": got["anchor_mono_ns"][at]})

    def told(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf, starts, got in walked(batches):
            first = pdf.iloc[starts]
            led, before, n, at = (first[c].to_numpy() for c in ("_led", "_before", "_pn", "_pt"))
            jump = got["offset_ns"][starts] - before
            got["lateness_ns"][starts] = np.where(led, got["lateness_ns"][starts] - at - _ns(first["n_start"].to_numpy() - n, rate), 0)
            got["step_ns"][starts] = np.where(led & (np.abs(jump) > step_ns), jump, 0)
            yield tell(pdf, starts, got)

    parts = materialise(in_order(rows).mapInPandas(
        ends, "run_id string, _part bigint, _n bigint, _first bigint, _steps bigint, _last bigint, _an bigint, _at bigint"))
    carried = scan(with_slice(parts, "_part", BLOCK_SLICE), ["run_id"], ["_part"],
                   [Carry("_upto", "sum", F.col("_n")), Carry("_before", "lag", F.col("_last")),
                    Carry("_pn", "lag", F.col("_an")), Carry("_pt", "lag", F.col("_at"))])
    later = []
    if to_end:
        jump = F.col("_first") - F.col("_before")
        here = F.col("_steps") + F.when(F.abs(jump) > step_ns, jump).otherwise(0)
        carried = scan(carried.withColumn("_steps", here), ["run_id"], ["_part"], [Carry("_on", "sum", F.col("_steps"))], reverse=True)
        later = [(F.col("_on") - F.col("_steps")).alias("_later")]
    # No nulls: pandas would turn the column into doubles.
    carried = carried.select(*stretch, (F.col("_upto") - F.col("_n")).alias("_base"), F.col("_before").isNotNull().alias("_led"), *later,
                             *[F.coalesce(c, F.lit(0)).alias(c) for c in ("_before", "_pn", "_pt")])
    return in_order(rows.join(spread(carried, stretch), stretch), [c for c in carried.columns if c not in stretch]).mapInPandas(told, schema)


def block_timeline(blocks: DataFrame, unpack: Unpack | None = None, **limits: int) -> DataFrame:
    """What each block says about its run: sample range, epoch, loss, clock step, new anchor.

    `blocks`, `unpack` and `limits` are those of `_walk`. Output has run_id, seq, n_start, n_end, epoch, new_epoch, epoch_start_n,
    lateness_ns, step_ns (0 = none), offset_ns and the anchor (anchor_n, anchor_mono_ns) set after the block, if any.
    """
    def tell(pdf: pd.DataFrame, starts: np.ndarray, got: dict[str, np.ndarray]) -> pd.DataFrame:
        out = pdf[["run_id", "seq", "n_start"]].assign(n_end=pdf["n_start"] + pdf["n_frames"], epoch=pdf["_base"].to_numpy() + got["epoch"])
        for c in ("new_epoch", "epoch_start_n", "lateness_ns", "step_ns", "offset_ns"):
            out[c] = got[c]
        for c in ("anchor_n", "anchor_mono_ns"):
            out[c] = pd.arrays.IntegerArray(got[c], ~got["anchored"])
        return out

    return _walk(blocks, tell, TIMELINE, unpack, **limits)


def block_anchors(blocks: DataFrame, unpack: Unpack | None = None, **limits: int) -> DataFrame:
    """The anchors of a timeline (run_id, epoch, n_ref, mono_ref_ns) without its blocks; `new_epoch` marks the first of an epoch,
    `offset_ns` is that of `epoch_offsets`, and the sum of `n_steps` over a run counts its steps."""
    def tell(pdf: pd.DataFrame, starts: np.ndarray, got: dict[str, np.ndarray]) -> pd.DataFrame:
        steps = np.zeros(len(pdf), np.int64)
        steps[starts] = np.add.reduceat((got["step_ns"] != 0).astype(np.int64), starts)  # a stretch begins with an anchor
        at = got["anchored"]
        return pd.DataFrame({"run_id": pdf["run_id"].to_numpy()[at], "epoch": (pdf["_base"].to_numpy() + got["epoch"])[at], "n_ref": got["anchor_n"][at],
                             "mono_ref_ns": got["anchor_mono_ns"][at], "new_epoch": got["new_epoch"][at], "offset_ns": _later_offsets(pdf, starts, got)[at],
                             "n_steps": steps[at]})

    return _walk(blocks, tell, "run_id string, epoch bigint, n_ref bigint, mono_ref_ns bigint, new_epoch boolean, offset_ns bigint, n_steps bigint", unpack,
                 to_end=True, **limits)


def block_times(blocks: DataFrame, unpack: Unpack | None = None, **limits: int) -> DataFrame:
    """`sample_times` of the first sample of each block (run_id, seq, epoch, n, mono_ns, utc_ns, start_utc).

    An epoch lies within its stretch, so its anchors are at hand where its blocks are walked, and blocks are not shuffled for them.
    """
    rate = limits.get("rate", 16_000)

    def tell(pdf: pd.DataFrame, starts: np.ndarray, got: dict[str, np.ndarray]) -> pd.DataFrame:
        n = pdf["n_start"].to_numpy()
        anchor = _anchor_rows(n, starts, got)
        mono = got["anchor_mono_ns"][anchor] + _ns(n - got["anchor_n"][anchor], rate)
        return pd.DataFrame({"run_id": pdf["run_id"], "seq": pdf["seq"], "epoch": pdf["_base"].to_numpy() + got["epoch"], "n": n,
                             "mono_ns": mono, "utc_ns": mono + _later_offsets(pdf, starts, got)})

    got = _walk(blocks, tell, "run_id string, seq bigint, epoch bigint, n bigint, mono_ns bigint, utc_ns bigint", unpack, to_end=True, **limits)
    return got.withColumn("start_utc", ns_to_iso("utc_ns"))


def _later_offsets(pdf: pd.DataFrame, starts: np.ndarray, got: dict[str, np.ndarray]) -> np.ndarray:
    """Of each block's epoch: its own offset plus every later step of the run."""
    opens = np.flatnonzero(got["new_epoch"])
    mine = opens[np.cumsum(got["new_epoch"]) - 1]  # the block that opened it
    upto = np.cumsum(got["step_ns"])
    last = np.append(starts[1:], len(pdf)) - 1
    to_end = np.repeat(upto[last], np.diff(np.append(starts, len(pdf))))
    return got["offset_ns"][mine] + to_end - upto[mine] + pdf["_later"].to_numpy()


def _anchor_rows(n: np.ndarray, starts: np.ndarray, got: dict[str, np.ndarray]) -> np.ndarray:
    """The row that set each block's anchor: of its epoch, the last one at or before its sample, the first if there is none."""
    change = np.append(True, n[1:] != n[:-1])
    change[starts] = True
    place, epoch = np.cumsum(change), np.cumsum(got["new_epoch"])
    rows = np.flatnonzero(got["anchored"])
    size = len(n) + 1
    keys = epoch[rows] * size + place[got["anchor_row"][rows]]  # in order: references of an epoch only move on
    at = np.searchsorted(keys, epoch * size + place, "right") - 1
    return rows[np.maximum(at, np.searchsorted(epoch[rows], epoch, "left"))]


def _ns(n: np.ndarray, rate: int) -> np.ndarray:
    """`samples_to_ns` of an array."""
    if NS % rate == 0:
        return n * (NS // rate)
    whole, rest = np.divmod(n, rate)
    q, r = np.divmod(rest * NS, rate)
    return whole * NS + q + ((2 * r > rate) | ((2 * r == rate) & (q % 2 == 1)))


def _first(found: Callable[[int, int], np.ndarray], lo: int, hi: int, size: int = 4096) -> int:
    """The first place in [lo, hi) where `found(a, b)` holds, `hi` without one."""
    while lo < hi:
        at = np.flatnonzero(found(lo, min(lo + size, hi)))
        if len(at):
            return lo + int(at[0])
        lo += size
    return hi


def _stretches(n: np.ndarray, mono: np.ndarray, real: np.ndarray, latency: np.ndarray, starts: np.ndarray, *limits: int) -> dict[str, np.ndarray]:
    """The columns of the stretches that begin at `starts`; what follows from the stretch before is left out."""
    t, offset = mono - latency, real - mono
    got = {c: np.zeros(len(n), np.int64) for c in ("epoch", "lateness_ns", "step_ns", "anchor_n", "anchor_mono_ns", "anchor_row")}
    got |= {"epoch_start_n": n.copy(), "offset_ns": offset.copy(), "new_epoch": np.zeros(len(n), bool), "anchored": np.zeros(len(n), bool)}
    for a, b in zip(starts, [*starts[1:], len(n)]):
        _stretch(n[a:b], t[a:b], offset[a:b], {c: v[a:b] for c, v in got.items()}, *limits)
        got["anchor_row"][a:b] += a
    return got


def _stretch(n: np.ndarray, t: np.ndarray, offset: np.ndarray, got: dict[str, np.ndarray], rate: int, late_ns: int, late_blocks: int, step_ns: int,
             reref_ns: int) -> None:
    """Fill the columns of one stretch. Between two events the reference stands still, so a block's lateness is one subtraction."""
    size = len(n)
    reach = np.maximum.accumulate(t)  # when a time is first passed
    opens, moves = {0: 0}, {0: 0}  # at a block: the block its epoch starts with, the block referred to from now on
    lateness = got["lateness_ns"]
    lateness[0] = t[0]
    done, ref, since, late = 1, 0, int(t[0]), 0
    while done < size:
        due = int(reach.searchsorted(since + reref_ns, "left"))
        end = min(max(due, done) + 1, size)
        part = t[done:end] - (t[ref] + _ns(n[done:end] - n[ref], rate))
        over, lost = part > late_ns, ()
        if over.any():
            place = np.arange(1, len(part) + 1)
            length = place - np.maximum.accumulate(np.where(over, -late, place))  # late blocks in a row, up to here
            lost = np.flatnonzero(length >= late_blocks)
            run = int(length[-1])
        else:
            run = 0
        if len(lost):
            end = done + int(lost[0]) + 1
            ref = end - late_blocks
            opens[end - 1] = moves[end - 1] = ref
            since, late = int(t[ref]), 0
        else:
            late = run
            if end - 1 == max(due, done):
                best = done + int(part.argmin())
                if n[best] > n[ref]:
                    ref = moves[end - 1] = best
                since = int(t[end - 1])
        lateness[done:end] = part[:end - done]
        done = end
    opened, step, level = got["new_epoch"], got["step_ns"], got["offset_ns"]
    opened[list(opens)] = True
    np.cumsum(opened, out=got["epoch"])
    got["epoch"] -= 1
    got["epoch_start_n"][list(opens)] = n[list(opens.values())]
    heads = [*opens, size]
    for a, b in zip(heads, heads[1:]):  # a step changes the level until the next; an epoch begins at its own
        now, at = int(offset[a]), a + 1
        level[a] = now
        stop = min(b + 1, size)  # the block that opens the next epoch is still measured against this one
        while at < stop:
            k = _first(lambda i, j: np.abs(offset[i:j] - now) > step_ns, at, stop)
            level[at:k] = now
            if k < stop:
                step[k], now = offset[k] - now, int(offset[k])
                level[k] = now
            at = k + 1
        if b < size:
            level[b] = offset[b]
    got["anchored"][list(moves)] = True
    for column, values in (("anchor_n", n), ("anchor_mono_ns", t), ("anchor_row", np.arange(size))):
        got[column][list(moves)] = values[list(moves.values())]


def epoch_offsets(timeline: DataFrame) -> DataFrame:
    """(run_id, epoch, offset_ns): an epoch's own offset plus every later clock step of its run."""
    own = timeline.where("new_epoch").select("run_id", "epoch", "seq", F.col("offset_ns").alias("_own"))
    steps = timeline.where("step_ns <> 0").select("run_id", "seq", "step_ns")
    both = (own.select("run_id", "seq", F.lit(0).cast("bigint").alias("step_ns"), F.lit(0).alias("_side"), "epoch", "_own")
            .unionByName(steps.select("run_id", "seq", "step_ns", F.lit(1).alias("_side"),
                                      F.lit(None).cast("bigint").alias("epoch"), F.lit(None).cast("bigint").alias("_own"))))
    # Backward: a step at the opening block itself is already in the epoch's own offset.
    later = scan(with_slice(both, "seq", BLOCK_SLICE), ["run_id"], ["seq", "_side"],
                 [Carry("_later", "sum", F.col("step_ns"))], reverse=True)
    same = steps.select("run_id", "seq", F.col("step_ns").alias("_same"))
    return (later.where("_side = 0").join(same, ["run_id", "seq"], "left")
            .select("run_id", "epoch", (F.col("_own") + F.col("_later") - F.coalesce("_same", F.lit(0))).alias("offset_ns")))


def marks_of(timeline: DataFrame) -> DataFrame:
    """The blocks that `anchors_of`, `epoch_offsets` and a count of steps read: far fewer than all."""
    return timeline.where("anchor_n is not null or new_epoch or step_ns <> 0")


def anchors_of(timeline: DataFrame) -> DataFrame:
    return timeline.where("anchor_n is not null").select(
        "run_id", "epoch", F.col("anchor_n").alias("n_ref"), F.col("anchor_mono_ns").alias("mono_ref_ns"))


def sample_times(samples: DataFrame, anchors: DataFrame, offsets: DataFrame, rate: int = 16_000) -> DataFrame:
    """`samples` (run_id, epoch, n, ...) plus mono_ns, utc_ns and the ISO stamp.

    A sample maps through the last anchor at or before it, the first one if there is none.
    """
    return (_stamped(samples, anchors, _epochs(anchors, offsets), rate, "inner")
            .withColumn("start_utc", ns_to_iso("utc_ns")).drop("hit", "_first", "offset_ns"))


def _epochs(anchors: DataFrame, offsets: DataFrame) -> DataFrame:
    first = anchors.groupBy("run_id", "epoch").agg(F.min(F.struct("n_ref", "mono_ref_ns")).alias("_first"))
    return first.join(offsets, ["run_id", "epoch"])


def _stamped(samples: DataFrame, anchors: DataFrame, epochs: DataFrame, rate: int, how: str) -> DataFrame:
    got = as_of(samples, anchors, ["run_id", "epoch"], "n", "n_ref", ["n_ref", "mono_ref_ns"], width=rate * 3600)
    ref = F.coalesce("hit", "_first")
    mono = ref["mono_ref_ns"] + samples_to_ns(F.col("n") - ref["n_ref"], rate)
    return got.join(epochs, ["run_id", "epoch"], how).withColumn("mono_ns", mono).withColumn("utc_ns", F.col("mono_ns") + F.col("offset_ns"))


def restamp_held(held: DataFrame, anchors: DataFrame, offsets: DataFrame, step_counts: DataFrame) -> DataFrame:
    """Held chunks (run_id, epoch, n, id, start_utc, held_steps) stamped again after a sync.

    Chunks of a known run and epoch get the corrected start, `clock_synced` and, when the run saw
    steps since the hold, `clock_step`; others pass unchanged. A chunk meets what its epoch needs in one join.
    """
    epochs = _epochs(anchors, offsets).join(step_counts.select("run_id", "step_count"), "run_id", "left")
    out = _stamped(held.select("id", "run_id", "epoch", "n", "start_utc", "held_steps"), anchors, epochs, 16_000, "left")
    mine = F.col("utc_ns").isNotNull()
    return out.select("id", "run_id", "epoch", "n", F.coalesce(ns_to_iso("utc_ns"), F.col("start_utc")).alias("start_utc"), mine.alias("clock_synced"),
                      (mine & (F.coalesce("step_count", F.lit(0)) > F.col("held_steps"))).alias("clock_step"))


# ------------------------------------------------------------- offset probes


def probe_offsets(probes: DataFrame, max_rtt_ns: int = 5 * NS, valid_ns: int = 600 * NS,
                  block_rows: int = 100_000) -> DataFrame:
    """Accepted probes (device_id, seq, t_send, t_recv, server_ns) with the offset kept after each.

    The first accepted probe takes the midpoint; each later one clamps the kept offset into what it
    proves. Clamps compose into one clamp, so a block of rows is a pair of bounds and blocks are
    folded independently.
    """
    rtt = F.col("t_recv") - F.col("t_send")
    usable = probes.where((rtt >= 0) & (rtt <= max_rtt_ns))
    rows = number_blocks(usable, ["device_id"], ["seq"], "seq", BLOCK_SLICE, block_rows=block_rows)
    first = F.col("_rn") == 0
    middle = F.col("server_ns") - (F.col("t_send") + floor_div(rtt, 2))
    rows = (rows.withColumn("_lo", F.when(first, middle).otherwise(F.col("server_ns") - F.col("t_recv")))
            .withColumn("_hi", F.when(first, middle).otherwise(F.col("server_ns") - F.col("t_send"))))

    def compose(pdf: pd.DataFrame) -> pd.DataFrame:
        lo = hi = None
        for a, b in pdf[["_lo", "_hi"]].itertuples(index=False):
            lo, hi = (a, b) if lo is None else (min(max(lo, a), b), min(max(hi, a), b))
        return pd.DataFrame({"device_id": [pdf["device_id"].iloc[0]], "_block": [pdf["_block"].iloc[0]],
                             "_blo": [lo], "_bhi": [hi]})

    def enter(pdf: pd.DataFrame) -> pd.DataFrame:
        x, entry = 0, []
        for lo, hi in pdf[["_blo", "_bhi"]].itertuples(index=False):
            entry.append(x)
            x = min(max(x, lo), hi)
        return pdf.assign(_x=entry)[["device_id", "_block", "_x"]]

    def replay(pdf: pd.DataFrame) -> pd.DataFrame:
        x, kept = pdf["_x"].iloc[0], []
        for lo, hi in pdf[["_lo", "_hi"]].itertuples(index=False):
            x = min(max(x, lo), hi)
            kept.append(x)
        return pdf.assign(offset_ns=kept)[["device_id", "seq", "t_send", "t_recv", "server_ns", "offset_ns"]]

    block = ["device_id", "_block"]
    bounds = map_groups(rows, block, "_rn", compose, "device_id string, _block bigint, _blo bigint, _bhi bigint")
    entry = map_groups(bounds, ["device_id"], "_block", enter, "device_id string, _block bigint, _x bigint")
    done = map_groups(spread(rows, block).join(entry, block), block, "_rn", replay,
                      "device_id string, seq bigint, t_send bigint, t_recv bigint, server_ns bigint, offset_ns bigint")
    return done.withColumn("rtt_ns", rtt).withColumn("synced_until_ns", F.col("t_recv") + valid_ns)
