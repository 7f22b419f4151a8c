"""Speech chunks of voice-activity windows, at any length of uninterrupted talk.

Windows become runs; a silent run of `Rules.reset_len` leaves nothing open, so the runs between two of them, a burst,
are chunked on their own. A burst of ordinary length is one group. A long one is cut into blocks that overlap by
what a decision can look ahead and back. What a block does to the chunk that enters it is a table: every chunk that may
enter (behind each pause and each opening near the block's head) with the one that leaves. Chunks that leave
and were not foreseen are followed in another round. Entries are then linked by doubling, and the blocks
on the true path give their chunks.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..functions.speech import FAR, SILENT, Chunk, Open, Rules, Tape, chunks_of
from ..functions.times import floor_div
from ..session import materialise
from .audio import activity_runs
from .folds import map_groups, spread, whole_groups
from .sliced import SLICE, Carry, scan

#: Windows of a burst that one group takes; longer ones go by blocks of BLOCK_WINDOWS.
LONG_WINDOWS = 1 << 20
BLOCK_WINDOWS = 1 << 17

#: An entry: where the open chunk starts, its first speech (-1 behind a cut), time; all -1 where nothing is open yet.
ENTRY = ["start", "speech", "now"]
OUT = ["n_start", "n_end", "cut_reason"]
NOTHING = Open(-1, -1, -1)


def speech_chunks(windows: DataFrame, keys: Sequence[str], rules: Rules | None = None, final: str = "shutdown",
                  n_end: int | None = None) -> DataFrame:
    """(keys, n_start, n_end, cut_reason): speech chunks of dense window streams (keys, idx, prob).

    The audio of a key begins with its first window and ends with its last, for the reason `final`, or at `n_end`.
    """
    rules = rules or Rules()
    tails = windows.select(*keys).distinct().select(*keys, F.lit(final).alias("final"), F.lit(n_end).cast("bigint").alias("n_stop"))
    return chunks_of_bursts(bursts_of(windows, keys, rules, tails if final != "shutdown" or n_end is not None else None), keys, rules)


def bursts_of(windows: DataFrame, keys: Sequence[str], rules: Rules, tails: DataFrame | None = None) -> DataFrame:
    """(keys, _burst, lo, hi, kind, final, n_stop): runs of equal class in samples, numbered by burst, from 0 in each key.

    `tails` (keys, final, n_stop) says why and where a key's audio ends. The table is stored, as it is read several times.
    """
    return bursts_of_runs(activity_runs(windows, keys, rules), keys, rules, tails)


def bursts_of_runs(runs: DataFrame, keys: Sequence[str], rules: Rules, tails: DataFrame | None = None) -> DataFrame:
    """`bursts_of` for runs of `activity_runs` or `joined_runs`."""
    keys = list(keys)
    hard = ((F.col("kind") == SILENT) & (F.col("n") * rules.window >= rules.reset_len)).cast("int")
    # Many run blocks per scan slice: runs are far fewer than windows.
    numbered = scan(runs.withColumn(SLICE, floor_div(SLICE, 64)).withColumn("_hard", hard), keys, ["first_idx"], [Carry("_burst", "sum", F.col("_hard"))])
    lo = F.col("first_idx") * rules.window
    rows = numbered.select(*keys, (F.col("_burst") - F.col("_hard")).alias("_burst"), lo.alias("lo"), (lo + F.col("n") * rules.window).alias("hi"), "kind")
    if tails is not None:
        return materialise(rows.join(tails, keys))
    return materialise(rows.select("*", F.lit("shutdown").alias("final"), F.lit(None).cast("bigint").alias("n_stop")))


def chunks_of_bursts(bursts: DataFrame, keys: Sequence[str], rules: Rules) -> DataFrame:
    """(keys, n_start, n_end, cut_reason) of whole bursts of `bursts_of`."""
    if 2 * rules.pad > rules.min_silence:
        raise ValueError("padding on both sides must fit into the silence between two chunks")
    keys = list(keys)
    ident, ddl = [*keys, "_burst"], ", ".join(f"{k} {bursts.schema[k].dataType.simpleString()}" for k in keys)
    schema = f"{ddl}, n_start bigint, n_end bigint, cut_reason string"

    def whole(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # Bursts are short and many, so they are slices of a batch's arrays and not frames of their own.
        for rows, starts in whole_groups(batches, ident):
            lo, hi, kind, burst, final, stop = (rows[c].to_numpy() for c in ("lo", "hi", "kind", "_burst", "final", "n_stop"))
            at, made = [], []
            for a, b in zip(starts, [*starts[1:], len(rows)]):
                tape = Tape(lo[a:b], hi[a:b], kind[a:b], rules)
                out, o, _, _ = chunks_of(tape, None, -FAR, int(lo[a]) if burst[a] == 0 else -FAR)
                got = _closed(tape, out, o, final[a], stop[a])
                made += got
                at += [a] * len(got)
            frame = pd.DataFrame(made, columns=OUT)
            for k in keys:
                frame[k] = rows[k].to_numpy()[at]
            yield frame[[*keys, *OUT]]

    def at_once(some: DataFrame) -> DataFrame:
        return spread(some, ident).sortWithinPartitions(*ident, "lo").mapInPandas(whole, schema)

    length = (F.max("hi") - F.min("lo")) / rules.window
    long = bursts.groupBy(ident).agg(length.alias("_n")).where(F.col("_n") > LONG_WINDOWS).drop("_n")
    if long.isEmpty():
        return at_once(bursts)
    short = at_once(bursts.join(long, ident, "left_anti"))
    return short.unionByName(_by_blocks(bursts.join(long, ident, "left_semi"), keys, ident, ddl, rules))


def _floor(pdf: pd.DataFrame) -> int:
    """Padding reaches back to the first window of a key's audio, and into the silence before any later burst."""
    return int(pdf["lo"].iloc[0]) if pdf["_burst"].iloc[0] == 0 else -FAR


def _closed(tape: Tape, out: list[Chunk], o: Open | None, final: str, stop: float | None) -> list[tuple]:
    rest = tape.last(o, final, None if pd.isna(stop) else int(stop)) if o is not None else None
    return [(c.n_start, c.n_end, c.cut_reason) for c in [*out, *([rest] if rest else [])]]


def _frame(pdf: pd.DataFrame, ident: list[str], rows: list[tuple], columns: list[str]) -> pd.DataFrame:
    got = pd.DataFrame(rows, columns=columns)
    for k in ident:
        got[k] = pdf[k].iloc[0]
    return got[[*ident, *columns]]


# ------------------------------------------------------------- long bursts


class _Block:
    """The runs around [lo, hi) and the ways through it."""

    def __init__(self, pdf: pd.DataFrame, lo: int, hi: int, reach: int, rules: Rules):
        self.lo, self.hi, self.reach, self.rules, self.runs = lo, hi, reach, rules, pdf
        self.floor = _floor(pdf) if len(pdf) else -FAR
        self.tape = Tape(pdf["lo"], pdf["hi"], pdf["kind"], rules, led=True)
        self.exits: dict[Open, Open | None] = {}

    def usual(self, o: Open) -> Open:
        """The same open chunk with the least time that has the same outcome: behind the middle of a pause, that pause's end."""
        t, w = self.tape, self.rules.window
        k = int(t.quiet.searchsorted(o.start, "right")) - 1
        if o.speech >= 0 or k < 0:
            return o
        begin, back = int(t.quiet[k]), int(t.back[k])
        same = begin + (back - begin) // 2 == o.start and back + w <= o.now and int(t._grid(o.start + self.rules.max_len)) >= o.now + w
        return Open(o.start, -1, back + w) if same else o

    def foreseen(self) -> list[Open]:
        """Chunks that may be the first to start in this block: an opening or the middle of a pause near its head."""
        r, t = self.rules, self.tape
        heads = [Open(max(int(a) - r.pad, self.floor), int(a), int(a) + r.window) for a in t.speech_from]
        closed = t.back < FAR
        size = (t.back - t.quiet)[closed]
        cuts = [Open(int(m), -1, int(b) + r.window) for m, b, n in zip((t.quiet[closed] + size // 2), t.back[closed], size) if n >= r.min_pause]
        return [o for o in heads + cuts if self.lo <= o.start < min(self.hi, self.lo + self.reach)]

    def opened(self, now: int) -> Open | None:
        """What is open next: NOTHING if no speech is in sight, None if the burst ends before."""
        o = self.tape.opening(now, self.floor)
        return self.usual(o) if o is not None else NOTHING if self.tape.end >= self.hi + self.reach else None

    def follow(self, o: Open | None) -> Open | None:
        """The first chunk on the way from `o` that starts behind the block, or NOTHING; None if the burst ends before."""
        way = []
        while self._inside(o) and o not in self.exits:
            way.append(o)
            o = self._next(o)[1]
        end = self.exits.get(o, o)
        self.exits.update(dict.fromkeys(way, end))
        return end

    def _inside(self, o: Open | None) -> bool:
        return o is not None and o != NOTHING and o.start < self.hi

    def _next(self, o: Open) -> tuple[Chunk | None, Open | None, bool]:
        got = self.tape.outcome(o)
        if got is None:
            return None, None, True
        chunk, now, then = got
        return chunk, self.usual(then) if then is not None else self.opened(now), False

    def chunks(self, o: Open | None) -> list[tuple]:
        out = []
        while self._inside(o):
            chunk, then, ended = self._next(o)
            if ended:
                return _closed(self.tape, out, o, self.runs["final"].iloc[0], self.runs["n_stop"].iloc[0])
            out += [chunk] if chunk else []
            o = then
        return [(c.n_start, c.n_end, c.cut_reason) for c in out]


def _by_blocks(runs: DataFrame, keys: list[str], ident: list[str], ddl: str, rules: Rules) -> DataFrame:
    reach = rules.max_len + rules.reset_len + 4 * rules.window  # a decision looks no farther
    size = max(BLOCK_WINDOWS, -(-2 * reach // rules.window)) * rules.window
    block = F.explode(F.sequence(floor_div(F.col("lo") - reach, size), floor_div(F.col("hi") - 1 + reach, size)))
    # Blocks before the first and behind the last window are empty of starts; they come out without rows.
    dealt = materialise(runs.select(*ident, "lo", "hi", "kind", "final", "n_stop", block.alias("block")))
    head = materialise(runs.groupBy(ident).agg(floor_div(F.min("lo"), size).alias("block")))
    node, keyed = [*ident, "block", *ENTRY], f"{ddl}, _burst bigint, block bigint"
    entry_ddl = "start bigint, speech bigint, now bigint"

    def asked(entries: DataFrame) -> DataFrame:
        """Blocks with the entries asked of them, as rows of no kind before the runs."""
        rows = dealt.join(entries.select(*ident, "block").distinct(), [*ident, "block"], "left_semi").select(
            *ident, "block", "lo", "hi", "kind", "final", "n_stop", *[F.lit(None).cast("bigint").alias(c) for c in ENTRY])
        return rows.unionByName(entries.select(*ident, "block", F.lit(-(1 << 62)).alias("lo"), F.lit(0).cast("bigint").alias("hi"),
                                               F.lit(-1).alias("kind"), F.lit("").alias("final"), F.lit(None).cast("bigint").alias("n_stop"), *ENTRY))

    def entered(pdf: pd.DataFrame) -> tuple[_Block, list[Open]]:
        b = int(pdf["block"].iloc[0])
        is_run = pdf["kind"] >= 0
        made = _Block(pdf[is_run], b * size, (b + 1) * size, reach, rules)
        return made, [Open(*(int(x) for x in r)) for r in pdf.loc[~is_run, ENTRY].itertuples(index=False)]

    def links(foresee: bool):
        def fn(pdf: pd.DataFrame) -> pd.DataFrame:
            way, wanted = entered(pdf)
            here, rows = int(pdf["block"].iloc[0]), []
            for e in dict.fromkeys(wanted + (way.foreseen() if foresee else [])):
                end = way.follow(way.opened(way.lo) if e == NOTHING else e)
                at = None if end is None else here + 1 if end == NOTHING else end.start // size
                rows.append((e.start, e.speech, e.now, at, *((end.start, end.speech, end.now) if end is not None else (None, None, None))))
            got = pd.DataFrame(rows, columns=[*ENTRY, "to_block", *(f"to_{c}" for c in ENTRY)])
            for k in [*ident, "block"]:
                got[k] = pdf[k].iloc[0]
            return got.astype({c: "Int64" for c in ("to_block", "to_start", "to_speech", "to_now")})[
                [*ident, "block", *ENTRY, "to_block", *(f"to_{c}" for c in ENTRY)]]

        return fn

    link_ddl = f"{keyed}, {entry_ddl}, to_block bigint, to_start bigint, to_speech bigint, to_now bigint"
    to = ["to_block", *(f"to_{c}" for c in ENTRY)]

    def target(df: DataFrame) -> DataFrame:
        return df.where("to_block is not null").select(*ident, *[F.col(t).alias(c) for t, c in zip(to, ["block", *ENTRY])]).distinct()

    begin = head.select(*node[:-3], *[F.lit(-1).cast("bigint").alias(c) for c in ENTRY])
    # Round one: every block with what may enter it; a block without a foreseen entry has no row.
    blocks = dealt.select(*ident, "block").distinct()
    every = asked(begin).unionByName(asked(blocks.select("*", *[F.lit(None).cast("bigint").alias(c) for c in ENTRY])).where("kind >= 0")).dropDuplicates()
    table = materialise(map_groups(every, [*ident, "block"], "lo", links(True), link_ddl))
    while True:
        missing = materialise(target(table).join(table.select(*node), node, "left_anti"))
        if missing.isEmpty():
            break
        table = materialise(table.unionByName(map_groups(asked(missing), [*ident, "block"], "lo", links(False), link_ddl)))

    reached, jump = begin, table
    while True:  # after k rounds all within 2^k blocks of the head are reached, and a jump leaps 2^k blocks
        more = target(reached.join(jump, node)).join(reached, node, "left_anti")
        more = materialise(more)
        if more.isEmpty():
            break
        reached = materialise(reached.unionByName(more))
        far = jump.select(*ident, *[F.col(t).alias(c) for t, c in zip(to, ["block", *ENTRY])], *[F.col(c).alias(f"_{c}") for c in ["block", *ENTRY]]).where("block is not null")
        jump = materialise(far.join(jump, node).select(*ident, *[F.col(f"_{c}").alias(c) for c in ["block", *ENTRY]], *to))

    def told(pdf: pd.DataFrame) -> pd.DataFrame:
        way, wanted = entered(pdf)
        rows = [c for e in wanted for c in way.chunks(way.opened(way.lo) if e == NOTHING else e)]
        return _frame(pdf, keys, rows, OUT)

    return map_groups(asked(reached), [*ident, "block"], "lo", told, f"{ddl}, n_start bigint, n_end bigint, cut_reason string")
