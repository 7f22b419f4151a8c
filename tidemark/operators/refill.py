"""Chunks of stored voice-activity segments: at once, behind late segments, and for a range redone in place."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.speech import Rules
from ..session import materialise
from .audio import EPOCH, SAMPLE_SLICE, activity_class, free_stretches, joined_runs, refill_chunks, reprocess_extent
from .chunking import bursts_of_runs, chunks_of_bursts
from .folds import drop_overlaps
from .generations import Generations
from .intervals import first_overlap
from .sliced import Carry, drop_slice, scan, with_slice

SEGMENTS = "device_id string, run_id string, epoch bigint, first_idx bigint, probs array<double>, ends string, n_end bigint"
CHUNKS = "device_id string, run_id string, epoch bigint, n_start bigint, n_end bigint, cut_reason string"
CHAIN = [*EPOCH, "chain"]
WINDOW_SLICE = 1 << 17


def run_lengths(segments: DataFrame, rules: Rules) -> DataFrame:
    """Segments (SEGMENTS) as (EPOCH, first_idx, n, body); `body` holds the runs (at, n, kind) of the windows, far fewer
    than these, and how the segment ends."""
    def stored(df: DataFrame) -> DataFrame:  # a lambda reads values and does not evaluate the step before for each element
        return df.select(F.inline(F.array(F.struct(*df.columns))))

    n = F.size("probs")
    kinds = stored(segments.where(n > 0).select(*EPOCH, "first_idx", n.alias("n"), F.transform("probs", lambda p: activity_class(p, rules)).alias("kinds"), "ends", "n_end"))
    first = F.filter(F.sequence(F.lit(0), F.col("n") - 1), lambda i: (i == 0) | (F.get("kinds", i) != F.get("kinds", i - 1)))
    runs = F.transform("first", lambda a, j: F.struct(
        a.cast("bigint").alias("at"), (F.coalesce(F.get("first", j + 1), F.col("n")) - a).cast("bigint").alias("n"), F.get("kinds", a).alias("kind")))
    return stored(kinds.withColumn("first", first)).select(*EPOCH, "first_idx", F.col("n").cast("bigint").alias("n"), F.struct(runs.alias("runs"), "ends", "n_end").alias("body"))


def chained(segments: DataFrame) -> DataFrame:
    """Segments of `run_lengths` with `chain`, the first window of their contiguous run.

    Of segments with one start the longest stays; one that overlaps the last kept one is dropped.
    """
    # Stored, as each scan reads its rows twice.
    best = materialise(segments.groupBy(*EPOCH, "first_idx").agg(F.max_by("body", "n").alias("body"), F.max("n").alias("n")))

    def behind(rows: DataFrame) -> DataFrame:
        """Rows with `_prev`, the farthest end of those before."""
        spans = with_slice(rows.select(*EPOCH, "first_idx", (F.col("first_idx") + F.col("n")).alias("_to")), "first_idx", WINDOW_SLICE)
        return scan(spans, EPOCH, ["first_idx"], [Carry("_prev", "max_before", F.col("_to"))])

    rows = materialise(behind(best))
    if not rows.where("first_idx < _prev").isEmpty():
        rows = materialise(behind(best.join(_kept(rows), [*EPOCH, "first_idx"], "left_semi")))
    opened = rows.withColumn("_open", F.when(F.col("_prev").isNull() | (F.col("_prev") != F.col("first_idx")), F.col("first_idx")))
    out = drop_slice(scan(opened, EPOCH, ["first_idx"], [Carry("chain", "last", F.col("_open"))]))
    return best.join(out.select(*EPOCH, "first_idx", "chain"), [*EPOCH, "first_idx"]).select(*CHAIN, "first_idx", "n", "body.runs", "body.ends", "body.n_end")


def _kept(rows: DataFrame) -> DataFrame:
    """(EPOCH, first_idx) of rows that do not overlap the last kept one. A row that begins behind all before it is kept, so
    only where others overlap it and follow it is there anything to fold."""
    lone = F.col("_prev").isNull() | (F.col("_prev") <= F.col("first_idx"))
    met = materialise(scan(rows.withColumn("_head", F.when(lone, F.col("first_idx"))), EPOCH, ["first_idx"], [Carry("_group", "last", F.col("_head"))]))
    group = [*EPOCH, "_group"]
    crossed = met.where("_head is null").select(group).distinct()
    n = (F.col("_to") - F.col("first_idx")).alias("n")
    folded = drop_overlaps(met.join(crossed, group, "left_semi").select(*EPOCH, "first_idx", n, F.lit(0).cast("bigint").alias("id")), EPOCH, "first_idx", "n", WINDOW_SLICE, distinct=True)
    return met.join(crossed, group, "left_anti").select(*EPOCH, "first_idx").unionByName(folded.select(*EPOCH, "first_idx"))


def _bursts(chain: DataFrame, rules: Rules) -> DataFrame:
    chain = materialise(chain)
    runs = chain.select(*CHAIN, "first_idx", F.explode("runs").alias("r")).select(*CHAIN, (F.col("first_idx") + F.col("r.at")).alias("first_idx"), "r.n", "r.kind")
    tails = chain.groupBy(CHAIN).agg(F.max_by(F.struct("ends", "n_end"), "first_idx").alias("t")).select(
        *CHAIN, F.coalesce("t.ends", F.lit("shutdown")).alias("final"), F.col("t.n_end").alias("n_stop"))
    return bursts_of_runs(joined_runs(runs, CHAIN), CHAIN, rules, tails)


def segment_chunks(segments: DataFrame, rules: Rules | None = None) -> DataFrame:
    """CHUNKS of all segments in one pass; a gap ends a chain, as the end of the epoch does."""
    rules = rules or Rules()
    return chunks_of_bursts(_bursts(chained(run_lengths(segments, rules)), rules), CHAIN, rules).drop("chain")


def refilled(segments: DataFrame, chunks: DataFrame, late: DataFrame, rules: Rules | None = None) -> tuple[DataFrame, DataFrame]:
    """(slices, rows): the epochs that `late` (EPOCH, lo, hi in samples) touches, and all their chunks after the fill.

    `segments` holds the late ones as well. A late segment joins the bursts around it; between two silences that
    reset everything nothing else can change, so only bursts that meet the late samples, or whose padding reaches
    them, are chunked again, and all other chunks of the slices stay. The result is that of one pass over all segments.
    """
    rules = rules or Rules()
    late = late.select(*EPOCH, "lo", "hi").distinct()
    slices = late.select(*EPOCH).distinct()
    bursts = _bursts(chained(run_lengths(segments, rules).join(slices, EPOCH, "left_semi")), rules)
    ident = [*CHAIN, "_burst"]
    reach = bursts.groupBy(ident).agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).withColumn("id", F.xxhash64(*ident))
    near = materialise(first_overlap(reach.withColumn("_from", F.col("lo") - rules.pad - 1).withColumn("_to", F.col("hi") + 1), late.select(*EPOCH, F.col("lo").alias("_ls"), F.col("hi").alias("_le"), F.lit(0).alias("lid")),
                         EPOCH, ("_from", "_to"), ("_ls", "_le"), "lid", ["lid"], SAMPLE_SLICE).where("hit is not null").select(*ident, "lo", "hi"))
    again = chunks_of_bursts(bursts.join(near.select(ident), ident, "left_semi"), CHAIN, rules).drop("chain")
    # A chunk belongs to the burst that its end lies in.
    old = chunks.join(slices, EPOCH, "left_semi").withColumn("_e0", F.col("n_end") - 1)
    gone = first_overlap(old, near.select(*EPOCH, F.col("lo").alias("_ls"), F.col("hi").alias("_le"), F.lit(0).alias("lid")), EPOCH, ("_e0", "n_end"), ("_ls", "_le"),
                         "lid", ["lid"], SAMPLE_SLICE)
    names = [c.split()[0] for c in CHUNKS.split(", ")]
    return slices, gone.where("hit is null").select(names).unionByName(again.select(names))


def merge_late(table: Generations, segments: DataFrame, rules: Rules | None = None, first_generation: int = 1):
    """A `foreachBatch` function for the rows of `streaming.segments.chunk_stream`: chunks are added to their slices, late
    notices refill theirs. `segments` is the stored segments, which reach the store before the stream sees them, as a
    callable. A batch is one generation, so that a replayed one changes nothing."""
    def merge(batch: DataFrame, batch_id: int) -> None:
        spark, generation = batch.sparkSession, first_generation + batch_id
        if table.swapped(spark, generation) or batch.isEmpty():
            return
        names = [c.split()[0] for c in CHUNKS.split(", ")]
        now = table.read(spark).select(names)
        touched = batch.select(*EPOCH).distinct()
        rows = now.join(touched, EPOCH, "left_semi").unionByName(batch.where("kind = 'chunk'").select(names))
        late = batch.where("kind = 'late'").select(*EPOCH, F.col("n_start").alias("lo"), F.col("n_end").alias("hi"))
        if not late.isEmpty():
            slices, filled = refilled(segments(spark), rows, late, rules)
            rows = rows.join(slices, EPOCH, "left_anti").unionByName(filled)
        table.swap(touched, rows, generation)

    return merge


# ------------------------------------------------------------- a range redone


def redone(raw: DataFrame, derived: DataFrame, cuts: DataFrame, progress: DataFrame | None, device_id: str, from_ms: int | None = None,
           to_ms: int | None = None, min_speech: int = 4_000) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(extents, rows, reopened): a device's raw rows that start in `[from, to)`, segmented anew.

    Extents are those of `reprocess_extent`. Derived chunks that meet one go; where it is a tail, all that end behind
    its start. `cuts` (CHUNKS), the new decisions over the chain's windows, fill what is free between the
    survivors, clipped as late fills are. `rows` are all chunks of the touched epochs afterwards (`fresh` marks the new
    ones), `reopened` the ids of raw rows that go back to pending.
    """
    chunk = derived.select(*EPOCH, "n_start", (F.col("n_start") + F.col("n_samples")).alias("n_end"), "cut_reason")
    ext = reprocess_extent(raw, derived, progress, device_id, from_ms, to_ms)
    span = ext.withColumn("n_hi", F.when(F.col("is_tail"), F.lit(1 << 60)).otherwise(F.col("n_hi")))
    met = (F.col("n_start") < F.col("n_hi")) & (F.col("n_end") > F.col("n_lo"))
    survivors = chunk.join(span, EPOCH).where(~met).select(chunk.columns)
    mine = raw.join(span, EPOCH).withColumn("n_end", F.col("n_start") + F.col("n_samples")).where(met)
    # In place whole raw rows are filled; a tail is replayed from its start.
    inside = mine.select(*EPOCH, F.when(F.col("is_tail"), F.greatest("n_start", "n_lo")).otherwise(F.col("n_start")).alias("n_start"), "n_end")
    free = free_stretches(inside.withColumn("n_samples", F.col("n_end") - F.col("n_start")),
                          survivors.withColumn("n_samples", F.col("n_end") - F.col("n_start")))
    fresh = refill_chunks(cuts.join(ext.select(*EPOCH), EPOCH, "left_semi"), free, min_speech).select(chunk.columns)
    rows = survivors.withColumn("fresh", F.lit(False)).unionByName(fresh.withColumn("fresh", F.lit(True)))
    return ext, rows, mine.where("status <> 'pending'").select("id")


def reprocess_range(table: Generations, raw: DataFrame, cuts: DataFrame, progress: DataFrame | None, device_id: str, from_ms: int | None = None,
                    to_ms: int | None = None, generation: int | None = None) -> DataFrame:
    """Redo a range of the chunks in `table` (CHUNKS) and switch the touched slices to the result at once; the ids of
    reopened raw rows. Readers see the old chunks until the switch. Give the generation of an interrupted run to repeat it."""
    spark = raw.sparkSession
    now = table.read(spark).withColumn("n_samples", F.col("n_end") - F.col("n_start"))
    ext, rows, reopened = redone(raw, now, cuts, progress, device_id, from_ms, to_ms)
    table.swap(ext, rows, table.next_generation(spark) if generation is None else generation)
    return reopened
