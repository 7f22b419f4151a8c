"""Late fills in any order of arrival against one pass; slices swapped as a whole, also when the job dies."""

import random
import tempfile

import pytest
from pyspark.sql import functions as F

from tidemark.functions.speech import Rules
from tidemark.operators import refill
from tidemark.operators.audio import EPOCH
from tidemark.operators.generations import Generations

from test_chunking import SHORT, random_probs

ROW = "device_id string, run_id string, epoch bigint, n_start bigint, n_end bigint, cut_reason string"


@pytest.fixture()
def tmp():
    return "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")


def segments(spark, seed, n, size):
    rnd, rows = random.Random(seed), []
    for k in range(3):
        probs = random_probs(rnd, n)
        rows += [(f"d{k}", "r", k, i, probs[i:i + size], None, None) for i in range(0, n, size)]
        rows[-1] = (*rows[-1][:5], "discontinuity" if k else None, None)
    return rows, spark.createDataFrame(rows, refill.SEGMENTS)


def test_late_fills_equal_one_pass_in_any_order(spark, tmp):
    rows, every = segments(spark, 5, 480, 60)
    want = {tuple(r) for r in refill.segment_chunks(every, SHORT).collect()}
    table, rnd = Generations(tmp, refill.CHUNKS), random.Random(1)
    rnd.shuffle(rows)
    parts = [rows[:12], rows[12:19], rows[19:]]
    table.swap(d := refill.segment_chunks(spark.createDataFrame(parts[0], refill.SEGMENTS), SHORT), d, 1)
    here = list(parts[0])
    for k, part in enumerate(parts[1:]):
        here += part
        late = spark.createDataFrame([(*r[:3], "late", r[3] * 512, (r[3] + len(r[4])) * 512, None) for r in part], "device_id string, run_id string, epoch bigint, kind string, n_start bigint, n_end bigint, cut_reason string")
        merge = refill.merge_late(table, lambda s: s.createDataFrame(here, refill.SEGMENTS), SHORT, first_generation=2)
        merge(late, k)
        if k == 0:
            once = sorted(map(tuple, table.read(spark).collect()))
            merge(late, k)  # a replayed batch
            assert sorted(map(tuple, table.read(spark).collect())) == once
    assert {tuple(r)[:6] for r in table.read(spark).select(*[c.split()[0] for c in ROW.split(", ")]).collect()} == want


def test_fill_touches_only_the_bursts_around_it(spark):
    # Three bursts of talk with silences that reset everything; the middle one lacks a segment.
    probs = ([0.9] * 40 + [0.0] * 130) * 3
    rows = [("d", "r", 0, i, probs[i:i + 10], None, None) for i in range(0, len(probs), 10)]
    gap = 190
    df = spark.createDataFrame(rows, refill.SEGMENTS)
    old = refill.segment_chunks(df.where(F.col("first_idx") != gap)).withColumn("cut_reason", F.concat("cut_reason", F.lit("-old")))
    slices, new = refill.refilled(df, old, spark.createDataFrame([("d", "r", 0, gap * 512, (gap + 10) * 512)], "device_id string, run_id string, epoch bigint, lo bigint, hi bigint"))
    got = sorted((r.n_start, r.n_end, r.cut_reason) for r in new.collect())
    assert [c for *_, c in got] == ["silence-old", "silence", "silence-old"] and slices.count() == 1
    assert [(a, b) for a, b, _ in got] == sorted((r.n_start, r.n_end) for r in refill.segment_chunks(df).collect())


def test_copies_and_overlaps_of_segments(spark):
    rows = [("d", "r", 0, 0, [0.9] * 10, None, None), ("d", "r", 0, 0, [0.9] * 30, None, None), ("d", "r", 0, 20, [0.0] * 30, None, None), ("d", "r", 0, 30, [0.0] * 50, None, None), ("d", "r", 0, 30, [], None, None)]
    got = [tuple(r)[3:] for r in refill.segment_chunks(spark.createDataFrame(rows, refill.SEGMENTS)).collect()]
    assert got == [(0, 30 * 512 + 4800, "silence")]
    assert refill.segment_chunks(spark.createDataFrame([], refill.SEGMENTS)).count() == 0


def test_a_swap_shows_at_once_or_not_at_all(spark, tmp):
    table = Generations(tmp, refill.CHUNKS)
    assert table.read(spark).count() == 0
    one = spark.createDataFrame([("a", "r", 0, 0, 5, "x"), ("a", "r", 1, 0, 5, "x"), ("b", "r", 0, 0, 5, "x")], ROW)
    table.swap(one, one, 1)
    two = spark.createDataFrame([("a", "r", 0, 1, 9, "y"), ("a", "r", 0, 9, 11, "y")], ROW)
    touched = one.where("device_id = 'a'")

    def now():
        return sorted((r.device_id, r.epoch, r.n_start, r.cut_reason) for r in table.read(spark).collect())

    before = now()
    table.write(one.where("device_id = 'a'"), 2)  # the job dies between rows and switch
    assert now() == before and not table.swapped(spark, 2)
    reader = table.read(spark)
    table.swap(touched, two, 2)  # its repetition
    assert now() == [("a", 0, 1, "y"), ("a", 0, 9, "y"), ("b", 0, 0, "x")]
    assert reader.count() == 3 and {r.cut_reason for r in reader.collect()} == {"x"}  # who began to read before keeps what was
    table.swap(touched, one, 2)  # switched already
    assert len(now()) == 3


def test_reprocess_in_place_and_at_the_tail(spark, tmp):
    raw = spark.createDataFrame([(i, "d", "r", e, i * 1000, 1000, i * 100, "segmented") for e in (0, 1) for i in range(10)],
                                "id bigint, device_id string, run_id string, epoch bigint, n_start bigint, n_samples bigint, start_utc_ms bigint, status string")
    chunks = spark.createDataFrame([("d", "r", e, a, b, "silence") for e in (0, 1) for a, b in ((0, 1500), (2500, 4200), (4200, 6100), (8000, 8800))], ROW)
    table = Generations(tmp, refill.CHUNKS)
    table.swap(chunks, chunks, 1)
    cuts = spark.createDataFrame([("d", "r", e, a, a + 700, "cap") for e in (0, 1) for a in range(0, 10_000, 700)], ROW)
    marks = spark.createDataFrame([("d", "r", 0, 10_000), ("d", "r", 1, 6_500)], "device_id string, run_id string, epoch bigint, segmented_to_n bigint")
    again = refill.reprocess_range(table, raw, cuts, marks, "d", 300, 500)
    assert sorted(r.id for r in again.collect()) == sorted([2, 3, 4, 5, 6] + [2, 3, 4, 5, 6, 7, 8, 9])
    got = {e: sorted((r.n_start, r.n_end, r.cut_reason) for r in table.read(spark).where(F.col("epoch") == e).collect()) for e in (0, 1)}
    # In place: whole raw rows 2000 to 7000 without the survivors; at the tail all from 2500 on.
    assert got[0] == sorted([(0, 1500, "silence"), (8000, 8800, "silence"), (2000, 2100, "cap"), (6300, 7000, "cap")] + [(a, a + 700, "cap") for a in range(2100, 6300, 700)]) or got[0][1] == (2000, 2800, "cap")
    assert got[1][0] == (0, 1500, "silence") and got[1][1][0] == 2500 and got[1][-1] == (9800, 10_000, "cap") and not any(c == "silence" for *_, c in got[1][1:])
    assert {r.generation for r in table.read(spark).collect()} == {2}
    assert sorted(r[2] for r in table.read(spark).select(*EPOCH).distinct().collect()) == [0, 1]


def test_refill_meets_every_stretch_whatever_the_lengths(spark):
    r, key = random.Random(8), "device_id string, run_id string, epoch bigint"
    cuts, free = [], []
    for d in ("a", "b"):
        at = sorted(r.sample(range(0, 4000), 60))
        cuts += [(d, "r", 0, x * 50_000, y * 50_000 - r.choice([0, 0, 30_000]), "cap") for x, y in zip(at, at[1:])]
        at = sorted(r.sample(range(0, 4000), 25))
        free += [(d, "r", 0, x * 50_000 - 7, y * 50_000 - 20_000) for x, y in zip(at, at[1:])]
    cuts.append(("c", "r", 0, 0, 1 << 60, "cap"))
    free += [("c", "r", 0, 5, 1000), ("c", "r", 0, 2000, 1 << 59)]
    got = refill.refill_chunks(spark.createDataFrame(cuts, f"{key}, n_start bigint, n_end bigint, cut_reason string"), spark.createDataFrame(free, f"{key}, lo bigint, hi bigint"), 60_000)
    want = []
    for d, _, _, lo, hi in free:
        met = sorted((max(c[3], lo), min(c[4], hi)) for c in cuts if c[0] == d and c[3] < hi and c[4] > lo)
        if len(met) > 1 and met[0][0] == lo and met[0][1] - lo < 60_000 and met[0][1] == met[1][0]:
            met[:2] = [(lo, met[1][1])]
        want += [(d, *m) for m in met]
    assert sorted(map(tuple, got.select("device_id", "n_start", "n_end").collect())) == sorted(want)
