"""Speech chunks: goldens by hand, the SQL of the rules on random windows, streams and late fills against one pass."""

import random

import duckdb
import pandas as pd
import pytest

from tidemark.functions.speech import HOLD, SILENT, SPEECH, Open, Rules, Tape, chunks_of
from tidemark.operators import chunking
from tidemark.plans.chunk_check import chunk_sql
from tidemark.streaming.segments import Chain, Segment

SHORT = Rules(window=512, min_silence=2048, pad=512, min_speech=512, max_len=16_384, min_pause=512)
DDL = "stream string, idx bigint, prob double"


def random_probs(rnd, n):
    out = []
    while len(out) < n:
        out += [rnd.choice([0.9, 0.9, 0.1, 0.1, 0.42])] * rnd.choice([1, 2, 3, 6, 20, 40, 60, 120, 300])
    return out[:n]


def streams(seeds, n):
    """Talk with pauses, talk without any, and windows that hold between the thresholds."""
    out = {}
    for s in seeds:
        r = random.Random(s)
        probs = random_probs(r, n)
        if s % 4 == 0:
            probs = [0.9] * n
        if s % 4 == 1:
            probs = [r.choice([0.9, 0.42, 0.42, 0.1]) if p != 0.9 or r.random() < 0.1 else p for p in probs]
        out[f"s{s}"] = probs
    return out


def by_sql(probs, rules):
    df = pd.DataFrame([(s, i, p) for s, ps in probs.items() for i, p in enumerate(ps)], columns=["stream", "idx", "prob"])  # noqa: F841
    return set(duckdb.sql(chunk_sql("SELECT * FROM df", rules)).fetchall())


def chunks(runs, rules=Rules(), n_end=None):
    """Chunks of runs given as (windows, kind)."""
    lo, hi, kind, at = [], [], [], 0
    for n, k in runs:
        lo.append(at * rules.window)
        at += n
        hi.append(at * rules.window)
        kind.append(k)
    tape = Tape(lo, hi, kind, rules)
    out, o, _, _ = chunks_of(tape, None, 0, 0)
    out += [c] if o is not None and (c := tape.last(o, "shutdown", n_end)) else []
    return [(c.n_start, c.n_end, c.cut_reason) for c in out]


def test_goldens():
    # Padding on both sides, to the head of the audio at most; 47 windows are the first 1500 ms of silence.
    assert chunks([(20, SPEECH), (60, SILENT)]) == [(0, 20 * 512 + 4800, "silence")]
    assert chunks([(30, SILENT), (20, SPEECH), (47, SILENT)]) == [(30 * 512 - 4800, 50 * 512 + 4800, "silence")]
    # A shorter silence merges; the end of the audio closes at the padding.
    assert chunks([(20, SPEECH), (46, SILENT), (20, SPEECH), (30, SILENT)]) == [(0, 86 * 512 + 4800, "shutdown")]
    # Windows between the thresholds neither begin a silence nor end one, and do not complete it.
    assert chunks([(20, SPEECH), (60, HOLD), (5, SPEECH), (10, SILENT), (60, HOLD), (1, SILENT), (9, SPEECH)]) == [(0, 85 * 512 + 4800, "silence"), (156 * 512 - 4800, 165 * 512, "shutdown")]
    # Too short to keep: 7 windows are 3584 samples.
    assert chunks([(7, SPEECH), (60, SILENT)]) == [] and len(chunks([(8, SPEECH), (60, SILENT)])) == 1
    # 30 s of talk without a pause: hard cuts, and what is left is kept however short.
    assert chunks([(940, SPEECH), (60, SILENT)]) == [(0, 480_000, "cap"), (480_000, 940 * 512 + 4800, "silence")]
    # The longest pause of 100 ms or more is cut in its middle, the first of equals.
    talk = [(100, SPEECH), (10, SILENT), (100, SPEECH), (20, SILENT), (100, SPEECH), (20, SILENT), (700, SPEECH)]
    assert chunks(talk)[0] == (0, 220 * 512, "cap")
    # A pause in progress counts, and goes on behind the cut.
    assert chunks([(930, SPEECH), (60, SILENT)])[0] == (0, (930 * 512 + 938 * 512) // 2, "cap")
    # The caller may know that the good audio ended earlier.
    assert chunks([(50, SPEECH)], n_end=9000) == [(0, 9000, "shutdown")]
    assert chunks([]) == [] and chunks([(9, SILENT), (9, HOLD)]) == []


@pytest.mark.parametrize("rules", [Rules(), SHORT])
def test_tape_equals_sql(rules):
    probs = streams(range(60), 2500)
    got = set()
    for s, ps in probs.items():
        kinds = [SPEECH if p >= 0.5 else SILENT if p < 0.35 else HOLD for p in ps]
        got |= {(s, *c) for c in chunks([(1, k) for k in kinds], rules)}
    assert got == by_sql(probs, rules)


@pytest.mark.parametrize("rules,long,block,n", [(Rules(), 1 << 20, 1 << 17, 5000), (SHORT, 100, 10, 700), (Rules(), 100, 10, 5000)])
def test_long_bursts_by_blocks(spark, monkeypatch, rules, long, block, n):
    monkeypatch.setattr(chunking, "LONG_WINDOWS", long)
    monkeypatch.setattr(chunking, "BLOCK_WINDOWS", block)
    probs = streams(range(4), n)
    df = spark.createDataFrame([(s, i, p) for s, ps in probs.items() for i, p in enumerate(ps)], DDL).repartition(3)
    got = [tuple(r) for r in chunking.speech_chunks(df, ["stream"], rules).collect()]
    assert len(got) == len(set(got)) and set(got) == by_sql(probs, rules)


def segments_of(probs, size, ends="shutdown"):
    segs = [Segment(i, probs[i:i + size]) for i in range(0, len(probs), size)]
    segs[-1].ends = ends
    return segs


def test_any_order_of_arrival_gives_the_chunks_of_one_pass():
    for rules in (Rules(), SHORT):
        probs = streams(range(1, 40), 2000)
        want, got = by_sql(probs, rules), set()
        for k, (s, ps) in enumerate(probs.items()):
            rnd, chain = random.Random(k), Chain()
            head, *rest = segments_of(ps, rnd.choice([37, 500]))
            rnd.shuffle(rest)
            todo = [head, *rest]
            while todo:
                n = rnd.randrange(1, 3)
                got |= {(s, *row[1:]) for row in chain.take(todo[:n], rules) if row[0] == "chunk"}
                todo = todo[n:]
        assert got == want


def test_gap_waits_then_closes_when_idle_and_late_is_reported():
    probs, chain = [0.9] * 200, Chain()
    assert chain.take([Segment(0, probs)], Rules()) == [] == chain.take([Segment(400, probs, "shutdown")], Rules()) and len(chain.waiting) == 1
    assert chain.take([], Rules(), idle=True) == [("chunk", 0, 200 * 512, "shutdown"), ("chunk", 400 * 512, 600 * 512, "shutdown")]
    assert chain.take([Segment(200, probs)], Rules()) == [("late", 200 * 512, 400 * 512, None)]


def test_gap_closes_while_the_device_goes_on_and_state_stays_small():
    rules, probs = Rules(), ([0.9] * 40 + [0.0] * 160 + [0.9] * 1100 + [0.42] * 300) * 200
    segs, missing, idle_ms = segments_of(probs, 100), 20, 1000
    chain, out, sizes = Chain(), [], []
    for k, s in enumerate(segs[:3000]):
        if k != missing:
            s.at = k * 100
            out += chain.take([s], rules, False, s.at - idle_ms)
            sizes.append((len(chain.runs), len(chain.waiting)))
    assert max(sizes[100:]) == max(sizes[100:400]) and max(n for n, _ in sizes) <= 8 and max(n for _, n in sizes) <= 1 + idle_ms // 100
    edge = segs[missing].first_idx * rules.window
    assert all(kind == "chunk" for kind, *_ in out) and not any(a < edge + 51_200 and b > edge for _, a, b, _ in out)
    # The missing one is late, however long ago; a gap seen too short a time still waits.
    assert [r[0] for r in chain.take([segs[missing]], rules)] == ["late"]
    young = Chain(mark=0)
    segs[3].at = 950
    assert young.take([segs[3]], rules, False, 900) == [] and len(young.waiting) == 1
