"""Steps whose cost must follow what they hold and not the windows, segments or tokens under it."""

import random
import re

import numpy as np
import pandas as pd
import pytest

from tidemark.functions.checks import SIDECAR_PATHS, Body
from tidemark.functions.speech import Rules
from tidemark.operators import audio, refill
from tidemark.operators.transcripts import _place_words
from tidemark.plans import catalog_ingest
from tidemark.plans.catalog import QUERIES


def test_windows_meet_as_bits_before_they_are_shuffled(spark):
    rnd, rules, rows, want = random.Random(3), Rules(), [], set()
    for key in "ab":
        at = 0
        while at < 700:
            kind, n = rnd.randrange(3), rnd.choice([1, 2, 63, 64, 65, 130])
            if not at or kind != last:
                rows += [(key, at + i, (0.1, 0.4, 0.9)[kind]) for i in range(n)]
                want.add((key, at, n, kind))
                at, last = at + n, kind
    rnd.shuffle(rows)
    runs = audio.activity_runs(spark.createDataFrame(rows, "k string, idx bigint, prob double").repartition(5), ["k"], rules)
    assert {(r["k"], r["first_idx"], r["n"], r["kind"]) for r in runs.collect()} == want
    assert "bit_or" in runs._jdf.queryExecution().toString()


def test_segments_without_overlap_are_not_folded(spark, monkeypatch):
    rows = [("d", "r", 0, i, [0.9, 0.4, 0.4, 0.1], None, None) for i in (0, 4, 12)]
    with monkeypatch.context() as m:
        m.setattr(refill, "drop_overlaps", lambda *a, **k: pytest.fail("nothing overlaps"))
        got = refill.chained(refill.run_lengths(spark.createDataFrame(rows, refill.SEGMENTS), Rules())).collect()
    assert {(r["first_idx"], r["chain"]) for r in got} == {(0, 0), (4, 0), (12, 12)}
    assert all([tuple(x) for x in r["runs"]] == [(0, 1, 2), (1, 2, 1), (3, 1, 0)] for r in got)
    # 2 overlaps 0 and goes, so 4 stays though 2 reaches over it; of two at 12 the longer stays.
    rows += [("d", "r", 0, 2, [0.1] * 6, None, None), ("d", "r", 0, 12, [0.9] * 5, None, None), ("d", "r", 0, 20, [0.9], None, None)]
    got = refill.chained(refill.run_lengths(spark.createDataFrame(rows, refill.SEGMENTS), Rules())).collect()
    assert {(r["first_idx"], r["n"], r["chain"]) for r in got} == {(0, 4, 0), (4, 4, 0), (12, 5, 12), (20, 1, 20)}


def test_late_fill_makes_segments_from_spans(spark, monkeypatch):
    monkeypatch.setattr(catalog_ingest, "_vad_stream", lambda *a: pytest.fail("no window by itself"))
    segs, _ = catalog_ingest._vad_segments(spark, "/root/testdata/sf0.001")
    got = {(r["device_id"], r["first_idx"]): r["probs"] for r in segs.collect()}
    monkeypatch.undo()
    want = {}
    for r in catalog_ingest._vad_stream(spark, "/root/testdata/sf0.001").orderBy("idx").collect():
        want.setdefault((r["stream"], r["idx"] // 64 * 64), []).append(r["prob"])
    assert got == want


def test_word_ends_are_numbers(spark):
    got = _place_words.func(pd.Series([" ab  c ", "ab c", None]), pd.Series([["ab", "c"], ["c"], None]))
    assert isinstance(got[0], np.ndarray) and list(got[0]) == [3, 7] and got[1] is None and got[2] is None


def test_windows_are_handed_over_in_parts(spark, monkeypatch):
    monkeypatch.setattr(audio, "OUT_ROWS", 4)
    df = spark.createDataFrame([("s", 0, 0, bytes(2 * 512 * 10 + 6))], "stream string, origin bigint, n_start bigint, pcm binary")
    assert sorted(r["idx"] for r in audio.vad_windows(df, ["stream"]).collect()) == list(range(11))


def test_json_objects_are_taken_apart_once(spark):
    b = Body(SIDECAR_PATHS)
    raws = ['{"epoch":null,"vad":{"model":"m","threshold":0.5},"n_start":7}', "[1]", "null", "7", "{", "{}", '{"epoch":1,"epoch":2}', '{"vad":"x"}', None]
    df = b.attach(spark.createDataFrame([(i, r) for i, r in enumerate(raws)], "i int, raw string"))
    got = {r["i"]: r for r in df.select("i", b.is_object.alias("obj"), b.has("epoch").alias("epoch"), b.given("epoch").alias("given"), b.text("vad.model").alias("model"),
                                         b.number("vad.threshold").alias("t"), b.long("n_start").alias("n"), b.is_object_at("vad").alias("vad"), b.has("vad.version").alias("version")).collect()}
    assert [got[i]["obj"] for i in range(9)] == [True, False, False, False, False, True, False, True, False]
    assert tuple(got[0])[2:] == (True, False, "m", 0.5, 7, True, False)
    assert not got[5]["epoch"] and tuple(got[7])[4:] == (None, None, None, False, False)
    plan = df._jdf.queryExecution().analyzed().toString()
    assert plan.count("parse_json") == 1 and not re.search(r"variant_get\(_v#\d+L?, ", plan)


def test_sidecar_rules_stay_small_enough_to_be_compiled(spark):
    """The JVM interprets methods above 8,000 bytes of code, however often they run."""
    import re
    from tidemark.plans.catalog_ingest import _sidecars
    from tidemark.sources.sidecars import checked
    rows = checked(_sidecars(spark, "/root/testdata/sf0.001"))
    text = spark.sparkContext._jvm.PythonSQLUtils.explainString(rows._jdf.queryExecution(), "codegen")
    sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", text)]
    assert sizes and max(sizes) < 8000
