"""Each operator on hand-made edge cases and against a plain brute force."""

import hashlib
import math
import random
import re
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidemark.llm import bpe, bpe_chunks, decontam, elias_fano, licenses, neardup, ngram_lm, quality_mil, topk, toxicity_crf, warc
from tidemark.llm.token_counts import count_tokens, token_counts

PATH = public_tokenizers.path("byte_bpe_50k.json")
DOCS = "doc_id long, text string, source string, n_words long, component_id long, score double, id long, bucket long"
POOL = "abc XYZ 'st \n\t\r  .,!? 0123 éüñ 日本語 \u0085 😀 'll 've 're'd's' <|endoftext|> \x1c\x0b"


def frame(spark, rows, more=()):
    """Documents with extra columns whose names clash with those the operators make."""
    return spark.createDataFrame([(i, t, "s", 7, 7, 7.0, 7, 7) for i, t in rows], DOCS)


def texts(seed, n):
    r = random.Random(seed)
    out = []
    for _ in range(n):
        size, k = r.choice([0, 1, 5, 50, 700, 5000]), r.random()
        out.append("".join(r.choice(POOL) for _ in range(size)) if k < 0.4
                   else r.choice(["a", "日本", "  ", "\n", "=", "x y"]) * size if k < 0.6
                   else r.choice([" ", "", "  "]).join(r.choice(["the", "<|endoftext|>", "don't", "über", "hello", "1234", "\n\n", "'s", "'"]) for _ in range(size)))
    return out


EDGES = [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (4, "one"), (None, "one two three four five six"), (5, "word " * 30000), (6, "!!!"), (7, "x" * 20000)]


def test_round_trip_equals_the_library(spark):
    lib = Tokenizer.from_file(PATH)
    rows = EDGES + list(enumerate(texts(3, 150), 100))
    got = sorted(map(tuple, bpe_chunks.encode_decode(frame(spark, rows), PATH, full=True).collect()), key=str)
    want = []
    for i, t in rows:
        ids = lib.encode(t or "", add_special_tokens=False).ids
        back = lib.decode(ids, skip_special_tokens=False)
        want.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(back.encode()).hexdigest(), ids, back))
    assert got == sorted(want, key=str)
    assert bpe_chunks.encode_decode(frame(spark, []), PATH).count() == 0


def test_joins_anywhere_are_repaired():
    tok, r = bpe.load(PATH), random.Random(5)
    for t in texts(8, 60):
        raw = t.encode()
        at, parts = 0, []
        while at < len(raw):
            end = min(len(raw), at + r.randrange(1, 200))
            while end < len(raw) and (raw[end] & 0xC0) == 0x80:
                end += 1
            if "<|endoftext|>".encode() not in raw:
                parts.append(tok.encode(raw[at:end].decode()))
            at = end
        if parts:
            assert bpe_chunks.join_chunks(parts, tok).tolist() == tok.encode(t).tolist()


def test_token_counts_equal_the_library(spark):
    lib = Tokenizer.from_file(PATH)
    rows = EDGES + list(enumerate(texts(4, 150), 100))
    got = sorted(map(tuple, token_counts(frame(spark, rows), PATH).collect()), key=str)
    want = [(i, len((t or "").encode()), n := len(lib.encode(t or "", add_special_tokens=False).ids), n > 512) for i, t in rows]
    assert got == sorted(want, key=str)
    assert token_counts(frame(spark, []), PATH).count() == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_transducer_on_random_code_points(seed):
    tok, r = bpe.load(PATH), random.Random(seed)
    docs = ["".join(chr(r.choice([r.randrange(32, 0xD7FF), r.randrange(0xE000, 0x1FFFF)])) for _ in range(300)) for _ in range(10)]
    raw = [d.encode() for d in docs]
    got = count_tokens(np.frombuffer(b"".join(raw), np.uint8), np.append(0, np.cumsum([len(x) for x in raw])), PATH)
    assert got.tolist() == [len(tok.encode(d)) for d in docs]


def components(rows):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    label = {i: i for i in sets}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b]
             and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    for _ in sets:
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    return {(i, len(sets[i]), label[i], label[i] == i) for i in sets}


def test_near_duplicates(spark):
    r = random.Random(9)
    base = [[f"w{r.randrange(3000)}" for _ in range(r.randrange(40, 160))] for _ in range(25)]
    rows, n = [(1, None), (2, ""), (3, "one"), (4, "ONE"), (5, "a b"), (6, "a b c d e"), (7, "  ")], 10
    for b in base:
        for _ in range(r.randrange(1, 8)):
            w = list(b)
            for _ in range(r.choice([0, 0, 1, 2, 4, 8])):
                w[r.randrange(len(w))] = "edit"
            rows.append((n, " ".join(w).upper() if r.random() < 0.3 else "\n".join(w)))
            n += 1
    got = set(map(tuple, neardup.near_duplicates(frame(spark, rows)).collect()))
    assert got == components(rows)


def test_near_duplicates_of_nothing_and_of_repeated_rows(spark):
    assert neardup.near_duplicates(frame(spark, [])).count() == 0
    got = [tuple(x) for x in neardup.near_duplicates(frame(spark, [(9, "a b c"), (9, "a b c"), (None, "a b c"), (None, "q")])).collect()]
    assert sorted(got, key=str) == sorted([(9, 1, 9, True)] * 2 + [(None, 1, 9, False), (None, 1, None, False)], key=str)


def test_half_keys_find_pairs_at_the_threshold():
    # (1 - (1 - s^2)^10)^2 at s = 0.75
    assert (1 - (1 - (neardup.NUM / neardup.DEN) ** neardup.HALF_WIDTH) ** neardup.HALF_KEYS) ** 2 > 0.999


def test_topk(spark):
    r = np.random.default_rng(2)
    rows = [(i, r.normal(size=8).tolist()) for i in range(230)] + [(300, None), (301, [1.0, None]), (302, [float("nan")]), (303, [float("inf")]), (400, []), (None, [1.0])]
    rows += [(500, [0.5] * 8), (501, [0.5] * 8), (502, [0.5] * 8)]
    df = spark.createDataFrame([(i, v, 1, 2.0) for i, v in rows], "vec_id long, embedding array<float>, score int, part double")
    got = {tuple(x) for x in topk.top_k(df, F.col("vec_id") % 100 == 0, shards=5).collect()}
    ints = {i: [math.floor(1024 * float(np.float32(x))) for x in v] for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}
    want = set()
    for q in (i for i in ints if i % 100 == 0):
        best = sorted((-sum(a * b for a, b in zip(ints[q], ints[c])), c) for c in ints if c != q)[:10]
        want |= {(q, k + 1, c, -s) for k, (s, c) in enumerate(best)}
    assert got == want
    assert topk.top_k(df.where("false"), F.col("vec_id") % 100 == 0).count() == 0


def test_topk_sends_no_copies_of_queries_through_the_driver(spark, monkeypatch):
    """Queries are few, their copies for every shard are not: Spark's size check takes the former for the latter."""
    r = np.random.default_rng(3)
    rows = [(i, r.integers(-3, 4, 6).astype(float).tolist()) for i in range(400)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    want = {(q, n + 1, c, -s) for q in range(0, 400, 5) for n, (s, c) in enumerate(sorted(
        (-sum(int(a * b) << 20 for a, b in zip(rows[q][1], v)), i) for i, v in rows if i != q)[:10])}
    for limits in ((4096, 1 << 16, 1 << 24), (16, 1 << 16, 1 << 24), (16, 30, 1 << 24), (7, 1 << 16, 200)):
        for name, n in zip(("SHARD_ROWS", "QUERY_ROWS", "QUERY_BYTES"), limits):
            monkeypatch.setattr(topk, name, n)
        got = topk.top_k(df, F.col("vec_id") % 5 == 0, shards=5)
        assert {tuple(x) for x in got.collect()} == want
        assert "BroadcastExchange" not in got._jdf.queryExecution().executedPlan().toString()
    # scores beyond 52 bits, where products are of integers
    far = spark.createDataFrame([(i, [float(i << 18), 1.0]) for i in range(12)], "vec_id long, embedding array<double>")
    assert [tuple(x) for x in topk.top_k(far, F.col("vec_id") == 10, k=2).orderBy("rank").collect()] == [
        (10, 1, 11, (110 << 56) + (1 << 20)), (10, 2, 9, (90 << 56) + (1 << 20))]


def test_warc(spark):
    big = "<p>ü</p>" * 400
    rows = [(1, "http://a", big), (5, "http://b\r\nX: y", big), (3, None, big), (2, "u", "tiny"), (4, "u", "tiny"), (6, "u", None), (7, "u", ""), (None, "u", big), (8, "u", "x" * 3_000_000)]
    pages = spark.createDataFrame([(*x, "c", 1) for x in rows], "page_id long, url string, html string, same string, size int")
    got = {tuple(x) for x in warc.archive_round_trip(spark, pages).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()}
    want = set()
    for i, _, h in rows:
        raw = (h or "").encode()
        revisit = h == big and i != 5
        want.add((i, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if revisit else "response", 5 if revisit else None))
    assert got == want
    assert warc.archive_round_trip(spark, pages.where("false")).count() == 0


def test_archives_on_disk_are_members_in_a_row(spark, tmp_path, monkeypatch):
    import io
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 4000)
    rows = [(i, f"http://{i}", "".join(random.Random(i).choices("abcdefgh", k=1500))) for i in range(30)] * 2 + [(99, None, "same " * 400)] * 3
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2)
    manifest = warc.write_archives(warc.mark_revisits(pages), f"file://{tmp_path}/w")
    files = manifest.collect()
    back = warc.read_archives(manifest, f"file://{tmp_path}/w")
    assert len(files) > 5 and back.rdd.getNumPartitions() == len(files) and sum(f["records"] for f in files) == len(rows)
    found = {(r["archive"], r["archive_offset"]): r for r in back.collect()}
    assert len(found) == len(rows)
    for f in files:
        raw = open(f["archive"], "rb").read()
        assert len(raw) == f["bytes"] and len(list(warc.read_records(io.BytesIO(raw)))) == f["records"]
        for (name, at), r in found.items():
            if f["archive"].endswith(name):  # a member begins at each offset and holds one record
                member = zlib.decompressobj(31)
                head = member.decompress(raw[at:])
                assert head.startswith(b"WARC/1.") and member.eof and head.count(b"WARC/1.") == 1
    assert {(r["page_id"], r["record_type"]) for r in found.values()} == {(i, "response") for i in [*range(30), 99]}


def test_warc_reader_refuses_damage():
    import io
    good = warc.record(1, "http://a", b"x" * 2000, None, False) + warc.record(2, "http://b", b"y", None, False)
    assert [r[0] for r in warc.read_records(io.BytesIO(good))] == [1, 2]
    raw = zlib.decompress(good, 31).replace(b"xxxx", b"xxyx", 1)
    gz = zlib.compressobj(6, zlib.DEFLATED, 31)
    for bad in (gz.compress(raw) + gz.flush(), good[:-20]):
        with pytest.raises((warc.DamagedArchive, zlib.error)):
            list(warc.read_records(io.BytesIO(bad)))


def test_licenses(spark):
    rows = EDGES + [(20, "Copyright 2020 Someone\nRELEASED under the  MIT Licence!"), (21, "text\nLicensed under CC BY-NC 4.0.\nReleased under the MIT License."), (21, "other")]
    got = {(r[0], r[1], r[2], r[3]) for r in licenses.license_scan(frame(spark, rows), licenses.known_notices(spark)).collect()}
    assert (20, "MIT", 1, "MIT") in got and (21, None, 2, "CC-BY-NC-4.0,MIT") in got and (21, None, 0, "") in got and (1, None, 0, "") in got
    assert licenses.license_scan(frame(spark, rows), licenses.known_notices(spark).where("false")).where("n_lines > 0").count() == 0


def test_full_licence_texts(spark):
    full = {p.stem: p.read_text(encoding="utf-8") for p in licenses._FOLDER.glob("*.txt")}
    assert {"MIT", "BSD-2-Clause", "BSD-3-Clause", "Apache-2.0", "GPL-2.0", "GPL-3.0", "MPL-2.0"} <= set(full)
    want, rows = {}, []
    for i, (name, text) in enumerate(sorted(full.items())):
        changed = "Copyright (c) 1987 A. N. Other\n\n" + re.sub(r"\bLICENSE\b", "LICENCE", text.upper()).replace(",", " ,").replace('"', "``")
        for k, t in enumerate((text, changed, licenses._unwrapped(text), text + " and one more word")):
            rows.append((10 * i + k, t))
            want[10 * i + k] = name if k < 3 else None
    gnu = licenses._GNU.format(it="This program", this="this program", name="GNU General Public License", version=", either version 3 of the License, or (at your option) any later version", colon=":", s="s")
    more = [(900, "MIT License\n\nCopyright (c) 2001 Me\n\n" + full["MIT"], "MIT"), (901, licenses._APACHE.upper(), "Apache-2.0"), (902, gnu, "GPL-3.0-or-later"),
            (903, "SPDX-License-Identifier: BSD-3-Clause", "BSD-3-Clause"), (904, "This project is licensed under the Apache Licence 2.0", "Apache-2.0"), (905, "License to kill", None)]
    rows += [x[:2] for x in more]
    want |= {i: name for i, _, name in more}
    got = {x["doc_id"]: x["whole_license"] for x in licenses.license_scan(frame(spark, rows), licenses.known_notices(spark)).collect()}
    assert got == want


@pytest.mark.parametrize("broadcast", [True, False])
def test_decontamination(spark, monkeypatch, broadcast):
    if not broadcast:
        monkeypatch.setattr(decontam, "BROADCAST_ROWS", 0)
    r = random.Random(4)
    items = [(k, " ".join(r.choice("abcdefg") + str(r.randrange(9)) for _ in range(n))) for k, n in enumerate([30, 13, 5, 1, 40])] + [(9, ""), (10, None), (11, "zz ZZ"), (11, "zz ZZ")]
    docs = list(EDGES)
    for i in range(40):
        w = [r.choice("abcdefg") + str(r.randrange(9)) for _ in range(r.randrange(0, 60))]
        for _ in range(r.randrange(0, 3)):
            src = (items[r.randrange(5)][1]).split()
            a = r.randrange(len(src))
            w += src[a:a + r.randrange(1, 30)]
        docs.append((100 + i, r.choice([" ", "--", "\n"]).join(w)))
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    want = []
    for i, t in docs:
        w, hit, names = words(t), set(), set()
        for k, u in items:
            x = words(u)
            size = min(13, len(x))
            wins = {tuple(x[s:s + size]) for s in range(max(1, len(x) - 12))} if x else set()
            for s in range(len(w) - size + 1) if x else ():
                if tuple(w[s:s + size]) in wins:
                    hit |= set(range(s, s + size))
                    names.add(str(k))
        want.append((i, len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    bench = spark.createDataFrame([(*x, 1) for x in items], "item_id long, text string, at int")
    got = [tuple(x) for x in decontam.contamination(frame(spark, docs), bench).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert decontam.contamination(frame(spark, docs), bench.where("false")).where("n_hit > 0").count() == 0


def test_elias_fano(tmp_path):
    r = np.random.default_rng(0)
    for n, top in ((0, 5), (1, 1), (7, 100), (1000, 10**6), (3000, 10**13), (500, 10)):
        v = np.sort(r.integers(0, top, n))
        uri = str(tmp_path / f"{n}-{top}")
        elias_fano.write_arrays(uri, {f"x.{k}": a for k, a in elias_fano.encode(v, top).items()})
        form = elias_fano.decoded(elias_fano.map_arrays(uri), "x")
        asked = r.integers(0, top, 300)
        assert (form.get(np.arange(n)) == v).all() and (form.successor(asked) == np.searchsorted(v, asked)).all()


def test_language_model(spark):
    r = random.Random(1)
    rows = [(i, " ".join(r.choice(["A", "b", "c", "dd", "e"]) for _ in range(r.randrange(0, 30)))) for i in range(80)] + [(90, None), (91, "unseen words a b"), (None, "a b")]
    learn = F.col("doc_id") % 4 != 0
    got = [tuple(x) for x in ngram_lm.score_texts(frame(spark, rows), learn).collect()]
    toks = lambda t: (t or "").lower().split() + [None]
    train = [toks(t) for i, t in rows if i is not None and i % 4]
    c = Counter(w for t in train for w in t)
    total, kinds = sum(c.values()), len(c)
    pairs = Counter(p for t in train for p in zip(t, t[1:]))
    mass, width = Counter(), Counter()
    for (a, _), k in pairs.items():
        mass[a] += k
        width[a] += 1
    n1, n2 = sum(k == 1 for k in pairs.values()), sum(k == 2 for k in pairs.values())
    less = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
    uni = lambda w: (c[w] + 0.1) / (total + 0.1 * (kinds + 1))
    known = {(g[0], g[2]): g for g in got}
    assert len(got) == len(rows)
    for i, t in rows:
        w = toks(t)
        want = math.log10(uni(w[0])) + sum(math.log10(max(pairs[a, b] - less, 0) / mass[a] + less * width[a] / mass[a] * uni(b) if mass[a] else uni(b)) for a, b in zip(w, w[1:]))
        g = known[i, len(w)]
        assert g[1] == bool(i is not None and i % 4) and g[3] == sum(c[x] > 0 for x in w) and g[4] == total
        assert g[5] == pytest.approx(sum(math.log10(uni(x)) for x in w)) and g[6] == pytest.approx(want, abs=0.02 * len(w))
    assert ngram_lm.score_texts(frame(spark, rows), F.lit(False)).where("train_tokens = 0").count() == len(rows)
    assert ngram_lm.score_texts(frame(spark, []), learn).count() == 0


@pytest.mark.parametrize("module,label", [(quality_mil, "quality"), (toxicity_crf, "toxic")])
def test_classifiers_learn_and_take_edges(spark, module, label):
    r = random.Random(3)
    plain = [f"{a}{b}{c}" for a in "bcdfg" for b in "aeiou" for c in "lmnrt"]
    rows, marks = [], []
    for i in range(400):
        w = [r.choice(plain) for _ in range(r.randrange(20, 120))]
        y = i % 2
        if label == "toxic" and y:
            for _ in range(4):
                w[r.randrange(len(w))] = r.choice(["vileword", "nastyone"])
        if label == "quality" and not y:
            w = [x.upper() + "!!" for x in w]
        rows.append((i, " ".join(w)))
        marks.append((i, y))
    labels = spark.createDataFrame([*marks, (None, 1), (5000, None)], f"doc_id long, {label} int")
    docs = frame(spark, rows + [(i + 1000 if i else None, t) for i, t in EDGES])
    model = module.train(docs, labels, F.col("doc_id") % 4 < 2)
    got = {x[0]: x for x in module.score(docs, model).collect() if x[0] is not None}
    held = [i for i, _ in marks if i % 4 >= 2]
    assert sum(got[i]["predicted"] == i % 2 for i in held) >= 0.97 * len(held)
    assert all(0 <= x["score"] <= 1 for x in got.values()) and got[1001]["score"] == got[1002]["score"]
    if label == "toxic":
        text = dict(rows)
        found = [text[i][s["start"]:s["end"]] for i in held if i % 2 for s in got[i]["spans"]]
        assert found and sum(any(w in ("vileword", "nastyone") for w in f.split()) for f in found) >= 0.95 * len(found)
    none = module.train(docs, labels.where("false"), F.lit(True))
    assert {round(x["score"], 9) for x in module.score(docs, none).collect()} == {0.5}
    assert module.score(frame(spark, []), model).count() == 0


def test_marginals_lay_out_a_part_of_the_runs_at_a_time():
    rng = np.random.default_rng(5)
    row = np.repeat(np.arange(3000), rng.integers(1, 280, 3000))
    odds, move, runs = rng.normal(0, 3, len(row)), np.array([[0.5, -0.3], [-0.4, 0.2]]), toxicity_crf.chains(row)
    tracemalloc.start()
    p, expected = toxicity_crf.marginals(odds, *runs, move)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(runs[2]) > 2 * toxicity_crf.BLOCK and most < 40e6
    assert abs(expected.sum() - (len(row) - 3000)) < 1e-6
    for r in (0, 1500, 2999):
        alone, of = odds[row == r], toxicity_crf.chains(np.zeros(int((row == r).sum()), np.int64))
        assert np.allclose(p[row == r], toxicity_crf.marginals(alone, *of, move)[0])


def test_marginals_of_long_texts_are_those_of_one_chain():
    r = np.random.default_rng(4)
    size = [1, 63, 64, 65, 128, 700, 3]
    row, odds, move = np.repeat(np.arange(len(size)), size), r.normal(0, 2, sum(size)), r.normal(0, 1.5, (2, 2))
    p, expected = toxicity_crf.marginals(odds, *toxicity_crf.chains(row), move)
    want, pairs = [], np.zeros((2, 2))
    for d in range(len(size)):
        psi, a = np.exp(np.stack([np.zeros(size[d]), odds[row == d]], axis=1)), np.exp(move)
        f, b = [psi[0] / psi[0].sum()], [np.ones(2)]
        for x in psi[1:]:
            f.append((f[-1] @ a) * x / ((f[-1] @ a) * x).sum())
        for x in psi[:0:-1]:
            b.append(a @ (x * b[-1]) / (a @ (x * b[-1])).sum())
        b.reverse()
        want += [(u * v)[1] / (u * v).sum() for u, v in zip(f, b)]
        for k in range(1, size[d]):
            m = f[k - 1][:, None] * a * (psi[k] * b[k])
            pairs += m / m.sum()
    assert np.allclose(p, want) and np.allclose(expected, pairs)


def test_toxicity_learns_from_long_texts(spark):
    r = random.Random(6)
    plain = [f"{a}{b}{c}" for a in "bcdfg" for b in "aeiou" for c in "lmnrt"]
    rows = [(i, " ".join(r.choice(plain) if not i % 2 or k % 300 else "vileword" for k in range(2600))) for i in range(60)]
    model = toxicity_crf.train(frame(spark, rows), spark.createDataFrame([(i, i % 2) for i, _ in rows], "doc_id long, toxic int"), F.col("doc_id") < 40)
    got = {x[0]: x["predicted"] for x in toxicity_crf.score(frame(spark, rows), model).collect()}
    assert got == {i: i % 2 for i, _ in rows}
    y, n = np.array([0, 1, 0, 1, 0]), np.array([5, 90, 50, 1, 1])
    assert toxicity_crf.sampled(y, n, 1000).tolist() == [0, 1, 2, 3, 4] and toxicity_crf.sampled(y, n, 20).tolist() == [0, 1]
