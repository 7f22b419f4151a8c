"""Line dedup, phrase mining and conversation repair on hand-made edge cases and against plain brute force."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import pytest

from tidemark.llm import line_dedup

DOCS = "doc_id long, text string, lang string, row binary, pos int, digest string, line string"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def frame(spark, rows, lang="en"):
    """Documents with extra columns whose names clash with those the operators make."""
    return spark.createDataFrame([(i, t, lang, b"1", 7, "d", "l") for i, t in rows], DOCS)


def brute_lines(rows, min_chars=20, min_docs=3):
    held = defaultdict(set)
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(LOWER)
    order = lambda i: (i is not None, i)
    for i, t in rows:
        for x in (t or "").split("\n"):
            if len(key(x)) >= min_chars:
                held[key(x)].add(i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(held[key(x)]) < min_docs or i == max(held[key(x)], key=order)]
        out.append((i, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return out


@pytest.mark.parametrize("hot", [1000, 3, 1])
def test_line_dedup(spark, monkeypatch, hot):
    monkeypatch.setattr(line_dedup, "HOT", hot)
    r = random.Random(1)
    shared = ["  Subscribe to our newsletter today!\t", "SUBSCRIBE to our newsletter TODAY!", "Ünïcode lines of twenty cp", "exactly twenty chars", "only nineteen chars", "in two documents only, no more", ""]
    rows = [(1, None), (2, ""), (3, "\n\n"), (None, "\n".join(shared)), (None, shared[0]), (4, "\r\n".join(shared)), (4, "\r\n".join(shared)), (5, (shared[2] + "\n") * 5000), (6, shared[5])]
    for i in range(60):
        rows.append((10 + i, "\n".join(r.choice(shared[:5] + [f"a line of its own, number {i} {k}"]) for k in range(r.randrange(0, 9)))))
    got = [tuple(x) for x in line_dedup.dedup_lines(frame(spark, rows)).collect()]
    assert Counter(got) == Counter(brute_lines(rows))
    assert line_dedup.dedup_lines(frame(spark, [])).count() == 0


def test_fm_index_counts_and_extends():
    import numpy as np

    from tidemark.llm.fm_index import FmIndex
    r = random.Random(2)
    pieces = [[r.randrange(1, 6) for _ in range(r.randrange(1, 12))] for _ in range(60)] + [[3] * 40]
    text = np.array([x for p in pieces for x in [0, *p]])
    index = FmIndex.from_bytes(FmIndex.build(text, 6, depth=3).to_bytes())
    grams = Counter(tuple(p[i:i + m]) for p in pieces for m in (1, 2, 3, 4) for i in range(len(p) - m + 1))
    assert all(index.count(list(g)) == n for g, n in grams.items()) and index.count([5, 5, 5, 5]) == grams[5, 5, 5, 5]
    ids = np.arange(1, 6)
    for sides in ((True, True), (False, False), (True, False), (False, True)):  # the same phrases from either side
        known, at = [(int(i),) for i in ids], index.words(ids)
        for left in sides:
            owner, word, at = index.extend(at, left)
            known = [(int(w), *known[o]) if left else (*known[o], int(w)) for o, w in zip(owner, word)]
        assert dict(zip(known, at.size.tolist())) == {g: n for g, n in grams.items() if len(g) == 3}
        # Both intervals are the phrase's own: sorted by it, and backwards.
        order = {g: k for k, g in enumerate(sorted(known))}
        assert [order[known[k]] for k in np.argsort(at.left)] == sorted(order.values())
        back = {g: k for k, g in enumerate(sorted(known, key=lambda g: g[::-1]))}
        assert [back[known[k]] for k in np.argsort(at.right)] == sorted(back.values())


def brute_phrases(rows, top, least):
    f, totals, out = defaultdict(Counter), Counter(), []
    for lang, t in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (t or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(w)
            for m in (1, 2, 3):
                f[lang].update(tuple(w[i:i + m]) for i in range(len(w) - m + 1))
    for lang, n in f.items():
        cand = {g: a for g, a in n.items() if len(g) > 1 and a >= least}
        rows = []
        for g, a in cand.items():
            if any(len(h) > len(g) and (h[:2] == g or h[1:] == g) and 100 * b >= 50 * a for h, b in cand.items()):
                continue
            score, k = min((10**6 * a * a // (n[g[:k]] * n[g[k:]]), k) for k in range(1, len(g)))
            rows.append((-score, -a, " ".join(g).encode(), n[g[:k]], n[g[k:]]))
        out += [(lang, k + 1, p.decode(), -a, x, y, totals[lang], -s) for k, (s, a, p, x, y) in enumerate(sorted(rows)[:top])]
    return out


@pytest.mark.parametrize("shard,bucket", [(2_000_000, 4_000_000), (50, 300)])
def test_collocations(spark, monkeypatch, shard, bucket):
    from tidemark.llm import phrases
    monkeypatch.setattr(phrases, "SHARD_WORDS", shard)
    monkeypatch.setattr(phrases, "BUCKET_WORDS", bucket)
    r = random.Random(7)
    rows = [(None, None), ("en", None), ("en", ""), ("", " \t\n"), ("de", "..,;"), (None, "New York, new york. " * 12), ("xx", "a " * 900), ("en", "A\x00b é f " * 11)]
    rows += [("en", "copy of the same row, again and again")] * 15
    for _ in range(120):
        w = [r.choice(["the", "The", "of", "house", "cat", "über", "日本", "x-y", "'s"]) + r.choice(["", "", " ", "\t", ".", "\r\n"]) for _ in range(r.randrange(0, 40))]
        rows.append((r.choice(["en", "en", "de", None, "und", "EN"]), " ".join(w)))
    docs = spark.createDataFrame([(*x, 1, 1, 1) for x in rows], "lang string, text string, gid long, score long, word int").repartition(3)
    got = [tuple(x) for x in phrases.collocations(docs, top=25, min_count=10).collect()]
    assert sorted(got) == sorted(brute_phrases(rows, 25, 10))
    assert phrases.collocations(docs.where("false")).count() == 0


@pytest.mark.parametrize("block", [64, 1, 3])
def test_cheapest_edits_in_ascii_order(monkeypatch, block):
    from tidemark.llm import repairs
    monkeypatch.setattr(repairs, "BLOCK", block)
    r = random.Random(block)
    some = ["", "s", "S", "d", "dd", "ss", "au", "ua" * 40, "u" * 30, "xX" * 20, "sua" * 15] + ["".join(r.choice("suaSUAxXd") for _ in range(r.randrange(1, 14))) for _ in range(400)]
    some += ["".join(r.choice("suuaaUAd") for _ in range(150))]
    for rows in some:
        got, want = repairs.cheapest_edits(rows), brute_edits(rows) if len(rows) < 9 else None
        assert got == forward(rows), rows
        assert want is None or got == want, rows


def forward(rows):
    """Least (cost, edits) per state, row by row."""
    best = {0: (0, "")}
    def put(d, s, v):
        d[s] = min(d.get(s, v), v)
    def inserted(d):
        d = dict(d)
        for s in (0, 1, 3, 2):
            if s in d:
                put(d, 3 if s == 2 else 2, (d[s][0] + 2, d[s][1] + "I"))
        if 2 in d:
            put(d, 3, (d[2][0] + 2, d[2][1] + "I"))
        return d
    for x in rows:
        then, more = {}, int(x.isupper())
        for s, (c, e) in inserted(best).items():
            put(then, s, (c + 3, e + "D"))
            if x != "d":
                put(then, 3 if s == 2 else 2, (c + 2 + more, e + "R"))
                to = {"s": 1 if s == 0 else None, "u": 2 if s != 2 else None, "a": 3 if s == 2 else None}.get(x.lower())
                if to is not None:
                    put(then, to, (c + more, e + "K"))
        best = then
    return min(v for s, v in inserted(best).items() if s == 3 or (s == 0))


def brute_edits(rows):
    """All edit strings of up to a few inserts, the roles tried one by one."""
    found = []
    limit = forward(rows)[0]

    def walk(i, said, cost, edits):
        if cost > limit:
            return
        if i == len(rows) and re.fullmatch(r"(s?(ua)+)?", said):
            found.append((cost, edits))
        for c in "ua":
            walk(i, said + c, cost + 2, edits + "I") if re.fullmatch(r"s?(ua)*u?", said + c) else None
        if i < len(rows):
            more = int(rows[i].isupper())
            walk(i + 1, said, cost + 3, edits + "D")
            if rows[i] != "d":
                for c, price, e in ((rows[i].lower(), more, "K"), ("u", 2 + more, "R"), ("a", 2 + more, "R")):
                    walk(i + 1, said + c, cost + price, edits + e) if re.fullmatch(r"s?(ua)*u?", said + c) else None

    walk(0, "", 0, "")
    return min(found)


def brute_conversations(rows):
    import zlib
    groups, out = defaultdict(list), {}
    space = lambda v: " " if v is None else v
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{space(conv)}:{space(turn)}".encode()) % 20
        role, text = space(role), space(text)
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        row = (turn, "user" if kind == 4 else role, text)
        groups[conv] += [] if kind == 0 else [row, row] if kind == 3 else [row]
    for conv, part in groups.items():
        part.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1], hashlib.sha256(x[2].encode()).digest()))
        seen, letters, faults = set(), "", Counter()
        for turn, role, text in part:
            solid = text.strip(" \t\n\x0b\x0c\r")
            fault = "blank" if not solid else "again" if (role, text) in seen else "short" if solid[-1] not in ".!?" else ""
            seen.add((role, text))
            faults[fault] += 1
            c = role[:1] if role[:1] in ("s", "u", "a") else "x"
            letters += "d" if fault in ("blank", "again") else c.upper() if fault == "short" else c
        turns = [t for t, _, _ in part if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(part, part[1:]))
        cost, audit = forward(letters)
        said, i = [], 0
        for e in audit:
            if e != "D":
                own = part[i][1] if e == "K" else "user" if not said or said[-1][1][:1] in "sa" else "assistant"
                said.append((e, own, "" if e == "I" else part[i][2]))
            i += e != "I"
        whole = "\n".join(f"{r}:{t}" for _, r, t in said)
        out[conv] = (conv, gaps, faults["blank"], faults["again"], faults["short"], illegal, cost, audit, hashlib.sha256(whole.encode()).hexdigest()), said
    return out


def test_conversation_repair(spark):
    from tidemark.llm import repairs
    r = random.Random(11)
    rows = [(None, None, None, None), (None, 3, "user", "Hi."), (-5, 2, "", "x."), (-5, 2, "tool", None), (7, None, "user", ""), (8, 1, "system", "\n \t"), (9, 1 << 40, "user", "far."), (9, 2, "assistant", "long " * 200_000 + ".")]
    rows += [(50, t, "user" if t % 3 else "assistant", f"turn {t % 50}" + "." * (t % 4 > 0)) for t in range(700)]
    for conv in range(100, 260):
        for t in range(r.randrange(0, 9)):
            row = (conv, r.choice([t, t, t, t + 3, None, 1]), r.choice(["user", "assistant", "user", "assistant", "system", "agent", None, "Über"]), r.choice(["Yes.", "No", "Why? ", " \r\n", None, "日本。", "ok!"]))
            rows += [row] * r.choice([1, 1, 1, 2])
    more = spark.createDataFrame([(*x, 1, True, 2) for x in rows], "conv_id long, turn long, role string, text string, fault int, dropped boolean, digest int").repartition(4)
    want = brute_conversations(rows)
    damaged = repairs.damage(more)
    got = [tuple(x) for x in repairs.repair_conversations(damaged).collect()]
    assert sorted(got, key=str) == sorted((s for s, _ in want.values()), key=str)
    turns = defaultdict(list)
    for x in sorted(repairs.repaired_turns(damaged).collect(), key=lambda x: x["place"]):
        turns[x["conv_id"]].append((x["edit"], x["role"], x["text"]))
    assert turns == {c: said for c, (_, said) in want.items() if said}
    assert any(not said for _, said in want.values())
    assert repairs.repair_conversations(repairs.damage(more.where("false"))).count() == 0
