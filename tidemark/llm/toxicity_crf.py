"""Toxicity by a linear-chain conditional random field over words.

Labels are of documents; words get theirs from them. A word of a toxic document starts as toxic if one of
its features (the word, its beginnings and ending) is far commoner in toxic than in other documents. The
field learns emission weights of hashed features and transitions from these tags, tags the toxic
documents again with its own marginals, and learns once more. Forward-backward marginals of all words of
a text give its offending spans and, through a logistic curve on the greatest marginal, their sum and their rate,
its score.

Texts are read in runs of 64 words, so all runs of a slice go in step; each run's 2 x 2 matrix carries the
messages over its borders, so a text of any length is one chain.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .sampling import labelled
from .storage import as_text, row_with_text, stored, text_of_row
from .text import LOWER, mix, rows_of, span_hashes, word_spans

#: Words a run, and runs that are laid out at a time.
CHAIN, BLOCK = 64, 2048
#: Emission weights: features are hashed to so many.
TABLE = 1 << 18
#: Labelled rows of either label that are learned from, and their words in all. Rows are taken in the order of a
#: hash of their ids until the words are used up, whatever their length.
TRAIN_EACH, TRAIN_WORDS = 1200, 800_000
ROUNDS, STEPS, RATE = 2, 20, 0.5
#: What a feature needs to mark words of toxic documents: this much log-likelihood ratio, and this share of
#: the documents that it stands in toxic.
EVIDENCE, PURITY = 20.0, 0.7
THRESHOLD, SPAN_FROM = 0.7, 0.5

# bytes that are cut from a word's ends
_EDGE = np.zeros(256, bool)
_EDGE[[b for b in range(33, 127) if not chr(b).isalnum()]] = True
_HEADS, _SEED = (4, 5, 6, 7), mix(np.arange(100, 120, dtype=np.uint64))
FEATURES = 2 + len(_HEADS)


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, end, hashed features) of every word, without punctuation at its ends (if more is left)."""
    row, start, end = word_spans(data, offsets)
    bare_s, bare_e = start.copy(), end.copy()
    for _ in range(4):
        bare_s += (bare_e - bare_s > 1) & _EDGE[data[bare_s]] if len(row) else 0
        bare_e -= (bare_e - bare_s > 1) & _EDGE[data[bare_e - 1]] if len(row) else 0
    low = LOWER[data]
    out = np.empty((len(row), FEATURES), np.int32)
    word = span_hashes(low, bare_s, bare_e)
    out[:, 0] = mix(word ^ _SEED[0]) % np.uint64(TABLE)
    out[:, 1] = mix(span_hashes(low, np.maximum(bare_s, bare_e - 4), bare_e) ^ _SEED[1]) % np.uint64(TABLE)
    for k, n in enumerate(_HEADS):
        whole = bare_e - bare_s <= n
        h = span_hashes(low, bare_s, np.minimum(bare_e, bare_s + n))
        out[:, 2 + k] = np.where(whole, mix(word ^ _SEED[2]), mix(h ^ _SEED[3 + k])) % np.uint64(TABLE)
    return row, bare_s, bare_e, out


def chains(row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(run, place in it) of each word, and the number in its text of each run."""
    at = np.arange(len(row)) - np.searchsorted(row, row)
    place = at % CHAIN
    return np.cumsum(place == 0) - 1, place, at[place == 0] // CHAIN


def _unit(v: np.ndarray) -> np.ndarray:
    return v / v.sum(axis=-1, keepdims=True)


def _borders(whole: np.ndarray, a: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The messages (runs x 2) that enter each run from before its first word and from behind its last one, given each
    run's 2 x 2 matrix."""
    enter, leave = np.ones((len(rank), 2)), np.ones((len(rank), 2))
    order = np.argsort(rank, kind="stable")
    levels = np.split(order, np.cumsum(np.bincount(rank))[:-1])[1:]
    for c in levels:
        enter[c] = _unit((enter[c - 1][:, None, :] @ whole[c - 1])[:, 0] @ a)
    for c in reversed(levels):
        leave[c - 1] = _unit((whole[c] @ leave[c][:, :, None])[:, :, 0] @ a.T)
    return enter, leave


def _laid_out(odds: np.ndarray, chain: np.ndarray, place: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Potentials (places x runs x 2) of the words of `n` runs, and which places are taken."""
    u, live = np.zeros((CHAIN, n, 2)), np.zeros((CHAIN, n), bool)
    u[place, chain, 1] = np.clip(odds, -30, 30)
    live[place, chain] = True
    u -= u.max(axis=2, keepdims=True)
    return np.exp(u, out=u), live


def marginals(odds: np.ndarray, chain: np.ndarray, place: np.ndarray, rank: np.ndarray, move: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """P(toxic) of each word, and expected transition counts (2 x 2), by forward-backward in step.

    `odds` are emission log-odds of toxic; `move` are log transition scores from row to column; `chain`,
    `place` and `rank` are those of `chains`. BLOCK runs are laid out at a time, however many there are."""
    n = len(rank)
    p, expected, a = np.zeros(len(odds)), np.zeros((2, 2)), np.exp(move)
    blocks = [(lo, min(lo + BLOCK, n)) for lo in range(0, n, BLOCK)]
    words = [slice(*np.searchsorted(chain, b)) for b in blocks]
    enter, leave = np.ones((n, 2)), np.ones((n, 2))
    if rank.any():
        whole = np.empty((n, 2, 2))
        for (lo, hi), w in zip(blocks, words):
            psi, live = _laid_out(odds[w], chain[w] - lo, place[w], hi - lo)
            part = psi[0][:, :, None] * np.eye(2)
            for k in range(1, CHAIN):
                step = (part @ a) * psi[k][:, None, :]
                part = np.where(live[k][:, None, None], step / step.sum(axis=(1, 2), keepdims=True), part)
            whole[lo:hi] = part
        enter, leave = _borders(whole, a, rank)
    last = np.ones((1, 2))  # the message behind the run before the block
    for (lo, hi), w in zip(blocks, words):
        at, where = chain[w] - lo, place[w]
        psi, live = _laid_out(odds[w], at, where, hi - lo)
        fwd, bwd = np.empty_like(psi), np.empty_like(psi)
        fwd[0], bwd[-1] = _unit(enter[lo:hi] * psi[0]), leave[lo:hi]
        for k in range(1, CHAIN):
            fwd[k] = _unit((fwd[k - 1] @ a) * psi[k])
        for k in range(CHAIN - 2, -1, -1):
            bwd[k] = np.where(live[k + 1][:, None], _unit((psi[k + 1] * bwd[k + 1]) @ a.T), leave[lo:hi])
        both = fwd * bwd
        p[w] = (both[..., 1] / both.sum(axis=2))[where, at]
        psi *= bwd
        later, before = np.flatnonzero(rank[lo:hi]), np.concatenate([last, fwd[-1]])
        for k in range(CHAIN):  # of the transition into the word in place k
            left, right = (before[later], psi[0, later]) if k == 0 else (fwd[k - 1, live[k]], psi[k, live[k]])
            pair = left[:, :, None] * a * right[:, None, :]
            expected += (pair / pair.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
        last = fwd[-1, -1:].copy()
    return p, expected


def emissions(weight: np.ndarray, f: np.ndarray) -> np.ndarray:
    out = weight[f[:, 0]]
    for k in range(1, FEATURES):
        out = out + weight[f[:, k]]
    return out


@dataclass(frozen=True)
class Model:
    """Fixed in size: TABLE weights and a few numbers."""
    weight: np.ndarray
    bias: float
    move: np.ndarray
    curve: np.ndarray  # of `summary`

    def words(self, f: np.ndarray, chain: np.ndarray, place: np.ndarray, rank: np.ndarray) -> np.ndarray:
        return marginals(emissions(self.weight, f) + self.bias, chain, place, rank, self.move)[0]

    def scores(self, p: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(summary(p, row, n) @ self.curve, -40, 40)))


def summary(p: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
    """What a document's score is made of: 1, the greatest marginal, and logs of their sum and of their
    sum in a hundred words."""
    most, total = np.zeros(n), np.bincount(row, p, n)
    np.maximum.at(most, row, p)
    rate = 100 * total / np.maximum(np.bincount(row, minlength=n), 25)
    return np.stack([np.ones(n), most, np.log1p(total), np.log1p(rate)], axis=1)


def fit(f: np.ndarray, row: np.ndarray, y: np.ndarray) -> Model:
    """Learn from words (features, ascending document numbers) and document labels."""
    n = len(y)
    toxic = y[row] == 1
    # in how many documents of either label a feature stands
    seen = np.zeros((2, TABLE))
    for k in range(FEATURES):
        pair = np.unique(row.astype(np.int64) * TABLE + f[:, k])
        for c in (0, 1):
            seen[c] += np.bincount((pair % TABLE)[y[pair // TABLE] == c], minlength=TABLE)
    # evidence: twice the log-likelihood ratio of "commoner in toxic documents" against "as common", so that the
    # many rare words that stand in toxic documents by chance do not count
    share, total = y.mean(), seen.sum(axis=0)
    part = seen[1] / np.maximum(total, 1)
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = np.nan_to_num(seen[1] * np.log(part / share)) + np.nan_to_num(seen[0] * np.log((1 - part) / (1 - share)))
    evident = (2 * gain > EVIDENCE) & (part > PURITY)
    tag = (toxic & evident[f].any(axis=1)).astype(np.float64)
    chain, place, rank = chains(row)
    weight, bias, move = np.zeros(TABLE), -3.0, np.zeros((2, 2))
    for turn in range(ROUNDS):
        g2, m2 = np.full(TABLE, 1e-2), np.full((2, 2), 1.0)
        last = np.flatnonzero(row[1:] == row[:-1])
        moves = np.zeros((2, 2))
        np.add.at(moves, (tag[last].round().astype(int), tag[last + 1].round().astype(int)), 1)
        scale = 1 / max(tag.sum(), 1)
        for _ in range(STEPS):
            p, expected = marginals(emissions(weight, f) + bias, chain, place, rank, move)
            off = p - tag
            g = sum(np.bincount(f[:, k], off, TABLE) for k in range(FEATURES)) + 0.05 * weight
            g2 += g * g
            weight -= RATE * g / np.sqrt(g2)
            bias -= RATE * np.clip(off.sum() * scale, -1, 1)
            gm = (expected - moves) * scale
            m2 += gm * gm
            move = move - RATE * gm / np.sqrt(m2)
        if turn + 1 < ROUNDS:
            p = marginals(emissions(weight, f) + bias, chain, place, rank, move)[0]
            tag = np.where(toxic, p > 0.5, 0).astype(np.float64)
    p = marginals(emissions(weight, f) + bias, chain, place, rank, move)[0]
    x, curve = summary(p, row, n), np.zeros(4)
    for _ in range(50):  # Newton steps of a ridge logistic curve
        q = 1 / (1 + np.exp(-np.clip(x @ curve, -30, 30)))
        h = (x * (q * (1 - q))[:, None]).T @ x + 1e-1 * np.eye(4)
        curve = curve - np.clip(np.linalg.solve(h, x.T @ (q - y) + 1e-1 * curve), -2, 2)
    return Model(weight.astype(np.float32), bias, move, curve)


def sampled(y: np.ndarray, n: np.ndarray, bound: int) -> np.ndarray:
    """Places of the rows to learn from, given labels and sizes in the order of the draw: of each label the first ones,
    until the next would exceed half the bound or what the other label leaves of it; at least one."""
    half = {c: min(int(n[y == c].sum()), bound // 2) for c in (0, 1)}
    take = []
    for c in (0, 1):
        at = np.flatnonzero(y == c)
        take.append(at[(np.cumsum(n[at]) <= bound - half[1 - c]) | (np.arange(len(at)) == 0)])
    return np.sort(np.concatenate(take))


def train(docs: DataFrame, labels: DataFrame, rows: Column, label: str = "toxic", key: str = "doc_id", text: str = "text") -> Model:
    """Fit on a bounded sample of the labelled rows that `rows` admits: at most TRAIN_EACH texts of either label and
    TRAIN_WORDS words in all come to the driver as features. Without rows of both labels every score is the smoothed share."""

    def encode(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offsets in rows_of(it, "text"):
            row, _, _, f = features(data, offsets)
            cuts = np.searchsorted(row, np.arange(part.num_rows + 1))
            blobs = [f[a:b].tobytes() for a, b in zip(cuts, cuts[1:])]
            yield pa.record_batch([part.column("id"), part.column("y"), pa.array(np.diff(cuts).astype(np.int64)), pa.array(blobs, pa.binary())], ["id", "y", "n", "f"])

    known = stored(labelled(docs, labels, label, rows, TRAIN_EACH, key, text).mapInArrow(encode, "id long, y int, n long, f binary").where("n > 0"), "features")
    sizes = known.groupBy("id", "y").agg(F.sum("n").alias("n")).orderBy(F.xxhash64("id"), "id").toPandas()
    ids = sampled(sizes.y.to_numpy(), sizes.n.to_numpy(), TRAIN_WORDS)
    chosen = docs.sparkSession.createDataFrame([(int(i),) for i in sizes.id[ids]], "id long")
    f, n, y = _learned(known.join(F.broadcast(chosen), "id", "left_semi").select("id", "y", "n", "f"))
    if len(set(y)) < 2:
        share = (y.sum() + 1) / (len(y) + 2)
        return Model(np.zeros(TABLE, np.float32), -30.0, np.zeros((2, 2)), np.array([np.log(share / (1 - share)), 0, 0, 0]))
    return fit(f, np.repeat(np.arange(len(n)), n), y)


def _learned(rows: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features of all words, words of each text, labels) in the order of ids; the rows themselves go when this ends."""
    got = rows.toPandas().sort_values("id", kind="stable")
    f, at = np.empty((int(got.n.sum()), FEATURES), np.int32), 0
    for b, n in zip(got.f, got.n):
        f[at: at + n] = np.frombuffer(b, np.int32).reshape(-1, FEATURES)
        at += n
    return f, got.n.to_numpy(), got.y.to_numpy(np.float64)


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text", whole: bool = False) -> DataFrame:
    """key, score (0 to 1), predicted (1 from THRESHOLD up) and spans for each row.

    spans: start and end, in characters of the text, and score of each run of words with marginals of
    SPAN_FROM or more. Null and empty texts have no span and the score of a text without toxic words;
    repeated rows get equal scores; other columns are ignored; no shuffle. With `whole`, `row` holds all columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    sent, place = row_with_text(docs, text) if whole else ([as_text(docs, text).alias("text")], None)
    span = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())])

    def rate(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for part, data, offsets in rows_of(text_of_row(it, place), "text"):
            row, start, end, f = features(data, offsets)
            p = m.words(f, *chains(row)) if len(row) else np.zeros(0)
            s = m.scores(p, row, part.num_rows)
            spans: list[list] = [[] for _ in range(part.num_rows)]
            hit = np.flatnonzero(p >= SPAN_FROM)
            if len(hit):
                char = np.append(0, np.cumsum((data & 0xC0) != 0x80))
                cut = np.flatnonzero((np.diff(hit) > 1) | (np.diff(row[hit]) > 0)) + 1
                for run in np.split(hit, cut):
                    r = int(row[run[0]])
                    base = char[offsets[r]]
                    spans[r].append({"start": int(char[start[run[0]]] - base), "end": int(char[end[run[-1]]] - base), "score": float(p[run].max())})
            yield pa.record_batch([part.column("id"), pa.array(s), pa.array((s >= THRESHOLD).astype(np.int32)), pa.array(spans, pa.list_(span)), *([part.column("row")] if whole else [])],
                                  ["id", "score", "predicted", "spans", *(["row"] if whole else [])])

    source = docs.select(F.col(key).cast("long").alias("id"), *sent)
    out = StructType.fromDDL("id long, score double, predicted int, spans array<struct<start:int,end:int,score:double>>")
    if whole:
        out = out.add("row", source.schema["row"].dataType)
    return source.mapInArrow(rate, out).withColumnRenamed("id", key)
