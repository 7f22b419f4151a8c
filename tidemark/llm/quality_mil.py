"""Quality by attention-based multiple-instance learning.

A document is a bag of passages of 64 words. A passage is encoded by what its bytes look like (pairs of
character classes) and by how much its words repeat, through one hidden layer. Gated attention weighs
the passages; the document's label trains encoder, gate and classifier together, and the score is that
of the weighted sum of passage encodings.
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
from .storage import as_text, row_with_text, text_of_row
from .text import LOWER, rows_of, span_hashes, word_spans

PASSAGE_WORDS = 64
#: Labelled rows of either label that are learned from, and passages (spread over the text) of a learned row.
#: Scores are of all passages.
TRAIN_EACH, TRAIN_PASSAGES = 2000, 32
HIDDEN, GATE, EPOCHS, BATCH, RATE = 32, 16, 40, 256, 0.01
THRESHOLD = 0.7

# classes of bytes: lower, upper, digit, blank, line end, ten of punctuation, the rest
_CLASS = np.full(256, 15, np.int64)
for _b in range(33, 127):
    _CLASS[_b] = 0 if 97 <= _b < 123 else 1 if 65 <= _b < 91 else 2 if 48 <= _b < 58 else 5 + _b % 10
_CLASS[[32, 9]] = 3
_CLASS[[10, 11, 12, 13]] = 4
WIDTH = 256 + 3


def passages(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, features) of every passage; a text without words has none."""
    row, start, end = word_spans(data, offsets)
    if not len(row):
        return np.zeros(0, np.int64), np.zeros((0, WIDTH), np.float32)
    first = np.searchsorted(row, row)  # of each word: the first word of its text
    head = np.flatnonzero((np.arange(len(row)) - first) % PASSAGE_WORDS == 0)
    n = len(head)
    words = np.diff(np.append(head, len(row)))
    of = np.repeat(np.arange(n), words)
    last = end[np.append(head[1:], len(row)) - 1]
    at = np.repeat(np.arange(n), last - start[head])
    pos = np.arange(len(at)) + np.repeat(start[head] - (np.cumsum(last - start[head]) - (last - start[head])), last - start[head])
    kind = _CLASS[data[pos]]
    same = at[1:] == at[:-1]
    pairs = np.bincount((at[:-1] * 256 + kind[:-1] * 16 + kind[1:])[same], minlength=n * 256).reshape(n, 256)
    h = span_hashes(LOWER[data], start, end)
    order = np.lexsort((h, of))
    fresh = np.ones(len(h), bool)
    fresh[1:] = (h[order][1:] != h[order][:-1]) | (of[order][1:] != of[order][:-1])
    distinct = np.bincount(of[order][fresh], minlength=n)
    length = np.add.reduceat(end - start, head)
    x = np.empty((n, WIDTH), np.float32)
    x[:, :256] = np.sqrt(pairs / np.maximum(pairs.sum(axis=1, keepdims=True), 1))
    x[:, 256], x[:, 257], x[:, 258] = distinct / words, np.log1p(length / words), np.log1p(words) / 4
    return row[head], x


@dataclass(frozen=True)
class Model:
    """Fixed in size: about 10,000 numbers."""
    w: np.ndarray  # encoder
    b: np.ndarray
    v: np.ndarray  # gate
    u: np.ndarray
    a: np.ndarray
    c: np.ndarray  # classifier
    d: np.ndarray

    def scores(self, row: np.ndarray, x: np.ndarray, n: int) -> np.ndarray:
        """Scores of n documents from their passages; one without passages has the score of a zero encoding."""
        out = np.full(n, _sigmoid(self.d[0]))
        if len(row):
            some, z = self._forward(row, x)[:2]
            out[some] = _sigmoid(z @ self.c + self.d[0])
        return out

    def _forward(self, row: np.ndarray, x: np.ndarray) -> tuple:
        some, first, of = np.unique(row, return_index=True, return_inverse=True)
        h = np.tanh(x @ self.w + self.b)
        t, s = np.tanh(h @ self.v), _sigmoid(h @ self.u)
        e = (t * s) @ self.a
        e = np.exp(e - np.maximum.reduceat(e, first)[of])
        weight = e / np.add.reduceat(e, first)[of]
        return some, np.add.reduceat(weight[:, None] * h, first, axis=0), first, of, h, t, s, weight


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def fit(row: np.ndarray, x: np.ndarray, y: np.ndarray, seed: int = 5) -> Model:
    """Adam on the log loss of documents; labels count by their inverse frequency. `row` ascends; y is by row."""
    rng = np.random.default_rng(seed)
    shapes = {"w": (WIDTH, HIDDEN), "b": (HIDDEN,), "v": (HIDDEN, GATE), "u": (HIDDEN, GATE), "a": (GATE,), "c": (HIDDEN,), "d": (1,)}
    p = {k: rng.normal(0, 1 / np.sqrt(s[0]), s) if k not in "bd" else np.zeros(s) for k, s in shapes.items()}
    m, q, step = {k: np.zeros(s) for k, s in shapes.items()}, {k: np.zeros(s) for k, s in shapes.items()}, 0
    weight = np.where(y == 1, 0.5 / max(y.mean(), 1e-6), 0.5 / max(1 - y.mean(), 1e-6))
    docs = np.unique(row)
    lo, hi = np.searchsorted(row, docs, "left"), np.searchsorted(row, docs, "right")
    for _ in range(EPOCHS):
        order = rng.permutation(len(docs))
        for k in range(0, len(docs), BATCH):
            some = np.sort(order[k:k + BATCH])
            take = np.concatenate([np.arange(lo[i], hi[i]) for i in some])
            model = Model(**p)
            ids, z, first, of, h, t, s, att = model._forward(row[take], x[take])
            d_o = (_sigmoid(z @ p["c"] + p["d"]) - y[ids]) * weight[ids] / len(ids)
            d_z = d_o[:, None] * p["c"]
            d_att = (d_z[of] * h).sum(axis=1)
            d_e = att * (d_att - np.add.reduceat(att * d_att, first)[of])
            d_g = d_e[:, None] * p["a"]
            d_t, d_s = d_g * s * (1 - t * t), d_g * t * s * (1 - s)
            d_h = (att[:, None] * d_z[of] + d_t @ p["v"].T + d_s @ p["u"].T) * (1 - h * h)
            grad = {"w": x[take].T @ d_h, "b": d_h.sum(axis=0), "v": h.T @ d_t, "u": h.T @ d_s, "a": (t * s).T @ d_e, "c": z.T @ d_o, "d": np.array([d_o.sum()])}
            step += 1
            for name, g in grad.items():
                g = g + 1e-4 * p[name] if name not in "bd" else g
                m[name] = 0.9 * m[name] + 0.1 * g
                q[name] = 0.999 * q[name] + 0.001 * g * g
                p[name] = p[name] - RATE * (m[name] / (1 - 0.9**step)) / (np.sqrt(q[name] / (1 - 0.999**step)) + 1e-8)
    return Model(**p)


def train(docs: DataFrame, labels: DataFrame, rows: Column, label: str = "quality", key: str = "doc_id", text: str = "text") -> Model:
    """Fit on a bounded sample of the labelled rows that `rows` admits. Passages are encoded on executors;
    at most 2 * TRAIN_EACH * TRAIN_PASSAGES of them come to the driver. Without rows of both labels the
    score is the smoothed share of label 1."""

    def encode(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offsets in rows_of(it, "text"):
            row, x = passages(data, offsets)
            n = np.bincount(row, minlength=part.num_rows)
            first = np.cumsum(n) - n
            keep = [np.unique(np.linspace(f, f + k - 1, min(k, TRAIN_PASSAGES)).astype(np.int64)) if k else np.zeros(0, np.int64) for f, k in zip(first.tolist(), n.tolist())]
            yield pa.record_batch([part.column("id"), part.column("y"), pa.array([x[i].tobytes() for i in keep], pa.binary())], ["id", "y", "x"])

    got = labelled(docs, labels, label, rows, TRAIN_EACH, key, text).mapInArrow(encode, "id long, y int, x binary").toPandas().sort_values("id")
    got = got[got.x.map(len) > 0]
    y = got.y.to_numpy(np.float64)
    if len(set(y)) < 2:
        zero = np.zeros
        share = (y.sum() + 1) / (len(y) + 2)
        return Model(zero((WIDTH, HIDDEN)), zero(HIDDEN), zero((HIDDEN, GATE)), zero((HIDDEN, GATE)), zero(GATE), zero(HIDDEN), np.array([np.log(share / (1 - share))]))
    xs = [np.frombuffer(b, np.float32).reshape(-1, WIDTH) for b in got.x]
    return fit(np.repeat(np.arange(len(xs)), [len(v) for v in xs]), np.concatenate(xs).astype(np.float64), y)


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text", whole: bool = False) -> DataFrame:
    """key, score (0 to 1, higher: better), predicted (1 from THRESHOLD up) for each row.

    Null and empty texts get the score of an empty bag; repeated rows get equal scores; other columns are
    ignored; no shuffle. With `whole`, `row` holds all columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    sent, place = row_with_text(docs, text) if whole else ([as_text(docs, text).alias("text")], None)

    def rate(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offsets in rows_of(text_of_row(it, place), "text"):
            s = shared.value.scores(*passages(data, offsets), part.num_rows)
            yield pa.record_batch([part.column("id"), pa.array(s), pa.array((s >= THRESHOLD).astype(np.int32)), *([part.column("row")] if whole else [])],
                                  ["id", "score", "predicted", *(["row"] if whole else [])])

    source = docs.select(F.col(key).cast("long").alias("id"), *sent)
    out = StructType.fromDDL("id long, score double, predicted int")
    if whole:
        out = out.add("row", source.schema["row"].dataType)
    return source.mapInArrow(rate, out).withColumnRenamed("id", key)
