"""Transcription as a partition map over user-supplied recognisers."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

RATE = 16_000


class RecogniserError(Exception):
    """A recogniser could not answer; the next one in order is tried."""


def transcribe(windows: DataFrame, recognisers: Sequence[tuple[str, Callable[[], Callable]]],
               language: str | None = None, gap_s: float = 0.3) -> DataFrame:
    """(window_id, chunk_id, backend, response, error) for packed windows.

    `windows`: window_id and parts, an array of (ord, chunk_id, pcm). Recognisers are
    `(name, make)`; `make()` loads a model once per task and returns
    `f(samples float32, language) -> dict` in the verbose JSON shape. They are tried in order. A
    reply without words for a window of several chunks is redone one chunk at a time, starting
    from the recogniser that answered; `chunk_id` is NULL for a reply about the whole window.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        loaded: dict[str, Callable] = {}

        def ask(samples: np.ndarray, start: int) -> tuple[dict | None, int, str | None]:
            errors = []
            for i in range(start, len(recognisers)):
                name, make = recognisers[i]
                try:
                    if name not in loaded:
                        loaded[name] = make()
                    return loaded[name](samples, language), i, None
                except RecogniserError as e:
                    errors.append(f"{name}: {e}")
            return None, start, "; ".join(errors) or "no recogniser"

        gap = np.zeros(round(gap_s * RATE), np.float32)
        for pdf in batches:
            out = []
            for window_id, parts in pdf[["window_id", "parts"]].itertuples(index=False):
                audio = [(p["chunk_id"], np.frombuffer(p["pcm"], "<i2").astype(np.float32) / 32768.0)
                         for p in sorted(parts, key=lambda p: p["ord"])]
                joined = np.concatenate([x for i, (_, a) in enumerate(audio) for x in ([gap, a] if i else [a])])
                reply, used, error = ask(joined, 0)
                if reply is not None and len(audio) > 1 and reply.get("segments") and not _has_words(reply):
                    for chunk_id, a in audio:
                        reply, used, error = ask(a, used)
                        out.append((window_id, chunk_id, recognisers[used][0], _dump(reply), error))
                    continue
                out.append((window_id, None, recognisers[used][0], _dump(reply), error))
            frame = pd.DataFrame(out, columns=["window_id", "chunk_id", "backend", "response", "error"])
            yield frame.astype({"chunk_id": "Int64"})

    return windows.select("window_id", "parts").mapInPandas(
        run, "window_id bigint, chunk_id bigint, backend string, response string, error string")


def _dump(reply: dict | None) -> str | None:
    return None if reply is None else json.dumps(reply, ensure_ascii=False)


def _has_words(reply: dict) -> bool:
    return bool(reply.get("words")) or any(s.get("words") for s in reply.get("segments") or [])
