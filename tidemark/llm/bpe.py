"""A byte-level BPE file of the tokenizers library, loaded once in a worker process."""

from __future__ import annotations

import json
from dataclasses import dataclass
from functools import cache

import numpy as np
import tiktoken


@dataclass(frozen=True)
class Bpe:
    """ids of texts by `encode`; `tokens[id]` is a token's bytes; `merges` maps pairs of ids to the id of
    their merge, which is also its rank; `special` maps strings to ids."""
    encoding: tiktoken.Encoding
    tokens: list[bytes]
    ranks: dict[bytes, int]
    merges: dict[tuple[int, int], int]
    special: dict[str, int]

    def encode(self, text: str) -> np.ndarray:
        return np.array(self.encoding.encode(text, allowed_special="all"), dtype=np.uint32)


def _byte_of() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies: printable bytes stand for themselves, the rest
    follow from U+0100 in byte order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


@cache
def load(path: str) -> Bpe:
    """The vocabulary of a tokenizers .json with a ByteLevel pre-tokenizer, as ranks.

    Equal to the library where ids ascend with the merges, which is checked; its pattern is the one that
    the ByteLevel pre-tokenizer fixes."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, pre = spec["model"], spec["pre_tokenizer"]
    if model["type"] != "BPE" or pre["type"] != "ByteLevel" or pre["add_prefix_space"] or not pre["use_regex"] or spec["normalizer"]:
        raise ValueError("only byte-level BPE files without normaliser or prefix space are read")
    byte_of = _byte_of()
    raw = lambda token: bytes(byte_of[c] for c in token)
    ranks = {raw(t): i for t, i in model["vocab"].items()}
    pairs = [tuple(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
    merged = [model["vocab"][a + b] for a, b in pairs]
    merges = {(model["vocab"][a], model["vocab"][b]): m for (a, b), m in zip(pairs, merged)}
    if merged != sorted(merged) or len(merged) + 256 != len(ranks):
        raise ValueError("ids must ascend with the merges")
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    tokens = [b""] * (max([*ranks.values(), *special.values()]) + 1)
    for t, i in [*ranks.items(), *((s.encode(), i) for s, i in special.items())]:
        tokens[i] = t
    # the fixed pattern of byte-level BPE
    pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    encoding = tiktoken.Encoding("byte-level", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)
    return Bpe(encoding, tokens, ranks, merges, special)
