"""Byte-level BPE ids of whole texts, and the bytes each id stands for.

The vocabulary file is a parameter and is read once in each Python worker. Ids equal those that the tokenizers
library gives with add_special_tokens=False, special strings in a text as their own ids; tests compare the two.
"""

from __future__ import annotations

import json
from functools import lru_cache

import numpy as np


def byte_letters() -> dict[str, int]:
    """The letter that byte-level vocabularies write for each byte: printable ones stand for themselves, the others follow from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteBpe:
    def __init__(self, path: str, pattern: str | None = None) -> None:
        import public_tokenizers
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        ranks = {bytes(letters[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
        named = ranks | {token.encode(): i for token, i in special.items()}
        self.sizes = np.zeros(max(named.values()) + 1, np.int64)
        for token, i in named.items():
            self.sizes[i] = len(token)
        self._encoding = tiktoken.Encoding("byte_bpe", pat_str=pattern or public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)

    def encode(self, text: str) -> np.ndarray:
        """The ids of a text as unsigned 32-bit integers, none for an empty one."""
        return np.asarray(self._encoding.encode_to_numpy(text, allowed_special="all"), np.uint32)


@lru_cache(maxsize=2)
def byte_bpe(path: str) -> ByteBpe:
    return ByteBpe(path)
