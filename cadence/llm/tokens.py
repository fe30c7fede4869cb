"""Byte-level BPE ids of a public tokenizer file.

A tokenizer is loaded once per Python worker. Encoding runs on the ranks of the
file's own vocabulary (the id of a byte-level token is its merge rank); texts with
very long unbroken runs, on which that takes more than linear time, and files
whose vocabulary is not of this kind go through the tokenizers library. Both give
the same ids, which the tests check.
"""

from __future__ import annotations

import functools
import json
import re

import numpy as np
import regex
import tiktoken
from tokenizers import Tokenizer

#: Fixed value: the pre-token pattern of byte-level BPE files without one of their own.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Longest unbroken run that is encoded by ranks.
LONG_RUN = 2000
_LONG = re.compile(r"\S{%d}|\s{%d}" % (LONG_RUN, LONG_RUN))


def default_path() -> str:
    """The public tokenizer of the registered queries."""
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_of_char() -> dict[str, int]:
    """Byte-level files write each byte as a printable character: itself where it
    is one, else the next free one from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Encoder:
    """Ids of texts; special tokens in a text are found as the file says."""

    def __init__(self, path: str) -> None:
        self.slow = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        special = {t["content"] for t in model.get("added_tokens", [])}
        longest_first = sorted(special, key=lambda t: (-len(t), t))
        self.special = re.compile("|".join(map(re.escape, longest_first))) if special else None
        self.special_tokens, self.longest_special = special, max(map(len, special), default=0)
        chars, self.fast = _byte_of_char(), None
        vocab = model["model"]["vocab"]
        if model["model"]["type"] == "BPE" and (model.get("pre_tokenizer") or {}).get("type") == "ByteLevel":
            ranks = {bytes(chars[c] for c in t): i for t, i in vocab.items() if t not in special}
            self.fast = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.pre_tokens = regex.compile(PATTERN).findall

    def split(self, text: str) -> list[str]:
        """Pre-tokens of a text; a special token written out in it is one of its own."""
        if self.special is None:
            return self.pre_tokens(text)
        out, at = [], 0
        for m in self.special.finditer(text):
            out += [*self.pre_tokens(text[at:m.start()]), m.group()]
            at = m.end()
        return out + self.pre_tokens(text[at:]) if at else self.pre_tokens(text)

    def ids(self, text: str) -> np.ndarray:
        if self.fast is None or self.special and self.special.search(text) or _LONG.search(text):
            return np.array(self.slow.encode(text, add_special_tokens=False).ids, np.uint32)
        return np.array(self.fast.encode_ordinary(text), np.uint32)

    def piece_tokens(self, piece: str) -> int:
        """Number of tokens of one pre-token."""
        if piece in self.special_tokens:
            return 1
        if len(piece) >= LONG_RUN or self.fast is None:
            return len(self.slow.encode(piece, add_special_tokens=False).ids)
        return len(self.fast.encode_ordinary(piece))


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)
