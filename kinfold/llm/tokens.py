"""Byte-level BPE over chunks of text that are encoded once each.

Where white space is single spaces and single line ends, cutting in front of each space and around each
line end never cuts a match of the pre-tokenizer's pattern in two, nor changes where its matches lie. Such
chunks repeat, so their ids are kept in a bounded cache. Other texts are cut by the pattern itself.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
import regex

#: White space of the pattern's \s: the Unicode property White_Space.
_SPACE = r"\t-\r \x85\xa0  -     　"
_ODD = re.compile(rf"[ \n][{_SPACE}]|[\x00\t\x0b-\r\x85\xa0  -     　]")


def pretoken_pattern(pattern: str) -> regex.Pattern:
    """The tokenizer's pattern for Python, with its white space spelt out."""
    return regex.compile(pattern.replace(r"[^\s", rf"[^{_SPACE}").replace(r"\s", f"[{_SPACE}]").replace(r"\S", f"[^{_SPACE}]"))


def chunks(text: str, pattern: regex.Pattern) -> list[str]:
    """Strings whose encodings, one after the other, are the encoding of ``text``."""
    if _ODD.search(text):
        return pattern.findall(text)
    return text.replace(" ", "\0 ").replace("\n", "\0\n\0").split("\0")


def rank_encoder(vocabulary: dict[str, int], pattern: str) -> Callable[[str], list[int]]:
    """An encoder from a byte-level vocabulary in which merges are numbered in their order, as the tokenizers
    library reads it. Each printable byte stands for itself there; the others, in order, for U+0100 and on."""
    import tiktoken

    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    byte = {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
    ranks = {bytes(byte[c] for c in token): n for token, n in vocabulary.items() if all(c in byte for c in token)}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


class ChunkEncoder:
    """Texts to little-endian unsigned 32-bit ids. ``encode_many`` encodes a list of chunks; at most
    ``entries`` of them are remembered at a time, and none of over ``longest`` characters."""

    def __init__(self, encode_many: Callable[[list[str]], list[list[int]]], pattern: str, entries: int = 300_000, longest: int = 200):
        self.encode_many, self.pattern, self.entries, self.longest = encode_many, pretoken_pattern(pattern), entries, longest
        self.known: dict[str, bytes] = {"": b""}

    def encode(self, text: str) -> bytes:
        parts = chunks(text, self.pattern)
        new = list(set(parts).difference(self.known))
        if not new:
            return b"".join(map(self.known.__getitem__, parts))
        if len(self.known) + len(new) > self.entries:
            self.known = {"": b""}
            new = list(set(parts) - {""})
        found = {c: np.asarray(ids, dtype="<u4").tobytes() for c, ids in zip(new, self.encode_many(new), strict=True)}
        both = self.known | found if len(found) > 50_000 else self.known
        if both is self.known:
            self.known.update((c, b) for c, b in found.items() if len(c) <= self.longest)
            long = {c: b for c, b in found.items() if len(c) > self.longest}
            if long:
                return b"".join([long[c] if c in long else self.known[c] for c in parts])
        return b"".join(map(both.__getitem__, parts))
