"""Byte-level BPE ids of whole texts, with a bounded cache of pieces.

The pre-tokeniser's pattern always ends a token before a single blank or line feed that stands
between two characters that aren't white space. So a text may be cut there, and the ids of a cut
piece never depend on its neighbours. Pieces repeat a lot; each distinct one is encoded once while
it stays in the cache. Texts with other runs of white space are encoded in one go. Where a text spells
an added token of the file, that token is one id, as the library gives it, and the text before and
after it are texts of their own.
"""

from __future__ import annotations

import json
import re

import numpy as np

#: Fixed value: the pre-tokeniser's pattern of the public vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
CACHE = 400_000


def vocabulary(path: str) -> tuple[dict[bytes, int], dict[str, int]]:
    """Ids by bytes, and the ids of added tokens by their text. The file spells each byte as a
    printable character: the 188 printable ones of Latin-1 as themselves, the others, in order, as
    those from U+0100."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    byte = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    added = spec.get("added_tokens", [])
    if any(t[flag] for t in added for flag in ("single_word", "lstrip", "rstrip", "normalized")):
        raise ValueError(f"{path}: added tokens that take in their surroundings aren't supported")
    special = {t["content"]: t["id"] for t in added}
    return {bytes(byte[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in special}, special


class _Odd(Exception):
    """A piece with white space at its edge."""


class _Pieces(dict):
    def __init__(self, coder, lead: str):
        super().__init__()
        self.coder, self.lead = coder, lead

    def __missing__(self, piece: str) -> bytes:
        if not piece or piece[0].isspace() or piece[-1].isspace():
            raise _Odd
        if len(self) >= CACHE:
            self.clear()
        out = np.array(self.coder.encode_ordinary(self.lead + piece), "<u4").tobytes()
        if len(piece) <= 64:
            self[piece] = out
        return out


class Coder:
    """Texts to ids, packed as little-endian unsigned 32-bit numbers."""

    def __init__(self, path: str):
        import tiktoken

        ranks, added = vocabulary(path)
        self.bpe = tiktoken.Encoding("bytes", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.added = {t: np.array([i], "<u4").tobytes() for t, i in added.items()}
        self.parts = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")")
        self.first, self.rest = _Pieces(self.bpe, ""), _Pieces(self.bpe, " ")
        self.feed = self.whole("\n")

    def whole(self, text: str) -> bytes:
        return np.array(self.bpe.encode_ordinary(text), "<u4").tobytes()

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if any(t in text for t in self.added):
            return b"".join(self.added[part] if part in self.added else self.plain(part) for part in self.parts.split(text))
        return self.plain(text)

    def plain(self, text: str) -> bytes:
        """Of a text without added tokens."""
        if not text:
            return b""
        out, first, rest = [], self.first, self.rest.__getitem__
        try:
            for line in text.split("\n"):
                head, *tail = line.split(" ")
                out.append(first[head] + b"".join(map(rest, tail)) if tail else first[head])
        except _Odd:
            return self.whole(text)
        return self.feed.join(out)
