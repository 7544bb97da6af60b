"""Vectorised word tokeniser shared by the text operators.

A *word* is a maximal run of ``\\w`` characters of the NFKC-normalised, case-folded text.  A batch of
texts becomes flat numpy arrays (one 64-bit hash per word, row offsets), so the operators never loop
over words in Python.  Null and empty texts have zero words.
"""

from __future__ import annotations

import re
import unicodedata

import numpy as np

_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1
_ODD = re.compile(r"[^\x00-\x7f\w]")
_NON_WORD = re.compile(r"\W+")


def _byte_tables() -> tuple[np.ndarray, np.ndarray]:
    value, word = np.zeros(256, np.uint64), np.zeros(256, bool)
    for b in range(256):
        c = chr(b).lower() if b < 128 else ""
        word[b] = b >= 128 or c.isalnum() or c == "_"
        value[b] = (ord(c) if c else b) + 1
    return value, word


def fold(text: str | None) -> str:
    """NFKC and case folding with every non-word character beyond ASCII turned into a space."""
    if not text:
        return ""
    if text.isascii():
        return text
    text = unicodedata.normalize("NFKC", text).casefold()
    return _NON_WORD.sub(" ", text) if _ODD.search(text) else text


def words_of(text: str | None) -> list[str]:
    """The words of one text; the definition that the vectorised form follows."""
    return re.findall(r"\w+", fold(text).lower())


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (uint64 in, uint64 out)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Tokeniser:
    """Hashes words of batches; holds the power tables, which grow to the longest batch seen."""

    def __init__(self) -> None:
        self.value, self.word = _byte_tables()
        self.power = self.inverse = np.ones(1, np.uint64)

    def _powers(self, n: int) -> None:
        if len(self.power) < n:
            n = 1 << (n - 1).bit_length()
            for name, base in (("power", _BASE), ("inverse", pow(_BASE, -1, 1 << 64))):
                p = np.full(n, base & _MASK, np.uint64)
                p[0] = 1
                setattr(self, name, np.multiply.accumulate(p))

    def __call__(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(hash of each word, offsets): the words of text i are ``hash[offsets[i]:offsets[i + 1]]``."""
        parts = [fold(t).encode("utf-8", "replace") for t in texts]
        ends = np.cumsum([len(p) + 1 for p in parts], dtype=np.int64) if parts else np.zeros(0, np.int64)
        raw = np.frombuffer(b"\n".join(parts) + b"\n", np.uint8)
        self._powers(len(raw) + 1)
        inside = self.word[raw]
        edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        if len(inside) and inside[0]:
            edge = np.concatenate(([0], edge))
        start, end = edge[0::2], edge[1::2]
        sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(np.where(inside, self.value[raw] * self.power[: len(raw)], np.uint64(0)), out=sums[1:])
        h = (sums[end] - sums[start]) * self.inverse[start]
        h = mix64(h + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        return h, np.concatenate((np.zeros(1, np.int64), np.searchsorted(start, ends).astype(np.int64)))


def slices(texts: list[str | None], limit: int = 250_000):
    """Ranges (i, j) of consecutive texts of about ``limit`` characters; a longer text is alone."""
    i = total = 0
    for j, t in enumerate(texts):
        n = len(t) if t else 0
        if total and total + n > limit:
            yield i, j
            i, total = j, 0
        total += n
    if i < len(texts):
        yield i, len(texts)
