"""Sets of hashed word shingles of whole texts."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import xxhash

from .common import give_back

_MULTIPLY, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


class _Words(dict):
    """64-bit hashes of words, remembered."""

    def __missing__(self, word: bytes) -> int:
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_WORDS = _Words()
_REMEMBER = 100_000


def forget() -> None:
    """Give back what was remembered; called at the end of a task, as its worker may serve other work."""
    _WORDS.clear()
    give_back()


def word_hashes(text: str) -> np.ndarray:
    """Hashes of the words (parts between the six ASCII white-space characters) of a text, A-Z in lower case."""
    if len(_WORDS) > _REMEMBER:
        _WORDS.clear()
    words = text.encode("utf-8", "surrogatepass").lower().split()
    return np.fromiter(map(_WORDS.__getitem__, words), np.uint64, len(words))


def mixed(hashes: np.ndarray) -> np.ndarray:
    """A bijective mix of 64-bit numbers."""
    hashes = hashes ^ (hashes >> np.uint64(32))
    hashes = hashes * _MIX
    return hashes ^ (hashes >> np.uint64(32))


def rolled(words: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of ``width`` words, in order."""
    n = len(words) - width + 1
    out = words[:n].copy()
    for k in range(1, width):
        out = out * _MULTIPLY + words[k : n + k]
    return mixed(out + np.uint64(width))


def shingle_set(text: str | None, width: int = 5) -> np.ndarray:
    """Sorted distinct hashes of runs of ``width`` words; of all words if there are fewer; empty without words."""
    words = word_hashes(text or "")
    return np.unique(rolled(words, min(width, len(words)))) if len(words) else words


def as_set_key(hashes: np.ndarray) -> int:
    """A signed 64-bit number for a set of hashes: equal sets, and only they but for chance, have equal ones."""
    return xxhash.xxh3_64_intdigest(hashes.tobytes()) - (1 << 63)


def concatenated(parts: Iterable[np.ndarray], dtype: type) -> np.ndarray:
    parts = list(parts)
    return np.concatenate(parts) if parts else np.zeros(0, dtype)
