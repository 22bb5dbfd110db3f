"""Words of a text as 64-bit hashes in numpy."""

from __future__ import annotations

import numpy as np
import xxhash

# A-Z to a-z; every byte that belongs to no word to a space.
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_ALNUM = bytes(_LOWER[b] if b >= 128 or 48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 else 32 for b in range(256))


def blank_words(text: str | None) -> list[bytes]:
    """Words between ASCII blanks ([^\\x20\\x09-\\x0D]+), A-Z lower-cased."""
    return text.encode("utf-8", "surrogatepass").translate(_LOWER).split() if text else []


def alnum_words(text: str | None) -> list[bytes]:
    """Runs of ASCII letters and digits and of anything beyond ASCII, A-Z lower-cased."""
    return text.encode("utf-8", "surrogatepass").translate(_ALNUM).split(b" ") if text else []


class _Hashes(dict):
    """xxHash64 of words, each computed once while there is room."""

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh64_intdigest(word)
        if len(word) <= 64:
            if len(self) >= 200_000:
                self.clear()
            self[word] = h
        return h


_KNOWN = _Hashes()


def hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_KNOWN.__getitem__, words), np.uint64, len(words))


def alnum_hashes(text: str | None) -> np.ndarray:
    return hashes([w for w in alnum_words(text) if w])


_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)  # fixed values: splitmix64's multipliers


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k words: one number for each start."""
    n = len(h) - k + 1
    if n <= 0:
        return h[:0]
    out = np.full(n, np.uint64(k), np.uint64)
    for i in range(k):
        out = mix(out + h[i : i + n])
    return out
