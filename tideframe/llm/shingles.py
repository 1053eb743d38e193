"""Hashes of five-word shingles, whole texts at a time.

Words are runs other than ASCII white space, with A-Z lower-cased. A word's hash is a sum of random
64-bit values of its bytes times powers of an odd multiplier; a shingle's hash mixes those of its
words in order. A text of fewer words than a shingle has one shingle, its whole sequence; a text
without words has none.
"""

from __future__ import annotations

import numpy as np

SIZE = 5
_MULTIPLIER = 0x9E3779B97F4A7C15
_REACH = 1 << 12


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240229)
    value = rng.integers(1, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
    value[ord("A") : ord("Z") + 1] = value[ord("a") : ord("z") + 1]
    space = np.zeros(256, bool)
    space[[0x20, *range(0x09, 0x0E)]] = True
    value[space] = 0
    power = np.cumprod(np.full(_REACH, _MULTIPLIER, np.uint64), dtype=np.uint64)
    return value, space, power


_VALUE, _SPACE, _POWER = _tables()


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xA0761D6478BD642F)
    return x ^ (x >> np.uint64(32))


def word_hashes(data: bytes) -> np.ndarray:
    """Hash of each word of a UTF-8 text."""
    raw = np.frombuffer(data, np.uint8)
    if not len(raw):
        return np.empty(0, np.uint64)
    space = _SPACE[raw]
    begins = np.flatnonzero(~space & np.append(True, space[:-1]))
    if not len(begins):
        return np.empty(0, np.uint64)
    place = np.arange(len(raw)) - np.repeat(begins, np.diff(np.append(begins, len(raw)))) if begins[0] == 0 else None
    if place is None:
        raw, begins = raw[begins[0] :], begins - begins[0]
        place = np.arange(len(raw)) - np.repeat(begins, np.diff(np.append(begins, len(raw))))
    terms = _VALUE[raw]
    if place.max() < _REACH:
        terms = terms * _POWER[place]
    else:  # a very long word, or very much white space: later stretches are weighed by their number too
        terms = terms * _POWER[place % _REACH]
        late = np.flatnonzero(place >= _REACH)  # the first stretch is not, so that words hash alike in all texts
        terms[late] *= mix((place[late] // _REACH).astype(np.uint64) + np.uint64(1))
    return mix(np.add.reduceat(terms, begins))


def shingle_hashes(text: str | None, size: int = SIZE) -> np.ndarray:
    """Distinct shingle hashes of a text, ascending."""
    words = word_hashes(text.encode("utf-8", "surrogatepass")) if text else np.empty(0, np.uint64)
    if not len(words):
        return words
    if len(words) < size:
        total = np.uint64(len(words)) * np.ones(1, np.uint64)
        for w in words:
            total = mix(total * np.uint64(_MULTIPLIER) + w)
        return total
    total = words[: len(words) - size + 1].copy()
    for k in range(1, size):
        total = total * np.uint64(_MULTIPLIER) + words[k : len(words) - size + 1 + k]
    return np.unique(mix(total))
