"""Words of whole texts as 64-bit hashes, with numpy over the bytes of an Arrow batch.

A word is a run of ASCII letters or non-ASCII bytes, A-Z in lower case. All bytes of a word
enter its hash. ``term_hashes`` adds the beginnings of longer words as terms of their own,
so that inflected forms of one stem meet.
"""

from __future__ import annotations

import numpy as np

_WORD = np.zeros(256, bool)
_WORD[65:91] = _WORD[97:123] = _WORD[128:] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_MASK = np.array([(1 << (8 * k)) - 1 for k in range(9)], dtype=np.uint64)
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def _scan(data: np.ndarray, at: np.ndarray):
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(at), np.int64), None
    low = np.concatenate([_LOWER[data], np.zeros(16, np.uint8)])
    inside = np.concatenate([[False], _WORD[data], [False]])
    edge = inside[1:] != inside[:-1]
    starts, ends = edge[:-1] & inside[1:-1], edge[1:] & inside[1:-1]
    inner = at[(at > 0) & (at < n)]
    glued = inner[inside[inner] & inside[inner + 1]]  # two texts meet without a gap
    starts[glued] = True
    ends[glued - 1] = True
    b, e = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    words = np.lib.stride_tricks.as_strided(low[:8].view(np.uint64), (len(low) - 8,), (1,))
    h = (e - b).astype(np.uint64) * _B
    todo = np.arange(len(b))
    k = 0
    while len(todo):
        rest = e[todo] - b[todo] - k
        x = words[b[todo] + k] & _MASK[np.minimum(rest, 8)]
        g = (h[todo] ^ x) * _A
        h[todo] = g ^ (g >> np.uint64(31))
        k += 8
        todo = todo[rest > 8]
    return h, np.searchsorted(b, at), (b, e, words)


STEMS = (4, 5, 6)


def word_hashes(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and each text's n + 1 offsets into them."""
    return _scan(data, at)[:2]


def term_hashes(data: np.ndarray, at: np.ndarray):
    """(hashes, number of the text each belongs to) of all words, then of the first 4, 5 and 6 bytes of the words that are longer."""
    h, first, scan = _scan(data, at)
    row = np.repeat(np.arange(len(at) - 1), np.diff(first))
    yield h, row
    if len(h):
        b, e, words = scan
        head = words[b]
        for k in STEMS:
            long = np.flatnonzero(e - b > k)
            g = (head[long] & _MASK[k]) * _B + np.uint64(k)
            g = (g ^ (g >> np.uint64(29))) * _A
            yield g ^ (g >> np.uint64(31)), row[long]
