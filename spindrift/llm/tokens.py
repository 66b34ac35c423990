"""Exact token ids of whole texts at vocabulary speed.

The public word tokenizer never joins characters across white space, nor across the border
between Latin letters and plain ASCII punctuation, so a text's ids are the concatenation of
its segments' ids. A batch is cut into segments with numpy; each worker keeps a hash table
from segment bytes to ids, and the tokenizers library sees a distinct segment once per
worker. Segments that the rules below do not cover are encoded by the library as they stand.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa

from spindrift.llm.common import raw

SLOT_BITS = 21
MOST_KEYS = 1_200_000

_LETTERS = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ]+")
_SPACE, _LETTER, _PUNCT, _OTHER = 0, 1, 2, 3


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _classes() -> np.ndarray:
    """Byte classes: ASCII white space; letters (UTF-8 of Latin-1 letters included); punctuation that takes part in no contraction, number or special token; all else."""
    c = np.full(256, _OTHER, np.uint8)
    c[list(b" \t\n\v\f\r")] = _SPACE
    c[65:91] = c[97:123] = c[0x80:0xC0] = c[0xC3] = _LETTER
    c[list(b".,!?;:%$&*#-/()\"+=@")] = _PUNCT
    return c


_CLASS = _classes()
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_MASK = np.array([(1 << (8 * k)) - 1 for k in range(9)], dtype=np.uint64)
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


class Words:
    """Segment-wise encoder of one tokenizer file; equal to ``Tokenizer.encode(text, add_special_tokens=False)``."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.byte_letters = self._byte_letters()
        self._reset()

    def _reset(self) -> None:
        n = 1 << SLOT_BITS
        self.keys = np.zeros((3, n), np.uint64)
        self.value = np.full(n, -1, np.int32)
        self.size = 0
        self.pool = np.zeros(1 << 20, np.uint32)
        self.used = 0
        self.starts, self.lens = (np.zeros(1 << 18, np.int64) for _ in range(2))
        self.count = 0
        self.rare: dict[bytes, int] = {}

    @staticmethod
    def _byte_letters() -> dict[int, str]:
        """The byte-level alphabet: printable Latin-1 bytes stand for themselves, the others for code points from 256 on."""
        kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
        out = {b: chr(b) for b in kept}
        rest = [b for b in range(256) if b not in out]
        return out | {b: chr(256 + i) for i, b in enumerate(rest)}

    def encode_segment(self, data: bytes) -> list[int]:
        word = data.decode("utf-8", "replace")
        if _LETTERS.fullmatch(word):
            # A run of Latin letters is one pre-token that no normaliser composes: the BPE model can be asked at once.
            low = word.lower()
            if not low.isascii():
                low = "".join(map(self.byte_letters.__getitem__, low.encode()))
            return [t.id for t in self.model.tokenize(low)]
        return self.tokenizer.encode(word, add_special_tokens=False).ids

    def _add(self, segments: list[bytes]) -> np.ndarray:
        """Encode new segments; their numbers."""
        each = [self.encode_segment(x) for x in segments]
        lens = np.fromiter(map(len, each), np.int64, len(each))
        total, n = int(lens.sum()), len(each)
        if self.used + total > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros(max(len(self.pool), total), np.uint32)])
        if self.count + n > len(self.starts):
            self.starts, self.lens = (np.concatenate([x, np.zeros(max(len(x), n), np.int64)]) for x in (self.starts, self.lens))
        self.pool[self.used : self.used + total] = np.fromiter((i for ids in each for i in ids), np.uint32, total)
        new = slice(self.count, self.count + n)
        self.starts[new], self.lens[new] = self.used + np.cumsum(lens) - lens, lens
        self.used += total
        self.count += n
        return np.arange(new.start, new.stop)

    def _segments(self, data: np.ndarray, at: np.ndarray):
        """Starts, ends and whether short and regular, of all segments."""
        n = len(data)
        cls = _CLASS[data]
        wrong = np.flatnonzero(data == 0xC3)
        if len(wrong):  # the multiplication and division signs are no letters
            follow = data[np.minimum(wrong + 1, n - 1)]
            cls[wrong[(follow == 0x97) | (follow == 0xB7)]] = _OTHER
        cut = np.empty(n, bool)
        cut[0] = True
        np.not_equal(cls[1:], cls[:-1], out=cut[1:])
        inner = at[(at > 0) & (at < n)]
        cut[inner] = True
        if (cls == _OTHER).any():  # words with anything else stay whole
            word = np.empty(n, bool)
            word[0] = True
            space = cls == _SPACE
            np.not_equal(space[1:], space[:-1], out=word[1:])
            word[inner] = True
            w = np.flatnonzero(word)
            odd = np.maximum.reduceat(cls, w) == _OTHER
            spread = np.repeat(odd, np.diff(np.append(w, n)))
            cut = np.where(spread, word, cut)
            cls = np.where(spread & (cls != _SPACE), np.uint8(_OTHER), cls)
        b = np.flatnonzero(cut)
        e = np.append(b[1:], n)
        c = cls[b]
        keep = c != _SPACE
        b, e, c = b[keep], e[keep], c[keep]
        return b, e, (c != _OTHER) & (e - b <= 24)

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a large_string array, one after another, and each text's n + 1 offsets into them."""
        data, at = raw(column)
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(len(column) + 1, np.int64)
        if self.size > MOST_KEYS or len(self.rare) > MOST_KEYS // 4:
            self._reset()
        b, e, regular = self._segments(data, at)
        value = np.full(len(b), -1, np.int64)
        r = np.flatnonzero(regular)
        value[r] = self._look(data, b[r], e[r])
        view = memoryview(np.ascontiguousarray(data))
        rare = self.rare
        odd = np.flatnonzero(~regular)
        if len(odd):
            found = [bytes(view[i:j]) for i, j in zip(b[odd].tolist(), e[odd].tolist())]
            new = [w for w in dict.fromkeys(found) if w not in rare]
            now = dict(zip(new, self._add(new).tolist()))
            rare.update((w, v) for w, v in now.items() if len(w) <= 64)
            value[odd] = [now[w] if w in now else rare[w] for w in found]
        lens = self.lens[value]
        ends = np.cumsum(lens)
        total = int(ends[-1]) if len(ends) else 0
        ids = self.pool[np.repeat(self.starts[value] - (ends - lens), lens) + np.arange(total)]
        first = np.searchsorted(b, at)  # segments before each text
        return ids, np.concatenate([[0], ends])[first].astype(np.int64)

    def _look(self, data: np.ndarray, b: np.ndarray, e: np.ndarray) -> np.ndarray:
        low = np.concatenate([_LOWER[data], np.zeros(32, np.uint8)])
        words = np.lib.stride_tricks.as_strided(low[:8].view(np.uint64), (len(low) - 8,), (1,))
        size = e - b
        k0 = words[b] & _MASK[np.minimum(size, 8)]
        k1 = words[b + 8 * (size > 8)] & _MASK[np.clip(size - 8, 0, 8)]
        k2 = words[b + 16 * (size > 16)] & _MASK[np.clip(size - 16, 0, 8)]
        h = k0 * _MIX[0] ^ k1 * _MIX[1] ^ k2 * _MIX[2]
        h ^= h >> np.uint64(29)
        h *= _MIX[3]
        slot = (h >> np.uint64(64 - SLOT_BITS)).astype(np.int64)
        out = np.full(len(b), -1, np.int64)
        todo = np.arange(len(b))
        missing = []
        wrap = (1 << SLOT_BITS) - 1
        while len(todo):
            s = slot[todo]
            v = self.value[s]
            same = (v >= 0) & (self.keys[0][s] == k0[todo]) & (self.keys[1][s] == k1[todo]) & (self.keys[2][s] == k2[todo])
            out[todo[same]] = v[same]
            missing.append(todo[v < 0])
            todo = todo[(v >= 0) & ~same]
            slot[todo] = (slot[todo] + 1) & wrap
        new = np.concatenate(missing) if missing else todo
        if len(new):
            order = np.lexsort((k2[new], k1[new], k0[new]))
            new = new[order]
            a0, a1, a2 = k0[new], k1[new], k2[new]
            first = np.empty(len(new), bool)
            first[0] = True
            first[1:] = (a0[1:] != a0[:-1]) | (a1[1:] != a1[:-1]) | (a2[1:] != a2[:-1])
            group = np.cumsum(first) - 1
            lead = new[first]
            view = memoryview(low)
            got = self._add([bytes(view[i:j]) for i, j in zip(b[lead].tolist(), e[lead].tolist())])
            self._insert(lead, slot[lead], got, k0, k1, k2)
            out[new] = got[group]
        return out

    def _insert(self, lead, slot, value, k0, k1, k2) -> None:
        """Put distinct new keys into free slots; those that one huge batch has beyond the table's room are not kept."""
        wrap = (1 << SLOT_BITS) - 1
        room = wrap * 3 // 4 - self.size
        lead, slot, value = lead[:room], slot[:room], value[:room]
        self.size += len(lead)
        while len(lead):
            free = self.value[slot] < 0
            at = np.flatnonzero(free)
            _, one = np.unique(slot[at], return_index=True)
            won = at[one]
            s = slot[won]
            self.value[s] = value[won]
            self.keys[0][s], self.keys[1][s], self.keys[2][s] = k0[lead[won]], k1[lead[won]], k2[lead[won]]
            left = np.ones(len(lead), bool)
            left[won] = False
            lead, slot, value = lead[left], (slot[left] + 1) & wrap, value[left]


_WORKER: dict[str, Words] = {}


def words(path: str) -> Words:
    """The worker's encoder, kept between tasks."""
    if path not in _WORKER:
        _WORKER[path] = Words(path)
    return _WORKER[path]
