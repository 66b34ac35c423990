"""Benchmark decontamination by CGK embedding, bit-sampling LSH and exact edit verification.

Texts are compared in lower case (ASCII and Latin-1) with white space as single spaces, over bytes. A CGK walk
reads a window with one pointer: at every step it emits the byte under the pointer and
moves on by one random bit that depends on the step and that byte. Walks that meet stay
together, so edit distance becomes Hamming distance of the emitted strings. A hash of
sampled steps collides for windows at a small Hamming distance. Windows begin at every
word (and at every character of three or more bytes, as some scripts have no spaces), in
every document and every item, and their size follows the item's size class, so a long
item is looked for by many overlapping windows. Repetitions use independent walks.

Samples and walks are tuned on edited copies of all items before the run: for each size
class the most samples with which at most MOST_REPETITIONS of its walks find ``recall`` of the
copies with ``edit_rate`` of their letters edited, as many as a match may differ by, and
LEAST_RECALL of each item's own copies. Items that no such setting finds often enough are
looked for everywhere by an exact search, so there is no cap on what can be found.

A collision aligns an item with a place in a document. A stretch of up to LOCAL bytes of
the item around the window must be within LOCAL_RATE of the text there (Myers' bit vectors
over many collisions at once; tuning counts what this misses as not found). Then the exact
edit distance of the whole item to the best stretch around the place decides: contaminated
if it is at most ``distance`` of its size.

A window leaves a walk as soon as its sampled bytes so far begin no item's key, so most
windows cost a few steps. Items are broadcast in blocks of at most ITEM_BLOCK bytes with their
index, which takes up to about 16 times as much (a key of 16 bytes for each window and
walk, and packed bit maps); a larger benchmark takes several passes, one block at a time.

Defined cases: null and blank documents match nothing; null and blank items are nobody's
contamination; items with equal text count as one, under the smallest of their ids (null
if all are null); repeated rows are reported once for each row, null doc_ids included;
empty tables give no rows; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.llm import common

DISTANCE = 0.2
EDIT_RATE = DISTANCE
RECALL = 0.97
LEAST_RECALL = 0.9  # of an item's own copies, else it is looked for exactly
MOST_REPETITIONS = {32: 5, 16: 8, 8: 8}  # by walk: short ones collide more often, and more of them may sample more steps
COPIES = 20_000  # edited copies to measure recall on, 3 to 20 of each item
STEPS = (32, 16, 8)  # walks by item size class: an item takes the longest walk within half its size, so that several windows can find it
SAMPLES = (14, 12, 10, 8, 6, 5, 4)
ITEM_BLOCK = 4 << 20
LOCAL = 64
LOCAL_RATE = 0.3
_LANES = 8192

_SPACE = np.zeros(256, bool)
_SPACE[list(b" \t\n\v\f\r")] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_FOLD[list(b"\t\n\v\f\r")] = 32


def fold(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower case and single spaces; a space stands before and after each text, so texts never touch."""
    n = len(at) - 1
    grown = np.full(len(data) + 2 * n, 32, np.uint8)
    shift = np.repeat(2 * np.arange(n) + 1, np.diff(at))
    low = _FOLD[data]
    latin = np.flatnonzero(data[:-1] == 0xC3) + 1  # capitals of Latin-1 in UTF-8
    capital = latin[(data[latin] >= 0x80) & (data[latin] <= 0x9E) & (data[latin] != 0x97)]
    low[capital] += 32
    grown[np.arange(len(data)) + shift] = low
    starts = at + 2 * np.arange(n + 1)
    keep = np.ones(len(grown), bool)
    keep[1:] = (grown[1:] != 32) | (grown[:-1] != 32)
    keep[starts[:-1]] = True
    return grown[keep], np.concatenate([[0], np.cumsum(keep)])[starts]


def folded(text: str) -> bytes:
    b = text.encode("utf-8", "replace")
    out, _ = fold(np.frombuffer(b, np.uint8), np.array([0, len(b)]))
    return out.tobytes().strip()


class Walk:
    """One repetition: the random bits of a walk and the steps whose bytes make the key."""

    def __init__(self, steps: int, samples: int, seed: int):
        r = np.random.default_rng(seed)
        self.steps = steps
        self.move = r.integers(0, 2, (steps, 256), dtype=np.int64)
        self.sampled = np.sort(r.choice(steps, min(samples, steps), replace=False)).tolist()
        self.odd = np.uint64(r.integers(1 << 62) * 2 + 1)
        n = len(self.sampled)
        self.sieved = [k for k in range(1, n + 1) if k % 2 == 0 or k == n]  # samples after which windows are sieved

    def keys(self, text: np.ndarray, starts: np.ndarray, sieve=None):
        """Places of the windows that stay, and their keys. ``sieve(samples so far, keys)`` tells which stay."""
        i, key, alive = starts.copy(), np.zeros(len(starts), np.uint64), np.arange(len(starts))
        done = 0
        for t in range(self.sampled[-1] + 1):
            c = text[i]
            if t == self.sampled[done]:
                key = (key ^ (c + np.uint64(1))) * self.odd
                key ^= key >> np.uint64(29)
                done += 1
                if sieve is not None and done in self.sieved:
                    ok = np.flatnonzero(sieve(done, key))
                    if len(ok) < len(key):
                        i, key, alive, c = i[ok], key[ok], alive[ok], c[ok]
            i += self.move[t][c]
        return alive, key


class Table:
    """The keys of one walk over the items' windows, sorted, and bit maps of their beginnings."""

    def __init__(self, walk: Walk, text: np.ndarray, starts: np.ndarray, item: np.ndarray, offset: np.ndarray):
        self.walk, self.maps = walk, {}
        bits = 18 if len(starts) < 1 << 15 else 22
        self.shift = np.uint64(64 - bits)

        def note(done, key):
            seen = np.zeros(1 << bits, bool)
            seen[(key >> self.shift).astype(np.int64)] = True
            self.maps[done] = np.packbits(seen, bitorder="little")
            return np.ones(len(key), bool)

        _, key = walk.keys(text, starts, note)
        order = np.argsort(key, kind="stable")
        self.key, self.item, self.offset = key[order], item[order].astype(np.int32), offset[order].astype(np.int32)

    def collisions(self, text: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(window in text, item, window in item) of all equal keys."""

        def begins(done, key):
            at = (key >> self.shift).astype(np.int64)
            return self.maps[done][at >> 3] >> (at & 7).astype(np.uint8) & 1

        alive, key = self.walk.keys(text, starts, begins)
        lo, hi = np.searchsorted(self.key, key), np.searchsorted(self.key, key, "right")
        n = hi - lo
        at = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        return np.repeat(starts[alive], n), self.item[at], self.offset[at]


def word_starts(text: np.ndarray) -> np.ndarray:
    """Places after a space that hold none, and every character of three or more bytes."""
    return np.flatnonzero(((text[1:] != 32) & (text[:-1] == 32)) | (text[1:] >= 0xE0)) + 1


def _masks(patterns: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Rows of up to 64 bytes as bit masks: for each row and byte value, where in the row it stands."""
    eq = np.zeros((len(patterns), 256), np.uint64)
    row = np.arange(len(patterns))
    for i in range(patterns.shape[1]):
        own = row[sizes > i]
        eq[own, patterns[own, i]] |= np.uint64(1) << np.uint64(i)
    return eq


class Lanes:
    """Myers' bit vectors for many patterns of up to 64 bytes side by side, each against a text of its own."""

    def __init__(self, sizes: np.ndarray):
        self.pv, self.mv = np.full(len(sizes), ~np.uint64(0)), np.zeros(len(sizes), np.uint64)
        self.score, self.top, self.one = sizes.astype(np.int64), (sizes - 1).astype(np.uint64), np.uint64(1)

    def step(self, eq: np.ndarray) -> np.ndarray:
        """Takes each lane's next byte (as its mask in the lane's pattern); distances of the best stretches that end there."""
        pv, mv = self.pv, self.mv
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | ~(xh | pv)
        mh = pv & xh
        self.score += ((ph >> self.top) & self.one).astype(np.int64)
        self.score -= ((mh >> self.top) & self.one).astype(np.int64)
        ph = ph << self.one
        self.pv, self.mv = (mh << self.one) | ~(xv | ph), ph & xv
        return self.score


class Items:
    """A block of benchmark items with the keys of their windows, by size class and repetition."""

    def __init__(self, items: list[tuple[int, bytes]], settings: dict[int, tuple[int, int]], first: int = 0, exact: tuple = (), distance: float = DISTANCE):
        self.ids = [i for i, _ in items]
        self.texts = [t for _, t in items]
        self.distance = distance
        self.size = np.array([len(t) for t in self.texts], np.int64)
        self.begin = np.cumsum(self.size) - self.size
        self.pool = np.frombuffer(b"".join(self.texts) + bytes(LOCAL), np.uint8)
        self.exact = [(j, *(_grams(self.texts[j], distance) if len(self.texts[j]) > LOCAL else ())) for j in exact]
        self.tables: list[Table] = []
        for steps in STEPS:
            samples, walks = settings.get(steps, (0, 0))
            own = [j for j, t in enumerate(self.texts) if self.steps_of(len(t)) == steps]
            if not own or not walks:
                continue
            pad = b" " + b"\0" * (steps + 1)
            text = np.frombuffer(b"".join(b" " + self.texts[j] + pad for j in own), np.uint8)
            begins = np.cumsum([1] + [len(self.texts[j]) + len(pad) + 1 for j in own[:-1]])
            starts = word_starts(text)
            starts = starts[text[starts] != 0]
            which = np.searchsorted(begins, starts, "right") - 1
            offset = starts - begins[which]
            size = self.size[own]
            whole = (offset + steps <= size[which]) | (offset == 0)
            starts, which, offset = starts[whole], which[whole], offset[whole]
            for r in range(first, first + walks):
                self.tables.append(Table(Walk(steps, samples, 1000 * steps + r), text, starts, np.array(own)[which], offset))

    @staticmethod
    def steps_of(size: int) -> int:
        return next((s for s in STEPS if 2 * s <= size), STEPS[-1])

    def alike(self, text: np.ndarray, place: np.ndarray, item: np.ndarray, offset: np.ndarray, steps: int) -> np.ndarray:
        """Whether LOCAL bytes of the item around its window are near enough to the text around the aligned place; small items are compared whole and with their own limit."""
        size = self.size[item]
        wide = np.minimum(size, LOCAL)
        begin = np.clip(offset - (wide - steps) // 2, 0, size - wide)
        limit = np.where(size <= LOCAL, (self.distance * size).astype(np.int64), int(LOCAL_RATE * LOCAL))
        keep = np.zeros(len(place), bool)
        for s in range(0, len(place), _LANES):
            b = slice(s, s + _LANES)
            pattern, of = np.unique(np.stack([self.begin[item[b]] + begin[b], wide[b]]), axis=1, return_inverse=True)
            eq = _masks(self.pool[pattern[0][:, None] + np.arange(int(pattern[1].max()))], pattern[1]).reshape(-1)
            lane, row = Lanes(wide[b]), of.reshape(-1) * 256
            at = place[b] + begin[b] - limit[b]
            best = wide[b].astype(np.int64)
            for t in range(int((wide[b] + 2 * limit[b]).max())):
                np.minimum(best, lane.step(eq[row + text[np.clip(at + t, 0, len(text) - 1)]]), out=best)
            keep[b] = best <= limit[b]
        return keep

    def candidates(self, text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place in text where an item would begin, item, place of a window within) of all collisions that are alike, distinct and sorted by window."""
        starts = word_starts(text)
        padded = np.concatenate([text, np.zeros(STEPS[0] + 2, np.uint8)])
        found = [np.zeros((3, 0), np.int64)]
        for table in self.tables:
            window, item, offset = table.collisions(padded, starts)
            ok = self.alike(text, window - offset, item, offset, table.walk.steps)
            found.append(np.stack([window[ok], item[ok], window[ok] - offset[ok]]))
        window, item, place = np.unique(np.concatenate(found, axis=1), axis=1)
        return place, item, window


def _codes(text: np.ndarray, q: int) -> np.ndarray:
    """Every q-gram of a text as 16 bits; equal codes of different q-grams only let more places pass."""
    code = text[: len(text) - q + 1].astype(np.uint32)
    for i in range(1, q):
        code = code * np.uint32(257) + text[i : len(text) - q + 1 + i]
    return ((code * np.uint32(2654435761)) >> np.uint32(16)).astype(np.uint16)


def _grams(item: bytes, distance: float = DISTANCE) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    """q, the longest of 3, 2 and 1 that leaves shared q-grams at most edits, which codes the item has, each code's number among them and how often they occur."""
    m = len(item)
    q = next((q for q in (3, 2) if m - q + 1 - q * int(distance * m) > 0), 1)
    table = np.zeros(1 << 16, bool)
    own, times = np.unique(_codes(np.frombuffer(item, np.uint8), q), return_counts=True)
    table[own] = True
    number = np.full(1 << 16, len(own), np.int32)
    number[own] = np.arange(len(own))
    return q, table, number, times


def _small(item: bytes, text: np.ndarray, most: int, lane: int = 1024):
    """(from, to) of all stretches of the text around a match of an item of at most LOCAL bytes: lanes of the text, each begun early enough for the matches that end in it."""
    m, n = len(item), len(text)
    eq = _masks(np.frombuffer(item, np.uint8)[None], np.array([m]))[0]
    first = np.arange(0, n, lane)
    lead = m + most
    lanes = Lanes(np.full(len(first), m))
    ends = []
    for t in range(-lead, lane):
        at = first + t
        inside = (at >= 0) & (at < n)
        score = lanes.step(np.where(inside, eq[text[np.clip(at, 0, n - 1)]], np.uint64(0)))
        if t >= 0:
            hit = np.flatnonzero((score <= most) & inside)
            if len(hit):
                ends.append(at[hit])
    if ends:
        e = np.unique(np.concatenate(ends))
        cut = np.flatnonzero(np.diff(e) > 1) + 1
        for lo, hi in zip(e[np.r_[0, cut]].tolist(), e[np.r_[cut - 1, len(e) - 1]].tolist()):
            yield max(0, lo - m - most), min(n, hi + 1)


def everywhere(items: Items, text: np.ndarray, distance: float):
    """(item number, from, to) of all stretches that can hold an item that is looked for exactly; none with a match is left out."""
    codes: dict[int, np.ndarray] = {}
    for j, *grams in items.exact:
        m = len(items.texts[j])
        most = int(distance * m)
        if not grams:
            if len(text):
                for lo, hi in _small(items.texts[j], text, most):
                    yield j, lo, hi
            continue
        q, table, number, times = grams
        least = m - q + 1 - q * most  # of a match's q-grams, an edit destroys q at most
        if q not in codes:
            codes[q] = _codes(text, q) if len(text) >= q else np.zeros(0, np.uint16)
        wide = min(m + most - q + 1, len(codes[q]))
        if least < 1 or wide < 1:
            if len(text):
                yield j, 0, len(text)
            continue
        sums = np.concatenate([[0], np.cumsum(table[codes[q]], dtype=np.int32)])
        good = np.flatnonzero(sums[wide:] - sums[:-wide] >= least)
        if len(good):
            cut = np.flatnonzero(np.diff(good) > wide + q) + 1
            for lo, hi in zip(good[np.r_[0, cut]].tolist(), good[np.r_[cut - 1, len(good) - 1]].tolist()):
                inside = np.bincount(number[codes[q][lo : hi + wide]], minlength=len(times) + 1)[:-1]
                if np.minimum(inside, times).sum() >= least:  # a q-gram counts no more often than the item has it
                    yield j, lo, hi + wide + q - 1


def best_distance(pattern: bytes, text: bytes, most: int) -> tuple[int, int] | None:
    """Smallest edit distance of ``pattern`` to a stretch of ``text`` and that stretch's end, if at most ``most`` (Myers' bit vectors)."""
    at = text.find(pattern)
    if at >= 0:
        return 0, at + len(pattern)
    m = len(pattern)
    full, high = (1 << m) - 1, 1 << (m - 1)
    eq: dict[int, int] = {}
    for i, c in enumerate(pattern):
        eq[c] = eq.get(c, 0) | 1 << i
    pv, mv, score = full, 0, m
    best, end = m, 0
    for j, c in enumerate(text):
        e = eq.get(c, 0)
        xv = e | mv
        xh = (((e & pv) + pv) ^ pv) | e
        ph = mv | (full & ~(xh | pv))
        mh = pv & xh
        if ph & high:
            score += 1
        elif mh & high:
            score -= 1
        ph = ph << 1 & full
        mh = mh << 1 & full
        pv = mh | (full & ~(xv | ph))
        mv = ph & xv
        if score < best:
            best, end = score, j + 1
    return (best, end) if best <= most else None


def find(items: Items, text: np.ndarray, at: np.ndarray) -> list[tuple[int, int, int, int]]:
    """(text number, item number, edit distance, end in the folded text) for each contaminated pair, by the least distance."""
    place, item, window = items.candidates(text)
    row = np.searchsorted(at, window, "right") - 1  # the window decides which text it lies in: its item may begin a little before
    tried: set[tuple[int, int, int]] = set()
    best: dict[tuple[int, int], tuple[int, int]] = {}
    raw = text.tobytes()
    for p, j, r in zip(place.tolist(), item.tolist(), row.tolist()):
        t = items.texts[j]
        most = int(items.distance * len(t))
        key = (r, j)
        stretch = (r, j, p // (most + 1))  # places of one stretch are at most ``most`` apart: one of them is tried
        if best.get(key, (1,))[0] == 0 or stretch in tried:
            continue
        tried.add(stretch)
        lo, hi = max(int(at[r]), p - 2 * most - 1), min(int(at[r + 1]), p + len(t) + 2 * most + 1)
        got = best_distance(t, raw[lo:hi], most) if hi > lo else None
        if got and (key not in best or got[0] < best[key][0]):
            best[key] = (got[0], lo + got[1] - int(at[r]))
    for j, lo, hi in everywhere(items, text, items.distance):
        t = items.texts[j]
        for r in range(max(0, int(np.searchsorted(at, lo, "right")) - 1), int(np.searchsorted(at, hi, "left"))):
            start = max(int(at[r]), lo)
            got = best_distance(t, raw[start : min(int(at[r + 1]), hi)], int(items.distance * len(t)))
            if got and ((r, j) not in best or got[0] < best[r, j][0]):
                best[r, j] = (got[0], start + got[1] - int(at[r]))
    return [(r, j, d, e) for (r, j), (d, e) in sorted(best.items())]


def edited(text: bytes, rate: float, r: np.random.Generator) -> bytes:
    """Random substitutions, insertions and deletions of letters."""
    out = bytearray()
    for c in text:
        x = r.random()
        if x < rate / 3:
            continue
        if x < 2 * rate / 3:
            out.append(int(r.integers(97, 123)))
        out.append(int(r.integers(97, 123)) if 2 * rate / 3 <= x < rate else c)
    return bytes(out)


def misspelt(text: bytes, edits: int, r: np.random.Generator) -> bytes:
    """So many substitutions, insertions and deletions at different random places."""
    out = [bytes([c]) for c in text]
    for at in r.choice(len(out), min(edits, len(out)), replace=False).tolist():
        c = bytes([int(r.integers(97, 123))])
        out[at] = (c, c + out[at], b"")[int(r.integers(3))]
    return b"".join(out)


def tuned(items: list[tuple[int, bytes]], distance: float = DISTANCE, recall: float = RECALL, edit_rate: float = EDIT_RATE) -> tuple[dict[int, tuple[int, int]], list[int], dict[int, float]]:
    """For each size class (samples, walks), the items (by number) that no setting finds often enough, and the measured recall of the walks."""
    r = np.random.default_rng(11)
    copies = min(20, max(3, COPIES // max(1, len(items))))
    settings, seldom, measured = {}, [], {}
    for steps in STEPS:
        own = [j for j, (_, t) in enumerate(items) if Items.steps_of(len(t)) == steps]
        if not own:
            continue
        some = [items[j] for j in own]
        changed = [misspelt(t, int(edit_rate * len(t)), r) for _, t in some for _ in range(copies)]
        text, at = fold(np.frombuffer(b"".join(changed), np.uint8), np.cumsum([0, *map(len, changed)]))
        options = []
        for samples in (s for s in SAMPLES if s <= steps):
            found = np.zeros(len(changed), bool)
            share = found.reshape(-1, copies)
            for walk in range(MOST_REPETITIONS[steps]):
                block = Items(some, {steps: (samples, 1)}, first=walk, distance=distance)
                for k in range(0, len(changed), 2000):
                    lo, hi = at[k], at[min(k + 2000, len(changed))]
                    _, item, window = block.candidates(text[lo:hi])
                    copy = np.searchsorted(at, window + lo, "right") - 1
                    found[copy[copy // copies == item]] = True
                rare = share.mean(axis=1) < min(LEAST_RECALL, recall)
                if found.mean() >= recall and not rare.any():
                    break
            missed = np.flatnonzero(rare) if found.mean() >= recall else np.arange(len(own))
            options.append((len(missed), -samples, walk + 1, missed.tolist(), float(found.mean())))
            if not len(missed):
                break
        _, samples, walks, missed, measured[steps] = min(options)
        settings[steps] = (-samples, 0 if len(missed) == len(own) else walks)
        seldom += [own[k] for k in missed]
    return settings, seldom, measured


def blocks(benchmark: DataFrame, limit: int = ITEM_BLOCK):
    """The benchmark's distinct items in lists of at most ``limit`` bytes (or one item), read in turn."""
    part, size = [], 0
    items = benchmark.where(F.col("text").isNotNull()).groupBy("text").agg(F.min("item_id").alias("item_id"))
    for row in items.orderBy("text").toLocalIterator():
        t = folded(row.text)
        if not t:
            continue
        if part and size + len(t) > limit:
            yield part
            part, size = [], 0
        part.append((row.item_id, t))
        size += len(t)
    if part:
        yield part


def _searcher(spark: SparkSession, part, distance: float, recall: float, edit_rate: float):
    settings, exact, _ = tuned(part, distance, recall, edit_rate)
    box = spark.sparkContext.broadcast(Items(part, settings, exact=tuple(exact), distance=distance))  # ITEM_BLOCK bytes of items, and their index of about 16 times as much

    def search(column):
        text, at = fold(*common.raw(common.texts(column)))
        return box.value, find(box.value, text, at) if len(text) else []

    return search


def matches(docs: DataFrame, benchmark: DataFrame, distance: float = DISTANCE, recall: float = RECALL, edit_rate: float = EDIT_RATE) -> DataFrame:
    """doc_id, item_id, edit_distance, similarity, end_at of every contaminated pair."""
    spark = docs.sparkSession
    schema = "doc_id long, item_id long, edit_distance int, similarity double, end_at long"
    out = spark.createDataFrame([], schema)
    for part in blocks(benchmark):
        search = _searcher(spark, part, distance, recall, edit_rate)

        def run(batches, search=search):
            for b in common.slices(batches):
                items, hits = search(b.column(1))
                yield pa.record_batch(
                    [
                        b.column(0).take(pa.array([h[0] for h in hits], pa.int64())),
                        pa.array([items.ids[h[1]] for h in hits], pa.int64()),
                        pa.array([h[2] for h in hits], pa.int32()),
                        pa.array([1 - h[2] / len(items.texts[h[1]]) for h in hits], pa.float64()),
                        pa.array([h[3] for h in hits], pa.int64()),
                    ],
                    ["doc_id", "item_id", "edit_distance", "similarity", "end_at"],
                )

        out = out.union(docs.select("doc_id", "text").mapInArrow(run, schema))
    return out


def keep_uncontaminated(docs: DataFrame, benchmark: DataFrame, distance: float = DISTANCE, recall: float = RECALL, edit_rate: float = EDIT_RATE) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item, with all their columns."""
    at_text = docs.columns.index("text")
    for k, part in enumerate(blocks(benchmark)):
        if k:
            docs = common.written(docs, "uncontaminated")  # one block's index a task
        search = _searcher(docs.sparkSession, part, distance, recall, edit_rate)

        def run(batches, search=search):
            for b in common.slices(batches):
                _, hits = search(b.column(at_text))
                keep = np.ones(b.num_rows, bool)
                keep[[h[0] for h in hits]] = False
                yield b.filter(pa.array(keep))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def op1_decontaminate_cgk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matches(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))


QUERIES = {"op1_decontaminate_cgk": op1_decontaminate_cgk}
ORACLE_SQL: dict[str, str] = {}
