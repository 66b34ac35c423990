"""Exact nearest neighbours by composition and length, through a block index with bounds.

Two fragments' similarity falls with their distance in composition, under a model whose
coefficients depend on their lengths. Blocks hold fragments alike in composition; a block
keeps the box of its members in the leading directions of composition, the range of what lies
outside those directions, and the range of lengths. For a fragment and a block this bounds
the distance from below and the coefficients from below, so the similarity from above. The
nearest blocks give a first worst among a fragment's best; blocks, and then single pairs
judged in the leading directions alone, are left out where their bound lies below it. The
best bounds are evaluated first, so that the worst is close to its last value when the
others are judged. Only pairs that remain are evaluated in all directions.

Directions and blocks decide only what is left out early: they are fitted on a bounded sample
(SAMPLE rows), and any of them gives the same neighbours. Features that fit the limit are
held by every task. Beyond it each task holds a part of the fragments, and all others pass by
it in tiles, by length, on which similarity depends most: a tile's blocks are alike in length
and composition, so many are left out whole for many held fragments, and each task returns no
more than the lists themselves. What is left stays of all pairs' order, at the price of one
single precision product each.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrift.functions import tnf
from spindrift.operators.measure import _ROW, arrays, matrix, wanted

MOST_EDGES = 200
LEAF = 64
WIDE = 65_536  # fragments that a task holds while the others pass by
HELD = 8 << 20  # bytes of features
ROWS, COLUMNS, TILE = 512, 512, 16_384  # of pairs seen at once, and of fragments that pass by together
FEW, MORE = 24, 64  # leading directions in which all pairs of a block are seen, and those that are left
DENSE = 16  # one pair of so many left: all are seen in all directions
TAKEN = 1 << 17  # pairs judged together
FIRST = 512  # fragments of the first tile; each is twice the one before, as bounds rise most at first
BOXED = 8  # leading directions of blocks' boxes
OFF = 1e-6  # what squared distances from boxes may be off
CLOSE = 1e-5  # what squared distances of pairs may be off in single precision, term by term
BEGIN = 1024  # held fragments that give a span its first bound
# A sum of n products is off by n * 2 ** -24 of what its terms sum to without signs, here at most
# twice the two norms; the rest is for the factors' own rounding.
LESS = 1 - 3 * (len(tnf.KMERS) + 2) * 2.0**-24
DIRECTIONS = 48
SAMPLE = 20_000
CELL = 0.01  # of log10 length
FINE = 0.004  # the same for features beyond HELD, whose cells are found once
SLACK = 1e-9
FARTHEST = 2**0.5 + SLACK  # of two vectors of length 1 or 0 without negative parts
SCHEMA = "src long, dst long, sim double"


def lower_coefficients(edges: np.ndarray) -> np.ndarray:
    """The model's four coefficients, from below, for lengths in each pair of cells between ``edges`` (log10).

    A polynomial around a cell's centre is exact at its full degree, so the value at the
    centre less all other terms at the cell's half width bounds it.
    """
    centre, half = (edges[1:] + edges[:-1]) / 2, float(np.diff(edges).max(initial=0)) / 2 + SLACK
    return np.concatenate([_lower(centre[k : k + 16, None], centre[None], half) for k in range(0, len(centre), 16)], axis=1)


def _lower(one: np.ndarray, two: np.ndarray, half: float) -> np.ndarray:
    x, y = np.minimum(one, two), np.maximum(one, two)
    powers = range(max(len(m["xy"]) for m in tnf.MODEL.values()))
    xs, ys = [x**k for k in powers], [y**k for k in powers]
    out = []
    for model in tnf.MODEL.values():
        parts = {part: np.polynomial.Polynomial(model[part]) for part in tnf.PARTS}
        low = parts["x"](x) + parts["y"](y) + parts["xy"](x * y)
        degree = max(p.degree() for p in parts.values())
        for i in range(degree + 1):
            for j in range(degree + 1):
                if i + j:
                    term = sum((z * math.comb(m, i) * math.comb(m, j) * xs[m - i] * ys[m - j] for m, z in enumerate(model["xy"]) if z and m >= max(i, j)), np.zeros(x.shape))
                    if not j:
                        term = term + parts["x"].deriv(i)(x) / math.factorial(i)
                    if not i:
                        term = term + parts["y"].deriv(j)(y) / math.factorial(j)
                    low = low - np.abs(term) * half ** (i + j)
        out.append(low - 1e-6)
    return np.stack(out)


class Directions:
    """The leading directions of composition in a sample, and fragments' places in them."""

    def __init__(self, sample: np.ndarray):
        self.mean = sample.mean(axis=0) if len(sample) else np.zeros(len(tnf.KMERS))
        _, _, v = np.linalg.svd(sample - self.mean, full_matrices=False) if len(sample) else (0, 0, np.zeros((0, len(tnf.KMERS))))
        self.axes = v[:DIRECTIONS].T

    def place(self, rows: np.ndarray) -> np.ndarray:
        """Coordinates, and last the norm of what the directions leave out."""
        c = rows - self.mean
        p = c @ self.axes
        return np.column_stack([p, np.sqrt(np.maximum((c * c).sum(axis=1) - (p * p).sum(axis=1), 0))])


def halves(place: np.ndarray, leaf: int) -> list[np.ndarray]:
    """Row numbers in blocks of at most ``leaf``, cut at the median of the widest coordinate."""
    todo, out = [np.arange(len(place))], []
    while todo:
        b = todo.pop()
        if len(b) <= leaf:
            out.append(b)
            continue
        o = b[np.argsort(place[b, place[b].std(axis=0).argmax()], kind="stable")]
        todo += [o[len(o) // 2 :], o[: len(o) // 2]]
    return out


def judged(least: np.ndarray, most: np.ndarray, b1, c1, b2, c2) -> np.ndarray:
    """The log odds of being different, from below, for distances from ``least`` to ``most``; some slopes are negative."""
    first = b1 + c1 * np.where(c1 >= 0, least, most)
    second = b2 + c2 * np.where(c2 >= 0, least, most)
    return np.where(first < -tnf.LOG_FLOOR, first, np.maximum(second, -tnf.LOG_FLOOR))


def above(least: np.ndarray, most: np.ndarray, b1, c1, b2, c2) -> np.ndarray:
    """The same from above."""
    first = b1 + c1 * np.where(c1 >= 0, most, least)
    second = b2 + c2 * np.where(c2 >= 0, most, least)
    return np.where(first < -tnf.LOG_FLOOR, first, np.maximum(second, -tnf.LOG_FLOOR)) + 1e-9


def kth(row: np.ndarray, z: np.ndarray, rows: int, k: int) -> np.ndarray:
    """The ``k``-th smallest log odds of each row, or a little more; inf in rows of fewer."""
    key = np.sort(row * 4096.0 + np.clip(z, -1000, 1000))
    count = np.bincount(row, minlength=rows)
    at = np.cumsum(count) - count + k - 1
    out = np.full(rows, np.inf)
    full = count >= k
    out[full] = key[at[full]] - np.flatnonzero(full) * 4096.0 + 1e-6
    return out


def reaching(z: np.ndarray) -> np.ndarray:
    """A similarity that log odds up to ``z`` reach, from below; -0.5 for inf."""
    return np.where(np.isfinite(z), 1 - 1 / (1 + np.exp(-np.clip(z, -700, 700))) - 1e-6, -0.5)


def odds(least: np.ndarray) -> np.ndarray:
    """The log odds up to which a similarity, rounded to six decimals, may reach ``least``."""
    p = np.clip(1 - least + 6e-7, 0, 1 - 1e-15)
    return np.where(least <= 0, np.inf, np.log(np.maximum(p, 1e-300)) - np.log1p(-p))


class Blocks:
    """Fragments in blocks: ``m`` (measure.matrix) by block, and each block's box."""

    def __init__(self, m: dict[str, np.ndarray], directions: Directions, min_cv: float, leaf: int = LEAF):
        place = directions.place(m["tnf"])
        blocks = halves(place, leaf) if len(place) else []
        order = np.concatenate(blocks) if blocks else np.zeros(0, np.int64)
        self.m = {k: v[order] for k, v in m.items()}
        self.place = place[order]
        self.covered = (self.m["mean"] > min_cv).any(axis=1)
        self.size = np.array([len(b) for b in blocks], np.int64)
        self.start = np.concatenate([[0], np.cumsum(self.size)]).astype(np.int64)
        at = self.start[:-1]
        self.low, self.high = (f.reduceat(self.place, at, axis=0) if len(at) else self.place for f in (np.minimum, np.maximum))
        self.short, self.long = (f.reduceat(self.m["log"], at) if len(at) else self.m["log"] for f in (np.minimum, np.maximum))

    def bounds(self, place: np.ndarray, log: np.ndarray, edges: np.ndarray, table: np.ndarray) -> np.ndarray:
        """The least log odds of fragments (rows) with the members of each block (columns)."""
        gap = np.maximum(np.maximum(self.low[None] - place[:, None], place[:, None] - self.high[None]), 0)
        d = np.maximum(np.sqrt((gap * gap).sum(axis=2)) - SLACK, 0)
        cell = np.clip(np.searchsorted(edges, log, "right") - 1, 0, len(edges) - 2)
        own, inverse = np.unique(cell, return_inverse=True)
        first, last = (np.clip(np.searchsorted(edges, x, "right") - 1, 0, len(edges) - 2) for x in (self.short, self.long))
        worst = np.stack([table[:, own, a : b + 1].min(axis=2) for a, b in zip(first, last)], axis=2)
        return judged(d, FARTHEST, *worst[:, inverse])


class Search:
    """The best neighbours of fragments among those of ``other``, exact; counts what it evaluates."""

    def __init__(self, other: Blocks, edges: np.ndarray, table: np.ndarray, min_cv: float, most: int):
        self.other, self.edges, self.table, self.min_cv, self.most = other, edges, table, min_cv, most
        self.pairs = self.evaluated = 0

    def of(self, own: Blocks, least: np.ndarray | None = None):
        """(src, dst, sim, top) for each block of ``own``; ``least``: what a neighbour of each row must reach, from below."""
        for at, to in zip(own.start[:-1], own.start[1:]):
            yield self._block({k: v[at:to] for k, v in own.m.items()}, own.place[at:to], own.covered[at:to], None if least is None else least[at:to])

    def _block(self, a, place, covered, least):
        o, n = self.other, len(a["id"])
        self.pairs += n * len(o.m["id"])
        need = np.full(n, -0.5) if least is None else np.maximum(least, -0.5)
        bound = o.bounds(place, a["log"], self.edges, self.table)
        order = np.argsort(bound.mean(axis=0), kind="stable")
        seed = order[: np.searchsorted(np.cumsum(o.size[order]), 4 * self.most) + 1]
        if least is None and len(seed) < len(order):
            need = self._worst(need, *self._few(a, place, covered, seed, need)[0])
        some = order[(bound[:, order] <= odds(need)[:, None]).any(axis=0)]
        if not len(some):
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.full(n, -1.0)
        best, cols, z = self._few(a, place, covered, some, need)
        may = z <= odds(self._worst(need, *best))[:, None]
        may[best[0], best[3]] = False  # these have their similarity
        may &= np.isfinite(z)
        row, at = np.nonzero(may)
        row, at, sim = (np.concatenate(x) for x in zip((best[0], best[3], best[2]), (row, at, self._exact(a, row, cols[at]))))
        col = cols[at]
        top = np.full(n, -1.0)
        np.maximum.at(top, row, sim)
        ok = covered[row] | o.covered[col]
        row, col, sim = row[ok], col[ok], sim[ok]
        keep = np.lexsort((o.m["id"][col], -sim, row))
        rank = np.arange(len(keep)) - np.searchsorted(row[keep], row[keep])
        keep = keep[rank < self.most]
        return a["id"][row[keep]], o.m["id"][col[keep]], sim[keep], top

    def _few(self, a, place, covered, blocks, need):
        """The covered pairs of ``blocks`` with the best bounds, ``most`` a row, as (row, column, similarity, place in the columns); the columns, and all pairs' bounds."""
        o = self.other
        cols = np.concatenate([np.arange(o.start[b], o.start[b + 1]) for b in blocks])
        z = self._judge(a, place, cols)
        ranked = np.where(covered[:, None] | o.covered[cols][None], z, np.inf)
        ranked[ranked > odds(need)[:, None]] = np.inf
        k = min(self.most, len(cols))
        at = np.argpartition(ranked, k - 1, axis=1)[:, :k]
        row = np.repeat(np.arange(len(z)), k)
        at = at.ravel()
        own = np.isfinite(ranked[row, at])
        row, at = row[own], at[own]
        return (row, cols[at], self._exact(a, row, cols[at]), at), cols, z

    def _worst(self, need, row, _, sim, __):
        """What a neighbour must reach, given ``most`` or fewer pairs a row."""
        full = np.bincount(row, minlength=len(need)) >= self.most
        worst = np.full(len(need), np.inf)
        np.minimum.at(worst, row, sim)
        return np.where(full, np.maximum(need, worst), need)

    def _judge(self, a, place, cols):
        """The log odds of all pairs, from below: their distance in the leading directions and in the norm of the rest."""
        o = self.other
        d = (place[:, :-1] ** 2).sum(axis=1)[:, None] + (o.place[cols, :-1] ** 2).sum(axis=1)[None] - 2 * (place[:, :-1] @ o.place[cols, :-1].T)
        r1, r2 = place[:, -1][:, None], o.place[cols, -1][None]
        least = np.maximum(np.sqrt(np.maximum(d + (r1 - r2) ** 2, 0)) - 1e-7, 0)
        most = np.sqrt(np.maximum(d, 0) + (r1 + r2) ** 2) + 1e-7
        z = judged(least, most, *tnf.coefficients(a["log"], o.m["log"][cols])) - 1e-6
        z[a["id"][:, None] == o.m["id"][cols][None]] = np.inf  # no fragment is its own neighbour
        return z

    def _exact(self, a, row, col):
        o, out = self.other, np.empty(len(row))
        self.evaluated += len(row)
        for k in range(0, len(row), 8192):
            s = slice(k, k + 8192)
            diff = a["tnf"][row[s]] - o.m["tnf"][col[s]]
            out[s] = np.einsum("ij,ij->i", diff, diff)
        return np.round(1 - tnf.probability(np.sqrt(out), a["log"][row], o.m["log"][col]), 6)


def length_cells(low: float, high: float, cell: float = CELL) -> np.ndarray:
    """Edges of cells of log10 length that hold all of low..high."""
    return low - SLACK + cell * np.arange(int((high - low) / cell) + 2)


def _record(src, dst, sim, own, top, later):
    if later:
        keep = dst > src
        src, dst, sim = src[keep], dst[keep], sim[keep]
    yield pa.record_batch([pa.array(src), pa.array(dst), pa.array(sim)], ["src", "dst", "sim"])
    yield pa.record_batch([pa.array(own), pa.nulls(len(own), pa.int64()), pa.array(top)], ["src", "dst", "sim"])


def neighbours(feats: DataFrame, min_cv: float = 1.0, most: int = MOST_EDGES, limit: int = HELD, wide: int = WIDE, later: bool = False) -> DataFrame:
    """src, dst, sim: every fragment's ``most`` most similar others (ties to the smaller id), with ``later`` those of them of larger id; rows with dst null hold its largest similarity."""
    n = feats.count()
    return _held(feats, min_cv, most, later) if n * _ROW <= limit else _streamed(feats, n, min_cv, most, wide, later)


def _held(feats: DataFrame, min_cv: float, most: int, later: bool) -> DataFrame:
    spark = feats.sparkSession
    m = matrix(feats)  # HELD bytes at most
    box = spark.sparkContext.broadcast((m, Directions(m["tnf"][:: max(1, len(m["id"]) // SAMPLE)])))
    blocks = -(-len(m["id"]) // (4 * LEAF))

    def run(batches):
        m, directions = box.value
        other = Blocks(m, directions, min_cv)
        edges = length_cells(m["log"].min(), m["log"].max())
        search = Search(other, edges, lower_coefficients(edges), min_cv, most)
        for b in batches:
            for part in b.column(0).to_pylist():
                for k in range(part * 4, min(part * 4 + 4, len(other.size))):
                    at, to = other.start[k : k + 2]
                    own = slice(at, to)
                    src, dst, sim, top = search._block({c: v[own] for c, v in other.m.items()}, other.place[own], other.covered[own], None)
                    yield from _record(src, dst, sim, other.m["id"][own], top, later)

    parts = spark.range(0, max(1, 2 * blocks), 1, max(1, min(blocks, 4 * spark.sparkContext.defaultParallelism)))
    return parts.mapInArrow(run, SCHEMA) if len(m["id"]) else spark.createDataFrame([], SCHEMA)


class Nearest:
    """The ``most`` best neighbours of some fragments among those that pass by, in any order; exact.

    The held fragments pass by, too, so that a first bound comes from those of them that look best.
    A similarity bound is a bound of distance in each cell of lengths. Held fragments lie in spans,
    those of a tile in blocks, each alike in composition and length; a block whose box lies beyond
    what a span's cells still reach is left out. Distances of the others are one product of single
    precision, which takes off each end's norm what the product may be off: first in the FEW
    leading directions and the norm of the rest, which bounds them from below; the few pairs that
    this leaves are looked at one by one, in MORE directions and then in all. Where some must
    lie far, or many are left, the product has all directions. Pairs within the bound are judged
    by it and their own lengths, what remains is evaluated, and raises the bound for those that follow.
    """

    def __init__(self, m: dict[str, np.ndarray], edges: np.ndarray, table: np.ndarray, most: int):
        n = len(m["id"])
        self.centre, self.axes = m["tnf"].mean(axis=0), leading(m["tnf"])
        turned, norm, place = self._turned(m["tnf"])
        blocks = halves(np.column_stack([place, m["log"]]), ROWS) if n else []
        order = np.concatenate(blocks) if n else np.zeros(0, np.int64)
        self.m = m = {k: v[order] for k, v in m.items()}
        self.edges, self.table, self.most = edges, table, most
        self.seen = self.judged = self.evaluated = 0
        self.turned, self.square, self.norm = turned[order], norm[order], norm.max(initial=0)
        self.sides = sides(m["log"])
        self.cell = self._cells(m["log"])
        self.need, self.top = np.full(n, -0.5), np.full(n, -1.0)
        self.last = np.full(n, np.iinfo(np.int64).max)  # the id from which on a similarity of 1 comes too late
        self.left, self.few = facing(self.turned, self.square, True), fewer(self.turned, self.square, True)
        self.place, self.spans = place[order].astype(np.float32), spans(blocks)
        self.boxes = [(self.place[x].min(axis=0), self.place[x].max(axis=0)) for x in self.spans]
        none = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        self.best, self.fresh, self.begun = [none for _ in self.spans], [[] for _ in self.spans], False

    def _cells(self, log):
        return np.clip(np.searchsorted(self.edges, log, "right") - 1, 0, len(self.edges) - 2)

    def _turned(self, rows):
        """Coordinates in the directions of the held fragments, leading ones first, in single precision; squared norms; places: the first few, and last the norm of the rest."""
        c = rows - self.centre
        norm = (c * c).sum(axis=1)
        c = c @ self.axes
        return c.astype(np.float32), norm, np.column_stack([c[:, :BOXED], rest(c, norm, BOXED)])

    def within(self, span: slice, cells: slice) -> tuple[np.ndarray, np.ndarray]:
        """How near and how far, squared, a fragment of each of these cells (rows) may lie to each own one (columns) and still reach what it needs; some slopes are negative."""
        own, inverse = np.unique(self.cell[span], return_inverse=True)
        b1, c1, b2, c2 = self.table[:, cells, own[0] : own[-1] + 1][:, :, own - own[0]][:, :, inverse]
        z = odds(self.need[span])[None]
        near, far = (f(x, y) for f, x, y in zip((np.minimum, np.maximum), reached(b1, c1, np.minimum(z, -tnf.LOG_FLOOR)), reached(b2, c2, np.where(z >= -tnf.LOG_FLOOR, z, -np.inf))))
        far = np.where(far < 0, -1.0, (np.minimum(far, FARTHEST) + 1e-7) ** 2 + 1e-7)
        return (np.maximum(near - 1e-7, 0) ** 2 - 1e-6).astype(np.float32), far.astype(np.float32)

    def meet(self, o: dict[str, np.ndarray]) -> None:
        """Fragments that pass by: id, log, tnf, covered."""
        if not self.begun:
            self.begun = True
            for span in self.spans:
                self._begin(span)
        turned, norm, place = self._turned(o["tnf"])
        blocks = halves(np.column_stack([place, o["log"]]), COLUMNS)
        order = np.concatenate(blocks)
        o = {k: v[order] for k, v in o.items()} | {"sides": sides(o["log"][order])}
        turned, norm, place = turned[order], norm[order], place[order].astype(np.float32)
        spots = spans(blocks)
        few, whole = fewer(turned, norm), facing(turned, norm)
        low, high = (np.stack([f(place[c], axis=0) for c in spots]) for f in (np.min, np.max))
        cell = self._cells(o["log"])
        cells = slice(cell.min(), cell.max() + 1)
        cell = cell - cells.start
        bands = [slice(cell[c].min(), cell[c].max() + 1) for c in spots]
        off = 2 * (1 - LESS) * (self.norm + norm.max(initial=0)) + 1e-7 + 3 * CLOSE
        for k, span in enumerate(self.spans):
            least, most = self.within(span, cells)
            least -= off
            far = least.max() > 0  # some must lie far
            gap = np.maximum(np.maximum(low - self.boxes[k][1], self.boxes[k][0] - high), 0)
            reach = most.max(axis=1)
            some = np.flatnonzero(np.array([reach[x].max() for x in bands]) >= (gap * gap).sum(axis=1) - OFF)  # blocks that the span's own box reaches
            if not len(some):
                continue
            apart = self._apart(span, low[some], high[some])
            near = np.argsort(apart.mean(axis=1), kind="stable")  # these raise the bound for the others
            some, apart = some[near], apart[near]
            farthest = np.stack([most[bands[j]].max(axis=0) for j in some])
            may = farthest >= np.maximum(apart - OFF, 0)
            if far:
                may &= np.stack([least[bands[j]].min(axis=0) for j in some]) <= self._across(span, low[some], high[some]) + OFF
            found, held = [], 0
            for at in np.flatnonzero(may.any(axis=1)):
                c, b, rows = spots[some[at]], bands[some[at]], np.flatnonzero(may[at])
                self.seen += (c.stop - c.start) * len(rows)
                met = None
                if not far or least[b][:, rows].max() <= 0:
                    met = self._sparse(few[c], turned[c], span, rows, most[b], farthest[at, rows], cell[c] - b.start)
                if met is None:
                    met = self._near(whole[c], self.left[span][rows], least[b][:, rows], most[b][:, rows], rows, cell[c] - b.start)
                found.append((met[0], met[1] + c.start, met[2]))
                held += len(met[0])
                if held > TAKEN:
                    self._take(k, span, *(np.concatenate(x) for x in zip(*found)), o, off)
                    found, held = [], 0
            if held:
                self._take(k, span, *(np.concatenate(x) for x in zip(*found)), o, off)

    def _apart(self, span, low, high):
        """Squared distances, from below, of a span's fragments (columns) from boxes (rows)."""
        out = np.zeros((len(low), span.stop - span.start), np.float32)
        for k, p in enumerate(self.place[span].T):
            gap = np.maximum(low[:, k, None] - p, p - high[:, k, None])
            out += np.square(np.maximum(gap, 0, out=gap), out=gap)
        return out

    def _across(self, span, low, high):
        """The same from above; the norms of what the directions leave out may lie in any directions."""
        out = np.zeros((len(low), span.stop - span.start), np.float32)
        for k, p in enumerate(self.place[span].T):
            wide = high[:, k, None] + p if k == BOXED else np.maximum(high[:, k, None] - p, p - low[:, k, None])
            out += np.square(wide, out=wide)
        return out

    def _near(self, right, left, least, most, rows, cell):
        """Row, column and squared distance, from below, of the pairs of these rows of a span and a block that lie as near and as far as they must."""
        d = right @ left.T
        one = len(most) == 1
        ok = d <= (most if one else most[cell])
        if least.max() > 0:
            ok &= d >= (least if one else least[cell])
        near = np.flatnonzero(ok)
        col, row = np.divmod(near, d.shape[1])
        return rows[row], col, d.ravel()[near].astype(float)

    def _sparse(self, few, turned, span, rows, most, farthest, cell):
        """The same of pairs that only must lie near, by a few directions first; none if too many are left by these."""
        own = self.few[span][rows]
        own[:, -1] = -farthest - CLOSE
        near = np.flatnonzero(few @ own.T <= 0)
        if len(near) * DENSE > len(few) * len(rows):
            return None
        col, row = np.divmod(near, len(rows))
        row = rows[row]
        d = np.zeros(len(row), np.float32)
        held = self.turned[span]
        for part in (slice(0, MORE), slice(MORE, None)):
            left, right = held[:, part], turned[:, part]
            for k in range(0, len(row), 4096):
                x = slice(k, k + 4096)
                diff = left[row[x]] - right[col[x]]
                d[x] += np.einsum("ij,ij->i", diff, diff)
            ok = d - CLOSE <= most[cell[col], row]
            row, col, d = row[ok], col[ok], d[ok]
        return row, col, d.astype(float) - CLOSE

    def _begin(self, span):
        """A first bound: the worst of as many held ones that look best from the span's middle."""
        m, n = self.m, len(self.m["id"])
        if n <= self.most:
            return
        x = self.turned[span]
        middle = x.mean(axis=0)
        far = self.turned - middle
        d = np.sqrt(np.einsum("ij,ij->i", far, far) + ((x - middle) ** 2).sum(axis=1).mean()).astype(float)
        log = m["log"][span].mean()
        z = decided_odds(d, *tnf.coefficients(np.array([log]), m["log"])[:, 0])
        wide = min(n, max(BEGIN, 2 * self.most))
        some = np.argpartition(z, wide - 1)[:wide]
        o = {c: v[some] for c, v in (m | {"sides": self.sides}).items()}
        d = np.maximum(self.left[span] @ facing(self.turned[some], self.square[some]).T, 0)
        off = 4 * (1 - LESS) * self.norm + 1e-7
        z = above(np.sqrt(d), np.sqrt(d + off), *tnf.coefficients(m["log"][span], o["log"]))
        z[~(m["covered"][span][:, None] | o["covered"][None]) | (m["id"][span][:, None] == o["id"][None])] = np.inf
        self.need[span] = reaching(np.partition(z, self.most - 1, axis=1)[:, self.most - 1])

    def _take(self, k, span, row, col, d, o, off):
        other = (self.m["id"][span][row] != o["id"][col]) & (o["id"][col] < self.last[span][row])  # no fragment is its own neighbour
        row, col, d = row[other], col[other], d[other]
        self.judged += len(row)
        c = self._coefficients(row + span.start, col, o)
        z = judged(np.sqrt(np.maximum(d - 1e-7, 0)), np.sqrt(np.maximum(d, 0) + off), *c) - 1e-9
        may = z <= odds(self.need[span])[row]
        if may.sum() >= self.most:  # of many at once, those that as many others surely surpass are not evaluated
            ok = may & (self.m["covered"][span][row] | o["covered"][col])
            high = above(np.sqrt(np.maximum(d[ok] - 1e-7, 0)), np.sqrt(np.maximum(d[ok], 0) + off), *c[:, ok])
            may &= z <= odds(np.maximum(self.need[span], reaching(kth(row[ok], high, span.stop - span.start, self.most))))[row]
        row, col = row[may], col[may]
        sim = self._exact(row + span.start, col, o, c[:, may])
        np.maximum.at(self.top, row + span.start, sim)
        ok = (sim >= self.need[span][row]) & (self.m["covered"][span][row] | o["covered"][col])
        self.fresh[k].append((row[ok], o["id"][col[ok]], sim[ok]))
        if sum(len(r) for r, _, _ in self.fresh[k]) > self.most * (span.stop - span.start) // 4:
            self._merge(k, span)

    def _merge(self, k, span):
        row, ids, sim = listed(*(np.concatenate(x) for x in zip(self._listed(k), *self.fresh[k])))
        count = np.bincount(row, minlength=span.stop - span.start)
        rank = np.arange(len(row)) - (np.cumsum(count) - count)[row]
        row, ids, sim = (x[rank < self.most] for x in (row, ids, sim))
        self.best[k], self.fresh[k] = (row.astype(np.uint16), ids, np.rint(sim * 1e6).astype(np.int32)), []  # half as wide
        full = count >= self.most
        worst = np.full(len(full), np.inf)
        np.minimum.at(worst, row, sim)
        self.need[span] = np.where(full, np.maximum(self.need[span], worst), self.need[span])
        last = np.zeros(len(full), np.int64)
        np.maximum.at(last, row, ids)
        self.last[span] = np.where(full & (worst >= 1), last, self.last[span])

    def _listed(self, k):
        row, ids, sim = self.best[k]
        return row.astype(np.int64), ids, sim / 1e6

    def _coefficients(self, row, col, o):
        """As ``tnf.probability`` finds them, to the last bit; what depends on one length alone is at hand."""
        out = np.empty((len(tnf.MODEL), len(row)))
        for k in range(0, len(row), 4096):
            r, c = row[k : k + 4096], col[k : k + 4096]
            log1, log2 = self.m["log"][r], o["log"][c]
            shorter, a, b = (log1 <= log2)[:, None], self.sides[r], o["sides"][c]
            one, two = np.where(shorter, a[:, :4], b[:, :4]), np.where(shorter, b[:, 4:], a[:, 4:])
            out[:, k : k + 4096] = (one + two).T + tnf.side("xy", np.minimum(log1, log2) * np.maximum(log1, log2))
        return out

    def _exact(self, row, col, o, coefficients):
        out = np.empty(len(row))
        self.evaluated += len(row)
        for k in range(0, len(row), 2048):
            s = slice(k, k + 2048)
            diff = self.m["tnf"][row[s]] - o["tnf"][col[s]]
            d = np.sqrt(np.einsum("ij,ij->i", diff, diff))
            out[s] = np.round(1 - tnf.decided(d, *coefficients[:, s]), 6)
        return out

    def found(self):
        """src, dst, sim, own, top of some fragments at a time."""
        for k, span in enumerate(self.spans):
            self._merge(k, span)
            row, ids, sim = self._listed(k)
            yield self.m["id"][span][row], ids, sim, self.m["id"][span], self.top[span]


def leading(rows: np.ndarray) -> np.ndarray:
    """The directions of fragments, leading ones first."""
    c = rows - rows.mean(axis=0) if len(rows) else rows
    return np.linalg.eigh(c.T @ c)[1][:, ::-1].copy()


def rest(turned: np.ndarray, norm: np.ndarray, most: int) -> np.ndarray:
    """The norm of what the first directions leave out."""
    return np.sqrt(np.maximum(norm - (turned[:, :most] ** 2).sum(axis=1), 0))


def facing(turned: np.ndarray, norm: np.ndarray, held: bool = False) -> np.ndarray:
    """Rows whose products, held ones with others, are squared distances from below."""
    n, k = turned.shape
    out = np.ones((n, k + 2), np.float32)
    np.multiply(turned, -2 if held else 1, out=out[:, :k], casting="same_kind")
    out[:, k + held] = norm * LESS
    return out


def fewer(turned: np.ndarray, norm: np.ndarray, held: bool = False) -> np.ndarray:
    """The same by the FEW leading directions and the norm of the rest; in the last place what a held one reaches is taken off."""
    left = rest(turned[:, :FEW].astype(float), norm, FEW)
    return np.column_stack([facing(np.column_stack([turned[:, :FEW], left]), norm, held), np.ones(len(turned), np.float32)])


def spans(blocks: list[np.ndarray]) -> list[slice]:
    """Where blocks lie, one after the other."""
    at = np.cumsum([0, *(len(b) for b in blocks)]).tolist()
    return [slice(x, y) for x, y in zip(at[:-1], at[1:])]


def sides(log: np.ndarray) -> np.ndarray:
    """What fragments of these lengths add to the four coefficients as the shorter one, and as the longer one."""
    return np.concatenate([tnf.side("x", log), tnf.side("y", log)]).T.copy()


def listed(row: np.ndarray, ids: np.ndarray, sim: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By row, falling similarity (0 to 1, of six decimals) and id; all three are one number where they fit 63 bits."""
    if len(row) and 0 <= ids.min() and ids.max() < 1 << 33 and row.max() < 1 << 10:
        key = np.sort(row << 53 | (1_000_000 - np.rint(sim * 1e6).astype(np.int64)) << 33 | ids)
        return key >> 53, key & ((1 << 33) - 1), (1_000_000 - (key >> 33 & ((1 << 20) - 1))) / 1e6
    keep = np.lexsort((ids, -sim, row))
    return row[keep], ids[keep], sim[keep]


def reached(b: np.ndarray, c: np.ndarray, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """From where to where b + c * d is at most z; inf and -1 if nowhere."""
    with np.errstate(divide="ignore", invalid="ignore"):
        at = (z - b) / c
    far = np.where(c > 0, at, np.where((c < 0) | (b <= z), np.inf, -1.0))
    near = np.where(c < 0, np.maximum(at, 0), 0.0)
    none = (far < 0) | (near > FARTHEST)
    return np.where(none, np.inf, near), np.where(none, -1.0, far)


def decided_odds(d, b1, c1, b2, c2) -> np.ndarray:
    first = b1 + c1 * d
    return np.where(first < -tnf.LOG_FLOOR, first, np.maximum(b2 + c2 * d, -tnf.LOG_FLOOR))


def _passing(batches: list[pa.RecordBatch]) -> dict[str, np.ndarray]:
    t = pa.Table.from_batches(batches).combine_chunks()
    rows = arrays({c: t[c].combine_chunks() for c in t.column_names})
    return {"id": t["contig_id"].to_numpy(), "log": rows["log"], "tnf": rows["tnf"], "covered": t["covered"].to_numpy()}


def _streamed(feats: DataFrame, n: int, min_cv: float, most: int, wide: int, later: bool) -> DataFrame:
    spark = feats.sparkSession
    lengths = feats.agg(F.min("length").alias("low"), F.max("length").alias("high")).first()
    edges = length_cells(*tnf.log_length([lengths.low, lengths.high]), FINE)
    box = spark.sparkContext.broadcast((edges, lower_coefficients(edges)))
    cores = min(spark.sparkContext.defaultParallelism, -(-n // ROWS))
    parts = cores * -(-n // (wide * cores))  # all tasks have the same work, so none is left to run alone
    rows = feats.select("contig_id", *(c for c in wanted(feats) if c not in ("mean", "var")), F.exists("mean", lambda x: x > min_cv).alias("covered"))
    own = rows.withColumn("part", F.pmod(F.xxhash64("contig_id"), F.lit(parts)).cast("int")).withColumn("other", F.lit(False))
    others = rows.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).withColumn("other", F.lit(True))

    def run(batches):
        own, held, some, size = None, [], [], FIRST
        for b in batches:
            cut = b.num_rows - int(np.count_nonzero(b.column("other").to_numpy(zero_copy_only=False)))
            if cut:
                held.append(b.slice(0, cut))
            while held and cut < b.num_rows:
                own = own or Nearest(_passing(held), *box.value, most)
                some.append(b.slice(cut, size - sum(x.num_rows for x in some)))
                cut += some[-1].num_rows
                if sum(x.num_rows for x in some) == size:
                    own.meet(_passing(some))
                    some, size = [], min(2 * size, TILE)
        if own is not None:
            if some:
                own.meet(_passing(some))
            for found in own.found():
                yield from _record(*found, later)

    dealt = own.unionByName(others).repartitionById(parts, F.col("part")).sortWithinPartitions("other", "length")
    return dealt.mapInArrow(run, SCHEMA)
