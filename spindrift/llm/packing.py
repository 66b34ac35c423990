"""Best-fit sequence packing by bin completion over the histogram of lengths.

How pieces fit together depends on their lengths alone, and there are at most ``capacity``
different lengths, so the packing problem of any corpus is a histogram of ``capacity``
counts. The driver solves that histogram; the executors turn the answer into places.

Solver: the largest remaining length is completed by undominated fillings (a filling is
dominated if one of its lengths, or two of them together, can be exchanged for a larger free
length that still fits). The best-fit descent is the incumbent. Branch and bound follows, in
rounds: the emptiest sequence and some others, the most wasteful or drawn ones, are searched
depth first for fillings that leave less in the emptiest one. A branch is cut as soon as its
waste exceeds what the incumbent leaves, and as fillings come by rising waste, so are those
after it. Each round that finds something is the next incumbent; a sequence that is left
empty is saved. Every REFITth round instead lays a larger part of the incumbent by best fit anew, so
that the search does not stay with one. Histograms of few sequences are searched whole.

Budgets (parameters): STEPS trials for the fillings of one length (if they yield none, the
filling is greedy by best fit), ROUNDS rounds; a search of PARTNERS sequences beside the
emptiest, at most as many levels deep, has NODES nodes, more than ten times its depth.
They never drop a piece; they can only leave more sequences than needed. The answer says so:
its number of sequences, the lower bound, and ``optimal`` where the two are equal or a whole
search has shown that no fewer will do.

Defined cases: null text is an empty text (one separator id); an empty table gives no rows;
repeated rows and equal doc_ids are packed as often as they occur; extra columns are ignored.
"""

from __future__ import annotations

import bisect
import zlib
from collections import Counter
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spindrift.llm import common, tokens

CAPACITY = 2048
SEPARATOR_ID = 0
STEPS = 1500
NODES = 100
ROUNDS = 80
REFIT = 8
PARTNERS = 6
WHOLE = 24  # histograms of so many sequences are searched whole


# --- solver ---------------------------------------------------------------------------------


def lower_bound(counts: dict[int, int], capacity: int) -> int:
    """The larger of the volume bound and Martello and Toth's L2."""
    lengths = sorted(counts)
    best = -(-sum(k * n for k, n in counts.items()) // capacity)
    for k in lengths:
        if k > capacity // 2:
            break
        big = sum(counts[x] for x in lengths if x > capacity - k)
        mid = [x for x in lengths if capacity // 2 < x <= capacity - k]
        n_mid = sum(counts[x] for x in mid)
        small = sum(x * counts[x] for x in lengths if k <= x <= capacity // 2)
        room = n_mid * capacity - sum(x * counts[x] for x in mid)
        best = max(best, big + n_mid + max(0, -(-(small - room) // capacity)))
    return best


def undominated(filling: tuple[int, ...], slack: int, lengths: list[int], left: dict[int, int]) -> bool:
    """No length of the filling, and no two together, can be exchanged for a larger free length within the slack."""
    used: dict[int, int] = {}
    for x in filling:
        used[x] = used.get(x, 0) + 1
    free = lambda z: left[z] > used.get(z, 0)
    for i, x in enumerate(filling):
        for low, high in ((x + 1, x + slack), *((x + y, x + y + slack) for y in filling[i + 1 :])):
            for z in lengths[bisect.bisect_left(lengths, low) : bisect.bisect_right(lengths, high)]:
                if free(z):
                    return False
    return True


def fillings(room: int, lengths: list[int], left: dict[int, int], steps: int, cut: list | None = None, most: int | None = None):
    """Maximal undominated fillings of ``room`` that waste ``most`` or less, as (waste, lengths), by largest lengths first.

    Within ``steps`` trials; ``cut`` gets an entry where these did not do.
    """
    most = room if most is None else most
    stack: list[list] = [[room, bisect.bisect_right(lengths, room) - 1]]
    chosen: list[int] = []
    used: dict[int, int] = {}
    grew = [False]
    while stack:
        if steps <= 0:
            if cut is not None:
                cut.append(room)
            return
        steps -= 1
        rest, at = stack[-1]
        while at >= 0:
            x = lengths[at]
            if left[x] <= used.get(x, 0):
                at -= 1
            elif most < rest - x < lengths[0]:  # too little is left for any other, and too much to waste
                grew[-1] = True
                at -= 1
            else:
                break
        if at < 0:
            if not grew[-1] and rest <= most and undominated(tuple(chosen), rest, lengths, left):
                yield rest, tuple(chosen)
            stack.pop()
            grew.pop()
            if chosen:
                used[chosen.pop()] -= 1
            continue
        stack[-1][1] = at - 1
        grew[-1] = True
        chosen.append(x)
        used[x] = used.get(x, 0) + 1
        stack.append([rest - x, min(at, bisect.bisect_right(lengths, rest - x) - 1)])
        grew.append(False)


def greedy(room: int, lengths: list[int], left: dict[int, int]) -> tuple[int, tuple[int, ...]]:
    """The largest free length that fits, again and again, as (waste, lengths)."""
    chosen: list[int] = []
    for x in reversed(lengths[: bisect.bisect_right(lengths, room)]):
        times = min(left[x], room // x)
        chosen += [x] * times
        room -= x * times
    return room, tuple(chosen)


def options(counts: dict[int, int], lengths: list[int], capacity: int, steps: int, first: bool = False, cut: list | None = None, most: int | None = None):
    """The largest length's fillings by waste, each as (waste, pattern, times it fits); with ``first`` only the best, with ``most`` those that waste no more (there may be none)."""
    top = lengths[-1]
    counts[top] -= 1
    found = []
    for waste, f in fillings(capacity - top, lengths, counts, steps, cut, most):
        found.append((waste, f))
        if waste == 0 and first:
            break
    if not found and (most is None or cut):
        w, f = greedy(capacity - top, lengths, counts)
        found = [(w, f)] if most is None or w <= most else []
    counts[top] += 1
    found.sort(key=lambda wf: wf[0])
    out = []
    for waste, f in found[: 1 if first else None]:
        pattern = (top, *f)
        need = Counter(pattern)
        out.append((waste, pattern, min(counts[x] // k for x, k in need.items())))
    return out


def _apply(counts: dict[int, int], lengths: list[int], pattern, times: int) -> None:
    for x in pattern:
        counts[x] -= times
        if counts[x] == 0:
            del lengths[bisect.bisect_left(lengths, x)]


def _undo(counts: dict[int, int], lengths: list[int], pattern, times: int) -> None:
    for x in pattern:
        if counts[x] == 0:
            bisect.insort(lengths, x)
        counts[x] += times


class Solution(NamedTuple):
    """Patterns (lengths of one sequence, largest first) and how often each is used; sequences in all, and no fewer than ``bound`` can hold the pieces; whether a whole search has shown that no fewer will do."""

    patterns: list[tuple[tuple[int, ...], int]]
    sequences: int
    bound: int
    shown: bool = False

    @property
    def status(self) -> str:
        return "optimal" if self.shown or self.sequences == self.bound else "within budget"


def descent(histogram: dict[int, int], capacity: int, steps: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit completion of the largest length, repeated until a length runs out: at most as many patterns as lengths, whatever the counts."""
    counts = {k: n for k, n in histogram.items() if n > 0}
    lengths, out = sorted(counts), []
    while lengths:
        _, pattern, times = options(counts, lengths, capacity, steps, True)[0]
        _apply(counts, lengths, pattern, times)
        out.append((pattern, times))
    return out


class Found(NamedTuple):
    """The best sequences of a search (None: none better than the incumbent), what the emptiest of them holds, leaves reached, and whether nothing was left out."""

    sequences: list[tuple[int, ...]] | None
    least: int
    leaves: int
    whole: bool


def search(pieces: dict[int, int], capacity: int, sequences: int, least: int, steps: int = STEPS, nodes: int = NODES) -> Found:
    """Depth-first search for ``sequences`` sequences of which one holds less than ``least``, as little as can be; one that holds nothing is left out."""
    counts = {k: n for k, n in pieces.items() if n > 0}
    lengths = sorted(counts)
    total = rest = sum(k * n for k, n in counts.items())
    slack = (sequences - 1) * capacity - total  # what the others waste, less what the emptiest holds
    goal = max(0, -slack)  # no less can be left in the emptiest
    best, path, waste, leaves = None, [], 0, 0
    cut: list[int] = []
    branch = lambda: iter(options(counts, lengths, capacity, steps, cut=cut, most=slack + least - 1 - waste))
    stack = [branch()] if lengths and sequences > 1 else []
    while stack and nodes > 0 and least > goal:
        step = next(stack[-1], None)
        nodes -= 1
        if step is not None and waste + step[0] > slack + least - 1:
            step = None  # fillings come by rising waste
        if step is None:
            stack.pop()
            if path:
                p = path.pop()
                _undo(counts, lengths, p, 1)
                waste -= capacity - sum(p)
                rest += sum(p)
            continue
        w, p, _ = step
        _apply(counts, lengths, p, 1)
        path.append(p)
        waste += w
        rest -= capacity - w
        if rest <= capacity:  # one more sequence holds what is left
            leaves += 1
            empty = 0 if len(path) + 1 < sequences else rest  # a sequence fewer leaves one that holds nothing
            if empty < least:
                least = empty
                last = tuple(x for x in reversed(lengths) for _ in range(counts[x]))
                best = [*path, last] if last else list(path)
            stack.append(iter(()))
        else:
            stack.append(branch())
    return Found(best, least, leaves, not cut and (not stack or least <= goal))


def _taken(patterns: list[tuple[int, ...]]) -> Counter:
    return Counter(x for p in patterns for x in p)


def _refitted(uses: Counter, order: list, capacity: int, r: np.random.Generator, k: int, steps: int) -> Counter:
    """A new incumbent: a larger part of the old one, its most wasteful sequences and some drawn ones, by best fit anew; the old one if that takes more sequences, or as many with the emptiest fuller."""
    wasteful, drawn = (60, 100, 150)[k % 3], (60, 120, 240)[k // 3 % 3]
    apart: Counter = Counter()
    for p in order:
        apart[p] = min(uses[p], max(0, wasteful - apart.total()))
    apart = +apart
    rest = [p for p in order if p not in apart]
    for i in r.permutation(len(rest))[:drawn].tolist():
        apart[rest[i]] = 1
    again: Counter = Counter()
    for p, t in descent(_taken(list(apart.elements())), capacity, steps):
        again[p] += t
    if (again.total(), min(map(sum, again))) > (apart.total(), min(map(sum, apart))):
        return uses
    return uses - apart + again


def solve(histogram: dict[int, int], capacity: int = CAPACITY, steps: int = STEPS, nodes: int = NODES, rounds: int = ROUNDS, partners: int = PARTNERS, refit: int = REFIT) -> Solution:
    """A packing of ``histogram`` (length to pieces), with its bound."""
    histogram = {k: n for k, n in histogram.items() if n > 0}
    if any(k > capacity or k < 1 for k in histogram):
        raise ValueError("lengths must lie between 1 and the capacity")
    bound = lower_bound(histogram, capacity)
    uses, shown = Counter(), False
    for p, t in descent(histogram, capacity, steps):
        uses[p] += t
    while bound < uses.total() <= WHOLE and not shown:
        found = search(histogram, capacity, uses.total(), min(map(sum, uses)), steps, max(1, rounds) * nodes)
        shown = found.whole and found.least > 0
        if not found.sequences or found.least > 0:
            break
        uses = Counter(found.sequences)
    r = np.random.default_rng(17)
    for k in range(rounds):
        if uses.total() <= bound or shown:
            break
        order = sorted((p for p in uses if uses[p]), key=lambda p: (sum(p), p))
        if refit and k % refit == 1:
            uses = _refitted(uses, order, capacity, r, k // refit, steps)
            continue
        others, near = order[1:], partners // 2
        wide = others[: 6 * partners]
        some = [wide[i] for i in r.permutation(len(wide))[:near].tolist()]
        free = [p for p in others if p not in some]
        some = [order[0], *some, *(free[i] for i in r.permutation(len(free))[: partners - near].tolist())]
        found = search(_taken(some), capacity, len(some), sum(order[0]), steps, nodes)
        if found.sequences:
            uses = uses - Counter(some) + Counter(found.sequences)
    patterns = sorted(uses.items(), key=lambda pt: (-sum(pt[0]), pt[0]))
    return Solution(patterns, uses.total(), bound, shown)


def places(patterns: list[tuple[tuple[int, ...], int]]) -> dict[str, np.ndarray]:
    """Per length the intervals of ranks that a pattern takes: length, first rank, pieces a sequence, first sequence, first offset."""
    rank: dict[int, int] = {}
    rows = []
    base = 0
    for pattern, times in patterns:
        offset = 0
        for x in sorted(set(pattern), reverse=True):
            k = pattern.count(x)
            rows.append((x, rank.get(x, 0), k, base, offset))
            rank[x] = rank.get(x, 0) + k * times
            offset += k * x
        base += times
    rows.sort()
    names = ("length", "rank", "each", "sequence", "offset")
    return {n: np.array([r[i] for r in rows], np.int64) for i, n in enumerate(names)}


# --- Spark ----------------------------------------------------------------------------------


def pieces(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, separator: int = SEPARATOR_ID) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every document's ids, cut only where longer than ``capacity``."""
    path = tokenizer or tokens.default_path()

    def run(batches):
        words = tokens.words(path)
        end = np.array([separator], "<u4").tobytes()
        for b in common.slices(batches):
            ids, at = words.encode(common.texts(b.column(1)))
            data = memoryview(np.ascontiguousarray(ids.astype("<u4", copy=False))).cast("B")
            row, piece, length, crc = [], [], [], []
            for i, (s, e) in enumerate(zip(at[:-1].tolist(), at[1:].tolist())):
                n = e - s + 1
                for k in range(-(-n // capacity)):
                    lo, hi = s + k * capacity, min(s + (k + 1) * capacity, e + 1)
                    c = zlib.crc32(data[4 * lo : 4 * min(hi, e)])
                    row.append(i)
                    piece.append(k)
                    length.append(hi - lo)
                    crc.append(zlib.crc32(end, c) if hi > e else c)
            piece, length = np.array(piece, np.int32), np.array(length, np.int64)
            yield pa.record_batch([b.column(0).take(pa.array(row, pa.int64())), pa.array(piece), pa.array(piece.astype(np.int64) * capacity), pa.array(length), pa.array(crc, pa.int64())], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def ranked(df: DataFrame, key: str, order: list[str], salts: int) -> DataFrame:
    """``_rank`` from 0 within ``key``, by salt and then ``order``: a hot key is ranked by ``salts`` tasks."""
    d = df.withColumn("_salt", F.pmod(F.xxhash64(*order), F.lit(salts)))
    own = Window.partitionBy(key).orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    first = d.groupBy(key, "_salt").agg(F.count(F.lit(1)).alias("_n")).select(key, "_salt", F.coalesce(F.sum("_n").over(own), F.lit(0)).alias("_first"))
    d = d.withColumn("_row", F.row_number().over(Window.partitionBy(key, "_salt").orderBy(*order)))
    return d.join(first, [key, "_salt"]).withColumn("_rank", F.col("_first") + F.col("_row") - 1).drop("_salt", "_first", "_row")


def pack(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, separator: int = SEPARATOR_ID, steps: int = STEPS, nodes: int = NODES, rounds: int = ROUNDS, partners: int = PARTNERS) -> DataFrame:
    """pieces() with sequence_id and offset; sequences hold at most ``capacity`` ids without gaps. Every row also says how many sequences there are, and the bound below which there can be none."""
    spark = docs.sparkSession
    cut = common.written(pieces(docs, tokenizer, capacity, separator), "pieces")
    histogram = {int(r[0]): int(r[1]) for r in cut.groupBy("length").count().collect()}  # at most ``capacity`` rows
    answer = solve(histogram, capacity, steps, nodes, rounds, partners)
    place = spark.sparkContext.broadcast(places(answer.patterns))  # about capacity patterns, more by at most those of the rounds
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]

    def run(batches):
        p = place.value
        stride = np.int64(1) << 42
        keys = p["length"] * stride + p["rank"]
        for b in batches:
            length, rank = b.column("length").to_numpy(), b.column("_rank").to_numpy()
            at = np.searchsorted(keys, length * stride + rank, "right") - 1
            j = rank - p["rank"][at]
            each = p["each"][at]
            out = [b.column(n) for n in names[:5]] + [pa.array(p["sequence"][at] + j // each), pa.array(p["offset"][at] + j % each * length)]
            yield pa.record_batch(out, names)

    salts = max(64, -(-sum(histogram.values()) // 100_000))
    d = ranked(cut, "length", ["doc_id", "piece", "ids_crc32"], salts)
    out = d.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
    return out.withColumns({"sequences": F.lit(answer.sequences).cast("long"), "bound": F.lit(answer.bound).cast("long"), "status": F.lit(answer.status)})


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(common.table(spark, sf_dir, "documents"))


QUERIES = {"op5_best_fit_packing": op5_best_fit_packing}
ORACLE_SQL: dict[str, str] = {}
