"""The similarity graph: cutoff, edges and the composite edge score over the nearest neighbours of ``knn``."""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spindrift.operators.knn import MOST_EDGES, neighbours  # noqa: F401
from spindrift.operators.measure import covered
from spindrift.plans.stage import written

COVERAGE = 0.95
MIN_SAMPLES = 3  # from so many on, correlation takes part in the score
DECIMALS = 6
RANGES = 4096
MISSING = 9.0  # ranks behind all others


class Rand:
    """The additive feedback generator behind C's rand() on common Linux systems, seeded like srand(seed)."""

    def __init__(self, seed: int = 1):
        x, state = seed or 1, []
        for _ in range(31):
            state.append(x)
            x = 16807 * x % 2147483647
        self.state = state + state[:3]
        for _ in range(310):
            self.next()

    def next(self) -> int:
        v = (self.state[-31] + self.state[-3]) & 0xFFFFFFFF
        self.state = self.state[-33:] + [v]
        return v >> 1


def coverage_curve(near: DataFrame) -> np.ndarray:
    """How many fragments have a largest similarity of so many per mille or more, for 0 to 1000, and the number of fragments at 0; one row a per mille is collected."""
    level = F.greatest(F.floor(F.round(F.col("sim") * 1e6) / 1000), F.lit(0)).cast("int")
    counts = np.zeros(1001, np.int64)
    for r in near.where("dst is null").groupBy(level.alias("level")).count().collect():
        counts[r.level] += r["count"]
    return curve(counts)


def curve(counts: np.ndarray) -> np.ndarray:
    return counts[::-1].cumsum()[::-1]


def _steps(rand: Rand | None):
    """The per milles to look at, falling from 999: all of them, or with random steps that widen on the way down."""
    p = 999
    while True:
        yield p
        wide = 1 if p > 990 else 3 if p > 900 else 9
        p -= 1 if rand is None else wide + rand.next() % 3


def cutoff(reach: np.ndarray, coverage: float = COVERAGE, rand: Rand | None = None) -> int:
    """The first per mille looked at where ``coverage`` of the fragments have a neighbour, or the one before if its share is closer; 700 or a little less if none has.

    ``reach`` is a coverage curve. The share above 999 counts as none.
    """
    share = reach / max(1, reach[0]) if reach[0] else np.ones(1001)
    share = np.append(share[:1000], 0.0)
    for above, p in itertools.pairwise(itertools.chain([1000], _steps(rand))):
        if p <= 700:
            return p
        if share[p] >= coverage:
            return min((p, above), key=lambda q: abs(share[q] - coverage))


def _drawn(reach: np.ndarray, size: int, rand: Rand) -> np.ndarray:
    """The curve of ``size`` fragments drawn without repetition: positions in the order of similarity, moved in a map of the few that have moved."""
    n, moved, drawn = int(reach[0]), {}, []
    for k in range(size):
        j = k + rand.next() % (n - k)
        drawn.append(moved.get(j, j))
        moved[j] = moved.get(k, k)
    below = n - reach  # positions of similarities below each level
    level = np.searchsorted(below, np.array(drawn), "right") - 1
    return curve(np.bincount(level, minlength=1001)[:1001])


def pooled_cutoff(reach: np.ndarray, seed: int = 1, full: int = 25_000, sample: int = 2500, runs: int = 10) -> float:
    """One search with random steps up to ``full`` fragments; above, the mean of ``runs`` searches in samples, each 700 at least. Two runs at 700 are all."""
    rand, n = Rand(seed), int(reach[0])
    if n <= full:
        for _ in range(n):  # the full sample is drawn too
            rand.next()
        return float(cutoff(reach, rand=rand))
    found: list[int] = []
    while len(found) < runs and not (len(found) == 2 and sum(found) < 1402):
        found.append(max(700, cutoff(_drawn(reach, sample, rand), rand=rand)))
    return sum(found) / runs if len(found) == runs else 700.0


def knn_edges(near: DataFrame, per_mille: float) -> DataFrame:
    """src < dst, sim above the cutoff, from the list of the smaller id."""
    return near.where((F.col("dst") > F.col("src")) & (F.col("sim") > per_mille / 1000))


def ranks(edges: DataFrame, value: str, out: str, highest: bool = False) -> DataFrame:
    """``value``, ``out``: the 1-based rank of each distinct value over all rows; ties share the lowest (or highest) rank.

    Counts per distinct value are accumulated over ranges: only one row a range meets in one task.
    """
    v = edges.groupBy(value).agg(F.count(F.lit(1)).alias("_n"))
    v = v.withColumn("_b", F.floor(F.coalesce(F.col(value), F.lit(MISSING)) * 1000))
    sums = v.groupBy("_b").agg(F.sum("_n").alias("_s"))
    before = F.coalesce(F.sum("_s").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    v = v.join(sums.select("_b", before.alias("_base")), "_b")
    own = F.sum("_n").over(Window.partitionBy("_b").orderBy(F.coalesce(F.col(value), F.lit(MISSING))).rowsBetween(Window.unboundedPreceding, 0))
    return v.select(value, (F.col("_base") + own if highest else F.col("_base") + own - F.col("_n") + 1).alias(out))


def global_rank(edges: DataFrame, value: str, out: str, highest: bool = False) -> DataFrame:
    """``edges`` with ``out``, as by ``ranks``."""
    r = ranks(edges, value, out, highest).withColumnRenamed(value, "_v")
    return edges.join(r, F.col(value).eqNullSafe(F.col("_v"))).drop("_v")


def at_rank(asked: DataFrame, rank: str, held: DataFrame, value: str, low: str, rows: int, out: str) -> DataFrame:
    """``asked`` with ``out``: the ``value`` of ``held`` whose interval of ranks, which begins at ``low``, holds ``rank``.

    An interval join without a row for each rank: both sides are merged in the order of ranks,
    within ranges of ranks; what a range has from before is one row a range.
    """
    width = max(1, -(-rows // RANGES))
    kept = [F.col(c) for c in asked.columns]
    x = asked.select(F.col(rank).alias("_k"), F.struct(*kept).alias("_row"), F.lit(None).cast("double").alias("_at"))
    y = held.select(F.col(low).alias("_k"), F.lit(None).cast(x.schema["_row"].dataType).alias("_row"), F.col(value).alias("_at"))
    both = x.unionByName(y).withColumn("_b", F.floor((F.col("_k") - 1) / width))
    last = both.groupBy("_b").agg(F.max_by("_at", F.when(F.col("_at").isNotNull(), F.col("_k"))).alias("_last"))
    carried = last.select("_b", F.last("_last", ignorenulls=True).over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)).alias("_before"))
    own = F.last("_at", ignorenulls=True).over(Window.partitionBy("_b").orderBy("_k", F.col("_at").isNull()).rowsBetween(Window.unboundedPreceding, 0))
    both = both.withColumn("_own", own).where("_row is not null").join(carried, "_b")
    return both.select("_row.*", F.coalesce("_own", "_before").alias(out))


def tally(edges: DataFrame, value: str) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values, MISSING for none, in ascending order, and how many edges have each."""
    t = edges.groupBy(F.coalesce(F.col(value), F.lit(MISSING)).alias("v")).agg(F.count(F.lit(1)).alias("n")).toArrow().sort_by("v")
    return t["v"].to_numpy(), t["n"].to_numpy()


def placed(edges: DataFrame) -> DataFrame:
    """``edges`` (s_tnf, s_abd, s_cor, of DECIMALS decimals) with rank_tnf and rank_cor, as by ``ranks`` (rank_cor the highest of ties), and m_tnf and m_cor, the s_abd at these ranks.

    What every task holds are the distinct values and their ranks, 64 MB at most however many
    edges there are; the edges themselves stay where they are.
    """
    values, low = {}, tally(edges, "s_abd")
    upto = np.cumsum(low[1])
    for name, highest in (("tnf", False), ("cor", True)):
        v, n = tally(edges, f"s_{name}")
        rank = np.cumsum(n) if highest else np.cumsum(n) - n + 1
        values[name] = v, rank, low[0][np.searchsorted(upto, rank)]
    box = edges.sparkSession.sparkContext.broadcast(values)
    added = {f"{k}_{name}": kind for name in ("tnf", "cor") for k, kind in (("rank", "long"), ("m", "double"))}

    def run(batches):
        for b in batches:
            out = list(b.columns)
            for name, (v, rank, at) in box.value.items():
                own = b.column(f"s_{name}")
                k = np.searchsorted(v, own.fill_null(MISSING).to_numpy())
                out += [pa.array(rank[k]), pa.array(at[k])]
            yield pa.record_batch(out, [*b.schema.names, *added])

    return edges.mapInArrow(run, ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in edges.schema), *(f"{c} {kind}" for c, kind in added.items())]))


def composite(edges: DataFrame, feats: DataFrame, min_cv: float = 1.0) -> DataFrame:
    """src, dst, s_tnf, s_abd, s_cor, rank_tnf, rank_cor, score: composition and correlation ranks mapped to the abundance distribution, then a weighted geometric mean.

    Scores have DECIMALS decimals, so each has at most 2 * 10 ** DECIMALS + 2 distinct values however
    many edges there are: ranks, and the values at these ranks, are found among them, and no edge is shuffled.
    """
    pairs = edges.select(F.col("src").alias("c1"), F.col("dst").alias("c2"), F.col("sim").alias("s_tnf"))
    m = covered(pairs, feats, min_cv, extra=["s_tnf"]).select("c1", "c2", "s_tnf", F.round(1 - F.col("abd_dist"), DECIMALS).alias("s_abd"), F.round(F.nanvl("corr", F.lit(None).cast("double")), DECIMALS).alias("s_cor"), "nnz")
    e = placed(written(m, "edges"))
    w = 1.0 / (1 + F.col("nnz"))
    s = F.pow("s_abd", 1 - w) * F.pow("m_tnf", w)
    first = feats.select(F.size("mean")).first()
    score = F.sqrt(s * F.col("m_cor")) if first and first[0] >= MIN_SAMPLES else s
    return e.select(F.col("c1").alias("src"), F.col("c2").alias("dst"), "s_tnf", "s_abd", "s_cor", "nnz", "rank_tnf", "rank_cor", F.round(score, DECIMALS).alias("score"))
