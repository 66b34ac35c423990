"""Pairs of fragments that share a marker, in the four modes, and their distances.

A marker's carriers are dealt to groups of about CARRIERS by a hash of the fragment. For pairs
within one set of carriers, every two groups meet in one cell of a triangle, so each pair is
made once; where two sets meet, the cells are a grid. A marker on many fragments is thereby
as many join keys as its pairs need, none with more than about CARRIERS ** 2 of them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrift.operators import measure
from spindrift.plans.stage import spread

UNMEASURED = 200
CARRIERS = 1024


def _grouped(carriers: DataFrame, keys: list[str], most: int) -> DataFrame:
    """``carriers`` with _g, the number of groups of their key, and _i, their own; keys of one group cost no row more."""
    sizes = carriers.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / most).cast("int").alias("_g"))
    return carriers.join(sizes.where("_g > 1"), keys, "left").withColumn("_g", F.coalesce("_g", F.lit(1))).withColumn("_i", F.pmod(F.xxhash64("contig_id"), F.col("_g")).cast("int"))


def _upto(first, last):
    return F.explode(F.sequence(first, last))


def triangle(carriers: DataFrame, keys: list[str], payload: str | None = None, most: int = CARRIERS) -> DataFrame:
    """c1 < c2 of every pair of rows with equal ``keys``, once a key; with ``payload``, pairs that differ in it."""
    d = _grouped(carriers, keys, most)
    held = [payload] if payload else []
    x = d.select(*keys, F.col("contig_id").alias("x"), *(F.col(c).alias("px") for c in held), "_i", _upto(F.col("_i"), F.col("_g") - 1).alias("_j"))
    y = d.select(*keys, F.col("contig_id").alias("y"), *(F.col(c).alias("py") for c in held), F.col("_i").alias("_j"), _upto(F.lit(0), F.col("_i")).alias("_i"))
    met = x.join(y, [*keys, "_i", "_j"]).where("x < y or (_i < _j and x <> y)")
    return (met.where("px <> py") if payload else met).select(F.least("x", "y").alias("c1"), F.greatest("x", "y").alias("c2"))


def _sides(some: DataFrame, carriers: DataFrame, keys: list[str], most: int) -> tuple[DataFrame, DataFrame]:
    """``some`` (c1) and ``carriers`` (c2) by the cells of ``keys``, _i and _j in which they meet."""
    a, b = _grouped(some, keys, most), _grouped(carriers, keys, most)
    groups = lambda d, name: d.select(*keys, F.col("_g").alias(name)).distinct()
    x = a.join(groups(b, "_h"), keys).select(*keys, F.col("contig_id").alias("c1"), "_i", _upto(F.lit(0), F.col("_h") - 1).alias("_j"))
    y = b.join(groups(a, "_h"), keys).select(*keys, F.col("contig_id").alias("c2"), F.col("_i").alias("_j"), _upto(F.lit(0), F.col("_h") - 1).alias("_i"))
    return x, y


def grid(some: DataFrame, carriers: DataFrame, keys: list[str], most: int = CARRIERS) -> DataFrame:
    """c1, c2: each of ``some`` with every other carrier of its key."""
    x, y = _sides(some, carriers, keys, most)
    return x.join(y, [*keys, "_i", "_j"]).where("c1 <> c2").select("c1", "c2")


def guard(mg: DataFrame, recruitable: DataFrame, feats: DataFrame, least: int = 0, fill: int = UNMEASURED, min_cv: float = 1.0, most: int = CARRIERS) -> DataFrame:
    """c1, c2, d of ``pairs_guard`` from ``least`` on, once for each marker that both carry; ``fill`` where a side is not kept.

    Features travel to the cells once a carrier, not once a pair, and pairs are made and measured there.
    """
    mg = mg.select("marker_id", "contig_id")
    x, y = _sides(mg.join(recruitable, "contig_id", "left_semi"), mg, ["marker_id"], most)
    keys, columns = ["marker_id", "_i", "_j"], measure.wanted(feats)
    rows = x.select(*keys, F.col("c1").alias("contig_id"), F.lit(True).alias("some")).unionByName(y.select(*keys, F.col("c2").alias("contig_id"), F.lit(False).alias("some")))
    rows = rows.join(feats.select("contig_id", *columns), "contig_id", "left").select(*keys, "contig_id", "some", *columns)

    def run(batches):
        for b, cut in _whole_cells(batches, len(keys)):
            ids, some, kept = b.column("contig_id").to_numpy(), b.column("some").to_numpy(zero_copy_only=False), b.column("length").is_valid().to_numpy(zero_copy_only=False)
            held = b.filter(pa.array(kept))
            m, at = measure.arrays({c: held.column(c) for c in columns}), np.cumsum(kept) - 1
            for i, j in _met(some, ~some, cut):
                other = ids[i] != ids[j]
                i, j = i[other], j[other]
                d, both = np.full(len(i), fill, np.int32), kept[i] & kept[j]
                first = np.where(ids[i] < ids[j], i, j)[both]
                one, two = at[first], at[(i + j)[both] - first]
                d[both] = measure.measured_batch(ids[first], ids[(i + j)[both] - first], {k: v[one] for k, v in m.items()}, {k: v[two] for k, v in m.items()}, min_cv).column("d").to_numpy()
                far = d >= least
                yield pa.record_batch([pa.array(ids[i[far]]), pa.array(ids[j[far]]), pa.array(d[far])], ["c1", "c2", "d"])

    return spread(rows, *keys).sortWithinPartitions(*keys).mapInArrow(run, "c1 long, c2 long, d int")


def unlike(mg: DataFrame, bins: DataFrame, asked: DataFrame, feats: DataFrame, least: int, fill: int = UNMEASURED, min_cv: float = 1.0, most: int = CARRIERS) -> DataFrame:
    """b1, b2 of ``asked`` between which two carriers of a marker are ``least`` or more apart; ``fill`` where a side is not kept. bins: contig_id, bin_id.

    Carriers in other bins stay behind, features travel to the cells once a carrier, and a task
    measures no more pairs of two bins once it has found them apart.
    """
    carriers = mg.select("marker_id", "contig_id").join(bins.select("contig_id", "bin_id"), "contig_id")
    side = lambda b: carriers.join(asked.select("b1", "b2", F.col(b).alias("bin_id")), "bin_id").select("marker_id", "b1", "b2", "contig_id")
    keys, columns = ["marker_id", "b1", "b2"], measure.wanted(feats)
    x, y = _sides(side("b1"), side("b2"), keys, most)
    keys = [*keys, "_i", "_j"]
    rows = x.select(*keys, F.col("c1").alias("contig_id"), F.lit(True).alias("some")).unionByName(y.select(*keys, F.col("c2").alias("contig_id"), F.lit(False).alias("some")))
    rows = rows.join(feats.select("contig_id", *columns), "contig_id", "left").select(*keys, "contig_id", "some", *columns)

    def run(batches):
        apart = set()
        for b, cut in _whole_cells(batches, len(keys)):
            ids, first, kept = b.column("contig_id").to_numpy(), b.column("some").to_numpy(zero_copy_only=False), b.column("length").is_valid().to_numpy(zero_copy_only=False)
            two, of = np.unique(np.stack([b.column("b1").to_numpy(), b.column("b2").to_numpy()]), axis=1, return_inverse=True)
            two, of = list(zip(*two.tolist())), of.reshape(-1)
            some = first & ~np.array([t in apart for t in two])[of]
            held = b.filter(pa.array(kept))
            m, at = measure.arrays({c: held.column(c) for c in columns}), np.cumsum(kept) - 1
            for i, j in _met(some, ~first, cut):
                d, both = np.full(len(i), fill, np.int32), kept[i] & kept[j]
                near, far = np.where(ids[i] < ids[j], i, j)[both], np.where(ids[i] < ids[j], j, i)[both]
                d[both] = measure.measured_batch(ids[near], ids[far], {k: v[at[near]] for k, v in m.items()}, {k: v[at[far]] for k, v in m.items()}, min_cv).column("d").to_numpy()
                found = np.unique(of[i[d >= least]])
                if len(found):
                    some &= ~np.isin(of, found)  # no cell that follows meets these bins again
                    new = [two[k] for k in found if two[k] not in apart]
                    apart.update(new)
                    yield pa.record_batch([pa.array([t[k] for t in new], pa.int64()) for k in (0, 1)], ["b1", "b2"])

    return spread(rows, *keys).sortWithinPartitions(*keys).mapInArrow(run, "b1 long, b2 long").distinct()


def measured(mg: DataFrame, feats: DataFrame, binning: DataFrame | None = None, same: bool = False, min_cv: float = 1.0, limit: int = measure.FEATURE_LIMIT, most: int = CARRIERS, least: int = 0) -> DataFrame:
    """All measures of ``pairs_all``, or with ``binning`` of the pairs of one bin (``same``) or of two, whose sides are both kept and at least ``least`` apart.

    Features beyond ``limit`` travel to the markers' cells once a carrier, not once a pair, and pairs are made and measured there.
    """
    if feats.count() * measure._ROW <= limit:
        pairs = pairs_all(mg, most) if binning is None else (pairs_within if same else pairs_merge)(mg, binning, most)
        return measure.measure(pairs, feats, min_cv, limit).where(F.col("d") >= least)
    carriers = mg.select("marker_id", "contig_id") if binning is None else _binned(mg, binning)
    keys, columns, held = ["marker_id"], measure.wanted(feats), [] if binning is None else ["bin_label"]
    if same:
        keys, carriers = [*keys, "_b"], carriers.withColumn("_b", F.xxhash64("bin_label"))  # labels themselves are compared, too
    cells = _grouped(carriers, keys, most).withColumn("_k", _upto(F.lit(0), F.col("_g") - 1))
    side = F.when(F.col("_i") == F.col("_k"), 0).when(F.col("_i") < F.col("_k"), 1).otherwise(2)  # both sides, the first, the second
    rows = cells.select(*keys, F.least("_i", "_k").alias("_i"), F.greatest("_i", "_k").alias("_j"), "contig_id", side.alias("side"), *held)
    keys = [*keys, "_i", "_j"]
    rows = rows.join(feats.select("contig_id", *columns), "contig_id").select(*keys, "contig_id", "side", *held, *columns)

    def run(batches):
        for b, cut in _whole_cells(batches, len(keys)):
            ids, side = b.column("contig_id").to_numpy(), b.column("side").to_numpy()
            label = b.column("bin_label").dictionary_encode().indices.to_numpy() if held else None
            m = measure.arrays({c: b.column(c) for c in columns})
            for i, j in _met(side != 2, side != 1, cut):
                own = (side[i] != 0) | (ids[i] < ids[j])
                if held:
                    own &= (label[i] == label[j]) == same
                i, j = i[own], j[own]
                one = np.where(ids[i] < ids[j], i, j)
                two = i + j - one
                for k in range(0, len(one), measure.PAIRS):
                    x, y = one[k : k + measure.PAIRS], two[k : k + measure.PAIRS]
                    yield measure.measured_batch(ids[x], ids[y], {c: v[x] for c, v in m.items()}, {c: v[y] for c, v in m.items()}, min_cv)

    return spread(rows, *keys).sortWithinPartitions(*keys).mapInArrow(run, measure.SCHEMA).where(F.col("d") >= least).dropDuplicates(["c1", "c2"])


def _whole_cells(batches, keys: int):
    """Batches in the order of their first ``keys`` columns, joined and cut so that no cell is in two; with the rows at which cells begin, and the number of rows."""
    held = None
    for b in batches:
        held = b if held is None else pa.Table.from_batches([held, b]).combine_chunks().to_batches()[0] if b.num_rows else held
        cut = _begins(held, keys)
        if len(cut) > 1:
            yield held.slice(0, cut[-1]), cut
            held = held.slice(cut[-1])
    if held is not None and held.num_rows:
        yield held, np.append(_begins(held, keys), held.num_rows)


def _begins(b: pa.RecordBatch, keys: int) -> np.ndarray:
    columns = [b.column(k).to_numpy() for k in range(keys)]
    new = np.ones(b.num_rows, bool)
    new[1:] = np.any([c[1:] != c[:-1] for c in columns], axis=0)
    return np.flatnonzero(new)


def _met(some: np.ndarray, others: np.ndarray, cut: np.ndarray, size: int = measure.PAIRS):
    """Row numbers of the pairs within cells, of some and others, about ``size`` at a time."""
    left, right, n = [], [], 0
    for at, to in zip(cut[:-1], cut[1:]):
        x, y = at + np.flatnonzero(some[at:to]), at + np.flatnonzero(others[at:to])
        step = max(1, size // max(1, len(y)))
        for k in range(0, len(x), step):
            i = x[k : k + step]
            left.append(np.repeat(i, len(y)))
            right.append(np.tile(y, len(i)))
            n += len(left[-1])
            if n >= size:
                yield np.concatenate(left), np.concatenate(right)
                left, right, n = [], [], 0
    if n:
        yield np.concatenate(left), np.concatenate(right)


def pairs_all(mg: DataFrame, most: int = CARRIERS) -> DataFrame:
    """c1 < c2 that carry one marker."""
    return triangle(mg.select("marker_id", "contig_id"), ["marker_id"], most=most).distinct()


def _binned(mg: DataFrame, binning: DataFrame) -> DataFrame:
    return mg.join(binning.select("contig_id", "bin_label"), "contig_id").select("marker_id", "bin_label", "contig_id")


def pairs_within(mg: DataFrame, binning: DataFrame, most: int = CARRIERS) -> DataFrame:
    """c1 < c2 of one bin: the bin is part of the join key, so other pairs are never made."""
    return triangle(_binned(mg, binning), ["marker_id", "bin_label"], most=most).distinct()


def pairs_merge(mg: DataFrame, binning: DataFrame, most: int = CARRIERS) -> DataFrame:
    """c1 < c2 of different bins."""
    return triangle(_binned(mg, binning), ["marker_id"], "bin_label", most).distinct()


def pairs_guard(mg: DataFrame, recruitable: DataFrame, most: int = CARRIERS) -> DataFrame:
    """Directed: c1 recruitable, c2 any other carrier."""
    mg = mg.select("marker_id", "contig_id")
    return grid(mg.join(recruitable, "contig_id", "left_semi"), mg, ["marker_id"], most).distinct()


def filled(pairs: DataFrame, measured: DataFrame, fill: int | None = None) -> DataFrame:
    """c1, c2, d: unmeasured pairs go, or get ``fill``. ``measured`` has c1 < c2."""
    key = pairs.select("c1", "c2", F.least("c1", "c2").alias("_a"), F.greatest("c1", "c2").alias("_b"))
    m = measured.select(F.col("c1").alias("_a"), F.col("c2").alias("_b"), "d")
    if fill is None:
        return key.join(m, ["_a", "_b"]).select("c1", "c2", "d")
    return key.join(m, ["_a", "_b"], "left").select("c1", "c2", F.coalesce("d", F.lit(fill)).alias("d"))


def measure_stats(pairs: DataFrame, measured: DataFrame, fill: int | None = None) -> DataFrame:
    """measured, filled, skipped counters of ``filled``."""
    m = measured.select(F.least("c1", "c2").alias("_a"), F.greatest("c1", "c2").alias("_b"), F.lit(1).alias("m"))
    d = pairs.select(F.least("c1", "c2").alias("_a"), F.greatest("c1", "c2").alias("_b")).join(m, ["_a", "_b"], "left")
    missing = F.count_if(F.col("m").isNull())
    return d.agg(F.count("m").alias("measured"), (missing if fill is not None else F.lit(0)).cast("long").alias("filled"), (missing if fill is None else F.lit(0)).cast("long").alias("skipped"))


def relaxed(pairs: DataFrame, strict: DataFrame, loose: DataFrame, fill: int | None = None) -> DataFrame:
    """Distances of the looser coverage filter, with ``fill`` for pairs that it leaves out too; an error if a pair measured by both has changed."""
    changed = strict.join(loose.withColumnRenamed("d", "_d"), ["c1", "c2"]).where("d <> _d").limit(1).count()
    if changed:
        raise ValueError("relaxing the coverage filter changed measured pairs")
    return filled(pairs, loose, fill)


def relax_stats(strict: DataFrame, loose: DataFrame) -> DataFrame:
    """One row: pairs measured by both, recovered by the looser filter alone, and changed."""
    both = loose.select("c1", "c2", "d").join(strict.select("c1", "c2", F.col("d").alias("_d")), ["c1", "c2"], "left")
    return both.agg(F.count("_d").alias("measured"), F.count_if(F.col("_d").isNull()).alias("recovered"), F.count_if(F.col("_d") != F.col("d")).alias("changed"))
