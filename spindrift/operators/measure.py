"""Feature rows of kept fragments and the distances of given pairs.

Pairs are generated first and measured last: the kernel sees only pairs that are needed.
Features that fit FEATURE_LIMIT bytes are broadcast to the pairs; beyond it they are joined.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrift.functions import abundance, tnf

FEATURE_LIMIT = 64 << 20
_ROW = 8 * (len(tnf.KMERS) + 8)


def _kept(depth: DataFrame, min_cv: float, min_cv_sum: float, *more) -> DataFrame:
    bad = (F.col("mean") < 0) | (F.col("mean") > 1e7) | (F.col("var") < 0) | (F.col("var") > 1e14)
    d = depth.groupBy("contig_id").agg(F.sum(F.when(F.col("mean") >= min_cv, F.col("mean")).otherwise(0.0)).alias("_sum"), F.max(bad).alias("_bad"), *more)
    return d.where((F.col("_sum") >= max(min_cv, min_cv_sum)) & ~F.col("_bad")).drop("_sum", "_bad")


def kept(depth: DataFrame, min_cv: float = 1.0, min_cv_sum: float = 1.0) -> DataFrame:
    """contig_id of fragments with enough coverage: the sum over samples of means that reach min_cv; rows with impossible values are out."""
    return _kept(depth, min_cv, min_cv_sum)


def coverage(depth: DataFrame, min_cv: float = 1.0, min_cv_sum: float = 1.0) -> DataFrame:
    """contig_id, mean, var of kept fragments; samples in name order."""
    s = F.array_sort(F.collect_list(F.struct("sample", "mean", "var")))
    return _kept(depth, min_cv, min_cv_sum, s.alias("s")).select("contig_id", F.col("s.mean").alias("mean"), F.col("s.var").alias("var"))


def features(contigs: DataFrame, depth: DataFrame, min_cv: float = 1.0, min_cv_sum: float = 1.0) -> DataFrame:
    """contig_id, length, tnf, kmers, mean, var of kept fragments; kmers are tnf's counts, a fraction as wide, for what goes through a shuffle for each pair."""
    return tnf.vectors(contigs, pack=True).join(coverage(depth, min_cv, min_cv_sum), "contig_id")


PAIRS = 4096  # measured at once
COVERED = ["c1", "c2", "abd_dist", "corr", "nnz"]
COVERED_SCHEMA = "c1 long, c2 long, abd_dist double, corr double, nnz int"
NAMES = ["c1", "c2", "tnf_dist", "tnf_prob", "abd_dist", "corr", "nnz", "d"]
SCHEMA = "c1 long, c2 long, tnf_dist double, tnf_prob double, abd_dist double, corr double, nnz int, d int"


def covered_batch(c1, c2, a: dict, b: dict, min_cv: float) -> pa.RecordBatch:
    """The coverage measures of pairs given as two aligned sets of feature rows."""
    abd, nnz = abundance.all_samples(a["mean"], a["var"], b["mean"], b["var"], min_cv)
    corr = abundance.correlation(a["mean"], b["mean"])
    return pa.record_batch([pa.array(c1, pa.int64()), pa.array(c2, pa.int64()), pa.array(abd), pa.array(corr), pa.array(nnz.astype(np.int32))], COVERED)


def measured_batch(c1, c2, a: dict, b: dict, min_cv: float) -> pa.RecordBatch:
    """All measures of pairs given as two aligned sets of feature rows."""
    diff = a["tnf"] - b["tnf"]
    dist = np.sqrt((diff * diff).sum(axis=1))
    prob = tnf.probability(dist, a["log"], b["log"])
    *ids, abd, corr, nnz = covered_batch(c1, c2, a, b, min_cv).columns
    # two truncations; what lies within rounding noise of a whole per cent counts as whole
    d = np.floor(np.round(prob * 100, 7)) + np.floor(np.round(abd.to_numpy() * 100, 7))
    return pa.record_batch([*ids, pa.array(dist), pa.array(prob), abd, corr, nnz, pa.array(d.astype(np.int32))], NAMES)


def measure(pairs: DataFrame, feats: DataFrame, min_cv: float = 1.0, limit: int = FEATURE_LIMIT, extra: list[str] | None = None) -> DataFrame:
    """c1, c2, the ``extra`` columns of the pairs, and all measures, of those pairs whose fragments are both kept."""
    return _paired(pairs, feats, wanted(feats), arrays, lambda *x: measured_batch(*x, min_cv), SCHEMA, _ROW, limit, extra or [])


def wanted(feats: DataFrame) -> list[str]:
    """The columns of features that all measures need; counts, if they are there, as they are narrower."""
    return ["length", "kmers" if "kmers" in feats.columns else "tnf", "mean", "var"]


def arrays(r) -> dict[str, np.ndarray]:
    """Arrays from a batch's feature columns, by name."""
    return {"log": tnf.log_length(r["length"]), "tnf": tnf.unpacked(r["kmers"]) if "kmers" in r else _rows(r["tnf"])} | {c: _rows(r[c]) for c in ("mean", "var") if c in r}


def covered(pairs: DataFrame, feats: DataFrame, min_cv: float = 1.0, limit: int = FEATURE_LIMIT, extra: list[str] | None = None) -> DataFrame:
    """As ``measure``, but only what coverage tells: such features are a twentieth as wide."""
    row = lambda r: {c: _rows(r[c]) for c in ("mean", "var")}
    first = feats.select(F.size("mean")).first()
    return _paired(pairs, feats, ["mean", "var"], row, lambda *x: covered_batch(*x, min_cv), COVERED_SCHEMA, 8 * (1 + 2 * (first[0] if first else 0)), limit, extra or [])


def matrix(feats: DataFrame, columns: list[str] | None = None, row=arrays) -> dict[str, np.ndarray]:
    """Driver-side arrays of features, by ascending id."""
    columns = columns or wanted(feats)
    t = feats.select("contig_id", *columns).toArrow().combine_chunks().sort_by("contig_id").combine_chunks()
    return row({c: t[c].combine_chunks() for c in columns}) | {"id": t["contig_id"].to_numpy()}


def _rows(column: pa.Array) -> np.ndarray:
    """A column of equally long lists, or of numbers, as an array; no value becomes a Python object."""
    if pa.types.is_list(column.type):
        return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1) if len(column) else np.zeros((0, 0))
    return column.to_numpy(zero_copy_only=False)


def _paired(pairs, feats, columns, row, measured, schema, size, limit, extra):
    """Pairs with ``measured`` of both sides' features, a few thousand pairs at a time; ``row``: arrays from a batch's feature columns."""
    spark = pairs.sparkSession
    own = pairs.select("c1", "c2", *extra)
    names = [c.split()[0] for c in schema.split(", ")]
    schema = ", ".join([schema, *(f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema.fields[2:])])
    pieces = lambda batches: (b.slice(at, PAIRS) for b in batches for at in range(0, b.num_rows, PAIRS))
    both_of = lambda batch, b, at: pa.record_batch([*batch.columns, *(b.column(c).take(at) for c in extra)], [*names, *extra])
    if feats.count() * size <= limit:
        box = spark.sparkContext.broadcast(matrix(feats, columns, row))

        def run(batches):
            m = box.value
            n = len(m["id"])
            for b in pieces(batches) if n else ():
                c1, c2 = b.column(0).to_numpy(), b.column(1).to_numpy()
                i, j = np.minimum(np.searchsorted(m["id"], c1), n - 1), np.minimum(np.searchsorted(m["id"], c2), n - 1)
                ok = (m["id"][i] == c1) & (m["id"][j] == c2)
                i, j = i[ok], j[ok]
                yield both_of(measured(c1[ok], c2[ok], {k: v[i] for k, v in m.items()}, {k: v[j] for k, v in m.items()}), b, pa.array(np.flatnonzero(ok)))

        return own.mapInArrow(run, schema)
    side = lambda c: feats.select(F.col("contig_id").alias(c), *(F.col(x).alias(f"{x}{c[1]}") for x in columns))
    both = own.join(side("c1"), "c1").join(side("c2"), "c2")

    def joined(batches):
        for b in pieces(batches):
            a = [row({x: b.column(f"{x}{k}") for x in columns}) for k in (1, 2)]
            yield both_of(measured(b.column("c1").to_numpy(), b.column("c2").to_numpy(), *a), b, pa.array(np.arange(b.num_rows)))

    return both.mapInArrow(joined, schema)


def correlation_gaps(measured: DataFrame) -> DataFrame:
    """One row: pairs, and those whose correlation is undefined (a side is constant over the samples)."""
    return measured.agg(F.count(F.lit(1)).alias("pairs"), F.count_if(F.col("corr").isNull() | F.isnan("corr")).alias("undefined"))
