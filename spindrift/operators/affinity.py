"""Pruned affinity edges: top-k per end, rank mode, anchors, recruits, and bin-to-bin counts."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

TOP = 5
SCALE = 1000
HELD = 1 << 20  # edges that a task holds to leave out those that cannot be among an end's best


def both_ways(edges: DataFrame, a: str = "src", b: str = "dst") -> DataFrame:
    """Every edge in both directions, under the same names."""
    rest = [c for c in edges.columns if c not in (a, b)]
    return edges.select(a, b, *rest).union(edges.select(F.col(b).alias(a), F.col(a).alias(b), *rest))


def weight(score) -> F.Column:
    """round(score * 1000), half to even."""
    return F.rint(score * SCALE).cast("int")


def top_union(edges: DataFrame, names: DataFrame | None = None, top: int = TOP) -> DataFrame:
    """src, dst, score of edges in the ``top`` of either end; ties by (score, first name, second name), largest first.

    ``names`` (contig_id, name) gives the tie order; without it ids stand for names.
    """
    ends = best_ends(edges, top)
    if names is not None:  # only what the scores leave needs names
        ends = ends.withColumn("_r", F.rank().over(Window.partitionBy("end").orderBy(F.desc("score")))).where(F.col("_r") <= top).drop("_r")
        n = names.select("contig_id", "name")
        ends = ends.join(n.select(F.col("contig_id").alias("src"), F.col("name").alias("na")), "src").join(n.select(F.col("contig_id").alias("dst"), F.col("name").alias("nb")), "dst")
    else:
        ends = ends.withColumn("na", F.col("src")).withColumn("nb", F.col("dst"))
    w = Window.partitionBy("end").orderBy(F.desc("score"), F.desc("na"), F.desc("nb"))
    return ends.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= top).select("src", "dst", "score").distinct()


def best_ends(edges: DataFrame, top: int = TOP, held: int = HELD) -> DataFrame:
    """src, dst, score, end: every edge at both its ends, without those that ``top`` others surpass there among the ``held`` edges that a task has at once; most edges go before the shuffle."""

    def run(batches):
        some, n = [], 0
        for b in batches:
            some.append(b)
            n += b.num_rows
            if n >= held:
                yield _best(some, top)
                some, n = [], 0
        if n:
            yield _best(some, top)

    e = edges.select("src", "dst", "score")
    kinds = [f.dataType.simpleString() for f in e.schema]
    return e.mapInArrow(run, f"src {kinds[0]}, dst {kinds[1]}, score {kinds[2]}, end {kinds[0]}")


def _best(batches: list[pa.RecordBatch], top: int) -> pa.RecordBatch:
    t = pa.Table.from_batches(batches).combine_chunks()
    score = t["score"].fill_null(-np.inf).to_numpy()  # as Spark's order has it, no score comes last and no number first
    score = np.tile(np.where(np.isnan(score), np.inf, score), 2)
    end, at = np.concatenate([t["src"].to_numpy(), t["dst"].to_numpy()]), np.tile(np.arange(t.num_rows), 2)
    order = np.lexsort((-score, end))
    first = np.flatnonzero(np.r_[True, np.diff(end[order]) != 0])
    size = np.diff(np.r_[first, len(order)])
    least = score[order][first + np.minimum(top, size) - 1]
    keep = order[score[order] >= np.repeat(least, size)]
    rows = t.take(pa.array(at[keep]))
    return pa.record_batch([*(rows[c].combine_chunks() for c in ("src", "dst", "score")), pa.array(end[keep], t.schema.field("src").type)], ["src", "dst", "score", "end"])


def affinity(edges: DataFrame, names: DataFrame | None = None, top: int = TOP) -> DataFrame:
    """c1 < c2, w >= 1 of the pruned edges."""
    e = top_union(edges, names, top).select(F.least("src", "dst").alias("c1"), F.greatest("src", "dst").alias("c2"), weight(F.col("score")).alias("w"))
    return e.where("w > 0")


def rank_mode(edges: DataFrame, top: int = TOP, scale: int = SCALE) -> DataFrame:
    """c1, c2, w by place in ascending order of score (then ids) instead of the score itself: 1 .. scale.

    The order is total, so places are counted range by range; no task sees all edges.
    """
    e = top_union(edges, None, top)
    e = e.withColumn("_b", F.floor(F.col("score") * 1000))
    sums = e.groupBy("_b").agg(F.count(F.lit(1)).alias("_n"))
    base = F.coalesce(F.sum("_n").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    n = F.sum("_n").over(Window.partitionBy())
    e = e.join(sums.select("_b", base.alias("_base"), n.alias("_all")), "_b")
    i = F.col("_base") + F.row_number().over(Window.partitionBy("_b").orderBy("score", "src", "dst")) - 1
    w = 1 + F.rint(i / F.greatest(F.col("_all") - 1, F.lit(1)) * (scale - 1))
    return e.select(F.least("src", "dst").alias("c1"), F.greatest("src", "dst").alias("c2"), w.cast("int").alias("w"))


def anchors(mg: DataFrame, seed: DataFrame) -> DataFrame:
    """Binned fragments that carry a marker."""
    return seed.join(mg.select("contig_id").distinct(), "contig_id", "left_semi").select("contig_id", "bin_label")


def anchor_affinity(edges: DataFrame, mg: DataFrame, seed: DataFrame, top: int = TOP) -> DataFrame:
    """c, anchor, w: each binned fragment's best anchors in its own bin (ties to the larger anchor id); zero weights go after the cut."""
    s = seed.select("contig_id", "bin_label")
    e = both_ways(edges.select("src", "dst", "score")).select(F.col("src").alias("c"), F.col("dst").alias("anchor"), "score")
    e = e.join(s.select(F.col("contig_id").alias("c"), F.col("bin_label").alias("b")), "c").join(anchors(mg, seed).select(F.col("contig_id").alias("anchor"), F.col("bin_label").alias("b")), ["anchor", "b"])
    w = Window.partitionBy("c").orderBy(F.desc("score"), F.desc("anchor"))
    return e.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= top).select("c", "anchor", weight(F.col("score")).alias("w")).where("w > 0")


def pins(mg: DataFrame, seed: DataFrame) -> DataFrame:
    """bin_label, contig_id: the smallest anchor of each bin, or its smallest fragment."""
    a = anchors(mg, seed).select("contig_id", F.lit(True).alias("a"))
    d = seed.select("contig_id", "bin_label").join(a, "contig_id", "left")
    return d.groupBy("bin_label").agg(F.coalesce(F.min(F.when(F.col("a"), F.col("contig_id"))), F.min("contig_id")).alias("contig_id"))


def recruit_affinity(edges: DataFrame, recruitable: DataFrame, pinned: DataFrame) -> DataFrame:
    """c (recruitable), member (pinned), bin_label, w."""
    e = both_ways(edges.select("src", "dst", "score")).select(F.col("src").alias("contig_id"), F.col("dst").alias("member"), "score")
    e = e.join(recruitable.select("contig_id"), "contig_id", "left_semi").join(pinned.select(F.col("contig_id").alias("member"), "bin_label"), "member")
    return e.select(F.col("contig_id").alias("c"), "member", "bin_label", weight(F.col("score")).alias("w")).where("w > 0")


def bin_affinity(aff: DataFrame, bins: DataFrame) -> DataFrame:
    """b1 < b2, n: pruned edges between two bins; bins (contig_id, bin_id)."""
    e = aff.join(bins.select(F.col("contig_id").alias("c1"), F.col("bin_id").alias("x")), "c1").join(bins.select(F.col("contig_id").alias("c2"), F.col("bin_id").alias("y")), "c2").where("x <> y")
    return e.groupBy(F.least("x", "y").alias("b1"), F.greatest("x", "y").alias("b2")).agg(F.count(F.lit(1)).alias("n"))
