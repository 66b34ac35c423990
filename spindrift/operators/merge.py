"""Merging bins: mutual best partners without a dissimilar marker pair between them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spindrift.operators.affinity import both_ways
from spindrift.operators.components import connected_components


def best_partners(binaff: DataFrame) -> DataFrame:
    """b, partner, n: all partners that share a bin's largest count."""
    e = both_ways(binaff, "b1", "b2")
    w = Window.partitionBy("b1").orderBy(F.desc("n"))
    return e.withColumn("_r", F.rank().over(w)).where("_r = 1 and n > 0").select(F.col("b1").alias("b"), F.col("b2").alias("partner"), "n")


def mutual_pairs(binaff: DataFrame) -> DataFrame:
    """b1 < b2 that are each other's best partner, and n."""
    best = best_partners(binaff)
    back = best.select(F.col("partner").alias("b"), F.col("b").alias("partner"))
    return best.join(back, ["b", "partner"]).where("b < partner").select(F.col("b").alias("b1"), F.col("partner").alias("b2"), "n")


def dissimilar_bins(measured: DataFrame, bins: DataFrame, simthresh: int) -> DataFrame:
    """b1 < b2 with a marker-sharing pair across them whose distance reaches the threshold."""
    d = measured.where(F.col("d") >= simthresh)
    d = d.join(bins.select(F.col("contig_id").alias("c1"), F.col("bin_id").alias("x")), "c1").join(bins.select(F.col("contig_id").alias("c2"), F.col("bin_id").alias("y")), "c2").where("x <> y")
    return d.select(F.least("x", "y").alias("b1"), F.greatest("x", "y").alias("b2")).distinct()


def blocked_pairs(mutual: DataFrame, measured: DataFrame, bins: DataFrame, simthresh: int) -> DataFrame:
    return dissimilar_bins(measured, bins, simthresh).join(mutual, ["b1", "b2"], "left_semi")


def unblocked(mutual: DataFrame, blocked: DataFrame, minconn: int = 0) -> DataFrame:
    return mutual.where(F.col("n") >= minconn).join(blocked, ["b1", "b2"], "left_anti")


def merge_pairs(binaff: DataFrame, measured: DataFrame, bins: DataFrame, simthresh: int, minconn: int = 0) -> DataFrame:
    return unblocked(mutual_pairs(binaff), dissimilar_bins(measured, bins, simthresh), minconn)


def components(pairs: DataFrame, bins: DataFrame) -> DataFrame:
    """bin_id, rep: the smallest bin reachable, for every bin."""
    rep = connected_components(pairs, "b1", "b2").select(F.col("node").alias("bin_id"), F.col("component").alias("rep"))
    return bins.select("bin_id").distinct().join(rep, "bin_id", "left").select("bin_id", F.coalesce("rep", "bin_id").alias("rep"))


def merge(binaff: DataFrame, measured: DataFrame, bins: DataFrame, simthresh: int, minconn: int = 0, strict: bool = False) -> DataFrame:
    """contig_id, bin_id after merging. The guard looks at pairs of bins; ``strict`` also undoes components that hold a dissimilar pair."""
    rep = components(merge_pairs(binaff, measured, bins, simthresh, minconn), bins)
    if strict:
        bad = dissimilar_bins(measured, bins, simthresh)
        bad = bad.join(rep.select(F.col("bin_id").alias("b1"), F.col("rep").alias("r1")), "b1").join(rep.select(F.col("bin_id").alias("b2"), F.col("rep").alias("r2")), "b2").where("r1 = r2").select(F.col("r1").alias("rep")).distinct()
        rep = rep.join(bad.withColumn("_bad", F.lit(True)), "rep", "left").select("bin_id", F.when(F.col("_bad"), F.col("bin_id")).otherwise(F.col("rep")).alias("rep"))
    return joined(rep, bins)


def joined(rep: DataFrame, bins: DataFrame) -> DataFrame:
    """contig_id, bin_id: each fragment in the bin that stands for its own."""
    return bins.join(rep, "bin_id").select("contig_id", F.col("rep").alias("bin_id"))
