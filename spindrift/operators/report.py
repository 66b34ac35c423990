"""Bin sizes, the minimum-size filter, stage summaries, and the constraints of whole-partition models."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def bin_sizes(binning: DataFrame, lengths: DataFrame) -> DataFrame:
    """bin_label, contigs, bp; unknown lengths count as 0."""
    d = binning.join(lengths.select("contig_id", "length"), "contig_id", "left")
    return d.groupBy("bin_label").agg(F.count(F.lit(1)).alias("contigs"), F.sum(F.coalesce("length", F.lit(0))).alias("bp"))


def min_bin_size(binning: DataFrame, lengths: DataFrame, minbp: int = 200_000) -> DataFrame:
    """The binning without bins of fewer than ``minbp`` letters."""
    return binning.join(bin_sizes(binning, lengths).where(F.col("bp") >= minbp).select("bin_label"), "bin_label", "left_semi").select("contig_id", "bin_label")


def stage_summary(before: DataFrame, after: DataFrame, kept: DataFrame | None = None) -> DataFrame:
    """One row: bins and contigs in and out, bins split, bins joined, contigs recruited, and what the size filter keeps."""
    b, a = before.select("contig_id", F.col("bin_label").alias("x")), after.select("contig_id", F.col("bin_label").alias("y"))
    both = b.join(a, "contig_id")
    split = both.groupBy("x").agg(F.countDistinct("y").alias("n")).agg(F.count_if(F.col("n") > 1).alias("bins_split"))
    joined = both.groupBy("y").agg(F.countDistinct("x").alias("n")).agg(F.count_if(F.col("n") > 1).alias("bins_joined"))
    size = lambda d, c, n: d.agg(F.countDistinct(c).alias(f"bins_{n}"), F.countDistinct("contig_id").alias(f"contigs_{n}"))
    k = (after if kept is None else kept).select("contig_id", F.col("bin_label").alias("z"))
    recruited = a.join(b, "contig_id", "left_anti").agg(F.countDistinct("contig_id").alias("recruited"))
    out = size(b, "x", "in")
    for one in (size(a, "y", "out"), split, joined, recruited, size(k, "z", "kept")):
        out = out.crossJoin(one)  # one-row tables
    return out


def bin_size_bounds(binning: DataFrame, lengths: DataFrame, low: int = 200_000, high: int = 20_000_000) -> DataFrame:
    """bin_label, bp, ok."""
    return bin_sizes(binning, lengths).select("bin_label", "bp", F.col("bp").between(low, high).alias("ok"))


def completeness(binning: DataFrame, mg: DataFrame, least: int = 30) -> DataFrame:
    """bin_label, markers (distinct), ok."""
    d = binning.join(mg, "contig_id", "left").groupBy("bin_label").agg(F.countDistinct("marker_id").alias("markers"))
    return d.select("bin_label", "markers", (F.col("markers") >= least).alias("ok"))


def contamination(binning: DataFrame, mg: DataFrame, below: int = 4) -> DataFrame:
    """bin_label, duplicated (markers carried by more than one fragment), ok."""
    d = binning.join(mg, "contig_id").groupBy("bin_label", "marker_id").agg(F.count(F.lit(1)).alias("n")).groupBy("bin_label").agg(F.count_if(F.col("n") > 1).alias("duplicated"))
    d = binning.select("bin_label").distinct().join(d, "bin_label", "left").na.fill(0, ["duplicated"])
    return d.select("bin_label", "duplicated", (F.col("duplicated") < below).alias("ok"))
