"""Integrity checks of the inputs: each gives rows that break a rule, or counters with a verdict."""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def duplicate_names(contigs: DataFrame) -> DataFrame:
    return contigs.groupBy("name").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def depth_order_violations(depth: DataFrame, contigs: DataFrame) -> DataFrame:
    """name, ordinal of depth rows that stand after a row of a later fragment; depth (ordinal, name), contigs (contig_id, name).

    The running maximum is taken per range of ordinals first, so no task orders all rows.
    """
    d = depth.join(contigs.select("name", "contig_id"), "name").withColumn("_b", F.floor(F.col("ordinal") / 4096))
    tops = d.groupBy("_b").agg(F.max("contig_id").alias("_m"))
    tops = tops.select("_b", F.max("_m").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)).alias("_before"))
    own = F.max("contig_id").over(Window.partitionBy("_b").orderBy("ordinal", "contig_id").rowsBetween(Window.unboundedPreceding, -1))
    d = d.withColumn("_in", own).join(tops, "_b")
    return d.where(F.greatest("_in", "_before") > F.col("contig_id")).select("name", "ordinal")


def ragged_depth(lines: DataFrame, with_variance: bool = True) -> DataFrame:
    """name, width of depth rows (ordinal, name, f: all fields) whose width is not the most common one, or has no whole samples, or whose values are no numbers in range."""
    step = 2 if with_variance else 1
    widths = lines.groupBy(F.size("f").alias("width")).count()
    usual = widths.agg(F.max(F.struct("count", "width")).alias("top")).select(F.col("top.width").alias("usual"))
    values = F.slice("f", 4, F.greatest(F.size("f") - 3, F.lit(0)))
    number = lambda x: F.coalesce(x.try_cast("double"), F.lit(-1.0))
    bad = F.exists(values, lambda x: (number(x) < 0) | F.isnan(number(x)))
    d = lines.crossJoin(F.broadcast(usual))  # one row
    return d.where((F.size("f") != F.col("usual")) | (F.size("f") < 3 + step) | ((F.size("f") - 3) % step != 0) | bad).select("name", F.size("f").alias("width"))


def order_of(lines: DataFrame, order: DataFrame) -> DataFrame:
    """depth_order_violations() of depth rows (ordinal, name) against the assembly's records (ordinal, name)."""
    return depth_order_violations(lines.select("ordinal", "name"), order.select("name", F.col("ordinal").alias("contig_id")))


def missing_depth(depth: DataFrame, contigs: DataFrame) -> DataFrame:
    return contigs.join(depth.select("name").distinct(), "name", "left_anti").select("name")


def seed_conflicts(seed: DataFrame) -> DataFrame:
    """Names that stand in more than one bin."""
    return seed.groupBy("name").agg(F.countDistinct("bin_label").alias("bins")).where("bins > 1")


def match_counts(rows: DataFrame, contigs: DataFrame) -> DataFrame:
    """One row: names read, matched, unmatched, and ok / warn / fail."""
    d = rows.select("name").distinct().join(contigs.select("name", F.lit(1).alias("m")), "name", "left").agg(F.count(F.lit(1)).alias("names"), F.count("m").alias("matched"))
    status = F.when(F.col("matched") == 0, "fail").when(F.col("names") - F.col("matched") > F.col("names") / 2, "warn").otherwise("ok")
    return d.select("names", "matched", (F.col("names") - F.col("matched")).alias("unmatched"), status.alias("status"))


def verdict(counts: DataFrame, what: str) -> str:
    """ok or warn (which is logged); an error if nothing was read or nothing matched."""
    row = counts.first()
    if row.status == "fail":
        raise ValueError(f"{what}: {'none read' if not row.names else f'none of {row.names} names is in the assembly'}")
    if row.status == "warn":
        logging.getLogger(__name__).warning("%s: %d of %d names are not in the assembly", what, row.unmatched, row.names)
    return row.status


def require(rows: DataFrame, message: str) -> None:
    """An error if the check found a row."""
    bad = rows.limit(5).collect()
    if bad:
        raise ValueError(f"{message}: {[tuple(r) for r in bad]}")


def not_fewer(before: DataFrame, after: DataFrame, stage: str) -> None:
    """A stage may not lose fragments."""
    n, m = before.count(), after.count()
    if m < n:
        raise ValueError(f"{stage} lost contigs: {n} in, {m} out")
