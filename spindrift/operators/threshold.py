"""The dissimilarity threshold that separates same-bin from cross-bin pairs best."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spindrift.plans.stage import written

HIGHEST = 200
FALLBACK = 50


def curve(same: DataFrame, cross: DataFrame) -> DataFrame:
    """t from 0 to 200 and err: same-bin pairs at or above t plus cross-bin pairs below it."""
    return _curve(_histogram(same, cross))


def _histogram(same: DataFrame, cross: DataFrame) -> DataFrame:
    return same.select("d", F.lit(1).alias("s"), F.lit(0).alias("c")).union(cross.select("d", F.lit(0).alias("s"), F.lit(1).alias("c"))).groupBy("d").agg(F.sum("s").alias("s"), F.sum("c").alias("c"))


def _curve(h: DataFrame) -> DataFrame:
    h = h.sparkSession.range(HIGHEST + 1).select(F.col("id").cast("int").alias("t")).join(F.broadcast(h.withColumnRenamed("d", "t")), "t", "left").na.fill(0)
    up, down = Window.orderBy("t").rowsBetween(0, Window.unboundedFollowing), Window.orderBy("t").rowsBetween(Window.unboundedPreceding, -1)
    return h.select("t", (F.sum("s").over(up) + F.coalesce(F.sum("c").over(down), F.lit(0))).alias("err"))


def derive(same: DataFrame, cross: DataFrame) -> DataFrame:
    """One row: simthresh (lowest t of least error), err, derived; the fallback where one side has no pair. A distance above 200 is an error."""
    h = written(_histogram(same, cross), "distances")  # pairs are measured once; a row a distance is left
    d = _curve(h).agg(F.min(F.struct("err", "t")).alias("b")).crossJoin(h.agg(F.sum("s").alias("ns"), F.sum("c").alias("nc"), F.max("d").alias("most")))  # two one-row tables
    off = F.coalesce("most", F.lit(0)) > HIGHEST
    known = (F.coalesce("ns", F.lit(0)) > 0) & (F.coalesce("nc", F.lit(0)) > 0)
    t = F.when(off, F.raise_error(F.lit("a distance lies above 200")).cast("int")).when(known, F.col("b.t")).otherwise(F.lit(FALLBACK))
    return d.select(t.alias("simthresh"), F.when(known, F.col("b.err")).alias("err"), known.alias("derived"))


def upper_median(values: DataFrame, column: str) -> DataFrame:
    """The upper middle element, counted over the histogram of values."""
    h = values.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    run, total = F.sum("n").over(Window.orderBy(column)), F.sum("n").over(Window.partitionBy())
    return h.select(column, run.alias("run"), total.alias("total")).where(F.col("run") > F.floor(F.col("total") / 2)).agg(F.min(column).alias("median"))
