"""Upper bounds for components whose search has reached its budget, as rounds of DataFrame steps.

A component of many facts is never one task here: they stay spread, and each round is joins,
sums and one written table. Both bounds hold after any number of rounds; more rounds tighten them.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrift.plans.stage import spread, written

ROUNDS = 12
SMALL = 200_000  # rows of a component's cycles that one task packs
PRICED = 1_000_000  # candidates and rows of a component that one task prices, at about 100 bytes each


def recruit_bound(cand: DataFrame, rivals: DataFrame, values: DataFrame, rounds: int = ROUNDS, small: int = PRICED) -> DataFrame:
    """component, bound: no assignment of the component's fragments weighs more.

    ``cand``: component, c, bin_id, w. ``rivals``: component, a, b, which may not share a bin.
    ``values``: component, value of an assignment that is known. Lagrangian dual of the rows
    x(a, bin) + x(b, bin) <= 1: with a price on each row every fragment takes its best bin by
    itself, and what they reach plus all prices bounds any assignment; prices of rows that are
    overdrawn rise, others fall, in steps by the gap to the known value. Components of at most
    ``small`` candidates and rows go through their rounds in one task each.
    """
    side = lambda c: cand.select("component", F.col("c").alias(c), "bin_id")
    rows = rivals.select("component", "a", "b").distinct().join(side("a"), ["component", "a"]).join(side("b"), ["component", "b", "bin_id"])
    rows = written(rows.select("component", "a", "b", "bin_id"), "bound-rows")
    cand = written(cand.select("component", "c", "bin_id", F.col("w").cast("double").alias("w")), "bound-candidates")
    facts = cand.select("component", "c", F.lit(None).cast("long").alias("b"), "bin_id", "w").union(rows.select("component", "a", "b", "bin_id", F.lit(0.0)))
    sizes = written(facts.groupBy("component").count(), "bound-sizes")
    got = _priced_whole(facts.join(sizes.where(F.col("count") <= small), "component", "left_semi").join(values, "component"), rounds)
    large = sizes.where(F.col("count") > small).select("component")
    if large.limit(1).count():
        mine = lambda d: d.join(large, "component", "left_semi")
        got = got.union(_priced_in_rounds(mine(cand), mine(rows), mine(values), rounds))
    return got


def priced(group: np.ndarray, w: np.ndarray, a: np.ndarray, b: np.ndarray, value: float, rounds: int) -> float:
    """The least dual of some rounds; candidates by fragment (``group``, ascending from 0) and bin, ``a`` and ``b`` the two that a row lets only one of take part."""
    price, bound, first = np.zeros(len(a)), np.inf, np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    for k in range(rounds + 1):
        r = w - np.bincount(a, price, len(w)) - np.bincount(b, price, len(w))
        best = np.maximum.reduceat(r, first)
        dual = np.maximum(best, 0).sum() + price.sum()
        bound = min(bound, dual)
        if k == rounds:
            return bound
        at = np.minimum.reduceat(np.where(r == best[group], np.arange(len(r)), len(r)), first)  # ties to the smaller bin
        taken = np.zeros(len(r), np.int64)
        taken[at[best > 0]] = 1
        g = taken[a] + taken[b] - 1
        g[(g < 0) & (price <= 0)] = 0
        n = (g * g).sum()
        price = np.maximum(0.0, price + ((dual - value) / n if n else 0.0) * g)


def _priced_whole(facts: DataFrame, rounds: int) -> DataFrame:
    """component, bound of components whose candidates and rows (with b) one task holds."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        own = pdf[pdf["b"].isna()].sort_values(["c", "bin_id"])
        rows = pdf[pdf["b"].notna()]
        (c, group), bins = np.unique(own["c"].to_numpy(), return_inverse=True), np.unique(own["bin_id"].to_numpy())
        key = lambda x, b: np.searchsorted(c, x.to_numpy().astype(np.int64)) * len(bins) + np.searchsorted(bins, b.to_numpy())
        at = key(own["c"], own["bin_id"])
        find = lambda x: np.searchsorted(at, key(rows[x], rows["bin_id"]))
        dual = priced(group, own["w"].to_numpy(), find("c"), find("b"), float(pdf["value"].iloc[0]), rounds)
        return pd.DataFrame({"component": [pdf["component"].iloc[0]], "bound": [int(np.floor(dual + 1e-6))]})

    kind = facts.schema["component"].dataType.simpleString()
    return spread(facts, "component").groupBy("component").applyInPandas(run, f"component {kind}, bound long")


def _priced_in_rounds(cand: DataFrame, rows: DataFrame, values: DataFrame, rounds: int) -> DataFrame:
    """component, bound of components whose candidates and rows stay spread."""
    price = written(rows.withColumn("price", F.lit(0.0)), "prices")
    bound = None
    for k in range(rounds + 1):
        load = price.select("component", F.col("a").alias("c"), "bin_id", "price").union(price.select("component", "b", "bin_id", "price")).groupBy("component", "c", "bin_id").agg(F.sum("price").alias("load"))
        left = cand.join(load, ["component", "c", "bin_id"], "left").withColumn("r", F.col("w") - F.coalesce("load", F.lit(0.0)))
        taken = left.groupBy("component", "c").agg(F.max(F.struct("r", (-F.col("bin_id")).alias("n"))).alias("m")).select("component", "c", F.greatest(F.lit(0.0), F.col("m.r")).alias("r"), F.when(F.col("m.r") > 0, -F.col("m.n")).alias("x"))
        taken = written(taken, "bound-taken")
        dual = taken.groupBy("component").agg(F.sum("r").alias("r")).join(price.groupBy("component").agg(F.sum("price").alias("p")), "component", "left").select("component", (F.col("r") + F.coalesce("p", F.lit(0.0))).alias("dual"))
        bound = dual if bound is None else bound.join(dual.withColumnRenamed("dual", "now"), "component").select("component", F.least("dual", "now").alias("dual"))
        bound = written(bound, "bound-dual")
        if k == rounds:
            break
        who = lambda c: taken.select("component", F.col("c").alias(c), F.col("x").alias(f"x{c}"))
        over = price.join(who("a"), ["component", "a"]).join(who("b"), ["component", "b"])
        g = F.coalesce((F.col("xa") == F.col("bin_id")).cast("int"), F.lit(0)) + F.coalesce((F.col("xb") == F.col("bin_id")).cast("int"), F.lit(0)) - 1
        over = over.withColumn("g", F.when((g < 0) & (F.col("price") <= 0), 0).otherwise(g))
        size = over.groupBy("component").agg(F.sum(F.col("g") * F.col("g")).alias("n"))
        step = dual.join(values, "component").join(size, "component").select("component", F.when(F.col("n") > 0, (F.col("dual") - F.col("value")) / F.col("n")).otherwise(0.0).alias("step"))
        price = written(over.join(step, "component").select("component", "a", "b", "bin_id", F.greatest(F.lit(0.0), F.col("price") + F.col("step") * F.col("g")).alias("price")), "prices")
    return bound.select("component", F.floor(F.col("dual") + 1e-6).cast("long").alias("bound"))


def packed(cycle: np.ndarray, edge: np.ndarray, weight: np.ndarray, rounds: int) -> np.ndarray:
    """What is left of the ``weight`` of each edge after some rounds; a row is an edge of a cycle, both numbered from 0."""
    left, size = weight.copy(), np.bincount(cycle)
    for _ in range(rounds):
        live = left[edge] > 1e-9
        live &= (np.bincount(cycle[live], minlength=len(size)) == size)[cycle]
        c, e = cycle[live], edge[live]
        got = np.full(len(size), np.inf)
        np.minimum.at(got, c, left[e] / np.bincount(e, minlength=len(left))[e])
        left = np.maximum(0.0, left - np.bincount(e, got[c], len(left)))
    return left


def _packed_whole(parts: DataFrame, left: DataFrame, rounds: int) -> DataFrame:
    """component, packed of components whose cycles one task holds."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        cycle = pdf.groupby(["p", "q", "f"], dropna=False).ngroup().to_numpy()
        edge = pdf.groupby(["bad", "a", "b"]).ngroup().to_numpy()
        weight, bad = np.zeros(edge.max() + 1), np.zeros(edge.max() + 1, bool)
        weight[edge], bad[edge] = pdf["w"].fillna(0.0), pdf["bad"]
        return pd.DataFrame({"component": [pdf["component"].iloc[0]], "packed": [float((weight - packed(cycle, edge, weight, rounds))[bad].sum())]})

    kind = parts.schema["component"].dataType.simpleString()
    return spread(parts.join(left, ["component", "bad", "a", "b"], "left"), "component").groupBy("component").applyInPandas(run, f"component {kind}, packed double")


def separate_bound(affinity: DataFrame, penalty: DataFrame, rounds: int = ROUNDS, small: int = SMALL) -> DataFrame:
    """component, bound: no slots of the component's fragments keep more affinity less penalty.

    ``affinity`` and ``penalty``: component, a, b, w, either order. Two fragments that exclude
    each other and are held together, directly or through a third, lose something in any
    slots: the penalty, or one of the holding weights. Such cycles are packed: each round
    every pair splits what it has left evenly among its cycles, and a cycle takes the least
    it is offered. All affinity, less what is packed, bounds any slots. Components whose cycles
    have at most ``small`` rows go through their rounds in one task each.
    """
    pairs = lambda d: d.groupBy("component", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.sum("w").cast("double").alias("w"))
    aff, pen = written(pairs(affinity), "bound-affinity"), pairs(penalty)
    ends = aff.select("component", F.col("a").alias("u"), F.col("b").alias("f")).union(aff.select("component", "b", "a"))
    third = pen.select("component", F.col("a").alias("p"), F.col("b").alias("q")).join(ends.withColumnRenamed("u", "p"), ["component", "p"]).join(ends.withColumnRenamed("u", "q"), ["component", "q", "f"])
    direct = pen.join(aff, ["component", "a", "b"], "left_semi").select("component", F.col("a").alias("p"), F.col("b").alias("q"), F.lit(None).cast("long").alias("f"))
    cycles = third.select("component", "p", "q", "f").union(direct).withColumn("cycle", F.xxhash64("component", "p", "q", "f"))
    way = lambda x, y: F.struct(F.lit(False).alias("bad"), F.least(x, y).alias("a"), F.greatest(x, y).alias("b"))
    held = F.when(F.col("f").isNull(), F.array(way("p", "q"))).otherwise(F.array(way("p", "f"), way("q", "f")))
    parts = F.concat(held, F.array(F.struct(F.lit(True).alias("bad"), F.col("p").alias("a"), F.col("q").alias("b"))))
    parts = written(cycles.select("component", "p", "q", "f", F.explode(parts).alias("e")).select("component", "p", "q", "f", "e.*"), "bound-cycles")
    left = written(aff.withColumn("bad", F.lit(False)).unionByName(pen.withColumn("bad", F.lit(True))), "bound-left")
    sizes = written(parts.groupBy("component").count(), "bound-sizes")
    got = _packed_whole(parts.join(sizes.where(F.col("count") <= small), "component", "left_semi"), left, rounds)
    large = sizes.where(F.col("count") > small).select("component")
    if large.limit(1).count():
        mine = lambda d: d.join(large, "component", "left_semi")
        got = got.union(_packed_in_rounds(mine(pen), mine(parts), mine(left), rounds))
    whole = aff.groupBy("component").agg(F.sum("w").alias("whole"))
    return whole.join(got, "component", "left").select("component", F.floor(F.col("whole") - F.coalesce("packed", F.lit(0.0)) + 1e-6).cast("long").alias("bound"))


def _packed_in_rounds(pen: DataFrame, parts: DataFrame, left: DataFrame, rounds: int) -> DataFrame:
    """component, packed of components whose cycles stay spread."""
    edge, cycle = ["component", "bad", "a", "b"], ["component", "p", "q", "f"]
    for _ in range(rounds):
        live = parts.join(left.where("w > 1e-9"), edge)
        closed = live.groupBy(*cycle).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == F.when(F.col("f").isNull(), 2).otherwise(3)).drop("n")
        same = [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in cycle]
        live = live.alias("l").join(closed.alias("r"), same, "left_semi").select("l.*")
        live = live.join(live.groupBy(*edge).agg(F.count(F.lit(1)).alias("n")), edge).withColumn("offer", F.col("w") / F.col("n"))
        got = live.groupBy(*cycle).agg(F.min("offer").alias("got"))
        used = live.alias("l").join(got.alias("r"), same).select(*(F.col(f"l.{c}").alias(c) for c in edge), "got").groupBy(*edge).agg(F.sum("got").alias("used"))
        left = written(left.join(used, edge, "left").select(*edge, F.greatest(F.lit(0.0), F.col("w") - F.coalesce("used", F.lit(0.0))).alias("w")), "bound-left")
    return pen.withColumnRenamed("w", "w0").join(left.where("bad"), ["component", "a", "b"]).groupBy("component").agg(F.sum(F.col("w0") - F.col("w")).alias("packed"))
