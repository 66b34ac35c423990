"""Recruiting unbinned fragments: best feasible bin each, exact search where two of them exclude each other."""

from __future__ import annotations

from collections import defaultdict

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spindrift.operators import bounds
from spindrift.operators.components import connected_components
from spindrift.plans.stage import spread, written

NODES = 200_000


def candidates(aff: DataFrame, minaff: int = 0) -> DataFrame:
    """c, bin_id, w: summed affinity to pinned members (columns c, bin_id, w)."""
    return aff.groupBy("c", "bin_id").agg(F.sum("w").alias("w")).where(F.col("w") >= minaff)


def dissimilar(guard: DataFrame, simthresh: int) -> DataFrame:
    return guard.where(F.col("d") >= simthresh).select("c1", "c2")


def blocked(guard: DataFrame, pinned: DataFrame, simthresh: int) -> DataFrame:
    """c, bin_id: a pinned member of the bin is dissimilar to c."""
    d = dissimilar(guard, simthresh)
    return d.join(pinned.select(F.col("contig_id").alias("c2"), "bin_id"), "c2").select(F.col("c1").alias("c"), "bin_id").distinct()


def feasible(cand: DataFrame, guard: DataFrame, pinned: DataFrame, simthresh: int) -> DataFrame:
    return cand.join(blocked(guard, pinned, simthresh), ["c", "bin_id"], "left_anti")


def argmax(cand: DataFrame) -> DataFrame:
    """c, bin_id, w of each fragment's best bin (ties to the smaller bin id), conflicts among recruits aside."""
    w = Window.partitionBy("c").orderBy(F.desc("w"), "bin_id")
    return cand.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def rivals(cand: DataFrame, guard: DataFrame, simthresh: int) -> DataFrame:
    """a < b: two recruitable fragments that exclude each other and share a candidate bin."""
    bins = cand.groupBy("c").agg(F.collect_set("bin_id").alias("bins"))
    side = lambda c: bins.select(F.col("c").alias(c), F.col("bins").alias(f"b{c}"))
    d = dissimilar(guard, simthresh).join(side("c2"), "c2").join(side("c1"), "c1").where(F.arrays_overlap("bc1", "bc2"))
    return d.select(F.least("c1", "c2").alias("a"), F.greatest("c1", "c2").alias("b")).distinct()


def best_assignment(options: dict[int, list[tuple[int, int]]], conflicts: list[tuple[int, int]], nodes: int = NODES) -> tuple[dict[int, int], str]:
    """Bins of the fragments of one conflict component, at most one each, of largest summed weight; options: fragment -> [(bin, w)].

    The first descent, greedy and always feasible, is outside the budget: ``nodes`` bound its improvement.
    """
    near = defaultdict(set)
    for a, b in conflicts:
        near[a].add(b)
        near[b].add(a)
    order = sorted(options, key=lambda c: (-len(near[c]), -max((w for _, w in options[c]), default=0), c))
    ranked = {c: sorted(options[c], key=lambda o: (-o[1], o[0])) for c in options}
    hope = [0] * (len(order) + 1)
    for i in range(len(order) - 1, -1, -1):
        hope[i] = hope[i + 1] + max((w for _, w in options[order[i]]), default=0)
    best, state, taken = [-1, {}], [nodes], {}
    stack = [(0, 0, iter([*ranked[order[0]], (None, 0)]))] if order else []
    while stack:
        i, score, choices = stack[-1]
        taken.pop(order[i], None)
        step = next(choices, None)
        if step is None or (state[0] <= 0 and best[0] >= 0):
            stack.pop()
            continue
        state[0] -= best[0] >= 0
        b, w = step
        if score + w + hope[i + 1] <= best[0]:
            continue
        if b is not None:
            if any(taken.get(m) == b for m in near[order[i]]):
                continue
            taken[order[i]] = b
        if i + 1 == len(order):
            best = [score + w, dict(taken)]
        else:
            stack.append((i + 1, score + w, iter([*ranked[order[i + 1]], (None, 0)])))
    return best[1], "optimal" if state[0] > 0 else "time limit"


def recruit(aff: DataFrame, guard: DataFrame, pinned: DataFrame, simthresh: int, minaff: int = 0, nodes: int = NODES, rounds: int = bounds.ROUNDS) -> DataFrame:
    """contig_id, bin_id, status, gap of the recruited fragments. Only fragments in a conflict reach the search.

    ``gap`` is how much more weight the fragment's component could reach at most: 0 where the
    status is optimal, else by the bound of ``rounds`` rounds.
    """
    cand = written(feasible(candidates(aff, minaff), guard, pinned, simthresh), "candidates")
    pairs = written(rivals(cand, guard, simthresh), "rivals")
    groups = written(connected_components(pairs, "a", "b"), "rival-groups").select(F.col("node").alias("c"), "component")
    calm = argmax(cand.join(groups, "c", "left_anti")).select(F.col("c").alias("contig_id"), "bin_id", F.lit("optimal").alias("status"), F.lit(0).cast("long").alias("gap"))
    own = written(cand.join(groups, "c").select("component", "c", "bin_id", F.col("w").cast("long").alias("w")), "rival-candidates")
    among = pairs.join(groups.withColumnRenamed("c", "a"), "a").select("component", "a", "b")
    facts = own.withColumn("rival", F.lit(None).cast("long")).union(among.select("component", F.col("a").alias("c"), F.lit(None).cast("long"), F.lit(0).cast("long"), F.col("b").alias("rival")))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        options = defaultdict(list)
        for c, b, w in pdf[pdf["rival"].isna()][["c", "bin_id", "w"]].itertuples(index=False):
            options[int(c)].append((int(b), int(w)))
        conflicts = [(int(a), int(b)) for a, b in pdf[pdf["rival"].notna()][["c", "rival"]].itertuples(index=False)]
        got, status = best_assignment(dict(options), conflicts, nodes)
        return pd.DataFrame({"component": pdf["component"].iloc[0], "contig_id": list(got), "bin_id": list(got.values()), "status": status}).astype({"contig_id": "int64", "bin_id": "int64", "status": "object"})

    searched = written(spread(facts, "component").groupBy("component").applyInPandas(run, "component long, contig_id long, bin_id long, status string"), "recruit-searched")
    late = searched.where("status <> 'optimal'")
    gap = searched.select("component", F.lit(0).cast("long").alias("gap")).distinct()
    if late.limit(1).count():
        some = late.select("component").distinct()
        value = own.withColumnRenamed("c", "contig_id").join(late, ["component", "contig_id", "bin_id"]).groupBy("component").agg(F.sum("w").alias("value"))
        bound = bounds.recruit_bound(own.join(some, "component", "left_semi"), among.join(some, "component", "left_semi"), value, rounds)
        late_gap = written(bound.join(value, "component").select("component", (F.col("bound") - F.col("value")).alias("late")), "recruit-gaps")
        gap = gap.join(late_gap, "component", "left").select("component", F.coalesce("late", "gap").alias("gap"))
    return calm.unionByName(searched.join(gap, "component").select("contig_id", "bin_id", "status", "gap"))
