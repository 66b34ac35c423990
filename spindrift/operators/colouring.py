"""Greedy colouring of conflict graphs, by falling degree and then id.

A bin of at most SMALL conflicts is coloured in one task. A larger one is coloured in rounds
of DataFrame steps: a node whose earlier neighbours all have a colour takes the smallest that
none of them has, which is the colour that the one-by-one order would give it. Sparse bins
need few such rounds. Dense ones need many, as a clique frees one node a round; where a round
has coloured fewer than CHUNK nodes of a bin, the bin's CHUNK earliest open nodes are coloured
by one task, from their conflicts among each other and the colours around them.
"""

from __future__ import annotations

from collections import defaultdict

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spindrift.plans.stage import spread, written

SMALL = 200_000
CHUNK = 512


def greedy(order: list, near: dict, taken: dict | None = None) -> dict:
    """Colours from 0 of the nodes of ``order``, one by one; ``taken``: colours that a node can't have."""
    colour: dict = {}
    for node in order:
        out = {colour[m] for m in near[node] if m in colour} | set((taken or {}).get(node, ()))
        colour[node] = next(c for c in range(len(out) + 1) if c not in out)
    return colour


def colours(edges: list[tuple[int, int]]) -> dict[int, int]:
    """Every node's colour."""
    near = defaultdict(set)
    for a, b in edges:
        near[a].add(b)
        near[b].add(a)
    return greedy(sorted(near, key=lambda n: (-len(near[n]), n)), near)


def colouring(conflicts: DataFrame, small: int = SMALL, chunk: int = CHUNK) -> DataFrame:
    """bin_id, node, colour (from 0) of every node of ``conflicts`` (bin_id, c1, c2)."""
    edges = written(conflicts.select("bin_id", F.least("c1", "c2").alias("c1"), F.greatest("c1", "c2").alias("c2")).where("c1 < c2").distinct(), "conflict-edges")
    sizes = edges.groupBy("bin_id").count()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        got = colours(list(zip(pdf["c1"].tolist(), pdf["c2"].tolist())))
        return pd.DataFrame({"bin_id": pdf["bin_id"].iloc[0], "node": list(got), "colour": list(got.values())})

    kind = "bin_id long, node long, colour int"
    few = spread(edges.join(sizes.where(F.col("count") <= small).select("bin_id"), "bin_id", "left_semi"), "bin_id").groupBy("bin_id").applyInPandas(run, kind)
    large = sizes.where(F.col("count") > small).select("bin_id")
    if not large.limit(1).count():
        return few
    return few.unionByName(_rounds(edges.join(large, "bin_id", "left_semi"), chunk))


def _rounds(edges: DataFrame, chunk: int) -> DataFrame:
    ends = edges.select("bin_id", F.col("c1").alias("node"), F.col("c2").alias("other")).union(edges.select("bin_id", "c2", "c1"))
    degree = ends.groupBy("bin_id", "node").agg(F.count(F.lit(1)).alias("degree"))
    other = degree.select("bin_id", F.col("node").alias("other"), F.col("degree").alias("od"))
    earlier = (F.col("od") > F.col("degree")) | ((F.col("od") == F.col("degree")) & (F.col("other") < F.col("node")))
    arcs = written(ends.join(degree, ["bin_id", "node"]).join(other, ["bin_id", "other"]).where(earlier).select("bin_id", "node", "other"), "conflict-arcs")
    state = written(degree.withColumn("colour", F.lit(None).cast("int")), "colours")
    least = F.array_min(F.array_except(F.sequence(F.lit(0), F.size("taken")), F.col("taken")))
    while True:
        open_ = state.where("colour is null").drop("colour")
        seen = arcs.join(open_.select("bin_id", "node"), ["bin_id", "node"], "left_semi").join(state.select("bin_id", F.col("node").alias("other"), F.col("colour").alias("oc")), ["bin_id", "other"])
        around = seen.groupBy("bin_id", "node").agg(F.count_if(F.col("oc").isNull()).alias("waits"), F.collect_set("oc").alias("taken"))
        now = open_.join(around, ["bin_id", "node"], "left").withColumns({"waits": F.coalesce("waits", F.lit(0)), "taken": F.coalesce("taken", F.array().cast("array<int>"))})
        now = written(now.withColumn("colour", F.when(F.col("waits") == 0, least)), "colours-round")
        slow = now.groupBy("bin_id").agg(F.count("colour").alias("n"), F.count(F.lit(1)).alias("all")).where((F.col("n") < chunk) & (F.col("n") < F.col("all"))).select("bin_id")
        by = Window.partitionBy("bin_id").orderBy(F.desc("degree"), "node")
        first = now.where("colour is null").join(slow, "bin_id", "left_semi").withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= chunk)
        first = written(first.select("bin_id", "node", "rank", "taken"), "colours-chunk")
        # what this round has coloured lies around the chunk, too
        fresh = now.where("colour is not null").select("bin_id", F.col("node").alias("other"), F.col("colour").alias("oc"))
        near = arcs.join(first.select("bin_id", "node", "rank"), ["bin_id", "node"])
        inner = near.join(first.select("bin_id", F.col("node").alias("other")), ["bin_id", "other"]).groupBy("bin_id", "node").agg(F.collect_list("other").alias("near"))
        outer = near.join(fresh, ["bin_id", "other"]).groupBy("bin_id", "node").agg(F.collect_set("oc").alias("more"))
        facts = first.join(inner, ["bin_id", "node"], "left").join(outer, ["bin_id", "node"], "left")

        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("rank")
            lists = lambda c: {n: [] if v is None else list(v) for n, v in zip(pdf["node"], pdf[c])}
            taken, more = lists("taken"), lists("more")
            got = greedy(pdf["node"].tolist(), lists("near"), {n: [*taken[n], *more[n]] for n in taken})
            return pd.DataFrame({"bin_id": pdf["bin_id"].iloc[0], "node": list(got), "chunk": list(got.values())})

        dense = facts.groupBy("bin_id").applyInPandas(run, "bin_id long, node long, chunk int")
        found = now.select("bin_id", "node", F.col("colour").alias("now")).join(dense, ["bin_id", "node"], "left").select("bin_id", "node", F.coalesce("now", "chunk").alias("now"))
        state = written(state.join(found, ["bin_id", "node"], "left").select("bin_id", "node", "degree", F.coalesce("colour", "now").alias("colour")), "colours")
        if not state.where("colour is null").limit(1).count():
            return state.select("bin_id", "node", "colour")
