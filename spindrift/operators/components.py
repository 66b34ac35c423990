"""Connected components by contraction: smallest-neighbour hooking with pointer jumping, one written table a round."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrift.plans.stage import written

SMALL = 200_000  # edges that one task joins up


def smallest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of edges a to b, ascending, and the smallest that each can reach."""
    node, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    i, j = at[: len(a)], at[len(a) :]
    to = np.arange(len(node))
    while True:
        before, low = to.copy(), np.minimum(to[i], to[j])
        for x in (i, j):
            np.minimum.at(to, before[x], low)
            np.minimum.at(to, x, low)
        to = to[to]
        if (to == before).all():
            return node, node[to]


def _joined(edges: DataFrame) -> DataFrame:
    """node, to (the smallest reachable) of few edges, in one task."""

    def run(batches):
        t = pa.Table.from_batches(batches)
        yield pa.record_batch([pa.array(x, t.schema.field("a").type) for x in smallest(t["a"].to_numpy(), t["b"].to_numpy())], ["node", "to"])

    kind = edges.schema["a"].dataType.simpleString()
    return edges.select("a", "b").coalesce(1).mapInArrow(run, f"node {kind}, to {kind}")


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", small: int = SMALL) -> DataFrame:
    """node, component (the smallest node reachable) for every node that has an edge to another.

    Each round every node hooks onto its smallest neighbour, hooks are shortened twice, and
    the edges are rewritten to the hooks' ends; nodes vanish from the edges at least by
    halves, so rounds grow with the logarithm of the number of nodes. Only sums and minima
    are grouped, so a hub costs no task more than its share; its joins can be split. What is
    left once at most ``small`` edges remain is joined up by one task.
    """
    e = edges.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).where("a < b").distinct()
    e = written(e, "edges")
    reps = None
    while n := e.count():
        if n <= small:
            hook = _joined(e)
        else:
            both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
            hook = written(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("to")), "hooks")
            for _ in range(2):
                nxt = hook.select(F.col("node").alias("to"), F.col("to").alias("further"))
                hook = hook.join(nxt, "to").select("node", F.col("further").alias("to"))
        hook = written(hook, "hooks")
        if reps is None:
            reps = hook
        else:
            on = hook.select(F.col("node").alias("to"), F.col("to").alias("further"))
            reps = written(reps.join(on, "to", "left").select("node", F.coalesce("further", "to").alias("to")), "reps")
        if n <= small:
            break
        left = hook.select(F.col("node").alias("a"), F.col("to").alias("_a"))
        right = hook.select(F.col("node").alias("b"), F.col("to").alias("_b"))
        e = e.join(left, "a").join(right, "b").select(F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b")).where("a < b").distinct()
        e = written(e, "edges")
    if reps is None:
        return e.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return reps.select("node", F.col("to").alias("component"))
