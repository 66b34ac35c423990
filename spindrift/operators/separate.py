"""Splitting bins: an exact, budgeted search per conflict component of a bin's anchors.

Edges and penalties stay inside a seed bin, and all penalties lie between anchors, so bins
are independent, a non-anchor follows its anchors, and anchors without a penalty in their
component stay in slot 1. What is left is grouped by bin and component and searched there.
A component that reaches its budget gets an upper bound of what any slots could reach.
"""

from __future__ import annotations

from collections import defaultdict

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrift.operators import bounds
from spindrift.operators.colouring import SMALL, colouring
from spindrift.operators.components import connected_components
from spindrift.plans.stage import spread, written

NODES = 200_000


def cannot_link(within: DataFrame, seed: DataFrame, simthresh: int) -> DataFrame:
    """bin_id, c1, c2, d of same-bin marker pairs at or above the threshold."""
    s = seed.select("contig_id", "bin_id")
    d = within.where(F.col("d") >= simthresh)
    return d.join(s.select(F.col("contig_id").alias("c1"), "bin_id"), "c1").join(s.select(F.col("contig_id").alias("c2"), "bin_id"), ["c2", "bin_id"]).select("bin_id", "c1", "c2", "d")


def budgets(conflicts: DataFrame, cap: int = 0, small: int = SMALL) -> DataFrame:
    """bin_id, k of bins that may need more than one slot: the colours of a greedy colouring, an upper bound of the slots that conflicts can need."""
    k = F.max("colour") + 1
    return colouring(conflicts, small).groupBy("bin_id").agg((F.least(k, F.lit(cap)) if cap else k).cast("int").alias("k")).where("k >= 2")


def budget_histogram(k: DataFrame) -> DataFrame:
    """k, bins: how many bins have each budget."""
    return k.groupBy("k").agg(F.count(F.lit(1)).alias("bins"))


def search(contigs: list[int], affinity: dict[tuple[int, int], int], penalty: dict[tuple[int, int], int], k: int, pin: int | None, nodes: int = NODES) -> tuple[dict[int, int], str]:
    """Slots 1..k for the fragments of one bin, or a part of it: largest affinity less penalty, then fewest outside slot 1; ``pin`` has slot 1."""
    anchors = {a for _, a in affinity} | {c for p in penalty for c in p} | ({pin} if pin is not None else set())
    # components over affinity among anchors and penalties; fragments that are no anchors join their anchors
    root = {c: c for c in contigs}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in [*affinity, *penalty]:
        root[find(a)] = find(b)
    parts = defaultdict(list)
    for c in sorted(contigs):
        parts[find(c)].append(c)
    slots, status = {}, "optimal"
    for part in parts.values():
        inside = set(part)
        pen = {p: w for p, w in penalty.items() if p[0] in inside}
        if k < 2 or not pen:
            slots.update(dict.fromkeys(part, 1))
            continue
        aff = {p: w for p, w in affinity.items() if p[0] in inside}
        best, state = _component(part, anchors, aff, pen, k, pin if pin in inside else None, nodes)
        slots.update(best)
        if state != "optimal":
            status = state
    return slots, status


def _component(part, anchors, aff, pen, k, pin, nodes):
    order_weight = defaultdict(int)
    mutual = defaultdict(int)  # both directions between anchors add up
    followers = defaultdict(dict)
    for (c, a), w in aff.items():
        if c in anchors:
            mutual[(min(c, a), max(c, a))] += w
        else:
            followers[c][a] = w
        order_weight[a] += w
    for (a, b), w in pen.items():
        order_weight[a] += w
        order_weight[b] += w
    nodes_in = [c for c in part if c in anchors]
    order = sorted(nodes_in, key=lambda c: (c != pin, -order_weight[c], c))
    at = {c: i for i, c in enumerate(order)}
    gain = [[] for _ in order]  # links to anchors placed before
    for pairs, sign in ((mutual, 1), (pen, -1)):
        for (a, b), w in pairs.items():
            i, j = sorted((at[a], at[b]))
            gain[j].append((i, sign * w))
    # a follower's best slot is known once the last of its anchors is placed
    due = [[] for _ in order]
    for c, links in followers.items():
        due[max(at[a] for a in links)].append(([(at[a], w) for a, w in links.items()], c))
    hope = [0] * (len(order) + 1)
    for i in range(len(order) - 1, -1, -1):
        hope[i] = hope[i + 1] + sum(w for _, w in gain[i] if w > 0) + sum(sum(w for _, w in links) for links, _ in due[i])
    free = [c for c in part if c not in anchors and c not in followers]
    best = [None, None]
    slot = [0] * len(order)
    left = [nodes]
    held = [0] * (k + 1)  # how many would be in each slot as slot 1, which ties of followers go to
    put: list = [()] * len(order)  # where the i-th anchor and the followers due there count

    def place(i, counted):
        for s in put[i]:
            held[s] -= 1
        for s in counted:
            held[s] += 1
        put[i] = counted

    def chosen(links, first=1):
        """A follower's best affinity and its slot; ties go to ``first``."""
        score = defaultdict(int)
        for i, w in links:
            score[slot[i]] += w
        top = max(score.values())
        return top, (first if score.get(first, -1) == top else min(s for s, v in score.items() if v == top))

    def relabel():
        """Without a pin slots are interchangeable: the one that can hold the most becomes slot 1, the others follow by smallest member."""
        ways = []
        for first in {slot[at[pin]]} if pin is not None else set(slot):
            groups = defaultdict(list)
            for c, i in at.items():
                groups[slot[i]].append(c)
            for batch in due:
                for links, c in batch:
                    groups[chosen(links, first)[1]].append(c)
            ways.append((-len(groups[first]), min(groups[first]), first, groups))
        _, _, fixed, groups = min(ways, key=lambda w: w[:3])
        rank = {fixed: 1} | {s: r for r, s in enumerate(sorted((s for s in groups if s != fixed), key=lambda s: min(groups[s])), 2)}
        return {c: rank[s] for s, cs in groups.items() for c in cs} | dict.fromkeys(free, 1)

    def enter(i, used, score):
        """The slots to try for the i-th anchor, best first; none at a leaf (whose answer is kept if it is better), beyond the budget or below hope."""
        if best[0] is not None:  # the first descent is outside the budget, so that there always is an answer
            if left[0] <= 0:
                return None
            left[0] -= 1
            if score + hope[i] < best[0][0]:
                return None
        if i == len(order):
            inside = held[slot[at[pin]]] if pin is not None else max(held)
            value = (score, inside - len(order) - len(followers))
            if best[0] is None or value > best[0]:
                best[0], best[1] = value, relabel()
            return None
        linked = defaultdict(int)
        for j, w in gain[i]:
            linked[slot[j]] += w
        waiting = []
        for links, _ in due[i]:
            others, own = defaultdict(int), 0
            for j, w in links:
                if j == i:
                    own = w
                else:
                    others[slot[j]] += w
            waiting.append((others, own, max(others.values(), default=0)))
        options = []
        for s in range(1, min(used + 1, k) + 1) if not (i == 0 and pin is not None) else (1,):
            more, counted = linked.get(s, 0), [s]
            for others, own, most in waiting:
                here = others.get(s, 0) + own
                top = max(here, most)
                more += top
                counted += [t for t, w in others.items() if w == top and t != s]
                if here == top:
                    counted.append(s)
            options.append((-more, s, counted))
        return iter(sorted(options))

    frames = [(0, 0, 0, enter(0, 0, 0))]
    while frames:
        i, used, score, options = frames[-1]
        step = next(options, None) if options is not None else None
        if step is None:
            if options is not None:
                place(i, ())
            frames.pop()
            continue
        more, slot[i], counted = step
        place(i, counted)
        used = max(used, slot[i])
        frames.append((i + 1, used, score - more, enter(i + 1, used, score - more)))
    return best[1], "optimal" if left[0] > 0 else "time limit"


def separate(seed: DataFrame, affinity: DataFrame, conflicts: DataFrame, pins: DataFrame, simthresh: int, sepmul: int = 1, nodes: int = NODES, rounds: int = bounds.ROUNDS) -> DataFrame:
    """bin_id, slot, contig_id, status, gap. Only components with a conflict reach the search, each for itself, with the slots of its bin; all other fragments pass.

    ``gap`` is how much more affinity less penalty the fragment's component could keep at most:
    0 where the status is optimal, else by the bound of ``rounds`` rounds.
    """
    s = seed.select("contig_id", "bin_id")
    own, pen = _inside(s, affinity), conflicts.select("bin_id", F.lit("p").alias("kind"), F.col("c1").alias("a"), F.col("c2").alias("b"), ((F.col("d") - simthresh) * sepmul).cast("int").alias("w"))
    groups = written(connected_components(own.select("a", "b").union(pen.select("a", "b")), "a", "b"), "separate-components").select(F.col("node").alias("a"), "component")
    k = budgets(conflicts)
    busy = pen.join(groups, "a").select("bin_id", "component").distinct().join(k, "bin_id")
    rows = s.select("bin_id", F.lit("c").alias("kind"), F.col("contig_id").alias("a"), F.lit(0).cast("long").alias("b"), F.lit(0).alias("w"))
    pin = pins.select("bin_id", F.lit("f").alias("kind"), F.col("contig_id").alias("a"), F.lit(0).cast("long").alias("b"), F.lit(0).alias("w"))
    facts = rows.union(own).union(pen).union(pin).join(groups, "a").join(busy, ["bin_id", "component"])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        kind = {k: g for k, g in pdf.groupby("kind")}
        contigs = kind["c"]["a"].tolist()
        none = pdf.iloc[:0]
        aff = {(a, b): w for a, b, w in kind.get("a", none)[["a", "b", "w"]].itertuples(index=False)}
        pen = {(a, b): w for a, b, w in kind.get("p", none)[["a", "b", "w"]].itertuples(index=False)}
        slots, status = search(contigs, aff, pen, int(pdf["k"].iloc[0]), int(kind["f"]["a"].iloc[0]) if "f" in kind else None, nodes)
        return pd.DataFrame({"bin_id": pdf["bin_id"].iloc[0], "slot": [slots[c] for c in contigs], "contig_id": contigs, "status": status, "component": pdf["component"].iloc[0]})

    searched = written(spread(facts, "bin_id", "component").groupBy("bin_id", "component").applyInPandas(run, "bin_id long, slot int, contig_id long, status string, component long"), "separate-searched")
    late = searched.where("status <> 'optimal'")
    gap = searched.select("component", F.lit(0).cast("long").alias("gap")).distinct()
    if late.limit(1).count():
        some = late.select("component").distinct()
        of = lambda d: d.join(groups, "a").join(some, "component", "left_semi").select("component", "a", "b", "w")
        bound = bounds.separate_bound(of(own), of(pen), rounds)
        slot = lambda c: late.select(F.col("contig_id").alias(c), F.col("slot").alias(f"s{c}"))
        kept = lambda d, sign: of(d).join(slot("a"), "a").join(slot("b"), "b").where("sa = sb").select("component", (sign * F.col("w")).alias("w"))
        value = kept(own, 1).union(kept(pen, -1)).groupBy("component").agg(F.sum("w").alias("value"))
        late_gap = bound.join(value, "component", "left").select("component", (F.col("bound") - F.coalesce("value", F.lit(0))).alias("late"))
        gap = gap.join(written(late_gap, "separate-gaps"), "component", "left").select("component", F.coalesce("late", "gap").alias("gap"))
    passed = s.join(searched.select("contig_id"), "contig_id", "left_anti").select("bin_id", F.lit(1).alias("slot"), "contig_id", F.lit("optimal").alias("status"), F.lit(0).cast("long").alias("gap"))
    return searched.join(gap, "component").select("bin_id", "slot", "contig_id", "status", "gap").unionByName(passed)


def _inside(s: DataFrame, affinity: DataFrame) -> DataFrame:
    return affinity.join(s.withColumnRenamed("contig_id", "c"), "c").select("bin_id", F.lit("a").alias("kind"), F.col("c").alias("a"), F.col("anchor").alias("b"), F.col("w").cast("int").alias("w"))


def objective(assigned: DataFrame, affinity: DataFrame, conflicts: DataFrame, simthresh: int, sepmul: int = 1) -> DataFrame:
    """One row: affinity kept together, penalty left together, fragments outside slot 1."""
    x, y = assigned.select(F.col("contig_id").alias("x"), "bin_id", "slot"), assigned.select(F.col("contig_id").alias("y"), "bin_id", "slot")
    on = ["bin_id", "slot"]
    kept = affinity.join(x, affinity["c"] == x["x"]).join(y.withColumnRenamed("y", "anchor"), [*on, "anchor"]).agg(F.coalesce(F.sum("w"), F.lit(0)).alias("affinity"))
    pen = conflicts.drop("bin_id").join(x.withColumnRenamed("x", "c1"), "c1").join(y.withColumnRenamed("y", "c2"), [*on, "c2"]).agg(F.coalesce(F.sum((F.col("d") - simthresh) * sepmul), F.lit(0)).alias("penalty"))
    return kept.crossJoin(pen).crossJoin(assigned.agg(F.count_if(F.col("slot") > 1).alias("outside")))
