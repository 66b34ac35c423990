"""Hand-made cases and brute force for the refinement operators."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from spindrift.functions import abundance, tnf
from spindrift.operators import affinity, bounds, checks, colouring, comarker, components, graph, knn, merge, partition, recruit, report, separate, threshold


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def edges(spark, data):
    return spark.createDataFrame(data, "src long, dst long, score double")


def test_top_union_with_name_ties(spark):
    names = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (4, "d")], "contig_id long, name string")
    got = affinity.top_union(edges(spark, [(1, 2, 0.9), (2, 3, 0.9), (1, 4, 0.95)]), names, top=1)
    assert rows(got, "src", "dst") == [(1, 4), (2, 3)]


def test_weights_round_half_to_even(spark):
    got = affinity.affinity(edges(spark, [(1, 2, 0.0005), (3, 4, 0.0015), (5, 6, 0.0025)]))
    assert rows(got, "c1", "c2", "w") == [(3, 4, 2), (5, 6, 2)]


MG = [(0, 1), (1, 1), (2, 1), (4, 1), (1, 2), (3, 2)]


def test_pair_modes(spark):
    mg = spark.createDataFrame(MG, "contig_id long, marker_id long")
    bins = spark.createDataFrame([(0, "A"), (1, "A"), (2, "B"), (3, "B")], "contig_id long, bin_label string")
    free = spark.createDataFrame([(4,)], "contig_id long")
    assert rows(comarker.pairs_within(mg, bins), "c1", "c2") == [(0, 1)]
    assert rows(comarker.pairs_merge(mg, bins), "c1", "c2") == [(0, 2), (1, 2), (1, 3)]
    assert rows(comarker.pairs_guard(mg, free), "c1", "c2") == [(4, 0), (4, 1), (4, 2)]
    assert comarker.pairs_all(mg).count() == 7
    measured = spark.createDataFrame([(0, 2, 30)], "c1 long, c2 long, d int")
    pairs = comarker.pairs_merge(mg, bins)
    assert rows(comarker.filled(pairs, measured), "c1", "c2", "d") == [(0, 2, 30)]
    assert rows(comarker.filled(pairs, measured, 200), "c1", "c2", "d") == [(0, 2, 30), (1, 2, 200), (1, 3, 200)]
    assert rows(comarker.measure_stats(pairs, measured, 200), "measured", "filled", "skipped") == [(1, 2, 0)]
    assert rows(comarker.measure_stats(pairs, measured), "measured", "filled", "skipped") == [(1, 0, 2)]
    with pytest.raises(ValueError):
        comarker.relaxed(pairs, measured, spark.createDataFrame([(0, 2, 31)], "c1 long, c2 long, d int"))


def test_threshold(spark):
    d = lambda v: spark.createDataFrame([(x,) for x in v], "d int")
    assert rows(threshold.derive(d([10, 20, 60]), d([15, 80, 90])), "simthresh", "err", "derived") == [(61, 1, True)]
    assert rows(threshold.derive(d([]), d([15])), "simthresh", "derived") == [(50, False)]
    with pytest.raises(Exception, match="above 200"):
        threshold.derive(d([10, 300]), d([15])).collect()
    assert rows(threshold.upper_median(d([1, 2, 3, 4]), "d"), "median") == [(3,)]


BINAFF = [(1, 2, 5), (2, 3, 5), (1, 3, 2), (1, 4, 1)]


@pytest.mark.parametrize(("pair", "strict", "want"), [(None, False, {1: 1, 2: 1, 3: 1, 4: 4}), ((2, 3), False, {1: 1, 2: 1, 3: 3, 4: 4}), ((1, 3), False, {1: 1, 2: 1, 3: 1, 4: 4}), ((1, 3), True, {1: 1, 2: 2, 3: 3, 4: 4})])
def test_merge(spark, pair, strict, want):
    bins = spark.createDataFrame([(10 * b, b) for b in range(1, 5)], "contig_id long, bin_id long")
    measured = spark.createDataFrame([(10 * pair[0], 10 * pair[1], 90)] if pair else [], "c1 long, c2 long, d int")
    aff = spark.createDataFrame(BINAFF, "b1 long, b2 long, n long")
    assert rows(merge.mutual_pairs(aff), "b1", "b2") == [(1, 2), (2, 3)]
    got = merge.merge(aff, measured, bins, 90, strict=strict)
    assert {r.contig_id // 10: r.bin_id for r in got.collect()} == want


def test_components_against_brute_force(spark):
    r = random.Random(1)
    for n, m in ((60, 40), (200, 199)):
        pairs = [(i, i + 1) for i in range(n - 1)] if m == n - 1 else [(r.randrange(n), r.randrange(n)) for _ in range(m)]
        root = list(range(n))

        def find(i, root=root):
            while root[i] != i:
                i = root[i]
            return i

        for a, b in pairs:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
        got = {x.node: x.component for x in components.connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()}
        assert all(got.get(i, i) == find(i) for i in range(n))


@pytest.mark.parametrize(("aff", "t", "want"), [
    ({(0, 1): 30, (2, 1): 700}, 50, {0: 1, 3: 1, 1: 2, 2: 2}),
    ({(0, 1): 30, (1, 0): 30, (2, 1): 700}, 50, dict.fromkeys(range(4), 1)),
    ({(0, 1): 30, (2, 1): 700}, 90, dict.fromkeys(range(4), 1)),
])
def test_separation_cases(aff, t, want):
    slots, status = separate.search([0, 1, 2, 3], aff, {(0, 1): 90 - t}, 2, 0)
    assert (slots, status) == (want, "optimal")


def _value(slots, aff, pen):
    same = lambda p: slots[p[0]] == slots[p[1]]
    return sum(w for p, w in aff.items() if same(p)) - sum(w for p, w in pen.items() if same(p)), -sum(s > 1 for s in slots.values())


def test_separation_is_optimal():
    r = random.Random(5)
    for _ in range(120):
        n, k = r.randint(2, 6), r.randint(2, 3)
        anchors = list(range(r.randint(1, n)))
        aff = {(c, a): r.randint(1, 9) for c in range(n) for a in anchors if c != a and r.random() < 0.5}
        pen = {(a, b): r.randint(0, 12) for a, b in itertools.combinations(anchors, 2) if r.random() < 0.5}
        slots, status = separate.search(list(range(n)), aff, pen, k, anchors[0])
        best = max(_value(dict(enumerate(s)), aff, pen) for s in itertools.product(range(1, k + 1), repeat=n) if s[anchors[0]] == 1)
        assert status == "optimal" and slots[anchors[0]] == 1 and _value(slots, aff, pen) == best


def test_separate_on_tables(spark):
    seed = spark.createDataFrame([(c, 1) for c in range(4)] + [(9, 2)], "contig_id long, bin_id long")
    aff = spark.createDataFrame([(0, 1, 30), (2, 1, 700)], "c long, anchor long, w int")
    conflicts = separate.cannot_link(spark.createDataFrame([(0, 1, 90)], "c1 long, c2 long, d int"), seed, 50)
    pins = spark.createDataFrame([(1, 0), (2, 9)], "bin_id long, contig_id long")
    got = separate.separate(seed, aff, conflicts, pins, 50)
    assert rows(got, "contig_id", "bin_id", "slot") == [(0, 1, 1), (1, 1, 2), (2, 1, 2), (3, 1, 1), (9, 2, 1)]
    assert rows(separate.budgets(conflicts), "bin_id", "k") == [(1, 2)]
    assert rows(separate.objective(got, aff, conflicts, 50), "affinity", "penalty", "outside") == [(700, 0, 2)]


def test_recruit_conflict(spark):
    aff = spark.createDataFrame([(2, 1, 900), (2, 2, 100), (3, 1, 800), (3, 2, 700)], "c long, bin_id long, w int")
    pinned = spark.createDataFrame([(0, 1), (1, 2)], "contig_id long, bin_id long")
    guard = spark.createDataFrame([(2, 3, 90), (3, 2, 90)], "c1 long, c2 long, d int")
    assert rows(recruit.recruit(aff, guard, pinned, 50), "contig_id", "bin_id") == [(2, 1), (3, 2)]
    assert rows(recruit.recruit(aff, guard.where("d < 0"), pinned, 50), "contig_id", "bin_id") == [(2, 1), (3, 1)]
    assert recruit.recruit(aff.where("w < 0"), guard, pinned, 50).count() == 0


def test_recruit_is_optimal():
    r = random.Random(6)
    for _ in range(150):
        n = r.randint(1, 6)
        options = {c: [(b, r.randint(1, 9)) for b in range(3) if r.random() < 0.7] or [(0, 1)] for c in range(n)}
        bad = [p for p in itertools.combinations(range(n), 2) if r.random() < 0.5]
        got, status = recruit.best_assignment(options, bad)
        best = 0
        for pick in itertools.product(*[[*options[c], (None, 0)] for c in range(n)]):
            if all(pick[a][0] is None or pick[a][0] != pick[b][0] for a, b in bad):
                best = max(best, sum(w for _, w in pick))
        assert status == "optimal" and sum(dict(options[c])[b] for c, b in got.items()) == best
        assert all(a not in got or got[a] != got.get(b) for a, b in bad)


def test_answers_that_tie_cost_no_walk_over_all_followers(monkeypatch):
    r = random.Random(1)
    anchors, n = list(range(150)), 200
    aff = {(c, a): 1000 for c in range(100, n) for a in r.sample(anchors, 3) if a != c}
    calls = []
    monkeypatch.setattr(separate, "min", lambda *a, **k: calls.append(1) or min(*a, **k), raising=False)
    slots, status = separate.search(list(range(n)), aff, {(a, a + 1): 5 for a in range(0, 100, 2)}, 3, None, nodes=1000)
    assert sorted(slots) == list(range(n)) and status == "time limit"
    assert len(calls) < 100 * n  # each tie took some n of them before


def test_a_component_beyond_the_budget_has_a_whole_answer(spark):
    n = 3000  # neighbours in a row exclude each other
    options = {c: [(1, 5), (2, 3)] for c in range(n)}
    got, status = recruit.best_assignment(options, [(c, c + 1) for c in range(n - 1)], nodes=100)
    assert status == "time limit" and len(got) == n and all(got[c] != got[c + 1] for c in range(n - 1))
    pen = {(c, c + 1): 10 for c in range(n - 1)}
    slots, status = separate.search(list(range(n)), {}, pen, 2, 0, nodes=100)
    assert status == "time limit" and sorted(slots) == list(range(n)) and slots[0] == 1
    assert sum(slots[a] == slots[b] for a, b in pen) < n // 2
    aff = spark.createDataFrame([(c, b, w) for c in range(30) for b, w in options[c]], "c long, bin_id long, w int")
    guard = spark.createDataFrame([(c, c + 1, 90) for c in range(29)], "c1 long, c2 long, d int")
    pinned = spark.createDataFrame([(900, 1), (901, 2)], "contig_id long, bin_id long")
    assert {(r.contig_id, r.status) for r in recruit.recruit(aff, guard, pinned, 50, nodes=5).collect()} == {(c, "time limit") for c in range(30)}


def test_stage_summary(spark):
    s = "contig_id string, bin_label string"
    before, after = spark.createDataFrame([("a", "A"), ("b", "A"), ("c", "B")], s), spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "2"), ("d", "2")], s)
    r = report.stage_summary(before, after).first()
    assert (r.bins_split, r.bins_joined, r.recruited, r.bins_in, r.bins_out, r.contigs_in, r.contigs_out) == (1, 1, 1, 2, 2, 3, 4)


def test_min_bin_size_keeps_unknown_lengths_at_zero(spark):
    b = spark.createDataFrame([(1, "A"), (2, "B"), (3, "B")], "contig_id long, bin_label string")
    n = spark.createDataFrame([(1, 10), (2, 4)], "contig_id long, length long")
    assert rows(report.min_bin_size(b, n, 5), "contig_id") == [(1,)]


def test_checks(spark):
    depth = spark.createDataFrame([(0, "a"), (1, "c"), (2, "b"), (9000, "a2")], "ordinal long, name string")
    contigs = spark.createDataFrame([(0, "a"), (1, "b"), (2, "c"), (3, "d"), (1, "a2")], "contig_id long, name string")
    assert rows(checks.depth_order_violations(depth, contigs), "name") == [("a2",), ("b",)]
    assert rows(checks.missing_depth(depth, contigs), "name") == [("d",)]
    seeds = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "x"), ("q", "x")], "name string, bin_label string")
    assert rows(checks.seed_conflicts(seeds), "name", "bins") == [("a", 2)]
    assert rows(checks.match_counts(seeds, contigs), "names", "matched", "unmatched", "status") == [(3, 2, 1, "ok")]
    with pytest.raises(ValueError):
        checks.require(checks.seed_conflicts(seeds), "conflict")
    with pytest.raises(ValueError):
        checks.not_fewer(contigs, depth, "merge")


def test_kmers_and_probability():
    assert len(tnf.KMERS) == 136
    c = tnf.counts(b"ACGTNACGTT")
    assert c.sum() == 3 and c[tnf.KMERS.index("ACGT")] == 2 and c[tnf.KMERS.index(tnf.canonical("CGTT"))] == 1
    p = tnf.probability(np.array([0.0, 0.05, 0.3]), np.full(3, 3.5), np.full(3, 4.0))
    assert (np.diff(p) >= 0).all() and (0 <= p).all() and (p <= 1).all()


def test_kmers_leave_in_pieces():
    import pyarrow as pa

    got = []

    class Contigs:  # hands one large batch to the function and sees what leaves it
        def select(self, *_):
            return self

        def mapInArrow(self, run, _):
            seq = ["ACGTTGCA" * 40, None, "NNNN"] * 500
            got.extend(run([pa.record_batch([pa.array(range(1500)), pa.array(seq)], ["contig_id", "seq"])]))

    tnf.kmer_counts(Contigs())
    assert sum(b.num_rows for b in got) == 500 * np.count_nonzero(tnf.counts(b"ACGTTGCA" * 40))
    assert max(b.num_rows for b in got) <= tnf.FRAGMENTS * len(tnf.KMERS) and len(got) > 1


def test_abundance_against_integration():
    r = np.random.default_rng(0)
    m1, m2, v1, v2 = r.uniform(1, 30, 40), r.uniform(1, 30, 40), r.uniform(1, 50, 40), r.uniform(1, 50, 40)
    x = np.linspace(-80, 120, 200_001)
    for a, b, c, d, got in zip(m1, m2, v1, v2, abundance.distance(m1, v1, m2, v2)):
        f, g = (np.exp(-((x - m) ** 2) / (2 * v)) / np.sqrt(2 * np.pi * v) for m, v in ((a, c), (b, d)))
        assert abs(0.5 * np.abs(f - g).sum() * (x[1] - x[0]) - got) < 1e-3
    d, n = abundance.all_samples(np.array([[1.0]]), np.array([[1.0]]), np.array([[1.0]]), np.array([[1.0]]))
    assert d[0] == 1.0 and n[0] == 0  # a mean of exactly 1 is no signal


def test_neighbours_broadcast_and_blocks_agree(spark):
    r = random.Random(2)
    seqs = [(i, "".join(r.choice("AACGT"[i % 4 :]) for _ in range(1200 + 40 * i)), 1200 + 40 * i) for i in range(60)]
    contigs = spark.createDataFrame(seqs, "contig_id long, seq string, length long")
    depth = spark.createDataFrame([(i, s, r.uniform(0, 9), 2.0) for i in range(60) for s in "AB"], "contig_id long, sample string, mean double, var double")
    from spindrift.operators import measure

    feats = measure.features(contigs, depth).cache()
    a = graph.neighbours(feats, most=5)
    for wide in (8, 25, 1000):
        b = graph.neighbours(feats, most=5, limit=0, wide=wide)
        assert rows(a.where("dst is not null"), "src", "dst", "sim") == rows(b.where("dst is not null"), "src", "dst", "sim")
        assert rows(a.where("dst is null"), "src", "sim") == rows(b.where("dst is null"), "src", "sim")
    assert graph.neighbours(feats.limit(0)).count() == 0
    pairs = spark.createDataFrame([(i, j) for i in range(6) for j in range(i)], "c1 long, c2 long")
    assert rows(measure.measure(pairs, feats), "c1", "c2", "d") == rows(measure.measure(pairs, feats, limit=0), "c1", "c2", "d")


def test_cutoff_and_generator():
    rand = graph.Rand(1)
    assert [rand.next() for _ in range(3)] == [1804289383, 846930886, 1681692777]  # well known first values of srand(1)
    reach = lambda x: graph.curve(np.bincount(np.floor(np.round(np.asarray(x) * 1e6) / 1000).astype(int), minlength=1001))
    assert graph.cutoff(reach(np.full(100, 0.9))) in (900, 901)
    assert graph.cutoff(reach(np.zeros(10))) == 700
    assert graph.cutoff(reach([])) == 1000 or graph.cutoff(reach([])) == 999
    x = np.random.default_rng(0).uniform(0.7, 1, 30_000)
    assert 700 <= graph.pooled_cutoff(reach(x)) <= 999
    assert abs(graph.pooled_cutoff(reach(x)) - graph.cutoff(reach(x))) < 12
    drawn = graph._drawn(reach(x), 2500, graph.Rand(3))
    assert drawn[0] == 2500 and np.abs(drawn / 2500 - reach(x) / 30_000).max() < 0.05
    assert graph._drawn(reach(x[:50]), 50, graph.Rand(3)).tolist() == reach(x[:50]).tolist()


def test_error_function():
    import math

    x = np.concatenate([np.linspace(-7, 28, 20_001), [0.0, 5.999, -6.0]])
    assert np.abs(abundance.erfc(x) - [math.erfc(v) for v in x]).max() < 5e-16


def _fragments(seed, n, first=0, copies=0):
    r = np.random.default_rng(seed)
    centre = np.abs(r.normal(0.08, 0.03, (4, 136)))
    x = np.abs(centre[r.integers(0, 4, n)] + r.normal(0, 0.008, (n, 136)))
    x[n - copies :] = x[:copies]
    x[n // 2] = 0  # without any window
    x /= np.maximum(np.sqrt((x * x).sum(axis=1, keepdims=True)), 1e-300)
    return {"id": first + r.permutation(n), "log": r.uniform(3, 5.7, n), "tnf": x, "mean": r.uniform(0, 1.6, (n, 2)), "var": np.ones((n, 2))}


def test_pruned_neighbours_are_a_full_sort():
    for m, most in ((_fragments(1, 900, copies=40), 15), (_fragments(2, 40), 60), (_fragments(3, 3), 2)):
        own = knn.Blocks(m, knn.Directions(m["tnf"]), 1.0, leaf=16)
        edges = knn.length_cells(m["log"].min(), m["log"].max())
        search = knn.Search(own, edges, knn.lower_coefficients(edges), 1.0, most)
        a = own.m
        d = np.sqrt(((a["tnf"][:, None] - a["tnf"][None]) ** 2).sum(axis=2))
        s = np.round(1 - tnf.probability(d, np.repeat(a["log"][:, None], len(d), axis=1), np.repeat(a["log"][None], len(d), axis=0)), 6)
        covered = (a["mean"] > 1).any(axis=1)
        for (at, to), (src, dst, sim, top) in zip(zip(own.start[:-1], own.start[1:]), search.of(own)):
            for k in range(at, to):
                others = [j for j in range(len(d)) if j != k]
                want = sorted((-s[k, j], int(a["id"][j])) for j in others if covered[k] or covered[j])[:most]
                mine = src == a["id"][k]
                assert list(zip((-sim[mine]).tolist(), dst[mine].tolist())) == want
                assert top[k - at] == max(s[k, j] for j in others)
        if len(d) == 900:
            assert search.pairs == 900 * 900 and search.evaluated < 0.35 * search.pairs


@pytest.mark.parametrize("n, most, tile", [(900, 15, 100), (900, 15, 2000), (40, 60, 7), (3, 2, 1)])
def test_neighbours_among_fragments_that_pass_by_are_a_full_sort(n, most, tile):
    m = _fragments(5, n, copies=min(40, n // 3))
    m["covered"] = (m["mean"] > 1).any(axis=1)
    edges = knn.length_cells(m["log"].min(), m["log"].max())
    d = np.sqrt(((m["tnf"][:, None] - m["tnf"][None]) ** 2).sum(axis=2))
    s = np.round(1 - tnf.probability(d, np.repeat(m["log"][:, None], n, axis=1), np.repeat(m["log"][None], n, axis=0)), 6)
    own = slice(0, n // 2 + 1)
    search = knn.Nearest({k: v[own] for k, v in m.items()}, edges, knn.lower_coefficients(edges), most)
    for k in range(0, n, tile):
        search.meet({c: v[k : k + tile] for c, v in m.items()})
    seen = 0
    for src, dst, sim, ids, top in search.found():
        for i, t in zip(ids, top):
            k = int(np.flatnonzero(m["id"] == i)[0])
            others = [j for j in range(n) if j != k]
            want = sorted((-s[k, j], int(m["id"][j])) for j in others if m["covered"][k] or m["covered"][j])[:most]
            assert list(zip((-sim[src == i]).tolist(), dst[src == i].tolist())) == want
            assert t == max(s[k, j] for j in others)
            seen += 1
    assert seen == n // 2 + 1


def test_packed_counts_are_the_vectors():
    n = np.zeros((5, len(tnf.KMERS)), np.int64)
    n[0, 3], n[1, :9], n[2, 5], n[3, 7] = 255, 256, 1 << 20, 1
    got = tnf.packed(n)
    assert [len(x) // len(tnf.KMERS) for x in got.to_pylist()] == [1, 2, 4, 1, 1]
    assert (tnf.unpacked(got) == tnf.normal(n.astype(float))).all() and (tnf.unpacked(got.slice(2)) == tnf.normal(n[2:].astype(float))).all()


def test_guard_is_measured_in_cells(spark):
    from spindrift.operators import measure

    r = random.Random(8)
    contigs = spark.createDataFrame([(i, "".join(r.choice("AACGT"[i % 4 :]) for _ in range(1200 + 40 * i)), 1200 + 40 * i) for i in range(30)], "contig_id long, seq string, length long")
    depth = spark.createDataFrame([(i, s, r.uniform(2, 9) if i % 7 else 0.1, 2.0) for i in range(30) for s in "AB"], "contig_id long, sample string, mean double, var double")
    feats = measure.features(contigs, depth).cache()
    mg = spark.createDataFrame([(c, m) for c in range(30) for m in range(4) if m == 0 or r.random() < 0.4], "contig_id long, marker_id long").cache()
    free = mg.where("contig_id % 3 = 0").select("contig_id").distinct()
    pairs = comarker.pairs_guard(mg, free)
    undirected = pairs.selectExpr("least(c1, c2) as c1", "greatest(c1, c2) as c2").distinct()
    want = rows(comarker.filled(pairs, measure.measure(undirected, feats, limit=0), 200), "c1", "c2", "d")
    assert want == rows(comarker.filled(pairs, measure.measure(undirected, feats.drop("kmers"), limit=0), 200), "c1", "c2", "d")
    for most in (4, 1024):
        assert rows(comarker.guard(mg, free, feats, most=most).distinct(), "c1", "c2", "d") == want
        assert rows(comarker.guard(mg, free, feats, least=60, most=most).distinct(), "c1", "c2", "d") == [w for w in want if w[2] >= 60]
    cells = [(1, 0), (1, 0), (1, 1), (2, 1), (2, 1), (2, 1), (3, 0)]
    for size in (1, 2, 3, 7):
        import pyarrow as pa

        got = list(comarker._whole_cells((pa.record_batch([pa.array([a for a, _ in cells[k : k + size]]), pa.array([b for _, b in cells[k : k + size]])], ["a", "b"]) for k in range(0, 7, size)), 2))
        assert [sorted(set(zip(*(c.to_pylist() for c in b.columns)))) for b, cut in got for b in [b.slice(x, y - x) for x, y in zip(cut[:-1], cut[1:])]] == [[c] for c in dict.fromkeys(cells)]


def test_only_bins_that_are_asked_for_are_measured(spark, monkeypatch):
    from spindrift.operators import measure

    r = random.Random(10)
    contigs = spark.createDataFrame([(i, "".join(r.choice("AACGT"[i % 4 :]) for _ in range(1200 + 40 * i)), 1200 + 40 * i) for i in range(40)], "contig_id long, seq string, length long")
    depth = spark.createDataFrame([(i, s, r.uniform(2, 9) if i % 9 else 0.1, 2.0) for i in range(40) for s in "AB"], "contig_id long, sample string, mean double, var double")
    feats = measure.features(contigs, depth).cache()
    mg = spark.createDataFrame([(c, m) for c in range(40) for m in range(6) if r.random() < 0.15], "contig_id long, marker_id long").cache()
    seed = spark.createDataFrame([(c, "abcdefg"[c % 7], c % 7) for c in range(40) if c % 5], "contig_id long, bin_label string, bin_id long")
    asked = spark.createDataFrame([(0, 1), (0, 4), (1, 2), (3, 6), (4, 5)], "b1 long, b2 long")
    pairs = comarker.pairs_merge(mg, seed)
    filled = comarker.filled(pairs, measure.measure(pairs, feats), comarker.UNMEASURED)
    sizes = []
    for least in (0, 90, 130, 160, 201):
        want = rows(merge.blocked_pairs(asked, filled, seed, least), "b1", "b2")
        sizes.append(len(want))
        for most in (2, 1024):
            assert rows(comarker.unlike(mg, seed, asked, feats, least, most=most), "b1", "b2") == want
    assert sizes[-1] == 0 and len(set(sizes)) > 2
    # carriers of other bins do not travel
    sides = comarker._sides
    monkeypatch.setattr(comarker, "_sides", lambda *a: met.append(a) or sides(*a))
    met = []
    comarker.unlike(mg, seed, asked.where("b1 = 3"), feats, 60)
    assert {x.contig_id % 7 for d in met[0][:2] for x in d.select("contig_id").collect()} == {3, 6}


def test_a_refinement_measures_its_pairs_in_cells(spark, monkeypatch):
    from spindrift.plans import refine
    from spindrift.sources.fixtures import Domain

    for name in ("pairs_guard", "pairs_merge", "filled"):  # every pair with both sides' features
        monkeypatch.setattr(comarker, name, lambda *a, **k: pytest.fail("pairs are listed"))
    names, write = [], refine.written
    monkeypatch.setattr(refine, "written", lambda d, what: names.append(what) or write(d, what))
    assert refine.refine(Domain(spark, "/root/testdata/sf0.001")).binning.count() > 0
    assert names.count("anchor-affinity") == 1  # not made anew by each of its readers


def test_pairs_are_measured_in_cells(spark):
    from spindrift.operators import measure

    r = random.Random(9)
    contigs = spark.createDataFrame([(i, "".join(r.choice("AACGT"[i % 4 :]) for _ in range(1200 + 40 * i)), 1200 + 40 * i) for i in range(30)], "contig_id long, seq string, length long")
    depth = spark.createDataFrame([(i, s, r.uniform(2, 9) if i % 7 else 0.1, 2.0) for i in range(30) for s in "AB"], "contig_id long, sample string, mean double, var double")
    feats = measure.features(contigs, depth).cache()
    mg = spark.createDataFrame([(c, m) for c in range(30) for m in range(4) if m == 0 or r.random() < 0.4], "contig_id long, marker_id long").cache()
    seed = spark.createDataFrame([(c, "ab"[c % 2]) for c in range(30) if c % 5], "contig_id long, bin_label string")
    for pairs, binning, same in ((comarker.pairs_all(mg), None, False), (comarker.pairs_within(mg, seed), seed, True), (comarker.pairs_merge(mg, seed), seed, False)):
        want = rows(measure.measure(pairs, feats), *measure.NAMES)
        assert len(want) > 50
        for most in (4, 1024):
            assert rows(comarker.measured(mg, feats, binning, same, limit=0, most=most), *measure.NAMES) == want


def test_lists_are_sorted_as_one_number():
    r = np.random.default_rng(4)
    row, sim = r.integers(0, 9, 500), np.round(r.integers(0, 5, 500) / 4, 6)
    for ids in (r.permutation(500), r.permutation(500) + (1 << 40), -r.permutation(500)):
        keep = np.lexsort((ids, -sim, row))
        for got, want in zip(knn.listed(row, ids, sim), (row, ids, sim)):
            assert got.tolist() == want[keep].tolist()


def test_few_fragments_that_pass_by_are_evaluated():
    m = _fragments(6, 6000)
    m["covered"] = (m["mean"] > 1).any(axis=1)
    edges = knn.length_cells(m["log"].min(), m["log"].max())
    search = knn.Nearest(m, edges, knn.lower_coefficients(edges), 20)
    row, col = np.arange(6000).repeat(5), np.tile(np.arange(5), 6000)
    other = search.m | {"sides": search.sides}
    assert (search._coefficients(row, col, other) == tnf.side("x", np.minimum(search.m["log"][row], search.m["log"][col])) + tnf.side("y", np.maximum(search.m["log"][row], search.m["log"][col])) + tnf.side("xy", search.m["log"][row] * search.m["log"][col])).all()
    search.meet(m)
    assert search.evaluated < 0.012 * 6000 * 6000


def test_short_fragments_meet_few_that_pass_by():
    """Short fragments' neighbours may be the farthest ones, as slopes are negative there; by length, whole blocks are left out."""
    r = np.random.default_rng(9)
    m = _fragments(7, 6000) | {"log": np.sort(np.log10(1000 + r.exponential(1500, 6000)))}
    m["covered"] = np.ones(6000, bool)
    edges = knn.length_cells(m["log"].min(), m["log"].max(), knn.FINE)
    own = {k: v[::7] for k, v in m.items()}
    n = len(own["id"])
    search = knn.Nearest(own, edges, knn.lower_coefficients(edges), 20)
    for k in range(0, 6000, 500):
        search.meet({c: v[k : k + 500] for c, v in m.items()})
    assert search.seen < 0.8 * n * 6000 and search.judged < 0.05 * n * 6000
    got = {}
    for src, dst, sim, _, _ in search.found():
        for s, d, x in zip(src.tolist(), dst.tolist(), sim.tolist()):
            got.setdefault(s, []).append((-x, d))
    for k in range(0, 6000, 7):
        d = np.sqrt(((m["tnf"] - m["tnf"][k]) ** 2).sum(axis=1))
        s = np.round(1 - tnf.probability(d, np.full(6000, m["log"][k]), m["log"]), 6)
        s[k] = -1
        o = np.lexsort((m["id"], -s))[:20]
        assert got[int(m["id"][k])] == list(zip((-s[o]).tolist(), m["id"][o].tolist()))


def test_only_pairs_that_can_be_listed_are_evaluated(monkeypatch):
    """Pairs are seen in a few directions first, and of many at once only those are evaluated that no ``most`` others surely surpass."""
    r = np.random.default_rng(9)
    m = _fragments(7, 6000, copies=300) | {"log": np.sort(np.log10(1000 + r.exponential(1500, 6000)))}
    m["covered"] = r.random(6000) < 0.7
    edges = knn.length_cells(m["log"].min(), m["log"].max(), knn.FINE)
    table = knn.lower_coefficients(edges)
    own = {k: v[::7] for k, v in m.items()}
    lists, sparse = [], knn.Nearest._sparse
    for dense in (1, 10**9):  # pair by pair wherever pairs need only lie near, and nowhere
        left = []
        monkeypatch.setattr(knn, "DENSE", dense)
        monkeypatch.setattr(knn.Nearest, "_sparse", lambda *a: left.append(sparse(*a)) or left[-1])  # noqa: B023
        search = knn.Nearest(own, edges, table, 20)
        for k in range(0, 6000, 500):
            search.meet({c: v[k : k + 500] for c, v in m.items()})
        assert search.evaluated < 40 * len(own["id"])
        assert any(x is not None and len(x[0]) for x in left) == (dense == 1)
        lists.append([np.concatenate(x).tolist() for x in zip(*search.found())])
    assert lists[0] == lists[1]
    got = {}
    for s, d, x in zip(*lists[0][:3]):
        got.setdefault(s, []).append((-x, d))
    for k in range(0, 6000, 7):
        d = np.sqrt(((m["tnf"] - m["tnf"][k]) ** 2).sum(axis=1))
        s = np.round(1 - tnf.probability(d, np.full(6000, m["log"][k]), m["log"]), 6)
        s[k] = -1
        s[~(m["covered"] | m["covered"][k])] = -1
        o = np.lexsort((m["id"], -s))[:20]
        assert got[int(m["id"][k])] == list(zip((-s[o]).tolist(), m["id"][o].tolist()))


def test_later_neighbours_are_those_of_larger_id(spark):
    m = _fragments(8, 60)
    feats = spark.createDataFrame([(int(i), int(10**x), [float(v) for v in t], [2.0, 0.5], [1.0, 1.0]) for i, x, t in zip(m["id"], m["log"], m["tnf"])], "contig_id long, length long, tnf array<double>, mean array<double>, var array<double>").cache()
    for limit in (0, 1 << 30):
        every = rows(graph.neighbours(feats, most=5, limit=limit).where("dst is null or dst > src").na.fill(-1), "src", "dst", "sim")
        assert rows(graph.neighbours(feats, most=5, limit=limit, later=True).na.fill(-1), "src", "dst", "sim") == every


def test_features_are_read_as_arrays():
    import pyarrow as pa

    from spindrift.operators import measure

    assert measure._rows(pa.array([[0.0, 9.0], [1.0, 2.0], [3.0, 4.0]]).slice(1)).tolist() == [[1, 2], [3, 4]]
    assert measure._rows(pa.array([5, 6, 7]).slice(2)).tolist() == [7]
    assert len(measure._rows(pa.array([], pa.list_(pa.float64())))) == 0


def test_coverage_alone_is_that_of_all_measures(spark):
    from spindrift.operators import measure

    feats = spark.createDataFrame([(i, 1000 + i, [0.1 * (i % 3)] * 136, [i * 0.7, 2.0], [1.0, i * 0.5]) for i in range(9)], "contig_id long, length long, tnf array<double>, mean array<double>, var array<double>")
    pairs = spark.createDataFrame([(i, j, i + j) for i in range(11) for j in range(i)], "c1 long, c2 long, x long")
    want = rows(measure.measure(pairs, feats, extra=["x"]), "c1", "c2", "x", "abd_dist", "nnz")
    for limit in (0, 1 << 20):
        assert rows(measure.covered(pairs, feats, limit=limit, extra=["x"]), "c1", "c2", "x", "abd_dist", "nnz") == want
    assert len(want) == 36 and measure.covered(pairs, feats.limit(0)).count() == 0


def test_coefficients_are_bounded_from_below_in_each_cell():
    edges = knn.length_cells(2.5, 5.7)
    table = knn.lower_coefficients(edges)
    r = np.random.default_rng(4)
    x, y = r.uniform(2.5, 5.7, (2, 50_000))
    lo, hi = np.minimum(x, y), np.maximum(x, y)
    c = tnf.side("x", lo) + tnf.side("y", hi) + tnf.side("xy", lo * hi)
    i, j = np.searchsorted(edges, x, "right") - 1, np.searchsorted(edges, y, "right") - 1
    assert (table[:, i, j] <= c).all() and np.median(c - table[:, i, j]) < 0.5
    log1, log2 = r.uniform(3, 5.7, 150), np.append(r.uniform(3, 5.7, 90), 4.0)
    z = tnf.coefficients(log1, log2)
    want = [tnf.side("x", min(a, b)) + tnf.side("y", max(a, b)) + tnf.side("xy", a * b) for a, b in ((log1[3], log2[5]), (log1[149], log2[90]))]
    assert np.allclose(z[:, 3, 5], want[0], atol=1e-6) and np.allclose(z[:, 149, 90], want[1], atol=1e-6)


def test_values_at_ranks(spark):
    r = random.Random(9)
    values = [round(r.random(), 1) for _ in range(200)] + [0.5] * 300
    held = graph.ranks(spark.createDataFrame([(v,) for v in values], "v double"), "v", "lo")
    asked = spark.createDataFrame([(k, f"x{k}") for k in range(1, 501)], "rank long, name string")
    for rows_ in (500, 10**7):
        got = graph.at_rank(asked, "rank", held, "v", "lo", rows_, "at").collect()
        assert {x["rank"]: x["at"] for x in got} == {k: v for k, v in enumerate(sorted(values), 1)} and all(x["name"] == f"x{x['rank']}" for x in got)


def _joined(mg, same=lambda a, b: True):
    return sorted({(min(a, b), max(a, b)) for m, a in mg for n, b in mg if m == n and a != b and same(a, b)})


def test_hot_markers_are_split_into_cells(spark):
    r = random.Random(11)
    mg = sorted({(0, c) for c in range(90)} | {(r.randrange(1, 9), r.randrange(120)) for _ in range(200)})
    d = spark.createDataFrame([(m, c) for m, c in mg], "marker_id long, contig_id long")
    bins = spark.createDataFrame([(c, "ABC"[c % 3]) for c in range(0, 120, 2)], "contig_id long, bin_label string")
    free = spark.createDataFrame([(c,) for c in range(1, 120, 2)], "contig_id long")
    binned = [(m, c) for m, c in mg if c % 2 == 0]
    for most in (7, 1024):
        assert rows(comarker.pairs_all(d, most), "c1", "c2") == _joined(mg)
        assert rows(comarker.pairs_within(d, bins, most), "c1", "c2") == _joined(binned, lambda a, b: a % 3 == b % 3)
        assert rows(comarker.pairs_merge(d, bins, most), "c1", "c2") == _joined(binned, lambda a, b: a % 3 != b % 3)
        assert rows(comarker.pairs_guard(d, free, most), "c1", "c2") == sorted({(a, b) for m, a in mg for n, b in mg if m == n and a != b and a % 2})
    cells = comarker.triangle(d.where("marker_id = 0"), ["marker_id"], most=7)
    assert cells.count() == 90 * 89 // 2  # each pair once
    sizes = [x["n"] for x in comarker._grouped(d.where("marker_id = 0"), ["marker_id"], 7).groupBy("_i").agg(comarker.F.count("*").alias("n")).collect()]
    assert max(sizes) < 3 * 7


def test_colouring_in_rounds_is_the_greedy_one(spark):
    r = random.Random(12)
    edges = {(1, a, b) for a in range(40) for b in range(a) if r.random() < 0.2} | {(2, 100 + a, 100 + b) for a in range(24) for b in range(a)}
    edges |= {(3, 200 + a, 201 + a) for a in range(30)} | {(4, 300, 301)}
    d = spark.createDataFrame(sorted(edges), "bin_id long, c1 long, c2 long")
    want = sorted((b, n, c) for b in (1, 2, 3, 4) for n, c in colouring.colours([(x, y) for k, x, y in edges if k == b]).items())
    for small, chunk in ((1000, 512), (0, 5), (20, 100)):
        assert rows(colouring.colouring(d, small, chunk), "bin_id", "node", "colour") == want
    assert rows(separate.budgets(d), "bin_id", "k") == rows(separate.budgets(d, small=0), "bin_id", "k")


def test_bounds_hold_and_meet_on_small_instances(spark):
    r = random.Random(13)
    cand, rivals_, best = [], [], {}
    for k in range(12):
        options = {c: [(b, r.randint(1, 20)) for b in range(3) if r.random() < 0.7] for c in range(5)}
        options = {c: o for c, o in options.items() if o}
        pairs = [(a, b) for a in options for b in options if a < b and r.random() < 0.5]
        cand += [(k, c, b, w) for c, o in options.items() for b, w in o]
        rivals_ += [(k, a, b) for a, b in pairs]
        full = 0
        for choice in itertools.product(*([(None, 0), *options[c]] for c in options)):
            at = dict(zip(options, (b for b, _ in choice)))
            if all(at[a] is None or at[a] != at[b] for a, b in pairs):
                full = max(full, sum(w for _, w in choice))
        best[k] = full
    d = spark.createDataFrame(cand, "component long, c long, bin_id long, w long")
    known = spark.createDataFrame([(k, max(0, v - 3)) for k, v in best.items()], "component long, value long")
    got = {x["component"]: x["bound"] for x in bounds.recruit_bound(d, spark.createDataFrame(rivals_, "component long, a long, b long"), known, 15).collect()}
    assert all(got[k] >= v for k, v in best.items()) and sum(got[k] == v for k, v in best.items()) >= 4

    aff, pen, best = [], [], {}
    for k in range(10):
        own = {(a, b): r.randint(1, 30) for a in range(6) for b in range(3) if a != b and r.random() < 0.6}
        bad = {(a, b): r.randint(1, 40) for a in range(3) for b in range(a) if r.random() < 0.8}
        aff += [(k, a, b, w) for (a, b), w in own.items()]
        pen += [(k, a, b, w) for (a, b), w in bad.items()]
        best[k] = max(sum(w for (a, b), w in own.items() if s[a] == s[b]) - sum(w for (a, b), w in bad.items() if s[a] == s[b]) for s in itertools.product(range(3), repeat=6))
    kind = "component long, a long, b long, w long"
    got = {x["component"]: x["bound"] for x in bounds.separate_bound(spark.createDataFrame(aff, kind), spark.createDataFrame(pen, kind), 6).collect()}
    assert all(got[k] >= v for k, v in best.items()) and sum(got.values()) < sum(w for *_, w in aff)


def test_rivals_are_compared_once_a_pair(spark):
    r = random.Random(14)
    cand = spark.createDataFrame([(c, b, 1) for c in range(30) for b in range(40) if c % 6 and (b % 3 != c % 3 or r.random() < 0.02)], "c long, bin_id long, w long").cache()
    guard = spark.createDataFrame([(a, b, r.choice([20, 80])) for a in range(40) for b in range(40) if a != b and r.random() < 0.3], "c1 long, c2 long, d int").cache()
    own = {}
    for c, b, _ in cand.collect():
        own.setdefault(c, set()).add(b)
    want = sorted({(min(x, y), max(x, y)) for x, y, d in guard.collect() if d >= 60 and own.get(x, set()) & own.get(y, set())})
    got = recruit.rivals(cand, guard, 60)
    assert rows(got, "a", "b") == want and want
    keys = [line for line in got._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join" in line]
    assert len(keys) == 2 and not any("bin_id" in k for k in keys)  # no row a shared bin


def test_prices_of_small_components_take_their_rounds_in_one_task(spark, monkeypatch):
    from spindrift.operators import bounds

    r, cand, rivals, values = random.Random(12), [], [], []
    for g in range(6):
        own = [(g, 100 * g + c, b, r.randint(1, 900)) for c in range(7) for b in range(4) if r.random() < 0.8]
        cand += own
        have = sorted({c for _, c, _, _ in own})
        rivals += [(g, a, b) for a in have for b in have if a < b and r.random() < 0.4]
        values.append((g, sum(max(w for _, c, _, w in own if c == x) for x in have[:3])))
    d = [spark.createDataFrame(x, y) for x, y in ((cand, "component long, c long, bin_id long, w long"), (rivals, "component long, a long, b long"), (values, "component long, value long"))]
    rounds = [rows(bounds.recruit_bound(*d, rounds=5, small=small), "component", "bound") for small in (0, 40)]
    monkeypatch.setattr(bounds, "_priced_in_rounds", lambda *a: pytest.fail("small components stay spread"))
    assert rows(bounds.recruit_bound(*d, rounds=5), "component", "bound") == rounds[0] == rounds[1]
    assert len(rounds[0]) == 6


def test_edges_that_cannot_be_among_the_best_are_not_shuffled(spark):
    r = random.Random(13)
    edges = [(a, b, r.choice([None, 0.25, 0.5, r.random()])) for a in range(40) for b in range(a + 1, 60) if r.random() < 0.7]
    d = spark.createDataFrame(edges, "src long, dst long, score double").coalesce(1)
    left = [tuple(x) for x in affinity.best_ends(d, 5).collect()]
    assert len(left) < len(edges)  # of twice as many ends
    at = {}
    for a, b, s in edges:
        for end in (a, b):
            at.setdefault(end, []).append((-1.0 if s is None else s, a, b))
    best = {e: sorted(x, reverse=True) for e, x in at.items()}
    want = {(a, b, None if s == -1 else s) for x in best.values() for s, a, b in x[:5]}
    assert {(a, b, s) for a, b, s, _ in left} >= want
    for held in (1, 50):
        assert {tuple(x)[:3] for x in affinity.best_ends(d, 5, held).collect()} >= want
    assert {tuple(x) for x in affinity.top_union(d).collect()} == want


def test_partition_search_respects_bans():
    got = partition.search({i: 300_000 for i in range(6)}, [(0, 1, 5), (2, 3, 5), (4, 5, 5)], {i: {i % 2} for i in range(6)}, 3, forbidden=[(0, 2)])
    assert set(got) == set(range(6)) and got[0] == got[1] and got[0] != got[2]


def test_scores_are_looked_up_without_moving_an_edge(spark):
    r = random.Random(12)
    edges = spark.createDataFrame([(i, i + 1, round(r.random(), 2), round(r.random(), 2), None if r.random() < 0.1 else round(r.uniform(-1, 1), 2), i % 4) for i in range(900)], "src long, dst long, s_tnf double, s_abd double, s_cor double, nnz int").cache()
    got = graph.placed(edges)
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    low, n = graph.ranks(edges, "s_abd", "lo"), edges.count()
    want = graph.global_rank(graph.global_rank(edges, "s_tnf", "rank_tnf"), "s_cor", "rank_cor", highest=True)
    for name in ("tnf", "cor"):
        want = graph.at_rank(want, f"rank_{name}", low, "s_abd", "lo", n, f"m_{name}")
    columns = ["src", "s_tnf", "rank_tnf", "rank_cor", "m_tnf", "m_cor", "nnz"]
    assert rows(got, *columns) == rows(want, *columns) and len(rows(got, "src")) == 900
    assert graph.placed(edges.limit(0)).count() == 0


def test_names_are_joined_to_what_scores_leave(spark):
    edges = spark.createDataFrame([(a, b, 0.5 if b % 3 else 0.7) for b in range(30) for a in range(b)], "src long, dst long, score double")
    names = spark.createDataFrame([(i, f"c{i}") for i in range(30)], "contig_id long, name string")
    got = affinity.top_union(edges, names, 3)
    all_ = [(e.src, e.dst, e.score) for e in edges.collect()]
    want = {e for end in range(30) for e in sorted((e for e in all_ if end in e[:2]), key=lambda e: (e[2], f"c{e[0]}", f"c{e[1]}"), reverse=True)[:3]}
    assert {(e.src, e.dst, e.score) for e in got.collect()} == want
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.rindex("rank(score") > plan.rindex("Join")  # deeper in the plan, so before the joins


def test_fragments_are_composed_of_letters(spark):
    from pyspark.sql import functions as F

    from spindrift.operators import measure
    from spindrift.sources import fixtures

    r = random.Random(13)
    texts = ["".join(r.choice("abcXYZ qz-\u212a\u0130\u00e9\u00c5\u65e5\n4") for _ in range(n)) for n in (3000, 40, 0, 1700, 2500)] + [None, "\u212a" * 999, "\u0130" * 1000]
    docs = spark.createDataFrame([(i, t, "l", None) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string")
    seq = F.translate(F.regexp_replace(F.lower("text"), "[^a-z]", ""), fixtures.LETTERS, fixtures.BASES)
    contigs = docs.select(F.col("doc_id").alias("contig_id"), seq.alias("seq")).withColumn("length", F.length("seq").cast("long")).where("length >= 1000")
    got = fixtures.composed(docs.coalesce(1))
    assert rows(got, "contig_id", "length", "kmers") == rows(tnf.vectors(contigs, pack=True), "contig_id", "length", "kmers") and got.count() == 4
    depth = spark.createDataFrame([(i, "A", 5.0, 1.0) for i in range(8)], "contig_id long, sample string, mean double, var double")
    feats = got.join(measure.coverage(depth), "contig_id")
    wide = tnf.vectors(contigs).join(measure.coverage(depth), "contig_id")
    for limit in (0, 1 << 20):  # counts serve as well as vectors
        assert rows(graph.neighbours(feats, most=2, limit=limit).na.fill(-1), "src", "dst", "sim") == rows(graph.neighbours(wide, most=2, limit=limit).na.fill(-1), "src", "dst", "sim")


def test_few_edges_are_joined_up_by_one_task(spark, monkeypatch):
    r = random.Random(14)
    pairs = [(r.randrange(400), r.randrange(400)) for _ in range(230)] + [(500 + i, 501 + i) for i in range(70)]
    d = spark.createDataFrame(pairs, "a long, b long")
    tables = []
    monkeypatch.setattr(components, "written", lambda df, what, f=components.written: tables.append(what) or f(df, what))
    want = rows(components.connected_components(d, small=0), "node", "component")
    many = len(tables)
    assert rows(components.connected_components(d, small=40), "node", "component") == want  # rounds first
    del tables[:]
    assert rows(components.connected_components(d), "node", "component") == want and tables == ["edges", "hooks"] and many > 8


def test_wide_rows_reach_python_a_few_at_a_time(spark):
    from spindrift.plans.stage import batches_of
    from spindrift.sources import fixtures

    import pyarrow as pa

    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    sizes = lambda b: (pa.record_batch([pa.array([x.num_rows])], ["n"]) for x in b)
    with batches_of(spark, 100):
        assert max(r.n for r in spark.range(900).mapInArrow(sizes, "n long").collect()) == 100
    assert spark.conf.get(key) == before and fixtures.batches_of is batches_of


def test_small_groups_with_much_work_stay_apart(spark, monkeypatch):
    n = 200  # 100 components of two anchors that exclude each other
    seed = spark.createDataFrame([(c, 1) for c in range(n)], "contig_id long, bin_id long")
    conflicts = spark.createDataFrame([(1, c, c + 1, 90) for c in range(0, n, 2)], "bin_id long, c1 long, c2 long, d int")
    aff, pins = spark.createDataFrame([], "c long, anchor long, w int"), spark.createDataFrame([(1, 0)], "bin_id long, contig_id long")
    tables = {}
    monkeypatch.setattr(separate, "written", lambda df, what, f=separate.written: tables.setdefault(what, f(df.withColumn("_task", F.spark_partition_id()), what) if what == "separate-searched" else f(df, what)))
    got = separate.separate(seed, aff, conflicts, pins, 50)
    assert got.where("slot = 2").count() == n // 2
    assert tables["separate-searched"].select("_task").distinct().count() > 8


def test_small_components_are_packed_in_one_task_each(spark, monkeypatch):
    r = random.Random(15)
    aff = [(g, a, b, r.randint(1, 9)) for g in range(4) for a, b in itertools.permutations(range(g * 20, g * 20 + 9), 2) if r.random() < 0.3]
    pen = [(g, a, b, r.randint(1, 12)) for g in range(3) for a, b in itertools.combinations(range(g * 20, g * 20 + 9), 2) if r.random() < 0.4]
    kind = "component long, a long, b long, w int"
    aff, pen = spark.createDataFrame(aff, kind), spark.createDataFrame(pen, kind)
    tables = []
    monkeypatch.setattr(bounds, "written", lambda df, what, f=bounds.written: tables.append(what) or f(df, what))
    for rounds in (1, 5):
        want = rows(bounds.separate_bound(aff, pen, rounds, small=0), "component", "bound")
        del tables[:]
        assert rows(bounds.separate_bound(aff, pen, rounds), "component", "bound") == want and len(want) == 4
        assert len(tables) == 4  # as many for any number of rounds
    whole = dict(rows(aff.groupBy("component").agg(F.sum("w").alias("w")), "component", "w"))
    assert want[3][1] == whole[3] and all(b < whole[g] for g, b in want[:3])
