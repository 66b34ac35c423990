import re

import numpy as np
import xxhash
from pyspark.sql import functions as F
from tests.llm.util import docs, edge_rows, prose

from spindrift.llm import simhash


def slow_fingerprint(text, k=4):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not w:
        return 0
    sh = [" ".join(w[i : i + k]) for i in range(len(w) - k + 1)] or [" ".join(w)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def slow_components(ids, prints, radius=4):
    root = list(range(len(ids)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                root[find(i)] = find(j)
    least = {}
    for i, d in enumerate(ids):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return [least.get(find(i)) for i in range(len(ids))]


def test_fingerprint_is_the_definition():
    for t in ("", " ", "One", "one two", "A b C d E", prose(3, 200), "é É x Ä b c d", prose(4, 3)):
        assert simhash.fingerprint(t.encode()) == slow_fingerprint(t)


def test_whole_query_against_brute_force(spark):
    rows = edge_rows()
    for i in range(60):
        base = prose(i % 12, 120).split()
        base[i % 100] = f"edit{i}"
        rows.append((100 + i, " ".join(base)))
    got = simhash.near_duplicates(docs(spark, rows, extra=True), tree_size=5).collect()
    prints = [slow_fingerprint(t) for _, t in rows]
    want = sorted(zip([str(d) for d, _ in rows], prints, map(str, slow_components([d for d, _ in rows], prints))))
    assert sorted((str(r.doc_id), r.fp % (1 << 64), str(r.component_id)) for r in got) == want


def test_links_keep_all_components_with_and_without_blocks(spark):
    r = np.random.default_rng(0)
    centers = r.integers(0, 1 << 63, 8, dtype=np.int64)
    values = {int(c) for c in centers}
    for c in centers:
        x = int(c)
        for _ in range(60):
            for b in r.integers(0, 63, 3):
                x ^= 1 << int(b)
            values.add(x)
            if r.random() < 0.5:
                x = int(c)
    values = sorted(values)
    want = slow_components(values, values)
    nodes = spark.createDataFrame([(v,) for v in values], "fp long")
    for size in (1000, 7):
        reps = simhash.connected_components(simhash.links(nodes, 4, size))
        got = {x.node: x.component for x in reps.collect()}
        assert [got.get(v, v) for v in values] == want


def flipped(x, bits, r):
    for b in r.choice(64, bits, replace=False):
        x ^= 1 << int(b)
    return x


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def test_links_of_one_hot_group_grow_with_its_members(spark):
    """Near copies by the thousand: components as brute force, at most one row a member and shard that it is in."""
    r = np.random.default_rng(4)
    center = int(r.integers(1 << 62))
    rows = {}
    for n in (1000, 2000, 4000):
        values = sorted({signed(flipped(center, int(r.integers(1, 7)), r)) for _ in range(n)})
        u = np.array(values, np.int64).view(np.uint64)
        nodes = spark.createDataFrame([(v,) for v in values], "fp long")
        got = [(x.a, x.b) for x in simhash.links(nodes, 4, 100).collect()]
        rows[n] = len(got)
        assert len(got) <= 30 * len(values)
        assert all((a ^ b).bit_count() <= 4 for a, b in ((a % (1 << 64), b % (1 << 64)) for a, b in got))
        near = [np.flatnonzero(np.bitwise_count(u ^ x) <= 4) for x in u]
        assert parts(len(values), ((i, int(j)) for i, js in enumerate(near) for j in js)) == parts(len(values), ((values.index(a), values.index(b)) for a, b in got))
    assert rows[4000] <= 2.6 * rows[2000]


def parts(n, pairs):
    root = list(range(n))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i, j in pairs:
        a, b = find(i), find(j)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_forest_of_large_groups_is_complete():
    r = np.random.default_rng(6)
    for n, centers in ((60, 1), (300, 40), (500, 5), (49, 49)):
        c = [int(r.integers(1 << 62)) for _ in range(centers)]
        u = np.unique(np.array([flipped(c[i % centers], int(r.integers(0, 6)), r) for i in range(n)], np.uint64))
        got = simhash.forest(u, 4)
        index = {int(x): i for i, x in enumerate(u)}
        want = [(i, int(j)) for i, x in enumerate(u) for j in np.flatnonzero(np.bitwise_count(u ^ x) <= 4)]
        assert parts(len(u), want) == parts(len(u), ((index[a], index[b]) for a, b in got)) and len(got) < len(u)


def test_bk_tree_finds_exactly_the_radius():
    r = np.random.default_rng(1)
    values = [int(x) for x in r.integers(0, 1 << 12, 300)]
    tree = simhash.BKTree()
    for v in values:
        tree.add(v)
    for q in range(0, 1 << 12, 37):
        assert sorted(tree.within(q, 2)) == sorted({v for v in values if (v ^ q).bit_count() <= 2})


def test_empty_table(spark):
    assert simhash.near_duplicates(docs(spark, [])).count() == 0
    assert spark.range(1).select(F.lit(1)).count() == 1
