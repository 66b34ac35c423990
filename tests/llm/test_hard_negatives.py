import math

import numpy as np
import pytest

from spindrift.llm import hard_negatives as hn

SCHEMA = "vec_id long, embedding array<float>, label int"
COLUMNS = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def slow(rows):
    """The contract on (vec_id, embedding, label) rows."""
    kept = {}
    for i, v, label in rows:
        if label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        label = int(math.fmod(label + 1, 10)) if i is not None and i % 7 == 0 else label
        kept[i, label, tuple(math.floor(256 * float(np.float32(x))) for x in v)] = True
    kept = list(kept)
    big = lambda i: i if i is not None else 1 << 70
    out = []
    for a in kept:
        if a[0] is None or a[0] % 100:
            continue
        near = sorted(((-sum(x * y for x, y in zip(a[2], b[2])), big(b[0]), b) for b in kept if b != a and len(b[2]) == len(a[2])), key=lambda x: x[:2])
        for ps, _, p in [x for x in near if x[2][1] == a[1]][:5]:
            inside = [(s, b) for s, _, b in near if b[1] != a[1] and 30 * -ps <= 100 * -s <= 90 * -ps]
            out += [(a[0], p[0], k, b[0], -ps, -s) for k, (s, b) in enumerate(inside[:10], 1)]
    return sorted(out, key=str)


def mined(spark, rows, **sizes):
    d = spark.createDataFrame(rows, SCHEMA).withColumn("row", hn.F.lit("clash")).withColumn("q", hn.F.lit(1))
    return sorted((tuple(r) for r in hn.mine(hn.quantised(d), **sizes).select(*COLUMNS).collect()), key=str)


def vectors(seed, n, dim=6, step=50):
    r = np.random.default_rng(seed)
    return [(int(i) * step // 2, (r.normal(size=dim) * 0.5).astype(np.float32).tolist(), int(r.integers(0, 3))) for i in range(n)]


@pytest.mark.parametrize("sizes", [{}, {"shard": 40, "block": 7}])
def test_whole_query_against_brute_force(spark, sizes):
    rows = vectors(1, 300)
    rows += [(100_000, None, 1), (100_100, [0.1] * 6, None), (100_200, [0.1, None, 0.1, 0.1, 0.1, 0.1], 1), (100_300, [float("nan")] * 6, 1), (100_400, [float("inf")] * 6, 1), (None, [0.5] * 6, 2)]
    rows += [(100_500, [0.0] * 6, 1), (100_600, [-0.5] * 6, 2), (100_700, [0.25] * 3, 1), (100_701, [0.25] * 3, 1), (100_702, [0.2] * 3, 2), (700_000, [], 1), (700_001, [], 1), (700_002, [], 0)]
    rows += [(200_000 + i, [0.5, 0.25, 0.0, 0.0, 0.0, 0.0], i % 2) for i in range(120)]  # ties across labels and ids
    rows += rows[:5]
    assert mined(spark, rows, **sizes) == slow(rows)


def test_no_rows(spark):
    assert mined(spark, []) == []
    assert mined(spark, [(100, [1.0, 1.0], 3), (101, [1.0, 1.0], 4)]) == []  # no positive
    assert mined(spark, [(100, [float(1 << 30)], 3), (101, [1.0], 3)]) == []  # beyond exact sums


def test_walk_stops_before_the_end_and_is_exact():
    r = np.random.default_rng(2)
    q = np.floor(256 * r.normal(size=(5000, 4)) * r.gamma(1, 1, size=(5000, 1)))
    lists = hn.Lists(np.arange(5000), np.arange(5000), q)
    anchor = np.array([3.0, -200.0, 90.0, 0.0])

    def enough(scores, threshold):
        kth = hn._kth(scores, 10)
        return kth is not None and threshold < kth

    at, scores = lists.walk(anchor, np.ones(5000, bool), enough)
    assert lists.met == len(at) < 1500
    own = q @ anchor
    assert [lists.ids[at[x]] for x in hn.best(lists.ids[at], lists.rows[at], scores, 10)] == np.lexsort((np.arange(5000), -own))[:10].tolist()
