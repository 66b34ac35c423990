import importlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F
from tests.llm.util import docs, edge_rows, prose

from spindrift.llm import simhash

pipeline = importlib.import_module("corpus_pipeline")


def jaccard(a, b):
    x, y = simhash.shingle_set(a.encode(), 5), simhash.shingle_set(b.encode(), 5)
    return len(x & y) / len(x | y) if x | y else 1.0


def test_near_duplicate_stage_against_brute_force(spark):
    rows = edge_rows()
    for g in range(10):
        base = prose(g, 260).split()
        for i in range(6):
            words = list(base)
            words[20 + 7 * i] = f"edit{i}"
            rows.append((100 + 10 * g + i, " ".join(words)))
    rows += [(500 + i, prose(50 + i, 100)) for i in range(20)] + [(600, prose(3, 260)), (600, prose(3, 260))]
    d = docs(spark, rows, extra=True)
    kept = simhash.keep_one(d, tree_size=7)
    assert kept.columns == d.columns
    got = sorted(str(r.doc_id) for r in kept.collect())
    prints = [simhash.fingerprint((t or "").encode(), 5) for _, t in rows]

    def keepers(radius):
        root = list(range(len(rows)))

        def find(i):
            while root[i] != i:
                i = root[i]
            return i

        for i in range(len(rows)):
            for j in range(i):
                if (prints[i] ^ prints[j]).bit_count() <= radius and jaccard(rows[i][1] or "", rows[j][1] or "") >= 0.8:
                    root[find(i)] = find(j)
        groups = {}
        for i, (k, _) in enumerate(rows):
            groups.setdefault(find(i), []).append(k)
        return sorted(str(min((k for k in g if k is not None), default=None)) for g in groups.values())

    # a link is a similarity of 0.8, however many bits of a fingerprint differ
    assert got == keepers(64)


def test_near_duplicates_are_all_found(spark):
    rows = []
    for i in range(12):  # one repeated line fixes the fingerprint; 2 and 3, 4 and 5, .. are alike, 0 and 1 stand alone
        words = prose(700 + (i // 2 if i > 1 else 90 + i), 100).split()
        words[:1] = [f"own{i}"]
        rows.append((i, ("the line that stands here again and again and " * 60) + " ".join(words)))
    for g in range(40):  # held-out edits down to a similarity of 0.8 and below
        base = prose(900 + g, 220).split()
        rows.append((100 + 2 * g, " ".join(base)))
        for k in range(3 + g % 4):
            base[10 + 30 * k] = f"edit{k}"
        rows.append((101 + 2 * g, " ".join(base)))
    prints = {simhash.fingerprint(t.encode(), 5) for i, t in rows if i < 12}
    assert len(prints) == 1
    gone = {j for j, y in rows if any(i < j and jaccard(x, y) >= 0.8 for i, x in rows)}
    assert len(gone) > 15 and {3, 5, 7, 9, 11} <= gone
    assert {r.doc_id for r in simhash.keep_one(docs(spark, rows)).collect()} == {i for i, _ in rows} - gone


def test_sketches_never_say_too_little():
    r = np.random.default_rng(3)
    for n in (0, 1, 40, 300, 5000, 90_000):
        x = np.unique(r.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2))
        for share, more in ((1.0, 0), (0.9, n // 20), (0.5, n), (0.0, 2 * n)):
            y = np.unique(np.concatenate([r.choice(x, int(share * n), replace=False) if n else x, r.integers(0, 1 << 63, more, dtype=np.uint64) * np.uint64(2) + np.uint64(1)]))
            both = len(np.intersect1d(x, y))
            bound = simhash.may_share(simhash.sketch(x), simhash.sketch(y))
            assert bound >= both
            if n >= 300 and share == 0.0 and more:
                assert min(bound, len(x)) < 0.88 * len(x)  # and tell unlike sets apart
    assert simhash.may_share(b"", simhash.sketch(x)) == float("inf")


def test_kept_rows_keep_clashing_columns(spark):
    names = ["_own", "own", "md5", "_md5", "keep", "_keep", "chosen", "_chosen", "KEEP"]
    d = docs(spark, edge_rows()).drop("lang").withColumns({c: F.lit(i) for i, c in enumerate(names[:8])})
    kept = simhash.keep_one(d)
    assert kept.columns == d.columns
    assert kept.select(*names[:8]).distinct().collect() == [tuple(range(8))]


def test_stages_of_edge_rows(spark, tmp_path):
    """Nulls, blanks, repeats, long texts, clashing names and an empty table, through each stage."""
    sf = str(tmp_path)
    rows = edge_rows() + [(100 + i, prose(i, 80)) for i in range(20)]
    spark.createDataFrame([(i, i % 2, 0) for i in range(20)] + [(None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    spark.createDataFrame([(1, rows[-1][1]), (2, None), (None, " ")], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    for table in (docs(spark, rows, extra=True), docs(spark, [], extra=True)):
        n, given = table.count(), Counter(table.collect())
        for name, stage in pipeline.STAGES[:-1]:
            got = stage(spark, table, sf)
            assert got.columns == table.columns and Counter(got.collect()) <= given, name
        packed = pipeline.STAGES[-1][1](spark, table, sf)
        assert len(packed.select("doc_id", "piece", "ids_crc32", "sequence_id", "offset").collect()) >= n


def test_stages_keep_columns_and_shrink(spark):
    sf = "/root/testdata/sf0.001"
    d = spark.read.parquet(f"{sf}/documents.parquet")
    n, names = d.count(), d.columns
    from spindrift.llm import common

    for k, (name, stage) in enumerate(pipeline.STAGES):
        d = common.written(stage(spark, d, sf), f"stage-{k}")
        if k < 4:
            assert d.columns == names and 0 < d.count() <= n, name
            n = d.count()
    assert {"doc_id", "piece", "sequence_id", "offset"} <= set(d.columns)
    assert d.select("doc_id").distinct().count() == n
