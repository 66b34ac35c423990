"""Hard negatives by the threshold algorithm over per-dimension sorted candidate lists.

Vectors are cut into whole numbers, so scores are exact. Candidates are dealt into shards of
about SHARD rows and anchors into blocks of about BLOCK; every shard meets every block once,
for each of two passes. A shard keeps one list of its rows for each dimension, sorted by that
component. An anchor walks all lists side by side, from the large end where its own component
is positive and from the small end where it is negative; each row met is scored at once by
random access. The threshold, the score that the components now at hand would give, bounds
every row not met yet. The walk stops once it lies strictly below the k-th score of each
window (or below the window), so that a row not met can't even tie.

The first pass finds an anchor's positives, with the rows of its own label as candidates; the
second its negatives, one window of scores for each positive, with the rows of other labels.
The best of the shards are merged by a window over at most k rows a shard.

Defined cases: rows with a null label, a null vector, or a null or non-finite component take
no part, nor do those with a component of 2 ** 18 / sqrt(length) or more in size, so that all
sums stay below 2 ** 52, where doubles are exact; a row with a null vec_id is no anchor and comes last among ties; repeated rows (equal
id, label and components) count once, and rows that only share a vec_id are rows each;
vectors of different lengths don't meet; an anchor without positives, or a window without
rows, gives no rows; a positive score below zero has an empty window; an empty table gives no
rows; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spindrift.llm import common

SHARD = 8192
BLOCK = 1024
POSITIVES = 5
NEGATIVES = 10
LOW, HIGH = 30, 90  # per cent of the positive's score
SCALE = 256
LARGEST = 1 << 18
LABELS = 10
FIRST_STEP = 16
_LAST = np.iinfo(np.int64).max


def quantised(vectors: DataFrame) -> DataFrame:
    """row (a hash that tells rows of one id apart), vec_id, label, q array<int>, dim of the rows that take part."""
    x = lambda v: v.cast("double")
    bad = F.exists("embedding", lambda v: v.isNull() | F.isnan(x(v)) | (F.abs(x(v)) * F.sqrt(F.size("embedding")) >= LARGEST))
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % LABELS).otherwise(F.col("label").cast("long"))
    d = vectors.where(F.col("label").isNotNull() & F.col("embedding").isNotNull() & ~bad)
    d = d.select(F.col("vec_id").cast("long").alias("vec_id"), label.alias("label"), F.transform("embedding", lambda v: F.floor(SCALE * x(v)).cast("int")).alias("q"))
    d = d.withColumn("row", F.xxhash64("vec_id", "label", "q")).withColumn("dim", F.size("q"))
    return d.dropDuplicates(["vec_id", "label", "q"])


class Lists:
    """One shard: its rows by ascending id, and for each dimension their numbers by ascending component."""

    def __init__(self, ids, rows, matrix):
        order = np.lexsort((rows, ids))
        self.at = order
        self.ids, self.rows, self.q = ids[order], rows[order], np.ascontiguousarray(matrix[order].astype(np.float64))
        self.n, self.dim = self.q.shape
        self.order = np.argsort(self.q, axis=0, kind="stable").T.astype(np.int32)
        self.met = 0  # rows scored by random access, for tests and logs

    def walk(self, anchor: np.ndarray, allowed: np.ndarray, enough) -> tuple[np.ndarray, np.ndarray]:
        """Numbers and scores of the allowed rows met before ``enough(scores, threshold)`` holds."""
        dims = np.flatnonzero(anchor)
        unseen = allowed.copy()
        found, scores = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        if not self.n or not len(dims):  # every score is zero
            rows = np.flatnonzero(unseen)
            return rows, np.zeros(len(rows), np.int64)
        up = anchor[dims] > 0
        depth, step = 0, FIRST_STEP
        left = int(unseen.sum())
        while left:
            to = min(self.n, depth + step)
            near = np.concatenate([self.order[dims[up], self.n - to : self.n - depth].ravel(), self.order[dims[~up], depth:to].ravel()])
            hit = np.zeros(self.n, bool)
            hit[near] = True
            new = np.flatnonzero(hit & unseen)
            unseen[new] = False
            left -= len(new)
            found.append(new)
            scores.append((self.q[new] @ anchor).astype(np.int64))
            self.met += len(new)
            if to == self.n:
                break
            row = np.where(up, self.order[dims, self.n - to], self.order[dims, to - 1])
            weights, here = anchor[dims].astype(np.int64), self.q[row, dims].astype(np.int64)
            if enough(np.concatenate(scores), int(weights @ here)):
                break
            depth, step = to, step * 2
        return np.concatenate(found), np.concatenate(scores)


def _kth(scores: np.ndarray, k: int):
    return np.partition(scores, len(scores) - k)[len(scores) - k] if len(scores) >= k else None


def best(ids: np.ndarray, rows: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best: highest score first, then smallest id."""
    if len(scores) > k:
        some = np.flatnonzero(scores >= _kth(scores, k))
    else:
        some = np.arange(len(scores))
    return some[np.lexsort((rows[some], ids[some], -scores[some]))][:k]


def _shard(t: pa.Table) -> tuple[Lists, np.ndarray]:
    ids = t["vec_id"].fill_null(_LAST).to_numpy()
    q = t["q"].combine_chunks()
    lists = Lists(ids, t["row"].to_numpy(), q.flatten().to_numpy().reshape(len(ids), -1))
    return lists, t["label"].to_numpy()[lists.at]


def _anchors(t: pa.Table):
    q = t["q"].combine_chunks()
    return t["a_row"].to_numpy(), t["label"].to_numpy(), q.flatten().to_numpy().reshape(t.num_rows, -1).astype(np.float64)


_FOUND = "a_row long, p_row long, positive_id long, positive_score long, row long, vec_id long, score long"
_KIND = pa.schema([(c.split()[0], pa.int64()) for c in _FOUND.split(", ")])


def _positives(shard: pa.Table, anchors: pa.Table, k: int) -> pa.Table:
    if not shard.num_rows or not anchors.num_rows:
        return _KIND.empty_table()
    lists, label = _shard(shard)
    of = {int(x): label == x for x in np.unique(label)}
    out = []
    for a_row, a_label, q in zip(*_anchors(anchors)):
        if int(a_label) not in of:
            continue
        allowed = of[int(a_label)] & (lists.rows != a_row)

        def enough(scores, threshold):
            kth = _kth(scores, k)
            return kth is not None and threshold < kth

        at, scores = lists.walk(q, allowed, enough)
        for x in best(lists.ids[at], lists.rows[at], scores, k):
            out.append((a_row, 0, 0, 0, lists.rows[at[x]], lists.ids[at[x]], scores[x]))
    return _table(out)


def _negatives(shard: pa.Table, anchors: pa.Table, k: int, low: int, high: int) -> pa.Table:
    if not shard.num_rows or not anchors.num_rows:
        return _KIND.empty_table()
    lists, label = _shard(shard)
    out = []
    positives = anchors["positives"].to_pylist()
    for a_row, a_label, q, own in zip(*_anchors(anchors), positives):
        windows = [p for p in own if low * p["score"] <= high * p["score"]]

        def inside(scores, p):
            return (100 * scores >= low * p["score"]) & (100 * scores <= high * p["score"])

        def enough(scores, threshold):
            for p in windows:
                if 100 * threshold >= low * p["score"]:
                    kth = _kth(scores[inside(scores, p)], k)
                    if kth is None or threshold >= kth:
                        return False
            return True

        at, scores = lists.walk(q, label != a_label, enough)
        for p in windows:
            some = np.flatnonzero(inside(scores, p))
            for x in some[best(lists.ids[at[some]], lists.rows[at[some]], scores[some], k)]:
                out.append((a_row, p["row"], p["vec_id"], p["score"], lists.rows[at[x]], lists.ids[at[x]], scores[x]))
    return _table(out)


def _table(rows: list[tuple]) -> pa.Table:
    cols = list(zip(*rows)) if rows else [()] * len(_KIND)
    made = {name: np.array(c, np.int64) for name, c in zip(_KIND.names, cols)}
    ids = {c: pa.array(v, mask=v == _LAST) if c in ("vec_id", "positive_id") else pa.array(v) for c, v in made.items()}
    return pa.table(ids, schema=_KIND)


def _met(candidates: DataFrame, anchors: DataFrame, sizes: tuple[int, int], meet) -> DataFrame:
    """``meet`` of every shard of candidates with every block of anchors of the same length of vectors."""
    shards, blocks = sizes
    left = candidates.withColumn("shard", F.pmod("row", F.lit(shards))).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    right = anchors.withColumn("block", F.pmod("a_row", F.lit(blocks)).cast("int")).withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))))
    right = right.withColumnsRenamed({c: f"{c}_r" for c in right.columns})  # names of its own: the two sides stem from one table

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        return meet(a, b.rename_columns([c.removesuffix("_r") for c in b.column_names]))

    return left.groupBy("dim", "shard", "block").cogroup(right.groupBy("dim_r", "shard_r", "block_r")).applyInArrow(run, _FOUND)


def mine(rows: DataFrame, anchor_every: int = 100, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, shard: int = SHARD, block: int = BLOCK) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score of ``quantised`` rows."""
    rows = common.written(rows, "negatives-rows")
    anchors = rows.where(F.col("vec_id") % anchor_every == 0).select(F.col("row").alias("a_row"), F.col("vec_id").alias("anchor_id"), "label", "q", "dim")
    sizes = (max(1, -(-rows.count() // shard)), max(1, -(-anchors.count() // block)))
    near = _met(rows, anchors.drop("anchor_id"), sizes, lambda a, b: _positives(a, b, positives))
    order = [F.desc("score"), F.asc_nulls_last("vec_id"), F.asc("row")]
    near = near.withColumn("n", F.row_number().over(Window.partitionBy("a_row").orderBy(*order))).where(F.col("n") <= positives)
    of = near.groupBy("a_row").agg(F.collect_list(F.struct("row", F.coalesce("vec_id", F.lit(_LAST)).alias("vec_id"), "score")).alias("positives"))
    asked = common.written(anchors.join(of, "a_row"), "negatives-asked")
    far = _met(rows, asked.drop("anchor_id"), sizes, lambda a, b: _negatives(a, b, negatives, low, high))
    far = far.withColumn("rank", F.row_number().over(Window.partitionBy("a_row", "p_row").orderBy(*order))).where(F.col("rank") <= negatives)
    return far.join(asked.select("a_row", "anchor_id"), "a_row").select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def op11_fagin_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mine(quantised(common.table(spark, sf_dir, "embeddings")))


QUERIES = {"op11_fagin_negatives": op11_fagin_negatives}
ORACLE_SQL = {
    "op11_fagin_negatives": f"""
WITH r AS (SELECT DISTINCT vec_id, (CASE WHEN vec_id % 7 = 0 THEN (label::BIGINT + 1) % {LABELS} ELSE label END)::BIGINT AS label,
    [floor({SCALE} * x::DOUBLE) for x in embedding] AS q FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_inner_product(a.q, b.q)::BIGINT AS score
  FROM r a JOIN r b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= {POSITIVES})
SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)::INT AS rank,
  vec_id AS negative_id, positive_score, score AS negative_score
FROM s JOIN p USING (anchor_id) WHERE NOT same AND {LOW} * positive_score <= 100 * score AND 100 * score <= {HIGH} * positive_score
QUALIFY rank <= {NEGATIVES}"""
}
