"""Bounded, reproducible samples of labelled documents for fitting classifiers.

The bound is a parameter: about ``per_class`` rows of each class, and about MOST_ROWS rows in
all, dealt evenly to however many classes there are. Rows are chosen by a hash of the
document id, so the sample does not depend on partitioning and grows no further with the
corpus. Held-out rows are never among them. Texts of the sample are whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from spindrift.llm import common

_SPACE = 1 << 30
MOST_ROWS = 40_000


def fractions(counts: dict, per_class: int) -> dict:
    return {c: min(1.0, per_class / n) for c, n in counts.items() if n}


def choose(rows: DataFrame, key: str, label: str, per_class: int, most: int = MOST_ROWS) -> tuple[list[tuple], dict]:
    """(key, label) pairs of the sample, and how many rows each class has in all. More classes than ``most`` can't have a row each: the most frequent ones have."""
    counts = {r[0]: int(r[1]) for r in rows.groupBy(label).count().orderBy(F.desc("count"), label).limit(most).collect()}
    per_class = max(1, min(per_class, most // max(1, len(counts))))
    schema = StructType([StructField("_label", rows.schema[label].dataType), StructField("_share", DoubleType())])
    share = rows.sparkSession.createDataFrame(list(fractions(counts, per_class).items()), schema)
    drawn = rows.select(key, label).join(F.broadcast(share), F.col(label) == F.col("_label"))  # at most ``most`` rows
    drawn = drawn.where(F.pmod(F.xxhash64(F.lit("sample"), F.col(key)), F.lit(_SPACE)) < F.col("_share") * _SPACE)
    got = drawn.orderBy(F.xxhash64(key), key).limit(2 * per_class * max(1, len(counts))).select(key, label).collect()
    return sorted((int(r[0]), r[1]) for r in got), counts


def within(rows: DataFrame, most_bytes: int) -> DataFrame:
    """``rows`` (doc_id, text, label: a sample) in the order of their ids' hashes, as long as their class's whole texts before them hold less than ``most_bytes``."""
    sizes = rows.select("doc_id", "label", F.coalesce(F.octet_length("text"), F.lit(0)).alias("n"), F.xxhash64("doc_id").alias("h")).collect()
    held: dict = {}
    kept = set()
    for r in sorted(sizes, key=lambda r: (r.h, r.doc_id)):
        if held.get(r.label, 0) < most_bytes:
            kept.add(r.doc_id)
        held[r.label] = held.get(r.label, 0) + r.n
    ids = rows.sparkSession.createDataFrame([(i,) for i in sorted(kept)], "_id long")
    return rows.join(F.broadcast(ids), F.col("doc_id") == F.col("_id"), "left_semi")


def labelled(docs: DataFrame, labels: DataFrame, label: str, modulus: int, remainder: int, per_class: int) -> tuple[DataFrame, dict]:
    """doc_id, text, label of the sampled rows, and the classes' sizes. A label that is null is none; repeated labels count once, as their largest."""
    usable = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~common.held(F.col("doc_id"), modulus, remainder))
    usable = usable.groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
    chosen, counts = choose(usable, "doc_id", "label", per_class)
    small = docs.sparkSession.createDataFrame(chosen, "doc_id long, label int")
    # at most 2 * per_class * classes rows
    return docs.select("doc_id", "text").join(F.broadcast(small), "doc_id"), counts
