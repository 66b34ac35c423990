"""Token ids in ORC files: run-length encoded integers, row indexes, Bloom filters on document ids.

Texts are range-partitioned and sorted by ``doc_id``, encoded by Arrow batch, and written as
one ORC file a partition. ORC's integer run-length encoding stores the ids; stripes are the
unit of parallel reads, and min/max row indexes together with the Bloom filter let a lookup
by ``doc_id`` skip stripes and row groups without decoding them.

Defined cases: null or empty texts hold the end id alone; rows with a null ``doc_id`` come
first; rows that repeat a ``doc_id`` all stay and are counted in (n_tokens, ids_crc32) order;
an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from spindrift.llm import common, tokens

END_ID = 2
ORC_OPTIONS = {
    "compression": "zstd",
    "orc.bloom.filter.columns": "doc_id",
    "orc.bloom.filter.fpp": "0.01",
    "orc.create.index": "true",
    "orc.row.index.stride": "2000",
    "orc.stripe.size": str(32 << 20),
}


def encode(docs: DataFrame, tokenizer: str | None = None, end_id: int = END_ID) -> DataFrame:
    """doc_id, ids array<int> of every row, each text's ids followed by ``end_id``."""
    path = tokenizer or tokens.default_path()

    def run(batches):
        words = tokens.words(path)
        for b in common.slices(batches):
            ids, at = words.encode(common.texts(b.column(1)))
            n = len(at) - 1
            ends = at[1:] + np.arange(1, n + 1)
            out = np.full(len(ids) + n, end_id, np.int32)
            keep = np.ones(len(out), bool)
            keep[ends - 1] = False
            out[keep] = ids
            offsets = np.concatenate([[0], ends]).astype(np.int32)
            yield pa.record_batch([b.column(0), pa.ListArray.from_arrays(offsets, out)], ["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>")


def write(docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int = END_ID) -> None:
    """Write the ids of every document to ORC files under ``path``, file after file in ascending doc_id order."""
    ordered = docs.select("doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    encode(ordered, tokenizer, end_id).write.options(**ORC_OPTIONS).mode("overwrite").orc(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """The files as doc_id, ids; filters on doc_id reach the row indexes and Bloom filters."""
    return spark.read.schema("doc_id long, ids array<int>").orc(path)


def digest(stored: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids_crc32 of stored ids."""

    def run(batches):
        for b in batches:
            ids = b.column(1)
            at = ids.offsets.to_numpy()
            data = memoryview(np.ascontiguousarray(ids.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False))).cast("B")
            crc = [zlib.crc32(data[4 * i : 4 * j]) for i, j in zip(at[:-1].tolist(), at[1:].tolist())]
            yield pa.record_batch([b.column(0), pa.array(np.diff(at).astype(np.int64)), pa.array(crc, pa.int64())], ["doc_id", "n_tokens", "ids_crc32"])

    return stored.select("doc_id", "ids").mapInArrow(run, "doc_id long, n_tokens long, ids_crc32 long")


def index(stored: DataFrame) -> DataFrame:
    """digest() with ``start``: the ids of all documents before this one."""
    slim = common.written(digest(stored), "orc-digest")
    return common.before(slim, "doc_id", "n_tokens", "start", "n_tokens", "ids_crc32").select("doc_id", "start", "n_tokens", "ids_crc32")


def op6_token_orc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = common.scratch(spark, "token-orc")
    write(common.table(spark, sf_dir, "documents"), path)
    return index(read(spark, path))


QUERIES = {"op6_token_orc": op6_token_orc}
ORACLE_SQL: dict[str, str] = {}
