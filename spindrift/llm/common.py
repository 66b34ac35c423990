"""What several corpus operators share: the shared folder, materialising, ordered prefix sums, held-out rule, Arrow helpers."""

from __future__ import annotations

import os
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spindrift.plans import stage
from spindrift.plans.stage import scratch, shared_dir  # noqa: F401

# One Python process per task slot: native libraries must not start threads of their own.
os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
os.environ.setdefault("OMP_NUM_THREADS", "1")
os.environ.setdefault("OPENBLAS_NUM_THREADS", "1")


BATCH_ROWS = 1000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of BATCH_ROWS rows instead of Spark's 10000, unless the session says otherwise: texts are long, and a batch is held by the JVM and by the worker."""
    if not spark.sparkContext.getConf().contains(_BATCH) and spark.conf.get(_BATCH) == "10000":
        spark.conf.set(_BATCH, BATCH_ROWS)


def written(df: DataFrame, what: str) -> DataFrame:
    small_batches(df.sparkSession)
    return stage.written(df, what)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unused(df: DataFrame, name: str) -> str:
    """A column name like ``name`` that ``df`` does not have (Spark's names ignore case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def forget(spark: SparkSession, df: DataFrame) -> None:
    """Delete the files of a ``written`` table that nothing reads any more."""
    for f in {os.path.dirname(x) for x in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(f)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def held(doc_id, modulus: int, remainder: int):
    """The held-out rule of the contracts: crc32 of the id's decimal text."""
    return F.crc32(doc_id.cast("string").cast("binary")) % modulus == remainder


def held_py(doc_id: int, modulus: int, remainder: int) -> bool:
    return zlib.crc32(str(doc_id).encode()) % modulus == remainder


def texts(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    """A string column as one array, nulls as empty texts."""
    import pyarrow.compute as pc

    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "")
    return column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a large_string array and its n + 1 offsets from 0, without copying the text."""
    n = len(column)
    offsets = np.frombuffer(column.buffers()[1], np.int64, n + 1, column.offset * 8)
    if n == 0 or column.buffers()[2] is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def slices(batches, limit: int = 2 << 20):
    """Arrow batches cut to about ``limit`` bytes each, so that a worker's memory is bounded by the longest text and not by the batch's row count."""
    for b in batches:
        per = max(1, b.nbytes // max(1, b.num_rows))
        step = max(1, limit // per)
        for at in range(0, b.num_rows, step):
            part = b.slice(at, step)
            if part.num_rows > 1 and part.nbytes > 4 * limit:
                for i in range(part.num_rows):
                    yield part.slice(i, 1)
            else:
                yield part
    _trim()


def _trim() -> None:
    """Give a worker's free memory back: it lives on through stages that need it elsewhere."""
    import ctypes

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass


BUCKET_ROWS = 500
MOST_BUCKETS = 65_536


def id_buckets(slim: DataFrame, key: str, rows: int = BUCKET_ROWS) -> tuple:
    """A monotone bucket expression for ``key`` with about ``rows`` ids a bucket and about MOST_BUCKETS at most, and the number of buckets.

    Equal widths first; a bucket with far more ids than meant is cut again between its own
    smallest and largest id, until none is (ids that are one value cannot be cut). Each cut
    is a count of at most two buckets' rows for every bucket, and an expression over literals,
    so that it is the same on every retry. Null keys have a bucket before all others.
    """
    lo, hi, n = slim.agg(F.min(key), F.max(key), F.count(key)).first()
    if not n:
        return (lambda c: F.lit(0).cast("long")), 1
    coarse = 2 if hi - lo >= 1 << 62 else 0  # differences stay within a long
    rows = max(rows, -(-n // MOST_BUCKETS))
    ids = slim.where(F.col(key).isNotNull()).select(F.shiftright(F.col(key).cast("long"), coarse).alias("k"))
    steps = [_even([(int(lo) >> coarse, int(hi) >> coarse, int(n))], rows)]

    def bucket(k, steps):
        at = F.lit(0).cast("long")
        for base, first, width in steps:
            x, w = k - F.get(_longs(first), at.cast("int")), F.get(_longs(width), at.cast("int"))
            at = F.get(_longs(base), at.cast("int")) + F.floor((x - F.pmod(x, w)) / w + 0.5).cast("long")
        return at

    while True:
        got = {int(r[0]): (int(r[1]), int(r[2]), int(r[3])) for r in ids.groupBy(bucket(F.col("k"), steps)).agg(F.min("k"), F.max("k"), F.count(F.lit(1))).collect()}
        if not any(c > 4 * rows and b > a for a, b, c in got.values()):
            return (lambda c: F.coalesce(bucket(F.shiftright(c.cast("long"), coarse), steps), F.lit(-1).cast("long"))), max(got) + 1
        steps.append(_even([got.get(i, (0, 0, 0)) for i in range(max(got) + 1)], rows))


def _longs(values: list[int]):
    """An array literal of longs; one string, as many single literals are slow to make."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")


def _even(cells: list[tuple[int, int, int]], rows: int) -> tuple[list, list, list]:
    """For each cell (least id, largest id, ids) the number of its first bucket, the id where that begins, and the width of its buckets."""
    base, first, width, at = [], [], [], 0
    for lo, hi, n in cells:
        k = max(1, min(-(-n // rows), hi - lo + 1)) if n > 4 * rows or len(cells) == 1 else 1
        base.append(at)
        first.append(lo)
        width.append(-(-(hi - lo + 1) // k) if k > 1 else 1 << 62)
        at += k
    return base, first, width


def before(slim: DataFrame, key: str, value: str, out: str, *ties: str) -> DataFrame:
    """Adds ``out``: the sum of ``value`` over all rows before this one in ascending ``key`` (then ``ties``) order.

    Two levels: sums per id bucket (MOST_BUCKETS at most) are accumulated in one small
    window; inside a bucket a partitioned window continues from there. No task sees all rows.
    """
    bucket, _ = id_buckets(slim, key)
    d = slim.withColumn("_b", bucket(F.col(key)))
    sums = d.groupBy("_b").agg(F.sum(value).alias("_s"))
    ends = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("_b", F.coalesce(F.sum("_s").over(ends), F.lit(0)).alias("_base"))
    own = Window.partitionBy("_b").orderBy(key, *ties).rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumn("_in", F.coalesce(F.sum(value).over(own), F.lit(0)))
    return d.join(sums, "_b").withColumn(out, F.col("_base") + F.col("_in")).drop("_b", "_in", "_base")
