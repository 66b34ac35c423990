"""Token counts through a digest cache.

The cache is a Parquet table of (content, n_tokens), one folder for each tokenizer version.
``content`` is the SHA-256 of a text in normal form, in which texts of one count meet; the
version is the SHA-256 of the tokenizer's file, of the library's version and of the normal
form's. A run digests every text where it lies, joins the distinct digests to the cache,
encodes one text of each that is missing, appends what it found in one commit, and joins
all documents to the counts.

Texts stay where they are while two bit maps, of 16 MB at most each, can tell the rows to
encode from all others; rows for which they can't (where both claim the row, as they do for
most rows of a corpus far beyond their size) go through an exact join. Digests of more than
a thousandth of all rows, a thousand at most, are joined by broadcast, all others by shuffle.

Defined cases: a null or empty text has 0 tokens and 0 bytes; special strings in a text are
the tokenizer's special tokens, as by the library's default; rows that repeat a text share
one cache entry and each get a result row; a null doc_id is kept; an empty table gives no
rows; extra columns are ignored; texts are read whole, however long. Runs at the same time
may append one digest twice, with equal counts; readers take it once.
"""

from __future__ import annotations

import hashlib
from importlib.metadata import version

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.llm import common, tokens

LIMIT = 2048
NORMAL_FORM = "1"
MOST_BITS = 27
HOT_SHARE = 1000
_CACHE = "content binary, n_tokens long"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def normal_form(text):
    """A text of the same token ids: runs of ASCII white space become one space, those at the ends go, and plain ASCII is lower-cased.

    The tokenizer lower-cases after it composes characters, so other texts keep their case; a
    text that may hold a special string, which is matched before all that, stays as it is.
    """
    slim = F.trim(F.regexp_replace(text, "[ \\t\\n\\x0B\\f\\r]+", " "))
    slim = F.when(F.octet_length(slim) == F.char_length(slim), F.translate(slim, _UPPER, _LOWER)).otherwise(slim)
    return F.when(F.contains(text, F.lit("<|")), text).otherwise(slim)


def content_digest(text):
    return F.unhex(F.sha2(normal_form(F.coalesce(text, F.lit(""))).cast("binary"), 256))


def tokenizer_version(path: str) -> str:
    h = hashlib.sha256(f"tokenizers {version('tokenizers')} normal form {NORMAL_FORM}\n".encode())
    with open(path, "rb") as f:
        for block in iter(lambda: f.read(1 << 20), b""):
            h.update(block)
    return h.hexdigest()


def cached(spark: SparkSession, cache: str, tokenizer: str) -> DataFrame:
    """content, n_tokens of one tokenizer version; no rows while nothing has been stored."""
    path = f"{cache}/tokenizer={tokenizer}"
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], _CACHE)
    return spark.read.schema(_CACHE).parquet(path).groupBy("content").agg(F.max("n_tokens").alias("n_tokens"))


def _hash():
    return F.xxhash64("content", "doc_id")


def _slots(h, bits: int) -> list:
    return [F.shiftrightunsigned(h, 64 - bits), F.pmod(h, F.lit(1 << bits))]


def bit_map(rows: DataFrame, bits: int) -> np.ndarray:
    """Two bits of each row's hash set in a map of 2 ** bits; words are combined on the executors."""
    slot = rows.select(F.explode(F.array(*_slots(_hash(), bits))).alias("slot"))
    words = slot.select(F.shiftright("slot", 6).alias("word"), F.expr("shiftleft(1L, cast(slot & 63 as int))").alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(1 << (bits - 6), np.uint64)
    out[words.column("word").to_numpy()] = words.column("bits").to_numpy().view(np.uint64)
    return out


def _set(table: np.ndarray, h: np.ndarray, bits: int) -> np.ndarray:
    u = h.view(np.uint64)
    got = np.ones(len(h), bool)
    for slot in (u >> np.uint64(64 - bits), u & np.uint64((1 << bits) - 1)):
        got &= (table[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63))) & np.uint64(1) == 1
    return got


def encoded(rows: DataFrame, path: str) -> DataFrame:
    """content, n_tokens of rows (content, text)."""

    def run(batches):
        words = tokens.words(path)
        for b in common.slices(batches):
            _, at = words.encode(common.texts(b.column(1)))
            yield pa.record_batch([b.column(0), pa.array(np.diff(at), pa.int64())], ["content", "n_tokens"])

    return rows.select("content", "text").mapInArrow(run, _CACHE)


def misses(docs: DataFrame, slim: DataFrame, stored: DataFrame, path: str, most_bits: int = MOST_BITS) -> DataFrame:
    """content, n_tokens of the digests in ``slim`` (doc_id, content) that are not in ``stored``: one text of each is encoded.

    ``docs`` has doc_id and text. The row encoded for a digest is that of its smallest doc_id.
    """
    spark = docs.sparkSession
    first = slim.groupBy("content").agg(F.min("doc_id").alias("doc_id")).join(stored.select("content"), "content", "left_anti")
    lead = common.written(first, "token-leads")
    n = slim.count()
    rows = docs.select("doc_id", "text", content_digest(F.col("text")).alias("content"))
    keys = lead.select(F.col("content").alias("_content"), F.col("doc_id").alias("_id"))
    exact = lambda d: d.join(keys, (F.col("content") == F.col("_content")) & F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi")
    bits = min(most_bits, max(12, (16 * n).bit_length()))
    if n > 1 << bits:
        return encoded(exact(rows), path).dropDuplicates(["content"])
    other = slim.join(keys, (F.col("content") == F.col("_content")) & F.col("doc_id").eqNullSafe(F.col("_id")), "left_anti")
    box = spark.sparkContext.broadcast((bit_map(lead, bits), bit_map(other, bits)))  # 2 ** most_bits bits each at most

    def sorted_out(batches, sure: bool):
        asked, left = box.value
        for b in batches:
            h = b.column(2).to_numpy()
            take = _set(asked, h, bits)
            if sure:
                take &= ~_set(left, h, bits)
            else:
                take &= _set(left, h, bits)
            yield b.filter(pa.array(take))

    def place(batches):
        words = tokens.words(path)
        for b in common.slices(sorted_out(batches, True)):
            _, at = words.encode(common.texts(b.column(1)))
            yield pa.record_batch([b.column(0), pa.array(np.diff(at), pa.int64())], ["content", "n_tokens"])

    hashed = rows.select("content", "text", _hash().alias("h"), "doc_id")
    here = hashed.mapInArrow(place, _CACHE)
    unsure = hashed.mapInArrow(lambda batches: sorted_out(batches, False), hashed.schema)
    return here.unionByName(encoded(exact(unsure), path)).dropDuplicates(["content"])


def count_tokens(docs: DataFrame, cache: str, tokenizer: str | None = None, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every row; what was not in the cache is appended to it."""
    spark = docs.sparkSession
    path = tokenizer or tokens.default_path()
    key = tokenizer_version(path)
    slim = docs.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), content_digest(F.col("text")).alias("content"))
    slim = common.written(slim, "token-digests")
    found = misses(docs, slim, cached(spark, cache, key), path)
    found.write.mode("append").parquet(f"{cache}/tokenizer={key}")
    stored = cached(spark, cache, key)
    sizes = slim.groupBy("content").agg(F.count(F.lit(1)).alias("n"))
    hot = sizes.where(F.col("n") > -(-slim.count() // HOT_SHARE)).select("content").join(stored, "content")
    hot = common.written(hot.withColumnRenamed("n_tokens", "_hot"), "token-hot")
    both = slim.join(F.broadcast(hot), "content", "left")  # HOT_SHARE rows at most
    cold = both.where("_hot is null").drop("_hot").join(stored, "content")
    out = both.where("_hot is not null").withColumnRenamed("_hot", "n_tokens").unionByName(cold)
    return out.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def op12_digest_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(common.table(spark, sf_dir, "documents"), common.scratch(spark, "token-cache"))


QUERIES = {"op12_digest_cache": op12_digest_cache}
ORACLE_SQL: dict[str, str] = {}
