"""Order MinHash fingerprints in DataFrame functions alone.

A text is cut into pieces (runs of non-space characters, at most 16 characters each) and
every K consecutive pieces are a k-mer. K-mers are numbered by occurrence, so that the
second copy of a k-mer is another element than the first. Element hashes fall into SLOTS
by their top bits; in each slot the two smallest are selected, put back in text order and
hashed as a tuple. The tuples, by slot, are the fingerprint: both the set of k-mers and
their order must agree for a slot to agree. One hash per k-mer serves all slots
(one-permutation hashing), so the work per text is linear in its length but for a sort.

Likeness: with p the share of slots that agree, both of a slot's two elements are shared
with probability p, one with J = sqrt(p), and 2 J / (1 + J) is the share of k-mers kept.
The fingerprints of two texts without pieces are equal (likeness 1).

Defined cases: null text is empty; rows that repeat a doc_id are ordered by the hash of
their text; rows with a null doc_id come last in the descending order; the only row of a
table is its own next document; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spindrift.llm import common

K = 3
SLOTS = 32
PIECE = r"\S{1,16}"
_LOW = 31  # bits that hold a k-mer's place in its text: a string of at most 2 GB has fewer pieces


def _pieces(df: DataFrame, text: str, out: str) -> DataFrame:
    return df.withColumn(out, F.regexp_extract_all(F.col(text), F.lit(PIECE), F.lit(0)))


def _kmers(words: Column, k: int) -> Column:
    """Hash and place of every k-mer in one long, sorted: the hash above, the place in the low bits."""
    place = (1 << _LOW) - 1

    def one(x: Column, i: Column) -> Column:
        h = F.xxhash64(x, *(F.get(words, i + j) for j in range(1, k)))
        return h.bitwiseAND(F.lit(~place)).bitwiseOR(i.cast("long").bitwiseAND(F.lit(place)))

    return F.sort_array(F.transform(words, one))


def _numbered(s: Column) -> Column:
    """Elements of a sorted k-mer array: a first occurrence keeps its hash, the o-th later one gets a hash of both."""
    place = F.lit((1 << _LOW) - 1)
    high = lambda x: F.shiftright(x, _LOW)
    starts = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: (i == 0) | (high(F.get(s, i)) != high(F.get(s, i - 1))))
    run = lambda at, to: F.transform(
        F.slice(s, at + 1, to - at), lambda x, o: F.when(o == 0, x).otherwise(F.xxhash64(high(x), o).bitwiseAND(F.bitwise_not(place)).bitwiseOR(x.bitwiseAND(place)))
    )
    bounds = F.zip_with(starts, F.array_append(F.slice(starts, 2, F.size(starts)), F.size(s)), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    return F.sort_array(F.flatten(F.transform(bounds, lambda r: run(r["a"], r["b"]))))


def fingerprint(df: DataFrame, text: str, out: str, k: int = K, slots: int = SLOTS) -> DataFrame:
    """Adds ``out``: array<int> of the slots' tuple hashes, in slot order, slots without elements left out."""
    bits = slots.bit_length() - 1
    if 1 << bits != slots:
        raise ValueError("slots must be a power of two")
    slot = lambda x: F.shiftright(x, 64 - bits)
    # each step is a column of its own and used more than once by the next, so it is computed once a row
    d = _pieces(df, text, "_w")
    d = d.withColumn("_s", _kmers(F.col("_w"), k))
    s = F.col("_s")
    distinct = F.size(F.array_distinct(F.transform(s, lambda x: F.shiftright(x, _LOW))))
    d = d.withColumn("_t", F.when(distinct == F.size(s), s).otherwise(_numbered(s)))
    t = F.col("_t")
    d = d.withColumn("_m", F.filter(t, lambda x, i: (i < 2) | (slot(x) != slot(F.get(t, i - 2)))))
    m = F.col("_m")
    high = lambda x: F.shiftright(x, _LOW)
    place = lambda x: x.bitwiseAND(F.lit((1 << _LOW) - 1))

    def tuple_hash(x: Column, i: Column) -> Column:
        y = F.get(m, i + 1)
        two = slot(x) == slot(y)
        return F.when(~F.coalesce(two, F.lit(False)), F.xxhash64(slot(x), high(x))).when(place(x) < place(y), F.xxhash64(slot(x), high(x), high(y))).otherwise(F.xxhash64(slot(x), high(y), high(x), F.lit(1)))

    first = F.transform(m, lambda x, i: F.when((i == 0) | (slot(x) != slot(F.get(m, i - 1))), tuple_hash(x, i)))
    return d.withColumn(out, F.transform(F.filter(first, lambda x: x.isNotNull()), lambda x: x.bitwiseAND(F.lit(0x7FFFFFFF)).cast("int"))).drop("_w", "_s", "_t", "_m")


def likeness(a: Column, b: Column) -> Column:
    """0 to 1: the estimated share of k-mers, in order, that two fingerprints' texts have in common."""
    most = F.greatest(F.size(a), F.size(b))
    j = F.sqrt(F.size(F.array_intersect(a, b)) / most)
    return F.when(most == 0, F.lit(1.0)).otherwise(2 * j / (1 + j))


def as_text(sig: Column) -> Column:
    return F.array_join(F.transform(sig, lambda x: F.lpad(F.lower(F.hex(x)), 8, "0")), "")


def with_next(docs: DataFrame, carry: list[str]) -> tuple[DataFrame, object]:
    """Documents dealt into id buckets, each bucket with the row that follows its last one; and the window of the order.

    One shuffle of the texts. A bucket's follower is found from the largest id of each
    bucket (at most common.MOST_BUCKETS rows, which bounds the broadcast); rows marked
    ``_guest`` are such followers and are to be dropped after ``lead``.
    """
    lowest = -(1 << 63)
    d = docs.withColumn("_key", F.coalesce(F.col("doc_id").cast("long"), F.lit(lowest)))
    bucket, _ = common.id_buckets(docs.select("doc_id"), "doc_id")
    tops = docs.select("doc_id").groupBy(bucket(F.col("doc_id")).alias("_b")).agg(F.max(F.coalesce(F.col("doc_id").cast("long"), F.lit(lowest))).alias("_key"))
    around = Window.orderBy("_b")
    # the top of each bucket follows the last row of the next higher one; the very top follows the lowest bucket's
    tops = tops.withColumn("_to", F.coalesce(F.lead("_b").over(around), F.min("_b").over(Window.partitionBy())))
    d = d.join(F.broadcast(tops.select("_key", "_to")), "_key", "left")
    own = F.struct(bucket(F.col("doc_id")).alias("b"), F.lit(False).alias("guest"))
    guest = F.struct(F.col("_to").alias("b"), F.lit(True).alias("guest"))
    d = d.select("_key", *carry, F.explode(F.when(F.col("_to").isNull(), F.array(own)).otherwise(F.array(own, guest))).alias("_at"))
    d = d.select("_key", *carry, F.col("_at.b").alias("_b"), F.col("_at.guest").alias("_guest"), F.xxhash64("text").alias("_tie"))
    return d, Window.partitionBy("_b").orderBy("_guest", F.col("_key").desc(), "_tie")


def edited_fingerprints(docs: DataFrame, k: int = K, slots: int = SLOTS) -> DataFrame:
    """doc_id, n_chars, edited_sha256, sig, edited_sig, near_edited, near_next of every row."""
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    d, order = with_next(docs, ["doc_id", "text"])
    d = d.withColumn("n_chars", F.char_length("text").cast("long")).withColumn("_third", F.floor(F.col("n_chars") / 3).cast("int"))
    d = d.withColumn("_next", F.lead("text").over(order))
    kept = F.substring(F.col("text"), F.lit(1), (F.col("n_chars") - F.col("_third")).cast("int"))
    d = d.withColumn("edited", F.concat(kept, F.substring(F.coalesce("_next", F.lit("")), F.lit(1), F.col("_third")))).drop("_next")
    d = fingerprint(fingerprint(d, "text", "sig", k, slots), "edited", "edited_sig", k, slots)
    d = d.withColumn("edited_sha256", F.sha2(F.col("edited").cast("binary"), 256)).drop("text", "edited")
    d = d.withColumn("_next_sig", F.lead("sig").over(order)).where(~F.col("_guest"))
    return d.select("doc_id", "n_chars", "edited_sha256", "sig", "edited_sig", likeness(F.col("sig"), F.col("edited_sig")).alias("near_edited"), likeness(F.col("sig"), F.col("_next_sig")).alias("near_next"))


def op10_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = edited_fingerprints(common.table(spark, sf_dir, "documents"))
    return d.select("doc_id", "n_chars", "edited_sha256", as_text(F.col("sig")).alias("fingerprint"), as_text(F.col("edited_sig")).alias("edited_fingerprint"), "near_edited", "near_next")


QUERIES = {"op10_order_minhash": op10_order_minhash}
ORACLE_SQL: dict[str, str] = {}
