"""How the sources of a language differ in their words: K-squared quadtrees over the group-term count matrix.

A group is a (lang, source). Within a language, its groups are the rows and the terms it
keeps the columns of a sparse count matrix, cut into tiles of SIDE rows and WIDE columns.
Each tile is a row of square quadtrees: one bit for each quadrant, which says whether it
holds any count, level by level down to single entries. Two tiles of the same columns are
traversed jointly, level by level, for all pairs of their rows at once. A pair of quadrants
without a bit in either is never opened: each column of it costs every pair of rows the same,
the divergence of their zero-count probabilities, so it is priced as width times that. What
is left at the last level are the entries with a count on one side or on both.

A tile meets the tiles of the row blocks after its own and itself, so every pair of groups
meets once; a task holds two tiles, whatever the number of sources or terms.

Defined cases: null text, lang and source are empty strings; a language without kept terms
has V = 0, its pairs are worth 0 and it has no `term` rows; a language with one source has no
`pair` rows; equal values are ranked by the item's UTF-8 bytes; rows that repeat a doc_id
count as documents each; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spindrift.llm import common

LEAST_DOCS = 10
SCALE = 1_000_000_000
TOP_TERMS = 10
SIDE = 64  # rows of a tile and side of its quadtrees, a power of two
WIDE = 512  # columns of a tile, about
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_GAP = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences), docs (documents that hold it)."""
    d = docs.select(*(F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source", "text")))

    def run(batches):
        for b in common.slices(batches):
            lang, source = (b.column(k).dictionary_encode() for k in (0, 1))
            of = lang.indices.to_numpy().astype(np.int64) * max(1, len(source.dictionary)) + source.indices.to_numpy()
            data, at = common.raw(common.texts(b.column(2)))
            low = pa.LargeStringArray.from_buffers(b.num_rows, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(_LOWER[data]))
            words = pc.split_pattern_regex(low, _GAP)
            size = np.diff(words.offsets.to_numpy())
            coded = words.flatten().dictionary_encode()
            row, code = np.repeat(np.arange(len(size)), size), coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            full = pc.not_equal(coded.dictionary, "").to_numpy(zero_copy_only=False)[code] if len(code) else np.zeros(0, bool)
            row, code = row[full], code[full]
            m = max(1, len(coded.dictionary))
            each, n = np.unique(row * m + code, return_counts=True)
            key, inverse = np.unique(of[each // m] * m + each % m, return_inverse=True)
            total = np.bincount(inverse, weights=n, minlength=len(key)).astype(np.int64)
            held = np.bincount(inverse, minlength=len(key)).astype(np.int64)
            group = key // m
            names = [(lang, group // max(1, len(source.dictionary))), (source, group % max(1, len(source.dictionary))), (coded, key % m)]
            cols = [x.dictionary.take(pa.array(k)).cast(pa.string()) for x, k in names]
            yield pa.record_batch([*cols, pa.array(total), pa.array(held)], ["lang", "source", "term", "n", "docs"])

    got = d.mapInArrow(run, "lang string, source string, term string, n long, docs long")
    return got.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _chance(n: str, total: str) -> F.Column:
    """1 + floor(SCALE * (n + 2) / total), in exact decimals."""
    return F.expr(f"1 + cast({SCALE} as decimal(10,0)) * cast({n} + 2 as decimal(19,0)) div cast({total} as decimal(20,0))")


def gap(p, q):
    """floor((p - q) ** 2 / (p + q)); p and q are at most SCALE + 1, so a long holds it all."""
    return (p - q) * (p - q) // (p + q)


_GAP_SQL = "(p - q) * (p - q) div (p + q)"


class Quadtrees:
    """A tile's quadtrees: for each level from the root's to the entries', which quadrants hold any entry.

    ``levels[k]`` is a bool array over (rows at that level, trees, columns at that level).
    ``value`` has p of each entry, ``zero`` p of each row's absent entries.
    """

    def __init__(self, row, col, p, zero, trees: int, side: int = SIDE):
        self.zero, self.side = np.asarray(zero, np.int64), side
        self.value = np.repeat(np.append(self.zero, np.zeros(side - len(self.zero), np.int64))[:, None], trees * side, axis=1)
        self.value[row, col] = p
        bits = np.zeros((side, trees, side), bool)
        bits[row, col // side, col % side] = True
        self.levels = [bits]
        while bits.shape[0] > 1:
            bits = bits[0::2] | bits[1::2]
            bits = bits[:, :, 0::2] | bits[:, :, 1::2]
            self.levels.append(bits)
        self.levels.reverse()


def joint(a: Quadtrees, b: Quadtrees, columns: int, same: bool) -> tuple[np.ndarray, int]:
    """Sums of gap() over the first ``columns`` columns for all pairs of rows of a and b, and the number of entries evaluated; with ``same``, only pairs above the diagonal count.

    Both sides go down together. Columns of a pair of rows that no opened quadrant has are
    ``columns`` less those evaluated, and are priced at once.
    """
    na, nb = len(a.zero), len(b.zero)
    total, seen = np.zeros((na, nb), np.int64), np.zeros((na, nb), np.int64)
    tree = np.flatnonzero(a.levels[0][0, :, 0] | b.levels[0][0, :, 0])
    work = [(np.zeros(len(tree), np.int64), np.zeros(len(tree), np.int64), tree, np.zeros(len(tree), np.int64), 0)]
    last, evaluated = len(a.levels) - 1, 0
    while work:
        i, j, t, c, k = work.pop()
        if len(i) > 1 << 20:  # half at a time: memory stays bounded
            h = len(i) // 2
            work += [(i[:h], j[:h], t[:h], c[:h], k), (i[h:], j[h:], t[h:], c[h:], k)]
            continue
        if k == last:
            at = t * a.side + c
            np.add.at(total, (i, j), gap(a.value[i, at], b.value[j, at]))
            np.add.at(seen, (i, j), 1)
            evaluated += len(i)
            continue
        step = np.arange(8)
        i, j, c, t = (np.repeat(x, 8) for x in (2 * i, 2 * j, 2 * c, t))
        n = len(i) // 8
        i += np.tile(step & 1, n)
        j += np.tile(step >> 1 & 1, n)
        c += np.tile(step >> 2, n)
        k += 1
        width = a.side >> k
        keep = (i * width < na) & (j * width < nb)
        if same:
            keep &= (j + 1) * width - 1 > i * width
        i, j, t, c = i[keep], j[keep], t[keep], c[keep]
        keep = a.levels[k][i, t, c] | b.levels[k][j, t, c]
        work.append((i[keep], j[keep], t[keep], c[keep], k))
    return total + gap(a.zero[:, None], b.zero[None, :]) * (columns - seen), evaluated


def _meet(left: pa.Table, right: pa.Table) -> pa.Table:
    """lang, a, b, value: one pair of tiles; rows with a null column number hold a group's zero-count p."""
    names, sides = ["lang", "a", "b", "value"], []
    kind = pa.schema([("lang", pa.string()), ("a", pa.string()), ("b", pa.string()), ("value", pa.int64())])
    if not left.num_rows or not right.num_rows:
        return kind.empty_table()
    columns = left["width"][0].as_py()
    trees = max(1, -(-columns // SIDE))
    for t in (left, right):
        head = t.filter(pc.is_null(t["col"])).sort_by("row")
        body = t.filter(pc.is_valid(t["col"]))
        place = np.full(SIDE_MOST, -1, np.int64)
        place[head["row"].to_numpy()] = np.arange(head.num_rows)
        sides.append((head["source"], place[body["row"].to_numpy()], body["col"].to_numpy(), body["p"].to_numpy(), head["p"].to_numpy()))
    same = left["i"][0].as_py() == left["j"][0].as_py()
    out = []
    lang = left["lang"][0].as_py()
    # a row block is about SIDE groups; one of more is met in strips of SIDE
    for x in range(0, len(sides[0][4]), SIDE):
        for y in range(x if same else 0, len(sides[1][4]), SIDE):
            trees_of = []
            for (_, row, col, p, zero), k in ((sides[0], x), (sides[1], y)):
                own = (row >= k) & (row < k + SIDE)
                trees_of.append(Quadtrees(row[own] - k, col[own], p[own], zero[k : k + SIDE], trees))
            sums, _ = joint(*trees_of, columns, same and x == y)
            i, j = np.nonzero(np.triu(np.ones(sums.shape, bool), 1)) if same and x == y else np.nonzero(np.ones(sums.shape, bool))
            out.append(pa.table([pa.array([lang] * len(i), pa.string()), sides[0][0].take(pa.array(i + x)).cast(pa.string()), sides[1][0].take(pa.array(j + y)).cast(pa.string()), pa.array(sums[i, j])], names))
    return pa.concat_tables(out).cast(kind)


SIDE_MOST = 1 << 16
SALTS = 64


def _of_lang(rows: DataFrame, name: str, langs: DataFrame, how: str = "inner") -> DataFrame:
    """``rows`` with the row of their language: ``name`` deals a language's rows to SALTS tasks."""
    salted = langs.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    return rows.withColumn("_salt", F.pmod(F.xxhash64(name), F.lit(SALTS))).join(salted, ["lang", "_salt"], how).drop("_salt")


def _blocked(rows: DataFrame, block: str, size: str, width: int, name: str, *order) -> DataFrame:
    """``rows`` with a block by hash, ``size`` / width blocks a language, and a number inside the block."""
    hashed = F.pmod(F.xxhash64(name), F.greatest(F.lit(1), F.ceil(F.col(size) / width)))
    return rows.withColumn(block, hashed).withColumn(block + "_at", F.row_number().over(Window.partitionBy("lang", block).orderBy(*order)) - 1)


def prepared(docs: DataFrame, least: int = LEAST_DOCS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(groups: lang, source, V, total, zero, rows and their blocks; terms: lang, term, q, columns and their blocks; entries: lang, source, term, n, p), written."""
    counts = common.written(term_counts(docs), "divergence-counts")
    kept = counts.groupBy("lang", "term").agg(F.sum("n").alias("of_lang"), F.sum("docs").alias("docs")).where(F.col("docs") >= least).drop("docs")
    kept = common.written(kept, "divergence-kept")
    langs = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("V"), F.sum("of_lang").alias("N"))
    entries = counts.drop("docs").join(kept.select("lang", "term"), ["lang", "term"])
    sums = entries.groupBy("lang", "source").agg(F.sum("n").alias("N"))
    groups = docs.select(*(F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source"))).distinct()
    of = groups.groupBy("lang").agg(F.count(F.lit(1)).alias("S"))
    groups = groups.join(sums, ["lang", "source"], "left")
    groups = _of_lang(_of_lang(groups, "source", of), "source", langs.select("lang", "V"), "left")
    groups = groups.select("lang", "source", "S", F.coalesce("V", F.lit(0)).alias("V"), (F.coalesce("N", F.lit(0)) + 2 * F.coalesce("V", F.lit(0))).alias("total"))
    groups = groups.withColumn("zero", F.when(F.col("V") > 0, _chance("0", "total")))
    groups = common.written(_blocked(groups, "i", "S", SIDE, "source", "source"), "divergence-groups")
    terms = _of_lang(kept, "term", langs).withColumn("q", _chance("of_lang", "N + 2 * V"))
    # frequent terms first: what is zero everywhere gathers in quadrants of its own
    terms = _blocked(terms, "c", "V", WIDE, "term", F.desc("of_lang"), "term")
    terms = terms.withColumn("width", F.count(F.lit(1)).over(Window.partitionBy("lang", "c")).cast("long"))
    terms = common.written(terms.select("lang", "term", "q", "c", F.col("c_at").alias("col"), "width"), "divergence-terms")
    entries = entries.join(groups.select("lang", "source", "total"), ["lang", "source"]).select("lang", "source", "term", "n", _chance("n", "total").alias("p"))
    return groups, terms, entries


def divergences(groups: DataFrame, terms: DataFrame, entries: DataFrame) -> DataFrame:
    """lang, a, b, value of each unordered pair of groups, every column counted."""
    rows = groups.where("V > 0").select("lang", "source", "S", "zero", "i", F.col("i_at").alias("row"))
    body = entries.join(terms.select("lang", "term", "c", "col", "width"), ["lang", "term"]).join(rows.drop("zero"), ["lang", "source"])
    body = body.select("lang", "source", "S", "i", "row", "c", "width", F.col("col").cast("int").alias("col"), "p")
    blocks = terms.select("lang", "c", "width").distinct()
    head = _of_lang(rows, "source", blocks).select("lang", "source", "S", "i", "row", "c", "width", F.lit(None).cast("int").alias("col"), F.col("zero").alias("p"))
    tiles = body.unionByName(head).withColumn("row", F.col("row").cast("int"))
    last = F.greatest(F.lit(1), F.ceil(F.col("S") / SIDE)) - 1
    left = tiles.withColumn("j", F.explode(F.sequence(F.col("i"), last))).drop("S")
    right = tiles.withColumn("j", F.col("i")).withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("j")))).drop("S")
    right = right.toDF(*(f"{c}_r" for c in right.columns))  # names of its own: the two sides stem from one table

    def meet(a: pa.Table, b: pa.Table) -> pa.Table:
        return _meet(a, b.rename_columns([c.removesuffix("_r") for c in b.column_names]))

    met = left.groupBy("lang", "c", "i", "j").cogroup(right.groupBy("lang_r", "c_r", "i_r", "j_r")).applyInArrow(meet, "lang string, a string, b string, value long")
    return met.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))


def audit(docs: DataFrame, least: int = LEAST_DOCS, top: int = TOP_TERMS) -> DataFrame:
    """lang, source, part (pair or term), item, value, rank."""
    groups, terms, entries = prepared(docs, least)
    met = common.written(divergences(groups, terms, entries), "divergence-pairs")
    none = groups.where("V = 0").select("lang", "source")
    zero = none.alias("x").join(none.alias("y"), "lang").where("x.source <> y.source").select("lang", F.col("x.source").alias("source"), F.col("y.source").alias("item"), F.lit(0).cast("long").alias("value"))
    pairs = met.select("lang", F.col("a").alias("source"), F.col("b").alias("item"), "value").unionByName(met.select("lang", F.col("b").alias("source"), F.col("a").alias("item"), "value")).unionByName(zero)
    by = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(by).alias("rank"))
    own = entries.join(terms.select("lang", "term", "q"), ["lang", "term"]).where("p > q")
    own = own.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), F.expr(_GAP_SQL).alias("value"))
    own = own.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= top)
    return pairs.unionByName(own.select(*pairs.columns))


def op13_k2_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(common.table(spark, sf_dir, "documents"))


QUERIES = {"op13_k2_divergence": op13_k2_divergence}
ORACLE_SQL = {
    "op13_k2_divergence": rf"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
g AS (SELECT DISTINCT lang, source FROM d),
w AS (SELECT r, lang, source, unnest(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_GAP}')) AS term FROM d),
k AS (SELECT lang, term, count(*)::HUGEINT AS n FROM w WHERE term <> '' GROUP BY lang, term HAVING count(DISTINCT r) >= {LEAST_DOCS}),
l AS (SELECT lang, count(*)::HUGEINT AS v, sum(n)::HUGEINT AS n FROM k GROUP BY lang),
c AS (SELECT w.lang, w.source, w.term, count(*)::HUGEINT AS n FROM w JOIN k USING (lang, term) GROUP BY ALL),
s AS (SELECT g.lang, g.source, coalesce(sum(c.n), 0)::HUGEINT AS n FROM g LEFT JOIN c USING (lang, source) GROUP BY ALL),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + ({SCALE}::HUGEINT * (coalesce(c.n, 0) + 2)) // (s.n + 2 * l.v) AS p,
  1 + ({SCALE}::HUGEINT * (k.n + 2)) // (l.n + 2 * l.v) AS q
  FROM g JOIN k USING (lang) JOIN l USING (lang) JOIN s USING (lang, source) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
pair AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
every AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(pair.value, 0)::BIGINT AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pair ON pair.lang = a.lang AND pair.source = a.source AND pair.item = b.source
  UNION ALL SELECT lang, source, 'term', term, (((p - q) * (p - q)) // (p + q))::BIGINT FROM p WHERE n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM every)
SELECT * FROM ranked WHERE part = 'pair' OR rank <= {TOP_TERMS}"""
}
