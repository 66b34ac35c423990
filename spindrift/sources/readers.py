"""Readers of assemblies, coverage tables, marker annotations, seeds and binnings (plain or gzip, told by a file's first bytes)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spindrift.plans.stage import written
from spindrift.sources import gzip_text

#: First column of a depth table's header.
DEPTH_HEADER = "contigName"
#: Seed files whose names hold one of these are no bins.
NO_BINS = ("unbinned", "lowdepth", "tooshort")


def dense_ids(df: DataFrame, *keys: str, out: str = "dense_id") -> DataFrame:
    """0-based dense ids in ``keys`` order: a range sort, one count per range, and ranks inside the ranges."""
    d = df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_p", F.spark_partition_id())
    d = written(d, "ranges")
    sizes = d.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))
    base = F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    d = d.join(F.broadcast(sizes.select("_p", base.alias("_base"))), "_p")  # one row a partition
    return d.withColumn(out, F.col("_base") + F.row_number().over(Window.partitionBy("_p").orderBy(*keys)) - 1).drop("_p", "_base")


def ids_by_appearance(rows: DataFrame) -> DataFrame:
    """label, id: 0-based ids of the labels of (ordinal, label) in the order of their first appearance."""
    first = rows.groupBy("label").agg(F.min("ordinal").alias("first"))
    return dense_ids(first, "first", "label", out="id").select("label", "id")


def lines(spark: SparkSession, paths: str | list[str], sep: str = "\n") -> DataFrame:
    """value, file, ordinal of the lines of one or more files or folders; ``ordinal`` grows along a file."""
    paths = [paths] if isinstance(paths, str) else list(paths)
    found = [f for p in paths for f in gzip_text.files(spark, p)]
    if not found:
        raise ValueError(f"no file at {', '.join(paths)}")
    packed = [f for f, is_packed in found if is_packed]
    plain = [f for f, is_packed in found if not is_packed] if packed else paths
    if not plain:
        return gzip_text.packed_lines(spark, packed, sep)
    d = spark.read.option("lineSep", sep).text(plain)
    d = d.select("value", F.col("_metadata.file_path").alias("file"), _ordinal().alias("ordinal"))
    return d.unionByName(gzip_text.packed_lines(spark, packed, sep)) if packed else d


def _ordinal() -> Column:
    """A number that grows along the file; a row's place within its split comes from the split's start."""
    return F.col("_metadata.file_block_start") * F.lit(1 << 20) + F.pmod(F.monotonically_increasing_id(), F.lit(1 << 33))


def fasta(spark: SparkSession, path: str, placed: bool = False) -> DataFrame:
    """name (first word of the header), seq, length; one row a record; with ``placed`` also file and ordinal."""
    d = lines(spark, path, "\n>").select(F.regexp_replace("value", r"^>|\r", "").alias("v"), "file", "ordinal").where("trim(v) <> ''")
    head = F.split(F.substring_index("v", "\n", 1), r"\s+")[0]
    body = F.when(F.instr("v", "\n") > 0, F.expr("substring(v, instr(v, '\n') + 1)")).otherwise("")
    d = d.select(head.alias("name"), F.regexp_replace(body, r"\s", "").alias("seq"), "file", "ordinal")
    return d.select("name", "seq", F.length("seq").cast("long").alias("length"), *(["file", "ordinal"] if placed else []))


def size_class(length: Column, large: int = 2500, small: int = 1000) -> Column:
    """large, small or null (dropped)."""
    return F.when(length >= large, "large").when(length >= small, "small")


def contigs(spark: SparkSession, path: str, minlen: int = 1500) -> DataFrame:
    """contig_id (dense, in the assembly's order), name, seq, length of records of at least ``minlen``; a repeated name is an error."""
    d = fasta(spark, path, placed=True).where(F.col("length") >= minlen)
    again = d.groupBy("name").count().where("count > 1").select("name").limit(5).collect()
    if again:
        raise ValueError(f"duplicate contig names: {[r.name for r in again]}")
    return dense_ids(d, "file", "ordinal", out="contig_id").drop("file", "ordinal")


def resolve(rows: DataFrame, names: DataFrame) -> DataFrame:
    """contig_id for ``rows.name``: exact, else the part before ``_LN:``; null if neither is known."""
    n = names.select("name", "contig_id")
    d = rows.withColumn("_cut", F.substring_index("name", "_LN:", 1))
    d = d.join(n.withColumnRenamed("contig_id", "_exact"), "name", "left").join(n.select(F.col("name").alias("_cut"), F.col("contig_id").alias("_part")), "_cut", "left")
    return d.withColumn("contig_id", F.coalesce("_exact", "_part")).drop("_cut", "_exact", "_part")


def _fields(spark: SparkSession, paths: list[str], width: int = 2, seen: Observation | None = None) -> DataFrame:
    """f: the fields of all rows but comments, of at least ``width``; ``seen`` gets rows read and rows of fewer fields (unparsed)."""
    v = F.regexp_replace("value", r"\r$", "")
    d = lines(spark, paths).select(v.alias("value")).where("trim(value) <> '' and value not like '#%' and value not like '@%'")
    d = d.select(F.split("value", "\t").alias("f"))
    if seen is not None:
        d = d.observe(seen, F.count(F.lit(1)).alias("rows"), F.count_if(F.size("f") < width).alias("unparsed"))
    return d.where(F.size("f") >= width)


def markers_table(spark: SparkSession, paths: list[str], seen: Observation | None = None) -> DataFrame:
    """name, marker: first two columns; an empty marker is no row."""
    return _fields(spark, paths, 2, seen).select(F.trim(F.get("f", 0)).alias("name"), F.trim(F.get("f", 1)).alias("marker")).where("marker <> ''").distinct()


def markers_busco(spark: SparkSession, paths: list[str], seen: Observation | None = None) -> DataFrame:
    """name, marker of rows whose status is Complete or Duplicated."""
    return _fields(spark, paths, 3, seen).where(F.get("f", 1).isin("Complete", "Duplicated")).select(F.get("f", 2).alias("name"), F.get("f", 0).alias("marker")).distinct()


_ORFS = "map<string,string>"


def pfam_cells(spark: SparkSession, paths: list[str]) -> DataFrame:
    """name, orfs of a dictionary literal {orf: {marker: ...}} a row, null where it is none. Tuples are read as lists."""
    d = _fields(spark, paths).select(F.get("f", 0).alias("name"), F.translate(F.get("f", 1), "()", "[]").alias("cell"))
    return d.select("name", F.from_json("cell", _ORFS, {"allowSingleQuotes": "true"}).alias("orfs"))


def markers_pfam(spark: SparkSession, paths: list[str], seen: Observation | None = None) -> DataFrame:
    """name, marker of every marker of every orf; rows that are no dictionary are skipped (unparsed), and so are orfs that are none."""
    cells = pfam_cells(spark, paths)
    if seen is not None:
        cells = cells.observe(seen, F.count(F.lit(1)).alias("rows"), F.count_if(F.col("orfs").isNull()).alias("unparsed"))
    orf = cells.select("name", F.explode("orfs").alias("orf", "markers"))
    return orf.select("name", F.explode(F.map_keys(F.from_json("markers", _ORFS, {"allowSingleQuotes": "true"}))).alias("marker")).distinct()


def present(spark: SparkSession, paths: list[str]) -> list[str]:
    """The paths where there is a file."""
    return [p for p in paths if gzip_text.files(spark, p)]


def markers(spark: SparkSession, paths: list[str], kind: str, seen: Observation | None = None) -> DataFrame:
    return {"table": markers_table, "busco": markers_busco, "pfam": markers_pfam}[kind](spark, paths, seen)


def incidence(rows: DataFrame, names: DataFrame) -> DataFrame:
    """contig_id, marker_id (dense, by name) of known fragments."""
    d = resolve(rows, names).where("contig_id is not null").select("contig_id", "marker").distinct()
    legend = dense_ids(d.select("marker").distinct(), "marker", out="marker_id")
    return d.join(legend, "marker").select("contig_id", (F.col("marker_id") + 1).alias("marker_id"))


def seed_table(spark: SparkSession, path: str) -> DataFrame:
    """name, bin_label; a row of fewer than two columns is an error."""
    d = _fields(spark, [path], 0)
    if d.where("size(f) < 2").limit(1).count():
        raise ValueError("a seed row has fewer than two columns")
    return d.select(F.trim(F.get("f", 0)).alias("name"), F.trim(F.get("f", 1)).alias("bin_label"))


#: Endings of FASTA files, before an optional .gz.
FASTA_ENDINGS = (".fa", ".fasta", ".fna", ".fas")


def seed_directory(spark: SparkSession, path: str) -> DataFrame:
    """name, bin_label from one FASTA a bin (files of other endings are none); the label is the file's name without extension."""
    d = lines(spark, path).select("value", F.url_decode(F.element_at(F.split("file", "/"), -1)).alias("file")).where("value like '>%'")
    ending = "|".join(e.replace(".", r"\.") for e in FASTA_ENDINGS)
    d = d.where(F.lower("file").rlike(rf"({ending})(\.gz)?$"))
    for word in NO_BINS:
        d = d.where(~F.lower("file").contains(word))
    if not d.limit(1).count():
        raise ValueError(f"no bin file with a sequence in {path}")
    label = F.regexp_replace(F.regexp_replace("file", r"(?i)\.gz$", ""), r"\.[^.]*$", "")
    return d.select(F.regexp_extract("value", r"^>(\S+)", 1).alias("name"), label.alias("bin_label"))


def seed(spark: SparkSession, path: str) -> DataFrame:
    """name, bin_label of a folder of bins, or of a table: a file, or a folder that Spark wrote."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(at):
        raise ValueError(f"no seed at {path}")
    folder = system.getFileStatus(at).isDirectory() and not system.exists(spark._jvm.org.apache.hadoop.fs.Path(at, "_SUCCESS"))
    return seed_directory(spark, path) if folder else seed_table(spark, path)


def binning(spark: SparkSession, path: str) -> DataFrame:
    return seed_table(spark, path)


def _depth(spark: SparkSession, path: str) -> DataFrame:
    """ordinal, f of all rows but the header, whose second field is no number."""
    d = lines(spark, path).select("ordinal", F.regexp_replace("value", r"\r$", "").alias("value")).where("trim(value) <> ''")
    return d.select("ordinal", F.split("value", "\t").alias("f")).where(F.get("f", 1).try_cast("double").isNotNull())


def depth_lines(spark: SparkSession, path: str) -> DataFrame:
    """ordinal, name, f (all fields) of the rows below the header."""
    return _depth(spark, path).select("ordinal", F.split(F.get("f", 0), " ")[0].alias("name"), "f")


def depth_header(spark: SparkSession, path: str) -> DataFrame:
    """One row: ``named``, whether the first line begins with the usual column name."""
    first = lines(spark, path).where("trim(value) <> ''").agg(F.min_by("value", F.struct("file", "ordinal")).alias("value"))
    return first.select(F.coalesce(F.split("value", "\t")[0] == DEPTH_HEADER, F.lit(False)).alias("named"))


def fasta_order(spark: SparkSession, path: str) -> DataFrame:
    """ordinal, name of all records in the assembly's order."""
    return lines(spark, path).where("value like '>%'").select("ordinal", F.regexp_extract("value", r"^>(\S+)", 1).alias("name"))


def depth_table(spark: SparkSession, path: str, with_variance: bool = True) -> DataFrame:
    """name, sample, mean, var, in long form; without variances the mean stands for them. The header gives the width."""
    d = _depth(spark, path)
    step = 2 if with_variance else 1
    values = F.slice("f", 4, F.size("f") - 3)
    n = (F.size(values) / step).cast("int")
    at = lambda k: F.get(values, k).cast("double")
    each = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(F.format_string("s%04d", i).alias("sample"), at(i * step).alias("mean"), (at(i * step + 1) if with_variance else at(i)).alias("var")))
    return d.select(F.split(F.get("f", 0), " ")[0].alias("name"), F.explode(each).alias("s")).select("name", "s.sample", "s.mean", "s.var")
