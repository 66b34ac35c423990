"""Writers: binning tables, bin FASTAs, summaries and the run's manifest."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spindrift.sources import bin_files


def safe_label(label: Column) -> Column:
    return F.regexp_replace(label, r"[^A-Za-z0-9._-]", "_")


def binning_lines(binning: DataFrame, names: DataFrame, sample: str) -> DataFrame:
    """Lines of a binning table in order: three header lines, then name and bin; unknown fragments are left out."""
    spark = binning.sparkSession
    head = spark.createDataFrame([(0, "", "", "@Version:0.9.0"), (1, "", "", f"@SampleID:{sample}"), (2, "", "", "@@SEQUENCEID\tBINID")], "_o int, _b string, _n string, value string")
    rows = binning.join(names.select("contig_id", "name"), "contig_id").select(F.lit(3).alias("_o"), F.col("bin_label").alias("_b"), F.col("name").alias("_n"), F.concat_ws("\t", "name", "bin_label").alias("value"))
    return head.union(rows).orderBy("_o", "_b", "_n").select("value")


def write_binning(binning: DataFrame, names: DataFrame, sample: str, path: str) -> None:
    """A folder of text parts that read in order make the table."""
    binning_lines(binning, names, sample).write.mode("overwrite").text(path)


def seed_lines(seed: DataFrame, names: DataFrame, sample: str) -> DataFrame:
    """Lines of the seed as a table with its original labels: three header lines, then name, bin and length."""
    head = seed.sparkSession.createDataFrame([(0, "", "", "@Version:0.9.0"), (1, "", "", f"@SampleID:{sample}"), (2, "", "", "@@SEQUENCEID\tBINID\tLENGTH")], "_o int, _b string, _n string, value string")
    rows = seed.join(names.select("contig_id", "name", "length"), "contig_id")
    rows = rows.select(F.lit(3).alias("_o"), F.col("bin_label").alias("_b"), F.col("name").alias("_n"), F.concat_ws("\t", "name", "bin_label", F.col("length").cast("string")).alias("value"))
    return head.union(rows).orderBy("_o", "_b", "_n").select("value")


def write_seed(seed: DataFrame, names: DataFrame, sample: str, path: str) -> None:
    """The seed as text parts that read in order make the table."""
    seed_lines(seed, names, sample).write.mode("overwrite").text(path)


def write_bin_fastas(contigs: DataFrame, binning: DataFrame, path: str) -> None:
    """One FASTA file a bin, ``path``/label.fa (label made safe), records in the assembly's order; a file of that name is replaced. Two labels of one safe form are an error."""
    labels = binning.select("bin_label").distinct().groupBy(safe_label(F.col("bin_label")).alias("bin")).count().where("count > 1").limit(1).collect()
    if labels:
        raise ValueError(f"several bins would be written to {labels[0].bin}.fa")
    d = contigs.select("contig_id", "name", "seq").join(binning.select("contig_id", safe_label(F.col("bin_label")).alias("bin")), "contig_id")
    contigs.sparkSession.dataSource.register(bin_files.BinFiles)
    rows = d.repartition("bin").sortWithinPartitions("bin", "contig_id").select("bin", F.concat(F.lit(">"), "name", F.lit("\n"), "seq").alias("value"))
    rows.write.format("bin_files").mode("append").option("path", path).save()


def composite_lines(edges: DataFrame, names: DataFrame) -> DataFrame:
    """Edge facts with six decimals, for exchange with rule engines."""
    n = names.select("contig_id", "name")
    d = edges.join(n.select(F.col("contig_id").alias("src"), F.col("name").alias("a")), "src").join(n.select(F.col("contig_id").alias("dst"), F.col("name").alias("b")), "dst")
    return d.select(F.format_string('composite("%s","%s",%.6f).', "b", "a", "score").alias("value"))


def distance_lines(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.format_string("comarker_sim(%d,%d,%d).", "c1", "c2", "d").alias("value"))


def read_facts(spark, path: str, predicate: str, arity: int) -> DataFrame:
    """Integer facts of one predicate; a file without any is an error."""
    pattern = rf"^\s*{predicate}\(" + r"\s*,\s*".join([r"(-?\d+)"] * arity) + r"\)\s*\.?\s*$"
    d = spark.read.text(path).where(F.col("value").rlike(pattern)).select(*(F.regexp_extract("value", pattern, k + 1).cast("long").alias(f"a{k + 1}") for k in range(arity)))
    if not d.limit(1).count():
        raise ValueError(f"no {predicate} facts in {path}")
    return d


def write_summary(summary: DataFrame, path: str) -> None:
    summary.write.mode("overwrite").option("sep", "\t").option("header", True).csv(path)


def write_manifest(spark, settings: dict, path: str) -> None:
    spark.createDataFrame([(json.dumps(settings, sort_keys=True, default=str),)], "value string").coalesce(1).write.mode("overwrite").text(path)
