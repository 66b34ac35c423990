"""Readers, sinks and the whole run from files."""

import gzip
import json
import random
from dataclasses import replace

import pytest

from spindrift.plans import refine
from spindrift.sources import readers, sinks


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_fasta_plain_and_gzip(spark, tmp_path):
    text = ">a one\r\nACG\nT\n>b\nAC\n>c\n\n"
    (tmp_path / "x.fa").write_text(text)
    with gzip.open(tmp_path / "y.fa.gz", "wt") as f:
        f.write(text)
    for n in ("x.fa", "y.fa.gz"):
        assert rows(readers.fasta(spark, str(tmp_path / n)), "name", "seq", "length") == [("a", "ACGT", 4), ("b", "AC", 2), ("c", "", 0)]
    assert rows(readers.contigs(spark, str(tmp_path / "x.fa"), 2), "contig_id", "name") == [(0, "a"), (1, "b")]
    (tmp_path / "z.fa").write_text(">a\nACG\n>a\nACG\n")
    with pytest.raises(ValueError):
        readers.contigs(spark, str(tmp_path / "z.fa"), 2)


def test_gzip_by_its_first_bytes_and_ids_in_file_order(spark, tmp_path):
    names = [f"c{(7 * i) % 400}" for i in range(400)]
    text = "".join(f">{n} x\nACGT\nAC\n" for n in names)
    (tmp_path / "plain.fa").write_text(text)
    with gzip.open(tmp_path / "packed.fa", "wb") as f:
        f.write(text[: len(text) // 2].encode())
    with gzip.open(tmp_path / "packed.fa", "ab") as f:  # a second member
        f.write(text[len(text) // 2 :].encode())
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1k")
    try:
        for n in ("plain.fa", "packed.fa"):
            assert rows(readers.contigs(spark, str(tmp_path / n), 2), "contig_id", "name", "seq") == [(i, x, "ACGTAC") for i, x in enumerate(names)]
            assert [r.name for r in readers.fasta_order(spark, str(tmp_path / n)).orderBy("ordinal").collect()] == names
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    with gzip.open(tmp_path / "t.tsv", "wb") as f:
        f.write(b"a\tm1\nb\tm2\n")
    (tmp_path / "u.tsv").write_text("c\tm3\n")
    assert rows(readers.markers(spark, [str(tmp_path / "t.tsv"), str(tmp_path / "u.tsv")], "table"), "name", "marker") == [("a", "m1"), ("b", "m2"), ("c", "m3")]
    with pytest.raises(ValueError):
        readers.fasta(spark, str(tmp_path / "none.fa"))


def test_seed_is_told_by_the_folder(spark, tmp_path):
    (tmp_path / "seed.csv").write_text("a\tB1\n")
    assert rows(readers.seed(spark, str(tmp_path / "seed.csv")), "name", "bin_label") == [("a", "B1")]
    bins = tmp_path / "bins.tsv"
    bins.mkdir()
    (bins / "x.1.fna").write_text(">a\nAC\n")
    (bins / "notes.md").write_text("> no bin\n")
    assert rows(readers.seed(spark, str(bins)), "name", "bin_label") == [("a", "x.1")]
    spark.createDataFrame([("q\tB2",)], "value string").write.text(str(tmp_path / "parts"))
    assert rows(readers.seed(spark, str(tmp_path / "parts")), "name", "bin_label") == [("q", "B2")]
    with pytest.raises(ValueError):
        readers.seed(spark, str(tmp_path / "nothing"))


def test_depth_rows_with_exponents(spark, tmp_path):
    (tmp_path / "d.tsv").write_text("contigName\tcontigLen\ttotalAvgDepth\ts1\ts1-var\na\t1e+05\t3\t1.5\t2\n")
    assert rows(readers.depth_table(spark, str(tmp_path / "d.tsv")), "name", "mean") == [("a", 1.5)]
    (tmp_path / "e.tsv").write_text("a\t9\t3\t1.5\t2\n")
    assert [readers.depth_header(spark, str(tmp_path / n)).first().named for n in ("d.tsv", "e.tsv")] == [True, False]
    assert readers.present(spark, [str(tmp_path / "d.tsv"), str(tmp_path / "no.tsv")]) == [str(tmp_path / "d.tsv")]


def test_markers(spark, tmp_path):
    (tmp_path / "t.tsv").write_text("# c\n@x\na\tm1\textra\nb\t \nb\tm2\n\n")
    (tmp_path / "b.tsv").write_text("# h\nb1\tComplete\ta\t9\nb2\tMissing\nb3\tDuplicated\tb\nb4\tFragmented\ta\n")
    (tmp_path / "p.tsv").write_text("a\t{'o1': {'m1': [[1, 2]], 'm2': [(3, 4)]}, 'o2': 5}\nb\tbroken{\n")
    assert rows(readers.markers(spark, [str(tmp_path / "t.tsv")], "table"), "name", "marker") == [("a", "m1"), ("b", "m2")]
    assert rows(readers.markers(spark, [str(tmp_path / "b.tsv")], "busco"), "name", "marker") == [("a", "b1"), ("b", "b3")]
    assert rows(readers.markers(spark, [str(tmp_path / "p.tsv")], "pfam"), "name", "marker") == [("a", "m1"), ("a", "m2")]


def test_seed_and_names(spark, tmp_path):
    bins = tmp_path / "bins"
    bins.mkdir()
    (bins / "bin.1.fa").write_text(">a x\nACGT\n>b\nAC\n")
    (bins / "lowDepth.fa").write_text(">c\nACGT\n")
    assert rows(readers.seed_directory(spark, str(bins)), "name", "bin_label") == [("a", "bin.1"), ("b", "bin.1")]
    (tmp_path / "s.tsv").write_text("@h\na_LN:5\tB1\nq\tB2\n")
    seed = readers.seed_table(spark, str(tmp_path / "s.tsv"))
    names = spark.createDataFrame([(0, "a")], "contig_id long, name string")
    assert rows(readers.resolve(seed, names).fillna(-1), "bin_label", "contig_id") == [("B1", 0), ("B2", -1)]
    (tmp_path / "bad.tsv").write_text("only\n")
    with pytest.raises(ValueError):
        readers.seed_table(spark, str(tmp_path / "bad.tsv"))


def test_depth(spark, tmp_path):
    (tmp_path / "d.tsv").write_text("contigName\tcontigLen\ttotalAvgDepth\ts1\ts1-var\ts2\ts2-var\na x\t9\t3\t1.5\t2\t3\t4\n")
    d = readers.depth_table(spark, str(tmp_path / "d.tsv"))
    assert rows(d, "name", "sample", "mean", "var") == [("a", "s0000", 1.5, 2.0), ("a", "s0001", 3.0, 4.0)]


def test_sinks(spark, tmp_path):
    b = spark.createDataFrame([(0, "B/2"), (1, "B1"), (9, "B1")], "contig_id long, bin_label string")
    n = spark.createDataFrame([(0, "a", "ACGT"), (1, "b", "AC")], "contig_id long, name string, seq string")
    assert [r.value for r in sinks.binning_lines(b, n, "s").collect()] == ["@Version:0.9.0", "@SampleID:s", "@@SEQUENCEID\tBINID", "a\tB/2", "b\tB1"]
    sinks.write_bin_fastas(n, b, str(tmp_path / "bins"))
    for _ in range(2):  # a second run leaves no second copy
        assert {p.name: p.read_text() for p in (tmp_path / "bins").iterdir()} == {"B1.fa": ">b\nAC\n", "B_2.fa": ">a\nACGT\n"}
        sinks.write_bin_fastas(n, b, str(tmp_path / "bins"))
    with pytest.raises(ValueError):
        sinks.write_bin_fastas(n, spark.createDataFrame([(0, "B/2"), (1, "B#2")], b.schema), str(tmp_path / "bins"))
    lengths = n.withColumn("length", sinks.F.length("seq").cast("long"))
    assert [r.value for r in sinks.seed_lines(b, lengths, "s").collect()] == ["@Version:0.9.0", "@SampleID:s", "@@SEQUENCEID\tBINID\tLENGTH", "a\tB/2\t4", "b\tB1\t2"]
    e = spark.createDataFrame([(0, 1, 0.5)], "src long, dst long, score double")
    assert [r.value for r in sinks.composite_lines(e, n).collect()] == ['composite("b","a",0.500000).']
    sinks.distance_lines(spark.createDataFrame([(0, 1, 7)], "c1 long, c2 long, d int")).write.text(str(tmp_path / "facts"))
    assert rows(sinks.read_facts(spark, str(tmp_path / "facts"), "comarker_sim", 3), "a1", "a2", "a3") == [(0, 1, 7)]
    with pytest.raises(ValueError):
        sinks.read_facts(spark, str(tmp_path / "facts"), "mg", 2)


def test_whole_run_from_files(spark, tmp_path):
    r = random.Random(4)
    genomes = [[r.choice(["ACGTACGGT", "TTTAACCA", "GGCGCGAT", "ATATCGAA"][g : g + 1] + ["ACGT"[k] for k in range(4)]) for _ in range(1200)] for g in range(3)]
    fasta, depth, marks, seed = [], ["contigName\tcontigLen\ttotalAvgDepth" + "".join(f"\ts{k}\ts{k}-var" for k in range(3))], [], []
    for i in range(24):
        g = i % 3
        body = "".join(r.sample(genomes[g], 900))
        name = f"k{7 * i % 24}"  # not in the order of names
        fasta.append(f">{name}\n{body}\n")
        if i < 23:  # one has no depth
            depth.append(f"{name}\t{len(body)}\t9" + "".join(f"\t{(5 + 7 * ((g + k) % 3)) + r.random():.3f}\t2.0" for k in range(3)))
        marks.append(f"{name}\tm{i // 3}")
        if i < 18:
            seed.append(f"{name}\tbin{g}")
    marks.append("short")
    for name, lines in (("a.fa", fasta), ("d.tsv", [x + "\n" for x in depth]), ("m.tsv", [x + "\n" for x in marks]), ("s.tsv", [x + "\n" for x in seed])):
        (tmp_path / name).write_text("".join(lines))
    p = lambda n: str(tmp_path / n)
    config = refine.RefineConfig(fasta=p("a.fa"), depth=p("d.tsv"), seed=p("s.tsv"), markers=(p("m.tsv"),), out=f"file://{p('out')}", min_bin_size=1000, write_bins=True)
    result = refine.run(spark, config)
    assert result.binning.count() >= 18 and result.binning.select("contig_id").distinct().count() == result.binning.count()
    assert rows(result.summaries, "operator", "not_optimal") == [("merge", 0), ("recruit", 0), ("separate", 0)]
    assert rows(refine.check(spark, config), "input", "status") == [("depth", "ok"), ("markers", "ok"), ("seed", "ok")]
    (tmp_path / "swapped.tsv").write_text("\n".join([depth[0], depth[2], depth[1], *depth[3:]]) + "\n")
    with pytest.raises(ValueError, match="order"):
        refine.run(spark, replace(config, depth=p("swapped.tsv")))
    told = json.loads("".join(f.read_text() for f in (tmp_path / "out" / "manifest").glob("part-*")))["counts"]
    want = {"contigs": 24, "contigs_without_depth": 1, "contigs_kept": 23, "marker_rows": 25, "marker_unparsed": 1, "marker_pairs": 24, "marker_files_missing": 0, "seed_rows": 18, "seed_unmatched": 0, "edges_without_correlation": 0, "pairs_within": 0}
    assert {k: told[k] for k in want} == want and told["edges"] > 0 and told["pairs_merge"] > 0
    ids = {r.name: r.contig_id for r in readers.contigs(spark, p("a.fa")).collect()}
    assert all(ids[f"k{7 * i % 24}"] == i for i in range(24))
    assert sum(f.read_text().count(">") for f in (tmp_path / "out" / "bins").glob("*.fa")) == result.filtered.count()
    assert (tmp_path / "out" / "binning_min1k").is_dir() and (tmp_path / "out" / "bins").is_dir() and (tmp_path / "out" / "manifest").is_dir()
    for bad in ({"operators": ("merge", "merge")}, {"simthresh": 201}, {"minlen": 10}, {"marker_format": "x"}):
        with pytest.raises(ValueError):
            refine.RefineConfig(**bad)


def test_integrity_checks_of_a_run(spark, tmp_path):
    from pyspark.sql import functions as F

    from spindrift.operators import checks

    head = "contigName\tcontigLen\ttotalAvgDepth\ts1\ts1-var\n"
    (tmp_path / "a.fa").write_text(">b x\nACGT\n>a\nACGT\n>c\nAC\n")
    (tmp_path / "good.tsv").write_text(head + "b x\t4\t1\t1\t2\na\t4\t1\t1.5\t2\nc\t2\t1\t0\t0\n")
    (tmp_path / "bad.tsv").write_text(head + "a\t4\t1\t1\t2\nb\t4\t1\tx\t2\nc\t2\t1\t1\n")
    order = readers.fasta_order(spark, str(tmp_path / "a.fa"))
    good, bad = (readers.depth_lines(spark, str(tmp_path / n)) for n in ("good.tsv", "bad.tsv"))
    assert [r.name for r in order.orderBy("ordinal").collect()] == ["b", "a", "c"]
    assert checks.order_of(good, order).count() == 0 and rows(checks.order_of(bad, order), "name") == [("b",)]
    assert checks.ragged_depth(good).count() == 0 and rows(checks.ragged_depth(bad), "name", "width") == [("b", 5), ("c", 4)]
    names = spark.createDataFrame([("a", 0), ("b", 1)], "name string, contig_id long")
    said = lambda *n: checks.match_counts(spark.createDataFrame([(x,) for x in n], "name string"), names)
    assert checks.verdict(said("a", "b"), "x") == "ok" and checks.verdict(said("a", "p", "q"), "x") == "warn"
    for none in ((), ("p",)):
        with pytest.raises(ValueError):
            checks.verdict(said(*none), "x")
    labels = spark.createDataFrame([(1, 7), (1, 99), (1, 100), (11, 0), (1, 1000), (110, 0)], "b long, s int").select(refine.slot_label(F.col("b"), F.col("s")).alias("l"))
    got = [r.l for r in labels.collect()]
    assert got[:3] == ["107", "199", "1_100"] and len(set(got)) == len(got)


def test_relaxed_coverage(spark):
    from spindrift.operators import comarker

    pairs = spark.createDataFrame([(0, 1), (0, 2), (1, 2)], "c1 long, c2 long")
    strict = spark.createDataFrame([(0, 1, 10)], "c1 long, c2 long, d int")
    loose = spark.createDataFrame([(0, 1, 10), (0, 2, 30)], "c1 long, c2 long, d int")
    assert rows(comarker.relaxed(pairs, strict, loose), "c1", "c2", "d") == [(0, 1, 10), (0, 2, 30)]
    assert rows(comarker.relaxed(pairs, strict, loose, 200), "c1", "c2", "d") == [(0, 1, 10), (0, 2, 30), (1, 2, 200)]
    assert comarker.relax_stats(strict, loose).first().asDict() == {"measured": 1, "recovered": 1, "changed": 0}
    changed = spark.createDataFrame([(0, 1, 11)], "c1 long, c2 long, d int")
    with pytest.raises(ValueError):
        comarker.relaxed(pairs, strict, changed)
