"""The refinement: an ordered list of operators over a seed binning, one written table a stage."""

from __future__ import annotations

import hashlib
import json
import logging
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spindrift.operators import affinity, checks, comarker, graph, measure, merge, recruit, report, separate, threshold
from spindrift.plans.stage import scratch, written
from spindrift.sources import readers, sinks

_log = logging.getLogger(__name__)
OPERATORS = ("separate", "merge", "recruit")


@dataclass(frozen=True)
class RefineConfig:
    """All options of a run; ``simthresh`` None derives the threshold from the seed."""

    name: str = "sample"
    fasta: str | None = None
    depth: str | None = None
    seed: str | None = None
    out: str | None = None
    markers: tuple[str, ...] = ()
    marker_format: str = "table"
    operators: tuple[str, ...] = OPERATORS
    simthresh: int | None = None
    sepmul: int = 1
    minconn: int = 0
    minaff: int = 0
    min_bin_size: int = 200_000
    minlen: int = 1500
    min_cv: float = 1.0
    variances: bool = True  # the depth table has a variance beside each mean
    relax_cv: bool = False  # measure pairs that the coverage filter leaves out without it
    random_cutoff: bool = False
    write_bins: bool = False
    nodes: int = 200_000

    def __post_init__(self):
        if any(o not in OPERATORS for o in self.operators) or len(set(self.operators)) != len(self.operators) or not self.operators:
            raise ValueError("operators: each of separate, merge, recruit at most once")
        if self.simthresh is not None and not 0 <= self.simthresh <= 200:
            raise ValueError("simthresh must lie between 0 and 200")
        if self.marker_format not in ("pfam", "busco", "table") or min(self.sepmul, self.minconn, self.min_bin_size) < 0 or self.minlen < 1500:
            raise ValueError("bad marker format, multiplier, size or length")

    @property
    def suffix(self) -> str:
        n = self.min_bin_size
        return f"_min{n // 1000}k" if n % 1000 == 0 and n else f"_min{n}bp"

    def fingerprint(self) -> str:
        """Of all options and input paths: a changed one never resumes old stages."""
        return hashlib.sha256(json.dumps(asdict(self), sort_keys=True).encode()).hexdigest()[:16]


@dataclass
class Result:
    binning: DataFrame
    filtered: DataFrame
    simthresh: int
    derived: bool
    stages: dict[str, DataFrame] = field(default_factory=dict)
    summaries: DataFrame | None = None


class Inputs:
    """What a run needs: lengths (contig_id, name, length), markers, seed (contig_id, bin_label), features, composite edges; features without a coverage filter if it is relaxed."""

    def __init__(self, lengths, mg, seed, features, composite, loose=None, counts=None):
        self.lengths, self.mg, self.seed, self.features, self.composite, self.loose = lengths, mg, seed, features, composite, loose
        self.counts = counts  # what a run has read, left out and measured, for its manifest; None if there is none


def numbered(binning: DataFrame) -> DataFrame:
    """bin_id by label order; labels are few."""
    ids = binning.select("bin_label").distinct().withColumn("bin_id", F.row_number().over(Window.orderBy("bin_label")).cast("long"))
    return binning.join(ids, "bin_label").select("contig_id", "bin_label", "bin_id")


def _pairs(mode: str, inputs: Inputs, binning: DataFrame) -> DataFrame:
    if mode == "guard":
        free = inputs.lengths.join(binning, "contig_id", "left_anti").select("contig_id")
        return comarker.pairs_guard(inputs.mg, free)
    return {"within": comarker.pairs_within, "merge": comarker.pairs_merge}[mode](inputs.mg, binning)


def distances(mode: str, inputs: Inputs, binning: DataFrame, fill: int | None) -> DataFrame:
    pairs = _pairs(mode, inputs, binning)
    one = _counted(mode, inputs, pairs)
    strict = measure.measure(one, inputs.features)
    if inputs.loose is None:
        return comarker.filled(pairs, strict, fill)
    strict, loose = written(strict, "strict"), written(measure.measure(one, inputs.loose, 0.0), "loose")
    if inputs.counts is not None:
        inputs.counts |= {f"{k}_{mode}": v for k, v in comarker.relax_stats(strict, loose).first().asDict().items()}
    return comarker.relaxed(pairs, strict, loose, fill)


def _counted(mode: str, inputs: Inputs, pairs: DataFrame) -> DataFrame:
    """The pairs, once each; a run counts them for its manifest."""
    one = written(pairs.select(F.least("c1", "c2").alias("c1"), F.greatest("c1", "c2").alias("c2")).distinct(), "pairs")
    n = one.count()
    if inputs.counts is not None:
        inputs.counts[f"pairs_{mode}"] = n
    if not n:
        _log.warning("%s: no two fragments share a marker", mode)
    return one


def far_pairs(mode: str, inputs: Inputs, binning: DataFrame, t: int, fill: int | None) -> DataFrame:
    """c1, c2, d of the pairs that are ``t`` or more apart, some of them repeated; measured in their markers' cells unless the coverage filter is relaxed."""
    if inputs.loose is not None:
        return written(distances(mode, inputs, binning, fill).where(F.col("d") >= t), f"far-{mode}")
    if inputs.counts is not None:
        _counted(mode, inputs, _pairs(mode, inputs, binning))
    if mode == "guard":
        free = inputs.lengths.join(binning, "contig_id", "left_anti").select("contig_id")
        return written(comarker.guard(inputs.mg, free, inputs.features, t, fill), "far-guard")
    return written(comarker.measured(inputs.mg, inputs.features, binning, mode == "within", least=t).select("c1", "c2", "d"), f"far-{mode}")


def derive_threshold(inputs: Inputs) -> tuple[int, bool]:
    row = threshold.derive(distances("within", inputs, inputs.seed, None), distances("merge", inputs, inputs.seed, None)).first()
    return int(row.simthresh), bool(row.derived)


def slot_label(bin_id, slot):
    """Bin number and slot of two digits; a slot of more digits is set off, so that no two bins share a label."""
    s = slot.cast("string")
    return F.concat(bin_id.cast("string"), F.when(slot < 100, F.lpad(s, 2, "0")).otherwise(F.concat(F.lit("_"), s)))


def run_separate(inputs: Inputs, binning: DataFrame, t: int, c: RefineConfig) -> DataFrame:
    bins = numbered(binning)
    mg = inputs.mg.join(binning, "contig_id", "left_semi")
    conflicts = written(separate.cannot_link(far_pairs("within", inputs, binning, t, None), bins, t), "conflicts")
    pins = affinity.pins(mg, binning).join(bins.select("bin_label", "bin_id").distinct(), "bin_label").select("bin_id", "contig_id")
    aff = written(affinity.anchor_affinity(inputs.composite, mg, binning), "anchor-affinity")  # components, search, bound and value read it
    s = separate.separate(bins, aff, conflicts, pins, t, c.sepmul, c.nodes)
    return s.select("contig_id", F.concat(F.lit("Bin_"), slot_label(F.col("bin_id"), F.col("slot"))).alias("bin_label"), "status")


def run_merge(inputs: Inputs, binning: DataFrame, t: int, c: RefineConfig) -> DataFrame:
    bins = numbered(binning)
    aff = affinity.affinity(inputs.composite, inputs.lengths)
    binaff = affinity.bin_affinity(aff, bins)
    if inputs.loose is not None:
        m = merge.merge(binaff, far_pairs("merge", inputs, binning, t, comarker.UNMEASURED), bins, t, c.minconn)
    else:  # only pairs of bins that may merge are measured
        if inputs.counts is not None:
            _counted("merge", inputs, _pairs("merge", inputs, binning))
        mutual = written(merge.mutual_pairs(binaff), "mutual")
        pairs = merge.unblocked(mutual, comarker.unlike(inputs.mg, bins, mutual, inputs.features, t), c.minconn)
        m = merge.joined(merge.components(pairs, bins), bins)
    return m.select("contig_id", F.concat(F.lit("Bin_"), F.col("bin_id").cast("string")).alias("bin_label"), F.lit("optimal").alias("status"))


def run_recruit(inputs: Inputs, binning: DataFrame, t: int, c: RefineConfig) -> DataFrame:
    bins = numbered(binning)
    free = inputs.lengths.join(binning, "contig_id", "left_anti").select("contig_id")
    edges = affinity.recruit_affinity(inputs.composite, free, binning).join(bins.select("bin_label", "bin_id").distinct(), "bin_label").select("c", "bin_id", "w")
    got = recruit.recruit(edges, far_pairs("guard", inputs, binning, t, comarker.UNMEASURED), bins, t, c.minaff, c.nodes)
    labels = bins.select("bin_id", "bin_label").distinct()
    before = binning.select("contig_id", "bin_label", F.lit("optimal").alias("status"))
    return before.union(got.join(labels, "bin_id").select("contig_id", "bin_label", "status"))


_RUN = {"separate": run_separate, "merge": run_merge, "recruit": run_recruit}


def run_stages(spark: SparkSession, inputs: Inputs, config: RefineConfig, folder: str | None = None) -> Result:
    """All operators in order. Stages are Parquet tables named by the operators so far; a complete one is read instead of run again."""
    if not inputs.mg.limit(1).count():
        raise ValueError("no marker facts: the guards would be empty")
    t, derived = (config.simthresh, False) if config.simthresh is not None else derive_threshold(inputs)
    folder = folder or scratch(spark, "refine")
    before, stages, summary, prefix = inputs.seed, {}, None, ""
    for op in config.operators:
        prefix += f"{op}-"
        path = f"{folder}/{config.fingerprint()}/{prefix.rstrip('-')}"
        done = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
        if not done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done):
            _RUN[op](inputs, before, t, config).write.mode("overwrite").parquet(path)
        after = spark.read.parquet(path)  # contig_id, bin_label, status
        cut = after.where("status <> 'optimal'").agg(F.count(F.lit(1)).alias("not_optimal"))
        checks.not_fewer(before, after, op)
        kept = report.min_bin_size(after, inputs.lengths, config.min_bin_size)
        row = report.stage_summary(before, after, kept).crossJoin(cut).select(F.lit(op).alias("operator"), "*")  # one-row tables
        summary = row if summary is None else summary.union(row)
        stages[op], before = after, after
    filtered = report.min_bin_size(before, inputs.lengths, config.min_bin_size)
    return Result(before, filtered, t, derived, stages, summary)


def refine(domain, config: RefineConfig | None = None) -> Result:
    """The refinement over derived tables (``sources.fixtures.Domain``)."""
    config = config or RefineConfig(simthresh=60, min_bin_size=20_000)
    return run_stages(domain.spark, Inputs(domain.lengths, domain.markers(True), domain.seed(), domain.features, domain.composite), config)


def inputs_from_files(spark: SparkSession, config: RefineConfig) -> Inputs:
    """Read and check the inputs of a run."""
    contigs = written(readers.contigs(spark, config.fasta, config.minlen), "sequences")
    names = contigs.select("contig_id", "name", "length")
    if not names.limit(1).count():
        raise ValueError("no contig is long enough")
    depth = readers.depth_table(spark, config.depth, config.variances)
    if not readers.depth_header(spark, config.depth).first().named:
        _log.warning("depth: the first column of the header is not %s", readers.DEPTH_HEADER)
    checks.verdict(checks.match_counts(depth, names), "depth")
    without = checks.missing_depth(depth, names).count()
    if without:
        _log.warning("depth: %d contigs have none and are not compared", without)
    checks.require(checks.ragged_depth(readers.depth_lines(spark, config.depth), config.variances), "depth rows of another width than the header's, or with other than numbers")
    checks.require(checks.order_of(readers.depth_lines(spark, config.depth), readers.fasta_order(spark, config.fasta)), "depth rows in another order than the assembly")
    rows = readers.resolve(depth, names).where("contig_id is not null").select("contig_id", "sample", "mean", "var")
    paths = list(config.markers)
    if config.marker_format == "busco":  # tables of single lineages may be missing
        paths = readers.present(spark, paths)
        for p in set(config.markers) - set(paths):
            _log.warning("markers: no file at %s, skipped", p)
    seen = Observation("marker rows")
    marks = written(readers.markers(spark, paths, config.marker_format, seen), "marker-rows")
    counts = {"contigs_without_depth": without, "marker_files_missing": len(config.markers) - len(paths)} | {f"marker_{k}": int(v) for k, v in seen.get.items()} | {"contigs": names.count(), "marker_pairs": marks.count()}
    checks.verdict(checks.match_counts(marks, names), "markers")
    mg = written(readers.incidence(marks, names), "markers")
    if mg.select("contig_id").distinct().limit(2).count() < 2:
        _log.warning("markers: fewer than 2 contigs with a marker, so no two can be told apart")
    said = written(readers.seed(spark, config.seed), "seed-rows")
    counts |= {"seed_rows": said.count(), "seed_unmatched": int(checks.match_counts(said, names).first().unmatched)}
    checks.verdict(checks.match_counts(said, names), "seed")
    seed = readers.resolve(said, names).where("contig_id is not null")
    checks.require(checks.seed_conflicts(seed.select("name", "bin_label")), "contigs in two bins")
    seed = written(seed.select("contig_id", "bin_label").distinct(), "seed")
    feats = written(measure.features(contigs, rows, config.min_cv, config.min_cv), "features")
    near = written(graph.neighbours(feats, config.min_cv, later=True), "neighbours")
    reach = graph.coverage_curve(near)
    p = graph.pooled_cutoff(reach) if config.random_cutoff else graph.cutoff(reach)
    loose = written(measure.features(contigs, rows, 0.0, 0.0), "loose-features") if config.relax_cv else None
    edges = written(graph.composite(graph.knn_edges(near, p), feats, config.min_cv), "composite")
    counts |= {"contigs_kept": feats.count(), "edges": edges.count(), "edges_without_correlation": edges.where("s_cor is null").count(), "cutoff": p}
    return Inputs(written(names, "contigs"), mg, seed, feats, edges, loose, counts)


def check(spark: SparkSession, config: RefineConfig) -> DataFrame:
    """One row an input of what is read and matched, with a verdict; nothing is run."""
    names = written(readers.fasta(spark, config.fasta).where(F.col("length") >= config.minlen).select("name", F.lit(0).alias("contig_id")), "check-names")
    rows = {"depth": readers.depth_table(spark, config.depth, config.variances), "markers": readers.markers(spark, list(config.markers), config.marker_format), "seed": readers.seed(spark, config.seed)}
    out = None
    for what, d in rows.items():
        row = checks.match_counts(d, names).select(F.lit(what).alias("input"), "*")
        out = row if out is None else out.union(row)
    return out


def run(spark: SparkSession, config: RefineConfig) -> Result:
    """A whole run from files to files."""
    inputs = inputs_from_files(spark, config)
    result = run_stages(spark, inputs, config, f"{config.out}/work" if config.out else None)
    if config.out:
        sinks.write_binning(result.binning, inputs.lengths, config.name, f"{config.out}/binning")
        sinks.write_binning(result.filtered, inputs.lengths, config.name, f"{config.out}/binning{config.suffix}")
        sinks.write_summary(result.summaries, f"{config.out}/summary")
        sinks.write_manifest(spark, asdict(config) | {"simthresh_used": result.simthresh, "derived": result.derived, "counts": inputs.counts}, f"{config.out}/manifest")
        sinks.write_seed(inputs.seed, inputs.lengths, config.name, f"{config.out}/seed")
        if config.write_bins:
            sinks.write_bin_fastas(readers.contigs(spark, config.fasta, config.minlen), result.filtered, f"{config.out}/bins")
    return result
