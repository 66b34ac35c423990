"""Every query of the refinement engine, by name, with its SQL oracle.

Oracles are composed from named fragments: a query's SQL is its SELECT, preceded by the
fragments it mentions, directly or not.
"""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from spindrift.functions import tnf
from spindrift.operators import affinity, checks, comarker, measure, merge, recruit, report, separate, threshold
from spindrift.plans.stage import scratch
from spindrift.sources import readers, sinks
from spindrift.sources.fixtures import BASES, LETTERS, MIN_LENGTH, SIMTHRESH, UNBINNED, Domain

_UNBINNED = ", ".join(f"'{s}'" for s in UNBINNED)


def _erf(z: str) -> str:
    """erf by its everywhere positive series, within 6e-15 for |z| <= 5.9, 1 beyond."""
    terms = f"list_sum(list_transform(range(0, 160), lambda n: pow(abs({z}), 2 * n + 1) / exp(lgamma(n + 1.5))))"
    return f"(CASE WHEN abs({z}) > 5.9 THEN sign({z}) ELSE sign({z}) * least(1.0, exp(-{z} * {z}) * {terms}) END)"


def _measured(pairs: str) -> str:
    """Fragments that measure the pairs of one fragment (c1, c2, both kept)."""
    return f"""
SELECT p.c1, p.c2, list_distance(a.v, b.v) AS tnf_dist, least(a.lg, b.lg) AS x, greatest(a.lg, b.lg) AS y
FROM {pairs} p JOIN feat a ON a.contig_id = p.c1 JOIN feat b ON b.contig_id = p.c2"""


_ABD_STEPS = {
    "raw": """
SELECT p.c1, p.c2, a.sample, (a.mean > 1 OR b.mean > 1) AS nz, a.mean AS mean1, b.mean AS mean2,
  greatest(a.mean, 1e-6) AS m1, greatest(b.mean, 1e-6) AS m2, greatest(a.var, 1.0) AS v1, greatest(b.var, 1.0) AS v2
FROM {p} p JOIN kept k1 ON k1.contig_id = p.c1 JOIN kept k2 ON k2.contig_id = p.c2 JOIN depth a ON a.contig_id = p.c1 JOIN depth b ON b.contig_id = p.c2 AND b.sample = a.sample""",
    "side": """
SELECT *, CASE WHEN v1 > v2 THEN m2 ELSE m1 END AS am, CASE WHEN v1 > v2 THEN v2 ELSE v1 END AS av, CASE WHEN v1 > v2 THEN m1 ELSE m2 END AS bm, CASE WHEN v1 > v2 THEN v1 ELSE v2 END AS bv, abs(v1 - v2) < 1e-4 AS same FROM {t}raw""",
    "cut": """
SELECT *, CASE WHEN same THEN (am + bm) / 2 ELSE (am * bv - bm * av - sqrt(greatest(av * bv * ((am - bm) * (am - bm) + (bv - av) * ln(bv / av)), 0))) / (CASE WHEN same THEN 1 ELSE bv - av END) END AS k1,
  CASE WHEN same THEN (am + bm) / 2 ELSE (am * bv - bm * av + sqrt(greatest(av * bv * ((am - bm) * (am - bm) + (bv - av) * ln(bv / av)), 0))) / (CASE WHEN same THEN 1 ELSE bv - av END) END AS k2 FROM {t}side""",
    "z": """
SELECT *, (k1 - am) / sqrt(2 * av) AS z1, (k1 - bm) / sqrt(2 * bv) AS z2, (k2 - am) / sqrt(2 * av) AS z3, (k2 - bm) / sqrt(2 * bv) AS z4 FROM {t}cut""",
    "phi": f"""
SELECT *, 0.5 * (1 + {_erf('z1')}) AS f1, 0.5 * (1 + {_erf('z2')}) AS f2, 0.5 * (1 + {_erf('z3')}) AS f3, 0.5 * (1 + {_erf('z4')}) AS f4 FROM {{t}}z""",
    "abd": """
SELECT c1, c2, sample, nz, mean1, mean2, greatest(1e-6, least(1 - 1e-6, CASE WHEN m1 = m2 THEN 0 WHEN same THEN abs(f1 - f2) ELSE abs(f3 - f1 + f2 - f4) END)) AS dist FROM {t}phi""",
    "mean": """
SELECT c1, c2, coalesce(avg(dist) FILTER (nz), 1.0) AS abd_dist, count(*) FILTER (nz) AS nnz,
  CASE WHEN min(mean1) < max(mean1) AND min(mean2) < max(mean2) THEN corr(mean1, mean2) END AS corr FROM {t}abd GROUP BY c1, c2""",
}


def _bundle(t: str, pairs: str) -> dict[str, str]:
    """All measuring fragments of one fragment of pairs, prefixed by ``t``."""
    out = {f"{t}{k}": v.replace("{p}", pairs).replace("{t}", t) for k, v in _ABD_STEPS.items()}
    out[f"{t}tnf"] = _measured(pairs)
    out[f"{t}prob"] = f"SELECT c1, c2, tnf_dist, {tnf.probability_sql('tnf_dist', 'x', 'y')} AS tnf_prob FROM {t}tnf"
    out[f"{t}d"] = f"""
SELECT p.c1, p.c2, (floor(round(p.tnf_prob * 100, 7)) + floor(round(m.abd_dist * 100, 7)))::INT AS d FROM {t}prob p JOIN {t}mean m ON m.c1 = p.c1 AND m.c2 = p.c2"""
    return out


FRAGMENTS = {
    "contigs": f"""
SELECT * FROM (SELECT doc_id AS contig_id, 'c' || doc_id AS name, lang, source, translate(regexp_replace(lower(text), '[^a-z]', '', 'g'), '{LETTERS}', '{BASES}') AS seq, length(seq) AS length FROM documents) WHERE length >= {MIN_LENGTH}""",
    "depth": """
SELECT g.contig_id, g.sample, coalesce(m, 0.0) AS mean, coalesce(v, 0.0) AS var FROM (SELECT contig_id, unnest(['A', 'N', 'R']) AS sample FROM contigs) g
LEFT JOIN (SELECT l_partkey AS contig_id, l_returnflag AS sample, avg(l_quantity) AS m, var_samp(l_quantity) AS v FROM lineitem GROUP BY 1, 2) l ON l.contig_id = g.contig_id AND l.sample = g.sample""",
    "mg": "SELECT DISTINCT l_partkey AS contig_id, l_suppkey AS marker_id FROM lineitem WHERE l_discount >= 0.095 AND l_partkey IN (SELECT contig_id FROM contigs)",
    "dmg": "SELECT DISTINCT l_partkey AS contig_id, l_suppkey AS marker_id FROM lineitem WHERE l_discount >= 0.075 AND l_partkey IN (SELECT contig_id FROM contigs)",
    "seed": f"SELECT contig_id, lang || '_' || source AS bin_label, lang FROM contigs WHERE source NOT IN ({_UNBINNED}) AND lang IS NOT NULL",
    "bins": "SELECT contig_id, bin_label, dense_rank() OVER (ORDER BY bin_label) AS bin_id FROM seed",
    "recruitable": "SELECT contig_id FROM contigs WHERE contig_id NOT IN (SELECT contig_id FROM seed)",
    "kept": "SELECT contig_id FROM depth GROUP BY contig_id HAVING sum(CASE WHEN mean >= 1 THEN mean ELSE 0 END) >= 1 AND min(mean) >= 0 AND max(mean) <= 1e7 AND min(var) >= 0 AND max(var) <= 1e14",
    "kmers": """
SELECT contig_id, least(k, reverse(translate(k, 'ACGT', 'TGCA'))) AS kmer, count(*) AS n FROM (SELECT contig_id, unnest(list_transform(range(1, length - 2), lambda i: substr(seq, i, 4))) AS k FROM contigs) GROUP BY 1, 2""",
    "norm": "SELECT contig_id, sqrt(sum(n * n)) AS norm FROM kmers GROUP BY contig_id",
    "feat": f"""
SELECT g.contig_id, list(coalesce(k.n, 0) / n.norm ORDER BY g.kmer) AS v, any_value(log10(least(c.length, {tnf.LONGEST}))) AS lg
FROM (SELECT contig_id, unnest([{', '.join(f"'{k}'" for k in tnf.KMERS)}]) AS kmer FROM kept) g JOIN norm n ON n.contig_id = g.contig_id JOIN contigs c ON c.contig_id = g.contig_id LEFT JOIN kmers k ON k.contig_id = g.contig_id AND k.kmer = g.kmer GROUP BY g.contig_id""",
    "p_all": "SELECT DISTINCT a.contig_id AS c1, b.contig_id AS c2 FROM mg a JOIN mg b ON a.marker_id = b.marker_id AND a.contig_id < b.contig_id",
    "p_within": "SELECT DISTINCT a.contig_id AS c1, b.contig_id AS c2 FROM mg a JOIN mg b ON a.marker_id = b.marker_id AND a.contig_id < b.contig_id JOIN seed s ON s.contig_id = a.contig_id JOIN seed t ON t.contig_id = b.contig_id AND t.bin_label = s.bin_label",
    "p_merge": "SELECT DISTINCT a.contig_id AS c1, b.contig_id AS c2 FROM mg a JOIN mg b ON a.marker_id = b.marker_id AND a.contig_id < b.contig_id JOIN seed s ON s.contig_id = a.contig_id JOIN seed t ON t.contig_id = b.contig_id AND t.bin_label <> s.bin_label",
    "p_guard": "SELECT DISTINCT a.contig_id AS c1, b.contig_id AS c2 FROM mg a JOIN recruitable r ON r.contig_id = a.contig_id JOIN mg b ON a.marker_id = b.marker_id AND a.contig_id <> b.contig_id",
    "p_lang": "SELECT DISTINCT a.contig_id AS c1, b.contig_id AS c2, s.lang = t.lang AS same FROM mg a JOIN mg b ON a.marker_id = b.marker_id AND a.contig_id < b.contig_id JOIN seed s ON s.contig_id = a.contig_id JOIN seed t ON t.contig_id = b.contig_id",
    "p_dwithin": "SELECT DISTINCT a.contig_id AS c1, b.contig_id AS c2, s.bin_id FROM dmg a JOIN dmg b ON a.marker_id = b.marker_id AND a.contig_id < b.contig_id JOIN bins s ON s.contig_id = a.contig_id JOIN bins t ON t.contig_id = b.contig_id AND t.bin_id = s.bin_id",
    "p_dguard": "SELECT DISTINCT a.contig_id AS c1, b.contig_id AS c2 FROM dmg a JOIN recruitable r ON r.contig_id = a.contig_id JOIN dmg b ON a.marker_id = b.marker_id AND a.contig_id <> b.contig_id",
    **_bundle("m_", "p_all"),
    **_bundle("w_", "p_dwithin"),
    **_bundle("g_", "p_dguard"),
    "p_dmerge": "SELECT DISTINCT a.contig_id AS c1, b.contig_id AS c2 FROM dmg a JOIN dmg b ON a.marker_id = b.marker_id AND a.contig_id < b.contig_id JOIN seed s ON s.contig_id = a.contig_id JOIN seed t ON t.contig_id = b.contig_id AND t.bin_label <> s.bin_label",
    **_bundle("x_", "p_dmerge"),
    "dfilled": "SELECT p.c1, p.c2, coalesce(m.d, 200) AS d FROM p_dmerge p LEFT JOIN x_d m ON m.c1 = p.c1 AND m.c2 = p.c2",
    "dunlike": f"SELECT DISTINCT least(s.bin_id, t.bin_id) AS b1, greatest(s.bin_id, t.bin_id) AS b2 FROM dfilled f JOIN bins s ON s.contig_id = f.c1 JOIN bins t ON t.contig_id = f.c2 WHERE d >= {SIMTHRESH}",
    "filled": "SELECT p.c1, p.c2, coalesce(m.d, 200) AS d FROM p_merge p LEFT JOIN m_d m ON m.c1 = p.c1 AND m.c2 = p.c2",
    "curve": """
SELECT t::INT AS t, (SELECT count(*) FROM p_lang p JOIN m_d m ON m.c1 = p.c1 AND m.c2 = p.c2 WHERE same AND d >= t) + (SELECT count(*) FROM p_lang p JOIN m_d m ON m.c1 = p.c1 AND m.c2 = p.c2 WHERE NOT same AND d < t) AS err FROM range(0, 201) r(t)""",
    "every": "SELECT a.contig_id AS c1, b.contig_id AS c2 FROM kept a JOIN kept b ON a.contig_id < b.contig_id",
    "e_tnf": _measured("every"),
    "sims": f"SELECT c1, c2, round(1 - {tnf.probability_sql('tnf_dist', 'x', 'y')}, 6) AS sim FROM e_tnf",
    "pairsym": "SELECT c1 AS src, c2 AS dst, sim FROM sims UNION ALL SELECT c2, c1, sim FROM sims",
    "rowmax": "SELECT src, max(sim) AS sim FROM pairsym GROUP BY src",
    "cover": "SELECT p, avg(CASE WHEN sim >= p / 1000.0 THEN 1.0 ELSE 0.0 END) AS cov FROM rowmax, range(701, 1000) r(p) GROUP BY p",
    "hit": "SELECT max(p) AS p FROM cover WHERE cov >= 0.95",
    "per_mille": """
SELECT CASE WHEN h.p IS NULL THEN 700 WHEN c.cov - 0.95 > 0.95 - coalesce(l.cov, 0) THEN h.p + 1 ELSE h.p END AS p FROM hit h LEFT JOIN cover c ON c.p = h.p LEFT JOIN cover l ON l.p = h.p + 1""",
    "nz": "SELECT contig_id FROM depth GROUP BY contig_id HAVING max(mean) > 1",
    "knn": """
SELECT src, dst, sim FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY sim DESC, dst) AS r FROM pairsym WHERE src IN (SELECT contig_id FROM nz) OR dst IN (SELECT contig_id FROM nz))
WHERE r <= 200 AND dst > src AND sim > (SELECT p FROM per_mille) / 1000.0""",
    "p_knn": "SELECT src AS c1, dst AS c2 FROM knn",
    **{k: v for k, v in _bundle("k_", "p_knn").items() if k not in ("k_tnf", "k_prob", "k_d")},
    "scored": "SELECT e.src, e.dst, e.sim AS s_tnf, round(1 - m.abd_dist, 6) AS s_abd, round(m.corr, 6) AS s_cor, m.nnz FROM knn e JOIN k_mean m ON m.c1 = e.src AND m.c2 = e.dst",
    "ranked": "SELECT *, rank() OVER (ORDER BY s_tnf) AS rank_tnf, count(*) OVER (ORDER BY coalesce(s_cor, 9)) AS rank_cor FROM scored",
    "quantile": "SELECT s_abd AS at, row_number() OVER (ORDER BY s_abd) AS k FROM scored",
    "composite": """
SELECT r.*, round(sqrt(pow(s_abd, 1 - 1.0 / (1 + nnz)) * pow(t.at, 1.0 / (1 + nnz)) * c.at), 6) AS score FROM ranked r JOIN quantile t ON t.k = rank_tnf JOIN quantile c ON c.k = rank_cor""",
    "ends": "SELECT src, dst, score, unnest([src, dst]) AS e FROM composite",
    "top": "SELECT DISTINCT src, dst, score FROM (SELECT *, row_number() OVER (PARTITION BY e ORDER BY score DESC, 'c' || src DESC, 'c' || dst DESC) AS r FROM ends) WHERE r <= 5",
    "aff": "SELECT src AS c1, dst AS c2, round_even(score * 1000, 0)::INT AS w FROM top WHERE round_even(score * 1000, 0) > 0",
    "binaff": "SELECT least(s.bin_id, t.bin_id) AS b1, greatest(s.bin_id, t.bin_id) AS b2, count(*) AS n FROM aff a JOIN bins s ON s.contig_id = a.c1 JOIN bins t ON t.contig_id = a.c2 WHERE s.bin_id <> t.bin_id GROUP BY 1, 2",
    "links": "SELECT b1 AS b, b2 AS partner, n FROM binaff UNION ALL SELECT b2, b1, n FROM binaff",
    "best": "SELECT b, partner, n FROM (SELECT *, rank() OVER (PARTITION BY b ORDER BY n DESC) AS r FROM links) WHERE r = 1 AND n > 0",
    "mutual": "SELECT x.b AS b1, x.partner AS b2, x.n FROM best x JOIN best y ON y.b = x.partner AND y.partner = x.b WHERE x.b < x.partner",
    "unlike": f"SELECT DISTINCT least(s.bin_id, t.bin_id) AS b1, greatest(s.bin_id, t.bin_id) AS b2 FROM filled f JOIN bins s ON s.contig_id = f.c1 JOIN bins t ON t.contig_id = f.c2 WHERE d >= {SIMTHRESH}",
    "blocked": "SELECT m.b1, m.b2 FROM mutual m JOIN unlike u ON u.b1 = m.b1 AND u.b2 = m.b2",
    "merges": "SELECT b1, b2, n FROM mutual m WHERE NOT EXISTS (SELECT 1 FROM blocked x WHERE x.b1 = m.b1 AND x.b2 = m.b2)",
    "reach": "SELECT bin_id AS a, bin_id AS b FROM bins UNION SELECT r.a, CASE WHEN m.b1 = r.b THEN m.b2 ELSE m.b1 END FROM reach r JOIN merges m ON m.b1 = r.b OR m.b2 = r.b",
    "rep": "SELECT a AS bin_id, min(b) AS rep FROM reach GROUP BY a",
    "conflicts": f"SELECT p.bin_id, d.c1, d.c2, d.d FROM w_d d JOIN p_dwithin p ON p.c1 = d.c1 AND p.c2 = d.c2 WHERE d.d >= {SIMTHRESH}",
    "ends_of": "SELECT bin_id, c1 AS node, c2 AS other FROM conflicts UNION SELECT bin_id, c2, c1 FROM conflicts",
    "place": "SELECT bin_id, node, row_number() OVER (PARTITION BY bin_id ORDER BY count(*) DESC, node) AS k FROM ends_of GROUP BY bin_id, node",
    "before": "SELECT p.bin_id, p.k, list(q.k) FILTER (q.k < p.k) AS near FROM ends_of e JOIN place p ON p.bin_id = e.bin_id AND p.node = e.node JOIN place q ON q.bin_id = e.bin_id AND q.node = e.other GROUP BY 1, 2",
    "greedy": """
SELECT DISTINCT bin_id, 0::BIGINT AS k, []::INT[] AS c FROM ends_of
UNION ALL SELECT g.bin_id, b.k, list_append(g.c, list_min(list_filter(range(0, b.k)::INT[], lambda x: NOT list_contains([g.c[j] for j in coalesce(b.near, [])], x))))
FROM greedy g JOIN before b ON b.bin_id = g.bin_id AND b.k = g.k + 1""",
    "slots": "SELECT bin_id, max(list_max(c) + 1)::INT AS k FROM greedy WHERE k > 0 GROUP BY bin_id",
    "anchors": "SELECT contig_id, bin_label FROM seed WHERE contig_id IN (SELECT contig_id FROM dmg)",
    "pin": "SELECT s.bin_label, coalesce(min(a.contig_id), min(s.contig_id)) AS contig_id FROM seed s LEFT JOIN anchors a ON a.contig_id = s.contig_id GROUP BY 1",
    "sym": "SELECT src, dst, score FROM composite UNION ALL SELECT dst, src, score FROM composite",
    "ancaff": """
SELECT c, anchor, w FROM (SELECT e.src AS c, e.dst AS anchor, round_even(score * 1000, 0)::INT AS w, row_number() OVER (PARTITION BY e.src ORDER BY score DESC, e.dst DESC) AS r
FROM sym e JOIN seed s ON s.contig_id = e.src JOIN anchors a ON a.contig_id = e.dst AND a.bin_label = s.bin_label) WHERE r <= 5 AND w > 0""",
    "recaff": "SELECT e.src AS c, e.dst AS member, b.bin_id, round_even(score * 1000, 0)::INT AS w FROM sym e JOIN recruitable r ON r.contig_id = e.src JOIN bins b ON b.contig_id = e.dst WHERE round_even(score * 1000, 0) > 0",
    "cand": "SELECT c, bin_id, sum(w) AS w FROM recaff GROUP BY c, bin_id",
    "guard": "SELECT p.c1, p.c2, coalesce(m.d, 200) AS d FROM p_dguard p LEFT JOIN g_d m ON m.c1 = p.c1 AND m.c2 = p.c2",
    "recblock": f"SELECT DISTINCT g.c1 AS c, b.bin_id FROM guard g JOIN bins b ON b.contig_id = g.c2 WHERE g.d >= {SIMTHRESH}",
    "sizes": "SELECT bin_label, count(*) AS contigs, sum(length) AS bp FROM seed JOIN contigs USING (contig_id) GROUP BY bin_label",
    "merged": "SELECT b.contig_id, r.rep AS bin_id FROM bins b JOIN rep r ON r.bin_id = b.bin_id",
}


def _sql(select: str) -> str:
    need: list[str] = []

    def visit(text: str, seen: tuple[str, ...]) -> None:
        for name in FRAGMENTS:
            if name not in seen and name not in need and re.search(rf"(?<![\w.]){name}(?![\w])", re.sub(r"'[^']*'", "", text)):
                visit(FRAGMENTS[name], (*seen, name))
                if name not in need:
                    need.append(name)

    visit(select, ())
    recursive = "RECURSIVE " if {"reach", "greedy"} & set(need) else ""
    heavy = {"feat", "sims", "pairsym", "knn", "composite", "m_d", "w_d", "g_d", "x_d", "scored", "k_mean"}
    return f"WITH {recursive}" + ",\n".join(f"{n} AS {'MATERIALIZED ' if n in heavy else ''}({FRAGMENTS[n]})" for n in need) + f"\n{select}" if need else select


QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def _query(name: str, make, sql: str | None = None) -> None:
    if name in QUERIES:
        raise ValueError(f"two queries are called {name}")
    QUERIES[name] = lambda spark, sf_dir: make(Domain(spark, sf_dir))
    if sql:
        ORACLE_SQL[name] = _sql(sql)


def _round(df, *names):
    return df.withColumns({n: F.round(n, 6) for n in names})


def _depth_rows(d: Domain):
    """The depth table as a file lists it: each contig stands where its first order does."""
    s = d.table("lineitem").groupBy(F.col("l_partkey").alias("id")).agg(F.min("l_orderkey").alias("ordinal"))
    return s.select("ordinal", F.concat(F.lit("c"), F.col("id").cast("string")).alias("name"))


def _deep_rows(d: Domain):
    """The rows of a depth file that holds only what has a mean of 25.5 or more."""
    return d.table("lineitem").groupBy(F.concat(F.lit("c"), F.col("l_partkey").cast("string")).alias("name")).agg(F.avg("l_quantity").alias("mean")).where("mean >= 25.5")


def _language_pairs(d: Domain):
    return tuple(d.measured_pairs(mode, fragmented=False).select("c1", "c2", "d") for mode in ("within", "merge"))


def _summary(d: Domain):
    after = d.merged.select("contig_id", F.col("bin_id").cast("string").alias("bin_label"))
    kept = report.min_bin_size(after, d.lengths, 20_000)
    return report.stage_summary(d.seed(), after, kept)


def _separate_refines(d: Domain):
    """Rows of the separation that break the seed partition or lose a fragment: none."""
    s = d.separated.join(d.bins.select("contig_id", F.col("bin_id").alias("own")), "contig_id", "full")
    return s.where("slot is null or own is null or own <> bin_id").select("contig_id")


def _guard_holds(d: Domain):
    """Recruited fragments that share a bin with a dissimilar one: none."""
    placed = d.recruited.select("contig_id", "bin_id").union(d.bins.select("contig_id", "bin_id"))
    g = recruit.dissimilar(d.guard, SIMTHRESH)
    g = g.join(d.recruited.select(F.col("contig_id").alias("c1"), "bin_id"), "c1").join(placed.select(F.col("contig_id").alias("c2"), F.col("bin_id").alias("b2")), "c2")
    return g.where("bin_id = b2").select(F.col("c1").alias("contig_id"), F.col("c2").alias("other"))


def _refinement(d: Domain):
    from spindrift.plans.refine import refine

    return refine(d).binning


_S = "contig_id"
_query("contig_dict", lambda d: _dense(d), "SELECT row_number() OVER (ORDER BY contig_id) - 1 AS dense_id, name, length FROM contigs")
_query("marker_incidence", lambda d: d.markers(), "SELECT * FROM mg")
_query("marker_incidence_dense", lambda d: d.markers(True), "SELECT * FROM dmg")
_query("marker_legend", lambda d: _legend(d), "SELECT dense_rank() OVER (ORDER BY marker_id) AS marker_int, marker_id FROM (SELECT DISTINCT marker_id FROM mg)")
_query("seed_bins", lambda d: d.bins, "SELECT * FROM bins")
_query("recruitable", lambda d: d.recruitable, "SELECT * FROM recruitable")
_query("depth_long", lambda d: _round(d.depth, "mean", "var"), "SELECT contig_id, sample, round(mean, 6) AS mean, round(var, 6) AS var FROM depth")
_query("kept_contigs", lambda d: measure.kept(d.depth), "SELECT * FROM kept")
_query("duplicate_names", lambda d: checks.duplicate_names(d.table("part").select(F.col("p_name").alias("name"))), "SELECT p_name AS name, count(*) AS n FROM part GROUP BY 1 HAVING n > 1")
_query(
    "depth_order_violations", lambda d: checks.depth_order_violations(_depth_rows(d), d.lengths),
    "SELECT name, ordinal FROM (SELECT name, ordinal, contig_id, max(contig_id) OVER (ORDER BY ordinal, contig_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM (SELECT l_partkey AS id, min(l_orderkey) AS ordinal FROM lineitem GROUP BY 1) JOIN contigs ON contig_id = id) WHERE m > contig_id",
)
_query("missing_depth", lambda d: checks.missing_depth(_deep_rows(d), d.lengths), "SELECT name FROM contigs WHERE contig_id NOT IN (SELECT l_partkey FROM lineitem GROUP BY 1 HAVING avg(l_quantity) >= 25.5)")
_query(
    "seed_conflicts", lambda d: checks.seed_conflicts(d.table("orders").select(F.col("o_custkey").cast("string").alias("name"), F.col("o_orderpriority").alias("bin_label"))),
    "SELECT o_custkey::VARCHAR AS name, count(DISTINCT o_orderpriority) AS bins FROM orders GROUP BY 1 HAVING bins > 1",
)
_query(
    "check_unmatched", lambda d: checks.match_counts(d.table("lineitem").select(F.concat(F.lit("c"), F.col("l_partkey").cast("string")).alias("name")), d.lengths),
    "SELECT count(*) AS names, count(c.name) AS matched, count(*) - count(c.name) AS unmatched, CASE WHEN matched = 0 THEN 'fail' WHEN unmatched > names / 2 THEN 'warn' ELSE 'ok' END AS status FROM (SELECT DISTINCT 'c' || l_partkey AS name FROM lineitem) l LEFT JOIN contigs c ON c.name = l.name",
)
for _mode in ("all", "within", "merge", "guard"):
    _query(f"comarker_{_mode}", lambda d, m=_mode: d.pairs(m), f"SELECT * FROM p_{_mode}")
_query("mg_subset", lambda d: d.markers().join(d.seed(), _S, "left_semi"), "SELECT * FROM mg WHERE contig_id IN (SELECT contig_id FROM seed)")
_query("kmer_counts", lambda d: tnf.kmer_counts(d.contigs), "SELECT * FROM kmers")
_query("tnf_norm", lambda d: _norms(d), "SELECT contig_id, kmer, round(n / norm, 6) AS value FROM kmers JOIN norm USING (contig_id)")
_query("tnf_distance", lambda d: _round(d.measured_pairs("all").select("c1", "c2", "tnf_dist"), "tnf_dist"), "SELECT c1, c2, round(tnf_dist, 6) AS tnf_dist FROM m_tnf")
_query("tnf_probability", lambda d: _round(d.measured_pairs("all").select("c1", "c2", "tnf_prob"), "tnf_prob"), "SELECT c1, c2, round(tnf_prob, 6) AS tnf_prob FROM m_prob")
_query("abd_distance", lambda d: _round(d.covered(d.pairs("all")).select("c1", "c2", "abd_dist", F.col("nnz").cast("long").alias("nnz")), "abd_dist"), "SELECT c1, c2, round(abd_dist, 6) AS abd_dist, nnz FROM m_mean")
_query("abd_distance_sample", lambda d: _sampled(d), "SELECT c1, c2, sample, nz, round(dist, 6) AS dist FROM m_abd")
_query("abd_corr", lambda d: _round(d.covered(d.pairs("all")).select("c1", "c2", F.nanvl("corr", F.lit(None).cast("double")).alias("corr")), "corr"), "SELECT c1, c2, round(corr, 6) AS corr FROM m_mean")
_query("pair_distance", lambda d: d.measured_pairs("all").select("c1", "c2", "d"), "SELECT * FROM m_d")
_query("comarker_filled", lambda d: d.comarker("merge", comarker.UNMEASURED), "SELECT * FROM filled")
_query(
    "measure_stats", lambda d: comarker.measure_stats(d.pairs("merge"), d.measured_pairs("merge"), comarker.UNMEASURED),
    "SELECT count(m.d) AS measured, count(*) - count(m.d) AS filled, 0::BIGINT AS skipped FROM p_merge p LEFT JOIN m_d m ON m.c1 = p.c1 AND m.c2 = p.c2",
)
_query("threshold_curve", lambda d: threshold.curve(*_language_pairs(d)), "SELECT * FROM curve")
_query("simthresh", lambda d: threshold.derive(*_language_pairs(d)), "SELECT t AS simthresh, err, TRUE AS derived FROM curve ORDER BY err, t LIMIT 1")
_query("upper_median", lambda d: threshold.upper_median(d.measured_pairs("all"), "d"), "SELECT d AS median FROM (SELECT d, row_number() OVER (ORDER BY d) AS r, count(*) OVER () AS n FROM m_d) WHERE r = n // 2 + 1")
_query("tnf_cutoff", lambda d: d.spark.createDataFrame([(d.per_mille,)], "p int"), "SELECT p::INT AS p FROM per_mille")
_query("knn_edges", lambda d: _round(d.knn, "sim"), "SELECT src, dst, sim FROM knn")
_query("rank_min_map", lambda d: d.composite.select("src", "dst", "s_tnf", "rank_tnf"), "SELECT src, dst, s_tnf, rank_tnf FROM ranked")
_query("rank_max_map", lambda d: d.composite.select("src", "dst", "s_cor", "rank_cor"), "SELECT src, dst, s_cor, rank_cor FROM ranked")
_query("composite_score", lambda d: d.composite.select("src", "dst", "s_abd", "score"), "SELECT src, dst, s_abd, score FROM composite")
_query("affinity_top5", lambda d: d.affinity, "SELECT * FROM aff")
_query(
    "affinity_rank_mode", lambda d: affinity.rank_mode(d.composite),
    "SELECT src AS c1, dst AS c2, (1 + round_even((row_number() OVER (ORDER BY score, src, dst) - 1)::DOUBLE / greatest(count(*) OVER () - 1, 1) * 999, 0))::INT AS w FROM (SELECT DISTINCT src, dst, score FROM (SELECT *, row_number() OVER (PARTITION BY e ORDER BY score DESC, src DESC, dst DESC) AS r FROM ends) WHERE r <= 5)",
)
_query("anchor_affinity", lambda d: d.anchor_affinity, "SELECT * FROM ancaff")
_query("pins", lambda d: affinity.pins(d.markers(True), d.seed()), "SELECT * FROM pin")
_query("cannot_link_edges", lambda d: d.conflicts, "SELECT * FROM conflicts")
_query("bin_affinity", lambda d: d.binaff, "SELECT * FROM binaff")
_query("bin_best_partner", lambda d: merge.best_partners(d.binaff), "SELECT * FROM best")
_query("mutual_pairs", lambda d: d.mutual, "SELECT * FROM mutual")
_query("blocked_pairs", lambda d: d.blocked(), "SELECT * FROM blocked")
_query("blocked_pairs_dense", lambda d: d.blocked(dense=True), "SELECT m.b1, m.b2 FROM mutual m JOIN dunlike u ON u.b1 = m.b1 AND u.b2 = m.b2")
_query("merge_pairs", lambda d: d.merges, "SELECT * FROM merges")
_query("merge_components", lambda d: merge.components(d.merges, d.bins), "SELECT * FROM rep")
_query("merge_binning", lambda d: d.merged, "SELECT * FROM merged")
_query("recruit_candidates", lambda d: recruit.candidates(d.recruit_edges), "SELECT * FROM cand")
_query("recruit_blocked", lambda d: recruit.blocked(d.dissimilar, d.bins, SIMTHRESH), "SELECT * FROM recblock")
_query(
    "recruit_argmax", lambda d: recruit.argmax(recruit.feasible(recruit.candidates(d.recruit_edges), d.guard, d.bins, SIMTHRESH)),
    "SELECT c, bin_id, w FROM (SELECT *, row_number() OVER (PARTITION BY c ORDER BY w DESC, bin_id) AS r FROM cand x WHERE NOT EXISTS (SELECT 1 FROM recblock k WHERE k.c = x.c AND k.bin_id = x.bin_id)) WHERE r = 1",
)
_query("min_bin_size", lambda d: report.min_bin_size(d.seed(), d.lengths, 20_000), "SELECT contig_id, bin_label FROM seed WHERE bin_label IN (SELECT bin_label FROM sizes WHERE bp >= 20000)")
_query("bin_sizes", lambda d: report.bin_sizes(d.seed(), d.lengths), "SELECT * FROM sizes")
_query(
    "stage_summary", _summary,
    """SELECT (SELECT count(DISTINCT bin_label) FROM seed) AS bins_in, (SELECT count(*) FROM seed) AS contigs_in, (SELECT count(DISTINCT bin_id) FROM merged) AS bins_out, (SELECT count(*) FROM merged) AS contigs_out,
(SELECT count(*) FROM (SELECT bin_label FROM seed JOIN merged USING (contig_id) GROUP BY 1 HAVING count(DISTINCT bin_id) > 1)) AS bins_split, (SELECT count(*) FROM (SELECT bin_id FROM seed JOIN merged USING (contig_id) GROUP BY 1 HAVING count(DISTINCT bin_label) > 1)) AS bins_joined,
(SELECT count(*) FROM merged WHERE contig_id NOT IN (SELECT contig_id FROM seed)) AS recruited, (SELECT count(*) FROM (SELECT bin_id FROM merged JOIN contigs USING (contig_id) GROUP BY 1 HAVING sum(length) >= 20000)) AS bins_kept,
(SELECT count(*) FROM merged WHERE bin_id IN (SELECT bin_id FROM merged JOIN contigs USING (contig_id) GROUP BY 1 HAVING sum(length) >= 20000)) AS contigs_kept""",
)
_query("bin_size_bounds", lambda d: report.bin_size_bounds(d.seed(), d.lengths, 20_000, 60_000), "SELECT bin_label, bp, bp BETWEEN 20000 AND 60000 AS ok FROM sizes")
_query("bin_completeness", lambda d: report.completeness(d.seed(), d.markers()), "SELECT bin_label, count(DISTINCT marker_id) AS markers, markers >= 30 AS ok FROM seed LEFT JOIN mg USING (contig_id) GROUP BY bin_label")
_query(
    "bin_contamination", lambda d: report.contamination(d.seed(), d.markers(True)),
    "SELECT bin_label, count(*) FILTER (n > 1) AS duplicated, duplicated < 4 AS ok FROM (SELECT bin_label, marker_id, count(marker_id) AS n FROM seed LEFT JOIN dmg USING (contig_id) GROUP BY 1, 2) GROUP BY bin_label",
)
_query("sub_bin_budget", lambda d: separate.budgets(d.conflicts), "SELECT * FROM slots")
_query("sub_bin_budget_in_rounds", lambda d: separate.budgets(d.conflicts, small=0), "SELECT * FROM slots")
_query("separate_binning", lambda d: d.separated)
_query("recruit_binning", lambda d: d.recruited)
_query("refinement_objective", lambda d: separate.objective(d.separated, d.anchor_affinity, d.conflicts, SIMTHRESH))
_query("separate_is_refinement", _separate_refines, "SELECT contig_id FROM contigs WHERE FALSE")
_query("recruit_guard_holds", _guard_holds, "SELECT contig_id, contig_id AS other FROM contigs WHERE FALSE")
_query("full_refinement", _refinement)


def _text(d: Domain, lines, what: str) -> str:
    """Lines (column value) as a folder of text files."""
    path = scratch(d.spark, what)
    lines.select("value").write.text(path)
    return path


def _fasta_file(d: Domain) -> str:
    return _text(d, d.contigs.orderBy("contig_id").select(F.concat(F.lit(">"), "name", F.lit(" from "), F.coalesce("source", F.lit("-")), F.lit("\n"), F.regexp_replace("seq", "(.{70})", "$1\n")).alias("value")), "fasta")


def _depth_file(d: Domain) -> str:
    pairs = F.array_sort(F.collect_list(F.struct("sample", F.concat_ws("\t", F.col("mean").cast("string"), F.col("var").cast("string")).alias("v"))))
    wide = d.depth.groupBy("contig_id").agg(pairs.alias("s")).join(d.lengths, "contig_id")
    return _text(d, wide.select(F.concat_ws("\t", "name", F.col("length").cast("string"), F.lit("0"), F.concat_ws("\t", F.col("s.v"))).alias("value")), "depth")


def _marker_file(d: Domain, kind: str) -> str:
    m = d.markers().join(d.lengths, _S).select("name", F.concat(F.lit("m"), F.col("marker_id").cast("string")).alias("m"), "marker_id")
    if kind == "table":
        rows = m.select(F.concat_ws("\t", "name", "m", F.lit("more")).alias("value"))
    elif kind == "busco":
        rows = m.select(F.concat_ws("\t", "m", F.when(F.col("marker_id") % 3 == 0, "Fragmented").when(F.col("marker_id") % 3 == 1, "Complete").otherwise("Duplicated"), "name").alias("value"))
    else:
        orfs = m.groupBy("name").agg(F.concat_ws(", ", F.array_sort(F.collect_list(F.concat(F.lit("'orf"), F.col("marker_id").cast("string"), F.lit("': {'"), "m", F.lit("': [[1, 9]]}"))))).alias("o"))
        rows = orfs.select(F.concat(F.col("name"), F.lit("\t{"), "o", F.lit("}")).alias("value"))
    return _text(d, rows, f"markers-{kind}")


def _read_markers(d: Domain, kind: str):
    return readers.markers(d.spark, [_marker_file(d, kind)], kind)


def _seed_file(d: Domain) -> str:
    name = F.when(F.col("contig_id") % 3 == 0, F.concat("name", F.lit("_LN:"), F.col("length").cast("string"))).otherwise(F.col("name"))
    return _text(d, d.seed().join(d.lengths.select("contig_id", "name", "length"), "contig_id").select(F.concat_ws("\t", name, "bin_label").alias("value")), "seed")


_MARKER_SQL = "SELECT DISTINCT c.name, 'm' || marker_id AS marker FROM mg JOIN contigs c USING (contig_id)"
_query("fasta_records", lambda d: readers.fasta(d.spark, _fasta_file(d)).select("name", "length", F.md5("seq").alias("seq_md5")), "SELECT name, length, md5(seq) AS seq_md5 FROM contigs")
_query("contig_ids", lambda d: readers.contigs(d.spark, _fasta_file(d), 1500).select("contig_id", "name", "length"), "SELECT row_number() OVER (ORDER BY contig_id) - 1 AS contig_id, name, length FROM contigs WHERE length >= 1500")
_query(
    "depth_rows", lambda d: _round(_round(readers.depth_table(d.spark, _depth_file(d)), "mean"), "var"),
    "SELECT c.name, CASE sample WHEN 'A' THEN 's0000' WHEN 'N' THEN 's0001' ELSE 's0002' END AS sample, round(mean, 6) AS mean, round(var, 6) AS var FROM depth JOIN contigs c USING (contig_id)",
)
_query(
    "depth_rows_without_variance", lambda d: _round(_round(readers.depth_table(d.spark, _depth_file(d), False).where("sample in ('s0000', 's0002', 's0004')"), "mean"), "var"),
    "SELECT c.name, CASE sample WHEN 'A' THEN 's0000' WHEN 'N' THEN 's0002' ELSE 's0004' END AS sample, round(mean, 6) AS mean, round(mean, 6) AS var FROM depth JOIN contigs c USING (contig_id)",
)
_query(
    "ragged_depth", lambda d: checks.ragged_depth(readers.depth_lines(d.spark, _depth_file(d)).withColumn("f", F.when(F.col("name").endswith("7"), F.slice("f", 1, 8)).otherwise(F.col("f")))),
    "SELECT name, 8 AS width FROM contigs WHERE name LIKE '%7'",
)
_query("markers_table", lambda d: _read_markers(d, "table"), _MARKER_SQL)
_query("markers_busco", lambda d: _read_markers(d, "busco"), _MARKER_SQL + " WHERE marker_id % 3 <> 0")
_query("markers_pfam", lambda d: _read_markers(d, "pfam"), _MARKER_SQL)
_query("marker_incidence_read", lambda d: readers.incidence(_read_markers(d, "table"), d.lengths), "SELECT contig_id, dense_rank() OVER (ORDER BY 'm' || marker_id) AS marker_id FROM mg")
_query("seed_rows", lambda d: readers.resolve(readers.seed_table(d.spark, _seed_file(d)), d.lengths).select("contig_id", "bin_label"), "SELECT contig_id, bin_label FROM seed")
_query(
    "binning_lines", lambda d: sinks.binning_lines(d.seed(), d.lengths, "s1"),
    "SELECT unnest(['@Version:0.9.0', '@SampleID:s1', '@@SEQUENCEID' || chr(9) || 'BINID']) AS value UNION ALL SELECT name || chr(9) || bin_label FROM seed JOIN contigs USING (contig_id)",
)
_query("safe_labels", lambda d: d.seed().select(sinks.safe_label(F.concat("bin_label", F.lit("/#1"))).alias("label")).distinct(), "SELECT DISTINCT regexp_replace(bin_label || '/#1', '[^A-Za-z0-9._-]', '_', 'g') AS label FROM seed")
_query(
    "distance_facts", lambda d: sinks.read_facts(d.spark, _text(d, sinks.distance_lines(d.measured_pairs("all")), "facts"), "comarker_sim", 3),
    "SELECT c1 AS a1, c2 AS a2, d::BIGINT AS a3 FROM m_d",
)
_query("budget_histogram", lambda d: separate.budget_histogram(separate.budgets(d.conflicts)), "SELECT k, count(*) AS bins FROM slots GROUP BY k")
_query("first_appearance_ids", lambda d: readers.ids_by_appearance(d.lengths.select(F.col("contig_id").alias("ordinal"), F.col("source").alias("label"))), "SELECT label, dense_rank() OVER (ORDER BY o) - 1 AS id FROM (SELECT source AS label, min(contig_id) AS o FROM contigs GROUP BY source)")
_query("correlation_gaps", lambda d: measure.correlation_gaps(d.covered(d.pairs("all"))), "SELECT count(*) AS pairs, count(*) - count(corr) AS undefined FROM m_mean")


def _dense(d: Domain):
    from spindrift.sources.readers import dense_ids

    return dense_ids(d.lengths, "contig_id").select("dense_id", "name", "length")


def _legend(d: Domain):
    from spindrift.sources.readers import dense_ids

    m = d.markers().select("marker_id").distinct()
    return dense_ids(m, "marker_id").select((F.col("dense_id") + 1).alias("marker_int"), "marker_id")


def _norms(d: Domain):
    return tnf.kmer_counts(d.contigs, norms=True).select("contig_id", "kmer", F.round(F.col("n") / F.col("norm"), 6).alias("value"))


def _sampled(d: Domain):
    """Each sample's own distance: the pair measure over one sample at a time."""
    import numpy as np
    import pyarrow as pa

    from spindrift.functions import abundance

    kept = measure.kept(d.depth)
    depth = d.depth.join(kept, "contig_id", "left_semi")
    side = lambda k: depth.select(F.col("contig_id").alias(f"c{k}"), "sample", F.col("mean").alias(f"m{k}"), F.col("var").alias(f"v{k}"))
    both = d.pairs("all").join(side(1), "c1").join(side(2), ["c2", "sample"]).select("c1", "c2", "sample", "m1", "v1", "m2", "v2")

    def run(batches):
        for b in batches:
            m1, v1, m2, v2 = (b.column(k).to_numpy() for k in range(3, 7))
            dist = abundance.distance(m1, v1, m2, v2) if len(m1) else np.zeros(0)
            yield pa.record_batch([*b.columns[:3], pa.array((m1 > 1) | (m2 > 1)), pa.array(np.round(dist, 6))], ["c1", "c2", "sample", "nz", "dist"])

    return both.mapInArrow(run, "c1 long, c2 long, sample string, nz boolean, dist double")


