"""Every operator as a query over the derived cohort, with the SQL that gives the same rows in another engine."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import annotations, cohort as C, combine, concord, family, popgen, predicates as P, ranges, relatedness, scope
from .fixtures import COHORT_SQL, Cohort, cohort

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None, with_cohort: bool = True):
    """Register a function of a Cohort under its name, with its SQL."""

    def register(f: Callable[[Cohort], DataFrame]):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(cohort(spark, sf_dir))
        if sql:
            ORACLE_SQL[f.__name__] = (COHORT_SQL + sql) if with_cohort else sql
        return f

    return register


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


REGIONS = [("chr3", 3_000_000, 3_900_000), ("X", 3_000_000, 4_200_000)]
REGION_SQL = "((chrom IN ('chr3', '3') AND pos BETWEEN 3000000 AND 3900000) OR (chrom IN ('chrX', 'X', 'chr23', '23') AND pos BETWEEN 3000000 AND 4200000))"
LIMITS = {"min_gq": 10, "min_dp": 5, "min_ab": 0.1, "max_ab": 0.9, "max_af": 0.02}


@query(f"SELECT ingest_id, chrom, pos, ref, alt, filter, info_AF FROM variants WHERE {REGION_SQL}")
def region_scan(c: Cohort) -> DataFrame:
    return C.region_scan(c.variants, REGIONS).select("ingest_id", *C.SITE, "filter", "info_AF")


@query("""SELECT chrom, pos, ref, alt, CAST(sum(gt) AS BIGINT) AS ac, count(DISTINCT (ingest_id, sample_id)) AS carriers FROM genotypes WHERE gt > 0
GROUP BY chrom, pos, ref, alt ORDER BY ac DESC, chrom, pos, ref, alt LIMIT 50""")
def top_variants(c: Cohort) -> DataFrame:
    return C.top_variants(c.genotypes, 50)


@query(f"""SELECT chrom, pos, ref, alt, count(DISTINCT sample_id) AS carriers, count(*) FILTER (WHERE gt = 2) AS hom_alt FROM genotypes
WHERE {REGION_SQL} AND gt > 0 GROUP BY chrom, pos, ref, alt""")
def carriers_at_locus(c: Cohort) -> DataFrame:
    return C.carriers(c.genotypes, REGIONS)


@query("""SELECT chrom, pos, ref, alt, (SELECT count(DISTINCT sample_id) FROM samples) - count(DISTINCT sample_id) AS hom_ref
FROM genotypes WHERE gt > 0 GROUP BY chrom, pos, ref, alt""")
def hom_ref_samples(c: Cohort) -> DataFrame:
    return C.hom_ref(c.genotypes, c.samples)


@query("""SELECT s.cohort, g.chrom, g.pos, g.ref, g.alt, CAST(sum(gt) AS BIGINT) AS ac, any_value(z.an) AS an, round(sum(gt) / any_value(z.an), 6) AS af
FROM genotypes g JOIN samples s USING (ingest_id, sample_id) JOIN (SELECT cohort, 2 * count(DISTINCT sample_id) AS an FROM samples GROUP BY cohort) z ON z.cohort = s.cohort
GROUP BY s.cohort, g.chrom, g.pos, g.ref, g.alt""")
def cohort_frequencies(c: Cohort) -> DataFrame:
    return rounded(C.frequencies(c.genotypes, c.samples), "af")


@query("""SELECT chrom, pos, ref, alt, ac1, an1, round(ac1 / an1, 4) AS af1, ac2, an2, round(ac2 / an2, 4) AS af2, round(ac1 / an1 - ac2 / an2, 4) AS diff
FROM (SELECT chrom, pos, ref, alt, CAST(coalesce(sum(gt) FILTER (WHERE cohort = 'A'), 0) AS BIGINT) AS ac1, CAST(coalesce(sum(gt) FILTER (WHERE cohort = 'B'), 0) AS BIGINT) AS ac2
 FROM genotypes JOIN samples USING (ingest_id, sample_id) GROUP BY chrom, pos, ref, alt)
CROSS JOIN (SELECT 2 * count(DISTINCT sample_id) FILTER (WHERE cohort = 'A') AS an1, 2 * count(DISTINCT sample_id) FILTER (WHERE cohort = 'B') AS an2 FROM samples)
ORDER BY abs(diff) DESC, chrom, pos, ref, alt LIMIT 100""")
def cohort_difference(c: Cohort) -> DataFrame:
    return C.difference(c.genotypes, c.samples, "A", "B", 100)


@query("""SELECT v.chrom, v.pos, v.ref, v.alt, t.n - coalesce(m.n, 0) AS n_called, CAST(coalesce(a.ac, 0) AS BIGINT) AS ac_called, round((t.n - coalesce(m.n, 0)) / t.n, 6) AS call_rate,
 round(coalesce(a.ac, 0) / nullif(2 * (t.n - coalesce(m.n, 0)), 0), 6) AS called_af
FROM variants v CROSS JOIN (SELECT count(DISTINCT sample_id) AS n FROM samples) t
LEFT JOIN (SELECT chrom, pos, ref, alt, count(DISTINCT sample_id) AS n FROM missing_genotypes GROUP BY ALL) m USING (chrom, pos, ref, alt)
LEFT JOIN (SELECT chrom, pos, ref, alt, sum(gt) AS ac FROM genotypes GROUP BY ALL) a USING (chrom, pos, ref, alt)""")
def called_rates(c: Cohort) -> DataFrame:
    return rounded(C.called(c.genotypes, c.missing_genotypes, c.samples, c.variants), "call_rate", "called_af")


@query("SELECT population, count(*) AS missing, count(DISTINCT sample_id) AS samples FROM missing_genotypes JOIN samples USING (ingest_id, sample_id) GROUP BY population")
def missing_by_population(c: Cohort) -> DataFrame:
    return C.missing_by_population(c.missing_genotypes, c.samples)


@query("SELECT gt, count(*) AS n, count(gq) AS n_gq, count(dp) AS n_dp, count(ad_ref) AS n_ad_ref, count(ad_alt) AS n_ad_alt, CAST(median(dp) AS DOUBLE) AS median_dp FROM genotypes GROUP BY gt")
def field_usability(c: Cohort) -> DataFrame:
    return C.field_usability(c.genotypes)


@query("""SELECT *, round(ti / nullif(tv, 0), 6) AS ti_tv, round(het / nullif(hom_alt, 0), 6) AS het_hom, round(x_het / nullif(x_calls, 0), 6) AS x_het_share,
 CASE WHEN x_calls < 20 THEN 'unknown' WHEN x_het / x_calls <= 0.10 THEN 'male' WHEN x_het / x_calls >= 0.20 THEN 'female' ELSE 'ambiguous' END AS sex
FROM (SELECT ingest_id, sample_id, count(*) FILTER (WHERE gt > 0) AS variants, count(*) FILTER (WHERE gt = 1) AS het, count(*) FILTER (WHERE gt = 2) AS hom_alt,
 count(*) FILTER (WHERE gt > 0 AND ref || alt IN ('AG', 'GA', 'CT', 'TC')) AS ti, count(*) FILTER (WHERE gt > 0 AND ref || alt NOT IN ('AG', 'GA', 'CT', 'TC')) AS tv,
 count(*) FILTER (WHERE gt = 1 AND chrom = 'chrX') AS x_het, count(*) FILTER (WHERE gt > 0 AND chrom = 'chrX') AS x_calls FROM genotypes GROUP BY ingest_id, sample_id)""")
def sample_quality(c: Cohort) -> DataFrame:
    return rounded(C.sample_qc(c.genotypes), "ti_tv", "het_hom", "x_het_share")


@query("SELECT max(pos) FILTER (WHERE chrom = 'chrX') AS max_x_pos, CASE WHEN max(pos) FILTER (WHERE chrom = 'chrX') > 155270560 THEN 'GRCh38' ELSE 'unknown' END AS build FROM variants")
def genome_build(c: Cohort) -> DataFrame:
    return C.build_of(c.variants)


@query(" UNION ALL ".join(f"SELECT '{x}' AS field, count({x}) AS populated, count(*) AS n_rows FROM genotypes" for x in ("ingest_id", "chrom", "pos", "ref", "alt", "sample_id", "gt", "gq", "dp", "ad_ref", "ad_alt")))
def column_population(c: Cohort) -> DataFrame:
    return C.column_population(c.genotypes)


@query("""SELECT key, count(*) AS n FROM (SELECT unnest(CASE WHEN info_AA IS NULL THEN ['AF'] ELSE ['AA', 'AF'] END) AS key FROM variants) GROUP BY key ORDER BY n DESC, key LIMIT 50""")
def overflow_keys(c: Cohort) -> DataFrame:
    extra = F.map_filter(F.create_map(F.lit("AA"), F.col("info_AA"), F.lit("AF"), F.coalesce(F.col("info_AF").cast("string"), F.lit(""))), lambda k, v: v.isNotNull())
    return C.map_keys_used(c.variants.select(extra.alias("info_extra")), "info_extra")


@query("""SELECT chrom, count(*) AS variants, min(pos) AS first_pos, max(pos) AS last_pos, count(*) FILTER (WHERE filter IS NULL OR filter IN ('PASS', '.', '')) AS passed FROM variants GROUP BY chrom""")
def contig_counts(c: Cohort) -> DataFrame:
    return C.contig_counts(c.variants)


@query("""SELECT v.chrom, v.pos, v.ref, v.alt, coalesce(c.carriers, 0) AS carriers, coalesce(c.hom_alt, 0) AS hom_alt, t.truncated
FROM (SELECT v.* FROM variants v JOIN genes g ON v.chrom = g.chrom AND v.pos BETWEEN g.start_pos - 500000 AND g.end_pos + 500000 WHERE g.gene_symbol = 'G12' ORDER BY v.chrom, v.pos, v.ref, v.alt LIMIT 20) v
LEFT JOIN (SELECT chrom, pos, ref, alt, count(DISTINCT sample_id) AS carriers, count(*) FILTER (WHERE gt = 2) AS hom_alt FROM genotypes WHERE gt > 0 GROUP BY ALL) c USING (chrom, pos, ref, alt)
CROSS JOIN (SELECT count(*) > 20 AS truncated FROM variants v JOIN genes g ON v.chrom = g.chrom AND v.pos BETWEEN g.start_pos - 500000 AND g.end_pos + 500000 WHERE g.gene_symbol = 'G12') t""")
def variants_in_gene(c: Cohort) -> DataFrame:
    return C.variants_in_gene(c.variants, c.genotypes, c.genes, "g12", 500_000, 20)


@query(f"""SELECT (SELECT count(*) FROM variants WHERE {REGION_SQL}) AS variants, count(*) AS genotype_rows, count(DISTINCT sample_id) FILTER (WHERE gt > 0) AS carriers, count(gq) AS with_gq, count(dp) AS with_dp
FROM genotypes WHERE {REGION_SQL}""")
def locus_summary(c: Cohort) -> DataFrame:
    return C.locus_summary(c.variants, c.genotypes, REGIONS)


@query("SELECT chrom, pos FROM (SELECT chrom, pos, row_number() OVER (PARTITION BY chrom ORDER BY pos, ref, alt) AS rn FROM variants) WHERE rn % 5 = 0")
def export_window_cuts(c: Cohort) -> DataFrame:
    return C.position_cuts(c.variants, 5)


# --- ranges and annotation


@query("SELECT v.chrom, v.pos, v.ref, v.alt, g.gene_symbol FROM variants v JOIN genes g ON v.chrom = g.chrom AND v.pos BETWEEN g.start_pos AND g.end_pos")
def genes_at_position(c: Cohort) -> DataFrame:
    return annotations.genes_at(c.variants.select(*C.SITE), c.genes.select("gene_symbol", "chrom", "start_pos", "end_pos")).select(*C.SITE, "gene_symbol")


@query("SELECT v.chrom, v.pos, v.ref, v.alt, g.gene_symbol FROM variants v JOIN genes g ON v.chrom = g.chrom AND v.pos BETWEEN g.start_pos AND g.end_pos")
def genes_at_position_bucketed(c: Cohort) -> DataFrame:
    return ranges.containing(c.variants.select(*C.SITE), c.genes, broadcast_rows=0).select(*C.SITE, "gene_symbol")


@query("""SELECT chrom, min(start_pos) AS start_pos, max(end_pos) AS end_pos FROM (SELECT *, sum(n) OVER (PARTITION BY chrom ORDER BY start_pos, end_pos ROWS UNBOUNDED PRECEDING) AS no FROM (
 SELECT *, CASE WHEN start_pos <= max(end_pos) OVER (PARTITION BY chrom ORDER BY start_pos, end_pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1 THEN 0 ELSE 1 END AS n
 FROM (SELECT chrom, start_pos, end_pos - 40000 AS end_pos FROM genes))) GROUP BY chrom, no""")
def merged_intervals(c: Cohort) -> DataFrame:
    return ranges.merge(c.genes.select("chrom", "start_pos", (F.col("end_pos") - 40000).alias("end_pos")))


@query("""SELECT v.chrom, v.pos, CAST(min(least(abs(v.pos - g.start_pos), abs(v.pos - g.end_pos))) AS BIGINT) AS distance FROM (SELECT DISTINCT chrom, pos FROM variants) v LEFT JOIN genes g ON v.chrom = g.chrom GROUP BY v.chrom, v.pos""")
def nearest_boundary(c: Cohort) -> DataFrame:
    return annotations.splice_distance(c.variants.select("chrom", "pos").distinct(), c.genes)


@query("""SELECT k.chrom, k.pos, k.ref, k.alt, c.clin_sig, g.af, g.af_grpmax FROM variants k LEFT JOIN clinvar_variants c USING (chrom, pos, ref, alt) LEFT JOIN gnomad_af g USING (chrom, pos, ref, alt)""")
def allele_annotation(c: Cohort) -> DataFrame:
    keys = c.variants.select(F.regexp_replace("chrom", "^chr", "").alias("chrom"), "pos", "ref", "alt")
    out = annotations.exact_alleles(annotations.exact_alleles(keys, c.clinvar_variants, ["clin_sig"]), c.gnomad_af, ["af", "af_grpmax"])
    return out.withColumn("chrom", F.concat(F.lit("chr"), "chrom"))


@query("""SELECT token, CASE WHEN n = 1 THEN gene_symbol END AS gene_symbol, CASE WHEN n = 1 THEN kind END AS kind, n > 1 AS is_ambiguous FROM (
 SELECT token, count(DISTINCT gene_symbol) AS n, min(gene_symbol) AS gene_symbol, min(kind) AS kind FROM (
  SELECT lower(gene_symbol) AS token, gene_symbol, 'symbol' AS kind FROM genes UNION ALL
  SELECT concat('OLD', CAST(CAST(substr(gene_symbol, 2) AS INT) % 500 AS VARCHAR)) AS token, gene_symbol, 'previous' AS kind FROM genes WHERE CAST(substr(gene_symbol, 2) AS INT) < 700) GROUP BY token)""")
def gene_tokens(c: Cohort) -> DataFrame:
    number = F.substr("gene_symbol", F.lit(2)).cast("int")
    aliases = c.genes.where(number < 700).select(F.concat(F.lit("OLD"), (number % 500).cast("string")).alias("alias"), F.lit("previous").alias("kind"), F.col("gene_symbol").alias("symbol"))
    tokens = c.genes.select(F.lower("gene_symbol").alias("token")).unionByName(aliases.select(F.col("alias").alias("token"))).distinct()
    return annotations.resolve_genes(tokens, c.genes, aliases)


@query("SELECT DISTINCT chrom FROM gnomad_af")
def contigs_covered(c: Cohort) -> DataFrame:
    return annotations.contigs_covered(c.gnomad_af)


@query("""SELECT v.chrom, v.pos, w.win_start, w.win_end FROM variants v JOIN (
 SELECT chrom, s + i * 250000 AS win_start, least(s + i * 250000 + 499999, e) AS win_end FROM (
  SELECT chrom, s, e, unnest(range(0, greatest(0, CAST(ceil((e - s + 1 - 500000) / 250000.0) AS BIGINT)) + 1)) AS i FROM (SELECT chrom, min(pos) AS s, max(pos) AS e FROM variants GROUP BY chrom))) w
ON v.chrom = w.chrom AND v.pos BETWEEN w.win_start AND w.win_end""")
def sliding_windows(c: Cohort) -> DataFrame:
    spans = c.variants.groupBy("chrom").agg(F.min("pos").alias("span_start"), F.max("pos").alias("span_end"))
    return ranges.sliding_windows(c.variants.select("chrom", "pos"), spans, 500_000, 250_000).select("chrom", "pos", "win_start", "win_end")


@query("""SELECT chrom, cluster, count(*) AS n FROM (SELECT chrom, sum(n) OVER (PARTITION BY chrom ORDER BY pos ROWS UNBOUNDED PRECEDING) AS cluster FROM (
 SELECT chrom, pos, CASE WHEN pos <= lag(pos) OVER (PARTITION BY chrom ORDER BY pos) + 23000 THEN 0 ELSE 1 END AS n FROM truth)) GROUP BY chrom, cluster""")
def swept_clusters(c: Cohort) -> DataFrame:
    return ranges.clusters(c.truth.select("chrom", "pos"), 23_000).groupBy("chrom", "cluster").agg(F.count("*").alias("n"))


# --- families

TRIO_SQL = """, trio AS (
 SELECT p.sample_id AS proband, p.sex, g.chrom, g.pos, g.ref, g.alt, g.gt AS g_gt, g.gq AS g_gq, g.dp AS g_dp, g.ad_ref AS g_ad_ref, g.ad_alt AS g_ad_alt,
  f.gt AS f_gt, f.gq AS f_gq, f.dp AS f_dp, f.ad_ref AS f_ad_ref, f.ad_alt AS f_ad_alt, m.gt AS m_gt, m.gq AS m_gq, m.dp AS m_dp, m.ad_ref AS m_ad_ref, m.ad_alt AS m_ad_alt, v.info_AF, v.filter
 FROM pedigree p JOIN genotypes g ON g.sample_id = p.sample_id
 LEFT JOIN genotypes f ON f.sample_id = p.father_id AND (f.chrom, f.pos, f.ref, f.alt) = (g.chrom, g.pos, g.ref, g.alt)
 LEFT JOIN genotypes m ON m.sample_id = p.mother_id AND (m.chrom, m.pos, m.ref, m.alt) = (g.chrom, g.pos, g.ref, g.alt)
 LEFT JOIN variants v ON (v.chrom, v.pos, v.ref, v.alt) = (g.chrom, g.pos, g.ref, g.alt))
"""


def _gate_sql(strict: bool = False) -> list[tuple[str, str]]:
    least = lambda c, n: f"coalesce({c} >= {n}, false)" if strict else f"({c} IS NULL OR {c} >= {n})"
    out = [(f"quality_{r}", f"{least(f'{r}_gq', 10)} AND {least(f'{r}_dp', 5)}") for r in "gfm"]
    out.append(("allele_balance", "coalesce(g_gt <> 1 OR g_ad_ref IS NULL OR g_ad_alt IS NULL OR g_ad_ref + g_ad_alt = 0 OR g_ad_alt / (g_ad_ref + g_ad_alt) BETWEEN 0.1 AND 0.9, true)"))
    out.append(("rarity", "(info_AF IS NULL OR info_AF <= 0.02 + 1e-7)"))
    return out


GATES_SQL = " AND ".join(f"({g})" for _, g in _gate_sql())
STRICT_SQL = " AND ".join(f"({g})" for _, g in _gate_sql(True))


#: The inheritance models in SQL.
MODEL_SQL = {
    "denovo": "f_gt = 0 AND m_gt = 0 AND g_gt IN (1, 2)", "recessive": "f_gt = 1 AND m_gt = 1 AND g_gt = 2",
    "dominant": "g_gt = 1 AND least(f_gt, m_gt) = 0 AND f_gt IS NOT NULL AND m_gt IS NOT NULL AND greatest(f_gt, m_gt) > 0",
}


def _rows(c: Cohort) -> DataFrame:
    return family.trios(c.genotypes, c.pedigree, c.variants)


def _model(name: str):
    def run(c: Cohort) -> DataFrame:
        return family.candidates(_rows(c), name, **LIMITS)

    run.__name__ = f"trio_{name}"
    query(f"{TRIO_SQL} SELECT proband, chrom, pos, ref, alt, g_gt, f_gt, m_gt, info_AF AS af FROM trio WHERE ({MODEL_SQL[name]}) AND {GATES_SQL}")(run)


for _name in ("denovo", "recessive", "dominant"):
    _model(_name)


@query(f"""{TRIO_SQL} SELECT proband, gene_symbol, count(*) FILTER (WHERE f_gt > 0) AS paternal, count(*) FILTER (WHERE f_gt = 0) AS maternal,
 array_to_string(list_sort(list(concat_ws(':', chrom, pos, ref, alt, CASE WHEN f_gt > 0 THEN 'paternal' ELSE 'maternal' END))), ',') AS variants
FROM (SELECT trio.*, gene_symbol FROM trio JOIN genes ON trio.chrom = genes.chrom AND pos BETWEEN start_pos - 300000 AND end_pos + 300000 WHERE ({MODEL_SQL['dominant']}) AND (info_AF IS NULL OR info_AF <= 0.02 + 1e-7))
GROUP BY proband, gene_symbol HAVING count(*) FILTER (WHERE f_gt > 0) > 0 AND count(*) FILTER (WHERE f_gt = 0) > 0""")
def compound_het(c: Cohort) -> DataFrame:
    wide = c.genes.select("gene_symbol", "chrom", (F.col("start_pos") - 300_000).alias("start_pos"), (F.col("end_pos") + 300_000).alias("end_pos"))
    return family.compound_het(_rows(c), wide, min_gq=0, min_dp=0, min_ab=None, max_af=0.02)


@query(f"""{TRIO_SQL} SELECT proband, chrom, pos, ref, alt, coalesce(af_grpmax, af) AS popmax FROM trio LEFT JOIN gnomad_af USING (chrom, pos, ref, alt)
WHERE ({MODEL_SQL['dominant']}) AND (coalesce(af_grpmax, af) IS NULL OR coalesce(af_grpmax, af) <= 0.05 + 1e-7)""")
def population_rarity(c: Cohort) -> DataFrame:
    return family.population_rare(_rows(c).where(family.fits("dominant")), c.gnomad_af, 0.05).select("proband", *C.SITE, "popmax")


@query(f"{TRIO_SQL} SELECT proband, count(*) AS dropped FROM trio WHERE ({MODEL_SQL['dominant']}) AND ({GATES_SQL}) AND NOT ({STRICT_SQL}) GROUP BY proband")
def strict_missing_dropped(c: Cohort) -> DataFrame:
    return family.strict_missing_dropped(_rows(c), "dominant", **LIMITS)


@query(f"""{TRIO_SQL} SELECT proband, count(*) AS model, {', '.join(f"count(*) FILTER (WHERE {' AND '.join(f'({g})' for _, g in _gate_sql()[:i + 1])}) AS {n}" for i, (n, _) in enumerate(_gate_sql()))}
FROM trio WHERE {MODEL_SQL['dominant']} GROUP BY proband""")
def gate_funnel(c: Cohort) -> DataFrame:
    return family.funnel(_rows(c), "dominant", **LIMITS)


X_SQL = f"""{TRIO_SQL}, x AS (SELECT *, CASE WHEN g_gt = 0 THEN NULL WHEN sex = 'male' AND g_gt = 1 THEN 'male_het' WHEN sex = 'female' AND f_gt = 1 THEN 'father_het'
 WHEN sex = 'male' AND g_gt = 2 AND m_gt = 1 THEN 'xlr_son' WHEN sex = 'male' AND g_gt = 2 AND m_gt = 0 THEN 'x_denovo_son'
 WHEN sex = 'female' AND g_gt = 2 AND f_gt = 2 AND m_gt = 1 THEN 'xlr_hom_daughter' WHEN sex = 'female' AND g_gt = 1 AND f_gt = 2 AND m_gt = 0 THEN 'xhet_paternal'
 WHEN sex = 'female' AND g_gt = 1 AND f_gt = 0 AND m_gt IN (1, 2) THEN 'xhet_maternal' WHEN sex = 'female' AND g_gt = 1 AND f_gt = 0 AND m_gt = 0 THEN 'x_denovo_daughter'
 WHEN sex = 'female' AND g_gt = 2 AND f_gt = 2 AND m_gt = 0 THEN 'x_denovo_daughter_mat' WHEN sex = 'female' AND g_gt = 2 AND f_gt = 0 AND m_gt IN (1, 2) THEN 'x_denovo_daughter_pat'
 WHEN sex = 'male' THEN CASE WHEN m_gt = 2 THEN 'consistent_unpatterned' END WHEN f_gt IS NULL OR m_gt IS NULL THEN NULL
 WHEN (g_gt = 1 AND f_gt = 2 AND m_gt = 1) OR (g_gt = 2 AND f_gt = 2 AND m_gt = 2) THEN 'consistent_unpatterned' ELSE 'mendel_error_other' END AS x_class
 FROM trio WHERE chrom = 'chrX' AND (pos BETWEEN 2781480 AND 154931043 OR pos BETWEEN 155260561 AND 155701382)) """


@query(X_SQL + "SELECT proband, x_class, count(*) AS n FROM x WHERE x_class IS NOT NULL GROUP BY proband, x_class")
def x_linked_classes(c: Cohort) -> DataFrame:
    return family.x_linked_counts(_rows(c))


def _balanced(r: str, gt: int, test: str) -> str:
    return f"coalesce({r}_gt <> {gt} OR {r}_ad_ref IS NULL OR {r}_ad_alt IS NULL OR {r}_ad_ref + {r}_ad_alt = 0 OR {r}_ad_alt / ({r}_ad_ref + {r}_ad_alt) {test}, true)"


X_LIMITS = {"min_gq": 6, "min_dp": 5, "min_ab": 0.05, "max_ab": 0.95, "max_af": 0.02, "max_af_x": 0.018, "min_hemi_ab": 0.1, "max_parent_alt_reads": 6}
X_GATES = f"""(m_gq IS NULL OR m_gq >= 6) AND (m_dp IS NULL OR m_dp >= 5) AND (g_gq IS NULL OR g_gq >= 6) AND (g_dp IS NULL OR g_dp >= CASE WHEN sex = 'male' THEN 2 ELSE 5 END)
 AND (sex = 'male' OR ((f_gq IS NULL OR f_gq >= 6) AND (f_dp IS NULL OR f_dp >= 2))) AND (sex <> 'male' OR {_balanced('g', 2, '>= 0.1')}) AND {_balanced('g', 1, 'BETWEEN 0.05 AND 0.95')} AND {_balanced('m', 1, 'BETWEEN 0.05 AND 0.95')}
 AND (info_AF IS NULL OR info_AF <= 0.018 + 1e-7)"""
X_CAPS = """(NOT (x_class = 'x_denovo_son' OR x_class = 'x_denovo_daughter' OR x_class = 'x_denovo_daughter_mat') OR m_ad_alt IS NULL OR m_ad_alt <= 6)
 AND (NOT (x_class = 'x_denovo_daughter' OR x_class = 'x_denovo_daughter_pat') OR f_ad_alt IS NULL OR f_ad_alt <= 6)"""
X_MODE = "CASE WHEN x_class LIKE 'xlr%' THEN 'recessive' WHEN x_class LIKE 'x_denovo%' THEN 'denovo' ELSE 'female_het' END"
X_FLAG = "CASE WHEN sex = 'male' AND f_gt = 2 THEN 'hemizygous_alt' WHEN sex = 'male' AND f_gt = 1 THEN 'anomalous_het' END"
X_NAMED = "(x_class LIKE 'xlr%' OR x_class LIKE 'x_denovo%' OR x_class LIKE 'xhet%')"


@query(X_SQL + f"SELECT proband, chrom, pos, ref, alt, x_class, {X_MODE} AS mode, {X_FLAG} AS father_flag FROM x WHERE {X_NAMED} AND {X_CAPS} AND {X_GATES}")
def x_linked_candidates(c: Cohort) -> DataFrame:
    return family.x_linked_candidates(_rows(c), **X_LIMITS)


@query(X_SQL + f"""SELECT proband, x_class, CASE WHEN x_class LIKE 'xhet%' AND n % 2 = 1 AND (x_class = 'xhet_maternal' OR n % 5 <> 0) AND (x_class = 'xhet_paternal' OR n % 7 <> 0) THEN 'dominant' ELSE {X_MODE} END AS mode, count(*) AS n
FROM (SELECT *, CAST(substr(proband, 2) AS INT) AS n FROM x) WHERE {X_NAMED} AND {X_CAPS} AND {X_GATES} GROUP BY ALL""")
def x_linked_modes(c: Cohort) -> DataFrame:
    n = F.substr("proband", F.lit(2)).cast("int")
    affected = c.pedigree.select(F.col("sample_id").alias("proband")).select("proband", (n % 2 == 1).alias("g"), (n % 5 != 0).alias("f"), (n % 7 != 0).alias("m"))
    return family.x_linked_candidates(_rows(c), affected=affected, **X_LIMITS).groupBy("proband", "x_class", "mode").agg(F.count("*").alias("n"))


GUARD_SQL = "NOT (chrom = 'chrX' AND (pos BETWEEN 2781480 AND 154931043 OR pos BETWEEN 155260561 AND 155701382) AND (coalesce(f_gt = 1, false) OR (sex = 'male' AND g_gt = 1)))"


@query(f"{TRIO_SQL} SELECT proband, chrom, count(*) AS n FROM trio WHERE {GUARD_SQL} GROUP BY proband, chrom")
def x_guarded_rows(c: Cohort) -> DataFrame:
    return family.x_guarded(_rows(c)).groupBy("proband", "chrom").agg(F.count("*").alias("n"))


@query(X_SQL + f"""SELECT proband, gene_symbol, count(*) FILTER (WHERE f_gt = 2) AS paternal, count(*) FILTER (WHERE f_gt = 0) AS maternal,
 array_to_string(list_sort(list(concat_ws(':', chrom, pos, ref, alt, CASE WHEN f_gt = 2 THEN 'paternal' ELSE 'maternal' END))), ',') AS variants
FROM (SELECT x.*, gene_symbol FROM x JOIN genes ON x.chrom = genes.chrom AND pos BETWEEN start_pos - 600000 AND end_pos + 600000
 WHERE sex = 'female' AND g_gt = 1 AND ((f_gt = 2 AND m_gt = 0) OR (f_gt = 0 AND m_gt > 0)) AND {X_GATES.replace('0.018', '0.02')}) GROUP BY proband, gene_symbol HAVING count(*) FILTER (WHERE f_gt = 2) > 0 AND count(*) FILTER (WHERE f_gt = 0) > 0""")
def x_compound_het(c: Cohort) -> DataFrame:
    wide = c.genes.select("gene_symbol", "chrom", (F.col("start_pos") - 600_000).alias("start_pos"), (F.col("end_pos") + 600_000).alias("end_pos"))
    return family.x_compound_het(_rows(c), wide, **(X_LIMITS | {"max_af_x": 0.02}))


@query("""SELECT proband, sample_id, role, sex, source, warning, max(blocked) OVER (PARTITION BY proband) AS blocked_reason FROM (
 SELECT *, CASE WHEN (declared IS NOT NULL AND declared <> told) OR (sure IS NOT NULL AND sure <> told) THEN 'parent_sex_conflict' WHEN told IS NULL AND sex IS NULL THEN 'needs_sex' END AS blocked FROM (
  SELECT *, coalesce(declared, believed, told) AS sex, CASE WHEN declared IS NOT NULL THEN 'pedigree' WHEN believed IS NOT NULL THEN 'inferred' WHEN told IS NOT NULL THEN 'role' END AS source,
   CASE WHEN declared <> sure THEN 'sex_conflict' WHEN (declared IS NULL AND doubted) OR (inferred = 'ambiguous' AND (told IS NOT NULL OR declared IS NULL)) THEN 'sex_ambiguous' END AS warning FROM (
   SELECT *, CASE WHEN NOT coalesce(doubted, false) THEN sure END AS believed FROM (
    SELECT *, CASE WHEN inferred IN ('male', 'female') THEN inferred END AS sure, CASE role WHEN 'father' THEN 'male' WHEN 'mother' THEN 'female' END AS told, role = 'proband' AND transmitted IS NOT NULL AND inferred IN ('male', 'female') AND transmitted <> inferred AS doubted FROM (
     SELECT proband, sample_id, role, CASE WHEN n % 4 = 0 THEN 'male' WHEN n % 4 = 1 THEN 'female' END AS declared, CASE n % 5 WHEN 0 THEN 'male' WHEN 1 THEN 'female' WHEN 2 THEN 'ambiguous' ELSE 'unknown' END AS inferred,
      CASE WHEN n % 7 = 0 THEN 'male' WHEN n % 7 = 1 THEN 'female' END AS transmitted FROM (
      SELECT proband, sample_id, role, CAST(substr(sample_id, 2) AS INT) AS n FROM (
       SELECT sample_id AS proband, sample_id, 'proband' AS role FROM pedigree UNION ALL SELECT sample_id, father_id, 'father' FROM pedigree UNION ALL SELECT sample_id, mother_id, 'mother' FROM pedigree)))))))""")
def trio_sexes(c: Cohort) -> DataFrame:
    parts = [c.pedigree.select(F.col("sample_id").alias("proband"), F.col(col).alias("sample_id"), F.lit(role).alias("role")) for col, role in (("sample_id", "proband"), ("father_id", "father"), ("mother_id", "mother"))]
    n = F.substr("sample_id", F.lit(2)).cast("int")
    members = parts[0].unionByName(parts[1]).unionByName(parts[2]).withColumns({
        "declared": F.when(n % 4 == 0, "male").when(n % 4 == 1, "female"),
        "inferred": F.when(n % 5 == 0, "male").when(n % 5 == 1, "female").when(n % 5 == 2, "ambiguous").otherwise("unknown"),
        "transmitted": F.when(n % 7 == 0, "male").when(n % 7 == 1, "female"),
    })
    return family.resolved_sexes(members)


@query(f"""{TRIO_SQL} SELECT proband, count(*) AS informative, round(avg(CASE WHEN g_gt = 1 THEN 1.0 ELSE 0.0 END), 6) AS carried,
 CASE WHEN count(*) < 5 THEN 'unknown' WHEN avg(CASE WHEN g_gt = 1 THEN 1.0 ELSE 0.0 END) >= 0.75 THEN 'female' WHEN avg(CASE WHEN g_gt = 1 THEN 1.0 ELSE 0.0 END) <= 0.25 THEN 'male' ELSE 'ambiguous' END AS transmitted_sex
FROM trio WHERE chrom = 'chrX' AND (pos BETWEEN 2781480 AND 154931043 OR pos BETWEEN 155260561 AND 155701382) AND f_gt = 2 AND m_gt = 0 AND g_gt IN (0, 1) GROUP BY proband""")
def transmitted_sex(c: Cohort) -> DataFrame:
    return rounded(family.transmitted_sex(_rows(c)), "carried")


@query("SELECT ingest_id, sample_id, count(*) FILTER (WHERE gt = 0) AS n_ref FROM genotypes GROUP BY ingest_id, sample_id")
def reference_rows(c: Cohort) -> DataFrame:
    return family.reference_rows(c.genotypes)


@query("""SELECT v.ingest_id, count(*) AS sites, count(*) FILTER (WHERE abs(info_AF - r) <= CASE WHEN r >= 0.01 THEN 0.01 * r ELSE 0 END + 0.0005) AS close,
 count(*) >= 20 AND count(*) FILTER (WHERE abs(info_AF - r) <= CASE WHEN r >= 0.01 THEN 0.01 * r ELSE 0 END + 0.0005) >= 0.9 * count(*) AS suspected
FROM variants v JOIN (SELECT chrom, pos, ref, alt, sum(gt) / (2 * (SELECT count(DISTINCT sample_id) FROM samples)) AS r FROM genotypes GROUP BY ALL HAVING sum(gt) > 0) a USING (chrom, pos, ref, alt) WHERE info_AF IS NOT NULL GROUP BY v.ingest_id""")
def cohort_derived_frequency(c: Cohort) -> DataFrame:
    return family.cohort_derived_af(c.variants, c.genotypes, c.samples)


PRESENCE = {
    **{f"{r}_{f}": ("true", f"{r}_{f} IS NOT NULL") for r in "gfm" for f in ("gq", "dp")}, "g_ab": ("g_gt = 1", "g_ad_ref IS NOT NULL AND g_ad_alt IS NOT NULL"),
    **{f"{r}_alt_reads": (f"{r}_gt = 0", f"{r}_ad_ref IS NOT NULL AND {r}_ad_alt IS NOT NULL") for r in "fm"},
}
STATE_SQL = "CASE WHEN known >= n THEN 'bound' WHEN known / n >= 0.9 THEN 'partial' ELSE 'unbound' END"


def _presence(model: str) -> str:
    return " UNION ALL ".join(f"SELECT proband, '{k}' AS field, count(*) FILTER (WHERE {of} AND {known}) AS known, count(*) FILTER (WHERE {of}) AS n FROM trio WHERE {MODEL_SQL[model]} GROUP BY proband" for k, (of, known) in PRESENCE.items())


@query(f"{TRIO_SQL} SELECT proband, field, known, n, {STATE_SQL} AS state FROM ({_presence('dominant')}) WHERE n > 0")
def gate_presence(c: Cohort) -> DataFrame:
    return family.gate_presence(_rows(c), "dominant")


@query(f"""{TRIO_SQL}, w AS (SELECT proband, regexp_replace(field, '^[gfm]_', '') AS kind, min(known / n) AS share FROM ({_presence('dominant')} UNION ALL {_presence('denovo')}) WHERE n > 0 GROUP BY 1, 2),
 d AS (SELECT proband, median(g_dp) AS depth FROM trio WHERE g_gt > 0 GROUP BY proband)
SELECT proband, kind, round(share, 6) AS share, CASE WHEN share >= 1 THEN 'bound' WHEN share >= 0.9 THEN 'partial' ELSE 'unbound' END AS state, coalesce(depth < 1.5 * 16, false) AS thin_coverage FROM w JOIN d USING (proband)""")
def effective_gates(c: Cohort) -> DataFrame:
    return rounded(family.effective_gates(_rows(c), ("dominant", "denovo"), 16), "share")


@query("""SELECT 'i1' AS ingest_id, count(*) AS sampled, count(g.pos) AS judged, count(g.pos) >= 0.1 * count(*) AS binds
FROM (SELECT DISTINCT chrom, pos, ref, alt FROM variants WHERE pos % greatest(1, ceil((SELECT count(*) FROM variants) / 500.0)) = 0) v
LEFT JOIN (SELECT DISTINCT chrom, pos, ref, alt FROM gnomad_af WHERE coalesce(af_grpmax, af) IS NOT NULL) g USING (chrom, pos, ref, alt)""")
def population_binding(c: Cohort) -> DataFrame:
    return family.population_binding(c.variants, c.gnomad_af, 500)


@query("""SELECT v.ingest_id, count(*) AS sites, count(*) FILTER (WHERE near) AS close, CASE WHEN count(*) = 0 THEN 'unavailable' WHEN NOT (count(*) >= 20 AND count(*) FILTER (WHERE near) >= 0.9 * count(*)) THEN 'applied' ELSE 'skipped_cohort_derived' END AS state
FROM (SELECT v.ingest_id, abs(info_AF - r) <= CASE WHEN r >= 0.01 THEN 0.01 * r ELSE 0 END + 0.0005 AS near FROM variants v
 JOIN (SELECT chrom, pos, ref, alt, sum(gt) / (2 * (SELECT count(DISTINCT sample_id) FROM samples)) AS r FROM genotypes GROUP BY ALL HAVING sum(gt) > 0) a USING (chrom, pos, ref, alt) WHERE info_AF IS NOT NULL) v GROUP BY v.ingest_id""")
def frequency_gate_state(c: Cohort) -> DataFrame:
    return family.af_gate_state(family.cohort_derived_af(c.variants, c.genotypes, c.samples), asked_for=False)


@query(f"{TRIO_SQL} SELECT proband, chrom, pos, ref, alt, f_gt, f_ad_ref, f_ad_alt, m_gt, m_ad_ref, m_ad_alt FROM trio WHERE ({MODEL_SQL['denovo']}) AND {GATES_SQL}")
def parent_reads(c: Cohort) -> DataFrame:
    rows = _rows(c)
    return family.parent_reads(rows, family.candidates(rows, "denovo", **LIMITS))


@query(f"""{TRIO_SQL} SELECT proband, t.chrom, t.pos, t.ref, t.alt, genes, clin_sig FROM (SELECT * FROM trio WHERE {MODEL_SQL['denovo']}) t
LEFT JOIN (SELECT v.chrom, v.pos, v.ref, v.alt, array_to_string(list_sort(list(DISTINCT gene_symbol)), ',') AS genes FROM variants v JOIN genes g ON v.chrom = g.chrom AND v.pos BETWEEN start_pos AND end_pos GROUP BY ALL) USING (chrom, pos, ref, alt)
LEFT JOIN clinvar_variants USING (chrom, pos, ref, alt)""")
def annotated_candidates(c: Cohort) -> DataFrame:
    return family.annotated(_rows(c).where(family.fits("denovo")).select("proband", *C.SITE), c.genes, c.clinvar_variants)


def _preset_sql(limits: dict) -> str:
    """A preset in SQL: trio rows whose population frequency is low enough, then each model under its gates."""
    gq, dp = limits["min_gq"], limits["min_dp"]
    at_least = (lambda x, n: f"coalesce({x} >= {n}, false)") if limits.get("strict") else (lambda x, n: f"({x} IS NULL OR {x} >= {n})")
    band = f"BETWEEN {limits['min_ab']} AND {limits['max_ab']}"
    gates = [f"{at_least(f'{r}_gq', gq)} AND {at_least(f'{r}_dp', dp)}" for r in "gfm"] + [_balanced("g", 1, band), f"(info_AF IS NULL OR info_AF <= {limits['max_af']} + 1e-7)", GUARD_SQL]
    if limits.get("pass_only"):
        gates.append("filter IS NULL")
    if share := limits.get("parent_alt_share"):
        gates += [f"coalesce({r}_ad_alt IS NULL OR {r}_ad_alt < 2 OR {r}_ad_alt / ({r}_ad_ref + {r}_ad_alt) < {share}, true)" for r in "fm"]
    gates = " AND ".join(f"({g})" for g in gates)
    parts = [f"SELECT proband, chrom, pos, ref, alt, '{m}' AS model, CAST(NULL AS VARCHAR) AS gene_symbol FROM pr WHERE ({MODEL_SQL[m]}) AND {gates}" for m in limits["models"] if m in MODEL_SQL]
    if "comphet" in limits["models"]:
        parts.append(f"""SELECT proband, chrom, pos, ref, alt, 'comphet', gene_symbol FROM (SELECT *, max(f_gt) OVER (PARTITION BY proband, gene_symbol) AS most, min(f_gt) OVER (PARTITION BY proband, gene_symbol) AS least
         FROM (SELECT q.*, gene_symbol FROM (SELECT * FROM pr WHERE ({MODEL_SQL['dominant']}) AND {gates}) q JOIN genes ON q.chrom = genes.chrom AND pos BETWEEN start_pos - 300000 AND end_pos + 300000)) WHERE most > 0 AND least = 0""")
    if "xlinked" in limits["models"]:
        x = f"""(m_gq IS NULL OR m_gq >= {gq}) AND (m_dp IS NULL OR m_dp >= {dp}) AND (g_gq IS NULL OR g_gq >= {gq}) AND (g_dp IS NULL OR g_dp >= CASE WHEN sex = 'male' THEN {dp // 2} ELSE {dp} END)
         AND (sex = 'male' OR ((f_gq IS NULL OR f_gq >= {gq}) AND (f_dp IS NULL OR f_dp >= {dp // 2}))) AND (sex <> 'male' OR {_balanced('g', 2, '>= 0.75')}) AND {_balanced('g', 1, band)} AND {_balanced('m', 1, band)}
         AND (info_AF IS NULL OR info_AF <= 0.001 + 1e-7)"""
        parts.append(f"SELECT proband, chrom, pos, ref, alt, 'xlinked', NULL FROM xp WHERE {X_NAMED} AND {X_CAPS.replace('<= 6', '<= 1')} AND {x}")
    head = f", pr AS (SELECT trio.* FROM trio LEFT JOIN gnomad_af USING (chrom, pos, ref, alt) WHERE coalesce(af_grpmax, af) IS NULL OR coalesce(af_grpmax, af) <= {limits['gnomad_max_af']} + 1e-7)"
    x_rows = X_SQL.replace(TRIO_SQL, "").replace(", x AS (", ", xp AS (").replace("FROM trio WHERE", "FROM pr WHERE")
    return TRIO_SQL + head + x_rows + " UNION ALL ".join(parts)


def _preset(name: str):
    limits = family.PRESETS[name]

    def run(c: Cohort) -> DataFrame:
        wide = c.genes.select("gene_symbol", "chrom", (F.col("start_pos") - 300_000).alias("start_pos"), (F.col("end_pos") + 300_000).alias("end_pos"))
        return family.preset(_rows(c), name, wide, c.gnomad_af)

    run.__name__ = f"preset_{name.replace('-', '_')}"
    query(_preset_sql(limits))(run)


for _name in family.PRESETS:
    _preset(_name)


@query("""SELECT 'i1' AS ingest_id, sample_id, unnest([father_id, mother_id]) AS other, 'parent-child' AS relation FROM pedigree""")
def declared_relations(c: Cohort) -> DataFrame:
    return family.on_pedigree(c.pedigree)


# --- relatedness and population genetics

KING_SQL = """, st AS (SELECT chrom, pos, ref, alt FROM variants WHERE chrom <> 'chrX'),
 m AS (SELECT st.*, s.sample_id, CASE WHEN q.sample_id IS NOT NULL THEN -1 ELSE coalesce(g.gt, 0) END AS gt FROM st CROSS JOIN samples s
  LEFT JOIN genotypes g ON g.sample_id = s.sample_id AND (g.chrom, g.pos, g.ref, g.alt) = (st.chrom, st.pos, st.ref, st.alt)
  LEFT JOIN missing_genotypes q ON q.sample_id = s.sample_id AND (q.chrom, q.pos, q.ref, q.alt) = (st.chrom, st.pos, st.ref, st.alt)),
 k AS (SELECT 'i1' AS ingest_id, a.sample_id AS a, b.sample_id AS b, count(*) FILTER (WHERE a.gt >= 0 AND b.gt >= 0) AS n_sites, count(*) FILTER (WHERE a.gt = 1 AND b.gt = 1) AS hethet,
  count(*) FILTER (WHERE (a.gt = 0 AND b.gt = 2) OR (a.gt = 2 AND b.gt = 0)) AS ibs0, count(*) FILTER (WHERE a.gt = 1 AND b.gt >= 0) + count(*) FILTER (WHERE b.gt = 1 AND a.gt >= 0) AS het_pair
  FROM m a JOIN m b ON (a.chrom, a.pos, a.ref, a.alt) = (b.chrom, b.pos, b.ref, b.alt) AND a.sample_id < b.sample_id GROUP BY a.sample_id, b.sample_id),
 kc AS (SELECT *, CASE WHEN het_pair < 20 THEN 'insufficient-data' WHEN (hethet - 2 * ibs0) / het_pair > 0.354 THEN 'duplicate'
  WHEN (hethet - 2 * ibs0) / het_pair > 0.177 AND ibs0 / n_sites < 0.005 THEN 'parent-child' WHEN (hethet - 2 * ibs0) / het_pair > 0.177 THEN 'full-siblings'
  WHEN (hethet - 2 * ibs0) / het_pair > 0.0884 THEN 'second-degree' WHEN (hethet - 2 * ibs0) / het_pair > 0.0442 THEN 'third-degree' ELSE 'unrelated' END AS relationship FROM k) """


def _kinship(c: Cohort) -> DataFrame:
    return relatedness.kinship(c.genotypes, c.missing_genotypes, c.samples, relatedness.usable_sites(c.variants))


@query(KING_SQL + "SELECT ingest_id, a, b, n_sites, hethet, ibs0, het_pair, round((hethet - 2 * ibs0) / nullif(het_pair, 0), 6) AS kinship, relationship FROM kc")
def king_kinship(c: Cohort) -> DataFrame:
    return rounded(relatedness.classified(_kinship(c)), "kinship")


@query(KING_SQL + """SELECT 'i1' AS ingest_id, d.sample_id, role, parent, relationship, CASE WHEN relationship IS NULL OR relationship = 'insufficient-data' THEN 'insufficient data' WHEN relationship = 'parent-child' THEN 'ok' ELSE 'mismatch' END AS state
FROM (SELECT sample_id, 'father' AS role, father_id AS parent FROM pedigree UNION ALL SELECT sample_id, 'mother', mother_id FROM pedigree) d LEFT JOIN kc ON a = least(d.sample_id, parent) AND b = greatest(d.sample_id, parent)""")
def pedigree_check(c: Cohort) -> DataFrame:
    asked = relatedness.kinship_of(relatedness.declared_pairs(c.pedigree), c.genotypes, c.missing_genotypes, c.samples, relatedness.usable_sites(c.variants))
    return relatedness.pedigree_check(asked, c.pedigree, c.samples)


POP_SQL = """, sz AS (SELECT super_population AS grp, count(*) AS size FROM samples GROUP BY 1),
 pc AS (SELECT v.chrom, v.pos, v.ref, v.alt, v.filter, v.info_AA, sz.grp, sz.size, coalesce(a.k, 0) AS k, coalesce(a.het, 0) AS het, sz.size - coalesce(q.gone, 0) AS called, 2 * (sz.size - coalesce(q.gone, 0)) AS n
  FROM variants v CROSS JOIN sz
  LEFT JOIN (SELECT chrom, pos, ref, alt, super_population AS grp, CAST(sum(gt) AS BIGINT) AS k, count(*) FILTER (WHERE gt = 1) AS het FROM genotypes JOIN samples USING (sample_id) WHERE gt > 0 GROUP BY ALL) a
   ON a.grp = sz.grp AND (a.chrom, a.pos, a.ref, a.alt) = (v.chrom, v.pos, v.ref, v.alt)
  LEFT JOIN (SELECT chrom, pos, ref, alt, super_population AS grp, count(DISTINCT sample_id) AS gone FROM missing_genotypes JOIN samples USING (sample_id) GROUP BY ALL) q
   ON q.grp = sz.grp AND (q.chrom, q.pos, q.ref, q.alt) = (v.chrom, v.pos, v.ref, v.alt)),
 sr AS (SELECT chrom, pos, ref, alt, CASE WHEN chrom = 'chrX' THEN 'non_autosomal' WHEN any_value(filter) IS NOT NULL THEN 'filter' WHEN min(called / size) < 0.6 - 1e-12 THEN 'call_rate'
  WHEN coalesce(least(sum(k), sum(n) - sum(k)) / nullif(sum(n), 0), 0) < 0.02 - 1e-12 THEN 'maf' END AS reason FROM pc GROUP BY chrom, pos, ref, alt),
 pk AS (SELECT pc.*, CASE WHEN n > 1 THEN 2.0 * k * (n - k) / (n * (n - 1)) ELSE 0 END AS pi FROM pc JOIN sr USING (chrom, pos, ref, alt) WHERE reason IS NULL),
 ha AS (SELECT n, (SELECT sum(1.0 / i) FROM range(1, n) t(i)) AS a1 FROM (SELECT DISTINCT n FROM pc WHERE n > 1)) """
FILTERS = {"min_call_rate": 0.6, "maf": 0.02, "pass_only": True}


def _counts(c: Cohort) -> DataFrame:
    return popgen.counts(c.variants, c.genotypes, c.missing_genotypes, popgen.groups(c.samples, "super_population"))


@query(POP_SQL + "SELECT chrom, pos, ref, alt, grp, k, het, called, n FROM pc")
def group_counts(c: Cohort) -> DataFrame:
    return _counts(c).select(*C.SITE, "grp", "k", "het", "called", "n")


@query(POP_SQL + "SELECT coalesce(reason, 'kept') AS reason, count(*) AS sites FROM sr GROUP BY 1")
def site_filters(c: Cohort) -> DataFrame:
    return popgen.reasons(_counts(c), **FILTERS)


@query(POP_SQL + """SELECT *, round(1 - ho / nullif(he, 0), 6) AS f FROM (SELECT grp, count(*) AS sites, count(*) FILTER (WHERE k > 0 AND k < n) AS segregating, round(sum(pi), 6) AS pi,
 round(coalesce(sum(1 / a1) FILTER (WHERE k > 0 AND k < n), 0), 6) AS theta_w, round(avg(het / nullif(called, 0)), 6) AS ho, round(avg(CASE WHEN n > 1 THEN pi END), 6) AS he FROM pk LEFT JOIN ha USING (n) GROUP BY grp)""")
def diversity(c: Cohort) -> DataFrame:
    out = rounded(popgen.summary(popgen.kept(_counts(c), **FILTERS)), "pi", "theta_w", "ho", "he")
    return rounded(out.withColumn("f", 1 - F.try_divide(F.col("ho"), F.col("he"))), "f")


@query(POP_SQL + """SELECT grp1, grp2, count(*) AS sites, round(sum((p1 - p2) * (p1 - p2) - p1 * (1 - p1) / (n1 - 1) - p2 * (1 - p2) / (n2 - 1)), 6) AS num, round(sum(p1 * (1 - p2) + p2 * (1 - p1)), 6) AS den,
 round(sum((p1 - p2) * (p1 - p2) - p1 * (1 - p1) / (n1 - 1) - p2 * (1 - p2) / (n2 - 1)) / nullif(sum(p1 * (1 - p2) + p2 * (1 - p1)), 0), 6) AS fst
FROM (SELECT a.grp AS grp1, b.grp AS grp2, a.k / a.n AS p1, b.k / b.n AS p2, a.n AS n1, b.n AS n2 FROM pk a JOIN pk b ON (a.chrom, a.pos, a.ref, a.alt) = (b.chrom, b.pos, b.ref, b.alt) AND a.grp < b.grp WHERE a.n > 1 AND b.n > 1) GROUP BY grp1, grp2""")
def hudson_fst(c: Cohort) -> DataFrame:
    return rounded(popgen.hudson_fst(popgen.kept(_counts(c), **FILTERS)), "num", "den", "fst")


DERIVED_SQL = """, dv AS (SELECT *, CASE WHEN upper(info_AA) = ref THEN k WHEN upper(info_AA) = alt THEN n - k END AS d FROM pk) """


@query(POP_SQL + DERIVED_SQL + "SELECT grp, n, d AS j, count(*) AS sites FROM dv WHERE d IS NOT NULL GROUP BY ALL")
def site_spectrum(c: Cohort) -> DataFrame:
    return popgen.sfs(popgen.polarised(popgen.kept(_counts(c), **FILTERS)))


@query(POP_SQL + "SELECT grp, n, least(k, n - k) AS j, count(*) AS sites FROM pk GROUP BY ALL")
def folded_spectrum(c: Cohort) -> DataFrame:
    return popgen.sfs(popgen.kept(_counts(c), **FILTERS), folded=True)


M = 4
PROJECTED_SQL = DERIVED_SQL + f""", pj AS (SELECT grp, j, sum(exp(lgamma(d + 1) - lgamma(j + 1) - lgamma(d - j + 1) + lgamma(n - d + 1) - lgamma({M} - j + 1) - lgamma(n - d - {M} + j + 1) - lgamma(n + 1) + lgamma({M + 1}) + lgamma(n - {M} + 1))) AS sites
 FROM dv CROSS JOIN range(0, {M + 1}) t(j) WHERE d IS NOT NULL AND n >= {M} AND j <= d AND {M} - j <= n - d GROUP BY grp, j) """


@query(POP_SQL + PROJECTED_SQL + "SELECT grp, CAST(j AS INT) AS j, round(sites, 6) AS sites FROM pj")
def projected_spectrum(c: Cohort) -> DataFrame:
    return rounded(popgen.projected_sfs(popgen.polarised(popgen.kept(_counts(c), **FILTERS)), M), "sites")


_T = popgen.tajima(M)


@query(POP_SQL + PROJECTED_SQL + f"""SELECT grp, round(s, 6) AS s, round(pi, 6) AS pi, round(theta_l, 6) AS theta_l, round(theta_h, 6) AS theta_h, round(s / {_T['a1']}, 6) AS theta_w,
 CASE WHEN s > 0 AND {_T['e1']} * s + {_T['e2']} * s * (s - 1) > 0 THEN round((pi - s / {_T['a1']}) / sqrt({_T['e1']} * s + {_T['e2']} * s * (s - 1)), 6) END AS tajima_d, round(pi - theta_h, 6) AS fay_wu_h_raw
FROM (SELECT grp, coalesce(sum(sites) FILTER (WHERE j BETWEEN 1 AND {M - 1}), 0) AS s, coalesce(sum(2 * j * ({M} - j) * sites) FILTER (WHERE j BETWEEN 1 AND {M - 1}), 0) / {M * (M - 1)} AS pi,
 coalesce(sum(j * sites) FILTER (WHERE j BETWEEN 1 AND {M - 1}), 0) / {M - 1} AS theta_l, coalesce(sum(2 * j * j * sites) FILTER (WHERE j BETWEEN 1 AND {M - 1}), 0) / {M * (M - 1)} AS theta_h FROM pj GROUP BY grp)""")
def neutrality_tests(c: Cohort) -> DataFrame:
    out = popgen.neutrality(popgen.projected_sfs(popgen.polarised(popgen.kept(_counts(c), **FILTERS)), M), M).drop("fay_wu_h")
    return rounded(out, "s", "pi", "theta_l", "theta_h", "theta_w", "tajima_d", "fay_wu_h_raw")


@query(POP_SQL + """, sp AS (SELECT chrom, min(pos) AS s, max(pos) AS e FROM pk GROUP BY chrom),
 w AS (SELECT chrom, s + i * 250000 AS win_start, least(s + i * 250000 + 499999, e) AS win_end FROM (SELECT *, unnest(range(0, greatest(0, CAST(ceil((e - s + 1 - 500000) / 250000.0) AS BIGINT)) + 1)) AS i FROM sp))
SELECT grp, pk.chrom, win_start, win_end, count(*) AS sites, count(*) FILTER (WHERE k > 0 AND k < n) AS segregating, round(sum(pi), 6) AS pi, round(sum(pi) / (win_end - win_start + 1) * 1e6, 6) AS pi_per_mb
FROM pk JOIN w ON w.chrom = pk.chrom AND pos BETWEEN win_start AND win_end GROUP BY grp, pk.chrom, win_start, win_end""")
def diversity_windows(c: Cohort) -> DataFrame:
    out = popgen.windows(popgen.kept(_counts(c), **FILTERS), 500_000, 250_000)
    return rounded(out.withColumn("pi_per_mb", F.col("pi_per_bp") * 1e6).drop("pi_per_bp"), "pi", "pi_per_mb")


@query(POP_SQL + """, tr AS (SELECT 'i1' AS ingest_id, v.chrom, v.pos, v.ref, v.alt, CASE WHEN p_partkey % 50 <> 0 THEN s.n - coalesce(m.gone, 0) - CASE WHEN p_partkey % 40 = 0 THEN 1 ELSE 0 END END AS n_called, s.n AS n_samples, m.gone FROM variants v CROSS JOIN (SELECT count(DISTINCT sample_id) AS n FROM samples) s
 LEFT JOIN (SELECT chrom, pos, ref, alt, count(*) AS gone FROM missing_genotypes GROUP BY ALL) m USING (chrom, pos, ref, alt))
SELECT ingest_id, count(*) FILTER (WHERE n_called IS NULL) AS untracked, count(*) FILTER (WHERE n_called < n_samples AND gone IS NULL) AS unrecorded, count(*) FILTER (WHERE n_called IS NULL) = 0 AND count(*) FILTER (WHERE n_called < n_samples AND gone IS NULL) = 0 AS tracked FROM tr GROUP BY ingest_id""")
def missing_tracking(c: Cohort) -> DataFrame:
    return popgen.tracking(_loaded(c), c.samples, c.missing_genotypes)


def _loaded(c: Cohort) -> DataFrame:
    """The variants with counts as if told at their loading: unknown at some, one sample short at others."""
    total, key = c.samples.agg(F.countDistinct("sample_id").alias("__n")), ["ingest_id", *C.SITE]
    gone = c.missing_genotypes.groupBy(*key).agg(F.count("*").alias("__gone"))
    alt = c.genotypes.groupBy(*key).agg(F.sum("gt").cast("long").alias("__ac"))
    site = c.variants.join(gone, key, "left").join(alt, key, "left").crossJoin(F.broadcast(total))
    n_called = F.when(F.col("p_partkey") % 50 != 0, F.col("__n") - F.coalesce("__gone", F.lit(0)) - F.when(F.col("p_partkey") % 40 == 0, 1).otherwise(0))
    return site.withColumns({"n_called": n_called, "an_called": 2 * n_called, "ac_called": F.coalesce("__ac", F.lit(0))}).drop("__n", "__gone", "__ac")


@query(POP_SQL + """, ex AS (SELECT chrom, pos, ref, alt, any_value(filter) AS filter, sum(called) AS called, sum(k) AS k, sum(n) AS n, min(called / size) AS rate FROM pc GROUP BY chrom, pos, ref, alt)
SELECT CASE WHEN chrom = 'chrX' THEN 'non_autosomal' WHEN ex.filter IS NOT NULL THEN 'filter' WHEN p_partkey % 40 = 0 AND p_partkey % 50 <> 0 THEN 'inexact_group_counts' WHEN rate < 0.6 - 1e-12 THEN 'call_rate'
 WHEN coalesce(least(k, n - k) / nullif(n, 0), 0) < 0.02 - 1e-12 THEN 'maf' ELSE 'kept' END AS reason, count(*) AS sites FROM ex JOIN variants USING (chrom, pos, ref, alt) GROUP BY 1""")
def site_filters_exact(c: Cohort) -> DataFrame:
    counted = popgen.counts(_loaded(c), c.genotypes, c.missing_genotypes, popgen.groups(c.samples, "super_population"))
    return popgen.reasons(counted, **FILTERS)


@query(POP_SQL + PROJECTED_SQL + f"""SELECT grp, sites, round(s, 6) AS s, round(pi, 6) AS pi, round(s / {_T['a1']}, 6) AS theta_w, round(theta_l, 6) AS theta_l, round(theta_h, 6) AS theta_h
FROM (SELECT grp, coalesce(sum(sites) FILTER (WHERE j BETWEEN 1 AND {M - 1}), 0) AS s, coalesce(sum(2 * j * ({M} - j) * sites) FILTER (WHERE j BETWEEN 1 AND {M - 1}), 0) / {M * (M - 1)} AS pi,
 coalesce(sum(j * sites) FILTER (WHERE j BETWEEN 1 AND {M - 1}), 0) / {M - 1} AS theta_l, coalesce(sum(2 * j * j * sites) FILTER (WHERE j BETWEEN 1 AND {M - 1}), 0) / {M * (M - 1)} AS theta_h FROM pj GROUP BY grp)
JOIN (SELECT grp, count(*) AS sites FROM dv WHERE d IS NOT NULL AND n >= {M} GROUP BY grp) USING (grp)""")
def projected_estimates(c: Cohort) -> DataFrame:
    return rounded(popgen.projected_thetas(popgen.polarised(popgen.kept(_counts(c), **FILTERS)), M), "s", "pi", "theta_w", "theta_l", "theta_h")


@query("""SELECT chrom, pos, ref, alt FROM (SELECT *, row_number() OVER (ORDER BY chrom, pos, ref, alt) - 1 AS k, count(*) OVER () AS t FROM (SELECT DISTINCT chrom, pos, ref, alt FROM variants WHERE chrom <> 'chrX')) WHERE (k * 300) % t = 0 OR (k * 300) % t > t - 300""")
def thinned_sites(c: Cohort) -> DataFrame:
    return relatedness.usable_sites(c.variants, max_sites=300).select(*C.SITE)


@query("""SELECT chrom, CAST(row_number() OVER (ORDER BY CASE WHEN chrom = 'chrX' THEN 1 ELSE 0 END, CASE WHEN chrom = 'chrX' THEN 0 ELSE CAST(substr(chrom, 4) AS INT) END) AS INT) AS place FROM (SELECT DISTINCT chrom FROM variants)""")
def natural_order(c: Cohort) -> DataFrame:
    order = Window.orderBy(*P.contig_order(F.col("chrom")))  # a row for each contig
    return c.variants.select("chrom").distinct().withColumn("place", F.row_number().over(order))


# --- concordance

CONF = "(SELECT chrom, min(pos) AS start_pos, min(pos) + 700000 AS end_pos FROM truth GROUP BY chrom)"
SIDES_SQL = f""", cf AS {CONF}, sd AS (
 SELECT x.*, CASE WHEN ref || alt IN ('AG', 'GA', 'CT', 'TC') THEN 'ti' ELSE 'tv' END AS subtype, CASE WHEN gt = 2 THEN 'homalt' ELSE 'het' END AS blt, pos BETWEEN start_pos AND end_pos AS in_conf
 FROM (SELECT 'truth' AS side, * FROM truth UNION ALL SELECT 'query', * FROM query WHERE filter IS NULL) x JOIN cf USING (chrom)),
 cl AS (SELECT s.side, s.chrom, s.pos, s.ref, s.alt, s.subtype, s.blt, s.qual, CASE WHEN o.gt IS NOT NULL AND NOT s.in_conf THEN CASE WHEN s.side = 'query' THEN 'N' END WHEN o.gt = s.gt THEN 'TP'
  WHEN s.side = 'truth' THEN CASE WHEN s.in_conf THEN 'FN' END WHEN s.in_conf THEN 'FP' ELSE 'N' END AS bd, CASE WHEN o.gt IS NULL OR NOT s.in_conf THEN '.' WHEN o.gt = s.gt THEN 'gm' ELSE 'am' END AS bk
  FROM sd s LEFT JOIN sd o ON o.side <> s.side AND (o.chrom, o.pos, o.ref, o.alt) = (s.chrom, s.pos, s.ref, s.alt)),
 cv AS (SELECT * FROM cl WHERE bd IS NOT NULL) """


def _classified(c: Cohort) -> DataFrame:
    conf = c.truth.groupBy("chrom").agg(F.min("pos").alias("start_pos"), (F.min("pos") + 700_000).alias("end_pos"))
    return concord.classify(concord.tagged(c.truth, "truth", conf), concord.tagged(c.query, "query", conf), "PASS")


@query(SIDES_SQL + "SELECT side, chrom, pos, ref, alt, subtype, blt, bd, bk FROM cv")
def concordance_verdicts(c: Cohort) -> DataFrame:
    return _classified(c).select("side", *C.SITE, "subtype", "blt", "bd", "bk")


TALLY_SQL = """SELECT count(*) FILTER (WHERE side = 'truth' AND bd = 'TP') AS truth_tp, count(*) FILTER (WHERE side = 'truth' AND bd = 'FN') AS truth_fn, count(*) FILTER (WHERE side = 'query' AND bd = 'TP') AS query_tp,
 count(*) FILTER (WHERE side = 'query' AND bd = 'FP') AS query_fp, count(*) FILTER (WHERE side = 'query' AND bd = 'N') AS query_unk, count(*) FILTER (WHERE side = 'query' AND bd = 'FP' AND bk = 'am') AS query_fp_gt FROM cv"""


@query(SIDES_SQL + f"""SELECT *, round(truth_tp / (truth_tp + truth_fn), 6) AS recall, round(query_tp / (query_tp + query_fp), 6) AS precision, round(query_unk / (query_tp + query_fp + query_unk), 6) AS frac_na, query_fp - query_fp_gt AS fp_al FROM ({TALLY_SQL})""")
def concordance_summary(c: Cohort) -> DataFrame:
    out = concord.metrics(concord.tallies(_classified(c)))
    return rounded(out, "recall", "precision", "frac_na").select("truth_tp", "truth_fn", "query_tp", "query_fp", "query_unk", "query_fp_gt", "recall", "precision", "frac_na", "fp_al")


@query(SIDES_SQL + """SELECT threshold, CAST(sum(tp) OVER o AS BIGINT) AS tp, CAST(sum(fp) OVER o AS BIGINT) AS fp, round(sum(tp) OVER o / (SELECT count(*) FROM cv WHERE side = 'truth'), 6) AS recall, round(sum(tp) OVER o / nullif(sum(tp) OVER o + sum(fp) OVER o, 0), 6) AS precision
FROM (SELECT qual AS threshold, count(*) FILTER (WHERE bd = 'TP') AS tp, count(*) FILTER (WHERE bd = 'FP') AS fp FROM cv WHERE side = 'query' AND bd IN ('TP', 'FP') GROUP BY qual) WINDOW o AS (ORDER BY threshold DESC ROWS UNBOUNDED PRECEDING)""")
def quality_curve(c: Cohort) -> DataFrame:
    return rounded(concord.roc(_classified(c)), "recall", "precision").select("threshold", "tp", "fp", "recall", "precision")


STRATUM_SQL = "count(*) FILTER (WHERE side = 'truth' AND bd = 'TP') AS truth_tp, count(*) FILTER (WHERE side = 'truth' AND bd = 'FN') AS truth_fn, count(*) FILTER (WHERE side = 'query' AND bd = 'FP') AS query_fp"


@query(SIDES_SQL + f"SELECT CASE WHEN af IS NULL THEN 'novel' WHEN af < 0.001 THEN 'rare' WHEN af < 0.05 THEN 'low' ELSE 'common' END AS stratum, {STRATUM_SQL} FROM cv LEFT JOIN gnomad_af USING (chrom, pos, ref, alt) GROUP BY 1")
def concordance_by_frequency(c: Cohort) -> DataFrame:
    return concord.by_frequency(_classified(c), c.gnomad_af)


@query(SIDES_SQL + f"SELECT gene_symbol AS stratum, {STRATUM_SQL} FROM cv JOIN genes ON cv.chrom = genes.chrom AND pos BETWEEN start_pos AND end_pos GROUP BY 1")
def concordance_by_gene(c: Cohort) -> DataFrame:
    return concord.by_gene(_classified(c), c.genes)


@query(SIDES_SQL + f"SELECT clin_sig AS stratum, {STRATUM_SQL} FROM cv JOIN clinvar_variants USING (chrom, pos, ref, alt) GROUP BY 1")
def concordance_by_clinical(c: Cohort) -> DataFrame:
    return concord.by_clinical(_classified(c), c.clinvar_variants)


@query(SIDES_SQL + f"SELECT CASE WHEN pos - 1 >= 3000000 AND pos - 1 < 3500000 AND chrom IN ('chr1', 'chr2') THEN 'first' ELSE 'none' END AS stratum, {STRATUM_SQL} FROM cv GROUP BY 1")
def concordance_by_region(c: Cohort) -> DataFrame:
    bed = c.truth.sparkSession.createDataFrame([("chr1", 3_000_000, 3_500_000, "first"), ("chr2", 3_000_000, 3_500_000, "first")], "chrom string, start long, end long, name string")
    return concord.by_bed(_classified(c), bed)


@query(SIDES_SQL + """SELECT side, chrom, pos, ref, alt, bd, bk, genes, clin_sig, af FROM cv
LEFT JOIN (SELECT v.chrom, v.pos, v.ref, v.alt, array_to_string(list_sort(list(DISTINCT gene_symbol)), ',') AS genes FROM variants v JOIN genes g ON v.chrom = g.chrom AND v.pos BETWEEN start_pos AND end_pos GROUP BY ALL) USING (chrom, pos, ref, alt)
LEFT JOIN clinvar_variants USING (chrom, pos, ref, alt) LEFT JOIN gnomad_af USING (chrom, pos, ref, alt) WHERE bd IN ('FP', 'FN')""")
def audited_errors(c: Cohort) -> DataFrame:
    return concord.errors_audited(_classified(c), c.genes, c.clinvar_variants, c.gnomad_af)


@query(SIDES_SQL + "SELECT chrom, pos, ref, alt, 1 AS callers FROM cv WHERE side = 'truth' AND bd = 'FN'")
def missed_by_all(c: Cohort) -> DataFrame:
    return concord.missed_by_all(_classified(c).withColumn("caller", F.lit("one"))).withColumn("callers", F.col("callers").cast("int"))


@query("""SELECT chrom, pos, ref, alt, 'S' AS sample_id, coalesce(t.gt, q.gt) AS gt, CASE WHEN t.gt IS NOT NULL AND q.gt IS NOT NULL THEN 'Intersection' WHEN t.gt IS NOT NULL THEN 'truth' ELSE 'query' END AS "set"
FROM truth t FULL JOIN query q USING (chrom, pos, ref, alt)""")
def combined_sets(c: Cohort) -> DataFrame:
    return combine.combine({"truth": c.truth.withColumn("sample_id", F.lit("S")), "query": c.query.withColumn("sample_id", F.lit("S"))})


@query("""SELECT k.chrom, k.pos, k.ref, k.alt, 'truth:S' AS sample_id, t.gt FROM (SELECT chrom, pos, ref, alt FROM truth UNION SELECT chrom, pos, ref, alt FROM query) k LEFT JOIN truth t USING (chrom, pos, ref, alt)
UNION ALL SELECT k.chrom, k.pos, k.ref, k.alt, 'query:S', q.gt FROM (SELECT chrom, pos, ref, alt FROM truth UNION SELECT chrom, pos, ref, alt FROM query) k LEFT JOIN query q USING (chrom, pos, ref, alt)""")
def merged_samples(c: Cohort) -> DataFrame:
    return combine.filled(combine.merge_samples({"truth": c.truth.withColumn("sample_id", F.lit("S")), "query": c.query.withColumn("sample_id", F.lit("S"))}))


@query("SELECT chrom, pos, ref, alt, af, af_grpmax FROM gnomad_af WHERE pos % 2000 <> 0 UNION ALL SELECT chrom, pos, ref, alt, 0.5 AS af, NULL AS af_grpmax FROM variants WHERE pos % 2000 = 0")
def load_replaces(c: Cohort) -> DataFrame:
    new = c.variants.where("pos % 2000 = 0").select(*C.SITE, F.lit(0.5).alias("af"), F.lit(None).cast("double").alias("af_grpmax"))
    return annotations.latest_wins(c.gnomad_af, new, C.SITE)


# --- normalisation


@query("""SELECT chrom, pos + i AS pos, substr(r, i + 1, 1) AS ref, substr(a, i + 1, 1) AS alt FROM (SELECT chrom, pos, r, a, unnest(range(0, length(r))) AS i FROM (SELECT chrom, pos, concat(ref, 'AC', alt) AS r, concat(alt, 'AG', ref) AS a FROM truth)) WHERE substr(r, i + 1, 1) <> substr(a, i + 1, 1)
UNION ALL SELECT chrom, pos + 1, 'A', 'ATT' FROM query""")
def atomized_calls(c: Cohort) -> DataFrame:
    long = c.truth.select("chrom", "pos", F.concat("ref", F.lit("AC"), "alt").alias("ref"), F.concat("alt", F.lit("AG"), "ref").alias("alt"))
    insertion = c.query.select("chrom", "pos", F.concat("ref", F.lit("A")).alias("ref"), F.concat("ref", F.lit("ATT")).alias("alt"))
    none = c.truth.select(F.lit("none").alias("chrom"), F.lit("A").alias("sequence")).limit(1)
    return concord.normalised(long.unionByName(insertion), none)


@query("""SELECT concat(chrom, '_', CAST(pos AS VARCHAR)) AS chrom, CAST(3 AS BIGINT) AS pos, concat('G', substr(repeat('AC', 1 + CAST(pos % 3 AS INT)), 1, 2)) AS ref, 'G' AS alt FROM (SELECT DISTINCT chrom, pos FROM truth)""")
def left_aligned_calls(c: Cohort) -> DataFrame:
    """A deletion of one unit of a repeat, told at its last unit, on contigs of their own."""
    at = c.truth.select(F.concat_ws("_", "chrom", F.col("pos").cast("string")).alias("chrom"), (1 + F.col("pos") % 3).cast("int").alias("units")).distinct()
    calls = at.select("chrom", (F.lit(1) + 2 * F.col("units")).cast("long").alias("pos"), F.when(F.col("units") == 1, "GAC").otherwise("CAC").alias("ref"), F.when(F.col("units") == 1, "G").otherwise("C").alias("alt"))
    return concord.normalised(calls, at.select("chrom", F.concat(F.lit("TTG"), F.repeat(F.lit("AC"), F.col("units")), F.lit("TT")).alias("sequence")), decompose=False)


@query("SELECT chrom, pos, ref, a AS alt, CASE a WHEN alt THEN '0/1' ELSE '0/1' END AS gt FROM (SELECT chrom, pos, ref, alt, unnest([alt, 'T' || alt]) AS a FROM truth)")
def split_alleles(c: Cohort) -> DataFrame:
    return concord.biallelic(c.truth.select("chrom", "pos", "ref", F.concat_ws(",", "alt", F.concat(F.lit("T"), "alt")).alias("alt"), F.lit("1/2").alias("gt")))


@query("SELECT chrom, pos, CASE gt WHEN 2 THEN '1/1' ELSE '0/1' END AS gt, CASE WHEN pos % 3 = 0 THEN 'symbolic' END AS excluded FROM truth")
def comparable_calls(c: Cohort) -> DataFrame:
    calls = c.truth.select("chrom", "pos", "ref", F.when(F.col("pos") % 3 == 0, "<DEL>").otherwise(F.col("alt")).alias("alt"), concord.canonical_gt(F.when(F.col("gt") == 2, "1/1").otherwise("1/0")).alias("gt"))
    return concord.comparable(calls).select("chrom", "pos", "gt", "excluded")


# --- transcripts

EXON_SQL = """, ex AS (SELECT concat('T', CAST(k AS VARCHAR), '_', gene_symbol) AS transcript_id, gene_symbol, i AS exon_number, chrom, start_pos + i * 15000 + k * 2000 AS start_pos, start_pos + i * 15000 + k * 2000 + 5000 AS end_pos, k = 0 AND CAST(substr(gene_symbol, 2) AS INT) % 3 <> 0 AS is_canonical
 FROM genes CROSS JOIN range(0, 4) e(i) CROSS JOIN range(0, 2) t(k)) """


def _exons(c: Cohort) -> DataFrame:
    many = c.genes.withColumn("exon_number", F.explode(F.sequence(F.lit(0), F.lit(3)))).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(1))))
    first = F.col("start_pos") + F.col("exon_number") * 15_000 + F.col("k") * 2_000
    canonical = (F.col("k") == 0) & (F.substr("gene_symbol", F.lit(2)).cast("int") % 3 != 0)
    return many.select(F.concat_ws("_", F.concat(F.lit("T"), "k"), "gene_symbol").alias("transcript_id"), "gene_symbol", "exon_number", "chrom", first.alias("start_pos"), (first + 5_000).alias("end_pos"), canonical.alias("is_canonical"))


@query(EXON_SQL + "SELECT v.chrom, v.pos, ex.transcript_id, CAST(ex.exon_number AS INT) AS exon_number FROM (SELECT DISTINCT chrom, pos FROM variants) v JOIN ex ON v.chrom = ex.chrom AND v.pos BETWEEN ex.start_pos AND ex.end_pos")
def exons_at_position(c: Cohort) -> DataFrame:
    return annotations.exons_at(c.variants.select("chrom", "pos").distinct(), _exons(c)).select("chrom", "pos", "transcript_id", "exon_number")


@query(EXON_SQL + """, best AS (SELECT * FROM (SELECT *, bool_or(is_canonical) OVER (PARTITION BY gene_symbol) AS anyone FROM ex) WHERE is_canonical OR NOT anyone)
SELECT gene_symbol, chrom, min(start_pos) AS start_pos, max(end_pos) AS end_pos FROM (SELECT *, sum(n) OVER (PARTITION BY gene_symbol, chrom ORDER BY start_pos, end_pos ROWS UNBOUNDED PRECEDING) AS no FROM (
 SELECT *, CASE WHEN start_pos <= max(end_pos) OVER (PARTITION BY gene_symbol, chrom ORDER BY start_pos, end_pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1 THEN 0 ELSE 1 END AS n FROM best)) GROUP BY gene_symbol, chrom, no""")
def coding_regions(c: Cohort) -> DataFrame:
    exons = _exons(c)
    return annotations.coding_regions(exons.drop("gene_symbol", "is_canonical"), exons.select("transcript_id", "gene_symbol", "is_canonical").distinct())


@query(EXON_SQL + "SELECT v.chrom, v.pos, CAST(min(least(abs(v.pos - ex.start_pos), abs(v.pos - ex.end_pos))) AS BIGINT) AS distance FROM (SELECT DISTINCT chrom, pos FROM variants) v LEFT JOIN ex ON v.chrom = ex.chrom GROUP BY v.chrom, v.pos")
def splice_distances(c: Cohort) -> DataFrame:
    return annotations.splice_distance(c.variants.select("chrom", "pos").distinct(), _exons(c))


@query(EXON_SQL + "SELECT DISTINCT transcript_id, gene_symbol, is_canonical FROM ex WHERE gene_symbol = 'G7'")
def gene_transcripts(c: Cohort) -> DataFrame:
    return annotations.transcripts_of(_exons(c).select("transcript_id", "gene_symbol", "is_canonical").distinct(), "g7")


@query("SELECT sample_id, chrom, pos, ref, alt, gt FROM (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY dp DESC, chrom, pos, ref, alt) AS r FROM genotypes) WHERE r = 1")
def deepest_call(c: Cohort) -> DataFrame:
    return annotations.first_per_key(c.genotypes, ["sample_id"], [F.desc("dp"), *C.SITE]).select("sample_id", *C.SITE, "gt")


# --- scopes

SCOPE_SQL = "EXISTS (SELECT 1 FROM genes g WHERE g.chrom = v.chrom AND v.pos BETWEEN greatest(g.start_pos - 5000, 1) AND g.end_pos + 5000 AND CAST(substr(g.gene_symbol, 2) AS INT) % 7 = 0)"


def _scope(c: Cohort) -> DataFrame:
    none = c.genes.select(F.lit("").alias("alias"), F.lit("alias").alias("kind"), F.col("gene_symbol").alias("symbol")).limit(0)
    tokens = c.genes.where(F.substr("gene_symbol", F.lit(2)).cast("int") % 7 == 0).select(F.lower("gene_symbol").alias("token"))
    return scope.of_genes(tokens, c.genes, none, 5000)


@query(f"SELECT v.chrom, v.pos, v.ref, v.alt FROM variants v WHERE {SCOPE_SQL}")
def scope_included(c: Cohort) -> DataFrame:
    return scope.within(c.variants, _scope(c)).select(*C.SITE)


@query(f"SELECT v.chrom, v.pos, v.ref, v.alt FROM variants v WHERE NOT {SCOPE_SQL}")
def scope_excluded(c: Cohort) -> DataFrame:
    return scope.within(c.variants, _scope(c), exclude=True).select(*C.SITE)
