"""A synthetic cohort derived from the star-schema tables, in SQL that both Spark and other engines accept.

Parts become variants and their annotations, line items genotypes, suppliers samples (with populations from nation and
region, and a pedigree), orders missing genotypes, customers genes.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")

COHORT_SQL = """WITH np AS (SELECT count(*) AS n FROM part), ns AS (SELECT count(*) AS n FROM supplier),
variants AS (
 SELECT 'i1' AS ingest_id,
  concat('chr', CASE WHEN p_partkey % 23 = 22 THEN 'X' ELSE cast(p_partkey % 23 + 1 AS varchar(8)) END) AS chrom,
  cast(3000000 + (p_partkey - p_partkey % 23) * 1000 AS bigint) AS pos,
  substr('ACGT', cast(p_partkey % 4 + 1 AS int), 1) AS ref,
  substr('ACGT', cast((p_partkey + 1 + p_size % 3) % 4 + 1 AS int), 1) AS alt,
  CASE WHEN p_size % 10 = 0 THEN 'LowQual' END AS filter,
  CASE WHEN p_size % 7 <> 0 THEN cast(p_size AS double) / 2000 END AS info_AF,
  CASE WHEN p_partkey % 6 = 0 THEN NULL WHEN p_partkey % 2 = 0 THEN substr('ACGT', cast(p_partkey % 4 + 1 AS int), 1) ELSE substr('acgt', cast((p_partkey + 1 + p_size % 3) % 4 + 1 AS int), 1) END AS info_AA,
  p_partkey FROM part),
g0 AS (SELECT l_partkey, l_suppkey, max(l_linenumber) AS ln, cast(max(l_quantity) AS int) AS q, cast(max(l_discount) * 100 AS int) AS d, cast(max(l_tax) * 100 AS int) AS t FROM lineitem GROUP BY l_partkey, l_suppkey),
genotypes AS (
 SELECT v.ingest_id, v.chrom, v.pos, v.ref, v.alt, concat('S', cast(l_suppkey AS varchar(12))) AS sample_id,
  CASE WHEN ln >= 6 THEN 2 WHEN ln >= 3 THEN 1 ELSE 0 END AS gt,
  CASE WHEN q % 11 <> 0 THEN q * 2 END AS gq, q AS dp, d AS ad_ref, t AS ad_alt
 FROM g0 JOIN variants v ON v.p_partkey = g0.l_partkey),
samples AS (
 SELECT 'i1' AS ingest_id, concat('S', cast(s_suppkey AS varchar(12))) AS sample_id,
  CASE WHEN s_suppkey % 2 = 0 THEN 'A' ELSE 'B' END AS cohort, n_name AS population, r_name AS super_population
 FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
missing_genotypes AS (
 SELECT DISTINCT v.ingest_id, v.chrom, v.pos, v.ref, v.alt, concat('S', cast(m.sk AS varchar(12))) AS sample_id
 FROM (SELECT o_orderkey % np.n AS pk, o_custkey % ns.n AS sk FROM orders CROSS JOIN np CROSS JOIN ns WHERE o_orderkey % 10 = 3) m
 JOIN variants v ON v.p_partkey = m.pk
 WHERE NOT EXISTS (SELECT 1 FROM g0 WHERE g0.l_partkey = m.pk AND g0.l_suppkey = m.sk)),
pedigree AS (
 SELECT 'i1' AS ingest_id, concat('S', cast(s_suppkey AS varchar(12))) AS sample_id, concat('S', cast(s_suppkey + 1 AS varchar(12))) AS father_id, concat('S', cast(s_suppkey + 2 AS varchar(12))) AS mother_id,
  CASE WHEN s_suppkey % 2 = 0 THEN 'male' ELSE 'female' END AS sex
 FROM supplier CROSS JOIN ns WHERE s_suppkey % 3 = 0 AND s_suppkey + 2 < ns.n),
genes AS (
 SELECT concat('G', cast(c_custkey AS varchar(12))) AS gene_symbol,
  concat('chr', CASE WHEN c_custkey % 23 = 22 THEN 'X' ELSE cast(c_custkey % 23 + 1 AS varchar(8)) END) AS chrom,
  cast(3000000 + (c_custkey - c_custkey % 23) * 1300 AS bigint) AS start_pos,
  cast(3000000 + (c_custkey - c_custkey % 23) * 1300 + 60000 AS bigint) AS end_pos FROM customer),
gnomad_af AS (SELECT v.chrom, v.pos, v.ref, v.alt, cast(p.p_size AS double) / 500 AS af, CASE WHEN p.p_size % 4 <> 0 THEN cast(p.p_size AS double) / 300 END AS af_grpmax FROM part p JOIN variants v ON v.p_partkey = p.p_partkey WHERE p.p_partkey % 3 <> 0),
clinvar_variants AS (SELECT v.chrom, v.pos, v.ref, v.alt, p.p_type AS clin_sig FROM part p JOIN variants v ON v.p_partkey = p.p_partkey WHERE p.p_partkey % 5 = 0),
truth AS (SELECT chrom, pos, ref, alt, CASE WHEN p_partkey % 4 = 0 THEN 2 ELSE 1 END AS gt, filter, cast(p_partkey % 40 AS double) AS qual FROM variants WHERE p_partkey % 25 <> 0),
query AS (SELECT chrom, pos, ref, alt, CASE WHEN p_partkey % 4 = 0 AND p_partkey % 48 <> 0 THEN 2 ELSE 1 END AS gt, filter, cast(p_partkey % 40 AS double) AS qual FROM variants WHERE p_partkey % 30 <> 7)
"""

PARTS = ("variants", "genotypes", "samples", "missing_genotypes", "pedigree", "genes", "gnomad_af", "clinvar_variants", "truth", "query")


@dataclass
class Cohort:
    """The tables of a cohort; calls of all ingestions side by side."""

    variants: DataFrame
    genotypes: DataFrame
    samples: DataFrame
    missing_genotypes: DataFrame
    pedigree: DataFrame
    genes: DataFrame
    gnomad_af: DataFrame
    clinvar_variants: DataFrame
    truth: DataFrame
    query: DataFrame


#: Folders of cohorts that were derived beforehand, by the folder of their tables.
_STORED: dict[str, str] = {}


def store(spark: SparkSession, sf_dir: str, to: str) -> None:
    """Derive the cohort once and write it as Parquet; from then on `cohort` reads it for that folder."""
    for name, df in vars(cohort(spark, sf_dir)).items():
        df.write.mode("overwrite").parquet(f"{to}/{name}")
    _STORED[sf_dir] = to


def cohort(spark: SparkSession, sf_dir: str) -> Cohort:
    """The cohort of a folder's tables. No table is read until a query needs it."""
    if sf_dir in _STORED:
        return Cohort(**{p: spark.read.parquet(f"{_STORED[sf_dir]}/{p}") for p in PARTS})
    for t in TABLES:
        spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)
    return Cohort(**{p: spark.sql(f"{COHORT_SQL} SELECT * FROM {p}") for p in PARTS})
