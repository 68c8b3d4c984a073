"""Cohort questions: frequencies and their differences, carriers, genes, sample quality, sex, table statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import predicates as P

SITE = ["chrom", "pos", "ref", "alt"]
KEY = ["ingest_id", *SITE]


def pairs(who: DataFrame) -> Column:
    """Distinct samples, as pairs of ingestion and sample."""
    return F.countDistinct(F.struct("ingest_id", "sample_id"))


def with_cohort(genotypes: DataFrame, samples: DataFrame) -> DataFrame:
    return genotypes.join(F.broadcast(samples.select("ingest_id", "sample_id", "cohort").distinct()), ["ingest_id", "sample_id"])


def region_scan(variants: DataFrame, regions) -> DataFrame:
    return variants.where(P.in_regions(regions))


def top_variants(genotypes: DataFrame, n: int) -> DataFrame:
    """Sites by number of ALT alleles, most first, ties in site order."""
    return genotypes.where("gt > 0").groupBy(*SITE).agg(F.sum("gt").cast("long").alias("ac"), pairs(genotypes).alias("carriers")).orderBy(F.desc("ac"), *SITE).limit(n)


def carriers(genotypes: DataFrame, regions) -> DataFrame:
    """Carriers of each site in the regions."""
    return genotypes.where(P.in_regions(regions) & (F.col("gt") > 0)).groupBy(*SITE).agg(pairs(genotypes).alias("carriers"), F.count_if(F.col("gt") == 2).alias("hom_alt"))


def hom_ref(genotypes: DataFrame, samples: DataFrame) -> DataFrame:
    """Samples without an ALT allele at each site that someone carries."""
    total = samples.agg(pairs(samples).alias("n"))
    return genotypes.where("gt > 0").groupBy(*SITE).agg(pairs(genotypes).alias("carriers")).crossJoin(F.broadcast(total)).select(*SITE, (F.col("n") - F.col("carriers")).alias("hom_ref"))


def frequencies(genotypes: DataFrame, samples: DataFrame) -> DataFrame:
    """ALT counts and frequencies of each cohort at each site; the denominator is twice the cohort's samples, called or not."""
    size = samples.groupBy("cohort").agg((2 * pairs(samples)).alias("an"))
    counted = with_cohort(genotypes, samples).groupBy("cohort", *SITE).agg(F.sum("gt").cast("long").alias("ac"))
    return counted.join(F.broadcast(size), "cohort").withColumn("af", F.col("ac") / F.col("an"))


def difference(genotypes: DataFrame, samples: DataFrame, first: str, second: str, limit: int | None = 100) -> DataFrame:
    """Sites by the difference of two cohorts' frequencies, largest first."""
    size = samples.agg(*((2 * F.countDistinct(F.when(F.col("cohort") == c, F.struct("ingest_id", "sample_id")))).alias(n) for c, n in ((first, "an1"), (second, "an2"))))
    count = lambda c: F.coalesce(F.sum(F.when(F.col("cohort") == c, F.col("gt"))), F.lit(0)).cast("long")
    own = with_cohort(genotypes, samples).where(F.col("cohort").isin(first, second)).groupBy(*SITE).agg(count(first).alias("ac1"), count(second).alias("ac2"))
    out = own.crossJoin(F.broadcast(size)).where("an1 > 0 and an2 > 0").withColumns({"af1": F.round(F.col("ac1") / F.col("an1"), 4), "af2": F.round(F.col("ac2") / F.col("an2"), 4)})
    out = out.withColumn("diff", F.round(F.col("ac1") / F.col("an1") - F.col("ac2") / F.col("an2"), 4)).select(*SITE, "ac1", "an1", "af1", "ac2", "an2", "af2", "diff")
    ordered = out.orderBy(F.desc(F.abs("diff")), *SITE)
    return ordered.limit(limit) if limit else ordered


def called(genotypes: DataFrame, missing: DataFrame, samples: DataFrame, variants: DataFrame) -> DataFrame:
    """Called samples, alleles, call rate and frequency among the called of each site; absence of a row is a reference call."""
    total = samples.groupBy("ingest_id").agg(F.countDistinct("sample_id").alias("n"))
    gone = missing.groupBy(*KEY).agg(F.countDistinct("sample_id").alias("missing"))
    alt = genotypes.groupBy(*KEY).agg(F.sum("gt").cast("long").alias("ac_called"))
    site = variants.select(*KEY).join(gone, KEY, "left").join(alt, KEY, "left").join(F.broadcast(total), "ingest_id")
    n_called = F.col("n") - F.coalesce("missing", F.lit(0))
    return site.select(*SITE, n_called.alias("n_called"), F.coalesce("ac_called", F.lit(0)).alias("ac_called"), (n_called / F.col("n")).alias("call_rate"), F.try_divide(F.coalesce("ac_called", F.lit(0)).cast("double"), 2 * n_called).alias("called_af"))


def missing_by_population(missing: DataFrame, samples: DataFrame) -> DataFrame:
    return missing.join(F.broadcast(samples.select("ingest_id", "sample_id", "population")), ["ingest_id", "sample_id"]).groupBy("population").agg(F.count("*").alias("missing"), pairs(missing).alias("samples"))


def field_usability(genotypes: DataFrame) -> DataFrame:
    """For each genotype, how many rows carry each measure."""
    return genotypes.groupBy("gt").agg(F.count("*").alias("n"), *(F.count(c).alias(f"n_{c}") for c in ("gq", "dp", "ad_ref", "ad_alt")), F.expr("percentile(dp, 0.5)").alias("median_dp"))


def sample_qc(genotypes: DataFrame) -> DataFrame:
    """Counts of each sample; ratios are NULL without a denominator (`display_ratio` writes them)."""
    alt, snv, x = F.col("gt") > 0, P.is_snv(), F.col("chrom").isin(*P.X_NAMES)
    counts = genotypes.groupBy("ingest_id", "sample_id").agg(
        F.count_if(alt).alias("variants"), F.count_if(F.col("gt") == 1).alias("het"), F.count_if(F.col("gt") == 2).alias("hom_alt"),
        F.count_if(alt & snv & P.is_transition()).alias("ti"), F.count_if(alt & snv & ~P.is_transition()).alias("tv"),
        F.count_if(x & (F.col("gt") == 1)).alias("x_het"), F.count_if(x & alt).alias("x_calls"),
    )
    share = F.try_divide(F.col("x_het").cast("double"), F.col("x_calls"))
    return counts.withColumns({
        "ti_tv": F.try_divide(F.col("ti").cast("double"), F.col("tv")), "het_hom": F.try_divide(F.col("het").cast("double"), F.col("hom_alt")),
        "x_het_share": share, "sex": inferred_sex(F.col("x_calls"), share),
    })


def inferred_sex(calls: Column, het_share: Column, least: int = 20, male: float = 0.10, female: float = 0.20) -> Column:
    return F.when(calls < least, "unknown").when(het_share <= male, "male").when(het_share >= female, "female").otherwise("ambiguous")


def display_ratio(above: Column, below: Column) -> Column:
    return F.when(below > 0, F.format_string("%.2f", above / below)).when(above > 0, "inf").otherwise("NA")


def build_of(variants: DataFrame) -> DataFrame:
    """The build that X positions prove: beyond GRCh37's X only GRCh38 has any."""
    most = F.max(F.when(F.col("chrom").isin(*P.X_NAMES), F.col("pos")))
    return variants.agg(most.alias("max_x_pos"), F.when(most > P.GRCH37_X_LENGTH, "GRCh38").otherwise("unknown").alias("build"))


def column_population(table: DataFrame) -> DataFrame:
    """How many rows have a value, by column."""
    plain = [f.name for f in table.schema.fields if f.dataType.typeName() != "map"]
    counts = table.agg(F.count("*").alias("__n"), *(F.count(F.col(f"`{c}`")).alias(c) for c in plain))
    return counts.select("__n", F.explode(F.array(*(F.struct(F.lit(c).alias("field"), F.col(f"`{c}`").alias("populated")) for c in plain))).alias("x")).select("x.field", "x.populated", F.col("__n").alias("n_rows"))


def map_keys_used(table: DataFrame, column: str, top: int = 50) -> DataFrame:
    """The keys of an overflow column by how many rows carry them."""
    return table.select(F.explode(F.map_keys(column)).alias("key")).groupBy("key").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "key").limit(top)


def contig_counts(variants: DataFrame) -> DataFrame:
    return variants.groupBy("chrom").agg(F.count("*").alias("variants"), F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos"), F.count_if(P.passed(F.col("filter"))).alias("passed"))


def variants_in_gene(variants: DataFrame, genotypes: DataFrame, genes: DataFrame, symbol: str, flank: int = 0, limit: int = 100) -> DataFrame:
    """A gene's first variants with carriers and homozygotes of each, and whether there are more."""
    span = genes.where(F.upper("gene_symbol") == symbol.upper()).select(F.col("chrom").alias("__c"), (F.col("start_pos") - flank).alias("__s"), (F.col("end_pos") + flank).alias("__e"))
    inside = (F.col("chrom") == F.col("__c")) & F.col("pos").between(F.col("__s"), F.col("__e"))
    picked = variants.join(F.broadcast(span), inside, "left_semi").select(*KEY).orderBy(*SITE).limit(limit + 1)
    counted = genotypes.where("gt > 0").join(F.broadcast(picked), KEY, "left_semi").groupBy(*KEY).agg(F.countDistinct("sample_id").alias("carriers"), F.count_if(F.col("gt") == 2).alias("hom_alt"))
    more = picked.agg((F.count("*") > limit).alias("truncated"))
    out = picked.join(counted, KEY, "left").orderBy(*SITE).limit(limit)
    return out.select(*SITE, F.coalesce("carriers", F.lit(0)).alias("carriers"), F.coalesce("hom_alt", F.lit(0)).alias("hom_alt")).crossJoin(F.broadcast(more))


def locus_summary(variants: DataFrame, genotypes: DataFrame, regions) -> DataFrame:
    """One row: variants, genotype rows, carriers and the presence of quality fields at a locus."""
    here = P.in_regions(regions)
    v = variants.where(here).agg(F.count("*").alias("variants"))
    g = genotypes.where(here).agg(F.count("*").alias("genotype_rows"), F.countDistinct(F.when(F.col("gt") > 0, F.struct("ingest_id", "sample_id"))).alias("carriers"), F.count("gq").alias("with_gq"), F.count("dp").alias("with_dp"))
    return v.crossJoin(F.broadcast(g))


def position_cuts(variants: DataFrame, every: int) -> DataFrame:
    """Every so manieth position of a contig: the edges of bounded export windows."""
    from .ranges import ranked

    return ranked(variants, ["chrom"], ("pos", "ref", "alt")).where((F.col("__rank") + 1) % every == 0).select("chrom", "pos")
