"""Side files and stored tables: pedigrees, panels, gene models, aliases, annotation calls, regions, dumps and replacement."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import predicates as P
from ..operators.annotations import first_per_key
from ..plans.fixtures import PARTS


def _lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).where((F.length(F.trim("value")) > 0) & ~F.col("value").startswith("#"))


def read_ped(spark: SparkSession, path: str, ingest_id: str) -> DataFrame:
    """Pedigree rows (family, individual, father, mother, sex, phenotype, by white space)."""
    c = F.split(F.trim("value"), r"\s+")
    sex = F.when(F.get("c", 4) == "1", "male").when(F.get("c", 4) == "2", "female").otherwise("unknown")
    affected = F.when(F.get("c", 5) == "2", True).when(F.get("c", 5) == "1", False)
    rows = _lines(spark, path).select(c.alias("c"))
    ok = F.when(F.size("c") >= 5, F.get("c", 1)).otherwise(F.raise_error(F.lit("a pedigree line needs five fields or more")))
    return rows.select(F.lit(ingest_id).alias("ingest_id"), ok.alias("sample_id"), F.get("c", 0).alias("family_id"), F.get("c", 2).alias("father_id"), F.get("c", 3).alias("mother_id"), sex.alias("sex"), affected.alias("affected"))


# Header names of a population panel.
PANEL_NAMES = {"sample_id": ("sample", "sample_id", "iid", "individual"), "population": ("pop", "population"), "super_population": ("super_pop", "superpop", "super_population", "region"), "sex": ("gender", "sex")}


def read_panel(spark: SparkSession, path: str, ingest_id: str) -> DataFrame:
    """Population labels; the delimiter and the columns follow from the header line."""
    head = spark.read.text(path).where(F.length(F.trim("value")) > 0).first()
    if head is None:
        raise ValueError(f"{path} is empty")
    sep = "\t" if "\t" in head.value else "," if "," in head.value else r"\s+"
    names = [x.strip().lower() for x in (head.value.split(sep) if sep != r"\s+" else head.value.split())]
    at = {k: next((names.index(a) for a in v if a in names), None) for k, v in PANEL_NAMES.items()}
    if at["sample_id"] is None or at["population"] is None:
        raise ValueError(f"{path} needs a sample and a population column")
    rows = spark.read.text(path).where((F.length(F.trim("value")) > 0) & (F.col("value") != head.value)).select(F.split(F.trim("value"), sep).alias("c"))
    field = lambda k: F.trim(F.get("c", at[k])) if at[k] is not None else F.lit(None).cast("string")
    sex = F.lower(field("sex"))
    out = rows.select(F.lit(ingest_id).alias("ingest_id"), field("sample_id").alias("sample_id"), field("population").alias("population"), field("super_population").alias("super_population"), F.when(sex.isin("1", "m", "male"), "male").when(sex.isin("2", "f", "female"), "female").otherwise("unknown").alias("sex")).distinct()
    twice = F.count("*").over(Window.partitionBy("sample_id"))
    return out.withColumn("sample_id", F.when(twice > 1, F.raise_error(F.concat(F.lit("conflicting labels of "), "sample_id"))).otherwise(F.col("sample_id")))


def panel_match(panel: DataFrame, samples: DataFrame) -> DataFrame:
    """sample_id and whether it is in both, only in the panel or only among the samples."""
    both = panel.select("sample_id", F.lit(1).alias("p")).join(samples.select("sample_id", F.lit(1).alias("s")).distinct(), "sample_id", "full")
    return both.select("sample_id", F.when(F.col("p").isNull(), "only_samples").when(F.col("s").isNull(), "only_panel").otherwise("matched").alias("state"))


def _gff(spark: SparkSession, path: str) -> DataFrame:
    c = F.split("value", "\t")
    attributes = F.map_from_entries(F.transform(F.filter(F.split(F.get("c", 8), ";"), lambda x: x.contains("=")), lambda x: F.struct(F.trim(F.split_part(x, F.lit("="), F.lit(1))).alias("k"), F.split_part(x, F.lit("="), F.lit(2)).alias("v"))))
    rows = _lines(spark, path).select(c.alias("c")).where(F.size("c") >= 9)
    return rows.select(F.get("c", 0).alias("chrom"), F.get("c", 2).alias("feature"), F.get("c", 3).cast("long").alias("start_pos"), F.get("c", 4).cast("long").alias("end_pos"), F.get("c", 6).alias("strand"), F.get("c", 7).try_cast("int").alias("phase"), attributes.alias("a"))


def primary_contig():
    return F.col("chrom").rlike("^(chr)?([1-9]|1[0-9]|2[0-2]|X|Y|M|MT)$")


def read_genes(spark: SparkSession, path: str) -> DataFrame:
    """Genes of a GFF3 on primary contigs, the first of each symbol and contig."""
    at = lambda k: F.try_element_at("a", F.lit(k))
    genes = _gff(spark, path).where((F.col("feature") == "gene") & primary_contig()).select(at("gene_name").alias("gene_symbol"), P.canonical_contig(F.col("chrom")).alias("chrom"), "start_pos", "end_pos", "strand", at("gene_id").alias("gene_id"), at("gene_type").alias("description")).where("gene_symbol is not null")
    return first_per_key(genes, ["gene_symbol", "chrom"], ["start_pos", "end_pos", "gene_id"])


def read_transcripts(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """transcripts, exons and cds of a GFF3; the canonical transcript is the one tagged MANE_Select."""
    at = lambda k: F.try_element_at("a", F.lit(k))
    rows = _gff(spark, path).where(primary_contig()).withColumn("chrom", P.canonical_contig(F.col("chrom")))
    tags = F.coalesce(at("tag"), F.lit(""))
    own = rows.withColumn("transcript_id", at("transcript_id"))
    transcripts = own.where("feature = 'transcript'").select("transcript_id", at("gene_name").alias("gene_symbol"), "chrom", "start_pos", "end_pos", "strand", at("transcript_type").alias("biotype"), tags.contains("MANE_Select").alias("is_canonical"), tags.contains("MANE_Plus").alias("is_mane_plus"))
    part = lambda f, *more: own.where(F.col("feature") == f).select("transcript_id", at("exon_number").try_cast("int").alias("exon_number"), "chrom", "start_pos", "end_pos", *more)
    return {"transcripts": transcripts, "exons": part("exon"), "cds": part("CDS", "phase")}


def read_gene_aliases(spark: SparkSession, path: str) -> DataFrame:
    """alias, kind and symbol from a nomenclature table with a header line."""
    t = spark.read.csv(path, sep="\t", header=True)
    t = t.where(F.col("status") == "Approved") if "status" in t.columns else t
    kinds = {"prev_symbol": "previous", "alias_symbol": "alias", "hgnc_id": "hgnc_id", "entrez_id": "entrez", "ensembl_gene_id": "ensembl"}
    parts = [t.select(F.explode(F.split(F.col(c), r"\|")).alias("alias"), F.lit(k).alias("kind"), "symbol") for c, k in kinds.items() if c in t.columns]
    return reduce(DataFrame.unionByName, parts).where(F.length("alias") > 0).distinct()


def _annotation_records(spark: SparkSession, path: str) -> DataFrame:
    c = F.split("value", "\t")
    info = F.map_from_entries(F.array_distinct(F.transform(F.filter(F.split(F.get("c", 7), ";"), lambda x: x.contains("=")), lambda x: F.struct(F.split_part(x, F.lit("="), F.lit(1)).alias("k"), F.regexp_replace(x, "^[^=]*=", "").alias("v")))))
    rows = _lines(spark, path).select(c.alias("c")).select(P.canonical_contig(F.get("c", 0)).alias("chrom"), F.get("c", 1).cast("long").alias("pos"), F.get("c", 2).alias("id"), F.get("c", 3).alias("ref"), F.posexplode(F.split(F.get("c", 4), ",")).alias("i", "alt"), info.alias("m"), F.monotonically_increasing_id().alias("line"))
    return rows.where("alt <> '.'")


def read_clinvar(spark: SparkSession, path: str) -> DataFrame:
    at = lambda k: F.try_element_at("m", F.lit(k))
    return _annotation_records(spark, path).select("chrom", "pos", "ref", "alt", at("CLNSIG").alias("clin_sig"), at("CLNREVSTAT").alias("review_status"), F.col("id").alias("clinvar_id"), at("CLNDN").alias("condition"))


def read_population_af(spark: SparkSession, path: str) -> DataFrame:
    """af and af_grpmax of each allele, the first of a key in the file."""
    at = lambda k: F.get(F.split(F.try_element_at("m", F.lit(k)), ","), F.col("i")).try_cast("double")
    rows = _annotation_records(spark, path).select("chrom", "pos", "ref", "alt", at("AF").alias("af"), F.coalesce(at("AF_grpmax"), at("AF_popmax")).alias("af_grpmax"), "line", "i")
    return first_per_key(rows, ["chrom", "pos", "ref", "alt"], ["line", "i"]).drop("line", "i")


def read_bed(spark: SparkSession, path: str) -> DataFrame:
    """chrom, start_pos, end_pos (closed, 1-based) and name of half-open 0-based regions."""
    c = F.split("value", r"\s+")
    rows = _lines(spark, path).where(~F.col("value").rlike("^(track|browser)")).select(c.alias("c"))
    return rows.select(F.get("c", 0).alias("chrom"), (F.get("c", 1).cast("long") + 1).alias("start_pos"), F.get("c", 2).cast("long").alias("end_pos"), F.get("c", 3).alias("name")).where("start_pos <= end_pos")


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """chrom, start (from 1) and bases of each line; `concord.gridded` joins them to pieces.

    The few header lines tell every line its contig; positions are sums of lengths within a contig's lines of each input
    part, shifted by those of the parts before.
    """
    lines = spark.read.text(path).withColumn("__n", F.monotonically_increasing_id()).withColumn("__part", F.shiftright("__n", 33))
    heads = lines.where(F.col("value").startswith(">")).select("__n", F.regexp_extract("value", r"^>(\S+)", 1).alias("chrom")).orderBy("__n").collect()  # a row for each contig
    if not heads:
        return lines.select(F.lit(None).cast("string").alias("chrom"), F.lit(1).cast("long").alias("start"), F.col("value").alias("bases")).limit(0)
    spans = spark.createDataFrame([(h.chrom, h["__n"], n["__n"] if n else None) for h, n in zip(heads, [*heads[1:], None], strict=True)], "chrom string, __from long, __to long")
    inside = (F.col("__n") > F.col("__from")) & (F.col("__to").isNull() | (F.col("__n") < F.col("__to")))
    named = lines.where(~F.col("value").startswith(">")).withColumn("bases", F.upper(F.trim("value"))).join(F.broadcast(spans), inside)
    total = named.groupBy("chrom", "__part").agg(F.sum(F.length("bases")).alias("__l"))
    shift = total.withColumn("__before", F.coalesce(F.sum("__l").over(Window.partitionBy("chrom").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("__l")
    own = F.coalesce(F.sum(F.length("bases")).over(Window.partitionBy("chrom", "__part").orderBy("__n").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return named.withColumn("__own", own).join(shift, ["chrom", "__part"]).select("chrom", (F.col("__own") + F.col("__before") + 1).cast("long").alias("start"), "bases").where(F.length("bases") > 0)


# --- stored tables


def dump(tables: dict[str, DataFrame], folder: str) -> None:
    """Each table as Parquet, those of an ingestion dealt by it."""
    for name, df in tables.items():
        w = df.write.mode("overwrite")
        (w.partitionBy("ingest_id") if "ingest_id" in df.columns else w).parquet(f"{folder}/{name}")


def load(spark: SparkSession, folder: str, names: tuple[str, ...] = PARTS, ingest_id: str | None = None) -> dict[str, DataFrame]:
    """The tables of a dump, under another ingestion's name if asked for."""
    out = {n: spark.read.parquet(f"{folder}/{n}") for n in names}
    return {n: df.withColumn("ingest_id", F.lit(ingest_id)) if ingest_id and "ingest_id" in df.columns else df for n, df in out.items()}


def replace_ingestion(df: DataFrame, path: str) -> None:
    """Write rows so that those of the ingestions they belong to are replaced and all others stay."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("ingest_id").parquet(path)


def rolled_back(tables: dict[str, DataFrame], ingest_id: str) -> dict[str, DataFrame]:
    """The tables without an ingestion."""
    return {n: df.where(F.col("ingest_id") != ingest_id) if "ingest_id" in df.columns else df for n, df in tables.items()}
