"""Look-ups in annotation tables: genes by token or position, alleles in any contig spelling, transcripts and their parts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import predicates as P
from .ranges import containing, merge, nearest_boundary

#: Rank of the ways in which a token names a gene.
RANKS = ("symbol", "ensembl", "previous", "alias", "hgnc_id", "entrez")


def genes_at(points: DataFrame, genes: DataFrame) -> DataFrame:
    return containing(points, genes)


def resolve_genes(tokens: DataFrame, genes: DataFrame, aliases: DataFrame) -> DataFrame:
    """token, gene_symbol and how it was found: by symbol in any case, else by the first kind of alias that names exactly one gene.

    An approved symbol never falls through to another gene's alias. Version suffixes of stable ids are ignored.
    """
    t = tokens.select("token", F.upper(F.trim("token")).alias("__u"), F.upper(F.split_part(F.trim("token"), F.lit("."), F.lit(1))).alias("__s")).distinct()
    known = genes.select("gene_symbol").distinct()
    direct = t.join(known.withColumn("__u", F.upper("gene_symbol")), "__u").select("token", "gene_symbol", F.lit("symbol").alias("kind"), F.lit(0).alias("rank"), (F.col("token") != F.col("gene_symbol")).alias("inexact"))
    ranks = F.create_map(*(x for i, k in enumerate(RANKS) for x in (F.lit(k), F.lit(i))))
    named = aliases.join(known.withColumnRenamed("gene_symbol", "symbol"), "symbol", "left_semi").select(F.upper(F.split_part("alias", F.lit("."), F.lit(1))).alias("__s"), "kind", F.col("symbol").alias("gene_symbol"))
    other = t.join(direct.select("token").distinct(), "token", "left_anti").join(named, "__s").select("token", "gene_symbol", "kind", F.element_at(ranks, F.col("kind")).alias("rank"), F.lit(False).alias("inexact"))
    every = direct.unionByName(other)
    best = Window.partitionBy("token")
    ranked = every.withColumn("__best", F.min(F.struct("rank", "inexact")).over(best)).where((F.col("rank") == F.col("__best.rank")) & (F.col("inexact") == F.col("__best.inexact")))
    one = ranked.groupBy("token").agg(F.countDistinct("gene_symbol").alias("n"), F.min("gene_symbol").alias("gene_symbol"), F.min("kind").alias("kind"))
    return tokens.select("token").distinct().join(one, "token", "left").select("token", F.when(F.col("n") == 1, F.col("gene_symbol")).alias("gene_symbol"), F.when(F.col("n") == 1, F.col("kind")).alias("kind"), F.coalesce(F.col("n") > 1, F.lit(False)).alias("is_ambiguous"))


def exact_alleles(keys: DataFrame, annotation: DataFrame, fields: list[str]) -> DataFrame:
    """keys (chrom, pos, ref, alt) with fields of the annotation, whatever the contig's spelling; a canonical spelling wins, and the caller's is returned."""
    spelt = annotation.select(P.canonical_contig(F.col("chrom")).alias("__c"), F.col("chrom").alias("__own"), "pos", "ref", "alt", *fields)
    first = Window.partitionBy("__c", "pos", "ref", "alt").orderBy(F.when(F.col("__own") == F.col("__c"), 0).otherwise(1), "__own")
    one = spelt.withColumn("__r", F.row_number().over(first)).where("__r = 1").drop("__r", "__own")
    return keys.withColumn("__c", P.canonical_contig(F.col("chrom"))).join(one, ["__c", "pos", "ref", "alt"], "left").select(*keys.columns, *fields)


def latest_wins(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """A table after a load: rows of the new one replace those of the same key."""
    return old.join(new.select(*key).distinct(), key, "left_anti").unionByName(new, allowMissingColumns=True)


def first_per_key(rows: DataFrame, key: list[str], order: list) -> DataFrame:
    return rows.withColumn("__r", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("__r = 1").drop("__r")


def coding_regions(cds: DataFrame, transcripts: DataFrame) -> DataFrame:
    """Merged coding intervals by gene and contig: of canonical transcripts, of all where a gene has none."""
    named = cds.join(transcripts.select("transcript_id", "gene_symbol", "is_canonical"), "transcript_id")
    best = named.withColumn("__any", F.bool_or("is_canonical").over(Window.partitionBy("gene_symbol"))).where(F.col("is_canonical") | ~F.col("__any"))
    keyed = best.select(F.struct("gene_symbol", "chrom").alias("__k"), "start_pos", "end_pos")
    return merge(keyed, "__k").select("__k.gene_symbol", "__k.chrom", "start_pos", "end_pos")


def transcripts_of(transcripts: DataFrame, symbol: str) -> DataFrame:
    return transcripts.where(F.upper("gene_symbol") == symbol.upper()).orderBy(F.desc("is_canonical"), "transcript_id")


def canonical_transcript(transcripts: DataFrame, symbol: str) -> DataFrame:
    return transcripts.where((F.upper("gene_symbol") == symbol.upper()) & F.col("is_canonical")).orderBy("transcript_id").limit(1)


def exons_at(points: DataFrame, exons: DataFrame) -> DataFrame:
    return containing(points, exons)


def splice_distance(points: DataFrame, exons: DataFrame) -> DataFrame:
    return nearest_boundary(points, exons)


def contigs_covered(annotation: DataFrame) -> DataFrame:
    return annotation.select(P.canonical_contig(F.col("chrom")).alias("chrom")).distinct()
