"""Scopes: gene tokens, regions and region files as merged intervals, by which rows are included or excluded."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import predicates as P
from .annotations import resolve_genes
from .ranges import containing, merge

#: Intervals up to which a scope is a literal predicate, which reaches the scan.
LITERAL = 64
#: Tokens up to which none may be unknown, and the share beyond.
FEW_TOKENS, UNKNOWN_SHARE = 20, 0.05


def intervals(df: DataFrame) -> DataFrame:
    """chrom (canonical), start_pos, end_pos merged."""
    return merge(df.select(P.canonical_contig(F.col("chrom")).alias("chrom"), "start_pos", "end_pos"))


def of_genes(tokens: DataFrame, genes: DataFrame, aliases: DataFrame, flank: int = 0) -> DataFrame:
    """The merged spans of the genes that tokens name, widened by a flank; too many unknown tokens are an error."""
    found = resolve_genes(tokens, genes, aliases)
    n = found.agg(F.count("*").alias("all"), F.count_if(F.col("gene_symbol").isNull()).alias("unknown")).first()
    if n.unknown and (n["all"] <= FEW_TOKENS or n.unknown > UNKNOWN_SHARE * n["all"]):
        raise ValueError(f"{n.unknown} of {n['all']} gene tokens are unknown or ambiguous")
    spans = genes.join(found.where("gene_symbol is not null").select("gene_symbol").distinct(), "gene_symbol", "left_semi")
    return intervals(spans.select("chrom", F.greatest(F.col("start_pos") - flank, F.lit(1)).alias("start_pos"), (F.col("end_pos") + flank).alias("end_pos")))


def _inside(rows: DataFrame, merged: DataFrame) -> DataFrame:
    """The distinct positions of rows inside."""
    at = rows.select("chrom", "pos").distinct().withColumn("__c", P.canonical_contig(F.col("chrom")))
    return containing(at, merged.withColumnRenamed("chrom", "__c"), chrom="__c").select("chrom", "pos").distinct()


def within(rows: DataFrame, merged: DataFrame, exclude: bool = False) -> DataFrame:
    """Rows inside the intervals, or outside them."""
    few = merged.limit(LITERAL + 1).collect()
    if len(few) <= LITERAL:
        inside = P.in_regions([(r.chrom, r.start_pos, r.end_pos) for r in few])
        return rows.where(~inside if exclude else inside)
    return rows.join(_inside(rows, merged), ["chrom", "pos"], "left_anti" if exclude else "left_semi")
