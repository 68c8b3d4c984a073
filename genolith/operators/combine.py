"""Combining call sets: union of sites with provenance, the first set's genotype winning, consensus and carried fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import predicates as P
from .cohort import SITE


def combine(sets: dict[str, DataFrame], least: int = 1, pass_only: bool = False, by_site: bool = False) -> DataFrame:
    """Genotypes of all sets (in order of priority) by site and sample, with `set`: the names that have the site, or Intersection.

    A sample's genotype is that of the first set with a known one. least: in how many sets a site (by_site: any allele
    at its position) must stand.
    """
    parts = [d.where(P.passed(F.col("filter"))) if pass_only else d for d in sets.values()]
    every = None
    for i, d in enumerate(parts):
        own = d.select(*SITE, "sample_id", "gt", F.lit(i).alias("__i"))
        every = own if every is None else every.unionByName(own)
    key = ["chrom", "pos"] if by_site else SITE
    names = F.array(*(F.lit(n) for n in sets))
    listed = F.array_sort(F.collect_set("__i"))
    seen = every.groupBy(*key).agg(listed.alias("__sets")).where(F.size("__sets") >= least)
    chosen = every.groupBy(*SITE, "sample_id").agg(F.min_by(F.col("gt"), F.when(F.col("gt").isNotNull(), F.col("__i"))).alias("gt"))
    told = F.when(F.size("__sets") == len(sets), "Intersection").otherwise(F.array_join(F.transform("__sets", lambda i: F.element_at(names, i + 1)), "-"))
    return chosen.join(seen.select(*key, told.alias("set")), key)


def merge_samples(sets: dict[str, DataFrame]) -> DataFrame:
    """The calls of all sets side by side, a sample being told with its set's name. Sparse: a sample without a call of a site has no row."""
    every = None
    for name, d in sets.items():
        own = d.select(*SITE, F.concat_ws(":", F.lit(name), "sample_id").alias("sample_id"), "gt")
        every = own if every is None else every.unionByName(own)
    return every


def site_rows(merged: DataFrame, samples: list[str]) -> DataFrame:
    """A row for each site with the genotypes of the samples in their order (NULL where there is no call): what a file's line needs."""
    known = merged.groupBy(*SITE).agg(F.map_from_entries(F.collect_set(F.struct("sample_id", "gt"))).alias("m"))  # one site's samples
    return known.select(*SITE, F.transform(F.array(*(F.lit(s) for s in samples)), lambda s: F.try_element_at("m", s)).alias("gts"))


def filled(merged: DataFrame) -> DataFrame:
    """The merged calls with a row for every sample of every site."""
    samples = sorted(r.sample_id for r in merged.select("sample_id").distinct().collect())  # the columns of the merged file
    names = F.array(*(F.lit(s) for s in samples))
    return site_rows(merged, samples).select(*SITE, F.posexplode("gts").alias("i", "gt")).select(*SITE, F.get(names, F.col("i")).alias("sample_id"), "gt")


def projected_info(value: str, number: str, allele: int) -> Column:
    """The part of a comma-joined field that belongs to one ALT (from 1): Number A, R (with the reference) or G (genotypes with it)."""
    parts = F.split(value, ",")
    if number == "A":
        return F.get(parts, allele - 1)
    if number == "R":
        return F.concat_ws(",", F.get(parts, 0), F.get(parts, allele))
    if number == "G":
        return F.concat_ws(",", F.get(parts, 0), F.get(parts, allele * (allele + 1) // 2), F.get(parts, allele * (allele + 1) // 2 + allele))
    return F.col(value)
