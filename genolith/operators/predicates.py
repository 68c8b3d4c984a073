"""Row predicates as Columns: contigs, regions, quality and rarity gates, sex-chromosome regions.

A gate never yields NULL: an absent measure passes, unless a strict gate with a positive minimum asks for it.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Contig spellings and the non-PAR X intervals of both builds (closed, 1-based).
X_NAMES = ("chrX", "X", "chr23", "23")
Y_NAMES = ("chrY", "Y", "chr24", "24")
M_NAMES = ("chrM", "M", "chrMT", "MT")
GRCH37_X_LENGTH = 155_270_560
NPX = {
    "GRCh38": ((2_781_480, 155_701_382),),
    "GRCh37": ((2_699_521, 154_931_043), (155_260_561, 155_270_560)),
    "unknown": ((2_781_480, 154_931_043), (155_260_561, 155_701_382)),
}
AMBIGUOUS = {"GRCh38": (), "GRCh37": (), "unknown": ((2_699_521, 2_781_479), (154_931_044, 155_260_560))}
#: Slack of allele-frequency limits, for values stored with single precision.
AF_SLACK = 1e-7


def contig_aliases(name: str) -> tuple[str, ...]:
    """All spellings of a contig, exact in case."""
    for group in (X_NAMES, Y_NAMES, M_NAMES):
        if name in group:
            return group
    bare = name.removeprefix("chr")
    return (f"chr{bare}", bare) if bare.isdigit() else (name,)


def canonical_contig(c: Column) -> Column:
    """One spelling for each contig: chr1 to chr22, chrX, chrY, chrM, or the name itself."""
    bare = F.regexp_replace(c, "^chr", "")
    return (
        F.when(c.isin(*X_NAMES), "chrX").when(c.isin(*Y_NAMES), "chrY").when(c.isin(*M_NAMES), "chrM")
        .when(bare.rlike("^[0-9]+$"), F.concat(F.lit("chr"), bare)).otherwise(c)
    )


def contig_order(c: Column) -> tuple[Column, Column, Column]:
    """Sort keys of the natural order: numbered contigs by number, then the others by name."""
    bare = F.regexp_replace(c, "^chr", "")
    number = F.when(bare.rlike("^[0-9]+$"), bare.cast("long"))
    return number.isNull(), F.coalesce(number, F.lit(0)), F.when(number.isNull(), bare).otherwise("")


def is_autosome(c: Column) -> Column:
    """Human autosomes under either spelling."""
    return c.rlike("^(chr)?([1-9]|1[0-9]|2[0-2])$")


def is_autosome_like(c: Column) -> Column:
    """Any numbered contig, for species with other karyotypes; sex and mitochondrial contigs are not."""
    return c.rlike("^(chr)?[0-9]+[A-Za-z]?$") & ~c.isin(*X_NAMES, *Y_NAMES)


def any_of(terms: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a | b, terms, F.lit(False))


def in_intervals(pos: Column, intervals: Iterable[tuple[int, int]]) -> Column:
    """Closed intervals; none: false."""
    return any_of(pos.between(lo, hi) for lo, hi in intervals)


def in_regions(regions: Iterable[tuple[str, int | None, int | None]], chrom: str = "chrom", pos: str = "pos") -> Column:
    """Inside any of the regions (contig in any spelling, start, end; open where None)."""
    terms = []
    for contig, start, end in regions:
        term = F.col(chrom).isin(*contig_aliases(contig))
        if start is not None:
            term = term & (F.col(pos) >= start)
        if end is not None:
            term = term & (F.col(pos) <= end)
        terms.append(term)
    return any_of(terms)


def at_least(value: Column, least: float, strict: bool = False) -> Column:
    """A measure's minimum; unknown passes, unless strict and the minimum is positive."""
    if strict and least > 0:
        return F.coalesce(value >= least, F.lit(False))
    return value.isNull() | (value >= least)


def quality(prefix: str = "", min_gq: int = 20, min_dp: int = 10, strict: bool = False) -> Column:
    return at_least(F.col(f"{prefix}gq"), min_gq, strict) & at_least(F.col(f"{prefix}dp"), min_dp, strict)


def allele_balance(prefix: str = "", low: float = 0.25, high: float = 0.75) -> Column:
    """Heterozygous calls only: the ALT share of reads within the band; no reads or unknown depths pass."""
    ref, alt = F.col(f"{prefix}ad_ref").cast("double"), F.col(f"{prefix}ad_alt").cast("double")
    share = F.try_divide(alt, ref + alt)
    return F.coalesce((F.col(f"{prefix}gt") != 1) | share.isNull() | share.between(low, high), F.lit(True))


def hemizygous_balance(prefix: str = "", least: float = 0.75) -> Column:
    """Hemizygous ALT calls only: the ALT share of reads at least so much; no reads or unknown depths pass."""
    ref, alt = F.col(f"{prefix}ad_ref").cast("double"), F.col(f"{prefix}ad_alt").cast("double")
    return F.coalesce((F.col(f"{prefix}gt") != 2) | (F.try_divide(alt, ref + alt) >= least), F.lit(True))


def het_depths_known(prefix: str = "") -> Column:
    return (F.col(f"{prefix}gt") != 1) | (F.col(f"{prefix}ad_ref").isNotNull() & F.col(f"{prefix}ad_alt").isNotNull())


def rare(af: Column, most: float) -> Column:
    return af.isNull() | (af <= most + AF_SLACK)


def passed(filter_: Column) -> Column:
    """NULL, PASS, '.' and '' mean that a site passed its filters."""
    return filter_.isNull() | filter_.isin("PASS", ".", "")


def trusted_ref(prefix: str, most_share: float = 0.05) -> Column:
    """A parent's reference call with (almost) no ALT reads."""
    ref, alt = F.col(f"{prefix}ad_ref").cast("double"), F.col(f"{prefix}ad_alt").cast("double")
    return F.coalesce(alt.isNull() | (alt < 2) | (F.try_divide(alt, ref + alt) < most_share), F.lit(True))


def non_par_x(build: str = "unknown", chrom: str = "chrom", pos: str = "pos") -> Column:
    return F.col(chrom).isin(*X_NAMES) & in_intervals(F.col(pos), NPX[build])


def ambiguous_x(build: str = "unknown", chrom: str = "chrom", pos: str = "pos") -> Column:
    return F.col(chrom).isin(*X_NAMES) & in_intervals(F.col(pos), AMBIGUOUS[build])


def is_snv(ref: str = "ref", alt: str = "alt") -> Column:
    return F.col(ref).rlike("^[ACGT]$") & F.col(alt).rlike("^[ACGT]$")


def is_transition(ref: str = "ref", alt: str = "alt") -> Column:
    return F.concat(ref, alt).isin("AG", "GA", "CT", "TC")
