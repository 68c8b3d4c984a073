"""Population genetics: counts by site and group, a cascade of site filters, diversity, spectra, F_ST and windows.

Rows are (site, group) with k ALT alleles among n = 2 * called. Groups are few, so they are joined to sites as a
broadcast table; calls and missing calls are pre-aggregated before they meet the sites.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.tables import harmonics, log_factorials
from . import predicates as P
from .cohort import KEY
from .ranges import sliding_windows, small

EPS = 1e-12


def groups(samples: DataFrame, by: str = "population") -> DataFrame:
    """Sample labels; samples without one form `unlabelled`."""
    return samples.select("ingest_id", "sample_id", F.coalesce(F.col(by), F.lit("unlabelled")).alias("grp")).distinct()


def counts(variants: DataFrame, genotypes: DataFrame, missing: DataFrame, labels: DataFrame) -> DataFrame:
    """A row for each site and group: k, het, called, n; groups without any call of a site count as reference."""
    size = labels.groupBy("ingest_id", "grp").agg(F.count("*").alias("size"))
    alt = genotypes.where("gt > 0").join(small(labels), ["ingest_id", "sample_id"]).groupBy(*KEY, "grp").agg(F.sum("gt").cast("long").alias("k"), F.count_if(F.col("gt") == 1).alias("het"))
    gone = missing.join(small(labels), ["ingest_id", "sample_id"]).groupBy(*KEY, "grp").agg(F.countDistinct("sample_id").alias("gone"))
    grid = variants.select(*KEY, *(c for c in ("filter", "info_AA", "an_called", "ac_called") if c in variants.columns)).join(F.broadcast(size), "ingest_id")
    out = grid.join(alt, [*KEY, "grp"], "left").join(gone, [*KEY, "grp"], "left").fillna(0, ["k", "het", "gone"])
    return out.withColumn("called", F.col("size") - F.col("gone")).withColumn("n", 2 * F.col("called")).drop("gone")


def exact_counts(called: Column, alt: Column, an_called: Column, ac_called: Column) -> Column:
    """Whether the counts that missing rows leave agree with those that a site was loaded with; a site without them can't disagree."""
    return F.coalesce((2 * called == an_called) & (alt == ac_called), F.lit(True))


def site_reasons(counted: DataFrame, min_call_rate: float = 0.9, maf: float = 0.0, pass_only: bool = False) -> DataFrame:
    """KEY, reason: the first test that a site fails, NULL if it is kept.

    Order: non_autosomal, not_biallelic, variant_type, filter, inexact_group_counts (if the sites carry an_called and
    ac_called), call_rate, maf.
    """
    loaded = {"an_called", "ac_called"} <= set(counted.columns)
    site = counted.groupBy(*KEY).agg(
        F.min(F.col("called") / F.col("size")).alias("rate"), F.sum("k").alias("k"), F.sum("n").alias("n"), F.first("filter").alias("filter"), F.sum("called").alias("all_called"),
        *(F.first(c).alias(c) for c in ("an_called", "ac_called") if loaded),
    )
    shared = F.count("*").over(Window.partitionBy("ingest_id", "chrom", "pos"))
    minor = F.try_divide(F.least("k", F.col("n") - F.col("k")).cast("double"), F.col("n"))
    reason = F.when(~P.is_autosome_like(F.col("chrom")), "non_autosomal").when(F.col("alleles") > 1, "not_biallelic").when(~P.is_snv(), "variant_type")
    if pass_only:
        reason = reason.when(~P.passed(F.col("filter")), "filter")
    if loaded:
        reason = reason.when(~exact_counts(F.col("all_called"), F.col("k"), F.col("an_called"), F.col("ac_called")), "inexact_group_counts")
    reason = reason.when(F.col("rate") < min_call_rate - EPS, "call_rate").when(F.coalesce(minor, F.lit(0.0)) < maf - EPS, "maf")
    return site.withColumn("alleles", shared).select(*KEY, reason.alias("reason"))


def kept(counted: DataFrame, **limits) -> DataFrame:
    """The rows of the sites that pass all tests, in the shuffle by site that the tests need anyway."""
    return counted.join(site_reasons(counted, **limits).where("reason is null").select(*KEY), KEY, "left_semi")


def tracking(variants: DataFrame, samples: DataFrame, missing: DataFrame) -> DataFrame:
    """By ingestion, whether missing calls are told apart from reference ones, and what speaks against it.

    untracked: sites without loaded counts of called samples. unrecorded: sites at which fewer samples were called than
    there are, though no missing row says which.
    """
    total = samples.groupBy("ingest_id").agg(F.countDistinct("sample_id").alias("n_samples"))
    gone = missing.groupBy(*KEY).agg(F.count("*").alias("gone"))
    site = variants.select(*KEY, "n_called", "an_called").join(small(total), "ingest_id").join(gone, KEY, "left")
    unrecorded = (F.col("n_called") < F.col("n_samples")) & (F.col("an_called") == 2 * F.col("n_called")) & F.col("gone").isNull()
    out = site.groupBy("ingest_id").agg(F.count_if(F.col("n_called").isNull()).alias("untracked"), F.count_if(unrecorded).alias("unrecorded"))
    return out.withColumn("tracked", (F.col("untracked") == 0) & (F.col("unrecorded") == 0))


def require_tracking(found: DataFrame, allow_untracked: bool = False) -> DataFrame:
    """The tracking rows; an ingestion whose missing calls would count as reference is an error unless that is allowed."""
    if not allow_untracked and (bad := [r.ingest_id for r in found.where("not tracked").select("ingest_id").collect()]):  # a row for each ingestion
        raise ValueError(f"missing calls aren't tracked in {', '.join(sorted(bad))}")
    return found


def reasons(counted: DataFrame, **limits) -> DataFrame:
    return site_reasons(counted, **limits).groupBy(F.coalesce("reason", F.lit("kept")).alias("reason")).agg(F.count("*").alias("sites"))


def pi(k: Column, n: Column) -> Column:
    k, n = k.cast("double"), n.cast("double")
    return F.coalesce(F.try_divide(2 * k * (n - k), n * (n - 1)), F.lit(0.0))


def segregating() -> Column:
    return (F.col("k") > 0) & (F.col("k") < F.col("n"))


def most_called(counted: DataFrame) -> int:
    return int(counted.agg(F.max("n")).first()[0] or 0)


def summary(counted: DataFrame) -> DataFrame:
    """By group: sites, segregating sites, pi, Watterson's theta, observed and expected heterozygosity, inbreeding."""
    table = harmonics(counted.sparkSession, max(2, most_called(counted)))
    rows = counted.join(F.broadcast(table), "n", "left")
    he, ho = F.avg(F.when(F.col("n") > 1, pi(F.col("k"), F.col("n")))), F.avg(F.try_divide(F.col("het").cast("double"), F.col("called")))
    return rows.groupBy("grp").agg(
        F.count("*").alias("sites"), F.count_if(segregating()).alias("segregating"), F.sum(pi(F.col("k"), F.col("n"))).alias("pi"),
        F.coalesce(F.sum(F.when(segregating() & (F.col("n") > 1), F.try_divide(F.lit(1.0), F.col("a1")))), F.lit(0.0)).alias("theta_w"), ho.alias("ho"), he.alias("he"),
    ).withColumn("f", 1 - F.try_divide(F.col("ho"), F.col("he")))


def hudson_fst(counted: DataFrame) -> DataFrame:
    """Hudson's F_ST of each pair of groups as a ratio of sums; NULL where the denominator isn't positive."""
    one = F.struct("grp", (F.col("k") / F.col("n")).alias("p"), F.col("n").cast("double").alias("n"))
    # the groups of a site, few, meet in its row: one shuffle by site
    site = counted.where("n > 1").groupBy(*KEY).agg(F.array_sort(F.collect_list(one)).alias("g"))
    pairs = site.select(F.posexplode("g").alias("i", "a"), "g").select("a", F.explode(F.filter("g", lambda x: x["grp"] > F.col("a.grp"))).alias("b"))
    flat = pairs.select(F.col("a.grp").alias("grp1"), F.col("b.grp").alias("grp2"), F.col("a.p").alias("p1"), F.col("b.p").alias("p2"), F.col("a.n").alias("n1"), F.col("b.n").alias("n2"))
    num = F.expr("(p1 - p2) * (p1 - p2) - p1 * (1 - p1) / (n1 - 1) - p2 * (1 - p2) / (n2 - 1)")
    den = F.expr("p1 * (1 - p2) + p2 * (1 - p1)")
    out = flat.groupBy("grp1", "grp2").agg(F.count("*").alias("sites"), F.sum(num).alias("num"), F.sum(den).alias("den"))
    return out.withColumn("fst", F.when(F.col("den") > 0, F.col("num") / F.col("den")))


def ancestral(aa: Column) -> Column:
    """The ancestral base of an annotation like `a|||`, upper-cased, and NULL if it isn't one base."""
    base = F.upper(F.trim(F.substring_index(aa, "|", 1)))
    return F.when(base.rlike("^[ACGT]$"), base)


def polarised(counted: DataFrame, mode: str = "aa") -> DataFrame:
    """k as the number of derived alleles; sites whose ancestral base isn't REF or ALT are left out. mode: aa, aa-high (capitals only) or ref."""
    if mode == "ref":
        return counted
    aa = ancestral(F.col("info_AA"))
    if mode == "aa-high":
        aa = F.when(F.substring_index("info_AA", "|", 1).rlike("^[ACGT]$"), aa)
    derived = F.when(aa == F.col("ref"), F.col("k")).when(aa == F.col("alt"), F.col("n") - F.col("k"))
    return counted.withColumn("k", derived).where("k is not null")


def sfs(counted: DataFrame, folded: bool = False) -> DataFrame:
    """Sites by number of derived (folded: minor) alleles, by group and number of haplotypes."""
    j = F.least("k", F.col("n") - F.col("k")) if folded else F.col("k")
    return counted.groupBy("grp", "n", j.alias("j")).agg(F.count("*").alias("sites"))


def projected_sfs(counted: DataFrame, m: int) -> DataFrame:
    """The spectrum projected to m haplotypes by hypergeometric weights, over distinct (n, k); sites with fewer are left out."""
    table = log_factorials(counted.sparkSession, max(2, m, most_called(counted)))
    lf = [r.lf for r in table.orderBy("n").collect()]  # one number for each haplotype count
    known = F.array(*(F.lit(x) for x in lf))
    log_comb = lambda a, b: F.get(known, a) - F.get(known, b) - F.get(known, a - b)
    distinct = counted.where(F.col("n") >= m).groupBy("grp", "n", "k").agg(F.count("*").alias("w"))
    low, high = F.greatest(F.lit(0), F.lit(m) - (F.col("n") - F.col("k"))), F.least(F.lit(m), F.col("k"))
    spread = distinct.withColumn("j", F.explode(F.sequence(low.cast("int"), high.cast("int"))))
    n, k, j = (F.col(c).cast("int") for c in ("n", "k", "j"))
    weight = F.exp(log_comb(k, j) + log_comb(n - k, F.lit(m) - j) - log_comb(n, F.lit(m)))
    return spread.groupBy("grp", "j").agg(F.sum(F.col("w") * weight).alias("sites"))


def tajima(m: int) -> dict[str, float]:
    """Tajima's (1989) constants for m haplotypes."""
    a1, a2 = (sum(1 / i**p for i in range(1, m)) for p in (1, 2))
    b1, b2 = (m + 1) / (3 * (m - 1)), 2 * (m * m + m + 3) / (9 * m * (m - 1))
    c1, c2 = b1 - 1 / a1, b2 - (m + 2) / (a1 * m) + a2 / a1**2
    return {"a1": a1, "a2": a2, "e1": c1 / a1, "e2": c2 / (a1**2 + a2)}


def neutrality(spectrum: DataFrame, m: int) -> DataFrame:
    """By group, from an unfolded spectrum of m haplotypes: S, pi, thetas, Tajima's D and Fay and Wu's H (raw and normalised); NULL where undefined."""
    j, x = F.col("j").cast("double"), F.col("sites")
    inner = (F.col("j") > 0) & (F.col("j") < m)
    over = lambda term: F.coalesce(F.sum(F.when(inner, term)), F.lit(0.0))
    sums = spectrum.groupBy("grp").agg(
        over(x.cast("double")).alias("s"), (over(2 * j * (m - j) * x) / (m * (m - 1))).alias("pi"), (over(j * x) / (m - 1)).alias("theta_l"), (over(2 * j * j * x) / (m * (m - 1))).alias("theta_h"),
    )
    c, s = tajima(m), F.col("s")
    spread = c["e1"] * s + c["e2"] * s * (s - 1)
    d = F.when((s > 0) & (spread > 0), (F.col("pi") - s / c["a1"]) / F.sqrt(spread)) if m >= 4 else F.lit(None).cast("double")
    an, bn, bn1 = c["a1"], c["a2"], c["a2"] + 1 / m**2
    one = (m - 2) / (6 * (m - 1))
    two = (18 * m * m * (3 * m + 2) * bn1 - (88 * m**3 + 9 * m * m - 13 * m + 6)) / (9 * m * (m - 1) ** 2)
    variance = one * s / an + two * s * (s - 1) / (an * an + bn)
    h = F.when((s > 0) & (variance > 0), (F.col("pi") - F.col("theta_l")) / F.sqrt(variance)) if m >= 3 else F.lit(None).cast("double")
    return sums.withColumns({"theta_w": s / an, "tajima_d": d, "fay_wu_h_raw": F.col("pi") - F.col("theta_h"), "fay_wu_h": h})


def projected_thetas(counted: DataFrame, m: int) -> DataFrame:
    """By group, S, pi, theta_w, theta_l and theta_h of the spectrum projected to m haplotypes, without making it.

    Of J drawn alleles out of m, the first two moments and the chances of none and of all are known in closed form, so
    a site is one term whatever m is; sites with fewer haplotypes are left out.
    """
    table = log_factorials(counted.sparkSession, max(2, m, most_called(counted)))
    known = F.array(*(F.lit(r.lf) for r in table.orderBy("n").collect()))  # one number for each haplotype count
    n, k = F.col("n").cast("int"), F.col("k").cast("int")
    log_comb = lambda a: F.when(a >= m, F.get(known, a) - F.get(known, a - m))
    chance = lambda a: F.coalesce(F.exp(log_comb(a) - log_comb(n)), F.lit(0.0))
    share = k.cast("double") / n
    mean = m * share
    variance = F.coalesce(F.try_divide(m * share * (1 - share) * (n - m), (n - 1).cast("double")), F.lit(0.0))
    none, every = chance(n - k), chance(k)
    distinct = counted.where(F.col("n") >= m).groupBy("grp", "n", "k").agg(F.count("*").alias("w"))
    total = lambda x: F.sum(F.col("w") * x)
    out = distinct.groupBy("grp").agg(
        F.sum("w").alias("sites"), total(1 - none - every).alias("s"), total(pi(F.col("k"), F.col("n"))).alias("pi"),
        (total(mean - m * every) / (m - 1)).alias("theta_l"), (total(2 * (variance + mean * mean - m * m * every)) / (m * (m - 1))).alias("theta_h"),
    )
    return out.withColumn("theta_w", F.col("s") / tajima(m)["a1"])


def windows(counted: DataFrame, size: int, step: int) -> DataFrame:
    """pi and segregating sites of each group in windows, also by base pair."""
    spans = counted.groupBy("chrom").agg(F.min("pos").alias("span_start"), F.max("pos").alias("span_end"))
    placed = sliding_windows(counted, spans, size, step)
    out = placed.groupBy("grp", "chrom", "win_start", "win_end").agg(F.count("*").alias("sites"), F.count_if(segregating()).alias("segregating"), F.sum(pi(F.col("k"), F.col("n"))).alias("pi"))
    return out.withColumn("pi_per_bp", F.col("pi") / (F.col("win_end") - F.col("win_start") + 1))


