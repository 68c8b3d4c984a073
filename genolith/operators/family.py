"""Inheritance models over all trios of a pedigree at once, and the reports around them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import predicates as P
from .cohort import KEY, SITE
from .ranges import containing, small

ROLES = ("g", "f", "m")
FIELDS = ("gt", "gq", "dp", "ad_ref", "ad_alt")

#: What each model asks for: one of some rules, each the allowed genotypes of proband, father and mother. A parent's 0
#: must be stored, so a parent without a call fits none.
MODELS: dict[str, tuple[tuple[tuple[int, ...], ...], ...]] = {
    "denovo": (((1, 2), (0,), (0,)),),
    "recessive": (((2,), (1,), (1,)),),
    "dominant": (((1,), (1, 2), (0,)), ((1,), (0,), (1, 2))),
}


def register_model(name: str, *rules: tuple[tuple[int, ...], tuple[int, ...], tuple[int, ...]]) -> None:
    """Add an inheritance model by the genotypes that its rules allow."""
    MODELS[name] = rules


def _among(c: Column, allowed: tuple[int, ...] | None) -> Column:
    return F.lit(True) if allowed is None else F.coalesce(c.isin(*allowed), F.lit(False))


def fits(model: str) -> Column:
    """Whether a trio row's genotypes fit a model."""
    return P.any_of(_all(_among(F.col(f"{r}_gt"), own) for r, own in zip(ROLES, rule, strict=True)) for rule in MODELS[model])


def trios(genotypes: DataFrame, pedigree: DataFrame, variants: DataFrame | None = None) -> DataFrame:
    """A row for each trio and site of which the proband has a call: g_, f_ and m_ fields, with info_AF and filter.

    Calls meet the pedigree first (a small table), then are brought together by trio and site in one shuffle.
    """
    carried = ["sex"] if "sex" in pedigree.columns else []
    ped = pedigree.select("ingest_id", F.col("sample_id").alias("proband"), "father_id", "mother_id", *carried).dropDuplicates(["ingest_id", "proband", "father_id", "mother_id"])
    roles = F.array(*(F.struct(F.lit(r).alias("role"), F.col(c).alias("sample_id")) for r, c in zip(ROLES, ("proband", "father_id", "mother_id"), strict=True)))
    members = ped.select("ingest_id", "proband", *carried, F.explode(roles).alias("x")).select("ingest_id", "proband", *carried, "x.role", "x.sample_id")
    own = genotypes.join(small(members), ["ingest_id", "sample_id"])
    of = lambda r, c: F.max(F.when(F.col("role") == r, F.col(c))).alias(f"{r}_{c}")
    wide = own.groupBy("proband", *KEY).agg(*(of(r, c) for r in ROLES for c in FIELDS), *(F.max(c).alias(c) for c in carried)).where("g_gt is not null")
    if variants is not None:
        wide = wide.join(variants.select(*KEY, "info_AF", "filter"), KEY, "left")
    return wide


def gates(min_gq: int = 20, min_dp: int = 10, min_ab: float | None = 0.25, max_ab: float = 0.75, max_af: float | None = 0.01, pass_only: bool = False, strict: bool = False, parent_alt_share: float | None = None) -> dict[str, Column]:
    """The named gates of a trio row, in the order in which a funnel applies them."""
    out = {f"quality_{r}": P.quality(f"{r}_", min_gq, min_dp, strict) for r in ROLES}
    if min_ab is not None:
        out["allele_balance"] = P.allele_balance("g_", min_ab, max_ab)
    if parent_alt_share is not None:
        out["parent_reads"] = P.trusted_ref("f_", parent_alt_share) & P.trusted_ref("m_", parent_alt_share)
    if max_af is not None:
        out["rarity"] = P.rare(F.col("info_AF"), max_af)
    if pass_only:
        out["passed"] = P.passed(F.col("filter"))
    return out


def _all(terms) -> Column:
    out = F.lit(True)
    for t in terms:
        out = out & t
    return out


def candidates(rows: DataFrame, model: str, **limits) -> DataFrame:
    """Sites of all trios that fit a model and pass its gates."""
    return rows.where(fits(model)).where(_all(gates(**limits).values())).select("proband", *SITE, "g_gt", "f_gt", "m_gt", F.col("info_AF").alias("af"))


def strict_missing_dropped(rows: DataFrame, model: str, **limits) -> DataFrame:
    """What passes only because a measure is unknown, by trio."""
    loose, strict = _all(gates(**limits).values()), _all(gates(**limits, strict=True).values())
    return rows.where(fits(model)).where(loose & ~strict).groupBy("proband").agg(F.count("*").alias("dropped"))


def funnel(rows: DataFrame, model: str, **limits) -> DataFrame:
    """How many sites of each trio remain after each gate, in one aggregation."""
    named, so_far, counts = gates(**limits), F.lit(True), [F.count("*").alias("model")]
    for name, gate in named.items():
        so_far = so_far & gate
        counts.append(F.count_if(so_far).alias(name))
    return rows.where(fits(model)).groupBy("proband").agg(*counts)


def compound_het(rows: DataFrame, genes: DataFrame, **limits) -> DataFrame:
    """Genes of each trio hit by a paternal and a maternal variant, with the variants of each; a site in several genes counts for each."""
    hits = candidates(rows, "dominant", **limits).withColumn("origin", F.when(F.col("f_gt") > 0, "paternal").otherwise("maternal"))
    return _both_origins(hits, genes)


def _both_origins(hits: DataFrame, genes: DataFrame) -> DataFrame:
    placed = containing(hits, genes.select("gene_symbol", "chrom", "start_pos", "end_pos"))
    count = lambda o: F.count_if(F.col("origin") == o)
    listed = F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "chrom", "pos", "ref", "alt", "origin"))), ",")
    return placed.groupBy("proband", "gene_symbol").agg(count("paternal").alias("paternal"), count("maternal").alias("maternal"), listed.alias("variants")).where("paternal > 0 and maternal > 0")


def population_rare(rows: DataFrame, population: DataFrame, most: float) -> DataFrame:
    """Rows whose group-maximum frequency (else the overall one) is at most so much; absent or unknown frequencies stay."""
    af = population.select(P.canonical_contig(F.col("chrom")).alias("__c"), F.col("pos").alias("__p"), F.col("ref").alias("__r"), F.col("alt").alias("__a"), F.coalesce("af_grpmax", "af").alias("popmax"))
    on = (P.canonical_contig(F.col("chrom")) == F.col("__c")) & (F.col("pos") == F.col("__p")) & (F.col("ref") == F.col("__r")) & (F.col("alt") == F.col("__a"))
    return rows.join(af, on, "left").where(P.rare(F.col("popmax"), most)).drop("__c", "__p", "__r", "__a")


def annotated(rows: DataFrame, genes: DataFrame, clinvar: DataFrame) -> DataFrame:
    """Rows with their genes (comma-joined) and clinical significance."""
    sites = rows.select(*SITE).distinct()
    named = containing(sites, genes.select("gene_symbol", "chrom", "start_pos", "end_pos")).groupBy(*SITE).agg(F.array_join(F.array_sort(F.collect_set("gene_symbol")), ",").alias("genes"))
    return rows.join(named, SITE, "left").join(clinvar.select(*SITE, "clin_sig").dropDuplicates(SITE), SITE, "left")


# X-linked inheritance on the non-PAR X. Name, sex, mode, allowed genotypes of proband, father and
# mother (None: any, also no call), in order of precedence; the parents whose 0/0 may carry few ALT reads only, and
# those that transmit the allele.
X_PATTERNS: tuple[tuple, ...] = (
    ("xlr_son", "male", "recessive", (2,), None, (1,), "", "m"),
    ("x_denovo_son", "male", "denovo", (2,), None, (0,), "m", ""),
    ("xlr_hom_daughter", "female", "recessive", (2,), (2,), (1,), "", "fm"),
    ("xhet_paternal", "female", "female_het", (1,), (2,), (0,), "", "f"),
    ("xhet_maternal", "female", "female_het", (1,), (0,), (1, 2), "", "m"),
    ("x_denovo_daughter", "female", "denovo", (1,), (0,), (0,), "fm", ""),
    ("x_denovo_daughter_mat", "female", "denovo", (2,), (2,), (0,), "m", ""),
    ("x_denovo_daughter_pat", "female", "denovo", (2,), (0,), (1, 2), "f", ""),
)
#: Genotypes that no pattern has: artefacts on a single X come before the patterns, what is left behind them.
X_ARTEFACTS = (("male_het", "male", (1,), None, None), ("father_het", "female", (1, 2), (1,), None))
X_OTHERS = (
    ("consistent_unpatterned", "male", (2,), None, (2,)), ("consistent_unpatterned", "female", (1,), (2,), (1,)), ("consistent_unpatterned", "female", (2,), (2,), (2,)),
    ("mendel_error_other", "female", (1, 2), (0, 1, 2), (0, 1, 2)),
)
# Limits of the X model.
X_LIMITS = {"min_gq": 20, "min_dp": 10, "min_ab": 0.25, "max_ab": 0.75, "max_af": 0.01, "max_af_x": 0.001, "min_hemi_ab": 0.75, "max_parent_alt_reads": 1}


def x_class() -> Column:
    """The X-linked class of a trio row on the non-PAR X, NULL where it can't be told."""
    out = F.lit(None).cast("string")
    for name, sex, *allowed in reversed([*X_ARTEFACTS, *((p[0], p[1], *p[3:6]) for p in X_PATTERNS), *X_OTHERS]):
        out = F.when((F.col("sex") == sex) & _all(_among(F.col(f"{r}_gt"), own) for r, own in zip(ROLES, allowed, strict=True)), name).otherwise(out)
    return out


def x_linked(rows: DataFrame, build: str = "unknown") -> DataFrame:
    """Trio rows of the non-PAR X with their class."""
    return rows.where(P.non_par_x(build)).withColumn("x_class", x_class())


def x_linked_counts(rows: DataFrame, build: str = "unknown") -> DataFrame:
    return x_linked(rows, build).where("x_class is not null").groupBy("proband", "x_class").agg(F.count("*").alias("n"))


def x_gates(min_gq: int, min_dp: int, min_ab: float, max_ab: float, max_af: float, max_af_x: float, min_hemi_ab: float, max_parent_alt_reads: int, min_male_x_dp: int | None = None, pass_only: bool = False) -> Column:
    """The gates of the X model: a hemizygous call has half the depth (or min_male_x_dp), a father counts for daughters only, the lower rarity limit holds."""
    single = min_dp // 2 if min_male_x_dp is None else min_male_x_dp
    son = F.col("sex") == "male"
    depth = F.when(son, P.quality("g_", min_gq, single)).otherwise(P.quality("g_", min_gq, min_dp) & P.quality("f_", min_gq, single))
    good = depth & P.quality("m_", min_gq, min_dp) & P.allele_balance("g_", min_ab, max_ab) & P.allele_balance("m_", min_ab, max_ab)
    good = good & (~son | P.hemizygous_balance("g_", min_hemi_ab)) & P.rare(F.col("info_AF"), min(max_af, max_af_x))
    return good & P.passed(F.col("filter")) if pass_only else good


def x_linked_candidates(rows: DataFrame, build: str = "unknown", affected: DataFrame | None = None, **limits) -> DataFrame:
    """Sites of a named pattern that pass its gates, with its mode; X_LIMITS hold where no others are given.

    A parent whose 0/0 a pattern rests on has max_parent_alt_reads ALT reads at most; where the cap fails the site is
    no candidate. affected (proband, g, f, m as booleans): female_het is told as dominant if the proband and all
    transmitting parents are affected.
    """
    limits = X_LIMITS | limits
    table = {p[0]: p for p in X_PATTERNS}
    of = lambda i: F.element_at(F.create_map(*(x for k, p in table.items() for x in (F.lit(k), F.lit(p[i])))), F.col("x_class"))
    capped = _all(~F.contains(of(6), F.lit(r)) | F.col(f"{r}_ad_alt").isNull() | (F.col(f"{r}_ad_alt") <= limits["max_parent_alt_reads"]) for r in "fm")
    found = x_linked(rows, build).where(F.col("x_class").isin(*table)).where(capped & x_gates(**limits))
    mode = of(2)
    if affected is not None:
        found = found.join(small(affected.select("proband", *(F.col(r).alias(f"__{r}") for r in ROLES))), "proband", "left")
        carried = _all(~F.contains(of(7), F.lit(r)) | F.coalesce(F.col(f"__{r}"), F.lit(False)) for r in "fm")
        mode = F.when((mode == "female_het") & F.coalesce(F.col("__g"), F.lit(False)) & carried, "dominant").otherwise(mode)
    father = F.when(F.col("sex") == "male", F.when(F.col("f_gt") == 2, "hemizygous_alt").when(F.col("f_gt") == 1, "anomalous_het"))
    return found.select("proband", *SITE, "x_class", mode.alias("mode"), father.alias("father_flag"))


def x_guarded(rows: DataFrame, build: str = "unknown") -> DataFrame:
    """Trio rows without those that a single X forbids: on the non-PAR X a heterozygous father, or a heterozygous male proband."""
    impossible = F.coalesce(F.col("f_gt") == 1, F.lit(False)) | ((F.col("sex") == "male") & (F.col("g_gt") == 1))
    return rows.where(~(P.non_par_x(build) & F.coalesce(impossible, F.lit(False))))


def x_compound_het(rows: DataFrame, genes: DataFrame, build: str = "unknown", **limits) -> DataFrame:
    """Genes of each daughter hit on the non-PAR X by a variant of her father's (hemizygous) and one of her mother's, under the X model's gates."""
    paternal, maternal = (F.col("f_gt") == 2) & (F.col("m_gt") == 0), (F.col("f_gt") == 0) & (F.col("m_gt") > 0)
    hits = rows.where(P.non_par_x(build) & (F.col("sex") == "female") & (F.col("g_gt") == 1)).where(x_gates(**(X_LIMITS | limits)))
    return _both_origins(hits.withColumn("origin", F.when(paternal, "paternal").when(maternal, "maternal")).where("origin is not null"), genes)


SEXES = ("male", "female")


def resolved_sexes(members: DataFrame) -> DataFrame:
    """The sex that each member of a trio is analysed as, where it comes from, and what speaks against it.

    members: proband, sample_id, role (proband, father, mother), declared, inferred (male, female, ambiguous, unknown)
    and, for probands, transmitted. The pedigree comes first, then a sure inference (for a proband only if X
    transmission doesn't contradict it), for a parent the role. A parent against whose role either one speaks blocks
    the trio; so does a proband of unknown sex.
    """
    declared, sure = (F.when(F.col(c).isin(*SEXES), F.col(c)) for c in ("declared", "inferred"))
    role = F.when(F.col("role") == "father", "male").when(F.col("role") == "mother", "female")
    doubted = role.isNull() & F.col("transmitted").isNotNull() & (F.col("transmitted") != sure)
    believed = F.when(~F.coalesce(doubted, F.lit(False)), sure)
    sex = F.coalesce(declared, believed, role)
    source = F.when(declared.isNotNull(), "pedigree").when(believed.isNotNull(), "inferred").when(role.isNotNull(), "role")
    against = F.coalesce(declared != role, F.lit(False)) | F.coalesce(sure != role, F.lit(False))
    warning = F.when(F.coalesce(declared != sure, F.lit(False)), "sex_conflict").when((declared.isNull() & F.coalesce(doubted, F.lit(False))) | ((F.col("inferred") == "ambiguous") & (role.isNotNull() | declared.isNull())), "sex_ambiguous")
    blocked = F.when(against, "parent_sex_conflict").when(role.isNull() & sex.isNull(), "needs_sex")
    told = members.withColumns({"sex": sex, "source": source, "warning": warning, "__blocked": blocked})
    # a conflict of a parent is told before a proband's unknown sex
    whole = F.max("__blocked").over(Window.partitionBy("proband"))
    return told.withColumn("blocked_reason", whole).select("proband", "sample_id", "role", "sex", "source", "warning", "blocked_reason")


def transmitted_sex(rows: DataFrame, build: str = "unknown", least: int = 5) -> DataFrame:
    """Sex told by X transmission: at sites where the father has the ALT and the mother hasn't, daughters carry it."""
    informative = rows.where(P.non_par_x(build) & (F.col("f_gt") == 2) & (F.col("m_gt") == 0) & F.col("g_gt").isin(0, 1))
    share = F.avg((F.col("g_gt") == 1).cast("double"))
    told = F.when(F.count("*") < least, "unknown").when(share >= 0.75, "female").when(share <= 0.25, "male").otherwise("ambiguous")
    return informative.groupBy("proband").agg(F.count("*").alias("informative"), share.alias("carried"), told.alias("transmitted_sex"))


def reference_rows(genotypes: DataFrame) -> DataFrame:
    """Samples with stored reference calls, without which no de novo can be told."""
    return genotypes.groupBy("ingest_id", "sample_id").agg(F.count_if(F.col("gt") == 0).alias("n_ref"))


def cohort_derived_af(variants: DataFrame, genotypes: DataFrame, samples: DataFrame) -> DataFrame:
    """Whether stored frequencies look as if computed from this cohort: close to ac/an at 90 % of 20 sites or more."""
    an = samples.groupBy("ingest_id").agg((2 * F.countDistinct("sample_id")).alias("an"))
    ac = genotypes.groupBy(*KEY).agg(F.sum("gt").alias("ac"))
    r = F.col("ac") / F.col("an")
    close = F.abs(F.col("info_AF") - r) <= F.when(r >= 0.01, 0.01 * r).otherwise(F.lit(0.0)) + 0.0005
    told = variants.where("info_AF is not null").join(ac, KEY).join(F.broadcast(an), "ingest_id").where("ac > 0")
    return told.groupBy("ingest_id").agg(F.count("*").alias("sites"), F.count_if(close).alias("close")).withColumn("suspected", (F.col("sites") >= 20) & (F.col("close") >= 0.9 * F.col("sites")))


#: A gate binds where its field is known in this share of the rows that it judges.
BOUND = 0.9
#: A proband's median depth below this many times the least depth is thin coverage.
THIN = 1.5
#: A population table binds if it has a frequency for this share of a sample of so many variants.
LEAST_HITS, PROBED = 0.1, 5000


def _state(known: Column, n: Column, bound: float = BOUND) -> Column:
    share = F.try_divide(known.cast("double"), n)
    return F.when(share >= 1, "bound").when(share >= bound, "partial").otherwise("unbound")


def gate_presence(rows: DataFrame, model: str, bound: float = BOUND) -> DataFrame:
    """For each gated field of a model's candidate rows, in how many it is known and whether the gate binds, told by trio and role.

    Quality is asked of every row, allele balance of heterozygous probands, ALT reads of the parents' 0/0.
    """
    own = rows.where(fits(model))
    asked: dict[str, tuple[Column, Column]] = {f"{r}_{c}": (F.lit(True), F.col(f"{r}_{c}").isNotNull()) for r in ROLES for c in ("gq", "dp")}
    depths = lambda r: F.col(f"{r}_ad_ref").isNotNull() & F.col(f"{r}_ad_alt").isNotNull()
    asked["g_ab"] = (F.col("g_gt") == 1, depths("g"))
    asked |= {f"{r}_alt_reads": (F.col(f"{r}_gt") == 0, depths(r)) for r in "fm"}
    counts = own.groupBy("proband").agg(*(x for k, (of, known) in asked.items() for x in (F.count_if(of).alias(f"n_{k}"), F.count_if(of & known).alias(k))))
    long = counts.select("proband", F.explode(F.array(*(F.struct(F.lit(k).alias("field"), F.col(k).alias("known"), F.col(f"n_{k}").alias("n")) for k in asked))).alias("x"))
    return long.select("proband", "x.*").where("n > 0").withColumn("state", _state(F.col("known"), F.col("n"), bound))


def effective_gates(rows: DataFrame, models: tuple[str, ...], least_dp: int = 10, bound: float = BOUND) -> DataFrame:
    """By trio and field, over some models: the weakest share in which it is known, and whether its gate binds there; also thin coverage."""
    every = None
    for m in models:
        own = gate_presence(rows, m, bound).withColumn("kind", F.regexp_replace("field", "^[gfm]_", ""))
        every = own if every is None else every.unionByName(own)
    share = F.col("known") / F.col("n")
    weakest = every.groupBy("proband", "kind").agg(F.min(share).alias("share")).withColumn("state", _state(F.col("share"), F.lit(1), bound))
    depth = rows.where("g_gt > 0").groupBy("proband").agg(F.percentile("g_dp", 0.5).alias("depth"))
    return weakest.join(depth, "proband").withColumn("thin_coverage", F.coalesce(F.col("depth") < THIN * least_dp, F.lit(False))).drop("depth")


def sampled_sites(variants: DataFrame, most: int = PROBED) -> DataFrame:
    """About so many sites of each ingestion, the same ones on every run: positions that a stride divides; all if there are few."""
    sized = variants.groupBy("ingest_id").agg(F.count("*").alias("__n")).withColumn("__stride", F.greatest(F.lit(1), F.ceil(F.col("__n") / most)))
    return variants.join(small(sized), "ingest_id").where(F.pmod("pos", "__stride") == 0).select(*KEY).distinct()


def population_binding(variants: DataFrame, population: DataFrame, most: int = PROBED) -> DataFrame:
    """Whether a population table can judge an ingestion's variants: the share of a sample for which it has a frequency."""
    keys = sampled_sites(variants, most).withColumn("__c", P.canonical_contig(F.col("chrom")))
    known = population.where(F.coalesce("af_grpmax", "af").isNotNull()).select(P.canonical_contig(F.col("chrom")).alias("__c"), "pos", "ref", "alt").distinct().withColumn("__known", F.lit(1))
    out = keys.join(known, ["__c", "pos", "ref", "alt"], "left").groupBy("ingest_id").agg(F.count("*").alias("sampled"), F.count("__known").alias("judged"))
    return out.withColumn("binds", F.col("judged") >= LEAST_HITS * F.col("sampled"))


def af_gate_state(derived: DataFrame, asked_for: bool) -> DataFrame:
    """What becomes of the frequency gate of each ingestion, from cohort_derived_af: a frequency that is the cohort's own isn't used unless a limit was asked for."""
    state = F.when(F.col("sites") == 0, "unavailable").when(~F.col("suspected"), "applied").otherwise("cohort_derived_suspected" if asked_for else "skipped_cohort_derived")
    return derived.select("ingest_id", "sites", "close", state.alias("state"))


def parent_reads(rows: DataFrame, listed: DataFrame) -> DataFrame:
    """The parents' reads at the listed sites (proband, chrom, pos, ref, alt)."""
    return rows.join(listed.select("proband", *SITE).distinct(), ["proband", *SITE], "left_semi").select("proband", *SITE, *(f"{r}_{c}" for r in "fm" for c in ("gt", "ad_ref", "ad_alt")))


# Named sets of limits. Fixed values.
PRESETS: dict[str, dict] = {
    "broad-first-pass": {"models": ("denovo", "recessive", "dominant", "comphet", "xlinked"), "min_gq": 15, "min_dp": 8, "min_ab": 0.20, "max_ab": 0.80, "max_af": 0.01, "gnomad_max_af": 0.01},
    "strict-denovo": {"models": ("denovo",), "min_gq": 30, "min_dp": 20, "min_ab": 0.30, "max_ab": 0.70, "max_af": 0.001, "gnomad_max_af": 0.0001, "strict": True, "pass_only": True, "parent_alt_share": 0.05},
    "rare-recessive": {"models": ("recessive", "comphet", "xlinked"), "min_gq": 20, "min_dp": 10, "min_ab": 0.25, "max_ab": 0.75, "max_af": 0.01, "gnomad_max_af": 0.01},
    "rare-dominant": {"models": ("dominant", "denovo"), "min_gq": 25, "min_dp": 12, "min_ab": 0.25, "max_ab": 0.75, "max_af": 0.001, "gnomad_max_af": 0.0001},
}


def preset(rows: DataFrame, name: str, genes: DataFrame, population: DataFrame | None = None, build: str = "unknown", **changes) -> DataFrame:
    """proband, site, model of all candidates of a preset; explicit limits win over it.

    A site absent from the population table, or without a frequency there, is rare. The X guard holds for the models of
    two copies. Compound-het candidates are told with their gene (NULL for the other models).
    """
    limits = PRESETS[name] | changes
    models, most = limits.pop("models"), limits.pop("gnomad_max_af")
    if population is not None and most is not None:
        rows = population_rare(rows, population, most)
    autosomal, gene = x_guarded(rows, build), F.lit(None).cast("string").alias("gene_symbol")
    parts = [candidates(autosomal, m, **limits).select("proband", *SITE, F.lit(m).alias("model"), gene) for m in models if m in MODELS]
    if "comphet" in models:
        pairs = compound_het(autosomal, genes, **limits).select("proband", "gene_symbol", F.explode(F.split("variants", ",")).alias("v")).withColumn("v", F.split("v", ":"))
        parts.append(pairs.select("proband", F.get("v", 0).alias("chrom"), F.get("v", 1).cast("long").alias("pos"), F.get("v", 2).alias("ref"), F.get("v", 3).alias("alt"), F.lit("comphet").alias("model"), "gene_symbol"))
    if "xlinked" in models:
        own = {k: v for k, v in limits.items() if k in X_LIMITS or k in ("min_male_x_dp", "pass_only")}
        parts.append(x_linked_candidates(rows, build, **own).select("proband", *SITE, F.lit("xlinked").alias("model"), gene))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def on_pedigree(pedigree: DataFrame) -> DataFrame:
    """Declared relations: each child with its parents, and pairs of full and half siblings."""
    child = pedigree.select("ingest_id", "sample_id", "father_id", "mother_id")
    parents = child.select("ingest_id", "sample_id", F.explode(F.array("father_id", "mother_id")).alias("other")).where("other <> '0'").withColumn("relation", F.lit("parent-child"))
    a, b = child.alias("a"), child.alias("b")
    same = lambda c: (F.col(f"a.{c}") == F.col(f"b.{c}")) & (F.col(f"a.{c}") != "0")
    sibs = a.join(b, (F.col("a.ingest_id") == F.col("b.ingest_id")) & (F.col("a.sample_id") < F.col("b.sample_id")) & same("father_id")).select("a.ingest_id", F.col("a.sample_id"), F.col("b.sample_id").alias("other"), F.lit(1).alias("n"))
    sibs = sibs.unionByName(a.join(b, (F.col("a.ingest_id") == F.col("b.ingest_id")) & (F.col("a.sample_id") < F.col("b.sample_id")) & same("mother_id")).select("a.ingest_id", F.col("a.sample_id"), F.col("b.sample_id").alias("other"), F.lit(1).alias("n")))
    kinds = sibs.groupBy("ingest_id", "sample_id", "other").agg(F.sum("n").alias("n")).select("ingest_id", "sample_id", "other", F.when(F.col("n") == 2, "full-siblings").otherwise("half-siblings").alias("relation"))
    return parents.unionByName(kinds)


