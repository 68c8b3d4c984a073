"""Variant call text files, read and written with DataFrame functions only.

Lines are split where Spark splits text files; a sample column becomes a row only if it carries something. Records with
several ALT alleles must be split beforehand (or with `split_multi`), as the tables hold one ALT a row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.cohort import KEY
from ..operators.predicates import contig_order

# INFO fields with a column of their own, by type, and FORMAT fields by shape.
INFO_LONG = ("AC", "AN", "DP", "MQ0", "NS", "END", "MLEAC", "HAPCOMP")
INFO_DOUBLE = ("AF", "MQ", "BQ", "SB", "QD", "FS", "SOR", "MQRankSum", "ReadPosRankSum", "ExcessHet", "InbreedingCoeff", "MLEAF", "BaseQRankSum", "ClippingRankSum", "FractionInformativeReads", "HAPDOM", "DragenSnvHardQUAL", "DragenIndelHardQUAL")
INFO_TEXT = ("CIGAR", "AA")
INFO_FLAGS = ("SOMATIC", "VALIDATED", "DB", "H2", "H3", "1000G")
FORMAT_INT = ("GQ", "DP", "MQ", "PQ")
FORMAT_PAIRS = ("AD", "ADF", "ADR")
FORMAT_TRIPLES = ("PL", "GL")
MOST_INT, MOST_PS = 65_535, 4_294_967_295


def header_samples(spark: SparkSession, path: str) -> list[str]:
    """The sample names of the column line."""
    line = spark.read.text(path).where(F.col("value").startswith("#CHROM")).first()
    if line is None:
        raise ValueError(f"{path} has no column line")
    return line.value.split("\t")[9:]


def header_fields(spark: SparkSession, path: str) -> DataFrame:
    """kind (INFO or FORMAT), id, number, type, description and the column that stores the field (NULL: the overflow map)."""
    lines = spark.read.text(path).where(F.col("value").rlike("^##(INFO|FORMAT)="))
    part = lambda p: F.regexp_extract("value", p, 1)
    typed = {f"INFO {x}": f"info_{x}" for x in (*INFO_LONG, *INFO_DOUBLE, *INFO_TEXT, *INFO_FLAGS)} | {f"FORMAT {x}": x.lower() for x in ("GT", "FT", "PS", *FORMAT_INT, *FORMAT_PAIRS, *FORMAT_TRIPLES)}
    out = lines.select(part("^##(INFO|FORMAT)").alias("kind"), part("[<,]ID=([^,>]+)").alias("id"), part("Number=([^,>]+)").alias("number"), part("Type=([^,>]+)").alias("type"), part('Description="([^"]*)"').alias("description"))
    stored = F.create_map(*(x for k, v in typed.items() for x in (F.lit(k), F.lit(v))))
    return out.withColumn("stored_as", F.try_element_at(stored, F.concat_ws(" ", "kind", "id")))


def _records(spark: SparkSession, path: str) -> DataFrame:
    cells = F.split("value", "\t")
    lines = spark.read.text(path).where(~F.col("value").startswith("#") & (F.length("value") > 0)).select(cells.alias("c"))
    null = lambda c: F.when(~c.isin(".", ""), c)
    at = lambda i: F.get("c", i)
    return lines.select(
        at(0).alias("chrom"), at(1).cast("long").alias("pos"), null(at(2)).alias("vcf_id"), at(3).alias("ref"), at(4).alias("alt"), null(at(5)).cast("float").alias("qual"),
        F.when(~at(6).isin("PASS", ".", ""), at(6)).alias("filter"), F.when(at(7) == ".", F.lit("")).otherwise(at(7)).alias("info"), F.split(F.coalesce(at(8), F.lit("")), ":").alias("keys"),
        F.slice("c", F.lit(10), F.greatest(F.size("c") - 9, F.lit(0))).alias("cells"),
    )


def split_multi(records: DataFrame) -> DataFrame:
    """A row for each ALT; alleles of other ALTs count as missing in its genotypes."""
    out = records.select("*", F.posexplode(F.split("alt", ",")).alias("__i", "__alt"))
    remap = lambda g: F.when(g.isin("0", "."), g).when(g == (F.col("__i") + 1).cast("string"), "1").otherwise(".")

    def cell(x: Column) -> Column:
        gt, rest = F.substring_index(x, ":", 1), F.regexp_replace(x, "^[^:]*", "")
        mapped = F.transform(F.split(gt, "[/|]"), remap)
        return F.concat(F.when(gt.contains("|"), F.array_join(mapped, "|")).otherwise(F.array_join(mapped, "/")), rest)

    return out.withColumn("cells", F.transform("cells", cell)).withColumn("alt", F.col("__alt")).drop("__i", "__alt")


def _clamped(c: Column, most: int = MOST_INT) -> Column:
    n = c.try_cast("long")
    return F.when(n >= 0, F.least(n, F.lit(most)))


def read_vcf(spark: SparkSession, path: str, ingest_id: str, cohort: str = "default", keep_reference: bool = False, record_missing: bool = True, multi: bool = False) -> dict[str, DataFrame]:
    """variants, genotypes, missing_genotypes, samples and ingestions of a file.

    gt is 1 for a heterozygous (or half-called ALT) genotype, 2 for homozygous or haploid ALT, 0 for reference calls
    (stored only if asked for). n_called, an_called and ac_called count whole genotypes, alleles and ALT alleles.
    """
    names = header_samples(spark, path)
    records = _records(spark, path)
    if multi:
        records = split_multi(records)
    else:
        records = records.withColumn("alt", F.when(F.col("alt").contains(",") | F.col("alt").isin(".", ""), F.raise_error(F.concat(F.lit("one ALT is needed at "), "chrom", F.lit(":"), F.col("pos").cast("string")))).otherwise(F.col("alt")))
    records = records.withColumn("ingest_id", F.lit(ingest_id))
    genotype = lambda x: F.split(F.substring_index(x, ":", 1), "[/|]")
    alleles = F.transform("cells", genotype)
    n = lambda f: F.aggregate(alleles, F.lit(0).cast("long"), lambda a, g: a + f(g))
    flags = F.filter(F.split("info", ";"), lambda x: ~x.contains("=") & (x != ""))
    pairs = F.transform(F.filter(F.split("info", ";"), lambda x: x.contains("=")), lambda x: F.struct(F.split_part(x, F.lit("="), F.lit(1)).alias("key"), F.regexp_replace(x, "^[^=]*=", "").alias("value")))
    mapped = records.withColumn("m", F.map_from_entries(pairs)).withColumn("flags", flags)
    value = lambda k: F.when(F.try_element_at("m", F.lit(k)) != ".", F.try_element_at("m", F.lit(k)))
    known = (*INFO_LONG, *INFO_DOUBLE, *INFO_TEXT)
    depth = F.split(value("AD"), ",")
    extra = F.map_concat(F.map_filter("m", lambda k, v: ~k.isin(*known, "AD")), F.map_from_entries(F.transform(F.filter("flags", lambda x: ~x.isin(*INFO_FLAGS)), lambda x: F.struct(x.alias("key"), F.lit("").alias("value")))))
    variants = mapped.select(
        *KEY, "vcf_id", "qual", "filter", *(value(k).try_cast("long").alias(f"info_{k}") for k in INFO_LONG), *(value(k).try_cast("float").alias(f"info_{k}") for k in INFO_DOUBLE), *(value(k).alias(f"info_{k}") for k in INFO_TEXT),
        F.get(depth, 0).try_cast("long").alias("info_AD_ref"), F.get(depth, 1).try_cast("long").alias("info_AD_alt"), *(F.array_contains("flags", k).cast("short").alias(f"info_{k}") for k in INFO_FLAGS), extra.alias("info_extra"),
        n(lambda g: (F.size(F.filter(g, lambda a: a == ".")) == 0).cast("long")).alias("n_called"), n(lambda g: F.size(F.filter(g, lambda a: a != ".")).cast("long")).alias("an_called"), n(lambda g: F.size(F.filter(g, lambda a: a == "1")).cast("long")).alias("ac_called"),
    )
    name = F.element_at(F.array(*(F.lit(x) for x in names)), F.col("i") + 1) if names else F.lit(None).cast("string")
    calls = records.select(*KEY, "keys", F.posexplode("cells").alias("i", "cell")).select(*KEY, "keys", name.alias("sample_id"), "cell", F.split("cell", ":").alias("values"), F.substring_index("cell", ":", 1).alias("g"))
    calls = calls.withColumn("a", F.split("g", "[/|]")).withColumns({"n_alt": F.size(F.filter("a", lambda x: x == "1")), "n_gone": F.size(F.filter("a", lambda x: x == ".")), "n": F.size("a")})
    gone = calls.where("n_gone = n").select(*KEY, "sample_id")
    gt = F.when((F.col("n_alt") == F.col("n")) & (F.col("n_gone") == 0), 2).when(F.col("n_alt") > 0, 1).when(F.col("n_gone") == 0, 0)
    kept = calls.withColumn("gt", gt).where("gt > 0" if not keep_reference else "gt is not null")
    fields = F.map_filter(F.map_from_entries(F.transform("keys", lambda k, i: F.struct(k.alias("key"), F.get("values", i).alias("value")))), lambda k, v: v.isNotNull() & (v != ".") & (k != "GT"))
    f = kept.withColumn("f", fields)
    one = lambda k: F.try_element_at("f", F.lit(k))
    many = lambda k, i: F.get(F.split(one(k), ","), i)
    triple = ("ref_ref", "ref_alt", "alt_alt")
    genotypes = f.select(
        *KEY, "sample_id", F.col("gt").cast("byte").alias("gt"), F.col("g").contains("|").cast("short").alias("phased"), *(_clamped(one(k)).cast("int").alias(k.lower()) for k in FORMAT_INT),
        *(_clamped(many(k, i)).cast("int").alias(f"{k.lower()}_{s}") for k in FORMAT_PAIRS for i, s in enumerate(("ref", "alt"))), *(_clamped(many("PL", i)).cast("int").alias(f"pl_{s}") for i, s in enumerate(triple)),
        *(many("GL", i).try_cast("float").alias(f"gl_{s}") for i, s in enumerate(triple)), one("FT").alias("ft"), _clamped(one("PS"), MOST_PS).alias("ps"),
        F.map_filter("f", lambda k, v: ~k.isin("FT", "PS", *FORMAT_INT, *FORMAT_PAIRS, *FORMAT_TRIPLES)).alias("format_extra"),
    )
    samples = spark.createDataFrame([(ingest_id, s, cohort) for s in names], "ingest_id string, sample_id string, cohort string")
    ingestion = variants.agg(F.count("*").alias("n_variants")).select(F.lit(ingest_id).alias("ingest_id"), F.lit(cohort).alias("cohort"), F.lit(path).alias("vcf_path"), "n_variants", F.lit(len(names)).cast("long").alias("n_samples"))
    return {"variants": variants, "genotypes": genotypes, "missing_genotypes": gone if record_missing else gone.limit(0), "samples": samples, "ingestions": ingestion}


def read_batch(spark: SparkSession, manifest: str, **options) -> dict[str, DataFrame]:
    """The tables of all files of a manifest: lines of vcf_path, ingest_id and (if told) cohort, separated by tabs."""
    cells = F.split("value", "\t")
    lines = spark.read.text(manifest).where(~F.col("value").startswith("#") & (F.trim("value") != "")).select(*(F.trim(F.get(cells, i)).alias(c) for i, c in enumerate(("path", "ingest_id", "cohort"))))
    files = [r for r in lines.collect() if r.path != "vcf_path"]  # one row a file
    if repeated := {r.ingest_id for r in files if sum(x.ingest_id == r.ingest_id for x in files) > 1}:
        raise ValueError(f"repeated ingestions: {', '.join(sorted(repeated))}")
    out: dict[str, DataFrame] = {}
    for r in files:
        for name, df in read_vcf(spark, r.path, r.ingest_id, r.cohort or "default", **options).items():
            out[name] = out[name].unionByName(df) if name in out else df
    return out


def verified(spark: SparkSession, path: str, tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The tables, if they hold a variant for every ALT allele of the file's records; else an error."""
    records = _records(spark, path).agg(F.sum(F.size(F.split("alt", ","))).alias("n")).first().n or 0
    if (found := tables["variants"].count()) != records:
        raise ValueError(f"{path} has {records} ALT alleles, {found} were read")
    return tables


def clamped(spark: SparkSession, path: str) -> DataFrame:
    """field and how many of its values are beyond the largest that is stored, of the FORMAT fields that have any."""
    cells = _records(spark, path).select("keys", F.explode("cells").alias("cell")).select("keys", F.split("cell", ":").alias("values"))
    one = cells.select(F.posexplode("keys").alias("i", "field"), "values").select("field", F.explode(F.split(F.coalesce(F.get("values", F.col("i")), F.lit("")), ",")).alias("v"))
    most = F.when(F.col("field") == "PS", MOST_PS).otherwise(MOST_INT)
    return one.where(F.col("field").isin(*FORMAT_INT, *FORMAT_PAIRS, "PL", "PS") & (F.col("v").try_cast("long") > most)).groupBy("field").agg(F.count("*").alias("n"))


def _info(columns: list[str]) -> Column:
    """The INFO text of a variant row: typed fields, flags, then what overflowed, by name."""
    typed = [F.concat(F.lit(f"{k}="), F.col(f"info_{k}").cast("string")) for k in (*INFO_LONG, *INFO_DOUBLE, *INFO_TEXT) if f"info_{k}" in columns]
    flags = [F.when(F.col(f"info_{k}") == 1, k) for k in INFO_FLAGS if f"info_{k}" in columns]
    extra = F.transform(F.array_sort(F.map_entries("info_extra")), lambda e: F.when(e["value"] == "", e["key"]).otherwise(F.concat_ws("=", e["key"], e["value"]))) if "info_extra" in columns else F.array().cast("array<string>")
    every = F.concat(F.array_compact(F.array(*typed, *flags)) if typed or flags else F.array().cast("array<string>"), F.coalesce(extra, F.array().cast("array<string>")))
    return F.when(F.size(every) > 0, F.array_join(every, ";")).otherwise(".")


def to_vcf_lines(variants: DataFrame, genotypes: DataFrame, missing: DataFrame, samples: list[str]) -> DataFrame:
    """chrom, pos, ref, alt and the text line of each variant with GT:GQ:DP:AD of the samples; absent calls are 0/0, missing ones ./. ."""
    dot = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("."))
    gt = F.when(F.col("gt") == 2, "1/1").when(F.col("gt") == 1, "0/1").otherwise("0/0")
    if "phased" in genotypes.columns:
        gt = F.when(F.col("phased") == 1, F.replace(gt, F.lit("/"), F.lit("|"))).otherwise(gt)
    depth = F.when(F.col("ad_ref").isNotNull() & F.col("ad_alt").isNotNull(), F.concat_ws(",", "ad_ref", "ad_alt")).otherwise(".")
    cell = genotypes.where(F.col("sample_id").isin(samples)).select(*KEY, "sample_id", F.concat_ws(":", gt, dot("gq"), dot("dp"), depth).alias("cell"))
    none = missing.where(F.col("sample_id").isin(samples)).select(*KEY, "sample_id", F.lit("./.:.:.:.").alias("cell"))
    cells = cell.unionByName(none).groupBy(*KEY).agg(F.map_from_entries(F.collect_set(F.struct("sample_id", "cell"))).alias("m"))  # one site's samples
    joined = variants.join(cells, KEY, "left")
    names = F.array(*(F.lit(s) for s in samples)) if samples else F.array().cast("array<string>")
    told = F.transform(names, lambda s: F.coalesce(F.try_element_at("m", s), F.lit("0/0:.:.:.")))
    own = lambda c: dot(c) if c in variants.columns else F.lit(".")
    fixed = F.concat_ws("\t", "chrom", F.col("pos").cast("string"), own("vcf_id"), "ref", "alt", own("qual"), F.coalesce("filter", F.lit("PASS")), _info(variants.columns))
    line = F.concat_ws("\t", fixed, F.lit("GT:GQ:DP:AD"), F.array_join(told, "\t")) if samples else fixed
    return joined.select("chrom", "pos", "ref", "alt", line.alias("line"))


def write_vcf(lines: DataFrame, path: str, samples: list[str]) -> None:
    """Part files in site order (contigs by number, then by name), each with the header of its own."""
    head = "##fileformat=VCFv4.2\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO" + ("\tFORMAT\t" + "\t".join(samples) if samples else "")
    order = contig_order(F.col("chrom"))
    ordered = lines.repartitionByRange(*order, "pos").sortWithinPartitions(*order, "pos", "ref", "alt").select("line")

    def headed(frames):
        first = True
        for frame in frames:
            if first and len(frame):
                frame = frame.copy()
                frame.iloc[0, 0] = head + "\n" + frame.iloc[0, 0]
                first = False
            yield frame

    ordered.mapInPandas(headed, "line string").write.text(path)
