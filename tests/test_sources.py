import pytest
from pyspark.sql import functions as F

from genolith.functions.guard import Refused, ask, checked
from genolith.operators import concord
from genolith.sources import tables, vcf
from genolith.streaming.ingest import follow

VCF = """##fileformat=VCFv4.2
##INFO=<ID=AF,Number=A,Type=Float,Description="Frequency">
##INFO=<ID=XX,Number=1,Type=String,Description="Own">
##FORMAT=<ID=GQ,Number=1,Type=Integer,Description="Quality">
#CHROM	POS	ID	REF	ALT	QUAL	FILTER	INFO	FORMAT	A	B	C
1	100	rs1	A	G	50	PASS	AF=0.5;DB;XX=y	GT:GQ:DP:AD	0/1:99:30:15,15	1|1:70000:10:0,10	0/0:-3:5:5,0
1	200	.	C	T	.	LowQual	.	GT:GQ	./1:9	./.:.	1:20
X	300	.	G	GA	10	.	AA=g;Q	GT	./0	0/1	./.
"""


@pytest.fixture()
def vcf_file(tmp_path):
    (tmp_path / "a.vcf").write_text(VCF)
    return f"file://{tmp_path}/a.vcf"


def test_vcf_rows(spark, vcf_file):
    t = vcf.read_vcf(spark, vcf_file, "i1", keep_reference=True)
    v = {r.pos: r for r in t["variants"].collect()}
    assert (v[100].info_AF, v[100].info_DB, v[100].info_extra, v[100].filter) == (0.5, 1, {"XX": "y"}, None)
    assert [(v[p].n_called, v[p].an_called, v[p].ac_called) for p in (100, 200, 300)] == [(3, 6, 3), (1, 2, 2), (1, 3, 1)]
    assert v[200].filter == "LowQual" and v[300].info_extra == {"Q": ""} and v[300].info_AA == "g"
    g = {(r.pos, r.sample_id): r for r in t["genotypes"].collect()}
    assert {k: r.gt for k, r in g.items()} == {(100, "A"): 1, (100, "B"): 2, (100, "C"): 0, (200, "A"): 1, (200, "C"): 2, (300, "B"): 1}
    assert (g[100, "B"].gq, g[100, "B"].phased, g[100, "C"].gq, g[100, "A"].ad_alt) == (65535, 1, None, 15)
    assert {(r.pos, r.sample_id) for r in t["missing_genotypes"].collect()} == {(200, "B"), (300, "C")}
    assert t["ingestions"].first().n_variants == 3
    assert vcf.read_vcf(spark, vcf_file, "i1")["genotypes"].where("gt = 0").count() == 0


def test_vcf_header(spark, vcf_file):
    assert {(r.kind, r.id, r.stored_as) for r in vcf.header_fields(spark, vcf_file).collect()} == {("INFO", "AF", "info_AF"), ("INFO", "XX", None), ("FORMAT", "GQ", "gq")}


def test_vcf_multi(spark, tmp_path):
    (tmp_path / "m.vcf").write_text("#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tA\n1\t5\t.\tA\tC,G\t.\t.\t.\tGT:DP\t1/2:7\n")
    path = f"file://{tmp_path}/m.vcf"
    with pytest.raises(Exception, match="one ALT"):
        vcf.read_vcf(spark, path, "i")["variants"].collect()
    t = vcf.read_vcf(spark, path, "i", multi=True)
    assert sorted((r.alt, r.gt, r.dp) for r in t["genotypes"].collect()) == [("C", 1, 7), ("G", 1, 7)]


def test_vcf_export_reads_back(spark, vcf_file, tmp_path):
    t = vcf.read_vcf(spark, vcf_file, "i1")
    lines = vcf.to_vcf_lines(t["variants"], t["genotypes"], t["missing_genotypes"], ["A", "B", "C"])
    vcf.write_vcf(lines, f"file://{tmp_path}/out", ["A", "B", "C"])
    back = vcf.read_vcf(spark, f"file://{tmp_path}/out", "i1")
    pick = lambda x: sorted((r.pos, r.alt, r.sample_id, r.gt) for r in x["genotypes"].collect())
    assert pick(back) == pick(t)
    assert back["missing_genotypes"].count() == 2
    full = lambda x: sorted(tuple(sorted(r.asDict().items(), key=str)) for r in x["variants"].drop("n_called", "an_called", "ac_called", "info_extra").collect())
    assert full(back) == full(t)
    assert {r.pos: r.info_extra for r in back["variants"].collect()} == {r.pos: r.info_extra for r in t["variants"].collect()}
    assert {(r.pos, r.sample_id): r.phased for r in back["genotypes"].collect()} == {(r.pos, r.sample_id): r.phased for r in t["genotypes"].collect()}


def test_export_in_natural_order(spark, tmp_path):
    sites = spark.createDataFrame([("i", c, p, "A", "C", None) for c in ("chr10", "chrX", "chr2", "chrM") for p in (20, 3)], "ingest_id string, chrom string, pos long, ref string, alt string, filter string")
    none = spark.createDataFrame([], "ingest_id string, chrom string, pos long, ref string, alt string, sample_id string, gt int, gq int, dp int, ad_ref int, ad_alt int")
    vcf.write_vcf(vcf.to_vcf_lines(sites, none, none.select(*none.columns[:6]), []).coalesce(1), f"file://{tmp_path}/n", [])
    found = [tuple(x.split("\t")[:2]) for f in sorted((tmp_path / "n").glob("part*")) for x in f.read_text().splitlines() if not x.startswith("#")]
    assert found == [(c, p) for c in ("chr2", "chr10", "chrM", "chrX") for p in ("3", "20")]


def test_batch_and_checks(spark, vcf_file, tmp_path):
    (tmp_path / "list.tsv").write_text(f"vcf_path\tingest_id\tcohort\n{vcf_file}\tone\tx\n{vcf_file}\ttwo\n")
    t = vcf.read_batch(spark, f"file://{tmp_path}/list.tsv")
    assert {(r.ingest_id, r.cohort) for r in t["ingestions"].collect()} == {("one", "x"), ("two", "default")} and t["variants"].count() == 6
    (tmp_path / "twice.tsv").write_text(f"{vcf_file}\tone\n{vcf_file}\tone\n")
    with pytest.raises(ValueError, match="repeated"):
        vcf.read_batch(spark, f"file://{tmp_path}/twice.tsv")
    whole = vcf.read_vcf(spark, vcf_file, "i")
    assert vcf.verified(spark, vcf_file, whole) is whole
    with pytest.raises(ValueError, match="were read"):
        vcf.verified(spark, vcf_file, whole | {"variants": whole["variants"].limit(1)})
    assert {r.field: r.n for r in vcf.clamped(spark, vcf_file).collect()} == {"GQ": 1}


def test_side_files(spark, tmp_path):
    put = lambda n, s: (tmp_path / n).write_text(s) and f"file://{tmp_path}/{n}"
    ped = tables.read_ped(spark, put("p.ped", "#c\nF1 K D M 1 2\nF1 D 0 0 1 1\n"), "i").collect()
    assert [(r.sample_id, r.father_id, r.sex, r.affected) for r in ped] == [("K", "D", "male", True), ("D", "0", "male", False)]
    panel = tables.read_panel(spark, put("p.tsv", "sample\tpop\tsuper_pop\tgender\nA\tX\tY\tfemale\nB\tX\tY\t1\n"), "i")
    assert {(r.sample_id, r.population, r.sex) for r in panel.collect()} == {("A", "X", "female"), ("B", "X", "male")}
    with pytest.raises(Exception, match="conflicting"):
        tables.read_panel(spark, put("q.tsv", "sample,pop\nA,X\nA,Y\n"), "i").collect()
    gff = put("g.gff3", "##gff\nchr1\tH\tgene\t10\t90\t.\t+\t.\tID=g1;gene_id=E1;gene_name=AB\nchr1\tH\tgene\t20\t90\t.\t+\t.\tID=g2;gene_id=E2;gene_name=AB\n"
              "chr1\tH\ttranscript\t10\t90\t.\t+\t.\ttranscript_id=T1;gene_name=AB;tag=basic,MANE_Select\nchr1\tH\tCDS\t12\t40\t.\t+\t0\ttranscript_id=T1;exon_number=1\nscaffold\tH\tgene\t1\t2\t.\t+\t.\tgene_name=ZZ\n")
    assert [(r.gene_symbol, r.start_pos) for r in tables.read_genes(spark, gff).collect()] == [("AB", 10)]
    parts = tables.read_transcripts(spark, gff)
    assert parts["transcripts"].first().is_canonical and parts["cds"].first().phase == 0
    bed = tables.read_bed(spark, put("b.bed", "chr1\t0\t10\tx\nchr1\t5\t5\ty\n")).collect()
    assert [(r.start_pos, r.end_pos) for r in bed] == [(1, 10)]
    af = tables.read_population_af(spark, put("f.vcf", "#CHROM\n1\t5\t.\tA\tC,G\t.\t.\tAF=0.1,0.2;AF_popmax=0.3,.\n1\t5\t.\tA\tC\t.\t.\tAF=0.9\n")).collect()
    assert sorted((r.chrom, r.alt, r.af, r.af_grpmax) for r in af) == [("chr1", "C", 0.1, 0.3), ("chr1", "G", 0.2, None)]
    names = tables.read_gene_aliases(spark, put("h.tsv", "hgnc_id\tsymbol\tstatus\tprev_symbol\talias_symbol\nH:1\tAB\tApproved\tOLD|OLDER\tNICK\nH:2\tGONE\tWithdrawn\tX\tY\n"))
    assert {(r.alias, r.kind) for r in names.collect()} == {("OLD", "previous"), ("OLDER", "previous"), ("NICK", "alias"), ("H:1", "hgnc_id")}
    lines = tables.read_fasta(spark, put("r.fa", ">c1 x\nacg\nTT\n>c2\nG\n"))
    assert lines.orderBy("chrom", "start").collect() == [("c1", 1, "ACG"), ("c1", 4, "TT"), ("c2", 1, "G")]
    assert concord.gridded(lines, 2).orderBy("chrom", "piece").collect() == [("c1", 0, "AC"), ("c1", 1, "GT"), ("c1", 2, "T"), ("c2", 0, "G")]


def test_replace_and_roll_back(spark, tmp_path):
    path = f"file://{tmp_path}/store"
    rows = lambda i, n: spark.range(n).select(F.lit(i).alias("ingest_id"), F.col("id").alias("pos"))
    tables.replace_ingestion(rows("a", 3), path)
    tables.replace_ingestion(rows("b", 2), path)
    tables.replace_ingestion(rows("a", 1), path)
    found = spark.read.parquet(path)
    assert {r.ingest_id: r["count"] for r in found.groupBy("ingest_id").count().collect()} == {"a": 1, "b": 2}
    assert tables.rolled_back({"t": found}, "a")["t"].count() == 2


def test_follow(spark, tmp_path):
    landing, target = f"file://{tmp_path}/in", f"file://{tmp_path}/out"
    for k in (2, 5):
        df = spark.range(k).select(F.lit("a").alias("ingest_id"), F.col("id").alias("pos"))
        df.unionByName(df).write.mode("append").parquet(landing)
        follow(spark, landing, target, f"file://{tmp_path}/cp", df.schema, ["ingest_id", "pos"]).awaitTermination(60)
    assert spark.read.parquet(target).count() == 5
    late = spark.range(10, 12).select(F.lit("a").alias("ingest_id"), F.col("id").alias("pos"))
    late.write.mode("append").parquet(landing)
    follow(spark, landing, target, f"file://{tmp_path}/cp", late.schema, ["ingest_id", "pos"]).awaitTermination(60)
    assert sorted(r.pos for r in spark.read.parquet(target).collect()) == [0, 1, 2, 3, 4, 10, 11]


def test_guard(spark):
    t = {"things": spark.range(3)}
    assert ask(spark, "WITH a AS (SELECT * FROM things) SELECT count(*) AS n FROM a WHERE id IN (SELECT id FROM things)", t).first().n == 3
    for good in ("DESCRIBE things", "SHOW TABLES", "SHOW COLUMNS IN things", "EXPLAIN FORMATTED SELECT * FROM things"):
        assert checked(spark, good, {"things"}) == good
    for bad in ("DROP TABLE things", "SELECT * FROM parquet.`/x`", "SELECT * FROM other", "SELECT 1; SELECT 2", "SET a=b", "INSERT INTO things VALUES (1)", "SELECT java_method('a', 'b')", "SELECT * FROM things WHERE id IN (SELECT id FROM secret)", "SELECT * FROM range(9)", "DESCRIBE other", "EXPLAIN SELECT * FROM other", "EXPLAIN DROP TABLE things", "SHOW FUNCTIONS", "SHOW COLUMNS IN other"):
        with pytest.raises(Refused):
            checked(spark, bad, {"things"})
