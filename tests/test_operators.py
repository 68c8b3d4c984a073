import random

from genolith.operators import combine, concord, ranges


def brute_left_align(pos, ref, alt, seq):
    """All spellings of the same haplotype with the same lengths; the leftmost one."""
    goal = seq[: pos - 1] + alt + seq[pos - 1 + len(ref) :]
    best = None
    for p in range(1, len(seq) + 1):
        for n in range(0, len(seq) - p + 2):
            m = n + len(alt) - len(ref)
            if n < 1 or m < 1:
                continue
            r = seq[p - 1 : p - 1 + n]
            a = goal[p - 1 : p - 1 + m]
            if len(r) == n and seq[: p - 1] + a + seq[p - 1 + n :] == goal and (len(r) == 1 or len(a) == 1):
                best = best or (p, r, a)
    return best


def test_left_align_against_brute_force():
    r = random.Random(5)
    for _ in range(300):
        seq = "".join(r.choice("AC") for _ in range(12))
        p = r.randint(2, 9)
        ref = seq[p - 1 : p - 1 + r.randint(1, 3)]
        alt = ref[0] + "".join(r.choice("AC") for _ in range(r.randint(0, 3)))
        if len(ref) == len(alt):
            continue
        got = concord.left_align(*concord.trim(p, ref, alt), seq)
        want = brute_left_align(p, ref, alt, seq)
        if want:
            assert got == want, (seq, p, ref, alt)


def test_atomize():
    assert concord.atomize(5, "ACG", "ATG") == [(6, "C", "T")] and concord.atomize(5, "A", "AT") == [(5, "A", "AT")]
    # substitutions first, the change of length behind the last base that both have
    assert concord.atomize(10, "ACGT", "TCA") == [(10, "A", "T"), (12, "GT", "A")] and concord.atomize(3, "AC", "GTT") == [(3, "A", "G"), (4, "C", "TT")]
    assert concord.atomize(7, "CAC", "C") == [(7, "CAC", "C")]


def test_trim_against_brute_force():
    r = random.Random(2)
    for _ in range(3000):
        ref, alt = ("".join(r.choice("AC") for _ in range(r.randint(1, 6))) for _ in range(2))
        p, a, b = concord.trim(100, ref, alt)
        end = next(k for k in range(min(len(ref), len(alt)), -1, -1) if k < min(len(ref), len(alt)) and (k == 0 or ref[-k:] == alt[-k:]))
        x, y = ref[: len(ref) - end], alt[: len(alt) - end]
        begin = next(k for k in range(min(len(x), len(y)) - 1, -1, -1) if x[:k] == y[:k])
        assert (p, a, b) == (100 + begin, x[begin:], y[begin:]), (ref, alt)


def test_phase_is_kept():
    bases, record = "GGACGG", lambda pos, ref, alt, gt=1, side=None: {"pos": pos, "ref": ref, "alt": alt, "gt": gt, "side_of": side}
    cis = concord._haplotypes([record(13, "AC", "TG")], 11, bases)
    trans = concord._haplotypes([record(13, "A", "T", side=0), record(14, "C", "G", side=1)], 11, bases)
    free = concord._haplotypes([record(13, "A", "T"), record(14, "C", "G")], 11, bases)
    assert cis == {("GGACGG", "GGTGGG")} and trans == {("GGAGGG", "GGTCGG")} and free == cis | trans
    assert concord._haplotypes([record(11 + i, "G", "A") for i in range(16)], 11, "G" * 20) == set()


def test_alignment_goes_on_in_the_piece_before(spark, monkeypatch):
    monkeypatch.setattr(concord, "PIECE", 4)
    seq = "GG" + "AC" * 9 + "TT"
    calls = spark.createDataFrame([("c", 18, "CAC", "C", 1), ("c", 4, "C", "CAC", 2), ("c", 5, "A", "G", 3), ("d", 9, "TTT", "T", 4)], "chrom string, pos long, ref string, alt string, no int")
    rows = concord.normalised(calls, spark.createDataFrame([("c", seq)], "chrom string, sequence string")).collect()
    assert sorted(tuple(r) for r in rows) == [("c", 2, "G", "GAC", 2), ("c", 2, "GAC", "G", 1), ("c", 5, "A", "G", 3), ("d", 9, "TTT", "T", 4)]


def test_comparable(spark):
    calls = spark.createDataFrame([("c", 2, "CG", "C", "1/0"), ("c", 2, "CT", "C", "0|1"), ("c", 1, "A", "<DEL>", "./1"), ("chrM", 5, "A", "T", "1"), ("x", 1, "A", "*", "0/1")], "chrom string, pos long, ref string, alt string, gt string")
    rows = concord.comparable(calls, spark.createDataFrame([("c", "ACG")], "chrom string, sequence string")).withColumn("gt", concord.canonical_gt(concord.F.col("gt"))).collect()
    assert sorted((r.chrom, r.ref, r.gt, r.excluded or "") for r in rows) == [("c", "A", "./1", "symbolic"), ("c", "CG", "0/1", ""), ("c", "CT", "0|1", "ref_mismatch"), ("chrM", "A", "1/1", ""), ("x", "A", "0/1", "symbolic")]


def test_normalised(spark):
    calls = spark.createDataFrame([("c", 6, "CAC", "C", 1), ("c", 3, "AC", "TG", 2), ("d", 2, "GTT", "GT", 1)], "chrom string, pos long, ref string, alt string, gt int")
    seqs = spark.createDataFrame([("c", "GGACACACTT")], "chrom string, sequence string")
    assert sorted(tuple(r) for r in concord.normalised(calls, seqs).collect()) == [("c", 2, "GAC", "G", 1), ("c", 3, "A", "T", 2), ("c", 4, "C", "G", 2), ("d", 2, "GT", "G", 1)]


def test_biallelic(spark):
    calls = spark.createDataFrame([("c", 1, "A", "C,G", "1/2")], "chrom string, pos long, ref string, alt string, gt string")
    assert sorted((r.alt, r.gt) for r in concord.biallelic(calls).collect()) == [("C", "0/1"), ("G", "0/1")]


def test_duplicate_keys_are_not_assessed(spark):
    s = "chrom string, pos long, ref string, alt string, gt int, filter string, qual double"
    truth = spark.createDataFrame([("c", 1, "A", "C", 1, None, 1.0), ("c", 1, "A", "C", 2, None, 1.0), ("c", 2, "A", "C", 1, None, 1.0)], s)
    query = spark.createDataFrame([("c", 1, "A", "C", 1, None, 1.0), ("c", 2, "A", "C", 2, None, 1.0)], s)
    rows = concord.classify(concord.tagged(truth, "truth"), concord.tagged(query, "query")).collect()
    assert sorted((r.side, r.pos, r.bd, r.bk) for r in rows) == [("query", 1, "FP", "."), ("query", 2, "FP", "am"), ("truth", 1, "N", "."), ("truth", 1, "N", "."), ("truth", 2, "FN", "am")]


def test_haplotype_rescue(spark):
    s = "chrom string, pos long, ref string, alt string, gt int, filter string, qual double"
    truth = spark.createDataFrame([("c", 11, "AC", "TG", 2, None, 1.0), ("c", 60, "A", "C", 1, None, 1.0)], s)
    query = spark.createDataFrame([("c", 11, "A", "T", 2, None, 1.0), ("c", 12, "C", "G", 2, None, 1.0)], s)
    seq = "G" * 10 + "AC" + "G" * 47 + "A" + "G" * 40
    rows = concord.classify(concord.tagged(truth, "truth"), concord.tagged(query, "query"))
    out = concord.haplotype_rescue(rows, spark.createDataFrame([("c", seq)], "chrom string, sequence string"), flank=5)
    assert sorted((r.side, r.pos, r.bd, r.bk) for r in out.collect()) == [("query", 11, "TP", "lm"), ("query", 12, "TP", "lm"), ("truth", 11, "TP", "lm"), ("truth", 60, "FN", ".")]


def test_containing_both_ways(spark):
    r = random.Random(1)
    points = spark.createDataFrame([("a" if r.random() < 0.5 else "b", r.randint(1, 500_000)) for _ in range(200)], "chrom string, pos long").distinct()
    spans = spark.createDataFrame([("a" if i % 2 else "b", s := r.randint(1, 400_000), s + r.randint(0, 150_000), i) for i in range(60)], "chrom string, start_pos long, end_pos long, no int")
    one, two = (sorted(tuple(x) for x in ranges.containing(points, spans, broadcast_rows=n).select("chrom", "pos", "no").collect()) for n in (1000, 0))
    assert one == two and one


def test_combine_priority_and_consensus(spark):
    s = "chrom string, pos long, ref string, alt string, sample_id string, gt int, filter string"
    a = spark.createDataFrame([("c", 1, "A", "C", "S", None, None), ("c", 2, "A", "C", "S", 1, "bad")], s)
    b = spark.createDataFrame([("c", 1, "A", "C", "S", 2, None), ("c", 3, "A", "C", "S", 1, None)], s)
    rows = {r.pos: (r.gt, r.set) for r in combine.combine({"a": a, "b": b}).collect()}
    assert rows == {1: (2, "Intersection"), 2: (1, "a"), 3: (1, "b")}
    assert [r.pos for r in combine.combine({"a": a, "b": b}, least=2).collect()] == [1]
    assert sorted(r.pos for r in combine.combine({"a": a, "b": b}, pass_only=True).collect()) == [1, 3]


def test_short_contigs_are_aligned_together(spark):
    calls = spark.createDataFrame([(f"c{i}", 6, "CAC", "C") for i in range(40)], "chrom string, pos long, ref string, alt string")
    found = concord.normalised(calls, spark.createDataFrame([(f"c{i}", "GGACACACTT") for i in range(40)], "chrom string, sequence string"), decompose=False)
    assert sorted(tuple(r) for r in found.collect()) == sorted((f"c{i}", 2, "GAC", "G") for i in range(40))
    # a group for each contig would cost a call of Python each
    assert "FlatMapCoGroupsInPandas [__group" in found._jdf.queryExecution().toString()
