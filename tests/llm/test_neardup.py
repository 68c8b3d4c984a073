import random

import numpy as np
from compare import same

from genolith.llm import neardup as N
from genolith.llm.graph import components
from genolith.llm.queries import ORACLE_SQL, QUERIES


def test_equals_its_sql(spark):
    same(QUERIES["op7_near_duplicates"](spark, "/root/testdata/sf0.001"), ORACLE_SQL["op7_near_duplicates"], "/root/testdata/sf0.001")


def shingles(t):
    w = (t or "").lower().split()
    return frozenset([tuple(w)] if len(w) == 1 else zip(w, w[1:], strict=False))


def brute(texts):
    sets = [shingles(t) for t in texts]
    comp = list(range(len(texts)))
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= 80 * len(a | b) and comp[i] != comp[j]:
                old, new = max(comp[i], comp[j]), min(comp[i], comp[j])
                comp = [new if c == old else c for c in comp]
    return comp


def test_crowded_group_against_brute_force(spark):
    r = random.Random(8)
    vocabulary = [f"v{i}" for i in range(80)]
    base = [r.choice(vocabulary) for _ in range(60)]
    texts = []
    for _ in range(260):
        w = list(base)
        for _ in range(r.randint(0, 9)):
            w[r.randrange(len(w))] = r.choice(vocabulary)
        texts.append(" ".join(w))
    texts += [" ".join(r.choice(vocabulary) for _ in range(r.randint(1, 12))) for _ in range(40)] + ["a b c d e f", "a b c d e", "one", "one", "", None]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    rows = {x.doc_id: x for x in N.labelled(docs).collect()}
    want = brute(texts)
    assert [rows[i].component_id for i in range(len(texts))] == want
    assert [rows[i].n_shingles for i in range(len(texts))] == [len(shingles(t)) for t in texts]
    assert {x.doc_id for x in N.keep(docs).collect()} == set(want)


def test_estimate_is_close():
    r = np.random.default_rng(3)
    both = r.integers(0, 2**63, 3000).astype(np.uint64)

    def regs(own):
        own = np.unique(own)
        bucket = own >> np.uint64(56)
        at = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
        return N.registers(1, np.zeros(len(at), int), own[at])

    hashes = N.mix(both)
    j, used = N.estimate(regs(hashes[:2700]), regs(hashes[300:]))
    assert used[0] == 256 and abs(j[0] - 0.8) < 0.1


def test_cross_links_across_blocks():
    sets = [[1, 2, 3, 4, 5], [1, 2, 3, 4], [9, 10], [1, 2, 3, 4, 5, 6]]
    sizes = np.array([len(s) for s in sets])
    args = (np.array([10, 11, 12, 13]), np.array([10, 11, 12, 13]))
    items = np.concatenate([np.array(s) for s in sets])
    assert len(N.cross_links(*args, np.array([0, 0, 0, 0]), sizes, items)) == 2
    assert {tuple(sorted(x)) for x in N.cross_links(*args, np.array([0, 0, 1, 1]), sizes, items)} == {(10, 13)}


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 90), (90, 95), (7, 7), (None, 3), (200, None), (91, 90), (90, 91)]
    assert {r.node: r.comp for r in components(spark.createDataFrame(edges, "a long, b long")).collect()} == {**{i: 0 for i in range(41)}, 100: 90, 95: 90, 90: 90, 91: 90}
    assert components(spark.createDataFrame([(1, 1)], "a long, b long")).count() == 0


def test_components_of_long_paths_and_stars_take_few_rounds(spark):
    told = []
    path = spark.range(10_000).selectExpr("id AS a", "id + 1 AS b")
    star = spark.range(20_001, 25_000).selectExpr("20000L AS a", "id AS b").unionByName(spark.range(30_000, 33_000).selectExpr("40000L AS a", "id AS b"))
    rows = components(path.unionByName(star), told).groupBy("comp").count().collect()
    assert {r.comp: r["count"] for r in rows} == {0: 10_001, 20_000: 5_000, 30_000: 3_001}
    assert len(told) <= 20 and max(told) <= 3


def test_odd_rows(spark, odd):
    rows = N.labelled(odd).collect()
    assert len(rows) == odd.count() and N.labelled(odd.limit(0)).count() == 0
    assert {r.component_id for r in rows if r.n_shingles == 2} == {3}
    assert N.keep(odd).columns == odd.columns
