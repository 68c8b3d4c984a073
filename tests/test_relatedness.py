import itertools
import random

import pytest

from genolith.operators import relatedness

SITE, CALL = "ingest_id string, chrom string, pos long, ref string, alt string", "ingest_id string, chrom string, pos long, ref string, alt string, sample_id string"


@pytest.fixture(scope="module")
def cohort(spark):
    """Eleven samples, one without a call; common and rare sites."""
    r, names, calls, gone, told = random.Random(3), [f"S{i}" for i in range(11)], [], [], {}
    for p in range(60):
        for s in names[:-1]:
            kind = r.random() * (1 if p % 3 else 12)
            value = 1 if kind < 0.4 else 2 if kind < 0.6 else -1 if kind < 0.7 else 0
            told[s, p] = value
            (gone if value < 0 else calls).append(("i", "chr1", p, "A", "C", s, *([] if value < 0 else [value])))
    known = spark.createDataFrame([("i", s) for s in names], "ingest_id string, sample_id string")
    sites = spark.createDataFrame([("i", "chr1", p, "A", "C") for p in range(60)], SITE)
    want = {}
    for a, b in itertools.combinations(sorted(names), 2):
        both = [(told.get((a, p), 0), told.get((b, p), 0)) for p in range(60)]
        both = [x for x in both if -1 not in x]
        want[a, b] = (len(both), both.count((1, 1)), both.count((0, 2)) + both.count((2, 0)), sum(x.count(1) for x in both))
    return spark.createDataFrame(calls, CALL + ", gt int"), spark.createDataFrame(gone, CALL), known, sites, want


def test_kinship_by_tiles_of_bounded_blocks(cohort, monkeypatch):
    monkeypatch.setattr(relatedness, "BLOCK_SAMPLES", 3)
    monkeypatch.setattr(relatedness, "LEAST_SAMPLES", 3)
    calls, gone, known, sites, want = cohort
    pairs = relatedness.kinship(calls, gone, known, sites)
    assert {(r.a, r.b): (r.n_sites, r.hethet, r.ibs0, r.het_pair) for r in pairs.collect()} == want
    # no group holds the calls of all samples at many sites
    assert "FlatMapGroups" not in pairs._jdf.queryExecution().toString()


def test_common_and_rare_sites_count_alike(monkeypatch):
    """The two ways of adding a site into a tile's tables."""
    import numpy as np
    import pyarrow as pa

    r = random.Random(4)
    own = {"ingest_id": "i", "i": 0, "j": 1, "total": 400, "left_ids": list("abcdefghijklmnop"), "right_ids": list("qrstuvwxyz"), "left_counts": [9] * 48, "right_counts": [9] * 30}
    lists = lambda n: pa.array([[s * 4 + r.randrange(3) for s in range(n) if r.random() < 0.9] for _ in range(400)], pa.list_(pa.int32()))
    left, right, found = lists(16), lists(10), []
    for dense in (0.1, 2.0):
        monkeypatch.setattr(relatedness, "DENSE", dense)
        tile = relatedness._Tile(own)
        tile.add(left, right)
        told = list(tile.told())
        assert sum(len(b) for b in told) == 160
        found.append((tile.same, tile.off))
    assert all(np.array_equal(a, b) for a, b in zip(*found, strict=True))


def test_kinship_of_asked_pairs(cohort):
    calls, gone, known, sites, want = cohort
    asked = [k for i, k in enumerate(sorted(want)) if i % 4 == 0]
    pairs = relatedness.kinship_of(calls.sparkSession.createDataFrame([("i", *k) for k in asked] + [("i", "S1", "none")], "ingest_id string, a string, b string"), calls, gone, known, sites)
    assert {(r.a, r.b): (r.n_sites, r.hethet, r.ibs0, r.het_pair) for r in pairs.collect()} == {k: want[k] for k in asked}
