import random
from collections import Counter
from itertools import accumulate

from genolith.llm import sharding


def least_capacity(sizes, shards):
    """Smallest capacity by trying all sums of runs."""
    ends = [0, *accumulate(sizes)]
    for c in sorted({b - a for i, a in enumerate(ends) for b in ends[i + 1 :]}):
        at, used = 0, 0
        for s in sizes:
            if s > c:
                break
            if at + s > c:
                at, used = 0, used + 1
            at += s
        else:
            if used < shards:
                return c
    return 0


def test_minimax_against_brute_force(spark):
    r = random.Random(4)
    for n, big in ((40, 1), (60, 500), (5, 1), (1, 1)):
        groups = [(f"{r.getrandbits(256):064x}", r.randint(1, 50) if i else 50 * big) for i in range(n)]
        # prefixes that several groups share
        groups += [(groups[0][0][:6] + f"{r.getrandbits(232):058x}", r.randint(1, 30)) for _ in range(6)]
        capacity, cuts = sharding.minimax_cuts(spark.createDataFrame(groups, "grp string, size long"), 4)
        ordered = sorted(groups)
        assert capacity == least_capacity([s for _, s in ordered], 4)
        load = Counter(sum(g >= c for c in cuts) for g, s in ordered for _ in range(s))
        assert max(load.values()) <= capacity and len(load) <= 4


def test_shards_are_whole(spark, odd):
    for docs in (odd, odd.limit(0)):
        rows = sharding.shard(docs).collect()
        assert len(rows) == docs.count()
        for k in {r.shard for r in rows}:
            assert sorted(r.slot for r in rows if r.shard == k) == list(range(sum(r.shard == k for r in rows)))
        by = {}
        for r in rows:
            assert by.setdefault(r.grp, r.shard) == r.shard
            assert r.size >= 1
