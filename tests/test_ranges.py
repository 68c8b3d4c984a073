import random

from genolith.operators import ranges


def test_nearest_boundary_by_running_windows(spark, monkeypatch):
    monkeypatch.setattr(ranges, "BUCKET", 50)
    r = random.Random(7)
    points = [(c, r.randint(1, 2000)) for c in "abc" for _ in range(60)] + [("a", None)]
    spans = [(c, s := r.randint(300, 1500), s + r.randint(0, 300)) for c in "ab" for _ in range(6)]
    found = ranges.nearest_boundary(spark.createDataFrame(points, "chrom string, pos long"), spark.createDataFrame(spans, "chrom string, start_pos long, end_pos long"))
    want = [(c, p, min((abs(p - e) for k, *own in spans if k == c for e in own), default=None) if p else None) for c, p in points]
    assert sorted(map(str, map(tuple, found.collect()))) == sorted(map(str, want))
    # no frame to the end of a partition, which takes time by the square of its rows
    assert "unboundedfollowing" not in found._jdf.queryExecution().toString().lower()
