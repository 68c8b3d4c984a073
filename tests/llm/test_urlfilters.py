import datetime as dt

from compare import same

from genolith.llm import urlfilters as U
from genolith.llm.queries import ORACLE_SQL, QUERIES


def test_equals_its_sql(spark):
    same(QUERIES["op4_dated_lists"](spark, "/root/testdata/sf0.001"), ORACLE_SQL["op4_dated_lists"], "/root/testdata/sf0.001")


def test_as_of(spark, odd):
    day = lambda n: dt.date(2024, 1, n)
    events = spark.createDataFrame([("a.org", "block", day(5)), ("a.org", None, day(10)), ("a.org", "block", day(20)), ("x.a.org", "allow", day(7)), ("x.a.org/Bad/p", "block", day(1)), ("b.org", "allow", day(3)), ("b.org", "block", day(3)), (None, "block", day(1))], "entry string, verdict string, since date")
    rows = [("http://u:p@A.org:80/?q", 4), ("http://a.org", 5), ("http://a.org", 9), ("http://a.org", 10), ("http://a.org", 25), ("http://x.a.org/ok", 8), ("http://y.x.a.org/", 8), ("http://x.a.org/bad//P/more#f", 8), ("http://x.a.org/badp", 8), ("http://b.org", 3), ("nonsense", 8), ("", 8), (None, 8), ("http://a.org", None), ("http://a.org", 25)]
    captures = spark.createDataFrame([(i, u, day(d) if d else None, "old") for i, (u, d) in enumerate(rows)], "i int, url string, fetched_at date, verdict string")
    for few in (U.BROADCAST_ENTRIES, 0):
        U.BROADCAST_ENTRIES, kept = few, U.BROADCAST_ENTRIES
        out = {r.i: (r.entry, r.verdict, r.kept) for r in U.evaluate(captures, events).collect()}
        U.BROADCAST_ENTRIES = kept
        block = ("a.org", "block", False)
        none = (None, None, True)
        assert [out[i] for i in range(len(rows))] == [none, block, block, none, block, ("x.a.org", "allow", True), ("x.a.org", "allow", True), ("x.a.org/bad/p", "block", False), ("x.a.org", "allow", True), ("b.org", "block", False), none, none, none, none, block]
    assert U.evaluate(captures, events.limit(0)).where("kept").count() == len(rows)
    assert U.evaluate(captures.limit(0), events).count() == 0
