import pytest

from genolith.operators.pedigree import Pedigree
from genolith.sources import sinks

FAMILY = [("gf", None, None, "male"), ("gm", "0", "0", "female"), ("dad", "gf", "gm", "male"), ("aunt", "gf", "gm", "female"), ("mum", "0", "0", "female"), ("kid", "dad", "mum", "male"), ("sib", "dad", "mum", "female"), ("half", "dad", "0", "male"), ("inbred", "kid", "aunt", "male")]


def test_pedigree():
    p = Pedigree(FAMILY)
    assert p.depth["gf"] == 0 and p.depth["kid"] == 2 and p.depth["inbred"] == 3 and p.problems() == []
    assert [p.kinship("kid", x) for x in ("kid", "dad", "sib", "half", "gf", "aunt", "mum")] == [0.5, 0.25, 0.25, 0.125, 0.125, 0.125, 0.25]
    assert p.inbreeding("inbred") == 0.125 and p.kinship("gf", "gm") == 0
    assert [p.expected("kid", x) for x in ("dad", "sib", "half", "gf", "aunt")] == ["parent-child", "full-siblings", "half-siblings", "grandparent", "second-degree"]
    assert len(p.trios()) == 5 and p.duos() == [("half", "dad")]
    with pytest.raises(ValueError, match="descend from themselves"):
        Pedigree([("a", "b", None, None), ("b", "a", None, None)])
    assert Pedigree([("a", "f", "m", None), ("f", None, None, "female")]).problems() == ["a: father f is female"]


def test_formats(spark):
    df = spark.createDataFrame([(1, 'a"\tb', None), (2, "c", True)], "n int, s string, b boolean")
    lines = lambda f: list(sinks.rendered(df, f))
    assert lines("TSVWithNames") == ["n\ts\tb", '1\ta"\\tb\t\\N', "2\tc\ttrue"]
    assert lines("CSV") == ['1,"a""\tb",\\N', '2,"c",true'] or lines("CSV")[1] == "2,\"c\",true"
    assert lines("JSONEachRow")[1] == '{"n": 2, "s": "c", "b": true}'
    assert '"rows": 2' in lines("JSON")[0] and lines("Vertical")[0] == "Row 1:" and lines("Pretty")[0].startswith("n | s")
    with pytest.raises(ValueError, match="unknown format"):
        lines("XML")


def test_bundle(spark, tmp_path):
    df = spark.createDataFrame([(1, "x")], "n long, extra string")
    df.write.parquet(f"file://{tmp_path}/dump/t")
    sinks.pack_bundle(f"{tmp_path}/dump", f"{tmp_path}/b.tar.gz")
    out = sinks.unpack_bundle(spark, f"{tmp_path}/b.tar.gz", f"{tmp_path}/back", {"t": spark.createDataFrame([], "n long, more string")})
    assert [tuple(r) for r in out["t"].collect()] == [(1, None)]
