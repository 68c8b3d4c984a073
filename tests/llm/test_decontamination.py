import re

from compare import same

from genolith.llm import decontamination as D
from genolith.llm.queries import ORACLE_SQL, QUERIES

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))


def test_equals_its_sql(spark):
    same(QUERIES["op2_decontaminate"](spark, "/root/testdata/sf0.001"), ORACLE_SQL["op2_decontaminate"], "/root/testdata/sf0.001")


def brute(text, items):
    own, hit, who = words(text), set(), set()
    for item, t in items:
        w = words(t)
        size = min(13, len(w))
        for k in range(len(w) - size + 1 if w else 0):
            for i in range(len(own) - size + 1):
                if own[i : i + size] == w[k : k + size]:
                    hit.update(range(i, i + size))
                    who |= {item} if item is not None else set()
    return len(own), len(hit), sorted(who)


def test_against_brute_force_whole_and_in_blocks(spark):
    long = " ".join(f"w{i}" for i in range(30))
    items = [("10", long), ("9", "Short, one!"), ("b", "é-é ß"), (None, "nobody has this"), ("n", None), ("e", "..."), ("10", long), ("c", "short one")]
    texts = [f"x {long.upper()} y", "a SHORT; one b short one", "É é ß é é ß", None, "", "nobody has this at all", "w3 w4 w5 w6 w7 w8 w9 w10 w11 w12 w13 w14 w15 tail", "short\x00one"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id string, text string")
    for most in (D.MAX_WINDOWS, 10):
        rows = {r.doc_id: r for r in D.judged(D.scan(docs, bench, max_windows=most)).collect()}
        for i, t in enumerate(texts):
            assert (rows[i].n_words, rows[i].n_hit, rows[i]["items"]) == brute(t, items), (i, most)


def test_blocks_are_counted_by_windows(spark):
    items = spark.createDataFrame([("a", " ".join(f"W{i}" for i in range(20))), ("b", "Three short words"), ("c", "..."), ("d", None), ("e", "é ß")], "item string, t string")
    assert [D._blocks(items, n) for n in (100, 10, 9, 3, 1)] == [1, 1, 2, 4, 10] and D._blocks(items.limit(0), 5) == 1


def test_remove(spark, odd):
    clean, long = " ".join(f"c{i}" for i in range(300)), " ".join(f"w{i}" for i in range(13))
    docs = spark.createDataFrame([(1, long + " z", "k"), (2, f"{clean}. {long}, end", "k"), (3, clean, "k"), (4, None, "k")], "doc_id long, text string, row_key string")
    out = {r.doc_id: r for r in D.remove(docs, spark.createDataFrame([("1", long)], "item_id string, text string")).collect()}
    assert {k: r.text for k, r in out.items()} == {2: f"{clean}. , end", 3: clean, 4: None} and out[2].row_key == "k"
    empty = spark.createDataFrame([], "item_id string, text string")
    assert D.remove(odd, empty).count() == odd.count() == D.scan(odd, empty).count()
    assert D.scan(odd.limit(0), empty).count() == 0


def test_remove_in_blocks_equals_one_block(spark):
    filler = [f"c{i}" for i in range(400)]
    a, b, c = ([f"{x}{i}" for i in range(14)] for x in "abz")
    over = a[7:] + b[:7]  # overlaps both neighbours
    texts = [
        " ".join([*filler[:186], *a, *filler[186:], *b]),  # 3.4 % by each of two items
        " ".join([*filler, *a, *b[:7], *filler[:100]]), " ".join([*filler, *c]), " ".join(filler), None, "", " ".join([*filler, *a, *b, *filler]),
    ]
    docs = spark.createDataFrame([(i, t, "k") for i, t in enumerate([*texts, texts[1]])], "doc_id long, text string, row_key string")
    bench = spark.createDataFrame([(str(i), " ".join(x)) for i, x in enumerate((a, b, c, over))], "item_id string, text string")
    one, many = (sorted((r.doc_id, r.text or "", r.row_key) for r in D.remove(docs, bench, max_windows=most).collect()) for most in (D.MAX_WINDOWS, 2))
    assert one == many and 0 not in {r[0] for r in many} and {2, 3, 4, 5} <= {r[0] for r in many}
