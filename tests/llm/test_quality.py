import math
import random
import re
from collections import Counter

import numpy as np

from genolith.llm import quality as Q


def test_rules_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in Q.assess(docs).collect():
        t = texts[r.doc_id]
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        windows = [tuple(w[k : k + 8]) for k in range(len(w) - 7)]
        often = Counter(windows)
        repeated = {k + i for k, x in enumerate(windows) if often[x] > 1 for i in range(8)}
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(repeated))
        assert r.base_failed == (len(w) < 20 or 100 * len(repeated) > 30 * len(w)) and not (r.kept and r.base_failed)


def symbols(text):
    """The model's characters by definition: blanks in a row are one, those at the start go with the four before it."""
    return "    " + re.sub(r"[\x09-\x0D\x20]+", " ", text).lstrip(" ")


class Plain:
    """Modified Kneser-Ney over five characters by definition, from counts of some texts."""

    def __init__(self, texts):
        counts = Counter(t[i : i + 5] for t in map(symbols, texts) for i in range(len(t) - 4))
        self.levels = {5: counts}
        for n in (4, 3, 2, 1):
            self.levels[n] = Counter(g[1:] for g in self.levels[n + 1])
        self.around, self.cuts = {}, {}
        for n, c in self.levels.items():
            for g, v in c.items():
                self.around.setdefault((n, g[:-1]), []).append(v)
            met = [sum(v == k for v in c.values()) for k in (1, 2, 3, 4)]
            y = met[0] / (met[0] + 2 * met[1]) if met[0] and met[1] else 0.5
            self.cuts[n] = [0.0] + [min(max(k + 1 - (k + 2) * y * met[k + 1] / met[k], 0.1), k + 0.9) if met[k] and met[k + 1] else min(0.5 * (k + 1), k + 0.9) for k in range(3)]

    def p(self, g):
        n = len(g)
        if not n:
            return 1 / (len(self.levels[1]) + 1)
        if (n, g[:-1]) not in self.around:
            return self.p(g[1:])
        around, cut = self.around[n, g[:-1]], lambda v: self.cuts[n][min(v, 3)]
        own = self.levels[n].get(g, 0)
        return (own - cut(own)) / sum(around) + sum(map(cut, around)) / sum(around) * self.p(g[1:])

    def log_ppl(self, text):
        t = symbols(text)
        own = [math.log(self.p(t[i : i + 5])) for i in range(len(t) - 4)]
        return -sum(own) / len(own), len(own), sum(x * x for x in own) / len(own) - (sum(own) / len(own)) ** 2


TEXTS = {
    "ru": ["Все счастливые семьи похожи друг на друга", "каждая несчастливая семья несчастлива по своему", "в доме всё смешалось, всё"],
    "zh": ["学而时习之，不亦说乎", "有朋自远方来，不亦乐乎", "人不知而不愠，不亦君子乎 😀𝒳"],
    "": ["  tabs\tand\n\nlines  ", "Ab aB AB", "x"],
}


def corpus(spark, n=8):
    r = random.Random(4)
    rows = [(lang or None, " ".join(r.choice(texts) for _ in range(r.randint(1, 6)))) for lang, texts in TEXTS.items() for _ in range(n)]
    return spark.createDataFrame([(i, t, lang) for i, (lang, t) in enumerate(rows)], "doc_id long, text string, lang string")


def test_model_is_kneser_ney_on_any_script_whatever_the_loads(spark):
    docs = corpus(spark)
    texts = docs.collect()
    plain = {lang: Plain([r.text for r in texts if r.lang == lang]) for lang in {r.lang for r in texts}}
    for load in (Q.LOAD, 100, 20):
        assert (len(Q.train(docs, load).loads) > 1) == (load < Q.LOAD)
        for r in Q.assess(docs, load).collect():
            want, n, _ = plain[r.lang].log_ppl(texts[r.doc_id].text)
            assert r.n_scored == n and math.isclose(r.log_ppl, want, rel_tol=1e-4), (load, r.lang, texts[r.doc_id].text)


def test_probabilities_sum_to_one():
    own = Plain(TEXTS["ru"])
    grams = list(own.levels[5].items())
    packed = [Q.grams(np.frombuffer(g.encode(), np.uint8), np.array([0, len(g.encode())])) for g, _ in grams]
    model = Q.Model(
        np.array([ord(g[0]) for g, _ in grams], np.uint64), np.array([sum(ord(c) << 16 * (4 - k) for k, c in enumerate(g[1:], 1)) for g, _ in grams], np.uint64), np.array([n for _, n in grams]),
        [np.array(own.cuts[k]) for k in range(1, 6)], np.array([ord(c) for c in own.levels[1]], np.uint64), np.array(list(own.levels[1].values())),
    )
    assert len(packed) == len(grams)
    for context in ("счас", " нес", "  в ", "    ", "qqqq", "семь"):
        chars = [*own.levels[1], "§"]
        first = np.full(len(chars), ord(context[0]), np.uint64)
        last = np.array([sum(ord(c) << 16 * (3 - k) for k, c in enumerate(context[1:] + x)) for x in chars], np.uint64)
        p = np.exp(model.score(first, last))
        assert math.isclose(p.sum(), 1, rel_tol=1e-4), context
        assert all(math.isclose(a, own.p(context + x), rel_tol=1e-4) for a, x in zip(p, chars, strict=True))


def test_grams_of_a_text():
    raw = "Ab  é\n9😀".encode()
    first, last, bounds = Q.grams(np.frombuffer(raw, np.uint8), np.array([0, 0, len(raw), len(raw)]))
    got = [x & 0xFFFF for x in last.tolist()]
    assert got[:-1] == [ord(c) for c in "Ab é 9"] and 0xD800 <= got[-1] < 0xE000 and bounds.tolist() == [0, 0, 7, 7] and first[0] == 32 and last[4] >> np.uint64(48) == ord("b")


def quantiles(values):
    values = sorted(values)
    return [values[max(0, math.ceil(q * len(values)) - 1)] for q in (0.25, 0.5, 0.75)]


def test_kept_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = {r.doc_id: r for r in docs.collect()}
    rows = Q.assess(docs).collect()
    plain = {lang: Plain([r.text for r in texts.values() if r.lang == lang]) for lang in {r.lang for r in texts.values()}}
    scored = {r.doc_id: plain[r.lang].log_ppl(texts[r.doc_id].text) for r in rows if not r.base_failed and len(texts[r.doc_id].text) < 3000}
    assert all(math.isclose(scored[r.doc_id][0], r.log_ppl, rel_tol=1e-4) for r in rows if r.doc_id in scored) and len(scored) > 50
    for lang in plain:
        own = [r for r in rows if r.lang == lang and not r.base_failed]
        variance = {r.doc_id: plain[lang].log_ppl(texts[r.doc_id].text)[2] for r in own}
        sure = {r.doc_id: [] for r in own}
        for value, size, var in (
            (lambda r: r.log_ppl, lambda r: r.n_scored, lambda r: variance[r.doc_id]),
            (lambda r: r.log_ppl * r.n_scored / r.n_words, lambda r: r.n_words, lambda r: variance[r.doc_id] * r.n_scored / r.n_words),
        ):
            q, v = quantiles([value(r) for r in own]), quantiles([var(r) for r in own])[1]
            z = {r.doc_id: (value(r) - q[1]) / math.sqrt(((q[2] - q[0]) / 1.349) ** 2 + Q.CLUSTERING * v / size(r)) for r in own}
            low, middle, high = quantiles(list(z.values()))
            reach = Q.BAND / 0.6745 * (1 + Q.FEW / len(own))
            edges = middle - reach * (middle - low), middle + reach * (high - middle)
            for r in own:
                sure[r.doc_id].append(None if min(abs(z[r.doc_id] - e) for e in edges) < 1e-3 else edges[0] < z[r.doc_id] < edges[1])
        for r in own:
            if None not in sure[r.doc_id]:
                assert r.kept == all(sure[r.doc_id]), r
        assert not any(r.kept for r in rows if r.lang == lang and r.base_failed)


def test_held_out_labels(spark):
    """Documents labelled good stay; the bands and rules together find most of the bad."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = Q.assess(docs).join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id").collect()
    good = [r for r in rows if r.quality == 1 and not r.base_failed]
    assert sum(r.kept for r in good) >= 0.99 * len(good)
    bad = [r for r in rows if r.quality == 0]
    assert sum(not r.kept for r in bad) >= 0.3 * len(bad)


def test_bands_reject_by_themselves(spark):
    """Of labelled documents that pass the base rules: surprising bad ones go by the upper band, sound ones stay."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = Q.assess(docs).where("not base_failed").join(docs.select("doc_id", "lang"), "doc_id").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id", "left").collect()
    measures = ("log_ppl", "log_ppl_word")
    middle = {(lang, x): np.median([r[x] for r in rows if r.lang == lang]) for lang in {r.lang for r in rows} for x in measures}
    good, bad = ([r for r in rows if r.quality == k] for k in (1, 0))
    above = [r for r in bad if not r.kept and any(r[x] > middle[r.lang, x] for x in measures)]
    assert sum(not r.kept for r in bad) >= 0.5 * len(bad) and len(above) >= 0.4 * len(bad)
    assert sum(r.kept for r in good) >= 0.99 * len(good)


def test_odd_rows(spark, odd):
    rows = Q.assess(odd).collect()
    assert len(rows) == odd.count() and all(r.base_failed and not r.kept for r in rows)
    assert Q.assess(odd.limit(0)).count() == 0
    assert Q.keep(odd).columns == odd.columns
    clash = spark.createDataFrame([(1, "a b c " * 30, "en", 5, 6.0, "k")], "doc_id long, text string, lang string, __n_words int, n_words double, ___kept string")
    assert [r.text for r in Q.keep(clash).collect()] == [] and Q.keep(clash).columns == clash.columns
