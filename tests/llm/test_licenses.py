import random
import time

import pyarrow as pa

from genolith.llm import licenses as L


def found(spark, texts):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    return {r.doc_id: r for r in L.find_notices(docs).collect()}


def test_base_places(spark):
    rows = found(spark, ["x Mit-LICENSE, the mit\nlicense", "mit licenses", None, "", "GNU General  Public License; cc-by", "émit license"])
    assert [(rows[i].n_words, rows[i].n_base, rows[i].first_word, rows[i].last_word, rows[i].base_labels) for i in range(6)] == [(6, 2, 1, 4, "mit"), (2, 0, None, None, ""), (0, 0, None, None, ""), (0, 0, None, None, ""), (6, 2, 0, 4, "cc-by,gpl"), (2, 0, None, None, "")]


def test_edits_within_bounds(spark):
    good = "Some text. Licenced under the Apache Licence, Version 2.0 and more"
    rows = found(spark, [good, "licensed under a patchy lizard version 2 0", "gnu genral publik license", "gnu grand pubic lice"])
    assert rows[0].labels == "apache" and rows[0].score < 1 and rows[0].base_labels == ""
    m = rows[0].matches[0]
    assert good[m.start : m.end] == "Licenced under the Apache Licence, Version 2.0" and (m.first_word, m.end_word) == (2, 10)
    assert rows[2].labels == "gpl" and rows[1].labels == rows[3].labels == "" and rows[1].score == 0


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_seeds_lose_nothing():
    r = random.Random(1)
    for text, label in L.NOTICES.items():
        notice = L.Notice(text, label)
        for _ in range(60):
            t = list(text)
            for _ in range(r.randint(0, notice.edits)):
                k = r.randrange(1, len(t) - 1)
                t[k : k + r.randint(0, 1)] = r.choice(["q", ""])
            s = "".join(t)
            if s != " ".join(s.split()) or edits(s, text) > notice.edits:
                continue
            words = f" before {s} after ".encode()
            assert any(s - 1 <= at <= s + 2 * notice.edits for at, *_ in notice.matches(words) for s in (8,)), (text, s)


def test_every_place_is_told(spark):
    text = "the mozila public license and then mozilla public license end"
    m = found(spark, [text])[0].matches
    assert [(x.edits, text[x.start : x.end]) for x in m] == [(1, "mozila public license"), (0, "mozilla public license")]


def best(notice, words, a, z):
    return min((edits(" ".join(words[i:j]), notice.text), i, j) for i in range(a, z) for j in range(i + 1, z + 1))


def test_labels_against_brute_force(spark):
    r = random.Random(6)
    notices = [L.Notice(t, label) for t, label in L.NOTICES.items() if len(t) < 46]
    texts = []
    for _ in range(60):
        words = []
        for _ in range(r.randint(1, 2)):
            t = list(r.choice(notices).text)
            for _ in range(r.randint(0, 6)):
                t[r.randrange(len(t))] = r.choice(["", "x", "é", "ab"])
            words += [r.choice(("and", "the", "cc", "by")) for _ in range(r.randint(0, 3))] + "".join(t).split()
        texts.append(" ".join(words))
    for i, row in found(spark, texts).items():
        words = texts[i].split()
        base = [(k, label) for phrase, label in L.BASE.items() for k in range(len(words)) if words[k : k + len(phrase.split())] == phrase.split()]
        assert (row.n_words, row.n_base, row.first_word, row.last_word) == (len(words), len(base), min(base, default=(None,))[0], max(base, default=(None,))[0])
        close = {n.text: best(n, words, 0, len(words))[0] for n in notices}
        within = {n.label for n in notices if close[n.text] <= n.edits}
        assert within <= set(row.labels.split(",")) and set(row.labels.split(",")) - {""} <= within | {b[1] for b in base} | {m.label for m in row.matches if len(m.notice) >= 46}, texts[i]
        for m in row.matches:
            if len(m.notice) < 46:
                assert edits(" ".join(words[m.first_word : m.end_word]), m.notice) <= L.Notice(m.notice, "").edits


def test_long_texts_cost_linear_time(spark):
    for unit in ("x released under the mit licence y ", "gnu general public license ", "mozilla public ", "é" * 40, "licensed under "):
        texts = [unit * (size // len(unit)) for size in (200_000, 800_000)]
        took = []
        for t in texts:
            began = time.process_time()
            rows = list(L._finder(L.NOTICES)(iter([pa.RecordBatch.from_arrays([pa.array([1]), pa.array([t])], ["doc_id", "text"])])))
            took.append(time.process_time() - began)
            assert rows[0].num_rows == 1
        assert took[1] < 8 * took[0] + 2, (unit, took)


def test_odd_rows(spark, odd):
    assert L.find_notices(odd).count() == odd.count() and L.find_notices(odd.limit(0)).count() == 0
