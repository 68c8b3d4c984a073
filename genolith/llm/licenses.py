"""Fuzzy short-notice search: exact seeds by the pigeonhole principle, then bounded-error matching.

A text is reduced to its words (digits, a-z after lower-casing A-Z, non-ASCII characters) joined by single blanks, so
punctuation and line breaks cost no edits. A notice that may hold k edits is cut into k + 1 pieces; one of them must
stand unchanged in any match, so only the surroundings of each exact piece hit, no longer than the notice and its
edits, are given to the regex library, whose bounded-error matching verifies the edits. Places found by several pieces
are one; of overlapping ones of a notice the one of fewer edits is told. Notices that stand word for word are counted
on their own as base places. A text costs linear time, whatever it repeats.

Defined cases. Null, empty or wordless text: no words, no places, empty labels, score 0. A text of any length is
searched whole. Repeated rows each get their result; null doc_id is carried. Empty table: no rows. Only doc_id and
text are read, so other columns can't clash.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Phrases whose words, standing consecutively, give a base label.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: Notices searched with edits, and their labels.
NOTICES = {
    "gnu general public license": "gpl",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "licensed under the apache license version 2 0": "apache",
    "released under the mit license": "mit",
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "redistribution and use in source and binary forms": "bsd",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "creative commons attribution": "cc-by",
    "licensed under cc by sa": "cc-by-sa",
    "licensed under cc by nc": "cc-by-nc",
    "dedicated to the public domain": "public-domain",
}
#: One edit for so many characters of a notice.
CHARS_PER_EDIT = 10
#: Windows of a notice whose verdicts a task remembers.
REMEMBERED = 20_000

_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")

SCHEMA = """doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double,
matches array<struct<label:string,notice:string,first_word:long,end_word:long,start:long,end:long,edits:int>>"""


class Notice:
    def __init__(self, text: str, label: str):
        self.text, self.label, self.edits = text, label, len(text) // CHARS_PER_EDIT
        cuts = [round(i * len(text) / (self.edits + 1)) for i in range(self.edits + 2)]
        self.seeds = [(a, text[a:b].encode()) for a, b in zip(cuts, cuts[1:], strict=False)]
        self.pattern = regex.compile(rf"(?b)(?<![^ ])(?:{text}){{e<={self.edits}}}(?![^ ])")
        self._seen: dict[tuple[bytes, int], list[tuple[int, int, int]]] = {}

    def around(self, words: bytes, at: int, offset: int) -> tuple[int, int]:
        """Where a match may stand that holds a seed at `at`, with the character on either side."""
        a = max(0, at - offset - 4 * self.edits - 1)
        z = min(len(words), at - offset + len(self.text) + 4 * self.edits + 1)
        while a and words[a] & 0xC0 == 0x80:
            a -= 1
        while z < len(words) and words[z] & 0xC0 == 0x80:
            z += 1
        return a, z

    def _verified(self, window: bytes, seed: int) -> list[tuple[int, int, int]]:
        """The best match of a window, and further ones on the side of the seed: (start, end, edits) in bytes, without blanks at the ends."""
        if (known := self._seen.get((window, seed))) is not None:
            return known
        text, found = window.decode(), []
        at = len(window[:seed].decode())
        a, z = 1 if window[:1] != b" " else 0, len(text) - (window[-1:] != b" ")  # a cut word begins or ends nothing
        while a < z:
            if (m := self.pattern.search(text, a, z)) is None or m.end() <= m.start():
                break
            if m.end() < len(text) and text[m.end()] != " " and text[m.end() - 1] != " ":  # a word that goes on behind z
                z = m.end() - 1
                continue
            start, end = m.start() + len(m[0]) - len(m[0].lstrip()), m.end() - (len(m[0]) - len(m[0].rstrip()))
            found.append((len(text[:start].encode()), len(text[:end].encode()), sum(m.fuzzy_counts)))
            if m.start() <= at < m.end():
                break
            a, z = (a, m.start()) if at < m.start() else (m.end(), z)
        if len(self._seen) >= REMEMBERED:
            self._seen.clear()
        self._seen[window, seed] = found
        return found

    def matches(self, words: bytes) -> list[tuple[int, int, int]]:
        """(start, end, edits) of the verified places in bytes; no two overlap."""
        every: set[tuple[int, int, int]] = set()
        for offset, seed in self.seeds:
            at = words.find(seed)
            while at >= 0:
                a, z = self.around(words, at, offset)
                every |= {(a + s, a + e, n) for s, e, n in self._verified(words[a:z], at - a)}
                at = words.find(seed, at + 1)
        starts: list[int] = []
        chosen: dict[int, tuple[int, int, int]] = {}
        for m in sorted(every, key=lambda m: (m[2], m[0], -m[1])):
            k = bisect_left(starts, m[0])
            if (k == 0 or chosen[starts[k - 1]][1] <= m[0]) and (k == len(starts) or starts[k] >= m[1]):
                starts.insert(k, m[0])
                chosen[m[0]] = m
        return [chosen[s] for s in starts]


def _places(words: bytes, phrase: bytes) -> list[int]:
    out, at = [], words.find(phrase)
    while at >= 0:
        out.append(at + 1)
        at = words.find(phrase, at + 1)
    return out


def _finder(notices: dict[str, str]):
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searched = [Notice(t, label) for t, label in notices.items()]
        base = [(f" {phrase} ".encode(), label) for phrase, label in BASE.items()]
        names = ("label", "notice", "first_word", "end_word", "start", "end", "edits")
        schema = pa.schema([("doc_id", pa.int64()), *((n, pa.int64()) for n in ("n_words", "n_base", "first_word", "last_word")), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("matches", pa.list_(pa.struct([("label", pa.string()), ("notice", pa.string()), *((n, pa.int64()) for n in ("first_word", "end_word", "start", "end")), ("edits", pa.int32())])))])
        for batch in batches:
            out = []
            for doc_id, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = value.as_py() or ""
                parts = text.encode().translate(_TABLE).split()
                words = b" " + b" ".join(parts) + b" "
                places = {label: _places(words, phrase) for phrase, label in base}
                found = [(notice, *m) for notice in searched for m in notice.matches(words)]
                base_labels = {label for label, at in places.items() if at}
                numbers, matches = [], []
                if found or base_labels:
                    blanks = np.flatnonzero(np.frombuffer(words, np.uint8) == 32)
                    number = lambda at: int(np.searchsorted(blanks, at)) - 1  # noqa: E731  of the word that begins at a byte
                    numbers = [number(at) for own in places.values() for at in own]
                if found:
                    spans = [m.span() for m in _WORD.finditer(text)]
                    for notice, s, e, edits in found:
                        first, end = number(s), number(e) + 1
                        matches.append((notice.label, notice.text, first, end, spans[first][0], spans[end - 1][1], edits))
                score = max([float(bool(numbers)), *(1 - m[-1] / len(m[1]) for m in matches)])
                labels = base_labels | {m[0] for m in matches}
                out.append((doc_id, len(parts), len(numbers), min(numbers, default=None), max(numbers, default=None), ",".join(sorted(base_labels)), ",".join(sorted(labels)), score, [dict(zip(names, m, strict=True)) for m in sorted(matches, key=lambda m: m[2:])]))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], f.type) for i, f in enumerate(schema)], schema=schema)

    return find


def find_notices(docs: DataFrame, notices: dict[str, str] = NOTICES, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """A row for each document: counts and places of base phrases, all labels, the best score, and every verified match with word and code-point spans."""
    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return source.mapInArrow(_finder(notices), SCHEMA)


def op6_license_notices(spark, sf_dir: str) -> DataFrame:
    return find_notices(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("matches")
