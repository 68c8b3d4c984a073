"""Personal data: candidate spans, boosted trees over format and context, calibrated thresholds.

Base patterns (email, ip, card, phone) are reported as they are. Generators of high recall propose further spans,
which may overlap: obfuscated addresses, national and separated phone numbers, cards with unusual separators, IPv6
and defanged addresses. Boosted trees score each from its format and the words around it; a kind's scores are
calibrated on held-out examples, and its threshold is the lowest that reaches PRECISION there. Accepted spans that
overlap a base span or a better one are left out.

The model is trained here, on EXAMPLES labelled snippets drawn from a seeded grammar (positives and look-alikes such
as dates, versions, order numbers), a bound that doesn't grow with the data.

Defined cases. Null or empty text: no spans. Null or repeated doc_id: each row on its own. Texts of any length are
searched whole, each pattern in linear time. Ties: earlier start, then longer span, then kind as listed. Empty table:
no rows. Only doc_id and text are read.
"""

from __future__ import annotations

import random
import re
import zlib
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .boosting import BoostedTrees, platt

KINDS = ("email", "ip", "card", "phone")
#: Labelled snippets on which the model is trained and calibrated.
EXAMPLES = 6000
PRECISION = 0.97
#: Code points of context on either side of a candidate.
CONTEXT = 40
#: Candidates of a text that are scored at a time.
BATCH = 4096

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

#: Wider patterns by kind. Each is bounded, so that a text costs linear time.
PROPOSALS = {
    "email": [
        re.compile(r"(?<![\w.%+-])[\w.%+-]{1,64}\s?[\[({<]?\s?(?:@|\bat\b|@|＠)\s?[\])}>]?\s?[A-Za-z0-9-]{1,63}(?:\s?[\[({<]?\s?(?:\.|\bdot\b)\s?[\])}>]?\s?[A-Za-z0-9-]{2,63}){1,4}", re.I),
    ],
    "ip": [
        re.compile(r"(?<![0-9A-Fa-f:])(?:(?:[0-9A-Fa-f]{1,4}:){2,7}(?::?[0-9A-Fa-f]{1,4})|(?:[0-9A-Fa-f]{1,4})?::[0-9A-Fa-f]{1,4})(?::[0-9A-Fa-f]{1,4}){0,6}(?![0-9A-Fa-f:])"),
        re.compile(r"(?<![0-9])[0-9]{1,3}(?:\s?[\[({]?\s?(?:\.|dot)\s?[\])}]?\s?[0-9]{1,3}){3}(?![0-9])", re.I),
    ],
    "card": [re.compile(r"(?<![0-9])[0-9]{4}(?:[ ._/ -]{0,3}[0-9]{4}){2}[ ._/ -]{0,3}[0-9]{1,7}(?![0-9])"), re.compile(r"(?<![0-9])3[0-9]{3}[ ._/-]{1,3}[0-9]{6}[ ._/-]{1,3}[0-9]{5}(?![0-9])")],
    "phone": [
        re.compile(r"(?<![0-9A-Za-z+./-])(?:00|\+)?\(?[0-9]{1,4}\)?(?:[ ./ -]{1,2}\(?[0-9]{2,5}\)?){1,5}(?![0-9A-Za-z])"),
        re.compile(r"(?<![0-9A-Za-z+./-])(?:00[1-9][0-9]{7,13}|0[1-9][0-9]{8,10}|[2-9][0-9]{9})(?![0-9A-Za-z])"),
    ],
}

_WORDS = {
    "email": ("mail", "contact", "write to", "reach", "courriel", "correo", "address"),
    "ip": ("ip", "host", "server", "addr", "ping", "login from", "client", "dns"),
    "card": ("card", "visa", "master", "amex", "pay", "credit", "debit", "carte", "karte", "tarjeta"),
    "phone": ("phone", "tel", "call", "mobile", "cell", "fax", "whatsapp", "ring", "dial", "sms", "handy", "móvil"),
    "not": ("version", "release", "build", "order", "invoice", "isbn", "ref", "serial", "date", "page", "chapter", "section", "between", "from", "ticket", "tracking", "score", "table"),
}


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _only_digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind number, start, end) of the base patterns, leftmost and non-overlapping by kind."""
    out = []
    last, at = 0, text.find("@")
    while at >= 0:
        # a match begins where the run of local characters before its @ does, or where the last match ended
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at) if start < at else None
        last = found.end() if found else max(last, at + 1)
        if found:
            out.append((0, start, last))
        at = text.find("@", last)
    for m in _IP.finditer(text):
        if all(len(p := x.lstrip("0")) <= 3 and int(p or 0) <= 255 for x in m[0].split(".")):
            out.append((1, *m.span()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() <= 37 and 13 <= len(d := _only_digits(m[0])) <= 19 and luhn(d):
            out.append((2, *m.span()))
    for m in _PHONE.finditer(text):
        if 9 <= len(_only_digits(m[0])) <= 15:
            out.append((3, *m.span()))
    return out


def candidates(text: str) -> list[tuple[int, int, int]]:
    """Proposed spans, overlapping or not, that have at least the shape of their kind."""
    out = set()
    digit, digits = _HAS_DIGIT.search(text) is not None, _HAS_DIGITS.search(text) is not None
    # what every match of the kind must hold
    may = {"email": "@" in text or "＠" in text or _AT.search(text) is not None, "ip": digit or "::" in text or text.count(":") >= 2, "card": digits, "phone": digits}
    for kind, name in enumerate(KINDS):
        if not may[name]:
            continue
        for pattern in PROPOSALS[name]:
            for m in pattern.finditer(text):
                n = sum("0" <= c <= "9" for c in m[0])
                if kind == 2 and not 13 <= n <= 19 or kind == 3 and not 7 <= n <= 15:
                    continue
                out.add((kind, *m.span()))
    return sorted(out)


_HAS_DIGIT, _HAS_DIGITS = re.compile(r"[0-9]"), re.compile(r"[0-9][0-9]")
_AT = re.compile(r"\bat\b", re.I)


def features(text: str, kind: int, start: int, end: int) -> list[float]:
    s = text[start:end]
    digits = _only_digits(s)
    groups = [len(g) for g in re.findall(r"[0-9]+", s)]
    before, after = text[max(0, start - CONTEXT) : start].lower(), text[end : end + CONTEXT].lower()
    around = before + " " + after
    parts = [int(x) for x in re.findall(r"[0-9]+", s) if len(x) <= 4]
    tail = re.findall(r"[A-Za-z]+", s)
    return [
        *(float(kind == k) for k in range(4)),
        len(s), len(digits), sum(c.isalpha() for c in s), sum(c in " .-/_()" for c in s), len(set(digits)) / max(1, len(digits)),
        len(groups), min(groups, default=0), max(groups, default=0), float(luhn(digits)) if digits else 0.0, float("+" in s or s.startswith("00")),
        float("(" in s), float(s.startswith("0")), float("." in s), float("/" in s), float(":" in s), float("::" in s), float("@" in s),
        float(bool(re.search(r"[\[({<]\s?(?:at|dot|\.|@)", s, re.I))), float(len(parts) == 4 and max(parts) <= 255), max(parts, default=0),
        float(len(parts) == 3 and (1900 <= parts[0] <= 2100 or 1900 <= parts[2] <= 2100)), len(tail[-1]) if tail else 0,
        float(bool(tail) and tail[-1].lower() in ("com", "org", "net", "edu", "gov", "io", "de", "fr", "es", "uk", "info", "example")),
        float(bool(before) and before[-1].isalnum()), float(bool(after) and after[0].isalnum()), float(before[-2:].strip() in ("v", "#", "$", "€")),
        *(float(any(w in around for w in _WORDS[k])) for k in KINDS), float(any(w in _WORDS[KINDS[kind]] or w.rstrip(":.") in _WORDS[KINDS[kind]] for w in before.split()[-3:])),
        float(any(w in around for w in _WORDS["not"])), sum(c.isdigit() for c in around) / max(1, len(around)),
    ]


def _with_luhn(r: random.Random, n: int) -> str:
    body = r.choice("3456") + "".join(r.choice("0123456789") for _ in range(n - 2))
    return next(body + c for c in "0123456789" if luhn(body + c))


def _examples(n: int, seed: int) -> list[tuple[str, int, int, int, int]]:
    """Labelled candidates (text, kind, start, end, is personal) of generated snippets."""
    r, out = random.Random(seed), []
    word = lambda: "".join(r.choice(("an", "the", "er", "ou", "tion", "be", "st", "lo", "mi", "ra", "ke", "su")) for _ in range(r.randint(1, 3)))
    number = lambda k: "".join(r.choice("0123456789") for _ in range(k))

    def good(kind: int) -> str:
        if kind == 0:
            at, dot = r.choice(((" at ", " dot "), ("[at]", "[dot]"), ("(at)", "."), (" @ ", "."), ("@", ".")))
            return f"{word()}{r.choice(('.', '_', ''))}{word()}{r.randint(0, 99)}{at}{word()}{dot}{r.choice(('com', 'org', 'net', 'de', 'fr', 'io'))}"
        if kind == 1:
            if r.random() < 0.5:
                full = ":".join(f"{r.randrange(1 << 16):x}" for _ in range(8))
                return full if r.random() < 0.6 else r.choice(("2001:db8::", "fe80::")) + ":".join(f"{r.randrange(1 << 16):x}" for _ in range(r.randint(1, 4)))
            return r.choice(("[.]", " . ", "(dot)", "[dot]")).join(str(r.randint(0, 255)) for _ in range(4))
        if kind == 2:
            d = _with_luhn(r, 16)
            return r.choice((".", "_", "/", "  ", " ")).join(d[i : i + 4] for i in (0, 4, 8, 12))
        a, b, c = number(3), number(3), number(4)
        return r.choice((f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"0{number(3)} {number(6)}", f"00{r.randint(1, 99)} {a} {b} {c}", f"0{r.randint(1, 9)} {number(2)} {number(2)} {number(2)} {number(2)}", f"0{r.randint(1, 9)}{number(8)}"))

    def bad(kind: int) -> str:
        if kind == 0:
            return r.choice((f"{word()} at {word()} dot {word()}{word()}", f"meet {word()} at {word()}.{word()}", f"@{word()} . {word()}", f"{word()} at {r.randint(1, 12)}.{r.randint(10, 59)}"))
        if kind == 1:
            return r.choice((f"{r.randint(0, 23)}:{r.randint(10, 59)}:{r.randint(10, 59)}", f"{r.randint(256, 999)}.{r.randint(0, 999)}.{r.randint(0, 999)}.{r.randint(0, 99)}", f"{r.randint(1, 9)} . {r.randint(1, 9)} . {r.randint(1, 20)} . {r.randint(300, 999)}", f"{r.randint(1, 9)}:{r.randint(1, 9)}:{r.randint(1, 9)}:{r.randint(1, 9)}"))
        if kind == 2:
            return r.choice((number(16), "-".join(number(4) for _ in range(4)), ".".join(number(4) for _ in range(4)), number(14), "/".join(number(4) for _ in range(4))))
        y = r.randint(1950, 2050)
        return r.choice((f"{y}-{r.randint(10, 12)}-{r.randint(10, 28)}", f"{r.randint(10, 28)}/{r.randint(10, 12)}/{y}", f"{y}-{y + 3}", number(10), f"{r.randint(1, 9)} {number(3)} {number(3)} {number(3)}", f"{number(4)} {number(4)} {number(4)}", f"978-{r.randint(0, 9)}-{number(3)}-{number(5)}-{r.randint(0, 9)}", f"{number(2)}.{number(2)}.{number(4)}", f"{number(5)}-{number(4)}"))

    while len(out) < n:
        kind, label = r.randrange(4), int(r.random() < 0.5)
        s = good(kind) if label else bad(kind)
        # look-alikes of phones and cards without their words are left alone: digits alone don't tell
        hint = r.random() < (0.75 if label else 0.12)
        lead = r.choice(_WORDS[KINDS[kind]]) if hint else r.choice(_WORDS["not"]) if not label and r.random() < 0.5 else word()
        text = " ".join(word() for _ in range(r.randint(0, 6))) + f" {lead}{r.choice((': ', ' ', ' is '))}"
        start = len(text)
        text += s + r.choice((" ", ". ", ", ", "\n")) + " ".join(word() for _ in range(r.randint(0, 6)))
        for k, a, z in candidates(text):
            if a < start + len(s) and z > start:
                near = min(z, start + len(s)) - max(a, start) >= 0.8 * max(z - a, len(s))
                out.append((text, k, a, z, int(label and k == kind and near)))
    return out[:n]


class Detector:
    """Trees, calibration and thresholds by kind."""

    def __init__(self, examples: int = EXAMPLES, seed: int = 7, precision: float = PRECISION):
        rows = _examples(examples, seed)
        x, y = np.array([features(*r[:4]) for r in rows]), np.array([r[4] for r in rows], float)
        kinds = np.array([r[1] for r in rows])
        train = np.array([zlib.crc32(r[0].encode()) % 3 < 2 for r in rows])  # equal snippets are on one side
        self.trees = BoostedTrees().fit(x[train], y[train])
        score = self.trees.score(x)
        self.calibration, self.threshold = [], []
        for k in range(len(KINDS)):
            own = ~train & (kinds == k)
            a, b = platt(score[own], y[own])
            p = 1 / (1 + np.exp(-(a * score[own] + b)))
            order = np.argsort(-p)
            hits = np.cumsum(y[own][order]) / np.arange(1, len(order) + 1)
            good = np.flatnonzero(hits >= precision)
            self.calibration.append((a, b))
            self.threshold.append(float(max(p[order][good[-1]], 0.5)) if len(good) else 2.0)

    def probabilities(self, rows: list[tuple[str, int, int, int]]) -> np.ndarray:
        kinds = np.array([r[1] for r in rows])
        a, b = np.array(self.calibration)[kinds].T
        return np.minimum(1 / (1 + np.exp(-(a * self.trees.score(np.array([features(*r) for r in rows])) + b))), 1 - 1e-9)  # 1 is a base span's

    def spans(self, text: str) -> list[tuple[int, int, int, float]]:
        """(kind number, start, end, probability); base spans have 1."""
        base = base_spans(text)
        return sorted([*((*b, 1.0) for b in base), *self.added(text, base)])

    def added(self, text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int, float]]:
        """Accepted candidates that overlap no base span, the likelier ones first where they overlap each other."""
        proposed = candidates(text)
        if not proposed:
            return []
        taken = sorted((s, e) for _, s, e in base)
        starts, furthest = [s for s, _ in taken], list(accumulate((e for _, e in taken), max))
        free = [c for c in proposed if not (k := bisect_left(starts, c[2])) or furthest[k - 1] <= c[1]]
        out: list[tuple[int, int, int, float]] = []
        good = []
        for i in range(0, len(free), BATCH):
            part = free[i : i + BATCH]
            p = self.probabilities([(text, *c) for c in part])
            good += [(-p[j], c[1], -(c[2] - c[1]), c[0], c) for j, c in enumerate(part) if p[j] >= self.threshold[c[0]]]
        begins, ends = Sorted(), {}
        for minus, *_, c in sorted(good):
            before, after = begins.around(c[1])
            if (before is None or ends[before] <= c[1]) and (after is None or after >= c[2]):
                begins.add(c[1])
                ends[c[1]] = c[2]
                out.append((*c, -minus))
        return out


class Sorted:
    """Distinct numbers in order, in short runs, so that adding one moves few."""

    def __init__(self):
        self.runs: list[list[int]] = [[]]
        self.heads: list[int] = []

    def around(self, x: int) -> tuple[int | None, int | None]:
        """The largest number up to x, and the smallest above it."""
        k = bisect_right(self.heads, x)
        if not k:
            return None, self.heads[0] if self.heads else None
        run = self.runs[k]
        i = bisect_right(run, x)
        return run[i - 1], run[i] if i < len(run) else self.heads[k] if k < len(self.heads) else None

    def add(self, x: int) -> None:
        k = bisect_right(self.heads, x)
        if not k:
            self.heads.insert(0, x)
            self.runs.insert(1, [x])
            return
        run = self.runs[k]
        insort(run, x)
        if len(run) > 512:
            self.runs[k : k + 1] = [run[:256], run[256:]]
            self.heads.insert(k, run[256])


SCHEMA = "doc_id long, spans array<struct<kind:string,start:long,end:long,probability:double,base:boolean>>"


def detect(docs: DataFrame, detector: Detector | None = None, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id and spans (ordered by kind as listed, then start) of every row."""
    held = docs.sparkSession.sparkContext.broadcast(detector or Detector())
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("probability", pa.float64()), ("base", pa.bool_())]))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for value in batch.column(1):
                s = value.as_py() or ""
                base = base_spans(s)
                found = sorted([*((*b, 1.0, True) for b in base), *((*c, False) for c in held.value.added(s, base))])
                out.append([{"kind": KINDS[k], "start": a, "end": z, "probability": p, "base": b} for k, a, z, p, b in found])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, kind)], ["doc_id", "spans"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(find, SCHEMA)


def redact(text: str, spans: list[tuple[int, int, int, float]]) -> str:
    """The text with each span replaced by its kind."""
    out, last = [], 0
    for k, a, z, _ in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= last:
            out += [text[last:a], f"[{KINDS[k].upper()}]"]
        last = max(last, z)
    return "".join([*out, text[last:]])


def op1_personal_data(spark, sf_dir: str) -> DataFrame:
    found = detect(spark.read.parquet(f"{sf_dir}/documents.parquet"))

    def told(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def count(kind: str):
        return F.size(F.filter("spans", lambda s: s["base"] & (s["kind"] == kind))).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *(count(k) for k in KINDS), F.sha2(told(F.filter("spans", lambda s: s["base"])), 256).alias("base_sha256"), told(F.col("spans")).alias("spans"))
