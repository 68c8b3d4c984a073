"""Token ids of whole texts by a public tokenizer's file, many texts at a time in numpy.

The word tokenizer lower-cases, drops white space, splits by a fixed pattern and merges byte pairs within each piece
alone. Texts of ASCII and Latin letters, whose folding is the same everywhere, are split here; each chunk's distinct
pieces are merged side by side, always the pair of lowest rank in each, and their ids are dealt out to the places where
they stand. Ids of up to KEPT pieces that a chunk holds twice or more are kept for the next ones (some 15 MB); beyond
that, those that the last chunk didn't hold make room. Pieces of over 32 bytes go to the library's own merging. All other texts, and those that may hold a special token's
name, are encoded by the library as they are. Both ways give the same ids (tested).

Defined cases. Null or empty text, or one of blanks: no ids. A text of any length is encoded whole (a long one is a
chunk of its own). Equal texts have equal ids. No texts: no ids. A file of another make of tokenizer: all texts go to
the library.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer

from .text import buffers, chunks, mix

TOKENIZER = "word_bpe_49k.json"
#: Bytes of text that are encoded at a time.
CHUNK = 1 << 21
#: Bytes of a piece that is merged here.
LONGEST = 32
#: Pieces whose ids a worker keeps.
KEPT = 200_000


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


SPACE, LETTER, NUMBER, OTHER, UNSAFE = range(5)


def _class(c: str) -> int:
    """The class of a character; unsafe ones are folded or composed by rules that are not kept here."""
    if c in "\t\n\r ":
        return SPACE
    kind = unicodedata.category(c)
    if kind[0] in "CZ" or c in "İŉſ":
        return UNSAFE
    return {"L": LETTER, "N": NUMBER}.get(kind[0], OTHER)


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Class and lower-case byte of ASCII; classes and lower-case byte pairs of U+0080 to U+017F by lead and continuation."""
    one = np.array([_class(chr(b)) if b < 128 else UNSAFE for b in range(256)], np.uint8)
    low = np.array([ord(chr(b).lower()) if b < 128 else b for b in range(256)], np.uint8)
    two, pair = np.full((64, 64), UNSAFE, np.uint8), np.zeros((64, 64, 2), np.uint8)
    for c in map(chr, range(0x80, 0x180)):
        lead, rest = c.encode()
        two[lead - 0xC0, rest - 0x80] = kind = _class(c)
        pair[lead - 0xC0, rest - 0x80] = list((c.lower() if kind != UNSAFE else c).encode())
    return one, low, two, pair


_ONE, _LOW, _TWO, _PAIR = _tables()
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)

#: How byte-level merging writes each byte: printable ones as themselves, the others from 256 on.
_PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTE_NAMES = {b: chr(b) for b in _PRINTABLE} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in _PRINTABLE)}


def _starts_with(data: np.ndarray, at: np.ndarray, word: bytes) -> np.ndarray:
    out = np.ones(len(at), bool)
    for k, b in enumerate(word):
        out &= data[np.minimum(at + k, len(data) - 1)] == b
    return out & (at + len(word) <= len(data))


def pieces(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The lower-cased bytes, starts and ends of pieces, and which documents (bounds: their ends) have an unsafe character."""
    n = len(data)
    kind, lower = _ONE[data], _LOW[data]
    lead = np.flatnonzero((data >= 0xC2) & (data < 0xC6))
    if len(lead):
        a, b = data[lead] - 0xC0, data[np.minimum(lead + 1, n - 1)] & 63
        kind[lead] = kind[lead + 1] = _TWO[a, b]
        lower[lead], lower[lead + 1] = _PAIR[a, b].T
    bad = np.flatnonzero(kind == UNSAFE)
    mark = np.flatnonzero(data[:-1] == ord("<"))
    bad = np.concatenate([bad, mark[data[mark + 1] == ord("|")]])
    unsafe = np.zeros(len(bounds) - 1, bool)
    unsafe[np.searchsorted(bounds, bad, "right") - 1] = True
    edge = np.empty(n + 1, bool)
    edge[0] = edge[n] = True
    np.not_equal(kind[1:], kind[:-1], out=edge[1:n])
    edge[bounds] = True
    edge[:n] |= (kind == NUMBER) & ((data & 0xC0) != 0x80)
    # an apostrophe that begins a run, and what may follow it, are a piece
    quote = np.flatnonzero(data == ord("'"))
    quote = quote[edge[quote]]
    for tail in (b"'s", b"'t", b"'re", b"'ve", b"'m", b"'ll", b"'d"):
        at = quote[_starts_with(lower, quote, tail)]
        at = at[np.searchsorted(bounds, at, "right") == np.searchsorted(bounds, at + len(tail) - 1, "right")]
        edge[at + 1] = False
        edge[at + len(tail)] = True
    cut = np.flatnonzero(edge)
    left, right = cut[:-1], cut[1:]
    some = kind[left] != SPACE
    return lower, left[some], right[some], unsafe


class _Merger:
    """Byte pair merging of many short pieces side by side."""

    def __init__(self, vocab: dict[str, int], merges: list[list[str]]):
        kind = np.uint16 if max(len(merges), *vocab.values()) < 0xFFFF else np.uint32
        #: No rank, or no id.
        self.none = kind(np.iinfo(kind).max)
        self.alone = np.array([vocab[_BYTE_NAMES[b] + e] for e in ("", "</w>") for b in range(256)], kind)
        left = np.array([vocab[a] for a, _ in merges], np.int64)
        right = np.array([vocab[b] for _, b in merges], np.int64)
        self.merged = np.array([vocab[a + b] for a, b in merges], kind)
        # ranks by pair, in a table with linear probing
        keys = left << 32 | right
        self.bits = max(4, int(len(keys) * 3).bit_length())
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.ranks = np.full(1 << self.bits, self.none, kind)
        todo, at = np.arange(len(keys)), self._slot(keys)
        while len(todo):
            _, first = np.unique(at, return_index=True)
            first = first[self.keys[at[first]] < 0]
            self.keys[at[first]], self.ranks[at[first]] = keys[todo[first]], todo[first].astype(kind)
            rest = np.ones(len(todo), bool)
            rest[first] = False
            todo, at = todo[rest], (at[rest] + 1) & (len(self.keys) - 1)
        a, b = np.meshgrid(self.alone, self.alone, indexing="ij")
        self.first = self.rank(a.ravel(), b.ravel())

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (mix(keys.view(np.uint64)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of each pair of ids, none where there is no such merge."""
        keys = a.astype(np.int64) << 32 | b.astype(np.int64)
        at = self._slot(keys)
        found = self.keys[at]
        out = np.where(found == keys, self.ranks[at], self.none)
        todo = np.flatnonzero((found != keys) & (found >= 0))
        while len(todo):
            at[todo] = (at[todo] + 1) & (len(self.keys) - 1)
            found = self.keys[at[todo]]
            same = found == keys[todo]
            out[todo[same]] = self.ranks[at[todo[same]]]
            todo = todo[~same & (found >= 0)]
        return out

    def __call__(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How many ids each piece has, and the ids one after the other."""
        counts = np.zeros(len(starts), np.int64)
        held = []
        for low, high in ((1, 1), (2, 3), (4, 6), (7, 9), (10, 13), (14, 18), (19, LONGEST)):
            own = np.flatnonzero((sizes >= low) & (sizes <= high))
            if len(own):
                held += self._merge(data, starts[own], sizes[own], own, counts)
        at = np.cumsum(counts) - counts
        out = np.empty(int(counts.sum()), np.uint32)
        for own, ids in held:
            n = counts[own]
            place = np.repeat(at[own] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
            out[place] = ids[ids != self.none]
        return counts, out

    def _merge(self, data, starts, sizes, own, counts):
        wide = int(sizes.max())
        column = np.arange(wide)
        inside = column < sizes[:, None]
        raw = data[starts[:, None] + column].astype(np.int32)
        raw[np.arange(len(own)), sizes - 1] += 256
        ids = np.where(inside, self.alone[raw], self.none)
        rank = np.where(inside[:, 1:], self.first[raw[:, :-1] * 512 + raw[:, 1:]], self.none)
        out = []
        while len(own):
            best = rank.argmin(1) if wide > 1 else np.zeros(len(own), np.int64)
            row = np.arange(len(own))
            lowest = rank[row, best] if wide > 1 else np.full(len(own), self.none, self.alone.dtype)
            live = lowest < self.none
            if not live.all():
                done = ~live
                counts[own[done]] = (ids[done] != self.none).sum(1)
                out.append((own[done], ids[done]))
                own, ids, rank, best, lowest = own[live], ids[live], rank[live], best[live], lowest[live]
                if not len(own):
                    break
                row = np.arange(len(own))
            after = column[:-1] > best[:, None]
            ids[:, :-1] = np.where(after, ids[:, 1:], ids[:, :-1])
            ids[:, -1] = self.none
            made = self.merged[lowest]
            ids[row, best] = made
            rank[:, :-1] = np.where(after[:, :-1], rank[:, 1:], rank[:, :-1])
            rank[:, -1] = self.none
            follows = ids[row, best + 1]
            rank[row, np.minimum(best, wide - 2)] = np.where(follows != self.none, self.rank(made, follows), self.none)
            late = np.flatnonzero(best > 0)
            rank[late, best[late] - 1] = self.rank(ids[late, best[late] - 1], made[late])
        return out


class Encoder:
    """Ids of texts as unsigned 32-bit integers."""

    _held: dict[str, Encoder] = {}

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.kept = _Kept()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.merger = _Merger(spec["model"]["vocab"], [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]) if self._as_expected(spec) else None

    @staticmethod
    def _as_expected(spec: dict) -> bool:
        """Whether the file's steps are those that this module stands for."""
        steps = [x["type"] for x in (spec.get("normalizer") or {}).get("normalizers", [])]
        split = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [{}])
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
        return (
            steps == ["NFC", "Replace", "Lowercase"] and [x.get("type") for x in split] == ["Split", "ByteLevel"] and split[0]["pattern"] == {"Regex": pattern}
            and split[0]["invert"] and split[0]["behavior"] == "Removed" and not split[1]["add_prefix_space"] and not split[1]["use_regex"]
            and spec["model"]["type"] == "BPE" and spec["model"].get("end_of_word_suffix") == "</w>" and not spec["model"].get("dropout") and not spec["model"].get("ignore_merges")
        )

    @classmethod
    def of(cls, path: str) -> Encoder:
        """The encoder of this process."""
        if path not in cls._held:
            cls._held[path] = cls(path)
        return cls._held[path]

    def __call__(self, text: str) -> bytes:
        """The ids of one text as little-endian unsigned 32-bit integers."""
        return next(iter(self.texts(pa.array([text], pa.string()))))[1].astype("<u4").tobytes()

    def texts(self, column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For runs of rows of a string column: how many ids each has, and the ids one after the other."""
        data, offsets = buffers(column)
        for i, j in chunks(offsets, CHUNK):
            yield self._chunk(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])

    def with_end(self, column: pa.Array, end: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """As texts, with an end id after each one's ids."""
        for counts, ids in self.texts(column):
            out = np.full(len(ids) + len(counts), end, np.uint32)
            out[np.arange(len(ids)) + np.repeat(np.arange(len(counts)), counts)] = ids
            yield counts + 1, out

    def _library(self, raw: bytes) -> np.ndarray:
        return np.array(self.tokenizer.encode(raw.decode(), add_special_tokens=False).ids, np.uint32)

    def _long(self, raw: bytes) -> np.ndarray:
        return np.array([t.id for t in self.tokenizer.model.tokenize("".join(_BYTE_NAMES[b] for b in raw))], np.uint32)

    def _chunk(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = len(bounds) - 1
        if not len(data):
            return np.zeros(n, np.int64), np.zeros(0, np.uint32)
        if self.merger is None:
            unsafe, first = np.ones(n, bool), np.zeros(n + 1, np.int64)
            many, starts_of, ids = np.zeros(0, np.int64), np.zeros(1, np.int64), np.zeros(0, np.uint32)
        else:
            lower, starts, ends, unsafe = pieces(data, bounds)
            first = np.searchsorted(starts, bounds)
            many, ids = self._pieces(lower, starts, ends - starts)
            starts_of = np.concatenate([[0], np.cumsum(many)])
        ends_of = starts_of[first[1:]] if len(many) else np.zeros(n, np.int64)
        begins = starts_of[first[:-1]] if len(many) else np.zeros(n, np.int64)
        if not unsafe.any():
            return ends_of - begins, ids
        own = [self._library(data[bounds[d] : bounds[d + 1]].tobytes()) if unsafe[d] else ids[begins[d] : ends_of[d]] for d in range(n)]
        return np.array([len(x) for x in own], np.int64), np.concatenate(own)

    def _pieces(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How many ids each piece has, and all ids in order; equal pieces are merged once."""
        if not len(starts):
            return np.zeros(0, np.int64), np.zeros(0, np.uint32)
        padded = np.concatenate([data, np.zeros(LONGEST + 8, np.uint8)])
        eight = np.ndarray((len(padded) - 7,), "<u8", padded, strides=(1,))
        words = [eight[np.minimum(starts + k, len(data))] & _MASKS[np.clip(sizes - k, 0, 8)] for k in range(0, LONGEST, 8)]
        key = sizes.astype(np.uint64)
        for w in words:
            key = mix(key * np.uint64(0x9E3779B97F4A7C15) + w)
        long = sizes > LONGEST
        key[long] = mix(np.flatnonzero(long).astype(np.uint64) + key[long])
        _, example, kind, often = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
        same = sizes[example][kind] == sizes
        for w in words:
            same &= w[example][kind] == w
        if not same.all():  # pieces whose hash another one has: each on its own
            odd = np.flatnonzero(~same)
            kind[odd] = len(example) + np.arange(len(odd))
            example, often = np.concatenate([example, odd]), np.concatenate([often, np.ones(len(odd), np.int64)])
        shape = np.stack([sizes[example].astype(np.uint64), *(w[example] for w in words)], 1)
        known = self.kept.find(key[example], shape)
        short = np.flatnonzero((known < 0) & ~long[example])
        counts = np.where(known >= 0, self.kept.counts[known], 0) if len(self.kept.keys) else np.zeros(len(example), np.int64)
        counts[short], fresh = self.merger(padded, starts[example[short]], sizes[example[short]])
        source, at = [self.kept.ids, fresh], np.where(known >= 0, self.kept.at[known], 0) if len(self.kept.keys) else np.zeros(len(example), np.int64)
        at[short] = len(self.kept.ids) + np.cumsum(counts[short]) - counts[short]
        end = len(self.kept.ids) + len(fresh)
        for k in np.flatnonzero(long[example]).tolist():
            e = example[k]
            source.append(self._long(data[starts[e] : starts[e] + sizes[e]].tobytes()))
            counts[k], at[k] = len(source[-1]), end
            end += len(source[-1])
        ids = np.concatenate(source)
        many = counts[kind]
        place = np.repeat(at[kind] - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
        out = ids[place]
        self.kept.learn(known, key[example], shape, counts, at, ids, (known < 0) & (often > 1) & ~long[example])
        return many, out


class _Kept:
    """Ids of pieces by hash, in sorted arrays; the pieces themselves stand beside, so that a hash is never taken for another."""

    def __init__(self):
        self.keys, self.shapes = np.zeros(0, np.uint64), np.zeros((0, 1 + LONGEST // 8), np.uint64)
        self.counts, self.at, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def find(self, keys: np.ndarray, shapes: np.ndarray) -> np.ndarray:
        """The place of each piece, -1 if it isn't there."""
        if not len(self.keys):
            return np.full(len(keys), -1)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where((self.keys[at] == keys) & (self.shapes[at] == shapes).all(1), at, -1)

    def learn(self, known, keys, shapes, counts, at, ids, new) -> None:
        """Take in the new pieces of a chunk; where there is no room for them, only what the chunk held stays."""
        new = np.flatnonzero(new)[:KEPT]
        if not len(new):
            return
        stay = np.arange(len(self.keys))
        if len(stay) + len(new) > KEPT:
            stay = np.unique(known[known >= 0])[: KEPT - len(new)]
        every = np.concatenate([self.keys[stay], keys[new]])
        order = np.argsort(every, kind="stable")
        counts, at = np.concatenate([self.counts[stay], counts[new]])[order], np.concatenate([self.at[stay], at[new]])[order]
        self.shapes = np.concatenate([self.shapes[stay], shapes[new]])[order]
        self.keys, self.counts, self.at = every[order], counts, np.cumsum(counts) - counts
        self.ids = ids[np.repeat(at - self.at, counts) + np.arange(int(counts.sum()))]
