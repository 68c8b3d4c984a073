"""Adaptive context-mixing range coder for token ids, in independently reset, checksummed blocks.

A segment holds the ids of many documents, cut into blocks of BLOCK ids. A block is decoded from its own bytes alone:
every model starts empty in it. Within a block, up to LANES runs of its ids are coded side by side in numpy, one id of
each run at a time, by range coders of their own and one model that learns from all of them.

For each id, order 2 (the last two ids) and order 1 (the last id) predict one id, with a confidence from how often that
context's prediction held. Whether the prediction of the highest order that has one holds is coded with a probability
mixed from three experts in the logistic domain, with weights that adapt: order 2's hit rate at its confidence, order
1's (agreeing or not), and order 0's frequency of the predicted id. If it fails, the id is coded by order 0, whose
frequencies are counted as ids go by and taken into use at steps that both sides know; an id that order 0 doesn't have
yet is an escape and a plain number. All arithmetic is in integers, so that any machine decodes what another one wrote.

Segment: magic, version, counts (documents, ids, blocks), then zlib-packed parts (document ids and their nulls,
lengths, each block's length and crc32), and the blocks. A damaged part raises ValueError.

Defined cases. No ids: no blocks. Ids of 0 to 2**32 - 1, others raise ValueError; a block with ids from 2**20 on tells
its distinct ids first. Null document ids are kept. Empty documents have length 0. All blocks but the last have BLOCK
ids; a document may reach over several blocks.
"""

from __future__ import annotations

import math
import struct
import zlib

import numpy as np

MAGIC, VERSION = b"GTOK", 3
BLOCK = 1 << 21
#: Runs of a block that are coded side by side, and ids that a run has at least where there are several.
LANES, LEAST = 4096, 512
#: Ids below this are their own symbols.
PLAIN = 1 << 20
#: Slots of the order-1 and order-2 tables, as powers of two.
SLOTS1, SLOTS2 = 16, 18
#: What order-0 frequencies add up to, as a power of two.
SCALE = 18
#: Steps between which the order-0 frequencies stay as they are (fewer at first).
STEADY = 32
_MOST = 7
_CONFIDENCE = 24

_U = np.uint64
_S12, _S32, _SCALE = _U(12), _U(32), _U(SCALE)
_WORD = _U((1 << 32) - 1)

#: Logistic function and its inverse on 12 bits: squash[x + 2048] for x in [-2048, 2047], in steps of 1/256.
_SQUASH = np.array([min(4095, max(1, round(4096 / (1 + math.exp(-x / 256))))) for x in range(-2048, 2048)], np.int32)
_STRETCH = np.array([max(-2047, min(2047, round(256 * math.log((p + 0.5) / (4095.5 - p))))) for p in range(4096)], np.int32)


#: What a step tells of a lane, in 9 bits: confidences of order 2 and order 1, whether they agree, whether each one held.
_K2, _K1, _AGREE, _HELD2, _HELD1 = (x.reshape(-1) for x in np.indices((8, 8, 2, 2, 2), np.int32))


def _after(k: np.ndarray, held: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """By step code: the next confidence (shifted), and whether the prediction stays. A failed one loses half its confidence, and its place at none."""
    stays = (held == 1) & (k > 0) | (k >= 2)
    return np.where((held == 1) & (k > 0), np.minimum(k + 1, _MOST), np.where(k >= 2, k >> 1, 1)).astype(np.int32) << _CONFIDENCE, stays


_NEXT2, _STAYS2 = _after(_K2, _HELD2)
_NEXT1, _STAYS1 = _after(_K1, _HELD1)
_SYMBOL = np.int32((1 << _CONFIDENCE) - 1)


class _Model:
    """What a block's coder has learned so far; symbols are below `size`."""

    def __init__(self, size: int, lanes: int):
        self.size = size
        #: A symbol below its confidence (0: none yet).
        self.seen1, self.seen2 = np.zeros(1 << SLOTS1, np.int32), np.zeros(1 << SLOTS2, np.int32)
        self.rate2, self.rate1 = np.full(8, 1 << 15, np.int64), np.full(8, 1 << 14, np.int64)
        self.weights = [30000, 20000, 10000]
        self.hash1, self.hash2 = np.zeros(lanes, np.uint32), np.zeros(lanes, np.uint32)
        self.counts, self.waiting, self.steps = np.zeros(size, np.int64), [], 0
        self._frequencies()

    def _frequencies(self) -> None:
        """Take what went by since the last time into use. Symbols that occur get a part of 2**SCALE; the rest of it is the escape's."""
        whole, least, novel, met = 1 << SCALE, 1, 1, 1
        if self.waiting:
            new = np.bincount(np.concatenate(self.waiting), minlength=self.size)
            met, novel = int(new.sum()), int(((self.counts == 0) & (new > 0)).sum())
            self.counts += new
            self.waiting = []
        while int((self.counts >= least).sum()) > whole >> 2:
            least *= 2
        own = np.where(self.counts >= least, self.counts, 0)
        some = own > 0
        escape = min(max(whole * novel // (2 * met), 16), whole >> 1)
        spare = whole - escape - int(some.sum())
        self.width = np.where(some, 1 + own * spare // max(int(own.sum()), 1), 0)
        ends = np.cumsum(self.width)
        self.used = int(ends[-1])
        self.start = ends - self.width
        self.owner = np.full(whole, -1, np.int32)
        self.owner[: self.used] = np.repeat(np.arange(self.size, dtype=np.int32), self.width)
        self.order0 = _STRETCH[np.minimum(self.width >> (SCALE - 12), 4095)]

    def predict(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """For the first n lanes: the predicted symbol, and its probability (12 bits; 0 where there is no prediction)."""
        self.slot1 = (self.hash1[:n] >> np.uint32(32 - SLOTS1)).astype(np.int64)
        self.slot2 = ((self.hash1[:n] * np.uint32(0x85EBCA6B) + self.hash2[:n]) >> np.uint32(32 - SLOTS2)).astype(np.int64)
        e1, e2 = self.seen1.take(self.slot1), self.seen2.take(self.slot2)
        self.c1, self.c2 = c1, c2 = e1 & _SYMBOL, e2 & _SYMBOL
        first = np.where(e2 > 0, c2, c1)
        self.code = code = (e2 >> _CONFIDENCE << 6) | (e1 >> _CONFIDENCE << 3) | ((first == c1).astype(np.int32) << 2)
        w2, w1, w0 = self.weights
        x2, x1 = _STRETCH[self.rate2 >> 4], _STRETCH[self.rate1 >> 4]
        self.x2, self.x1 = np.where(_K2 > 0, x2[_K2], 0), np.where(_AGREE > 0, x1[_K1], np.minimum(-x1[_K1], 0))
        self.x0 = self.order0.take(first)
        dot = (w2 * self.x2 + w1 * self.x1).astype(np.int32).take(code)
        dot += np.int32(w0) * self.x0
        dot >>= 16
        np.minimum(np.maximum(dot, -2047, out=dot), 2047, out=dot)
        dot += 2048
        self.p = p = _SQUASH.take(dot) * (code > 7)
        return first, p

    def update(self, actual: np.ndarray, hit: np.ndarray) -> None:
        n = len(actual)
        told = self.code | ((self.c2 == actual).astype(np.int32) << 1) | (self.c1 == actual)
        met = np.bincount(told, minlength=512)
        # sums of integers, exact in floats
        share = np.bincount(self.code, self.p, 512)
        asked = int(met[8:].sum())
        if asked:
            held = np.where(_K2 > 0, _HELD2, _HELD1) * met
            held[:8] = 0
            error = (held.reshape(-1, 4).sum(1) << 12) - share.reshape(-1, 4).sum(1).astype(np.int64)
            lane = (hit.astype(np.float64) * 4096 - self.p).dot(self.x0)
            for k, total in enumerate((int((self.x2[::4] * error).sum()), int((self.x1[::4] * error).sum()), int(lane))):
                self.weights[k] = min(max(self.weights[k] + ((total // asked) >> 6), -(1 << 18)), 1 << 18)
        cells = met.reshape(8, 8, 2, 2, 2)
        for rate, by, well in ((self.rate2, cells.sum((1, 2, 3, 4)), cells[:, :, :, 1].sum((1, 2, 3))), (self.rate1, cells.sum((0, 2, 3, 4)), cells[..., 1].sum((0, 2, 3)))):
            rate += np.where(by > 0, ((well << 16) // np.maximum(by, 1) - rate) >> 2, 0)
            np.minimum(rate, 0xFFFF, out=rate)
        # of equal slots the last lane's stays
        self.seen1[self.slot1] = np.where(_STAYS1.take(told), self.c1, actual) | _NEXT1.take(told)
        self.seen2[self.slot2] = np.where(_STAYS2.take(told), self.c2, actual) | _NEXT2.take(told)
        self.hash2[:n] = self.hash1[:n]
        self.hash1[:n] = actual.astype(np.uint32) * np.uint32(0x9E3779B1)
        self.waiting.append(actual)
        self.steps += 1
        if self.steps % STEADY == 0 or self.steps < STEADY and self.steps & (self.steps - 1) == 0:
            self._frequencies()


class _Writer:
    """Range encoders of all lanes."""

    def __init__(self, lanes: int):
        self.low, self.width = np.zeros(lanes, _U), np.full(lanes, (1 << 64) - 1, _U)
        self.out, self.size = np.zeros((lanes, 64), np.uint32), np.zeros(lanes, np.int64)

    def binary(self, n: int, p: np.ndarray, yes: np.ndarray | None) -> np.ndarray:
        """Code (or, without yes, decode) a decision of probability p on 12 bits in the first n lanes; of probability 0, it is no."""
        low, width = self.low[:n], self.width[:n]
        bound = (width >> _S12) * p.astype(_U)
        if yes is None:
            yes = self.code[:n] - low < bound
        low += np.where(yes, _U(0), bound)
        width[:] = np.where(yes, bound, width - bound)
        return yes

    def narrow(self, lanes: np.ndarray, start: np.ndarray, width: np.ndarray, unit: np.ndarray) -> None:
        """Take [start, start + width) of the range, in units."""
        self.low[lanes] += unit * start.astype(_U)
        self.width[lanes] = unit * width.astype(_U)

    def settle(self) -> None:
        """Shift out a word where the range has become too small; a range that straddles a word's edge ends there."""
        todo = np.flatnonzero(self.width <= _WORD)
        if len(todo):
            lo, wi = self.low[todo], self.width[todo]
            wi = np.where((lo ^ (lo + wi)) >> _S32 == 0, wi, (~lo + _U(1)) & _WORD)
            self.moved(todo, lo)
            self.low[todo], self.width[todo] = lo << _S32, wi << _S32

    def moved(self, lanes: np.ndarray, lo: np.ndarray) -> None:
        if int(self.size[lanes].max()) >= self.out.shape[1] - 4:
            self.out = np.concatenate([self.out, np.zeros_like(self.out)], axis=1)
        self.out[lanes, self.size[lanes]] = (lo >> _S32).astype(np.uint32)
        self.size[lanes] += 1

    def ended(self) -> tuple[np.ndarray, bytes]:
        """How many words each lane has, and all of them."""
        every = np.arange(len(self.low))
        for _ in range(2):
            self.moved(every, self.low)
            self.low <<= _S32
        return self.size, self.out[np.arange(self.out.shape[1]) < self.size[:, None]].astype(">u4").tobytes()


class _Reader(_Writer):
    """Range decoders of all lanes."""

    def __init__(self, sizes: np.ndarray, raw: bytes):
        self.low, self.width = np.zeros(len(sizes), _U), np.full(len(sizes), (1 << 64) - 1, _U)
        self.words, self.at = np.zeros((len(sizes), int(sizes.max()) + 2), np.uint32), np.full(len(sizes), 2, np.int64)
        self.words[np.arange(self.words.shape[1]) < sizes[:, None]] = np.frombuffer(raw, ">u4")
        self.code = (self.words[:, 0].astype(_U) << _S32) | self.words[:, 1]

    def moved(self, lanes: np.ndarray, lo: np.ndarray) -> None:
        self.code[lanes] = (self.code[lanes] << _S32) | self.words[lanes, np.minimum(self.at[lanes], self.words.shape[1] - 1)]
        self.at[lanes] += 1

    def place(self, lanes: np.ndarray, unit: np.ndarray, most: int) -> np.ndarray:
        """Where the code stands in the range, in units."""
        return np.minimum((self.code[lanes] - self.low[lanes]) // unit, _U(most - 1)).astype(np.int64)


def _order0(model: _Model, coder: _Writer, lanes: np.ndarray, actual: np.ndarray | None) -> np.ndarray:
    """Code (or decode) the symbols of some lanes by order 0."""
    writing = actual is not None
    unit = coder.width[lanes] >> _SCALE
    own = actual if writing else model.owner.take(coder.place(lanes, unit, 1 << SCALE))
    width = model.width.take(own, mode="clip")  # of symbol -1 it isn't used
    new = width == 0 if writing else own < 0
    coder.narrow(lanes, np.where(new, model.used, model.start.take(own, mode="clip")), np.where(new, (1 << SCALE) - model.used, width), unit)
    if new.any():
        coder.settle()
        rest = lanes[new]
        unit = coder.width[rest] // _U(model.size)
        plain = actual[new] if writing else coder.place(rest, unit, model.size)
        coder.narrow(rest, plain, np.ones(len(rest), np.int64), unit)
        if not writing:
            own[new] = plain
    return own


def _coded(coder: _Writer, size: int, n: int, lanes: int, grid: np.ndarray, writing: bool) -> None:
    """Code (or decode into) grid[step, lane], whose last lanes may be shorter by one step."""
    model = _Model(size, lanes)
    for step in range(len(grid)):
        m = min(lanes, n - step * lanes)
        actual = grid[step, :m]
        first, p = model.predict(m)
        hit = coder.binary(m, p, (p > 0) & (first == actual) if writing else None)
        lost = np.flatnonzero(~hit)
        if not writing:
            actual[:] = first
        if len(lost):
            found = _order0(model, coder, lost, actual[lost] if writing else None)
            if not writing:
                actual[lost] = found
        coder.settle()
        model.update(actual, hit)


def _runs(n: int) -> tuple[int, np.ndarray]:
    """The lanes of a block of n ids, and where each one's run begins; runs differ by one id at most."""
    lanes = min(max(n // LEAST, 1), LANES)
    longer = n - n // lanes * lanes
    sizes = n // lanes + (np.arange(lanes) < longer)
    return lanes, np.cumsum(sizes) - sizes


def _order(n: int, lanes: int, starts: np.ndarray) -> np.ndarray:
    """The places of a block's ids in the order in which they are coded."""
    return (starts + np.arange(-(-n // lanes))[:, None]).reshape(-1)[:n]


_BLOCK_HEAD = "<IIIII"


def encode_block(ids: np.ndarray) -> bytes:
    """Some ids as a block that can be decoded alone."""
    n, largest = len(ids), int(ids.max())
    distinct = np.zeros(0, np.uint32)
    if largest >= PLAIN:
        distinct, ids = np.unique(ids, return_inverse=True)
    size = len(distinct) or largest + 1
    lanes, starts = _runs(n)
    steps = -(-n // lanes)
    grid = np.zeros((steps, lanes), np.int32)
    grid.reshape(-1)[:n] = ids[_order(n, lanes, starts)]
    coder = _Writer(lanes)
    _coded(coder, size, n, lanes, grid, True)
    sizes, data = coder.ended()
    parts = [zlib.compress(np.diff(distinct.astype(np.int64), prepend=0).astype("<u4").tobytes(), 6), zlib.compress(sizes.astype("<u4").tobytes(), 6)]
    return struct.pack(_BLOCK_HEAD, n, size, *map(len, parts), len(distinct)) + b"".join(parts) + data


def decode_block(raw: bytes) -> np.ndarray:
    """The ids of a block."""
    n, size, a, b, n_distinct = struct.unpack_from(_BLOCK_HEAD, raw)
    at = struct.calcsize(_BLOCK_HEAD)
    distinct = np.cumsum(np.frombuffer(zlib.decompress(raw[at : at + a]), "<u4").astype(np.int64))
    lanes, starts = _runs(n)
    grid = np.zeros((-(-n // lanes), lanes), np.int32)
    sizes = np.frombuffer(zlib.decompress(raw[at + a : at + a + b]), "<u4").astype(np.int64)
    _coded(_Reader(sizes, raw[at + a + b :]), size, n, lanes, grid, False)
    out = np.empty(n, np.uint32)
    found = grid.reshape(-1)[:n]
    out[_order(n, lanes, starts)] = distinct[found] if n_distinct else found
    return out


_HEAD = "<4sHQQQ"


def write_segment(doc_ids: list[int | None], lengths: np.ndarray, ids: np.ndarray) -> bytes:
    """A segment of documents, their lengths in ids, and all their ids one after the other."""
    if len(ids) and not 0 <= int(ids.min()) <= int(ids.max()) < 1 << 32:
        raise ValueError("ids must be in 0 to 2**32 - 1")
    blocks = [encode_block(ids[i : i + BLOCK]) for i in range(0, len(ids), BLOCK)]
    known = np.array([d is not None for d in doc_ids], bool)
    numbers = np.array([d or 0 for d in doc_ids], np.int64)
    parts = [
        np.packbits(known).tobytes(), np.diff(numbers, prepend=np.int64(0)).astype("<i8").tobytes(), lengths.astype("<u4").tobytes(),
        np.array([len(b) for b in blocks], "<u4").tobytes(), np.array([zlib.crc32(b) for b in blocks], "<u4").tobytes(),
    ]
    packed = [zlib.compress(p, 6) for p in parts]
    head = struct.pack(_HEAD, MAGIC, VERSION, len(doc_ids), len(ids), len(blocks)) + struct.pack(f"<{len(packed)}I", *map(len, packed)) + b"".join(packed)
    return struct.pack("<II", len(head), zlib.crc32(head)) + head + b"".join(blocks)


class Segment:
    """A written segment: its documents, and its blocks by number."""

    def __init__(self, raw: bytes):
        size, crc = struct.unpack_from("<II", raw)
        head = raw[8 : 8 + size]
        if zlib.crc32(head) != crc or head[:4] != MAGIC:
            raise ValueError("damaged segment head")
        _, version, n_docs, self.n, self.blocks = struct.unpack_from(_HEAD, head)
        if version != VERSION:
            raise ValueError(f"segment version {version}")
        at = struct.calcsize(_HEAD)
        sizes = struct.unpack_from("<5I", head, at)
        at += 20
        parts = []
        for s in sizes:
            parts.append(zlib.decompress(head[at : at + s]))
            at += s
        known = np.unpackbits(np.frombuffer(parts[0], np.uint8), count=n_docs).astype(bool)
        numbers = np.cumsum(np.frombuffer(parts[1], "<i8"))
        self.doc_ids = [d if k else None for d, k in zip(numbers.tolist(), known.tolist(), strict=True)]
        self.lengths = np.frombuffer(parts[2], "<u4").astype(np.int64)
        self._sizes, self._crcs = (np.frombuffer(p, "<u4").astype(np.int64) for p in parts[3:])
        self._starts = 8 + size + np.cumsum(self._sizes) - self._sizes
        self._raw = raw

    def block(self, k: int) -> np.ndarray:
        """The ids of block k, from its own checked bytes alone."""
        own = self._raw[self._starts[k] : self._starts[k] + self._sizes[k]]
        if zlib.crc32(own) != self._crcs[k]:
            raise ValueError(f"damaged block {k}")
        return decode_block(own)

    def ids(self) -> np.ndarray:
        return np.concatenate([np.zeros(0, np.uint32), *(self.block(k) for k in range(self.blocks))])


def read_segment(raw: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """What write_segment was given."""
    found = Segment(raw)
    return found.doc_ids, found.lengths, found.ids()
