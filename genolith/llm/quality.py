"""Quality rules and n-gram perplexity.

The language model counts n-grams of five characters over every document, by language, in Spark: a map-side count for
each task, then sums by (language, n-gram). Characters are the text's own code points (blanks in a row are one; those
beyond U+FFFF share 2,048 symbols), so what is counted grows with the input and with every script in it. Probabilities
are modified Kneser-Ney: three discounts for each order from counts of counts, continuation counts below the highest
order. Every language has its own counts, discounts and band.

A model is a set of sorted arrays: for each order the n-grams (hashed in the highest order, packed below it) beside
their log probabilities, and the contexts beside their back-off weights; scoring searches them for the distinct n-grams
of a chunk of text. Models are broadcast in loads of about LOAD n-grams: several small languages, or one language, or a
block of a large one (n-grams by their fourth character, so that an n-gram finds all its lower orders in its block). A
scan for each load adds to every document's sums, so the answer doesn't depend on how many loads there are.

A document's log perplexity by character and by word are each judged against its language's band: the median over all
documents of the language, and on either side BAND times the deviation of the documents on that side, told by their
quartile. Deviations are in a spread that has a part for differences between documents and a part that shrinks with the
document's length; bands of languages with few documents are wider by FEW over their number. Documents outside either
band are rejected, and so are those that fail the base rules (fewer than 20 words, or over 30 % of words in repeated
8-word windows).

Defined cases. Null, empty or wordless text: all counts 0, base_failed, not kept, no perplexity. Null language: a
language of its own, with the empty one. A language whose documents all fail the base rules has no band. Ties with a
band's edge are kept. Repeated rows are scored alike; null doc_id is carried. Empty table: no rows. `keep` returns all
columns under their own names, whatever they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from .shared import settled
from .text import NOT_SPACE, Words, covered, mix, rows, window_hashes

ORDER = 5
#: N-grams of the highest order in a load, some 150 MB in a worker. A block has one fourth character at least.
LOAD = 4_000_000
#: N-grams that a counting task holds before it tells them.
TOLD = 400_000
#: Bytes of text that are counted or scored at a time.
CHUNK = 1 << 19
#: How far a band reaches on either side of its middle, in the deviation of sound documents on that side.
BAND = 4.5
#: A band of so many documents is twice as wide as one of very many.
FEW = 30
REPEAT_WINDOW = 8
#: How much the log probabilities of neighbouring characters move together: their sum varies so many times more.
CLUSTERING = 3.0

_B = np.arange(256)
_CONTINUES = (_B & 0xC0) == 0x80
_SYMBOL = np.isin(_B, list(b"#*$%&|<>"))
_LOW = [np.uint64((1 << 16 * k) - 1) for k in range(5)]
_S16, _S48 = np.uint64(16), np.uint64(48)


def symbols(chars: np.ndarray) -> np.ndarray:
    """16-bit symbols of code points: blanks are one, those beyond 16 bits share the range that no character has."""
    out = np.where((chars >= 9) & (chars <= 13), 32, chars).astype(np.uint64)
    far = np.flatnonzero(out > 0xFFFF)
    out[far] = 0xD800 | (mix(out[far]) & np.uint64(0x7FF))
    return out


def grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The n-gram that ends at each character of each document (its first symbol, and its last four packed), and the bounds of the documents in them.

    Runs of blanks are one, and a document begins after blanks.
    """
    lo, hi = int(offsets[0]), int(offsets[-1])
    data, bounds = data[lo:hi], offsets - lo
    code = symbols(np.frombuffer(data.tobytes().decode(errors="replace").encode("utf-32-le", "surrogatepass"), "<u4"))
    bounds = np.concatenate([[0], np.cumsum(~_CONTINUES[data])])[bounds]
    keep = code != 32
    keep[1:] |= code[:-1] != 32
    starts = bounds[:-1][bounds[:-1] < len(code)]
    keep[starts] = code[starts] != 32  # blanks at the start are those before it
    new = np.concatenate([[0], np.cumsum(keep)])[bounds]
    code = code[keep]
    lead = ORDER - 1
    sizes = np.diff(new)
    place = np.arange(len(code)) + np.repeat(np.arange(1, len(sizes) + 1) * lead, sizes)
    padded = np.full(len(code) + lead * len(sizes), 32, np.uint64)
    padded[place] = code
    last = padded[place]
    for k in range(1, lead):
        last |= padded[place - k] << np.uint64(16 * k)
    return padded[place - lead], last, new


def hashed(first: np.ndarray, last: np.ndarray) -> np.ndarray:
    return mix(last * np.uint64(0x9E3779B97F4A7C15) + first + np.uint64(1))


COUNTS = "lang string, hi int, lo long, n long"


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, list] = {}

    def told(lang: str):
        key, first, last, n = held.pop(lang)
        return pa.RecordBatch.from_arrays([pa.array([lang] * len(key), pa.string()), pa.array(first.astype(np.int32)), pa.array(last.view(np.int64)), pa.array(n)], ["lang", "hi", "lo", "n"])

    for batch, data, offsets in rows(batches, most=CHUNK):
        first, last, bounds = grams(data, offsets)
        langs = batch.column(batch.schema.get_field_index("lang")).fill_null("").to_numpy(zero_copy_only=False)
        owner = np.repeat(np.arange(len(langs)), np.diff(bounds))
        key = hashed(first, last)
        for lang in dict.fromkeys(langs.tolist()):
            own = np.flatnonzero((langs == lang)[owner])
            parts = [x[own] for x in (key, first, last)] + [np.ones(len(own), np.int64)]
            if lang in held:
                parts = [np.concatenate(x) for x in zip(held[lang], parts, strict=True)]
            values, at, kind = np.unique(parts[0], return_index=True, return_inverse=True)
            n = np.zeros(len(values), np.int64)
            np.add.at(n, kind, parts[3])
            held[lang] = [values, parts[1][at], parts[2][at], n]
        while sum(len(x[0]) for x in held.values()) > TOLD:
            yield told(max(held, key=lambda x: len(held[x][0])))
    for lang in list(held):
        yield told(lang)


def discounts(met: tuple[int, int, int, int]) -> np.ndarray:
    """The cut of a count of 0, 1, 2, and 3 or more, from how many n-grams have the counts 1 to 4."""
    y = met[0] / (met[0] + 2 * met[1]) if met[0] and met[1] else 0.5
    return np.array([0.0, *(min(max(k + 1 - (k + 2) * y * met[k + 1] / met[k], 0.1), k + 0.9) if met[k] and met[k + 1] else min(0.5 * (k + 1), k + 0.9) for k in range(3))])


def _search(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the wanted stand in a sorted array, and whether they do."""
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


class Model:
    """A language's model, or a block of it, in sorted arrays.

    first, last, counts: its n-grams of the highest order; cuts: the discounts of orders 1 to 5; single, begun: the
    language's characters and in how many ways each one's 2-grams begin.
    """

    def __init__(self, first: np.ndarray, last: np.ndarray, counts: np.ndarray, cuts: list[np.ndarray], single: np.ndarray, begun: np.ndarray):
        cut = cuts[0][np.minimum(begun, 3)]
        total = max(int(begun.sum()), 1)
        uniform = 1 / (len(single) + 1)
        left = float(cut.sum()) / total if len(single) else 1.0
        order = np.argsort(single)
        self.single, self.p1 = single[order], ((begun - cut) / total + left * uniform)[order]
        self.unseen = float(np.log(left * uniform))
        #: By order: n-grams, log probabilities, contexts, log back-off weights.
        self.orders = []
        levels = []
        keys = last
        for k in range(ORDER - 1, 1, -1):  # continuation counts: in how many ways can this be begun
            keys, n = np.unique(keys & _LOW[k], return_counts=True)
            levels.append((keys, n))
        lower_keys, lower = self.single, self.p1
        for k, (keys, n) in zip(range(2, ORDER), reversed(levels), strict=True):
            p = self._level(keys >> _S16, n, cuts[k - 1], lower[_search(lower_keys, keys & _LOW[k - 1])[0]], keys)
            lower_keys, lower = keys, p
        key = hashed(first, last)
        order = np.argsort(key)
        self._level(((first << _S48) | (last >> _S16))[order], counts[order], cuts[ORDER - 1], lower[_search(lower_keys, last[order])[0]], key[order])
        self.p1 = np.log(self.p1).astype(np.float32)

    def _level(self, context: np.ndarray, n: np.ndarray, cuts: np.ndarray, lower: np.ndarray, keys: np.ndarray) -> np.ndarray:
        contexts, of = np.unique(context, return_inverse=True)
        cut = cuts[np.minimum(n, 3)]
        total = np.bincount(of, n)
        left = np.bincount(of, cut) / total
        p = (n - cut) / total[of] + left[of] * lower
        self.orders.append((keys, np.log(p).astype(np.float32), contexts, np.log(np.maximum(left, 1e-12)).astype(np.float32)))
        return p

    def score(self, first: np.ndarray, last: np.ndarray, k: int = ORDER) -> np.ndarray:
        """The log probability of each n-gram's last symbol after those before it."""
        if k == 1:
            at, found = _search(self.single, last)
            return np.where(found, self.p1[at] if len(self.p1) else 0, self.unseen)
        keys, logp, contexts, weights = self.orders[k - 2]
        at, found = _search(keys, hashed(first, last) if k == ORDER else last)
        out = np.where(found, logp[at] if len(logp) else 0, 0.0).astype(np.float64)
        if len(rest := np.flatnonzero(~found)):
            context = (last[rest] >> _S16) | (first[rest] << _S48 if k == ORDER else np.uint64(0))
            at, known = _search(contexts, context)
            out[rest] = np.where(known, weights[at] if len(weights) else 0, 0.0) + self.score(first[rest], last[rest] & _LOW[k - 1], k - 1)
        return out


def block_of(lo, blocks: int):
    """The block of an n-gram of a language that has several: by its fourth character."""
    if isinstance(lo, Column):
        return F.pmod(F.pmod(F.shiftrightunsigned(lo, 16).bitwiseAND(F.lit(0xFFFF)) * 40503, F.lit(65537)), F.lit(blocks))
    return ((lo >> _S16) & _LOW[1]) * np.uint64(40503) % np.uint64(65537) % np.uint64(blocks)


class Trained:
    """Counts of a corpus, and the loads in which its models are broadcast: lists of (language, block, blocks)."""

    def __init__(self, docs: DataFrame, load: int):
        counted = docs.select("text", F.col("lang").cast("string").alias("lang")).mapInArrow(_count, COUNTS)
        self.counts = settled(counted.groupBy("lang", "hi", "lo").agg(F.sum("n").alias("n")))
        levels, at = [self.counts.select("lang", F.col("lo").alias("g"), "n")], self.counts.select("lang", F.col("lo").alias("g"))
        for k in range(ORDER - 1, 0, -1):
            own = at.groupBy("lang", F.col("g").bitwiseAND(F.lit((1 << 16 * k) - 1 if k < 4 else -1)).alias("g")).agg(F.count("*").alias("n"))
            if k == ORDER - 1:
                own = settled(own)
            levels.append(own)
            at = own.select("lang", "g")
        self.single = settled(levels[-1])
        told = None
        for k, x in enumerate(levels):
            some = x.groupBy("lang").agg(F.lit(ORDER - k).alias("k"), F.count("*").alias("size"), *(F.sum((F.col("n") == c).cast("long")).alias(f"n{c}") for c in range(1, 5)))
            told = some if told is None else told.unionByName(some)
        self.cuts: dict[str, list] = {}
        sizes = {}
        for r in sorted(told.collect(), key=lambda r: (r.lang, r.k)):  # five rows a language
            self.cuts.setdefault(r.lang, []).append(discounts((r.n1, r.n2, r.n3, r.n4)))
            sizes[r.lang] = r["size"]  # of the highest order, the last one told
        self.loads: list[list[tuple[str, int, int]]] = []
        room = 0
        for lang, size in sorted(sizes.items(), key=lambda x: (x[1], x[0])):
            blocks = -(-size // load)
            if blocks > 1:
                self.loads += [[(lang, b, blocks)] for b in range(blocks)]
                room = 0
                continue
            if size > room:
                self.loads.append([])
                room = load
            self.loads[-1].append((lang, 0, 1))
            room -= size

    def models(self, load: list[tuple[str, int, int]]) -> dict[str, tuple[Model, int, int]]:
        """The models of a load, by language, with its block and number of blocks."""
        langs = [x[0] for x in load]
        chosen = self.counts.where(F.col("lang").isin(langs))
        _, block, blocks = load[0]
        if blocks > 1:
            chosen = chosen.where(block_of(F.col("lo"), blocks) == block)
        found, single = chosen.toArrow(), self.single.where(F.col("lang").isin(langs)).toArrow()
        out = {}
        for lang, block, blocks in load:
            own, chars = (t.filter(pc.equal(t["lang"], lang)) for t in (found, single))
            column = lambda t, c, kind: t[c].to_numpy().astype(kind, copy=False)
            last, first = column(own, "lo", np.int64).view(np.uint64), column(own, "hi", np.int64).view(np.uint64)
            out[lang] = (Model(first, last, column(own, "n", np.int64), self.cuts[lang], column(chars, "g", np.int64).view(np.uint64), column(chars, "n", np.int64)), block, blocks)
        return out


def train(docs: DataFrame, load: int = LOAD) -> Trained:
    """Counts of the text and lang of every document, by language."""
    return Trained(docs, load)


def _repeats(words: Words) -> np.ndarray:
    """Words of each document that stand in an 8-word window which occurs twice or more in it."""
    grams8 = window_hashes(words.hashes(lower=False), REPEAT_WINDOW)
    out = np.zeros(len(words.first) - 1, np.int64)
    for d in np.flatnonzero(np.diff(words.first) > REPEAT_WINDOW):
        a, z = int(words.first[d]), int(words.first[d + 1])
        own = grams8[a : z - REPEAT_WINDOW + 1]
        order = np.sort(own)
        if not (same := order[1:][order[1:] == order[:-1]]).size:
            continue
        out[d] = covered(z - a, np.flatnonzero(np.isin(own, same)), REPEAT_WINDOW).sum()
    return out


def _duplicate_lines(raw: bytes) -> int:
    lines = [x for x in raw.split(b"\n") if x.strip()]
    return len(lines) - len(set(lines))


#: What a scan tells of a document: counts for the rules, and sums of log probabilities so far.
TOLD_COLUMNS = {"n_words": LongType(), "word_chars": LongType(), "n_symbols": LongType(), "n_dup_lines": LongType(), "n_repeat_words": LongType(), "n_scored": LongType(), "sum": DoubleType(), "squares": DoubleType()}


def _rules(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    words = Words(data, offsets, NOT_SPACE)
    chunk = words.data
    points = np.concatenate([[0], np.cumsum(~_CONTINUES[chunk] & NOT_SPACE[chunk])])[words.bounds]
    marks = np.concatenate([[0], np.cumsum(_SYMBOL[chunk])])[words.bounds]
    raw, b = chunk.tobytes(), words.bounds.tolist()
    duplicates = np.array([_duplicate_lines(raw[i:j]) for i, j in zip(b, b[1:], strict=False)], np.int64)
    return [np.diff(words.first), np.diff(points), np.diff(marks), duplicates, _repeats(words)]


def _scorer(held, schema: pa.Schema, text: int, lang: int, fresh: bool):
    """Adds a load's log probabilities to the last columns of each row, or makes them if fresh."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models: dict[str, tuple[Model, int, int]] = held.value
        for whole in batches:
            named = pa.RecordBatch.from_arrays([*whole.columns], [f"c{i}" for i in range(whole.num_columns)])
            for batch, data, offsets in rows(iter([named]), f"c{text}", CHUNK):
                n = batch.num_rows
                first, last, bounds = grams(data, offsets)
                sizes = np.diff(bounds)
                owner = np.repeat(np.arange(n), sizes)
                langs = np.array(batch.column(lang).cast(pa.string()).fill_null("").to_pylist(), object)
                logp = np.zeros(len(first))
                for name in dict.fromkeys(langs.tolist()):
                    if name not in models:
                        continue
                    model, block, blocks = models[name]
                    own = np.flatnonzero((langs == name)[owner])
                    if blocks > 1:
                        own = own[block_of(last[own], blocks) == block]
                    _, at, kind = np.unique(hashed(first[own], last[own]), return_index=True, return_inverse=True)
                    logp[own] = model.score(first[own][at], last[own][at])[kind]
                sums, squares = (np.concatenate([[0.0], np.cumsum(x)])[bounds] for x in (logp, logp * logp))
                more = [np.diff(sums), np.diff(squares)]
                if fresh:
                    columns = [*batch.columns, *(pa.array(x, pa.int64()) for x in (*_rules(data, offsets), sizes)), *map(pa.array, more)]
                else:
                    columns = [*batch.columns[:-2], *(pa.array(batch.column(batch.num_columns - 2 + k).to_numpy() + x) for k, x in enumerate(more))]
                yield pa.RecordBatch.from_arrays(columns, schema.names)

    return score


def prefix_of(columns: list[str]) -> str:
    """What the added columns' names begin with: nothing that a column of the caller's has."""
    out = "__"
    while any(c.lower().startswith(out) for c in columns):
        out += "_"
    return out


def measured(docs: DataFrame, trained: Trained, without: tuple[str, ...] = ()) -> tuple[DataFrame, str]:
    """docs (without some columns) with what the rules and the models tell, under names with a prefix that is returned too."""
    p = prefix_of(docs.columns)
    schema = StructType([*docs.schema.fields, *(StructField(p + c, t) for c, t in TOLD_COLUMNS.items())])
    names = [c.lower() for c in docs.columns]
    out, fresh = docs, True
    loads = trained.loads or [[]]
    for k, load in enumerate(loads):
        held = docs.sparkSession.sparkContext.broadcast(trained.models(load) if load else {})
        shape = pa.schema([(f.name, pa.null()) for f in schema])
        out = out.mapInArrow(_scorer(held, shape, names.index("text"), names.index("lang"), fresh), schema)
        out = settled(out.drop(*without) if k == len(loads) - 1 else out)  # rows are written for the next load, or once
        held.destroy()
        fresh = False
    n, w, total = (F.col(p + c) for c in ("n_scored", "n_words", "sum"))
    some, own = w > 0, F.greatest(F.col(p + "squares") / n - (total / n) * (total / n), F.lit(0.0))
    told = {"log_ppl": -total / n, "log_ppl_word": F.try_divide(-total, w), "variance": own, "variance_word": F.try_divide(own * n, w)}
    out = out.withColumns({p + c: F.when(some, x) for c, x in told.items()}).drop(p + "sum", p + "squares")
    return out.withColumn(p + "lang", F.coalesce(F.col("lang").cast("string"), F.lit(""))), p


def base_failed(p: str = ""):
    return (F.col(f"{p}n_words") < 20) | (100 * F.col(f"{p}n_repeat_words") > 30 * F.col(f"{p}n_words"))


#: The measures that have a band: log perplexity, its variance, and of how many parts it is the mean.
MEASURES = (("log_ppl", "variance", "n_scored"), ("log_ppl_word", "variance_word", "n_words"))


def _deviation(band: Column, p: str, k: int):
    """How far a document lies from the middle of its band, in the spread expected at its length."""
    value, _, size = MEASURES[k]
    between = (band["q"][2] - band["q"][0]) / 1.349
    spread = F.sqrt(between * between + F.lit(CLUSTERING) * band["v"] / F.col(p + size))
    return F.when(spread > 0, (F.col(p + value) - band["q"][1]) / spread).otherwise(F.lit(0.0))


def bands(scored: DataFrame, p: str = "") -> DataFrame:
    """For each language and measure: band0 and band1, with the middle, what the spread is made of, and the edges.

    The edges are calibrated on the deviations of all documents that pass the base rules: BAND times the standard
    deviation that the quartile on that side tells. Up to a quarter of outliers on a side can't move it far.
    """
    own = scored.where(~base_failed(p)).where(F.col(p + "log_ppl").isNotNull()).select(F.col(p + "lang").alias("of"), *dict.fromkeys(p + c for m in MEASURES for c in m))
    quartiles = lambda x: F.percentile_approx(x, [0.25, 0.5, 0.75], 10000)
    first = own.groupBy("of").agg(*(x for k, (value, variance, _) in enumerate(MEASURES) for x in (quartiles(p + value).alias(f"q{k}"), F.percentile_approx(p + variance, 0.5, 10000).alias(f"v{k}"))))
    first = settled(first.select("of", *(F.struct(F.col(f"q{k}").alias("q"), F.col(f"v{k}").alias("v")).alias(f"band{k}") for k in range(2))))
    second = own.join(first, "of").groupBy("of").agg(F.count("*").alias("n"), *(x for k in range(2) for x in (F.first(f"band{k}").alias(f"band{k}"), quartiles(_deviation(F.col(f"band{k}"), p, k)).alias(f"z{k}"))))
    reach = F.lit(BAND / 0.6745) * (1 + FEW / F.col("n"))

    def edged(k: int) -> Column:
        z = F.col(f"z{k}")
        return F.struct(f"band{k}.q", f"band{k}.v", (z[1] - reach * (z[1] - z[0])).alias("below"), (z[1] + reach * (z[2] - z[1])).alias("above")).alias(f"band{k}")

    return settled(second.select("of", edged(0), edged(1)))


def judged(scored: DataFrame, found: DataFrame, p: str = "") -> DataFrame:
    """scored with kept: whether a document passes the base rules and lies in both bands of its language."""
    beside = scored.join(found.select(F.col("of").alias(p + "of"), *(F.col(f"band{k}").alias(f"{p}band{k}") for k in range(2))), F.col(p + "lang") == F.col(p + "of"), "left")
    kept = ~base_failed(p)
    for k in range(2):
        band = F.col(f"{p}band{k}")
        kept = kept & F.coalesce(_deviation(band, p, k).between(band["below"], band["above"]), F.lit(True))
    return beside.withColumn(p + "kept", kept).drop(p + "of", p + "band0", p + "band1")


def assess(docs: DataFrame, load: int = LOAD) -> DataFrame:
    """doc_id, lang, the rules' counts, n_scored, log_ppl, base_failed and kept of each document."""
    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("lang").cast("string").alias("lang"))
    scored, p = measured(chosen, train(chosen, load), ("text",))
    out = judged(scored, bands(scored, p), p)
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_scored", "log_ppl", "log_ppl_word")
    return out.select("doc_id", "lang", *(F.col(p + c).alias(c) for c in names), base_failed(p).alias("base_failed"), F.col(p + "kept").alias("kept"))


def keep(docs: DataFrame, load: int = LOAD) -> DataFrame:
    """The rows of docs that are kept, with all their columns. They are written once beside their scores, so that each is scored once."""
    scored, p = measured(docs, train(docs, load))
    return judged(scored, bands(scored, p), p).where(F.col(p + "kept")).select(*(F.col(f"`{c}`") for c in docs.columns))


def op8_quality_rules(spark, sf_dir: str) -> DataFrame:
    return assess(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("n_scored", "lang")
