"""Benchmark decontamination: a broadcast hash set of normalised test n-grams against every training window.

Words are runs of digits, letters a-z (A-Z lower-cased) and non-ASCII characters. A window is 13 consecutive words of
a benchmark item; an item of fewer words, but not none, is one window. Every window of every whole document is hashed;
hits of the hash set are verified on the words themselves. Rolling hashes cost the same for any window length.

The hash set is broadcast, up to max_windows windows. A larger benchmark is a stated query set: it is taken in blocks
of items, each scanned against all rows with its own broadcast, and the results of a row are merged by its key.

Defined cases. Null or empty text, or one without words: no words, no hits. Null item text: no window. Repeated items
(same item_id or same text) each count by their item_id. Null item_id: its windows hit words, but it is no item.
Repeated documents: each row gets its own result. Empty benchmark: no hits. An empty documents table: no rows.
Other columns are carried only by `remove`, under their own names.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import settled
from .text import ALNUM, LOWER, Words, covered, rows, window_hashes

WINDOW = 13
#: Windows that one broadcast may hold: 13 words each, about 150 MB in a worker at most.
MAX_WINDOWS = 500_000
#: Bits of the table that a window's hash must pass before it is looked up.
FILTER_BITS = 22

SCHEMA = "doc_id long, row_key long, n_words long, hit_starts array<long>, hit_ends array<long>, items array<string>"


class TestSet:
    """Windows of benchmark items by length: their hashes, and for each its words and items."""

    def __init__(self, items: list[tuple[str | None, str | None]]):
        by_size: dict[int, dict[int, dict[bytes, set]]] = defaultdict(lambda: defaultdict(lambda: defaultdict(set)))
        for item, text in items:
            raw = np.frombuffer((text or "").encode(), np.uint8)
            words = Words(raw, np.array([0, len(raw)]), ALNUM)
            n = len(words.starts)
            if not n:
                continue
            size = min(WINDOW, n)
            for k, h in enumerate(window_hashes(words.hashes(lower=True), size).tolist()):
                by_size[size][h][joined(words, k, size)].add(item)
        self.windows = {size: {h: dict(x) for h, x in table.items()} for size, table in by_size.items()}
        self.filters = {}
        for size, table in self.windows.items():
            bits = np.zeros(1 << FILTER_BITS, bool)
            bits[np.fromiter(table, np.uint64, len(table)) >> np.uint64(64 - FILTER_BITS)] = True
            self.filters[size] = bits

    def hits(self, words: Words, hashes: np.ndarray, size: int) -> list[tuple[int, set]]:
        """Verified places where a window of this size starts, with its items."""
        table, found = self.windows[size], []
        grams = window_hashes(hashes, size)
        for k in np.flatnonzero(self.filters[size][grams >> np.uint64(64 - FILTER_BITS)]).tolist():
            if (texts := table.get(int(grams[k]))) is not None and (who := texts.get(joined(words, k, size))) is not None:
                found.append((k, who))
        return found


def joined(words: Words, k: int, size: int) -> bytes:
    return b" ".join(LOWER[words.data[words.starts[i] : words.ends[i]]].tobytes() for i in range(k, k + size))


def _scanner(test_set, doc_id: str, text: str):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tests: TestSet = test_set.value
        for batch, data, offsets in rows(batches, text):
            words = Words(data, offsets, ALNUM)
            hashes = words.hashes(lower=True)
            first = words.first
            runs: dict[int, list] = defaultdict(list)
            for size in tests.windows:
                for k, who in tests.hits(words, hashes, size):
                    d = int(np.searchsorted(first, k, "right")) - 1
                    if k + size <= first[d + 1]:  # not across documents
                        runs[d].append((k - int(first[d]), size, who))
            n = batch.num_rows
            starts, ends, items = [[]] * n, [[]] * n, [[]] * n
            for d, found in runs.items():
                at = np.zeros(int(first[d + 1] - first[d]), bool)
                for size in {x[1] for x in found}:
                    at |= covered(len(at), np.array([x[0] for x in found if x[1] == size]), size)
                edges = np.flatnonzero(np.diff(np.concatenate([[False], at, [False]])))
                starts[d], ends[d] = edges[::2].tolist(), edges[1::2].tolist()
                items[d] = sorted({i for x in found for i in x[2] if i is not None})
            get = lambda name: batch.column(batch.schema.get_field_index(name))
            yield pa.RecordBatch.from_arrays(
                [get(doc_id).cast(pa.int64()), get("row_key"), pa.array(np.diff(first), pa.int64()), pa.array(starts, pa.list_(pa.int64())), pa.array(ends, pa.list_(pa.int64())), pa.array(items, pa.list_(pa.string()))],
                ["doc_id", "row_key", "n_words", "hit_starts", "hit_ends", "items"],
            )

    return scan


def scan(docs: DataFrame, benchmark: DataFrame, text: str = "text", doc_id: str = "doc_id", item_id: str = "item_id", max_windows: int = MAX_WINDOWS) -> DataFrame:
    """A row for each document: doc_id, n_words, hit_starts and hit_ends (runs of hit words, end exclusive), items (sorted as strings)."""
    sized = benchmark.select(F.col(item_id).cast("string").alias("item"), F.col("text").alias("t"))
    blocks = _blocks(sized, max_windows)
    source = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), (F.monotonically_increasing_id() if blocks > 1 else F.lit(0)).cast("long").alias("row_key"))
    # rows are written first where several blocks must find them under the same keys
    found = _merged(settled(source) if blocks > 1 else source, sized, blocks)
    return found.drop("row_key")


def _blocks(sized: DataFrame, max_windows: int) -> int:
    """In how many blocks the items (item, t) are taken, by their windows."""
    words = F.regexp_count(F.translate("t", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"))
    windows = sized.select(words.alias("n")).where("n > 0").agg(F.sum(F.greatest(F.col("n") - (WINDOW - 1), F.lit(1)))).first()[0] or 0
    return max(1, -(-windows // max_windows))


def _merged(source: DataFrame, sized: DataFrame, blocks: int) -> DataFrame:
    """The hits of all blocks of a benchmark (item, t) in source (doc_id, text, row_key), merged by row_key."""
    results = []
    for k in range(blocks):
        part = sized.where(F.pmod(F.xxhash64("t"), F.lit(blocks)) == k) if blocks > 1 else sized
        tests = source.sparkSession.sparkContext.broadcast(TestSet([(r.item, r.t) for r in part.collect()]))
        results.append(source.mapInArrow(_scanner(tests, "doc_id", "text"), SCHEMA))
    if blocks == 1:
        return results[0]
    every = results[0]
    for more in results[1:]:
        every = every.unionByName(more)
    runs = every.groupBy("row_key").agg(
        F.first("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"),
        F.array_sort(F.flatten(F.collect_list(F.arrays_zip("hit_starts", "hit_ends")))).alias("runs"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
    )
    merged = F.aggregate(
        "runs", F.array().cast("array<struct<hit_starts:bigint,hit_ends:bigint>>"),
        lambda out, x: F.when((F.size(out) > 0) & (F.element_at(out, -1)["hit_ends"] >= x["hit_starts"]),
            F.concat(F.slice(out, F.lit(1), F.size(out) - 1), F.array(F.struct(F.element_at(out, -1)["hit_starts"].alias("hit_starts"), F.greatest(F.element_at(out, -1)["hit_ends"], x["hit_ends"]).alias("hit_ends")))),
        ).otherwise(F.concat(out, F.array(x))),
    )
    return runs.withColumn("runs", merged).select("doc_id", "row_key", "n_words", F.col("runs.hit_starts").alias("hit_starts"), F.col("runs.hit_ends").alias("hit_ends"), "items")


def judged(found: DataFrame) -> DataFrame:
    """n_hit, and whether a twentieth of the words or more is hit."""
    n_hit = F.aggregate(F.arrays_zip("hit_starts", "hit_ends"), F.lit(0).cast("long"), lambda a, x: a + x["hit_ends"] - x["hit_starts"])
    return found.withColumn("n_hit", n_hit).withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def _cut(raw: bytes, starts: list[int], ends: list[int]) -> bytes:
    words = Words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), ALNUM)
    pieces, last = [], 0
    for s, e in zip(starts, ends, strict=True):
        pieces.append(raw[last : words.starts[s]])
        last = words.ends[e - 1]
    return b"".join([*pieces, raw[last:]])


def _without(batch: pa.RecordBatch, at: int, found: Iterator[tuple[int, list, list]]) -> pa.RecordBatch:
    """The batch without contaminated rows, hits cut from column `at`; found has the words and hit runs of each row."""
    texts, keep = batch.column(at).to_pylist(), []
    for k, (n, starts, ends) in enumerate(found):
        hit = sum(ends) - sum(starts)
        keep.append(not (hit and 20 * hit >= n))
        if hit and keep[-1]:
            texts[k] = _cut(texts[k].encode(), starts, ends).decode()
    columns = list(batch.columns)
    columns[at] = pa.array(texts, batch.schema.field(at).type)
    return pa.RecordBatch.from_arrays(columns, schema=batch.schema).filter(pa.array(keep, pa.bool_()))


def _cutter(test_set, text: str):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(text)
            keyed = pa.RecordBatch.from_arrays([pa.nulls(batch.num_rows, pa.int64()), pa.array(np.zeros(batch.num_rows, np.int64)), batch.column(at)], ["doc_id", "row_key", "text"])
            yield _without(batch, at, (x for out in _scanner(test_set, "doc_id", "text")(iter([keyed])) for x in zip(*(out.column(c).to_pylist() for c in (2, 3, 4)), strict=True)))

    return cut


def _joined_cutter(text: str, columns: int):
    """Cuts by the last three columns: words and merged runs, null where a row has no hit."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = pa.RecordBatch.from_arrays(batch.columns[:columns], schema=pa.schema([batch.schema.field(i) for i in range(columns)]))
            found = zip(*(batch.column(columns + c).to_pylist() for c in range(3)), strict=True)
            yield _without(own, own.schema.get_field_index(text), ((n or 0, starts or [], ends or []) for n, starts, ends in found))

    return cut


def remove(docs: DataFrame, benchmark: DataFrame, text: str = "text", max_windows: int = MAX_WINDOWS) -> DataFrame:
    """The documents without contaminated ones; hit passages of the others are cut from their text. Columns are kept.

    A benchmark beyond max_windows is taken in blocks, all on the original text: their hits are merged by row, which is
    then judged once and cut once. The rows are written first, so that every block finds them under the same keys.
    """
    sized = benchmark.select(F.col("item_id").cast("string").alias("item"), F.col("text").alias("t"))
    blocks = _blocks(sized, max_windows)
    if blocks == 1:
        tests = docs.sparkSession.sparkContext.broadcast(TestSet([(r.item, r.t) for r in sized.collect()]))
        return docs.mapInArrow(_cutter(tests, text), docs.schema)
    keyed = settled(docs.withColumn("__row", F.monotonically_increasing_id()))
    source = keyed.select(F.lit(None).cast("long").alias("doc_id"), F.col(text).alias("text"), F.col("__row").alias("row_key"))
    found = _merged(source, sized, blocks).where(F.size("hit_starts") > 0)
    found = found.select(F.col("row_key").alias("__row"), F.col("n_words").alias("__n"), F.col("hit_starts").alias("__starts"), F.col("hit_ends").alias("__ends"))
    beside = keyed.join(found, "__row", "left").select(*(F.col(f"`{c}`") for c in docs.columns), "__n", "__starts", "__ends")
    return beside.mapInArrow(_joined_cutter(text, len(docs.columns)), docs.schema)


def op2_decontaminate(spark, sf_dir: str) -> DataFrame:
    found = judged(scan(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), "contaminated")


OP2_SQL = r"""
WITH dw AS (
  SELECT row_number() OVER () AS k, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
bw AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bg AS (
  SELECT item_id, least(13, len(w)) AS n, unnest(list_transform(range(1, len(w) - least(13, len(w)) + 2), lambda i: array_to_string(w[i:i + least(13, len(w)) - 1], ' '))) AS g FROM bw WHERE len(w) > 0),
sizes AS (SELECT DISTINCT n FROM bg),
dg AS (
  SELECT k, n, unnest(range(1, len(w) - n + 2)) AS i, unnest(list_transform(range(1, len(w) - n + 2), lambda i: array_to_string(w[i:i + n - 1], ' '))) AS g FROM dw, sizes WHERE len(w) >= n),
hit AS (SELECT k, dg.n, i, item_id FROM dg JOIN bg ON dg.g = bg.g AND dg.n = bg.n),
hw AS (SELECT k, count(DISTINCT j) AS n_hit FROM (SELECT k, unnest(range(i, i + n)) AS j FROM (SELECT DISTINCT k, i, n FROM hit)) GROUP BY k),
hi AS (SELECT k, count(DISTINCT item_id) AS n_items, array_to_string(list_sort(list(DISTINCT CAST(item_id AS VARCHAR))), ',') AS items FROM hit GROUP BY k)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM dw LEFT JOIN hw USING (k) LEFT JOIN hi USING (k)
"""
