"""Near duplicates by HyperMinHash: compressed registers, banding, a collision-corrected estimate, then exact sets.

A document's set is its distinct 2-word shingles (words split at ASCII white space, A-Z lower-cased), as 64-bit
hashes. Documents of equal sets form a class; from there on one document stands for its class. The first 8 bits of a
shingle's hash choose one of 256 buckets, and a bucket keeps its smallest hash compressed to the number of leading
zeros (6 bits) and 10 mantissa bits. Empty buckets borrow from others in an order that all documents share. 51 bands
of 5 registers make candidates: two sets of similarity 0.8 miss all bands once in 10^9 pairs. The Jaccard estimate
from unborrowed registers, corrected for chance collisions of compressed registers, drops a candidate only when it
lies six standard deviations below the threshold; what remains is confirmed on the full sets.

No bucket is expanded into all its pairs. Every member is first compared with the bucket's smallest member; linked
ones form components. Buckets that still hold several components are the rest: the documents that share such buckets
are gathered in clusters, a cluster is dealt into blocks of a bounded number of shingles, and each pair of blocks
counts common shingles from an inverted index and tells only links between components. So no link is lost, no pair of
documents is ever a row, and no task holds more than two blocks. A class of any number of copies is one row.

Defined cases. Null, empty or wordless text: an empty set, linked with nothing, a component of its own, kept. One
word: the word is the one shingle. Null doc_id: the row gets the component of its class, which is null where no row of
the class has an id; it is kept only then. Rows that share a doc_id count as one document: they are linked when any of
their texts are. Ties can't matter: components don't depend on the order of rows. Empty table: no rows. Texts of any
length are used whole. Only doc_id and text are read; `keep` returns all columns under their own names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import components
from .shared import settled
from .text import NOT_SPACE, Words, mix, rows, window_hashes

BUCKETS, MANTISSA = 256, 10
BANDS, ROWS = 51, 5
#: Shingles of a block in which the documents of crowded buckets are compared.
BLOCK_SHINGLES = 250_000
#: Document ids that may be broadcast to pick the texts of candidates; more are joined by a shuffle.
BROADCAST_IDS = 2_000_000
#: Percent of the union that two sets share at least.
THRESHOLD = 80
#: Standard deviations by which an estimate may fall short of the threshold.
SLACK = 6.0
#: Chance that registers of two unrelated sets agree: a sum over leading-zero counts of squared shares, over the mantissa values.
COLLISION = 0.169919487159739093975315012348 / (1 << MANTISSA)

SIGNED = "doc_id long, n_shingles long, cls binary, regs binary"


def shingles(words: Words, hashes: np.ndarray, d: int, pairs: np.ndarray) -> np.ndarray:
    """The sorted distinct shingle hashes of document d of a chunk."""
    a, z = int(words.first[d]), int(words.first[d + 1])
    if z - a < 2:
        return window_hashes(hashes[a:z], 1)
    return np.unique(pairs[a : z - 1])


def registers(docs: int, owner: np.ndarray, least: np.ndarray) -> np.ndarray:
    """uint16 registers of documents: 0 empty, else leading zeros + 1 above the mantissa."""
    rest = (least << np.uint64(8)) | np.uint64(1)
    zeros = (64 - np.frexp(rest.astype(np.float64))[1]).clip(0, 55).astype(np.uint64)
    mantissa = (rest << (zeros + np.uint64(1))) >> np.uint64(64 - MANTISSA)
    out = np.zeros((docs, BUCKETS), np.uint16)
    out[owner, (least >> np.uint64(56)).astype(np.int64)] = ((zeros + np.uint64(1)) << np.uint64(MANTISSA) | mantissa).astype(np.uint16)
    return out


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, data, offsets in rows(batches):
        words = Words(data, offsets, NOT_SPACE)
        hashes = words.hashes(lower=True)
        pairs = window_hashes(hashes, 2)
        sizes, classes, owner, least = [], [], [], []
        for d in range(batch.num_rows):
            own = shingles(words, hashes, d, pairs)
            sizes.append(len(own))
            classes.append(hashlib.blake2b(own.tobytes(), digest_size=16).digest() if len(own) else None)
            bucket = own >> np.uint64(56)
            at = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(own) else []
            owner.append(np.full(len(at), d))
            least.append(own[at])
        made = registers(batch.num_rows, np.concatenate(owner), np.concatenate(least)) if owner else np.zeros((0, BUCKETS), np.uint16)
        regs = [x.tobytes() if n else None for x, n in zip(made, sizes, strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("doc_id")), pa.array(sizes, pa.int64()), pa.array(classes, pa.binary()), pa.array(regs, pa.binary())], ["doc_id", "n_shingles", "cls", "regs"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, data, offsets in rows(batches):
        words = Words(data, offsets, NOT_SPACE)
        hashes = words.hashes(lower=True)
        pairs = window_hashes(hashes, 2)
        own = [shingles(words, hashes, d, pairs) for d in range(batch.num_rows)]
        ends = np.concatenate([[0], np.cumsum([len(x) for x in own])]).astype(np.int32)
        values = pa.array((np.concatenate(own) if own else np.zeros(0, np.uint64)).view(np.int64))
        yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("doc_id")), pa.ListArray.from_arrays(pa.array(ends), values)], ["cid", "items"])


_PROBES = 64


def densified(regs: np.ndarray) -> np.ndarray:
    """Registers in which empty buckets hold another's value, found by a sequence of probes that depends on the bucket alone."""
    out, empty = regs.copy(), regs == 0
    for t in range(1, _PROBES):
        todo = np.flatnonzero(empty.any(1))
        if not len(todo):
            return out
        probe = (mix(np.arange(BUCKETS, dtype=np.uint64) + np.uint64(t * BUCKETS)) >> np.uint64(56)).astype(np.int64)
        take = np.where(empty[todo], regs[todo][:, probe], 0)
        out[todo] = np.where(empty[todo] & (take > 0), take, out[todo])
        empty[todo] &= take == 0
    start = (mix(np.arange(BUCKETS, dtype=np.uint64)) >> np.uint64(56)).astype(np.int64)
    for d in np.flatnonzero(empty.any(1)):  # few full buckets: the next one from a place of the bucket's own
        full = np.flatnonzero(regs[d])
        if len(full):
            own = np.flatnonzero(empty[d])
            out[d, own] = regs[d, full[np.searchsorted(full, start[own]) % len(full)]]
    return out


def _band(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(0, batch.num_rows, 2000):
            part = batch.slice(i, 2000)
            regs = np.frombuffer(b"".join(part.column(1).to_pylist()), np.uint16).reshape(part.num_rows, BUCKETS)
            full = densified(regs)[:, : BANDS * ROWS].reshape(part.num_rows, BANDS, ROWS).astype(np.uint64)
            key = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), full.shape[:2])
            for k in range(ROWS):
                key = mix(key * np.uint64(0x9E3779B97F4A7C15) + full[:, :, k] + np.uint64(1))
            cid = np.repeat(part.column(0).to_numpy(zero_copy_only=False), BANDS)
            yield pa.RecordBatch.from_arrays([pa.array(cid, pa.int64()), pa.array(key.reshape(-1).view(np.int64))], ["cid", "key"])


def estimate(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Jaccard estimates of register rows, corrected for chance collisions, and how many buckets each rests on."""
    used = ((a > 0) | (b > 0)).sum(1)
    same = ((a == b) & (a > 0)).sum(1)
    return (same / np.maximum(used, 1) - COLLISION) / (1 - COLLISION), used


def _likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        a, b = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint16).reshape(-1, BUCKETS) for k in (4, 5))
        j, used = estimate(a, b)
        t = THRESHOLD / 100
        yield batch.select([0, 1, 2, 3]).filter(pa.array(j >= t - SLACK * np.sqrt(t * (1 - t) / np.maximum(used, 1))))


def enough(a: Column, b: Column, shared: Column) -> Column:
    return 100 * shared >= THRESHOLD * (a + b - shared)


def sets_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """cid, items: the full sets of the documents whose doc_id is among ids."""
    ids = settled(ids)
    few = ids.count() <= BROADCAST_IDS
    return docs.join(F.broadcast(ids) if few else ids, "doc_id", "left_semi").mapInArrow(_sets, "cid long, items array<long>")


def cross_links(ids: np.ndarray, comps: np.ndarray, side: np.ndarray, sizes: np.ndarray, items: np.ndarray) -> list[tuple[int, int]]:
    """Links between documents of different components, enough to join all components that any link joins.

    items: the sets one after the other; side: whether a document is of the first (0) or second (1) block. If both
    occur only pairs across are compared.
    """
    _, shingle = np.unique(items, return_inverse=True)
    owner = np.repeat(np.arange(len(ids)), sizes)
    order = np.argsort(shingle, kind="stable")
    holders = owner[order]
    count = np.bincount(shingle)
    first = np.concatenate([[0], np.cumsum(count)])
    ends = np.cumsum(sizes)
    names, comp = np.unique(comps, return_inverse=True)
    parent = np.arange(len(names))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = int(parent[x])
        return x

    out = []
    across = 0 < int(side.sum()) < len(side)
    most = int(np.argmax(np.bincount(comp)))  # pairs within the largest component need no look
    for x in np.flatnonzero(comp != most):
        own = shingle[ends[x] - sizes[x] : ends[x]]
        n = count[own]
        at = np.repeat(first[own] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        shared = np.bincount(holders[at], minlength=len(ids))
        good = 100 * shared >= THRESHOLD * (sizes[x] + sizes - shared)
        good &= comp != comp[x]
        if across:
            good &= side != side[x]
        for y in np.flatnonzero(good):
            a, b = root(int(comp[x])), root(int(comp[y]))
            if a != b:
                parent[max(a, b)] = min(a, b)
                out.append((int(ids[x]), int(ids[y])))
    return out


def crowded_links(at: DataFrame, reps: DataFrame, docs: DataFrame) -> DataFrame | None:
    """Links (a, b) between components that meet in a bucket of three or more. at: key, cid, hub, comp."""
    mixed = at.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("size")).where("lo < hi and size > 2").select("key")
    near = settled(at.join(mixed, "key", "left_semi").select("cid", "hub", "comp").distinct())
    if not near.limit(1).count():
        return None
    clusters = components(near.where("cid <> hub").select(F.col("cid").alias("a"), F.col("hub").alias("b")).distinct())
    member = near.groupBy("cid").agg(F.first("comp").alias("comp")).join(clusters.select(F.col("node").alias("cid"), F.col("comp").alias("cluster")), "cid").join(reps.select("cid", "n"), "cid")
    member = settled(member)
    blocks = member.groupBy("cluster").agg(F.ceil(F.sum("n") / BLOCK_SHINGLES).cast("int").alias("blocks"), F.countDistinct("comp").alias("comps")).where("comps > 1").drop("comps")
    dealt = member.join(blocks, "cluster").withColumn("block", F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int"))
    sets = sets_of(docs, dealt.select(F.col("cid").alias("doc_id")).distinct())
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    paired = dealt.join(sets, "cid").withColumn("other", other).select("cluster", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "cid", "comp", "items")

    def compare(frame):
        import pandas as pd

        items = frame["items"].tolist()
        found = cross_links(frame["cid"].to_numpy(), frame["comp"].to_numpy(), (frame["block"] != frame["i"]).to_numpy().astype(int), np.array([len(x) for x in items]), np.concatenate(items))
        return pd.DataFrame(found, columns=["a", "b"])

    return settled(paired.groupBy("cluster", "i", "j").applyInPandas(compare, "a long, b long"))


def verified(pairs: DataFrame, reps: DataFrame, docs: DataFrame) -> DataFrame:
    """Those pairs (a, b) of class representatives whose full sets are similar enough."""
    side = lambda c: reps.select(F.col("cid").alias(c), F.col("n").alias(f"n{c}"), F.col("regs").alias(f"regs{c}"))
    could = pairs.join(side("a"), "a").join(side("b"), "b").where((100 * F.col("na") >= THRESHOLD * F.col("nb")) & (100 * F.col("nb") >= THRESHOLD * F.col("na")))
    likely = settled(could.select("a", "b", "na", "nb", "regsa", "regsb").mapInArrow(_likely, "a long, b long, na long, nb long").distinct())
    sets = sets_of(docs, likely.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct())
    one = likely.join(sets.withColumnsRenamed({"cid": "a", "items": "ia"}), "a")
    two = one.join(sets.withColumnsRenamed({"cid": "b", "items": "ib"}), "b")
    shared = F.size(F.array_intersect("ia", "ib"))
    return settled(two.where(enough(F.size("ia"), F.size("ib"), shared)).select("a", "b").distinct())


def labelled(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row."""
    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    signed = settled(source.mapInArrow(_sign, SIGNED))
    reps = settled(signed.where("cls is not null").groupBy("cls").agg(F.min("doc_id").alias("cid"), F.first("n_shingles").alias("n"), F.first("regs").alias("regs")).where("cid is not null"))
    bands = reps.select("cid", "regs").mapInArrow(_band, "cid long, key long").repartition("key")
    hubs = bands.groupBy("key").agg(F.min("cid").alias("hub"), F.max("cid").alias("last")).where("hub < last").select("key", "hub")
    crowded = settled(bands.join(hubs, "key").select("key", "cid", "hub"))
    links = verified(crowded.where("cid <> hub").select(F.col("hub").alias("a"), F.col("cid").alias("b")).distinct(), reps, source)
    comps = components(links)
    at = crowded.join(comps.select(F.col("node").alias("cid"), "comp"), "cid", "left").select("key", "cid", "hub", F.coalesce("comp", "cid").alias("comp")).distinct()
    more = crowded_links(settled(at), reps, source)
    if more is not None and more.limit(1).count():
        comps = components(links.unionByName(more))
    of = reps.select("cls", "cid").join(comps.select(F.col("node").alias("cid"), "comp"), "cid", "left").select("cls", F.coalesce("comp", "cid").alias("comp"))
    component = F.coalesce("comp", "doc_id")
    return signed.select("doc_id", "n_shingles", "cls").join(of, "cls", "left").select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, component.isNull()).alias("kept"))


def keep(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The rows of docs that are kept, one document of each component."""
    gone = labelled(docs, text, doc_id).where("not kept").select(F.col("doc_id").alias("__gone")).distinct()
    return docs.join(gone, F.col(doc_id).cast("long") == F.col("__gone"), "left_anti")


def op7_near_duplicates(spark, sf_dir: str) -> DataFrame:
    return labelled(spark.read.parquet(f"{sf_dir}/documents.parquet"))


_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
OP7_SQL = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOW}, '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 1 THEN w ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS s FROM w),
classes AS (SELECT list_sort(s) AS k, min(doc_id) AS cid, len(any_value(s)) AS n FROM s WHERE len(s) > 0 GROUP BY 1),
items AS MATERIALIZED (SELECT cid, n, unnest(k) AS g FROM classes),
shared AS (SELECT a.cid AS a, b.cid AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS c FROM items a JOIN items b ON a.g = b.g AND a.cid < b.cid AND 100 * a.n >= 80 * b.n AND 100 * b.n >= 80 * a.n GROUP BY 1, 2),
links AS MATERIALIZED (SELECT a, b FROM shared WHERE 100 * c >= 80 * (na + nb - c) UNION ALL SELECT b, a FROM shared WHERE 100 * c >= 80 * (na + nb - c)),
reach AS (SELECT cid AS node, cid AS comp FROM classes UNION SELECT links.b, reach.comp FROM reach JOIN links ON links.a = reach.node),
comps AS (SELECT node, min(comp) AS comp FROM reach GROUP BY node)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, coalesce(comp, s.doc_id) AS component_id, coalesce(comp, s.doc_id) = s.doc_id AS kept
FROM s LEFT JOIN classes ON list_sort(s.s) = classes.k LEFT JOIN comps ON comps.node = classes.cid
"""
