"""Pairwise KING-robust kinship from calls that differ from the reference, and missing ones.

With absence meaning a reference call, het/het and opposite-homozygote sites follow from counts of common sites by
inclusion and exclusion. Samples are dealt into blocks of bounded size; a tile, that is a pair of blocks, receives the
calls of the sites at which both blocks have some, adds them into tables of a tile's size as they stream by (rare sites
pair by pair, common ones by products of indicator matrices), and tells all its pairs. Memory is a tile's tables and a
batch, whatever the number of samples and sites, and no row is shuffled for a pair of samples. Declared pairs alone
(pedigrees) are answered from the calls of their samples.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import predicates as P
from .cohort import KEY
from .ranges import ranked, small

# Kinship bounds of the classes, and the share of opposite homozygotes below which first degree means parent and child.
DUPLICATE, FIRST, SECOND, THIRD, PARENT_IBS0 = 0.354, 0.177, 0.0884, 0.0442, 0.005


#: Most samples of a block (a tile has two tables of 8 bytes for each pair); the number of blocks of a smaller cohort, for tiles enough to share out; least samples of a block.
BLOCK_SAMPLES, BLOCKS, LEAST_SAMPLES = 1536, 12, 64
#: Partitions over which tiles are dealt, at most.
MOST_PARTITIONS = 2000
#: A site with more than this share of a tile's pairs is counted by products of matrices, so many sites at a time.
DENSE, DENSE_SITES = 0.01, 128
#: Pairs that are spelt out at a time, and rows that are told at a time.
PAIRS, ROWS = 1 << 18, 1 << 16


def usable_sites(variants: DataFrame, pass_only: bool = False, max_sites: int | None = None) -> DataFrame:
    """Biallelic single-base sites of numbered contigs; beyond max_sites, evenly thinned to as many."""
    sites = variants.where(P.is_autosome_like(F.col("chrom")) & P.is_snv())
    if pass_only:
        sites = sites.where(P.passed(F.col("filter")))
    sites = sites.select(*KEY).distinct()
    return sites if max_sites is None else thinned(sites, max_sites)


def thinned(sites: DataFrame, most: int) -> DataFrame:
    """`most` sites of each ingestion, spread evenly in the order of contig, position and alleles: those of rank floor(i * total / most)."""
    rank = ranked(sites, ["ingest_id"])
    total = sites.groupBy("ingest_id").agg(F.count("*").alias("__total"))
    step = (F.col("__rank") * most) % F.col("__total")
    return rank.join(small(total), "ingest_id").where((F.col("__total") <= most) | (step == 0) | (step > F.col("__total") - most)).select(*sites.columns)


#: How a call is written beside its sample's number, as number * 4 + code.
HET, HOM, GONE = 0, 1, 2
#: By the codes of two samples' calls: both het and both missing, 32 bits each; opposite homozygotes to be taken off and het against missing, likewise.
_SAME = np.zeros((4, 4), np.int64)
_SAME[HET, HET], _SAME[GONE, GONE] = 1, 1 << 32
_OFF = np.zeros((4, 4), np.int64)
_OFF[HOM, :3] += 1
_OFF[:3, HOM] += 1
_OFF[HET, GONE] = _OFF[GONE, HET] = 1 << 32


class _Tile:
    """Counts of common sites for all pairs of two blocks of samples, or of one with itself."""

    def __init__(self, own: dict):
        self.own, self.n = own, (len(own["left_ids"]), len(own["right_ids"]))
        self.same, self.off = (np.zeros(self.n[0] * self.n[1], np.int64) for _ in range(2))
        self.dense: list[tuple[np.ndarray, np.ndarray]] = []

    def add(self, left: pa.Array, right: pa.Array) -> None:
        """Lists of calls by site, of the left and of the right block."""
        (a, a_at), (b, b_at) = ((x.flatten().to_numpy(), np.concatenate(([0], np.cumsum(x.value_lengths().to_numpy())))) for x in (left, right))
        na, nb = np.diff(a_at), np.diff(b_at)
        common = na * nb > max(64, DENSE * self.n[0] * self.n[1])
        for s in np.nonzero(common)[0]:
            self.dense.append((a[a_at[s] : a_at[s + 1]], b[b_at[s] : b_at[s + 1]]))
            if len(self.dense) == DENSE_SITES:
                self.multiply()
        # the others: each left call with all right calls of its site
        calls = np.nonzero(np.repeat(~common, na))[0]
        site = np.repeat(np.arange(len(na)), na)[calls]
        until = np.cumsum(nb[site])
        begin = 0
        while begin < len(calls):
            done = until[begin - 1] if begin else 0
            end = max(begin + 1, int(np.searchsorted(until, done + PAIRS, "right")))
            n = nb[site[begin:end]]
            x = np.repeat(a[calls[begin:end]], n)
            y = b[np.repeat(b_at[site[begin:end]] - (until[begin:end] - n - done), n) + np.arange(int(n.sum()))]
            pair, codes = (x >> 2).astype(np.int64) * self.n[1] + (y >> 2), (x & 3, y & 3)
            np.add.at(self.off, pair, _OFF[codes])
            alike = np.nonzero(_SAME[codes])[0]
            np.add.at(self.same, pair[alike], _SAME[codes[0][alike], codes[1][alike]])
            begin = end

    def multiply(self) -> None:
        def indicators(side: int) -> list[np.ndarray]:
            out = np.zeros((3, self.n[side], len(self.dense)), np.float32)
            for s, calls in enumerate(self.dense):
                out[calls[side] & 3, calls[side] >> 2, s] = 1
            return [*out, out.sum(0)]

        (het, hom, gone, some), (het_, hom_, gone_, some_) = indicators(0), indicators(1)
        whole = lambda x: x.astype(np.int64).ravel()
        for table, low, high in ((self.same, ((het, het_),), ((gone, gone_),)), (self.off, ((hom, some_), (some, hom_)), ((het, gone_), (gone, het_)))):
            for (x, y), shift in [*((p, 0) for p in low), *((p, 32) for p in high)]:
                table += whole(x @ y.T) << shift
        self.dense = []

    def told(self) -> Iterator[pa.RecordBatch]:
        if self.dense:
            self.multiply()
        own, (n, m) = self.own, self.n
        ids = [pa.array(own[s], pa.string()) for s in ("left_ids", "right_ids")]
        (het, hom, gone), (het_, hom_, gone_) = (np.array(own[s], np.int64).reshape(-1, 3).T for s in ("left_counts", "right_counts"))
        step = max(1, ROWS // max(1, m))
        for at in range(0, n, step):
            x, y = (v.ravel() for v in np.mgrid[at : min(n, at + step), 0:m])
            if own["i"] == own["j"]:
                x, y = x[x < y], y[x < y]
            same, off = self.same[x * m + y], self.off[x * m + y]
            columns = {
                "n_sites": own["total"] - gone[x] - gone_[y] + (same >> 32), "hethet": same & 0xFFFFFFFF,
                # homozygous at one and reference at the other: neither het, hom nor missing there
                "ibs0": hom[x] + hom_[y] - (off & 0xFFFFFFFF), "het_pair": het[x] + het_[y] - (off >> 32),
            }
            yield pa.RecordBatch.from_pydict({"ingest_id": pa.array([own.get("ingest_id")], pa.string()).take(pa.array(np.zeros(len(x), np.int32))), "a": ids[0].take(pa.array(x)), "b": ids[1].take(pa.array(y)), **columns})


def _tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of tiles whose rows follow one another: first its samples, then the calls of its sites."""
    tile = None
    for batch in batches:
        begins = np.nonzero(batch["own"].to_numpy(zero_copy_only=False) != "")[0].tolist()
        for at, end in zip([0, *begins], [*begins, len(batch)], strict=True):
            if at in begins and at < end:
                if tile:
                    yield from tile.told()
                tile = _Tile(json.loads(batch["own"][at].as_py()))
                at += 1
            if at < end:
                tile.add(batch["left"].slice(at, end - at), batch["right"].slice(at, end - at))
    if tile:
        yield from tile.told()


def _calls(genotypes: DataFrame, missing: DataFrame, sites: DataFrame) -> DataFrame:
    """Calls at the sites that differ from the reference, with their code."""
    code = F.when(F.col("gt") == 1, HET).when(F.col("gt") == 2, HOM)
    calls = genotypes.where("gt > 0").join(sites, KEY, "left_semi").select(*KEY, "sample_id", code.alias("code"))
    return calls.unionByName(missing.join(sites, KEY, "left_semi").select(*KEY, "sample_id", F.lit(GONE).alias("code")).distinct())


def _singly(calls: DataFrame) -> DataFrame:
    """What a sample has by itself."""
    return calls.groupBy("ingest_id", "sample_id").agg(*(F.count_if(F.col("code") == c).alias(n) for c, n in ((HET, "het"), (HOM, "hom"), (GONE, "gone"))))


def _with_kinship(pairs: DataFrame) -> DataFrame:
    return pairs.withColumn("kinship", F.try_divide((F.col("hethet") - 2 * F.col("ibs0")).cast("double"), F.col("het_pair")))


def kinship(genotypes: DataFrame, missing: DataFrame, samples: DataFrame, sites: DataFrame) -> DataFrame:
    """A row for each pair of samples (a < b): n_sites, hethet, ibs0, het_pair and kinship."""
    every = _calls(genotypes, missing, sites)
    total = sites.groupBy("ingest_id").agg(F.count("*").alias("total"))
    known = samples.select("ingest_id", "sample_id").distinct()
    most = known.groupBy("ingest_id").count().agg(F.max("count")).first()[0] or 1
    size = min(BLOCK_SAMPLES, max(LEAST_SAMPLES, -(-most // BLOCKS)))
    blocks = -(-most // size)
    # blocks follow the order of names, so that samples that were named together share rare sites within few tiles
    no = F.row_number().over(Window.partitionBy("ingest_id").orderBy("sample_id")) - 1
    placed = known.withColumn("__no", no).select("ingest_id", "sample_id", F.floor(F.col("__no") / size).cast("int").alias("block"), (F.col("__no") % size).alias("no"))
    # a row for each tile: both blocks' samples in order
    member = F.struct("no", "sample_id", F.array(*(F.coalesce(c, F.lit(0)) for c in ("het", "hom", "gone"))).alias("counts"))
    block = placed.join(_singly(every), ["ingest_id", "sample_id"], "left").groupBy("ingest_id", "block").agg(F.array_sort(F.collect_list(member)).alias("m"))
    side = lambda s, b: block.select("ingest_id", F.col("block").alias(b), F.col("m.sample_id").alias(f"{s}_ids"), F.flatten("m.counts").alias(f"{s}_counts"))
    tiles = side("left", "i").join(side("right", "j"), "ingest_id").where("i <= j").join(F.broadcast(total), "ingest_id", "left").fillna(0, ["total"])
    # text, and empty lists: for a null list or struct Spark's Arrow writer goes over all rows of the batch before
    own = F.to_json(F.struct("ingest_id", "i", "j", "total", "left_ids", "right_ids", "left_counts", "right_counts"))
    none = F.array().cast("array<int>")
    # calls: one shuffle by site, then to each tile of which both blocks have some
    found = every.where("code is not null").join(small(placed), ["ingest_id", "sample_id"]).repartition(*KEY)
    by_block = found.groupBy(*KEY, "block").agg(F.collect_set((F.col("no") * 4 + F.col("code")).cast("int")).alias("calls"))
    by_site = by_block.groupBy(*KEY).agg(F.collect_list(F.struct("block", "calls")).alias("own"))
    left = by_site.select("ingest_id", F.explode("own").alias("l"), "own")
    both = left.select("ingest_id", "l", F.explode(F.filter("own", lambda o: o["block"] >= F.col("l.block"))).alias("r"))
    rows = tiles.select("ingest_id", "i", "j", own.alias("own"), none.alias("left"), none.alias("right")).unionByName(
        both.select("ingest_id", F.col("l.block").alias("i"), F.col("r.block").alias("j"), F.lit("").alias("own"), F.col("l.calls").alias("left"), F.col("r.calls").alias("right"))
    )
    dealt = rows.repartition(min(MOST_PARTITIONS, blocks * (blocks + 1) // 2), "ingest_id", "i", "j").sortWithinPartitions("ingest_id", "i", "j", F.col("own") == "")
    schema = "ingest_id string, a string, b string, n_sites long, hethet long, ibs0 long, het_pair long"
    return _with_kinship(dealt.select("own", "left", "right").mapInArrow(_tiles, schema))


def relationship(kin: Column, ibs0: Column, n_sites: Column, het_pair: Column, least_hets: int = 20) -> Column:
    share = F.try_divide(ibs0.cast("double"), n_sites)
    return (
        F.when(kin.isNull() | (het_pair < least_hets), "insufficient-data").when(kin > DUPLICATE, "duplicate")
        .when((kin > FIRST) & (share < PARENT_IBS0), "parent-child").when(kin > FIRST, "full-siblings")
        .when(kin > SECOND, "second-degree").when(kin > THIRD, "third-degree").otherwise("unrelated")
    )


def classified(pairs: DataFrame) -> DataFrame:
    return pairs.withColumn("relationship", relationship(F.col("kinship"), F.col("ibs0"), F.col("n_sites"), F.col("het_pair")))


def kinship_of(asked: DataFrame, genotypes: DataFrame, missing: DataFrame, samples: DataFrame, sites: DataFrame) -> DataFrame:
    """As `kinship`, for the pairs (ingest_id, a, b; a < b) that are asked about and known; what is shuffled is the calls of their samples."""
    known = samples.select("ingest_id", "sample_id").distinct()
    asked = asked.select("ingest_id", "a", "b").where("a < b").distinct()
    for s in ("a", "b"):
        asked = asked.join(known.select("ingest_id", F.col("sample_id").alias(s)), ["ingest_id", s], "left_semi")
    member = asked.select("ingest_id", "a", "b", F.explode(F.array(F.struct(F.col("a").alias("sample_id"), F.lit(0).alias("side")), F.struct(F.col("b").alias("sample_id"), F.lit(1).alias("side")))).alias("m")).select("ingest_id", "a", "b", "m.*")
    every = _calls(genotypes, missing, sites).where("code is not null").join(small(member), ["ingest_id", "sample_id"])
    # bits of the codes that each of the two has at a site
    bits = lambda side: F.bit_or(F.when(F.col("side") == side, F.expr("shiftleft(1, code)")).otherwise(0))
    at = every.select("ingest_id", "a", "b", "chrom", "pos", "ref", "alt", "side", "code").groupBy("ingest_id", "a", "b", "chrom", "pos", "ref", "alt").agg(bits(0).alias("x"), bits(1).alias("y"))
    # by site: missing, het and hom of either
    n = lambda c: F.count_if(F.expr(c))
    has = lambda v, code: f"({v} & {1 << code}) <> 0"
    one = lambda v, w: [n(has(v, HET)) - n(f"{has(v, HET)} and {has(w, GONE)}"), n(f"{has(v, HOM)} and {w} = 0")]
    (het_a, only_a), (het_b, only_b) = one("x", "y"), one("y", "x")
    met = at.groupBy("ingest_id", "a", "b").agg(n(f"{has('x', GONE)} or {has('y', GONE)}").alias("gone"), n(f"{has('x', HET)} and {has('y', HET)}").alias("hethet"), (only_a + only_b).alias("ibs0"), (het_a + het_b).alias("het_pair"))
    total = sites.groupBy("ingest_id").agg(F.count("*").alias("total"))
    out = asked.join(met, ["ingest_id", "a", "b"], "left").join(F.broadcast(total), "ingest_id", "left").fillna(0)
    return _with_kinship(out.select("ingest_id", "a", "b", F.expr("total - gone").alias("n_sites"), "hethet", "ibs0", "het_pair"))


def declared(pedigree: DataFrame) -> DataFrame:
    """ingest_id, sample_id, role and parent."""
    each = pedigree.select("ingest_id", "sample_id", F.explode(F.array(F.struct(F.lit("father").alias("role"), F.col("father_id").alias("parent")), F.struct(F.lit("mother").alias("role"), F.col("mother_id").alias("parent")))).alias("x"))
    return each.select("ingest_id", "sample_id", "x.role", "x.parent").where("parent <> '0'")


def declared_pairs(pedigree: DataFrame) -> DataFrame:
    """The pairs of a sample and its parent, a < b."""
    return declared(pedigree).select("ingest_id", F.least("sample_id", "parent").alias("a"), F.greatest("sample_id", "parent").alias("b")).distinct()


def pedigree_check(pairs: DataFrame, pedigree: DataFrame, samples: DataFrame) -> DataFrame:
    """Each declared parent against the genotypes: ok, mismatch, insufficient data or not genotyped."""
    known = samples.select("ingest_id", F.col("sample_id").alias("parent")).distinct().withColumn("__known", F.lit(True))
    both = classified(pairs).select("ingest_id", F.col("a").alias("__a"), F.col("b").alias("__b"), "relationship")
    d = declared(pedigree).join(small(known), ["ingest_id", "parent"], "left").withColumn("__a", F.least("sample_id", "parent")).withColumn("__b", F.greatest("sample_id", "parent")).join(both, ["ingest_id", "__a", "__b"], "left")
    state = F.when(F.col("__known").isNull(), "not genotyped").when(F.col("relationship").isNull() | (F.col("relationship") == "insufficient-data"), "insufficient data").when(F.col("relationship") == "parent-child", "ok").otherwise("mismatch")
    return d.select("ingest_id", "sample_id", "role", "parent", "relationship", state.alias("state"))
