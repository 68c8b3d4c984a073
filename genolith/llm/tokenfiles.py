"""Token-id files: documents in ascending doc_id order, as range-coded segments (see rangecoder) in Parquet containers.

Documents are dealt by ranges of doc_id; each task encodes its range in order and writes segments of about SEGMENT ids
through Spark's own committed writer, so a lost executor costs its tasks only and any store that Spark reaches will do.
A row of a file holds part (the range), segment (its place there) and data. Reading decodes segments independently;
the ids before a document are those before its part, before its segment there, and before it in the segment.

Defined cases. Null or empty text: the end id alone. Null doc_id: first in order. Repeated doc_id: in an order of
their own, each with its ids. A text of any length is one document (a segment is closed behind it). Ids of any tokenizer up
to 2**32 - 1. Empty table: no segments, no rows. Only doc_id and text are read.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .rangecoder import read_segment, write_segment
from .shared import shared_dir
from .tokens import Encoder, default_path

END = 2
#: Ids of a segment: it is closed once it has as many.
SEGMENT = 8_000_000


def _writer(path: str, end: int, most: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, segment = Encoder.of(path), TaskContext.get().partitionId(), 0
        doc_ids, lengths, ids, held = [], [], [], 0

        def row():
            nonlocal doc_ids, lengths, ids, held, segment
            every, ids = np.concatenate(ids), []
            data = write_segment(doc_ids, np.concatenate(lengths), every)
            out = pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([segment], pa.int32()), pa.array([held], pa.int64()), pa.array([data], pa.binary())], ["part", "segment", "n_ids", "data"])
            doc_ids, lengths, held, segment = [], [], 0, segment + 1
            return out

        for batch in batches:
            names, at = batch.column(0).to_pylist(), 0
            for counts, own in encode.with_end(batch.column(1), end):
                doc_ids += names[at : at + len(counts)]
                at += len(counts)
                lengths.append(counts)
                ids.append(own)
                held += len(own)
                if held >= most:
                    yield row()
        if doc_ids:
            yield row()

    return write


def write(docs: DataFrame, to: str, text: str = "text", doc_id: str = "doc_id", path: str | None = None, end: int = END, segment: int = SEGMENT) -> None:
    """Write the token files of docs to a folder."""
    # rows of one doc_id are told apart by where they come from, so that a frequent doc_id is dealt to many parts
    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), F.monotonically_increasing_id().alias("tie"))
    dealt = source.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "text")
    dealt.mapInArrow(_writer(path or default_path(), end, segment), "part int, segment int, n_ids long, data binary").write.parquet(to)


def _read(with_ids: bool):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                part, segment, data = (batch.column(i)[k].as_py() for i in range(3))
                doc_ids, lengths, ids = read_segment(data)
                wide = ids.astype("<u4", copy=False)
                ends = np.cumsum(lengths)
                starts = ends - lengths
                own = [wide[a:z].tobytes() for a, z in zip(starts.tolist(), ends.tolist(), strict=True)]
                n = len(doc_ids)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part] * n, pa.int32()), pa.array([segment] * n, pa.int32()), pa.array(doc_ids, pa.int64()), pa.array(starts, pa.int64()), pa.array(lengths, pa.int64()), pa.array(map(zlib.crc32, own), pa.int64()), pa.array(own if with_ids else [None] * n, pa.binary())],
                    ["part", "segment", "doc_id", "at", "n_tokens", "ids_crc32", "ids"],
                )

    return read


def read(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 and (if asked for) ids of every document in the files."""
    files = spark.read.parquet(path)
    # one row a segment, summed by part and then within it, so that no task sees all of them
    parts = files.groupBy("part").agg(F.sum("n_ids").alias("n"))
    earlier = parts.withColumn("before_part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("part", "before_part")
    inside = Window.partitionBy("part").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    before = files.select("part", "segment", F.coalesce(F.sum("n_ids").over(inside), F.lit(0)).alias("before")).join(earlier, "part").select("part", "segment", (F.col("before") + F.col("before_part")).alias("before"))
    held = files.select("part", "segment", "data").mapInArrow(_read(with_ids), "part int, segment int, doc_id long, at long, n_tokens long, ids_crc32 long, ids binary")
    return held.join(before, ["part", "segment"]).select("doc_id", (F.col("before") + F.col("at")).alias("start"), "n_tokens", "ids_crc32", "ids")


def op9_token_files(spark, sf_dir: str) -> DataFrame:
    to = f"{shared_dir(spark)}/genolith/tokens-{uuid.uuid4().hex}"
    write(spark.read.parquet(f"{sf_dir}/documents.parquet"), to)
    return read(spark, to).drop("ids")
