"""Incremental ingestion of Parquet dumps from a landing folder, an extension: rows of a batch replace those of their key."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..sources.tables import replace_ingestion


def follow(spark: SparkSession, landing: str, target: str, checkpoint: str, schema: StructType, key: list[str]) -> StreamingQuery:
    """Take what has landed and stop. Rows of an ingestion may land in any number of batches: the ones of a key that came last stay.

    An ingestion is written anew with what it already has, from a copy beside the checkpoint, so that a batch that is
    taken twice gives the same rows.
    """

    def put(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        fresh = batch.dropDuplicates(key)
        staged = f"{checkpoint}/staged/{number}"
        folder = session._jvm.org.apache.hadoop.fs.Path(target)
        if folder.getFileSystem(session._jsc.hadoopConfiguration()).exists(folder):
            held = session.read.schema(schema).parquet(target).join(fresh.select("ingest_id").distinct(), "ingest_id", "left_semi").select(*batch.columns)
            fresh = held.join(fresh.select(*key).distinct(), key, "left_anti").select(*batch.columns).unionByName(fresh)
        fresh.write.mode("overwrite").parquet(staged)
        replace_ingestion(session.read.schema(schema).parquet(staged), target)

    return spark.readStream.schema(schema).parquet(landing).writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
