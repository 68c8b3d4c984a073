"""Places that all executors share, and lineage cuts that survive the loss of any of them."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; where it is unset and all runs in one process, a folder made for the session."""
    if not (found := spark.conf.get("spark.checkpoint.dir", None)):
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="genolith-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def settled(df: DataFrame) -> DataFrame:
    """The rows of df, written once to the shared folder and reread, so that no later stage computes them again."""
    path = f"{shared_dir(df.sparkSession)}/genolith/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clear(spark: SparkSession) -> None:
    """Remove all that was settled in the shared folder; frames that still read it are lost."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/genolith")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: Rows of an Arrow batch: of documents, so that a batch is some megabytes in the JVM and in a worker.
BATCH_ROWS = 1000


def ship(spark: SparkSession) -> None:
    """Give executors this package, once for each SparkContext, and keep Arrow batches small where the session has no size of its own."""
    sc = spark.sparkContext
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(setting)) > BATCH_ROWS:
        spark.conf.set(setting, str(BATCH_ROWS))
    if getattr(sc, "_genolith_shipped", False):
        return
    package = Path(__file__).resolve().parents[1]
    archive = Path(tempfile.mkdtemp(prefix="genolith-")) / "genolith-package.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for p in sorted(package.rglob("*.py")):
            z.write(p, p.relative_to(package.parent))
    sc.addPyFile(str(archive))
    sc._genolith_shipped = True
