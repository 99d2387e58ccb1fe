"""Session-level helpers: table loading, lineage cuts, checked broadcasts."""

from __future__ import annotations

import atexit
import io
import os
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table `name` of the data directory `sf_dir` (a parquet file or a folder of them)."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Make this package importable in the Python workers, wherever the driver found it: it is added
    to the session as a zip file, once."""
    sc = spark.sparkContext
    if getattr(sc, "_provgraph_shipped", False):
        return
    here = Path(__file__).resolve().parent
    content = io.BytesIO()
    with zipfile.ZipFile(content, "w") as z:
        for path in sorted(here.rglob("*.py")):
            z.write(path, str(path.relative_to(here.parent)))
    folder = tempfile.mkdtemp(prefix="provgraph-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    file = Path(folder) / "provgraph.zip"
    file.write_bytes(content.getvalue())
    sc.addPyFile(str(file))  # the driver serves it to the executors
    sc._provgraph_shipped = True


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: that of spark.checkpoint.dir. Only where it is unset and
    the master is local (tests, a laptop) a temporary folder is made."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = sc.getConf().get("spark.checkpoint.dir")
        if not folder:
            if not sc.master.startswith("local[") and sc.master != "local":
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix=f"provgraph-{os.getpid()}-")
            atexit.register(shutil.rmtree, folder, ignore_errors=True)
        sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Materialise `df` and cut its lineage with a reliable checkpoint."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """`df` written to the shared folder as a table and read from there. Like `cut`, but computed once and
    by one job, where a checkpoint counts the rows before it writes them: for loops of small steps.
    See `release`."""
    path = f"{shared_folder(df.sparkSession)}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, key: str, buckets: int, by: str | None = None) -> DataFrame:
    """`df` written to the shared folder as a table in `buckets` buckets of `key`, sorted by it, and
    partitioned by `by`: joins of such tables on the key need neither exchange nor sort, and a filter
    on `by` reads only its part. Each bucket (of each part) is one file, so the order within a bucket
    is known; the session is told to rely on it. See `release`."""
    spark = df.sparkSession
    name = f"provgraph_{uuid.uuid4().hex}"
    spread = df.repartition(buckets, key)
    spread = spread.sortWithinPartitions(*([by] if by else []), key)
    writer = spread.write.format("parquet").bucketBy(buckets, key).sortBy(key).option("path", f"{shared_folder(spark)}/{name}")
    (writer.partitionBy(by) if by else writer).saveAsTable(name)
    spark.conf.set("spark.sql.legacy.bucketedTableScan.outputOrdering", "true")
    _written(spark).append(name)
    return spark.table(name)


def _written(spark: SparkSession) -> list[str]:
    sc = spark.sparkContext
    if not hasattr(sc, "_provgraph_written"):
        sc._provgraph_written = []
    return sc._provgraph_written


def release(spark: SparkSession) -> None:
    """Delete the tables and checkpoints this library has written in the session. Call it when the
    results that were made from them have been used. (Spark deletes single checkpoints earlier where
    spark.cleaner.referenceTracking.cleanCheckpoints is set.)"""
    sc = spark.sparkContext
    folder = sc.getCheckpointDir()
    if folder is None:
        return
    for name in _written(spark):
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    _written(spark).clear()
    path = sc._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)
    sc.setCheckpointDir(os.path.dirname(folder.rstrip("/")))


def broadcast_if_small(df: DataFrame, max_rows: int) -> DataFrame:
    """`df` with a broadcast hint if it has at most `max_rows` rows (checked by a count that stops
    there), else unchanged, so that the planner joins by shuffle."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df
