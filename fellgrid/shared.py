"""The folder that driver and executors share, for tables that cut lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def work_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session, else the context's checkpoint folder.

    Where neither is set, a temporary folder does if driver and executors are one process on this machine; on a
    cluster that is an error, as executors would not see one another's files.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = getattr(spark, "_fellgrid_work", None)
        if base is None:
            base = spark._fellgrid_work = tempfile.mkdtemp(prefix="fellgrid")
    return base.rstrip("/")


def table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends here, and a lost executor loses nothing."""
    path = f"{work_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._fellgrid_path = path
    return out


def drop(df: DataFrame) -> None:
    """Delete the files behind a written table that nothing reads any more."""
    jvm = df.sparkSession._jvm
    path = jvm.org.apache.hadoop.fs.Path(df._fellgrid_path)
    path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
