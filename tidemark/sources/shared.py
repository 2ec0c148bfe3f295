"""The one shared folder that executors and driver both see."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session, or the checkpoint folder that was set on its context.

    Where both are unset, a local master (tests) gets a temporary folder once; a cluster, whose machines would
    each write to their own, raises.
    """
    sc = spark.sparkContext
    path = sc.getConf().get("spark.checkpoint.dir")
    if path:
        return path.rstrip("/")
    known = getattr(sc, "_tidemark_dir", None)
    if known is None:
        known = sc.getCheckpointDir()
        if known is None:
            if not sc.master.split("[")[0] == "local":
                raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
            known = "file://" + tempfile.mkdtemp(prefix="tidemark-")
        sc._tidemark_dir = known = known.rstrip("/")
    return known


def scratch(spark: SparkSession, name: str) -> str:
    """A path of its own in a folder under the shared one that goes when the application ends."""
    sc = spark.sparkContext
    top = getattr(sc, "_tidemark_scratch", None)
    if top is None:
        top = sc._tidemark_scratch = f"{shared_dir(spark)}/tidemark-{sc.applicationId}"
        path = sc._jvm.org.apache.hadoop.fs.Path(top)
        fs = path.getFileSystem(sc._jsc.hadoopConfiguration())
        fs.mkdirs(path)
        fs.deleteOnExit(path)
    return f"{top}/{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: later steps read files that survive a lost executor."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint(eager=True)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, read back."""
    spark = df.sparkSession
    path = scratch(spark, name)
    schema = df.schema
    df.write.parquet(path)
    return spark.read.schema(schema).parquet(path)
