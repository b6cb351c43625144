"""Session helpers: scratch storage that outlives executors, lineage cuts."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def workspace(spark: SparkSession) -> str:
    """Shared folder for checkpoints and intermediate tables.

    The cluster names it in ``spark.checkpoint.dir``; where that is unset, it is a
    folder of the session's warehouse, which all executors share as well.
    """
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get(
        "spark.checkpoint.dir", None
    )
    current = sc.getCheckpointDir()
    if configured:
        if current is None:
            sc.setCheckpointDir(configured)
        return configured
    if current:
        return current
    folder = f"{spark.conf.get('spark.sql.warehouse.dir', None).rstrip('/')}/_scratch"
    sc.setCheckpointDir(folder)
    return folder


def own_folder(spark: SparkSession) -> str:
    """The part of the workspace that holds this application's intermediate tables."""
    return f"{workspace(spark).rstrip('/')}/candor-{spark.sparkContext.applicationId}"


def release(spark: SparkSession) -> None:
    """Delete this application's intermediate tables; frames that read them are then void."""
    path = spark._jvm.org.apache.hadoop.fs.Path(own_folder(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the workspace."""
    return f"{own_folder(spark)}/{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder and read it from there."""
    workspace(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as a Parquet table in the workspace and read it from there.

    For wide intermediate results that several readers use a few columns of each, and for vectors, which take a fraction
    of a checkpoint's space in it.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
