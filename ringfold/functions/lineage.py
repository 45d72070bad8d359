"""Cutting lineage in iterative jobs, through storage every executor sees."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``.

    Only a local session may fall back to a folder of its own: on a cluster a
    machine-local path would be lost with its machine.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder")
        folder = f"{tempfile.gettempdir()}/ringfold-steps"
    return folder.rstrip("/")


def step_folder(spark: SparkSession) -> str:
    """Where this application writes its step tables."""
    return f"{shared_folder(spark)}/ringfold-{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{step_folder(spark)}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str = "step") -> DataFrame:
    """Write ``df`` once as a table in the shared folder and read it back."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def clear_steps(spark: SparkSession) -> None:
    """Delete this application's step tables, once its results are written."""
    path = spark._jvm.org.apache.hadoop.fs.Path(step_folder(spark))
    system = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    system.delete(path, True)
