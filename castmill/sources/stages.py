"""Stages of longer plans, written once to the folder that driver and executors share and read back from there."""

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def stage_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a folder of our own only on a single machine whose session names none."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        path = tempfile.mkdtemp(prefix="castmill-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def written(df: DataFrame) -> DataFrame:
    """df from files: what reads it repeats nothing that made it, and a lost executor costs none of it."""
    path = f"{stage_dir(df.sparkSession)}/castmill/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
