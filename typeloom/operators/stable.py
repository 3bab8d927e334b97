"""The cluster's shared folder, and lineage cut there."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where none is set, a folder below the warehouse, if driver and executors are one process, else an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not (spark.sparkContext.master + "[").startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/checkpoints"
    return found.rstrip("/")


def place(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{folder(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """df with its lineage cut: written as Parquet in the shared folder and read back, so that its size is that of its files.

    A checkpoint instead hands on the size estimated for its plan. Rounds of joins multiply these estimates with each other, and their digits, which double with
    each round, fill the driver's memory. Columns go by place, as names may repeat; what Parquet cannot hold (columns without a type, intervals) is checkpointed."""
    spark = df.sparkSession
    if any(t in df.schema.simpleString() for t in ("void", "interval")):
        if not spark.sparkContext.getCheckpointDir():
            spark.sparkContext.setCheckpointDir(folder(spark))
        return df.checkpoint()
    path, plain = place(spark, "cut"), df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    plain.write.parquet(path)
    return spark.read.schema(plain.schema).parquet(path).toDF(*df.columns)
