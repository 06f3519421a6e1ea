"""The folder all executors share, and tables that cut lineage there."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a local folder only where it is unset and all
    tasks run on this machine. On a cluster it has to be set."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="blocksearch-")
        sc.setCheckpointDir(found)
    return found.rstrip("/")


def fixed(df: DataFrame) -> DataFrame:
    """``df`` checkpointed: rows that depend on an order of tasks can't turn out
    otherwise later, and a lost executor costs a read of files."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame, spark: SparkSession | None = None) -> DataFrame:
    """The same as a table of files, of another session if one is given. A
    checkpoint keeps the constraints of the plan that made it, which double from
    round to round of a loop; files keep none, and are packed."""
    spark = spark or df.sparkSession
    path = f"{shared_dir(spark)}/rounds-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
