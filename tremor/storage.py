"""Tables that one step writes and later steps read, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL = "tremor.local.checkpoint"


def shared_dir(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir.  Only a local session may go without that setting
    (tests): it then gets a folder of its own."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get(_LOCAL, None)
    if not root:
        if not (spark.sparkContext.master or "").startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="spark-tremor-")
        spark.conf.set(_LOCAL, root)
    return f"{root.rstrip('/')}/{uuid.uuid4().hex}"


def written(df: DataFrame, name: str = "part") -> DataFrame:
    """The rows of df, written as Parquet now and read from there: computed once, whoever reads them
    how often, and safe from lost executors."""
    path = f"{shared_dir(df.sparkSession)}/{name}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
