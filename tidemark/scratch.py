"""Tables that an operator reads more than once: written to the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``. Unset in a local session: make one; elsewhere an error, as a folder of one machine
    loses what the others write."""
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        d = f"file://{tempfile.mkdtemp(prefix='tidemark-')}"
        spark.conf.set("spark.checkpoint.dir", d)
    return d.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """The frame written and read back: computed once, short lineage, survives lost executors.

    Joins with it are merges: its size on disk, packed by column, says little of its rows, and Spark would collect
    millions of them on the driver to broadcast them.
    """
    path = f"{shared_dir(df.sparkSession)}/tidemark/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path).hint("merge")
