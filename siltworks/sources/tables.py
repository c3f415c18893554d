"""Tables written to the folder that all machines share: they cut long plans and survive lost executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """A new folder under ``spark.checkpoint.dir``. Where that's unset, a local session takes one of its own; a cluster must name it."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        root = tempfile.mkdtemp(prefix="siltworks-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/tables-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """The rows of ``df``, read from a table to which they're written now."""
    where = shared_folder(df.sparkSession)
    df.write.parquet(where)
    return df.sparkSession.read.schema(df.schema).parquet(where)


def spread(rows: DataFrame, each: int = 3) -> DataFrame:
    """The rows dealt evenly to ``each`` tasks a core. A file's splits go by its compressed bytes, so small files that need much work a row would leave most cores idle."""
    return rows.repartition(each * rows.sparkSession.sparkContext.defaultParallelism)
