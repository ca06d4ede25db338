"""A fresh folder that all executors share, for files that a query writes and reads again."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession, name: str) -> str:
    """Below the folder that the cluster names in ``spark.checkpoint.dir``; only a local session without that setting takes a local one."""
    top = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not top:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        top = f"file://{tempfile.gettempdir()}/fidelis"
    return f"{top.rstrip('/')}/{name}-{uuid.uuid4().hex}"


#: Folders of ``stored`` that this driver has made and not yet deleted.
_STORED: list[str] = []


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in a shared folder: later reads see the same values, whichever order its sums were made in."""
    folder = shared_folder(df.sparkSession, name)
    _STORED.append(folder)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def clean(spark: SparkSession) -> None:
    """Deletes the tables of ``stored``: call it when results have been read or written."""
    while _STORED:
        path = spark._jvm.org.apache.hadoop.fs.Path(_STORED.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
