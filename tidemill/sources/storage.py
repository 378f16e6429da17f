"""Places that the driver and all executors share, and what is written there.

Everything that has to outlive a stage goes to the folder named by
``spark.checkpoint.dir``; a lost executor costs no more than the tasks it was
running. Only where a session names no such folder (tests, a notebook) a
temporary one is made.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def shared_root(spark: SparkSession) -> str:
    """The shared folder's URI, without a slash at its end."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        app = spark.sparkContext.applicationId
        if app not in _own:
            _own[app] = "file://" + tempfile.mkdtemp(prefix="tidemill-")
        root = _own[app]
    return root.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"


def save(df: DataFrame, name: str) -> DataFrame:
    """Writes df once as Parquet in the shared folder and returns the stored table.

    It cuts the lineage, and what follows reads only the columns it needs.
    """
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
