"""Written intermediate tables in the folder that all executors share."""

from __future__ import annotations

import sys
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; a temporary folder only in a local session that has none."""
    path = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    held = sys.__dict__.setdefault("_skein_folders", {})
    app = spark.sparkContext.applicationId
    if app not in held:
        held[app] = "file://" + tempfile.mkdtemp(prefix="skein-")
    return held[app]


def written(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and reread it, which cuts its lineage."""
    path = f"{shared_dir(df.sparkSession)}/skein/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
