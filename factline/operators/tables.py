"""Tables of intermediate rows in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where it is unset, a folder of our own in local mode, and an error on a cluster."""
    given = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if given:
        return given.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
    if not _OWN:
        _OWN.append("file://" + tempfile.mkdtemp(prefix="factline-"))
    return _OWN[0]


def saved(df: DataFrame, tag: str) -> DataFrame:
    """``df`` written as a table and read back: lineage is cut, and a lost executor costs no earlier round."""
    path = f"{shared_folder(df.sparkSession)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.saved_at = path
    return out


def dropped(*frames: DataFrame) -> None:
    """Delete the tables behind frames that ``saved`` gave and that nothing reads any more; others are left."""
    for frame in frames:
        name = frame.__dict__.get("saved_at")
        if name:
            path = frame.sparkSession._jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(frame.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
