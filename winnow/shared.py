"""The folder that the driver and all executors see."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; where that is unset, one of our own, which only a local master can use."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="winnow-")
        spark.conf.set("spark.checkpoint.dir", root)
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """df with its lineage cut by a checkpoint in the shared folder."""
    shared_root(df.sparkSession)
    return df.checkpoint()


def kept(df: DataFrame, name: str) -> DataFrame:
    """df written once as a table in the shared folder and read back: its lineage ends there, and its rows are read by column."""
    path = f"{shared_root(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clear(spark: SparkSession, *names: str) -> int:
    """Delete the tables that operators left in the shared folder (those whose names start with one of `names`, or all
    of ours: a name, a dash and 32 hexadecimal digits); how many went. Only for when no query needs them any more."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(shared_root(spark))
    store = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    ours = re.compile(rf"(?:{'|'.join(map(re.escape, names)) or '[a-z-]+'})-[0-9a-f]{{32}}")
    found = [f.getPath() for f in (store.listStatus(root) if store.exists(root) else []) if ours.fullmatch(f.getPath().getName())]
    return sum(store.delete(path, True) for path in found)
