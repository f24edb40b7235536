"""Tables that are written before they are read on: the lineage ends there."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame


def _folder(df: DataFrame) -> str:
    """The shared folder of spark.checkpoint.dir; one of our own only where none is set and all runs in one process."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        told = sc.getConf().get("spark.checkpoint.dir")
        if not told and not re.match(r"local(\[|$)", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(told or tempfile.mkdtemp(prefix="siftline-"))
    return sc.getCheckpointDir()


def kept(df: DataFrame) -> DataFrame:
    """df as written to the shared folder."""
    _folder(df)
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """df as compressed Parquet in the shared folder, deleted when the driver ends: for large tables, of which kept would
    write each row as it lies in memory, and small ones whose size decides a join."""
    spark = df.sparkSession
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{_folder(df)}/stored-{uuid.uuid4().hex}")
    df.write.option("compression", "zstd").parquet(path.toString())
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(path)
    return spark.read.schema(df.schema).parquet(path.toString())


def spent(df: DataFrame) -> None:
    """Deletes what ``stored`` has written, once all that is made of it has been written too."""
    sc = df.sparkSession.sparkContext
    for path in {sc._jvm.org.apache.hadoop.fs.Path(f).getParent().toString() for f in df.inputFiles()}:
        if re.search(r"/stored-[0-9a-f]{32}$", path):
            at = sc._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(sc._jsc.hadoopConfiguration()).delete(at, True)
