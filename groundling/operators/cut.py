"""Tables written between steps."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def cut(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet in the session's shared folder and read back, so that plans and their size estimates start anew: after checkpoint() the estimate goes on, and in rounds of
    joins its digits double until the driver has no memory. A temporary folder serves only where none is set, as in tests. The files go when the Python process ends."""
    spark, sc = df.sparkSession, df.sparkSession.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not folder:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="groundling-"))
        folder = sc.getCheckpointDir()
    path = f"{folder.rstrip('/')}/groundling/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    atexit.register(_remove, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def _remove(spark: SparkSession, path: str) -> None:
    try:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session has ended first; the folder is the cluster's to clear
        return
