"""Session helpers shared by the operators: shared folder, written tables, sizes."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """Folder named by ``spark.checkpoint.dir``; a temporary one only where none is set, in local mode: executors elsewhere could not see it."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="groundling-")
        spark.sparkContext.setCheckpointDir(named)
        named = spark.sparkContext.getCheckpointDir()
    return named.rstrip("/")


def unused(df: DataFrame, name: str) -> str:
    """``name``, or the first of name_1, name_2 ... that no column has; names are compared without case, as Spark does."""
    have = {c.lower() for c in df.columns}
    return next(n for n in (name, *(f"{name}_{i}" for i in range(1, len(have) + 2))) if n.lower() not in have)


def making_room(df: DataFrame, name: str) -> DataFrame:
    """``df`` ready for a result column ``name``: an input column of that name stays under the first free name of ``unused``."""
    clash = [c for c in df.columns if c.lower() == name.lower()]
    return df.withColumnRenamed(clash[0], unused(df, name)) if clash else df


def written(df: DataFrame) -> DataFrame:
    """Cut the lineage of ``df``: write it as Parquet in the shared folder and read it back.

    The files go when the Python process ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/groundling/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    atexit.register(_remove, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def _remove(spark: SparkSession, path: str) -> None:
    try:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session has ended first; the folder is the cluster's to clear
        return


def text_bytes(df: DataFrame, text_col: str) -> int:
    """Bytes of all texts: one scan, used to size partitions by the input."""
    return df.agg(F.sum(F.octet_length(text_col))).first()[0] or 0


def connected(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) for ``edges`` (a, b): the least node reachable.

    Alternating large-star and small-star rounds, each written to the shared folder, until
    nothing changes; the rounds grow with the logarithm of the number of nodes. A hub's
    neighbours are aggregated by partial ``min``, never gathered in one task.
    """
    mark = lambda e: tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    e = written(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    was = mark(e)
    for _ in range(max_rounds):
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("s")).select("s.*")
        e = written(small.where("u <> v").distinct())
        now = mark(e)
        if now == was:
            break
        was = now
    else:
        raise RuntimeError(f"components have not settled in {max_rounds} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component"))
