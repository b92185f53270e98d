"""Streams of pings: an extension beyond batch lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import grid


def with_admin(pings: DataFrame, admin: DataFrame) -> DataFrame:
    """Stream-static join: each ping with the names of its cell."""
    keyed = pings.withColumns({"cy": grid.cell_y(F.col("lat_micro")), "cx": grid.cell_x(F.col("lon_micro"))})
    return keyed.join(admin, ["cy", "cx"], "left")


def counts(pings: DataFrame, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Pings by cell and time window; rows later than ``late`` are left out and their state is dropped."""
    keyed = pings.withColumn("cell", grid.cell(F.col("lat_micro"), F.col("lon_micro"))).withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return keyed.groupBy(F.window("ts", window), "cell").agg(F.count("*").alias("n"), F.approx_count_distinct("user_id").alias("users")).select(F.col("window.start").alias("start"), "cell", "n", "users")
