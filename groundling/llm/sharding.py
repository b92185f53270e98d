"""Contiguous shards of near-equal bytes from a global prefix sum of sizes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._spark import written

LOW_BITS = 33  # monotonically_increasing_id keeps the row's place in its partition there


def shard_by_bytes(docs: DataFrame, n_shards: int = 8, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Put every row of ``docs`` into shards 0..n_shards-1, contiguous in input order.

    Returns ``keep`` and size (UTF-8 bytes + 1), text_crc32, shard, slot (place in its shard, from
    0) and start_byte (global prefix sum before the row). A row goes where its first byte
    falls when the total is cut at n_shards equal targets, so a shard's bytes differ from the
    target by less than the largest row.

    Per-partition totals are one row a partition; only these are summed in order in one task.
    The prefix inside a partition is a window over that partition's rows, so equal keys or texts
    never meet in one task. Sizes and places are written once, so a lost executor cannot renumber.

    Null text: size 1, crc 0. Repeated rows and null ids: rows of their own. Empty table: no rows.
    Other columns are left out, whatever their names.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    names = [f"_k{i}" for i in range(len(keep))]
    rows = written(
        docs.select(
            *[F.col(c).alias(n) for c, n in zip(keep, names, strict=True)],
            (F.octet_length(text).cast("long") + 1).alias("_size"),
            F.crc32(text.cast("binary")).alias("_crc"),
            F.monotonically_increasing_id().alias("_id"),
        )
    )
    rows = rows.withColumns({"_part": F.shiftright("_id", LOW_BITS), "_at": F.col("_id").bitwiseAND((1 << LOW_BITS) - 1)})
    totals = rows.groupBy("_part").agg(F.sum("_size").alias("_bytes"), F.count("*").alias("_rows"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    starts = totals.select(
        "_part",
        F.coalesce(F.sum("_bytes").over(before), F.lit(0)).alias("_bytes0"),
        F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_rows0"),
        F.sum("_bytes").over(everything).alias("_total"),
    )
    inside = Window.partitionBy("_part").orderBy("_at")
    placed = (
        rows.withColumns({
            "_sum": F.sum("_size").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_size"),
            "_row": F.row_number().over(inside) - 1,
        })
        .join(starts, "_part")
        .withColumns({"_start": F.col("_bytes0") + F.col("_sum"), "_place": F.col("_rows0") + F.col("_row")})
        .withColumn("_shard", F.expr(f"CAST((CAST(_start AS DECIMAL(38,0)) * {n_shards}) div _total AS INT)"))
    )
    placed = written(placed.select(*names, "_size", "_crc", "_shard", "_place", "_start"))
    heads = placed.groupBy("_shard").agg(F.min("_place").alias("_first"))
    return placed.join(F.broadcast(heads), "_shard").select(  # one row a shard
        *[F.col(n).alias(c) for c, n in zip(keep, names, strict=True)],
        F.col("_size").alias("size"),
        F.col("_crc").alias("text_crc32"),
        F.col("_shard").alias("shard"),
        (F.col("_place") - F.col("_first")).alias("slot"),
        F.col("_start").alias("start_byte"),
    )
