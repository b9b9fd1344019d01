"""Exact positions in a total order without a single-partition window.

``row_number().over(Window.orderBy(...))`` with no partition key moves every row
into one task.  Instead: range-partition and sort (a distributed sort), tag each
row with ``monotonically_increasing_id`` (partition id in the high bits, offset
inside the partition in the low 33 bits), write it once so the numbering is fixed,
then add per-partition offsets from a table with one row per partition (its size
is the partition count, a known bound, so it is broadcast).
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize

_LOW_BITS = 33


def global_position(df: DataFrame, order_cols: list[Column], name: str = "position",
                    num_partitions: int | None = None, keep_parts: bool = False) -> DataFrame:
    """Add ``name`` = 1-based position of each row in ``order_cols`` order.

    ``order_cols`` must be a total order (end it with a unique key).  With
    ``keep_parts`` the number of the row's sorted part stays as ``_pid``."""
    spark = df.sparkSession
    n = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    sorted_df = (df.repartitionByRange(n, *order_cols)
                   .sortWithinPartitions(*order_cols)
                   .withColumn("_mid", F.monotonically_increasing_id()))
    # Materialise once: the offsets and the rows below must see the same
    # numbering, and the written table also cuts lineage for executor loss.
    fixed = materialize(sorted_df, "position")
    tagged = fixed.select("*", F.shiftright("_mid", _LOW_BITS).alias("_pid"),
                          F.col("_mid").bitwiseAND((1 << _LOW_BITS) - 1).alias("_off"))
    counts = tagged.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    offsets = counts.select(
        "_pid", (F.sum("_n").over(Window.orderBy("_pid")) - F.col("_n")).alias("_base"))
    return (tagged.join(F.broadcast(offsets), "_pid")
                  .withColumn(name, F.col("_base") + F.col("_off") + 1)
                  .drop(*([] if keep_parts else ["_pid"]), "_mid", "_off", "_base"))


def position_within(df: DataFrame, group_col: str, order_cols: list[Column],
                    name: str = "rank") -> DataFrame:
    """1-based position inside ``group_col``, also for huge groups: a global
    position minus each group's first position.

    The first positions are joined by sorted part and group, and written before, so
    that their size is known: a few travel to the rows, and where they are many the
    rows are dealt by parts too.  No task gets a whole group."""
    g = global_position(df, [F.col(group_col)] + list(order_cols), name="_gpos", keep_parts=True)
    parts = g.groupBy("_pid", group_col).agg(F.min("_gpos").alias("_start"))
    firsts = materialize(parts.join(parts.groupBy(group_col).agg(F.min("_start").alias("_first")), group_col)
                              .drop("_start"), "group-firsts")
    return (g.join(firsts, ["_pid", group_col])
             .withColumn(name, F.col("_gpos") - F.col("_first") + 1)
             .drop("_pid", "_gpos", "_first"))
