"""Ranking, top-k and dense numbering without single-task windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedloom.session import stage


def ranked(df: DataFrame, by, order: list[Column], name: str = "rank") -> DataFrame:
    """1-based dense position inside each ``by`` group."""
    by = [by] if isinstance(by, str) else list(by)
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))


def top_per(df: DataFrame, by, order: list[Column], k: int, name: str = "rank") -> DataFrame:
    """First ``k`` rows of each group.

    The ``<= k`` filter plans as a group limit on both sides of the shuffle, so a
    group holding a third of all rows sends at most k rows per map task.
    """
    return ranked(df, by, order, name).filter(F.col(name) <= F.lit(int(k)))


def range_numbered(df: DataFrame, order: list[Column], label: str) -> DataFrame:
    """Globally sorted copy with ``_part`` (range number) and ``_pos`` (0-based place in it).

    The copy is written out, so both numbers are the same for every later reader.
    """
    mid = F.monotonically_increasing_id()
    out = (
        df.orderBy(*order)
        .withColumn("_mid", mid)
        .withColumn("_part", F.shiftright("_mid", 33).cast("int"))
        .withColumn("_pos", F.col("_mid") - F.shiftleft(F.col("_part").cast("bigint"), 33))
        .drop("_mid")
    )
    return stage(out, label)


def dense_numbers(df: DataFrame, order: list[Column], name: str, label: str = "numbered") -> DataFrame:
    """1..n in sort order: local places plus the sizes of the ranges before.

    Only the per-range sizes (one row per sort partition) meet in one task.
    """
    rows = range_numbered(df, order, label)
    sizes = rows.groupBy("_part").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    return (
        rows.join(F.broadcast(offsets), "_part")  # one row per sort partition
        .withColumn(name, F.col("_offset") + F.col("_pos") + 1)
        .drop("_part", "_pos", "_offset")
    )
