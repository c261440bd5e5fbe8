"""Gapless ranks within groups of any size, without bringing a group to one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Rows that a bucket of one group holds on average.
BUCKET_ROWS = 20_000


def ranked(df: DataFrame, keys: list[str], order: list[str], n_rows: int, name: str = "rank") -> DataFrame:
    """Add ``name``: 0, 1, 2, ... within each group of ``keys`` (never null).

    A group is split by a hash of ``order`` into buckets of about ``BUCKET_ROWS`` rows. Ranks count the rows of lower buckets, which a small table of
    counts gives, and then the rows before it in its own. ``df`` is read twice, so pass a stored table.
    """
    buckets = max(64, n_rows // BUCKET_ROWS)
    rows = df.withColumn("__bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)).cast("int"))
    at = [*keys, "__bucket"]
    lower = Window.partitionBy(*keys).orderBy("__bucket") if keys else Window.orderBy("__bucket")  # a row for each bucket
    before = rows.groupBy(*at).agg(F.count(F.lit(1)).alias("__n")).withColumn("__before", F.sum("__n").over(lower) - F.col("__n")).drop("__n")
    own = F.row_number().over(Window.partitionBy(*at).orderBy(*order))
    return rows.withColumn("__own", own).join(before, at).withColumn(name, F.col("__before") + F.col("__own") - 1).drop("__bucket", "__own", "__before")


def position(order: Column, limits: list[int]) -> Column:
    """How many of the increasing ``limits`` are at most ``order``."""
    return F.size(F.filter(F.array(*[F.lit(x).cast("long") for x in limits]), lambda x: x <= order)) if limits else F.lit(0)
