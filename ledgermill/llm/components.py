"""Connected components of links of any number, by alternating large-star and small-star steps, each a join and a grouping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, save


def _star(links: DataFrame, larger_only: bool) -> DataFrame:
    """Link the neighbours ``v`` of each ``u`` to the least node around it: those above ``u`` (large star, from both directions), or all below it (small)."""
    if larger_only:
        around = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        around = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = around.groupBy(F.col("u").alias("c")).agg(F.min("v").alias("m")).withColumn("m", F.least("c", "m"))
    met = around.join(least, F.col("u") == F.col("c"))
    if larger_only:
        out = met.filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = met.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select(F.col("c").alias("u"), F.col("m").alias("v")))
    return out.filter("u != v").distinct()


def components(links: DataFrame, most_steps: int = 60) -> DataFrame:
    """``node, root`` of every node of ``links`` (its first two columns, long): the least node that it reaches. Rows with a null or with equal nodes are
    no links. Every step is stored in the shared folder and the one before it deleted, so a lost executor costs one step."""
    spark = links.sparkSession
    a, b = links.columns[:2]
    pairs = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).distinct()
    now, path = save(pairs, "links")
    before = None
    for _ in range(most_steps):
        new, new_path = save(_star(_star(now, True), False), "links")
        seen = new.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        forget(spark, path)
        now, path = new, new_path
        if seen == before:
            break
        before = seen
    else:
        raise RuntimeError(f"links still move after {most_steps} steps")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()
