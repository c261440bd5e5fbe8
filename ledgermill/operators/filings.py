"""Filing histories and persons with significant control."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..constants import FILING_ROWS
from ..functions.text import filing_description, is_annual_accounts


def latest_accounts(filings: DataFrame, newest: int | None = FILING_ROWS) -> DataFrame:
    """The newest annual accounts of each company among its ``newest`` filings of any type, by ``filed_on`` descending and then ``pos``.

    With ``newest`` null every filing counts, and a grouping that sums up before the shuffle takes the place of the window.
    """
    good = is_annual_accounts(F.col("type"), F.col("description"))
    columns = [c for c in filings.columns if c != "company_number"]
    if newest is None:
        # the latest date, and of that the least position
        first = F.max_by(F.struct(*columns), F.struct("filed_on", -F.col("pos")))
        found = filings.filter(good).groupBy("company_number").agg(first.alias("f")).select("company_number", "f.*")
    else:
        order = Window.partitionBy("company_number").orderBy(F.desc("filed_on"), "pos")
        ranked = filings.withColumn("__rn", F.row_number().over(order)).filter(F.col("__rn") <= newest).filter(good)
        found = ranked.withColumn("__first", F.row_number().over(order)).filter("__first = 1").drop("__rn", "__first")
    return found.withColumn("description", filing_description(F.col("description")))


def active_controllers(psc: DataFrame) -> DataFrame:
    """``company_number, pscs`` of rows ``company_number, idx, psc_name, status_tag, block_text``: who hasn't ceased, in the page's order. A company all of
    whose controllers have ceased has an empty list."""
    text, tag = F.coalesce("block_text", F.lit("")), F.lower(F.coalesce("status_tag", F.lit("")))
    active = ~tag.contains("ceased") & ~text.contains("Ceased on")
    corporate = text.rlike("Legal form|Registration number|Place registered")
    name = F.regexp_replace("psc_name", r"(?U)\s+", " ")
    entry = F.when(active, F.struct("idx", name.alias("name"), corporate.alias("is_corporate")))
    listed = psc.groupBy("company_number").agg(F.array_sort(F.collect_list(entry)).alias("l"))
    return listed.select("company_number", F.transform("l", lambda x: F.struct(x["name"].alias("name"), x["is_corporate"].alias("is_corporate"))).alias("pscs"))


def with_controllers(companies: DataFrame, psc: DataFrame) -> DataFrame:
    """Companies with their controllers; a company without any row has an empty list."""
    found = active_controllers(psc).withColumnRenamed("company_number", "__c")
    empty = F.expr("cast(array() as array<struct<name:string,is_corporate:boolean>>)")
    return companies.join(found, F.col("company_number") == F.col("__c"), "left").drop("__c").withColumn("pscs", F.coalesce("pscs", empty))
