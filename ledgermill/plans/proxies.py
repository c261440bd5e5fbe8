"""Views of the driver's tables in the shapes that the operators take: customers as a register, orders as filings, line items as facts and rows of text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import DEFAULT_KEYWORDS
from ..operators.keywords import parse_keywords
from ..sources.lists import split_pages

WORDS = ["the", "of the", "and", "de la", "der", "que", "that in", "foreign exchange", "THE", "in that"]
#: Words of the documents, and then the default list, of which they have none.
KEYWORDS = WORDS + parse_keywords(DEFAULT_KEYWORDS)
OCR_SOURCE = "src1"
OTHER_NAME = "QWVY ZJK"
ENDINGS = ["", " Limited", " PLC", " Ltd.", " & Co Limited"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents cut at their newlines into pages."""
    docs = table(spark, sf_dir, "documents")
    return split_pages(docs, "\n", keep=["source"])


def register(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = F.lpad(F.col("c_custkey").cast("string"), 8, "0")
    status = F.element_at(F.array(*[F.lit(x) for x in ("Active", "Dissolved", "Liquidation", "Active", "Active")]), (F.col("c_custkey") % 5 + 1).cast("int"))
    return table(spark, sf_dir, "customer").select(number.alias("company_number"), F.col("c_name").alias("company_name"), status.alias("company_status"), "c_custkey")


def companies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each order: its customer's number, typed in four ways, some beyond the register, some missing."""
    k = F.col("o_custkey") * 11 % 10 + F.col("o_custkey")  # some are on no register
    text = F.when(F.col("o_orderkey") % 4 == 0, k.cast("string")).when(F.col("o_orderkey") % 4 == 1, F.concat(F.lit(" "), k.cast("string"), F.lit(" "))).when(
        F.col("o_orderkey") % 4 == 2, F.concat(F.lit("sc "), k.cast("string"))
    )
    name = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("Order "), F.col("o_orderstatus")))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("row_no"), name.alias("name"), text.alias("number"))


COMPANIES_SQL = """SELECT o_orderkey AS row_no, CASE WHEN o_orderkey % 3 = 0 THEN 'Order ' || o_orderstatus END AS name,
  CASE o_orderkey % 4 WHEN 0 THEN k::VARCHAR WHEN 1 THEN ' ' || k || ' ' WHEN 2 THEN 'sc ' || k END AS number
  FROM (SELECT *, o_custkey * 11 % 10 + o_custkey AS k FROM orders)"""


def clean_sql(column: str) -> str:
    s = f"upper(regexp_replace(coalesce({column}, ''), '[^A-Za-z0-9]', '', 'g'))"
    return f"""CASE WHEN regexp_full_match({s}, '[0-9]+') THEN lpad({s}, greatest(8, length({s}))::INT, '0')
  WHEN regexp_full_match({s}, '[A-Z]{{2}}[0-9]{{1,6}}') THEN substr({s}, 1, 2) || lpad(substr({s}, 3), 6, '0') ELSE {s} END"""


def filings(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    kind = F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), "AA").when(F.col("o_orderpriority") == "3-MEDIUM", "AAMD").otherwise("SH03")
    what = F.when(F.col("o_orderstatus") == "P", "Interim accounts").when(F.col("o_orderkey") % 5 == 0, "Micro company accounts").when(F.col("o_orderkey") % 5 == 1, "Total exemption full accounts").otherwise("Full accounts")
    description = F.concat(what, F.lit(" made up to "), F.date_format("o_orderdate", "d MMMM yyyy"), F.lit(" View PDF (3 pages)"))
    return o.select(
        F.lpad(F.col("o_custkey").cast("string"), 8, "0").alias("company_number"), F.col("o_orderdate").cast("date").alias("filed_on"), kind.alias("type"), description.alias("description"), F.col("o_orderkey").alias("pos"), F.col("o_totalprice").alias("amount")
    )


FILINGS_SQL = """SELECT lpad(o_custkey::VARCHAR, 8, '0') AS company_number, o_orderdate::DATE AS filed_on,
  CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'AA' WHEN o_orderpriority = '3-MEDIUM' THEN 'AAMD' ELSE 'SH03' END AS type,
  CASE WHEN o_orderstatus = 'P' THEN 'Interim accounts' WHEN o_orderkey % 5 = 0 THEN 'Micro company accounts' WHEN o_orderkey % 5 = 1 THEN 'Total exemption full accounts' ELSE 'Full accounts' END
    || ' made up to ' || strftime(o_orderdate, '%-d %B %Y') AS description,
  o_orderkey AS pos, o_totalprice AS amount FROM orders"""


def fact_lines(l: DataFrame) -> DataFrame:  # noqa: E741
    """Line items as facts of their order; the context of a line is its return flag in its ship year, its unit the flag of its status."""
    tags = ["TurnoverRevenue", "Revenue", "CashBankOnHand", "Debtors", "Other"]
    tag = F.element_at(F.array(*[F.lit(t) for t in tags]), (F.col("l_partkey") % 5 + 1).cast("int"))
    year = F.year("l_shipdate").cast("string")
    ref = F.concat(F.col("l_returnflag"), year)
    cents = F.rint(F.col("l_extendedprice") * 100).cast("long")
    raw = F.when(F.col("l_linenumber") == 7, "-").otherwise(F.format_number(F.floor(cents / 100), 0))
    pos = (F.col("l_linenumber") * 1_000_000 + F.col("l_partkey")).cast("int")
    fact = F.struct(
        pos.alias("pos"), tag.alias("tag"), ref.alias("context_ref"), F.col("l_linestatus").alias("unit_ref"), raw.alias("raw_text"),
        F.lit("ixt:numdotdecimal").alias("format"), F.when(F.col("l_linenumber") % 2 == 0, "3").alias("scale"), F.when(F.col("l_linenumber") % 3 == 0, "-").alias("sign"),
    )
    member = F.when(F.col("l_returnflag") == "A", F.array(F.lit("x:ConsolidatedGroup"))).when(F.col("l_returnflag") == "R", F.array(F.lit("x:SegmentOne"))).otherwise(F.expr("cast(array() as array<string>)"))
    context = F.struct(ref.alias("context_id"), F.concat(year, F.lit("-01-01")).alias("start_date"), F.concat(year, F.lit("-12-31")).alias("end_date"), (F.col("l_returnflag") != "N").alias("has_dims"), member.alias("members"))
    unit = F.when(F.col("l_linestatus") == "F", F.struct(F.col("l_linestatus").alias("unit_id"), F.lit("GBP").alias("measure")))
    return l.select(F.col("l_orderkey").alias("doc_id"), fact.alias("fact"), context.alias("context"), unit.alias("unit"))


def facts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The facts, contexts and units of line items as tables."""
    lines = fact_lines(table(spark, sf_dir, "lineitem"))
    return lines.select("doc_id", "fact.*"), lines.select("doc_id", "context.*").distinct(), lines.filter("unit is not null").select("doc_id", "unit.*").distinct()


FACTS_SQL = """SELECT doc_id, figure, tag_pos, pos, CASE flag WHEN 'N' THEN 0 ELSE 1 END AS rank, year || '-12-31' AS end_date, year || '-01-01' AS start_date,
  CASE WHEN line = 7 THEN 0.0 ELSE floor(cents / 100) * (CASE WHEN line % 2 = 0 THEN 1000 ELSE 1 END) * (CASE WHEN line % 3 = 0 THEN -1 ELSE 1 END) END AS value, CASE WHEN unit = 'F' THEN 'GBP' ELSE '' END AS unit
  FROM (SELECT l_orderkey AS doc_id, (l_linenumber * 1000000 + l_partkey)::INT AS pos, l_linenumber AS line, l_returnflag AS flag, l_linestatus AS unit, year(l_shipdate)::VARCHAR AS year,
    round_even(l_extendedprice * 100, 0)::BIGINT AS cents, CASE l_partkey % 5 WHEN 0 THEN 'turnover' WHEN 1 THEN 'turnover' WHEN 2 THEN 'cash' WHEN 3 THEN 'debtors' END AS figure,
    CASE l_partkey % 5 WHEN 1 THEN 1 ELSE 0 END AS tag_pos FROM lineitem WHERE l_partkey % 5 < 4 AND l_returnflag <> 'R')"""


def rows_of_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page for each order: a heading row of units every third order, and a row for each line item of its label and two amounts."""
    l = table(spark, sf_dir, "lineitem")  # noqa: E741
    price = F.floor(F.rint(F.col("l_extendedprice") * 100) / 100 + 1000)
    label = F.element_at(F.array(*[F.lit(x) for x in ("Turnover", "Cost of sales", "Cash at bank and in hand", "Debtors", "Current assets")]), (F.col("l_linenumber") % 5 + 1).cast("int"))
    line = F.when(label == "Current assets", label).otherwise(F.concat(label, F.lit(" 3 "), F.format_number(price, 0), F.lit(" "), F.format_number(price * 2, 0)))
    body = l.select(F.col("l_orderkey").alias("doc_id"), (F.col("l_linenumber") * F.lit(10**15) + F.col("l_partkey") * F.lit(10**9) + F.rint(F.col("l_extendedprice") * 100).cast("long")).alias("line_no"), line.alias("line"))
    heads = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), F.lit(0).cast("long").alias("line_no"), F.when(F.col("o_orderkey") % 3 == 0, "Note £000 £000").when(F.col("o_orderkey") % 3 == 1, "2025 £m").otherwise("5 m customers were served").alias("line"))
    return body.unionByName(heads)


ROWS_SQL = """SELECT l_orderkey AS doc_id, l_linenumber * 1000000000000000 + l_partkey * 1000000000 + round_even(l_extendedprice * 100, 0)::BIGINT AS line_no, l_linenumber % 5 AS kind, floor(round_even(l_extendedprice * 100, 0) / 100 + 1000) AS price,
  CASE l_orderkey % 3 WHEN 0 THEN 1000 ELSE 1000000 END AS heading FROM lineitem"""
