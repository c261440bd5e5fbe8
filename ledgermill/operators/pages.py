"""Documents as pages of text: reading order, limits, and the first page with each figure."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import constants as K
from ..functions.text import page_currency
from .lines import first_of, is_balance_page, is_statement_page, labelled

LONG, REACH = 40, 15


def reading_order(page: Column, n_pages: Column) -> Column:
    """0, 1, ... from the first page, or in documents of more than 40 pages, from a quarter of them on and around."""
    return F.when(n_pages > LONG, F.pmod(page - F.floor(n_pages * 0.25).cast("int"), n_pages)).otherwise(page)


def in_order(pages: DataFrame, max_pages: int | None = None) -> DataFrame:
    """Pages with ``order_pos``, of each document at most ``max_pages`` (null or 0: all)."""
    rows = pages.withColumn("order_pos", reading_order(F.col("page"), F.col("n_pages")))
    return rows.filter(F.col("order_pos") < max_pages) if max_pages else rows


def page_rows(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), r"\r\n|[\n\r\f\x0b\x85\u2028\u2029]")


def coverage(pages: DataFrame) -> DataFrame:
    """``doc_id, pages, pages_checked, scanned_pages, any_scanned``: how much of each document was read, by ``method``."""
    scanned = F.coalesce(F.col("method").contains("OCR"), F.lit(False))
    return pages.groupBy("doc_id").agg(F.max("n_pages").alias("pages"), F.count(F.lit(1)).alias("pages_checked"), F.count_if(scanned).alias("scanned_pages"), F.bool_or(scanned).alias("any_scanned"))


def page_figures(pages: DataFrame, max_pages: int | None = None, balance_reach: int | None = None) -> DataFrame:
    """A row a document of ``doc_id, page, n_pages, text, method``: turnover, prior, unit, page (from 1), method, currency from the first statement page in
    reading order that has a figure; cash and debtors each from the first balance page that has one.

    ``balance_reach``: balance pages count only up to so many pages after the turnover's (15 when no keywords are searched; null: all). Only statement and
    balance pages are cut into lines.
    """
    read = in_order(pages, max_pages).withColumn("rows", page_rows(F.col("text")))
    flagged = read.withColumns({"statement": is_statement_page(F.col("rows")), "balance": is_balance_page(F.col("rows"))}).filter("statement or balance")
    lines = flagged.select("doc_id", "page", "order_pos", "method", "statement", "balance", page_currency(F.col("text")).alias("currency"), F.posexplode("rows").alias("line_no", "line"))
    keys = ["doc_id", "page", "order_pos", "method", "currency"]
    labels = {"turnover": (K.TURNOVER_LABEL, False, F.col("statement")), **{name: (K.LABELS[name], True, F.col("balance")) for name in ("cash", "debtors")}}
    found = labelled(lines, labels, [*keys, "statement", "balance"])
    if balance_reach is not None:
        t_pos = F.min(F.when(F.col("label") == "turnover", F.col("order_pos"))).over(Window.partitionBy("doc_id"))
        found = found.withColumn("t_pos", t_pos).filter((F.col("label") == "turnover") | F.col("t_pos").isNull() | (F.col("order_pos") - F.col("t_pos") <= balance_reach))
    balance = ["current", "method"]
    best = first_of(found, ["doc_id"], "order_pos", turnover=["current", "prior", "unit", "page", "method", "currency"], cash=balance, debtors=balance)
    best = best.withColumnsRenamed({"doc_id": "__t", "turnover": "t"})
    out = read.groupBy("doc_id").agg(F.max("n_pages").alias("pages"), F.count(F.lit(1)).alias("pages_checked")).join(best, F.col("doc_id") == F.col("__t"), "left")
    return out.select(
        "doc_id",
        F.col("t.current").alias("turnover"),
        F.col("t.prior").alias("prior"),
        F.col("t.unit").alias("unit"),
        (F.col("t.page") + 1).alias("page"),
        F.col("t.method").alias("method"),
        F.col("t.currency").alias("currency"),
        F.col("cash.current").alias("cash"),
        F.col("debtors.current").alias("debtors"),
        F.coalesce("cash.method", "debtors.method").alias("balance_method"),
        "pages",
        "pages_checked",
    )
