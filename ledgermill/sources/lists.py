"""Reading a list of companies: encoding, separator, header row and columns are found in the file."""

from __future__ import annotations

import csv
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SAMPLE, HEADER_ROWS = 5000, 10
NAME_WORDS, NUMBER_WORDS = ["company name", "name", "company"], ["company number", "company reg", "number", "crn", "reg"]
LIST = "row_no long, name string, number string"
_HEADER = r"(?i)company|name|number|crn|reg"


def separator_of(sample: str) -> str:
    """One of comma, semicolon, tab and bar, found in the first characters of a file; comma if none is."""
    try:
        return csv.Sniffer().sniff(sample[:SAMPLE], ",;\t|").delimiter
    except csv.Error:
        return ","


def guess(headers: list[str], words: list[str], skip: str | None = None) -> str | None:
    """The first header with the first word that any has, in any case."""
    return next((h for w in words for h in headers if h != skip and w in h.lower()), None)


def find_column(headers: list[str], wanted: str) -> str:
    """The header of that name, ignoring case and outer blanks."""
    for h in headers:
        if h.strip().lower() == wanted.strip().lower():
            return h
    raise ValueError(f"no column {wanted!r}; there are: {', '.join(h for h in headers if h)}")


def read_list(spark: SparkSession, path: str, name: str | None = None, number: str | None = None) -> DataFrame:
    """``row_no, name, number`` of a CSV file, all as text. The header is the first of the top ten rows with a cell such as "company" or "number", else the
    first row with any text; an empty file gives no row.

    The file is UTF-8 if all of it is, with or without a byte order mark, and else cp1252. It is read in parts, unless a cell goes on over a line's end. Only
    its first characters and ten rows reach the driver.
    """
    lines = spark.read.text(path)
    quotes = F.length(F.regexp_replace("value", '[^"]', ""))
    seen = lines.agg(F.bool_and(F.is_valid_utf8("value")).alias("utf8"), F.bool_and(quotes % 2 == 0).alias("whole")).first()
    if seen["utf8"] is None:
        return spark.createDataFrame([], LIST)
    head = [bytes(r["b"] or b"") for r in lines.select(F.substring(F.col("value").cast("binary"), 1, SAMPLE * 4).alias("b")).limit(SAMPLE).collect()]
    separator = separator_of(b"\n".join(head).decode("utf-8-sig" if seen["utf8"] else "cp1252", "replace"))
    raw = spark.read.option("sep", separator).option("encoding", "UTF-8" if seen["utf8"] else "ISO-8859-1").option("header", False).option("multiLine", not seen["whole"])
    # quotes inside a cell are doubled; Spark's own charsets have no cp1252, which differs from Latin-1 in 27 characters
    raw = raw.option("escape", '"').csv(path)
    pairs = [(chr(b), bytes([b]).decode("cp1252")) for b in range(0x80, 0xA0) if bytes([b]).decode("cp1252", "ignore")]
    latin = F.col if seen["utf8"] else lambda c: F.translate(c, "".join(a for a, _ in pairs), "".join(b for _, b in pairs))
    cells = F.array(*[F.coalesce(F.regexp_replace(F.trim(latin(c)), "^\ufeff", ""), F.lit("")) for c in raw.columns])
    rows = raw.select(cells.alias("cells"), F.monotonically_increasing_id().alias("id"))
    top = rows.orderBy("id").limit(HEADER_ROWS).collect()
    filled = [r for r in top if any(r["cells"])]
    named = [r for r in filled if any(re.search(_HEADER, c) for c in r["cells"])]
    if not filled:
        return spark.createDataFrame([], LIST)
    header = (named or filled)[0]
    headers = list(header["cells"])
    number = find_column(headers, number) if number else guess(headers, NUMBER_WORDS)
    name = find_column(headers, name) if name else guess(headers, NAME_WORDS, skip=number)
    pick = lambda h: F.nullif(F.col("cells")[headers.index(h)], F.lit("")) if h else F.lit(None).cast("string")
    # ids follow the file's order, as its parts do
    kept = rows.filter(F.col("id") > header["id"]).select(F.col("id").alias("row_no"), pick(name).alias("name"), pick(number).alias("number"))
    return kept.filter(F.col("name").isNotNull() | F.col("number").isNotNull())


def split_pages(docs: DataFrame, separator: str = "\f", id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``doc_id, page, n_pages, text`` (and the columns ``keep``) of documents whose pages come joined; an empty document has one empty page."""
    parts = F.split(F.coalesce(text_col, F.lit("")), re.escape(separator))
    return docs.select(F.col(id_col).alias("doc_id"), *(keep or []), F.size(parts).alias("n_pages"), F.posexplode(parts).alias("page", "text"))


def newest_first(filings: DataFrame) -> DataFrame:
    """Filings with ``pos`` within their company from 0 on, newest first, for lists that come without one."""
    return filings.withColumn("pos", F.row_number().over(Window.partitionBy("company_number").orderBy(F.desc("filed_on"), "type", "description")) - 1)
