"""The whole job over the driver's tables: customers as a register, each twice in a list of companies, orders as filings with electronic documents and pages.

What a filing holds follows from its order's number ``k``; the SQL states the outcome of the same rules. Names are letters made of a hash of the key, so that
two of them are never alike.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import proxies as P

LETTERS = ("0123456789abcdef", "BCDFGHJKLMNPQRST")
UNKNOWN, OTHER = "ÖÖÖÖÖÖ ÄÄÄÄÄÄ", "AEIOU AEIOU"
KEYWORDS = ["foreign exchange", "hedging", "treasury"]


def letters(key: Column) -> Column:
    """Twelve letters of a key."""
    return F.translate(F.substring(F.md5(key.cast("string").cast("binary")), 1, 12), *LETTERS)


def letters_sql(key: str) -> str:
    return f"translate(substr(md5({key}::VARCHAR), 1, 12), '{LETTERS[0]}', '{LETTERS[1]}')"


def _typed(name: Column) -> Column:
    """With a letter too many: a score of 200 * 12 / 25."""
    return F.concat(F.substring(name, 1, 3), F.lit("X"), F.substring(name, 4, 20))


def _far(name: Column) -> Column:
    """With fifteen letters too many: a score of 200 * 12 / 39."""
    return F.concat(name, F.lit("X" * 15))


def profiles(spark, sf_dir) -> DataFrame:
    k = F.col("c_custkey")
    said = F.when(k % 17 == 0, "First  accounts made up to 1 May 2026").when(k % 2 == 0, "Last accounts\n made up to 31 March 2025").otherwise("")
    text = F.concat(F.lit("Overview "), said, F.when(k % 11 == 0, " Accounts  Overdue").otherwise(""))
    return P.register(spark, sf_dir).select("company_number", F.concat(letters(k), F.lit(" LIMITED")).alias("company_name"), "company_status", text.alias("page_text"))


def companies(spark, sf_dir) -> DataFrame:
    """A row by number, in four spellings, some beyond the register and some with another company's name; and a row by name, or once more by number."""
    c = P.table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    number = F.when(k % 13 == 0, k + 50_000_000).otherwise(k).cast("string")
    by_number = c.select((k * 2).alias("row_no"), F.when(k % 9 == 0, OTHER).when(k % 9 == 1, F.lower(letters(k))).alias("name"), F.concat(F.when(k % 3 == 0, " ").otherwise(""), number).alias("number"))
    name = F.when(k % 4 == 0, F.concat(F.lower(letters(k)), F.lit(" ltd"))).when(k % 4 == 1, _typed(letters(k))).when(k % 8 == 2, UNKNOWN).when(k % 8 == 6, _far(letters(k)))
    by_name = c.select((k * 2 + 1).alias("row_no"), name.alias("name"), F.when(k % 4 == 3, number).alias("number"))
    return by_number.unionByName(by_name)


def controllers(spark, sf_dir) -> DataFrame:
    s = P.table(spark, sf_dir, "supplier")
    return s.select(F.lpad(F.col("s_suppkey").cast("string"), 8, "0").alias("company_number"), F.lit(0).alias("idx"), F.col("s_name").alias("psc_name"), F.lit("Active").alias("status_tag"), F.lit("").alias("block_text"))


def filings(spark, sf_dir) -> DataFrame:
    k = F.col("pos")
    return P.filings(spark, sf_dir).withColumns({"xhtml_url": F.when(k % 3 == 0, F.concat(F.lit("x"), k.cast("string"))), "pdf_url": F.when(k % 5 != 4, F.concat(F.lit("p"), k.cast("string")))})


def _amount() -> Column:
    return F.floor(F.rint(F.col("o_totalprice") * 100) / 100) + 1000


def _text(amount: Column) -> Column:
    return F.format_number(amount, 0)


def documents(spark, sf_dir) -> DataFrame:
    """Tagged figures, or table rows or placed blocks of a statement, or neither; hidden text, and two keywords in every other document."""
    k, a = F.col("o_orderkey"), _amount()
    fact = lambda name, x: F.concat(F.lit(f'<ix:nonFraction name="core:{name}" contextRef="c" unitRef="u" format="ixt:numdotdecimal">'), _text(x), F.lit("</ix:nonFraction>"))
    header = '<ix:header><ix:hidden>treasury</ix:hidden><xbrli:context id="c"><xbrli:startDate>2025-01-01</xbrli:startDate><xbrli:endDate>2025-12-31</xbrli:endDate></xbrli:context><xbrli:unit id="u"><xbrli:measure>iso4217:GBP</xbrli:measure></xbrli:unit></ix:header>'
    rows = F.concat(F.lit("<table><tr><td>Income statement</td></tr><tr><td>Note</td><td>£000</td></tr><tr><td>Turnover</td><td>3</td><td>"), _text(a), F.lit("</td><td>"), _text(a * 2), F.lit("</td></tr></table>"))
    placed = F.concat(
        F.lit('<div><div style="top:10px;left:1px">Profit and loss account</div><div style="top:30.02px;left:60px">'), _text(a), F.lit('</div><div style="top: 30px; left: 2px">Turnover</div><div style="top:50px;left:1px">Balance sheet</div>'),
        F.lit('<div style="top:60px;left:1px">Current assets</div><div style="top:70px;left:1px">Debtors</div><div style="top:70px;left:50px">'), _text(a * 3), F.lit("</div></div>"),
    )
    body = F.when(k % 4 == 0, F.concat(fact("TurnoverRevenue", a), fact("Debtors", a * 4))).when(k % 8 == 1, rows).when(k % 8 == 5, placed).otherwise("")
    said = F.when(k % 2 == 1, "<p>Hedging of foreign ex-<br/>change and foreign exchange.</p>").otherwise("<p>Nothing.</p>")
    html = F.concat(F.lit(f"<html><body>{header}"), body, said, F.lit("</body></html>"))
    return P.table(spark, sf_dir, "orders").filter((k % 3 == 0) & (k % 21 != 0)).select(k.alias("doc_id"), F.concat(F.lit("x"), k.cast("string")).alias("url"), html.alias("html"))


def pages(spark, sf_dir) -> DataFrame:
    """Three pages: a cover with a keyword, twice; a statement in thousands, some without a figure; a balance sheet."""
    k, a = F.col("o_orderkey"), _amount()
    statement = F.concat(F.lit("Income statement\nNote 2025 £000\n"), F.when(k % 8 == 1, "Other income").otherwise(F.concat(F.lit("Turnover 3 "), _text(a), F.lit(" "), _text(a * 2))))
    balance = F.concat(F.lit("Balance sheet\nCash 9 9,999\nCurrent assets\nCash at bank and in hand 5 "), _text(a * 5), F.lit(" "), _text(a * 6))
    texts = F.array(F.lit("Annual report\nforeign exchange and\nFOREIGN-EXCHANGE"), statement, balance)
    o = P.table(spark, sf_dir, "orders").filter((k % 5 != 4) & (k % 7 != 6))
    scanned = F.when(F.floor(k / 2) % 2 == 0, "PDF scan (OCR)").otherwise("PDF text")
    return o.select(k.alias("doc_id"), F.concat(F.lit("p"), k.cast("string")).alias("url"), F.lit(3).alias("n_pages"), scanned.alias("method"), F.posexplode(texts).alias("page", "text"))


def world_sql(latest: str, reason: str) -> str:
    """Views up to ``res``: a row for each row of the list with its outcome. ``latest``: the newest accounts; ``reason``: why an amount is missing."""
    name = letters_sql("c_custkey")
    return f"""WITH latest AS ({latest}),
reg AS (SELECT c_custkey AS c, lpad(c_custkey::VARCHAR, 8, '0') AS company_number, {name} || ' LIMITED' AS company_name FROM customer),
asked AS (SELECT c_custkey * 2 AS row_no, c_custkey AS c, c_custkey % 13 <> 0 AS found, true AS by_number,
    CASE WHEN c_custkey % 9 = 0 THEN '{OTHER}' WHEN c_custkey % 9 = 1 THEN lower({name}) END AS typed FROM customer
  UNION ALL SELECT c_custkey * 2 + 1, c_custkey, CASE WHEN c_custkey % 4 = 3 THEN c_custkey % 13 <> 0 ELSE c_custkey % 4 < 2 END, c_custkey % 4 = 3,
    CASE c_custkey % 4 WHEN 0 THEN lower({name}) || ' ltd' WHEN 1 THEN substr({name}, 1, 3) || 'X' || substr({name}, 4) WHEN 2 THEN CASE WHEN c_custkey % 8 = 2 THEN '{UNKNOWN}' ELSE {name} || repeat('X', 15) END END FROM customer),
doc AS (SELECT company_number, filed_on::DATE AS filed_on, description, pos AS k, {reason} AS reason, floor(round_even(o_totalprice * 100, 0) / 100) + 1000 AS a,
    pos % 3 = 0 AND pos % 21 <> 0 AS ix, pos % 5 <> 4 AS pdf, pos % 5 <> 4 AND pos % 7 <> 6 AS pages, (pos // 2) % 2 = 0 AS ocr, pos % 8 <> 1 AS shown FROM latest JOIN orders ON o_orderkey = pos),
j AS (SELECT a.row_no, a.c, a.found, a.by_number, a.typed, r.company_number AS number, r.company_name, d.* EXCLUDE (company_number), ix AND k % 4 IN (0, 1) AS ix_found,
    CASE WHEN a.c % 17 = 0 THEN '' WHEN a.c % 2 = 0 THEN '31 March 2025' END AS last FROM asked a JOIN reg r ON r.c = a.c LEFT JOIN doc d ON d.company_number = r.company_number),
rule AS (SELECT *, CASE WHEN NOT found THEN 2 WHEN last = '' THEN 3 WHEN k IS NULL AND last IS NULL THEN 4 WHEN k IS NULL THEN 5 WHEN ix_found THEN 6 WHEN ix AND reason <> '' THEN 7 WHEN NOT pdf THEN 8
    WHEN NOT pages THEN 9 WHEN shown AND ocr THEN 10 WHEN shown THEN 11 WHEN reason <> '' THEN 12 WHEN ix THEN 13 ELSE 14 END AS rule FROM j),
res AS (SELECT *, CASE WHEN rule = 2 THEN 'NOT FOUND' WHEN rule IN (3, 4, 7, 12, 13) THEN 'NOT DISCLOSED' WHEN rule IN (6, 11) THEN 'FOUND' WHEN rule = 10 THEN 'VERIFY' ELSE 'CHECK PDF' END AS turnover_status,
  CASE WHEN rule = 6 THEN CASE WHEN k % 8 = 1 THEN a * 1000 ELSE a END WHEN rule IN (10, 11) THEN a * 1000 END AS turnover,
  CASE WHEN rule = 6 AND k % 8 = 1 THEN a * 2000 WHEN rule IN (10, 11) THEN a * 2000 END AS prior_turnover,
  CASE WHEN rule >= 10 THEN a * 5 END AS cash, CASE WHEN rule >= 6 AND ix AND k % 4 = 0 THEN a * 4 WHEN rule >= 6 AND ix AND k % 8 = 5 THEN a * 3 END AS debtors,
  CASE WHEN rule IN (6, 10, 11) THEN 'GBP' END AS currency,
  CASE WHEN rule = 6 AND k % 4 = 0 THEN '2025-12-31' WHEN rule >= 6 THEN filed_on::VARCHAR END AS period_end,
  CASE WHEN rule >= 6 AND ix THEN CASE WHEN k % 2 = 1 THEN 2 ELSE 0 END WHEN rule >= 10 THEN CASE WHEN ocr THEN 0 ELSE 1 END END AS keyword_count,
  CASE WHEN rule >= 6 AND ix THEN CASE WHEN k % 2 = 1 THEN 'foreign exchange (1), hedging (1)' ELSE 'none found' END WHEN rule >= 10 THEN CASE WHEN ocr THEN 'none found' ELSE 'foreign exchange (2)' END END AS keywords,
  nullif(concat_ws('; ', CASE rule WHEN 2 THEN CASE WHEN by_number THEN 'company number ' || (c + 50000000) || ' not on the register' WHEN c % 8 = 2 THEN 'company not found on the register' ELSE 'no confident match (closest: ' || company_name || ', 62%), add the company number' END
    WHEN 3 THEN 'no accounts filed yet (new company)' WHEN 4 THEN 'no accounts filed' WHEN 5 THEN 'accounts made up to ' || last || ' exist but weren''t found in the filing history, check the company page'
    WHEN 7 THEN reason WHEN 8 THEN 'the accounts filing has no downloadable document' WHEN 9 THEN 'the accounts PDF couldn''t be downloaded' WHEN 12 THEN reason WHEN 13 THEN 'turnover not shown in the filed accounts'
    WHEN 14 THEN 'no turnover line found in 3 pages, open the PDF to check' END,
    CASE WHEN found AND c % 5 = 1 THEN 'company status: Dissolved' WHEN found AND c % 5 = 2 THEN 'company status: Liquidation' END, CASE WHEN found AND c % 11 = 0 THEN 'accounts overdue' END,
    CASE WHEN found AND by_number AND typed = '{OTHER}' THEN 'the number belongs to ' || company_name || ', check it matches ''{OTHER}''' END,
    CASE WHEN rule >= 6 AND date_diff('day', filed_on, DATE '2001-01-01') > 730 THEN 'latest accounts are over 2 years old (' || strftime(filed_on, '%-d %B %Y') || ')' END,
    CASE WHEN rule >= 10 AND NOT ix AND ocr THEN 'keywords not searched in scanned pages (keyword search of scanned PDFs is turned off)' END,
    CASE WHEN rule = 10 THEN 'read by OCR from page 2, check the figures against the PDF' WHEN rule >= 11 AND ocr THEN 'cash and debtors read by OCR, check them against the PDF' END), '') AS note,
  CASE WHEN found THEN company_name ELSE typed END AS shown_name, CASE WHEN found THEN number WHEN by_number THEN (c + 50000000)::VARCHAR END AS shown_number,
  CASE WHEN found AND rule >= 3 THEN coalesce((SELECT s_name FROM supplier WHERE s_suppkey = c), 'none registered') END AS psc, CASE WHEN rule >= 6 AND pdf THEN 'p' || k END AS accounts_pdf FROM rule)"""


REPORT = "row_no, company_name, company_number, turnover_status, turnover, prior_turnover, cash, debtors, currency, period_end, psc, keyword_count, keywords, note, accounts_pdf".split(", ")
