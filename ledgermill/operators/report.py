"""One result row a company: status, note, cells and links; and summaries per status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import dates
from ..functions.text import form_encoded, is_insolvent, joined_notes, why_missing, without_legal_ending, without_title

OUTPUT = [
    "row_no", "company_name", "company_number", "turnover_status", "turnover", "prior_turnover", "cash", "debtors", "currency", "period_end", "accounts_type", "psc", "search_text",
    "search_url", "keyword_count", "keywords", "note", "accounts_pdf",
]


def psc_cell(pscs: Column) -> Column:
    """Names joined by semicolons, or that there are none; null if they weren't looked up."""
    return F.when(F.size(pscs) == 0, "none registered").when(pscs.isNotNull(), F.array_join(F.transform(pscs, lambda p: p["name"]), "; "))


def _person(pscs: Column) -> Column:
    people = F.filter(pscs, lambda p: ~p["is_corporate"])
    return F.coalesce(F.get(people, F.lit(0))["name"], F.get(pscs, F.lit(0))["name"], F.lit(""))


def _joined(separator: str, *parts: Column) -> Column:
    return F.array_join(F.filter(F.array(*parts), lambda x: x != ""), separator)


def search_text(company: Column, pscs: Column) -> Column:
    """The company without its legal form, its first individual controller (else the first), and the site; null without a company."""
    c = without_legal_ending(F.trim(F.coalesce(company, F.lit(""))))
    return F.when(c != "", _joined(" + ", c, _person(pscs), F.lit("LinkedIn")))


def search_url(company: Column, pscs: Column) -> Column:
    c = without_legal_ending(F.trim(F.coalesce(company, F.lit(""))))
    query = _joined(" ", c, without_title(_person(pscs)), F.lit("LinkedIn"))
    return F.when(c != "", F.concat(F.lit("https://www.google.com/search?q="), form_encoded(query)))


#: The joined row that :func:`decided` needs: what each step found, null where it found nothing.
JOINED = (
    "row_no long, name string, number_key string, company_number string, company_name string, company_status string, match_note string, accounts_overdue boolean, last_accounts string, "
    "filed_on date, accounts_type string, pdf_url string, xhtml_url string, has_xhtml boolean, has_pages boolean, ix_turnover double, ix_prior double, ix_currency string, ix_end string, "
    "ix_months int, ix_method string, ix_cash double, ix_debtors double, pg_turnover double, pg_prior double, pg_unit string, pg_page int, pg_method string, pg_currency string, pg_cash double, "
    "pg_debtors double, pg_balance_method string, pg_checked long, pg_pages long, keyword_note string, failed boolean, pg_problem string, scanned_skipped boolean"
)
#: What :func:`output_rows` needs of decided rows, besides controllers and keywords.
DECIDED = [
    "row_no", "name", "number_key", "company_number", "company_name", "turnover_status", "turnover", "prior_turnover", "cash", "debtors", "currency", "period_end", "accounts_type", "method", "note",
]


def decided(joined: DataFrame, as_of: Column | None = None) -> DataFrame:
    """Add ``turnover_status, note, turnover, prior_turnover, cash, debtors, currency, period_end, method`` to joined rows, by the first rule that holds.

    Figures of the electronic document come first, those of pages fill in; ``as_of`` is the day from which accounts count as old. A row whose source
    failed is ERROR, only that row.
    """
    as_of = F.current_date() if as_of is None else as_of
    d = joined
    reason = why_missing(F.col("accounts_type"))
    made_up = dates.made_up_to(F.col("accounts_type"))
    no_number, no_name = F.col("number_key") == "", F.trim(F.coalesce("name", F.lit(""))) == ""
    found, electronic = F.col("company_number").isNotNull(), F.coalesce("has_xhtml", F.lit(False))
    has_filing = F.col("accounts_type").isNotNull()
    ocr = F.coalesce(F.col("pg_method").contains("OCR"), F.lit(False))
    pg, ix = F.col("pg_turnover").isNotNull(), electronic & F.col("ix_turnover").isNotNull()
    rules = [
        (F.coalesce("failed", F.lit(False)), "ERROR", F.lit("a source failed for this row, run it again")),
        (~found & no_number & no_name, "NOT FOUND", F.lit("no company name or number in this row")),
        (~found, "NOT FOUND", F.col("match_note")),
        (F.col("last_accounts") == "", "NOT DISCLOSED", F.lit("no accounts filed yet (new company)")),
        (~has_filing & F.col("last_accounts").isNull(), "NOT DISCLOSED", F.lit("no accounts filed")),
        (~has_filing, "CHECK PDF", F.concat(F.lit("accounts made up to "), F.col("last_accounts"), F.lit(" exist but weren't found in the filing history, check the company page"))),
        (ix, "FOUND", F.lit("")),
        (electronic & (reason != ""), "NOT DISCLOSED", reason),
        (F.coalesce("pdf_url", F.lit("")) == "", "CHECK PDF", F.lit("the accounts filing has no downloadable document")),
        (~F.coalesce("has_pages", F.lit(False)), "CHECK PDF", F.lit("the accounts PDF couldn't be downloaded")),
        (pg & ocr, "VERIFY", F.lit("")),
        (pg, "FOUND", F.lit("")),
        (reason != "", "NOT DISCLOSED", reason),
        (electronic, "NOT DISCLOSED", F.lit("turnover not shown in the filed accounts")),
        (F.col("pg_problem").isNotNull(), "CHECK PDF", F.col("pg_problem")),
        (F.coalesce("scanned_skipped", F.lit(False)), "CHECK PDF", F.lit("scanned PDF not read (scanned-PDF reading is turned off)")),
        (F.lit(True), "CHECK PDF", F.concat(F.lit("no turnover line found in "), F.coalesce("pg_checked", F.lit(0)).cast("string"), F.lit(" pages, open the PDF to check"))),
    ]
    rule = F.lit(None).cast("int")
    for k in range(len(rules) - 1, -1, -1):
        rule = F.when(rules[k][0], k).otherwise(rule)
    d = d.withColumn("__rule", rule)
    pick = lambda values: F.element_at(F.array(*values), F.col("__rule") + 1)
    d = d.withColumns({"turnover_status": pick([F.lit(s) for _, s, _ in rules]), "__note": pick([n for _, _, n in rules])})
    # rules 3 and later have a company; 6 reads the electronic document, 8 on the pages too
    is_ix, paged = F.col("__rule") == 6, F.col("__rule") >= 10
    by_page = F.col("__rule").isin(10, 11)
    in_time = found & (F.col("__rule") >= 6)
    currency = F.when(is_ix, F.col("ix_currency")).when(by_page, F.when(F.coalesce("pg_currency", F.lit("")) == "", "GBP").otherwise(F.col("pg_currency")))
    method = F.when(is_ix, F.col("ix_method")).when(
        by_page, F.concat(F.col("pg_method"), F.lit(", page "), F.col("pg_page").cast("string"), F.when(F.coalesce("pg_unit", F.lit("")) != "", F.concat(F.lit(", figures in "), currency, F.col("pg_unit"))).otherwise(""))
    )
    d = d.withColumns(
        {
            "turnover": F.when(is_ix, F.col("ix_turnover")).when(by_page, F.col("pg_turnover")),
            "prior_turnover": F.when(is_ix, F.col("ix_prior")).when(by_page, F.col("pg_prior")),
            "cash": F.coalesce(F.when(electronic & in_time, F.col("ix_cash")), F.when(paged, F.col("pg_cash"))),
            "debtors": F.coalesce(F.when(electronic & in_time, F.col("ix_debtors")), F.when(paged, F.col("pg_debtors"))),
            "currency": currency,
            "method": method,
            "period_end": F.coalesce(F.when(is_ix, F.nullif(F.col("ix_end"), F.lit(""))), F.when(in_time, made_up.cast("string"))),
        }
    )
    months = F.concat(F.lit("these accounts cover "), F.col("ix_months").cast("string"), F.lit(" months, not a normal year"))
    old = F.concat(F.lit("latest accounts are over 2 years old ("), dates.made_up_to_text(F.col("accounts_type")), F.lit(")"))
    by_ocr = F.concat(F.lit("read by OCR from page "), F.col("pg_page").cast("string"), F.lit(", check the figures against the PDF"))
    status_note = F.concat(F.lit("company status: "), F.col("company_status"))
    note = joined_notes(
        F.col("__note"),
        F.when(found & (F.col("number_key") == ""), F.col("match_note")),
        F.when(found & is_insolvent(F.col("company_status")), status_note),
        F.when(found & F.coalesce("accounts_overdue", F.lit(False)), "accounts overdue"),
        F.when(found & (F.col("number_key") != ""), F.col("match_note")),
        F.when(in_time & dates.is_stale(made_up, as_of), old),
        F.when(is_ix & dates.is_odd_period(F.col("ix_months")), months),
        F.when(paged, F.col("keyword_note")),
        F.when(F.col("__rule") == 10, by_ocr),
        F.when(paged & (F.col("turnover_status") != "VERIFY") & F.coalesce(F.col("pg_balance_method").contains("OCR"), F.lit(False)), "cash and debtors read by OCR, check them against the PDF"),
        F.when(F.coalesce("currency", F.lit("GBP")) != "GBP", F.concat(F.lit("figures are in "), F.col("currency"))),
    )
    return d.withColumn("note", note).drop("__rule", "__note")


def output_rows(decided_rows: DataFrame) -> DataFrame:
    """The fixed output columns: registered name and number, else as typed; empty strings are null."""
    blank = lambda c: F.nullif(c, F.lit(""))
    optional = lambda c, kind="string": F.col(c) if c in decided_rows.columns else F.lit(None).cast(kind)
    pscs = F.col("pscs") if "pscs" in decided_rows.columns else F.lit(None).cast("array<struct<name:string,is_corporate:boolean>>")
    made = {
        "company_name": blank(F.coalesce(blank(F.col("company_name")), F.col("name"))),
        "company_number": blank(F.coalesce(blank(F.col("company_number")), F.col("number_key"))),
        "psc": psc_cell(pscs),
        "search_text": search_text(F.col("company_name"), pscs),
        "search_url": search_url(F.col("company_name"), pscs),
        "keyword_count": optional("keyword_count", "int"),
        "keywords": optional("keyword_cell"),
        "accounts_pdf": blank(optional("pdf_url")),
        "note": blank(F.col("note")),
        "currency": blank(F.col("currency")),
        "period_end": blank(F.col("period_end")),
        "accounts_type": blank(F.col("accounts_type")),
    }
    return decided_rows.select(*[made[c].alias(c) if c in made else F.col(c) for c in OUTPUT])


def status_summary(rows: DataFrame, status_col: str = "turnover_status") -> DataFrame:
    """``pos, status, companies, meaning``: every status, with 0 where no row has it, and the total of them."""
    spark = rows.sparkSession
    listed = spark.createDataFrame([(k, s, K.MEANINGS[s]) for k, s in enumerate(K.STATUSES)] + [(len(K.STATUSES), "Total", "")], "pos int, status string, meaning string")
    counts = rows.filter(F.col(status_col).isin(*K.STATUSES)).rollup(F.col(status_col).alias("__s")).agg(F.count(F.lit(1)).alias("n")).select(F.coalesce("__s", F.lit("Total")).alias("__s"), "n")
    return listed.join(counts, F.col("status") == F.col("__s"), "left").select("pos", "status", F.coalesce("n", F.lit(0)).cast("long").alias("companies"), "meaning")


def summary_block(rows: DataFrame, keywords: list[str] | None = None, status_col: str = "turnover_status") -> DataFrame:
    """The summary as it is written: :func:`status_summary`, and with ``keywords``, how many ``rows`` mention one (``keyword_count`` over 0) and the list."""
    summary = status_summary(rows, status_col)
    if not keywords:
        return summary
    end = len(K.STATUSES) + 1
    some = rows.agg(F.count_if(F.col("keyword_count") > 0).alias("companies")).select(
        F.lit(end).alias("pos"), F.lit("Keywords").alias("status"), "companies", F.lit("companies whose accounts mention at least one keyword").alias("meaning")
    )
    listed = rows.sparkSession.createDataFrame([(end + 1, None, None, f"Searched for {len(keywords)}: " + ", ".join(keywords))], "pos int, status string, companies long, meaning string")
    return summary.unionByName(some).unionByName(listed)


def mentions_keywords(found: Column) -> Column:
    return F.coalesce(F.size(found) > 0, F.lit(False))
