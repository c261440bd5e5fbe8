"""The whole job: a list of companies to one result row each, by set-based steps over the register, controllers, filings, electronic documents and pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import FILING_ROWS
from ..functions.text import is_overdue, last_accounts, why_missing
from ..storage import save, spread
from . import facts, filings as filings_, keywords as keywords_, match, pages as pages_, report
from .lines import worth_reading

SCANNED = "OCR"


def register_with_profiles(profiles: DataFrame) -> DataFrame:
    """Register rows ``company_number, company_name, company_status, page_text`` with what their page says: ``last_accounts, accounts_overdue``."""
    return profiles.withColumns({"last_accounts": last_accounts(F.col("page_text")), "accounts_overdue": is_overdue(F.col("page_text"))})


def matched(firsts: DataFrame, register: DataFrame) -> DataFrame:
    """Different companies ``name_key, number_key, name, number`` with their row of the register, by number, else by name, and ``match_note``."""
    columns = ["company_number", "company_name", "company_status", "last_accounts", "accounts_overdue"]
    by_number = match.match_numbers(firsts, register.select(*columns))
    keep = ["name_key", "number_key", "name", *columns, "match_note"]
    best = match.match_names(firsts, register.select("company_number", "company_name")).drop("company_name").withColumnRenamed("company_number", "__c")
    by_name = best.join(register.select(*columns), F.col("__c") == F.col("company_number"), "left")
    return by_number.select(*keep).unionByName(by_name.select(*keep))


def pages_read(pages: DataFrame, max_pages: int | None, read_scanned: bool, keywords: list[str] | None, ocr_keywords: bool) -> DataFrame:
    """``doc_id, pg_checked, pg_pages, keyword_pages, scanned_skipped, keyword_skipped, pg_problem``: how far each document was read."""
    kept = pages_.in_order(pages, max_pages)
    scanned = F.coalesce(F.col("method").contains(SCANNED), F.lit(False))
    searched = (~scanned | F.lit(read_scanned and ocr_keywords)) & (F.trim(F.coalesce("text", F.lit(""))) != "")
    problem = F.max("problem") if "problem" in pages.columns else F.max(F.lit(None).cast("string"))
    return kept.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("pg_checked"),
        F.max("n_pages").cast("long").alias("pg_pages"),
        F.count_if(searched).alias("keyword_pages"),
        F.bool_or(scanned & F.lit(not read_scanned)).alias("scanned_skipped"),
        F.bool_or(scanned & F.lit(read_scanned and not ocr_keywords)).alias("keyword_skipped"),
        problem.alias("pg_problem"),
    )


def keyword_note() -> Column:
    """Why pages weren't all searched, if they weren't."""
    return (
        F.when(F.col("scanned_skipped"), "keywords not searched in scanned pages (scanned-PDF reading is turned off)")
        .when(F.col("keyword_skipped"), "keywords not searched in scanned pages (keyword search of scanned PDFs is turned off)")
        .when(F.col("keyword_pages") < F.col("pg_pages"), F.concat(F.lit("keywords searched in "), F.col("keyword_pages").cast("string"), F.lit(" of "), F.col("pg_pages").cast("string"), F.lit(" pages (page limit)")))
    )


def company_results(
    companies: DataFrame,
    register: DataFrame,
    psc: DataFrame,
    filings: DataFrame,
    documents: DataFrame,
    pages: DataFrame,
    keywords: list[str] | None = None,
    max_pages: int | None = None,
    read_scanned: bool = True,
    ocr_keywords: bool = True,
    as_of: Column | None = None,
    newest: int | None = FILING_ROWS,
) -> DataFrame:
    """One row for each row of ``companies`` (``row_no, name, number``) with a name or number, in the columns of :func:`report.output_rows`.

    ``register``: ``company_number, company_name, company_status, last_accounts, accounts_overdue``; ``psc`` and ``filings`` as in :mod:`filings`; ``documents``:
    ``doc_id, url, html`` of electronic accounts; ``pages``: ``doc_id, url, page, n_pages, text, method`` of others, and ``problem`` where one can't be read.

    Each company is looked up once, however often it is in the list. Only documents of the newest accounts of the companies found are read, electronic ones
    first; pages only where those give no turnover. What several steps read is stored in the shared folder between them.
    """
    keyed = match.with_keys(companies)
    firsts = save(spread(match.distinct_companies(keyed), "name_key", "number_key"), "firsts")
    found = save(matched(firsts, register), "matched")
    numbers = found.filter("company_number is not null").select(F.col("company_number").alias("__n"), "last_accounts").distinct()
    own = lambda df, some=numbers: df.join(some, F.col("company_number") == F.col("__n"), "left_semi")
    # a new company, whose page says that it has filed nothing yet, has no accounts to read
    latest = save(filings_.latest_accounts(own(filings, numbers.filter("last_accounts is null or last_accounts != ''")), newest), "latest")

    electronic = documents.join(latest.select(F.col("xhtml_url").alias("__u")).distinct(), F.col("url") == F.col("__u"), "left_semi")
    parsed = save(facts.read_documents(electronic), "parsed")
    figures = save(facts.document_figures(parsed).withColumnRenamed("doc_id", "__id").join(electronic.select("doc_id", "url"), F.col("__id") == F.col("doc_id")), "ix_figures")
    known = figures.filter(F.col("turnover").isNotNull() | F.col("error").isNotNull()).select(F.col("url").alias("__k"))
    present = figures.select(F.col("url").alias("__x"))
    # pages are read where the electronic document has no turnover, and the accounts' kind doesn't say why
    open_ = latest.join(known, F.col("xhtml_url") == F.col("__k"), "left_anti").join(present, F.col("xhtml_url") == F.col("__x"), "left")
    open_ = open_.filter(F.col("__x").isNull() | (why_missing(F.col("description")) == "")).select(F.col("pdf_url").alias("__p"), F.col("__x").isNotNull().alias("__searched"))
    wanted = save(pages.join(open_.groupBy("__p").agg(F.bool_and("__searched").alias("__searched")), F.col("url") == F.col("__p")).drop("__p"), "wanted")
    seen = pages_read(wanted, max_pages, read_scanned, keywords, ocr_keywords)
    scanned = F.coalesce(F.col("method").contains(SCANNED), F.lit(False))
    readable = wanted if read_scanned else wanted.filter(~scanned)
    if read_scanned and keywords is None:  # of scanned pages, only those worth it
        readable = readable.filter(~scanned | worth_reading(pages_.page_rows(F.col("text"))))
    # a page is read where it is dealt to, and only its rows with a label leave that task
    page_figures = pages_.page_figures(spread(readable, "doc_id", "page"), max_pages, None if keywords is not None else pages_.REACH)
    names = {"turnover": "pg_turnover", "prior": "pg_prior", "unit": "pg_unit", "page": "pg_page", "method": "pg_method", "currency": "pg_currency", "cash": "pg_cash", "debtors": "pg_debtors", "balance_method": "pg_balance_method"}
    page_figures = page_figures.select(F.col("doc_id").alias("__f"), *[F.col(a).alias(b) for a, b in names.items()])
    urls = wanted.groupBy("doc_id").agg(F.first("url").alias("__pdf")).withColumnRenamed("doc_id", "__d")
    paged = seen.join(page_figures, F.col("doc_id") == F.col("__f"), "left").join(urls, F.col("doc_id") == F.col("__d")).drop("doc_id", "__f", "__d")

    ix = {"turnover": "ix_turnover", "prior_turnover": "ix_prior", "currency": "ix_currency", "period_end": "ix_end", "months": "ix_months", "method": "ix_method", "cash": "ix_cash", "debtors": "ix_debtors", "error": "ix_error", "url": "__ix"}
    figures = figures.select(*[F.col(a).alias(b) for a, b in ix.items()])
    rows = found.join(latest.withColumnsRenamed({"company_number": "__l", "description": "accounts_type"}), F.col("company_number") == F.col("__l"), "left")
    rows = rows.join(figures, F.col("xhtml_url") == F.col("__ix"), "left").join(paged, F.col("pdf_url") == F.col("__pdf"), "left")
    rows = filings_.with_controllers(rows, own(psc)).withColumn("pscs", F.when(F.col("company_number").isNotNull(), F.col("pscs")))
    made = {"has_xhtml": F.col("__ix").isNotNull(), "has_pages": F.col("__pdf").isNotNull(), "failed": F.col("ix_error").isNotNull()}
    made["keyword_note"] = F.when(F.col("pg_problem").isNull(), keyword_note()) if keywords is not None else F.lit(None).cast("string")
    if keywords is not None:
        # an electronic document is searched as one text, and then its pages aren't
        texts = parsed.join(electronic.select(F.col("doc_id").alias("__e"), "url"), F.col("doc_id") == F.col("__e")).select("url", "text", F.lit(False).alias("ocr"))
        searched = pages_.in_order(wanted, max_pages).filter(~F.col("__searched") & (~scanned | F.lit(read_scanned and ocr_keywords)))
        if "problem" in pages.columns:
            searched = searched.filter("problem is null")
        both = texts.unionByName(searched.select("url", "text", scanned.alias("ocr")))
        cells = keywords_.document_report(keywords_.page_counts(both, keywords, ocr=F.col("ocr")), "url", len(keywords))
        # a document of which no page was searched: none found
        cells = cells.select(F.col("url").alias("__w"), "keywords_found", "keyword_count", "keyword_cell")
        rows = rows.join(cells, F.coalesce("__ix", "__pdf") == F.col("__w"), "left")
        nothing = F.col("__w").isNull() & F.col("__ix").isNull() & F.col("__pdf").isNotNull() & F.col("pg_problem").isNull() | F.col("__w").isNotNull() & F.col("keyword_cell").isNull()
        rows = rows.withColumns({"keyword_cell": F.when(nothing, "none found").otherwise(F.col("keyword_cell")), "keyword_count": F.when(nothing, 0).otherwise(F.col("keyword_count"))})
        made["keyword_note"] = F.when(F.col("__ix").isNull(), made["keyword_note"])
    rows = rows.withColumns(made).withColumn("row_no", F.lit(0).cast("long"))
    # companies without a document share the empty key by which documents are joined
    decided = report.decided(spread(rows, "name_key", "number_key"), as_of)
    listed = [*report.DECIDED, "pscs", "pdf_url", *(["keyword_cell", "keyword_count", "keywords_found"] if keywords is not None else [])]
    results = save(decided.select("name_key", "number_key", *[c for c in listed if c not in ("row_no", "name", "number_key")]), "results")
    return report.output_rows(match.fan_out(keyed.select("row_no", "name", "name_key", "number_key"), results))
