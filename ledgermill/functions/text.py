"""Column functions over names, numbers, headings and notes; all of them built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import constants as K


def bound(value: Column, use) -> Column:
    """``use(value)`` with the value computed once: in a lambda it is a variable, where a column that is used twice is two expressions."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def strip(c: Column) -> Column:
    """Without outer white space of any kind."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def _replaced(c: Column, *steps: tuple[str, str]) -> Column:
    for pattern, by in steps:
        c = F.regexp_replace(c, "(?U)" + pattern, by)
    return c


def normalised_name(name: Column) -> Column:
    """A company name in capitals without legal form, leading THE and punctuation; null gives the empty string."""
    c = F.replace(F.upper(F.coalesce(name, F.lit(""))), F.lit("&"), F.lit(" AND "))
    c = _replaced(c, *K.NAME_STEPS)
    return strip(_replaced(strip(c), (r"^THE\s+", ""), (r"\s+", " ")))


def clean_number(number: Column, numeric: bool = False) -> Column:
    """A company number as the register writes it. ``numeric``: the column is a number, of which whole values lose their decimals."""
    text = F.when(number == F.floor(number), number.cast("decimal(38,0)").cast("string")).otherwise(number.cast("string")) if numeric else number.cast("string")
    s = F.upper(F.regexp_replace(F.coalesce(text, F.lit("")), "[^A-Za-z0-9]", ""))
    digits = F.regexp_extract(s, r"^[A-Z]{2}(\d{1,6})$", 1)
    padded = F.concat(F.substring(s, 1, 2), F.lpad(digits, 6, "0"))
    return F.when(s.rlike(r"^\d+$"), F.lpad(s, F.greatest(F.length(s), F.lit(8)), F.lit("0"))).when(digits != "", padded).otherwise(s)


def without_legal_ending(name: Column) -> Column:
    return F.regexp_replace(name, K.LEGAL_ENDING, "")


def without_title(name: Column) -> Column:
    return F.regexp_replace(name, K.TITLE, "")


def form_encoded(c: Column) -> Column:
    """As in a query string: blanks are +."""
    return F.replace(F.replace(F.url_encode(c), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def money(value: Column, currency: Column) -> Column:
    """``£1,234``; other currencies than GBP, EUR and USD stand behind; null gives the empty string. What rounds to zero has no sign."""
    digits = F.when(F.rint(value) == 0, "0").otherwise(F.format_number(value, 0))
    sign = F.create_map(*[F.lit(x) for x in ("GBP", "£", "EUR", "€", "USD", "$")])[F.coalesce(currency, F.lit("GBP"))]
    return F.when(value.isNull(), "").when(sign.isNotNull(), F.concat(sign, digits)).otherwise(F.concat_ws(" ", digits, currency))


def page_currency(text: Column) -> Column:
    """EUR, USD or GBP by the first of these whose sign or word the text shows, else the empty string."""
    found = F.lit("")
    for currency, pattern in reversed(K.CURRENCIES):
        found = F.when(text.rlike(pattern), currency).otherwise(found)
    return found


def _has_word(text: Column, word: str) -> Column:
    """Whether one of the words between white space and bars is wholly of this form."""
    return text.rlike(rf"(?U)(?<![^\s|])(?:{word})(?![^\s|])")


def unit_multiplier(text: Column) -> Column:
    """What a heading says figures are in: 1,000,000 or 1,000 or 1. Null counts as no heading."""
    return F.when(_has_word(text, K.MILLIONS_WORD), 1_000_000).when(_has_word(text, K.THOUSANDS_WORD), 1_000).otherwise(1)


def unit_label(multiplier: Column) -> Column:
    return F.when(multiplier == 1_000_000, "m").when(multiplier == 1_000, "000").otherwise("")


def is_heading_line(line: Column) -> Column:
    """Nothing but heading words, and at least one."""
    return line.rlike(rf"(?iU)^[\s|]*{K.HEADING_WORD}(?:[\s|]+{K.HEADING_WORD})*[\s|]*$")


def why_missing(description: Column) -> Column:
    """Why accounts with this description need not show turnover; the empty string if they should."""
    d = F.lower(F.coalesce(description, F.lit("")))
    small = d.contains("total exemption") | d.contains("abridged") | d.contains("small") | d.contains("filleted")
    return (
        F.when(d.contains("dormant"), "dormant company, no turnover")
        .when(d.contains("micro"), "micro-entity accounts, turnover not required to be filed")
        .when(small, "small company accounts, profit and loss not filed")
        .when(d.contains("medium"), "medium company accounts, which may leave turnover out")
        .otherwise("")
    )


def is_annual_accounts(kind: Column, description: Column) -> Column:
    """Accounts or amended accounts, but not interim or initial ones."""
    return kind.isin(*K.ACCOUNT_TYPES) & ~F.coalesce(description, F.lit("")).rlike(r"(?iU)^\s*(?:interim|initial)\s+accounts")


def filing_description(description: Column) -> Column:
    return F.split(description, " View PDF")[0]


def last_accounts(page_text: Column) -> Column:
    """Three values: the date as text, the empty string for a company that has filed none yet, null if the page doesn't say."""
    t = F.regexp_replace(page_text, r"(?U)\s+", " ")
    made_up = F.regexp_extract(t, r"(?U)Last accounts made up to (\d{1,2} \w+ \d{4})", 1)
    return F.when(made_up != "", made_up).when(t.contains("First accounts made up to"), "")


def is_overdue(page_text: Column) -> Column:
    return F.lower(F.regexp_replace(F.coalesce(page_text, F.lit("")), r"(?U)\s+", " ")).contains("accounts overdue")


def is_insolvent(status: Column) -> Column:
    return F.coalesce(F.lower(status).isin(*K.INSOLVENT_STATUSES), F.lit(False))


def joined_notes(note: Column, *notes: Column) -> Column:
    """The note and then the notes in their order, without empty ones."""
    return F.array_join(F.filter(F.array(note, *notes), lambda x: x.isNotNull() & (x != "")), "; ")
