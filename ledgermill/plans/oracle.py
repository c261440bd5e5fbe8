"""For the queries that SQL can express, the same result in DuckDB's SQL over the same tables."""

from __future__ import annotations

from ..constants import MEANINGS, STATUSES
from .proxies import COMPANIES_SQL, ENDINGS, FACTS_SQL, FILINGS_SQL, KEYWORDS, OCR_SOURCE, OTHER_NAME, ROWS_SQL, clean_sql
from .world import KEYWORDS as FEW, REPORT, letters_sql, world_sql


def _keywords() -> str:
    kept, seen = [], set()
    for k, word in enumerate(KEYWORDS):
        norm = " ".join(word.lower().split())
        if norm not in seen:
            seen.add(norm)
            compact = norm.replace(" ", "") if " " in norm or len(norm) >= 8 else None
            kept.append(f"({k}, '{word}', ' {norm.replace(' ', '  ')} ', {'NULL' if compact is None else repr(compact)})")
    return ", ".join(kept)


_PAGES = """SELECT doc_id, source, len(parts)::INT AS n_pages, unnest(range(len(parts)))::INT AS page, unnest(parts) AS text
  FROM (SELECT doc_id, source, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents)"""

_FORMS = f"""pages AS ({_PAGES}),
normal AS (SELECT *, trim(regexp_replace(regexp_replace(lower(text), '-\\s*\\n\\s*', '', 'g'), '[^a-z0-9]+', ' ', 'g')) AS t FROM pages),
forms AS (SELECT *, ' ' || replace(t, ' ', '  ') || ' ' AS x, CASE WHEN source = '{OCR_SOURCE}' THEN replace(t, ' ', '') END AS solid FROM normal)"""

_HITS = f"""{_FORMS},
words(kw_pos, keyword, padded, compact) AS (VALUES {_keywords()}),
plain AS (SELECT doc_id, source, page, kw_pos, keyword, solid, compact, (length(x) - length(replace(x, padded, ''))) // length(padded) AS n FROM forms, words WHERE text <> ''),
hits AS (SELECT doc_id, source, page, kw_pos, keyword,
  CASE WHEN n = 0 AND solid IS NOT NULL AND compact IS NOT NULL THEN (length(solid) - length(replace(solid, compact, ''))) // length(compact) ELSE n END AS n FROM plain)"""

_ENDING = "CASE p_partkey % 5 " + " ".join(f"WHEN {k} THEN '{e}'" for k, e in enumerate(ENDINGS)) + " END"


def _normalised(c: str) -> str:
    s = f"replace(upper(coalesce({c}, '')), '&', ' AND ')"
    for pattern, by in (
        (r"\bP\.\s*L\.\s*C\.?", "PLC"), (r"\bL\.\s*T\.\s*D\.?", "LTD"), (r"[^\pL\pN_\s]", " "), (r"\bLTD\b", "LIMITED"), (r"\bPLC\b", "PUBLIC LIMITED COMPANY"),
        (r"\b(PUBLIC LIMITED COMPANY|LIMITED LIABILITY PARTNERSHIP|LIMITED|COMPANY)\b", " "), (r"^\s+|\s+$", ""), (r"^THE\s+", ""), (r"\s+", " "),
    ):
        s = f"regexp_replace({s}, '{pattern}', '{by}', 'g')"
    return f"trim({s})"


_REGISTER = "SELECT lpad(c_custkey::VARCHAR, 8, '0') AS company_number, c_name AS company_name FROM customer"
_KEYED = f"SELECT row_no, name, number, lower(trim(coalesce(name, ''))) AS name_key, {clean_sql('number')} AS number_key FROM ({COMPANIES_SQL}) WHERE coalesce(name, '') <> '' OR coalesce(number, '') <> ''"
_GOOD = "type IN ('AA', 'AAMD') AND NOT regexp_matches(description, '(?i)^\\s*(interim|initial)\\s+accounts')"
_LATEST = f"""WITH r AS (SELECT *, row_number() OVER (PARTITION BY company_number ORDER BY filed_on DESC, pos) AS rn FROM ({FILINGS_SQL})),
g AS (SELECT *, row_number() OVER (PARTITION BY company_number ORDER BY rn) AS first FROM r WHERE {{deep}} {_GOOD})
SELECT company_number, filed_on::VARCHAR AS filed_on, type, string_split(description, ' View PDF')[1] AS description, pos FROM g WHERE first = 1"""

_REASON = """CASE WHEN lower(description) LIKE '%dormant%' THEN 'dormant company, no turnover' WHEN lower(description) LIKE '%micro%' THEN 'micro-entity accounts, turnover not required to be filed'
  WHEN regexp_matches(lower(description), 'total exemption|abridged|small|filleted') THEN 'small company accounts, profit and loss not filed'
  WHEN lower(description) LIKE '%medium%' THEN 'medium company accounts, which may leave turnover out' ELSE '' END"""


def _rows(label: int, start: bool) -> str:
    """The first row of a label; with ``start``, from the first "Current assets" row on. In orders of remainder 2 a sentence with an m stands above, which
    counts for eight rows."""
    scale = "CASE WHEN doc_id % 3 = 0 THEN 1000 WHEN doc_id % 3 = 1 OR place <= 8 THEN 1000000 ELSE 1 END"
    begin = "line_no >= coalesce(head, -1)" if start else "true"
    return f"""WITH l AS ({ROWS_SQL}), b AS (SELECT *, min(CASE WHEN kind = 4 THEN line_no END) OVER (PARTITION BY doc_id) AS head, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS place FROM l),
f AS (SELECT doc_id, min(line_no) AS line_no, arg_min(price, line_no) AS price, min(place) AS place FROM b WHERE {begin} AND kind = {label} GROUP BY doc_id), g AS (SELECT *, {scale} AS mult FROM f)
SELECT doc_id, price * mult AS current, price * 2 * mult AS prior, CASE mult WHEN 1000 THEN '000' WHEN 1000000 THEN 'm' ELSE '' END AS unit, line_no FROM g"""


_HEADLINE = f"""WITH f AS ({FACTS_SQL}), o AS (SELECT *, row_number() OVER (PARTITION BY doc_id, figure, tag_pos, end_date ORDER BY rank, pos, value) AS n FROM f),
p AS (SELECT *, lead(value) OVER (PARTITION BY doc_id, figure, tag_pos ORDER BY end_date DESC) AS prior FROM o WHERE n = 1),
q AS (SELECT *, row_number() OVER (PARTITION BY doc_id, figure ORDER BY tag_pos, end_date DESC) AS m FROM p),
h AS (SELECT doc_id, figure, value AS current, prior, unit, end_date, start_date FROM q WHERE m = 1)"""

_PSC = """SELECT s_nationkey::VARCHAR AS company_number, s_suppkey, 'Mr ' || s_name AS name, s_suppkey % 3 = 0 AS corporate FROM supplier
  WHERE s_suppkey % 4 <> 0 AND NOT (s_suppkey % 3 <> 0 AND s_suppkey % 7 = 0)"""

# the rules of a status by their numbers, as in the report
_STATUS = f"""WITH reg AS (SELECT c_custkey AS k, lpad(c_custkey::VARCHAR, 8, '0') AS company_number FROM customer),
latest AS ({_LATEST.format(deep='')}),
latest2 AS (SELECT l.company_number, l.filed_on::DATE AS filed_on, l.description, l.pos, o_totalprice AS amount FROM latest l JOIN orders ON o_orderkey = l.pos),
j AS (SELECT k, pos, amount, filed_on, {_REASON} AS reason, description, k % 13 <> 0 AS found, CASE WHEN k % 17 = 0 THEN '' WHEN k % 2 = 0 THEN '31 March 2025' END AS last, company_number FROM reg LEFT JOIN latest2 USING (company_number)),
r AS (SELECT *, CASE WHEN k % 97 = 0 THEN 0 WHEN NOT found THEN 2 WHEN last = '' THEN 3 WHEN description IS NULL AND last IS NULL THEN 4 WHEN description IS NULL THEN 5 WHEN pos % 3 = 0 AND pos % 4 = 0 THEN 6
  WHEN pos % 3 = 0 AND reason <> '' THEN 7 WHEN pos % 5 = 4 THEN 8 WHEN pos % 7 = 6 THEN 9 WHEN pos % 8 <> 1 AND pos % 2 = 0 THEN 10 WHEN pos % 8 <> 1 THEN 11 WHEN reason <> '' THEN 12 WHEN pos % 3 = 0 THEN 13 ELSE 14 END AS rule FROM j),
s AS (SELECT *, CASE WHEN rule = 0 THEN 'ERROR' WHEN rule = 2 THEN 'NOT FOUND' WHEN rule IN (3, 4, 7, 12, 13) THEN 'NOT DISCLOSED' WHEN rule IN (6, 11) THEN 'FOUND' WHEN rule = 10 THEN 'VERIFY' ELSE 'CHECK PDF' END AS status,
  CASE WHEN rule = 6 THEN 'GBP' WHEN rule IN (10, 11) THEN CASE WHEN pos % 9 = 0 THEN 'EUR' ELSE 'GBP' END END AS currency FROM r)"""

_NOTE = """concat_ws('; ', CASE rule WHEN 0 THEN 'a source failed for this row, run it again' WHEN 2 THEN 'company number not on the register' WHEN 3 THEN 'no accounts filed yet (new company)' WHEN 4 THEN 'no accounts filed'
  WHEN 5 THEN 'accounts made up to ' || last || ' exist but weren''t found in the filing history, check the company page' WHEN 7 THEN reason WHEN 8 THEN 'the accounts filing has no downloadable document'
  WHEN 9 THEN 'the accounts PDF couldn''t be downloaded' WHEN 12 THEN reason WHEN 13 THEN 'turnover not shown in the filed accounts' WHEN 14 THEN 'no turnover line found in ' || pos % 50 || ' pages, open the PDF to check' END,
  CASE WHEN found AND k % 5 = 1 THEN 'company status: Dissolved' WHEN found AND k % 5 = 2 THEN 'company status: Liquidation' END, CASE WHEN found AND k % 11 = 0 THEN 'accounts overdue' END,
  CASE WHEN found AND rule >= 6 AND date_diff('day', filed_on, DATE '2001-01-01') > 730 THEN 'latest accounts are over 2 years old (' || strftime(filed_on, '%-d %B %Y') || ')' END,
  CASE WHEN rule = 6 AND pos % 14 NOT IN (0, 11, 12, 13) THEN 'these accounts cover ' || pos % 14 || ' months, not a normal year' END,
  CASE WHEN rule = 10 THEN 'read by OCR from page ' || pos % 40 || ', check the figures against the PDF' END, CASE WHEN currency <> 'GBP' THEN 'figures are in ' || currency END)"""


def _summary() -> str:
    listed = ", ".join("({}, '{}', '{}')".format(k, s, MEANINGS[s].replace("'", "''")) for k, s in enumerate(STATUSES))
    return f"""{_STATUS}, m(pos, status, meaning) AS (VALUES {listed}), c AS (SELECT status, count(*) AS n FROM s GROUP BY status)
SELECT pos, status, coalesce(n, 0)::BIGINT AS companies, meaning FROM m LEFT JOIN c USING (status) UNION ALL SELECT {len(STATUSES)}, 'Total', sum(n)::BIGINT, '' FROM c"""


_WORLD = world_sql(_LATEST.format(deep="rn <= 500 AND"), _REASON)


def _company_summary() -> str:
    listed = ", ".join("({}, '{}', '{}')".format(k, s, MEANINGS[s].replace("'", "''")) for k, s in enumerate(STATUSES))
    n = len(STATUSES)
    return f"""{_WORLD}, m(pos, status, meaning) AS (VALUES {listed}), c AS (SELECT turnover_status AS status, count(*) AS n FROM res GROUP BY 1)
SELECT pos, status, coalesce(n, 0)::BIGINT AS companies, meaning FROM m LEFT JOIN c USING (status) UNION ALL SELECT {n}, 'Total', sum(n)::BIGINT, '' FROM c
UNION ALL SELECT {n + 1}, 'Keywords', count(*) FILTER (WHERE keyword_count > 0)::BIGINT, 'companies whose accounts mention at least one keyword' FROM res
UNION ALL SELECT {n + 2}, NULL, NULL, 'Searched for {len(FEW)}: {", ".join(FEW)}'"""


# text between tags, without scripts and styles; the entities that the tables have
_VISIBLE = """list_aggregate(list_filter(list_transform(string_split_regex(regexp_replace(regexp_replace(html, '<(script|style)[^>]*>.*?</(script|style)>', '<x>', 'gs'), '<!--.*?-->', '', 'gs'), '<[^>]*>'),
  lambda x: trim(replace(replace(replace(replace(replace(replace(replace(x, '&copy;', '©'), '&middot;', '·'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#x27;', ''''), '&amp;', '&'))), lambda x: x <> ''), 'string_agg', ' ')"""

_EVENTS = "SELECT event_id, user_id AS doc_id, day(ts)::INT AS page, event_type AS text, second(ts)::INT AS sec, hour(ts) * 60 + minute(ts) AS y FROM events"

ORACLE_SQL = {
    "keyword_counts": f"WITH {_HITS} SELECT doc_id, keyword, sum(n)::BIGINT AS n FROM hits WHERE n > 0 GROUP BY doc_id, keyword",
    "keyword_ranked_cell": f"""WITH {_HITS}, d AS (SELECT doc_id, kw_pos, keyword, sum(n)::BIGINT AS n FROM hits WHERE n > 0 GROUP BY ALL),
c AS (SELECT doc_id, count(*)::INT AS c, string_agg(keyword || ' (' || n || ')', ', ' ORDER BY n DESC, kw_pos) AS cell FROM d GROUP BY doc_id),
a AS (SELECT doc_id, bool_or(text <> '') AS searched FROM pages GROUP BY doc_id)
SELECT doc_id, CASE WHEN searched THEN coalesce(c, 0)::INT END AS keyword_count, CASE WHEN searched THEN coalesce(cell, 'none found') END AS keyword_cell FROM a LEFT JOIN c USING (doc_id)""",
    "keyword_report": f"""WITH {_HITS}, d AS (SELECT doc_id, kw_pos, keyword FROM hits WHERE n > 0 GROUP BY ALL), c AS (SELECT doc_id, count(*) AS c, string_agg(keyword, '|' ORDER BY kw_pos) AS found FROM d GROUP BY doc_id),
a AS (SELECT doc_id, bool_or(text <> '') AS searched FROM pages GROUP BY doc_id)
SELECT doc_id, CASE WHEN searched THEN coalesce(found, '') END AS found, CASE WHEN searched THEN coalesce(c, 0) = 5 END AS all_found FROM a LEFT JOIN c USING (doc_id)""",
    "keyword_lists": """WITH t AS (SELECT p_partkey, unnest([0, 1, 3, 4]) AS k, unnest([p_name, upper(p_type), p_brand, p_type || '-']) AS keyword FROM part),
w AS (SELECT p_partkey::BIGINT * 1048576 + k AS kw_pos, keyword, trim(regexp_replace(lower(keyword), '[^a-z0-9]+', ' ', 'g')) AS norm FROM t)
SELECT min(kw_pos) AS kw_pos, arg_min(keyword, kw_pos) AS keyword, norm FROM w GROUP BY norm""",
    "keyword_long_list": f"""WITH {_FORMS}, typed AS (SELECT doc_id * 2 AS kw_pos, regexp_extract(text, '[A-Za-z0-9]+ [A-Za-z0-9]+ [A-Za-z0-9]+') AS keyword FROM documents UNION ALL SELECT p_partkey * 2 + 1, p_name FROM part),
normed AS (SELECT *, trim(regexp_replace(lower(keyword), '[^a-z0-9]+', ' ', 'g')) AS norm FROM typed), listed AS (SELECT min(kw_pos) AS kw_pos, arg_min(trim(keyword), kw_pos) AS keyword, norm FROM normed WHERE norm <> '' GROUP BY norm),
needles AS (SELECT *, split_part(norm, ' ', 1) AS w, ' ' || replace(norm, ' ', '  ') || ' ' AS padded, CASE WHEN norm LIKE '% %' OR length(norm) >= 8 THEN replace(norm, ' ', '') END AS compact FROM listed),
w AS (SELECT DISTINCT doc_id, page, unnest(string_split(t, ' ')) AS w FROM forms), near AS (SELECT doc_id, page, kw_pos, keyword, padded FROM w JOIN needles USING (w)),
plain AS (SELECT doc_id, page, kw_pos, keyword, (length(x) - length(replace(x, padded, ''))) // length(padded) AS n FROM near JOIN forms USING (doc_id, page)), found AS (SELECT * FROM plain WHERE n > 0),
glued AS (SELECT doc_id, page, kw_pos, keyword, (length(solid) - length(replace(solid, compact, ''))) // length(compact) AS n FROM forms JOIN needles ON contains(solid, compact)),
hits AS (SELECT * FROM found UNION ALL SELECT * FROM glued g WHERE NOT EXISTS (SELECT 1 FROM found f WHERE f.doc_id = g.doc_id AND f.page = g.page AND f.kw_pos = g.kw_pos))
SELECT doc_id, kw_pos, keyword, sum(n)::BIGINT AS n FROM hits GROUP BY ALL""",
    "keyword_coverage": f"""WITH {_HITS}, h AS (SELECT doc_id, page, bool_or(n > 0) AS hit FROM hits GROUP BY ALL)
SELECT source, count(*)::BIGINT AS pages, count(*) FILTER (WHERE hit)::BIGINT AS pages_with_keywords, count(*) FILTER (WHERE text = '')::BIGINT AS empty_pages
FROM pages LEFT JOIN h USING (doc_id, page) GROUP BY source""",
    "clean_numbers": f"SELECT row_no, {clean_sql('number')} AS clean FROM ({COMPANIES_SQL})",
    "register_match": f"""SELECT row_no, number_key, company_number, company_name, CASE WHEN company_number IS NULL THEN 'company number ' || number_key || ' not on the register'
  WHEN row_no % 3 = 1 THEN 'the number belongs to ' || company_name || ', check it matches ''{OTHER_NAME}''' END AS match_note
FROM (SELECT row_no, {clean_sql('number')} AS number_key FROM ({COMPANIES_SQL})) k LEFT JOIN ({_REGISTER}) r ON number_key = company_number WHERE number_key <> ''""",
    "register_unmatched": f"SELECT row_no, number_key FROM ({_KEYED}) WHERE number_key <> '' AND number_key NOT IN (SELECT company_number FROM ({_REGISTER}))",
    "dedupe_fan_out": f"""WITH k AS ({_KEYED}), f AS (SELECT name_key, number_key, arg_min(coalesce(number, '~'), row_no) AS n FROM k GROUP BY name_key, number_key)
SELECT row_no, k.name_key, k.number_key, nullif(n, '~') AS first_number, length(k.name_key)::INT AS name_length FROM k JOIN f USING (name_key, number_key)""",
    "normalised_names": f"SELECT p_partkey AS row_no, {_normalised('name')} AS normalised FROM (SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'The ' ELSE '' END || p_name || ' ' || p_brand || {_ENDING} AS name FROM part)",
    "name_exact_match": f"""WITH n AS (SELECT p_partkey AS row_no, {_normalised('name')} AS searched FROM (SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'The ' ELSE '' END || p_name || ' ' || p_brand || {_ENDING} AS name FROM part)),
r AS (SELECT {_normalised("p_name || ' ' || p_brand")} AS registered, min(p_partkey) AS number, count(*)::BIGINT AS same_name FROM part GROUP BY 1)
SELECT row_no, searched, number, same_name FROM n LEFT JOIN r ON searched = registered""",
    "name_fuzzy_best": f"""SELECT row_no, CASE WHEN score >= 90 THEN lpad(row_no::VARCHAR, 8, '0') END AS company_number, score, coalesce(score >= 90 AND row_no % 10 = 0, false) AS ambiguous,
  CASE WHEN score IS NULL THEN 'company not found on the register' WHEN score < 90 THEN 'no confident match (closest: ' || {letters_sql('row_no')} || ' PLC, ' || round_even(score, 0)::INT || '%), add the company number'
    WHEN row_no % 10 = 0 THEN 'several companies with near-identical names, add the company number to be sure' END AS match_note
FROM (SELECT p_partkey AS row_no, CASE WHEN m % 4 < 2 THEN 96 WHEN m = 3 THEN 100 WHEN m = 6 THEN 2400::DOUBLE / 39 WHEN m = 7 THEN 2400::DOUBLE / 27 END::DOUBLE AS score FROM (SELECT p_partkey, p_partkey % 8 AS m FROM part))""",
    "profile_pages": """SELECT lpad(c_custkey::VARCHAR, 8, '0') AS company_number, CASE WHEN c_custkey % 17 = 0 THEN '' WHEN c_custkey % 2 = 0 THEN '31 March 2025' END AS last_accounts, c_custkey % 11 = 0 AS accounts_overdue FROM customer""",
    "company_report": f"{_WORLD} SELECT {', '.join({'company_name': 'shown_name AS company_name', 'company_number': 'shown_number AS company_number'}.get(c, c) for c in REPORT)} FROM res",
    "company_summary": _company_summary(),
    "company_list": """SELECT CASE WHEN c_custkey % 5 <> 0 THEN 'Café; "' || c_name || '"' END AS name, CASE WHEN c_custkey % 3 <> 0 THEN c_custkey::VARCHAR END AS number FROM customer WHERE c_custkey % 15 <> 0""",
    "company_list_named": """SELECT 'T, ' || c_name AS name, CASE WHEN c_custkey % 4 <> 0 THEN (c_custkey + 7)::VARCHAR END AS number FROM customer""",
    "keyword_file": """WITH w AS (SELECT unnest(['FX-Hedging', 'Standard Polished TIN', 'small plated copper']) AS keyword, 0 AS file UNION ALL SELECT lower(trim(p_name)), 1 FROM part UNION ALL SELECT lower(p_type), 1 FROM part),
n AS (SELECT *, trim(regexp_replace(lower(keyword), '[^a-z0-9]+', ' ', 'g')) AS norm FROM w) SELECT arg_min(keyword, file) AS keyword, norm FROM n GROUP BY norm""",
    "document_files": f"""WITH p AS (SELECT page_id, '<p>prix: é</p>' || html AS html FROM pages)
SELECT CASE WHEN page_id % 50 <> 7 THEN page_id END AS doc_id, CASE WHEN page_id % 50 <> 7 THEN (length(html) - length(replace(html, '<tr', ''))) // 3 END::INT AS n_rows,
  CASE WHEN page_id % 50 <> 7 THEN md5(regexp_replace({_VISIBLE}, '\\s+', ' ', 'g')) END AS text_md5, CASE WHEN page_id % 50 = 7 THEN 'not text in utf-8' END AS error FROM p""",
    "first_page_figure": f"""WITH o AS (SELECT o_orderkey AS o, o_custkey AS doc_id, (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1)::INT AS page, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders),
p AS (SELECT *, CASE WHEN n > 40 THEN (page - floor(n * 0.25)::INT + n) % n ELSE page END AS seq FROM o),
t AS (SELECT p.doc_id, arg_min(current, seq) AS turnover, arg_min(prior, seq) AS prior, arg_min(page, seq) + 1 AS page, min(seq) AS first FROM p JOIN ({_rows(0, False)}) f ON f.doc_id = o WHERE o % 2 = 0 GROUP BY p.doc_id),
c AS (SELECT p.doc_id, arg_min(current, seq) AS cash FROM p JOIN ({_rows(2, True)}) f ON f.doc_id = o LEFT JOIN t ON t.doc_id = p.doc_id WHERE o % 2 = 1 AND (first IS NULL OR seq - first <= 15) GROUP BY p.doc_id),
d AS (SELECT p.doc_id, arg_min(current, seq) AS debtors FROM p JOIN ({_rows(3, True)}) f ON f.doc_id = o LEFT JOIN t ON t.doc_id = p.doc_id WHERE o % 2 = 1 AND (first IS NULL OR seq - first <= 15) GROUP BY p.doc_id)
SELECT a.doc_id, turnover, prior, t.page::INT AS page, cash, debtors, pages_checked FROM (SELECT doc_id, count(*)::BIGINT AS pages_checked FROM o GROUP BY doc_id) a LEFT JOIN t USING (doc_id) LEFT JOIN c USING (doc_id) LEFT JOIN d USING (doc_id)""",
    "far_units": """SELECT doc_id, (a + 1000) * m AS current, (a + 2000) * m AS prior, CASE m WHEN 1000 THEN '000' WHEN 1000000 THEN 'm' ELSE '' END AS unit
FROM (SELECT o_orderkey AS doc_id, floor(o_totalprice) AS a, CASE WHEN o_orderkey % 5 = 0 THEN 1 WHEN o_orderkey % 3 = 0 THEN 1000 WHEN o_orderkey % 3 = 1 THEN 1000000 ELSE 1 END AS m FROM orders)""",
    "decimal_rows": """WITH o AS (SELECT o_orderkey AS doc_id, o_orderkey % 6 AS m, o_orderkey % 900 + 10 AS a FROM orders),
v AS (SELECT doc_id, m, a, CASE m WHEN 0 THEN 2000.5 + a WHEN 1 THEN (a || '.5')::DOUBLE WHEN 2 THEN 1000 + a WHEN 3 THEN -1000 * a WHEN 4 THEN 1000 * a END::DOUBLE AS x,
  CASE WHEN m = 1 THEN (a || '.3')::DOUBLE WHEN m = 2 THEN 2000 WHEN m = 4 AND a <= 80 THEN 8000 END::DOUBLE AS y FROM o WHERE m < 5)
SELECT doc_id, round_even(x * 1000000, 0) AS current, round_even(y * 1000000, 0) AS prior, 'm' AS unit FROM v""",
    "page_kinds": """SELECT o_orderkey AS doc_id, m IN (0, 5) AS statement, m IN (2, 4) AS balance, m IN (0, 2) AS worth, CASE WHEN m IN (2, 4) THEN 0 ELSE 1 END::INT AS headings FROM (SELECT o_orderkey, o_orderkey % 6 AS m FROM orders)""",
    "figure_texts": """SELECT c_custkey, CASE WHEN c_custkey % 10 = 0 THEN '' ELSE CASE c_custkey % 4 WHEN 0 THEN '£' WHEN 1 THEN '€' WHEN 2 THEN '$' ELSE '' END || format('{:,}', round_even(c_acctbal, 0)::BIGINT) || CASE WHEN c_custkey % 4 = 3 THEN ' CHF' ELSE '' END END AS money,
  CASE c_custkey % 7 WHEN 1 THEN 'EUR' WHEN 2 THEN 'USD' WHEN 4 THEN 'USD' WHEN 3 THEN '' ELSE 'GBP' END AS currency FROM customer""",
    "ixbrl_documents": f"""SELECT page_id AS doc_id, 0 AS n_facts, (length(html) - length(replace(html, '<tr', ''))) // 3 AS n_rows, md5(regexp_replace({_VISIBLE}, '\\s+', ' ', 'g')) AS text_md5, NULL::VARCHAR AS error FROM pages""",
    "latest_filing": _LATEST.format(deep="rn <= 500 AND"),
    "latest_filing_any_depth": _LATEST.format(deep=""),
    "fact_ranked": FACTS_SQL,
    "fact_headline": f"{_HEADLINE} SELECT * FROM h",
    "ixbrl_figures": f"""{_HEADLINE}, d AS (SELECT DISTINCT l_orderkey AS doc_id FROM lineitem), t AS (SELECT * FROM h WHERE figure = 'turnover')
SELECT d.doc_id, t.current AS turnover, t.prior AS prior_turnover, CASE WHEN t.doc_id IS NOT NULL THEN 'GBP' END AS currency, t.end_date AS period_end,
  round_even(date_diff('day', t.start_date::DATE, t.end_date::DATE) / 30.44, 0)::INT AS months, c.current AS cash, b.current AS debtors
FROM d LEFT JOIN t USING (doc_id) LEFT JOIN (SELECT * FROM h WHERE figure = 'cash') c USING (doc_id) LEFT JOIN (SELECT * FROM h WHERE figure = 'debtors') b USING (doc_id)""",
    "statement_units": f"""WITH l AS (SELECT CASE o_orderkey % 3 WHEN 0 THEN 1000 WHEN 1 THEN 1000000 ELSE 1000000 END AS multiplier, o_orderkey % 3 < 2 AS is_heading FROM orders
UNION ALL SELECT 1, false FROM ({ROWS_SQL})) SELECT multiplier::INT AS multiplier, is_heading, count(*)::BIGINT AS rows FROM l GROUP BY ALL""",
    "page_order": f"SELECT doc_id, page, n_pages, order_pos::INT AS order_pos FROM (SELECT *, CASE WHEN n_pages > 40 THEN (page - floor(n_pages * 0.25)::INT + n_pages) % n_pages ELSE page END AS order_pos FROM ({_PAGES})) WHERE order_pos < 20",
    "page_coverage": f"""WITH p AS (SELECT *, CASE WHEN n_pages > 40 THEN (page - floor(n_pages * 0.25)::INT + n_pages) % n_pages ELSE page END AS order_pos, source = '{OCR_SOURCE}' AS ocr FROM ({_PAGES}))
SELECT doc_id, max(n_pages)::INT AS pages, count(*)::BIGINT AS pages_checked, count(*) FILTER (WHERE ocr)::BIGINT AS scanned_pages, bool_or(ocr) AS any_scanned FROM p WHERE order_pos < 10 GROUP BY doc_id""",
    "line_rebuild": f"SELECT doc_id, page::BIGINT AS page_key, sec::DOUBLE AS top, string_agg(text, ' ' ORDER BY event_id, text) AS line FROM ({_EVENTS}) GROUP BY ALL",
    "box_rows": f"""WITH e AS (SELECT *, (sec % 10 + 5)::DOUBLE AS height FROM ({_EVENTS})), t AS (SELECT doc_id, page, list_sort(list(height))[len(list(height)) // 2 + 1] * 0.6 AS tol FROM e GROUP BY doc_id, page),
g AS (SELECT e.*, CASE WHEN y - lag(y) OVER w > tol THEN 1 ELSE 0 END AS starts FROM e JOIN t USING (doc_id, page) WINDOW w AS (PARTITION BY doc_id, page ORDER BY y, event_id)),
r AS (SELECT *, sum(starts) OVER (PARTITION BY doc_id, page ORDER BY y, event_id ROWS UNBOUNDED PRECEDING)::INT AS row_no FROM g)
SELECT doc_id, page, row_no, string_agg(text, ' ' ORDER BY event_id) AS line, arg_min(text, event_id) AS first FROM r GROUP BY ALL""",
    "figure_rows": _rows(0, False),
    "balance_rows": _rows(2, True),
    "psc_list": f"""WITH p AS ({_PSC}), a AS (SELECT DISTINCT s_nationkey::VARCHAR AS company_number FROM supplier)
SELECT company_number, coalesce(string_agg(name, '; ' ORDER BY s_suppkey), 'none registered') AS cell, count(*) FILTER (WHERE corporate)::INT AS corporate FROM a LEFT JOIN p USING (company_number) GROUP BY company_number""",
    "search_link": f"""WITH p AS ({_PSC}), f AS (SELECT company_number, coalesce(arg_min(name, s_suppkey) FILTER (WHERE NOT corporate), arg_min(name, s_suppkey)) AS person FROM p GROUP BY company_number),
n AS (SELECT n_nationkey::VARCHAR AS company_number, n_name || ' & Sons' AS company FROM nation)
SELECT company_number, company || coalesce(' + ' || person, '') || ' + LinkedIn' AS search_text,
  'https://www.google.com/search?q=' || replace(replace(replace(company || coalesce(' ' || substr(person, 4), '') || ' LinkedIn', '&', '%26'), '#', '%23'), ' ', '+') AS search_url FROM n LEFT JOIN f USING (company_number)""",
    "missing_reasons": f"SELECT {_REASON} AS reason, {_GOOD} AS annual, count(*)::BIGINT AS filings FROM ({FILINGS_SQL}) GROUP BY ALL",
    "status_report": f"""{_STATUS} SELECT k AS row_no, company_number, status AS turnover_status, CASE WHEN rule IN (6, 10, 11) THEN round_even(amount, 0) END AS turnover,
  CASE WHEN rule >= 10 THEN round_even(amount / 2, 0) END AS cash, currency, CASE WHEN rule = 6 THEN '2025-03-31' WHEN found AND rule >= 6 THEN filed_on::VARCHAR END AS period_end, nullif({_NOTE}, '') AS note FROM s""",
    "status_summary": _summary(),
}
