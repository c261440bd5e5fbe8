"""Column functions and row reading against values worked out by hand."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ledgermill import constants as K
from ledgermill.functions import dates
from ledgermill.functions import text as T
from ledgermill.functions.amounts import amounts, fact_value
from ledgermill.operators import keywords as kw, phrases
from ledgermill.operators import lines as L
from ledgermill.operators import match


def column(spark, values, use, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r["x"] for r in df.select("i", use(F.col("v")).alias("x")).orderBy("i").collect()]


def figures_of(spark, cases, label, balance=False):
    """The figure of each list of lines, null where there is none."""
    df = spark.createDataFrame([(d, k, x) for d, lines in enumerate(cases) for k, x in enumerate(lines)], "doc_id int, line_no int, line string")
    found = {r["doc_id"]: r for r in L.figures(df, label, ["doc_id"], balance).collect()}
    return [found.get(d) for d in range(len(cases))]


def test_clean_number(spark):
    raw = ["07123456", "7123456", " 71 23-456", "fc4711", "NI 000012", "GE1234567", None, "", "x/y", "1234567890"]
    assert column(spark, raw, T.clean_number) == ["07123456", "07123456", "07123456", "FC004711", "NI000012", "GE1234567", "", "", "XY", "1234567890"]
    assert column(spark, [7123456.0, 12.5, None], lambda c: T.clean_number(c, numeric=True), "double") == ["07123456", "00000125", ""]


def test_normalised_name(spark):
    raw = ["Brick & Mortar plc", "BRICK AND MORTAR P. L. C.", "the Quillfeather Limited", "Quillfeather Company L.T.D.", "Œuvre–Étoile ltd", "Public Limited Company", "Theodore Bros", None]
    assert column(spark, raw, T.normalised_name) == ["BRICK AND MORTAR"] * 2 + ["QUILLFEATHER"] * 2 + ["ŒUVRE ÉTOILE", "", "THEODORE BROS", ""]


def test_similarity_bounds():
    assert match.similarity("NORTH MILL", "MILL NORTH") == 100
    assert match.similarity("QUAYSIDE BOATS", "HILLSIDE GOATS") < 90
    assert match.ratio("", "") == 100 and match.ratio("A", "") == 0
    assert match.similarity("ABCDEFGHIJKL", "ABCXDEFGHIJKL") == pytest.approx(96)


def quadratic(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


@given(st.text("ABC ", max_size=20), st.text("ABC ", max_size=20))
@settings(max_examples=200, deadline=None)
def test_common_length(a, b):
    assert match.common_length(a, b) == quadratic(a, b)


def test_similarities_of_many_pairs():
    """In batches as one by one: lengths around the words of 64 bits, carries, blanks, letters beyond 16 bits, empty names."""
    rng = random.Random(7)
    letters = "ABCDEFGH ÉX 12𝄞"
    a = ["".join(rng.choices(letters, k=rng.choice([0, 1, 3, 20, 20, 20, 63, 64, 65, 130, 200]))) for _ in range(10_000)]
    b = ["".join(x for x in t if rng.random() > 0.1) + "".join(rng.choices(letters, k=rng.randint(0, 9))) if rng.random() < 0.7 else "".join(rng.choices(letters, k=rng.choice([0, 1, 5, 70]))) for t in a]
    assert match.similarities(a, b).tolist() == [match.similarity(x, y) for x, y in zip(a, b, strict=True)]
    assert match.similarities(["A" * 300], ["A" * 299]).tolist() == [200.0 * 299 / 599] and match.similarities([], []).tolist() == []


TURNOVER = [
    ("Turnover 5 412,007 398,511", 412007, 398511), ("Revenue 1,4 88,120 88,120 79,903 79,903", 88120, None), ("Revenue 3.2 4,118.6", 4119, None), ("Group turnover 61.205 58,330", 61205, 58330),
    ("Revenue 48.6 44.1", 49, 44), ("Turnover £000 9,310", 9310000, None), ("Sales (note 7) 15,250", 15250, None), ("Revenue (7) 2,345 2,100", 2345, 2100), ("Net sales (6,400)", -6400, None), ("Turnover 2 nil 812", 0, None),
    ("TOTAL REVENUE 1.302.6 Other incorne 18.2", 1303, None), ("Sales 70,000 6,999", 70000, None), ("Sales 70,000 7,000", 70000, 7000), ("Turnover – 512", 0, None), ("Revenue 5,120 note", 5120, None),
    ("Revenue from hire of plant 33,190 30,008", None, None), ("Turnover includes the fair value of goods", None, None), ("Revenue", None, None), ("Cost of sales 4,400 4,100", None, None), ("Turnover 6.3", None, None), ("Salesperson 5,000", None, None),
]


def test_turnover_rows(spark):
    found = figures_of(spark, [[line] for line, _, _ in TURNOVER], K.TURNOVER_LABEL)
    for (line, current, prior), got in zip(TURNOVER, found, strict=True):
        assert (got and (got["current"], got["prior"])) == (None if current is None else (current, prior)), line


def test_balance_rows(spark):
    cash = [("Cash at bank and in hand 8 61,204 57,330", 61204), ("Cashatbankandinhand 9,100 8,700", 9100), ("Cash and short-term deposits 12 140.2 133.9", 140), ("Cash flows from operations 5,500", None), ("Cash in hand 4 nil 400", 0)]
    debtors = [("Debtors 11 733,015 690,002", 733015), ("Trade and other receivables 5,311 4,870", 5311), ("Debtors: amounts falling due within one year 9 2,406,118 2,199,340", 2406118), ("Total debtors - 8,120", 0), ("Receivables ledger 77,000", None)]
    for label, rows in ((K.CASH_LABEL, cash), (K.DEBTORS_LABEL, debtors)):
        assert [g and g["current"] for g in figures_of(spark, [[x] for x, _ in rows], label)] == [y for _, y in rows]


def test_units_from_rows_above(spark):
    filler = [f"Fixed asset {i} 12 11" for i in range(11)]
    cases = [
        ["Notes £m £m", "Turnover £000 8,210"], ["a town of 3 m people"] + [""] * 8 + ["Note £ £", "Turnover 6 301,400 288,100"], ["31 December 2025 | £m"] + filler + ["Turnover 64 59"],
        ["A town of 3 m people"] + filler + ["Turnover 6,400 5,900"], ["£000"] + [f"row {i}" for i in range(40)] + ["Turnover 640 590"], ["£000"] + [f"row {i}" for i in range(39)] + ["Turnover 640 590"],
    ]
    assert [(g["current"], g["unit"]) for g in figures_of(spark, cases, K.TURNOVER_LABEL)] == [(8_210_000, "000"), (301_400, ""), (64_000_000, "m"), (6_400, ""), (640, ""), (640_000, "000")]


def test_first_row_with_an_amount_wins(spark):
    (got,) = figures_of(spark, [["Revenue", "Revenue from hire of plant 1,000", "Revenue 7 21,000 20,000", "Revenue 9,999"]], K.TURNOVER_LABEL)
    assert (got["current"], got["line_no"]) == (21000, 2)


def test_current_assets_come_first(spark):
    rows = ["Balance sheet", "£m £m", "Fixed assets", "Debtors 210 205", "Current assets", "Stocks 1,100 1,050", "Debtors 3,310 3,290"]
    unreadable = ["Balance sheet", "Debtors 9 301.0 377.1", "Current assets Share capital 12.1 12.1", "Stocks Debtors"]
    got = figures_of(spark, [rows, unreadable, rows[:4]], K.DEBTORS_LABEL, balance=True)
    assert got[0]["current"] == 3_310_000_000 and got[1] is None and got[2]["current"] == 210_000_000


def test_units_currency_and_headings(spark):
    heads = ["£m", "Restated 2025 Em", "in million", "€m | €m", "Note £000 £000", "£'000s", "$k", "Note £ £", "1999 2000", "team item 5m", None]
    assert column(spark, heads, T.unit_multiplier) == [10**6] * 4 + [10**3] * 3 + [1] * 4
    assert column(spark, ["Note 2025 £m", "31 Dec2024 | €000", "weeks ended", "Group accounts", " | ", ""], T.is_heading_line) == [True, True, True, False, False, False]
    assert column(spark, ["in £", "Fm and f'000 Em ", "thousand euro", "US$ and £", "dollars", "2025"], T.page_currency) == ["GBP", "GBP", "EUR", "USD", "USD", ""]
    pages = [["Quillfeather", "Consolidated statement of comprehensive income"], ["PROFIT&LOSSACCOUNT"], ["Notes to the accounts", "Income statement"], ["Statement of financial position"], ["", " "] + ["x"] * 8 + ["Balance sheet"]]
    assert column(spark, pages, L.is_statement_page, "array<string>") == [True, True, False, False, False]
    assert column(spark, pages, L.is_balance_page, "array<string>") == [False, False, False, True, False]


def test_why_missing(spark):
    raw = ["Dormant company accounts", "Micro-entity full accounts", "Filleted accounts", "Unaudited abridged accounts", "Medium company accounts", "Group of companies accounts", None]
    assert [x[:5] for x in column(spark, raw, T.why_missing)] == ["dorma", "micro", "small", "small", "mediu", "", ""]


def test_fact_values(spark):
    rows = [("7.300,25", "ixt:num-comma-decimal", "2", None, 730025.0), ("81", None, None, "-", -81.0), ("–", None, None, None, 0.0), ("5", "ixt:fixed-zero", None, None, 0.0), ("6,050 ", "", "x", "", 6050.0), ("none", None, None, None, None)]
    df = spark.createDataFrame(rows, "t string, f string, s string, g string, want double")
    for r in df.select(fact_value(F.col("t"), F.col("f"), F.col("s"), F.col("g")).alias("x"), "want").collect():
        assert r["x"] == r["want"]


def test_dates(spark):
    assert column(spark, ["accounts made up to 5 June 2024 and more", "made up to 5 Juno 2024", None], lambda c: dates.made_up_to(c).cast("string")) == ["2024-06-05", None, None]
    df = spark.createDataFrame([("2022-02-01", "2023-06-30", 17), ("2023-07-01", "2024-06-30", 12), ("2024", "not", None)], "a string, b string, want int")
    assert all(r["x"] == r["want"] for r in df.select(dates.months_between(F.col("a"), F.col("b")).alias("x"), "want").collect())


def test_profile_text(spark):
    text = ["Company  status Active Last accounts \n made up to 30 September 2024", "First accounts made up to 1 May 2027 due", "Charges", "x ACCOUNTS  OVERDUE", None]
    assert column(spark, text, T.last_accounts) == ["30 September 2024", "", None, None, None]
    assert column(spark, text, T.is_overdue) == [False, False, False, True, False]


def test_money(spark):
    df = spark.createDataFrame([(1234.5, "GBP", "£1,234"), (-9.0, "EUR", "€-9"), (5e6, "CHF", "5,000,000 CHF"), (None, "GBP", ""), (7.0, None, "£7")], "v double, c string, want string")
    assert all(r["x"] == r["want"] for r in df.select(T.money(F.col("v"), F.col("c")).alias("x"), "want").collect())


def test_money_of_nearly_nothing(spark):
    assert column(spark, [-0.3, -0.5, -0.0, 0.5, -0.51], lambda c: T.money(c, F.lit("GBP")), "double") == ["£0", "£0", "£0", "£0", "£-1"]


def found_keywords(spark, words, text, ocr=False):
    pages = spark.createDataFrame([(1, text)], "doc_id int, text string")
    return {r["keyword"]: r["n"] for r in kw.document_counts(kw.page_counts(pages, words, ocr=F.lit(ocr))).collect()}


def test_keywords(spark):
    assert found_keywords(spark, ["interest rate"], "one interest-\nrate swap, two INTEREST RATES, a Interest—Rate cap") == {"interest rate": 1}
    assert found_keywords(spark, ["bank loans"], "bank lo-\nans; bank\nloans") == {"bank loans": 2}
    glued = "Thecompanyhasnobankloansorleaseliabilitiesatyearend"
    assert found_keywords(spark, ["bank loans", "lease liabilities", "leasing", "year"], glued, True) == {"bank loans": 1, "lease liabilities": 1}
    assert found_keywords(spark, ["bank loans"], glued) == {}
    assert found_keywords(spark, ["tax", "rent"], "taxes, taxi, current, rents") == {}
    assert found_keywords(spark, ["leases", "VAT", "vat", " "], "leases VAT Vat vat") == {"leases": 1, "VAT": 3}
    assert found_keywords(spark, ["a b a", "a a", "a"], "a b a b a, a a a") == {"a b a": 1, "a a": 2, "a": 6}
    assert found_keywords(spark, ["x y"], "") == {} == found_keywords(spark, [], "x y")
    assert len(kw.parse_keywords(K.DEFAULT_KEYWORDS)) == 162


@given(st.lists(st.sampled_from(["a", "b", "a b", "b a", "a b a", "a a"]), min_size=1, max_size=6), st.text("ab ,", max_size=30))
@settings(max_examples=25, deadline=None)
def test_keywords_count_as_a_regular_expression_counts(spark, words, text):
    import re

    normal = re.sub("[^a-z0-9]+", " ", text).strip()
    want = {w: n for w in dict.fromkeys(words) if (n := len(re.findall(rf"(?<![a-z0-9]){w}(?![a-z0-9])", normal)))}
    assert found_keywords(spark, words, text) == want


def listed_keywords(spark, words, text, ocr=False):
    pages = spark.createDataFrame([(1, text)], "doc_id int, text string")
    keywords = spark.createDataFrame(list(enumerate(words)), "kw_pos int, keyword string")
    return {r["keyword"]: r["n"] for r in phrases.list_counts(pages, keywords, ["doc_id"], ocr=F.lit(ocr)).collect()}


@pytest.mark.parametrize("words, text, ocr", [
    (["interest rate", "interest"], "one interest-\nrate swap, two INTEREST RATES, a Interest—Rate cap", False),
    (["bank loans", "lease liabilities", "leasing", "year"], "Thecompanyhasnobankloansorleaseliabilitiesatyearend", True),
    (["bank loans", "a b", "aba aba"], "bankloans bank loans ab ab abaabaabaabaaba", True),
    (["leases", "VAT", "vat", " ", "--"], "leases VAT Vat vat", False),
    (["a b a", "a a", "a", "b a b a b"], "a b a b a, a a a " * 200, False),
    (["x y"], "", False), (["x y"], None, True), (["x y"], "?!", True), ([], "x y", False),
])
def test_a_list_as_a_table_counts_the_same(spark, words, text, ocr):
    assert listed_keywords(spark, words, text, ocr) == found_keywords(spark, words, text, ocr)


def test_a_long_list_counts_the_same_on_many_pages(spark):
    rng = random.Random(5)
    vocabulary = ["ab", "ba", "a", "b", "lease", "leases", "liability", "tax"]
    phrase = lambda most: " ".join(rng.choices(vocabulary, k=rng.randint(1, most)))
    words = [phrase(5) for _ in range(120)]
    rows = [(k % 7, k, phrase(900) if k % 3 else phrase(300).replace(" ", ""), k % 2 == 0) for k in range(24)]
    pages = spark.createDataFrame(rows, "doc_id int, page int, text string, scan boolean")
    want = kw.page_counts(pages, words, ocr=F.col("scan")).select("doc_id", "page", F.explode("hits").alias("h")).select("doc_id", "page", "h.*").collect()
    keywords = spark.createDataFrame(list(enumerate(words)), "kw_pos int, keyword string")
    got = phrases.list_counts(pages, keywords, ["doc_id", "page"], ocr=F.col("scan"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want)) and len(want) > 500


def test_the_plan_does_not_grow_with_the_list(spark):
    pages = spark.createDataFrame([(1, "a b")], "doc_id int, text string")
    sizes = []
    for n in (10, 10000):
        keywords = spark.range(n).select(F.col("id").alias("kw_pos"), F.concat(F.lit("word "), F.col("id").cast("string")).alias("keyword"))
        sizes.append(len(phrases.list_counts(pages, keywords, ["doc_id"])._jdf.queryExecution().optimizedPlan().toString()))
    assert abs(sizes[0] - sizes[1]) < 100


def test_keyword_report(spark):
    pages = spark.createDataFrame([(1, "VAT rent. Lease term. VAT"), (1, "rent VAT"), (2, "timber"), (3, None), (4, None), (4, "rent")], "doc_id int, text string")
    counted = kw.page_counts(pages, ["rent", "lease term", "VAT"])
    got = {r["doc_id"]: r for r in kw.document_report(counted, n_keywords=3).collect()}
    assert got[1]["keyword_cell"] == "VAT (3), rent (2), lease term (1)" and got[1]["keywords_found"] == ["rent", "lease term", "VAT"] and got[1]["all_found"]
    assert got[2]["keyword_cell"] == "none found" and got[2]["keyword_count"] == 0 and got[2]["all_found"] is False
    assert got[3]["keyword_cell"] is None and got[3]["keyword_count"] is None
    assert got[4]["keyword_cell"] == "rent (1)"


def test_keywords_are_searched_once(spark):
    """The search of a page stands once in the plans of the counts and of the report, and each reads its table once."""
    pages = spark.range(5).select(F.col("id").alias("doc_id"), F.col("id").cast("string").alias("text"))
    counted = kw.page_counts(pages, ["one two", "three"])
    for made in (kw.document_counts(counted), kw.document_report(counted)):
        plan = made._jdf.queryExecution().executedPlan().toString()
        assert plan.count("[^a-z0-9]+") == 1 and plan.count("Range (0, 5") == 1


def test_keyword_list_and_file(spark, tmp_path):
    path = tmp_path / "k.txt"
    path.write_text("lease term\nVAT; rent\n")
    rows = kw.distinct_keywords(kw.keyword_list(spark, "Rent, bank", str(path))).orderBy("kw_pos").collect()
    assert [r["keyword"] for r in rows] == ["Rent", "bank", "lease term", "VAT"]
    assert kw.keyword_list(spark, None).count() == 0


def test_amounts_of_empty_and_long_rows(spark):
    assert column(spark, ["", "no 12", "(2024: 5,000)"], lambda c: amounts(c, F.lit(False))) == [[], [], [5000.0]]
    assert column(spark, ["7 " + "1,000 " * 1500], lambda c: F.size(amounts(c, F.lit(True)))) == [1500]


def test_long_list_keeps_only_what_is_met(spark):
    """Of a page of over a million letters only places at which a keyword may begin leave their task; keywords lie over the limits of what is looked at together."""
    text = "zz " * 349_520 + "blue harbour light " * 3 + "zz " * 30_000 + "harbourlight blue  harbour"
    pages = spark.createDataFrame([(1, text), (2, "blue"), (3, "harbour")], "doc_id int, text string")
    listed = spark.createDataFrame([(1, "Blue Harbour"), (2, "harbour light"), (3, "blue harbour light blue"), (4, "none of it"), (5, "light blue")], "kw_pos long, keyword string")
    got = {(r["doc_id"], r["kw_pos"]): r["n"] for r in phrases.list_counts(pages, listed, ["doc_id"]).collect()}
    assert got == {(1, 1): 4, (1, 2): 3, (1, 3): 1, (1, 5): 2}
    words = listed.selectExpr("lower(keyword) as __phrase")
    sizes = [12, 13, 23, 10]
    met = phrases._met(pages.withColumnRenamed("text", "__text"), ["doc_id"], True, phrases._listed_bits(words, 1 << 16), sizes)
    assert met.count() < 30
