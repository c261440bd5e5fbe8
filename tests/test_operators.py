"""Matching, filings, electronic documents, pages, reports and the whole job on small tables."""

import random
import re

import pytest
from pyspark.sql import functions as F

from ledgermill.operators import company, facts, filings, match, pages, report
from ledgermill.operators import lines as L
from ledgermill.sources import documents, lists, sinks
from ledgermill.storage import forget_all, save, shared_folder


def document(facts_, contexts):
    ctx = "".join(f'<xbrli:context id="{c}"><xbrli:entity>{seg}</xbrli:entity><xbrli:period><xbrli:startDate>{s}</xbrli:startDate><xbrli:endDate>{e}</xbrli:endDate></xbrli:period></xbrli:context>' for c, s, e, seg in contexts)
    return f'<html><body><ix:header>{ctx}<xbrli:unit id="U"><xbrli:measure>iso4217:EUR</xbrli:measure></xbrli:unit></ix:header>{facts_}</body></html>'


def fact(name, ctx, text, more=""):
    return f'<ix:nonFraction name="core:{name}" contextRef="{ctx}" unitRef="U" {more}>{text}</ix:nonFraction>'


def dimension(member):
    return f'<xbrli:segment><xbrldi:explicitMember dimension="d:Any">d:{member}</xbrldi:explicitMember></xbrli:segment>'


def test_electronic_documents(spark):
    years = [("north", "2025-01-01", "2025-12-31", dimension("NorthRegion")), ("before", "2024-01-01", "2024-12-31", ""), ("now", "2025-01-01", "2025-12-31", ""), ("group", "2025-01-01", "2025-12-31", dimension("ConsolidatedEntity"))]
    tagged = document(fact("Revenue", "north", "31") + fact("Revenue", "before", "640") + fact("Revenue", "group", "7,000") + fact("Revenue", "now", "715") + fact("Debtors", "now", "–") + fact("Debtors", "lost", "9"), years)
    rows = "".join(f"<tr><td>{a}</td><td>{b}</td></tr>" for a, b in (("Statement of income", ""), ("Sales", "8,100 7,900"), ("Balance sheet", ""), ("Current assets", ""), ("Cash in hand", "2,600 1,400")))
    placed = '<div><div style="top: 20.02px; left: 60px">3,905 3,300</div><div style="top:20px;left:2px">Debtors</div></div>'
    hidden = "<html><ix:header>secret</ix:header><style>p{}</style><p>shown  text</p><br/>more</html>"
    docs = spark.createDataFrame([(1, tagged), (2, f"<table>{rows}</table>{placed}"), (3, ""), (4, None), (5, hidden), (6, "<![if odd"), (7, "<div/><p>a<b>")], "doc_id long, html string")
    parsed = facts.read_documents(docs)
    got = {r["doc_id"]: r for r in facts.document_figures(parsed).collect()}
    assert (got[1]["turnover"], got[1]["prior_turnover"], got[1]["period_end"], got[1]["months"], got[1]["debtors"], got[1]["currency"]) == (715, 640, "2025-12-31", 12, 0, "EUR")
    assert (got[2]["turnover"], got[2]["prior_turnover"], got[2]["cash"], got[2]["debtors"], got[2]["method"]) == (8100, 7900, 2600, 3905, "iXBRL table (untagged)")
    assert all(got[k]["turnover"] is None for k in (3, 4, 5, 6, 7)) and set(got) == set(range(1, 8))
    assert parsed.filter("doc_id = 5").first()["text"] == "shown  text more"


def test_statement_units_are_those_of_its_rows(spark):
    """Units above a heading don't count below it, and an unreadable current-assets part gives way to the next heading."""
    rows = ["£000", "Income statement", "Turnover 5,000 4,000", "Balance sheet", "Current assets", "Debtors", "Balance sheet (company)", "Debtors 700 650"]
    lines = spark.createDataFrame([(1, k, x) for k, x in enumerate(rows)], "doc_id int, line_no int, line string")
    from ledgermill import constants as K

    found = L.statement_figures(lines).first()
    assert found["turnover"]["current"] == 5000 and found["debtors"]["current"] == 700


def test_context_rank(spark):
    rows = [(False, [], 0), (True, ["x:ConsolidatedMember"], 1), (True, ["x:CurrentFinancialInstruments"], 2), (True, ["x:NonCurrentFinancialInstruments"], None), (True, ["y:CreditorsWithinOneYear", "z:ConsolidatedX"], 2), (True, [], None), (None, None, 0)]
    df = spark.createDataFrame(rows, "d boolean, m array<string>, want int")
    assert all(r["x"] == r["want"] for r in df.select(facts.context_rank(F.col("d"), F.col("m")).alias("x"), "want").collect())


def test_pages(spark):
    text = {0: "Quillfeather\nStatement of income\nNote 2025 2024\n£ £\nTurnover 4 61,300 60,010", 1: "Balance sheet\n£000 £000\nCurrent assets\nDebtors 880 790\nCash in hand 310 290", 2: "Notes to the accounts\nBalance sheet\nCash 77,777"}
    rows = [(1, p, 3, t, "PDF text") for p, t in text.items()] + [(2, 0, 1, None, "PDF text")]
    rows += [(3, p, 20, "Income statement\nSales 900" if p == 1 else "Balance sheet\nCash 550" if p == 17 else "x", "PDF text") for p in range(20)]
    df = spark.createDataFrame(rows, "doc_id int, page int, n_pages int, text string, method string")
    got = {r["doc_id"]: r for r in pages.page_figures(df).collect()}
    assert (got[1]["turnover"], got[1]["prior"], got[1]["cash"], got[1]["debtors"], got[1]["page"], got[1]["currency"]) == (61300, 60010, 310000, 880000, 1, "GBP")
    assert got[2]["turnover"] is None and got[2]["pages_checked"] == 1
    near = {r["doc_id"]: r for r in pages.page_figures(df, balance_reach=pages.REACH).collect()}
    assert got[3]["cash"] == 550 and near[3]["turnover"] == 900 and near[3]["cash"] is None  # 16 pages on
    assert pages.page_figures(df, max_pages=1).filter("doc_id = 1").first()["cash"] is None
    order = spark.range(200).select(pages.reading_order(F.col("id").cast("int"), F.lit(200)).alias("o"), "id").orderBy("o").collect()
    assert order[0]["id"] == 50 and [r["o"] for r in order] == list(range(200))


def test_boxes(spark):
    rows = [(1, 0, 40.0, 9.0, 8.0, "upper"), (1, 0, 42.0, 70.0, 8.0, "end"), (1, 0, 40.0, 3.0, 8.0, "far"), (1, 0, 60.0, 9.0, 30.0, "low")]
    got = L.box_rows(spark.createDataFrame(rows, "doc_id int, page int, y_mid double, x_left double, height double, text string")).orderBy("row_no").collect()
    assert [(r["line"], r["first"]) for r in got] == [("far upper end", "far"), ("low", "low")]


def rows_of_boxes(boxes):
    """The rows of one page, box by box."""
    heights = sorted(b[4] for b in boxes)
    limit, rows, last = heights[len(heights) // 2] * 0.6, [], None
    for place in sorted({b[2] for b in boxes}, key=lambda y: (y is not None, y or 0)):
        if not rows or (last is not None and place - last > limit):
            rows.append([])
        rows[-1] += [(b[3], b[5]) for b in boxes if b[2] == place]
        last = place
    return [" ".join(t for _, t in sorted(r)) for r in rows]


def test_boxes_of_pages_of_any_size(spark):
    rng = random.Random(3)
    boxes = []
    for page in range(8):
        step = rng.choice([0.5, 3, 6, 40, 900])
        for k in range(400 if page else 3000):
            y = None if page == 3 and k < 5 else round(rng.uniform(-200 * step, 200 * step), 1)
            boxes.append((1, page, y, float(k), 0.0 if page == 5 else float(rng.choice([8, 9, 10, 11])), f"t{k}"))
    got = L.box_rows(spark.createDataFrame(boxes, "doc_id int, page int, y_mid double, x_left double, height double, text string")).orderBy("page", "row_no").collect()
    assert [(r["page"], r["row_no"]) for r in got] == [(p, n) for p in range(8) for n in range(sum(r["page"] == p for r in got))]
    for page in range(8):
        assert [r["line"] for r in got if r["page"] == page] == rows_of_boxes([b for b in boxes if b[1] == page])


def test_latest_accounts(spark):
    rows = [("7", "2026-02-01", "CH01", "Change", 0), ("7", "2025-09-01", "AA", "\tInitial accounts", 1), ("7", "2025-03-01", "AAMD", "Amended accounts made up to 3 May 2024 View PDF", 2), ("7", "2025-03-01", "AA", "Later", 3), ("8", "2026-01-01", "CH01", None, 0)]
    df = spark.createDataFrame(rows, "company_number string, filed_on string, type string, description string, pos int").withColumn("filed_on", F.to_date("filed_on"))
    for newest in (500, None):
        (got,) = filings.latest_accounts(df, newest).collect()
        assert (got["company_number"], got["pos"], got["description"]) == ("7", 2, "Amended accounts made up to 3 May 2024")
    assert filings.latest_accounts(df, 2).count() == 0
    numbered = lists.newest_first(df.drop("pos")).filter("company_number = '7'").orderBy("pos").collect()
    assert [(r["pos"], r["type"]) for r in numbered] == [(0, "CH01"), (1, "AA"), (2, "AA"), (3, "AAMD")]


def test_controllers(spark):
    psc = spark.createDataFrame([("7", 2, "Dame  Ada Nwosu", "Active", ""), ("7", 1, "Parent Ltd", None, "Registration number 9"), ("7", 0, "Gone", "ceased", None), ("8", 0, "Left", "", "x Ceased on 2 June")], "company_number string, idx int, psc_name string, status_tag string, block_text string")
    rows = spark.createDataFrame([("7", "QUILL & CO LIMITED"), ("8", "B PLC"), ("9", "C")], "company_number string, company_name string")
    got = {r["company_number"]: r for r in filings.with_controllers(rows, psc).select("*", report.psc_cell(F.col("pscs")).alias("cell"), report.search_text(F.col("company_name"), F.col("pscs")).alias("t"), report.search_url(F.col("company_name"), F.col("pscs")).alias("u")).collect()}
    assert got["7"]["cell"] == "Parent Ltd; Dame Ada Nwosu" and got["7"]["t"] == "QUILL & CO + Dame Ada Nwosu + LinkedIn" and got["7"]["u"].endswith("q=QUILL+%26+CO+Ada+Nwosu+LinkedIn")
    assert got["8"]["cell"] == "none registered" == got["9"]["cell"]


def test_matching(spark):
    reg = spark.createDataFrame([("00000011", "QUILLFEATHER PLC"), ("00000012", "HARBOUR BOATS LIMITED"), ("00000013", "HARBOUR BOATZ LIMITED")], "company_number string, company_name string")
    rows = spark.createDataFrame([(1, "Quillfeather", "11"), (2, "Someone Else", "11"), (3, "x", "98"), (4, "The Quillfeather Ltd", None), (5, "Harbour Boats", ""), (6, "Vwxyz", None), (7, None, None), (8, "Boats Harbour", None)], "row_no int, name string, number string")
    keyed = match.with_keys(rows)
    by_number = {r["row_no"]: r for r in match.match_numbers(keyed, reg).collect()}
    assert by_number[1]["match_note"] is None and by_number[2]["match_note"] == "the number belongs to QUILLFEATHER PLC, check it matches 'Someone Else'" and by_number[3]["match_note"] == "company number 00000098 not on the register"
    by_name = {r["row_no"]: r for r in match.match_names(keyed, reg).collect()}
    assert by_name[4]["company_number"] == "00000011" and by_name[5]["ambiguous"] and by_name[5]["company_number"] == "00000012" and by_name[6]["company_number"] is None and by_name[8]["score"] == 100
    assert set(by_name) == {4, 5, 6, 8} and {r["row_no"] for r in match.unmatched(keyed, reg).collect()} == {3}


def test_candidates_lose_no_match(spark):
    """Every pair that reaches the threshold by brute force is a candidate: names with edits and swapped words, short ones, and common words only."""
    rng = random.Random(4)
    words = ["HOLDINGS", "GROUP", "NORTH", "SOUTH", "MILL", "MILLS", "AB", "QX", "ESTATES", "ESTATE", "ÉTOILE", "A", "12", "HOLDING"]
    names = sorted({" ".join(rng.sample(words, rng.randint(1, 4))) for _ in range(120)} | {"".join(rng.choices("ABC ", k=rng.randint(1, 9))).strip() or "Z" for _ in range(40)})
    typed = {" ".join(n.split()) for n in names[::3]}
    for n in names:
        letters = list(n)
        for _ in range(rng.randint(1, 3)):
            p = rng.randrange(len(letters) + 1)
            letters[p : p + rng.randint(0, 1)] = rng.choice([["X"], [], ["E"]])
        typed.add(" ".join("".join(letters).split()) or "Z")
    reg = spark.createDataFrame([(f"{k:08d}", n) for k, n in enumerate(names)], "company_number string, company_name string")
    found = {(r["searched"], r["registered"]) for r in match.candidates(spark.createDataFrame([(t,) for t in typed], "searched string"), reg).collect()}
    from ledgermill.functions.text import normalised_name

    normal = [r["n"] for r in reg.select(normalised_name(F.col("company_name")).alias("n")).collect()]
    want = {(t, n) for t in typed for n in normal if match.similarity(t, n) >= 90 and n}
    assert len(want) > 100 and want <= found


def test_pairs_of_names_grow_with_names(spark):
    """Names of random letters, typed with one too many, three too many or fifteen: four times as many of them give four times as many pairs, not sixteen."""
    counts = {}
    for size in (500, 2000):
        rng = random.Random(3)
        names = ["".join(rng.choices("BCDFGHJKLMNPQRST", k=12)) for _ in range(size)]
        reg = match.registered_names(spark.createDataFrame([(f"{k:08d}", n) for k, n in enumerate(names)], "company_number string, company_name string"))
        for least, more in ((90, 1), (85, 3), (0, 15)):
            typed = spark.createDataFrame([(k, n[:5] + "X" * more + n[5:]) for k, n in enumerate(names)], "sid long, searched string")
            own = match.with_masks(typed, "searched")
            pairs = match.pairs_by_parts(own, reg, least) if least else match.pairs_by_runs(own, reg)
            counts[size, least] = pairs.count()
            assert counts[size, least] >= size
    assert all(counts[2000, least] <= 5 * counts[500, least] for least in (90, 85, 0)) and counts[2000, 90] < 2100


def test_amounts_of_a_row_are_read_once(spark):
    """The first row of a label that has an amount; a filter of such rows doesn't read the amounts a second time."""
    rows = [(1, k, line) for k, line in enumerate(["£000", "Turnover", "Turnover -x", "Turnover 3 1,250 1,100", "Turnover 9 9,999"])] + [(2, 0, "Turnover"), (2, 1, "Turnover x")]
    found = L.figures(spark.createDataFrame(rows, "doc_id int, line_no int, line string"), L.K.TURNOVER_LABEL, ["doc_id"])
    assert [tuple(r) for r in found.collect()] == [(1, 1250000, 1100000, "000", 3)]
    steps = found._jdf.queryExecution().optimizedPlan().toString().splitlines()
    assert sum("lambdafunction" in s and "regexp_replace" in s for s in steps) == 1


def test_files_are_written_and_read_by_few_tasks(spark, tmp_path):
    """A file a row, with its bytes as they are and nothing beside it; hundreds of small files are read by a few tasks."""
    rows = [(f"{k % 7}/{k}.html", bytes([k % 256, 13, 10, 0])) for k in range(700)]
    sinks.write_files(spark.createDataFrame(rows, "name string, content binary"), f"file:{tmp_path}/out")
    assert {str(p.relative_to(tmp_path / "out")): p.read_bytes() for p in (tmp_path / "out").rglob("*") if p.is_file()} == dict(rows)
    files = documents.read_files(spark, f"{tmp_path}/out", "*.html")
    # of the files that are read and of those too large
    assert files.rdd.getNumPartitions() <= 2 * documents.PARTS * spark.sparkContext.defaultParallelism and files.count() == 700


def test_names_of_the_same_letters_do_not_hide_the_closest(spark, monkeypatch):
    """A name typed with fifteen letters too many, and names of its letters in another order that share a run with it: the one that shares a long run gives the score that others
    must reach, so names with eight of its letters aren't compared; in whatever blocks a run's names meet."""
    n = "BCDFGHJKLMNP"
    others = ["".join(random.Random(k).sample(n[:5] + n[8:], 5)) for k in range(200)]
    names = [n, *("HJK" + x + "QRST" for x in others)]
    for k in (0, 1, 2, 5, 6, 7, 8, 9):
        rest = (n[:k] + n[k + 3 :])[::-1]
        names += [n[k : k + 3] + rest[i:] + rest[:i] for i in range(5)]
    reg = match.registered_names(spark.createDataFrame([(f"{k:08d}", x) for k, x in enumerate(names)], "company_number string, company_name string"))
    own = match.with_masks(spark.createDataFrame([(1, n[:5] + "X" * 15 + n[5:])], "sid long, searched string"), "searched")
    pairs = lambda: sorted(r["registered"] for r in match.pairs_by_runs(own, reg).join(reg, "rid").select("registered").collect())
    found = pairs()
    assert n in found and all(sorted(x) == sorted(n) for x in found)
    monkeypatch.setattr(match, "BLOCK", 3)
    assert pairs() == found


def test_scoring_is_spread_over_tasks(spark):
    """A few names, whose bytes would all go to one task."""
    reg = match.registered_names(spark.createDataFrame([(f"{k:08d}", f"NAME {k}") for k in range(50)], "company_number string, company_name string").coalesce(1))
    own = match.with_masks(reg.select(F.col("rid").alias("sid"), F.col("registered").alias("searched")), "searched")
    scored = match.scored_pairs(own.join(reg, F.col("sid") == F.col("rid")).select("sid", "rid").coalesce(1), own, reg)
    assert scored.rdd.getNumPartitions() == 4 and scored.filter("score = 100").count() == 50


def test_closest_names(spark):
    """500 names against 500 registered ones, all pairs compared: the closest of those that share a run of three letters, with scores from 40 to 100."""
    rng = random.Random(9)
    words = ["NORTHGATE", "HARBOUR", "STREET", "GARAGE", "BAKERY", "BAKERIES", "MILLS", "OLD", "ÉTOILE", "QUAY", "TRADING", "AND", "SONS", "12"]
    name = lambda: " ".join(rng.choice(words) if rng.random() < 0.6 else "".join(rng.choices("ABCDEILNORST", k=rng.randint(1, 9))) for _ in range(rng.randint(1, 4)))
    registered = [name() for _ in range(480)] + [name() + " " + "LONG " * 30 for _ in range(20)]
    typed = []
    for n in registered:
        letters = list(n)
        for _ in range(rng.choice([0, 1, 2, 4, 8, 12])):
            p = rng.randrange(len(letters) + 1)
            letters[p : p + rng.randint(0, 2)] = rng.choices("ABCDEX ", k=rng.randint(0, 2))
        typed.append(" ".join("".join(letters).split()))
    reg = spark.createDataFrame([(f"{k:08d}", n) for k, n in enumerate(registered)], "company_number string, company_name string")
    rows = spark.createDataFrame([(k, t, "") for k, t in enumerate(typed)], "row_no int, name string, number_key string")
    got = {r["row_no"]: r for r in match.match_names(rows, reg).collect()}
    from ledgermill.functions.text import normalised_name

    norm = lambda df, c: [r["n"] for r in df.select(normalised_name(F.col(c)).alias("n")).collect()]
    runs = lambda t: {f[k : k + 3] for f in (t, " ".join(sorted(t.split()))) for k in range(len(f) - 2)}
    known, levels = norm(reg, "company_name"), set()
    known_runs = [runs(n) for n in known]
    for k, t in enumerate(norm(rows.orderBy("row_no"), "name")):
        mine = runs(t)
        scores = [(-match.similarity(t, n), i) for i, (n, r) in enumerate(zip(known, known_runs, strict=True)) if t and n and (mine & r or n == t)]
        if not scores:
            assert got[k]["score"] is None and got[k]["match_note"] == "company not found on the register"
            continue
        score, i = -min(scores)[0], min(scores)[1]
        assert got[k]["score"] == pytest.approx(score), (t, known[i])
        levels.add(int(score) // 10)
        if score >= 90:
            assert got[k]["company_number"] == f"{i:08d}" and got[k]["ambiguous"] == (sum(s <= -90 for s, _ in scores) > 1)
        else:
            assert got[k]["company_number"] is None and got[k]["match_note"] == f"no confident match (closest: {registered[i]}, {score:.0f}%), add the company number"
    assert levels >= {5, 6, 7, 8, 9, 10}


def test_names_that_are_close_but_not_enough(spark):
    reg = spark.createDataFrame([("1", "Northgate Bakery Limited"), ("2", "Harbour Street Garage Ltd")], "company_number string, company_name string")
    rows = match.with_keys(spark.createDataFrame([(1, "Northgate Bakeries UK", None), (2, "Harbour St Garage", None), (3, "Zz", None), (4, "Ltd", None)], "row_no int, name string, number string"))
    notes = {r["row_no"]: (r["company_number"], r["match_note"]) for r in match.match_names(rows, reg).collect()}
    assert notes[1] == (None, "no confident match (closest: Northgate Bakery Limited, 81%), add the company number")
    assert notes[2] == (None, "no confident match (closest: Harbour Street Garage Ltd, 89%), add the company number")
    assert notes[3] == notes[4] == (None, "company not found on the register")
    assert match.match_names(rows, reg.limit(0)).filter("match_note != 'company not found on the register'").count() == 0


def test_summary(spark, tmp_path):
    rows = spark.createDataFrame([("FOUND", 2), ("FOUND", 0), ("ERROR", None)], "turnover_status string, keyword_count int")
    got = {r["status"]: r["companies"] for r in report.status_summary(rows).collect()}
    assert got == {"FOUND": 2, "ERROR": 1, "VERIFY": 0, "NOT DISCLOSED": 0, "CHECK PDF": 0, "NOT FOUND": 0, "Total": 3}
    sinks.write_summary(rows, str(tmp_path / "s"), keywords=["VAT", "rent"])
    lines = [tuple(r) for r in spark.read.parquet(str(tmp_path / "s")).orderBy("pos").collect()]
    assert lines[-2:] == [(7, "Keywords", 1, "companies whose accounts mention at least one keyword"), (8, None, None, "Searched for 2: VAT, rent")] and len(lines) == 9


def test_decisions(spark):
    names = [re.split(r"\s+", c.strip())[0] for c in report.JOINED.split(",")]
    base = dict.fromkeys(names) | {"row_no": 1, "number_key": "1", "company_number": "1", "company_name": "A"}
    filed = base | {"accounts_type": "Full accounts made up to 30 June 2019", "pdf_url": "p", "has_pages": True, "pg_method": "PDF text", "pg_page": 6}
    cases = [
        (base | {"failed": True}, "ERROR", "source failed"), (base | {"company_number": None, "match_note": "company number 1 not on the register"}, "NOT FOUND", "not on the register"), (base | {"last_accounts": ""}, "NOT DISCLOSED", "new company"),
        (base, "NOT DISCLOSED", "no accounts filed"), (base | {"last_accounts": "4 May 2023"}, "CHECK PDF", "weren't found"), (filed | {"has_xhtml": True, "ix_turnover": 5.0, "ix_months": 17}, "FOUND", "cover 17 months"),
        (filed | {"has_xhtml": True, "accounts_type": "Micro accounts"}, "NOT DISCLOSED", "micro"), (filed | {"pdf_url": None}, "CHECK PDF", "no downloadable"), (filed | {"has_pages": False}, "CHECK PDF", "couldn't be downloaded"),
        (filed | {"pg_turnover": 7.0, "pg_method": "PDF scan (OCR)"}, "VERIFY", "read by OCR from page 6"), (filed | {"pg_turnover": 7.0, "pg_currency": "EUR"}, "FOUND", "figures are in EUR"), (filed | {"accounts_type": "Dormant accounts"}, "NOT DISCLOSED", "dormant"),
        (filed | {"has_xhtml": True}, "NOT DISCLOSED", "not shown"), (filed | {"pg_checked": 9}, "CHECK PDF", "found in 9 pages"), (filed | {"pg_problem": "it can't be opened"}, "CHECK PDF", "it can't be opened"),
        (filed | {"scanned_skipped": True}, "CHECK PDF", "scanned PDF not read"), (base | {"company_number": None, "number_key": "", "name": " "}, "NOT FOUND", "no company name or number"),
    ]
    df = spark.createDataFrame([tuple((c | {"row_no": k})[n] for n in names) for k, (c, _, _) in enumerate(cases)], report.JOINED)
    got = report.output_rows(report.decided(df, F.to_date(F.lit("2025-01-01")))).orderBy("row_no").collect()
    for r, (_, status, note) in zip(got, cases, strict=True):
        assert r["turnover_status"] == status and note in r["note"], r
    assert "over 2 years old (30 June 2019)" in got[10]["note"]


STATEMENT = "Income statement\nNote £000\nTurnover 3 410 390"
BALANCE = "Balance sheet\nCurrent assets\nCash in hand 4,100 3,900\nDebtors 8 6,200 5,100"


@pytest.fixture(scope="module")
def job(spark):
    """Companies 1 to 12, a row of the status table each, and tables that the whole job reads."""
    filed = {  # number: (description, electronic document, page document)
        4: ("Full accounts", "x4", "p4"), 5: ("Micro accounts", "x5", "p5"), 6: ("Full accounts", None, None), 7: ("Full accounts", "gone", "lost"), 8: ("Full accounts", None, "p8"), 9: ("Full accounts", None, "p9"),
        10: ("Dormant accounts", None, "p10"), 11: ("Full accounts", "x11", "p11"), 12: ("Full accounts", None, "p12"), 13: ("Full accounts", "x13", None), 14: ("Full accounts", None, "p14"),
    }
    last = {1: "", 2: None, 3: "1 May 2025"}
    n = lambda k: f"{k:08d}"
    register = spark.createDataFrame([(n(k), f"COMPANY {'ABCDEFGHIJKLMN'[k - 1] * 6} LIMITED", "Active" if k != 6 else "Liquidation", last.get(k, "1 May 2025"), k == 7) for k in range(1, 15)], "company_number string, company_name string, company_status string, last_accounts string, accounts_overdue boolean")
    psc = spark.createDataFrame([(n(4), 0, "Ada Nwosu", "Active", "")], "company_number string, idx int, psc_name string, status_tag string, block_text string")
    history = [(n(k), "2025-06-01", "AA", f"{d} made up to 31 December 2024 View PDF", x, p, 1) for k, (d, x, p) in filed.items()] + [(n(3), "2026-01-01", "CH01", "Change", None, None, 0), (n(4), "2020-06-01", "AA", "Full accounts", "x5", None, 2)]
    filings_ = spark.createDataFrame(history, "company_number string, filed_on string, type string, description string, xhtml_url string, pdf_url string, pos int").withColumn("filed_on", F.to_date("filed_on"))
    now = [("c", "2023-07-01", "2024-12-31", "")]
    html = [(4, "x4", document(fact("TurnoverRevenue", "c", "77"), now) + "<p>VAT and rent</p>"), (5, "x5", "<p>VAT</p>" + fact("Debtors", "c", "5")), (11, "x11", "<p>none of them</p>"), (13, "x13", "<p>rent</p>")]
    documents = spark.createDataFrame(html, "doc_id long, url string, html string")
    text = {8: (STATEMENT, "PDF text"), 9: (STATEMENT, "PDF scan (OCR)"), 10: ("x", "PDF text"), 11: ("y", "PDF text"), 12: (BALANCE + " VAT rent", "PDF scan (OCR)"), 4: ("VAT VAT", "PDF text"), 14: (None, None)}
    page_rows = [(k, f"p{k}", p, 2, t if p == 0 else BALANCE, m, "it can't be opened" if k == 14 else None) for k, (t, m) in text.items() for p in (0, 1)]
    pages_ = spark.createDataFrame(page_rows, "doc_id long, url string, page int, n_pages int, text string, method string, problem string")
    listed = [(k, None, str(k)) for k in range(1, 15)] + [(20, "company dddddd ltd", None), (21, "Company DDDDDD", "4"), (22, " ", ""), (23, None, "99"), (24, "4", "4")]
    companies = spark.createDataFrame(listed, "row_no long, name string, number string")

    def run(**options):
        return {r["row_no"]: r for r in company.company_results(companies, register, psc, filings_, documents, pages_, as_of=F.to_date(F.lit("2025-10-01")), **options).collect()}

    return run


def test_whole_job(job):
    got = job()
    status = {k: r["turnover_status"] for k, r in got.items()}
    want = {1: "NOT DISCLOSED", 2: "NOT DISCLOSED", 3: "CHECK PDF", 4: "FOUND", 5: "NOT DISCLOSED", 6: "CHECK PDF", 7: "CHECK PDF", 8: "FOUND", 9: "VERIFY", 10: "NOT DISCLOSED", 11: "NOT DISCLOSED", 12: "CHECK PDF", 13: "CHECK PDF", 14: "CHECK PDF", 20: "FOUND", 21: "FOUND", 22: "NOT FOUND", 23: "NOT FOUND", 24: "FOUND"}
    assert status == want
    notes = {1: "no accounts filed yet", 2: "no accounts filed", 3: "made up to 1 May 2025 exist", 4: "these accounts cover 18 months", 5: "micro-entity", 6: "no downloadable document; company status: Liquidation", 7: "couldn't be downloaded; accounts overdue", 9: "read by OCR from page 1", 10: "dormant", 11: "turnover not shown"}
    notes |= {12: "no turnover line found in 2 pages", 13: "no downloadable", 14: "it can't be opened", 22: "no company name or number", 23: "company number 00000099 not on the register", 24: "check it matches '4'"}
    assert all(x in got[k]["note"] for k, x in notes.items())
    assert (got[4]["turnover"], got[4]["currency"], got[4]["period_end"], got[4]["psc"]) == (77, "EUR", "2024-12-31", "Ada Nwosu") and "figures are in EUR" in got[4]["note"]
    assert (got[8]["turnover"], got[8]["prior_turnover"], got[8]["cash"], got[8]["debtors"], got[8]["period_end"]) == (410000, 390000, 4100, 6200, "2024-12-31")
    assert got[11]["cash"] == 4100 and got[5]["cash"] is None  # pages are read for the first alone
    assert got[20]["company_number"] == "00000004" and got[22]["company_number"] is None and got[23]["psc"] is None and all(r["keywords"] is None for r in got.values())


def test_whole_job_with_keywords(job):
    got = job(keywords=["VAT", "rent"])
    assert {k: got[k]["keywords"] for k in (1, 4, 5, 6, 8, 11, 12, 13, 14)} == {1: None, 4: "VAT (1), rent (1)", 5: "VAT (1)", 6: None, 8: "none found", 11: "none found", 12: "VAT (1), rent (1)", 13: "rent (1)", 14: None}
    assert got[4]["keyword_count"] == 2 and got[12]["note"].endswith("cash and debtors read by OCR, check them against the PDF")
    few = job(keywords=["VAT"], max_pages=1)
    assert "keywords searched in 1 of 2 pages (page limit)" in few[8]["note"] and few[8]["cash"] is None and "page limit" not in (few[4]["note"] or "")
    skipped = job(keywords=["VAT"], ocr_keywords=False)
    assert "keyword search of scanned PDFs is turned off" in skipped[9]["note"] and skipped[9]["turnover"] == 410000 and skipped[12]["keywords"] == "none found"
    unread = job(keywords=["VAT"], read_scanned=False)
    assert unread[9]["turnover_status"] == "CHECK PDF" and "scanned PDF not read" in unread[9]["note"] and "scanned-PDF reading is turned off" in unread[12]["note"]


def test_write_results(spark, job, tmp_path):
    rows = spark.createDataFrame(list(job().values()), "row_no long, company_name string, company_number string, turnover_status string, turnover double, prior_turnover double, cash double, debtors double, currency string, period_end string, accounts_type string, psc string, search_text string, search_url string, keyword_count int, keywords string, note string, accounts_pdf string")
    sinks.write_results(rows, str(tmp_path / "c"), "csv")
    back = spark.read.option("header", True).csv(str(tmp_path / "c")).collect()
    assert [int(r["row_no"]) for r in back] == sorted(int(r["row_no"]) for r in back) and back[0]["note"].startswith("no accounts filed yet")
    sinks.write_results(rows, str(tmp_path / "p"), by_status=True)
    assert spark.read.parquet(str(tmp_path / "p")).filter("turnover_status = 'FOUND'").count() == 5


def test_read_list(spark, tmp_path):
    a, b, c, d, e = (tmp_path / f"{x}.csv" for x in "abcde")
    a.write_bytes("Title of it;\n;\nCompany Name;Company Reg No\nBrûlée Bakers;07000001\n;\nQuill;7123456\n".encode("cp1252"))
    b.write_bytes("﻿name,number\nQuill,1\n\"two, \"\"x\"\"\nlines\",2\n".encode())
    c.write_bytes(b"name|number\n" + b"".join(b"Row %d|%d\n" % (k, k) for k in range(900)) + "Euro € Café|5\n".encode("cp1252"))  # the only such bytes are far down
    d.write_bytes(b"")
    e.write_bytes(b"first,second\n1,2\n")
    rows = lambda p: [(r["name"], r["number"]) for r in lists.read_list(spark, str(p)).orderBy("row_no").collect()]
    assert rows(a) == [("Brûlée Bakers", "07000001"), ("Quill", "7123456")]
    assert rows(b) == [("Quill", "1"), ('two, "x"\nlines', "2")]
    assert rows(c)[-1] == ("Euro € Café", "5") and len(rows(c)) == 901
    assert rows(d) == [] and rows(e) == []  # nothing to pick
    assert [(r["name"], r["number"]) for r in lists.read_list(spark, str(e), name="SECOND ", number="first").collect()] == [("2", "1")]
    with pytest.raises(ValueError, match="no column"):
        lists.read_list(spark, str(e), name="third")
    assert lists.guess(["Id", "Trading name", "CRN"], lists.NUMBER_WORDS) == "CRN"


def test_split_pages(spark):
    got = lists.split_pages(spark.createDataFrame([(1, "a\fb\f"), (2, None)], "doc_id int, text string")).orderBy("doc_id", "page").collect()
    assert [tuple(r) for r in got] == [(1, 3, 0, "a"), (1, 3, 1, "b"), (1, 3, 2, ""), (2, 1, 0, "")]


def test_stored_tables(spark):
    forget_all(spark)
    a = save(spark.range(5).toDF("x"), "t")
    assert a.count() == 5 and a.inputFiles()[0].split(":", 1)[1].lstrip("/").startswith(shared_folder(spark).lstrip("/"))
    assert forget_all(spark) == 1 and forget_all(spark) == 0


def test_files_are_read_by_the_encoding_they_declare(spark, tmp_path):
    """Marks before declarations, declarations before meta elements, meta elements before UTF-8; a file that can't be read costs its own row."""
    text = "<html><p>Café £5 € “x”</p></html>"
    files = {
        "a": text.encode(), "b": b"\xef\xbb\xbf" + b'<?xml version="1.0" encoding="iso-8859-1"?>' + text.encode(), "c": text.encode("utf-16"), "d": b"<?xml version='1.0' encoding='windows-1252'?>" + text.encode("cp1252"),
        "e": b'<meta http-equiv="x" content="text/html; charset=ISO-8859-1">' + text.encode("cp1252"), "f": b'<META CHARSET=koi8-r>' + "Ёж".encode("koi8-r"), "g": b'<?xml version="1.0" encoding="utf-16"?>' + text.encode(), "h": b"",
        "i": b"<p>caf\xe9</p>", "j": b'<meta charset="klingon">x', "k": b"<?xml version='1.0' encoding='latin-1'?>\x81\x93",
    }
    (tmp_path / "deep").mkdir()
    for name, raw in files.items():
        (tmp_path / ("deep" if name > "f" else "") / f"{name}.html").write_bytes(raw)
    (tmp_path / "other.txt").write_bytes(b"\xff")
    got = {r["url"].rsplit("/", 1)[1][0]: (r["html"], r["error"]) for r in documents.read_files(spark, str(tmp_path), "*.html").collect()}
    assert set(got) == set(files) - {"h"} and all(got[n][0].endswith(text) and got[n][1] is None for n in "abcdeg")
    assert got["f"][0].endswith("Ёж") and got["k"][0].endswith("\x81“")
    assert got["i"] == (None, "not text in utf-8") and got["j"] == (None, "unknown encoding klingon")
    assert {r["error"] for r in documents.read_files(spark, str(tmp_path), "*.html", largest=60).filter("html is null").collect()} >= {"file too large"}
    read = facts.read_documents(documents.read_files(spark, str(tmp_path), "[ai].html").select(F.lit(1).alias("doc_id"), "html", "error")).collect()
    assert {(r["text"], r["error"]) for r in read} == {("Café £5 € “x”", None), (None, "not text in utf-8")}


def test_references_without_an_end():
    """Only a whole reference is one: in text, in attributes and at the end of an element."""
    html = '<p>ver&amp</p><p>R&D &ampersand; &notit; A&amp;B &#163;5 &#xa3;6 &copy 7 &nosuch; &</p><table><tr><td>x&lt</td></tr></table><ix:nonFraction name="a&copy">1</ix:nonFraction>'
    read = facts.parse(html)
    assert read["text"] == "ver&amp R&D &ampersand; &notit; A&B £5 £6 &copy 7 &nosuch; & x&lt 1"
    assert read["rows"] == ["x&lt"] and read["facts"][0]["tag"] == "a&copy"
