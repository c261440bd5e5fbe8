"""Whole-word keyword counts over pages of text, without a join: the list is a literal and every page is scanned once, where it is read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import bound, strip


def parse_keywords(text: str | None) -> list[str]:
    """Keywords one a line, or separated by commas or semicolons."""
    for separator in ",;":
        text = (text or "").replace(separator, "\n")
    return [k.strip() for k in (text or "").split("\n") if k.strip()]


def normal_text(text: Column) -> Column:
    """Lower case, words split over lines joined, everything else than a-z and 0-9 one blank."""
    joined = F.regexp_replace(F.lower(text), r"(?U)-\s*\n\s*", "")
    return F.trim(F.regexp_replace(joined, "[^a-z0-9]+", " "))


def distinct_keywords(keywords: DataFrame) -> DataFrame:
    """``kw_pos, keyword, norm`` of rows ``kw_pos, keyword``: of spellings that are the same after normalising, the first; blank ones drop out."""
    rows = keywords.select("kw_pos", strip("keyword").alias("keyword"), normal_text(F.col("keyword")).alias("norm")).filter("norm != ''")
    return rows.groupBy("norm").agg(F.min("kw_pos").alias("kw_pos"), F.min_by("keyword", "kw_pos").alias("keyword")).select("kw_pos", "keyword", "norm")


def _literal(keywords: list[str], spark) -> list[tuple[int, str, str]]:
    """The list after :func:`distinct_keywords`; it is what the user typed, so it is small."""
    rows = spark.createDataFrame(list(enumerate(keywords)), "kw_pos int, keyword string")
    return [(r["kw_pos"], r["keyword"], r["norm"]) for r in distinct_keywords(rows).orderBy("kw_pos").collect()]


def keyword_list(spark: SparkSession, text: str | None, path: str | None = None) -> DataFrame:
    """``kw_pos, keyword`` of a typed list and then of a text file, as :func:`parse_keywords` splits them."""
    typed = spark.createDataFrame(list(enumerate(parse_keywords(text))), "kw_pos long, keyword string")
    if path is None:
        return typed
    # of a file's lines, in order; the typed list comes first
    lines = spark.read.text(path).select((F.monotonically_increasing_id() + F.lit(1 << 20)).alias("line"), "value")
    return typed.unionByName(split_keywords(lines, "line", "value").select("kw_pos", "keyword"))


def split_keywords(rows: DataFrame, pos_col: str, text_col: str) -> DataFrame:
    """``kw_pos, keyword`` of the keywords in the texts of ``rows``, in the order of ``pos_col``: at most 2**20 a row."""
    parts = rows.select(F.col(pos_col).cast("long").alias("__p"), F.posexplode(F.split(F.coalesce(text_col, F.lit("")), "[\n,;]")).alias("__k", "__w"))
    return parts.select((F.col("__p") * F.lit(1 << 20) + F.col("__k")).alias("kw_pos"), strip(F.col("__w")).alias("keyword")).filter("keyword != ''")


def _occurrences(text: Column, needle: Column) -> Column:
    return F.floor((F.length(text) - F.length(F.replace(text, needle, F.lit("")))) / F.length(needle)).cast("long")


def _repeats_itself(words: list[str]) -> bool:
    """Whether a phrase can begin before an earlier one of it has ended, as "a b a" can."""
    return any(words[k:] == words[: len(words) - k] for k in range(1, len(words)))


def page_counts(pages: DataFrame, keywords: list[str], text_col: str = "text", ocr: Column | None = None) -> DataFrame:
    """Add ``hits``, an array of ``kw_pos, keyword, n`` of the keywords on each page in the order of the list; null where there is no text.

    The page's words are gone through once: where one begins a keyword, the next words decide. Phrases that can overlap themselves are counted by what their
    removal shortens, with blanks doubled, so that neighbours each have a blank of their own. On ``ocr`` pages, phrases and words of eight letters or more
    that aren't found so are looked for with blanks left out.
    """
    listed = [(p, k, n, n.split(" ")) for p, k, n in _literal(keywords, pages.sparkSession)]
    plain, knotted = [x for x in listed if not _repeats_itself(x[3])], [x for x in listed if _repeats_itself(x[3])]
    none = F.expr("cast(array() as array<struct<kw_pos:int,keyword:string,n:bigint>>)")
    if not listed:
        return pages.withColumn("hits", F.when(F.coalesce(F.col(text_col), F.lit("")) != "", none))
    blank = F.lit(" ")
    hit = lambda p, k, n: F.struct(p.alias("kw_pos"), k.alias("keyword"), n.cast("long").alias("n"))
    entry = lambda p, k, n, w: F.struct(F.lit(p).alias("kw_pos"), F.lit(k).alias("keyword"), F.lit(n).alias("norm"), F.lit(len(w)).alias("words"))
    begun: dict[str, list] = {}
    for x in plain:
        begun.setdefault(x[3][0], []).append(entry(*x))
    order = [(p, k) for p, k, _, _ in listed]
    name = F.create_map(*[F.lit(x) for pair in order for x in pair])

    def at_places(words: Column) -> Column:
        """The place in the list of every plain keyword that begins somewhere, once for each time."""
        places = F.filter(F.transform(words, lambda w, i: F.when(w.isin(*begun), i)), lambda i: i.isNotNull())
        begin = F.create_map(*[y for w, es in begun.items() for y in (F.lit(w), F.array(*es))])
        here = lambda i: F.filter(begin[F.get(words, i)], lambda e: F.array_join(F.slice(words, i + 1, e["words"]), " ") == e["norm"])
        return F.flatten(F.transform(places, lambda i: F.transform(here(i), lambda e: e["kw_pos"])))

    def by_keyword(found: Column) -> Column:
        return F.transform(F.array_distinct(found), lambda p: hit(p, name[p], F.size(F.filter(found, lambda q: q == p))))

    def more(t: Column, structs: list[Column], form) -> Column:
        return F.filter(F.transform(F.array(*structs), lambda k: hit(k["kw_pos"], k["keyword"], form(t, k["needle"]))), lambda h: h["n"] > 0)

    def needles(rows, make) -> list[Column]:
        return [F.struct(F.lit(p).alias("kw_pos"), F.lit(k).alias("keyword"), F.lit(make(n)).alias("needle")) for p, k, n, _ in rows]

    def hits(t: Column) -> Column:
        found = bound(bound(F.split(t, " "), at_places), by_keyword) if plain else none
        if knotted:
            spaced = F.concat(blank, F.replace(t, blank, F.lit("  ")), blank)
            found = F.concat(found, bound(spaced, lambda x: more(x, needles(knotted, lambda n: " " + n.replace(" ", "  ") + " "), _occurrences)))
        compact = [x for x in listed if " " in x[2] or len(x[2]) >= 8]
        if ocr is not None and compact:
            form = lambda x, needle: F.when(F.contains(x, needle), _occurrences(x, needle)).otherwise(F.lit(0).cast("long"))
            glued = bound(F.replace(t, blank, F.lit("")), lambda x: more(x, needles(compact, lambda n: n.replace(" ", "")), form))
            known = lambda f, g: F.concat(f, F.filter(g, lambda h: ~F.exists(f, lambda x: x["kw_pos"] == h["kw_pos"])))
            found = bound(found, lambda f: F.when(ocr, known(f, glued)).otherwise(f))
        return F.array_sort(found)

    return pages.withColumn("hits", F.when(F.coalesce(F.col(text_col), F.lit("")) != "", bound(normal_text(F.col(text_col)), hits)))


def document_counts(counted: DataFrame, doc_col: str = "doc_id") -> DataFrame:
    """``doc, kw_pos, keyword, n``: mentions over the pages of a document. Only keywords that occur are shuffled, summed beforehand."""
    # an outer explode, because Spark would put the count into a filter below another one and do it twice
    rows = counted.select(doc_col, F.explode_outer("hits").alias("h")).filter("h is not null").select(doc_col, "h.*")
    return rows.groupBy(doc_col, "kw_pos", "keyword").agg(F.sum("n").alias("n"))


def document_report(counted: DataFrame, doc_col: str = "doc_id", n_keywords: int | None = None) -> DataFrame:
    """A row a document: ``keywords_found`` in the given order, ``ranked`` (most mentioned first, ties as given), ``keyword_count``, ``keyword_cell``,
    ``all_found``. A document without any text has nulls (nothing was searched), one without a keyword has empty lists and ``none found``."""
    each = counted.select(doc_col, F.col("hits").isNotNull().alias("s"), F.explode_outer("hits").alias("h")).select(doc_col, "s", "h.*")
    summed = each.groupBy(doc_col, "kw_pos", "keyword").agg(F.sum("n").alias("n"), F.max("s").alias("s"))
    entry = F.when(F.col("kw_pos").isNotNull(), F.struct((-F.col("n")).alias("m"), "kw_pos", "keyword", "n"))
    rows = summed.groupBy(doc_col).agg(F.max("s").alias("searched"), F.array_sort(F.collect_list(entry)).alias("found"))
    found = F.when(F.col("searched"), F.col("found"))
    given = F.array_sort(F.transform(found, lambda x: F.struct(x["kw_pos"].alias("kw_pos"), x["keyword"].alias("keyword"))))
    ranked = F.transform(found, lambda x: F.struct(x["keyword"].alias("keyword"), x["n"].alias("n")))
    cell = F.when(F.size(found) == 0, "none found").otherwise(F.array_join(F.transform(found, lambda x: F.concat(x["keyword"], F.lit(" ("), x["n"].cast("string"), F.lit(")"))), ", "))
    n = F.when(F.col("searched"), F.size(found))
    return rows.select(
        doc_col,
        F.transform(given, lambda x: x["keyword"]).alias("keywords_found"),
        ranked.alias("ranked"),
        n.alias("keyword_count"),
        F.when(F.col("searched"), cell).alias("keyword_cell"),
        (n == (n_keywords if n_keywords is not None else -1)).alias("all_found"),
    )
