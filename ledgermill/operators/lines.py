"""Rows of text: rebuilt from positioned blocks or OCR boxes, and figures read from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import constants as K
from ..functions.amounts import amounts
from ..functions.text import is_heading_line, unit_label, unit_multiplier

SPAN = 60
#: Gaps that end a row in a band of a page.
BAND = 256


def from_blocks(blocks: DataFrame) -> DataFrame:
    """``doc_id, page_key, top, line``: texts ``doc_id, page_key, top, left, text`` of one height (to a tenth) joined from left to right."""
    rows = blocks.withColumn("top", F.bround("top", 1)).filter(F.coalesce("text", F.lit("")) != "")
    listed = F.array_sort(F.collect_list(F.struct(F.coalesce("left", F.lit(0.0)).alias("left"), "text")))
    return rows.groupBy("doc_id", "page_key", "top").agg(F.array_join(F.transform(listed, lambda x: x["text"]), " ").alias("line"))


def box_rows(boxes: DataFrame) -> DataFrame:
    """``doc_id, page, row_no, line, first``: OCR boxes ``doc_id, page, y_mid, x_left, height, text`` in rows. By descending place a row ends where the gap
    to the next box is over 0.6 of the page's upper median height; ``first`` is the text of the leftmost box. Boxes of one place are put together and heights are
    counted before a page is looked at as a whole. Places are compared within bands of the page, of which only the first and last place and the number of rows are put
    in the page's order, so a page of any size is spread over tasks."""
    page = Window.partitionBy("doc_id", "page")
    counts = boxes.groupBy("doc_id", "page", "height").agg(F.count(F.lit(1)).alias("n"))
    upto = counts.withColumn("upto", F.sum("n").over(page.orderBy("height").rowsBetween(Window.unboundedPreceding, 0))).withColumn("all", F.sum("n").over(page))
    middle = upto.filter(F.col("upto") > F.floor(F.col("all") / 2)).groupBy(F.col("doc_id").alias("__d"), F.col("page").alias("__p")).agg((F.min("height") * 0.6).alias("tolerance"))
    places = boxes.groupBy("doc_id", "page", "y_mid").agg(F.collect_list(F.struct("x_left", "text")).alias("l"))
    same_page = F.col("doc_id").eqNullSafe(F.col("__d")) & F.col("page").eqNullSafe(F.col("__p"))
    # whatever the bands are, the rows are the same; boxes without a place come first
    width = F.when(F.col("tolerance") > 0, F.col("tolerance") * BAND).otherwise(float(BAND))
    band = F.coalesce(F.floor(F.col("y_mid") / width), F.lit(-(2**63)))
    rows = places.join(middle, same_page).drop("__d", "__p").withColumn("band", band)
    within = Window.partitionBy("doc_id", "page", "band").orderBy("y_mid")
    wide = lambda before: F.coalesce((F.col("y_mid") - before > F.col("tolerance")).cast("int"), F.lit(0))
    rows = rows.withColumn("starts", wide(F.lag("y_mid").over(within)))
    rows = rows.withColumn("nth", F.sum("starts").over(within.rowsBetween(Window.unboundedPreceding, 0)))
    bands = rows.groupBy("doc_id", "page", "band").agg(F.min("y_mid").alias("y_mid"), F.max("y_mid").alias("last"), F.sum("starts").alias("inside"), F.first("tolerance").alias("tolerance"))
    down = page.orderBy(F.col("y_mid").asc_nulls_first(), "band")
    bands = bands.withColumn("head", wide(F.lag("last").over(down)))
    before = F.sum(F.col("head") + F.col("inside")).over(down.rowsBetween(Window.unboundedPreceding, 0)) - F.col("inside")
    bands = bands.select(F.col("doc_id").alias("__d"), F.col("page").alias("__p"), F.col("band").alias("__b"), before.alias("__before"))
    rows = rows.join(bands, same_page & (F.col("band") == F.col("__b"))).withColumn("row_no", (F.col("__before") + F.col("nth")).cast("int"))
    out = rows.groupBy("doc_id", "page", "row_no").agg(F.array_sort(F.flatten(F.collect_list("l"))).alias("l"))
    return out.select("doc_id", "page", "row_no", F.array_join(F.transform("l", lambda x: x["text"]), " ").alias("line"), F.element_at("l", 1)["text"].alias("first"))


def all_lines(table_rows: DataFrame, block_lines: DataFrame) -> DataFrame:
    """``doc_id, line_no, line``: a document's table rows ``doc_id, line_no, line`` and then its rebuilt rows, by page and height."""
    a = table_rows.select("doc_id", F.lit(0).alias("source_no"), F.lit(0).cast("long").alias("p"), F.col("line_no").cast("double").alias("o"), "line")
    b = block_lines.select("doc_id", F.lit(1).alias("source_no"), F.col("page_key").cast("long").alias("p"), F.col("top").cast("double").alias("o"), "line")
    order = Window.partitionBy("doc_id").orderBy("source_no", "p", "o")
    return a.unionByName(b).withColumn("line_no", F.row_number().over(order) - 1).select("doc_id", "line_no", "line")


def _top(rows: Column) -> Column:
    """The first eight rows that aren't blank."""
    return F.array_join(F.slice(F.filter(rows, lambda r: F.trim(r) != ""), 1, 8), " | ")


def is_statement_page(rows: Column) -> Column:
    return _top(rows).rlike(K.STATEMENT_HEADING) & ~_top(rows).rlike(K.NOTES_HEADING)


def is_balance_page(rows: Column) -> Column:
    return _top(rows).rlike(K.BALANCE_HEADING) & ~_top(rows).rlike(K.NOTES_HEADING)


def worth_reading(first_boxes: Column, needs_turnover: Column | None = None) -> Column:
    """Whether a scanned page, of which only each row's first box was read, is worth reading in full: a statement page with a turnover label, if turnover
    is still needed, or a balance page with a label of cash or debtors."""
    label = lambda pattern: F.exists(first_boxes, lambda r: F.trim(r).rlike(pattern))
    needs_turnover = F.lit(True) if needs_turnover is None else needs_turnover
    return (needs_turnover & is_statement_page(first_boxes) & label(K.SKIM_TURNOVER)) | (is_balance_page(first_boxes) & label(K.SKIM_BALANCE))


def labelled(lines: DataFrame, labels: dict[str, tuple[str, bool, Column | None]], keys: list[str]) -> DataFrame:
    """``*keys, label, current, prior, unit, line_no``: for each of ``labels`` (pattern, whether it is of a balance sheet, where it applies), the first row of each group of
    ``keys`` (rows ``line_no, line``) with the label and an amount. All labels are looked up in one pass over the lines.

    Amounts are in the units on the row itself, else of the 8 rows above, else of the nearest row of nothing but heading words within 40 above. The prior
    year counts if there are just two amounts within a factor of ten. Of a balance sheet, only rows from the first "Current assets" heading on count where
    there is one.
    """
    above = Window.partitionBy(*keys).orderBy("line_no")
    # what the patterns find goes to the windows, not the text; windows only run on from a group's first row, at the same cost for each row
    own = {name: F.col("line").rlike(pattern) & (F.lit(True) if applies is None else applies) for name, (pattern, _, applies) in labels.items()}
    hits = [F.when(own[name], F.struct(F.lit(name).alias("label"), F.regexp_extract("line", pattern, 1).alias("after"), F.lit(balance).alias("balance"))) for name, (pattern, balance, _) in labels.items()]
    some_balance = any(balance for _, balance, _ in labels.values())
    begins = F.col("line").rlike(K.CURRENT_ASSETS) if some_balance else F.lit(False)
    rows = lines.select(*keys, "line_no", "line", unit_multiplier(F.col("line")).alias("__mult"), F.array_compact(F.array(*hits)).alias("__hits"), begins.alias("__begins"))
    rows = rows.withColumn("__head", (F.col("__mult") > 1) & is_heading_line(F.col("line"))).drop("line").withColumn("__rn", F.row_number().over(above))
    before = above.rowsBetween(Window.unboundedPreceding, -1)
    nearest = lambda which: F.max(F.when(which, F.col("__rn"))).over(before)
    rows = rows.withColumns({"__m": nearest(F.col("__mult") == 1_000_000), "__k": nearest(F.col("__mult") == 1_000), "__hm": nearest(F.col("__head") & (F.col("__mult") == 1_000_000)), "__hk": nearest(F.col("__head") & (F.col("__mult") == 1_000))})
    if some_balance:
        whole = above.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        rows = rows.withColumn("__from", F.min(F.when(F.col("__begins"), F.col("line_no"))).over(whole))
    within = lambda c, n: F.coalesce(F.col("__rn") - F.col(c) <= n, F.lit(False))
    near = F.when(within("__m", 8), 1_000_000).when(within("__k", 8), 1_000).otherwise(1)
    last = F.greatest("__hm", "__hk")  # the one that there is, if one is null
    heading = F.when(F.col("__rn") - last <= 40, F.when(F.col("__hm") == last, 1_000_000).otherwise(1_000))
    rows = rows.filter(F.size("__hits") > 0).withColumns({"__near": near, "__heading": heading}).withColumn("__hit", F.explode("__hits"))
    if some_balance:
        rows = rows.filter(~F.col("__hit.balance") | F.col("__from").isNull() | (F.col("line_no") >= F.col("__from")))
    rows = rows.select(*keys, "line_no", "__near", "__heading", "__hit.label", F.col("__hit.after").alias("__after"))
    rows = rows.filter(~F.col("__after").rlike(r"(?U)^\s*[A-Za-z]{2,}"))
    # up to the next word of three letters other than nil
    rows = rows.withColumn("__rest", F.regexp_replace("__after", r"(?is)(?!nil(?![a-z]))[a-z]{3,}.*$", ""))
    rows = rows.withColumn("__own", unit_multiplier(F.col("__rest")))
    scale = F.when(F.col("__own") > 1, F.col("__own")).when(F.col("__near") > 1, F.col("__near")).otherwise(F.coalesce("__heading", F.lit(1)))
    rows = rows.withColumn("__scale", scale).withColumn("__values", amounts(F.col("__rest"), F.col("__scale") > 1))
    first, second = F.try_element_at("__values", F.lit(1)), F.try_element_at("__values", F.lit(2))
    share = F.abs(F.when(first != 0, second / first))
    prior = F.when((F.size("__values") == 2) & share.between(0.1, 10), F.rint(second * F.col("__scale")))
    found = F.struct(F.rint(first * F.col("__scale")).alias("current"), prior.alias("prior"), unit_label(F.col("__scale")).alias("unit"), "line_no")
    # a filter of rows without an amount would have the amounts read twice, in it and behind it
    some = F.when(F.size("__values") > 0, F.col("line_no"))
    return rows.groupBy(*keys, "label").agg(F.min_by(found, some).alias("f")).filter("f is not null").select(*keys, "label", "f.*")


def figures(lines: DataFrame, label: str, keys: list[str], balance: bool = False) -> DataFrame:
    """``*keys, current, prior, unit, line_no`` of one label, as :func:`labelled` finds it."""
    return labelled(lines, {"": (label, balance, None)}, keys).drop("label")


def first_of(found: DataFrame, keys: list[str], order: str, **columns: list[str]) -> DataFrame:
    """``*keys`` and for each label (a name of ``columns``) a struct of these columns of its row of the least ``order``; null where a label has none."""
    pick = lambda name, cs: F.min_by(F.struct(*cs), F.when(F.col("label") == name, F.col(order))).alias(name)
    return found.groupBy(*keys).agg(*[pick(name, cs) for name, cs in columns.items()])


def statement_figures(lines: DataFrame, span: int = SPAN) -> DataFrame:
    """``doc_id, turnover, cash, debtors``, each a struct of ``current, prior, unit``: the figure below the first heading of its statement that yields one within ``span``
    rows, else of the whole document. Units are looked up inside those rows alone. Lines are copied at most once for each heading that is less than ``span`` rows above,
    and read once for all labels."""
    notes = F.col("line").rlike(K.NOTES_HEADING)
    kinds = F.array_compact(F.array(*[F.when(F.col("line").rlike(h) & ~notes, F.lit(k)) for k, h in enumerate((K.STATEMENT_HEADING, K.BALANCE_HEADING))]))
    heads = lines.select(F.col("doc_id").alias("__d"), F.col("line_no").alias("slice_no"), F.explode(kinds).alias("kind"))
    near = (F.col("doc_id") == F.col("__d")) & (F.col("line_no") >= F.col("slice_no")) & (F.col("line_no") < F.col("slice_no") + span)
    parts = lines.join(heads, near).select("doc_id", "slice_no", "kind", "line_no", "line")
    whole = lines.select("doc_id", F.lit(2**31 - 1).alias("slice_no"), F.lit(2).alias("kind"), "line_no", "line")
    of_statement, of_balance = F.col("kind") != 1, F.col("kind") != 0
    labels = {"turnover": (K.TURNOVER_LABEL, False, of_statement), "cash": (K.CASH_LABEL, True, of_balance), "debtors": (K.DEBTORS_LABEL, True, of_balance)}
    found = labelled(parts.unionByName(whole), labels, ["doc_id", "slice_no", "kind"])
    return first_of(found, ["doc_id"], "slice_no", **dict.fromkeys(labels, ["current", "prior", "unit"]))
