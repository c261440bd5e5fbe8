"""Matching a list of companies to the register: by number, else by name."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..constants import MATCH_THRESHOLD, MISMATCH_THRESHOLD
from ..functions.text import bound, clean_number, normalised_name, strip
from ..storage import forget, save, spread, store

#: Scores at which names are searched by parts of them, one after the other, for those that found nothing so alike before.
LEVELS = (MATCH_THRESHOLD, 85)
#: Of a name that is like none, so many of its rarest runs find a first name to compare with: runs of so many letters, or of three where it shares none of these.
FIRST_RUNS, LONG_RUN = 3, 6
#: Names of a run that meet at once.
BLOCK = 16384
#: Classes of letters, and how many letters of a class a mask of 63 bits shows.
CLASSES, SHOWN = 21, 3
#: Pairs of names compared at once.
PAIRS = 4096


def common_length(a: str, b: str) -> int:
    """Length of the longest common subsequence: a row of the usual table is one integer, a bit for each letter of ``a``."""
    if not a or not b:
        return 0
    places: dict[str, int] = {}
    for i, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for x in b:
        kept = row & places.get(x, 0)
        row = ((row + kept) | (row - kept)) & full
    return len(a) - row.bit_count()


def ratio(a: str, b: str) -> float:
    return 200.0 * common_length(a, b) / (len(a) + len(b)) if a or b else 100.0


def similarity(a: str, b: str) -> float:
    """0 to 100 of two normalised names, as they are or with their words sorted."""
    if a == b:
        return 100.0
    return max(ratio(a, b), ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split()))))


def _letters(texts: list[str], width: int, fill: int) -> np.ndarray:
    """The code points of texts, a row each, filled up to ``width``."""
    out = np.full((len(texts), width), fill, np.uint32)
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    out[np.arange(width)[None, :] < size[:, None]] = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4")
    return out


def common_lengths(a: list[str], b: list[str]) -> np.ndarray:
    """:func:`common_length` of many pairs at once: a row of the table is 64-bit words, a bit for each letter of ``a``, and all pairs go on by a letter of ``b`` together."""
    out = np.zeros(len(a), np.int64)
    words = np.fromiter((max(1, -(-len(x) // 64)) for x in a), np.int64, len(a))
    order = np.lexsort((np.fromiter(map(len, b), np.int64, len(b)), words))
    for at in range(0, len(order), PAIRS):
        for w in np.unique(words[order[at : at + PAIRS]]).tolist():
            rows = order[at : at + PAIRS][words[order[at : at + PAIRS]] == w]
            one, other = [a[k] for k in rows], [b[k] for k in rows]
            x, y = _letters(one, -(-max(map(len, one)) // 8) * 8, 0xFFFFFFFF), _letters(other, max(map(len, other)), 0xFFFFFFFE)
            if max(x.max(initial=0, where=x < 0xFFFFFFFF), y.max(initial=0, where=y < 0xFFFFFFFE)) < 254:  # bytes are compared faster
                x, y = x.astype(np.uint8), np.minimum(y, 254).astype(np.uint8)
            row, bits = np.full((len(rows), w), ~np.uint64(0)), np.zeros((len(rows), 8 * w), np.uint8)
            for t in range(y.shape[1]):
                bits[:, : x.shape[1] // 8] = np.packbits(x == y[:, t, None], axis=1, bitorder="little")
                same = bits.view("<u8")
                kept, carry = row & same, np.zeros(len(rows), np.uint64)
                total = np.empty_like(row)
                for k in range(w):  # the sum of long integers, word by word
                    part = row[:, k] + kept[:, k]
                    total[:, k] = part + carry
                    carry = ((part < kept[:, k]) | (total[:, k] < part)).astype(np.uint64)
                row = total | (row & ~same)
            out[rows] = 64 * w - np.bitwise_count(row).sum(axis=1, dtype=np.int64)
    return out


def similarities(a: list[str], b: list[str]) -> np.ndarray:
    """:func:`similarity` of many pairs at once."""
    size = np.fromiter((len(x) + len(y) for x, y in zip(a, b, strict=True)), np.int64, len(a))
    common = common_lengths(a, b)
    ordered = {x: " ".join(sorted(x.split())) for x in {*a, *b}}
    worded = [k for k, (x, y) in enumerate(zip(a, b, strict=True)) if ordered[x] != x or ordered[y] != y]
    score = np.where(size > 0, 200.0 * common / np.maximum(size, 1), 100.0)
    if worded:
        x, y = [ordered[a[k]] for k in worded], [ordered[b[k]] for k in worded]
        both = np.fromiter((len(i) + len(j) for i, j in zip(x, y, strict=True)), np.int64, len(x))
        score[worded] = np.maximum(score[worded], np.where(both > 0, 200.0 * common_lengths(x, y) / np.maximum(both, 1), 100.0))
    return score


def _similarities(a, b) -> Column:
    """:func:`similarity` of two columns, by Arrow batches."""

    def scores(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series(similarities(x.tolist(), y.tolist()))

    return F.pandas_udf(scores, "double")(a, b)


def name_score(a: Column, b: Column) -> Column:
    """Similarity of two company names; the Python helper sees only names that differ after normalising."""
    x, y = normalised_name(a), normalised_name(b)
    return F.when(x == y, 100.0).otherwise(_similarities(x, y))


def with_keys(companies: DataFrame, numeric: bool = False) -> DataFrame:
    """Rows with a name or a number, and the two keys by which rows are the same company."""
    name, number = F.coalesce(F.col("name"), F.lit("")), F.coalesce(F.col("number").cast("string"), F.lit(""))
    return companies.filter((name != "") | (number != "")).withColumns({"name_key": F.lower(strip(name)), "number_key": clean_number(F.col("number"), numeric)})


def distinct_companies(keyed: DataFrame) -> DataFrame:
    """One row a company: ``name_key, number_key`` and name and number as its first row spells them."""
    first = F.min_by(F.struct("name", "number"), "row_no")
    return keyed.groupBy("name_key", "number_key").agg(first.alias("f")).select("name_key", "number_key", "f.name", "f.number")


def fan_out(keyed: DataFrame, results: DataFrame) -> DataFrame:
    """The result of each company for all its rows; results have the two keys and other columns."""
    r = results.withColumnsRenamed({"name_key": "__n", "number_key": "__k"})
    return keyed.join(r, F.col("name_key").eqNullSafe(F.col("__n")) & F.col("number_key").eqNullSafe(F.col("__k"))).drop("__n", "__k")


def match_numbers(companies: DataFrame, register: DataFrame) -> DataFrame:
    """Companies with a ``number_key``, left-joined to the register (``company_number, company_name, ...``); ``match_note`` says if there is none or if
    a given name differs from the registered one."""
    rows = companies.filter("number_key != ''").join(register, F.col("number_key") == F.col("company_number"), "left")
    given = strip(F.coalesce("name", F.lit("")))
    score = F.when(F.col("company_number").isNotNull() & (given != ""), name_score(given, F.col("company_name")))
    differs = F.concat(F.lit("the number belongs to "), F.col("company_name"), F.lit(", check it matches '"), given, F.lit("'"))
    missing = F.concat(F.lit("company number "), F.col("number_key"), F.lit(" not on the register"))
    return rows.withColumn("match_note", F.when(F.col("company_number").isNull(), missing).when(score < MISMATCH_THRESHOLD, differs))


def unmatched(companies: DataFrame, register: DataFrame) -> DataFrame:
    """Companies whose number is not on the register."""
    return companies.filter("number_key != ''").join(register, F.col("number_key") == F.col("company_number"), "left_anti")


def _sorted_words(name: Column) -> Column:
    return F.array_join(F.array_sort(F.split(name, " ")), " ")


def _trigrams(text: Column) -> Column:
    """The runs of three letters of a text, once each; of fewer letters none."""
    every = bound(text, lambda t: F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(t) - 2, F.lit(1))), lambda i: F.substring(t, i, F.lit(3)))))
    return F.when(F.length(text) < 3, F.array().cast("array<string>")).otherwise(every)


def _whole(text: Column) -> Column:
    """The key of a name of four letters or fewer, which is like no other at the threshold."""
    return F.when(F.length(text) < 5, F.array(F.concat(F.lit("="), text))).otherwise(F.array().cast("array<string>"))


def blocks(name: Column) -> Column:
    """The keys of a normalised name: the runs of three letters of the name as it is and with its words sorted, and all of a short one."""
    return F.array_distinct(F.concat(_trigrams(name), _trigrams(_sorted_words(name)), _whole(name)))


def registered_names(register: DataFrame) -> DataFrame:
    """A stored row for each different normalised name: ``rid, registered``, its company of the least number, how many have it, and its letters as of :func:`with_masks`."""
    named = spread(register.select("company_number", "company_name"), "company_number", "company_name").withColumn("registered", normalised_name(F.col("company_name")))
    one = named.groupBy("registered").agg(F.min("company_number").alias("company_number"), F.min_by("company_name", "company_number").alias("company_name"), F.count(F.lit(1)).alias("companies"))
    masked = with_masks(one.withColumn("rid", F.monotonically_increasing_id()), "registered")
    return save(masked.withColumnsRenamed({"mask": "r_mask", "rest": "r_rest", "size": "r_size"}), "registered")


def _letter_masks(names: pd.Series) -> pd.DataFrame:
    """Which letters names have, in 63 bits (of each class of letters the first three set a bit each), and how many letters have no bit."""
    texts = names.tolist()
    masks, rest = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int32)
    if texts and any(texts):
        letters = _letters(texts, max(map(len, texts)), 0xFFFFFFFF)
        kind = np.where(letters == 0xFFFFFFFF, CLASSES, letters % CLASSES)
        for c in range(CLASSES):
            n = (kind == c).sum(axis=1)
            masks |= ((1 << np.minimum(n, SHOWN)) - 1) << (SHOWN * c)
            rest += np.maximum(n - SHOWN, 0).astype(np.int32)
    return pd.DataFrame({"mask": masks, "rest": rest})


def with_masks(names: DataFrame, column: str) -> DataFrame:
    """Names with ``mask, rest, size``, by which :func:`_best_score` bounds their scores."""
    made = F.pandas_udf(_letter_masks, "mask long, rest int")(column)
    return names.withColumn("__m", made).select("*", "__m.mask", "__m.rest", F.length(column).alias("size")).drop("__m")


def _best_score() -> Column:
    """The score that a name (``mask, rest, size``) and a registered one (``r_mask, r_rest, r_size``) can't exceed: that of their letters in any order, so also with words
    sorted."""
    common = F.least(F.bit_count(F.col("mask").bitwiseAND(F.col("r_mask"))) + F.least("rest", "r_rest"), "size", "r_size")
    return 200.0 * common / (F.col("size") + F.col("r_size"))


def fitting_lengths(own: list[int], other: list[int], least: float) -> list[tuple[int, int, int, int]]:
    """``n, m, out, put``: lengths of names and registered names that can reach the score, and how many letters of the registered one are left out at most, and how many
    put in."""
    found = []
    for n in own:
        for m in other:
            common = int(np.ceil(least * (n + m) / 200.0 - 1e-9))
            if common <= min(n, m):
                found.append((n, m, m - common, n - common))
    return found


def pairs_by_parts(own: DataFrame, reg: DataFrame, least: float) -> DataFrame:
    """Pairs of ``own`` (``sid, searched, mask, rest, size``) and ``reg`` (``rid, registered, r_mask, r_rest, r_size``) among which are all that reach the score.

    A registered name is cut into one part more than letters can be left out or put in. Of these a part is whole in the name, before which as many letters are left out or
    put in as there are parts before it, so it is looked for at a few places only.
    """
    spark = own.sparkSession
    lengths = lambda df, c: [r[0] for r in df.select(c).distinct().collect()]
    fits = fitting_lengths(lengths(own, "size"), lengths(reg, "r_size"), least)
    table = spark.createDataFrame(fits, "n int, m int, out int, put int").withColumn("e", F.col("out") + F.col("put"))
    forms = lambda c: F.explode(F.array_distinct(F.array(F.col(c), _sorted_words(F.col(c)))))
    begin, end = (F.floor((F.col("i") + k) * F.col("m") / (F.col("e") + 1)).cast("int") for k in (0, 1))
    key = lambda at: F.xxhash64("m", "e", "i", F.substring("text", at + 1, F.col("__end") - F.col("__begin")))
    cut = lambda df: df.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("e")))).withColumns({"__begin": begin, "__end": end})
    r = reg.join(F.broadcast(table.select("m", "e").distinct()), F.col("r_size") == F.col("m")).withColumn("text", forms("registered"))
    r = cut(r).select(key(F.col("__begin")).alias("key"), "rid", "r_mask", "r_rest", "r_size")
    q = cut(own.join(F.broadcast(table), F.col("size") == F.col("n")).withColumn("text", forms("searched")))
    q = q.withColumn("__by", F.explode(F.sequence(-F.col("i"), F.col("i"), F.when(F.col("i") > 0, 2).otherwise(1))))
    put = (F.col("i") + F.col("__by")) / 2
    after = F.col("n") - F.col("m") - F.col("__by")
    q = q.filter((put <= F.col("put")) & (F.col("i") - put <= F.col("out")) & (F.abs(after) <= F.col("e") - F.col("i")))
    at = F.col("__begin") + F.col("__by")
    q = q.filter((at >= 0) & (at + F.col("__end") - F.col("__begin") <= F.col("n"))).select(key(at).alias("__key"), "sid", "mask", "rest", "size")
    return q.join(r, F.col("__key") == F.col("key")).filter(_best_score() >= least - 1e-9).select("sid", "rid").distinct()


def scored_pairs(pairs: DataFrame, own: DataFrame, reg: DataFrame, least: float = 0, shared: bool = False) -> DataFrame:
    """``sid, searched, company_number, company_name, companies, score`` of the pairs ``sid, rid`` that reach the score and share a run of three letters; ``shared``: all
    do."""
    texts = spread(pairs.join(own.select("sid", "searched"), "sid"), "rid").join(reg.select("rid", "registered", "company_number", "company_name", "companies"), "rid")
    scored = texts.withColumn("score", F.when(F.col("searched") == F.col("registered"), 100.0).otherwise(_similarities("searched", "registered")))
    if not shared:
        # a letter left out breaks three runs of a name, and a place at which letters are put in two; runs are compared only where that may be all of them
        n, m = F.length("searched"), F.length("registered")
        common = F.col("score") * (n + m) / 200.0 - 1e-6
        surely = (m - 2 > 3 * (m - common) + 2 * (n - common)) | (n - 2 > 3 * (n - common) + 2 * (m - common))
        compared = F.when(surely, True).otherwise(F.arrays_overlap(blocks(F.col("searched")), blocks(F.col("registered"))))
        scored = scored.filter(F.when(F.col("score") >= least, compared))
    return scored.drop("rid", "registered")


def closest_of(scored: DataFrame) -> DataFrame:
    """``sid, searched, company_number, company_name, score, good`` of scored pairs: the most alike (ties: the least number), and the companies that reach the threshold."""
    place = F.min(F.struct((-F.col("score")).alias("less"), "company_number", "company_name")).alias("best")
    best = scored.groupBy("sid", "searched").agg(place, F.sum(F.when(F.col("score") >= MATCH_THRESHOLD, F.col("companies")).otherwise(0)).alias("good"))
    return best.select("sid", "searched", "best.company_number", "best.company_name", (-F.col("best.less")).alias("score"), "good")


def candidates(names: DataFrame, register: DataFrame, least: float = MATCH_THRESHOLD) -> DataFrame:
    """``searched, registered`` of :func:`pairs_by_parts`."""
    reg = registered_names(register)
    own = with_masks(names.select("searched").distinct().withColumn("sid", F.xxhash64("searched")), "searched")
    return pairs_by_parts(own, reg, least).join(own, "sid").join(reg, "rid").select("searched", "registered")


def _long_runs(name: Column) -> Column:
    """The runs of ``LONG_RUN`` letters of a normalised name as it is and with its words sorted."""
    every = lambda text: F.transform(F.sequence(F.lit(1), F.length(text) - (LONG_RUN - 1)), lambda i: F.substring(text, i, F.lit(LONG_RUN)))
    of = lambda text: F.when(F.length(text) < LONG_RUN, F.array().cast("array<string>")).otherwise(bound(text, every))
    return F.array_distinct(F.concat(of(name), of(_sorted_words(name))))


def _met(asked: pa.Table, known: pa.Table) -> pa.Table:
    """``sid, rid`` of the names ``sid, mask, rest, size, least`` and the registered ones ``rid, r_mask, r_rest, r_size`` of a run whose letters can reach ``least``, as
    :func:`_best_score` has it: all with all, by arrays."""
    column = lambda t, c: t.column(c).to_numpy()
    order = np.lexsort((column(known, "r_rest"), column(known, "r_size")))
    rid, other, more, long = (column(known, c)[order] for c in ("rid", "r_mask", "r_rest", "r_size"))
    sid, mask, rest, size, least = (column(asked, c) for c in ("sid", "mask", "rest", "size", "least"))
    # registered names of one length and rest have one limit for a name
    edges = np.flatnonzero(np.r_[True, (np.diff(long) != 0) | (np.diff(more) != 0), True])[: None if len(rid) else 0]
    limits = []
    for at in edges[:-1]:
        need = np.ceil((least - 1e-9) * (size + long[at]) / 200.0)
        limits.append(np.where(need > np.minimum(size, long[at]), 255, np.clip(need - np.minimum(rest, more[at]), 0, 254)).astype(np.uint8))
    found = []
    step = max(1, (1 << 20) // max(1, len(rid)))
    for k in range(0, len(sid), step):
        common = np.bitwise_count(mask[k : k + step, None] & other[None, :])
        for limit, begin, end in zip(limits, edges[:-1], edges[1:], strict=True):
            s, r = np.nonzero(common[:, begin:end] >= limit[k : k + step, None])
            if len(s):
                found.append((sid[k + s], rid[begin + r]))
    s, r = (np.concatenate([f[i] for f in found]) if found else np.zeros(0, np.int64) for i in (0, 1))
    return pa.table({"sid": pa.array(s, pa.int64()), "rid": pa.array(r, pa.int64())})


def pairs_by_runs(open_: DataFrame, reg: DataFrame) -> DataFrame:
    """``sid, rid`` of names that are like none and the registered names that share a run of three letters with them and can be their closest.

    A first name, of those that share one of the rarest long runs the one that can be most alike, gives a score that the closest can't fall below. All that share any run
    are then met, in blocks of a run's names that are compared by their letters as arrays; only pairs whose letters reach that score leave the block.
    """
    runs = lambda df, column, how, *columns: df.select(F.explode(how(F.col(column))).alias("key"), *columns)
    letters, own = ("rid", "r_mask", "r_rest", "r_size"), ("sid", "mask", "rest", "size")
    count = F.count(F.lit(1))
    rare = Window.partitionBy("sid").orderBy("df", "key")
    rarest = lambda asking: asking.withColumn("nth", F.row_number().over(rare)).filter(F.col("nth") <= FIRST_RUNS)
    first = lambda asking, how: asking.join(runs(reg, "registered", how, *letters), "key").groupBy("sid").agg(F.max_by("rid", F.struct(_best_score(), "rid")).alias("rid"))
    long = runs(reg, "registered", _long_runs).groupBy("key").agg(count.alias("df"))
    long = save(rarest(runs(open_, "searched", _long_runs, *own).join(long, "key")).select("key", *own), "rarest")
    frequency = runs(reg, "registered", blocks).groupBy("key").agg(count.alias("df")).join(runs(open_, "searched", blocks).groupBy("key").agg(count.alias("asking")), "key")
    frequency = save(frequency, "frequency")
    others = open_.join(long.select("sid").distinct(), "sid", "left_anti")
    short = save(rarest(runs(others, "searched", blocks, *own).join(frequency, "key")).select("key", *own), "rarest")
    firsts = first(long, _long_runs) if short.isEmpty() else first(long, _long_runs).unionByName(first(short, blocks))
    least = save(scored_pairs(firsts, open_, reg, shared=True).select("sid", F.col("score").alias("least")), "least")
    # a run's names on either side are dealt to blocks, and each block of the one meets each of the other
    number = lambda n: F.ceil(F.col(n) / BLOCK).cast("int")
    dealt = lambda name, n: F.pmod(F.xxhash64(name), number(n)).cast("int")
    all_of = lambda n: F.explode(F.sequence(F.lit(0), number(n) - 1))
    mine = runs(open_.join(least, "sid", "left").withColumn("least", F.coalesce("least", F.lit(0.0))), "searched", blocks, *own, "least").join(frequency, "key")
    mine = mine.select("key", dealt("sid", "asking").alias("a"), all_of("df").alias("b"), *own, "least")
    known = runs(reg, "registered", blocks, *letters).join(frequency, "key").select("key", all_of("asking").alias("a"), dealt("rid", "df").alias("b"), *letters)
    by = ("key", "a", "b")
    return spread(mine, *by).groupBy(*by).cogroup(spread(known, *by).groupBy(*by)).applyInArrow(_met, "sid long, rid long").distinct()


def closest_names(names: DataFrame, register: DataFrame) -> DataFrame:
    """``searched, company_number, company_name, score, good`` of every different searched name that shares a run of three letters with a registered one: the most alike of
    these (ties: the least number), and how many companies reach the threshold.

    Names are searched at falling scores. What a name finds at a score or above is the closest there is, and it isn't searched again; so only names that are like none
    meet all that share any run with them. No pairs are shuffled but those whose letters allow the score.
    """
    spark = names.sparkSession
    reg = registered_names(register)
    own = with_masks(names.select("searched").filter("searched != ''").distinct().withColumn("sid", F.monotonically_increasing_id()), "searched")
    open_, path = store(own, "open")
    found: DataFrame | None = None
    for least in (*LEVELS, 0):
        scored = scored_pairs(pairs_by_parts(open_, reg, least) if least else pairs_by_runs(open_, reg), open_, reg, least, shared=not least)
        closed = save(closest_of(scored), "closest")
        found = closed if found is None else found.union(closed)
        before = path
        open_, path = store(open_.join(closed.select(F.col("sid").alias("c")), F.col("sid") == F.col("c"), "left_anti"), "open")
        forget(spark, before)
        if open_.isEmpty():
            break
    forget(spark, path)
    assert found is not None
    return found.drop("sid")


def match_names(companies: DataFrame, register: DataFrame) -> DataFrame:
    """Companies without a number, with the register's best match for their name; null company_number where none is accepted, and then the note names the closest."""
    rows = save(spread(companies.filter("number_key = ''"), *companies.columns).withColumn("searched", normalised_name(F.col("name"))), "named")
    accepted, several = F.col("score") >= MATCH_THRESHOLD, F.col("good") > 1
    note = F.when(~accepted, F.concat(F.lit("no confident match (closest: "), F.col("company_name"), F.lit(", "), F.format_number(F.rint("score"), 0), F.lit("%), add the company number")))
    note = note.when(several, F.lit("several companies with near-identical names, add the company number to be sure"))
    best = closest_names(rows, register).select(F.col("searched").alias("__s"), "company_number", "company_name", "score", accepted.alias("accepted"), (accepted & several).alias("ambiguous"), note.alias("match_note"))
    joined = rows.join(best, F.col("searched") == F.col("__s"), "left").drop("__s")
    note = F.when(F.col("score").isNull(), "company not found on the register").otherwise(F.col("match_note"))
    keep = lambda c: F.when(F.col("accepted"), F.col(c)).alias(c)
    return joined.select(*companies.columns, keep("company_number"), keep("company_name"), "score", F.coalesce("ambiguous", F.lit(False)).alias("ambiguous"), note.alias("match_note"))
